"""Token ids of many texts with a tokenizer file, encoding each distinct piece once per worker."""

from __future__ import annotations

import json
import os
import re
import string
import unicodedata
from array import array
from collections.abc import Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from dipstick.llm.common import by_value

by_value(__name__)

# White space that the byte-level split knows beyond ASCII; texts with it are encoded whole.
_WIDE = re.compile("[" + "".join(map(chr, (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))) + "]")
_BLANK = " \t\n\r\x0b\x0c"
_CHUNK = re.compile(f" ?[^{_BLANK}]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+")
# Words of these letters are one piece to both layouts, and the same in normal form.
_PLAIN = re.compile(" ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
# Byte-level models write each byte as a letter; those without one of their own follow U+0100.
_HIDDEN = [b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b)]
_LETTERS = {b: 0x100 + i for i, b in enumerate(_HIDDEN)}

_SPELLED = np.array([_LETTERS.get(b, b) for b in range(256)], "<u4")


def _layout(spec: dict) -> str | None:
    """How the tokenizer splits texts: ``spaced`` byte-level words, lower-case ``words``, or unknown."""
    before, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not norm:
        return "spaced"
    steps = before.get("pretokenizers") or [{}]
    lowers = any(n.get("type") == "Lowercase" for n in (norm or {}).get("normalizers", []))
    if lowers and steps[0].get("type") == "Split" and steps[0].get("invert") and spec["model"].get("end_of_word_suffix"):
        return "words"
    return None


def _ends_word(letter: str) -> bool:
    """Whether this is still a letter or digit at its end in normal form and lower case, where some become letter and mark."""
    return unicodedata.normalize("NFC", letter).lower()[-1:].isalnum()


def _strings(values: pa.Array) -> list[str]:
    return values.to_numpy(zero_copy_only=False).tolist()


class PieceEncoder:
    """Encodes texts as the ``tokenizers`` library does, from the ids of their pieces.

    Both known layouts never merge across a boundary between white space and a word, nor between a
    letter or digit (in normal form) and the ASCII punctuation that ends a word. So a text's ids are those of its
    pieces, a piece's are those of its word and its tail, and the library sees each of these once. Texts where this does not hold (special
    strings, white space beyond ASCII) and tokenizers of another layout are encoded whole. The words of many texts are
    split, coded and cut by Arrow, so that Python meets each of them once a call. At most about
    ``limit`` words, or 8 ids for each, are remembered; then the memory starts anew, which changes no result.
    """

    def __init__(self, content: str, limit: int = 1 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        spec = json.loads(content)
        self.tokenizer, self.limit = Tokenizer.from_str(content), limit
        self.model, self.layout = self.tokenizer.model, _layout(spec)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self._reset()

    def _reset(self) -> None:
        self.units: dict[str, int] = {"": 0}  # the first row is the empty tail
        self.ids, self.ends = array("I"), array("q", [0, 0])

    def _split(self, texts: Sequence[str]) -> tuple[pa.Array, np.ndarray, dict[int, str]]:
        """Pieces of all texts, their number for every text, and the texts to encode whole by place; these have no pieces that count."""
        if self.layout == "words":
            texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
            # Lower-casing first saves pieces; beyond ASCII it need not commute with the normal form.
            low = pc.if_else(pc.string_is_ascii(texts), pc.ascii_lower(texts), texts)
            odd = np.zeros(len(texts), bool)
            for s in self.special:
                odd |= pc.match_substring(low, s).to_numpy(zero_copy_only=False)
            lists = pc.ascii_split_whitespace(pc.if_else(pa.array(odd), "", low))
            whole = {i: texts[i].as_py() for i in np.flatnonzero(odd).tolist()}
            return lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False), whole
        whole, split = {}, []
        for i, text in enumerate(texts.to_pylist() if isinstance(texts, pa.Array) else texts):
            if self.layout is None or any(s in text for s in self.special) or not text.isascii() and _WIDE.search(text):
                whole[i] = text
                split.append(())
            else:
                split.append(_CHUNK.findall(text))
        counts = np.fromiter(map(len, split), np.int64, len(split))
        return pa.array(list(chain.from_iterable(split)), pa.string()), counts, whole

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[list[int]]:
        """Ids of plain words, put into the model's letters in one go."""
        joined = "\n".join(words)
        low = joined if self.layout == "spaced" else joined.lower()
        letters = _SPELLED[np.frombuffer(low.encode(), np.uint8)].tobytes().decode("utf-32-le")
        tokenize = self.model.tokenize
        return [[t.id for t in tokenize(w)] for w in letters.split(chr(_LETTERS[10]))]

    def _store(self, ids: list[list[int]]) -> range:
        """Rows of lists of ids that are appended to the memory."""
        first = len(self.ends) - 1
        self.ends.extend((np.cumsum([len(i) for i in ids], dtype=np.int64) + len(self.ids)).tolist())
        self.ids.extend(chain.from_iterable(ids))
        return range(first, first + len(ids))

    def _learn(self, new: set[str]) -> None:
        plain = [u for u in new if _PLAIN.fullmatch(u)]
        odd = list(new.difference(plain))
        for some, ids in ((plain, self._words), (odd, self._whole)):
            if some:
                self.units.update(zip(some, self._store(ids(some))))

    def _halves(self, pieces: pa.Array) -> np.ndarray:
        """Rows of the word and the tail of every piece, side by side; what is new is learned first."""
        stems = pc.ascii_rtrim(pieces, string.punctuation)
        last = pc.utf8_slice_codeunits(stems, -1).dictionary_encode()
        ends = np.array([_ends_word(c) for c in _strings(last.dictionary)], bool)[last.indices.to_numpy()]
        stems = pc.if_else(pa.array(ends), stems, pieces)
        cut = np.flatnonzero(pc.not_equal(stems, pieces).to_numpy(zero_copy_only=False))
        tails = [p[len(s) :] for p, s in zip(_strings(pieces.take(pa.array(cut))), _strings(stems.take(pa.array(cut))))]
        coded = stems.dictionary_encode()
        words = _strings(coded.dictionary)
        self._learn({*words, *tails} - self.units.keys())
        rows = np.zeros((len(pieces), 2), np.int64)
        rows[:, 0] = np.fromiter(map(self.units.__getitem__, words), np.int64, len(words))[coded.indices.to_numpy()]
        rows[cut, 1] = [self.units[t] for t in tails]
        return rows

    def _rows(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.ends) > self.limit or len(self.ids) > 8 * self.limit:
            self._reset()
        pieces, counts, whole = self._split(texts)
        coded = pieces.dictionary_encode()
        rows, counts = self._halves(coded.dictionary)[coded.indices.to_numpy()].ravel(), 2 * counts
        if whole:
            places = np.array(list(whole))
            rows = np.insert(rows, np.cumsum(counts)[places], self._store(self._whole(list(whole.values()))))
            counts[places] += 1
        return rows, counts

    def lengths(self, texts: Sequence[str]) -> np.ndarray:
        """Number of tokens of every text."""
        rows, counts = self._rows(texts)
        total = np.concatenate([[0], np.cumsum(np.diff(np.array(self.ends))[rows])])
        ends = np.cumsum(counts)
        return total[ends] - total[ends - counts]

    def encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after the other, and the number of ids of every text."""
        rows, counts = self._rows(texts)
        ends = np.array(self.ends)
        sizes = (ends[1:] - ends[:-1])[rows]
        total = np.concatenate([[0], np.cumsum(sizes)])
        at = np.arange(total[-1]) + np.repeat(ends[rows] - total[:-1], sizes)
        last = np.cumsum(counts)
        return np.array(self.ids)[at], total[last] - total[last - counts]
