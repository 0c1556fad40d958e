"""Benchmark decontamination: canonical template windows, joined by hash and checked slot by slot."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dipstick.llm.common import by_value, kept, pieces, text_of, worker_memo

by_value(__name__)

WORD, NUMBER, UNIT, NAME, STOP = 0, 1, 2, 3, 4
# Classes of code points: words are runs of letters, numbers runs of digits, and every end stands alone.
OTHER, LETTER, DIGIT, END = 0, 1, 2, 3
UPPER, FIGURE = 4, 8
ENDS = ".!?\n"
# Unit words, known as such after a number.
UNITS = set(
    "mm cm m km inch inches foot feet ft yard yards mile miles mg g kg gram grams kilogram kilograms ounce ounces "
    "pound pounds lb lbs ton tons ml l liter liters litre litres gallon gallons second seconds sec minute minutes min "
    "hour hours hr day days week weeks month months year years kmh mph percent dollar dollars euro euros cent cents "
    "degree degrees celsius fahrenheit watt watts volt volts".split()
)
_MARK = {k: xxhash.xxh64_intdigest(f"\x00{k}") for k in (NUMBER, UNIT, NAME)}
# Number of bits of the filter that tells tasks which windows a benchmark may hold.
FILTER_BITS = 22
# Runs of code points hashed at a time, and weights of the places in a run, which repeat after these.
RUNS, WEIGHTS = 1 << 15, 1 << 10


def _multipliers(n: int) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(f"multiplier {i}") | 1 for i in range(n)], np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _code_points() -> tuple[np.ndarray, np.ndarray]:
    """Of every code point its class, with marks of capitals and of other figures than digits (as ²), and the hash of its lower case.

    Words equal in lower case have equal hashes: Python knows two forms of a small sigma, by place, which share theirs, and
    the only letter whose lower case is two code points stands for itself.
    """
    size = sys.maxunicode + 1
    known = "".join(filter(str.isalnum, map(chr, range(size))))
    letters = "".join(re.findall(r"[^\W\d_]+", known))
    marks, lower = np.zeros(size, np.uint8), np.arange(1, size + 1, dtype=np.uint64)
    for chars, mark in ((letters, LETTER), ("".join(re.findall(r"\d+", known)), DIGIT), (ENDS, END)):
        marks[_points(chars)] = mark
    for test, mark in ((str.isupper, UPPER), (str.isdigit, FIGURE)):
        marks[_points("".join(filter(test, letters)))] |= mark
    for c in letters:
        low = c.lower()
        if low != c and len(low) == 1:
            lower[ord(c)] = ord(low) + 1
    lower[ord("ς")] = lower[ord("σ")]
    return marks, _mixed(lower * np.uint64(0x9E3779B97F4A7C15))


class Canonical:
    """Tokens of texts in canonical form: hashes of the plain form, of the form with names, of the words themselves, and kinds.

    Texts are cut and hashed as arrays of code points; no token becomes a Python object, and none is remembered.
    """

    def __init__(self):
        self.marks, self.codes = _code_points()
        self.weights = _multipliers(WEIGHTS)
        units = sorted(UNITS)
        cuts = np.cumsum([0, *map(len, units)])
        hashes = self._hashes(_points("".join(units)), cuts[:-1], cuts[1:])
        self.known: dict[int, str] = dict(zip(hashes.tolist(), units))
        self.unit_hashes = np.sort(hashes)

    def _hashes(self, points: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of runs that follow each other without gaps."""
        out = np.zeros(len(begins), np.uint64)
        for at in range(0, len(begins), RUNS):
            first, last = begins[at : at + RUNS], ends[at : at + RUNS]
            here = slice(first[0], last[-1])
            place = np.arange(here.start, here.stop)
            place -= np.repeat(first, last - first)
            place &= WEIGHTS - 1
            codes = self.codes[points[here]]
            codes *= self.weights[place]
            out[at : at + RUNS] = np.add.reduceat(codes, first - first[0])
        return _mixed(out)

    def _runs(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(begins, ends, marks of the first code point) of the runs of a class; a point or comma between digits belongs to the number."""
        marks = self.marks[points]
        of = marks & 3
        inner = np.flatnonzero((points == ord(".")) | (points == ord(",")))
        inner = inner[(inner > 0) & (inner < len(points) - 1)]
        of[inner[(of[inner - 1] == DIGIT) & (of[inner + 1] == DIGIT)]] = DIGIT
        edge = of == END
        edge[:1] = True
        edge[1:] |= of[1:] != of[:-1]
        begins = np.flatnonzero(edge)
        return begins, np.append(begins, len(points))[1:], marks[begins]

    def __call__(self, texts: list[str]):
        """(begins, ends, document, plain hashes, hashes with names, literal hashes, kinds, number or unit word) without sentence ends.

        Tokens begin and end at places in the joined texts (``joined``). A unit counts as one only after a number, a name only inside a sentence.
        """
        text = joined(texts)
        points = _points(text)
        begins, ends, marks = self._runs(points)
        own = self._hashes(points, begins, ends)
        token = (marks & 3) != OTHER
        begins, ends, marks, own = begins[token], ends[token], marks[token], own[token]
        n = len(begins)
        kind = np.where(marks & UPPER, np.int8(NAME), np.int8(WORD))
        near = np.searchsorted(self.unit_hashes[1:], own, "right")
        for at in np.flatnonzero(self.unit_hashes[near] == own).tolist():
            if text[begins[at] : ends[at]].lower() == self.known[int(own[at])]:
                kind[at] = UNIT
        kind[((marks & 3) == DIGIT) | ((marks & FIGURE) > 0)] = NUMBER
        kind[(marks & 3) == END] = STOP
        firsts = np.searchsorted(begins, np.cumsum([0, *(len(t) + 1 for t in texts)]))
        doc = np.repeat(np.arange(len(texts)), np.diff(firsts))
        plain, typed = own.copy(), (kind == NUMBER) | (kind == UNIT)
        starts = np.ones(n, bool)
        starts[1:] = (kind[:-1] == STOP) | (doc[1:] != doc[:-1])
        after = np.zeros(n, bool)
        after[1:] = (kind[:-1] == NUMBER) & (doc[1:] == doc[:-1])
        kind[(kind == NAME) & starts] = WORD
        kind[(kind == UNIT) & ~after] = WORD
        for placeholder in (NUMBER, UNIT):
            plain[kind == placeholder] = np.uint64(_MARK[placeholder])
        named = plain.copy()
        named[kind == NAME] = np.uint64(_MARK[NAME])
        real = kind != STOP
        return begins[real], ends[real], doc[real], plain[real], named[real], own[real], kind[real], typed[real]


def joined(texts: list[str]) -> str:
    """The texts in a row, with a code point between them that is in no token."""
    return "\0".join(texts)


def _rolling(hashes: np.ndarray, length: int) -> np.ndarray:
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k, m in enumerate(_multipliers(length)):
        out += hashes[k : k + n] * m
    return out ^ (out >> np.uint64(29))


def _windows(canon: Canonical, texts: list[str], wanted: list[tuple[int, int]], literal: float):
    """For each wanted (length, form): where tokens begin and end, all windows' hashes, and which windows are templates.

    Form 0 has placeholders for numbers and units, form 1 for names too; both need a share of
    ``literal`` words. Form 2 has none: it takes the windows with a number or unit word as they stand.
    """
    begins, ends, doc, plain, named, own, kind, typed = canon(texts)
    first = np.searchsorted(doc, np.arange(len(texts)))
    place = np.arange(len(doc)) - first[doc] if len(doc) else doc
    forms = ((plain, (kind == NUMBER) | (kind == UNIT)), (named, kind != WORD), (own, np.zeros(len(doc), bool)))
    for length, form in wanted:
        n = len(doc) - length + 1
        if n <= 0:
            continue
        hashes, slot = forms[form]

        def held(marks: np.ndarray) -> np.ndarray:
            sums = np.concatenate([[0], np.cumsum(marks)])
            return sums[length:] - sums[:-length]

        ok = doc[:n] == doc[length - 1 :]
        if form < 2:
            ok &= held(slot) <= (1 - literal) * length
        if form:  # without a name, or a number or unit word, this form is the plain one
            ok &= held(typed if form == 2 else kind == NAME) > 0
        if ok.any():
            yield begins, ends, doc, place, length, form, _rolling(hashes, length), slot, ok


def _describe(text: str, begins: np.ndarray, ends: np.ndarray, slot: np.ndarray, at: int, length: int) -> tuple[str, list[str]]:
    span = slice(at, at + length)
    words = [text[b:e].lower() for b, e in zip(begins[span].tolist(), ends[span].tolist())]
    slots = slot[span].tolist()
    return " ".join("\x01" if s else w for w, s in zip(words, slots)), [w for w, s in zip(words, slots) if s]


_SCHEMA = pa.schema(
    [("id", pa.int64()), ("row", pa.int64()), ("size", pa.int64()), ("place", pa.int64()), ("length", pa.int64()), ("form", pa.int64()),
     ("hash", pa.int64()), ("canon", pa.string()), ("slots", pa.list_(pa.string()))]
)
_DDL = "id bigint, row bigint, size bigint, place bigint, length bigint, form bigint, hash bigint, canon string, slots array<string>"


def windows(rows: DataFrame, window: int, wanted: list[tuple[int, int]] | None, literal: float, filters: dict[int, bytes] | None) -> DataFrame:
    """The template windows of ``rows`` (id, text): a row for each, or for each that the filter lets by.

    ``wanted`` tells lengths and forms. None: all forms, and a text shorter than ``window`` is one
    window of its own length (benchmark items).
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        canon = worker_memo("canonical", Canonical)
        number = TaskContext.get().partitionId() << 36
        bits = np.unpackbits(np.frombuffer(b"".join(filters[k] for k in sorted(filters)), np.uint8), bitorder="little") if filters else None
        for batch in pieces(batches, 500):
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out = []
            if wanted is None:
                sizes = np.bincount(canon(texts)[2], minlength=len(texts)).tolist()
                groups: dict[int, list[int]] = {}
                for i, size in enumerate(sizes):
                    groups.setdefault(min(size, window), []).append(i)
                jobs = [([(n, form) for form in range(3)], where) for n, where in groups.items() if n]
            else:
                sizes, jobs = None, [(wanted, list(range(len(texts))))]
            for sizes_wanted, where in jobs:
                some = [texts[i] for i in where]
                text = joined(some)
                for begins, ends, doc, place, length, form, hashes, slot, ok in _windows(canon, some, sizes_wanted, literal):
                    if bits is not None:
                        ok = ok & (bits[(hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] > 0)
                    for at in np.flatnonzero(ok).tolist():
                        i = where[doc[at]]
                        words, slots = _describe(text, begins, ends, slot, at, length)
                        h = int(hashes[at : at + 1].view(np.int64)[0])
                        out.append((ids[i], number + i, sizes[i] if sizes else 0, int(place[at]), length, form, h, words, slots))
            number += len(ids)
            columns = list(zip(*out)) if out else [[]] * len(_SCHEMA)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA)], schema=_SCHEMA)

    return rows.mapInArrow(work, _DDL)


def window_filter(items: DataFrame) -> dict[int, bytes]:
    """The bits of all benchmark windows' hashes: half a megabyte however large the benchmark is."""
    bit = F.shiftrightunsigned("hash", 64 - FILTER_BITS)
    size = 32768
    rows = items.groupBy(F.floor(bit / size).alias("part")).agg(F.bitmap_construct_agg((bit % size).cast("bigint")).alias("bits")).collect()
    found = {int(r["part"]): bytes(r["bits"]) for r in rows}
    return {k: found.get(k, bytes(size // 8)) for k in range((1 << FILTER_BITS) // size)}


def _agreeing(hits: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """The hits less those with a slot whose value stands for two within ``key``, one way or the other; and these values."""
    slots = hits.select(*key, F.explode(F.arrays_zip("item_slots", "doc_slots")).alias("s")).select(*key, "s.item_slots", "s.doc_slots").distinct()
    n = F.count("*").alias("n")
    one = slots.groupBy(*key, F.col("item_slots").alias("value")).agg(n).where("n > 1").select(*key, "value", F.lit("item").alias("side"))
    other = slots.groupBy(*key, F.col("doc_slots").alias("value")).agg(n).where("n > 1").select(*key, "value", F.lit("doc").alias("side"))
    values = kept(one.unionByName(other), "slots-that-disagree")
    bad = values.groupBy(*key).agg(*[F.collect_set(F.when(F.col("side") == side, F.col("value"))).alias(f"bad_{side}") for side in ("item", "doc")])
    none = F.array().cast("array<string>")
    good = ~F.arrays_overlap("item_slots", F.coalesce("bad_item", none)) & ~F.arrays_overlap("doc_slots", F.coalesce("bad_doc", none))
    return hits.join(bad, key, "left").where(good).drop("bad_item", "bad_doc"), values


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 8, cover: int = 13, literal: float = 0.5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, n_windows, n_covered, item_words, same_slots): documents that hold a benchmark item.

    Words are lower-cased; numbers, units after a number and names inside a sentence become typed
    placeholders. Every run of ``window`` canonical words is a template window, in a form that keeps
    names and, where it has any, one that does not; where it holds a number or unit word it is also
    taken as it stands, so that a literal copy is found however many numbers it has. Windows of documents and items are joined by
    hash and compared word by word. Then slots are checked: one value must always stand for the same
    other value, both ways, or the windows that disagree are left out. That is asked of all windows
    of a document and an item together and, where some disagree, of each occurrence by itself: of
    each diagonal (place in the document less place in the item), and of neighbouring diagonals up
    to ``window // 2`` and up to ``2 * window`` words apart, for copies with words put in or left
    out. Covers are counted likewise. A document is reported with an item when its remaining windows cover ``cover`` words of the
    item, or all of a shorter one. That finds whole and partial copies, and re-asked questions with
    other numbers and names. ``same_slots`` tells the copies.

    Windows with over half of placeholders are used as they stand only. Before the join, tasks drop windows whose
    bit is missing in a filter of fixed size made from all items; the join decides. A window that many
    documents hold is split by the adaptive join, or its side is broadcast by measured size.

    NULL texts have no windows. Rows of equal id are looked at apart and reported once by id; items of
    equal id likewise; with an empty table nothing is reported.
    """
    items = benchmark.select(F.col(item_col).cast("bigint").alias("id"), text_of(item_text).alias("text"))
    item_windows = kept(windows(items, window, None, literal, None), "item-windows")
    wanted = sorted((int(r[0]), int(r[1])) for r in item_windows.select("length", "form").distinct().collect())
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), text_of(text_col).alias("text"))
    seen = windows(texts, window, wanted, literal, window_filter(item_windows))
    named = {"id": "doc_id", "row": "doc_row", "place": "doc_place", "slots": "doc_slots"}
    left = seen.select("length", "form", "hash", "canon", *[F.col(a).alias(b) for a, b in named.items()])
    right = item_windows.select(
        "length", "form", "hash", "canon", F.col("id").alias("item_id"), F.col("row").alias("item_row"), F.col("size").alias("item_words"),
        F.col("place").alias("item_place"), F.col("slots").alias("item_slots"),
    )
    pair = ["doc_id", "doc_row", "item_id", "item_row", "item_words"]
    hits = kept(
        left.join(right, ["hash", "length", "form", "canon"]).select(*pair, "doc_place", "item_place", "length", "doc_slots", "item_slots"),
        "template-hits",
        texts=True,
    )
    row, apart = ["doc_row", "item_row"], ["slack", "number"]
    at_once, disagree = _agreeing(hits, row)
    # Of pairs that hold together as a whole every occurrence does; the others are read again by occurrence.
    again = hits.join(disagree.select(*row).distinct(), row, "left_semi").withColumn("delta", F.col("doc_place") - F.col("item_place"))
    along = Window.partitionBy(*row).orderBy("delta")
    gap = F.coalesce(F.col("delta") - F.lag("delta").over(along), F.lit(0))
    diagonals = again.select(*row, "delta").distinct().withColumn("gap", gap)
    slacks = (0, window // 2, 2 * window)
    numbers = [F.sum((F.col("gap") > slack).cast("int")).over(along).alias(f"n{slack}") for slack in slacks]
    readings = F.explode(F.array(*[F.struct(F.lit(slack).alias("slack"), F.col(f"n{slack}").alias("number")) for slack in slacks]))
    numbered = diagonals.select(*row, "delta", *numbers).select(*row, "delta", readings.alias("r")).select(*row, "delta", "r.*")
    one_by_one, _ = _agreeing(kept(again.join(numbered, [*row, "delta"]), "occurrences"), [*row, *apart])
    places = F.explode(F.sequence(F.col("item_place"), F.col("item_place") + F.col("length") - 1))
    same = F.col("doc_slots") == F.col("item_slots")

    def covered(checked: DataFrame, key: list[str]) -> DataFrame:
        return (
            checked.select(*key, "doc_place", same.alias("same"), places.alias("covered"))
            .groupBy(*key)
            .agg(F.count_distinct("doc_place").alias("n_windows"), F.count_distinct("covered").alias("n_covered"), F.min("same").alias("same_slots"))
            .where(F.col("n_covered") >= F.least(F.lit(cover), F.col("item_words")))
            .drop(*apart)
        )

    found = covered(at_once, pair).unionByName(covered(one_by_one, [*pair, *apart]))
    best = F.max(F.struct("n_covered", "n_windows", "same_slots", "item_words")).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.n_windows", "best.n_covered", "best.item_words", "best.same_slots")
