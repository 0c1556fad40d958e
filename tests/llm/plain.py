"""Plain versions of the operators, one text at a time, and rows with every oddity."""

from __future__ import annotations

import hashlib
import html
import math
import re
import zlib
from collections import Counter

import numpy as np
import xxhash

SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, digest string, row string, `group` int, "
    "fp string, n_tokens string, kept string, key string, id string, bucket string, word string, words string, hash string, "
    "target string, of_doc_id string, n_words string, copies string, site string, lines string, host string"
)
EXTRA = len(SCHEMA.split(",")) - 5
LONG = "alpha beta gamma delta " * 30_000


def odd_rows():
    """NULLs in any column, empty and long texts, repeated rows, equal ids, columns of clashing names."""
    text = "The quick brown fox jumps over the lazy dog near the river bank while seven geese watch from the far shore today ok."
    rows = [
        (1, text, "en", "a"), (2, None, "en", "a"), (3, "", "en", "a"), (4, " \t\n ", None, None), (None, text + " Again.", "en", None),
        (None, None, None, None), (7, LONG, "en", "b"), (8, text, "en", "b"), (8, text, "en", "b"), (8, text + " other", "fr", "b"),
        (9, "Released under the MIT License.\nReleased under the MIT License.", "en", "c"), (10, "one", "en", "c"),
        (11, "naïve café — Ünïcödé 漢字 … <|endoftext|> a b  c", "fr", "c"), (12, text.upper(), "en", "d"), (13, text + " 12 km & 3.5 %", "en", "d"),
    ]
    return [(*r, len(r[1] or ""), *["x" if i != 3 else 5 for i in range(EXTRA)]) for r in rows]


def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def none(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def mix(rows, weights=(3, 1, 2), share=1.5, most=2.0):
    """(doc_id, size, source size, target, taken) of rows (doc_id, text, source)."""
    sizes, total = {}, 0
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(words(text))
        total += len(words(text))
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    goal, open_, left = {}, set(names), share * total
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > most * sizes[s]}
        if not full:
            goal |= {s: level * weight[s] for s in open_}
            break
        for s in full:
            goal[s] = most * sizes[s]
            left -= goal[s]
        open_ -= full
    out = []
    for s in names:
        keyed = []
        for doc, text, source in rows:
            if source == s:
                n = len(words(text))
                u = (int(hashlib.md5(f"42:{'' if doc is None else doc}:{hashlib.md5((text or '').encode()).hexdigest()}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
                symbols = sum((text or "").count(c) for c in "#*$%&|<>")
                keyed.append((-math.log(u) / (1 - 0.5 * min(1, symbols / max(n, 1))), -1 if doc is None else doc, n, doc))
        epochs = goal[s] // max(sizes[s], 1)
        rest, upto = goal[s] - epochs * sizes[s], 0
        for _, _, n, doc in sorted(keyed, key=lambda k: k[:3]):
            upto += n
            more = upto - n / 2 <= rest and rest > 0
            out.append((doc, n, sizes[s], goal[s], int(n * (epochs + more))))
    return out


def fingerprint(text):
    w = lower(text).encode().split()
    shingles = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    votes = Counter()
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        votes.update(j for j in range(64) if h >> j & 1)
    return sum(1 << j for j in range(64) if 2 * votes[j] > len(shingles))


def groups(prints, distance=4):
    """The component of each fingerprint, by its first place in the list."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= distance:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def quality_counts(text):
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    marked = {i + k for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for k in range(8)}
    shouted = sum(len(x.encode()) > 1 and x.encode().isupper() for x in w)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(marked), len(lines), shouted)


def base_failed(n):
    return n[0] < 20 or 100 * n[4] > 30 * n[0]


def quality(rows, floors, cut, factor, keep=0.75, steps=3):
    """Verdicts of rows (text, lang, source): limits, then minimum covariance determinant per group."""
    counts = [quality_counts(t) for t, _, _ in rows]
    x = np.array([[math.log1p(n[1] / max(n[0], 1)), *(math.sqrt(a / b) for a, b in ((n[2], max(n[0], 1)), (n[3], max(n[5], 1)), (n[4], max(n[0], 1)), (n[6], max(n[0], 1))))] for n in counts])
    failed = np.array([base_failed(n) for n in counts], bool)
    good, low = ~failed, np.array(floors) ** 2
    for key in {r[1:] for r in rows}:
        at = np.array([i for i, r in enumerate(rows) if r[1:] == key and not failed[i]], int)
        if not len(at):
            continue
        y = x[at]
        rank = lambda q: np.sort(y, axis=0)[max(math.ceil(q * len(y)) - 1, 0)]
        centre, precision = rank(0.5), np.diag(1 / (((rank(0.75) - rank(0.25)) / 1.349) ** 2 + low))
        for _ in range(steps):
            d = np.einsum("ni,ij,nj->n", y - centre, precision, y - centre)
            bins = np.floor(16 * np.log2(d + 1e-6))
            some = y[bins <= np.sort(bins)[math.ceil(keep * len(y)) - 1]]
            centre = some.mean(axis=0)
            precision = np.linalg.inv(factor * (some.T @ some / len(some) - np.outer(centre, centre)) + np.diag(low))
        good[at] = np.einsum("ni,ij,nj->n", y - centre, precision, y - centre) <= cut
    return counts, failed, good


def holds_item(text, items, run=13):
    """Items of which the text holds ``run`` words in a row, or all where they are shorter."""
    flat = lambda t: re.findall(r"[^\W\d_]+|\d+", t.lower())
    whole = f" {' '.join(flat(text or ''))} "
    out = set()
    for item, wording in items:
        w = flat(wording)
        if any(f" {' '.join(w[i : i + run])} " in whole for i in range(max(1, len(w) - run + 1))):
            out.add(item)
    return out


def unigram(rows):
    """{place: (tokens, known, base score)} and the number of training tokens of rows (doc_id, text)."""
    tokens = [lower(t).encode().split() + [b""] for _, t in rows]
    train = Counter(w for (d, _), ts in zip(rows, tokens) if zlib.crc32(("" if d is None else str(d)).encode()) % 10 for w in ts)
    n, v = sum(train.values()), len(train)
    score = lambda ts: sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ts)
    return [(len(ts), sum(train[w] > 0 for w in ts), score(ts)) for ts in tokens], n


def article(page):
    """Text of the article of a page built like the test tables' pages."""
    inner = re.search(r"<article>(.*?)</article>", page or "", re.S)
    parts = re.split(r"</?(?:p|h1)>", inner[1]) if inner else []
    bare = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", p)))).strip() for p in parts]
    return "\n".join(p for p in bare if p)
