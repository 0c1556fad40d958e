"""Closed syncmers against a plain version, their likeness, and edited texts over any layout."""

import hashlib
import random
from collections import Counter
from functools import lru_cache

import pytest

from dipstick.llm import queries, syncmers
from llm import plain

FOLDER = "/root/testdata/sf0.001"
MASK = (1 << 64) - 1


def mix(h):
    h = (h ^ h >> 31) * syncmers._MULTIPLIERS[4] & MASK
    return h ^ h >> 29


@lru_cache(maxsize=None)
def plain_anchors(text):
    """(hash, place) of every k-mer whose least inner hash is at an edge, one k-mer at a time."""
    k, s, out = syncmers.K, syncmers.S, []
    if len(text) < k:
        return [(int.from_bytes(hashlib.blake2b(text.encode(), digest_size=4).digest(), "little") >> 5, 0)] if text else []
    levels = [[mix(ord(c) + 1) for c in text]]  # hashes of 1, 2, 4, 8 and 16 code points
    for j in range(4):
        h = levels[-1]
        levels.append([mix(h[i] * syncmers._MULTIPLIERS[j] + h[i + 2**j] & MASK) for i in range(len(h) - 2**j)])
    inner, half = levels[3], levels[4]
    for at in range(len(text) - k + 1):
        last = at + k - s
        if min(inner[at : last + 1]) in (inner[at], inner[last]):
            out.append((mix(half[at] * syncmers._MULTIPLIERS[3] + half[at + k - 16] & MASK) >> 37, at))
    return out


def plain_likeness(a, b):
    if not a or not b:
        return float(len(a) == len(b))

    def numbered(x):
        seen = Counter()
        for h, place in x:
            seen[h] += 1
            yield (h, seen[h]), place

    left, right = dict(numbered(a)), dict(numbered(b))
    votes = Counter(left[m] - right[m] for m in left.keys() & right.keys())
    least = min(2, len(a), len(b))
    return 2 * sum(v for v in votes.values() if v >= least) / (len(a) + len(b))


def plain_compare(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
    out = []
    for at, (doc_id, text, _) in enumerate(order):
        following = order[(at + 1) % len(order)][1]
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        a, b, c = (plain_anchors(t) for t in (text, changed, following))
        out.append((doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), round(plain_likeness(a, b), 9), round(plain_likeness(a, c), 9)))
    return sorted(out, key=str)


def got(df):
    names = ["doc_id", "n_chars", "edited_sha256", "near_edited", "near_next"]
    return sorted(((*r[:3], round(r[3], 9), round(r[4], 9)) for r in df.select(*names).collect()), key=str)


def with_digest(spark, docs):
    return [(r[0], r[1] or "", r[2]) for r in docs.selectExpr("doc_id", "text", "xxhash64(coalesce(text, ''))").collect()]


def short(docs):
    return docs.selectExpr("doc_id", "if(length(text) > 30000, left(text, 3000), text) AS text")


@pytest.mark.parametrize("seed", range(4))
def test_anchors(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice(["ab", "abcdefgh ", "漢字é \n𝄞xyz"][seed % 3]) for _ in range(rng.choice([1, 30, 31, 32, 700])))
    hashes, places = syncmers.anchors(text)
    assert list(zip(hashes.tolist(), places.tolist())) == plain_anchors(text)
    if len(text) >= syncmers.K:  # an anchor in any WINDOW neighbouring k-mers
        assert all(b - a <= syncmers.WINDOW for a, b in zip([-1, *places], [*places, len(text) - syncmers.K + 1]))
    again = syncmers.decoded(syncmers.encoded(hashes, places))
    assert [x.tolist() for x in again] == [hashes.tolist(), places.tolist()]


def test_repeats_stay_linear_and_likeness_holds():
    for text in ("a" * 200_000, "no " * 100_000):
        assert syncmers.likeness(syncmers.anchors(text), syncmers.anchors(text)) == 1
    rng = random.Random(1)
    one, other = ("".join(rng.choice("abcdefghij klm") for _ in range(4000)) for _ in range(2))
    near = lambda a, b: syncmers.likeness(syncmers.anchors(a), syncmers.anchors(b))
    assert near(one, other) == 0 and near("", "") == 1 and near("", one) == 0 and near("x", "x") == 1 and near("x", "y") == 0
    assert 0.45 < near(one, syncmers.edited(one, other)) < 0.55
    assert near(one, other[:500] + one) > 0.9  # moved, not lost


def test_query_against_plain(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert got(queries.QUERIES["op13_document_fingerprints"](spark, FOLDER)) == plain_compare(with_digest(spark, docs))


@pytest.mark.parametrize("parts", [300, 2000, 20_000])
def test_odd_rows_in_parts_of_any_size(spark, monkeypatch, parts):
    docs = short(plain.odd(spark)).repartition(4)
    monkeypatch.setattr(syncmers, "PART_BYTES", parts)
    assert got(syncmers.compare_edited(docs)) == plain_compare(with_digest(spark, docs))


def test_a_third_of_rows_equal(spark, monkeypatch):
    monkeypatch.setattr(syncmers, "PART_BYTES", 5_000)
    text = "one text that very many rows hold, all of them under one number " * 3
    rows = [(5, text)] * 200 + [(None, text)] * 30 + [(i, f"{i} {text[i % 7:]}{i * i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert got(syncmers.compare_edited(docs)) == plain_compare(with_digest(spark, docs))
    sent, n_parts = syncmers._sent(docs.selectExpr("doc_id", "text"))
    sizes = [r[1] for r in sent.groupBy("part").count().collect()]
    assert n_parts > 10 and max(sizes) < 4 * sum(sizes) / n_parts


def test_edges(spark):
    one = spark.createDataFrame([(3, "only this text stands here, and it is long enough for a few anchors")], "doc_id bigint, text string")
    assert got(syncmers.compare_edited(one)) == plain_compare(with_digest(spark, one))
    assert got(syncmers.compare_edited(plain.none(spark))) == []
    prints = syncmers.fingerprints(plain.odd(spark), carry=["text"]).collect()
    assert all(r.fingerprint == syncmers.fingerprint(r.text or "") for r in prints) and len(prints) == len(plain.odd_rows())
