"""Operators against plain versions, on the test tables and on rows with every oddity."""

import itertools
import math
import random
import re
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
from dipstick.llm import boilerplate, decontaminate, language_model, licences, main_text, mixing, packing, quality, queries, simhash, token_counts
from dipstick.llm.tokens import PieceEncoder
from helpers import rows_of
from llm import plain

FOLDER = "/root/testdata/sf0.001"
BYTES, WORDS = queries.tokenizer("byte_bpe_50k.json"), queries.tokenizer("word_bpe_49k.json")


@pytest.fixture(scope="module")
def docs(spark):
    """The documents of the test tables with the odd rows."""
    table = spark.read.parquet(f"{FOLDER}/documents.parquet")
    return table.unionByName(plain.odd(spark).withColumn("doc_id", F.col("doc_id") + 100_000), allowMissingColumns=True)


@pytest.fixture(scope="module")
def rows(docs):
    return docs.select("doc_id", "text", "lang", "source").collect()


def same(got, want):
    assert sorted(got, key=str) == sorted(want, key=str)


def test_registered():
    names = entry.queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10 and "pipeline" in names


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    duck = duckdb.connect()
    for path in Path(FOLDER).glob("*.parquet"):
        duck.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    cursor = duck.execute(queries.ORACLES[name])
    names = [d[0] for d in cursor.description]
    df = queries.QUERIES[name](spark, FOLDER)
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.collect(), df.columns, sorted(names)) == rows_of(cursor.fetchall(), names, sorted(names))


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_pieces_give_the_library_ids(path):
    rng = random.Random(3)
    bits = ["a", "B", "don't", "'s", " ", "  ", "\n", "\t", " ", "\x1c", "é", "H̱", "<|endoftext|>", "<|StartOfText|>", "#$", "—,", "'", "12", "3.5", "_", "…",
            "漢字", "　", "Σ", "word,", ".'t", "!''s", " '", "('stop"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 12))) for _ in range(1500)] + [r[1] or "" for r in plain.odd_rows()]
    encoder, library = PieceEncoder(Path(path).read_text(), limit=50), Tokenizer.from_file(path)
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    for start in range(0, len(texts), 500):  # the small memory starts anew on the way
        ids, lengths = encoder.encode(texts[start : start + 500])
        ends = np.cumsum(lengths)
        assert [ids[b - n : b].tolist() for b, n in zip(ends, lengths)] == want[start : start + 500]
        assert encoder.lengths(texts[start : start + 500]).tolist() == [len(w) for w in want[start : start + 500]]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_words_and_tails_are_remembered_apart(path):
    """Work and memory go with different words, not with their pairings with punctuation; columns are taken as they come."""
    words, tails = ["".join(w) for w in itertools.product("abc", "def", "ghi")], ["".join(t) for t in itertools.product(".,;!", repeat=2)]
    texts = ["", *(f"{w}{t}" for w in words for t in tails), "<|endoftext|> \n", " ", "a\tB\n"]
    encoder, library = PieceEncoder(Path(path).read_text()), Tokenizer.from_file(path)
    ids, lengths = encoder.encode(pa.array(["left out", *texts, "left out"]).slice(1, len(texts)))
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert lengths.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    assert len(encoder.ends) < len(words) + len(tails) + 12
    assert [len(part) for part in encoder.encode([])] == [0, 0]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_letters_that_become_letter_and_mark(path):
    """Lower case or normal form may end such a word in a mark, which is one piece with the punctuation behind it."""
    texts = [f"a{c}. {c}!" for c in "\u0130\u0958\u0a33\u0b5c\ufb1d\ufb4e\u1e96\u01f0\u00df\ufb03"]
    encoder, library = PieceEncoder(Path(path).read_text()), Tokenizer.from_file(path)
    ids, _ = encoder.encode(texts)
    assert ids.tolist() == [i for t in texts for i in library.encode(t, add_special_tokens=False).ids]


def test_token_counts_and_their_cache(spark, docs, rows, tmp_path):
    cache, library = str(tmp_path / "cache"), Tokenizer.from_file(BYTES)
    counted = token_counts.count_tokens(docs, BYTES, cache, limit=100)
    n = {t: len(library.encode(t, add_special_tokens=False).ids) for t in {r.text or "" for r in rows}}
    same(
        [tuple(r) for r in counted.collect()],
        [(r.doc_id, len((r.text or "").encode()), n[r.text or ""], n[r.text or ""] > 100) for r in rows],
    )
    stored = spark.read.parquet(cache).count()
    assert stored == len(n)
    token_counts.count_tokens(docs, BYTES, cache).collect()
    assert spark.read.parquet(cache).count() == stored
    token_counts.count_tokens(docs.limit(3), WORDS, cache).collect()
    assert spark.read.parquet(cache).select("tokenizer").distinct().count() == 2


@pytest.mark.parametrize("top", [1, 2, 50, 300, 50_000, 1 << 40, (1 << 64) - 1])
def test_packing_round_trip(top):
    ids = np.random.default_rng(0).integers(0, top, 3000, dtype=np.uint64)
    ids[::7] = 0
    words, escapes = packing.pack(ids)
    assert (packing.unpack(words, escapes, len(ids)) == ids).all()
    assert len(packing.pack(ids[:0])[0]) == 0 and len(words) <= len(ids)


def test_token_files(docs, rows):
    library = Tokenizer.from_file(WORDS)
    got = sorted(packing.pack_documents(docs, WORDS).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in rows), key=lambda d: (d is not None, d))
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1]]
    want = []
    for r in rows:
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 1]
        want.append((r.doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    same([(r.doc_id, r.n_tokens, r.ids_crc32) for r in got], want)


def test_mix(docs, rows):
    got = [tuple(r)[:5] for r in mixing.mix(docs).collect()]
    want = plain.mix([(r.doc_id, r.text, r.source) for r in rows])
    order = lambda r: (str(r[0]), r[1], r[4])
    for a, b in zip(sorted(got, key=order), sorted(want, key=order), strict=True):
        assert a[:3] + a[4:] == b[:3] + b[4:] and a[3] == pytest.approx(b[3])
    assert sorted(got, key=order) == sorted((tuple(r)[:5] for r in mixing.mix(docs.repartition(3)).collect()), key=order)
    by_source: dict = {}
    for r, g in zip(sorted(rows, key=lambda r: str(r.doc_id)), sorted(got, key=lambda g: str(g[0]))):
        assert g[4] <= 2 * g[1]
    for g in got:
        held = by_source.setdefault((g[2], g[3]), [0, 0])
        held[0], held[1] = held[0] + g[4], max(held[1], g[1])
    if len(by_source) == len({r.source for r in rows}):
        assert all(abs(taken - target) <= largest for (_, target), (taken, largest) in by_source.items())


def test_mix_keeps_whole_rows(docs):
    mixed = mixing.mix(docs, carry=True)
    assert mixed.select("row.*").columns == docs.columns and mixed.count() == docs.count()


def test_licence_base(docs, rows):
    got = {(r.doc_id, r.n_words): r for r in licences.scan(docs).collect()}
    for r in rows:
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", plain.lower(r.text))
        found = sorted((i, label) for label, phrase in licences.PHRASES.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split())
        row = got[r.doc_id, len(w)]
        assert (row.n_base, row.first_word, row.last_word) == (len(found), found[0][0] if found else None, found[-1][0] if found else None)
        assert row.base_labels == ",".join(sorted({label for _, label in found})) and set(filter(None, row.base_labels.split(","))) <= set(row.labels.split(","))
        assert 0 <= row.score <= 1 and (row.score == 1) >= bool(found)


def test_licence_diagonals(spark):
    gpl = licences.TEMPLATES["gpl"].split()
    texts = [
        " ".join(gpl),
        " ".join(["before"] * 5 + gpl[:15] + ["new", "words"] + gpl[15:]),  # inserted words: two diagonals, one span
        " ".join(gpl[:12] + gpl[14:]),  # lost words
        " ".join(gpl[:8]),  # too little of it
        " ".join(gpl[:15] + ["far"] * 40 + gpl[15:]),  # halves that do not adjoin
    ]
    rows = licences.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).orderBy("doc_id").collect()
    assert [r.labels for r in rows] == ["gpl", "gpl", "gpl", "", ""]
    assert rows[0].score == 1 and 0.7 <= rows[1].score < 1 and 0 < rows[3].score < 0.7


def test_native_plans(spark, docs):
    for df in (licences.scan(docs), boilerplate.drop_site_lines(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not [w for w in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop") if w in plan]


def test_site_lines(docs, rows):
    pages = [(r.source, (r.text or "").split("\n")) for r in rows]
    bare = lambda line: line.strip(" \t\r")
    want = []
    for r, (site, lines) in zip(rows, pages):
        others = [[bare(x) for x in ls] for s, ls in pages if s == site]
        often = {b for b in map(bare, lines) if b and (n := sum(b in ls for ls in others)) >= 3 and n > 0.2 * len(others)}
        left = [x for x in lines if bare(x) not in often]
        want.append((r.doc_id, len(lines), len(lines) - len(left), "\n".join(left)))
    same([tuple(r) for r in boilerplate.drop_site_lines(docs, ratio=0.2, min_pages=3).collect()], want)


def test_hosts(spark):
    urls = ["http://www.A.com/x", "https://u@b.org:80?q", "c.org/x", None, ""]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert [r[0] for r in df.select(boilerplate.host_of(F.col("url"))).collect()] == ["a.com", "b.org", None, None, None]


def test_unigram_base(docs, rows):
    got = sorted(map(tuple, language_model.score(docs, common=50).collect()), key=lambda r: (str(r[0]), r[2], r[5]))
    found, n = plain.unigram([(r.doc_id, r.text) for r in rows])
    want = sorted(
        ((r.doc_id, zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 10 == 0, f[0], f[1], n, f[2]) for r, f in zip(rows, found)),
        key=lambda r: (str(r[0]), r[2], r[5]),
    )
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [g[5] for g in got] == pytest.approx([w[5] for w in want])
    assert all(g[6] < 0 for g in got)


def test_log_bilinear_is_normalised_and_learns(spark):
    rng = random.Random(5)
    nouns = [f"w{i}" for i in range(30)]
    texts = []
    for _ in range(400):  # each word is followed by the next one of its ring
        at = rng.randrange(30)
        texts.append(" ".join(nouns[(at + k) % 30] for k in range(60)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    rows = language_model.score(df, vocabulary_size=40, dim=16, rounds=8, slices=1).where("held_out").collect()
    assert sum(r.score for r in rows) > 0.8 * sum(r.base_score for r in rows)
    assert all(r.n_own == r.n_tokens for r in rows)


def _any_model(size: int, dim: int = 5):
    model = language_model.LogBilinear(dim, np.arange(float(size)))
    return model.load(np.random.default_rng(1).normal(size=len(model.flat())))


@pytest.mark.parametrize("size", [2, 3, 23, 400])
def test_log_bilinear_is_normalised_over_all_words(size):
    words = np.arange(size)
    for a, b in ((0, 1), (size - 1, 0)):
        found = _any_model(size).log_probs(np.full(size, a), np.full(size, b), words, block=7)
        assert np.exp(found).sum() == pytest.approx(1, abs=1e-5)


def test_log_probabilities_against_plain_sums():
    model, rng = _any_model(40), np.random.default_rng(3)
    one, two, word = rng.integers(0, 40, (3, 200))
    p = {k: v.astype(float) for k, v in model.parts.items()}
    want = []
    for a, b, w in zip(one, two, word):
        q = np.append(p["first"][a] + p["second"][b], 1)
        classes = [0 if x == 0 else 1 + (x - 1) // model.width for x in range(40)]
        e = [math.exp(q @ p["out"][40 + c]) for c in range(max(classes) + 1)]
        own = classes[w]
        inside = sum(math.exp(q @ p["out"][x]) for x in range(40) if classes[x] == own)
        want.append(math.log(e[own] / sum(e)) + q @ p["out"][w] - math.log(inside))
    assert model.log_probs(one, two, word, block=64) == pytest.approx(want, abs=1e-4)


def test_scores_do_not_depend_on_the_partitioning(spark, docs):
    def scored(df):
        rows = language_model.score(df, share=100, shard_tokens=500).select("doc_id", "n_tokens", "base_score", "score").collect()
        return sorted(map(tuple, rows), key=lambda r: (str(r[0]), *r[1:3]))

    few, many = scored(docs.coalesce(1)), scored(docs.repartition(7))
    assert [r[:2] for r in few] == [r[:2] for r in many]
    assert [r[3] for r in few] == pytest.approx([r[3] for r in many], rel=1e-6)


def test_copies_are_dealt_over_shards(spark):
    """One text is most of the corpus; its tokens weigh as much as its rows would, in every shard."""
    texts = [(2 * i + 1, "a b c d" if i % 4 else f"e f g{i % 8}") for i in range(400)]
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    rows = language_model.score(df, share=100, shard_tokens=100, rounds=4).collect()
    assert len(rows) == 400
    by_text = {}
    for r in rows:
        by_text.setdefault(texts[(r.doc_id - 1) // 2][1], set()).add((round(r.score, 9), round(r.base_score, 9)))
    assert all(len(v) == 1 for v in by_text.values())
    [(own, base)] = by_text["a b c d"]
    assert own > 0.6 * base


def test_vocabulary_grows_with_the_corpus(spark):
    def own_words(n):
        rng = random.Random(2)
        draws = [int(rng.paretovariate(1)) for _ in range(n)]
        rows = [(i, " ".join(f"w{w}" for w in draws[50 * i : 50 * i + 50])) for i in range(n // 50)]
        df = spark.createDataFrame(rows, "doc_id bigint, text string")
        got = language_model.score(df, share=2).agg(F.sum("n_own"), F.sum("n_tokens")).first()
        return got[0] / got[1]

    small, large = own_words(2000), own_words(40000)
    assert 0.5 < small < large


def test_common_words_do_not_change_scores(docs):
    few, all_ = (sorted(language_model.score(docs, vocabulary_size=4, rounds=1, common=c).select("n_tokens", F.round("score", 6), F.round("base_score", 6)).collect()) for c in (200, 1 << 20))
    assert few == all_


def _factor():
    inner, p = quality.chi2_cut(len(quality.FLOORS), 0.25), len(quality.FLOORS)
    terms = sum((inner / 2) ** (k + 0.5) / math.gamma(k + 1.5) for k in range((p + 2) // 2))
    return 0.75 / (1 - math.erfc(math.sqrt(inner / 2)) - math.exp(-inner / 2) * terms)


def test_quality(docs, rows):
    counts, failed, good = plain.quality([(r.text, r.lang, r.source) for r in rows], list(quality.FLOORS.values()), quality.chi2_cut(5, 1e-6), _factor())
    got = quality.judge(docs).drop("distance").collect()
    same([tuple(r) for r in got], [(r.doc_id, *n, bool(f), bool(g)) for r, n, f, g in zip(rows, counts, failed, good)])


def test_chi_square():
    assert quality.chi2_cut(4, 0.05) == pytest.approx(9.487729, abs=1e-5)
    assert quality.chi2_cut(5, 0.05) == pytest.approx(11.070498, abs=1e-5)


def test_outliers_go_and_clean_texts_stay(spark):
    rng = random.Random(2)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(400)]
    clean = [" ".join(rng.choices(vocabulary, k=rng.randint(25, 400))) for _ in range(120)]
    junk = [" ".join(w + "###" for w in rng.choices(vocabulary, k=60)) for _ in range(15)] + [" ".join(w.upper() for w in rng.choices(vocabulary, k=60)) for _ in range(15)]
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(clean + junk)], "doc_id bigint, text string, lang string, source string")
    assert {r.doc_id for r in quality.judge(df).where("kept").collect()} == set(range(len(clean)))


def test_each_statistic_rejects_alone(spark):
    rng = random.Random(6)
    word = lambda n=5: "".join(rng.choices("abcdefghij", k=n))
    clean = [" ".join(word(rng.randint(4, 6)) for _ in range(rng.randint(60, 300))) for _ in range(80)]
    run = [word() for _ in range(14)]
    odd = {
        "length": " ".join(word(40) for _ in range(100)),
        "symbols": " ".join(word(4) + "#" for _ in range(100)),
        "lines": "\n".join("\n".join(["menus"] * 7 + [word()]) for _ in range(20)),  # every eight words hold a new one
        "repeats": " ".join([*run, *(word() for _ in range(72)), *run]),
        "shouting": " ".join(word().upper() for _ in range(100)),
    }
    table = [(str(i), t, "en", "s") for i, t in enumerate(clean)] + [(name, t, "en", "s") for name, t in odd.items()]
    df = spark.createDataFrame(table, "doc_id string, text string, lang string, source string")
    judged = {r.doc_id: r for r in quality.judge(df).collect()}
    assert not any(r.base_failed for r in judged.values()) and {i for i, r in judged.items() if not r.kept} == set(odd)


def test_contaminated(spark, docs, rows):
    bench = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()]
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {(r.doc_id, i) for r in rows for i in plain.holds_item(r.text, items)}


def test_templates_and_slots(spark):
    item = "a train leaves the old station at 40 km per hour and Anna waits for 3 hours while Anna reads about 40 birds"
    short = "sing the song of seven hills"
    bench = spark.createDataFrame([(1, item), (2, short), (3, None), (3, "")], "item_id bigint, text string")
    other = item.replace("40", "75").replace("Anna", "Berta").replace("3", "9")
    texts = [
        "so " + item.upper() + " end", other, other.replace("75 birds", "76 birds").replace("Berta reads", "Clara reads"), "we Sing the song, of seven hills!",
        "sing the song of six hills", "a train leaves the old station at noon and nobody waits", None, "", "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15",
    ]
    found = decontaminate.contaminated(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), bench).collect()
    by_doc = {(r.doc_id, r.item_id): r for r in found}
    # Document 2 changes one value two ways: only windows without the changed slots count, too few.
    assert set(by_doc) == {(0, 1), (1, 1), (3, 2)}
    assert by_doc[0, 1].same_slots and not by_doc[1, 1].same_slots and by_doc[3, 2].n_covered == 6


def test_items_of_numbers(spark):
    bench = spark.createDataFrame([(1, "Compute 17 * 23 + 4 * 9 - 6"), (2, " ".join(str(n * n) for n in range(20)))], "item_id bigint, text string")
    texts = [
        "please compute 17 * 23 + 4 * 9 - 6 now", "compute 17 * 23 + 4 * 9 - 7", "so " + " ".join(str(n * n) for n in range(14)),
        " ".join(str(n * n) for n in range(12)), " ".join(str(n * n + 1) for n in range(20)),
    ]
    found = decontaminate.contaminated(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), bench).collect()
    assert {(r.doc_id, r.item_id, r.n_covered, r.same_slots) for r in found} == {(0, 1, 6, True), (2, 2, 14, True)}


def test_slots_are_checked_by_occurrence(spark):
    item = "a farmer buys 3 brown hens for 7 coins and then sells 9 eggs for 4 coins on every market day"
    other, third = (item.translate(str.maketrans("3794", digits)) for digits in ("5286", "8123"))
    drill = "add 3 red balls to 5 blue balls then add 4 red balls to 9 blue balls then add 6 red balls to 2 blue balls then stop"
    redrill = drill.translate(str.maketrans("354962", "781352"))
    bench = spark.createDataFrame([(1, item), (2, drill)], "item_id bigint, text string")
    split = third.replace("coins and", "coins and also")
    texts = [
        f"{item} some words between {other}", f"{other} some words between {third}", drill, redrill, f"{other} some words between {split}",
        item.replace("brown hens for 7", "brown hens for 3").replace("eggs for 4", "eggs for 7").replace("9 eggs", "3 eggs"),
    ]
    found = decontaminate.contaminated(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), bench).collect()
    assert {(r.doc_id, r.item_id, r.same_slots) for r in found} == {(0, 1, True), (1, 1, False), (2, 2, True), (3, 2, False), (4, 1, False)}


def test_links_and_groups(spark):
    rng = np.random.default_rng(4)
    prints = []
    for _ in range(60):
        at = int(rng.integers(0, 1 << 63)) * 2 + int(rng.integers(0, 2))
        prints += [at ^ sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, 7)), replace=False)) for _ in range(6)]
    prints += [0, (1 << 64) - 1, 1 << 63]
    df = spark.createDataFrame([(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(prints)], "doc_id bigint, fp bigint")
    for r in (0, 1, 2, 3, 4):
        got = {(a % (1 << 64), b % (1 << 64)) for a, b, *_ in simhash.near_pairs(df.select("fp", F.col("fp").alias("root")), r).collect()}
        want = {(a, b) for a in prints for b in prints if a != b and bin(a ^ b).count("1") <= r}
        assert {frozenset(p) for p in got} == {frozenset(p) for p in want}
    for r in (2, 4):
        roots = {f % (1 << 64): root for f, root in simhash.connected(df, r).collect()}
        groups = plain.groups(prints, r)
        assert len(roots) == len(set(prints))
        assert len({(roots[p], g) for p, g in zip(prints, groups)}) == len(set(groups)) == len(set(roots.values()))
    chain = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (200, 100)]
    edges = spark.createDataFrame([(min(e), max(e)) for e in chain], "a bigint, b bigint")
    found = {r.node: r.root for r in simhash.components(edges).collect()}
    assert found == {i: 0 for i in range(41)} | {100: 90, 90: 90, 95: 90, 200: 90}


def test_stars_alone_do_not_join_a_path(spark):
    """Fingerprints in a row, each linked to its neighbours only, and numbered out of order."""
    steps, path = 0, []
    for i in range(12):
        path.append(steps)
        steps ^= 0b1111 << 4 * (5 * i % 12)
    df = spark.createDataFrame([(i, p) for i, p in enumerate(path)], "doc_id bigint, fp bigint")
    alone = df.select("fp", F.col("fp").alias("root"))
    assert simhash.near_pairs(alone, 4).select("a", "b").distinct().count() >= len(path) - 1
    assert len({r.root for r in simhash.connected(df, 4).collect()}) == len(set(plain.groups(path)))


def test_near_duplicates(docs, rows):
    prints = [plain.fingerprint(r.text) for r in rows]
    roots = plain.groups(prints)
    least = {g: min((r.doc_id for r, x in zip(rows, roots) if x == g and r.doc_id is not None), default=None) for g in set(roots)}
    same([tuple(r) for r in simhash.near_duplicates(docs).collect()], [(r.doc_id, f"{p:016x}", least[g]) for r, p, g in zip(rows, prints, roots)])


def test_main_text_of_the_pages(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    got = main_text.extract(pages).collect()
    want = {r.page_id: plain.article(r.html) for r in pages.collect()}
    assert {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)


def test_wrapper(spark):
    def page(i, host="http://h.org"):
        body = f"<h1>Title {i}</h1><div>Read our magazine every week</div><p>Body &amp; text\n number {i} <b>bold</b> here.<p>Second of {i}"
        return (
            f"{host}/{i}",
            f"<html><head><title>T</title><script>var a='</p><p>no';</script><style>p{{}}</style></head><body class='has-sidebar'><header>Site</header>"
            f"<nav><ul><li>Home<li>More</ul></nav><div class='cookieNotice'>We use cookies {i}</div><div id=content><!-- <p>no</p> -->{body}</div>"
            f"<div>About us and terms</div><aside>side {i}</aside><form>Mail <input></form><div class='comments'><p>nice {i}</div><footer>foot {i}</footer></body></html>",
        )

    rows = [page(i) for i in range(8)] + [("http://h.org/copy", page(3)[1])]
    rows += [page(50 + i, "http://two.org") for i in range(2)]  # too few pages for a wrapper
    rows += [("http://copies.org/x", page(99)[1])] * 7  # copies of one page are no template
    rows += [("http://h.org/n", None), (None, "<p>loose &lt;b&gt; text"), ("http://h.org/e", ""), ("no host", "plain\n words"), ("http://h.org/deep", "<div>" * 3000 + "deep")]
    df = spark.createDataFrame([(i, u, h, "x", 1) for i, (u, h) in enumerate(rows)], "page_id bigint, url string, html string, host string, seed int")
    text = {r.page_id: r.text for r in main_text.extract(df).collect()}
    assert text[4] == "Title 4\nBody & text number 4 bold here.\nSecond of 4"
    assert text[8] == text[3]
    assert text[9] == "Title 50\nRead our magazine every week\nBody & text number 50 bold here.\nSecond of 50\nAbout us and terms"
    assert len({text[i] for i in range(11, 18)}) == 1 and "Body & text number 99" in text[11]
    assert [text[i] for i in range(18, 23)] == ["", "loose <b> text", "", "plain words", "deep"]


def _site(host, layout, ids):
    """Pages without article elements: menu and notice differ by layout, the text by page."""
    shells = {
        "a": "<body><div class='top'>Home Shop Help</div><div class='text'><p>{}</p></div><div class='end'>All rights of shop A</div></body>",
        "b": "<body><table class='grid'><tr><td>Left links and more</td><td><p>{}</p></td></tr></table><div class='last'>Sent to you by B</div></body>",
        "error": "<body><div class='oops'>Not here</div></body>",
    }
    return [(i, f"http://{host}/{i}", shells[layout].format(f"Story number {i} of its own kind, word{i * 7} and word{i * 11}.")) for i in ids]


def test_odd_first_page_and_two_layouts(spark):
    pages = _site("one.org", "error", [1]) + _site("one.org", "a", range(2, 12))
    pages += _site("two.org", "a", range(100, 112)) + _site("two.org", "b", range(112, 120))
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    text = {r.page_id: r.text for r in main_text.extract(df).collect()}
    for i in [*range(2, 12), *range(100, 120)]:
        assert text[i] == f"Story number {i} of its own kind, word{i * 7} and word{i * 11}.", (i, text[i])
    assert text[1] == "Not here"


def test_short_articles_lose_their_template(spark):
    menu = "".join(f"<div>Section {k} of our large site with a long name</div>" for k in range(9))
    short = [f"<html><body>{menu}<p>Short {i}</p></body></html>" for i in range(9)] + [f"<html><body>{menu}<p></p></body></html>"]
    notes = [f"<div class=n{k}>Note {k}</div>" for k in range(6)]
    full = "".join(notes)
    same = [f"<html><body>{full}<p>One text</p></body></html>", *(f"<html><body>{full.replace(x, '')}<p>One text</p></body></html>" for x in notes)]
    rows = [("http://short.org/", h) for h in short] + [("http://same.org/", h) for h in same]
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], "page_id bigint, url string, html string")
    got = {r.page_id: (r.text, r.n_chars) for r in main_text.extract(df).collect()}
    assert [got[i] for i in range(10)] == [(f"Short {i}", 7) for i in range(9)] + [("", 0)]
    # Pages that differ by a missing part of their template only are copies of one text, which stays.
    assert all(got[i][0].endswith("One text") and "Note" in got[i][0] for i in range(10, 17))


def test_tree_matching_by_the_plain_table():
    rng = random.Random(5)

    def tree(depth):
        inner = "".join(tree(depth - 1) for _ in range(rng.randrange(5))) if depth else "x"
        return f"<{(tag := rng.choice(['div', 'section', 'p']))} class={rng.choice('ab')}>{inner}</{tag}>"

    def weigh(x, y):
        if (x.tag, x.sign) != (y.tag, y.sign):
            return 0
        table = [[0] * (len(y.children) + 1) for _ in range(len(x.children) + 1)]
        for i, c in enumerate(x.children):
            for j, d in enumerate(y.children):
                table[i + 1][j + 1] = max(table[i][j + 1], table[i + 1][j], table[i][j] + weigh(c, d))
        return 1 + table[-1][-1]

    for _ in range(150):
        a, b = (main_text.parse("".join(tree(3) for _ in range(4))) for _ in range(2))
        for limit in (1, 8, 1 << 20):  # from halving all rows to the whole table
            pairs = main_text.match(a, b, limit)
            assert len(pairs) == weigh(a, b)
            assert len({id(x) for x, _ in pairs}) == len({id(y) for _, y in pairs}) == len(pairs)
            assert all((x.tag, x.sign) == (y.tag, y.sign) for x, y in pairs)


def test_long_pages_are_matched_whole():
    a, b = (main_text.parse("".join(f"<{t}>{i}</{t}>" for i in range(6000) for t in [("p", "div", "section")[i * k % 7 % 3]])) for k in (1, 3))
    assert len(main_text.match(a, b)) > 3000


def test_empty_tables(spark):
    docs = plain.none(spark)
    bench = spark.createDataFrame([], "item_id bigint, text string")
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert token_counts.count_tokens(docs, BYTES, queries.fresh_path(spark, "none")).count() == 0
    for df in (
        packing.pack_documents(docs, WORDS), mixing.mix(docs), licences.scan(docs), boilerplate.drop_site_lines(docs), language_model.score(docs),
        quality.judge(docs), simhash.near_duplicates(docs), decontaminate.contaminated(plain.odd(spark), bench), decontaminate.contaminated(docs, bench),
        main_text.extract(pages),
    ):
        assert df.count() == 0


def test_names_inside_the_article_mark_only_as_a_whole(spark):
    kept = '<div class="side-effects">Known effects.</div><p class="share-price">The price rose.</p><section id="related-work">Others did this.</section>'
    page = f'<div class="side-bar">Menu</div><article><p>Intro</p>{kept}<div class="related">More to read</div></article>'
    df = spark.createDataFrame([(1, "http://a.example/x", page)], "page_id bigint, url string, html string")
    assert main_text.extract(df).first().text == "Intro\nKnown effects.\nThe price rose.\nOthers did this."


def test_mix_of_rows_without_an_id_does_not_depend_on_the_layout(spark):
    rows = [(None if i % 3 else i, f"word{i} " * (1 + i % 5), "s") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    one, other = (sorted((r.row.text, r.copies) for r in mixing.mix(d, carry=True).collect()) for d in (docs, docs.repartition(7, "text")))
    assert one == other and len({c for _, c in one}) > 1


def test_licence_scan_of_a_very_long_text(spark):
    """Four times the words take about four times as long, not sixteen."""
    import time

    def seconds(words):
        docs = spark.range(1).selectExpr("id AS doc_id", f"concat(repeat('word and other ', {words // 3}), 'under the mit license') AS text")
        start = time.perf_counter()
        row = licences.scan(docs).first()
        assert (row.n_base, row.first_word, row.base_labels) == (1, words // 3 * 3, "mit")
        return time.perf_counter() - start

    seconds(3000)
    short, long = seconds(100_000), seconds(400_000)
    assert long < 5 * short + 5
