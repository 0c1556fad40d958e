"""The pipeline against plain versions of its stages, and its stages on odd rows."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from dipstick.llm import common, decontaminate, packing, quality, queries, simhash
from llm import plain
from llm.test_operators import _factor

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def plain_run(rows, items):
    """Rows (doc_id, text, lang, source, n_chars) through all stages; ids are distinct and known."""
    *_, good = plain.quality([r[1:4] for r in rows], list(quality.FLOORS.values()), quality.chi2_cut(5, 1e-6), _factor())
    rows = [r for r, g in zip(rows, good) if g]
    roots = plain.groups([plain.fingerprint(r[1]) for r in rows])
    first = {g: min(r[0] for r, x in zip(rows, roots) if x == g) for g in set(roots)}
    rows = [r for r in rows if r[0] in first.values()]
    rows = [r for r in rows if not plain.holds_item(r[1], items)]
    copies = {doc: taken // size for doc, size, _, _, taken in plain.mix([(r[0], r[1], r[3]) for r in rows]) if size}
    library, out, start = Tokenizer.from_file(queries.tokenizer("word_bpe_49k.json")), [], 0
    for r in sorted(rows):
        for _ in range(copies.get(r[0], 0)):
            ids = [*library.encode(r[1], add_special_tokens=False).ids, 1]
            out.append((r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
    return out


def test_run(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select(*COLUMNS).collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, FOLDER).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert got == plain_run(rows, items)


def test_stages_keep_columns_and_take_odd_rows(spark, tmp_path):
    words = "The quick brown fox jumps over a lazy dog and then some other animals come along to see what is going on here today"
    odd = plain.odd(spark).select(*COLUMNS, "row", "copies", "size", "key")
    more = spark.createDataFrame([(500 + i, f"{words} {i} {'xyz' * i}", "en", "z", 1) for i in range(5)], ", ".join(f"{c} {t}" for c, t in odd.dtypes[:5]))
    docs = odd.unionByName(more, allowMissingColumns=True)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, FOLDER).write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.dtypes == docs.dtypes
            before, after = (Counter(r[0] for r in d.select(F.xxhash64(*COLUMNS)).collect()) for d in (docs, out))
            assert set(after) <= set(before) and (name == "source_mix" or all(after[k] <= before[k] for k in after))
        docs = out
    assert docs.count() > 0
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, plain.none(spark), FOLDER).count() == 0


def test_one_of_each_group_stays(spark):
    rows = [(i, f"same words in all of these texts number {i % 3} {'a b c d e ' * (3 * (i % 3))}", "en", "s", 1) for i in (9, 3, 6, 4, 1, 2, 2)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    prints = {r[0]: plain.fingerprint(r[1]) for r in rows}
    ids = sorted(prints)
    roots = plain.groups([prints[i] for i in ids])
    kept = corpus_pipeline.simhash_near_duplicates(spark, docs, FOLDER).collect()
    assert sorted(r.doc_id for r in kept) == sorted({ids[g] for g in roots}) and not math.isnan(len(kept))


def test_rows_without_an_id_of_their_own_stay(spark):
    tops = ["river", "copper", "violin", "orchard", "glacier", "harbour"]
    texts = [" ".join(f"{top}{(i * i + k) % 97}" for i in range(60)) for k, top in enumerate(tops)]
    assert len(set(plain.groups([plain.fingerprint(t) for t in texts]))) == len(texts)
    ids = [None, None, 7, 7, 7, 8]
    rows = [(i, t, "en", "s", 1) for i, t in zip(ids, texts)]
    rows += [(None, texts[5], "en", "s", 2), (None, texts[0], "en", "s", 1), (9, texts[1], "en", "s", 1)]  # copies
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    left = [(r.doc_id, r.text) for r in corpus_pipeline.simhash_near_duplicates(spark, docs, FOLDER).collect()]
    assert sorted(left, key=str) == sorted([(i, t) for i, t in zip([None, 9, 7, 7, 7, 8], texts)], key=str)


def test_contaminated_rows_go_by_row(spark):
    item = spark.read.parquet(f"{FOLDER}/benchmark.parquet").where(F.length("text") > 80).first().text
    rows = [(None, f"so {item} end"), (None, "a clean text"), (5, item), (5, "another clean text")]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    left = corpus_pipeline.benchmark_decontamination(spark, docs, FOLDER).collect()
    assert sorted(r.text for r in left) == ["a clean text", "another clean text"]


def test_columns_named_like_the_digest_and_maps_stay(spark):
    words = "the quick brown fox jumps over a lazy dog and then some other animals come along to see what is going on here today"
    rows = [(i, f"{words} {i} {'abc ' * i}", "en", "s", 1, f"mine {i}", {"b": i, "a": 1}) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, _digest string, about map<string,int>")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        found = out.collect()
        assert out.columns == docs.columns and found and all(r._digest == f"mine {r.doc_id}" and r.about == {"b": r.doc_id, "a": 1} for r in found)


def test_whole_texts_go_to_python_in_small_batches(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes]), pa.array([batch.num_rows])], ["bytes", "n"])

    key, texts = "spark.sql.execution.arrow.maxBytesPerBatch", spark.range(0, 6000, 1, 1).select(F.repeat(F.lit("word "), 600).alias("text"))
    sent = texts.mapInArrow(sizes, "bytes bigint, n bigint")
    seen = common.kept(sent, "batches", texts=True).collect()
    assert sum(r["n"] for r in seen) == 6000 and max(r["bytes"] for r in seen) < 1.1 * common.TEXT_BATCH
    assert spark.conf.get(key, None) is None
    spark.conf.set(key, str(1 << 20))  # a session's own size stands
    try:
        assert max(r["bytes"] for r in common.kept(sent, "batches", texts=True).collect()) < 1.1 * (1 << 20)
        assert spark.conf.get(key) == str(1 << 20)
    finally:
        spark.conf.unset(key)
    with pytest.raises(Exception, match="division|DIVIDE"):  # nor does a failure leave the setting behind
        common.kept(texts.select(F.raise_error(F.lit("division"))), "batches", texts=True)
    assert spark.conf.get(key, None) is None


@pytest.mark.parametrize("module", [quality, simhash, decontaminate, packing])
def test_stages_with_texts_ask_for_small_batches(spark, module, monkeypatch):
    asked, plain_kept = [], module.kept
    monkeypatch.setattr(module, "kept", lambda df, name, texts=False: (asked.append((name, texts)), plain_kept(df, name, texts))[1])
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(30)
    stage = {quality: "quality_rules", simhash: "simhash_near_duplicates", decontaminate: "benchmark_decontamination", packing: "token_files"}[module]
    dict(corpus_pipeline.STAGES)[stage](spark, docs, FOLDER).count()
    assert [name for name, texts in asked if texts] == [{quality: "text-counts", simhash: "fingerprints", decontaminate: "template-hits", packing: "shards"}[module]]


def test_a_worker_remembers_one_operator(monkeypatch):
    monkeypatch.delitem(common.sys.modules, "_dipstick_worker", raising=False)
    first = common.worker_memo("canonical", list)
    assert common.worker_memo("canonical", list) is first
    both = [common.worker_memo(("encoder", i), list) for i in range(2)]
    assert [common.worker_memo(("encoder", i), list) for i in range(2)] == both and all(common.worker_memo(("encoder", i), list) is both[i] for i in range(2))
    assert common.worker_memo("canonical", list) is not first


def test_canonical_words_are_forgotten_in_time():
    canon = decontaminate.Canonical()
    words = ["".join(chr(97 + i // 26**k % 26) for k in range(4)) for i in range(400_000)]
    for at in range(0, len(words), 50_000):
        canon([" ".join(words[at : at + 50_000])])
    assert len(canon.known) <= (1 << 18) + 50_000
    again, fresh = canon([" ".join(words[:9])]), decontaminate.Canonical()([" ".join(words[:9])])
    assert all((a == b).all() for a, b in zip(again, fresh))
