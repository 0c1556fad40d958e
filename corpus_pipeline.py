"""A training corpus from documents, in five stages that each call one operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from dipstick.llm import decontaminate, mixing, packing, queries, quality, simhash
from dipstick.session import fresh_path
from dipstick.sources.tables import table


def _same(left: DataFrame, right: DataFrame, columns: list[str]):
    condition = F.lit(True)
    for c in columns:
        condition = condition & left[c].eqNullSafe(right[c])
    return condition


def _hashable(docs: DataFrame, column: str):
    """A column as a hash takes it: a map as its entries in order of their text."""
    c = F.col(f"`{column}`")
    return F.sort_array(F.transform(F.map_entries(c), lambda e: F.to_json(e))) if isinstance(docs.schema[column].dataType, MapType) else c


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a digest of all that a row holds, and the digest's name: ids may be NULL or shared."""
    name = "_digest"
    while name in docs.columns:
        name += "_"
    return docs.withColumn(name, F.xxhash64(*[_hashable(docs, c) for c in docs.columns])), name


def quality_rules(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the quality rules keep. Rows are known by id and a digest of all they hold.

    NULL and empty texts have no words and go; equal rows share a verdict; an empty table stays empty.
    """
    keyed, digest = _keyed(docs)
    good = quality.judge(keyed, carry=["doc_id", digest]).where("kept").select("doc_id", digest).distinct()
    return keyed.join(good, _same(keyed, good, ["doc_id", digest]), "left_semi").drop(digest)


def simhash_near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One row of every group: that of the smallest id, NULL last, and among rows of one id that of the smallest digest."""
    keyed, digest = _keyed(docs)
    groups = simhash.near_duplicates(keyed, carry=[digest])
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", digest)).alias("first")
    chosen = groups.groupBy("root").agg(first).select("first.doc_id", f"first.{digest}")
    # Rows equal in all columns share their key; they are merged before their shuffle.
    found = keyed.join(chosen, _same(keyed, chosen, ["doc_id", digest]), "left_semi")
    return found.dropDuplicates(["doc_id", digest]).drop(digest)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that hold no benchmark item. Rows are known by a 64-bit digest alone, so that one without id goes too and no other of its id.

    NULL and empty texts hold nothing and stay, as do all rows where the benchmark is empty.
    """
    keyed, digest = _keyed(docs)
    found = decontaminate.contaminated(keyed, table(spark, folder, "benchmark"), id_col=digest).select("doc_id").distinct()
    return keyed.join(found, keyed[digest] == found["doc_id"], "left_anti").drop(digest)


def source_mix(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents as often as the mix takes them: repeated rows are the epochs. A text without words is taken by no mix."""
    mixed = mixing.mix(docs, carry=True).where("copies > 0")
    return mixed.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_epoch")).select("row.*")


def token_files(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Ids of the mixed corpus in files, and what the files hold for every document."""
    return packing.pack_documents(docs, queries.tokenizer("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_duplicates", simhash_near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mix", source_mix),
    ("token_files", token_files),
]
# Fingerprints, robust estimates and tokenizers are beyond SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written as Parquet and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
