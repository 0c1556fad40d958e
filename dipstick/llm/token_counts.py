"""Token counts through a cache keyed by content and tokenizer digests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dipstick.llm.common import by_value, kept, pieces, text_of, worker_memo
from dipstick.llm.tokens import PieceEncoder

by_value(__name__)

CACHE = "tokenizer string, digest binary, n_tokens bigint"


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer's file and of the library that reads it."""
    if path.endswith(".model"):
        import sentencepiece as library
    else:
        import tokenizers as library
    return hashlib.sha256(Path(path).read_bytes() + library.__version__.encode()).hexdigest()


def _counter(path: str):
    """A function for ``mapInArrow`` from (digest, text) to (digest, n_tokens)."""
    data, version = Path(path).read_bytes(), tokenizer_version(path)

    def make():
        if not path.endswith(".model"):
            return PieceEncoder(data.decode()).lengths
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=data)
        return lambda texts: [len(ids) for ids in model.encode(list(texts), num_threads=1)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = worker_memo(("lengths", version), make)
        for batch in pieces(batches):
            n = pa.array(lengths(batch.column(1).to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n], ["digest", "n_tokens"])

    return count


def count_tokens(docs: DataFrame, tokenizer_path: str, cache: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row; counts of new contents are appended to ``cache``.

    A text is known by the digest of its normalised content (NULL becomes the empty text, which has
    no tokens). Copies are merged before the shuffle, contents that the cache holds for this
    tokenizer are left out, and the rest is encoded, each content once. The counts then come from
    the cache for all rows alike, joined by digest; a hot digest is split by the adaptive join.
    ``cache`` is a folder that may serve many runs and tokenizers; two runs at once may add a
    content twice, so it is read by distinct digest. Repeated rows and ids are answered row by row,
    an empty table gives no rows, other columns are not looked at.
    """
    spark = docs.sparkSession
    version = tokenizer_version(tokenizer_path)
    text = text_of(text_col)
    content = docs.select(F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"))
    spark.createDataFrame([], CACHE).write.mode("ignore").parquet(cache)

    def stored() -> DataFrame:
        rows = spark.read.schema(CACHE).parquet(cache).where(F.col("tokenizer") == version)
        return rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    misses = content.dropDuplicates(["digest"]).join(stored(), "digest", "left_anti")
    counted = misses.mapInArrow(_counter(tokenizer_path), "digest binary, n_tokens bigint")
    counted.select(F.lit(version).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache)
    rows = docs.select(
        F.col(id_col), F.unhex(F.sha2(text, 256)).alias("digest"), F.octet_length(text).cast("bigint").alias("n_bytes")
    )
    # Written, so that the join reads plain rows and a hot digest is split there.
    counts = kept(stored(), "counts")
    return rows.join(counts, "digest").select(id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
