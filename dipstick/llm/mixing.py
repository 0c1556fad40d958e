"""Mixing sources to target weights by weighted sampling without replacement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dipstick.llm.common import WHITE, kept, text_of

SYMBOLS = "#*$%&|<>"
# A document's quality weight lies between these; the buckets below rely on the lower one.
LOW, HIGH = 0.5, 1.0


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[^{WHITE}]+")).cast("bigint")


def quality_weight(text: Column, words: Column) -> Column:
    """1 for a text without symbols, falling to 0.5 where there is one to every word."""
    symbols = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
    return F.lit(HIGH) - F.lit(HIGH - LOW) * F.least(F.lit(1.0), symbols / F.greatest(words, F.lit(1)))


def uniform(seed: int, key: Column, text: Column) -> Column:
    """A number strictly between 0 and 1 from a digest of the key: the same in every run."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit("")), F.md5(text)))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def targets(sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, n_docs, target) from one row per source.

    Sources take the weights in turn by code point, NULL last. Stopping targets at ``most`` times the
    size and sharing the excess again by weight, until none is above, ends at one common level per
    weight: sources whose limit lies below the level get their limit, the others level times
    weight. In the order of limit over weight that level is found by running sums. All windows run
    over one row per source.
    """
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    rows = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    ratio = F.col("cap") / F.col("weight")
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    summed = rows.withColumn("ratio", ratio).withColumns(
        {
            "caps_before": F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
            "weights_from": F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)),
            "total": F.sum("source_size").over(whole) * F.lit(float(share)),
        }
    )
    level = (F.col("total") - F.col("caps_before")) / F.col("weights_from")
    # Past the first source that can hold the level, later rows only give lower ones.
    common = F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(whole)
    levelled = summed.withColumn("level", level).withColumn("common", common)
    target = F.least(F.col("cap"), F.coalesce(F.col("common"), F.col("ratio")) * F.col("weight"))
    return levelled.select("source", "source_size", "n_docs", target.alias("target"))


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: bool = False) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies), and ``row`` if ``carry``: the whole input row.

    A source whose target is e times its size and a rest takes every document e times (whole epochs)
    and then documents in the order of exponential keys -ln(u) / weight, which draws without
    replacement in proportion to the quality weight, until their running size reaches the rest. The
    document on the border is taken if more than half of it lies inside, so a source misses its
    target by at most half a document, and no document is cut.

    A hot source is no hot task: its documents are dealt into about the square root of their number
    of buckets along the keys, bucket totals are summed up first, and running sums then start inside
    each bucket. A bucket's share of a source is at most HIGH / LOW times the mean.

    NULL texts have size 0 and are taken 0 times; NULL sources are one source; keys come from
    the id and the whole text, so rows that share an id or have none are drawn apart from each other and
    alike in every run; rows of equal id and text take places one after the other; an empty table
    gives no rows.
    """
    text = F.col("text")
    plain = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        text_of(text_col).alias("text"),
        *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []),
    )
    extra = ["row"] if carry else []
    sized = plain.withColumn("size", n_words(text)).select(
        "doc_id",
        "source",
        "size",
        (-F.log(uniform(seed, F.col("doc_id"), text)) / quality_weight(text, F.col("size"))).alias("key"),
        *extra,
    )
    sized = kept(sized, "sized")
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    goal = kept(targets(per_source, weights, share, most).withColumnRenamed("source", "of"), "targets")
    epochs = F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1)))
    place = 1 - F.exp(-F.lit(LOW) * F.col("key"))
    placed = (
        sized.join(goal, F.col("source").eqNullSafe(F.col("of")))
        .withColumn("epochs", epochs)
        .withColumn("bucket", F.floor(place * F.ceil(F.sqrt("n_docs"))))
    )
    same = F.coalesce(F.concat(F.lit("v"), F.col("source")), F.lit("n"))
    placed = placed.withColumn("group", same)
    sums = placed.groupBy("group", "bucket").agg(F.sum("size").alias("bucket_size"))
    earlier = Window.partitionBy("group").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("group", "bucket", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("group", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    running = placed.join(starts, ["group", "bucket"]).withColumn("upto", F.col("before") + F.sum("size").over(inside))
    rest = F.col("target") - F.col("epochs") * F.col("source_size")
    more = (F.col("upto") - F.col("size") / 2 <= rest) & (rest > 0)
    copies = F.when(F.col("size") > 0, F.col("epochs") + F.when(more, 1).otherwise(0)).otherwise(0).cast("bigint")
    return running.select(
        "doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"), *extra
    )
