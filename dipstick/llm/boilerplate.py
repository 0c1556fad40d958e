"""Line deduplication by a line's frequency on its own site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dipstick.llm.common import kept, text_of

# Fixed value: what is cut from a line's ends before lines are compared.
EDGES = " \t\r"


def host_of(url: Column) -> Column:
    """The host of a URL, lower case and without ``www.``; NULL where there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.nullif(F.regexp_replace(host, r"^www\.", ""), F.lit(""))


def site_lines(pages: DataFrame, ratio: float, min_pages: int) -> DataFrame:
    """(site, hashes): the lines that over ``ratio`` of a site's pages hold, of ``site`` and ``lines``.

    A page counts once for each of its lines. A site with L lines to a page has at most L / ratio
    such lines, whatever its number of pages, so one array per site holds them.
    """
    per_line = (
        pages.select("site", F.explode(F.array_distinct("lines")).alias("line"))
        .groupBy("site", "line")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") >= min_pages)
    )
    totals = pages.groupBy("site").agg(F.count("*").alias("n_pages"))
    common = per_line.join(totals.withColumnRenamed("site", "of"), F.col("site").eqNullSafe(F.col("of")))
    return common.where(F.col("n") > F.lit(ratio) * F.col("n_pages")).groupBy("site").agg(F.collect_list("line").alias("hashes"))


def drop_site_lines(docs: DataFrame, ratio: float = 0.05, min_pages: int = 5, id_col: str = "doc_id", text_col: str = "text", site: Column | None = None) -> DataFrame:
    """(id, n_lines, n_dropped, text) of every row, without the lines its site repeats.

    A line is compared without blanks at its ends, by a 64-bit hash; blank lines are never dropped. It
    goes from all pages of a site when more than ``ratio`` of the site's pages hold it and at least
    ``min_pages`` do. ``site`` defaults to the source of a document; ``host_of`` gives it for URLs.
    Counts are combined before their shuffle, so a line on all pages of a hot site is one row per
    task, and texts are not shuffled while the table of site lines is small enough for Spark to
    broadcast by its measured size; beyond that the join by site is split where it is skewed.

    NULL texts are empty and have one blank line; a NULL site is a site of its own. Repeated rows count
    as pages of their own; an empty table gives no rows.
    """
    of = F.col("source") if site is None else site
    text = text_of(text_col)
    trimmed = F.transform(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(EDGES)))
    hashed = F.transform(F.filter(trimmed, lambda line: line != ""), lambda line: F.xxhash64(line))
    pages = docs.select(of.cast("string").alias("site"), hashed.alias("lines"))
    common = kept(site_lines(pages, ratio, min_pages).withColumnRenamed("site", "of"), "site-lines")
    rows = docs.select(F.col(id_col).alias("id"), of.cast("string").alias("site"), text.alias("text"))
    joined = rows.join(common, F.col("site").eqNullSafe(F.col("of")), "left").withColumn("lines", F.split("text", "\n"))

    def stays(line: Column) -> Column:
        bare = F.btrim(line, F.lit(EDGES))
        return (bare == "") | F.col("hashes").isNull() | ~F.array_contains(F.coalesce("hashes", F.array().cast("array<bigint>")), F.xxhash64(bare))

    left = joined.withColumn("left", F.filter("lines", stays))
    return left.select(
        F.col("id").alias(id_col),
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size("left")).cast("bigint").alias("n_dropped"),
        F.array_join("left", "\n").alias("text"),
    )
