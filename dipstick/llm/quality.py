"""Quality rules: fixed limits on a text's own counts, then robust multivariate outliers."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dipstick.llm.common import by_value, kept, pieces, text_of

by_value(__name__)

# Fixed values of the contract.
SYMBOLS = "#*$%&|<>"
BLANK = " \t\n\x0b\x0c\r"
WINDOW = 8
MIN_WORDS = 20
REPEAT_PERCENT = 30
# The transformed statistics and the spread that each is granted even where a group has none. The cut lies at
# six floors, so those of x_lines (at most 1) and x_repeats (at most the root of 0.3) are under a sixth of that.
FLOORS = {"x_length": 0.25, "x_symbols": 0.1, "x_lines": 0.15, "x_repeats": 0.08, "x_shouting": 0.1}
COUNTS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_lines bigint, n_shouted bigint"


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside a run of ``window`` words that the text has twice or more, the first one included.

    Runs are named by rank, doubling their length: equal names are equal runs, without hashing.
    """
    n = len(words)
    if n <= window:
        return 0
    code: dict[bytes, int] = {}
    names = np.fromiter((code.setdefault(w, len(code)) for w in words), np.int64, n)
    if len(code) == n:
        return 0
    length = 1
    while length < window:
        pairs = names[:-length] * np.int64(n + 1) + names[length:]
        names = np.unique(pairs, return_inverse=True)[1]
        length *= 2
    often = np.bincount(names)[names] > 1
    marks = np.zeros(n + 1, np.int64)
    marks[: len(often)] += often
    marks[window:] -= often[: n + 1 - window]
    return int((np.cumsum(marks[:n]) > 0).sum())


def text_counts(text: str) -> tuple[int, ...]:
    """The counts named in ``COUNTS``."""
    words = text.encode().split()
    lines = [line for line in text.split("\n") if line.strip(BLANK)]
    return (
        len(words),
        len(text) - sum(text.count(c) for c in BLANK),
        sum(text.count(c) for c in SYMBOLS),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        sum(len(w) > 1 and w.isupper() for w in words),
    )


def measure(docs: DataFrame, carry: Sequence[str], text_col: str = "text") -> DataFrame:
    """The columns ``carry`` of ``docs`` and the counts of each whole text (NULL: empty)."""
    names = [c.split()[0] for c in COUNTS.split(", ")]
    others = [f"of_{c}" for c in carry]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            table = np.array([text_counts(t) for t in batch.column(0).to_pylist()], np.int64).reshape(-1, len(names))
            columns = [batch.column(i + 1) for i in range(len(others))]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(table[:, i]) for i in range(len(names))], others + names)

    plain = docs.select(text_of(text_col).alias("text"), *[F.col(f"`{c}`").alias(f"of_{c}") for c in carry])
    schema = ", ".join([f"`{c}` {kind}" for c, kind in plain.dtypes[1:]] + [COUNTS])
    return plain.mapInArrow(count, schema)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def chi2_cut(p: int, tail: float) -> float:
    """Quantile of the chi-square distribution, from its survival function by bisection."""

    def survival(x: float) -> float:
        if p % 2 == 0:
            return math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(p // 2))
        terms = sum((x / 2) ** (k + 0.5) / math.gamma(k + 1.5) for k in range(p // 2))
        return math.erfc(math.sqrt(x / 2)) + math.exp(-x / 2) * terms

    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if survival(mid) > tail else (low, mid)
    return high


def _distance(names: list[str]) -> Column:
    """Squared Mahalanobis distance from the columns ``centre`` and ``precision`` (row by row)."""
    p = len(names)
    off = [F.col(c) - F.col("centre")[i] for i, c in enumerate(names)]
    return sum((off[i] * off[j] * F.col("precision")[i * p + j] for i in range(p) for j in range(p)), F.lit(0.0))


def _with_params(rows: DataFrame, params: DataFrame) -> DataFrame:
    return rows.join(params.select("group", "centre", "precision"), "group")


def fit_mcd(rows: DataFrame, floors: dict[str, float], keep: float = 0.75, steps: int = 3) -> DataFrame:
    """(group, centre, precision) by minimum covariance determinant, for every ``group`` of ``rows``.

    Starts from medians and quartile ranges and takes concentration steps, which never raise the
    determinant: each keeps the ``keep`` share of a group's rows that lie nearest and estimates mean
    and covariance from those. A step is two grouped sums: a histogram of distances, fine enough
    (sixteen bins to a doubling) to place the cut, and the moments of the rows below it. So a group
    of any size is combined before its shuffle, and only sums per group meet. The covariance is made
    consistent for normal data and widened by the squared ``floors``, so that a statistic that never
    varies in a group rejects nothing for a trifle.
    """
    names, p = list(floors), len(floors)
    low = np.array(list(floors.values()))
    inner = chi2_cut(p, 1 - keep)
    # Share of a wider chi-square below the same cut: the usual consistency factor.
    below = 1 - math.exp(-inner / 2) * sum((inner / 2) ** k / math.factorial(k) for k in range((p + 2) // 2))
    if p % 2:
        terms = sum((inner / 2) ** (k + 0.5) / math.gamma(k + 1.5) for k in range((p + 2) // 2))
        below = 1 - math.erfc(math.sqrt(inner / 2)) - math.exp(-inner / 2) * terms
    factor = keep / below
    schema = "group string, centre array<double>, precision array<double>"

    def start(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                quartiles = np.array([list(q) for q in row[1:]], float)
                spread = (quartiles[:, 2] - quartiles[:, 0]) / 1.349
                out.append((row[0], quartiles[:, 1].tolist(), np.diag(1 / (spread**2 + low**2)).ravel().tolist()))
            yield pd.DataFrame(out, columns=["group", "centre", "precision"])

    def refit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                n, sums = row[1], np.array(row[2 : 2 + p], float)
                cross = np.zeros((p, p))
                cross[np.triu_indices(p)] = row[2 + p :]
                cross = np.triu(cross, 1).T + cross
                centre = sums / n
                cov = factor * (cross / n - np.outer(centre, centre)) + np.diag(low**2)
                out.append((row[0], centre.tolist(), np.linalg.inv(cov).ravel().tolist()))
            yield pd.DataFrame(out, columns=["group", "centre", "precision"])

    quartiles = [F.percentile_approx(c, [0.25, 0.5, 0.75], 1000).alias(c) for c in names]
    params = kept(rows.groupBy("group").agg(*quartiles).mapInPandas(start, schema), "mcd")
    distance = _distance(names)
    bin_of = F.floor(16 * F.log2(distance + F.lit(1e-6))).alias("bin")
    upto = Window.partitionBy("group").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    moments = [F.sum(c) for c in names] + [F.sum(F.col(a) * F.col(b)) for i, a in enumerate(names) for b in names[i:]]
    for _ in range(steps):
        placed = _with_params(rows, params).select("group", *names, bin_of)
        counts = placed.groupBy("group", "bin").agg(F.count("*").alias("n"))
        cuts = (
            counts.withColumns({"below": F.sum("n").over(upto), "all": F.sum("n").over(Window.partitionBy("group"))})
            .where(F.col("below") >= F.lit(keep) * F.col("all"))
            .groupBy("group")
            .agg(F.min("bin").alias("cut"))
        )
        near = placed.join(kept(cuts, "mcd-cuts"), "group").where(F.col("bin") <= F.col("cut"))
        sums = near.groupBy("group").agg(F.count("*").alias("n"), *[m.alias(f"m{i}") for i, m in enumerate(moments)])
        params = kept(sums.mapInPandas(refit, schema), "mcd")
    return params


def judge(docs: DataFrame, tail: float = 1e-6, carry: Sequence[str] = ("doc_id",), text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The columns ``carry`` of every row, with its counts, ``base_failed``, ``distance`` and ``kept``.

    Rows that pass the fixed limits are held against the minimum-covariance-determinant estimate of
    their language and source; those beyond the chi-square quantile of ``tail`` are rejected. A NULL
    language or source is a value of its own. A group of one row has distance 0 and is kept. NULL and
    empty texts fail the fixed limits; repeated rows are judged alike; an empty table gives no rows.
    """
    names = list(FLOORS)
    n = F.greatest(F.col("n_words"), F.lit(1))
    lines = F.greatest(F.col("n_lines"), F.lit(1))
    mark = [F.coalesce(F.concat(F.lit("v"), F.col(f"`of_{c}`").cast("string")), F.lit("n")) for c in (lang_col, source_col)]
    measured = kept(measure(docs, [*carry, *{lang_col, source_col}.difference(carry)], text_col), "text-counts", texts=True)
    counts = [c.split()[0] for c in COUNTS.split(", ")]
    rows = measured.select(
        F.struct(*[F.col(f"`of_{c}`").alias(c) for c in carry], *counts).alias("row"),
        base_failed().alias("failed"),
        F.concat_ws("\x01", *mark).alias("group"),
        F.log1p(F.col("word_chars") / n).alias("x_length"),
        F.sqrt(F.col("n_symbols") / n).alias("x_symbols"),
        F.sqrt(F.col("n_dup_lines") / lines).alias("x_lines"),
        F.sqrt(F.col("n_repeat_words") / n).alias("x_repeats"),
        F.sqrt(F.col("n_shouted") / n).alias("x_shouting"),
    )
    params = fit_mcd(rows.where(~F.col("failed")).select("group", *names), FLOORS)
    judged = rows.join(params, "group", "left").withColumn("distance", _distance(names))
    far = F.coalesce(F.col("distance") > chi2_cut(len(names), tail), F.lit(False))
    return judged.select("row.*", F.col("failed").alias("base_failed"), "distance", (~F.col("failed") & ~far).alias("kept"))
