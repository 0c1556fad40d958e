"""Whitening of embeddings by an incremental eigendecomposition with a last Rayleigh-Ritz step."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dipstick.llm.common import by_value, kept

by_value(__name__)

# How an entry becomes a whole number.
SCALE, SHIFT = 64, 1_000_000
# Entries beyond this are taken as this, so that they stay exact in a double.
LARGEST = 1 << 45
# Bytes of a chunk of vectors, and spectra that one task combines.
CHUNK_BYTES, FAN = 16 << 20, 16
EPS = np.finfo(float).eps
SPECTRUM = "part int, n bigint, sums array<string>, mean array<double>, spread array<double>, axes array<double>"


def roots(poles: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of the secular equation ``1 + sum(weights / (poles - x)) = 0``, one above each of the rising poles.

    Given as the index of the nearer pole and the offset from it, so that differences to poles keep
    their digits. Offsets are bisected down to neighbouring numbers.
    """
    k = len(poles)
    widths = np.diff(poles, append=poles[-1] + weights.sum())
    with np.errstate(divide="ignore"):
        at_middle = 1 + (weights / (poles[None, :] - (poles + widths / 2)[:, None])).sum(axis=1)
        left = (at_middle >= 0) | (np.arange(k) == k - 1)
        nearer = np.arange(k) + ~left
        low = np.where(left, 0.0, -widths / 2)
        high = np.where(left, np.where(np.arange(k) == k - 1, widths, widths / 2), 0.0)
        offsets = poles[None, :] - poles[nearer][:, None]
        while True:
            middle = (low + high) / 2
            if np.all((middle == low) | (middle == high) | (high - low <= 2 * EPS * np.abs(middle))):
                break
            above = 1 + (weights / (offsets - middle[:, None])).sum(axis=1) >= 0
            low, high = np.where(above, low, middle), np.where(above, middle, high)
    return nearer, np.where(left, high, low)  # the end that is not the pole


def rank_one(values: np.ndarray, vectors: np.ndarray, along: np.ndarray, weight: float) -> tuple[np.ndarray, np.ndarray]:
    """Spectrum of ``vectors diag(values) vectors' + weight along along'``; values rise, ``weight`` is not negative.

    Deflation: of equal values a reflection leaves one with a share of the update, and a value whose
    share is too small to move it stays as it is. The others are roots of the secular equation, whose
    vectors are made from the update that has exactly these roots, so that they stay orthogonal.
    """
    z = math.sqrt(weight) * (along @ vectors)
    scale = max(values[-1], z @ z)
    least = 8 * EPS * scale
    if not scale > 0:
        return values, vectors
    values, vectors = values.copy(), vectors.copy()
    cuts = np.flatnonzero(np.diff(values) > least) + 1
    for a, b in zip([0, *cuts], [*cuts, len(values)]):
        norm = np.linalg.norm(z[a:b])
        if b - a > 1 and norm > 0:
            mirror = z[a:b].copy()
            mirror[-1] += math.copysign(norm, mirror[-1])
            vectors[:, a:b] -= np.outer(vectors[:, a:b] @ mirror, mirror * (2 / (mirror @ mirror)))
            z[b - 1], z[a : b - 1] = -math.copysign(norm, z[b - 1]), 0
    moved = np.flatnonzero(np.abs(z) * np.linalg.norm(z) > least)
    if len(moved):
        poles, z, k = values[moved], z[moved], len(moved)
        nearer, offset = roots(poles, z * z)
        apart = poles[None, :] - poles[nearer][:, None] - offset[:, None]  # pole j less root i
        i, j = np.arange(k)[:, None], np.arange(k)[None, :]
        other = np.where(i < j, poles[:, None], np.append(poles[1:], 0)[:, None]) - poles[None, :]
        ratio = np.where(i == k - 1, -apart, -apart / np.where(i == k - 1, 1, other))
        shares = np.sqrt(np.abs(ratio.prod(axis=0))) * np.sign(z)
        turn = (shares[None, :] / apart).T
        vectors[:, moved] = vectors[:, moved] @ (turn / np.linalg.norm(turn, axis=0))
        values[moved] = poles[nearer] + offset
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


@dataclass
class Spectrum:
    """Number, sums, mean and eigenpairs of the scatter of the vectors seen so far."""

    n: int
    sums: list[int]
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def empty(cls, size: int) -> "Spectrum":
        return cls(0, [0] * size, np.zeros(size), np.zeros(size), np.eye(size))

    def _shift(self, mean: np.ndarray, n: int) -> None:
        """The update along the difference of two means."""
        if self.n:
            along = mean - self.mean
            self.values, self.vectors = rank_one(self.values, self.vectors, along, self.n * n / (self.n + n))
            self.mean = self.mean + along * (n / (self.n + n))
        else:
            self.mean = mean
        self.n += n

    def add(self, x: np.ndarray) -> None:
        """A chunk of vectors: its centred rows, reduced to as many as there are dimensions with the same
        scatter, are one rank-one update each; its mean is one more. A single row is the mean's update alone."""
        mean = x.mean(axis=0)
        self.sums = [a + b for a, b in zip(self.sums, x.astype(object).sum(axis=0) if np.abs(x).max() > 1 << 40 else x.sum(axis=0).tolist())]
        for row in np.linalg.qr(x - mean, mode="r"):
            self.values, self.vectors = rank_one(self.values, self.vectors, row, 1.0)
        self._shift(mean, len(x))

    def merge(self, other: "Spectrum") -> None:
        """The other spectrum, by one update for each of its eigenpairs and one for the means."""
        for value, along in zip(other.values, other.vectors.T):
            if value > 0:
                self.values, self.vectors = rank_one(self.values, self.vectors, along, value)
        self.sums = [a + b for a, b in zip(self.sums, other.sums)]
        self._shift(other.mean, other.n)

    def row(self, part: int) -> dict:
        return {"part": part, "n": self.n, "sums": [str(s) for s in self.sums], "mean": self.mean.tolist(),
                "spread": self.values.tolist(), "axes": self.vectors.ravel().tolist()}

    @classmethod
    def of(cls, row) -> "Spectrum":
        size = len(row["mean"])
        axes = np.array(row["axes"], float).reshape(size, size)
        return cls(int(row["n"]), [int(s) for s in row["sums"]], np.array(row["mean"], float), np.array(row["spread"], float), axes)


def _matrices(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(ids, whole numbers) of chunks of vectors that hold ``size`` known, finite entries each."""
    rows = max(1, CHUNK_BYTES // (8 * size))
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            some = batch.slice(start, rows)
            entries = some.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, size)
            x = np.clip(np.floor(SCALE * entries), -LARGEST, LARGEST).astype(np.int64) + SHIFT
            yield some.column(0), x


def _offsets(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - sums`` exactly: as longs where they fit."""
    if n * int(np.abs(x).max()) + max(map(abs, sums)) < 1 << 62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def deviations(offsets: np.ndarray) -> list[int | None]:
    """Sums of squares of rows exactly; NULL where a long cannot hold one."""
    if offsets.shape[1] * int(np.abs(offsets).max()) ** 2 < 1 << 63:
        return (offsets * offsets).sum(axis=1).tolist()
    found = (offsets.astype(object) ** 2).sum(axis=1)
    return [int(v) if v < 1 << 63 else None for v in found]


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, embedding) of rows whose vector is known, not empty, and holds known finite entries only."""
    rows = vectors.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{vec_col}`").alias("embedding"))
    fine = F.forall("embedding", lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf")))
    return rows.where(fine & (F.size("embedding") > 0))


def _summed(df: DataFrame) -> np.ndarray:
    """Entry by entry sums of the arrays ``part``, one an input task, combined before their shuffle."""
    sums = df.select(F.posexplode("part")).groupBy("pos").agg(F.sum("col").alias("total"))
    return np.array([r.total for r in sums.orderBy("pos").collect()], float)


def spectrum(rows: DataFrame, size: int) -> Spectrum | None:
    """The spectrum of all rows: one by task, incrementally, then combined in a tree of ``FAN``."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Spectrum.empty(size)
        for _, x in _matrices(batches, size):
            found.add(x)
        if found.n:
            yield pa.RecordBatch.from_pandas(pd.DataFrame([found.row(TaskContext.get().partitionId())]), schema=kinds, preserve_index=False)

    def combine(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("part")
        found = Spectrum.of(frame.iloc[0])
        for at in range(1, len(frame)):
            found.merge(Spectrum.of(frame.iloc[at]))
        return pd.DataFrame([found.row(int(frame["part"].iloc[0]) // FAN)])

    numbers, texts = pa.list_(pa.float64()), pa.list_(pa.string())
    kinds = pa.schema([("part", pa.int32()), ("n", pa.int64()), ("sums", texts), ("mean", numbers), ("spread", numbers), ("axes", numbers)])
    spectra = kept(rows.mapInArrow(learn, SPECTRUM), "spectra")
    left = spectra.count()
    while left > 1:
        spectra = kept(spectra.groupBy(F.expr(f"part div {FAN}")).applyInPandas(combine, SPECTRUM), "spectra")
        left = spectra.count()
    first = spectra.first()
    return Spectrum.of(first) if first else None


@dataclass
class Whitening:
    """What ``fit`` learned: exact number and sums, the components as columns, their variances, and checks."""

    n: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    trace: float
    identity_error: float | None

    def project(self, offsets: np.ndarray) -> np.ndarray:
        """Whitened rows; NaN along a component without variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            found = (offsets.astype(float) / self.n) @ self.components / np.sqrt(self.variances)
        found[:, self.variances <= 0] = np.nan
        return found

    def explained(self) -> list[float | None]:
        return [float(v / self.trace) if self.trace > 0 else None for v in self.variances]


def fit(rows: DataFrame, components: int = 32) -> Whitening | None:
    """Components of all ``usable`` vectors of one size; None where there are none.

    The combined spectrum's axes are a whole orthonormal basis. The Rayleigh-Ritz step projects every
    centred vector on it, sums the products by task, and turns the basis by the eigenvectors of that
    small matrix: they are then eigenvectors of the covariance to double precision. One more pass
    measures the covariance of the whitened rows. A task holds matrices of size by size; sums of
    these, one an entry, are what the driver sees.
    """
    size = rows.select(F.size("embedding")).first()
    if size is None:
        return None
    size = size[0]
    learned = spectrum(rows, size)
    n, sums = learned.n, learned.sums
    basis = np.linalg.qr(learned.vectors)[0]

    def products(project) -> np.ndarray:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = 0.0
            for _, x in _matrices(batches, size):
                y = project(_offsets(x, n, sums))
                total = total + np.concatenate([(y.T @ y).ravel(), y.sum(axis=0)])
            if np.ndim(total):
                yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["part"])

        return _summed(rows.mapInArrow(work, "part array<double>")) / n

    small = products(lambda offsets: offsets.astype(float) / n @ basis)[: size * size].reshape(size, size)
    values, turn = np.linalg.eigh((small + small.T) / 2)
    values, turn = values[::-1], turn[:, ::-1]
    trace = float(np.trace(small))
    values = np.where(values > size * EPS * max(values[0], 0), values, 0.0)
    k = min(components, size)
    found = Whitening(n, sums, basis @ turn[:, :k], values[:k], trace, None)
    real = int((found.variances > 0).sum())
    if real:
        checked = Whitening(n, sums, found.components[:, :real], found.variances[:real], trace, None)
        measured = products(checked.project)
        mean = measured[real * real :]
        covariance = measured[: real * real].reshape(real, real) - np.outer(mean, mean)
        found.identity_error = float(np.abs(covariance - np.eye(real)).max())
    return found


def _literal(values: list[float | None]) -> Column:
    return F.array(*[F.lit(v).cast("double") for v in values])


def whiten(vectors: DataFrame, components: int = 32, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every usable vector and component.

    Rows with a NULL, an empty vector or NULL or non-finite entries are dropped. Where vectors differ
    in size only those of the commonest size (the larger one of a tie) belong together and are kept.
    Repeated rows and NULL ids count and are answered like others. A component without variance (equal
    vectors, fewer vectors than dimensions) has a NULL ``whitened``; without any variance ``explained``
    and ``identity_error`` are NULL too. ``deviation`` is NULL where a long cannot hold it. An empty
    table gives no rows; other columns are ignored.
    """
    rows = usable(vectors, id_col, vec_col)
    sizes = rows.groupBy(F.size("embedding").alias("size")).count()
    common = sizes.orderBy(F.desc("count"), F.desc("size")).first()
    rows = rows.where(F.size("embedding") == (common["size"] if common else 0))
    found = fit(rows, components) if common else None
    size = common["size"] if common else 0

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _matrices(batches, size):
            offsets = _offsets(x, found.n, found.sums)
            y = found.project(offsets)
            ends = np.arange(0, y.size + 1, y.shape[1], dtype=np.int32)
            each = pa.ListArray.from_arrays(ends, pa.array(y.ravel(), from_pandas=True))
            yield pa.RecordBatch.from_arrays([ids, pa.array(deviations(offsets), pa.int64()), each], ["vec_id", "deviation", "whitened"])

    done = rows.mapInArrow(work, f"vec_id {rows.dtypes[0][1]}, deviation bigint, whitened array<double>")
    n, shares, error = (found.n, found.explained(), found.identity_error) if found else (0, [None], None)
    return done.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("bigint").alias("n"), "deviation", "whitened",
        F.get(_literal(shares), F.col("at")).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
