"""Document fingerprints from closed syncmers, and their likeness by position."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dipstick.llm.common import by_value, kept, pieces, text_of

by_value(__name__)

# Code points in a k-mer and in the inner substrings whose least one must lie at an edge.
K, S = 31, 8
WINDOW = K - S + 1
# An anchor: the hash of its k-mer in the upper bits, the distance to the anchor before it in the lower ones.
GAP_BITS = 5
# Bytes of text in a part, and parts at most; a part's border is one row on the driver.
PART_BYTES, MOST_PARTS = 64 << 20, 100_000

# Odd multipliers of the doubling steps and of the last mix.
_MULTIPLIERS = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(_MULTIPLIERS[4])
    return h ^ (h >> np.uint64(29))


def _grown(h: np.ndarray, step: int, level: int) -> np.ndarray:
    """Hashes of substrings twice as long as ``step``, from those of ``step``."""
    return _mixed(h[:-step] * np.uint64(_MULTIPLIERS[level % 4]) + h[step:])


def anchors(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, places) of the closed syncmers of a text, in order.

    A k-mer is one if the least hash among its inner substrings is that of its first or its last one,
    so whether it is chosen depends on the k-mer alone, and among ``WINDOW`` neighbouring k-mers there
    is always one. A text shorter than a k-mer has one anchor, the whole text; an empty one has none.
    """
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    n = len(points)
    if n < K:
        whole = int.from_bytes(hashlib.blake2b(text.encode(), digest_size=4).digest(), "little") >> GAP_BITS
        return np.array([whole] * (n > 0), np.uint32), np.zeros(int(n > 0), np.int64)
    h = _mixed(points.astype(np.uint64) + np.uint64(1))
    inner, step, level = None, 1, 0
    while 2 * step <= K:
        h = _grown(h, step, level)
        step, level = 2 * step, level + 1
        if step == S:
            inner = h
    # Least of WINDOW neighbouring inner hashes, by doubling.
    least, width = inner, 1
    while 2 * width <= WINDOW:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < WINDOW:
        least = np.minimum(least[: len(least) - (WINDOW - width)], least[WINDOW - width :])
    places = np.flatnonzero((inner[: len(least)] == least) | (inner[WINDOW - 1 :] == least))
    # A k-mer is covered by two overlapping substrings of ``step`` code points.
    hashes = _mixed(h[places] * np.uint64(_MULTIPLIERS[3]) + h[places + K - step])
    return (hashes >> np.uint64(32 + GAP_BITS)).astype(np.uint32), places


def encoded(hashes: np.ndarray, places: np.ndarray) -> str:
    """A fingerprint: one 32-bit word an anchor, in order, as base64 without padding."""
    gaps = np.diff(places, prepend=0).astype(np.uint32)
    return base64.b64encode((hashes << np.uint32(GAP_BITS) | gaps).astype("<u4").tobytes()).decode().rstrip("=")


def decoded(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    words = np.frombuffer(base64.b64decode(fingerprint + "=" * (-len(fingerprint) % 4)), "<u4")
    return words >> np.uint32(GAP_BITS), np.cumsum(words & np.uint32((1 << GAP_BITS) - 1), dtype=np.int64)


def _numbered(hashes: np.ndarray) -> np.ndarray:
    """Each hash with the number of equal ones before it."""
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    turn = np.empty(len(hashes), np.uint64)
    turn[order] = np.arange(len(hashes)) - np.repeat(starts, np.diff(np.r_[starts, len(hashes)]))
    return hashes.astype(np.uint64) << np.uint64(32) | turn


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Share of the anchors of both that match by position.

    Equal anchors are paired in order (the j-th of a hash with the j-th); a pair counts if another
    one has the same offset between its places, or if the shorter fingerprint has one anchor only.
    """
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    _, i, j = np.intersect1d(_numbered(a[0]), _numbered(b[0]), assume_unique=True, return_indices=True)
    _, counts = np.unique(a[1][i] - b[1][j], return_counts=True)
    least = min(2, len(a[0]), len(b[0]))
    return 2 * int(counts[counts >= least].sum()) / (len(a[0]) + len(b[0]))


def fingerprint(text: str) -> str:
    return encoded(*anchors(text))


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as much of the start of ``following``, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """(doc_id, fingerprint) and the columns ``carry`` of every row; NULL texts count as empty."""
    others = [f"of_{c}" for c in carry]
    plain = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_of(text_col).alias("text"), *[F.col(f"`{c}`").alias(o) for c, o in zip(carry, others)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = pa.array([fingerprint(t) for t in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), found, *batch.columns[2:]], ["doc_id", "fingerprint", *others])

    kinds = "".join(f", `{c}` {kind}" for c, kind in plain.dtypes[2:])
    done = plain.mapInArrow(work, f"doc_id {plain.dtypes[0][1]}, fingerprint string{kinds}")
    return done.select("doc_id", "fingerprint", *[F.col(f"`{o}`").alias(c) for c, o in zip(carry, others)])


KEY = np.dtype([("known", "?"), ("doc_id", "<i8"), ("digest", "<i8")])


def _keys(found: list, part: str) -> np.ndarray:
    return np.array(sorted((r[part].known, r[part].doc_id or 0, r[part].digest) for r in found), KEY)


def _parts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """First keys of the parts, ranges of (doc_id, digest), and keys whose equal rows fill much of a part.

    Only keys are sorted; one key a part and at most eight full keys a part come to the driver.
    """
    key = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "digest")  # NULL first
    keys = kept(rows.select("doc_id", "digest", F.octet_length("text").alias("size")), "keys")
    size = keys.agg(F.sum("size")).first()[0] or 0
    parts = min(MOST_PARTS, size // PART_BYTES + 1)
    parts = max(parts, min(rows.sparkSession.sparkContext.defaultParallelism, size // 100_000))
    spread = keys.repartitionByRange(parts, key).withColumn("part", F.spark_partition_id())
    firsts = spread.groupBy("part").agg(F.min(key).alias("first")).collect()
    full = keys.groupBy("doc_id", "digest").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    full = full.where((F.col("n") > 1) & (F.col("size") * 8 > max(size // parts, 1))).select(key.alias("key")).collect()
    return _keys(firsts, "first"), _keys(full, "key")


def _sent(rows: DataFrame) -> tuple[DataFrame, int]:
    """Every row in its part, and the first row of a part also after the last one of the part before it.

    ``part`` is found by bisection over the borders. ``role`` is 0 for a row of its own part and 1 for
    the guest. Rows equal in id and text that fill much of a part are dealt to all parts, but for the
    first that a task sees: each is followed by its own text, wherever it is (role 2).
    """
    rows = rows.select("doc_id", "text", F.xxhash64("text").alias("digest"))
    firsts, full = _parts(rows)
    n_parts = max(1, len(firsts))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealt: dict[tuple, int] = {}
        for batch in pieces(batches, 500):
            key = np.zeros(batch.num_rows, KEY)
            key["known"] = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            key["doc_id"] = batch.column(0).fill_null(0).to_numpy()
            key["digest"] = batch.column(2).to_numpy()
            part = np.searchsorted(firsts, key, "right") - 1
            guests = np.flatnonzero(firsts[part] == key)
            home, role = part.copy(), np.zeros(batch.num_rows, np.int8)
            for at in np.flatnonzero(np.isin(key, full)) if len(full) else ():
                mark = key[at].item()
                dealt[mark] = dealt.get(mark, -1) + 1
                if dealt[mark]:
                    part[at], role[at] = (part[at] + dealt[mark]) % n_parts, 2
            guests = guests[role[guests] == 0]
            taken = batch.take(pa.array(np.r_[np.arange(batch.num_rows), guests]))
            parts = np.r_[part, (home[guests] - 1) % n_parts].astype(np.int32)
            roles = np.r_[role, np.ones(len(guests), np.int8)]
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(parts), pa.array(roles)], ["doc_id", "text", "digest", "part", "role"])

    return rows.mapInArrow(work, "doc_id bigint, text string, digest bigint, part int, role tinyint"), n_parts


FOUND = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a part in order, each with the one that follows it; two texts are held at a time."""
    names = [c.split()[0] for c in FOUND.split(", ")]
    before = None

    def row(doc_id: int | None, text: str, own: tuple, following: str, after: tuple) -> tuple:
        changed = edited(text, following)
        other = own if changed == text else anchors(changed)
        digest = hashlib.sha256(changed.encode()).hexdigest()
        return doc_id, len(text), digest, encoded(*own), encoded(*other), likeness(own, other), likeness(own, after)

    for batch in pieces(batches, 200):
        out = []
        for doc_id, text, role in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if role == 1 and before is None:
                continue  # a second guest
            own = before[2] if before is not None and before[1] == text else anchors(text)
            if role == 2:
                out.append(row(doc_id, text, own, text, own))
                continue
            if before is not None:
                out.append(row(*before, text, own))
            before = (doc_id, text, own) if role == 0 else None
        yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*out)))) if out else {n: [] for n in names}, schema=_schema())


def _schema() -> pa.Schema:
    kinds = {"bigint": pa.int64(), "string": pa.string(), "double": pa.float64()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in FOUND.split(", ")])


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    The next document is the next by id, NULL first, and among rows of one id by a digest of the text;
    after the last comes the first. Only keys are sorted to find the borders of parts; then each text
    is shuffled once, the first of a part twice. NULL texts count as empty: their fingerprint is empty,
    and like another empty one only. Repeated rows are answered row by row, and an only document is its
    own next one. An empty table gives no rows. Other columns are ignored.
    """
    plain = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), text_of(text_col).alias("text"))
    rows, n_parts = _sent(plain)
    # Own rows in order, then the guest; rows dealt here come first, for they need no other.
    order = ["part", F.when(F.col("role") == 2, -1).otherwise(F.col("role")), F.col("doc_id").asc_nulls_first(), "digest"]
    walked = rows.repartitionById(n_parts, F.col("part")).sortWithinPartitions(*order)
    return walked.select("doc_id", "text", "role").mapInArrow(_walk, FOUND)
