"""SimHash fingerprints, their links by multi-index hashing, and the groups the links make."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dipstick.llm.common import by_value, kept, lower_ascii, pieces, text_of

by_value(__name__)

SEED = 42


def fingerprint(text: str, shingle: int = 4) -> int:
    """64 bits of a lower-cased text; a bit is set where over half of the shingles' hashes set it."""
    words = text.encode().split()
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())
    hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], np.uint64)
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):  # a long text's bits are counted in parts
        part = hashes[at : at + 4096].astype(">u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """(doc_id, fp) and the columns ``carry`` of every row, ``fp`` as a signed 64-bit number. NULL texts count as empty."""
    others = [f"of_{c}" for c in carry]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64)
            columns = [batch.column(0), pa.array(found.view(np.int64)), *[batch.column(i + 2) for i in range(len(others))]]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "fp", *others])

    plain = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), lower_ascii(text_of(text_col)).alias("text"), *[F.col(f"`{c}`").alias(f"of_{c}") for c in carry])
    kinds = "".join(f", `{c}` {kind}" for c, kind in plain.dtypes[2:])
    return plain.mapInArrow(work, f"doc_id bigint, fp bigint{kinds}")


def segments(bits: int, distance: int) -> list[tuple[int, int, int]]:
    """(shift, width, radius) of each segment: fingerprints that link agree on one within its radius.

    With m segments and r differing bits some segment differs in at most r div m; the ones after the
    first r mod m + 1 need search one bit less far, or the total would already exceed r. Three
    segments keep the radius at one for four bits, and are as wide as that allows.
    """
    m = max(2, distance // 2 + 1)
    widths = [bits // m + (i >= m - bits % m) for i in range(m)]
    shifts = [sum(widths[:i]) for i in range(m)]
    radius, extra = divmod(distance, m)
    return [(s, w, radius if i <= extra else radius - 1) for i, (s, w) in enumerate(zip(shifts, widths))]


def _ball(width: int, radius: int) -> list[int]:
    """Masks of up to ``radius`` bits (at most one, by the choice of segments)."""
    if radius < 0:  # the other segments find such a pair
        return []
    return [0] + ([1 << i for i in range(width)] if radius else [])


def near_pairs(classes: DataFrame, distance: int = 4) -> DataFrame:
    """(a, b, root_a, root_b), a < b: fingerprints of different roots at ``distance`` or fewer differing bits.

    Multi-index hashing: a table holds every fingerprint of ``classes`` (fp, root) under each of its
    segments; a fingerprint enumerates the small Hamming ball around each of its segments and fetches
    the table rows there. The whole distance is checked inside the join. Segments are as wide as the
    pigeonhole allows, so a bucket holds few unrelated fingerprints; a bucket that a family of near
    copies fills is split by the adaptive skew join. A pair may come once for each shared segment.
    """
    table, probes = [], []
    for number, (shift, width, radius) in enumerate(segments(64, distance)):
        value = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1))
        name = F.lit(number << 48)
        table.append(name.bitwiseOR(value))
        probes += [name.bitwiseOR(value.bitwiseXOR(F.lit(mask))) for mask in _ball(width, radius)]
    left = classes.select(F.col("fp").alias("a"), F.col("root").alias("root_a"), F.explode(F.array(*probes)).alias("key"))
    right = classes.select(F.col("fp").alias("b"), F.col("root").alias("root_b"), F.explode(F.array(*table)).alias("key"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    apart = (F.col("a") < F.col("b")) & (F.col("root_a") != F.col("root_b"))
    return left.join(right, (left["key"] == right["key"]) & apart & near).select("a", "b", "root_a", "root_b")


def _rooted(classes: DataFrame, edges: DataFrame) -> DataFrame:
    """``classes`` with every root replaced by the smallest root that ``edges`` between roots reach."""
    roots = kept(components(edges), "roots")
    found = classes.join(roots.withColumnRenamed("root", "least"), classes["root"] == roots["node"], "left")
    return kept(found.select("fp", F.coalesce("least", "root").alias("root")), "classes")


def connected(prints: DataFrame, distance: int = 4) -> DataFrame:
    """(fp, root) of every distinct fingerprint: one root for all that links join, directly or by others.

    Two searches. In the first every fingerprint keeps one of its links only, the one to its largest
    partner, so that a family of near copies leaves the join as a star, not as all its pairs. The
    second looks at all pairs again and reports those whose roots still differ, as pairs of roots:
    with them every link joins two fingerprints of one root, and none was lost. Both are combined
    before their shuffle.
    """
    alone = kept(prints.select("fp").distinct().select("fp", F.col("fp").alias("root")), "classes")
    stars = near_pairs(alone, distance).groupBy("a").agg(F.max("b").alias("b"))
    joined = _rooted(alone, stars)
    left = near_pairs(joined, distance).select(F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b"))
    return _rooted(joined, left.distinct())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node reachable.

    Alternating large-star and small-star steps. Each replaces a node's edges by edges to the
    smallest neighbour, so the number of edges never grows and the rounds are about the logarithm
    of the longest path. Every step is joins and grouped minima, written to the shared folder.
    """

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        if not large:
            both = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        joined = both.join(least, "a")
        far = joined.where(F.col("b") > F.col("a")) if large else joined.where(F.col("b") != F.col("m"))
        moved = far.select(F.col("b").alias("x"), F.col("m").alias("y"))
        if not large:
            moved = moved.unionByName(joined.select(F.col("a").alias("x"), F.col("m").alias("y")))
        return moved.where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()

    def state(pairs: DataFrame):
        return pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    now, before = kept(edges, "links"), None
    while (mark := state(now)) != before:
        before = mark
        now = kept(star(kept(star(now, True), "links"), False), "links")
    # Now every edge joins a root with one of its nodes.
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(
        now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    )


def near_duplicates(docs: DataFrame, shingle: int = 4, distance: int = 4, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row; with ``carry`` also its root and these columns.

    Rows of one fingerprint are one class, so copies never meet in pairs: links run between distinct
    fingerprints, and the smallest id of a class is found by a combined minimum. ``component_id`` is
    the smallest id reachable over links. Texts without words have fingerprint zero and are linked
    like others. Repeated rows are answered row by row; NULL ids take part but name a component only
    where it has no other id (then it is NULL). An id that unrelated rows share can name two
    components; ``root``, the fingerprint that stands for a component, is its own. An empty table
    gives no rows.
    """
    more = ["root"] if carry else []
    prints = kept(fingerprints(docs, shingle, id_col, text_col, carry), "fingerprints", texts=True)
    firsts = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    # Written, so that the join by root reads plain rows and a large component is split there.
    named = kept(firsts.join(connected(prints, distance), "fp"), "named")
    least = kept(named.groupBy("root").agg(F.min("first").alias("component_id")), "least")
    answer = kept(named.join(least, "root").select("fp", "component_id", *more), "classes")
    shown = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return prints.join(answer, "fp").select("doc_id", shown.alias("fingerprint"), "component_id", *more, *[F.col(f"`of_{c}`").alias(c) for c in carry])
