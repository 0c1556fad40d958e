"""Token ids in files of 64-bit words, coded Simple-8b."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dipstick.llm.common import by_value, kept, pieces, text_of, worker_memo
from dipstick.llm.tokens import PieceEncoder
from dipstick.session import fresh_path

by_value(__name__)

# Fixed values of the format. The upper four bits of a word select how many ids it holds and in how many
# bits each. Selector 0 is an escape: the word holds the place of one id of over 60 bits in the block's list.
COUNTS = np.array([1, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 240])
WIDTHS = np.array([60, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 0])
MAGIC = b"dips8b01"
BLOCK = 1 << 16
_FOOT = "<8sqqq"  # magic, documents, ids, blocks
_BLOCK = np.dtype([("offset", "<i8"), ("ids", "<i8"), ("words", "<i8"), ("escapes", "<i8")])
_DOC = np.dtype([("id", "<i8"), ("known", "?"), ("ids", "<i8")])


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words and escaped values of a block of unsigned ids.

    Which selectors fit is found for all places at once, by running maxima of the bit widths; only
    the walk from word to word is a loop.
    """
    n = len(ids)
    padded = np.concatenate([ids.astype(np.uint64), np.zeros(240, np.uint64)])
    bits = np.zeros(len(padded), np.uint8)
    rest = padded.astype(np.min_scalar_type(padded.max()))  # small ids are measured in few bytes
    step = rest.dtype.itemsize * 4
    while step:
        high = rest >> rest.dtype.type(step)
        bits += (high > 0).astype(np.uint8) * np.uint8(step)
        rest = np.where(high > 0, high, rest)
        step //= 2
    bits += (rest > 0).astype(np.uint8)
    choice = np.zeros(n, np.uint8)
    running, width = bits, 1
    for selector in range(1, 16):
        while width < COUNTS[selector]:  # a window is the union of two shorter ones
            by = min(width, int(COUNTS[selector]) - width)
            running = np.maximum(running[: len(running) - by], running[by:])
            width += by
        fits = running[:n] <= WIDTHS[selector]
        if not fits.any():  # nor will more ids in fewer bits
            break
        choice[fits] = selector
    step_of, starts, at = COUNTS[choice].astype(np.uint8).tobytes(), [], 0
    while at < n:
        starts.append(at)
        at += step_of[at]
    starts = np.array(starts, np.int64)
    chosen = choice[starts]
    words = chosen.astype(np.uint64) << np.uint64(60)
    for selector in range(1, 15):
        where = np.flatnonzero(chosen == selector)
        for k in range(COUNTS[selector]):
            words[where] |= padded[starts[where] + k] << np.uint64(k * WIDTHS[selector])
    escaped = np.flatnonzero(chosen == 0)
    words[escaped] |= np.arange(len(escaped), dtype=np.uint64)
    return words, padded[starts[escaped]]


def unpack(words: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` ids of a block, a selector at a time."""
    chosen = (words >> np.uint64(60)).astype(np.int64)
    sizes = COUNTS[chosen]
    starts = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint64)
    for selector in range(1, 15):
        where = np.flatnonzero(chosen == selector)
        mask = np.uint64((1 << int(WIDTHS[selector])) - 1)
        for k in range(COUNTS[selector]):
            out[starts[where] + k] = (words[where] >> np.uint64(k * WIDTHS[selector])) & mask
    where = np.flatnonzero(chosen == 0)
    out[starts[where]] = escapes[(words[where] & np.uint64((1 << 60) - 1)).astype(np.int64)]
    return out[:n]


class ShardWriter:
    """One file: blocks, block table, document table, foot. Memory holds one block and the two tables."""

    def __init__(self, out):
        self.out, self.blocks, self.docs, self.rest = out, [], [], np.empty(0, np.uint64)
        self.offset = self.n_ids = self.n_docs = 0

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.offset += len(data)

    def _block(self, ids: np.ndarray) -> None:
        words, escapes = pack(ids)
        self.blocks.append((self.offset, len(ids), len(words), len(escapes)))
        for part in (words, escapes):
            self._write(part.astype("<u8").tobytes())

    def add(self, doc_ids: list, ids: np.ndarray, lengths: np.ndarray) -> None:
        table = np.zeros(len(doc_ids), _DOC)
        table["known"] = [d is not None for d in doc_ids]
        table["id"] = [d or 0 for d in doc_ids]
        table["ids"] = lengths
        self.docs.append(table)
        self.n_ids += len(ids)
        self.n_docs += len(table)
        self.rest = np.concatenate([self.rest, ids.astype(np.uint64)])
        full = len(self.rest) // BLOCK * BLOCK
        for start in range(0, full, BLOCK):
            self._block(self.rest[start : start + BLOCK])
        self.rest = self.rest[full:]

    def close(self) -> None:
        if len(self.rest):
            self._block(self.rest)
        self._write(np.array(self.blocks, _BLOCK).tobytes())
        for table in self.docs:
            self._write(table.tobytes())
        self._write(struct.pack(_FOOT, MAGIC, self.n_docs, self.n_ids, len(self.blocks)))


def read_shard(file, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of the document table, their ids) by groups of documents, one block in memory at a time."""
    size -= struct.calcsize(_FOOT)
    magic, n_docs, _, n_blocks = struct.unpack(_FOOT, file.read_at(struct.calcsize(_FOOT), size))
    if magic != MAGIC:
        raise ValueError("not a shard of this format")
    tail = n_blocks * _BLOCK.itemsize + n_docs * _DOC.itemsize
    end = file.read_at(tail, size - tail)
    blocks = np.frombuffer(end, _BLOCK, n_blocks)
    docs = np.frombuffer(end, _DOC, n_docs, n_blocks * _BLOCK.itemsize)
    ends, done, held = np.cumsum(docs["ids"]), 0, np.empty(0, np.uint64)
    given = 0
    for offset, n, n_words, n_escapes in blocks.tolist():
        raw = np.frombuffer(file.read_at(8 * (n_words + n_escapes), offset), "<u8")
        held = np.concatenate([held, unpack(raw[:n_words], raw[n_words:], n)])
        upto = int(np.searchsorted(ends, given + len(held), "right"))
        if upto > done:
            use = int(ends[upto - 1]) - given
            yield docs[done:upto], held[:use]
            held, given, done = held[use:], given + use, upto
    if done < n_docs:
        yield docs[done:], held


def write_ids(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text and write the ids to shards under ``folder``, in ascending order of the id.

    Returns the table of shards (shard, path, n_docs, n_ids), itself written before the return. Rows
    are dealt by ranges of the id, so shard follows shard in that order, NULL ids first and equal ids
    by a digest of the text. A task writes a file of its own name and then reports it; a task that is run again
    writes another file, and only reported ones are part of the result. ``folder`` is a place that
    pyarrow and every executor can open.
    """
    content = Path(tokenizer_path).read_text()
    shards = pa.schema([("shard", pa.int32()), ("path", pa.string()), *((c, pa.int64()) for c in ("n_docs", "n_ids", "n_bytes"))])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = worker_memo(("encoder", hash(content)), lambda: PieceEncoder(content))
        system, root = pafs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        shard = TaskContext.get().partitionId()
        path = f"{root}/shard-{shard:06d}-{uuid.uuid4().hex}.s8b"
        writer = None
        for batch in pieces(batches):
            if writer is None:
                writer = ShardWriter(system.open_output_stream(path))
            ids, lengths = encoder.encode(batch.column(1))
            ids = np.insert(ids.astype(np.uint64), np.cumsum(lengths), np.uint64(end_id))
            writer.add(batch.column(0).to_pylist(), ids, lengths + 1)
        if writer is not None:
            writer.close()
            writer.out.close()
            row = [shard, path, writer.n_docs, writer.n_ids, writer.offset]
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, shards)], schema=shards)

    digest = F.xxhash64("text")
    ordered = (
        docs.select(F.col(id_col).cast("bigint").alias("id"), text_of(text_col).alias("text"))
        .repartitionByRange(F.col("id"), digest)
        .sortWithinPartitions(F.col("id"), digest, F.col("text"))
    )
    return kept(ordered.mapInArrow(encode, "shard int, path string, n_docs bigint, n_ids bigint, n_bytes bigint"), "shards", texts=True)


def read_ids(shards: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files of a table of shards.

    A shard's first place is the sum of the shards before it: a window over one row per shard.
    """
    spark = shards.sparkSession
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = shards.withColumn("first", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with system.open_input_file(path) as file:
                    for table, ids in read_shard(file, file.size()):
                        ends = np.cumsum(table["ids"])
                        starts = ends - table["ids"]
                        data = memoryview(ids.astype("<u4").tobytes())
                        crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(table["id"], pa.int64(), mask=~table["known"]),
                                pa.array(first + starts, pa.int64()),
                                pa.array(table["ids"], pa.int64()),
                                pa.array(crc, pa.int64()),
                            ],
                            ["doc_id", "start", "n_tokens", "ids_crc32"],
                        )
                        first += int(ends[-1])

    dealt = placed.select("path", "first").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return dealt.mapInArrow(decode, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    """Write the ids of all documents and read them back: (doc_id, start, n_tokens, ids_crc32).

    NULL texts count as empty: they hold the end id alone. Repeated rows are written as often as they
    come. An empty table gives no shard and no row; other columns are not looked at.
    """
    folder = fresh_path(docs.sparkSession, "token-ids")
    return read_ids(write_ids(docs, tokenizer_path, folder, end_id), folder)
