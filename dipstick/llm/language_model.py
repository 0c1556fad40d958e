"""Language-model scores: a unigram base and a log-bilinear model trained with noise contrast."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dipstick.llm.common import by_value, kept, pieces, text_of

by_value(__name__)

END = b""  # the token after a text's last word; no word is empty
ALPHA = 0.1
LN10 = math.log(10)


def tokens_of(text: bytes) -> list[bytes]:
    """Words of a text in UTF-8; lower case and white space of bytes are those of ASCII."""
    return [*text.lower().split(), END]


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return batch.column(1).cast(pa.binary()).to_pylist()


def held_out(doc_id) -> bool:
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 10 == 0


def _plain(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))


def word_counts(plain: DataFrame, flush: int = 500_000) -> DataFrame:
    """(word, n) over all training texts; a task adds up its own words before the shuffle."""
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out():
            for start in range(0, len(words := list(seen.items())), 50_000):
                part = words[start : start + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), schema)], schema=schema)

        for batch in pieces(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), _texts(batch)):
                if not held_out(doc_id):
                    seen.update(tokens_of(text))
            if len(seen) > flush:
                yield from out()
                seen.clear()
        yield from out()

    return plain.mapInArrow(count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


class LogBilinear:
    """P(word | two words before), code 0 standing for all words outside the vocabulary.

    The two context words' vectors, each from a table of its own position, add up to a prediction. A word
    belongs to a class of neighbouring ranks, and P(word) = P(class) * P(word | class); both factors are
    products of the prediction with the vectors of classes, or of the words of one class, normalised by a
    matrix product in blocks. So a token costs about twice the root of the vocabulary, whatever its size.
    Code 0 is a class of its own. Rows of ``out`` are the words, then the classes; the last column is the bias.
    """

    def __init__(self, dim: int, counts: np.ndarray):
        rng, self.size, self.dim = np.random.default_rng(7), len(counts), dim
        self.width = max(1, math.ceil(math.sqrt(self.size)))
        n_classes = 1 + math.ceil((self.size - 1) / self.width)
        self.starts = np.concatenate([[0], 1 + self.width * np.arange(n_classes - 1), [self.size]]).astype(np.int64)
        share = (counts + 1.0) / (counts + 1.0).sum()
        of_class = np.add.reduceat(share, self.starts[:-1])
        noise = np.concatenate([share / of_class[self.class_of(np.arange(self.size))], of_class])
        self.log_noise = np.log(noise).astype(np.float32)
        self.cum, self.class_cum = np.concatenate([[0], np.cumsum(share)]), np.cumsum(of_class)
        rows = self.size + n_classes
        self.parts = {
            "first": rng.normal(0, 0.1, (self.size, dim)).astype(np.float32),  # one word back
            "second": rng.normal(0, 0.1, (self.size, dim)).astype(np.float32),  # two words back
            "out": np.column_stack([rng.normal(0, 0.1, (rows, dim)), self.log_noise]).astype(np.float32),
        }

    def class_of(self, codes: np.ndarray) -> np.ndarray:
        return np.where(codes == 0, 0, 1 + (codes - 1) // self.width)

    def order(self, codes: np.ndarray) -> np.ndarray:
        """Order of codes, ties as they stand; two bytes are sorted by their digits."""
        return np.argsort(codes.astype(np.uint16) if len(self.log_noise) <= 1 << 16 else codes, kind="stable")

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts.values()])

    def load(self, flat: np.ndarray) -> "LogBilinear":
        at = 0
        for name, part in self.parts.items():
            self.parts[name] = flat[at : at + part.size].reshape(part.shape).astype(np.float32)
            at += part.size
        return self

    def predict(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        q = np.ones((len(one), self.dim + 1), np.float32)
        q[:, :-1] = self.parts["first"][one]
        q[:, :-1] += self.parts["second"][two]
        return q

    def train(self, batches: Iterator[tuple[np.ndarray, ...]], seed: int, rate: float = 0.05, noise: int = 16) -> float:
        """Noise-contrastive estimation of classes, and of words inside their class.

        Each token is told from ``noise`` classes, and from ``noise`` words of its class, drawn by frequency;
        tokens of a batch share these draws, so their scores are matrix products. Gradients hold only rows that
        a batch touches; steps are scaled by the running sum of a place's squares. A batch is (one back, two
        back, word, weight). Returns the weight seen.
        """
        rng, sums, seen = np.random.default_rng(seed), {k: np.ones_like(v) for k, v in self.parts.items()}, 0.0
        out, size, offset = self.parts["out"], self.size, np.float32(math.log(noise))

        def force(q, vectors, rows):  # minus the probability that noise is data
            return -1 / (1 + np.exp(np.clip(self.log_noise[rows] + offset - q @ vectors.T, -30, 30)))

        def pull(q, vectors, rows, weight):  # one minus the probability that data is data
            return weight / (1 + np.exp(np.clip(np.einsum("ij,ij->i", q, vectors) - self.log_noise[rows] - offset, -30, 30)))

        for one, two, word, weight in batches:
            order = self.order(word)
            one, two, word, weight = one[order], two[order], word[order], weight[order].astype(np.float32)
            seen += float(weight.sum(dtype=np.float64))
            q = self.predict(one, two)
            classes = self.class_of(word)
            runs = _runs(classes)
            present = classes[runs]

            rows = size + classes
            vectors = out[rows]
            some = pull(q, vectors, rows, weight)
            back = some[:, None] * vectors
            touched = [(size + present, np.stack([some[a:b] @ q[a:b] for a, b in zip(runs, [*runs[1:], len(word)])]))]
            drawn = size + np.minimum(np.searchsorted(self.class_cum, rng.random(noise)), len(self.class_cum) - 1)
            some = force(q, out[drawn], drawn) * weight[:, None]
            back += some @ out[drawn]
            touched.append((drawn, some.T @ q))

            low, high = self.starts[present], self.starts[present + 1]
            point = self.cum[low][:, None] + rng.random((len(present), noise)) * (self.cum[high] - self.cum[low])[:, None]
            drawn = np.clip(np.searchsorted(self.cum, point, "right") - 1, low[:, None], high[:, None] - 1)
            for start, end, c, picks in zip(runs, [*runs[1:], len(word)], present, drawn):
                if c:
                    vectors = out[picks]
                    some = force(q[start:end], vectors, picks) * weight[start:end, None]
                    back[start:end] += some @ vectors
                    touched.append((picks, some.T @ q[start:end]))
            inner = int(np.searchsorted(word, 1))
            if inner < len(word):
                q_in, w = q[inner:], word[inner:]
                vectors = out[w]
                some = pull(q_in, vectors, w, weight[inner:])
                back[inner:] += some[:, None] * vectors
                at = _runs(w)
                touched.append((w[at], np.add.reduceat(some[:, None] * q_in, at)))

            grads = {"first": (one, back[:, :-1]), "second": (two, back[:, :-1]), "out": tuple(np.concatenate(x) for x in zip(*touched))}
            for name, (rows, g) in grads.items():
                order = self.order(rows)
                at = _runs(rows[order])
                rows, g = rows[order][at], np.add.reduceat(g[order], at)
                total = sums[name][rows] + g * g
                sums[name][rows] = total
                self.parts[name][rows] += np.float32(rate) * g / np.sqrt(total)
        return seen

    def log_probs(self, one: np.ndarray, two: np.ndarray, word: np.ndarray, block: int = 1 << 15) -> np.ndarray:
        """Normalised log-probability of every token."""
        out, size, found = self.parts["out"], self.size, np.empty(len(word))
        for at in range(0, len(word), block):
            order = self.order(word[at : at + block]) + at
            q, w = self.predict(one[order], two[order]), word[order]
            classes = self.class_of(w)
            got = np.concatenate([_log_softmax_at(out[size:] @ q[a : a + 2048].T, classes[a : a + 2048]) for a in range(0, len(w), 2048)])
            runs = _runs(classes)
            for start, end in zip(runs, [*runs[1:], len(w)]):
                if c := classes[start]:
                    low, high = self.starts[c], self.starts[c + 1]
                    got[start:end] += _log_softmax_at(out[low:high] @ q[start:end].T, w[start:end] - low)
            found[order] = got
        return found


def _runs(ordered: np.ndarray) -> np.ndarray:
    """Where runs of equal values start."""
    return np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))


def _log_softmax_at(scores: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Log share of the named row in each column: sums run down the columns, next to each other in memory."""
    own = scores[row, np.arange(scores.shape[1])]
    top = scores.max(axis=0)
    scores -= top
    return own - top - np.log(np.exp(scores, out=scores).sum(axis=0))


def _contexts(codes: np.ndarray, lengths: np.ndarray, end: int):
    """(one back, two back) of every token; before a text's first word stands the end token."""
    one, two = np.empty_like(codes), np.empty_like(codes)
    one[1:], two[2:] = codes[:-1], codes[:-2]
    starts = np.cumsum(lengths) - lengths
    one[starts] = two[starts] = end
    second = starts[lengths > 1] + 1
    two[second] = end
    return one, two


def _added(parts: pa.Table) -> tuple[np.ndarray, float]:
    """Sum of models' blocks, in order of their numbers, so that a sum has the same digits in every run."""
    order = np.argsort(parts["number"].to_numpy(), kind="stable")
    blocks = parts["value"].to_pylist()
    total = np.zeros(len(blocks[0]) // 8)
    for i in order:
        total += np.frombuffer(blocks[i])
    return total, float(np.sort(parts["n"].to_numpy()).sum())


def train_model(
    texts: DataFrame, counts: np.ndarray, n_train: int, dim: int, rounds: int, slices: int, shard_tokens: int, batch_size: int = 1 << 15
) -> LogBilinear:
    """Trains on ``texts`` (codes binary), rows of 32-bit codes, all of them ``rounds`` times.

    Texts are dealt into shards of about ``shard_tokens`` tokens and these into ``slices``, by a hash of
    their codes alone: the partitioning of the input has no part in the result. Equal texts are one row with a weight,
    and a text with many copies is dealt over the shards. Shards train on a slice each from the same model; the mean
    of all shards, weighted by tokens and added up in two levels, starts the next slice. A task holds
    one shard's slice and one model; the driver holds one model, whose size goes with the vocabulary.
    """
    model = LogBilinear(dim, counts)
    n_shards = max(1, math.ceil(n_train / shard_tokens))
    n_parts = math.ceil(math.sqrt(n_shards))
    spread = F.least("copies", F.lit(n_shards))
    dealt = (
        texts.groupBy("codes").agg(F.count("*").alias("copies"))
        .select("codes", (F.col("copies") / spread).alias("weight"), F.xxhash64("codes").alias("mark"), F.explode(F.sequence(F.lit(0), spread.cast("int") - 1)).alias("copy"))
        .withColumn("shard", F.pmod(F.pmod("mark", F.lit(n_shards)) + F.col("copy"), F.lit(n_shards)).cast("int"))
        .withColumn("slice", F.pmod(F.xxhash64("mark"), F.lit(slices)).cast("int"))
    )
    dealt = kept(dealt, "training-codes")

    for turn in range(rounds * slices):
        state = model.flat()

        def work(key, group):
            own = LogBilinear(dim, counts).load(state)
            rows = sorted(zip(group["mark"].to_pylist(), group["codes"].to_pylist(), group["weight"].to_pylist()))

            def batches():
                held, n = [], 0
                for _, codes, weight in rows:
                    codes = np.frombuffer(codes, np.int32).astype(np.int64)
                    one, two = _contexts(codes, np.array([len(codes)]), 1)
                    for at in range(0, len(codes), batch_size):
                        cut = slice(at, at + batch_size)
                        held.append((one[cut], two[cut], codes[cut], np.full(len(codes[cut]), weight)))
                        n += len(codes[cut])
                        if n >= batch_size:
                            yield tuple(np.concatenate(x) for x in zip(*held))
                            held, n = [], 0
                if held:
                    yield tuple(np.concatenate(x) for x in zip(*held))

            shard = key[0].as_py()
            seen = own.train(batches(), seed=shard * 1000 + turn)
            flat = own.flat().astype(np.float64) * seen
            cuts = range(0, len(flat), 8192)
            return pa.table(
                [pa.array(list(range(len(cuts))), pa.int32()), pa.array([shard % n_parts] * len(cuts), pa.int32()), pa.array([shard] * len(cuts), pa.int32()),
                 pa.array([seen] * len(cuts)), pa.array([flat[a : a + 8192].tobytes() for a in cuts], pa.binary())],
                ["block", "part", "number", "n", "value"],
            )

        def add(key, group):
            total, n = _added(group)
            number = key[1].as_py() if len(key) > 1 else 0
            return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([number], pa.int32()), pa.array([n]), pa.array([total.tobytes()], pa.binary())], ["block", "number", "n", "value"])

        if slices > 1:
            chosen = dealt.where(F.col("slice") == turn % slices)
        else:
            chosen = dealt
        models = chosen.select("shard", "mark", "codes", "weight").groupBy("shard").applyInArrow(work, "block int, part int, number int, n double, value binary")
        schema = "block int, number int, n double, value binary"
        rows = models.groupBy("block", "part").applyInArrow(add, schema).groupBy("block").applyInArrow(add, schema).orderBy("block").collect()
        if rows:
            model.load(np.concatenate([np.frombuffer(bytes(r["value"])) / r["n"] for r in rows]))
    return model


def score(
    docs: DataFrame, vocabulary_size: int | None = None, dim: int = 24, rounds: int = 1, slices: int = 2, share: int = 8, shard_tokens: int = 1 << 22,
    common: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_own) of every row.

    ``base_score`` is the add-0.1 unigram log10 probability, ``score`` that of the log-bilinear model:
    its normalised probability of a word in the vocabulary, or of all other words together times the
    add-0.1 share of the word among these. ``n_own`` counts the tokens in the vocabulary. Both learn from all
    texts that are not held out, by the checksum of the id (NULL as empty text).

    The vocabulary is the words that occur at least sqrt(training tokens) / ``share`` times: it grows with
    the corpus, and has never more than ``share`` times that root. ``vocabulary_size`` sets its size instead.

    Texts are split into words twice: once to count these, once to write their codes, from which the model
    learns and scores. Counts of words that make up at least one in ``common`` training tokens travel to the tasks;
    there can be no more than ``common`` of them, whatever the input. All other words are looked up by a
    join on the word: every text's rarer words leave the task, meet the counts by word, and their
    sums return by row. So nothing without a bound is broadcast, no word is left out, and no word of the
    join is a hot key. Scores do not depend on the partitioning of the input.

    NULL and empty texts are one end token. Repeated rows are scored row by row; without training
    texts every token is unseen; an empty table gives no rows.
    """
    plain = _plain(docs, id_col, text_col)
    counted = kept(word_counts(plain), "word-counts")
    total = counted.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    n_train, n_types = int(total["n"] or 0), int(total["v"])
    top = [(bytes(r["word"]), int(r["n"])) for r in counted.where((F.col("n") * F.lit(common) >= n_train) | (F.col("word") == F.lit(END))).collect()]
    top.sort(key=lambda wn: (-wn[1], wn[0]))
    least = max(n_train / common, math.sqrt(n_train) / share)
    inner = [w for w, n in top if w != END and (n >= least or vocabulary_size is not None)]
    vocabulary = {END: 1} | {w: i + 2 for i, w in enumerate(inner[: None if vocabulary_size is None else vocabulary_size - 2])}
    table = dict(top)
    counts = np.zeros(len(vocabulary) + 1)
    for word, code in vocabulary.items():
        counts[code] = table.get(word, 0)
    counts[0] = n_train - counts.sum()
    others = n_types - sum(w in table for w in vocabulary)
    size = len(counts)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 36
        # A word's number here: the model's words first, then the other common ones, then 0 for the rest.
        place = {w: i for w, i in vocabulary.items()} | {w: size + i for i, (w, _) in enumerate(x for x in top if x[0] not in vocabulary)}
        known = np.zeros(size + len(top) + 1)
        for w, i in place.items():
            known[i] = table.get(w, 0)
        logs = np.log10(known + ALPHA)
        for batch in pieces(batches):
            ids, texts = batch.column(0).to_pylist(), [tokens_of(t) for t in _texts(batch)]
            lengths = np.fromiter(map(len, texts), np.int64, len(texts))
            words = list(chain.from_iterable(texts))
            at = np.fromiter(map(place.get, words, repeat(0)), np.int64, len(words))
            codes = np.where(at < size, at, 0).astype(np.int32)
            starts = np.cumsum(lengths) - lengths
            sums = [np.add.reduceat(x, starts) for x in (((at > 0) & (known[at] > 0)).astype(np.int64), np.where(at > 0, logs[at], 0), np.where(at >= size, logs[at], 0), (codes == 0).astype(np.int64))]
            missing = np.flatnonzero(at == 0)
            ends = np.searchsorted(missing, np.concatenate([starts, [len(at)]])).astype(np.int32)
            rare = pa.ListArray.from_arrays(pa.array(ends), pa.array([words[i] for i in missing.tolist()], pa.binary()))
            columns = [
                np.arange(number, number + len(ids)), [None if d is None else str(d) for d in ids], [held_out(d) for d in ids], lengths, *sums,
                [codes[a : a + n].tobytes() for a, n in zip(starts.tolist(), lengths.tolist())],
            ]
            number += len(ids)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, f.type) for c, f in zip(columns, coded_schema)), rare], schema=coded_schema)

    coded_schema = pa.schema(
        [("row", pa.int64()), ("doc_id", pa.string()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()),
         ("other", pa.float64()), ("n_other", pa.int64()), ("codes", pa.binary()), ("rare", pa.list_(pa.binary()))]
    )
    ddl = "row bigint, doc_id string, held_out boolean, n_tokens bigint, n_known bigint, base double, other double, n_other bigint, codes binary, rare array<binary>"
    coded = kept(plain.mapInArrow(encode, ddl), "codes")
    model = train_model(coded.where(~F.col("held_out")).select("codes"), counts, n_train, dim, rounds, slices, shard_tokens)
    flat = model.flat()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = LogBilinear(dim, counts).load(flat)
        for batch in pieces(batches, 200):
            lengths = batch.column("n_tokens").to_numpy()
            codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.int32).astype(np.int64)
            found = own.log_probs(*_contexts(codes, lengths, 1), codes) / LN10
            scores = np.add.reduceat(found, np.cumsum(lengths) - lengths)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores)], [*batch.schema.names[:-1], "own"])

    rows = coded.drop("rare").select("row", "doc_id", "held_out", "n_tokens", "n_known", "base", "other", "n_other", "codes")
    rows = rows.mapInArrow(work, "row bigint, doc_id string, held_out boolean, n_tokens bigint, n_known bigint, base double, other double, n_other bigint, own double")
    looked = coded.select("row", F.explode("rare").alias("word")).join(counted, "word", "left")
    found = looked.groupBy("row").agg(
        F.sum(F.log10(F.coalesce("n", F.lit(0)) + F.lit(ALPHA))).alias("more"),
        F.count("n").alias("more_known"),
    )
    more = F.coalesce("more", F.lit(0.0))
    whole = math.log10(n_train + ALPHA * (n_types + 1))
    rest = math.log10(max(counts[0], 0) + ALPHA * (others + 1))
    return rows.join(found, "row", "left").select(
        F.col("doc_id").cast(docs.schema[id_col].dataType).alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(n_train).cast("bigint").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * F.lit(whole)).alias("base_score"),
        (F.col("own") + F.col("other") + more - F.col("n_other") * F.lit(rest)).alias("score"),
        (F.col("n_tokens") - F.col("n_other")).alias("n_own"),
    )
