"""Repair of damaged conversations: faults, the cheapest edits by a run-length programme, and the repaired turns."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dipstick.llm.common import by_value, kept, worker_memo

by_value(__name__)

# What each edit costs, and what a truncated turn that is not deleted costs besides.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
# States of the order `(s?(ua)+)?`: nothing yet, after s, after u, after a. By state, the next state of each initial.
NEXT = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
ACCEPTING = (0, 3)
CLASSES = "sua"
# A symbol is twice the class of a turn's initial (3: no role of the order) plus one if truncated, or this.
MUST_GO = 8
FAR = 1 << 60
# Choices of runs up to this power of two are remembered; longer ones are put together from them.
REMEMBERED = 12
COUNTS = ["n_rows", "blank", "duplicate", "truncated", "illegal", "turns"]
SEGMENT = (
    "key string, seg int, " + ", ".join(f"{c} bigint" for c in COUNTS)
    + ", first_turn bigint, last_turn bigint, first_class int, last_class int, matrix array<bigint>, runs binary, audit string, cost bigint"
)
ANSWER = "key string, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"
Vector = tuple[int, int, int, int]


def remembered(f: Callable) -> Callable:
    """``f`` with its answers kept in the Python worker, which serves many tasks."""

    @wraps(f)
    def call(*key):
        store = worker_memo(("conversations", f.__name__), dict)
        if key not in store:
            if len(store) >= 1 << 16:
                store.clear()
            store[key] = f(*key)
        return store[key]

    return call


def insertion(state: int) -> str:
    """Initial of the only turn that may be inserted, or that a turn may be given, in ``state``."""
    return "a" if state == 2 else "u"


def edits(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """(initial, cost, next state) of the edits that take a turn away from the input, by initial."""
    found = [("D", DELETE, state)]
    if symbol != MUST_GO:
        own, more = symbol // 2, TRUNCATED * (symbol % 2)
        if own < 3 and CLASSES[own] in NEXT[state]:
            found.append(("K", KEEP + more, NEXT[state][CLASSES[own]]))
        found.append(("R", REROLE + more, NEXT[state][insertion(state)]))
    return found


def min_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum((a[:, :, None] + b[None, :, :]).min(axis=1), FAR)


def _insertions() -> np.ndarray:
    """Cheapest way from state to state by insertions alone."""
    paths = np.full((4, 4), FAR, np.int64)
    for start in range(4):
        state, cost = start, 0
        while paths[start, state] > cost:
            paths[start, state] = cost
            state, cost = NEXT[state][insertion(state)], cost + INSERT
    return paths


@remembered
def power(symbol: int, j: int) -> np.ndarray:
    """Min-plus transition of 2**j turns of one symbol: from the state before them to the state after them."""
    if j:
        return min_plus(power(symbol, j - 1), power(symbol, j - 1))
    one = np.full((4, 4), FAR, np.int64)
    for state in range(4):
        for _, cost, to in edits(symbol, state):
            one[state, to] = min(one[state, to], cost)
    return min_plus(_insertions(), one)


@remembered
def advance(symbol: int, length: int, after: Vector) -> tuple[int, Vector]:
    """Costs to finish before a run, from those after it, by the binary powers; least cost taken out."""
    costs, j = np.array(after, np.int64), 0
    while length >> j:
        if length >> j & 1:
            costs = (power(symbol, j) + costs[None, :]).min(axis=1)
        j += 1
    least = int(costs.min())
    return least, tuple((costs - least).tolist())


def choose(symbol: int, j: int, after: Vector, state: int) -> tuple[str, int]:
    """Initials of the cheapest edits of 2**j turns, least in ASCII, and the state they lead to."""
    return (_chosen if j <= REMEMBERED else _choose)(symbol, j, after, state)


def _choose(symbol: int, j: int, after: Vector, state: int) -> tuple[str, int]:
    if j:
        first, middle = choose(symbol, j - 1, advance(symbol, 1 << (j - 1), after)[1], state)
        second, last = choose(symbol, j - 1, after, middle)
        return first + second, last
    least, before = advance(symbol, 1, after)
    said = ""
    while True:
        found = [(letter, to) for letter, cost, to in edits(symbol, state) if cost + after[to] == least + before[state]]
        to = NEXT[state][insertion(state)]
        if INSERT + before[to] == before[state]:
            found.append(("I", to))
        letter, state = min(found)
        said += letter
        if letter != "I":
            return said, state


_chosen = remembered(_choose)
FINAL: Vector = (0, 10, 5, 0)  # what insertions cost after the last turn


def before_runs(runs: list[tuple[int, int]], after: Vector) -> tuple[int, list[Vector]]:
    """Cost taken out, and the costs to finish after each run and before the first (last entry)."""
    total, steps = 0, [after]
    for symbol, length in reversed(runs):
        more, after = advance(symbol, length, after)
        total += more
        steps.append(after)
    return total, steps


def unroll(runs: list[tuple[int, int]], steps: list[Vector], state: int) -> tuple[str, int]:
    """The edits' initials over the runs from ``state``, and the state after them."""
    said = []
    for at, (symbol, length) in enumerate(runs):
        after, left = steps[len(runs) - 1 - at], length
        while left:
            j = left.bit_length() - 1
            left -= 1 << j
            part, state = choose(symbol, j, advance(symbol, left, after)[1] if left else after, state)
            said.append(part)
    return "".join(said), state


def trailing(state: int) -> str:
    said = ""
    while state not in ACCEPTING:
        said, state = said + "I", NEXT[state][insertion(state)]
    return said


def _normal(costs: np.ndarray) -> tuple[int, Vector]:
    least = int(costs.min())
    return least, tuple((costs - least).tolist())


class Segment:
    """The turns of one conversation that a task sees: runs of equal symbols, and counts."""

    def __init__(self, key: str):
        self.key, self.runs = key, []
        self.counts = dict.fromkeys(COUNTS, 0)
        self.first_turn = self.last_turn = self.first_class = self.last_class = None

    def add(self, turn: int | None, own: int, blank: bool, cut: bool, repeated: bool, copies: int) -> None:
        """``copies`` equal turns; the first is a duplicate if ``repeated``, the others are."""
        c = self.counts
        if self.last_class is not None:
            c["illegal"] += not _legal(self.last_class, own)
        else:
            self.first_class = own
        c["illegal"] += copies - 1  # no role may follow itself
        self.last_class = own
        c["n_rows"] += copies
        if turn is not None and turn != self.last_turn:
            c["turns"] += 1
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        if blank:
            c["blank"] += copies
        else:
            c["duplicate"] += copies - 1 + repeated
            c["truncated"] += cut and not repeated
        if blank or repeated:
            self._run(MUST_GO, copies)
        else:
            self._run(2 * own + cut, 1)
            self._run(MUST_GO, copies - 1)

    def _run(self, symbol: int, length: int) -> None:
        if length and self.runs and self.runs[-1][0] == symbol:
            self.runs[-1] = (symbol, self.runs[-1][1] + length)
        elif length:
            self.runs.append((symbol, length))

    def row(self, seg: int, whole: bool) -> dict:
        found = {"key": self.key, "seg": seg, **self.counts, "matrix": None, "runs": None, "audit": None, "cost": None}
        found |= {c: getattr(self, c) for c in ("first_turn", "last_turn", "first_class", "last_class")}
        if whole:
            cost, steps = before_runs(self.runs, FINAL)
            said, state = unroll(self.runs, steps, 0)
            return found | {"cost": cost + steps[-1][0], "audit": said + trailing(state)}
        matrix = np.where(np.eye(4, dtype=bool), 0, FAR).astype(np.int64)
        for symbol, length in self.runs:
            for j in range(length.bit_length()):
                if length >> j & 1:
                    matrix = min_plus(matrix, power(symbol, j))
        return found | {"matrix": matrix.ravel().tolist(), "runs": np.array(self.runs, "<i8").tobytes()}


def _legal(a: int, b: int) -> bool:
    return (a, b) in ((0, 1), (1, 2), (2, 1))


def gaps(first: int | None, last: int | None, turns: int) -> int:
    return last - first + 1 - turns if turns else 0


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


_LONG, _INT, _TEXT = pa.int64(), pa.int32(), pa.string()


def _segment_schema() -> pa.Schema:
    kinds = {"key": _TEXT, "seg": _INT, **dict.fromkeys(COUNTS, _LONG), "first_turn": _LONG, "last_turn": _LONG, "first_class": _INT, "last_class": _INT}
    return pa.schema([*kinds.items(), ("matrix", pa.list_(_LONG)), ("runs", pa.binary()), ("audit", _TEXT), ("cost", _LONG)])


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns to conversations; the first and the last of a task may go on in another one and stay open."""
    seg, schema, out = TaskContext.get().partitionId(), _segment_schema(), []
    now, first = None, True
    for batch in batches:
        for key, turn, own, blank, cut, repeated, copies in zip(*(c.to_pylist() for c in batch.columns)):
            if now is None or key != now.key:
                if now is not None:
                    out.append(now.row(seg, not first))
                    first = False
                now = Segment(key)
            if copies:
                now.add(turn, own, blank, cut, repeated, copies)
        if out:
            yield _batch(out, schema)
            out = []
    if now is not None:
        yield _batch([now.row(seg, False)], schema)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, parts: seg and matrix in order) to the costs to finish after each part and before it."""
    schema = pa.schema([("key", _TEXT), ("seg", _INT), ("after", pa.list_(_LONG)), ("cost", _LONG)])
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            costs = np.array(FINAL, np.int64)
            for part in reversed(row["parts"]):
                after = costs.tolist()
                costs = (np.array(part["matrix"], np.int64).reshape(4, 4) + costs[None, :]).min(axis=1)
                out.append({"key": row["key"], "seg": part["seg"], "after": after, "cost": int(costs[0])})
        yield _batch(out, schema)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edits of an open part for each state it may be entered in, and the states they lead to."""
    schema = pa.schema([("key", _TEXT), ("seg", _INT), ("said", pa.list_(_TEXT)), ("leads", pa.list_(_INT))])
    for batch in batches:
        for at in range(batch.num_rows):
            key, seg, runs, after = (batch.column(i)[at].as_py() for i in range(4))
            runs = [tuple(r) for r in np.frombuffer(runs, "<i8").reshape(-1, 2).tolist()]
            _, steps = before_runs(runs, _normal(np.array(after, np.int64))[1])
            both = [unroll(runs, steps, state) for state in range(4)]
            yield _batch([{"key": key, "seg": seg, "said": [b[0] for b in both], "leads": [b[1] for b in both]}], schema)


_ANSWER = pa.schema([("key", _TEXT), *[(c, _LONG) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", _TEXT)])


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The parts of a conversation, in order, to its answer."""
    for batch in batches:
        out = []
        for at in range(batch.num_rows):
            key, parts = batch.column(0)[at].as_py(), batch.column(1)[at].as_py()
            total = {c: sum(p[c] for p in parts) for c in COUNTS}
            said, state, last_class, first_turn, last_turn = [], 0, None, None, None
            for p in parts:
                said.append(p["said"][state])
                state = p["leads"][state]
                if p["first_class"] is not None:
                    total["illegal"] += last_class is not None and not _legal(last_class, p["first_class"])
                    last_class = p["last_class"]
                if p["first_turn"] is not None:
                    total["turns"] -= p["first_turn"] == last_turn
                    first_turn = p["first_turn"] if first_turn is None else first_turn
                    last_turn = p["last_turn"]
            out.append(
                {"key": key, "gaps": gaps(first_turn, last_turn, total["turns"]), "cost": parts[0]["cost"], "audit": "".join(said) + trailing(state)}
                | {c: total[c] for c in ("blank", "duplicate", "truncated", "illegal")}
            )
        yield _batch(out, _ANSWER)


def damaged(conversations: DataFrame) -> DataFrame:
    """(key, turn, role, text, copies): the damage that ``crc32(conv_id:turn) % 20`` names; NULL texts and roles are one space.

    ``copies`` is 0 for a turn that is dropped and 2 for one that is repeated. ``key`` is NULL-safe.
    """
    space = F.lit(" ")
    number, turn, role, text = (F.col(f"`{c}`") for c in ("conv_id", "turn", "role", "text"))
    named = F.concat(F.coalesce(number.cast("string"), space), F.lit(":"), F.coalesce(turn.cast("string"), space))
    kind = F.crc32(named.cast("binary")) % 20
    plain = conversations.select(
        F.coalesce(F.concat(F.lit("#"), number.cast("string")), F.lit("")).alias("key"),
        turn.cast("bigint").alias("turn"), kind.alias("kind"),
        F.coalesce(role.cast("string"), space).alias("role"), F.coalesce(text.cast("string"), space).alias("text"),
    )
    changed = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return plain.select(
        "key", "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        changed.alias("text"),
        F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).alias("copies"),
    )


def _digest(text: str) -> Column:
    return F.unhex(F.md5(text))


def _place() -> Column:
    """A turn's place among those of its conversation: NULL first."""
    return F.struct(F.col("turn").isNotNull().alias("known"), "turn")


def _symbols(rows: DataFrame) -> DataFrame:
    """One row per different turn, in the order of conversations over all partitions, without texts.

    Equal turns are counted before their shuffle. The first place of a role and text is a combined
    minimum, joined back, so that a text which fills many turns of one conversation is split.
    """
    white = " \t\n\x0b\x0c\r"
    end = F.rtrim(F.col("text"), F.lit(white))
    light = rows.select(
        "key", "turn", "role", _digest("text").alias("digest"), (end == "").alias("blank"),
        (~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("cut"), "copies",
    )
    turns = light.groupBy("key", "turn", "role", "digest", "blank", "cut").agg(F.sum("copies").alias("copies"))
    names = [F.col(c).alias(f"_{c}") for c in ("key", "role", "digest")]
    seen = turns.where("copies > 0").groupBy(*names).agg(F.min(_place()).alias("first"))
    initial = F.substring("role", 1, 1)
    own = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    marked = turns.join(seen, F.expr("key = _key AND role = _role AND digest = _digest"), "left").select(
        "key", "turn", "role", "digest", own.alias("own"), "blank", "cut",
        F.coalesce(_place() != F.col("first"), F.lit(False)).alias("repeated"), "copies",
    )
    order = ["key", F.col("turn").asc_nulls_first(), "role", "digest"]
    return marked.repartitionByRange(*order).sortWithinPartitions(*order).select("key", "turn", "own", "blank", "cut", "repeated", "copies")


def audits(rows: DataFrame) -> DataFrame:
    """(key, gaps, blank, duplicate, truncated, illegal, cost, audit) of every conversation of ``damaged`` rows.

    Turns are sorted over all partitions, so a conversation of any length is many tasks. A task
    collapses equal neighbouring symbols to runs, and answers the conversations that lie inside it by
    one backward pass over runs (binary powers of the min-plus transitions) and one unrolling. Of one
    that crosses a border each part leaves a 4 x 4 matrix; from these come the costs to finish after
    each part, then every part is unrolled by itself, and the parts are chained.
    """
    found = kept(_symbols(rows).mapInArrow(_segments, SEGMENT), "turns")
    whole = found.where("audit IS NOT NULL").select(
        "key", F.when(F.col("turns") > 0, F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns")).otherwise(0).alias("gaps"),
        "blank", "duplicate", "truncated", "illegal", "cost", "audit",
    )
    opened = found.where("audit IS NULL").drop("audit", "cost")
    parts = opened.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("seg", "matrix"))).alias("parts"))
    ends = parts.mapInArrow(_ends, "key string, seg int, after array<bigint>, cost bigint")
    pieces = opened.join(ends, ["key", "seg"]).select("key", "seg", "runs", "after").mapInArrow(
        _pieces, "key string, seg int, said array<string>, leads array<int>"
    )
    about = opened.drop("matrix", "runs").join(ends.select("key", "seg", "cost"), ["key", "seg"]).join(pieces, ["key", "seg"])
    rest = [c for c in about.columns if c not in ("key", "seg")]
    chained = about.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("seg", *rest))).alias("parts")).mapInArrow(_chained, ANSWER)
    return whole.unionByName(chained)


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[tuple[str, str, str]]]]:
    """(answer, turns) of each conversation: its turns as (edit, role, text) must be read before the next one.

    Rows come sorted, and a conversation's answer before its turns; one turn is held at a time.
    """
    rows = (row for batch in batches for at in range(0, batch.num_rows, 200) for row in zip(*(c.to_pylist() for c in batch.slice(at, 200).columns)))
    ahead = [next(rows, None)]

    def turns(key: str, audit: str) -> Iterator[tuple[str, str, str]]:
        at, state = 0, 0

        def inserted() -> Iterator[tuple[str, str, str]]:
            nonlocal at, state
            while at < len(audit) and audit[at] == "I":
                initial = insertion(state)
                yield "I", "assistant" if initial == "a" else "user", ""
                at, state = at + 1, NEXT[state][initial]

        while ahead[0] is not None and ahead[0][0] == key:
            _, _, role, text, copies, *_ = ahead[0]
            for _ in range(copies):
                yield from inserted()
                edit, at = audit[at], at + 1
                if edit == "K":
                    state = NEXT[state][role[0]]
                    yield edit, role, text
                elif edit == "R":
                    initial = insertion(state)
                    state = NEXT[state][initial]
                    yield edit, "assistant" if initial == "a" else "user", text
                else:
                    yield edit, role, text
            ahead[0] = next(rows, None)
        yield from inserted()

    while ahead[0] is not None:
        key, *_, answer = ahead[0]
        ahead[0] = next(rows, None)
        yield (key, answer), turns(key, answer["audit"])


def _streamed(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Answers and turns of a conversation in one task, in order: the repaired text is one sequence."""
    answer = F.struct(*[c for c in found.columns if c != "key"])
    kind = found.select(answer.alias("answer")).schema["answer"].dataType
    nothing = F.lit(None)
    both = found.select(
        "key", nothing.cast("bigint").alias("turn"), nothing.cast("string").alias("role"), nothing.cast("string").alias("text"),
        F.lit(0).alias("copies"), nothing.cast("binary").alias("digest"), answer.alias("answer"),
    ).unionByName(rows.where("copies > 0").withColumns({"digest": _digest("text"), "answer": nothing.cast(kind)}))
    order = ["key", F.col("answer").isNull(), F.col("turn").asc_nulls_first(), "role", "digest"]
    return both.repartition("key").sortWithinPartitions(*order).drop("digest")


def _original(conversations: DataFrame) -> Column:
    """The id behind a key, in its own type."""
    kind = conversations.schema["conv_id"].dataType
    return F.when(F.col("key") != "", F.expr("substring(key, 2)")).cast(kind).alias("conv_id")


def repaired_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text): every conversation after the damage and its cheapest repair.

    ``edit`` is K, R, I or D; rows of deleted turns are there with the place of the turn that follows.
    """
    schema = pa.schema([("key", _TEXT), ("place", _LONG), ("edit", _TEXT), ("role", _TEXT), ("text", _TEXT)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for (key, _), turns in _edited(batches):
            place = 0
            for edit, role, text in turns:
                out.append({"key": key, "place": place, "edit": edit, "role": role, "text": text})
                place += edit != "D"
                if len(out) == 200:
                    yield _batch(out, schema)
                    out = []
        yield _batch(out, schema)

    rows = damaged(conversations)
    turns = _streamed(rows, audits(rows)).mapInArrow(work, "key string, place bigint, edit string, role string, text string")
    return turns.select(_original(conversations), "place", "edit", "role", "text")


def repair(conversations: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation.

    Turns stand by number, NULL first, those of one number by role and a digest of the text; repeated
    rows are duplicates of the first. NULL roles and texts are one space, NULL ids one conversation.
    Texts and roles are told apart by 128 bits of their digest. A conversation all of whose turns were
    dropped has zeros, an empty audit and the digest of nothing; an empty table gives no rows. Other
    columns are ignored. Texts pass one at a time: the digest of a conversation's repaired text is one
    sequence, so its texts go through one task, which holds one turn and the audit.
    """
    names = [f.name for f in _ANSWER][1:]
    schema = pa.schema([*_ANSWER, ("repaired_sha256", _TEXT)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for (key, answer), turns in _edited(batches):
            digest, between = hashlib.sha256(), b""
            for edit, role, text in turns:
                if edit != "D":
                    digest.update(between + f"{role}:{text}".encode())
                    between = b"\n"
            out.append({"key": key, **{c: answer[c] for c in names}, "repaired_sha256": digest.hexdigest()})
            if len(out) == 1000:
                yield _batch(out, schema)
                out = []
        yield _batch(out, schema)

    rows = damaged(conversations)
    told = _streamed(rows, audits(rows)).mapInArrow(work, ANSWER + ", repaired_sha256 string")
    return told.select(_original(conversations), *names[:5], "cost", "audit", "repaired_sha256")
