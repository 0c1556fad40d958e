"""Conversation repair against a plain search over all edits, and on odd and very long conversations."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from dipstick.llm import conversations, queries

FOLDER = "/root/testdata/sf0.01"
KIND = "conv_id bigint, turn bigint, role string, text string"
WHITE = "\t\n\x0b\x0c\r "


def plain_damage(rows):
    """(conv_id, turn, role, text) after the damage, in order."""
    out = []
    for conv, turn, role, text in rows:
        said = ":".join(" " if v is None else str(v) for v in (conv, turn))
        kind, role, text = zlib.crc32(said.encode()) % 20, " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    # Turns of one number stand by role and by the digest of the text.
    return sorted(out, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).digest()))


def plain_audit(symbols):
    """Cheapest edits, least in ASCII: Dijkstra over (rows taken, state) with the audit as tie break."""
    nxt = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
    heap, done = [(0, "", 0, 0, ())], set()
    while heap:
        cost, said, at, state, roles = heapq.heappop(heap)
        if at == len(symbols) and state in (0, 3):
            return cost, said, roles
        if (at, state) in done:
            continue
        done.add((at, state))
        for role in ("user", "assistant"):
            if role[0] in nxt[state]:
                heapq.heappush(heap, (cost + 5, said + "I", at, nxt[state][role[0]], (*roles, (None, role))))
        if at == len(symbols):
            continue
        role, fault = symbols[at]
        heapq.heappush(heap, (cost + 2, said + "D", at + 1, state, roles))
        if fault in ("blank", "duplicate"):
            continue
        more = 5 * (fault == "truncated")
        if role[:1] in nxt[state]:
            heapq.heappush(heap, (cost + more, said + "K", at + 1, nxt[state][role[0]], (*roles, (at, role))))
        for to in ("user", "assistant"):
            if to[0] in nxt[state]:
                heapq.heappush(heap, (cost + 1 + more, said + "R", at + 1, nxt[state][to[0]], (*roles, (at, to))))


def plain_repair(rows):
    out = []
    for conv in {r[0] for r in rows}:
        own, seen, symbols = plain_damage([r for r in rows if r[0] == conv]), set(), []
        for _, _, role, text in own:
            bare = text.rstrip(WHITE)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            symbols.append((role, fault))
        cost, audit, roles = plain_audit(symbols)
        turns = {r[1] for r in own if r[1] is not None}
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        said = "\n".join(f"{role}:{own[at][3] if at is not None else ''}" for at, role in roles)
        faults = [sum(f == x for _, f in symbols) for x in ("blank", "duplicate", "truncated")]
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out.append((conv, gaps, *faults, illegal, cost, audit, hashlib.sha256(said.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return sorted((tuple(r) for r in df.select(*names).collect()), key=str)


def table(spark, rows):
    return spark.createDataFrame(rows, KIND)


def odd_rows(seed, n=60, size=14):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "", "USER", None, "unknown", "sys"]
    texts = ["Yes.", "No!", "cut off", " ", "", None, "a. b", "\x0b\n", "long. " * 2000, "ok?\t", " "]
    return [(rng.choice([i, None, -i]) if i < 3 else i, rng.choice([None, t, t, t, t // 2]), rng.choice(roles[: rng.choice([2, 9])]), rng.choice(texts))
            for i in range(n) for t in range(rng.randint(1, size))]


def test_query_against_plain(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(queries.QUERIES["op12_conversation_repair"](spark, FOLDER)) == plain_repair(rows)


@pytest.mark.parametrize("seed", range(3))
def test_odd_rows_in_any_layout(spark, seed):
    rows = odd_rows(seed)
    want = plain_repair(rows)
    assert got(conversations.repair(table(spark, rows).repartition(5))) == want
    more = table(spark, rows).withColumns({c: F.lit("x") for c in ("key", "copies", "digest", "seg", "answer", "own")})
    assert got(conversations.repair(more)) == want


def test_none_and_all_dropped(spark):
    assert got(conversations.repair(table(spark, []))) == []
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    nothing = hashlib.sha256(b"").hexdigest()
    assert got(conversations.repair(table(spark, [(dropped, 0, "user", "Hi.")]))) == [(dropped, 0, 0, 0, 0, 0, 0, "", nothing)]


def test_a_conversation_over_many_tasks(spark):
    """One conversation holds most rows; its parts, cut by partitions, give what one pass gives."""
    rng = random.Random(7)
    rows = [(1, t // 2 if t % 9 == 0 else t, rng.choice(["user", "assistant"]), rng.choice(["Yes.", "cut", f"Text {t}.", f"More {t}"])) for t in range(3000)]
    rows += [(1, 5000, "user", "Same.")] * 500 + [(c, t, "user", "Hi there.") for c in range(2, 30) for t in range(3)]
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # small partitions stay as they are
    try:
        found = got(conversations.repair(table(spark, rows)))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert found == plain_repair(rows)


def test_runs_by_powers(spark):
    """A run's costs and choices by binary powers are those of single steps."""
    rng = random.Random(5)
    for _ in range(200):
        runs = [(rng.randrange(9), rng.choice([1, 2, 3, 7, 40, 300])) for _ in range(rng.randint(1, 5))]
        single = [(s, 1) for s, n in runs for _ in range(n)]
        cost, steps = conversations.before_runs(runs, conversations.FINAL)
        cost1, steps1 = conversations.before_runs(single, conversations.FINAL)
        assert (cost, steps[-1]) == (cost1, steps1[-1])
        for state in range(4):
            assert conversations.unroll(runs, steps, state) == conversations.unroll(single, steps1, state)


def test_repaired_turns_keep_the_order(spark):
    turns = conversations.repaired_turns(table(spark, odd_rows(9))).where("edit <> 'D'").orderBy("conv_id", "place").collect()
    by = {}
    for r in turns:
        by.setdefault(r.conv_id, []).append(r.role[0])
    assert by and all(re.fullmatch("(s?(ua)+)?", "".join(v)) for v in by.values())
