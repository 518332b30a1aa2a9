import hashlib
import heapq
import random
import zlib

import pytest

from siftlog.llm import conversations as c, queries
from tests.llm.cases import DATA

SPACE = " \t\n\x0b\f\r"


def faults_of(rows):
    """The first fault of each (turn, role, text) row, in order."""
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.rstrip(SPACE)
        out.append(c.BLANK if not bare else c.DUPLICATE if (role, text) in seen else c.TRUNCATED if bare[-1] not in ".!?" else c.SOUND)
        seen.add((role, text))
    return out


def cheapest(rows, costs, everything=False):
    """(cost, audit, repaired) by trying edits in order of (cost, audit); without `everything`, once from each (row, last role)."""
    faults, tried = faults_of(rows), set()
    heap = [(0, "", 0, "", ())]
    while heap:
        cost, audit, at, initials, left = heapq.heappop(heap)
        if initials[1:2] == "s" or len(initials) > 1 and initials[-2:] not in ("su", "ua", "au") or initials and initials[0] not in "su" or initials == "" and left:
            continue
        if not everything and (at, initials[-1:]) in tried:
            continue
        tried.add((at, initials[-1:]))
        if at == len(rows) and (initials == "" or initials[-1] == "a"):
            return cost, audit, "\n".join(left)
        for name in ("user", "assistant"):
            heapq.heappush(heap, (cost + costs.insert, audit + "I", at, initials + name[0], (*left, f"{name}:")))
        if at < len(rows):
            _, role, text = rows[at]
            heapq.heappush(heap, (cost + costs.delete, audit + "D", at + 1, initials, left))
            if faults[at] not in (c.BLANK, c.DUPLICATE):
                more = costs.truncated * (faults[at] == c.TRUNCATED)
                if role[:1] in ("s", "u", "a"):
                    heapq.heappush(heap, (cost + more, audit + "K", at + 1, initials + role[0], (*left, f"{role}:{text}")))
                for name in ("user", "assistant"):
                    heapq.heappush(heap, (cost + costs.rerole + more, audit + "R", at + 1, initials + name[0], (*left, f"{name}:{text}")))
    raise AssertionError


def expected(rows, costs=c.Costs()):
    turns = [t for t, _, _ in rows if t is not None]
    faults = faults_of(rows)
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    cost, audit, left = cheapest(rows, costs)
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count(c.BLANK), faults.count(c.DUPLICATE), faults.count(c.TRUNCATED),
        sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(left.encode()).hexdigest())


def damaged(rows):
    """Conversations after the planted damage: {conv_id: rows in order}."""
    out = {}
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        kept = out.setdefault(conv, [])
        if kind != 0:
            text = "" if kind == 1 else text.translate({ord(x): None for x in ".!?"}) if kind == 2 else text
            kept += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for kept in out.values():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    return out


def got(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def test_query_against_trying_everything(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    result = queries.op11_conversation_repair(spark, DATA)
    assert result.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert got(result) == {conv: expected(kept) for conv, kept in damaged(rows).items()}


def random_rows(draw, n):
    texts = ["Yes.", "No!", "why", "", " \t", "Yes.", None, "é?\n", "tail. x"]
    roles = ["user", "assistant", "user", "assistant", "system", None, "tool", "", "sage"]
    return [(draw.choice([1, 2, 3, 4, 5, 6, 7, None]), draw.choice([0, 1, 2, 3, 5, 9, None]), draw.choice(roles), draw.choice(texts)) for _ in range(n)]


@pytest.mark.parametrize("seed, piece", [(1, 64), (2, 2), (3, 1)])
def test_nulls_repeats_and_strange_roles(spark, seed, piece):
    rows = random_rows(random.Random(seed), 45)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, copies string, fault int").repartition(3)
    turns, copies = c.damage(df)
    assert got(c.summarise(c.repair_conversations(turns, copies=copies, piece=piece))) == {conv: expected(kept) for conv, kept in damaged(rows).items()}


@pytest.mark.parametrize("costs", [c.Costs(), c.Costs(insert=1, delete=3), c.Costs(rerole=3, delete=4, insert=2, truncated=1)])
def test_search_against_trying_everything(costs):
    draw = random.Random(costs.insert)
    for _ in range(60):
        rows = [(k, draw.choice(["user", "assistant", "system", "tool"]), draw.choice(["a.", "b.", "c", ""])) for k in range(draw.randrange(5))]
        layers = [c.row_moves(role, fault, 1, costs) for (_, role, _), fault in zip(rows, faults_of(rows))]
        cost, audit, left = cheapest(rows, costs, everything=True)
        assert (cost, audit, left) == cheapest(rows, costs)
        assert c.best_of(layers, costs.insert)[:2] == (cost, audit)
        assert "\n".join(f"{r}:{t}" for r, t in c.apply_edits([(r, t, 1) for _, r, t in rows], audit, c.NOTHING)) == left


def test_long_conversation_folds_to_the_same_edits(spark):
    draw = random.Random(5)
    one = [(7, k, draw.choice(["user", "assistant", "user", "assistant", "tool"]), draw.choice([f"text {k}.", f"cut {k}", "same."])) for k in range(900)]
    df = spark.createDataFrame(one + [(8, 0, "user", "hot.")] * 5000 + [(8, 1, "assistant", "yes.")], "conv_id bigint, turn bigint, role string, text string")
    run = lambda piece: got(c.summarise(c.repair_conversations(df, piece=piece)))
    small, large = run(4), run(4096)
    assert small == large and small[8][2] == 4999 and small[8][6] == "K" + "D" * 4999 + "K"
    faults = faults_of([r[1:] for r in one])
    assert large[7][5:7] == c.best_of([c.row_moves(r[2], f, 1, c.Costs()) for r, f in zip(one, faults)], 5)[:2]


def test_no_rows_dropped_rows_and_costless_inserts(spark):
    df = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert c.summarise(c.repair_conversations(df)).count() == 0
    from pyspark.sql import functions as F

    gone = spark.createDataFrame([(1, 0, "user", "a.")], df.schema)
    assert got(c.summarise(c.repair_conversations(gone, copies=F.lit(0)))) == {1: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    with pytest.raises(ValueError):
        c.repair_conversations(df, costs=c.Costs(insert=0))
