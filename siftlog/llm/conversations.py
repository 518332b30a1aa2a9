"""Conversation structure repair by depth-first branch-and-bound.

A row may be kept, reroled to the role that must follow, or deleted, and empty
turns may be inserted, so that the roles read `(s?(ua)+)?` by their initials.
Of the cheapest edits those with the ASCII-least audit (initials D, I, K, R)
win.

Search: layers are rows, nodes are (layer, state), and a state is what the kept
roles end with. An explicit stack takes prefixes depth first, cheapest move
first. A prefix goes when its cost and the least cost of all later layers (the
suffix lower bound) cannot beat the incumbent (cost, audit), or when the
dominance table of its node holds a cheaper or equally cheap, ASCII-smaller one.
The stack running empty proves the incumbent optimal.

Scale: rows are ordered by a range partitioning over (conversation, turn, role,
start of text), so a hot conversation spreads over tasks; repeated rows of a
turn are counted before that. A task cuts conversations into pieces of
at most `PIECE` rows. One that fits into a piece is solved there. Else each
piece gives, for every state it may begin with, the best edits to every state it
may end with; folding these tables, again `PIECE` at a time by the same search,
chooses the state at each cut. That leaves one small row for every PIECE rows
to go to the conversation's fold. Only `summarise` walks whole conversations:
its audit is one value, and holds one byte a row.

Defined results: null role or text is one space; null turns come first, rows
of a turn by role, then text. A null id is a conversation of its own. A row of
`copies` 0 is none, but names its conversation. Long texts stay whole, at most
PIECE of them in a task's memory at a time. Empty tables give no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import namedtuple
from collections.abc import Iterator
from math import inf

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from siftlog.llm.common import SPACES, stored

PIECE = 64
RANGE_BYTES = 64 << 20
BATCH_ROWS = 256

#: What the kept roles end with. A conversation may end with nothing or an assistant.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (NOTHING, ASSISTANT)
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)

Costs = namedtuple("Costs", "rerole delete insert truncated", defaults=(1, 2, 5, 5))

PIECE_FIELDS = (
    "blank bigint, duplicate bigint, truncated bigint, illegal bigint, first_turn bigint, last_turn bigint, turns bigint, "
    "first_role string, last_role string"
)
TURNS = "array<struct<role: string, text: string>>"


def wanted(state: int) -> tuple[str, int]:
    """The role that must come next, and the state after it."""
    return ("assistant", ASSISTANT) if state == USER else ("user", USER)


def row_moves(role: str, fault: int, copies: int, costs: Costs) -> list[list[tuple[int, str, int, str]]]:
    """For each state what may be done with a row: (cost, edits, next state, path). Copies after the first are duplicates."""
    if fault in (BLANK, DUPLICATE):
        return [[(costs.delete * copies, "D" * copies, state, "")] for state in range(4)]
    more, moves = "D" * (copies - 1), []
    extra, penalty = costs.delete * (copies - 1), costs.truncated * (fault == TRUNCATED)
    for state in range(4):
        name, after = wanted(state)
        kept = SYSTEM if role[:1] == "s" and state == NOTHING else after if role[:1] == name[0] else None
        here = [(costs.delete + extra, "D" + more, state, ""), (costs.rerole + penalty + extra, "R" + more, after, "")]
        if kept is not None:
            here.append((penalty + extra, "K" + more, kept, ""))
        moves.append(here)
    return moves


def suffix_bounds(layers: list, end: int, insert: int | None) -> list[list[float]]:
    """For each layer and state the least cost of all later layers with `end` after them, whatever the audit."""
    bounds = [[0.0 if state == end else inf for state in range(4)]]
    for moves in [None, *reversed(layers)]:
        after = bounds[-1]
        here = list(after) if moves is None else [min(c + after[s] for c, _, s, _ in moves[state]) for state in range(4)]
        for _ in range(3 if insert is not None else 0):
            here = [min(here[state], insert + here[wanted(state)[1]]) for state in range(4)]
        bounds[-1 if moves is None else len(bounds):] = [here]
    return bounds[::-1]


def search(layers: list, entry: int, ends: tuple[int, ...], insert: int | None) -> dict[int, tuple[int, str, str]]:
    """The best (cost, audit, path) from `entry` to each reachable end. `insert` is the cost of an inserted turn, if any."""
    bounds = {end: suffix_bounds(layers, end, insert) for end in ends}
    bounds = {end: b for end, b in bounds.items() if b[0][entry] < inf}
    best: dict[int, tuple[int, str, str]] = {}
    tables: list[dict] = [{} for _ in range(len(layers) + 1)]

    def hopeless(cost: int, audit: str, state: int, at: int) -> bool:
        """No completion beats the incumbent of any end."""
        for end, bound in bounds.items():
            if end not in best:
                return False
            c, a, _ = best[end]
            least = cost + bound[at][state]
            if least < c or least == c and audit <= a[: len(audit)]:
                return False
        return True

    stack = [(0, "", entry, "", 0)]
    while stack:
        cost, audit, state, path, at = stack.pop()
        known = tables[at].get(state)
        if known is not None and known <= (cost, audit) or hopeless(cost, audit, state, at):
            continue
        tables[at][state] = (cost, audit)
        if at == len(layers) and state in bounds and (state not in best or (cost, audit) < best[state][:2]):
            best[state] = (cost, audit, path)
        moves = [(cost + c, audit + e, s, path + p, at + 1) for c, e, s, p in layers[at][state]] if at < len(layers) else []
        if insert is not None:
            moves.append((cost + insert, audit + "I", wanted(state)[1], path, at))
        moves = [(min(m[0] + bound[m[4]][m[2]] for bound in bounds.values()), m[1], m) for m in moves]
        stack += [m for _, _, m in sorted(moves, reverse=True)]
    return best


def table_of(layers: list, insert: int | None) -> list[list[tuple[int, str, int, str]]]:
    """A piece as one layer: for each state it may begin with, the best edits to each state it may end with."""
    return [[(c, a, end, p) for end, (c, a, p) in search(layers, entry, range(4), insert).items()] for entry in range(4)]


def best_of(layers: list, insert: int | None) -> tuple[int, str, str]:
    """The best edits of a whole conversation."""
    return min(search(layers, NOTHING, ENDS, insert).values())


def fold(tables: list, piece: int) -> str:
    """The state after each piece, one digit each, of the best edits of all pieces."""
    layers = [[[(c, a, end, str(end)) for c, a, end, _ in here] for here in table] for table in tables]
    piece = max(2, piece)  # groups of one would never get fewer
    while len(layers) > piece:
        layers = [table_of(layers[k : k + piece], None) for k in range(0, len(layers), piece)]
    return best_of(layers, None)[2]


def apply_edits(rows: list, edits: str, state: int) -> list[tuple[str, str]]:
    """The turns that remain of (role, text, copies) rows."""
    out, at = [], 0
    for role, text, copies in [*rows, (None, None, 1)]:
        while at < len(edits) and edits[at] == "I":
            name, state = wanted(state)
            out.append((name, ""))
            at += 1
        if role is None:
            continue
        edit = edits[at]
        at += copies
        if edit == "K":
            state = SYSTEM if role[:1] == "s" else wanted(state)[1]
            out.append((role, text))
        elif edit == "R":
            name, state = wanted(state)
            out.append((name, text))
    return out


def piece_counts(rows: list) -> dict:
    """Counts of (turn, role, text, copies, fault) rows in order."""
    out = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "first_turn": None, "last_turn": None, "turns": 0, "first_role": None, "last_role": None}
    for turn, role, _, copies, fault in rows:
        if fault == BLANK:
            out["blank"] += copies
        else:
            out["duplicate"] += copies - (fault != DUPLICATE)
            out["truncated"] += fault == TRUNCATED
        out["illegal"] += copies - 1 + (out["last_role"] is not None and out["last_role"] + role[:1] not in ("su", "ua", "au"))
        if turn is not None and turn != out["last_turn"]:
            out["turns"] += 1
            out["last_turn"] = turn
            out["first_turn"] = turn if out["first_turn"] is None else out["first_turn"]
        out["first_role"] = role[:1] if out["first_role"] is None else out["first_role"]
        out["last_role"] = role[:1]
    return out


def joined_counts(a: dict, b: dict) -> dict:
    """Counts of two pieces, one after the other."""
    out = {name: a[name] + b[name] for name in ("blank", "duplicate", "truncated", "illegal", "turns")}
    both = a["last_role"] is not None and b["first_role"] is not None
    out["illegal"] += both and a["last_role"] + b["first_role"] not in ("su", "ua", "au")
    out["turns"] -= a["last_turn"] is not None and a["last_turn"] == b["first_turn"]
    for name in ("first_turn", "first_role"):
        out[name] = b[name] if a[name] is None else a[name]
    for name in ("last_turn", "last_role"):
        out[name] = a[name] if b[name] is None else b[name]
    return out


def _batches(rows: Iterator[dict], schema: pa.Schema, size: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def _rows(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names), strict=True)


def find_faults(turns: DataFrame) -> DataFrame:
    """(conv, turn, role, text, copies) rows, one for all equal ones, with the first fault of each."""
    rows = stored(turns.groupBy("conv", "turn", "role", "text").agg(F.sum("copies").alias("copies")), "turns")
    bare = F.rtrim("text", F.lit(SPACES))
    said = rows.filter((F.col("copies") > 0) & (bare != "")).select(
        "conv", "role", "turn", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit("second"), "text").alias("h2"))
    again = stored(
        said.groupBy("conv", "role", "h1", "h2").agg(F.min(F.struct("turn")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        .select(F.col("conv").alias("c"), F.col("role").alias("r"), "h1", "h2", "first"), "said-again")
    hashed = rows.withColumn("h1", F.xxhash64("text")).withColumn("h2", F.xxhash64(F.lit("second"), "text"))
    same = F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (hashed["h1"] == again["h1"]) & (hashed["h2"] == again["h2"])
    fault = (
        F.when(bare == "", BLANK).when(F.struct("turn") > F.col("first"), DUPLICATE)
        .when(~F.substring(bare, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(SOUND)
    )
    return hashed.join(again, same, "left").select("conv", "turn", "role", "text", "copies", fault.alias("fault"))


def _in_order(faulty: DataFrame) -> DataFrame:
    """Rows in ranges of (conversation, turn, role, text); the start of a long text is enough to place it."""
    rows = stored(faulty, "faults")
    size = rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    ranges = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    return (
        rows.repartitionByRange(ranges, "conv", "turn", F.substring("role", 1, 32), F.substring("text", 1, 32))
        .sortWithinPartitions("conv", "turn", "role", "text")
    )


def cut_pieces(faulty: DataFrame, costs: Costs, piece: int) -> DataFrame:
    """Pieces in order of (part, seq): whole conversations with their edits, pieces of others with their tables and rows."""
    conv = faulty.schema["conv"].dataType.simpleString()
    schema = T.StructType.fromDDL(
        f"conv {conv}, part int, seq bigint, whole boolean, {PIECE_FIELDS}, cost bigint, audit string, turns_left {TURNS}, "
        "moves array<array<struct<cost: bigint, audit: string, state: int>>>, rows array<struct<role: string, text: string, copies: bigint>>")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def result(seq: int, conv, rows: list, whole: bool) -> dict:
            layers = [row_moves(role, fault, copies, costs) for _, role, _, copies, fault in rows]
            bare = [(role, text, copies) for _, role, text, copies, _ in rows]
            out = {"conv": conv, "part": part, "seq": seq, "whole": whole} | piece_counts(rows)
            if whole:
                cost, audit, _ = best_of(layers, costs.insert)
                left = [{"role": r, "text": t} for r, t in apply_edits(bare, audit, NOTHING)]
                return out | {"cost": cost, "audit": audit, "turns_left": left}
            moves = [[{"cost": c, "audit": a, "state": s} for c, a, s, _ in here] for here in table_of(layers, costs.insert)]
            return out | {"moves": moves, "rows": [{"role": r, "text": t, "copies": n} for r, t, n in bare]}

        def pieces() -> Iterator[dict]:
            seq, now, held, whole = 0, None, None, False  # the first conversation may have begun in the range before
            for conv, turn, role, text, copies, fault in _rows(batches, ["conv", "turn", "role", "text", "copies", "fault"]):
                if held is None or conv != now:
                    if held is not None:
                        yield result(seq, now, held, whole)
                        seq, whole = seq + 1, True
                    now, held = conv, []
                if copies:
                    if len(held) == piece:
                        yield result(seq, now, held, False)
                        seq, held, whole = seq + 1, [], False
                    held.append((turn, role, text, copies, fault))
            if held is not None:  # the last one may go on in the next range
                yield result(seq, now, held, False)

        yield from _batches(pieces(), arrow)

    return _in_order(faulty).mapInArrow(run, schema)


def choose_states(cut: DataFrame, costs: Costs, piece: int) -> DataFrame:
    """(part, seq, entry, state): the states that pieces of conversations in several of them begin and end with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def chosen(places: list, tables: list) -> Iterator[dict]:
            entry = NOTHING
            for (part, seq), digit in zip(places, fold(tables, piece), strict=True):
                yield {"part": part, "seq": seq, "entry": entry, "state": int(digit)}
                entry = int(digit)

        def all_chosen() -> Iterator[dict]:
            now, places, tables = None, [], []
            for conv, part, seq, moves in _rows(batches, ["conv", "part", "seq", "moves"]):
                if places and conv != now:
                    yield from chosen(places, tables)
                    places, tables = [], []
                now = conv
                places.append((part, seq))
                tables.append([[(m["cost"], m["audit"], m["state"], "") for m in here] for here in moves])
            if places:
                yield from chosen(places, tables)

        yield from _batches(all_chosen(), pa.schema([("part", pa.int32()), ("seq", pa.int64()), ("entry", pa.int32()), ("state", pa.int32())]), 4096)

    pieces = cut.filter(~F.col("whole")).select("conv", "part", "seq", "moves")
    return pieces.repartition("conv").sortWithinPartitions("conv", "part", "seq").mapInArrow(run, "part int, seq bigint, entry int, state int")


def repair_conversations(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", copies: Column | None = None,
    costs: Costs = Costs(), piece: int = PIECE,
) -> DataFrame:
    """(conv, part, seq, whole, counts, cost, audit, turns_left): the repaired turns of each piece, in order of (part, seq)."""
    if costs.insert <= 0:
        raise ValueError("an inserted turn must cost something, or there is no end of them")
    blank = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    plain = turns.select(
        F.col(conv).alias("conv"), F.col(turn).cast("bigint").alias("turn"), blank(role).alias("role"), blank(text).alias("text"),
        (F.lit(1) if copies is None else copies).cast("bigint").alias("copies"))
    cut = stored(cut_pieces(find_faults(plain), costs, piece), "pieces")
    states = stored(choose_states(cut, costs, piece), "states")
    names = ["conv", "part", "seq", "whole", *(f.split()[0] for f in PIECE_FIELDS.split(", ")), "cost", "audit", "turns_left"]
    schema = T.StructType([cut.schema[n] for n in names])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                move = next(m for m in row["moves"][row["entry"]] if m["state"] == row["state"])
                left = apply_edits([(r["role"], r["text"], r["copies"]) for r in row["rows"]], move["audit"], row["entry"])
                row |= {"cost": move["cost"], "audit": move["audit"], "turns_left": [{"role": r, "text": t} for r, t in left]}
                yield pa.RecordBatch.from_pylist([{n: row[n] for n in names}], schema=arrow)

    mended = cut.filter(~F.col("whole")).join(states, ["part", "seq"]).select("conv", *[c for c in cut.columns if c != "conv"], "entry", "state")
    return cut.filter("whole").select(*names).unionByName(mended.mapInArrow(run, schema))


def summarise(pieces: DataFrame) -> DataFrame:
    """One row per conversation: its gaps, counts, cost, audit and the SHA-256 of its repaired `role:text` lines."""
    counts = ["blank", "duplicate", "truncated", "illegal"]
    lines = F.transform("turns_left", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns"), F.lit(0).cast("bigint"))
    whole = pieces.filter("whole").select("conv", gaps.alias("gaps"), *counts, "cost", "audit", F.sha2(F.array_join(lines, "\n"), 256).alias("repaired_sha256"))
    schema = whole.schema
    arrow = to_arrow_schema(schema)
    fields = [f.split()[0] for f in PIECE_FIELDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(conv, total: dict, cost: int, audit: list, digest) -> dict:
            gaps = total["last_turn"] - total["first_turn"] + 1 - total["turns"] if total["turns"] else 0
            return {"conv": conv, "gaps": gaps, "cost": cost, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()} | {n: total[n] for n in counts}

        def all_rows() -> Iterator[dict]:
            now, total = None, None
            for conv, cost, audit, left, *values in _rows(batches, ["conv", "cost", "audit", "turns_left", *fields]):
                here = dict(zip(fields, values, strict=True))
                if total is None or conv != now:
                    if total is not None:
                        yield row(now, total, spent, audits, digest)
                    now, total, spent, audits, digest, empty = conv, here, 0, [], hashlib.sha256(), True
                else:
                    total = joined_counts(total, here)
                spent += cost
                audits.append(audit)
                for t in left:
                    digest.update(f"{'' if empty else chr(10)}{t['role']}:{t['text']}".encode())
                    empty = False
            if total is not None:
                yield row(now, total, spent, audits, digest)

        yield from _batches(all_rows(), arrow)

    parts = pieces.filter(~F.col("whole")).repartition("conv").sortWithinPartitions("conv", "part", "seq")
    return whole.unionByName(parts.mapInArrow(run, schema))


def damage(turns: DataFrame) -> tuple[DataFrame, Column]:
    """Conversations with faults planted by crc32 of `conv_id:turn`, and the copies that are left of each row: none, one or two."""
    kind = F.crc32(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]).cast("binary")) % 20
    text, role = (F.coalesce(F.col(c), F.lit(" ")) for c in ("text", "role"))
    out = turns.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))
    return out, F.col("copies")
