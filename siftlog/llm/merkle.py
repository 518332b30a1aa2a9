"""Merkle dataset manifest with incremental witnesses.

Leaves are digests of rows. Per tree (a source) they ascend by key; while more
than one node remains, runs of ARITY consecutive ones (the last may be shorter)
become the digest of their digests. The roots of all trees, ordered by tree, are
the leaves of one more tree, whose root is the manifest's.

Witnesses: nodes are appended in order. A new node's witness starts with the
siblings to its left; it belongs to the open subtree that holds the node, and
each later sibling that completes extends the witnesses of all that is under its
left siblings. Distribution: aligned blocks of ARITY ** LEVELS nodes are appended
in separate tasks; their roots are the nodes of the next round, until each tree
has one. On the way back a block is appended again, now with the witness of its
root, which every witness in it is continued by.

A witness is text: one level after the other, comma-separated, each with the
siblings in order and a dot in the place of the node itself.

Scale: ranks come from a range partitioning over (tree, key, digest), so a hot
tree spreads over tasks; a task holds one block at a time, and a round has 729
times fewer rows. The driver reads one number a round and one root.

Defined results: a null tree is a tree of its own and comes first, null keys
first, equal keys by their digest; equal rows are separate leaves. A lone leaf is
its tree's root. An empty table gives no rows. Long texts are hashed in the JVM
and travel no further.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from siftlog.llm.common import stored

ARITY, LEVELS = 3, 6
RANGE_ROWS = 1 << 20
DIGEST_BITS = 256


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts, one after the other."""
    return F.sha2(F.concat(*parts), DIGEST_BITS)


def leaf_digest(values: list[Column]) -> Column:
    """Digest of a row's values: `-` for null, else their UTF-8 byte count, `:` and the value."""
    texts = [v.cast("string") for v in values]
    return digest(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


class Appender:
    """Appends nodes to one block; open[level] is the run that is not complete, with the witnesses of all nodes under each subtree."""

    def __init__(self, levels: int = LEVELS):
        self.open: list[list[tuple[str, list[list[str]]]]] = [[] for _ in range(levels)]
        self.root: tuple[str, list[list[str]]] | None = None

    def append(self, node: str) -> list[str]:
        """Add a node; its witness goes on growing with what is appended later."""
        witness: list[str] = []
        self._add(0, node, [witness])
        return witness

    def _add(self, level: int, node: str, witnesses: list[list[str]]) -> None:
        if level == len(self.open):
            self.root = (node, witnesses)
            return
        run = self.open[level]
        start = "".join(d for d, _ in run) + "."
        for _, earlier in run:
            for w in earlier:
                w[-1] += node
        for w in witnesses:
            w.append(start)
        run.append((node, witnesses))
        if len(run) == ARITY:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        node = hashlib.sha256("".join(d for d, _ in run).encode()).hexdigest()
        self._add(level + 1, node, [w for _, below in run for w in below])

    def finish(self, alone: bool) -> str:
        """The block's root. One that is `alone` in its tree ends where one node remains, others at the height of a full block."""
        for level, run in enumerate(self.open):
            if alone and len(run) == 1 and self.root is None and not any(self.open[level + 1 :]):
                for w in run[0][1]:
                    w.pop()
                return run[0][0]
            if run:
                self._complete(level)
        assert self.root is not None
        return self.root[0]


def number_nodes(nodes: DataFrame) -> DataFrame:
    """(tree, digest, payload, rank, total) of (tree, key, digest, payload): rank from 0 in the tree, by key."""
    nodes = stored(nodes, "leaves")
    ranges = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-nodes.count() // RANGE_ROWS))
    placed = stored(
        nodes.repartitionByRange(ranges, "tree", "key", "digest").sortWithinPartitions("tree", "key", "digest")
        .withColumn("place", F.monotonically_increasing_id()).withColumn("part", F.shiftright("place", 33)), "placed")
    parts = placed.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    tree = Window.partitionBy("tree")
    offsets = stored(parts.select(
        F.col("tree").alias("t"), F.col("part").alias("p"),
        (F.sum("n").over(tree.orderBy("part")) - F.col("n") - F.col("first")).alias("shift"), F.sum("n").over(tree).alias("total")), "offsets")
    here = F.col("tree").eqNullSafe(F.col("t")) & (F.col("part") == F.col("p"))
    return placed.join(offsets, here).select("tree", "digest", "payload", (F.col("place") + F.col("shift")).alias("rank"), "total")


def _append_blocks(nodes: DataFrame, upper: DataFrame | None) -> DataFrame:
    """Append each block of (tree, digest, payload, rank, total).

    Without `upper` a row per block: (tree, digest, payload, rank, total) of its root. With it, (tree, block, witness, top) of the blocks'
    roots, a row per node: (tree, rank, digest, payload, witness, top).
    """
    width = ARITY**LEVELS
    payload = nodes.schema["payload"].dataType.simpleString()
    tree = nodes.schema["tree"].dataType.simpleString()
    rows = nodes.select("tree", F.floor(F.col("rank") / width).alias("block"), "rank", "total", "digest", "payload", F.lit(None).cast("string").alias("witness"), F.lit(None).cast("string").alias("top"))
    if upper is None:
        schema = T.StructType.fromDDL(f"tree {tree}, digest string, payload {payload}, rank bigint, total bigint")
    else:
        schema = T.StructType.fromDDL(f"tree {tree}, rank bigint, digest string, payload {payload}, witness string, top string")
        rows = rows.unionByName(upper.select(
            "tree", "block", F.lit(-1).cast("bigint").alias("rank"), F.lit(0).cast("bigint").alias("total"), F.lit("").alias("digest"),
            F.lit(None).cast(nodes.schema["payload"].dataType).alias("payload"), "witness", "top"))
    arrow, down = to_arrow_schema(schema), upper is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def closed(name: tuple, held: list, total: int, above: tuple) -> list[dict]:
            block = Appender()
            witnesses = [block.append(node) for _, node, _ in held]
            root = block.finish(alone=total <= width)
            if not down:
                return [{"tree": name[0], "digest": root, "payload": None, "rank": name[1], "total": -(-total // width)}]
            rest, top = above
            return [
                {"tree": name[0], "rank": rank, "digest": node, "payload": payload, "witness": ",".join(w + [rest] if rest else w), "top": top}
                for (rank, node, payload), w in zip(held, witnesses, strict=True)]

        now, held, size, above, out = None, [], 0, ("", None), []
        for batch in batches:
            for tree, block, rank, total, node, payload, witness, top in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (tree, block) != now:
                    if held:
                        out += closed(now, held, size, above)
                    now, held = (tree, block), []
                if rank < 0:
                    above = (witness, top)
                else:
                    held.append((rank, node, payload))
                    size = total
                if len(out) >= 4096:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)
                    out = []
        if held:
            out += closed(now, held, size, above)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "rank").mapInArrow(run, schema)


def grow(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The nodes of each round, numbered, and (tree, digest) of the roots."""
    rounds, roots = [stored(number_nodes(nodes), "nodes")], []
    while True:
        blocks = stored(_append_blocks(rounds[-1], None), "blocks")
        roots.append(blocks.filter("total = 1").select("tree", "digest"))
        more = blocks.filter("total > 1")
        if more.isEmpty():
            break
        rounds.append(more)
    out = roots[0]
    for r in roots[1:]:
        out = out.unionByName(r)
    return rounds, out


def witnesses(rounds: list[DataFrame], roots: DataFrame) -> DataFrame:
    """(tree, rank, digest, payload, witness, top) of every leaf; `roots` has (tree, witness, top) of the trees' roots."""
    tops = roots.select("tree", F.lit(0).cast("bigint").alias("block"), "witness", "top")
    width, upper = ARITY**LEVELS, None
    for k, nodes in reversed(list(enumerate(rounds))):
        # trees that end in this round are continued by their root, others by their block's node in the next one
        ended = nodes.filter(F.col("total") <= width).select(F.col("tree").alias("t")).distinct()
        here = tops.join(ended, F.col("tree").eqNullSafe(F.col("t")), "left_semi")
        upper = here if upper is None else here.unionByName(upper.select("tree", F.col("rank").alias("block"), "witness", "top"))
        upper = _append_blocks(nodes, upper)
        upper = stored(upper, "witnesses") if k else upper
    return upper


def build_manifest(leaves: DataFrame) -> DataFrame:
    """(tree, rank, digest, payload, witness, top, root) of leaves (tree, key, digest, payload): `top` is the tree's root, `root` the manifest's."""
    rounds, tops = grow(leaves)
    tops = stored(tops, "tops")
    nodes = tops.select(F.lit("").alias("tree"), F.col("tree").alias("key"), "digest", F.struct("tree", "digest").alias("payload"))
    above, root = grow(nodes)
    found = root.first()
    root = found["digest"] if found else None
    last = leaves.sparkSession.range(1).select(F.lit("").alias("tree"), F.lit("").alias("witness"), F.lit(root).cast("string").alias("top"))
    whole = stored(witnesses(above, last), "tops-witnesses")
    above_tops = whole.select(F.col("payload.tree").alias("tree"), "witness", F.col("payload.digest").alias("top"))
    return witnesses(rounds, above_tops).withColumn("root", F.lit(root).cast("string"))


def siblings(witness: Column) -> Column:
    """The digests of a witness, level by level, left to right."""
    return F.translate(witness, ".,", "")


def fold_witness(leaf: Column, witness: Column) -> Column:
    """The root that a leaf and its witness give."""
    levels = F.filter(F.split(witness, ","), lambda x: x != "")
    return F.aggregate(levels, leaf, lambda node, level: F.sha2(F.replace(level, F.lit("."), node), DIGEST_BITS))
