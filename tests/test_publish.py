"""Immutable datasets, set digests, rank selection and batches when one key holds most rows."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from siftlog.operators import dataset as ds, measure
from siftlog.sources import commits, sinks


def tree_digest(ids):
    """(depth, digest) of distinct ids, by recursion."""
    def node(members, level):
        if len(members) == 1:
            return 0, members[0]
        parts = {}
        for h in members:
            parts.setdefault(h[2 * level : 2 * level + 2], []).append(h)
        below = {byte: node(part, level + 1) for byte, part in parts.items()}
        if len(below) == 1:
            return next(iter(below.values()))
        text = "".join(f"{byte}={below[byte][1]}\n" for byte in sorted(below))
        return max(level + 1, *(d for d, _ in below.values())), hashlib.sha256(text.encode()).hexdigest()

    return node([hashlib.sha256(i.encode()).hexdigest() for i in ids], 0)


@pytest.mark.parametrize("n", [1, 2, 300, 4000])
def test_set_digest_does_not_depend_on_order_or_width(spark, n):
    ids = [f"rev-{k}" for k in range(n)]
    frame = spark.createDataFrame([(i,) for i in ids], "revision_id string").repartition(3)
    want = (n, *tree_digest(ids))
    for width in (None, 1, 3):
        assert tuple(ds.revision_digest(frame, width).first()) == want
    turned = spark.createDataFrame([(i,) for i in reversed(ids)], "revision_id string")
    assert tuple(ds.revision_digest(turned).first()) == want


def test_set_digest_of_no_ids_and_of_repeated_ids(spark):
    none = spark.createDataFrame([], "revision_id string")
    assert tuple(ds.revision_digest(none).first()) == (0, 0, hashlib.sha256(b"").hexdigest())
    assert ds.revision_digest(spark.createDataFrame([("a",), ("b",), ("a",)], "revision_id string")).first().revision_digest is None


def some_rows(spark, n=500):
    return spark.range(n).select(
        F.format_string("r%06d", "id").alias("revision_id"), F.concat(F.lit('{"n":'), F.col("id").cast("string"), F.lit("}")).alias("features_json"),
        F.array(F.lit("A")).alias("issue_codes"), F.when(F.col("id") % 3 != 0, F.lit("train")).alias("split"))


def test_publish_is_atomic_and_immutable(spark, tmp_path, monkeypatch):
    rows, root = some_rows(spark), str(tmp_path)
    digest = ds.revision_digest(rows).first()
    with pytest.raises(ValueError):
        ds.read_dataset(spark, root, "t", "d")

    def dies(*_):
        raise RuntimeError("died before the manifest")

    with monkeypatch.context() as m:
        m.setattr(ds, "_describe", dies)
        with pytest.raises(RuntimeError):
            ds.publish(rows, root, "t", "d", digest, file_bytes=50_000)
    assert ds.manifest_of(spark, root, "t", "d") is None and len(commits.folders(spark, f"{root}/tenant=t/dataset=d")) == 1

    manifest = [r.asDict() for r in ds.publish(rows, root, "t", "d", digest, file_bytes=50_000).collect()]
    base = tmp_path / "tenant=t" / "dataset=d"
    files = sorted(str(p.relative_to(base)) for p in base.glob("run=*/*.parquet"))
    assert len(files) > 2 and files == sorted(r["file"] for r in manifest) and sum(r["rows"] for r in manifest) == 500
    for r in manifest:
        body = (base / r["file"]).read_bytes()
        assert (hashlib.sha256(body).hexdigest(), len(body)) == (r["sha256"], r["size_bytes"])
        assert (r["digest_depth"], r["revision_sha256"], r["total_rows"]) == (digest.depth, digest.revision_digest, 500)

    again = [r.asDict() for r in ds.publish(rows.repartition(7), root, "t", "d", digest).collect()]
    assert sorted(map(str, again)) == sorted(map(str, manifest))
    with pytest.raises(ValueError, match="different rows"):
        ds.publish(rows.withColumn("split", F.lit("test")), root, "t", "d", digest)
    some_rows(spark, 3).write.parquet(f"{base}/run=stray")
    assert ds.read_dataset(spark, root, "t", "d").count() == 500
    victim = base / manifest[0]["file"]
    other = next(base / r["file"] for r in manifest if r["sha256"] != manifest[0]["sha256"])
    victim.write_bytes(other.read_bytes())
    (victim.parent / f".{victim.name}.crc").unlink(missing_ok=True)
    with pytest.raises(ValueError, match="differ from their manifest"):
        ds.publish(rows, root, "t", "d", digest)


def test_percentiles_of_a_group_with_most_rows(spark):
    draw = random.Random(3)
    rows = [("hot" if k % 10 else f"g{k % 4}", draw.choice([7, 7, 7, draw.randrange(5000)])) for k in range(8000)] + [("one", -3), ("none", None)]
    out = measure.latency_summary(spark.createDataFrame(rows, "g string, v bigint").repartition(6), "g", "v")
    got = {r.g: tuple(r)[1:] for r in out.collect()}
    want = {}
    for g in {g for g, v in rows if v is not None}:
        v = sorted(v for x, v in rows if x == g)
        want[g] = (len(v), v[0], v[-1], *(v[-(-len(v) * p // 100) - 1] for p in (50, 95, 99)))
    assert got == want
    assert "percentile" not in out._jdf.queryExecution().toString().lower()


def test_batches_of_a_hot_tenant_hour(spark):
    draw = random.Random(4)
    rows = [("hot" if k % 10 else "cold", 1_700_000_000_000_000_000 + draw.randrange(3600) * 10**9, f"r{k:05d}", "x" * draw.choice([10, 90, 700, 1500])) for k in range(3000)]
    frame = spark.createDataFrame(rows, "tenant_id string, received_at_ns bigint, revision_id string, envelope_json string").repartition(5)
    got = {r.revision_id: (r.tenant_id, r.batch_key) for r in sinks.assign_batches(frame, "c", 50, 2000).collect()}
    want = {}
    for tenant in ("hot", "cold"):
        total = 0
        for nth, (_, _, rid, text) in enumerate(sorted((r for r in rows if r[0] == tenant), key=lambda r: (r[1], r[2])), 1):
            big = len(text) > 1000
            want[rid] = (tenant, f"{(nth - 1) // 50}.{total // 1000}.{nth if big else 0}")
            total += 0 if big else len(text)
    assert got == want
