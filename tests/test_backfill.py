"""A backfill that dies between its writes ends like one that does not."""

import pytest
from pyspark.sql import functions as F

from siftlog.plans import backfill, domain, registry  # noqa: F401  (registry loads the queries in order)
from siftlog.plans.q_search import backfill_inputs, installed_bundles
from siftlog.sources import commits

SF = "/root/testdata/sf0.001"


class Died(Exception):
    pass


def state(spark, root, jobs):
    settled = sorted((r.job_id, r.status, r.completed_revision_id, r.last_error_code) for r in backfill.current_jobs(root, jobs).collect())
    new = sorted((r.receipt_id, r.revision_id, r.status, r.envelope_json) for r in backfill.stored_revisions(spark, root).collect())
    return settled, new


@pytest.fixture(scope="module")
def inputs(spark):
    jobs, receipts = backfill_inputs(spark, SF)
    few = jobs.filter("cast(substring(job_id, 5) as bigint) < 60")
    return commits.stored(few, "jobs"), commits.stored(receipts.drop("fmt").drop(*[c for c in receipts.columns if c.startswith("f_")]), "receipts")


def run(root, name, inputs):
    return backfill.run_backfill(root, name, *inputs, installed_bundles(), F.timestamp_micros(F.lit(domain.NOW_US)))


def test_a_run_that_dies_anywhere_ends_the_same(spark, tmp_path, inputs, monkeypatch):
    whole, read = f"{tmp_path}/whole", backfill.read_evidence
    parsed = []

    def once(ready, bundles):  # detection and parsing are planned once for all runs of this test
        if not parsed:
            parsed.append(read(ready, bundles))
        return parsed[0].join(ready.select("job_id"), "job_id", "left_semi")

    monkeypatch.setattr(backfill, "read_evidence", once)
    run(whole, "r", inputs)
    want = state(spark, whole, inputs[0])
    codes = {code for _, _, _, code in want[0]}
    assert codes == {None, "RECEIPT_UNAVAILABLE", "BUNDLE_UNAVAILABLE", "EVIDENCE_UNAVAILABLE", "EVIDENCE_INTEGRITY", "BUNDLE_MISMATCH"}
    assert all((status == "COMPLETE") == (code is None) for _, status, _, code in want[0])
    write = commits.write_run
    for survives in range(4):
        left = [survives]

        def dying(rows, table, name):
            if not left[0]:
                write(rows, table, name)  # files without a marker
                commits.remove(spark, f"{table}/run={name}/{commits.MARKER}")
                raise Died
            left[0] -= 1
            write(rows, table, name)

        root = f"{tmp_path}/{survives}"
        monkeypatch.setattr(commits, "write_run", dying)
        with pytest.raises(Died):
            run(root, "r", inputs)
        monkeypatch.setattr(commits, "write_run", write)
        run(root, "r" if survives % 2 else "other", inputs)  # the same run again, or another one
        assert state(spark, root, inputs[0]) == want
