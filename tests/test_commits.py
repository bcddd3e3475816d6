"""One commit a load: faults at every step, repeated loads, readers, leftovers."""

import pytest
from pyspark.sql import functions as F

from parcelframe.sources import commits, ingest as ing


def _raw(spark, ids):
    return spark.createDataFrame([(i, "a") for i in ids], "MAILITM_FID string, `Bureau depot` string")


def _ids(spark, path, source=None):
    rows = ing.read_table(spark, path)
    return sorted(r.mailitm_fid for r in (rows.where(F.col("source") == source) if source else rows).collect())


class Stop(BaseException):
    """The process ends here: nothing after it runs."""


STEPS = ["manifest", "stage", "staged_sources", "commit", "_replace"]


def _load(spark, path, source, ids, batch):
    """One load of rows that need no cleaning."""
    rows = spark.createDataFrame([(i, source) for i in ids], "mailitm_fid string, source string").coalesce(1)
    ing.reload_table(rows, path, sources=[source], batch_id=batch, audit=lambda: [ing._audit(source, batch, len(ids), len(ids), "success", None)])


@pytest.mark.parametrize("when", ["before", "after"])
@pytest.mark.parametrize("step", STEPS)
def test_a_load_that_stops_anywhere(spark, tmp_path, monkeypatch, step, when):
    path = str(tmp_path / "t")
    _load(spark, path, "export", ["1", "2"], "b1")
    _load(spark, path, "import", ["9"], "b1")
    real = getattr(commits, step)

    def stop(*a, **k):
        if when == "after":
            real(*a, **k)
        raise Stop

    monkeypatch.setattr(commits, step, stop)
    with pytest.raises(Stop):
        _load(spark, path, "export", ["3", "4", "5"], "b2")
    monkeypatch.undo()
    done = when == "after" and step in ("commit", "_replace")
    assert _ids(spark, path, "export") == (["3", "4", "5"] if done else ["1", "2"]) and _ids(spark, path, "import") == ["9"]
    log = {(r.batch_id, r.source): r.rows_inserted for r in ing.audit_log(spark, path).collect()}
    assert log.get(("b2", "export")) == (3 if done else None)  # the audit goes with the rows
    for _ in range(2):  # however often it's repeated
        _load(spark, path, "export", ["3", "4", "5"], "b2")
    assert _ids(spark, path) == ["3", "4", "5", "9"]
    log = [(r.batch_id, r.source, r.rows_inserted, r.status) for r in ing.audit_log(spark, path).collect()]
    assert sorted(log) == [("b1", "export", 2, "success"), ("b1", "import", 1, "success"), ("b2", "export", 3, "success")]
    commits.vacuum(spark, path, keep=0)
    assert _ids(spark, path) == ["3", "4", "5", "9"] == sorted(r.mailitm_fid for r in spark.read.parquet(path).collect())


def test_a_task_that_fails_leaves_the_old_rows(spark, tmp_path):
    path, audit = str(tmp_path / "t"), str(tmp_path / "audit")
    ing.import_all(spark, {"export": _raw(spark, ["1"])}, path, "b1", audit)
    bad = _raw(spark, ["2", "3"]).withColumn("Bureau depot", F.when(F.col("MAILITM_FID") == "3", F.raise_error(F.lit("no"))).otherwise("x"))
    for _ in range(2):
        got = ing.import_all(spark, {"export": bad}, path, "b2", audit).first()
        assert got.status == "failed" and _ids(spark, path) == ["1"]
    assert sorted((r.batch_id, r.status) for r in spark.read.parquet(audit).collect()) == [("b1", "success"), ("b2", "failed")]
    assert sorted((r.batch_id, r.status) for r in ing.audit_log(spark, path).collect()) == [("b1", "success"), ("b2", "failed")]


def test_two_loads_from_one_manifest(spark, tmp_path):
    path = str(tmp_path / "t")
    _load(spark, path, "export", ["1"], "b1")
    base = commits.manifest(spark, path)
    commits.commit(spark, path, base, {"export": None}, None, [])
    with pytest.raises(commits.ConcurrentLoad):
        commits.commit(spark, path, base, {"export": "lost"}, None, [])
    assert _ids(spark, path) == [] and commits.manifest(spark, path)["number"] == 2


def test_readers_and_leftovers(spark, tmp_path):
    path = str(tmp_path / "t")
    for k in range(3):
        _load(spark, path, "export", [f"{k}a", f"{k}b"], f"b{k}")
    old = commits.read(spark, path, number=2)
    assert len(commits.vacuum(spark, path)) == 1 and sorted(r.mailitm_fid for r in old.collect()) == ["1a", "1b"]
    assert len(commits.vacuum(spark, path, keep=0)) == 1 and _ids(spark, path) == ["2a", "2b"]
    assert ing.read_table(spark, path).columns[-1] == "source" and "version" not in ing.read_table(spark, path).columns
    plan = ing.read_table(spark, path).where(F.col("source") == "export")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull" in plan or "PartitionFilters" in plan
