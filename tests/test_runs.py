"""Runs that break and are started again, and state that counts a batch once."""

import threading
from collections import Counter

import pytest
from pyspark.sql import DataFrameWriter

from hashloom.plans import programs
from hashloom.plans.tables import decoded_apps
from hashloom.sources import sinks
from hashloom.sources.runs import Entries, Runs, UnitState
from hashloom.storage import materialize, scope, small_batches, usual_batches


def rows(df):
    return sorted(map(str, df.collect()))


def breaks_at(monkeypatch, nth):
    """From now on the nth write fails."""
    plain, seen = DataFrameWriter.parquet, []

    def write(self, path, *args, **kwargs):
        seen.append(path)
        if len(seen) == nth:
            raise OSError("the disk is full")
        return plain(self, path, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", write)


def test_parse_breaks_and_resumes(spark, sf_dir, tmp_path, monkeypatch):
    tables = decoded_apps(spark, sf_dir)
    for n, df in tables.items():
        df.write.parquet(f"{tmp_path}/in/{n}")
    programs.run(spark, "PARSE", f"{tmp_path}/in", f"{tmp_path}/whole")
    want = {n: rows(df) for n, df in sinks.read_profile(spark, f"{tmp_path}/whole").items()}
    with monkeypatch.context() as m, pytest.raises(OSError):
        tables_of = programs.parse({n: spark.read.parquet(f"{tmp_path}/in/{n}") for n in tables})
        breaks_at(m, 3)
        sinks.write_profile(tables_of, f"{tmp_path}/out", "first")
    assert sinks.read_profile(spark, f"{tmp_path}/out") == {}
    programs.run(spark, "PARSE", f"{tmp_path}/in", f"{tmp_path}/out", resume=True, run="second")
    for _ in range(2):  # again under its name, and again with nothing left to do
        assert {n: rows(df) for n, df in sinks.read_profile(spark, f"{tmp_path}/out").items()} == want
        programs.run(spark, "PARSE", f"{tmp_path}/in", f"{tmp_path}/out", run="second")
        programs.run(spark, "PARSE", f"{tmp_path}/in", f"{tmp_path}/out", resume=True)
    programs.run(spark, "PARSE", f"{tmp_path}/in", f"{tmp_path}/out")  # all apps anew: they take the place of the old ones
    assert {n: rows(df) for n, df in sinks.read_profile(spark, f"{tmp_path}/out").items()} == want
    assert "run=first" in Entries(spark, f"{tmp_path}/out").folders("apps")
    Runs(spark, f"{tmp_path}/out").clean()
    assert "run=first" not in Entries(spark, f"{tmp_path}/out").folders("apps")
    assert {n: rows(df) for n, df in sinks.read_profile(spark, f"{tmp_path}/out").items()} == want


def test_latest_rows_of_a_key(spark, tmp_path):
    found = lambda *r: spark.createDataFrame(r, "app_id string, unit_hash string, source_hash string")
    sinks.write_unit_hashes(found(("a", "1", "x"), ("a", "2", "x"), (None, "3", "x")), str(tmp_path), "one")
    sinks.write_unit_hashes(found(("a", "1", "y"), ("b", "1", "x"), (None, "3", "z")), str(tmp_path), "two")
    assert not sinks.write_unit_hashes(found(("a", "1", "w")), str(tmp_path), "two")
    assert sorted(tuple(map(str, r)) for r in sinks.read_unit_hashes(spark, str(tmp_path)).collect()) == [("None", "3", "z"), ("a", "1", "y"), ("a", "2", "x"), ("b", "1", "x")]
    assert sinks.read_provenance(spark, str(tmp_path / "none")) is None


def test_two_writers(spark, tmp_path):
    entries = Entries(spark, str(tmp_path))
    entries.add(0, {"a": 1})
    with pytest.raises(RuntimeError):
        entries.add(0, {"a": 2})
    assert entries.latest() == (0, {"a": 1})


def units(spark, n, step=1):
    return spark.createDataFrame([(f"app{i % 7}", f"u{i * step % 5}", f"t{i % 3}", f"[p{i % 3}]") for i in range(n)], "app_id string, unit_hash string, tree_hash string, tree string")


def state_of(state):
    return rows(state.apps()), rows(state.counts()), rows(state.trees())


def test_units_are_counted_once(spark, tmp_path, monkeypatch):
    state = UnitState(spark, str(tmp_path), buckets=3)
    assert state.add("one", units(spark, 20)) and state.add("two", units(spark, 11, 2))
    both = units(spark, 20).collect() + units(spark, 11, 2).collect()
    assert {(r.unit_hash, r.app_id): r.n for r in state.apps().collect()} == Counter((r.unit_hash, r.app_id) for r in both)
    assert {(r.unit_hash, r.tree_hash, r.tree): r.n for r in state.trees().collect()} == Counter((r.unit_hash, r.tree_hash, r.tree) for r in both)
    before = state_of(state)
    assert not state.add("two", units(spark, 11, 2)) and state_of(UnitState(spark, str(tmp_path))) == before
    with monkeypatch.context() as m:  # between the apps and the trees
        breaks_at(m, 2)
        with pytest.raises(OSError):
            state.add("three", units(spark, 9, 3))
    assert state_of(state) == before
    assert state.add("three", units(spark, 9, 3))
    after = state_of(state)
    assert len(state.counts().collect()) == 5 and sum(r.n for r in state.counts().collect()) == 40
    state.clean()
    assert state_of(state) == after
    assert state.add("none", units(spark, 9).limit(0)) and state_of(state) == after


def test_only_touched_buckets_are_written(spark, tmp_path):
    state = UnitState(spark, str(tmp_path), buckets=50)
    state.add("all", units(spark, 30))
    state.add("some", units(spark, 30).filter("unit_hash = 'u1'"))
    generation = state.entries.latest()[1]["generation"]
    assert sorted(generation.values()).count("some") == 1 and len(generation) > 1


def test_scopes_of_two_threads(spark):
    """The end of one thread's scope leaves the other's tables alone."""
    made, ended, found = threading.Event(), threading.Event(), []

    def first():
        with scope():
            df = materialize(spark.range(7).toDF("n"), "first")
            made.set()
            ended.wait(60)
            found.append(df.count())

    def second():
        made.wait(60)
        with scope():
            materialize(spark.range(3).toDF("n"), "second")
        ended.set()

    threads = [threading.Thread(target=f) for f in (first, second)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(90)
    assert found == [7]


def test_batches_can_be_set_back(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    small_batches(spark.range(1))
    assert spark.conf.get(key) == str(2 << 20)
    usual_batches(spark)
    assert spark.conf.get(key) == "67108864b"
