"""The seen IDs as tables of buckets: what a batch reads, merging, crashes, and the stream's use of it."""

import json
import random

import pytest
from pyspark.sql import functions as F

from coverlens import schema
from coverlens.plans.ingest import ingest_run
from coverlens.sources import files
from coverlens.sources.seen import SeenIds
from coverlens.streaming import incremental
from tests.conftest import rows


def ids(spark, values):
    return spark.createDataFrame([(v,) for v in values], "nct_id string")


def test_among_equals_a_join(spark, tmp_path):
    rng = random.Random(3)
    seen, held = SeenIds(spark, str(tmp_path / "s"), per_bucket=40, fan=3), {}
    for run in range(1, 8):
        held[run] = {f"N{rng.randrange(900)}" for _ in range(rng.randrange(1, 150))}
        seen.add(ids(spark, [*held[run], None, ""]), run)
    held[2] = {"N1", "N2", "other"}
    seen.add(ids(spark, held[2]), 2)  # repeated after it was merged
    batch = [f"N{i}" for i in range(0, 1200, 7)] + ["other", None, "", "N7"]
    for without in (None, 2, 5):
        known = set().union(*[x for run, x in held.items() if run != without])
        assert {r[0] for r in rows(seen.load(without))} == known
        assert sorted(r[0] for r in rows(seen.among(ids(spark, batch), without))) == sorted(known & set(filter(None, batch)))
    assert seen.add(ids(spark, ["new"])) == 8
    seen.reset()
    assert rows(seen.among(ids(spark, batch))) == [] and rows(seen.load()) == []


def test_runs_without_new_ids(spark, tmp_path):
    seen = SeenIds(spark, str(tmp_path / "s"), fan=2)
    for run, own in enumerate(([], ["A"], [], [], [None, ""]), 1):
        seen.add(spark.createDataFrame([(v,) for v in own], "nct_id string"), run)
        assert rows(seen.among(ids(spark, ["A", "B"]))) == ([("A",)] if run > 1 else [])
    assert seen.generations() == {"1", "2", "3", "4", "5"} and rows(seen.load()) == [("A",)]
    seen.add(spark.createDataFrame([], "nct_id string"), 2)
    assert rows(seen.load()) == []


def read_paths(df):
    return {f.split("/epoch=0/")[1].rsplit("/", 1)[0] for f in df.inputFiles() if "/epoch=0/" in f}


def test_a_batch_opens_only_buckets_that_may_hold_its_ids(spark, tmp_path):
    """A state a hundred times as large: as many folders are opened for the same batch, none for IDs that are new."""
    opened = {}
    for size in (2_000, 200_000):
        seen = SeenIds(spark, str(tmp_path / f"s{size}"), per_bucket=1000)
        seen.add(spark.range(size).select(F.concat(F.lit("N"), "id").alias("nct_id")))
        assert len(files.folders(spark, f"{seen.root}/epoch=0/{seen.tables()[0]['name']}/ids")) == (2 if size == 2_000 else 256)
        found = seen.among(ids(spark, ["N5", "N1999", "new1"]))
        opened[size] = read_paths(found)
        assert sorted(rows(found)) == [("N1999",), ("N5",)]
        fresh = seen.among(ids(spark, [f"fresh{i}" for i in range(20)]))
        assert len(read_paths(fresh)) <= 3
    assert all("bucket=" in p for paths in opened.values() for p in paths)
    assert len(opened[200_000]) <= 3


def test_tables_grow_with_the_logarithm_of_the_runs(spark, tmp_path):
    seen = SeenIds(spark, str(tmp_path / "s"), fan=2)
    for run in range(1, 14):
        seen.add(ids(spark, [f"N{run}"]), run)
        assert len(seen.tables()) == bin(run).count("1")
    assert len([f for f in files.folders(spark, f"{seen.root}/epoch=0") if f.startswith("table-")]) <= 2 * 4
    assert {r[0] for r in rows(seen.load())} == {f"N{i}" for i in range(1, 14)}


@pytest.mark.parametrize("broken", ["_write", "_publish"])
def test_a_crash_while_merging_loses_nothing(spark, tmp_path, monkeypatch, broken):
    seen = SeenIds(spark, str(tmp_path / "s"), fan=3)
    for run in (1, 2):
        seen.add(ids(spark, [f"N{run}"]), run)
    real, calls = getattr(SeenIds, broken), []

    def crash(self, epoch, *args):
        calls.append(args)
        if len(calls) == 2:  # the first call is the run's own table
            if broken == "_write":
                real(self, epoch, *args)  # the merged table is complete, and not yet named by a manifest
            raise RuntimeError("lost")
        return real(self, epoch, *args)

    monkeypatch.setattr(SeenIds, broken, crash)
    with pytest.raises(RuntimeError):
        seen.add(ids(spark, ["N3"]), 3)
    monkeypatch.undo()
    again = SeenIds(spark, str(tmp_path / "s"), fan=3)
    assert len(again.tables()) == 3 and {r[0] for r in rows(again.load())} == {"N1", "N2", "N3"}
    again.add(ids(spark, ["N3"]), 3)  # the run is repeated
    assert len(again.tables()) == 1 and {r[0] for r in rows(again.among(ids(spark, ["N1", "N3", "N9"])))} == {"N1", "N3"}


def test_manifests_are_whole_or_absent(spark, tmp_path):
    files.publish_text(spark, str(tmp_path / "m"), "t", "é 1")
    assert files.read_text(spark, str(tmp_path / "m" / "t")) == "é 1"
    with pytest.raises(FileExistsError):
        files.publish_text(spark, str(tmp_path / "m"), "t", "2")
    assert files.read_text(spark, str(tmp_path / "m" / "t")) == "é 1"


def studies(spark, names):
    empty = [None] * 7
    data = [(1, "f", i, n, True, *empty, []) for i, n in enumerate(names)]
    picked = [f.split(" ") for f in ("page_no bigint", "page_file string", "pos int")]
    return spark.createDataFrame(data, ", ".join(" ".join(p) for p in picked) + "," + schema.PICKED)


def test_a_stream_that_dies_between_output_and_ids_repeats_nothing(spark, tmp_path, monkeypatch):
    out = str(tmp_path / "out")
    incremental.add_batch(studies(spark, ["A", "B", "A"]), 0, out, "s1")
    monkeypatch.setattr(SeenIds, "add", lambda *a, **b: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        incremental.add_batch(studies(spark, ["B", "C"]), 1, out, "s1")
    monkeypatch.undo()
    # Another stream goes on: C has been emitted, though its ID was not yet in the set.
    incremental.add_batch(studies(spark, ["C", "D"]), 0, out, "s2")
    # The first one replays its batch.
    incremental.add_batch(studies(spark, ["B", "C"]), 1, out, "s1")
    emitted = sorted((r.nct_id, r.batch_id) for r in incremental.read_ingested(spark, out).collect())
    assert emitted == [("A", 0), ("B", 0), ("C", 1), ("D", 0)]


@pytest.fixture()
def broadcasts_fail(spark):
    """Any join that broadcasts a row fails, however few there are."""
    spark.conf.set("spark.sql.maxBroadcastTableSize", "1b")
    yield
    spark.conf.unset("spark.sql.maxBroadcastTableSize")


def test_a_stream_broadcasts_no_ids(spark, tmp_path, monkeypatch, broadcasts_fail):
    """Neither those of a batch nor seen ones, be they in one bucket or in several with filters: they would pass through the driver."""
    for per_bucket in (1000, 10):
        out = str(tmp_path / f"out{per_bucket}")
        monkeypatch.setattr(incremental, "_seen", lambda s, o, n=per_bucket: SeenIds(s, f"{o}/_seen", per_bucket=n))
        incremental.add_batch(studies(spark, [f"N{i}" for i in range(60)]), 0, out, "s1")
        assert [t["buckets"] for t in SeenIds(spark, f"{out}/_seen").tables()] == [1 if per_bucket == 1000 else 8]
        incremental.add_batch(studies(spark, [f"N{i}" for i in range(40, 90)]), 1, out, "s1")
        emitted = sorted((int(r.nct_id[1:]), r.batch_id) for r in incremental.read_ingested(spark, out).collect())
        assert emitted == [(i, int(i >= 60)) for i in range(90)]


def test_repeated_runs_broadcast_no_ids(spark, tmp_path, broadcasts_fail):
    landing, out = tmp_path / "landing", str(tmp_path / "out")
    landing.mkdir()
    for per_bucket in (1000, 10):
        seen = SeenIds(spark, str(tmp_path / f"seen{per_bucket}"), per_bucket=per_bucket)
        for run, numbers in ((1, range(60)), (2, range(40, 90))):
            status = {"overallStatus": "COMPLETED", "startDateStruct": {"date": "2012-03-04"}}
            page = [{"protocolSection": {"identificationModule": {"nctId": f"N{i}"}, "statusModule": status}} for i in numbers]
            (landing / f"page-{run}.json").write_text(json.dumps({"studies": page}))
            emitted = ingest_run(spark, str(landing), f"{out}{per_bucket}", seen, run)
            assert sorted(int(r.nct_id[1:]) for r in emitted.select("nct_id").collect()) == [i for i in numbers if run == 1 or i >= 60]
        assert max(t["buckets"] for t in seen.tables()) == (1 if per_bucket == 1000 else 8)
        (landing / "page-2.json").unlink()


def test_two_streams_keep_their_candidates_apart(spark, tmp_path, monkeypatch):
    """While one batch is between its candidates and its output, another stream's batch runs to its end."""
    out, inner = str(tmp_path / "out"), []
    real = incremental._index_emitted

    def interrupted(session, path, seen, but):
        if not inner:
            inner.append(1)
            incremental.add_batch(studies(spark, ["X"]), 0, out, "s2")
        real(session, path, seen, but)

    monkeypatch.setattr(incremental, "_index_emitted", interrupted)
    incremental.add_batch(studies(spark, ["A", "X"]), 0, out, "s1")
    assert sorted(r.nct_id for r in incremental.read_ingested(spark, out).collect()) == ["A", "X"]
