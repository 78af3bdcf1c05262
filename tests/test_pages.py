import bz2
import gzip
import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from coverlens import schema
from coverlens.plans.ingest import ingest, ingest_run
from coverlens.sources.pages import flatten_studies, read_pages, rejected, unreadable_pages
from coverlens.sources.seen import SeenIds
from coverlens.streaming.incremental import add_batch, read_ingested, run_incremental


def study(nct_id="N1", dmc=None, status="COMPLETED", start="2012-03-04", **more):
    modules = {
        "identificationModule": {"nctId": nct_id, "other": {"deep": 1}},
        "statusModule": {"overallStatus": status, "startDateStruct": {"date": start}},
    }
    if dmc is not None:
        modules["oversightModule"] = {"oversightHasDmc": dmc}
    modules.update(more)
    return {"protocolSection": modules, "hasResults": False}


def land(folder, number, studies, indent=None):
    folder.mkdir(parents=True, exist_ok=True)
    text = json.dumps({"studies": studies, "nextPageToken": f"t{number}"}, indent=indent)
    (folder / f"page-{number:05d}.json").write_text(text)


def test_flatten(spark, tmp_path):
    full = study(
        "N1",
        True,
        "Terminated",
        "2011-02",
        designModule={"studyType": "INTERVENTIONAL", "phases": ["PHASE2", "PHASE1"]},
        sponsorCollaboratorsModule={"leadSponsor": {"class": "INDUSTRY", "name": "x"}},
        conditionsModule={"conditions": ["Lung cancer", None]},
    )
    full["protocolSection"]["statusModule"]["whyStopped"] = 'said "no"\nand left'
    full["protocolSection"]["statusModule"]["primaryCompletionDateStruct"] = {"date": "2013"}
    loose = study("N2", "yes", designModule={"phases": "PHASE3"}, conditionsModule={"conditions": "Heart failure"})
    empty = study("N3", "true", None, None, designModule={"phases": []}, conditionsModule={"conditions": ""})
    bare = {"protocolSection": {"identificationModule": {"nctId": "N4"}}}
    dropped = [study(None), study(""), {}, {"protocolSection": {}}]
    land(tmp_path / "in", 1, [full, loose], indent=2)
    land(tmp_path / "in", 12, [*dropped, empty, bare])
    flat = flatten_studies(read_pages(spark, str(tmp_path / "in"))).orderBy(*schema.ARRIVAL)
    assert rows(flat.drop("page_file")) == [
        (1, 0, "N1", True, "Phase 1/Phase 2", "INTERVENTIONAL", "INDUSTRY", "TERMINATED", 'said "no"\nand left',
         "2011-02", "2013", ["Lung cancer", None], "Oncology", 2011),
        (1, 1, "N2", None, "Phase 3", None, None, "COMPLETED", None, "2012-03-04", None, ["Heart failure"],
         "Cardiovascular", 2012),
        (12, 4, "N3", True, None, None, None, None, None, None, None, [], "Other/Unclassified", None),
        (12, 5, "N4", None, None, None, None, None, None, None, None, [], "Other/Unclassified", None),
    ]


def test_page_cap_and_unreadable_pages(spark, tmp_path):
    for n in range(1, 5):
        land(tmp_path, n, [study(f"N{n}")])
    (tmp_path / "page-00009.json").write_text('{"studies": [ {bad')
    pages = read_pages(spark, str(tmp_path))
    assert ids(flatten_studies(pages)) == ["N1", "N2", "N3", "N4"]
    assert rows(unreadable_pages(pages).select("page_no", F.length("_corrupt_record"))) == [(9, 18)]
    assert ids(flatten_studies(read_pages(spark, str(tmp_path), max_pages=2))) == ["N1", "N2"]


def ids(df):
    return sorted(r[0] for r in df.select("nct_id").collect())


def test_missing_folder(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        read_pages(spark, str(tmp_path / "none"))


def test_first_arrival_wins_after_the_filters(spark, tmp_path):
    land(tmp_path, 1, [study("A", status="RECRUITING"), study("B", True), study("B", False), study("C", start="2009")])
    land(tmp_path, 2, [study("A", True), study("B", False), study("C", start=None), study("D", status="")])
    land(tmp_path, 10, [study("A", False), study("E", status="withdrawn", start="2025-12-31")])
    tidy = ingest(spark, str(tmp_path))
    assert sorted((r.nct_id, r.has_dmc) for r in tidy.collect()) == [("A", True), ("B", True), ("E", None)]
    seen = spark.createDataFrame([("A",), ("A",), ("Z",)], "nct_id string")
    assert ids(ingest(spark, str(tmp_path), seen=seen)) == ["B", "E"]
    assert ids(ingest(spark, str(tmp_path), start_from="2025-01-01")) == ["E"]
    assert ids(ingest(spark, str(tmp_path), statuses=["Recruiting"])) == ["A"]


def test_empty_result_keeps_its_columns(spark, tmp_path):
    land(tmp_path, 1, [])
    tidy = ingest(spark, str(tmp_path))
    assert tidy.columns == schema.TIDY_COLUMNS and tidy.count() == 0


def test_repeated_batch_runs(spark, tmp_path):
    landing, out = tmp_path / "landing", str(tmp_path / "out")
    seen = SeenIds(spark, str(tmp_path / "seen"))
    land(landing, 1, [study("A", True), study("B", status="RECRUITING")])
    assert ids(ingest_run(spark, str(landing), out, seen, 1)) == ["A"]
    land(landing, 2, [study("A", False), study("B", True)])
    for _ in range(2):  # the second time as a repetition after a failure
        assert ids(ingest_run(spark, str(landing), out, seen, 2)) == ["B"]
        assert ids(seen.load()) == ["A", "B"]
    assert ids(ingest_run(spark, str(landing), out, seen, 3)) == []


def emitted(df):
    return sorted((r.nct_id, r.has_dmc, r.batch_id) for r in df.collect())


def test_stream_adds_only_new_studies(spark, tmp_path):
    landing, out, checkpoint = (str(tmp_path / n) for n in ("landing", "out", "checkpoint"))
    land(tmp_path / "landing", 1, [study("A", True), study("B", status="RECRUITING"), study("A", False)])
    first = emitted(run_incremental(spark, landing, out, checkpoint))
    assert first == [("A", True, 0)]
    assert emitted(run_incremental(spark, landing, out, checkpoint)) == first  # nothing landed
    land(tmp_path / "landing", 2, [study("A", False), study("B", True)])
    second = emitted(run_incremental(spark, landing, out, checkpoint))
    assert second == [("A", True, 0), ("B", True, 1)]
    land(tmp_path / "landing", 3, [study("C"), study("B", False)])
    third = emitted(run_incremental(spark, landing, out, checkpoint))
    assert third == second + [("C", None, 2)]
    # A replay of batch 1 finds its own rows only in its own folder and writes them again.
    replay = flatten_studies(read_pages(spark, f"{landing}/page-00002.json")).where("has_dmc")
    add_batch(replay, 1, out, json.loads((tmp_path / "checkpoint" / "metadata").read_text())["id"].join(["s", ""]))
    assert emitted(read_ingested(spark, out)) == third


def test_many_batches_equal_one(spark, tmp_path):
    for n in range(1, 7):
        land(tmp_path / "landing", n, [study(f"S{(n * k) % 7}", n % 2 == 0) for k in range(1, 5)])
    landing = str(tmp_path / "landing")
    one = run_incremental(spark, landing, str(tmp_path / "one"), str(tmp_path / "c1"))
    many = run_incremental(spark, landing, str(tmp_path / "many"), str(tmp_path / "c2"), max_files_per_trigger=1)
    batch = ingest(spark, landing)
    assert ids(one) == ids(many) == ids(batch)
    assert {(r.nct_id, r.has_dmc) for r in one.collect()} == {(r.nct_id, r.has_dmc) for r in batch.collect()}
    assert many.select("batch_id").distinct().count() > 1


def test_a_new_checkpoint_repeats_and_loses_nothing(spark, tmp_path):
    landing, out = str(tmp_path / "landing"), str(tmp_path / "out")
    land(tmp_path / "landing", 1, [study("A", True)])
    run_incremental(spark, landing, out, str(tmp_path / "c1"))
    land(tmp_path / "landing", 2, [study("B", True)])
    run_incremental(spark, landing, out, str(tmp_path / "c1"))
    again = run_incremental(spark, landing, out, str(tmp_path / "c2"))
    assert emitted(again) == [("A", True, 0), ("B", True, 1)]


def test_an_old_run_is_repeated(spark, tmp_path):
    landing, out, seen = tmp_path / "landing", str(tmp_path / "out"), SeenIds(spark, str(tmp_path / "seen"))
    land(landing, 1, [study("A", True)])
    ingest_run(spark, str(landing), out, seen, 1)
    land(landing, 2, [study("B", True)])
    ingest_run(spark, str(landing), out, seen, 2)
    assert ids(ingest_run(spark, str(landing), out, seen, 1)) == ["A"]


def test_unreadable_pages_fail_or_are_kept(spark, tmp_path):
    land(tmp_path / "in", 1, [study("A")])
    (tmp_path / "in" / "page-00002.json").write_text('{"studies": [ {bad')
    with pytest.raises(Exception, match="cannot be read"):
        ingest(spark, str(tmp_path / "in")).count()
    assert ids(ingest(spark, str(tmp_path / "in"), rejects=str(tmp_path / "bad"))) == ["A"]
    assert [r.page_no for r in spark.read.parquet(str(tmp_path / "bad")).collect()] == [2]


def test_badly_typed_studies_cost_themselves(spark, tmp_path):
    bad = [study("B", designModule="x"), "text", [1], study({"a": 1}), study("C", sponsorCollaboratorsModule={"leadSponsor": ["y"]})]
    land(tmp_path / "in", 1, [study("A", True), *bad, None, study("D", designModule=None)])
    with pytest.raises(Exception, match="A study cannot be read: .*page-00001.json, place"):
        ingest(spark, str(tmp_path / "in")).count()
    assert ids(ingest(spark, str(tmp_path / "in"), rejects=str(tmp_path / "bad"))) == ["A", "D"]
    found = spark.read.parquet(str(tmp_path / "bad")).orderBy("pos")
    top = "protocolSection."
    assert rows(found.select("page_no", "pos", "faults")) == [
        (1, 1, [top + "designModule"]),
        (1, 2, ["study"]),
        (1, 3, ["study"]),
        (1, 4, [top + "identificationModule.nctId"]),
        (1, 5, [top + "sponsorCollaboratorsModule.leadSponsor"]),
    ]
    assert found.first().record.startswith('{"hasResults":false')
    landing, out = str(tmp_path / "in"), str(tmp_path / "out")
    emitted = run_incremental(spark, landing, out, str(tmp_path / "c"), skip_unreadable=True)
    assert ids(emitted) == ["A", "D"]


def test_rejects_and_studies_come_from_one_scan(spark, tmp_path):
    land(tmp_path / "in", 1, [study("A"), "text"])
    pages = read_pages(spark, str(tmp_path / "in"))
    tidy = ingest(spark, str(tmp_path / "in"), rejects=str(tmp_path / "bad"))
    assert not [f for f in tidy.inputFiles() if f.endswith(".json")]  # the pages are not read again
    assert ids(tidy) == ["A"]
    assert rows(spark.read.parquet(str(tmp_path / "bad"))) == rows(rejected(pages)) != []


def test_page_numbers(spark, tmp_path):
    for name, opener in (("page-00001.json.bz2", bz2.open), ("page-00002.json.gz", gzip.open)):
        with opener(tmp_path / name, "wt") as f:
            f.write(json.dumps({"studies": [study(name)]}))
    assert ids(flatten_studies(read_pages(spark, str(tmp_path), max_pages=1))) == ["page-00001.json.bz2"]
    (tmp_path / "unnumbered.json").write_text(json.dumps({"studies": [study("U")]}))
    assert len(ids(flatten_studies(read_pages(spark, str(tmp_path))))) == 3
    with pytest.raises(Exception, match="without a number"):
        read_pages(spark, str(tmp_path), max_pages=1).count()
    with pytest.raises(Exception, match="without a number"):
        read_pages(spark, str(tmp_path), max_pages=1, multi_line=False).count()
