"""Harvests of paged providers: caps, stale pages, resume, manifests."""

import collections
import json
import os

import pytest
from pyspark.sql import functions as F

from oreweave.plans import harvest as H
from oreweave.sinks.ledger import Ledger
from oreweave.sources import jsonl


@pytest.fixture
def fetch(spark, tmp_path):
    spark.sparkContext.addPyFile(os.path.join(os.path.dirname(__file__), "offline_fetch.py"))
    log = tmp_path / "log"
    log.mkdir()

    def asked():
        return collections.Counter(n.rsplit("-", 1)[0] for n in os.listdir(log))

    return {"fetch": "offline_fetch:logged_works", "log": str(log)}, asked


def reasons(state):
    return {r["query"]: (r["pages"], r["taken"], r["reason"]) for r in state.collect()}


def test_queries_end_for_their_own_reasons(spark, tmp_path, fetch):
    options, asked = fetch
    harvest = H.Harvest(spark, str(tmp_path / "h"), ["a", "b", "broken", "empty", "same"], H.Limits(page_size=3, stale_pages=2))
    state = harvest.run(H.fetched_pages(options))
    assert reasons(state) == {
        "a": (4, 12, "last_page"), "b": (4, 12, "last_page"), "broken": (1, 3, "fetch_error"), "empty": (1, 0, "empty_page"), "same": (2, 0, "max_stale_pages"),
    }
    assert state.where("query = 'broken'").first()["error"] == "gone"
    assert set(asked().values()) == {1} and harvest.skipped() == 6
    works = harvest.works()
    assert works.count() == works.select("work_id").distinct().count() == 27
    assert {r["query"] for r in works.where("work_id like 'a-%'").select("query").distinct().collect()} == {"a"}


def test_caps(spark, tmp_path, fetch):
    options, asked = fetch
    capped = H.Harvest(spark, str(tmp_path / "c"), ["a", "b"], H.Limits(per_query=4, page_size=3), taken={"b": 4})
    assert reasons(capped.run(H.fetched_pages(options))) == {"a": (2, 4, "limit_per_query"), "b": (0, 4, "limit_per_query")}
    total = H.Harvest(spark, str(tmp_path / "t"), ["a", "b"], H.Limits(total=7, page_size=3))
    total.run(H.fetched_pages(options))
    assert sorted(r["work_id"] for r in total.works().collect()) == ["a-0", "a-1", "a-100", "a-2", "b-0", "b-1", "b-2"]
    paged = H.Harvest(spark, str(tmp_path / "p"), ["a"], H.Limits(pages=2, page_size=3))
    assert reasons(paged.run(H.fetched_pages(options))) == {"a": (2, 6, "max_pages_per_query")}


def test_a_stopped_harvest_fetches_no_page_twice(spark, tmp_path, fetch, monkeypatch):
    options, asked = fetch
    make = lambda: H.Harvest(spark, str(tmp_path / "h"), ["a", "b"], H.Limits(page_size=2))
    make().run(H.fetched_pages(options), max_rounds=1)
    assert asked() == {"a-0": 1, "b-0": 1}
    with monkeypatch.context() as m:  # the third round dies after its pages were written
        m.setattr(H.Harvest, "_new_works", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            make().run(H.fetched_pages(options))
    assert make().rounds() == 1 and asked() == {"a-0": 1, "b-0": 1, "a-1": 1, "b-1": 1}
    state = make().run(H.fetched_pages(options))
    assert reasons(state) == {"a": (4, 8, "last_page"), "b": (4, 8, "last_page")}
    assert set(asked().values()) == {1} and len(asked()) == 8
    make().run(H.fetched_pages(options))
    assert set(asked().values()) == {1}


def test_export_with_lookups_ledger_and_resume(spark, tmp_path, fetch):
    options, asked = fetch
    ledger, out = Ledger(spark, str(tmp_path / "ledger")), str(tmp_path / "out")
    args = dict(limits=H.Limits(page_size=2), lookup="offline_fetch:unpaywall")
    first = H.export_literature(spark, out, ["a", 'q"uote'], H.fetched_pages(options), max_rounds=2, ledger=ledger, **args)
    assert (first["status"], first["records_written"], first["run_id"]) == ("running", 8, None)
    done = H.export_literature(spark, out, ["a", 'q"uote'], H.fetched_pages(options), ledger=ledger, **args)
    assert (done["status"], done["records_written"], done["rounds"], done["unpaywall_checked"]) == ("completed", 16, 4, 16)
    assert set(asked().values()) == {1}
    lines = [json.loads(r["payload"]) for r in jsonl.json_lines(spark, f"{out}/records").collect()]
    assert len(lines) == 16 and {x["query"] for x in lines} == {"a", 'q"uote'}
    assert {x["openalex"]["id"]: bool(x["unpaywall"]) for x in lines}["a-1"] is False and sum(bool(x["unpaywall"]) for x in lines) == 15
    status = ledger.run_status(done["run_id"])
    assert status["document_texts"] == 16 and status["artifacts"] == 1 and status["run"]["status"] == "completed"
    assert json.loads(spark.read.text(f"{out}/manifest").first()[0])["records_written"] == 16

    again = H.export_literature(spark, str(tmp_path / "again"), ["a", "c"], H.fetched_pages(options), H.Limits(page_size=2, stale_pages=1, per_query=20), resume_from=[f"{out}/records"])
    assert {q["query"]: (q["pages"], q["taken"], q["reason"]) for q in again["queries"]} == {"a": (1, 8, "max_stale_pages"), "c": (4, 8, "last_page")}
    assert again["skipped_existing"] == 2


def test_degraded_export(spark, tmp_path, fetch):
    options, _ = fetch
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    done = H.export_literature(spark, str(tmp_path / "out"), ["broken"], H.fetched_pages(options), H.Limits(page_size=2), ledger=ledger)
    assert done["status"] == "completed_degraded" and ledger.run_status(done["run_id"])["run"]["status"] == "completed_degraded"


def test_offset_export_resumes(spark, tmp_path):
    spark.sparkContext.addPyFile(os.path.join(os.path.dirname(__file__), "offline_fetch.py"))
    ledger, out = Ledger(spark, str(tmp_path / "ledger")), str(tmp_path / "out")
    options = dict(fetch="offline_fetch:oqmd", offset="8", limit="2", page_size="2")
    kind = "formationenergy_id BIGINT"
    first = H.export_offsets(spark, out, options, kind, "formationenergy_id", ledger=ledger)
    assert (first["status"], first["records_written"], first["skipped_existing"], first["failed_pages"]) == ("completed", 2, 0, 0)
    second = H.export_offsets(spark, out, {**options, "limit": "4", "bad": "10"}, kind, "formationenergy_id", ledger=ledger)
    assert (second["status"], second["records_written"], second["skipped_existing"], second["failed_offsets"]) == ("completed_degraded", 1, 2, [10])
    assert ledger.run_status(second["run_id"])["run"]["status"] == "completed_degraded"
    keys = [json.loads(r["payload"])["formationenergy_id"] for r in jsonl.json_lines(spark, f"{out}/records").collect()]
    assert sorted(keys) == [8, 9, 11]


def test_research_reads_harvested_works_and_reports_a_relaxed_filter(spark, tmp_path, fetch):
    from oreweave.operators.research import EVIDENCE, harvested_web_search, run_research

    options, _ = fetch
    harvest = H.Harvest(spark, str(tmp_path / "h"), ["copper flotation", "b"], H.Limits(page_size=2, pages=1))
    harvest.run(H.fetched_pages(options))
    web = harvested_web_search(harvest.works())
    corpus = spark.createDataFrame([("ev:1", "text", "s", "txt", "f.txt", "0", 0.5, True)], ", ".join(f"{c} {'double' if c == 'relevance' else 'string'}" for c in EVIDENCE) + ", filter_relaxed boolean")
    result = run_research("copper flotation", lambda q: corpus, web=web, max_subqueries=1)
    assert len(result.warnings) == 1 and {c["source_type"] for c in result.citations} == {"txt", "openalex"}
    assert sum(c["source_type"] == "openalex" for c in result.citations) == 2 and "filter_relaxed" not in result.citations[0]
    plain = run_research("copper flotation", lambda q: corpus.drop("filter_relaxed"), max_subqueries=1)
    assert plain.warnings == [] and len(plain.citations) == 1
