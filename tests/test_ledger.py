"""The ledger's buckets and manifests, and incremental ingest."""

import os

import pytest
from pyspark.sql import functions as F

from oreweave.plans import pipeline as P
from oreweave.sinks.ledger import Ledger

CHUNKS = "id string, run_id string, source_file_id string, document_id string, chunk_index int, text string"


def chunk(file, index, text, run="r"):
    return (f"{file}:{index}", run, file, file, index, text)


@pytest.fixture
def ledger(spark, tmp_path):
    return Ledger(spark, str(tmp_path), bucket_rows=10)


def texts(ledger, run=None):
    return {(r["run_id"], r["id"]): r["text"] for r in ledger.read("document_chunks", run).collect()}


def many(spark, files, per_file=4, run="r"):
    rows = [chunk(f"f{k}", i, f"text {k} {i}", run) for k in range(files) for i in range(per_file)]
    return spark.createDataFrame(rows, CHUNKS)


def scope(spark, *files, run="r"):
    return spark.createDataFrame([(run, f) for f in files], "run_id string, source_file_id string")


def test_one_file_rewrites_one_bucket(spark, ledger):
    ledger.replace("document_chunks", many(spark, 20), scope(spark, *[f"f{k}" for k in range(20)]))
    before = ledger.manifest("document_chunks", "r")
    assert before["buckets"] == 8 and before["version"] == 1 and len(before["live"]) > 3
    ledger.replace("document_chunks", spark.createDataFrame([chunk("f3", 0, "new")], CHUNKS), scope(spark, "f3"))
    after = ledger.manifest("document_chunks", "r")
    moved = [b for b in before["live"] if before["live"][b] != after["live"].get(b)]
    assert len(moved) == 1 and after["version"] == 2
    found = texts(ledger)
    assert found["r", "f3:0"] == "new" and ("r", "f3:1") not in found and len(found) == 77


def test_a_job_that_dies_leaves_the_old_version(spark, ledger, monkeypatch):
    ledger.replace("document_chunks", many(spark, 6), scope(spark, *[f"f{k}" for k in range(6)]))
    old = texts(ledger)
    monkeypatch.setattr(Ledger, "_publish", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        ledger.replace("document_chunks", spark.createDataFrame([chunk("f3", 0, "new")], CHUNKS), scope(spark, "f3"))
    monkeypatch.undo()
    assert texts(ledger) == old
    ledger.replace("document_chunks", spark.createDataFrame([chunk("f3", 0, "new")], CHUNKS), scope(spark, "f3"))
    assert texts(ledger)["r", "f3:0"] == "new" and len(texts(ledger)) == 21


def test_readers_keep_their_version_until_vacuum(spark, ledger):
    ledger.replace("document_chunks", many(spark, 6), scope(spark, *[f"f{k}" for k in range(6)]))
    reading = ledger.read("document_chunks", "r")
    for n in range(3):
        ledger.replace("document_chunks", spark.createDataFrame([chunk("f3", 0, f"new {n}")], CHUNKS), scope(spark, "f3"))
    assert reading.where("source_file_id = 'f3'").count() == 4
    assert ledger.vacuum(keep=1) > 0 and ledger.versions("document_chunks", "r") == ["0000000004.json"]
    assert texts(ledger)["r", "f3:0"] == "new 2" and len(texts(ledger)) == 21 and ledger.vacuum(keep=1) == 0


def test_two_writers_of_a_run_do_not_overwrite_each_other(spark, ledger):
    ledger.replace("document_chunks", many(spark, 2), scope(spark, "f0", "f1"))
    stale = ledger.manifest("document_chunks", "r")
    ledger.replace("document_chunks", spark.createDataFrame([chunk("f0", 0, "first")], CHUNKS), scope(spark, "f0"))
    with pytest.raises(RuntimeError, match="another job"):
        ledger._publish("document_chunks", "r", stale)


def test_a_run_that_outgrows_its_buckets_is_dealt_anew(spark, ledger):
    sizes = []
    for part in range(8):
        rows = [chunk(f"p{part}f{k}", 0, "x") for k in range(15)]
        ledger.upsert("document_chunks", spark.createDataFrame(rows, CHUNKS))
        sizes.append(ledger.manifest("document_chunks", "r")["buckets"])
    assert sizes[0] == 2 and sizes[-1] > 2 and len(texts(ledger)) == 120


def test_upsert_replace_append_over_runs(spark, ledger):
    both = many(spark, 5, run="a").unionByName(many(spark, 9, run="b b/ü=1"))
    keys = ("run_id", "id")
    ledger.upsert("document_chunks", both, keys)
    ledger.upsert("document_chunks", spark.createDataFrame([chunk("f1", 2, "changed", "b b/ü=1")], CHUNKS), keys)
    assert len(texts(ledger, "a")) == 20 and len(texts(ledger)) == 56
    assert texts(ledger)["b b/ü=1", "f1:2"] == "changed" and sorted(ledger.run_ids("document_chunks")) == ["a", "b b/ü=1"]
    ledger.replace("document_chunks", spark.createDataFrame([], CHUNKS), scope(spark, *[f"f{k}" for k in range(5)], run="a"))
    assert not texts(ledger, "a") and ledger.manifest("document_chunks", "a")["live"] == {}
    calls = spark.createDataFrame([("c1", "a", "x"), ("c2", "a", "y")], "id string, run_id string, provider string")
    for _ in range(2):
        ledger.append("llm_calls", calls)
    assert ledger.read("llm_calls", "a").count() == 4
    assert max(len(c) for c in ledger.manifest("llm_calls", "a")["live"].values()) == 2


def test_replace_by_type_keeps_the_other_types(spark, ledger):
    kinds = "id string, run_id string, target_type string, target_id string"
    rows = [(f"{t}{k}", "r", t, str(k)) for t in ("chunk", "entity") for k in range(30)]
    ledger.replace_run("kg_embeddings", spark.createDataFrame(rows, kinds), "r")
    new = spark.createDataFrame([("chunk0", "r", "chunk", "again")], kinds)
    ledger.replace("kg_embeddings", new, new, keys=("run_id", "target_type"))
    found = ledger.read("kg_embeddings", "r").groupBy("target_type").count().collect()
    assert {r["target_type"]: r["count"] for r in found} == {"chunk": 1, "entity": 30}


def test_empty_writes(spark, ledger):
    none = spark.createDataFrame([], CHUNKS)
    ledger.upsert("document_chunks", none)
    ledger.append("document_chunks", none)
    ledger.replace("document_chunks", none, scope(spark))
    assert ledger.read("document_chunks").count() == 0 and ledger.read("document_chunks", "r").columns[0] == "id"
    ledger.replace_run("document_chunks", none, "r")
    assert ledger.read("document_chunks", "r").count() == 0
    with pytest.raises(KeyError):
        ledger.read("other")


# incremental ingest ----------------------------------------------------------------------------------


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


def held(ledger, run_id):
    names = {r["id"]: r["relative_path"] for r in ledger.read("source_files", run_id).collect()}
    return {names[r["source_file_id"]]: r["text"] for r in ledger.read("document_texts", run_id).collect()}


def buckets(ledger, table, run_id):
    return ledger.manifest(table, run_id)["live"]


def test_second_ingest_parses_nothing_and_a_change_is_replaced(spark, tmp_path, monkeypatch):
    root, ledger = tmp_path / "in", Ledger(spark, str(tmp_path / "ledger"))
    for k in range(4):
        write(root / f"sub{k % 2}" / f"{k}.txt", f"Introduction\nSteel number {k} was tested. " * 5)
    (root / "bad.docx").write_bytes(b"not a zip")
    run_id = P.ingest_folder(spark, ledger, str(root), "demo", ocr="off")
    taken = []
    own = P.ingest_files
    monkeypatch.setattr(P, "ingest_files", lambda ledger, run, files, *rest: (taken.append(sorted(r[0] for r in files.select("relative_path").collect())), own(ledger, run, files, *rest))[1])

    before = {t: ledger.versions(t, run_id) for t in ("document_texts", "document_chunks", "source_files")}
    assert P.drain_folder(spark, ledger, str(root), run_id, ocr="off") == [{"new": 0, "changed": 0, "unfinished": 0, "retry": 0, "gone": 0, "same": 5, "touched": 0}]
    assert taken == [] and before == {t: ledger.versions(t, run_id) for t in before}

    write(root / "sub0" / "2.txt", "Introduction\nA wholly new text about copper.")
    os.utime(root / "sub1" / "1.txt", (1, 1))  # another time, the same bytes
    write(root / "new.txt", "Introduction\nNickel came later.")
    os.remove(root / "sub1" / "3.txt")
    passes = P.drain_folder(spark, ledger, str(root), run_id, ocr="off")
    assert [(p["new"], p["changed"], p["touched"], p["gone"], p["same"]) for p in passes] == [(1, 1, 1, 1, 2), (0, 0, 0, 0, 6)]
    assert taken == [["new.txt", "sub0/2.txt"]]
    texts_ = held(ledger, run_id)
    assert sorted(texts_) == ["bad.docx", "new.txt", "sub0/0.txt", "sub0/2.txt", "sub1/1.txt"] and "copper" in texts_["sub0/2.txt"]
    chunks = {r["text"] for r in ledger.read("document_chunks", run_id).collect()}
    assert any("copper" in c for c in chunks) and not any("number 2" in c or "number 3" in c for c in chunks)
    states = {r["relative_path"]: r["status"] for r in ledger.read("source_files", run_id).collect()}
    assert states["sub1/3.txt"] == "missing" and set(states.values()) == {"missing", "extracted"}

    write(root / "sub1" / "3.txt", "Introduction\nIt came back.")
    assert P.refresh_folder(spark, ledger, str(root), run_id, ocr="off")["unfinished"] == 1
    assert "back" in held(ledger, run_id)["sub1/3.txt"]


def test_failed_files_are_tried_again_up_to_a_limit(spark, tmp_path):
    root, ledger = tmp_path / "in", Ledger(spark, str(tmp_path / "ledger"))
    write(root / "a.txt", "text")
    (root / "bad.docx").write_bytes(b"not a zip")
    run_id = P.ingest_folder(spark, ledger, str(root), ocr="off")
    passes = P.drain_folder(spark, ledger, str(root), run_id, ocr="off", max_attempts=3)
    assert [p["retry"] for p in passes] == [1, 1, 0]
    jobs = {(r["stage"], r["status"]): r["attempts"] for r in ledger.read("ingest_jobs", run_id).collect()}
    assert jobs["extract", "failed"] == 3 and jobs["extract", "completed"] == 1


def test_a_job_that_died_is_taken_up_again(spark, tmp_path, monkeypatch):
    root, ledger = tmp_path / "in", Ledger(spark, str(tmp_path / "ledger"))
    write(root / "a.txt", "first text")
    run_id = P.ingest_folder(spark, ledger, str(root), ocr="off")
    write(root / "a.txt", "second text, longer")
    monkeypatch.setattr(P, "chunk_run", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        P.refresh_folder(spark, ledger, str(root), run_id, ocr="off")
    monkeypatch.undo()
    assert P.refresh_folder(spark, ledger, str(root), run_id, ocr="off")["unfinished"] == 1
    assert [r["text"] for r in ledger.read("document_chunks", run_id).collect()] == ["second text, longer"]


def test_folder_as_a_stream(spark, tmp_path, monkeypatch):
    root, ledger, checkpoint = tmp_path / "in", Ledger(spark, str(tmp_path / "ledger")), str(tmp_path / "checkpoint")
    for k in range(3):
        write(root / f"{k}.txt", f"text {k}")
    run_id = ledger.create_run("stream", str(root))
    calls = []
    own = P.ingest_files
    monkeypatch.setattr(P, "ingest_files", lambda ledger, run, files, *rest: (calls.append(files.count()), own(ledger, run, files, *rest))[1])
    P.stream_folder(spark, ledger, str(root), run_id, checkpoint, ocr="off", max_files=2)
    assert calls == [2, 1] and sorted(held(ledger, run_id).values()) == ["text 0", "text 1", "text 2"]
    write(root / "sub" / "3.txt", "text 3")
    P.stream_folder(spark, ledger, str(root), run_id, checkpoint, ocr="off")
    assert calls == [2, 1, 1] and len(held(ledger, run_id)) == 4
    P.stream_folder(spark, ledger, str(root), run_id, str(tmp_path / "other"), ocr="off")  # a lost checkpoint
    assert calls == [2, 1, 1] and ledger.read("ingest_runs", run_id).first()["status"] == "completed"
