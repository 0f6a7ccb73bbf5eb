import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from oreweave import cli
from oreweave.operators import hypotheses as H
from oreweave.operators.research import (
    MockProvider, decompose, extractive_answer, noisy_json, run_research, web_evidence,
)
from oreweave.plans import pipeline as P
from oreweave.service import ResearchService
from oreweave.sinks import exports
from oreweave.sinks.ledger import Ledger, list_runs
from oreweave.sources import files as Src
from oreweave.sources import jsonl, office, providers, tei
from oreweave.streaming import incremental as S


def xlsx(rows):
    cells = []
    for number, row in enumerate(rows, 1):
        body = ""
        for i, value in enumerate(row):
            ref = f"{chr(65 + i)}{number}"
            if isinstance(value, str):
                body += f'<c r="{ref}" t="inlineStr"><is><t>{value}</t></is></c>'
            elif value is not None:
                body += f'<c r="{ref}"><v>{value}</v></c>'
        cells.append(f'<row r="{number}">{body}</row>')
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} {rel}><sheets><sheet name="S1" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{''.join(cells)}</sheetData></worksheet>")
    return out.getvalue()


def docx():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = (
        '<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Intro</w:t></w:r></w:p><w:p><w:r><w:t>Froth flotation of 316L.</w:t></w:r></w:p>'
        '<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:p><w:r><w:t>1</w:t></w:r></w:p></w:tc></w:tr></w:tbl>'
    )
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


BOOK = [
    [None, "Отвальные хвосты", 1000.0, 0.5, 700.0, 0.2, 90.0],
    [None, "+125 мкм", 12.0, 5.0, 620.0, 4.0, 20.0],
    [None, "-10", 30.0, 6.0, 80.0, 8.0, 40.0],
    [None, "Итого извлекаемый металл", None, 1.0, 33.0, 2.0, 11.0],
    [None, "Хвосты породные", 500.0, 0.4, 20.0, 0.1, 8.0],
    [None, "-71+45", 9.0, 2.0, 5.0, 1.0, 600.5],
    [None, "Итого не извлекаемый металл", None, 1.0, 3.0, 2.0, 1.0],
]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    (root / "sub").mkdir()
    (root / "notes.txt").write_text(
        "Introduction\n" + "316L stainless steel shows fatigue after selective laser melting, with porosity and austenite seen by xrd.\n" * 12
        + "Флотация и гидроциклон класса -71+45 мкм.\n", encoding="utf-8",
    )
    (root / "sub" / "paper.docx").write_bytes(docx())
    (root / "sub" / "КГМК.xlsx").write_bytes(xlsx(BOOK))
    (root / "bad.docx").write_bytes(b"not a zip")
    (root / "scan.pdf").write_bytes(b"%PDF-1.4 broken")
    (root / "photo.png").write_bytes(b"\x89PNG")
    return root


@pytest.fixture(scope="module")
def built(spark, folder, tmp_path_factory):
    ledger = Ledger(spark, str(tmp_path_factory.mktemp("ledger")))
    run_id = P.ingest_folder(spark, ledger, str(folder), "demo")
    counts = P.build_graph(ledger, run_id)
    return ledger, run_id, counts


def test_ingest(built):
    ledger, run_id, _ = built
    status = ledger.run_status(run_id)
    assert status["source_files"] == 6 and status["document_texts"] == 6 and status["structured_records"] == 7
    assert status["run"]["status"] == "completed_degraded"
    jobs = {(j["stage"], j["status"]): j["count"] for j in status["jobs"]}
    assert jobs == {("extract", "completed"): 5, ("extract", "failed"): 1, ("chunk_index", "completed"): 6}
    book = ledger.read("document_texts", run_id).where("title = 'КГМК.xlsx'").first()["text"]
    assert "КГМК Отвальные хвосты класс +125: Э28 620.0 т, Э29 20.0 т." in book.splitlines()
    files = {r["relative_path"] for r in ledger.read("source_files", run_id).collect()}
    assert "sub/paper.docx" in files
    assert status["entities"] > 0 and status["relations"] == 8


def test_records_carry_the_stream_down(built):
    ledger, run_id, _ = built
    kb = jsonl.knowledge_base(ledger, run_id)
    assert {(r["stream"], r["size_class"]) for r in kb["size_classes"].collect()} == {
        ("Отвальные хвосты", "+125"), ("Отвальные хвосты", "-10"), ("Хвосты породные", "-71+45")}
    assert {(r["stream"], r["extractable"]) for r in kb["extractability"].collect()} == {("Отвальные хвосты", True), ("Хвосты породные", False)}
    assert kb["summaries"].count() == 2 and kb["documents"].count() == 6


def test_graph_build(built):
    ledger, run_id, counts = built
    assert counts["entities"] >= 4 and counts["relations"] >= 3 and counts["sections"] >= 3
    assert counts["embeddings"] == 6 + ledger.read("document_chunks", run_id).count() + counts["entities"]
    names = {(r["subject_name"], r["predicate"]) for r in P.named_relations(ledger, run_id).collect()}
    assert ("316L", "has_property") in names and ("316L", "belongs_to_class") in names
    assert counts["nodes"] > 0 and counts["edges"] > 0
    evidence, hits = P.search_graph(ledger, "316L fatigue porosity")
    assert evidence.count() >= 1 and evidence.first()["relevance"] <= 1.0 and hits.count() >= 1


def test_stages_and_reruns(built):
    ledger, run_id, counts = built
    with pytest.raises(ValueError):
        P.parse_stages("sections,other")
    again = P.build_graph(ledger, run_id, ["sections", "entities"])
    assert again["entities"] == counts["entities"] and again["sections"] == counts["sections"]
    assert P.build_all(ledger, dry_run=True) == {run_id: "planned"}


def test_retrieval_modes(built):
    ledger, run_id, _ = built
    for mode in ("kg", "collections", "tfidf", "auto"):
        hits = P.retriever(ledger, run_id, mode).retrieve("316L stainless steel fatigue", 4).collect()
        assert hits and all(0.0 <= h["relevance"] <= 1.0 for h in hits)
    with pytest.raises(ValueError):
        P.retriever(ledger, run_id, "other")


def test_hypothesis_run_and_exports(built, tmp_path, spark):
    ledger, run_id, _ = built
    settings = P.PipelineInput("Снизить потери на 5%", run_id)
    result = P.run_pipeline(ledger, settings)
    ranked = result["ranked"].collect()
    generators = {r["generator"] for r in ranked}
    assert {"numeric_priority", "expert_seed", "counterfactual", "prediction_guided", "evolution_agent"} <= generators
    scores = [r["final_score"] for r in ranked]
    assert scores == sorted(scores, reverse=True) and all(0 <= s <= 1 for s in scores)
    paths = P.export_all(result, settings, str(tmp_path / "out"))
    table = spark.read.option("header", "true").csv(paths["csv"])
    assert table.columns == ["rank", "id", "title", "plant", "stream", "size_class", "target_element", "final_score", "warnings"]
    assert "Top hypotheses:" in open(paths["report"], encoding="utf-8").read()
    metrics = H.compare_profiles(result["candidates"], result["size_classes"], 6, [p for p in H.PROFILES if p.id in ("v01", "v12", "v15")]).collect()
    assert len(metrics) == 3 and all(0 <= m["quality_score"] <= 1 for m in metrics)
    with pytest.raises(ValueError):
        P.PipelineInput("x", retrieval_mode="other")
    with pytest.raises(ValueError):
        P.PipelineInput("x", weights={"risk": -1.0})


def test_ocr_results_replace_short_text(built, spark):
    ledger, run_id, _ = built
    scan = ledger.read("document_texts", run_id).where("title = 'photo.png'").first()["source_file_id"]
    text = "Recognised line with words = 1\n" * 30
    results = spark.createDataFrame([(scan, "", "skipped", 0), (scan, text, "completed", 1)], "source_file_id string, text string, status string, engine_order int")
    P.apply_ocr(ledger, run_id, results)
    row = ledger.read("document_texts", run_id).where(F.col("source_file_id") == scan).first()
    assert row["text"].startswith("Recognised") and json.loads(row["metadata"])["ocr_required"] is False
    assert ledger.read("document_chunks", run_id).where(F.col("source_file_id") == scan).count() >= 1
    assert ledger.read("structured_records", run_id).where("record_type = 'pdf_ocr_formulas'").count() >= 1


def test_provider_steps(built):
    ledger, run_id, _ = built
    assert P.structure_corpus(ledger, run_id, None) == {}
    assert P.structure_corpus(ledger, run_id, MockProvider(error="down")) == {}
    assert P.structure_corpus(ledger, run_id, MockProvider(['{"topics": ["ore"]}'])) == {"topics": ["ore"]}
    answer = json.dumps({"relations": [{"subject": "316L", "predicate": "similar_to", "object": "fatigue", "evidence_text": "e"}, {"subject": "x", "predicate": "similar_to", "object": "y"}]})
    assert P.add_provider_relations(ledger, run_id, MockProvider([answer])) == 1
    statuses = {r["status"] for r in ledger.read("llm_calls", run_id).collect()}
    assert statuses == {"skipped", "failed", "completed"}


def test_ocr_engines_and_tei_service(spark, folder, tmp_path):
    def missing(name, content):
        return "", "skipped", 0, {}

    def reader(name, content):
        return "Words of a page. " * 100, "completed", 1, {"ocr_engine": "reader"}

    def broken(name, content):
        raise OSError("no")

    ledger = Ledger(spark, str(tmp_path / "l"))
    run_id = P.ingest_folder(spark, ledger, str(folder), "ocr", engines=(missing, reader))
    photo = ledger.read("document_texts", run_id).where("title = 'photo.png'").first()
    assert photo["text"].startswith("Words of a page.")
    files = Src.scan_folder(spark, str(folder), "*.png").withColumn("source_file_id", F.lit("x"))
    from oreweave.sources import ocr as Ocr

    failed = Ocr.recognise(files, (broken,))
    assert failed.first()["status"] == "failed" and Ocr.needs_assist(failed).count() == 1
    spark.sparkContext.addPyFile(__file__.replace("test_pipeline.py", "offline_fetch.py"))
    answers = {r["source_file_id"]: r for r in tei.request_tei(files, "offline_fetch:tei").collect()}
    assert answers["x"]["tei"].startswith("<TEI")
    assert tei.request_tei(files, "offline_fetch:no_tei").first()["error"]
    doc = photo["source_file_id"]
    xml = spark.createDataFrame([(doc, TEI)], "source_file_id string, tei string")
    counts = P.build_graph(ledger, run_id, ["sections"], tei=xml)
    kinds = {r["section_type"] for r in ledger.read("document_sections", run_id).where(F.col("source_file_id") == doc).collect()}
    assert kinds == {"title", "abstract", "body", "reference"} and counts["assets"] >= 2


def test_provider_records_run(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "l"))
    payloads = spark.createDataFrame([('{"formationenergy_id": 1, "name": "Fe2O3", "composition": "Fe2O3"}',), ('{"formationenergy_id": 1, "name": "dup"}',)], "payload string")
    run_id = P.ingest_records(spark, ledger, payloads, "oqmd", "x")
    status = ledger.run_status(run_id)
    assert (status["source_files"], status["structured_records"], status["run"]["status"]) == (1, 1, "completed")
    assert ledger.read("source_files", run_id).first()["path"] == "oqmd://1"
    listed = list_runs(ledger.read("ingest_runs"), ledger.read("document_chunks"), ledger.read("kg_embeddings"), ledger.read("kg_sync_status")).collect()
    assert [r["run_id"] for r in listed] == [run_id] and listed[0]["vectors_ready"] is False


def test_ledger_writes(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "l"))
    schema = "id string, run_id string, source_file_id string, document_id string, chunk_index int, text string"
    ledger.replace("document_chunks", spark.createDataFrame([("a", "r1", "f1", "f1", 0, "x"), ("b", "r1", "f2", "f2", 0, "y"), ("c", "r2", "f3", "f3", 0, "z")], schema),
                   spark.createDataFrame([("r1", "f1"), ("r1", "f2"), ("r2", "f3")], "run_id string, source_file_id string"))
    ledger.replace("document_chunks", spark.createDataFrame([("a2", "r1", "f1", "f1", 0, "new")], schema), spark.createDataFrame([("r1", "f1")], "run_id string, source_file_id string"))
    assert {r["id"] for r in ledger.read("document_chunks").collect()} == {"a2", "b", "c"}
    ledger.replace("document_chunks", spark.createDataFrame([], schema), spark.createDataFrame([("r2", "f3")], "run_id string, source_file_id string"))
    assert ledger.read("document_chunks", "r2").count() == 0 and ledger.read("document_chunks", "r1").count() == 2
    run = ledger.create_run("n", "/p")
    ledger.set_status(run, "running")
    rows = ledger.read("ingest_runs").collect()
    assert len(rows) == 1 and rows[0]["status"] == "running" and ledger.latest_run_id() == run
    with pytest.raises(RuntimeError):
        ledger.run_status("missing")


TEI = """<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title>Alloy study</title></titleStmt><sourceDesc><biblStruct><analytic>
<author><persName>Ann Lee</persName></author><idno type="DOI">10.1/x</idno></analytic></biblStruct></sourceDesc></fileDesc><profileDesc><abstract><p>Short.</p></abstract></profileDesc></teiHeader>
<text><body><div><head>Methods</head><p>We melt.</p><p>We cool.</p></div></body><back><listBibl><biblStruct><title>Ref one</title></biblStruct></listBibl></back>
<figure type="table" xml:id="t1"><head>T</head><figDesc>Data</figDesc></figure><formula xml:id="f1">a=b</formula></text></TEI>"""


def test_tei(spark):
    rows = tei.parse_tei(spark.createDataFrame([("s1", TEI), ("s2", "<broken")], "source_file_id string, tei string")).cache()
    sections = tei.tei_sections(rows).orderBy("section_index").collect()
    assert [(s["section_type"], s["title"]) for s in sections] == [("title", "Title"), ("abstract", "Abstract"), ("body", "Methods"), ("reference", "Reference 1")]
    assert sections[2]["text"] == "We melt.\n\nWe cool."
    assert [(a["asset_type"], a["label"], a["caption"]) for a in tei.tei_assets(rows).orderBy("asset_index").collect()] == [("table", "t1", "Data"), ("formula", "f1", "")]
    meta = {(r["kind"], r["text"]) for r in rows.where("row_kind = 'metadata'").collect()}
    assert {("doi", "10.1/x"), ("author", "Ann Lee"), ("title", "Alloy study")} <= meta
    assert rows.where("row_kind = 'error'").count() == 1
    plain = spark.createDataFrame([("s1", 0, "full_text", "x", "y", "e"), ("s2", 0, "full_text", "x", "y", "e")], tei.tei_sections(rows).schema)
    assert tei.sections_with_fallback(tei.tei_sections(rows), plain).where("source_file_id = 's2'").count() == 1
    rows.unpersist()


def test_mixed_encodings_in_one_folder(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("имя,n\nникель,1\n".encode())
    (tmp_path / "b.csv").write_bytes("имя,n\nмедь,2\n".encode("cp1251"))
    (tmp_path / "c.csv").write_bytes("имя,n\n".encode("cp1251") + "кобальт,x\n".encode("cp1251"))
    df = Src.read_csv_any_encoding(spark, str(tmp_path))
    assert sorted(map(tuple, df.select("имя", "n").collect())) == [("кобальт", "x"), ("медь", "2"), ("никель", "1")]
    text = spark.createDataFrame([("й".encode(),), ("й".encode("cp1251"),), (b"\x98\xe9",)], "b binary").select(Src.decoded_text(F.col("b")))
    assert [r[0] for r in text.collect()] == ["й", "й", "\x98é"]


def test_unreadable_workbook_fails_its_job(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "bad.xlsx").write_bytes(b"no workbook")
    (folder / "good.txt").write_text("plain text of a file")
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    run = P.ingest_folder(spark, ledger, str(folder), ocr="off")
    jobs = {r["status"]: r["error"] for r in ledger.read("ingest_jobs", run).where("stage = 'extract'").collect()}
    assert jobs.keys() == {"failed", "completed"} and jobs["failed"] and jobs["completed"] is None


def test_stream_dedupe_remembers_old_keys(spark, tmp_path):
    source = tmp_path / "events"
    source.mkdir()
    days = ["2020-01-01", "2020-06-01", "2021-01-01"]
    for i, day in enumerate(days):
        spark.createDataFrame([(1, day, i), (10 + i, day, i)], "k int, day string, seq int").coalesce(1).write.mode("append").parquet(str(source))
    stream = S.file_stream(spark, str(source), "k int, day string, seq int", max_files=1)
    first = S.first_of_key(stream, str(tmp_path / "out"), str(tmp_path / "cp"), ["k"], [F.asc("seq")])
    assert sorted(r["k"] for r in first.collect()) == [1, 10, 11, 12]


def test_office_and_encodings(spark, tmp_path):
    assert office.docx_plain_text(docx()) == "Intro Froth flotation of 316L. a 1"
    assert "## Intro\n\nFroth flotation of 316L.\n\n## Таблица 1\n\n| a |\n|---|\n| 1 |" in office.docx_markdown("p.docx", docx())
    assert Src.decode_text("медь".encode("cp1251")) == "медь"
    (tmp_path / "t.csv").write_bytes("имя,доля\nмедь,1.5\n".encode("cp1251"))
    df = Src.read_csv_any_encoding(spark, str(tmp_path / "t.csv"))
    assert df.columns == ["имя", "доля"] and df.first()[0] == "медь"
    (tmp_path / "u.csv").write_text("имя\nникель\n", encoding="utf-8")
    assert Src.read_csv_any_encoding(spark, str(tmp_path / "u.csv")).first()[0] == "никель"


def test_conversion_and_cache(spark, folder):
    files = Src.scan_folder(spark, str(folder))
    out = {r["path"].rsplit("/", 1)[-1]: r for r in Src.convert_to_markdown(files.where("source_type in ('txt', 'docx')")).collect()}
    assert out["paper.docx"]["ok"] and out["bad.docx"]["ok"] is False and out["bad.docx"]["error"]
    images = files.where("source_type = 'image'").select("path", "content")
    empty = spark.createDataFrame([], "key string, description string")
    known, todo = Src.with_cached_descriptions(images, empty, "p", "m")
    assert (known.count(), todo.count()) == (0, 1)
    cache = todo.select("key", F.lit("a photo").alias("description"))
    assert Src.with_cached_descriptions(images, cache, "p", "m")[0].first()["description"] == "a photo"
    assert images.select(exports.is_pdf(F.col("content"))).first()[0] is False


def test_paged_sources(spark):
    providers.register(spark)
    spark.sparkContext.addPyFile(__file__.replace("test_pipeline.py", "offline_fetch.py"))
    pages = spark.read.format("offset_pages").options(fetch="offline_fetch:oqmd", offset="8", limit="4", page_size="4", bad="10").load()
    good, bad = providers.split_failures(pages)
    assert sorted(json.loads(r["payload"])["formationenergy_id"] for r in good.collect()) == [8, 9, 11]
    assert [r["offset"] for r in bad.collect()] == [10]
    works = spark.read.format("cursor_pages").options(fetch="offline_fetch:works", queries='["ore", "broken"]', page_size="2", limit_per_query="5").load()
    counts = {r["query"]: r["count"] for r in works.where("error is null").groupBy("query").count().collect()}
    assert counts == {"ore": 5, "broken": 2} and works.where("error is not null").count() == 1


def test_http_retries():
    import urllib.error

    waits, answers = [], [urllib.error.HTTPError("u", 429, "slow", {"Retry-After": "7"}, None), urllib.error.HTTPError("u", 503, "x", {}, None)]

    class Ok(io.BytesIO):
        def __enter__(self):
            return self

        def __exit__(self, *a):
            return False

    def opener(request, timeout):
        if answers:
            raise answers.pop(0)
        return Ok(b'{"a": 1}')

    assert providers.get_json("http://x", sleep=waits.append, opener=opener) == {"a": 1} and waits == [7, 2]
    answers.append(urllib.error.HTTPError("u", 404, "x", {}, None))
    with pytest.raises(RuntimeError):
        providers.get_json("http://x", sleep=waits.append, opener=opener)


def test_query_profiles():
    full = providers.profile_queries("full")
    assert full[0] == "materials science" and len(full) == len({q.lower() for q in full})
    assert providers.profile_queries("bio-soft") == providers.profile_queries("bio")
    with pytest.raises(KeyError):
        providers.profile_queries("nope")
    assert "primary_topic" not in providers.openalex_filter([], 2018, 2020) and "topics" not in providers.openalex_filter(None, 2018, 2020)


def test_jsonl_resume(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"formationenergy_id": "1", "query": "q"}\nbroken{\n\n{"formationenergy_id": "2", "query": "q"}\n{"status": "downloaded", "pdf_url": "u"}\n')
    keys = jsonl.seen_keys(spark, str(tmp_path), "formationenergy_id STRING", F.col("record.formationenergy_id"))
    assert {r["key"] for r in keys.collect()} == {"1", "2"}
    assert jsonl.downloaded_links(spark, str(tmp_path)).first()["pdf_url"] == "u"
    assert {r["query"]: r["records"] for r in jsonl.query_counts(spark, str(tmp_path)).collect()}["q"] == 2
    feedback = tmp_path / "f.json"
    feedback.write_text('[{"hypothesis_id": "h", "action": "approve"}]')
    assert jsonl.load_feedback(spark, str(feedback)).first()["action"] == "approve"
    feedback.write_text('[{"hypothesis_id": "h", "action": "dance"}]')
    with pytest.raises(Exception):
        jsonl.load_feedback(spark, str(feedback)).collect()


def test_exports(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "T", "A")], "id string, type string, label string")
    edges = spark.createDataFrame([("a", "b", "R"), ("a", "b", "Q")], "source string, target string, relation string")
    keys = [json.loads(r["value"])["key"] for r in exports.graph_json(nodes, edges).where("kind = 'edge'").collect()]
    assert sorted(keys) == [0, 1]
    found = spark.createDataFrame([("1", "x"), ("2", "y"), ("2", "y")], "id string, v string")
    exports.append_new_json(found, spark.createDataFrame([("1",)], "id string"), "id", str(tmp_path / "j"))
    assert [r["id"] for r in spark.read.json(str(tmp_path / "j")).collect()] == ["2"]
    links = spark.createDataFrame([("http://a",)], "link string")
    for fmt in ("text", "json", "csv"):
        exports.write_links(links, str(tmp_path / fmt), fmt)
    with pytest.raises(ValueError):
        exports.write_links(links, str(tmp_path / "x"), "xml")
    log = spark.createDataFrame([("2024-01-01 00:00:00", "/x/" + "n" * 60 + ".txt", 10, "text-copy", True, None, None)],
                                "timestamp string, path string, bytes bigint, processor string, ok boolean, skipped_reason string, error string")
    line = exports.run_log_lines(log).first()
    assert line["result"] == "OK" and "…" in line["line"]


def evidence(spark, rows):
    return spark.createDataFrame([(i, t, "s", "txt", "f", "", r) for i, t, r in rows],
                                 "evidence_id string, text string, source_id string, source_type string, filename string, section string, relevance double")


def test_research(spark):
    assert noisy_json('x {"queries": ["b"]} y') == {"queries": ["b"]} and noisy_json("none") == {}
    planner = MockProvider(['{"queries": ["Q", "second", "third"]}'])
    assert decompose(planner, "q", 3) == ["q", "second", "third"] and decompose(None, "q", 3) == ["q"]
    corpus = evidence(spark, [("a", "text a", 0.9), ("b", "text b", 0.4)])
    web = spark.createDataFrame([("glm", "q", 0, "http://w", "W", "body", ""), ("openalex", "q", 0, "http://o", "O", "", "2020")],
                                "backend string, query string, rank int, link string, title string, content string, published string")
    ranks = {r["source_type"]: r["relevance"] for r in web_evidence(web).collect()}
    assert ranks == {"web": 0.6, "openalex": 0.55}
    plain = run_research("q", lambda q: corpus)
    assert plain.provider == "extractive" and [c["evidence_id"] for c in plain.citations] == ["a", "b"] and "rel=0.90" in plain.answer
    mixed = run_research("q", lambda q: corpus, web=lambda qs: web_evidence(web), max_context=3, web_max=2, writers=[MockProvider(["ok [1]"])])
    assert [c["source_type"] for c in mixed.citations] == ["txt", "web", "openalex"] and mixed.answer == "ok [1]"
    drafts = [MockProvider(["short"], name="m1"), MockProvider(["a longer draft"], name="m2")]
    judged = run_research("q", lambda q: corpus, writers=drafts, judge=MockProvider(error="down"))
    assert judged.provider == "fallback-longest-draft" and judged.answer == "a longer draft" and judged.warnings
    failed = run_research("q", lambda q: corpus, writers=[MockProvider(error="x", name="m1"), MockProvider(["only"], name="m2")], judge=MockProvider(["j"]))
    assert failed.answer == "only" and failed.provider == "m2(single)"
    assert run_research("q", lambda q: corpus.where("false")).provider == "none"
    assert "«q»" in extractive_answer("q", [])
    with pytest.raises(ValueError):
        run_research(" ", lambda q: corpus)


def test_service(built):
    ledger, run_id, _ = built
    service = ResearchService(ledger, writers=[MockProvider(["answer [1]"])], api_key="k")
    assert service.handle("GET", "/health")[0] == 200 and service.handle("GET", "/runs")[0] == 401
    code, body = service.handle("GET", "/runs", {"X-API-Key": "k"})
    assert code == 200 and body["runs"][0]["run_id"] == run_id and body["runs"][0]["vectors_ready"]
    auth = {"Authorization": "Bearer k"}
    code, body = service.handle("POST", "/research", auth, json.dumps({"question": "316L fatigue", "run_id": run_id}).encode())
    assert code == 200 and body["answer"] == "answer [1]" and body["citations"]
    assert service.handle("POST", "/research", auth, b"{}")[0] == 400
    assert service.handle("POST", "/other", auth)[0] == 404


def test_command_line(built, folder, capsys):
    ledger, run_id, _ = built
    assert cli.main(["--ledger", ledger.root, "status", "--run-id", run_id]) == 0
    assert cli.main(["--ledger", ledger.root, "search", "316L fatigue"]) == 0
    assert "[g1]" in capsys.readouterr().out
    assert cli.main(["--ledger", ledger.root, "research", "--question", "316L fatigue", "--json"]) == 0


def test_failure_streaks(spark, tmp_path):
    rows = [("k", i, f) for i, f in enumerate([True, True, False, True, True, True])] + [("z", 0, False)]
    source = tmp_path / "in"
    spark.createDataFrame(rows, "key string, seq int, failed boolean").coalesce(1).write.parquet(str(source))
    stream = S.file_stream(spark, str(source), "key string, seq int, failed boolean")
    out = str(tmp_path / "out")
    query = (
        S.failure_streaks(stream, 3).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp"))
        .trigger(availableNow=True).foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{out}/batch={i}")).start()
    )
    query.awaitTermination()
    got = {r["key"]: (r["events"], r["longest_streak"], r["stopped"]) for r in spark.read.parquet(out).collect()}
    assert got == {"k": (6, 3, True), "z": (1, 0, False)}


def test_streaks_do_not_depend_on_arrival(spark, tmp_path):
    import random
    from itertools import groupby

    rng = random.Random(4)
    rows = [("k", i, rng.random() < 0.6) for i in range(60)] + [("gap", i * 3, True) for i in range(5)] + [("z", 1, None)]
    shuffled = rng.sample(rows, len(rows)) + rows[:9] + [("k", None, True)]
    for i in range(0, len(shuffled), 20):
        spark.createDataFrame(shuffled[i : i + 20], "key string, seq int, failed boolean").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = S.file_stream(spark, str(tmp_path / "in"), "key string, seq int, failed boolean", max_files=1)
    out = str(tmp_path / "out")
    S.drain(S.failure_streaks(stream, 3), lambda df, i: df.coalesce(1).write.mode("overwrite").parquet(f"{out}/batch={i}"), str(tmp_path / "cp"), "update")
    longest = max(len(list(g)) for failed, g in groupby(r[2] for r in rows[:60]) if failed)
    got = {}
    for r in spark.read.parquet(out).orderBy("batch").collect():
        got[r["key"]] = (r["events"], r["longest_streak"], r["stopped"])
    assert got == {"k": (60, longest, longest >= 3), "gap": (5, 5, True), "z": (1, 0, False)}


def test_descriptions_are_asked_for_once_and_kept(spark, tmp_path):
    rows = [("a.png", b"one"), ("b.png", b"one"), ("c.png", b"bad"), ("d.png", None), ("e.png", b"")]
    images, folder, log = spark.createDataFrame(rows, "path string, content binary"), str(tmp_path / "cache"), tmp_path / "asked"
    log.mkdir()
    name = str(log)

    def describe(content):
        import uuid

        open(f"{name}/{uuid.uuid4().hex}", "wb").close()
        if content == b"bad":
            raise RuntimeError("no answer")
        return f"photo {len(content)}"

    def run():
        return {r["path"]: (r["description"], r["origin"], r["error"]) for r in Src.described_images(images, folder, "p", "m", describe).collect()}

    first = run()
    assert first == {
        "a.png": ("photo 3", "provider", None), "b.png": ("photo 3", "provider", None), "e.png": ("photo 0", "provider", None),
        "c.png": ("Изображение: c.png", "name", "no answer"), "d.png": ("Изображение: d.png", "name", "no content"),
    }
    assert len(list(log.iterdir())) == 3
    assert {p: o for p, (_, o, _) in run().items()} == {"a.png": "cache", "b.png": "cache", "e.png": "cache", "c.png": "name", "d.png": "name"}
    assert len(list(log.iterdir())) == 4  # only the failed one is asked for again


def test_stored_web_results_reach_the_context(spark):
    from oreweave.operators.research import WEB_RESULT, stored_web_search

    rows = [("glm", "flotation", i, f"http://x/{i}", f"title {i}", "about froth flotation", None) for i in range(3)]
    rows.append(("openalex", "other", 0, "http://y", "Pulp density", "text", "2020"))
    search = stored_web_search(spark.createDataFrame(rows, WEB_RESULT))
    assert {r["filename"] for r in search(["Flotation"]).collect()} == {"http://x/0", "http://x/1", "http://x/2"}
    assert {r["filename"] for r in search(["pulp rheology"]).collect()} == {"http://y"}
    corpus = spark.createDataFrame([("c1", "t", "s", "txt", "f", "", 0.5)], "evidence_id string, text string, source_id string, source_type string, filename string, section string, relevance double")
    result = run_research("flotation", lambda q: corpus, web=search, web_max=2)
    assert [c["source_type"] for c in result.citations] == ["txt", "web", "web"]


def test_streaks_make_no_frame_of_a_keys_rows(monkeypatch):
    """Many keys with few rows: frames of every key were most of the time."""
    import pandas as pd

    class Grouped:
        def applyInPandasWithState(self, update, *_):
            return update

    class Stream:
        def groupBy(self, *_):
            return Grouped()

    class State:
        exists = False

        def update(self, value):
            self.value = value

    def refused(*_, **__):
        raise AssertionError("frames were joined")

    parts = [pd.DataFrame({"seq": [0.0, float("nan")], "failed": [True, True]}), pd.DataFrame({"seq": [2, 1], "failed": [None, True]})]
    monkeypatch.setattr(pd, "concat", refused)
    from oreweave.streaming.incremental import failure_streaks

    (out,) = failure_streaks(Stream(), 2)(("a",), iter(parts), State())
    assert out.values.tolist() == [["a", 3, 2, True]]
