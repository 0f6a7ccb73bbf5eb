import random

import pytest
from pyspark.sql import functions as F

from oreweave import constants as K
from oreweave.operators import entities as E
from oreweave.operators import links as L
from oreweave.operators import matching
from oreweave.operators import profiling, ranking
from oreweave.operators import relations as R
from oreweave.operators import scans
from oreweave.operators.embeddings import embed, embed_query
from oreweave.operators.graph import ledger_graph
from oreweave.operators.matching import contains_join
from oreweave.operators.optimizer import improve, variants
from oreweave.operators.retrieval import HybridRetriever, accepts, asked_for, filtered_or_all
from oreweave.operators.tfidf import TfidfIndex, document_scores


def test_contains_join_equals_brute_force(spark):
    rng = random.Random(3)
    texts = [(i, "".join(rng.choice("abcx ") for _ in range(60))) for i in range(80)]
    names = [(i, "".join(rng.choice("abcx ") for _ in range(rng.randint(1, 5)))) for i in range(60)]
    expected = sorted((t, n) for t, text in texts for n, name in names if len(name) >= 3 and name in text)
    for fraction, few, group in ((1.0, 1 << 20, 256), (1.0, 1 << 20, 0), (1.0, 0, 0), (0.2, 0, 256)):
        got = contains_join(
            spark.createDataFrame(texts, "tid int, text string"), spark.createDataFrame(names, "nid int, name string"),
            ["tid"], "text", ["nid"], "name", statistics_fraction=fraction, broadcast_bytes=few, group_names=group,
        )
        assert sorted(map(tuple, got.collect())) == expected


@pytest.mark.parametrize("frequent", [200_000, 20, 0])
def test_contains_join_by_words(spark, monkeypatch, frequent):
    """Names of one word are met by words, frequent or not, each pair once; the text is not copied for its pieces."""
    monkeypatch.setattr(matching, "FREQUENT_WORDS", frequent)
    rng = random.Random(11)
    signs = ["a", "b", "ß", "я", "-", "A", "\U0001d400", " ", " ", ",", "\n", "]"]
    texts = [(i % 2, i, "".join(rng.choice(signs) for _ in range(rng.choice([0, 5, 200])))) for i in range(60)] + [(0, 99, None), (1, 98, "abab-b-ba" * 9)]
    names = [(i % 2, i, "".join(rng.choice(signs[:5] + [" ", ","]) for _ in range(rng.randint(1, 6)))) for i in range(300)]
    names += [(0, 900, "aab"), (0, 901, "aab"), (1, 902, "ab\U0001d400")]
    expected = sorted((t, n) for g, t, text in texts for h, n, name in names if g == h and len(name) >= 3 and text and name in text.lower())
    got = contains_join(
        spark.createDataFrame(texts, "g int, tid int, text string"), spark.createDataFrame(names, "g int, nid int, name string"),
        ["tid"], "text", ["nid"], "name", on=["g"], derive={"at": F.col("_at")},
    )
    rows = [(r["tid"], r["nid"], r["at"]) for r in got.collect()]
    assert sorted(row[:2] for row in rows) == expected
    text_of, name_of = {i: text for _, i, text in texts}, {i: name for _, i, name in names}
    assert all(at == text_of[t].lower().index(name_of[n]) + 1 for t, n, at in rows)
    plan = got._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
    cuts = [line for line in plan.splitlines() if "Generate explode" in line and "_line" in line]
    assert cuts and all("*(" in line for line in cuts)


def test_block_scans_equal_plain_scans(spark):
    rng = random.Random(5)
    rows = [(k, i, rng.choice(["a", "b", None])) for k in ("hot", "cold") for i in range(300 if k == "hot" else 7)]
    df = spark.createDataFrame(rows, "k string, i int, v string")
    filled = {(r["k"], r["i"]): r["out"] for r in scans.forward_fill(df, ["k"], ["i"], F.floor(F.col("i") / 16), "v", "out").collect()}
    numbered = {(r["k"], r["i"]): r["island"] for r in scans.islands(df, ["k"], ["i"], F.floor(F.col("i") / 16), F.col("v")).collect()}
    streaks = {(r["k"], r["i"]): r["run_length"] for r in scans.consecutive_run(df, ["k"], ["i"], F.floor(F.col("i") / 16), F.col("v") == "a").collect()}
    for key in ("hot", "cold"):
        last, island, previous, streak = None, 0, object(), 0
        for k, i, v in (r for r in rows if r[0] == key):
            last = v if v is not None else last
            island += v != previous
            previous = v
            streak = streak + 1 if v == "a" else 0
            assert (filled[k, i], numbered[k, i], streaks[k, i]) == (last, island, streak)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 100, 997])
@pytest.mark.parametrize("accuracy", [100_000, 20])
def test_quantiles_are_exact(spark, n, accuracy):
    import numpy as np

    rng = np.random.default_rng(n)
    values = np.round(rng.normal(size=n) * 10, 1)
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = profiling.exact_quantiles(df.withColumn("g", F.lit(1)), ["g"], "v", [0.0, 0.25, 0.5, 0.75, 1.0], accuracy).orderBy("probability").collect()
    assert [r["quantile"] for r in got] == pytest.approx(list(np.quantile(values, [0, 0.25, 0.5, 0.75, 1.0])))


def test_optimizer_reaches_the_published_scores(spark):
    final = {r["variant_id"]: r for r in improve(variants(spark), "number", 100).collect()}
    assert final["v18"]["start_score"] == pytest.approx(0.823) and final["v18"]["final_score"] == pytest.approx(0.875108, abs=1e-6)
    assert final["v01"]["start_score"] == pytest.approx(0.217) and final["v01"]["final_score"] == pytest.approx(0.639, abs=5e-4)
    steps = improve(variants(spark), "number", 100, trace=True)
    assert steps.count() == 1800 and steps.where("score_delta < 0").count() == 0
    assert max(final.values(), key=lambda r: r["final_score"])["variant_id"] == "v18"


def contexts(spark):
    text = "316L stainless steel shows fatigue after slm; Fe2O3 porosity, XRD of austenite. 316L again."
    rows = [("r", "f1", "chunk", "f1:chunk:0", 0, text), ("r", "f2", "chunk", "f2:chunk:0", 0, "Inconel 718 and nickel superalloy fatigue")]
    return spark.createDataFrame(rows, "run_id string, source_file_id string, context_type string, context_id string, context_index int, text string")


def test_entities_and_relations(spark):
    rows = contexts(spark)
    mentions = E.entity_mentions(rows)
    records = spark.createDataFrame(
        [("r", "f3", "oqmd_formationenergy", '{"name": "Fe2O3", "formationenergy_id": 9}'), ("r", "f4", "materials_project_summary", '{"formula_pretty": "SiC", "material_id": "mp-1"}'),
         ("r", "f5", "openalex_work", '{"openalex": {"referenced_works": ["W1", "W2"]}}')],
        "run_id string, source_file_id string, record_type string, payload string",
    )
    entities = E.aggregate_entities(mentions, E.record_entities(records))
    by_name = {(r["entity_type"], r["normalized"]): r for r in entities.collect()}
    assert by_name["alloy", "316l"]["source_count"] == 2 and by_name["alloy", "316l"]["confidence"] == 0.85
    assert by_name["material", "fe2o3"]["source_count"] == 2 and by_name["material", "fe2o3"]["confidence"] == 0.7
    assert by_name["material", "sic"]["confidence"] == 0.92 and by_name["material", "sic"]["canonical_id"] == "mp-1"
    assert ("property", "fatigue") in by_name and ("element", "fe") in by_name
    relations = R.build_relations(rows, entities, records)
    found = {(r["predicate"], r["extractor"]) for r in relations.collect()}
    assert ("has_property", "cooccurrence_rules") in found and ("belongs_to_class", "class_rules") in found
    assert relations.where("predicate = 'cites'").count() == 2
    assert relations.select("relation_id").distinct().count() == relations.count()
    proposed = spark.createDataFrame(
        [("r", "316l", "similar_to", "Fe2O3", "e", None), ("r", "316L", "made_up", "Fe2O3", "e", 0.5), ("r", "ghost", "similar_to", "Fe2O3", "e", 0.5)],
        "run_id string, subject string, predicate string, object string, evidence_text string, confidence double",
    )
    resolved = R.provider_relations(proposed, entities, "mock").collect()
    assert len(resolved) == 1 and resolved[0]["confidence"] == 0.65


def test_aliases_and_observations(spark):
    rows = contexts(spark)
    mentions = E.entity_mentions(rows)
    assert {r["alias"] for r in E.entity_aliases(mentions).collect()} == {"Inconel718"}
    assert E.observations(mentions, rows).count() == mentions.count()


def test_catalog_word_boundaries(spark):
    df = spark.createDataFrame([("the system of a tem, phase-field and young's modulus. chemsem",)], "t string")
    hits = {m["name"] for m in df.select(E.catalog_hits(F.col("t")).alias("h")).first()["h"]}
    assert hits == {"tem", "phase-field", "young's modulus"}


def test_domain_entities(spark):
    rows = spark.createDataFrame([("d1", 0, "Флотация и флотации, гидроциклоны; Pnt/Cp класса -71+45 мкм")], "document_id string, chunk_index int, text string")
    got = {(r["entity_type"], r["normalized"]) for r in E.domain_entities(rows, ["chunk_index"]).collect()}
    assert ("process", "флотация") in got and ("process", "гидроциклоны") in got and ("equipment", "гидроциклоны") in got
    assert ("mineral", "pnt/cp") in got and ("size_class", "-71+45 мкм") in got


def test_hash_embedding_of_table_and_query_agree(spark):
    df = spark.createDataFrame([(1, "Iron iron ore"), (2, "")], "id int, text string")
    rows = {r["id"]: r["embedding"] for r in embed(df, ["id"], dimensions=32).collect()}
    cells = {i: v for i, v in enumerate(rows[1]) if v}
    assert cells == pytest.approx(embed_query("Iron iron ore", 32)) and rows[2] == [0.0] * 32


def test_stored_index_equals_direct_scores(spark, tmp_path):
    rng = random.Random(1)
    docs = spark.createDataFrame([(i, " ".join(rng.choice(["ore", "mill", "froth", "grade", "loss"]) for _ in range(12))) for i in range(40)], "id int, text string")
    direct = {r["id"]: r["score"] for r in document_scores(docs, ["id"], "ore mill loss").collect()}
    stored = {r["id"]: r["score"] for r in TfidfIndex.build(docs, ["id"], str(tmp_path / "idx")).scores("ore mill loss").collect()}
    assert stored.keys() == direct.keys() and all(stored[k] == pytest.approx(direct[k]) for k in direct)


def test_metadata_filter(spark):
    wanted = asked_for("Потери КГМК элемент 28 класс -71 +45 в xlsx")
    assert wanted >= {("plant", "КГМК"), ("element", "element28"), ("size class", "-71 +45"), ("source type", "xlsx")}
    rows = spark.createDataFrame([("кгмк э28 -71+45", "xlsx"), ("кгмк э28", "xlsx")], "t string, s string")
    assert [r[0] for r in rows.select(accepts(wanted, F.col("t"), F.col("s"), F.lit("{}"))).collect()] == [True, False]
    assert not asked_for("zzz")


def test_hybrid_retriever_and_retry(spark):
    rows = [("c1", "d1", 0, "pulp density and froth flotation", "txt", "a.txt", "{}"), ("c2", "d2", 0, "geology of rivers", "txt", "b.txt", "{}")]
    chunks = spark.createDataFrame(rows, "chunk_id string, document_id string, chunk_index int, text string, source_type string, filename string, metadata string")
    best = HybridRetriever(chunks).retrieve("froth flotation density").collect()
    assert best[0]["evidence_id"] == "ev:c1" and not best[0]["filter_relaxed"]
    relaxed = HybridRetriever(chunks).retrieve("froth flotation КГМК").collect()
    assert relaxed and relaxed[0]["filter_relaxed"]
    none = filtered_or_all(chunks.where("false"), F.lit(True), [F.asc("chunk_id")], 3)
    assert none.count() == 0


def candidate(spark, **over):
    base = dict(id="h", title="t", hypothesis_text="x", proposed_change="Настроить режим", expected_effect="e", target_plant="P", target_stream="S",
                target_size_class="-10", target_element="both", causal_chain=["a"] * 5, evidence=[("e1", "Потери 250,5 т", "s", "xlsx", "f", "", 1.0)],
                validation_steps=["v"], warnings=[], risks=[], generator="numeric_priority", position=0)
    rows = [tuple({**base, **o}.values()) for o in over.get("rows", [{}])]
    schema = ("id string, title string, hypothesis_text string, proposed_change string, expected_effect string, target_plant string, target_stream string, "
              "target_size_class string, target_element string, causal_chain array<string>, evidence array<struct<evidence_id:string,text:string,source_id:string,"
              "source_type:string,filename:string,section:string,relevance:double>>, validation_steps array<string>, warnings array<string>, risks array<string>, generator string, position int")
    return spark.createDataFrame(rows, schema)


def test_ranking_rules(spark):
    rows = [{"id": "a"}, {"id": "b", "proposed_change": "Замена насоса", "position": 1}, {"id": "c", "evidence": [], "causal_chain": ["x"], "validation_steps": [], "position": 2}]
    ranked = ranking.rank(ranking.validate(candidate(spark, rows=rows), no_capex=True)).collect()
    assert [r["id"] for r in ranked][0] == "a" and ranked[0]["target_tonnes"] == 250.5
    warned = {r["id"]: r["warnings"] for r in ranked}
    assert not warned["a"] and len(warned["b"]) == 1 and len(warned["c"]) == 3
    risky = {r["id"]: r["final_score"] for r in ranked}
    assert risky["b"] < risky["a"]


def test_risk_lowers_the_score(spark):
    from oreweave.functions.scoring import weighted_score

    scores = {name: F.lit(0.5) for name in K.SCORE_WEIGHTS}
    low, high = ({**scores, "risk": F.lit(v)} for v in (0.0, 1.0))
    row = spark.range(1).select(weighted_score(low).alias("l"), weighted_score(high).alias("h")).first()
    assert row["h"] < row["l"]


def test_review_keeps_two_per_bucket(spark):
    rows = [{"id": f"h{i}", "position": i} for i in range(4)] + [{"id": "z", "target_size_class": None, "evidence": [], "position": 9}]
    kept = ranking.diversify(ranking.reflect(candidate(spark, rows=rows)))
    assert {r["id"] for r in kept.collect()} == {"h0", "h1", "z"}
    assert [len(r["warnings"]) for r in kept.where("id = 'z'").collect()] == [2]


HTML = """<!-- <a href="/hidden">x</a> --><ul class="pagination"><li><a href="/list?page=3">3</a></li><li><a href='/list?page=2'>2</a></li></ul>
<a class="x" href="/dlibra/publication/1/edition/2/content">Article one</a><a href="/Content/55/a.pdf?handler=pdf" title="t">PDF</a>
<a href="/Content/55/a.pdf?handler=pdf">again</a><a href="/abc/77">issue</a><a href="mailto:x">m</a>"""


def pages(spark, html=HTML, url="https://s.org/list?page=1"):
    return spark.createDataFrame([(1, url, html)], "page_id int, url string, html string")


def test_link_extraction(spark):
    links = [r["link"] for r in L.page_links(pages(spark), ["page_id"]).orderBy("position").collect()]
    assert links == ["https://s.org/list?page=3", "https://s.org/list?page=2", "https://s.org/dlibra/publication/1/edition/2/content",
                     "https://s.org/Content/55/a.pdf?handler=pdf", "https://s.org/abc/77"]
    raw = pages(spark, "text https://s.org/local/getFiles.php?x&doc_type=pdf end")
    assert [r["link"] for r in L.page_links(raw, ["page_id"], include="doc_type=pdf").collect()] == ["https://s.org/local/getFiles.php?x&doc_type=pdf"]
    assert [r["link"] for r in L.section_links(pages(spark), ["page_id"]).collect()] == ["https://s.org/abc/77"]
    article = L.nearest_article_links(pages(spark), ["page_id"]).collect()
    assert [(r["title"], r["content_id"]) for r in article] == [("Article one", "55")]


@pytest.mark.parametrize("html,expected", [
    (HTML, "https://s.org/list?page=2"),
    ('<a class="btn-next" href="/n1">go</a>', "https://s.org/n1"),
    ('<a href="/n2">Далее</a>', "https://s.org/n2"),
    ('<a rel="next" href="/n3">x</a>', "https://s.org/n3"),
    ('<a data-page="4" href="/n4">x</a><a data-page="2" href="/n5">x</a>', "https://s.org/n5"),
    ('<a aria-label="Next page" href="/n6">x</a>', "https://s.org/n6"),
    ('<a href="/catalog/9?page=2">x</a>', None),
])
def test_next_page_tiers(spark, html, expected):
    assert pages(spark, html).select(L.next_page(F.col("html"), F.col("url"))).first()[0] == expected


def test_issue_archive(spark):
    menu = spark.createDataFrame([("https://i.pl/arch", '<a href="/v71">Volume 71 Issue 1/2026</a><a href="/v70">Volume 70 Issue 2B/2025</a>')], "url string, html string")
    issues = L.issue_links(menu)
    listed = spark.createDataFrame([("https://i.pl/v71", '<a href="/files/archiwum/Vol1_2026/02.pdf">b</a><a href="/files/archiwum/Vol1_2026/01.pdf">a</a>'),
                                    ("https://i.pl/v70", '<a href="/files/archiwum/Vol2_2025/09.pdf">c</a>')], "url string, html string")
    rows = L.issue_articles(issues, listed).collect()
    assert [(r["volume"], r["issue"], r["number"]) for r in rows] == [(70, 2, 9), (71, 1, 1), (71, 1, 2)]
    assert L.issue_articles(issues, listed, year=2025).count() == 1


def test_crawl_stops_and_counts_rounds(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "src string, dst string")
    seeds = spark.createDataFrame([("a",)], "node string")
    assert {r["node"]: r["depth"] for r in L.crawl(edges, seeds).collect()} == {"a": 0, "b": 1, "c": 2}


def test_graph_edges_need_both_ends(spark):
    docs = spark.createDataFrame([("r", "d", "t")], "run_id string, source_file_id string, title string")
    sections = spark.createDataFrame([("r", "d", "s", "h"), ("r", "gone", "s2", "h")], "run_id string, source_file_id string, section_id string, title string")
    chunks = spark.createDataFrame([("r", "d", "c", 0)], "run_id string, source_file_id string, chunk_id string, chunk_index int")
    entities = spark.createDataFrame([("r", "e1", "alloy", "316L")], "run_id string, entity_id string, entity_type string, name string")
    relations = spark.createDataFrame([("e1", "e9", "has_property")], "subject_entity_id string, object_entity_id string, predicate string")
    nodes, edges = ledger_graph(docs, sections, chunks, entities, relations)
    assert nodes.count() == 5 and sorted(r["type"] for r in edges.collect()) == ["HAS_CHUNK", "HAS_SECTION"]


def test_markdown_report(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (2, None, 4.0)], "id int, name string, ni_grade double")
    text = profiling.markdown_report("t.csv", df, ["id"])
    assert "- **Строк**: 2, **Колонок**: 3" in text and "`name` (string) — 1/2 непустых" in text
    assert "**Ключевая колонка**: `ni_grade`" in text and "- Медиана: 3.000" in text


def test_crawl_reaches_the_end_of_a_long_chain(spark):
    edges = spark.createDataFrame([(str(i), str(i + 1)) for i in range(70)], "src string, dst string")
    reached = L.crawl(edges, spark.createDataFrame([("0",)], "node string"))
    assert {r["node"]: r["depth"] for r in reached.collect()} == {str(i): i for i in range(71)}


def test_links_in_all_quote_styles(spark):
    html = "<a href=/bare>x</a><a class=y href='/single'>x</a><a href=\"/double\">x</a><a href=/last>z</a>"
    row = spark.createDataFrame([(html,), ("<area href=/area>",)], "html string").select(L.href_candidates(F.col("html"), "http\\S+").alias("h")).collect()
    assert [r["h"] for r in row] == [["/bare", "/single", "/double", "/last"], ["/area"]]


def test_common_passes_equal_single_searches(spark):
    rng = random.Random(9)
    vocabulary = ["froth", "flotation", "density", "pulp", "ni", "cu", "кгмк", "river", "alloy", "fatigue"]
    rows = [(f"c{i}", f"d{i}", i, " ".join(rng.choice(vocabulary) for _ in range(12)), "txt", "f", "{}") for i in range(60)]
    chunks = spark.createDataFrame(rows, "chunk_id string, document_id string, chunk_index int, text string, source_type string, filename string, metadata string")
    queries = ["froth flotation", "alloy fatigue КГМК", "zz yy", "river"]
    search = HybridRetriever(chunks)
    together = search.retrieve_all(queries, 5).collect()
    for i, query in enumerate(queries):
        alone = search.retrieve(query, 5).collect()
        ours = [r for r in together if r["query"] == i]
        assert sorted((r["evidence_id"], round(r["relevance"], 9), r["filter_relaxed"]) for r in ours) == sorted(
            (r["evidence_id"], round(r["relevance"], 9), r["filter_relaxed"]) for r in alone)


def test_a_task_counts_a_fixed_amount_of_text(spark, monkeypatch):
    from oreweave import tables
    from oreweave.operators.embeddings import bucket_weights

    docs = spark.range(200).select(F.col("id"), F.concat(F.lit("ore mill "), F.repeat(F.concat("id", F.lit(" loss ")), 20)).alias("text"))
    monkeypatch.setattr(tables, "PART_BYTES", 1024, raising=False)
    cells = bucket_weights(docs, ["id"]).select("id", F.spark_partition_id().alias("p"))
    assert cells.groupBy("p").agg(F.count_distinct("id").alias("n")).agg(F.max("n")).first()[0] < 25
    assert cells.select("id").distinct().count() == 200


def test_only_counts_of_vocabulary_terms_are_kept(spark, monkeypatch):
    from oreweave.operators import tfidf

    kept, real = [], tfidf.stored
    monkeypatch.setattr(tfidf, "stored", lambda df: kept.append(real(df)) or kept[-1])
    docs = spark.range(50).select("id", F.concat_ws(" ", F.lit("ore mill"), F.concat(F.lit("rare"), "id"), F.lit("ore")).alias("text"))
    found = document_scores(docs, ["id"], "ore mill", max_features=4).collect()
    assert len(found) == 50 and all(df.count() <= 4 for df in kept)


def test_both_filters_read_the_hits_of_one_search(spark, small_dir, capsys):
    from oreweave.plans.retrieval_queries import filter_retry

    filter_retry(spark, small_dir).explain()
    assert "regexp_extract_all" not in capsys.readouterr().out


def test_metric_columns_cast_only_what_may_be_a_number(spark, capsys):
    from datetime import datetime

    rows = [(1.0, "A", datetime(2020, 1, 1), True), (2.0, " -3.5 ", datetime(2020, 1, 2), False), (3.0, "Infinity", None, None), (4.0, "NaN", None, None)]
    df = spark.createDataFrame(rows, "loss double, loss_text string, loss_date timestamp, loss_flag boolean").coalesce(1)
    values = profiling._long_form(df, df.columns)
    got = {(r[0], r[1]) for r in values.collect()}
    assert got == {("loss", 1.0), ("loss", 2.0), ("loss", 3.0), ("loss", 4.0), ("loss_text", -3.5), ("loss_text", float("inf"))}
    values.explain()
    plan = capsys.readouterr().out
    assert "loss_date" not in plan.split("Project")[1].split("+-")[0] and "RoundRobin" in plan
    assert profiling._long_form(df, ["loss_date"]).count() == 0
