"""One query for each small operator that no larger query shows: the operator itself on table columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from oreweave.functions import chem
from oreweave.functions import records as Rec
from oreweave.functions import text as T
from oreweave.functions import urls as U
from oreweave.functions.hashing import iso_seconds
from oreweave.operators.embeddings import embedding_targets
from oreweave.operators.graph import ledger_graph
from oreweave.operators.layout import merge_assets
from oreweave.operators.links import doi_links
from oreweave.plans.registry import query, sql_collapse
from oreweave.tables import table


@query("page_texts", """
  SELECT doc_id, generate_subscripts(p, 1) - 1 AS page, md5(unnest(p)) AS page_md5 FROM (
    SELECT doc_id, string_split(replace(text, chr(10), chr(12)), chr(12)) AS p FROM documents WHERE text <> '')
""")
def page_texts(spark, sf_dir):
    """Pages of texts whose lines are taken for pages."""
    docs = table(spark, sf_dir, "documents")
    pages = T.split_pages(F.translate("text", "\n", "\f"))
    return docs.select("doc_id", F.posexplode(pages).alias("page", "text")).select("doc_id", F.col("page").cast("bigint").alias("page"), F.md5("text").alias("page_md5"))


_COMPACT = "replace(replace(name, '-', ''), ' ', '')"


@query("alias_names", f"""
  SELECT p_partkey, {_COMPACT} AS alias FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_brand ELSE replace(p_name, ' ', '-') END AS name FROM part)
  WHERE {_COMPACT} NOT IN ('', name)
""")
def alias_names(spark, sf_dir):
    kind = F.col("p_partkey") % 3
    name = F.when(kind == 0, F.col("p_name")).when(kind == 1, F.col("p_brand")).otherwise(F.replace("p_name", F.lit(" "), F.lit("-")))
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(chem.aliases(name)).alias("alias"))


@query("camel_labels", """
  SELECT p_partkey, array_to_string(list_transform(string_split(trim(regexp_replace(p_type, '[^A-Za-z0-9]+', ' ', 'g')), ' '), lambda w: upper(w[1]) || lower(w[2:])), '') AS label FROM part
""")
def camel_labels(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.camel_label(F.col("p_type")).alias("label"))


@query("search_urls", """
  SELECT c_custkey, 'https://example.org/find?q=' || replace(c_name, '#', '%23') || '&segment=' || c_mktsegment || '&page=' || (c_custkey % 7)::VARCHAR AS url FROM customer
""")
def search_urls(spark, sf_dir):
    parts = [("q", F.col("c_name")), ("segment", F.col("c_mktsegment")), ("page", (F.col("c_custkey") % 7).cast("string"))]
    return table(spark, sf_dir, "customer").select("c_custkey", U.search_url("https://example.org/find", parts).alias("url"))


_STEMS = ["Отчет КГМК", "данные вкр", "МЕДный цех", "сводка ТОФ", "прочее"]


@query("plant_paths", f"""
  SELECT c_custkey, CASE c_custkey % 5 {' '.join(f"WHEN {i} THEN '{plant}'" for i, plant in enumerate(['КГМК', 'НОФ Вкр', 'НОФ мед', 'ТОФ']))} ELSE c_mktsegment END AS plant FROM customer
""")
def plant_paths(spark, sf_dir):
    stem = F.element_at(F.array(*map(F.lit, _STEMS)), (F.col("c_custkey") % 5 + 1).cast("int"))
    path = F.concat(F.lit("/data/"), "c_mktsegment", F.lit("/"), stem, F.lit(" "), F.col("c_custkey").cast("string"), F.lit(".xlsx"))
    return table(spark, sf_dir, "customer").select("c_custkey", T.plant_from_path(path).alias("plant"))


@query("list_values", """
  SELECT p_partkey, generate_subscripts(v, 1) - 1 AS position, unnest(v) AS value FROM (
    SELECT p_partkey, list_filter(regexp_split_to_array(p_name || ',, ' || p_brand || ' ', '[,\\s]+'), lambda x: x <> '') AS v FROM part)
""")
def list_values(spark, sf_dir):
    text = F.concat("p_name", F.lit(",, "), "p_brand", F.lit(" "))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(T.parse_list(text)).alias("position", "value"))
    return rows.withColumn("position", F.col("position").cast("bigint"))


@query("cell_values", f"""
  SELECT c_custkey, {sql_collapse("'  ' || c_name || '  мкм ' || c_mktsegment")} AS label,
    CASE c_custkey % 3 WHEN 0 THEN c_acctbal::DOUBLE END AS number FROM customer
""".replace("'  мкм '", "'   '"))
def cell_values(spark, sf_dir):
    """Labels lose their unit and their blanks; what is no number, or NaN, is no value."""
    kind = F.col("c_custkey") % 3
    cell = F.when(kind == 0, F.col("c_acctbal").cast("double").cast("string")).when(kind == 1, "NaN").otherwise(F.col("c_name"))
    label = F.concat(F.lit("  "), "c_name", F.lit("  мкм "), "c_mktsegment")
    return table(spark, sf_dir, "customer").select("c_custkey", T.cell_label(label).alias("label"), T.cell_number(cell).alias("number"))


@query("iso_times", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS at FROM events")
def iso_times(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", iso_seconds(F.col("ts")).alias("at"))


_TONNES = "'Э28 ' || l_quantity::DOUBLE::VARCHAR || ' т, Э29 ' || coalesce(nullif(l_linenumber, 3)::DOUBLE::VARCHAR, 'None') || ' т'"


@query("record_sentences", f"""
  SELECT l_orderkey, l_linenumber, 'size_class' AS kind, l_shipdate::DATE::VARCHAR || ' ' || l_returnflag || ' класс ' || l_linestatus || ': ' || {_TONNES} || '.' AS sentence FROM lineitem
  UNION ALL SELECT l_orderkey, l_linenumber, 'summary', l_shipdate::DATE::VARCHAR || ' ' || l_returnflag || ': ' || {_TONNES} || ', СМТ ' || l_quantity::DOUBLE::VARCHAR || '.' FROM lineitem
  UNION ALL SELECT l_orderkey, l_linenumber, 'extractable', l_shipdate::DATE::VARCHAR || ' ' || l_returnflag || CASE WHEN l_linestatus = 'O' THEN ' извлекаемый: ' ELSE ' неизвлекаемый: ' END || {_TONNES} || '.' FROM lineitem
""")
def record_sentences(spark, sf_dir):
    """Sentences of the three kinds of workbook records."""
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_shipdate").cast("date").cast("string").alias("plant"), F.col("l_returnflag").alias("stream"), F.col("l_linestatus").alias("size_class"),
        F.col("l_quantity").cast("double").alias("element28_tonnes"), F.nullif("l_linenumber", F.lit(3)).cast("double").alias("element29_tonnes"),
        F.col("l_quantity").cast("double").alias("dry_metric_tonnes"), (F.col("l_linestatus") == "O").alias("extractable"),
    )
    cells = F.array(*[F.struct(F.lit(kind).alias("kind"), Rec.tailings_sentence(kind).alias("sentence")) for kind in ("size_class", "summary", "extractable")])
    return rows.select("l_orderkey", "l_linenumber", F.inline(cells))


@query("json_answers", """
  SELECT c_custkey, CASE c_custkey % 4 WHEN 2 THEN NULL WHEN 3 THEN NULL ELSE '{"name": "' || c_name || '", "list": [1, {"a": ' || c_custkey::VARCHAR || '}]}' END AS answer FROM customer
""")
def json_answers(spark, sf_dir):
    """JSON out of noisy answers: bare, between words, absent, broken."""
    clean = F.concat(F.lit('{"name": "'), "c_name", F.lit('", "list": [1, {"a": '), F.col("c_custkey").cast("string"), F.lit("}]}"))
    kind = F.col("c_custkey") % 4
    noisy = F.when(kind == 0, clean).when(kind == 1, F.concat(F.lit("Here it is:\n```"), clean, F.lit("``` as asked"))).when(kind == 2, F.col("c_name")).otherwise(F.concat(F.lit("{"), clean))
    return table(spark, sf_dir, "customer").select("c_custkey", T.extract_json_object(noisy).alias("answer"))


@query("ocr_codes", """
  SELECT doc_id, CASE lang WHEN 'en' THEN ['en', 'ru'] WHEN 'de' THEN ['ru', 'en'] ELSE ['en'] END AS languages FROM documents
""")
def ocr_codes(spark, sf_dir):
    lang = F.col("lang")
    codes = F.when(lang == "en", "eng+rus").when(lang == "de", "RUS, eng+rus").otherwise("xyz")
    return table(spark, sf_dir, "documents").select("doc_id", T.ocr_languages(codes).alias("languages"))


@query("asset_merge", """
  WITH p AS (SELECT l_orderkey, l_returnflag, l_linestatus, l_linenumber FROM lineitem WHERE l_linenumber <= 2),
  e AS (SELECT l_orderkey, l_returnflag, l_linestatus, l_linenumber, row_number() OVER (PARTITION BY l_orderkey, l_returnflag, l_linestatus ORDER BY l_linenumber) AS n
        FROM lineitem l WHERE l_linenumber > 2 AND NOT EXISTS (SELECT 1 FROM p WHERE p.l_orderkey = l.l_orderkey AND p.l_returnflag = l.l_returnflag AND p.l_linestatus = l.l_linestatus))
  SELECT l_orderkey AS source_file_id, l_returnflag AS asset_type, l_linestatus AS content, l_linenumber::VARCHAR AS label FROM p
  UNION ALL SELECT l_orderkey, l_returnflag, l_linestatus, l_linenumber::VARCHAR FROM e WHERE n = 1
""")
def asset_merge(spark, sf_dir):
    """Assets of the first lines of an order with those of later lines that are new for it."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.lit("r").alias("run_id"), F.col("l_orderkey").alias("source_file_id"), F.col("l_returnflag").alias("asset_type"), F.col("l_linestatus").alias("content"),
        F.col("l_linenumber").cast("string").alias("label"), "l_linenumber",
    )
    first = F.col("l_linenumber") <= 2
    return merge_assets(rows.where(first).drop("l_linenumber"), rows.where(~first).drop("l_linenumber")).drop("run_id")


@query("embedding_texts", """
  SELECT 'documents' AS target_type, 'd' || doc_id AS target_id, md5('Document ' || doc_id || chr(10) || text) AS text_md5 FROM documents
  UNION ALL SELECT 'chunks', 'b' || item_id, md5(text) FROM benchmark
  UNION ALL SELECT 'entities', 'p' || p_partkey, md5(p_type || ': ' || p_name || ' ') FROM part
""")
def embedding_texts(spark, sf_dir):
    run = F.lit("r").alias("run_id")
    number = F.col("doc_id").cast("string")
    docs = table(spark, sf_dir, "documents").select(run, F.concat(F.lit("d"), number).alias("source_file_id"), F.concat(F.lit("Document "), number).alias("title"), "text")
    chunks = table(spark, sf_dir, "benchmark").select(run, F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("chunk_id"), "text")
    entities = table(spark, sf_dir, "part").select(
        run, F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("entity_id"), F.col("p_type").alias("entity_type"), F.col("p_name").alias("name")
    )
    return embedding_targets(docs, chunks, entities).select("target_type", "target_id", F.md5("text").alias("text_md5"))


@query("ledger_edges", """
  WITH d AS (SELECT 'c' || c_custkey AS id FROM customer WHERE c_acctbal > 0), s AS (SELECT 'o' || o_orderkey AS id, 'c' || o_custkey AS doc FROM orders),
  k AS (SELECT 's' || s_suppkey AS id, 'c' || s_suppkey AS doc FROM supplier), e AS (SELECT 'p' || p_partkey AS id FROM part WHERE p_size > 10)
  SELECT doc AS source, id AS target, 'HAS_SECTION' AS type, NULL AS predicate FROM s WHERE doc IN (SELECT id FROM d)
  UNION ALL SELECT doc, id, 'HAS_CHUNK', NULL FROM k WHERE doc IN (SELECT id FROM d)
  UNION ALL SELECT 'p' || l_partkey, 'p' || (l_suppkey + 1), 'KG_RELATION', l_shipdate::DATE::VARCHAR FROM lineitem
    WHERE 'p' || l_partkey IN (SELECT id FROM e) AND 'p' || (l_suppkey + 1) IN (SELECT id FROM e)
""")
def ledger_edges(spark, sf_dir):
    """Graph edges of customers, orders, suppliers and parts: an edge needs both its ends."""
    named = lambda prefix, column: F.concat(F.lit(prefix), F.col(column).cast("string"))
    run = F.lit("r").alias("run_id")
    docs = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(named("c", "c_custkey").alias("source_file_id"), F.col("c_name").alias("title"), run)
    sections = table(spark, sf_dir, "orders").select(named("o", "o_orderkey").alias("section_id"), named("c", "o_custkey").alias("source_file_id"), F.col("o_orderpriority").alias("title"), run)
    chunks = table(spark, sf_dir, "supplier").select(named("s", "s_suppkey").alias("chunk_id"), named("c", "s_suppkey").alias("source_file_id"), F.lit(0).alias("chunk_index"), run)
    entities = table(spark, sf_dir, "part").where("p_size > 10").select(named("p", "p_partkey").alias("entity_id"), F.col("p_brand").alias("entity_type"), F.col("p_name").alias("name"), run)
    relations = table(spark, sf_dir, "lineitem").select(
        named("p", "l_partkey").alias("subject_entity_id"), F.concat(F.lit("p"), (F.col("l_suppkey") + 1).cast("string")).alias("object_entity_id"), F.col("l_shipdate").cast("date").cast("string").alias("predicate")
    )
    return ledger_graph(docs, sections, chunks, entities, relations)[1]


@query("doi_results", """
  SELECT '10.1/' || item_id AS doi, text AS title, (2000 + item_id % 20)::INTEGER AS year, 'https://doi.org/10.1/' || item_id AS url FROM benchmark WHERE item_id % 3 <> 0
""")
def doi_results(spark, sf_dir):
    """Links of search answers; a work without a DOI has none."""
    number = F.col("item_id").cast("string")
    doi = F.when(F.col("item_id") % 3 != 0, F.concat(F.lit("10.1/"), number)).otherwise("")
    work = F.struct(doi.alias("doi"), F.col("text").alias("title"), (F.lit(2000) + F.col("item_id") % 20).cast("int").alias("year"), F.lit("j").alias("journal"), F.lit(0.5).alias("score"))
    payloads = table(spark, sf_dir, "benchmark").select(F.to_json(F.struct(F.array(work).alias("results"))).alias("payload"))
    return doi_links(payloads).select("doi", "title", "year", "url")


@query("record_keys", """
  SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN l_orderkey::VARCHAR WHEN 1 THEN l_partkey::VARCHAR || ':unknown' WHEN 2 THEN 'unknown:' || l_suppkey::VARCHAR
    ELSE substring(sha1(l_shipdate::DATE::VARCHAR || l_orderkey::VARCHAR), 1, 16) END AS record_key FROM lineitem
""")
def record_keys(spark, sf_dir):
    """Keys of provider records: own id, else the pair of entry and calculation, else a hash of the record."""
    kind = F.col("l_linenumber") % 4
    record = F.struct(
        F.when(kind == 0, F.col("l_orderkey").cast("string")).when(kind == 1, "").alias("formationenergy_id"),
        F.when(kind == 1, F.col("l_partkey").cast("string")).when(kind == 2, "").alias("entry_id"),
        F.when(kind == 2, F.col("l_suppkey").cast("string")).alias("calculation_id"),
    )
    raw = F.concat(F.col("l_shipdate").cast("date").cast("string"), F.col("l_orderkey").cast("string"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", Rec.oqmd_key(record, raw).alias("record_key"))
