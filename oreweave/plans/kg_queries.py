"""Knowledge-graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from oreweave import constants as K
from oreweave.functions import text as T
from oreweave.operators import entities as E
from oreweave.operators import relations as R
from oreweave.operators.graph import relation_names, tailings_graph
from oreweave.operators.matching import contains_join
from oreweave.plans import corpus
from oreweave.plans.registry import query, sql_chunks, sql_collapse, sql_list, sql_text
from oreweave.session import stored
from oreweave.tables import SIZE_CLASS_BY_LINE, spread, table, tailings_records

_TERMS = ", ".join(
    f"({sql_text(kind)}, {sql_text(term)}, {sql_text(E._regex_literal(term))})"
    for kind, terms in corpus.CATALOG.items() for term in terms
)
_CHUNKS = f"""chunks AS (
  SELECT run_id, source_file_id, chunk_index, source_file_id || ':chunk:' || chunk_index AS context_id, chunk_text AS text
  FROM {sql_chunks(corpus.SQL_DOCUMENTS, 'run_id, source_file_id')})"""
_MARKED = "regexp_replace(text, '([+-])([\\p{L}\\p{N}_])', '\\1' || chr(1) || '\\2', 'g')"
_SYMBOLS = sql_list(K.ELEMENT_SYMBOLS)
_MENTIONS = f"""terms(entity_type, term, pattern) AS (VALUES {_TERMS}),
{_CHUNKS},
words AS (
  SELECT run_id, source_file_id, chunk_index, context_id,
    list_transform(regexp_extract_all({_MARKED}, '[\\p{{L}}\\p{{N}}_]+(?:[+-]\\x01)?'), lambda w: replace(w, chr(1), '')) AS words
  FROM chunks
), formulas AS (
  SELECT run_id, source_file_id, chunk_index, context_id, unnest(fs) AS name, generate_subscripts(fs, 1) AS pos
  FROM (SELECT *, list_filter(words, lambda w: regexp_full_match(w, '(?:[A-Z][a-z]?[0-9]*){{2,}}[+-]?')
      AND NOT list_contains({_SYMBOLS}, w)
      AND len(list_filter(regexp_extract_all(w, '[A-Z][a-z]?'), lambda e: NOT list_contains({_SYMBOLS}, e))) = 0
      AND len(regexp_extract_all(w, '[A-Z][a-z]?')) >= 2) AS fs FROM words)
), mentions AS (
  SELECT run_id, source_file_id, chunk_index, context_id, 'material' AS entity_type, name, 0.7::DOUBLE AS confidence, pos FROM formulas
  UNION ALL
  SELECT run_id, source_file_id, chunk_index, context_id, 'element', unnest(regexp_extract_all(name, '[A-Z][a-z]?')), 0.75, pos FROM formulas
  UNION ALL
  SELECT run_id, source_file_id, chunk_index, context_id, 'alloy',
    {sql_collapse("translate(unnest(regexp_extract_all(text, '(?i)(?:^|[^\\p{L}\\p{N}_])(316L|304L|17-4PH|Ti-?6Al-?4V|AlSi10Mg|CoCrMo|NiTi|Inconel\\s*\\d+|Fe-?Cr-?Ni|Al-?Cu-?Mg|Cu-?Ni)(?:$|[^\\p{L}\\p{N}_])', 1)), '–—', '--')")}, 0.85, 0 FROM chunks
  UNION ALL
  SELECT run_id, source_file_id, chunk_index, context_id, entity_type, term, 0.68, 1000000
  FROM chunks CROSS JOIN terms
  WHERE contains(lower(text), term) AND regexp_matches(lower(text), '(^|[^A-Za-z0-9])' || pattern || '([^A-Za-z0-9]|$)')
)"""
_ENTITY_ID = "substr(sha1(run_id || ':' || entity_type || ':' || normalized), 1, 16)"
_RECORDS = """records AS (
  SELECT 'src' || item_id % 20 AS run_id, 'bench-' || item_id AS source_file_id, 'material' AS entity_type,
    list_filter(string_split(regexp_replace(text, '[^\\p{L}]+', ' ', 'g'), ' '), lambda w: length(w) >= 6)[1] AS name,
    0.92::DOUBLE AS confidence, 'mp-' || item_id AS canonical_id
  FROM benchmark)"""
_ENTITIES = f"""{_RECORDS}, observed AS (
  SELECT run_id, entity_type, lower(name) AS normalized, name, source_file_id, NULL AS canonical_id, confidence, 0 AS origin, chunk_index, pos FROM mentions
  UNION ALL
  SELECT run_id, entity_type, lower(name), name, source_file_id, canonical_id, confidence, 1, 0, 0 FROM records WHERE name IS NOT NULL
), entities AS (
  SELECT run_id, entity_type, normalized,
    arg_min(name, (origin, source_file_id, chunk_index, pos)) AS name,
    first(canonical_id ORDER BY origin, source_file_id, chunk_index, pos) AS canonical_id,
    coalesce(max(confidence) FILTER (origin = 0), arg_min(confidence, (origin, source_file_id, chunk_index, pos))) AS confidence,
    count(*) AS source_count,
    arg_min(source_file_id, (origin, source_file_id, chunk_index, pos)) AS first_source_file_id
  FROM observed GROUP BY run_id, entity_type, normalized
)"""


def contexts(spark, sf_dir):
    return E.context_rows(corpus.chunks(spark, sf_dir))


def mentions(spark, sf_dir):
    return E.entity_mentions(contexts(spark, sf_dir), corpus.CATALOG)


def entities_of(spark, sf_dir, rows):
    return E.aggregate_entities(E.entity_mentions(rows, corpus.CATALOG), E.record_entities(corpus.records(spark, sf_dir)))


def all_entities(spark, sf_dir):
    return entities_of(spark, sf_dir, contexts(spark, sf_dir))


@query("term_match", f"""
  WITH terms(entity_type, term, pattern) AS (VALUES {_TERMS})
  SELECT doc_id, entity_type, term AS name FROM documents CROSS JOIN terms
  WHERE contains(lower(text), term) AND regexp_matches(lower(text), '(^|[^A-Za-z0-9])' || pattern || '([^A-Za-z0-9]|$)')
""")
def term_match(spark, sf_dir):
    low = spread(table(spark, sf_dir, "documents")).select("doc_id", F.lower("text").alias("low"))
    return low.select("doc_id", F.inline(E.catalog_hits(F.col("low"), corpus.CATALOG))).select("doc_id", "entity_type", "name")


@query("entity_mentions", f"WITH {_MENTIONS} SELECT run_id, entity_type, lower(name) AS normalized, count(*) AS mentions, count(DISTINCT source_file_id) AS document_count FROM mentions GROUP BY ALL")
def entity_mentions(spark, sf_dir):
    found = mentions(spark, sf_dir)
    keys = ["run_id", "entity_type", "normalized"]
    counted = found.groupBy("run_id", "entity_type", T.normalize_name(F.col("name")).alias("normalized")).agg(F.count("*").alias("mentions"))
    return counted.join(E.entity_document_counts(found), keys)


@query("entity_agg", f"WITH {_MENTIONS}, {_ENTITIES} SELECT {_ENTITY_ID} AS entity_id, * FROM entities")
def entity_agg(spark, sf_dir):
    return all_entities(spark, sf_dir)


@query("context_union", f"""
  WITH {_CHUNKS}
  SELECT 'chunk' AS context_type, run_id, count(*) AS contexts, sum(length(text))::BIGINT AS chars FROM chunks GROUP BY run_id
  UNION ALL
  SELECT 'section', run_id, count(*), sum(length(title || chr(10) || text))::BIGINT FROM {corpus.SQL_DOCUMENTS} GROUP BY run_id
""")
def context_union(spark, sf_dir):
    sections = corpus.documents(spark, sf_dir).select(
        "run_id", "source_file_id", F.col("source_file_id").alias("section_id"), F.lit(0).alias("section_index"), "title", "text"
    )
    rows = E.context_rows(corpus.chunks(spark, sf_dir), sections)
    return rows.groupBy("context_type", "run_id").agg(F.count("*").alias("contexts"), F.sum(F.length("text")).alias("chars"))


@query("snippet", """
  SELECT doc_id, CASE WHEN pos = 0 THEN substring(text, 1, 350)
    ELSE trim(substring(text, greatest(0, pos - 176) + 1, least(length(text), pos - 1 + 4 + 175) - greatest(0, pos - 176)), E' \\n\\r\\t') END AS snippet
  FROM (SELECT doc_id, text, strpos(lower(text), 'tion') AS pos FROM documents)
""")
def snippet(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.snippet(F.col("text"), F.lit("tion")).alias("snippet"))


@query("dict_match", """
  WITH names AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\\p{L}]{7,}')) AS name FROM benchmark)
  SELECT doc_id, name FROM documents JOIN names ON contains(lower(text), name)
""")
def dict_match(spark, sf_dir):
    """Every benchmark word of seven or more letters against every document, as substrings."""
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]{7,}"), F.lit(0)))
    names = table(spark, sf_dir, "benchmark").select(words.alias("name")).distinct().withColumn("name_id", F.col("name"))
    found = contains_join(spread(table(spark, sf_dir, "documents")), names, ["doc_id"], "text", ["name_id"], "name")
    return found.select("doc_id", F.col("name_id").alias("name"))


def _sql_snippet(text: str, name: str) -> str:
    pos = f"strpos(lower({text}), lower({name}))"
    return f"""CASE WHEN {pos} = 0 THEN substring({text}, 1, 350)
      ELSE trim(substring({text}, greatest(0, {pos} - 176) + 1, least(length({text}), {pos} - 1 + length({name}) + 175) - greatest(0, {pos} - 176)), E' \\n\\r\\t') END"""


_FOUND = f"""found AS (
  SELECT c.run_id, c.context_id, c.source_file_id, c.chunk_index, c.text, e.entity_type, e.name, e.normalized, {_ENTITY_ID.replace('run_id', 'e.run_id').replace('entity_type', 'e.entity_type').replace('normalized', 'e.normalized')} AS entity_id
  FROM chunks c JOIN entities e ON e.run_id = c.run_id AND length(e.normalized) >= 3 AND contains(lower(c.text), e.normalized)
)"""
_PREDICATES = "(VALUES " + ", ".join(f"({sql_text(t)}, {sql_text(p)})" for t, p in K.PREDICATE_BY_TYPE.items()) + ") AS p(entity_type, predicate)"
_RELATIONS = f"""relations AS (
  SELECT substr(sha1(s.run_id || ':' || s.entity_id || ':' || p.predicate || ':' || o.entity_id || ':' || s.context_id), 1, 16) AS relation_id,
    s.run_id, s.entity_id AS subject_entity_id, p.predicate, o.entity_id AS object_entity_id, s.context_id AS evidence_chunk_id,
    s.source_file_id, 0.62::DOUBLE AS confidence, {_sql_snippet('s.text', 's.name')} AS evidence_text
  FROM found s JOIN found o ON o.context_id = s.context_id JOIN {_PREDICATES} ON p.entity_type = o.entity_type
  WHERE s.entity_type IN ('material', 'alloy')
)"""


@query("cooccurrence", f"WITH {_MENTIONS}, {_ENTITIES}, {_FOUND}, {_RELATIONS} SELECT * FROM relations")
def cooccurrence(spark, sf_dir):
    rows = stored(contexts(spark, sf_dir))
    found = R.entities_in_contexts(rows, stored(entities_of(spark, sf_dir, rows)))
    return R.cooccurrence_relations(found).select(
        "relation_id", "run_id", "subject_entity_id", "predicate", "object_entity_id", "evidence_chunk_id", "source_file_id", "confidence",
        "evidence_text",
    )


@query("class_rules", """
  SELECT p_partkey, unnest(list_distinct(list_filter([
      CASE WHEN low IN ('316l', '304l') THEN 'stainless steel' END, CASE WHEN low IN ('316l', '304l') THEN 'austenitic stainless steel' END,
      CASE WHEN contains(low, 'ti-6al-4v') OR contains(low, 'ti6al4v') THEN 'titanium alloy' END,
      CASE WHEN contains(low, 'alsi10mg') THEN 'aluminum alloy' END, CASE WHEN contains(low, 'inconel') THEN 'nickel superalloy' END],
      lambda x: x IS NOT NULL))) AS class_name
  FROM (SELECT p_partkey, lower(replace(['316 L', 'Inconel ' || p_size, 'Ti-6Al-4V', 'AlSi10Mg ' || p_brand, p_name][p_partkey % 5 + 1], ' ', '')) AS low FROM part)
""")
def class_rules(spark, sf_dir):
    from oreweave.functions.chem import material_classes

    names = F.array(
        F.lit("316 L"), F.concat(F.lit("Inconel "), "p_size"), F.lit("Ti-6Al-4V"), F.concat(F.lit("AlSi10Mg "), "p_brand"), F.col("p_name")
    )
    name = F.get(names, F.pmod("p_partkey", F.lit(5)).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(material_classes(name)).alias("class_name"))


_CASES = "['" + "', '".join(SIZE_CLASS_BY_LINE) + "']"
SQL_RECORDS = f"""(
  SELECT 'P' || l_suppkey AS plant, CASE WHEN l_linestatus = 'O' THEN 'Отвальные хвосты' ELSE 'Хвосты породные' END AS stream,
    {_CASES}[(l_linenumber - 1) % 7 + 1] AS size_class, sum(l_quantity) AS element28_tonnes,
    round((sum(l_extendedprice::DECIMAL(18,2)) / 10000)::DOUBLE, 1) AS element29_tonnes
  FROM lineitem GROUP BY ALL
)"""


@query("unpivot_relations", f"""
  SELECT plant || ':' || stream || ':' || size_class AS source, 'CONTAINS_LOSS' AS relation, target,
    plant || ' ' || stream || ' класс ' || size_class || ': ' || target || ' потери ' || format('{{:.1f}}', tonnes) || ' т.' AS evidence_text,
    0.95::DOUBLE AS confidence
  FROM (SELECT plant, stream, size_class, 'element28' AS target, element28_tonnes AS tonnes FROM {SQL_RECORDS}
        UNION ALL SELECT plant, stream, size_class, 'element29', element29_tonnes FROM {SQL_RECORDS}) WHERE tonnes > 0
""")
def unpivot_relations(spark, sf_dir):
    return R.loss_relations(tailings_records(spark, sf_dir))


@query("recovery_relations", """
  SELECT 'P' || l_suppkey || ':' || l_linestatus AS source,
    CASE WHEN l_returnflag = 'R' THEN 'POTENTIALLY_RECOVERABLE' ELSE 'NOT_RECOVERABLE_WITH_CURRENT_TECH' END AS relation,
    'mineralogical_forms' AS target, count(*) AS records, 0.9::DOUBLE AS confidence
  FROM lineitem GROUP BY ALL
""")
def recovery_relations(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("P"), "l_suppkey").alias("plant"), F.col("l_linestatus").alias("stream"),
        (F.col("l_returnflag") == "R").alias("extractable"),
        F.col("l_quantity").alias("element28_tonnes"), F.col("l_tax").alias("element29_tonnes"),
    )
    rows = R.recovery_relations(lines)
    return rows.groupBy("source", "relation", "target").agg(F.count("*").alias("records"), F.max("confidence").alias("confidence"))


_PHRASES = [
    "режим Флотации и измельчения", "песковая насадка гидроциклона, мельницы", "пирротина и Pnt/Cp по классу",
    "доизмельчение, дробилка и сгустителя", "классификатора и грохочения; халькопирит",
]
_DOMAIN_SQL = " UNION ALL ".join(
    f"SELECT plant, stream, size_class, {i} AS kind_no, '{kind}' AS entity_type, regexp_extract_all(text, {sql_text('(?i)' + pattern.replace(chr(92) + 'b', '').replace(chr(92) + 'w', '[' + chr(92) + 'p{L}' + chr(92) + 'p{N}_]'))}) AS names FROM lines"
    for i, (kind, pattern) in enumerate(K.DOMAIN_PATTERNS.items())
)


@query("domain_entities", f"""
  WITH lines AS (
    SELECT plant, stream, size_class, plant || ' ' || stream || ' класс ' || size_class || ': ' ||
      [{", ".join(sql_text(p) for p in _PHRASES)}][(length(plant) + length(size_class) + element28_tonnes::BIGINT) % {len(_PHRASES)} + 1] AS text FROM {SQL_RECORDS}
  ), found AS (
    SELECT plant, stream, size_class, kind_no, entity_type, generate_subscripts(names, 1) AS pos, trim(regexp_replace(unnest(names), '\\s+', ' ', 'g')) AS name
    FROM ({_DOMAIN_SQL})
  )
  SELECT entity_type, arg_min(name, (plant, stream, size_class, kind_no, pos)) AS name, lower(name) AS normalized, count(*) AS mentions,
    arg_min(plant, (plant, stream, size_class, kind_no, pos)) AS first_plant
  FROM found GROUP BY entity_type, lower(name)
""")
def domain_entities(spark, sf_dir):
    """Process, equipment, mineral and size-class names in sentences that differ from record to record."""
    turn = F.length("plant") + F.length("size_class") + F.round("element28_tonnes").cast("bigint")
    phrase = F.get(F.array(*[F.lit(p) for p in _PHRASES]), (turn % len(_PHRASES)).cast("int"))
    text = F.concat(F.concat_ws(" ", "plant", "stream"), F.lit(" класс "), "size_class", F.lit(": "), phrase)
    rows = tailings_records(spark, sf_dir).select(
        F.col("plant").alias("document_id"), F.col("plant").alias("ord1"), F.col("stream").alias("ord2"), F.col("size_class").alias("ord3"), text.alias("text")
    )
    found = E.domain_entities(rows, ["ord1", "ord2", "ord3"])
    return found.select("entity_type", "name", "normalized", "mentions", F.col("first_document_id").alias("first_plant"))


@query("relation_names", """
  SELECT c_custkey, o.n_name AS subject_name, r.n_name AS object_name
  FROM customer LEFT JOIN nation o ON o.n_nationkey = c_nationkey LEFT JOIN nation r ON r.n_nationkey = (c_custkey * 7) % 30
""")
def named_relations(spark, sf_dir):
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("entity_id"), F.col("n_name").alias("name"))
    pairs = table(spark, sf_dir, "customer").select(
        "c_custkey", F.col("c_nationkey").cast("bigint").alias("subject_entity_id"),
        F.pmod(F.col("c_custkey") * 7, F.lit(30)).cast("bigint").alias("object_entity_id"),
    )
    return relation_names(pairs, names).select("c_custkey", "subject_name", "object_name")


@query("kg_nodes_edges", f"""
  WITH r AS (SELECT * FROM {SQL_RECORDS}), edges AS (
    SELECT 'Plant:' || plant AS source, 'Stream:' || plant || ':' || stream AS target, 'HAS_STREAM' AS relation FROM (SELECT DISTINCT plant, stream FROM r)
    UNION ALL SELECT 'Stream:' || plant || ':' || stream, 'SizeClass:' || plant || ':' || stream || ':' || size_class, 'HAS_SIZE_CLASS' FROM r
    UNION ALL SELECT 'SizeClass:' || plant || ':' || stream || ':' || size_class, 'KPI:reduce_element28_loss', 'CONTRIBUTES_TO' FROM r WHERE element28_tonnes <> 0
    UNION ALL SELECT 'SizeClass:' || plant || ':' || stream || ':' || size_class, 'KPI:reduce_element29_loss', 'CONTRIBUTES_TO' FROM r WHERE element29_tonnes <> 0
  )
  SELECT 'edge' AS kind, relation AS type, source AS id, count(*) AS n FROM edges GROUP BY ALL
  UNION ALL SELECT 'node', 'Plant', 'Plant:' || plant, 1 FROM r GROUP BY plant
  UNION ALL SELECT 'node', 'TailingsStream', 'Stream:' || plant || ':' || stream, 1 FROM r GROUP BY plant, stream
  UNION ALL SELECT 'node', 'SizeClass', 'SizeClass:' || plant || ':' || stream || ':' || size_class, 1 FROM r
""")
def kg_nodes_edges(spark, sf_dir):
    rows = tailings_records(spark, sf_dir)
    nodes, edges = tailings_graph(rows.select("plant", "stream").distinct(), rows)
    node_rows = nodes.groupBy(F.lit("node").alias("kind"), "type", "id").agg(F.count("*").alias("n"))
    edge_rows = edges.groupBy(F.lit("edge").alias("kind"), F.col("relation").alias("type"), F.col("source").alias("id")).agg(F.count("*").alias("n"))
    return node_rows.unionByName(edge_rows)


_HIT_WORDS = ["ment", "hel", "sich"]


@query("graph_hits", f"""
  WITH {_MENTIONS}, {_ENTITIES}, {_FOUND}, {_RELATIONS},
  ids AS (SELECT {_ENTITY_ID} AS entity_id, name, normalized FROM entities),
  matched AS (
    SELECT w, entity_id, row_number() OVER (PARTITION BY w ORDER BY entity_id) AS n
    FROM (SELECT DISTINCT w, entity_id FROM ids, (SELECT unnest({sql_list(_HIT_WORDS)}) AS w) WHERE contains(lower(name), w) OR contains(normalized, w))
  ), chosen AS (SELECT DISTINCT entity_id FROM matched WHERE n <= 8 ORDER BY entity_id LIMIT 8),
  hits AS (
    SELECT c.entity_id, r.*, row_number() OVER (PARTITION BY c.entity_id ORDER BY relation_id) AS n
    FROM chosen c JOIN relations r ON c.entity_id IN (r.subject_entity_id, r.object_entity_id)
  )
  SELECT relation_id, predicate, s.name AS subject_name, o.name AS object_name
  FROM (SELECT * FROM hits WHERE n <= 8 ORDER BY entity_id, relation_id LIMIT 8) h
  LEFT JOIN ids s ON s.entity_id = h.subject_entity_id LEFT JOIN ids o ON o.entity_id = h.object_entity_id
""")
def graph_hits(spark, sf_dir):
    from oreweave.operators.retrieval import graph_hits as search

    rows = stored(contexts(spark, sf_dir))
    entities = stored(entities_of(spark, sf_dir, rows))
    relations = R.cooccurrence_relations(R.entities_in_contexts(rows, entities, evidence=False))  # no column of it is asked for
    return search(entities, relations, " ".join(_HIT_WORDS)).select("relation_id", "predicate", "subject_name", "object_name")
