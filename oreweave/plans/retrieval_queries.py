"""Retrieval and research queries. The query strings are parameters; the corpus tables are read whole."""

from __future__ import annotations

from pyspark.sql import functions as F

from oreweave import constants as K
from oreweave.operators import retrieval as Rt
from oreweave.operators.dedupe import overfetch_top_k
from oreweave.operators.embeddings import bucket_weights, embed, embed_query
from oreweave.operators.research import citations, merge_web_results, pool_evidence, slot_merge, web_evidence
from oreweave.operators.tfidf import document_scores
from oreweave.plans import corpus
from oreweave.plans.registry import query, sql_chunks, sql_sum_contains, sql_text
from oreweave.session import stored
from oreweave.tables import spread, table

QUESTION = "the thin nickel ering with tion that oreau"
SUB_QUERIES = ["that with the ering", "elle sich tion", "orantion from hehely"]
_TOKEN = r"[a-zа-яё0-9][a-zа-яё0-9+\-_/]{1,}"


@query("keyword_rank", f"""
  SELECT doc_id, score FROM (
    SELECT doc_id, {sql_sum_contains('lower(text)', Rt.lexical_terms(QUESTION))} / {len(Rt.lexical_terms(QUESTION))}::DOUBLE AS score FROM documents
  ) WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 50
""")
def keyword_rank(spark, sf_dir):
    return Rt.top_k(Rt.keyword_presence(spread(table(spark, sf_dir, "documents")), ["doc_id"], "text", QUESTION), 50, tie=["doc_id"])


_TF_WORDS = [w.lower() for w in "ononst hehely keit sich".split() if len(w) > 2]
_COUNTS = " + ".join(f"((length(lower(text)) - length(replace(lower(text), {sql_text(w)}, ''))) / {len(w)})::BIGINT" for w in _TF_WORDS)


@query("keyword_tf", f"""
  SELECT doc_id, least(1.0, ({_COUNTS}) / {len(_TF_WORDS)}::DOUBLE) AS score FROM documents WHERE ({_COUNTS}) > 0
""")
def keyword_tf(spark, sf_dir):
    return Rt.keyword_frequency(spread(table(spark, sf_dir, "documents")), ["doc_id"], "text", " ".join(_TF_WORDS))


def _sql_tfidf(source: str, key: str, text: str, question: str) -> str:
    grams = (
        "list_concat(tok, list_transform(range(1, len(tok)), lambda i: tok[i] || ' ' || tok[i + 1]))"
    )
    return f"""docs AS (
      SELECT {key}, regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS tok FROM {source}
    ), counts AS (
      SELECT {key}, term, count(*) AS tf FROM (SELECT {key}, unnest({grams}) AS term FROM docs) GROUP BY ALL
    ), vocab AS (
      SELECT term, ln((1.0 + (SELECT count(*) FROM docs)) / (1.0 + count(*))) + 1.0 AS idf
      FROM counts GROUP BY term ORDER BY sum(tf) DESC, term LIMIT {K.TFIDF_MAX_FEATURES}
    ), asked AS (
      SELECT term, count(*) AS qtf FROM (
        SELECT unnest({grams}) AS term FROM (SELECT regexp_extract_all(lower({sql_text(question)}), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS tok)) GROUP BY term
    ), q AS (SELECT v.term, v.idf, coalesce(qtf, 0) * v.idf AS qw FROM vocab v LEFT JOIN asked USING (term)),
    scored AS (
      SELECT {key}, sum(tf * idf * qw) / (sqrt(sum((tf * idf) * (tf * idf))) * (SELECT sqrt(sum(qw * qw)) FROM q)) AS score
      FROM counts JOIN q USING (term) GROUP BY {key}
    )"""


@query("tfidf_topk", f"""
  WITH {_sql_tfidf('documents', 'doc_id', 'text', QUESTION)}
  SELECT doc_id, round(score, 6) AS score FROM scored WHERE score > 0 ORDER BY round(score, 6) DESC, doc_id LIMIT 100
""")
def tfidf_topk(spark, sf_dir):
    scores = document_scores(table(spark, sf_dir, "documents"), ["doc_id"], QUESTION)
    return Rt.top_k(scores.withColumn("score", F.round("score", 6)), 100, tie=["doc_id"])


_CHUNKS = f"""chunks AS (
  SELECT source_file_id || ':chunk:' || chunk_index AS chunk_id, chunk_text AS text, run_id, source_file_id, chunk_index
  FROM {sql_chunks(corpus.SQL_DOCUMENTS, 'run_id, source_file_id')})"""
_HYBRID = f"""WITH {_CHUNKS}, {_sql_tfidf('chunks', 'chunk_id', 'text', QUESTION)}, vec AS (
    SELECT chunk_id, score AS v FROM scored WHERE score > 0 ORDER BY round(score, 9) DESC, chunk_id LIMIT 16
  ), kw AS (
    SELECT chunk_id, w FROM (SELECT chunk_id, {sql_sum_contains('lower(text)', Rt.lexical_terms(QUESTION))} / {len(Rt.lexical_terms(QUESTION))}::DOUBLE AS w FROM chunks)
    WHERE w > 0 ORDER BY w DESC, chunk_id LIMIT 16
  ), merged AS (
    SELECT chunk_id, round(coalesce(v, 0), 6) AS vector_score, round(coalesce(w, 0), 6) AS keyword_score,
      round(0.65 * coalesce(v, 0) + 0.35 * coalesce(w, 0), 6) AS score
    FROM vec FULL OUTER JOIN kw USING (chunk_id)
  )"""


@query("hybrid_search", f"{_HYBRID} SELECT * FROM merged ORDER BY score DESC, chunk_id LIMIT 8")
def hybrid_search(spark, sf_dir):
    scores = Rt.hybrid_scores(corpus.chunks(spark, sf_dir), ["chunk_id"], "text", QUESTION, 8)
    rounded = scores.select("chunk_id", *[F.round(c, 6).alias(c) for c in ("vector_score", "keyword_score", "score")])
    return Rt.top_k(rounded, 8, tie=["chunk_id"])


_ALIASES_28 = K.ELEMENT_QUERY_TOKENS["element28"]


@query("metadata_filter", f"""
  WITH hay AS (SELECT doc_id, source, lower(text || ' ' || lang || ' ' || to_json({{'source': source, 'lang': lang}})) AS h, lang FROM documents)
  SELECT doc_id, source FROM hay
  WHERE (lang IN ('txt') OR contains(h, 'txt') OR contains(h, 'pdf'))
     OR (({' OR '.join(f'contains(h, {sql_text(w)})' for w in _ALIASES_28)}) AND contains(replace(h, ' ', ''), '-4'))
     OR ({' OR '.join(f'contains(h, {sql_text(w)})' for w in K.ELEMENT_QUERY_TOKENS['element29'])})
""")
def metadata_filter(spark, sf_dir):
    """Documents that pass any of three facet filters."""
    docs = spread(table(spark, sf_dir, "documents"))
    text, lang = F.col("text"), F.col("lang")
    metadata = F.to_json(F.struct("source", "lang"))
    typed = Rt.accepts(Rt.asked_for("pdf or txt sources"), text, lang, metadata)
    sized = Rt.accepts(Rt.asked_for("losses of элемент 28 in class -4"), text, lang, metadata)
    copper = Rt.accepts(Rt.asked_for("losses of элемент 29"), text, lang, metadata)
    return docs.where(typed | sized | copper).select("doc_id", "source")


_ELEMENT_SIGNS = " OR ".join(f"contains(lower(text), {sql_text(w)})" for words in K.ELEMENT_QUERY_TOKENS.values() for w in words)


def _filtered_sql(label: str, test: str) -> str:
    return f"""SELECT '{label}' AS search, chunk_id, score, NOT bool_or({test}) OVER () AS filter_relaxed FROM merged JOIN chunks USING (chunk_id)
      QUALIFY ({test}) OR filter_relaxed"""


@query("filter_retry", f"""
  {_HYBRID},
  filtered AS ({_filtered_sql('none', 'false')} UNION ALL {_filtered_sql('some', _ELEMENT_SIGNS)})
  SELECT * FROM filtered QUALIFY row_number() OVER (PARTITION BY search ORDER BY score DESC, chunk_id) <= 8
""")
def filter_retry(spark, sf_dir):
    """A plant filter no chunk satisfies falls back to all hits, an element filter keeps what it accepts."""
    chunks = corpus.chunks(spark, sf_dir)
    scores = Rt.hybrid_scores(chunks, ["chunk_id"], "text", QUESTION, 8).withColumn("score", F.round("score", 6))
    hits = stored(chunks.join(F.broadcast(scores.select("chunk_id", "score")), "chunk_id"))  # at most 32 rows, for both filters
    elements = frozenset(("element", e) for e in ("element28", "element29"))
    out = []
    for label, wanted in (("none", Rt.asked_for("КГМК")), ("some", elements)):
        accept = Rt.accepts(wanted, F.col("text"), F.lit(""), F.lit("{}"))
        best = Rt.filtered_or_all(hits, accept, [F.desc("score"), F.asc("chunk_id")], 8)
        out.append(best.select(F.lit(label).alias("search"), "chunk_id", "score", "filter_relaxed"))
    return out[0].unionByName(out[1])


# Embeddings --------------------------------------------------------------------------------

_BUCKET = "(('0x' || substr(sha1(tok), 1, 16))::UBIGINT % 384)::BIGINT"
_HASHED = f"""tokens AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{_TOKEN}')) AS tok FROM documents),
  cells AS (SELECT doc_id, {_BUCKET} AS bucket, count(*)::DOUBLE AS n FROM tokens GROUP BY ALL),
  norms AS (SELECT doc_id, sqrt(sum(n * n)) AS norm FROM cells GROUP BY doc_id)"""


@query("hash_embedding", f"WITH {_HASHED} SELECT doc_id, bucket, round(n / norm, 6) AS weight FROM cells JOIN norms USING (doc_id)")
def hash_embedding(spark, sf_dir):
    cells = bucket_weights(table(spark, sf_dir, "documents"), ["doc_id"])
    return cells.select("doc_id", "bucket", F.round("weight", 6).alias("weight"))


_HASH_QUERY = "thatin hehely orantion elle sich"


@query("hash_search", f"""
  WITH {_HASHED}, q AS (
    SELECT bucket, n / sqrt(sum(n * n) OVER ()) AS w FROM (
      SELECT {_BUCKET} AS bucket, count(*)::DOUBLE AS n FROM (SELECT unnest(regexp_extract_all({sql_text(_HASH_QUERY)}, '{_TOKEN}')) AS tok) GROUP BY 1)
  )
  SELECT doc_id, round(sum(n / norm * w), 6) AS score FROM cells JOIN norms USING (doc_id) JOIN q USING (bucket)
  GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 20
""")
def hash_search(spark, sf_dir):
    vectors = embed(table(spark, sf_dir, "documents"), ["doc_id"])
    scores = Rt.vector_scores(vectors, ["doc_id"], "embedding", embed_query(_HASH_QUERY), normalized=True)
    return Rt.top_k(scores.withColumn("score", F.round("score", 6)), 20, tie=["doc_id"])


# A fixed 64-dimensional query direction.
QUERY_VECTOR = {i: ((i * 37) % 17 - 8) / 10.0 for i in range(64) if (i * 37) % 17 != 8}
_QNORM = sum(w * w for w in QUERY_VECTOR.values()) ** 0.5
_DOT = " + ".join(f"embedding[{i + 1}]::DOUBLE * {w / _QNORM!r}::DOUBLE" for i, w in sorted(QUERY_VECTOR.items()))
_SCORED = f"""scored AS (
  SELECT vec_id, label, round(({_DOT}) / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS score FROM embeddings)"""


def _scored(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return Rt.vector_scores(rows, ["vec_id", "label"], "embedding", QUERY_VECTOR, normalized=False).withColumn("score", F.round("score", 6))


@query("vector_topk", f"WITH {_SCORED} SELECT vec_id, score FROM scored WHERE score > 0 ORDER BY score DESC, vec_id LIMIT 20")
def vector_topk(spark, sf_dir):
    return Rt.top_k(_scored(spark, sf_dir).where(F.col("score") > 0), 20, tie=["vec_id"]).select("vec_id", "score")


@query("overfetch_topk", f"""
  WITH {_SCORED}, pool AS (SELECT * FROM scored ORDER BY score DESC, vec_id LIMIT 64)
  SELECT vec_id, label, score FROM pool WHERE score > 0 AND label % 2 = 0 ORDER BY score DESC, vec_id LIMIT 8
""")
def overfetch(spark, sf_dir):
    return overfetch_top_k(_scored(spark, sf_dir), "score", ["vec_id"], 8, F.col("label") % 2 == 0)


@query("multi_collection_topk", f"""
  WITH {_SCORED} SELECT label, vec_id, score FROM scored
  QUALIFY row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) <= 5
""")
def multi_collection_topk(spark, sf_dir):
    return Rt.per_collection_top_k(_scored(spark, sf_dir), 5, ["vec_id"], by="label").select("label", "vec_id", "score")


@query("hydrate_hits", f"""
  WITH {_CHUNKS}, {_SCORED}, hits AS (
    SELECT ['chunks', 'documents', 'entities'][vec_id % 3 + 1] AS target_type, vec_id, score FROM scored ORDER BY score DESC, vec_id LIMIT 30
  )
  SELECT 'kg:chunk:' || chunk_id AS evidence_id, substring(text, 1, 900) AS text, source_file_id AS source_id, chunk_index::VARCHAR AS section, least(1.0, greatest(0.0, score)) AS relevance
  FROM hits JOIN chunks ON target_type = 'chunks' AND chunk_id = vec_id || ':chunk:0'
  UNION ALL
  SELECT 'kg:document:' || source_file_id, substring(title || chr(10) || text, 1, 900), source_file_id, 'document', least(1.0, greatest(0.0, score))
  FROM hits JOIN {corpus.SQL_DOCUMENTS} d ON target_type = 'documents' AND source_file_id = vec_id::VARCHAR
  UNION ALL
  SELECT 'kg:entity:' || p_partkey, 'material: ' || p_name || '.', p_partkey::VARCHAR, p_partkey::VARCHAR, least(1.0, greatest(0.0, score))
  FROM hits JOIN part ON target_type = 'entities' AND p_partkey = vec_id
""")
def hydrate_hits(spark, sf_dir):
    kinds = F.array(F.lit("chunks"), F.lit("documents"), F.lit("entities"))
    kind = F.get(kinds, F.pmod("vec_id", F.lit(3)).cast("int"))
    target = F.when(kind == "chunks", F.concat(F.col("vec_id").cast("string"), F.lit(":chunk:0"))).otherwise(F.col("vec_id").cast("string"))
    hits = Rt.top_k(_scored(spark, sf_dir), 30, tie=["vec_id"]).select(kind.alias("target_type"), target.alias("target_id"), "score")
    entities = table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("entity_id"), F.lit("material").alias("entity_type"), F.col("p_name").alias("name"),
        F.lit(None).cast("string").alias("first_source_file_id"),
    )
    evidence = Rt.hydrate(hits, corpus.chunks(spark, sf_dir), corpus.documents(spark, sf_dir), entities)
    return evidence.select("evidence_id", "text", "source_id", "section", "relevance")


# Research ----------------------------------------------------------------------------------


def _lexical_words(question: str) -> list[str]:
    import re

    return re.findall(K.QUERY_TOKEN_PATTERN, question.lower())


def _sql_share(column: str, question: str) -> str:
    words = _lexical_words(question)
    return f"{sql_sum_contains(column, words)} / {len(words)}::DOUBLE"


@query("kg_search", f"""
  WITH {_CHUNKS}, rows AS (
    SELECT 'kg:chunk:' || chunk_id AS evidence_id, text FROM chunks
    UNION ALL SELECT 'kg:section:' || source_file_id, title || chr(10) || text FROM {corpus.SQL_DOCUMENTS}
  )
  SELECT evidence_id, substring(text, 1, 900) AS text, score AS relevance
  FROM (SELECT *, {_sql_share('lower(text)', QUESTION)} AS score FROM rows) WHERE score > 0 ORDER BY score DESC, evidence_id LIMIT 12
""")
def kg_search(spark, sf_dir):
    documents = corpus.documents(spark, sf_dir)
    rows = corpus.chunks(spark, sf_dir).select(F.concat(F.lit("kg:chunk:"), "chunk_id").alias("evidence_id"), "text").unionByName(
        documents.select(F.concat(F.lit("kg:section:"), "source_file_id").alias("evidence_id"), F.concat_ws("\n", "title", "text").alias("text"))
    )
    best = Rt.top_k(Rt.lexical_search(rows, "text", QUESTION), 12, tie=["evidence_id"])
    return best.select("evidence_id", F.substring("text", 1, K.EVIDENCE_CHARS).alias("text"), F.col("score").alias("relevance"))


_STEPS = " UNION ALL ".join(
    f"(SELECT chunk_id AS evidence_id, {i} AS step, row_number() OVER (ORDER BY relevance DESC, chunk_id) AS position, relevance FROM "
    f"(SELECT chunk_id, {_sql_share('lower(text)', q)} AS relevance FROM chunks) WHERE relevance > 0 ORDER BY relevance DESC, chunk_id LIMIT 40)"
    for i, q in enumerate(SUB_QUERIES)
)
_POOL = f"pooled AS (SELECT DISTINCT ON (evidence_id) evidence_id, step, relevance FROM ({_STEPS}) ORDER BY evidence_id, relevance DESC, step, position)"


def _pooled(spark, sf_dir):
    """All sub-queries scored in one pass over the chunks, the 40 best of each pooled."""
    chunks = corpus.chunks(spark, sf_dir).select("chunk_id", "text")
    best = Rt.batch_lexical_search(chunks, ["chunk_id"], "text", SUB_QUERIES, 40)
    return pool_evidence(best.select(
        F.col("chunk_id").alias("evidence_id"), F.col("query").alias("step"), "position", F.col("score").alias("relevance")
    ))


@query("pool_evidence", f"WITH {_CHUNKS}, {_POOL} SELECT * FROM pooled")
def pooled_evidence(spark, sf_dir):
    return _pooled(spark, sf_dir).select("evidence_id", "step", "relevance")


_WEB = """web AS (
  SELECT DISTINCT ON (link) 'web:' || substr(sha1(link), 1, 16) AS evidence_id, greatest(0.2::DOUBLE, 0.6::DOUBLE - 0.04::DOUBLE * rank) AS relevance, link FROM (
    SELECT url AS link, page_id % 12 AS rank FROM pages) ORDER BY link, relevance DESC, evidence_id)"""


@query("slot_merge", f"""
  WITH {_CHUNKS}, {_POOL}, {_WEB}, w AS (
    SELECT evidence_id, relevance, 1 AS is_web, row_number() OVER (ORDER BY relevance DESC, evidence_id) AS position FROM web
    QUALIFY position <= 6
  ), c AS (
    SELECT evidence_id, relevance, 0 AS is_web, row_number() OVER (ORDER BY relevance DESC, evidence_id) AS position FROM pooled
    QUALIFY position <= 12 - (SELECT count(*) FROM w)
  )
  SELECT row_number() OVER (ORDER BY is_web, position)::INT AS n, evidence_id, round_even(relevance, 3) AS relevance FROM (SELECT * FROM w UNION ALL SELECT * FROM c)
""")
def slots(spark, sf_dir):
    """Citation list: pooled corpus evidence with slots reserved for web results (the pages table)."""
    results = table(spark, sf_dir, "pages").select(
        F.lit("glm").alias("backend"), F.pmod("page_id", F.lit(12)).alias("rank"), F.col("url").alias("link"),
        F.col("url").alias("title"), F.lit("").alias("content"), F.lit("").alias("published"),
    )
    web = merge_web_results(web_evidence(results)).select("evidence_id", "relevance")
    corpus_hits = _pooled(spark, sf_dir).select("evidence_id", "relevance")
    return citations(slot_merge(corpus_hits, web, 12, 6)).select("n", "evidence_id", "relevance")


@query("web_dedupe", f"WITH {_WEB} SELECT evidence_id, link AS filename, relevance FROM web")
def web_dedupe(spark, sf_dir):
    results = table(spark, sf_dir, "pages").select(
        F.lit("glm").alias("backend"), F.pmod("page_id", F.lit(12)).alias("rank"), F.col("url").alias("link"),
        F.col("url").alias("title"), F.lit("").alias("content"), F.lit("").alias("published"),
    )
    return merge_web_results(web_evidence(results)).select("evidence_id", "filename", "relevance")
