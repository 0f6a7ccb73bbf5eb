"""Ledger, job and upsert queries. ``documents.source`` is the run, ``events`` are job records."""

from __future__ import annotations

from pyspark.sql import functions as F

from oreweave.functions.hashing import stable_id
from oreweave.operators.dedupe import keep_first, top_n, unseen, upsert
from oreweave.operators.scans import consecutive_run, forward_fill, islands
from oreweave.plans import corpus
from oreweave.plans.registry import query, sql_chunks
from oreweave.sinks import exports, ledger
from oreweave.tables import table

_CHUNKS = f"(SELECT * FROM {sql_chunks(corpus.SQL_DOCUMENTS, 'run_id, source_file_id')})"


@query("document_overview", f"""
  SELECT d.run_id, d.source_file_id, d.title, length(d.text) AS text_chars, coalesce(c.n, 0) AS chunk_count
  FROM {corpus.SQL_DOCUMENTS} d LEFT JOIN (SELECT run_id, source_file_id, count(*) AS n FROM {_CHUNKS} GROUP BY ALL) c
    ON c.run_id = d.run_id AND c.source_file_id = d.source_file_id
""")
def document_overview(spark, sf_dir):
    docs = corpus.documents(spark, sf_dir)
    out = ledger.document_overview(docs.select("run_id", "source_file_id"), docs.select("source_file_id", "title", "text"), corpus.chunks(spark, sf_dir))
    return out.select("run_id", "source_file_id", "title", "text_chars", "chunk_count")


_RUNS = "(SELECT DISTINCT source AS run_id FROM documents UNION SELECT 'empty' AS run_id)"


def _runs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("source").alias("run_id")).distinct().unionByName(
        spark.range(1).select(F.lit("empty").alias("run_id"))
    )


def _run_tables(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("run_id"))
    labels = table(spark, sf_dir, "labels").join(docs, "doc_id")
    return {
        "documents": docs,
        "chunks": corpus.chunks(spark, sf_dir),
        "labelled": labels,
        "toxic": labels.where(F.col("toxic") == 1),
    }


@query("run_summary", f"""
  SELECT r.run_id, (SELECT count(*) FROM documents WHERE source = r.run_id) AS documents,
    (SELECT count(*) FROM {_CHUNKS} c WHERE c.run_id = r.run_id) AS chunks,
    (SELECT count(*) FROM labels JOIN documents USING (doc_id) WHERE source = r.run_id) AS labelled,
    (SELECT count(*) FROM labels JOIN documents USING (doc_id) WHERE source = r.run_id AND toxic = 1) AS toxic
  FROM {_RUNS} r
""")
def run_summary(spark, sf_dir):
    return ledger.run_summary(_runs(spark, sf_dir), _run_tables(spark, sf_dir))


@query("runs_with_chunks", f"""
  SELECT r.run_id, count(*) AS chunks, (SELECT count(*) FROM documents WHERE source = r.run_id) AS documents, count(*) FILTER (c.chunk_index = 0) AS kg_embeddings
  FROM {_RUNS} r JOIN {_CHUNKS} c ON c.run_id = r.run_id GROUP BY r.run_id
""")
def runs_with_chunks(spark, sf_dir):
    tables = _run_tables(spark, sf_dir)
    return ledger.runs_with_chunks(_runs(spark, sf_dir), tables["documents"], tables["chunks"], tables["chunks"].where("chunk_index = 0"))


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events")


@query("latest_status", "SELECT DISTINCT ON (user_id) user_id, event_id, event_type AS status FROM events ORDER BY user_id, ts DESC, event_id DESC")
def latest_status(spark, sf_dir):
    rows = ledger.latest_status(_events(spark, sf_dir), ["user_id"], [F.desc("ts"), F.desc("event_id")])
    return rows.select("user_id", "event_id", F.col("event_type").alias("status"))


@query("job_status_matrix", "SELECT user_id % 7 AS stage, event_type AS status, count(*) AS count FROM events GROUP BY ALL")
def job_status_matrix(spark, sf_dir):
    jobs = _events(spark, sf_dir).select(F.pmod("user_id", F.lit(7)).alias("stage"), F.col("event_type").alias("status"))
    return ledger.job_matrix(jobs)


@query("final_status", """
  SELECT run_id, CASE WHEN sum(bad) > 0 THEN 'completed_degraded' ELSE 'completed' END AS status FROM (
    SELECT user_id AS run_id, (event_type = 'error' AND value > 60 OR event_type = 'click' AND value > 75)::INT AS bad FROM events) GROUP BY run_id
""")
def final_status(spark, sf_dir):
    events = _events(spark, sf_dir).select(F.col("user_id").alias("run_id"), "event_type", "value")
    jobs = events.select("run_id", F.when((F.col("event_type") == "error") & (F.col("value") > 60), "failed").otherwise("completed").alias("status"))
    artifacts = events.select("run_id", F.when((F.col("event_type") == "click") & (F.col("value") > 75), "skipped").otherwise("completed").alias("status"))
    return ledger.final_status(jobs, artifacts, events.select("run_id").distinct())


@query("active_jobs", "SELECT user_id, count(*) AS active FROM events WHERE event_type IN ('click', 'view') GROUP BY user_id")
def active_jobs(spark, sf_dir):
    return _events(spark, sf_dir).where(F.col("event_type").isin("click", "view")).groupBy("user_id").agg(F.count("*").alias("active"))


@query("resume_anti", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def resume_anti(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    seen = table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == "R").select(F.col("l_orderkey").alias("o_orderkey"))
    return unseen(orders, seen, ["o_orderkey"])


@query("upsert", """
  SELECT DISTINCT ON (key) key, event_id, value FROM (
    SELECT user_id || ':' || event_type AS key, event_id, value, 0 AS gen FROM events WHERE event_id % 3 <> 0
    UNION ALL SELECT user_id || ':' || event_type, event_id, value * 2, 1 FROM events WHERE event_id % 3 = 0
  ) ORDER BY key, gen DESC, event_id DESC
""")
def upserted(spark, sf_dir):
    """Two generations of records by key; the newer generation wins."""
    key = F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("key")
    old, new = F.col("event_id") % 3 != 0, F.col("event_id") % 3 == 0
    current = _events(spark, sf_dir).where(old).select(key, "event_id", "value", F.lit(0).alias("gen"))
    changes = _events(spark, sf_dir).where(new).select(key, "event_id", (F.col("value") * 2).alias("value"), F.lit(1).alias("gen"))
    return upsert(current, changes, ["key"], [F.desc("gen"), F.desc("event_id")]).drop("gen")


@query("stable_ids", """
  SELECT doc_id, substr(sha1(source || ':' || lang || '/' || doc_id || '.txt'), 1, 16) AS file_id,
    ('0x' || substr(sha1(substr(sha1(source || ':' || doc_id), 1, 16)), 1, 16))::UBIGINT::DECIMAL(20,0) AS point_id
  FROM documents
""")
def stable_ids(spark, sf_dir):
    from oreweave.functions.hashing import point_id

    docs = table(spark, sf_dir, "documents")
    path = F.concat(F.col("lang"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return docs.select(
        "doc_id", stable_id(F.col("source"), path).alias("file_id"),
        point_id(stable_id(F.col("source"), F.col("doc_id"))).alias("point_id"),
    )


@query("record_offsets", """
  SELECT user_id, event_id, (SELECT count(*) FROM events o WHERE o.user_id = e.user_id AND o.event_type <> 'purchase')
    + row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS record_index
  FROM events e WHERE event_type = 'purchase'
""")
def record_offsets(spark, sf_dir):
    """Appended records continue the numbering of the records a file already has."""
    rows = _events(spark, sf_dir).select(
        F.lit("r").alias("run_id"), F.col("user_id").cast("string").alias("source_file_id"), F.lit("x").alias("record_type"),
        F.col("event_id").cast("string").alias("payload"), F.col("event_id").alias("position"), "event_type",
    )
    existing = rows.where(F.col("event_type") != "purchase")
    numbered = ledger.record_rows(
        rows.where(F.col("event_type") == "purchase").drop("event_type"), existing, F.floor(F.col("position") / 1024)
    )
    return numbered.select(
        F.col("source_file_id").cast("bigint").alias("user_id"), F.col("payload").cast("bigint").alias("event_id"),
        F.col("record_index").cast("bigint").alias("record_index"),
    )


@query("topn_per_group", """
  SELECT l_suppkey, l_linenumber, l_orderkey FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_linenumber ORDER BY l_orderkey, l_partkey, l_extendedprice) <= 2
""")
def topn_per_group(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_linenumber", "l_orderkey", "l_partkey", "l_extendedprice")
    order = [F.asc("l_orderkey"), F.asc("l_partkey"), F.asc("l_extendedprice")]
    return top_n(rows, ["l_suppkey", "l_linenumber"], order, 2).select("l_suppkey", "l_linenumber", "l_orderkey")


@query("first_event", "SELECT DISTINCT ON (user_id, event_type) user_id, event_type, event_id FROM events ORDER BY user_id, event_type, ts, event_id")
def first_event(spark, sf_dir):
    rows = keep_first(_events(spark, sf_dir), ["user_id", "event_type"], [F.asc("ts"), F.asc("event_id")])
    return rows.select("user_id", "event_type", "event_id")


# Ordered scans over event streams: a block is one day of a user.


def _stream(spark, sf_dir):
    return _events(spark, sf_dir).select("user_id", "event_id", "event_type", "value", "ts")


def _day():
    return F.date_trunc("DAY", F.col("ts"))


@query("forward_fill", """
  SELECT user_id, event_id, last_value(CASE WHEN event_type IN ('signup', 'purchase') THEN event_type END IGNORE NULLS)
    OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS state
  FROM events
""")
def filled_state(spark, sf_dir):
    rows = _stream(spark, sf_dir).withColumn("mark", F.when(F.col("event_type").isin("signup", "purchase"), F.col("event_type")))
    return forward_fill(rows, ["user_id"], ["ts", "event_id"], _day(), "mark", "state").select("user_id", "event_id", "state")


_RUNS_OF = """marked AS (
  SELECT *, CASE WHEN kind IS DISTINCT FROM lag(kind) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS start
  FROM (SELECT user_id, event_id, ts, {label} AS kind FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
), numbered AS (
  SELECT *, sum(start) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM marked
)"""


@query("event_islands", f"""
  WITH {_RUNS_OF.format(label="event_type")}
  SELECT user_id, island, kind AS event_type, count(*) AS rows FROM numbered GROUP BY ALL
""")
def event_islands(spark, sf_dir):
    rows = islands(_stream(spark, sf_dir), ["user_id"], ["ts", "event_id"], _day(), F.col("event_type"))
    return rows.groupBy("user_id", "island", "event_type").agg(F.count("*").alias("rows"))


@query("skip_streak", f"""
  WITH {_RUNS_OF.format(label="event_type = 'error'")}
  SELECT user_id, event_id, CASE WHEN kind THEN row_number() OVER (PARTITION BY user_id, island ORDER BY ts, event_id) ELSE 0 END AS streak FROM numbered
""")
def skip_streak(spark, sf_dir):
    """Consecutive failed requests at each point, the counter an exporter stops on."""
    rows = consecutive_run(_stream(spark, sf_dir), ["user_id"], ["ts", "event_id"], _day(), F.col("event_type") == "error", "streak")
    return rows.select("user_id", "event_id", "streak")


@query("conversation_state", """
  SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN md5(text) END IGNORE NULLS)
    OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS question_md5
  FROM conversations
""")
def conversation_state(spark, sf_dir):
    """The last user message at or above every turn, as a workbook row carries its stream label down."""
    rows = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.when(F.col("role") == "user", F.md5(F.encode("text", "UTF-8"))).alias("mark")
    )
    filled = forward_fill(rows, ["conv_id"], ["turn"], F.floor(F.col("turn") / 4), "mark", "question_md5")
    return filled.select("conv_id", "turn", "question_md5")


# Exports -----------------------------------------------------------------------------------


@query("output_names", """
  SELECT doc_id, flat || CASE WHEN rn > 1 THEN '_' || (rn - 1) ELSE '' END || '.md' AS output_name FROM (
    SELECT doc_id, flat, row_number() OVER (PARTITION BY flat ORDER BY relative_path, doc_id) AS rn FROM (
      SELECT doc_id, 'corpus/' || doc_id // 3 || '.' || ['txt', 'pdf', 'md'][doc_id % 3 + 1] AS relative_path, 'corpus__' || doc_id // 3 AS flat FROM documents))
""")
def output_names(spark, sf_dir):
    """Three files share each name and differ by extension, so every group of clashes has three rows."""
    ext = F.get(F.array(F.lit("txt"), F.lit("pdf"), F.lit("md")), F.pmod("doc_id", F.lit(3)).cast("int"))
    stem = F.floor(F.col("doc_id") / 3).cast("string")
    files = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("corpus/"), stem, F.lit("."), ext).alias("relative_path"))
    return exports.flat_output_names(files, ["relative_path", "doc_id"]).select("doc_id", "output_name")


@query("run_log", """
  SELECT event_id, result, strftime(ts, '%Y-%m-%d %H:%M:%S') || ' | ' || rpad(event_id::VARCHAR, 42, ' ') || ' | ' || lpad(size, 10, ' ')
    || ' | ' || rpad('text-copy', 26, ' ') || ' | ' || rpad(result, 9, ' ') || ' | ' || note AS line
  FROM (SELECT *, CASE WHEN event_type = 'view' THEN 'SKIPPED' WHEN event_type = 'error' THEN 'ERROR' ELSE 'OK' END AS result,
    CASE WHEN event_type = 'view' THEN 'too big' WHEN event_type = 'error' THEN 'failed' ELSE '' END AS note,
    CASE WHEN bytes < 1024 THEN bytes || ' B' ELSE printf('%.1f KB', bytes / 1024.0) END AS size
    FROM (SELECT *, (event_id * 37 % 900000)::BIGINT AS bytes FROM events))
""")
def run_log(spark, sf_dir):
    kind = F.col("event_type")
    rows = _events(spark, sf_dir).select(
        F.col("event_id").cast("string").alias("path"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        (F.col("event_id") * 37 % 900000).cast("bigint").alias("bytes"), F.lit("text-copy").alias("processor"),
        (kind != "error").alias("ok"), F.when(kind == "view", "too big").alias("skipped_reason"),
        F.when(kind == "error", "failed").alias("error"),
    )
    return exports.run_log_lines(rows).select(F.col("path").cast("bigint").alias("event_id"), "result", "line")


@query("harvest_caps", """
  WITH works AS (SELECT o_orderpriority AS query, o_custkey AS work_id, o_orderkey AS position, dense_rank() OVER (ORDER BY o_orderpriority) AS qi FROM orders),
  fresh AS (SELECT * FROM works WHERE work_id NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')),
  firsts AS (SELECT DISTINCT ON (work_id) * FROM fresh ORDER BY work_id, qi, position),
  capped AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY position) AS rn FROM firsts)
  SELECT query, work_id, position FROM capped WHERE rn <= 40 ORDER BY qi, position LIMIT 150
""")
def harvest_caps(spark, sf_dir):
    """Literature harvest: unseen works once each, at most 40 per query and 150 in all."""
    works = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("query"), F.substring("o_orderpriority", 1, 1).alias("query_index"),
        F.col("o_orderkey").alias("position"), F.col("o_custkey").alias("work_id"),
    )
    seen = table(spark, sf_dir, "customer").where(F.col("c_mktsegment") == "BUILDING").select(F.col("c_custkey").alias("work_id"))
    return exports.capped_export(works, seen, 40, 150).select("query", "work_id", "position")


@query("harvest_manifest", """
  SELECT CASE WHEN count(*) FILTER (event_type = 'error') > 0 THEN 'completed_degraded' ELSE 'completed' END AS status,
    count(*) FILTER (event_type = 'purchase') AS records_written, count(*) FILTER (event_type NOT IN ('purchase', 'error')) AS skipped_existing,
    count(*) FILTER (event_type = 'error') AS failed_pages FROM events
""")
def harvest_manifest(spark, sf_dir):
    events = _events(spark, sf_dir)
    kind = F.col("event_type")
    parts = [events.where(kind == "purchase"), events.where(~kind.isin("purchase", "error")), events.where(kind == "error")]
    return exports.export_manifest(*parts, status="completed").drop("settings")
