"""Document-processing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from oreweave import constants as K
from oreweave.functions import text as T
from oreweave.functions import urls as U
from oreweave.functions.hashing import sha256
from oreweave.operators.chunking import chunk_documents
from oreweave.operators.dedupe import keep_first, keep_first_ci
from oreweave.operators.layout import document_lines, fallback_sections, formula_records, table_records
from oreweave.sources.files import decoded_text
from oreweave.plans.registry import BLANKS, BREAKS, query, sql_chunks, sql_collapse, sql_lines, sql_strip, sql_text
from oreweave.tables import spread, table


@query("chunk", f"SELECT doc_id, chunk_index, chunk_text FROM {sql_chunks('documents', 'doc_id')}")
def chunk(spark, sf_dir):
    out = chunk_documents(spread(table(spark, sf_dir, "documents")), ["doc_id"])
    return out.withColumn("chunk_index", F.col("chunk_index").cast("bigint"))


_TAGLESS = "regexp_replace(html, '<[^>]+>', ' ', 'g')"


@query("html_strip", f"SELECT page_id, {sql_collapse(_TAGLESS)} AS plain_text FROM pages")
def html_strip(spark, sf_dir):
    return spread(table(spark, sf_dir, "pages")).select("page_id", T.strip_tags(F.col("html")).alias("plain_text"))


@query("quality_issues", f"""
  SELECT source AS run_id, doc_id, lang, length(text) AS text_chars, length({sql_strip('text')}) < 200 AS ocr_required
  FROM documents WHERE length({sql_strip('text')}) < 200 OR length(text) < 200
""")
def quality_issues(spark, sf_dir):
    from oreweave.sinks.ledger import quality_issues as issues
    from oreweave.plans.corpus import documents

    docs = documents(spark, sf_dir)
    quality = F.to_json(F.struct(
        F.length("text").alias("text_chars"),
        (F.length(T.py_strip(F.col("text"))) < K.OCR_REQUIRED_BELOW_CHARS).alias("ocr_required"),
    ))
    files = docs.select("run_id", "source_file_id", "relative_path", "source_type", "lang")
    texts = docs.select("source_file_id", "text", quality.alias("text_quality"))
    return issues(files, texts).select(
        "run_id", F.col("source_file_id").cast("bigint").alias("doc_id"), "lang",
        F.length("text").cast("bigint").alias("text_chars"), "ocr_required",
    )


_COMPACT = f"regexp_replace(text, '{BLANKS}+', '', 'g')"


@query("text_quality", f"""
  SELECT doc_id, CASE WHEN c = 0 THEN 0.0 ELSE round_even(greatest(0.0, least(1.0,
      0.50 * least(c / 900.0::DOUBLE, 1.0) + 0.35 * (info / greatest(1, c)::DOUBLE)
      + 0.15 * least(c / lines::DOUBLE / 45::DOUBLE, 1.0))), 3) END AS quality
  FROM (
    SELECT doc_id, length({_COMPACT})::DOUBLE AS c,
      length(regexp_replace({_COMPACT}, '[^\\p{{L}}\\p{{N}}=+\\-*/%.,;:()\\[\\]{{}}<>]', '', 'g'))::DOUBLE AS info,
      greatest(1, len(list_filter({sql_lines('text')}, lambda x: {sql_strip('x')} <> ''))) AS lines
    FROM documents
  )
""")
def text_quality(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents")).select("doc_id", T.ocr_quality(F.col("text"), F.lit(1)).alias("quality"))


@query("ocr_routing", f"""
  SELECT doc_id, CASE WHEN length(body) < 200 THEN lang ELSE body || E'\n\nExtracted OCR fallback text:\n' || lang END AS merged,
    length(body) < 800 AS needs_assist
  FROM (SELECT doc_id, lang, {sql_strip('text')} AS body FROM documents)
""")
def ocr_routing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    merged = T.merge_ocr_text(F.col("text"), F.col("lang"))
    return docs.select(
        "doc_id",
        merged.alias("merged"),
        T.needs_ocr_assist(F.lit("completed"), F.col("text"), F.lit(1.0)).alias("needs_assist"),
    )


_MATH = "(=|≈|≤|≥|->|→|<-|←|\\\\Delta|\\\\sum|\\\\int|(^|[^\\p{L}\\p{N}_])(exp|log|sin|cos)($|[^\\p{L}\\p{N}_]))"
_MARK = "regexp_replace(line, '([+-])([\\p{L}\\p{N}_])', '\\1' || chr(1) || '\\2', 'g')"
_WORDS = f"list_transform(regexp_extract_all({_MARK}, '[\\p{{L}}\\p{{N}}_]+(?:[+-]\\x01)?'), lambda w: replace(w, chr(1), ''))"


@query("formula_lines", f"""
  WITH lines AS (
    SELECT doc_id, idx AS line_no, {sql_collapse('raw')} AS line FROM (
      SELECT doc_id, unnest({sql_lines('text')}) AS raw, generate_subscripts({sql_lines('text')}, 1) AS idx
      FROM documents WHERE length(text) > 0)
  ), kinds AS (
    SELECT *, replace(line, ' ', '') AS compact,
      len(list_filter({_WORDS}, lambda w: regexp_full_match(w, '(?:[A-Z][a-z]?[0-9]*){{2,}}[+-]?'))) > 0
      AND (regexp_matches(line, '[-+·()\\[\\]]') OR len(string_split(line, ' ')) <= 8) AS chemical
    FROM lines WHERE length(line) BETWEEN 3 AND 280
  ), typed AS (
    SELECT *, CASE WHEN chemical THEN 'chemical_formula'
      WHEN regexp_matches(line, '{_MATH}') AND regexp_matches(line, '[A-Za-zΑ-Ωα-ω]') AND length(compact) >= 5
        AND regexp_matches(compact, '[=+\\-*/^_()\\[\\]{{}}<>≈≤≥→←]')
        AND len(regexp_extract_all(compact, '[\\p{{L}}\\p{{N}}]')) >= 3 THEN 'equation' END AS kind
    FROM kinds
  )
  SELECT doc_id, min(line_no) AS line, line AS text, kind, {sql_collapse("translate(line, '−–—×·', '---*.')")} AS normalized,
    round(least(0.95, 0.55 + CASE WHEN contains(line, '=') THEN 0.2 ELSE 0 END
      + CASE WHEN regexp_matches(line, '≈|≤|≥|→|<-|->') THEN 0.1 ELSE 0 END
      + CASE WHEN kind = 'chemical_formula' THEN 0.15 ELSE 0 END)::DOUBLE, 4) AS confidence
  FROM typed WHERE kind IS NOT NULL GROUP BY doc_id, line, kind
""")
def formula_lines(spark, sf_dir):
    found = formula_records(spread(table(spark, sf_dir, "documents")), ["doc_id"])
    return found.select(
        "doc_id", F.col("line").cast("bigint").alias("line"), "text", "kind", "normalized", F.round("confidence", 4).alias("confidence")
    )


@query("table_islands", f"""
  WITH lines AS (
    SELECT doc_id, idx AS line_no, raw FROM (
      SELECT doc_id, unnest({sql_lines('body')}) AS raw, generate_subscripts({sql_lines('body')}, 1) AS idx
      FROM (SELECT doc_id, replace(text, ', ', '   ') AS body FROM documents) WHERE length(body) > 0)
  ), cells AS (
    SELECT doc_id, line_no, list_filter(list_transform(
      string_split_regex({sql_strip('raw')}, '{BLANKS}{{2,}}'), lambda c: {sql_strip('c')}), lambda c: c <> '') AS cells
    FROM lines
  ), rows AS (
    SELECT * FROM cells WHERE len(cells) >= 2
      AND (len(cells) >= 3 OR len(list_filter(cells, lambda c: regexp_matches(c, '\\p{{Nd}}'))) > 0)
  ), runs AS (
    SELECT *, line_no - row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM rows
  )
  SELECT doc_id, min(line_no) AS start_line, max(line_no) AS end_line, count(*) AS row_count,
    max(len(cells)) AS column_count, sum(len(cells))::BIGINT AS filled_cells,
    CASE WHEN count(*) >= 3 THEN 0.75 ELSE 0.6 END::DOUBLE AS confidence
  FROM runs GROUP BY doc_id, run HAVING count(*) >= 2
""")
def table_islands(spark, sf_dir):
    """Aligned tables; commas of the prose stand for column gaps."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit(", "), F.lit("   ")).alias("text"))
    found = table_records(docs, ["doc_id"])
    filled = F.aggregate(
        F.transform("rows", lambda r: F.size(F.filter(r, lambda c: c != ""))), F.lit(0), lambda a, n: a + n
    )
    return found.select(
        "doc_id",
        F.col("start_line").cast("bigint").alias("start_line"),
        F.col("end_line").cast("bigint").alias("end_line"),
        F.col("row_count").cast("bigint").alias("row_count"),
        F.col("column_count").cast("bigint").alias("column_count"),
        filled.cast("bigint").alias("filled_cells"),
        "confidence",
    )


@query("fallback_sections", f"""
  WITH RECURSIVE body AS (
    SELECT doc_id, {sql_strip('text')} AS t FROM documents
  ), lines AS (
    SELECT doc_id, unnest({sql_lines('t')}) AS line, generate_subscripts({sql_lines('t')}, 1) - 1 AS i
    FROM body WHERE length(t) > 0
  ), heads AS (
    SELECT doc_id, i, {sql_strip('line')} AS title FROM lines
    WHERE regexp_full_match({sql_strip('line')}, '(?:\\d+(?:\\.\\d+)*\\.?\\s+)?([A-ZА-Я][A-Za-zА-Яа-я0-9 ,:/()\\\\-]{{2,90}})')
  ), starts AS (
    SELECT DISTINCT doc_id, -1::BIGINT AS i FROM lines
    UNION ALL
    SELECT s.doc_id, (SELECT min(h.i) FROM heads h WHERE h.doc_id = s.doc_id AND h.i > s.i + 9) AS i
    FROM starts s
    WHERE EXISTS (SELECT 1 FROM heads h WHERE h.doc_id = s.doc_id AND h.i > s.i + 9)
  ), bounds AS (
    SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS stop FROM starts
  ), parts AS (
    SELECT b.doc_id, b.i, {sql_strip("coalesce(string_agg(l.line, chr(10) ORDER BY l.i), '')")} AS text
    FROM bounds b LEFT JOIN lines l ON l.doc_id = b.doc_id AND l.i > b.i AND (b.stop IS NULL OR l.i < b.stop)
    GROUP BY b.doc_id, b.i
  ), kept AS (
    SELECT p.doc_id, p.i, p.text, count(*) OVER (PARTITION BY p.doc_id) AS n,
      row_number() OVER (PARTITION BY p.doc_id ORDER BY p.i) - 1 AS section_index, h.title
    FROM parts p LEFT JOIN heads h ON h.doc_id = p.doc_id AND h.i = p.i WHERE p.text <> ''
  )
  SELECT doc_id, section_index, CASE WHEN n = 1 THEN 'full_text' ELSE 'body' END AS section_type,
    CASE WHEN n = 1 THEN lang ELSE coalesce(kept.title, 'Full text') END AS title, md5(kept.text) AS text_md5
  FROM kept JOIN documents USING (doc_id)
""")
def sections(spark, sf_dir):
    out = fallback_sections(spread(table(spark, sf_dir, "documents")), ["doc_id"], "lang")
    return out.select(
        "doc_id", F.col("section_index").cast("bigint").alias("section_index"), "section_type", "title",
        F.md5(F.encode("text", "UTF-8")).alias("text_md5"),
    )


@query("document_line_stats", f"""
  SELECT doc_id, len({sql_lines('text')}) AS lines, len(list_filter({sql_lines('text')}, lambda x: {sql_strip('x')} = '')) AS blank_lines
  FROM documents WHERE length(text) > 0
""")
def document_line_stats(spark, sf_dir):
    lines = document_lines(table(spark, sf_dir, "documents").repartition("doc_id"), ["doc_id"])
    return lines.groupBy("doc_id").agg(
        F.count("*").alias("lines"), F.count_if(T.py_strip(F.col("content")) == "").alias("blank_lines")
    )


@query("exact_dup", """
  SELECT sha256(text) AS content_hash, count(*) AS copies, min(doc_id) AS first_doc_id
  FROM documents GROUP BY 1 HAVING count(*) > 1
""")
def exact_dup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", sha256(F.encode("text", "UTF-8")).alias("content_hash"))
    groups = docs.groupBy("content_hash").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc_id"))
    return groups.where(F.col("copies") > 1)


@query("dedupe_first", f"""
  WITH lines AS (
    SELECT doc_id, unnest({sql_lines('text')}) AS line, generate_subscripts({sql_lines('text')}, 1) AS line_no
    FROM documents WHERE length(text) > 0)
  SELECT DISTINCT ON (line) line, doc_id, line_no FROM lines ORDER BY line, doc_id, line_no
""")
def dedupe_first(spark, sf_dir):
    lines = document_lines(spread(table(spark, sf_dir, "documents")), ["doc_id"])
    rows = lines.select(F.col("content").alias("line"), "doc_id", F.col("line").cast("bigint").alias("line_no"))
    return keep_first(rows, ["line"], [F.asc("doc_id"), F.asc("line_no")])


@query("dedupe_ci", f"""
  WITH lines AS (
    SELECT doc_id, trim(unnest({sql_lines('text')})) AS line, generate_subscripts({sql_lines('text')}, 1) AS line_no
    FROM documents WHERE length(text) > 0)
  SELECT DISTINCT ON (lower(line)) line, doc_id, line_no FROM lines WHERE line <> '' ORDER BY lower(line), doc_id, line_no
""")
def dedupe_ci(spark, sf_dir):
    lines = document_lines(spread(table(spark, sf_dir, "documents")), ["doc_id"])
    rows = lines.select(F.col("content").alias("line"), "doc_id", F.col("line").cast("bigint").alias("line_no"))
    return keep_first_ci(rows, "line", [F.asc("doc_id"), F.asc("line_no")])


@query("normalize_doi", """
  SELECT p_partkey, nullif(lower(regexp_replace(regexp_replace(regexp_replace(trim(raw),
      '^https://doi\\.org/', ''), '^http://doi\\.org/', ''), '^doi:', '')), '') AS doi
  FROM (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'https://doi.org/10.1000/' || p_brand
      WHEN 1 THEN ' http://doi.org/10.1000/' || p_brand || ' ' WHEN 2 THEN 'doi:10.1000/' || p_type
      WHEN 3 THEN 'DOI:10.1000/' || p_type ELSE 'doi:' END AS raw FROM part)
""")
def normalize_doi(spark, sf_dir):
    slot = F.pmod("p_partkey", F.lit(5))
    raw = (
        F.when(slot == 0, F.concat(F.lit("https://doi.org/10.1000/"), "p_brand"))
        .when(slot == 1, F.concat(F.lit(" http://doi.org/10.1000/"), "p_brand", F.lit(" ")))
        .when(slot == 2, F.concat(F.lit("doi:10.1000/"), "p_type"))
        .when(slot == 3, F.concat(F.lit("DOI:10.1000/"), "p_type"))
        .otherwise("doi:")
    )
    return table(spark, sf_dir, "part").select("p_partkey", U.normalize_doi(raw).alias("doi"))


@query("inverted_index", f"SELECT conv_id, turn, {sql_collapse('text')} AS abstract FROM conversations")
def inverted_index(spark, sf_dir):
    """Texts turned into word -> positions indexes and read back in position order."""
    from oreweave.functions.records import abstract_from_index

    words = F.split(T.collapse_ws(F.col("text")), " ")
    rows = table(spark, sf_dir, "conversations").repartition("conv_id", "turn").select(
        "conv_id", "turn", F.posexplode(words).alias("position", "word")
    )
    index = (
        rows.groupBy("conv_id", "turn", "word").agg(F.collect_list("position").alias("positions"))
        .groupBy("conv_id", "turn").agg(F.map_from_entries(F.collect_list(F.struct("word", "positions"))).alias("index"))
    )
    return index.select("conv_id", "turn", abstract_from_index(F.col("index")).alias("abstract"))


@query("first_number", f"""
  SELECT p_partkey, coalesce(list_filter(list_transform(list_filter(
      string_split_regex(replace(p_name || ' ' || p_brand || ' ' || p_size || ' ' || (p_retailprice * 100)::BIGINT || ',5', ',', '.'), '{BLANKS}+'),
      lambda t: regexp_full_match(t, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?')), lambda t: t::DOUBLE),
      lambda v: v > 10)[1], 100.0) AS target_tonnes
  FROM part
""")
def first_number(spark, sf_dir):
    text = F.concat_ws(
        " ", "p_name", "p_brand", F.col("p_size").cast("string"),
        F.concat(F.round(F.col("p_retailprice") * 100).cast("bigint").cast("string"), F.lit(",5")),
    )
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.coalesce(T.first_number_above(text), F.lit(100.0)).alias("target_tonnes")
    )


@query("file_admission", """
  SELECT doc_id, ext, CASE WHEN bytes > 4096 THEN 'skipped' WHEN ext IN ('pdf', 'md', 'csv', 'png') THEN 'accepted' ELSE 'rejected' END AS decision,
    CASE WHEN bytes < 1024 THEN bytes || ' B' ELSE format('{:.1f} KB', bytes / 1024.0) END AS size_label,
    CASE WHEN ext IN ('pdf', 'md') THEN 'text' WHEN ext = 'csv' THEN 'tabular' WHEN ext = 'png' THEN 'image' ELSE 'unknown' END AS ftype
  FROM (SELECT doc_id, strlen(text) AS bytes, ['pdf', 'md', 'csv', 'png', 'log', 'exe'][doc_id % 6 + 1] AS ext FROM documents)
""")
def file_admission(spark, sf_dir):
    from oreweave.sources.files import admission

    names = F.array(*[F.lit(x) for x in ("pdf", "md", "csv", "png", "log", "exe")])
    files = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat(F.col("source"), F.lit("/doc"), "doc_id", F.lit("."), F.get(names, F.pmod("doc_id", F.lit(6)).cast("int"))).alias("path"),
        F.octet_length("text").cast("bigint").alias("bytes"),
    )
    return admission(files, max_bytes=4096).select(
        "doc_id", T.extension(F.col("path")).alias("ext"), "decision", T.human_size(F.col("bytes")).alias("size_label"), "ftype"
    )


_LATIN = "".join(chr(b) for b in range(0x80, 0x100) if b != 0x98)
_CYRILLIC = "".join(bytes([b]).decode("cp1251") for b in range(0x80, 0x100) if b != 0x98)


@query("csv_decode", f"""
  SELECT doc_id, CASE WHEN doc_id % 2 = 0 OR regexp_full_match(text, '(?s)[\\x00-\\x7F]*') OR NOT regexp_full_match(text, '(?s)[\\x00-\\xFF]*') THEN text
    ELSE translate(text, {sql_text(_LATIN)}, {sql_text(_CYRILLIC)}) END AS text
  FROM documents
""")
def csv_decode(spark, sf_dir):
    """Files in UTF-8 and, for odd ids where single bytes can hold them, in single bytes: each decoded by its own content."""
    single = (F.col("doc_id") % 2 == 1) & F.rlike("text", F.lit("(?s)^[\\x00-\\xFF]*$"))
    content = F.when(single, F.encode("text", "ISO-8859-1")).otherwise(F.encode("text", "UTF-8"))
    return table(spark, sf_dir, "documents").select("doc_id", decoded_text(content).alias("text"))
