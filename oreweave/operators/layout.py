"""Formula lines, aligned tables and text sections of plain-text documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oreweave import constants as K
from oreweave.functions import text as T


def _pages(docs: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """keys, ``page`` from 1, ``_page_text``."""
    pages = docs.select(*keys, F.posexplode(T.split_pages(F.col(text))).alias("_page", "_page_text"))
    return pages.select(*keys, (F.col("_page") + 1).alias("page"), "_page_text")


def _page_lines() -> Column:
    return T.split_lines(F.col("_page_text"))


def document_lines(docs: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """One row per line: keys, ``page`` and ``line`` from 1, ``content``."""
    lines = _pages(docs, keys, text).select(*keys, "page", F.posexplode(_page_lines()).alias("_line", "content"))
    return lines.select(*keys, "page", (F.col("_line") + 1).alias("line"), "content")


def formula_records(docs: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """Equations and chemical formula lines; a repeated line counts once per page.

    Lines are classified inside the page's array, so each is cleaned and tested once and only
    the formula lines become rows.
    """
    cleaned = F.transform(_page_lines(), lambda x: T.collapse_ws(x))
    typed = F.transform(
        cleaned, lambda x, i: F.struct((i + 1).alias("line"), x.alias("text"), T.formula_kind(x).alias("kind"))
    )
    found = _pages(docs, keys, text).select(*keys, "page", F.inline(F.filter(typed, lambda r: r["kind"].isNotNull())))
    first = Window.partitionBy(*keys, "page", "text").orderBy("line")
    return (
        found.withColumn("_n", F.row_number().over(first))
        .where(F.col("_n") == 1)
        .drop("_n")
        .withColumn("normalized", T.normalize_formula(F.col("text")))
        .withColumn("confidence", T.formula_confidence(F.col("text"), F.col("kind")))
    )


def table_lines(docs: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """Lines that belong to a table, with ``table_start`` numbering the block they are in.

    A table is two or more adjacent table-like lines of one page. Documents are shuffled
    once by key; exploding and windowing then stay in that partitioning.
    """
    pages = _pages(docs.select(*keys, text).repartition(*keys), keys, text)
    split = F.transform(
        _page_lines(), lambda x, i: F.struct((i + 1).alias("line"), x.alias("content"), T.table_cells(x).alias("cells"))
    )
    cells = pages.select(*keys, "page", F.inline(F.filter(split, lambda r: F.size(r["cells"]) >= 2)))
    page = Window.partitionBy(*keys, "page").orderBy("line")
    # line number minus rank is constant inside a block of adjacent lines
    blocks = cells.withColumn("_run", F.col("line") - F.row_number().over(page))
    block = Window.partitionBy(*keys, "page", "_run")
    return (
        blocks.withColumn("row_count", F.count("*").over(block))
        .withColumn("column_count", F.max(F.size("cells")).over(block))
        .withColumn("table_start", F.min("line").over(block))
        .where(F.col("row_count") >= 2)
        .drop("_run")
    )


def table_records(docs: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """One row per table: extent, padded rows, raw lines and confidence."""
    padding = F.array_repeat(F.lit(""), F.col("column_count") - F.size("cells"))
    rows = table_lines(docs, keys, text).withColumn("_padded", F.concat("cells", padding))
    grouped = rows.groupBy(*keys, "page", "table_start", "row_count", "column_count").agg(
        F.max("line").alias("end_line"),
        # a table lies inside one page of one document, so the list is bounded by that page
        F.array_sort(F.collect_list(F.struct("line", "_padded", "content"))).alias("_rows"),
    )
    return grouped.select(
        *keys,
        "page",
        F.col("table_start").alias("start_line"),
        "end_line",
        F.col("row_count").cast("int").alias("row_count"),
        "column_count",
        F.transform("_rows", lambda r: r["_padded"]).alias("rows"),
        F.transform("_rows", lambda r: T.py_strip(r["content"])).alias("raw_lines"),
        F.when(F.col("row_count") >= 3, 0.75).otherwise(0.6).alias("confidence"),
    )


def enriched_text(text: Column, formulas: Column, tables: Column, table_rows: int | None = None) -> Column:
    """Text followed by its formula lines and the rows of each table, all unless ``table_rows`` says how many.

    ``formulas``: array of structs page, line, kind, text. ``tables``: array of structs page,
    row_count, column_count, rows. Both in reading order.
    """
    formula_lines = F.transform(
        formulas, lambda f: F.format_string("[p.%d:%d] %s: %s", f["page"], f["line"], f["kind"], f["text"])
    )
    formula_block = F.when(
        F.size(formulas) > 0,
        F.concat_ws("\n", F.lit(""), F.lit("Extracted PDF formulas and equations:"), F.array_join(formula_lines, "\n")),
    )
    table_blocks = F.transform(
        tables,
        lambda t, i: F.concat_ws(
            "\n",
            F.format_string("Table %d p.%d rows=%d cols=%d", i + 1, t["page"], t["row_count"], t["column_count"]),
            F.array_join(
                F.transform(t["rows"] if table_rows is None else F.slice(t["rows"], 1, table_rows), lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))),
                "\n",
            ),
        ),
    )
    table_block = F.when(
        F.size(tables) > 0,
        F.concat_ws("\n", F.lit(""), F.lit("Extracted PDF tables:"), F.array_join(table_blocks, "\n")),
    )
    body = T.py_strip(text)
    return F.concat_ws("\n\n", F.when(body != "", body), formula_block, table_block)


def _is_heading(line: Column) -> Column:
    """Title-like line; lines too long to be one never reach the pattern."""
    clean = T.py_strip(line)
    short = (F.length(clean) <= 91) | F.rlike(clean, F.lit("^[0-9]"))
    return short & F.rlike(clean, F.lit(K.HEADING_PATTERN))


def _section_starts(lines: Column) -> Column:
    """Line numbers (from 0) where a new section begins.

    A heading opens a section only when more than eight lines have been collected since the
    last one, so the rule is folded over the heading positions, which are few.
    """
    headings = F.array_compact(F.transform(lines, lambda line, i: F.when(_is_heading(line), i)))
    return F.aggregate(
        headings,
        F.array().cast("array<int>"),
        lambda acc, h: F.when(
            F.when(F.size(acc) == 0, h > 8).otherwise(h - F.get(acc, F.size(acc) - 1) > 9), F.concat(acc, F.array(h))
        ).otherwise(acc),
    )


def _sections(lines: Column, starts: Column) -> Column:
    """Array of (title, text): the lines between two starts; a heading is no part of its text."""

    def text_of(start: Column, i: Column) -> Column:
        stop = F.coalesce(F.get(starts, i), F.size(lines))
        return T.py_strip(F.array_join(F.slice(lines, start + 2, stop - start - 1), "\n"))

    parts = F.transform(
        F.concat(F.array(F.lit(-1)), starts),
        lambda s, i: F.struct(
            F.when(s < 0, F.lit("Full text")).otherwise(T.py_strip(F.get(lines, s))).alias("title"),
            text_of(s, i).alias("text"),
        ),
    )
    return F.filter(parts, lambda p: p["text"] != "")


def fallback_sections(
    docs: DataFrame, keys: Sequence[str], title: str, text: str = "text", extractor: str = "text_fallback"
) -> DataFrame:
    """Sections of documents that have no structural markup.

    One section is typed ``full_text`` under the document title, several are typed ``body``
    under their headings. The whole rule is one array expression per document: nested
    one-element transforms bind the lines, the starts and the parts, so each is computed once.
    """
    full_title = F.when(F.coalesce(F.col(title), F.lit("")) == "", "Full text").otherwise(F.col(title))
    lines = T.split_lines(T.py_strip(F.coalesce(F.col(text), F.lit(""))))
    bound = F.transform(F.array(lines), lambda x: F.struct(x.alias("lines"), _section_starts(x).alias("starts")))
    parts = F.transform(bound, lambda b: _sections(b["lines"], b["starts"]))
    typed = F.transform(
        parts,
        lambda ps: F.transform(
            ps,
            lambda p, i: F.struct(
                i.alias("section_index"),
                F.when(F.size(ps) == 1, "full_text").otherwise("body").alias("section_type"),
                F.when(F.size(ps) == 1, full_title).otherwise(p["title"]).alias("title"),
                p["text"].alias("text"),
            ),
        ),
    )
    return docs.select(*keys, F.inline(F.flatten(typed))).withColumn("extractor", F.lit(extractor))


def assets_from_records(records: DataFrame) -> DataFrame:
    """Document assets of formula and table records.

    ``records`` has run_id, source_file_id, record_type and a JSON ``payload``.
    """
    payload = F.from_json(
        "payload",
        "page INT, line INT, start_line INT, text STRING, normalized STRING, rows ARRAY<ARRAY<STRING>>",
    )
    is_formula = F.contains(F.col("record_type"), F.lit("formula"))
    is_table = ~is_formula & F.contains(F.col("record_type"), F.lit("table"))
    p = F.col("_p")
    table_text = F.array_join(
        F.transform(
            F.coalesce(p["rows"], F.array().cast("array<array<string>>")),
            lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |")),
        ),
        "\n",
    )

    def number(column: Column) -> Column:
        return F.coalesce(column.cast("string"), F.lit(""))

    def filled(column: Column) -> Column:
        return F.when(column != "", column)

    return (
        records.where(is_formula | is_table)
        .withColumn("_p", payload)
        .select(
            "run_id",
            "source_file_id",
            F.when(is_formula, "formula").otherwise("table").alias("asset_type"),
            F.concat_ws(
                ":", "record_type", number(p["page"]), F.when(is_formula, number(p["line"])).otherwise(number(p["start_line"]))
            ).alias("label"),
            F.lit("").alias("caption"),
            F.when(is_formula, F.coalesce(filled(p["text"]), filled(p["normalized"]), F.col("payload")))
            .otherwise(F.coalesce(filled(table_text), F.col("payload")))
            .alias("content"),
            p["page"].alias("page"),
            "record_type",
            F.col("payload").alias("metadata"),
        )
    )


def merge_assets(primary: DataFrame, extra: DataFrame) -> DataFrame:
    """Assets of the markup plus those record assets whose (type, content) is new for the file."""
    keys = ["run_id", "source_file_id", "asset_type", "content"]
    fresh = extra.join(primary.select(*keys), keys, "left_anti")
    first = Window.partitionBy(*keys).orderBy("label")
    unique = fresh.withColumn("_n", F.row_number().over(first)).where(F.col("_n") == 1).drop("_n")
    return primary.unionByName(unique, allowMissingColumns=True)
