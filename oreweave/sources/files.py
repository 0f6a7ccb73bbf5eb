"""Folder scans and file parsing.

Spark lists and reads the files; the parsers run per file inside tasks and yield plain rows.
A file that cannot be parsed becomes a row with an error, never a failed job.
"""

from __future__ import annotations

import json
import re
import subprocess
import tempfile
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oreweave import constants as K
from oreweave.functions import text as T
from oreweave.functions.hashing import short_hash
from oreweave.operators.dedupe import keep_first
from oreweave.session import stored
from oreweave.sources import office

PARSED = "path string, parsed_text string, parse_error string, metadata string"


def scan_folder(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    """Files below a folder: path, relative_path, length, content, source_type, modified.

    The content column is only read by plans that use it, and never for files that a filter on
    ``modified`` or ``length`` leaves out.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return scanned(reader.load(root), root)


def scanned(files: DataFrame, root: str) -> DataFrame:
    """Columns of a scan from rows of the binary file format, of a batch or of a stream."""
    prefix = re.escape(root.rstrip("/").split("://")[-1].removeprefix("file:")) + "/"
    relative = F.regexp_replace("path", f"^(?:[a-z0-9]+:(?://[^/]*)?)?/*(?=/){prefix}", "")
    return files.select(
        "path", relative.alias("relative_path"), "length", "content", T.source_type(F.col("path")).alias("source_type"),
        F.col("modificationTime").alias("modified"),
    )


def admission(
    files: DataFrame,
    include: list[str] | None = None,
    exclude: list[str] | None = None,
    images: bool = True,
    text: bool = True,
    tables: bool = True,
    max_bytes: int = int(K.CONVERTER_MAX_MB * 1024 * 1024),
) -> DataFrame:
    """Which files a conversion run takes (``path, bytes``): accepted, skipped or rejected with a reason."""
    ext = T.extension(F.col("path"))
    kind = F.coalesce(F.try_element_at(T.literal_map(K.CONVERTER_TYPE_BY_EXTENSION), ext), F.lit("unknown"))
    switched_off = [name for name, on in (("image", images), ("text", text), ("tabular", tables)) if not on]
    wanted = (kind != "unknown") & ~ext.isin(exclude if exclude is not None else K.CONVERTER_EXCLUDED)
    if include:
        wanted = wanted & ext.isin(include)
    if switched_off:
        wanted = wanted & ~kind.isin(switched_off)
    too_big = F.col("bytes") > max_bytes
    reason = F.when(too_big, F.format_string("пропущен: %.1f МБ > лимита %.1f МБ", F.col("bytes") / 1048576.0, F.lit(max_bytes / 1048576.0)))
    return files.withColumn("ftype", kind).withColumn(
        "decision", F.when(too_big, "skipped").when(wanted, "accepted").otherwise("rejected")
    ).withColumn("skipped_reason", reason)


def decode_text(content: bytes) -> str:
    """Text of a file in the first encoding that fits."""
    for encoding in K.TEXT_ENCODINGS:
        try:
            return content.decode(encoding)
        except UnicodeDecodeError:
            continue
    return content.decode("utf-8", errors="replace")


def pdf_layout_text(content: bytes, max_pages: int | None = None, timeout: int = 90) -> tuple[str, dict]:
    """Layout text of a PDF through the ``pdftotext`` program; empty text and an error when it is missing."""
    pages = ["-f", "1", "-l", str(max_pages)] if max_pages else []
    with tempfile.NamedTemporaryFile(suffix=".pdf") as handle:
        handle.write(content)
        handle.flush()
        try:
            done = subprocess.run(
                ["pdftotext", "-layout", *pages, handle.name, "-"], check=False, capture_output=True, timeout=timeout
            )
        except (FileNotFoundError, subprocess.TimeoutExpired) as exc:
            return "", {"parser": "pdftotext", "error": str(exc)}
    text = done.stdout.decode("utf-8", errors="ignore")
    return text, {"parser": "pdftotext", "returncode": done.returncode, "pages_detected": text.count("\f") + 1 if text else 0}


def _parse_one(path: str, kind: str, content: bytes) -> tuple[str, dict]:
    if kind == "docx":
        return office.docx_plain_text(content), {"parser": "docx"}
    if kind == "txt":
        return content.decode("utf-8", errors="ignore"), {"parser": "txt"}
    if kind == "pdf":
        text, metadata = pdf_layout_text(content)
        return text, {**metadata, "ocr_required": len(text.strip()) < K.OCR_REQUIRED_BELOW_CHARS}
    if kind == "image":
        name = path.rsplit("/", 1)[-1]
        return f"Image source: {name}. OCR not executed in local mock mode.", {"ocr_required": True}
    return "", {"parser": kind}


def parse_files(files: DataFrame) -> DataFrame:
    """Text of scanned files, one row per file: path, parsed_text, parse_error, metadata JSON."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, kind, content in zip(batch["path"], batch["source_type"], batch["content"]):
                try:
                    text, metadata = _parse_one(path, kind, bytes(content))
                    rows.append((path, text, None, json.dumps(metadata, ensure_ascii=False)))
                except Exception as exc:
                    rows.append((path, "", str(exc), json.dumps({"parser": kind, "error": str(exc)})))
            yield pd.DataFrame(rows, columns=["path", "parsed_text", "parse_error", "metadata"])

    return files.select("path", "source_type", "content").mapInPandas(parse, PARSED)


def document_id(path: Column) -> Column:
    return short_hash(path, 12)


# Latin-1 characters 80..FF and what the same bytes mean in cp1251 (98 is unassigned there).
_HIGH = "".join(chr(b) for b in range(0x80, 0x100) if b != 0x98)
_CYRILLIC = "".join(bytes([b]).decode("cp1251") for b in range(0x80, 0x100) if b != 0x98)


def csv_encoding(content: Column) -> Column:
    """utf-8 where the bytes are valid, else cp1251, else latin-1 where a byte has no meaning in cp1251."""
    bytes_ = F.decode(content, "ISO-8859-1")
    return F.when(F.is_valid_utf8(content.cast("string")), "utf-8").when(F.contains(bytes_, F.lit("\x98")), "latin-1").otherwise("cp1251")


def decoded_text(content: Column) -> Column:
    """Text of raw bytes in the first encoding that fits, as a column expression."""
    bytes_ = F.decode(content, "ISO-8859-1")
    kind = csv_encoding(content)
    return F.when(kind == "utf-8", content.cast("string")).when(kind == "latin-1", bytes_).otherwise(F.translate(bytes_, _HIGH, _CYRILLIC))


def page_text(content: Column, content_type: Column) -> Column:
    """Text of a stored page: the charset of its content type, else of its markup, else by its bytes."""
    latin = F.decode(content, "ISO-8859-1")

    def charset(source: Column, pattern: str) -> Column:
        return F.nullif(F.lower(F.regexp_extract(F.coalesce(source, F.lit("")), pattern, 1)), F.lit(""))

    declared = F.coalesce(
        charset(content_type, r"(?i)charset\s*=\s*[\"']?([\w.-]+)"),
        charset(F.substring(latin, 1, 4096), r"(?is)<meta\b[^>]*charset\s*=\s*[\"']?([\w.-]+)"),
        F.lit(""),
    )
    return (
        F.when(declared.isin("utf-8", "utf8"), F.make_valid_utf8(content.cast("string")))
        .when(declared.isin("windows-1251", "cp1251"), F.translate(latin, _HIGH, _CYRILLIC))
        .when(declared.isin("iso-8859-1", "latin-1", "latin1"), latin)
        .otherwise(decoded_text(content))
    )


def read_csv_any_encoding(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """CSV files of a path, each in UTF-8, else cp1251, else Latin-1.

    Files of one encoding are read together. Spark's reader knows no cp1251, so such files are
    read byte by byte as Latin-1 and their characters are mapped afterwards, which stays a plain
    column expression. Columns are matched by name; where the groups disagree on a type it is text.
    """
    kinds = spark.read.format("binaryFile").load(path).select("path", csv_encoding(F.col("content")).alias("kind"))
    by_kind: dict[str, list[str]] = {}
    for row in kinds.orderBy("path").collect():  # names of files, which the reader lists as well
        by_kind.setdefault(row["kind"], []).append(row["path"])
    reader = spark.read.option("header", header).option("inferSchema", "true")
    groups = []
    for kind, paths in by_kind.items():
        df = reader.option("encoding", "UTF-8" if kind == "utf-8" else "ISO-8859-1").csv(paths)
        if kind == "cp1251":
            table = str.maketrans(_HIGH, _CYRILLIC)
            df = df.select(*[
                (F.translate(F.col(f"`{f.name}`"), _HIGH, _CYRILLIC) if f.dataType.simpleString() == "string" else F.col(f"`{f.name}`"))
                .alias(f.name.translate(table)) for f in df.schema.fields
            ])
        groups.append(df)
    if not groups:
        return reader.csv(path)
    kinds_of: dict[str, set] = {}
    for df in groups:
        for name, kind in df.dtypes:
            kinds_of.setdefault(name, set()).add(kind)
    alike = [df.select(*[(F.col(f"`{n}`") if len(kinds_of[n]) == 1 else F.col(f"`{n}`").cast("string")).alias(n) for n in df.columns]) for df in groups]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), alike)


# Workbooks ---------------------------------------------------------------------------------

CELLS = "path string, sheet_name string, row_number int, cells array<string>, error string"


def workbook_rows(files: DataFrame) -> DataFrame:
    """Rows of all sheets of the xlsx files: path, sheet_name, row_number from 1, cells, error.

    A workbook that cannot be read gives one row with its error and no cells.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    out = [(path, sheet, number, cells, None) for sheet, number, cells in office.xlsx_rows(bytes(content))]
                except Exception as exc:
                    out = [(path, None, None, None, f"{type(exc).__name__}: {exc}")]
                yield pd.DataFrame(out, columns=["path", "sheet_name", "row_number", "cells", "error"])

    return files.where(F.col("source_type") == "xlsx").select("path", "content").mapInPandas(read, CELLS)


def tailings_workbooks(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Summaries, size classes and extractability rows of tailings workbooks.

    The stream of a row is the last summary label at or above it in its sheet: a forward fill
    that runs block-wise, so a sheet of any length is spread over tasks.
    """
    from oreweave.operators.scans import forward_fill

    def number(i: int) -> Column:
        return T.cell_number(F.get("cells", F.lit(i)))

    label = T.cell_label(F.get("cells", F.lit(1)))
    marked = rows.withColumn("label", label).withColumn(
        "_summary", F.when(F.col("label").isin(K.SUMMARY_LABELS), F.col("label"))
    )
    keys = ["path", "sheet_name"]
    filled = forward_fill(
        marked, keys, ["row_number"], F.floor(F.col("row_number") / 8192), "_summary", "_stream"
    ).withColumn("stream", F.coalesce("_stream", F.lit(K.DEFAULT_STREAM)))
    name = F.element_at(F.split("path", "/"), -1)
    source = [
        T.plant_from_path(F.col("path")).alias("plant"),
        F.col("stream"),
        F.concat_ws(":", name, "sheet_name", F.col("row_number").cast("string")).alias("source_id"),
        F.col("path").alias("filename"),
        F.col("sheet_name"),
        F.col("row_number"),
    ]
    compact = F.replace("label", F.lit(" "), F.lit(""))
    is_summary = F.col("_summary").isNotNull()
    summaries = filled.where(is_summary).select(
        *source,
        number(2).alias("dry_metric_tonnes"), number(3).alias("element28_grade_pct"), number(4).alias("element28_tonnes"),
        number(5).alias("element29_grade_pct"), number(6).alias("element29_tonnes"),
    )
    is_class = ~is_summary & compact.isin(K.SIZE_CLASSES) & number(2).isNotNull()
    size_classes = filled.where(is_class).select(
        *source, F.col("label").alias("size_class"),
        number(2).alias("mass_share_pct"), number(3).alias("element28_loss_share_pct"), number(4).alias("element28_tonnes"),
        number(5).alias("element29_loss_share_pct"), number(6).alias("element29_tonnes"),
    )
    extractable = F.startswith("label", F.lit(K.EXTRACTABLE_PREFIX))
    total = extractable | F.startswith("label", F.lit(K.NOT_EXTRACTABLE_PREFIX))
    extractability = filled.where(~is_summary & ~is_class & total).select(
        *source, extractable.alias("extractable"),
        number(3).alias("element28_share_pct"), number(4).alias("element28_tonnes"),
        number(5).alias("element29_share_pct"), number(6).alias("element29_tonnes"),
    )
    return summaries, size_classes, extractability


# Markdown conversion -----------------------------------------------------------------------

CONVERTED = "path string, markdown string, processor string, ok boolean, error string"


def convert_to_markdown(files: DataFrame) -> DataFrame:
    """Markdown of text-like files (docx with headings and tables, txt, md, pdf pages)."""

    def one(path: str, content: bytes) -> tuple[str, str]:
        name = path.rsplit("/", 1)[-1]
        ext = name.rsplit(".", 1)[-1].lower()
        if ext == "docx":
            return office.docx_markdown(name, content), "docx"
        if ext == "pdf":
            text, _ = pdf_layout_text(content)
            pages = "\n\n".join(f"## Страница {i}\n\n{p.strip()}" for i, p in enumerate(text.split("\f"), 1) if p.strip())
            return f"# {name}\n\n{pages}\n\n*Источник: {name}*\n", "pdftotext"
        if ext in ("md", "txt"):
            return decode_text(content), "text-copy"
        return f"# {name}\n\n*Неподдерживаемый формат: .{ext}*\n", "unsupported"

    def convert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    markdown, processor = one(path, bytes(content))
                    rows.append((path, markdown, processor, True, None))
                except Exception as exc:
                    rows.append((path, None, "-", False, str(exc)))
            yield pd.DataFrame(rows, columns=["path", "markdown", "processor", "ok", "error"])

    return files.select("path", "content").mapInPandas(convert, CONVERTED)


def with_cached_descriptions(images: DataFrame, cache: DataFrame, provider: str, model: str) -> tuple[DataFrame, DataFrame]:
    """Image rows with a cached description, and those that still need the provider.

    images: path, content. cache: key, description. The key is provider, model and content hash.
    """
    keyed = images.withColumn("key", F.concat_ws(":", F.lit(provider), F.lit(model), F.sha2("content", 256)))
    known = keyed.join(cache.select("key", "description"), "key")
    return known, keyed.join(cache.select("key"), "key", "left_anti")


DESCRIBED = "key string, description string, error string"


def described_images(images: DataFrame, folder: str, provider: str, model: str, describe: Callable[[bytes], str]) -> DataFrame:
    """Images (path, content) with a description, asking the provider once for each unknown content.

    The cache is a Parquet folder (key, description). Misses are reduced to one row per key before
    the provider is called; its answers are appended, so a rerun asks for nothing. A RuntimeError of
    the provider is kept as `error`, not cached, and the image described by its name, as is one
    without content. Columns: path, key, description, origin (cache, provider or name), error.
    """
    spark = images.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    there = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
    cache = spark.read.schema("key string, description string").parquet(folder) if there else spark.createDataFrame([], "key string, description string")
    cache = cache.groupBy("key").agg(F.min("description").alias("description"))  # two jobs may have asked at once
    filled = images.where("content is not null").select("path", "content")
    known, misses = with_cached_descriptions(filled, cache, provider, model)
    known = stored(known.select("path", "key", "description", F.lit("cache").alias("origin"), F.lit(None).cast("string").alias("error")))
    once = keep_first(misses, ["key"], [F.asc("path")])

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for key, content in zip(frame["key"], frame["content"]):
                try:
                    rows.append((key, describe(bytes(content)), None))
                except RuntimeError as exc:
                    rows.append((key, None, str(exc)))
            yield pd.DataFrame(rows, columns=["key", "description", "error"])

    answers = stored(once.select("key", "content").mapInPandas(ask, DESCRIBED))
    answers.where("error is null and description is not null").select("key", "description").write.mode("append").parquet(folder)
    by_name = describe_by_name(F.col("path"))
    fresh = misses.select("path", "key").join(answers, "key").select(
        "path", "key", F.coalesce("description", by_name).alias("description"),
        F.when(F.col("description").isNull(), "name").otherwise("provider").alias("origin"), "error",
    )
    bare = images.where("content is null").select(
        "path", F.lit(None).cast("string").alias("key"), by_name.alias("description"), F.lit("name").alias("origin"), F.lit("no content").alias("error"),
    )
    return known.unionByName(fresh).unionByName(bare)


def describe_by_name(path: Column) -> Column:
    """Fallback description of an image when no vision provider answers."""
    return F.concat(F.lit("Изображение: "), F.element_at(F.split(path, "/"), -1))
