"""Scientific-article XML (TEI) as section and asset rows."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

XML_ID = "{http://www.w3.org/XML/1998/namespace}id"
ROWS = (
    "source_file_id string, row_kind string, row_index int, kind string, title string, caption string, text string"
)


def _flat(node: ET.Element | None) -> str:
    return "" if node is None else " ".join(" ".join(node.itertext()).split())


def tei_rows(xml: str) -> Iterator[tuple[str, int, str, str, str, str]]:
    """(row_kind, index, kind, title, caption, text); row_kind is section, asset or metadata."""
    root = ET.fromstring(xml)
    title = _flat(root.find(".//{*}titleStmt/{*}title")) or _flat(root.find(".//{*}title"))
    doi = next((_flat(n) for n in root.iterfind(".//{*}idno") if (n.get("type") or "").lower() == "doi"), "")
    yield "metadata", 0, "title", "", "", title
    yield "metadata", 0, "doi", "", "", doi
    authors = [name for name in (_flat(a) for a in root.iterfind(".//{*}sourceDesc//{*}author")) if name]
    for i, name in enumerate(authors):
        yield "metadata", i, "author", "", "", name

    sections = [("title", "Title", title), ("abstract", "Abstract", _flat(root.find(".//{*}profileDesc/{*}abstract")))]
    sections = [s for s in sections if s[2]]
    for div in root.iterfind(".//{*}text/{*}body/{*}div"):
        text = "\n\n".join(p for p in (_flat(p) for p in div.iterfind(".//{*}p")) if p)
        if text:
            sections.append(("body", _flat(div.find("./{*}head")) or f"Section {len(sections)}", text))
    for i, ref in enumerate(root.iterfind(".//{*}text/{*}back//{*}biblStruct"), 1):
        if _flat(ref):
            sections.append(("reference", f"Reference {i}", _flat(ref)))
    for i, (kind, heading, text) in enumerate(sections):
        yield "section", i, kind, heading, "", text.strip()

    assets = []
    for i, figure in enumerate(root.iterfind(".//{*}figure"), 1):
        kind = "table" if (figure.get("type") or "").lower() == "table" else "figure"
        caption = _flat(figure.find(".//{*}figDesc")) or _flat(figure.find(".//{*}head"))
        if caption or _flat(figure):
            assets.append((kind, figure.get(XML_ID) or f"{kind}-{i}", caption, _flat(figure)))
    for i, formula in enumerate(root.iterfind(".//{*}formula"), 1):
        if _flat(formula):
            assets.append(("formula", formula.get(XML_ID) or f"formula-{i}", "", _flat(formula)))
    for i, (kind, label, caption, text) in enumerate(assets):
        yield "asset", i, kind, label, caption, text


def parse_tei(documents: DataFrame) -> DataFrame:
    """Rows of many TEI documents (``source_file_id, tei``); malformed ones yield an error row."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for source_file_id, xml in zip(batch["source_file_id"], batch["tei"]):
                try:
                    out.extend((source_file_id, *row) for row in tei_rows(xml))
                except ET.ParseError as exc:
                    out.append((source_file_id, "error", 0, "parse_error", "", "", str(exc)))
            yield pd.DataFrame(
                out, columns=["source_file_id", "row_kind", "row_index", "kind", "title", "caption", "text"]
            )

    return documents.select("source_file_id", "tei").mapInPandas(parse, ROWS)


def tei_sections(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("row_kind") == "section").select(
        "source_file_id", F.col("row_index").alias("section_index"), F.col("kind").alias("section_type"), "title", "text",
        F.lit("grobid_tei").alias("extractor"),
    )


def tei_assets(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("row_kind") == "asset").select(
        "source_file_id", F.col("row_index").alias("asset_index"), F.col("kind").alias("asset_type"),
        F.col("title").alias("label"), "caption", F.col("text").alias("content"),
    )


def sections_with_fallback(tei: DataFrame, fallback: DataFrame) -> DataFrame:
    """Structured sections where a document has them, text sections for the others."""
    return tei.unionByName(fallback.join(tei.select("source_file_id"), "source_file_id", "left_anti"))


def request_tei(files: DataFrame, fetch: str) -> DataFrame:
    """TEI of PDF files (``source_file_id, content``) from a parsing service.

    ``fetch`` names a function ``module:function`` that turns PDF bytes into XML. A failure or
    an answer that is no TEI becomes a row with an error and no XML.
    """
    from oreweave.sources.providers import load_function

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        service = load_function(fetch)
        for batch in batches:
            rows = []
            for source_file_id, content in zip(batch["source_file_id"], batch["content"]):
                try:
                    xml = service(bytes(content))
                    if "<tei" not in xml.lower():
                        raise RuntimeError("the answer is not TEI XML")
                    rows.append((source_file_id, xml, None))
                except Exception as exc:
                    rows.append((source_file_id, None, str(exc)))
            yield pd.DataFrame(rows, columns=["source_file_id", "tei", "error"])

    return files.select("source_file_id", "content").mapInPandas(call, "source_file_id string, tei string, error string")
