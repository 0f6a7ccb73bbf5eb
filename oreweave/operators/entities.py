"""Entity extraction and aggregation."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oreweave import constants as K
from oreweave.functions import chem
from oreweave.functions import text as T
from oreweave.functions.hashing import stable_id

Catalog = Mapping[str, Sequence[str]]


def context_rows(chunks: DataFrame, sections: DataFrame | None = None) -> DataFrame:
    """Chunks followed by sections as one table of text contexts.

    chunks: run_id, source_file_id, chunk_id, chunk_index, text.
    sections: run_id, source_file_id, section_id, section_index, title, text.
    """
    rows = chunks.select(
        "run_id",
        "source_file_id",
        F.lit("chunk").alias("context_type"),
        F.col("chunk_id").alias("context_id"),
        F.col("chunk_index").alias("context_index"),
        "text",
    )
    if sections is None:
        return rows
    return rows.unionByName(
        sections.select(
            "run_id",
            "source_file_id",
            F.lit("section").alias("context_type"),
            F.col("section_id").alias("context_id"),
            F.col("section_index").alias("context_index"),
            F.concat_ws("\n", "title", "text").alias("text"),
        )
    )


def _regex_literal(term: str) -> str:
    return "".join("\\" + ch if not ch.isalnum() and ch != " " else ch for ch in term)


def _first_word(term: str) -> str:
    return re.match(r"[a-z0-9]+", term).group(0)


def term_present(low: Column, words: Column, term: str) -> Column:
    """Whole-word hit of a catalog term, given the catalog words of the text.

    A one-word term is decided by the words alone. A longer one is searched in the text, and
    only when its first word is there.
    """
    first = _first_word(term)
    known = F.array_contains(words, first)
    if first == term:
        return known
    pattern = rf"(?<![A-Za-z0-9]){_regex_literal(term)}(?![A-Za-z0-9])"
    return known & F.contains(low, F.lit(term)) & F.rlike(low, F.lit(pattern))


def _mention(entity_type: str | Column, name: Column, confidence: float) -> Column:
    kind = F.lit(entity_type) if isinstance(entity_type, str) else entity_type
    return F.struct(kind.alias("entity_type"), name.alias("name"), F.lit(confidence).alias("confidence"))


def catalog_hits(low: Column, catalog: Catalog = K.TERM_CATALOG) -> Column:
    """Array of the catalog terms present in a lower-case text; at most the catalog size.

    The text is split into words once and intersected with the first words of the catalog,
    instead of being searched once per term.
    """
    confidence = K.ENTITY_CONFIDENCE["term"]
    terms = [(kind, term.lower()) for kind, names in catalog.items() for term in names]
    first_words = sorted({_first_word(term) for _, term in terms})
    words = F.array_intersect(F.split(low, "[^a-z0-9]+"), F.array(*[F.lit(w) for w in first_words]))
    hits = F.transform(
        F.array(words),
        lambda present: F.array_compact(
            F.array(*[F.when(term_present(low, present, term), _mention(kind, F.lit(term), confidence)) for kind, term in terms])
        ),
    )
    return F.flatten(hits)


def text_mentions(text: Column, low: Column, catalog: Catalog = K.TERM_CATALOG) -> Column:
    """All entity mentions of a text in reading order of the rules: alloys, formulas with their
    elements, catalog terms."""
    alloys = F.transform(
        F.regexp_extract_all(text, F.lit(f"(?iU){K.ALLOY_PATTERN}"), F.lit(0)),
        lambda m: _mention("alloy", T.clean_name(m), K.ENTITY_CONFIDENCE["alloy"]),
    )
    formulas = F.filter(F.regexp_extract_all(text, F.lit(f"(?U){K.FORMULA_PATTERN}"), F.lit(0)), chem.is_formula)
    materials = F.flatten(
        F.transform(
            formulas,
            lambda m: F.concat(
                F.array(_mention("material", m, K.ENTITY_CONFIDENCE["material"])),
                F.transform(chem.formula_elements(m), lambda e: _mention("element", e, K.ENTITY_CONFIDENCE["element"])),
            ),
        )
    )
    return F.concat(alloys, materials, catalog_hits(low, catalog))


def entity_mentions(contexts: DataFrame, catalog: Catalog = K.TERM_CATALOG) -> DataFrame:
    """One row per mention with its position, found without any shuffle."""
    ids = ["run_id", "source_file_id", "context_type", "context_id", "context_index"]
    low = contexts.select(*ids, "text", F.lower("text").alias("_low"))
    return low.select(*ids, F.posexplode(text_mentions(F.col("text"), F.col("_low"), catalog)).alias("position", "_m")).select(
        *ids, "position", "_m.*"
    )


def record_entities(records: DataFrame) -> DataFrame:
    """Materials named by provider records (``run_id, source_file_id, record_type, payload``)."""
    p = F.from_json(
        "payload",
        "formula_pretty STRING, material_id STRING, name STRING, composition STRING, entry_id STRING, "
        "formationenergy_id STRING",
    )

    def filled(column: Column) -> Column:
        return F.when(column != "", column)

    is_mp = F.col("record_type") == "materials_project_summary"
    is_oqmd = F.col("record_type") == "oqmd_formationenergy"
    name = F.when(is_mp, F.coalesce(filled(F.col("_p.formula_pretty")), filled(F.col("_p.material_id")))).otherwise(
        F.coalesce(filled(F.col("_p.name")), filled(F.col("_p.composition")), filled(F.col("_p.entry_id")))
    )
    return (
        records.where(is_mp | is_oqmd)
        .withColumn("_p", p)
        .select(
            "run_id",
            "source_file_id",
            F.lit("material").alias("entity_type"),
            name.alias("name"),
            F.when(is_mp, F.lit(K.RECORD_CONFIDENCE["materials_project_summary"]))
            .otherwise(F.lit(K.RECORD_CONFIDENCE["oqmd_formationenergy"]))
            .alias("confidence"),
            F.when(is_mp, F.col("_p.material_id")).otherwise(F.col("_p.formationenergy_id")).alias("canonical_id"),
        )
        .where(F.col("name").isNotNull())
    )


def aggregate_entities(mentions: DataFrame, records: DataFrame | None = None) -> DataFrame:
    """Entities by (run, type, normalized name).

    Text mentions come before record mentions: a record only adds to the count of an entity
    the text already named. Observations stay rows (the mentions table) instead of a list, so
    a very frequent name costs one aggregation buffer per task.
    """
    first = ["_origin", "context_type", "source_file_id", "context_index", "position"]
    rows = mentions.select(
        "run_id", "source_file_id", "context_type", "context_index", "position", "entity_type", "name", "confidence",
        F.lit(None).cast("string").alias("canonical_id"), F.lit(0).alias("_origin"),
    )
    if records is not None:
        rows = rows.unionByName(
            records.select(
                "run_id", "source_file_id", "entity_type", "name", "confidence", "canonical_id",
                F.lit("record").alias("context_type"), F.lit(0).alias("context_index"), F.lit(0).alias("position"),
                F.lit(1).alias("_origin"),
            )
        )
    order = F.struct(*first)
    grouped = rows.groupBy("run_id", "entity_type", T.normalize_name(F.col("name")).alias("normalized")).agg(
        F.min_by(F.struct("name", "source_file_id", "canonical_id", "confidence"), order).alias("_first"),
        F.max(F.when(F.col("_origin") == 0, F.col("confidence"))).alias("_text_confidence"),
        F.count("*").alias("source_count"),
    )
    return grouped.select(
        stable_id(F.col("run_id"), F.col("entity_type"), F.col("normalized")).alias("entity_id"),
        "run_id",
        "entity_type",
        F.col("_first.name").alias("name"),
        "normalized",
        F.col("_first.canonical_id").alias("canonical_id"),
        F.coalesce("_text_confidence", F.col("_first.confidence")).alias("confidence"),
        "source_count",
        F.col("_first.source_file_id").alias("first_source_file_id"),
    )


def entity_document_counts(mentions: DataFrame) -> DataFrame:
    """Distinct source documents per entity, beside the raw mention count."""
    keys = ["run_id", "entity_type", "normalized"]
    rows = mentions.select("run_id", "entity_type", T.normalize_name(F.col("name")).alias("normalized"), "source_file_id")
    return rows.distinct().groupBy(*keys).agg(F.count("*").alias("document_count"))


def entity_aliases(mentions: DataFrame) -> DataFrame:
    """Distinct (entity, alias) rows of alloys; other types carry no aliases."""
    return (
        mentions.where(F.col("entity_type") == "alloy")
        .select("run_id", "entity_type", "name", F.explode(chem.aliases(F.col("name"))).alias("alias"))
        .select(
            stable_id(F.col("run_id"), F.col("entity_type"), T.normalize_name(F.col("name"))).alias("entity_id"),
            "run_id",
            "alias",
            T.normalize_name(F.col("alias")).alias("normalized_alias"),
        )
        .distinct()
    )


def observations(mentions: DataFrame, contexts: DataFrame) -> DataFrame:
    """Mention rows with their text window."""
    return mentions.join(contexts.select("context_type", "context_id", "text"), ["context_type", "context_id"]).select(
        "run_id", "entity_type", "name", "source_file_id", "context_id",
        T.snippet(F.col("text"), F.col("name")).alias("snippet"),
    )


def domain_entities(chunks: DataFrame, order: Sequence[str]) -> DataFrame:
    """Processes, equipment, minerals and size classes; the first spelling of each is kept.

    chunks: document_id, text and the ``order`` columns that give the reading order.
    """
    def hits(kind: str, pattern: str) -> Column:
        names = F.regexp_extract_all("text", F.lit(f"(?iU){pattern}"), F.lit(0))
        return F.transform(names, lambda m: F.struct(F.lit(kind).alias("entity_type"), T.collapse_ws(m).alias("name")))

    found = F.concat(*[hits(kind, pattern) for kind, pattern in K.DOMAIN_PATTERNS.items()])
    rows = chunks.select("document_id", *order, F.posexplode(found).alias("_pos", "_m")).select(
        "document_id", *order, "_pos", "_m.*", F.lower("_m.name").alias("normalized")
    )
    return rows.groupBy("entity_type", "normalized").agg(
        F.min_by(F.struct("name", "document_id"), F.struct(*order, "_pos")).alias("_first"),
        F.count("*").alias("mentions"),
    ).select(
        "entity_type", F.col("_first.name").alias("name"), "normalized",
        F.col("_first.document_id").alias("first_document_id"), "mentions",
    )
