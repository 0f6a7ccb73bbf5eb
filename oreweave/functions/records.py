"""Expressions over provider records (JSON payloads of literature and materials services)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from oreweave.functions.hashing import short_hash
from oreweave.functions.urls import normalize_doi

WORK = (
    "id STRING, doi STRING, title STRING, display_name STRING, publication_year INT, type STRING, cited_by_count INT, "
    "open_access STRUCT<is_oa: BOOLEAN, oa_url: STRING>, abstract_inverted_index MAP<STRING, ARRAY<INT>>, "
    "authorships ARRAY<STRUCT<author: STRUCT<display_name: STRING>>>, "
    "primary_location STRUCT<landing_page_url: STRING, pdf_url: STRING, source: STRUCT<display_name: STRING, issn: ARRAY<STRING>>>, "
    "best_oa_location STRUCT<landing_page_url: STRING, pdf_url: STRING>, "
    "topics ARRAY<STRUCT<id: STRING, display_name: STRING, score: DOUBLE>>, "
    "concepts ARRAY<STRUCT<display_name: STRING>>, keywords ARRAY<STRUCT<display_name: STRING, keyword: STRING>>, "
    "referenced_works ARRAY<STRING>"
)
UNPAYWALL = "best_oa_location STRUCT<url_for_pdf: STRING, url: STRING>"
OQMD = (
    "name STRING, entry_id STRING, calculation_id STRING, formationenergy_id STRING, composition STRING, "
    "composition_generic STRING, prototype STRING, spacegroup STRING, volume STRING, ntypes STRING, natoms STRING, "
    "unit_cell STRING, sites STRING, band_gap STRING, delta_e STRING, stability STRING, fit STRING, calculation_label STRING"
)
OQMD_FIELDS = [
    "name", "entry_id", "calculation_id", "icsd_id", "formationenergy_id", "duplicate_entry_id", "composition",
    "composition_generic", "prototype", "spacegroup", "volume", "ntypes", "natoms", "unit_cell", "sites", "band_gap",
    "delta_e", "stability", "fit", "calculation_label",
]
OQMD_TEXT_FIELDS = [
    "composition_generic", "prototype", "spacegroup", "volume", "ntypes", "natoms", "band_gap", "delta_e", "stability",
    "fit", "calculation_label",
]
MATERIAL = (
    "material_id STRING, formula_pretty STRING, formula STRING, band_gap STRING, energy_above_hull STRING, "
    "formation_energy_per_atom STRING, symmetry STRUCT<symbol: STRING>, structure STRING"
)
MATERIAL_FIELDS = [
    "material_id", "formula_pretty", "band_gap", "energy_above_hull", "formation_energy_per_atom", "symmetry", "structure",
]


def _line(label: str, value: Column) -> Column:
    return F.concat(F.lit(label), F.coalesce(value.cast("string"), F.lit("None")))


def _names(array: Column, separator: str) -> Column:
    kept = F.filter(F.transform(array, lambda x: x["display_name"]), lambda n: n.isNotNull() & (n != ""))
    return F.array_join(F.coalesce(kept, F.array().cast("array<string>")), separator)


def abstract_from_index(index: Column) -> Column:
    """Words of an inverted index in position order; a word may sit at many positions."""
    pairs = F.flatten(
        F.transform(
            F.map_entries(index),
            lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("position"), e["key"].alias("word"))),
        )
    )
    return F.coalesce(F.array_join(F.transform(F.array_sort(pairs), lambda p: p["word"]), " "), F.lit(""))


def abstract_last_word(index: Column) -> Column:
    """The other published reading: one word per position, the last index entry wins."""
    pairs = F.flatten(
        F.transform(
            F.map_entries(index),
            lambda e, i: F.transform(
                e["value"], lambda p: F.struct(p.alias("position"), (-i).alias("entry"), e["key"].alias("word"))
            ),
        )
    )
    ordered = F.array_sort(pairs)
    firsts = F.filter(
        ordered, lambda p, i: (i == 0) | (p["position"] != F.get(ordered, F.greatest(i - 1, F.lit(0)))["position"])
    )
    return F.coalesce(F.array_join(F.transform(firsts, lambda p: p["word"]), " "), F.lit(""))


def best_oa_url(work: Column, unpaywall: Column) -> Column:
    free = unpaywall["best_oa_location"]
    best, primary = work["best_oa_location"], work["primary_location"]
    return (
        F.when(free.isNotNull(), F.coalesce(free["url_for_pdf"], free["url"]))
        .when(best.isNotNull(), F.coalesce(best["pdf_url"], best["landing_page_url"]))
        .otherwise(F.coalesce(primary["pdf_url"], primary["landing_page_url"]))
    )


def literature_text(work: Column, unpaywall: Column, raw: Column) -> Column:
    """Document text of a harvested work: labelled lines, abstract, raw record."""
    keywords = F.filter(
        F.transform(work["keywords"], lambda k: F.coalesce(k["display_name"], k["keyword"])), lambda k: k.isNotNull()
    )
    open_access = F.initcap(work["open_access"]["is_oa"].cast("string"))
    return F.concat_ws(
        "\n",
        _line("OpenAlex work: ", work["id"]),
        _line("Title: ", F.coalesce(work["title"], work["display_name"])),
        _line("DOI: ", normalize_doi(work["doi"])),
        _line("Publication year: ", work["publication_year"]),
        _line("Type: ", work["type"]),
        _line("Cited by count: ", work["cited_by_count"]),
        _line("Open access: ", open_access),
        _line("OA URL: ", best_oa_url(work, unpaywall)),
        F.concat(F.lit("Topics: "), _names(work["topics"], ", ")),
        F.concat(F.lit("Concepts: "), _names(work["concepts"], ", ")),
        F.concat(
            F.lit("Keywords: "),
            F.array_join(F.coalesce(keywords, F.array().cast("array<string>")), ", "),
        ),
        F.lit(""),
        F.lit("Abstract:"),
        abstract_from_index(work["abstract_inverted_index"]),
        F.lit(""),
        F.lit("Raw metadata JSON:"),
        raw,
    )


def normalized_work(work: Column) -> Column:
    """Search-result form of a work."""
    location = work["primary_location"]
    authors = F.filter(
        F.transform(work["authorships"], lambda a: a["author"]["display_name"]), lambda n: n.isNotNull() & (n != "")
    )
    return F.struct(
        work["id"].alias("openalex_id"),
        work["doi"].alias("doi"),
        work["title"].alias("title"),
        work["publication_year"].alias("publication_year"),
        abstract_last_word(work["abstract_inverted_index"]).alias("abstract"),
        work["cited_by_count"].alias("cited_by_count"),
        location["source"]["display_name"].alias("journal"),
        F.coalesce(authors, F.array().cast("array<string>")).alias("authors"),
        work["topics"].alias("topics"),
        work["open_access"]["is_oa"].alias("is_oa"),
        work["open_access"]["oa_url"].alias("oa_url"),
        location["landing_page_url"].alias("landing_page_url"),
        location["pdf_url"].alias("pdf_url"),
    )


def search_text(work: Column) -> Column:
    """Document text of a normalised work."""

    def given(label: str, value: Column) -> Column:
        return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(label), value))

    return F.concat_ws(
        "\n",
        F.concat(F.lit("Title: "), F.coalesce(work["title"], F.lit("Untitled"))),
        F.concat(F.lit("DOI: "), F.coalesce(work["doi"], F.lit("n/a"))),
        F.concat(F.lit("Year: "), F.coalesce(work["publication_year"].cast("string"), F.lit("n/a"))),
        F.concat(F.lit("Citations: "), F.coalesce(work["cited_by_count"].cast("string"), F.lit("0"))),
        given("Journal: ", work["journal"]),
        given("Authors: ", F.array_join(work["authors"], "; ")),
        given("Topics: ", _names(work["topics"], "; ")),
        given("Open access URL: ", work["oa_url"]),
        F.lit(""),
        F.lit("Abstract:"),
        F.when(work["abstract"] != "", work["abstract"]).otherwise("(no abstract in OpenAlex)"),
        F.lit(""),
        F.lit("Source: OpenAlex metadata API. License: CC0."),
    )


def oqmd_key(record: Column, raw: Column) -> Column:
    """Formation-energy id, else ``entry:calculation``, else a hash of the record."""

    def given(value: Column) -> Column:
        return F.when(value != "", value)

    either = record["entry_id"].isNotNull() | record["calculation_id"].isNotNull()
    unknown = F.lit("unknown")
    pair = F.concat_ws(
        ":", F.coalesce(given(record["entry_id"]), unknown), F.coalesce(given(record["calculation_id"]), unknown)
    )
    return F.coalesce(given(record["formationenergy_id"]), F.when(either, pair), short_hash(raw))


def oqmd_text(record: Column, key: Column, raw: Column) -> Column:
    def line(name: str) -> Column:
        return F.when(record[name].isNotNull(), F.concat(F.lit(f"{name}: "), record[name]))

    def included(name: str) -> Column:
        return F.when(record[name].isNotNull(), F.lit(f"{name}: included as normalized JSON payload in structured_records."))

    return F.concat_ws(
        "\n",
        F.concat(F.lit("OQMD formationenergy_id: "), F.coalesce(record["formationenergy_id"], key)),
        F.concat(F.lit("Name: "), F.coalesce(record["name"], F.lit("unknown"))),
        F.concat(F.lit("Composition: "), F.coalesce(record["composition"], F.lit("unknown"))),
        F.lit("Source: OQMD REST formationenergy endpoint. Data license: CC BY 4.0."),
        *[line(name) for name in OQMD_TEXT_FIELDS],
        included("unit_cell"),
        included("sites"),
        F.lit(""),
        F.lit("Raw OQMD formationenergy JSON:"),
        raw,
    )


def material_text(record: Column, raw: Column) -> Column:
    def line(name: str) -> Column:
        return F.when(record[name].isNotNull(), F.concat(F.lit(f"{name}: "), record[name]))

    return F.concat_ws(
        "\n",
        F.concat(F.lit("Materials Project material_id: "), F.coalesce(record["material_id"], F.lit("unknown"))),
        F.concat(F.lit("Formula: "), F.coalesce(record["formula_pretty"], F.lit("unknown"))),
        F.lit("Source: Materials Project mp-api summary endpoint. Data license: CC BY 4.0."),
        line("energy_above_hull"),
        line("formation_energy_per_atom"),
        line("band_gap"),
        F.when(
            F.coalesce(record["symmetry"]["symbol"], F.lit("")) != "",
            F.concat(F.lit("symmetry: "), record["symmetry"]["symbol"]),
        ),
        F.when(
            record["structure"].isNotNull(), F.lit("structure: included as normalized JSON payload in structured_records.")
        ),
        F.lit(""),
        F.lit("Raw summary JSON:"),
        raw,
    )


def tailings_sentence(kind: str) -> Column:
    """Sentence of a workbook record, the text form that is chunked and searched."""

    def number(column: str) -> Column:
        return F.coalesce(F.col(column).cast("string"), F.lit("None"))

    where = F.concat_ws(" ", "plant", "stream")
    both = F.concat(F.lit("Э28 "), number("element28_tonnes"), F.lit(" т, Э29 "), number("element29_tonnes"), F.lit(" т"))
    if kind == "summary":
        return F.concat(where, F.lit(": "), both, F.lit(", СМТ "), number("dry_metric_tonnes"), F.lit("."))
    if kind == "size_class":
        return F.concat(where, F.lit(" класс "), F.col("size_class"), F.lit(": "), both, F.lit("."))
    marker = F.when(F.col("extractable"), "извлекаемый").otherwise("неизвлекаемый")
    return F.concat(where, F.lit(" "), marker, F.lit(": "), both, F.lit("."))
