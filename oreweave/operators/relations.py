"""Relations between entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oreweave import constants as K
from oreweave.functions import chem
from oreweave.functions import text as T
from oreweave.functions.hashing import stable_id
from oreweave.operators.dedupe import keep_first
from oreweave.operators.matching import contains_join
from oreweave.session import stored

COLUMNS = [
    "relation_id", "run_id", "subject_entity_id", "predicate", "object_entity_id", "object_value", "evidence_text",
    "evidence_chunk_id", "source_file_id", "confidence", "extractor",
]


def entities_in_contexts(contexts: DataFrame, entities: DataFrame, evidence: bool = True) -> DataFrame:
    """(context, entity) pairs: the normalized name occurs anywhere in the context text.

    Materials and alloys bring the snippet around them along, so no later step needs the text;
    without ``evidence`` it stays null."""
    named = entities.select("run_id", "entity_id", "entity_type", "name", "normalized")
    text, name = F.col("_text"), F.col("name")
    around = F.when(F.lower(name) == F.col("normalized"), T.snippet(text, name, at=F.col("_at"))).otherwise(T.snippet(text, name))
    pairs = contains_join(
        contexts, named, ["run_id", "context_type", "context_id"], "text", ["entity_id", "entity_type", "name", "normalized"],
        "normalized", on=["run_id"], carry=["context_index", "source_file_id"],
        derive={"snippet": F.when(F.col("entity_type").isin("material", "alloy"), around) if evidence else F.lit(None).cast("string")},
    )
    return stored(pairs)  # several relations are built from it


def cooccurrence_relations(found: DataFrame) -> DataFrame:
    """Materials and alloys linked to the described entities of the same context.

    Only types with a predicate can be objects; those come from the fixed term catalog, so a
    context yields at most (materials x catalog terms) rows, never all pairs of its entities.
    """
    key = ["run_id", "context_type", "context_id"]
    subjects = found.where(F.col("entity_type").isin("material", "alloy")).select(
        *key, F.col("entity_id").alias("subject_entity_id"), "snippet", "source_file_id"
    )
    objects = found.where(F.col("entity_type").isin(list(K.PREDICATE_BY_TYPE))).select(
        *key,
        F.col("entity_id").alias("object_entity_id"),
        F.col("name").alias("object"),
        chem.predicate_for(F.col("entity_type")).alias("predicate"),
    )
    return subjects.join(objects, key).select(
        stable_id(
            F.col("run_id"), F.col("subject_entity_id"), F.col("predicate"), F.col("object_entity_id"), F.col("context_id")
        ).alias("relation_id"),
        "run_id",
        "subject_entity_id",
        "predicate",
        "object_entity_id",
        F.lit(None).cast("string").alias("object_value"),
        F.col("snippet").alias("evidence_text"),
        F.col("context_id").alias("evidence_chunk_id"),
        "source_file_id",
        F.lit(K.COOCCURRENCE_CONFIDENCE).alias("confidence"),
        F.lit("cooccurrence_rules").alias("extractor"),
    )


def class_relations(found: DataFrame, entities: DataFrame) -> DataFrame:
    """Materials linked to the classes their names imply, when the class is itself an entity.

    The relation id leaves the context out, so the last context of a file supplies the evidence.
    """
    classes = entities.where(F.col("entity_type") == "material_class").select(
        "run_id", F.col("entity_id").alias("object_entity_id"), F.col("normalized").alias("class_name")
    )
    named = (
        found.where(F.col("entity_type").isin("material", "alloy"))
        .select(
            "run_id", "context_type", "context_id", "context_index", "source_file_id", "entity_id", "name",
            F.explode(chem.material_classes(F.col("name"))).alias("class_name"),
        )
        .join(classes, ["run_id", "class_name"])
    )
    last = Window.partitionBy("run_id", "entity_id", "object_entity_id", "source_file_id").orderBy(
        F.desc("context_type"), F.desc("context_index")
    )
    return (
        named.withColumn("_n", F.row_number().over(last))
        .where(F.col("_n") == 1)
        .select(
            stable_id(
                F.col("run_id"), F.col("entity_id"), F.lit("belongs_to_class"), F.col("object_entity_id"),
                F.col("source_file_id"),
            ).alias("relation_id"),
            "run_id",
            F.col("entity_id").alias("subject_entity_id"),
            F.lit("belongs_to_class").alias("predicate"),
            "object_entity_id",
            F.lit(None).cast("string").alias("object_value"),
            F.col("name").alias("evidence_text"),
            F.col("context_id").alias("evidence_chunk_id"),
            "source_file_id",
            F.lit(K.CLASS_RULE_CONFIDENCE).alias("confidence"),
            F.lit("class_rules").alias("extractor"),
        )
    )


def citation_relations(records: DataFrame) -> DataFrame:
    """``cites`` rows of literature records, whether the work is nested or at the top level."""
    p = F.from_json("payload", "referenced_works ARRAY<STRING>, openalex STRUCT<referenced_works: ARRAY<STRING>>")
    works = records.where(F.col("record_type") == "openalex_work").withColumn("_p", p)
    cited = F.coalesce(F.col("_p.referenced_works"), F.col("_p.openalex.referenced_works"))
    rows = works.select("run_id", "source_file_id", F.explode(cited).alias("object_value"))
    return rows.select(
        stable_id(F.col("run_id"), F.col("source_file_id"), F.lit("cites"), F.col("object_value")).alias("relation_id"),
        "run_id",
        F.lit(None).cast("string").alias("subject_entity_id"),
        F.lit("cites").alias("predicate"),
        F.lit(None).cast("string").alias("object_entity_id"),
        "object_value",
        F.col("object_value").alias("evidence_text"),
        F.lit(None).cast("string").alias("evidence_chunk_id"),
        "source_file_id",
        F.lit(K.CITES_CONFIDENCE).alias("confidence"),
        F.lit("openalex_metadata").alias("extractor"),
    ).dropDuplicates(["relation_id"])


def provider_relations(proposed: DataFrame, entities: DataFrame, extractor: str) -> DataFrame:
    """Resolve proposed (subject, predicate, object) rows by entity id or by name.

    proposed: run_id, subject, predicate, object, evidence_text, confidence. Rows with an
    unknown end or a predicate outside the allowed set are dropped.
    """
    by_id = entities.select("run_id", F.col("entity_id").alias("_key"), F.col("entity_id").alias("_found"))
    by_name = (
        entities.groupBy("run_id", F.lower("name").alias("_key")).agg(F.max("entity_id").alias("_found"))
    )

    def resolve(df: DataFrame, column: str) -> DataFrame:
        ids = by_id.withColumnsRenamed({"_key": column, "_found": "_by_id"})
        names = by_name.withColumnsRenamed({"_key": "_lower", "_found": "_by_name"})
        return (
            df.join(ids, ["run_id", column], "left")
            .withColumn("_lower", F.lower(column))
            .join(names, ["run_id", "_lower"], "left")
            .withColumn(f"{column}_entity_id", F.coalesce("_by_id", "_by_name"))
            .drop("_by_id", "_by_name", "_lower")
        )

    allowed = proposed.where(F.col("predicate").isin(K.PROVIDER_PREDICATES))
    resolved = resolve(resolve(allowed, "subject"), "object").where(
        F.col("subject_entity_id").isNotNull() & F.col("object_entity_id").isNotNull()
    )
    return resolved.select(
        stable_id(
            F.col("run_id"), F.lit(extractor), F.col("subject_entity_id"), F.col("predicate"), F.col("object_entity_id"),
            F.coalesce("evidence_text", F.lit("")),
        ).alias("relation_id"),
        "run_id",
        "subject_entity_id",
        "predicate",
        "object_entity_id",
        F.lit(None).cast("string").alias("object_value"),
        F.substring(F.coalesce("evidence_text", F.lit("")), 1, K.RELATION_EVIDENCE_CHARS).alias("evidence_text"),
        F.lit(None).cast("string").alias("evidence_chunk_id"),
        F.lit(None).cast("string").alias("source_file_id"),
        F.coalesce("confidence", F.lit(K.PROVIDER_RELATION_CONFIDENCE)).alias("confidence"),
        F.lit(extractor).alias("extractor"),
    ).transform(lambda rows: keep_first(rows, ["relation_id"], [F.desc("confidence")]))


def build_relations(contexts: DataFrame, entities: DataFrame, records: DataFrame | None = None) -> DataFrame:
    found = entities_in_contexts(contexts, entities)
    out = cooccurrence_relations(found).unionByName(class_relations(found, entities))
    if records is not None:
        out = out.unionByName(citation_relations(records))
    return out.select(*COLUMNS)


def loss_relations(size_classes: DataFrame) -> DataFrame:
    """CONTAINS_LOSS rows, one per positive element tonnage of a size-class record."""
    element = F.stack(
        F.lit(2), F.lit("element28"), F.col("element28_tonnes"), F.lit("element29"), F.col("element29_tonnes")
    ).alias("target", "tonnes")
    rows = size_classes.select("plant", "stream", "size_class", element).where(F.col("tonnes") > 0)
    return rows.select(
        F.concat_ws(":", "plant", "stream", "size_class").alias("source"),
        F.lit("CONTAINS_LOSS").alias("relation"),
        "target",
        F.format_string(
            "%s %s класс %s: %s потери %s т.", "plant", "stream", "size_class", "target", T.one_decimal(F.col("tonnes"))
        ).alias("evidence_text"),
        F.lit(0.95).alias("confidence"),
    )


def recovery_relations(extractability: DataFrame) -> DataFrame:
    target = F.concat_ws(":", "plant", "stream")
    relation = F.when(F.col("extractable"), "POTENTIALLY_RECOVERABLE").otherwise("NOT_RECOVERABLE_WITH_CURRENT_TECH")
    zero = F.lit(0.0)
    return extractability.select(
        target.alias("source"),
        relation.alias("relation"),
        F.lit("mineralogical_forms").alias("target"),
        F.format_string(
            "%s: %s, Э28 %s т, Э29 %s т.", target, relation,
            T.one_decimal(F.coalesce("element28_tonnes", zero)), T.one_decimal(F.coalesce("element29_tonnes", zero)),
        ).alias("evidence_text"),
        F.lit(0.90).alias("confidence"),
    )
