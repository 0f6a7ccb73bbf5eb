"""Property-graph tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oreweave.functions.text import camel_label
from oreweave.operators.dedupe import keep_first

NODE = "id STRING, type STRING, label STRING"


def _node(df: DataFrame, identifier: Column, kind: str, label: Column) -> DataFrame:
    return df.select(identifier.alias("id"), F.lit(kind).alias("type"), label.cast("string").alias("label"))


def _edge(df: DataFrame, source: Column, target: Column, relation: Column | str) -> DataFrame:
    kind = F.lit(relation) if isinstance(relation, str) else relation
    return df.select(source.alias("source"), target.alias("target"), kind.alias("relation"))


def tailings_graph(
    summaries: DataFrame, size_classes: DataFrame, relations: DataFrame | None = None, hypotheses: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Nodes (one per id) and edges (parallel edges kept) of plants, streams, classes and proposals."""
    plant = F.concat(F.lit("Plant:"), "plant")
    stream = F.concat_ws(":", F.lit("Stream"), "plant", "stream")
    size = F.concat_ws(":", F.lit("SizeClass"), "plant", "stream", "size_class")
    nodes = [
        _node(summaries, plant, "Plant", F.col("plant")),
        _node(summaries, stream, "TailingsStream", F.col("stream")),
        _node(size_classes, size, "SizeClass", F.col("size_class")),
    ]
    edges = [
        _edge(summaries, plant, stream, "HAS_STREAM"),
        _edge(size_classes, stream, size, "HAS_SIZE_CLASS"),
    ]
    for element in ("element28", "element29"):
        heavy = size_classes.where(F.coalesce(f"{element}_tonnes", F.lit(0.0)) != 0)
        edges.append(_edge(heavy, size, F.lit(f"KPI:reduce_{element}_loss"), "CONTRIBUTES_TO"))
    if relations is not None:
        nodes.append(_node(relations, F.col("source"), "EvidenceNode", F.col("source")))
        nodes.append(_node(relations, F.col("target"), "EvidenceNode", F.col("target")))
        edges.append(_edge(relations, F.col("source"), F.col("target"), F.col("relation")))
    if hypotheses is not None:
        hid = F.concat(F.lit("Hypothesis:"), "id")
        nodes.append(_node(hypotheses, hid, "Hypothesis", F.col("title")))
        edges.append(_edge(hypotheses.where(F.col("target_plant").isNotNull()), hid, F.concat(F.lit("Plant:"), "target_plant"), "TARGETS"))
        complete = hypotheses.where(
            F.col("target_plant").isNotNull() & F.col("target_stream").isNotNull() & F.col("target_size_class").isNotNull()
        )
        target = F.concat_ws(":", F.lit("SizeClass"), "target_plant", "target_stream", "target_size_class")
        edges.append(_edge(complete, hid, target, "TARGETS"))
        supported = hypotheses.withColumn("_e", F.explode("evidence"))
        edges.append(_edge(supported, hid, F.col("_e.source_id"), "SUPPORTED_BY"))
    all_nodes = nodes[0]
    for more in nodes[1:]:
        all_nodes = all_nodes.unionByName(more)
    all_edges = edges[0]
    for more in edges[1:]:
        all_edges = all_edges.unionByName(more)
    return unique_nodes(all_nodes), all_edges


def unique_nodes(nodes: DataFrame) -> DataFrame:
    """One row per id; evidence nodes give way to typed ones."""
    return nodes.groupBy("id").agg(
        F.min_by(F.struct("type", "label"), F.struct(F.col("type") == "EvidenceNode", "type", "label")).alias("_n")
    ).select("id", "_n.type", "_n.label")


def ledger_graph(
    documents: DataFrame, sections: DataFrame, chunks: DataFrame, entities: DataFrame, relations: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Graph tables of one or more runs.

    Nodes are unique by id. An edge needs both its ends; ends are checked with semi joins,
    which never multiply rows.
    """
    nodes = (
        documents.select(F.col("source_file_id").alias("id"), F.lit("Document").alias("label"), F.col("title").alias("name"), "run_id")
        .unionByName(sections.select(F.col("section_id").alias("id"), F.lit("Section").alias("label"), F.col("title").alias("name"), "run_id"))
        .unionByName(chunks.select(F.col("chunk_id").alias("id"), F.lit("Chunk").alias("label"), F.col("chunk_index").cast("string").alias("name"), "run_id"))
        .unionByName(entities.select(F.col("entity_id").alias("id"), camel_label(F.col("entity_type")).alias("label"), "name", "run_id"))
    )
    nodes = keep_first(nodes, ["id"], [F.asc("label"), F.asc("name")])
    links = (
        sections.select(F.col("source_file_id").alias("source"), F.col("section_id").alias("target"), F.lit("HAS_SECTION").alias("type"), F.lit(None).cast("string").alias("predicate"))
        .unionByName(chunks.select(F.col("source_file_id").alias("source"), F.col("chunk_id").alias("target"), F.lit("HAS_CHUNK").alias("type"), F.lit(None).cast("string").alias("predicate")))
        .unionByName(
            relations.where(F.col("subject_entity_id").isNotNull() & F.col("object_entity_id").isNotNull()).select(
                F.col("subject_entity_id").alias("source"), F.col("object_entity_id").alias("target"), F.lit("KG_RELATION").alias("type"), "predicate"
            )
        )
    )
    ids = nodes.select("id")
    edges = links.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(
        ids.withColumnRenamed("id", "target"), "target", "left_semi"
    )
    return nodes, edges.select("source", "target", "type", "predicate")


def relation_names(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations with the names of both ends; unknown ends stay null."""
    names = entities.select("entity_id", "name")
    subject = names.withColumnsRenamed({"entity_id": "subject_entity_id", "name": "subject_name"})
    target = names.withColumnsRenamed({"entity_id": "object_entity_id", "name": "object_name"})
    return relations.join(subject, "subject_entity_id", "left").join(target, "object_entity_id", "left")
