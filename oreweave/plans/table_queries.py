"""Profiling, scoring and optimizer queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from oreweave import constants as K
from oreweave.functions.scoring import component_scores, variant_score, weighted_score
from oreweave.operators import profiling, ranking
from oreweave.operators.optimizer import METRICS, improve
from oreweave.plans.kg_queries import SQL_RECORDS
from oreweave.plans.registry import query, sql_text
from oreweave.tables import spread, table, tailings_records

_ORDER_COLUMNS = [
    ("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"), ("o_totalprice", "double"),
    ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string"),
]


@query("column_profile", " UNION ALL ".join(
    f"SELECT {i} AS position, '{c}' AS column_name, '{t}' AS data_type, count({c}) AS non_null, count(*) AS row_count FROM orders"
    for i, (c, t) in enumerate(_ORDER_COLUMNS, 1)))
def column_profile(spark, sf_dir):
    return profiling.column_profile(table(spark, sf_dir, "orders"))


def _describe_sql(relation: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c})::DOUBLE AS min, "
        f"round(quantile_cont({c}::DOUBLE, 0.25), 6) AS p25, round(quantile_cont({c}::DOUBLE, 0.5), 6) AS p50, round(quantile_cont({c}::DOUBLE, 0.75), 6) AS p75, max({c})::DOUBLE AS max FROM {relation}"
        for c in columns
    )


_LINE_NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("describe_stats", _describe_sql("lineitem", _LINE_NUMBERS))
def describe_stats(spark, sf_dir):
    stats = profiling.describe(table(spark, sf_dir, "lineitem"))
    rounded = [F.round(c, 6).alias(c) for c in ("mean", "std", "min", "p25", "p50", "p75", "max")]
    return stats.select("column_name", "count", *rounded)


@query("key_metrics", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, round(avg({c}), 6) AS mean, round(median({c}::DOUBLE), 6) AS median, round(sum({c}::DECIMAL(30,6))::DOUBLE, 2) AS sum FROM lineitem"
    for c in profiling.key_metric_columns(_LINE_NUMBERS)))
def key_metrics(spark, sf_dir):
    """Columns picked by name as a converter does; text and dates drop out because nothing in them is a number."""
    stats = profiling.key_metrics(table(spark, sf_dir, "lineitem"))
    return stats.select("column_name", "min", "max", F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"), F.round("sum", 2).alias("sum"))


@query("group_quantiles", """
  SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90 FROM events GROUP BY event_type
""")
def group_quantiles(spark, sf_dir):
    rows = profiling.exact_quantiles(table(spark, sf_dir, "events"), ["event_type"], "value", [0.5, 0.9])
    return rows.groupBy("event_type").agg(
        F.round(F.max(F.when(F.col("probability") == 0.5, F.col("quantile"))), 6).alias("p50"),
        F.round(F.max(F.when(F.col("probability") == 0.9, F.col("quantile"))), 6).alias("p90"),
    )


@query("head_rows", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def head_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", (-F.col("o_totalprice")).alias("_k"))
    return profiling.head_rows(rows, ["_k", "o_orderkey"], 50).drop("_k")


@query("file_stats", """
  SELECT event_type AS ftype, count(*) AS files, count(*) FILTER (value <= 20 AND event_id % 2 = 0) AS ok, count(*) FILTER (value > 20) AS skipped,
    count(*) FILTER (value <= 20 AND event_id % 2 = 1) AS errors FROM events GROUP BY event_type
""")
def file_stats(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("ftype"), (F.col("event_id") % 2 == 0).alias("ok"), F.when(F.col("value") > 20, "too big").alias("skipped_reason")
    )
    return profiling.run_file_stats(rows)


@query("argmax", f"""
  SELECT DISTINCT ON (plant) plant, stream, size_class, element28_tonnes + element29_tonnes AS total_tonnes FROM {SQL_RECORDS}
  ORDER BY plant, total_tonnes DESC, stream, size_class
""")
def argmax(spark, sf_dir):
    best = ranking.richest(tailings_records(spark, sf_dir), ["stream", "size_class"], keys=["plant"])
    return best.select("plant", "stream", "size_class", "total_tonnes")


@query("priority_topn", f"""
  SELECT plant, stream, size_class, greatest(element28_tonnes, element29_tonnes) AS priority FROM {SQL_RECORDS}
  ORDER BY priority DESC, plant, stream, size_class LIMIT 8
""")
def priority_topn(spark, sf_dir):
    return ranking.size_class_order(tailings_records(spark, sf_dir)).select("plant", "stream", "size_class", "priority")


@query("distinct_plants", "SELECT DISTINCT 'P' || l_suppkey AS plant FROM lineitem")
def distinct_plants(spark, sf_dir):
    return tailings_records(spark, sf_dir).select("plant").distinct()


_CHANGES = ["Настроить режим флотации", "Замена насосов и добавление линии", "Сравнить варианты", "Новый контур и контроль воды"]
_CHANGE = "[" + ", ".join(sql_text(c) for c in _CHANGES) + "][p_partkey % 4 + 1]"


def _any(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, {sql_text(w)})" for w in words) + ")"


_W = K.SCORE_WEIGHTS
_NORM = sum(v for k, v in _W.items() if k != "risk")
_POSITIVE = " + ".join(f"{w!r}::DOUBLE * {name}" for name, w in _W.items() if name != "risk")


@query("weighted_score", f"""
  WITH base AS (
    SELECT p_partkey, lower({_CHANGE}) AS low, p_size AS n_evidence, p_partkey % 6 AS chain, p_retailprice AS tonnes,
      CASE WHEN p_type = 'ECONOMY' THEN 'expert_seed' ELSE 'numeric_priority' END AS generator, (SELECT max(p_retailprice) FROM part) AS top FROM part
  ), flags AS (
    SELECT *, {_any('low', K.EXISTING_EQUIPMENT_WORDS)} AS existing, {_any('low', K.HIGH_CAPEX_WORDS)} AS capex,
      least(1.0::DOUBLE, tonnes / greatest(1.0::DOUBLE, top)) AS kpi_impact FROM base
  ), scores AS (
    SELECT *, CASE WHEN existing THEN 0.85 WHEN capex THEN 0.55 ELSE 0.70 END::DOUBLE AS feasibility,
      least(1.0::DOUBLE, 0.25::DOUBLE + 0.15::DOUBLE * n_evidence) AS evidence_strength,
      CASE WHEN chain >= 4 THEN 0.90 ELSE 0.55 END::DOUBLE AS causal_consistency,
      CASE WHEN generator <> 'expert_seed' THEN 0.65 ELSE 0.35 END::DOUBLE AS novelty,
      least(1.0::DOUBLE, 0.35::DOUBLE + kpi_impact * 0.65::DOUBLE) AS business_value,
      CASE WHEN existing THEN 0.85 ELSE 0.55 END::DOUBLE AS implementability,
      greatest(0.05::DOUBLE, least(1.0::DOUBLE, 0.35::DOUBLE + CASE WHEN capex THEN 0.25 ELSE 0 END::DOUBLE - CASE WHEN existing THEN 0.10 ELSE 0 END::DOUBLE)) AS risk
    FROM flags
  )
  SELECT p_partkey, round(risk, 6) AS risk, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, ({_POSITIVE} - {_W['risk']!r}::DOUBLE * risk) / {_NORM!r}::DOUBLE)), 6) AS final_score FROM scores
""")
def weighted(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    change = F.get(F.array(*[F.lit(c) for c in _CHANGES]), F.pmod("p_partkey", F.lit(4)).cast("int"))
    scores = component_scores(
        change, F.col("p_size"), F.pmod("p_partkey", F.lit(6)), F.when(F.col("p_type") == "ECONOMY", "expert_seed").otherwise("numeric_priority"),
        F.col("p_retailprice"), parts.agg(F.max("p_retailprice")).scalar(),
    )
    return parts.select("p_partkey", F.round(scores["risk"], 6).alias("risk"), F.round(weighted_score(scores), 6).alias("final_score"))


_FORBIDDEN, _UNAVAILABLE = ["bolt"], ["ring"]


@query("validate_rules", """
  SELECT p_partkey, array_to_string(list_filter([
      CASE WHEN contains(low, 'bolt') THEN 'Запрещенный элемент в гипотезе: bolt' END,
      CASE WHEN contains(low, 'ring') THEN 'Недоступное оборудование: ring' END,
      CASE WHEN contains(low, 'новый') THEN 'Ограничение no_capex: гипотеза требует капитального изменения или нового узла.' END,
      CASE WHEN p_size % 10 = 0 THEN 'Нет evidence-фрагментов.' END,
      CASE WHEN p_size % 6 < 3 THEN 'Недостаточно полная причинная цепочка.' END,
      CASE WHEN p_size % 7 = 0 THEN 'Нет плана проверки.' END], lambda x: x IS NOT NULL), '; ') AS warnings
  FROM (SELECT *, lower(p_name || CASE WHEN p_partkey % 3 = 0 THEN ' Новый узел' ELSE '' END) AS low FROM part)
""")
def validate_rules(spark, sf_dir):
    text = F.concat("p_name", F.when(F.col("p_partkey") % 3 == 0, " Новый узел").otherwise(""))
    size = F.col("p_size")
    warnings = ranking.validation_warnings(text, size % 10, size % 6, size % 7, _FORBIDDEN, _UNAVAILABLE, no_capex=True)
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(warnings, "; ").alias("warnings"))


@query("quality_metrics", """
  WITH m AS (
    SELECT source AS profile_id, count(*) AS hypotheses, avg(least(1.0, n_chars / 4000.0::DOUBLE)) AS avg_final_score,
      avg((quality IS NOT NULL)::INT::DOUBLE) AS evidence_coverage, avg((coalesce(quality, 0) = 1)::INT::DOUBLE) AS causal_coverage,
      avg((coalesce(toxic, 0) = 1)::INT::DOUBLE) AS warning_rate, count(DISTINCT lang) / 6.0::DOUBLE AS generator_diversity,
      least(1.0, count(*) / 60.0::DOUBLE) AS corpus_use, least(1.0, count(*) / 18.0::DOUBLE) AS hypothesis_breadth
    FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source)
  SELECT profile_id, hypotheses, round_even(avg_final_score, 6) AS avg_final_score, round_even(evidence_coverage, 6) AS evidence_coverage,
    round_even(causal_coverage, 6) AS causal_coverage, round_even(warning_rate, 6) AS warning_rate, round_even(generator_diversity, 6) AS generator_diversity,
    round_even(corpus_use, 6) AS corpus_use, round_even(hypothesis_breadth, 6) AS hypothesis_breadth,
    round_even(greatest(0.0, least(1.0, 0.30 * avg_final_score + 0.18 * evidence_coverage + 0.16 * causal_coverage + 0.12 * generator_diversity
      + 0.10 * corpus_use + 0.10 * hypothesis_breadth - 0.06 * warning_rate)), 6) AS quality_score FROM m
""")
def quality_metrics(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    rows = docs.join(table(spark, sf_dir, "labels"), "doc_id", "left")

    def share(condition):
        return F.avg(condition.cast("double"))

    metrics = rows.groupBy(F.col("source").alias("profile_id")).agg(
        F.count("*").alias("hypotheses"),
        F.avg(F.least(F.lit(1.0), F.col("n_chars") / 4000.0)).alias("avg_final_score"),
        share(F.col("quality").isNotNull()).alias("evidence_coverage"),
        share(F.coalesce("quality", F.lit(0)) == 1).alias("causal_coverage"),
        share(F.coalesce("toxic", F.lit(0)) == 1).alias("warning_rate"),
        (F.count_distinct("lang") / 6.0).alias("generator_diversity"),
        F.least(F.lit(1.0), F.count("*") / 60.0).alias("corpus_use"),
        F.least(F.lit(1.0), F.count("*") / 18.0).alias("hypothesis_breadth"),
    )
    return ranking.with_quality(metrics)


# Metric vectors of the optimizer, one per part.
_VECTOR = {
    "interpretability": ("p_size", 50), "evidence_grounding": ("p_partkey", 97), "domain_fit": ("p_partkey", 89),
    "modernity_2026": ("p_partkey", 83), "local_runnability": ("p_partkey", 79), "implementation_risk": ("p_partkey", 71),
}
_START = ", ".join(f"({c} % {m}) / {float(m)!r}::DOUBLE AS {name}" for name, (c, m) in _VECTOR.items())


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.pmod("p_partkey", F.lit(100)).cast("int").alias("number"),
        *[(F.pmod(F.col(c), F.lit(m)) / float(m)).alias(name) for name, (c, m) in _VECTOR.items()],
    )


def _sql_variant_score(prefix: str = "") -> str:
    total = " + ".join(f"({w!r}::DOUBLE * {prefix}{name})" for name, w in K.VARIANT_WEIGHTS.items())
    return f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.0::DOUBLE + {total}))"


@query("variant_score", f"SELECT p_partkey, round({_sql_variant_score()}, 6) AS score FROM (SELECT p_partkey, {_START} FROM part)")
def variant_scores(spark, sf_dir):
    return _vectors(spark, sf_dir).select("p_partkey", F.round(variant_score({m: F.col(m) for m in METRICS}), 6).alias("score"))


def _sql_step(metric: str, delta: float) -> str:
    room = metric if metric == "implementation_risk" else f"(1.0::DOUBLE - {metric})"
    return f"{abs(delta)!r}::DOUBLE * greatest({room}, 0.02::DOUBLE)"


def _sql_iterate(iterations: int) -> str:
    gains = []
    for index, (_, deltas) in enumerate(K.IMPROVEMENT_ACTIONS):
        terms = " + ".join(f"{abs(K.VARIANT_WEIGHTS[m])!r}::DOUBLE * ({_sql_step(m, d)})" for m, d in deltas.items())
        gains.append(f"0.0::DOUBLE + {terms} + ((i + {index} + number) % {len(K.IMPROVEMENT_ACTIONS)}) * 0.000001::DOUBLE")
    damping = "(1.0::DOUBLE / (1.0::DOUBLE + (i - 1) / 35.0::DOUBLE))"
    moved = []
    for metric in METRICS:
        cases = ""
        for index, (_, deltas) in enumerate(K.IMPROVEMENT_ACTIONS):
            if metric in deltas:
                sign = "-" if metric == "implementation_risk" else "+"
                cases += f" WHEN {index} THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, {metric} {sign} ({_sql_step(metric, deltas[metric])}) * {damping}))"
        moved.append(f"CASE choice{cases} ELSE {metric} END AS {metric}")
    names = ", ".join(METRICS)
    return f"""
      WITH RECURSIVE start AS (SELECT p_partkey, (p_partkey % 100)::BIGINT AS number, {_START} FROM part),
      steps AS (
        SELECT p_partkey, number, 1::BIGINT AS i, {names} FROM start
        UNION ALL
        SELECT p_partkey, number, i + 1, {', '.join(moved)} FROM (
          SELECT *, list_position(gains, list_max(gains)) - 1 AS choice FROM (SELECT *, [{', '.join(gains)}] AS gains FROM steps WHERE i <= {iterations}))
      )
      SELECT f.p_partkey, round({_sql_variant_score('s.')}, 6) AS start_score, round({_sql_variant_score('f.')}, 6) AS final_score,
        {', '.join(f'round(f.{m}, 6) AS {m}' for m in METRICS)}
      FROM steps f JOIN start s USING (p_partkey) WHERE f.i = {iterations + 1}"""


@query("iterate", _sql_iterate(100))
def iterate(spark, sf_dir):
    """One hundred greedy improvement steps for every part."""
    final = improve(spread(_vectors(spark, sf_dir)), "number", 100)
    return final.select("p_partkey", *[F.round(c, 6).alias(c) for c in ("start_score", "final_score", *METRICS)])
