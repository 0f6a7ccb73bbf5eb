"""Registered queries: a Spark plan over the input tables and, where SQL can say it, its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]

PLANS: dict[str, Plan] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    def register(plan: Plan) -> Plan:
        if name in PLANS:
            raise ValueError(f"query registered twice: {name}")
        PLANS[name] = plan
        if sql is not None:
            SQL[name] = sql
        return plan

    return register


# SQL fragments -----------------------------------------------------------------------------

BLANKS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
BREAKS = r"(?:\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}])"


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_collapse(column: str) -> str:
    return f"trim(regexp_replace({column}, '{BLANKS}+', ' ', 'g'))"


def sql_strip(column: str) -> str:
    return f"regexp_replace({column}, '^{BLANKS}+|{BLANKS}+$', '', 'g')"


def sql_lines(column: str) -> str:
    """Lines of a non-empty text without a trailing empty one."""
    return f"string_split_regex(regexp_replace({column}, '{BREAKS}$', ''), '{BREAKS}')"


def sql_chunks(source: str, keys: str, text: str = "text", size: int = 1800, overlap: int = 250) -> str:
    """Subquery: keys, chunk_index, chunk_text."""
    step = size - overlap
    return f"""(
      SELECT {keys}, i AS chunk_index, substring(t, i * {step} + 1, {size}) AS chunk_text
      FROM (
        SELECT {keys}, t, unnest(range(0, (1 + ceil(greatest(length(t) - {size}, 0) / {step}.0))::BIGINT)) AS i
        FROM (SELECT {keys}, {sql_collapse(text)} AS t FROM {source}) WHERE length(t) > 0
      )
    )"""


def sql_list(values) -> str:
    return "[" + ", ".join(sql_text(v) for v in values) + "]"


def sql_sum_contains(column: str, words) -> str:
    return "(" + " + ".join(f"contains({column}, {sql_text(w)})::INT" for w in words) + ")"
