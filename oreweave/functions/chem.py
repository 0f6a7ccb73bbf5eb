"""Chemistry-aware name expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from oreweave import constants as K


def formula_elements(name: Column) -> Column:
    return F.regexp_extract_all(name, F.lit("[A-Z][a-z]?"), F.lit(0))


def is_formula(name: Column) -> Column:
    elements = formula_elements(name)
    return (
        ~name.isin(K.ELEMENT_SYMBOLS)
        & (F.size(elements) >= 2)
        & F.forall(elements, lambda e: e.isin(K.ELEMENT_SYMBOLS))
    )


def aliases(name: Column) -> Column:
    compact = F.replace(F.replace(name, F.lit("-"), F.lit("")), F.lit(" "), F.lit(""))
    extra = F.when(F.lower(name) == "ti-6al-4v", F.array(F.lit("Ti6Al4V"), F.lit("Ti 6Al 4V"))).otherwise(
        F.array().cast("array<string>")
    )
    names = F.array_distinct(F.concat(F.array(compact), extra))
    return F.array_sort(F.filter(names, lambda a: (a != "") & (a != name)))


def material_classes(name: Column) -> Column:
    compact = F.replace(F.lower(name), F.lit(" "), F.lit(""))
    hits = [
        F.when(compact == value if rule == "equals" else F.contains(compact, F.lit(value)), F.lit(label))
        for rule, value, label in K.CLASS_RULES
    ]
    return F.array_distinct(F.array_compact(F.array(*hits)))


def predicate_for(entity_type: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, predicate in K.PREDICATE_BY_TYPE.items():
        out = F.when(entity_type == name, predicate).otherwise(out)
    return out
