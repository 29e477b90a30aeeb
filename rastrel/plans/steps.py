"""Operators as SQL templates: one definition runs on DataFrames and writes its own oracle.

An Operator is a SELECT over {src} and further named inputs. Called with DataFrames it is a lazy
DataFrame, so Catalyst sees one plan however many operators are chained; called with Plans it is a
Plan, which can run on Spark or be written as nested SQL for another engine.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Source:
    """A named input: how Spark reads it, and the same as SQL over the raw tables."""

    read: Callable[[SparkSession, str], DataFrame]
    sql: str

    def frame(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.read(spark, sf_dir)

    def oracle(self) -> str:
        return self.sql


class Plan:
    def __init__(self, operator: Operator, inputs: dict[str, Plan | Source]):
        self.operator, self.inputs = operator, inputs

    def frame(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.operator.on(spark, **{k: v.frame(spark, sf_dir) for k, v in self.inputs.items()})

    def oracle(self) -> str:
        return (self.operator.duck or other_dialect(self.operator.sql)).format(**{k: f"({v.oracle()})" for k, v in self.inputs.items()})

    def then(self, *operators: Operator, **others: Plan | Source) -> Plan:
        out = self
        for o in operators:
            out = o(out, **{k: v for k, v in others.items() if "{" + k + "}" in o.sql})
        return out


@dataclass(frozen=True)
class Custom:
    """A step in Python over one input. Its oracle, if any, is a plan with the same rows by another way, an inverse's being its origin."""

    run: Callable[[DataFrame], DataFrame]
    src: Plan | Source
    same_as: Plan | Source | None = None

    def frame(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.run(self.src.frame(spark, sf_dir))

    def oracle(self) -> str | None:
        return self.same_as and self.same_as.oracle()


class Operator:
    """A template; duck is the oracle's own text where the two engines' words differ or the formula is stated another way."""

    def __init__(self, sql: str, duck: str | None = None):
        self.sql, self.duck = sql, duck

    def on(self, spark: SparkSession, **frames: DataFrame) -> DataFrame:
        return spark.sql(self.sql, **frames)

    def __call__(self, src: DataFrame | Plan | Source, **others) -> DataFrame | Plan:
        if isinstance(src, DataFrame):
            return self.on(src.sparkSession, src=src, **others)
        return Plan(self, {"src": src, **others})


def other_dialect(sql: str) -> str:
    """Spark SQL of the templates as DuckDB writes it: integer division, arrays and double literals."""
    for ours, theirs in ((" DIV ", " // "), ("ARRAY_SORT(", "list_sort("), (" ARRAY(", " list_value("), ("(ARRAY(", "(list_value("), ("ELEMENT_AT(", "list_extract(")):
        sql = sql.replace(ours, theirs)
    return re.sub(r"(?<![\w.])(\d+(?:\.\d+)?(?:[eE]-?\d+)?)D\b", r"(\1)::DOUBLE", sql)
