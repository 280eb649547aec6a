"""Inputs that Spark and DuckDB read from the same SQL text."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..session import table


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The rows of a SQL text that names tables as {lineitem}."""
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in set(re.findall(r"{(\w+)}", sql))})


def duck(sql: str) -> str:
    return re.sub(r"{(\w+)}", r"\1", sql)


def ticked(sql: str) -> str:
    """A SQL text with quoted names as Spark quotes them."""
    return sql.replace('"', "`")


#: A picture as wide as 64 and as high as there are suppliers, with values of a byte.
PIXELS = "select l_partkey % 64 as x, l_suppkey as y, cast(sum(l_quantity) as bigint) % 256 as v, cast(sum(l_linenumber) as bigint) * 5 % 256 as a from {lineitem} group by l_partkey % 64, l_suppkey"
#: One grid of all orders, 25 cells a row.
GRID = 'select o_orderkey as id, cast(floor(o_orderkey / 25) as bigint) as "row", o_orderkey % 25 as "column", cast(floor(o_totalprice) as bigint) as price, o_orderpriority as priority from {orders}'


def times(a: str, b: str) -> str:
    """The product of two lists of nine, in DuckDB's SQL."""
    return "[" + ", ".join(" + ".join(f"{a}[{3 * r + k + 1}] * {b}[{3 * k + q + 1}]" for k in range(3)) for r in range(3) for q in range(3)) + "]"


def turn(v: list[str]) -> str:
    """A rotation about a vector, for lengths over 0; times stands for the length."""
    x, y, z = v
    s, k = "(sin(t) / t)", "((1 - cos(t)) / (t * t))"
    return f"[1 - {k} * (({y}) ** 2 + ({z}) ** 2), {k} * {x} * {y} - {s} * {z}, {k} * {x} * {z} + {s} * {y}, {k} * {x} * {y} + {s} * {z}, 1 - {k} * (({x}) ** 2 + ({z}) ** 2), {k} * {y} * {z} - {s} * {x}, {k} * {x} * {z} - {s} * {y}, {k} * {y} * {z} + {s} * {x}, 1 - {k} * (({x}) ** 2 + ({y}) ** 2)]"
