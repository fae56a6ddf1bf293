"""Registry of the named queries and of the SQL that checks each of them."""

from __future__ import annotations

import re
import textwrap
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_CTES: dict[str, str] = {}


def cte(name: str, sql: str) -> None:
    """Declare a named sub-select that any oracle may refer to."""
    if name in _CTES:
        raise ValueError(f"duplicate sub-select {name}")
    _CTES[name] = textwrap.dedent(sql).strip()


def _needed(sql: str, seen: list[str]) -> list[str]:
    for word in dict.fromkeys(re.findall(r"\b(?:FROM|JOIN)\s+([A-Za-z_]\w*)", sql)):
        if word in _CTES and word not in seen:
            _needed(_CTES[word], seen)
            if word not in seen:
                seen.append(word)
    return seen


def compose(sql: str) -> str:
    """Prefix a select with every declared sub-select it uses, in order."""
    names = _needed(sql, [])
    body = textwrap.dedent(sql).strip()
    if not names:
        return body
    parts = ",\n".join(f"{n} AS (\n{textwrap.indent(_CTES[n], '  ')}\n)" for n in names)
    return f"WITH {parts}\n{body}"


def query(name: str, sql: str | None = None, digits: dict[str, int] | None = None):
    """Register a query; ``digits`` rounds the named double columns on both sides."""
    digits = digits or {}

    def wrap(fn: Callable) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            from ..sources.fixtures import Tables

            df = fn(Tables(spark, sf_dir))
            return df.select(*[(F.round(c, digits[c]) + F.lit(0.0)).alias(c) if c in digits else F.col(c) for c in df.columns])

        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = run
        if sql is not None:
            rounds = ", ".join(f"round({c}, {d}) + 0.0 AS {c}" for c, d in digits.items())
            pick = f"* REPLACE ({rounds})" if digits else "*"
            ORACLES[name] = compose(f"SELECT {pick} FROM (\n{textwrap.dedent(sql).strip()}\n)")
        return fn

    return wrap
