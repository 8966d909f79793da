"""SQL templates: an operator as one declarative query over named input frames.

A template names its inputs as $name and uses a few portable functions that each engine spells differently. Spark
runs it over DataFrames (no temp views); the same text renders for a checking engine.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

#: name: (Spark, DuckDB) of the portable functions; arguments are SQL texts.
PORTABLE: dict[str, tuple[Callable[..., str], Callable[..., str]]] = {
    "LASTNN": (lambda x: f"last_value({x}, true)", lambda x: f"last_value({x} IGNORE NULLS)"),
    "FIRSTNN": (lambda x: f"first_value({x}, true)", lambda x: f"first_value({x} IGNORE NULLS)"),
    "PCTL": (lambda x, p: f"percentile({x}, {p})", lambda x, p: f"quantile_cont({x}, {p})"),
    "DAYS": (lambda a, b: f"datediff({a}, {b})", lambda a, b: f"date_diff('day', {b}, {a})"),
    "ADDDAYS": (lambda d, n: f"date_add({d}, {n})", lambda d, n: f"CAST({d} + CAST({n} AS INTEGER) AS DATE)"),
    "WEEKDAY": (lambda d: f"weekday({d})", lambda d: f"(isodow({d}) - 1)"),
    "DAYSEQ": (lambda a, b: f"explode(sequence({a}, {b}))", lambda a, b: f"CAST(unnest(generate_series({a}, {b}, INTERVAL 1 DAY)) AS DATE)"),
    "INTSEQ": (lambda a, b: f"explode(sequence({a}, {b}))", lambda a, b: f"unnest(generate_series({a}, {b}))"),
    "ARGMAX": (lambda x, k: f"max_by({x}, {k})", lambda x, k: f"arg_max({x}, {k})"),
    "ARGMIN": (lambda x, k: f"min_by({x}, {k})", lambda x, k: f"arg_min({x}, {k})"),
}


def _arguments(text: str, at: int) -> tuple[list[str], int]:
    """Arguments of the call whose opening bracket is at `at`, and the position after it."""
    depth, parts, begin = 0, [], at + 1
    for i in range(at, len(text)):
        if text[i] == "(":
            depth += 1
        elif text[i] == ")":
            depth -= 1
            if not depth:
                return [*parts, text[begin:i].strip()], i + 1
        elif text[i] == "," and depth == 1:
            parts.append(text[begin:i].strip())
            begin = i + 1
    raise ValueError(f"unbalanced call in {text[at:at + 60]!r}")


def spell(text: str, engine: int) -> str:
    """Replace the portable functions: engine 0 is Spark, 1 DuckDB."""
    while m := re.search(r"\b(" + "|".join(PORTABLE) + r")\(", text):
        args, end = _arguments(text, m.end() - 1)
        text = text[: m.start()] + PORTABLE[m[1]][engine](*args) + text[end:]
    return text


@dataclass(frozen=True)
class Template:
    text: str

    def apply(self, spark: SparkSession, **frames: DataFrame) -> DataFrame:
        body = re.sub(r"\$(\w+)", r"{\1}", spell(self.text, 0))
        return spark.sql(body, **{k: v for k, v in frames.items() if f"{{{k}}}" in body})

    def sql(self, **bases: str) -> str:
        """As DuckDB SQL; each input is given as a query."""
        return re.sub(r"\$(\w+)", lambda m: f"({bases[m[1]]})", spell(self.text, 1))
