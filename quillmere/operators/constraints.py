"""Data quality as declared rules, all judged in one pass over a table.

Row rules are predicates; one aggregate counts what violates each and keeps a bounded sample of keys. A
row violates a rule that isn't true for it: null counts as a violation, so a rule that lets nulls pass
says so. Uniqueness and references need the rows of a key together: a uniqueness rule is one grouping, a
reference one anti-join. The report has a row for every rule, and fails a case by its severity.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A row rule: what must be true of each row."""

    name: str
    holds: Column
    severity: str = "error"


@dataclass(frozen=True)
class Unique:
    """No two rows have these columns alike; null is a value like any other."""

    name: str
    columns: tuple[str, ...]
    severity: str = "error"


@dataclass(frozen=True)
class Reference:
    """Every non-null value of ``column`` is a value of ``target`` in ``rows``."""

    name: str
    column: str
    rows: DataFrame
    target: str
    severity: str = "error"


def _rows_judged(rows: DataFrame, rules: list[Rule], key: str, samples: int) -> DataFrame:
    bad = [~F.coalesce(r.holds, F.lit(False)) for r in rules]
    flagged = rows.select(F.coalesce(F.col(key).cast("string"), F.lit("null")).alias("k"), *[b.alias(f"b{i}") for i, b in enumerate(bad)])
    counts = flagged.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(f"b{i}").alias(f"c{i}") for i in range(len(rules))])
    each = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"), F.col(f"c{i}").alias("violations"), F.col("n").alias("checked")) for i, r in enumerate(rules)])
    judged = counts.select(F.inline(each))
    if samples < 1:
        return judged.withColumn("samples", F.array().cast("array<string>"))
    # Violations alone, a row for each rule that a row breaks; a task sends the smallest keys of a rule.
    broken = flagged.select("k", F.explode(F.array_compact(F.array(*[F.when(F.col(f"b{i}"), F.lit(r.name)) for i, r in enumerate(rules)]))).alias("rule"))
    first = F.row_number().over(Window.partitionBy("rule").orderBy("k"))
    held = broken.withColumn("at", first).where(F.col("at") <= samples).groupBy("rule").agg(F.array_sort(F.collect_list("k")).alias("samples"))
    return judged.join(F.broadcast(held), "rule", "left").withColumn("samples", F.coalesce("samples", F.array().cast("array<string>")))


def _sampled(violating: DataFrame, key: str, rule, kind: str, checked: DataFrame, samples: int) -> DataFrame:
    """The report row of a rule whose violating rows are at hand."""
    some = violating.select(F.coalesce(F.col(key).cast("string"), F.lit("null")).alias("k")).orderBy("k").limit(samples).agg(F.array_sort(F.collect_list("k")).alias("samples"))
    counts = violating.agg(F.count(F.lit(1)).alias("violations"))
    named = checked.agg(F.count(F.lit(1)).alias("checked"))
    # Three tables of one row each.
    joined = counts.join(F.broadcast(named)).join(F.broadcast(some))
    return joined.select(F.lit(rule.name).alias("rule"), F.lit(kind).alias("kind"), F.lit(rule.severity).alias("severity"), "checked", "violations", "samples")


def judge(rows: DataFrame, rules: list[Rule | Unique | Reference], key: str, samples: int = 5) -> DataFrame:
    """rule, kind (row, unique, reference), severity, checked, violations and samples of every rule of a table.
    ``samples`` are the keys of its first violations; of a uniqueness rule those of rows whose value repeats."""
    if len({r.name for r in rules}) < len(rules) or not rules:
        raise ValueError("rules have names of their own")
    parts = []
    if plain := [r for r in rules if isinstance(r, Rule)]:
        parts.append(_rows_judged(rows, plain, key, samples).select("rule", F.lit("row").alias("kind"), "severity", "checked", "violations", "samples"))
    for r in rules:
        if isinstance(r, Unique):
            each = rows.groupBy(*r.columns).agg(F.count(F.lit(1)).alias("__n"), F.min(key).alias("__first"))
            again = each.where("__n > 1").withColumn("__more", F.col("__n") - 1)
            some = again.select(F.coalesce(F.col("__first").cast("string"), F.lit("null")).alias("k")).orderBy("k").limit(samples).agg(F.array_sort(F.collect_list("k")).alias("samples"))
            counts = again.agg(F.coalesce(F.sum("__more"), F.lit(0)).alias("violations"))
            total = each.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("checked"))
            parts.append(counts.join(F.broadcast(total)).join(F.broadcast(some)).select(F.lit(r.name).alias("rule"), F.lit("unique").alias("kind"), F.lit(r.severity).alias("severity"), "checked", "violations", "samples"))
        elif isinstance(r, Reference):
            given = rows.where(F.col(r.column).isNotNull())
            known = r.rows.select(F.col(r.target).alias("__target")).where("__target is not null").distinct()
            parts.append(_sampled(given.join(known, F.col(r.column) == F.col("__target"), "left_anti"), key, r, "reference", given, samples))
    return reduce(DataFrame.unionByName, parts)


def passed(report: DataFrame, name: str = "case_id", value: str = "data") -> DataFrame:
    """One case: it passes if no rule of severity error is violated."""
    wrong = F.coalesce(F.max((F.col("severity") == "error") & (F.col("violations") > 0)), F.lit(False))
    return report.agg((~wrong).alias("passed")).select(F.lit(value).alias(name), "passed")


def suite(tables: dict[str, tuple[DataFrame, list[Rule | Unique | Reference], str]], samples: int = 5, only: Callable[[str], bool] = lambda _: True) -> DataFrame:
    """The reports of several tables (rows, rules, key), with the name of each."""
    parts = [judge(rows, rules, key, samples).withColumn("table", F.lit(name)) for name, (rows, rules, key) in tables.items() if only(name)]
    return reduce(DataFrame.unionByName, parts)
