"""Deadline rows from milestones and rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from caseloom.functions.extract import roll_weekend


def due_date(base: Column, n: Column, unit: Column) -> Column:
    """n days or months after base, rolled from a weekend to Monday."""
    return roll_weekend(F.when(unit == "month", F.add_months(base, n)).otherwise(F.date_add(base, n)))


def status(due: Column, done: Column, today: Column, soon: int = 5) -> Column:
    return (
        F.when(due.isNull(), "missing")
        .when(done.isNotNull(), F.when(done > due, "late").otherwise("done"))
        .when(due < today, "overdue")
        .when(F.date_diff(due, today) <= soon, "soon")
        .otherwise("open")
    )


MOST_RULES = 1000  # of a table of deadlines; each case gets a row for each


def deadline_rows(cases: DataFrame, rules: DataFrame, base: str, done: str, today: Column) -> DataFrame:
    """One row per case and rule. The rules, MOST_RULES at most, become a constant array that each case is exploded by: nothing is
    joined."""
    rows = rules.limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} deadlines")
    if not rows:
        rows = [dict.fromkeys(rules.columns)]
        cases = cases.where("false")
    typed = lambda r, f: F.lit(r[f.name]).cast(f.dataType).alias(f.name)
    all_ = F.array(*[F.struct(*[typed(r, f) for f in rules.schema]) for r in rows])
    each = cases.withColumn("__rule", F.explode(all_)).select("*", "__rule.*").drop("__rule")
    due = due_date(F.col(base), F.col("n"), F.col("unit"))
    return each.withColumn("due", due).withColumns({"status": status(F.col("due"), F.col(done), today), "days_left": F.date_diff("due", today)})
