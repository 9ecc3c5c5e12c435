"""Data contracts: checks that return their violations, and one that raises."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """A contract that does not hold."""


def repeated_keys(frame: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that come more than once, with their number of rows."""
    return frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def require_unique(frame: DataFrame, keys: Sequence[str]) -> DataFrame:
    """frame, if its keys are unique."""
    if bad := repeated_keys(frame, keys).limit(3).collect():
        raise ContractError(f"{', '.join(keys)} repeat: {bad}")
    return frame


def joined(left: DataFrame, right: DataFrame, keys: Sequence[str], cardinality: str = "many_to_one", how: str = "left") -> DataFrame:
    """left joined with right on keys, after the side that must be unique is found so: many_to_one or one_to_one."""
    if cardinality == "one_to_one":
        require_unique(left, keys)
    elif cardinality != "many_to_one":
        raise ValueError(cardinality)
    return left.join(require_unique(right, keys), list(keys), how)


def violations(frame: DataFrame, rules: dict[str, str]) -> DataFrame:
    """One row per rule: rule, rows, violations (rows for which the condition is not true)."""
    counts = frame.agg(F.count(F.lit(1)).alias("__rows"), *[F.count_if(~F.coalesce(F.expr(c), F.lit(False))).alias(n) for n, c in rules.items()])
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col("__rows").alias("rows"), F.col(n).alias("violations")) for n in rules]))
    return counts.select(each.alias("r")).select("r.*")


#: What every interval must meet.
INTERVALS = {"start_before_end": "ord_start < ord_end", "gap_of_eight": "ord_end - ord_start = 8", "has_start": "start IS NOT NULL", "has_end": "end IS NOT NULL", "delta": "abs(delta - (end - start)) < 1e-9"}
#: No slot at or after the target, or at or before the start, may feed a feature.
LEAKAGE = {"before_target": "ord < ord_end", "after_start": "ord > ord_start"}


def require(frame: DataFrame, rules: dict[str, str]) -> DataFrame:
    """frame, if all rows meet all rules."""
    if bad := violations(frame, rules).where("violations > 0").collect():
        raise ContractError("; ".join(f"{r['rule']}: {r['violations']} of {r['rows']}" for r in bad))
    return frame


def separation(train: DataFrame, test: DataFrame, day: str) -> DataFrame:
    """One row: the last day of train, the first of test, and whether the one lies before the other (true if either has none)."""
    ends = train.agg(F.max(day).alias("last_train")).join(test.agg(F.min(day).alias("first_test")))  # a row each
    return ends.withColumn("separate", F.coalesce(F.col("last_train") < F.col("first_test"), F.lit(True)))


def require_separate(train: DataFrame, test: DataFrame, day: str) -> None:
    """All of train lies before all of test."""
    row = separation(train, test, day).first()
    if not row["separate"]:
        raise ContractError(f"training reaches {row['last_train']}, the test begins at {row['first_test']}")


def require_features(columns: Sequence[str], forbidden: Sequence[str]) -> list[str]:
    """columns, if none of them has a forbidden part."""
    if bad := [c for c in columns if any(f in c for f in forbidden)]:
        raise ContractError(f"not to be used as features: {', '.join(bad)}")
    return list(columns)


def probabilities(frame: DataFrame, columns: Sequence[str], tolerance: float = 1e-6) -> DataFrame:
    """Rows whose probabilities are missing, not finite or don't sum up to 1."""
    total = sum((F.col(c) for c in columns[1:]), F.col(columns[0]))
    return frame.where(total.isNull() | F.isnan(total) | (F.abs(total - 1) > tolerance))
