"""Rules that route, admit and compare: lists of named conditions over columns."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.scoring import first_true


def relationship(base_kind: F.Column, kind: F.Column, base_at: F.Column, at: F.Column) -> F.Column:
    """Whether two documents may be compared, or why not."""
    return first_true([("no_base", base_kind.isNull()), ("base_is_later", base_at >= at), ("amends", (base_kind == kind)), ("other_kind", base_kind != kind)], "unknown")


def violations(df: DataFrame, key: str, rules: dict[str, F.Column]) -> DataFrame:
    """key, violation: one row for each named rule that a row breaks; a rule that cannot be told is broken."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return df.select(key, F.explode(broken).alias("violation"))
