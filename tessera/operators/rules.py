"""Domain rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compensation(df: DataFrame, *, years: str, months: str, wage: str, average: str) -> DataFrame:
    """Termination compensation N and 2N in DECIMAL; both are rounded half up to 2 places from the exact product.

    One month's wage for each year, half a one for 1 to 5 further months, a whole one for 6 or more.  Where the wage
    is over three times the local average, that is the basis and at most 12 months count; without an average the flag is null.
    Without service or a positive wage all results are null.
    """
    money = "decimal(18,2)"
    credit = F.when(F.col(months).between(1, 5), F.lit(0.5)).when(F.col(months) >= 6, F.lit(1.0)).otherwise(F.lit(0.0)).cast("decimal(3,1)")
    cap = F.col(average).cast(money) * 3
    capped = F.col(wage).cast(money) > cap
    count = F.col(years).cast("decimal(6,1)") + credit
    count = F.when(F.coalesce(capped, F.lit(False)), F.least(count, F.lit(12).cast("decimal(6,1)"))).otherwise(count)
    basis = F.when(F.coalesce(capped, F.lit(False)), cap).otherwise(F.col(wage).cast(money))
    out = df.withColumn("compensation_months", count.cast("decimal(8,2)")).withColumn("wage_basis", basis.cast(money)).withColumn("cap_applied", capped)
    exact = F.col("wage_basis") * F.col("compensation_months")
    out = out.withColumn("n1", F.round(exact, 2).cast("decimal(20,2)")).withColumn("n2", F.round(exact * 2, 2).cast("decimal(20,2)"))
    valid = (F.col(wage) > 0) & (F.col(years) + F.col(months) > 0)
    return out.withColumns({c: F.when(valid, F.col(c)) for c in ("compensation_months", "wage_basis", "cap_applied", "n1", "n2")})


def outcome_bucket(months: Column, *, life: Column | None = None, death: Column | None = None) -> Column:
    flag = lambda c: F.coalesce(c, F.lit(False)) if c is not None else F.lit(False)
    return F.when(flag(death), "death").when(flag(life), "life").when(months <= 0, "none").when(months <= 12, "up_to_1y").when(months <= 36, "1y_to_3y").otherwise("over_3y")


def merge_lists(old: Column, new: Column, resolved: Column) -> Column:
    """Old items, then new ones that are missing, without the resolved ones."""
    merged = F.concat(old, F.array_except(new, old))
    return F.filter(merged, lambda x: ~F.array_contains(resolved, x))


def any_of_groups(text: Column, groups: list[list[str]]) -> Column:
    """Whether every group has a term that the text holds, whatever its case."""
    found = F.lit(True)
    low = F.lower(text)
    for group in groups:
        one = F.lit(False)
        for term in group:
            one = one | F.contains(low, F.lit(term.lower()))
        found = found & one
    return found
