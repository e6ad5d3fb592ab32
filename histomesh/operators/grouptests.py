"""Tests of group differences, for all features at once.

``long`` holds (keys, sample, value) rows and a ``group`` column; NULL values and groups are left out. Every
test reduces to counts and sums per (feature, group), or per distinct value, before anything is compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from histomesh.functions.tails import f_tail, gamma_tail, log_gamma, normal_two_sided, t_two_sided
from histomesh.operators.order import average_ranks
from histomesh.session import durable


def _known(long: DataFrame, keys: list[str], group: str, value: str) -> DataFrame:
    return long.select(*keys, F.col(group).alias("_g"), F.col(value).cast("double").alias("_v")).filter("_g is not null and _v is not null")


def _moments(long: DataFrame, keys: list[str], group: str, value: str) -> DataFrame:
    """Count, mean and sum of squared deviations per (keys, group)."""
    each = _known(long, keys, group, value).groupBy(*keys, "_g")
    return each.agg(F.count(F.lit(1)).alias("_n"), F.avg("_v").alias("_m"), (F.var_pop("_v") * F.count(F.lit(1))).alias("_s"))


def _pair(per_group: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row per key with exactly two groups: columns suffixed 1 (the smaller group) and 2."""
    ends = per_group.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_groups"), F.min(F.struct("_g", *columns)).alias("_a"), F.max(F.struct("_g", *columns)).alias("_b")
    )
    wide = ends.filter("_groups = 2")
    return wide.select(*keys, *[F.col(f"{s}.{c}").alias(f"{c}{i}") for i, s in ((1, "_a"), (2, "_b")) for c in columns])


def t_test(long: DataFrame, group: str, keys=("feature",), value: str = "value", equal_variance: bool = True) -> DataFrame:
    """``(keys, n1, n2, statistic, df, p)`` of two groups, the smaller group value first; NULL without variance."""
    keys = list(keys)
    w = _pair(_moments(long, keys, group, value), keys, ["_n", "_m", "_s"]).filter("_n1 >= 2 and _n2 >= 2")
    n1, n2, s1, s2 = (F.col(c) for c in ("_n1", "_n2", "_s1", "_s2"))
    if equal_variance:
        df = (n1 + n2 - 2).cast("double")
        error = (s1 + s2) / df * (1 / n1 + 1 / n2)
    else:
        e1, e2 = s1 / (n1 - 1) / n1, s2 / (n2 - 1) / n2
        error = e1 + e2
        df = error * error / (e1 * e1 / (n1 - 1) + e2 * e2 / (n2 - 1))
    out = w.filter(s1 + s2 > 0).withColumn("df", df).withColumn("statistic", (F.col("_m1") - F.col("_m2")) / F.sqrt(error))
    return out.select(*keys, n1.alias("n1"), n2.alias("n2"), "statistic", "df", t_two_sided(F.col("statistic"), F.col("df")).alias("p"))


def anova(long: DataFrame, group: str, keys=("feature",), value: str = "value") -> DataFrame:
    """``(keys, n, n_groups, statistic, df1, df2, p)`` of one-way analysis of variance."""
    keys = list(keys)
    per = _moments(long, keys, group, value)
    whole = _known(long, keys, group, value).groupBy(*keys).agg(F.avg("_v").alias("_mean"))
    sums = per.join(whole, keys).groupBy(*keys).agg(
        F.sum("_n").alias("n"), F.count(F.lit(1)).alias("n_groups"), F.sum("_s").alias("_within"),
        F.sum(F.col("_n") * (F.col("_m") - F.col("_mean")) * (F.col("_m") - F.col("_mean"))).alias("_between"),
    )
    sums = sums.filter((F.col("n_groups") >= 2) & (F.col("n") > F.col("n_groups")) & (F.col("_within") > 0))
    d1, d2 = F.col("n_groups") - 1, F.col("n") - F.col("n_groups")
    out = sums.withColumn("statistic", F.try_divide(F.col("_between") * d2, F.col("_within") * d1))
    return out.select(*keys, "n", "n_groups", "statistic", d1.alias("df1"), d2.alias("df2"), f_tail(F.col("statistic"), d1.cast("double"), d2.cast("double")).alias("p"))


def _rank_sums(long: DataFrame, keys: list[str], group: str, value: str) -> tuple[DataFrame, DataFrame]:
    """Rank sum and size per (keys, group); number of values and sum of t^3 - t over ties per key."""
    known = durable(_known(long, keys, group, value))
    ranks = durable(average_ranks(known, keys, "_v"))
    counts = known.groupBy(*keys, "_v", "_g").agg(F.count(F.lit(1)).alias("_c"))
    per = counts.join(ranks, [*keys, "_v"]).groupBy(*keys, "_g").agg(F.sum(F.col("_c") * F.col("avg_rank")).alias("_r"), F.sum("_c").alias("_n"))
    c = F.col("cnt").cast("double")
    return per, ranks.groupBy(*keys).agg(F.sum("cnt").alias("n"), F.sum(c * c * c - c).alias("_ties"))


def mann_whitney(long: DataFrame, group: str, keys=("feature",), value: str = "value") -> DataFrame:
    """``(keys, n1, n2, statistic, z, p)``: U of the smaller group value, normal tail with tie and continuity correction."""
    keys = list(keys)
    per, ties = _rank_sums(long, keys, group, value)
    w = _pair(per, keys, ["_r", "_n"]).join(ties, keys)
    n1, n2, n = F.col("_n1").cast("double"), F.col("_n2").cast("double"), F.col("n").cast("double")
    u = F.col("_r1") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.try_divide(F.col("_ties"), n * (n - 1))))
    away = F.greatest(F.abs(u - n1 * n2 / 2) - 0.5, F.lit(0.0))
    z = F.when(sd > 0, F.signum(u - n1 * n2 / 2) * away / sd)
    out = w.select(*keys, F.col("_n1").alias("n1"), F.col("_n2").alias("n2"), u.alias("statistic"), z.alias("z"))
    return out.withColumn("p", normal_two_sided(F.col("z")))


def kruskal(long: DataFrame, group: str, keys=("feature",), value: str = "value") -> DataFrame:
    """``(keys, n, n_groups, statistic, df, p)``: tie-corrected H of two groups or more."""
    keys = list(keys)
    per, ties = _rank_sums(long, keys, group, value)
    sums = per.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_groups"), F.sum(F.col("_r") * F.col("_r") / F.col("_n")).alias("_rr")).join(ties, keys)
    n = F.col("n").cast("double")
    correction = 1 - F.try_divide(F.col("_ties"), n * n * n - n)
    out = sums.filter((F.col("n_groups") >= 2) & (correction > 0)).withColumn("statistic", F.try_divide(12 / (n * (n + 1)) * F.col("_rr") - 3 * (n + 1), correction))
    df = F.col("n_groups") - 1
    return out.select(*keys, "n", "n_groups", "statistic", df.alias("df"), gamma_tail(df / 2.0, F.col("statistic") / 2).alias("p"))


def _log_choose(n: Column, k: Column) -> Column:
    return log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1)


def fisher_exact(table: DataFrame, keys=("gene",), hit: str = "mutated", group: str = "in_group") -> DataFrame:
    """``(keys, a, b, c, d, odds_ratio, p)``: association of two booleans per key, two-sided.

    a: both, b: ``hit`` only, c: ``group`` only, d: neither. p sums the hypergeometric probabilities of all
    tables with these margins that are no likelier than the one found. The odds ratio is NULL where
    b * c = 0.
    """
    keys = list(keys)
    h, g = F.col(hit), F.col(group)
    known = table.filter(h.isNotNull() & g.isNotNull())
    cells = known.groupBy(*keys).agg(F.count_if(h & g).alias("a"), F.count_if(h & ~g).alias("b"), F.count_if(~h & g).alias("c"), F.count_if(~h & ~g).alias("d"))
    a, b, c, d = (F.col(x) for x in "abcd")
    low, high = F.greatest(F.lit(0).cast("long"), a - d), F.least(a + b, a + c)
    weight = lambda k: _log_choose(a + b, k) + _log_choose(c + d, a + c - k)
    # the table's own weight needs no other row, so its margins' tables are summed where they arise
    each = cells.withColumn("_own", weight(a)).withColumn("_k", F.explode(F.sequence(low, high))).withColumn("_w", weight(F.col("_k")))
    each = each.withColumn("_p", F.exp(F.col("_w") - _log_choose(a + b + c + d, a + c)))
    total = F.sum(F.when(F.col("_w") <= F.col("_own") + 1e-7, F.col("_p")))
    out = each.groupBy(*keys, "a", "b", "c", "d").agg(F.least(F.lit(1.0), total).alias("p"))
    return out.select(*keys, "a", "b", "c", "d", F.when(b * c > 0, a * d / (b * c)).alias("odds_ratio"), "p")
