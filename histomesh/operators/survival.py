"""Survival statistics. Times are day counts, so every time axis has at most a few 10,000 steps.

Subjects are always reduced to one row per (key, day) before a cumulative window, which keeps a
window at that size however many subjects share a key.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from histomesh.functions.tails import chi2_tail, normal_two_sided
from histomesh.operators.order import average_ranks, quantiles, running_sums
from histomesh.session import durable, spread

Z95 = 1.959963984540054
RANK_BITS = 8  # bits of a risk's rank that are split together


def join_clinical(features: DataFrame, clinical: DataFrame, time="os_time", event="os_event", sample="sample_id") -> DataFrame:
    known = clinical.filter(F.col(time).isNotNull() & F.col(event).isNotNull())
    return features.join(known, sample)


def life_table(df: DataFrame, keys=(), time="os_time", event="os_event") -> DataFrame:
    """Events, censorings and subjects at risk per (keys, day)."""
    keys = list(keys)
    daily = df.groupBy(*keys, time).agg(
        F.sum(event).alias("d"), F.sum(1 - F.col(event)).alias("c"), F.count(F.lit(1)).alias("m")
    )
    later = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(F.col(time).desc())
    return daily.withColumn("at_risk", F.sum("m").over(later)).drop("m")


def km_curve(df: DataFrame, keys=(), time="os_time", event="os_event") -> DataFrame:
    """Kaplan-Meier survival with log-log 95% limits, one row per (keys, day)."""
    keys = list(keys)
    table = life_table(df, keys, time, event)
    upto = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(time)
    n, d = F.col("at_risk"), F.col("d")
    out = (
        table.withColumn("_log", F.sum(F.when(d < n, F.log(1 - d / n))).over(upto))
        .withColumn("_zero", F.max((d == n).cast("int")).over(upto))
        .withColumn("_var", F.sum(F.when(d < n, d / (n * (n - d).cast("double")))).over(upto))
    )
    s = F.when(F.col("_zero") == 1, 0.0).otherwise(F.exp(F.coalesce("_log", F.lit(0.0))))
    out = out.withColumn("survival", s)
    inner = (F.col("survival") > 0) & (F.col("survival") < 1)
    v = F.log("survival")
    limit = lambda sign: F.when(
        inner, F.exp(-F.exp(F.log(-v) + sign * Z95 * F.sqrt("_var") / v))
    ).otherwise(F.col("survival"))
    return out.select(
        *keys, time, "d", "c", "at_risk", "survival", limit(-1).alias("ci_lower"), limit(1).alias("ci_upper")
    )


def logrank_table(df: DataFrame, group: str, time="os_time", event="os_event") -> DataFrame:
    """Observed and expected events per group, and the variance matrix in long form ``(g, h, v)``."""
    own = df.groupBy(group, time).agg(F.sum(event).alias("d"), F.count(F.lit(1)).alias("m"))
    days = own.groupBy(time).agg(F.sum("d").alias("dt"), F.sum("m").alias("mt"))
    days = days.withColumn("nt", F.sum("mt").over(Window.partitionBy(F.lit(0)).orderBy(F.col(time).desc())))
    names = sorted(r[group] for r in own.select(group).distinct().collect())  # one name per group
    grid = days.filter(F.col("dt") > 0).withColumn(group, F.explode(F.lit(names)))
    # at risk in a group at a day: everyone in it whose own day is not earlier
    cells = own.unionByName(grid.select(group, time, F.lit(0).cast("long").alias("d"), F.lit(0).cast("long").alias("m")))
    cells = cells.groupBy(group, time).agg(F.sum("d").alias("d"), F.sum("m").alias("m"))
    cells = cells.withColumn("n", F.sum("m").over(Window.partitionBy(group).orderBy(F.col(time).desc())))
    return cells.join(days, time).filter(F.col("dt") > 0)


def logrank_k(df: DataFrame, group: str, time="os_time", event="os_event") -> DataFrame:
    """One row: chi-square statistic, degrees of freedom and p of the k-sample log-rank test.

    Group totals and the k x k variance are aggregated in Spark; only those k + k^2 numbers reach
    the driver, for the solve.
    """
    cells = logrank_table(df, group, time, event)
    share = F.col("n") / F.col("nt")
    factor = F.when(F.col("nt") > 1, F.col("dt") * (F.col("nt") - F.col("dt")) / (F.col("nt") - 1.0)).otherwise(0.0)
    packed = cells.groupBy(time).agg(
        F.max(factor).alias("f"),
        F.array_sort(F.collect_list(F.struct(F.col(group).alias("g"), share.alias("p")))).alias("r"),  # k entries
    )
    pairs = packed.withColumn("a", F.explode("r")).withColumn("b", F.explode("r"))
    v = F.col("f") * F.col("a.p") * (F.when(F.col("a.g") == F.col("b.g"), 1.0).otherwise(0.0) - F.col("b.p"))
    variance = pairs.groupBy(F.col("a.g").alias("g"), F.col("b.g").alias("h")).agg(F.sum(v).alias("v")).collect()
    totals = cells.groupBy(group).agg(F.sum("d").alias("o"), F.sum(F.col("dt") * share).alias("e")).collect()
    names = sorted(r[group] for r in totals)
    at = {g: i for i, g in enumerate(names)}
    z, cov = np.zeros(len(names)), np.zeros((len(names), len(names)))
    for r in totals:
        z[at[r[group]]] = float(r["o"]) - float(r["e"])
    for r in variance:
        cov[at[r["g"]], at[r["h"]]] = r["v"]
    stat = float(z[:-1] @ np.linalg.pinv(cov[:-1, :-1]) @ z[:-1])
    dof = len(names) - 1
    one = df.sparkSession.createDataFrame([(stat, dof)], "statistic double, dof int")
    return one.withColumn("p", chi2_tail(F.col("statistic"), dof))


def logrank_observed_expected(df: DataFrame, group: str, time="os_time", event="os_event") -> DataFrame:
    cells = logrank_table(df, group, time, event)
    return cells.groupBy(group).agg(F.sum("d").alias("observed"), F.sum(F.col("dt") * F.col("n") / F.col("nt")).alias("expected"))


def risk_set_sums(df: DataFrame, keys=(), x="x", beta: Column | None = None, time="os_time", event="os_event") -> DataFrame:
    """Per (keys, day): sums of w, wx, wx2 over everyone still at risk, and over the day's events.

    ``w = exp(beta * x)``. Columns s0 s1 s2 (risk set), e0 e1 e2 (tied events), d, ex (sum of x
    over events).
    """
    keys = list(keys)
    w = F.exp((beta if beta is not None else F.lit(0.0)) * F.col(x))
    v = F.col(x)
    ev = F.col(event) == 1
    daily = df.groupBy(*keys, time).agg(
        F.sum(w).alias("t0"), F.sum(w * v).alias("t1"), F.sum(w * v * v).alias("t2"),
        F.sum(F.when(ev, w).otherwise(0.0)).alias("e0"), F.sum(F.when(ev, w * v).otherwise(0.0)).alias("e1"),
        F.sum(F.when(ev, w * v * v).otherwise(0.0)).alias("e2"),
        F.sum(event).alias("d"), F.sum(F.when(ev, v).otherwise(0.0)).alias("ex"),
    )
    later = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(F.col(time).desc())
    return daily.select(
        *keys, time, *[F.sum(f"t{i}").over(later).alias(f"s{i}") for i in range(3)], "e0", "e1", "e2", "d", "ex"
    )


def score_information(risk: DataFrame, keys=(), beta: Column | None = None) -> DataFrame:
    """Efron log-likelihood, score and information per key."""
    steps = F.sequence(F.lit(0), F.col("d").cast("int") - 1)
    part = lambda l: l / F.col("d")
    den = lambda l: F.col("s0") - part(l) * F.col("e0")
    num = lambda l: F.col("s1") - part(l) * F.col("e1")
    sq = lambda l: F.col("s2") - part(l) * F.col("e2")
    acc = F.aggregate(
        steps,
        F.struct(F.lit(0.0).alias("l"), F.lit(0.0).alias("u"), F.lit(0.0).alias("i")),
        lambda a, l: F.struct(
            (a["l"] + F.log(den(l))).alias("l"),
            (a["u"] + num(l) / den(l)).alias("u"),
            (a["i"] + sq(l) / den(l) - (num(l) / den(l)) * (num(l) / den(l))).alias("i"),
        ),
    )
    b = beta if beta is not None else F.lit(0.0)
    per_day = risk.filter(F.col("d") > 0).withColumn("_a", acc)
    return per_day.groupBy(*keys).agg(
        F.sum(b * F.col("ex") - F.col("_a.l")).alias("loglik"),
        F.sum(F.col("ex") - F.col("_a.u")).alias("score"),
        F.sum("_a.i").alias("information"),
    )


def _standardised(long: DataFrame, keys: list[str], time, event) -> DataFrame:
    """Complete cases with x scaled by the sample sd; keys with too little variation are dropped."""
    full = long.filter(F.col("value").isNotNull() & F.col(time).isNotNull() & F.col(event).isNotNull())
    stats = full.groupBy(*keys).agg(
        F.avg("value").alias("_m"), F.stddev_samp("value").alias("_s"), F.min("value").alias("_lo"), F.max("value").alias("_hi"),
        F.sum(event).alias("events"), F.count(F.lit(1)).alias("n"),
    )
    joined = full.join(stats, keys)
    # three distinct values exist exactly when something lies strictly between the extremes
    between = joined.groupBy(*keys).agg(F.max(((F.col("value") > F.col("_lo")) & (F.col("value") < F.col("_hi"))).cast("int")).alias("_b"))
    fit = joined.join(between.filter(F.col("_b") == 1).select(*keys), keys, "left_semi").filter(F.col("events") >= 5)
    sd = F.when(F.col("_s") > 0, F.col("_s")).otherwise(1.0)
    return fit.select(*keys, time, event, ((F.col("value") - F.col("_m")) / sd).alias("x"), "n", "events")


def univariate_cox(
    long: DataFrame, keys=("feature",), time="os_time", event="os_event", rounds: int = 25, tol: float = 1e-9, adjust: bool = True
) -> DataFrame:
    """One Cox model per key: hr, 95% limits, z, p, n, events and the Benjamini-Hochberg q.

    All keys take their Newton steps together: one aggregate over the long table per round, and a
    state table of one row per key. The step that is below ``tol`` is taken too, so what is left is of
    its square: z is beta times the root of the events, which makes ``tol`` itself visible in long tables.
    Keys that do not converge are dropped.
    """
    keys = list(keys)
    data = durable(_standardised(long, keys, time, event))
    state = data.groupBy(*keys).agg(F.max("n").alias("n"), F.max("events").alias("events"))
    state = durable(state.select(*keys, "n", "events", F.lit(0.0).alias("beta"), F.lit(None).cast("double").alias("_ll"), F.lit(1.0).alias("_step"), F.lit(0.0).alias("_good"), F.lit(None).cast("double").alias("information"), F.lit(False).alias("_done")))
    slim = data.select(*keys, time, event, "x")
    for _ in range(rounds):
        active = state.filter(~F.col("_done")).select(*keys, "beta")
        risk = risk_set_sums(slim.join(active, keys), [*keys, "beta"], "x", F.col("beta"), time, event)
        step = score_information(risk, [*keys, "beta"], F.col("beta")).drop("beta")
        joined = state.join(step.withColumnRenamed("information", "_info"), keys, "left")
        # a drop in log-likelihood beyond its rounding goes back to the last good beta with half the step
        worse = F.col("_ll").isNotNull() & (F.col("loglik") < F.col("_ll") - 1e-10 - 1e-12 * F.abs("_ll"))
        newton = F.greatest(F.lit(-2.0), F.least(F.lit(2.0), F.try_divide(F.col("score"), F.col("_info"))))
        running = ~F.col("_done") & F.col("loglik").isNotNull()
        small = ~worse & (F.abs(newton) < tol)
        state = durable(
            joined.select(
                *keys, "n", "events",
                F.when(running & worse, F.col("_good") + F.col("_step") / 2)
                .when(running, F.col("beta") + F.coalesce(newton, F.lit(0.0))).otherwise(F.col("beta")).alias("beta"),
                F.when(running & ~worse, F.col("loglik")).otherwise(F.col("_ll")).alias("_ll"),
                F.when(running & worse, F.col("_step") / 2).when(running, newton).otherwise(F.col("_step")).alias("_step"),
                F.when(running & ~worse, F.col("beta")).otherwise(F.col("_good")).alias("_good"),
                F.when(running, F.col("_info")).otherwise(F.col("information")).alias("information"),
                (F.col("_done") | (running & small)).alias("_done"),
            )
        )
        if state.filter(~F.col("_done")).isEmpty():
            break
    se = 1 / F.sqrt("information")
    z = F.col("beta") / se
    out = state.filter(F.col("_done") & (F.col("information") > 0)).select(
        *keys, F.exp("beta").alias("hr"), F.exp(F.col("beta") - Z95 * se).alias("ci_lower"),
        F.exp(F.col("beta") + Z95 * se).alias("ci_upper"), z.alias("z"), normal_two_sided(z).alias("p"), "n", "events", "beta",
    )
    if not adjust:
        return out
    family = [k for k in keys if k != "feature"]
    return bh_adjust(out, family)


def bh_adjust(df: DataFrame, keys=(), p="p") -> DataFrame:
    """Benjamini-Hochberg q within ``keys``; one row per test."""
    part = list(keys) or [F.lit(0)]
    n = F.count(F.lit(1)).over(Window.partitionBy(*part))
    # a tie shares the largest rank, as sorting followed by the running minimum does
    rank = F.count(F.lit(1)).over(Window.partitionBy(*part).orderBy(p).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    raw = df.filter(F.col(p).isNotNull()).withColumn("_raw", F.col(p) * n / rank)
    worst_first = Window.partitionBy(*part).orderBy(F.col(p).desc())
    return raw.withColumn("q", F.least(F.lit(1.0), F.min("_raw").over(worst_first))).drop("_raw")


def stratified_univariate_cox(long: DataFrame, stratum: str, min_samples: int = 40, sample="sample_id", **kw) -> DataFrame:
    """``univariate_cox`` inside every stratum with at least ``min_samples`` samples."""
    sizes = long.groupBy(stratum).agg(F.count_distinct(sample).alias("_n")).filter(F.col("_n") >= min_samples)
    return univariate_cox(long.join(sizes.select(stratum), stratum, "left_semi"), keys=(stratum, "feature"), **kw)


def concordance_counts(df: DataFrame, keys=(), risk="risk", time="os_time", event="os_event") -> DataFrame:
    """Comparable, concordant and risk-tied pairs per key, without forming pairs.

    Subject i (event) is comparable with j when j's time is later, or equal with j censored. The
    pairs with a lower risk for j are counted by splitting the dense risk ranks bit by bit: a pair
    is counted at the one bit where the ranks part, inside a group sharing the higher bits. Each
    group is one row per day before its window, so a group costs at most the number of days.
    RANK_BITS bits at a time are split in the task that has all ranks that part there, so a row is moved
    once for so many bits; the next bits need one row per day and group of those.
    """
    keys = list(keys)
    order = (2 * F.col(time).cast("long") + (1 - F.col(event))).alias("t")  # events before censorings of a day
    base = df.filter(F.col(risk).isNotNull()).select(*keys, F.col(risk).cast("double").alias("risk"), order, F.col(event).alias("e"))
    base = base.groupBy(*keys, "risk", "t", "e").agg(F.count(F.lit(1)).alias("m"))
    distinct = base.select(*keys, "risk").distinct().withColumn("one", F.lit(1))
    ranked = running_sums(distinct, keys, "risk", {"r": "one"}).select(*keys, "risk", (F.col("r") - 1).alias("r"))
    events = F.when(F.col("e") == 1, F.col("m")).otherwise(0).alias("ev")
    rows = durable(base.join(ranked, [*keys, "risk"]).select(*keys, "r", "t", "m", events))
    top = rows.agg(F.max("r")).first()[0] or 0
    later = lambda *part: Window.partitionBy(*keys, *part).orderBy(F.col("t").desc()).rangeBetween(Window.unboundedPreceding, -1)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("double")
    pairs = lambda df_, part: (
        df_.withColumn("after", F.coalesce(F.sum("m").over(later(*part)), F.lit(0))).groupBy(*keys).agg(
            total(F.col("ev").cast("double") * F.col("after")).alias("pairs")
        )
    )
    sums = [F.sum("m").alias("m"), F.sum("ev").alias("ev")]
    tied = concordant = None
    while concordant is None or top:
        near = spread(rows.withColumn("c", F.expr(f"shiftright(r, {RANK_BITS})")), [*keys, "c"])
        if tied is None:
            tied = pairs(near.groupBy(*keys, "c", "r", "t").agg(*sums), ["c", "r"])
        levels = (
            near.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(min(RANK_BITS, max(int(top).bit_length(), 1)) - 1))))
            .withColumn("bit", F.expr("cast(shiftright(r, b) & 1 as int)"))
            .withColumn("prefix", F.expr("shiftright(r, b + 1)"))
            .groupBy(*keys, "c", "b", "prefix", "t")
            .agg(
                F.sum(F.when(F.col("bit") == 0, F.col("m")).otherwise(0)).alias("low"),
                F.sum(F.when(F.col("bit") == 1, F.col("ev")).otherwise(0)).alias("high_events"),
            )
            .withColumn("below", F.coalesce(F.sum("low").over(later("c", "b", "prefix")), F.lit(0)))
        )
        part = levels.groupBy(*keys).agg(total(F.col("high_events").cast("double") * F.col("below")).alias("pairs"))
        concordant = part if concordant is None else concordant.unionByName(part)
        rows = durable(near.groupBy(*keys, "c", "t").agg(*sums).withColumnRenamed("c", "r"))
        top = int(top) >> RANK_BITS
    comparable = pairs(rows, [])  # no bits are left: one row per day
    parts = {"comparable": comparable, "concordant": concordant, "tied": tied}
    stacked = None
    for name, part in parts.items():
        filled = part.select(*keys, *[(F.col("pairs") if c == name else F.lit(0.0)).alias(c) for c in parts])
        stacked = filled if stacked is None else stacked.unionByName(filled)
    return stacked.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in parts])


def concordance_index(df: DataFrame, keys=(), risk="risk", time="os_time", event="os_event") -> DataFrame:
    """Share of comparable pairs where the earlier event has the higher risk; tied risks count half."""
    c = concordance_counts(df, keys, risk, time, event)
    value = F.when(F.col("comparable") > 0, (F.col("concordant") + 0.5 * F.col("tied")) / F.col("comparable"))
    return c.withColumn("c_index", value)


def censoring_survival(df: DataFrame, time="os_time", event="os_event") -> DataFrame:
    """Kaplan-Meier estimate of staying uncensored, per day (events leave before censorings)."""
    table = life_table(df, (), time, event)
    n = F.col("at_risk") - F.col("d")
    upto = Window.partitionBy(F.lit(0)).orderBy(time)
    step = F.when((n > 0) & (F.col("c") < n), F.log(1 - F.col("c") / n)).otherwise(0.0)
    gone = F.max(((F.col("c") > 0) & (F.col("c") >= n)).cast("int")).over(upto)
    g = F.when(gone == 1, 0.0).otherwise(F.exp(F.sum(step).over(upto)))
    return table.select(time, g.alias("g"))


def time_dependent_auc(
    df: DataFrame, risk="risk", time="os_time", event="os_event", months=(6, 12, 24), days_per_month: float = 30.44
) -> DataFrame:
    """Cumulative/dynamic AUC at each horizon strictly inside the observed times.

    Cases are weighted by the inverse probability of being uncensored. Risks are ordered once per
    horizon with distributed running sums; no case-control pair is formed.
    """
    horizons = F.array(*[F.struct(F.lit(int(m)).alias("month"), F.lit(float(m) * days_per_month).alias("h")) for m in months])
    limits = df.agg(F.min(time).alias("lo"), F.max(time).alias("hi")).first()
    weighted = df.select(F.col(risk).alias("risk"), time, event).join(censoring_survival(df, time, event), time)
    at = weighted.withColumn("_h", F.explode(horizons)).filter(
        (F.col("_h.h") > F.lit(limits["lo"])) & (F.col("_h.h") < F.lit(limits["hi"]))
    )
    case = (F.col(time) <= F.col("_h.h")) & (F.col(event) == 1)
    per_risk = at.groupBy(F.col("_h.month").alias("month"), "risk").agg(
        F.sum(F.when(case, 1 / F.col("g")).otherwise(0.0)).alias("w"),
        F.sum((F.col(time) > F.col("_h.h")).cast("long")).alias("controls"),
    )
    ordered = running_sums(per_risk, ["month"], "risk", {"upto": "controls"})
    below = F.col("upto") - F.col("controls") / 2.0
    return ordered.groupBy("month").agg(
        F.try_divide(F.sum(F.col("w") * below), F.sum("w") * F.sum("controls")).alias("auc")
    )


def spearman_ranks(long: DataFrame, keys: list[str]) -> DataFrame:
    """Tie-averaged rank of every value within ``keys``."""
    ranks = average_ranks(long, keys, "value").select(*keys, "value", "avg_rank")
    return long.filter(F.col("value").isNotNull()).join(ranks, [*keys, "value"])


def median_split(df: DataFrame, risk="risk") -> DataFrame:
    median = quantiles(df, [], risk, {"_med": 0.5}).first()["_med"]
    return df.withColumn("risk_group", F.when(F.col(risk) > median, "high").otherwise("low"))


def tertiles(df: DataFrame, value: str, names=("low", "mid", "high")) -> DataFrame:
    """Quantile-edge groups: equal values always share one; duplicate edges merge."""
    k = len(names)
    row = quantiles(df, [], value, {f"e{i}": i / k for i in range(1, k)}).first()
    known = df.filter(F.col(value).isNotNull())
    group = None
    for i, name in enumerate(names[:-1], start=1):
        hit = F.col(value) <= row[f"e{i}"]
        group = F.when(hit, name) if group is None else group.when(hit, name)
    return known.withColumn("tertile", group.otherwise(names[-1]))


def top_fraction(df: DataFrame, value: str, fraction: float = 0.10) -> DataFrame:
    """Rows at or above the (1 - fraction) linear quantile."""
    edge = quantiles(df, [], value, {"e": 1 - fraction}).first()["e"]
    return df.filter(F.col(value) >= edge)


def zscore(long: DataFrame, keys=("feature",), value="value", population: bool = False) -> DataFrame:
    """Standardised values per key; a zero spread gives NULL."""
    keys = list(keys)
    spread = F.stddev_pop(value) if population else F.stddev_samp(value)
    stats = long.groupBy(*keys).agg(F.avg(value).alias("_m"), spread.alias("_s"))
    return long.join(stats, keys).withColumn("z", F.when(F.col("_s") > 0, (F.col(value) - F.col("_m")) / F.col("_s"))).drop("_m", "_s")
