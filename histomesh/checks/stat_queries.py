"""Queries over agreement, classifier evaluation, survival statistics and signatures."""

from pyspark.sql import functions as F

from histomesh.checks.fixtures import Registry, Tables, rounded, with_tables
from histomesh.operators import agreement as A
from histomesh.operators import correlation as C
from histomesh.operators import evaluate as E
from histomesh.operators import grouptests as G
from histomesh.operators import signature as M
from histomesh.operators import survival as S
from histomesh.plans import outcome

R = Registry()

# ---- agreement of labelings

PAIRS = with_tables("cells", "cns") + """, pairs as (select cn as a, type_id as b from cns), k as (select a, b, count(*) n from pairs group by 1,2)"""


def pairs(t: Tables):
    cns = t.cns().selectExpr("cell_id", "cn", "type_id")
    return A.published_pairs(cns, cns, ["cell_id"], "cn", "type_id")


@R.add("published_pairs", with_tables("cells", "cns") + """, p as (select cell_id, case when q = 50 then null else type_id end as published from cns)
 select c.cn as a, p.published as b, count(*) as n from cns c join p on c.cell_id = p.cell_id where p.published is not null group by 1,2""")
def published_pairs(t: Tables):
    cns = t.cns()
    published = cns.selectExpr("cell_id", "case when q = 50 then null else type_id end as published")
    return A.contingency(A.published_pairs(cns, published, ["cell_id"], "cn", "published"))


@R.add("crosstab", PAIRS + " select a, b, n, round(n*1.0e0/sum(n) over (partition by a),6) as row_frac from k")
def crosstab(t: Tables):
    return rounded(A.crosstab(pairs(t)), "row_frac")


@R.add("crosstab_wide", PAIRS + " select a, " + ", ".join(f"round(count(*) filter (where b={i})*1.0e0/count(*),6) as b_{i}" for i in range(8)) + " from pairs group by 1")
def crosstab_wide(t: Tables):
    return rounded(A.crosstab_wide(pairs(t), list(range(8))), *[f"b_{i}" for i in range(8)])


@R.add("best_match", PAIRS + ", r as (select a, b, n*1.0e0/sum(n) over (partition by a) f, row_number() over (partition by a order by n desc, b) rn from k) select a, b as best, round(f,6) as overlap from r where rn=1")
def best_match(t: Tables):
    return rounded(A.best_match(pairs(t)), "overlap")


@R.add("adjusted_rand", PAIRS + """, s as (select sum(n*(n-1)/2.0e0) s from k), sa as (select sum(n*(n-1)/2.0e0) s from (select sum(n) n from k group by a)), sb as (select sum(n*(n-1)/2.0e0) s from (select sum(n) n from k group by b)),
 t as (select sum(n)*(sum(n)-1)/2.0e0 t from k) select round((s.s - sa.s*sb.s/t.t)/((sa.s+sb.s)/2 - sa.s*sb.s/t.t),6) as ari from s, sa, sb, t""")
def adjusted_rand(t: Tables):
    return rounded(A.adjusted_rand(pairs(t)), "ari")


@R.add("normalized_mutual_info", PAIRS + """, t as (select sum(n)*1.0e0 t from k), pa as (select a, sum(n)/max(t) p from k, t group by a), pb as (select b, sum(n)/max(t) p from k, t group by b),
 mi as (select sum(k.n/t.t*ln(k.n/t.t/(pa.p*pb.p))) mi from k, t, pa, pb where k.a=pa.a and k.b=pb.b), ha as (select -sum(p*ln(p)) h from pa), hb as (select -sum(p*ln(p)) h from pb)
 select round(mi.mi/((ha.h+hb.h)/2),6) as nmi from mi, ha, hb""")
def normalized_mutual_info(t: Tables):
    return rounded(A.normalized_mutual_info(pairs(t)), "nmi")


VEC = "with e as (select vec_id, embedding::double[] as v, label as cn from embeddings)"


def vectors(t: Tables):
    return t.read("embeddings").selectExpr("vec_id", "cast(embedding as array<double>) as features", "label as cn")


@R.add("silhouette", VEC + """, d as (select a.vec_id, a.cn, b.cn as other, sum(list_distance(a.v,b.v)*list_distance(a.v,b.v)) s, count(*) n from e a join e b on true group by 1,2,3),
 ab as (select vec_id, max(case when cn=other then s/(n-1) end) a, min(case when cn<>other then s/n end) b from d group by 1) select round(avg((b-a)/greatest(a,b)),5) as silhouette from ab""")
def silhouette(t: Tables):
    return rounded(A.silhouette_squared(vectors(t)), "silhouette", places=5)


CENTRES = VEC + """, x as (select vec_id, cn, i, v[i] as x from e, (select unnest(range(1,65)) as i)), c as (select cn, i, avg(x) m from x group by 1,2), cv as (select cn, list(m order by i) m from c group by 1)"""


@R.add("davies_bouldin", CENTRES + """, s as (select e.cn, avg(list_distance(e.v, cv.m)) s from e join cv on e.cn=cv.cn group by 1),
 r as (select a.cn, max((sa.s+sb.s)/list_distance(a.m,b.m)) r from cv a join cv b on a.cn<>b.cn join s sa on a.cn=sa.cn join s sb on b.cn=sb.cn group by 1) select round(avg(r),5) as davies_bouldin from r""")
def davies_bouldin(t: Tables):
    return rounded(A.davies_bouldin(vectors(t)), "davies_bouldin", places=5)


@R.add("inertia", CENTRES + " select round(sum(list_distance(e.v, cv.m)*list_distance(e.v, cv.m)),3) as inertia from e join cv on e.cn=cv.cn")
def inertia(t: Tables):
    return rounded(A.inertia(vectors(t)), "inertia", places=3)


# ---- classifier evaluation

PRED = with_tables("predictions") + """, k as (select mode_id, seed, y_true, y_pred, count(*) n from predictions group by 1,2,3,4),
 tr as (select mode_id, seed, y_true as class, sum(n) support from k group by 1,2,3), sa as (select mode_id, seed, y_pred as class, sum(n) predicted from k group by 1,2,3),
 tp as (select mode_id, seed, y_true as class, n from k where y_true=y_pred),
 cls as (select mode_id, seed, class from tr union select mode_id, seed, class from sa),
 pc as (select cls.*, coalesce(support,0) support, coalesce(predicted,0) predicted, coalesce(tp.n,0) tp from cls left join tr using (mode_id, seed, class) left join sa using (mode_id, seed, class) left join tp using (mode_id, seed, class)),
 m as (select mode_id, seed, class, case when predicted>0 then tp*1.0e0/predicted else 0 end as precision, case when support>0 then tp*1.0e0/support else 0 end as recall,
  case when support+predicted>0 then 2.0e0*tp/(support+predicted) else 0 end as f1, support, predicted, tp from pc),
 agg as (select mode_id, seed, sum(tp)*1.0e0/sum(support) accuracy, avg(f1) macro_f1, sum(support*1.0e0*predicted)/(sum(support)*1.0e0*sum(support)) pe, count(*) filter (where recall<0.1 and support>0)*1.0e0 as n_collapsed from m group by 1,2),
 met as (select mode_id, seed, 'accuracy' as metric, accuracy as value from agg union all select mode_id, seed, 'macro_f1', macro_f1 from agg union all select mode_id, seed, 'cohen_kappa', (accuracy-pe)/(1-pe) from agg union all select mode_id, seed, 'n_collapsed', n_collapsed from agg)"""
KEYS = ["mode_id", "seed"]


@R.add("confusion", PRED + " select mode_id, seed, y_true, y_pred, n, round(n*1.0e0/sum(n) over (partition by mode_id, seed, y_true),6) as row_frac from k")
def confusion(t: Tables):
    return rounded(E.confusion(t.predictions(), KEYS), "row_frac")


@R.add("per_class_metrics", PRED + " select mode_id, seed, class, round(precision,6) as precision, round(recall,6) as recall, round(f1,6) as f1, cast(support as bigint) as support, cast(predicted as bigint) as predicted from m")
def per_class_metrics(t: Tables):
    return rounded(E.per_class_metrics(E.confusion(t.predictions(), KEYS), KEYS), "precision", "recall", "f1")


@R.add("classification_metrics", PRED + " select mode_id, seed, metric, round(value,6) as value from met")
def classification_metrics(t: Tables):
    return rounded(E.classification_metrics(t.predictions(), KEYS), "value")


@R.add("per_class_summary", PRED + " select mode_id, class, round(avg(precision),6) as precision, round(avg(recall),6) as recall, round(avg(f1),6) as f1, round(avg(support),6) as support, count(distinct seed) as n_seeds from m group by 1,2")
def per_class_summary(t: Tables):
    return rounded(E.per_class_summary(E.per_class_metrics(E.confusion(t.predictions(), KEYS), KEYS)), "precision", "recall", "f1", "support")


@R.add("params_vs_f1", PRED + " select mode_id, round(avg(value),6) as macro_f1, mode_id*1000+500 as n_params from met where metric='macro_f1' group by 1")
def params_vs_f1(t: Tables):
    metrics = E.classification_metrics(t.predictions(), KEYS)
    params = t.predictions().select("mode_id").distinct().selectExpr("mode_id", "mode_id*1000+500 as n_params")
    return rounded(E.params_vs_f1(metrics, params), "macro_f1")


@R.add("bootstrap_ci")
def bootstrap_ci(t: Tables):
    """Random intervals; the point value and coverage are tested against row resampling."""
    out = E.bootstrap_ci(t.predictions(), ["mode_id"], n_bootstrap=1000)
    return rounded(out, "value", "ci_lower", "ci_upper")


@R.add("seed_summary", PRED + """, d as (select a.metric, a.mode_id, a.seed, a.value, round(a.value-b.value,12) as d from met a join met b on a.metric=b.metric and a.seed=b.seed and b.mode_id=0),
 rk as (select *, rank() over (partition by metric, mode_id order by abs(d)) + (count(*) over (partition by metric, mode_id, abs(d)) - 1)/2.0e0 as r from d where d <> 0),
 w as (select metric, mode_id, list(r order by seed) rs, least(sum(case when d>0 then r else 0 end), sum(case when d<0 then r else 0 end)) as w from rk where mode_id<>0 group by 1,2),
 en as (select w.metric, w.mode_id, m.m, w.w, list_sum([case when (m.m >> i) & 1 = 1 then rs[i+1] else 0 end for i in range(6) if i < len(rs)]) as s, len(rs) as k from w, (select unnest(range(64)) as m) m where m.m < pow(2, len(rs))),
 p as (select metric, mode_id, least(1.0, 2.0e0*count(*) filter (where s <= w + 1e-9)/pow(2, max(k))) as p from en group by 1,2)
 select d.metric, d.mode_id, round(avg(d.value),6) as mean, round(stddev_samp(d.value),6) as sd, round(avg(d.d),6) as delta_vs_base, count(distinct seed) as n_seeds, case when d.metric <> 'accuracy' then round(max(p.p),6) end as wilcoxon_p
 from d left join p on d.metric=p.metric and d.mode_id=p.mode_id group by 1,2""")
def seed_summary(t: Tables):
    """All four metrics; the accuracies are tied, where the p is the normal one, which SQL lacks."""
    summary = E.seed_summary(E.classification_metrics(t.predictions(), KEYS), 0)
    summary = summary.withColumn("wilcoxon_p", F.when(F.col("metric") != "accuracy", F.col("wilcoxon_p")))
    return rounded(summary, "mean", "sd", "delta_vs_base", "wilcoxon_p")


# ---- survival

CLIN = with_tables("clinical")
LIFE = CLIN + """, dl as (select subtype, os_time, sum(os_event) d, sum(1-os_event) c, count(*) m from clinical group by 1,2),
 life as (select *, sum(m) over (partition by subtype order by os_time desc) as at_risk from dl)"""


@R.add("life_table", LIFE + " select subtype, os_time, cast(d as bigint) as d, cast(c as bigint) as c, cast(at_risk as bigint) as at_risk from life")
def life_table(t: Tables):
    return S.life_table(t.clinical(), ["subtype"])


@R.add("km_curve", LIFE + """, s as (select *, case when max(case when d=at_risk then 1 else 0 end) over w = 1 then 0 else exp(sum(case when d<at_risk then ln(1-d*1.0e0/at_risk) else 0 end) over w) end as s,
  sum(case when d<at_risk then d*1.0e0/(at_risk*1.0e0*(at_risk-d)) else 0 end) over w as v from life window w as (partition by subtype order by os_time))
 select subtype, os_time, cast(d as bigint) as d, cast(c as bigint) as c, cast(at_risk as bigint) as at_risk, round(s,6) as survival,
  round(case when s > 0 and s < 1 then exp(-exp(ln(-ln(s)) - 1.959963984540054e0*sqrt(v)/ln(s))) else s end,6) as ci_lower, round(case when s > 0 and s < 1 then exp(-exp(ln(-ln(s)) + 1.959963984540054e0*sqrt(v)/ln(s))) else s end,6) as ci_upper from s""")
def km_curve(t: Tables):
    return rounded(S.km_curve(t.clinical(), ["subtype"]), "survival", "ci_lower", "ci_upper")


LOGRANK = CLIN + """, days as (select os_time, sum(os_event) dt, count(*) mt from clinical group by 1), nd as (select *, sum(mt) over (order by os_time desc) nt from days),
 g as (select n.os_time, n.dt, n.nt, s.subtype, (select count(*) from clinical c where c.subtype=s.subtype and c.os_time >= n.os_time) as n, (select coalesce(sum(os_event),0) from clinical c where c.subtype=s.subtype and c.os_time = n.os_time) as d
  from nd n, (select distinct subtype from clinical) s where n.dt > 0)"""


@R.add("logrank_observed_expected", LOGRANK + " select subtype, cast(sum(d) as bigint) as observed, round(sum(dt*n*1.0e0/nt),6) as expected from g group by 1")
def logrank_observed_expected(t: Tables):
    return rounded(S.logrank_observed_expected(t.clinical(), "subtype"), "expected")


@R.add("logrank_two_groups", LOGRANK.replace("clinical c where", "two c where").replace("from clinical) s", "from two) s").replace("from clinical group by 1)", "from two group by 1)").replace(
    ", days as", ", two as (select * replace (case when subtype in ('BUILDING','MACHINERY') then 'a' else 'b' end as subtype) from clinical), days as") + """,
 z as (select sum(d - dt*n*1.0e0/nt) z, sum(case when nt > 1 then dt*(nt-dt)/(nt-1.0e0)*(n*1.0e0/nt)*(1-n*1.0e0/nt) else 0 end) v from g where subtype='a') select round(z*z/v,6) as statistic, cast(1 as int) as dof from z""")
def logrank_two_groups(t: Tables):
    two = t.clinical().withColumn("subtype", F.when(F.col("subtype").isin("BUILDING", "MACHINERY"), "a").otherwise("b"))
    return rounded(S.logrank_k(two, "subtype").drop("p"), "statistic")


@R.add("logrank_k")
def logrank_k(t: Tables):
    """k-sample statistic and p; the two-sample case is SQL-checked, the solve is tested."""
    return rounded(S.logrank_k(t.clinical(), "subtype"), "statistic", "p")


FEAT = with_tables("clinical", "features_long") + """, z as (select f.feature, f.sample_id, c.os_time, c.os_event, (f.value - avg(f.value) over w)/stddev_samp(f.value) over w as x from features_long f join clinical c on f.sample_id=c.sample_id
  where f.value is not null window w as (partition by f.feature)),
 dl as (select feature, os_time, count(*)*1.0e0 t0, sum(x) t1, sum(x*x) t2, sum(os_event*1.0e0) e0, sum(os_event*x) e1, sum(os_event*x*x) e2, sum(os_event) d, sum(os_event*x) ex from z group by 1,2),
 rs as (select *, sum(t0) over w s0, sum(t1) over w s1, sum(t2) over w s2 from dl window w as (partition by feature order by os_time desc))"""


def cox_long(t: Tables):
    return S.join_clinical(t.features_long(), t.clinical())


def standard(t: Tables):
    return S._standardised(cox_long(t), ["feature"], "os_time", "os_event")


@R.add("risk_set_sums", FEAT + " select feature, os_time, round(s0,5) as s0, round(s1,5) as s1, round(s2,5) as s2, round(e0,5) as e0, round(e1,5) as e1, round(e2,5) as e2, cast(d as bigint) as d, round(ex,5) as ex from rs")
def risk_set_sums(t: Tables):
    return rounded(S.risk_set_sums(standard(t), ["feature"]), "s0", "s1", "s2", "e0", "e1", "e2", "ex", places=5)


@R.add("cox_newton_step", FEAT + """, st as (select rs.*, l.l/d as a from rs, lateral (select unnest(range(cast(d as bigint)))*1.0e0 as l) l where d > 0),
 sc as (select feature, os_time, max(ex) ex, sum((s1-a*e1)/(s0-a*e0)) u, sum((s2-a*e2)/(s0-a*e0) - ((s1-a*e1)/(s0-a*e0))*((s1-a*e1)/(s0-a*e0))) i, sum(ln(s0-a*e0)) l from st group by 1,2)
 select feature, round(-sum(l),4) as loglik, round(sum(ex-u),5) as score, round(sum(i),5) as information from sc group by 1""")
def cox_newton_step(t: Tables):
    out = S.score_information(S.risk_set_sums(standard(t), ["feature"]), ["feature"])
    return rounded(rounded(out, "loglik", places=4), "score", "information", places=5)


@R.add("univariate_cox", FEAT + " select feature, count(*) as n, cast(sum(os_event) as bigint) as events, 0.0e0 as score_at_fit, true as ordered from z group by 1")
def univariate_cox(t: Tables):
    """Full fit; the SQL side checks counts and that the score vanishes at the fitted value."""
    long = cox_long(t)
    fit = S.univariate_cox(long)
    at = S._standardised(long, ["feature"], "os_time", "os_event").join(fit.select("feature", "beta"), "feature")
    score = S.score_information(S.risk_set_sums(at, ["feature", "beta"], "x", F.col("beta")), ["feature", "beta"], F.col("beta"))
    ordered = (F.col("ci_lower") < F.col("hr")) & (F.col("hr") < F.col("ci_upper")) & (F.col("q") >= F.col("p"))
    return fit.join(score.select("feature", "score"), "feature").select(
        "feature", "n", F.col("events").cast("long").alias("events"), F.abs(F.round("score", 4)).alias("score_at_fit"), ordered.alias("ordered")
    )


def cox_sql(keys: str, having: str = "true", rounds: int = 7) -> str:
    """Newton iterations of the one-feature Cox model (tied events share the risk set) as chained SQL."""
    k = [c.strip() for c in keys.split(",")]
    on = lambda a, b: " and ".join(f"{a}.{c}={b}.{c}" for c in k)
    of = lambda a: ", ".join(f"{a}.{c}" for c in k)
    sql = with_tables("clinical", "features_long") + f""", j as (select c.subtype, f.feature, c.os_time, c.os_event, f.value from features_long f join clinical c on f.sample_id=c.sample_id),
 big as (select subtype from clinical group by 1 having {having}), z as (select {keys}, os_time, os_event, (value - avg(value) over w)/stddev_samp(value) over w as x from j where value is not null and subtype in (select subtype from big) window w as (partition by {keys})),
 b0 as (select {keys}, 0.0e0 as beta, 0.0e0 as info from z group by all)"""
    for i in range(rounds):
        sql += f""", w{i} as (select {of('z')}, z.os_time, z.os_event, z.x, exp(b.beta*z.x) as w from z join b{i} b on {on('z', 'b')}),
 d{i} as (select {keys}, os_time, sum(w) t0, sum(w*x) t1, sum(w*x*x) t2, sum(os_event*w) e0, sum(os_event*w*x) e1, sum(os_event*w*x*x) e2, sum(os_event) d, sum(os_event*x) ex from w{i} group by all),
 r{i} as (select *, sum(t0) over w s0, sum(t1) over w s1, sum(t2) over w s2 from d{i} window w as (partition by {keys} order by os_time desc)),
 s{i} as (select r.*, l.l/d as a from r{i} r, lateral (select unnest(range(cast(d as bigint)))*1.0e0 as l) l where d > 0),
 u{i} as (select {keys}, sum(ex/d - (s1-a*e1)/(s0-a*e0)) u, sum((s2-a*e2)/(s0-a*e0) - ((s1-a*e1)/(s0-a*e0))*((s1-a*e1)/(s0-a*e0))) info from s{i} group by {keys}),
 b{i + 1} as (select {of('b')}, b.beta + u.u/u.info as beta, u.info from b{i} b join u{i} u on {on('b', 'u')})"""
    return sql + f""", cnt as (select {keys}, count(*) n, cast(sum(os_event) as bigint) events from z group by {keys})
 select {of('b')}, round(exp(beta),5) as hr, round(exp(beta - 1.959963984540054e0/sqrt(info)),5) as ci_lower, round(exp(beta + 1.959963984540054e0/sqrt(info)),5) as ci_upper, round(beta*sqrt(info),5) as z, cnt.n, cnt.events
 from b{rounds} b join cnt on {on('b', 'cnt')}"""


@R.add("univariate_cox_estimates", cox_sql("feature"))
def univariate_cox_estimates(t: Tables):
    return rounded(S.univariate_cox(cox_long(t)).drop("beta", "p", "q"), "hr", "ci_lower", "ci_upper", "z", places=5)


@R.add("stratified_univariate_cox", cox_sql("subtype, feature", "count(*) >= 40"))
def stratified_univariate_cox(t: Tables):
    out = S.stratified_univariate_cox(cox_long(t), "subtype").drop("beta", "p", "q")
    return rounded(out, "hr", "ci_lower", "ci_upper", "z", places=5)


@R.add("bh_adjust", with_tables("clinical") + """, p as (select sample_id as feature, os_time/1501.0e0 as p from clinical), n as (select count(*) n from p),
 r as (select feature, p, p*n.n/(count(*) over (order by p range between unbounded preceding and current row)) as raw from p, n) select feature, round(p,6) as p, round(least(1.0, min(raw) over (order by p desc)),6) as q from r""")
def bh_adjust(t: Tables):
    tests = t.clinical().select(F.col("sample_id").alias("feature"), (F.col("os_time") / 1501.0).alias("p"))
    return rounded(S.bh_adjust(tests), "p", "q")


RISK = with_tables("clinical") + ", rk as (select subtype, sample_id, os_time, os_event, ((sample_id*7919) % 97)*1.0e0 - os_time/40.0e0 as risk from clinical)"
RISK_EXPR = "((sample_id*7919) % 97)*1.0D - os_time/40.0D as risk"


def risks(t: Tables):
    return t.clinical().selectExpr("subtype", "sample_id", "os_time", "os_event", RISK_EXPR)


@R.add("concordance_index", RISK + """, p as (select a.subtype, a.risk as ra, b.risk as rb from rk a join rk b on a.subtype=b.subtype and a.os_event=1 and (b.os_time > a.os_time or (b.os_time = a.os_time and b.os_event=0)))
 select subtype, count(*)*1.0e0 as comparable, count(*) filter (where ra > rb)*1.0e0 as concordant, count(*) filter (where ra = rb)*1.0e0 as tied, round((count(*) filter (where ra > rb) + 0.5e0*count(*) filter (where ra = rb))/count(*),6) as c_index from p group by 1""")
def concordance_index(t: Tables):
    return rounded(S.concordance_index(risks(t), ["subtype"]), "c_index")


@R.add("censoring_survival", CLIN + """, dl as (select os_time, sum(os_event) d, sum(1-os_event) c, count(*) m from clinical group by 1), l as (select *, sum(m) over (order by os_time desc) n from dl)
 select os_time, round(case when max(case when c > 0 and c >= n-d then 1 else 0 end) over w = 1 then 0 else exp(sum(case when n-d > 0 and c < n-d then ln(1-c*1.0e0/(n-d)) else 0 end) over w) end,6) as g from l window w as (order by os_time)""")
def censoring_survival(t: Tables):
    return rounded(S.censoring_survival(t.clinical()), "g")


@R.add("time_dependent_auc", RISK + """, dl as (select os_time, sum(os_event) d, sum(1-os_event) c, count(*) m from clinical group by 1), l as (select *, sum(m) over (order by os_time desc) n from dl),
 g as (select os_time, exp(sum(case when n-d > 0 and c < n-d then ln(1-c*1.0e0/(n-d)) else 0 end) over (order by os_time)) as g from l), h as (select * from (values (6),(12),(24)) h(month)),
 ca as (select month, risk, 1/g as w from rk join g on rk.os_time=g.os_time, h where rk.os_time <= month*30.44e0 and os_event=1), co as (select month, risk from rk, h where os_time > month*30.44e0),
 s as (select ca.month, sum(w*case when ca.risk > co.risk then 1.0e0 when ca.risk = co.risk then 0.5e0 else 0 end) num, sum(w) den from ca join co on ca.month=co.month group by 1)
 select cast(month as int) as month, round(num/den,6) as auc from s""")
def time_dependent_auc(t: Tables):
    return rounded(S.time_dependent_auc(risks(t)), "auc")


@R.add("stratify_by_median", RISK + " select sample_id, case when risk > (select quantile_cont(risk, 0.5) from rk) then 'high' else 'low' end as risk_group from rk")
def stratify_by_median(t: Tables):
    return S.median_split(risks(t)).select("sample_id", "risk_group")


@R.add("tertiles", RISK + ", e as (select quantile_cont(risk, 1.0e0/3) a, quantile_cont(risk, 2.0e0/3) b from rk) select sample_id, case when risk <= a then 'low' when risk <= b then 'mid' else 'high' end as tertile from rk, e")
def tertiles(t: Tables):
    return S.tertiles(risks(t), "risk").select("sample_id", "tertile")


@R.add("top_fraction", RISK + " select sample_id from rk where risk >= (select quantile_cont(risk, 0.9) from rk)")
def top_fraction(t: Tables):
    return S.top_fraction(risks(t), "risk", 0.10).select("sample_id")


@R.add("km_by_tertile", RISK + """, e as (select quantile_cont(risk, 1.0e0/3) a, quantile_cont(risk, 2.0e0/3) b from rk), g as (select case when risk <= a then 'low' when risk <= b then 'mid' else 'high' end as tertile, os_time, os_event from rk, e),
 dl as (select tertile, os_time, sum(os_event) d, count(*) m from g group by 1,2), l as (select *, sum(m) over (partition by tertile order by os_time desc) n from dl)
 select tertile, os_time, round(case when max(case when d=n then 1 else 0 end) over w = 1 then 0 else exp(sum(case when d<n then ln(1-d*1.0e0/n) else 0 end) over w) end,6) as survival from l window w as (partition by tertile order by os_time)""")
def km_by_tertile(t: Tables):
    return rounded(S.km_curve(S.tertiles(risks(t), "risk"), ["tertile"]).select("tertile", "os_time", "survival"), "survival")


@R.add("zscore_sample", with_tables("features_long") + " select sample_id, feature, round((value-avg(value) over w)/stddev_samp(value) over w,6) as z from features_long window w as (partition by feature)")
def zscore_sample(t: Tables):
    return rounded(S.zscore(t.features_long()).select("sample_id", "feature", "z"), "z")


@R.add("zscore_population", with_tables("features_long") + " select sample_id, feature, round((value-avg(value) over w)/stddev_pop(value) over w,6) as z from features_long window w as (partition by feature)")
def zscore_population(t: Tables):
    return rounded(S.zscore(t.features_long(), population=True).select("sample_id", "feature", "z"), "z")


@R.add("features_x_clinical", with_tables("clinical", "features_long") + " select f.feature, count(*) as n, count(f.value) as n_known, cast(sum(os_event) as bigint) as events from features_long f join clinical c on f.sample_id=c.sample_id group by 1")
def features_x_clinical(t: Tables):
    joined = S.join_clinical(t.features_long(), t.clinical())
    return joined.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("n_known"), F.sum("os_event").alias("events"))


RHO = with_tables("features_long") + """, p as (select a.feature as fa, b.feature as fb, a.sample_id, a.value as va, b.value as vb from features_long a join features_long b on a.sample_id=b.sample_id where a.value is not null and b.value is not null),
 r as (select fa, fb, rank() over (partition by fa, fb order by va) + (count(*) over (partition by fa, fb, va)-1)/2.0e0 as ra, rank() over (partition by fa, fb order by vb) + (count(*) over (partition by fa, fb, vb)-1)/2.0e0 as rb from p),
 rho as (select fa as feature_a, fb as feature_b, abs(corr(ra, rb)) as rho from r group by 1,2)"""


@R.add("spearman_matrix", RHO + " select feature_a, feature_b, round(rho,6) as rho from rho")
def spearman_matrix(t: Tables):
    return rounded(C.spearman_matrix(t.features_long()), "rho")


@R.add("reduce_collinearity", RHO.replace("with ", "with recursive ", 1) + """, ed as (select feature_a, feature_b from rho where rho > 0.5 and feature_a <> feature_b), reach as (select distinct feature_a as feature, feature_a as g from rho union select r.feature, e.feature_b from reach r join ed e on r.g=e.feature_a),
 grp as (select feature, min(g) as grp from reach group by 1),
 ce as (select rho.feature_a as feature, a.grp, round(avg(rho.rho),12) as c from rho join grp a on rho.feature_a=a.feature join grp b on rho.feature_b=b.feature and a.grp=b.grp group by 1,2)
 select feature, grp as "group", round(c,6) as centrality, row_number() over (partition by grp order by c desc, feature) = 1 as representative from ce""")
def reduce_collinearity(t: Tables):
    return rounded(C.reduce_collinearity(C.spearman_matrix(t.features_long()), 0.5), "centrality")


# ---- signature

COLUMNS = ["acctbal", "n_orders", "total", "avg"]


def design(t: Tables, **kw):
    return M.design(t.features_wide(), t.clinical(), COLUMNS, **kw)


@R.add("signature_report")
def signature_report(t: Tables):
    return rounded(M.signature_report(design(t), 4), "value")


@R.add("lasso_cox_frequency")
def lasso_cox_frequency(t: Tables):
    return M.lasso_cox_frequency(design(t, population_sd=True), COLUMNS)


@R.add("permutation_importance")
def permutation_importance(t: Tables):
    d = design(t)
    return rounded(M.permutation_importance(d, COLUMNS, M.cox_ridge(d, 4)), "importance")


@R.add("select_features", with_tables("features_long") + """, a as (select feature, avg(value) v from features_long group by 1), b as (select feature, max(value) v from features_long group by 1)
 select feature from a where v >= (select quantile_cont(v, 0.5) from a) intersect select feature from b where v >= (select quantile_cont(v, 0.5) from b)""")
def select_features(t: Tables):
    long = t.features_long()
    a = long.groupBy("feature").agg(F.avg("value").alias("frequency"))
    b = long.groupBy("feature").agg(F.max("value").alias("importance"))
    return M.select_features(a, b, 0.5)


@R.add("null_calibration")
def null_calibration(t: Tables):
    return rounded(M.null_calibration(t.features_long(), t.clinical()), "min_p")


@R.add("null_chain")
def null_chain(t: Tables):
    """Selections of an outcome dealt out by hash, which SQL can't repeat; half of the few features are let through."""
    return rounded(outcome.null_chain(t.features_wide(), t.clinical(), top_fraction=0.5), "value")


# ---- group differences

GROUPED = with_tables("features_long", "clinical") + """, f as (select x.feature, c.os_event as g2, c.subtype as g, x.value as v from features_long x join clinical c on c.sample_id = x.sample_id where x.value is not null)"""


def grouped(t: Tables):
    return t.features_long().join(t.clinical(), "sample_id")


@R.add("t_test", GROUPED + """, m as (select feature, g2, count(*) n, avg(v) m, var_samp(v) * (count(*) - 1) s from f group by 1, 2),
 w as (select a.feature, a.n as n1, b.n as n2, a.m - b.m as diff, a.s + b.s as s from m a join m b on a.feature = b.feature and a.g2 = 0 and b.g2 = 1)
 select feature, n1, n2, round(diff / sqrt(s / (n1 + n2 - 2) * (1.0e0/n1 + 1.0e0/n2)), 6) as statistic, cast(n1 + n2 - 2 as double) as df from w""")
def t_test(t: Tables):
    return rounded(G.t_test(grouped(t), "os_event"), "statistic").drop("p")


@R.add("anova", GROUPED + """, m as (select feature, g, count(*) n, avg(v) m, var_samp(v) * (count(*) - 1) s from f group by 1, 2), o as (select feature, avg(v) mean from f group by 1),
 w as (select m.feature, cast(sum(n) as bigint) n, count(*) k, sum(s) wi, sum(n * (m.m - o.mean) * (m.m - o.mean)) be from m join o on o.feature = m.feature group by 1),
 r as (select *, be / (k - 1) / (wi / (n - k)) as st, (n - k) / 2.0e0 as a from w)
 select feature, n, k as n_groups, round(st, 6) as statistic, k - 1 as df1, n - k as df2, round(pow((n - k) / (n - k + 4 * st), a) * (1 + a * (1 - (n - k) / (n - k + 4 * st))), 8) as p from r""")
def anova(t: Tables):
    return rounded(rounded(G.anova(grouped(t), "subtype"), "statistic"), "p", places=8)


RANKED = GROUPED + """, k as (select feature, v, g, g2, rank() over (partition by feature order by v) + (count(*) over (partition by feature, v) - 1) / 2.0e0 as r from f),
 ties as (select feature, sum(c) n, sum(c*c*c - c) t from (select feature, v, count(*) * 1.0e0 as c from f group by 1, 2) group by 1)"""


@R.add("mann_whitney", RANKED + """, s as (select feature, g2, sum(r) r, count(*) * 1.0e0 n from k group by 1, 2),
 w as (select a.feature, a.n as n1, b.n as n2, a.r - a.n * (a.n + 1) / 2 as u, sqrt(a.n * b.n / 12 * ((x.n + 1) - x.t / (x.n * (x.n - 1)))) as sd from s a join s b on a.feature = b.feature and a.g2 = 0 and b.g2 = 1 join ties x on x.feature = a.feature)
 select feature, cast(n1 as bigint) as n1, cast(n2 as bigint) as n2, u as statistic, round(sign(u - n1*n2/2) * greatest(abs(u - n1*n2/2) - 0.5, 0) / sd, 6) as z from w""")
def mann_whitney(t: Tables):
    return rounded(G.mann_whitney(grouped(t), "os_event"), "z").drop("p")


@R.add("kruskal", RANKED + """, s as (select feature, g, sum(r) r, count(*) n from k group by 1, 2),
 w as (select s.feature, cast(max(x.n) as bigint) n, count(*) kk, (12 / (max(x.n) * (max(x.n) + 1)) * sum(r * r / s.n) - 3 * (max(x.n) + 1)) / (1 - max(x.t) / (max(x.n) * max(x.n) * max(x.n) - max(x.n))) h from s join ties x on x.feature = s.feature group by 1)
 select feature, n, kk as n_groups, round(h, 6) as statistic, kk - 1 as df, round(exp(-h/2) * (1 + h/2), 8) as p from w""")
def kruskal(t: Tables):
    return rounded(rounded(G.kruskal(grouped(t), "subtype"), "statistic"), "p", places=8)


@R.add("fisher_exact", with_tables("clinical") + """, m as (select distinct o_custkey as sample_id, l_partkey % 97 as gene from orders join lineitem on l_orderkey = o_orderkey),
 t as (select g.gene, c.os_event = 1 as grp, m.gene is not null as hit from clinical c cross join (select unnest(range(97)) as gene) g left join m on m.sample_id = c.sample_id and m.gene = g.gene),
 c as (select gene, count(*) filter (where hit and grp) a, count(*) filter (where hit and not grp) b, count(*) filter (where not hit and grp) c, count(*) filter (where not hit and not grp) d from t group by 1),
 e as (select *, unnest(range(greatest(0, a - d), least(a + b, a + c) + 1)) as k from c),
 p as (select *, lgamma(a+b+1) - lgamma(k+1) - lgamma(a+b-k+1) + lgamma(c+d+1) - lgamma(a+c-k+1) - lgamma(c+d-a-c+k+1) as w, lgamma(a+b+c+d+1) - lgamma(a+c+1) - lgamma(b+d+1) as al from e),
 o as (select gene, w as own from p where k = a)
 select p.gene, a, b, c, d, round(case when b * c > 0 then a * d * 1.0e0 / (b * c) end, 6) as odds_ratio, round(least(1.0, sum(case when w <= own + 1e-7 then exp(w - al) end)), 7) as p from p join o on o.gene = p.gene group by 1, 2, 3, 4, 5""")
def fisher_exact(t: Tables):
    """One gene per remainder of the part number: mutated in a customer who ordered such a part."""
    lines = t.read("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_partkey") % 97).alias("gene"))
    hits = t.read("orders").select("o_orderkey", F.col("o_custkey").alias("sample_id")).join(lines, "o_orderkey").select("sample_id", "gene").distinct()
    every = t.clinical().select("sample_id", (F.col("os_event") == 1).alias("in_group")).withColumn("gene", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(96).cast("long"))))
    table = every.join(hits.withColumn("mutated", F.lit(True)), ["sample_id", "gene"], "left").withColumn("mutated", F.coalesce("mutated", F.lit(False)))
    return rounded(rounded(G.fisher_exact(table), "odds_ratio"), "p", places=7)
