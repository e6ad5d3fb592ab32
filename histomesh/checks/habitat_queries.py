"""Queries over habitat maps: composition, diversity, point patterns, interaction, distances."""

import re

from pyspark.sql import functions as F

from histomesh.checks.fixtures import Registry, Tables, rounded, with_tables
from histomesh.operators import habitat as H
from histomesh.operators import interaction as I
from histomesh.operators import pointpattern as pp
from histomesh.operators.kernel_density import kde_cv

R = Registry()
HP = with_tables("habitat_patches")
# Fixed probe lattice and shift offsets, small enough for the SQL side.
PROBES = [((2 * i + 1) / 10, (2 * j + 1) / 10) for i in range(5) for j in range(5)]
OFFSETS = [((37 * i + 11) % 64 / 64, (23 * i + 5) % 64 / 64) for i in range(50)]
D2 = "(l.x_um-r.x_um)*(l.x_um-r.x_um)+(l.y_um-r.y_um)*(l.y_um-r.y_um)"

WIN = HP + """, win as (select sample_id, min(x_um) x0, max(x_um) x1, min(y_um) y0, max(y_um) y1, (max(x_um)-min(x_um))*(max(y_um)-min(y_um)) area from habitat_patches group by 1),
 cnt as (select sample_id, habitat, count(*) n from habitat_patches group by 1,2 having count(*) >= 10),
 hw as (select c.sample_id, c.habitat, c.n, w.x0, w.x1, w.y0, w.y1, w.area from cnt c join win w on c.sample_id = w.sample_id),
 pts as (select p.sample_id, p.habitat, p.patch_id, p.x_um, p.y_um, least(p.x_um-w.x0, w.x1-p.x_um, p.y_um-w.y0, w.y1-p.y_um) as edge
   from habitat_patches p join hw w on p.sample_id = w.sample_id and p.habitat = w.habitat)"""


@R.add("background_guard", HP + " select count(*) as n_patches, count(*) filter (where patch_id % 97 = 0) as n_outside from habitat_patches")
def background_guard(t: Tables):
    """Every 97th patch is given a class outside the habitats; the report must count just those."""
    odd = F.when(F.col("patch_id") % 97 == 0, F.lit(-1)).otherwise(F.col("habitat"))
    return H.background_report(t.habitat_patches().withColumn("habitat", odd))


@R.add("composition_features", HP + " select * from (" + " union all ".join(
    f"select sample_id, 'comp_H{i + 1:02d}' as feature, round(count(*) filter (where habitat={i})*1.0e0/count(*), 6) as value from habitat_patches group by 1"
    for i in range(10)) + ")")
def composition_features(t: Tables):
    return rounded(H.composition_features(t.habitat_patches()), "value")


DIVERSITY_SQL = HP + """, c as (select sample_id, habitat, count(*) n from habitat_patches group by 1,2),
 t as (select sample_id, sum(n) total from c group by 1), p as (select c.sample_id, c.n*1.0e0/t.total as p, t.total from c join t on c.sample_id = t.sample_id),
 d as (select sample_id, cast(count(*) as double) s, -sum(p*ln(p)) h, sum(p*p) q, max(total) total from p group by 1)"""


@R.add("diversity_features", DIVERSITY_SQL + """
 select sample_id, s as div_richness, round(h,6) as div_shannon, round(1-q,6) as div_simpson, round(1/q,6) as div_inv_simpson,
  round(case when s > 1 then h/ln(s) else 0 end,6) as div_pielou from d""")
def diversity_features(t: Tables):
    table = H.diversity_table(t.habitat_patches()).drop("div_fisher_alpha", "total")
    return rounded(table, "div_shannon", "div_simpson", "div_inv_simpson", "div_pielou")


@R.add("fisher_alpha", DIVERSITY_SQL + " select sample_id, cast(total as bigint) as total, s as div_richness, 0.0e0 as residual from d")
def fisher_alpha(t: Tables):
    table = H.diversity_table(t.habitat_patches())
    a, s = F.col("div_fisher_alpha"), F.col("div_richness")
    residual = F.abs(F.round(a * F.log1p(F.col("total") / a) - s, 6))
    return table.select("sample_id", "total", "div_richness", residual.alias("residual"))


RIPLEY = WIN + f""", pr as (select l.sample_id, l.habitat, l.edge, {D2} as d2 from pts l join pts r on l.sample_id=r.sample_id and l.habitat=r.habitat and {D2} <= 40000),
 s as (select sample_id, habitat, """ + ", ".join(
    f"count(*) filter (where d2 <= {r * r}) as all_{r}, count(*) filter (where d2 <= {r * r} and edge >= {r}) as in_{r}" for r in (20, 50, 100, 200)) + """ from pr group by 1,2),
 m as (select sample_id, habitat, """ + ", ".join(f"count(*) filter (where edge >= {r}) as m_{r}" for r in (20, 50, 100, 200)) + """ from pts group by 1,2),
 k as (select s.*, hw.n, hw.n/hw.area as lam, """ + ", ".join(
    f"case when m_{r} >= 5 then (in_{r}-m_{r})*1.0e0/m_{r}/(hw.n/hw.area) end as k_{r}" for r in (20, 50, 100, 200)) + """
   from s join m on s.sample_id=m.sample_id and s.habitat=m.habitat join hw on s.sample_id=hw.sample_id and s.habitat=hw.habitat)"""


@R.add("ripley_k_l", RIPLEY + " select sample_id, habitat, round(list_avg([k_20,k_50,k_100,k_200]),4) as ripley_k, round(list_avg([" + ",".join(
    f"sqrt(k_{r}/pi())-{r}" for r in (20, 50, 100, 200)) + "]),4) as ripley_l, round((" + "+".join(
    f"(all_{r}-n)*1.0e0/n/lam" for r in (20, 50, 100, 200)) + ")/4,4) as ripley_k_uncorrected from k")
def ripley_k_l(t: Tables):
    out = pp.ripley_and_pair_correlation(t.habitat_patches()).drop("pair_correlation")
    return rounded(out, "ripley_k", "ripley_l", "ripley_k_uncorrected", places=4)


@R.add("pair_correlation", RIPLEY + """ select sample_id, habitat, round(((all_50-all_20)/(n*lam*pi()*2100) + (all_100-all_50)/(n*lam*pi()*7500) + (all_200-all_100)/(n*lam*pi()*30000))/3, 6) as pair_correlation from k""")
def pair_correlation(t: Tables):
    out = pp.ripley_and_pair_correlation(t.habitat_patches()).select("sample_id", "habitat", "pair_correlation")
    return rounded(out, "pair_correlation")


NN = WIN + f""", nn as (select l.sample_id, l.habitat, l.patch_id, sqrt(min({D2})) as d from pts l join pts r
   on l.sample_id=r.sample_id and l.habitat=r.habitat and l.patch_id<>r.patch_id group by 1,2,3)"""


@R.add("g_function", NN + " select sample_id, habitat, round(avg(d),6) as g_function from nn group by 1,2")
def g_function(t: Tables):
    return rounded(pp.g_function(pp.neighbour_distances(t.habitat_patches())), "g_function")


@R.add("clark_evans", NN + """, g as (select sample_id, habitat, avg(d) d from nn group by 1,2)
 select g.sample_id, g.habitat, round(g.d/(0.5/sqrt(n/area) + (0.051+0.041/sqrt(n))*2*((x1-x0)+(y1-y0))/n), 6) as clark_evans
 from g join hw on g.sample_id=hw.sample_id and g.habitat=hw.habitat""")
def clark_evans(t: Tables):
    p = t.habitat_patches()
    return rounded(pp.clark_evans(pp.neighbour_distances(p), pp.habitat_windows(p, ["sample_id"])), "clark_evans")


PROBE = NN + ", probes as (select * from (values " + ",".join(f"({i},{u}e0,{v}e0)" for i, (u, v) in enumerate(PROBES)) + f""") t(probe,u,v)),
 l as (select hw.sample_id, hw.habitat, probe, x0+(x1-x0)*u as x_um, y0+(y1-y0)*v as y_um from hw, probes),
 pd as (select l.sample_id, l.habitat, l.probe, sqrt(min({D2})) as d from l join pts r on l.sample_id=r.sample_id and l.habitat=r.habitat group by 1,2,3)"""


@R.add("f_function", PROBE + " select sample_id, habitat, round(avg(d),6) as f_function from pd group by 1,2")
def f_function(t: Tables):
    return rounded(pp.f_function(pp.probe_distances(t.habitat_patches(), probes=PROBES)), "f_function")


@R.add("j_function", PROBE + """, r as (select sample_id, habitat, quantile_cont(d, 0.5) r from nn group by 1,2),
 g as (select nn.sample_id, nn.habitat, avg(case when d <= r.r then 1.0 else 0.0 end) g from nn join r on nn.sample_id=r.sample_id and nn.habitat=r.habitat group by 1,2),
 f as (select pd.sample_id, pd.habitat, avg(case when d <= r.r then 1.0 else 0.0 end) f from pd join r on pd.sample_id=r.sample_id and pd.habitat=r.habitat group by 1,2)
 select g.sample_id, g.habitat, round(case when 1-f > 1e-9 then (1-g)/(1-f) end, 6) as j_function from g join f on g.sample_id=f.sample_id and g.habitat=f.habitat""")
def j_function(t: Tables):
    p = t.stored("habitat_patches")
    return rounded(pp.j_function(pp.neighbour_distances(p), pp.probe_distances(p, probes=PROBES)), "j_function")


DEFAULT_PROBES = NN + ", probes as (select * from (values " + ",".join(
    f"({i},cast('{u!r}' as double),cast('{v!r}' as double))" for i, (u, v) in enumerate(pp.unit_probes())) + f""") t(probe,u,v)),
 l as (select hw.sample_id, hw.habitat, probe, x0+(x1-x0)*u as x_um, y0+(y1-y0)*v as y_um from hw, probes),
 pd as (select l.sample_id, l.habitat, l.probe, sqrt(min({D2})) as d from l join pts r on l.sample_id=r.sample_id and l.habitat=r.habitat group by 1,2,3)"""


@R.add("f_function_default_probes", DEFAULT_PROBES + " select sample_id, habitat, round(avg(d),6) as f_function from pd group by 1,2")
def f_function_default_probes(t: Tables):
    """The 500 standard probes of every sample window."""
    return rounded(pp.f_function(pp.probe_distances(t.habitat_patches())), "f_function")


@R.add("quadrat_dispersion", WIN + ", q as (select p.sample_id, p.habitat, " + ", ".join(
    "(" + "+".join(f"case when p.{a}_um >= w.{a}0 + {i}.0e0*((w.{a}1-w.{a}0)/8) then 1 else 0 end" for i in range(1, 8)) + f") as q{a}" for a in "xy") + """
  from pts p join hw w on p.sample_id=w.sample_id and p.habitat=w.habitat),
 c as (select sample_id, habitat, qx, qy, count(*) c from q group by 1,2,3,4)
 select sample_id, habitat, round((sum(c*c)/64.0e0 - (sum(c)/64.0e0)*(sum(c)/64.0e0))/(sum(c)/64.0e0), 6) as quadrat_dispersion from c group by 1,2""")
def quadrat_dispersion(t: Tables):
    return rounded(pp.quadrat_vmr(t.habitat_patches()), "quadrat_dispersion")


KDE_SQL = WIN + """, cv as (select sample_id, habitat, count(*) n, var_samp(x_um) sxx, var_samp(y_um) syy, covar_samp(x_um,y_um) sxy from pts group by 1,2),
 q as (select l.sample_id, l.habitat, l.patch_id, sum(exp(-0.5*(syy*(l.x_um-r.x_um)*(l.x_um-r.x_um) - 2*sxy*(l.x_um-r.x_um)*(l.y_um-r.y_um) + sxx*(l.y_um-r.y_um)*(l.y_um-r.y_um))
    /(sxx*syy-sxy*sxy)*pow(n, 1.0e0/3))) as s
  from pts l join pts r on l.sample_id=r.sample_id and l.habitat=r.habitat join cv on l.sample_id=cv.sample_id and l.habitat=cv.habitat group by 1,2,3)
 select sample_id, habitat, round(stddev_pop(s)/avg(s), 6) as kde_summary from q group by 1,2"""


@R.add("kde_summary", KDE_SQL)
def kde_summary(t: Tables):
    p = t.habitat_patches()
    group = ["sample_id", "habitat"]
    dense = p.join(pp.habitat_windows(p, ["sample_id"]).select(*group), group, "left_semi")
    return rounded(kde_cv(dense, group), "kde_summary")


@R.add("dispersion_guard", HP + """, s as (select distinct sample_id from habitat_patches), h as (select unnest(range(10)) as habitat),
 c as (select sample_id, habitat, count(*) n from habitat_patches group by 1,2)
 select s.sample_id, cast(h.habitat as int) as habitat, cast(coalesce(c.n,0) as bigint) as n, coalesce(c.n,0) >= 10 as passes
 from s cross join h left join c on s.sample_id=c.sample_id and h.habitat=c.habitat""")
def dispersion_guard(t: Tables):
    return pp.dispersion_with_guard(t.habitat_patches())


ADJ = HP + f""", pr as (select l.sample_id, l.patch_id as a_id, r.patch_id as b_id, l.habitat as ha, r.habitat as hb from habitat_patches l join habitat_patches r
   on l.sample_id=r.sample_id and l.patch_id < r.patch_id and {D2} <= 10000)"""


@R.add("adjacency_matrix", ADJ + """, e as (select sample_id, ha as a, hb as b from pr union all select sample_id, hb, ha from pr),
 c as (select sample_id, a, b, count(*) n from e group by 1,2,3)
 select sample_id, a, b, n, round(n*1.0e0/sum(n) over (partition by sample_id), 6) as freq from c""")
def adjacency_matrix(t: Tables):
    return rounded(I.adjacency_matrix(t.habitat_patches()), "freq")


@R.add("interaction_z", ADJ + """, win as (select sample_id, min(x_um) x0, max(x_um) x1, min(y_um) y0, max(y_um) y1 from habitat_patches group by 1),
 offs as (select * from (values """ + ",".join(f"({i},{u}e0,{v}e0)" for i, (u, v) in enumerate(OFFSETS)) + f""") t(perm,u,v)),
 l as (select p.sample_id, p.patch_id, o.perm, w.x0 + fmod(p.x_um-w.x0+o.u*(w.x1-w.x0), w.x1-w.x0) as x_um, w.y0 + fmod(p.y_um-w.y0+o.v*(w.y1-w.y0), w.y1-w.y0) as y_um
   from habitat_patches p join win w on p.sample_id=w.sample_id cross join offs o),
 lab as (select l.sample_id, l.patch_id, l.perm, arg_min(r.habitat, ({D2}, r.patch_id)) as h from l join habitat_patches r on l.sample_id=r.sample_id group by 1,2,3),
 all_lab as (select * from lab union all select sample_id, patch_id, -1, habitat from habitat_patches),
 e as (select a.sample_id, a.perm, a.h as a, b.h as b from pr join all_lab a on pr.a_id=a.patch_id join all_lab b on pr.b_id=b.patch_id and a.perm=b.perm
   union all select a.sample_id, a.perm, b.h, a.h from pr join all_lab a on pr.a_id=a.patch_id join all_lab b on pr.b_id=b.patch_id and a.perm=b.perm),
 c as (select sample_id, perm, a, b, count(*) n from e group by 1,2,3,4),
 f as (select sample_id, perm, a, b, n*1.0e0/sum(n) over (partition by sample_id, perm) as f from c),
 scaf as (select s.sample_id, p.perm, cast(x.a as int) a, cast(y.b as int) b from (select distinct sample_id from habitat_patches) s cross join (select distinct perm from all_lab) p
   cross join (select unnest(range(10)) a) x cross join (select unnest(range(10)) b) y),
 g as (select scaf.*, coalesce(f.f, 0) as f from scaf left join f on scaf.sample_id=f.sample_id and scaf.perm=f.perm and scaf.a=f.a and scaf.b=f.b),
 z as (select sample_id, a, b, max(f) filter (where perm=-1) obs, avg(f) filter (where perm>=0) mu, stddev_pop(f) filter (where perm>=0) sd from g group by 1,2,3)
 select sample_id, a, b, round(obs,9) as observed, round(mu,9) as null_mean, round(sd,9) as null_sd, round(case when sd > 1e-9 then (obs-mu)/sd else 0 end, 4) as z from z""")
def interaction_z(t: Tables):
    out = I.interaction_z(t.stored("habitat_patches"), offsets=OFFSETS)
    return rounded(rounded(out, "observed", "null_mean", "null_sd", places=9), "z", places=4)


@R.add("null_model_comparison")
def null_model_comparison(t: Tables):
    return I.null_model_comparison(t.stored("habitat_patches"))


@R.add("distance_features", HP + f""", c as (select sample_id, habitat, count(*) n from habitat_patches group by 1,2),
 d as (select l.sample_id, l.habitat as source, r.habitat as target, l.patch_id, sqrt(min({D2})) as d from habitat_patches l join habitat_patches r
   on l.sample_id=r.sample_id and l.patch_id<>r.patch_id and l.habitat <= r.habitat group by 1,2,3,4)
 select d.sample_id, d.source, d.target, round(avg(d.d),6) as mean_dist from d join c on d.sample_id=c.sample_id and d.target=c.habitat and c.n >= 2 group by 1,2,3""")
def distance_features(t: Tables):
    return rounded(H.pair_distances(t.stored("habitat_patches")), "mean_dist")


TRANSITION = HP + """, r as (select l.sample_id, l.habitat as s, r.habitat as d, row_number() over (partition by l.patch_id
   order by (l.x_um-r.x_um)*(l.x_um-r.x_um)+(l.y_um-r.y_um)*(l.y_um-r.y_um), r.patch_id) rn
  from habitat_patches l join habitat_patches r on l.sample_id=r.sample_id and l.patch_id<>r.patch_id),
 c as (select sample_id, s, d, count(*) n from r where rn <= 6 group by 1,2,3),
 p as (select sample_id, n*1.0e0/sum(n) over (partition by sample_id) p from c)"""


@R.add("transition_entropy", TRANSITION + " select sample_id, round(-sum(p*ln(p)),6) as transition_ste from p group by 1")
def transition_entropy(t: Tables):
    return rounded(H.transition_entropy(t.habitat_patches()), "transition_ste")


def _block(name: str, feature: str, value: str) -> str:
    """One feature block as (sample_id, feature, value), from the SQL of its own query."""
    full = re.sub(r"(?:(?<!\d)|(?<=/3)),\s?[469]\)", ", 12)", R.sql[name])  # keep the digits, round once at the end
    return f"select sample_id, {feature} as feature, {value} as value from ({full}) b_{name}_{value}"


def _tag(column: str) -> str:
    return f"lpad(cast({column}+1 as varchar), 2, '0')"


ALL_FEATURES = " union all ".join(
    [_block("composition_features", "feature", "value"), _block("transition_entropy", "'transition_ste'", "transition_ste")]
    + [_block("diversity_features", f"'{m}'", m) for m in H.DIVERSITY if m != "div_fisher_alpha"]
    + [
        _block(q, f"concat('disp_H', {_tag('habitat')}, '_{m}')", m)
        for q, m in [("ripley_k_l", "ripley_k"), ("ripley_k_l", "ripley_l")]
        + [(m, m) for m in ("pair_correlation", "g_function", "f_function", "j_function", "clark_evans", "quadrat_dispersion", "kde_summary")]
    ]
    + [
        _block("interaction_z", f"concat('inter_H', {_tag('a')}, '_H', {_tag('b')})", "z"),
        _block("distance_features", f"concat('dist_H', {_tag('source')}, '_H', {_tag('target')})", "mean_dist"),
    ]
)


@R.add("extract_all_features", f"""select sample_id, feature, case when feature like '%ripley_k' then round(value,3) when feature like 'inter_%' then round(value,4) else round(value,8) end as value
 from ({ALL_FEATURES}) f where value is not null""")
def extract_all_features(t: Tables):
    """The wide feature table read back in long form (one iteratively solved column has its own query)."""
    wide = H.extract_all_features(t.habitat_patches(), probes=PROBES, offsets=OFFSETS)
    names = [n for n in H.feature_names() if n != "div_fisher_alpha"]
    long = wide.unpivot("sample_id", names, "feature", "value").filter(F.col("value").isNotNull())
    f, v = F.col("feature"), F.col("value")
    return long.withColumn("value", F.when(f.like("%ripley_k"), F.round(v, 3)).when(f.startswith("inter_"), F.round(v, 4)).otherwise(F.round(v, 8)))


@R.add("features_by_compartment", HP + """, p as (select *, case when habitat < 3 then 'tumour_bulk' when habitat < 6 then 'leading_edge' else 'other' end as compartment from habitat_patches),
 c as (select sample_id, compartment, habitat, count(*) n from p group by 1,2,3), t as (select sample_id, compartment, sum(n) total, count(*)*1.0e0 s from c group by 1,2)
 select c.sample_id, c.compartment, max(s) as div_richness, round(-sum(n*1.0e0/total*ln(n*1.0e0/total)),6) as div_shannon from c join t on c.sample_id=t.sample_id and c.compartment=t.compartment group by 1,2""")
def features_by_compartment(t: Tables):
    h = F.col("habitat")
    compartment = F.when(h < 3, "tumour_bulk").when(h < 6, "leading_edge").otherwise("other")
    keys = ["sample_id", "compartment"]
    table = H.diversity_table(t.habitat_patches().withColumn("compartment", compartment), keys)
    return rounded(table.select(*keys, "div_richness", "div_shannon"), "div_shannon")
