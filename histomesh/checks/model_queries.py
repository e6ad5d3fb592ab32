"""Queries over sources, logs, clustering, classifiers, tiles and ingest."""

import os
import uuid

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from histomesh.checks.fixtures import Registry, Tables, rounded, with_tables
from histomesh.operators import classify as K
from histomesh.operators import cluster as U
from histomesh.operators import evaluate as E
from histomesh.operators import lattice as G
from histomesh.operators import tiles as I
from histomesh.operators.composition import composition_matrix
from histomesh.session import durable, ensure_checkpoint_dir
from histomesh.sources import tables as X
from histomesh.streaming.ingest import incremental_ingest

R = Registry()


def scratch(t: Tables) -> str:
    """A fresh folder beside the checkpoints (shared storage on a cluster)."""
    return os.path.join(ensure_checkpoint_dir(t.spark), f"tables-{uuid.uuid4().hex}")


# ---- sources and sinks


@R.add("read_table", "select l_orderkey as order_id, l_suppkey as image_id, l_quantity as quantity from lineitem")
def read_table(t: Tables):
    return X.read_table(t.spark, f"{t.dir}/lineitem.parquet", ["l_orderkey", "l_suppkey", "l_quantity"], {"l_orderkey": "order_id", "l_suppkey": "image_id", "l_quantity": "quantity"})


@R.add("read_csv", "select c_custkey as sample_id, c_mktsegment as subtype, c_acctbal as acctbal from customer")
def read_csv(t: Tables):
    path = scratch(t) + ".csv"
    X.write_csv(t.read("customer").select("c_custkey", "c_mktsegment", "c_acctbal"), path)
    return X.read_table(t.spark, path, None, {"c_custkey": "sample_id", "c_mktsegment": "subtype", "c_acctbal": "acctbal"}, "c_custkey long, c_mktsegment string, c_acctbal double")


@R.add("write_json", "select s_suppkey, s_nationkey from supplier")
def write_json(t: Tables):
    path = scratch(t)
    X.write_json(t.read("supplier").select("s_suppkey", "s_nationkey"), path)
    return t.spark.read.schema("s_suppkey long, s_nationkey int").json(path)


@R.add("read_shards", with_tables("lattice") + " select cast(slide_id as bigint) as slide_id, count(*) as n, cast(sum(patch_id) as bigint) as ids from lattice group by 1")
def read_shards(t: Tables):
    path = scratch(t)
    X.write_cached(t.lattice(), path)
    shards = X.read_shards(t.spark, path)
    return shards.groupBy(F.col("slide_id").cast("long").alias("slide_id")).agg(F.count(F.lit(1)).alias("n"), F.sum("patch_id").alias("ids"))


@R.add("union_shards", with_tables("lattice") + " select cast(slide_id as bigint) as slide_id, count(*) as n, cast(sum(patch_id) as bigint) as ids from lattice group by 1")
def union_shards(t: Tables):
    """Two cohorts' shard folders, one with a column more, as one table."""
    paths = [scratch(t), scratch(t)]
    for k, path in enumerate(paths):
        part = t.lattice().filter(F.col("slide_id") % 2 == k)
        X.write_cached(part.withColumn("site", F.lit("b")) if k else part, path)
    both = X.read_shards(t.spark, paths[0]).unionByName(X.read_shards(t.spark, paths[1]), allowMissingColumns=True)
    return both.groupBy(F.col("slide_id").cast("long").alias("slide_id")).agg(F.count(F.lit(1)).alias("n"), F.sum("patch_id").alias("ids"))


@R.add("write_cached", with_tables("cells") + " select image_id, count(*) as n, cast(sum(case when image_id % 2 = 0 then 1 else 2 end) as bigint) as versions from cells group by 1")
def write_cached(t: Tables):
    """Even images are written first as version 1; a second write must add the odd ones only."""
    path = scratch(t)
    cells = t.cells().select("image_id", "cell_id")
    X.write_cached(cells.filter(F.col("image_id") % 2 == 0).withColumn("version", F.lit(1)), path, "image_id")
    X.write_cached(cells.withColumn("version", F.lit(2)), path, "image_id")
    out = t.spark.read.parquet(path).groupBy(F.col("image_id").cast("long").alias("image_id"))
    return out.agg(F.count(F.lit(1)).alias("n"), F.sum("version").alias("versions"))


@R.add("incremental_ingest", with_tables("lattice") + " select slide_id, count(*) as n, count(distinct patch_id) as n_distinct from lattice group by 1")
def ingest(t: Tables):
    """Two arrivals, one slide's patches spread over both, files in batches of their own; every patch lands once."""
    base = scratch(t)
    table = t.lattice().select("slide_id", "patch_id", "label")
    half = table.agg(F.max("slide_id")).first()[0] // 2
    early = (F.col("slide_id") < half) | ((F.col("slide_id") == half) & (F.col("patch_id") % 2 == 0))
    for arrival in (early, ~early):
        table.filter(arrival).write.mode("append").parquet(f"{base}/landing")
        incremental_ingest(t.spark, f"{base}/landing", f"{base}/table", f"{base}/state", table.schema, max_files=2)
    out = t.spark.read.parquet(f"{base}/table").groupBy(F.col("slide_id").cast("long").alias("slide_id"))
    return out.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("patch_id").alias("n_distinct"))


@R.add("fold_embedding", "select vec_id, cast(len(embedding) as int) as dim, round(list_sum(embedding::double[]), 4) as total from embeddings")
def fold_embedding(t: Tables):
    wide = t.read("embeddings").select("vec_id", *[F.element_at("embedding", i + 1).alias(f"emb_{i}") for i in reversed(range(64))])
    folded = X.fold_embedding(wide)
    total = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, v: a + v)
    return folded.select("vec_id", F.size("embedding").alias("dim"), F.round(total, 4).alias("total"))


LOG = with_tables("log_lines")
EPOCHS = LOG + r""", m as (select run_id, line_no, line, try_cast(nullif(regexp_extract(line, 'seed (\d+) \| .* slides', 1), '') as int) as s, nullif(regexp_extract(line, 'HabitatNet\[(\w+)\]', 1), '') as md from log_lines),
 c as (select *, last_value(s ignore nulls) over w as seed, last_value(md ignore nulls) over w as mode from m window w as (partition by run_id order by line_no)),
 ep as (select run_id, line_no, seed, mode, cast(regexp_extract(line, 'epoch\s+(\d+)\s+loss', 1) as int) as epoch, cast(regexp_extract(line, 'loss ([\d.]+)', 1) as double) as loss,
  cast(regexp_extract(line, 'acc ([\d.]+)', 1) as double) as acc, cast(regexp_extract(line, 'f1 ([\d.]+)', 1) as double) as f1 from c where line like 'epoch%' and seed is not null and mode is not null)"""
RESULTS = LOG + r""", rs as (select run_id, cast(regexp_extract(line, 'seed (\d+) (\w+)\s+macro_f1', 1) as int) as seed, regexp_extract(line, 'seed (\d+) (\w+)\s+macro_f1', 2) as mode, cast(regexp_extract(line, 'macro_f1 ([\d.]+)', 1) as double) as macro_f1,
  cast(regexp_extract(line, 'min_recall ([\d.]+)', 1) as double) as min_recall, case when line like '%COLLAPSED%' then '[1, 4]' else '[]' end as collapsed_classes, cast(case when line like '%COLLAPSED%' then 2 else 0 end as int) as n_collapsed
  from log_lines where regexp_matches(line, 'seed \d+ \w+\s+macro_f1'))"""


@R.add("parse_log_epochs", EPOCHS + " select * from ep")
def parse_log_epochs(t: Tables):
    return X.parse_epochs(t.log_lines(), ["run_id"], ["line_no"])


@R.add("parse_log_results", RESULTS + " select * from rs")
def parse_log_results(t: Tables):
    return X.parse_results(t.log_lines(), ["run_id"])


@R.add("read_log", EPOCHS.replace("partition by run_id order by line_no", "order by run_id, line_no") + " select seed, mode, epoch, count(*) as n, round(sum(loss),4) as loss from ep group by 1,2,3")
def read_log(t: Tables):
    """The lines written as one ordered log in parts and read back from disk."""
    path = scratch(t)
    ordered = t.log_lines().repartitionByRange("run_id", "line_no").sortWithinPartitions("run_id", "line_no")
    ordered.select("line").write.text(path)
    epochs, _ = X.read_log(t.spark, path, in_parts=True)
    return epochs.groupBy("seed", "mode", "epoch").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("loss"), 4).alias("loss"))


@R.add("training_curve", EPOCHS + " select mode, epoch, round(avg(loss),6) as loss, round(avg(acc),6) as acc, round(avg(f1),6) as f1, count(*) as n from ep group by 1,2")
def training_curve(t: Tables):
    return rounded(E.training_curve(X.parse_epochs(t.log_lines(), ["run_id"], ["line_no"])), "loss", "acc", "f1")


@R.add("salvage_summary", RESULTS + """, r as (select seed, mode, avg(macro_f1) v from rs group by 1,2), j as (select r.*, r.v - b.v as d from r left join (select * from r where mode='none') b on r.seed=b.seed)
 select mode, count(*) as runs, round(avg(v),6) as mean, round(stddev_samp(v),6) as sd, round(min(v),6) as min, round(max(v),6) as max, count(*) filter (where d > 0) as wins, round(avg(d),6) as mean_delta, round(quantile_cont(d,0.5),6) as median_delta from j group by 1""")
def salvage_summary(t: Tables):
    return rounded(E.salvage_summary(X.parse_results(t.log_lines(), ["run_id"])), "mean", "sd", "min", "max", "mean_delta", "median_delta")


@R.add("expected_runs", RESULTS + """, w as (select cast(s.s as bigint) as seed, m.m as mode from (select unnest(range(1,9)) as s) s, (select unnest(['none','graph','grid2d','grid3d','other']) as m) m)
 select seed, mode from w except select cast(seed as bigint), mode from rs""")
def expected_runs(t: Tables):
    return E.expected_runs(X.parse_results(t.log_lines(), ["run_id"]), list(range(1, 9)), ["none", "graph", "grid2d", "grid3d", "other"])


# ---- clustering

TYPES = list(range(8))
WIDE = [f"n_{i}" for i in TYPES]


def matrix(t: Tables):
    return composition_matrix(t.cells(), TYPES, 40.0, type_col="type_id")


@R.add("fit_topics", with_tables("cells") + " select count(*) as n, cast(6 as int) as n_topics, 1.0e0 as low, 1.0e0 as high, true as explains_more from cells")
def fit_topics(t: Tables):
    """Topic proportions of every cell. They sum to one, and mixing the topics' type shares by them
    gives the counts a higher likelihood than the overall type shares do."""
    counts = durable(matrix(t))
    topics = durable(U.fit_topics(counts, WIDE, ["image_id", "cell_id"], n_topics=6))
    total = F.aggregate("topics", F.lit(0.0), lambda a, v: a + v)
    both = durable(topics.join(counts, ["image_id", "cell_id"]))
    sums = both.agg(*[F.sum(F.col("topics")[k] * F.col(c)).alias(f"{k}_{c}") for k in range(6) for c in WIDE], *[F.sum(c).alias(c) for c in WIDE]).first()
    n = sum(sums[c] for c in WIDE)
    mass = {k: sum(sums[f"{k}_{c}"] for c in WIDE) for k in range(6)}
    mixed = sum(F.col(c) * F.log(sum(F.col("topics")[k] * (sums[f"{k}_{c}"] / mass[k]) for k in range(6))) for c in WIDE if sums[c])
    plain = sum(F.col(c) * float(np.log(sums[c] / n)) for c in WIDE if sums[c])
    return both.agg(
        F.count(F.lit(1)).alias("n"), F.max(F.size("topics")).alias("n_topics"), F.round(F.min(total), 6).alias("low"),
        F.round(F.max(total), 6).alias("high"), (F.sum(mixed) > F.sum(plain)).alias("explains_more"),
    )


def fractions(t: Tables):
    total = sum(F.col(c) for c in WIDE)
    return durable(matrix(t).select("image_id", "cell_id", F.array(*[F.col(c) / total for c in WIDE]).alias("topics")))


@R.add("assign_cns", with_tables("cells") + " select count(*) as n, cast(10 as bigint) as n_classes, true as by_size, 'CN01' as first_label, true as nearest from cells")
def assign_cns(t: Tables):
    """Ten classes over all cells, numbered by size; a class is that of the nearest class mean for 99.5 % of the cells or more."""
    out = durable(U.assign_cns(fractions(t), 10))
    sizes = out.groupBy("cn", "cn_label").agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.col("topics")[i]).alias(f"m{i}") for i in TYPES])
    packed = sizes.agg(F.array_sort(F.collect_list(F.struct("cn", "n", "cn_label"))).alias("s"))
    pair = F.sequence(F.lit(0), F.size("s") - 2)
    centres = sizes.orderBy("cn").collect()  # ten rows
    away = lambda r: sum((F.col("topics")[i] - float(r[f"m{i}"])) * (F.col("topics")[i] - float(r[f"m{i}"])) for i in TYPES)
    nearest = F.array_min(F.array(*[F.struct(away(r).alias("d"), F.lit(r["cn"]).alias("cn")) for r in centres]))["cn"]
    right = out.agg((F.avg((nearest == F.col("cn")).cast("int")) >= 0.995).alias("nearest")).first()["nearest"]
    return packed.select(
        F.aggregate("s", F.lit(0).cast("long"), lambda a, v: a + v["n"]).alias("n"), F.size("s").cast("long").alias("n_classes"),
        F.forall(pair, lambda i: F.get("s", i)["n"] >= F.get("s", i + 1)["n"]).alias("by_size"), F.col("s")[0]["cn_label"].alias("first_label"),
        F.lit(right).alias("nearest"),
    )


@R.add("sweep_k")
def sweep_k(t: Tables):
    return rounded(U.sweep_k(fractions(t)), "silhouette_squared", "davies_bouldin", "ari_vs_previous", "inertia", places=4)


PROB = "(9 - habitat)/16.0e0 as tumour_prob"


def prob_patches(t: Tables):
    return durable(t.habitat_patches().selectExpr("sample_id as slide_id", "patch_id", "x_um", "y_um", "(9 - habitat)/16.0D as tumour_prob"))


@R.add("smoothed_probability", with_tables("habitat_patches") + f""", p as (select *, {PROB} from habitat_patches), r as (select l.sample_id as slide_id, l.patch_id, r.tumour_prob as p, row_number() over (partition by l.patch_id
  order by (l.x_um-r.x_um)*(l.x_um-r.x_um)+(l.y_um-r.y_um)*(l.y_um-r.y_um), r.patch_id) rn from p l join p r on l.sample_id=r.sample_id and l.patch_id<>r.patch_id)
 select slide_id, patch_id, round(avg(p),8) as smoothed, round(stddev_pop(p),8) as gradient from r where rn <= 8 group by 1,2""")
def smoothed_probability(t: Tables):
    return rounded(U.smoothed_probability(prob_patches(t)), "smoothed", "gradient", places=8)


@R.add("assign_compartments", with_tables("habitat_patches") + " select sample_id as slide_id, count(*) as n, cast(3 as bigint) as n_compartments, true as bulk_highest from habitat_patches group by 1 having count(*) >= 50")
def assign_compartments(t: Tables):
    """Three compartments per slide; bulk must have the highest mean probability."""
    out = U.assign_compartments(prob_patches(t))
    per = out.groupBy("slide_id", "compartment").agg(F.count(F.lit(1)).alias("n"), F.avg("smoothed").alias("m"))
    return per.groupBy("slide_id").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_compartments"), (F.max_by("compartment", "m") == "tumour_bulk").alias("bulk_highest")
    )


COLUMNS = ["acctbal", "n_orders", "total", "avg"]


def profiles(t: Tables):
    return durable(U.habitat_profiles(t.features_wide(), COLUMNS))


@R.add("canberra_to_anchors", with_tables("features_long") + """, w as (select sample_id, max(case when feature='acctbal' then value end) a, max(case when feature='n_orders' then value end) b, max(case when feature='total' then value end) c, max(case when feature='avg' then value end) d from features_long group by 1),
 f as (select * from w where a is not null and b is not null and c is not null and d is not null),
 z as (select sample_id, [(a-avg(a) over ())/stddev_pop(a) over (), (b-avg(b) over ())/stddev_pop(b) over (), (c-avg(c) over ())/stddev_pop(c) over (), (d-avg(d) over ())/stddev_pop(d) over ()] as p from f),
 an as (select 0 as anchor, [0.5e0, -1.0e0, 0.25e0, 1.0e0] as v union all select 1, [-0.5e0, 0.75e0, 1.5e0, -2.0e0])
 select sample_id, anchor, round(list_sum([abs(p[i]-v[i])/(abs(p[i])+abs(v[i])) for i in range(1,5)]),6) as dist from z, an""")
def canberra_to_anchors(t: Tables):
    anchors = t.spark.createDataFrame([(0, [0.5, -1.0, 0.25, 1.0]), (1, [-0.5, 0.75, 1.5, -2.0])], "anchor int, profile array<double>")
    return rounded(U.canberra_to(profiles(t), anchors).select("sample_id", "anchor", "dist"), "dist")


@R.add("consensus_cluster", with_tables("features_long") + """, k as (select sample_id from features_long group by 1 having count(value) = 4)
 select count(*) as n_samples, cast(4 as bigint) as n_ecotypes, true as within_unit, true as home_is_best from k""")
def consensus_cluster(t: Tables):
    """Ecotypes of all samples; each sample's own ecotype must have real consensus support."""
    final, consensus = U.consensus_cluster(profiles(t), 4)
    joined = consensus.join(final.select("sample_id", F.col("cluster").alias("home"), "ecotype"), "sample_id")
    per = joined.groupBy("sample_id", "ecotype").agg(
        F.min("consensus").alias("lo"), F.max("consensus").alias("hi"), F.max(F.when(F.col("cluster") == F.col("home"), F.col("consensus"))).alias("own")
    )
    return per.agg(
        F.count(F.lit(1)).alias("n_samples"), F.count_distinct("ecotype").alias("n_ecotypes"),
        ((F.min("lo") >= 0) & (F.max("hi") <= 1)).alias("within_unit"), (F.avg("own") > 0.5).alias("home_is_best"),
    )


@R.add("consensus_pairs", with_tables("predictions") + """, l as (select mode_id * 6 + seed - 1 as rep, vec_id, y_pred % 4 as c from predictions where (vec_id * 11 + mode_id * 7 + seed) % 5 <> 0),
 p as (select count(*) filter (where a.c = b.c) as co, count(*) as seen from l a join l b on a.rep = b.rep and a.vec_id < b.vec_id group by a.vec_id, b.vec_id),
 i as (select count(distinct vec_id) as n from l), h as (select co, seen, count(*) as n from p group by 1, 2)
 select co, seen, n from h union all select 0, 0, i.n * (i.n - 1) // 2 - (select sum(n) from h) from i where i.n * (i.n - 1) // 2 > (select sum(n) from h)""")
def consensus_pairs(t: Tables):
    """All pairs of patches by how often 24 runs put them together."""
    labels = t.predictions().filter("(vec_id * 11 + mode_id * 7 + seed) % 5 <> 0").selectExpr("cast(mode_id * 6 + seed - 1 as int) as rep", "vec_id", "cast(y_pred % 4 as int) as cluster")
    return U.pair_histogram(durable(labels), 24, "vec_id")


@R.add("consensus_sweep", with_tables("features_long") + """, k as (select sample_id from features_long group by 1 having count(value) = 4)
 select cast(k as int) as k, n * (n - 1) // 2 as n_pairs, true as area_in_unit, true as one_chosen from (select count(*) as n from k) c, range(2, 6) t(k)""")
def consensus_sweep(t: Tables):
    """Number of ecotypes by the consensus of all pairs; every sweep holds all pairs and chooses one number."""
    own = profiles(t)
    out = None
    for k in range(2, 6):
        part = U.consensus_pairs(U.replicate_labels(own, k, 200), 200).withColumn("k", F.lit(k))
        out = part if out is None else out.unionByName(part)
    out = durable(out)
    areas = U.consensus_cdf(out, weight="n")
    totals = out.groupBy("k").agg(F.sum("n").cast("long").alias("n_pairs"))
    all_rows = Window.partitionBy(F.lit(0))  # one row per k
    one = F.sum(F.col("chosen").cast("int")).over(all_rows) == 1
    return areas.join(totals, "k").select("k", "n_pairs", F.col("area").between(0, 1).alias("area_in_unit"), one.alias("one_chosen"))


@R.add("consensus_cdf", with_tables("predictions") + """, v as (select mode_id + 2 as k, ((vec_id*37 + seed*11) % 101)/100.0e0 * (1 + mode_id)/4.0e0 as v from predictions), o as (select k, v, row_number() over (partition by k order by v)*1.0e0/count(*) over (partition by k) as f from v),
 g as (select *, lag(v) over (partition by k order by f) pv, lag(f) over (partition by k order by f) pf from o), a as (select k, sum(case when pv is not null then (v-pv)*(f+pf)/2 else 0 end) area from g group by 1),
 d as (select k, area, (area - lag(area) over (order by k))/lag(area) over (order by k) as delta from a)
 select k, round(area,6) as area, round(delta,6) as delta_area, k = (select k from d where delta = (select max(delta) from d) order by k limit 1) as chosen from d""")
def consensus_cdf(t: Tables):
    values = t.predictions().selectExpr("mode_id + 2 as k", "((vec_id*37 + seed*11) % 101)/100.0D * (1 + mode_id)/4.0D as consensus")
    return rounded(U.consensus_cdf(values), "area", "delta_area")


# ---- classifiers


def lattice_patches(t: Tables):
    return durable(G.to_lattice(t.lattice().select("slide_id", "patch_id", "label", "x_um", "y_um", "embedding"), 112.0))


@R.add("context_vectors", with_tables("lattice") + """, w as (select * from (values ('none',64),('graph',256),('grid2d',713),('grid3d',1883)) w(mode, width)) select w.mode, count(*) as n, cast(width as int) as width from lattice, w group by 1, 3""")
def context_vectors(t: Tables):
    patches, out = lattice_patches(t), None
    for mode in K.MODES:
        part = K.context_vectors(patches, mode, 64).select(F.lit(mode).alias("mode"), F.size("x").alias("width"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("mode", "width").agg(F.count(F.lit(1)).alias("n"))


def val_split(patches):
    last = patches.select("slide_id").distinct()
    return last.withColumn("split", F.when(F.col("slide_id") % 4 == 3, "val").otherwise("train"))


@R.add("train_habitat_classifier")
def train_habitat_classifier(t: Tables):
    """Held-out metrics of the plain and the graph-context head."""
    patches = lattice_patches(t)
    split = val_split(patches)
    out = None
    for mode in ("none", "graph"):
        part = K.run_mode(patches, split, mode, 10, 64, max_iter=15, hidden=(32, 16))
        out = part if out is None else out.unionByName(part)
    return rounded(E.classification_metrics(durable(out), ["mode"]), "value")


def _weight(i, j, layer):
    return ((i * 7 + j * 3 + layer * 5) % 11 - 5) / 10.0


def head_weights():
    sizes = [64, 4, 3, 3]
    return [
        (np.array([[_weight(i, j, n) for j in range(sizes[n + 1])] for i in range(sizes[n])]), np.array([0.05 * (j + 1) for j in range(sizes[n + 1])]))
        for n in range(3)
    ]


def _layer_sql(source, size_in, size_out, layer, relu):
    terms = []
    for j in range(size_out):
        s = " + ".join(f"{source}[{i + 1}]*({_weight(i, j, layer)}e0)" for i in range(size_in)) + f" + {0.05 * (j + 1)!r}e0"
        terms.append(f"greatest(0.0e0, {s})" if relu else s)
    return "[" + ", ".join(terms) + "]"


@R.add("predict_habitat", f"""with e as (select vec_id, embedding::double[] as v from embeddings), h1 as (select vec_id, {_layer_sql('v', 64, 4, 0, True)} as h from e),
 h2 as (select vec_id, {_layer_sql('h', 4, 3, 1, True)} as h from h1), o as (select vec_id, {_layer_sql('h', 3, 3, 2, False)} as z from h2),
 x as (select vec_id, z, exp(z[1]-list_max(z)) a, exp(z[2]-list_max(z)) b, exp(z[3]-list_max(z)) c from o)
 select vec_id, cast(list_position(z, list_max(z)) - 1 as int) as habitat, round(greatest(a,b,c)/(a+b+c),6) as confidence, round((a+c)/(a+b+c),6) as tumour_prob from x""")
def predict_habitat(t: Tables):
    out = K.predict_habitat(t.read("embeddings").select("vec_id", "embedding"), head_weights(), [0, 2])
    return rounded(out.drop("embedding"), "confidence", "tumour_prob")


# ---- tiles

PX = with_tables("tile_pixels")
HSV = PX + """, m as (select *, greatest(r,g,b) as v, greatest(r,g,b) - least(r,g,b) as df from tile_pixels),
 hs as (select tile_id, x, y, r, g, b, v as val, cast(case when v = 0 then 0 else floor((df*round(1044480.0e0/v) + 2048)/4096.0e0) end as int) as sat,
  cast(case when df = 0 then 0 else floor(((case when v = r then g-b when v = g then b-r+2*df else r-g+4*df end)*round(737280.0e0/(6*df)) + 2048)/4096.0e0) end as int) as h0 from m),
 hsv as (select *, case when h0 < 0 then h0 + 180 else h0 end as hue, cast(floor((r*9798 + g*19235 + b*3735 + 16384)/32768.0e0) as int) as gray from hs)"""


@R.add("hsv", HSV + " select tile_id, x, y, hue, sat, val, gray from hsv")
def hsv(t: Tables):
    return I.hsv(t.tile_pixels()).withColumn("gray", I.gray()).select("tile_id", "x", "y", "hue", "sat", "val", "gray")


FLAGS = HSV + """, lp as (select a.*, coalesce(lag(gray) over wx, lead(gray) over wx) + coalesce(lead(gray) over wx, lag(gray) over wx) + coalesce(lag(gray) over wy, lead(gray) over wy) + coalesce(lead(gray) over wy, lag(gray) over wy) - 4*gray as lap
  from hsv a window wx as (partition by tile_id, y order by x), wy as (partition by tile_id, x order by y)),
 fl as (select tile_id, var_pop(lap) as blur_var, avg(case when sat > 60 and hue > 35 and hue < 130 then 1.0e0 else 0 end) as pen_frac, avg(case when val < 40 then 1.0e0 else 0 end) as fold_frac from lp group by 1)"""


@R.add("artefact_flags", FLAGS + " select tile_id, cast(round(blur_var*4096) as bigint) as blur_4096, round(pen_frac,6) as pen_frac, round(fold_frac,6) as fold_frac from fl")
def artefact_flags(t: Tables):
    flags = I.artefact_flags(t.tile_pixels())
    exact = flags.select("tile_id", F.round(F.col("blur_var") * 4096).cast("long").alias("blur_4096"), "pen_frac", "fold_frac")
    return rounded(exact, "pen_frac", "fold_frac")


@R.add("drop_artefact_tiles", FLAGS + " select distinct tile_id from fl where not (blur_var < 15 or pen_frac > 0.2 or fold_frac > 0.2)")
def drop_artefact_tiles(t: Tables):
    return I.drop_artefact_tiles(t.tile_pixels(), pen_max=0.2).select("tile_id").distinct()


@R.add("tissue_mask", HSV + """, o as (select cast(a.d as int) as dx, cast(b.d as int) as dy from (select unnest(range(-3,4)) as d) a, (select unnest(range(-3,4)) as d) b),
 md as (select p.tile_id, p.x, p.y, cast(quantile_cont(q.sat, 0.5) as int) as value from hsv p cross join o join hsv q on q.tile_id=p.tile_id and q.x = greatest(0, least(7, p.x+o.dx)) and q.y = greatest(0, least(7, p.y+o.dy)) group by 1,2,3),
 h as (select tile_id, value as bin, count(*) n from md group by 1,2),
 c as (select *, sum(n) over w w0, sum(n*bin) over w m0, sum(n) over (partition by tile_id) tw, sum(n*bin) over (partition by tile_id) tm from h window w as (partition by tile_id order by bin)),
 b as (select *, case when tw > w0 then (w0*1.0e0)*(tw-w0)*(m0/(w0*1.0e0)-(tm-m0)/((tw-w0)*1.0e0))*(m0/(w0*1.0e0)-(tm-m0)/((tw-w0)*1.0e0)) else 0 end as vb from c),
 lv as (select tile_id, bin as level from (select *, row_number() over (partition by tile_id order by vb desc, bin) rn from b) where rn = 1),
 mk as (select md.tile_id, md.x, md.y, case when value > level then 1 else 0 end as m from md join lv on md.tile_id=lv.tile_id),
 di as (select p.tile_id, p.x, p.y, max(q.m) as m from mk p join mk q on p.tile_id=q.tile_id and abs(p.x-q.x) <= 2 and abs(p.y-q.y) <= 2 group by 1,2,3)
 select p.tile_id, p.x, p.y, min(q.m) as mask from di p join di q on p.tile_id=q.tile_id and abs(p.x-q.x) <= 2 and abs(p.y-q.y) <= 2 group by 1,2,3""")
def tissue_mask(t: Tables):
    return I.tissue_mask(t.tile_pixels())


STAIN = PX + """, od as (select tile_id, x as px, y as py, r, g, b, ln(256.0e0)-ln(r+1.0e0) as x, ln(256.0e0)-ln(g+1.0e0) as y2, ln(256.0e0)-ln(b+1.0e0) as z from tile_pixels),
 st as (select * from od where least(x,y2,z) >= 0.15),
 c0 as (select tile_id, count(*) n, avg(x) mx, avg(y2) my, avg(z) mz, covar_samp(x,x) a, covar_samp(y2,y2) b, covar_samp(z,z) c, covar_samp(x,y2) d, covar_samp(x,z) e, covar_samp(y2,z) f from st group by 1 having count(*) >= 10),
 c1 as (select *, (a+b+c)/3 q from c0), c2 as (select *, sqrt(((a-q)*(a-q)+(b-q)*(b-q)+(c-q)*(c-q)+2*(d*d+e*e+f*f))/6) p from c1),
 c3 as (select *, ((a-q)*((b-q)*(c-q)-f*f) - d*(d*(c-q)-f*e) + e*(d*f-(b-q)*e))/(2*p*p*p) hd from c2 where p > 0),
 c4 as (select *, q + 2*p*cos(acos(greatest(-1.0e0, least(1.0e0, hd)))/3 + 2*pi()/3) l from c3),
 c5 as (select *, [[d*f-e*(b-l), e*d-(a-l)*f, (a-l)*(b-l)-d*d], [d*(c-l)-e*f, e*e-(a-l)*(c-l), (a-l)*f-d*e], [(b-l)*(c-l)-f*f, f*e-d*(c-l), d*f-(b-l)*e]] as ks from c4),
 c6 as (select *, list_reverse_sort(list_transform(ks, lambda k: [k[1]*k[1]+k[2]*k[2]+k[3]*k[3], k[1], k[2], k[3]]))[1] as w from c5),
 c7 as (select *, w[2]/sqrt(w[1]) nx, w[3]/sqrt(w[1]) ny, w[4]/sqrt(w[1]) nz from c6 where w[1] > 0), c8 as (select *, mx*nx+my*ny+mz*nz mn from c7),
 c9 as (select *, mx-mn*nx fx, my-mn*ny fy, mz-mn*nz fz from c8), ca as (select *, sqrt(fx*fx+fy*fy+fz*fz) fs from c9),
 cb as (select *, fx/fs ux, fy/fs uy, fz/fs uz from ca where fs > 0), ax as (select *, ny*uz-nz*uy vx, nz*ux-nx*uz vy, nx*uy-ny*ux vz from cb),
 an as (select st.tile_id, atan2(st.x*vx+st.y2*vy+st.z*vz, st.x*ux+st.y2*uy+st.z*uz) as t, ux, uy, uz, vx, vy, vz from st join ax on ax.tile_id = st.tile_id),
 en as (select tile_id, ux, uy, uz, vx, vy, vz, quantile_cont(t, 0.01) lo, quantile_cont(t, 0.99) hi from an group by all),
 vs as (select tile_id, [cos(lo)*ux+sin(lo)*vx, cos(lo)*uy+sin(lo)*vy, cos(lo)*uz+sin(lo)*vz] v1, [cos(hi)*ux+sin(hi)*vx, cos(hi)*uy+sin(hi)*vy, cos(hi)*uz+sin(hi)*vz] v2 from en),
 he as (select tile_id, greatest(v1, v2) h, least(v1, v2) e from vs),
 nn as (select *, list_inner_product(h,h) hh, list_inner_product(e,e) ee, list_inner_product(h,e) as he from he),
 am as (select od.tile_id, px, py, r, g, b, hh, ee, nn.he, hh*ee-nn.he*nn.he as det, h[1]*od.x+h[2]*od.y2+h[3]*od.z ph, e[1]*od.x+e[2]*od.y2+e[3]*od.z pe from od left join nn on nn.tile_id = od.tile_id and hh*ee-nn.he*nn.he > 1e-12),
 a2 as (select *, (ee*ph-he*pe)/det ah, (hh*pe-he*ph)/det ae from am), tp as (select tile_id, quantile_cont(ah, 0.99) th, quantile_cont(ae, 0.99) te from a2 group by 1)"""


@R.add("macenko_normalize", STAIN + """
 select a2.tile_id, px as x, py as y, cast(case when th > 0 and te > 0 then floor(greatest(0.0e0, least(255.0e0, 256*exp(-(ah*1.9705e0/th*0.5626e0 + ae*1.0308e0/te*0.2159e0))-1))) else r end as int) as r,
  cast(case when th > 0 and te > 0 then floor(greatest(0.0e0, least(255.0e0, 256*exp(-(ah*1.9705e0/th*0.7201e0 + ae*1.0308e0/te*0.8012e0))-1))) else g end as int) as g,
  cast(case when th > 0 and te > 0 then floor(greatest(0.0e0, least(255.0e0, 256*exp(-(ah*1.9705e0/th*0.4062e0 + ae*1.0308e0/te*0.5581e0))-1))) else b end as int) as b
 from a2 join tp on tp.tile_id = a2.tile_id""")
def macenko_normalize(t: Tables):
    return I.macenko_normalize(t.tile_pixels()).select("tile_id", "x", "y", "r", "g", "b")


def channel_means():
    return lambda images: images.reshape(len(images), -1, 3).mean(axis=1)


@R.add("encode_tiles", PX + " select tile_id, round(avg(r),3) as red, round(avg(g),3) as green, round(avg(b),3) as blue from tile_pixels group by 1")
def encode_tiles(t: Tables):
    out = I.encode_tiles(I.pack_tiles(t.tile_pixels()), channel_means, ["tile_id"])
    return out.select("tile_id", *[F.round(F.element_at("embedding", i + 1).cast("double"), 3).alias(c) for i, c in enumerate(("red", "green", "blue"))])
