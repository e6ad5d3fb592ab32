"""Queries over labels, slides, registration and the patch lattice."""

import numpy as np
from pyspark.sql import functions as F

from histomesh.checks.fixtures import Registry, Tables, rounded, with_tables
from histomesh.operators import labels as L
from histomesh.operators import lattice as G
from histomesh.operators import slides as S

R = Registry()
MPP = 0.325
AFFINE = [[1 / MPP, 0.0, 0.0], [0.0, 1 / MPP, 0.0]]
S_FACTOR = repr(1 / MPP) + "e0"


@R.add("apply_affine", with_tables("cells") + f" select cell_id, round({S_FACTOR}*x_um + 0.25e0*y_um + 3, 6) as x_px, round(-0.125e0*x_um + {S_FACTOR}*y_um + 7.5e0, 6) as y_px from cells")
def apply_affine(t: Tables):
    out = L.apply_affine(t.cells(), [[1 / MPP, 0.25, 3.0], [-0.125, 1 / MPP, 7.5]]).select("cell_id", "x_px", "y_px")
    return rounded(out, "x_px", "y_px")


@R.add("apply_affine_per_sample", with_tables("cells") + """ select cell_id, round((1.0e0 + s_suppkey/1000.0e0)*x_um + 0.0e0*y_um + s_suppkey, 6) as x_px, round(0.0e0*x_um + 2.0e0*y_um - s_suppkey, 6) as y_px
 from cells join supplier on image_id = s_suppkey""")
def apply_affine_per_sample(t: Tables):
    affines = t.read("supplier").select(
        F.col("s_suppkey").alias("image_id"), (1.0 + F.col("s_suppkey") / 1000.0).alias("a00"), F.lit(0.0).alias("a01"),
        F.col("s_suppkey").cast("double").alias("a02"), F.lit(0.0).alias("a10"), F.lit(2.0).alias("a11"),
        (-F.col("s_suppkey")).cast("double").alias("a12"),
    )
    out = L.apply_affine_table(t.cells(), affines, ["image_id"]).select("cell_id", "x_px", "y_px")
    return rounded(out, "x_px", "y_px")


TRANSFER = with_tables("cells", "cns", "nuclei") + f""", p as (select image_id as sample_id, cell_id as match_id, cn, {S_FACTOR}*x_um+0.0e0*y_um+0.0e0 as cx, 0.0e0*x_um+{S_FACTOR}*y_um+0.0e0 as cy from cns),
 r as (select n.sample_id, n.nucleus_id, n.x_px, n.y_px, p.match_id, p.cn, (x_px-cx)*(x_px-cx)+(y_px-cy)*(y_px-cy) as d2,
   row_number() over (partition by n.nucleus_id order by (x_px-cx)*(x_px-cx)+(y_px-cy)*(y_px-cy), p.match_id) rn from nuclei n join p on n.sample_id = p.sample_id),
 tr as (select sample_id, nucleus_id, x_px, y_px, match_id, sqrt(d2)*{MPP}e0 as dist, cast(case when sqrt(d2)*{MPP}e0 <= 3 then cn else -1 end as int) as cn from r where rn = 1)"""


def transferred(t: Tables):
    cns = t.stored("cns").withColumnRenamed("image_id", "sample_id")
    return L.transfer_labels(t.stored("nuclei"), cns, AFFINE, MPP, 3.0)


@R.add("transfer_labels", TRANSFER + " select sample_id, nucleus_id, match_id, round(dist,6) as match_distance_um, cn from tr")
def transfer_labels(t: Tables):
    return rounded(transferred(t).drop("x_px", "y_px"), "match_distance_um")


@R.add("matched_fraction", TRANSFER + " select count(*) as n, round(avg(case when cn >= 0 then 1.0 else 0.0 end),6) as matched, avg(case when cn >= 0 then 1.0 else 0.0 end) < 0.3 as suspicious from tr")
def matched_fraction(t: Tables):
    return rounded(L.matched_fraction(transferred(t)), "matched")


PATCHES = with_tables("cells", "cns") + """, g as (select image_id as sample_id, cast(floor(x_um/50.0e0) as bigint) as patch_x, cast(floor(y_um/50.0e0) as bigint) as patch_y, cn, count(*) as c from cns group by 1,2,3,4),
 d as (select *, sum(c) over (partition by sample_id, patch_x, patch_y) as n, row_number() over (partition by sample_id, patch_x, patch_y order by c desc, cn) as rn from g),
 patches as (select sample_id, patch_x, patch_y, cast(case when n <= 5 then 10 else cn end as int) as label, cast(n as bigint) as n_cells, c*1.0e0/n as dominant_frac from d
   where rn = 1 and (n <= 5 or (n > 15 and c*1.0e0/n >= 0.6e0)))"""


def patches(t: Tables):
    return L.label_patches(t.cns().withColumnRenamed("image_id", "sample_id"), 50.0, xy=("x_um", "y_um"))


@R.add("label_patches", PATCHES + " select sample_id, patch_x, patch_y, label, n_cells, round(dominant_frac,6) as dominant_frac from patches")
def label_patches(t: Tables):
    return rounded(patches(t), "dominant_frac")


@R.add("patch_label_report", PATCHES + """ select label, count(*) as n, round(100.0e0*count(*)/sum(count(*)) over (),6) as pct, quantile_cont(n_cells,0.5) as median_cells,
 round(quantile_cont(dominant_frac,0.5),6) as median_dominant_frac from patches group by 1""")
def patch_label_report(t: Tables):
    return rounded(L.patch_label_report(patches(t)), "pct", "median_dominant_frac")


@R.add("patch_lineage_summary", with_tables("cells") + """, g as (select image_id as sample_id, cast(floor(x_um/100.0e0) as bigint) as patch_x, cast(floor(y_um/100.0e0) as bigint) as patch_y, type_id as lineage, count(*) as c from cells group by 1,2,3,4),
 d as (select *, sum(c) over (partition by sample_id, patch_x, patch_y) as n, row_number() over (partition by sample_id, patch_x, patch_y order by c desc, lineage) as rn from g)
 select sample_id, patch_x, patch_y, cast(n as bigint) as n_cells, lineage as dominant, round(c*1.0e0/n,6) as purity from d where rn = 1 and n >= 50""")
def patch_lineage_summary(t: Tables):
    cells = t.cells().selectExpr("image_id as sample_id", "x_um", "y_um", "type_id as lineage")
    return rounded(L.patch_lineage_summary(cells, 100.0, 50, xy=("x_um", "y_um")), "purity")


@R.add("purest_patches", with_tables("cells") + """, g as (select image_id as sample_id, cast(floor(x_um/100.0e0) as bigint) as patch_x, cast(floor(y_um/100.0e0) as bigint) as patch_y, type_id as lineage, count(*) as c from cells group by 1,2,3,4),
 d as (select *, sum(c) over (partition by sample_id, patch_x, patch_y) as n, row_number() over (partition by sample_id, patch_x, patch_y order by c desc, lineage) as rn from g),
 p as (select sample_id, patch_x, patch_y, cast(n as bigint) as n_cells, lineage as dominant, c*1.0e0/n as purity from d where rn = 1 and n >= 25),
 r as (select *, row_number() over (partition by dominant order by purity desc, n_cells desc, patch_x, patch_y, sample_id) as rank from p)
 select sample_id, patch_x, patch_y, n_cells, dominant, round(purity,6) as purity, cast(rank as int) as rank from r where rank <= 5""")
def purest_patches(t: Tables):
    cells = t.cells().selectExpr("image_id as sample_id", "x_um", "y_um", "type_id as lineage")
    summary = L.patch_lineage_summary(cells, 100.0, 25, xy=("x_um", "y_um"))
    return rounded(S.purest_patches(summary, 5, ties=("patch_x", "patch_y", "sample_id")), "purity")


@R.add("contiguous_cap", with_tables("cells") + """, p as (select distinct image_id as sample_id, cast(floor(x_um/10.0e0) as bigint) as patch_x, cast(floor(y_um/10.0e0) as bigint) as patch_y from cells),
 c as (select sample_id, quantile_cont(patch_x,0.5) cx, quantile_cont(patch_y,0.5) cy from p group by 1),
 r as (select p.*, row_number() over (partition by p.sample_id order by (patch_x-cx)*(patch_x-cx)+(patch_y-cy)*(patch_y-cy), patch_x, patch_y) rn from p join c on p.sample_id=c.sample_id)
 select sample_id, patch_x, patch_y from r where rn <= 40""")
def contiguous_cap(t: Tables):
    p = t.cells().selectExpr(
        "image_id as sample_id", "cast(floor(x_um/10.0) as bigint) as patch_x", "cast(floor(y_um/10.0) as bigint) as patch_y"
    ).distinct()
    return L.contiguous_cap(p, 40)


@R.add("grid_subsample", with_tables("cells") + """, o as (select image_id, cell_id, row_number() over (partition by image_id order by yi, xi, cell_id) - 1 as p, count(*) over (partition by image_id) as n from cells),
 i as (select distinct o.image_id, cast(round_even(g.i*(o.n-1)/19.0e0, 0) as bigint) as p from (select distinct image_id, n from o) o, (select unnest(range(20)) as i) g)
 select o.image_id, o.cell_id from o join i on o.image_id = i.image_id and o.p = i.p""")
def grid_subsample(t: Tables):
    return L.grid_subsample(t.cells(), 20, ["image_id"], ["yi", "xi", "cell_id"]).select("image_id", "cell_id")


SPLIT_SQL = """ split as (select sample_id, case when p < 4 then 'train' when p < 5 then 'val' when p < 6 then 'test' else 'unused' end as split
 from (select sample_id, row_number() over (order by (sample_id*7919 + 42*104729) % 1000003, sample_id) - 1 as p from (select distinct l_suppkey as sample_id from lineitem)))"""


def split_of(t: Tables):
    key = F.expr("(sample_id*7919 + 42*104729) % 1000003")
    samples = t.read("lineitem").select(F.col("l_suppkey").alias("sample_id"))
    return L.sample_split(samples, "sample_id", {"train": 4, "val": 1, "test": 1}, key)


@R.add("sample_split", "with " + SPLIT_SQL + " select * from split")
def sample_split(t: Tables):
    return split_of(t)


@R.add("split_leaks", "with " + SPLIT_SQL + " select sample_id, cast(2 as bigint) as n_splits from split where sample_id % 7 = 0")
def split_leaks(t: Tables):
    """Every seventh sample is also put into a second split; the report must name just those."""
    split = split_of(t)
    leaked = split.filter(F.col("sample_id") % 7 == 0).withColumn("split", F.concat("split", F.lit("_again")))
    rows = t.read("lineitem").select(F.col("l_suppkey").alias("sample_id")).join(split.unionByName(leaked), "sample_id")
    return L.split_leaks(rows, "sample_id")


@R.add("class_weights", with_tables("cells", "cns") + " select cell_id, cn, 1.0e0/count(*) over (partition by cn) as weight from cns")
def class_weights(t: Tables):
    return L.class_weights(t.cns().select("cell_id", "cn"), "cn")


@R.add("top_n_by_p", "select p_partkey as feature, p_retailprice as p from part order by p, feature limit 20")
def top_n_by_p(t: Tables):
    return S.top_n_by_p(t.read("part").select(F.col("p_partkey").alias("feature"), F.col("p_retailprice").alias("p")))


@R.add("balanced_resample", with_tables("cns") + """, c as (select cn, count(*) as n from cns group by 1) select cn, true as within_five_sigma from c""")
def balanced_resample(t: Tables):
    """Draws per class lie within five standard deviations of the even share, also for rare classes."""
    cns = t.cns().select("image_id", "cell_id", "cn")
    drawn = L.balanced_resample(cns, "cn", ["image_id", "cell_id"]).groupBy("cn").agg(F.count(F.lit(1)).alias("n"))
    mean = cns.count() / cns.select("cn").distinct().count()
    return drawn.select("cn", (F.abs(F.col("n") - mean) < 5 * mean**0.5).alias("within_five_sigma"))


@R.add("pooled_fit_sample", with_tables("cells") + " select least(5000, count(*)) as n, least(5000, count(*)) as n_distinct from cells")
def pooled_fit_sample(t: Tables):
    sample = L.pooled_fit_sample(t.cells().select("cell_id"), 5000, ["cell_id"])
    return sample.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("cell_id").alias("n_distinct"))


@R.add("nearest_centroid", """with e as (select vec_id, embedding::double[] as v, label from embeddings),
 c as (select label, i, avg(v[i]) as m from (select label, v, unnest(range(1, len(v)+1)) as i from e) group by 1,2),
 cv as (select label, list(m order by i) as m from c group by 1),
 s as (select e.vec_id, cv.label as name, list_dot_product(e.v, cv.m)/(greatest(sqrt(list_dot_product(e.v,e.v)),1e-9)*greatest(sqrt(list_dot_product(cv.m,cv.m)),1e-9)) as sim from e cross join cv),
 r as (select *, row_number() over (partition by vec_id order by sim desc, name) rn from s)
 select vec_id, cast(name as int) as name, round(sim,6) as confidence from r where rn = 1""")
def nearest_centroid(t: Tables):
    from histomesh.functions.vectors import mean_vector

    points = t.read("embeddings").select("vec_id", "label", "embedding")
    centroids = points.groupBy(F.col("label").alias("name")).agg(mean_vector("embedding").alias("centroid"))
    out = L.nearest_centroid(points.drop("label"), centroids)
    return rounded(out.select("vec_id", "name", "confidence"), "confidence")


SLIDES = """ slides as (select s_suppkey as slide_id, concat('TCGA-', cast(s_suppkey as varchar(9)), case when s_suppkey % 2 = 0 then '-01Z-00-dx1' else '-01A-TS1' end) as barcode,
 case when s_suppkey % 3 = 0 then null else '0.25' end as mpp_x, case when s_suppkey % 5 = 0 then null else '0.5' end as aperio_mpp from {supplier})"""


@R.add("is_diagnostic_slide", "with " + SLIDES.format(supplier="supplier") + " select slide_id, barcode, contains(upper(barcode), '-DX') as diagnostic from slides")
def is_diagnostic_slide(t: Tables):
    slides = t.spark.sql("with " + SLIDES + " select * from slides", supplier=t.read("supplier"))
    return slides.select("slide_id", "barcode", S.is_diagnostic_slide("barcode").alias("diagnostic"))


@R.add("slide_resolution", "with " + SLIDES.format(supplier="supplier") + """ select slide_id, cast(coalesce(mpp_x, aperio_mpp) as double) as mpp, coalesce(mpp_x, aperio_mpp) is not null as usable,
 cast(round_even(10.0e0/cast(coalesce(mpp_x, aperio_mpp) as double),0) as int) as magnification, cast(round_even(112.0e0/cast(coalesce(mpp_x, aperio_mpp) as double),0) as int) as native_patch_px from slides""")
def slide_resolution(t: Tables):
    slides = t.spark.sql("with " + SLIDES + " select * from slides", supplier=t.read("supplier"))
    return S.slide_resolution(slides, ["mpp_x", "aperio_mpp"]).drop("barcode", "mpp_x", "aperio_mpp")


# a 30 x 30 raster per image: a pixel is tissue when any cell lies in it
MASK_SQL = """, occ as (select distinct image_id as slide_id, cast(floor(xi/1000.0e0) as int) as mx, cast(floor(yi/1000.0e0) as int) as my from cells),
 grid as (select i.slide_id, cast(gx.x as int) as mx, cast(gy.y as int) as my from (select distinct image_id as slide_id from cells) i, (select unnest(range(30)) as x) gx, (select unnest(range(30)) as y) gy),
 mask as (select g.slide_id, g.mx, g.my, case when o.mx is null then 0 else 1 end as tissue from grid g left join occ o on g.slide_id=o.slide_id and g.mx=o.mx and g.my=o.my)"""


def occupied(t: Tables):
    return t.cells().selectExpr(
        "image_id as slide_id", "cast(floor(xi/1000.0) as int) as mx", "cast(floor(yi/1000.0) as int) as my"
    ).distinct()


def tissue_mask(t: Tables):
    occ = occupied(t).withColumn("tissue", F.lit(1))
    thirty = F.lit(list(range(30)))
    grid = t.cells().select(F.col("image_id").alias("slide_id")).distinct()
    grid = grid.withColumn("mx", F.explode(thirty)).withColumn("my", F.explode(thirty))
    # no broadcast: the size estimate of rows derived from all cells is too low by far
    return grid.join(occ.hint("merge"), ["slide_id", "mx", "my"], "left").select("slide_id", "mx", "my", F.coalesce("tissue", F.lit(0)).alias("tissue"))


@R.add("tile_candidates", with_tables("cells") + MASK_SQL + """, tiles as (select s.slide_id, cast(a.x as int) as x0, cast(b.y as int) as y0 from (select distinct slide_id from grid) s, (select unnest(range(0, 960-224+1, 112)) as x) a, (select unnest(range(0, 960-224+1, 112)) as y) b)
 select t.slide_id, t.x0, t.y0, round(avg(m.tissue),6) as tissue_frac from tiles t join mask m on t.slide_id=m.slide_id
  and m.mx >= floor(t.x0*(30/960.0e0)) and m.mx < floor((t.x0+224)*(30/960.0e0)) and m.my >= floor(t.y0*(30/960.0e0)) and m.my < floor((t.y0+224)*(30/960.0e0))
 group by 1,2,3 having avg(m.tissue) >= 0.4""")
def tile_candidates(t: Tables):
    slides = t.cells().select(F.col("image_id").alias("slide_id")).distinct().selectExpr("slide_id", "960 as w", "960 as h", "30 as mask_w", "30 as mask_h")
    return rounded(S.tile_candidates(slides, tissue_mask(t), 224, 112), "tissue_frac")


# cells drawn 2 raster pixels to the right and 1 up of the tissue they belong to
DENSITY_SQL = """, dens as (select image_id as slide_id, greatest(0, least(29, cast(floor((yi - 1000)/1000.0e0) as int))) as row_, greatest(0, least(29, cast(floor((xi + 2000)/1000.0e0) as int))) as col_, count(*)*1.0e0 as value from cells group by 1,2,3)"""


def density(t: Tables):
    cells = t.cells().selectExpr("image_id as slide_id", "xi + 2000 as x_px", "yi - 1000 as y_px", "30 as w", "30 as h")
    return S.cell_density(cells, 1000.0)


def tissue_rows(t: Tables):
    return occupied(t).select("slide_id", F.col("my").alias("row"), F.col("mx").alias("col"), F.lit(1.0).alias("value"))


@R.add("offset_xcorr", with_tables("cells") + MASK_SQL + DENSITY_SQL + """, offs as (select cast(a.d as int) as dy, cast(b.d as int) as dx from (select unnest(range(-3,4)) as d) a, (select unnest(range(-3,4)) as d) b)
 select d.slide_id, dy, dx, round(sum(value),4) as corr from dens d cross join offs join occ o on d.slide_id=o.slide_id and (d.row_+dy+30)%30 = o.my and (d.col_+dx+30)%30 = o.mx group by 1,2,3""")
def offset_xcorr(t: Tables):
    return rounded(S.offset_xcorr(tissue_rows(t), density(t), 3), "corr", places=4)


@R.add("registration_residual", with_tables("cells") + MASK_SQL + DENSITY_SQL + """, offs as (select cast(a.d as int) as dy, cast(b.d as int) as dx from (select unnest(range(-14,16)) as d) a, (select unnest(range(-14,16)) as d) b),
 x as (select d.slide_id, dy, dx, sum(value) as corr from dens d cross join offs join occ o on d.slide_id=o.slide_id and (d.row_+dy+30)%30 = o.my and (d.col_+dx+30)%30 = o.mx group by 1,2,3),
 r as (select *, row_number() over (partition by slide_id order by corr desc, dx*dx+dy*dy, dy, dx) rn from x)
 select slide_id, dx, dy, round(case when dx=0 and dy=0 then 10 else sqrt(dx*dx+dy*dy)*10 end,6) as residual_um, dx=0 and dy=0 as is_bound, case when (dx=0 and dy=0) or sqrt(dx*dx+dy*dy)*10 > 5 then 'FAIL' else 'PASS' end as verdict from r where rn=1""")
def registration_residual(t: Tables):
    return rounded(S.full_frame_residual(tissue_rows(t), density(t), 10.0), "residual_um")


@R.add("gaussian_blur", with_tables("cells") + DENSITY_SQL + """, k as (select cast(o as int) as o, exp(-o*o/8.0e0)/(select sum(exp(-o*o/8.0e0)) from (select unnest(range(-8,9)) as o)) as k from (select unnest(range(-8,9)) as o)),
 px as (select s.slide_id, a.y, b.x from (select distinct slide_id from dens) s, (select unnest(range(30)) as y) a, (select unnest(range(30)) as x) b),
 full_ as (select px.slide_id, px.y, px.x, coalesce(d.value,0) as v from px left join dens d on px.slide_id=d.slide_id and px.y=d.row_ and px.x=d.col_),
 bx as (select f.slide_id, f.y, t.x, sum(f.v*k.k) as v from (select unnest(range(30)) as x) t cross join k join full_ f on f.x = case when t.x+k.o < 0 then -(t.x+k.o) when t.x+k.o > 29 then 58-(t.x+k.o) else t.x+k.o end group by 1,2,3),
 byy as (select f.slide_id, t.y, f.x, sum(f.v*k.k) as v from (select unnest(range(30)) as y) t cross join k join bx f on f.y = case when t.y+k.o < 0 then -(t.y+k.o) when t.y+k.o > 29 then 58-(t.y+k.o) else t.y+k.o end group by 1,2,3)
 select slide_id, count(*) as n, round(sum(v),4) as total, round(sum(v*v),4) as energy, round(sum(v*y),4) as my, round(max(v),5) as peak from byy where v > 1e-12 group by 1""")
def gaussian_blur(t: Tables):
    v = F.col("value")
    out = S.gaussian_blur(density(t)).filter(v > 1e-12).groupBy("slide_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(v).alias("total"), F.sum(v * v).alias("energy"), F.sum(v * F.col("row")).alias("my"), F.max(v).alias("peak")
    )
    return rounded(rounded(out, "total", "energy", "my", places=4), "peak", places=5)


@R.add("on_tissue_fraction", with_tables("cells") + MASK_SQL + DENSITY_SQL + """ select d.slide_id, round(sum(case when o.mx is null then 0 else value end)/sum(value),6) as on_tissue from dens d left join occ o on d.slide_id=o.slide_id and d.row_=o.my and d.col_=o.mx group by 1""")
def on_tissue_fraction(t: Tables):
    return rounded(S.on_tissue_fraction(density(t), tissue_rows(t)), "on_tissue")


@R.add("largest_images", with_tables("cells") + " select image_id, count(*) as n from cells group by 1 order by n desc, image_id limit 5")
def largest_images(t: Tables):
    return S.largest_groups(t.cells(), "image_id", 5)


# ---- lattice

LAT = with_tables("lattice")


def placed(t: Tables):
    return G.to_lattice(t.lattice().select("slide_id", "patch_id", "label", "x_um", "y_um", "embedding"), 112.0)


@R.add("to_lattice", LAT + " select slide_id, patch_id, row_ as row, cast(col_ as bigint) as col from lattice")
def to_lattice(t: Tables):
    return placed(t).select("slide_id", "patch_id", "row", "col")


@R.add("infer_stride", with_tables("habitat_patches") + """, nn as (select l.sample_id as slide_id, l.patch_id, sqrt(min((l.x_um-r.x_um)*(l.x_um-r.x_um)+(l.y_um-r.y_um)*(l.y_um-r.y_um))) as d from habitat_patches l join habitat_patches r on l.sample_id=r.sample_id and l.patch_id<>r.patch_id group by 1,2),
 p as (select * from nn where d > 0), e as (select slide_id, min(d) lo, max(d) hi from p group by 1),
 h as (select p.slide_id, lo, (hi-lo)/50 as w, least(49, cast(floor((d-lo)/((hi-lo)/50)) as int)) as bin, count(*) n from p join e on p.slide_id=e.slide_id group by 1,2,3,4),
 r as (select *, row_number() over (partition by slide_id order by n desc, bin) rn from h) select slide_id, round(lo+(bin+0.5e0)*w,6) as stride_um from r where rn=1""")
def infer_stride(t: Tables):
    return rounded(G.infer_stride(t.stored("habitat_patches").withColumnRenamed("sample_id", "slide_id")), "stride_um")


COARSE = with_tables("habitat_patches") + """, o as (select sample_id, min(x_um) x0, min(y_um) y0 from habitat_patches group by 1),
 rc as (select p.sample_id as slide_id, p.patch_id, cast(round_even((p.y_um-o.y0)/112.0e0,0) as bigint) as row_, cast(round_even((p.x_um-o.x0)/112.0e0,0) as bigint) as col_ from habitat_patches p join o on p.sample_id=o.sample_id)"""


def coarse(t: Tables):
    return G.to_lattice(t.habitat_patches().withColumnRenamed("sample_id", "slide_id"), 112.0)


@R.add("lattice_stats", COARSE + """, s as (select slide_id, row_, col_, count(*) n from rc group by 1,2,3)
 select slide_id, max(row_)+1 as height, max(col_)+1 as width, count(*) as occupied, round(count(*)*1.0e0/((max(row_)+1)*(max(col_)+1)),6) as occupancy, cast(sum(n)-count(*) as bigint) as collisions from s group by 1""")
def lattice_stats(t: Tables):
    return rounded(G.lattice_stats(coarse(t)), "occupancy")


@R.add("lattice_window_join", COARSE + """, bank as (select slide_id, row_, col_, max(patch_id) as nbr_id from rc group by 1,2,3),
 w as (select rc.slide_id, rc.patch_id, cast(a.d as int) as dr, cast(b.d as int) as dc, row_+a.d as r, col_+b.d as c from rc, (select unnest([-1,0,1]) as d) a, (select unnest([-1,0,1]) as d) b)
 select w.slide_id, w.patch_id, w.dr, w.dc, bank.nbr_id, bank.nbr_id is not null as valid from w left join bank on w.slide_id=bank.slide_id and w.r=bank.row_ and w.c=bank.col_""")
def lattice_window_join(t: Tables):
    return G.lattice_window_join(coarse(t), 3)


POOL_SQL = LAT + """, l as (select slide_id, patch_id, row_, col_, embedding::double[] as v from lattice),
 x as (select l.*, i, v[i] as e, s.s as scale from l, (select unnest(range(1,65)) as i), (select unnest([0,1,2]) as s) s),
 pool as (select slide_id, cast(scale as int) as scale, cast(floor(row_/pow(2.0e0,scale)) as bigint) as row, cast(floor(col_/pow(2.0e0,scale)) as bigint) as col, i, count(*) as n, avg(e) as value from x group by 1,2,3,4,5)"""


@R.add("pyramid_pool", POOL_SQL + " select slide_id, scale, row, col, n, cast(i-1 as int) as dim, round(value,5) as value from pool")
def pyramid_pool(t: Tables):
    out = G.pyramid_pool(placed(t), 3).select("slide_id", "scale", "row", "col", "n", F.posexplode("embedding").alias("dim", "value"))
    return rounded(out, "value", places=5)


@R.add("scale_window_join", POOL_SQL + """, big as (select slide_id, count(*) >= 3 as big from lattice group by 1),
 w as (select l.slide_id, l.patch_id, cast(s.s as int) as scale, cast(a.d as int) as dr, cast(b.d as int) as dc, cast(floor(row_/pow(2.0e0,s.s)) as bigint)+a.d as r, cast(floor(col_/pow(2.0e0,s.s)) as bigint)+b.d as c
  from l join big on l.slide_id=big.slide_id, (select unnest([0,1,2]) as s) s, (select unnest([-1,0,1]) as d) a, (select unnest([-1,0,1]) as d) b where big or (a.d=0 and b.d=0))
 select w.slide_id, w.patch_id, w.scale, w.dr, w.dc, i.i, round(p.value,5) as value, p.value is not null as valid from w, (select unnest([1, 2, 33, 64]) as i) i left join pool p on w.slide_id=p.slide_id and w.scale=p.scale and w.r=p.row and w.c=p.col and p.i = i.i""")
def scale_window_join(t: Tables):
    p = placed(t)
    out = G.scale_window_join(p, G.pyramid_pool(p, 3), 3, 3)
    out = out.withColumn("i", F.explode(F.array(*[F.lit(i) for i in (1, 2, 33, 64)])))
    return out.select("slide_id", "patch_id", "scale", "dr", "dc", "i", F.round(F.get("embedding", F.col("i") - 1), 5).alias("value"), "valid")


LINKS = LAT + """, l as (select slide_id, patch_id, x_um, y_um, embedding::double[] as v from lattice),
 r as (select a.slide_id, a.patch_id, b.patch_id as nbr_id, a.v, b.v as nv, sqrt((a.x_um-b.x_um)*(a.x_um-b.x_um)+(a.y_um-b.y_um)*(a.y_um-b.y_um)) as dist,
   row_number() over (partition by a.patch_id order by (a.x_um-b.x_um)*(a.x_um-b.x_um)+(a.y_um-b.y_um)*(a.y_um-b.y_um), b.patch_id) as rank
  from l a join l b on a.slide_id=b.slide_id and a.patch_id<>b.patch_id),
 links as (select * from r where rank <= 6 and dist <= 130)"""


def links(t: Tables):
    return G.neighbours(t.stored("lattice"), 6, 130.0)


@R.add("radius_capped_knn", LINKS + " select slide_id, patch_id, nbr_id, cast(rank as int) as rank, round(dist,6) as dist from links")
def radius_capped_knn(t: Tables):
    return rounded(links(t).select("slide_id", "patch_id", "nbr_id", "rank", "dist"), "dist")


@R.add("deepset_pool", LINKS + """, e as (select slide_id, patch_id, i, nv[i] as x from links, (select unnest(range(1,65)) as i)), p as (select slide_id, patch_id, i, avg(x) m, max(x) mx from e group by 1,2,3)
 select l.slide_id, l.patch_id, cast(g.i-1 as int) as dim, round(coalesce(p.m,0),5) as mean, round(coalesce(p.mx,0),5) as max from l cross join (select unnest(range(1,65)) as i) g left join p on l.patch_id=p.patch_id and g.i=p.i""")
def deepset_pool(t: Tables):
    pooled = G.deepset_pool(t.lattice(), links(t), 64)
    out = pooled.select("slide_id", "patch_id", F.posexplode(F.arrays_zip("mean", "max")).alias("dim", "z")).select("slide_id", "patch_id", "dim", "z.mean", "z.max")
    return rounded(out, "mean", "max", places=5)


ATT = LINKS + """, lg as (select *, list_dot_product(v,nv)/8.0e0 - ln(1+dist/100.0e0) as z from links), s as (select *, exp(z - max(z) over (partition by patch_id)) as e from lg),
 w as (select *, e/sum(e) over (partition by patch_id) as weight from s)"""


@R.add("attention_map", ATT + " select slide_id, patch_id, nbr_id, round(weight,6) as weight from w")
def attention_map(t: Tables):
    return rounded(G.attention_map(links(t), 64).select("slide_id", "patch_id", "nbr_id", "weight"), "weight")


@R.add("distance_attention", ATT + """, e as (select slide_id, patch_id, i, sum(weight*nv[i]) as x from w, (select unnest(range(1,65)) as i) group by 1,2,3)
 select l.slide_id, l.patch_id, cast(g.i-1 as int) as dim, round(coalesce(e.x,0),5) as context from l cross join (select unnest(range(1,65)) as i) g left join e on l.patch_id=e.patch_id and g.i=e.i""")
def distance_attention(t: Tables):
    out = G.distance_attention(t.lattice(), links(t), 64)
    return rounded(out.select("slide_id", "patch_id", F.posexplode("context").alias("dim", "context")), "context", places=5)


ATT_HEAD = LINKS + """, h as (select *, [list_sum([v[i+1]*((7*o+3*i)%11-5)/50.0e0 for i in range(64)]) + o/10.0e0 for o in range(4)] as qv, [list_sum([nv[i+1]*((5*o+2*i)%13-6)/50.0e0 for i in range(64)]) + o/10.0e0 for o in range(4)] as kv, [list_sum([nv[i+1]*((3*o+5*i)%7-3)/10.0e0 for i in range(64)]) + o/10.0e0 for o in range(4)] as vv from links),
 lg as (select *, list_dot_product(qv, kv)/2.0e0 - ln(1+dist/100.0e0) as z from h), s as (select *, exp(z - max(z) over (partition by patch_id)) as e from lg),
 w as (select *, e/sum(e) over (partition by patch_id) as weight from s), x as (select slide_id, patch_id, o, sum(weight*vv[o+1]) as x from w, (select unnest(range(4)) as o) group by 1,2,3)
 select l.slide_id, l.patch_id, cast(g.o as int) as dim, round(coalesce(x.x,0),5) as context from l cross join (select unnest(range(4)) as o) g left join x on l.patch_id=x.patch_id and g.o=x.o"""


def head(a: int, b: int, m: int, c: int, d: float):
    """A layer from 64 to 4 numbers; the SQL spells out the same rule."""
    o, i = np.arange(4)[:, None], np.arange(64)[None, :]
    return ((a * o + b * i) % m - c) / d, np.arange(4) / 10


@R.add("weighted_attention", ATT_HEAD)
def weighted_attention(t: Tables):
    """Query, key and value layers given; patches without neighbours hold zeros."""
    weights = G.AttentionWeights(head(7, 3, 11, 5, 50.0), head(5, 2, 13, 6, 50.0), head(3, 5, 7, 3, 10.0))
    out = G.distance_attention(t.lattice(), links(t), 64, weights=weights)
    return rounded(out.select("slide_id", "patch_id", F.posexplode("context").alias("dim", "context")), "context", places=5)


@R.add("grid_context_vector", POOL_SQL + """, w as (select l.slide_id, l.patch_id, s.s as scale, a.d as dr, b.d as dc, cast(floor(row_/pow(2.0e0,s.s)) as bigint)+a.d as r, cast(floor(col_/pow(2.0e0,s.s)) as bigint)+b.d as c
  from l, (select unnest([0,1,2]) as s) s, (select unnest([-1,0,1]) as d) a, (select unnest([-1,0,1]) as d) b),
 f as (select w.*, p.i, p.value from w join pool p on w.slide_id=p.slide_id and w.scale=p.scale and w.r=p.row and w.c=p.col),
 m as (select slide_id, patch_id, i, avg(value) as m, count(*) as n_valid from f group by 1,2,3),
 tot as (select slide_id, patch_id, sum(value) as total from f group by 1,2)
 select m.slide_id, m.patch_id, m.n_valid, round(sum(m.m),4) as mean_sum, round(max(t.total),4) as window_sum, cast(27 as int) as slots, cast(27*64 as int) as width from m join tot t on m.patch_id=t.patch_id group by m.slide_id, m.patch_id, m.n_valid""")
def grid_context_vector(t: Tables):
    from histomesh.functions.vectors import vsum

    p = placed(t)
    out = G.grid_context_vector(G.scale_window_join(p, G.pyramid_pool(p, 3), 3, 3), 64)
    return rounded(
        out.select("slide_id", "patch_id", "n_valid", vsum("mean").alias("mean_sum"), vsum("window").alias("window_sum"), F.size("mask").alias("slots"), F.size("window").alias("width")),
        "mean_sum", "window_sum", places=4,
    )
