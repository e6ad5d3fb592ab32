"""Queries over cell tables: preparation, radius joins, composition."""

from pyspark.sql import functions as F

from histomesh.checks.fixtures import Registry, Tables, rounded, with_tables
from histomesh.operators import barrier as B
from histomesh.operators import cells as C
from histomesh.operators import composition as K
from histomesh.operators.spatial import knn_join, radius_pairs

R = Registry()
LINEAGE_OF_TYPE = "element_at(array('tumour','t_cell','b_cell','macrophage','vascular','stroma_sma','other_immune','other'), type_id + 1)"
LINEAGE_CASE = ("case type_id when 0 then 'tumour' when 1 then 't_cell' when 2 then 'b_cell' when 3 then 'macrophage' "
                "when 4 then 'vascular' when 5 then 'stroma_sma' when 6 then 'other_immune' else 'other' end")
TYPES = list(range(8))
WIDE = [f"n_{t}" for t in TYPES]

# type names of the raw table, some of them artefacts or outside the mapping
RAW_TYPE = ("case when q % 25 = 0 then 'dirt' when q % 13 = 0 then 'unlisted' when type_id = 0 then 'tumor cells' when type_id = 1 then 'CD8+ T cells' "
            "when type_id = 2 then 'B cells' when type_id = 3 then 'CD163+ macrophages' when type_id = 4 then 'vasculature' "
            "when type_id = 5 then 'stroma' when type_id = 6 then 'granulocytes' else 'nerves' end")


@R.add("scale_coords", with_tables("cells") + """
 select cell_id, image_id, round(xi*0.37744e0, 6) as x_um, round(yi*0.37744e0, 6) as y_um, cast(297 as int) as patch_px from cells""")
def scale_coords(t: Tables):
    px = t.cells().select("cell_id", "image_id", F.col("xi").alias("x_px"), F.col("yi").alias("y_px"))
    out = C.scale_coords(px, 0.37744).withColumn("patch_px", C.native_patch_px(F.lit(0.37744)))
    return rounded(out.drop("x_px", "y_px"), "x_um", "y_um")


@R.add("drop_artefacts", with_tables("cells") + f""", raw as (select image_id, cell_id as src_id, {RAW_TYPE} as cell_type from cells)
 select image_id, src_id, cell_type, cast(row_number() over (order by image_id, src_id) - 1 as bigint) as cell_id from raw where cell_type <> 'dirt'""")
def drop_artefacts(t: Tables):
    raw = t.cells().select("image_id", F.col("cell_id").alias("src_id"), F.expr(RAW_TYPE).alias("cell_type"))
    return C.drop_artefacts(raw, ["image_id", "src_id"])


@R.add("validate_cells", with_tables("cells") + """
 select cast(count(*) as bigint) as n_cells, count(distinct image_id) as n_images,
  cast(count(*) - count(distinct image_id * 100000000 + cell_id) as bigint) as n_duplicate_keys,
  greatest(max(x_um)-min(x_um), max(y_um)-min(y_um)) as span_um, 'ok' as verdict from cells""")
def validate_cells(t: Tables):
    return C.validation_report(t.cells())


@R.add("min_cells_filter", with_tables("cells") + """
 select cell_id, image_id from cells where image_id in (select image_id from cells group by 1 having count(*) >= 455)""")
def min_cells_filter(t: Tables):
    return C.min_cells_filter(t.cells(), 455).select("cell_id", "image_id")


@R.add("vocabulary_check", with_tables("cells") + f""", raw as (select {RAW_TYPE} as cell_type from cells)
 select cell_type, count(*) as n from raw where cell_type in ('dirt', 'unlisted') group by 1""")
def vocabulary_check(t: Tables):
    raw = t.cells().select(F.expr(RAW_TYPE).alias("cell_type"))
    return C.unknown_types(raw, sum(C.PHENOTYPES_BY_LINEAGE.values(), []))


@R.add("map_lineage", with_tables("cells") + f""", raw as (select cell_id, type_id, {RAW_TYPE} as cell_type from cells)
 select cell_id, cell_type, case when cell_type in ('dirt','unlisted') then 'other' else {LINEAGE_CASE} end as lineage,
  cell_type not in ('dirt','unlisted') as mapped from raw""")
def map_lineage(t: Tables):
    return C.map_lineage(t.cells().select("cell_id", F.expr(RAW_TYPE).alias("cell_type")))


@R.add("unmapped_report", with_tables("cells") + f""", raw as (select {RAW_TYPE} as cell_type from cells)
 select cell_type, count(*) as n from raw where cell_type in ('dirt','unlisted') group by 1""")
def unmapped_report(t: Tables):
    return C.unmapped_report(t.cells().select(F.expr(RAW_TYPE).alias("cell_type")))


MARKER_COLUMNS = ["panck", "ecad", "cd3e", "cd20", "cd68", "cd163", "cd31", "sma", "cd45"]
OTSU_SQL = with_tables("cells", "markers") + """, long as (""" + " union all ".join(
    f"select cell_id, '{m}' as marker, {m} as x from markers" for m in MARKER_COLUMNS
) + """), v as (select marker, ln(1 + greatest(x, 0)) as v from long),
 e as (select marker, min(v) lo, max(v) hi from v group by 1),
 h as (select v.marker, lo, hi, cast(floor((v - lo)/(hi - lo + 1e-9)*255) as int) as bin, count(*) n from v join e on v.marker = e.marker group by 1,2,3,4),
 c as (select *, sum(n) over (partition by marker order by bin) w0, sum(n*bin) over (partition by marker order by bin) m0,
   sum(n) over (partition by marker) w, sum(n*bin) over (partition by marker) m from h),
 b as (select *, case when w > w0 then (w0*1.0e0)*(w-w0)*(m0/(w0*1.0e0) - (m-m0)/((w-w0)*1.0e0))*(m0/(w0*1.0e0) - (m-m0)/((w-w0)*1.0e0)) else 0 end as vb from c),
 t as (select marker, lo, hi, bin, row_number() over (partition by marker order by vb desc, bin) rn from b),
 otsu as (select marker, bin, exp(bin/255.0e0*(hi-lo)+lo) - 1 as threshold from t where rn = 1)"""


@R.add("otsu_threshold", OTSU_SQL + " select marker, bin, round(threshold, 4) as threshold from otsu")
def otsu_threshold(t: Tables):
    return rounded(C.otsu_thresholds(t.markers(), MARKER_COLUMNS), "threshold", places=4)


@R.add("gate_lineages", OTSU_SQL + """, th as (select """ + ", ".join(
    f"max(case when marker='{m}' then threshold end) as t_{m}" for m in MARKER_COLUMNS) + """ from otsu)
 select cell_id, case when panck >= t_panck or ecad >= t_ecad then 'tumour'
  when cd45 >= t_cd45 and cd3e >= t_cd3e then 't_cell' when cd45 >= t_cd45 and cd20 >= t_cd20 then 'b_cell'
  when cd45 >= t_cd45 and (cd68 >= t_cd68 or cd163 >= t_cd163) then 'macrophage'
  when cd45 < t_cd45 and cd31 >= t_cd31 then 'vascular' when cd45 < t_cd45 and sma >= t_sma then 'stroma_sma'
  when cd45 >= t_cd45 then 'other_immune' else 'other' end as lineage from markers, th""")
def gate_lineages(t: Tables):
    return C.gate_by_otsu(t.markers(), MARKER_COLUMNS).select("cell_id", "lineage")


PAIRS = """, pairs as (select l.image_id, l.cell_id, l.type_id, r.cell_id as nbr_id, r.type_id as nbr_type,
  (l.x_um-r.x_um)*(l.x_um-r.x_um)+(l.y_um-r.y_um)*(l.y_um-r.y_um) as d2
  from cells l join cells r on l.image_id = r.image_id and (l.x_um-r.x_um)*(l.x_um-r.x_um)+(l.y_um-r.y_um)*(l.y_um-r.y_um) <= {r2})"""


@R.add("radius_join", with_tables("cells") + PAIRS.format(r2=400) +
       " select image_id, cell_id, nbr_id, round(d2, 6) as d2 from pairs")
def radius_join(t: Tables):
    pairs = radius_pairs(t.cells(), ["image_id"], "cell_id", 20.0)
    return rounded(pairs.select("image_id", "cell_id", "nbr_id", "d2"), "d2")


@R.add("radius_pairs", with_tables("cells") + PAIRS.format(r2=400) +
       " select image_id, cell_id, nbr_id, round(sqrt(d2), 6) as dist from pairs where cell_id < nbr_id")
def unordered_pairs(t: Tables):
    pairs = radius_pairs(t.cells(), ["image_id"], "cell_id", 20.0, unordered=True)
    return rounded(pairs.select("image_id", "cell_id", "nbr_id", F.sqrt("d2").alias("dist")), "dist")


def neighbour_right(cells):
    return cells.select("image_id", F.col("cell_id").alias("nbr_id"), F.col("x_um").alias("nx"), F.col("y_um").alias("ny"))


@R.add("knn_join", with_tables("cells") + """, r as (select l.image_id, l.cell_id, r.cell_id as nbr_id,
  (l.x_um-r.x_um)*(l.x_um-r.x_um)+(l.y_um-r.y_um)*(l.y_um-r.y_um) as d2,
  row_number() over (partition by l.cell_id order by (l.x_um-r.x_um)*(l.x_um-r.x_um)+(l.y_um-r.y_um)*(l.y_um-r.y_um), r.cell_id) as rank
  from cells l join cells r on l.image_id = r.image_id and l.cell_id <> r.cell_id)
 select image_id, cell_id, nbr_id, cast(rank as int) as rank, round(sqrt(d2), 6) as dist from r where rank <= 6""")
def knn(t: Tables):
    cells = t.stored("cells").select("image_id", "cell_id", "x_um", "y_um")
    out = knn_join(cells, neighbour_right(cells), ["image_id"], 6, "cell_id", "nbr_id", ("x_um", "y_um"), ("nx", "ny"), exclude_self=True)
    return rounded(out.select("image_id", "cell_id", "nbr_id", "rank", F.sqrt("d2").alias("dist")), "dist")


@R.add("composition_counts", with_tables("cells") + PAIRS.format(r2=1600) +
       " select image_id, cell_id, nbr_type as type_id, count(*) as n from pairs group by 1,2,3")
def composition_counts(t: Tables):
    return K.composition_counts(t.cells(), 40.0, type_col="type_id")


MATRIX = with_tables("cells", "cns") + PAIRS.format(r2=1600) + """, matrix as (select image_id, cell_id, """ + ", ".join(
    f"cast(sum(case when nbr_type={i} then 1 else 0 end) as bigint) as n_{i}" for i in TYPES) + " from pairs group by 1,2)"


@R.add("composition_matrix", MATRIX + " select * from matrix")
def composition_matrix(t: Tables):
    return K.composition_matrix(t.cells(), TYPES, 40.0, type_col="type_id")


@R.add("neighbourhood_size", MATRIX + f""", s as (select {'+'.join(WIDE)} as size from matrix)
 select quantile_cont(size, 0.5) as median_size, round(avg(size), 6) as mean_size, count(*) as n_cells,
  quantile_cont(size, 0.5) between 10 and 62.5 as within_expected from s""")
def neighbourhood_size(t: Tables):
    return rounded(K.neighbourhood_size_qc(K.composition_matrix(t.cells(), TYPES, 40.0, type_col="type_id"), WIDE), "mean_size")


PROFILE = MATRIX + f""", f as (select c.cn, """ + ", ".join(
    f"m.n_{i}*1.0e0/greatest({'+'.join('m.' + w for w in WIDE)},1) as n_{i}" for i in TYPES
) + """ from matrix m join cns c on m.cell_id = c.cell_id),
 profile as (""" + " union all ".join(f"select cn, 'n_{i}' as type, avg(n_{i}) as mean_frac from f group by cn" for i in TYPES) + ")"


def labelled_matrix(t: Tables):
    matrix = K.composition_matrix(t.cells(), TYPES, 40.0, type_col="type_id")
    return matrix.join(t.cns().select("cell_id", "cn"), "cell_id")


@R.add("cn_centroids", PROFILE + " select cn, type, round(mean_frac, 6) as mean_frac from profile")
def cn_centroids(t: Tables):
    return rounded(K.mean_profiles(labelled_matrix(t), "cn", WIDE), "mean_frac")


@R.add("cn_enrichment", PROFILE + """ select cn, type, round(mean_frac, 6) as mean_frac,
 round((mean_frac - avg(mean_frac) over (partition by type)) / stddev_samp(mean_frac) over (partition by type), 5) as z from profile""")
def cn_enrichment(t: Tables):
    out = K.cn_enrichment(labelled_matrix(t), "cn", WIDE)
    return rounded(rounded(out, "mean_frac"), "z", places=5)


@R.add("cn_definitions", PROFILE + """, z as (select cn, type, (mean_frac - avg(mean_frac) over (partition by type)) / stddev_samp(mean_frac) over (partition by type) as z from profile),
 r as (select *, row_number() over (partition by cn order by z desc, type) rn from z),
 fr as (select cn, count(*) n, round(100.0e0*count(*)/sum(count(*)) over (), 1) as frequency_pct from cns group by 1)
 select r.cn, string_agg(printf('%s (%+.1f)', type, z), ', ' order by rn) as top_types, fr.n, fr.frequency_pct from r join fr on r.cn = fr.cn where rn <= 3 group by r.cn, fr.n, fr.frequency_pct""")
def cn_definitions(t: Tables):
    return K.cn_definitions(K.cn_enrichment(labelled_matrix(t), "cn", WIDE), t.cns(), "cn")


@R.add("cn_frequency", with_tables("cells", "cns") + " select cn, count(*) as n, round(100.0e0*count(*)/sum(count(*)) over (), 1) as frequency_pct from cns group by 1")
def cn_frequency(t: Tables):
    return K.class_frequency(t.cns(), "cn")


@R.add("composition_per_image", with_tables("cells", "cns") + """, w as (select image_id, """ + ", ".join(
    f"count(*) filter (where cn={i})*1.0e0/count(*) as frac_{i}" for i in range(10)) + """ from cns group by 1),
 g as (select *, greatest(""" + ",".join(f"frac_{i}" for i in range(10)) + """) as top from w)
 select image_id, """ + ", ".join(f"round(frac_{i},6) as frac_{i}" for i in range(10)) + ", cast(case " + " ".join(
    f"when frac_{i} = top then {i}" for i in range(10)) + " end as int) as dominant, round(top, 6) as dominant_frac from g")
def composition_per_image(t: Tables):
    out = K.composition_per_image(t.cns(), list(range(10)), "cn")
    return rounded(out, *[f"frac_{i}" for i in range(10)], "dominant_frac")


@R.add("barrier_score", (with_tables("cells") + """, v as (select image_id, cell_id, type_id, x_um, y_um from cells where type_id in (0, 1, 5)),
 n as (select l.image_id, l.cell_id as a, r.cell_id as b, row_number() over (partition by l.cell_id order by (l.x_um-r.x_um)*(l.x_um-r.x_um)+(l.y_um-r.y_um)*(l.y_um-r.y_um), r.cell_id) rn
   from v l join v r on l.image_id = r.image_id and l.cell_id <> r.cell_id),
 e as (select a, b from n where rn <= 8 union select b, a from n where rn <= 8),
 w as (select cell_id as node, 0 as hops, 0 as caf, 0 as own from v where type_id = 0
   union select e.b, w.hops + 1, w.caf + w.own, cast(v.type_id = 5 as int) from w join e on e.a = w.node join v on v.cell_id = e.b where w.hops < 40),
 h as (select node, min(hops) as hops from w group by 1), p as (select w.node, w.hops, min(w.caf) as caf from w join h on h.node = w.node and h.hops = w.hops group by 1, 2),
 i as (select v.image_id, p.hops, p.caf from v left join p on p.node = v.cell_id where v.type_id = 1),
 s as (select image_id, count(*) as n_immune, count(*) filter (where hops = 1) as n_adjacent, count(*) filter (where hops is null) as n_unreached, count(*) filter (where hops >= 2) as n_scored,
   count(*) filter (where hops >= 2 and caf > 0) as n_positive from i group by 1)
 select *, case when n_scored > 0 then round(n_positive * 1.0e0 / n_scored, 6) end as score from s""").replace("with ", "with recursive ", 1))
def barrier_score(t: Tables):
    """Immune cells behind stroma, on the graph of tumour, immune and stroma cells."""
    return rounded(B.barrier_score(t.stored("cells"), 1, 0, 5, kind="type_id"), "score")
