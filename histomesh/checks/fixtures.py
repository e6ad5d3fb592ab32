"""Spatial tables derived from the given parquet tables, in Spark and as SQL text.

The SQL strings use only integer arithmetic and IEEE division, so Spark and a SQL engine that
checks the results build the same rows from the same text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from histomesh.session import durable

CELLS = """
select cell_id, image_id, xi, yi, xi/100.0e0 as x_um, yi/100.0e0 as y_um, q, pk,
  cast((cast(floor(xi/6000.0e0) as bigint) + 2*cast(floor(yi/6000.0e0) as bigint) + case when q < 36 then 0 else q end) % 8 as int) as type_id
from (select l_orderkey*10 + l_linenumber as cell_id, max(l_suppkey) as image_id, max(cast(l_quantity as bigint)) as q, max(l_partkey) as pk,
  (max(l_partkey)*7919 + l_orderkey*104729 + l_linenumber*611953) % 30000 as xi,
  (max(l_partkey)*15485863 + l_orderkey*32452843 + l_linenumber*49979687) % 30000 as yi
  from {lineitem} group by l_orderkey, l_linenumber) t"""

HABITAT_PATCHES = """
select image_id as sample_id, cell_id as patch_id, xi/10.0e0 as x_um, yi/10.0e0 as y_um,
  cast((cast(floor(xi/6000.0e0) as bigint) + 2*cast(floor(yi/6000.0e0) as bigint) + case when q < 36 then 0 else q end) % 10 as int) as habitat
from {cells}"""

CNS = """
select *, cast((cast(floor(xi/5000.0e0) as bigint)*2 + cast(floor(yi/5000.0e0) as bigint)*3 + case when q < 46 then 0 else q end) % 10 as int) as cn
from {cells}"""

NUCLEI = """
select image_id as sample_id, cell_id as nucleus_id, (xi/100.0e0 + (cell_id % 17 - 8)/2.0e0)/0.325e0 as x_px,
  (yi/100.0e0 + (cell_id % 13 - 6)/2.0e0)/0.325e0 as y_px
from {cells}"""

MARKERS = """
select cell_id, image_id,
 cast((pk*37 + q*11) % 997 as double) + case when type_id=0 then 3000 else 0 end as panck,
 cast((pk*31 + q*7) % 967 as double) + case when type_id=0 and q % 3 = 0 then 2600 else 0 end as ecad,
 cast((pk*41 + q*13) % 991 as double) + case when type_id in (1,2,3,6) then 2500 else 0 end as cd45,
 cast((pk*43 + q*17) % 983 as double) + case when type_id=1 then 2000 else 0 end as cd3e,
 cast((pk*53 + q*23) % 971 as double) + case when type_id=2 then 2100 else 0 end as cd20,
 cast((pk*59 + q*29) % 953 as double) + case when type_id=3 then 2200 else 0 end as cd68,
 cast((pk*61 + q*31) % 947 as double) + case when type_id=3 and q % 2 = 0 then 2300 else 0 end as cd163,
 cast((pk*67 + q*37) % 941 as double) + case when type_id=4 then 2400 else 0 end as cd31,
 cast((pk*47 + q*19) % 977 as double) + case when type_id=5 then 2000 else 0 end as sma
from {cells}"""

LATTICE = """
select slide_id, patch_id, label, slot % 12 as col_, cast(floor(slot/12.0e0) as bigint) as row_,
  112.0e0*(slot % 12) as x_um, 112.0e0*cast(floor(slot/12.0e0) as bigint) as y_um, embedding
from (select cast(floor(vec_id/125.0e0) as bigint) as slide_id, vec_id as patch_id, label, embedding,
  vec_id % 125 + cast(floor((vec_id % 125)/9.0e0) as bigint) as slot from {embeddings}) t"""

CLINICAL = """
select c_custkey as sample_id, c_mktsegment as subtype, (c_custkey*7919 + 13) % 1500 + 1 as os_time,
  cast(case when (c_custkey*31) % 10 < 6 then 1 else 0 end as int) as os_event
from {customer}"""

LOG_LINES = """
select user_id as run_id, event_id as line_no, case event_type
 when 'signup' then concat('seed ', cast(event_id % 6 + 1 as varchar(9)), ' | 6 train / 2 val slides')
 when 'view' then concat('HabitatNet[', case event_id % 4 when 0 then 'none' when 1 then 'graph' when 2 then 'grid2d' else 'grid3d' end, ']: fused 64')
 when 'click' then concat('epoch  ', cast(event_id % 30 as varchar(9)), '  loss 0.', cast(event_id % 900 + 100 as varchar(9)), '  acc 0.5  f1 0.', cast(event_id % 800 + 100 as varchar(9)))
 when 'purchase' then concat('seed ', cast(event_id % 6 + 1 as varchar(9)), ' ', case event_id % 4 when 0 then 'none' when 1 then 'graph' when 2 then 'grid2d' else 'grid3d' end,
   '  macro_f1 0.', cast(event_id % 900 + 100 as varchar(9)), '  min_recall 0.', cast(event_id % 800 + 100 as varchar(9)),
   case when event_id % 3 = 0 then '  COLLAPSED classes: [1, 4]' else '' end)
 else 'noise' end as line
from {events}"""

# SQL text only: the Spark side of these three builds its small fixed axis with explode.
PREDICTIONS_SQL = """
select m.mode_id, s.seed, e.vec_id, e.label as y_true,
 cast(case when (e.vec_id*(7 + s.seed*s.seed) + s.seed*13) % 97 < 30 - 8*m.mode_id then (e.label + 1 + e.vec_id % 3) % 10 else e.label end as int) as y_pred
from embeddings e cross join (values (0),(1),(2),(3)) m(mode_id) cross join (values (1),(2),(3),(4),(5),(6)) s(seed)"""

FEATURES_SQL = """
select c.c_custkey as sample_id, f.feature, case f.feature when 'acctbal' then c.c_acctbal
  when 'n_orders' then cast(coalesce(o.n,0) as double) when 'total' then o.t else o.a end as value
from customer c left join (select o_custkey, count(*) n, cast(round(sum(o_totalprice)*100) as bigint)/100.0e0 t, cast(round(sum(o_totalprice)*100) as bigint)/(100.0e0*count(*)) a from orders group by 1) o
  on c.c_custkey=o.o_custkey cross join (values ('acctbal'),('n_orders'),('total'),('avg')) f(feature)"""

TILE_PIXELS_SQL = """
select p.p_partkey as tile_id, px.x, py.y,
  cast((205 + p.p_partkey*3 + px.x*7 + py.y*11 + px.x*py.y*(p.p_partkey % 10)) % 256 as int) as r,
  cast((110 + p.p_partkey*5 + px.x*13 + py.y*3) % 256 as int) as g, cast((185 + p.p_partkey*7 + px.x*5 + py.y*17) % 256 as int) as b
from part p cross join (values (0),(1),(2),(3),(4),(5),(6),(7)) px(x) cross join (values (0),(1),(2),(3),(4),(5),(6),(7)) py(y)"""

_SQL = {
    "cells": CELLS.format(lineitem="lineitem"),
    "habitat_patches": HABITAT_PATCHES.format(cells="cells"),
    "cns": CNS.format(cells="cells"),
    "nuclei": NUCLEI.format(cells="cells"),
    "markers": MARKERS.format(cells="cells"),
    "lattice": LATTICE.format(embeddings="embeddings"),
    "clinical": CLINICAL.format(customer="customer"),
    "features_long": FEATURES_SQL,
    "log_lines": LOG_LINES.format(events="events"),
    "predictions": PREDICTIONS_SQL,
    "tile_pixels": TILE_PIXELS_SQL,
}
_NEEDS = {"habitat_patches": ["cells"], "cns": ["cells"], "nuclei": ["cells"], "markers": ["cells"]}


def with_tables(*names: str) -> str:
    """``WITH`` clause (open for further members) defining the named tables in dependency order."""
    ordered: list[str] = []
    for name in names:
        for item in [*_NEEDS.get(name, []), name]:
            if item not in ordered:
                ordered.append(item)
    return "with " + ",\n".join(f"{n} as ({_SQL[n]})" for n in ordered)


class Tables:
    """The given tables and the derived spatial tables as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def cells(self) -> DataFrame:
        return self.spark.sql(CELLS, lineitem=self.read("lineitem"))

    def stored(self, name: str) -> DataFrame:
        """A derived table written once, for operators that read their input several times."""
        return durable(getattr(self, name)())

    def habitat_patches(self) -> DataFrame:
        return self.spark.sql(HABITAT_PATCHES, cells=self.cells())

    def cns(self) -> DataFrame:
        return self.spark.sql(CNS, cells=self.cells())

    def nuclei(self) -> DataFrame:
        return self.spark.sql(NUCLEI, cells=self.cells())

    def markers(self) -> DataFrame:
        return self.spark.sql(MARKERS, cells=self.cells())

    def lattice(self) -> DataFrame:
        return self.spark.sql(LATTICE, embeddings=self.read("embeddings"))

    def clinical(self) -> DataFrame:
        return self.spark.sql(CLINICAL, customer=self.read("customer"))

    def log_lines(self) -> DataFrame:
        return self.spark.sql(LOG_LINES, events=self.read("events"))

    def predictions(self) -> DataFrame:
        axis = (
            self.read("embeddings")
            .select("vec_id", F.col("label").alias("y_true"))
            .withColumn("mode_id", F.explode(F.lit([0, 1, 2, 3])))
            .withColumn("seed", F.explode(F.lit([1, 2, 3, 4, 5, 6])))
        )
        wrong = F.expr("(vec_id*(7 + seed*seed) + seed*13) % 97 < 30 - 8*mode_id")
        return axis.select(
            "mode_id",
            "seed",
            "vec_id",
            "y_true",
            F.when(wrong, F.expr("(y_true + 1 + vec_id % 3) % 10")).otherwise(F.col("y_true")).cast("int").alias("y_pred"),
        )

    def features_wide(self) -> DataFrame:
        orders = (
            self.read("orders")
            .groupBy(F.col("o_custkey").alias("c_custkey"))
            .agg(
                F.count(F.lit(1)).alias("n"),
                F.round(F.sum("o_totalprice") * 100).cast("long").alias("cents"),
            )
            .withColumn("total", F.col("cents") / 100.0)
            .withColumn("avg", F.col("cents") / (100.0 * F.col("n")))
        )
        joined = self.read("customer").select("c_custkey", "c_acctbal").join(orders, "c_custkey", "left")
        return joined.select(
            F.col("c_custkey").alias("sample_id"),
            F.col("c_acctbal").alias("acctbal"),
            F.coalesce("n", F.lit(0)).cast("double").alias("n_orders"),
            "total",
            "avg",
        )

    def features_long(self) -> DataFrame:
        names = ["acctbal", "n_orders", "total", "avg"]
        return self.features_wide().unpivot("sample_id", names, "feature", "value")

    def tile_pixels(self) -> DataFrame:
        eight = F.lit(list(range(8)))
        return (
            self.read("part")
            .select(F.col("p_partkey").alias("tile_id"))
            .withColumn("x", F.explode(eight))
            .withColumn("y", F.explode(eight))
            .selectExpr(
                "tile_id", "x", "y",
                "cast((205 + tile_id*3 + x*7 + y*11 + x*y*(tile_id % 10)) % 256 as int) as r",
                "cast((110 + tile_id*5 + x*13 + y*3) % 256 as int) as g",
                "cast((185 + tile_id*7 + x*5 + y*17) % 256 as int) as b",
            )
        )


class Registry:
    """Collects queries and their SQL counterparts."""

    def __init__(self):
        self.queries, self.sql = {}, {}

    def add(self, name: str, sql: str | None = None):
        def wrap(fn):
            if name in self.queries:
                raise ValueError(f"query {name} registered twice")
            self.queries[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
            if sql is not None:
                self.sql[name] = sql
            return fn

        return wrap


def rounded(df: DataFrame, *cols: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), places) for c in cols})
