"""The end-to-end chains on small derived tables."""

import pathlib
import re

from pyspark.sql import functions as F

from histomesh.checks.fixtures import Tables
from histomesh.operators import lattice as G
from histomesh.operators import signature as M
from histomesh.plans import context_benchmark, neighbourhoods, outcome
from histomesh.session import durable

SF = "/root/testdata/sf0.001"


def test_discovery_and_cohort_patches(spark):
    t = Tables(spark, SF)
    cells = durable(t.cells().select("image_id", "cell_id", "x_um", "y_um", F.concat(F.lit("t"), "type_id").alias("cell_type")))
    out = neighbourhoods.discover(cells, n_topics=4, k=5, n_init=1, sweep=(4, 5))
    assert out["assignments"].count() == cells.count()
    assert out["definitions"].count() == 5
    assert out["sweep"].count() == 2
    patches = neighbourhoods.cohort_patches(cells, out["assignments"], 0.5, 100, 20)
    assert patches.groupBy("sample_id").count().agg(F.max("count")).first()[0] <= 20


def test_paired_patches(spark):
    t = Tables(spark, SF)
    cns = durable(t.cns().withColumnRenamed("image_id", "sample_id"))
    out = neighbourhoods.paired_patches(
        durable(t.nuclei()), cns, [[1 / 0.325, 0, 0], [0, 1 / 0.325, 0]], 0.325, 150, {"train": 6, "val": 2, "test": 2}
    )
    assert out["matched"].first().matched > 0.9
    assert set(out["report"].columns) >= {"split", "label", "n", "median_cells"}


def test_context_benchmark(spark):
    t = Tables(spark, SF)
    p = durable(G.to_lattice(t.lattice().select("slide_id", "patch_id", "label", "x_um", "y_um", "embedding"), 112.0))
    pred = context_benchmark.predictions(p, [1, 2], {"train": 3, "val": 1}, 10, 64, modes=("none", "grid2d"), max_iter=3, hidden=(8,))
    tables = context_benchmark.evaluate(durable(pred), n_bootstrap=50)
    assert tables["metrics"].count() == 2 * 2 * 3
    assert tables["summary"].filter("mode = 'grid2d'").count() == 3
    assert tables["metrics"].filter("ci_lower > value or value > ci_upper").count() <= 2


def test_outcome_chain(spark):
    t = Tables(spark, SF)
    wide = durable(t.features_wide().withColumn("comp_a", F.col("acctbal")).withColumn("comp_b", F.col("n_orders")))
    clinical = durable(t.clinical())
    cox = outcome.associations(wide, clinical, ["subtype"], min_samples=20)
    assert cox.filter("stratum = 'all'").count() == 6
    sig = outcome.signature(wide, clinical, rho=0.95, top_fraction=0.6, lasso_repeats=3)
    assert sig["groups"].filter("representative").count() < 6
    eco, consensus = outcome.ecotypes(wide, 3, 4)
    assert eco.count() == wide.dropna(subset=["comp_a", "comp_b"]).count()
    assert outcome.consensus_sweep(wide, (2, 3), 3).filter("chosen").count() == 1


def test_null_chain(spark):
    """The whole chain runs on an outcome dealt out anew; the outcomes stay the same ones."""
    t = Tables(spark, SF)
    wide, clinical = durable(t.features_wide()), durable(t.clinical())
    dealt = M.permuted_outcome(clinical)
    both = [sorted((r.os_time, r.os_event) for r in d.collect()) for d in (clinical, dealt)]
    assert both[0] == both[1]
    got = {r.metric: r.value for r in outcome.null_chain(wide, clinical, top_fraction=0.6, lasso_repeats=2).collect()}
    assert got["n_unsettled"] == 0 and got["n_significant"] <= 1
    assert 1 <= got["n_kept"] <= got["n_tested"] == len(wide.columns) - 1 and got["n_selected"] <= got["n_kept"]
    assert (got["c_index"] is None) == (got["n_selected"] < 2)
    if got["n_selected"] >= 2:
        assert got["c_index"] < 0.7 and 0.2 < got["c_index_held_out"] < 0.8


def test_source_rules():
    """No local checkpoints, no cross joins, no row-at-a-time UDFs anywhere in the library."""
    banned = re.compile(r"localCheckpoint|crossJoin|F\.udf\(|toLocalIterator|\.rdd\b")
    for path in pathlib.Path(__file__).parents[1].joinpath("histomesh").rglob("*.py"):
        assert not banned.search(path.read_text()), path
