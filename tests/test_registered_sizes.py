from unittest import mock

from histomesh.checks.catalogue import QUERIES
from histomesh.operators import interaction as I
from histomesh.operators import signature as M

SF = "/root/testdata/sf0.001"


def test_statistics_without_sql_are_registered_with_the_defaults(spark):
    with mock.patch.object(I, "null_model_comparison") as called:
        QUERIES["null_model_comparison"](spark, SF)
    assert called.call_args.kwargs == {}
    with mock.patch.object(M, "lasso_cox_frequency") as called:
        QUERIES["lasso_cox_frequency"](spark, SF)
    assert called.call_args.kwargs == {}
