"""All registered queries in one place."""

from histomesh.checks import cell_queries, habitat_queries, label_queries, stat_queries, model_queries

_MODULES = [cell_queries, habitat_queries, label_queries, stat_queries, model_queries]
QUERIES, SQL = {}, {}
for _m in _MODULES:
    QUERIES.update(_m.R.queries)
    SQL.update(_m.R.sql)
