import __spark_entry__
from factflow.plans import bridge, catalogue


def test_every_query_has_sql_or_a_reason():
    beyond = {"pts_interprocedural", "call_graph_solved"}
    assert set(catalogue.QUERIES) - set(catalogue.SQL) == beyond
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_projections_name_only_tables():
    for name in bridge.PROJECTIONS:
        assert "{" not in bridge.sql(name).replace("'{\"'", "").replace("${", "").replace('{"', ""), name
