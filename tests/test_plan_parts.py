"""Plan documents are dealt out before they are opened."""

from fleetlens.plans import explain


def test_documents_of_one_partition_are_dealt_out(spark):
    plan = '{"query_block":{"nested_loop":[{"table":{"table_name":"t","access_type":"ALL","rows_examined_per_scan":"5000"}}]}}'
    one = spark.createDataFrame([("d", i, plan) for i in range(500)], "digest string, ts long, plan_json string").coalesce(1)
    nodes = explain.plan_nodes(one)
    files = {f.rsplit("/", 1)[1][:10] for f in nodes.filter("kind = 'query_block'").inputFiles()}
    assert len(files) > 1 and nodes.count() == 4 * 500
