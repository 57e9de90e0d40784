"""What the mix sends to the driver: nothing that grows with the documents."""

import re

from qualitylab.llm import mixing


def test_slots_and_cells_are_not_broadcast(spark):
    docs = spark.createDataFrame([(i, f"s{i % 3}", "word " * 70) for i in range(60)], "doc_id long, source string, text string")
    for out in (mixing.mixed_sources(docs), mixing.mixed_blocks(docs)):
        assert out.count() >= 60
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"SortMergeJoin \[source_#\d+, block#\d+L\]", plan)
        assert re.search(r"SortMergeJoin \[source_#\d+, cell#\d+\]", plan)
        assert not re.search(r"Broadcast\w*Join \[source_#\d+, ", plan)
