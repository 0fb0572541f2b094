"""How often the licence scan goes through its texts."""

from chronolith.llm import licenses


def test_texts_are_cut_once(spark):
    """What the scan returns has read the texts before: its plan cuts nothing anew, for any of the uses of what was found."""
    docs = spark.createDataFrame([(1, "Released under the MIT License. More."), (2, "nothing"), (3, None)], "doc_id long, text string")
    out = licenses.scan(docs)
    assert [tuple(r) for r in out.collect()] == [(1, "MIT", 4, 1)]
    assert "split(" not in out._jdf.queryExecution().optimizedPlan().toString()
