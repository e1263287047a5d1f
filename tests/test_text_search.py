from stratalens.plans import registry


def test_texts_are_embedded_once(spark):
    out = registry.QUERIES["text_search"](spark, "/root/testdata/sf0.001")
    # the search's passes read vectors that were written, none makes them again
    assert "array_remove" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {r["rank"] for r in out.collect()} == {1, 2, 3, 4, 5}
