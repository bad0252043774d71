"""Joins of the operators: what grows with the input is not sent to the driver."""
from mailwarden.llm import jaccard_join
from mailwarden.llm.common import salted_join, written


def _plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))


def test_salted_join_repeats_the_small_side_on_the_executors(spark):
    """A table of a few bytes is broadcast by Spark's own choice, and 32 times as long by then."""
    large = spark.createDataFrame([(i, i % 3) for i in range(50)] + [(50, None)], "doc_id long, sid long")
    small = written(spark.createDataFrame([(0, 7), (1, 8)], "sid long, component_id long"), "small")
    for how, rows in (("left", 51), ("inner", 34)):
        out = salted_join(large, small, "sid", "doc_id", how)
        assert "Broadcast" not in _plan(out)
        assert out.count() == rows
        assert {(r.sid, r.component_id) for r in out.collect() if r.component_id} == {(0, 7), (1, 8)}


def test_pivots_meet_their_first_sets_on_the_executors(spark):
    texts = ["a b c d e f g h i j k l m n", "a b c d e f g h i j k l m o", "p q r s t u v w x y z a c e"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    near = jaccard_join._near(written(jaccard_join._scan(docs, "doc_id", "text", 3, 4, 80), "scan"), 80)
    assert "Broadcast" not in _plan(near)
    assert near.count() == 1
