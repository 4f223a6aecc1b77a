from pyspark.sql import functions as F

from tapeworks.operators import features as f


def test_rules_with_missing_values(spark):
    rows = [(1.0, 2.0), (None, 2.0), (0.0, 0.0), (3.0, None)]
    d = spark.createDataFrame(rows, "a double, b double").select(
        "a", "b", f.divided("b", "a").alias("q"), f.both("a", f.gt("b", 1)).alias("both"), f.either("a", "b").alias("either"), f.negated(f.gt("a", 1)).alias("no"),
        f.ne("a", "b").alias("ne"), f.eq("a", "b").alias("eq"), f.ge("a", "b").alias("ge"), f.le("a", "b").alias("le"), f.truthy(F.lit(None)).alias("none"),
    )
    got = {(r["a"], r["b"]): tuple(r)[2:] for r in d.collect()}
    assert got == {
        (1.0, 2.0): (2.0, True, True, True, True, False, False, True, False), (None, 2.0): (None, False, True, True, True, False, False, False, False),
        (0.0, 0.0): (None, False, False, True, False, True, True, True, False), (3.0, None): (None, False, True, False, True, False, False, False, False),
    }
