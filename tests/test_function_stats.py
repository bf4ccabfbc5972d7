"""Percentiles of function durations over many distinct values."""

from pyspark.sql import functions as F

from chronoloom.plans.derived import function_stats


def test_percentiles_are_exact_over_many_durations(spark):
    n = 200_000
    spans = spark.range(n).select(F.when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("name"), (F.col("id") * 7919 % n * 3).alias("dur_us"))
    spans = spans.unionByName(spark.sql("SELECT 'open' AS name, CAST(NULL AS BIGINT) AS dur_us UNION ALL SELECT 'once', 5"))
    got = {r["name"]: r for r in function_stats(spans).collect()}
    rows = spans.collect()
    assert set(got) == {"even", "odd", "once"}
    for name, r in got.items():
        held = sorted(x["dur_us"] for x in rows if x["name"] == name)
        at = lambda percent: held[-(-len(held) * percent // 100) - 1]
        assert (r["n"], r["p50_us"], r["p95_us"], r["max_us"]) == (len(held), at(50), at(95), held[-1])
        assert r["mean_us"] == sum(held) / len(held)
