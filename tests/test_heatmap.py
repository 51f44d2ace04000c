from __future__ import annotations

from pyspark.sql import functions as F

from trailmill.operators import heatmap
from trailmill.sources.tables import derived


def test_every_point_of_a_hot_user_counts(spark):
    n = 60_000
    i = F.col("id")
    p = spark.range(n).select(
        "id", F.lit(1).cast("long").alias("user_id"), F.floor(i / 100).alias("trip_id"), (i * 60_000).alias("ts"), (30 + i % 200 * 0.01).alias("lat"), (100 + F.floor(i / 200) * 0.01).alias("lng"), F.lit(5.0).alias("accuracy_m")
    )
    got = heatmap.heat_cells(p, "user_id").agg(F.sum("samples"), F.count(F.lit(1)), F.sum("trips")).first()
    assert tuple(got) == (n, n, n)


def test_weight_half_way_is_that_of_the_sum_in_order(spark):
    """A cell of one user with points of two trips: summed trip by trip it would weigh 31."""
    p = derived(spark, "/root/testdata/sf0.1", "track").filter("user_id = 120")
    got = heatmap.heat_cells(p, "user_id").filter("y = 42559 and x = 136924").first()
    assert (got["samples"], got["trips"], got["stay_s"], got["weight"]) == (10, 2, 100, 30)
