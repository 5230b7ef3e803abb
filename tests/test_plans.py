"""Whole coverage runs over the registered queries' own tables."""

from pyspark.sql import functions as F

from rfcover.catalog import missions


def suppliers(spark, folder, n):
    rows = spark.range(1, n + 1).select(F.col("id").alias("s_suppkey"), F.concat(F.lit("s"), "id").alias("s_name"), (F.col("id") % 25).alias("s_nationkey"))
    rows.write.parquet(f"{folder}/supplier.parquet")
    return str(folder)


def test_relay_gain_uses_the_full_grid(spark, tmp_path, monkeypatch):
    seen = {}
    whole = missions.PC.relay_scenarios

    def spy(cells, *a, **kw):
        seen["cells"] = cells
        return whole(cells, *a, **kw)

    monkeypatch.setattr(missions.PC, "relay_scenarios", spy)
    missions.relay_gain(spark, suppliers(spark, tmp_path, 2))
    sides = seen["cells"].groupBy("run_id").agg((F.max(F.greatest("row", "col")) + 1).alias("n")).collect()
    assert len(sides) == 2 and all(s.n == 220 for s in sides)
