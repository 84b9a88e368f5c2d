"""Jobs of several stages."""

from pyspark.sql import functions as F

from acadspark.plans.pipeline import run_stages
from acadspark.session import BY_ESTIMATE, BY_MEASURE


def _joined(spark, t):
    forms = t["a"].select("id", F.explode(F.array(*[F.concat(F.lit(f"{i}/"), "name") for i in range(9)])).alias("url"))
    return spark.range(400_000).withColumn("name", F.lit("y" * 90)).join(forms, "id")


def test_stages_broadcast_no_table_by_its_bytes_on_disk(spark, tmp_path):
    before = {k: spark.conf.get(k, None) for k in (BY_ESTIMATE, BY_MEASURE)}
    seen = []

    def plan(df):
        df.write.format("noop").mode("overwrite").save()
        df.collect()
        return df._jdf.queryExecution().executedPlan().toString()

    def second(t):
        rows = _joined(spark, t).groupBy("url").agg(F.count("*").alias("n"))
        seen.append(plan(rows))
        small = t["a"].filter("id < 50").join(spark.range(400_000), "id").groupBy("name").count()
        seen.append(plan(small))
        return rows

    # 20,000 rows of some 4 MB, which take a few kB on disk
    stages = [("a", lambda t: spark.range(20_000).withColumn("name", F.lit("x" * 200))), ("b", second)]
    try:
        spark.conf.set(BY_ESTIMATE, "1m")
        done = run_stages(spark, stages, str(tmp_path / "job"))
        assert spark.conf.get(BY_ESTIMATE) == "1m" and spark.conf.get(BY_MEASURE, None) == before[BY_MEASURE]
        assert "BroadcastHashJoin" in plan(_joined(spark, done).groupBy("url").agg(F.count("*").alias("n")))  # as it was in a stage
    finally:
        spark.conf.unset(BY_ESTIMATE) if before[BY_ESTIMATE] is None else spark.conf.set(BY_ESTIMATE, before[BY_ESTIMATE])
    assert "BroadcastHashJoin" not in seen[0].split("== Initial Plan ==")[0]
    assert "BroadcastHashJoin" in seen[1].split("== Initial Plan ==")[0]
    assert {r.n for r in done["b"].collect()} == {20_000}
