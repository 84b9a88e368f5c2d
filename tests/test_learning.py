"""Rows of a fit are dealt over tasks."""

from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import functions as F

from acadspark.operators import learning as Y


def test_rows_of_one_task_are_a_fixed_share(spark):
    train = spark.range(6400).select(F.col("id").alias("features"), (F.col("id") % 2).cast("double").alias("label")).coalesce(1)
    prepared = PipelineModel([SQLTransformer(statement="SELECT * FROM __THIS__")])
    sizes = [len(p) for p in Y.fit_rows(prepared, train).rdd.glom().collect()]
    assert sum(sizes) == 6400 and max(sizes) <= 2 * 6400 / spark.sparkContext.defaultParallelism
