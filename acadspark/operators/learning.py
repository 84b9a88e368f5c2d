"""Text classification with Spark ML."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.feature import IDF, CountVectorizer, NGram, RegexTokenizer, SQLTransformer, StopWordsRemover
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from acadspark.functions.steps import SPREAD
from acadspark.operators.predicates import not_lab_text

TERMS, HIDDEN = 100, 10


def split_examples(examples: DataFrame, test_share: int = 5) -> tuple[DataFrame, DataFrame]:
    """Deterministic train and test parts by hash of text and label: about one in ``test_share`` of every label.

    The share holds in the mean, not to the row; equal texts never stand on both sides, and no label is ranked in one task.
    """
    h = F.pmod(F.xxhash64("text", "label"), F.lit(test_share))
    return examples.filter(h != 0), examples.filter(h == 0)


def stratified_split(examples: DataFrame, key: str, test_share: int = 5) -> DataFrame:
    """``examples`` with ``is_test``: exactly one in ``test_share`` of every label (rounded down), by the order of a hash of ``key``.

    Ranks are exact in two steps: the counts per label and slice of the hash range are summed up, and rows are ranked within
    their slice, so no label has to fit one task. Keys must be unique; rows of a null label are a label of their own.
    """
    h = F.md5(F.col(key).cast("string"))
    rows = examples.withColumns({"_h": h, "_slice": F.substring(h, 1, 3)})
    counts = rows.groupBy("label", "_slice").agg(F.count(F.lit(1)).alias("_n"))
    label = W.partitionBy("label")
    below = counts.select(F.col("label").alias("_label"), F.col("_slice").alias("_s"), F.coalesce(F.sum("_n").over(label.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"), F.sum("_n").over(label).alias("_all"))
    ranked = rows.withColumn("_rank", F.row_number().over(W.partitionBy("label", "_slice").orderBy("_h", key)))
    joined = ranked.join(below, F.col("label").eqNullSafe(F.col("_label")) & (F.col("_slice") == F.col("_s")))
    return joined.select(*examples.columns, (F.col("_base") + F.col("_rank") <= F.floor(F.col("_all") / test_share)).alias("is_test"))


def fit_rows(prepared: PipelineModel, train: DataFrame) -> DataFrame:
    """Features and labels that every pass of the fit reads, dealt evenly over several tasks per core however the texts are stored:
    the part of one task is a fixed share of them."""
    rows = prepared.transform(train).select("features", "label")
    return rows.repartition(SPREAD * train.sparkSession.sparkContext.defaultParallelism)


def train_text_classifier(train: DataFrame, seed: int = 42, terms: int = TERMS, max_iter: int = 100) -> PipelineModel:
    """TF-IDF of words and word pairs into a small perceptron. ``train`` has text and label (0.0 or 1.0)."""
    stages = [
        RegexTokenizer(inputCol="text", outputCol="_words", pattern=r"[^\p{L}\p{N}_]+", minTokenLength=2),
        StopWordsRemover(inputCol="_words", outputCol="_kept"),
        NGram(n=2, inputCol="_kept", outputCol="_pairs"),
        SQLTransformer(statement="SELECT *, concat(_kept, _pairs) AS _terms FROM __THIS__"),
        CountVectorizer(inputCol="_terms", outputCol="_counts", vocabSize=terms, minDF=2.0, maxDF=0.8),
        IDF(inputCol="_counts", outputCol="features"),
    ]
    prepared = Pipeline(stages=stages).fit(train)
    size = len(prepared.stages[4].vocabulary)
    mlp = MultilayerPerceptronClassifier(layers=[size, HIDDEN, 2], seed=seed, maxIter=max_iter, featuresCol="features", labelCol="label")
    data = fit_rows(prepared, train).persist()
    try:
        model = mlp.fit(data)
    finally:
        data.unpersist()
    return PipelineModel(stages=[*prepared.stages, model])


def predict_text(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Add ``label_hat`` and ``confidence`` (the largest class probability)."""
    out = model.transform(df)
    p = F.array_max(vector_to_array("probability"))
    return out.select(*df.columns, F.col("prediction").alias("label_hat"), p.alias("confidence"))


def evaluate(model: PipelineModel, test: DataFrame) -> DataFrame:
    """One row: examples and accuracy."""
    return predict_text(model, test).agg(F.count("*").alias("examples"), F.avg((F.col("label_hat") == F.col("label")).cast("double")).alias("accuracy"))


def scan_blocks(model: PipelineModel, blocks: DataFrame, min_conf: float = 0.7, low: int = 10, high: int = 500) -> DataFrame:
    """Text blocks classed as lab names."""
    ok = not_lab_text(blocks.filter(F.length("text").between(low, high)), "text").filter("NOT not_lab").drop("not_lab")
    return predict_text(model, ok).filter((F.col("label_hat") == 1.0) & (F.col("confidence") >= min_conf))


def top_features(model: PipelineModel, n: int = 20) -> DataFrame:
    """Terms with the largest absolute mean weight in the first layer. The vocabulary holds ``TERMS`` entries at most."""
    vocab = model.stages[4].vocabulary
    weights = model.stages[-1].weights.toArray()[: len(vocab) * HIDDEN]
    # the first layer is stored term by term, one weight per hidden unit
    mean = abs(weights.reshape(len(vocab), HIDDEN).mean(axis=1))
    from pyspark.sql import SparkSession

    spark = SparkSession.active()
    return spark.createDataFrame([(t, float(w)) for t, w in zip(vocab, mean)], "term string, weight double").orderBy(F.desc("weight"), "term").limit(n)


def save_model(model: PipelineModel, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
