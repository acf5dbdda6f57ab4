"""Sentiment: lexicon features (SQL-checkable) and a Spark ML three-class model."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, OneHotEncoder, StringIndexer, VarianceThresholdSelector, VectorAssembler
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sift.functions import resources as R

CLASSES = ["-1", "0", "1"]


def lexicon_frame(spark: SparkSession, rows=None) -> DataFrame:
    """Lexicon rows in file order -> ``(word, score, ord)``."""
    rows = rows if rows is not None else R.LEXICON
    return spark.createDataFrame([(w, float(s), i) for i, (w, s) in enumerate(rows)],
                                 "word string, score double, ord int")


def first_per_word(lexicon: DataFrame) -> DataFrame:
    """The first row of every word wins (by ``ord``)."""
    w = Window.partitionBy("word").orderBy("ord")
    return lexicon.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select("word", "score")


def lexicon_features(docs: DataFrame, lexicon: DataFrame, tokens_col: str = "tokens",
                     id_col: str = "doc_id") -> DataFrame:
    """A15 + J4: per document sum of negative scores, sum of positive scores and the
    shares of negative / positive tokens (0 for an empty document)."""
    lex = first_per_word(lexicon)
    from sift.functions.text import explode_nonempty
    long = explode_nonempty(docs, [id_col], tokens_col, "word")
    hits = (long.join(F.broadcast(lex), "word")  # a word list, read by every task: the tokens are not shuffled
                .groupBy(id_col).agg(
                    F.sum(F.when(F.col("score") < 0, F.col("score")).otherwise(0.0)).alias("neg_sum"),
                    F.sum(F.when(F.col("score") > 0, F.col("score")).otherwise(0.0)).alias("pos_sum"),
                    F.count(F.when(F.col("score") < 0, 1)).alias("n_neg"),
                    F.count(F.when(F.col("score") > 0, 1)).alias("n_pos")))
    d = docs.select(id_col, F.size(tokens_col).alias("_len")).join(hits, id_col, "left")
    share = lambda c: F.when(F.col("_len") > 0, F.coalesce(F.col(c), F.lit(0)) / F.col("_len")).otherwise(0.0)
    return d.select(id_col,
                    F.coalesce("neg_sum", F.lit(0.0)).alias("neg_sum"),
                    F.coalesce("pos_sum", F.lit(0.0)).alias("pos_sum"),
                    share("n_neg").alias("neg_share"), share("n_pos").alias("pos_share"))


def lexicon_sentiment(features: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Sign of (positive sum + negative sum) as -1 / 0 / 1."""
    return features.select(id_col, F.signum(F.col("pos_sum") + F.col("neg_sum")).cast("int").alias("sentiment"))


def encode_classes(df: DataFrame, label_col: str) -> DataFrame:
    """Labels -1/0/1 -> class index (fixed order) and a one-hot vector of 3."""
    idx = StringIndexer(inputCol="_lab", outputCol="class_index", stringOrderType="alphabetAsc")
    d = df.withColumn("_lab", F.col(label_col).cast("string"))
    model = idx.fit(spark_frame_of_classes(d.sparkSession))
    enc = OneHotEncoder(inputCol="class_index", outputCol="one_hot", dropLast=False)
    out = model.transform(d)
    return enc.fit(out).transform(out).drop("_lab")


def spark_frame_of_classes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c,) for c in CLASSES], "_lab string")


def split_column(id_col: str = "doc_id", seed: int = 42, test_buckets: int = 1, buckets: int = 10):
    """Stable 90/10 split by a multiplicative bucket of the id: the same rows on every run and in any engine."""
    b = F.pmod(F.floor(F.pmod(F.col(id_col).cast("bigint") * 7919 + seed, F.lit(1_000_003)) / 97), F.lit(buckets))
    return F.when(b < test_buckets, "test").otherwise("train")


def sentiment_pipeline(num_features: int = 1 << 18, max_iter: int = 50) -> Pipeline:
    """M11 (re-aimed): hashed tf-idf of tokens + lexicon features -> multinomial LR.

    The regression gives a feature that is constant over the training rows the coefficient 0.  Those go
    before the fit, so that an iteration sums the coefficients of the buckets with a training token, not of all.
    """
    return Pipeline(stages=[
        HashingTF(inputCol="tokens", outputCol="hashed", numFeatures=num_features),
        VarianceThresholdSelector(featuresCol="hashed", outputCol="tf", varianceThreshold=0.0),
        IDF(inputCol="tf", outputCol="tfidf"),
        VectorAssembler(inputCols=["tfidf", "neg_sum", "pos_sum", "neg_share", "pos_share"], outputCol="features"),
        LogisticRegression(featuresCol="features", labelCol="label", family="multinomial",
                           maxIter=max_iter, regParam=0.01),
    ])


def train(train_df: DataFrame) -> PipelineModel:
    """The fitted pipeline; the tokens are hashed once for all passes of the fit.

    Every iteration sums one dense gradient a partition: one partition a core, however many the input has.
    """
    hashing, selector, *rest = sentiment_pipeline().getStages()
    few = train_df.sparkSession.sparkContext.defaultParallelism
    more = ["neg_sum", "pos_sum", "neg_share", "pos_share", "label"]
    hashed = hashing.transform(train_df.coalesce(few)).select("hashed", *more).persist()
    chosen = selector.fit(hashed)
    kept = chosen.transform(hashed).select("tf", *more).persist()
    fitted = Pipeline(stages=rest).fit(kept)
    kept.unpersist()
    hashed.unpersist()
    return PipelineModel(stages=[hashing, chosen, *fitted.stages])


def predict(model: PipelineModel, df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """M12 + X6: argmax class index - 1 -> sentiment in {-1, 0, 1}."""
    return model.transform(df).select(id_col, (F.col("prediction") - 1).cast("int").alias("sentiment"))
