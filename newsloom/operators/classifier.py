"""A text classifier trained on labelled texts, behind the interface of the default scorer."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.operators.evaluation import encode_label
from newsloom.operators.sentiment import scored


def train(labelled: DataFrame, features: int = 1 << 14, rounds: int = 20) -> PipelineModel:
    """Fits word frequencies and a logistic regression on text and label; rows with other labels or without text are left out."""
    rows = labelled.select("text", encode_label(F.col("label")).cast("double").alias("code")).where("code is not null and text is not null")
    stages = [RegexTokenizer(inputCol="text", outputCol="_words", pattern=r"[^\p{L}\p{N}]+"), HashingTF(inputCol="_words", outputCol="_tf", numFeatures=features), IDF(inputCol="_tf", outputCol="_v"), LogisticRegression(featuresCol="_v", labelCol="code", maxIter=rounds, regParam=0.01)]
    return Pipeline(stages=stages).fit(rows)


def predict(model: PipelineModel, rows: DataFrame, text: str = "text") -> DataFrame:
    """rows with scores and sentiment; rows without text are left out. The model may have been saved and loaded."""
    raw = model.transform(rows.where(F.col(text).isNotNull()).withColumn("text", F.col(text)))
    logits = raw.withColumn("_model_logits", vector_to_array("rawPrediction")).drop("_words", "_tf", "_v", "rawPrediction", "probability", "prediction")
    return scored(logits, F.col("_model_logits"), text).drop("_model_logits")
