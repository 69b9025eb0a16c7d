"""Fitted models on disk."""

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession

from freshet.plans.encoding import known_encoding
from freshet.plans.training import ForestModel

_ABOUT = "column string, base int, digits int"


def save_model(model: ForestModel, path: str) -> None:
    """Save ``model``, replacing what is at ``path``: the forest, and the category's numbers as a table."""
    known = model.encoding
    model.pipeline.write().overwrite().save(f"{path}/forest")
    spark = SparkSession.active()
    about = [(known.column, known.base, known.digits)] if known else []
    spark.createDataFrame(about, _ABOUT).write.mode("overwrite").parquet(f"{path}/encoding")
    if known:
        known.table.write.mode("overwrite").parquet(f"{path}/categories")


def load_model(path: str) -> ForestModel:
    """The model at ``path``; its table of numbers is read where it lies, and measured again."""
    spark = SparkSession.active()
    about = spark.read.schema(_ABOUT).parquet(f"{path}/encoding").first()
    table = spark.read.parquet(f"{path}/categories") if about else None
    encoding = known_encoding(table, about["column"], about["base"], about["digits"]) if about else None
    return ForestModel(PipelineModel.load(f"{path}/forest"), encoding)
