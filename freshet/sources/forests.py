"""Grown trees as Spark's forest model, by way of the folder that Spark saves one in."""

import json
import time

import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import SparkSession

from freshet.storage import new_path

_SPLIT = pa.struct(
    [
        ("featureIndex", pa.int32()),
        ("leftCategoriesOrThreshold", pa.list_(pa.float64())),
        ("numCategories", pa.int32()),
    ]
)
_NODE = pa.struct(
    [
        ("id", pa.int32()),
        ("prediction", pa.float64()),
        ("impurity", pa.float64()),
        ("impurityStats", pa.list_(pa.float64())),
        ("rawCount", pa.int64()),
        ("gain", pa.float64()),
        ("leftChild", pa.int32()),
        ("rightChild", pa.int32()),
        ("split", _SPLIT),
    ]
)
_CLASSES = "org.apache.spark.ml.classification."
_OF_FOREST = ("bootstrap", "featureSubsetStrategy", "numTrees", "subsamplingRate")


def forest_model(spark: SparkSession, forest, inputs: int, trees) -> RandomForestClassificationModel:
    """A fitted model of two classes with the parameters of the estimator ``forest``.

    ``trees`` has a list of nodes for each tree, as Spark saves them: children after their parents.
    """
    path = new_path(spark, "grown")
    about = _about(spark, forest, "RandomForestClassificationModel", forest.uid)
    about |= {"numFeatures": inputs, "numClasses": 2, "numTrees": len(trees)}
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(f"{path}/metadata")
    names = [_about(spark, forest, "DecisionTreeClassificationModel", f"dtc_{k}", _OF_FOREST) for k in range(len(trees))]
    kept = [(k, json.dumps(name), 1.0) for k, name in enumerate(names)]
    spark.createDataFrame(kept, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    nodes = pa.table(
        {
            "treeID": pa.array([k for k, tree in enumerate(trees) for _ in tree], pa.int32()),
            "nodeData": pa.array([node for tree in trees for node in tree], _NODE),
        }
    )
    spark.createDataFrame(nodes).coalesce(1).write.parquet(f"{path}/data")
    return RandomForestClassificationModel.load(path)


def _about(spark, forest, name, uid, without=()):
    params = [p for p in forest.params if p.name not in without]
    own = {p.name: forest.getOrDefault(p) for p in params if forest.isSet(p)}
    others = [p for p in params if p.name not in own and forest.hasDefault(p)]
    return {
        "class": _CLASSES + name,
        "timestamp": int(time.time() * 1000),
        "sparkVersion": spark.version,
        "uid": uid,
        "paramMap": own,
        "defaultParamMap": {p.name: forest.getOrDefault(p) for p in others},
    }
