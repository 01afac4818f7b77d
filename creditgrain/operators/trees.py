"""Boosted trees as a relation: nodes in a table, paths as plain SQL.

A fitted ensemble is flattened into a row for each node. The margin of a row of inputs is
then the sum over trees of the value of the leaf that its path ends in, which a SQL
expression says without the library that fitted the trees, and in any engine.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence

from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_shared_path, store


def tree_nodes(spark: SparkSession, model: GBTClassificationModel) -> DataFrame:
    """tree, node (0 is the root), input, threshold, low, high, value, weight, a row for each node.

    A row goes to ``low`` if the input is at most the threshold, else to ``high``. Leaves have
    a ``value`` and no input; ``weight`` is that of the tree.
    """
    path = new_shared_path(spark, "trees")
    model.write().save(path)
    # The columns have other names by version: tree, its settings, its weight.
    weights = spark.read.parquet(f"{path}/treesMetadata").toDF("tree", "settings", "weight").drop("settings")
    node, split = F.col("nodeData"), F.col("nodeData.split")
    inner = node["leftChild"] >= 0
    nodes = spark.read.parquet(f"{path}/data").toDF("treeID", "nodeData").select(
        F.col("treeID").alias("tree"),
        node["id"].alias("node"),
        F.when(inner, split["featureIndex"]).alias("input"),
        F.when(inner, F.get(split["leftCategoriesOrThreshold"], F.lit(0))).alias("threshold"),
        F.when(inner, node["leftChild"]).alias("low"),
        F.when(inner, node["rightChild"]).alias("high"),
        F.when(~inner, node["prediction"]).alias("value"),
    )
    return store(nodes.join(weights, "tree"), "tree-nodes")


def margin_sql(nodes: DataFrame, inputs: Sequence[str]) -> str:
    """The weighted sum of the leaves as a SQL expression of the input columns.

    It is as long as the ensemble has nodes, which is a setting of the fit and no size of
    the data.
    """
    trees: dict[int, dict] = defaultdict(dict)
    for r in nodes.collect():  # an ensemble's nodes
        trees[r.tree][r.node] = r

    def path(tree: dict, at: int) -> str:
        r = tree[at]
        if r.value is not None:
            return f"cast({r.value!r} as double)"
        return f"case when {inputs[r.input]} <= cast({r.threshold!r} as double) then {path(tree, r.low)} else {path(tree, r.high)} end"

    return " + ".join(f"cast({tree[0].weight!r} as double) * {path(tree, 0)}" for _, tree in sorted(trees.items()))


def walked_probability(nodes: DataFrame, inputs: Sequence[str]) -> Column:
    """The probability of class 1 by the paths: the logistic function of twice the margin."""
    return 1 / (1 + F.exp(-2 * F.expr(margin_sql(nodes, inputs))))
