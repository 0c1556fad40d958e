"""A fitted forest as a table of nodes: scoring as a walk of joins, importances as sums over nodes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dipstick.operators.model import matrix
from dipstick.session import fresh_path


def node_table(model: PipelineModel) -> DataFrame:
    """(tree, node, Feature, place, threshold, left_node, right_node, n0, n1, n_rows) of a fitted forest.

    One row a node; 0 is a tree's root. Values up to ``threshold`` go left. A leaf has NULL Feature,
    threshold and children. ``n0`` and ``n1`` are the weights of the classes that the node was fitted
    on, ``n_rows`` counts rows with repeats of the bootstrap, ``place`` is the feature's.
    The table is the stored form of the model, so it has no bound and never passes the driver.
    """
    spark = SparkSession.active()
    path = fresh_path(spark, "forest")
    model.stages[-1].write().save(path)
    names = F.array(*[F.lit(f) for f in model.stages[0].getInputCols()])
    node, split = F.col("nodeData"), F.col("nodeData.split")
    inner = node["leftChild"] >= 0

    def of_inner(value: Column) -> Column:
        return F.when(inner, value)

    return spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"),
        node["id"].alias("node"),
        of_inner(F.get(names, split["featureIndex"])).alias("Feature"),
        of_inner(split["featureIndex"]).alias("place"),
        of_inner(F.get(split["leftCategoriesOrThreshold"], F.lit(0))).alias("threshold"),
        of_inner(node["leftChild"]).alias("left_node"),
        of_inner(node["rightChild"]).alias("right_node"),
        node["impurityStats"][0].alias("n0"),
        node["impurityStats"][1].alias("n1"),
        node["rawCount"].alias("n_rows"),
    )


def depth(model: PipelineModel) -> int:
    return max(tree.depth for tree in model.stages[-1].trees)


def leaves_of(nodes: DataFrame, rows: DataFrame, features: Sequence[str], n_trees: int, levels: int, keep: Sequence[str]) -> DataFrame:
    """(keep, _walker, tree, node, n0, n1): the leaf that every row of ``rows`` reaches in every tree.

    A row starts at the root of each tree and takes one equi-join with the node table a level. The
    table goes by its measured size: small ones are broadcast once for all levels, and the walk of a
    row then stays inside one task.
    """
    values = F.array(*[F.col(f"`{f}`") for f in features])
    kept = [c for c in keep if c not in features]
    # The number is given before rows are repeated by tree.
    state = matrix(rows, features, kept).select(*kept, F.monotonically_increasing_id().alias("_walker"), values.alias("_values"))
    state = state.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1))).alias("tree"), F.lit(0).alias("node"))
    for _ in range(levels):
        steps = nodes.select("tree", "node", "place", "threshold", "left_node", "right_node")
        go = F.when(F.get(F.col("_values"), F.col("place")) <= F.col("threshold"), F.col("left_node")).otherwise(F.col("right_node"))
        state = state.join(steps, ["tree", "node"]).withColumn("node", F.coalesce(go, "node")).drop("place", "threshold", "left_node", "right_node")
    ends = nodes.select("tree", "node", "n0", "n1")
    return state.drop("_values").join(ends, ["tree", "node"])


def score_by_nodes(
    nodes: DataFrame, rows: DataFrame, features: Sequence[str], n_trees: int, levels: int, keep: Sequence[str] = ("station_id", "Date", "Target")
) -> DataFrame:
    """(keep, prediction, score, confidence): the mean over trees of the leaves' class shares, as the model gives them."""
    found = leaves_of(nodes, rows, features, n_trees, levels, keep)
    kept = [c for c in keep if c not in features]
    share = F.col("n1") / (F.col("n0") + F.col("n1"))
    scored = found.groupBy(*kept, "_walker").agg(F.avg(share).alias("score"))
    return scored.select(
        *kept, (F.col("score") > 0.5).cast("int").alias("prediction"), "score", F.greatest("score", 1 - F.col("score")).alias("confidence")
    )


def _weighted_gini(n0: str, n1: str) -> Column:
    a, b = F.col(n0), F.col(n1)
    return (a + b) - (a * a + b * b) / (a + b)


def importances(nodes: DataFrame, features: Sequence[str]) -> DataFrame:
    """(Feature, Importance): the weighted decrease of impurity at a feature's splits, recomputed from the node table.

    Decreases are shares of their tree's sum, the mean over trees is scaled to one. A feature that no
    tree splits on has 0, as has a tree without splits.
    """
    children = nodes.select("tree", F.col("node").alias("_child"), "n0", "n1")
    sides = {
        side: children.select("tree", F.col("_child").alias(f"{side}_node"), F.col("n0").alias(f"{side}_n0"), F.col("n1").alias(f"{side}_n1"))
        for side in ("left", "right")
    }
    split = nodes.where("Feature IS NOT NULL")
    for side, table in sides.items():
        split = split.join(table, ["tree", f"{side}_node"])
    decrease = _weighted_gini("n0", "n1") - _weighted_gini("left_n0", "left_n1") - _weighted_gini("right_n0", "right_n1")
    by_tree = split.groupBy("tree", "Feature").agg(F.sum(decrease).alias("decrease"))
    whole = by_tree.groupBy("tree").agg(F.sum("decrease").alias("whole"))
    shares = by_tree.join(whole, "tree").groupBy("Feature").agg(F.sum(F.try_divide("decrease", "whole")).alias("share"))
    total = shares.agg(F.sum("share")).scalar()
    names = nodes.sparkSession.createDataFrame([(f,) for f in features], "Feature string")
    return names.join(shares, "Feature", "left").select("Feature", F.coalesce(F.try_divide("share", total), F.lit(0.0)).alias("Importance"))


def structure(nodes: DataFrame, least_rows: int) -> DataFrame:
    """(tree, n_leaves less n_splits, children_found, weights_add_up, leaves_large_enough) of every tree.

    A binary tree has one leaf more than splits; every child that is named exists; the classes of two
    children are those of their parent; no leaf was fitted on fewer rows than the limit.
    """
    child = F.explode(F.array("left_node", "right_node")).alias("_child")
    asked = nodes.where("Feature IS NOT NULL").select("tree", F.col("node").alias("_parent"), child)
    found = asked.join(nodes.select("tree", F.col("node").alias("_child"), "n0", "n1"), ["tree", "_child"])
    pairs = found.groupBy("tree", F.col("_parent").alias("node")).agg(
        F.count("*").alias("children"), F.sum("n0").alias("c0"), F.sum("n1").alias("c1")
    )
    leaf = F.col("Feature").isNull()
    near = (F.abs(F.col("c0") - F.col("n0")) < 1e-6 * (1 + F.col("n0"))) & (F.abs(F.col("c1") - F.col("n1")) < 1e-6 * (1 + F.col("n1")))
    return nodes.join(pairs, ["tree", "node"], "left").groupBy("tree").agg(
        (F.count_if(leaf) - F.count_if(~leaf)).alias("leaves_over_splits"),
        F.bool_and(leaf | (F.col("children") == 2)).alias("children_found"),
        F.bool_and(leaf | near).alias("weights_add_up"),
        F.bool_and(~leaf | (F.col("n_rows") >= least_rows)).alias("leaves_large_enough"),
    )
