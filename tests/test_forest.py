"""The node table of a fitted forest: SQL over it gives the model's own scores and importances."""

import duckdb
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from dipstick.catalog.base import Inputs
from dipstick.operators import forecast, forest, model, profile
from dipstick.plans import training

FOLDER = "/root/testdata/sf0.001"

WALK = """WITH RECURSIVE walk AS (
  SELECT r.row, r.x, n.tree, n.node, n.place, n.threshold, n.left_node, n.right_node, n.n1 / (n.n0 + n.n1) AS share FROM rows r JOIN nodes n ON n.node = 0
  UNION ALL
  SELECT w.row, w.x, n.tree, n.node, n.place, n.threshold, n.left_node, n.right_node, n.n1 / (n.n0 + n.n1)
  FROM walk w JOIN nodes n ON n.tree = w.tree AND n.node = CASE WHEN w.x[w.place + 1] <= w.threshold THEN w.left_node ELSE w.right_node END
)
SELECT row, avg(share) AS score FROM walk WHERE place IS NULL GROUP BY row ORDER BY row"""

DECREASES = """WITH split AS (
  SELECT p.tree, p.Feature, gini(p.n0, p.n1) - gini(l.n0, l.n1) - gini(r.n0, r.n1) AS d
  FROM nodes p JOIN nodes l ON l.tree = p.tree AND l.node = p.left_node JOIN nodes r ON r.tree = p.tree AND r.node = p.right_node
), share AS (SELECT tree, Feature, sum(d) / sum(sum(d)) OVER (PARTITION BY tree) AS s FROM split GROUP BY 1, 2)
SELECT Feature, sum(s) / (SELECT sum(s) FROM share) AS Importance FROM share GROUP BY 1"""


@pytest.fixture(scope="module")
def data(spark):
    return Inputs.of(spark, FOLDER)


@pytest.fixture(scope="module")
def small(data):
    return training.train(data.prepared, trees=12, depth=7)


@pytest.fixture
def duck(tmp_path):
    con = duckdb.connect()
    con.execute("CREATE MACRO gini(a, b) AS (a + b) - (a * a + b * b) / (a + b)")

    def give(name, df):
        df.write.parquet(f"{tmp_path}/{name}")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}/*.parquet'")

    return con, give


def numbered(df, features):
    return model.matrix(df, features, ["_row"]).select(F.col("_row").alias("row"), F.array(*features).alias("x"))


def agree(duck, fitted, rows):
    """The model, the joins and SQL over the node table give each row one score."""
    con, give = duck
    features = fitted.stages[0].getInputCols()
    rows = rows.withColumn("_row", F.row_number().over(Window.orderBy("station_id", "Date")))
    nodes = forest.node_table(fitted)
    give("nodes", nodes)
    give("rows", numbered(rows, features))
    sql = [(r[0], round(r[1], 9)) for r in con.execute(WALK).fetchall()]
    by_joins = forest.score_by_nodes(nodes, rows, features, fitted.stages[-1].getNumTrees, forest.depth(fitted), ["_row"])
    own = model.score(fitted, rows, ["_row"])
    for found in (by_joins, own):
        assert sorted((r._row, round(r.score, 9)) for r in found.collect()) == sql
    assert len(sql) > 3


def test_scored_days(duck, small):
    agree(duck, small.model, small.unseen)


def test_scored_walk(duck, data, small):
    agree(duck, small.model, forecast.feature_rows(forecast.walk(data.seeded, forecast.PREDICT), profile.weekday_profile(data.features)))


def test_importances(duck, data):
    con, give = duck
    fitted = training.ranking_forest(data.prepared, trees=8)
    give("nodes", forest.node_table(fitted))
    sql = {f: round(v, 6) for f, v in con.execute(DECREASES).fetchall()}
    for table in (model.importance_table(fitted), forest.importances(forest.node_table(fitted), fitted.stages[0].getInputCols())):
        assert {r.Feature: round(r.Importance, 6) for r in table.collect() if r.Importance > 0} == {f: v for f, v in sql.items() if v > 0}


def test_routed_rows_are_the_fitted_counts(data):
    """Without a bootstrap the rows that reach a leaf are the ones it was fitted on."""
    rows = data.prepared
    fitted = model.fit_forest(rows, ["Month", "Total_Sold", "Opening_Stock"], trees=3, depth=5, bootstrap=False)
    nodes = forest.node_table(fitted)
    found = forest.leaves_of(nodes, rows, ["Month", "Total_Sold", "Opening_Stock"], 3, forest.depth(fitted), ["station_id"])
    counted = {(r.tree, r.node): r.n for r in found.groupBy("tree", "node").agg(F.count("*").alias("n")).collect()}
    assert counted == {(r.tree, r.node): r.n_rows for r in nodes.where("Feature IS NULL").collect()}


def test_one_leaf(spark):
    rows = spark.createDataFrame([(float(i), 1) for i in range(6)], "x double, Target int")
    fitted = model._pipeline(["x"], numTrees=2, maxDepth=3).fit(rows)
    nodes = forest.node_table(fitted)
    assert forest.depth(fitted) == 0 and nodes.count() == 2
    assert [r.Importance for r in forest.importances(nodes, ["x"]).collect()] == [0.0]
