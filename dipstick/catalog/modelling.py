"""M, J06, T03, T06 and F15: features for training, forests, balancing and metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dipstick.catalog.base import query
from dipstick.catalog.sources import scored
from dipstick.catalog.sql import DECIDED, FEATURES, LEDGER, SCORED, over, rnd, walk
from dipstick.config import ENGINEERED, PRODUCTS
from dipstick.functions import numeric
from dipstick.operators import clean, features, forecast, forest, metrics, model, profile, smote, timeline
from dipstick.plans import reports


@query("m01_importance_forest")
def importance_forest(data):
    """The ranking forest at its full size: (Feature, Importance), largest first."""
    return data.ranked


@query("m02_importance_table")
def importance_table(data):
    """Features kept and dropped by the 1 % threshold, largest importance first."""
    ranked = data.ranked
    kept = model.select_features(ranked).withColumn("selected", F.lit(True))
    return kept.unionByName(model.dropped_features(ranked).withColumn("selected", F.lit(False))).orderBy(
        F.desc("Importance"), "Feature"
    )


@query(
    "m02_importances_hold",
    "SELECT CAST(count(*) AS BIGINT) AS n_features, true AS sums_to_one, 'Opening_Stock' AS strongest FROM (VALUES "
    + ", ".join("(0)" for _ in range(19)) + ") AS t(x)",
)
def importances_hold(data):
    """Every candidate is ranked, shares sum to one, and the opening stock leads as published."""
    return data.ranked.agg(
        F.count("*").alias("n_features"),
        (F.abs(F.sum("Importance") - 1) < 1e-9).alias("sums_to_one"),
        F.max_by("Feature", "Importance").alias("strongest"),
    )


_CANDIDATES = ("Cash", "Card", "DayOfWeek", "Day_Num", "HSD1_Sold", "HSD2_Sold", "HSD3_Sold", "Is_Festival_Month", "Is_Monsoon_Month",
               "Is_Weekend", "MS_Sold", "Month", "Online", "Opening_Stock", "Prev_Closing", "Quarter", "Rolling_7d_Sales", "Total_Sold", "Year")


@query(
    "m02_importances_by_nodes",
    "SELECT Feature, true AS as_ranked FROM (VALUES " + ", ".join(f"('{f}')" for f in _CANDIDATES) + ") AS t(Feature)",
)
def importances_by_nodes(data):
    """Importances recomputed from the impurity of nodes and their children, beside those of the fitted model."""
    names = data.ranking.stages[0].getInputCols()
    again = forest.importances(forest.node_table(data.ranking), names).withColumnRenamed("Importance", "again")
    return data.ranked.join(again, "Feature").select("Feature", (F.abs(F.col("Importance") - F.col("again")) < 1e-6).alias("as_ranked"))


# Product litres over total litres stand for importances: exact, and different per station.
_SHARES = """, shares AS (SELECT station_id, f AS Feature, s AS Importance FROM (
  SELECT station_id, unnest(['MS_Sold', 'HSD1_Sold', 'HSD2_Sold', 'HSD3_Sold']) AS f,
    unnest([sum(MS_Sold), sum(HSD1_Sold), sum(HSD2_Sold), sum(HSD3_Sold)]) / sum(Total_Sold) AS s FROM ledger GROUP BY 1))"""


def _shares(data) -> DataFrame:
    sums = data.ledger.groupBy("station_id").agg(*[F.sum(c).alias(c) for c in (*PRODUCTS, "Total_Sold")])
    entries = [F.struct(F.lit(c).alias("Feature"), (F.col(c) / F.col("Total_Sold")).alias("Importance")) for c in PRODUCTS]
    return sums.select("station_id", F.inline(F.array(*entries)))


def _rounded_shares(df: DataFrame) -> DataFrame:
    return df.withColumn("Importance", numeric.half_even(F.col("Importance"), 6))


@query(
    "t03_importance_order",
    over(
        LEDGER + _SHARES,
        f"""SELECT station_id, Feature, {rnd('Importance', 6)} AS Importance,
          CAST(row_number() OVER (PARTITION BY station_id ORDER BY Importance DESC) AS INTEGER) AS falling,
          CAST(row_number() OVER (PARTITION BY station_id ORDER BY Importance) AS INTEGER) AS rising FROM shares""",
    ),
)
def importance_order(data):
    orders = {"falling": F.desc("Importance"), "rising": F.asc("Importance")}
    ranks = {n: F.row_number().over(timeline.station().orderBy(o)) for n, o in orders.items()}
    return _rounded_shares(_shares(data).withColumns(ranks))


@query(
    "t06_threshold_selection",
    over(LEDGER + _SHARES, f"SELECT station_id, Feature, {rnd('Importance', 6)} AS Importance, Importance >= 0.2 AS selected FROM shares"),
)
def threshold_selection(data):
    shares = _shares(data)
    kept = model.select_features(shares, 0.2).withColumn("selected", F.lit(True))
    return _rounded_shares(kept.unionByName(model.dropped_features(shares, 0.2).withColumn("selected", F.lit(False))))


@query(
    "j06_importance_by_name",
    over(LEDGER + _SHARES, f"SELECT station_id, Feature, {rnd('Importance', 6)} AS Importance FROM shares WHERE Importance >= 0.2"),
)
def importance_by_name(data):
    """Names of selected features looked up in the importance table."""
    shares = _shares(data)
    selected = model.select_features(shares, 0.2).select("station_id", "Feature")
    return _rounded_shares(selected.join(shares, ["station_id", "Feature"]))


@query(
    "m03_split",
    over(
        LEDGER,
        """SELECT station_id, "Date", Target, CASE WHEN rn <= floor(count(*) OVER (PARTITION BY station_id) * CAST(0.8 AS DOUBLE)) THEN 'train' ELSE 'test' END AS split FROM ledger""",
    ),
)
def split(data):
    return timeline.chronological_split(data.ledger).select("station_id", "Date", "Target", "split")


def _train(data) -> DataFrame:
    table = timeline.chronological_split(data.ledger)
    return table.where(F.col("split") == "train").drop("split")


_SMOTE_FEATURES = ("Opening_Stock", "Total_Sold", "Dip")


@query("m04_synthetic_rows")
def synthetic_rows(data):
    """Synthetic refill days with their base, neighbour and position on the segment."""
    return smote.synthetic_rows(_train(data), _SMOTE_FEATURES)


@query(
    "m04_synthetic_rows_hold",
    over(
        LEDGER,
        """, part AS (SELECT station_id, Target, rn <= floor(count(*) OVER (PARTITION BY station_id) * CAST(0.8 AS DOUBLE)) AS train FROM ledger)
        SELECT station_id, d AS made, d AS of_the_minority, d AS on_the_segment, d AS near FROM (
          SELECT station_id, abs(count(*) FILTER (WHERE Target = 1) - count(*) FILTER (WHERE Target = 0)) AS d FROM part WHERE train GROUP BY 1)""",
    ),
)
def synthetic_rows_hold(data):
    """How many synthetic rows there are, and for how many each promise holds."""
    train = _train(data)
    made = smote.synthetic_rows(train, _SMOTE_FEATURES)
    ends = [
        train.select("station_id", F.col("Date").alias(day), F.col("Target").alias(f"{day}_class"),
                     *[F.col(f).alias(f"{day}_{f}") for f in _SMOTE_FEATURES])
        for day in ("base", "neighbour")
    ]
    near = smote.neighbours(smote.minority_rows(train), _SMOTE_FEATURES).select(
        "station_id", F.col("Date").alias("base"), "neighbour", F.lit(True).alias("is_near")
    )
    checked = made.join(ends[0], ["station_id", "base"]).join(ends[1], ["station_id", "neighbour"]).join(
        near, ["station_id", "base", "neighbour"], "left"
    )
    on_segment = reduce(
        lambda a, b: a & b,
        [F.abs(F.col(f) - F.col(f"base_{f}") - F.col("u") * (F.col(f"neighbour_{f}") - F.col(f"base_{f}"))) < 1e-6
         for f in _SMOTE_FEATURES],
    )
    same_class = (F.col("Target") == F.col("base_class")) & (F.col("Target") == F.col("neighbour_class"))
    return checked.groupBy("station_id").agg(
        F.count("*").alias("made"),
        F.count_if(same_class).alias("of_the_minority"),
        F.count_if(on_segment & F.col("u").between(0, 1)).alias("on_the_segment"),
        F.count_if(F.col("is_near")).alias("near"),
    )


@query(
    "m04_balanced_classes",
    over(
        LEDGER,
        """, part AS (SELECT station_id, Target, rn <= floor(count(*) OVER (PARTITION BY station_id) * CAST(0.8 AS DOUBLE)) AS train FROM ledger)
        SELECT station_id, CAST(c AS INTEGER) AS Target, greatest(count(*) FILTER (WHERE Target = 0), count(*) FILTER (WHERE Target = 1)) AS n
        FROM part, range(2) AS t(c) WHERE train GROUP BY 1, 2""",
    ),
)
def balanced_classes(data):
    balanced = smote.balance(_train(data), _SMOTE_FEATURES)
    return balanced.groupBy("station_id", "Target").agg(F.count("*").alias("n"))


@query(
    "m05_class_weights",
    over(LEDGER, "SELECT station_id, Target, count(*) AS n, sum(count(*)) OVER (PARTITION BY station_id) / (2 * count(*)) AS weight FROM ledger GROUP BY 1, 2"),
)
def class_weights(data):
    return model.class_weights(data.ledger, ["station_id"])


@query(
    "m05_weights_of_all_days",
    over(LEDGER, "SELECT Target, count(*) AS n, (SELECT count(*) FROM ledger) / (2 * count(*)) AS weight FROM ledger GROUP BY 1"),
)
def weights_of_all_days(data):
    return model.class_weights(data.ledger)


@query("m06_trained_forest")
def trained_forest(data):
    """The classifier at its full size: metrics on the last fifth of every station's days."""
    return data.trained.metrics


@query(
    "m06_beats_majority",
    over(LEDGER, "SELECT DISTINCT station_id, true AS beats_majority FROM ledger"),
)
def beats_majority(data):
    """Whether the classifier is right more often than always naming the commoner class."""
    hit = (F.col("Target") == F.col("prediction")).cast("int")
    rates = data.trained.scored.groupBy("station_id").agg(
        F.avg(hit).alias("accuracy"), F.avg("Target").alias("refills")
    )
    return rates.select(
        "station_id", (F.col("accuracy") > F.greatest(F.col("refills"), 1 - F.col("refills"))).alias("beats_majority")
    )


# One tree over the month alone, of all rows, splits until no month is left with another class, so that SQL
# knows what it predicts. (Leaves of one class are merged, so their shares are not those of single months.)
_MONTH_TREE = """, part AS (SELECT *, month("Date") AS m, rn <= floor(count(*) OVER (PARTITION BY station_id) * CAST(0.8 AS DOUBLE)) AS train FROM ledger),
weighed AS (SELECT m, Target, CAST((SELECT count(*) FROM part WHERE train) AS DOUBLE) / (2 * count(*) OVER (PARTITION BY Target)) AS w FROM part WHERE train),
rates AS (SELECT m, coalesce(sum(w) FILTER (WHERE Target = 1), 0) / sum(w) AS p FROM weighed GROUP BY m)
"""


@query(
    "m06_month_tree",
    over(
        LEDGER + _MONTH_TREE,
        """SELECT station_id, "Date", Target, CAST(p > 0.5 AS INTEGER) AS prediction FROM part JOIN rates USING (m) WHERE NOT train""",
    ),
)
def month_tree(data):
    """Class of unseen days by a weighted forest of one tree over the month: fitting and scoring, exactly."""
    table = timeline.chronological_split(data.ledger).withColumn("Month", F.month("Date"))
    known, unseen = (table.where(F.col("split") == part) for part in ("train", "test"))
    tree = model.fit_forest(known, ["Month"], trees=1, min_leaf=1, bootstrap=False)
    return model.score(tree, unseen).select("station_id", "Date", "Target", "prediction")


@query(
    "m06_node_table",
    "SELECT CAST(t AS INTEGER) AS tree, CAST(1 AS BIGINT) AS leaves_over_splits, true AS children_found, true AS weights_add_up, true AS leaves_large_enough FROM range(200) AS r(t)",
)
def node_table(data):
    """The classifier as a table of nodes: each of its 200 trees is one binary tree whose weights add up."""
    return forest.structure(data.nodes, 3)


def _by_nodes(data, rows: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    fitted = data.trained.model
    return forest.score_by_nodes(data.nodes, rows, fitted.stages[0].getInputCols(), fitted.stages[-1].getNumTrees, forest.depth(fitted), keep)


def _beside(found: DataFrame, again: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    other = again.select(*keep, *[F.col(c).alias(f"_{c}") for c in ("prediction", "score", "confidence")])
    near = [F.abs(F.col(c) - F.col(f"_{c}")) < 1e-9 for c in ("score", "confidence")]
    even = F.abs(F.col("score") - 0.5) < 1e-9
    return found.join(other, list(keep)).select(*keep, (near[0] & near[1] & (even | (F.col("prediction") == F.col("_prediction")))).alias("as_scored"))


@query(
    "m07_scores_by_nodes",
    over(
        LEDGER,
        """, part AS (SELECT *, rn > floor(count(*) OVER (PARTITION BY station_id) * CAST(0.8 AS DOUBLE)) AS test FROM ledger)
        SELECT station_id, "Date", Target, true AS as_scored FROM part WHERE test""",
    ),
)
def scores_by_nodes(data):
    """Every unseen day walked through the node table by joins: class, probability and confidence as the model gives them."""
    keep = ("station_id", "Date", "Target")
    return _beside(data.trained.scored, _by_nodes(data, data.trained.unseen, keep), keep)


@query("m07_scored_days")
def scored_days(data):
    """Class, probability and confidence of the unseen days."""
    return data.trained.scored


@query(
    "m07_scores_hold",
    over(
        LEDGER,
        """, part AS (SELECT *, rn > floor(count(*) OVER (PARTITION BY station_id) * CAST(0.8 AS DOUBLE)) AS test FROM ledger)
        SELECT station_id, count(*) AS n_days, count(*) AS consistent FROM part WHERE test GROUP BY 1""",
    ),
)
def scores_hold(data):
    """Unseen days scored, and those whose class and confidence agree with the probability."""
    p, confidence = F.col("score"), F.col("confidence")
    agrees = (F.col("prediction") == F.when(p > 0.5, 1).otherwise(0)) & (
        F.abs(confidence - F.greatest(p, 1 - p)) < 1e-9
    )
    return data.trained.scored.groupBy("station_id").agg(
        F.count("*").alias("n_days"), F.count_if(agrees).alias("consistent")
    )


@query("f15_scored_walk")
def scored_walk(data):
    """Every simulated day scored by the model in one batch."""
    walked = forecast.walk(data.seeded, forecast.PREDICT)
    return reports.scored_walk(data.trained.model, walked, profile.weekday_profile(data.features))


@query(
    "f15_scores_hold",
    over(walk(30, stop=True), "SELECT station_id, count(*) AS n_days, count(*) AS consistent FROM path GROUP BY 1"),
)
def walk_scores_hold(data):
    """Simulated days scored, and those whose label and confidence agree with the probability."""
    p = F.col("Refill_Prob")
    label = F.when(p >= 0.5, "REFILL").otherwise("No")
    near_even = F.abs(p - 0.5) <= 0.0005
    agrees = ((F.col("Model_Says") == label) | near_even) & (F.abs(F.col("confidence") - F.greatest(p, 1 - p)) <= 0.0005)
    return scored_walk(data).groupBy("station_id").agg(
        F.count("*").alias("n_days"), F.count_if(agrees).alias("consistent")
    )


@query(
    "f15_scores_by_nodes",
    over(walk(30, stop=True), 'SELECT station_id, "Date", true AS as_scored FROM path'),
)
def walk_scores_by_nodes(data):
    """Every simulated day walked through the node table by joins, beside the model's own scores."""
    rows = forecast.feature_rows(forecast.walk(data.seeded, forecast.PREDICT), profile.weekday_profile(data.features))
    keep = ("station_id", "Date")
    return _beside(model.score(data.trained.model, rows, keep), _by_nodes(data, rows, keep), keep)


@query(
    "f15_prediction_with_model",
    over(
        walk(30, stop=True) + DECIDED,
        "SELECT station_id, refill_date, days_remaining, triggered, closing_stock, true AS confident FROM decided",
    ),
)
def prediction_with_model(data):
    """The refill decision with the model's confidence on the last simulated day, at least one half."""
    decision = reports.predict_with_model(data.trained.model, data.features, data.multipliers)
    return decision.select(
        "station_id", "refill_date", "days_remaining", "triggered", "closing_stock",
        (F.col("confidence").between(0.5, 1) & (F.col("confidence") != 0.91)).alias("confident"),
    )


@query("m08_accuracy", over(SCORED, f"SELECT station_id, {rnd('avg(CAST(Target = prediction AS INTEGER))', 6)} AS accuracy FROM scored GROUP BY 1"))
def accuracy(data):
    return metrics.accuracy(scored(data)).withColumn("accuracy", numeric.half_even(F.col("accuracy"), 6))


@query(
    "m09_f1",
    over(
        SCORED,
        f"""SELECT station_id, {rnd('2 * p * r / (p + r)', 6)} AS f1_score FROM (SELECT station_id,
          sum(Target * prediction) / sum(prediction) AS p, sum(Target * prediction) / sum(Target) AS r FROM scored GROUP BY 1)""",
    ),
)
def f1(data):
    return metrics.f1_score(scored(data)).withColumn("f1_score", numeric.half_even(F.col("f1_score"), 6))


# The pairwise definition: how often a refill day scores above another day, ties half.
_PAIRS = """SELECT {by}{sum} AS roc_auc
  FROM (SELECT station_id, score, count(*) AS k FROM scored WHERE Target = 1 GROUP BY 1, 2) p
  JOIN (SELECT station_id, score, count(*) AS k FROM scored WHERE Target = 0 GROUP BY 1, 2) n ON {on} {group}"""
_AREA = rnd("sum(CASE WHEN p.score > n.score THEN 2 * p.k * n.k WHEN p.score = n.score THEN p.k * n.k ELSE 0 END) / (2 * sum(p.k * n.k))", 6)


@query("m10_roc_auc", over(SCORED, _PAIRS.format(by="p.station_id, ", sum=_AREA, on="p.station_id = n.station_id", group="GROUP BY 1")))
def roc_auc(data):
    return metrics.roc_auc(scored(data)).withColumn("roc_auc", numeric.half_even(F.col("roc_auc"), 6))


@query("m10_roc_auc_overall", over(SCORED, _PAIRS.format(by="", sum=_AREA, on="true", group="")))
def roc_auc_overall(data):
    return metrics.roc_auc(scored(data), by=()).withColumn("roc_auc", numeric.half_even(F.col("roc_auc"), 6))


_P0, _P1 = "tn / (tn + fn)", "tp / (tp + fp)"
_R0, _R1 = "tn / (tn + fp)", "tp / (tp + fn)"


def _f(p: str, r: str) -> str:
    return f"2 * ({p}) * ({r}) / (({p}) + ({r}))"


def _report_row(label: str, values: tuple[str, str, str], support: str) -> str:
    p, r, f = (rnd(v, 4) for v in values)
    return f"SELECT station_id, '{label}' AS label, {p} AS precision, {r} AS recall, {f} AS f1_score, {support} AS support FROM cells"


def _mixed(a: str, b: str, weighted: bool) -> str:
    return f"(({a}) * (tn + fp) + ({b}) * (tp + fn)) / (tn + fp + fn + tp)" if weighted else f"(({a}) + ({b})) / 2"


_HIT = "(tn + tp) / (tn + fp + fn + tp)"
_CELLS = """, cells AS (SELECT station_id, count(*) FILTER (WHERE Target = 0 AND prediction = 0) AS tn, count(*) FILTER (WHERE Target = 0 AND prediction = 1) AS fp,
  count(*) FILTER (WHERE Target = 1 AND prediction = 0) AS fn, count(*) FILTER (WHERE Target = 1 AND prediction = 1) AS tp FROM scored GROUP BY 1)"""


@query(
    "m11_classification_report",
    over(
        SCORED + _CELLS,
        " UNION ALL ".join(
            [
                _report_row("No Refill", (_P0, _R0, _f(_P0, _R0)), "tn + fp"),
                _report_row("Refill", (_P1, _R1, _f(_P1, _R1)), "tp + fn"),
                _report_row("accuracy", (_HIT, _HIT, _HIT), "tn + fp + fn + tp"),
                *[
                    _report_row(
                        name,
                        (_mixed(_P0, _P1, w), _mixed(_R0, _R1, w), _mixed(_f(_P0, _R0), _f(_P1, _R1), w)),
                        "tn + fp + fn + tp",
                    )
                    for name, w in (("macro avg", False), ("weighted avg", True))
                ],
            ]
        ),
    ),
)
def classification_report(data):
    return metrics.classification_report(scored(data))


@query("m12_confusion", over(SCORED + _CELLS, "SELECT * FROM cells"))
def confusion(data):
    return metrics.confusion(scored(data))


_CURVE = """, counts AS (SELECT {by} score, count(*) FILTER (WHERE Target = 1) AS p, count(*) FILTER (WHERE Target = 0) AS n FROM scored GROUP BY {by} score),
curve AS (SELECT *, sum(p) OVER w AS cp, sum(n) OVER w AS cn, sum(p) OVER (PARTITION BY {by_or_one}) AS ap, sum(n) OVER (PARTITION BY {by_or_one}) AS an,
  lead(p) OVER w AS np, lead(n) OVER w AS nn, row_number() OVER w AS place FROM counts WINDOW w AS (PARTITION BY {by_or_one} ORDER BY score DESC))
SELECT {by} score AS threshold, {fpr} AS fpr, {tpr} AS tpr FROM curve WHERE {keep}
UNION ALL SELECT DISTINCT {by} CAST(NULL AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM scored"""


def _curve_sql(by: str, drop: bool) -> str:
    keep = "place = 1 OR np IS NULL OR np <> p OR nn <> n" if drop else "true"
    return over(SCORED, _CURVE.format(by=f"{by}," if by else "", by_or_one=by or "1", keep=keep, fpr=rnd("cn / an", 6), tpr=rnd("cp / ap", 6)))


@query("m13_roc_points", _curve_sql("station_id", True))
def roc_points(data):
    return metrics.roc_points(scored(data))


@query("m13_roc_points_all", _curve_sql("station_id", False))
def roc_points_all(data):
    return metrics.roc_points(scored(data), drop_collinear=False)


@query("m13_roc_points_overall", _curve_sql("", True))
def roc_points_overall(data):
    return metrics.roc_points(scored(data), by=())


@query(
    "m14_metrics_record",
    over(
        SCORED + _CELLS,
        f""", area AS ({_PAIRS.format(by="p.station_id, ", sum=_AREA, on="p.station_id = n.station_id", group="GROUP BY 1")})
        SELECT c.station_id, {rnd(_HIT, 4)} AS accuracy, {rnd('2 * tp / (2 * tp + fp + fn)', 4)} AS f1_score, {rnd('roc_auc', 4)} AS roc_auc
        FROM cells c JOIN area ON area.station_id = c.station_id""",
    ),
)
def metrics_record(data):
    return metrics.metrics_record(scored(data))


@query(
    "m15_training_features",
    over(
        FEATURES + f""", trained AS (SELECT station_id, "Date", Lag1_Total_Sold, Lag2_Total_Sold, Lag1_Closing, DOW_Avg_Sales, Days_Since_Refill, mean_sold,
          {rnd('avg(Total_Sold) OVER (PARTITION BY station_id ORDER BY "Date" ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)', 0)} AS r FROM feat)""",
        f"""SELECT station_id, "Date", {", ".join(f"{rnd(c, 6)} AS {c}" for c in ENGINEERED if c not in ("Sales_Trend", "Days_Since_Refill"))},
        {rnd('r / mean_sold', 4)} AS Sales_Trend, Days_Since_Refill FROM trained""",
    ),
)
def training_features(data):
    table = features.training_features(data.prepared)
    exact = ("Sales_Trend", "Days_Since_Refill")
    return table.select(
        "station_id", "Date",
        *[(F.col(c) if c in exact else numeric.half_even(F.col(c), 6)).alias(c) for c in ENGINEERED],
    )
