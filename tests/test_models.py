"""The forest and the logistic fit against independent ones, and the table of nodes under another engine."""

import hashlib
import random
from types import SimpleNamespace

import duckdb
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from procurisk.config import MODEL_FEATURES, MODEL_TARGET
from procurisk.operators import forest, ranks, training
from procurisk.sources import sinks

FEATURES = ("a", "b", "c", "d", "e")
WEIGHTS = (0.75, 1.5)


def rows_of(seed, n=120):
    choose = random.Random(seed)
    rows = []
    for i in range(n):
        a, b = choose.choice([0.0, 1.0, 2.0, None]), round(choose.gauss(0, 3), 2)
        label = int((a or 0) + b + choose.gauss(0, 1) > 1)
        rows.append((f"v{i % 100}", label, a, b, choose.random(), float(i % 7), 5.0))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, f"key string, label int, {', '.join(f'{c} double' for c in FEATURES)}")


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def brute_forest(rows, trees, depth, bins):
    """{(tree, node): (feature, threshold, weight_0, weight_1)} by plain recursion."""
    table = [(key, label, [0.0 if x is None else x for x in values]) for key, label, *values in rows]
    cuts = []
    for f in range(len(FEATURES)):
        distinct = sorted({values[f] for _, _, values in table})
        places = sorted({j * len(distinct) // bins for j in range(1, bins)} - {0})
        cuts.append([(distinct[i - 1] + distinct[i]) / 2 for i in places])
    found = {}

    def purity(a, b):
        return (a * a + b * b) / (a + b) if a + b else 0.0

    def weigh(some):
        return [sum(k for _, y, _, k in some if y == c) * WEIGHTS[c] for c in (0, 1)]

    def grow(tree, node, level, some):
        total, best = weigh(some), None
        looked = sorted(FEATURES, key=lambda c: md5(f"{tree}|{node}|{c}"))[: int(len(FEATURES) ** 0.5)]
        for f in sorted(FEATURES.index(c) for c in looked):
            for cut in cuts[f] if level < depth else []:
                left = [row for row in some if row[2][f] <= cut]
                right = [row for row in some if row[2][f] > cut]
                if left and right:
                    low = weigh(left)
                    gain = purity(*low) + purity(total[0] - low[0], total[1] - low[1]) - purity(*total)
                    if gain > forest.LEAST_GAIN * sum(total) and (best is None or gain > best[0]):
                        best = (gain, f, cut, left, right)
        found[tree, node] = (FEATURES[best[1]] if best else None, best[2] if best else None, *total)
        if best:
            grow(tree, 2 * node, level + 1, best[3])
            grow(tree, 2 * node + 1, level + 1, best[4])

    for tree in range(1, trees + 1):
        drawn = [(key, label, values, sum(int(md5(f"{tree}|{key}")[:7], 16) >= b for b in forest.DRAW_BOUNDS)) for key, label, values in table]
        drawn = [row for row in drawn if row[3]]
        if drawn:
            grow(tree, 1, 0, drawn)
    return found


@pytest.mark.parametrize("seed,depth,bins", [(1, 3, 8), (2, 5, 32), (3, 0, 4)])
def test_forest_is_grown_as_by_hand(spark, seed, depth, bins):
    rows = rows_of(seed)
    model = forest.fit(frame(spark, rows), "key", "label", FEATURES, WEIGHTS, trees=6, depth=depth, bins=bins)
    got = {(r["tree"], r["node"]): (r["feature"], r["threshold"], r["weight_0"], r["weight_1"]) for r in model.nodes.collect()}
    assert got == brute_forest(rows, 6, depth, bins)


@pytest.fixture(scope="module")
def grown(spark):
    rows = rows_of(5, 100)
    return rows, forest.fit(frame(spark, rows), "key", "label", FEATURES, WEIGHTS, trees=9, depth=4, bins=16)


def test_two_ways_of_scoring_and_another_engine(spark, grown, tmp_path):
    rows, model = grown
    table = frame(spark, rows)
    inside = {r["key"]: r["probability_1"] for r in model.transform(table).collect()}
    joined = {r["key"]: r["probability_1"] for r in model.probabilities(table, "key").collect()}
    sinks.save_model(model, str(tmp_path / "model"))
    table.write.parquet(str(tmp_path / "rows"))
    values = ", ".join(f"'{c}': coalesce({c}, 0)" for c in FEATURES)
    walked = dict(
        duckdb.sql(f"""
            WITH RECURSIVE nodes AS (FROM '{tmp_path}/model/nodes/*.parquet'),
            rows AS (SELECT key, MAP {{{values}}} AS x FROM '{tmp_path}/rows/*.parquet'),
            walk AS (
              SELECT key, x, tree, 1 AS node FROM rows, (SELECT DISTINCT tree FROM nodes)
              UNION ALL SELECT key, x, w.tree, CASE WHEN x[feature] <= threshold THEN left_node ELSE right_node END
              FROM walk w JOIN nodes n ON w.tree = n.tree AND w.node = n.node WHERE feature IS NOT NULL)
            SELECT key, avg(weight_1 / (weight_0 + weight_1)) FROM walk w JOIN nodes n ON w.tree = n.tree AND w.node = n.node
            WHERE feature IS NULL GROUP BY key""").fetchall()
    )
    assert set(inside) == set(joined) == set(walked)
    assert all(abs(inside[k] - joined[k]) < 1e-12 and abs(inside[k] - walked[k]) < 1e-12 for k in inside)
    again = sinks.load_model(spark, str(tmp_path / "model"))
    assert {r["key"]: r["probability_1"] for r in again.transform(table).collect()} == inside
    right = sum((inside[key] > 0.5) == bool(label) for key, label, *_ in rows)
    assert right > 85  # of 100, seen in the fit


@pytest.mark.parametrize("pairs,counters", [(1, 1 << 22), (50, 1), (1 << 21, 0)])
def test_counts_do_not_hinge_on_batches(spark, monkeypatch, pairs, counters):
    """Rows walked a few at a time, and counters kept only where they occur, give the same trees."""
    monkeypatch.setattr(forest, "PAIRS_AT_ONCE", pairs)
    monkeypatch.setattr(forest, "COUNTERS", counters)
    rows = [*rows_of(4), (None, 1, 1.0, 1.0, 1.0, 1.0, 1.0)]  # a row without a key is in no tree
    model = forest.fit(frame(spark, rows[:-1]), "key", "label", FEATURES, WEIGHTS, trees=6, depth=4, bins=8)
    got = {(r["tree"], r["node"]): (r["feature"], r["threshold"], r["weight_0"], r["weight_1"]) for r in model.nodes.collect()}
    assert got == brute_forest(rows[:-1], 6, 4, 8)
    unkeyed = forest.fit(frame(spark, rows[-1:] * 3), "key", "label", FEATURES, WEIGHTS, trees=6, depth=4, bins=8)
    assert unkeyed.nodes.count() == 0


def test_a_level_makes_no_row_for_each_row_and_tree(spark, monkeypatch):
    """What a level hands on is bounded by the counters of a batch; a row for each row and tree, joined level by level, was the cost of a fit."""
    plans = []
    best_splits = forest._best_splits
    monkeypatch.setattr(forest, "_best_splits", lambda counted, *rest: plans.append(counted) or best_splits(counted, *rest))
    forest.fit(frame(spark, rows_of(7)), "key", "label", FEATURES, WEIGHTS, trees=4, depth=3, bins=4)
    assert len(plans) > 2
    for counted in plans:
        plan = counted._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate" not in plan and "Join" not in plan


def test_scoring_walks_batches(spark, grown):
    """A walk by expressions inside each row, node after node, was most of the cost of scoring. Rows keep their columns, repeated rows too."""
    rows, model = grown
    twice = frame(spark, rows[:20] * 2).withColumn("more", F.array(F.col("key")))
    scored = model.transform(twice)
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "lambda" not in plan
    got = scored.collect()
    assert scored.columns == [*twice.columns, "probability_1", "prediction"] and len(got) == 40
    joined = {r["key"]: r["probability_1"] for r in model.probabilities(frame(spark, rows), "key").collect()}
    assert all(abs(r["probability_1"] - joined[r["key"]]) < 1e-12 and r["more"] == [r["key"]] for r in got)
    assert all(r["prediction"] == int(r["probability_1"] > 0.5) for r in got)


def test_scoring_compares_as_spark_does(spark):
    """NaN is above every number, for values and for thresholds; a tree may be a single leaf, and numbers of trees may be left out."""
    nan = float("nan")
    nodes = [(1, 1, 0, "a", 0.0, 2, 3, 2.0, 2.0), (1, 2, 1, None, None, None, None, 1.0, 0.0), (1, 3, 1, None, None, None, None, 0.0, 1.0)]
    nodes += [(3, 1, 0, "b", nan, 2, 3, 2.0, 2.0), (3, 2, 1, None, None, None, None, 3.0, 1.0), (3, 3, 1, None, None, None, None, 0.0, 1.0)]
    nodes += [(4, 1, 0, None, None, None, None, 1.0, 1.0)]
    model = forest.ForestModel(spark.createDataFrame(nodes, forest.NODES), FEATURES)
    rows = [(str(a), 0, a, nan, None, None, None) for a in (-1.0, -0.0, 0.5, nan, float("inf"), None)]
    got = {r["key"]: r["probability_1"] for r in model.transform(frame(spark, rows)).collect()}
    low, high = 0.75 / 3, 1.75 / 3
    assert got == {"-1.0": low, "-0.0": low, "0.5": high, "nan": high, "inf": high, "None": low}
    assert got == {r["key"]: r["probability_1"] for r in model.probabilities(frame(spark, rows), "key").collect()}


def test_forest_on_awkward_tables(spark, grown):
    rows, model = grown
    odd = [("x", 0, None, None, None, None, None), ("x", 1, 1e300, -1e300, 0.0, 0.0, 0.0), (None, 0, 1.0, 1.0, 1.0, 1.0, 1.0)]
    assert all(0 <= r["probability_1"] <= 1 for r in model.transform(frame(spark, odd)).collect())
    assert model.transform(frame(spark, odd).limit(0)).count() == 0
    one_class = forest.fit(frame(spark, [r for r in rows if r[1] == 1]), "key", "label", FEATURES, WEIGHTS, trees=3, depth=3)
    assert [r["feature"] for r in one_class.nodes.collect()] == [None] * 3
    assert {r["probability_1"] for r in one_class.transform(frame(spark, odd)).collect()} == {1.0}
    assert forest.fit(frame(spark, rows).limit(0), "key", "label", FEATURES, WEIGHTS, trees=3, depth=3).nodes.count() == 0


@pytest.fixture(scope="module")
def logistic(spark):
    choose = random.Random(9)
    rows = []
    for i in range(300):
        values = [choose.gauss(0, 1 + j) for j in range(len(MODEL_FEATURES) - 1)] + [3.0]
        rows.append((int(values[0] + choose.gauss(0, 1) > 0.5), 0.6 if i % 2 else 1.4, *values))  # as balanced weights they add up to 300
    columns = ", ".join(f"{c} double" for c in MODEL_FEATURES)
    table = spark.createDataFrame(rows, f"{MODEL_TARGET} int, weight double, {columns}").cache()
    return table, training._logistic(300).fit(table)


def steep(model, table):
    return [r["feature"] for r in training.logistic_gradient(model, table).collect() if abs(r["gradient"]) > 1e-5 * r["scale"]]


def test_gradient_is_zero_only_at_the_optimum(logistic):
    table, model = logistic
    assert steep(model, table) == []
    fitted = model.stages[3]
    weights = fitted.coefficients.toArray().copy()
    weights[4] += 0.01
    moved = SimpleNamespace(coefficients=Vectors.dense(weights), intercept=fitted.intercept)
    assert MODEL_FEATURES[4] in steep(SimpleNamespace(stages=[*model.stages[:3], moved]), table)


# ranks


@pytest.mark.parametrize("ranges", [1, 3, 50])
def test_positions_and_running_totals(spark, ranges):
    choose = random.Random(4)
    rows = [(i, choose.choice([None, 1, 2, 3, 4]), choose.randint(-5, 5)) for i in range(200)]
    table = spark.createDataFrame(rows, "id long, grade int, n int").repartition(5)
    ordered = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    got = ranks.running_totals(table, ["grade", "id"], {"before": F.col("n"), "place": F.lit(1)}, ranges).collect()
    expected, total = {}, 0
    for place, (i, _, n) in enumerate(ordered):
        expected[i] = (total, place)
        total += n
    assert {r["id"]: (r["before"], r["place"]) for r in got} == expected
    positions = ranks.with_positions(table, [F.col("grade").desc(), F.col("id")]).collect()
    falling = sorted(rows, key=lambda r: (-(r[1] or -1), r[0]))
    assert {r["id"]: r["position"] for r in positions} == {r[0]: i for i, r in enumerate(falling, 1)}
    assert ranks.with_positions(table.limit(0), ["id"]).count() == 0


def test_area_of_unrounded_scores(spark):
    """Scores that differ only after the fourth decimal are ranked apart, equal ones count half."""
    choose = random.Random(6)
    rows = [(choose.randint(0, 1), 0.5 + choose.randint(0, 40) * 1e-7) for _ in range(300)]
    pairs = [(p > n) + 0.5 * (p == n) for y, p in rows if y for z, n in rows if not z]
    table = spark.createDataFrame(rows, "label int, score double")
    found = ranks.area_under_roc(training.score_histogram(table, "label", "score")).first()[0]
    assert abs(found - sum(pairs) / len(pairs)) < 1e-12 and abs(found - 0.5) > 1e-6
    assert training.roc_auc(training.score_histogram(table.where("label = 1"), "label", "score")).first()[0] is None
