"""Boosted trees, two-level sums and medians against plain versions."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoweave.functions import medians
from chronoweave.functions.ordered import running_sums
from chronoweave.operators import boosting

ROUNDS, STEP, WIDTH = 3, 0.1, 4


def plain_boosting(bins, y, rounds=ROUNDS):
    """Probabilities of the rows it learnt from, growing each tree's best leaf one at a time."""
    scores = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-scores))
        g, h = p - y, p * (1 - p)

        def split(rows):
            sums = np.zeros((3, WIDTH, boosting.BINS))
            for f in range(WIDTH):
                for k, weight in enumerate((g[rows], h[rows], np.ones(len(rows)))):
                    np.add.at(sums[k, f], bins[rows, f], weight)
            return boosting.best_split(sums)

        leaves = [(split(np.arange(len(y))), np.arange(len(y)))]
        while len(leaves) < boosting.LEAVES and any(found for found, _ in leaves):
            best = max((leaf for leaf in leaves if leaf[0]), key=lambda leaf: leaf[0][0])
            leaves = [leaf for leaf in leaves if leaf is not best]
            (_, feature, cut, missing_left), rows = best
            left = np.where(bins[rows, feature] == 0, missing_left, bins[rows, feature] <= cut)
            leaves += [(split(part), part) for part in (rows[left], rows[~left])]
        for _, rows in leaves:
            scores[rows] -= STEP * g[rows].sum() / h[rows].sum()
    return 1 / (1 + np.exp(-scores))


def test_trees_equal_a_plain_version(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(boosting, "KEEP", 2)
    monkeypatch.setattr(boosting, "ADDERS", 2)
    rng = np.random.default_rng(0)
    x = rng.standard_normal((600, WIDTH))
    x[rng.random(x.shape) < 0.05] = np.nan
    y = ((np.nan_to_num(x[:, 0]) * np.nan_to_num(x[:, 1]) > 0) ^ (rng.random(600) < 0.1)).astype(int)
    names = [f"x{i}" for i in range(WIDTH)]
    rows = [(i, *[None if np.isnan(v) else float(v) for v in x[i]], int(y[i])) for i in range(600)]
    table = spark.createDataFrame(rows, "id int, " + ", ".join(f"{n} double" for n in names) + ", y int").repartition(3)
    half, all_rows = boosting.boosted(table, names, F.col("y"), [F.col("id") < 300, F.col("id") >= 0], rounds=ROUNDS, step=STEP)
    bins = boosting.binned(x, half.edges)
    for model, n in ((half, 300), (all_rows, 600)):
        got = {r["id"]: r["prob_up"] for r in boosting.with_probability(table, model).collect()}
        assert np.allclose([got[i] for i in range(n)], plain_boosting(bins[:n], y[:n]), rtol=0, atol=1e-12)
        assert all(sum(f < 0 for f in tree.feature) <= boosting.LEAVES for tree in model.trees)
    boosting.save_model(spark, half, str(tmp_path / "model"))
    again = boosting.load_model(spark, str(tmp_path / "model"))
    bins = boosting.binned(x, again.edges)
    assert again.features == names and all(np.array_equal(a.scores(bins), b.scores(bins)) for a, b in zip(half.trees, again.trees))


def test_rows_without_a_split_keep_the_share(spark):
    table = spark.createDataFrame([(float(i % 2), i % 2) for i in range(10)], "x double, y int")
    model = boosting.boosted(table, ["x"], F.col("y"), [F.lit(True)], rounds=1)[0]
    assert {round(r["prob_up"], 12) for r in boosting.with_probability(table, model).collect()} == {0.5}


def test_running_sums_in_buckets(spark):
    random.seed(1)
    rows = [(k, i, random.randint(-5, 5)) for k in "ab" for i in range(40)]
    table = spark.createDataFrame(rows, "k string, i int, v int").repartition(4)
    got = {(r["k"], r["i"]): r["total"] for r in running_sums(table, ["k"], [F.col("i")], F.floor(F.col("i") / 7), {"total": F.col("v")}).collect()}
    for key in "ab":
        total = 0
        for k, i, v in rows:
            if k == key:
                total += v
                assert got[key, i] == total


@pytest.mark.parametrize("ranges", [2, 64])
def test_medians_by_ranges(spark, monkeypatch, ranges):
    monkeypatch.setattr(medians, "RANGES", ranges)
    monkeypatch.setattr(medians, "_MARGIN", 0.4)  # most values are inside the bracket
    random.seed(ranges)
    groups = {"one": [3.0], "two": [1.0, 2.0], "ties": [5.0] * 9 + [1.0, 7.0], "many": [random.choice([random.random(), 0.5]) for _ in range(500)]}
    table = spark.createDataFrame([(k, v) for k, held in groups.items() for v in held] + [("many", None)], "k string, v double")
    got = {r["k"]: r["m"] for r in medians.exact_medians(table, ["k"], {"m": F.col("v")}).collect()}
    assert got == {k: statistics.median(held) for k, held in groups.items()}
