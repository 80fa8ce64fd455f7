"""Neighbour-based mutual information against all-pairs versions."""

import math
import random

import numpy as np
import pytest

from kestrel.operators import neighbours as NB
from kestrel.operators import ordering as O


def psi(n):
    return -0.5772156649015329 + sum(1 / i for i in range(1, n))


def by_class(x, label, k):
    keep = [i for i in range(len(x)) if label.count(label[i]) > 1]
    total = 0.0
    for i in keep:
        own = sorted(abs(x[i] - x[j]) for j in keep if j != i and label[j] == label[i])
        kk = min(k, len(own))
        inside = sum(abs(x[i] - x[j]) < own[kk - 1] for j in keep)
        total += psi(kk) - psi(len(own) + 1) - psi(inside)
    return max(0.0, psi(len(keep)) + total / len(keep))


def in_plane(x, y, k):
    x, y = np.array(x), np.array(y)
    s, total = y.std(ddof=1) / x.std(ddof=1), 0.0
    for i in range(len(x)):
        dx, dy = np.abs(x - x[i]), np.abs(y - y[i])
        d = np.maximum(dx * s, dy)
        j = np.argsort(d)[k]
        rx, ry = (dx[j], dx[j] * s) if dx[j] * s >= dy[j] else (dy[j] / s, dy[j])
        total += psi(int((dx < rx).sum())) + psi(int((dy < ry).sum()))
    return max(0.0, psi(len(x)) + psi(k) - total / len(x))


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(2)
    out = []
    for i in range(600):
        a, label = rnd.gauss(0, 1), rnd.choice(["p", "q", "q", "r"])
        out.append((i, a + (label == "p") * 2, rnd.gauss(0, 3) if rnd.random() > 0.05 else None, a * a + rnd.gauss(0, 0.2), label,
                    a + rnd.gauss(0, 0.3) if rnd.random() > 0.05 else float("nan")))
    return out + [(600, 1.0, 1.0, 1.0, "only one", 5.0), (601, 1.0, 1.0, 1.0, None, 50.0)]


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "id long, a double, b double, c double, label string, y double")


def test_digamma(spark):
    got = spark.range(1, 400).select(NB.digamma("id")).collect()
    assert all(abs(r[0] - psi(i)) < 1e-10 for i, r in enumerate(got, 1))


@pytest.mark.parametrize("block_rows", [None, 50])
@pytest.mark.parametrize("k", [1, 3])
def test_class_form_equals_all_pairs(spark, rows, table, k, block_rows, monkeypatch):
    if block_rows:
        monkeypatch.setattr(O.neighbours, "__defaults__", (block_rows,))
        monkeypatch.setattr(O.running_sum, "__defaults__", (block_rows,))
    got = {r.feature: r.mi for r in NB.against_class(table, ["a", "b", "c"], "label", "id", k).collect()}
    for c, at in (("a", 1), ("b", 2), ("c", 3)):
        use = [r for r in rows if r[at] is not None and r[4] is not None]
        assert abs(got[c] - by_class([r[at] for r in use], [r[4] for r in use], k)) < 1e-9
    assert got["a"] > 0.2 and got["b"] < 0.1


@pytest.mark.parametrize("strip", [4096, 20])
def test_plane_form_equals_all_pairs(rows, table, strip, monkeypatch):
    monkeypatch.setattr(NB, "STRIP_ROWS", strip)
    got = {r.feature: r.mi for r in NB.against_target(table, ["a", "b", "c"], "y", "id", 3).collect()}
    for c, at in (("a", 1), ("b", 2), ("c", 3)):
        use = [r for r in rows if r[at] is not None and not math.isnan(r[5])]
        assert abs(got[c] - in_plane([r[at] for r in use], [r[5] for r in use], 3)) < 1e-9
    assert got["a"] > 0.3 and got["b"] < 0.1


def test_rows_of_few_values_ask_few_cells():
    """A column of few values and small jitter: most neighbourhoods stay in their cell, at any number of rows."""
    for n in (8_000, 64_000):
        rng = np.random.default_rng(1)
        x, y = rng.integers(0, 10, n) + rng.random(n) * 1e-9, rng.random(n) * 100
        some = np.flatnonzero(rng.random(n) < 32 / 500)
        cuts = NB.cell_cuts(x[some], y[some], 10.0, n // 500)
        row, cell = NB.cells_reached(cuts, x, x, y, y)
        assert len(row) == n and np.bincount(cell).max() < 1500
        r = 4 * 1000 / n                                     # as far as about 4 rows of the value
        reached, _ = NB.cells_reached(cuts, x - r / 10, x + r / 10, y - r, y + r)
        assert len(reached) < 1.15 * n


def test_discrete_feature_against_a_continuous_target(rows, table):
    got = {r.feature: r.mi for r in NB.against_target(table, ["a", "label"], "y", "id", 3, discrete=["label"]).collect()}
    use = [r for r in rows if r[4] is not None and not math.isnan(r[5])]
    assert abs(got["label"] - by_class([r[5] for r in use], [r[4] for r in use], 3)) < 1e-9


def test_ties_are_told_apart_the_same_way_on_any_layout(spark):
    df = spark.createDataFrame([(i, float(i % 5), float(i % 3), i % 5 > 2) for i in range(400)], "id long, x double, y double, label boolean")
    scores = {tuple(round(r.mi, 12) for r in NB.against_class(df.repartition(n), ["x", "y"], "label", "id").orderBy("feature").collect()) for n in (1, 5)}
    assert len(scores) == 1 and next(iter(scores))[0] > 0.5 > next(iter(scores))[1]


def test_rows_at_the_same_place_are_told_apart(spark):
    """Four and more rows at one jittered value: the estimate stays that of the classes, whatever the number of places."""
    rnd = random.Random(5)
    rows = [(i, f, rnd.choice([0.0, 0.5, 1.0]), i % 2) for f in ("few", "one") for i in range(2000)]
    rows = [(i, f, x if f == "few" else 7.0, int(x > 0.2) if f == "few" else lab) for i, f, x, lab in rows]
    points = spark.createDataFrame(rows, "key long, feature string, x double, label int")        # no jitter: all rows of a value share a place
    got = {r.feature: r.mi for r in NB._by_class(points, 3).collect()}
    share = sum(r[3] for r in rows[:2000]) / 2000
    entropy = -share * math.log(share) - (1 - share) * math.log(1 - share)
    assert abs(got["few"] - entropy) < 0.02 and got["one"] < 0.05
    # The same key many times: nothing tells the rows apart, and they count as one place.
    same = spark.createDataFrame([(1, "a", 2.0, i % 2) for i in range(12)], "key long, feature string, x double, label int")
    assert NB._by_class(same, 3).first().mi is not None


def test_small_and_constant_columns(spark):
    df = spark.createDataFrame([(1, 1.0, None, 2.0, "a"), (2, 1.0, None, 3.0, "b")], "id long, x double, e double, y double, label string")
    assert {r.feature: r.mi for r in NB.against_class(df, ["x", "e"], "label", "id").collect()} == {"x": None, "e": None}
    assert {r.feature: r.mi for r in NB.against_target(df, ["x", "e"], "y", "id").collect()} == {"x": None, "e": None}
