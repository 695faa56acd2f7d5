"""Overlays, hulls and containment against plain computations."""

import random

import numpy as np
import pytest

from driftline.operators import overlay

RING = "array<struct<x: double, y: double>>"


def inside(rings, x, y):
    """Even-odd over all rings of a shape, for arrays of points."""
    odd = np.zeros(x.shape, bool)
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            if ay != by:
                odd ^= ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
    return odd


def star(rng, n, cx, cy):
    """A ring that crosses itself, mostly."""
    return [(cx + rng.uniform(-5, 5), cy + rng.uniform(-5, 5)) for _ in range(n)]


@pytest.mark.parametrize("width", [1.7, 100.0])
def test_areas_against_sampling(spark, width):
    rng = random.Random(3)
    shapes = {("k", i): [star(rng, 3 + i % 4, rng.uniform(-3, 8), rng.uniform(-3, 8))] for i in range(8)}
    shapes[("k", 3)].append([(0.0, 0.0), (2.0, 0.5), (1.0, 3.0)])  # more rings of one shape: holes where they overlap it
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    shapes |= {("holed", 0): [square, [(1.0, 1.0), (3.0, 1.0), (3.0, 3.0), (1.0, 3.0)]], ("same", 0): [square], ("same", 1): [square], ("bow", 0): [[(0.0, 0.0), (4.0, 4.0), (4.0, 0.0), (0.0, 4.0)]], ("line", 0): [[(0.0, 0.0), (1.0, 1.0)]]}
    rows = [(k, s, ring) for (k, s), rings in shapes.items() for ring in rings]
    got = {r["key"]: r for r in overlay.areas(overlay.slabs(spark.createDataFrame(rows, f"key string, shape long, ring {RING}"), width)).collect()}
    assert "line" not in got
    exact = {"holed": (12, 0), "same": (16, 16), "bow": (8, 0)}
    for key, (union, shared) in exact.items():
        assert (got[key]["union"], got[key]["shared"]) == (pytest.approx(union), pytest.approx(shared))
    n = 1500
    x, y = np.meshgrid(np.linspace(-9, 14, n) + 1e-4, np.linspace(-9, 14, n) + 1e-4)
    depth = sum(inside(rings, x, y).astype(int) for (k, _), rings in shapes.items() if k == "k")
    cell = (23 / (n - 1)) ** 2
    assert got["k"]["union"] == pytest.approx((depth >= 1).sum() * cell, rel=2e-3)
    assert got["k"]["shared"] == pytest.approx((depth >= 2).sum() * cell, rel=2e-3)
    assert got["k"]["most"] == depth.max()


def test_outline_corners(spark):
    cases = {
        "one": ([[(0, 0), (4, 0), (2, 3)]], {(0, 0), (4, 0), (2, 3)}),
        "touching": ([[(0, 0), (2, 0), (2, 2), (0, 2)], [(2, 0), (5, 0), (5, 2), (2, 2)]], {(0, 0), (5, 0), (5, 2), (0, 2)}),
        "diagonal": ([[(0, 0), (2, 0), (2, 2), (0, 2)], [(2, 2), (4, 2), (4, 4), (2, 4)]], {(0, 0), (2, 0), (2, 2), (0, 2), (4, 2), (4, 4), (2, 4)}),
        "crossing": ([[(0, 1), (6, 1), (6, 2), (0, 2)], [(2, 0), (3, 0), (3, 4), (2, 4)]], {(0, 1), (6, 1), (6, 2), (0, 2), (2, 0), (3, 0), (3, 4), (2, 4), (2, 1), (3, 1), (2, 2), (3, 2)}),
    }
    rows = [(k, i, [(float(x), float(y)) for x, y in ring]) for k, (rings, _) in cases.items() for i, ring in enumerate(rings)]
    got = overlay.outline_corners(overlay.slabs(spark.createDataFrame(rows, f"key string, shape long, ring {RING}"), 1.5)).collect()
    for key, (_, corners) in cases.items():
        assert {(r["x"], r["y"]) for r in got if r["key"] == key} == corners


def test_overlapping_rings_and_points(spark):
    rng = random.Random(6)
    rings = {i: star(rng, 3, rng.uniform(-9, 9), rng.uniform(-9, 9)) for i in range(24)}
    table = spark.createDataFrame([(1, i, r) for i, r in rings.items()], f"lake long, id long, ring {RING}")
    got = {(r["left_id"], r["right_id"]): r for r in overlay.overlaps(table.filter("id < 12"), table.filter("id >= 12"), ["lake"], 4.0).collect()}
    x, y = np.meshgrid(np.linspace(-26, 26, 1301) + 1e-4, np.linspace(-26, 26, 1301) + 1e-4)
    cover = {i: inside([r], x, y) for i, r in rings.items()}
    for i in range(12):
        for j in range(12, 24):
            shared, union = ((cover[i] & cover[j]).sum() * 0.04**2, (cover[i] | cover[j]).sum() * 0.04**2)
            if shared > 0.1:
                assert got[i, j]["shared"] == pytest.approx(shared, abs=0.15) and got[i, j]["iou"] == pytest.approx(shared / union, abs=0.03)
            elif shared == 0:
                assert (i, j) not in got or got[i, j]["shared"] < 0.05
    assert len(got) > 8
    points = [(n, rng.uniform(-25, 25), rng.uniform(-25, 25)) for n in range(300)]
    found = overlay.points_in_rings(spark.createDataFrame(points, "n long, x double, y double"), table.select(table.id.alias("ring_id"), "ring"), 4.0)
    wanted = {(n, i) for n, px, py in points for i, r in rings.items() if inside([r], np.array([px]), np.array([py]))[0]}
    assert {(r["n"], r["ring_id"]) for r in found.collect()} == wanted


def test_hulls_merge(spark):
    rng = random.Random(2)
    rows = [("round", rng.gauss(0, 1), rng.gauss(0, 1)) for _ in range(3000)] + [("grid", float(i % 7), float(i // 7)) for i in range(49)] * 3 + [("one", 1.0, 1.0)] * 5 + [("two", 0.0, 0.0), ("two", 1.0, 1.0), (None, 0.0, 0.0), ("one", None, 1.0)]
    got = {r["key"]: r for r in overlay.hulls(spark.createDataFrame(rows, "key string, x double, y double").repartition(7)).collect()}
    assert (got["grid"]["n"], got["grid"]["area"]) == (4, 36.0) and got["one"]["n"] == 1 and (got["two"]["n"], got["two"]["area"]) == (2, 0.0) and got[None]["n"] == 1
    ring = [(p["x"], p["y"]) for p in got["round"]["ring"]]
    pts = np.array([r[1:] for r in rows if r[0] == "round"])
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
        assert ((bx - ax) * (pts[:, 1] - ay) - (by - ay) * (pts[:, 0] - ax) >= -1e-12).all()
    assert set(ring) <= {r[1:] for r in rows if r[0] == "round"}


def test_sides_move_to_their_strips_alone(spark):
    square = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]
    level = spark.createDataFrame([("k", i, [(x + i / 2, y) for x, y in square]) for i in range(3)], "key string, shape long, ring array<struct<x: double, y: double>>")
    tilted = spark.createDataFrame([("k", 9, [(0.0, 0.0), (2.0, 1.0), (0.0, 2.0)])], level.schema)
    assert not overlay.has_slopes(level) and overlay.has_slopes(level.unionByName(tilted))
    moves = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hash")
    gaps = overlay.slabs(level, 1.0, False)
    assert moves(gaps) == 1 and moves(overlay.outline_corners(gaps)) == 2
    assert set(map(tuple, gaps.collect())) == set(map(tuple, overlay.slabs(level, 1.0).collect()))
    assert overlay.areas(gaps).first()["union"] == 2.0 and overlay.outline_corners(gaps).count() == 4
