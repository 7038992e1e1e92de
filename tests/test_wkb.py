"""Well-known binary polygons: bytes to rings, islands and holes in any order."""

import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from panelspark.functions.wkb import RINGS, rings_of_wkb
from panelspark.operators.spatial import EARTH_RADIUS_M, polygon_area


def polygon(rings, order="<", kind=3):
    body = b"".join(struct.pack(f"{order}I", len(r)) + b"".join(struct.pack(f"{order}dd", *p) for p in r) for r in rings)
    return struct.pack(f"{'<' if order == '<' else '>'}BII", order == "<", kind, len(rings)) + body


def multi(parts, order="<", inner=None):
    return struct.pack(f"{order}BII", order == "<", 6, len(parts)) + b"".join(polygon(p, inner or order) for p in parts)


def rings_of(spark, blobs):
    df = spark.createDataFrame([(i, b) for i, b in enumerate(blobs)], "i int, g binary").repartition(2)
    found = {r["i"]: r["rings"] for r in df.select("i", rings_of_wkb("g").alias("rings")).collect()}
    return [None if found[i] is None else [[(p["x"], p["y"]) for p in ring] for ring in found[i]] for i in range(len(blobs))]


def test_bytes_give_the_same_doubles(spark):
    rng = random.Random(1)
    odd = [0.0, -0.0, 1.0, -1.0, 0.1, -85.75, 1e-300, 5e-324, -2.2e-308, 1.7976931348623157e308, 38.2527, 2.0**52 + 1, math.pi]
    shapes = [
        [[(rng.choice(odd), rng.uniform(-180, 180)) for _ in range(rng.randrange(6))] for _ in range(rng.randrange(4))] for _ in range(30)
    ]
    for order in "<>":
        assert rings_of(spark, [polygon(s, order) for s in shapes]) == shapes
    parts = [[shapes[i], shapes[i + 1], shapes[i + 2]] for i in range(0, 27, 3)]
    flat = [[r for p in ps for r in p] for ps in parts]
    assert rings_of(spark, [multi(p) for p in parts]) == flat
    assert rings_of(spark, [multi(p, ">", "<") for p in parts]) == flat  # each polygon names its own byte order
    long = [[(i / 7, -i / 3) for i in range(3000)]]
    assert rings_of(spark, [polygon(long)]) == [long]


def test_other_bytes_are_null(spark):
    square = [[(0, 0), (1, 0), (1, 1), (0, 0)]]
    good = polygon(square)
    assert rings_of(spark, [None, b"", b"\x01", good[:-1], good + b"x", polygon(square, kind=2), polygon(square, kind=1003), b"\x01\x03\0\0\0\xff\xff\xff\xff", b"\x01\x06\0\0\0\xff\xff\xff\xff", multi([])]) == [None] * 9 + [[]]


def box(x, y, w, ccw=True):
    ring = [(x, y), (x + w, y), (x + w, y + w), (x, y + w), (x, y)]
    return ring if ccw else ring[::-1]


@pytest.mark.parametrize("ccw", [True, False])
def test_islands_and_holes_in_any_order(spark, ccw):
    size = lambda y, w: EARTH_RADIUS_M**2 * math.radians(w) * (math.sin(math.radians(y + w)) - math.sin(math.radians(y)))
    outer, hole, island, pond = box(0, 10, 2, ccw), box(0.5, 10.5, 0.5, not ccw), box(5, 10, 2, ccw), box(5.5, 10.2, 0.3, not ccw)
    want = 2 * size(10, 2) - size(10.5, 0.5) - size(10.2, 0.3)
    orders = [[outer, hole, island, pond], [hole, outer, pond, island], [island, outer, hole, pond]]
    rows = [(i, [[{"x": float(x), "y": float(y)} for x, y in r] for r in rings]) for i, rings in enumerate([*orders, [outer, island], [], [[(0, 0), (1, 1)]]])]
    got = [r[0] for r in spark.createDataFrame(rows, f"i int, r {RINGS}").orderBy("i").select(polygon_area("r")).collect()]
    assert got[:3] == pytest.approx([want] * 3, rel=2e-4)  # edges are great circles, the closed form has parallels
    assert got[0] == pytest.approx(got[1], rel=1e-12) and got[0] == pytest.approx(got[2], rel=1e-12)
    assert got[3] == pytest.approx(2 * size(10, 2), rel=2e-4) and got[4:] == [0.0, 0.0]


def test_a_null_geometry_has_no_area(spark):
    df = spark.createDataFrame([(None,)], "g binary").select(polygon_area(rings_of_wkb("g")).alias("a"))
    assert df.filter(F.col("a").isNull()).count() == 1
