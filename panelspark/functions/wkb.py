"""Well-known binary polygons as column expressions: bytes to rings of points, without leaving the JVM.

A polygon is a byte order, a type (3), a number of rings, and per ring a number of points and two doubles a point; a
multi-polygon (6) is a number of polygons in that form. Numbers are put together from the hexadecimal form of their bytes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .nulls import as_col

POLYGON, MULTI_POLYGON = 3, 6
RINGS = "array<array<struct<x:double,y:double>>>"
_PLACES = "struct<pos:int,rings:array<struct<at:int,n:int,little:boolean>>>"
_HEADER, _COUNT, _POINT = 5, 4, 16


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is worked out once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _digits(wkb: Column, at: Column, size: int, little: Column) -> Column:
    """Hexadecimal digits of `size` bytes from 0-based `at`, most significant byte first."""
    swapped = lambda d: F.concat(*[F.substring(d, 2 * i + 1, 2) for i in reversed(range(size))])
    return _let(F.hex(F.substring(wkb, at + 1, F.lit(size))), lambda d: F.when(little, swapped(d)).otherwise(d))


def _whole(digits: Column) -> Column:
    return F.conv(digits, 16, 10).cast("bigint")


def _count(wkb: Column, at: Column, little: Column) -> Column:
    """An unsigned 32-bit number, null where the bytes end before it or can't hold that many of anything."""
    fits = lambda n: F.when((n <= F.octet_length(wkb)) & (at + _COUNT <= F.octet_length(wkb)), n).cast("int")
    return _let(_whole(_digits(wkb, at, 4, little)), fits)


def _double(wkb: Column, at: Column, little: Column) -> Column:
    def value(half: Column) -> Column:
        high, low = half["high"], half["low"]
        exponent = F.shiftright(high, 20).bitwiseAND(F.lit(2047))
        fraction = F.shiftleft(high.bitwiseAND(F.lit(0xFFFFF)), 32) + low
        normal = (fraction + F.lit(1 << 52)).cast("double") * F.pow(F.lit(2.0), (exponent - 1075).cast("double"))
        small = fraction.cast("double") * F.pow(F.lit(2.0), F.lit(-1074.0))
        size = F.when(exponent == 0, small).otherwise(normal)
        return F.when(F.shiftright(high, 31) == 1, -size).otherwise(size)

    halves = lambda d: F.struct(_whole(F.substring(d, 1, 8)).alias("high"), _whole(F.substring(d, 9, 8)).alias("low"))
    return _let(_let(_digits(wkb, at, 8, little), halves), value)


def _little(wkb: Column, at: Column) -> Column:
    return F.hex(F.substring(wkb, at + 1, F.lit(1))) == "01"


def _upto(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.expr("array()").cast("array<int>"))


def _polygon(wkb: Column, state: Column) -> Column:
    """The state after a polygon that begins at its position: the position behind it, and its rings' places."""
    at = state["pos"]
    little = _little(wkb, at)
    n_rings = _count(wkb, at + _HEADER, little)
    begin = F.struct(F.when(n_rings.isNotNull(), at + _HEADER + _COUNT).alias("pos"), state["rings"].alias("rings")).cast(_PLACES)

    def ring(s: Column, _: Column) -> Column:
        def after(n: Column) -> Column:
            here = F.struct((s["pos"] + _COUNT).alias("at"), n.alias("n"), little.alias("little"))
            return F.struct((s["pos"] + _COUNT + n * _POINT).alias("pos"), F.concat(s["rings"], F.array(here)).alias("rings")).cast(_PLACES)

        return _let(_count(wkb, s["pos"], little), after)

    return F.aggregate(_upto(n_rings), begin, ring)


def rings_of_wkb(col: Column | str) -> Column:
    """All rings of a two-dimensional polygon or multi-polygon, in the order and orientation of the bytes.

    Null for null, for other types and for bytes that end too early or too late.
    """
    wkb = as_col(col)
    zero, none = F.lit(0), F.expr("array()").cast("array<struct<at:int,n:int,little:boolean>>")
    kind = _whole(_digits(wkb, F.lit(1), 4, _little(wkb, zero)))
    one = _polygon(wkb, F.struct(F.lit(0).alias("pos"), none.alias("rings")).cast(_PLACES))
    n_parts = _count(wkb, F.lit(_HEADER), _little(wkb, zero))
    start = F.struct(F.when(n_parts.isNotNull(), F.lit(_HEADER + _COUNT)).alias("pos"), none.alias("rings")).cast(_PLACES)
    many = F.aggregate(_upto(n_parts), start, lambda s, _: _polygon(wkb, s))
    found = F.when(kind == POLYGON, one).when(kind == MULTI_POLYGON, many)

    def points(place: Column) -> Column:
        at = lambda i: place["at"] + (i - 1) * _POINT
        point = lambda i: F.struct(_double(wkb, at(i), place["little"]).alias("x"), _double(wkb, at(i) + 8, place["little"]).alias("y"))
        return F.transform(_upto(place["n"]), point)

    return _let(found, lambda f: F.when(f["pos"] == F.octet_length(wkb), F.transform(f["rings"], points)).cast(RINGS))
