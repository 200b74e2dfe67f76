"""Array, edge and hash expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def edges_at_most(edges: Column, x: Column) -> Column:
    """How many edges are at most x: the place to insert x after equal edges."""
    return F.size(F.filter(edges, lambda e: e <= x))


def edges_under(edges: Column, x: Column) -> Column:
    """How many edges are under x: the place to insert x before equal edges."""
    return F.size(F.filter(edges, lambda e: e < x))


def snap_down(edges: Column, x: Column) -> Column:
    """The largest edge at most x; null beyond the outermost, which stands for no bound."""
    return F.array_max(F.filter(edges, lambda e: e <= x))


def snap_up(edges: Column, x: Column) -> Column:
    return F.array_min(F.filter(edges, lambda e: e >= x))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda u, v: u * v), F.lit(0.0), lambda s, x: s + x)


def mismatch(a: Column, b: Column) -> Column:
    """Share of places at which two arrays differ."""
    return F.aggregate(F.zip_with(a, b, lambda u, v: (u != v).cast("double")), F.lit(0.0), lambda s, x: s + x) / F.size(a)


def first_nearest(distances: Column) -> Column:
    """0-based place of the least distance, the first among equals."""
    return (F.array_position(distances, F.array_min(distances)) - 1).cast("int")


def hash_number(*parts: Column | str) -> Column:
    """A number in [0, 2**32) that any engine with md5 gives for the same text."""
    text = F.concat_ws("|", *[F.col(p) if isinstance(p, str) else p for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def hash_uniform(*parts: Column | str) -> Column:
    return hash_number(*parts) / F.lit(4294967296.0)
