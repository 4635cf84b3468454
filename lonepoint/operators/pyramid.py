"""Neighbour counts in crowded places from a pyramid of cell counts.

A ball is covered by cells, large ones inside and smaller ones towards its border, each level half as wide as the
one before.  Cells that lie wholly inside or outside of all radii are settled by their number of points per slide;
only the points of the smallest cells on a border are compared.  So a point among thousands of neighbours costs a few
dozen cells and a thin shell of points, not a pair for each neighbour.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import MAX_CELL, Space, finite, grid_width, number_sql
from ..session import joined

#: Halvings of the widest cells, by dimensions, and the cells that a ball has about.
LEVELS = {1: 6, 2: 4, 3: 3}
CELLS = {1: 16, 2: 150, 3: 700}


def _side(radius: float, level: int) -> float:
    return grid_width(radius) / 2**level


def usable(space: Space, radii: Sequence[float]) -> bool:
    """Whether balls of these radii can be covered: few plain coordinates, radii above zero."""
    return space.flat and space.dims in LEVELS and max(radii) > 0


def _cell(space: Space, side: float, prefix: str = "") -> Column:
    return F.array(*[F.floor(F.col(f"{prefix}{c}") / F.lit(side)) for c in space.coords()])


def _ordinary(space: Space, radius: float) -> Column:
    """Points whose cells can be told exactly."""
    limit = F.lit(MAX_CELL / 2 * grid_width(radius))
    each = [finite(F.col(c)) & (F.abs(F.col(c)) <= limit) for c in space.coords()]
    return functools.reduce(lambda a, b: a & b, each)


def home_cell(space: Space, radius: float) -> Column:
    """The widest cell of a point, null for one whose cell cannot be told exactly."""
    return F.when(_ordinary(space, radius), _cell(space, _side(radius, 0)))


def crowded_cells(sites: DataFrame, span: int, radius: float, space: Space, most: int) -> DataFrame:
    """Widest cells next to one that holds more than ``most`` sites within the length of a window: ``home``."""
    counts = (
        sites.where(_ordinary(space, radius))
        .groupBy(home_cell(space, radius).alias("cell"), F.floor(F.col("sl") / span).alias("block"))
        .agg(F.count(F.lit(1)).alias("sites"))
        .where(F.col("sites") > most)
    )
    steps = itertools.product((-1, 0, 1), repeat=space.dims)
    around = [F.array(*[F.col("cell")[i] + s for i, s in enumerate(step)]) for step in steps]
    return counts.select(F.explode(F.array(*around)).alias("home")).distinct()


def _cover(radii: Sequence[float], space: Space) -> tuple[list[tuple[str, str]], str]:
    """Columns to add to probes one after the other, and the last one's name: ``whole`` and ``edge`` cells.

    A cell is ``(level, cell, far)``; ``far`` is the distance of its farthest corner.
    """
    top, levels, dims = radii[-1], LEVELS[space.dims], space.dims
    slack = number_sql(0.05 * _side(top, levels))
    columns, parts = [], []
    open_cells = "cells0"
    most = number_sql(MAX_CELL)
    home = [f"floor(greatest(least({c} / {number_sql(_side(top, 0))}, {most}), -{most}))" for c in space.coords()]
    starts = [
        f"array({', '.join(f'{h} + {s}L' for h, s in zip(home, step))})"
        for step in itertools.product((-1, 0, 1), repeat=dims)
    ]
    columns.append((open_cells, f"array({', '.join(starts)})"))
    for level in range(levels + 1):
        side = number_sql(_side(top, level))
        low = [f"(c[{i}] * {side} - {x})" for i, x in enumerate(space.coords())]
        high = [f"({x} - (c[{i}] + 1) * {side})" for i, x in enumerate(space.coords())]
        near = [f"greatest({a}, {b}, 0D)" for a, b in zip(low, high)]
        far = [f"greatest(abs({a}), abs({b}))" for a, b in zip(low, high)]
        root = lambda terms: f"sqrt({' + '.join(f'{t} * {t}' for t in terms)})"
        columns.append((
            f"seen{level}",
            f"filter(transform({open_cells}, c -> named_struct('level', {level}, 'cell', c, 'near', {root(near)} - {slack}, "
            f"'far', {root(far)} + {slack})), c -> c.near <= {number_sql(top)})",
        ))
        settled = " and ".join(f"(c.far <= {number_sql(r)} or c.near > {number_sql(r)})" for r in radii)
        columns.append((f"whole{level}", f"filter(seen{level}, c -> {settled})"))
        columns.append((f"edge{level}", f"filter(seen{level}, c -> not ({settled}))"))
        parts.append(f"whole{level}")
        if level < levels:
            children = ", ".join(
                f"array({', '.join(f'2 * c.cell[{i}] + {b}L' for i, b in enumerate(bits))})"
                for bits in itertools.product((0, 1), repeat=dims)
            )
            open_cells = f"cells{level + 1}"
            columns.append((open_cells, f"flatten(transform(edge{level}, c -> array({children})))"))
    columns.append(("whole", f"concat({', '.join(parts)})"))
    return columns, f"edge{levels}"


def crowded_counts(
    probes: DataFrame, sites: DataFrame, span: int, radii: Sequence[float], space: Space
) -> DataFrame:
    """Points within each radius of the probes, by slide: ``(id, nsl, c0, c1, ..)``, the probe included.

    ``sites`` are distinct vectors per slide with their numbers ``n``.  Slides without a near point may be listed
    with zeros.
    """
    radii = sorted(radii)
    levels = LEVELS[space.dims]
    columns, edge = _cover(radii, space)
    for name, text in columns:
        probes = probes.withColumn(name, F.expr(text))
    block = F.floor(F.col("sl") / span)
    blocks = F.explode(F.sequence(block - 1, block + 1)).alias("block")
    asked = probes.select("id", "sl", *space.coords(), "whole", F.col(edge).alias("edge"), blocks)
    timely = F.abs(F.col("nsl") - F.col("sl")) < span

    sided = F.array(*[
        F.struct(F.lit(level).alias("level"), _cell(space, _side(radii[-1], level)).alias("cell"))
        for level in range(levels + 1)
    ])
    stored = sites.where(_ordinary(space, radii[-1]))
    counts = (
        stored.select("sl", "n", F.explode(sided).alias("at"))
        .groupBy("at.level", "at.cell", "sl")
        .agg(F.sum("n").alias("n"))
        .select("level", "cell", F.floor(F.col("sl") / span).alias("block"), F.col("sl").alias("nsl"), "n")
    )
    inner = (
        joined(asked.select("id", "sl", "block", F.explode("whole").alias("at")).select("id", "sl", "block", "at.*"), counts, "level", "cell", "block")
        .where(timely)
        .select("id", "nsl", *[F.when(F.col("far") <= r, F.col("n")).otherwise(0).alias(f"c{i}") for i, r in enumerate(radii)])
    )
    points = stored.select(
        _cell(space, _side(radii[-1], levels)).alias("cell"), block.alias("block"), F.col("id").alias("nid"),
        F.col("sl").alias("nsl"), "n", *space.prefixed(stored, "n"),
    )
    d = F.when(F.col("nid") == F.col("id"), F.lit(0.0)).otherwise(space.distance("", "n"))
    border = (
        joined(asked.select("id", "sl", "block", *space.coords(), F.explode("edge.cell").alias("cell")), points, "cell", "block")
        .where(timely)
        .withColumn("d", d)
        .select("id", "nsl", *[F.when(F.col("d") <= r, F.col("n")).otherwise(0).alias(f"c{i}") for i, r in enumerate(radii)])
    )
    return inner.unionByName(border).groupBy("id", "nsl").agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in range(len(radii))])
