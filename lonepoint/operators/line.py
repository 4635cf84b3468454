"""Neighbour counts and bounded neighbour lists on one coordinate, without a join.

Spark brings together the points of a block of slides with those of the windows around it.  A task sorts each slide
once; the neighbours of a point in a slide are then two places in its order apart, however many they are.  A route
still tells who meets whom: a probe's order holds the points whose home is in its reach.  For bounded lists a task walks
each probe's slides, newest first, and returns only the pairs that can be on the list.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import Space
from ..session import spread
from .routes import Route

#: Points of a block, and searches of its probes in slides; more of both if a window is longer.
BLOCK_POINTS = 1 << 13
BLOCK_SEARCHES = 1 << 20
MAX_SEARCHES = 1 << 22
#: Pairs that a task looks at together, more if one slide holds more.
PIECE_PAIRS = 1 << 20


@dataclass(frozen=True)
class Recent:
    """Keep, for each probe and class, the ``k`` most recent earlier neighbours, in the order of slide and id.

    ``classes`` numbers neighbours from their ids and distances, below ``count``.
    """

    k: int
    count: int = 1
    classes: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None


@dataclass(frozen=True)
class Skyband:
    """Keep, for each probe, the earlier neighbours with at most ``limit`` others no farther and strictly later."""

    limit: int


def usable(space: Space, slide: int, span: int) -> bool:
    """Whether slides can be sorted: one plain coordinate, and windows that a task can hold."""
    return space.flat and space.dims == 1 and slide * span * (2 * span - 1) <= MAX_SEARCHES


def _first(low: np.ndarray, high: np.ndarray, test: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """For each row the first place from ``low`` to ``high`` that passes, by halving; later ones pass too."""
    low, high = low.copy(), high.copy()
    while len(at := np.flatnonzero(low < high)):
        middle = (low[at] + high[at]) // 2
        hit = test(at, middle)
        high[at[hit]] = middle[hit]
        low[at[~hit]] = middle[~hit] + 1
    return low


def counts_within(
    values: np.ndarray, start: np.ndarray, end: np.ndarray, x: np.ndarray, radii: Sequence[float]
) -> list[np.ndarray]:
    """Values within each of the ascending radii of ``x``, in the ascending runs from ``start`` to ``end``."""

    def near(at, place, radius):
        # The test of ``Space.distance``, which never falls on the way to x.
        t = x[at] - values[place]
        return np.sqrt(t * t) <= radius

    below = _first(start, end, lambda at, place: values[place] >= x[at])
    above = _first(below, end, lambda at, place: values[place] > x[at])
    counts = []
    for r in reversed(radii):
        start = _first(start, below, lambda at, place: near(at, place, r))
        end = _first(above, end, lambda at, place: ~near(at, place, r))
        counts.insert(0, end - start)
    return counts


def _dealt(reach: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number for each probe's reach, and stored rows with the reaches they are in."""
    groups, sets = pd.factorize(reach)
    homes, names = pd.factorize(home)
    order = np.argsort(homes, kind="stable")
    edges = np.searchsorted(homes[order], np.arange(len(names) + 1))
    found = {name: order[edges[i] : edges[i + 1]] for i, name in enumerate(names)}
    held = [(g, found[h]) for g, text in enumerate(sets) for h in text.split(";") if h in found]
    none = [np.zeros(0, np.int64)]
    rows = np.concatenate(none + [rows for _, rows in held])
    return groups, rows, np.repeat([g for g, _ in held], [len(rows) for _, rows in held]).astype(np.int64)


def _block_counts(rows: pd.DataFrame, radii: Sequence[float], per_id: bool) -> pd.DataFrame:
    """The histogram of a block's probes."""
    names = [f"c{i}" for i in range(len(radii))]
    ordinary = np.isfinite(rows["x0"].to_numpy())
    asked = rows["asked"].to_numpy()
    probes, stored, odd = rows[asked & ordinary], rows[~asked & ordinary], rows[~ordinary]
    groups, at, of = _dealt(probes["reach"].to_numpy(), stored["home"].to_numpy())
    value, slide = stored["x0"].to_numpy()[at], stored["sl"].to_numpy()[at]
    order = np.lexsort((value, slide, of))
    value, slide, of = value[order], slide[order], of[order]
    parts = []
    if len(value):
        low, width = slide.min(), slide.max() - slide.min() + 1
        keys, starts = np.unique(of * width + (slide - low), return_index=True)
        ends = np.append(starts[1:], len(value))
        first = np.maximum(probes["first"].to_numpy(), low)
        many = np.maximum(np.minimum(probes["last"].to_numpy(), low + width - 1) - first + 1, 0)
        probe = np.repeat(np.arange(len(probes)), many)
        there = first[probe] + np.arange(len(probe)) - np.repeat(np.cumsum(many) - many, many)
        key = groups[probe] * width + (there - low)
        run = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        some = keys[run] == key
        probe, there, run = probe[some], there[some], run[some]
        counts = counts_within(value, starts[run], ends[run], probes["x0"].to_numpy()[probe], radii)
        held = counts[-1] > 0
        probe = probe[held]
        parts.append([probes["id"].to_numpy()[probe], probes["sl"].to_numpy()[probe], there[held], *[c[held] for c in counts]])
    # A point without an ordinary coordinate is near to itself alone, in as many rows as it has.
    alone = odd[odd["asked"] & (odd["sl"] >= odd["first"]) & (odd["sl"] <= odd["last"])]
    copies = alone["id"].map(odd[~odd["asked"]].groupby("id").size()).fillna(0)
    parts.append([alone[c].to_numpy() for c in ("id", "sl", "sl")] + [copies.to_numpy()] * len(radii))
    columns = [np.concatenate(c).astype(np.int64) for c in zip(*parts)]
    out = pd.DataFrame(dict(zip(["id", "sl", "nsl", *names], columns)))
    out = out[out[names[-1]] > 0]
    if per_id and probes["id"].duplicated().any() | alone["id"].duplicated().any():
        out = out.groupby(["id", "sl", "nsl"], as_index=False).sum()
    return out


def line_histogram(
    probes: DataFrame, pts: DataFrame, slide: int, span: int, radii: Sequence[float], space: Space, route: Route | None,
    per_id: bool = False,
) -> DataFrame:
    """Points within each radius of the probes, by slide: ``(id, sl, nsl, c0, c1, ..)``, the probe included.

    Probes may bring the slides ``first .. last`` beyond which nothing matters; slides without a near point are left
    out.  Rows are per probe, or per id.  A block holds the slides of a few thousand ids and the windows next to them,
    so it has a bounded number of points as ids are unique; a stored point goes to its own block and, near a border,
    to the next one.
    """
    length = max(span, min(BLOCK_POINTS, BLOCK_SEARCHES // (2 * span - 1)) // slide)
    if "first" not in probes.columns:
        probes = probes.withColumns({"first": F.col("sl") - (span - 1), "last": F.col("sl") + (span - 1)})
    block = lambda at: f"({at} - pmod({at}, {length}L)) div {length}L"
    around = F.expr(f"sequence({block(f'(sl - {span - 1}L)')}, {block(f'(sl + {span - 1}L)')})")
    none, every = F.lit(None), F.lit("")
    left = probes.where("sl is not null").select("id", "sl", "first", "last", "x0")
    right = pts.where("sl is not null").select("id", "sl", "x0")
    if route is None:
        left, right = left.withColumn("reach", every), right.withColumn("home", every)
    else:
        left, right = route.with_reach(left, space), route.with_home(right, space)
        left = left.withColumn("reach", F.array_join(F.transform("parts", lambda p: p.cast("string")), ";"))
        right = right.withColumn("home", F.col("part").cast("string"))
    names = ["block", "asked", "id", "sl", "first", "last", "x0", "reach", "home"]
    left = left.withColumns({"block": F.expr(block("sl")), "asked": F.lit(True), "home": none.cast("string")})
    right = right.withColumns({"asked": F.lit(False), "reach": none.cast("string")}).withColumns({"first": F.col("sl"), "last": F.col("sl")})
    dealt = left.select(names).unionByName(right.withColumn("block", F.explode_outer(around)).select(names))
    schema = ", ".join(f"{c} bigint" for c in ["id", "sl", "nsl", *[f"c{i}" for i in range(len(radii))]])
    radii = [float(r) for r in radii]
    return spread(dealt, "block").groupBy("block").applyInPandas(lambda rows: _block_counts(rows, radii, per_id), schema)


def _rank(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by the keys, and for its places the rank, from 0, among those that agree in all keys but the last."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([k[order[1:]] != k[order[:-1]] for k in keys[:-1]])
    at = np.arange(len(order))
    return order, at - np.maximum.accumulate(np.where(new, at, 0))


def with_nearest(nearest: np.ndarray, probe: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Adds distances to the ascending lists of smallest ones, a row for each probe; returns the probes that got any."""
    order, rank = _rank(probe, d)
    few = rank < nearest.shape[1]
    seen, at = np.unique(probe[order[few]], return_inverse=True)
    new = np.full((len(seen), nearest.shape[1]), np.inf)
    new[at, rank[few]] = d[order[few]]
    nearest[seen] = np.sort(np.concatenate([nearest[seen], new], axis=1), axis=1)[:, : nearest.shape[1]]
    return seen


def _pieces(sizes: np.ndarray) -> list[np.ndarray]:
    """Rows in runs of about ``PIECE_PAIRS`` pairs."""
    cuts = np.flatnonzero(np.diff((np.cumsum(sizes) - 1) // PIECE_PAIRS)) + 1
    return np.split(np.arange(len(sizes)), cuts)


class _Walk:
    """What a walk of probes over their slides has found so far."""

    def __init__(self, keep: Recent | Skyband, probes: int, radius: float):
        self.keep = keep
        self.reach = np.full(probes, radius)
        if isinstance(keep, Recent):
            self.found = np.zeros((probes, keep.count), np.int64)
        else:
            self.nearest = np.full((probes, keep.limit + 1), np.inf)

    def open(self) -> np.ndarray:
        """Probes that older slides still matter to."""
        if isinstance(self.keep, Recent):
            return (self.found < self.keep.k).any(axis=1)
        return self.nearest[:, -1] > 0

    def add(self, probe: np.ndarray, nid: np.ndarray, d: np.ndarray) -> np.ndarray:
        """Which of the pairs of some probes' next slide matter."""
        if isinstance(self.keep, Recent):
            of = np.zeros(len(d), np.int64) if self.keep.classes is None else self.keep.classes(nid, d)
            key, found = probe * self.keep.count + of, self.found.reshape(-1)
            many = np.bincount(key, minlength=len(found))
            # Only where a list overflows an order is needed.
            over = (many + found)[key] > self.keep.k
            at = np.flatnonzero(over)
            order, rank = _rank(key[at], -nid[at])
            at = at[order]
            kept = np.concatenate([np.flatnonzero(~over), at[rank + found[key[at]] < self.keep.k]])
            found[:] = np.minimum(found + many, self.keep.k)
            return kept
        kept = np.flatnonzero(d < self.nearest[probe, -1])
        seen = with_nearest(self.nearest, probe[kept], d[kept])
        self.reach[seen] = np.minimum(self.reach[seen], self.nearest[seen, -1])
        return kept


def _block_pairs(rows: pd.DataFrame, radius: float, span: int, keep: Recent | Skyband) -> pd.DataFrame:
    """The pairs of a block's probes with earlier points that ``keep`` asks for."""
    rows = rows[np.isfinite(rows["x0"].to_numpy())]
    asked = rows["asked"].to_numpy()
    probes, stored = rows[asked], rows[~asked].sort_values(["sl", "x0"])
    value, nid, slides = (stored[c].to_numpy() for c in ("x0", "id", "sl"))
    x, sl, first, last = (probes[c].to_numpy() for c in ("x0", "sl", "first", "last"))
    first, last = np.maximum(first, sl - (span - 1)), np.minimum(last, sl - 1)
    walk, parts = _Walk(keep, len(probes), radius), []
    for lag in range(1, span):
        there = sl - lag
        at = np.flatnonzero((there >= first) & (there <= last) & walk.open())
        start, end = (np.searchsorted(slides, there[at], side) for side in ("left", "right"))

        def near(row, place):
            # The test of ``Space.distance``, which never falls on the way to x.
            t = x[at[row]] - value[place]
            return np.sqrt(t * t) <= walk.reach[at[row]]

        middle = _first(start, end, lambda row, place: value[place] >= x[at[row]])
        start = _first(start, middle, near)
        many = _first(middle, end, lambda row, place: ~near(row, place)) - start
        some = np.flatnonzero(many)
        for piece in _pieces(many[some]) if len(some) else []:
            row = some[piece]
            size = many[row]
            place = np.repeat(start[row] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            probe = np.repeat(at[row], size)
            t = x[probe] - value[place]
            d = np.sqrt(t * t)
            kept = walk.add(probe, nid[place], d)
            parts.append((probe[kept], place[kept], d[kept]))
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    probe, place, d = (np.concatenate(c) for c in zip(none, *parts))
    return pd.DataFrame({"id": probes["id"].to_numpy()[probe], "sl": sl[probe], "nid": nid[place], "nsl": slides[place], "d": d})


def line_pairs(
    probes: DataFrame, pts: DataFrame, slide: int, span: int, radius: float, keep: Recent | Skyband
) -> DataFrame:
    """Pairs ``(id, sl, nid, nsl, d)`` of the probes with points of earlier slides that ``keep`` asks for.

    Each row of the probes has its own list.  Blocks are as for ``line_histogram``, with the windows before them only.
    """
    length = max(span, BLOCK_POINTS // slide)
    block = lambda at: f"({at} - pmod({at}, {length}L)) div {length}L"
    around = F.expr(f"sequence({block('sl')}, {block(f'(sl + {span - 1}L)')})")
    names = ["block", "asked", "id", "sl", "first", "last", "x0"]
    left = probes.where("sl is not null and first <= last").select("id", "sl", "first", "last", "x0")
    left = left.withColumns({"block": F.expr(block("sl")), "asked": F.lit(True)})
    right = pts.where("sl is not null").select("id", "sl", "x0")
    right = right.withColumns({"asked": F.lit(False), "first": F.col("sl"), "last": F.col("sl"), "block": F.explode_outer(around)})
    dealt = left.select(names).unionByName(right.select(names))
    schema = "id bigint, sl bigint, nid bigint, nsl bigint, d double"
    return spread(dealt, "block").groupBy("block").applyInPandas(lambda rows: _block_pairs(rows, float(radius), span, keep), schema)
