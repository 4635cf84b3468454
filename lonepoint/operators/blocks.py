"""Distance joins of long vectors, block against block.

Spark brings together blocks of bounded size; a task compares two blocks with
one matrix product and returns only the pairs that are near enough.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Rows of one side of a block; cells of one distance matrix and its columns; pairs whose distances are taken at once.
BLOCK_ROWS = 1 << 14
TILE_CELLS = 1 << 19
TILE_COLUMNS = 1 << 11
PAIRS = 1 << 16
# Share of the squares by which a matrix product may be off.
ROUNDING = 1e-9


def _comparable(m: np.ndarray) -> np.ndarray:
    """Rows whose coordinates are ordinary numbers, and their squares too."""
    with np.errstate(over="ignore", invalid="ignore"):
        return np.flatnonzero(np.isfinite(m).all(axis=1) & np.isfinite((m * m).sum(axis=1)))


def _distances(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    d = np.empty(len(i))
    for at in range(0, len(i), PAIRS):
        part = slice(at, at + PAIRS)
        d[part] = np.sqrt(((x[i[part]] - y[j[part]]) ** 2).sum(axis=1))
    return d


def _tighten(nearest: np.ndarray, i: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Merge new distances ``d`` of the rows ``i`` into the sorted smallest ones of each row; the rows that took part."""
    limit, rows = nearest.shape[1], np.unique(i)
    of, all_d = np.concatenate([np.repeat(rows, limit), i]), np.concatenate([nearest[rows].ravel(), d])
    order = np.lexsort((all_d, of))
    starts = np.searchsorted(of[order], rows)
    nearest[rows] = all_d[order][starts[:, None] + np.arange(limit)]
    return rows


def near_pairs(
    x: np.ndarray, y: np.ndarray, radius: float | None, limit: int | None, bound: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index pairs within the radius, or of the ``limit`` nearest rows of y per row of x.

    Ties at the limit are all returned.  Rows with a coordinate that is not an
    ordinary number are in no pair.  ``bound`` has a distance for each row of x beyond which pairs do not matter.

    The matrix product only preselects, with a margin for its rounding; distances are then taken from differences.  With
    a limit, what a row has found in one tile bounds what the next tiles have to look at.
    """
    usable_x, usable_y = _comparable(x), _comparable(y)
    if len(usable_x) < len(x) or len(usable_y) < len(y):
        i, j, d = near_pairs(x[usable_x], y[usable_y], radius, limit, None if bound is None else bound[usable_x])
        return usable_x[i], usable_y[j], d
    if not len(x) or not len(y):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0)
    xx, yy = (x * x).sum(axis=1), (y * y).sum(axis=1)
    most = np.full(len(x), np.inf if radius is None else radius)
    if bound is not None:
        most = np.fmin(most, bound)
    # One product gives the least square that rounding allows, but for a number of the row of x.
    left = np.column_stack([-2.0 * x, np.ones(len(x))])
    right = np.column_stack([y, yy * (1 - ROUNDING) - ROUNDING]).T
    own = xx * (1 - ROUNDING)
    columns = min(len(y), TILE_COLUMNS)
    step = max(1, TILE_CELLS // columns)
    rows, cols, dist = [], [], []
    for start in range(0, len(x), step):
        part = slice(start, start + step)
        reach = most[part]
        nearest = None if limit is None else np.full((len(reach), limit), np.inf)
        found = []
        for first in range(0, len(y), columns):
            tile = slice(first, first + columns)
            low = left[part] @ right[:, tile]
            most_low = reach * reach - own[part]
            if limit is not None and limit < low.shape[1] and np.isinf(reach).any():
                high = np.partition(low + 2 * ROUNDING * (1 + yy[tile]), limit - 1, axis=1)[:, limit - 1]
                most_low = np.minimum(most_low, high + 2 * ROUNDING * xx[part])
            i, j = np.nonzero(low <= most_low[:, None])
            d = _distances(x[part], y[tile], i, j)
            found.append((i, j + first, d))
            if limit is not None and len(i):
                touched = _tighten(nearest, i, d)
                reach = reach.copy()
                reach[touched] = np.minimum(reach[touched], nearest[touched, -1])
        i, j, d = (np.concatenate(f) for f in zip(*found))
        keep = d <= reach[i]
        rows.append(i[keep] + start)
        cols.append(j[keep])
        dist.append(d[keep])
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(dist)


def block_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    radius: float | None = None,
    limit: int | None = None,
    same: tuple[str, str] | None = None,
    bound: str | None = None,
) -> DataFrame:
    """Near pairs of ``left.value`` and ``right.nvalue`` with equal keys, and their distance ``d``.

    Both sides must have been cut so that a key holds a bounded number of rows.
    ``same`` names id columns whose equality makes a pair at any distance, ``bound`` a column of the left side with the
    distance beyond which its pairs do not matter, null for none.
    """
    kept_left = [f for f in left.schema.fields if f.name not in keys and f.name != "value"]
    kept_right = [f for f in right.schema.fields if f.name not in keys and f.name != "nvalue"]
    schema = T.StructType([*kept_left, *kept_right, T.StructField("d", T.DoubleType())])
    left_names, right_names = [f.name for f in kept_left], [f.name for f in kept_right]

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({f.name: [] for f in schema.fields})
        x, y = np.stack(a["value"].to_numpy()), np.stack(b["nvalue"].to_numpy())
        most = None if bound is None else a[bound].to_numpy(dtype=float, na_value=np.nan)
        i, j, d = near_pairs(x, y, radius, limit, most)
        if same is not None:
            # Vectors that are not comparable still meet themselves.
            odd = np.flatnonzero(~np.isfinite(x).all(axis=1))
            at = pd.Series(np.arange(len(b)), index=b[same[1]].to_numpy())
            odd = odd[np.isin(a[same[0]].to_numpy()[odd], at.index)]
            i = np.concatenate([i, odd])
            j = np.concatenate([j, at.loc[a[same[0]].to_numpy()[odd]].to_numpy()]).astype(int)
            d = np.concatenate([d, np.zeros(len(odd))])
        out = {n: a[n].to_numpy()[i] for n in left_names}
        out.update({n: b[n].to_numpy()[j] for n in right_names})
        return pd.DataFrame({**out, "d": d})

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(compare, schema)
