"""Detectors in Spark's keyed streaming state.

Points go to cells, with copies to the cells their ball touches, and cells to a fixed number of keys.  A key keeps
the slides of its open windows in one map, in blocks of at least a window's length; an event-time timer wakes it when a
window closes, it reports all windows that have closed by then and removes the slides that no window needs any more.  A
window holds at most as many points as it has ids, so the state of a key has a bound, however crowded a cell is.  A key
reads and writes only blocks near new points and near windows that it reports, however many slides late points keep.

Only points that can be outliers are searched for: a point with more than k others in its own small cell and slide
is left out at once, and one with k neighbours of its own or later slides as soon as it has them.  So searches
are few in crowded places, and each one compares a point with its cell's points of a few slides.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.slides import EVENT_BASE
from ..functions.vectors import MAX_CELL, SLACK, Space
from ..operators.routes import Route, assign, grid_route
from ..plans.detect import SINGLE, evaluate
from ..plans.params import QuerySet, parse_rk
from ..plans.status import INLIER, OUTLIER, SAFE
from ..session import shuffle_width
from .native import with_event_time

REPORT = "e bigint, w int, s int, r double, k int, n_outliers bigint"
PARTIAL = f"part bigint, version int, {REPORT}"
TRANSITION = "e bigint, id bigint, previous string, status string"

#: Distances computed at once.
CHUNK = 1 << 21
#: Points looked at in one run.
RUN_ROWS = 1 << 16
#: Coordinates taken in together, before they are put to those that wait.
WAIT_VALUES = 1 << 19
#: Slides kept for late points are dealt over about so many blocks.
LATE_BLOCKS = 64

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_WAITING = "ids binary, sl binary, cells binary, home binary, x binary"
_SLIDES = f"{_WAITING}, open binary, hist binary, mark binary"


Distance = Callable[[np.ndarray, np.ndarray], np.ndarray]


@dataclass
class Points:
    """Points of a key, ordered by cell and slide.

    ``open`` are the places of home points that can still be outliers, ``hist[i, j]`` the neighbours of the
    i-th of them in slide ``own + j - (span - 1)`` within each radius, and ``mark`` what a detector notes about it.
    """

    ids: np.ndarray
    sl: np.ndarray
    cells: np.ndarray
    home: np.ndarray
    x: np.ndarray
    open: np.ndarray
    hist: np.ndarray
    mark: np.ndarray

    def store(self) -> tuple[bytes, ...]:
        return tuple(np.ascontiguousarray(a).tobytes() for a in vars(self).values())

    @staticmethod
    def load(stored: Sequence[bytes], width: int, radii: int) -> Points:
        ids, sl, cells, home, x, opened, hist, mark = stored
        ids = np.frombuffer(ids, np.int64)
        opened = np.frombuffer(opened, np.int64)
        return Points(
            ids,
            np.frombuffer(sl, np.int64),
            np.frombuffer(cells, np.int64),
            np.frombuffer(home, bool),
            np.frombuffer(x).reshape(len(ids), -1),
            opened,
            np.frombuffer(hist, np.int32).reshape(len(opened), width, radii),
            np.frombuffer(mark, np.int64),
        )

    @staticmethod
    def joined(parts: Sequence[Points]) -> Points:
        """All of them in one order."""
        first = np.cumsum([0] + [len(p.ids) for p in parts])
        ids, sl, cells, home, x = (
            np.concatenate([getattr(p, name) for p in parts]) for name in ("ids", "sl", "cells", "home", "x")
        )
        order = np.lexsort((ids, sl, cells))
        opened = np.argsort(order)[np.concatenate([p.open + n for p, n in zip(parts, first)])]
        sorting = np.argsort(opened)
        hist, mark = (np.concatenate([getattr(p, name) for p in parts])[sorting] for name in ("hist", "mark"))
        return Points(ids[order], sl[order], cells[order], home[order], x[order], opened[sorting], hist, mark)

    def where(self, which: np.ndarray) -> Points:
        """Only the points of a mask."""
        opened = which[self.open]
        return Points(
            self.ids[which], self.sl[which], self.cells[which], self.home[which], self.x[which],
            (np.cumsum(which) - 1)[self.open[opened]], self.hist[opened], self.mark[opened],
        )

    def keep(self, which: np.ndarray) -> None:
        """Only these open ones stay open."""
        self.open, self.hist, self.mark = self.open[which], self.hist[which], self.mark[which]


def _crowded(cells: np.ndarray, x: np.ndarray, radius: float, k: int) -> np.ndarray:
    """Points with more than k points, themselves included, in a cell so small that all of it is near."""
    if radius > 0:
        with np.errstate(invalid="ignore", over="ignore"):
            place = np.floor(x / (radius / math.sqrt(x.shape[1]) * (1 - SLACK)))
            usable = (np.abs(place) <= MAX_CELL).all(1)
        place = np.where(usable[:, None], place, 0.0).astype(np.int64)
    else:
        # Equal vectors, by their bits; both zeros are one.
        usable, place = np.isfinite(x).all(1), (x + 0.0).view(np.int64)
    _, at, count = np.unique(np.column_stack([cells, place]), axis=0, return_inverse=True, return_counts=True)
    return usable & (count[at.reshape(-1)] > k)


def euclidean_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all rows of ``a`` to all rows of ``b``, summed axis by axis as in plans."""
    total = np.zeros((len(a), len(b)))
    with np.errstate(invalid="ignore", over="ignore"):
        for axis in range(a.shape[1]):
            gap = a[:, axis][:, None] - b[:, axis]
            total += gap * gap
    return np.sqrt(total)


class Cells(StatefulProcessor):
    """Slides of a key, their neighbour counts, and the timer that both detectors share.

    Slides are kept in blocks of one window's length, or of several if late points keep many.  A key has one timer, for
    the next window that closes; when it wakes, it looks at all windows that the watermark has closed since, a run of
    blocks at a time.
    """

    def __init__(self, span: int, radii: Sequence[float], k: int, lateness: int, space: Space, distance: Distance | None):
        self.span, self.radii, self.k, self.lateness = span, list(radii), k, lateness
        self.coords = space.coords()
        self.dims, self.flat, self.distance = space.dims, space.flat, distance
        #: Slides of a block; never fewer than a window, so that a window lies in two blocks at most.
        self.length = span * max(1, lateness // (span * LATE_BLOCKS))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.slides = handle.getMapState("slides", "block bigint", _SLIDES)
        self.waiting = handle.getMapState("waiting", "block bigint", _WAITING)
        self.clock = handle.getValueState("clock", "done bigint, timer bigint")

    def close(self) -> None:
        pass

    def timer(self, e: int) -> None:
        """Wake the key when slide ``e`` is complete but for late points."""
        self.handle.registerTimer((EVENT_BASE + e - self.lateness) * 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frames, held, first = [], 0, None
        most = max(RUN_ROWS, WAIT_VALUES // max(1, self.dims))
        for frame in rows:
            frames.append(frame)
            held += len(frame)
            if held >= most:
                first = self._wait(frames, first)
                frames, held = [], 0
        first = self._wait(frames, first)
        if first is not None:
            done, timer = self.clock.get() if self.clock.exists() else (None, None)
            if timer is None or first < timer:
                self.timer(first)
                self.clock.update((done, first))
        return iter([])

    def _wait(self, frames: list[pd.DataFrame], first: int | None) -> int | None:
        """Put points to those that wait for the watermark; the oldest slide of all."""
        frames = [f for f in frames if len(f)]
        if not frames:
            return first
        group = pd.concat(frames)
        x = group[self.coords].to_numpy(np.float64) if self.flat else np.stack(group["value"].to_numpy()).astype(float)
        self._put([
            group["id"].to_numpy(np.int64), group["sl"].to_numpy(np.int64),
            group["cell"].to_numpy(np.int64), group["is_home"].to_numpy(bool), x,
        ])
        oldest = int(group["sl"].min())
        return oldest if first is None else min(first, oldest)

    def _put(self, new: list[np.ndarray]) -> None:
        blocks = new[1] // self.length
        order = np.argsort(blocks, kind="stable")
        names, start = np.unique(blocks[order], return_index=True)
        for block, rows in zip(names.tolist(), np.split(order, start[1:])):
            stored = [np.ascontiguousarray(a[rows]).tobytes() for a in new]
            if self.waiting.containsKey((block,)):
                stored = [a + b for a, b in zip(self.waiting.getValue((block,)), stored)]
            self.waiting.updateValue((block,), tuple(stored))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) // 1000
        upto += self.lateness - EVENT_BASE
        done = self.clock.get()[0] if self.clock.exists() else None
        due = sorted(k[0] for k in self.waiting.keys() if k[0] * self.length <= upto)
        if done is not None and done >= upto and not due:
            return
        # Blocks in the state, and those in memory as they were read, None if they are new.
        self.stored, self.loaded = {k[0] for k in self.slides.keys()}, {}
        held = self._new([b""] * 5)
        self._open()
        # Windows that were not looked at yet, or that new points change.
        since = upto if done is None else done
        held = self._turn(held, self._recent(since))
        pending = {e for e in self._windows(held.sl) if since < e <= upto}
        while due or pending:
            fresh, taken = [self._new([b""] * 5)], []
            while due and sum(len(p.ids) for p in fresh) < RUN_ROWS:
                taken.append(due.pop(0))
                fresh.append(self._due(taken[-1], upto))
            end = min(upto, due[0] * self.length - 1) if due else upto
            new = Points.joined(fresh)
            pending |= {e for e in self._windows(new.sl) if e <= upto}
            now = sorted(e for e in pending if e <= end)
            pending = {e for e in pending if e > end}
            near = {*taken, *(e // self.length for e in now)}
            held = self._insert(self._turn(held, {b + i for b in near for i in (-1, 0, 1)}), new)
            if now:
                yield from self._report(key, held, np.array(now, np.int64))
            self._settle(held, end)
            held = held.where(held.sl > end - self.lateness - self.span)
        gone = upto - self.lateness - self.span
        for block in [b for b in self.stored if (b + 1) * self.length <= gone + 1]:
            self.slides.removeKey((block,))
            self.stored.remove(block)
        held = self._turn(held, {gone // self.length, *self._recent(upto)})
        held = held.where(held.sl > gone)
        self._close(upto)
        nexts = [k[0] for k in self.waiting.keys()]
        oldest = [int(np.frombuffer(self.waiting.getValue((min(nexts),))[1], np.int64).min())] if nexts else []
        if len(held.sl) and held.sl.max() > upto - self.span:
            oldest.append(upto + 1)
        elif len(held.sl) or self.stored:
            first = [held.sl.min()] if len(held.sl) else []
            if self.stored:
                first.append(np.frombuffer(self.slides.getValue((min(self.stored),))[1], np.int64).min())
            oldest.append(int(min(first)) + self.span + self.lateness)
        self._turn(held, set())
        if oldest:
            self.timer(min(oldest))
            self.clock.update((upto, min(oldest)))
        else:
            self.clock.clear()

    def _recent(self, e: int) -> set[int]:
        """Blocks with the slides of the window that ends with ``e``."""
        return {(e - self.span + 1) // self.length, e // self.length}

    def _windows(self, sl: np.ndarray) -> list[int]:
        """Windows that hold any of the slides."""
        return np.unique(np.unique(sl)[:, None] + np.arange(self.span)).tolist()

    def _new(self, stored: Sequence[bytes]) -> Points:
        """Points without counts, the home ones open unless others of their slide settle them."""
        ids, sl, cells, home, x = stored
        ids, sl, cells = (np.frombuffer(a, np.int64) for a in (ids, sl, cells))
        home = np.frombuffer(home, bool)
        x = np.frombuffer(x).reshape(len(ids), self.dims)
        # Under another distance no cell is known whose points are all near.
        if self.distance or not len(ids):
            settled = np.zeros(len(ids), bool)
        else:
            settled = _crowded(np.column_stack([cells, sl]), x, self.radii[0], self.k)
        opened = np.flatnonzero(home & ~settled) if self.k > 0 else np.zeros(0, np.int64)
        empty = np.zeros((len(opened), 2 * self.span - 1, len(self.radii)), np.int32)
        return Points(ids, sl, cells, home, x, opened, empty, np.full(len(opened), -1, np.int64))

    def _due(self, block: int, upto: int) -> Points:
        """The points of a block that wait no longer; newer ones go back."""
        ids, sl, cells, home, x = stored = self.waiting.getValue((block,))
        self.waiting.removeKey((block,))
        slides = np.frombuffer(sl, np.int64)
        if slides.max() <= upto:
            return self._new(stored)
        arrays = [
            np.frombuffer(ids, np.int64), slides, np.frombuffer(cells, np.int64), np.frombuffer(home, bool),
            np.frombuffer(x).reshape(len(slides), -1),
        ]
        self._put([a[slides > upto] for a in arrays])
        return self._new([a[slides <= upto].tobytes() for a in arrays])

    def _insert(self, held: Points, new: Points) -> Points:
        """Count the new points against all others that share a window, both ways."""
        if not len(new.ids):
            return held
        if not len(held.ids):
            held = new.where(np.zeros(len(new.ids), bool))
        old = held.mark.copy()
        # Old open points against the new ones, then new open points against all.
        held.hist = held.hist + self._count(held, held.open, new, None)
        held.mark, new.mark = np.full(len(old), 0, np.int64), np.full(len(new.open), 1, np.int64)
        marks = Points.joined([held, new]).mark.astype(bool)
        held.mark, new.mark = old, np.full(len(new.open), -1, np.int64)
        both = Points.joined([held, new])
        hist = both.hist.copy()
        hist[marks] += self._count(both, both.open[marks], both, both.open[marks])
        both.hist = hist
        return both

    def _count(self, searching: Points, rows: np.ndarray, stored: Points, own: np.ndarray | None) -> np.ndarray:
        """Stored points near the rows by slide and radius; ``own`` are the places of the rows themselves among them."""
        width, span = 2 * self.span - 1, self.span
        out = np.zeros((len(rows), width, len(self.radii)), np.int32)
        if not len(rows) or not len(stored.ids):
            return out
        names, code = np.unique(stored.cells, return_inverse=True)
        cells, sl = searching.cells[rows], searching.sl[rows]
        at = np.minimum(np.searchsorted(names, cells), len(names) - 1)
        low = min(int(sl.min()), int(stored.sl.min())) - span
        length = max(int(sl.max()), int(stored.sl.max())) + span + 1 - low
        keys = code.reshape(-1) * length + (stored.sl - low)
        first = np.searchsorted(keys, at * length + (sl - span + 1 - low), "left")
        last = np.searchsorted(keys, at * length + (sl + span - 1 - low), "right")
        last = np.where(names[at] == cells, last, first)
        # Rows of a cell within the length of a window are compared with the stored ones around them at once.
        block = sl // span
        cuts = np.flatnonzero((cells[1:] != cells[:-1]) | (block[1:] != block[:-1])) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(rows)]):
            c, d = int(first[a]), int(last[b - 1])
            if c >= d:
                continue
            step = max(1, CHUNK // (d - c))
            for i in range(a, b, step):
                j = min(i + step, b)
                distance = (self.distance or euclidean_matrix)(searching.x[rows[i:j]], stored.x[c:d])
                if own is not None:
                    distance[np.arange(j - i), own[i:j] - c] = np.inf
                p, q = np.nonzero(distance <= self.radii[-1])
                place = stored.sl[c + q] - sl[i + p] + (span - 1)
                common = (place >= 0) & (place < width)
                p, q, place = p[common], q[common], place[common]
                place = p * width + place
                for r, radius in enumerate(self.radii):
                    near = place if r == len(self.radii) - 1 else place[distance[p, q] <= radius]
                    out[i:j, :, r] = np.bincount(near, minlength=(j - i) * width).reshape(j - i, width)
        return out

    def _turn(self, held: Points, blocks: set[int]) -> Points:
        """The points of these blocks: others are written if they changed, missing ones are read."""
        at = held.sl // self.length
        order = np.argsort(at, kind="stable")
        for block in sorted(self.loaded.keys() - blocks):
            before = self.loaded.pop(block)
            first, last = np.searchsorted(at[order], [block, block + 1])
            if first == last:
                if before is not None:
                    self.slides.removeKey((block,))
                continue
            which = np.zeros(len(at), bool)
            which[order[first:last]] = True
            value = held.where(which).store()
            if before is None or tuple(bytes(v) for v in before) != value:
                self.slides.updateValue((block,), value)
            self.stored.add(block)
        missing = sorted(blocks & self.stored)
        self.stored -= blocks
        self.loaded.update((b, self.slides.getValue((b,))) for b in missing)
        for block in blocks:
            self.loaded.setdefault(block, None)
        held = held.where(np.isin(at, list(self.loaded)))
        if not missing:
            return held
        width, radii = 2 * self.span - 1, len(self.radii)
        return Points.joined([held, *[Points.load(self.loaded[b], width, radii) for b in missing]])

    def _open(self) -> None:
        """Before the windows of a key are looked at."""

    def _close(self, upto: int) -> None:
        """After that."""

    def _report(self, key, held: Points, windows: np.ndarray) -> Iterator[pd.DataFrame]:
        """Rows for some windows, in ascending order."""
        raise NotImplementedError

    def _settle(self, held: Points, e: int) -> None:
        """Close what is certain after the windows up to ``e``."""
        raise NotImplementedError


class WindowReports(Cells):
    """Outliers per key, window, radius and k; a window that late points change is reported again."""

    def __init__(self, queries: QuerySet, lateness: int, space: Space, distance: Distance | None):
        super().__init__(queries.spans[-1], queries.radii, queries.ks[-1], lateness, space, distance)
        self.queries = queries

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.versions = handle.getMapState("versions", "block bigint", "version binary")

    def _open(self) -> None:
        self.reported, self.touched = {}, set()
        if self.lateness:
            self.reported = {k[0]: np.frombuffer(v[0], np.int32).copy() for k, v in self.versions.iterator()}

    def _close(self, upto: int) -> None:
        if not self.lateness:
            return
        for block in list(self.reported):
            if (block + 1) * self.length <= upto - self.lateness - self.span:
                if block not in self.touched or self.versions.containsKey((block,)):
                    self.versions.removeKey((block,))
            elif block in self.touched:
                self.versions.updateValue((block,), (self.reported[block].tobytes(),))

    def _versions(self, windows: np.ndarray) -> np.ndarray:
        """How often each of some windows, in ascending order, was reported before."""
        versions = np.zeros(len(windows), np.int64)
        if not self.lateness:
            return versions
        names, start = np.unique(windows // self.length, return_index=True)
        for block, first, last in zip(names.tolist(), start, [*start[1:], len(windows)]):
            counts = self.reported.setdefault(block, np.zeros(self.length, np.int32))
            self.touched.add(block)
            at = windows[first:last] - block * self.length
            versions[first:last] = counts[at]
            counts[at] += 1
        return versions

    def _report(self, key, held: Points, windows: np.ndarray) -> Iterator[pd.DataFrame]:
        wanted = self.queries
        homes = np.unique(held.sl[held.home])
        sl = held.sl[held.open]
        near = np.flatnonzero((sl > windows[0] - self.span) & (sl <= windows[-1]))
        sl, upto = sl[near], np.zeros((len(near), 2 * self.span, len(self.radii)), np.int64)
        np.cumsum(held.hist[near], axis=1, out=upto[:, 1:])
        columns: list[list[np.ndarray]] = []
        for w, span in zip(wanted.windows, wanted.spans):
            living = np.isin(windows, np.unique(homes[:, None] + np.arange(span)))
            if not living.any():
                continue
            ends = sl[:, None] + np.arange(span)
            at = np.minimum(np.searchsorted(windows, ends), len(windows) - 1)
            inside = windows[at] == ends
            place = np.arange(span)
            # Neighbours in the window that ends so many slides after the point's own.
            counts = upto[:, place + self.span] - upto[:, np.maximum(place - span + self.span, 0)]
            for i, r in enumerate(wanted.radii):
                for k in wanted.ks:
                    found = np.bincount(at[inside & (counts[:, :, i] < k)], minlength=len(windows))
                    for s, step in zip(wanted.slides, wanted.steps):
                        due = living & ((windows + 1) % step == 0)
                        n = int(due.sum())
                        columns.append([windows[due], np.full(n, w), np.full(n, s), np.full(n, r), np.full(n, k), found[due]])
        names = ["e", "w", "s", "r", "k", "n_outliers"]
        if not any(len(c[0]) for c in columns):
            return
        frame = pd.DataFrame({name: np.concatenate([c[i] for c in columns]) for i, name in enumerate(names)})
        names, at = np.unique(frame["e"].to_numpy(), return_inverse=True)
        frame.insert(0, "version", self._versions(names)[at.reshape(-1)])
        frame.insert(0, "part", key[0])
        yield frame

    def _settle(self, held: Points, e: int) -> None:
        """What is certain now is certain in every window that can still be reported."""
        known = e - self.lateness - held.sl[held.open]
        # Its own slide is in every window of a point.
        sure = np.arange(self.span) < np.maximum(known, 1)[:, None]
        safe = (held.hist[:, self.span - 1 :, 0] * sure).sum(1) >= self.k
        if safe.any():
            held.keep(~safe)


class StatusChanges(Cells):
    """Status changes of points.

    Whenever a key wakes, the status of its open points follows for all windows that have closed since, from their
    neighbours per slide.  A mark is the status in the last window looked at.
    """

    def __init__(self, span: int, radius: float, k: int, space: Space, distance: Distance | None):
        super().__init__(span, [radius], k, 0, space, distance)

    def _report(self, key, held: Points, windows: np.ndarray) -> Iterator[pd.DataFrame]:
        names = np.array([OUTLIER, INLIER, SAFE], dtype=object)
        opened, span = held.open, self.span
        sl, hist = held.sl[opened], held.hist[:, :, 0].astype(np.int64)
        upto = np.zeros((len(opened), 2 * span), np.int64)
        np.cumsum(hist, axis=1, out=upto[:, 1:])
        place = np.arange(span)
        status = (upto[:, place + span] - upto[:, place] >= self.k).astype(np.int64)
        status[upto[:, place + span] - upto[:, [span - 1]] >= self.k] = 2
        at = sl[:, None] + place
        seen = (at >= windows[0]) & (at <= windows[-1])
        before = np.column_stack([np.full(len(opened), -1, np.int64), status[:, :-1]])
        # The first window of this look follows the one of the last look.
        begins = seen & ~np.column_stack([np.zeros(len(opened), bool), seen[:, :-1]])
        before[begins] = held.mark[np.nonzero(begins)[0]]
        rows, j = np.nonzero(seen & (before >= 0) & (before != status))
        last = np.where(seen.any(1), span - 1 - np.argmax(seen[:, ::-1], axis=1), -1)
        held.mark = np.where(last >= 0, status[np.arange(len(opened)), last], held.mark)
        if len(rows):
            yield pd.DataFrame({
                "e": at[rows, j], "id": held.ids[opened[rows]],
                "previous": names[before[rows, j]], "status": names[status[rows, j]],
            })

    def _settle(self, held: Points, e: int) -> None:
        held.keep(held.mark != 2)


def _routed(
    points: DataFrame, slide: int, radius: float, space: Space, route: Route | None, distance: Distance | None,
    buckets: int, lateness: int,
) -> DataFrame:
    """Copies of the points by key; a point is once in every cell that its ball touches."""
    if space.dims is None:
        raise ValueError("a stream needs vectors of a declared length")
    if (space.metric is None) != (distance is None):
        raise ValueError("another metric comes with its matrix form")
    # Spark drops what is not after the watermark: one slide more, so that the newest one stays open.
    timed = space.project(with_event_time(points, slide, lateness + 1), F.col("id").cast("bigint").alias("id"), "sl", "ts")
    copies = assign(timed, route or grid_route(space, radius), space).withColumn("cell", F.xxhash64("part")).drop("part")
    return copies.withColumn("bucket", F.pmod("cell", F.lit(buckets)))


def _started(frame: DataFrame, path: str, trigger: dict | None) -> StreamingQuery:
    """The stream written to ``path/report``, with keyed state in the store that supports it."""
    spark = frame.sparkSession
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        return (
            frame.writeStream.format("parquet")
            .outputMode("append")
            .option("path", f"{path}/report")
            .option("checkpointLocation", f"{path}/checkpoint")
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


@dataclass(frozen=True)
class KeyedReport:
    """The report of a keyed stream, and what its state holds."""

    spark: SparkSession
    path: str
    queries: QuerySet
    space: Space

    def versions(self) -> DataFrame:
        """Rows as they were reported, by key: ``part, version`` and the report's columns."""
        return self.spark.read.schema(PARTIAL).parquet(f"{self.path}/report")

    def results(self) -> DataFrame:
        """The newest report of every window: ``e, w, s, r, k, n_outliers``."""
        keys = ["e", "w", "s", "r", "k"]
        newest = self.versions().groupBy("part", *keys).agg(F.max_by("n_outliers", "version").alias("n"))
        return newest.groupBy(*keys).agg(F.sum("n").alias("n_outliers"))

    def points(self) -> DataFrame:
        """Points held in the state, as ``id, value, sl``."""
        held = None
        for name in ("slides", "waiting"):
            rows = (
                self.spark.read.format("statestore")
                .option("path", f"{self.path}/checkpoint")
                .option("stateVarName", name)
                .load()
                .select(*[F.col(f"user_map_value.{c}").alias(c) for c in ("ids", "sl", "home", "x")])
            )
            held = rows if held is None else held.union(rows)

        def unpacked(frames):
            for frame in frames:
                for sl, ids, home, x in zip(frame["sl"], frame["ids"], frame["home"], frame["x"]):
                    ids, sl, home = np.frombuffer(ids, np.int64), np.frombuffer(sl, np.int64), np.frombuffer(home, bool)
                    x = np.frombuffer(x).reshape(len(ids), -1)
                    if home.any():
                        yield pd.DataFrame({"id": ids[home], "value": list(x[home]), "sl": sl[home]})

        return held.mapInPandas(unpacked, "id bigint, value array<double>, sl bigint")

    def drain(self, **options) -> DataFrame:
        """The windows that are still open, as a bounded input would end with them.

        The batch plan over the points in the state, which therefore has to be that of a stopped stream.
        """
        held = self.points()
        newest = held.agg(F.max("sl")).first()[0]
        if newest is None:
            return self.spark.createDataFrame([], REPORT)
        recent = held.where(F.col("sl") > newest - self.queries.spans[-1]).select("id", "value")
        return evaluate(recent, self.queries, SINGLE["pmcod"], self.space, between=(newest, None), **options)


def keyed_report(
    points: DataFrame,
    queries: QuerySet,
    path: str,
    space: Space,
    route: Route | None = None,
    lateness: int = 0,
    buckets: int | None = None,
    trigger: dict | None = None,
    distance: Distance | None = None,
) -> tuple[StreamingQuery, KeyedReport]:
    """Start a streaming query that reports each window as soon as a point arrives after it.

    Points up to ``lateness`` slides late are still taken: windows that they change are reported again, and
    ``KeyedReport.results`` shows the newest version.  Later ones are dropped, unless they come in the very batch
    in which their windows are reported.  ``route`` must reach as far as the
    largest radius.  ``buckets`` keys share the cells, by default as many as a shuffle has tasks.  If ``space`` has a
    metric of its own, ``distance`` is its form for matrices: the distances of all rows of one to all of another.
    """
    buckets = buckets or shuffle_width(points.sparkSession)
    copies = _routed(points, queries.unit, queries.radii[-1], space, route, distance, buckets, lateness)
    partial = copies.groupBy("bucket").transformWithStateInPandas(
        WindowReports(queries, lateness, space, distance), PARTIAL, "Append", "EventTime"
    )
    return _started(partial, path, trigger), KeyedReport(points.sparkSession, path, queries, space)


def stream_transitions(
    points: DataFrame, window: int, slide: int, radius: float, k: int, path: str, space: Space,
    route: Route | None = None, buckets: int | None = None, trigger: dict | None = None, distance: Distance | None = None,
) -> tuple[StreamingQuery, Callable[[], DataFrame]]:
    """Status changes as they happen: ``(e, id, previous, status)`` for each window at which a status differs from before."""
    if window % slide:
        raise ValueError("the window must be a multiple of the slide")
    buckets = buckets or shuffle_width(points.sparkSession)
    copies = _routed(points, slide, radius, space, route, distance, buckets, 0)
    changes = copies.groupBy("bucket").transformWithStateInPandas(
        StatusChanges(window // slide, radius, k, space, distance), TRANSITION, "Append", "EventTime"
    )
    spark = points.sparkSession
    return _started(changes, path, trigger), lambda: spark.read.schema(TRANSITION).parquet(f"{path}/report")


def stream_outliers(
    points: DataFrame, window: int, slide: int, radius: float, k: int, path: str, space: Space, **options
) -> tuple[StreamingQuery, Callable[[], DataFrame]]:
    """Streaming form of the single query; the second result reads the report."""
    if window % slide:
        raise ValueError("the window must be a multiple of the slide")
    query, report = keyed_report(points, QuerySet([window], [slide], [radius], [k]), path, space, **options)
    return query, lambda: report.results().select("e", "n_outliers")


def stream_rk(
    points: DataFrame, window: int, slide: int, queries, path: str, space: Space, **options
) -> tuple[StreamingQuery, Callable[[], DataFrame]]:
    """Streaming form of many (k, R) over one window."""
    listed = parse_rk(queries) if isinstance(queries, str) else list(queries)
    wanted = QuerySet([window], [slide], [r for _, r in listed], [k for k, _ in listed])
    query, report = keyed_report(points, wanted, path, space, **options)
    return query, lambda: report.results().select("e", "r", "k", "n_outliers")


def stream_rkws(
    points: DataFrame, windows, slides, radii, ks, path: str, space: Space, **options
) -> tuple[StreamingQuery, Callable[[], DataFrame]]:
    """Streaming form of all combinations of windows, slides, radii and ks."""
    query, report = keyed_report(points, QuerySet(windows, slides, radii, ks), path, space, **options)
    return query, report.results
