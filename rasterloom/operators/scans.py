"""Folds over a session's positions in time that grows with their number: smoothing, the movement gate, spaced prompts.

A session is one Arrow group, sorted once. operators.lines says the same of short arrays as column expressions.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Positions that the gate looks at first when it seeks the next one it keeps.
LOOK = 16


def smoothed(xy: np.ndarray, share: float = 0.3) -> np.ndarray:
    """Exponential smoothing: the first as it is, then (1 - share) of the last plus share of the next, in that order of operations."""
    step = lambda a, b: (1 - share) * a + share * b
    return np.array([list(accumulate(c, step)) for c in xy.T.tolist()], "f8").reshape(2, -1).T


def gated(xy: np.ndarray, least: float) -> np.ndarray:
    """The places that are at least so far from the last one kept; the first is kept. Looks ahead in doubling spans."""
    kept, at, n = [0] if len(xy) else [], 0, len(xy)
    while kept:
        to, span = kept[-1] + 1, LOOK
        while to < n:
            far = np.hypot(*(xy[to : to + span] - xy[kept[-1]]).T) >= least
            if far.any():
                at = to + int(far.argmax())
                break
            to, span = to + span, 2 * span
        if to >= n:
            break
        kept.append(at)
    return np.array(kept, "i8")


def spaced(xy: np.ndarray, least: float) -> np.ndarray:
    """The places that are at least so far from every one kept before them: only those in the cells around are looked at."""
    cells: dict[tuple[int, int], list[tuple[float, float]]] = {}
    kept = []
    for k, (x, y) in enumerate(xy.tolist()):
        i, j = math.floor(x / least), math.floor(y / least)
        if all(math.hypot(x - p, y - q) >= least for a in (i - 1, i, i + 1) for b in (j - 1, j, j + 1) for p, q in cells.get((a, b), ())):
            cells.setdefault((i, j), []).append((x, y))
            kept.append(k)
    return np.array(kept, "i8")


def over_sessions(events: DataFrame, fold: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """session, n (from 1 in order of ts and event_id), x, y: what fold, (places, positions), makes of each session's positions."""

    def go(group: pa.Table) -> pa.Table:
        group = group.sort_by([("ts", "ascending"), ("event_id", "ascending")])
        place, xy = fold(np.stack([group.column(c).to_numpy() for c in ("x", "y")], 1))
        return pa.table({"session": pa.array(np.full(len(place), group.column("session")[0].as_py(), "i8")), "n": pa.array((place + 1).astype("i4")), "x": pa.array(xy[:, 0].copy()), "y": pa.array(xy[:, 1].copy())})

    return events.select("session", "ts", "event_id", "x", "y").groupby("session").applyInArrow(go, "session bigint, n int, x double, y double")


def smooth(events: DataFrame, share: float = 0.3) -> DataFrame:
    return over_sessions(events, lambda xy: (np.arange(len(xy)), smoothed(xy, share)))


def gate(events: DataFrame, least: float) -> DataFrame:
    return over_sessions(events, lambda xy: (k := gated(xy, least), xy[k]))


def space(events: DataFrame, least: float) -> DataFrame:
    return over_sessions(events, lambda xy: (k := spaced(xy, least), xy[k]))
