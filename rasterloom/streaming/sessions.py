"""Tracing sessions as a fold over pointer and key events, in batch and as a stateful stream.

A session's state is one small row: whether it traces, its smoothed pointer, the anchor of the movement gate, its path,
its checkpoints, its preview and the line end it resumes. Beside it stand the ends of the lines that the session has
saved or merged, under the grid cell of each end, so that a later press meets them. The same step function folds a
batch of a session's events (one group a session) and a stream's, where the state store keeps both between batches, under a
key for PER_KEY neighbouring sessions: a call of the store costs more than a session's fold.

Rules. A press starts a path, at an end of an existing line if one is near (resume). A press near the start, within
30 pixels while the path is the start alone and within 20 after, makes a spot height or closes the line; any other commits
the preview or else adds the point, and is a checkpoint; it does not move the gate's anchor. A move or drag nearer than 18
pixels to the anchor does nothing but smooth the pointer. A drag adds the raw point, snapped unless the manual key is held,
and moves the anchor; a move makes a preview: the raw point with the manual key, else the way to the smoothed pointer. An
undo does nothing while the start is the only checkpoint. Finish saves two points or more: a resumed line takes them at
its end, any other is new; cancel drops them. What ends a path also clears the smoothed pointer.
Distances are pixels times the event's `unit`, map units a pixel; the gate keeps the unit of its start.
The way to the smoothed pointer and the snap need pixels: streaming.tracing folds with a view; here they are the pointer
itself and the raw point.

Time. Events are folded in order (ts, event_id), whatever the order in which they arrive: the stream holds an event until
the watermark has passed it, and drops one that comes later than that. After `timeout` without an event a path is given
up (action `expired`, a row without an event); after `keep` without one the session's line ends go too, and with them the
last of its state. By then the given layer must hold what was saved.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..operators.lines import merge_at_end, merge_at_start

#: Pointer smoothing; in pixels the movement gate, the radii that close a line and make a spot height, and that resume a line.
SHARE, GATE, CLOSE, SPOT, RESUME = 0.3, 18.0, 20.0, 30.0, 10.0
#: Map units of a grid cell that line ends lie in, and the cells up to which a press looks at cells instead of all ends.
CELL, MOST_CELLS = 10.0, 256
#: Microseconds without an event after which a path is given up, and after which a session's line ends are forgotten.
TIMEOUT, KEEP = 24 * 3600 * 10**6, 7 * 24 * 3600 * 10**6
#: A new line's number is the event's that saved it, from FIRST on: unique without a counter that outlives its session.
FIRST = 1_000_000_000
#: Neighbouring sessions that share a key of the stream's state, so that they share its calls; events or rows in one text of it.
PER_KEY, BLOCK = 16, 10_000
OUT = "session bigint, event_id bigint, action string, n_points int, checkpoint int, x double, y double, us bigint, line_id bigint, side string, line array<struct<x:double,y:double>>"
EVENT = ("us", "event_id", "kind", "x", "y", "manual", "unit", "line_id", "x0", "y0", "x1", "y1")


def fresh() -> dict:
    return {"on": False, "sx": None, "sy": None, "ax": None, "ay": None, "gate": GATE, "path": [], "cps": [], "preview": [], "resume": None}


class Layer:
    """The ends of the lines that a session has saved or merged: line -> (x0, y0, x1, y1), and cell -> [line, at its end]."""

    def __init__(self, lines=None, cells=None):
        self.lines, self.cells = {} if lines is None else lines, {} if cells is None else cells

    @staticmethod
    def cell(x: float, y: float) -> str:
        return f"{math.floor(x / CELL)},{math.floor(y / CELL)}"

    def put(self, line: int, ends: tuple[float, float, float, float]) -> None:
        before = self.lines.get(str(line))
        for at_end in (0, 1) if before else ():
            cell = self.cell(*before[2 * at_end : 2 * at_end + 2])
            left = [e for e in self.cells.get(cell) if e != [line, at_end]]
            if left:
                self.cells[cell] = left
            else:
                del self.cells[cell]
        self.lines[str(line)] = list(ends)
        for at_end in (0, 1):
            cell = self.cell(*ends[2 * at_end : 2 * at_end + 2])
            self.cells[cell] = [*(self.cells.get(cell) or []), [line, at_end]]

    def near(self, x: float, y: float, reach: float, given: Iterable[tuple] = ()) -> tuple[int, bool, tuple[float, float], tuple] | None:
        """(line, whether its start, the point, the line's ends) of the nearest end within reach, of the session's lines and
        of those given (line, x0, y0, x1, y1) that it has not changed; ties go to the smaller line and its start."""
        span = [range(math.floor((v - reach) / CELL), math.floor((v + reach) / CELL) + 1) for v in (x, y)]
        if len(span[0]) * len(span[1]) <= MOST_CELLS:
            own = [line for i in span[0] for j in span[1] for line, _ in self.cells.get(f"{i},{j}") or ()]
        else:
            own = [int(line) for line in self.lines]
        known = {g[0]: tuple(g[1:]) for g in given if self.lines.get(str(g[0])) is None} | {line: tuple(self.lines.get(str(line))) for line in own}
        found = [(math.hypot(e[2 * k] - x, e[2 * k + 1] - y), line, k) for line, e in known.items() for k in (0, 1)]
        d, line, at_end = min(found, default=(math.inf, 0, 0))
        return (line, not at_end, known[line][2 * at_end : 2 * at_end + 2], known[line]) if d < reach else None

    def clear(self) -> None:
        self.lines.clear()
        self.cells.clear()


def save(s: dict, layer: Layer, closed: bool, number: int) -> str:
    """Hand the path out as s["saved"] = (line, side, points): of a resumed line the part that goes on at that side."""
    path = [tuple(p) for p in s["path"]]
    if closed and path[-1] != path[0]:
        path.append(path[0])
    if s["resume"] and not closed:
        line, at_start, ends = s["resume"]
        layer.put(line, (*path[-1], *ends[2:]) if at_start else (*ends[:2], *path[-1]))
        s["saved"] = (line, "start" if at_start else "end", path)
        return "merged"
    line = FIRST + number
    layer.put(line, (*path[0], *path[-1]))
    s["saved"] = (line, None, path)
    return "closed" if closed else "saved"


def step(s: dict, kind: str, x: float, y: float, manual: bool = False, unit: float = 1.0, layer: Layer | None = None, given: Iterable[tuple] = (), view=None, number: int = 0) -> str:
    """Change the state by one event; the name of what it did. layer: the ends the session has made; given: those of the
    existing lines near a press; view: pixels that routes and snaps use (streaming.tracing.View); number: the event's."""
    layer = Layer() if layer is None else layer
    if kind in ("move", "drag"):
        s["sx"], s["sy"] = (x, y) if s["sx"] is None else ((1 - SHARE) * s["sx"] + SHARE * x, (1 - SHARE) * s["sy"] + SHARE * y)
        if not s["on"]:
            return "idle"
        if math.hypot(x - s["ax"], y - s["ay"]) < s["gate"]:
            return "gated"
        if kind == "move":
            s["preview"] = [(x, y)] if manual else view.preview(s["path"][-1], (s["sx"], s["sy"])) if view else [(s["sx"], s["sy"])]
            return "preview"
        s["preview"] = []
        s["path"].append((x, y) if manual or not view else view.snap(s["path"], (x, y)))
        s["ax"], s["ay"] = x, y
        return "extended"
    if kind == "press":
        if not s["on"]:
            end = layer.near(x, y, RESUME * unit, given)
            at = end[2] if end else (x, y)
            s.update(on=True, ax=at[0], ay=at[1], gate=GATE * unit, path=[tuple(at)], cps=[0], preview=[], resume=[end[0], end[1], list(end[3])] if end else None)
            return "resumed" if end else "started"
        if math.hypot(x - s["path"][0][0], y - s["path"][0][1]) < (SPOT if len(s["path"]) == 1 else CLOSE) * unit:
            if len(s["path"]) == 1:
                action, s["saved"] = "spot", (None, None, s["path"][:1])
            else:
                s["path"] += view.preview(s["path"][-1], s["path"][0]) if view else s["path"][:1]
                if s["path"][-1] == s["path"][0]:
                    s["path"].pop()
                action = save(s, layer, True, number)
            s.update(fresh())
            return action
        s["path"] += s["preview"] or [(x, y)]
        s["preview"] = []
        s["cps"].append(len(s["path"]) - 1)
        return "checkpoint"
    if not s["on"]:
        return "idle"
    if kind == "undo":
        if len(s["cps"]) <= 1:
            return "kept"
        if len(s["path"]) <= s["cps"][-1] + 1:
            s["cps"].pop()
        del s["path"][s["cps"][-1] + 1 :]
        s["ax"], s["ay"] = s["path"][-1]
        return "undone"
    action = save(s, layer, False, number) if kind == "finish" and len(s["path"]) >= 2 else "cancelled"
    s.update(fresh())
    return action


class Fold:
    """One session: its state, its layer, and what time does to them."""

    def __init__(self, session: int, state: dict | None = None, layer: Layer | None = None, timeout: int | None = TIMEOUT, keep: int | None = KEEP, view=None):
        self.session, self.state, self.layer, self.timeout, self.keep, self.view = session, state or fresh(), layer or Layer(), timeout, keep, view

    def waits(self) -> list[int]:
        """When time alone will change something, as far as that is known now."""
        last, s = self.state.get("last"), self.state
        if last is None:
            return []
        return [last + t for t, due in ((self.timeout, s["on"] or s["sx"] is not None), (self.keep, True)) if t is not None and due]

    def pass_time(self, us: float) -> list[tuple]:
        """The rows of what ended before us."""
        last, rows, s = self.state.get("last"), [], self.state
        if last is not None and self.timeout is not None and us - last > self.timeout and (s["on"] or s["sx"] is not None):
            if s["on"]:
                rows.append((self.session, None, "expired", len(s["path"]), s["cps"][-1], *s["path"][-1], last + self.timeout, None, None, None))
            s.update(fresh())
        if last is not None and self.keep is not None and us - last > self.keep:
            self.layer.clear()
            s.clear()
            s.update(fresh())
        return rows

    def run(self, events: list[tuple]) -> list[tuple]:
        """One row an event; events are tuples of EVENT in any order, of which kind `end` tells of a line near a press."""
        near: dict[tuple, list[tuple]] = {}
        for e in events:
            if e[2] == "end":
                near.setdefault(e[:2], []).append((int(e[7]), *e[8:12]))
        rows = []
        for e in sorted((e for e in events if e[2] not in ("end", "tick")), key=lambda e: e[:2]):
            us, event_id, kind, x, y, manual, unit = e[:7]
            rows += self.pass_time(us)
            s = self.state
            action = step(s, kind, x, y, bool(manual), unit, self.layer, near.get((us, event_id), ()), self.view, int(event_id))
            s["last"] = us
            line, side, points = s.pop("saved", (None, None, None))
            px, py = s["path"][-1] if s["path"] else (None, None)
            rows.append((self.session, event_id, action, len(s["path"]), s["cps"][-1] if s["cps"] else None, px, py, us, line, side, points and [{"x": p[0], "y": p[1]} for p in points]))
        return rows


def table_of(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")])
    return out.astype({"event_id": "Int64", "checkpoint": "Int32", "n_points": "int32", "line_id": "Int64", "session": "int64", "us": "int64", "x": "float64", "y": "float64"})


def tuples_of(pdf: pd.DataFrame) -> list[tuple]:
    return list(zip(*(pdf[c].tolist() for c in EVENT)))


def with_ends(events: DataFrame, layer: DataFrame | None = None, largest: float = 1.0) -> DataFrame:
    """(session, us, event_id, kind, x, y, manual, unit) and, as rows of kind `end`, the lines of the session's layer
    (session, line_id, x0, y0, x1, y1) with an end near each press. Presses and ends meet by grid cell, without
    an aggregation, so the same join serves a stream; no event's unit may be above largest."""
    plain = events.withColumn("us", F.unix_micros("ts")) if "us" not in events.columns else events
    plain = plain if "unit" in events.columns else plain.withColumn("unit", F.lit(1.0))
    plain = plain.select(*events.columns, *(c for c in ("us", "unit") if c not in events.columns))
    nothing = {"line_id": "string", **dict.fromkeys(("x0", "y0", "x1", "y1"), "double")}
    whole = plain.withColumns({c: F.lit(None).cast(t) for c, t in nothing.items()})
    if layer is None:
        return whole
    reach = RESUME * largest
    cell = lambda c: F.floor(c / F.lit(2 * reach))
    around = lambda c: F.explode(F.sequence(cell(c - F.lit(reach)), cell(c + F.lit(reach))))
    # Presses, of which there are fewer, look into the cells they reach, two an axis; a line stands in the cells of its two ends only.
    ends = layer.select(F.col("session").alias("of"), F.col("line_id").cast("string").alias("line_id"), "x0", "y0", "x1", "y1", F.posexplode(F.array(*(F.struct(cell(F.col(f"x{k}")).alias("i"), cell(F.col(f"y{k}")).alias("j")) for k in (0, 1)))).alias("end", "at")).select("of", *nothing, "end", "at.i", "at.j")
    fits = F.when(F.col("unit") <= largest, F.col("x")).otherwise(F.raise_error(F.lit("a unit is above largest")).cast("double"))
    looks = plain.where("kind = 'press'").select("*", around(fits).alias("i")).select("*", around(F.col("y")).alias("j"))
    met = looks.join(ends, (looks["session"] == ends["of"]) & (looks["i"] == ends["i"]) & (looks["j"] == ends["j"]))
    close = lambda k: F.coalesce(F.hypot(F.col(f"x{k}") - F.col("x"), F.col(f"y{k}") - F.col("y")) < F.lit(RESUME) * F.col("unit"), F.lit(False))
    once = F.when(F.col("end") == 0, close(0)).otherwise(close(1) & ~close(0))  # of a line with both ends near, the start tells
    return whole.unionByName(met.where(once).select(*plain.columns, *nothing).withColumn("kind", F.lit("end")).select(*whole.columns))


def replay(events: DataFrame, layer: DataFrame | None = None, largest: float = 1.0, timeout: int | None = TIMEOUT, keep: int | None = KEEP) -> DataFrame:
    """What every event of (session, ts, event_id, kind, x, y, manual[, unit]) did, in batch, and which paths were given up."""

    def folded(session: int, told: list[tuple]) -> list[tuple]:
        fold = Fold(session, timeout=timeout, keep=keep)
        return fold.run(told) + fold.pass_time(math.inf)

    def go(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come session by session; many short sessions make one table."""
        now, held = None, []
        for pdf in parts:
            rows = []
            for session, event in zip(pdf["session"].tolist(), tuples_of(pdf)):
                if held and session != now:
                    rows += folded(now, held)
                    held = []
                now = session
                held.append(event)
            if rows:
                yield table_of(rows)
        if held:
            yield table_of(folded(now, held))

    told = with_ends(events, layer, largest).select("session", *EVENT)
    return told.repartition("session").sortWithinPartitions("session").mapInPandas(go, OUT)


class Stored:
    """The map of the state store that has all of a key's sessions, as (session, what, key) -> JSON. What a call reads and
    writes is kept until flush, so the store is asked once for a key, not at all where it has none, and told the outcome."""

    def __init__(self, state):
        self.state = state

    def open(self) -> None:
        self.seen, self.changed, self.listed, self.there = {}, {}, None, self.state.exists()

    def get(self, key: tuple):
        if key not in self.seen:
            there = self.there and (self.state.containsKey(key) if self.listed is None else key in self.listed.get(key[:2], ()))
            self.seen[key] = json.loads(self.state.getValue(key)[0]) if there else None
        return self.seen[key]

    def put(self, key: tuple, value) -> None:
        if value is not None or self.get(key) is not None:
            self.seen[key] = value
            self.changed.setdefault(key[:2], set()).add(key)

    def keys(self, session: int, what: str) -> list[tuple]:
        if self.listed is None and self.there:
            self.listed = {}
            for key in self.state.keys():
                self.listed.setdefault(tuple(key[:2]), set()).add(tuple(key))
        old, new = (self.listed.get((session, what), ()) if self.there else ()), self.changed.get((session, what), ())
        return [k for k in {*old, *new} if k not in new or self.seen[k] is not None]

    def flush(self) -> None:
        for key in (k for keys in self.changed.values() for k in keys):
            if self.seen[key] is not None:
                self.state.updateValue(key, (json.dumps(self.seen[key]),))
            elif self.there and self.state.containsKey(key):
                self.state.removeKey(key)


class Part:
    """What is stored of a session under a name, as a layer uses a dictionary."""

    def __init__(self, stored: Stored, session: int, what: str):
        self.stored, self.session, self.what = stored, session, what

    def get(self, key: str):
        return self.stored.get((self.session, self.what, key))

    def __setitem__(self, key: str, value) -> None:
        self.stored.put((self.session, self.what, key), value)

    def __delitem__(self, key: str) -> None:
        self[key] = None

    def __iter__(self) -> Iterator[str]:
        return (k[2] for k in self.stored.keys(self.session, self.what))

    def clear(self) -> None:
        for key in list(self):
            del self[key]


def packed(told: DataFrame) -> DataFrame:
    """sessions (PER_KEY of them), ts, us, event: events as JSON, so that few columns go to Python and into the state; null of a
    `tick`, which stays, as it moves the watermark."""
    end = F.to_json(F.struct("session", "us", "event_id", "line_id", F.array("x0", "y0", "x1", "y1").alias("ends")))
    event = F.when(F.col("kind") == "end", end).when(~F.col("kind").eqNullSafe("tick"), F.to_json(F.struct("session", *EVENT[:7])))
    return told.select(F.expr(f"session div {PER_KEY}").alias("sessions"), "ts", "us", event.alias("event"))


def unpacked(e: dict) -> tuple:
    """A tuple of EVENT from what packed tells of it; a number that is missing is not a number, as in pandas."""
    number = lambda v: v if type(v) is float else math.nan if v is None else float(v)
    if "ends" in e:
        return (e["us"], e["event_id"], "end", None, None, None, None, e["line_id"], *map(number, e["ends"]))
    return (e["us"], e["event_id"], e.get("kind"), number(e.get("x")), number(e.get("y")), e.get("manual"), number(e.get("unit")), None, None, None, None, None)


def text_of(rows: list[tuple]) -> str:
    """Rows of OUT as JSON; what is not a number is null, as in table_of."""
    names = [c.split()[0] for c in OUT.split(", ")]
    plain = [{c: v for c, v in zip(names, r) if v is not None and v == v} for r in rows]
    for r in plain:
        if "line" in r:
            r["line"] = [{c: v for c, v in p.items() if v == v} for p in r["line"]]
    return json.dumps(plain)


class Sessions(StatefulProcessor):
    """The stream's form of replay, for the sessions of a key. Events wait in a list, those of a batch as one text, until the
    watermark has passed them; timers of event time then fold them, give up paths and drop what is left of a session. Rows
    go out as texts: a table a key, of as many columns as OUT, costs more than the fold."""

    def __init__(self, timeout: int | None = TIMEOUT, keep: int | None = KEEP):
        self.timeout, self.keep = timeout, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        long, text = (lambda n: StructField(n, LongType())), (lambda n: StructField(n, StringType()))
        self.stored = Stored(handle.getMapState("stored", StructType([long("session"), text("what"), text("key")]), StructType([text("value")])))
        self.waits = handle.getValueState("waits", StructType([text("waits")]))  # session -> when time alone changes it
        self.waiting = handle.getListState("waiting", StructType([long("us"), text("events")]))

    def wake(self, us: int) -> None:
        """A timer at the first millisecond that is no earlier."""
        self.handle.registerTimer(-(-us // 1000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for pdf in rows:
            new = [(int(us), event) for us, event in zip(pdf["us"].tolist(), pdf["event"].tolist()) if isinstance(event, str)]
            if new:
                least = min(us for us, _ in new)
                self.waiting.appendValue((least, f"[{','.join(event for _, event in new)}]"))
                first = least if first is None else min(first, least)
        if first is not None:
            self.wake(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        held = list(self.waiting.get())
        later = [(us, text) for us, text in held if us > now]
        due, rest = {}, []
        for us, text in held:
            for e in json.loads(text) if us <= now else ():
                if e["us"] <= now:
                    due.setdefault(e["session"], []).append(unpacked(e))
                else:
                    rest.append(e)
        for k in range(0, len(rest), BLOCK):
            some = rest[k : k + BLOCK]
            later.append((min(e["us"] for e in some), json.dumps(some)))
        self.stored.open()
        told = self.waits.get() if self.stored.there else None
        waits = {int(session): us for session, us in json.loads(told[0]).items()} if told else {}
        out = []
        for session in sorted({*due, *(session for session, us in waits.items() if us <= now)}):
            state = self.stored.get((session, "state", ""))
            for name in ("path", "preview") if state else ():
                state[name] = [tuple(p) for p in state[name]]
            fold = Fold(session, state, Layer(Part(self.stored, session, "line"), Part(self.stored, session, "cell")), self.timeout, self.keep)
            out += fold.run(due.get(session, [])) + fold.pass_time(now)
            self.stored.put((session, "state", ""), None if fold.state == fresh() else fold.state)
            waits.pop(session, None)
            waits |= {session: us + 1 for us in sorted(fold.waits(), reverse=True) if us + 1 > now}
        self.stored.flush()
        if due:
            self.waiting.put(later) if later else self.waiting.clear()
        if waits:
            self.waits.update((json.dumps(waits),))
        elif told:
            self.waits.clear()
        if waits or later:
            self.wake(min([*waits.values(), *(us for us, _ in later)]))
        for k in range(0, len(out), BLOCK):
            yield pd.DataFrame({"rows": [text_of(out[k : k + BLOCK])]})

    def close(self) -> None:
        pass


def stream(events: DataFrame, layer: DataFrame | None = None, largest: float = 1.0, delay: str = "0 seconds", timeout: int | None = TIMEOUT, keep: int | None = KEEP) -> DataFrame:
    """The streaming query of replay over a streaming DataFrame of events; one may come as late as delay. An event of kind
    `tick` does nothing but move the watermark on."""
    told = packed(with_ends(events.withWatermark("ts", delay), layer, largest).select("session", "ts", *EVENT))
    found = told.groupBy("sessions").transformWithStateInPandas(statefulProcessor=Sessions(timeout, keep), outputStructType="rows string", outputMode="Append", timeMode="EventTime")
    return found.select(F.inline(F.from_json("rows", f"array<struct<{OUT}>>", {"mode": "FAILFAST"})))


def written(layer: DataFrame, replayed: DataFrame) -> DataFrame:
    """session, line_id, geom, changed: the layer (session, line_id, geom) after what the sessions saved, closed and merged."""
    saved = replayed.where("line_id is not null").groupBy("session", "line_id").agg(F.array_sort(F.collect_list(F.struct("us", "event_id", "side", "line"))).alias("parts"))
    grown = lambda geom, p: F.when(p["side"] == "start", merge_at_start(geom, p["line"])).when(p["side"] == "end", merge_at_end(geom, p["line"])).otherwise(p["line"])
    both = layer.join(saved, ["session", "line_id"], "full")
    base = F.coalesce("geom", F.expr("cast(array() as array<struct<x:double,y:double>>)"))
    geom = F.aggregate(F.coalesce("parts", F.expr("cast(array() as array<struct<us:bigint,event_id:bigint,side:string,line:array<struct<x:double,y:double>>>>)")), base, grown)
    return both.select("session", "line_id", geom.alias("geom"), F.col("parts").isNotNull().alias("changed"))
