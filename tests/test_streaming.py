"""The stateful stream of sessions does what the batch fold does: lines, order, time, late events, and an empty state at the end."""

from __future__ import annotations

import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.operators.kernels import least_cost
from rasterloom.plans.fixtures import pointer_events
from rasterloom.streaming import sessions, tracing
from rasterloom.streaming.sessions import FIRST, replay, stream, written

SF = "/root/testdata/sf0.001"
SCHEMA = "session long, ts timestamp, event_id long, kind string, x double, y double, manual boolean, unit double"
HOUR = 3600 * 10**6
T0 = datetime.datetime(2024, 1, 1)


def rows(*events):
    """(session, second, event_id, kind, x, y) as events."""
    return [(s, T0 + datetime.timedelta(seconds=t), i, k, float(x), float(y), False, 1.0) for s, t, i, k, x, y in events]


def plain(found):
    return sorted((tuple(tuple(map(tuple, v)) if isinstance(v, list) else v for v in r) for r in found), key=repr)


class Feed:
    """A stream over a folder that gets one file a batch; one checkpoint."""

    def __init__(self, spark, tmp_path, name, **options):
        self.spark, self.source, self.name, self.checkpoint, self.options = spark, str(tmp_path / "in"), name, str(tmp_path / "cp"), options
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        spark.createDataFrame([], SCHEMA).write.mode("append").parquet(self.source)

    def run(self, batches):
        read = self.spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(self.source)
        q = stream(read, **self.options).writeStream.format("memory").queryName(self.name).outputMode("append").option("checkpointLocation", self.checkpoint).start()
        try:
            for batch in batches:
                self.spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(self.source)
                q.processAllAvailable()
            progress = q.lastProgress["stateOperators"][0] if q.lastProgress["stateOperators"] else {}
            dropped = sum(op["numRowsDroppedByWatermark"] for p in q.recentProgress for op in p["stateOperators"])
            return [tuple(r) for r in self.spark.table(self.name).collect()], progress, dropped
        finally:
            q.stop()


def tick(second):
    return rows((-1, second, -1, "tick", 0, 0))


def test_stream_resumes_what_it_saved(spark, tmp_path):
    one = rows((1, 0, 1, "press", 0, 0), (1, 1, 2, "press", 100, 0), (1, 2, 3, "finish", 0, 0), (2, 2, 4, "press", 100, 0))
    two = rows((1, 10, 5, "press", 98, 3), (1, 11, 6, "press", 200, 0), (1, 12, 7, "finish", 0, 0), (2, 12, 8, "press", 170, 0), (1, 13, 9, "press", 40, 41))
    ends = spark.createDataFrame([(1, 77, 40.0, 40.0, 60.0, 60.0)], "session long, line_id long, x0 double, y0 double, x1 double, y1 double")
    got, state, _ = Feed(spark, tmp_path, "resumed", layer=ends, timeout=HOUR, keep=2 * HOUR).run([one, two, tick(3 * 3600)])
    assert [(r[1], r[2], r[8], r[9]) for r in sorted(got, key=lambda r: r[7]) if r[0] == 1] == [
        (1, "started", None, None), (2, "checkpoint", None, None), (3, "saved", FIRST + 3, None), (5, "resumed", None, None), (6, "checkpoint", None, None), (7, "merged", FIRST + 3, "end"),
        (9, "resumed", None, None), (None, "expired", None, None),
    ]
    # Another session has a layer of its own.
    assert [r[2] for r in sorted(got, key=lambda r: r[7]) if r[0] == 2] == ["started", "checkpoint", "expired"]
    assert state["numRowsTotal"] == 0
    assert plain(got) == plain(replay(spark.createDataFrame(one + two, SCHEMA), ends, timeout=HOUR, keep=2 * HOUR).collect())


def test_order_of_arrival_changes_nothing(spark, tmp_path):
    rng = np.random.default_rng(4)
    kinds = rng.choice(["press", "move", "drag", "undo", "finish", "cancel"], 240, p=[0.35, 0.2, 0.2, 0.1, 0.1, 0.05])
    events = rows(*((int(rng.integers(3)), 60 * k, k, str(kind), *rng.integers(0, 120, 2)) for k, kind in enumerate(kinds)))
    mixed = [e for k in range(0, 240, 8) for e in rng.permutation(np.array(events[k : k + 8], object)).tolist()]
    mixed = [(int(a), b, int(c), d, float(e), float(f), False, 1.0) for a, b, c, d, e, f, *_ in mixed]
    # Batches overlap in time by up to eight minutes; ten may pass.
    batches = [mixed[k : k + 60] for k in (0, 60, 120, 180)]
    batches = [batches[0][:-3], batches[1][:4] + batches[0][-3:] + batches[1][4:], *batches[2:]]
    got, state, dropped = Feed(spark, tmp_path, "mixed", delay="10 minutes", timeout=HOUR // 4, keep=HOUR).run([*batches, tick(8 * 3600)])
    want = replay(spark.createDataFrame(events, SCHEMA), timeout=HOUR // 4, keep=HOUR).collect()
    assert dropped == 0 and plain(got) == plain(want) and state["numRowsTotal"] == 0
    assert {"resumed", "merged", "expired"} & {r[2] for r in got}


def test_late_events_are_dropped_and_counted(spark, tmp_path):
    late = rows((1, 100, 3, "press", 90, 0))
    got, state, dropped = Feed(spark, tmp_path, "late", delay="30 seconds", timeout=HOUR, keep=HOUR).run([rows((1, 90, 1, "press", 0, 0)), tick(500), late, rows((1, 600, 2, "press", 90, 0)), tick(3 * 3600)])
    assert [r[1:3] for r in sorted(got, key=lambda r: r[7])] == [(1, "started"), (2, "checkpoint"), (None, "expired")] and dropped == 1 and state["numRowsTotal"] == 0


def test_time_gives_up_paths_and_forgets_lines(spark):
    day = 24 * 3600
    events = rows((1, 0, 1, "press", 0, 0), (1, 1, 2, "press", 100, 0), (1, 2, 3, "finish", 0, 0), (1, 10, 4, "press", 300, 0), (1, 10 + day, 5, "press", 400, 0), (1, 11 + 2 * day, 6, "press", 500, 0), (1, 12 + 10 * day, 7, "press", 100, 0))
    got = sorted(replay(spark.createDataFrame(events, SCHEMA)).collect(), key=lambda r: r["us"])
    assert [(r["event_id"], r["action"]) for r in got] == [(1, "started"), (2, "checkpoint"), (3, "saved"), (4, "started"), (5, "checkpoint"), (None, "expired"), (6, "started"), (None, "expired"), (7, "started"), (None, "expired")]
    assert (got[5]["us"] - got[4]["us"], got[5]["n_points"], got[5]["x"]) == (day * 10**6, 2, 400)


def test_written_lines(spark):
    kind = "session long, line_id long, geom array<struct<x:double,y:double>>"
    layer = spark.createDataFrame([(1, 5, [(0.0, 0.0), (10.0, 0.0)]), (1, 6, [(90.0, 90.0), (95.0, 95.0)])], kind)
    events = rows((1, 0, 1, "press", 1, 1), (1, 1, 2, "press", 0, 50), (1, 2, 3, "finish", 0, 0), (1, 3, 4, "press", 11, 0), (1, 4, 5, "press", 60, 0), (1, 5, 6, "finish", 0, 0), (1, 6, 7, "press", 300, 0), (1, 7, 8, "press", 400, 0), (1, 8, 9, "press", 400, 90), (1, 9, 10, "press", 301, 1))
    ends = layer.select("session", "line_id", F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(10.0).alias("x1"), F.lit(0.0).alias("y1")).where("line_id = 5")
    got = {r["line_id"]: ([tuple(p) for p in r["geom"]], r["changed"]) for r in written(layer, replay(spark.createDataFrame(events, SCHEMA), ends)).collect()}
    assert got == {5: ([(0, 50), (0, 0), (10, 0), (60, 0)], True), 6: ([(90, 90), (95, 95)], False), FIRST + 10: ([(300, 0), (400, 0), (400, 90), (300, 0)], True)}


def test_a_press_meets_ends_by_cells(spark):
    rng = np.random.default_rng(2)
    ends = [(int(rng.integers(3)), k, *(float(v) for v in rng.uniform(-60, 60, 4))) for k in range(200)]
    events = rows(*((int(rng.integers(3)), k, k, "press", *rng.uniform(-60, 60, 2)) for k in range(150)))
    layer = spark.createDataFrame(ends, "session long, line_id long, x0 double, y0 double, x1 double, y1 double")
    found = sessions.with_ends(spark.createDataFrame(events, SCHEMA), layer).where("kind = 'end'").select("event_id", "line_id").distinct().collect()
    want = {(e[2], str(n[1])) for e in events for n in ends if n[0] == e[0] and min(math.hypot(n[2] - e[4], n[3] - e[5]), math.hypot(n[4] - e[4], n[5] - e[5])) < 10}
    assert {tuple(r) for r in found} == want and len(want) > 50
    with pytest.raises(Exception, match="above largest"):
        sessions.with_ends(spark.createDataFrame(events, SCHEMA).withColumn("unit", F.lit(2.0)), layer).collect()


def test_source_of_events_is_the_stream(spark):
    from rasterloom.plans.sessions import replayed, source_pointer_events

    got, want = source_pointer_events(spark, SF).collect(), replayed(spark, SF).collect()
    assert plain(got) == plain(want) and {"resumed", "merged", "expired"} <= {r["action"] for r in want}


# ---- with pixels


def way_by_hand(view, start, target):
    """The fallbacks of the way to a target, and smoothing, vertex by vertex."""
    if view is None:
        return [target]
    inside = lambda p: (min(max(int((view.y_max - p[1]) / view.px_h), 0), view.cost.shape[0] - 1), min(max(int((p[0] - view.x_min) / view.px_w), 0), view.cost.shape[1] - 1))
    pixels = least_cost(view.cost, inside(start), inside(target), 100_000)[0][1:]
    if not pixels:
        return [target]
    if len(pixels) > 5:
        pixels = [tuple(sum(p[k] for p in pixels[max(0, i - 2) : i + 3]) / len(pixels[max(0, i - 2) : i + 3]) for k in (0, 1)) for i in range(len(pixels))]
    points = [(view.x_min + c * view.px_w, view.y_max - r * view.px_h) for r, c in pixels]
    for _ in range(3 if len(points) > 2 else 0):
        cut = [points[0]]
        for (ax, ay), (bx, by) in zip(points, points[1:]):
            cut += [(0.75 * ax + 0.25 * bx, 0.75 * ay + 0.25 * by), (0.25 * ax + 0.75 * bx, 0.25 * ay + 0.75 * by)]
        points = [*cut, points[-1]]
    return points


def snap_by_hand(view, path, p):
    r, c = int((view.y_max - p[1]) / view.px_h), int((p[0] - view.x_min) / view.px_w)
    if not (0 <= r < view.edges.shape[0] and 0 <= c < view.edges.shape[1]):
        return p
    best, far = None, 7
    for dr in range(-6, 7):
        for dc in range(-6, 7):
            rr, cc = r + dr, c + dc
            if 0 <= rr < view.edges.shape[0] and 0 <= cc < view.edges.shape[1] and view.edges[rr, cc]:
                x, y = view.x_min + cc * view.px_w, view.y_max - rr * view.px_h
                if len(path) >= 2:
                    turn = math.atan2(y - path[-1][1], x - path[-1][0]) - math.atan2(path[-1][1] - path[-2][1], path[-1][0] - path[-2][0])
                    turn = (turn + math.pi) % (2 * math.pi) - math.pi
                    if abs(turn) > math.radians(60):
                        continue
                if abs(dr) + abs(dc) < far:
                    best, far = (x, y), abs(dr) + abs(dc)
    return (0.7 * p[0] + 0.3 * best[0], 0.7 * p[1] + 0.3 * best[1]) if best else p


def made_views(spark):
    rng = np.random.default_rng(8)
    views = {}
    for img, (h, w) in {0: (40, 60), 1: (25, 25)}.items():
        edges = rng.random((h, w)) < 0.2
        edges[h // 2] = True
        views[img] = tracing.View(np.where(edges, 1.0, 1 + 8 * rng.random((h, w))), edges, -10.0, 70.0, 2.0, 2.5)
    px = [(i, r, c, float(v.cost[r, c]), bool(v.edges[r, c]), v.x_min, v.y_max, v.px_w, v.px_h) for i, v in views.items() for r in range(v.cost.shape[0]) for c in range(v.cost.shape[1])]
    return views, spark.createDataFrame(px, "img_id long, r int, c int, cost double, edge boolean, x_min double, y_max double, px_w double, px_h double").repartition(5)


def test_tracing_follows_the_pixels(spark):
    views, px = made_views(spark)
    rng = np.random.default_rng(9)
    kinds = rng.choice(["press", "move", "drag", "undo", "finish"], 400, p=[0.3, 0.3, 0.25, 0.08, 0.07])
    events = rows(*((int(rng.integers(6)), 60 * k, k, str(kind), *rng.uniform(-20, 110, 2)) for k, kind in enumerate(kinds)))
    df = spark.createDataFrame([(*e, e[0] % 3) for e in events], SCHEMA + ", img_id long")  # view 2 has no pixels
    got = tracing.trace(df, px, per_group=30).collect()
    assert {r["session"] for r in got} == set(range(6)) and {"preview", "extended", "saved", "closed"} <= {r["action"] for r in got}

    class Plain:
        def __init__(self, view):
            self.view = view

        def preview(self, start, target):
            return way_by_hand(self.view, start, target)

        def snap(self, path, p):
            return snap_by_hand(self.view, path, p)

    want = []
    for s in range(6):
        fold = sessions.Fold(s, view=Plain(views[s % 3]) if s % 3 in views else None)
        told = [(int((e[1] - T0).total_seconds() * 10**6) + int(T0.replace(tzinfo=datetime.timezone.utc).timestamp()) * 10**6, *e[2:8], None, None, None, None, None) for e in events if e[0] == s]
        want += fold.run(told) + fold.pass_time(math.inf)
    key = lambda r: (r[0], r[7], r[1] is None)
    assert len(got) == len(want)
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key)):
        assert a[:5] == b[:5] and a[7:10] == b[7:10]
        assert (a[5] is None) == (b[5] is None) and (a[5] is None or (a[5], a[6]) == pytest.approx((b[5], b[6])))
        assert (a[10] is None) == (b[10] is None) and (a[10] is None or np.allclose([tuple(p) for p in a[10]], [(p["x"], p["y"]) for p in b[10]]))


def test_a_route_ends_where_the_search_does():
    cost = np.ones((3, 9))
    view = tracing.View(cost, None)
    assert view.route((0.0, 0.0), (0.2, 0.1)) == [(0.2, 0.1)]  # the same pixel: the target itself
    assert view.route((0.0, 0.0), (3.0, 0.0)) == [(1.0, 0.0), (2.0, 0.0), (3.0, 0.0)]
    assert view.route((0.0, 0.0), (99.0, 0.0))[-1] == (7.0, 0.0)  # clamped to column 8, then the mean of 6, 7, 8
    assert tracing.View(None, None).route((0.0, 0.0), (5.0, 5.0)) == [(5.0, 5.0)]


def test_queries_say_what_their_names_do(spark):
    from rasterloom.plans import sessions as plans

    moves = plans.session_move(spark, SF).collect()
    assert {r["action"] for r in moves} <= {"extended", "preview", "gated"} and len(moves) > 20
    asked = {r["event_id"]: r for r in pointer_events(spark, SF).collect()}
    assert all(asked[r["event_id"]]["kind"] in ("move", "drag") for r in moves)
    press, keys = plans.session_press(spark, SF).collect(), plans.session_key(spark, SF).collect()
    assert all(asked[r["event_id"]]["kind"] == "press" for r in press) and all(asked[r["event_id"]]["kind"] in ("undo", "finish") for r in keys)
    every = plans.replayed(spark, SF).collect()
    assert len([r for r in every if r["event_id"] is not None]) == len(asked)
    ended = {}
    for r in every:
        if r["action"] in ("saved", "merged", "closed", "spot", "cancelled", "expired"):
            ended[r["session"]] = ended.get(r["session"], 0) + 1
    assert {r["session"]: r["resets"] for r in plans.reset_session(spark, SF).collect()} == ended
    lines = plans.session_lines(spark, SF).collect()
    assert {(r["session"], r["line_id"]) for r in lines} == {(r["session"], r["line_id"]) for r in every if r["line_id"] is not None}
    assert all(len(r["geom"]) >= 2 for r in lines)


def test_a_line_with_both_ends_near_is_met_once(spark):
    """Presses look into the cells around them and a line stands in the cells of its ends, so no line is told twice and no distinct is needed."""
    layer = spark.createDataFrame([(1, 7, 0.0, 0.0, 3.0, 0.0), (1, 8, 500.0, 0.0, 3.0, 9.5), (2, 9, 1.0, 1.0, 1.0, 1.0)], "session long, line_id long, x0 double, y0 double, x1 double, y1 double")
    told = sessions.with_ends(spark.createDataFrame([(1, 0, 5, "press", 2.0, 1.0, False)], "session long, us long, event_id long, kind string, x double, y double, manual boolean"), layer)
    assert sorted(r.line_id for r in told.where("kind = 'end'").collect()) == ["7", "8"]
    assert "HashAggregate" not in told._jdf.queryExecution().executedPlan().toString()


def streamed(spark, tmp_path, name, events, layer=None):
    """What the stream makes of events that are all there, and how often it went to the state store (puts and gets)."""
    source, provider = str(tmp_path / "in"), "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.createDataFrame(events, SCHEMA).coalesce(1).write.parquet(source)
    spark.createDataFrame(tick(40 * 24 * 3600), SCHEMA).coalesce(1).write.mode("append").parquet(source)
    q = stream(spark.readStream.schema(SCHEMA).parquet(source), layer).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    metrics = [op["customMetrics"] for p in q.recentProgress for op in p["stateOperators"]]
    return spark.table(name).collect(), sum(m["rocksdbPutCount"] + m["rocksdbGetCount"] for m in metrics)


def test_a_stream_goes_to_the_state_by_the_session_not_by_the_event(spark, tmp_path):
    """It held each event as a row and looked up each cell and each line end in the store, press by press."""
    rng = np.random.default_rng(6)
    kinds = rng.choice(["press", "move", "drag", "undo", "finish"], 600, p=[0.4, 0.1, 0.1, 0.1, 0.3])
    events = rows(*((int(rng.integers(2)), k, k, str(kind), *rng.uniform(0, 90, 2)) for k, kind in enumerate(kinds)))
    got, asked = streamed(spark, tmp_path, "few_questions", events)
    assert plain(got) == plain(replay(spark.createDataFrame(events, SCHEMA)).collect())
    assert {"resumed", "merged", "saved"} <= {r["action"] for r in got} and asked < 60


def test_odd_values_in_a_stream(spark, tmp_path):
    nan, inf = math.nan, math.inf
    events = rows((1, 0, 1, "press", 0, 0), (1, 1, 2, "press", nan, 50), (1, 2, 3, "press", inf, -inf), (1, 3, 4, 'a "kind", \\ of \n its own', 5, 5), (1, 4, 5, "press", 1e-300, 0.1), (1, 5, 6, "drag", 123456789.123456789, 60), (1, 6, 7, "finish", 0, 0), (2, 7, 2**50 + 1, "press", 3, 4))
    events += [(1, T0 + datetime.timedelta(seconds=s), 10 + s, kind, x, y, manual, 1.0) for s, kind, x, y, manual in ((10, "press", 1.0, 1.0, None), (11, "press", None, 50.0, None), (12, "drag", 70.0, None, None), (13, None, 1.0, 1.0, None), (14, "move", 9.0, 9.0, True))]
    ends = spark.createDataFrame([(1, 7, 1.0, 1.0, 500.0, 500.0), (1, 9, nan, 3.0, 400.0, inf), (2, 8, 0.0, 0.0, 3.0, 4.0)], "session long, line_id long, x0 double, y0 double, x1 double, y1 double")
    got, _ = streamed(spark, tmp_path, "odd_values", events, ends)
    want = replay(spark.createDataFrame(events, SCHEMA), ends).collect()
    assert plain(got) == plain(want) and "resumed" in {r["action"] for r in got}


def test_neighbouring_sessions_share_a_key_but_nothing_else(spark, tmp_path):
    """Far presses read all lines of their own session from the state, some lines are forgotten while others stay, and the key is empty in the end."""
    lines = [rows((s, 10 * s, 10 * s, "press", 100 * s, 0), (s, 10 * s + 1, 10 * s + 1, "press", 100 * s, 90), (s, 10 * s + 2, 10 * s + 2, "finish", 0, 0)) for s in (1, 2, 3, 17)]
    far = [(s, T0 + datetime.timedelta(seconds=1000 + k), 500 + k, kind, x, y, False, 60.0) for k, (s, kind, x, y) in enumerate([(2, "press", 600.0, 90.0), (2, "press", 5000.0, 0.0), (2, "finish", 0.0, 0.0), (2, "press", 4900.0, 0.0), (2, "press", 9000.0, 0.0), (3, "press", 0.0, 0.0), (17, "press", -9000.0, 0.0), (17, "press", 0.0, 0.0), (17, "finish", 0.0, 0.0)])]
    again = rows((1, 2 * 3600 + 500, 600, "press", 100, 90), (3, 2 * 3600 + 500, 601, "press", 300, 90))
    got, state, dropped = Feed(spark, tmp_path, "neighbours", timeout=HOUR // 2, keep=2 * HOUR).run([sum(lines, []), far, again, tick(20 * 3600)])
    want = replay(spark.createDataFrame([*sum(lines, []), *far, *again], SCHEMA), timeout=HOUR // 2, keep=2 * HOUR).collect()
    assert plain(got) == plain(want) and dropped == 0 and state["numRowsTotal"] == 0
    told = {r[1]: (r[2], r[8]) for r in got if r[1] is not None}
    assert told[500][0] == "resumed" and told[502] == ("merged", FIRST + 22) and told[503][0] == "resumed" and told[508] == ("saved", FIRST + 508)
    assert (told[600][0], told[601][0]) == ("started", "resumed")  # two hours after the last event of session 1, not of session 3
