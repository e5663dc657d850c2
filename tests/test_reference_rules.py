"""Rows worked out by hand from the rules, so that a query and its twin cannot share a misreading."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from rasterloom.operators import snap
from rasterloom.plans import models, routes
from rasterloom.streaming.sessions import FIRST, Layer, fresh, step

SF = "/root/testdata/sf0.001"


def run(events, lines=None, layer=None, unit=1.0):
    state, given = fresh(), [(k, *line[0], *line[-1]) for k, line in enumerate(lines or [])]
    told = [step(state, *e, layer=layer, given=given, unit=unit) for e in events]
    return told, state


def test_what_ends_a_path_clears_the_smoothed_pointer():
    for end in [("finish", 0, 0)], [("press", 90, 0), ("finish", 0, 0)], [("press", 1, 1)], [("press", 90, 0), ("press", 1, 1)], [("cancel", 0, 0)]:
        told, s = run([("move", 40, 40), ("press", 0, 0), *end])
        assert told[-1] in ("cancelled", "saved", "spot", "closed") and s["sx"] is None and s["sy"] is None
        assert {k: v for k, v in s.items() if k != "saved"} == fresh()
    # The start keeps it: three tenths of the way from 40 to 140.
    assert run([("move", 40, 40), ("press", 0, 0), ("move", 140, 40)])[1]["sx"] == pytest.approx(70)


def test_radii_are_pixels_of_the_event():
    assert run([("press", 0, 0), ("press", 29, 0)], unit=0.5)[0] == ["started", "checkpoint"]
    assert run([("press", 0, 0), ("drag", 9, 0)], unit=0.5)[0] == ["started", "extended"] and run([("press", 0, 0), ("drag", 35, 0)], unit=2.0)[0] == ["started", "gated"]
    assert run([("press", 15, 0)], [[(0, 0), (90, 90)]], unit=2.0)[0] == ["resumed"]


def test_a_saved_line_is_resumed_and_grows():
    layer = Layer()
    told, s = run([("press", 0, 0), ("press", 100, 0), ("finish", 0, 0), ("press", 95, 2), ("press", 200, 0), ("finish", 0, 0)], layer=layer)
    assert told == ["started", "checkpoint", "saved", "resumed", "checkpoint", "merged"] and s["saved"] == (FIRST, "end", [(100, 0), (200, 0)])
    assert layer.lines == {str(FIRST): [0, 0, 200, 0]} and layer.cells == {"0,0": [[FIRST, 0]], "20,0": [[FIRST, 1]]}
    # Its old end is no end now; its start is resumed backwards.
    assert run([("press", 100, 0)], layer=layer)[0] == ["started"]
    told, s = run([("press", 3, 0), ("press", 3, 80), ("finish", 0, 0)], layer=layer)
    assert told[-1] == "merged" and s["saved"] == (FIRST, "start", [(0, 0), (3, 80)]) and layer.lines == {str(FIRST): [3, 80, 200, 0]}


def test_a_resumed_line_that_is_closed_is_a_new_one():
    layer = Layer()
    told, s = run([("press", 5, 5), ("press", 90, 0), ("press", 90, 90), ("press", 6, 6)], [[(5, 5), (50, 50)]], layer=layer)
    assert told == ["resumed", "checkpoint", "checkpoint", "closed"] and s["saved"] == (FIRST, None, [(5, 5), (90, 0), (90, 90), (5, 5)])


def test_a_given_line_that_the_session_has_changed_is_no_longer_given():
    layer, line = Layer(), [[(5, 5), (50, 50)]]
    run([("press", 50, 50), ("press", 150, 150), ("finish", 0, 0)], line, layer=layer)
    assert layer.lines == {"0": [5, 5, 150, 150]} and run([("press", 50, 50)], line, layer=layer)[0] == ["started"] and run([("press", 5, 6)], line, layer=layer)[0] == ["resumed"]


def test_a_wide_reach_looks_at_all_ends():
    layer = Layer()
    layer.put(7, (0.0, 0.0, 5000.0, 0.0))
    assert layer.near(900.0, 0.0, 1000.0)[:2] == (7, True) and layer.near(2000.0, 0.0, 1000.0) is None


def test_undo_with_only_the_start_does_nothing():
    told, s = run([("press", 0, 0), ("drag", 50, 0), ("drag", 100, 0), ("undo", 0, 0)])
    assert told == ["started", "extended", "extended", "kept"] and s["path"] == [(0, 0), (50, 0), (100, 0)]


def test_undo_trims_to_the_last_checkpoint_then_drops_it():
    told, s = run([("press", 0, 0), ("drag", 50, 0), ("press", 60, 0), ("drag", 90, 0), ("undo", 0, 0)])
    assert s["path"] == [(0, 0), (50, 0), (60, 0)] and s["cps"] == [0, 2] and (s["ax"], s["ay"]) == (60, 0)
    told, s = run([("press", 0, 0), ("drag", 50, 0), ("press", 60, 0), ("undo", 0, 0)])
    assert told[-1] == "undone" and s["path"] == [(0, 0)] and s["cps"] == [0]


def test_second_press_near_the_start_is_a_spot_height():
    assert run([("press", 0, 0), ("press", 29, 0)])[0] == ["started", "spot"]
    assert run([("press", 0, 0), ("press", 30, 0)])[0] == ["started", "checkpoint"]


def test_closing_needs_no_third_point_but_a_nearer_press():
    assert run([("press", 0, 0), ("drag", 50, 0), ("press", 19, 0)])[0][-1] == "closed"
    assert run([("press", 0, 0), ("drag", 50, 0), ("press", 20, 0)])[0][-1] == "checkpoint"


def test_a_checkpoint_leaves_the_anchor_and_commits_the_preview():
    told, s = run([("press", 0, 0), ("move", 40, 0, True), ("press", 90, 0)])
    assert told == ["started", "preview", "checkpoint"] and s["path"] == [(0, 0), (40, 0)] and (s["ax"], s["ay"]) == (0, 0) and s["preview"] == []
    assert run([("press", 0, 0), ("press", 90, 0)])[1]["path"] == [(0, 0), (90, 0)]


def test_a_drag_adds_the_raw_point():
    told, s = run([("move", 0, 0), ("press", 0, 0), ("drag", 40, 0)])
    assert told[-1] == "extended" and s["path"][-1] == (40, 0) and s["sx"] == pytest.approx(12)


def test_the_gate_counts_from_the_anchor():
    assert run([("press", 0, 0), ("drag", 17.9, 0), ("drag", 18, 0), ("drag", 35, 0)])[0] == ["started", "gated", "extended", "gated"]


def test_a_press_resumes_a_line_at_its_nearer_end():
    line = [[(5, 5), (50, 50)]]
    told, s = run([("press", 6, 6)], line)
    assert told == ["resumed"] and s["path"] == [(5, 5)] and s["resume"] == [0, True, [5, 5, 50, 50]]
    assert run([("press", 49, 50)], line)[1]["resume"][:2] == [0, False] and run([("press", 30, 30)], line)[0] == ["started"]


def test_finish_saves_two_points():
    assert run([("press", 0, 0), ("finish", 0, 0)])[0][-1] == "cancelled"
    assert run([("press", 0, 0), ("press", 90, 0), ("finish", 0, 0)])[0][-1] == "saved"


def told(df, key, *cols):
    return {r[key]: tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in df.collect()}


def test_undo_query(spark, tmp_path):
    kinds = {1: ["click", "purchase", "purchase", "error"], 2: ["click", "purchase", "click", "purchase", "error", "error"], 3: ["error", "click"]}
    rows = [(i * 100 + k, i, e, 1.0, '{"k": 1}') for i, es in kinds.items() for k, e in enumerate(es)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, props string").withColumn("ts", F.timestamp_seconds("event_id"))
    df.write.parquet(str(tmp_path / "events.parquet"))
    from rasterloom.plans.sequences import undo_to_checkpoint

    assert told(undo_to_checkpoint(spark, str(tmp_path)), "session", "path_len", "checkpoints") == {1: (3, [0]), 2: (1, [0]), 3: (1, [0])}


def test_models():
    assert [(m[0], m[1], m[2], m[3]) for m in models.MODELS] == [(0, "Canny", "canny", None), (1, "LSD", "lsd", None), (2, "HED", "hed", None), (3, "MobileSAM", "canny", "mobile_sam"), (4, "SAM", "canny", "segment_anything")]


def test_labels(spark):
    assert told(models.display_name(spark, SF), "model_idx", "name", "label") == {
        0: ("Canny", "Download Model"), 1: ("LSD", "Download Model"), 2: ("HED", "Download HED"), 3: ("MobileSAM", "Download MobileSAM (~39MB)"), 4: ("SAM (VIT_B)", "Download SAM (~358MB)"),
    }


def test_update_status(spark):
    local = "key int, present boolean, size long, etag string, last_modified string"
    remote = "key int, ok boolean, etag string, last_modified string, content_length long"
    cases = [
        ((True, 5, "a", "d"), (False, "a", "d", 5), "check_failed"), ((False, None, None, None), (True, "a", "d", 5), "not_installed"), ((True, 5, "a", "d"), (True, "b", "d", 5), "update_available"),
        ((True, 5, "a", "d"), (True, "a", "d", 6), "update_available"), ((True, 5, None, "d"), (True, None, "e", 5), "update_available"), ((True, 5, "a", "d"), (True, "a", "e", 5), "up_to_date"),
        ((True, 5, "a", "d"), (True, None, None, None), "unknown"), ((True, 0, "", ""), (True, "", "", 0), "unknown"), ((True, None, None, None), (True, "a", None, None), "up_to_date"),
    ]
    l = spark.createDataFrame([(i, *c[0]) for i, c in enumerate(cases)], local).alias("l")
    r = spark.createDataFrame([(i, *c[1]) for i, c in enumerate(cases)], remote).alias("r")
    met = l.join(r, F.col("l.key") == F.col("r.key"), "left").select("l.key", models.update_status().alias("status"))
    assert told(met, "key", "status") == {i: c[2] for i, c in enumerate(cases)}


def test_sizes_and_types(spark, tmp_path):
    spark.createDataFrame([(3, 100), (6, 1536), (10, 5), (1, 2)], "doc_id long, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert told(models.format_size(spark, str(tmp_path)), "doc_id", "size") == {3: "100.0B", 6: "1.5KB", 10: "?", 1: "2.0KB"}
    n = len(models.TYPE_NAMES)
    at = {name: i for i, name in enumerate(models.TYPE_NAMES)}
    # bytes by o_custkey % 5: 1, 2, 4, 8, 3
    rows = [(at["Byte"], 0, "u8"), (at["Byte"] + n, 1, None), (at["Float32"], 2, "f32"), (at["Float32"] + n, 0, None), (at["Odd"], 2, "f32"), (at["Odd"] + n, 4, None), (at["ARGB32"], 2, None)]
    spark.createDataFrame([r[:2] for r in rows], "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    assert told(models.decode_dtype(spark, str(tmp_path)), "id", "held") == {i: h for i, _, h in rows}


def test_allowed_hosts(spark, tmp_path):
    spark.createDataFrame([(1, "https://vcl.ucsd.edu/x"), (2, "http://vcl.ucsd.edu/x"), (4, "https://notvcl.ucsd.edu/x"), (5, "https://RAW.githubusercontent.com/y")], "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    got = told(models.url_allowlist(spark, str(tmp_path)), "page_id", "error")
    assert {k: v for k, v in got.items() if k > 0} == {1: None, 2: "scheme", 4: "host", 5: None}


def test_prompts(spark):
    point = "struct<x:int,y:int>"
    df = spark.createDataFrame([(1, [(0, 0), (50, 50), (52, 51), (80, 50)], (100, 50)), (2, [], (3, 3)), (3, [(100, 150)], (100, 150)), (4, [(10, 2)], (60, 2))], f"id int, path array<{point}>, target {point}")
    positive, inside, complete = routes.prompts(F.col("path"), F.col("target"), 200, 200)
    got = told(df.where(inside).withColumn("positive", positive).where("size(positive) >= 2").withColumn("kept", complete(F.col("positive"))), "id", "kept")
    xy = {k: [tuple(p) for p in v] for k, v in got.items()}
    # The last three of the path, of which (52, 51) is too near (50, 50); both sides of the last two, those outside left out.
    assert xy == {1: [(50, 50), (80, 50), (100, 50), (80, 40), (80, 60), (100, 40), (100, 60)], 4: [(10, 2), (60, 2), (10, 12), (60, 12)]}


def test_snaps(spark):
    pixels = spark.createDataFrame([(0, 10, 30), (0, 40, 40)], "img_id long, r int, c int")
    spots = spark.createDataFrame([(1, 0, 10, 10), (2, 0, 9, 10), (3, 0, 30, 10), (4, 0, 25, 10), (5, 0, 26, 14)], "pid long, img_id long, px int, py int")
    assert told(snap.nearest_in_rings(spots, pixels, 20), "pid", "c", "r") == {1: (30, 10), 3: (30, 10), 4: (30, 10), 5: (30, 10)}
    assert told(snap.snap_to_edge(spots, pixels, 5), "pid", "x", "y") == {1: (10, 10), 2: (9, 10), 3: (30, 10), 4: (26.5, 10), 5: (26, 14)}
    # From the left along the row: an edge ahead is taken, one behind is not; without a history both are.
    kinds = "pid long, img_id long, px int, py int, qx int, qy int, ox int, oy int"
    asked = spark.createDataFrame([(1, 0, 25, 10, 20, 10, 10, 10), (2, 0, 34, 10, 40, 10, 35, 10), (3, 0, 34, 10, 40, 10, None, None)], kinds)
    assert told(snap.snap_to_edge(asked, pixels, 9, turn=60.0), "pid", "x", "y") == {1: (26.5, 10), 2: (34, 10), 3: (32.8, 10)}
