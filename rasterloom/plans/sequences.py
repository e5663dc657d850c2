"""Queries on ordered vertices: windows, folds, ids and limits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import lines as ops, scans
from ..operators.numbering import number_rows
from ..registry import query
from .fixtures import EVENTS, LINE_PTS, LINES, line_pts, lines, pointer_events, table


@query("moving_mean_5", f"""WITH {LINE_PTS}, n AS (SELECT *, count(*) OVER (PARTITION BY line_id) AS n, avg(x) OVER w AS mx, avg(y) OVER w AS my FROM line_pts WINDOW w AS (PARTITION BY line_id ORDER BY seq ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))
SELECT line_id, seq, floor(CASE WHEN n > 5 THEN mx ELSE x END * 1000000 + 0.3::DOUBLE)::BIGINT AS x6, floor(CASE WHEN n > 5 THEN my ELSE y END * 1000000 + 0.3::DOUBLE)::BIGINT AS y6 FROM n""")
def moving_mean_5(spark, sf_dir):
    """Millionths, so that the last digit of a sum does not decide a comparison."""
    return ops.moving_mean(line_pts(spark, sf_dir)).select("line_id", "seq", *(F.floor(F.col(c) * 1000000 + F.lit(0.3)).alias(f"{c}6") for c in ("x", "y")))


RANKED = f"{EVENTS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts, event_id) AS n FROM pointer)"


@query("ema_pointer", f"""WITH RECURSIVE {RANKED}, s AS (
  SELECT session, n, x, y FROM ranked WHERE n = 1
  UNION ALL SELECT r.session, r.n, 0.7::DOUBLE * s.x + 0.3::DOUBLE * r.x, 0.7::DOUBLE * s.y + 0.3::DOUBLE * r.y FROM s JOIN ranked r ON r.session = s.session AND r.n = s.n + 1)
SELECT session, n::INT AS n, round(x, 6) AS x, round(y, 6) AS y FROM s""")
def ema_pointer(spark, sf_dir):
    return scans.smooth(pointer_events(spark, sf_dir)).select("session", "n", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


STEPS = f"""{LINE_PTS}, steps AS (SELECT line_id, seq, sqrt(dx * dx + dy * dy) AS length, atan2(dy, dx) AS heading FROM (
  SELECT line_id, seq, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy FROM line_pts WINDOW w AS (PARTITION BY line_id ORDER BY seq)))"""


@query("segment_lengths", f"WITH {STEPS} SELECT line_id, seq, round(length, 6) AS length FROM steps")
def segment_lengths(spark, sf_dir):
    return ops.headings(line_pts(spark, sf_dir)).select("line_id", "seq", F.round("length", 6).alias("length"))


@query("heading", f"WITH {STEPS} SELECT line_id, arg_max(round(heading, 6), seq) AS heading FROM steps WHERE heading IS NOT NULL GROUP BY line_id")
def heading(spark, sf_dir):
    """The direction of a line's last step."""
    return ops.headings(line_pts(spark, sf_dir)).where("heading is not null").groupBy("line_id").agg(F.max_by(F.round("heading", 6), "seq").alias("heading"))


@query("turn_angle", f"""WITH {STEPS}, t AS (SELECT line_id, seq, heading - lag(heading) OVER (PARTITION BY line_id ORDER BY seq) AS d FROM steps), u AS (
  SELECT line_id, seq, CASE WHEN d > pi() THEN d - 2 * pi() WHEN d < -pi() THEN d + 2 * pi() ELSE d END AS turn FROM t)
SELECT line_id, seq, round(turn, 6) AS turn, abs(turn) <= radians(60.0::DOUBLE) AS allowed FROM u""")
def turn_angle(spark, sf_dir):
    return ops.headings(line_pts(spark, sf_dir)).select("line_id", "seq", F.round("turn", 6).alias("turn"), (F.abs("turn") <= F.radians(F.lit(60.0))).alias("allowed"))


@query("recent_points", f"WITH {LINE_PTS} SELECT line_id, seq, x, y FROM (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY seq DESC) AS n FROM line_pts) WHERE n <= 3")
def recent_points(spark, sf_dir):
    last = Window.partitionBy("line_id").orderBy(F.desc("seq"))
    return line_pts(spark, sf_dir).withColumn("n", F.row_number().over(last)).where("n <= 3").drop("n")


def chaikin_sql(rounds: int) -> str:
    """Corner cutting with one CTE a round: the ends stay, every edge gives two points."""
    ctes, last = [], "(SELECT line_id, seq::BIGINT AS seq, x, y FROM line_pts)"
    for k in range(rounds):
        ctes.append(f"""e{k} AS (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny, count(*) OVER (PARTITION BY line_id) AS n, row_number() OVER w AS i FROM {last} WINDOW w AS (PARTITION BY line_id ORDER BY seq)),
c{k} AS (SELECT line_id, i * 4 AS seq, x, y FROM e{k} WHERE n < 3 OR i = 1 OR i = n
  UNION ALL SELECT line_id, i * 4 + 1, 0.75::DOUBLE * x + 0.25::DOUBLE * nx, 0.75::DOUBLE * y + 0.25::DOUBLE * ny FROM e{k} WHERE n >= 3 AND i < n
  UNION ALL SELECT line_id, i * 4 + 2, 0.25::DOUBLE * x + 0.75::DOUBLE * nx, 0.25::DOUBLE * y + 0.75::DOUBLE * ny FROM e{k} WHERE n >= 3 AND i < n)""")
        last = f"c{k}"
    return f"WITH {LINE_PTS}, {', '.join(ctes)} SELECT line_id, (row_number() OVER (PARTITION BY line_id ORDER BY seq))::INT AS seq, x, y FROM {last}"


@query("chaikin", chaikin_sql(3))
def chaikin(spark, sf_dir):
    return ops.chaikin(line_pts(spark, sf_dir))


NEXT_ID = "SELECT CASE WHEN c_custkey % 7 = 0 THEN 'x' || c_custkey WHEN c_custkey % 5 = 0 THEN NULL ELSE (c_custkey - 100)::VARCHAR END AS id FROM customer"


@query("next_feature_id", f"SELECT greatest(coalesce(max(try_cast(id AS BIGINT)), 0), 0) + 1 AS next_id FROM ({NEXT_ID})")
def next_feature_id(spark, sf_dir):
    """One more than the largest id that is a number, and at least 1."""
    k = F.col("c_custkey")
    ids = table(spark, sf_dir, "customer").select(F.when(k % 7 == 0, F.concat(F.lit("x"), k)).when(k % 5 == 0, None).otherwise((k - 100).cast("string")).alias("id"))
    return ids.agg((F.greatest(F.coalesce(F.max(F.col("id").try_cast("bigint")), F.lit(0)), F.lit(0)) + 1).alias("next_id"))


@query("assign_ids", "SELECT c_custkey AS fid, c_nationkey AS layer, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) + b.base)::BIGINT AS id FROM customer JOIN (SELECT s_nationkey, max(s_suppkey) AS base FROM supplier GROUP BY s_nationkey) b ON s_nationkey = c_nationkey")
def assign_ids(spark, sf_dir):
    """New features of a layer are numbered on from its largest id."""
    base = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("layer")).agg(F.max("s_suppkey").alias("base"))
    new = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("fid"), F.col("c_nationkey").alias("layer")).join(base, "layer")
    return number_rows(new, "layer", "fid").select("fid", "layer", (F.col("number") + F.col("base")).alias("id"))


@query("checkpoint_index", f"WITH {EVENTS} SELECT session, event_id, grown - 1 AS checkpoint FROM (SELECT *, count(*) FILTER (kind IN ('press', 'drag')) OVER (PARTITION BY session ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS grown FROM pointer) WHERE kind = 'press'")
def checkpoint_index(spark, sf_dir):
    """The place in the path of each click: how many points stand before it."""
    so_far = Window.partitionBy("session").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    grown = F.count(F.when(F.col("kind").isin("press", "drag"), 1)).over(so_far)
    return pointer_events(spark, sf_dir).select("session", "event_id", "kind", (grown - 1).alias("checkpoint")).where("kind = 'press'").drop("kind")




@query("truncate_path", f"WITH {LINES} SELECT fid, list_transform(pts[1:3], lambda p: p.x) AS xs FROM lines")
def truncate_path(spark, sf_dir):
    """The first n + 1 vertices, n = 2."""
    return lines(spark, sf_dir).select("fid", F.slice("geom", 1, 3)["x"].alias("xs"))


@query("undo_points", f"WITH {LINES} SELECT fid, greatest(len(pts) - 2, 1)::INT AS n, list_filter([0, 2, 4, 6], lambda c: c < greatest(len(pts) - 2, 1)) AS checkpoints FROM lines")
def undo_points(spark, sf_dir):
    """Without its last two points, but for one at least; checkpoints past the end go."""
    n = F.greatest(F.size("geom") - 2, F.lit(1))
    return lines(spark, sf_dir).withColumn("path", F.slice("geom", F.lit(1), n)).select("fid", F.size("path").alias("n"), F.filter(F.array(*map(F.lit, (0, 2, 4, 6))), lambda c: c < F.size("path")).alias("checkpoints"))


@query("distinct_prompts", f"""WITH RECURSIVE {RANKED}, s AS (
  SELECT session, n, [{{'x': x, 'y': y}}] AS kept FROM ranked WHERE n = 1
  UNION ALL SELECT r.session, r.n, CASE WHEN len(list_filter(s.kept, lambda q: sqrt((q.x - r.x) * (q.x - r.x) + (q.y - r.y) * (q.y - r.y)) < 40)) > 0 THEN s.kept ELSE list_append(s.kept, {{'x': r.x, 'y': r.y}}) END
  FROM s JOIN ranked r ON r.session = s.session AND r.n = s.n + 1)
SELECT session, list_transform(kept, lambda p: p.x) AS xs FROM (SELECT session, arg_max(kept, n) AS kept FROM s GROUP BY session)""")
def distinct_prompts(spark, sf_dir):
    """Prompts that are 40 apart from all kept before them, in order."""
    kept = scans.space(pointer_events(spark, sf_dir), 40.0)
    return kept.groupBy("session").agg(F.array_sort(F.collect_list(F.struct("n", "x")))["x"].alias("xs"))


@query("movement_gate", f"""WITH RECURSIVE {RANKED}, s AS (
  SELECT session, n, x, y, true AS kept FROM ranked WHERE n = 1
  UNION ALL SELECT r.session, r.n, CASE WHEN sqrt((s.x - r.x) * (s.x - r.x) + (s.y - r.y) * (s.y - r.y)) < 90 THEN s.x ELSE r.x END, CASE WHEN sqrt((s.x - r.x) * (s.x - r.x) + (s.y - r.y) * (s.y - r.y)) < 90 THEN s.y ELSE r.y END,
    sqrt((s.x - r.x) * (s.x - r.x) + (s.y - r.y) * (s.y - r.y)) >= 90 FROM s JOIN ranked r ON r.session = s.session AND r.n = s.n + 1)
SELECT session, x, y FROM s WHERE kept""")
def movement_gate(spark, sf_dir):
    """Moves closer than 90 to the last one kept are dropped."""
    return scans.gate(pointer_events(spark, sf_dir), 90.0).select("session", "x", "y")


UNDO_SQL = f"""WITH RECURSIVE {RANKED}, s AS (
  SELECT session, n, CASE WHEN kind IN ('press', 'drag') THEN 1 ELSE 0 END AS len, CASE WHEN kind = 'press' THEN [0] ELSE []::INT[] END AS cps FROM ranked WHERE n = 1
  UNION ALL SELECT r.session, r.n,
    CASE WHEN r.kind IN ('press', 'drag') THEN s.len + 1 WHEN r.kind = 'undo' AND len(s.cps) > 1 THEN
      CASE WHEN s.len - 1 > list_last(s.cps) THEN list_last(s.cps) + 1 ELSE s.cps[len(s.cps) - 1] + 1 END ELSE s.len END,
    CASE WHEN r.kind = 'press' THEN list_append(s.cps, s.len) WHEN r.kind = 'undo' AND len(s.cps) > 1 AND s.len - 1 <= list_last(s.cps) THEN s.cps[1:len(s.cps) - 1] ELSE s.cps END
  FROM s JOIN ranked r ON r.session = s.session AND r.n = s.n + 1)
SELECT session, arg_max(len, n)::INT AS path_len, arg_max(cps, n)::INT[] AS checkpoints FROM s GROUP BY session"""


@query("undo_to_checkpoint", UNDO_SQL)
def undo_to_checkpoint(spark, sf_dir):
    """A fold over presses, drags and undos: an undo trims to the last checkpoint or, when already there,
    drops it; with no checkpoint but the start it does nothing."""
    events = pointer_events(spark, sf_dir)
    kinds = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "kind"))), lambda e: e["kind"])
    start = F.struct(F.lit(0).alias("len"), F.array().cast("array<int>").alias("cps"))

    def step(s, kind):
        n, cps = s["len"], s["cps"]
        last, many = F.try_element_at(cps, F.lit(-1)), F.size(cps)
        past = n - 1 > last
        undone = F.struct(
            F.when(past, last + 1).otherwise(F.try_element_at(cps, F.lit(-2)) + 1).alias("len"),
            F.when(past, cps).otherwise(F.slice(cps, F.lit(1), F.greatest(many - 1, F.lit(0)))).alias("cps"),
        )
        return (
            F.when(kind == "press", F.struct((n + 1).alias("len"), F.concat(cps, F.array(n)).alias("cps")))
            .when(kind == "drag", F.struct((n + 1).alias("len"), cps.alias("cps")))
            .when((kind == "undo") & (many > 1), undone).otherwise(s)
        )

    return events.groupBy("session").agg(kinds.alias("kinds")).select("session", F.aggregate("kinds", start, step).alias("s")).select("session", F.col("s.len").alias("path_len"), F.col("s.cps").alias("checkpoints"))
