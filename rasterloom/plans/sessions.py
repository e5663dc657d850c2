"""Queries that replay tracing sessions; the streaming form is tested to do the same."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..registry import query
from ..streaming.sessions import KEEP, OUT, replay, stream, written
from ..streaming.tracing import trace
from .fixtures import pointer_events, table


def line_owners(spark, sf_dir):
    """line_id, session: the user whose line it is."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("line_id"), F.expr("o_custkey div 10").alias("session"))


def user_layer(spark, sf_dir):
    """session, line_id, geom: each user's own output layer, ten customers' orders as lines."""
    from ..operators.lines import make_polyline
    from .fixtures import line_pts

    return make_polyline(line_pts(spark, sf_dir)).join(line_owners(spark, sf_dir), "line_id").select("session", "line_id", "geom")


def user_ends(spark, sf_dir):
    """The first and the last point of each line of user_layer, found without the lines."""
    from .pixels import ends

    told = ends(spark, sf_dir).select("line_id", F.col("x1").alias("x0"), F.col("y1").alias("y0"), F.col("x2").alias("x1"), F.col("y2").alias("y1"))
    return told.join(line_owners(spark, sf_dir), "line_id").select("session", "line_id", "x0", "y0", "x1", "y1")


def replayed(spark, sf_dir):
    return replay(pointer_events(spark, sf_dir), user_ends(spark, sf_dir))


@query("session_press")
def session_press(spark, sf_dir):
    """What presses did; some go on at an end of a line of the user's layer, or of one that the session has saved."""
    return replayed(spark, sf_dir).where("action in ('started', 'resumed', 'spot', 'closed', 'checkpoint')")


@query("session_move")
def session_move(spark, sf_dir):
    """What moves and drags did with the pixels of the user's view (user % 10): routes over edge cost, snaps to edges."""
    from .routes import costs

    pixels = costs(spark, sf_dir).withColumns({"edge": F.col("cost") > 1 + 150 / 16, "px_w": F.lit(8.0), "px_h": F.lit(2.0), "y_max": F.lit(100.0)})
    events = pointer_events(spark, sf_dir).withColumn("img_id", F.col("session") % 10)
    return trace(events, pixels, user_ends(spark, sf_dir)).where("action in ('extended', 'preview', 'gated')")


@query("session_key")
def session_key(spark, sf_dir):
    return replayed(spark, sf_dir).where("action in ('undone', 'kept', 'saved', 'merged', 'cancelled')")


@query("reset_session")
def reset_session(spark, sf_dir):
    """How often each session's path ended: saved, closed, made a spot, dropped or given up after a time."""
    ended = "action in ('saved', 'merged', 'closed', 'spot', 'cancelled', 'expired')"
    return replayed(spark, sf_dir).where(ended).groupBy("session").agg(F.count(F.lit(1)).alias("resets"))


@query("session_lines")
def session_lines(spark, sf_dir):
    """The lines that sessions made or changed, as they are at the end."""
    layer = user_layer(spark, sf_dir)
    return written(layer, replay(pointer_events(spark, sf_dir), user_ends(spark, sf_dir))).where("changed").select("session", "line_id", "geom")


@query("source_pointer_events")
def source_pointer_events(spark, sf_dir):
    """What the stateful stream does with the events, read as a stream until no more are there (availableNow), in the shared
    folder: presses meet the user's layer and the lines that the stream has saved, and paths are given up by event time. A
    last event of kind `tick` moves the watermark past all that wait."""
    from ..sources.layers import shared_folder

    # A streaming source reads folders; the events may be one file.
    source, ends, out, state = (f"{shared_folder(spark)}/{n}-{uuid.uuid4().hex}" for n in ("events", "ends", "replayed", "replay-state"))
    events = pointer_events(spark, sf_dir)
    events.write.parquet(source)
    tick = F.timestamp_micros(F.unix_micros(F.max("ts")) + F.lit(KEEP + 60_000_000)).alias("ts")
    events.agg(tick).where("ts is not null").select(F.lit(-1).cast("bigint").alias("session"), "ts", F.lit(-1).cast("bigint").alias("event_id"), *(F.lit(0.0).alias(c) for c in "xy"), F.lit("tick").alias("kind"), F.lit(False).alias("manual")).select(*events.columns).write.mode("append").parquet(source)
    user_ends(spark, sf_dir).write.parquet(ends)
    read = spark.readStream.schema(events.schema).parquet(source)
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream(read, spark.read.parquet(ends)).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(provider) if before is None else spark.conf.set(provider, before)
    return spark.read.schema(OUT).parquet(out)


@query("cache_invalidation", "SELECT user_id AS session, count(*) FILTER (event_type = 'view' AND k % 4 <> coalesce(p, -1)) AS recomputed FROM (SELECT *, lag(k % 4) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM (SELECT *, json_extract(props, '$.k')::INT AS k FROM events WHERE event_type = 'view')) GROUP BY user_id")
def cache_invalidation(spark, sf_dir):
    """How often a session's view changes, so that what was cached of it is computed anew."""
    from pyspark.sql import Window

    views = table(spark, sf_dir, "events").where("event_type = 'view'").withColumn("view", F.get_json_object("props", "$.k").cast("int") % 4)
    before = F.lag("view").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return views.withColumn("new", F.col("view") != F.coalesce(before, F.lit(-1))).groupBy(F.col("user_id").alias("session")).agg(F.count_if("new").alias("recomputed"))
