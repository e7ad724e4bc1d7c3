"""Streaming ingest with sliding-window template counts (D1) and
streaming deduplication (D2).  Declared only by the reference; the window
and watermark rules are ours.

The batch twins (``windowed_template_counts``, ``dedupe_within``) share the same
column logic, so a stream and a batch over the same rows agree.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed
from ..functions.text import message_template
from ..operators.alerts import severity_rank
from ..operators.dedupe import timed_repeats
from ..operators.ingest import ingest
from ..operators.rca import classify
from ..plans.analyze import finished
from ..sources.logs import _scanned, number_lines, split_positions


def windowed_template_counts(entries: DataFrame, size: str = "1 hour", slide: str = "15 minutes") -> DataFrame:
    """Entries -> ``(window_start, window_end, template, n)`` over sliding
    windows of event time ``ts``.  Templates may be empty or NULL.  Entries
    without a time are in no window; ``untimed_template_counts`` has them."""
    t = entries.select("ts", message_template("message").alias("template")).where(F.col("ts").isNotNull())
    g = t.groupBy(F.window("ts", size, slide).alias("w"), "template").agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "template", "n")


def untimed_template_counts(entries: DataFrame) -> DataFrame:
    """The counts of entries without a time, in the same columns with NULL
    window bounds.  On a stream this is an aggregate of its own, in update
    or complete mode, as no watermark can ever close it."""
    t = entries.where(F.col("ts").isNull()).select(message_template("message").alias("template"))
    g = t.groupBy("template").agg(F.count(F.lit(1)).alias("n"))
    none = F.lit(None).cast("timestamp_ntz")
    return g.select(none.alias("window_start"), none.alias("window_end"), "template", "n")


def stream_entries(lines_stream: DataFrame) -> DataFrame:
    """A streaming ``log_lines`` frame -> streaming ``log_entries`` (the
    batch ingest is a narrow transformation, so it runs unchanged).  A line of
    a file stream is known by its file, the offset of its split and its position
    there, from which its id is made: a task that is run again gives the
    same ids.  ``line_no`` is the position where the split is the whole file, else
    NULL."""
    if "pos" not in lines_stream.columns:
        return ingest(lines_stream)
    at = F.concat_ws("\x1f", "source", F.col("block_start").cast("string"))
    whole = (F.col("block_start") == 0) & (F.col("block_length") >= F.col("file_size"))
    key = F.when(whole, F.col("source")).otherwise(at)
    e = ingest(lines_stream.select(key.alias("source"), F.col("pos").alias("line_no"), "raw_line"))
    # An offset behind a control character marks lines of files in several splits.
    return e.withColumns({"line_no": F.when(~F.col("source").contains("\x1f"), F.col("line_no")), "source": F.substring_index("source", "\x1f", 1)})


def stream_template_counts(entries_stream: DataFrame, size: str = "1 hour", slide: str = "15 minutes",
                           watermark: str = "1 hour") -> DataFrame:
    """Watermarked sliding-window counts per template (append mode
    emits a window once the watermark passes its end).

    Watermarks need a ``timestamp`` (session time zone) event time; entry
    times are ``timestamp_ntz``, so they are cast for the watermark and the
    window bounds are cast back, matching the batch twin."""
    e = entries_stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    out = windowed_template_counts(e, size, slide)
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"),
                      F.col("window_end").cast("timestamp_ntz").alias("window_end"), "template", "n")


def stream_dedupe(entries_stream: DataFrame, keys: list[str], watermark: str = "1 hour") -> DataFrame:
    """D2 on a stream: drop repeats of ``keys`` seen within the watermark.
    Entries without a time have no place in event time; they are a stream
    of their own (``stream_untimed_repeats``)."""
    t = entries_stream.where(F.col("ts").isNotNull()).withColumn("template", message_template("message"))
    t = t.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    return t.dropDuplicatesWithinWatermark(keys).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def stream_dedupe_within(entries_stream: DataFrame, keys: list[str], within: str, watermark: str = "1 hour") -> DataFrame:
    """The streaming twin of ``timed_repeats``: one row for each burst of a
    key, in append mode once the watermark has passed its end.  Entries without
    a time can't be closed by a watermark: ``stream_untimed_repeats``."""
    t = entries_stream.withColumn("template", message_template("message"))
    t = t.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    d = timed_repeats(t, keys, within)
    return d.select(*keys, *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("first_ts", "last_ts")], "dup_count")


def stream_untimed_repeats(entries_stream: DataFrame, keys: list[str], idle: str = "1 hour") -> DataFrame:
    """``(keys..., dup_count)`` of entries without a time: repeats of a key are
    counted in keyed state by arrival, and a group is given out when ``idle`` of
    processing time has passed without another.  Together with
    ``stream_dedupe_within`` every entry is in some ``dup_count``."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    wait = int(idle_seconds(idle) * 1000)
    schema = T.StructType([*[entries_stream.schema[k] for k in keys], T.StructField("dup_count", T.LongType())])

    def run(key, frames, state):
        n = state.get[0] if state.exists else 0
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(*key, n)], columns=schema.names)
            return
        n += sum(len(f) for f in frames)
        state.update((n,))
        state.setTimeoutDuration(wait)

    t = entries_stream.where(F.col("ts").isNull()).select(*keys)
    return t.groupBy(*keys).applyInPandasWithState(run, schema, "n long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def idle_seconds(text: str) -> float:
    """Seconds of a span such as ``30 minutes``."""
    n, unit = text.split()
    return float(n) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")]


def stream_escalations(entries_stream: DataFrame, key: str, silence: str = "30 minutes", watermark: str = "10 minutes") -> DataFrame:
    """D3 on a stream: ``(key, at, severity)``, the streaming twin of
    ``escalations``.  Keyed state holds the severity that was last told and the
    time of the last entry; an entry above the former is an alert, and after
    ``silence`` without one the key begins anew (an event-time timer).  Entries of
    a key that come in one micro-batch are taken in order of time, later ones
    as long as the watermark lets them in."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    gap = idle_seconds(silence)
    names = [s for _, s in reversed(fixed.SEVERITY_BY_LEVEL)]
    schema = T.StructType([entries_stream.schema[key], T.StructField("at", T.TimestampType()), T.StructField("severity", T.StringType())])

    def run(who, frames, state):
        told, last = state.get if state.exists else (0, None)
        out = []
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values(["ts", "rank"], ascending=[True, False])
        for ts, rank in zip(rows["ts"], rows["rank"], strict=True):
            at = ts.timestamp()
            if last is not None and at > last + gap:
                told = 0
            if rank > told:
                told = int(rank)
                out.append((who[0], ts, names[told - 1]))
            last = at if last is None else max(last, at)
        state.update((told, last))
        state.setTimeoutTimestamp(max(int((last + gap) * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=schema.names)

    t = entries_stream.where(F.col("ts").isNotNull()).select(key, F.col("ts").cast("timestamp").alias("ts"), severity_rank("level").alias("rank"))
    t = t.where("rank > 0").withWatermark("ts", watermark)
    return t.groupBy(key).applyInPandasWithState(run, schema, "told int, last double", "append", GroupStateTimeout.EventTimeTimeout)


def resolve_stream(clusters_stream: DataFrame, replies_stream: DataFrame, timeout: str = "70 seconds", classify_fn=None) -> DataFrame:
    """R9 on streams: clusters ``(asked_at timestamp, ...)`` wait ``timeout``
    for their reply ``(cluster_no, response, replied_at timestamp)``; without one
    the rules decide, as after a time-out of the request.  A stream-stream left
    outer join in append mode: a result with a reply comes at once, the others
    when the watermark has passed the time-out.  A reply that comes later than
    that is not used."""
    c = (classify_fn or (lambda d: classify(d, msg="rep_message")))(clusters_stream).withWatermark("asked_at", "0 seconds")
    r = replies_stream.select(F.col("cluster_no").alias("_no"), F.col("response").alias("_response"), "replied_at").withWatermark("replied_at", "0 seconds")
    in_time = (F.col("cluster_no") == F.col("_no")) & (F.col("replied_at") >= F.col("asked_at")) & (F.col("replied_at") <= F.col("asked_at") + F.expr(f"INTERVAL {timeout}"))
    return finished(c.join(r, in_time, "leftOuter").withColumn("_got", F.col("_no").isNotNull()))


def read_log_stream(spark, path: str | None = None, kafka: dict | None = None, source_name: str = "stream") -> DataFrame:
    """Streaming ``log_lines``.

    * ``path``: new text files in a folder (one row per line; ``source`` is
      the file path), with the line's place: ``block_start`` (the split's
      byte offset), ``block_length``, ``file_size`` and ``pos`` (position in the
      split).  ``line_no`` is NULL; ``number_lines`` gives each micro-batch the
      line numbers of ``read_log_lines`` (``cluster_each_batch`` does this).
    * ``kafka``: options for the Kafka source (``kafka.bootstrap.servers``,
      ``subscribe``, ...; ``startingOffsets`` defaults to ``earliest``).
      ``source`` is ``topic:partition`` and ``line_no`` the offset.  Needs
      the Kafka connector on the classpath.
    """
    if (path is None) == (kafka is None):
        raise ValueError("give exactly one of path or kafka")
    if path is not None:
        return split_positions(_scanned(spark.readStream.format("text").load(path))).withColumn("line_no", F.lit(None).cast("bigint"))
    opts = {"startingOffsets": "earliest", **kafka}
    df = spark.readStream.format("kafka").options(**opts).load()
    return df.select(
        F.concat_ws(":", "topic", F.col("partition").cast("string")).alias("source"),
        F.col("offset").alias("line_no"),
        F.col("value").cast("string").alias("raw_line"),
    )


def cluster_each_batch(lines_stream: DataFrame, write_results, checkpoint_location: str,
                       trigger: dict | None = None, threshold: float | None = None):
    """C2-C4 per micro-batch: clustering is not an append-only stateful
    operator, so each micro-batch of lines is clustered as a batch (the
    full ``analyze`` plan) inside ``foreachBatch`` and handed to
    ``write_results(results_df, batch_id)``.  Returns the started query."""
    from ..plans.analyze import analyze

    t = fixed.SIMILARITY_THRESHOLD if threshold is None else threshold

    def run(batch_df, batch_id):
        lines = number_lines(batch_df.drop("pos", "line_no")) if "block_start" in batch_df.columns else batch_df
        write_results(analyze(lines, threshold=t), batch_id)

    w = lines_stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint_location)
    w = w.trigger(**(trigger or {"availableNow": True}))
    return w.start()
