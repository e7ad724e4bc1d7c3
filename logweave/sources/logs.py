"""Log sources: text files, multi-line payloads, and the ``log_lines`` view
derived from the ``events`` table.

Every source yields the same frame ``log_lines(source string, line_no bigint,
raw_line string)``.  ``(source, line_no)`` is the order key used everywhere
downstream (cluster numbering, representatives, "first 20 lines").
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import is_blank
from ..session import ship_package

LOG_LINES_SCHEMA = "source string, line_no bigint, raw_line string"


#: Splits of files in more than one split, up to which their table is sent to the lines.
SPLITS = 100_000


def split_positions(rows: DataFrame) -> DataFrame:
    """``rows`` of a text scan with ``pos``, the line's number in its split.

    A scan task hands over a split's lines in order, one split after the
    other, so this is one narrow pass that counts; no lines are moved.  It runs on
    a stream as well."""
    ship_package(rows.sparkSession)
    at = rows.columns.index("source"), rows.columns.index("block_start")
    schema = T.StructType([*rows.schema.fields, T.StructField("pos", T.LongType())])

    def run(batches):
        last, n = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(k) for k in at]
            new = np.zeros(batch.num_rows, bool)
            for c in keys:
                new[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
            new[0] = (keys[0][0].as_py(), keys[1][0].as_py()) != last
            k = np.arange(batch.num_rows)
            begin = np.maximum.accumulate(np.where(new, k, -1))
            pos = np.where(begin >= 0, k - begin, n + k) + 1
            last, n = (keys[0][-1].as_py(), keys[1][-1].as_py()), int(pos[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pos, pa.int64())], schema=pa.schema([*batch.schema, ("pos", pa.int64())]))

    return rows.mapInArrow(run, schema)


def number_lines(rows: DataFrame, n_splits: int | None = None) -> DataFrame:
    """``(source, raw_line, block_start, block_length, file_size)`` of a text
    scan -> ``log_lines`` with each line's true number in its file, from 1.

    A line's number is its position inside its split plus the lines of the
    file's earlier splits, so it does not depend on how files were split,
    packed into tasks or on the number of cores.  Files of one split need no
    more than the position.  For the others a table of their splits is joined by
    file and offset; it is sent to the lines if there are at most ``SPLITS`` such
    splits by ``n_splits``, a bound known from the files' sizes (0: no such file
    and no join; None: left to the optimizer)."""
    at = split_positions(rows)
    whole = (F.col("block_start") == 0) & (F.col("block_length") >= F.col("file_size"))
    if n_splits == 0:
        return at.select("source", F.col("pos").alias("line_no"), "raw_line")
    splits = at.where(~whole).groupBy("source", "block_start").agg(F.max("pos").alias("_n"))
    earlier = Window.partitionBy("source").orderBy("block_start").rowsBetween(Window.unboundedPreceding, -1)
    base = splits.select("source", "block_start", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    if n_splits is not None and n_splits <= SPLITS:
        base = F.broadcast(base)
    cut = at.where(~whole).join(base, ["source", "block_start"]).select("source", (F.col("pos") + F.col("_base")).alias("line_no"), "raw_line")
    return at.where(whole).select("source", F.col("pos").alias("line_no"), "raw_line").unionByName(cut)


def _scanned(df: DataFrame) -> DataFrame:
    m = F.col("_metadata")
    return df.select(m["file_path"].alias("source"), F.col("value").alias("raw_line"), m["file_block_start"].alias("block_start"),
                     m["file_block_length"].alias("block_length"), m["file_size"].alias("file_size"))


def _bytes(text: str) -> int:
    n = text.strip().lower().removesuffix("b")
    return int(n[:-1]) << {"k": 10, "m": 20, "g": 30, "t": 40}[n[-1]] if n[-1].isalpha() else int(n)


def split_bound(spark: SparkSession, path: str) -> int:
    """At most so many splits are those of files in several splits.  A split
    is no smaller than the cost of opening a file, unless the session's splits
    are; the files are listed, not read."""
    least = min(_bytes(spark.conf.get(f"spark.sql.files.{k}")) for k in ("openCostInBytes", "maxPartitionBytes"))
    sizes = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(path).select("length")
    return int(sizes.where(F.col("length") > least).agg(F.sum(F.ceil(F.col("length") / least))).first()[0] or 0)


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """UTF-8 text file(s) -> one row per line, with ``source`` (the file
    path) and ``line_no`` (the line's number in the file, see
    ``number_lines``).  Files are read in parallel splits; nothing passes
    through the driver.
    """
    return number_lines(_scanned(spark.read.text(path)), split_bound(spark, path))


def write_lines(lines: DataFrame, path: str, file: Column) -> None:
    """Write ``log_lines`` as text, one file for each value of ``file`` (a
    folder ``file=value``), lines in order of ``line_no``."""
    rows = lines.select(file.alias("file"), "line_no", "raw_line").repartition("file").sortWithinPartitions("file", "line_no")
    rows.select("file", "raw_line").write.partitionBy("file").text(path)


def split_payload(df: DataFrame, text_col: str, key_col: str, source: str | None = None) -> DataFrame:
    """One text payload per row -> one row per line (split on ``\\r?\\n``).

    Trailing empty strings are dropped (Java ``String.split`` semantics);
    ``line_no`` is the 1-based position inside the payload.
    """
    parts = F.split(F.col(text_col), r"\r?\n")
    # Drop the trailing run of empty strings: keep up to the last non-empty part.
    last = F.array_max(
        F.transform(parts, lambda x, i: F.when(F.length(x) > 0, i + 1).otherwise(F.lit(0)))
    )
    kept = F.slice(parts, 1, F.greatest(last, F.lit(0)))
    src = F.lit(source) if source is not None else F.col(key_col).cast("string")
    return df.select(
        F.col(key_col),
        src.alias("source"),
        F.posexplode(kept).alias("pos", "raw_line"),
    ).select(key_col, "source", (F.col("pos") + 1).cast("bigint").alias("line_no"), "raw_line")


def filter_payloads(df: DataFrame, text_col: str) -> DataFrame:
    """S3: refuse blank payloads (null, empty or whitespace only)."""
    return df.where(~is_blank(text_col))


# --- the synthetic ``log_lines`` view over ``events`` ------------------------
# One expression per output column; the same text (with the two marked
# differences) is the DuckDB oracle's ``log_lines``.
_MSG_CASE = """CASE event_id % 13
   WHEN 0 THEN 'Buoy b' || CAST(user_id AS STRING) || ' drifted ' || CAST(event_id AS STRING) || ' m off its mooring'
   WHEN 1 THEN 'Pilot roster ended in an npe, watch ' || CAST(event_id % 3 AS STRING)
   WHEN 2 THEN 'Radar sweep ' || CAST(event_id AS STRING) || ' lost: timeout'
   WHEN 3 THEN 'Manifest of agent u' || CAST(user_id AS STRING) || ' forbidden by customs'
   WHEN 4 THEN 'Fog horn tested'
   WHEN 5 THEN 'Chart tile 0x' || {hex} || ' evicted, store out of memory'
   WHEN 6 THEN 'Berth planner at ' || CAST(event_id % 100 AS STRING) || ' percent of its heap'
   WHEN 7 THEN 'Ferry ' || CAST(event_id % 40 AS STRING) || ' cleared the lock'
   WHEN 8 THEN 'Tide gauge reading ' || CAST(event_id AS STRING) || ' taken'
   WHEN 9 THEN 'Tide gauge reading ' || CAST(event_id AS STRING) || ' taken, rounded to 3 cm'
   WHEN 10 THEN 'Tide gauge reading ' || CAST(event_id AS STRING) || ' rounded to 3 cm, then filed by quay'
   WHEN 11 THEN 'Crane ' || CAST(event_id % 6 AS STRING) || ' wants a new connection to the yard'
   ELSE 'Ice report: nothing new' END"""

_LVL_CASE = """CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'CRITICAL'
   WHEN 'signup' THEN 'WARNING' WHEN 'click' THEN 'INFO' ELSE 'NOTICE' END"""

_TS_CASE = """CASE event_id % 7 WHEN 1 THEN replace(t0, ' ', 'T') WHEN 2 THEN t0 || '.123'
   WHEN 3 THEN t0 || '.1' ELSE t0 END"""

_LINE_CASE = """CASE
  WHEN event_id % 30 = 29 THEN '   '
  WHEN event_id % 10 = 9 THEN 'garbage ' || msg
  WHEN event_id % 10 = 8 THEN ts_txt || ' ' || lvl || '  ' || msg
  WHEN event_id % 30 = 27 THEN '{"timestamp":null,"time":"' || ts_txt || '","level":"warn","service":"' || svc || '","tags":["a","b"]}'
  WHEN event_id % 30 = 17 THEN '{"time":"' || ts_txt || '","severity":"' || lvl || '","logger":"' || svc || '","msg":"' || msg || '","n":' || CAST(event_id AS STRING) || '}'
  WHEN event_id % 10 = 7 THEN '{"timestamp": "' || ts_txt || '", "level": "' || lvl || '", "service": "' || svc || '", "message": "' || msg || '"}'
  ELSE '  ' || ts_txt || ' ' || lvl || ' ' || svc || ' - ' || msg || ' ' END"""


def log_lines_exprs(fmt: str, hexpr: str, string_type: str = "STRING") -> tuple[list[str], str, str]:
    """SQL expression texts for one engine: the first projection's list, the
    timestamp-text CASE and the raw-line CASE."""
    first = [
        "event_id",
        "user_id",
        "event_type",
        f"{fmt} AS t0",
        f"{_LVL_CASE} AS lvl",
        "'svc-' || CAST(user_id % 5 AS STRING) AS svc",
        f"{_MSG_CASE.format(hex=hexpr)} AS msg",
    ]
    return (
        [e.replace("STRING", string_type) for e in first],
        _TS_CASE,
        _LINE_CASE.replace("STRING", string_type),
    )


def log_lines_from_events(events: DataFrame) -> DataFrame:
    """The ``log_lines`` view over ``events``: every parse branch occurs
    (plain with/without service, JSON with aliases, garbage, blank).
    Narrow projection only; grows linearly with ``events``."""
    first, ts_case, line_case = log_lines_exprs(
        "date_format(ts, 'yyyy-MM-dd HH:mm:ss')", "lower(hex(event_id))"
    )
    return (
        events.selectExpr(*first)
        .selectExpr("*", f"{ts_case} AS ts_txt")
        .selectExpr("'events' AS source", "event_id AS line_no", f"{line_case} AS raw_line")
    )


def load_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``log_lines`` for a test-data directory (reads ``events.parquet``;
    only the columns the view needs reach the scan)."""
    from .tables import read_parquet

    return log_lines_from_events(read_parquet(spark, f"{sf_dir}/events.parquet"))
