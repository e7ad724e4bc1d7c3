"""Ingest (I1-I11): raw lines -> ``log_entries``.

One narrow transformation (projections and a filter, no shuffle, no UDF):
strip, drop blanks, dispatch on the first character, full-match the two
plain-text grammars, scan JSON lines for aliased keys, normalise the level,
parse the timestamp and derive a stable entry id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.jsonfields import json_aliased
from ..functions.text import is_blank, java_strip, java_trim

def clean_lines(lines: DataFrame) -> DataFrame:
    """Drop null/blank lines; ``line`` is the stripped text."""
    return lines.where(~is_blank("raw_line")).withColumn("line", java_strip("raw_line"))


def tag_format(df: DataFrame, line_col: str = "line") -> DataFrame:
    """``format`` = 'json' for lines starting with ``{``, else 'plain'."""
    return df.withColumn(
        "format", F.when(F.col(line_col).startswith("{"), "json").otherwise("plain")
    )


def normalize_level(c) -> F.Column:
    """I8: upper-case; WARNING->WARN, CRITICAL->FATAL; other/NULL->UNKNOWN."""
    u = F.upper(java_trim(c))
    known = [lv for lv in fixed.LEVELS if lv != "UNKNOWN"]
    out = F.when(u.isin(*known), u)
    for alias, lv in fixed.LEVEL_ALIASES.items():
        out = out.when(u == alias, F.lit(lv))
    return out.otherwise(F.lit("UNKNOWN"))


def parse_ts(c, on_bad: str = "null") -> F.Column:
    """Trim, every 'T' -> ' ', then ``yyyy-MM-dd HH:mm:ss[.SSS]`` as a
    ``timestamp_ntz``.  A bad or missing text gives NULL (``on_bad='null'``,
    reproducible) or the current local time (``on_bad='now'``).

    The calendar is lenient as LocalDateTime.parse is: a day up to 31 that the
    month lacks is its last day, and 24:00:00 is the next day's start."""
    t = F.translate(java_trim(c), "T", " ")
    ok = t.rlike(fixed.TIMESTAMP_TEXT)
    strict = t.try_cast("timestamp_ntz")
    first = F.concat(F.substring(t, 1, 8), F.lit("01")).try_cast("date")
    day, hour = F.substring(t, 9, 2).try_cast("int"), F.substring(t, 12, 2)
    last = F.least(day, F.dayofmonth(F.last_day(first)))
    midnight = (hour == "24") & F.substring(t, 15, 20).rlike(r"^00:00(\.0+)?$")
    time = F.when(midnight, F.lit("00:00:00")).otherwise(F.substring(t, 12, 20))
    date = F.when(day.between(1, 31), F.date_add(first, last - 1 + midnight.cast("int")))
    lenient = F.concat_ws(" ", date.cast("string"), F.when(date.isNotNull(), time)).try_cast("timestamp_ntz")
    ts = F.when(ok, F.coalesce(strict, F.when(date.isNotNull(), lenient)))
    if on_bad == "now":
        return F.coalesce(ts, F.localtimestamp())
    if on_bad != "null":
        raise ValueError("on_bad must be 'null' or 'now'")
    return ts


_SEP = "\u0001"


def _groups(line, pattern: str, n: int):
    """All ``n`` groups of a full-line match with one regex evaluation.

    The match is rewritten to ``SEP g1 SEP g2 ...`` and split (limit ``n+1``
    so the last group may itself hold SEP).  A match always starts with a
    digit, so "rewritten" is "now starts with SEP while the line did not".
    Returns an ``array<string>`` (index 1..n) or NULL when no match.
    """
    rep = "".join(f"{_SEP}${i}" for i in range(1, n + 1))
    r = F.regexp_replace(line, pattern, rep)
    hit = r.startswith(_SEP) & ~line.startswith(_SEP)
    return F.when(hit, F.split(r, _SEP, n + 1))


_JSON_SPEC = {
    "ts_text": (fixed.JSON_TS_KEYS, None),
    "level_text": (fixed.JSON_LEVEL_KEYS, "UNKNOWN"),
    "service": (fixed.JSON_SERVICE_KEYS, fixed.UNKNOWN_SERVICE),
    "message": (fixed.JSON_MESSAGE_KEYS, None),
}


def parse_lines(lines: DataFrame) -> DataFrame:
    """Wide parse of every line, one row out per row in.

    Adds ``line`` (stripped; NULL when blank), ``branch`` ('service',
    'noservice', 'json'; NULL for blank or unparsable rows) and the raw
    field texts ``ts_text``, ``level_text``, ``service``, ``message``.

    Each grammar's regex runs once per row (see ``_groups``); the staged
    projections keep Catalyst from inlining an expensive column into
    several consumers.
    """
    s1 = lines.select("*", java_strip("raw_line").alias("_line")).select(
        "*", (F.length("_line") == 0).alias("_blank")
    )
    line = F.col("_line")
    json = ~F.col("_blank") & line.startswith("{")
    plain = ~F.col("_blank") & ~line.startswith("{")
    s2 = s1.select(
        "*",
        F.when(plain, _groups(line, fixed.PLAIN_WITH_SERVICE, 4)).alias("_g1"),
        F.when(json, json_aliased(line, _JSON_SPEC)).alias("_j"),
    )
    s3 = s2.select(
        "*",
        F.when(plain & F.col("_g1").isNull(), _groups(line, fixed.PLAIN_NO_SERVICE, 3)).alias("_g2"),
    )
    g1, g2, j = F.col("_g1"), F.col("_g2"), F.col("_j")
    is_json, svc, nosvc = j.isNotNull(), g1.isNotNull(), g2.isNotNull()

    def pick(jv, v1, v2):
        return F.when(is_json, jv).when(svc, v1).when(nosvc, v2)

    return s3.select(
        *lines.columns,
        F.when(~F.col("_blank"), line).alias("line"),
        pick(F.lit("json"), F.lit("service"), F.lit("noservice")).alias("branch"),
        pick(j["ts_text"], g1[1], g2[1]).alias("ts_text"),
        pick(j["level_text"], g1[2], g2[2]).alias("level_text"),
        pick(j["service"], java_trim(g1[3]), F.lit(fixed.UNKNOWN_SERVICE)).alias("service"),
        pick(j["message"], java_trim(g1[4]), java_trim(g2[3])).alias("message"),
    )


def entry_id(source="source", line_no="line_no") -> F.Column:
    """Stable id = sha256 of ``source:line_no`` (recomputes identically,
    unlike a random UUID)."""
    return F.sha2(F.concat_ws(":", F.col(source), F.col(line_no).cast("string")), 256)


def ingest(lines: DataFrame, on_bad: str = "null", observation=None) -> DataFrame:
    """``log_lines`` -> ``log_entries`` (unparsable and blank rows
    dropped).  Columns: id, source, line_no, ts, level, service, message,
    raw_line (the stripped line).

    With ``observation`` (a ``pyspark.sql.Observation``) the parse counts of
    A1 are gathered while the first action on the result runs.

    Parsed rows leave through a generator (0 or 1 row per line) rather
    than a filter: a filter on a parse result would be pushed below the
    projection and evaluate every regex a second time.
    """
    p = parse_lines(lines)
    if observation is not None:
        # A1 as a side effect of the ingest job itself: no extra pass.
        parsed = F.col("branch").isNotNull()
        p = p.observe(
            observation,
            F.count(F.lit(1)).alias("total_lines"),
            F.count_if(F.col("line").isNull()).alias("blank_lines"),
            F.count_if(parsed).alias("parsed_lines"),
            F.count_if(F.col("line").isNotNull() & ~parsed).alias("rejected_lines"),
        )
    entry = F.struct(
        entry_id().alias("id"),
        F.col("source"),
        F.col("line_no"),
        parse_ts("ts_text", on_bad).alias("ts"),
        normalize_level("level_text").alias("level"),
        F.col("service"),
        F.col("message"),
        F.col("line").alias("raw_line"),
    )
    return p.select(F.inline(F.when(F.col("branch").isNotNull(), F.array(entry))))


def rejected_lines(lines: DataFrame) -> DataFrame:
    """I5 complement: non-blank lines that match no grammar (same scan, the
    opposite predicate; no join)."""
    p = parse_lines(lines)
    return p.where(F.col("line").isNotNull() & F.col("branch").isNull()).select(
        "source", "line_no", "line"
    )
