"""First row per group without a sort-based aggregate.

``min(struct(...))`` over wide rows has a variable-width buffer, which
Spark can only run as a sort aggregate: every task would sort all its rows.
Instead: (1) a hash aggregate per ``(group, source)`` keeps ``count`` and
``min(line_no)`` (fixed-width buffers, map-side partial aggregation, so a
hot group costs one partial row per task); (2) the smallest ``(source,
line)`` per group is picked on that smaller table; (3) the chosen rows
are fetched with an equi-join on ``(source, line_no)``.  Whether that join
broadcasts is left to the optimizer, which knows the bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_keys(df: DataFrame, keys: list[str], source: str = "source", line: str = "line_no") -> DataFrame:
    """``(keys..., n, _s, _l)``: group size and the lowest ``(source, line)``."""
    per_src = df.groupBy(*keys, source).agg(F.count(F.lit(1)).alias("_n"), F.min(line).alias("_l"))
    g = per_src.groupBy(*keys).agg(F.sum("_n").alias("n"), F.min(F.struct(F.col(source), F.col("_l"))).alias("_k"))
    return g.select(*keys, "n", F.col("_k")[source].alias("_s"), F.col("_k._l").alias("_l"))


def fetch_rows(df: DataFrame, firsts: DataFrame, source: str = "source", line: str = "line_no") -> DataFrame:
    """Join the chosen ``(_s, _l)`` keys back to their rows (one row each).
    Null-safe keys: a row with a NULL source or line is still fetched."""
    return df.join(firsts, df[source].eqNullSafe(firsts["_s"]) & df[line].eqNullSafe(firsts["_l"]))


def first_per_group(df: DataFrame, keys: list[str], cols: list[str], source: str = "source",
                    line: str = "line_no") -> DataFrame:
    """``(keys..., cols..., n)``: for each group the columns of its first row
    by ``(source, line)`` and the group's row count."""
    from ..session import checkpoint_dir

    checkpoint_dir(df.sparkSession)
    # One group row per key, written once: joining it does not read the input again.
    firsts = first_keys(df, keys, source, line).checkpoint()
    data = df.select(*[F.col(c).alias(f"_d_{c}") for c in dict.fromkeys([source, line, *cols])])
    j = fetch_rows(data, firsts, f"_d_{source}", f"_d_{line}")
    return j.select(*keys, *[F.col(f"_d_{c}").alias(c) for c in cols], "n")
