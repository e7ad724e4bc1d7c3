"""Root-cause rows: keyword rules (R1-R3), replies with rule fallback (R9),
result ids (R11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed


def _rule_column(msg: Column, rules, default, pick) -> Column:
    m = F.lower(F.coalesce(msg, F.lit("")))
    out = None
    for rule in rules:
        kws, vals = rule[0], rule[1:]
        cond = None
        for k in kws:
            c = m.contains(k)
            cond = c if cond is None else (cond | c)
        out = F.when(cond, pick(vals)) if out is None else out.when(cond, pick(vals))
    d = pick(default)
    return d if out is None else out.otherwise(d)


def rule_columns(msg="message", rules=None, default=None) -> dict[str, Column]:
    """R1/R2 as columns: first rule whose keyword occurs in the lower-cased
    message wins; otherwise the default.  Patterns carry the heuristic
    prefix."""
    rules = fixed.RULES if rules is None else rules
    default = fixed.DEFAULT_RULE if default is None else default
    msg = F.col(msg) if isinstance(msg, str) else msg
    return {
        "error_pattern": _rule_column(msg, rules, default, lambda v: F.lit(fixed.HEURISTIC_PREFIX + v[0])),
        "root_cause": _rule_column(msg, rules, default, lambda v: F.lit(v[1])),
        "fix_suggestion": _rule_column(msg, rules, default, lambda v: F.lit(v[2])),
        "confidence_score": _rule_column(msg, rules, default, lambda v: F.lit(float(v[3]))),
    }


def classify(df: DataFrame, msg: str = "message", rules=None, default=None) -> DataFrame:
    """Add error_pattern, root_cause, fix_suggestion, confidence_score."""
    cols = rule_columns(msg, rules, default)
    return df.select("*", *[c.alias(n) for n, c in cols.items()])


#: Characters of the keywords of one automaton, and messages matched by one task.
PART, SLOT = 2_000_000, 100_000
_RULE = "struct<priority:int,error_pattern:string,root_cause:string,fix_suggestion:string,confidence_score:double>"


def _matched(texts, rules):
    """For each message of a slot the first rule, by ``no``, whose keyword
    occurs in it: one pass of an Aho-Corasick automaton over its text."""
    import ahocorasick
    import pyarrow as pa

    numbers = rules.column("_no").to_pylist()
    first: dict[str, int] = {}
    for at, kw in enumerate(rules.column("_kw").to_pylist()):
        if kw not in first or numbers[at] < numbers[first[kw]]:
            first[kw] = at
    always = first.pop("", None)
    automaton = ahocorasick.Automaton()
    for kw, at in first.items():
        automaton.add_word(kw, (numbers[at], at))
    if first:
        automaton.make_automaton()
    rows, picked = [], []
    for k, text in enumerate(texts.column("_text").to_pylist()):
        best = min((hit for _, hit in automaton.iter(text)), default=None) if first else None
        if always is not None:
            best = min(best or (numbers[always], always), (numbers[always], always))
        if best is not None:
            rows.append(k)
            picked.append(best[1])
    kept = texts.select(["_k1", "_k2", "_n"]).take(pa.array(rows, pa.int64()))
    rule = rules.select(["_no", "_rule"]).take(pa.array(picked, pa.int64()))
    return pa.table({**{c: kept.column(c) for c in kept.column_names}, **{c: rule.column(c) for c in rule.column_names}})


def classify_with_rule_table(df: DataFrame, rules: DataFrame, msg: str = "message", default=None) -> DataFrame:
    """R1 with a user rule table ``(priority int, keyword string, pattern,
    root_cause, fix_suggestion, confidence)`` of any size; lower priority
    wins, ties by pattern.  Rules with a NULL keyword fit nothing.

    The rules, numbered in their order, are cut into parts of ``PART``
    characters of keywords, and the different lower-cased messages into slots
    of about ``SLOT``; a slot meets a part in one task, which builds an automaton
    of the part's keywords and runs it over the messages.  The least number
    of a message is an aggregate.  A message on a third of all rows is one row
    there, and is sent to the rows when they get their rules (``join_hot``).
    """
    from ..session import ship_package
    from .components import global_row_number
    from .joins import join_hot
    from .tables import Written

    spark = df.sparkSession
    ship_package(spark)
    default = fixed.DEFAULT_RULE if default is None else default
    low = F.lower(F.coalesce(F.col(msg), F.lit("")))
    keys = {"_k1": F.xxhash64(low), "_k2": F.xxhash64(F.lit(1), low)}
    r = rules.where(F.col("keyword").isNotNull()).select(
        F.lower("keyword").alias("_kw"),
        F.struct(F.col("priority").cast("int").alias("priority"), F.concat(F.lit(fixed.HEURISTIC_PREFIX), F.col("pattern")).alias("error_pattern"), "root_cause",
                 "fix_suggestion", F.col("confidence").cast("double").alias("confidence_score")).alias("_rule"))
    numbered = Written(global_row_number(r, ["_rule", "_kw"], "_no"), "rules").df
    texts = Written(df.select(low.alias("_text")).groupBy("_text").agg(F.count(F.lit(1)).alias("_n")).withColumns(
        {"_k1": F.xxhash64("_text"), "_k2": F.xxhash64(F.lit(1), "_text")}), "messages").df
    chars = numbered.agg(F.sum(F.length("_kw"))).first()[0] or 0
    n_texts, rows = texts.agg(F.count(F.lit(1)), F.sum("_n")).first()
    parts, slots = max(1, -(-chars // PART)), max(1, -(-n_texts // SLOT))
    # Equal keywords are in one part.
    p = numbered.withColumn("_part", F.pmod(F.xxhash64("_kw"), F.lit(parts))).withColumn("_slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long"))))
    t = texts.withColumn("_slot", F.pmod("_k1", F.lit(slots).cast("long"))).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    met = t.groupBy("_slot", "_part").cogroup(p.groupBy("_slot", "_part")).applyInArrow(
        _matched, f"_k1 bigint, _k2 bigint, _n bigint, _no bigint, _rule {_RULE}")
    best = met.groupBy("_k1", "_k2", "_n").agg(F.min(F.struct("_no", "_rule"))["_rule"].alias("_rule"))
    keyed = df.withColumns(keys)
    j = join_hot(keyed, best, ["_k1", "_k2"], F.col("_n"), rows or 0)
    d = {"error_pattern": F.lit(fixed.HEURISTIC_PREFIX + default[0]), "root_cause": F.lit(default[1]),
         "fix_suggestion": F.lit(default[2]), "confidence_score": F.lit(float(default[3]))}
    return j.select(*df.columns, *[F.when(F.col("_rule").isNotNull(), F.col("_rule")[k]).otherwise(v).alias(k) for k, v in d.items()])


def empty_cluster_result() -> dict[str, Column]:
    """The result of a cluster with no entries."""
    eid, pat, cause, fix, conf = fixed.EMPTY_CLUSTER
    return {
        "rep_id": F.lit(eid),
        "error_pattern": F.lit(fixed.HEURISTIC_PREFIX + pat),
        "root_cause": F.lit(cause),
        "fix_suggestion": F.lit(fix),
        "confidence_score": F.lit(float(conf)),
    }


def rules_table(spark) -> DataFrame:
    """The built-in rules as a rule table (one row per keyword)."""
    rows = []
    for prio, (kws, pat, cause, fix, conf) in enumerate(fixed.RULES):
        rows += [(prio, k, pat, cause, fix, float(conf)) for k in kws]
    return spark.createDataFrame(
        rows, "priority int, keyword string, pattern string, root_cause string, "
              "fix_suggestion string, confidence double")
