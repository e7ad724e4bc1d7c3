"""Prompt, request and reply tables.

Calls to a language-model service are not made here: requests are written
as a table (one row per cluster) and replies come back as a table
``(cluster_no, response)``; a missing reply row is a failed call and falls
back to the keyword rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.jsonfields import json_aliased
from ..functions.text import col_of, is_blank, java_trim, json_escape_full, once, unescape_reply_text


def sample_lines(assigned: DataFrame, k: int = fixed.MAX_LINES_PER_CLUSTER,
                 order=("source", "line_no")) -> DataFrame:
    """The first ``k`` raw lines of each cluster, numbered 1..k, from
    entries that carry their ``cluster_no`` (``Clustering.assigned``, or
    members joined to entries).

    ``row_number() <= k`` over a cluster window: Catalyst plans a partial
    ``WindowGroupLimit`` before the shuffle, so a cluster holding a third
    of all rows ships at most ``k`` rows per task.
    """
    m = assigned.select("cluster_no", *order, "raw_line")
    w = Window.partitionBy("cluster_no").orderBy(*order)
    return m.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k).select(
        "cluster_no", F.col("n").cast("long").alias("n"), *order, "raw_line"
    )


def build_prompts(sample: DataFrame, clusters: DataFrame, k: int = fixed.MAX_LINES_PER_CLUSTER) -> DataFrame:
    """One prompt per cluster from its (at most ``k``) sampled lines and
    its size.  The collected list is bounded by ``k``."""
    lines = sample.groupBy("cluster_no").agg(
        F.array_sort(F.collect_list(F.struct("n", "raw_line"))).alias("_l")
    )
    body = F.array_join(
        F.transform("_l", lambda x: F.format_string("[%d] %s\n", x["n"], x["raw_line"])), ""
    )
    more = F.when(
        F.col("size") > k, F.format_string(fixed.PROMPT_MORE.replace("{n}", "%d"), F.col("size") - k)
    ).otherwise(F.lit(""))
    return clusters.select("cluster_no", "size").join(lines, "cluster_no").select(
        "cluster_no", F.concat(F.lit(fixed.PROMPT_HEADER), body, more, F.lit(fixed.PROMPT_FOOTER)).alias("prompt")
    )


def build_requests(prompts: DataFrame, model: str = fixed.DEFAULT_MODEL,
                   max_tokens: int = fixed.MAX_TOKENS) -> DataFrame:
    """Request bodies ``{"model","max_tokens","messages":[{"role","content"}]}``
    written with the hand-made escaping of the original client."""
    head = '{"model":"' + model.replace("\\", "\\\\").replace('"', '\\"') + f'","max_tokens":{int(max_tokens)},'
    return prompts.select(
        "cluster_no",
        F.concat(
            F.lit(head + '"messages":[{"role":"user","content":"'),
            json_escape_full("prompt"),
            F.lit('"}]}'),
        ).alias("request"),
    )


TEXT_BLOCK = r'"text"\s*:\s*"([^\\"]*+(?:\\.[^\\"]*+)*+)"'


def reply_text(c) -> Column:
    """First ``"text": "..."`` block of a reply body, unescaped; NULL
    when the body is NULL or has none."""
    got = F.try_element_at(F.regexp_extract_all(col_of(c), F.lit(TEXT_BLOCK), 1), F.lit(1))
    return unescape_reply_text(got)


_REPLY_SPEC = {
    "errorPattern": (("errorPattern",), fixed.REPLY_DEFAULTS["errorPattern"]),
    "rootCause": (("rootCause",), fixed.REPLY_DEFAULTS["rootCause"]),
    "fixSuggestion": (("fixSuggestion",), fixed.REPLY_DEFAULTS["fixSuggestion"]),
    "confidenceScore": (("confidenceScore",), str(fixed.REPLY_DEFAULTS["confidenceScore"])),
}


def parse_reply(text: str | Column) -> Column:
    """Reply text -> struct(error_pattern, root_cause, fix_suggestion,
    confidence_score).

    Code fences are removed, the block from the first ``{`` to the last
    ``}`` is scanned for the four keys (absent -> default, present JSON
    null -> NULL), the confidence defaults to 1.0 when missing or not a
    number and is clamped to [0, 1] (NaN stays NaN, as Math.min/max do).
    Blank text -> "Empty reply"; no braces -> "Malformed LLM response" with
    the reply as root cause; both carry the heuristic prefix and 0.0.
    """
    pre = fixed.HEURISTIC_PREFIX
    er, mr = fixed.EMPTY_REPLY, fixed.MALFORMED_REPLY
    empty = F.struct(F.lit(pre + er[0]).alias("error_pattern"), F.lit(er[1]).alias("root_cause"),
                     F.lit(er[2]).alias("fix_suggestion"), F.lit(float(er[3])).alias("confidence_score"))

    # Every step is named several times by the next one and worked out once.
    def clamped(conf):
        return F.when(F.isnan(conf), conf).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), conf)))

    def good(f):
        conf = F.coalesce(java_trim(f["confidenceScore"]).try_cast("double"), F.lit(1.0))
        return F.struct(f["errorPattern"].alias("error_pattern"), f["rootCause"].alias("root_cause"),
                        f["fixSuggestion"].alias("fix_suggestion"), once(conf, clamped).alias("confidence_score"))

    def block(t, cleaned):
        start = F.instr(cleaned, "{")
        rpos = F.instr(F.reverse(cleaned), "}")
        end = F.length(cleaned) - rpos + 1
        ok = (start > 0) & (rpos > 0) & (end >= start)
        malformed = F.struct(F.lit(pre + mr[0]).alias("error_pattern"), t.alias("root_cause"),
                             F.lit(mr[1]).alias("fix_suggestion"), F.lit(float(mr[2])).alias("confidence_score"))
        found = once(cleaned.substr(start, end - start + 1), lambda b: once(json_aliased(b, _REPLY_SPEC), good))
        return F.when(~ok, malformed).otherwise(found)

    def parsed(t):
        cleaned = java_trim(F.replace(F.replace(t, F.lit(fixed.CODE_FENCES[0]), F.lit("")), F.lit(fixed.CODE_FENCES[1]), F.lit("")))
        return once(cleaned, lambda c: block(t, c))

    return F.when(is_blank(text), empty).otherwise(once(col_of(text), parsed))


def replies_from_conversations(conversations: DataFrame) -> DataFrame:
    """Reply bodies shaped like a messages-API response, one for each
    assistant turn, keyed ``cluster_no`` by the turn's order ``(conv_id,
    turn)`` from 1.  Used to exercise R7-R9 on the given tables.

    The texts are turned into every form of reply that the parser tells
    apart, by the turn's number: clean, fenced and embedded JSON, confidences
    above 1, below 0, not a number, null and missing, repeated keys, blank
    and brace-free texts (see ``REPLY_FORMS``)."""
    from .components import global_row_number

    said = conversations.where(F.col("role") == "assistant").select("conv_id", "turn", "text", F.xxhash64("text").alias("_h"))
    n = global_row_number(said, ["conv_id", "turn", "_h"], "cluster_no")
    return n.select("cluster_no", reply_body(reply_form("cluster_no", "text")).alias("response"))


def reply_body(text) -> Column:
    """A messages-API response around a reply text."""
    return F.concat(F.lit('{"content":[{"type":"text","text":"'), json_escape_full(text), F.lit('"}],"role":"assistant"}'))


#: Reply texts around ``{t}``, a JSON string's content.
REPLY_FORMS = (
    '{"errorPattern":"{t}","rootCause":"cause of {t}","fixSuggestion":"fix","confidenceScore":0.75}',
    '```json\n{"errorPattern": "{t}", "rootCause": "c", "fixSuggestion": "f", "confidenceScore": 1.5}\n```',
    'Here is what I found:\n{"errorPattern":"{t}","rootCause":"c","confidenceScore":-0.25} Regards',
    '{"errorPattern":null,"rootCause":"{t}","fixSuggestion":"f","confidenceScore":"high"}',
    '{"errorPattern":"first","errorPattern":"{t}","rootCause":"c","fixSuggestion":"a","fixSuggestion":"b","confidenceScore":0.1,"confidenceScore":0.9}',
    '{"confidenceScore":null,"rootCause":"{t}"}',
    '  \n ',
    'no braces: {t}',
    '} {t} {',
    '```{"errorPattern":"{t}","confidenceScore": NaN }```',
)


def reply_form(no, text) -> Column:
    """The form of ``REPLY_FORMS`` for a row's number, with its whole text in
    place of ``{t}``; characters that would end a JSON string become blanks."""
    t = F.regexp_replace(col_of(text), r'[\x00-\x1F"\\{}`]', " ")
    forms = F.array(*[F.lit(f) for f in REPLY_FORMS])
    form = F.element_at(forms, (F.pmod(col_of(no), F.lit(len(REPLY_FORMS))) + 1).cast("int"))
    return F.replace(form, F.lit("{t}"), t)
