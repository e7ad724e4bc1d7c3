"""DuckDB SQL texts used as the independent check of every query.

These are test oracles: plain SQL over the same parquet tables, written
from the semantics (not from the Spark code).  RE2 has no Java classes, so
the Java meanings are spelled out: ``JWS`` = Character.isWhitespace,
``JS`` = Java ``\\s``, ``JDOT`` = Java ``.`` (no line terminators).
"""

from __future__ import annotations

from ..sources.logs import log_lines_exprs

JWS = r"[\t\n\x0B\f\r\x1C-\x1F \x{1680}\x{2000}-\x{2006}\x{2008}-\x{200A}\x{2028}\x{2029}\x{205F}\x{3000}]"
JS = r"[ \t\n\x0B\f\r]"
JDOT = r"[^\n\r\x{85}\x{2028}\x{2029}]"
CTL = r"[\x00-\x20]"

P1 = (
    r"^(\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(?:\.\d+)?)" + JS + r"+([A-Z]+)" + JS
    + r"+([a-zA-Z0-9_-]+)" + JS + r"+-" + JS + r"+(" + JDOT + r"*)$"
)
P2 = r"^(\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(?:\.\d+)?)" + JS + r"+([A-Z]+)" + JS + r"+(" + JDOT + r"*)$"
QSTR = r'(?:[^\\"]|\\' + JDOT + r")*"
KV = r'"([a-zA-Z0-9_-]+)"' + JS + r"*:" + JS + r'*(?:"(' + QSTR + r')"|([^,}' + r"\t\n\x0B\f\r " + r"]+))"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def jtrim(x: str) -> str:
    return f"regexp_replace({x}, {q('^' + CTL + '+|' + CTL + '+$')}, '', 'g')"


def unesc_obj(x: str) -> str:
    return f"replace(replace(replace({x}, '\\\"', '\"'), '\\\\', '\\'), '\\n', chr(10))"


def unesc_str(x: str) -> str:
    return f"replace(replace({unesc_obj(x)}, '\\r', chr(13)), '\\t', chr(9))"


def unesc_reply(x: str) -> str:
    return f"replace(replace({unesc_obj(x)}, '\\t', chr(9)), '\\r', chr(13))"


def log_lines_cte() -> str:
    first, ts_case, line_case = log_lines_exprs(
        "strftime(ts, '%Y-%m-%d %H:%M:%S')", "printf('%x', event_id)", "VARCHAR"
    )
    return (
        "log_lines AS (SELECT 'events' AS source, event_id AS line_no, "
        f"{line_case} AS raw_line FROM (SELECT *, {ts_case} AS ts_txt FROM "
        f"(SELECT {', '.join(first)} FROM events) b) c)"
    )


def _lookup(keys, default) -> str:
    out = "NULL" if default is None else q(default)
    for k in reversed(keys):
        hit = f"list_filter(kv, lambda p: p.k = {q(k)})"
        out = f"CASE WHEN len({hit}) > 0 THEN {hit}[-1].v ELSE {out} END"
    return out


def parsed_cte(lines_table: str | None = None) -> str:
    """``parsed``: one row per log line with line, branch and raw fields
    (``log_lines`` from ``events``, or from ``lines_table`` when given)."""
    val = (
        f"NULLIF(CASE WHEN rv[i] IS NULL THEN {unesc_obj(jtrim('qv[i]'))} ELSE "
        f"(CASE WHEN length({jtrim('rv[i]')}) >= 2 AND starts_with({jtrim('rv[i]')}, '\"') "
        f"AND ends_with({jtrim('rv[i]')}, '\"') THEN substr({jtrim('rv[i]')}, 2, length({jtrim('rv[i]')}) - 2) "
        f"ELSE {jtrim('rv[i]')} END) END, 'null')"
    )
    src = log_lines_cte() if lines_table is None else f"log_lines AS (SELECT * FROM {lines_table})"
    return f"""{src},
ll AS (
  SELECT source, line_no, raw_line,
         regexp_replace(raw_line, {q('^' + JWS + '+|' + JWS + '+$')}, '', 'g') AS s
  FROM log_lines),
ll2 AS (
  SELECT *, (s IS NULL OR length(s) = 0) AS blank,
         regexp_matches(s, {q(P1)}) AS m1, regexp_matches(s, {q(P2)}) AS m2,
         regexp_extract(s, {q(P1)}, ['ts','lvl','svc','msg']) AS g1,
         regexp_extract(s, {q(P2)}, ['ts','lvl','msg']) AS g2,
         regexp_extract_all(s, {q(KV)}, 1) AS ks,
         regexp_extract_all(s, {q(KV)}, 2) AS qv,
         regexp_extract_all(s, {q(KV)}, 3) AS rv
  FROM ll),
ll3 AS (
  SELECT *, list_transform(range(1, len(ks) + 1), lambda i: {{'k': ks[i], 'v': {val}}}) AS kv
  FROM ll2),
parsed AS (
  SELECT source, line_no, raw_line,
    CASE WHEN NOT blank THEN s END AS line,
    CASE WHEN blank THEN NULL WHEN starts_with(s, '{{') THEN 'json'
         WHEN m1 THEN 'service' WHEN m2 THEN 'noservice' END AS branch,
    CASE WHEN blank THEN NULL WHEN starts_with(s, '{{') THEN {_lookup(('timestamp', 'time'), None)}
         WHEN m1 THEN g1.ts WHEN m2 THEN g2.ts END AS ts_text,
    CASE WHEN blank THEN NULL WHEN starts_with(s, '{{') THEN {_lookup(('level', 'severity'), 'UNKNOWN')}
         WHEN m1 THEN g1.lvl WHEN m2 THEN g2.lvl END AS level_text,
    CASE WHEN blank THEN NULL WHEN starts_with(s, '{{') THEN {_lookup(('service', 'logger'), 'unknown')}
         WHEN m1 THEN {jtrim('g1.svc')} WHEN m2 THEN 'unknown' END AS service,
    CASE WHEN blank THEN NULL WHEN starts_with(s, '{{') THEN {_lookup(('message', 'msg'), None)}
         WHEN m1 THEN {jtrim('g1.msg')} WHEN m2 THEN {jtrim('g2.msg')} END AS message
  FROM ll3)"""


def ts_expr(x: str) -> str:
    """Strict where the calendar allows it; else a day up to 31 is the
    month's last day and 24:00:00 the next day's start."""
    t = f"replace({jtrim(x)}, 'T', ' ')"
    pat = q(r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(\.\d{3})?")
    y, m, d, h = (f"CAST(substr({t}, {a}, {n}) AS INTEGER)" for a, n in ((1, 4), (6, 2), (9, 2), (12, 2)))
    day = f"(make_date({y}, {m}, 1) + CAST(least({d}, day(last_day(make_date({y}, {m}, 1)))) - 1 AS INTEGER))"
    late = f"({h} = 24 AND regexp_full_match(substr({t}, 14), ':00:00([.]0+)?'))"
    lenient = (f"CASE WHEN {m} BETWEEN 1 AND 12 AND {d} BETWEEN 1 AND 31 THEN CASE WHEN {late} THEN CAST({day} + 1 AS TIMESTAMP) "
               f"ELSE TRY_CAST(CAST({day} AS VARCHAR) || ' ' || substr({t}, 12) AS TIMESTAMP) END END")
    return f"CASE WHEN regexp_full_match({t}, {pat}) THEN coalesce(TRY_CAST({t} AS TIMESTAMP), {lenient}) END"


def iso_local(x: str) -> str:
    """A timestamp with T, seconds and fraction as far as they are not zero."""
    f = f"strftime({x}, '%f')"
    return (f"(strftime({x}, '%Y-%m-%dT%H:%M') || CASE WHEN second({x}) = 0 AND {f} = '000000' THEN '' ELSE strftime({x}, ':%S') || "
            f"CASE WHEN {f} = '000000' THEN '' WHEN ends_with({f}, '000') THEN '.' || substr({f}, 1, 3) ELSE '.' || {f} END END)")


def level_expr(x: str) -> str:
    u = f"upper({jtrim(x)})"
    return (
        f"CASE WHEN {u} IN ('TRACE','DEBUG','INFO','WARN','ERROR','FATAL') THEN {u} "
        f"WHEN {u} = 'WARNING' THEN 'WARN' WHEN {u} = 'CRITICAL' THEN 'FATAL' ELSE 'UNKNOWN' END"
    )


def entries_cte(lines_table: str | None = None) -> str:
    """``parsed`` plus ``log_entries``."""
    return f"""{parsed_cte(lines_table)},
log_entries AS (
  SELECT sha256(source || ':' || CAST(line_no AS VARCHAR)) AS id, source, line_no,
         {ts_expr('ts_text')} AS ts, {level_expr('level_text')} AS level,
         service, message, line AS raw_line
  FROM parsed WHERE branch IS NOT NULL)"""


def template_expr(x: str) -> str:
    t = f"lower({x})"
    t = f"regexp_replace({t}, '0x[0-9a-f]+', '<HEX>', 'g')"
    t = f"regexp_replace({t}, '[0-9]+', '<NUM>', 'g')"
    t = f"regexp_replace({t}, '[^a-z<>]+', ' ', 'g')"
    return f"trim({t}, ' ')"


def rule_case(msg: str, rules, default, field: int) -> str:
    """CASE over the ordered keyword rules; field 1 pattern, 2 cause,
    3 fix, 4 confidence (pattern gets the heuristic prefix)."""
    m = f"lower(coalesce({msg}, ''))"
    parts = []
    for kws, *vals in rules:
        cond = " OR ".join(f"contains({m}, {q(k)})" for k in kws)
        v = vals[field - 1]
        parts.append(f"WHEN {cond} THEN {_rule_val(v, field)}")
    return f"CASE {' '.join(parts)} ELSE {_rule_val(default[field - 1], field)} END"


def _rule_val(v, field):
    if field == 4:
        return f"CAST({v!r} AS DOUBLE)"
    if field == 1:
        return q("[Heuristic] " + v)
    return q(v)


def cells_sql(src: str, key: str, tcol: str) -> str:
    """n-gram cells ``(key, k, w)`` of the templates in ``src`` (``tcol``)."""
    return f"""(
  SELECT {key}, (xor(ascii(cs[i]) * 31 + ascii(cs[i + 1]), 17)) % 128 AS k, 1.0 AS w, 'b' AS kind
  FROM (SELECT {key}, cs, unnest(range(1, len(cs))) AS i
        FROM (SELECT {key}, string_split({tcol}, '') AS cs FROM {src} WHERE length({tcol}) > 0))
  UNION ALL
  SELECT {key}, (ascii(cs[i]) * 13) % 128 AS k, 0.5 AS w, 'u' AS kind
  FROM (SELECT {key}, cs, unnest(range(1, len(cs) + 1)) AS i
        FROM (SELECT {key}, string_split({tcol}, '') AS cs FROM {src} WHERE length({tcol}) > 0)))"""


def vectors_sql(src: str, key: str, tcol: str) -> str:
    """Normalised sparse vectors ``(key, k, x FLOAT)``."""
    return f"""(
  SELECT c.{key}, c.k, (c.v / m.mag)::FLOAT AS x
  FROM (SELECT {key}, k, sum(w)::FLOAT AS v FROM {cells_sql(src, key, tcol)} GROUP BY {key}, k) c
  JOIN (SELECT {key}, sqrt(sum((v * v)::DOUBLE)) AS mag
        FROM (SELECT {key}, k, sum(w)::FLOAT AS v FROM {cells_sql(src, key, tcol)} GROUP BY {key}, k)
        GROUP BY {key}) m USING ({key}))"""


def clusters_cte(threshold: float = 0.85) -> str:
    """``log_entries`` ... ``clusters`` and ``members`` (needs WITH RECURSIVE)."""
    return f"""{entries_cte()},
et AS (SELECT *, {template_expr('message')} AS t FROM log_entries),
tpl AS (SELECT t, count(*) AS n, min({{'s': source, 'l': line_no, 'id': id, 'm': message}}) AS first
        FROM et WHERE length(t) > 0 GROUP BY t),
vec AS {vectors_sql('tpl', 't', 't')},
nrm AS (SELECT t, sum((x * x)::DOUBLE) AS ss FROM vec GROUP BY t),
dots AS (SELECT a.t AS ta, b.t AS tb, sum((a.x * b.x)::DOUBLE) AS d
         FROM vec a JOIN vec b ON a.k = b.k AND a.t < b.t GROUP BY 1, 2),
tedges AS (SELECT ta, tb, d / (sqrt(na.ss) * sqrt(nb.ss)) AS cosine
          FROM dots JOIN nrm na ON na.t = ta JOIN nrm nb ON nb.t = tb
          WHERE d / (sqrt(na.ss) * sqrt(nb.ss)) >= {threshold}),
eb AS (SELECT ta AS x, tb AS y FROM tedges UNION ALL SELECT tb, ta FROM tedges),
reach AS (SELECT t AS v, t AS r FROM tpl
          UNION SELECT reach.v, eb.y FROM reach JOIN eb ON reach.r = eb.x),
comp AS (SELECT v AS t, min(r) AS c FROM reach GROUP BY v),
cl0 AS (SELECT comp.c AS c, min(first) AS rep, sum(n)::BIGINT AS size FROM tpl JOIN comp USING (t) GROUP BY comp.c
        UNION ALL
        SELECT NULL, {{'s': source, 'l': line_no, 'id': id, 'm': message}}, 1
        FROM et WHERE t IS NULL OR length(t) = 0),
clusters AS (SELECT c, rep.s AS rep_source, rep.l AS rep_line_no, rep.id AS rep_id, rep.m AS rep_message, size,
                    row_number() OVER (ORDER BY rep.s, rep.l) AS cluster_no FROM cl0),
members AS (SELECT cl.cluster_no, e.id, e.source, e.line_no FROM et e JOIN comp ON comp.t = e.t
            JOIN clusters cl ON cl.c = comp.c
            UNION ALL SELECT cluster_no, rep_id, rep_source, rep_line_no FROM clusters WHERE c IS NULL)"""


def kv_val(qi: str, ri: str) -> str:
    r = jtrim(ri)
    return (
        f"NULLIF(CASE WHEN {ri} IS NULL THEN {unesc_obj(jtrim(qi))} ELSE "
        f"(CASE WHEN length({r}) >= 2 AND starts_with({r}, '\"') AND ends_with({r}, '\"') "
        f"THEN substr({r}, 2, length({r}) - 2) ELSE {r} END) END, 'null')"
    )


def kv_cols(col: str) -> str:
    """Select-list part: ``ks, qv, rv`` scanned from ``col``."""
    return (f"regexp_extract_all({col}, {q(KV)}, 1) AS ks, regexp_extract_all({col}, {q(KV)}, 2) AS qv, "
            f"regexp_extract_all({col}, {q(KV)}, 3) AS rv")


def kv_list() -> str:
    """``list<struct(k, v)>`` from columns ks, qv, rv."""
    return f"list_transform(range(1, len(ks) + 1), lambda i: {{'k': ks[i], 'v': {kv_val('qv[i]', 'rv[i]')}}})"


def lookup(keys, default) -> str:
    return _lookup(keys, default)


def field_pat(kind: str, field: str) -> str:
    if kind == "string":
        return f'"{field}"' + JS + "*:" + JS + '*"(' + QSTR + ')"'
    if kind == "number":
        return f'"{field}"' + JS + "*:" + JS + r"*(-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)"
    if kind == "array":
        return f'"{field}"' + JS + "*:" + JS + r"*\[([^\]]*)\]"
    raise ValueError(kind)


def esc_full(x: str) -> str:
    return (f"replace(replace(replace(replace(replace({x}, '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n'), "
            f"chr(13), '\\r'), chr(9), '\\t')")


def esc(x: str) -> str:
    return f"replace(replace(replace(replace({x}, '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n'), chr(13), '\\r')"


def is_blank(x: str) -> str:
    return f"({x} IS NULL OR regexp_full_match({x}, {q(JWS + '*')}))"
