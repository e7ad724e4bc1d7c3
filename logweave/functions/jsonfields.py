"""JSON text helpers as column expressions.

The values are found by regular-expression scans over the raw text, at any
depth, exactly like a lightweight hand-written scanner would; they are not a
JSON parser.  All built-in expressions (no UDF).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fixed
from .text import col_of, iso_local, java_trim, json_escape_full, quote_regex, unescape_object_value, unescape_string_field


def _unquote(t: Column) -> Column:
    wrapped = (F.length(t) >= 2) & t.startswith('"') & t.endswith('"')
    return F.when(wrapped, t.substr(F.lit(2), F.length(t) - 2)).otherwise(t)


def _scanned(c: Column) -> Column:
    """The groups ``(k, q, r)`` of every match of the pair pattern, by one
    run of it: matches are rewritten with marks around their groups, which
    splits take apart.  A text that holds a mark itself is scanned group
    by group."""
    pat = F.lit(fixed.JSON_KV)
    marked = F.regexp_replace(c, pat, F.lit("\x01$1\x02$2\x02$3\x03"))
    parts = F.split(marked, "\x01")
    once = F.transform(F.slice(parts, 2, 1 << 30), lambda x: F.split(F.substring_index(x, "\x03", 1), "\x02"))
    once = F.transform(once, lambda g: F.struct(g[0].alias("k"), g[1].alias("q"), g[2].alias("r")))
    thrice = F.arrays_zip(
        F.regexp_extract_all(c, pat, 1).alias("k"),
        F.regexp_extract_all(c, pat, 2).alias("q"),
        F.regexp_extract_all(c, pat, 3).alias("r"),
    )
    return F.when(c.rlike("[\x01-\x03]"), thrice).otherwise(F.when(c.isNotNull(), once))


def json_pairs(c) -> Column:
    """J1 as a column: ``array<struct<k string, v string>>`` in scan order.

    Quoted values are trimmed and unescape ``\\"``, ``\\\\``, ``\\n``; bare
    tokens are trimmed; the text ``null`` (quoted or not) becomes NULL.
    Spark returns ``''`` for a group that did not take part in a match, and
    a bare token is never empty, so "quoted" is ``bare == ''``.
    """
    zipped = _scanned(col_of(c))

    # Three passes so each regex-based trim runs once per value (lambda
    # bodies are evaluated without common-subexpression elimination).
    trimmed = F.transform(zipped, lambda x: F.struct(
        x["k"].alias("k"), (x["r"] == "").alias("quoted"),
        java_trim(F.when(x["r"] == "", x["q"]).otherwise(x["r"])).alias("t")))
    valued = F.transform(trimmed, lambda x: F.struct(
        x["k"].alias("k"),
        F.when(x["quoted"], unescape_object_value(x["t"])).otherwise(_unquote(x["t"])).alias("v")))
    return F.transform(valued, lambda x: F.struct(
        x["k"].alias("k"), F.when(x["v"] == "null", F.lit(None)).otherwise(x["v"]).alias("v")))


def json_aliased(c, spec: dict) -> Column:
    """Several aliased lookups in one pass over the scanned pairs.

    ``spec`` maps an output name to ``(keys, default)``: the first key of
    ``keys`` that is *present* gives the value (its last occurrence, even a
    NULL one), else ``default``.  One ``aggregate`` fold keeps, per wanted
    key, "seen" and "last value"; the finish step applies the aliases.
    """
    wanted = []
    for keys, _ in spec.values():
        wanted += [k for k in keys if k not in wanted]
    init = F.struct(
        *[F.lit(False).alias(f"p{i}") for i in range(len(wanted))],
        *[F.lit(None).cast("string").alias(f"v{i}") for i in range(len(wanted))],
    )

    def merge(acc, x):
        hit = [x["k"] == k for k in wanted]
        return F.struct(
            *[F.when(h, F.lit(True)).otherwise(acc[f"p{i}"]).alias(f"p{i}") for i, h in enumerate(hit)],
            *[F.when(h, x["v"]).otherwise(acc[f"v{i}"]).alias(f"v{i}") for i, h in enumerate(hit)],
        )

    def finish(acc):
        outs = []
        for name, (keys, default) in spec.items():
            v = F.lit(default).cast("string")
            for k in reversed(keys):
                i = wanted.index(k)
                v = F.when(acc[f"p{i}"], acc[f"v{i}"]).otherwise(v)
            outs.append(v.alias(name))
        return F.struct(*outs)

    return F.aggregate(json_pairs(c), init, merge, finish)


def _field_pattern(template: str, field: str) -> str:
    return template.replace("{field}", quote_regex(field))


def json_string(c, field: str) -> Column:
    """First ``"field": "..."`` anywhere in the text, unescaped; NULL if
    there is none."""
    c = col_of(c)
    pat = _field_pattern(fixed.JSON_STRING_FIELD, field)
    return unescape_string_field(F.try_element_at(F.regexp_extract_all(c, F.lit(pat), 1), F.lit(1)))


def json_number_text(c, field: str) -> Column:
    """First ``"field": number`` as its text; NULL if there is none."""
    pat = _field_pattern(fixed.JSON_NUMBER_FIELD, field)
    return F.nullif(F.regexp_extract(col_of(c), pat, 1), F.lit(""))


def json_string_array(c, field: str) -> Column:
    """Quoted elements of the first ``"field": [...]`` (up to the first
    ``]``), unescaping ``\\"`` and ``\\\\``; an empty array when missing."""
    c = col_of(c)
    pat = _field_pattern(fixed.JSON_ARRAY_FIELD, field)
    inner = F.coalesce(F.try_element_at(F.regexp_extract_all(c, F.lit(pat), 1), F.lit(1)), F.lit(""))
    items = F.regexp_extract_all(inner, F.lit(fixed.JSON_QUOTED), 1)
    return F.transform(
        items, lambda s: F.replace(F.replace(s, F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))
    )


def _quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), json_escape_full(c), F.lit('"'))


def value_to_json(c: Column, t: T.DataType) -> Column:
    """A value of type ``t`` as JSON text: strings escaped (\\\\ \\" \\n \\r
    \\t), numbers and booleans as text, NULL as ``null`` at any depth, arrays,
    structs and maps member by member; timestamps as LocalDateTime.toString()
    writes them, dates in ISO form, binary in base 64."""
    if isinstance(t, (T.NumericType, T.BooleanType)):
        out = c.cast("string")
    elif isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        out = F.concat(F.lit('"'), iso_local(c), F.lit('"'))
    elif isinstance(t, T.BinaryType):
        out = F.concat(F.lit('"'), F.base64(c), F.lit('"'))
    elif isinstance(t, T.ArrayType):
        out = F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: value_to_json(x, t.elementType)), ","), F.lit("]"))
    elif isinstance(t, T.MapType):
        pair = lambda e: F.concat(_quoted(e["key"].cast("string")), F.lit(":"), value_to_json(e["value"], t.valueType))
        out = F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries(c), pair), ","), F.lit("}"))
    elif isinstance(t, T.StructType):
        out = F.when(c.isNotNull(), _object([(f.name, c[f.name], f.dataType) for f in t.fields]))
    else:
        out = _quoted(c.cast("string"))
    return F.coalesce(out, F.lit("null"))


def _object(fields: list) -> Column:
    parts = [F.concat(F.lit('"' + name.replace("\\", "\\\\").replace('"', '\\"') + '":'), value_to_json(c, t)) for name, c, t in fields]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def rows_to_json(df) -> Column:
    """Each row as one JSON object text, keys in column order."""
    return _object([(f.name, df[f.name], f.dataType) for f in df.schema.fields])
