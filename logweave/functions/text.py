"""Column expressions with Java string semantics.

All of these are built-in Spark expressions (JVM side, whole-stage codegen);
no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

# The characters of Character.isWhitespace, and those up to U+0020.
WHITE = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x1680, *range(0x2000, 0x2007),
                          *range(0x2008, 0x200B), 0x2028, 0x2029, 0x205F, 0x3000]))
CONTROL = "".join(map(chr, range(0x21)))


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def once(value: Column, use) -> Column:
    """``use(value)``, with ``value`` worked out once a row however often
    ``use`` names it.  Spark shares no common parts inside branches and lambda
    bodies: a value named there is worked out anew every time."""
    return F.element_at(F.transform(F.array(value), use), 1)


def java_strip(c) -> Column:
    """String.strip(): remove leading/trailing Unicode whitespace."""
    return F.btrim(col_of(c), F.lit(WHITE))


def java_trim(c) -> Column:
    """String.trim(): remove leading/trailing characters <= U+0020."""
    return F.btrim(col_of(c), F.lit(CONTROL))


def is_blank(c) -> Column:
    """Null, empty, or whitespace only (String.isBlank())."""
    return F.coalesce(java_strip(c), F.lit("")) == ""


def iso_local(c) -> Column:
    """A timestamp as LocalDateTime.toString() writes it: ``T`` between date
    and time, seconds and fraction only as far as they are not zero, the
    fraction in thousandths or millionths."""
    c = col_of(c)
    micros = F.date_format(c, "SSSSSS")
    text = F.concat(F.date_format(c, "yyyy-MM-dd"), F.lit("T"), F.date_format(c, "HH:mm"))
    some = (F.second(c) != 0) | (micros != "000000")
    short = micros.endswith("000")
    fraction = F.when(micros == "000000", "").when(short, F.concat(F.lit("."), F.substring(micros, 1, 3))).otherwise(F.concat(F.lit("."), micros))
    return F.concat(text, F.when(some, F.concat(F.date_format(c, ":ss"), fraction)).otherwise(""))


def unescape_object_value(c) -> Column:
    """Unescape used for quoted values of a scanned JSON object: \\" \\\\ \\n."""
    c = col_of(c)
    c = F.replace(c, F.lit('\\"'), F.lit('"'))
    c = F.replace(c, F.lit("\\\\"), F.lit("\\"))
    return F.replace(c, F.lit("\\n"), F.lit("\n"))


def unescape_string_field(c) -> Column:
    """Unescape used for single string fields: \\" \\\\ \\n \\r \\t."""
    c = unescape_object_value(c)
    c = F.replace(c, F.lit("\\r"), F.lit("\r"))
    return F.replace(c, F.lit("\\t"), F.lit("\t"))


def unescape_reply_text(c) -> Column:
    """Unescape used for a reply's text block: \\" \\\\ \\n \\t \\r."""
    c = unescape_object_value(c)
    c = F.replace(c, F.lit("\\t"), F.lit("\t"))
    return F.replace(c, F.lit("\\r"), F.lit("\r"))


def json_escape(c) -> Column:
    """Escape for hand-written JSON text: backslash, quote, \\n, \\r."""
    c = col_of(c)
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    c = F.replace(c, F.lit('"'), F.lit('\\"'))
    c = F.replace(c, F.lit("\n"), F.lit("\\n"))
    return F.replace(c, F.lit("\r"), F.lit("\\r"))


def json_escape_full(c) -> Column:
    """Escape for request bodies: backslash, quote, \\n, \\r, \\t."""
    return F.replace(json_escape(c), F.lit("\t"), F.lit("\\t"))


def message_template(c) -> Column:
    """Lower-case, hex -> <HEX>, digit runs -> <NUM>, anything outside
    ``[a-z<>]`` -> one space, trimmed.  Null stays null."""
    t = F.lower(col_of(c))
    t = F.regexp_replace(t, fixed.HEX_RUN, fixed.HEX_TOKEN)
    t = F.regexp_replace(t, fixed.DIGIT_RUN, fixed.NUM_TOKEN)
    t = F.regexp_replace(t, fixed.NON_TEMPLATE_CHARS, " ")
    return F.trim(t)


def quote_regex(field: str) -> str:
    """Pattern.quote for a field name placed into a pattern."""
    return r"\Q" + field.replace(r"\E", r"\E\\E\Q") + r"\E"
