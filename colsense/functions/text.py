"""Text expressions: csv/json rendering, strict JSON list parsing, whitespace, tokens.

All are native Spark expressions (higher-order functions over arrays, regex),
so they stay in the JVM and need no Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colsense.constants import TOKEN_PATTERN

_NOT_SIMPLE = r"[^\x20-\x7e\n\r\t]"


# FIXED VALUES: the characters ``str.strip()`` removes (``str.isspace()``), in code-point order
PY_WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
                 "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
                 "\u2028\u2029\u202f\u205f\u3000")


def strip_ws(c: Column) -> Column:
    """Remove leading and trailing whitespace exactly like ``str.strip()``."""
    return F.btrim(c, F.lit(PY_WHITESPACE))


def csv_field(c: Column, sep: str = ",", na: str = "") -> Column:
    """One csv field with minimal quoting: quote when it holds sep, quote, CR or LF."""
    needs = F.instr(c, sep) > 0
    needs = needs | (F.instr(c, '"') > 0) | (F.instr(c, "\n") > 0) | (F.instr(c, "\r") > 0)
    quoted = F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(c.isNull(), F.lit(na)).when(needs, quoted).otherwise(c)


def _u_escape(cp: Column) -> Column:
    return F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(cp)), 4, "0"))


def _escape_char(ch: Column) -> Column:
    cp = F.ascii(ch)
    astral = cp - 0x10000
    return (F.when(ch == '"', F.lit('\\"'))
             .when(ch == "\\", F.lit("\\\\"))
             .when(ch == "\n", F.lit("\\n"))
             .when(ch == "\r", F.lit("\\r"))
             .when(ch == "\t", F.lit("\\t"))
             .when(ch == "\b", F.lit("\\b"))
             .when(ch == "\f", F.lit("\\f"))
             .when(cp > 0xFFFF, F.concat(_u_escape(F.lit(0xD800) + F.shiftright(astral, 10)),
                                         _u_escape(F.lit(0xDC00) + astral % 1024)))
             .when((cp < 0x20) | (cp > 0x7E), _u_escape(cp))
             .otherwise(ch))


def json_string(c: Column) -> Column:
    """JSON string literal with ASCII-only output (``json.dumps`` default).

    Printable text, tabs and line breaks take the cheap path (a few replaces);
    only strings with other control or non-ASCII characters are split into code
    points.
    """
    simple = c
    for char, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        simple = F.replace(simple, F.lit(char), F.lit(escaped))
    simple = F.concat(F.lit('"'), simple, F.lit('"'))
    full = F.concat(F.lit('"'), F.array_join(F.transform(F.split(c, ""), _escape_char), ""), F.lit('"'))
    return (F.when(c.isNull(), F.lit("null"))
             .when(c.rlike(_NOT_SIMPLE), full)
             .otherwise(simple))


def json_list(arr: Column) -> Column:
    """JSON text of a string list with ``", "`` between items (``json.dumps`` layout)."""
    return F.concat(F.lit("["), F.array_join(F.transform(arr, json_string), ", "), F.lit("]"))


_JSON_WS = " \t\n\r"


def _valid_strict(s: Column) -> Column:
    """Strict JSON document test: the parser alone accepts trailing text, so the
    candidate must also parse as the value of an object and as the item of an
    array; what can follow a value in one of them is an error in the other.
    Texts that can't start and end like a JSON value aren't parsed."""
    bare = F.btrim(s, F.lit(_JSON_WS))
    likely = F.when(bare.startswith("["), bare.endswith("]")).when(bare.startswith("{"), bare.endswith("}")) \
              .when(bare.startswith('"'), bare.endswith('"')).otherwise(bare.rlike("^[-0-9tfn]"))
    obj = F.try_parse_json(F.concat(F.lit('{"v":'), s, F.lit("}")))
    wrap = F.try_parse_json(F.concat(F.lit("["), s, F.lit("]")))
    return F.coalesce(likely & obj.isNotNull() & wrap.isNotNull(), F.lit(False))


def with_strict_json_array(df: DataFrame, src: str, out: str, strip: bool = True) -> DataFrame:
    """Adds a predicted label list parsed with the published repair rules.

    Candidates ``s``, ``s + '"]'``, ``s + ']'``, ``s + '""]'``; the first valid
    JSON document wins (materialised once, then parsed once); when it is not an
    array the result is null.  Items are rendered like ``str()``: booleans
    ``True``/``False``, null ``None``, others as their JSON text; then optionally
    stripped.  Kinds of items are looked at only where the text has one of the
    three literals in it.
    """
    s = F.col(src)
    cands = [s, F.concat(s, F.lit('"]')), F.concat(s, F.lit("]")), F.concat(s, F.lit('""]'))]
    chosen = F.lit(None).cast("string")
    for cand in reversed(cands):
        chosen = F.when(_valid_strict(cand), cand).otherwise(chosen)
    staged = df.withColumn("__chosen", chosen)
    is_list = F.btrim(F.col("__chosen"), F.lit(_JSON_WS)).startswith("[")
    staged = staged.withColumn("__texts", F.when(is_list, F.from_json(F.col("__chosen"), "array<string>")))
    items = F.try_variant_get(F.try_parse_json("__chosen"), "$", "array<variant>")
    kinds = F.transform(items, lambda x: F.schema_of_variant(x))
    rendered = F.transform(
        F.arrays_zip(F.col("__texts").alias("t"), kinds.alias("k")),
        lambda z: (F.when(z["k"] == "BOOLEAN", F.when(z["t"] == "true", F.lit("True")).otherwise(F.lit("False")))
                    .when(z["k"] == "VOID", F.lit("None"))
                    .otherwise(z["t"])))
    rendered = F.when(F.col("__chosen").rlike("true|false|null"), rendered).otherwise(F.col("__texts"))
    if strip:
        rendered = F.transform(rendered, strip_ws)
    return staged.withColumn(out, rendered).drop("__chosen", "__texts")


def token_count(s: Column) -> Column:
    """Number of word / symbol pieces (engine-independent token estimate)."""
    return F.coalesce(F.size(F.regexp_extract_all(s, F.lit(TOKEN_PATTERN), 0)), F.lit(0))
