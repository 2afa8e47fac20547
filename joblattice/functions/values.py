"""Truthiness, defaults, trimming and parsing with JavaScript's rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as JavaScript's trim sees it (Spark's trim drops U+0020 only).
_JS_SPACE = r"[\s\p{Z}\x{FEFF}]"


def js_trim(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{_JS_SPACE}+|{_JS_SPACE}+$", "")


def lenient_int(text: Column) -> Column:
    """Leading integer of a text, 0 when there is none.

    Text is read as decimal digits only (no "0x" form); digits that do not fit
    a BIGINT give 0.
    """
    digits = F.regexp_extract(text, rf"^{_JS_SPACE}*([+-]?[0-9]+)", 1)
    return F.coalesce(digits.try_cast("bigint"), F.lit(0).cast("bigint"))


def zero_as_blank(number: Column) -> Column:
    return F.coalesce(F.nullif(number, F.lit(0).cast("bigint")).cast("string"), F.lit(""))


def utc_stamp(ts: Column) -> Column:
    """ISO-8601 text with milliseconds and Z; the session runs in UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def int_fits(text: Column) -> Column:
    """False where ``lenient_int`` gives 0 for digits that do not fit a BIGINT."""
    digits = F.regexp_extract(text, rf"^{_JS_SPACE}*([+-]?[0-9]+)", 1)
    return F.coalesce((digits == "") | digits.try_cast("bigint").isNotNull(), F.lit(True))


def generated_user_id(ts: Column, same_time: Column | None = None) -> Column:
    """Id for a request without one, from its event time, so a re-run agrees.

    ``same_time``: a number that tells apart requests that share a time, or null.
    """
    parts = [F.unix_millis(ts.cast("timestamp")).cast("string")]
    if same_time is not None:
        parts.append(F.lower(F.hex(same_time)))
    return F.concat(F.lit("user_"), F.concat_ws("_", *parts))


def _without_mark(body: Column) -> Column:
    mark = F.lit("\ufeff")
    return F.when(F.startswith(body, mark), F.substring(body, 2, 2**31 - 1)).otherwise(body)


def strict_json(body: Column) -> Column:
    """VARIANT of a text that is one JSON value and nothing else; null otherwise.

    The parser stops after the first value and takes no notice of what follows. The text
    is therefore parsed as first of two elements of an array, the other its own hash: text
    behind the value moves the hash, closes the array before it or is no JSON.
    A leading U+FEFF is stripped, as a web server's JSON reader does.
    """
    text = _without_mark(body)
    mark = F.xxhash64(text).cast("string")
    return F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"'), mark, F.lit('"]')))


def strict_json_value(parsed: Column, body: Column) -> Column:
    """The value that ``strict_json`` has parsed, if it stood alone."""
    text = _without_mark(body)
    alone = (F.try_variant_get(parsed, "$[1]", "string") == F.xxhash64(text).cast("string")) & F.try_variant_get(
        parsed, "$[2]", "variant"
    ).isNull()
    return F.when(alone, F.try_variant_get(parsed, "$[0]", "variant"))


# --- JSON values held as VARIANT ---------------------------------------------

# JSON text of the values that count as false. Going by the JSON text keeps the
# types apart: number 0 is false, the string "0" is not.
_FALSY_JSON = r'^(null|false|""|-?0(\.0*)?([eE][+-]?[0-9]+)?)$'


def member(value: Column, path: str) -> Column:
    """Sub-value at a path, SQL null when it is absent or not reachable."""
    return F.try_variant_get(value, path, "variant")


def json_text(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def json_truthy(value: Column) -> Column:
    """Truth of a JSON value: absent, null, false, 0 and "" are false.

    Arrays and objects are true, empty ones too.
    """
    text = F.to_json(value)
    # Most values are told by comparing; the pattern is for numbers that start with 0.
    falsy = text.isin("null", "false", '""', "0") | (F.ltrim(text, F.lit("-")).startswith("0") & text.rlike(_FALSY_JSON))
    return F.coalesce(~falsy, F.lit(False))


def json_is_array(value: Column) -> Column:
    return F.coalesce(F.to_json(value).startswith("["), F.lit(False))


def json_or(value: Column, default: Column) -> Column:
    """``value || default`` on VARIANT; the value keeps its own JSON type."""
    return F.when(json_truthy(value), value).otherwise(default.cast("variant"))


def json_text_or(value: Column, default: Column | str) -> Column:
    """``value || default`` read as text."""
    fallback = default if isinstance(default, Column) else F.lit(default)
    return F.when(json_truthy(value), json_text(value)).otherwise(fallback)


def json_list(value: Column) -> Column:
    """Array of texts from an array, or from a single value; falsy gives []."""
    one = F.when(json_truthy(value), F.array(json_text(value)))
    many = F.when(json_is_array(value), F.try_variant_get(value, "$", "array<string>"))
    return F.coalesce(many, one, F.array().cast("array<string>"))
