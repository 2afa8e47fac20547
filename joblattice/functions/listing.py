"""Expressions over the columns of a listing."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from joblattice.functions import fixed_values as fixed


def score_tier(score: Column) -> Column:
    """high, medium or low; NaN is low (Spark would rank it above all numbers)."""
    return (
        F.when(score.isNull() | F.isnan(score), F.lit("low"))
        .when(score >= fixed.SCORE_HIGH, F.lit("high"))
        .when(score >= fixed.SCORE_MEDIUM, F.lit("medium"))
        .otherwise(F.lit("low"))
    )


def initial(company: Column) -> Column:
    return F.substring(company, 1, 1)


def display_line(company: Column, location: Column) -> Column:
    return F.concat_ws(" · ", company, location)


# A word: letters and digits; + and # may end it, and . + # may stand inside it (node.js, c++11)
# or a . before it (.net). All other punctuation parts words.
WORD = r"\.?[\p{L}\p{M}\p{N}]+(?:[.+#]+[\p{L}\p{M}\p{N}]+)*[+#]*"


def words(text: Column) -> Column:
    """Lower-case words of a title or skill, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def phrase(skill: Column) -> Column:
    """A skill as its words joined by one blank, however it was typed."""
    return F.array_join(words(skill), " ")


def runs_of(found: Column, n: Column) -> Column:
    """The distinct runs of ``n`` consecutive words of an array, joined by one blank."""
    starts = F.when(F.size(found) >= n, F.sequence(F.lit(1), F.size(found) - n + 1))
    runs = F.transform(starts, lambda i: F.array_join(F.slice(found, i, n), " "))
    return F.coalesce(F.array_distinct(runs), F.array().cast("array<string>"))


def salary_parts(salary: Column) -> Column:
    """Struct(lo BIGINT, hi BIGINT, currency, period) of a salary text.

    One or two amounts, each with a sign or code of its currency before or behind it or
    none, and a unit k or m in either case; a unit on the last amount alone holds for
    both. "/h", "/hr" or "/hour" make it hourly, "/y", "/yr" or "/year" yearly, which
    is the default. One amount is both ends. Any other text gives nulls, as does an
    amount beyond 15 digits, rather than a number that may be wrong.
    """
    signs = "|".join([*(re.escape(s) for s, _ in fixed.CURRENCY_SIGNS), *(c for c, _ in fixed.CURRENCIES)])
    amount_text = r"([0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?|[0-9]+(?:\.[0-9]+)?)\s*([KM]?)(?![0-9A-Z])"
    one = rf"(?:{signs})?\s*{amount_text}\s*(?:{signs})?"
    form = rf"^\s*{one}(?:\s*(?:-|–|—|TO)\s*{one})?\s*(?:/\s*(H|HR|HOUR|Y|YR|YEAR))?\s*$"
    # One match gives all groups; what does not match stays as it is, without the mark "=".
    text = F.translate(F.upper(salary), "=", "?")
    marked = F.regexp_replace(text, F.lit(form), F.lit("=$1|$2|$3|$4|$5"))
    groups = F.when(F.startswith(marked, F.lit("=")), F.split(F.substring(marked, 2, 2**31 - 1), r"\|", 5))

    def amount(number: Column, unit: Column) -> Column:
        times = F.when(unit == "M", 1_000_000).when(unit == "K", 1_000).otherwise(1)
        return (F.replace(number, F.lit(","), F.lit("")).try_cast("decimal(18,3)") * times).try_cast("bigint")

    # The codes and signs in the text; E£ holds no other sign. Two currencies name none.
    names = {**dict(fixed.CURRENCY_SIGNS), **{c: c for c, _ in fixed.CURRENCIES}}
    held = {c: [s for s, name in names.items() if name == c] for c in dict.fromkeys(names.values())}
    none = F.lit(None).cast("string")
    codes = [
        F.when(reduce(Column.__or__, [_holds(text, form, names) for form in forms]), F.lit(c)).otherwise(none)
        for c, forms in held.items()
    ]

    def read(found: Column) -> Column:
        a, a_unit, b, b_unit, per = (F.nullif(found["groups"][i], F.lit("")) for i in range(5))
        low = amount(a, F.coalesce(a_unit, b_unit))
        high = F.when(b.isNull(), low).otherwise(amount(b, b_unit))
        known = low.isNotNull() & high.isNotNull()
        hourly = F.when(F.startswith(per, F.lit("H")), F.lit("hour")).otherwise(F.lit("year"))
        return F.struct(
            F.when(known, F.least(low, high)).alias("lo"),
            F.when(known, F.greatest(low, high)).alias("hi"),
            F.when(known & (F.size(found["named"]) == 1), found["named"][0]).alias("currency"),
            F.when(known, hourly).alias("period"),
        )

    # The parts are bound to a name, so that the text is matched once a row.
    parts = F.struct(groups.alias("groups"), F.array_compact(F.array(*codes)).alias("named"))
    return F.transform(F.array(parts), read)[0]


def _holds(text: Column, sign: str, signs) -> Column:
    """Does the text hold a sign, and not just as the end of a longer one?"""
    for longer in signs:
        if longer != sign and sign in longer:
            text = F.replace(text, F.lit(longer), F.lit(""))
    return F.contains(text, F.lit(sign))


def decode_entities(text: Column) -> Column:
    return reduce(
        lambda done, entity: F.replace(done, F.lit(entity[0]), F.lit(entity[1])),
        fixed.HTML_ENTITIES,
        text,
    )
