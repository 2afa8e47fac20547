"""Skill and choice lists kept as arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from joblattice.functions.values import js_trim


def clean_skills(skills: Column) -> Column:
    """Trimmed, non-empty, first of equals kept, entry order kept."""
    return F.array_distinct(F.filter(F.transform(skills, js_trim), lambda s: s != ""))


def add_skill(skills: Column, entry: Column) -> Column:
    """Append one typed entry unless it is blank or (case-sensitively) there."""
    trimmed = js_trim(entry)
    ignore = F.coalesce(trimmed, F.lit("")).eqNullSafe("") | F.array_contains(skills, trimmed)
    return F.when(ignore, skills).otherwise(F.array_append(skills, trimmed))


def remove_skill(skills: Column, skill: Column | str) -> Column:
    return F.array_remove(skills, skill)


def toggle(choices: Column, choice: Column | str) -> Column:
    """Remove the choice when present, else append it."""
    value = choice if isinstance(choice, Column) else F.lit(choice)
    return F.when(F.array_contains(choices, value), F.array_remove(choices, value)).otherwise(
        F.array_append(choices, value)
    )
