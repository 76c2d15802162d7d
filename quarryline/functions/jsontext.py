"""Reading model output that should be JSON but may not be."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarryline.functions.binding import bind

_NUMBER = r"\A\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*\z"
_SPAN = r"(?s)(\{.*\}|\[.*\])"


def _valid(text: Column) -> Column:
    return F.when(F.try_parse_json(text).isNotNull(), text)


def lenient_json(text: Column) -> Column:
    """The text when it is JSON, else its widest {...} or [...] span when that is."""
    span = F.nullif(F.regexp_extract(text, _SPAN, 1), F.lit(""))
    return F.coalesce(_valid(text), bind(span, _valid))


def json_kind(text: Column, path: str = "$") -> Column:
    """Type name at a path, null where nothing is there: OBJECT, ARRAY, STRING, VOID, ..."""
    found = F.try_variant_get(F.try_parse_json(text), path, "variant")
    return F.regexp_extract(F.schema_of_variant(found), r"\A(\w+)", 1)


def is_falsy(text: Column, path: str = "$") -> Column:
    """Whether the value is null, false, zero or empty; null where nothing is there."""

    def judged(found: Column) -> Column:
        kind, value = found["kind"], found["value"]
        return (
            F.when(kind == "VOID", True)
            .when(kind == "BOOLEAN", value == "false")
            .when(kind == "STRING", F.coalesce(value, F.lit("")) == "")
            .when(kind == "OBJECT", F.regexp_replace(value, r"\s", "") == "{}")
            .when(kind == "ARRAY", F.regexp_replace(value, r"\s", "") == "[]")
            .when(kind.isNotNull(), as_number(value) == 0.0)
        )

    return bind(_found(text, path), judged)


def _found(text: Column, path: str) -> Column:
    return F.struct(
        json_kind(text, path).alias("kind"), F.get_json_object(text, path).alias("value")
    )


def as_number(text: Column) -> Column:
    """A number as text, or true/false, as double; null for anything else."""
    return (
        F.when(text == "true", 1.0)
        .when(text == "false", 0.0)
        .when(text.rlike(_NUMBER), F.trim(text).try_cast("double"))
    )


def number_at(text: Column, path: str) -> Column:
    """Number at a path: 0 when the key is missing, null when it cannot be read."""
    return bind(
        _found(text, path),
        lambda found: F.when(found["kind"].isNull(), 0.0).otherwise(as_number(found["value"])),
    )
