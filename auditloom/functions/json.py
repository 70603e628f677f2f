"""JSON in VARIANT columns, with Python's reading of it."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditloom.functions.text import strip

_DIGITS = [c for c in map(chr, range(sys.maxunicode)) if unicodedata.category(c) == "Nd"]
_VALUES = "".join(str(unicodedata.decimal(c)) for c in _DIGITS)


def parse(text: Column) -> Column:
    """Variant, or null for bad JSON.

    `try_parse_json` ignores what follows the first value. Wrapped in brackets, exactly one
    element must be there; with one more behind it, two. The second test fails where the text
    closes the bracket itself.
    """
    def length(after: str) -> Column:
        return F.json_array_length(F.concat(F.lit("["), text, F.lit(after + "]")))

    whole = (length("") == 1) & (length(",0") == 2)
    return F.when(whole, F.try_parse_json(text))


def is_object(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))


def is_list(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith("ARRAY"), F.lit(False))


def field(value: Column, name: str) -> Column:
    """Member of an object as a variant; null where the key is missing."""
    return F.try_variant_get(value, f"$.{name}", "variant")


def as_text(value: Column) -> Column:
    """Python's `str()` of a parsed value; null only for a missing one."""
    plain = F.try_variant_get(value, "$", "string")
    is_flag = plain.isin("true", "false") & (F.schema_of_variant(value) == "BOOLEAN")
    return (
        F.when(plain.isNull() & F.is_variant_null(value), "None")
        .when(is_flag, F.initcap(plain))
        .otherwise(plain)
    )


def as_int(value: Column) -> Column:
    """Whole number of 32 bits: fractions cut off, text read as `int()` does, anything else null.

    Text can have white space around it, a sign, digits of any script and single `_` between them.
    """
    text = F.translate(strip(F.try_variant_get(value, "$", "string")), "".join(_DIGITS), _VALUES)
    number = F.when(
        text.rlike(r"\A[+-]?[0-9]+(_[0-9]+)*\z"), F.replace(text, F.lit("_"), F.lit(""))
    ).try_cast("int")
    is_text = F.schema_of_variant(value) == "STRING"
    return F.when(is_text, number).otherwise(F.try_variant_get(value, "$", "int"))
