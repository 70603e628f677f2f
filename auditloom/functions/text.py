"""Column functions on text."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from auditloom import fixed

# Python's whitespace: the Unicode set plus four separators that Java's pattern leaves out
SPACE = r"[\s\x1c-\x1f]"
_SPACES = [c for c in map(chr, range(0x3001)) if c.isspace()]


def strip(text: Column) -> Column:
    """Python's `str.strip()`; Spark's `trim` drops blanks only unless told more."""
    ends = F.left(text, F.lit(1)).isin(_SPACES) | F.right(text, F.lit(1)).isin(_SPACES)
    return F.when(
        ends, F.regexp_replace(text, rf"(?U)\A{SPACE}+|{SPACE}+\z", "")
    ).otherwise(text)


def truncate(text: Column, chars: int) -> Column:
    return F.substring(text, 1, chars)


def decode_source(content: Column) -> Column:
    """Bytes to text: bad UTF-8 replaced, all line ends turned into newlines."""
    text = F.make_valid_utf8(content.cast("string"))
    return F.regexp_replace(text, "\r\n?", "\n")


@F.arrow_udf(StringType())
def _nfkc_batch(text: pa.Array) -> pa.Array:
    # not pyarrow's utf8_normalize: its NFKC leaves accents apart from their letters
    return pa.array(
        [t if t is None else unicodedata.normalize("NFKC", t) for t in text.to_pylist()],
        pa.string(),
    )


def nfkc(text: Column) -> Column:
    """NFKC form. Plain ASCII is its own NFKC form and never leaves the JVM."""
    is_ascii = F.octet_length(text) == F.char_length(text)
    return F.coalesce(F.when(is_ascii, text), _nfkc_batch(F.when(~is_ascii, text)))


def clean_input(text: Column) -> Column:
    """Drop control and format characters but newline and tab, normalize, strip."""
    visible = F.regexp_replace(text, r"[\p{Cc}\p{Cf}&&[^\n\t]]", "")
    return strip(nfkc(visible))


def sanitize_input(text: Column, max_length: int = fixed.INPUT_CHARS) -> Column:
    """Struct of the cleaned text and whether it is short enough; long text is rejected."""
    cleaned = F.coalesce(clean_input(text), F.lit(""))
    too_long = F.char_length(cleaned) > max_length
    return F.struct(
        F.when(~too_long, cleaned).alias("cleaned"), too_long.alias("is_rejected")
    )


def severity_rank(severity: Column) -> Column:
    """0 for critical to 4 for info."""
    return F.array_position(F.array(*map(F.lit, fixed.SEVERITIES)), severity).cast("int") - 1


def as_literal_pattern(names: list[str]) -> str:
    """Regular expression that finds any of the names."""
    return "|".join("".join("\\" + c if c in ".$^*+?()[]{}|\\" else c for c in n) for n in names)
