"""Column functions on paths and URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditloom import fixed
from auditloom.functions.text import as_literal_pattern, strip


def is_scanned(path: Column) -> Column:
    """Python file outside the ignored folders, tested on the repository-relative path."""
    ignored = F.array(*map(F.lit, fixed.IGNORED_DIRS))
    return path.endswith(fixed.SOURCE_SUFFIX) & ~F.arrays_overlap(F.split(path, "/"), ignored)


def is_reviewed(path: Column) -> Column:
    """Python file with no path part that contains an excluded word, in any case."""
    excluded = as_literal_pattern(fixed.REVIEW_EXCLUDED)
    return path.endswith(fixed.SOURCE_SUFFIX) & ~F.lower(path).rlike(excluded)


def safe_path(path: Column) -> Column:
    """Letters, digits and ``_ . / -`` stay; Python's word characters include all Unicode ones."""
    safe = F.regexp_replace(path, r"[^\p{L}\p{N}_./\-]", "_")
    return F.substring(safe, 1, fixed.SAFE_PATH_CHARS)


def relative_to(path: Column, root: Column) -> Column:
    """Path below `root`; null where the path is elsewhere."""
    prefix = F.concat(F.rtrim(root, F.lit("/")), F.lit("/"))
    return F.when(path.startswith(prefix), F.substr(path, F.char_length(prefix) + 1))


def normalize_url(url: Column) -> Column:
    return F.rtrim(strip(url), F.lit("/"))


def is_repository_url(normalized: Column) -> Column:
    return F.coalesce(normalized.rlike(fixed.URL_PATTERN), F.lit(False))


def full_name(normalized: Column) -> Column:
    """Owner and name: the last two parts of a URL."""
    return F.array_join(F.slice(F.split(normalized, "/"), -2, 2), "/")
