"""Paths and messages as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a scan takes and leaves out.
EXTENSIONS = (".jpg", ".jpeg", ".png")
IGNORED_FILES = ("thumbs.db", "desktop.ini")
IGNORED_FOLDER = "__MACOSX"
REDACTED = "<redacted-path>"


def normalize_path(path: Column) -> Column:
    """Relative path with forward slashes; empty and ``.`` components collapse. Null where the path is not allowed."""
    slashed = F.regexp_replace(F.regexp_replace(path, r"\\", "/"), "^/+", "")
    parts = F.split(slashed, "/")
    named = F.filter(parts, lambda x: (x != "") & (x != "."))
    return F.when((F.size(named) > 0) & ~F.exists(parts, lambda x: x == ".."), F.array_join(named, "/"))


def eligible(path: Column) -> Column:
    """Whether a scan takes the normalized path."""
    parts = F.split(path, "/")
    name = F.lower(F.element_at(parts, -1))
    suffix = F.regexp_extract(name, r".(\.[^.]*)$", 1)
    return ~F.exists(parts, lambda x: x.startswith(".") | (x == IGNORED_FOLDER)) & ~name.isin(*IGNORED_FILES) & suffix.isin(*EXTENSIONS)


def sanitize(message: Column, longest: int = 500) -> Column:
    """Absolute paths redacted, white space collapsed, cut to a length."""
    pattern = r"""(?:(?:[A-Za-z]:)?[/\\](?:[^\s:'"]+[/\\])+[^\s:'"]*)"""
    clean = F.trim(F.regexp_replace(F.regexp_replace(message, pattern, REDACTED), r"(?U)\s+", " "))
    return F.when(F.length(clean) > longest, F.concat(F.substring(clean, 1, longest - 1), F.lit("…"))).otherwise(clean)
