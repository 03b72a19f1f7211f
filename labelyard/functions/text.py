"""Row-wise text expressions; all of them also work on streams."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Words of two or more letters, digits or underscores in any script. Java's \w is
# ASCII only, hence the Unicode classes.
TOKEN = r"[\p{L}\p{N}_]{2,}"

# Unicode white space, spelled out for the same reason.
SPACE = r"\s\x0b\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def is_blank(text: Column) -> Column:
    """True for NULL, empty and all-whitespace text."""
    return ~F.coalesce(text, F.lit("")).rlike(f"[^{SPACE}]")


def seed_order(seed: int, key: Column) -> Column:
    """Reproducible pseudo-random order key: depends only on the seed and the row key."""
    return F.md5(F.concat_ws("-", F.lit(str(seed)), key.cast("string")))
