"""Content digests in one spelling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(hash_col: Column | str) -> Column:
    """The 64 lower-case hex digits of a SHA-256 in any spelling; null where there are not exactly 64."""
    c = F.col(hash_col) if isinstance(hash_col, str) else hash_col
    plain = F.regexp_replace(F.lower(c), r"^\s*sha-?256\s*[:=]?|[^0-9a-f]", "")
    return F.when(F.length(plain) == 64, plain)
