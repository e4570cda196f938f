"""Sizes of texts in tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space, and a token as a longest run of letters, digits and underscores or of other characters.
SPACE = r"\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
TOKEN = rf"[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{SPACE}]+"


def n_tokens(text: Column) -> Column:
    """Tokens of the whole text, in the JVM; 0 for null, empty and blank texts."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("bigint")
