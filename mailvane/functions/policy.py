"""Subject policy as column expressions.

A message is body-blocked when its case-folded subject contains any keyword.
Keywords are a plain argument; the defaults are the compensation words of the
original tool.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import casefold

# --- fixed values: default policy keywords, reason and blocked-body marker ---
COMPENSATION_SUBJECT_KEYWORDS = ("연봉", "성과급", "보너스", "인센티브", "보상", "급여", "임금")
COMPENSATION_BLOCK_REASON = "COMPENSATION_SUBJECT"
COMPENSATION_BLOCK_BODY = "[BLOCKED:COMPENSATION_SUBJECT]"
# --- end fixed values ---


def contains_keyword(c: Column | str, keywords: Sequence[str] | None) -> Column:
    """True when the case-folded value contains any keyword folded the same way."""
    if not keywords:
        return F.lit(False)
    folded = casefold(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))
    tests = [folded.contains(F.lit(k.casefold())) for k in keywords]
    return reduce(lambda a, b: a | b, tests)


def block_columns(subject: Column | str = "subject",
                  keywords: Sequence[str] | None = COMPENSATION_SUBJECT_KEYWORDS,
                  reason: str = COMPENSATION_BLOCK_REASON) -> dict[str, Column]:
    """``body_read_blocked`` and ``block_reason`` columns for a header row."""
    blocked = contains_keyword(subject, keywords)
    return {
        "body_read_blocked": blocked,
        "block_reason": F.when(blocked, F.lit(reason)).otherwise(F.lit(None).cast("string")),
    }
