"""How the driver's tables become mail data, shared by the Spark queries and the SQL oracle.

* messages: ``documents`` with folder = source, uid = doc_id (see sources.tables).
* fetch failures: messages with ``doc_id % 17 = 0`` cannot be fetched.
* listing gaps: messages with ``doc_id % 13 = 0`` are gone from the server.
* checkpoint: per folder, the highest uid below half of the largest doc_id.

The modulo rules only pick which messages play "failed" or "deleted"; every
query still reads the whole table.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: scenario parameters ---
FAIL_EVERY = 17
GONE_EVERY = 13
POLICY_KEYWORDS = ("thanedble", "Nicht", "attion")
CUSTOM_PATTERNS = ("[0-9a-f]{32,}", r"mail[0-9]+\.example\.com")
RUN_TS = "2026-06-01 12:00:00"
OLD_CHECK_TS = "2026-05-29 12:00:00"
FRESH_CHECK_TS = "2026-06-01 06:00:00"
# --- end fixed values ---


def fetch_ok(uid: Column) -> Column:
    return (uid % F.lit(FAIL_EVERY)) != 0


def still_listed(uid: Column) -> Column:
    return (uid % F.lit(GONE_EVERY)) != 0


def _pad6(x: Column) -> Column:
    return F.lpad((x % 1000000).cast("string"), 6, "0")


def secret_suffix(kind: str, doc_id: Column) -> Column:
    """Deterministic secret appended to a text so every row holds one target."""
    s = doc_id.cast("string")
    if kind == "rrn":
        return F.concat(F.lit(" id "), _pad6(doc_id), F.lit("-"), (doc_id % 8 + 1).cast("string"),
                        _pad6(doc_id * 7), F.lit(" "))
    if kind == "bearer":
        return F.concat(F.lit(" Authorization: Bearer tk"), s, F.lit("xyzabcdef "))
    if kind == "jwt":
        return F.concat(F.lit(" eyJhbGciOi"), s, F.lit(".eyJzdWIiOi"), s, F.lit(".SflKxwRJSM"), s, F.lit(" "))
    if kind == "url":
        return F.concat(F.lit(" https://api.example.com/v1?user="), s, F.lit("&access_token=tk"), s,
                        F.lit("&page=2 "))
    if kind == "secret":
        return (F.when(doc_id % 3 == 0, F.concat(F.lit(" password=pw"), s, F.lit(" ")))
                .when(doc_id % 3 == 1, F.concat(F.lit(' api_key: "k'), s, F.lit('" ')))
                .otherwise(F.concat(F.lit(" secret = 's"), s, F.lit("' "))))
    raise ValueError(kind)


def secret_suffix_sql(kind: str, doc_id: str = "doc_id") -> str:
    """The same suffix as a DuckDB expression."""
    s = f"CAST({doc_id} AS VARCHAR)"
    pad = lambda x: f"lpad(CAST(({x}) % 1000000 AS VARCHAR), 6, '0')"
    if kind == "rrn":
        return (f"(' id ' || {pad(doc_id)} || '-' || CAST({doc_id} % 8 + 1 AS VARCHAR) || "
                f"{pad(doc_id + ' * 7')} || ' ')")
    if kind == "bearer":
        return f"(' Authorization: Bearer tk' || {s} || 'xyzabcdef ')"
    if kind == "jwt":
        return f"(' eyJhbGciOi' || {s} || '.eyJzdWIiOi' || {s} || '.SflKxwRJSM' || {s} || ' ')"
    if kind == "url":
        return f"(' https://api.example.com/v1?user=' || {s} || '&access_token=tk' || {s} || '&page=2 ')"
    if kind == "secret":
        return (f"(CASE WHEN {doc_id} % 3 = 0 THEN ' password=pw' || {s} || ' ' "
                f"WHEN {doc_id} % 3 = 1 THEN ' api_key: \"k' || {s} || '\" ' "
                f"ELSE ' secret = ''s' || {s} || ''' ' END)")
    raise ValueError(kind)
