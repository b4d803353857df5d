"""Text scalar functions as Spark columns.

Expressions are native but for full case folding and HTML entities, which have
no built-in form and are Arrow-batched pandas UDFs.
"""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values: line and whitespace classes of Python's str methods ---
# str.splitlines() boundaries.
LINE_BREAK_PATTERN = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
# str.split() whitespace inside a line (Java's Unicode \s plus \x1c-\x1f).
WHITESPACE_RUN_PATTERN = r"(?U)[\s\x1c-\x1f]+"
# Tokens of a query (Python's Unicode \w).
QUERY_TOKEN_PATTERN = r"[\p{L}\p{N}_]+"
# Index term characters: letters, numbers, private use; everything else separates.
TERM_PATTERN = r"[\p{L}\p{N}\p{Co}]+"
# The same before folding: combining marks are no part of a term and do not end one.
RAW_TERM_PATTERN = r"[\p{L}\p{N}\p{Co}][\p{L}\p{N}\p{Co}\u0300-\u036f]*"
RAW_GAP_PATTERN = r"[^\p{L}\p{N}\p{Co}\u0300-\u036f]+"
# HTML to text, in order: script/style blocks, line breaks, paragraph ends, other tags.
SCRIPT_STYLE_PATTERN = r"(?is)<(script|style).*?>.*?</\1>"
BR_PATTERN = r"(?is)<br\s*/?>"
P_END_PATTERN = r"(?is)</p\s*>"
TAG_PATTERN = r"(?is)<[^>]+>"
EXCERPT_MAX_CHARS = 500
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"
# --- end fixed values ---


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _diacritic_table() -> tuple[str, str]:
    """Accented Latin letters and their base letters, derived by rule.

    A letter is mapped when its canonical decomposition is one ASCII letter
    followed only by combining marks. Letters such as 'ß', 'æ', 'ø' have no
    such decomposition and stay as they are, as does every other script.
    """
    src, dst = [], []
    for cp in range(0x80, 0x10000):
        d = unicodedata.normalize("NFD", chr(cp))
        if len(d) > 1 and d[0].isascii() and d[0].isalpha() and all(
            unicodedata.category(x) == "Mn" for x in d[1:]
        ):
            src.append(chr(cp))
            dst.append(d[0])
    return "".join(src), "".join(dst)


DIACRITIC_SRC, DIACRITIC_DST = _diacritic_table()
# Marks that a decomposed Latin letter carries; dropped, so that they do not split a term.
MARK_PATTERN = "[\u0300-\u036f]+"
_FOLD_TABLE = str.maketrans(DIACRITIC_SRC, DIACRITIC_DST)


def fold_for_index(c: Column | str) -> Column:
    """Lower case with Latin diacritics removed, composed or not (index term folding, F2)."""
    return F.regexp_replace(F.translate(F.lower(_col(c)), DIACRITIC_SRC, DIACRITIC_DST), MARK_PATTERN, "")


def fold_python(value: str) -> str:
    """The same folding in Python, for per-row helpers that must agree with it."""
    return re.sub(MARK_PATTERN, "", value.lower().translate(_FOLD_TABLE))


def index_terms(c: Column | str) -> Column:
    """Array of index terms of a text column, in order."""
    return F.regexp_extract_all(fold_for_index(c), F.lit(TERM_PATTERN), 0)


def raw_terms(c: Column | str) -> Column:
    """The terms of ``index_terms`` before ``fold_term``: one pass over a text, accents still on."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(RAW_TERM_PATTERN), 0)


def fold_term(t: Column | str) -> Column:
    """A raw term as the index holds it; a plain ASCII one is one already."""
    t = _col(t)
    return F.when(F.octet_length(t) == F.length(t), t).otherwise(
        F.regexp_replace(F.translate(t, DIACRITIC_SRC, DIACRITIC_DST), MARK_PATTERN, ""))


def spaced_terms(c: Column | str) -> Column:
    """The raw terms of a text between single spaces, for a Python helper to split (runs of marks alone stay in)."""
    return F.regexp_replace(F.lower(_col(c)), RAW_GAP_PATTERN, " ")


def splittable(c: Column | str) -> Column:
    """A text whose raw terms ``split_terms`` finds: ASCII as it is, any other as ``spaced_terms``."""
    return F.when(F.octet_length(_col(c)) == F.length(_col(c)), _col(c)).otherwise(spaced_terms(c))


_ASCII_GAPS = {i: " " for i in range(128) if not chr(i).isalnum()}


def split_terms(text: str) -> list[str]:
    """The raw terms of a ``splittable`` text in Python, by one pass over it."""
    return text.lower().translate(_ASCII_GAPS).split() if text.isascii() else text.split()


def fold_raw(term: str) -> str:
    """``fold_term`` in Python; empty for marks without a letter."""
    if term.isascii():
        return term
    plain = term.translate(_FOLD_TABLE)
    return plain if plain.isascii() else re.sub(MARK_PATTERN, "", plain)


def query_tokens(c: Column | str) -> Column:
    """Array of query tokens (Unicode ``\\w+``) (F1)."""
    return F.regexp_extract_all(_col(c), F.lit(QUERY_TOKEN_PATTERN), 0)


def ascii_lower(c: Column | str) -> Column:
    """Case folding of ASCII letters only, the way SQLite LIKE compares."""
    return F.translate(_col(c), ASCII_UPPER, ASCII_LOWER)


def contains_token(text: Column | str, token: Column | str) -> Column:
    """LIKE '%token%' without regard to the case of ASCII letters, ``_`` for any character.

    A query token holds letters, digits and ``_`` only, so it is a pattern as it
    stands; the text is not copied in lower case.
    """
    return F.rlike(_col(text), F.concat(F.lit("(?is)"), F.translate(_col(token), "_", ".")))


@F.pandas_udf(T.StringType())
def _casefold_udf(s: pd.Series) -> pd.Series:
    return s.str.casefold()


def casefold(c: Column | str) -> Column:
    """Full case folding."""
    return _casefold_udf(_col(c))


@F.pandas_udf(T.StringType())
def _unescape_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda v: html.unescape(v) if v and "&" in v else v)


def html_unescape(c: Column | str) -> Column:
    """Decode every named and numeric HTML entity."""
    return _unescape_udf(_col(c))


def strip_html(c: Column | str) -> Column:
    """Tags out, line structure kept; entities are not decoded here (T3 first half)."""
    out = F.regexp_replace(_col(c), SCRIPT_STYLE_PATTERN, " ")
    out = F.regexp_replace(out, BR_PATTERN, "\n")
    out = F.regexp_replace(out, P_END_PATTERN, "\n")
    return F.regexp_replace(out, TAG_PATTERN, " ")


def html_to_text(c: Column | str) -> Column:
    """HTML to text (T3): drop script/style, breaks to newlines, tags to spaces, unescape."""
    return html_unescape(strip_html(c))


def normalize_text(c: Column | str) -> Column:
    """Collapse whitespace inside lines, drop blank lines, keep line breaks (T4)."""
    lines = F.split(_col(c), LINE_BREAK_PATTERN, -1)
    cleaned = F.transform(lines, lambda x: F.trim(F.regexp_replace(x, WHITESPACE_RUN_PATTERN, " ")))
    return F.array_join(F.filter(cleaned, lambda x: F.length(x) > 0), "\n")


def collapse_whitespace(c: Column | str) -> Column:
    """All whitespace runs, line breaks included, to one space; ends trimmed."""
    return F.trim(F.regexp_replace(_col(c), WHITESPACE_RUN_PATTERN, " "))


def shorten(c: Column | str, max_chars: int = EXCERPT_MAX_CHARS) -> Column:
    """Excerpt shortening (T6): collapse whitespace, cut, right-trim, append '...'."""
    n = collapse_whitespace(F.coalesce(_col(c), F.lit("")))
    cut = F.concat(F.rtrim(F.substring(n, 1, max_chars)), F.lit("..."))
    return F.when(F.length(n) <= max_chars, n).otherwise(cut)
