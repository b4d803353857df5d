"""Inverted index over subject and body.

``postings(term, folder, uid, tf, positions)`` and ``doc_len(folder, uid, len)``.
Tokens of one message are exploded in one pass (both columns together), so
the grouping by ``(term, folder, uid)`` is fully combined map-side and the
shuffle moves only finished postings. The key includes the document, so a
hot term or a hot folder spreads over all reducers.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold_term, raw_terms
from ..session import checkpoint_dir

# --- fixed values: BM25 constants of the ranking function ---
BM25_K1 = 1.2
BM25_B = 0.75
IDF_FLOOR = 1e-6
# --- end fixed values ---


@dataclass(frozen=True)
class MailIndex:
    """Postings and document lengths.

    ``postings`` may carry ``positions``; when it does not, ``source`` (the
    indexed messages) lets phrase queries recompute positions for just the
    phrase terms: a scan and explode filtered by a small term set, no
    shuffle of the corpus.
    """
    postings: DataFrame
    doc_len: DataFrame
    source: DataFrame | None = None

    def occurrences(self, terms: DataFrame) -> DataFrame:
        """``term, folder, uid, col, pos`` for the given ``terms(term)``."""
        t = F.broadcast(terms.select("term").distinct())
        if "positions" in self.postings.columns:
            return (self.postings.join(t, "term", "left_semi")
                    .select("term", "folder", "uid", F.explode("positions").alias("p"))
                    .select("term", "folder", "uid", F.col("p.col").alias("col"), F.col("p.pos").alias("pos")))
        if self.source is None:
            raise ValueError("phrase search needs positions in the postings or the indexed messages")
        return _occurrences(_tokens(self.source)).join(t, "term", "left_semi")

    def of_terms(self, terms: DataFrame) -> "MailIndex":
        """This index for ``terms(term)`` alone, written once; lengths and the source stay whole.

        The semi join stands below the grouping of the postings: other terms
        are dropped where they are read, before any shuffle.
        """
        checkpoint_dir(terms.sparkSession)
        post = self.postings.join(F.broadcast(terms.select("term").distinct()), "term", "left_semi").checkpoint(eager=True)
        lens = self.doc_len if self.source is None else self.doc_len.checkpoint(eager=True)
        return MailIndex(post, lens, self.source)

    def term_stats(self) -> DataFrame:
        """Document frequency per term (A4)."""
        return self.postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))

    def corpus_stats(self) -> DataFrame:
        """One row: number of indexed messages and average length (A4)."""
        return self.doc_len.agg(
            F.count(F.lit(1)).alias("n_docs"),
            (F.sum("len").cast("double") / F.count(F.lit(1))).alias("avgdl"),
        )


def _tokens(messages: DataFrame) -> DataFrame:
    return messages.select(
        "folder", "uid",
        raw_terms(F.coalesce(F.col("subject"), F.lit(""))).alias("s_terms"),
        raw_terms(F.coalesce(F.col("body"), F.lit(""))).alias("b_terms"),
    )


def doc_lengths(messages: DataFrame) -> DataFrame:
    """Token count of subject plus body per message."""
    return _tokens(messages).select(
        "folder", "uid", (F.size("s_terms") + F.size("b_terms")).alias("len"))


def _occurrences(toks: DataFrame) -> DataFrame:
    """Terms are folded after the explode, where most are ASCII and stay as they are."""
    rows = toks.select("folder", "uid", F.size("s_terms").alias("_n"),
                       F.posexplode(F.concat("s_terms", "b_terms")).alias("_p", "_raw"))
    body = F.col("_p") >= F.col("_n")
    return rows.select(fold_term("_raw").alias("term"), "folder", "uid", F.when(body, 1).otherwise(0).alias("col"),
                       F.when(body, F.col("_p") - F.col("_n")).otherwise(F.col("_p")).alias("pos"))


def tagged_terms(messages: DataFrame) -> DataFrame:
    """``term, folder, uid, col, pos`` of every term occurrence (``col`` 0: subject, 1: body)."""
    return _occurrences(_tokens(messages))


def build_postings(messages: DataFrame, with_positions: bool = True) -> DataFrame:
    """Postings of ``messages(folder, uid, subject, body)``."""
    toks = _tokens(messages)
    if not with_positions:
        occ = toks.select("folder", "uid", F.explode(F.concat("s_terms", "b_terms")).alias("_raw")).select(
            fold_term("_raw").alias("term"), "folder", "uid")
    else:
        occ = _occurrences(toks)
    aggs = [F.count(F.lit(1)).cast("int").alias("tf")]
    if with_positions:
        aggs.append(F.array_sort(F.collect_list(F.struct("col", "pos"))).alias("positions"))
    return occ.groupBy("term", "folder", "uid").agg(*aggs)


def build_index(messages: DataFrame, with_positions: bool = False) -> MailIndex:
    """Index of ``messages``; blocked rows are indexed with their (empty) body.

    Without ``with_positions`` the index keeps a reference to ``messages``
    for phrase queries instead of storing every position.
    """
    return MailIndex(build_postings(messages, with_positions), doc_lengths(messages),
                     None if with_positions else messages)


def refresh_index(index: MailIndex, touched: DataFrame, removed_folders: DataFrame | None = None,
                  with_positions: bool = False, messages: DataFrame | None = None) -> MailIndex:
    """Replace the entries of touched messages and of reset folders.

    ``touched`` holds the new content of upserted messages. Entries of other
    messages are kept as they are; nothing is rescored, since scores are
    computed from the statistics at query time.
    """
    keys = touched.select("folder", "uid")
    post = index.postings.join(keys, ["folder", "uid"], "left_anti")
    lens = index.doc_len.join(keys, ["folder", "uid"], "left_anti")
    if removed_folders is not None:
        rf = removed_folders.select("folder")
        post = post.join(rf, "folder", "left_anti")
        lens = lens.join(rf, "folder", "left_anti")
    fresh = build_index(touched, with_positions)
    return MailIndex(post.unionByName(fresh.postings), lens.unionByName(fresh.doc_len),
                     None if with_positions else messages)

