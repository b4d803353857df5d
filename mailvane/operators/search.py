"""Ranked search for a batch of queries.

Plan per batch: query tokens -> index terms -> join postings on (term,
folder) -> BM25 parts with global statistics -> sum per (query, message) with
"every token matched" -> active filter and header join -> top-k per query.
Queries with no index hit fall back to an ASCII-case-insensitive LIKE scan
of their folder, newest first. Excerpts are cut only for the final top-k
rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.redact import redact, validate_patterns
from ..functions.text import ascii_lower, contains_token, index_terms, query_tokens, shorten
from ..session import checkpoint_dir, few
from ..sources.tables import restrict_folders
from .index import BM25_B, BM25_K1, IDF_FLOOR, MailIndex

# Excerpt: so many tokens of the body.
EXCERPT_TOKENS = 18
ELLIPSIS = "..."
# A token as the index sees it (combining marks belong to their letter) and what stands between it and the next.
TOKEN_PIECE_PATTERN = r"[\p{L}\p{N}\p{Co}][\p{L}\p{N}\p{Co}\u0300-\u036f]*[^\p{L}\p{N}\p{Co}]*"
LEAD_PATTERN = r"^[^\p{L}\p{N}\p{Co}]*"
GAP_PATTERN = r"[^\p{L}\p{N}\p{Co}\u0300-\u036f]+$"

RESULT_COLUMNS = ("query_id", "folder", "uid", "subject", "sender", "date", "excerpt",
                  "score", "is_deleted", "body_index_blocked", "block_reason", "rank")


def query_terms(queries: DataFrame) -> DataFrame:
    """One row per query token: ``query_id, folder, i, token, terms, m``.

    ``terms`` is the token as the index tokenizer sees it; a token such as
    ``foo_bar`` becomes the phrase ``[foo, bar]``; ``_`` becomes the empty
    phrase, which can never match.
    """
    return (queries.select("query_id", "folder", F.posexplode(query_tokens("query")).alias("i", "token"))
            .withColumn("terms", index_terms(F.col("token")))
            .withColumn("m", F.size("terms")))


def _phrase_hits(qt: DataFrame, index: MailIndex) -> DataFrame:
    """Occurrences of multi-term phrases: rows ``query_id, i, folder, uid, f`` over all folders.

    Only occurrences of phrase terms leave the task that reads a message; no
    text is shuffled.
    """
    parts = qt.filter(F.col("m") > 1).select(
        "query_id", "i", "m", F.posexplode("terms").alias("j", "term"))
    occ = index.occurrences(parts.select("term")).join(F.broadcast(parts), "term")
    starts = (occ.groupBy("query_id", "i", "folder", "uid", "col",
                          (F.col("pos") - F.col("j")).alias("start"))
              .agg(F.count(F.lit(1)).alias("k"), F.first("m").alias("m"))
              .filter(F.col("k") == F.col("m")))
    return starts.groupBy("query_id", "i", "folder", "uid").agg(F.count(F.lit(1)).alias("f"))


def has_phrases(queries: DataFrame) -> bool:
    """Whether any query token is a multi-term phrase (a small job on the query batch only)."""
    return not query_terms(queries).filter(F.col("m") > 1).isEmpty()


def bm25_scores(index: MailIndex, queries: DataFrame, stats: DataFrame | None = None,
                phrases: bool | None = None) -> DataFrame:
    """Scores of every message that holds all tokens of a query.

    Returns ``query_id, folder, uid, score``; more negative is better. N,
    average length and document frequencies cover the whole index (all
    folders, soft-deleted rows included); results are restricted to the
    query's folder only after that. ``stats`` may be a precomputed one-row
    ``corpus_stats()`` table. ``phrases=False`` leaves out the phrase branch
    (which rescans the corpus for positions when the index stores none);
    ``None`` decides from the batch.
    """
    index = index.of_terms(query_terms(queries).select(F.explode("terms").alias("term")))
    cs = stats if stats is not None else index.corpus_stats()
    st = cs.select(F.struct("n_docs", "avgdl")).scalar()
    n_docs, avgdl = st.getField("n_docs"), st.getField("avgdl")
    if phrases is None:
        phrases = has_phrases(queries)

    q = queries.select("query_id", "folder", F.size(query_tokens("query")).alias("n_tokens"))
    qt = query_terms(queries)
    post = index.postings

    single = qt.filter(F.col("m") == 1).select("query_id", "folder", "i", F.col("terms")[0].alias("term"))
    df_single = (F.broadcast(single.select("term").distinct())
                 .join(post.select("term"), "term").groupBy("term").agg(F.count(F.lit(1)).alias("n")))
    # hits only in the queries' folders; document frequencies above stay global
    hit_post = restrict_folders(post, queries)
    hits1 = (F.broadcast(single).join(hit_post.select("term", "folder", "uid", F.col("tf").alias("f")), ["term", "folder"])
             .join(df_single, "term")
             .select("query_id", "i", "folder", "uid", "f", "n"))

    hits = hits1
    if phrases:
        # asked for twice, frequency and rows; the texts are read once
        ph = _phrase_hits(qt, index).checkpoint(eager=True)
        ph_n = ph.groupBy("query_id", "i").agg(F.count(F.lit(1)).alias("n"))
        hits_m = (ph.join(q.select("query_id", F.col("folder").alias("q_folder")), "query_id")
                  .filter(F.col("folder") == F.col("q_folder")).drop("q_folder")
                  .join(ph_n, ["query_id", "i"])
                  .select("query_id", "i", "folder", "uid", "f", "n"))
        hits = hits.unionByName(hits_m)
    hits = hits.join(index.doc_len, ["folder", "uid"])
    raw_idf = F.log((n_docs - F.col("n") + F.lit(0.5)) / (F.col("n") + F.lit(0.5)))
    idf = F.when(raw_idf <= 0, F.lit(IDF_FLOOR)).otherwise(raw_idf)
    f = F.col("f").cast("double")
    part = idf * (f * (BM25_K1 + 1.0)) / (f + BM25_K1 * (1.0 - BM25_B + BM25_B * F.col("len") / avgdl))
    return (hits.groupBy("query_id", "folder", "uid")
            .agg((-F.sum(part)).alias("score"), F.count(F.lit(1)).alias("matched"))
            .join(q.select("query_id", "n_tokens"), "query_id")
            .filter(F.col("matched") == F.col("n_tokens"))
            .select("query_id", "folder", "uid", "score"))


def rounded(c: Column, digits: int | None) -> Column:
    return c if digits is None else F.round(c, digits)


def best_cover(offsets: Column, n_terms: Column) -> Column:
    """(first, last): the span of tokens with the most distinct terms that fit one excerpt.

    ``offsets`` are (pos, k) of the tokens that are term number k, in order.
    The span ends at the first token at which that many terms stand within
    EXCERPT_TOKENS, and begins at the last token from which they all do. One
    pass keeps the last place of every term. Without a hit ``last`` is below 0.
    """
    never = -(1 << 30)
    start = F.struct(F.transform(F.sequence(F.lit(0), F.greatest(n_terms, F.lit(1)) - 1), lambda _: F.lit(never)).alias("seen"),
                     F.lit(0).alias("n"), F.lit(0).alias("first"), F.lit(-1).alias("last"))

    def step(acc: Column, hit: Column) -> Column:
        seen = F.transform(acc["seen"], lambda v, j: F.when(j == hit["k"], hit["pos"]).otherwise(v))
        live = F.filter(seen, lambda v: v > hit["pos"] - EXCERPT_TOKENS)
        more = F.size(live) > acc["n"]
        return F.struct(seen.alias("seen"), F.when(more, F.size(live)).otherwise(acc["n"]).alias("n"),
                        F.when(more, F.array_min(live)).otherwise(acc["first"]).alias("first"),
                        F.when(more, hit["pos"]).otherwise(acc["last"]).alias("last"))

    return F.aggregate(offsets, start, step, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))


def _with_excerpt(rows: DataFrame) -> DataFrame:
    """``excerpt`` of ``body`` around its ``terms`` (F8).

    EXCERPT_TOKENS tokens that hold the span of ``best_cover`` in their middle
    (of an odd rest one more behind it), moved inside the body. Tokens are whole
    and punctuation between them stays; ``...`` marks a cut. Without a hit in
    the body the excerpt is its beginning.
    """
    body = F.coalesce("body", F.lit(""))
    pieces = F.regexp_extract_all(body, F.lit(TOKEN_PIECE_PATTERN), 0)
    # folded piece by piece; a piece is its term but for what follows it
    folded = F.transform("_pieces", lambda p: F.get(index_terms(p), F.lit(0)))
    hits = F.filter(F.transform("_folded", lambda t, i: F.struct(i.cast("int").alias("pos"), (F.array_position("terms", t) - 1).cast("int").alias("k"))),
                    lambda h: h["k"] >= 0)
    rows = rows.withColumn("_pieces", pieces).withColumn("_folded", folded).withColumn("_span", best_cover(hits, F.size("terms")))
    size = F.size("_pieces")
    first = F.col("_span.first") - F.floor((EXCERPT_TOKENS - (F.col("_span.last") - F.col("_span.first") + 1)) / 2).cast("int")
    first = F.when(F.col("_span.last") < 0, 0).otherwise(F.greatest(F.least(first, size - EXCERPT_TOKENS), F.lit(0)))
    rows = rows.withColumn("_first", first.cast("int"))
    cut_before, cut_after = F.col("_first") > 0, F.col("_first") + EXCERPT_TOKENS < size
    text = F.array_join(F.slice("_pieces", F.col("_first") + 1, EXCERPT_TOKENS), "")
    out = F.concat(F.when(cut_before, ELLIPSIS).otherwise(F.regexp_extract(body, LEAD_PATTERN, 0)),
                   F.when(cut_after, F.concat(F.regexp_replace(text, GAP_PATTERN, ""), F.lit(ELLIPSIS))).otherwise(text))
    return rows.withColumn("excerpt", F.when(size == 0, body).otherwise(out)).drop("_pieces", "_folded", "_span", "_first")


def search(index, messages: DataFrame, queries: DataFrame, *,
           default_limit: int = 20, score_digits: int | None = None, with_excerpt: bool = True,
           fallback: bool = True, redact_output: bool = True, extra_patterns=None,
           stats: DataFrame | None = None, materialize: bool = True, grams=None) -> DataFrame:
    """Ranked, redacted search for ``queries(query_id, folder, query[, limit])``.

    ``messages`` is the index table (``folder, uid, subject, sender, date,
    body, is_deleted, body_index_blocked, block_reason``). Ranking is score
    ascending, then uid descending; with ``score_digits`` the score is rounded
    before ranking and output.

    With ``materialize`` the ranked index hits (at most ``limit`` rows per
    query) are checkpointed to the shared checkpoint folder. The fallback
    then sees which queries are unanswered from that small table, and the
    LIKE scan of the message bodies is skipped when every query was answered.

    ``index`` is a ``MailIndex`` or a ``blocks.BlockIndex``, whose bounds leave
    blocks unread. With ``grams`` (a ``grams.GramIndex``) the fallback looks
    its candidates up instead of scanning the folders.
    """
    if int(default_limit) < 1:
        raise ValueError("limit must be greater than 0")
    extra = validate_patterns(extra_patterns)
    q = queries.select("query_id", "folder", "query",
                       (F.col("limit") if "limit" in queries.columns else F.lit(default_limit))
                       .cast("int").alias("q_limit"))
    # the batch is small and read by several planning jobs (term list, limit bound, phrase check):
    # keep it in memory; a lost block is recomputed from its lineage
    q = q.cache()
    messages = restrict_folders(messages, q)  # headers, bodies, fallback: only the batch's folders
    heads = messages.filter(~F.col("is_deleted")).select(
        "folder", "uid", "subject", "sender", "date", "is_deleted", "body_index_blocked", "block_reason")
    active_keys = messages.filter(~F.col("is_deleted")).select("folder", "uid")
    bound = _limit_bound(q)

    if isinstance(index, MailIndex):
        # top-k on (query, message, score) only: the literal bound lets Spark cut each map task to
        # `bound` rows per query before the shuffle; headers are joined for the survivors
        scored = (bm25_scores(index, q, stats)
                  .join(active_keys, ["folder", "uid"], "left_semi")
                  .withColumn("score", rounded(F.col("score"), score_digits)))
        w = Window.partitionBy("query_id").orderBy(F.col("score").asc(), F.col("uid").desc())
        ranked = (scored.withColumn("rank", F.row_number().over(w))
                  .filter(F.col("rank") <= F.lit(bound))
                  .join(q.select("query_id", "q_limit"), "query_id")
                  .filter(F.col("rank") <= F.col("q_limit")).drop("q_limit"))
    else:
        ranked = index.top_hits(q, active_keys, bound, score_digits)
    if materialize:
        # few rows, counted: headers and bodies are read in place, not shuffled to them
        checkpoint_dir(ranked.sparkSession)
        ranked = few(heads.join(few(ranked.checkpoint(eager=True)), ["folder", "uid"]).checkpoint(eager=True))
    else:
        ranked = ranked.join(heads, ["folder", "uid"])
    answered = ranked.select("query_id")

    if with_excerpt:
        terms = q.select("query_id", F.array_distinct(F.flatten(F.transform(query_tokens("query"), index_terms))).alias("terms"))
        bodies = messages.select("folder", "uid", "body")
        ranked = _with_excerpt(bodies.join(ranked, ["folder", "uid"]).join(F.broadcast(terms), "query_id"))
        ranked = ranked.withColumn("excerpt", shorten("excerpt")).drop("body", "terms")
    else:
        ranked = ranked.withColumn("excerpt", F.lit(None).cast("string"))

    out = ranked
    if fallback:
        pending = _unanswered(q, answered)
        if not (materialize and pending.isEmpty()):
            found = (fallback_search(messages, pending, None, with_excerpt) if grams is None
                     else grams.fallback(messages, pending, bound, with_excerpt))
            out = out.unionByName(found)
    out = out.select(*RESULT_COLUMNS)
    if redact_output:
        out = out.withColumns({c: redact(c, extra) for c in ("subject", "sender", "excerpt")})
    return out


def _limit_bound(queries: DataFrame) -> int:
    """Largest ``q_limit`` of a query batch (a tiny job on the batch), used as a literal top-k bound."""
    bound, least = queries.agg(F.max("q_limit"), F.min("q_limit")).first()
    if least is not None and least < 1:
        raise ValueError("limit must be greater than 0")
    return int(bound or 1)


def _unanswered(queries: DataFrame, answered: DataFrame | None) -> DataFrame:
    q = queries if answered is None else queries.join(answered.select("query_id").distinct(), "query_id",
                                                      "left_anti")
    return (q.withColumn("tokens", F.transform(query_tokens("query"), lambda t: ascii_lower(t)))
            .filter(F.size("tokens") > 0))


def fallback_search(messages: DataFrame, queries: DataFrame, answered: DataFrame | None,
                    with_excerpt: bool = True) -> DataFrame:
    """LIKE scan for queries the index did not answer.

    Every token must occur in subject or body, comparing with ASCII-only
    case folding and ``_`` as a one-character wildcard, like SQLite's LIKE.
    Score 0.0, newest first, ``limit`` rows. Queries without tokens get
    nothing.
    """
    q = queries if "tokens" in queries.columns and answered is None else _unanswered(queries, answered)
    m = messages.filter(~F.col("is_deleted")).select("folder", "uid", "subject", F.coalesce(F.col("body"), F.lit("")).alias("body"))
    cond = F.forall("tokens", lambda t: contains_token("subject", t) | contains_token("body", t))
    # keys only are ranked; texts are joined for the rows that stay
    hits = m.join(F.broadcast(q), "folder").filter(cond).select("query_id", "folder", "uid", "q_limit")
    w = Window.partitionBy("query_id").orderBy(F.col("uid").desc())
    top = (hits.withColumn("rank", F.row_number().over(w))
           .filter(F.col("rank") <= F.lit(_limit_bound(q)))
           .filter(F.col("rank") <= F.col("q_limit")))
    return fallback_rows(messages, top, with_excerpt)


def fallback_rows(messages: DataFrame, top: DataFrame, with_excerpt: bool) -> DataFrame:
    """Result rows of the messages in ``top(query_id, folder, uid, rank)``; a body is shortened only there."""
    checkpoint_dir(messages.sparkSession)
    rows = messages.filter(~F.col("is_deleted")).join(few(top.checkpoint(eager=True)), ["folder", "uid"])
    return rows.select(
        "query_id", "folder", "uid", "subject", "sender", "date",
        (shorten(F.col("body")) if with_excerpt else F.lit(None).cast("string")).alias("excerpt"),
        F.lit(0.0).alias("score"), "is_deleted", "body_index_blocked", "block_reason", "rank")


def search_context(sync_fn, search_fn):
    """Search after a best-effort sync.

    ``sync_fn()`` returns a metrics DataFrame; if it raises, the error is
    reported as one row and the search still runs on the existing index.
    Returns (sync_report, results).
    """
    try:
        report = sync_fn()
        checkpoint_dir(report.sparkSession)
        # the sync's own work runs here, so that its failures are reported as well
        report = (report.withColumn("ok", F.lit(True)).withColumn("error", F.lit(None).cast("string"))
                  .checkpoint(eager=True))
        ok = True
    except Exception as exc:  # report and carry on, as the original tool does
        report, ok = str(exc), False
    results = search_fn()
    if not ok:
        spark = results.sparkSession
        report = spark.createDataFrame([(False, report)], "ok boolean, error string")
    return report, results


def redact_query_echo(queries: DataFrame, extra_patterns=None) -> DataFrame:
    """Queries with the echoed query text redacted (P10)."""
    return queries.withColumn("query", redact("query", validate_patterns(extra_patterns)))
