"""Registered fixture queries: one Spark plan per operator and its SQL oracle.

Every query reads the driver's tables at ``sf_dir`` in full. Query batches
(search strings, keys) are parameters; the corpus they run against is the
whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import policy
from ..functions.redact import (redact, redact_bearer, redact_custom, redact_jwt, redact_rrn,
                                redact_secret_value, redact_url_secret)
from ..functions.text import html_to_text, normalize_text, shorten
from ..operators import index as ix
from ..operators import reading, search
from ..sources import tables
from . import fixture as fx
from . import oracle as o

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        _QUERIES[name] = fn
        if sql is not None:
            _ORACLE[name] = sql
        return fn
    return deco


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLE)


# ---------------------------------------------------------------- inputs

def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read_table(spark, sf_dir, "documents")


def source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.source_messages_from_documents(documents(spark, sf_dir))


def indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.as_index_rows(source(spark, sf_dir), F.lit(fx.RUN_TS).cast("timestamp"))


# ------------------------------------------------- scans and projections

register("folder_inventory", "SELECT DISTINCT source AS name FROM documents")(
    lambda spark, d: tables.folder_inventory(source(spark, d)))

register("uid_listing_range",
         "SELECT source AS folder, doc_id AS uid, 777 AS uidvalidity FROM documents "
         "WHERE doc_id >= (SELECT max(doc_id) FROM documents) / 2")(
    lambda spark, d: tables.uid_listing(source(spark, d)).filter(
        F.col("uid") >= documents(spark, d).select((F.max("doc_id") / 2).alias("h")).scalar()))


def _recent_sql(limit: int) -> str:
    blocked = o.contains_any_sql("subject", fx.POLICY_KEYWORDS)
    return (f"WITH {o.MESSAGES_CTE}, r AS (SELECT *, row_number() OVER (PARTITION BY folder "
            f"ORDER BY uid DESC) AS rank FROM m) "
            f"SELECT folder, uid, {o.redact_sql('subject')} AS subject, {o.redact_sql('sender')} AS sender, "
            f"date, rank, {blocked} AS body_read_blocked, "
            f"CASE WHEN {blocked} THEN 'COMPENSATION_SUBJECT' END AS block_reason "
            f"FROM r WHERE rank <= {limit}")


@register("recent_messages", _recent_sql(10))
def recent_messages(spark, d):
    return reading.recent_messages(source(spark, d), 10, fx.POLICY_KEYWORDS)


_CONV_CTE = ("c AS (SELECT role AS folder, conv_id * 1000 + turn AS uid, "
             "split_part(text, chr(10), 1) AS subject, "
             "'conv' || CAST(conv_id AS VARCHAR) || '@example.com' AS sender, "
             "'Thu, 28 May 2026 10:00:00 +0900' AS date FROM conversations)")


@register("recent_conversations",
          f"WITH {_CONV_CTE}, r AS (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY uid DESC) AS rank "
          f"FROM c) SELECT folder, uid, {o.redact_sql('subject')} AS subject, {o.redact_sql('sender')} AS sender, "
          f"date, rank, {o.contains_any_sql('subject', fx.POLICY_KEYWORDS)} AS body_read_blocked, "
          f"CASE WHEN {o.contains_any_sql('subject', fx.POLICY_KEYWORDS)} THEN 'COMPENSATION_SUBJECT' END "
          f"AS block_reason FROM r WHERE rank <= 25")
def recent_conversations(spark, d):
    """Second corpus: newest turns per role."""
    conv = tables.source_messages_from_conversations(tables.read_table(spark, d, "conversations"))
    return reading.recent_messages(conv, 25, fx.POLICY_KEYWORDS)


def _body_sql(where: str, max_chars: int, keys_from: str | None) -> str:
    blocked = o.contains_any_sql("subject", fx.POLICY_KEYWORDS)
    red = o.redact_sql("body")
    keys = f" JOIN ({keys_from}) k USING (folder, uid)" if keys_from else ""
    return (
        f"WITH {o.MESSAGES_CTE}, s AS (SELECT m.* FROM m{keys} WHERE {where}) "
        f"SELECT folder, uid, {o.redact_sql('subject')} AS subject, {o.redact_sql('sender')} AS sender, date, "
        f"CASE WHEN {blocked} THEN '[BLOCKED:COMPENSATION_SUBJECT]' ELSE substr({red}, 1, {max_chars}) END AS body, "
        f"CASE WHEN {blocked} THEN 'blocked' ELSE 'plain' END AS body_text_type, "
        f"CASE WHEN {blocked} THEN false ELSE length({red}) > {max_chars} END AS truncated, "
        f"{blocked} AS blocked, {blocked} AS can_override, "
        f"CASE WHEN {blocked} THEN 'COMPENSATION_SUBJECT' END AS block_reason FROM s")


_LABEL_KEYS = "SELECT d.source AS folder, l.doc_id AS uid FROM labels l JOIN documents d ON d.doc_id = l.doc_id"


@register("keyed_fetch", _body_sql("true", 2000, _LABEL_KEYS))
def keyed_fetch(spark, d):
    labels = tables.read_table(spark, d, "labels")
    keys = labels.join(documents(spark, d).select("doc_id", "source"), "doc_id").select(
        F.col("source").alias("folder"), F.col("doc_id").alias("uid"))
    return reading.read_bodies(source(spark, d), None, keys, 2000, False, fx.POLICY_KEYWORDS)


@register("policy_withhold", _body_sql("true", 1000, None))
def policy_withhold(spark, d):
    src = source(spark, d)
    return reading.read_bodies(src, None, src.select("folder", "uid"), 1000, False, fx.POLICY_KEYWORDS)


def _index_rows_sql() -> str:
    blocked = o.contains_any_sql("subject", fx.POLICY_KEYWORDS)
    return (f"WITH {o.MESSAGES_CTE} SELECT folder, uid, uidvalidity, subject, sender, date, "
            f"CASE WHEN {blocked} THEN '' ELSE body END AS body, "
            f"CASE WHEN {blocked} THEN 'blocked' ELSE 'plain' END AS body_text_type, false AS truncated, "
            f"{blocked} AS body_index_blocked, CASE WHEN {blocked} THEN 'COMPENSATION_SUBJECT' END AS block_reason "
            f"FROM m")


@register("policy_index_rows", _index_rows_sql())
def policy_index_rows(spark, d):
    from ..operators import sync
    return sync.apply_index_policy(source(spark, d), fx.POLICY_KEYWORDS,
                                   policy.COMPENSATION_BLOCK_REASON).drop("ok")


BODY_QUERIES = [
    (1, "src0", "the", 5, 30), (2, "src3", "Licen", 5, 30), (3, "src7", "token", 3, 50),
    (4, "src11", "der", 5, 10), (5, "src15", "zzzz", 5, 30), (6, "src3", "é", 4, 50),
]


def _body_search_sql() -> str:
    blocked = o.contains_any_sql("subject", fx.POLICY_KEYWORDS)
    red = o.redact_sql("body")
    qv = o.values_sql(BODY_QUERIES, ["query_id", "folder", "query", "lim", "max_scan"])
    return (
        f"WITH {o.MESSAGES_CTE}, qs AS (SELECT * FROM {qv}), "
        f"r AS (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY uid DESC) AS scan_rank FROM m), "
        f"h AS (SELECT qs.query_id, qs.lim, r.* FROM r JOIN qs USING (folder) "
        f"WHERE r.scan_rank <= qs.max_scan AND NOT {blocked} AND contains(lower(r.body), lower(qs.query))), "
        f"t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY uid DESC) AS rank FROM h) "
        f"SELECT query_id, folder, uid, {o.redact_sql('subject')} AS subject, {o.redact_sql('sender')} AS sender, "
        f"date, substr({red}, 1, 300) AS body, 'plain' AS body_text_type, length({red}) > 300 AS truncated, "
        f"rank, false AS blocked, false AS can_override, CAST(NULL AS VARCHAR) AS block_reason "
        f"FROM t WHERE rank <= lim")


@register("body_search", _body_search_sql())
def body_search(spark, d):
    qs = spark.createDataFrame(BODY_QUERIES, "query_id long, folder string, query string, limit int, max_scan int")
    return reading.body_search(source(spark, d), qs, 300, False, fx.POLICY_KEYWORDS).drop("scan_rank")


# ------------------------------------------------------------- redaction

def _redact_query(kind: str, fn):
    def run(spark, d):
        docs = documents(spark, d)
        text = F.concat(F.col("text"), fx.secret_suffix(kind, F.col("doc_id")))
        return docs.select("doc_id", fn(text).alias("redacted"))
    sql_fn = {"rrn": o.rrn_sql, "bearer": o.bearer_sql, "jwt": o.jwt_sql, "url": o.url_secret_sql}
    sql = None
    if kind in sql_fn:
        sql = (f"SELECT doc_id, {sql_fn[kind]('(text || ' + fx.secret_suffix_sql(kind) + ')')} AS redacted "
               f"FROM documents")
    register(f"redact_{kind}", sql)(run)


_redact_query("rrn", redact_rrn)
_redact_query("bearer", redact_bearer)
_redact_query("jwt", redact_jwt)
_redact_query("url", redact_url_secret)


def _secret_sql() -> str:
    return f"SELECT doc_id, {o.secret_sql('(text || ' + fx.secret_suffix_sql('secret') + ')')} AS redacted FROM documents"


register("redact_secret", _secret_sql())(
    lambda spark, d: documents(spark, d).select(
        "doc_id", redact_secret_value(F.concat(F.col("text"), fx.secret_suffix("secret", F.col("doc_id"))))
        .alias("redacted")))

register("redact_custom",
         "SELECT doc_id, " + "".join("regexp_replace(" for _ in fx.CUSTOM_PATTERNS) + "text"
         + "".join(f", {o.q(p)}, '[REDACTED:CUSTOM]', 'g')" for p in fx.CUSTOM_PATTERNS)
         + " AS redacted FROM documents")(
    lambda spark, d: documents(spark, d).select("doc_id", redact_custom(F.col("text"), fx.CUSTOM_PATTERNS)
                                                .alias("redacted")))


def _chain_text_sql() -> str:
    parts = " || ".join(fx.secret_suffix_sql(k) for k in ("rrn", "bearer", "jwt", "url", "secret"))
    return f"(text || {parts})"


def _chain_text(doc_id):
    return F.concat(F.col("text"), *[fx.secret_suffix(k, doc_id) for k in ("rrn", "bearer", "jwt", "url", "secret")])


register("redact_chain",
         f"SELECT doc_id, {o.redact_sql(_chain_text_sql(), fx.CUSTOM_PATTERNS)} AS redacted FROM documents")(
    lambda spark, d: documents(spark, d).select(
        "doc_id", redact(_chain_text(F.col("doc_id")), fx.CUSTOM_PATTERNS).alias("redacted")))


@register("truncate_after_redact",
          "WITH b AS (SELECT doc_id, " + o.redact_sql("(text || ' password=' || CAST(doc_id AS VARCHAR))")
          + " AS r FROM documents) SELECT doc_id AS uid, substr(r, 1, 200) AS body, length(r) > 200 AS truncated "
          "FROM b")
def truncate_after_redact(spark, d):
    from ..functions.redact import redact_body
    docs = documents(spark, d).select(
        F.col("doc_id").alias("uid"), F.lit("").alias("subject"), F.lit("").alias("sender"),
        F.concat(F.col("text"), F.lit(" password="), F.col("doc_id").cast("string")).alias("body"),
        F.lit(False).alias("truncated"))
    return redact_body(docs, 200).select("uid", "body", "truncated")


# ------------------------------------------------------------------ text

register("html_to_text", f"SELECT page_id, {o.normalize_sql(o.html_to_text_sql('html'))} AS text FROM pages")(
    lambda spark, d: tables.read_table(spark, d, "pages").select(
        "page_id", normalize_text(html_to_text(F.col("html"))).alias("text")))

register("normalize_text", f"SELECT doc_id, {o.normalize_sql('text')} AS text FROM documents")(
    lambda spark, d: documents(spark, d).select("doc_id", normalize_text(F.col("text")).alias("text")))

register("normalize_conversations",
         f"SELECT conv_id, turn, {o.normalize_sql('text')} AS text FROM conversations")(
    lambda spark, d: tables.read_table(spark, d, "conversations").select(
        "conv_id", "turn", normalize_text(F.col("text")).alias("text")))

register("shorten_excerpt", f"SELECT doc_id, {o.shorten_sql('text')} AS excerpt FROM documents")(
    lambda spark, d: documents(spark, d).select("doc_id", shorten(F.col("text")).alias("excerpt")))


# ----------------------------------------------------------------- index

_TOK_CTE = (f"tok AS (SELECT folder, uid, unnest({o.terms_sql('subject')}) AS term FROM m "
            f"UNION ALL SELECT folder, uid, unnest({o.terms_sql('body')}) AS term FROM m)")

POSTINGS_SQL = (f"WITH {o.MESSAGES_CTE}, {_TOK_CTE} SELECT term, folder, uid, CAST(count(*) AS INTEGER) AS tf "
                f"FROM tok GROUP BY 1, 2, 3")
register("index_postings", POSTINGS_SQL)(
    lambda spark, d: ix.build_postings(indexed(spark, d), with_positions=False))

register("index_term_stats",
         f"WITH {o.MESSAGES_CTE}, {_TOK_CTE} SELECT term, count(DISTINCT (folder, uid)) AS df FROM tok GROUP BY 1")(
    lambda spark, d: ix.build_index(indexed(spark, d), False).term_stats())

register("index_corpus_stats",
         f"WITH {o.MESSAGES_CTE}, {_TOK_CTE} SELECT (SELECT count(*) FROM m) AS n_docs, "
         f"round((SELECT count(*) FROM tok)::DOUBLE / (SELECT count(*) FROM m), 9) AS avgdl")(
    lambda spark, d: ix.build_index(indexed(spark, d), False).corpus_stats()
    .select("n_docs", F.round("avgdl", 9).alias("avgdl")))


# ---------------------------------------------------------------- search

SEARCH_QUERIES = [
    (1, "src0", "licensed under", 10), (2, "src1", "token", 5), (3, "src2", "que elle de", 10),
    (4, "src3", "license", 10), (5, "src4", "uber", 10), (6, "src5", "der der", 10),
    (7, "src6", "the and", 20), (8, "src7", "Licensed", 3), (9, "src8", "thanedble the", 10),
    (10, "src9", "attion", 10), (11, "src10", "Ouéaux", 5), (12, "src12", "ÉLLE", 10),
]
PHRASE_QUERIES = [(21, "src0", "licensed_under", 10), (22, "src5", "der_die", 10),
                  (23, "src2", "de_la the", 10), (24, "src6", "of_the", 5)]
FALLBACK_QUERIES = [(31, "src0", "icens", 5), (32, "src1", "ensed", 10), (33, "src4", "t_e", 4),
                    (34, "src9", "ABLE ion", 10), (35, "src13", "qqqzz", 10), (36, "src2", "_", 3),
                    (37, "src3", "!!", 3)]
QSCHEMA = "query_id long, folder string, query string, limit int"


def _queries_df(spark, rows):
    return spark.createDataFrame(rows, QSCHEMA)


def _bm25_sql(rows, phrase: bool = False) -> str:
    """Ranked index hits; phrases (``a_b``) need adjacent terms in one column.

    ``rows`` is a list of (query_id, folder, query, limit) or a SQL subquery
    with those columns (``lim`` for the limit).
    """
    qv = f"({rows}) AS t" if isinstance(rows, str) else o.values_sql(rows, ["query_id", "folder", "query", "lim"])
    return f"""
WITH {o.MESSAGES_CTE},
cols AS (SELECT folder, uid, 0 AS c, {o.terms_sql('subject')} AS l FROM m
         UNION ALL SELECT folder, uid, 1 AS c, {o.terms_sql('body')} AS l FROM m),
tok AS (SELECT folder, uid, c, unnest(l) AS term, generate_subscripts(l, 1) AS p FROM cols),
len AS (SELECT folder, uid, count(*) AS l FROM tok GROUP BY 1, 2),
st AS (SELECT (SELECT count(*) FROM m) AS nn, (SELECT count(*) FROM tok)::DOUBLE / (SELECT count(*) FROM m) AS a),
qs AS (SELECT * FROM {qv}),
qt0 AS (SELECT query_id, folder, regexp_extract_all(query, {o.q(o.QTOKEN)}) AS toks FROM qs),
qt AS (SELECT query_id, folder, unnest(toks) AS tok, generate_subscripts(toks, 1) AS i FROM qt0),
qp AS (SELECT query_id, folder, i, {o.terms_sql('tok')} AS terms FROM qt),
qj AS (SELECT query_id, i, len(terms) AS k, unnest(terms) AS term, generate_subscripts(terms, 1) AS j FROM qp),
occ AS (SELECT qj.query_id, qj.i, qj.k, tok.folder, tok.uid, tok.c, tok.p - qj.j AS start
        FROM qj JOIN tok ON tok.term = qj.term),
ph AS (SELECT query_id, i, folder, uid, count(*) AS f FROM
        (SELECT query_id, i, folder, uid, c, start FROM occ GROUP BY ALL HAVING count(*) = max(k))
       GROUP BY ALL),
dn AS (SELECT query_id, i, count(*) AS n FROM ph GROUP BY ALL),
nt AS (SELECT query_id, count(*) AS k FROM qt GROUP BY 1),
s AS (SELECT ph.query_id, ph.i, ph.folder, ph.uid, ph.f, len.l, st.a, st.nn, dn.n
      FROM ph JOIN dn USING (query_id, i) JOIN len USING (folder, uid)
      JOIN qs ON qs.query_id = ph.query_id AND qs.folder = ph.folder, st),
sc AS (SELECT query_id, folder, uid, count(*) AS matched,
        round(-sum((CASE WHEN ln((nn - n + 0.5) / (n + 0.5)) <= 0 THEN 1e-6 ELSE ln((nn - n + 0.5) / (n + 0.5)) END)
          * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * l / a))), 6) AS score FROM s GROUP BY 1, 2, 3),
r AS (SELECT sc.*, row_number() OVER (PARTITION BY query_id ORDER BY score ASC, uid DESC) AS rank
      FROM sc JOIN nt USING (query_id) WHERE matched = nt.k)
SELECT r.query_id, r.folder, r.uid, r.score, r.rank FROM r JOIN qs USING (query_id) WHERE r.rank <= qs.lim
"""


def _ranked(spark, d, rows, fallback=False, with_excerpt=False):
    msgs = indexed(spark, d)
    index = ix.build_index(msgs)
    return search.search(index, msgs, _queries_df(spark, rows), score_digits=6,
                         with_excerpt=with_excerpt, fallback=fallback)


register("search_bm25", _bm25_sql(SEARCH_QUERIES))(
    lambda spark, d: _ranked(spark, d, SEARCH_QUERIES).select("query_id", "folder", "uid", "score", "rank"))

register("search_phrase", _bm25_sql(PHRASE_QUERIES))(
    lambda spark, d: _ranked(spark, d, PHRASE_QUERIES).select("query_id", "folder", "uid", "score", "rank"))


def _fallback_sql(rows) -> str:
    """Queries with no index hit: LIKE scan, ASCII case folding, newest first."""
    qv = o.values_sql(rows, ["query_id", "folder", "query", "lim"])
    lower_ascii = lambda e: f"translate({e}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"  # noqa
    return f"""
WITH {o.MESSAGES_CTE},
idx AS ({_bm25_sql(rows)}),
qs AS (SELECT * FROM {qv}),
fq AS (SELECT query_id, folder, lim, list_transform(regexp_extract_all(query, {o.q(o.QTOKEN)}), lambda t: {lower_ascii('t')}) AS toks
       FROM qs WHERE query_id NOT IN (SELECT query_id FROM idx)),
h AS (SELECT fq.query_id, fq.lim, m.* FROM m JOIN fq USING (folder)
      WHERE len(fq.toks) > 0 AND list_bool_and(list_transform(fq.toks,
            lambda t: {lower_ascii('m.subject')} LIKE '%' || t || '%' OR {lower_ascii('m.body')} LIKE '%' || t || '%'))),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY uid DESC) AS rank FROM h)
SELECT query_id, folder, uid, {o.redact_sql('subject')} AS subject, {o.redact_sql('sender')} AS sender, date,
       {o.redact_sql(o.shorten_sql('body'))} AS excerpt, CAST(0.0 AS DOUBLE) AS score, false AS is_deleted,
       false AS body_index_blocked, CAST(NULL AS VARCHAR) AS block_reason, rank
FROM r WHERE rank <= lim
"""


register("search_fallback", _fallback_sql(FALLBACK_QUERIES))(
    lambda spark, d: _ranked(spark, d, FALLBACK_QUERIES, fallback=True, with_excerpt=True)
    .filter(F.col("score") == 0.0))


def _switch_sql(rows) -> str:
    base = _fallback_sql(rows)
    return (f"WITH a AS ({_bm25_sql(rows)}), b AS ({base}) "
            f"SELECT query_id, folder, uid, score, rank FROM a UNION ALL "
            f"SELECT query_id, folder, uid, score, rank FROM b")


SWITCH_QUERIES = SEARCH_QUERIES[:4] + FALLBACK_QUERIES[:4]

register("search_switch", _switch_sql(SWITCH_QUERIES))(
    lambda spark, d: _ranked(spark, d, SWITCH_QUERIES, fallback=True)
    .select("query_id", "folder", "uid", "score", "rank"))

def benchmark_queries(spark, d):
    """One query per ``benchmark`` passage, whole, in folder src<item_id mod 20>."""
    b = tables.read_table(spark, d, "benchmark")
    return b.select(F.col("item_id").alias("query_id"),
                    F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("folder"),
                    F.col("text").alias("query"),
                    F.lit(10).alias("limit"))


BENCH_QUERIES_SQL = (f"SELECT item_id AS query_id, 'src' || CAST(item_id % 20 AS VARCHAR) AS folder, "
                     f"text AS query, 10 AS lim "
                     f"FROM benchmark")


@register("search_batch", _bm25_sql(BENCH_QUERIES_SQL))
def search_batch(spark, d):
    msgs = indexed(spark, d)
    return search.search(ix.build_index(msgs), msgs, benchmark_queries(spark, d), score_digits=6,
                         with_excerpt=False, fallback=False).select("query_id", "folder", "uid", "score", "rank")



def _excerpt_sql(rows) -> str:
    """Ranked hits with their excerpt, and the fallback rows, redacted.

    An excerpt is 18 tokens of the body: of all runs of 18 tokens that end with
    a hit, the earliest with the most distinct query terms; from it the shortest
    end part that still has them all, with the room left shared out before and
    behind, one more behind.
    """
    qv = rows if isinstance(rows, str) else "SELECT * FROM " + o.values_sql(rows, ["query_id", "folder", "query", "lim"])
    return f"""
WITH {o.MESSAGES_CTE}, a AS ({_bm25_sql(rows)}), b AS ({_fallback_sql(rows)}), qs AS ({qv}),
t AS (SELECT query_id, list_distinct(flatten(list_transform(regexp_extract_all(query, {o.q(o.QTOKEN)}), lambda x: {o.terms_sql('x')}))) AS terms FROM qs),
w AS (SELECT a.*, m.subject, m.sender, m.date, m.body, t.terms, regexp_extract_all(coalesce(m.body, ''), {o.q(o.PIECE)}) AS pieces
      FROM a JOIN m USING (folder, uid) JOIN t USING (query_id)),
x AS (SELECT query_id, folder, uid, terms, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS i FROM w),
h AS (SELECT query_id, folder, uid, i, {o.terms_sql('piece')}[1] AS term FROM x WHERE list_contains(terms, {o.terms_sql('piece')}[1])),
l AS (SELECT e.query_id, e.folder, e.uid, e.i AS e, h.term, max(h.i) AS i FROM h e JOIN h USING (query_id, folder, uid)
      WHERE h.i BETWEEN e.i - 17 AND e.i GROUP BY ALL),
v AS (SELECT query_id, folder, uid, e, count(*) AS n, min(i) AS f FROM l GROUP BY query_id, folder, uid, e),
c AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY query_id, folder, uid ORDER BY n DESC, e) = 1),
p AS (SELECT w.*, len(pieces) AS n, CASE WHEN c.e IS NULL THEN 0 ELSE greatest(0, least(len(pieces) - 18, c.f - 1 - (18 - (c.e - c.f + 1)) // 2)) END AS s
      FROM w LEFT JOIN c USING (query_id, folder, uid)),
e AS (SELECT *, CASE WHEN n = 0 THEN body ELSE
        (CASE WHEN s > 0 THEN '...' ELSE regexp_extract(body, {o.q(o.LEAD)}) END)
        || (CASE WHEN s + 18 < n THEN regexp_replace(array_to_string(pieces[s + 1 : s + 18], ''), {o.q(o.GAP)}, '') || '...'
            ELSE array_to_string(pieces[s + 1 : s + 18], '') END) END AS excerpt FROM p)
SELECT query_id, folder, uid, {o.redact_sql('subject')} AS subject, {o.redact_sql('sender')} AS sender, date,
       {o.redact_sql(o.shorten_sql('excerpt'))} AS excerpt, score, false AS is_deleted, false AS body_index_blocked,
       CAST(NULL AS VARCHAR) AS block_reason, rank FROM e
UNION ALL SELECT query_id, folder, uid, subject, sender, date, excerpt, score, is_deleted, body_index_blocked, block_reason, rank FROM b
"""


register("search_snippet", _excerpt_sql(SEARCH_QUERIES + PHRASE_QUERIES))(
    lambda spark, d: _ranked(spark, d, SEARCH_QUERIES + PHRASE_QUERIES, fallback=True, with_excerpt=True))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked, redacted search with excerpts and fallback, over the whole corpus."""
    return _ranked(spark, sf_dir, SEARCH_QUERIES + PHRASE_QUERIES + FALLBACK_QUERIES,
                   fallback=True, with_excerpt=True)


register("search_redacted", _excerpt_sql(SEARCH_QUERIES + PHRASE_QUERIES + FALLBACK_QUERIES))(flagship)
