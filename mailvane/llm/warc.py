"""Fixity audit of WARC replicas by Merkle trees over offset ranges.

Each record is hashed with its place. Records that begin in one range of
2**LEAF_BITS bytes of a file form a leaf; 2**FAN_BITS neighbouring ranges form
the node above, up to one root per file. Digests are the records' SHA-256. Two replicas' roots are compared, and
only children of nodes that differ are compared on the next level, down to the
records. A node's group is bounded: by the fan-out, and at the leaves by the
least size of a record.

Defined results: a record whose bytes differ at the same place is ``changed``;
one of the first replica only is ``missing``, of the second only ``extra``;
records repeated at one place are compared as a bag, by their sorted hashes;
null bytes count as empty; a null file or offset is a place like any other;
equal replicas, and two empty ones, give no row; a page with null page_id goes
to a file by the hash of its content. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

LEAF_BITS, FAN_BITS = 16, 8
#: Pages of one file.
PAGES = 1_000
#: Bits of the offsets under one root; a longer file has several roots, which are all compared.
OFFSET_BITS = 40


def _record(url: Column, html: Column, page_id: Column) -> Column:
    """The bytes of a response record (as text; UTF-8 gives the bytes)."""
    body = F.coalesce(html, F.lit(""))
    return F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")),
                    F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Length: "),
                    F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def records_of_pages(pages: DataFrame) -> DataFrame:
    """(file, page_id, bytes): pages as records of files of PAGES neighbouring ids each."""
    file = F.coalesce(F.expr(f"concat('pages-', cast(page_id div {PAGES} as string))"),
                      F.concat(F.lit("pages-none-"), F.pmod(F.xxhash64("url", "html"), F.lit(4096)).cast("string")))
    return pages.select(file.alias("file"), "page_id", _record(F.col("url"), F.col("html"), F.col("page_id")).alias("bytes"))


def digest(bytes_: Column) -> Column:
    """(length, digest) of a record."""
    b = F.coalesce(bytes_, F.lit("")).cast("binary")
    return F.struct(F.octet_length(b).cast("long").alias("length"), F.sha2(b, 256).alias("digest"))


def place(hashed: DataFrame) -> DataFrame:
    """``hashed`` (file, page_id, length, digest, ...) with the offset of each record in its file, in order of id and digest."""
    order = Window.partitionBy("file").orderBy("page_id", "digest").rowsBetween(Window.unboundedPreceding, -1)
    return hashed.withColumn("offset", F.coalesce(F.sum("length").over(order), F.lit(0)).cast("long"))


def replicas_of_pages(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two replicas (file, offset, length, digest) of all pages; the second as bad storage would leave it.

    By page_id modulo 997, some records of the second have one byte changed (3),
    are cut (5), lost (7) or found once more at a place of their own (11).
    Pages are read, and hashed, once; only lengths and hashes are shuffled.
    """
    rule = F.coalesce(F.pmod("page_id", F.lit(997)), F.lit(0))
    bad = F.when(rule == 3, F.expr("concat(substring(bytes, 1, 10), '~', substring(bytes, 12))")).when(
        rule == 5, F.expr("substring(bytes, 1, length(bytes) - 4)"))
    rows = records_of_pages(pages).select("file", "page_id", rule.alias("rule"), digest(F.col("bytes")).alias("a"),
                                          F.when(bad.isNotNull(), digest(bad)).alias("b"))
    rows = rows.select("file", "page_id", "rule", "a.length", "a.digest", F.coalesce("b", "a").alias("b"))
    rows = materialise(place(rows), "warc-replicas")
    second = rows.filter("rule != 7").select("file", F.explode(F.when(F.col("rule") == 11, F.array(F.col("offset"), F.col("offset") + 1)).otherwise(
        F.array("offset"))).alias("offset"), "b.length", "b.digest")
    return rows.select("file", "offset", "length", "digest"), second


def _places(records: DataFrame) -> DataFrame:
    """One row per place (file, offset): records repeated there as a bag."""
    return records.groupBy("file", "offset").agg(F.sum("length").alias("length"), F.array_join(F.array_sort(F.collect_list("digest")), "+").alias("digest"))


def _level(nodes: DataFrame, bits: int) -> DataFrame:
    """(file, node, hash) of the nodes ``bits`` bits above: a hash over the children in order of offset."""
    kids = F.array_sort(F.collect_list(F.struct("node", "hash")))
    up = nodes.groupBy("file", F.shiftright("node", bits).alias("up")).agg(kids.alias("kids"))
    line = F.transform("kids", lambda k: F.concat_ws(":", F.coalesce(k["node"].cast("string"), F.lit("")), k["hash"]))
    return up.select("file", F.col("up").alias("node"), F.sha2(F.concat_ws("\n", line), 256).alias("hash"))


def tree(records: DataFrame) -> list[DataFrame]:
    """Levels from the records' places (first) to one root per file (last), each (file, node, hash)."""
    base = materialise(_places(records), "warc-records")
    levels = [base.select("file", F.col("offset").alias("node"), F.concat_ws(":", F.col("length").cast("string"), "digest").alias("hash"), "length", "digest")]
    bits, step = 0, LEAF_BITS
    while bits < OFFSET_BITS:
        step = min(step, OFFSET_BITS - bits)
        levels.append(materialise(_level(levels[-1], step), "warc-level"))
        bits, step = bits + step, FAN_BITS
    return levels


def _differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """Nodes that are not the same in both."""
    x, y = a.select("file", "node", F.col("hash").alias("h")), b.select(F.col("file").alias("f"), F.col("node").alias("n"), F.col("hash").alias("g"))
    same_place = F.col("file").eqNullSafe(F.col("f")) & F.col("node").eqNullSafe(F.col("n"))
    differ = x.join(y, same_place, "full").filter(~F.col("h").eqNullSafe(F.col("g")))
    here = F.col("h").isNotNull()
    return differ.select(F.when(here, F.col("file")).otherwise(F.col("f")).alias("file"), F.when(here, F.col("node")).otherwise(F.col("n")).alias("node"))


def audit(first: DataFrame, second: DataFrame) -> DataFrame:
    """(file, offset, kind, first_length, first_sha256, second_length, second_sha256) of every place that differs.

    ``first`` and ``second`` are replicas (file, offset, length, digest).
    """
    one, two = tree(first), tree(second)
    shifts = _shifts(len(one))
    bad = _differing(one[-1], two[-1])
    for level in range(len(one) - 2, -1, -1):
        bad = bad.select(F.col("file").alias("bad_file"), F.col("node").alias("bad_node"))

        def below(nodes: DataFrame) -> DataFrame:
            inside = F.col("file").eqNullSafe(F.col("bad_file")) & F.shiftright("node", shifts[level]).eqNullSafe(F.col("bad_node"))
            return nodes.join(bad, inside, "left_semi")

        a, b = below(one[level]), below(two[level])
        bad = _differing(a, b) if level else bad
    a, b = (t.select(F.struct("file", "node").alias(f"{p}place"), F.col("length").cast("long").alias(f"{p}_length"), F.col("digest").alias(f"{p}_sha256"))
            for t, p in ((a, "first"), (b, "second")))
    found = a.join(b, F.col("firstplace") == F.col("secondplace"), "full").filter(
        ~(F.col("first_sha256").eqNullSafe(F.col("second_sha256")) & F.col("first_length").eqNullSafe(F.col("second_length"))))
    place = F.coalesce("firstplace", "secondplace")
    kind = F.when(F.col("first_sha256").isNull(), "extra").when(F.col("second_sha256").isNull(), "missing").otherwise("changed")
    return found.select(place["file"].alias("file"), place["node"].alias("offset"), kind.alias("kind"),
                        "first_length", "first_sha256", "second_length", "second_sha256")


def _shifts(levels: int) -> list[int]:
    """Bits between each level and the one above."""
    out, bits, step = [], 0, LEAF_BITS
    while len(out) < levels - 1:
        step = min(step, OFFSET_BITS - bits)
        out.append(step)
        bits, step = bits + step, FAN_BITS
    return out


ORACLE_SQL = f"""
WITH r AS (SELECT 'pages-' || CAST(page_id // {PAGES} AS VARCHAR) AS file, page_id, page_id % 997 AS rule,
  replace('WARC/1.0@WARC-Type: response@WARC-Record-ID: <urn:page:', '@', chr(13) || chr(10)) || CAST(page_id AS VARCHAR)
  || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: '
  || CAST(octet_length(encode(coalesce(html, ''))) AS VARCHAR) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '')
  || chr(13) || chr(10) || chr(13) || chr(10) AS b FROM pages),
h AS (SELECT file, page_id, rule, b, octet_length(encode(b)) AS len, sha256(b) AS sha FROM r),
p AS (SELECT *, CAST(coalesce(sum(len) OVER (PARTITION BY file ORDER BY page_id, sha ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos FROM h),
d AS (SELECT *, CASE WHEN rule = 3 THEN substr(b, 1, 10) || '~' || substr(b, 12) ELSE substr(b, 1, length(b) - 4) END AS bad FROM p)
SELECT file, pos AS "offset", 'changed' AS kind, CAST(len AS BIGINT) AS first_length, sha AS first_sha256,
  CAST(octet_length(encode(bad)) AS BIGINT) AS second_length, sha256(bad) AS second_sha256 FROM d WHERE rule IN (3, 5)
UNION ALL SELECT file, pos, 'missing', CAST(len AS BIGINT), sha, NULL, NULL FROM d WHERE rule = 7
UNION ALL SELECT file, pos + 1, 'extra', NULL, NULL, CAST(len AS BIGINT), sha FROM d WHERE rule = 11
"""
