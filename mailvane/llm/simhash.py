"""SimHash near-duplicate groups by multi-index hashing.

Defined results: a null or blank text has fingerprint zero and is linked like
any other; a text with fewer words than the shingle length is one shingle;
repeated rows stay (one result row per input row); an empty table gives an
empty result; a null id never is the smallest of a group, and a group of null
ids only has a null component. Other columns of the input are not read.
"""

from __future__ import annotations

from itertools import combinations, islice, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import materialise, text_batches

SEED = 42
#: Shingles hashed at a time, so that memory does not follow a text's length.
CHUNK = 65_535
#: Members of one table bucket that are verified pair by pair; larger buckets go through ``_ball_links``.
BUCKET = 64


def simhash64(text: str | None, width: int) -> int:
    """Unsigned fingerprint of one text: bit set where over half of the shingle hashes have it."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < width:
        shingles = iter([b" ".join(words)])
    else:
        shingles = map(b" ".join, zip(*(islice(words, i, None) for i in range(width))))
    total, ones = 0, np.zeros(64, dtype=np.int64)
    while h := b"".join(map(xxhash.xxh64_digest, islice(shingles, CHUNK), repeat(SEED))):
        bits = np.unpackbits(np.frombuffer(h, dtype=np.uint8).reshape(-1, 8), axis=1)
        ones += np.add.reduce(bits, axis=0, dtype=np.uint16)
        total += len(bits)
    return int.from_bytes(np.packbits(ones * 2 > total).tobytes(), "big")


def fingerprint(text: Column, width: int = 3) -> Column:
    """The 64-bit fingerprint of a text column as a signed long."""
    @pandas_udf("long")
    def f(s: pd.Series) -> pd.Series:
        return pd.Series(np.array([simhash64(t, width) for t in s], dtype=np.uint64).view(np.int64))

    return f(text)


def fingerprint_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def _masks(width: int, radius: int) -> list[int]:
    """Every mask of at most ``radius`` bits within ``width`` bits."""
    return [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]


def _near(a: Column, b: Column, max_bits: int) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= max_bits


def links(fps: DataFrame, max_bits: int = 2) -> DataFrame:
    """Links (a, b) that join exactly the distinct fingerprints ``fp`` within ``max_bits`` of each other.

    The fingerprint has two 32-bit segments. By the pigeonhole principle two
    fingerprints within ``max_bits`` are within ``r0`` in the first or within
    ``r1`` in the second, with r0 + r1 = max_bits - 1. Each segment is a table
    from its 32-bit value to fingerprints; every fingerprint looks up the small
    Hamming ball around its own segment and the full distance of each match is
    verified. A ball step is taken from one end of a pair only (where the lowest
    flipped bit is clear).

    A bucket with more than BUCKET members would give pairs with the square of
    its size. Its members and the fingerprints that look it up are linked by
    ``_ball_links`` instead, which is exact and linear.
    """
    if max_bits not in (0, 2, 4):
        raise ValueError("max_bits must be 0, 2 or 4")
    if max_bits == 0:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    r0 = max_bits // 2
    radius = (r0, max_bits - 1 - r0)
    parts = F.array(F.struct(F.lit(0).alias("seg"), F.shiftrightunsigned("fp", 32).alias("key")),
                    F.struct(F.lit(1).alias("seg"), F.col("fp").bitwiseAND(0xFFFFFFFF).alias("key")))
    entries = fps.select("fp", F.inline(parts))
    sized = entries.groupBy("seg", "key").agg(F.count("*").alias("members"))
    balls = F.when(F.col("seg") == 0, F.array(*[F.lit(m).cast("long") for m in _masks(32, radius[0])])).otherwise(
        F.array(*[F.lit(m).cast("long") for m in _masks(32, radius[1])]))
    lowest = F.col("mask").bitwiseAND(-F.col("mask"))
    probes = (entries.select("fp", "seg", "key", F.explode(balls).alias("mask"))
              .filter(F.col("key").bitwiseAND(lowest) == 0)
              .select("seg", F.col("key").bitwiseXOR(F.col("mask")).alias("key"), F.col("fp").alias("a"),
                      (F.col("mask") == 0).alias("own")))
    cold = entries.join(sized.filter(F.col("members") <= BUCKET), ["seg", "key"])
    pairs = (probes.join(cold, ["seg", "key"])
             .filter((~F.col("own") | (F.col("a") < F.col("fp"))) & _near(F.col("a"), F.col("fp"), max_bits))
             .select("a", F.col("fp").alias("b")))
    crowded = (probes.join(sized.filter(F.col("members") > BUCKET), ["seg", "key"], "left_semi")
               .select(F.col("a").alias("fp")).distinct())
    return pairs.unionByName(_ball_links(crowded, max_bits))


def _ball_links(fps: DataFrame, max_bits: int) -> DataFrame:
    """Links between all fingerprints within an even ``max_bits``, without pairs.

    Two fingerprints are within 2r bits exactly if their balls of radius r share
    a centre, and all that share a centre are within 2r of each other. Linking
    each to the smallest at every centre keeps every group connected. No centre
    has more members than a ball has points.
    """
    masks = [m - (1 << 64) if m >> 63 else m for m in _masks(64, max_bits // 2)]
    at = fps.select("fp", F.explode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("mask")).select(
        F.col("fp").bitwiseXOR(F.col("mask")).alias("centre"), "fp")
    least = at.groupBy("centre").agg(F.min("fp").alias("b"), F.count("*").alias("n")).filter("n > 1")
    return at.join(least, "centre").filter(F.col("fp") != F.col("b")).select(F.col("fp").alias("a"), "b").distinct()


def connected(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b) but the roots; root is the smallest node reachable.

    Alternates large-star and small-star steps until the links no longer change.
    Each step is a grouped minimum and a join; each round is written to the
    shared folder. Only a row count and a checksum reach the driver.
    """
    e = edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    e = materialise(e.distinct(), name)
    seen = None
    while (mark := e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()) != seen:
        seen = mark
        if not mark[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(least, "u").filter(F.col("v") > F.col("u"))
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialise(small.unionByName(down.select("u", F.col("m").alias("v"))).distinct(), name)
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _rooted(docs: DataFrame, width: int, max_bits: int) -> DataFrame:
    """(doc_id, fp, root, component_id) of every row of ``docs``; ``root`` is the group's smallest fingerprint."""
    text_batches(docs)
    fps = materialise(docs.select("doc_id", fingerprint(F.col("text"), width).alias("fp")), "simhash")
    nodes = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("first_doc")), "simhash-nodes")
    roots = connected(links(nodes.select("fp"), max_bits), "simhash-links")
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        "fp", "first_doc", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    named = rooted.join(smallest, "root").select("fp", "root", "component_id")
    return fps.join(named, "fp").select("doc_id", "fp", "root", "component_id")


def simhash_groups(docs: DataFrame, width: int = 3, max_bits: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs`` (doc_id, text).

    Copies collapse to one fingerprint before any search; links and components
    work on distinct fingerprints only.
    """
    return _rooted(docs, width, max_bits).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, width: int = 3, max_bits: int = 2) -> DataFrame:
    """The rows of ``docs`` that stay: one row of each group, of the smallest id in it.

    Where an id stands on rows with different texts, the texts are grouped like
    any others: each group keeps a row of its own. Documents without an id
    cannot be told apart by one: of a group of them alone, one row stays. All
    columns of ``docs`` come back unchanged.
    """
    groups = materialise(_rooted(docs, width, max_bits), "simhash-groups")
    kept = (groups.filter(F.col("doc_id") == F.col("component_id")).groupBy("root")
            .agg(F.min("doc_id").alias("_kept_id"), F.min("fp").alias("_kept_fp")).drop("root"))
    several = groups.filter("doc_id is not null").groupBy("doc_id").agg((F.min("fp") != F.max("fp")).alias("_several"))
    kept = kept.groupBy("_kept_id").agg(F.collect_set("_kept_fp").alias("_kept_fps")).join(
        several.withColumnRenamed("doc_id", "_kept_id"), "_kept_id")
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_id")).filter("_id is not null")

    def one(of: DataFrame, *by: str) -> DataFrame:
        return of.groupBy(*by).agg(F.min_by("_row", F.xxhash64("_row.text")).alias("_row")).select("_row.*")

    # the fingerprint is taken again only of rows whose id has several texts
    text_batches(docs)
    named = rows.join(kept, F.col("_id") == F.col("_kept_id")).withColumn("_fp", fingerprint(F.when(F.col("_several"), F.col("_row.text")), width))
    named = named.filter(~F.col("_several") | F.array_contains("_kept_fps", F.col("_fp")))
    named = one(named.withColumn("_fp", F.when(F.col("_several"), F.col("_fp"))), "_id", "_fp")
    nameless = one(docs.filter("doc_id is null").select(F.struct("*").alias("_row"), fingerprint(F.col("text"), width).alias("_fp"))
                   .join(groups.filter("component_id is null").select("fp", "root").distinct(), F.col("_fp") == F.col("fp")), "root")
    return named.unionByName(nameless)
