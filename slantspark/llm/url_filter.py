"""URL filter: a blocked Bloom filter over listed canonical URLs, then an exact hash join (DataFrame functions only).

A listed entry is a canonical (host, path) prefix with a verdict; it covers its host, all subdomains and every path that
starts with its path.  Each URL gives its candidate entries: every suffix of its host at a dot, times every prefix of its
path whose length occurs in the list.  The filter is a table of 64-bit blocks (one per ``block_keys`` listed keys); a key
sets four bits of one block.  Candidates whose block holds all four bits go on to an exact join on (host, path), which
removes the filter's false positives; the longest entry left decides.  URLs without one get ``default``.

Defined results: a null URL or one without ``://`` has empty host and path, no rule and the default verdict.  A host
without dots has itself as its one suffix.  Repeated URLs are judged row by row.  An entry listed twice counts once; with
different verdicts, block wins.  Entries with a null part are not used; an empty list gives the default everywhere.  Other columns of
the input do not matter; only ``id_col`` and ``url_col`` are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    rest = F.substr(url, F.instr(url, "://") + F.lit(3))
    return F.when(F.instr(url, "://") > 0, F.translate(F.regexp_extract(rest, r"\A([^/?#]*)", 1), UPPER, LOWER)).otherwise(F.lit(""))


def url_path(url: Column) -> Column:
    rest = F.substr(url, F.instr(url, "://") + F.lit(3))
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def _key(host: Column, path: Column) -> Column:
    """The canonical key; a host never holds a slash, so the first slash parts the two."""
    return F.concat(host, F.lit("/"), path)


def _bits(h: Column) -> Column:
    """Four of 64 bits, from the upper half of the key's hash."""
    out = None
    for k in range(4):
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 32 + 6 * k).bitwiseAND(F.lit(63)).cast("int"))
        out = bit if out is None else out.bitwiseOR(bit)
    return out


def bloom_blocks(keys: DataFrame, key: str, n_blocks: int) -> DataFrame:
    """(block, mask): the 64-bit block of each block number that holds a key."""
    h = F.xxhash64(F.col(key))
    return (keys.select(F.pmod(h, F.lit(n_blocks)).alias("block"), _bits(h).alias("bits"))
            .groupBy("block").agg(F.bit_or("bits").alias("mask")))


def judge_urls(pages: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow",
               block_keys: int = 4, broadcast_rows: int = 500_000) -> DataFrame:
    """Rows (id, host, path, rule, verdict) for every URL.

    ``listed``: (host, path, verdict), verdict allow or block.  The blocks (24 bytes each) and the list are broadcast only
    while the list has at most ``broadcast_rows`` entries (counted); beyond that both joins are shuffled by hash.
    """
    entries = (listed.where(F.col("host").isNotNull() & F.col("path").isNotNull())
               .groupBy(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"))
               .agg(F.max(F.when(F.col("verdict") == "block", 1).otherwise(0)).alias("blocks"))
               .withColumn("key", _key(F.col("rule_host"), F.col("rule_path"))))
    facts = entries.agg(F.count("*").alias("n"), F.collect_set(F.length("rule_path")).alias("lengths")).first()
    hint = F.broadcast if facts["n"] <= broadcast_rows else (lambda df: df)
    n_blocks = max(1, -(-facts["n"] // block_keys))
    blocks = hint(bloom_blocks(entries, "key", n_blocks))
    lengths = sorted(facts["lengths"]) or [0]

    rows = pages.select(F.col(id_col).alias("page_id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    # Distinct (host, path) first: a hot host or page is looked up once, and the verdict is joined back by it.
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    wanted = F.flatten(F.transform(F.col("suffixes"), lambda s: F.transform(
        F.filter(F.array(*[F.lit(x) for x in lengths]), lambda n: n <= F.length("path")), lambda n: _key(s, F.substring(F.col("path"), F.lit(1), n)))))
    urls = rows.select("host", "path").distinct().withColumn("suffixes", suffixes)
    tried = urls.select("host", "path", F.explode(wanted).alias("key")).withColumn("h", F.xxhash64("key"))
    passed = (tried.withColumn("block", F.pmod("h", F.lit(n_blocks))).join(blocks, "block")
              .where(F.col("mask").bitwiseAND(_bits(F.col("h"))) == _bits(F.col("h"))).select("host", "path", "key"))
    exact = passed.join(hint(entries), "key")
    best = (exact.groupBy("host", "path")
            .agg(F.max(F.struct(F.length("key").alias("size"), F.length("rule_host").alias("host_size"), F.col("key").alias("rule"),
                                F.concat("rule_host", "rule_path").alias("shown"), "blocks")).alias("best"))
            .select(F.col("host").alias("h1"), F.col("path").alias("p1"), F.col("best.shown").alias("rule"), F.col("best.blocks").alias("blocks")))
    return (rows.join(best, (F.col("host") == F.col("h1")) & (F.col("path") == F.col("p1")), "left")
            .select("page_id", "host", "path", "rule",
                    F.when(F.col("blocks") == 1, F.lit("block")).when(F.col("blocks") == 0, F.lit("allow")).otherwise(F.lit(default)).alias("verdict")))
