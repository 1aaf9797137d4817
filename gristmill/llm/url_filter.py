"""URL filter: a blocked Bloom filter over listed canonical URLs, then an exact hash join.

A list entry is a host and a path, ``example.com`` + ``/en/``; it covers that host, its subdomains and
every path that starts with it. The canonical form of an entry is host + path as one string. A URL is
covered by an entry exactly if the entry equals one of the URL's own (host suffix, path prefix) pairs,
so each URL is expanded into these few keys, keys that the Bloom filter has not seen are dropped
before anything is shuffled, and the rest meet the list in an equality join, which removes the
filter's false positives. Nothing but column expressions and joins is used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, sized

#: Words of 64 bits in a block; a key sets one bit in each.
WORDS = 8
#: Most blocks of a filter: 2^20 blocks of 64 bytes are 64 MB, small enough to go to every executor.
MOST_BLOCKS = 1 << 20
KEYS_A_BLOCK = 32


def host_of(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; '' if there is none."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; '' if there is no ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def bloom_blocks(keys: DataFrame, n: int) -> tuple[DataFrame, int]:
    """The filter of column ``key`` as a table of (block, w0 .. w7), and its number of blocks.

    Its size is bounded whatever the list: past ``MOST_BLOCKS`` blocks only the share of false
    positives grows, which the exact join removes.
    """
    blocks = 1
    while blocks < MOST_BLOCKS and blocks * KEYS_A_BLOCK < n:
        blocks *= 2
    bits = [F.bit_or(F.expr(f"shiftleft(1L, cast({_place(w)} as int))")).alias(f"w{w}") for w in range(WORDS)]
    return keys.select("key").groupBy(_block(blocks)).agg(*bits), blocks


def _block(blocks: int) -> Column:
    return F.expr(f"pmod(xxhash64(key), {blocks}L)").alias("block")


def _place(word: int) -> str:
    return f"(shiftright(xxhash64(key, 1), {6 * word}) & 63)"


def candidate_keys(host: Column, path: Column, labels: Column, lengths: Column) -> Column:
    """The host + path keys that could cover this URL: host suffixes of at most ``labels`` labels, path prefixes of
    every one of the ``lengths``."""
    parts = F.split(host, r"\.")
    suffixes = F.transform(
        F.sequence(F.greatest(F.lit(1), F.size(parts) - labels + 1), F.size(parts)),
        lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."),
    )
    prefixes = F.transform(F.filter(lengths, lambda n: n <= F.length(path)), lambda n: F.substring(path, F.lit(1), n))
    return F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat(h, p))))


def judge_urls(pages: DataFrame, listed: DataFrame, *, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(id_col, host, path, rule, verdict) for every row of ``pages``.

    ``listed`` has host, path and verdict. An entry covers every path that begins with its own, so an
    empty path covers all and ``/private`` also ``/private-x``; one whose path does not begin with
    ``/`` covers nothing. The longest entry that covers a URL gives rule and verdict; an entry listed
    with two verdicts takes the lesser, so ``allow``. Every length that a listed path has is tried, so
    the keys of a URL are its host suffixes times these lengths. URLs that no entry covers get a null
    rule and ``default``. Null or relative URLs have empty host and path, which no entry covers.
    Repeated rows stay repeated; null ids are kept; other columns are not looked at. An empty list
    gives every page ``default``. The pages are shuffled once, by id and URL, pre-aggregated.
    """
    rules = (
        listed.select(ascii_lower(F.col("host")).alias("h"), F.col("path").alias("p"), F.col("verdict").alias("rule_verdict"))
        .filter("h <> '' and (p = '' or p like '/%') and rule_verdict is not null")
        .groupBy(F.concat("h", "p").alias("key"))
        .agg(F.min("rule_verdict").alias("rule_verdict"), F.max(F.length("p")).alias("chars"), F.sum(F.octet_length("h") + F.octet_length("p")).alias("bytes"), F.max(F.size(F.split("h", r"\."))).alias("labels"))
    )
    n, texts, lengths, labels = rules.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0)), F.array_sort(F.collect_set("chars")), F.coalesce(F.max("labels"), F.lit(1))).first()
    bloom, blocks = bloom_blocks(rules, n)
    urls = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).select("id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    keys = candidate_keys(F.col("host"), F.col("path"), F.lit(labels), F.lit(lengths) if lengths else F.array().cast("array<int>"))
    own = F.array(F.lit(None).cast("string"))  # one row of each page always passes
    tried = urls.withColumn("key", F.explode(F.concat(own, F.when(F.col("host") != "", keys).otherwise(F.array().cast("array<string>"))))).withColumn("block", F.when(F.col("key").isNotNull(), _block(blocks)))
    seen = " and ".join(f"shiftright(w{w}, cast({_place(w)} as int)) & 1 = 1" for w in range(WORDS))
    passed = tried.join(F.broadcast(bloom), "block", "left").filter(F.expr(f"key is null or ({seen})")).drop("block", *(f"w{w}" for w in range(WORDS)))
    exact = passed.join(sized(rules.select("key", "rule_verdict"), n, texts), "key", "left").filter("key is null or rule_verdict is not null")
    best = exact.groupBy("id", "url", "host", "path").agg(
        F.count_if(F.col("key").isNull()).alias("times"),
        F.max_by(F.struct("key", "rule_verdict"), F.when(F.col("key").isNotNull(), F.struct(F.length("key"), "key"))).alias("best"),
    )
    return best.select(
        F.col("id").alias(id_col), "host", "path", F.col("best.key").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"),
        F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy"),
    ).drop("copy")
