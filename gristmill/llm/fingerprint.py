"""Document fingerprints by winnowing.

A text's tokens are its runs of letters and digits, lower-cased, in pieces of at most ``PIECE``
characters. The rolling hash of every ``K`` tokens in a row is the polynomial of their own hashes,
modulo a prime; in every ``WINDOW`` hashes in a row the least is chosen, the rightmost of equals, and
kept with its position. Two texts that share ``WINDOW + K - 1`` tokens in a row share a chosen gram.
The rolling hash decides between grams of a window alone; a chosen gram is named by 64 bits made of its
tokens' 64-bit hashes, so that a name stands for one passage in a corpus of any size. Column expressions only.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import let, shuffle_partitions

PIECE, K, WINDOW = 8, 4, 8
TOKEN = r"[\p{L}\p{N}]{1,%d}" % PIECE
#: The rolling hash's prime modulus, the greatest below 2^32, and its base; (base^2) x modulus stays below 2^63.
PRIME, BASE = (1 << 32) - 5, 8191
#: Bits of a gram's position, as many as an array's places need. While a window is compared a gram is one number, its
#: rolling hash above its position counted down: the least number is the least hash at its rightmost place.
PLACE_BITS = 31
_PLACES = (1 << PLACE_BITS) - 1
GRAMS = "array<struct<place:int,name:bigint>>"


def rolling(h: Column) -> Column:
    """The hash of every K in a row of at least K token hashes, h[i] b^3 + h[i+1] b^2 + h[i+2] b + h[i+3]: each is
    made of the hashes of its two halves, and every half serves two grams."""
    pair = F.transform(F.sequence(F.lit(0), F.size(h) - 2), lambda i: F.pmod(F.get(h, i) * BASE + F.get(h, i + 1), F.lit(PRIME)))
    return let(pair, lambda p: F.transform(F.sequence(F.lit(0), F.size(p) - 3), lambda i: F.pmod(F.get(p, i) * (BASE * BASE) + F.get(p, i + 2), F.lit(PRIME))))


def chosen(grams: Column) -> Column:
    """The positions of the grams that winnowing chooses by their rolling hashes, in order."""
    packed = F.transform(grams, lambda x, i: F.shiftleft(x, PLACE_BITS).bitwiseOR(F.lit(_PLACES) - i))

    def lows(p):
        least = F.transform(F.sequence(F.lit(1), F.size(p) - WINDOW + 1), lambda i: F.array_min(F.slice(p, i, WINDOW)))
        return F.when(F.size(p) >= WINDOW, F.array_distinct(least)).otherwise(F.array(F.array_min(p)))

    return F.transform(let(packed, lows), lambda x: (F.lit(_PLACES) - x.bitwiseAND(_PLACES)).cast("int"))


def winnow(text: Column) -> Column:
    """The chosen grams of a text in order of position, as (place, name).

    Fewer than K tokens make one gram; a text without any token is a token itself; an empty or null
    text has no grams. Fewer grams than a window make one window.
    """
    tokens = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    gram = lambda place, name: F.struct(place.alias("place"), name.alias("name"))
    one = lambda name: F.array(gram(F.lit(0), name))
    named = lambda t: lambda i: gram(i, F.xxhash64(*[F.get(t, i + j) for j in range(K)]))
    places = lambda t: let(F.transform(t, lambda x: F.pmod(x, F.lit(PRIME))), lambda h: chosen(rolling(h)))
    many = lambda t: F.transform(places(t), named(t))
    grams = lambda t: F.when(F.size(t) >= K, many(t)).when(F.size(t) > 0, one(F.xxhash64(t))).otherwise(one(F.xxhash64(text)))
    return F.when(F.length(text) > 0, let(F.transform(tokens, lambda t: F.xxhash64(t)), grams)).otherwise(F.array()).cast(GRAMS)


def kept_hashes(grams: Column) -> Column:
    return F.array_distinct(F.transform(grams, lambda x: x["name"]))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two arrays of distinct hashes; 1 for two empty ones."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(let(both, lambda n: n / (F.size(a) + F.size(b) - n).cast("double")))


def said(grams: Column) -> Column:
    """``position:name`` of each chosen gram, comma-joined."""
    return F.array_join(F.transform(grams, lambda x: F.concat(x["place"].cast("string"), F.lit(":"), F.lower(F.hex(x["name"])))), ",")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fingerprint, hashes) for every row: the chosen grams with positions as text, their hashes as an array."""
    return docs.select(id_col, winnow(F.col(text_col)).alias("g")).select(id_col, said(F.col("g")).alias("fingerprint"), kept_hashes(F.col("g")).alias("hashes"))


_LAST = -(1 << 63)


def with_next(rows: DataFrame, order: str, ties: str, added: dict[str, Column], carried: list[str], rows_a_range: int = 1000, most_ranges: int = 20_000) -> DataFrame:
    """``rows`` with the ``added`` columns and ``next_<c>`` of each carried column: that of the next row in
    descending ``order`` (a long; null last), the first row's for the last.

    Rows are exchanged once, by ranges of ``order``, and the added columns computed then; each range also gets the one row that follows it.
    Ranges come from quantiles, at most ``most_ranges`` of them, and what follows them from each range's
    first row, two numbers for each. Rows of equal order follow each other by a hash of ``ties``; an order that fills several quantiles, such as null ids, is parted by that hash.
    """
    spark = rows.sparkSession
    keyed = rows.withColumn("with_key", F.coalesce(F.col(order), F.lit(_LAST))).withColumn("with_hash", F.xxhash64(ties))
    n = rows.count()
    if n == 0:
        return rows.withColumns(added).select("*", *[F.col(c).alias(f"next_{c}") for c in carried])
    parts = min(most_ranges, max(n // rows_a_range, 3 * shuffle_partitions(spark)))
    found = keyed.agg(F.percentile_approx("with_key", [i / parts for i in range(1, parts)], 20 * parts)).first()[0] or []
    times = Counter(found)
    marks = sorted(times)
    # A range holds the orders above one mark up to the next; ranges are numbered downwards, as the order goes.
    place = F.lit(len(marks)) - _bisect(F.lit(marks), F.col("with_key"), len(marks)) if marks else F.lit(0)
    heavy = {m: 1 << (k.bit_length() + 1) for m, k in times.items() if k > 1}
    part = F.lit(_MOST_PARTS)
    if heavy:
        width = F.try_element_at(F.create_map(*[F.lit(x).cast("long") for pair in heavy.items() for x in pair]), F.col("with_key"))
        part = F.coalesce(F.floor((F.col("with_hash").cast("double") + 2.0**63) / 2.0**64 * width), F.lit(_MOST_PARTS)).cast("int")
    keyed = keyed.withColumn("bucket", place.cast("long") * (2 * _MOST_PARTS) + part)
    first = F.max(F.struct("with_key", (-1 - F.col("with_hash")).alias("turned")))
    heads = {r["bucket"]: (r["head"]["with_key"], -1 - r["head"]["turned"]) for r in keyed.select("bucket", "with_key", "with_hash").groupBy("bucket").agg(first.alias("head")).collect()}
    turn = sorted(heads)
    follows = [(*heads[turn[(i + 1) % len(turn)]], b) for i, b in enumerate(turn)]
    ghosts = spark.createDataFrame(follows, "with_key long, with_hash long, to long")
    extra = keyed.join(F.broadcast(ghosts), ["with_key", "with_hash"]).withColumn("bucket", F.col("to")).withColumn("ghost", F.lit(True)).drop("to")
    both = keyed.withColumn("ghost", F.lit(False)).unionByName(extra).repartition("bucket").withColumns(added)
    w = W.partitionBy("bucket").orderBy("ghost", F.col("with_key").desc(), "with_hash")
    return both.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in carried]).filter("not ghost").drop("with_key", "with_hash", "bucket", "ghost")


#: Parts of one order at most, more than there are quantiles.
_MOST_PARTS = 1 << 16


def _bisect(table: Column, value: Column, n: int) -> Column:
    """How many of the ``n`` ascending numbers of ``table`` lie below ``value``, by halving."""
    at = F.lit(0)
    for half in (1 << i for i in reversed(range(n.bit_length()))):
        at = let(at, _step(table, value, n, half))
    return at


def _step(table: Column, value: Column, n: int, half: int):
    return lambda at: F.when((at + half <= n) & (F.try_element_at(table, F.least(at + half, F.lit(n))) < value), at + half).otherwise(at)


def fingerprint_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every document.

    The edited text has its last floor(n/3) code points replaced by the first as many (or all) of the
    next document's, in descending order of id. A null text is empty. Rows of one id are ordered by a
    hash of their text; a lone row is its own next. near_*: Jaccard likeness of chosen hashes.
    """
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    linked = with_next(own, "id", "text", {"g": winnow(F.col("text"))}, ["text", "g"])
    n = F.length("text")
    tail = F.floor(n / 3).cast("int")
    edited = linked.select("id", n.cast("long").alias("n_chars"), "g", "next_g", F.concat(F.substring("text", F.lit(1), n - tail), F.substring("next_text", F.lit(1), tail)).alias("edited"))
    both = edited.select("id", "n_chars", "g", "next_g", F.sha2("edited", 256).alias("edited_sha256"), winnow(F.col("edited")).alias("e"))
    return both.select(
        F.col("id").alias("doc_id"), "n_chars", "edited_sha256", said(F.col("g")).alias("fingerprint"), said(F.col("e")).alias("edited_fingerprint"),
        likeness(kept_hashes(F.col("g")), kept_hashes(F.col("e"))).alias("near_edited"), likeness(kept_hashes(F.col("g")), kept_hashes(F.col("next_g"))).alias("near_next"),
    )
