"""URL filter: a blocked Bloom filter passes possible hits to an exact hash join.

Listed are canonical URLs (host without ``www.``, path without a last ``/``)
and rules (host, path prefix, action). Both become keys. A URL has one key
for its canonical form and one for each pair of a host suffix and a path
prefix that a rule could have.

* The filter is a table: one row per block of 512 bits, eight words of 64.
  A key's hash names its block, a second one sets one bit in every word.
* The distinct keys of the table are joined with the filter on the block; a
  key goes on if all its eight bits are set. Few others do (about 1 % or
  less at ``BITS_PER_KEY``).
* An exact join on the key text removes the false positives.
* The remaining keys go back to the distinct (host, path) pairs, where the
  longest rule wins, and from there to the rows.

Frequent URLs and hosts are aggregated before anything is shuffled, and the
joins back have one row per key on their other side, so a hot key can be
split. Whether a side is broadcast is left to Spark's size threshold.

Defined cases: a null url, or one without ``://``, has empty host and path,
fits no rule and is allowed. Repeated rows are judged each. Without rules or
list everything is allowed. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BITS_PER_KEY, MIN_BLOCKS = 16, 1024
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: str) -> tuple[Column, Column]:
    """Expressions for the host (lower case) and path of a url column."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def canonical(host: str = "host", path: str = "path") -> Column:
    """Key of a whole URL; null for an empty host."""
    return F.when(F.col(host) != "", F.concat(
        F.lit("u:"), F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, "/$", "")))


def _bits(key: Column) -> list[Column]:
    """The bit that a key sets in each of the eight words of its block."""
    h = F.xxhash64(F.lit("bits"), key)
    one = F.lit(1).cast("long")
    return [F.call_function("shiftleft", one, F.shiftrightunsigned(h, 6 * j).bitwiseAND(63).cast("int"))
            for j in range(8)]


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def bloom(keys: DataFrame, blocks: int) -> DataFrame:
    """``(block, w0..w7)`` of a column ``key``."""
    k = keys.select(_block(F.col("key"), blocks).alias("block"), *[
        b.alias(f"w{j}") for j, b in enumerate(_bits(F.col("key")))])
    return k.groupBy("block").agg(*[F.bit_or(f"w{j}").alias(f"w{j}") for j in range(8)])


def possible(keys: DataFrame, filter_: DataFrame, blocks: int) -> DataFrame:
    """The keys whose bits are all set."""
    k = keys.select("key", _block(F.col("key"), blocks).alias("block"), *[
        b.alias(f"b{j}") for j, b in enumerate(_bits(F.col("key")))])
    hit = F.lit(True)
    for j in range(8):
        hit = hit & (F.col(f"w{j}").bitwiseAND(F.col(f"b{j}")) == F.col(f"b{j}"))
    return k.join(filter_, "block").where(hit).select("key")


def judge(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` for every row.

    ``listed`` has a column ``key`` of canonical URLs to block; ``rules`` are
    (host, path, action) rows of a short hand-written list.
    """
    spark: SparkSession = pages.sparkSession
    host, path = host_and_path("url")
    p = pages.select("page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    pairs = p.select("host", "path").distinct()

    labels = max([r[0].count(".") + 1 for r in rules], default=0)
    lengths = sorted({len(r[1]) for r in rules})
    exprs = [canonical()]
    parts = F.split("host", r"\.")
    for n in range(1, labels + 1):
        suffix = F.array_join(F.slice(parts, F.greatest(F.size(parts) - n + 1, F.lit(1)), n), ".")
        exprs += [F.when((F.size(parts) >= n) & (F.length("path") >= m) & (F.col("host") != ""),
                         F.concat(F.lit("r:"), suffix, F.substring("path", 1, m))) for m in lengths]
    keyed = pairs.select("host", "path", F.explode(F.array_compact(F.array(*exprs))).alias("key"))

    kind = "key string, rule string, action string, weight int"
    table = spark.createDataFrame([(f"r:{h}{q}", f"{h}{q}", a, len(h) + len(q)) for h, q, a in rules], kind)
    entries = table.unionByName(listed.where("key is not null").select("key").distinct().select(
        "key", F.lit(None).cast("string").alias("rule"), F.lit("block").alias("action"), F.lit(-1).alias("weight")))
    n = entries.count()
    blocks = max(MIN_BLOCKS, -(-n * BITS_PER_KEY // 512))
    hits = possible(keyed.select("key").distinct(), bloom(entries, blocks), blocks).join(entries, "key")
    best = keyed.join(hits, "key").groupBy("host", "path").agg(
        F.max_by(F.struct("rule", "action"), F.struct("weight", "key")).alias("best"))
    return p.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.action", F.lit("allow")).alias("verdict"))


def urls_of_sites(pages: DataFrame, sites: tuple[str, ...]) -> DataFrame:
    """Canonical URLs of ``pages`` whose host has a label of ``sites``: a list that grows with the crawl."""
    host, path = host_and_path("url")
    p = pages.select(host.alias("host"), path.alias("path"))
    on = F.arrays_overlap(F.split("host", r"\."), F.array(*map(F.lit, sites)))
    return p.where(on).select(canonical().alias("key")).distinct()
