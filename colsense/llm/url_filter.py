"""URL filter by a blocked Bloom filter and an exact join (operator 13), in
DataFrame functions only.

A list entry is a canonical URL: a host and a path.  It fits its host and all
subdomains, where the URL's path starts with the entry's; the longest fitting
entry (by host and path together, then by host) gives the verdict, and `allow`
holds where none fits.

A URL's candidates are its host suffixes at label borders times its path
prefixes that end in `/` (and those of the lengths of listed paths that don't),
none longer than the longest listed.  So URLs are first cut to what the list can
tell apart, distinct cuts are expanded, and each candidate probes one block of
the filter: 8 words of 64 bits, one bit in each.  Only possible hits reach the
exact join with the list on host and path, which removes false positives.

Sizes: the filter has a power of two of blocks for about 16 entries each, at most
MAX_BLOCKS (64 bytes a block: 16 MB), and is the only broadcast; with more
entries it lets more candidates through to the exact join, which stays right.
The other joins are on distinct cuts or entries; the last one, back to the URLs,
keeps them on the side that adaptive execution can split.

Cases: a null URL and one without `://` have an empty host and path and fit
nothing; an empty table gives no rows; repeated rows are judged each; entries
that are null or have no host are ignored; of equal entries with different
verdicts `block` holds; an empty list allows everything.  Other columns of the
input are carried when named in `keep`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage, table

PER_BLOCK = 16
MAX_BLOCKS = 1 << 18
WORDS = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# FIXED VALUES: the rules of the registered query.
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def _after_scheme(url: Column) -> Column:
    """What follows the first `://`; empty without one."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def listed(entries: DataFrame, entry_col: str = "entry", verdict_col: str = "verdict") -> DataFrame:
    """(host, path, verdict) of entries like `example.net/en/`, one row for each."""
    e = F.col(entry_col).cast("string")
    host = F.translate(F.regexp_extract(e, r"^[^/]*", 0), UPPER, LOWER)
    path = F.regexp_extract(e, r"^[^/]*([\s\S]*)", 1)
    blocks = F.max(F.when(F.col(verdict_col) == "block", 1).otherwise(0))
    return (entries.select(host.alias("host"), path.alias("path"), verdict_col).where("host <> ''")
            .groupBy("host", "path").agg(F.when(blocks == 1, "block").otherwise("allow").alias("verdict")))


def _bits(host: Column, path: Column, n_blocks: int) -> tuple[Column, list[Column]]:
    """Block and the bit of each of its words."""
    h = F.xxhash64(host, path)
    spread = F.xxhash64(path, host, F.lit(1))
    return (F.pmod(h, F.lit(n_blocks)).cast("int"),
            [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(spread, 6 * i).bitwiseAND(F.lit(63)).cast("int"))
             for i in range(WORDS)])


def bloom_blocks(entries: DataFrame, n_blocks: int) -> DataFrame:
    """(block, w0..w7): the filter's blocks that hold an entry."""
    block, bits = _bits(F.col("host"), F.col("path"), n_blocks)
    return (entries.select(block.alias("block"), *[b.alias(f"b{i}") for i, b in enumerate(bits)])
            .groupBy("block").agg(*[F.bit_or(f"b{i}").alias(f"w{i}") for i in range(WORDS)]))


def _candidates(cuts: DataFrame, open_lengths: list[int]) -> DataFrame:
    """(site, cut, host, path): each cut's host suffixes times its path prefixes."""
    labels = F.split("site", r"\.")
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n), "."))
    dirs = F.filter(F.sequence(F.lit(1), F.greatest(F.length("cut"), F.lit(1))), lambda i: F.substring("cut", i, F.lit(1)) == "/")
    lengths = F.array_union(dirs, F.filter(F.array(*[F.lit(x) for x in open_lengths]).cast("array<int>"), lambda i: i <= F.length("cut")))
    return (cuts.withColumn("length", F.explode(lengths)).withColumn("path", F.substring("cut", F.lit(1), F.col("length")))
            .withColumn("host", F.explode(suffixes)).select("site", "cut", "host", "path"))


def possible_hits(candidates: DataFrame, entries: DataFrame, n_blocks: int) -> DataFrame:
    """The candidates that the filter of the entries lets through."""
    block, bits = _bits(F.col("host"), F.col("path"), n_blocks)
    probes = candidates.withColumn("block", block).join(F.broadcast(bloom_blocks(entries, n_blocks)), "block")
    passes = F.lit(True)
    for i, b in enumerate(bits):
        passes = passes & (F.col(f"w{i}").bitwiseAND(b) != 0)
    return probes.where(passes).select(*candidates.columns)


def judge_urls(urls: DataFrame, entries: DataFrame, url_col: str = "url", keep: list[str] | None = None,
               default: str = "allow", max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """(*keep, host, path, rule, verdict) of every row of urls; entries has
    (host, path, verdict), one row for each, as `listed` makes them."""
    entries = stage(entries)
    sizes = entries.agg(F.count("*").alias("n"), F.max(F.length("path")).alias("path"),
                        F.max(F.size(F.split("host", r"\."))).alias("labels"),
                        F.sort_array(F.collect_set(F.when(~F.col("path").endswith("/"), F.length("path")))).alias("open")).first()
    rows = urls.select(*(keep or []), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    if not sizes.n:
        return rows.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    n_blocks = 1
    while n_blocks * PER_BLOCK < sizes.n and n_blocks < max_blocks:
        n_blocks *= 2

    # what the list can tell apart: the last labels of the host and the first characters of the path
    site = F.substring_index("host", ".", -sizes.labels)
    cut = F.substring("path", F.lit(1), F.lit(sizes.path))
    cuts = rows.select(site.alias("site"), cut.alias("cut")).where("site <> ''").distinct()
    hits = possible_hits(_candidates(cuts, sizes.open), entries, n_blocks)
    order = F.struct(F.length("host") + F.length("path"), F.length("host"))
    found = (hits.join(entries, ["host", "path"])
             .groupBy("site", "cut").agg(F.max_by(F.struct(F.concat("host", "path").alias("rule"), "verdict"), order).alias("hit")))
    return (rows.withColumn("_uf_site", site).withColumn("_uf_cut", cut)
            .join(found.select(F.col("site").alias("_uf_site"), F.col("cut").alias("_uf_cut"), F.col("hit").alias("_uf_hit")),
                  ["_uf_site", "_uf_cut"], "left")
            .select(*rows.columns, F.col("_uf_hit.rule").alias("rule"), F.coalesce("_uf_hit.verdict", F.lit(default)).alias("verdict")))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(e).alias("entry"), F.lit(v).alias("verdict")) for e, v in RULES])).alias("r")).select("r.*")
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), listed(rules), keep=["page_id"])


OP13_SQL = """
WITH after AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM after),
judged AS (
  SELECT *, CASE
      WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
      WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
      WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
      WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM parts)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM judged
"""
