"""URL filtering: host and path rules, then a blocked Bloom filter and an exact join with listed URLs (operator 13)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import fresh, materialize, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    """A verdict on a host with all its subdomains, where the URL's path starts with `path`."""

    verdict: str
    host: str
    path: str


RULES = (Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"))

#: Query parameters that say where a visitor came from and not what the page is.
TRACKING = "^(utm_[^=]*|ref|fbclid|gclid)(=.*)?$"

#: 64-bit words of a block of the filter, each of which gets one bit of every key.
WORDS = 8
#: Keys to a block at which about one key in two hundred passes wrongly, and blocks at most: 72 bytes each, 9 MB in all.
KEYS, MOST_BLOCKS = 40, 1 << 17
#: More keys than this to a block let so much pass that the filter isn't worth its broadcast.
FULL = 128

#: A key of more than this share of all possible hits is dealt over SALTS tasks; at most SHARE keys are.
SHARE, SALTS = 1024, 64


def host_of(url: Column) -> Column:
    """What stands behind the first `://` and before `/`, `?`, `#` or the end, A-Z in lower case; empty without `://` or for null."""
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host and stands before `?`, `#` or the end; empty without `://` or for null."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """One address for the forms of a page; null where there is no host.

    Scheme, user, default port, a leading `www.` or `m.`, fragment, closing slashes,
    a closing `.html` and tracking parameters go; other parameters are sorted.
    """
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host_of(url), "^.*@", ""), ":(80|443)?$", ""), "^(www|m)[.]", "")
    path = F.regexp_replace(F.regexp_replace(path_of(url), "/+$", ""), "[.]html$", "")
    told = F.split(F.regexp_extract(url, r"://[^?#]*\?([^#]*)", 1), "&")
    kept = F.array_join(F.array_sort(F.filter(told, lambda p: (p != "") & ~p.rlike(TRACKING))), "&")
    return F.when(host != "", F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def ruled(host: Column, path: Column, rules: Sequence[Rule] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, written as host and path, and its verdict; null where none fits.

    Of rules of one length the one with the longer host wins, then a block.  Rules
    are literals of the plan: a list of hundreds, not of millions (those are listed
    URLs).
    """
    ordered = sorted(rules, key=lambda r: (-len(r.host + r.path), -len(r.host), r.verdict != "block", r))
    if not ordered:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    fits = [((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path) for r in ordered]
    return tuple(F.coalesce(*[F.when(f, F.lit(value(r))) for f, r in zip(fits, ordered, strict=True)]) for value in (lambda r: r.host + r.path, lambda r: r.verdict))


def _place(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    """The block of a key, and its bit in each word of the block."""
    spread = F.xxhash64(F.lit(13), key)
    return F.pmod(F.xxhash64(key), F.lit(blocks)), [F.shiftrightunsigned(spread, 6 * w).bitwiseAND(F.lit(63)).cast("int") for w in range(WORDS)]


def blocked_bloom(keys: DataFrame, key: str) -> tuple[DataFrame | None, int]:
    """(block, w0 to w7) of the distinct `keys`, and the number of blocks; None where there are too many keys.

    One row for each block that has a key, built by bit_or on both sides of the
    shuffle.  Its size has a bound: MOST_BLOCKS rows of nine integers.
    """
    n, blocks = keys.count(), 1
    while blocks * KEYS < n and blocks < MOST_BLOCKS:
        blocks *= 2
    if n > blocks * FULL:
        return None, 0
    block, bits = _place(F.col(key), blocks)
    masks = [F.expr(f"shiftleft(1L, b{w})").alias(f"w{w}") for w in range(WORDS)]
    marked = keys.select(block.alias("block"), *[b.alias(f"b{w}") for w, b in enumerate(bits)]).select("block", *masks)
    return materialize(marked.groupBy("block").agg(*[F.bit_or(f"w{w}").alias(f"w{w}") for w in range(WORDS)]), "bloom"), blocks


def may_be_listed(df: DataFrame, key: str, held: DataFrame | None, blocks: int, out: str) -> DataFrame:
    """Add boolean `out`: whether the filter lets the key pass; a null key never does."""
    if held is None:
        return df.withColumn(out, F.col(key).isNotNull())
    names = fresh(df.columns, "block", *[f"w{w}" for w in range(WORDS)])
    block, bits = _place(F.col(key), blocks)
    passes = reduce(Column.__and__, [F.getbit(F.col(names[w + 1]), bits[w]) == 1 for w in range(WORDS)])
    own = F.when(F.col(key).isNotNull(), block)
    return df.join(F.broadcast(held.toDF(*names)), own == F.col(names[0]), "left").withColumn(out, F.coalesce(passes, F.lit(False))).drop(*names)


def listed_exactly(possible: DataFrame, keys: DataFrame) -> DataFrame:
    """Add `listed` to rows (id, .., key): whether distinct `keys` has the key, by a hash join on the key itself.

    A key with more than a 1024th of the rows is dealt over 64 salts, and its row
    of `keys` stands once for each.
    """
    total = possible.count()
    hot = possible.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max(1000, total // SHARE)).select(F.col("key").alias("hot"))
    salted = possible.join(F.broadcast(hot), F.col("key") == F.col("hot"), "left").withColumn("salt", F.when(F.col("hot").isNotNull(), F.pmod(F.xxhash64("id", "url"), F.lit(SALTS)).cast("int")).otherwise(0)).drop("hot")
    last = F.when(F.col("hot").isNotNull(), F.lit(SALTS - 1)).otherwise(0)
    dealt = keys.join(F.broadcast(hot), F.col("key") == F.col("hot"), "left").select("key", F.explode(F.sequence(F.lit(0), last)).alias("salt"), F.lit(True).alias("listed"))
    return salted.join(dealt.hint("shuffle_hash"), ["key", "salt"], "left").withColumn("listed", F.coalesce("listed", F.lit(False)))


def judge(pages: DataFrame, listed: DataFrame, rules: Sequence[Rule] = RULES, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, listed) of every page: its longest rule's verdict, or else `block` if its canonical URL is listed.

    `listed` is a table of URLs in a column `url`, in any form.  Pages without a
    rule are tried on a blocked Bloom filter of the listed canonical URLs; possible
    hits go to an exact hash join, which removes the false ones; `listed` is null
    where a rule decided.  A null URL, an empty one and one without `://` have an
    empty host and path, fit no rule and are allowed; null URLs of the list count
    as nothing; repeated rows get a row each; a null page_id stays; long URLs are
    read whole; no rows give none, an empty list blocks none; other columns are not
    read.  DataFrame operations only.
    """
    keys = materialize(listed.select(canonical(F.col("url")).alias("key")).where("key IS NOT NULL").distinct(), "listed")
    held, blocks = blocked_bloom(keys, "key")
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    seen = pages.select(F.col(page_id).alias("id"), F.col(url).alias("url")).withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))}).withColumns({"rule": rule, "verdict": verdict})
    tried = may_be_listed(seen.withColumn("key", F.when(F.col("rule").isNull(), canonical(F.col("url")))), "key", held, blocks, "maybe")
    possible = materialize(tried.where("maybe").select("id", "url", "host", "path", "key"), "possible")
    sure = tried.where("NOT maybe").select(F.col("id").alias(page_id), "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"), F.when(F.col("rule").isNull(), F.lit(False)).alias("listed"))
    hits = listed_exactly(possible, keys).select(F.col("id").alias(page_id), "host", "path", F.lit(None).cast("string").alias("rule"), F.when(F.col("listed"), "block").otherwise("allow").alias("verdict"), "listed")
    return sure.unionByName(hits)


#: Words of a page's source that put its URL on the query's list.
SPAM = ("casino", "cheap-pills", "spam-farm")


def listed_pages(pages: DataFrame, words: Sequence[str] = SPAM) -> DataFrame:
    """URLs of pages whose source has one of the words."""
    return pages.where(reduce(Column.__or__, [F.col("html").contains(w) for w in words])).select("url")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return judge(pages, listed_pages(pages))


_SPAM = " OR ".join(f"contains(html, '{w}')" for w in SPAM)
_FITS = [f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN" for r in sorted(RULES, key=lambda r: -len(r.host + r.path))]
_BY_LENGTH = sorted(RULES, key=lambda r: -len(r.host + r.path))
SQL = f"""
WITH p AS (SELECT page_id, html, coalesce(url, '') AS url FROM pages),
s AS (SELECT page_id, html, url,
             translate(regexp_extract(url, '://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
             regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path,
             list_sort([x FOR x IN string_split(regexp_extract(url, '://[^?#]*\\?([^#]*)', 1), '&') IF x <> '' AND NOT regexp_matches(x, '{TRACKING}')]) AS told FROM p),
c AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':(80|443)?$', ''), '^(www|m)[.]', '') AS own,
             regexp_replace(regexp_replace(path, '/+$', ''), '[.]html$', '') || CASE WHEN len(told) > 0 THEN '?' || array_to_string(told, '&') ELSE '' END AS rest FROM s),
listed AS (SELECT DISTINCT own || rest AS key FROM c WHERE own <> '' AND ({_SPAM})),
r AS (SELECT c.*, CASE {" ".join(f"{f} '{r.host + r.path}'" for f, r in zip(_FITS, _BY_LENGTH, strict=True))} END AS rule,
             CASE {" ".join(f"{f} '{r.verdict}'" for f, r in zip(_FITS, _BY_LENGTH, strict=True))} END AS said,
             own <> '' AND own || rest IN (SELECT key FROM listed) AS hit FROM c)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN hit THEN 'block' ELSE 'allow' END) AS verdict,
       CASE WHEN rule IS NULL THEN hit END AS listed FROM r
"""
