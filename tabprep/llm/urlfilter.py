"""URL filter: rules first, then a list of canonical URLs behind a blocked
Bloom filter with an exact hash join (native).

*Rules* are ``(host, path, verdict)``: a rule fits its host and all subdomains
if the URL's path starts with the rule's path; the longest fitting rule wins
and its verdict is final. The rule set is configuration (a few literals).

*List.* The other URLs are looked up by canonical form in a list of any size.
The filter is one 64-bit word per block (``bits_per_url`` bits per listed URL
in all, ``hashes`` bits set per URL), built by a grouped ``bit_or``. The
distinct canonical URLs probe it with an equi-join on the block number; what
passes goes to an exact hash join on the canonical URL, which removes the false
positives. The filter table is broadcast only below a counted size.

Defined results: a null URL or one without ``://`` has an empty host and path,
no rule and no canonical form, hence ``allow``; null or empty list entries are
ignored; repeated rows stay repeated; other columns are not read; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabprep.llm.common import UPPER, col, small_or_shuffled

BITS_PER_URL = 16
HASHES = 4
#: Query parameters that do not change the page.
TRACKING = r"(^|&)(utm_[^=&]*|ref|gclid|fbclid)=[^&]*"


def host(url) -> Column:
    h = F.regexp_extract(col(url), r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(h, UPPER, UPPER.lower()), F.lit(""))


def path(url) -> Column:
    return F.coalesce(F.regexp_extract(col(url), r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url) -> Column:
    """Host without ``www.``/``m.``, default port and final dot; path without
    ``index.html``, ``.html`` and final slashes; other than tracking
    parameters. No scheme, no fragment. Null without a host."""
    h = F.regexp_replace(F.regexp_replace(host(url), r"^(www|m)\.", ""), r"\.?(:80|:443)?$", "")
    p = F.regexp_replace(F.regexp_replace(path(url), r"(/index)?\.html?$", ""), r"/+$", "")
    q = F.regexp_extract(col(url), r"(?s)^[^?#]*\?([^#]*)", 1)
    q = F.regexp_replace(F.regexp_replace(q, TRACKING, ""), r"^&+", "")
    return F.when(h != "", F.concat(h, p, F.when(q != "", F.concat(F.lit("?"), q)).otherwise("")))


def rule_columns(host_col: str, path_col: str, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """``(rule, verdict)`` of the longest fitting rule, null where none fits."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):  # the longest is tested first
        fits = ((F.col(host_col) == h) | F.col(host_col).endswith("." + h)) & F.col(path_col).startswith(p)
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        verdict = F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _block(key: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(blocks)).alias("block")


def _mask(key: str, hashes: int) -> Column:
    """The bits of a key inside its block, from a hash independent of the block's."""
    h = F.xxhash64(F.lit("bits"), F.col(key))
    mask = F.lit(0).cast("long")
    for i in range(hashes):
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"),
                                              F.shiftrightunsigned(h, 6 * i).bitwiseAND(63).cast("int")))
    return mask


def bloom_filter(listed: DataFrame, n_listed: int, bits_per_url: int = BITS_PER_URL,
                 hashes: int = HASHES) -> tuple[DataFrame, int]:
    """``(block, word)`` rows and the number of blocks for distinct ``canon`` rows."""
    blocks = max(1, -(-n_listed * bits_per_url // 64))
    return (listed.select(_block("canon", blocks), _mask("canon", hashes).alias("mask"))
            .groupBy("block").agg(F.bit_or("mask").alias("word"))), blocks


def listed_urls(canon: DataFrame, listed: DataFrame, bits_per_url: int = BITS_PER_URL,
                hashes: int = HASHES) -> DataFrame:
    """The distinct ``canon`` values that are in the list (exact)."""
    listed = listed.select("canon").filter(F.col("canon").isNotNull()).distinct()
    n = listed.count()
    bloom, blocks = bloom_filter(listed, n, bits_per_url, hashes)
    probe = canon.select("canon").filter(F.col("canon").isNotNull()).distinct()
    want = _mask("canon", hashes)
    possible = (probe.withColumn("block", _block("canon", blocks))
                .join(small_or_shuffled(bloom, blocks), "block")
                .filter(F.col("word").bitwiseAND(want) == want).select("canon"))
    return possible.join(listed, "canon", "left_semi")


def judge(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]], page_id: str = "page_id",
          url: str = "url") -> DataFrame:
    """One row per page row: ``page_id, url, host, path, canon, rule, listed, verdict``.

    ``listed`` has a column ``canon`` of canonical URLs to block."""
    p = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"))
    p = p.withColumns({"host": host("url"), "path": path("url"), "canon": canonical("url")})
    hits = listed_urls(p.select("canon"), listed).select(F.col("canon").alias("_key"), F.lit(True).alias("_hit"))
    # a null form never matches; its rows get keys of their own instead of one hot null
    own = F.coalesce("canon", F.concat(F.lit("~"), F.coalesce(F.col("page_id").cast("string"), F.lit(""))))
    rule, verdict = rule_columns("host", "path", rules)
    return (p.withColumn("_key", own).join(hits, "_key", "left")
            .select("page_id", "url", "host", "path", "canon", rule.alias("rule"),
                    F.coalesce("_hit", F.lit(False)).alias("listed"),
                    F.coalesce(verdict, F.when(F.col("_hit"), "block").otherwise("allow")).alias("verdict")))
