"""URL filtering by rules and by a list of canonical URLs behind a blocked Bloom filter (native).

A listed URL's hash names a block of 256 bits, eight words of 32, and sets one bit in each word;
words are combined by ``bit_or`` as partial aggregates. The blocks are broadcast: a page whose
eight bits are all set may be listed, any other is not and is never shuffled. Possible hits
meet the list by an exact hash join on the canonical URL, which removes false positives. The
filter's size is bounded by ``most_blocks``; a list too long for that is joined without a filter.

Rules are few and written by people: they travel as constants of the plan, and their number is
bounded. A rule fits its host and all subdomains if the path starts with the rule's path; of those
that fit, the longest text wins (of equally long ones the longer host, then the smaller text),
before the list.

Defined results: a null URL, or one without ``://``, has an empty host and path, fits no rule and is
not listed; so is a URL whose host and path are both empty; repeated pages are judged alike, null ids
too; an empty table gives no rows, an empty list blocks nothing; URLs of any length are taken
whole; of other columns only those named in ``keep`` are read.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a block, and bits of a word.
WORDS, WIDTH = 8, 32
#: Bits a listed URL: under one false positive in a hundred.
BITS = 12
#: 32 MB of words at most are broadcast.
MOST_BLOCKS = 1 << 20
MOST_RULES = 1000
#: Characters of a list that may be broadcast for the exact join.
SMALL_LIST = 8 << 20
#: Query parameters that name no other page.
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid)(=|$)"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """One text for the variants of a URL, NULL where there is no host and path.

    Scheme, fragment, ``www.``, default ports, tracking parameters, ``index.html``, ``.html`` and slashes at the end go; parameters are sorted.
    """
    host = F.regexp_replace(host_of(url), r"^www\.|:(80|443)\z", "")
    path = F.rtrim(F.regexp_replace(path_of(url), r"(/index)?\.html?\z", ""), F.lit("/"))
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&", -1), lambda p: (p != "") & ~p.rlike(TRACKING))), "&")
    whole = F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))
    return F.when(whole != "", whole)


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """(text, verdict) of the rule that holds, or NULL."""
    if len(rules) > MOST_RULES or len({r.text for r in rules}) < len(rules):
        raise ValueError(f"rules must have distinct texts, and there may be {MOST_RULES}; longer lists of URLs belong in `listed`")
    found = F.lit(None).cast("struct<text:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (-len(r.text), -len(r.host), r.text), reverse=True):
        of_host = (host == r.host.lower()) | host.endswith("." + r.host.lower())
        found = F.when(of_host & path.startswith(r.path), F.struct(F.lit(r.text).alias("text"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _bits(key: Column) -> list[Column]:
    """One bit for each word of a block, from a hash beside the block's."""
    other = F.xxhash64(key, F.lit(1))
    return [F.call_function("shiftleft", F.lit(1), F.shiftright(other, 5 * i).bitwiseAND(F.lit(WIDTH - 1)).cast("int")) for i in range(WORDS)]


def bloom(listed: DataFrame, blocks: int, key: str = "key") -> DataFrame:
    """(block, w0..w7) of a list of canonical URLs; a row for each block in use."""
    words = [F.bit_or(bit).alias(f"w{i}") for i, bit in enumerate(_bits(F.col(key)))]
    return listed.groupBy(_block(F.col(key), blocks).alias("block")).agg(*words)


def possible(rows: DataFrame, words: DataFrame, blocks: int, key: str = "key", name: str = "possible") -> DataFrame:
    """``rows`` with whether their key passes the filter: a map-side look-up of one block."""
    held = words.select(F.col("block").alias("_block"), *[F.col(f"w{i}").alias(f"_w{i}") for i in range(WORDS)])
    joined = rows.withColumn("_at", _block(F.col(key), blocks)).join(F.broadcast(held), F.col("_at") == F.col("_block"), "left")
    all_set = F.col(key).isNotNull() & F.col("_block").isNotNull()
    for i, bit in enumerate(_bits(F.col(key))):
        all_set &= F.col(f"_w{i}").bitwiseAND(bit) == bit
    return joined.select(*rows.columns, F.coalesce(all_set, F.lit(False)).alias(name))


def judge(pages: DataFrame, rules: Sequence[Rule], listed: DataFrame, url: str = "url", listed_url: str = "url", keep: Sequence[str] = ("page_id",), bits: int = BITS, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """``keep`` columns with host, path, canonical, rule, verdict, and whether the page passed the filter and is listed."""
    address = F.col("_url")
    rows = pages.select(*[F.col(c) for c in keep], F.col(url).alias("_url"))
    rows = rows.select(*keep, host_of(address).alias("host"), path_of(address).alias("path"), canonical(address).alias("canonical"))
    listing = written(listed.select(canonical(F.col(listed_url)).alias("key")).dropna().distinct(), "listed")
    size = listing.agg(F.count("key").alias("n"), F.coalesce(F.sum(F.octet_length("key")), F.lit(0)).alias("chars")).first()
    blocks = max(1, -(-size["n"] * bits // (WORDS * WIDTH)))
    if blocks <= most_blocks:
        rows = possible(rows, bloom(listing, blocks), blocks, "canonical")
    else:
        rows = rows.withColumn("possible", F.col("canonical").isNotNull())
    exact = listing.select(F.col("key").alias("canonical"), F.lit(True).alias("listed"))
    exact = F.broadcast(exact) if size["chars"] <= SMALL_LIST and size["n"] <= SMALL_LIST // 64 else exact.hint("shuffle_hash")
    hits = rows.filter("possible").join(exact, "canonical", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    judged = rows.filter(~F.col("possible")).withColumn("listed", F.lit(False)).unionByName(hits)
    judged = judged.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("listed"), "block").otherwise("allow"))
    return judged.select(*keep, "host", "path", "canonical", F.col("_rule.text").alias("rule"), verdict.alias("verdict"), "possible", "listed")
