"""URL filters: rules by host and path, and a list of addresses behind a blocked Bloom filter.

The list may be as long as one likes.  Its canonical addresses are hashed into a filter of blocks of 256 bits; an
address sets, and is looked up by, eight bits of one block.  The filter is a table (block, four words) of at most
``MOST_BLOCKS`` rows whatever the list's length, so it can be sent to all tasks.  Addresses whose bits are not all set
are surely not listed; only the others are shuffled and joined exactly with the list, which removes false positives.  A
list that outgrows the filter makes more rows take the exact join and changes no result.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from questloom.session import stage

#: Blocks of 256 bits; 2**17 of them are 4 MB of bits.
MOST_BLOCKS = 1 << 17
#: Bits of the filter for each listed address, until the filter is at its largest.
BITS_PER_KEY = 16
WORDS = 4


class Rule(NamedTuple):
    """A host with all its subdomains, the start of the path, and the verdict (allow or block)."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; null if there is none."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.when(url.contains("://"), F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; null without a ``://``."""
    return F.when(url.contains("://"), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1))


def canonical(url: Column) -> Column:
    """The form by which addresses are compared; null for a null or one without ``://``.

    No scheme, no fragment, no ``www.``, no port 80 or 443, no slash at the end of the path, and of the query the
    parameters in order, without empty ones and those that only say where a visitor came from (``utm_*``, ``ref``,
    ``fbclid``, ``gclid``).
    """
    site = F.regexp_replace(F.regexp_replace(host(url), r"^www\.", ""), r":(80|443)$", "")
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    parts = F.array_sort(
        F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(r"^(utm_[^=]*|ref|fbclid|gclid)(=|$)"))
    )
    tail = F.array_join(parts, "&")
    return F.concat(site, F.regexp_replace(path(url), r"/+$", ""), F.when(tail == "", "").otherwise(F.concat(F.lit("?"), tail)))


def rule_fits(rule: Rule) -> Column:
    site = (F.col("host") == rule.host) | F.col("host").endswith("." + rule.host)
    return site & F.col("path").startswith(rule.path)


def _masks(address: Column) -> list[Column]:
    """For each word of a block the two bits that the address sets there."""
    bits = F.xxhash64(address, F.lit(2))
    one = F.lit(1).cast("long")
    return [_bit(one, bits, 12 * w).bitwiseOR(_bit(one, bits, 12 * w + 6)) for w in range(WORDS)]


def _bit(one: Column, bits: Column, at: int) -> Column:
    return F.call_function("shiftleft", one, F.shiftrightunsigned(bits, at).bitwiseAND(F.lit(63)).cast("int"))


def _block(address: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(address, F.lit(1)), F.lit(blocks)).cast("int")


def bloom_filter(addresses: DataFrame, blocks: int) -> DataFrame:
    """Of a table (address): (block, word_0 .. word_3), the blocks that have a bit set."""
    rows = addresses.select(_block(F.col("address"), blocks).alias("block"), *[m.alias(f"word_{i}") for i, m in enumerate(_masks(F.col("address")))])
    return rows.groupBy("block").agg(*[F.bit_or(f"word_{i}").alias(f"word_{i}") for i in range(WORDS)])


def blocks_for(keys: int, most: int = MOST_BLOCKS) -> int:
    """The next power of two that gives each key its bits, at most ``most``."""
    need = max(1, -(-keys * BITS_PER_KEY // (64 * WORDS)))
    return min(most, 1 << (need - 1).bit_length())


def judge_urls(pages: DataFrame, listed: DataFrame, rules: Sequence[Rule] = (), *, id_col: str = "page_id", url_col: str = "url",
               listed_col: str = "url", verdict: str = "block", most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, listed, checked.

    The longest rule (host and path together) that fits decides, of several the one with the longer host, then the last
    by its text, then by its verdict; ``rule`` is its text, null if none fits.  Otherwise a
    page whose canonical address is on the list gets ``verdict``, and any other the opposite one.  ``checked`` tells
    that the filter could not rule the page out, so that the list itself was asked (only asked where no rule decides).
    Null addresses and those without ``://`` have an empty host and path, fit no rule and are never listed.  The list
    may hold nulls, repetitions and different forms of an address; an empty list blocks nothing.  A row repeated is
    judged each time.  Rules are few (a list in the program); other columns are not looked at.
    """
    pages = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    known = listed.select(canonical(F.col(listed_col)).alias("address")).where("address IS NOT NULL").distinct()
    known = stage(known, "listed-urls")
    blocks = blocks_for(known.count(), most_blocks)
    bloom = bloom_filter(known, blocks)

    read = pages.select(
        "page_id",
        F.coalesce(host(F.col("url")), F.lit("")).alias("host"),
        F.coalesce(path(F.col("url")), F.lit("")).alias("path"),
        canonical(F.col("url")).alias("address"),
    )
    ruled = F.lit(None).cast("string")
    said = F.lit(None).cast("string")
    for rule in sorted(set(rules), key=lambda r: (len(r.name), len(r.host), r.name, r.verdict)):
        fits = rule_fits(rule)
        ruled = F.when(fits, rule.name).otherwise(ruled)
        said = F.when(fits, rule.verdict).otherwise(said)
    read = read.withColumn("rule", ruled).withColumn("said", said)
    read = read.withColumn("block", _block(F.coalesce("address", F.lit("")), blocks))
    # Bounded by MOST_BLOCKS rows of five numbers.
    looked = read.join(F.broadcast(bloom), "block", "left")
    all_set = F.lit(True)
    for i, mask in enumerate(_masks(F.col("address"))):
        all_set = all_set & (F.coalesce(F.col(f"word_{i}"), F.lit(0)).bitwiseAND(mask) == mask)
    possible = F.col("said").isNull() & F.col("address").isNotNull() & all_set
    looked = looked.select("page_id", "host", "path", "rule", "said", "address", possible.alias("checked"))
    other = "allow" if verdict == "block" else "block"

    def finished(rows: DataFrame, is_listed: Column) -> DataFrame:
        answer = F.coalesce(F.col("said"), F.when(is_listed, verdict).otherwise(other))
        return rows.select("page_id", "host", "path", "rule", answer.alias("verdict"), is_listed.alias("listed"), "checked")

    exact = known.select(F.col("address"), F.lit(True).alias("there")).hint("shuffle_hash")
    asked = looked.where("checked").join(exact, "address", "left")
    return finished(looked.where("NOT checked"), F.lit(False)).unionByName(finished(asked, F.coalesce("there", F.lit(False))))
