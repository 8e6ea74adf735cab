"""URL filters: a blocked Bloom filter passes possible hits to an exact hash join, in DataFrame functions alone.

A rule lists a canonical URL (host and path prefix) with a verdict; it fits its host and all subdomains where the
path starts with the rule's. A page's keys are its host suffixes joined with its path prefixes of the listed lengths.
Keys that pass the filter are joined exactly with the rules, and the longest rule that fits decides.

A null URL or one without ``://`` has an empty host and path, fits no rule and gets the default. Repeated rows each
get a verdict; null ids are kept; other columns aren't read. Of rules with the same host and path, ``block`` wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import lower_ascii

#: The filter has at most so many blocks of 64 bits (8 MB), whatever the number of rules; only that may be broadcast.
MOST_BLOCKS = 1 << 20
#: Rules that a block holds on average, if there are blocks enough.
RULES_A_BLOCK = 4


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _block_and_mask(key: Column, blocks: int) -> tuple[Column, Column]:
    """A key's block and its four bits there."""
    h = F.xxhash64(key)
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(F.xxhash64(key, F.lit(1)), 6 * k).bitwiseAND(F.lit(63)).cast("int")) for k in range(4)]
    return F.pmod(h, F.lit(blocks)), bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2]).bitwiseOR(bits[3])


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row: id, host, path, the deciding rule (host and path joined, or null) and its verdict, else ``default``.

    ``rules`` has host, path and verdict. Its number sets the filter's size up to ``MOST_BLOCKS``.
    """
    rules = rules.where("host is not null and path is not null").groupBy(lower_ascii(F.col("host")).alias("host"), "path").agg(F.max("verdict").alias("verdict"))
    rules = rules.select(F.concat("host", "path").alias("key"), F.length("path").alias("n_path"), "verdict")
    # A few numbers: how many rules, and the lengths that listed paths have.
    about = rules.agg(F.count("*").alias("n"), F.collect_set("n_path").alias("lengths")).first()
    blocks = min(MOST_BLOCKS, 1 << max(4, (about["n"] // RULES_A_BLOCK).bit_length()))
    block, mask = _block_and_mask(F.col("key"), blocks)
    bloom = rules.select(block.alias("block"), mask.alias("mask")).groupBy("block").agg(F.bit_or("mask").alias("bits"))

    rows = pages.select(F.col(id_col).alias(id_col), F.col(url_col).cast("string").alias("url"))
    rows = rows.select(F.monotonically_increasing_id().alias("row"), id_col, host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    prefixes = F.array_compact(F.array(*(F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in sorted(about["lengths"]))))
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p)))) if about["lengths"] else F.array().cast("array<string>")
    tried = rows.select("*", F.posexplode_outer(F.array_distinct(keys)).alias("place", "key"))
    passed = tried.withColumn("block", block).withColumn("mask", mask).join(F.broadcast(bloom), "block", "left").withColumn("hit", F.coalesce(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask"), F.lit(False)))
    # One row of each page stays, so that pages without a possible hit keep their place.
    possible = passed.where("hit or place is null or place = 0").select("row", id_col, "host", "path", F.when(F.col("hit"), F.col("key")).alias("key"))
    exact = possible.join(rules.select("key", "verdict"), "key", "left")
    longest = F.max(F.when(F.col("verdict").isNotNull(), F.struct(F.length("key").alias("n"), F.col("key").alias("rule"), "verdict")))
    return exact.groupBy("row", id_col, "host", "path").agg(longest.alias("best")).select(id_col, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


#: The rules of the registered query: (host, path, verdict).
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def oracle(rules=RULES, default: str = "allow") -> str:
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in rules)
    return f"""
    with rules(h, p, v) as (values {values}),
    split as (select row_number() over () as rid, page_id, case when url like '%://%' then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
    parts as (select rid, page_id, translate(regexp_extract(rest, '(?s)^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) as path from split),
    best as (select rid, arg_max(h || p, length(h || p)) as rule, arg_max(v, length(h || p)) as v from parts join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by rid)
    select page_id, host, path, rule, coalesce(v, '{default}') as verdict from parts left join best using (rid)"""
