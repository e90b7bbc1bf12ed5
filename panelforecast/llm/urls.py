"""URL verdicts by host and path rules and by a list of canonical URLs, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from panelforecast.operators.joins import lookup_join
from panelforecast.sources.stages import stage

# The rules of the registered query.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

#: A block of the filter: eight words of 64 bits, one bit of each per URL, and this many URLs on average.
WORDS, URLS_A_BLOCK = 8, 32
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty for null and without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty for null and without ``://``."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def canonical_url(url: Column) -> Column:
    """One spelling for the spellings of a URL; null where there is no host.

    The scheme, the fragment, an empty query, what comes before ``@``, the ports 80 and
    443, dots that end the host, ``/./`` and repeated slashes go; an empty path is ``/``.
    """
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(url_host(url), "^.*@", ""), ":(80|443)?$", ""), r"\.+$", "")
    path = F.regexp_replace(F.concat(F.lit("/"), url_path(url)), r"/(\.?/)+", "/")
    query = F.coalesce(F.regexp_extract(url, _PARTS, 3), F.lit(""))
    return F.when(host != "", F.concat(host, path, F.when(query == "?", "").otherwise(query)))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """``struct(verdict, rule)`` of the longest rule that fits, null where none does.

    A rule ``host/path`` fits its host and all hosts below it, where the URL's path starts
    with the rule's. Of equally long rules the one with the longer host wins, then the first in
    the alphabet; of rules with the same text the one given first.
    """
    found = None
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), -r[1].index("/"), r[1])):
        at, slash, rest = rule.partition("/")
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(slash + rest)
        value = F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return F.lit(None).cast("struct<verdict:string,rule:string>") if found is None else found


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(blocks))


def _bits(url: Column) -> list[Column]:
    """One bit in each word of the URL's block, six bits of a second hash a word."""
    second = F.xxhash64(url, F.lit("bits"))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(second, 6 * i).bitwiseAND(63).cast("int")) for i in range(WORDS)]


def bloom_blocks(urls: DataFrame, column: str, blocks: int) -> DataFrame:
    """``(block, words)``: the blocked Bloom filter of a table of URLs, one row per block in use.

    Bits of a block are or-ed before anything is shuffled, so repeated URLs cost nothing.
    """
    bits = urls.select(_block(F.col(column), blocks).alias("block"), *[b.alias(f"w{i}") for i, b in enumerate(_bits(F.col(column)))])
    words = bits.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])
    return words.select("block", F.array(*[f"w{i}" for i in range(WORDS)]).alias("words"))


def listed_urls(asked: DataFrame, listed: DataFrame, column: str = "canonical") -> DataFrame:
    """The distinct URLs of ``asked`` that ``listed`` holds; both have the one ``column``.

    Each distinct URL looks up one block of the filter; the possible hits go on to a hash
    join with the list, which removes the false ones (about 1 in 1,000). The
    filter is staged and measured before it is broadcast, and beyond the limit it is joined
    with hot blocks spread.
    """
    listed = stage(listed.where(F.col(column).isNotNull()).distinct(), "listed-urls")
    blocks = max(1, -(-listed.count() // URLS_A_BLOCK))
    asked = asked.where(F.col(column).isNotNull()).distinct().withColumn("block", _block(F.col(column), blocks))
    looked = lookup_join(asked, bloom_blocks(listed, column, blocks), "block", "inner", spread_by=column)
    held = [F.get("words", F.lit(i)).bitwiseAND(b) != 0 for i, b in enumerate(_bits(F.col(column)))]
    possible = looked
    for bit in held:
        possible = possible.where(bit)
    return possible.select(column).join(listed.hint("shuffle_hash"), column, "left_semi")


def judge(
    pages: DataFrame,
    listed: DataFrame | None = None,
    rules: Sequence[tuple[str, str]] = RULES,
    id_column: str = "page_id",
    url_column: str = "url",
    listed_column: str = "url",
) -> DataFrame:
    """Every row of ``pages`` and, after its columns, a struct ``judged`` of ``host``, ``path``, ``rule`` and ``verdict``.

    A rule decides where one fits. All other URLs are blocked if the canonical list holds
    them, else allowed. ``listed`` is a table of URLs to block, of any size; without one it
    is the URLs of these pages that a rule blocks, so that another spelling of a blocked URL
    (an empty path, a port, a dot after the host) is blocked as well.

    Null URLs and URLs without ``://`` have an empty host and path, no rule, and are
    allowed. Repeated rows and null ids stay. Rows whose URL is listed are spread by a hash
    of the id, however many share the URL. A column named ``judged`` is replaced.
    """
    kept = [c for c in pages.columns if c != "judged"]
    given = pages.select(*[f"`{c}`" for c in kept]).toDF(*[f"c{i}" for i in range(len(kept))])
    row_id, url = f"c{kept.index(id_column)}", F.col(f"c{kept.index(url_column)}")
    parts = given.withColumns({"host": url_host(url), "path": url_path(url), "canonical": canonical_url(url)})
    ruled = parts.withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    if listed is None:
        blocked = ruled.where("found.verdict = 'block'").select("canonical")
    else:
        blocked = listed.select(canonical_url(F.col(listed_column)).alias("canonical"))
    hits = listed_urls(ruled.where("found is null").select("canonical"), blocked).withColumn("hit", F.lit(True))
    # pages with a rule look nothing up: their key is null
    ruled = ruled.withColumn("canonical", F.when(F.col("found").isNull(), F.col("canonical")))
    met = lookup_join(ruled, hits, "canonical", "left", spread_by=row_id)
    verdict = F.coalesce("found.verdict", F.when(F.col("hit"), "block").otherwise("allow"))
    judged = F.struct("host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"))
    return met.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)], judged.alias("judged"))
