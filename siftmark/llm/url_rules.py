"""URL filtering by mined association rules, with explicit rules on top.

URLs become sets of tokens (scheme, host labels, path words, query keys, fragment).
FP-growth mines the token combinations that go with bad labels; rules below the
confidence, support or lift limits, and rules that a shorter rule already covers, are
dropped. A rule is indexed under its rarest token; a URL is looked up by its tokens
and the candidates are checked for the whole combination. Explicit (host, path) rules
outrank the mined ones.

Null URLs and URLs without ``://`` have empty host and path; they have no tokens and
are allowed. Each row is judged on its own, so repeated rows get equal verdicts. No
labels, or none bad, give no mined rules. Only DataFrame functions and Spark ML run.
"""

from __future__ import annotations

import string
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

BAD = "label:bad"


class Limits(NamedTuple):
    """Production parameters of the mined rules."""

    min_support: float = 0.002
    min_count: int = 10
    min_confidence: float = 0.6
    min_lift: float = 1.5
    longest: int = 3


class Policy(NamedTuple):
    host: str
    path: str
    verdict: str


# Fixed values of the contract.
POLICY = (
    Policy("net", "/", "block"),
    Policy("example.net", "/en/", "allow"),
    Policy("example.com", "/de/", "block"),
    Policy("org", "/fr/", "allow"),
)


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    host = F.regexp_extract(url, "://([^/?#]*)", 1)
    lowered = F.translate(host, string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(lowered, F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_tokens(url: Column) -> Column:
    """Distinct tokens of a URL; all numbers are one token."""

    def tagged(tag: str, parts: Column) -> Column:
        return F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.concat(F.lit(tag), p))

    lowered = F.lower(F.coalesce(url, F.lit("")))
    words = F.transform(
        F.split(url_path(lowered), "[/._~-]+"), lambda p: F.regexp_replace(p, "^[0-9]+$", "0")
    )
    query = F.split(F.regexp_extract(lowered, r"://[^?#]*\?([^#]*)", 1), "[&;]")
    keys = F.transform(query, lambda p: F.regexp_extract(p, "^([^=]*)", 1))
    whole = F.concat(
        tagged("s:", F.array(F.regexp_extract(lowered, "^([a-z][a-z0-9+.-]*)://", 1))),
        tagged("h:", F.split(url_host(lowered), r"\.")),
        tagged("p:", words),
        tagged("q:", keys),
        tagged("f:", F.array(F.regexp_extract(lowered, "#(.*)$", 1))),
    )
    none = F.array().cast("array<string>")
    return F.when(lowered.contains("://"), F.array_distinct(whole)).otherwise(none)


def policy_rule(host: Column, path: Column, rules: Sequence[Policy]) -> Column:
    """The longest explicit rule that fits, as a struct (size, rule, verdict); else null.

    A rule fits its host and all subdomains when the path starts with the rule's.
    """
    fits = [
        F.when(
            ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path),
            F.struct(
                F.lit(len(r.host + r.path)).alias("size"),
                F.lit(r.host + r.path).alias("rule"),
                F.lit(r.verdict).alias("verdict"),
            ),
        )
        for r in rules
    ]
    return F.array_max(F.array(*fits))


def mine_rules(labelled: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Rules ``tokens -> bad`` of labelled token sets (columns tokens, bad).

    Returns tokens (sorted), size, count (URLs with all tokens), bad (of these),
    confidence. A rule needs the support, confidence and lift of ``limits``, and a
    higher confidence than each rule on a part of its tokens.
    """
    rows = materialize(
        labelled.where(F.col("bad").isNotNull() & (F.size("tokens") > 0)), "url_labelled"
    )
    marked = F.array_union("tokens", F.array(F.lit(BAD)))
    items = F.when(F.col("bad"), marked).otherwise(F.col("tokens"))
    model = FPGrowth(itemsCol="items", minSupport=limits.min_support, minConfidence=0.0)
    sets = model.fit(rows.select(items.alias("items"))).freqItemsets.where(
        F.size("items") <= limits.longest + 1
    )
    sets = materialize(sets.withColumn("items", F.array_sort("items")), "url_itemsets")
    with_bad = sets.where(F.array_contains("items", BAD) & (F.size("items") > 1)).select(
        F.array_remove("items", BAD).alias("tokens"), F.col("freq").alias("bad")
    )
    alone = sets.where(~F.array_contains("items", BAD)).select(
        F.col("items").alias("tokens"), F.col("freq").alias("count")
    )
    base = rows.agg(F.avg(F.col("bad").cast("double")).alias("base"))
    confidence = F.col("bad") / F.col("count")
    rules = (
        with_bad.join(alone, "tokens")
        .crossJoin(base)  # one row
        .where(
            (F.col("count") >= limits.min_count)
            & (confidence >= limits.min_confidence)
            & (confidence >= limits.min_lift * F.col("base"))
        )
        .select(
            "tokens", F.size("tokens").alias("size"), "count", "bad", confidence.alias("confidence")
        )
    )
    # A rule of n tokens has at most 2**longest - 2 parts, so this stays in proportion.
    def part(chosen: int) -> Column:
        place = lambda t: F.array_position("tokens", t).cast("int") - 1
        return F.filter("tokens", lambda t: F.call_function("bit_get", F.lit(chosen), place(t)) == 1)

    parts = F.array(*map(part, range(1, 2**limits.longest)))
    real = F.filter(F.array_distinct(parts), lambda p: (F.size(p) > 0) & (F.size(p) < F.col("size")))
    shorter = rules.select(F.col("tokens").alias("part"), F.col("confidence").alias("part_confidence"))
    covered = (
        rules.select("tokens", "confidence", F.explode(real).alias("part"))
        .join(shorter, "part")
        .where(F.col("part_confidence") >= F.col("confidence"))
        .select("tokens")
        .distinct()
    )
    return rules.join(covered, "tokens", "left_anti")


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Best mined rule of each distinct URL that has one: url, tokens, confidence.

    The inverted index holds every rule once, under its least frequent token.
    """
    held = materialize(rules, "url_rules")
    token_count = (
        held.select(F.explode("tokens").alias("token"), "count").groupBy("token").agg(F.max("count").alias("n"))
    )
    keyed = (
        held.withColumn("id", F.concat_ws("\x00", "tokens"))
        .select("*", F.explode("tokens").alias("token"))
        .join(token_count, "token")
        .groupBy("id")
        .agg(
            F.first(F.struct("tokens", "confidence")).alias("r"),
            F.min(F.struct("n", "token")).getField("token").alias("token"),
        )
        .select("token", "r.tokens", "r.confidence")
    )
    distinct = urls.select("url").where(F.col("url").isNotNull()).distinct()
    of_url = distinct.withColumn("of_url", url_tokens(F.col("url")))
    found = (
        of_url.select("url", "of_url", F.explode("of_url").alias("token"))
        .join(keyed, "token")
        .where(F.size(F.array_except("tokens", "of_url")) == 0)
        .select("url", "tokens", "confidence")
    )
    order = F.struct("confidence", F.size("tokens"), F.concat_ws(" ", "tokens"))
    return found.groupBy("url").agg(
        F.max_by(F.struct("tokens", "confidence"), order).alias("r")
    ).select("url", "r.tokens", "r.confidence")


def judge_urls(
    pages: DataFrame,
    labelled: DataFrame,
    key: str = "page_id",
    url: str = "url",
    policy: Sequence[Policy] = POLICY,
    limits: Limits = Limits(),
) -> DataFrame:
    """key, url, host, path, rule, verdict, mined_rule and mined_confidence of each page."""
    rows = pages.select(F.col(key), F.col(url).alias("url"))
    best = match_rules(rows, mine_rules(labelled, limits)).select(
        "url",
        F.concat_ws(" ", "tokens").alias("mined_rule"),
        F.col("confidence").alias("mined_confidence"),
    )
    host, path = url_host(F.col("url")), url_path(F.col("url"))
    judged = rows.join(best, "url", "left").withColumn("_fit", policy_rule(host, path, policy))
    mined = F.when(F.col("mined_rule").isNotNull(), "block").otherwise("allow")
    return judged.select(
        F.col(key),
        "url",
        host.alias("host"),
        path.alias("path"),
        F.col("_fit.rule").alias("rule"),
        F.coalesce(F.col("_fit.verdict"), mined).alias("verdict"),
        "mined_rule",
        "mined_confidence",
    )


def labels_by_number(pages: DataFrame, labels: DataFrame, url: str = "url") -> DataFrame:
    """Labelled token sets: a page's path ends in the number of the document it shows.

    Bad: the document's quality is 0 or it is toxic. Several labels of a document
    count as bad if one is; a label with neither value is no label.
    """
    number = F.regexp_extract(url_path(F.col(url)), "/([0-9]{1,18})(?:[.][a-z]+)?/?$", 1)
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    of_doc = labels.groupBy("doc_id").agg(F.max(F.coalesce(bad, F.col("quality") == 0, F.col("toxic") == 1)).alias("bad"))
    of_page = pages.select(
        url_tokens(F.col(url)).alias("tokens"),
        F.when(number != "", number.cast("long")).alias("doc_id"),
    )
    return of_page.join(of_doc, "doc_id").select("tokens", "bad")
