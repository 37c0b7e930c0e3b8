"""URL filters: given rules first, then association rules over URL tokens.

A labelled page is a transaction of its URL's tokens and its label. FP-growth
mines the token combinations that occur often enough; those that lead to the
label ``block`` with enough confidence become rules, and a rule is dropped when
a part of its tokens already leads there as surely. Rules are matched by an
inverted index: each is filed under its rarest token, a URL looks up its own
tokens, and what is found is kept if the URL has all of the rule's tokens.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelyard.llm.store import cut

ALLOW, BLOCK = "allow", "block"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Given:
    """A rule for a host with its subdomains and for paths that begin with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def given_rules(verdicts: dict[str, str]) -> list[Given]:
    """From texts like ``example.org/es/``: the host ends at the first slash."""
    out = []
    for text, verdict in verdicts.items():
        host, slash, path = text.partition("/")
        out.append(Given(host.translate(str.maketrans(_UPPER, _LOWER)), slash + path, verdict))
    return out


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    found = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without a host part."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def _host_rules(hosts: DataFrame, rules: Sequence[Given]) -> DataFrame:
    """``host`` and the ``rules`` for it and the domains above it, longest first."""
    listed = hosts.sparkSession.createDataFrame(
        [(r.host, r.path, r.text, r.verdict) for r in rules],
        "domain string, start string, rule string, verdict string",
    )
    labels = F.split("host", r"\.", -1)
    above = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    wide = hosts.select("host", F.explode(above).alias("domain"))
    found = wide.join(listed, "domain").select(
        "host", F.struct(F.length("rule").alias("n"), "rule", "start", "verdict").alias("r")
    )
    return found.groupBy("host").agg(F.sort_array(F.collect_list("r"), asc=False).alias("rules"))


def apply_given(urls: DataFrame, rules: Sequence[Given]) -> DataFrame:
    """All columns of ``urls`` (with ``host`` and ``path``) plus ``rule`` and ``rule_verdict``.

    Among the rules that fit, the longest decides; of two equally long the one
    later in order of text.
    """
    hosts = urls.select("host").distinct()
    # A host may hold a third of all rows: the third key, always 0, has both sides
    # shuffled for this join, so that adaptive execution can split it.
    zero = F.pmod(F.xxhash64("host"), F.lit(1))
    known = _host_rules(hosts, rules).withColumn("_z", zero)
    both = urls.withColumn("_z", zero).join(known, ["host", "_z"], "left")
    fits = F.filter("rules", lambda r: F.startswith(F.col("path"), r["start"]))
    best = F.get(fits, F.lit(0))
    return both.select(
        *urls.columns, best["rule"].alias("rule"), best["verdict"].alias("rule_verdict")
    )


def tokens(host: Column, path: Column, url: Column) -> Column:
    """Distinct tokens of a URL: the host and the domains above it, words of the host, path
    segments, the ending, parts of the query, the fragment, the scheme; digits of all but
    the host are alike."""
    labels = F.filter(F.split(host, r"\.", -1), lambda x: x != "")
    above = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(labels), F.lit(1))),
        lambda i: F.concat(F.lit("host:"), F.array_join(F.slice(labels, i, F.size(labels) + 1), ".")),
    )
    words = F.transform(
        F.filter(F.split(host, r"[^a-z]+", -1), lambda x: x != ""),
        lambda x: F.concat(F.lit("word:"), x),
    )
    segments = F.transform(
        F.filter(F.split(path, "/", -1), lambda x: x != ""),
        lambda x: F.concat(F.lit("path:"), F.regexp_replace(x, r"\d+", "0")),
    )
    ending = F.regexp_extract(path, r"\.([A-Za-z0-9]{1,8})$", 1)
    query = F.transform(
        F.filter(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&", -1), lambda x: x != ""),
        lambda x: F.concat(F.lit("query:"), F.regexp_replace(x, r"\d+", "0")),
    )
    fragment = F.regexp_extract(url, "#(.*)$", 1)
    single = F.array(
        F.concat(F.lit("host:"), host),
        F.when(ending != "", F.concat(F.lit("ending:"), ending)),
        F.when(fragment != "", F.concat(F.lit("fragment:"), F.regexp_replace(fragment, r"\d+", "0"))),
        F.concat(F.lit("scheme:"), F.regexp_extract(url, "^((?s:.*?))://", 1)),
    )
    return F.array_distinct(F.filter(F.concat(above, words, segments, query, single), lambda x: x.isNotNull()))


@dataclass(frozen=True)
class Mining:
    """Least share and number of labelled URLs with the combination, and least confidence.

    Without a least number a few labelled URLs would make every combination of
    their tokens frequent.
    """

    min_support: float = 0.002
    min_count: int = 20
    min_confidence: float = 0.8
    # Longest combination of tokens, if any.
    max_tokens: int | None = None


_LABEL = "label:block"


def same_tokens(urls: DataFrame, least: int = 1) -> DataFrame:
    """``token`` and ``same``, the first of the tokens that occur in exactly the same rows of
    ``urls`` (``tokens``), told by number and hashes of the rows; of tokens in ``least`` rows."""
    row = [F.xxhash64(F.lit(seed), "tokens").cast("decimal(38,0)").alias(f"h{seed}") for seed in (1, 2)]
    each = urls.select(F.explode("tokens").alias("token"), *row).groupBy("token").agg(
        F.count("*").alias("n"), F.sum("h1").alias("h1"), F.sum("h2").alias("h2")
    )
    each = cut(each.where(F.col("n") >= least))
    first = each.groupBy("n", "h1", "h2").agg(F.min("token").alias("same"))
    return cut(each.join(first, ["n", "h1", "h2"]).select("token", "same"))


def mine(urls: DataFrame, settings: Mining = Mining()) -> DataFrame:
    """Rules from labelled URLs (``tokens``, ``blocked`` boolean): ``rule``, ``antecedent``,
    ``alternatives``, ``anchors``, ``confidence`` and ``support``.

    Tokens that occur in exactly the same labelled URLs would only multiply
    combinations: one of them is mined, and ``alternatives`` has per token of the
    antecedent all that stand for it. A URL has the token if it has any of these,
    which are the rules that mining all of them would give.

    Every labelled URL counts. Numbers of rules are bounded by ``min_support``:
    a rule needs that share of all labelled URLs.
    """
    spark = urls.sparkSession
    empty = (
        "rule long, antecedent array<string>, alternatives array<array<string>>, "
        "anchors array<string>, confidence double, support double"
    )
    n = urls.count()
    if n < max(settings.min_count, 1):
        return spark.createDataFrame([], empty)
    support = max(settings.min_support, settings.min_count / n)
    same = same_tokens(urls, max(1, math.floor(support * n)))
    # Numbered before the tokens are parted: one number per row of ``urls``.
    each = urls.withColumn("id", F.monotonically_increasing_id())
    each = each.select("id", "blocked", F.explode_outer("tokens").alias("token"))
    each = cut(each.join(same.where("token <> same").select("token"), "token", "left_anti"))
    freq = cut(
        each.where("token IS NOT NULL").groupBy("token").agg(
            F.count("*").alias("freq"), F.count_if("blocked").alias("hits")
        )
    )
    least = math.ceil(support * n)
    sure = F.col("hits") / F.col("freq")
    found = freq.where((F.col("hits") >= least) & (sure >= settings.min_confidence)).select(
        F.array("token").alias("antecedent"), sure.alias("confidence"), (F.col("hits") / n).alias("support")
    )
    allowed = urls.where(~F.col("blocked")).count()
    # A token of a longer rule must tell some allowed URLs apart: one that all of them have,
    # or none, leaves a rule no surer than without it, or alone.
    missed = F.col("freq") - F.col("hits")
    telling = freq.where((missed > 0) & (missed < allowed) & (F.col("hits") >= least)).select("token")
    if settings.max_tokens != 1 and not telling.isEmpty():
        found = found.unionByName(_longer(each, telling, support, settings))
    found = found.select(
        F.xxhash64(F.array_sort("antecedent")).alias("rule"),
        F.array_sort("antecedent").alias("antecedent"),
        "confidence",
        "support",
    )
    # A rule is dropped when a part of its tokens leads to the label as surely.
    parts = found.select("rule", "confidence", "antecedent", F.explode("antecedent").alias("token"))
    short = found.select(
        F.col("rule").alias("r2"), F.col("confidence").alias("c2"), F.col("antecedent").alias("a2")
    ).withColumn("token", F.element_at("a2", 1))
    beaten = parts.join(short, "token").where(
        "r2 <> rule AND c2 >= confidence AND size(a2) < size(antecedent) "
        "AND size(array_except(a2, antecedent)) = 0"
    )
    kept = found.join(beaten.select("rule").distinct(), "rule", "left_anti")
    # The rarest token has the fewest URLs to look at.
    rarest = kept.select("rule", F.explode("antecedent").alias("token")).join(freq, "token")
    rarest = rarest.groupBy("rule").agg(F.min_by("token", F.struct("freq", "token")).alias("anchor"))
    names = same.groupBy("same").agg(F.sort_array(F.collect_list("token")).alias("names"))
    wide = kept.select("rule", F.explode("antecedent").alias("same")).join(names, "same")
    wide = wide.join(rarest, "rule").groupBy("rule").agg(
        F.sort_array(F.collect_list(F.struct("same", "names"))).getField("names").alias("alternatives"),
        F.max(F.when(F.expr("same = anchor"), F.col("names"))).alias("anchors"),
    )
    return kept.join(wide, "rule").select(
        "rule", "antecedent", "alternatives", "anchors", "confidence", "support"
    )


def _longer(each: DataFrame, telling: DataFrame, support: float, settings: Mining) -> DataFrame:
    """Rules of two tokens or more, by FP-growth over the tokens that can be part of one.

    ``each`` has a row per URL (``id``, ``blocked``) and ``token``; URLs without such a token
    stay, as they count for the support.
    """
    told = each.join(telling.withColumn("_telling", F.col("token")), "token", "left")
    baskets = told.groupBy("id").agg(
        F.any_value("blocked").alias("blocked"), F.collect_set("_telling").alias("tokens")
    )
    baskets = cut(
        baskets.select(
            F.when(F.col("blocked"), F.concat("tokens", F.array(F.lit(_LABEL))))
            .otherwise(F.col("tokens"))
            .alias("items")
        )
    )
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=settings.min_confidence).fit(baskets)
    found = model.associationRules.where(F.col("consequent") == F.array(F.lit(_LABEL)))
    found = found.where(F.size("antecedent") > 1)
    if settings.max_tokens is not None:
        found = found.where(F.size("antecedent") <= settings.max_tokens)
    return found.select("antecedent", "confidence", "support")


def match(urls: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """``key``, and the surest rule that matches: ``antecedent``, as the URL's own tokens, and
    ``confidence``."""
    rules = rules.withColumn("anchor", F.explode("anchors")).drop("antecedent")
    asked = urls.select(key, "tokens", F.explode("tokens").alias("anchor"))
    met = asked.join(rules, "anchor")
    met = met.where(F.forall("alternatives", lambda x: F.arrays_overlap(x, "tokens")))
    own = F.transform("alternatives", lambda x: F.array_min(F.array_intersect(x, F.col("tokens"))))
    met = met.withColumn("antecedent", own)
    best = F.struct("confidence", "support", "antecedent")
    return met.groupBy(key).agg(F.max(best).alias("best")).select(
        key, F.col("best.antecedent").alias("antecedent"), F.col("best.confidence").alias("confidence")
    )


def judge(
    pages: DataFrame,
    labels: DataFrame,
    rules: Sequence[Given],
    settings: Mining = Mining(),
) -> DataFrame:
    """Per row of ``pages`` its ``page_id``, ``host``, ``path``, ``rule``, ``verdict``,
    and ``antecedent`` and ``confidence`` of the mined rule that matched, if any.

    ``labels`` has ``page_id`` and ``blocked``; an id with both labels, and rows
    with a null, are not labelled. The given rule's verdict holds; without one, a
    URL that matches a mined rule is blocked and every other is allowed.

    A null url or one without ``://`` has an empty host and path, no given rule
    and no tokens, and is allowed. Rows that repeat an id and url are answered
    once each. Other columns take no part; empty tables give empty results.
    """
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"))
    parted = rows.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    ruled = apply_given(parted, rules)
    # Equal URLs have equal tokens, so matching goes by distinct URLs.
    token_list = F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(
        tokens(F.col("host"), F.col("path"), F.col("url"))
    )
    known = labels.where("page_id IS NOT NULL AND blocked IS NOT NULL").groupBy("page_id").agg(
        F.bool_and("blocked").alias("blocked"), F.bool_or("blocked").alias("_any")
    )
    known = known.where("blocked = _any").select("page_id", "blocked")
    labelled = parted.where("host <> ''").join(known, "page_id").select(
        token_list.alias("tokens"), "blocked"
    )
    mined = mine(labelled, settings)
    urls = parted.where("host <> ''").select("url", "host", "path").distinct()
    found = match(urls.select("url", token_list.alias("tokens")), mined, "url")
    zero = F.pmod(F.xxhash64("url"), F.lit(1))
    both = ruled.withColumn("_z", zero).join(found.withColumn("_z", zero), ["url", "_z"], "left")
    method = F.when(F.col("confidence").isNotNull(), F.lit(BLOCK)).otherwise(F.lit(ALLOW))
    return both.select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("rule_verdict", method).alias("verdict"),
        "antecedent",
        "confidence",
    )
