"""URL filtering by listed rules and by association rules mined from labelled URLs.

Listed rules (host, path, verdict) decide first. Their verdicts also label the URLs they fit; FP-growth mines combinations of
URL tokens that go with a label, and combinations that pass support, confidence and a check against simpler ones become
rules for all other URLs. A rule is looked up under its rarest token, so a URL only meets rules it may fit.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import combinations, product

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideway.llm.common import shield

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Everything before the first "://" is skipped; then host and path.
PARTS = "(?s)^.*?://([^/?#]*)([^?#]*)"
LABEL = "verdict="


@dataclass(frozen=True)
class ListedRule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


@dataclass(frozen=True)
class MinedRule:
    tokens: frozenset[str]
    verdict: str
    confidence: float
    support: float

    def order(self) -> tuple:
        """Better rules first: confidence, support, more tokens, block before allow, then by name."""
        return -self.confidence, -self.support, -len(self.tokens), self.verdict != "block", sorted(self.tokens)


def host_of(url: Column) -> Column:
    """Host with A-Z in lower case; empty without "://" or for null."""
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """Path without query and fragment; empty without "://" or for null."""
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def tokens_of(host: Column, path: Column) -> Column:
    """Distinct tokens of a URL: ending, domain, host labels, path words with digits as one sign, and the file ending."""
    labels = F.array_remove(F.split(host, "\\."), "")
    n = F.size(labels)
    words = F.array_remove(F.split(F.regexp_replace(F.translate(path, UPPER, LOWER), "[0-9]+", "#"), "[/.]+"), "")
    return F.array_distinct(
        F.concat(
            F.transform(F.slice(labels, F.greatest(n, F.lit(1)), 1), lambda x: F.concat(F.lit("end="), x)),
            F.transform(
                F.array(F.array_join(F.slice(labels, F.greatest(n - 1, F.lit(1)), 2), ".")), lambda x: F.concat(F.lit("domain="), x)
            ),
            F.transform(F.slice(labels, 1, F.greatest(n - 2, F.lit(0))), lambda x: F.concat(F.lit("label="), x)),
            F.transform(words, lambda x: F.concat(F.lit("path="), x)),
        )
    )


def listed_rule(rules: list[ListedRule], host: Column, path: Column) -> tuple[Column, Column]:
    """(name, verdict) of the longest rule that fits; null if none does."""
    name = verdict = None
    for rule in sorted(rules, key=lambda r: (-len(r.name), r.name)):
        fits = rule.fits(host, path)
        name = F.when(fits, rule.name) if name is None else name.when(fits, rule.name)
        verdict = F.when(fits, rule.verdict) if verdict is None else verdict.when(fits, rule.verdict)
    none = F.lit(None).cast("string")
    return (none, none) if name is None else (name, verdict)


def prune(rules: list[MinedRule], confidence: float, support: float, longest: int) -> list[MinedRule]:
    """Rules that pass the thresholds and beat every rule of the same verdict made of fewer of their tokens."""
    passed = {(r.tokens, r.verdict): r for r in rules if r.confidence >= confidence and r.support >= support and len(r.tokens) <= longest}
    kept = []
    for (tokens, verdict), rule in passed.items():
        simpler = (frozenset(c) for k in range(1, len(tokens)) for c in combinations(sorted(tokens), k))
        if not any((s, verdict) in passed and passed[s, verdict].confidence >= rule.confidence for s in simpler):
            kept.append(rule)
    return sorted(kept, key=MinedRule.order)


def mine_rules(
    labelled: DataFrame, support: float = 0.005, confidence: float = 0.9, longest: int = 3, parts: int | None = None
) -> list[MinedRule]:
    """Pruned rules from ``labelled`` (tokens, verdict).

    Tokens that occur in the same rows are one item for FP-growth: a rule over several of them says no more than over one and
    would be pruned, so nothing is lost, and a URL of many words that repeats has few items, not 2^words combinations. Each
    rule is then given for every token of its items. Their number is bounded by the support threshold and the tokens of a
    URL, not by the table: a token set that has the support takes that share of the rows. Null tokens or verdicts count for
    no rule; an empty table gives none.
    """
    labelled = labelled.filter("tokens is not null and verdict is not null")
    n = labelled.count()
    alike = items_alike(labelled, max(1, math.ceil(support * n))) if n else {}
    if not alike:
        return []
    items = labelled.select(
        F.array_append(F.array_intersect("tokens", F.array(*map(F.lit, alike))), F.concat(F.lit(LABEL), "verdict")).alias("items")
    )
    growth = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence)
    model = (growth.setNumPartitions(parts) if parts else growth).fit(items)
    found = model.associationRules.filter(
        F.element_at("consequent", 1).startswith(LABEL) & (F.size("antecedent") <= longest) & (F.col("support") >= support)
    )
    rules = [
        MinedRule(frozenset(r["antecedent"]), r["consequent"][0].removeprefix(LABEL), r["confidence"], r["support"])
        for r in found.select("antecedent", "consequent", "confidence", "support").collect()
    ]
    kept = prune([r for r in rules if not any(t.startswith(LABEL) for t in r.tokens)], confidence, support, longest)
    named = (replace(r, tokens=frozenset(t)) for r in kept for t in product(*[alike[x] for x in r.tokens]))
    return sorted(named, key=MinedRule.order)


def items_alike(labelled: DataFrame, least: int) -> dict[str, list[str]]:
    """Tokens of at least ``least`` rows, under the smallest of those that occur in the same rows.

    Rows are told apart by two hashes of their tokens; a token's rows by the sums of both. The result has at most the
    number of tokens of a URL over the support.
    """
    whole = F.array_sort("tokens")
    rows = labelled.select(
        F.explode(F.array_distinct("tokens")).alias("token"),
        F.xxhash64(F.lit(1), whole).cast("decimal(38,0)").alias("a"), F.xxhash64(F.lit(2), whole).cast("decimal(38,0)").alias("b"),
    )
    seen = rows.groupBy("token").agg(F.count("*").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b")).filter(F.col("n") >= least)
    groups = seen.groupBy("n", "a", "b").agg(F.array_sort(F.collect_list("token")).alias("tokens"))
    return {r.tokens[0]: r.tokens for r in groups.select("tokens").collect()}


def inverted_index(rules: list[MinedRule]) -> dict[str, list[MinedRule]]:
    """Rules under their rarest token, best first."""
    seen = Counter(t for r in rules for t in r.tokens)
    index = defaultdict(list)
    for rule in sorted(rules, key=MinedRule.order):
        index[min(rule.tokens, key=lambda t: (seen[t], t))].append(rule)
    return dict(index)


def best_rule(index: dict[str, list[MinedRule]], tokens: list[str]) -> MinedRule | None:
    """The best rule all of whose tokens are there."""
    have = set(tokens)
    met = (next((r for r in index[t] if r.tokens <= have), None) for t in have if t in index)
    return min((r for r in met if r is not None), key=MinedRule.order, default=None)


def judge_urls(
    df: DataFrame, rules: list[ListedRule], url_col: str = "url", keep: list[str] | None = None,
    support: float = 0.005, confidence: float = 0.9, longest: int = 3, otherwise: str = "allow",
) -> DataFrame:
    """``keep`` (all columns by default) plus host, path, rule, verdict, mined (the mined rule's tokens) and confidence.

    The longest listed rule that fits decides; else the best mined rule; else ``otherwise``. A null URL or one without
    "://" has empty host and path and meets no rule. Ties between mined rules go by support, tokens, block before allow
    and name. Repeated rows are judged alike; an empty table gives an empty result; without labelled URLs nothing is
    mined. Columns named like an added one are replaced. Rows do not move, so hot hosts do not matter.
    """
    added = ("host", "path", "rule", "verdict", "mined", "confidence")
    keep = df.columns if keep is None else keep
    df, back = shield(df, "_ur_")
    own = [c if c in df.columns else f"own {c}" for c in keep if c.lower() not in added]
    url = F.col(f"`{url_col}`").cast("string")
    split = df.withColumns({"_ur_host": host_of(url), "_ur_path": path_of(url)})
    host, path = F.col("_ur_host"), F.col("_ur_path")
    name, verdict = listed_rule(rules, host, path)
    placed = split.select(
        *[F.col(f"`{c}`") for c in own], host.alias("host"), path.alias("path"), name.alias("rule"), verdict.alias("verdict"),
        tokens_of(host, path).alias("_ur_tokens"),
    )
    labelled = placed.filter("verdict is not null").select(F.col("_ur_tokens").alias("tokens"), "verdict")
    mined = mine_rules(labelled, support, confidence, longest)
    index = inverted_index(mined)
    schema = T.StructType(
        [df.schema[c] for c in own]
        + [T.StructField(c, T.StringType()) for c in ("host", "path", "rule", "verdict")]
        + [T.StructField("mined", T.ArrayType(T.StringType())), T.StructField("confidence", T.DoubleType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *rest, verdicts, tokens = batch.columns
            found = [None if v is not None else best_rule(index, t) for v, t in zip(verdicts.to_pylist(), tokens.to_pylist())]
            final = [v if v is not None else r.verdict if r else otherwise for v, r in zip(verdicts.to_pylist(), found)]
            yield pa.RecordBatch.from_arrays(
                [*rest, pa.array(final, pa.string()),
                 pa.array([sorted(r.tokens) if r else None for r in found], pa.list_(pa.string())),
                 pa.array([r.confidence if r else None for r in found], pa.float64())],
                names=[*own, *added],
            )

    return back(placed.mapInArrow(run, schema))
