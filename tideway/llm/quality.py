"""Quality rules as weak supervision, in DataFrame operations only.

Each rule looks at one measure of a text and votes good (1), bad (-1) or abstains (0). Expectation-maximisation over the
counted vote patterns (at most 3 to the number of rules, whatever the corpus) estimates how often each rule is right about
good and about bad texts, and the posterior probability of quality decides in place of all-must-pass filtering.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideway.llm.common import SPACES, shield, text_of, words_of
from tideway.session import materialise

#: Names of the measures a rule may use; all are longs.
MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stutters", "n_upper", "n_letters",
    "n_exclaims",
)
#: Width of the word windows that count as repeats.
WINDOW = 8


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, whatever the optimiser does to projections."""
    return F.transform(F.array(value), body)[0]


def _pairs(left: Column, step: int) -> Column:
    """Hashes of each element with the one ``step`` further on; shorter by ``step``."""
    return _let(
        left,
        lambda x: F.zip_with(
            F.slice(x, 1, F.greatest(F.size(x) - step, F.lit(0))),
            F.slice(x, step + 1, F.greatest(F.size(x) - step, F.lit(0))),
            lambda a, b: F.xxhash64(a, b),
        ),
    )


def repeated_words(words: Column) -> Column:
    """Words inside windows of eight that occur twice or more in the text, first ones included.

    Windows are compared by 64-bit hashes of their words. Equal windows are found by one sort, covered words by the gaps
    between the starts of repeated windows, so the cost is n log n for any text.
    """

    def covered(hashes: Column) -> Column:
        marked = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            n = F.size(s)
            flags = F.transform(
                s,
                lambda x, k: F.when(
                    ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | ((k < n - 1) & (F.get(s, k + 1)["h"] == x["h"])), x["i"]
                ),
            )
            return F.array_sort(F.filter(flags, lambda i: i.isNotNull()))

        def width(p: Column) -> Column:
            gaps = F.transform(p, lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - i, F.lit(WINDOW))))
            return F.aggregate(gaps, F.lit(0).cast("long"), lambda acc, g: acc + g)

        return _let(_let(marked, starts), width)

    def windows(words: Column) -> Column:
        return _pairs(_pairs(_pairs(F.transform(words, lambda w: F.xxhash64(w)), 1), 2), 4)

    # Nearly all texts repeat no window; they stop after the distinct count.
    return F.when(F.size(words) <= WINDOW, F.lit(0).cast("long")).otherwise(
        _let(windows(words), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))
    )


def measures(text: Column) -> Column:
    """Struct of the measures of one text."""

    def found(words: Column) -> Column:
        lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.regexp_replace(x, SPACES, "")) > 0)
        stutters = F.size(
            F.filter(F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: a == b), lambda x: x)
        )
        line_counts = _let(lines, lambda x: F.struct(F.size(x).alias("all"), F.size(F.array_distinct(x)).alias("unlike")))
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.regexp_replace(text, SPACES, "")).cast("long").alias("word_chars"),
            F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
            line_counts.alias("lines"),
            repeated_words(words).alias("n_repeat_words"),
            stutters.cast("long").alias("n_stutters"),
            F.length(F.regexp_replace(text, "[^\\p{Lu}]+", "")).cast("long").alias("n_upper"),
            F.length(F.regexp_replace(text, "[^\\p{L}\\p{M}]+", "")).cast("long").alias("n_letters"),
            F.length(F.regexp_replace(text, "[^!]+", "")).cast("long").alias("n_exclaims"),
        )

    return _let(words_of(text), found)


@dataclass(frozen=True)
class Rule:
    """Votes by a ratio of measures: bad from ``bad`` on, good up to ``good``, abstains between or when ``per`` is zero.

    With ``bad < good`` the sense is turned: bad up to ``bad``, good from ``good`` on.
    """

    name: str
    measure: str
    per: str | None
    good: float
    bad: float

    def vote(self) -> Column:
        value = F.try_divide(F.col(self.measure), F.col(self.per) if self.per else F.lit(1))
        up = self.bad > self.good
        is_bad = value >= self.bad if up else value <= self.bad
        is_good = value <= self.good if up else value >= self.good
        return F.when(is_bad, -1).when(is_good, 1).otherwise(0)


RULES = (
    Rule("symbols", "n_symbols", "n_words", 0.05, 0.3),
    Rule("repeats", "n_repeat_words", "n_words", 0.05, 0.25),
    Rule("same_lines", "n_dup_lines", "n_lines", 0.1, 0.5),
    Rule("stutter", "n_stutters", "n_words", 0.05, 0.3),
    Rule("shouting", "n_upper", "n_letters", 0.2, 0.5),
    Rule("exclaims", "n_exclaims", "n_words", 0.05, 0.5),
    Rule("letters", "n_letters", "word_chars", 0.94, 0.88),
    Rule("length", "n_words", None, 60, 19),
    Rule("short_words", "word_chars", "n_words", 3, 2),
    Rule("long_words", "word_chars", "n_words", 10, 15),
)
#: Share of good texts, and how often a rule's vote is bad for good and for bad texts, as believed before any data: rules
#: seldom accuse a good text, and each kind of bad text trips few rules. The weight is in votes for each vote seen.
PRIOR_GOOD, ACCUSE_GOOD, ACCUSE_BAD = 0.85, 0.01, 0.35
PRIOR_WEIGHT = 0.2


@dataclass(frozen=True)
class VoteModel:
    """Share of good texts and, per rule, the chance that a cast vote is bad for good and for bad texts."""

    good: float
    accuse_good: tuple[float, ...]
    accuse_bad: tuple[float, ...]
    rounds: int = 0

    def accuracy(self) -> list[tuple[float, float]]:
        """Per rule: how often its vote is right about good and about bad texts."""
        return [(1 - g, b) for g, b in zip(self.accuse_good, self.accuse_bad)]

    def posterior(self, votes: list[str]) -> Column:
        """Probability that a text with these votes is good."""
        log_odds = F.lit(math.log(self.good / (1 - self.good)))
        for name, g, b in zip(votes, self.accuse_good, self.accuse_bad):
            log_odds = log_odds + F.when(F.col(name) < 0, math.log(g / b)).when(
                F.col(name) > 0, math.log((1 - g) / (1 - b))
            ).otherwise(0.0)
        return 1 / (1 + F.exp(-log_odds))


def fit_votes(patterns: DataFrame, votes: list[str], rounds: int = 50, tolerance: float = 1e-5) -> VoteModel:
    """Expectation-maximisation over counted patterns (votes, n); each round is one aggregate of the small table."""
    k = len(votes)
    model = VoteModel(PRIOR_GOOD, (ACCUSE_GOOD,) * k, (ACCUSE_BAD,) * k)
    for done in range(1, rounds + 1):
        q, n = F.col("q"), F.col("n")
        sums = [F.sum(n).alias("all"), F.sum(n * q).alias("good")]
        for i, v in enumerate(votes):
            cast, against = F.col(v) != 0, F.col(v) < 0
            for name, w in (("g", n * q), ("b", n * (1 - q))):
                sums.append(F.sum(F.when(cast, w).otherwise(0.0)).alias(f"{name}{i}"))
                sums.append(F.sum(F.when(against, w).otherwise(0.0)).alias(f"{name}{i}x"))
        row = patterns.withColumn("q", model.posterior(votes)).agg(*sums).first()
        if not row["all"]:
            return model
        w = PRIOR_WEIGHT

        def share(part: float, cast: float, belief: float) -> float:
            return (part + w * cast * belief + belief) / (cast * (1 + w) + 1)

        new = VoteModel(
            share(row["good"], row["all"], PRIOR_GOOD),
            tuple(share(row[f"g{i}x"], row[f"g{i}"], ACCUSE_GOOD) for i in range(k)),
            tuple(share(row[f"b{i}x"], row[f"b{i}"], ACCUSE_BAD) for i in range(k)),
            done,
        )
        moved = max(abs(x - y) for x, y in zip(
            (new.good, *new.accuse_good, *new.accuse_bad), (model.good, *model.accuse_good, *model.accuse_bad)
        ))
        model = new
        if moved < tolerance:
            break
    return model


def quality(
    df: DataFrame, text_col: str = "text", keep: list[str] | None = None, rules: tuple[Rule, ...] = RULES, least: float = 0.5,
    store: bool = True,
) -> DataFrame:
    """``keep`` (all columns by default) plus the measures, base_failed, quality and kept; one row per input row.

    A text fails the base rules with fewer than 20 words or with over 30 % of its words in repeated windows of eight.
    Else it is kept if its posterior probability of quality is at least ``least``. A null text is an empty one and
    fails. Ties of the vote cannot arise (a probability decides); repeated rows are judged alike; an empty table gives an
    empty result. Columns named like an added one are replaced. The fitted accuracies are in ``quality_model``. With
    ``store`` the measured rows are written once; without it the measures are computed twice and no rows are written,
    which suits wide rows that are only filtered.
    """
    return quality_model(df, text_col, keep, rules, least, store)[0]


def quality_model(
    df: DataFrame, text_col: str = "text", keep: list[str] | None = None, rules: tuple[Rule, ...] = RULES, least: float = 0.5,
    store: bool = True,
) -> tuple[DataFrame, VoteModel]:
    """As ``quality``, with the fitted model."""
    added = (*MEASURES, "base_failed", "quality", "kept")
    votes = [f"_q_{r.name}" for r in rules]
    keep = df.columns if keep is None else keep
    df, back = shield(df, "_q")
    own = [c if c in df.columns else f"own {c}" for c in keep if c.lower() not in added]
    text = text_of(text_col)
    # The generator keeps the measures from being computed once per use.
    found = df.select(*[F.col(f"`{c}`") for c in own], F.explode(F.array(measures(text))).alias("_q"))
    found = found.select(
        *[F.col(f"`{c}`") for c in own],
        *[F.col(f"_q.{m}").alias(m) for m in MEASURES if m not in ("n_dup_lines", "n_lines")],
        (F.col("_q.lines.all") - F.col("_q.lines.unlike")).cast("long").alias("n_dup_lines"),
        F.col("_q.lines.all").cast("long").alias("n_lines"),
    )
    voted = found.withColumns({v: r.vote() for v, r in zip(votes, rules)})
    if store:
        voted = materialise(voted, "votes")
    patterns = materialise(voted.groupBy(*votes).agg(F.count("*").cast("double").alias("n")), "patterns")
    model = fit_votes(patterns, votes)
    failed = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    out = voted.withColumn("base_failed", failed).withColumn("quality", model.posterior(votes))
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= least))
    return back(out.select(*[F.col(f"`{c}`") for c in own], *added)), model
