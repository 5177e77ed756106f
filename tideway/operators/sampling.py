"""Samples, splits and draws that give the same rows on any cluster and partitioning."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideway.functions.hashing import keyed_hash, keyed_pick, keyed_uniform, uniform_between
from tideway.functions.normal import normal_cdf, normal_ppf
from tideway.functions.scalar import at_least, at_most, edge_class, wrap_angle
from tideway.operators.columns import computed
from tideway.operators.ranking import hash_slice, rank_within
from tideway.session import materialise


def take_smallest(
    df: DataFrame, score: Column, n: int | Column, tie: Sequence[str], slice_by: Column
) -> DataFrame:
    """The ``n`` rows with the smallest (score, tie), without a global sort.

    Slice counts tell which slice holds the n-th row. Earlier slices are kept whole and only
    that one slice is ranked.
    """
    n = F.lit(n) if isinstance(n, int) else n
    rows = df.withColumns({"__score": score, "__slice": slice_by.cast("long")})
    counts = rows.groupBy("__slice").agg(F.count(F.lit(1)).alias("__n"))
    over = Window.partitionBy(F.lit(0)).orderBy("__slice")  # one row per slice
    counts = counts.withColumn("__end", F.sum("__n").over(over))
    counts = counts.withColumn("__left", n - (F.col("__end") - F.col("__n")))
    kept = rows.join(counts.filter(F.col("__left") > 0).select("__slice", "__n", "__left"), "__slice")
    whole = kept.filter(F.col("__n") <= F.col("__left"))
    border = kept.filter(F.col("__n") > F.col("__left"))
    border = border.withColumn(
        "__r", F.row_number().over(Window.partitionBy("__slice").orderBy("__score", *tie))
    ).filter(F.col("__r") <= F.col("__left"))
    return whole.select(*df.columns).unionByName(border.select(*df.columns))


def sample_rows(
    df: DataFrame, n: int, key: Sequence[str], seed: int = 0, score: Column | None = None,
    slice_by: Column | None = None,
) -> DataFrame:
    """``n`` rows, chosen by a hash of their key (or by ``score``)."""
    if score is None:
        score = keyed_hash(seed, *key)
        slice_by = hash_slice(score)
    if slice_by is None:
        raise ValueError("a score of your own needs its slices")
    return take_smallest(df, score, n, key, slice_by)


def split_keys(
    df: DataFrame, key: str, fraction: float, seed: int = 0, score: Column | None = None,
    slice_by: Column | None = None, name: str = "_train",
) -> DataFrame:
    """Distinct keys with a train flag: exactly floor(fraction * n) of them are held out."""
    keys = df.select(key).distinct()
    n = keys.agg(F.floor(F.lit(fraction) * F.count(F.lit(1))).alias("n")).scalar()
    if score is None:
        score = keyed_hash(seed, key)
        slice_by = hash_slice(score)
    test = take_smallest(keys, score, n, [key], slice_by).withColumn("__test", F.lit(True))
    return keys.join(test, key, "left").select(key, F.col("__test").isNull().alias(name))


def split_by_modulus(df: DataFrame, key: str, modulus: int = 3, name: str = "_train") -> DataFrame:
    """Hold out every ``modulus``-th individual id."""
    return df.withColumn(name, F.pmod(F.col(key), F.lit(modulus)) != 0)


def assign_shards(
    df: DataFrame, key: Sequence[str], train_shards: int, test_shards: int, train: str = "_train",
    name: str = "_shard", pick: Callable[..., Column] | None = None, seed: int = 0,
) -> DataFrame:
    """Shard number inside each split, the same for all rows of one key."""
    number = (pick or (lambda *c: keyed_pick(seed, *c)))(*[F.col(k) for k in key])
    size = F.when(F.col(train), F.lit(train_shards)).otherwise(F.lit(test_shards))
    return df.withColumn(name, F.pmod(number, size))


def depth_class(
    df: DataFrame, depth: str, classes: Sequence[float], key: Sequence[str] = (), seed: int = 0,
    uniform: Column | None = None, name: str = "depth_class", mode: str = "draw",
    relative_sd: float = 0.08 / 1.96,
) -> DataFrame:
    """Class of a depth reading that stands for an interval.

    ``mode="draw"`` takes the true depth as normal around the reading, cuts it at the last
    class and bins it: the same law as drawing a class from renormalised bin probabilities,
    with one quantile per row instead of one CDF per class. A zero reading gives the first
    class, null and NaN none. ``mode="edge"`` bins the reading itself.
    """
    if mode == "edge":
        return df.withColumn(name, edge_class(depth, classes))
    u = uniform if uniform is not None else keyed_uniform(seed, *key)
    last = float(classes[-1])
    out = df.withColumns({"__sd": F.col(depth) * relative_sd, "__u": u})
    z = (F.lit(last) - F.col(depth)) / F.nullif(F.col("__sd"), F.lit(0.0))
    out = computed(computed(out, {"__z": z}), {"__top": normal_cdf(F.col("__z"))})
    # keep the argument inside (0, 1): u may be 0
    p = at_most(at_least(F.col("__u") * F.col("__top"), 1e-300), 1 - 2.0**-53)
    out = computed(out, {"__p": p})
    drawn = F.col(depth) + F.col("__sd") * normal_ppf(F.col("__p"))
    out = computed(out, {"__x": drawn}).withColumn("__d", at_most("__x", last))
    klass = F.when(F.col("__sd") == 0, F.lit(float(classes[0]))).otherwise(
        edge_class(F.col("__d"), classes)
    )
    klass = F.when(~F.isnan(F.col(depth).cast("double")), klass)
    return out.withColumn(name, klass).drop("__sd", "__u", "__z", "__top", "__p", "__x", "__d")


def class_probabilities(df: DataFrame, depth: str, classes: Sequence[float], name: str = "p") -> DataFrame:
    """One row per class with its probability under the same law, for inspection."""
    c = F.array(*[F.lit(float(k)) for k in classes])
    sd = F.nullif(F.col(depth) * (0.08 / 1.96), F.lit(0.0))
    out = df.select("*", F.posexplode(c).alias("__i", "depth_class"))
    previous = F.when(F.col("__i") > 0, F.element_at(c, F.greatest(F.col("__i"), F.lit(1))))
    out = out.withColumns(
        {
            "__z": (F.col("depth_class") - F.col(depth)) / sd,
            "__y": (previous - F.col(depth)) / sd,
            "__t": (F.lit(float(classes[-1])) - F.col(depth)) / sd,
        }
    )
    mass = normal_cdf(F.col("__z")) - F.coalesce(normal_cdf(F.col("__y")), F.lit(0.0))
    p = F.when(F.col("__z").isNull(), (F.col("__i") == 0).cast("double")).otherwise(
        mass / normal_cdf(F.col("__t"))
    )
    return out.withColumn(name, p).drop("__i", "__z", "__y", "__t")


JITTERS: Mapping[str, Callable[[Column, Column], Column]] = {
    "multiply": lambda x, d: x * (1.0 + d),
    "add": lambda x, d: x + d,
    "add_floor_zero": lambda x, d: at_least(x + d, 0.0),
    "angle": lambda x, d: wrap_angle(x + d),
}


def augment(
    df: DataFrame, copies: int, jitter: Mapping[str, tuple[str, float]], key: Sequence[str],
    id_step: int, individual: str = "_individual", train: str = "_train", seed: int = 0,
    noise: Callable[[str, float, Column], Column] | None = None,
) -> DataFrame:
    """Originals plus ``copies`` jittered copies of every training individual.

    ``jitter`` maps a column to (kind, half width). Copies get ``id_step * copy`` added to
    their individual id; the step must exceed the largest id. Originals and copies come from
    one scan: each row explodes into its copy numbers, 0 being itself.
    """
    numbers = F.when(F.col(train), F.sequence(F.lit(0), F.lit(copies))).otherwise(F.array(F.lit(0)))
    out = df.withColumn("_copy", F.explode(numbers))

    def default_noise(name: str, half: float, copy: Column) -> Column:
        return uniform_between(-half, half, seed, F.lit(name), *key, copy)

    draw = noise or default_noise
    changes = {
        c: F.when(F.col("_copy") == 0, F.col(c)).otherwise(
            JITTERS[kind](F.col(c), draw(c, half, F.col("_copy")))
        )
        for c, (kind, half) in jitter.items()
    }
    changes[individual] = F.col(individual) + F.col("_copy") * F.lit(id_step)
    return out.withColumns(changes)


def contrasts(
    df: DataFrame, decisions_per_individual: int, alternatives_per_decision: int,
    individual: str = "_individual", decision: str = "_decision", choice: str = "_choice",
    selected: str = "_selected", features: Sequence[str] = (), seed: int = 0,
    pick: Callable[..., Column] | None = None, order: Column | None = None,
    parts: int | None = None,
) -> DataFrame:
    """Balanced (selected, unselected) pairs, drawn with replacement.

    Every individual gives the same number of decision draws and every draw the same number
    of alternatives, so long histories and wide decisions carry no extra weight. A draw is an
    index into ranks: decisions are ranked per individual by a number (an individual may hold
    any share of the data), alternatives per decision by their choice.

    Choices are gathered once into a row per decision, which holds as many as its class list or
    its cells in reach, whatever the table holds. Draws meet these rows, and become pairs only
    then, so an exchange moves a row per draw and none per pair.

    ``pick(tag, *cols)`` gives a non-negative long that is reduced modulo the group size;
    ``order`` is the number that ranks the decisions. Both default to seeded hashes.
    """
    pick = pick or (lambda tag, *cols: keyed_pick(seed, F.lit(tag), *cols))
    if order is None:
        order = keyed_hash(seed, individual, decision)
    chosen = F.col(selected)
    one = F.struct(F.col(choice).alias("c"), *[F.col(f).alias(f"f{i}") for i, f in enumerate(features)])
    offered = (
        df.filter(chosen.isNotNull())
        .groupBy(individual, decision)
        .agg(
            F.collect_list(F.when(chosen, one)).alias("__sel"),
            F.sort_array(F.collect_list(F.when(~chosen, one))).alias("__alt"),
        )
        .filter((F.size("__sel") > 0) & (F.size("__alt") > 0))
    )
    # One row per decision, written once: ranks, sizes and pairs never read the choices again.
    offered = materialise(offered, "offered")
    usable = offered.select(individual, decision)
    ranked = rank_within(
        usable.withColumn("__order", order), [individual], ["__order", decision], "__r", parts
    ).select(individual, decision, F.col("__r").cast("long").alias("__r"))
    sizes = usable.groupBy(individual).agg(F.count(F.lit(1)).alias("__size"))
    draws = sizes.withColumn(
        "_draw", F.explode(F.sequence(F.lit(0), F.lit(decisions_per_individual - 1)))
    )
    draws = draws.withColumn(
        "__r", F.pmod(pick("decision", F.col(individual), F.col("_draw")), F.col("__size")) + 1
    ).drop("__size")
    drawn = draws.join(ranked, [individual, "__r"]).drop("__r").join(offered, [individual, decision])
    pairs = drawn.withColumn(
        "_pair", F.explode(F.sequence(F.lit(0), F.lit(alternatives_per_decision - 1)))
    )
    at = F.pmod(pick("choice", F.col(individual), F.col("_draw"), F.col("_pair")), F.size("__alt").cast("long"))
    pairs = pairs.withColumn("__o", F.get("__alt", at.cast("int"))).withColumn("__s", F.explode("__sel"))

    def side(tag: str, row: str) -> list[Column]:
        return [F.col(f"{row}.c").alias(f"{tag}_choice"), *[F.col(f"{row}.f{i}").alias(f"{tag}_{f}") for i, f in enumerate(features)]]

    return pairs.select(individual, decision, "_draw", "_pair", *side("other", "__o"), *side("selected", "__s"))


def contrast_decisions(
    pairs: DataFrame, features: Sequence[str], individual: str = "_individual",
    decision: str = "_decision",
) -> DataFrame:
    """Pairs in long form: two choices per contrast, keyed by (individual, draw, pair)."""
    side = lambda tag, flag: F.struct(
        F.lit(flag).alias("_selected"), F.col(f"{tag}_choice").alias("_choice"),
        *[F.col(f"{tag}_{f}").alias(f) for f in features],
    )
    return pairs.select(
        individual, decision, "_draw", "_pair",
        F.inline(F.array(side("selected", True), side("other", False))),
    )
