"""SimHash near-duplicates: fingerprints of word shingles and a self-join of their binary trie.

Fingerprints are made in Arrow batches (one hash per shingle, bit sums in numpy). Equal fingerprints collapse before
anything is compared. The top bits of the trie deal the work: a task holds one pair of subtrees whose prefixes differ
within the error budget, walks both together bit by bit, adds up differing bits and drops a pair of nodes as soon as the
budget is exceeded. A task reports each fingerprint with the smallest one it is linked to there, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideway.llm.common import shield, without
from tideway.llm.components import connected_components
from tideway.session import materialise

#: Mean fingerprints wanted in the largest subtree of a task, and the deepest cut of the trie.
SUBTREE, DEEPEST = 20_000, 16
#: Pairs of trie nodes handled at a time, and the product of sizes below which two nodes are compared directly.
FRONTIER, LEAF = 50_000, 32
FP = "_sh_fp"


def _bit_sums(h: np.ndarray) -> np.ndarray:
    """How many of the 64-bit hashes set each bit."""
    sums = np.zeros(64, np.int64)
    for at in range(0, len(h), 65536):
        sums += np.unpackbits(h[at : at + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sums


def _print_of(sums: np.ndarray, n: int) -> int:
    return int(np.packbits(sums * 2 > n, bitorder="little").view("<u8")[0])


def simhash_of(hashes: np.ndarray) -> int:
    """Unsigned 64-bit SimHash of given shingle hashes: a bit is set if over half of them set it; no hashes give zero."""
    return _print_of(_bit_sums(hashes), len(hashes))


def fingerprint(text: str | None, width: int = 3) -> int:
    """Unsigned 64-bit SimHash of the word shingles of one text, repeats included; no words give zero."""
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: only A-Z and ASCII white space
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    ends = starts + sizes
    k = max(1, len(words) - width + 1)
    first, last = starts[:k].tolist(), ends[len(words) - k :].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, k, 65536):
        h = np.array([digest(joined[a:b], 42) for a, b in zip(first[at : at + 65536], last[at : at + 65536])], "<u8")
        ones += _bit_sums(h)
    return _print_of(ones, k)


def with_fingerprint(df: DataFrame, text_col: str, name: str, width: int = 3, keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns by default) plus the fingerprint as a signed long under ``name``."""
    keep = list(df.columns) if keep is None else keep
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(name, T.LongType(), False)])
    # The text goes in under a name of its own, as kept columns may repeat it.
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").cast("string").alias("_sh_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(x.as_py(), width) for x in batch.column(batch.num_columns - 1)]
            signed = pa.array(np.array(found, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], signed], names=[*keep, name])

    return source.mapInArrow(run, schema)


class Forest:
    """Union of numbered nodes under their smallest member, link arrays at a time."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while len(a):
            ra, rb = root[a], root[b]
            low, high = np.minimum(ra, rb), np.maximum(ra, rb)
            apart = low < high
            if not apart.any():
                break
            a, b = a[apart], b[apart]
            np.minimum.at(root, high[apart], low[apart])
            while True:
                up = root[root]
                if np.array_equal(up, root):
                    break
                root[:] = up


def _cross(lo1, hi1, lo2, hi2):
    """Index pairs of each pair of ranges."""
    n1, n2 = hi1 - lo1, hi2 - lo2
    size = n1 * n2
    which = np.repeat(np.arange(len(size)), size)
    k = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
    return lo1[which] + k // n2[which], lo2[which] + k % n2[which]


def trie_links(a: np.ndarray, b: np.ndarray, depth: int, errors: int, budget: int, same: bool, link) -> None:
    """Walk two subtrees together and call ``link(i, j)`` for index pairs within the budget.

    ``a`` and ``b`` are sorted distinct uint64 with a common prefix of ``depth`` bits each (differing in ``errors`` bits);
    a node is a range of the sorted array. ``same``: both are one subtree, and each unordered pair is met once.
    """
    one = np.uint64(1)
    zero = np.zeros(1, np.int64)
    stack = [(depth, zero, zero + len(a), zero, zero + len(b), zero + errors)]
    while stack:
        d, lo1, hi1, lo2, hi2, err = stack.pop()
        if len(lo1) > FRONTIER:
            for at in range(0, len(lo1), FRONTIER):
                cut = slice(at, at + FRONTIER)
                stack.append((d, lo1[cut], hi1[cut], lo2[cut], hi2[cut], err[cut]))
            continue
        small = ((hi1 - lo1) * (hi2 - lo2) <= LEAF) | (d == 64)
        if small.any():
            i, j = _cross(lo1[small], hi1[small], lo2[small], hi2[small])
            near = np.bitwise_count(a[i] ^ b[j]) <= budget
            if same:
                near &= i < j
            link(i[near], j[near])
        rest = ~small
        lo1, hi1, lo2, hi2, err = lo1[rest], hi1[rest], lo2[rest], hi2[rest], err[rest]
        if not len(lo1):
            continue
        bit = one << np.uint64(63 - d)
        low = ~np.uint64((int(bit) << 1) - 1)
        mid1 = np.searchsorted(a, (a[lo1] & low) | bit)
        mid2 = np.searchsorted(b, (b[lo2] & low) | bit)
        below = []
        for left1, right1, left2, right2, more in (
            (lo1, mid1, lo2, mid2, 0), (mid1, hi1, mid2, hi2, 0), (lo1, mid1, mid2, hi2, 1), (mid1, hi1, lo2, mid2, 1)
        ):
            live = (left1 < right1) & (left2 < right2) & (err + more <= budget)
            if same:
                live &= left1 <= left2  # the mirrored pair is met elsewhere
            below.append((left1[live], right1[live], left2[live], right2[live], err[live] + more))
        # One wide step per level; the stack only cuts steps that are too wide.
        stack.append((d + 1, *map(np.concatenate, zip(*below))))


def trie_self_join(distinct: DataFrame, budget: int = 2) -> DataFrame:
    """(a, b): fingerprints ``fp`` of ``distinct`` and the smallest one that a task links them to, over all near pairs."""
    # At most 2**DEEPEST counts; they tell how deep the trie is cut so that its largest subtree fits a task.
    heads = distinct.groupBy(F.shiftrightunsigned("fp", 64 - DEEPEST).cast("int").alias("head")).count().collect()
    sizes = np.zeros(1 << DEEPEST, np.int64)
    for head, n in heads:
        sizes[head] = n
    cut = next((k for k in range(4, DEEPEST) if sizes.reshape(1 << k, -1).sum(axis=1).max() <= SUBTREE), DEEPEST)
    masks = [m for m in range(1 << cut) if m.bit_count() <= budget] if cut <= 12 else [
        (1 << i if i >= 0 else 0) | (1 << j if j >= 0 else 0) for i in range(-1, cut) for j in range(-1, max(i, 0))
    ]
    if cut > 12 and budget != 2:
        raise ValueError("tables this large are cut for a budget of 2 bits")
    head = F.shiftrightunsigned("fp", 64 - cut)
    other = F.explode(F.array(*[F.lit(m) for m in sorted(set(masks))])).alias("mask")
    dealt = distinct.select("fp", head.alias("head"), other).select(
        F.least("head", F.col("head").bitwiseXOR(F.col("mask"))).alias("one"),
        F.greatest("head", F.col("head").bitwiseXOR(F.col("mask"))).alias("two"),
        "fp",
    )

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        one, two = key[0].as_py(), key[1].as_py()
        fps = np.sort(group.column("fp").combine_chunks().to_numpy(zero_copy_only=False).view(np.uint64))
        split = np.searchsorted(fps >> np.uint64(64 - cut), np.uint64(two)) if two > one else 0
        forest = Forest(len(fps))
        if two == one:
            trie_links(fps, fps, cut, 0, budget, True, forest.add)
        else:
            trie_links(
                fps[:split], fps[split:], cut, (one ^ two).bit_count(), budget, False, lambda i, j: forest.add(i, j + split)
            )
        linked = np.flatnonzero(forest.root != np.arange(len(fps)))
        return pa.table({"a": fps[linked].view(np.int64), "b": fps[forest.root[linked]].view(np.int64)})

    return dealt.groupBy("one", "two").applyInArrow(run, "a long, b long")


def near_groups(prints: DataFrame, id_col: str, budget: int = 2) -> DataFrame:
    """(fp, root, component_id) of every fingerprint of ``prints`` (id, fp): the smallest id reachable over near ones."""
    distinct = materialise(prints.groupBy("fp").agg(F.min(f"`{id_col}`").alias("least")), "fingerprints")
    roots = connected_components(trie_self_join(distinct, budget)).withColumnRenamed("node", "fp")
    placed = distinct.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    placed = materialise(placed, "placed")
    least = materialise(placed.groupBy("root").agg(F.min("least").alias("component_id")), "components")
    return materialise(placed.join(least, "root").select("fp", "root", "component_id"), "groups")


def _stored_groups(df: DataFrame, id_col: str, text_col: str, width: int, budget: int, own: list[str]):
    """Rows with fingerprint and row number as a written table, the groups, and the row of each group that stays."""
    prints = with_fingerprint(df, text_col, FP, width, own).withColumn("_sh_row", F.monotonically_increasing_id())
    stored = materialise(prints, "prints", compression="zstd")
    row_id = F.col(f"`{id_col}`")
    groups = near_groups(stored.select(row_id.alias("id"), F.col(FP).alias("fp")), "id", budget).withColumnRenamed("fp", FP)
    order = F.struct(row_id.isNull().alias("none"), row_id.alias("id"), F.col("_sh_row").alias("row"))
    # Partial minima are taken before the exchange, so a large group costs one row per task.
    first = stored.join(groups, FP).groupBy("root").agg(F.min(order).alias("best")).select(F.col("best.row").alias("_sh_row"))
    return stored, groups, materialise(first, "first-rows")


def simhash_groups(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, budget: int = 2, carry: bool = True
) -> DataFrame:
    """``df`` plus fingerprint (16 hex digits), component_id (smallest id reachable) and kept; one row per input row.

    Null and empty texts have fingerprint zero and are linked like any other. A null id names a component only if all
    ids in it are null. ``kept`` marks one row per component: the smallest id (null last), and of rows that repeat it
    the first in stored order. An empty table gives an empty result. Columns of ``df`` named like an added one are replaced. ``carry=False`` returns the id and the added columns only.
    """
    df, back = shield(without(df, "fingerprint", "component_id", "kept"), "_sh_")
    own = list(df.columns) if carry else [id_col]
    stored, groups, first = _stored_groups(df, id_col, text_col, width, budget, own)
    out = stored.join(groups, FP).join(first.withColumn("_sh_first", F.lit(True)), "_sh_row", "left")
    out = out.select(
        *[F.col(f"`{c}`") for c in own],
        F.lower(F.lpad(F.hex(FP), 16, "0")).alias("fingerprint"),
        "component_id",
        F.coalesce("_sh_first", F.lit(False)).alias("kept"),
    )
    return back(out)


def simhash_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, budget: int = 2) -> DataFrame:
    """The rows of ``df`` that stay: one per component, as marked by ``kept`` of ``simhash_groups``; same columns."""
    df, back = shield(df, "_sh_")
    stored, _, first = _stored_groups(df, id_col, text_col, width, budget, list(df.columns))
    return back(stored.join(first, "_sh_row", "left_semi").drop("_sh_row", FP))
