"""All pairs of records whose sets of values overlap above a similarity threshold.

Records with the same set are one class, represented by its least id. Minwise hash signatures of the classes are cut
into bands; classes that share a band bucket are candidates. With the default 48 bands of 3 rows, a pair of Jaccard
similarity 0.6 is missed with probability (1 - 0.6^3)^48 < 9e-6, and the probability falls with similarity; verified
pairs are exact. A bucket row carries the set's size and a 64-bit sketch (each value sets one bit): sets of sizes n and
m that share s values differ in n + m - 2 s, and their sketches in no more bits, so most candidates that aren't similar
end in the join itself, and no similar pair does. What is left is made distinct and verified.

Buckets of one set, nearly all of them, are dropped before the join. A bucket can only grow without bound if every value
that made its band is frequent. Such bands are known from the values' frequencies, without counting buckets, and are cut
further by prefix tokens: sets of similarity t share one of their n - ceil(t n) + 1 first values in any fixed order, here
the frequent ones last, so each such bucket is joined per prefix value instead, and no pair is lost. All other buckets
hold at most ``frequent`` sets. Buckets of frequent values that are still large, and classes with many members, are
compared in blocks: a task meets two blocks of at most ``BLOCK`` rows, whatever the bucket's size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.operators.skew import join_states
from tessera.session import cut

MASK = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Rows of a block, about.
BLOCK = 2000


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (shift, multiply, xor) over an array; wraps around."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pairs_in_blocks(rows: DataFrame, keys: Sequence[str], size: str, id: str, match: Column | None = None, block: int = BLOCK) -> DataFrame:
    """Pairs (a, b) of rows with equal keys and a.id < b.id for which match holds, as columns a and b of structs.

    size is the number of rows with the same keys. Such rows are cut into blocks by a hash of the id, and each pair of
    blocks is a key of its own, so no task meets more than two blocks. match is a condition over a and b.
    """
    n = F.ceil(F.col(size) / block).cast("int")
    own = F.pmod(F.xxhash64(F.lit(3), id), n).cast("int")
    each = rows.select(*keys, F.struct(*rows.columns).alias("r"), own.alias("own"), F.explode(F.sequence(F.lit(0), n - 1)).alias("other"))
    cells = each.select(*keys, F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "r")
    a, b = cells.alias("x"), cells.alias("y")
    on = F.col(f"x.r.{id}") < F.col(f"y.r.{id}")
    for k in (*keys, "lo", "hi"):
        on = on & (F.col(f"x.{k}") == F.col(f"y.{k}"))
    on = on & ((F.col("x.lo") == F.col("x.hi")) | (F.col("x.own") != F.col("y.own")))
    out = a.join(b, on).select(F.col("x.r").alias("a"), F.col("y.r").alias("b"))
    return out if match is None else out.where(match)


def sets_of_lists(lists: DataFrame, min_size: int) -> DataFrame:
    """(grp, id, items) from (grp, id, items): each id's distinct values over all its lists, ascending.

    grp is an int that tells families of sets apart, id and the items are longs. NULL ids, lists and items are ignored,
    repeated values count once; sets under min_size values are left out. A set is one value of one row, so it must fit
    a task; nothing but a record's own values is gathered for it.
    """
    own = lists.where(F.col("id").isNotNull() & F.col("items").isNotNull()).select("grp", "id", F.array_distinct(F.array_compact("items")).alias("items"))
    whole = own.groupBy("grp", "id").agg(F.flatten(F.collect_list("items")).alias("items"))
    return whole.select("grp", "id", F.sort_array(F.array_distinct("items")).alias("items")).where(F.size("items") >= min_size)


def build_sets(items: DataFrame, min_size: int) -> DataFrame:
    """As sets_of_lists, from (grp, id, item), one value a row."""
    member = items.where(F.col("item").isNotNull()).select("grp", "id", "item").distinct()
    return sets_of_lists(member.groupBy("grp", "id").agg(F.collect_list("item").alias("items")), min_size)


def classes(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((grp, rep, items, copies), one row per distinct set with its least id as rep; (grp, rep, id, copies), the
    members of the sets that occur repeatedly)."""
    per_set = cut(sets.groupBy("grp", "items").agg(F.min("id").alias("rep"), F.count("*").alias("copies")))
    again = per_set.where(F.col("copies") > 1).select("grp", "items", "rep", "copies")
    members = join_states(sets.select("grp", "items", "id"), again, ["grp", "items"], "copies").select("grp", "rep", "id", "copies")
    return per_set, members


def with_frequent(reps: DataFrame, frequent: int) -> DataFrame:
    """(grp, rep, items, frequent): the values that more than ``frequent`` sets hold come last, the most frequent at the
    end, and the column frequent has their number."""
    member = reps.select("grp", "rep", F.explode("items").alias("item"))
    counts = member.groupBy("grp", "item").agg(F.count("*").alias("f")).where(F.col("f") > frequent)
    held = join_states(member, counts, ["grp", "item"], "f").groupBy("grp", "rep").agg(F.sort_array(F.collect_list(F.struct("f", "item"))).alias("hot"))
    hot = F.coalesce(F.col("hot.item"), F.array().cast("array<long>"))
    return reps.select("grp", "rep", "items").join(held, ["grp", "rep"], "left").select("grp", "rep", F.concat(F.array_except("items", hot), hot).alias("items"), F.size(hot).alias("frequent"))


def band_keys(
    offsets: np.ndarray, values: np.ndarray, frequent: np.ndarray, threshold: float, bands: int, rows: int, seed: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set number, bucket key, whether only frequent values made it) of a batch of sets given as offsets into values;
    the last frequent[i] values of set i are frequent ones."""
    n_sets = len(offsets) - 1
    if n_sets == 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, bool)
    starts, sizes = offsets[:-1], np.diff(offsets)
    base = _mix(values.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    hot = np.zeros(len(values), bool)
    for i in np.flatnonzero(frequent):
        hot[offsets[i + 1] - frequent[i] : offsets[i + 1]] = True
    any_hot = bool(hot.any())
    seeds = _mix(np.arange(1, bands * rows + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03) + np.uint64(seed))
    owner, keys, all_frequent = [], [], []
    everyone = np.arange(n_sets)
    for b in range(bands):
        key = np.full(n_sets, b + 1, np.uint64)
        all_hot = np.ones(n_sets, bool)
        for r in range(rows):
            h = _mix(base ^ seeds[b * rows + r])
            least = np.minimum.reduceat(h, starts)
            key = _mix(key * np.uint64(0x9E3779B97F4A7C15) ^ least)
            if any_hot:
                all_hot &= np.minimum.reduceat(np.where(hot, MASK, h), starts) > least
        cold = ~all_hot if any_hot else np.ones(n_sets, bool)
        owner.append(everyone[cold])
        keys.append(key[cold])
        all_frequent.append(np.zeros(len(owner[-1]), bool))
        for i in np.flatnonzero(~cold):
            first = base[offsets[i] : offsets[i] + sizes[i] - math.ceil(threshold * sizes[i] - 1e-9) + 1]
            owner.append(np.full(len(first), i))
            keys.append(_mix(first ^ key[i]))
            all_frequent.append(np.ones(len(first), bool))
    return np.concatenate(owner), np.concatenate(keys), np.concatenate(all_frequent)


def sketch(items: Column) -> Column:
    """64 bits, one of them set by each value."""
    return F.aggregate(items, F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(x), F.lit(64)).cast("int"))))


def _buckets(sets: DataFrame, only_frequent: bool, threshold: float, bands: int, rows: int, seed: int) -> DataFrame:
    """(bucket, no) of the bands that only frequent values made, or of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            grp = _mix(batch.column(0).to_numpy().astype(np.uint64) + np.uint64(1))
            offsets = lists.offsets.to_numpy().astype(np.int64)
            values = lists.values.to_numpy()[offsets[0] : offsets[-1]]
            owner, keys, hot = band_keys(offsets - offsets[0], values, batch.column(3).to_numpy(), threshold, bands, rows, seed)
            owner, keys = owner[hot == only_frequent], keys[hot == only_frequent]
            keys = _mix(keys ^ grp[owner]).view(np.int64)
            for i in range(0, len(owner), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + 200_000]), batch.column(1).take(pa.array(owner[i : i + 200_000]))], names=["bucket", "no"])

    some = sets.where("frequent > 0") if only_frequent else sets
    return some.select("grp", "no", "items", "frequent").mapInArrow(run, "bucket long, no long")


def _near(a: str, b: str, threshold: float) -> Column:
    """Whether two sets may be similar by their sizes and sketches; true for all that are."""
    x, y = F.col(f"{a}.n"), F.col(f"{b}.n")
    apart = F.bit_count(F.col(f"{a}.sketch").bitwiseXOR(F.col(f"{b}.sketch")))
    shared = F.ceil((x + y) * (threshold / (1 + threshold)) - 1e-9)
    return (F.col(f"{a}.grp") == F.col(f"{b}.grp")) & (F.least(x, y) >= threshold * F.greatest(x, y) - 1e-9) & (apart <= x + y - 2 * shared)


def candidates(reps: DataFrame, threshold: float, bands: int = 48, rows: int = 3, seed: int = 7, frequent: int = 200) -> DataFrame:
    """(grp, rep_a, rep_b), rep_a < rep_b: distinct pairs that share a bucket and may be similar by size and sketch."""
    # numbers are short and known once the rows are written
    sets = cut(with_frequent(reps, frequent).withColumn("no", F.monotonically_increasing_id()))
    # at most `frequent` sets each, so counted over the bucket; nearly all hold one set and end here
    cold = _buckets(sets, False, threshold, bands, rows, seed).withColumn("in_bucket", F.count("*").over(Window.partitionBy("bucket"))).where("in_bucket > 1")
    hot = cut(_buckets(sets, True, threshold, bands, rows, seed))
    counts = hot.groupBy("bucket").agg(F.count("*").alias("in_bucket")).where("in_bucket > 1")
    both = cold.unionByName(join_states(hot, counts, ["bucket"], "in_bucket"))
    about = sets.select("no", "grp", "rep", F.size("items").alias("n"), sketch(F.col("items")).alias("sketch"))
    both = cut(both.join(about, "no").drop("no"))
    pairs = pairs_in_blocks(both, ["bucket"], "in_bucket", "rep", _near("a", "b", threshold))
    return pairs.select("a.grp", F.col("a.rep").alias("rep_a"), F.col("b.rep").alias("rep_b")).distinct()


def similar_classes(reps: DataFrame, threshold: float, bands: int = 48, rows: int = 3, seed: int = 7) -> DataFrame:
    """(grp, rep_a, rep_b, similarity), rep_a < rep_b: pairs of different sets with Jaccard similarity >= threshold."""
    pairs = candidates(reps, threshold, bands, rows, seed)
    sets = reps.select("grp", "rep", "items")
    full = pairs.join(sets.withColumnsRenamed({"rep": "rep_a", "items": "items_a"}), ["grp", "rep_a"]).join(sets.withColumnsRenamed({"rep": "rep_b", "items": "items_b"}), ["grp", "rep_b"])
    shared = F.size(F.array_intersect("items_a", "items_b"))
    union = F.size("items_a") + F.size("items_b") - F.col("shared")
    return full.withColumn("shared", shared).withColumn("similarity", F.col("shared") / union).where(F.col("similarity") >= threshold - 1e-12).select("grp", "rep_a", "rep_b", "similarity")


def pairs_of_sets(sets: DataFrame, threshold: float = 0.6, bands: int = 48, rows: int = 3) -> DataFrame:
    """(grp, id_a, id_b), id_a < id_b: all pairs of sets (grp, id, items) of a group with Jaccard similarity >= threshold.

    This lists the pairs within a class of equal sets too, in blocks; ``classes`` and ``similar_classes`` hold the same
    without them. Ties at the threshold are kept; an empty table gives no pairs.
    """
    reps, members = classes(cut(sets))
    linked = similar_classes(reps, threshold, bands, rows)
    who = reps.select("grp", "rep").withColumn("id", F.col("rep")).unionByName(members.where(F.col("rep") != F.col("id")).drop("copies"))
    out = linked.select("grp", "rep_a", "rep_b")
    out = out.join(who.withColumnsRenamed({"rep": "rep_a", "id": "x"}), ["grp", "rep_a"]).join(who.withColumnsRenamed({"rep": "rep_b", "id": "y"}), ["grp", "rep_b"]).select("grp", "x", "y")
    same = pairs_in_blocks(members, ["grp", "rep"], "copies", "id").select("a.grp", F.col("a.id").alias("x"), F.col("b.id").alias("y"))
    return out.unionByName(same).select("grp", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def similar_pairs(items: DataFrame, threshold: float = 0.6, min_size: int = 3, bands: int = 48, rows: int = 3) -> DataFrame:
    """pairs_of_sets of (grp, id, item), one value a row; sets under min_size values pair with nothing. See
    sets_of_lists for NULLs and repeated rows."""
    return pairs_of_sets(build_sets(items, min_size), threshold, bands, rows)


def similar_between(left: DataFrame, right: DataFrame, threshold: float = 0.6, min_size: int = 3, bands: int = 48, rows: int = 3) -> DataFrame:
    """(grp, id_left, id_right): pairs between two tables of (grp, id, item) whose sets are similar; as similar_pairs.

    Ids of the two tables are told apart by doubling, so ids must fit in 62 bits.
    """
    both = left.select("grp", (F.col("id") * 2).alias("id"), "item").unionByName(right.select("grp", (F.col("id") * 2 + 1).alias("id"), "item"))
    p = similar_pairs(both, threshold, min_size, bands, rows).where(F.pmod("id_a", F.lit(2)) != F.pmod("id_b", F.lit(2)))
    side = lambda odd: F.floor(F.when(F.pmod("id_a", F.lit(2)) == odd, F.col("id_a")).otherwise(F.col("id_b")) / 2).cast("long")
    return p.select("grp", side(0).alias("id_left"), side(1).alias("id_right"))
