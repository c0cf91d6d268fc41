"""Items that appear together: pair counts over baskets, scored against chance.

Baskets are reduced to distinct items, and identical baskets collapse into one with a weight. Pairs are enumerated
once per distinct basket and their weights summed. Two bounds leave out items that no result can hold, before any
pair exists: an item must be in at least ``min_count`` baskets, and, as n(a,b) <= n(b), a lift of L needs
n(a) <= N / L. Both are exact.

A basket that still has more than ``giant`` items is never collected and its pairs never listed, as they would be
quadratic in its size. Such baskets count by membership. A pair that is known from other baskets gains one for each
giant both its items are in, by joins that only pairs with items in giants take part in. A pair that meets in giants
alone must meet in min_count of them; it shares two of the giants that remain when the min_count - 2 last ones of
either item are set aside (one, if min_count is 1; giants are ordered by size), so only items with two such giants in
common are paired. With fewer than min_count giants there is no such pair.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tessera.operators.skew import join_states
from tessera.session import cut


def kept_members(df: DataFrame, basket: str, item: str, min_count: int, min_lift: float) -> tuple[DataFrame, DataFrame, int]:
    """((basket, item) of items that can be in a result, (item, n) of these items, number of baskets); n is the item's
    number of baskets."""
    member = cut(df.where(df[basket].isNotNull() & df[item].isNotNull()).select(df[basket].alias("basket"), df[item].alias("item")).distinct())
    baskets = member.select("basket").distinct().count()
    counts = cut(member.groupBy("item").agg(F.count("*").alias("n")).where((F.col("n") >= min_count) & (F.col("n") * F.lit(float(min_lift)) <= F.lit(baskets))))
    return join_states(member, counts, ["item"], "n").select("basket", "item"), counts, baskets


def pairs_together(df: DataFrame, basket: str, item: str, min_count: int, min_lift: float, giant: int = 2000) -> DataFrame:
    """(item_a, item_b, n_a, n_b, n_ab, lift, conviction), item_a < item_b, with n_ab >= min_count and lift >= min_lift.

    lift = n_ab N / (n_a n_b) over N baskets. conviction is that of the rule a -> b, (1 - n_b / N) / (1 - n_ab / n_a),
    NULL where the rule never fails. Rows with a NULL basket or item are ignored, repeated rows count once, ties at
    the bounds are kept, an empty table gives no rows. min_count must be 1 or more.
    """
    member, items, baskets = kept_members(df, basket, item, min_count, min_lift)
    member = cut(member)
    sizes = cut(member.groupBy("basket").agg(F.count("*").alias("size")).where(F.col("size") > 1))
    placed = join_states(member, sizes, ["basket"], "size")
    collapsed = (
        placed.where(F.col("size") <= giant)
        .groupBy("basket").agg(F.sort_array(F.collect_list("item")).alias("items"))
        .groupBy("items").agg(F.count("*").alias("w"))
    )
    pairs = (
        collapsed.select("items", "w", F.posexplode("items").alias("i", "a"))
        .select("w", "a", F.explode(F.expr("slice(items, i + 2, size(items))")).alias("b"))
        .groupBy("a", "b").agg(F.sum("w").alias("n_ab"))
    )
    n_giants = sizes.where(F.col("size") > giant).count()
    if n_giants:
        pairs = cut(pairs)
        more = in_giants(pairs, cut(placed.where(F.col("size") > giant)), min_count, n_giants)
        pairs = pairs.unionByName(more).groupBy("a", "b").agg(F.sum("n_ab").alias("n_ab"))
    scored = (
        pairs.where(F.col("n_ab") >= min_count)
        .join(items.select(F.col("item").alias("a"), F.col("n").alias("n_a")), "a")
        .join(items.select(F.col("item").alias("b"), F.col("n").alias("n_b")), "b")
        .where(F.col("n_ab").cast("double") * baskets >= F.lit(float(min_lift)) * F.col("n_a") * F.col("n_b"))
    )
    n = F.lit(float(max(baskets, 1)))
    fails = 1 - F.col("n_ab") / F.col("n_a")
    return scored.select(
        F.col("a").alias("item_a"), F.col("b").alias("item_b"), "n_a", "n_b", "n_ab",
        (F.col("n_ab") * n / (F.col("n_a") * F.col("n_b"))).alias("lift"),
        F.when(F.col("n_ab") < F.col("n_a"), (1 - F.col("n_b") / n) / F.when(F.col("n_ab") < F.col("n_a"), fails)).alias("conviction"),
    )


def in_giants(pairs: DataFrame, giants: DataFrame, min_count: int, n_giants: int) -> DataFrame:
    """(a, b, n_ab): how often pairs meet in giants, for those of pairs and for those that meet there min_count times
    alone. giants: (basket, item, size)."""
    known = pairs.select("a", "b")
    if n_giants >= min_count:
        known = known.unionByName(pairs_of_giants(giants, min_count)).distinct()
    g = giants.select("basket", "item")
    met = known.join(g.withColumnRenamed("item", "a"), "a").join(g.withColumnRenamed("item", "b"), ["basket", "b"])
    return met.groupBy("a", "b").agg(F.count("*").alias("n_ab"))


def pairs_of_giants(giants: DataFrame, min_count: int) -> DataFrame:
    """(a, b), a < b: pairs of items that share two early giants (one, if min_count is 1), each pair once."""
    # an item's baskets over giant items each: their number is bounded by the rows over giant
    early = giants.groupBy("item").agg(F.sort_array(F.collect_list(F.struct("size", "basket"))).alias("g")).where(F.size("g") >= min_count)
    early = early.select("item", F.expr(f"slice(g.basket, 1, size(g) - {max(min_count - 2, 0)})").alias("g"))
    if min_count == 1:
        keys = early.select("item", F.explode("g").alias("k"))
    else:
        keys = _two_of(early)
    p, q = keys.alias("p"), keys.alias("q")
    return p.join(q, (F.col("p.k") == F.col("q.k")) & (F.col("p.item") < F.col("q.item"))).select(F.col("p.item").alias("a"), F.col("q.item").alias("b")).distinct()


def _two_of(early: DataFrame) -> DataFrame:
    """(item, k): each two of an item's giants."""
    each = early.select("item", "g", F.posexplode("g").alias("i", "x"))
    each = each.select("item", "x", F.explode(F.expr("slice(g, i + 2, size(g))")).alias("y"))
    return each.select("item", F.struct("x", "y").alias("k"))
