"""Mixing sources to target weights of a total size in tokens.

Tokens are summed per source; a source's repetition rate is its target size over its tokens, at most its cap. Each
document is emitted floor(rate) times, plus once more if a hash of the seed and its id, seen as a number in [0, 1), is
below the rate's fraction. The draw depends on nothing but seed, id and rate, so lost executors and reruns give the
same records. Only one small row per source is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.llm.tokenizer import DEFAULT_RANKS, count_tokens
from tessera.session import cut


def source_key(source: Column) -> Column:
    """Sources are compared in lower case without outer white space."""
    return F.lower(F.regexp_replace(source, r"^\s+|\s+$", ""))


def sized(docs: DataFrame, id: str = "doc_id", ranks_file: str = DEFAULT_RANKS) -> DataFrame:
    """(id, source key, n_tokens) of all documents, written once so that texts are encoded once."""
    return cut(count_tokens(docs.select(id, source_key(F.col("source")).alias("source"), "text"), "text", [id, "source"], ranks_file=ranks_file))


def rates(sizes: DataFrame, targets: DataFrame, total_tokens: int) -> DataFrame:
    """One row per target source: its tokens, wanted tokens and repetition rate.

    Repeated target rows of one source are merged (shares added, the smaller cap). A source without tokens has rate 0;
    a NULL or negative share or cap counts as 0. Only max_repeats whole copies are possible, so the rate is at most
    max_repeats.
    """
    have = sizes.where(F.col("source").isNotNull()).groupBy("source").agg(F.count("*").alias("documents"), F.sum("n_tokens").alias("tokens"))
    want = targets.select(source_key(F.col("source")).alias("source"), F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)).alias("target_share"), F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)).alias("max_repeats"))
    want = want.groupBy("source").agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    out = want.join(have, "source", "left").na.fill(0, ["documents", "tokens"]).withColumn("wanted_tokens", F.col("target_share") * F.lit(float(total_tokens)))
    rate = F.when(F.col("tokens") > 0, F.least(F.col("wanted_tokens") / F.when(F.col("tokens") > 0, F.col("tokens")), F.col("max_repeats").cast("double"))).otherwise(0.0)
    return out.withColumn("rate", rate)


def draw(sizes: DataFrame, rate: DataFrame, id: str = "doc_id", seed: int = 17) -> DataFrame:
    """The drawn records (id, source, copy, n_tokens); copy counts from 1 to at most max_repeats.

    Documents of sources that are no target, or NULL, are not drawn.
    """
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(id).cast("string"))), 1, 13)
    part = F.conv(digits, 16, 10).cast("double") / float(16**13)
    # as many rows as there are target sources, which the caller lists
    kept = sizes.join(F.broadcast(rate.select("source", "rate")), "source")
    copies = F.floor("rate") + (part < F.col("rate") - F.floor("rate")).cast("long")
    return kept.withColumn("copies", copies.cast("int")).where(F.col("copies") > 0).select(id, "source", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"), "n_tokens")


def shares(drawn: DataFrame, rate: DataFrame) -> DataFrame:
    """What each target source reached: records, tokens, share of all drawn tokens, and whether it falls short.

    short: the cap keeps the source below its wanted size. Shares are 0 if nothing was drawn.
    """
    got = drawn.groupBy("source").agg(F.count("*").alias("records"), F.sum("n_tokens").alias("drawn_tokens"))
    # one row per target source, so a window over all rows is as small
    every = F.sum("drawn_tokens").over(Window.partitionBy(F.lit(1)))
    out = rate.join(F.broadcast(got), "source", "left").na.fill(0, ["records", "drawn_tokens"]).withColumn("all_tokens", every)
    share = F.when(F.col("all_tokens") > 0, F.col("drawn_tokens") / F.when(F.col("all_tokens") > 0, F.col("all_tokens"))).otherwise(0.0)
    return out.select("source", "target_share", "max_repeats", "documents", "tokens", "rate", "records", "drawn_tokens", share.alias("actual_share"), (F.col("rate") * F.col("tokens") < F.col("wanted_tokens") * 0.999999).alias("short"))
