"""Mixing sources to target weights by Sainte-Laguë apportionment, in DataFrame operations only.

A source's documents are dealt by a seeded digest over shards of about ``SHARD_SIZE`` words, so no window sees more than
a shard, whatever a source holds. The mix is a number of blocks of ``BLOCK`` words. Sources get blocks by the highest
quotients of their targets, shards the blocks of their source by the highest quotients of their sizes. A shard's
documents, in seeded order, form one stream of blocks; its quota takes the whole stream as often as it fits, and the
rest as a run of blocks from a seeded start, round the end. A document's words taken are those of its blocks.

Highest quotients without listing them all: with P parties, B blocks and total target T, the last quotient that wins is
T / B' / 2 for some B' in [B - P/2, B + P/2], since rounding moves each party by half a block at most. So every party
surely has round(t (B - P/2) / T) blocks and at most round(t (B + P/2) / T); only the quotients between are ranked, about
P in all.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from itembank.llm.common import query, run_folder, stage, table

SHARE = 1.5
REPEATS = 2
WEIGHTS = (5.0, 2.0, 1.0)
BLOCK = 16
SHARD_SIZE = 1 << 20
SEED = "mix-1"
#: White space of the size of a text: space and the five controls from tab to carriage return.
SPACES = "\t\n\x0b\x0c\r "


def word_count(text: Column) -> Column:
    """Number of runs of other characters than SPACES. White space is made one kind of space; then each start of a run
    is a position, found by taking away all characters but the starts."""
    runs = F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "x")
    return F.coalesce(F.length(F.translate(runs, SPACES, "")), F.lit(0)).cast("long")


def with_targets(sources: DataFrame, share: float, repeats: int) -> DataFrame:
    """``target`` of each source (``weight``, ``source_size``): ``share`` of all sizes by weight, no target above
    ``repeats`` sizes, the excess dealt again by weight. The sources that reach their limit are the first ones in order
    of limit / weight: source k does if all after it, at k's own limit / weight, could not use up what is left."""
    order = W.orderBy(F.col("source_size") / F.col("weight"), "rank")
    upto, every = order.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    limit = F.col("source_size") * F.lit(repeats)
    rows = sources.select(
        "*", limit.alias("__limit"), (F.sum("source_size").over(every) * F.lit(share)).alias("__total"),
        F.coalesce(F.sum(limit).over(upto), F.lit(0)).alias("__below"),
        (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0))).alias("__open"),
    )
    level = (F.col("__total") - F.col("__below")) / F.col("__open")
    full = F.col("__limit") <= F.col("weight") * level
    rows = rows.withColumn("__full", full).withColumn("__level", F.max(F.when(~full, level)).over(every))
    target = F.when(F.col("__full"), F.col("__limit").cast("double")).otherwise(F.col("weight") * F.col("__level"))
    return rows.withColumn("target", target).drop("__limit", "__total", "__below", "__open", "__full", "__level")


def apportion(parties: DataFrame, group: list[str], party: list[str], claim: str, seats: str, out: str) -> DataFrame:
    """``out``: the seats of each party by Sainte-Laguë's highest quotients claim / (2 k - 1), ties to the first party.
    ``seats`` is the number dealt out in the party's group, the same on all of its rows."""
    whole = W.partitionBy(*group)
    total, n = F.sum(claim).over(whole), F.count(F.lit(1)).over(whole)
    share = F.when(F.col("__total") > 0, F.col(claim) / F.col("__total")).otherwise(F.lit(0.0))
    low = F.greatest(F.floor(share * F.greatest(F.col(seats) - F.col("__n") / 2 - 1, F.lit(0.0)) + 0.5) - 1, F.lit(0))
    high = F.floor(share * (F.col(seats) + F.col("__n") / 2 + 1) + 0.5) + 1
    rows = parties.withColumns({"__total": total.cast("double"), "__n": n})
    rows = rows.withColumns({"__low": low.cast("long"), "__high": F.when(F.col(claim) > 0, high).otherwise(F.lit(0)).cast("long")})
    rows = rows.withColumn("__left", F.col(seats) - F.sum("__low").over(whole))
    bids = rows.where(F.col("__high") > F.col("__low")).select(
        *group, *party, "__left", F.col(claim).alias("__claim"), F.explode(F.sequence(F.col("__low") + 1, F.col("__high"))).alias("__k"))
    place = F.row_number().over(W.partitionBy(*group).orderBy((F.col("__claim") / (2 * F.col("__k") - 1)).desc(), *party))
    keys = [*group, *party]
    won = bids.withColumn("__place", place).where(F.col("__place") <= F.col("__left")).groupBy(
        *[F.col(c).alias(f"__w_{c}") for c in keys]).agg(F.count(F.lit(1)).alias("__won"))
    same = F.lit(True)
    for c in keys:
        same = same & (F.col(c) == F.col(f"__w_{c}"))
    return rows.join(won, same, "left").select(*parties.columns, (F.col("__low") + F.coalesce("__won", F.lit(0))).alias(out))


def _digest(doc_id: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))


def mix(
    docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS,
    block: int = BLOCK, shard_size: int = SHARD_SIZE, seed: str = SEED,
    doc_id: str = "doc_id", text: str = "text", source: str = "source", row_key: Column | None = None,
) -> DataFrame:
    """``doc_id``, ``size``, ``source_size``, ``target`` and ``taken`` of every row.

    ``weights`` go to the sources in code point order, null last, and repeat. ``taken`` counts repeats; it is at most
    ``repeats`` sizes, and sums to a source's target within a block or two a shard. A null source is a source; a null
    or blank text has size 0 and gives nothing; rows that repeat an id count each, and which of two equal rows is cut
    makes no difference. ``row_key`` (a long), if given, is returned too, as ``row_key``. With no words at all every target is 0. An empty table gives no rows; other columns are not read.
    The list of distinct sources, one row each, is ranked in one task.
    """
    folder = run_folder(docs.sparkSession, "mix")
    key = _digest(F.col(doc_id), seed)
    more = [] if row_key is None else [row_key.alias("row_key")]
    sized = stage(docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), key.alias("key"), *more,
    ), folder, "sized")

    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    wheel = F.array(*[F.lit(float(w)) for w in weights])
    sources = sums.withColumn("rank", rank).withColumn("weight", F.get(wheel, F.col("rank") % len(weights)))
    sources = with_targets(sources, share, repeats).withColumn(
        "blocks", F.round(F.sum("target").over(W.partitionBy()) / block).cast("long"))
    sources = apportion(sources, [], ["rank"], "target", "blocks", "quota")
    sources = stage(sources.withColumn("shards", F.greatest(F.ceil(F.col("source_size") / shard_size), F.lit(1))), folder, "sources")

    named = sources.select(F.col("source").alias("__source"), "rank", "source_size", "target", "quota", "shards")
    shard = F.conv(F.substring("key", 1, 12), 16, 10).cast("long") % F.col("shards")
    dealt = stage(
        sized.join(named, F.col("source").eqNullSafe(F.col("__source"))).drop("source", "__source").withColumn("shard", shard),
        folder, "dealt")

    held = dealt.groupBy("rank", "shard").agg(F.sum("size").alias("held"), F.max("quota").alias("quota"))
    quotas = apportion(held, ["rank"], ["shard"], "held", "quota", "taken_blocks")
    n = F.ceil(F.col("held") / block)
    quotas = quotas.withColumn("n", n).withColumn("taken_blocks", F.least("taken_blocks", F.col("n") * repeats))
    start = F.conv(F.substring(_digest(F.concat_ws("/", "rank", "shard"), seed), 1, 12), 16, 10).cast("long")
    quotas = quotas.select(
        F.col("rank").alias("__rank"), F.col("shard").alias("__shard"),
        F.when(F.col("n") > 0, F.floor(F.col("taken_blocks") / F.col("n"))).otherwise(F.lit(0)).alias("rounds"),
        F.when(F.col("n") > 0, F.col("taken_blocks") % F.col("n")).otherwise(F.lit(0)).alias("extra"),
        F.when(F.col("n") > 0, start % F.col("n")).otherwise(F.lit(0)).alias("start"), "n",
    )
    order = W.partitionBy("rank", "shard").orderBy(F.substring("key", 13, 20), "doc_id", "size", *(["row_key"] if more else []))
    end = F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0))
    laid = dealt.withColumn("end", end).withColumn("at", F.col("end") - F.col("size"))
    laid = laid.join(quotas, (F.col("rank") == F.col("__rank")) & (F.col("shard") == F.col("__shard")))

    def overlap(low: Column, high: Column) -> Column:
        return F.greatest(F.least("end", high * block) - F.greatest("at", low * block), F.lit(0))

    last = F.col("start") + F.col("extra")
    extra = overlap(F.col("start"), F.least(last, F.col("n"))) + overlap(F.lit(0), F.greatest(last - F.col("n"), F.lit(0)))
    taken = (F.col("size") * F.col("rounds") + extra).cast("long")
    return laid.select("doc_id", "size", "source_size", "target", taken.alias("taken"), *(["row_key"] if more else []))


@query()
def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed with weights 5, 2, 1 to one and a half times their size."""
    return mix(table(spark, sf_dir, "documents"))
