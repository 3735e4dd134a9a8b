"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Each source gets a target number of words; no target passes ``cap`` times its
source's size, and the excess is shared again by weight.  A source's documents
are put in a hashed permutation and cut into blocks of about ``BLOCK_ROWS``
documents.  The mix takes every block once for each whole time the target holds
the source (an epoch), and blocks in permuted order for the rest; of the last
block it takes the documents that still fit.  That fixes each source's quota of
blocks exactly.  Where a large document leaves a source short of its target by
more than ``TOLERANCE``, documents that fit are taken once more, those taken least
first, in permuted order, until none fits or has been taken ``cap`` times; these
single draws go to shards by hash.

The quotas are dealt to the output shards by a splitting tree: the root holds
the quota of every source; a node draws, source by source, how many of its
blocks go left (half of them in all), each draw hypergeometric given those
before, so that the vector is multivariate hypergeometric, and the rest go
right.  A leaf is a shard.  Draws invert the exact distribution function around
its mode (to 12 standard deviations) at a hashed number, so reruns agree.  A
shard then takes the next disjoint run of each source's permuted blocks, and its
rows are shuffled locally by hash.

Everything is DataFrame and SQL functions.  Documents meet their block on
(source, block), which spreads a source that holds a third of all rows over its
blocks; sources and nodes have a row each.

Defined cases: a null text has size 0; a null source is a source of its own, last
in order; no words at all give targets of 0; repeated rows are documents of their
own (``take_mix`` adds up the copies of rows with equal doc_id, source and text); an
empty table gives an empty result; only doc_id, text and source are read, so
other columns can't clash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import WORD, materialize, unit_hash
from cairn.session import fresh_path

BLOCK_ROWS = 1024
SHARD_WORDS = 8_000_000
MIN_SHARDS = 16
SIGMAS = 12
TOLERANCE = 0.001  # share of its target that a source may miss before single documents fill it up
ROUNDS = 24  # of filling up: each takes a whole turn of a source, or makes its room smaller than a document
STEP = 6  # levels of the splitting tree that one row holds
MOST_TASKS = 1 << 16  # partitions of the mix at most; beyond it, shards share them


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """(source, source_size, rows) with rank, weight and target; a row per source.

    With r = cap * size / weight in ascending order, a source is capped where its r is
    at most the words left over per weight left over; the others share at that level.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(by_name) - 1
    ranked = (sizes.withColumn("rank", rank)
              .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1)))
              .withColumn("most", F.col("source_size") * float(cap)))
    level = Window.orderBy(F.col("most") / F.col("weight"), "rank")
    before, onward = level.rowsBetween(Window.unboundedPreceding, -1), level.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    shared = (ranked
              .withColumn("all_words", F.sum("source_size").over(every).cast("double"))
              .withColumn("share", (F.col("all_words") - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
                          / F.sum("weight").over(onward))
              .withColumn("capped", F.col("most") <= F.col("share") * F.col("weight"))
              # the first source that isn't capped sets the level; shares beyond it are lower
              .withColumn("level", F.max(F.when(~F.col("capped"), F.col("share"))).over(every)))
    return shared.select("source", "source_size", "rows", "rank", F.when(F.col("capped"), F.col("most"))
                         .otherwise(F.col("level") * F.col("weight")).alias("target"))


def named(value: Column, of) -> Column:
    """``of`` the value, which is computed once however often ``of`` mentions it."""
    return F.transform(F.array(value), of)[0]


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """How many of ``drawn`` out of ``total`` are among the ``marked``: the quantile of u."""
    given = F.struct(total.alias("total"), marked.alias("marked"), drawn.alias("drawn"), u.alias("u"))
    return named(given, lambda g: named(_mode_range(g), lambda r: _quantile(g, r)))


def _mode_range(g: Column) -> Column:
    """The numbers looked at: those possible within ``SIGMAS`` of the mean."""
    lowest = F.greatest(F.lit(0), g["drawn"] + g["marked"] - g["total"])
    highest = F.least(g["drawn"], g["marked"])
    mean = g["drawn"] * g["marked"] / F.greatest(g["total"], F.lit(1))
    sigma = F.sqrt(F.greatest(F.lit(0.0), mean * (1 - g["marked"] / F.greatest(g["total"], F.lit(1)))))
    around = F.struct(mean.alias("mean"), (F.ceil(sigma * SIGMAS) + SIGMAS).alias("reach"))
    return named(around, lambda a: F.struct(
        F.greatest(lowest, F.floor(a["mean"]) - a["reach"]).cast("bigint").alias("start"),
        F.least(highest, F.floor(a["mean"]) + a["reach"]).cast("bigint").alias("stop")))


def _quantile(g: Column, r: Column) -> Column:
    start, stop = r["start"], r["stop"]

    def ratio(k: Column) -> Column:  # chance of k + 1 against that of k
        return (((g["marked"] - k) * (g["drawn"] - k)).cast("double")
                / ((k + 1) * (g["total"] - g["marked"] - g["drawn"] + k + 1)))

    def up_to(limit: Column | None) -> Column:
        def step(acc: Column, k: Column) -> Column:
            cum = acc["cum"] + acc["p"]
            reached = acc["k"].isNotNull() if limit is None else (acc["k"].isNotNull() | (cum >= limit))
            k_found = F.lit(None).cast("bigint") if limit is None else F.coalesce(acc["k"], F.when(cum >= limit, k))
            p = F.when(k < stop, acc["p"] * ratio(k)).otherwise(0.0)
            return F.struct(p.alias("p"), F.when(reached, acc["cum"]).otherwise(cum).alias("cum"), k_found.alias("k"))
        zero = F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("cum"), F.lit(None).cast("bigint").alias("k"))
        return F.aggregate(F.sequence(start, stop), zero, step)

    found = named(up_to(None)["cum"] * g["u"], lambda limit: F.coalesce(up_to(limit)["k"], stop))
    return F.when(stop <= start, start).otherwise(found)


def split_quotas(quotas: DataFrame, levels: int, seed: int) -> DataFrame:
    """(rank, blocks) dealt to 2**levels shards: (shard, rank, blocks), by the splitting tree.

    ``STEP`` levels are one expression on a row for each node above them, so the plan hardly grows with the tree.
    """
    nodes = quotas.agg(F.array_sort(F.collect_list(F.struct("rank", "blocks"))).alias("held")).select(
        F.lit(0).cast("bigint").alias("node"), "held")
    kind = "struct<left:bigint,total:bigint,went:array<struct<rank:int,blocks:bigint>>>"

    def halves(held: Column, level: Column, node: Column) -> Column:
        def draw(acc: Column, x: Column) -> Column:
            u = unit_hash(F.lit(seed), level, node, x["rank"])
            return named(hypergeometric(acc["total"], x["blocks"], acc["left"], u), lambda n: F.struct(
                (acc["left"] - n).alias("left"), (acc["total"] - x["blocks"]).alias("total"),
                F.concat(acc["went"], F.array(F.struct(x["rank"].alias("rank"), n.alias("blocks")))).alias("went")))

        def start(total: Column) -> Column:
            return F.struct(F.floor(total / 2).cast("bigint").alias("left"), total.alias("total"),
                            F.array().cast("array<struct<rank:int,blocks:bigint>>").alias("went")).cast(kind)

        total = F.aggregate(held, F.lit(0).cast("bigint"), lambda a, x: a + x["blocks"])
        left = named(total, lambda t: F.aggregate(held, start(t), draw)["went"])
        return named(left, lambda went: F.array(went, F.zip_with(held, went, lambda a, b: F.struct(
            a["rank"].alias("rank"), (a["blocks"] - b["blocks"]).alias("blocks")))))

    for done in range(0, levels, STEP):
        if done:  # enough nodes to spread
            nodes = nodes.repartition("node")
        depth = min(STEP, levels - done)

        def deeper(row: Column, level: Column) -> Column:
            wide = F.pow(F.lit(2), level).cast("bigint")
            return F.flatten(F.transform(row, lambda held, i: halves(
                held, (F.lit(done) + level).cast("int"), F.col("node") * wide + i)))  # noqa: B023  built at once

        below = F.aggregate(F.sequence(F.lit(0), F.lit(depth - 1)), F.array("held"), deeper)
        nodes = (nodes.select("node", F.posexplode(below).alias("side", "held"))
                      .select((F.col("node") * 2 ** depth + F.col("side")).alias("node"), "held"))
    return nodes.select(F.col("node").alias("shard"), F.explode("held").alias("x")).select("shard", "x.rank", "x.blocks")


def fit_documents(units: DataFrame, *also: str) -> DataFrame:
    """Of documents (row, place, doc_id, digest, size) grouped by rank, block, room and ``also``: those
    (row, size) that fit one after the other in permuted order, the smallest of the others, and the room left."""
    def fit(acc: Column, x: Column) -> Column:
        fits = x["size"] <= acc["room"]
        least = F.when(acc["least"].isNull() | (x["size"] < acc["least"]["size"]), x).otherwise(acc["least"])
        taken = F.concat(acc["rows"], F.array(F.struct(x["row"].alias("row"), x["size"].alias("size"))))
        return F.struct(F.when(fits, acc["room"] - x["size"]).otherwise(acc["room"]).alias("room"),
                        F.when(fits, taken).otherwise(acc["rows"]).alias("rows"),
                        F.when(fits, acc["least"]).otherwise(least).alias("least"))

    x_kind = "struct<place:double,doc_id:bigint,digest:bigint,size:bigint,row:bigint>"
    empty = F.struct(F.col("room"), F.array().cast("array<struct<row:bigint,size:bigint>>").alias("rows"),
                     F.lit(None).cast(x_kind).alias("least"))
    return (units.groupBy("rank", "block", "room", *also)
            .agg(F.array_sort(F.collect_list(F.struct("place", "doc_id", "digest", "size", "row"))).alias("docs"))
            .select("rank", "block", *also, F.aggregate("docs", empty, fit).alias("fit")))


def fill_up(placed: DataFrame, short: DataFrame, cap: int) -> DataFrame | None:
    """(row, epoch) of single documents that bring the ``short`` sources nearer to their targets;
    None where no source is short.

    ``short`` has a source's rank, its room, the least room that counts (``enough``), its epochs, and its
    last block with the ``rows`` taken of it.  A round writes two tables, and reads what all rounds before
    it took as one, so that no round's plan is larger than the one before.
    """
    if short.isEmpty():
        return None
    spark = placed.sparkSession
    again = (F.col("block") < F.col("last_block")) | ((F.col("block") == F.col("last_block")) & F.array_contains("rows", F.col("row")))
    held = materialize(
        placed.filter("size > 0").join(short.withColumnRenamed("block", "last_block"), "rank")
              .select("rank", "row", "doc_id", "digest", "place", "size", "block", F.col("room").alias("at_first"), "enough",
                      (F.col("epochs") + F.when(again, 1).otherwise(0)).cast("int").alias("times")), "mix_short")
    kind, folder, paths = "row bigint, epoch int, size bigint, rank int", fresh_path(spark, "mix_filled"), []
    for number in range(ROUNDS):
        now, used = held, None
        if paths:
            taken = spark.read.schema(kind).parquet(*paths)
            now = (held.join(taken.groupBy("row").agg(F.count(F.lit(1)).cast("int").alias("more")), "row", "left")
                       .withColumn("times", F.col("times") + F.coalesce("more", F.lit(0))).drop("more"))
            used = taken.groupBy("rank").agg(F.sum("size").alias("used"))
        now = now.filter(F.col("times") < cap)
        open_ = now.withColumn("used", F.lit(0)) if used is None else now.join(used, "rank")
        open_ = open_.withColumn("room", F.col("at_first") - F.col("used")).filter("room > enough and size <= room")
        # a turn: the documents of a block that have been taken equally often, once more
        turns = open_.groupBy("rank", "times", "block").agg(F.sum("size").alias("words"), F.first("room").alias("most"))
        before = Window.partitionBy("rank").orderBy("times", "block").rowsBetween(Window.unboundedPreceding, -1)
        turns = (turns.withColumn("room", F.col("most") - F.coalesce(F.sum("words").over(before), F.lit(0)))
                      .filter("room > 0").select("rank", "times", "block", "words", "most", "room"))
        turns = materialize(turns, "mix_turns")
        if turns.isEmpty():
            break
        mine = now.join(turns, ["rank", "times", "block"]).filter("size <= most")
        fits = fit_documents(mine.filter("words > room"), "times")
        (mine.filter("words <= room").select("row", F.col("times").alias("epoch"), "size", "rank")
             .unionByName(fits.select("rank", F.col("times").alias("epoch"), F.explode("fit.rows").alias("x"))
                              .select("x.row", "epoch", "x.size", "rank"))
             .write.parquet(f"{folder}/{number}"))
        paths.append(f"{folder}/{number}")
    return spark.read.schema(kind).parquet(*paths).select("row", "epoch") if paths else None


def draw_mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, seed: int = 1,
             shard_words: int = SHARD_WORDS) -> DataFrame:
    """Every row of ``docs`` (doc_id, text, source) with size, source_size, target, its
    draws (epoch and shard of each time that the mix takes it) and taken words."""
    return dealt_mix(docs, weights, cap, seed, shard_words)[0]


def dealt_mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, seed: int = 1,
              shard_words: int = SHARD_WORDS) -> tuple[DataFrame, int]:
    """``draw_mix`` and the number of shards."""
    sized = materialize(docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "source", word_count(F.col("text")).alias("size"),
        F.xxhash64("text").alias("digest")).withColumn("row", F.monotonically_increasing_id()), "mix_sizes")
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    blocks_of = F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.col("rows") / BLOCK_ROWS, F.lit(1.0))))).cast("bigint")
    sources = materialize(
        source_targets(sizes, weights, cap).withColumn("n_blocks", blocks_of), "mix_sources")
    place = unit_hash(F.lit(seed), F.col("source"), F.col("doc_id"), F.col("digest"))
    # a row per source; Spark broadcasts the written table if its size allows, else splits the hot source
    named = sources.withColumnRenamed("source", "named")
    placed = sized.join(named, F.col("source").eqNullSafe(F.col("named"))).select(
        "source", "rank", "row", "doc_id", "digest", "size", "source_size", "target", place.alias("place"),
        F.floor(place * F.col("n_blocks")).alias("block"))
    placed = materialize(placed, "mix_placed")

    # the blocks of the epoch that isn't whole, in permuted order, as far as the words reach
    words = placed.groupBy("rank", "block", "source_size", "target").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("rank").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    blocks = (words.withColumn("epochs", epochs)
                   .withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
                   .withColumn("room", F.col("target") - F.col("epochs") * F.col("source_size") - F.col("before"))
                   .select("rank", "block", "epochs", "room",
                           F.greatest(F.col("target") * TOLERANCE, F.lit(0.0)).alias("enough"),
                           (F.col("room") >= F.col("words")).alias("whole"),
                           ((F.col("room") < F.col("words")) & (F.col("room") > 0)).alias("last")))
    blocks = materialize(blocks, "mix_blocks")

    # of the last block: the documents, in permuted order, that still fit, and the
    # smallest of the others if it brings the sum nearer
    nearer = F.coalesce(F.col("fit.least.size") < 2 * F.col("fit.room"), F.lit(False))
    at_last = blocks.filter("last").select("rank", "block", "room", "enough", "epochs")
    fitted = materialize(fit_documents(placed.join(at_last, ["rank", "block"]), "enough", "epochs"), "mix_last")
    chosen = fitted.select(F.explode(F.when(nearer, F.concat("fit.rows.row", F.array("fit.least.row")))
                                     .otherwise(F.col("fit.rows.row"))).alias("row"))
    short = (fitted.filter(~nearer).filter("fit.room > enough")
                   .select("rank", "block", "epochs", "enough", F.col("fit.room").alias("room"), F.col("fit.rows.row").alias("rows")))
    filled = fill_up(placed, short, cap)

    # a unit is a block taken in an epoch; the tree says how many of a source's go to each shard
    units = (blocks.select("rank", "block", "epochs", F.explode(F.when(
        F.col("whole") | F.col("last"), F.sequence(F.lit(0), F.col("epochs").cast("int"))).otherwise(
            F.when(F.col("epochs") > 0, F.sequence(F.lit(0), F.col("epochs").cast("int") - 1))
            .otherwise(F.array().cast("array<int>")))).alias("epoch"))
        .withColumn("turn", F.row_number().over(Window.partitionBy("rank").orderBy(
            F.xxhash64(F.lit(seed), "rank", "epoch", "block"), "epoch", "block"))))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    levels = math.ceil(math.log2(max(MIN_SHARDS, total / shard_words)))
    often = F.col("epochs") + F.when(F.col("whole") | F.col("last"), 1).otherwise(0)
    quotas = blocks.groupBy("rank").agg(F.sum(often).alias("blocks")).filter("blocks > 0")
    dealt = split_quotas(quotas, levels, seed).filter("blocks > 0")
    until = F.sum("blocks").over(Window.partitionBy("rank").orderBy("shard"))
    turns = dealt.withColumn("until", until).select("rank", "shard", F.explode(
        F.sequence((F.col("until") - F.col("blocks") + 1).cast("int"), F.col("until").cast("int"))).alias("turn"))
    draws = units.join(turns, ["rank", "turn"]).groupBy("rank", "block").agg(
        F.array_sort(F.collect_list(F.struct("epoch", "shard"))).alias("draws"))
    partial = F.when(F.col("last"), F.col("epochs").cast("int")).alias("partial")
    of_block = materialize(blocks.select("rank", "block", partial).join(draws, ["rank", "block"], "left"), "mix_draws")

    # the documents taken singly: those of the last block that fit, and those that fill up
    single = chosen.withColumn("epoch", F.lit(None).cast("int"))
    single = single if filled is None else single.unionByName(filled)
    shard = F.pmod(F.xxhash64(F.lit(seed), "row", "epoch"), F.lit(2 ** levels)).cast("bigint")
    more = F.when(F.col("epoch").isNotNull(), F.struct("epoch", shard.alias("shard")))  # nulls aren't collected
    single = single.groupBy("row").agg(F.max(F.col("epoch").isNull()).alias("fits"), F.array_sort(F.collect_list(more)).alias("more"))
    none = F.array().cast("array<struct<epoch:int,shard:bigint>>")
    own = F.filter(F.coalesce("draws", none), lambda d: F.coalesce(d["epoch"] != F.col("partial"), F.lit(True)) | F.col("fits"))
    drawn = (placed.join(of_block, ["rank", "block"], "left").join(single, "row", "left")
                   .withColumn("fits", F.coalesce("fits", F.lit(False)))
                   .withColumn("draws", F.concat(own, F.coalesce("more", none))))
    return (drawn.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("draws")).alias("taken"),
                         "draws", "digest", "source"), 2 ** levels)


def take_mix(docs: DataFrame, seed: int = 1, **options) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as drawn, shard by shard in a
    locally shuffled order, with the columns of ``docs``."""
    drawn, shards = dealt_mix(docs, seed=seed, **options)
    key = F.struct(F.col("doc_id").cast("bigint").alias("id"), F.col("source").alias("source"), F.xxhash64("text").alias("digest"))
    draws = (drawn.filter("size(draws) > 0")
                  .groupBy(F.struct(F.col("doc_id").alias("id"), "source", "digest").alias("__key"))
                  .agg(F.flatten(F.collect_list("draws")).alias("__draws")))
    # rows that repeat a doc_id, source and text share their draws: one of them takes them all
    one = Window.partitionBy("__key").orderBy("__key")
    rows = (docs.withColumn("__key", key).hint("merge").join(draws, "__key")
                .withColumn("__copy", F.row_number().over(one)).filter("__copy = 1"))
    dealt = (rows.select("*", F.posexplode("__draws").alias("__place", "__draw")).drop("__draws")
                 .withColumn("__shard", F.col("__draw.shard")))
    # a task a shard, so that hashing can't put several into one
    tasks = min(shards, MOST_TASKS)
    dealt = dealt.repartitionById(tasks, F.pmod("__shard", F.lit(tasks)).cast("int"))
    return (dealt.sortWithinPartitions("__shard", F.xxhash64(F.lit(seed), "__key", "__draw.epoch"), "__place")
                 .select(*docs.columns))
