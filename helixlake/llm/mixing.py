"""Mixing sources to target weights, in blocks of words.

Each source's words, document after document, are packed into blocks of fixed length.
A source gets as many slots as its target has blocks.  For each of them an output shard is
drawn at random, so a source's counts per shard are multinomial, given its total, and the
totals meet the targets; a shard takes as many slots of each source as its count says.
Slot numbers are mapped through a pseudorandom permutation of
the source's block numbers, one for each pass over the source, and the drawn blocks are
joined to the documents by block number.  All draws are hashes of (seed, source, number):
reruns agree.

Only DataFrame operations are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from helixlake.llm.common import running_start, stored, table, unique_ids, word_count

WEIGHTS = (1, 2, 3)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: float = 3.0) -> DataFrame:
    """Per source: source, source_no, source_size, weight, target.

    ``sizes`` has source and size.  Sources by code point, null last, take the weights in
    turn and share the sum of all sizes.  A target stops at ``limit`` times its source's
    size, the excess being shared by weight until none is above: with caps in order of
    cap / weight, the first level at which the rest fits under its caps.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    every = W.partitionBy(F.lit(1)).orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("source_no", F.row_number().over(every) - 1)
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("source_no") % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", pick.cast("double")).withColumn("cap", F.col("source_size") * F.lit(limit))
    order = W.partitionBy(F.lit(1)).orderBy(F.col("cap") / F.col("weight"), "source_no")
    whole, upto = W.partitionBy(F.lit(1)), order.rowsBetween(W.unboundedPreceding, -1)
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))
    open_weight = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0))
    per = per.withColumn("level", left / open_weight)
    per = per.withColumn("share", F.max(F.when(F.col("cap") / F.col("weight") >= F.col("level"), F.col("level"))).over(whole))
    target = F.least(F.col("cap"), F.coalesce(F.col("share") * F.col("weight"), F.col("cap"))).cast("double")
    return per.select("source", F.col("source_no").cast("int").alias("source_no"), F.col("source_size").cast("long").alias("source_size"), "weight", target.alias("target"))


def permuted(number: str, count: str, *seed: str, rounds: int = 24) -> Column:
    """Where a pseudorandom permutation of 0 .. count - 1 puts ``number``.

    Swap-or-not: each round pairs x with (k - x) mod count and swaps the pair or not by
    one hashed bit of its larger member, which permutes any domain exactly.
    """
    parts = ", ".join(seed)
    step = f"""named_struct('x', s.x, 'y', pmod(pmod(xxhash64({parts}, r, 'k'), {count}) - s.x, {count}))"""
    return F.expr(
        f"""aggregate(sequence(1, {rounds}), named_struct('x', cast({number} as bigint), 'y', cast(0 as bigint)),
            (s, r) -> transform(array({step}), p -> named_struct('x',
                CASE WHEN xxhash64({parts}, r, greatest(p.x, p.y)) & 1 = 1 THEN p.y ELSE p.x END, 'y', cast(0 as bigint)))[0], s -> s.x)"""
    )


def draw_slots(spark: SparkSession, plan: DataFrame, block_words: int, shard_slots: int, seed: int) -> DataFrame:
    """One row per slot: source_no, slot, shard, pass_no, block, words (taken from the block's start).

    ``plan`` has source_no, source_size, target.  All passes but the last take each block
    whole; the last takes permuted blocks until the target, rounded, is met.
    """
    plan = plan.filter("source_size > 0").select(
        "source_no", "source_size", F.round("target").cast("long").alias("goal"), F.expr(f"cast(ceil(source_size / {block_words}) as bigint)").alias("blocks")
    )
    plan = plan.withColumn("passes", F.expr("goal div source_size")).withColumn("rest", F.col("goal") % F.col("source_size"))
    plan = plan.withColumn("short", F.col("source_size") - (F.col("blocks") - 1) * block_words)
    # Where the last, short block would stand in the last pass is needed to know the words before a slot.
    need = "passes * blocks + CASE WHEN rest > 0 THEN least(blocks, cast(ceil(rest / {0}) as bigint) + 1) ELSE 0 END".format(block_words)
    plan = plan.withColumn("slots", F.expr(need))
    first = W.partitionBy(F.lit(1)).orderBy("source_no").rowsBetween(W.unboundedPreceding, -1)
    plan = plan.withColumn("first", F.coalesce(F.sum("slots").over(first), F.lit(0)))
    total = plan.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    shards = max(1, -(-total // shard_slots))
    # Sources are dealt to ranges of slot numbers in steps, so that a hot source's slots start in many tasks.
    width = 4096
    steps = plan.withColumn("step", F.explode(F.expr(f"sequence(0, greatest(slots - 1, 0) div {width})"))).filter("slots > 0").repartition("source_no", "step")
    draws = steps.withColumn("draw", F.explode(F.expr(f"sequence(step * {width}, least(slots, (step + 1) * {width}) - 1)")))
    shard = F.pmod(F.xxhash64(F.lit(seed), "source_no", "draw", F.lit("shard")), F.lit(shards))
    quota = stored(draws.groupBy("source_no", shard.alias("shard")).agg(F.count("*").alias("quota")), "quota")
    # A shard's slots of a source are as many as it drew, numbered on from those of other shards.
    from_ = running_start(quota, ["source_no"], [F.col("shard")], "quota", "from_slot")
    slots = from_.withColumn("slot", F.explode(F.expr("sequence(from_slot, from_slot + quota - 1)")))
    slots = slots.join(plan.select("source_no", "source_size", "goal", "blocks", "passes", "rest", "short"), "source_no")  # a row per source
    slots = slots.withColumn("pass_no", F.expr("slot div blocks")).withColumn("turn", F.col("slot") % F.col("blocks"))
    slots = slots.withColumn("block", permuted("turn", "blocks", str(int(seed)), "source_no", "pass_no"))
    short_turn = F.when((F.col("pass_no") == F.col("passes")) & (F.col("block") == F.col("blocks") - 1), F.col("turn"))
    short_at = slots.groupBy("source_no").agg(F.min(short_turn).alias("short_turn"))
    slots = slots.join(short_at, "source_no")  # a row per source
    size = F.when(F.col("block") == F.col("blocks") - 1, F.col("short")).otherwise(F.lit(block_words))
    early = F.when(F.col("short_turn") < F.col("turn"), F.col("short") - block_words).otherwise(F.lit(0))
    words = F.when(F.col("pass_no") < F.col("passes"), size).otherwise(F.greatest(F.lit(0), F.least(size, F.col("rest") - F.col("turn") * block_words - early)))
    return slots.select("source_no", "slot", "shard", "pass_no", "block", words.cast("long").alias("words")).filter("words > 0")


def mix_sources(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights: tuple[int, ...] = WEIGHTS, limit: float = 3.0, block_words: int = 512, shard_slots: int = 8192, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """(taken, slots): what the mix takes of each document, and the drawn slots.

    taken has doc_id, size, source_size, target, taken (words, repeats counted); slots is
    what draw_slots returns.  A null text has size 0; a null source is a source of its
    own; rows that repeat an id are documents of their own.  No rows in, no rows out.
    """
    sized = stored(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), F.monotonically_increasing_id().alias("row")), "sizes")
    plan = stored(targets(sized, weights, limit), "targets")
    # A row per source; the join is left to Spark, which broadcasts by size or else splits a hot source.
    known = sized.join(plan, sized["source"].eqNullSafe(plan["source"])).select("row", "doc_id", "source_no", "size", "source_size", "target")
    placed = running_start(known, ["source_no"], [F.col("doc_id"), F.col("row")], "size", "start", spread=F.xxhash64("doc_id", F.lit(seed)))
    placed = stored(placed, "placed")
    slots = stored(draw_slots(docs.sparkSession, plan, block_words, shard_slots, seed), "slots")
    drawn = slots.groupBy("source_no", "block").agg(F.collect_list("words").alias("takes"))  # at most limit + 1 takes a block
    reach = F.expr(f"sequence(start div {block_words}, (start + size - 1) div {block_words})")
    pieces = placed.filter("size > 0").select("row", "source_no", "start", "size", F.explode(reach).alias("block"))
    low = F.expr(f"greatest(start - block * {block_words}, 0)")
    high = F.expr(f"least(start + size - block * {block_words}, {block_words})")
    pieces = pieces.withColumn("low", low).withColumn("high", high).join(drawn, ["source_no", "block"])
    got = F.expr("aggregate(takes, cast(0 as bigint), (s, w) -> s + greatest(0, least(high, w) - low))")
    taken = pieces.groupBy("row").agg(F.sum(got).alias("taken"))
    result = placed.join(taken, "row", "left").select("doc_id", F.col("size").cast("long"), "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    return result, slots


def repeat_by_mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", seed: int = 17, **options) -> DataFrame:
    """The documents as often as the mix takes them, with the columns of ``docs``.

    A document is never cut here: taken / size copies of it, the fraction rounded up or
    down by a hash of its id, so that a source's words keep their expectation.  Documents
    without words are kept once.  Rows that share an id or have none are documents of their
    own, known by a stored number.  No rows in, no rows out.
    """
    if unique_ids(docs, doc_id):
        rows = docs.select(F.struct(*docs.columns).alias("doc"), F.col(doc_id).alias("row"))
    else:
        rows = stored(docs.select(F.struct(*docs.columns).alias("doc"), F.monotonically_increasing_id().alias("row")), "rows")
    taken, _ = mix_sources(rows.select("row", F.col("doc")[source].alias("source"), F.col("doc")[text].alias("text")), doc_id="row", seed=seed, **options)
    ratio = F.col("taken") / F.col("size")
    luck = F.pmod(F.xxhash64("doc_id", F.lit(seed), F.lit("copies")), F.lit(1_000_000)) / F.lit(1_000_000.0)
    copies = F.when(F.col("size") == 0, F.lit(1)).otherwise((F.floor(ratio) + F.when(luck < ratio - F.floor(ratio), 1).otherwise(0)).cast("int"))
    often = taken.select(F.col("doc_id").alias("row"), copies.alias("copies")).filter("copies > 0")
    both = rows.join(often.hint("merge"), "row")
    return both.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc.*")


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))[0]


QUERIES = {"op3_mix_sources": op3_mix_sources}
ORACLE: dict[str, str] = {}
