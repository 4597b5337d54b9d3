"""Mixing sources to target weights by weighted fair queueing.

Every source's documents stand in a shuffled queue. A document's virtual finish
time is the number of tokens of its source up to and including it, divided by
the source's target; the queue starts over after its end, so a source may be
taken more than once. The documents of all sources are sorted by finish time
and taken while the total budget lasts. All prefix sums run in two levels,
within narrow buckets and over the buckets' totals, so that no task needs all
rows of a source or of the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from .common import WORD, materialise

#: Buckets of a source's shuffled queue, and of the mix's virtual time.
BUCKETS = 4096
MAX_COPIES = 3
SEED = 20_240_607


def targets(totals: DataFrame, weights: tuple = (1, 2, 3), max_copies: int = MAX_COPIES, share: float = 1.0) -> DataFrame:
    """Adds weight and target to one row per source (source, source_size).

    Sources in code-point order, null last, weigh ``weights`` in turn and share
    ``share`` of all sizes. No target exceeds ``max_copies`` times its source's
    size; what lies above is shared again by weight. The fixed point of that
    has a closed form: sources fill up in the order of limit over weight, and
    those that stay open have weight times one level. Windows here run over
    one row per source.
    """
    everything = W.partitionBy()
    ranked = totals.withColumn("_n", F.row_number().over(everything.orderBy(F.col("source").isNull(), F.col("source"))) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_n") % len(weights) + 1).cast("int"))
    frame = ranked.withColumn("weight", weight).withColumn("_limit", max_copies * F.col("source_size").cast("double"))
    order = everything.orderBy(F.col("_limit") / F.col("weight"), F.col("_n"))
    before = order.rowsBetween(W.unboundedPreceding, -1)
    frame = frame.withColumns({
        "_total": F.sum("source_size").over(everything) * F.lit(float(share)),
        "_filled": F.coalesce(F.sum("_limit").over(before), F.lit(0.0)),
        "_weight_left": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
    })
    level = (F.col("_total") - F.col("_filled")) / F.col("_weight_left")
    # the first source that the level doesn't fill sets the level of all that follow
    frame = frame.withColumn("_open", F.when(level <= F.col("_limit") / F.col("weight"), level))
    frame = frame.withColumn("_level", F.first("_open", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0)))
    target = F.when(F.col("_level").isNull(), F.col("_limit")).otherwise(F.least(F.col("_limit"), F.col("_level") * F.col("weight")))
    return frame.select("source", "source_size", "weight", target.alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = (1, 2, 3), max_copies: int = MAX_COPIES, seed: int = SEED, buckets: int = BUCKETS, share: float = 1.0) -> DataFrame:
    """How often the mix takes each document: doc_id, source, size, source_size, target, copies, taken, text_hash.

    size is the number of words (null text: 0). The budget is the targets' sum.
    A document without words costs nothing and is taken as often as its source
    goes round; one of a source with no words at all, once. Null sources are a
    source. Rows with equal id and text are interchangeable; reruns agree.
    An empty table gives no rows; other columns are left out.
    """
    sized = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        F.col(f"`{source_col}`").cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(f"`{text_col}`").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))).alias("text_hash"),
    )
    sized = materialise(sized.withColumn("_place", F.xxhash64(F.lit(seed), "doc_id", "text_hash")), "sizes")
    if buckets & (buckets - 1):
        raise ValueError("buckets must be a power of two")
    # the leading bits, so that buckets follow each other as places do
    sized = sized.withColumn("_bucket", F.shiftright("_place", 65 - buckets.bit_length()))
    queue = ["source", "_bucket"]
    sums = sized.groupBy(*queue).agg(F.sum("size").alias("_sum"))
    within = W.partitionBy("source").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(within), F.lit(0))).drop("_sum")
    goals = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_copies, share)
    sums = sums.alias("s").join(goals.alias("g"), F.expr("s.source <=> g.source")).select("s.source", "s._bucket", "s._before", "g.source_size", "g.target")
    joined = sized.alias("d").join(sums.alias("s"), F.expr("d.source <=> s.source and d._bucket = s._bucket"))
    local = W.partitionBy("d.source", "d._bucket").orderBy("_place", "doc_id", "text_hash", "size").rowsBetween(W.unboundedPreceding, 0)
    upto = F.col("_before") + F.sum("size").over(local)
    # rounds that begin before the target is reached, and one more for the budget's rest
    rounds = F.least(F.lit(max_copies), F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")) + 1).otherwise(1))
    queued = joined.select("doc_id", "d.source", "size", "text_hash", "source_size", "target", "_place", upto.alias("_upto")).withColumn("_rounds", rounds.cast("int"))
    queued = materialise(queued, "queue")

    def finish(turn):
        return F.when(F.col("target") > 0, (F.col("_upto") + turn * F.col("source_size")) / F.col("target")).otherwise(F.lit(0.0))

    def rank(turn):
        return F.struct(finish(turn).alias("finish"), F.col("_place").alias("place"), F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), F.col("size").alias("size"))

    turns = queued.withColumn("_rank", F.explode(F.transform(F.sequence(F.lit(0), F.col("_rounds") - 1), rank)))
    turns = turns.select("size", "_rank", F.floor(F.col("_rank.finish") * buckets).alias("_slot"))
    slots = turns.groupBy("_slot").agg(F.sum("size").alias("_sum"))
    so_far = F.sum("_sum").over(W.partitionBy().orderBy("_slot").rowsBetween(W.unboundedPreceding, 0))
    budget = goals.agg((F.sum("target") + 0.5).alias("_budget"))
    slots = slots.withColumn("_so_far", so_far).crossJoin(F.broadcast(budget))  # a row
    over = slots.where("_so_far > _budget").agg(F.min(F.struct("_slot", (F.col("_so_far") - F.col("_sum")).alias("_before"), "_budget")).alias("_cut")).select("_cut.*")
    last = turns.join(F.broadcast(over), "_slot")  # a row; its slot's turns alone are sorted
    spent = F.col("_before") + F.sum("size").over(W.partitionBy("_slot").orderBy("_rank").rowsBetween(W.unboundedPreceding, 0))
    first_left_out = last.withColumn("_spent", spent).where("_spent > _budget").agg(F.min("_rank").alias("_end"))
    copies = F.size(F.filter(F.transform(F.sequence(F.lit(0), F.col("_rounds") - 1), rank), lambda r: F.col("_end").isNull() | (r < F.col("_end"))))
    done = queued.crossJoin(F.broadcast(first_left_out)).withColumn("copies", copies.cast("long"))  # a row
    return done.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "text_hash")
