"""Mixing sources to target weights by Pfair scheduling, with DataFrame functions only.

Rows of a source form blocks.  With weights w that add up to W over the active sources, block c (from 0) of a
source is released at slot floor(c * W / w) and due at slot ceil((c + 1) * W / w), and each slot goes to the
released block with the earliest deadline, so that at every slot each source is less than one
block away from its share.  The schedule repeats after W slots, in which each active source gets exactly
w blocks; it is made once for each set of active sources, in an array expression over W
slots, and looked up for every block.  A source that runs out leaves the active set; the others
share on by their weights, so every row is placed exactly once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK_ROWS = 64
SHARD_ROWS = 100_000


def _weight(weights: dict[str, int], default: int) -> Column:
    out = F.lit(default)
    for name, w in weights.items():
        if w <= 0:
            raise ValueError(f"weights are positive whole numbers; {name!r} has {w}")
        out = F.when(F.col("source") == name, F.lit(w)).otherwise(out)
    return out.cast("long")


def period_schedule(sets: DataFrame) -> DataFrame:
    """For rows with ``active`` (array of source and weight): (.., slot, source, nth) of one period each.

    A fold over the slots: each goes to the released block that is due first.
    """
    step = """
    aggregate(
      sequence(0L, total - 1L),
      named_struct('done', transform(active, a -> 0L), 'out', cast(array() as array<int>)),
      (s, t) -> transform(
        array(array_min(transform(
          filter(sequence(0, size(active) - 1), i -> s.done[i] < active[i].weight and s.done[i] * total div active[i].weight <= t),
          i -> named_struct('due', ((s.done[i] + 1L) * total + active[i].weight - 1L) div active[i].weight, 'place', i))).place),
        p -> named_struct('done', transform(s.done, (d, i) -> d + if(i = p, 1L, 0L)), 'out', array_append(s.out, p)))[0],
      s -> s.out)
    """
    slots = sets.withColumn("total", F.expr("aggregate(active, 0L, (x, a) -> x + a.weight)")).withColumn("chosen", F.expr(step))
    slots = slots.select("first_period", "next_period", "total", "active", F.posexplode("chosen").alias("slot", "place"))
    each = Window.partitionBy("first_period", "place").orderBy("slot")
    return slots.withColumn("nth", F.row_number().over(each) - 1).withColumn("source", F.expr("active[place].source"))


def mix(docs: DataFrame, weights: dict[str, int], default_weight: int = 1, block_rows: int = BLOCK_ROWS, shard_rows: int = SHARD_ROWS, source_column: str = "source", id_column: str = "doc_id") -> DataFrame:
    """Every row once, as (row, source, block, slot, place): the mixed order is by slot, then place.

    ``row`` holds all columns of the input, so that no name can clash.  ``block`` counts the source's blocks from 0,
    ``slot`` the slots of the schedule (slots that a source leaves empty when it runs out are left out), ``place`` the rows of a block.
    Sources that ``weights`` doesn't name weigh ``default_weight``; null is a source of its own.  Rows go to blocks
    by a hash of their identifier; null and repeated identifiers are placed like others.  Numbers of sources are meant to
    be those of a mix (up to some hundreds).  An empty table gives no rows.
    """
    shards = max(1, -(-docs.count() // shard_rows))
    named = F.coalesce(F.col(source_column).cast("string"), F.lit("\0"))
    key = F.xxhash64(F.col(id_column).cast("string"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), named.alias("source"), key.alias("key"), F.col(id_column).alias("id"))
    rows = rows.withColumn("shard", F.pmod("key", F.lit(shards)))
    ranked = Window.partitionBy("source", "shard").orderBy("key", "id")
    rows = rows.withColumn("rank", F.row_number().over(ranked) - 1).select(
        "row", "source", "shard", F.floor(F.col("rank") / block_rows).alias("local"), (F.col("rank") % block_rows).cast("int").alias("place")
    )
    # Shards of a source, one row each: how many blocks come before them.
    counted = docs.select(named.alias("source"), F.pmod(key, F.lit(shards)).alias("shard")).groupBy("source", "shard").agg(F.count(F.lit(1)).alias("n"))
    counted = counted.withColumn("blocks", F.ceil(F.col("n") / block_rows))
    before = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.withColumn("before", F.coalesce(F.sum("blocks").over(before), F.lit(0)))
    sources = counted.groupBy("source").agg(F.sum("blocks").alias("blocks")).withColumn("weight", _weight(weights, default_weight))
    sources = sources.withColumn("periods", F.ceil(F.col("blocks") / F.col("weight")))
    # One row with an entry for each source; one set of active sources for each place where a source runs out.
    mixed = sources.agg(F.sort_array(F.collect_list(F.struct("source", "weight", "periods"))).alias("all")).where("size(all) > 0")
    mixed = mixed.withColumn("ends", F.expr("array_sort(array_distinct(transform(all, a -> a.periods)))"))
    sets = mixed.select("all", "ends", F.posexplode("ends").alias("number", "next_period"))
    sets = sets.withColumn("first_period", F.expr("if(number = 0, 0L, ends[number - 1])"))
    sets = sets.withColumn("active", F.expr("transform(filter(all, a -> a.periods > first_period), a -> named_struct('source', a.source, 'weight', a.weight))"))
    # Slots before a set's first period: those of all periods before, with the weights active in them.
    base = "aggregate(all, 0L, (x, a) -> x + a.weight * least(a.periods, first_period))"
    schedule = period_schedule(sets.select("first_period", "next_period", "active")).join(sets.select("first_period", F.expr(base).alias("base")), "first_period")
    blocks = counted.join(sources.select("source", "weight"), "source").select(
        "source", "shard", "weight", "before", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("local")
    )
    blocks = blocks.withColumn("block", F.col("before") + F.col("local")).withColumn("period", F.floor(F.col("block") / F.col("weight"))).withColumn("nth", F.col("block") % F.col("weight"))
    slots = blocks.join(schedule.select("source", "nth", "first_period", "next_period", "total", "base", F.col("slot").alias("at")), ["source", "nth"])
    slots = slots.where("period >= first_period and period < next_period")
    slots = slots.select("source", "shard", "local", "block", (F.col("base") + (F.col("period") - F.col("first_period")) * F.col("total") + F.col("at")).alias("slot"))
    return rows.join(slots, ["source", "shard", "local"]).select("row", F.when(F.col("source") != "\0", F.col("source")).alias("source"), "block", "slot", "place")


def in_order(mixed: DataFrame) -> DataFrame:
    """The input's rows in mixed order."""
    return mixed.orderBy("slot", "place").select("row.*")
