"""Problem 8: mix sources to target shares of the tokens, repeating small sources a capped number of times.

Method: slot i of the schedule draws the point frac((i + 1/2) / golden ratio), which the cumulative weights map to a
source; the slots of a source are ranked. Each source's texts, shuffled anew for each repetition, form one stream that is
cut into blocks of equal tokens; the slot of rank r takes block r of its source. Low discrepancy keeps every stretch of the
schedule near the target shares.

Unless given, the total is the largest at which every source that has texts reaches its share within its repetitions; the
source that stops it there is marked (``binds``) in the report, beside the tokens available and used of each.
Ranks and running sums are computed in two levels (chunks of slots, hash buckets of texts), so that no task holds a whole
source.

Defined cases: null and empty texts have no tokens and are not used; texts without source, or of a source without target,
stay out; a source with a target but no texts gets no slots and is reported with share 0, the others keep their proportions;
a target of zero or less, or without repetitions, is treated alike; repeated rows of a key count once; more than ``MOST_SOURCES`` targets are an error, as the driver holds them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchloom.llm import tokens
from matchloom.session import materialise, table

BLOCK_TOKENS = 2_048
GOLDEN = 0.6180339887498949
CHUNK = 1 << 16
BUCKET_ROWS = 20_000
MOST_SOURCES = 10_000


def _sizes(vocabulary: str):
    def run(batches):
        for batch in batches:
            sizes = np.array([tokens.count(x, vocabulary) for x in batch.column(2).to_pylist()], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes)], ["doc_id", "source", "n_tokens"])

    return run


def _of_bounds(u: Column, bounds: list[float], first: int) -> Column:
    """Number of the interval that ``u`` lies in, by halving the sorted ``bounds``."""
    if not bounds:
        return F.lit(first)
    half = len(bounds) // 2
    return F.when(u < bounds[half], _of_bounds(u, bounds[:half], first)).otherwise(_of_bounds(u, bounds[half + 1 :], first + half + 1))


def mixture(texts: DataFrame, targets: DataFrame, total_tokens: int | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = 1, vocabulary: str = tokens.VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """Rows ``(slot, source, doc_id, repeat_no, n_tokens)`` of the mixture of ``texts(key, source, text)``, and the report by source."""
    spark = texts.sparkSession
    targets = targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    wanted = [r for r in targets.limit(MOST_SOURCES + 1).collect()]
    if len(wanted) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources have a target")
    names = spark.createDataFrame([(r.source,) for r in wanted], "source string")
    used = texts.where(F.col("key").isNotNull() & (F.length("text") > 0)).select("key", "source", "text").join(F.broadcast(names), "source", "left_semi").select("key", "source", "text")
    sized = materialise(used.mapInArrow(_sizes(vocabulary), "doc_id long, source string, n_tokens long").where("n_tokens > 0").dropDuplicates(["doc_id"]))
    held = {r.source: (r.tokens, r.rows) for r in sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows")).collect()}  # one row for each target
    live = sorted(r.source for r in wanted if r.source in held and (r.target_share or 0) > 0 and (r.max_repeats or 0) > 0)
    share = {r.source: float(r.target_share) for r in wanted if r.source in live}
    cap = {r.source: int(r.max_repeats or 0) for r in wanted}
    whole = sum(share.values())
    share = {k: v / whole for k, v in share.items()}
    room = {k: cap[k] * held[k][0] / share[k] for k in live}
    most, binding = int(min(room.values(), default=0)), min(room, key=room.get, default=None)
    total = most if total_tokens is None else max(0, int(total_tokens))
    n_slots = total // block_tokens
    bounds = np.cumsum([share[k] for k in live]).tolist() if live else []

    # the schedule
    point = (F.col("slot") + 0.5) * F.lit(GOLDEN)
    slots = spark.range(n_slots).toDF("slot").withColumn("u", point - F.floor(point))
    choice = _of_bounds(F.col("u"), bounds[:-1], 0) if bounds else F.lit(-1)
    slots = slots.select("slot", choice.alias("k"), F.floor(F.col("slot") / CHUNK).alias("chunk"))
    chunks = slots.groupBy("k", "chunk").agg(F.count("*").alias("n"))
    chunks = chunks.select("k", "chunk", (F.sum("n").over(Window.partitionBy("k").orderBy("chunk")) - F.col("n")).alias("before"))
    ranked = slots.withColumn("rank", F.row_number().over(Window.partitionBy("k", "chunk").orderBy("slot")) - 1).join(chunks, ["k", "chunk"])
    ranked = ranked.select("k", (F.col("rank") + F.col("before")).alias("block"), "slot")

    # the streams: for each source the repetitions that its slots reach
    plan = [(k, name, held[name][0], max(1, -(-held[name][1] // BUCKET_ROWS)), min(cap[name], int(share[name] * total // held[name][0]) + 1)) for k, name in enumerate(live)]
    plan = spark.createDataFrame(plan, "k int, source string, tokens long, buckets int, repeats int")
    stream = sized.join(F.broadcast(plan), "source").withColumn("repeat_no", F.explode(F.sequence(F.lit(0), F.col("repeats") - 1)))
    stream = stream.withColumn("draw", F.xxhash64("doc_id", "repeat_no", F.lit(seed))).withColumn("bucket", F.pmod("draw", "buckets"))
    sums = stream.groupBy("k", "repeat_no", "bucket").agg(F.sum("n_tokens").alias("n"))
    sums = sums.select("k", "repeat_no", "bucket", (F.sum("n").over(Window.partitionBy("k").orderBy("repeat_no", "bucket")) - F.col("n")).alias("before"))
    own = Window.partitionBy("k", "repeat_no", "bucket").orderBy("draw", "doc_id")
    stream = stream.withColumn("within", F.sum("n_tokens").over(own) - F.col("n_tokens")).join(sums, ["k", "repeat_no", "bucket"])
    stream = stream.withColumn("block", F.floor((F.col("before") + F.col("within")) / block_tokens))
    mixed = stream.join(ranked, ["k", "block"]).select("slot", "source", "doc_id", "repeat_no", "n_tokens")

    reached = mixed.groupBy("source", "doc_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("uses")).groupBy("source").agg(F.sum("n").alias("tokens"), F.max("uses").alias("most_uses"))
    known = spark.createDataFrame([(r.source, float(r.target_share or 0), int(r.max_repeats or 0), int(held.get(r.source, (0, 0))[0]), total_tokens is None and r.source == binding) for r in wanted], "source string, target_share double, max_repeats int, available_tokens long, binds boolean")
    report = known.join(reached, "source", "left").select("source", "target_share", "max_repeats", "available_tokens", "binds", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"))
    every = F.sum("tokens").over(Window.partitionBy())  # one row for each target
    return mixed, report.withColumn("actual_share", F.when(every > 0, F.round(F.col("tokens") / every, 6)).otherwise(0.0))


def _mixture(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return mixture(table(spark, folder, "documents").select(F.col("doc_id").alias("key"), "source", "text"), table(spark, folder, "mix_targets"))


def p8_mixed(spark: SparkSession, folder: str) -> DataFrame:
    """The texts of the mixture by slot of the schedule."""
    return _mixture(spark, folder)[0]


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and actual share of each source."""
    return _mixture(spark, folder)[1]


QUERIES = {"p8_mixed": p8_mixed, "p8_shares": p8_shares}
