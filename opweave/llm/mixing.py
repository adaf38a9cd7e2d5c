"""Problem 8: mixing sources to target weights by Sainte-Lague apportionment.

The mix is counted in blocks of equal token size.  Blocks go to the source, then inside
a source to the shard, with the highest quotient weight / (2 k + 1), k blocks held so
far, up to what max_repeats allows.

A shard lays its documents, in seeded order, into blocks; a document longer than a block
is a block of its own.  The whole passes of its quota take every block.  For the rest the
shard selects blocks in their seeded order as long as they fit, opens the first that does
not for the documents of it that do, and goes on, so that large documents leave no hole.
"""
from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa

from pyspark.sql import DataFrame, Window, functions as F

SHARD_TOKENS = 2_000_000  # a shard holds about so many tokens ...
MAX_SHARDS = 32_768  # ... and a source at most so many shards, which bounds what the driver apportions; a shard's task holds one block at a time


def sainte_lague(weights: list[float], caps: list[int], seats: int) -> list[int]:
    """Seats by highest quotients w / (2 k + 1) under caps; ties to the earlier entry.

    A threshold on the quotient found by bisection gives nearly all seats at once."""
    held = [0] * len(weights)
    seats = min(seats, sum(c for c, w in zip(caps, weights) if w > 0))
    if seats <= 0:
        return held
    at = lambda q: [min(c, int((w / q + 1) // 2)) if w > 0 else 0 for w, c in zip(weights, caps)]
    low, high = 0.0, max(weights)
    for _ in range(200):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        if sum(at(mid)) > seats:
            low = mid
        else:
            high = mid
    held = [max(0, h - 1) for h in at(high)] if sum(at(high)) <= seats else held  # the last seats go one by one: rounding cannot decide a tie
    heap = [(-w / (2 * h + 1), i) for i, (w, c, h) in enumerate(zip(weights, caps, held)) if w > 0 and h < c]
    heapq.heapify(heap)
    left = seats - sum(held)
    while left and heap:
        _, i = heapq.heappop(heap)
        held[i] += 1
        left -= 1
        if held[i] < caps[i]:
            heapq.heappush(heap, (-weights[i] / (2 * held[i] + 1), i))
    return held


def mix_sources(docs: DataFrame, targets: DataFrame, *, key: str = "doc_id", total_tokens: int | None = None, block_tokens: int = 512, seed: int = 42) -> DataFrame:
    """(key, source, n_tokens, repeats): chosen documents, each used ``repeats`` times (1..max_repeats).

    docs: ``key``, ``source``, ``n_tokens`` (a materialised table: it is read twice); targets: source,
    target_share, max_repeats (a small table by nature; a null or non-positive share or cap counts as 0,
    of repeated sources the first by share counts).  total_tokens: size of the mix, by default all tokens
    of the listed sources.  A source that cannot reach its target gives all that max_repeats allows, and
    the others share what is missing in proportion.  Documents without tokens, with a null source or of
    an unlisted source are never chosen."""
    spark = docs.sparkSession
    aim = {}
    for r in targets.select("source", "target_share", "max_repeats").filter("source is not null").orderBy("source", F.desc("target_share")).collect():
        aim.setdefault(r[0], (max(0.0, r[1] or 0.0), max(0, r[2] or 0)))
    if not aim:
        return spark.createDataFrame([], f"{key} {docs.schema[key].dataType.simpleString()}, source string, n_tokens bigint, repeats int")
    names = sorted(aim)
    live = docs.select(key, "source", "n_tokens").filter(F.col("source").isin(names) & (F.col("n_tokens") > 0))
    have = {r[0]: r[1] for r in live.groupBy("source").agg(F.sum("n_tokens")).collect()}
    total = total_tokens if total_tokens is not None else sum(have.values())
    caps = [aim[s][1] * have.get(s, 0) // block_tokens for s in names]
    quota = dict(zip(names, sainte_lague([aim[s][0] for s in names], caps, total // block_tokens)))
    n_shards = {s: max(1, min(MAX_SHARDS, -(-have.get(s, 0) // SHARD_TOKENS))) for s in names}
    per = F.create_map(*[F.lit(x) for s in names for x in (s, n_shards[s])])
    live = live.withColumn("h", F.xxhash64(F.lit(seed), F.col(key))).withColumn("shard", F.pmod(F.col("h"), per[F.col("source")]).cast("int"))
    sizes: dict[str, list[tuple[int, int]]] = {s: [] for s in names}
    for s, k, n in live.groupBy("source", "shard").agg(F.sum("n_tokens")).orderBy("source", "shard").collect():
        sizes[s].append((k, n))
    plan = []
    for s, shards in sizes.items():
        cap = [aim[s][1] * n // block_tokens for _, n in shards]
        got = sainte_lague([n for _, n in shards], cap, quota[s])
        left = quota[s] - sum(got)  # blocks that only shard rounding keeps out
        for (k, n), q, c in zip(shards, got, cap):
            extra = min(left, 1) if q == c else 0
            left -= extra
            t = min((q + extra) * block_tokens, aim[s][1] * n)
            plan.append((s, k, t // n, t % n))
    if not plan:
        plan = [("", -1, 0, 0)]
    quotas = spark.createDataFrame(plan, "qs string, qk int, passes long, rest long")
    r = live.join(F.broadcast(quotas), (F.col("source") == F.col("qs")) & (F.col("shard") == F.col("qk")))
    kind = docs.schema[key].dataType.simpleString()
    r = r.select("source", "shard", F.col(key).alias("k"), "n_tokens", "passes", "rest", "h").repartition("source", "shard").sortWithinPartitions("source", "shard", "h", "k")
    r = r.mapInArrow(_select(block_tokens), f"k {kind}, source string, n_tokens bigint, repeats int")
    return r.select(F.col("k").alias(key), "source", "n_tokens", "repeats")


def _select(block: int):
    """Repeats of each document: passes, and one more where its block is selected.  Rows by shard in seeded order; one block is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, left, size = None, 0, 0
        held: list[tuple] = []
        out: list[tuple] = []
        kind = None

        def flush() -> None:
            nonlocal left, size
            whole = size <= left
            for k, source, n, passes in held:
                extra = whole or n <= left
                left -= n if extra else 0
                if passes + extra:
                    out.append((k, source, n, passes + extra))
            held.clear()
            size = 0

        def rows() -> pa.RecordBatch:
            cols = list(zip(*out)) if out else [()] * 4
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (kind, pa.string(), pa.int64(), pa.int32()))], names=["k", "source", "n_tokens", "repeats"])

        for b in batches:
            kind = b.schema.field("k").type
            for source, no, k, n, passes, rest in zip(*(b.column(c).to_pylist() for c in ("source", "shard", "k", "n_tokens", "passes", "rest"))):
                if (source, no) != shard:
                    flush()
                    shard, left = (source, no), rest
                elif size + n > block:
                    flush()
                held.append((k, source, n, passes))
                size += n
            yield rows()
        if held:
            flush()
            yield rows()

    return run


def mix_shares(docs: DataFrame, mix: DataFrame, targets: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """Per listed source: target and actual share, available and chosen tokens, and whether the target is met.

    actual_share is 0 where nothing was chosen; met means within ``tolerance`` of the target."""
    t = targets.filter("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max_by("max_repeats", "target_share").alias("max_repeats"))
    have = docs.groupBy("source").agg(F.sum("n_tokens").alias("available_tokens")).withColumnRenamed("source", "hs")
    got = mix.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("chosen_tokens"), F.count("*").alias("chosen_docs"), F.max("repeats").alias("top_repeats")).withColumnRenamed("source", "ms")
    x = t.join(have, F.col("source") == F.col("hs"), "left").join(got, F.col("source") == F.col("ms"), "left").drop("hs", "ms")
    x = x.fillna(0, ["available_tokens", "chosen_tokens", "chosen_docs", "top_repeats"])
    share = F.coalesce(F.try_divide(F.col("chosen_tokens"), F.sum("chosen_tokens").over(Window.partitionBy())), F.lit(0.0))
    x = x.withColumn("actual_share", F.round(share, 6))
    return x.withColumn("met", F.abs(F.col("actual_share") - F.col("target_share")) <= tolerance)
