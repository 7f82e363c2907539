"""Mixing sources to target weights: Sainte-Lague apportionment of equal-token blocks, then seeded block selection."""

from __future__ import annotations

import heapq
import math
import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from blockframe.llm.common import WORD, checkpointed, table, unused

#: Words in a block.
BLOCK = 64
#: Rows of a source in one shard, about.
SHARD_ROWS = 1_000
#: Shards beyond one a source that the driver plans, at most; beyond, shards of all sources grow in proportion.
MAX_SHARDS = 200_000
SEED = 7


def targets(sizes: list[int], weights: list[float], share: float = 1.5, most: float = 2.0) -> list[float]:
    """share of all sizes, split by weight; a source stops at most times its size and the excess is split again by weight until none is above."""
    left, open_, out = share * sum(sizes), [i for i, n in enumerate(sizes)], [0.0] * len(sizes)
    while open_:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / total >= most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in full:
            out[i] = most * float(sizes[i])
        left -= sum(out[i] for i in full)
        gone = set(full)
        open_ = [i for i in open_ if i not in gone]
    return out


def sainte_lague(votes: list[float], seats: int, caps: list[int]) -> list[int]:
    """seats by highest quotients votes / (2 s + 1), none above its cap; ties to the smaller index. Starts from rounded shares, which are within a few seats, so the heaps stay short."""
    total = sum(votes)
    got = [min(c, math.floor(v * seats / total + 0.5)) if total else 0 for v, c in zip(votes, caps, strict=True)]
    short = min(seats, sum(caps)) - sum(got)
    if short > 0:
        heap = [(-v / (2 * g + 1), i) for i, (v, g, c) in enumerate(zip(votes, got, caps, strict=True)) if g < c]
        heapq.heapify(heap)
        for _ in range(short):
            _, i = heapq.heappop(heap)
            got[i] += 1
            if got[i] < caps[i]:
                heapq.heappush(heap, (-votes[i] / (2 * got[i] + 1), i))
    elif short < 0:
        heap = [(votes[i] / (2 * g - 1), -i) for i, g in enumerate(got) if g]
        heapq.heapify(heap)
        for _ in range(-short):
            _, i = heapq.heappop(heap)
            i = -i
            got[i] -= 1
            if got[i]:
                heapq.heappush(heap, (votes[i] / (2 * got[i] - 1), -i))
    return got


def _lots(seed: int, source: str | None, shard: int, count: int) -> tuple[int, int]:
    """step and shift: of a shard's count blocks, those b with (b step + shift) mod count < m are its selection of m."""
    dice = random.Random(f"{seed}/{source}/{shard}")
    step = next((x for x in (dice.randrange(1, count) for _ in range(10_000)) if math.gcd(x, count) == 1), 1) if count > 1 else 1
    return step, dice.randrange(max(1, count))


def quotas(sizes: list[int], want: float, block: int, most: int, lots: list[tuple[int, int]]) -> list[int]:
    """Blocks that each shard of a source gives, by highest quotients: as many that their words, short last blocks counted as what they are, come closest to want."""
    counts = [math.ceil(n / block) for n in sizes]
    caps = [most * c for c in counts]

    def taken(quota: list[int]) -> int:
        total = 0
        for n, c, q, (step, shift) in zip(sizes, counts, quota, lots, strict=True):
            if c:
                passes, more = divmod(q, c)
                total += passes * n + more * block - (c * block - n if ((c - 1) * step + shift) % c < more else 0)
        return total

    # more seats take more words, one block each
    low, high = min(math.floor(want / block), sum(caps)), sum(caps)
    reach = low + 64
    while reach < high and taken(sainte_lague(sizes, reach, caps)) < want:
        low, reach = reach, low + 2 * (reach - low)
    high = min(high, reach)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if taken(sainte_lague(sizes, mid, caps)) >= want else (mid + 1, high)
    return min((sainte_lague(sizes, s, caps) for s in (low, max(0, low - 1))), key=lambda q: abs(taken(q) - want))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, pattern: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """One row per input row: id, source, size, source_size, target, taken. Other columns are ignored; an empty table gives an empty result.

    size counts the words of the text (null: 0). Sources in code point order, null last, weigh pattern, repeating.
    Each source's rows are dealt over shards by a seeded hash of the id and laid end to end in a seeded order; the line is
    cut into blocks of `block` words, the last one of what is left. A source has shards by its own rows, and its shards give blocks by highest quotients until their words come closest to its target; a shard
    with q of n blocks takes every block q // n times and a seeded selection of q % n blocks once more. taken is what the
    document's words in those blocks come to, at most `most` times its size. Rows of equal id and size are interchangeable.
    The driver holds one row per source and shard: at most MAX_SHARDS and one more for each source, which is also the bound of what is broadcast.
    """
    spark = docs.sparkSession
    rows = checkpointed(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size")))
    per = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    per.sort(key=lambda r: (r.source is None, r.source or ""))
    each = max(SHARD_ROWS, sum(r.n for r in per) / MAX_SHARDS)
    shards = {r.source: math.ceil(r.n / each) for r in per}
    wanted = targets([r["size"] for r in per], [pattern[i % len(pattern)] for i in range(len(per))], share, most)
    split = spark.createDataFrame([(k, n) for k, n in shards.items() if n > 1], "split_source string, shards long")
    rows = rows.join(F.broadcast(split) if len(shards) <= MAX_SHARDS else split, F.col("source").eqNullSafe(F.col("split_source")), "left").withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "id"), F.coalesce("shards", F.lit(1))).cast("int")).drop("split_source", "shards")
    cells: dict = {}
    for r in rows.groupBy("source", "shard").agg(F.sum("size").alias("size")).collect():
        cells.setdefault(r.source, []).append((r.shard, r["size"]))
    plan = []
    for r, want in zip(per, wanted, strict=True):
        own = sorted(cells[r.source])
        counts = [math.ceil(n / block) for _, n in own]
        lots = [_lots(seed, r.source, shard, count) for (shard, _), count in zip(own, counts, strict=True)]
        for (shard, _), count, quota, (step, shift) in zip(own, counts, quotas([n for _, n in own], want, block, most, lots), lots, strict=True):
            plan.append((r.source, shard, int(r["size"]), float(want), max(1, count), quota // max(1, count), quota % max(1, count), step, shift))
    cell = spark.createDataFrame(plan, "cell_source string, cell_shard int, source_size long, target double, count long, passes long, more long, step long, shift long")
    line = Window.partitionBy("source", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "id"), "id", "size")
    placed = rows.withColumn("end", F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0))).withColumn("start", F.col("end") - F.col("size"))
    joined = placed.join(F.broadcast(cell) if len(plan) <= 2 * MAX_SHARDS else cell, F.col("source").eqNullSafe(F.col("cell_source")) & (F.col("shard") == F.col("cell_shard")))
    picked = F.expr(f"""aggregate(sequence(start div {block}, (end - 1) div {block}), 0L, (sum, b) -> sum
        + if(pmod(b * step + shift, count) < more, least((b + 1) * {block}, end) - greatest(b * {block}, start), 0L))""")
    return joined.select("id", "source", "size", "source_size", "target", (F.col("passes") * F.col("size") + F.when(F.col("size") > 0, picked).otherwise(F.lit(0))).cast("long").alias("taken"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id").drop("source")


ORACLE_SQL: dict[str, str] = {}


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each document as often as the mix takes it. A document of which taken words are wanted appears floor(taken / size) times,
    and once more with a seeded chance of the remaining fraction; one that is not taken goes, one without words stays once. All columns kept."""
    own, size, taken, copy = (unused(docs, name) for name in ("_own_id", "_size", "_taken", "_copy"))
    plan = mix(docs).groupBy(F.col("id").alias(own)).agg(F.max("size").alias(size), F.max("taken").alias(taken))
    part = F.col(taken) / F.col(size)
    chance = F.pmod(F.xxhash64(F.lit(SEED + 2), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    times = F.when(F.col(size) > 0, F.floor(part) + F.when(chance < part - F.floor(part), 1).otherwise(0)).otherwise(1).cast("int")
    copies = docs.join(plan, F.col("doc_id").eqNullSafe(F.col(own)), "left").withColumn(copy, F.when(times > 0, F.sequence(F.lit(1), times)))
    return copies.withColumn(copy, F.explode(copy)).select(*docs.columns)
