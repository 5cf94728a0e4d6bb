"""Shards of near-equal bytes by minimax contiguous partition, in DataFrame operations only.

Atomic groups (equal texts) are ordered by 60 bits of the text's MD5. The smallest feasible shard
capacity is found by binary search; a capacity is checked by cutting greedily. The check needs, for a
running byte count, the last group boundary at or below it. Boundaries stay distributed: the driver
holds prefix sums at the edges of hash cells, at first 4,096 of them, and splits into 64 only those
cells in which a cut may still fall. A greedy walk that stops at known edges gives an upper bound of the
capacity, one that may cut inside an unsplit cell gives a lower bound; when both meet, the capacity and
the cuts are exact. What the driver holds is bounded by cells, not by rows.

Groups of at least a fair share of what is left (at most one for each shard) are dealt first, each to a
shard of its own, so that one huge group of copies doesn't widen the other shards.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoalgraph.llm.runtime import cut, prepare, text_or_empty

CELL_BITS, SPLIT_BITS = 12, 6
OVERHEAD = 8


@dataclass
class Cell:
    low: int
    bits: int  # of the hash that are fixed
    bytes: int
    groups: int

    @property
    def solid(self) -> bool:
        """No cut can fall inside."""
        return self.groups <= 1 or self.bits == 64


def greedy(ends: list[int], cells: list[Cell], shards: int, capacity: int, inside: bool) -> list[int] | None:
    """Positions (in bytes) after each shard but the last; None if the shards don't hold everything."""
    total, at, cuts = ends[-1] if ends else 0, 0, []
    for _ in range(shards):
        target = at + capacity
        if target >= total:
            return cuts
        i = bisect_right(ends, target)  # the cell that holds the target
        edge = ends[i - 1] if i else 0
        at = target if inside and not cells[i].solid else max(at, edge)
        cuts.append(at)
    return None


def least(low: int, high: int, fits) -> int:
    """The smallest value in [low, high] that fits; high fits."""
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if fits(mid) else (mid + 1, high)
    return high


def walked(ends: list[int], cells: list[Cell], shards: int, capacity: int, inside: bool) -> list[int]:
    """As greedy(), but goes on to the end whether or not everything fits."""
    total, at, out = ends[-1] if ends else 0, 0, []
    for _ in range(shards - 1):
        target = min(at + capacity, total)
        i = bisect_right(ends, target)
        edge = ends[i - 1] if i else 0
        at = total if i >= len(cells) else target if inside and not cells[i].solid else max(at, edge)
        out.append(at)
    return out


def cells_of(groups: DataFrame, old: list[Cell] | None) -> list[Cell]:
    """The first cells, or what the old ones split into."""
    bits = CELL_BITS if old is None else min(64, old[0].bits + SPLIT_BITS)
    if old is not None:
        parents = groups.sparkSession.createDataFrame([(c.low >> (64 - c.bits),) for c in old], "parent long")
        groups = groups.join(F.broadcast(parents), F.shiftright("h", 64 - old[0].bits) == F.col("parent"), "left_semi")
    found = groups.groupBy(F.shiftright("h", 64 - bits).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("groups"))
    return sorted((Cell(r["cell"] << (64 - bits), bits, r["bytes"], r["groups"]) for r in found.collect()), key=lambda c: c.low)


def partition(groups: DataFrame, shards: int) -> tuple[list[int], int]:
    """The lowest hash of every shard but the first, and the capacity, for groups (h, bytes) with distinct h."""
    cells = cells_of(groups, None)
    while True:
        ends, total = [], 0
        for c in cells:
            total += c.bytes
            ends.append(total)
        if not total:
            return [], 0
        low = -(-total // shards)
        upper = least(low, total, lambda c: greedy(ends, cells, shards, c, False) is not None)
        lower = least(low, upper, lambda c: greedy(ends, cells, shards, c, True) is not None)
        if lower == upper:
            cuts = greedy(ends, cells, shards, upper, False)
            return [cells[bisect_right(ends, at)].low for at in cuts], upper
        spans = list(zip(walked(ends, cells, shards, lower, False), walked(ends, cells, shards, upper, True), strict=True))
        split = set()
        for a, b in spans:
            split.update(i for i in range(bisect_right(ends, a), min(len(cells) - 1, bisect_right(ends, b)) + 1) if not cells[i].solid)
        if not split:  # every cell in question is solid: the bounds can't differ any more
            cuts = greedy(ends, cells, shards, upper, False)
            return [cells[bisect_right(ends, at)].low for at in cuts], upper
        finer: list[Cell] = []
        for bits in sorted({cells[i].bits for i in split}):
            finer += cells_of(groups, [cells[i] for i in sorted(split) if cells[i].bits == bits])
        cells = sorted([c for i, c in enumerate(cells) if i not in split] + finer, key=lambda c: c.low)


def numbered(df: DataFrame, by: list[str], order: list[Column], out: str, part: Column) -> DataFrame:
    """Gapless numbers from 0 within each group of ``by``, in the order of ``part`` and then of ``order``.

    A group is numbered in all its parts at once. ``by`` and ``part`` must have a bounded number of values: a count for each
    pair of them is broadcast.
    """
    df = df.withColumn("_part", part.cast("int"))
    counts = df.groupBy(*by, "_part").agg(F.count("*").alias("_n"))
    before = counts.select(*by, "_part", (F.sum("_n").over(Window.partitionBy(*by).orderBy("_part")) - F.col("_n")).alias("_before"))
    within = F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order)) - 1
    return df.join(F.broadcast(before), [*by, "_part"]).withColumn(out, (F.col("_before") + within).cast("long")).drop("_part", "_before")


def digits(text: Column, n: int) -> Column:
    """The first n hexadecimal digits of a text's MD5 as a number."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, n), 16, 10).cast("long")


def shard_by_bytes(docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shards 0 to n_shards - 1 of documents, rows with equal texts together, the largest shard as small as it can be.

    A null text is an empty one (size 8, CRC 0); null and repeated ids are rows like any other. An empty
    table gives no rows. Columns of the input other than the two named don't matter.
    """
    prepare(docs.sparkSession)
    text = text_or_empty(text_col)
    base = cut(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.shiftleft(digits(text, 15) - F.lit(1 << 59), 4).alias("h"),  # 60 bits, spread over all 64
        )
    )
    groups = cut(base.groupBy("h").agg(F.sum("size").alias("bytes")))
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    alone: list[int] = []
    left = total
    for r in groups.orderBy(F.desc("bytes"), "h").limit(n_shards).collect():
        if len(alone) < n_shards - 1 and r["bytes"] * (n_shards - len(alone)) >= left:
            alone.append(r["h"])
            left -= r["bytes"]
        else:
            break
    rest = groups.where(~F.col("h").isin(alone)) if alone else groups
    lows, _ = partition(rest, n_shards - len(alone))
    shard = F.lit(len(alone)) + sum((F.when(F.col("h") >= low, 1).otherwise(0) for low in lows), F.lit(0))
    for k, h in enumerate(alone):
        shard = F.when(F.col("h") == h, F.lit(k)).otherwise(shard)
    dealt = base.withColumn("shard", shard.cast("int"))
    out = numbered(dealt, ["shard"], [F.col("doc_id"), F.col("h")], "slot", digits(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), 2))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
