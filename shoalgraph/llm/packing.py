"""Packing of tokenised documents into sequences by minimum bin slack over piece lengths.

A document's tokens are cut into windows of the sequence length from its start; what is left (shorter
than a sequence) is its last piece. Pieces matter to the packer only by their length, so the corpus
reduces to at most 2,048 counts. For each sequence the packer takes the largest length that is left and
fills the rest of the window by a subset-sum dynamic programme over the multiset of lengths: bit w of
a big integer says that w can be filled, binary-split multiplicities keep the multiset bounded, and
the choice closest to the capacity is backtracked into counts per length. The same pattern is then used
as often as the counts allow, so planning takes a bounded number of patterns at any corpus size.
Pieces find their place by their rank among pieces of equal length, numbered in parts all over the
cluster.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoalgraph.llm.runtime import cut, prepare, text_or_empty
from shoalgraph.llm.sharding import numbered


class Encoder:
    """Ids as the tokenizers library gives them (special strings inside texts become their ids).

    A byte-level vocabulary that also comes as ranks is run by the quicker library over these; the two give equal ids
    for texts without special strings, and texts with one go to the first library.
    """

    def __init__(self, name: str):
        import public_tokenizers
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(public_tokenizers.path(name))
        self.special = [t.content for t in self.full.get_added_tokens_decoder().values()]
        self.quick = None
        if name == "byte_bpe_50k.json":
            import tiktoken

            with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.quick = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.quick is None or any(s in text for s in self.special):
            return np.array(self.full.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return self.quick.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)


#: Parts in which pieces of one length are numbered at once: whole windows (most pieces), and any other length.
PARTS = 4096, 16
PIECES = "start long, length long, ids_crc32 long, doc_tokens long"


def pieces(batches: Iterator[pa.RecordBatch], tokenizer: str, length: int, end: int, keep_ids: bool) -> Iterator[pa.RecordBatch]:
    encoder = Encoder(tokenizer)
    for batch in batches:
        rows, found, ids_out = [], [], []

        def flush() -> pa.RecordBatch:
            cols = list(zip(*found, strict=True)) or [(), (), (), ()]
            arrays = [batch.column(0).take(pa.array(rows, pa.int64()))] + [pa.array(c, pa.int64()) for c in cols]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if keep_ids:
                arrays.append(pa.array(ids_out, pa.list_(pa.int32())))
                names.append("ids")
            out = pa.RecordBatch.from_arrays(arrays, names)
            rows.clear(), found.clear(), ids_out.clear()
            return out

        for i, text in enumerate(batch.column(1)):
            ids = np.append(encoder.ids(text.as_py() or ""), np.array([end], "<u4"))
            for at in range(0, len(ids), length):
                part = ids[at : at + length]
                rows.append(i)
                found.append((at, len(part), zlib.crc32(part.tobytes()), len(ids)))
                if keep_ids:
                    ids_out.append(part.astype(np.int32))
            if len(found) > 20_000:
                yield flush()
        yield flush()


def fill(counts: list[int], capacity: int) -> list[tuple[int, int]]:
    """(length, how many) of a choice from the multiset whose sum comes closest to capacity without exceeding it."""
    reach, trail = 1, []
    mask = (1 << (capacity + 1)) - 1
    for size in range(capacity, 0, -1):
        left = min(counts[size], capacity // size)
        step = 1
        while left and not reach >> capacity & 1:
            take = min(step, left)
            trail.append((size, take, reach))
            reach |= (reach << (size * take)) & mask
            left -= take
            step *= 2
        if reach >> capacity & 1:
            break
    at, chosen = reach.bit_length() - 1, {}
    for size, take, before in reversed(trail):
        if not before >> at & 1:
            chosen[size] = chosen.get(size, 0) + take
            at -= size * take
    return list(chosen.items())


def plan(counts: dict[int, int], length: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns (times, [(length, pieces of it in each sequence)]) that use every piece once."""
    left = [0] * (length + 1)
    for size, n in counts.items():
        left[size] = n
    out = []
    top = length
    while True:
        while top and not left[top]:
            top -= 1
        if not top:
            return out
        left[top] -= 1
        chosen = dict(fill(left, length - top))
        left[top] += 1
        chosen[top] = chosen.get(top, 0) + 1
        times = min(left[size] // n for size, n in chosen.items())
        for size, n in chosen.items():
            left[size] -= n * times
        out.append((times, sorted(chosen.items(), reverse=True)))


def place_rows(patterns: list[tuple[int, list[tuple[int, int]]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, pieces in each sequence, first sequence, offset of the first one)."""
    rank: dict[int, int] = {}
    rows, sequence = [], 0
    for times, chosen in patterns:
        offset = 0
        for size, n in chosen:
            first = rank.get(size, 0)
            rank[size] = first + n * times
            rows.append((size, first, rank[size], n, sequence, offset))
            offset += size * n
        sequence += times
    return rows


def stepped(rows: list[tuple[int, int, int, int, int, int]]) -> tuple[list[tuple[int, int]], list[tuple]]:
    """(length, step) of each length, and the rows once for each step of ranks that they reach into.

    With as many steps as rows a length has at most twice as many entries, and a rank meets two of them on average.
    """
    last, many = {}, {}
    for size, _, end, *_ in rows:
        last[size], many[size] = max(end, last.get(size, 0)), many.get(size, 0) + 1
    step = {size: -(-end // many[size]) for size, end in last.items()}
    return sorted(step.items()), [(r[0], k, *r[1:]) for r in rows for k in range(r[1] // step[r[0]], (r[2] - 1) // step[r[0]] + 1)]


def pack(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", length: int = 2048, end: int = 1, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row for each piece of each document, with its sequence and its offset there; with keep_ids its ids too.

    A null or empty text is the end id alone. Ids of documents may be null or repeat: each row is a document of its own. An
    empty table gives no rows; other columns don't matter.
    """
    spark = prepare(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, {PIECES}" + ", ids array<int>" * keep_ids
    made = cut(docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(lambda it: pieces(it, tokenizer, length, end, keep_ids), schema))
    counts = {int(r["length"]): r["n"] for r in made.groupBy("length").agg(F.count("*").alias("n")).collect()}
    steps, rows = stepped(place_rows(plan(counts, length)))
    table = spark.createDataFrame(rows, "length long, at long, low long, high long, each long, first_sequence long, first_offset long")
    part = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.when(F.col("length") == length, PARTS[0]).otherwise(PARTS[1]))
    ranked = numbered(made, ["length"], [F.col("doc_id"), F.col("start")], "rank", part)
    ranked = ranked.join(F.broadcast(spark.createDataFrame(steps, "length long, step long")), "length").withColumn("at", F.floor(F.col("rank") / F.col("step")))
    near = (F.col("p.length") == F.col("t.length")) & (F.col("p.at") == F.col("t.at"))
    placed = ranked.alias("p").join(F.broadcast(table).alias("t"), near & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    step = F.col("rank") - F.col("low")
    return placed.select(
        "doc_id",
        "start",
        F.col("p.length").alias("length"),
        "ids_crc32",
        "doc_tokens",
        (F.col("first_sequence") + F.floor(step / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("first_offset") + F.pmod(step, F.col("each")) * F.col("p.length")).cast("long").alias("offset"),
        *(["ids"] if keep_ids else []),
    )
