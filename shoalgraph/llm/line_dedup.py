"""Line-level deduplication by pairwise alignment.

Each line that isn't blank is hashed. A line belongs to the first document (by id) that holds it; a later
document that shares a line with its owner is overlapping it, and the two are aligned with patience
diff on their line hashes. Aligned common blocks are deleted from the later document when they
are long enough not to be chance. Runs of lines that are just long enough for that belong to their first document in the
same way: every line of a block that two documents share lies in such a run, so a block is paired with a document that
holds it also where each of its lines stood alone in earlier ones. A document is paired with owners only, so the number
of pairs grows with the number of lines, however many copies a line has. Lines of very many documents (there can be only a
few thousand of them) find their owner by broadcast, so that a line that all documents share lands in no single task.

``rare_share`` and ``rare_least`` are for callers who want frequent lines to stay: lines and runs that more documents hold
then start no alignment. Unless they are asked for there is no such bound. Exact copies are no evidence of
frequency: equal texts are counted once, and a later equal text is deleted whole against the first.

What travels is line hashes, 8 bytes a line; texts are shuffled once, to delete lines from them.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoalgraph.llm.blocks import mixed, powers
from shoalgraph.llm.runtime import cut, join_by_size, prepare, text_or_empty, unused

WHITE = " \t\x0b\x0c\r"


def patience(a: list[int], b: list[int]) -> list[tuple[int, int, int]]:
    """Aligned blocks (start in a, start in b, length): common ends first, then the longest rising run of lines
    that are unique on either side, then the same between these."""
    found: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, p, j, q = todo.pop()
        while i < p and j < q and a[i] == b[j]:
            found.append((i, j))
            i, j = i + 1, j + 1
        while i < p and j < q and a[p - 1] == b[q - 1]:
            p, q = p - 1, q - 1
            found.append((p, q))
        if i >= p or j >= q:
            continue
        once: dict[int, int] = {}
        for k in range(i, p):
            once[a[k]] = -1 if a[k] in once else k
        twin: dict[int, int] = {}
        for k in range(j, q):
            if once.get(b[k], -1) >= 0:
                twin[b[k]] = -1 if b[k] in twin else k
        pairs = sorted((once[h], k) for h, k in twin.items() if k >= 0)
        if not pairs:
            continue
        tails: list[int] = []
        ends: list[int] = []
        back = [-1] * len(pairs)
        for k, (_, y) in enumerate(pairs):
            at = bisect_left(tails, y)
            back[k] = ends[at - 1] if at else -1
            tails[at : at + 1] = [y]
            ends[at : at + 1] = [k]
        k, run = ends[-1], []
        while k >= 0:
            run.append(pairs[k])
            k = back[k]
        run.reverse()
        x0, y0 = i, j
        for x, y in [*run, (p, q)]:
            todo.append((x0, x, y0, y))
            if x < p or y < q:
                found.append((x, y))
            x0, y0 = x + 1, y + 1
    found.sort()
    blocks: list[list[int]] = []
    for x, y in found:
        if blocks and blocks[-1][0] + blocks[-1][2] == x and blocks[-1][1] + blocks[-1][2] == y:
            blocks[-1][2] += 1
        else:
            blocks.append([x, y, 1])
    return [(x, y, n) for x, y, n in blocks]


def long_runs(h: np.ndarray, size: np.ndarray, offsets: np.ndarray, min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first line, end line, text, hash) of each text's shortest runs of ``min_chars`` from or up to each line."""
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    length = np.append(0, np.cumsum(size, dtype=np.int64))
    power, inverse = powers(len(h) + 1)
    sums = np.append(np.uint64(0), np.cumsum(h * power[: len(h)]))
    at = np.arange(len(h))
    end = np.searchsorted(length, length[:-1] + min_chars)
    first = np.searchsorted(length, length[1:] - min_chars, side="right") - 1
    a, b = end <= offsets[1:][row], first >= offsets[:-1][row]
    lo, hi, of = np.append(at[a], first[b]), np.append(end[a], at[b] + 1), np.append(row[a], row[b])
    return lo, hi, of, mixed((sums[hi] - sums[lo]) * inverse[lo] + (hi - lo).astype(np.uint64))


def in_long_runs(mine: np.ndarray, sizes: np.ndarray, theirs: np.ndarray, min_chars: int) -> np.ndarray:
    """Which lines lie in a run of at least ``min_chars`` that stands in the other text as well."""
    lines, where = np.unique(mine, return_index=True)
    at = np.minimum(np.searchsorted(lines, theirs), len(lines) - 1)
    their_sizes = np.where(lines[at] == theirs, sizes[where[at]], min_chars)  # what isn't shared ends a run
    lo, hi, _, own = long_runs(mine, sizes, np.array([0, len(mine)]), min_chars)
    shared = np.isin(own, long_runs(theirs, their_sizes, np.array([0, len(theirs)]), min_chars)[3])
    edge = np.zeros(len(mine) + 1, np.int64)
    np.add.at(edge, lo[shared], 1)
    np.add.at(edge, hi[shared], -1)
    return np.cumsum(edge[:-1]) > 0


def overlap(mine: np.ndarray, sizes: np.ndarray, theirs: np.ndarray, min_chars: int) -> set[int]:
    """Lines of mine in aligned blocks of at least ``min_chars``: all that lie in a run of that size which the other text has too.

    A block that crosses others (as it was moved), or whose lines repeat, isn't aligned with them, so the first places of what is
    left of long common runs are aligned again until nothing is left. A line long enough by itself counts wherever the text
    holds it.
    """
    lines, other = mine.tolist(), theirs.tolist()
    gone = {k for x, _, n in patience(lines, other) if sizes[x : x + n].sum() >= min_chars for k in range(x, x + n)}
    shared = np.isin(mine, theirs)
    if shared.sum() == len(gone) or sizes[shared].sum() < min_chars:
        return gone
    left = set(np.flatnonzero(in_long_runs(mine, sizes, theirs, min_chars)).tolist())
    once = list(dict.fromkeys(other))
    while True:
        alone = {lines[k] for k in gone if sizes[k] >= min_chars}
        gone |= {k for k in left if lines[k] in alone}
        left -= gone
        first = {lines[k]: k for k in sorted(left, reverse=True)}
        rest = sorted(first.values())
        new = {rest[k] for x, _, n in patience([lines[k] for k in rest], once) for k in range(x, x + n)} if left else set()
        if not new:
            return gone
        gone |= new


def alignments(batches: Iterator[pa.RecordBatch], min_chars: int) -> Iterator[pa.RecordBatch]:
    """Columns later, lines, sizes, owner's lines -> later and the lines to delete."""
    for batch in batches:
        ids, out = [], []
        for i in range(batch.num_rows):
            mine, sizes, theirs = (batch.column(k)[i].values.to_numpy(zero_copy_only=False) for k in (1, 2, 3))
            gone = sorted(overlap(mine.view(np.uint64), sizes, theirs.view(np.uint64), min_chars))
            if gone:
                ids.append(i)
                out.append(gone)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), pa.array(out, pa.list_(pa.int32()))], ["later", "gone"])


def starts(batches: Iterator[pa.RecordBatch], min_chars: int) -> Iterator[pa.RecordBatch]:
    """Columns doc_id, lines, sizes -> doc_id and, once each, its lines and its shortest runs of ``min_chars`` from or up to each line."""
    for batch in batches:
        h = batch.column(1).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        size = batch.column(2).flatten().to_numpy(zero_copy_only=False)
        offsets = batch.column(1).offsets.to_numpy()
        offsets = offsets - offsets[0]
        row = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
        lo, hi, of, runs = long_runs(h, size, offsets, min_chars)
        more = hi - lo > 1
        keys, of = np.append(h, runs[more]), np.append(row, of[more])
        order = np.lexsort((keys, of))
        keys, of = keys[order], of[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (of[1:] != of[:-1])
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of[new])), pa.array(keys[new].view(np.int64))], ["doc_id", "line"])


def lines_of(text):
    return F.transform(F.split(text, "\n"), lambda s: F.btrim(s, F.lit(WHITE)))


def removals(docs: DataFrame, rare_share: float | None, rare_least: int, min_chars: int, id_col: str, text_col: str) -> DataFrame:
    """(key, doc_id, gone): places (from 0, blank lines not counted) of lines to delete from later texts; an empty list
    stands for the whole text."""
    text = text_or_empty(text_col)
    full = F.filter(lines_of(text), lambda s: s != "")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.md5(text.cast("binary"))).alias("key"), full.alias("x"))
    rows = rows.where((F.size("x") > 0) & F.col("doc_id").isNotNull())
    rows = cut(rows.select("doc_id", "key", F.transform("x", lambda s: F.xxhash64(s)).alias("lines"), F.transform("x", F.length).alias("sizes")))
    firsts = rows.groupBy("key").agg(F.min_by(F.struct("lines", "sizes"), "doc_id").alias("x"), F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    firsts = firsts.select("doc_id", "key", "copies", "x.*")
    firsts = cut(firsts)
    kind = docs.schema[id_col].dataType.simpleString()
    lines = cut(firsts.select("doc_id", "lines", "sizes").mapInArrow(lambda it: starts(it, min_chars), f"doc_id {kind}, line long"))
    owners = lines.groupBy("line").agg(F.min("doc_id").alias("owner"), F.count("*").alias("df")).where(F.col("df") > 1)
    if rare_share is not None:
        owners = owners.where(F.col("df") <= max(rare_least, int(rare_share * firsts.count())))
    owned = join_by_size(lines, cut(owners), "line", "df")
    pairs = owned.where(F.col("doc_id") != F.col("owner")).select(F.col("doc_id").alias("later"), "owner").distinct()
    later = firsts.select(F.col("doc_id").alias("later"), "lines", "sizes")
    owner = firsts.select(F.col("doc_id").alias("owner"), F.col("lines").alias("theirs"))
    aligned = pairs.join(owner, "owner").join(later, "later").select("later", "lines", "sizes", "theirs")
    gone = aligned.mapInArrow(lambda it: alignments(it, min_chars), f"later {kind}, gone array<int>")
    gone = gone.select("later", F.explode("gone").alias("k")).groupBy("later").agg(F.collect_set("k").alias("gone"))
    partly = gone.join(firsts.select(F.col("doc_id").alias("later"), "key"), "later").select("key", F.col("later").alias("doc_id"), "gone")
    several = firsts.where("copies > 1").select("key", F.col("doc_id").alias("first"), "copies")
    whole = join_by_size(rows.select("doc_id", "key"), several, "key", "copies").where(F.col("doc_id") != F.col("first"))
    whole = whole.select("key", "doc_id", F.array().cast("array<int>").alias("gone")).distinct()
    return partly.unionByName(whole)


def dedup_lines(
    docs: DataFrame, rare_share: float | None = None, rare_least: int = 50, min_chars: int = 40, id_col: str = "doc_id", text_col: str = "text", report: bool = False
) -> DataFrame:
    """The documents with duplicate line blocks deleted from later ones; all columns and rows stay.

    With report, doc_id, n_lines (that aren't blank), n_removed and the remaining text are returned instead. The first of
    equal texts (by id) stays, later ones become empty. Rows with a null id are never the earlier or later one
    and stay as they are; a null or blank text stays too. Repeated rows (same id and text) count as one. An
    empty table gives no rows.
    """
    prepare(docs.sparkSession)
    cuts = removals(docs, rare_share, rare_least, min_chars, id_col, text_col)
    own, gone, key, key_id = unused(docs, "text_key", "gone", "cut_key", "cut_id")
    cuts = cuts.select(F.col("key").alias(key), F.col("doc_id").alias(key_id), F.col("gone").alias(gone))
    keyed = docs.withColumn(own, F.unhex(F.md5(text_or_empty(text_col).cast("binary"))))
    found = keyed.join(cuts, (F.col(own) == F.col(key)) & (F.col(f"`{id_col}`") == F.col(key_id)), "left")
    if report:
        kind = docs.schema[id_col].dataType.simpleString()
        chosen = found.select(F.col(f"`{id_col}`").alias("doc_id"), text_or_empty(text_col).alias("text"), gone)
        return chosen.mapInArrow(lambda it: reported(it), f"doc_id {kind}, n_lines long, n_removed long, text string")
    at = docs.columns.index(text_col)
    schema = T.StructType([T.StructField(f.name, T.StringType() if f.name == text_col else f.dataType) for f in docs.schema])
    return found.select(*[F.col(f"`{c}`") for c in docs.columns], gone).mapInArrow(lambda it: shortened(it, at), schema)


def remaining(text: str, gone: list[int] | None) -> tuple[str, int, int]:
    """The text without the lines (or, for an empty list, without any); lines that aren't blank, and how many of them went."""
    if gone is not None and not gone:
        n = sum(1 for s in text.split("\n") if s.strip(WHITE))
        return "", n, n
    out, k, away = [], 0, set(gone or ())
    for s in text.split("\n"):
        if not s.strip(WHITE):
            out.append(s)
            continue
        if k not in away:
            out.append(s)
        k += 1
    return ("\n".join(out) if away else text), k, len(away)


def reported(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [remaining(t.as_py(), g.as_py()) for t, g in zip(batch.column(1), batch.column(2), strict=True)]
        texts, lines, away = zip(*found, strict=True) if found else ((), (), ())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lines, pa.int64()), pa.array(away, pa.int64()), pa.array(texts, pa.string())], ["doc_id", "n_lines", "n_removed", "text"])


def shortened(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    """Columns of the documents and the lines to delete -> columns of the documents."""
    for batch in batches:
        texts = [t.as_py() if not g.is_valid else remaining(t.as_py() or "", g.as_py())[0] for t, g in zip(batch.column(at), batch.column(batch.num_columns - 1), strict=True)]
        columns = [pa.array(texts, pa.string()) if k == at else c for k, c in enumerate(batch.columns[:-1])]
        yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1])
