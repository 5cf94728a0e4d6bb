"""Benchmark decontamination by latent semantic retrieval.

Texts become lower-case words. Passages are pairs of neighbouring blocks of as many words as the longest benchmark
item, so any place where an item can stand lies within one passage. Terms are the words of the benchmark;
other words can't add to a similarity. All documents are read once to note where which terms stand (a table of a
fraction of their size, written to the shared folder), and that table is scanned three times:

1. document frequencies of the terms over all blocks;
2. a single-pass randomised SVD of the TF-IDF matrix of all blocks and items: every task multiplies its rows
   with a shared random matrix and sends one row of the product for each term; their sum, the sketch of
   A'A, gives the leading right singular vectors (Nystroem form). Its size is terms times rank, whatever the
   corpus is;
3. every passage is projected; items with a cosine of at least ``cosine`` are candidates, and a candidate is
   a leak if the longest common subsequence of item and passage, within a stretch of 1.5 item lengths,
   covers enough of the item, or somewhat less of it together with nearly all of its answer (the last third).

Two more ways make a candidate, as frequent terms have no weight in the cosine. Every place where an item stands
word for word is one, found from the item's rarest word. And an item that leaks so often that its own words
are frequent, so that stop words hold more of its weight than ``TRUSTED`` allows, is not left to the cosine: each passage that
holds 0.6 of its words is a candidate, which misses no leak, as a leak has that share in common with its passage.

The benchmark is taken in blocks of about ``ITEMS`` different texts or ``CHARS`` characters, so that what is broadcast stays
bounded; items of equal text are one until the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoalgraph.llm.blocks import LOWER, PUNCTUATION, Prefix, chunks, tidied, words
from shoalgraph.llm.runtime import cut, prepare, text_or_empty

ITEMS, CHARS, RANK, OVER, SEED = 1024, 1 << 19, 192, 16, 7
#: Terms in more than this share of the blocks are stop words.
MAX_DF = 0.05
#: Items of which terms that aren't stop words hold less than this share of the weight are searched by their words.
TRUSTED = 0.8
#: Share of an item's words that any leak has.
LEAST = 0.6
#: Slots by which words are looked up among the terms, and words of texts that are taken at once.
FILTER, AT_ONCE = 1 << 18, 1 << 20
#: Terms of blocks that are sketched at once, and those of them that have a dense row of their own at a time (about a processor's cache).
ENTRIES, TILE = 1 << 15, 1 << 10


@dataclass
class Model:
    keys: list  # of the items' texts
    items: list[np.ndarray]  # numbers of their words
    vocab: np.ndarray  # hashes of the terms, sorted
    stride: int
    cosine: float
    lcs: float
    slots: np.ndarray = field(default=None)  # a term of each slot, or -1
    several: np.ndarray = field(default=None)  # slots of more than one term
    idf: np.ndarray = field(default=None)
    basis: np.ndarray = field(default=None)  # idf times right singular vectors
    queries: np.ndarray = field(default=None)
    anchors: dict[int, list[tuple[int, int]]] = field(default_factory=dict)  # term -> items of which it is the rarest, and where
    hot: np.ndarray = field(default=None)  # items that leak too often for the cosine
    columns: np.ndarray = field(default=None)  # column in times of each term, or -1
    times: np.ndarray = field(default=None)  # how often each hot item holds each of their terms

    def __post_init__(self):
        slot = (self.vocab & np.uint64(FILTER - 1)).astype(np.int64)
        self.slots = np.full(FILTER, -1, np.int32)
        self.slots[slot] = np.arange(len(slot))
        self.several = np.bincount(slot, minlength=FILTER) > 1

    def search(self, df: np.ndarray, total: int) -> None:
        """Weights of the terms, and what finds leaks that the cosine can't see."""
        smooth = np.log((1 + total) / (1 + df)) + 1
        self.idf = np.where(df / total > max(MAX_DF, 2 / total), 0.0, smooth)
        for i, x in enumerate(self.items):
            at = int(np.argmin(df[x]))
            self.anchors.setdefault(int(x[at]), []).append((i, at))
        kept = [(smooth[t] ** 2)[self.idf[t] > 0].sum() / (smooth[t] ** 2).sum() for t in map(np.unique, self.items)]
        self.hot = np.flatnonzero(np.array(kept) < TRUSTED)
        terms = np.unique(np.concatenate([self.items[i] for i in self.hot])) if len(self.hot) else np.zeros(0, np.int64)
        self.columns = np.full(len(self.vocab), -1)
        self.columns[terms] = np.arange(len(terms))
        self.times = np.zeros((len(terms), len(self.hot)), np.float32)
        for j, i in enumerate(self.hot):
            np.add.at(self.times[:, j], self.columns[self.items[i]], 1)
        if not self.idf.any():
            self.idf[:] = 1

    def terms(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words that are terms, and their numbers."""
        slot = (h & np.uint64(FILTER - 1)).view(np.int64)
        k = self.slots[slot]
        at = np.flatnonzero(k >= 0)
        k, own = k[at].astype(np.int64), h[at]
        more = np.flatnonzero(self.several[slot[at]])
        k[more] = np.minimum(np.searchsorted(self.vocab, own[more]), len(self.vocab) - 1)
        ok = self.vocab[k] == own
        return at[ok], k[ok]


@dataclass
class Found:
    """Terms in some texts: how many words lie before each text (and in all), places and numbers of the terms."""

    before: np.ndarray
    at: np.ndarray
    term: np.ndarray

    def blocked(self, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(block, term, how often) once for each pair, and the first block of every text (and the end)."""
        first = np.append(0, np.cumsum(np.maximum(1, -(-np.diff(self.before) // model.stride))))
        text = np.searchsorted(self.before, self.at, side="right") - 1
        block = first[text] + (self.at - self.before[text]) // model.stride
        size = max(1, len(model.vocab))
        pair, times = np.unique(block * size + self.term, return_counts=True)
        return pair // size, pair % size, times, first

    def sequence(self) -> np.ndarray:
        """Every word's number, -1 for words that aren't terms."""
        out = np.full(int(self.before[-1]), -1, np.int32)
        out[self.at] = self.term
        return out


def hashed(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    buf = LOWER[buf]
    start, end, before = words(buf, offsets, PUNCTUATION)
    return Prefix(buf).spans(start, end), before


def of_texts(batch: pa.RecordBatch, column: int, model: Model) -> Iterator[tuple[int, Found]]:
    """The terms of a batch's texts, a few texts at a time, with the row of the first."""
    for lo, _, buf, offsets in chunks(batch.column(column)):
        h, before = hashed(buf, offsets)
        yield lo, Found(before, *model.terms(h))


@tidied
def noted(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """Columns doc_id, text -> doc_id, n (words), terms: places from the text's first word and numbers of its terms."""
    for batch in batches:
        n, out = np.zeros(batch.num_rows, np.int64), []
        for lo, found in of_texts(batch, 1, model):
            count = len(found.before) - 1
            n[lo : lo + count] = np.diff(found.before)
            edge = np.searchsorted(found.at, found.before)
            place = found.at - np.repeat(found.before[:-1], np.diff(edge))
            both = np.stack([place, found.term], axis=1).astype("<i4")
            out += [both[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(out, pa.binary())], ["doc_id", "n", "terms"])


def of_notes(batch: pa.RecordBatch) -> Iterator[tuple[int, Found]]:
    """As of_texts(), from columns doc_id, n, terms."""
    n = batch.column(1).to_numpy()
    offsets = np.append(0, np.cumsum(n))
    notes = batch.column(2).cast(pa.large_binary())
    if not len(n):
        return
    edge = np.frombuffer(notes.buffers()[1], np.int64)[notes.offset : notes.offset + len(n) + 1] // 8
    data = notes.buffers()[2]
    both = np.frombuffer(data, "<i4")[: 2 * edge[-1]].reshape(-1, 2) if edge[-1] else np.zeros((0, 2), np.int32)
    lo = 0
    while lo < len(n):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + AT_ONCE, side="right")) - 1)
        own = both[edge[lo] : edge[hi]].astype(np.int64)
        before = offsets[lo : hi + 1] - offsets[lo]
        yield lo, Found(before, own[:, 0] + np.repeat(before[:-1], np.diff(edge[lo : hi + 1])), own[:, 1])
        lo = hi


@tidied
def frequencies(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    df, total = np.zeros(len(model.vocab), np.int64), 0
    for batch in batches:
        for _, found in of_notes(batch):
            _, term, _, first = found.blocked(model)
            df += np.bincount(term, minlength=len(df))
            total += int(first[-1])
    seen = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, -1), pa.int32()), pa.array(np.append(df[seen], total))], ["term", "n"])


def weighted(model: Model, block: np.ndarray, term: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(block, term, TF-IDF weight) of the terms that have a weight; a term's frequency counts by its logarithm."""
    keep = model.idf[term] > 0
    return block[keep], term[keep], ((1 + np.log(times[keep])) * model.idf[term[keep]]).astype(np.float32)


def normed(rows: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """Weights of sparse entries after each row is given length one."""
    length = np.sqrt(np.bincount(rows, weights=weights**2, minlength=n))
    return (weights / np.maximum(length[rows], 1e-12)).astype(np.float32)


def add_products(into: np.ndarray, rows: np.ndarray, weights: np.ndarray, column: np.ndarray, table: np.ndarray) -> None:
    """Adds to each (sorted) row the table's rows of its entries, by weight.

    Rows of equally many entries are multiplied together; of a row of over TILE entries, TILE at a time.
    """
    if not len(rows):
        return
    at = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
    count = np.diff(np.append(at, len(rows)))
    pieces = -(-count // TILE)
    if pieces.max() > 1:
        at = np.repeat(at, pieces) + TILE * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        count = np.diff(np.append(at, len(rows)))
    order = np.argsort(count, kind="stable")
    at, count = at[order], count[order]
    edges = np.flatnonzero(np.append(True, count[1:] != count[:-1]))
    for lo, hi in zip(edges, np.append(edges[1:], len(at)), strict=True):
        n = int(count[lo])
        step = TILE // n  # pieces of TILE entries, which may be of one row, are alone
        for first in range(lo, hi, step):
            own = at[first : min(hi, first + step)]
            entries = own[:, None] + np.arange(n)
            into[rows[own]] += np.matmul(weights[entries][:, None], table[column[entries]])[:, 0]


def projected(model: Model, block: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Sums of the basis rows of each (sorted) block's terms."""
    out = np.zeros((n, model.basis.shape[1]), np.float32)
    add_products(out, block, (weight / model.idf[term]).astype(np.float32), term, model.basis)
    return out


def omega(n: int, width: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((n, width), dtype=np.float32)


def sketch(block: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, om: np.ndarray, into: np.ndarray) -> None:
    """Adds A' (A omega) of some rows of A, given as weights that are normed here."""
    w = normed(block, weight, n)
    lo = 0
    while lo < len(block):
        hi = min(len(block), lo + ENTRIES)
        hi = int(np.searchsorted(block, block[hi - 1], side="right"))
        rows, inverse = np.unique(block[lo:hi], return_inverse=True)
        y = np.zeros((len(rows), om.shape[1]), np.float32)
        add_products(y, inverse, w[lo:hi], term[lo:hi], om)
        order = np.argsort(term[lo:hi], kind="stable")
        add_products(into, term[lo:hi][order], w[lo:hi][order], inverse[order], y)
        lo = hi


@tidied
def sketches(batches: Iterator[pa.RecordBatch], model: Model, width: int) -> Iterator[pa.RecordBatch]:
    om, out = omega(len(model.vocab), width), np.zeros((len(model.vocab), width), np.float32)
    for batch in batches:
        for _, found in of_notes(batch):
            *pairs, first = found.blocked(model)
            sketch(*weighted(model, *pairs), int(first[-1]), om, out)
    seen = np.flatnonzero(out.any(axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array([x.tobytes() for x in out[seen]], pa.binary())], ["term", "row"])


@tidied
def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the rows of equal terms of one partition."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for t, row in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            x = np.frombuffer(row.as_py(), np.float32).astype(np.float64)
            total[t] = total[t] + x if t in total else x
    yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.int32()), pa.array([x.astype(np.float32).tobytes() for x in total.values()], pa.binary())], ["term", "row"])


def common(masks: dict[int, int], m: int, sequence: list[int]) -> int:
    """Length of the longest common subsequence, by bits of an integer."""
    full = (1 << m) - 1
    v = full
    for x in sequence:
        u = v & masks.get(x, 0)
        v = ((v + u) | (v - u)) & full
    return m - v.bit_count()


def masks_of(item: np.ndarray) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, x in enumerate(item.tolist()):
        out[x] = out.get(x, 0) | 1 << i
    return out


def alike(item: np.ndarray, masks: dict[int, int], answer: dict[int, int], passage: list[int], lcs: float) -> tuple[float, int]:
    """Share of the item found in order within a stretch of 1.5 item lengths (0 if that is no leak), and where."""
    m = len(item)
    held = sum(masks[x].bit_count() for x in masks.keys() & set(passage))  # words of the item, in any order
    if held < LEAST * m or common(masks, m, passage) < LEAST * m:
        return 0.0, 0
    wide, best, where = -(-3 * m // 2), 0, 0
    for at in range(0, max(1, len(passage) - m + 1), max(1, m // 8)):
        n = common(masks, m, passage[at : at + wide])
        if n > best:
            best, where = n, at
    share = best / m
    if m < 8:
        return (share, where) if share == 1 else (0.0, 0)
    if share >= lcs:
        return share, where
    last = max(4, m // 3)
    if share >= LEAST and common(answer, last, passage[where : where + wide]) >= 0.9 * last:
        return share, where
    return 0.0, 0


def verbatim(model: Model, found: Found, sequence: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Passages and the items that stand in them word for word, wherever the text holds them."""
    before = found.before
    anchored = np.zeros(len(model.vocab), bool)
    anchored[list(model.anchors)] = True
    own = anchored[found.term]
    at, term = found.at[own], found.term[own]
    order = np.argsort(term, kind="stable")
    at, term = at[order], term[order]
    text = np.searchsorted(before, at, side="right") - 1
    edges = np.append(np.flatnonzero(np.append(True, term[1:] != term[:-1])), len(term)) if len(term) else [0]
    passages, items = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        for k, offset in model.anchors[int(term[lo])]:
            item = model.items[k]
            start, of = at[lo:hi] - offset, text[lo:hi]
            ok = (start >= before[of]) & (start + len(item) <= before[of + 1])
            start, of = start[ok], of[ok]
            for j, word in enumerate(item):
                if not len(start):
                    break
                ok = sequence[start + j] == word
                start, of = start[ok], of[ok]
            passages.append(first[of] + (start - before[of]) // model.stride)
            items.append(np.full(len(start), k))
    return np.concatenate(passages), np.concatenate(items)


def worded(model: Model, block: np.ndarray, term: np.ndarray, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Passages and the hot items of which they hold enough words for a leak."""
    passages, items = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if len(model.hot):
        column = model.columns[term]
        block, column = block[column >= 0], column[column >= 0]
        need = LEAST * np.array([len(model.items[i]) for i in model.hot]) - 1e-3
        step = 512
        for lo in range(0, len(tail), step):
            hi = min(len(tail), lo + step)
            a, b = np.searchsorted(block, [lo, hi + 1])
            if a == b:
                continue
            x = np.zeros((hi - lo + 1, len(model.times)), np.float32)
            x[block[a:b] - lo, column[a:b]] = 1
            pair = np.where(tail[lo:hi, None], x[:-1], np.maximum(x[:-1], x[1:]))
            i, k = np.nonzero(pair @ model.times >= need)
            passages.append(i + lo)
            items.append(model.hot[k])
    return np.concatenate(passages), np.concatenate(items)


@dataclass
class Search:
    """What a task needs besides the model, made once."""

    model: Model

    def __post_init__(self):
        self.masks = [masks_of(x) for x in self.model.items]
        self.answers = [masks_of(x[len(x) - max(4, len(x) // 3) :]) if len(x) >= 8 else {} for x in self.model.items]

    def leaks(self, found: Found) -> dict[tuple[int, int], tuple[float, float, int]]:
        """(text, item): (share, cosine, first word) of the best place of every leak."""
        model, best = self.model, {}
        block, term, times, first = found.blocked(model)
        tail = np.zeros(int(first[-1]), bool)
        tail[first[1:] - 1] = True
        sequence = found.sequence()
        exact = [verbatim(model, found, sequence, first), worded(model, block, term, tail)]
        sure = np.unique(np.concatenate([b * len(model.items) + k for b, k in exact]))
        block, term, weight = weighted(model, block, term, times)
        if not len(block) and not len(sure):
            return best
        x = projected(model, block, term, weight, int(first[-1]))
        pair = x.copy()
        pair[:-1][~tail[:-1]] += x[1:][~tail[:-1]]
        length = np.sqrt((pair**2).sum(axis=1))
        full = np.flatnonzero((length > 1e-6) | np.isin(np.arange(len(tail)), sure // len(model.items)))
        for a in range(0, len(full), 4096):
            own = full[a : a + 4096]
            cos = pair[own] @ model.queries.T / np.maximum(length[own], 1e-6)[:, None]
            chosen = cos >= model.cosine
            mine = sure[np.isin(sure // len(model.items), own)]
            chosen[np.searchsorted(own, mine // len(model.items)), mine % len(model.items)] = True
            for i, k in zip(*np.nonzero(chosen), strict=True):
                b = int(own[i])
                text = int(np.searchsorted(first, b, side="right")) - 1
                start = int(found.before[text]) + (b - int(first[text])) * model.stride
                passage = sequence[start : min(int(found.before[text + 1]), start + 2 * model.stride)].tolist()
                share, where = alike(model.items[k], self.masks[k], self.answers[k], passage, model.lcs)
                if share > best.get((text, int(k)), (0.0,))[0]:
                    best[text, int(k)] = (share, float(cos[i, k]), start - int(found.before[text]) + where)
        return best


@tidied
def reported(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """Columns doc_id, n, terms -> the leaks of every document."""
    search = Search(model)
    for batch in batches:
        rows: list[tuple] = []
        for lo, found in of_notes(batch):
            rows += [(lo + text, model.keys[k], cos, share, at) for (text, k), (share, cos, at) in sorted(search.leaks(found).items())]
        r, key, cos, share, at = zip(*rows, strict=True) if rows else ((),) * 5
        columns = [pa.array(key, pa.binary()), pa.array(cos, pa.float64()), pa.array(share, pa.float64()), pa.array(at, pa.int64())]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(r, pa.int64())), *columns], ["doc_id", "key", "cosine", "lcs_share", "first_word"])


@tidied
def cleaned(batches: Iterator[pa.RecordBatch], model: Model, column: int) -> Iterator[pa.RecordBatch]:
    """Rows into whose text (the given column) nothing leaks."""
    search = Search(model)
    for batch in batches:
        keep = np.ones(batch.num_rows, bool)
        for lo, found in of_texts(batch, column, model):
            keep[[lo + text for text, _ in search.leaks(found)]] = False
        yield batch.filter(pa.array(keep))


def keyed(benchmark: DataFrame) -> DataFrame:
    """(item_id, text, key) of the items that have a text."""
    text = text_or_empty("text")
    return benchmark.select("item_id", text.alias("text"), F.unhex(F.md5(text.cast("binary"))).alias("key")).where(F.length("text") > 0)


def models(rows: DataFrame, items: DataFrame, cosine: float, lcs: float) -> Iterator[tuple[Model, DataFrame]]:
    """A fitted model for each block of benchmark texts, and the noted terms of all documents; rows: (doc_id, text)."""
    spark, kind = rows.sparkSession, rows.schema["doc_id"].dataType.simpleString()
    texts = items.select("key", "text").distinct()
    size = texts.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).first()
    parts = max(1, -(-size["n"] // ITEMS), -(-(size["chars"] or 0) // CHARS))
    for part in range(parts):
        own = texts if parts == 1 else texts.where(F.pmod(F.xxhash64("key"), F.lit(parts)) == part)
        taken = own.orderBy("key").collect()
        keys, hashes = [], []
        for lo, hi, buf, offsets in chunks(pa.array([r["text"] for r in taken], pa.string())):
            h, before = hashed(buf, offsets)
            for i in range(hi - lo):
                if before[i + 1] > before[i]:
                    keys.append(bytes(taken[lo + i]["key"]))
                    hashes.append(h[before[i] : before[i + 1]])
        if not hashes:
            continue
        vocab = np.unique(np.concatenate(hashes))
        model = Model(keys, [np.searchsorted(vocab, x) for x in hashes], vocab, max(32, max(map(len, hashes))), cosine, lcs)
        shared = spark.sparkContext.broadcast(model)
        notes = cut(rows.mapInArrow(lambda it, s=shared: noted(it, s.value), f"doc_id {kind}, n long, terms binary"))
        counts = notes.mapInArrow(lambda it, s=shared: frequencies(it, s.value), "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))
        df = {r["term"]: r["n"] for r in counts.collect()}
        total = max(1, df.pop(-1, 0))
        model.search(np.array([df.get(k, 0) for k in range(len(vocab))], float), total)
        width = min(len(vocab), RANK + OVER)
        shared = spark.sparkContext.broadcast(model)
        rows_of = notes.mapInArrow(lambda it, s=shared, w=width: sketches(it, s.value, w), "term int, row binary")
        y = np.zeros((len(vocab), width))
        for r in rows_of.repartition("term").mapInArrow(added, "term int, row binary").collect():
            y[r["term"]] = np.frombuffer(r["row"], np.float32)
        own = [(np.full(len(t), i), t, c) for i, (t, c) in enumerate(np.unique(x, return_counts=True) for x in model.items)]
        item, term, weight = weighted(model, *map(np.concatenate, zip(*own, strict=True)))
        own_y = np.zeros(y.shape, np.float32)
        om = omega(len(vocab), width)
        sketch(item, term, weight, len(keys), om, own_y)
        y += own_y * max(1.0, np.linalg.norm(y) / max(1e-9, np.linalg.norm(own_y)))  # items weigh as much as the corpus
        core = om.astype(np.float64).T @ y
        values, vectors = np.linalg.eigh((core + core.T) / 2)
        ok = values > 1e-6 * values.max()
        u, _, _ = np.linalg.svd(y @ (vectors[:, ok] / np.sqrt(values[ok])), full_matrices=False)
        model.basis = (model.idf[:, None] * u[:, :RANK]).astype(np.float32)
        q = projected(model, item, term, weight, len(keys))
        model.queries = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-9)
        yield model, notes


def contamination(docs: DataFrame, benchmark: DataFrame, cosine: float = 0.4, lcs: float = 0.75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, cosine, lcs_share and first_word of every document and item that leaks into it.

    Null and empty texts, of documents or items, leak nothing. Ids may be null or repeat: every row is searched by
    itself, and items of equal text are all reported. An empty table gives no rows; other columns don't matter.
    """
    spark = prepare(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    items = keyed(benchmark)
    schema = f"doc_id {kind}, key binary, cosine double, lcs_share double, first_word long"
    out = spark.createDataFrame([], schema)
    for model, notes in models(rows, items, cosine, lcs):
        shared = spark.sparkContext.broadcast(model)
        out = out.unionByName(notes.mapInArrow(lambda it, s=shared: reported(it, s.value), schema))
    return out.join(items.select("key", "item_id"), "key").select("doc_id", "item_id", "cosine", "lcs_share", "first_word")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, cosine: float = 0.4, lcs: float = 0.75, text_col: str = "text") -> DataFrame:
    """The documents without those into which a benchmark item leaks; all columns, of any name, stay.

    Rows with a null or empty text stay, repeated rows all stay or all go, and an empty table gives no rows. The documents are
    read twice: once to note their terms, once to leave out those that hold an item.
    """
    spark = prepare(docs.sparkSession)
    at = docs.columns.index(text_col)
    rows = docs.select(F.lit(0).alias("doc_id"), text_or_empty(text_col).alias("text"))
    for model, _ in models(rows, keyed(benchmark), cosine, lcs):
        shared = spark.sparkContext.broadcast(model)
        docs = docs.mapInArrow(lambda it, s=shared: cleaned(it, s.value, at), docs.schema)
    return docs
