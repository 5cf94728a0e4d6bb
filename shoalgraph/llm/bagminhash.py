"""Near duplicates by weighted-Jaccard signatures from hierarchical Poisson processes (BagMinHash).

A text is the multiset of its five-word shingles. Each shingle with weight w takes part in unit-rate
Poisson processes on weight levels (0, 1], (1, 2], (2, 4], (4, 8], ...; points of a block carry a
level inside it and count only up to w, so texts with different weights share the points of their common
levels. A point falls on one of the signature's components; a component keeps its earliest point. Two
signatures agree in a component with probability equal to the weighted Jaccard similarity. Points are made
in order of time, and a shingle stops once its next point comes later than all components' minima, so
most shingles make one point.

Signatures are banded, and each bucket's texts are linked in two steps. First every text is paired with its
bucket's first one; pairs are verified by exact multiset overlap and links are joined into classes, so a large group
of close copies costs one pair a text and bucket. Then only buckets that still hold texts of different classes
(of several with the same texts, one) are worked through: their item sets meet in a task, and each text that is not
of the bucket's largest class is compared with all texts of other classes and of a fitting size, so that
no link between classes is lost. Nothing but links leaves the task, at most one for every two classes it joins. Buckets of
more than ``BLOCK`` items are dealt as pairs of blocks. Equal texts are one node, so copies are never paired.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoalgraph.llm.blocks import Prefix, chunks, mixed, replicas, shingles, tidied, words
from shoalgraph.llm.runtime import cut, join_by_size, prepare, text_or_empty, unused

SHINGLE, BANDS, ROWS = 5, 20, 5
#: Items (shingles with their repetitions) that a block of a bucket holds.
BLOCK = 1_000_000
#: Texts that one text is compared with at a time.
STEP = 512
#: Processes below which several of their points are made at once.
FEW = 4096
C1, C2 = np.uint64(0xD1B54A32D192ED03), np.uint64(0x8CB92BA72F3D8DD7)


def unit(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53


def signatures(keys: np.ndarray, text: np.ndarray, weight: np.ndarray, n_texts: int, m: int) -> np.ndarray:
    """A row of m component values for each text; texts without shingles get zeros."""
    top = np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64)
    per = top + 1
    item = np.repeat(np.arange(len(keys)), per)
    block = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    size = np.where(block == 0, 1, 2.0 ** np.maximum(block - 1, 0))
    low = np.where(block == 0, 0, 2.0 ** np.maximum(block - 1, 0))
    state = mixed(keys[item] + block.astype(np.uint64) * C1)
    of, limit = text[item], weight[item].astype(np.float64)
    time = np.zeros(len(item))
    best, who = np.full(n_texts * m, np.inf), np.zeros(n_texts * m, np.uint64)
    worst = np.full(n_texts, np.inf)
    while len(state):
        steps = 1 if len(state) > FEW else 16  # points of a process that are made at once
        made_state, made_time = [], []
        for _ in range(steps):
            state = mixed(state + C2)
            time = time - np.log(unit(state)) / size
            made_state.append(state)
            made_time.append(time)
        s, t = (np.concatenate(x) if steps > 1 else x[0] for x in (made_state, made_time))
        text_of, top_level = np.tile(of, steps), np.tile(limit, steps)
        near = t < worst[text_of]
        draw = mixed(s ^ C1)
        near &= np.tile(low, steps) + np.tile(size, steps) * unit(mixed(draw)) <= top_level
        at = text_of[near] * m + (draw[near] % np.uint64(m)).astype(np.int64)
        t, s = t[near], s[near]
        order = np.argsort(at << 32 | t.astype(np.float32).view(np.int32))  # by component, then by time (positive floats order as their bits)
        at, t, s = at[order], t[order], s[order]
        first = np.ones(len(at), bool)
        first[1:] = at[1:] != at[:-1]
        at, t, s = at[first], t[first], s[first]
        better = t < best[at]
        best[at[better]], who[at[better]] = t[better], s[better]
        worst = best.reshape(n_texts, m).max(axis=1)
        stays = time < worst[of]
        state, time, of, limit, size, low = state[stays], time[stays], of[stays], limit[stays], size[stays], low[stays]
    return who.reshape(n_texts, m)


def bands(sig: np.ndarray, n_bands: int, rows: int) -> np.ndarray:
    out = np.zeros((len(sig), n_bands), np.uint64)
    for r in range(rows):
        out = mixed(out + sig[:, r::rows][:, :n_bands] * C1 + np.uint64(r))
    return mixed(out + np.arange(n_bands, dtype=np.uint64) * C2)


def multisets(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingle, text and weight, sorted by text and shingle."""
    start, end, before = words(buf, offsets)
    return replicas(*shingles(Prefix(buf).spans(start, end), before, SHINGLE))


@tidied
def signed(batches: Iterator[pa.RecordBatch], n_bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    """Columns id, key, text -> id, key, n (the multiset's size), bands."""
    for batch in batches:
        size, out = np.zeros(batch.num_rows, np.int64), np.zeros((batch.num_rows, n_bands), np.int64)
        for lo, hi, buf, offsets in chunks(batch.column(2), 1 << 19):
            keys, text, weight = multisets(buf, offsets)
            size[lo:hi] = np.bincount(text, weights=weight, minlength=hi - lo)
            out[lo:hi] = bands(signatures(keys, text, weight, hi - lo, n_bands * rows), n_bands, rows).view(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * n_bands, pa.int32()), pa.array(out.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size), lists], ["doc_id", "key", "n", "bands"])


@tidied
def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns key, text -> key and the multiset as bytes: (shingle, occurrence) hashes of 64 bits, sorted."""
    for batch in batches:
        out: list[bytes] = []
        for lo, hi, buf, offsets in chunks(batch.column(1)):
            keys, text, weight = multisets(buf, offsets)
            nth = np.arange(weight.sum()) - np.repeat(np.cumsum(weight) - weight, weight)
            k, t = mixed(np.repeat(keys, weight) + nth.astype(np.uint64) * C1), np.repeat(text, weight)
            k = k[np.lexsort((k, t))]
            at = np.searchsorted(t, np.arange(hi - lo + 1))
            out += [k[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["key", "items"])


@tidied
def verified(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Columns a, b, items_a, items_b -> links with their similarity."""
    for batch in batches:
        score = np.zeros(batch.num_rows)
        for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
            p, q = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
            both = len(np.intersect1d(p, q, assume_unique=True))
            score[i] = both / max(1, len(p) + len(q) - both)
        ok = score >= least
        mask = pa.array(ok)
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask), pa.array(score[ok])], ["a", "b", "score"])


def linked(pairs: DataFrame, items: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of keys whose texts are similar; items: (key, items), one row for a key."""
    one = pairs.join(items.select(F.col("key").alias("a"), F.col("items").alias("items_a")), "a")
    both = one.join(items.select(F.col("key").alias("b"), F.col("items").alias("items_b")), "b").select("a", "b", "items_a", "items_b")
    return both.mapInArrow(lambda it: verified(it, least), "a binary, b binary, score double")


class Group:
    """Texts of a bucket (or of two of its blocks), and the classes they are in."""

    def __init__(self, rows: list[tuple], least: float):
        rows.sort(key=lambda r: (r[0], r[4], len(r[3]), r[1]))  # block, of the largest class, size, key
        self.least, self.keys = least, [r[1] for r in rows]
        self.block = np.array([r[0] for r in rows], np.int64)
        self.main = np.array([r[4] for r in rows], bool)
        self.labels, of = np.unique(np.array([r[2].hex() for r in rows]), return_inverse=True)
        self.of = of.astype(np.int64)
        self.size = np.array([len(r[3]) // 8 for r in rows], np.int64)
        _, codes = np.unique(np.frombuffer(b"".join(r[3] for r in rows), np.uint64), return_inverse=True)
        self.codes, self.at = codes.astype(np.int32), np.append(0, np.cumsum(self.size))
        self.flag = np.zeros(int(codes.max()) + 1 if len(codes) else 1, np.uint8)

    def compare(self, x: int, lo: int, hi: int) -> Iterator[tuple[int, float]]:
        """Links of text x with texts lo to hi of other classes, each with a class that x has none with yet."""
        own = self.codes[self.at[x] : self.at[x + 1]]
        for a in range(lo, hi, STEP):
            y = np.arange(a, min(hi, a + STEP))
            y = y[self.of[y] != self.of[x]]
            if not len(y):
                continue
            n = self.size[y]
            start = np.cumsum(n) - n
            index = np.repeat(self.at[y] - start, n) + np.arange(n.sum())
            self.flag[own] = 1
            both = np.add.reduceat(self.flag[self.codes[index]], start, dtype=np.int64)
            self.flag[own] = 0
            score = both / (n + self.size[x] - both)
            for k in np.flatnonzero(score >= self.least).tolist():
                if self.of[y[k]] != self.of[x]:
                    yield int(y[k]), float(score[k])
                    self.of[self.of == self.of[y[k]]] = self.of[x]

    def fitting(self, x: int, lo: int, hi: int) -> tuple[int, int]:
        """Those of texts lo to hi (sorted by size) that can be similar to x."""
        n = self.size[lo:hi]
        return lo + int(np.searchsorted(n, self.least * self.size[x] * (1 - 1e-9))), lo + int(np.searchsorted(n, self.size[x] / self.least * (1 + 1e-9), side="right"))

    def links(self) -> Iterator[tuple[int, int, float]]:
        """(x, y, similarity): with all of them, every two texts that are similar are in one class."""
        n = len(self.keys)
        if self.block[0] != self.block[-1]:  # two blocks: only pairs across them
            middle = int(np.searchsorted(self.block, self.block[-1]))
            spans = [(x, [(middle, n)]) for x in range(middle)]
        else:
            middle = int(np.searchsorted(self.main, True))
            spans = [(x, [(x + 1, middle), (middle, n)]) for x in range(middle)]
        for x, parts in spans:
            for lo, hi in parts:
                if lo < hi:
                    yield from ((x, y, score) for y, score in self.compare(x, *self.fitting(x, lo, hi)))


@tidied
def compared(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Columns bucket, p, q, block, key, label, items, main, sorted by the first three -> links and the labels they join."""

    def told(rows: list[tuple]) -> pa.RecordBatch:
        group = Group(rows, least)
        was = group.of.copy()
        found = [(group.keys[x], group.keys[y], bytes.fromhex(group.labels[was[x]]), bytes.fromhex(group.labels[was[y]]), score) for x, y, score in group.links()]
        a, b, label_a, label_b, score = zip(*found, strict=True) if found else ((),) * 5
        kinds = (pa.binary(),) * 4 + (pa.float64(),)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((a, b, label_a, label_b, score), kinds, strict=True)], ["a", "b", "label_a", "label_b", "score"])

    now, rows = None, []
    for batch in batches:
        c = [batch.column(k) for k in range(8)]
        groups = list(zip(c[0].to_pylist(), c[1].to_pylist(), c[2].to_pylist(), strict=True))
        for i, group in enumerate(groups):
            if group != now and rows:
                yield told(rows)
                rows = []
            now = group
            rows.append((c[3][i].as_py(), c[4][i].as_py(), c[5][i].as_py(), c[6][i].as_py(), c[7][i].as_py()))
    if rows:
        yield told(rows)


def across(crowd: DataFrame, labels: DataFrame, items: DataFrame, least: float) -> DataFrame:
    """Links between texts of different classes that share a bucket, with the classes (label_a, label_b) they join.

    crowd: (bucket, key, n). Buckets of the same texts are one. The texts of a bucket's largest class are not compared with
    each other; in a large bucket they make blocks of their own.
    """
    left = crowd.join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
    same = left.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.bit_xor(F.xxhash64("key")).alias("x"), F.count("*").alias("c"))
    same = same.where("lo != hi").groupBy("x", "c").agg(F.min("bucket").alias("bucket")).select("bucket", "c")
    open_ = cut(join_by_size(left, cut(same), "bucket", "c").select("bucket", "key", "n", "label"))
    by_label = open_.groupBy("bucket", "label").agg(F.count("*").alias("c"), F.sum("n").alias("w"))
    plan = by_label.groupBy("bucket").agg(F.max(F.struct("c", "label", "w")).alias("m"), F.sum("w").alias("all"), F.sum("c").alias("c"))
    blocks = lambda w: F.ceil(w / F.lit(BLOCK)).cast("int")
    whole = F.col("all") <= BLOCK
    far = F.when(whole, 0).otherwise(blocks(F.col("m.w")))
    near = F.when(whole, 1).otherwise(F.greatest(F.lit(1), blocks(F.col("all") - F.col("m.w"))))
    plan = plan.select("bucket", "c", F.col("m.label").alias("major"), far.alias("far"), near.alias("near"))
    told = join_by_size(open_, cut(plan), "bucket", "c")
    main = F.col("label") == F.col("major")
    own = F.when(main & (F.col("far") > 0), F.col("near") + F.pmod(F.xxhash64("key"), F.col("far"))).otherwise(F.pmod(F.xxhash64("key"), F.col("near"))).cast("int")
    told = told.select("bucket", "key", "label", main.alias("main"), own.alias("block"), "near", "far")
    nears, every = F.sequence(F.lit(0), F.col("near") - 1), F.sequence(F.lit(0), F.col("near") + F.col("far") - 1)
    told = told.withColumn("other", F.explode(F.when(F.col("block") < F.col("near"), every).otherwise(nears)))
    told = told.select("bucket", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "key", "label", "main")
    rows = told.join(items, "key").select("bucket", "p", "q", "block", "key", "label", "items", "main")
    rows = rows.repartition("bucket", "p", "q").sortWithinPartitions("bucket", "p", "q")
    return rows.mapInArrow(lambda it: compared(it, least), "a binary, b binary, label_a binary, label_b binary, score double")


def components(links: DataFrame, low: str = "a", high: str = "b") -> DataFrame:
    """(key, label): the smallest key of each node's connected component; nodes without links aren't listed.

    Alternating large-star and small-star rounds on the edge table, each written to the shared checkpoint
    folder; all state stays distributed.
    """
    edges = cut(links.select(F.greatest(low, high).alias("u"), F.least(low, high).alias("v")).where(F.col("u") != F.col("v")).distinct())
    mark = None
    while True:
        both = edges.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        low_of = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low_of, "u").select(F.inline(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))))
        edges = cut(small.where(F.col("u") != F.col("v")).distinct())
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
    return edges.select(F.col("u").alias("key"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("key"), F.col("v").alias("label")).distinct())


def classes(docs: DataFrame, least: float, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key, n) of every row, and (key, label, copies, first) of every text: its class, its rows, its smallest id."""
    key = F.unhex(F.md5(text_or_empty(text_col).cast("binary")))
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), key.alias("key"), text_or_empty(text_col).alias("text"))
    marked = cut(rows.mapInArrow(lambda it: signed(it, BANDS, ROWS), f"doc_id {kind}, key binary, n long, bands array<long>"))
    nodes = marked.groupBy("key").agg(F.first("n").alias("n"), F.first("bands").alias("bands"), F.min("doc_id").alias("first"), F.count("*").alias("copies"))
    nodes = cut(nodes)
    members = nodes.where("n > 0").select("key", "first", "n", F.explode("bands").alias("bucket"))
    heads = members.groupBy("bucket").agg(F.min("key").alias("head"), F.count("*").alias("c")).where("c > 1")
    crowd = cut(join_by_size(members, cut(heads), "bucket", "c"))  # texts that share a bucket with another one
    one = crowd.select(F.col("key").alias("k"), "first").distinct()  # a row of each text: its copies, however many, are left out where they are
    wanted = rows.join(one, (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("first")), "left_semi").select("key", "text")
    items = cut(wanted.mapInArrow(sets, "key binary, items binary").groupBy("key").agg(F.first("items").alias("items")))
    stars = crowd.where(F.col("key") != F.col("head")).select(F.col("head").alias("a"), F.col("key").alias("b")).distinct()
    links = linked(stars, items, least)
    labels = components(links)
    more = cut(across(crowd.select("bucket", "key", "n"), labels, items, least))
    if not more.isEmpty():
        joined = components(more, "label_a", "label_b").select(F.col("key").alias("label"), F.col("label").alias("final"))
        moved = labels.join(joined, "label", "left").select("key", F.coalesce("final", "label").alias("label"))
        alone = joined.select(F.col("label").alias("key"), F.col("final").alias("label")).join(labels.select("key"), "key", "left_anti")
        labels = moved.unionByName(alone)
    return marked.drop("bands"), cut(nodes.select("key", "copies", "first").join(labels, "key", "left").withColumn("label", F.coalesce("label", "key")))


def near_duplicates(docs: DataFrame, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id, n_shingles and kept of every document.

    class_id is the smallest id in the document's class (texts that links of weighted Jaccard similarity ``least`` or more
    on five-word shingles connect), kept whether the row is the one that stays of its class. Equal texts, null and
    empty ones together, are one class member; texts of fewer than five words are one shingle. Rows with a null id
    get the class of their text and are never kept; repeated rows are marked alike. An empty table gives no rows; other
    columns don't matter.
    """
    prepare(docs.sparkSession)
    marked, texts = classes(docs, least, id_col, text_col)
    first = cut(texts.groupBy("label").agg(F.min("first").alias("class_id"), F.count("*").alias("texts")))
    of_text = cut(join_by_size(texts.select("key", "copies", "label"), first, "label", "texts").drop("label"))
    out = join_by_size(marked, of_text, "key", "copies")
    kept = F.col("doc_id").eqNullSafe(F.col("class_id")) & F.col("doc_id").isNotNull()
    return out.select("doc_id", "class_id", F.col("n").alias("n_shingles"), kept.alias("kept"))


def drop_near_duplicates(docs: DataFrame, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without all but the first (by id) of each class; all columns stay.

    Rows without an id stay, once for a class, only where no row of the class has an id. Repeated rows (same id and
    text) stay once; null and empty texts are one class. An empty table gives no rows, and columns of any name
    are kept as they are.
    """
    prepare(docs.sparkSession)
    _, texts = classes(docs, least, id_col, text_col)
    best = texts.groupBy("label").agg(F.min(F.struct(F.col("first").isNull().alias("none"), F.col("first").alias("doc_id"), F.col("key"))).alias("best"))
    own, stay_id, stay_key = unused(docs, "key", "stay_id", "stay_key")
    stays = best.select(F.col("best.doc_id").alias(stay_id), F.col("best.key").alias(stay_key))
    keyed = docs.withColumn(own, F.unhex(F.md5(text_or_empty(text_col).cast("binary"))))
    found = keyed.join(stays, (F.col(own) == F.col(stay_key)) & F.col(f"`{id_col}`").eqNullSafe(F.col(stay_id)), "left_semi")
    return found.dropDuplicates([own, id_col]).drop(own)
