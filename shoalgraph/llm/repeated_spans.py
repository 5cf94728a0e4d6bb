"""Bytes covered by long strings that start in an earlier document too, by difference-cover suffix sorting.

The suffixes of the whole corpus are dealt to buckets by content first, so that equal ``length``-byte strings
always meet and each bucket can be sorted by itself. A string's bucket is the smallest hash of the short
substrings in it (its minimizer); neighbouring strings with the same one form a run, which travels as one piece.

1. Runs are compared whole, by hash: a run that an earlier document has too is covered, and a run whose
   minimizer occurs in no other document can't be. On the sample data that settles all but the runs at the edges of
   repeated passages.
2. The bytes of the runs left meet in buckets. Each bucket builds suffix arrays by the difference-cover algorithm
   (ranks of triples at two of three places, recursion on the names, merge of the rest) for some of its minimizers at a
   time; neighbours there whose first ``length`` bytes agree are one string, owned by the smallest id.
3. Each text loses its covered bytes.

Runs and bytes travel as packed arrays, a few rows for each task and bucket, and a task streams its buckets one by one. Buckets
follow from the bytes of all texts. A minimizer of more bytes than a part may hold is dealt by string. Those that a sample of
documents shows to be frequent (that only decides the routing) are dealt by run, and then by string, before they travel; each
task merges equal ones first, so that a passage in a third of all documents arrives once a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoalgraph.llm.blocks import Prefix, chunks, mixed, tidied, tidy
from shoalgraph.llm.runtime import cut, prepare, text_or_empty

#: Bytes of the substrings that minimizers are chosen from.
GRAM = 20
#: Strings in a run at most; longer ones (of periodic text) are cut there.
LONGEST = 255
#: Documents in the sample for routing, and in how many of them a minimizer is frequent.
SAMPLED, FREQUENT = 5000, 25
CHUNK, FLUSH, SORTED = 1 << 19, 4 << 20, 1 << 19
#: Bytes of text for each bucket, and runs of it that are compared at a time.
PER_BUCKET, COMPARED = 64 << 20, 250_000
OPEN, COVERED, SPREAD = 0, 1, 2
RUN = np.dtype([("h", "<u8"), ("body", "<u8"), ("doc", "<i8"), ("row", "<i8"), ("lo", "<u4"), ("n", "<u4")])


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Start places of the suffixes of s (integers of 0 to 2 ** 20) in order, by the difference cover {1, 2} modulo 3."""
    n = len(s)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    t = np.zeros(n + 3, np.int64)
    t[:n] = s
    t[:n] += 1
    wide, deep = int(t.max()).bit_length(), n.bit_length()  # bits of a value, of a rank
    if 2 * wide + deep > 63:
        return doubled(s)
    ones, twos, zeros = (np.arange(k, n + (k == 1 and n % 3 == 1), 3) for k in (1, 2, 0))
    sample = np.concatenate([ones, twos])
    packed = t[sample]
    for k in (1, 2):
        packed <<= 21
        packed |= t[np.minimum(sample + k, n + 2)]
    order = np.argsort(packed)
    new = np.append(True, np.diff(packed[order]) != 0)
    names = np.empty(len(sample), np.int64)
    names[order] = np.cumsum(new) - 1
    if not new.all():
        order = doubled(names) if names.max() >= 1 << 20 else suffix_array(names)
    rank = np.zeros(n + 4, np.int64)
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    key1 = lambda i: t[i] << deep | rank[i + 1]
    key2 = lambda i: t[i] << wide + deep | t[i + 1] << deep | rank[i + 2]
    zero = zeros[np.argsort(key1(zeros))]
    by_rank = sample[order]
    by_rank = by_rank[by_rank < n]
    ones, twos = by_rank[by_rank % 3 == 1], by_rank[by_rank % 3 == 2]
    out = np.empty(n, np.int64)
    at = np.arange(len(zero)) + np.searchsorted(key1(ones), key1(zero)) + np.searchsorted(key2(twos), key2(zero))
    out[at] = zero
    free = np.ones(n, bool)
    free[at] = False
    out[free] = by_rank
    return out


def doubled(names: np.ndarray) -> np.ndarray:
    """Suffix order of an array with too many different names to pack three in a number: ranks of pairs, doubled."""
    rank, step, n = names.astype(np.int64), 1, len(names)
    while True:
        follow = np.zeros(n, np.int64)
        follow[: n - step] = rank[step:] + 1
        _, rank = np.unique(rank << 32 | follow, return_inverse=True)
        step *= 2
        if rank.max() == n - 1 or step >= n:
            return np.argsort(rank, kind="stable")


def minima(h: np.ndarray, span: int) -> np.ndarray:
    """The smallest of each ``span`` neighbouring values."""
    done = 1
    while done * 2 <= span:
        h = np.minimum(h[:-done], h[done:])
        done *= 2
    return np.minimum(h[: len(h) - (span - done)], h[span - done :]) if done < span else h


def strings(buf: np.ndarray, offsets: np.ndarray, length: int) -> tuple[Prefix, np.ndarray, np.ndarray]:
    """Hashes of substrings, the minimizer of the string at each place, and whether it lies within one text."""
    prefix = Prefix(buf)
    least = minima(prefix.windows(GRAM), length - GRAM + 1)
    whole = np.zeros(len(least) + 1, np.int32)
    size = np.diff(offsets)
    long = np.flatnonzero(size >= length)
    np.add.at(whole, offsets[:-1][long], 1)
    np.add.at(whole, offsets[1:][long] - length + 1, -1)
    return prefix, least, np.cumsum(whole[:-1]) > 0


def runs(buf: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(minimizer, hash of all its bytes, text, place in the text, strings) of the runs of a chunk."""
    empty = np.zeros(0, np.int64)
    if len(buf) < length:
        return empty.astype(np.uint64), empty.astype(np.uint64), empty, empty, empty
    prefix, least, whole = strings(buf, offsets, length)
    begins = whole.copy()
    begins[1:] &= ~whole[:-1] | (least[1:] != least[:-1])
    starts = offsets[:-1][offsets[:-1] < len(begins)]
    begins[starts] |= whole[starts]
    lo = np.flatnonzero(begins)
    stop = np.append(lo[1:], len(whole))
    text = np.searchsorted(offsets, lo, side="right") - 1
    stop = np.minimum(stop, offsets[text + 1] - length + 1)
    if len(lo) and (stop - lo).max() > LONGEST:
        parts = -(-(stop - lo) // LONGEST)
        run = np.repeat(np.arange(len(lo)), parts)
        lo = lo[run] + LONGEST * (np.arange(len(run)) - np.repeat(np.cumsum(parts) - parts, parts))
        text, stop = text[run], np.minimum(stop[run], lo + LONGEST)
    return least[lo], prefix.spans(lo, stop + length - 1), text, lo - offsets[text], stop - lo


def hot(keys: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    if not len(frequent):
        return np.zeros(len(keys), bool)
    at = np.searchsorted(frequent, keys)
    at[at == len(frequent)] = 0
    return frequent[at] == keys


def settled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs sorted by minimizer, body and document, and which of them an earlier document has too."""
    x = x[np.lexsort((x["doc"], x["body"], x["h"]))]
    new = np.ones(len(x), bool)
    new[1:] = (x["h"][1:] != x["h"][:-1]) | (x["body"][1:] != x["body"][:-1])
    first = np.flatnonzero(new)
    owner = np.repeat(x["doc"][first], np.diff(np.append(first, len(x))))
    return x, x["doc"] > owner


def packed(x: np.ndarray) -> bytes:
    """Runs as bytes, column by column, each (document, row) once; 32 bits (never all 0) of a minimizer tell it apart in its bucket."""
    _, first, at = np.unique(mixed(x["doc"].view(np.uint64)) + x["row"].view(np.uint64), return_index=True, return_inverse=True)
    docs, rows = x["doc"][first], x["row"][first]
    many, far = len(rows) >= 1 << 16, len(x) and int(x["lo"].max()) >= 1 << 24
    plain = not rows.any()  # ids tell rows apart
    head = np.array([len(x), len(rows), many, far, plain], "<i8").tobytes() + docs.tobytes()
    h = np.where(x["h"] == 0, 0, x["h"] | np.uint64(1)).astype("<u4")
    low = x["lo"].astype("<u4").tobytes() if far else x["lo"].astype("<u2").tobytes() + (x["lo"] >> 16).astype("u1").tobytes()
    return head + (b"" if plain else rows.tobytes()) + h.tobytes() + x["body"].tobytes() + at.astype("<u4" if many else "<u2").tobytes() + low + x["n"].astype("u1").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    n, m, many, far, plain = np.frombuffer(data, "<i8", 5).tolist()
    at = 40

    def column(kind: str, size: int) -> np.ndarray:
        nonlocal at
        col = np.frombuffer(data, kind, size, at)
        at += col.nbytes
        return col

    docs = column("<i8", m)
    rows = np.zeros(m, np.int64) if plain else column("<i8", m)
    x = np.empty(n, RUN)
    x["h"], x["body"] = column("<u4", n), column("<u8", n)
    own = column("<u4" if many else "<u2", n)
    x["doc"], x["row"] = docs[own], rows[own]
    x["lo"] = column("<u4", n) if far else column("<u2", n) + (column("u1", n).astype("<u4") << 16)
    x["n"] = column("u1", n)
    return x


def parcels(kind: int, x: np.ndarray, keys: np.ndarray, buckets: int) -> Iterator[tuple[int, int, bytes]]:
    bucket = (mixed(keys) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    x, bucket = x[order], bucket[order]
    at = np.searchsorted(bucket, np.arange(buckets + 1))
    for b in np.unique(bucket).tolist():
        yield b, kind, packed(x[at[b] : at[b + 1]])


def sent(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    b, k, d = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(k, pa.int32()), pa.array(d, pa.binary())], ["bucket", "kind", "data"])


@tidied
def dealt(batches: Iterator[pa.RecordBatch], length: int, frequent: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Columns doc_id, row, text -> packed runs for buckets."""
    held, size = [], 0

    def flush() -> pa.RecordBatch:
        x, covered = settled(np.concatenate(held) if held else np.empty(0, RUN))
        often = hot(x["h"], frequent) & ~covered
        rest = ~covered & ~often
        rows = [*parcels(OPEN, x[rest], x["h"][rest], buckets), *parcels(SPREAD, x[often], x["body"][often], buckets), *parcels(COVERED, x[covered], x["doc"][covered].view(np.uint64), buckets)]
        held.clear()
        return sent(rows)

    for batch in batches:
        doc, row = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
        for lo, _, buf, offsets in chunks(batch.column(2), CHUNK):
            h, body, text, at, n = runs(buf, offsets, length)
            x = np.empty(len(h), RUN)
            x["h"], x["body"], x["doc"], x["row"], x["lo"], x["n"] = h, body, doc[lo + text], row[lo + text], at, n
            held.append(x)
            size += len(buf)
            if size >= FLUSH:
                yield flush()
                size = 0
                tidy()
    yield flush()


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], list[bytes]]]:
    """Columns bucket, kind, data, sorted by the first two -> the data of each bucket and kind; covered runs come as they are, a few at a time."""
    now, parts = None, []
    for batch in batches:
        for b, k, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if (b, k) != now or (k == COVERED and parts):
                if parts:
                    yield now, parts
                now, parts = (b, k), []
            parts.append(d.as_py())
    if parts:
        yield now, parts


@tidied
def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed runs of whole buckets -> (doc_id, row, lo, n, look): covered runs, and those whose bytes have to be looked at."""
    for (_, kind), parts in by_bucket(batches):
        if kind == COVERED:
            yield told(unpacked(parts[0]), None)
            continue
        many = -(-sum(int(np.frombuffer(d, "<i8", 1)[0]) for d in parts) // COMPARED)
        for k in range(many):  # a few minimizers (or bodies) at a time
            own = [x[(x["h" if kind == OPEN else "body"] >> 1) % many == k] for x in map(unpacked, parts)]
            yield compared_runs(np.concatenate(own), kind)
            del own
            tidy()


def compared_runs(x: np.ndarray, kind: int) -> pa.RecordBatch:
    x, covered = settled(x)
    new = np.ones(len(x), bool)
    new[1:] = x["h"][1:] != x["h"][:-1]
    first = np.flatnonzero(new)
    sizes = np.diff(np.append(first, len(x)))
    bodies = np.ones(len(x), np.int64)
    bodies[1:] = (x["body"][1:] != x["body"][:-1]) | new[1:]
    several = np.minimum.reduceat(x["doc"], first) < np.maximum.reduceat(x["doc"], first) if len(x) else np.zeros(0, bool)
    several &= np.add.reduceat(bodies, first) > 1 if len(x) else several
    look = ~covered & (np.repeat(several, sizes) if kind == OPEN else True)
    return told(x[covered | look], look[covered | look])


def told(x: np.ndarray, look: np.ndarray | None) -> pa.RecordBatch:
    look = np.zeros(len(x), bool) if look is None else look
    cols = [pa.array(np.ascontiguousarray(x[c]).astype(k)) for c, k in (("doc", np.int64), ("row", np.int64), ("lo", np.int32), ("n", np.int32))]
    return pa.RecordBatch.from_arrays([*cols, pa.array(look)], ["doc_id", "row", "lo", "n", "look"])


@tidied
def opened(batches: Iterator[pa.RecordBatch], length: int, frequent: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Columns doc_id, row, text, places and sizes of runs -> the runs' bytes for buckets."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def flush() -> pa.RecordBatch:
        x, data = np.concatenate([a for a, _ in held]), np.concatenate([b for _, b in held])
        held.clear()
        width = x["n"].astype(np.int64) + length - 1
        start = np.cumsum(width) - width
        often = hot(x["h"], frequent)
        rows = list(parcels_of_bytes(OPEN, x[~often], start[~often], x["h"][~often], data, length, buckets))
        if often.any():  # every string by itself
            n = x["n"][often].astype(np.int64)
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            y = np.repeat(x[often], n)
            y["lo"] += within.astype(np.uint32)
            y["n"] = 1
            at = np.repeat(start[often], n) + within
            y["h"] = y["body"] = Prefix(data).spans(at, at + length)
            y["h"] = 0
            order = np.lexsort((y["doc"], y["body"]))
            at = at[order]
            y, covered = settled(y)
            rows += parcels(COVERED, y[covered], y["doc"][covered].view(np.uint64), buckets)
            rows += parcels_of_bytes(OPEN, y[~covered], at[~covered], y["body"][~covered], data, length, buckets)
        return sent(rows)

    for batch in batches:
        doc, row = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
        for first, end, buf, offsets in chunks(batch.column(2), CHUNK):
            lists = [batch.column(k).slice(first, end - first) for k in (3, 4)]
            counts = np.array([len(v) for v in lists[0].to_pylist()], np.int64)
            if not counts.sum():
                continue
            text = np.repeat(np.arange(end - first), counts)
            lo, n = (v.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for v in lists)
            x = np.zeros(len(lo), RUN)
            x["doc"], x["row"], x["lo"], x["n"] = doc[first + text], row[first + text], lo, n
            _, least, _ = strings(buf, offsets, length)
            at = offsets[text] + lo
            x["h"] = least[at]
            width = n + length - 1
            index = np.repeat(at - (np.cumsum(width) - width), width) + np.arange(width.sum())
            held.append((x, buf[index]))
            size += int(width.sum())
            if size >= FLUSH:
                yield flush()
                size = 0
                tidy()
    if held:
        yield flush()


def parcels_of_bytes(kind: int, x: np.ndarray, start: np.ndarray, keys: np.ndarray, data: np.ndarray, length: int, buckets: int) -> Iterator[tuple[int, int, bytes]]:
    bucket = (mixed(keys) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    x, start, bucket = x[order], start[order], bucket[order]
    at = np.searchsorted(bucket, np.arange(buckets + 1))
    for b in np.unique(bucket).tolist():
        own, s = x[at[b] : at[b + 1]], start[at[b] : at[b + 1]]
        width = own["n"].astype(np.int64) + length - 1
        index = np.repeat(s - (np.cumsum(width) - width), width) + np.arange(width.sum())
        head = packed(own)
        yield b, kind, np.array([len(head)], "<i8").tobytes() + head + data[index].tobytes()


def agree(buf: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Whether the ``length`` bytes at each place in order equal those at the place before it there."""
    word = np.zeros(len(buf), np.uint64)
    for k in range(8):
        word[: len(buf) - k] |= buf[k:].astype(np.uint64) << np.uint64(8 * k)
    same = np.ones(max(0, len(order) - 1), bool)
    for at in [*range(0, length - 8, 8), length - 8]:
        here = word[order + at]
        same &= here[1:] == here[:-1]
    return np.append(False, same) if len(order) else same


def sorted_out(x: np.ndarray, data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(run, first string, strings) that an earlier document has too: neighbours in the suffix array of the runs' bytes that agree
    in their first ``length`` bytes are one string."""
    width = x["n"].astype(np.int64) + length - 1
    start = np.cumsum(width + 1) - (width + 1)
    buf, apart = np.zeros(int((width + 1).sum()), np.uint8), np.ones(int((width + 1).sum()), bool)
    index = np.repeat(start - (np.cumsum(width) - width), width) + np.arange(len(data))
    buf[index], apart[index] = data, False
    s = buf.astype(np.int32) + 1
    s[apart] = 0
    n = x["n"].astype(np.int64)
    run = np.repeat(np.arange(len(x)), n)
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    whose = np.full(len(s), -1, np.int32)
    whose[start[run] + within] = np.arange(len(run))
    order = suffix_array(s)
    order = order[whose[order] >= 0]
    first = np.flatnonzero(~agree(buf, order, length))
    doc = x["doc"][run[whose[order]]]
    owner = np.repeat(np.minimum.reduceat(doc, first), np.diff(np.append(first, len(doc))))
    covered = np.zeros(len(run), bool)
    covered[whose[order]] = doc > owner
    begins = covered.copy()
    begins[1:] &= ~covered[:-1] | (run[1:] != run[:-1])
    at = np.flatnonzero(begins)
    total = np.add.reduceat(covered, at, dtype=np.int64) if len(at) else np.zeros(0, np.int64)
    return run[at], within[at], total


def parts_of(x: np.ndarray, data: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(runs, bytes) of a bucket in parts of about SORTED bytes that can be sorted by themselves.

    A part holds whole minimizers. One with more bytes than that is dealt by string.
    """
    width = x["n"].astype(np.int64) + length - 1
    start = np.cumsum(width) - width
    key = np.where(x["h"] == 0, x["body"], x["h"])
    order = np.argsort(key, kind="stable")
    x, width, start, key = x[order], width[order], start[order], key[order]
    new = np.append(True, key[1:] != key[:-1])
    first = np.flatnonzero(new)
    size = np.add.reduceat(width, first)
    edge = np.append(first, len(x))
    lo = 0
    while lo < len(first):
        hi = lo + max(1, int(np.searchsorted(np.cumsum(size[lo:]), SORTED, side="right")))
        a, b = edge[lo], edge[hi]
        w = width[a:b]
        own = data[np.repeat(start[a:b] - (np.cumsum(w) - w), w) + np.arange(w.sum())]
        if hi == lo + 1 and size[lo] > SORTED:
            yield from by_string(x[a:b], own, length)
        else:
            yield x[a:b], own
        lo = hi


def by_string(x: np.ndarray, data: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(runs of one string, bytes) of the runs of a minimizer, in parts of about SORTED bytes.

    Equal strings stand side by side, those of the smallest id first. However many there are, parts stay small: one that begins amid
    equal strings starts with the first of them, so that each part knows their owner.
    """
    n = x["n"].astype(np.int64)
    begin = np.cumsum(n + length - 1) - (n + length - 1)
    prefix, last, step = Prefix(data), np.cumsum(n), max(1, SORTED // length)
    block = (last - 1) // (4 * COMPARED)
    edge = np.append(np.flatnonzero(np.append(True, block[1:] != block[:-1])), len(x))
    passes = np.uint64(block[-1] + 1)
    for k in range(int(passes)):  # a few strings at a time
        picked = []
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            of = np.repeat(np.arange(a, b), n[a:b])
            within = np.arange(len(of)) - np.repeat(last[a:b] - n[a:b] - (last[a] - n[a]), n[a:b])
            h = prefix.spans(begin[of] + within, begin[of] + within + length)
            own = h % passes == k
            picked.append((of[own].astype(np.int32), within[own].astype(np.uint32), h[own]))
        of, within, h = (np.concatenate(c) for c in zip(*picked, strict=True))
        del picked
        order = np.lexsort((x["doc"][of], h))
        of, within, h = of[order], within[order], h[order]
        new = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        for lo in range(0, len(of), step):
            own = np.arange(lo, min(lo + step, len(of)))
            first = new[np.searchsorted(new, lo, side="right") - 1]
            if first < lo:
                own = np.append(first, own)
            y = x[of[own]]
            y["lo"] += within[own]
            y["n"] = 1
            yield y, data[((begin[of[own]] + within[own])[:, None] + np.arange(length)).ravel()]


@tidied
def sorted_buckets(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Packed bytes of whole buckets -> covered (doc_id, row, lo, n)."""
    for (_, kind), parts in by_bucket(batches):
        if kind == COVERED:
            yield told(unpacked(parts[0]), None)
            continue
        runs_, bytes_ = [], []
        for d in parts:
            k = int(np.frombuffer(d, "<i8", 1)[0])
            runs_.append(unpacked(d[8 : 8 + k]))
            bytes_.append(np.frombuffer(d, np.uint8, offset=8 + k))
        parts.clear()
        x, data = np.concatenate(runs_), np.concatenate(bytes_)
        del runs_, bytes_
        for y, own in parts_of(x, data, length):
            run, first, n = sorted_out(y, own, length)
            out = y[run].copy()
            out["lo"] += first.astype(np.uint32)
            out["n"] = n
            if len(out):
                yield told(out, None)


@tidied
def shorn(batches: Iterator[pa.RecordBatch], length: int, keep_bytes: bool = True) -> Iterator[pa.RecordBatch]:
    """Columns doc_id, text, places and counts of covered strings -> the digest of what is left and, if asked for, what is left."""
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    for batch in batches:
        for first, end, buf, offsets in chunks(batch.column(1), CHUNK):
            out = []
            for i in range(first, end):
                data = buf[offsets[i - first] : offsets[i - first + 1]]
                los, ns = batch.column(2)[i], batch.column(3)[i]
                if not los.is_valid or not len(los):
                    out.append((len(data), 0, 0, hashlib.sha256(data).hexdigest(), data.tobytes() if keep_bytes else None))
                    continue
                lo = los.values.to_numpy(zero_copy_only=False).astype(np.int64)
                hi = lo + ns.values.to_numpy(zero_copy_only=False) + length - 1
                edge = np.zeros(len(data) + 1, np.int32)
                np.add.at(edge, lo, 1)
                np.add.at(edge, hi, -1)
                gone = np.cumsum(edge[:-1]) > 0
                spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                kept = data[~gone]
                out.append((len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept.tobytes() if keep_bytes else None))
            columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
            columns = [batch.column(0).slice(first, end - first), *columns]
            yield pa.RecordBatch.from_arrays(columns if keep_bytes else columns[:-1], names if keep_bytes else names[:-1])


def remove_repeats(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", keep_bytes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document; with keep_bytes what is left too (bytes, as a
    cut may fall inside a character).

    A null text is an empty one. Rows with a null id lose nothing and take nothing from others. Rows of equal ids don't take from
    each other. Ids are integers. An empty table gives no rows; other columns don't matter.
    """
    if length <= GRAM:
        raise ValueError(f"length must be over {GRAM}")
    spark = prepare(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    known = rows.where(F.col("doc_id").isNotNull()).withColumn("doc_id", F.col("doc_id").cast("long"))
    repeated = not known.groupBy("doc_id").count().where("count > 1").isEmpty()
    row = F.xxhash64("doc_id", "text") if repeated else F.lit(0).cast("long")  # tells rows of an id apart
    known = known.select("doc_id", row.alias("row"), "text")
    long = known.where(F.octet_length("text") >= length)
    size = long.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    every = max(1, size["n"] // SAMPLED)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (size["bytes"] or 0) // PER_BUCKET)

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, buf, offsets in chunks(batch.column(0), CHUNK):
                h, _, doc, _, _ = runs(buf, offsets, length)
                own = np.unique(np.stack([doc.astype(np.uint64), h]), axis=1)[1] if len(h) else h
                keys, n = np.unique(own, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n, pa.int64())], ["h", "n"])

    seen = long.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).select("text").mapInArrow(sampled, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    often = np.sort(np.array([r["h"] for r in seen.where(F.col("n") >= FREQUENT).select("h").collect()], np.int64).view(np.uint64))
    shared = spark.sparkContext.broadcast(often)
    parcel = "bucket int, kind int, data binary"
    found = "doc_id long, row long, lo int, n int, look boolean"
    dealt_by_bucket = lambda df: df.repartition(buckets, "bucket").sortWithinPartitions("bucket", "kind")
    first = cut(dealt_by_bucket(long.mapInArrow(lambda it: dealt(it, length, shared.value, buckets), parcel)).mapInArrow(compared, found))
    by_row = first.where("look").groupBy("doc_id", "row").agg(F.collect_set(F.struct("lo", "n")).alias("x"))
    asked = known.join(by_row.select("doc_id", "row", F.col("x.lo").alias("los"), F.col("x.n").alias("ns")), ["doc_id", "row"])
    sorted_ = dealt_by_bucket(asked.mapInArrow(lambda it: opened(it, length, shared.value, buckets), parcel)).mapInArrow(lambda it: sorted_buckets(it, length), found)
    covered = first.where("not look").unionByName(sorted_).select("doc_id", "row", "lo", "n")
    place = F.shiftleft(F.col("lo").cast("long"), 8).bitwiseOR(F.col("n").cast("long")).alias("x")  # n is LONGEST at most; a number takes a quarter of a struct
    lists = covered.select("doc_id", "row", place).groupBy("doc_id", "row").agg(F.collect_list("x").alias("x"))
    lists = lists.select("doc_id", "row", F.expr("transform(x, v -> int(shiftright(v, 8)))").alias("los"), F.expr("transform(x, v -> int(v & 255))").alias("ns"))
    joined = known.join(lists, ["doc_id", "row"], "left").select(F.col("doc_id").cast(kind).alias("doc_id"), "text", "los", "ns")
    none = F.lit(None).cast("array<int>")
    lost = rows.where(F.col("doc_id").isNull()).select("doc_id", "text", none.alias("los"), none.alias("ns"))
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_bytes
    return joined.unionByName(lost).mapInArrow(lambda it: shorn(it, length, keep_bytes), schema)
