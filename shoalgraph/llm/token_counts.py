"""Token counts of whole texts without their token ids.

The piece vocabulary has no piece in which a space follows another character and none with a line feed, so
merges never cross the start of a run of spaces or a line feed. A text is therefore a list of
pre-tokens (a run of spaces with the word after it, or what follows a line feed) whose piece counts add
up. In each task every distinct pre-token is given to the tokenizer once; its count is then joined (by
the pre-token's hash, in memory) to each document's pre-token frequencies and summed.

The join is within a task: dealing every (document, pre-token) pair over the cluster would shuffle
several times the input, and a task repeats only the distinct pre-tokens that other tasks have too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoalgraph.llm.blocks import Prefix, chunks
from shoalgraph.llm.runtime import prepare, text_or_empty

#: Distinct pre-tokens remembered by a task; beyond it the memory starts anew, which changes no count.
REMEMBERED = 1 << 20


class Counter:
    """Piece counts of pre-tokens of one sentencepiece model."""

    def __init__(self, model: str):
        import public_tokenizers
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(model))
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        if any("\n" in p or "▁" in p.lstrip("▁") for p in pieces):
            raise ValueError(f"{model}: pieces cross pre-tokens")
        self.known, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def of(self, units: list[bytes]) -> np.ndarray:
        """Piece counts of pre-tokens as units() has them."""
        asked, less = [], np.zeros(len(units), np.int64)
        for i, u in enumerate(units):
            s = u.decode("utf-8", "replace")
            if s[0] != " ":  # after a line feed
                asked.append("\n" + s)
                less[i] = 2
            elif s == " ":
                asked.append("")
                less[i] = -1
            elif s.isspace() and not s.strip(" "):
                asked.append(s[1:])
            else:
                asked.append(s[1:])  # the tokenizer puts one space before
        return np.fromiter(map(len, self.sp.encode(asked, num_threads=1)), np.int64, len(asked)) - less

    def total(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Token counts of the texts in a buffer in which every text has one space before it."""
        space, feed = buf == 32, buf == 10
        begins = np.zeros(len(buf), bool)
        begins[1:] = (space[1:] & ~space[:-1]) | feed[:-1] | feed[1:]
        begins[offsets[:-1]] = True
        start = np.flatnonzero(begins)
        end = np.append(start[1:], len(buf))
        is_feed = feed[start]
        text = np.searchsorted(offsets, start, side="right") - 1
        out = np.bincount(text[is_feed], minlength=len(offsets) - 1)
        start, end, text = start[~is_feed], end[~is_feed], text[~is_feed]
        keys, first, where = np.unique(Prefix(buf).spans(start, end), return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, keys)
        new = np.ones(len(keys), bool)
        inside = at < len(self.known)
        new[inside] = self.known[at[inside]] != keys[inside]
        counts = np.zeros(len(keys), np.int64)
        counts[~new] = self.counts[at[~new]]
        if new.any():
            i = first[new]
            data = buf.tobytes()
            counts[new] = self.of([data[a:b] for a, b in zip(start[i].tolist(), end[i].tolist(), strict=True)])
            if len(self.known) + new.sum() > REMEMBERED:
                self.known, self.counts = keys, counts
            else:
                known = np.concatenate([self.known, keys[new]])
                order = np.argsort(known, kind="stable")
                self.known, self.counts = known[order], np.concatenate([self.counts, counts[new]])[order]
        return (out + np.bincount(text, weights=counts[where], minlength=len(offsets) - 1)).astype(np.int64)


def counted(batches: Iterator[pa.RecordBatch], model: str, limit: int) -> Iterator[pa.RecordBatch]:
    counter = Counter(model)
    for batch in batches:
        n_tokens, n_bytes = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
        for lo, hi, buf, offsets in chunks(batch.column(1)):
            sizes = np.diff(offsets)
            n_bytes[lo:hi] = sizes
            raw = buf.tobytes()
            if b"\xe2\x96\x81" in raw:  # the space mark itself stands in a text: it acts as a space
                raw = None
            full = np.flatnonzero(sizes > 0)
            if raw is None:
                data = buf.tobytes()
                texts = [data[offsets[i] : offsets[i + 1]].decode() for i in full]
                n_tokens[lo + full] = [len(x) for x in counter.sp.encode(texts, num_threads=1)]
                continue
            moved = np.insert(buf, offsets[:-1][full], 32)
            at = np.append(0, np.cumsum(sizes[full] + 1))
            if len(full):
                n_tokens[lo + full] = counter.total(moved, at)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes), pa.array(n_tokens), pa.array(n_tokens > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])


def token_counts(docs: DataFrame, model: str = "piece_bpe_32k.model", limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bytes and tokens of every text. A null text is an empty one with no tokens; ids may be null or repeat; other columns don't matter."""
    prepare(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    return texts.mapInArrow(lambda it: counted(it, model, limit), f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
