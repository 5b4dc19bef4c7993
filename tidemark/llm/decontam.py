"""Benchmark decontamination: size-partitioned MinHash containment search.

Test items are short and documents may be long, so the Jaccard similarity of
the two says little. Items are therefore partitioned by the size of their
shingle sets (powers of two). For the items of a partition whose sets hold up
to ``s`` shingles, a document is read as windows of ``2s`` shingles that
start every ``s``: a passage copied from an item lies inside one of them,
and there the containment asked for implies a Jaccard similarity of at least
``t*q / (2s + (1-t)*q)`` (a partition holds sizes above ``s/2`` up to ``s``,
from one shingle on: more than 0.176 for its smallest item, 0.33 for the
largest). ``hashes`` MinHash values per window, one per band, then miss a
copied passage with a chance of at most ``(1 - 0.176) ** hashes``, 4e-6 for 64;
a passage as long as the partition allows, with 1e-11.
Items of fewer than five words have one shingle of fewer words; a document
contains such an item if it is the same short sequence.

Every candidate is verified exactly: the share of the item's distinct
shingles that the whole document holds must reach ``threshold``.

Documents are read where they lie; the items are the stated query set and go
to the tasks in blocks of at most ``block_bytes`` of text, one pass over the
documents for each block.

Defined cases: null or empty texts and items match nothing. Items and
documents with a null id are matched like others (null in the result);
``clean`` takes rows by their texts, whatever their ids. Repeated rows
are matched each; repeated rows of an item count once per (item_id, text).
An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import WordHasher, mix64, nullable, rows_at_once, shingle_hashes, whole, words

HASHES = 64
BLOCK_BYTES = 16 << 20


def _multipliers(n: int) -> np.ndarray:
    return (mix64(np.arange(1, n + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


class ItemIndex:
    """MinHash values of a block of items, by size partition."""

    def __init__(self, texts: list[str], size: int, hashes: int):
        hasher = WordHasher()
        self.size, self.mult = size, _multipliers(hashes)
        self.sets = [np.unique(shingle_hashes(hasher(words(t)), size)) for t in texts]
        parts: dict[int, list[int]] = {}
        for i, s in enumerate(self.sets):
            if len(s):
                parts.setdefault(1 << (len(s) - 1).bit_length(), []).append(i)
        # per partition and hash function: sorted minima with the items they stand for
        self.parts = []
        for s, items in sorted(parts.items()):
            low = [(self.sets[i] >> np.uint64(32)).astype(np.uint32) for i in items]
            bands = []
            for m in self.mult:
                v = np.array([(x * m).min() for x in low], np.uint32)
                order = np.argsort(v, kind="stable")
                bands.append((v[order], np.array(items, np.int64)[order]))
            self.parts.append((s, bands))
        known = np.concatenate([*self.sets, np.empty(0, np.uint64)])
        self.all = np.unique(known)

    def candidates(self, h: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Distinct (document, item) pairs of one batch; h: all shingles, owner: their document."""
        x = (h >> np.uint64(32)).astype(np.uint32)
        found = []
        first = np.r_[0, np.flatnonzero(owner[1:] != owner[:-1]) + 1]
        lens = np.diff(np.r_[first, len(h)])
        for s, bands in self.parts:
            # blocks of s shingles inside each document; a window is a block and the next one
            per = -(-lens // s)
            doc = np.repeat(np.arange(len(first)), per)
            starts = first[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)) * s
            last = np.r_[doc[1:] != doc[:-1], True]
            buf = np.empty_like(x)
            for m, (values, items) in zip(self.mult, bands):
                np.multiply(x, m, out=buf)
                low = np.minimum.reduceat(buf, starts)
                win = np.where(last, low, np.minimum(low, np.r_[low[1:], low[-1:]]))
                lo = np.searchsorted(values, win)
                hit = np.flatnonzero(values[np.minimum(lo, len(values) - 1)] == win)
                if not len(hit):
                    continue
                n = np.searchsorted(values, win[hit], "right") - lo[hit]
                at = np.repeat(lo[hit], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                found.append(np.unique(owner[starts[np.repeat(hit, n)]] * np.int64(len(self.sets)) + items[at]))
        return np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)


class Matcher:
    """Finds the items of an index in texts, in groups of at most ``GROUP`` shingles (or one longer text)."""

    GROUP = 200_000

    def __init__(self, index: ItemIndex, threshold: float):
        self.ix, self.threshold, self.hasher = index, threshold, WordHasher()

    def __call__(self, texts) -> Iterator[tuple[int, int, int]]:
        """``(text, item, shared shingles)``, by their numbers."""
        sets, rows, held = [], [], 0
        for row, t in enumerate(texts):
            s = shingle_hashes(self.hasher(words(t)), self.ix.size)
            if len(s):
                sets.append(s)
                rows.append(row)
                held += len(s)
            if held >= self.GROUP:
                yield from self._matches(sets, rows)
                sets, rows, held = [], [], 0
        if sets:
            yield from self._matches(sets, rows)

    def _matches(self, sets: list[np.ndarray], rows: list[int]) -> Iterator[tuple[int, int, int]]:
        lens = np.array([len(s) for s in sets])
        pairs = self.ix.candidates(np.concatenate(sets), np.repeat(np.arange(len(sets)), lens))
        seen, known = -1, None
        for d, i in zip(pairs // len(self.ix.sets), pairs % len(self.ix.sets)):
            if d != seen:
                seen, known = d, np.unique(sets[d])
            item = self.ix.sets[i]
            at = np.minimum(np.searchsorted(known, item), len(known) - 1)
            shared = int((known[at] == item).sum())
            if shared >= self.threshold * len(item):
                yield rows[d], int(i), shared


def _blocks(docs: DataFrame, items: DataFrame, size: int, hashes: int, block_bytes: int):
    """Ids and index of each block of items; the index is broadcast, its size is bounded by the block."""
    items = items.select("item_id", "text").where("text is not null").distinct()
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_bytes))
    for b in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text")
        rows = block.select(whole("item_id"), "text").collect()
        index = ItemIndex([r[1] for r in rows], size, hashes)
        yield np.array([r[0] for r in rows], np.int64), docs.sparkSession.sparkContext.broadcast(index)


def _search(docs: DataFrame, names: np.ndarray, index, threshold: float) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]):
        match = Matcher(index.value, threshold)
        for pdf in frames:
            ids = pdf["doc_id"].to_numpy()
            out = [(ids[d], names[i], len(match.ix.sets[i]), shared, shared / len(match.ix.sets[i]))
                   for d, i, shared in match(pdf["text"])]
            if out:
                yield pd.DataFrame(out, columns=["doc_id", "item_id", "item_shingles", "shared", "containment"])

    kind = "doc_id long, item_id long, item_shingles long, shared long, containment double"
    out = docs.select(whole("doc_id"), "text").mapInPandas(run, kind)
    return out.withColumns({"doc_id": nullable("doc_id"), "item_id": nullable("item_id")})


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.75, size: int = 5,
                 hashes: int = HASHES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(doc_id, item_id, item_shingles, shared, containment)`` of every document that holds an item."""
    rows_at_once(docs.sparkSession)
    return reduce(DataFrame.unionByName, [_search(docs, names, index, threshold) for names, index in
                                          _blocks(docs, items, size, hashes, block_bytes)])


def clean(docs: DataFrame, items: DataFrame, threshold: float = 0.75, size: int = 5, hashes: int = HASHES,
          block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without the rows that hold a test item. Each row is judged by its own text, where it is read."""
    rows_at_once(docs.sparkSession)

    def without(index):
        def run(batches: Iterator[pa.RecordBatch]):
            match = Matcher(index.value, threshold)
            for batch in batches:
                stays = np.ones(batch.num_rows, bool)
                stays[[d for d, _, _ in match(batch["text"].to_pylist())]] = False
                yield batch.filter(pa.array(stays))
        return run

    for _, index in _blocks(docs, items, size, hashes, block_bytes):
        docs = docs.mapInArrow(without(index), docs.schema)
    return docs
