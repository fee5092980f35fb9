"""Held-out passages in training text: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

An item is looked for at two sizes. Passages: each run of WINDOW words of it. Whole items: windows of the greatest WINDOW * 2 ** k words it
has, so that an item and windows of documents differ in length by less than half. Every window of the documents of these sizes has a
SimHash, the signs of the words' summed code bits. The items' fingerprints are cut into BLOCKS blocks, each with a table from all values
that differ in at most radius // BLOCKS bits to windows; two fingerprints that differ in at most the radius agree so far in one block at
least, so looking up every document window misses none. Candidates are verified by the words themselves: the longest run of equal words
around matching passages, and the similarity of the shingles, the share of the item's that the document holds, each weighted by how few
items hold it.

leaks() gives both measures. A document near a whole item is one of a similarity of SIMILARITY; one that holds a passage has a run of WINDOW
words. Items are sent to the executors in passes of MOST_ITEMS, so they may be any number; a pass reads the documents once, and
never shuffles them, only findings are. Words are runs of letters or digits in lower case, so punctuation, case and spacing don't count.

Defined cases: a null or empty text, or one of fewer than WINDOW words, holds no item and is none; equal items are found each; equal
documents of another id each; a repeated (item, document) counts once, with its greatest values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.words import codes, mixed, runs
from quernstone.session import cut, passes

WINDOW = 13
#: Differing bits of passages, and of windows of whole items: an edited word of 26 changes about five bits of 64.
RADIUS, ITEM_RADIUS = 3, 11
BLOCKS = 4
BITS = 64 // BLOCKS
SHINGLE = 5
SIMILARITY = 0.8
#: Items in one pass over the documents.
MOST_ITEMS = 20_000


def simhashes(values: np.ndarray, offsets: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """SimHash of each window of words, the place of its first word, and the text it belongs to."""
    sizes = np.diff(offsets)
    n = np.maximum(sizes - window + 1, 0)
    starts = np.concatenate([[0], np.cumsum(n)])
    at = np.arange(starts[-1]) + np.repeat(offsets[:-1] - starts[:-1], n)
    text = np.repeat(np.arange(len(sizes)), n)
    if not len(at):
        return np.empty(0, np.uint64), at, text
    out = np.empty((len(at), 8), np.uint8)
    spread = np.ascontiguousarray(mixed(values)).view(np.uint8).reshape(-1, 8)
    ends = at + window
    for byte in range(8):
        bits = np.unpackbits(spread[:, byte : byte + 1], axis=1)
        sums = np.zeros((len(values) + 1, 8), np.int32)
        np.cumsum(bits, axis=0, dtype=np.int32, out=sums[1:])
        out[:, byte] = np.packbits(sums[ends] - sums[at] > window // 2, axis=1)[:, 0]
    return out.view(np.uint64)[:, 0], at, text


class Layer:
    """The items' windows of one size by blocks of their fingerprints."""

    def __init__(self, words: np.ndarray, offsets: np.ndarray, window: int, radius: int, stride: int = 1) -> None:
        self.window, self.radius = window, radius
        prints, at, item = simhashes(words, offsets, window)
        begin, end = offsets[:-1][item], offsets[1:][item]
        keep = ((at - begin) % stride == 0) | (at + window == end)
        self.prints, self.at, self.item = prints[keep], at[keep], item[keep]
        masks = [0]
        for _ in range(radius // BLOCKS):
            masks = sorted({m ^ flip for m in masks for flip in [0, *(1 << b for b in range(BITS))]})
        self.tables = []
        for lo in range(0, 64, BITS):
            block = (self.block(self.prints, lo)[:, None] ^ np.array(masks)[None, :]).ravel()
            order = np.argsort(block, kind="stable")
            self.tables.append((lo, order // len(masks), np.cumsum(np.bincount(block + 1, minlength=(1 << BITS) + 1))))

    @staticmethod
    def block(prints: np.ndarray, lo: int) -> np.ndarray:
        return ((prints >> np.uint64(lo)) & np.uint64((1 << BITS) - 1)).view(np.int64)

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document window, item window) of all pairs within the radius; a pair may come from several blocks."""
        left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for lo, order, firsts in self.tables:
            block = self.block(prints, lo)
            n = firsts[block + 1] - firsts[block]
            some = np.flatnonzero(n)
            n, begin = n[some], firsts[block[some]]
            ends = np.cumsum(n)
            if not len(ends):
                continue
            q = np.repeat(some, n)
            w = order[np.arange(ends[-1]) + np.repeat(begin - (ends - n), n)]
            near = np.bitwise_count(prints[q] ^ self.prints[w]) <= self.radius
            left.append(q[near])
            right.append(w[near])
        return np.concatenate(left), np.concatenate(right)


def item_shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(shingle, item) of all distinct shingles of each item, in the order of the items."""
    shingles, starts = runs(*codes(pa.array(texts, pa.string())), SHINGLE)
    owner = np.repeat(np.arange(len(texts)), np.diff(starts))
    order = np.lexsort((shingles, owner))
    shingles, owner = shingles[order], owner[order]
    new = np.ones(len(owner), bool)
    new[1:] = (shingles[1:] != shingles[:-1]) | (owner[1:] != owner[:-1])
    return shingles[new], owner[new]


class Index:
    """Items by passages, and by windows of their own size where WHOLE is wanted. HELD is in how many of all N_ITEMS items each shingle
    stands; if it isn't given, these items are all."""

    def __init__(self, ids: list[int], texts: list[str], window: int = WINDOW, radius: int = RADIUS, whole: bool = True, held: dict[int, int] | None = None, n_items: int | None = None) -> None:
        self.window, self.ids = window, np.array(ids, np.int64)
        self.words, self.offsets = codes(pa.array(texts, pa.string()))
        self.passages = Layer(self.words, self.offsets, window, radius)
        self.items = []
        sizes = np.diff(self.offsets)
        size = 2 * window
        while whole and np.any(sizes >= size):
            own = (sizes >= size) & (sizes < 2 * size)
            if own.any():
                pieces = [self.words[a:z] for a, z in zip(self.offsets[:-1][own], self.offsets[1:][own], strict=True)]
                layer = Layer(np.concatenate(pieces), np.concatenate([[0], np.cumsum([len(x) for x in pieces])]), size, ITEM_RADIUS, size // 4)
                layer.item = np.flatnonzero(own)[layer.item]
                self.items.append(layer)
            size *= 2
        shingles, owner = item_shingles(texts)
        if held is None:
            _, inverse, n = np.unique(shingles, return_inverse=True, return_counts=True)
            n = n[inverse] if len(shingles) else np.empty(0)
        else:
            n = np.array([held.get(x, 1) for x in shingles.tolist()], float)
        weight = np.log1p((len(ids) if n_items is None else n_items) / n)
        self.total = np.bincount(owner, weight, len(ids))
        order = np.argsort(shingles, kind="stable")
        self.known, self.firsts = np.unique(shingles[order], return_index=True)
        self.firsts = np.append(self.firsts, len(order))
        self.owner, self.weight = owner[order], weight[order]

    def shared(self, shingles: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pair, sum): of each text and item with a shingle in common, as text * items + item in order, the weights of those in common."""
        at = np.minimum(np.searchsorted(self.known, shingles), max(len(self.known) - 1, 0))
        hit = self.known[at] == shingles if len(self.known) else np.zeros(len(shingles), bool)
        pairs = np.unique(text[hit] * max(len(self.known), 1) + at[hit])
        t, s = pairs // max(len(self.known), 1), pairs % max(len(self.known), 1)
        n = self.firsts[s + 1] - self.firsts[s]
        ends = np.cumsum(n)
        entry = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.firsts[s] - (ends - n), n)
        key, inverse = np.unique(np.repeat(t, n) * len(self.ids) + self.owner[entry], return_inverse=True)
        return key, np.bincount(inverse, self.weight[entry], len(key))

    def find(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, item id, longest run of equal words or 0, weighted share of the item's shingles) of the candidates."""
        words, offsets = codes(texts)
        prints, at, text = simhashes(words, offsets, self.window)
        q, w = self.passages.candidates(prints)
        places, items = self.passages.at[w], self.passages.item[w]
        keys = [text[q] * len(self.ids) + items]
        for layer in self.items:
            prints, _, text_ = simhashes(words, offsets, layer.window)
            x, y = layer.candidates(prints)
            keys.append(text_[x] * len(self.ids) + layer.item[y])
        pair = np.unique(np.concatenate(keys))
        longest = np.zeros(len(pair), np.int64)
        same = np.ones(len(q), bool)
        for j in range(self.window):
            same &= words[at[q] + j] == self.words[places + j]
        # equal windows that follow each other on one diagonal make one longer run
        rows = np.unique(np.stack([keys[0], at[q] - places, at[q]], 1)[same], axis=0)
        if len(rows):
            new = np.concatenate([[True], np.any(rows[1:, :2] != rows[:-1, :2], axis=1) | (rows[1:, 2] != rows[:-1, 2] + 1)])
            begins = np.flatnonzero(new)
            np.maximum.at(longest, np.searchsorted(pair, rows[begins, 0]), np.diff(np.append(begins, len(rows))) + self.window - 1)
        share = np.zeros(len(pair))
        if len(pair):
            shingles, starts = runs(words, offsets, SHINGLE)
            key, sums = self.shared(shingles, np.repeat(np.arange(len(starts) - 1), np.diff(starts)))
            k = np.minimum(np.searchsorted(key, pair), max(len(key) - 1, 0))
            held = key[k] == pair if len(key) else np.zeros(len(pair), bool)
            share[held] = sums[k[held]] / self.total[pair[held] % len(self.ids)]
        return pair // max(len(self.ids), 1), self.ids[pair % max(len(self.ids), 1)], longest, share


def _held_by(items: DataFrame) -> DataFrame:
    """(shingle, n) of the shingles that more than one of the items holds. A written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(item_shingles(b.column(0).to_pylist())[0].view(np.int64))], ["shingle"])

    return cut(items.select("text").mapInArrow(run, "shingle bigint").groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "leakage-shingles")


def leaks(documents: DataFrame, items: DataFrame, window: int = WINDOW, radius: int = RADIUS, whole: bool = True) -> DataFrame:
    """(item_id, doc_id, longest_run, similarity) of documents with a window near one of an item's; without WHOLE only near its passages."""
    spark = documents.sparkSession
    named = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").filter("item_id is not null and text <> ''").distinct()
    n, blocks = passes(named, "item_id", MOST_ITEMS)
    d = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").filter("doc_id is not null and text is not null")
    schema = "item_id bigint, doc_id bigint, longest_run int, similarity double"
    shared = _held_by(named) if n > 1 else None
    n_items = named.count() if n > 1 else None
    found = spark.createDataFrame([], schema)
    for block in blocks:
        if not block:
            continue
        ids, texts = [r["item_id"] for r in block], [r["text"] for r in block]
        held = None
        if shared is not None:
            own = spark.createDataFrame(pd.DataFrame({"shingle": np.unique(item_shingles(texts)[0]).view(np.int64)}))
            held = {r["shingle"] % 2**64: r["n"] for r in shared.join(own, "shingle").collect()}
        index = spark.sparkContext.broadcast(Index(ids, texts, window, radius, whole, held, n_items))
        found = found.unionByName(d.mapInArrow(_finder(index), schema))
    return found.groupBy("item_id", "doc_id").agg(F.max("longest_run").alias("longest_run"), F.max("similarity").alias("similarity"))


def _finder(index: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 1000):
                part = b.slice(k, 1000)
                text, item, run_, share = index.value.find(part.column(1))
                yield pa.RecordBatch.from_arrays([pa.array(item), part.column(0).take(pa.array(text)), pa.array(run_, pa.int32()), pa.array(share)], ["item_id", "doc_id", "longest_run", "similarity"])

    return run


def near_items(found: DataFrame, similarity: float = SIMILARITY, window: int = WINDOW) -> DataFrame:
    """(item_id, doc_id, longest_run, similarity) of documents that hold an item nearly whole, or a passage of it."""
    return found.filter((F.col("similarity") >= similarity) | (F.col("longest_run") >= window))


def verified(found: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, doc_id) of documents that share at least WINDOW consecutive words with the item."""
    return found.filter(F.col("longest_run") >= window).select("item_id", "doc_id")
