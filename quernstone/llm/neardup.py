"""Near-duplicate records: a Gray-ordered hierarchical index over fingerprints.

Each distinct text has BANDS x ROWS min-wise hashes of its runs of words, and a fingerprint of the lowest DEPTH bits of each. The index is
a forest. An upper node of tree b holds all texts that share the masked bit pattern of band b, ROWS whole hashes; two texts of
similarity s share one at least of them with probability 1 - (1 - s ** ROWS) ** BANDS. Below it the fingerprints are sorted by Gray
rank, so that neighbours share bits, and factored into blocks: the bits all of a block share are the block's mask and pattern. A search
adds up the differences from the root down and leaves a whole group out as soon as they pass the radius; what is left is compared one by
one. An exact comparison of the sets of runs follows.

Texts equal in words are one class, represented by its least unit_id, before the index is built. So a group of copies, however large,
is one fingerprint. A node with more than NODE distinct texts is divided once more, by PAIRS pairs of whole min-wise hashes: each member goes to that
many lower nodes, and two texts of similarity 0.5 miss each other in all of them with a probability below one in 100,000. A lower node
that is still as large holds texts nearly all of which are pairs; it is searched in cells of NODE by NODE members, one task each.

Defined cases: a null text is no record; texts of fewer than RUN words have no runs and are alike only if equal in words; equal rows
count once; pairs are of different unit_ids, the smaller first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.llm.words import codes, mixed, runs
from quernstone.session import bounded, cut, hot_keys

RUN = 3
SIMILARITY = 0.5
BANDS, ROWS, DEPTH = 30, 3, 3
HASHES = BANDS * ROWS
WORDS = -(-HASHES * DEPTH // 64)
BLOCK = 32
#: Members beyond which a node is divided.
NODE = 20_000
PAIRS = HASHES // 2
#: Members of a class in one task of a join; larger classes are salted by member.
CHUNK = 1_000
_SEEDS = np.random.default_rng(20).integers(1, 2**63, HASHES, dtype=np.int64).astype(np.uint64) | np.uint64(1)


def radius_of(similarity: float) -> int:
    """Differing bits that fingerprints of two texts as similar pass with a probability under one in a thousand: half the bits of those
    hashes that differ, plus 3.3 standard deviations."""
    differ = 1 - similarity
    mean = differ * DEPTH / 2
    spread = differ * (DEPTH / 4 + DEPTH**2 / 4) - mean**2
    return int(np.ceil(HASHES * mean + 3.3 * np.sqrt(HASHES * spread)))


def _minima(values: np.ndarray, starts: np.ndarray, seed: np.uint64) -> np.ndarray:
    x = values * seed
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return np.minimum.reduceat(x, starts)


def fingerprints(texts: pa.Array, run: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprints, band keys, has runs) of each text: WORDS words and BANDS keys."""
    words, offsets = codes(texts)
    values, starts = runs(words, offsets, run)
    some = np.diff(starts) > 0
    code, bands = np.zeros((len(some), WORDS), np.uint64), np.zeros((len(some), BANDS), np.uint64)
    if some.any():
        at = starts[:-1][some]
        own = np.zeros((len(at), WORDS), np.uint64)
        for b in range(BANDS):
            key = np.full(len(at), b + 1, np.uint64)
            for r in range(ROWS):
                least = _minima(values, at, _SEEDS[b * ROWS + r])
                key = mixed(key + least)
                low = mixed(least)
                for d in range(DEPTH):
                    bit = (b * ROWS + r) * DEPTH + d
                    own[:, bit // 64] |= ((low >> np.uint64(d)) & np.uint64(1)) << np.uint64(63 - bit % 64)
            bands[some, b] = key
        code[some] = own
    return code, bands, some


def gray_rank(code: np.ndarray) -> np.ndarray:
    """The place of each fingerprint (a row of words, highest first) in the Gray order of all."""
    rank, carry = code.copy(), np.zeros(len(code), np.uint64)
    for w in range(code.shape[1]):
        for shift in (1, 2, 4, 8, 16, 32):
            rank[:, w] ^= rank[:, w] >> np.uint64(shift)
        rank[:, w] ^= np.uint64(0) - carry
        carry = rank[:, w] & np.uint64(1)
    return rank


def _far(a: np.ndarray, b: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Differing bits under a mask, added up word by word."""
    return sum(np.bitwise_count((a[..., w] ^ b[..., w]) & mask[..., w]).astype(np.int16) for w in range(a.shape[-1]))


class Node:
    """The blocks below an upper node: fingerprints in Gray order, each block's mask of common bits and their pattern."""

    def __init__(self, code: np.ndarray) -> None:
        self.order = np.lexsort(gray_rank(code).T[::-1])
        self.code = code[self.order]
        at = np.arange(0, len(code), BLOCK)
        ones, zeros = np.bitwise_and.reduceat(self.code, at, axis=0), ~np.bitwise_or.reduceat(self.code, at, axis=0)
        self.mask, self.pattern = ones | zeros, ones

    def search(self, query: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(position in QUERY, position in the node's fingerprints as given) of all pairs within the radius."""
        for q in range(0, len(query), 256):
            part = query[q : q + 256]
            far = _far(part[:, None], self.pattern[None], self.mask[None])
            qs, blocks = np.nonzero(far <= radius)
            for k in range(0, len(qs), 8192):
                x, y = qs[k : k + 8192], blocks[k : k + 8192]
                rows = y[:, None] * BLOCK + np.arange(BLOCK)[None, :]
                there = rows < len(self.code)
                rows = np.minimum(rows, len(self.code) - 1)
                rest = _far(part[x, None], self.code[rows], ~self.mask[y, None])
                near, column = np.nonzero((far[x, y][:, None] + rest <= radius) & there)
                yield x[near] + q, self.order[rows[near, column]]


def _normal() -> Column:
    return F.trim(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]+", " "))


def members(records: DataFrame) -> DataFrame:
    """(unit_id, c1, c2): the class of each record, a 128-bit hash of its words. A written table."""
    named = records.filter("unit_id is not null and text is not null").select("unit_id", _normal().alias("_w"))
    return cut(named.select("unit_id", F.xxhash64("_w").alias("c1"), F.xxhash64(F.lit(11), "_w").alias("c2")).distinct(), "neardup-classes")


def membership(records: DataFrame) -> DataFrame:
    """(unit_id, class_id, n_members) of every record: its class of records equal in words, by the class's least unit_id."""
    classes = members(records.select("unit_id", "text"))
    sizes = classes.groupBy("c1", "c2").agg(F.min("unit_id").alias("class_id"), F.count(F.lit(1)).alias("n_members"))
    return classes.join(sizes, ["c1", "c2"]).select("unit_id", "class_id", "n_members")


def _firsts(records: DataFrame, classes: DataFrame) -> DataFrame:
    """(unit_id, c1, text) of one record per class: all but the later members of repeated classes, without a shuffle of texts."""
    own = ["c1", "c2"]
    least = classes.groupBy(*own).agg(F.count(F.lit(1)).alias("_n"), F.min("unit_id").alias("rep")).filter("_n > 1")
    others = bounded(classes.join(least, own).filter("unit_id <> rep").select("unit_id").distinct())
    named = records.filter("unit_id is not null and text is not null").select("unit_id", F.xxhash64(_normal()).alias("c1"), "text")
    return named.join(others, "unit_id", "left_anti")


def _printed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From c1, text: c1, code, keys."""
    for b in it:
        for k in range(0, b.num_rows, 2000):
            part = b.slice(k, 2000)
            code, bands, some = fingerprints(part.column("text"))
            code, bands = np.ascontiguousarray(code[some]), np.ascontiguousarray(bands[some])
            raw = pa.Array.from_buffers(pa.binary(8 * WORDS), len(code), [None, pa.py_buffer(code)]).cast(pa.binary())
            keys = pa.ListArray.from_arrays(pa.array(np.arange(len(bands) + 1) * BANDS, pa.int32()), pa.array(bands.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column("c1").filter(pa.array(some)), raw, keys], ["c1", "code", "keys"])


def _shared(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key those whose key another row has; a row waits only for the next batch's first."""
    last: pa.RecordBatch | None = None
    again = False
    for b in it:
        if not b.num_rows:
            continue
        key = b.column("key").to_numpy()
        if last is not None:
            same = last.column("key")[0].as_py() == key[0]
            if same or again:
                yield last
            again = same
        next_ = np.concatenate([key[1:] == key[:-1], [False]])
        before = np.concatenate([[again], next_[:-1]])
        yield b.slice(0, b.num_rows - 1).filter(pa.array((next_ | before)[:-1]))
        last, again = b.slice(b.num_rows - 1), bool(before[-1])
    if last is not None and again:
        yield last


def _words_of(code: pa.Array) -> np.ndarray:
    return np.frombuffer(code.buffers()[2], np.uint64, count=len(code) * WORDS, offset=code.offset * 8 * WORDS).reshape(-1, WORDS)


def _search(radius: int):
    """From rows sorted by node (key, part), index rows and queries told by `role` (0 both, 1 index, 2 query): pairs of classes."""

    def flush(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        key, part, role = (t[c].to_numpy() for c in ("key", "part", "role"))
        code = _words_of(t["code"].chunk(0))
        edges = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (part[1:] != part[:-1]), [True]]))
        sizes = np.diff(edges)
        two = edges[:-1][sizes == 2]  # most nodes: one comparison
        two = two[_far(code[two], code[two + 1], np.full((1, WORDS), ~np.uint64(0))) <= radius]
        left, right = [two], [two + 1]
        for a, z in zip(edges[:-1][sizes > 2], edges[1:][sizes > 2], strict=True):
            index, query = np.flatnonzero(role[a:z] != 2) + a, np.flatnonzero(role[a:z] != 1) + a
            if len(index) and len(query):
                for q, i in Node(code[index]).search(code[query], radius):
                    left.append(query[q])
                    right.append(index[i])
        i, j = np.concatenate(left), np.concatenate(right)
        c1 = t["c1"].to_numpy()
        a, b = np.minimum(c1[i], c1[j]), np.maximum(c1[i], c1[j])
        pairs = np.unique(np.stack([a, b], 1)[a != b], axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([*held, batch])
            key, part = t["key"].to_numpy(), t["part"].to_numpy()
            other = np.flatnonzero((key != key[-1]) | (part != part[-1]))
            first = int(other[-1]) + 1 if len(other) else 0
            if first:
                yield flush(t.slice(0, first))
            held = t.slice(first).combine_chunks().to_batches()
        if held:
            yield flush(pa.Table.from_batches(held))

    return run


def _divided(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From c1, text: c1, subs, the PAIRS keys of lower nodes."""
    for b in it:
        for k in range(0, b.num_rows, 2000):
            part = b.slice(k, 2000)
            values, starts = runs(*codes(part.column("text")), RUN)
            some = np.diff(starts) > 0
            at = starts[:-1][some]
            subs = np.empty((len(at), PAIRS), np.uint64)
            for j in range(PAIRS if len(at) else 0):
                subs[:, j] = mixed(mixed(_minima(values, at, _SEEDS[2 * j]) + np.uint64(j)) + _minima(values, at, _SEEDS[2 * j + 1]))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(subs) + 1) * PAIRS, pa.int32()), pa.array(subs.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column("c1").filter(pa.array(some)), lists], ["c1", "subs"])


def _repeated_keys(keyed: DataFrame, name: str) -> DataFrame:
    """(key, c1) of the keys that more than one row has. A written table."""
    return cut(keyed.repartition("key").sortWithinPartitions("key").select("key", "c1").mapInArrow(_shared, "key bigint, c1 bigint"), name)


def _lower_nodes(big: DataFrame, firsts: DataFrame) -> DataFrame:
    """(key, c1): the members of large nodes BIG by lower nodes of theirs."""
    members_ = big.select("c1").distinct()
    subs = cut(firsts.select("c1", "text").join(bounded(members_), "c1", "left_semi").mapInArrow(_divided, "c1 bigint, subs array<bigint>"), "neardup-subs")
    keyed = big.join(subs, "c1").select("c1", "key", F.explode("subs").alias("_sub")).select("c1", F.xxhash64("key", "_sub").alias("key"))
    return _repeated_keys(keyed, "neardup-lower")


def _celled(nodes: DataFrame) -> DataFrame:
    """nodes (key, c1) with part and role: 0 for ordinary ones; a node of more than NODE members is cut into chunks by member, and each
    member goes to the cells its chunk shares with another, as a query of the later and as an entry for the earlier."""
    plain = nodes.withColumns({"part": F.lit(0).cast("bigint"), "role": F.lit(0).cast("byte")})
    hot = hot_keys(nodes, ["key"], NODE)
    if hot is None:
        return plain
    named = hot.select("key", F.ceil(F.col("_n") / NODE).cast("bigint").alias("_c"))
    big = nodes.join(named, "key").withColumn("_x", F.expr("pmod(xxhash64(c1), _c)")).withColumn("_y", F.explode(F.expr("sequence(0L, _c - 1)")))
    role = F.when(F.col("_x") == F.col("_y"), 0).when(F.col("_x") > F.col("_y"), 1).otherwise(2).cast("byte")
    cells = big.select("key", "c1", (F.least("_x", "_y") * F.col("_c") + F.greatest("_x", "_y") + 1).alias("part"), role.alias("role"))
    return plain.join(named, "key", "left_anti").unionByName(cells)


def candidates(firsts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b): classes, a < b, whose fingerprints are within the radius in some tree. Keys are shuffled without fingerprints first, so
    only texts that share an upper node with another carry theirs through the search."""
    prints = cut(firsts.select("c1", "text").mapInArrow(_printed, "c1 bigint, code binary, keys array<bigint>"), "neardup-prints")
    nodes = _repeated_keys(prints.select("c1", F.explode("keys").alias("key")), "neardup-nodes")
    hot = hot_keys(nodes, ["key"], NODE)
    if hot is None:
        spread = nodes.withColumns({"part": F.lit(0).cast("bigint"), "role": F.lit(0).cast("byte")})
    else:
        plain, big = nodes.join(hot.select("key"), "key", "left_anti"), nodes.join(hot.select("key"), "key", "left_semi")
        spread = _celled(_lower_nodes(big, firsts)).unionByName(plain.withColumns({"part": F.lit(0).cast("bigint"), "role": F.lit(0).cast("byte")}))
    held = spread.join(prints.select("c1", "code"), "c1").repartition("key", "part").sortWithinPartitions("key", "part")
    return cut(held.select("key", "part", "role", "c1", "code").mapInArrow(_search(radius_of(similarity)), "a bigint, b bigint").distinct(), "neardup-pairs")


def _similar(run: int, similarity: float):
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 2000):
                part = b.slice(k, 2000)
                sets = []
                for name in ("text_a", "text_b"):
                    values, starts = runs(*codes(part.column(name)), run)
                    sets.append([np.unique(values[x:z]) for x, z in zip(starts[:-1], starts[1:], strict=True)])
                shared = np.array([np.isin(x, y, assume_unique=True).sum() for x, y in zip(*sets, strict=True)], np.int64)
                union = np.array([len(x) + len(y) for x, y in zip(*sets, strict=True)], np.int64) - shared
                share = shared / np.maximum(union, 1)
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(share)], ["unit_id_a", "unit_id_b", "similarity"]).filter(pa.array(share >= similarity))

    return check


def similar_firsts(firsts: DataFrame, pairs: DataFrame, run: int = RUN, similarity: float = SIMILARITY) -> DataFrame:
    """(unit_id_a, unit_id_b, similarity) of class representatives whose sets of runs are as similar. Only texts of candidates are
    shuffled."""
    named = pairs.select(F.col("a").alias("c1")).unionByName(pairs.select(F.col("b").alias("c1"))).distinct()
    texts = cut(firsts.join(bounded(named), "c1", "left_semi"), "neardup-texts")
    left, right = (texts.select(F.col("c1").alias(x), F.col("unit_id").alias(f"unit_{x}"), F.col("text").alias(f"text_{x}")) for x in "ab")
    both = pairs.join(left, "a").join(right, "b")
    both = both.select(F.col("unit_a").alias("a"), F.col("unit_b").alias("b"), "text_a", "text_b")
    return both.mapInArrow(_similar(run, similarity), "unit_id_a string, unit_id_b string, similarity double")


def _chunk(n: str, member: str) -> Column:
    """The chunk of a class of N members that a member is in."""
    return F.expr(f"cast(pmod(xxhash64({member}), {_chunks(n)}) as int)")


def _chunks(n: str) -> str:
    return f"cast(ceil({n} / {CHUNK}) as int)"


def _members_of(pairs: DataFrame, repeated: DataFrame, copies: DataFrame, side: str, other: str) -> DataFrame:
    """PAIRS with each member of the class of SIDE, a representative, in its place. A pair is sent to each chunk of a large class."""
    sizes = repeated.select(F.col("rep").alias(side), "_n")
    sent = pairs.join(bounded(sizes), side, "left").withColumn("_chunk", F.explode(F.expr(f"sequence(0, {_chunks('coalesce(_n, 1)')} - 1)"))).drop("_n")
    held = copies.select(F.col("rep").alias(side), _chunk("_n", "unit_id").alias("_chunk"), F.col("unit_id").alias("_member"))
    return sent.join(held, [side, "_chunk"], "left").select(F.coalesce("_member", side).alias(side), other)


def similar_pairs(records: DataFrame, run: int = RUN, similarity: float = SIMILARITY, copies: int | None = None) -> DataFrame:
    """(unit_id_a, unit_id_b): all pairs of records as similar, so n * (n - 1) / 2 of a class of n records equal in words. Only if COPIES
    is given, a class of more records takes part by its representative, and its others by one link each to that, which connects the same."""
    most = copies
    records = records.select("unit_id", "text")
    classes = members(records)
    firsts = _firsts(records, classes)
    reps = cut(similar_firsts(firsts, candidates(firsts, similarity), run, similarity), "neardup-similar").select("unit_id_a", "unit_id_b")
    own = ["c1", "c2"]
    repeated = classes.groupBy(*own).agg(F.count(F.lit(1)).alias("_n"), F.min("unit_id").alias("rep")).filter("_n > 1")
    held = cut(classes.join(repeated, own).select("unit_id", "rep", "_n"), "neardup-copies")
    links = held.limit(0) if most is None else held.filter((F.col("_n") > most) & (F.col("unit_id") != F.col("rep")))
    links = links.select(F.col("rep").alias("x"), F.col("unit_id").alias("y"))
    few = held if most is None else held.filter(F.col("_n") <= most)
    left = few.select("rep", F.explode(F.expr(f"sequence(0, {_chunks('_n')} - 1)")).alias("_chunk"), F.col("unit_id").alias("x"))
    right = few.select("rep", _chunk("_n", "unit_id").alias("_chunk"), F.col("unit_id").alias("y"))
    within = left.join(right, ["rep", "_chunk"]).filter("x < y").select("x", "y")
    sizes = few.filter("unit_id = rep").select("rep", "_n")
    across = _members_of(_members_of(reps, sizes, few, "unit_id_a", "unit_id_b"), sizes, few, "unit_id_b", "unit_id_a")
    every = links.unionByName(within).unionByName(across.select(F.col("unit_id_a").alias("x"), F.col("unit_id_b").alias("y")))
    return every.select(F.least("x", "y").alias("unit_id_a"), F.greatest("x", "y").alias("unit_id_b")).distinct()


def groups(records: DataFrame, run: int = RUN, similarity: float = SIMILARITY) -> DataFrame:
    """(unit_id, group_id): connected records; the group's least unit_id. Links to a class's representative do for that. Large and small stars alternate until nothing changes, each
    round one aggregation and written table, so nothing is collected."""
    pairs = similar_pairs(records, run, similarity, copies=1)
    labels = cut(pairs.select(F.col("unit_id_a").alias("u"), F.col("unit_id_b").alias("v")), "neardup-edges")
    while True:
        both = labels.unionByName(labels.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small_ = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        after = cut(small_, "neardup-edges")
        if after.count() == labels.count() and not after.join(labels, ["u", "v"], "left_anti").head(1):
            break
        labels = after
    return labels.select(F.col("u").alias("unit_id"), F.col("v").alias("group_id")).unionByName(labels.select(F.col("v").alias("unit_id"), F.col("v").alias("group_id"))).distinct()
