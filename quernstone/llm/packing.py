"""Filling containers of fixed capacity with documents by planning over the histogram of their lengths.

Lengths are counted in tokens of a public tokenizer (a path is the parameter). A document longer than a container is cut into full
containers and a rest; all others stay whole. The plan packs counts, not documents: from the longest length down, all containers of
one form are filled alike, each with the longest length that still fits (best fit), as often as the counts allow. The histogram has at
most CAPACITY rows, so the plan is made on the driver at any size of the input, and has at most CAPACITY forms of at most
sqrt(2 * CAPACITY) lengths each. Documents take the planned slots by joining on their rank within their length; ranks are counted in hash
pieces of about PIECE documents, so one length may be as common as it likes and no task ranks more.

Defined cases: a null or empty text has no tokens and is in no container; equal texts are packed each; a repeated doc_id with another
text is another document.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernstone.session import bounded, cut

CAPACITY = 2048
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The public split pattern of the vocabulary's byte-level BPE.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: Documents of one length that one task ranks.
PIECE = 250_000
_CODERS: dict = {}


def _coder(path: str):
    import tiktoken

    if path not in _CODERS:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}
        _CODERS[path] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _CODERS[path]


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens) of each row with a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(tokenizer)
        for b in batches:
            counts = [len(coder.encode_ordinary(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64())], ["doc_id", "n_tokens"])

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").filter("text <> ''").mapInArrow(run, "doc_id bigint, n_tokens bigint")


def plan_slots(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best fit over counts. Rows (length, first_rank, last_rank, first_container, per_container): the documents of that length whose rank
    is from first_rank to last_rank (from 0) go to the containers from first_container on, per_container of them to each."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    taken, slots, container = np.zeros(capacity + 1, np.int64), [], 0
    while len(lengths := np.flatnonzero(left)):
        form, room, stock = {}, capacity, left.copy()
        while room and len(fits := np.flatnonzero(stock[: room + 1])):
            length = int(fits[-1])
            # all containers of a form are alike: one is added as often as the scarcest of its lengths allows
            form[length] = form.get(length, 0) + 1
            stock[length] -= 1
            room -= length
        times = min(int(left[k]) // m for k, m in form.items())
        for k, m in sorted(form.items()):
            slots.append((k, int(taken[k]), int(taken[k]) + times * m - 1, container, m))
            taken[k] += times * m
            left[k] -= times * m
        container += times
        del lengths
    return slots


def pack(documents: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, piece: int = PIECE) -> DataFrame:
    """(container_id, doc_id, first_token, n_tokens), one row per document, or per piece of one that is longer than a container."""
    spark = documents.sparkSession
    sizes = token_counts(documents, tokenizer)
    rest = F.col("n_tokens") - F.col("_k") * capacity
    pieces = sizes.withColumn("_k", F.explode(F.sequence(F.lit(0), F.floor((F.col("n_tokens") - 1) / capacity).cast("int"))))
    pieces = pieces.select("doc_id", (F.col("_k") * capacity).cast("bigint").alias("first_token"), F.least(rest, F.lit(capacity)).cast("bigint").alias("n_tokens"))
    pieces = cut(pieces, "packing-pieces")
    histogram = {r["n_tokens"]: r["n"] for r in pieces.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most CAPACITY rows
    slots = plan_slots(histogram, capacity)
    parted = F.broadcast(spark.createDataFrame([(k, -(-n // piece)) for k, n in histogram.items()], "n_tokens bigint, _pieces bigint"))
    planned = F.broadcast(spark.createDataFrame(slots, "n_tokens bigint, _first bigint, _last bigint, _container bigint, _per bigint"))
    pieces = pieces.join(parted, "n_tokens").withColumn("_piece", F.expr("pmod(xxhash64(doc_id, first_token), _pieces)")).drop("_pieces")
    upto = F.sum("_n").over(Window.partitionBy("n_tokens").orderBy("_piece"))
    before = bounded(pieces.groupBy("n_tokens", "_piece").agg(F.count(F.lit(1)).alias("_n")).select("n_tokens", "_piece", (upto - F.col("_n")).alias("_before")))
    rank = F.row_number().over(Window.partitionBy("n_tokens", "_piece").orderBy("doc_id", "first_token")) - 1
    ranked = pieces.withColumn("_rank", rank).join(before, ["n_tokens", "_piece"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    placed = ranked.join(planned, "n_tokens").filter("_rank between _first and _last")
    return placed.select((F.col("_container") + F.floor((F.col("_rank") - F.col("_first")) / F.col("_per"))).alias("container_id"), "doc_id", "first_token", "n_tokens")
