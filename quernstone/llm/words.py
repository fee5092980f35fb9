"""Words of texts as 64-bit codes, in Arrow and numpy. Words are runs of letters or digits, in lower case."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_BREAK = r"[^\p{L}\p{N}]+"


def codes(texts: pa.Array, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The codes of all words, one text after another, and where each text begins (one more than there are texts)."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    plain = pc.utf8_trim(pc.replace_substring_regex(pc.utf8_lower(texts), pattern=_BREAK, replacement=" "), characters=" ")
    lists = pc.split_pattern(plain, pattern=" ")
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    encoded = lists.flatten().dictionary_encode()
    words = encoded.dictionary.to_pylist()
    values = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))
    found = values[encoded.indices.to_numpy()] if len(words) else np.empty(0, np.uint64)
    if "" in words:  # a text without words splits into one empty word
        keep = encoded.indices.to_numpy() != words.index("")
        before = np.concatenate([[0], np.cumsum(keep)])
        return found[keep], before[offsets]
    return found, offsets


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def runs(values: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all runs of K consecutive words within each text, and where each text's begin."""
    sizes = np.diff(offsets)
    n = np.maximum(sizes - k + 1, 0)
    starts = np.concatenate([[0], np.cumsum(n)])
    at = np.arange(starts[-1]) + np.repeat(offsets[:-1] - starts[:-1], n)
    code = np.zeros(len(at), np.uint64)
    for j in range(k):
        code = mixed(code * np.uint64(0x9E3779B97F4A7C15) + values[at + j])
    return code, starts
