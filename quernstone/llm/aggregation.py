"""One ranking from lists of several scores: robust rank aggregation.

Only the order within each list counts. An item's position in a list is divided by the number of items any list of the query holds,
so a long list weighs no more than a short one; an item a list doesn't hold has 1 there. With its m normalised ranks sorted, the
k-th is at most r with probability P(Beta(k, m - k + 1) <= r) if ranks were random; the least of these, times m, is the item's
significance, and the ranking is by it.

Equal scores share the mean of their positions. A row with a score is placed by it, one with only a rank by its rank, one with
neither after all others. Rows of a null query, index or unit are no hits. Duplicates count once (the best score, the least rank).
Equal significance is resolved by the mean rank, then by unit_id. A single list gives its own order.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.session import HOT_ROWS, bounded, split_hot

#: Up to so many lists the probabilities are written out as polynomials, which stay in generated code; with more, an Arrow function gives them.
WRITTEN_OUT = 8


def _hits(hits: DataFrame) -> DataFrame:
    h = hits.select("query_id", "index", "unit_id", F.col("score").cast("double").alias("score"), F.col("rank").cast("int").alias("rank"))
    h = h.filter("query_id is not null and `index` is not null and unit_id is not null")
    return h.groupBy("query_id", "index", "unit_id").agg(F.max(F.when(~F.isnan("score"), F.col("score"))).alias("score"), F.min("rank").alias("rank"))


def _positions(h: DataFrame) -> DataFrame:
    """`at`: the position in the list, by a window over each list."""
    by_list = Window.partitionBy("query_id", "index").orderBy(F.col("score").desc_nulls_last())
    first, last = F.rank().over(by_list), F.count(F.lit(1)).over(by_list.rangeBetween(Window.unboundedPreceding, 0))
    size = F.count(F.lit(1)).over(Window.partitionBy("query_id", "index"))
    by_rank = F.coalesce(F.col("rank").cast("double"), size.cast("double"))
    return h.select("query_id", "index", "unit_id", F.when(F.col("score").isNotNull(), (first + last) / 2).otherwise(F.greatest(F.lit(1.0), F.least(by_rank, size))).alias("at"))


def _positions_in_pieces(h: DataFrame, rows: int) -> DataFrame:
    """As _positions for lists too long for one task: each is cut by score into pieces of about ROWS rows, ranked apart and offset by
    the rows of the pieces before."""
    key = ["query_id", "index"]
    stats = h.groupBy(*key).agg(F.count(F.lit(1)).alias("_size"), F.min("score").alias("_lo"), F.max("score").alias("_hi"))
    h = h.join(bounded(stats), key)
    pieces = F.ceil(F.col("_size") / rows)
    share = (F.col("_hi") - F.col("score")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))
    h = h.withColumn("_piece", F.when(F.col("score").isNotNull(), F.least(pieces - 1, F.floor(F.coalesce(share, F.lit(0.0)) * pieces))).otherwise(pieces).cast("bigint"))
    ties = h.filter("score is not null").groupBy(*key, "_piece", "score").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*key).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ties.groupBy(*key, "_piece").agg(F.sum("_n").alias("_m")).withColumn("_before", F.coalesce(F.sum("_m").over(before), F.lit(0))).drop("_m")
    upto = Window.partitionBy(*key, "_piece").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    ties = ties.withColumn("_upto", F.sum("_n").over(upto)).join(offsets, [*key, "_piece"])
    mean = F.col("_before") + F.col("_upto") - (F.col("_n") - 1) / 2
    placed = h.join(ties.select(*key, "score", mean.alias("_mean")), [*key, "score"], "left")
    by_rank = F.greatest(F.lit(1.0), F.least(F.coalesce(F.col("rank").cast("double"), F.col("_size").cast("double")), F.col("_size")))
    return placed.select(*key, "unit_id", F.coalesce("_mean", by_rank).alias("at"))


def _tail(m: Column, most: int, k: int, r: Column) -> Column:
    """P(Beta(k, m - k + 1) <= r): of m random ranks at least k are at most r."""
    whole = F.lit(None)
    for n in range(1, most + 1):
        terms = [F.lit(float(comb(n, j))) * F.pow(r, F.lit(j)) * F.pow(1 - r, F.lit(n - j)) for j in range(k, n + 1)]
        whole = F.when(m == n, sum(terms[1:], terms[0]) if terms else F.lit(None)).otherwise(whole)
    return whole


def beta_cdf(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """P(Beta(a, b) <= x) of whole a and b, by the continued fraction of the regularised incomplete beta function (modified Lentz)."""
    turn = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(turn, b, a).astype(float), np.where(turn, a, b).astype(float), np.where(turn, 1 - x, x)
    logs = np.concatenate([[0.0, 0.0], np.cumsum(np.log(np.arange(1, max(2, int((a + b).max())))))])  # logs[n] = ln((n - 1)!)
    at = lambda n: logs[n.astype(np.int64)]
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(at(p + q) - at(p) - at(q) + p * np.log(y) + q * np.log1p(-y)) / p
    tiny = 1e-300
    c, d = np.ones_like(y), 1 - (p + q) * y / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    f = d.copy()
    for k in range(1, 10_000):
        for term in (k * (q - k) * y / ((p + 2 * k - 1) * (p + 2 * k)), -(p + k) * (p + q + k) * y / ((p + 2 * k) * (p + 2 * k + 1))):
            d, c = 1 + term * d, 1 + term / c
            d, c = 1 / np.where(np.abs(d) < tiny, tiny, d), np.where(np.abs(c) < tiny, tiny, c)
            f *= d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    value = np.where(y > 0, np.minimum(front * f, 1.0), 0.0)
    return np.where(turn, 1 - value, value)


def _tested(ats: pd.Series, n_units: pd.Series, n_lists: pd.Series) -> pd.DataFrame:
    """rho and mean rank of items, from their positions: of M lists those that don't hold the item have normalised rank 1."""
    rho, mean = np.ones(len(ats)), np.ones(len(ats))
    lists, sizes = n_lists.to_numpy(), n_units.to_numpy()
    for m in np.unique(lists):
        own = np.flatnonzero(lists == m)
        r = np.ones((len(own), m))
        for row, k in enumerate(own):
            held = np.minimum(np.asarray(ats.iloc[k], float) / sizes[k], 1.0)
            r[row, : len(held)] = held
        k = np.broadcast_to(np.arange(1, m + 1), r.shape)
        rho[own], mean[own] = np.minimum(1.0, beta_cdf(k, m - k + 1, r).min(axis=1) * m), r.mean(axis=1)
    return pd.DataFrame({"rho": rho, "mean_rank": mean})


tested = F.pandas_udf(_tested, T.StructType([T.StructField("rho", T.DoubleType()), T.StructField("mean_rank", T.DoubleType())]))


def _significance(places: DataFrame, sizes: DataFrame | None, most: int) -> DataFrame:
    """(query_id, unit_id, rho, mean_rank) from positions; SIZES has n_units and n_lists of each query where a window can't count them."""
    items = places.groupBy("query_id", "unit_id").agg(F.sort_array(F.collect_list("at")).alias("ats"), F.collect_set("index").alias("_in"))
    if sizes is None:
        query = Window.partitionBy("query_id")
        items = items.withColumns({"n_units": F.count(F.lit(1)).over(query), "n_lists": F.size(F.array_distinct(F.flatten(F.collect_set("_in").over(query))))})
    else:
        items = items.join(bounded(sizes), "query_id")
    if most > WRITTEN_OUT:
        items = items.withColumn("_t", tested("ats", F.col("n_units").cast("bigint"), F.col("n_lists").cast("int")))
        return items.select("query_id", "unit_id", F.round("_t.rho", 15).alias("rho"), F.round("_t.mean_rank", 12).alias("mean_rank"))
    ranks = [F.coalesce(F.least(F.get("ats", F.lit(k)) / F.col("n_units"), F.lit(1.0)), F.lit(1.0)) for k in range(most)]
    items = items.select("query_id", "unit_id", "n_lists", *[r.alias(f"_r{k}") for k, r in enumerate(ranks)])
    tails = [F.when(F.col("n_lists") > k, _tail(F.col("n_lists"), most, k + 1, F.col(f"_r{k}"))) for k in range(most)]
    rho = F.least(F.lit(1.0), (F.least(*tails) if most > 1 else tails[0]) * F.col("n_lists"))
    total = sum((F.when(F.col("n_lists") > k, F.col(f"_r{k}")).otherwise(0.0) for k in range(1, most)), F.col("_r0"))
    return items.select("query_id", "unit_id", F.round(rho, 15).alias("rho"), F.round(total / F.col("n_lists"), 12).alias("mean_rank"))


def _scored(hits: DataFrame, rows: int) -> DataFrame:
    most = max(1, hits.select("index").distinct().count())
    cold, hot = split_hot(hits.select("query_id", "index", "unit_id", "score", "rank"), ["query_id"], rows)
    # one shuffle: every later grouping has the query in its key
    done = _significance(_positions(_hits(cold.repartition("query_id"))), None, most)
    if hot is None:
        return done
    h = _hits(hot)
    sizes = h.groupBy("query_id").agg(F.count_distinct("unit_id").alias("n_units"), F.count_distinct("index").cast("int").alias("n_lists"))
    return done.unionByName(_significance(_positions_in_pieces(h, max(1, rows // 4)), sizes, most))


def best_units(hits: DataFrame, rows: int = HOT_ROWS) -> DataFrame:
    """(query_id, unit_id): the first of each query's combined ranking."""
    s = _scored(hits, rows)
    return s.groupBy("query_id").agg(F.min(F.struct("rho", "mean_rank", "unit_id")).alias("best")).select("query_id", "best.unit_id")


def combined_ranking(hits: DataFrame, top_k: int | None = None, rows: int = HOT_ROWS) -> DataFrame:
    """(query_id, position, unit_id, rho): each query's combined ranking, whole or its first TOP_K."""
    order = Window.partitionBy("query_id").orderBy("rho", "mean_rank", "unit_id")
    s = _scored(hits, rows).withColumn("position", F.row_number().over(order))
    s = s if top_k is None else s.filter(F.col("position") <= top_k)
    return s.select("query_id", "position", "unit_id", "rho")
