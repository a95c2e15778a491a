"""Approximate nearest neighbours by an adaptive dimension scan over inverted lists.

Centres are fitted on a bounded sample, every row is put into its nearest centre's list.
In each probed list the rotated vectors are scanned in blocks of columns; after each block
a hypothesis test on the partial distance abandons the candidates that will hardly come
under the query's bound. What survives is measured exactly, in double precision, on the
original vectors. The number of probed lists is chosen on the sample: the least that finds
`aim` of its true neighbours, and for each query at least so many that they hold more than k
vectors of the sample. The k-th nearest of the sample's vectors in the probed lists is the
query's bound; all neighbours returned are found by the scan of the lists.

Defined results: vectors that are null, zero, or hold null or non-finite components, and
vectors of another dimension than the commonest, take no part. Rows that repeat an id are
one candidate at their smallest distance. Ties go to the smaller id. With fewer candidates
than k all that are found are returned; an empty table gives no rows. Only the named
columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.llm.bytewords import lean
from loomline.llm.spool import Spool

#: Rows of a list, and queries of a list, that meet in one task.
ROWS, QUERIES = 8192, 2048
BLOCK = 16


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0)


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    """A random orthogonal matrix: it spreads each difference evenly over the columns."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a to all rows of b, good enough to choose lists by."""
    return np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None], 0)


def fit_centres(sample: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """k-means over the sample's distinct vectors."""
    sample = np.unique(sample, axis=0)
    centres = sample[np.random.default_rng(5).permutation(len(sample))[:lists]].copy()
    for _ in range(rounds):
        near = nearest_centres(sample, centres, 1)[:, 0]
        total, count = np.zeros_like(centres), np.bincount(near, minlength=len(centres))
        np.add.at(total, near, sample)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
    return centres


def nearest_centres(x: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    out = []
    for lo in range(0, len(x), 4096):
        d = squares(x[lo : lo + 4096], centres)
        part = np.argpartition(d, n - 1, 1)[:, :n] if n < d.shape[1] else np.tile(np.arange(d.shape[1]), (len(d), 1))
        out.append(np.take_along_axis(part, np.argsort(np.take_along_axis(d, part, 1), 1, kind="stable"), 1))
    return np.concatenate(out) if out else np.empty((0, n), np.int64)


def lists_to_probe(sample: np.ndarray, centres: np.ndarray, k: int, aim: float, least: int) -> int:
    """Lists that hold the share `aim` of the true neighbours of some vectors, among vectors that the centres weren't fitted on."""
    sample = np.unique(sample, axis=0)
    if len(sample) <= k + 1:
        return len(centres)
    some = sample[np.random.default_rng(3).permutation(len(sample))[:300]]
    true = np.argpartition(squares(some, sample), k + 1, 1)[:, : k + 1]
    home = nearest_centres(sample, centres, 1)[:, 0]
    order = nearest_centres(some, centres, len(centres))
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(order.shape[1])[None].repeat(len(some), 0), 1)
    needed = np.sort(np.take_along_axis(place, home[true], 1).ravel())
    return int(min(len(centres), max(least, needed[int(np.ceil(aim * len(needed))) - 1] + 1)))


def least_by_id(ids: np.ndarray, distances: np.ndarray) -> np.ndarray:
    """Places of the nearest row of each id, by id."""
    order = np.lexsort((distances, ids))
    return order[np.r_[True, ids[order][1:] != ids[order][:-1]]] if len(ids) else order


def adaptive_scan(queries: np.ndarray, bound: np.ndarray, own: np.ndarray, rows: np.ndarray, ids: np.ndarray, turn: np.ndarray, k: int, slack: float = 2.1) -> list[tuple[np.ndarray, np.ndarray]]:
    """The k nearest rows of each query that aren't its own id: (ids, distances). bound: a squared distance each query is sure of."""
    dim = rows.shape[1]
    rotated = np.ascontiguousarray((rows @ turn).T)  # by column
    out = []
    for q, query in enumerate(queries):
        blur = 1e-10 * float(query @ query)  # what rotation may do to the distance of equal vectors
        tau = bound[q] * (1 + 1e-9) + blur
        alive = np.flatnonzero(ids != own[q])
        partial, t = np.zeros(len(alive)), query @ turn
        for lo in range(0, dim, BLOCK):
            hi = min(lo + BLOCK, dim)
            cols = rotated[lo:hi]
            diff = (cols if len(alive) == len(ids) else cols[:, alive]) - t[lo:hi, None]
            partial = partial + np.einsum("ij,ij->j", diff, diff)
            if np.isfinite(tau):
                share = hi / dim
                limit = tau * share * (1 + slack / np.sqrt(hi)) ** 2 if hi < dim else tau * (1 + 1e-6)
                keep = partial <= limit
                alive, partial = alive[keep], partial[keep]
            if not len(alive):
                break
        if len(alive) > 4 * k:  # more than enough: those clearly beyond the k-th go before the exact measure
            once = partial[least_by_id(ids[alive], partial)]
            if len(once) > k:
                alive = alive[partial <= np.partition(once, k - 1)[k - 1] * (1 + 1e-6) + blur]
        exact = np.sqrt(((rows[alive] - query) ** 2).sum(1))
        order = np.lexsort((ids[alive], exact))
        name = ids[alive][order]
        first = np.sort(np.unique(name, return_index=True)[1])[:k]
        out.append((name[first], exact[order][first]))
    return out


def search(vectors: DataFrame, query: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, sample_rows: int = 20_000, max_lists: int = 4096, aim: float = 0.99, least_probes: int = 8) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found of every row for which `query` holds."""
    spark = vectors.sparkSession
    result = "query_id long, rank int, vec_id long, score double"
    v = F.col("v")
    own = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].alias("v"), F.coalesce(query, F.lit(False)).alias("asks")).where(F.col("id").isNotNull() & usable(v))
    size = own.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    if not size:
        return spark.createDataFrame([], result)
    dim, total = size[0]
    own = own.where(F.size("v") == dim)
    taken = own.orderBy(F.xxhash64("id"), "id").limit(sample_rows).select("id", F.col("v").cast("array<double>")).toArrow()
    sample_ids = taken.column(0).to_numpy()
    by_id = np.argsort(sample_ids, kind="stable")
    names, first_of = np.unique(sample_ids[by_id], return_index=True)
    sample = taken.column(1).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    shuffled = sample[np.random.default_rng(2).permutation(len(sample))]
    fitted, kept_out = np.split(shuffled, [max(1, 2 * len(sample) // 3)])
    centres = fit_centres(fitted, int(np.clip(np.sqrt(total), 1, max_lists)))
    probes = lists_to_probe(kept_out, centres, k, aim, least_probes)
    turn = rotation(dim)
    sample_home = nearest_centres(sample, centres, 1)[:, 0]
    in_list = np.bincount(sample_home[by_id][first_of], minlength=len(centres))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row with its list; a query also with the lists it probes and a bound that the sample's vectors in them prove."""
        for batch in batches:
            for lo in range(0, len(batch), 2048):
                part = batch.slice(lo, 2048)
                ids, x = part.column(0).to_numpy(), part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
                home = nearest_centres(x, centres, 1)[:, 0]
                probed, bound = [None] * len(x), np.full(len(x), np.inf)
                asks = np.flatnonzero(part.column(2).to_numpy(zero_copy_only=False))
                if len(asks):
                    order = nearest_centres(x[asks], centres, len(centres))
                    enough = (np.cumsum(in_list[order], 1) <= k).sum(1) + 1  # lists that hold k vectors beside the query's own
                    for i, near, n in zip(asks.tolist(), order, np.clip(enough, probes, len(centres)).tolist(), strict=True):
                        probed[i] = near[:n].tolist()
                        looked = np.zeros(len(centres), bool)
                        looked[near[:n]] = True
                        d = ((sample - x[i]) ** 2).sum(1)
                        d[~looked[sample_home] | (sample_ids == ids[i])] = np.inf
                        d = np.minimum.reduceat(d[by_id], first_of)  # of each id's nearest row
                        bound[i] = np.partition(d, k - 1)[k - 1] if len(d) >= k else np.inf
                raw = pa.array([r.tobytes() for r in x], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), raw, pa.array(home, pa.int32()), pa.array(probed, pa.list_(pa.int32())), pa.array(bound)], ["id", "raw", "list", "probed", "bound"])

    indexed = Spool(spark, "ann").table("index", own.mapInArrow(lean(assign), "id long, raw binary, list int, probed array<int>, bound double"))
    asking = indexed.where("probed is not null").select("id", "raw", "bound", F.explode("probed").alias("list"))
    # rows and queries of a list are split so that no task gets more than ROWS by QUERIES of them; at most max_lists counts come here
    splits = {r.list: [-(-r.n // ROWS), 1] for r in indexed.groupBy("list").agg(F.count("*").alias("n")).collect()}
    for r in asking.groupBy("list").agg(F.count("*").alias("n")).collect():
        splits.setdefault(r.list, [1, 1])[1] = -(-r.n // QUERIES)
    table = F.broadcast(spark.createDataFrame([(a, b, c) for a, (b, c) in splits.items()], "list int, row_parts int, query_parts int"))
    spread = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    rows = indexed.join(table, "list").select("list", spread(F.col("row_parts")).alias("r"), all_of(F.col("query_parts")).alias("q"), "id", "raw")
    asking = asking.join(table, "list").select("list", all_of(F.col("row_parts")).alias("r"), spread(F.col("query_parts")).alias("q"), F.col("id").alias("ask_id"), F.col("raw").alias("ask_raw"), "bound")

    def meet(ask: pa.Table, have: pa.Table) -> pa.Table:
        mats = [np.frombuffer(b"".join(t.column(c).to_pylist()), np.float64).reshape(-1, dim) for t, c in ((ask, "ask_raw"), (have, "raw"))]
        own_ids, ids = ask.column("ask_id").to_numpy(), have.column("id").to_numpy()
        found = adaptive_scan(mats[0], ask.column("bound").to_numpy(), own_ids, mats[1], ids, turn, k) if len(ids) else []
        n = [len(a) for a, _ in found]
        return pa.table({"query_id": np.repeat(own_ids[: len(n)], n), "vec_id": np.concatenate([a for a, _ in found] or [np.empty(0, np.int64)]), "score": np.concatenate([b for _, b in found] or [np.empty(0)])})

    key = ["list", "r", "q"]
    found = asking.groupBy(*key).cogroup(rows.groupBy(*key)).applyInArrow(meet, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    by = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
