"""Approximate nearest neighbours with a hash-prefix forest.

Each of ``TREES`` trees gives every vector a hash string: its characters are
those of cross-polytope hashes, the strongest of ``DIMS`` random projections and its
sign. A tree is the vectors sorted by hash string, kept as blocks: all of a block
have the same first character, and a crowded first character is dealt over
several blocks. A query descends each tree to its longest matching prefix; then
all trees ascend together, a character at a time, until the vectors that share
at least that prefix in some tree are as many as asked for. Those candidates are
scored exactly.

First pass: each tree counts, for each query, the vectors at every prefix
length. The sum over the trees says at which length the query stops. Second pass:
the trees score what lies at that length or deeper, and each block's best go on.
A query whose trees have too few even at the first character goes to every block
of one tree, so that it sees all rows.

How many candidates are asked for is measured, not set: the true neighbours of
``SAMPLE`` queries are found among all rows, and the least number stands with
which those queries would find ``TARGET`` of them. Vectors with structure need few,
whatever the rows; vectors without any need a share of all rows, and get it.

Vectors are compared by inner product; where lengths differ they are hashed with
one more coordinate that makes all equally long, which turns the largest inner
product into the nearest direction. Vectors of another dimension are compared
among themselves. Of rows with equal vectors only the smallest ``KEEP`` + 1 ids can
ever be among the nearest, so no more of them are indexed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

KEEP = 20
QUERY_EVERY = 20
TREES = 14
DIMS = 8
DEPTH = 8
SEED = 42
#: Vectors of one block at most, about.
BLOCK_ROWS = 8_192
#: Queries whose true neighbours are found to set the candidates asked for, the share of them to be found, and the least to ask for (a vector may count once a tree).
SAMPLE, TARGET, LEAST = 96, 0.93, TREES * (KEEP + 4)
#: Scores this near, relatively, are worked out again in one fixed order of summing.
NEARLY = 1e-9


def usable(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, v) of rows that take part: id and vector not null, all components finite numbers, not all of them zero; in double precision."""
    v = F.col(vector).cast("array<double>")
    df = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter("id is not null and v is not null")
    return df.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))


def projections(size: int) -> np.ndarray:
    """(trees, depth, dims, size) random directions; the last coordinate is the one added."""
    return np.random.default_rng(SEED).normal(size=(TREES, DEPTH, DIMS, size)).astype(np.float64)


def hash_strings(v: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """(rows, trees) hash strings as numbers, a character in each 4 bits, the first character highest."""
    found = np.zeros((len(v), len(planes)), np.uint64)
    rows = np.arange(len(v))
    for t, tree in enumerate(planes):
        for directions in tree:
            y = v @ directions.T
            best = np.abs(y).argmax(axis=1)
            found[:, t] = found[:, t] << np.uint64(4) | (2 * best + (y[rows, best] > 0)).astype(np.uint64)
    return found


def by_dimension(lists: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, vectors) of each dimension among the vectors of a batch."""
    sizes = np.diff(lists.offsets.to_numpy())
    flat, starts = lists.values.to_numpy(), lists.offsets.to_numpy()[:-1]
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        yield rows, flat[starts[rows][:, None] + np.arange(size)]


def codes(v: np.ndarray, asks: np.ndarray, longest: float, planes: np.ndarray) -> np.ndarray:
    """(rows, trees) hash strings of vectors; queries get 0 as the added coordinate."""
    lift = np.where(asks, 0.0, np.sqrt(np.maximum(0.0, longest - (v * v).sum(axis=1))))
    return hash_strings(np.hstack([v, lift[:, None]]), planes)


def _hashed(longest: float):
    """Rows (id, v, is_query) to one row a tree: (dim, tree, first, code, id, v, asks)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            every_id, every_ask = b.column(0).to_numpy(), b.column(2).to_numpy(zero_copy_only=False)
            for rows, v in by_dimension(b.column(1)):
                dim = v.shape[1]
                if dim not in planes:
                    planes[dim] = projections(dim + 1)
                ids, asks = every_id[rows], every_ask[rows]
                code = codes(v, asks, longest, planes[dim]).T.reshape(-1)
                tree = np.repeat(np.arange(TREES), len(ids))
                again = pa.array(np.tile(rows, TREES))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(tree), dim)), pa.array(tree), pa.array((code >> np.uint64(28)).astype(np.int64)), pa.array(code.astype(np.int64)), pa.array(np.tile(ids, TREES)), b.column(1).take(again), pa.array(np.tile(asks, TREES))],
                    ["dim", "tree", "first", "code", "id", "v", "asks"],
                )

    return run


def _counts(key, tree: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
    """Of each query the vectors of this block that share 1, 2, ... characters at least: a binary search in the sorted strings for each."""
    codes = np.sort(tree["code"].to_numpy(np.int64))
    rows = []
    if len(codes) and len(asked):
        code = asked["code"].to_numpy(np.int64)
        counts = np.empty((len(code), DEPTH), np.int64)
        for n in range(1, DEPTH + 1):
            width = 4 * (DEPTH - n)
            low = code >> width << width
            counts[:, n - 1] = np.searchsorted(codes, low + (1 << width)) - np.searchsorted(codes, low)
        rows = [{"query_id": q, "counts": c.tolist()} for q, c in zip(asked["id"].tolist(), counts, strict=True)]
    return pd.DataFrame(rows, columns=["query_id", "counts"])


def _top(v: np.ndarray, ids: np.ndarray, q: int, x: np.ndarray) -> list[tuple[float, int]]:
    """(score, id) of the KEEP nearest to x but for the query's own row, ties to the smaller id."""
    score = np.where(ids == q, -np.inf, v @ x)
    most = min(KEEP, len(score))
    limit = np.partition(score, len(score) - most)[len(score) - most]
    near = np.flatnonzero(score >= limit - NEARLY * max(1.0, abs(limit))) if np.isfinite(limit) else np.flatnonzero(np.isfinite(score))
    # A matrix product may round by a row's place; this sum does not, so equal vectors have equal scores.
    exact = (v[near] * x).sum(axis=1)
    order = np.lexsort((ids[near], -exact))[:KEEP]
    return [(float(exact[k]), int(ids[near[k]])) for k in order if ids[near[k]] != q]


def _best(key, tree: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
    """The KEEP nearest of each query in this block among those that share as many characters as it stops at."""
    out = []
    if len(tree) and len(asked):
        tree = tree.sort_values(["code", "id"], kind="stable")
        codes, ids = tree["code"].to_numpy(np.int64), tree["id"].to_numpy(np.int64)
        v = np.stack(tree["v"].to_numpy())
        for q, code, depth, x in zip(asked["id"].tolist(), asked["code"].tolist(), asked["depth"].tolist(), asked["v"], strict=True):
            width = 4 * (DEPTH - max(depth, 1))
            low = code >> width << width
            a, b = (0, len(codes)) if depth == 0 else (np.searchsorted(codes, low), np.searchsorted(codes, low + (1 << width)))
            if a == b:
                continue
            out += [(q, i, s) for s, i in _top(v[a:b], ids[a:b], q, np.asarray(x))]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})


def candidates_needed(indexed: DataFrame, asked: DataFrame, longest: float) -> int:
    """How many candidates queries have to ask for, so that those of a sample find TARGET of their true neighbours.

    The sample's queries are scored against all rows, block by block; SAMPLE * KEEP neighbours reach the driver.
    """
    rows = asked.orderBy(F.xxhash64("id")).limit(SAMPLE).collect()
    if not rows:
        return LEAST
    sample = [(r.id, np.array(r.v)) for r in rows]

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple[float, int]]] = {q: [] for q, _ in sample}
        for b in batches:
            if b.num_rows:
                for at, v in by_dimension(b.column(1)):
                    ids = b.column(0).to_numpy()[at]
                    for q, x in sample:
                        if len(x) == v.shape[1]:
                            best[q] = sorted([*best[q], *_top(v, ids, q, x)], key=lambda t: (-t[0], t[1]))[:KEEP]
        flat = [(q, i, s) for q, found in best.items() for s, i in found]
        if flat:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*flat, strict=True)], ["q", "id", "score"])

    nth = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))
    true = indexed.mapInArrow(near, "q long, id long, score double").withColumn("n", nth).filter(F.col("n") <= KEEP).select("q", "id")  # KEEP rows a query and task
    true = indexed.join(F.broadcast(true), "id").select("q", "v").collect()  # SAMPLE * KEEP rows at most

    def code(v: np.ndarray, ask: bool) -> np.ndarray:
        return codes(v[None, :], np.array([ask]), longest, projections(len(v) + 1))[0]

    asks = {q: code(x, True) for q, x in sample}
    counts = indexed.mapInArrow(_prefix_counts(asks, {q: len(x) for q, x in sample}, longest), "q long, depth int, n long").groupBy("q", "depth").agg(F.sum("n").alias("n")).collect()
    at = {(r.q, r.depth): r.n for r in counts}
    found = []  # of each true neighbour its query's counts and the longest prefix that it shares with it in a tree
    for r in true:
        found.append(([at.get((r.q, d), 0) for d in range(DEPTH + 1)], int(shared(code(np.array(r.v), False), asks[r.q]).max())))
    wanted = LEAST
    while found:
        stops = [next((d for d in range(DEPTH, 0, -1) if n[d] >= wanted), 0) for n, _ in found]
        if sum(d >= stop for stop, (_, d) in zip(stops, found, strict=True)) >= TARGET * len(found) or not any(stops):
            break
        wanted *= 2
    return wanted


def shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many leading characters of hash strings are alike."""
    apart = (a ^ b).astype(np.float64)
    return DEPTH - (np.frexp(apart)[1] + 3) // 4


def _prefix_counts(asks: dict[int, np.ndarray], dims: dict[int, int], longest: float):
    """Of each sampled query the vectors of a batch that share so many characters at least, summed over the trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {q: np.zeros(DEPTH + 1, np.int64) for q in asks}
        for b in batches:
            if b.num_rows:
                for _, v in by_dimension(b.column(1)):
                    code = codes(v, np.zeros(len(v), bool), longest, projections(v.shape[1] + 1))
                    for q, own in asks.items():
                        if dims[q] == v.shape[1]:
                            total[q] += np.bincount(shared(code, own).reshape(-1), minlength=DEPTH + 1)[::-1].cumsum()[::-1]
        flat = [(q, d, int(n)) for q, t in total.items() for d, n in enumerate(t)]
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in flat], pa.int64()), pa.array([f[1] for f in flat], pa.int32()), pa.array([f[2] for f in flat], pa.int64())], ["q", "depth", "n"])

    return run


def nearest(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", every: int = QUERY_EVERY) -> DataFrame:
    """(query_id, rank, vec_id, score): the KEEP nearest found of each row whose id is divisible by ``every``.

    Nearest first, ties to the smaller id, a query's own row left out; with no more than KEEP other rows all are returned.
    Rows with a null id, null or zero vectors, or null or non-finite components take no part; queries find vectors of
    their own dimension. Of rows with the same id the one with the least vector takes part. An empty table, or one without
    queries, gives an empty result.
    """
    v = cut(usable(vectors, id_col, vector).groupBy("id").agg(F.min("v").alias("v")))
    # Equal vectors: the smallest KEEP + 1 ids, dealt by a salt first so that no task gets all copies.
    salted = Window.partitionBy("__h", "__salt").orderBy("id")
    alike = Window.partitionBy("__h").orderBy("id")
    hashed = v.withColumns({"__h": F.sha2(F.array_join(F.transform("v", lambda x: x.cast("string")), ","), 256), "__salt": F.pmod("id", F.lit(64))})
    few = hashed.withColumn("__n", F.row_number().over(salted)).filter(F.col("__n") <= KEEP + 1).withColumn("__n", F.row_number().over(alike)).filter(F.col("__n") <= KEEP + 1)
    indexed = few.select("id", "v", F.lit(False).alias("asks"))
    asked = v.filter(F.pmod("id", F.lit(every)) == 0).select("id", "v", F.lit(True).alias("asks"))
    size = v.agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("longest")).first()
    indexed = cut(indexed)
    wanted = candidates_needed(indexed.select("id", "v"), asked.select("id", "v"), size.longest or 0.0)

    forest = cut(indexed.unionByName(asked).mapInArrow(_hashed(size.longest or 0.0), "dim long, tree long, first long, code long, id long, v array<double>, asks boolean"))
    crowd = forest.filter("not asks").groupBy("dim", "tree", "first").count()  # at most TREES * 2 * DIMS rows a dimension
    blocks = F.broadcast(crowd.select("dim", "tree", "first", F.ceil(F.col("count") / BLOCK_ROWS).cast("int").alias("blocks")))
    trees = forest.filter("not asks").join(blocks, ["dim", "tree", "first"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).drop("blocks", "asks")
    questions = forest.filter("asks").select(*[F.col(c).alias(c) for c in ("dim", "tree", "first", "code", "id", "v")])
    every_block = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")

    key = ["dim", "tree", "first", "block"]
    at_own = questions.join(blocks, ["dim", "tree", "first"]).select("dim", "tree", "first", every_block, "code", "id")
    counts = trees.select(*key, "code").groupBy(*key).cogroup(at_own.groupBy(*key)).applyInPandas(_counts, "query_id long, counts array<long>")
    totals = counts.select("query_id", *[F.col("counts")[n].alias(f"c{n + 1}") for n in range(DEPTH)]).groupBy("query_id").agg(*[F.sum(f"c{n}").alias(f"c{n}") for n in range(1, DEPTH + 1)])
    stop = F.coalesce(*[F.when(F.col(f"c{n}") >= wanted, F.lit(n)) for n in range(DEPTH, 0, -1)], F.lit(0))
    depth = totals.select(F.col("query_id").alias("id"), stop.alias("depth"))
    deep = questions.join(depth, "id", "left").withColumn("depth", F.coalesce("depth", F.lit(0)))
    # Trees that stop at a character: the query's own first character. At the root: every block of the first tree.
    inside = deep.filter("depth > 0").join(blocks, ["dim", "tree", "first"]).select("dim", "tree", "first", every_block, "code", "id", "v", "depth")
    root = deep.filter("depth = 0 and tree = 0").drop("first").join(blocks, ["dim", "tree"]).select("dim", "tree", "first", every_block, "code", "id", "v", "depth")
    routed = inside.unionByName(root)
    best = trees.groupBy(*key).cogroup(routed.groupBy(*key)).applyInPandas(_best, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    # A vector found by several trees has the same score in each.
    found = best.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= KEEP).select("query_id", "rank", "vec_id", "score")
