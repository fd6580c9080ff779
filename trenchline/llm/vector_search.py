"""Exact top-k search by inner product: branch-and-bound over dimension blocks, columnar.

Vectors become whole numbers, floor(scale * x).  Candidates and queries are dealt by a hash of
their id to the rows and columns of a grid, and each of its cells is one group of a task, where
vectors lie in vertical layout (one row of the array per dimension).  A block of candidates is
scored against many queries at once, dimension block by dimension block, each one product of two
matrices.  What the remaining dimensions can add is bounded by the lengths of both remainders
(Cauchy-Schwarz), and pairs whose best case is not above the query's k-th best score of the
blocks before are compacted away, once few are left.  Blocks go in order of id; the first block
of a cell is scored whole and gives the first k-th best scores.  What is left gets exact integer
scores, so the result is exact; equal scores go to the smaller id.  A second step merges the k
best of each cell.

Data moved: candidates once per column of the grid, queries once per row, as they are stored.
Block sizes are parameters, so tasks hold a bounded number of vectors at any input size.

Defined results
* Null vectors, and those holding null or non-finite components, take no part, nor do null ids.
* Only vectors of the query's length are its candidates; rows with the query's id are its own.
* Repeated rows are candidates each; a repeated query row is one query.
* Scores beyond the range of a long are clipped to it.  Empty tables give an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCALE, K = 1024, 10
CANDIDATES, QUERIES = 2048, 1024  # vectors in a block
DIMENSIONS = 16  # accumulated at a time
CELL = (4, 8)  # blocks of candidates, and of queries, that meet in a cell of the grid
TOGETHER = 128  # queries scored together: their sums fit a core's cache
FEW = 64  # once less than one pair of so many is open, the others are compacted away
LONG = np.iinfo(np.int64)
#: Products and sums below these are whole numbers in single and in double precision.
EXACT_SINGLE, EXACT = float(1 << 24), float(1 << 52)
#: Lengths are raised by this part, more than rounding takes; where sums are not exact, also by ten times this part of the whole length.
SLACK = 1e-6


def usable(vector: Column, kind: str) -> Column:
    """Whether all components, of the given type, count; null, which a filter drops as well, for vectors that are or hold null."""
    nan, more, less = (F.array_contains(vector, F.lit(float(x)).cast(kind)) for x in ("nan", "inf", "-inf"))
    return (F.size(vector) > 0) & ~nan & ~more & ~less


def of_length(table: pa.Table, size: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the vectors of one length, and these as whole numbers, a row per dimension; in order of id."""
    chosen = table.filter(pc.equal(pc.list_value_length(table["v"]), size)).sort_by("id").combine_chunks()
    whole = np.multiply(pc.list_flatten(chosen["v"]).to_numpy(), scale, dtype=np.float64)
    return chosen["id"].to_numpy(), np.ascontiguousarray(np.floor(whole, out=whole).reshape(-1, size).T)


def remaining(m: np.ndarray) -> np.ndarray:
    """The length of each vector from every dimension block on, and a last row of none; m has a row per dimension."""
    squares = [np.square(m[i:i + DIMENSIONS]).sum(axis=0) for i in range(0, len(m), DIMENSIONS)]
    lengths = np.sqrt(np.vstack([np.cumsum(squares[::-1], axis=0)[::-1], np.zeros(m.shape[1])]))
    return lengths * (1 + SLACK)


def exact_scores(queries: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The product of each column of `queries` with that of `chosen`, by Python's whole numbers."""
    found = (sum(int(a) * int(b) for a, b in zip(q, c, strict=True)) for q, c in zip(queries.T, chosen.T, strict=True))
    return np.array([min(LONG.max, max(LONG.min, s)) for s in found], np.int64)


def first_pairs(queries: np.ndarray, block: np.ndarray, blur: np.ndarray, own: np.ndarray, k: int):
    """(query, candidate, score) of the pairs of a first block that can be among the query's k best; own: pairs that do not count."""
    sums = queries.T @ block
    sums[own] = -np.inf
    floors = np.full(len(sums), -np.inf, sums.dtype)
    if block.shape[1] > k:
        floors = np.minimum(np.partition(sums - blur, -k, axis=1)[:, -k], LONG.max)
        floors[floors <= LONG.min] = -np.inf  # scores below it are all clipped to it
    pairs = np.flatnonzero(~(sums + blur < floors[:, None]))
    return *np.divmod(pairs, block.shape[1]), sums.ravel()[pairs]


def open_pairs(queries: np.ndarray, block: np.ndarray, mine: np.ndarray, rest: np.ndarray, floors: np.ndarray):
    """(query, candidate, score) of the pairs of a block that can score above the query's floor, by branch-and-bound."""
    sums = np.zeros((queries.shape[1], block.shape[1]), block.dtype)
    starts = range(0, len(block), DIMENSIONS)
    for step, i in enumerate(starts, 1):
        sums += queries[i:i + DIMENSIONS].T @ block[i:i + DIMENSIONS]
        is_open = ~(sums + np.multiply.outer(mine[step], rest[step]) <= floors[:, None])
        if np.count_nonzero(is_open) < is_open.size // FEW:
            break
    pairs = np.flatnonzero(is_open)
    q, c = np.divmod(pairs, block.shape[1])
    sums = sums.ravel()[pairs]
    for step, i in enumerate(starts[step:], step + 1):
        sums = sums + np.einsum("dp,dp->p", queries[i:i + DIMENSIONS, q], block[i:i + DIMENSIONS, c])
        stay = ~(sums + mine[step, q] * rest[step, c] <= floors[q])
        q, c, sums = q[stay], c[stay], sums[stay]
    return q, c, sums


def best_pairs(queries: np.ndarray, q_ids: np.ndarray, columns: np.ndarray, ids: np.ndarray, k: int):
    """(query, candidate, score) of each query's k best candidates, which are in order of id.

    So a later candidate has to score above what a query's k best have, its floor.
    """
    mine, rest = remaining(queries), remaining(columns)
    largest = mine[0].max() * rest[0].max()
    kind = np.float32 if largest < EXACT_SINGLE else np.float64
    if not largest < EXACT:
        mine, rest = (x + 10 * SLACK * x[0] for x in (mine, rest))
    asked, held, mine, rest = (x.astype(kind) for x in (queries, columns, mine, rest))
    best = np.zeros((3, 0), np.int64)
    floors = np.full(len(q_ids), -np.inf, kind)
    for start in range(0, len(ids), CANDIDATES):
        c_part, found = slice(start, start + CANDIDATES), [best]
        block = np.ascontiguousarray(held[:, c_part])
        for first in range(0, len(q_ids), TOGETHER):
            q_part = slice(first, first + TOGETHER)
            if start == 0:
                blur = np.multiply.outer(mine[-1, q_part], rest[-1, c_part])
                q, c, scores = first_pairs(asked[:, q_part], block, blur, q_ids[q_part, None] == ids[c_part], k)
            else:
                q, c, scores = open_pairs(asked[:, q_part], block, mine[:, q_part], rest[:, c_part], floors[q_part])
            others = q_ids[q + first] != ids[c + start]
            q, c, scores = q[others] + first, c[others] + start, scores[others]
            found.append(np.stack([q, c, scores.astype(np.int64) if largest < EXACT else exact_scores(queries[:, q], columns[:, c])]))
        q, c, scores = np.concatenate(found, axis=1)
        order = np.lexsort((c, ~scores, q))  # ~ turns the order, also of the least long
        q, c, scores = q[order], c[order], scores[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        best = np.stack([q, c, scores])[:, rank < k]
        last = rank == k - 1
        floors[q[last]] = np.where(scores[last] < LONG.max, scores[last], np.inf)
    return best


def grid(n: int, m: int) -> tuple[int, int]:
    """Rows and columns of the grid on which n candidates meet m queries."""
    return max(1, -(-n // (CANDIDATES * CELL[0]))), max(1, -(-m // (QUERIES * CELL[1])))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, scale: int = SCALE, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score of each query's k highest inner products."""
    def chosen(df):
        kind = "float" if df.select(vector).dtypes[0][1] == "array<float>" else "double"
        kept = df.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast(f"array<{kind}>").alias("v"))
        return kept.where(F.col("id").isNotNull() & usable(F.col("v"), kind))

    def copied(df, of, cells):
        return df.withColumn(of, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cells - 1).cast("long"))))

    candidates, asked = chosen(vectors), chosen(queries).dropDuplicates(["id"])
    c_cells, q_cells = grid(vectors.count(), queries.count())
    candidates = copied(candidates.withColumn("c", F.pmod(F.xxhash64("id"), F.lit(c_cells))), "q", q_cells)
    asked = copied(asked.withColumn("q", F.pmod(F.xxhash64("id"), F.lit(q_cells))), "c", c_cells)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [(np.zeros(0, np.int64),) * 3]
        if left.num_rows and right.num_rows:
            for size in pc.unique(pc.list_value_length(right["v"])).to_pylist():
                ids, columns = of_length(left, size, scale)
                q_ids, rows = of_length(right, size, scale)
                if len(ids):
                    q, c, scores = best_pairs(rows, q_ids, columns, ids, k)
                    found.append((q_ids[q], ids[c], scores))
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*found, strict=True)), strict=True)))

    met = candidates.groupBy("c", "q").cogroup(asked.groupBy("c", "q")).applyInArrow(meet, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
