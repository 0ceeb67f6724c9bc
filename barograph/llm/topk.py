"""Exact top-k by inner product: branch and bound over vectors in vertical layout.

Candidates are dealt out over cells, each of which keeps its own in blocks that hold one dimension after another; the
queries then pass through every cell. A query adds up its scores a few dimensions at a time; after each step, what the
rest of the dimensions can still add is bounded by the product of the remaining lengths (Cauchy-Schwarz), and candidates
that can't reach the k-th best are compacted away. The k-th best of one block is the floor of the next, and a cell gives
k rows for each query. Each candidate is shuffled once, each query once for every cell, and no score is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barograph.session import shared_dir

K, EVERY, SCALE = 5, 50, 256
#: Vectors in a block of candidates, and candidates in a cell, about: a task holds one cell's at a time.
BLOCK, CELL = 4096, 32_768
#: Dimensions added at a time.
STEP = 8


def quantized(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and v, an array of whole doubles: floor(scale * x). Rows that are null or hold null, NaN or infinity go."""
    v = F.col("embedding")
    sound = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    return vectors.where(v.isNotNull() & sound).select("vec_id", F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double")).alias("v"))


class Block:
    """Candidates of one length, dimension by dimension, with what is left of their lengths after each step."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.columns = ids, np.ascontiguousarray(rows.T)
        dims = len(self.columns)
        squares = np.cumsum((self.columns * self.columns)[::-1], axis=0)[::-1]
        left = [squares[d + STEP] if d + STEP < dims else np.zeros(len(ids)) for d in range(0, max(1, dims), STEP)]
        self.lengths = np.sqrt(np.stack(left))
        self.norms = np.sqrt(squares[0]) if dims else np.zeros(len(ids))


def search(query: np.ndarray, block: Block, k: int, floor: float = -np.inf, among: np.ndarray | None = None, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the k best of a block, or of those at the places ``among``.

    floor: a score that k others are known to reach; candidates below it are of no use.
    """
    dims, n = block.columns.shape
    rest = np.sqrt(np.concatenate([np.cumsum((query * query)[::-1])[::-1], [0.0]]))
    alive = np.arange(n) if among is None else among
    scores = np.zeros(len(alive))
    for j, d in enumerate(range(0, dims, step)):
        part = block.columns[d : d + step] if len(alive) == n else block.columns[d : d + step, alive]
        scores = scores + query[d : d + step] @ part
        if d + step >= dims:
            break
        # a little more than the bound, for the rounding in the lengths
        slack = rest[d + step] * block.lengths[j, alive] * (1 + 1e-9) + 1e-6
        if len(alive) > k:
            floor = max(floor, float(np.partition(scores - slack, len(alive) - k)[len(alive) - k]))
        stay = scores + slack >= floor
        alive, scores = alive[stay], scores[stay]
    best = np.lexsort((block.ids[alive], -scores))[:k]
    return alive[best], scores[best]


def best_of(q_id: int, query: np.ndarray, blocks: list[Block], k: int) -> list[tuple[int, int]]:
    """(score, vec_id) of the k best candidates of other ids in all blocks.

    Scores are sums of whole numbers: exact in doubles below 2^53. The few candidates whose score could be beyond are
    added up as whole numbers of any size.
    """
    best: list[tuple[int, int]] = []
    length = float(np.sqrt(query @ query)) if len(query) else 0.0
    for block in blocks:
        others = block.ids != q_id
        large = others & ~(block.norms * length < 2.0**52)
        plain = others & ~large
        floor = float(best[-1][0]) if len(best) == k else -np.inf
        at, scores = search(query, block, k, floor, None if plain.all() else np.flatnonzero(plain))
        found = [(int(s), int(i)) for s, i in zip(scores.tolist(), block.ids[at].tolist(), strict=True)]
        whole = [int(x) for x in query.tolist()] if large.any() else []
        for i in np.flatnonzero(large).tolist():
            found.append((sum(a * int(b) for a, b in zip(whole, block.columns[:, i].tolist(), strict=True)), int(block.ids[i])))
        best = sorted({*best, *found}, key=lambda x: (-x[0], x[1]))[:k]
    return best


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
    """(cell, kind, dims, ids, vectors) of stretches of rows that have the first three in common."""
    arrays = batch.column("v")
    lengths = np.asarray(arrays.value_lengths()).astype(np.int64)
    values = np.asarray(arrays.flatten(), np.float64)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    cells, kinds, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "kind", "vec_id"))
    change = np.flatnonzero((np.diff(cells) != 0) | (np.diff(kinds) != 0) | (np.diff(lengths) != 0)) + 1
    for a, b in zip([0, *change.tolist()], [*change.tolist(), len(ids)], strict=True):
        if a < b:
            yield int(cells[a]), int(kinds[a]), int(lengths[a]), ids[a:b], values[starts[a] : starts[b]].reshape(b - a, -1)


def _searched(k: int):
    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by cell, candidates before queries, and by length."""
        cell, wait, blocks = None, {}, {}

        def pack(dims: int) -> None:
            ids, rows = (np.concatenate(x) for x in zip(*wait.pop(dims), strict=True))
            blocks.setdefault(dims, []).extend(Block(ids[i : i + BLOCK], rows[i : i + BLOCK]) for i in range(0, len(ids), BLOCK))

        for batch in batches:
            out = []
            for at, kind, dims, ids, rows in _rows(batch):
                if at != cell:
                    cell, wait, blocks = at, {}, {}
                if kind == 0:
                    wait.setdefault(dims, []).append((ids, rows))
                    continue
                if dims in wait:
                    pack(dims)
                for q_id, query in zip(ids.tolist(), rows, strict=True):
                    out += [(q_id, i, s) for s, i in best_of(q_id, query, blocks.get(dims, []), k)]
            columns = list(zip(*out, strict=True)) or [[], [], []]
            # a score beyond a long raises here
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

    return searched


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for every row whose vec_id ``every`` divides, its k best others.

    Vectors that are null or hold null or non-finite components take no part, nor do rows with a null vec_id; vectors
    of another length than the query's are no candidates. Ties go to the smaller vec_id; equal rows of one vec_id, which
    are the query's own or one candidate, count once. Scores must fit a long. No vectors give no rows.
    """
    spark, at = vectors.sparkSession, shared_dir(vectors.sparkSession, "vectors")
    quantized(vectors.where("vec_id is not null"), scale).dropDuplicates(["vec_id", "v"]).write.parquet(at)
    sound = spark.read.parquet(at)
    cells = max(spark.sparkContext.defaultParallelism, -(-sound.count() // CELL))
    named = ["cell", "kind", "dims", "vec_id", "v"]
    dims = F.size("v").alias("dims")
    candidates = sound.select(F.pmod(F.xxhash64("vec_id", "v"), F.lit(cells)).cast("int").alias("cell"), F.lit(0).alias("kind"), dims, "vec_id", "v")
    queries = sound.where(F.col("vec_id") % every == 0).select("vec_id", "v", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell"))
    rows = candidates.unionByName(queries.select("cell", F.lit(1).alias("kind"), dims, "vec_id", "v")).select(*named)
    found = rows.repartition(cells, "cell").sortWithinPartitions("cell", "kind", "dims").mapInArrow(_searched(k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.dropDuplicates(["query_id", "vec_id", "score"]).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
