"""Hard negatives of anchors by bounds along a spanning tree of the anchors.

The score of a row under an anchor is an integer inner product.  Anchors are taken in blocks of a fixed
number; a block's anchors are joined by minimum spanning trees of at most ``TREE`` anchors.  For a batch
of rows each tree is walked from its root.  A row's score at the parent lies in an interval (a point, if
it was scored there); at the child it can differ by at most the length of the edge times the norm of the
row.  Only rows whose interval at the child overlaps the child's window are scored there.

Two passes over all rows for each block of anchors:

1. Positives: the window of an anchor is what beats the worst of its best ``positives`` rows of its own
   label found so far.  Each task keeps that many rows an anchor; Spark takes the best of all tasks.
2. Negatives: the scores of the positives fix the windows, and rows of other labels that fall into an
   anchor's widest window are dealt to those of its positives.  Again each task keeps the best few.

So a row is never copied, and what a task holds and sends depends on the block alone.

Defined results: rows with a null id, label or vector, or a null or non-finite component, take no part;
missing components of a shorter vector count as 0; ``other rows`` of an anchor are those with another
id; repeated rows count each; an anchor without positives, or a positive without negatives in its
window, gives no row; further columns are ignored; an empty table gives an empty result.  Scores are
exact; where norms are so large that a score may need more than 53 bits, the job ends with an error.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casegraph.llm.common import bounded_batches, table
from casegraph.session import cut_lineage, ensure_checkpoint_dir

SCALE = 256
#: Anchors of one block, whose vectors each task holds, and of one spanning tree.
BLOCK = 16_384
TREE = 512
POSITIVES = 5
NEGATIVES = 5
#: A negative scores from this share of the positive's score on, in hundredths.
LEAST = 80
_ROWS = 2048
_EXACT = float(1 << 53)


def quantised(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``id, label, v`` of the rows that take part; ``v`` are whole numbers as doubles."""
    # A double beyond a long would lose its value in floor; such numbers are whole already.
    v = F.transform(
        F.col(vector).cast("array<double>"),
        lambda x: F.when(F.abs(x) < 2.0**50, F.floor(F.lit(float(SCALE)) * x).cast("double")).otherwise(F.lit(float(SCALE)) * x),
    )
    whole = F.forall(F.col(vector).cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(
        F.col(vec_id).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & whole
    ).select(
        F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), v.alias("v")
    )


def spanning_tree(points: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Order of a minimum spanning tree from point 0 on, and parent and edge length of each point."""
    n = len(points)
    parent, edge = np.zeros(n, np.int64), np.full(n, np.inf)
    order, rest = [], np.ones(n, bool)
    at = 0
    while True:
        order.append(at)
        rest[at] = False
        if not rest.any():
            edge[0] = 0.0
            return order, parent, edge
        left = np.flatnonzero(rest)
        length = np.sqrt(((points[left] - points[at]) ** 2).sum(axis=1))
        nearer = length < edge[left]
        parent[left[nearer]] = at
        edge[left[nearer]] = length[nearer]
        at = int(left[np.argmin(edge[left])])


class Forest:
    """A block of anchors in spanning trees."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        # Anchors of one label, and among these of one direction, come together, so that edges are short.
        code = ((vectors[:, :8] > 0) * (1 << np.arange(min(8, vectors.shape[1])))).sum(axis=1)
        order = np.lexsort((ids, code, labels))
        self.ids, self.labels, self.vectors = ids[order], labels[order], vectors[order]
        self.norms = np.sqrt((self.vectors**2).sum(axis=1))
        self.trees = []
        for a in range(0, len(ids), TREE):
            walk, parent, edge = spanning_tree(self.vectors[a : a + TREE])
            self.trees.append([(a + i, a + int(parent[i]), float(edge[i])) for i in walk])

    def visit(self, rows: np.ndarray, norms: np.ndarray, wanted) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each anchor the rows that ``wanted(anchor, low, high)`` marks by their bounds, with their scores."""
        for tree in self.trees:
            low, high = {}, {}
            waiting = np.bincount([p for _, p, _ in tree[1:]], minlength=1) if len(tree) > 1 else np.zeros(1, np.int64)
            waiting = dict(enumerate(waiting.tolist()))
            for anchor, parent, edge in tree:
                if anchor == parent:
                    reach = self.norms[anchor] * norms
                    a, b = -reach, reach
                else:
                    # Rounding of edges, norms and sums stays far below this slack.
                    reach = edge * norms * (1 + 1e-9) + 1e-6
                    a, b = low[parent] - reach, high[parent] + reach
                    waiting[parent] -= 1
                    if not waiting[parent]:
                        del low[parent], high[parent]
                near = np.flatnonzero(wanted(anchor, a, b))
                scores = exact_scores(rows[near], self.vectors[anchor], norms[near] * self.norms[anchor])
                if waiting.get(anchor):
                    a[near] = b[near] = scores
                    low[anchor], high[anchor] = a, b
                yield anchor, near, scores


def exact_scores(rows: np.ndarray, anchor: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Integer inner products; a sum of doubles is exact as long as the norms' product fits 53 bits."""
    if len(bound) and bound.max() >= _EXACT:
        raise ValueError("components are too large for exact scores; scale the vectors")
    return rows @ anchor


def _batches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, labels, vectors and norms of some rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            part = batch.slice(at, _ROWS)
            lists = part.column("v")
            sizes = lists.value_lengths().to_numpy()
            rows = np.zeros((part.num_rows, width))
            rows[np.arange(width) < sizes[:, None]] = lists.flatten().to_numpy()
            norms = np.sqrt((rows**2).sum(axis=1))
            yield part.column("id").to_numpy(), part.column("label").to_numpy(), rows, norms


def best(scores: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Places of the ``n`` highest scores, ties by smaller id."""
    if len(scores) > 4 * n:
        least = np.partition(scores, len(scores) - n)[len(scores) - n]
        some = np.flatnonzero(scores >= least)
        return some[np.lexsort((ids[some], -scores[some]))[:n]]
    return np.lexsort((ids, -scores))[:n]


class _Tops:
    """The best rows of each slot seen by one task."""

    def __init__(self, n: int):
        self.n, self.found = n, {}

    def add(self, slot, scores: np.ndarray, ids: np.ndarray) -> None:
        if slot in self.found:
            scores, ids = np.r_[self.found[slot][0], scores], np.r_[self.found[slot][1], ids]
        kept = best(scores, ids, self.n)
        self.found[slot] = scores[kept], ids[kept]

    def least(self, slot) -> float:
        """A score that a further row must reach to be among the best."""
        scores = self.found.get(slot, ((),))[0]
        return scores[-1] if len(scores) == self.n else -np.inf


def _positives(rows: DataFrame, forest: Forest, width: int, n: int) -> DataFrame:
    """``slot, id, score``: for each anchor the best rows of its label with another id, of each task."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops = _Tops(n)
        for ids, labels, vectors, norms in _batches(batches, width):
            same = {int(x): labels == x for x in np.unique(labels)}
            none = np.zeros(len(ids), bool)

            def wanted(anchor: int, low: np.ndarray, high: np.ndarray, same=same, none=none, ids=ids) -> np.ndarray:
                return same.get(int(forest.labels[anchor]), none) & (ids != forest.ids[anchor]) & (high >= tops.least(anchor))

            for anchor, near, scores in forest.visit(vectors, norms, wanted):
                if len(near):
                    tops.add(anchor, scores, ids[near])
        slots = [s for s, (scores, _) in tops.found.items() for _ in scores]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(slots, pa.int32()),
                pa.array([i for _, ids in tops.found.values() for i in ids.tolist()], pa.int64()),
                pa.array([int(s) for scores, _ in tops.found.values() for s in scores.tolist()], pa.int64()),
            ],
            ["slot", "id", "score"],
        )

    return rows.mapInArrow(found, "slot int, id long, score long")


def _negatives(rows: DataFrame, forest: Forest, width: int, positives: list[np.ndarray], n: int, least: int) -> DataFrame:
    """``slot, which, id, score``: for each positive of an anchor (by place) the best rows within its window, of each task."""

    def window(score: float) -> tuple[float, float]:
        # 80 p <= 100 s <= 100 p for whole s; an empty window if p is negative.
        return float(-((-least * int(score)) // 100)), score

    windows = [[window(s) for s in scores.tolist()] for scores in positives]
    lows = np.array([min((a for a, _ in w), default=np.inf) for w in windows])
    highs = np.array([max((b for _, b in w), default=-np.inf) for w in windows])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops = _Tops(n)
        for ids, labels, vectors, norms in _batches(batches, width):
            other = {int(x): labels != x for x in np.unique(labels)}
            every = np.ones(len(ids), bool)

            def wanted(anchor: int, low: np.ndarray, high: np.ndarray, other=other, every=every) -> np.ndarray:
                return other.get(int(forest.labels[anchor]), every) & (high >= lows[anchor]) & (low <= highs[anchor])

            for anchor, near, scores in forest.visit(vectors, norms, wanted):
                for which, (a, b) in enumerate(windows[anchor]):
                    inside = (scores >= max(a, tops.least((anchor, which)))) & (scores <= b)
                    if inside.any():
                        tops.add((anchor, which), scores[inside], ids[near[inside]])
        slots = [s for s, (scores, _) in tops.found.items() for _ in scores]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([s for s, _ in slots], pa.int32()),
                pa.array([w for _, w in slots], pa.int32()),
                pa.array([i for _, ids in tops.found.values() for i in ids.tolist()], pa.int64()),
                pa.array([int(s) for scores, _ in tops.found.values() for s in scores.tolist()], pa.int64()),
            ],
            ["slot", "which", "id", "score"],
        )

    return rows.mapInArrow(found, "slot int, which int, id long, score long")


def _ranked(found: DataFrame, slot: list[str], n: int) -> DataFrame:
    """The best of what the tasks found, numbered from 1; a slot has ``n`` rows of each task at most."""
    place = F.row_number().over(Window.partitionBy(*slot).orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", place).where(F.col("rank") <= n)


def hard_negatives(
    rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` from rows ``id, label, v``.

    The driver holds the vectors of one block of anchors and the scores of their positives, never more.
    """
    spark = rows.sparkSession
    bounded_batches(spark)
    ensure_checkpoint_dir(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(_ROWS))
    anchors = cut_lineage(rows.where(is_anchor))
    count = anchors.count()
    width = rows.agg(F.max(F.size("v"))).first()[0] or 0
    blocks = -(-count // BLOCK)
    block = F.pmod(F.xxhash64("id", F.lit("block")), F.lit(max(1, blocks)))
    path = f"{spark.sparkContext.getCheckpointDir()}/negatives-{uuid.uuid4().hex}"
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark.createDataFrame([], schema).write.parquet(path)
    for k in range(blocks):
        own = anchors.where(block == k).toPandas()
        if own.empty:
            continue
        vectors = np.zeros((len(own), width))
        for i, v in enumerate(own["v"]):
            vectors[i, : len(v)] = v
        forest = Forest(own["id"].to_numpy(np.int64), own["label"].to_numpy(np.int64), vectors)
        best_ones = _ranked(_positives(rows, forest, width, positives), ["slot"], positives).toPandas()
        scores: list[np.ndarray] = [np.zeros(0)] * len(own)
        for slot, part in best_ones.sort_values("rank").groupby("slot"):
            scores[slot] = part["score"].to_numpy(np.float64)
        found = _ranked(_negatives(rows, forest, width, scores, negatives, least), ["slot", "which"], negatives)
        ids = [(s, int(forest.ids[s]), r - 1, p, x) for s, r, p, x in best_ones[["slot", "rank", "id", "score"]].itertuples(index=False)]
        named = spark.createDataFrame(ids, "slot int, anchor_id long, which int, positive_id long, positive_score long")
        found.join(F.broadcast(named), ["slot", "which"]).select(
            "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
            "positive_score", F.col("score").alias("negative_score"),
        ).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quantised(table(spark, sf_dir, "embeddings"))
    label = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", label), F.col("id") % 100 == 0)


ORACLE = """
WITH rows AS (
  SELECT CAST(vec_id AS BIGINT) AS id,
    CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.id AS anchor_id, a.label AS anchor_label, r.id AS id, r.label AS label,
    CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
  FROM rows a JOIN rows r ON r.id <> a.id WHERE a.id % 100 = 0),
positives AS (
  SELECT anchor_id, anchor_label, id AS positive_id, score AS positive_score FROM scores WHERE label = anchor_label
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank,
  s.id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id AND s.label <> p.anchor_label
  AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) <= 5
"""
