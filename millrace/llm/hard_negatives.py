"""Hard negatives from vectors, by a vector-approximation file: bounds looked up in tables decide which rows are scored exactly."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.shared import Stages, give_back

#: Cells of a dimension, with edges at the quantiles of about so many rows, which a hash of the row number chooses.
CELLS = 64
SAMPLE_ROWS = 4096
#: Rows of the file that are looked at together, and anchors whose tables are looked up together.
BLOCK_ROWS = 8192
GROUP = 16
#: Anchors of one pass over the file are sent to all tasks, in about so many bytes.
ANCHOR_BYTES = 2 << 20
#: Scaled components beyond this are held at it, so that scores stay integers of 64 bits.
MOST = 1 << 23
_NONE = np.iinfo(np.int64).min
_FILE = "place long, id long, label long, code binary, vector binary"
_FOUND = "anchor long, window long, score long, id long"


def participants(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(place, id, label, x): the rows that take part, numbered; x holds doubles."""
    rows = vectors.select(F.monotonically_increasing_id().alias("place"), F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("x"))
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return rows.where(F.col("label").isNotNull() & F.col("x").isNotNull() & F.forall("x", finite))


def scaled(x: np.ndarray, scale: float) -> np.ndarray:
    return np.clip(np.floor(x * scale), -MOST, MOST).astype(np.int64)


def _matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    """The lists as rows, filled up with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(lengths), dims))
    row = np.repeat(np.arange(len(lengths)), lengths)
    start = np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(lengths) else lengths
    out[row, np.arange(len(row)) - np.repeat(start, lengths)] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def fit_edges(sample: np.ndarray, cells: int) -> np.ndarray:
    """Per dimension the first value of every cell but the lowest, ascending, filled up with a value that none reaches."""
    edges = np.full((sample.shape[1], cells - 1), MOST + 1, np.int64)
    if len(sample):
        for d, values in enumerate(np.quantile(sample, np.arange(1, cells) / cells, axis=0, method="lower").T):
            own = np.unique(values)
            edges[d, : len(own)] = own
    return edges


def _encode(dims: int, scale: float, edges: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = scaled(_matrix(batch.column(3), dims), scale)
            code = np.empty(v.shape, np.uint8)
            for d in range(dims):
                code[:, d] = np.searchsorted(edges[d], v[:, d], "right")
            stored = [pa.array([x.tobytes() for x in part], pa.binary()) for part in (code, v.astype("<i4"))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), *stored], ["place", "id", "label", "code", "vector"])

    return run


class Block:
    """Rows of the file, ordered by label, with what their cells can hold here."""

    def __init__(self, rows: pa.Table, dims: int, edges: np.ndarray):
        label = rows["label"].to_numpy()
        order = np.argsort(label, kind="stable")
        n = len(order)
        self.label = label[order]
        self.place = rows["place"].to_numpy()[order]
        known = rows["id"].is_valid().to_numpy()[order]
        # ids beside a mark that puts null ids last
        self.id, self.no_id = rows["id"].fill_null(0).to_numpy()[order], ~known
        read = lambda name, kind: np.frombuffer(b"".join(rows[name].to_pylist()), kind).reshape(n, dims)[order]
        self.codes = np.ascontiguousarray(read("code", np.uint8).T)
        self.vectors = read("vector", "<i4")
        least, most = self.vectors.min(0).astype(np.int64)[:, None], self.vectors.max(0).astype(np.int64)[:, None]
        self.low = np.minimum(np.maximum(np.concatenate((least, edges), 1), least), most)
        self.high = np.maximum(np.minimum(np.concatenate((edges - 1, most), 1), most), least)

    def bounds(self, anchors: np.ndarray, rows: slice) -> tuple[np.ndarray, np.ndarray]:
        """Lowest and highest possible scores, rows by anchors: per dimension, a look into a table of cells."""
        codes = self.codes[:, rows]
        lower, upper = (np.zeros((codes.shape[1], len(anchors)), np.int64) for _ in range(2))
        for d, code in enumerate(codes):
            at_low, at_high = self.low[d][:, None] * anchors[:, d], self.high[d][:, None] * anchors[:, d]
            lower += np.take(np.minimum(at_low, at_high), code, axis=0)
            upper += np.take(np.maximum(at_low, at_high), code, axis=0)
        return lower, upper

    def scores(self, rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        return self.vectors[rows].astype(np.int64) @ anchor


@dataclass
class Best:
    """The best `most` rows so far: higher scores first, ties by smaller id, null ids last."""

    most: int
    score: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    id: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    no_id: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))

    def least(self) -> int:
        """A row under this score cannot enter."""
        return int(self.score[-1]) if len(self.score) == self.most else _NONE

    def add(self, score: np.ndarray, ids: np.ndarray, no_id: np.ndarray) -> None:
        score, ids, no_id = (np.concatenate(x) for x in ((self.score, score), (self.id, ids), (self.no_id, no_id)))
        order = np.lexsort((ids, no_id, -score))[: self.most]
        self.score, self.id, self.no_id = score[order], ids[order], no_id[order]


@dataclass
class Anchors:
    """The anchors of one pass, by label; windows: per anchor {positive score: (lowest, highest score of a negative)}."""

    place: np.ndarray
    label: np.ndarray
    vectors: np.ndarray
    windows: list[dict[int, tuple[int, int]]] | None = None


def _kth(values: np.ndarray, k: int) -> int:
    return int(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else _NONE


def _look_for_positives(block: Block, anchors: Anchors, best: dict, most: int) -> None:
    """Same-label rows; one enters only if its upper bound reaches the most-th largest lower bound."""
    for label in np.unique(anchors.label).tolist():
        rows = slice(*np.searchsorted(block.label, [label, label + 1]).tolist())
        if rows.start == rows.stop:
            continue
        own = np.flatnonzero(anchors.label == label)
        for group in np.split(own, range(GROUP, len(own), GROUP)):
            lower, upper = block.bounds(anchors.vectors[group], rows)
            for j, a in enumerate(group.tolist()):
                other = block.place[rows] != anchors.place[a]
                low = lower[:, j][other]
                held = best.setdefault((a, 0), Best(most))
                found = np.flatnonzero(other & (upper[:, j] >= max(held.least(), _kth(low, most)))) + rows.start
                held.add(block.scores(found, anchors.vectors[a]), block.id[found], block.no_id[found])


def _look_for_negatives(block: Block, anchors: Anchors, best: dict, most: int) -> None:
    """Rows of other labels that may lie in a window, and in it reach what the window has already or surely gets here."""
    asked = np.flatnonzero([len(w) > 0 for w in anchors.windows])
    for group in np.split(asked, range(GROUP, len(asked), GROUP)):
        if not len(group):
            continue
        lower, upper = block.bounds(anchors.vectors[group], slice(None))
        for j, a in enumerate(group.tolist()):
            other = block.label != anchors.label[a]
            low, high = lower[:, j], upper[:, j]
            may = np.zeros(len(low), bool)
            for positive, (least, largest) in anchors.windows[a].items():
                held = best.setdefault((a, positive), Best(most))
                sure = low[other & (low >= least) & (high <= largest)]
                may |= (low <= largest) & (high >= max(least, held.least(), _kth(sure, most)))
            rows = np.flatnonzero(may & other)
            score = block.scores(rows, anchors.vectors[a])
            for positive, (least, largest) in anchors.windows[a].items():
                inside = (score >= least) & (score <= largest)
                best[a, positive].add(score[inside], block.id[rows[inside]], block.no_id[rows[inside]])


def _scan(dims: int, edges: np.ndarray, sent, look: Callable, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors: Anchors = sent.value
        best: dict[tuple[int, int], Best] = {}
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= BLOCK_ROWS:
                look(Block(pa.Table.from_batches(held), dims, edges), anchors, best, most)
                held, n = [], 0
        if n:
            look(Block(pa.Table.from_batches(held), dims, edges), anchors, best, most)
        for (a, window), b in best.items():
            k = len(b.score)
            if k:
                columns = [pa.array([int(anchors.place[a])] * k), pa.array([window] * k), pa.array(b.score), pa.array(b.id, mask=b.no_id)]
                yield pa.RecordBatch.from_arrays([c.cast(pa.int64()) for c in columns], ["anchor", "window", "score", "id"])
        give_back()

    return run


def _ranked(found: DataFrame, most: int) -> DataFrame:
    """The best of what the tasks found, with rank."""
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def mine(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    anchors_every: int = 100,
    positives: int = 5,
    negatives: int = 10,
    low_percent: int = 30,
    high_percent: int = 90,
    scale: float = 256.0,
    cells: int = CELLS,
) -> DataFrame:
    """One row per negative: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components count as floor(scale * x), a score is the inner product of two rows.  Anchors are the rows whose id is divisible by
    anchors_every.  An anchor's positives are its best `positives` other rows of the same label.  For each, the best
    `negatives` rows of other labels are returned whose score lies between low_percent and high_percent of the positive's; for a negative
    positive score no row does.  Higher scores come first, ties go by smaller id, null ids last.

    Rows with a null label, a null vector, or a null or non-finite component take no part; null ids are no anchors.  Rows with a repeated id are rows
    of their own, as anchors too.  Vectors that end earlier than the longest go on with zeros, empty ones score 0 with all; scaled
    components beyond MOST are held at it.  An empty table gives no rows.  Other columns are not read.

    The file holds each row's cells beside its vector.  Anchors are the stated query set: a pass sends a bounded number of them to all tasks, which go
    through the file in blocks, keep the best so far per anchor and window, and score exactly only rows whose bounds let them enter.  What tasks send
    on is bounded by anchors, windows and ranks, whatever the size or likeness of the rows.
    """
    spark = vectors.sparkSession
    with Stages(spark, "hard-negatives") as stages:
        rows = participants(vectors, id_col, vector_col, label_col)
        is_anchor = F.col("id") % anchors_every == 0
        n, dims, n_anchors = rows.agg(F.count("*"), F.coalesce(F.max(F.size("x")), F.lit(0)), F.count(F.when(is_anchor, 1))).first()
        dims = max(dims, 1)
        sample = rows.where(F.pmod(F.xxhash64("place"), F.lit(max(1, n // SAMPLE_ROWS))) == 0).select("x").toArrow()["x"].combine_chunks()
        edges = fit_edges(scaled(_matrix(sample, dims), scale), cells)
        file = stages.write(rows.mapInArrow(_encode(dims, scale, edges), _FILE), "file")
        passes = max(1, -(-n_anchors * dims * 4 // ANCHOR_BYTES))
        chosen = stages.write(file.where(is_anchor).select("place", "id", "label", "vector", F.pmod(F.xxhash64("place"), F.lit(passes)).alias("part")), "anchors")
        out = None
        for part in range(passes):
            held = chosen.where(F.col("part") == part).toArrow().sort_by([("label", "ascending"), ("place", "ascending")])
            if not held.num_rows:
                continue
            some = Anchors(held["place"].to_numpy(), held["label"].to_numpy(), np.frombuffer(b"".join(held["vector"].to_pylist()), "<i4").reshape(-1, dims).astype(np.int64))
            sent = spark.sparkContext.broadcast(some)
            near = stages.write(_ranked(stages.write(file.mapInArrow(_scan(dims, edges, sent, _look_for_positives, positives), _FOUND), "near"), positives), "positives")
            sent.unpersist()
            at = {place: k for k, place in enumerate(some.place.tolist())}
            some.windows = [{} for _ in at]
            for anchor, score in near.select("anchor", "score").distinct().collect():  # as many as anchors times positives at most
                least, largest = -(-low_percent * score // 100), high_percent * score // 100
                if least <= largest:
                    some.windows[at[anchor]][score] = (least, largest)
            sent = spark.sparkContext.broadcast(some)
            far = stages.write(_ranked(stages.write(file.mapInArrow(_scan(dims, edges, sent, _look_for_negatives, negatives), _FOUND), "far"), negatives), "negatives")
            sent.unpersist()
            pairs = near.select("anchor", F.col("id").alias("positive_id"), F.col("score").alias("window"))
            names = chosen.where(F.col("part") == part).select(F.col("place").alias("anchor"), F.col("id").alias("anchor_id"))
            found = far.withColumnsRenamed({"id": "negative_id", "score": "negative_score"}).join(pairs, ["anchor", "window"]).join(names, "anchor")
            found = found.select("anchor_id", "positive_id", "rank", "negative_id", F.col("window").alias("positive_score"), "negative_score")
            out = found if out is None else out.unionByName(found)
        if out is None:
            out = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
        return stages.keep(out)
