"""Files of token ids, compressed by Re-Pair grammars block by block, with random access to documents."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.packing import CachedTokenizer, tokenizer_at
from millrace.llm.shared import JOB_SETTINGS, Stages, give_back, settings, text_bytes

END_ID = 1
#: A block closes with the document in which it reaches so many ids; only longer documents are cut over blocks.
BLOCK_IDS = 1 << 19
#: A pair gets a rule if it stands in a block so often.
LEAST_COUNT = 8
#: Rounds end once one shortens a block by less than this share.
LEAST_GAIN = 0.01
#: Pairs looked at in a round, from the most frequent on.
ROUND_PAIRS = 8192
#: Texts tokenised together have about so many bytes.
BATCH_BYTES = 8 << 20
#: Slots in which a round's pairs are found.
SLOTS = 1 << 16
#: Few blocks at a time between Spark and Python, and in Parquet's reader.
READ_SETTINGS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "8", "spark.sql.parquet.columnarReaderBatchSize": "16"}

#: A file's row is a block.  part and block order it, start counts the part's ids before it, skipped the ids of its first document in blocks before, open_end
#: says that its last document goes on in the next one.  doc_ends are places in the block.  terminals, rules (pairs) and expansion lengths are
#: 32-bit numbers, symbols 16- or 32-bit ones by `width`: terminal k or, from their count on, rule k.
BLOCK_SCHEMA = (
    "part int, block long, start long, n_ids long, skipped long, open_end boolean, doc_ids array<long>, doc_ends array<long>, "
    "terminals binary, rules binary, lengths binary, symbols binary, width int"
)
_BLOCK_TYPES = [
    ("part", pa.int32()), ("block", pa.int64()), ("start", pa.int64()), ("n_ids", pa.int64()), ("skipped", pa.int64()), ("open_end", pa.bool_()), ("doc_ids", pa.list_(pa.int64())),
    ("doc_ends", pa.list_(pa.int64())), ("terminals", pa.binary()), ("rules", pa.binary()), ("lengths", pa.binary()), ("symbols", pa.binary()), ("width", pa.int32()),
]


class Grammar:
    """Ids as a sequence of symbols: those under len(terminals) stand for an id, the others for a rule, a pair of earlier symbols."""

    def __init__(self, terminals: np.ndarray, rules: np.ndarray, lengths: np.ndarray, symbols: np.ndarray):
        self.terminals, self.rules, self.lengths, self.symbols = terminals, rules, lengths, symbols
        self.sizes = np.concatenate((np.ones(len(terminals), np.int64), lengths.astype(np.int64)))
        self._table: tuple[np.ndarray, np.ndarray] | None = None
        self._ends: np.ndarray | None = None

    def _flat(self) -> tuple[np.ndarray, np.ndarray]:
        """All symbols' expansions behind each other, as ranks of terminals, and where each begins; rules are replaced pass by pass."""
        if self._table is None:
            n = len(self.terminals)
            symbols = np.arange(n + len(self.rules))
            while (rule := symbols >= n).any():
                at = np.arange(len(symbols)) + np.cumsum(rule) - rule
                wide = np.empty(len(symbols) + int(rule.sum()), np.int64)
                wide[at[~rule]] = symbols[~rule]
                pairs = self.rules[symbols[rule] - n]
                wide[at[rule]], wide[at[rule] + 1] = pairs[:, 0], pairs[:, 1]
                symbols = wide
            self._table = self.terminals[symbols], np.cumsum(self.sizes) - self.sizes
        return self._table

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """The ids of symbols."""
        flat, begin = self._flat()
        size = self.sizes[symbols]
        stop = np.cumsum(size)
        if not len(stop):
            return flat[:0]
        return flat[np.arange(stop[-1]) + np.repeat(begin[symbols] - stop + size, size)]

    def ids(self) -> np.ndarray:
        return self.expand(self.symbols)

    def span(self, start: int, stop: int) -> np.ndarray:
        """The ids from start to stop: expansion lengths tell which symbols hold them, and only these are expanded."""
        if self._ends is None:
            self._ends = np.cumsum(self.sizes[self.symbols])
        if stop <= start:
            return self.terminals[:0]
        first, last = np.searchsorted(self._ends, [start, stop - 1], "right").tolist()
        before = int(self._ends[first - 1]) if first else 0
        return self.expand(self.symbols[first : last + 1])[start - before : stop - before]


def _slot(keys: np.ndarray) -> np.ndarray:
    """A slot under SLOTS for every key."""
    return ((keys * keys.dtype.type(0x9E3779B1)) >> keys.dtype.type(keys.dtype.itemsize * 8 - 16 if keys.dtype.itemsize == 4 else 16)).astype(np.int64) & (SLOTS - 1)


def _chosen(pairs: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Pairs taken in order, none of which ends with the symbol that another begins with, so that their places cannot overlap; a pair of twins overlaps itself alone."""
    left: set[int] = set()
    right: set[int] = set()
    out = []
    for a, b in pairs.tolist():
        if a in right or b in left or a == b and a in left:
            continue
        left.add(a)
        right.add(b)
        out.append((a, b))
        if len(out) == most:
            break
    return out


def compress(ids: np.ndarray, least_count: int = LEAST_COUNT, least_gain: float = LEAST_GAIN) -> Grammar:
    """Re-Pair in rounds: the most frequent pairs that cannot overlap are replaced together, each by a new symbol, as long as it pays."""
    terminals = np.unique(ids)
    if len(terminals) and terminals[-1] < 1 << 22:
        rank = np.zeros(int(terminals[-1]) + 1, np.uint32)
        rank[terminals] = np.arange(len(terminals), dtype=np.uint32)
        seq = rank[ids]
    else:
        seq = np.searchsorted(terminals, ids).astype(np.uint32)
    rules: list[tuple[int, int]] = []
    n = len(terminals)
    while len(seq) > 1:
        count = n + len(rules)
        # symbols under 2^16 make 32-bit keys, which sort several times faster; rules stop at that bound while terminals lie under it
        narrow = n < 1 << 15
        shift, kind = (16, np.uint32) if narrow else (32, np.uint64)
        room = (1 << 16) - count if narrow else (1 << 32) - count
        if room <= 0:
            break
        keys = (seq[:-1].astype(kind) << kind(shift)) | seq[1:].astype(kind)
        ordered = np.sort(keys)
        first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
        times = np.diff(np.append(first, len(ordered)))
        often = np.flatnonzero(times >= least_count)
        if len(often) > ROUND_PAIRS:
            often = often[np.argpartition(times[often], -ROUND_PAIRS)[-ROUND_PAIRS:]]
        often = often[np.lexsort((ordered[first[often]], -times[often]))]
        found = ordered[first[often]]
        pairs = _chosen(np.column_stack((found >> kind(shift), found & kind((1 << shift) - 1))), min(room, ROUND_PAIRS))
        if not pairs:
            break
        chosen = np.array([(a << shift) | b for a, b in pairs], kind)
        # pairs meet in a table of slots; of two in one slot the later waits for the next round
        slots = _slot(chosen)
        table = np.full(SLOTS, -1, np.int32)
        table[slots[::-1]] = np.arange(len(chosen) - 1, -1, -1)
        taken = np.flatnonzero(table[slots] == np.arange(len(chosen)))
        pairs, chosen = [pairs[k] for k in taken.tolist()], chosen[taken]
        table[slots[taken]] = np.arange(len(taken))
        is_left = np.zeros(count, bool)
        is_left[[a for a, _ in pairs]] = True
        at = np.flatnonzero(is_left[seq[:-1]])
        near = keys[at]
        symbol = table[_slot(near)]
        met = (symbol >= 0) & (chosen[symbol] == near)
        at, symbol = at[met], symbol[met]
        # in a run of twins every other place is taken
        fresh = np.append(True, np.diff(at) > 1) if len(at) else np.zeros(0, bool)
        index = np.arange(len(at))
        even = (index - np.maximum.accumulate(np.where(fresh, index, 0))) % 2 == 0
        at, symbol = at[even], symbol[even]
        seq[at] = count + symbol
        kept = np.ones(len(seq), bool)
        kept[at + 1] = False
        gain = len(at) / len(seq)
        seq = seq[kept]
        rules += pairs
        if gain < least_gain:
            break
    lengths = np.ones(n + len(rules), np.uint32)
    for k, (a, b) in enumerate(rules):
        lengths[n + k] = lengths[a] + lengths[b]
    return Grammar(terminals.astype(np.uint32), np.array(rules, np.uint32).reshape(-1, 2), lengths[n:], seq)


def _documents(batches: Iterator[pa.RecordBatch], tokenizer: CachedTokenizer, end: np.ndarray) -> Iterator[tuple[int | None, np.ndarray]]:
    """Document ids with their token ids, texts of about BATCH_BYTES looked up together."""
    held, size = [], 0

    def made() -> Iterator[tuple[int | None, np.ndarray]]:
        together = pa.Table.from_batches(held).combine_chunks()
        ids, counts = tokenizer.encode_many(together.column(1).chunk(0))
        stops = np.cumsum(counts).tolist()
        for key, a, b in zip(together.column(0).to_pylist(), [0, *stops], stops, strict=False):
            yield key, np.concatenate((ids[a:b], end))

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.column(1).nbytes
        if size >= BATCH_BYTES:
            yield from made()
            held, size = [], 0
    if held:
        yield from made()


def _encode(tokenizer_path: str, end_id: int, block_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, end = tokenizer_at(tokenizer_path), np.array([end_id], "<u4")
        part = TaskContext.get().partitionId()
        start = block = 0
        held, n_held, doc_ids, doc_ends = [], 0, [], []

        def made(skipped: int, open_end: bool) -> pa.RecordBatch:
            nonlocal start, block, held, n_held, doc_ids, doc_ends
            g = compress(np.concatenate(held))
            width = 2 if len(g.terminals) + len(g.rules) <= 1 << 16 else 4
            stored = (g.terminals.astype("<u4"), g.rules.astype("<u4"), g.lengths.astype("<u4"), g.symbols.astype(f"<u{width}"))
            row = (part, block, start, n_held, skipped, open_end, doc_ids, doc_ends, *(x.tobytes() for x in stored), width)
            start, block = start + n_held, block + 1
            held, n_held, doc_ids, doc_ends = [], 0, [], []
            return pa.RecordBatch.from_arrays([pa.array([x], kind) for x, (_, kind) in zip(row, _BLOCK_TYPES, strict=True)], [name for name, _ in _BLOCK_TYPES])

        for key, ids in _documents(batches, tokenizer, end):
            total = len(ids)
            if n_held and total > block_ids:
                yield made(0, False)
            skipped = 0
            while total - skipped > block_ids:
                held, n_held, doc_ids, doc_ends = [ids[skipped : skipped + block_ids]], block_ids, [key], [block_ids]
                yield made(skipped, True)
                skipped += block_ids
            held.append(ids[skipped:])
            n_held += total - skipped
            doc_ids.append(key)
            doc_ends.append(n_held)
            if skipped or n_held >= block_ids:
                yield made(skipped, False)
        if n_held:
            yield made(0, False)
        give_back()

    return run


def write_token_files(
    docs: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, block_ids: int = BLOCK_IDS
) -> None:
    """Writes the ids of all texts, each followed by end_id, in ascending order of the document ids.

    `path`/blocks holds Parquet files of blocks (BLOCK_SCHEMA), `path`/parts the ids before each part.  Rows are dealt by ranges of id, so that a task writes
    neighbours, and Spark's commit makes a lost task's files vanish.  Memory holds one block and one document.

    Null texts are empty: end_id alone.  Null ids come first; rows of equal ids follow each other in the table's order and are
    split over tasks by their number, so a hot id fills no task.  Documents longer than block_ids are cut over blocks.  An empty
    table makes files without rows.  Other columns are not read.
    """
    spark = docs.sparkSession
    texts = F.coalesce(text_bytes(text_col), F.lit(b""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), texts.alias("text"), F.monotonically_increasing_id().alias("place"))
    dealt = rows.repartitionByRange(F.col("id").asc_nulls_first(), "place").sortWithinPartitions(F.col("id").asc_nulls_first(), "place")
    with settings(spark, JOB_SETTINGS):
        dealt.select("id", "text").mapInArrow(_encode(tokenizer_path, end_id, block_ids), BLOCK_SCHEMA).write.parquet(f"{path}/blocks")
    # one row to a part, that is to a task of the job above
    sizes = sorted(map(tuple, blocks(spark, path).groupBy("part").agg(F.sum("n_ids")).collect()))
    before = [0, *accumulate(n for _, n in sizes)]
    spark.createDataFrame([(p, b) for (p, _), b in zip(sizes, before, strict=False)], "part int, before long").write.parquet(f"{path}/parts")


def blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")


def _grammars(batch: pa.RecordBatch) -> Iterator[tuple[dict, Grammar]]:
    for row in batch.to_pylist():
        terminals, rules, lengths = (np.frombuffer(row[name], "<u4") for name in ("terminals", "rules", "lengths"))
        yield row, Grammar(terminals, rules.reshape(-1, 2), lengths, np.frombuffer(row["symbols"], f"<u{row['width']}"))


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, grammar in _grammars(batch):
            ids = grammar.ids().astype("<u4")
            starts = [0, *row["doc_ends"][:-1]]
            sums = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, row["doc_ends"], strict=True)]
            n = len(starts)
            whole = np.ones(n, bool)
            whole[0] &= not row["skipped"]
            whole[-1] &= not row["open_end"]
            at = row["start"] + np.array(starts, np.int64)
            at[0] -= row["skipped"]
            columns = [
                pa.array([row["part"]] * n, pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(at), pa.array([row["skipped"]] + [0] * (n - 1), pa.int64()),
                pa.array(np.diff([0, *row["doc_ends"]]).astype(np.int64)), pa.array(sums, pa.int64()), pa.array(whole),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["part", "id", "at", "skipped", "n", "crc", "whole"])


def _joined(pieces: pd.DataFrame) -> pd.DataFrame:
    """One row of a document cut over blocks: checksums are linear, so what follows moves them as zeros would."""
    pieces = pieces.sort_values("skipped")
    crc, n = 0, 0
    for length, own in zip(pieces["n"].tolist(), pieces["crc"].tolist(), strict=True):
        zeros = bytes(4 * length)
        crc = zlib.crc32(zeros, crc) ^ zlib.crc32(zeros) ^ own
        n += length
    first = pieces.iloc[:1]
    return first.assign(n=n, crc=crc)[["part", "id", "at", "n", "crc"]]


def read_token_files(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """One row per document, from the files alone: id, start (ids of all documents before it), n_tokens, ids_crc32 (of its ids as little-endian 32-bit numbers)."""
    with Stages(spark, "token-files") as stages:
        segments = blocks(spark, path).mapInArrow(_segments, "part int, id long, at long, skipped long, n long, crc long, whole boolean")
        found = stages.write(segments, "segments", READ_SETTINGS)
        columns = ("part", "id", "at", "n", "crc")
        cut = found.where("not whole").groupBy("part", "at").applyInPandas(_joined, "part int, id long, at long, n long, crc long")
        rows = found.where("whole").select(*columns).unionByName(cut)
        parts = spark.read.parquet(f"{path}/parts")  # one row to a task of the job that wrote
        placed = rows.join(F.broadcast(parts), "part")
        return stages.keep(placed.select(F.col("id").alias(id_col), (F.col("before") + F.col("at")).alias("start"), F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32")))


def _picked(wanted: frozenset):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, grammar in _grammars(batch):
                found = [(key, row["part"], row["start"] + a - (0 if k else row["skipped"]), 0 if k else row["skipped"], grammar.span(a, b).tolist()) for k, (key, a, b) in enumerate(zip(row["doc_ids"], [0, *row["doc_ends"]], row["doc_ends"], strict=False)) if key in wanted]
                if found:
                    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], ["id", "part", "at", "skipped", "ids"])

    return run


def read_documents(spark: SparkSession, path: str, ids: list[int], id_col: str = "doc_id") -> DataFrame:
    """(id, token_ids) of a few documents: blocks are chosen by their ids, and of these only the symbols that hold a document are expanded."""
    chosen = blocks(spark, path).where(F.arrays_overlap("doc_ids", F.array(*(F.lit(i).cast("long") for i in ids))))
    pieces = chosen.mapInArrow(_picked(frozenset(ids)), "id long, part int, at long, skipped long, ids array<long>")
    whole = pieces.groupBy("id", "part", "at").agg(F.array_sort(F.collect_list(F.struct("skipped", "ids"))).alias("pieces"))
    return whole.select(F.col("id").alias(id_col), F.flatten(F.col("pieces.ids")).alias("token_ids"))
