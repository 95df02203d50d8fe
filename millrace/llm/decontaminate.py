"""Benchmark decontamination with a generalised suffix automaton of the test items."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from millrace.llm.shared import Stages, giving_back, text_bytes

#: Lower-cases A-Z and blanks every byte that belongs to no word; bytes from 0x80 are parts of letters.
_WORD_BYTES = bytes((c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32) for c in range(256))
#: Item words in one automaton; more items go to further automata, each a pass of its own.
BLOCK_WORDS = 100_000

_HITS = StructType().add("spans", ArrayType(StructType().add("start", "integer").add("end", "integer"))).add("item_ids", ArrayType(StringType()))
_COUNTS = StructType().add("n_words", "long").add("n_hit", "long")


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_WORD_BYTES).split()


class Automaton:
    """Generalised suffix automaton over item words, with the items that hold each window.

    State v stands for the word strings of lengths link length + 1 to length[v] that end at the same places.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        items = [(i, ws) for i, ws in items if ws]
        self.shortest = min((min(window, len(ws)) for _, ws in items), default=0)
        coded = [(i, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in ws]) for i, ws in items]
        for _, ws in coded:
            last = 0
            for w in ws:
                last = self._extend(last, w)
        #: By state: the window's length and its items.  A state holds at most one string of window words and one of each lesser length.
        self.marks: dict[int, dict[int, set[str]]] = {}
        for i, ws in coded:
            width = min(window, len(ws))
            for end, (v, n) in enumerate(self.walk(ws, width), 1):
                if n == width:
                    self.marks.setdefault(v, {}).setdefault(width, set()).add(i)
        #: The nearest state with marks on the way to the root, itself included.
        self.marked = [0] * len(self.link)
        for v in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            self.marked[v] = v if v in self.marks else self.marked[self.link[v]]

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            q = self.next[last][w]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
        new = self._state(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return new

    def _state(self, length: int, following: dict[int, int], link: int) -> int:
        self.length.append(length)
        self.next.append(following)
        self.link.append(link)
        return len(self.link) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def walk(self, ids: list[int], most: int) -> Iterator[tuple[int, int]]:
        """After each word: the state of the longest matching suffix of at most `most` words, and its length."""
        v, n = 0, 0
        for w in ids:
            while v and w not in self.next[v]:
                v = self.link[v]
                n = self.length[v]
            if w in self.next[v]:
                v = self.next[v][w]
                n += 1
            if n > most:
                n = most
            while v and n <= self.length[self.link[v]]:
                v = self.link[v]
            yield v, n

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged word spans under any window, and the items with occurring windows."""
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        if not self.shortest:
            return spans, items
        ids = np.fromiter((self.vocabulary.get(w, -1) for w in words), np.int64, len(words))
        # no window holds a word outside the vocabulary, so shorter stretches between such words are passed over
        cuts = np.concatenate(([-1], np.flatnonzero(ids < 0), [len(ids)]))
        for k in np.flatnonzero(np.diff(cuts) > self.shortest).tolist():
            lo, hi = int(cuts[k]) + 1, int(cuts[k + 1])
            for end, (v, n) in enumerate(self.walk(ids[lo:hi].tolist(), self.window), lo + 1):
                v, widest = self.marked[v], 0
                while v:
                    for width, found in self.marks[v].items():
                        if width <= n:
                            items |= found
                            widest = max(widest, width)
                    v = self.marked[self.link[v]]
                if widest:
                    start = end - widest
                    while spans and spans[-1][1] >= start:
                        start = min(start, spans.pop()[0])
                    spans.append((start, end))
        return spans, items


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if merged and start <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
        else:
            merged.append((start, end))
    return merged


def _scan(automaton, first: bool, last: bool, with_text: bool):
    """Adds one automaton's spans and items to those of the automata before it; columns after the text are carried on.

    All but the last pass carry the text on too.
    """

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = automaton.value
        for batch in batches:
            n_words, n_hit, spans, items = [], [], [], []
            texts = batch.column(1).to_pylist()
            end = batch.num_columns if first else batch.num_columns - 2
            before = [([], [])] * len(texts) if first else list(zip(batch.column(end).to_pylist(), batch.column(end + 1).to_pylist(), strict=True))
            carried = {name: batch.column(i) for i, name in enumerate(batch.schema.names[:end]) if i != 1 or with_text or not last}
            for text, (old_spans, old_items) in zip(texts, before, strict=True):
                words = words_of(text)
                found, held = matcher.match(words)
                if old_spans or old_items:
                    found = _merge([(s["start"], s["end"]) for s in old_spans] + found)
                    held = held | set(old_items)
                n_words.append(len(words))
                n_hit.append(sum(e - s for s, e in found))
                spans.append([{"start": s, "end": e} for s, e in found])
                items.append(sorted(held))
            span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            hits = {"spans": pa.array(spans, span), "item_ids": pa.array(items, pa.list_(pa.string()))}
            counts = {"n_words": pa.array(n_words, pa.int64()), "n_hit": pa.array(n_hit, pa.int64())} if last else {}
            columns = carried | counts | hits
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items in blocks of BLOCK_WORDS words, read partition by partition; the block at work and the next are held."""
    block, size = [], 0
    for item, text in benchmark.select(F.col(item_col).cast("string"), text_bytes(text_col)).where(F.col(item_col).isNotNull()).toLocalIterator():
        words = words_of(bytes(text) if text is not None else None)
        if size and size + len(words) > BLOCK_WORDS:
            yield block
            block, size = [], 0
        block.append((item, words))
        size += len(words)
    if block:
        yield block


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 13,
    coverage_divisor: int = 20,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per row of docs: id, the columns of `carry` as they are, n_words, n_hit, spans of hit words, item_ids, contaminated.

    A window is `window` consecutive words of an item, or all words of a shorter one.  A document is contaminated when
    hit words are at least one in coverage_divisor of its words.  The benchmark is taken in blocks of
    BLOCK_WORDS words, each one automaton broadcast to all tasks and one pass over the documents; between passes the texts
    are carried on with their hits, row by row.

    Null, empty and wordless texts have no words and are clean.  Rows with a null id or repeated rows are
    judged like others.  Items without words or without an id match nothing; items that repeat an id are one item with
    the windows of both.  Without items every document is clean.  An empty table gives no rows.  Other columns are
    not read.
    """
    spark = docs.sparkSession
    with Stages(spark, "decontaminate") as stages:
        kept = [c for c in carry if c != text_col]
        with_text = text_col in carry
        texts = docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("text"), *(F.col(c).alias(f"carried_{c}") for c in kept))
        carried = texts.schema.fields
        blocks = _blocks(benchmark, item_col, item_text_col) if benchmark is not None else iter(())
        items, written = next(blocks, []), None
        while True:
            following = next(blocks, None)
            scan = _scan(spark.sparkContext.broadcast(Automaton(items, window)), written is None, following is None, with_text)
            if following is None:
                first = carried if with_text else [carried[0], *carried[2:]]
                found = (texts if written is None else written).mapInArrow(scan, StructType([*first, *_COUNTS.fields, *_HITS.fields]))
                break
            before, items = written, following
            written = stages.write((texts if before is None else before).mapInArrow(scan, StructType([*carried, *_HITS.fields])), "hits")
            if before is not None:
                stages.drop(before)
        contaminated = (F.col("n_hit") > 0) & (coverage_divisor * F.col("n_hit") >= F.col("n_words"))
        returned = [(F.col("text").cast("string") if c == text_col else F.col(f"carried_{c}")).alias(c) for c in carry]
        return stages.keep(found.select(F.col("id").alias(id_col), *returned, "n_words", "n_hit", "spans", "item_ids", contaminated.alias("contaminated")))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if not spans:
                out.append(text)
                continue
            plain, places, at = text.translate(_WORD_BYTES), [], 0
            for word in plain.split():
                at = plain.index(word, at)
                places.append((at, at + len(word)))
                at += len(word)
            kept, at = [], 0
            for s in spans:
                kept.append(text[at : places[s["start"]][0]])
                at = places[s["end"] - 1][1]
            out.append(b"".join([*kept, text[at:]]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["id", "text"])


def remove_spans(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) with the hit words of `found` cut out; ids must be unique, and rows with a null id are left out."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("text"))
    joined = texts.join(found.select(F.col(id_col).alias("id"), "spans"), "id").select("id", "text", "spans")
    return joined.mapInArrow(_cut, "id long, text binary").select(F.col("id").alias(id_col), F.col("text").cast("string").alias(text_col))


def items_digest(item_ids: list[str]) -> str:
    """SHA-256 of the sorted ids joined by commas."""
    return hashlib.sha256(",".join(sorted(item_ids)).encode()).hexdigest()
