"""Packing token streams into fixed windows by multiway Karmarkar-Karp differencing."""

from __future__ import annotations

import heapq
import os
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import Stages, giving_back, text_bytes

WINDOW = 2048
END_ID = 1
#: Pieces are at most this long before balancing: several to a window let the differences cancel.
PIECE = 512
#: Windows balanced at a time.
GROUP_WINDOWS = 32

#: Stretches remembered in either half, some 75 MB.
REMEMBERED = 400_000

#: A character of one id, which stands between stretches.
_MARK = "\x01"
#: Byte-level vocabularies write a byte that shows as a character of Latin-1 as that character, and the k-th of the others as character 256 + k.
_BYTE_CHARACTERS = {b: 256 + k for k, b in enumerate([*range(0x21), *range(0x7F, 0xA1), 0xAD])}
_STOPS = (b".", b",")
_STOP = re.compile(rb"(?<=[a-z])([.,])(?=[ \n])")

_SCHEMA = "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, token_ids binary"


class CachedTokenizer:
    """Token ids as little-endian unsigned 32-bit bytes.

    The pre-tokeniser never joins characters across ASCII white space, so ids are remembered by the stretches between.  It also
    lower-cases, and parts letters from a full stop or comma, which stand apart here to make stretches recur.
    What is remembered fills two halves of `most` stretches each: where the newer half is full it becomes the older
    one, and what was not asked for again since then goes.
    """

    def __init__(self, path: str, most: int = REMEMBERED):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        (self.mark,) = self.tokenizer.encode(_MARK, add_special_tokens=False).ids
        self.model = self.tokenizer.model
        # a composed lower-case word reaches the model as its bytes' characters, unless this tokenizer adds to it
        plain = lambda w: self.tokenizer.encode(w, add_special_tokens=False).ids == self._of_model(w.encode())
        self.direct = all(map(plain, ("the", "quickly", "zqxjkv", "caf\u00e9", "\u00f1and\u00fa", "\u65e5\u672c")))
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.most = most

    def encode(self, text: bytes | None) -> bytes:
        parts = _STOP.sub(rb" \1 ", (text or b"").lower()).split() if b"<|" not in (text or b"<|") else (text or b"").split()
        if fresh := set(parts).difference(self.known):
            if len(self.known) > self.most:
                self.older, self.known = self.known, {}
                fresh = set(parts)
            self._meet(fresh)
        return b"".join(map(self.known.__getitem__, parts))

    def _meet(self, fresh: set[bytes]) -> None:
        """Puts what is not in the newer half there, from the older one or learned."""
        held = {p: self.older[p] for p in fresh if p in self.older}
        self.known.update(held)
        self._learn([p for p in fresh if p not in held])

    def encode_many(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of binary texts behind each other, and how many each text has.

        Each stretch of the texts is looked up once: a stop behind a letter is parted from its word there, which keeps what is remembered small.
        """
        same_bytes = lambda a, kind: pa.Array.from_buffers(kind, len(a), a.buffers(), a.null_count, a.offset)  # noqa: E731  bytes that may be no UTF-8
        strings = same_bytes(texts.fill_null(b""), pa.string())
        special = pc.match_substring(strings, "<|")
        lowered = pc.ascii_lower(strings)
        parts = pc.ascii_split_whitespace(pc.if_else(special, strings, lowered) if pc.any(special).as_py() else lowered)
        flat = parts.flatten().dictionary_encode()
        stretches = same_bytes(flat.dictionary, pa.binary()).to_pylist()
        ended = np.flatnonzero(pc.match_substring_regex(flat.dictionary, "^[^<]*[a-z][.,]$").to_numpy(zero_copy_only=False)).tolist()
        words = stretches.copy()
        for k in ended:
            words[k] = words[k][:-1]
        if len(self.known) > self.most:
            self.older, self.known = self.known, {}
        self._meet(set(words).union(_STOPS).difference(self.known))
        values = list(map(self.known.__getitem__, words))
        stops = {stop: self.known[stop] for stop in _STOPS}
        for k in ended:
            values[k] += stops[stretches[k][-1:]]
        size = np.fromiter(map(len, values), np.int64, len(values)) // 4
        begin, ids = np.cumsum(size) - size, np.frombuffer(b"".join(values), "<u4")
        at = flat.indices.to_numpy()
        sizes = size[at]
        stops = np.cumsum(sizes)
        total = int(stops[-1]) if len(stops) else 0
        out = ids[np.arange(total) + np.repeat(begin[at] - stops + sizes, sizes)]
        ends = np.append(0, stops)[parts.offsets.to_numpy() - parts.offsets[0].as_py()]
        return out, np.diff(ends)

    def _of_model(self, word: bytes) -> list[int]:
        characters = word.decode("latin-1")
        return [x.id for x in self.model.tokenize(characters if characters.isascii() else characters.translate(_BYTE_CHARACTERS))]

    def _learn(self, new: list[bytes]) -> None:
        """Words go to the model, other stretches through the tokenizer in one string, a mark between them; those that might hide a mark go alone."""
        if self.direct:
            rest = []
            for p in new:
                word = p.decode("utf-8", "replace")
                if word.isalpha() and (word.islower() if word.isascii() else word == word.lower() and unicodedata.is_normalized("NFC", word)):
                    ids = self._of_model(p)
                    self.known[p] = struct.pack(f"<{len(ids)}I", *ids)
                else:
                    rest.append(p)
            new = rest
        mark = _MARK.encode()
        plain = [p for p in new if b"<|" not in p and mark not in p]
        groups = [plain] if plain else []
        groups += [[p] for p in new if b"<|" in p or mark in p]
        texts = [f" {_MARK} ".join(p.decode("utf-8", "replace") for p in g) for g in groups]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            ends = [*(np.flatnonzero(ids == self.mark).tolist() if len(group) > 1 else []), len(ids)]
            for part, start, end in zip(group, [0, *(x + 1 for x in ends)], ends, strict=False):
                self.known[part] = ids[start:end].tobytes()


@lru_cache(maxsize=1)
def tokenizer_at(path: str, most: int = REMEMBERED) -> CachedTokenizer:
    """One to a Python worker: the tasks that it runs one after the other share what is remembered."""
    return CachedTokenizer(path, most)


def difference(sizes: list[int], windows: int) -> list[list[int]]:
    """Karmarkar-Karp: splits the indices of sizes over `windows` sets of nearly equal sums.

    Every number starts as a partition of its own, its other sets empty.  The two partitions of the largest
    spread are merged, the largest sets of one with the smallest of the other, until one is left.
    """
    heap = []
    for i, size in enumerate(sizes):
        sums = np.zeros(windows, np.int64)
        sums[-1] = size
        heap.append((-size, i, sums, [[] for _ in range(windows - 1)] + [[i]]))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, tie, a, in_a = heapq.heappop(heap)
        _, _, b, in_b = heapq.heappop(heap)
        sums = a + b[::-1]
        order = np.argsort(sums, kind="stable")
        sums = sums[order]
        sets = [in_a[k] + in_b[windows - 1 - k] if in_b[windows - 1 - k] else in_a[k] for k in order.tolist()]
        heapq.heappush(heap, (int(sums[0] - sums[-1]), tie, sums, sets))
    return heap[0][3] if heap else []


def balance(sizes: list[int], capacity: int = WINDOW) -> list[list[int]]:
    """Nearly equal windows within capacity; their number rises while any exceeds it."""
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        sets = difference(sizes, windows)
        if all(sum(sizes[i] for i in s) <= capacity for s in sets):
            return [s for s in sets if s]
        windows += 1


def _pack(path: str, window: int, end_id: int, piece: int, group_windows: int, with_ids: bool, remembered: int):
    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, end = tokenizer_at(path, remembered), int(end_id).to_bytes(4, "little")
        sequence = TaskContext.get().partitionId() << 32
        full: list[tuple] = []
        rest: list[tuple] = []
        held = 0

        def rows(pieces: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*pieces, strict=True))
            kinds = [pa.int64()] * 7 + [pa.binary()]
            names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "token_ids"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        def placed(p: tuple, at: int, offset: int) -> tuple:
            return (*p[:3], zlib.crc32(p[4]), p[3], at, offset, p[4] if with_ids else None)

        def flush() -> list[tuple]:
            nonlocal sequence, rest, held
            out = []
            for chosen in balance([p[2] for p in rest], window):
                offset = 0
                for i in chosen:
                    out.append(placed(rest[i], sequence, offset))
                    offset += rest[i][2]
                sequence += 1
            rest, held = [], 0
            return out

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = tokenizer.encode(text) + end
                total = len(ids) // 4
                at = 0
                while total - at >= window:
                    full.append(placed((i, at, window, total, ids[4 * at : 4 * (at + window)]), sequence, 0))
                    sequence += 1
                    at += window
                while at < total:
                    n = min(piece, total - at)
                    rest.append((i, at, n, total, ids[4 * at : 4 * (at + n)]))
                    held += n
                    at += n
                if held >= group_windows * window:
                    full += flush()
                if len(full) >= 1000:
                    yield rows(full)
                    full = []
        if rest:
            full += flush()
        if full:
            yield rows(full)

    return run


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    end_id: int = END_ID,
    piece: int = PIECE,
    group_windows: int = GROUP_WINDOWS,
    with_ids: bool = True,
    remembered: int = REMEMBERED,
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, token_ids.

    A document is its ids and end_id.  Whole windows are cut off long documents; what is left, in pieces of
    at most `piece` ids, is balanced over windows in groups of about group_windows, within the tasks that read the
    documents and without a shuffle.  Sequence ids are unique: task and running number.  Only a task's last group
    may leave a window with much padding.

    Null, empty and blank texts are end_id alone.  Null ids and repeated rows are packed like others, each row on its
    own.  An empty table gives no rows.  Other columns are not read.
    """
    with Stages(docs.sparkSession, "packing") as stages:
        texts = docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("text"))
        pieces = texts.mapInArrow(_pack(tokenizer_path, window, end_id, piece, group_windows, with_ids, remembered), _SCHEMA)
        if not with_ids:
            pieces = pieces.drop("token_ids")
        return stages.keep(pieces.withColumnRenamed("id", id_col), "pieces")
