"""Word-piece counts by a linear longest-match automaton."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import Stages

#: Mark that begins pieces standing at the start of a word.
WORD_START = "▁"


class PieceCounter:
    """Greedy longest-match piece counts of a word, in time linear in its length.

    The trie holds the initial pieces behind WORD_START and the other pieces below a second root; where WORD_START alone is a
    piece, the first root pops it and goes on at the second.  For a state whose string
    cannot be extended, `link` is the state of what is left after greedily popping its leading pieces, and `popped` how
    many they are; a state without link can't be segmented.
    """

    def __init__(self, pieces: list[str]):
        self.next: list[dict[str, int]] = [{}, {}]
        piece_end = [False, False]
        for piece in pieces:
            initial = piece.startswith(WORD_START)
            body = piece[len(WORD_START) :] if initial else piece
            v = 0 if initial else 1
            for c in body:
                if c not in self.next[v]:
                    self.next[v][c] = len(self.next)
                    self.next.append({})
                    piece_end.append(False)
                v = self.next[v][c]
            piece_end[v] = True
        n = len(self.next)
        self.link: list[int] = [-1] * n
        self.popped = [0] * n
        if piece_end[0]:
            self.link[0], self.popped[0] = 1, 1
        queue = deque([0, 1])
        while queue:
            u = queue.popleft()
            for c, v in self.next[u].items():
                if piece_end[v]:
                    self.link[v], self.popped[v] = 1, 1
                else:
                    z, k = self.link[u], self.popped[u]
                    while z >= 0 and c not in self.next[z]:
                        k += self.popped[z]
                        z = self.link[z]
                    if z >= 0:
                        self.link[v], self.popped[v] = self.next[z][c], k
                queue.append(v)

    def count(self, word: str) -> int:
        """Pieces of the word; 0 where no segmentation exists."""
        v, total = 0, 0
        for c in word:
            while c not in self.next[v]:
                total += self.popped[v]
                v = self.link[v]
                if v < 0:
                    return 0
            v = self.next[v][c]
        while v != 1:
            total += self.popped[v]
            v = self.link[v]
            if v < 0:
                return 0
        return total


def pieces_of(path: str) -> list[str]:
    """The pieces of a sentencepiece model, without control, unknown and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    skip = (model.is_control, model.is_unknown, model.is_byte, model.is_unused)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not any(f(i) for f in skip)]


def _count(path: str, most: int = 400_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter(pieces_of(path))
        known: dict[bytes, int] = {}
        for batch in batches:
            n_words, n_pieces, n_unknown = [], [], []
            for text in batch.column(1).to_pylist():
                words = (text or b"").split()
                try:
                    counts = list(map(known.__getitem__, words))
                except KeyError:
                    if len(known) > most:
                        known.clear()
                    for w in set(words):
                        if w not in known:
                            known[w] = counter.count(w.decode("utf-8", "replace"))
                    counts = list(map(known.__getitem__, words))
                unknown = counts.count(0)
                n_words.append(len(words))
                n_pieces.append(sum(counts) + unknown)
                n_unknown.append(unknown)
            columns = [batch.column(0), *(pa.array(x, pa.int64()) for x in (n_words, n_pieces, n_unknown))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_words", "n_pieces", "n_unknown"])

    return run


def count_pieces(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_words, n_pieces, n_unknown.

    Words stand between ASCII white space and keep their case.  A word is cut greedily: the longest initial piece (WORD_START
    alone where no longer one fits), then the longest other piece, and so on; a word without such a cut is one unknown piece.  Lengths of words seen are
    remembered up to a bound.

    Null, empty and blank texts have no words.  Null ids and repeated rows are counted like others.  An empty table
    gives no rows.  Other columns are not read.
    """
    with Stages(docs.sparkSession, "token-counts") as stages:
        texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
        counted = texts.mapInArrow(_count(model_path), "id long, n_words long, n_pieces long, n_unknown long")
        return stages.keep(counted.withColumnRenamed("id", id_col), "counts")
