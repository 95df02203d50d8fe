"""Fill-in-the-middle texts: cut points found by rank among the units of a text, from a sparse scan of events."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import give_back, text_bytes

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: ASCII characters that change the class of what stands beside them, by unit: a line ends with its \n, a word with the white space after it.
EVENTS = {"line": "\n", "word": " \t\n\v\f\r", "character": ""}

_SCHEMA = "id long, n long, form string, prefix_chars long, middle_chars long, output binary"


class EventScan:
    """One Aho-Corasick automaton over the unit's class-changing characters and the sentinels.

    Only events are looked at: a gap between two of them holds no end of a line or word, and as many characters as it is long.
    """

    def __init__(self, unit: str):
        import ahocorasick

        self.unit = unit
        self.automaton = ahocorasick.Automaton()
        for c in EVENTS[unit]:
            self.automaton.add_word(c, False)
        for s in (PREFIX, SUFFIX, MIDDLE):
            self.automaton.add_word(s, True)
        self.automaton.make_automaton()

    def scan(self, text: str) -> Units:
        places, sentinel = [], False
        for at, is_sentinel in self.automaton.iter(text):
            if is_sentinel:
                sentinel = True
            else:
                places.append(at + 1)
        ends = np.array(places, np.int64)
        if self.unit == "character":
            return Units(len(text), None, sentinel)
        if self.unit == "word" and len(ends):
            ends = ends[np.append(np.diff(ends) > 1, True)]  # a run of white space ends its word once, at the run's end
        if len(text) and (not len(ends) or ends[-1] < len(text)):
            ends = np.append(ends, len(text))
        return Units(len(ends), ends, sentinel)


class Units:
    """How many units a text has, where they end (None: each character is one), and whether a sentinel stands in the text."""

    def __init__(self, n: int, ends: np.ndarray | None, sentinel: bool):
        self.n, self.ends, self.sentinel = n, ends, sentinel

    def characters(self, rank: int) -> int:
        """Characters in the first `rank` units."""
        if self.ends is None or not rank:
            return rank
        return int(self.ends[rank - 1])


def draws(seed: int, key: int | None) -> list[int]:
    """Four unsigned integers: the first 8-digit groups of the SHA-256 of the seed, a colon and the decimal key."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]


def arrange(text: str, units: Units, h: list[int], fim_percent: int, spm_percent: int) -> tuple[str, int | None, int | None, str]:
    """form, prefix_chars, middle_chars and output of a text."""
    if not text or units.sentinel or h[2] % 100 >= fim_percent:
        return "plain", None, None, text
    start, end = (units.characters(k) for k in sorted((h[0] % (units.n + 1), h[1] % (units.n + 1))))
    prefix, middle, suffix = text[:start], text[start:end], text[end:]
    if h[3] % 100 < spm_percent:
        return "spm", start, end - start, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return "psm", start, end - start, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def _transform(unit: str, seed: int, fim_percent: int, spm_percent: int, batch_chars: int = 8 << 20):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = EventScan(unit)
        names = ["id", "n", "form", "prefix_chars", "middle_chars", "output"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        rows, held = [], 0
        for batch in batches:
            for key, raw in zip(batch.column(0), batch.column(1), strict=True):
                text = (raw.as_py() or b"").decode("utf-8", "surrogateescape")
                units = scan.scan(text)
                key = key.as_py()
                form, before, middle, output = arrange(text, units, draws(seed, key), fim_percent, spm_percent)
                rows.append((key, units.n, form, before, middle, output.encode("utf-8", "surrogateescape")))
                held += len(output)
                if held >= batch_chars:
                    yield made(rows)
                    rows, held = [], 0
        if rows:
            yield made(rows)
        give_back()

    return run


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "line", seed: int = 7, fim_percent: int = 100, spm_percent: int = 50
) -> DataFrame:
    """One row per row of docs: id, n (units), form, prefix_chars, middle_chars, output (the new text).

    A text is cut into units: lines with their \\n, words with the white space after them, or characters.  Two ranks drawn from seed
    and id part it into prefix, middle and suffix, which are put out behind sentinels: `psm` in that order but for the
    middle, which comes last, `spm` with the suffix first.  fim_percent of the texts are rearranged, spm_percent of these as
    spm; the rest are `plain`, like empty texts and those that hold a sentinel, and have null prefix_chars and middle_chars.

    Null texts count as empty, null ids draw as an empty key; repeated rows are each put out, alike.  Very long texts
    are scanned like others, and bytes that are no UTF-8 come out as they went in.  An empty table gives no rows.  Other columns are not read.
    Rows stay where they are: nothing is shuffled, and each row is made from its own text alone.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("text"))
    found = texts.mapInArrow(_transform(unit, seed, fim_percent, spm_percent), _SCHEMA)
    return found.withColumn("output", F.col("output").cast("string")).withColumnRenamed("id", id_col)


def restored(output: str = "output", form: str = "form") -> F.Column:
    """The exact text again (of valid UTF-8), from output and form alone: no part of a rearranged text holds a sentinel."""
    parts = F.split(F.col(output), "<[PSM]>", -1)
    order = {"psm": (1, 3, 2), "spm": (2, 3, 1)}
    text = F.col(output)
    for kind, places in order.items():
        text = F.when(F.col(form) == kind, F.concat(*(parts[k] for k in places))).otherwise(text)
    return text
