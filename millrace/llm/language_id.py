"""Language identification: known words first, then ever shorter character n-grams."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.llm.shared import Stages, give_back

#: Prediction for texts without a letter.
UNKNOWN = "und"
#: Longest first; the fallback for a word tries them in this order.
GRAM_LENGTHS = (4, 3, 2, 1)
#: Words kept per language, and n-grams kept per language and length, by frequency in steps of a sixteenth of a doubling.
WORDS_PER_LANGUAGE = 20_000
GRAMS_PER_LANGUAGE = 5_000
#: The model's size bound in scores, words times languages: with over 50 languages each keeps fewer words and n-grams.
MOST_SCORES = 50_000_000

#: Up to U+02C1 all letters are in these ranges, and no marks; texts that go no further, most by far, need no look at categories.
_FAR = re.compile("[\u02c2-\U0010ffff]")
_NEAR_LETTERS = re.compile("[a-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u02c1]+")
_LETTERS = re.compile(r"[^\W\d_]+")


def _characters(*categories: str) -> str:
    """The inside of a pattern's class: all characters of these Unicode categories (which have none from plane 2 to 13)."""
    ranges: list[list[int]] = []
    for c in chain(range(0x20000), range(0xE0000, 0xE0200)):
        if unicodedata.category(chr(c)) in categories:
            if ranges and ranges[-1][1] == c - 1:
                ranges[-1][1] = c
            else:
                ranges.append([c, c])
    return "".join(f"\\U{lo:08x}-\\U{hi:08x}" for lo, hi in ranges)


_MARKS, _NUMERALS = _characters("Mn", "Mc", "Me"), _characters("Nl", "No")
#: Word characters that are no letters, and marks, which are none but belong to the letter before: rare, so looked for first.
_ODD = re.compile(f"[{_MARKS}{_NUMERALS}]")
_NUMERAL = re.compile(f"[{_NUMERALS}]")
_MARKED_LETTERS = re.compile(rf"[^\W\d_](?:[^\W\d_]|[{_MARKS}])*")


def letter_words(text: str | None) -> list[str]:
    """Stretches of letters (Unicode categories L) with their marks (M), lower-cased."""
    text = (text or "").lower()
    if text.isascii() or not _FAR.search(text):
        return _NEAR_LETTERS.findall(text)
    if not _ODD.search(text):
        return _LETTERS.findall(text)
    return _MARKED_LETTERS.findall(_NUMERAL.sub(" ", text))


def grams_of(word: str, n: int) -> list[str]:
    """The n-grams of the word between boundary marks; single characters stand without marks."""
    marked = word if n == 1 else f"<{word}>"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def _rows(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)


def _count_words(most: int = 400_000):
    """Rows (lang, item, n), words summed within the task, at most about `most` at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}

        def flush() -> pa.RecordBatch:
            out = [(lang, w, n) for lang, counted in words.items() for w, n in counted.items()]
            words.clear()
            return _rows(out, ["lang", "item", "n"], [pa.string(), pa.string(), pa.int64()])

        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words.setdefault(lang, Counter()).update(letter_words(text))
            if sum(map(len, words.values())) > most:
                yield flush()
        yield flush()
        give_back()

    return run


def _count_grams(most: int = 400_000):
    """Rows (lang, kind, item, n) of the n-grams of counted words, kind being their length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: dict[tuple[str, int], dict[str, int]] = {}

        def flush() -> pa.RecordBatch:
            out = [(lang, k, g, n) for (lang, k), counted in grams.items() for g, n in counted.items()]
            grams.clear()
            return _rows(out, ["lang", "kind", "item", "n"], [pa.string(), pa.int32(), pa.string(), pa.int64()])

        for batch in batches:
            for lang, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for k in GRAM_LENGTHS:
                    counted = grams.setdefault((lang, k), {})
                    for g in grams_of(word, k):
                        counted[g] = counted.get(g, 0) + n
            if sum(map(len, grams.values())) > most:
                yield flush()
        yield flush()
        give_back()

    return run


@dataclass
class Model:
    """Log frequencies: one row of `scores` per word or n-gram, one column per language, smoothed where unseen."""

    languages: list[str]
    words: dict[str, int]
    grams: dict[int, dict[str, int]]
    scores: np.ndarray

    def fallback(self, word: str) -> list[int]:
        """The rows of an unseen word: its n-grams of the greatest length with any known."""
        for n in GRAM_LENGTHS:
            known = self.grams[n]
            rows = [known[g] for g in grams_of(word, n) if g in known]
            if rows:
                return rows
        return []

    def predict(self, text: str | None, cache: dict[str, list[int]]) -> tuple[str, float]:
        """(language, probability).  A word adds its row, an unseen one the mean of its n-grams' rows.  Ties go to the language first by name."""
        words = letter_words(text)
        if not words or not self.languages:
            return UNKNOWN, 0.0
        rows = list(map(self.words.get, words))
        weights: list[float] | np.ndarray = np.ones(len(rows))
        if None in rows:
            unseen = [w for w, r in zip(words, rows, strict=True) if r is None]
            rows = [r for r in rows if r is not None]
            weights = [1.0] * len(rows)
            for w in unseen:
                r = cache.get(w)
                if r is None:
                    r = cache[w] = self.fallback(w)
                if r:
                    rows += r
                    weights += [1 / len(r)] * len(r)
        total = np.asarray(weights) @ self.scores[rows] if len(rows) else np.zeros(len(self.languages))
        e = np.exp(total - total.max())
        best = int(np.argmax(total))
        return self.languages[best], float(e[best] / e.sum())


def fit(stages: Stages, docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Counts words and n-grams of all rows with a language; the most frequent of any language make the model, with their counts in all.

    A frequency is smoothed by 0.5 over that of the kind's kept items.  Rows with a null text or language are not
    learned from.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).cast("string"), F.col(lang_col).cast("string"))
    # words are summed over the corpus before their n-grams are taken: each distinct word is cut up once
    words = rows.mapInArrow(_count_words(), "lang string, item string, n long").groupBy("lang", "item").agg(F.sum("n").alias("n"))
    words = stages.write(words, "word-counts")
    grams = words.mapInArrow(_count_grams(), "lang string, kind int, item string, n long").groupBy("lang", "kind", "item").agg(F.sum("n").alias("n"))
    counts = words.select("lang", F.lit(0).alias("kind"), "item", "n").unionByName(stages.write(grams, "gram-counts"))
    totals = counts.groupBy("lang", "kind").agg(F.sum("n").alias("total"))
    sums = {(r["lang"], r["kind"]): r["total"] for r in totals.collect()}
    langs = sorted({lang for lang, _ in sums})
    most = MOST_SCORES // max(1, len(langs)) ** 2
    bounds = {kind: max(1, min(GRAMS_PER_LANGUAGE if kind else WORDS_PER_LANGUAGE, most // 2 if not kind else most // (2 * len(GRAM_LENGTHS)))) for kind in (0, *GRAM_LENGTHS)}
    step = F.floor(F.log2("n") * 16).cast("int")
    steps: dict[tuple[str, int], list[tuple[int, int]]] = {}
    for lang, kind, at, items in counts.groupBy("lang", "kind", step.alias("step")).agg(F.count("*")).collect():
        steps.setdefault((lang, kind), []).append((at, items))
    cut = [(lang, kind, _least_step(found, bounds[kind])) for (lang, kind), found in steps.items()]
    cuts = F.broadcast(docs.sparkSession.createDataFrame(cut, "lang string, kind int, least int"))
    items = stages.write(counts.join(cuts, ["lang", "kind"]).where(step >= F.col("least")).select("kind", "item").distinct(), "kept-items")
    kept = counts.join(F.broadcast(items), ["kind", "item"]).select("lang", "kind", "item", "n")
    index: dict[tuple[int, str], int] = {}
    found: list[tuple[int, int, int]] = []
    column = {x: i for i, x in enumerate(langs)}
    for lang, kind, item, n in kept.toLocalIterator():
        found.append((index.setdefault((kind, item), len(index)), column[lang], n))
    table = np.zeros((len(index), len(langs)))
    words = {item: r for (kind, item), r in index.items() if not kind}
    grams = {n: {item: r for (kind, item), r in index.items() if kind == n} for n in GRAM_LENGTHS}
    if not found:
        return Model(langs, words, grams, table)
    for r, c, n in found:
        table[r, c] = n
    kinds = np.fromiter((k for k, _ in index), np.int64, len(index))
    totals_by = np.array([[sums.get((x, k), 0) for x in langs] for k in range(max(GRAM_LENGTHS) + 1)], float).reshape(-1, len(langs))
    size = np.bincount(kinds, minlength=max(GRAM_LENGTHS) + 1)
    scores = np.log(table + 0.5) - np.log(totals_by[kinds] + 0.5 * np.maximum(1, size[kinds])[:, None])
    return Model(langs, words, grams, scores)


def _least_step(steps: list[tuple[int, int]], bound: int) -> int:
    """The least sixteenth of a doubling whose items, with all more frequent ones, are within bound; the greatest step stays anyway."""
    least, total = max(steps)[0], 0
    for at, items in sorted(steps, reverse=True):
        total += items
        if total > bound:
            break
        least = at
    return least


def _predict(model, most: int = 200_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, cache = model.value, {}
        for batch in batches:
            out = [m.predict(t, cache) for t in batch.column(1).to_pylist()]
            if len(cache) > most:
                cache.clear()
            scored = [pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], *scored], ["id", *batch.schema.names[2:], "lang_pred", "score"])
        cache.clear()
        give_back()

    return run


def identify(docs: DataFrame, training: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: id, the columns of `carry` as they are, lang_pred, score (the probability of lang_pred among the learned languages).

    Learned from the texts and languages of `training`; predictions read the text alone.  Texts that are null or have no
    letter get "und" and 0; so does every text if nothing was learned.  Ties go to the first language by
    name.  Null ids and repeated rows are judged like others.  An empty table gives no rows.  Other columns are not read.
    """
    spark = docs.sparkSession
    with Stages(spark, "language") as stages:
        model = spark.sparkContext.broadcast(fit(stages, training, text_col, lang_col))
        texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *(F.col(c).alias(f"carried_{c}") for c in carry))
        schema = StructType([texts.schema["id"], *texts.schema.fields[2:]]).add("lang_pred", "string").add("score", "double")
        found = texts.mapInArrow(_predict(model), schema)
        return stages.keep(found.select(F.col("id").alias(id_col), *(F.col(f"carried_{c}").alias(c) for c in carry), "lang_pred", "score"), "languages")


