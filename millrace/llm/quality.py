"""A quality classifier learned from positive and unlabelled texts."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import Stages, text_bytes

#: Rows of either kind that a fit takes, about: those whose id's hash is within a bound computed from the count.
FIT_ROWS = 8_000
#: Buckets of hashed words, and of hashed byte trigrams.
BUCKETS = 128
EPOCHS = 300
HIDDEN = 24
#: The class prior where no label tells it.
PRIOR = 0.8

_MARKS = b"|!*#%$&.,;:-/@<>_'\"()[]{}=+?"
_WORD_END = re.compile(rb"[A-Za-z\x80-\xff]+[^A-Za-z\x80-\xff\s]{2,}$")


def features(text: bytes | None) -> np.ndarray:
    """Sizes, repetition of words and lines, shares of kinds of words and bytes, hashed words and byte trigrams, all over the whole text."""
    text = text or b""
    words, lines = text.split(), [x for x in text.split(b"\n") if x.strip()]
    n, size = len(words), max(1, len(text))
    seen = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    counted = Counter(words)
    lower = Counter(w.lower().strip(_MARKS) for w in words)
    top = [c for _, c in lower.most_common(3)] + [0, 0, 0]
    pairs = len(set(zip(words, words[1:], strict=False)))
    values = [
        np.log1p(n),
        np.log1p(len(lines)),
        np.log1p(size / max(1, len(lines))),
        size / max(1, n),
        len(counted) / max(1, n),
        len(lower) / max(1, n),
        pairs / max(1, n - 1),
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / max(1, n - 1),
        *(c / max(1, n) for c in top[:3]),
        1 - len(set(lines)) / max(1, len(lines)),
        max(Counter(lines).values(), default=0) / max(1, len(lines)),
        sum(len(x) < 30 for x in lines) / max(1, len(lines)),
        sum(c for w, c in counted.items() if _WORD_END.match(w)) / max(1, n),
        sum(c for w, c in counted.items() if w.isupper()) / max(1, n),
        sum(c for w, c in counted.items() if w[:1].isupper()) / max(1, n),
        sum(c for w, c in counted.items() if w.isdigit()) / max(1, n),
        seen[65:91].sum() / size,
        seen[97:123].sum() / size,
        seen[48:58].sum() / size,
        seen[128:].sum() / size,
        seen[:32].sum() / size,
        *(np.sqrt(seen[c] / size) for c in _MARKS),
    ]
    word_at = np.fromiter((zlib.crc32(w) % BUCKETS for w in lower), np.int64, len(lower))
    hashed = np.bincount(word_at, np.fromiter(lower.values(), np.float64, len(lower)), BUCKETS) / max(1, n)
    return np.concatenate((np.array(values, np.float32), np.sqrt(hashed).astype(np.float32), np.sqrt(_trigrams(text) / size).astype(np.float32)))


def _trigrams(text: bytes, step: int = 1 << 20) -> np.ndarray:
    """Counts of hashed byte trigrams, a stretch of the text at a time."""
    counts = np.zeros(BUCKETS, np.int64)
    for at in range(0, max(0, len(text) - 2), step):
        a = np.frombuffer(text, np.uint8)[at : at + step + 2].astype(np.uint32)
        codes = (a[:-2] | a[1:-1] << 8 | a[2:] << 16) * np.uint32(0x9E3779B1)
        counts += np.bincount(codes >> np.uint32(25), minlength=BUCKETS)
    return counts


@dataclass
class Network:
    """Standardised features, one hidden layer, a logistic output."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float

    def score(self, x: np.ndarray) -> np.ndarray:
        h = np.tanh(np.clip((x - self.mean) / self.scale, -8, 8) @ self.w1 + self.b1)
        return 1 / (1 + np.exp(-np.clip(h @ self.w2 + self.b2, -30, 30)))


def fit_positive_unlabelled(positive: np.ndarray, unlabelled: np.ndarray, prior: float, epochs: int = EPOCHS, hidden: int = HIDDEN, seed: int = 11) -> Network:
    """Minimises the non-negative unbiased risk of positive-unlabelled learning (Kiryo et al.) with the logistic loss.

    risk = prior E_p[l(f)] + max(0, E_u[l(-f)] - prior E_p[l(-f)]).  Where the second part falls below zero its gradient
    is followed upwards alone.  Features of both kinds fill whole batches; Adam takes the steps.
    """
    rng = np.random.default_rng(seed)
    both = np.concatenate((positive, unlabelled))
    mean, scale = both.mean(axis=0), both.std(axis=0) + 1e-3
    p, u = (np.clip((x - mean) / scale, -8, 8) for x in (positive, unlabelled))
    params = [rng.normal(0, 1 / np.sqrt(p.shape[1]), (p.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.array(0.0)]
    first, second = [np.zeros_like(x) for x in params], [np.zeros_like(x) for x in params]
    x = np.concatenate((p, u))
    n_p, n_u = len(p), len(u)
    for step in range(1, epochs + 1):
        w1, b1, w2, b2 = params
        h = np.tanh(x @ w1 + b1)
        f = h @ w2 + b2
        s = 1 / (1 + np.exp(-np.clip(f, -30, 30)))
        negative_part = np.logaddexp(0, f[n_p:]).mean() - prior * np.logaddexp(0, f[:n_p]).mean()
        g = np.zeros(len(x))
        if negative_part >= 0:
            g[:n_p] = prior * (s[:n_p] - 1) / n_p - prior * s[:n_p] / n_p
            g[n_p:] = s[n_p:] / n_u
        else:
            g[:n_p] = prior * s[:n_p] / n_p
            g[n_p:] = -s[n_p:] / n_u
        back = (g[:, None] * w2) * (1 - h * h)
        grads = [x.T @ back + 1e-4 * w1, back.sum(axis=0), h.T @ g + 1e-4 * w2, g.sum()]
        for i, d in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * d
            second[i] = 0.999 * second[i] + 0.001 * d * d
            params[i] = params[i] - 0.02 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return Network(mean, scale, params[0], params[1], params[2], float(params[3]))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([features(t).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], ["features"])


def _score(network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x = np.stack([features(t) for t in batch.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(network.value.score(x).astype(np.float64))], ["id", "score"])

    return run


def _among(share: float) -> F.Column:
    """Whether the id's hash is in the first `share` of all hashes."""
    return F.shiftrightunsigned(F.xxhash64("id"), 11) < F.lit(int(min(1.0, share) * (1 << 53)))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.3) -> DataFrame:
    """One row per row of docs: id, score (the probability of label 1), predicted.

    Trusted positives are the documents whose labels are all 1; unlabelled are those without a label here, the
    rest of the table.  The class prior is the share of 1 among labels.  A fit takes about FIT_ROWS of either kind, chosen by
    the hash of the id; never more than twice that, which bounds rows that repeat an id.

    Null and empty texts get the score of an empty text.  Null labels and labels of no document are left out; with no
    positive or no unlabelled document all scores are the prior.  Null ids and repeated rows are scored like
    others.  An empty table gives no rows.  Other columns are not read.
    """
    spark = docs.sparkSession
    with Stages(spark, "quality") as stages:
        texts = docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("text"))
        marked = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y"))
        marked = stages.write(marked.groupBy("id").agg(F.min("y").alias("y")), "labels")
        n_labels, n_positive = marked.agg(F.count("*"), F.count_if(F.col("y") == 1)).first()
        prior = min(0.99, max(0.01, n_positive / n_labels if n_labels else PRIOR))
        n_docs = texts.where("id is not null").count()
        positive = marked.where("y = 1").where(_among(FIT_ROWS / max(1, n_positive))).select("id")
        # both sides keep the same hashes, so what is sent around is bounded by the share
        share = min(FIT_ROWS / max(1, n_docs - n_labels), 4 * FIT_ROWS / max(1, n_docs), 4 * FIT_ROWS / max(1, n_labels))
        kinds = [
            texts.join(F.broadcast(positive), "id", "left_semi"),
            texts.where(F.col("id").isNotNull() & _among(share)).join(F.broadcast(marked.where(_among(share)).select("id")), "id", "left_anti"),
        ]
        samples = []
        for rows in kinds:
            taken = rows.limit(2 * FIT_ROWS).mapInArrow(_extract, "features binary").collect()
            samples.append(np.array([np.frombuffer(r[0], np.float32) for r in taken], np.float64))
        if all(len(x) for x in samples):
            network = fit_positive_unlabelled(*samples, prior)
            found = texts.mapInArrow(_score(spark.sparkContext.broadcast(network)), "id long, score double")
        else:
            found = texts.select("id", F.lit(float(prior)).alias("score"))
        return stages.keep(found.select(F.col("id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted")))
