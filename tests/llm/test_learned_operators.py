"""Language and quality: cases, gradients and held-out accuracy."""

import random

import numpy as np
import pytest

from millrace.llm import language_id, quality


def test_letters_are_letters_and_marks():
    assert language_id.letter_words("\u00b2 \u00bd \u2167 \u2462 12 _") == []
    assert language_id.letter_words("x\u00b2y a1b") == ["x", "y", "a", "b"]
    assert language_id.letter_words("\u0928\u092e\u0938\u094d\u0924\u0947 caf\u00e9 cafe\u0301") == ["\u0928\u092e\u0938\u094d\u0924\u0947", "caf\u00e9", "cafe\u0301"]


def test_language_learns_long_words_whole_and_all_languages(spark, monkeypatch):
    long = "ab" * 60
    rows = [(i, f"{long}x sun" if i % 2 else f"{long}y sun", "xx" if i % 2 else "yy") for i in range(40)] + [(100 + i, f"word{'abcdefghij'[i % 10] * (i // 10 + 2)}", f"l{i}") for i in range(230)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    asked = spark.createDataFrame([(1, f"{long}x", "yy"), (1, f"{long}y", None), (None, "\u00b2\u00b3", None), (3, "worda", None)], "doc_id long, text string, lang string")
    got = [(r["doc_id"], r["lang_pred"]) for r in language_id.identify(asked, docs).collect()]
    assert sorted(got, key=str)[:3] == [(1, "xx"), (1, "yy"), (3, sorted(got, key=str)[2][1])] and (None, "und") in got
    truth = {i: lang for i, _, lang in rows}
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(docs, docs).collect()}
    assert len(set(got.values())) > 200 and sum(got[i] == lang for i, lang in truth.items()) > 0.8 * len(rows)


def test_kept_items_have_their_counts_in_all_languages(spark, monkeypatch):
    from millrace.llm.shared import Stages

    monkeypatch.setattr(language_id, "WORDS_PER_LANGUAGE", 2)
    rows = [("aa " * 50 + "bb " * 40 + "cc", "x"), ("dd " * 50 + "ee " * 40 + "aa " * 3, "y")]
    with Stages(spark, "test") as stages:
        model = language_id.fit(stages, spark.createDataFrame(rows, "text string, lang string"))
    x, y = (np.exp(model.scores[model.words["aa"]])).tolist()
    assert x > y and y == pytest.approx(3.5 / (93 + 0.5 * len(model.words)))


def test_languages_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    from millrace.llm.queries import op6_language_id

    got = op6_language_id(spark, "/root/testdata/sf0.01").where("held_out").join(docs.where("lang is not null").select("doc_id", "lang"), "doc_id").where("lang_pred != 'und'")
    right, n = got.where("lang_pred = lang").count(), got.count()
    assert n > 100 and right >= 0.9 * n


def auc(scores, truth):
    order = np.argsort(scores, kind="stable")
    ranks = np.empty(len(scores))
    ranks[order] = np.arange(1, len(scores) + 1)
    pos = truth == 1
    return (ranks[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_quality_held_out_beside_shuffled_labels(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    rows = [(r["doc_id"], r["quality"]) for r in labels.where("quality is not null").collect()]
    rng = random.Random(1)
    held = {i for i, _ in rows if rng.random() < 0.3}
    truth = {i: q for i, q in rows if i in held}
    learned = [(i, q) for i, q in rows if i not in held]
    shuffled = list(zip([i for i, _ in learned], rng.sample([q for _, q in learned], len(learned)), strict=True))
    found = []
    for given in (learned, shuffled):
        got = quality.score_quality(docs, spark.createDataFrame(given, "doc_id long, quality int")).collect()
        scores = {r["doc_id"]: r["score"] for r in got}
        found.append(auc(np.array([scores[i] for i in truth]), np.array(list(truth.values()))))
    assert found[0] > 0.9 and found[1] < found[0] - 0.15, found


def test_non_negative_branch_follows_the_gradient():
    """One step of either branch moves the risk that it follows in the right direction."""
    rng = np.random.default_rng(5)
    p, u = rng.normal(1, 1, (60, 4)), rng.normal(0, 1, (80, 4))

    def parts(net, prior):
        x = [np.clip((z - net.mean) / net.scale, -8, 8) for z in (p, u)]
        f_p, f_u = (np.tanh(z @ net.w1 + net.b1) @ net.w2 + net.b2 for z in x)
        return prior * np.logaddexp(0, -f_p).mean(), np.logaddexp(0, f_u).mean() - prior * np.logaddexp(0, f_p).mean()

    before, after = (parts(quality.fit_positive_unlabelled(p, u, 0.5, epochs=n), 0.5) for n in (1, 30))
    assert sum(after) < sum(before)
    # with prior 0.99 on separable data the second part turns negative, and is then pushed back
    p, u = rng.normal(3, 0.1, (60, 4)), np.concatenate((rng.normal(3, 0.1, (20, 4)), rng.normal(-3, 0.1, (60, 4))))
    values = [parts(quality.fit_positive_unlabelled(p, u, 0.99, epochs=n), 0.99)[1] for n in (5, 100, 300)]
    assert min(values) > -0.5
