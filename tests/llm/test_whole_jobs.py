"""Cases in which an operator once did less than its whole job."""

import random

import corpus_pipeline
import numpy as np
import pytest
from millrace.llm import decontaminate, minhash_dedup, quality, token_counts
from millrace.llm.queries import piece_model


def longest_pieces(word, pieces):
    """Greedy longest match over WORD_START and the word with the full vocabulary."""
    left, n = token_counts.WORD_START + word, 0
    while left:
        end = next((e for e in range(len(left), 0, -1) if left[:e] in pieces), 0)
        if not end:
            return 0
        left, n = left[end:], n + 1
    return n


def test_words_without_an_initial_piece_use_the_bare_mark(spark):
    rng = random.Random(6)
    for _ in range(80):
        pieces = {("▁" if rng.random() < 0.3 else "") + "".join(rng.choice("ab") for _ in range(rng.randrange(1, 5))) for _ in range(7)} | {"▁"}
        counter = token_counts.PieceCounter(sorted(pieces))
        for _ in range(60):
            word = "".join(rng.choice("abc" if rng.random() < 0.1 else "ab") for _ in range(rng.randrange(1, 9)))
            assert counter.count(word) == longest_pieces(word, pieces), (word, pieces)
    pieces = set(token_counts.pieces_of(piece_model()))
    words = ["2024-11-27", "7", "ñandú", "the", "12,345.67", "x2024", "日本語のテキスト", "\0"]
    docs = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_pieces"], r["n_unknown"]) for r in token_counts.count_pieces(docs, piece_model()).collect()}
    counts = [longest_pieces(w, pieces) for w in words]
    assert counts[0] > 1 and counts[1] == 2
    assert got == {i: (max(n, 1), int(n == 0)) for i, n in enumerate(counts)}


@pytest.mark.parametrize("n", [30, 399, 400, 2000, 2600])
def test_word_shares_are_over_the_whole_text(n):
    words = [("Title" if k % 10 == 0 else "12" if k % 7 == 3 else "UP" if k % 11 == 5 else "end..." if k % 13 == 8 else "low") for k in range(n)]
    text = "\n".join(" ".join(words[k : k + 10]) for k in range(0, n, 10)).encode()
    shares = [sum(w == "end..." for w in words), sum(w == "UP" for w in words), sum(w in ("Title", "UP") for w in words), sum(w == "12" for w in words)]
    assert quality.features(text)[14:18] == pytest.approx([x / n for x in shares])


@pytest.mark.parametrize("block_words", [100_000, 15, 4])
def test_contamination_judges_each_row_whatever_the_blocks(spark, monkeypatch, block_words):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block_words)
    items = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(4))) for i in range(6)], "item_id long, text string")
    rows = [(None, "so w1x0 w1x1 w1x2 w1x3"), (None, "clean"), (5, "w0x0 w0x1 w0x2 w0x3"), (5, "w5x0 w5x1 w5x2 w5x3 w2x0 w2x1 w2x2 w2x3"), (5, "none"), (6, "twice"), (6, "twice"), (7, None)]
    got = decontaminate.find_contamination(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()
    wanted = [(None, 4, 5, ["1"]), (None, 0, 1, []), (5, 4, 4, ["0"]), (5, 8, 8, ["2", "5"]), (5, 0, 1, []), (6, 0, 1, []), (6, 0, 1, []), (7, 0, 0, [])]
    assert sorted(((r["doc_id"], r["n_hit"], r["n_words"], r["item_ids"]) for r in got), key=str) == sorted(wanted, key=str)


def test_pipeline_decides_by_row(spark, tmp_path):
    rng = random.Random(8)
    a, b, c, d, e = (" ".join("".join(rng.choice(["ta", "ro", "mi", "ken"]) for _ in range(4)) for _ in range(60)) for _ in range(5))
    item = " ".join(f"item{k}" for k in range(13))
    near = lambda text: text + " end"
    # by stage: letterless and null texts; copies; near copies; test items
    rows = [(None, "12 34"), (9, None), (None, a), (7, b), (7, c), (3, c), (3, c), (7, near(b)), (None, near(c)), (None, d), (None, d), (None, near(d)), (8, item), (8, e), (None, item + " x")]
    docs = spark.createDataFrame([(i, t, "aa", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    lettered = rows[2:]
    distinct = [(None, a), (7, b), (3, c), (7, near(b)), (None, near(c)), (None, d), (None, near(d)), (8, item), (8, e), (None, item + " x")]
    apart = [(None, a), (3, c), (8, item), (8, e)]
    ordered = lambda got: sorted(((r["doc_id"], r["text"]) for r in got.select("doc_id", "text").collect()), key=str)
    alone = ordered(corpus_pipeline.distinct_texts(spark, docs.where("text rlike '[a-z]'"), str(tmp_path)))
    assert alone == sorted(distinct, key=str)
    found = []
    for name, stage in corpus_pipeline.STAGES[:4]:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        found.append(ordered(docs))
    assert found[0] == sorted(lettered, key=str) and found[1] == sorted(distinct, key=str)
    for got, known in ((found[2], apart), (found[3], [x for x in apart if x[1] != item])):
        assert [x for x in got if x in apart] == sorted(known, key=str)
        texts = [t for _, t in got]
        assert len([t for t in texts if t in (b, near(b))]) == 1 and len([t for t in texts if t in (d, near(d))]) == 1
        assert len(got) == len(known) + 2 and near(c) not in texts
    assert all(i is None or i == 7 for i, _ in found[3] if (i, _) not in apart)


def test_bitmaps_of_sets_rule_out_no_link():
    rng = np.random.default_rng(5)
    for n, other, shared in ((1, 1, 1), (1, 1, 0), (90, 120, 85), (400, 300, 300), (3000, 2900, 2600), (64, 65, 0), (500, 500, 250)):
        draw = np.unique(rng.integers(0, 1 << 63, n + other - shared + 9, dtype=np.uint64))
        rng.shuffle(draw)
        a, b = draw[:n], draw[n - shared : n - shared + other]
        apart = minhash_dedup._apart(minhash_dedup.parity(a).tobytes(), minhash_dedup.parity(b).tobytes())
        assert apart <= n + other - 2 * shared
        if shared * 2 <= min(n, other) > 9:
            assert 7 * apart > n + other  # sets half alike are ruled out


def test_pairs_of_long_lists_are_ruled_out_before_sets_meet(spark, monkeypatch):
    """One slot leaves no order, so all pairs share a shingle; the tables else grow with what they count."""
    assert [minhash_dedup._slots(n) for n in (0, 1 << 20, 1 << 22, 1 << 25, 1 << 40)] == [1 << 16, 1 << 16, 1 << 18, 1 << 21, 1 << 22]
    monkeypatch.setattr(minhash_dedup, "LEAST_SLOTS", 1)
    monkeypatch.setattr(minhash_dedup, "MOST_SLOTS", 1)
    compared, confirmed = [], minhash_dedup._confirmed

    def counted(stages, sets, pairs):
        compared.append(pairs.count())
        return confirmed(stages, sets, pairs)

    monkeypatch.setattr(minhash_dedup, "_confirmed", counted)
    shared = [f"s{k}" for k in range(66)]
    texts = [" ".join(shared + [f"u{i}x{k}" for k in range(34)]) for i in range(60)]
    texts += [t + " end" for t in texts[::20]]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts, 1)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash_dedup.near_duplicates(docs).collect()}
    assert got == {i: i for i in range(1, 61)} | {61: 1, 62: 21, 63: 41}
    assert sum(compared) < 300  # of 1,953
