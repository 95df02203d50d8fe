"""Fill-in-the-middle, token files and hard negatives against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import fill_middle, hard_negatives, queries, token_files

FOLDER = "/root/testdata/sf0.001"
UNITS = {"line": r"[^\n]*\n|[^\n]+", "word": r"[^ \t\n\v\f\r]*[ \t\n\v\f\r]+|[^ \t\n\v\f\r]+", "character": r"(?s)."}


def sql_rows(name, folder=FOLDER):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got = con.execute(queries.oracle_sql()[name])
    return [c[0] for c in got.description], got.fetchall()


def same_as_sql(spark, name, folder=FOLDER):
    columns, wanted = sql_rows(name, folder)
    got = queries.queries()[name](spark, folder).select(*columns).collect()
    assert len(got) == len(wanted) and Counter(map(tuple, got)) == Counter(wanted)


def test_fill_middle_sql(spark):
    same_as_sql(spark, "op11_fill_middle")


def by_hand(key, text, unit, seed, fim, spm):
    text = text or ""
    units = re.findall(UNITS[unit], text)
    n, d = len(units), hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(d[k : k + 8], 16) for k in (0, 8, 16, 24)]
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= fim:
        return key, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    form = "spm" if h[3] % 100 < spm else "psm"
    return key, n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize(("unit", "seed", "fim", "spm"), [("line", 7, 100, 50), ("word", 3, 60, 0), ("character", 11, 100, 100)])
def test_fill_middle_by_hand(spark, unit, seed, fim, spm):
    rng = random.Random(seed)
    alphabet = ["a", "\n", " ", "\t", "é", "日", "😀", "<", ">", "P", "S", "M", "\r\n", "\0", "<<S", " "]
    texts = [None, "", "\n", "\n\n", "x", "a\n", "no end", "<P>", "a<M>\nb", "<P", "P>", "<<S>", "<S<P>>", "a\r\n", "long " * 40_000, "y\n" * 30_000, "z" * 100_000]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 30))) for _ in range(300)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "null id\nline"), (None, "null id\nline"), (5, "again\nb\nc"), (-3, "a\nb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", *(F.lit("clash").alias(c) for c in ("id", "n", "form", "output")))
    found = fill_middle.fill_in_middle(docs, unit=unit, seed=seed, fim_percent=fim, spm_percent=spm).withColumn("back", fill_middle.restored())
    got = [tuple(r) for r in found.collect()]
    assert Counter(r[:-1] for r in got) == Counter(by_hand(k, t, unit, seed, fim, spm) for k, t in rows)
    assert Counter((r[0], r[-1]) for r in got) == Counter((k, t or "") for k, t in rows)
    assert fill_middle.fill_in_middle(docs.limit(0)).count() == 0


def test_fill_middle_keeps_bytes_that_are_no_text(spark):
    docs = spark.sql("SELECT 4L AS doc_id, cast(X'61FF0A62C3' AS string) AS text")
    wanted = by_hand(4, b"a\xff\nb\xc3".decode("utf-8", "surrogateescape"), "line", 7, 100, 50)[-1].encode("utf-8", "surrogateescape")
    assert fill_middle.fill_in_middle(docs).select(F.sha2("output", 256)).first()[0] == hashlib.sha256(wanted).hexdigest()


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.word_tokenizer())


@pytest.mark.parametrize("kind", ["empty", "one", "twins", "words", "wide", "noise"])
def test_grammar_round_trip_and_spans(kind):
    rng = np.random.default_rng(3)
    ids = {
        "empty": np.zeros(0), "one": [7], "twins": [5] * 999, "words": np.concatenate([[3, 9, 4, 4, 4, 1][: rng.integers(1, 7)] for _ in range(900)]),
        "wide": rng.integers(0, 1 << 32, 9)[rng.integers(0, 9, 3000)], "noise": rng.integers(0, 50_000, 60_000),
    }[kind]
    ids = np.asarray(ids, np.uint32)
    g = token_files.compress(ids, least_count=2, least_gain=0.0001)
    assert (g.ids() == ids).all() and len(g.lengths) == len(g.rules)
    n = len(g.terminals)
    assert [len(g.expand(np.array([n + k]))) for k in range(len(g.rules))] == g.lengths.tolist()
    for _ in range(40):
        a, b = sorted(rng.integers(0, len(ids) + 1, 2).tolist())
        assert (g.span(a, b) == ids[a:b]).all()
    if kind in ("twins", "words"):
        assert len(g.symbols) + 2 * len(g.rules) < len(ids) / 3


def ids_by_hand(rows, end_id=1):
    t, start, out = tokenizer(), 0, []
    for k, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):  # stable: rows of one id keep the table's order
        ids = [*t.encode(text or "", add_special_tokens=False).ids, end_id]
        out.append((k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("block_ids", [1 << 19, 64, 1])
def test_token_files(spark, tmp_path, block_ids):
    rng = random.Random(block_ids)
    words = ["the", "Cat's", "\n", "<|endoftext|>", "x1 2", "日本", "!", "é", "quickly"]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 60)))) for k in rng.sample(range(-50, 4000), 120)]
    rows += [(None, "no id"), (None, None), (4000, "a long one " * 400), (4001, ""), (4002, None), (4003, "same"), (4003, "same"), (4003, "same id, other text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).select("*", *(F.lit("clash").alias(c) for c in ("id", "part", "n", "place")))
    token_files.write_token_files(docs, f"{tmp_path}/t", queries.word_tokenizer(), block_ids=block_ids)
    got = [tuple(r) for r in token_files.read_token_files(spark, f"{tmp_path}/t").collect()]
    assert Counter(got) == Counter(ids_by_hand(rows))
    some = {r["doc_id"]: r["token_ids"] for r in token_files.read_documents(spark, f"{tmp_path}/t", [4000, 4001, -9999]).collect()}
    t = tokenizer()
    assert some == {4000: [*t.encode("a long one " * 400, add_special_tokens=False).ids, 1], 4001: [1]}


def test_token_files_of_nothing(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    token_files.write_token_files(docs, f"{tmp_path}/t", queries.word_tokenizer())
    assert token_files.read_token_files(spark, f"{tmp_path}/t").count() == 0


def test_token_files_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    got = queries.op12_token_files(spark, FOLDER).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert Counter(map(tuple, got)) == Counter(ids_by_hand(rows))


@pytest.mark.parametrize("folder", [FOLDER, "/root/testdata/sf0.01"])
def test_hard_negatives_sql(spark, folder):
    same_as_sql(spark, "op13_hard_negatives", folder)


def negatives_by_hand(rows, every, positives, negatives, low, high, scale):
    dims = max((len(x) for _, x, _ in rows if x is not None), default=0)
    kept = []
    for i, x, label in rows:
        if label is not None and x is not None and all(v is not None and math.isfinite(v) for v in x):
            kept.append((i, [max(-(1 << 23), min(1 << 23, math.floor(scale * v))) for v in x] + [0] * (dims - len(x)), label))
    best = lambda found, most: sorted(found, key=lambda r: (-r[0], r[1] is None, r[1] or 0))[:most]
    for a, (i, x, label) in enumerate(kept):
        if i is None or i % every:
            continue
        score = [(sum(p * q for p, q in zip(x, y, strict=True)), j, k, other) for k, (j, y, other) in enumerate(kept)]
        for s, j, _, _ in best([r for r in score if r[3] == label and r[2] != a], positives):
            far = best([r for r in score if r[3] != label and low * s <= 100 * r[0] <= high * s], negatives)
            yield from ((i, j, k + 1, r[1], s, r[0]) for k, r in enumerate(far))


@pytest.mark.parametrize("seed", range(4))
def test_hard_negatives_by_hand(spark, monkeypatch, seed):
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", [8192, 20][seed % 2])
    monkeypatch.setattr(hard_negatives, "ANCHOR_BYTES", [2 << 20, 100][seed % 2])
    monkeypatch.setattr(hard_negatives, "SAMPLE_ROWS", [4096, 5][seed // 2])
    rng = random.Random(seed)
    vector = lambda n=6: [rng.choice([rng.gauss(0.2, 0.5), rng.randrange(-2, 3) / 4]) for _ in range(n)]
    rows = [(k, vector(), rng.randrange(4)) for k in range(150)]
    rows += [(k, [0.5] * 6, 0 if k < 230 else 1) for k in range(200, 260)]  # a hot vector
    rows += [(300, None, 1), (310, vector(), None), (320, [0.1, None, 0.0, 0.0, 0.0, 0.0], 2), (330, [float("nan")] * 6, 1), (340, [float("inf")] * 6, 1), (350, [], 3), (360, vector(2), 1)]
    rows += [(None, vector(), 1), (None, vector(), 2), (370, vector(), 7), (380, [1e30, -1e30, 0.0, 0.0, 0.0, 0.0], 1), (10, vector(), 1), (10, vector(), 1), (-20, vector(), -1)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").select("*", *(F.lit("clash").alias(c) for c in ("id", "place", "x", "score", "rank")))
    asked = {"every": 10, "positives": 3, "negatives": 4, "low": 20, "high": 95, "scale": 16.0}
    got = hard_negatives.mine(docs.repartition(3), anchors_every=10, positives=3, negatives=4, low_percent=20, high_percent=95, scale=16.0, cells=8).collect()
    assert Counter(map(tuple, got)) == Counter(negatives_by_hand(rows, *asked.values()))
    assert len(got) > 100
    assert hard_negatives.mine(docs.limit(0)).count() == 0


def test_few_rows_are_scored_exactly(spark, monkeypatch):
    """Bounds leave only a small part of the rows to exact scores."""
    rng = np.random.default_rng(1)
    n, dims = 4000, 32
    v = np.clip(np.floor(256 * rng.normal(0, 0.2, (n, dims))), -(1 << 23), 1 << 23).astype(np.int64)
    edges = hard_negatives.fit_edges(v[:1000], hard_negatives.CELLS)
    code = np.column_stack([np.searchsorted(edges[d], v[:, d], "right") for d in range(dims)]).astype(np.uint8)
    table = pa.table({"place": np.arange(n), "id": np.arange(n), "label": np.arange(n) % 5, "code": [c.tobytes() for c in code], "vector": [x.astype("<i4").tobytes() for x in v]})
    block = hard_negatives.Block(table, dims, edges)
    low, high = block.bounds(v[:3], slice(None))
    exact = block.vectors.astype(np.int64) @ v[:3].T
    assert (low <= exact).all() and (exact <= high).all()
    scored = []
    held = block.scores
    block.scores = lambda rows, a: (scored.append(len(rows)), held(rows, a))[1]
    some = hard_negatives.Anchors(np.arange(3), np.arange(3) % 5, v[:3])
    best = {}
    hard_negatives._look_for_positives(block, some, best, 5)
    assert sum(scored) < 0.1 * 3 * n / 5
    some.windows = [{int(s): (-(-30 * int(s) // 100), 90 * int(s) // 100) for s in best[a, 0].score} for a in range(3)]
    scored.clear()
    hard_negatives._look_for_negatives(block, some, {}, 10)
    assert sum(scored) < 0.2 * 3 * n


def texts_of_one_id(rng):
    a, b, c = (" ".join("".join(rng.choice(["ta", "ro", "mi", "ken"]) for _ in range(4)) for _ in range(70)) for _ in range(3))
    return [(1, a), (2, a), (7, a), (7, b), (9, b), (7, c), (None, b), (7, c), (3, None)], (a, b, c)


def test_suffix_dedup_keeps_the_first_of_every_text_whatever_its_id(spark):
    from millrace.llm import suffix_dedup

    rows, (a, b, c) = texts_of_one_id(random.Random(2))
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in suffix_dedup.remove_repeats(docs).collect())
    n = {x: len(x.encode()) for x in (a, b, c)}
    assert got == Counter([(1, n[a], 0), (2, n[a], n[a]), (7, n[a], n[a]), (7, n[b], 0), (9, n[b], n[b]), (7, n[c], 0), (None, n[b], 0), (7, n[c], 0), (3, 0, 0)])


def test_near_duplicates_judge_rows_not_ids(spark):
    from millrace.llm import minhash_dedup

    rows, _ = texts_of_one_id(random.Random(2))
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).withColumn("own", F.lit("clash")).withColumn("place", F.lit("clash"))
    got = Counter((r["doc_id"], r["component_id"], r["kept"]) for r in minhash_dedup.near_duplicates(docs).collect())
    assert got == Counter([(1, 1, True), (2, 1, False), (7, 1, False), (7, 7, True), (9, 7, False), (7, 7, True), (None, None, False), (7, 7, True), (3, 3, True)])


def test_letters_by_range_are_letters_by_category():
    import unicodedata

    from millrace.llm import language_id

    for c in map(chr, range(0x2C2)):
        low = c.lower()
        wanted = [x for x in low if unicodedata.category(x)[0] == "L"]
        if all(ord(x) < 0x2C2 for x in low):
            assert "".join(language_id.letter_words(c)) == "".join(wanted), c
    assert language_id.letter_words("Ünï²x a1b_c ×ÿ ˁz من x́y") == ["ünï", "x", "a", "b", "c", "ÿ", "ˁz", "من", "x́y"]
