"""Corpus operators against brute force on small tables with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import decontaminate, exact_dedup, language_id, line_dedup, minhash_dedup, packing, quality, sharding, suffix_dedup, token_counts
from millrace.llm.queries import piece_model, word_tokenizer
from millrace.llm.shared import Stages, components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


def prose(rng, n):
    return " ".join(rng.choice(["tion", "the", "ouan", "een", "ly", "der", "qué"]) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(7)
    passage, rows = prose(rng, 60), [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "One"), (5, "a b c d"), (6, "a  b\tc d")]
    for i in range(7, 40):
        rows.append((i, prose(rng, rng.randrange(1, 200)) + (passage if i % 3 == 0 else "") + prose(rng, 30)))
    base = rows[20][1].split()
    for i in range(40, 60):
        words = list(base)
        words[rng.randrange(len(words))] = f"w{i}"
        rows.append((i, " ".join(words)))
    rows += [(60, rows[10][1]), (61, rows[10][1] + " \n"), (62, prose(rng, 30_000)), (63, "x" * 5_000), (64, "ab" * 300), (65, "\0" * 150 + "z" * 120)]
    rng.shuffle(rows)
    return rows


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact(spark, corpus):
    import re

    rows = corpus + [(None, "one")]
    got = {r["doc_id"]: r for r in exact_dedup.exact_dedup(frame(spark, rows), bucket_entries=4).collect()}
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    assert len(got) == len(rows)
    for text, ids in groups.items():
        keep = min(i for i in ids if i is not None)
        for i in ids:
            r = got[i]
            assert (r["keep_id"], r["group_size"], r["kept"]) == (keep, len(ids), i == keep)
            assert r["text_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0


@pytest.mark.parametrize("hot_rows", [256, 2])
def test_exact_null_and_repeated_ids_and_clashing_columns(spark, monkeypatch, hot_rows):
    monkeypatch.setattr(exact_dedup, "HOT_ROWS", hot_rows)
    rows = [(None, "a b"), (5, "a\tb"), (5, "a b"), (5, "other"), (9, "other"), (9, None), (None, "x"), *((i, "copy  of\nall") for i in range(20, 60))]
    docs = frame(spark, rows).select("doc_id", "text", *(F.lit("clash").alias(c) for c in ("id", "key", "n", "slot", "bucket", "keep_id", "chain", "sha")))
    got = Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(docs, bucket_entries=2).collect())
    wanted = [(None, 5, 3, False), (5, 5, 3, True), (5, 5, 3, True), (5, 5, 2, True), (9, 5, 2, False), (9, 9, 1, True), (None, None, 1, False)]
    assert got == Counter(wanted + [(i, 20, 40, i == 20) for i in range(20, 60)])


def test_exact_results_come_from_the_index(spark, monkeypatch):
    docs = frame(spark, [(i, f"text {i // 2}") for i in range(40)])
    held = exact_dedup.grow_directory
    half = lambda *a: ((found := held(*a))[0].where("slot % 2 = 0"), found[1])
    monkeypatch.setattr(exact_dedup, "grow_directory", half)
    assert 0 < exact_dedup.exact_dedup(docs, bucket_entries=2).count() < 40


def test_colliding_keys_form_chains(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *c: F.hash(F.length(F.col("text"))).cast("long") if c == ("text",) else F.hash(*c).cast("long"))
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["chain"]) for r in exact_dedup.exact_dedup(frame(spark, [(1, "ab"), (2, "cd"), (3, "ab"), (4, "cd"), (5, "e")])).collect()}
    assert got == {1: (1, 2, 0), 3: (1, 2, 0), 2: (2, 2, 1), 4: (2, 2, 1), 5: (5, 1, 0)}


def test_directory_splits_only_overfull_buckets(spark):
    # half of the keys share their top 6 bits, so their buckets split far beyond the rest
    keys = spark.range(3000).select(F.when(F.col("id") % 2 == 0, F.xxhash64("id")).otherwise(F.shiftrightunsigned(F.xxhash64("id"), 6)).alias("key"))
    with Stages(spark, "test") as stages:
        directory, depth = exact_dedup.grow_directory(stages, keys, 3000, 100)
        found = directory.collect()
    at = {r["slot"]: r for r in found}
    sizes = Counter()
    for k in keys.collect():
        sizes[at[(k["key"] % (1 << 64)) >> (64 - depth)]["bucket"]] += 1
    assert max(sizes.values()) <= 100 and sum(sizes.values()) == 3000
    local = {r["bucket"]: r["local_depth"] for r in found}
    slots = Counter(r["bucket"] for r in found)
    assert all(slots[b] == 1 << (depth - d) for b, d in local.items()) and max(local.values()) == depth > 8 and min(local.values()) < 8
    start = min(local.values())
    parents = Counter()
    for b, n in sizes.items():
        if local[b] > start:
            parents[b >> (depth - local[b] + 1), local[b] - 1] += n
    deepest = {k: n for k, n in parents.items() if k[1] == depth - 1}
    assert all(n > 100 for n in deepest.values())


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    with Stages(spark, "test") as stages:
        got = {r["node"]: r["component"] for r in components(stages, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}


def sets_of(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").replace("\x1c", "\x1c").split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_near_duplicates(spark, corpus):
    got = {r["doc_id"]: r for r in minhash_dedup.near_duplicates(frame(spark, corpus)).collect()}
    sets = {i: sets_of(t) for i, t in corpus}
    comp = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and comp[a] != comp[b]:
                    comp[a] = comp[b] = min(comp[a], comp[b])
                    changed = True
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in got.items()} == {i: (len(s), comp[i], comp[i] == i) for i, s in sets.items()}
    assert minhash_dedup.near_duplicates(empty(spark)).count() == 0


def brute_repeats(rows, limit=suffix_dedup.LIMIT):
    seen, out = set(), {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        b = (t or "").encode()
        hit = bytearray(len(b))
        for s in range(len(b) - limit + 1):
            g = b[s : s + limit]
            if g in seen:
                hit[s : s + limit] = b"\1" * limit
            seen.add(g)
        spans = sum(1 for k in range(len(b)) if hit[k] and (k == 0 or not hit[k - 1]))
        kept = bytes(c for c, h in zip(b, hit, strict=True) if not h)
        out[i] = (len(b), sum(hit), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("shard_segments", [2048, 2])
def test_repeats(spark, corpus, monkeypatch, shard_segments):
    monkeypatch.setattr(suffix_dedup, "SHARD_SEGMENTS", shard_segments)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.remove_repeats(frame(spark, corpus)).collect()}
    assert got == brute_repeats(corpus)
    assert suffix_dedup.remove_repeats(empty(spark)).count() == 0


def test_repeats_null_and_repeated_ids(spark, corpus):
    text = next(t for _, t in corpus if t and 500 < len(t) < 2000)
    rows = [(None, text), (1, text), (1, text), (2, text)]
    got = sorted(((r["doc_id"] or 0), r["n_removed"]) for r in suffix_dedup.remove_repeats(frame(spark, rows)).collect())
    assert got == [(0, 0), (1, 0), (1, 0), (2, len(text.encode()))]


@pytest.mark.parametrize("seed", range(8))
def test_induced_sorting(seed):
    rng = np.random.default_rng(seed)
    s = rng.integers(1, [2, 3, 4, 30, 200, 3, 2, 5][seed] + 1, [50, 400, 3000, 5000, 20000, 1, 2, 9][seed])
    if seed == 4:
        s = np.concatenate((s[:700], s[:700], s[:5000], s[:700]))
    s = np.append(s, 0)
    text = [tuple(s[i : i + 2000]) for i in range(len(s))] if len(s) < 6000 else [s[i:].tobytes() for i in range(0)]
    sa = suffix_dedup.induced_suffix_array(s)
    if text:
        assert sa.tolist() == sorted(range(len(s)), key=text.__getitem__)
    else:
        assert sa.tolist() == suffix_dedup._by_doubling(s).tolist()


@pytest.mark.parametrize("letters", [1, 3, 700])
def test_doubling_orders_all_suffixes(letters):
    rng = np.random.default_rng(letters)
    s = np.append(np.tile(rng.integers(1, letters + 1, 300), 4), 0)
    assert suffix_dedup._by_doubling(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


def test_whole_prefixes_are_those_of_all_prefixes():
    """Places that agree on the first or on the last bytes of a string only are no repeats; the work of a shard with few repeats is one comparison a place."""
    rng = random.Random(21)
    a, b = rng.randbytes(150), rng.randbytes(150)
    raw = a + b + a[:60] + b[60:] + a + bytes([1]) * 120
    s = np.frombuffer(raw + b"\0", np.uint8).astype(np.int64) + 1
    s[-1] = 0
    sa = suffix_dedup.induced_suffix_array(s)
    assert sa.tolist() == suffix_dedup.induced_suffix_array(s.astype(np.uint16)).tolist()
    text = np.frombuffer(raw + b"\0" + bytes(119), np.uint8)
    every, whole = (suffix_dedup.permuted_common_prefixes(text, sa, whole=w) for w in (False, True))
    assert ((every == 100) == (whole == 100)).all() and (every == 100).sum() > 51 and (whole <= every).all()


def test_common_prefixes():
    raw = b"abcabcabcabcabcabcabcabdxabcabcabcabcabc" * 5
    s = np.append(np.frombuffer(raw, np.uint8).astype(np.int64) + 1, 0)
    sa = suffix_dedup.induced_suffix_array(s)
    plcp = suffix_dedup.permuted_common_prefixes(np.frombuffer(raw + b"\0" + bytes(119), np.uint8), sa)
    for a, b in zip(sa[1:].tolist(), sa[:-1].tolist(), strict=True):
        n = 0
        while n < 100 and a + n < len(raw) and b + n < len(raw) and raw[a + n] == raw[b + n]:
            n += 1
        assert plcp[a] == n or max(a, b) + n >= len(raw)


def brute_contamination(docs, items, window=13):
    out = {}
    for i, t in docs:
        words = decontaminate.words_of(t.encode() if t else None)
        hit, found = set(), set()
        for item, text in items:
            ws = decontaminate.words_of(text.encode() if text else None)
            width = min(window, len(ws))
            windows = {tuple(ws[k : k + width]) for k in range(len(ws) - width + 1)} if ws else set()
            for k in range(len(words) - width + 1 if ws else 0):
                if tuple(words[k : k + width]) in windows:
                    hit |= set(range(k, k + width))
                    found.add(str(item))
        out[i] = (len(words), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(words))
    return out


@pytest.mark.parametrize("block_words", [100_000, 30])
def test_contamination(spark, monkeypatch, block_words):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block_words)
    rng = random.Random(5)
    items = [(i, " ".join(rng.choice("abc") for _ in range(n))) for i, n in enumerate([13, 14, 30, 5, 2, 12, 40, 20])] + [(8, None), (9, "?!"), (10, "Été À la, carte"), (11, "Été À la, carte")]
    docs = [(i, " ".join(rng.choice("abcd" if i % 2 else "abcdefgh") for _ in range(rng.randrange(120)))) for i in range(60)]
    docs += [(60, None), (61, ""), (62, "x " * 50 + items[2][1]), (63, "ÉTÉ"), (64, "so Été À LA-carte!"), (65, "y " * 2000 + items[6][1])]
    got = decontaminate.find_contamination(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], sorted(r["item_ids"]), r["contaminated"]) for r in got.collect()} == brute_contamination(docs, items)
    cut = {r["doc_id"]: r["text"] for r in decontaminate.remove_spans(frame(spark, docs), got).collect()}
    assert cut[61] == "" and cut[62].strip() == ("x " * 50).strip() and cut[60] is None
    clean = decontaminate.find_contamination(frame(spark, docs), spark.createDataFrame([], "item_id long, text string"))
    assert clean.where("contaminated or n_hit > 0").count() == 0 and clean.count() == len(docs)


def test_packing(spark, corpus):
    from tokenizers import Tokenizer

    rows = corpus + [(70, "<|endoftext|> it's naïve … 123"), (71, "Á  b\x1cc")]
    got = packing.pack(frame(spark, rows).coalesce(1), word_tokenizer()).collect()
    tokenizer = Tokenizer.from_file(word_tokenizer())
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        assert zlib.crc32(r["token_ids"]) == r["ids_crc32"] and len(r["token_ids"]) == 4 * r["length"]
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for i, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        ps = sorted(pieces[i], key=lambda r: r["start"])
        assert b"".join(p["token_ids"] for p in ps) == np.array(ids, "<u4").tobytes()
        assert all(p["doc_tokens"] == len(ids) for p in ps)
    for ps in sequences.values():
        at = 0
        for p in sorted(ps, key=lambda r: r["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= packing.WINDOW
    assert packing.pack(empty(spark), word_tokenizer()).count() == 0


def test_differencing_balances():
    rng = random.Random(1)
    sizes = [rng.randrange(1, 513) for _ in range(400)]
    sums = [sum(sizes[i] for i in s) for s in packing.balance(sizes)]
    assert sum(sums) == sum(sizes) and max(sums) <= 2048 and len(sums) <= -(-sum(sizes) // 2048) + 1
    assert sorted(i for s in packing.difference([8, 7, 6, 5, 4], 2) for i in s) == [0, 1, 2, 3, 4]


def greedy(word, pieces):
    at, n, prefix = 0, 0, token_counts.WORD_START
    while at < len(word):
        for end in range(len(word), at, -1):
            if prefix + word[at:end] in pieces:
                break
        else:
            return 0
        at, n, prefix = end, n + 1, ""
    return n


def test_piece_counts(spark, corpus):
    rng = random.Random(2)
    for _ in range(60):
        pieces = {("▁" if rng.random() < 0.4 else "") + "".join(rng.choice("ab") for _ in range(rng.randrange(1, 5))) for _ in range(8)}
        counter = token_counts.PieceCounter(sorted(pieces))
        for _ in range(60):
            word = "".join(rng.choice("ab") for _ in range(rng.randrange(1, 9)))
            assert counter.count(word) == greedy(word, pieces), (word, pieces)
    pieces = set(token_counts.pieces_of(piece_model()))
    got = {r["doc_id"]: r for r in token_counts.count_pieces(frame(spark, corpus), piece_model()).collect()}
    for i, t in corpus:
        counts = [greedy(w, pieces) for w in (t or "").split()] if len(t or "") < 4000 else None
        if counts is not None:
            assert (got[i]["n_words"], got[i]["n_pieces"], got[i]["n_unknown"]) == (len(counts), sum(counts) + counts.count(0), counts.count(0))
    assert token_counts.count_pieces(empty(spark), piece_model()).count() == 0


def test_language(spark):
    rng = random.Random(4)
    syllables = {"aa": ["the", "ing", "and"], "bb": ["der", "ung", "sch"], "cc": ["qué", "ción", "los"]}
    rows = [(i, " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(40)), lang) for i, lang in enumerate(list(syllables) * 40)]
    train = spark.createDataFrame(rows[:90] + [(500, None, "aa"), (501, "foo", None)], "doc_id long, text string, lang string")
    test = rows[90:] + [(200, None, None), (201, "12 34 !!", "aa"), (202, "", None), (203, "ungschder", None), (204, "x" * 50_000, None)]
    got = {r["doc_id"]: r for r in language_id.identify(spark.createDataFrame(test, "doc_id long, text string, lang string"), train).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows[90:])
    assert [got[i]["lang_pred"] for i in (200, 201, 202, 203)] == ["und", "und", "und", "bb"]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    nothing = language_id.identify(frame(spark, [(1, "abc")]), empty(spark)).collect()
    assert [(r["lang_pred"], r["score"]) for r in nothing] == [("und", 0.0)]


def test_language_model_backs_off():
    grams = {4: {"<the": 3}, 3: {"<th": 1}, 2: {}, 1: {"z": 2}}
    model = language_id.Model(["x", "y"], {"the": 0}, grams, np.array([[0.0, -1.0], [-2.0, 0.0], [-5.0, -5.0], [-1.0, -1.0]]))
    assert [model.fallback(w) for w in ("them", "thq", "zz", "q")] == [[3], [1], [2, 2], []]
    e = np.exp(-3.0)
    assert model.predict("the thq thq", {}) == ("y", pytest.approx(1 / (1 + e)))
    assert model.predict("zz the", {})[0] == "x" and model.predict("q", {}) == ("x", 0.5)


def test_quality(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(60)) if i % 4 else "!! " * 50) for i in range(400)]
    labels = spark.createDataFrame([(i, 1 if i % 4 else 0) for i in range(150)] + [(None, 1), (3, None), (9999, 1)], "doc_id long, quality int")
    rows += [(1000, None), (1001, ""), (None, "alpha beta"), (5, rows[5][1])]
    got = quality.score_quality(frame(spark, rows), labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    held = [r for r in got if r["doc_id"] is not None and 150 <= r["doc_id"] < 400]
    assert sum(r["predicted"] == (r["doc_id"] % 4 > 0) for r in held) > 0.95 * len(held)
    assert quality.score_quality(frame(spark, rows[:5]), labels.limit(0)).select("score").distinct().collect()[0][0] == quality.PRIOR
    assert quality.score_quality(empty(spark), labels).count() == 0


def test_shard_store(spark, tmp_path):
    docs = frame(spark, [(i, f"text {i}" * 50) for i in range(1000)] + [(None, None), (1, None), (2, "")])
    store = sharding.ShardStore(spark, f"file://{tmp_path}/a store+x", target_bytes=20_000, fanout=2)
    for k in range(3):
        store.append(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(3)) == k).repartition(3))
    before, rows = store.manifest().count(), sorted(map(str, docs.collect()))
    version = store.compact(docs.schema)
    assert version == 4 and store.manifest().count() < before
    assert sorted(map(str, store.snapshot(docs.schema).collect())) == rows == sorted(map(str, store.snapshot(docs.schema, 3).collect()))
    assert sum(r["rows"] for r in store.manifest().collect()) == len(rows)
    with pytest.raises(Exception, match="exist"):
        store.commit(store.manifest(), 2)
    docs.limit(0).write.parquet(f"file://{tmp_path}/a store+x/data/not-committed-yet")
    store.vacuum(keep=2)
    assert store.versions() == [3, 4] and (tmp_path / "a store+x/data/not-committed-yet").exists()
    store.vacuum(retention_seconds=0)
    assert store.versions() == [4] and not (tmp_path / "a store+x/data/not-committed-yet").exists()
    assert sorted(map(str, store.snapshot(docs.schema).collect())) == rows
    # another writer commits between the look at the version and the commit
    looked, seen = store.versions, []
    store.versions = lambda: [4] if not seen.append(1) and len(seen) == 1 else looked()
    store.commit(store.manifest(4), 4)
    seen.clear()
    assert store.append(docs.limit(1)) == 6
    assert sharding.compacted(empty(spark), f"file://{tmp_path}/none").count() == 0


def edits(x, y):
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        row, old = [i], row
        for j, b in enumerate(y, 1):
            row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (a != b)))
    return row[-1]


def normal(line):
    import re

    return re.sub(r"[\s!-/:-@\[-`{-~\d]+", " ", line.lower()).strip()


def edited_groups(forms):
    """The representative of each form's group, linked by edits of a tenth of the longer form at most."""
    group = {f: f for f in forms}
    for x in forms:
        for y in forms:
            most = int(0.1 * max(len(x), len(y)))
            if x < y and group[x] != group[y] and abs(len(x) - len(y)) <= most and edits(x, y) <= most:
                gx, gy = group[x], group[y]
                group = {k: gx if v == gy else v for k, v in group.items()}
    return group


@pytest.mark.parametrize("short_list", [8, 2])
def test_fuzzy_lines(spark, monkeypatch, short_list):
    monkeypatch.setattr(line_dedup, "SHORT_LIST", short_list)
    rng = random.Random(12)
    base = [prose(rng, 40) for _ in range(12)]
    docs = [(i, "\n".join(rng.choice(base) if rng.random() < 0.5 else " ".join([*(w := rng.choice(base).split())[:-1], w[-1] + "x"]) for _ in range(5))) for i in range(40)]
    docs += [(100, None), (101, ""), (102, "\n\n--\n"), (103, "a b c\nA  b, c!\na b d"), (None, base[0]), (40, base[0].upper() + "\n" + prose(rng, 3000))]
    docs += [(200 + i, f"{base[0]} {'abcdefghij'[i]}") for i in range(10)]
    clashing = frame(spark, docs).select("doc_id", "text", *(F.lit(1).alias(c) for c in ("id", "h", "pos", "norm", "node", "lines", "dropped")))
    got = {r["doc_id"]: r for r in line_dedup.fuzzy_lines(clashing).collect()}
    places = [(i, p, normal(x), x) for i, t in docs if i is not None and t is not None for p, x in enumerate(t.split("\n"))]
    forms = sorted({n for _, _, n, _ in places if n})
    group = edited_groups(forms)
    keep = {}
    for i, p, n, _ in sorted(places):
        if n:
            keep.setdefault(group[n], (i, p))
    for i, t in docs:
        if i is None or t is None:
            assert got[i]["text"] == t and got[i]["n_removed"] == 0
            continue
        kept = [x for j, p, n, x in places if j == i and (not n or keep[group[n]] == (j, p))]
        assert (got[i]["text"], got[i]["n_lines"]) == ("\n".join(kept), t.count("\n") + 1)
    assert len(set(group.values())) < len(forms)
    assert line_dedup.fuzzy_lines(empty(spark)).count() == 0


def test_fuzzy_lines_repeated_ids(spark):
    line = "the same line stands in all of these texts"
    rows = [(1, line), (1, line), (1, line + "\nmore words of its own"), (None, line), (None, line)]
    got = line_dedup.fuzzy_lines(frame(spark, rows)).collect()
    assert Counter((r["doc_id"], r["n_removed"]) for r in got) in (Counter({(1, 0): 2, (1, 1): 1, (None, 0): 2}), Counter({(1, 1): 2, (1, 0): 1, (None, 0): 2}))


@pytest.mark.parametrize("words", [6, 12, 40])
def test_fuzzy_lines_find_one_changed_letter(spark, words):
    rng = random.Random(words)
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randrange(3, 9)))
    lines = [[word() for _ in range(words)] for _ in range(300)]
    changed = []
    for w in lines:
        k = rng.randrange(words)
        changed.append(w[:k] + [w[k][:1] + rng.choice(letters) + w[k][2:]] + w[k + 1 :])
    docs = [(i, " ".join(w)) for i, w in enumerate(lines)] + [(1000 + i, " ".join(w)) for i, w in enumerate(changed)]
    assert line_dedup.fuzzy_lines(frame(spark, docs)).agg(F.sum("n_removed")).first()[0] >= (295 if words > 6 else 270)


def test_fuzzy_lines_recall_on_the_test_data(spark):
    """Against edit distance alone, over pairs of lines of up to 400 characters that share two neighbouring words."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    forms = sorted({n for r in docs.collect() for x in (r["text"] or "").split("\n") if 10 <= len(n := normal(x)) <= 400})
    posts = defaultdict(set)
    for f in forms:
        ws = f.split()
        for g in zip(ws, ws[1:], strict=False):
            posts[g].add(f)
    pairs = {(x, y) for fs in posts.values() if len(fs) <= 40 for x in fs for y in fs if x < y and abs(len(x) - len(y)) <= 0.1 * max(len(x), len(y))}
    near = []
    for x, y in pairs:
        apart = (Counter(x) - Counter(y)).total(), (Counter(y) - Counter(x)).total()
        if max(apart) <= int(0.1 * max(len(x), len(y))) and edits(x, y) <= int(0.1 * max(len(x), len(y))):
            near.append((x, y))
    lines = spark.createDataFrame([(i, f, len(f)) for i, f in enumerate(forms)], "node long, norm string, len int")
    with Stages(spark, "test") as stages:
        classes = stages.write(lines, "classes")
        posts = stages.write(line_dedup.signatures(classes), "posts")
        found, _ = line_dedup.candidates(stages, posts)
        links = {(r["a"], r["b"]) for r in line_dedup.within_edits(stages, classes, found).collect()}
    number = {f: i for i, f in enumerate(forms)}
    got = sum(tuple(sorted((number[x], number[y]))) in links for x, y in near)
    assert len(near) > 100 and got >= 0.9 * len(near)


def test_crowded_lists_compare_only_lines_that_letters_allow(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))
    lines = [" ".join(word() for _ in range(20)) for _ in range(40)]
    lines.append(lines[5][:60] + "é" + lines[5][61:])
    compared, plain = [], line_dedup.within_edits
    monkeypatch.setattr(line_dedup, "within_edits", lambda stages, classes, pairs: compared.append(pairs.count()) or plain(stages, classes, pairs))
    with Stages(spark, "test") as stages:
        classes = stages.write(spark.createDataFrame([(i, x, len(x)) for i, x in enumerate(lines)], "node long, norm string, len int"), "classes")
        posts = stages.write(classes.select(F.lit(1).cast("long").alias("key"), "node", "len", F.lit(0).cast("long").alias("simhash")), "posts")
        assert sorted(map(tuple, line_dedup._groups(stages, classes, posts).collect())) == [(5, 5), (40, 5)]
    assert compared == [40, 1]


def test_bitmaps_rule_out_no_line_within_edits(spark):
    """Lines of 70 to 80 letters have bitmaps of 16 or 32 numbers, long ones several hundred; all have a tenth of their letters changed, left out or added."""
    rng = random.Random(6)
    rows = []
    for size in [*range(60, 100), 700, 3000] * 3:
        x = [rng.choice("abcdé\u2028\U0001f600 ") for _ in range(size)]
        y = list(x)
        for _ in range(size // 10 if size > 80 else 6):
            at, way = rng.randrange(len(y)), rng.randrange(3)
            y[at : at + (way != 2)] = [rng.choice("xyz")] if way else []
        rows += [(len(rows), "".join(x), len(x)), (len(rows) + 1, "".join(y), len(y))]
    lines = spark.createDataFrame(rows, "node long, norm string, len int")
    held = lines.join(line_dedup.sketches(lines), "node")
    other = held.select((F.col("node") - 1).alias("node"), F.col("len").alias("len_x"), F.col("sketch").alias("sketch_x"))
    pairs = held.where("node % 2 = 0").join(other, "node")
    assert pairs.count() == len(rows) // 2 == pairs.where(line_dedup._within_sketch("x")).count()
    assert pairs.where("size(sketch) != size(sketch_x)").count() > 0


def test_remembered_stretches_equal_the_plain_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    cached, plain = packing.CachedTokenizer(path, most=3), Tokenizer.from_file(path)
    texts = ["", "  ", "One two. Three, two\nthree.", "a\x01b c \x01 \x01\x01 d", "<|endoftext|> Hi <| x|>", "a\u0301 \u0301x \u03a3\u0391\u03a3", "don't 12a3 don't"]
    for text in texts * 2:
        assert np.frombuffer(cached.encode(text.encode()), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


def test_members_of_long_lists_all_meet(spark):
    """One list whose smallest is like none of the others; 2 and 3 have no other block in common."""
    row = lambda key, node, text, simhash=0: (key, node, len(text), simhash, text)
    texts = {1: "a" * 40, 2: "b" * 40, 3: "b" * 39 + "c", **{k: chr(100 + k) * 40 for k in range(4, 16)}}
    table = spark.createDataFrame([row(7, k, t) for k, t in texts.items()], "key long, node long, len int, simhash long, norm string")
    with Stages(spark, "test") as stages:
        classes = stages.write(table.select("node", "len", "norm"), "classes")
        posts = stages.write(table.select("key", "node", "len", "simhash"), "posts")
        assert [tuple(r) for r in line_dedup._groups(stages, classes, posts).orderBy("node").collect()] == [(2, 2), (3, 2)]


def test_frequent_words_make_no_long_lists(spark):
    """Half of all words are the same one; two lines that differ in a word, and two in a blank, still meet."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))
    lines = [" ".join(word() if rng.random() < 0.5 else "the" for _ in range(60)) for _ in range(200)]
    lines += [lines[0][:100] + "é" + lines[0][101:], lines[1].replace(" ", "", 1)]
    classes = spark.createDataFrame([(i, x, len(x)) for i, x in enumerate(lines)], "node long, norm string, len int")
    with Stages(spark, "test") as stages:
        posts = stages.write(line_dedup.signatures(classes), "posts")
        assert posts.groupBy("key").count().agg(F.max("count")).first()[0] <= 20
        groups = line_dedup._groups(stages, classes, posts).where("node != component").collect()
        assert sorted(map(tuple, groups)) == [(200, 0), (201, 1)]


def test_stretches_rule_out_no_line_within_edits(spark):
    rng = random.Random(9)
    rows = []
    for i in range(40):
        x = "".join(rng.choice("abcdé\U0001f600 ") for _ in range(200))
        y = list(x)
        for at in rng.sample(range(200), 20):
            y[at] = rng.choice("xyz")
        rows.append((2 * i, x, 2 * i + 1, "".join(y)))
    pairs = spark.createDataFrame(rows, "a long, x string, b long, y string")
    assert pairs.where(f"{line_dedup._stretches('x', 'y')} <= 5 * 20").count() == 40
    turned = pairs.where(f"{line_dedup._stretches('x', 'reverse(x)')} <= 5 * 20")
    assert turned.count() == 0


def test_members_of_long_lists_meet_whatever_their_simhashes(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHORT_LIST", 2)
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=7))
    other, line = (" ".join(word() for _ in range(8)) for _ in range(2))
    rows = [(1, other), (2, line), (3, line[:30] + "z" + line[31:])]
    classes = spark.createDataFrame(rows, "node long, norm string")
    posts = spark.createDataFrame([(1, n, len(t), (1 << 60) - 1 if n == 3 else 0) for n, t in rows], "key long, node long, len long, simhash long")
    with Stages(spark, "test") as stages:
        found = {tuple(r) for r in line_dedup._groups(stages, classes, posts).collect()}
    assert found == {(2, 2), (3, 2)}
