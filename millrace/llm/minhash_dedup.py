"""Near-duplicates by MinHash signatures and an inverted join on signature coordinates."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import Stages, by_row, components, giving_back, own_ids

SHINGLE_WORDS = 5
#: Links have 100 * intersection >= 75 * union.
LINK_PERCENT = 75
COORDINATES = 128
#: A pair at similarity 0.75 agrees in fewer of 128 coordinates with probability about 1e-7.
MATCHES = 70
#: The tables of counts that order pairs of coordinate and value, and the shingles of documents that meet again, from rare to frequent
#: have a slot for about so many of them, within these powers of two.
SLOT_ELEMENTS = 32
LEAST_SLOTS, MOST_SLOTS = 1 << 16, 1 << 22
#: Posting lists up to this length pair their members; longer ones meet on rare shingles.
SHORT_LIST = 32
#: The most ids that are sent to every executor in place of a shuffle of the texts: 16 MB, and some 64 MB as a hash table.
BROADCAST_IDS = 2_000_000

_MIX = np.uint64(0x9E3779B97F4A7C15)
_FOLD = np.uint64(0xFF51AFD7ED558CCD)


#: One random number per byte, 0 for the six blanks; a word's hash is a polynomial in _BASE over them.
_BYTE = np.random.default_rng(41).integers(1, 1 << 63, 256, dtype=np.uint64)
_IN_WORD = np.ones(256, bool)
_IN_WORD[[0x20, *range(0x09, 0x0E)]] = False
_BASE = 0xD6E8FEB86659FD93
_CHUNK = 1 << 18


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _BASE and of its inverse modulo 2^64."""
    both = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        both.append(np.multiply.accumulate(p))
    return both[0], both[1]


def word_hashes(text: bytes | None) -> np.ndarray:
    """64-bit hashes of the words of a text, A-Z lower-cased."""
    text, parts, at = (text or b"").lower(), [], 0
    while at < len(text):
        end = at + _CHUNK
        while end < len(text) and _IN_WORD[text[end]]:
            end += 1
        a = np.frombuffer(text, np.uint8)[at:end]
        at = end
        inside = np.zeros(len(a) + 2, np.int8)
        inside[1:-1] = _IN_WORD[a]
        edge = np.diff(inside)
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        power, inverse = _powers(_CHUNK if len(a) <= _CHUNK else 1 << len(a).bit_length())
        total = np.zeros(len(a) + 1, np.uint64)
        np.cumsum(_BYTE[a] * power[: len(a)], out=total[1:])
        h = (total[last] - total[first]) * inverse[first]
        h ^= h >> np.uint64(32)
        h *= _FOLD
        h ^= h >> np.uint64(29)
        parts.append(h)
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


def shingle_set(text: bytes | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the 5-word shingles; fewer words make one shingle, none make no shingle."""
    h = word_hashes(text)
    if not len(h):
        return h
    width = min(SHINGLE_WORDS, len(h))
    s = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        s = (s ^ h[i : len(h) - width + 1 + i]) * _MIX
        s ^= s >> np.uint64(31)
    s *= _FOLD
    s ^= s >> np.uint64(33)
    s.sort()
    return s[np.concatenate(([True], s[1:] != s[:-1]))]


@lru_cache(maxsize=4)
def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_231)
    return (rng.integers(0, 1 << 32, n, dtype=np.uint32) | np.uint32(1))[:, None], rng.integers(0, 1 << 32, n, dtype=np.uint32)[:, None]


def signature(shingles: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    """The least permuted shingle per coordinate."""
    a, b = _permutations(coordinates)
    h = (shingles >> np.uint64(16)).astype(np.uint32)
    least = np.full(coordinates, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(h), 1024):
        block = h[None, at : at + 1024] * a
        block += b
        np.minimum(least, block.min(axis=1), out=least)
    return least


def _elements(sig: np.ndarray) -> np.ndarray:
    """64-bit keys of the (coordinate, value) pairs of signatures, one signature a row."""
    e = sig.astype(np.uint64) | (np.arange(1, sig.shape[1] + 1, dtype=np.uint64) << np.uint64(32))[None, :]
    e *= _MIX
    e ^= e >> np.uint64(29)
    e *= _FOLD
    e ^= e >> np.uint64(32)
    return e


@giving_back
def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, key, sig = [], [], []
        for text in batch.column(1).to_pylist():
            s = shingle_set(text)
            n.append(len(s))
            key.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            sig.append(signature(s).tobytes() if len(s) else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(sig, pa.binary())], ["id", "n_shingles", "set_key", "sig"])


def _matrix(column: pa.Array, kind: type = np.uint32) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _slots(elements: int) -> int:
    """Size of the table of counts for so many elements: a power of two."""
    return min(MOST_SLOTS, max(LEAST_SLOTS, 1 << (elements // SLOT_ELEMENTS).bit_length()))


def _counted(counts: np.ndarray) -> pa.RecordBatch:
    used = np.flatnonzero(counts)
    return pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], ["slot", "n"])


def _count_slots(slots: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(slots, np.int64)
        for batch in batches:
            if len(batch):
                np.add.at(counts, (_elements(_matrix(batch.column(0))) % np.uint64(slots)).astype(np.int64).ravel(), 1)
        yield _counted(counts)

    return run


def _post(counts, prefix: int):
    """Posts each signature under its `prefix` rarest coordinate-value pairs."""

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = np.uint64(len(counts.value))
        for batch in batches:
            for part in range(0, len(batch), 2000):
                rows = batch.slice(part, 2000)
                e = _elements(_matrix(rows.column(2)))
                order = np.argsort(counts.value[(e % slots).astype(np.int64)], axis=1, kind="stable")[:, :prefix]
                key = np.take_along_axis(e, order, axis=1).view(np.int64).ravel()
                ids, n = (np.repeat(rows.column(i).to_numpy(zero_copy_only=False), order.shape[1]) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids), pa.array(n)], ["key", "id", "n"])

    return run


@giving_back
def _low_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Signatures as the lowest byte of each coordinate, all that pairs carry."""
    for batch in batches:
        low = [m.tobytes() for m in _matrix(batch.column(1)).astype(np.uint8)] if len(batch) else []
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(low, pa.binary())], ["id", "low"])


@giving_back
def _agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures agree in the lowest bytes of MATCHES coordinates or more: all that agree in so many, and hardly another."""
    for batch in batches:
        if len(batch):
            same = (_matrix(batch.column(2), np.uint8) == _matrix(batch.column(3), np.uint8)).sum(axis=1) >= MATCHES
            mask = pa.array(same)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])


def parity(s: np.ndarray) -> np.ndarray:
    """A bitmap of two to four bits a shingle, a power of two in length, in which each shingle turns a bit over.

    Bitmaps of two sets, the longer one's halves laid over each other by exclusive or, differ in as many bits as shingles are in one set only, at most.
    """
    size = max(64, 1 << (2 * len(s) - 1).bit_length())
    return np.packbits(np.bincount(((s >> np.uint64(20)) % np.uint64(size)).astype(np.int64), minlength=size).astype(np.uint8) & 1)


@giving_back
def _parities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [np.frombuffer(s, np.uint64) for s in batch.column(1).to_pylist()]
        columns = [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([parity(s).tobytes() for s in sets], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["id", "n", "bits"])


def _apart(x: bytes, y: bytes) -> int:
    """Shingles that are in one of two sets only, at least, by their bitmaps."""
    p, q = sorted((np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)), key=len)
    while len(p) < len(q):
        q = q[: len(q) // 2] ^ q[len(q) // 2 :]
    return int(np.bitwise_count(p ^ q).sum())


@giving_back
def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that may link by their bitmaps: sets of n and m that do differ in (n + m) / 7 shingles at most."""
    for batch in batches:
        a, b, n, m, x, y = (batch.column(i).to_pylist() for i in range(6))
        mask = pa.array([7 * _apart(p, q) <= i + j for i, j, p, q in zip(n, m, x, y, strict=True)], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])


@giving_back
def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 100):
            part = batch.slice(at, 100)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingle_set(t).tobytes() for t in part.column(1).to_pylist()], pa.binary())], ["id", "shingles"])


def _count_shingles(slots: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(slots, np.int64)
        for batch in batches:
            for s in batch.column(0).to_pylist():
                np.add.at(counts, (np.frombuffer(s, np.uint64) % np.uint64(slots)).astype(np.int64), 1)
        yield _counted(counts)

    return run


def _post_shingles(counts):
    """Posts a set (id, component, shingles) under its rarest shingles.

    Sets of n and m that pass have ceil(3/7 (n + m)) in common, which is ceil(3/4 n) or more, so they share one of the first
    n - common + 1 of the one and m - common + 1 of the other.
    """

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = np.uint64(len(counts.value))
        for batch in batches:
            keys, ids, comps, ns, places = [], [], [], [], []
            for i, c, raw in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                s = np.frombuffer(raw, np.uint64)
                n = len(s)
                s = s[np.lexsort((s, counts.value[(s % slots).astype(np.int64)]))[: n - (3 * n + 3) // 4 + 1]]
                keys.append(s.view(np.int64))
                places.append(np.arange(len(s)))
                for x, v in ((ids, i), (comps, c), (ns, n)):
                    x.append(np.full(len(s), v, np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, ids, comps, ns, places)], ["key", "id", "c", "n", "place"])

    return run


def _slot_counts(stages: Stages, rows: DataFrame, count, slots: int):
    """A table of counts for the executors, a byte a slot: the eighths of powers of two that a count reaches.

    Rows are counted in about two tasks a core, so that tasks' tables don't outgrow the rows.
    """
    spark = rows.sparkSession
    counted = rows.coalesce(2 * spark.sparkContext.defaultParallelism).mapInArrow(count(slots), "slot long, n long")
    power = F.least(F.lit(255), F.floor(8 * F.log2(F.sum("n")))).cast("short").alias("power")
    powers = np.zeros(slots, np.uint8)
    counted = stages.write(counted.groupBy("slot").agg(power).select(F.col("slot").cast("int").alias("slot"), "power"), "counts")
    for batch in counted.toArrow().to_batches():
        powers[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    stages.drop(counted)
    return spark.sparkContext.broadcast(powers)


def _few(ids: DataFrame) -> DataFrame:
    """The ids, to be sent to every executor where they are few."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


@giving_back
def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = np.concatenate((p, q))
            both.sort()
            common = int((both[1:] == both[:-1]).sum())
            keep.append(100 * common >= LINK_PERCENT * (len(both) - common))
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id, kept.

    1. Signatures of 128 coordinates over the whole text; equal shingle sets form a class with one representative.
    2. A signature agreeing with another in MATCHES coordinates shares a pair among its 128 - MATCHES + 1 first
       ones in any common order; from rare to frequent, pairs that many documents share are skipped.
    3. In each posting list all members meet the smallest first: matching sizes, MATCHES agreeing coordinates and the
       similarity of the full sets make a link.  A large group of near copies costs about one pair a member.
    4. Lists that then still hold several components: short ones pair their members across components; members
       of long ones meet across components where their full sets share one of their rarest shingles, which a
       pair that passes must, and bitmaps of the sets don't rule the pair out.  No link between two components is lost.

    Texts that are null, empty or blank have no shingles and link with nothing; fewer than five words form one
    shingle.  Rows with a null id are returned with a null component, not kept, and link with nothing.
    Rows that repeat an id are documents of their own, whatever their texts; a component bears its smallest id, and all rows with
    that id in it are kept.  An empty table gives no rows.  Other columns are not read.
    """
    spark = docs.sparkSession
    with Stages(spark, "minhash") as stages:
        texts, names = by_row(stages, docs, id_col, text_col)
        signed = stages.write(texts.mapInArrow(_sign, "id long, n_shingles long, set_key binary, sig binary"), "signatures")
        classes = stages.write(
            signed.where("id is not null and n_shingles > 0").groupBy("set_key").agg(F.min("id").alias("rep")), "classes"
        )
        reps = stages.write(
            signed.where("n_shingles > 0").join(classes.select(F.col("rep").alias("id")), "id", "left_semi").select("id", "n_shingles", "sig"),
            "representatives",
        )
        # without the signatures, which only the representatives need
        rows = stages.write(signed.select("id", "n_shingles", "set_key"), "rows")
        stages.drop(signed)
        counts = _slot_counts(stages, reps.select("sig"), _count_slots, _slots(COORDINATES * reps.count()))
        posts = stages.write(
            reps.select("id", "n_shingles", "sig").mapInArrow(_post(counts, COORDINATES - MATCHES + 1), "key long, id long, n long"), "postings"
        )
        low = stages.write(reps.select("id", "sig").mapInArrow(_low_bytes, "id long, low binary"), "low-bytes")
        stages.drop(reps)
        heads = posts.groupBy("key").agg(F.min(F.struct("id", "n")).alias("head"), F.count("*").alias("size")).where("size > 1")
        heads = stages.write(heads.select("key", F.col("head.id").alias("a"), F.col("head.n").alias("n_a")), "heads")
        shared = stages.write(posts.join(heads, "key"), "shared-postings")
        stages.drop(posts, heads)
        alike = F.expr(f"100 * least(n_a, n) >= {LINK_PERCENT} * greatest(n_a, n)")
        star = shared.where((F.col("a") != F.col("id")) & alike).select("a", F.col("id").alias("b")).distinct()
        star = stages.write(star, "star-pairs")
        links = _links(stages, texts, low, star)
        grouped = stages.write(components(stages, links), "components")

        # lists that still hold several components
        labels = grouped.select(F.col("node").alias("id"), "component")
        marked = shared.join(labels, "id", "left").select("key", "id", "n", F.coalesce("component", "id").alias("c"))
        marked = stages.write(marked, "labelled-postings")
        mixed = marked.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("size")).where("lo < hi")
        mixed = stages.write(mixed.select("key", "size"), "mixed-lists")
        short = stages.write(marked.join(mixed.where(F.col("size") <= SHORT_LIST), "key").drop("size"), "short-lists")
        left = short.select("key", F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("c").alias("c_a"))
        near = left.join(short, "key").where((F.col("a") < F.col("id")) & (F.col("c_a") != F.col("c")) & alike)
        near = near.select("a", F.col("id").alias("b")).distinct().join(star, ["a", "b"], "left_anti")
        more = _links(stages, texts, low, stages.write(near, "short-list-pairs"))

        still = marked.join(mixed.where(F.col("size") > SHORT_LIST), "key").select("id", "c").distinct()
        still = stages.write(still, "open-documents")
        stages.drop(marked, mixed, short, shared, low)
        sets = stages.write(texts.join(_few(still.select("id")), "id", "left_semi").select("id", "text").mapInArrow(_sets, "id long, shingles binary"), "open-shingles")
        held = sets.agg(F.sum(F.length("shingles") / 8)).first()[0]
        often = _slot_counts(stages, sets.select("shingles"), _count_shingles, _slots(int(held or 0)))
        rare = sets.join(still, "id").select("id", "c", "shingles")
        rare = stages.write(rare.mapInArrow(_post_shingles(often), "key long, id long, c long, n long, place long"), "rare-shingles")
        left = rare.select("key", F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("c").alias("c_a"), F.col("place").alias("place_a"))
        common = F.expr("(3 * (n_a + n) + 6) div 7")
        met = (F.col("a") < F.col("id")) & (F.col("c_a") != F.col("c")) & (F.col("n_a") - F.col("place_a") >= common) & (F.col("n") - F.col("place") >= common)
        rest = left.join(rare, "key").where(met)
        rest = stages.write(rest.select("a", F.col("id").alias("b")).distinct(), "rest-pairs")
        bits = stages.write(sets.mapInArrow(_parities, "id long, n long, bits binary"), "parities")
        both = rest.join(bits.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("bits").alias("x")), "a")
        both = both.join(bits.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("bits").alias("y")), "b").select("a", "b", "n_a", "n_b", "x", "y")
        possible = stages.write(both.mapInArrow(_possible, "a long, b long"), "possible-pairs")
        stages.drop(rare, rest, bits)
        more = more.union(_confirmed(stages, sets, possible))
        final = stages.write(components(stages, links.union(more)), "final-components")

        whole = classes.join(final.select(F.col("node").alias("rep"), "component"), "rep", "left")
        whole = stages.write(whole.select("set_key", F.coalesce("component", "rep").alias("component")), "class-components")
        found = rows.join(whole, "set_key", "left")
        component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
        named = own_ids(found.select("id", "n_shingles", component.alias("component_id")), names, "id", "component_id")
        kept = F.coalesce(F.col("component_id") == F.col("id"), F.lit(False))
        return stages.keep(named.select(F.col("id").alias(id_col), "n_shingles", "component_id", kept.alias("kept")))


def _links(stages: Stages, texts: DataFrame, low: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs that agree in MATCHES coordinates and whose full sets pass."""
    with_a = pairs.join(low.select(F.col("id").alias("a"), F.col("low").alias("x")), "a")
    with_b = with_a.join(low.select(F.col("id").alias("b"), F.col("low").alias("y")), "b").select("a", "b", "x", "y")
    likely = stages.write(with_b.mapInArrow(_agree, "a long, b long"), "likely-pairs")
    wanted = stages.write(likely.select(F.col("a").alias("id")).union(likely.select("b")).distinct(), "wanted")
    sets = stages.write(texts.join(_few(wanted), "id", "left_semi").mapInArrow(_sets, "id long, shingles binary"), "shingles")
    links = _confirmed(stages, sets, likely)
    stages.drop(likely, wanted, sets)
    return links


def _confirmed(stages: Stages, sets: DataFrame, pairs: DataFrame) -> DataFrame:
    with_a = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a")
    with_b = with_a.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b").select("a", "b", "x", "y")
    return stages.write(with_b.mapInArrow(_confirm, "a long, b long"), "links")
