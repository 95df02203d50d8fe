"""Removal of repeated byte strings with suffix arrays built by induced sorting.

Every string of LIMIT bytes has a minimiser: the byte K-gram of least hash in it.  Runs of starts with the same minimiser form a
segment, and equal strings have equal minimisers at equal offsets, so segments are dealt to shards by the
minimiser's hash.  Segments that repeat whole are settled by an aggregate; those that share a minimiser and differ go to suffix
arrays, one a shard.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import Stages, by_row, own_ids

LIMIT = 100
K = 32
#: Segments of one minimiser that a shard takes; beyond it the minimiser is spread over several shards, whose first strings are then compared.
SHARD_SEGMENTS = 2048

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_LOW = np.uint64(0xFFFFFF)
#: Texts are cut into blocks of this many starts, so that a place fits the low 24 bits.
_BLOCK = 1 << 22


def induced_suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array of a string of whole numbers that ends with its only, least one.

    Suffixes are classified as smaller or larger than the next.  The leftmost-smaller ones are put at their buckets'
    ends, and one sweep over the buckets upwards and one downwards induce the order of all from them: first to
    sort the leftmost-smaller substrings, and, after the string of their names has been sorted the same way, to sort
    the suffixes.  A sweep moves a bucket's entries at a time.  Strings of names with few repeats to a name end
    the recursion by doubling ranks.
    """
    n = len(s)
    if n == 1:
        return np.zeros(1, np.int64)
    sizes = np.bincount(s)
    if len(np.flatnonzero(sizes)) > max(512, n // 100):
        return _by_doubling(s)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    step = np.sign(s[1:].astype(np.int64) - s[:-1])
    where = np.where(step != 0, np.arange(n - 1), n)
    ahead = np.minimum.accumulate(where[::-1])[::-1]
    smaller = np.ones(n, bool)
    smaller[:-1] = np.append(step, 1)[np.minimum(ahead, n - 1)] > 0
    leftmost = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1

    sa = _induce(s, smaller, sizes, starts, ends, leftmost[_in_order(s[leftmost])])
    is_leftmost = np.zeros(n, bool)
    is_leftmost[leftmost] = True
    order = sa[is_leftmost[sa]]
    length = np.zeros(n, np.int64)
    length[leftmost[:-1]] = np.diff(leftmost)
    a, b = order[:-1], order[1:]
    same = (length[a] == length[b]) & (length[a] > 0)
    live = np.flatnonzero(same)
    at = 0
    while len(live):
        x, y = a[live], b[live]
        equal = s[x + at] == s[y + at]
        same[live[~equal]] = False
        live = live[equal & (length[x] > at)]
        at += 1
    names = np.concatenate(([0], np.cumsum(~same)))
    if names[-1] + 1 < len(order):
        name_at = np.zeros(n, np.int64)
        name_at[order] = names
        order = leftmost[induced_suffix_array(name_at[leftmost])]
    return _induce(s, smaller, sizes, starts, ends, order)


def _induce(s: np.ndarray, smaller: np.ndarray, sizes: np.ndarray, starts: np.ndarray, ends: np.ndarray, leftmost: np.ndarray) -> np.ndarray:
    """All suffixes in the order that the leftmost-smaller ones, given in order of their first numbers, induce."""
    n = len(s)
    sa = np.full(n, -1, np.int64)
    first = s[leftmost]
    held = np.bincount(first, minlength=len(sizes))
    base = np.cumsum(held) - held
    sa[ends[first] - held[first] + np.arange(len(leftmost)) - base[first]] = leftmost
    head = starts.copy()
    buckets = np.flatnonzero(sizes)
    for c in buckets.tolist():
        found, lo = [], starts[c]
        while lo < head[c]:
            batch, lo = sa[lo : head[c]], head[c]
            prev = batch[batch > 0] - 1
            prev = prev[~smaller[prev]]
            own = s[prev] == c
            mine = prev[own]
            sa[head[c] : head[c] + len(mine)] = mine
            head[c] += len(mine)
            found.append(prev[~own] if len(mine) else prev)
        if held[c]:
            batch = sa[ends[c] - held[c] : ends[c]]
            prev = batch[batch > 0] - 1
            found.append(prev[~smaller[prev]])
        if found:
            _deal(s, sa, np.concatenate(found), head, 1)
    tail = ends.copy()
    larger_end = head
    for c in buckets[::-1].tolist():
        found, hi = [], ends[c]
        while hi > tail[c]:
            batch, hi = sa[tail[c] : hi][::-1], tail[c]
            prev = batch[batch > 0] - 1
            prev = prev[smaller[prev]]
            own = s[prev] == c
            mine = prev[own]
            sa[tail[c] - len(mine) : tail[c]] = mine[::-1]
            tail[c] -= len(mine)
            found.append(prev[~own] if len(mine) else prev)
        if larger_end[c] > starts[c]:
            batch = sa[starts[c] : larger_end[c]][::-1]
            prev = batch[batch > 0] - 1
            found.append(prev[smaller[prev]])
        if found:
            _deal(s, sa, np.concatenate(found), tail, -1)
    sa[0] = n - 1
    return sa


def _deal(s: np.ndarray, sa: np.ndarray, suffixes: np.ndarray, edge: np.ndarray, way: int) -> None:
    """Appends suffixes, in order, at their buckets' edges."""
    if not len(suffixes):
        return
    first = s[suffixes]
    order = _in_order(first)
    first = first[order]
    cut = np.flatnonzero(np.concatenate(([True], first[1:] != first[:-1])))
    counts = np.diff(np.append(cut, len(first)))
    rank = np.arange(len(first)) - np.repeat(cut, counts)
    sa[edge[first] + rank if way > 0 else edge[first] - 1 - rank] = suffixes[order]
    edge[first[cut]] += way * counts


def _in_order(values: np.ndarray) -> np.ndarray:
    """A stable order of whole numbers; those of 16 bits are sorted by their digits."""
    return np.argsort(values.astype(np.uint16) if values.max(initial=0) < 1 << 16 else values, kind="stable")


def _by_doubling(s: np.ndarray) -> np.ndarray:
    """A place's rank is where its group of equal strings starts in the order; each round sorts the groups of two or more by the rank `width` on."""
    n, width = len(s), 1
    order = np.argsort(s, kind="stable")
    group = s[order]
    rank = np.empty(n, np.int64)
    at = np.arange(n)
    while True:
        first = np.append(True, group[1:] != group[:-1])
        items = order[at]
        rank[items] = at[np.flatnonzero(first)[np.cumsum(first) - 1]]
        open_ = ~(first & np.append(first[1:], True))
        at, items = at[open_], items[open_]
        if not len(at):
            return order
        ahead = items + width
        key = rank[items] * (n + 1) + np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        put = np.argsort(key)
        order[at], group = items[put], key[put]
        width = min(2 * width, n)


def words8(b: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place as one number."""
    x = b.astype(np.uint64)
    for shift in (1, 2, 4):
        x = x[:-shift] | (x[shift:] << np.uint64(8 * shift))
    return x


def permuted_common_prefixes(text: np.ndarray, sa: np.ndarray, limit: int = LIMIT, whole: bool = False) -> np.ndarray:
    """By place: the common prefix, up to limit, with the suffix before it in the order; text has `limit` + 8 spare bytes at its end.

    Bytes are compared eight at a time in all places at once.  With whole, only prefixes of limit bytes are asked for, and those of places that differ in
    the last eight of them are given as 0.
    """
    w = words8(text)
    after, before = sa[1:], sa[:-1]
    common = np.zeros(len(sa) - 1, np.int64)
    live = np.flatnonzero(w[after + (limit - 8)] == w[before + (limit - 8)]) if whole else np.arange(len(common))
    tried = live
    for at in range(0, limit, 8):
        live = live[w[after[live] + at] == w[before[live] + at]]
        common[live] = at + 8
    live = tried[common[tried] < limit]
    while len(live):
        live = live[text[after[live] + common[live]] == text[before[live] + common[live]]]
        common[live] += 1
        live = live[(common[live] < limit) & (common[live] % 8 > 0)]
    plcp = np.zeros(len(text), np.int64)
    plcp[after] = np.minimum(common, limit)
    return plcp


def _kgram_hashes(a: np.ndarray) -> np.ndarray:
    x = words8(a)
    n = len(a) - K + 1
    h = x[:n] * _M1
    for at in range(8, K, 8):
        h ^= h >> np.uint64(29)
        h ^= x[at : at + n]
        h *= _M1
    h ^= h >> np.uint64(32)
    h *= _M2
    h ^= h >> np.uint64(29)
    return h


def segments_of(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimiser hash, first start, number of starts) of a text's segments."""
    parts = []
    for base in range(0, max(0, len(text) - LIMIT + 1), _BLOCK):
        a = np.frombuffer(text, np.uint8)[base : base + _BLOCK + LIMIT - 1]
        h = _kgram_hashes(a)
        least = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
        width, window = 1, LIMIT - K + 1
        while 2 * width <= window:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if window > width:
            least = np.minimum(least[: width - window], least[window - width :])
        cut = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
        parts.append((h[(least[cut] & _LOW).astype(np.int64)], cut + base, np.diff(np.append(cut, len(least)))))
    if not parts:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


def _parts(batches: Iterator[pa.RecordBatch], rows: int = 100) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def _minimisers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _parts(batches):
        parts = [segments_of(t)[0] for t in batch.column(1).to_pylist() if t is not None and len(t) >= LIMIT]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts).view(np.int64) if parts else np.empty(0, np.int64))], ["f"])


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest = xxhash.xxh3_64_intdigest
    for batch in _parts(batches):
        ids, fs, sids, starts, ns = [], [], [], [], []
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if i is None or t is None or len(t) < LIMIT:
                continue
            f, start, n = segments_of(t)
            ids.append(np.full(len(f), i, np.int64))
            fs.append(f)
            sids.append(np.fromiter((digest(t[s:e]) for s, e in zip(start.tolist(), (start + n + (LIMIT - 1)).tolist(), strict=True)), np.uint64, len(f)))
            starts.append(start)
            ns.append(n)
        if ids:
            joined = [np.concatenate(x) for x in (fs, sids, ids, starts, ns)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(joined[0].view(np.int64)), pa.array(joined[1].view(np.int64)), pa.array(joined[2]), pa.array(joined[3]), pa.array(joined[4].astype(np.int32))],
                ["f", "sid", "id", "start", "n"],
            )


def _slice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of wanted segments; column 2 lists a text's (f, shard, start, n)."""
    for batch in batches:
        rows = []
        for i, t, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            rows += [(w["f"], w["shard"], i, w["start"], w["n"], t[w["start"] : w["start"] + w["n"] + LIMIT - 1]) for w in wanted]
        cols = list(zip(*rows, strict=True)) or [[]] * 6
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["f", "shard", "id", "start", "n", "bytes"])


def repeats_in_shard(segments: list[tuple]) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, bytes]]]:
    """For segments (f, shard, id, start, n, bytes): later strings as (id, first start, count), and the first strings of spread minimisers."""
    segments = sorted({(r[2], r[3]): r for r in segments}.values(), key=lambda r: (r[2], r[3]))
    raw = b"\0".join(r[5] for r in segments)
    size = np.fromiter((len(r[5]) for r in segments), np.int64, len(segments))
    base = np.cumsum(size + 1) - size - 1
    text = np.frombuffer(raw + bytes(LIMIT + 9), np.uint8)
    n = len(raw)
    s = np.frombuffer(raw + b"\0", np.uint8).astype(np.uint16) + 2
    s[base[1:] - 1] = 1
    s[n] = 0
    sa = induced_suffix_array(s)
    left = np.zeros(n + 1, np.int64)
    for b, k in zip(base.tolist(), size.tolist(), strict=True):
        left[b : b + k] = np.arange(k, 0, -1)
    sa = sa[left[sa] >= LIMIT]
    run = np.cumsum(permuted_common_prefixes(text, sa, whole=True)[sa] < LIMIT)
    cut = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
    first = np.minimum.reduceat(sa, cut)
    later = np.zeros(n + 2, np.int8)
    later[sa] = 1
    later[first] = 0
    edge = np.diff(later, prepend=0)
    lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    out = []
    for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
        k = int(np.searchsorted(base, a, "right")) - 1
        out.append((segments[k][2], segments[k][3] + a - int(base[k]), b - a))
    firsts = []
    if any(r[1] >= 0 for r in segments):
        for a in first.tolist():
            k = int(np.searchsorted(base, a, "right")) - 1
            if segments[k][1] >= 0:
                firsts.append((segments[k][2], segments[k][3] + a - int(base[k]), xxhash.xxh3_128_digest(raw[a : a + LIMIT])))
    return out, firsts


def _sort_shards(most_bytes: int = 2 << 20):
    """Suffix arrays over whole groups (f, shard) in the order they come, about most_bytes at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, group = 0, None

        def flush() -> pa.RecordBatch:
            later, firsts = repeats_in_shard(held)
            rows = [(i, s, n, None) for i, s, n in later] + [(i, s, 1, g) for i, s, g in firsts]
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["id", "start", "n", "gram"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:2] != group:
                    group = row[:2]
                    if size > most_bytes:
                        yield flush()
                        held, size = [], 0
                held.append(row)
                size += len(row[5])
        if held:
            yield flush()

    return run


def _remove(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_bytes, n_removed, n_spans, kept, digests = [], [], [], [], []
            for t, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                t = t or b""
                spans: list[list[int]] = []
                for start, n in sorted((r["start"], r["n"]) for r in found or ()):
                    end = start + n + LIMIT - 1
                    if spans and start <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], end)
                    else:
                        spans.append([start, end])
                rest, at = [], 0
                for start, end in spans:
                    rest.append(t[at:start])
                    at = end
                whole = b"".join([*rest, t[at:]]) if spans else t
                n_bytes.append(len(t))
                n_removed.append(len(t) - len(whole))
                n_spans.append(len(spans))
                digests.append(hashlib.sha256(whole).hexdigest())
                kept.append(whole if with_text else None)
            columns = [batch.column(0), *(pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans)), pa.array(digests, pa.string()), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """One row per row of docs: id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes).

    A byte goes if a string of LIMIT bytes over it also starts earlier, at a smaller id or earlier in its own text.  All
    strings are judged on the input.

    Null texts count as empty; texts under LIMIT bytes stay whole.  Rows with a null id are neither earlier than others nor
    cut.  Rows that repeat an id with another text are documents of their own, earlier ones those that stand earlier in the table; rows that repeat id
    and text are one place, and neither copy is cut for the other.  An empty table gives no rows.  Other columns are not read.
    """
    spark = docs.sparkSession
    with Stages(spark, "suffix") as stages:
        texts, names = by_row(stages, docs, id_col, text_col)
        dated = texts.where("id is not null")
        repeated = dated.select("id", "text").mapInArrow(_minimisers, "f long").groupBy("f").agg(F.count("*").alias("c")).where("c > 1")
        repeated = stages.write(repeated.select("f"), "repeated-minimisers")
        found = dated.mapInArrow(_segments, "f long, sid long, id long, start long, n int").join(repeated, "f")
        found = stages.write(found, "repeated-segments")
        firsts = found.groupBy("f", "sid").agg(F.min(F.struct("id", "start")).alias("first"), F.max("n").alias("n"), F.count("*").alias("c"))
        firsts = stages.write(firsts.select("f", "sid", F.col("first.id").alias("first_id"), F.col("first.start").alias("first_start"), "n", "c"), "first-segments")

        copies = found.select("f", "sid", "id", "start", "n").join(firsts.where("c > 1").select("f", "sid", "first_id", "first_start"), ["f", "sid"])
        copies = copies.where("id != first_id or start != first_start").select("id", "start", F.col("n").cast("long").alias("n"))
        copies = stages.write(copies, "copied-segments")

        mixed = stages.write(firsts.groupBy("f").agg(F.count("*").alias("kinds")).where("kinds > 1"), "mixed-minimisers")
        shard = F.when(F.col("kinds") > SHARD_SEGMENTS, F.pmod(F.xxhash64("first_id", "first_start"), F.ceil(F.col("kinds") / SHARD_SEGMENTS))).otherwise(-1)
        wanted = firsts.join(mixed, "f").select(
            F.col("first_id").alias("id"), F.struct("f", shard.cast("int").alias("shard"), F.col("first_start").alias("start"), "n").alias("w")
        )
        wanted = stages.write(wanted.groupBy("id").agg(F.collect_list("w").alias("wanted")), "wanted")
        cut = dated.join(wanted, "id").mapInArrow(_slice, "f long, shard int, id long, start long, n int, bytes binary")
        dealt = cut.repartition("f", "shard").sortWithinPartitions("f", "shard")
        sorted_ = stages.write(dealt.mapInArrow(_sort_shards(), "id long, start long, n long, gram binary"), "sorted-shards")

        grams = sorted_.where("gram is not null")
        earliest = stages.write(grams.groupBy("gram").agg(F.min(F.struct("id", "start")).alias("at"), F.count("*").alias("c")).where("c > 1"), "earliest-strings")
        spread = grams.join(earliest, "gram").where("id != at.id or start != at.start").select("id", "start", "n")

        later = copies.union(sorted_.where("gram is null").select("id", "start", "n")).union(spread)
        later = stages.write(later.groupBy("id").agg(F.collect_list(F.struct("start", "n")).alias("later")), "later")
        final = texts.join(later, "id", "left").select("id", "text", "later")
        kept = final.mapInArrow(_remove(with_text), "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
        if not with_text:
            kept = kept.drop("kept")
        return stages.keep(own_ids(kept, names, "id").withColumnRenamed("id", id_col))
