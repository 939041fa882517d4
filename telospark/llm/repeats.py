"""Removal of repeated byte strings by prefix-free parsing.

Parse: a rolling hash of GRAM bytes runs over each text; a place is a trigger where its hash is the
least of some window of LENGTH bytes, so every such window holds a trigger, and equal windows hold
the same one at the same place. A trigger's phrase is all that a window through it can reach: what
stands before it, the trigger, and the parse from there on, as far as LENGTH bytes go.

Dictionary: phrases meet by trigger and digest. One whose copy stands in an earlier document is
removed whole, at one row for up to 23 windows, in its own task already if the copy stands there;
that is where repetitive text collapses. Only the first copies of phrases that share a trigger with
a different phrase are opened: their bytes come together by trigger. Two suffix arrays are made
there: of the dictionary (every suffix of a phrase up to its trigger's end, in lexicographic order)
and of the parse (what follows the trigger, in lexicographic order, with the lengths of common
prefixes). Together they give the corpus order: by rank of the phrase's suffix, then of the parse's.
Neighbours there that agree in LENGTH bytes form a run; its members after its first document go.

Triggers with very many phrases would make one task too large: their windows are dealt one by one by
the hash of all their bytes, equal ones meeting in each task first, and ordered in the same way.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telospark.llm.common import free_shuffles, table
from telospark.llm.tokens import slices, trim

LENGTH = 50
GRAM = 28
#: Phrases of one trigger within a task's slice from which on it is spread by phrase.
HOT = 200
#: Phrases of one trigger in all from which on their windows are dealt one by one.
MANY = 4096
#: Windows that are put into order at once.
TOGETHER = 1 << 20
#: Text per bucket and group, in bytes.
BUCKET = 8 << 20
_NONE = -(1 << 63)
_COLUMNS = ("ids", "ties", "counts", "a", "b", "pos")
_BLOBS = "bucket int, kind int, ids binary, ties binary, counts binary, a binary, b binary, pos binary"
_K = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _K[3]
    x = (x ^ (x >> np.uint64(29))) * _K[1]
    return x ^ (x >> np.uint64(32))


def _loads(b: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number."""
    x = b.astype(np.uint64)
    for step in (1, 2, 4):
        x = x[:-step] | (x[step:] << np.uint64(8 * step))
    return x


def _slide(x: np.ndarray, width: int, f) -> np.ndarray:
    """f over each `width` neighbours, by doubling."""
    have, step = x, 1
    while 2 * step <= width:
        have, step = f(have[:-step], have[step:]), 2 * step
    rest = width - step
    return f(have[:-rest], have[rest:]) if rest else have


def triggers(b: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, trigger hashes, phrase digests) of a text of `length` bytes or more."""
    left = length - GRAM
    n = len(b)
    padded = np.concatenate([np.zeros(left, np.uint8), b, np.zeros(length, np.uint8)])
    load = _loads(padded)
    m = n - GRAM + 1
    h = np.zeros(m, np.uint64)
    for s in [*range(0, GRAM - 7, 8), GRAM - 8]:
        h = _mix(h + load[left + s : left + s + m]) * _K[0]
    low = _slide(h, left + 1, np.minimum)
    edge = np.zeros(left, np.uint64)
    at = np.flatnonzero(_slide(np.concatenate([edge, low, edge]), left + 1, np.maximum) == h)
    d = h[at] ^ (np.minimum(at, left).astype(np.uint64) << np.uint64(32)) ^ np.minimum(n - at, length).astype(np.uint64)
    spots = [*range(-left, -7, 8), -8, *range(GRAM, length - 7, 8), length - 8]
    for s in spots:
        d = (d ^ (d >> np.uint64(31))) * _K[1] + load[at + left + s] * _K[2]
    return at, h[at], _mix(d)


def suffixes(b: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """96-bit digests (64 and 32) of the `length` bytes from each place on."""
    load = _loads(np.concatenate([b, np.zeros(8, np.uint8)]))
    x, y = np.full(len(at), length, np.uint64), np.full(len(at), 77, np.uint64)
    for s in [*range(0, length - 7, 8), length - 8]:
        v = load[at + s]
        x = (x ^ (x >> np.uint64(31))) * _K[1] + v * _K[2]
        y = (y ^ (y >> np.uint64(28))) * _K[0] + _mix(v)
    return _mix(x), (_mix(y) >> np.uint64(32)).astype(np.uint32)


def _pack(bucket: int, kind: int, ids: np.ndarray, ties: np.ndarray, a: np.ndarray, b: np.ndarray, pos: np.ndarray) -> dict:
    """One blob; entries of a document in a row are stored with their number."""
    new = np.flatnonzero(np.concatenate(([True], (ids[1:] != ids[:-1]) | (ties[1:] != ties[:-1]))))
    counts = np.diff(np.concatenate((new, [len(ids)]))).astype(np.uint32)
    return {"bucket": bucket, "kind": kind, "ids": ids[new].tobytes(), "ties": ties[new].tobytes(), "counts": counts.tobytes(), "a": a.tobytes(), "b": b.tobytes(), "pos": pos.astype(np.int32).tobytes()}


def _unpack(rows: list[dict], a_type, b_type) -> tuple[np.ndarray, ...]:
    """ids, ties, a, b, pos, kind of all entries."""
    join = lambda c, t: np.frombuffer(b"".join(r[c] for r in rows), t)
    counts = join("counts", np.uint32)
    pos = join("pos", np.int32)
    kind = np.repeat([r["kind"] for r in rows], [len(r["pos"]) // 4 for r in rows])
    return np.repeat(join("ids", np.int64), counts), np.repeat(join("ties", np.uint32), counts), join("a", a_type), join("b", b_type), pos, kind


def _deal(to: np.ndarray, kind: int, *cols: np.ndarray):
    """A blob for each value of `to`; cols: ids, ties, a, b, pos."""
    order = np.argsort(to, kind="stable")
    cols = [c[order] for c in cols]
    to = to[order]
    edges = [0, *(np.flatnonzero(to[1:] != to[:-1]) + 1).tolist(), len(to)]
    for s, e in zip(edges, edges[1:]):
        if e > s:
            yield _pack(int(to[s]), kind, *(c[s:e] for c in cols))


def _batch(rows: list[dict]) -> pa.RecordBatch:
    trim()
    kinds = [("bucket", pa.int32()), ("kind", pa.int32()), *((c, pa.binary()) for c in _COLUMNS)]
    return pa.RecordBatch.from_pylist(rows, pa.schema(kinds))


def _range(x: np.ndarray, n: int) -> np.ndarray:
    """Buckets 0 to n - 1 by the upper bits of x."""
    return ((x >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _home(ids: np.ndarray, n: int) -> np.ndarray:
    return _range(_mix(ids.view(np.uint64) * _K[0]), n)


def _runs(*cols: np.ndarray) -> np.ndarray:
    """Number of the run of equal values that each entry is in."""
    new = np.zeros(len(cols[0]), bool)
    for c in cols:
        new[1:] |= c[1:] != c[:-1]
    return np.cumsum(new)


def _parse(df: DataFrame, n: int, length: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for part in slices(batch, "_text", 4 << 20):
                ids, ties, at, h, d = [], [], [], [], []
                for i, raw in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    if len(raw) >= length:
                        p, x, y = triggers(np.frombuffer(raw, np.uint8), length)
                        ids.append(np.full(len(p), i, np.int64))
                        ties.append(np.full(len(p), zlib.crc32(raw), np.uint32))
                        at.append(p)
                        h.append(x)
                        d.append(y)
                if not ids:
                    continue
                ids, ties, at, h, d = map(np.concatenate, (ids, ties, at, h, d))
                # what stands in an earlier document of this very slice needs no dictionary
                order = np.argsort(d, kind="stable")
                same = _runs(h[order], d[order])
                least = np.minimum.reduceat(ids[order], np.flatnonzero(np.diff(same, prepend=-1)))[same]
                later = np.zeros(len(ids), bool)
                later[order] = least < ids[order]
                rows = _flagged(ids[later], ties[later], at[later], n, 3)
                ids, ties, at, h, d = (c[~later] for c in (ids, ties, at, h, d))
                hot = np.zeros(len(h), bool)
                sorted_ = np.sort(h)
                often = np.unique(sorted_[HOT:][sorted_[HOT:] == sorted_[: max(len(h) - HOT, 0)]])  # more than HOT times
                if len(often):
                    some = np.flatnonzero(np.isin(h, often))
                    order = some[np.lexsort((d[some], h[some]))]
                    trigger, phrase = _runs(h[order]), _runs(h[order], d[order])
                    first = np.concatenate(([True], phrase[1:] != phrase[:-1]))
                    hot[order] = (np.bincount(trigger, weights=first) > HOT)[trigger]
                plain = ~hot
                cols = lambda m: (ids[m], ties[m], h[m].view(np.uint8).reshape(-1, 8)[:, :6], d[m], at[m])
                rows += _deal(_range(_mix(h[plain] * _K[2]), n), 0, *cols(plain))  # minima are not uniform
                if hot.any():
                    rows += _deal(_range(_mix(h[hot] ^ d[hot]), n), 1, *cols(hot))
                    # for the others of such a trigger: its first and last document here
                    some = np.flatnonzero(hot)
                    some = some[np.lexsort((ids[some], h[some]))]
                    lead = np.concatenate(([True], h[some][1:] != h[some][:-1]))
                    ends = some[lead | np.concatenate((lead[1:], [True]))]
                    rows += _deal(_range(_mix(h[ends] * _K[2]), n), 2, *cols(ends))
                yield _batch(rows)
        trim()

    return df.select("_id", "_text").mapInArrow(run, _BLOBS)


def _dictionary(n: int):
    """Blobs of a bucket of triggers -> blobs by document: kind 0, phrases found earlier; kind 1,
    phrases to open; kind 4, those to open window by window. Blobs of kind 3 are of kind 0 already."""

    def run(t: pa.Table) -> pa.Table:
        blobs = t.to_pylist()
        rows: list[dict] = [r | {"kind": 0} for r in blobs if r["kind"] == 3]
        for spread in (False, True):
            some = [r for r in blobs if r["kind"] != 3 and (r["kind"] == 1) == spread]
            if not some:
                continue
            ids, ties, a, d, pos, kind = _unpack(some, np.uint8, np.uint64)
            h = np.zeros((len(ids), 8), np.uint8)
            h[:, :6] = a.reshape(-1, 6)
            h = h.view(np.uint64).ravel()
            # most triggers stand alone: only the others are sorted in full
            order = np.argsort(h)
            if not spread:
                same = h[order][1:] == h[order][:-1]
                order = order[np.concatenate((same, [False])) | np.concatenate(([False], same))]
            if not len(order):
                continue
            order = order[np.lexsort((ids[order], kind[order] == 2, d[order], h[order]))]
            ids, ties, h, d, pos, kind = (x[order] for x in (ids, ties, h, d, pos, kind))
            group, phrase = _runs(h), _runs(h, d)
            head = np.flatnonzero(np.concatenate(([True], phrase[1:] != phrase[:-1])))
            least = ids[head][phrase]
            real = kind != 2
            earlier = real & (least < ids)
            single = np.zeros(len(ids), bool)
            if spread:
                open_ = single = real & ~earlier
            else:
                start = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
                low, high = np.minimum.reduceat(ids, start), np.maximum.reduceat(ids, start)
                kinds = np.bincount(group[head])  # phrases of the trigger
                foreign = np.bincount(group, weights=kind == 2) > 0
                open_ = real & ~earlier & ((kinds > 1) | foreign)[group] & (low < high)[group]
                single = open_ & (foreign | (kinds > MANY))[group]
            for m, out in ((earlier, 0), (open_ & ~single, 1), (single, 4)):
                none = np.zeros(0, np.uint8)
                by = np.lexsort((pos[m], ties[m], ids[m]))
                i, tie, p = ids[m][by], ties[m][by], pos[m][by]
                for r in _deal(_home(i, n), out, i, tie, np.zeros((len(i), 0), np.uint8), np.zeros((len(i), 0), np.uint8), p):
                    rows.append(r | {"a": none.tobytes(), "b": none.tobytes()})
        return pa.Table.from_batches([_batch(rows)])

    return run


def _places(marks: pa.Table) -> dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]]:
    """By document (id, tie): places and their kinds."""
    if not marks.num_rows:
        return {}
    ids, ties, _, _, pos, kind = _unpack(marks.to_pylist(), np.uint8, np.uint8)
    order = np.lexsort((pos, ties, ids))
    ids, ties, pos, kind = (x[order] for x in (ids, ties, pos, kind))
    edges = [0, *(np.flatnonzero((ids[1:] != ids[:-1]) | (ties[1:] != ties[:-1])) + 1).tolist(), len(ids)]
    return {(int(ids[s]), int(ties[s])): (pos[s:e].astype(np.int64), kind[s:e]) for s, e in zip(edges, edges[1:]) if e > s}


def _cover(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    d = np.zeros(n + 1, np.int32)
    np.add.at(d, starts, 1)
    np.add.at(d, ends, -1)
    return np.cumsum(d[:-1]) > 0


def _entries(raw: bytes, at: np.ndarray, start: np.ndarray, windows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes (a row each, zeros behind the last window) and shape (bytes before the trigger, windows)
    of the parts of a text from `start` on; at: the triggers."""
    width = 2 * length - GRAM
    b = np.concatenate([np.frombuffer(raw, np.uint8), np.zeros(width, np.uint8)])
    out = b[start[:, None] + np.arange(width)]
    out[np.arange(width) >= (windows + length - 1)[:, None]] = 0
    return out, np.stack([at - start, windows], axis=1).astype(np.uint16)


def _open(n: int, length: int):
    """Texts and marks of a group -> blobs: kind 0, phrases by bucket of their trigger, and single
    windows by bucket of their bytes; kind 2, windows that an earlier document of this very group
    holds, by document."""
    left = length - GRAM

    def run(texts: pa.Table, marks: pa.Table) -> pa.Table:
        places = _places(marks)
        phrases: list[list[np.ndarray]] = []
        singles: list[list[np.ndarray]] = []
        for i, raw in zip(texts["_id"].to_pylist(), texts["_text"].to_pylist()):
            tie = zlib.crc32(raw)
            got = places.get((i, tie)) if places else None
            if got is None or not (got[1] != 0).any():
                continue
            m = len(raw) - length + 1
            span = lambda p: (np.maximum(p - left, 0), np.minimum(p, m - 1) + 1)
            gone = _cover(m, *span(got[0][got[1] == 0]))
            b = np.frombuffer(raw, np.uint8)
            p = got[0][got[1] == 1]
            first, end = span(p)
            stay = np.concatenate(([0], np.cumsum(~gone)))
            p, first, end = (x[stay[end] > stay[first]] for x in (p, first, end))
            if len(p):
                bucket = _range(_mix(suffixes(b, p, GRAM)[0]), n)
                phrases.append([np.full(len(p), i, np.int64), np.full(len(p), tie, np.uint32), *_entries(raw, p, first, end - first, length), first, bucket])
            p = got[0][got[1] == 4]
            if len(p):
                first, end = span(p)
                q = np.repeat(first - np.cumsum(end - first) + (end - first), end - first) + np.arange(int((end - first).sum()))
                p = np.repeat(p, end - first)
                p, q = p[~gone[q]], q[~gone[q]]
                x, _ = suffixes(b, q, length)
                singles.append([np.full(len(q), i, np.int64), np.full(len(q), tie, np.uint32), *_entries(raw, p, q, np.ones(len(q), np.int64), length), q, _range(x, n)])
        rows: list[dict] = []
        if phrases:
            ids, ties, a, shape, pos, bucket = map(np.concatenate, zip(*phrases))
            rows += _deal(bucket, 0, ids, ties, a, shape, pos)
        if singles:
            ids, ties, a, shape, pos, bucket = map(np.concatenate, zip(*singles))
            e, r, least = corpus_order(a, shape, ids, length)
            later = np.zeros(len(ids), bool)
            later[e] = least < ids[e]
            once = ~later
            rows += _deal(bucket[once], 0, ids[once], ties[once], a[once], shape[once], pos[once])
            rows += _flagged(ids[later], ties[later], pos[later], n)
        return pa.Table.from_batches([_batch(rows)])

    return run


def _flagged(ids: np.ndarray, ties: np.ndarray, pos: np.ndarray, n: int, kind: int = 2) -> list[dict]:
    by = np.lexsort((pos, ties, ids))
    none = np.zeros((len(ids), 0), np.uint8)
    return list(_deal(_home(ids[by], n), kind, ids[by], ties[by], none, none, pos[by]))


def _keys(flat: np.ndarray, start: np.ndarray, size: np.ndarray, most: int) -> list[np.ndarray]:
    """Eight bytes at a time, from `start` on, as numbers in lexicographic order; bytes beyond
    `size` count as zero."""
    load = _loads(np.concatenate([flat, np.zeros(most + 8, np.uint8)])).byteswap()
    out = []
    for j in range(0, most, 8):
        over = np.clip(8 * (8 - (size - j)), 0, 64).astype(np.uint64)
        k = load[start + j]
        out.append(np.where(over >= 64, np.uint64(0), (k >> np.minimum(over, np.uint64(63))) << np.minimum(over, np.uint64(63))))
    return out


def _sorted_runs(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows by the keys, and in that order the number of the run of equal rows."""
    order = np.lexsort(keys[::-1])
    return order, _runs(*(k[order] for k in keys))


def _parse_classes(rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of the parse: the rank of each row of bytes among all, and classes[k]: the number
    of its class among rows that agree in k bytes, in lexicographic order."""
    m, width = rest.shape
    order, _ = _sorted_runs(_keys(rest.ravel(), np.arange(m) * width, np.full(m, width), width))
    in_order = rest[order]
    differ = in_order[1:] != in_order[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    rank = np.empty(m, np.int64)
    rank[order] = np.arange(m)
    classes = np.zeros((width + 1, m), np.int64)
    for k in range(width + 1):
        classes[k, 1:] = np.cumsum(common < k)
    return rank, classes[:, rank]


def corpus_order(a: np.ndarray, shape: np.ndarray, ids: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry, place, least id) of all windows of the entries (see _entries) in corpus order: the
    rank of the phrase's suffix, then that of the parse after it. Windows of equal bytes form a run,
    and have the least id of its members."""
    width, left = a.shape[1], length - GRAM
    before, windows = shape[:, 0].astype(np.int64), shape[:, 1].astype(np.int64)
    entry = np.repeat(np.arange(len(a)), windows)
    place = np.arange(len(entry)) - np.repeat(np.cumsum(windows) - windows, windows)
    flat = a.ravel()
    # the dictionary: suffixes up to the trigger's end
    size = before[entry] + GRAM - place
    order, run = _sorted_runs(_keys(flat, entry * width + place, size, length))
    suffix = np.empty(len(entry), np.int64)
    suffix[order] = run
    # the parse: what follows the trigger
    behind = np.concatenate([flat, np.zeros(width, np.uint8)])[(np.arange(len(a)) * width + before + GRAM)[:, None] + np.arange(left)]
    behind[(before + GRAM)[:, None] + np.arange(left) >= (windows + length - 1)[:, None]] = 0
    rank, classes = _parse_classes(behind)
    order = np.lexsort((rank[entry], suffix))
    entry, place, suffix, depth = entry[order], place[order], suffix[order], (length - size)[order]
    run = _runs(suffix, classes[depth, entry])
    least = np.minimum.reduceat(ids[entry], np.flatnonzero(np.diff(run, prepend=-1)))[run] if len(run) else run
    return entry, place, least


def _order(n: int, length: int):
    """Blobs of a bucket of phrases -> windows that an earlier document holds, by document. Blobs
    of kind 2 are such windows already and pass."""
    width = 2 * length - GRAM

    def run(t: pa.Table) -> pa.Table:
        blobs = t.to_pylist()
        rows, some = [r for r in blobs if r["kind"] == 2], [r for r in blobs if r["kind"] == 0]
        if not some:
            return pa.Table.from_batches([_batch(rows)])
        ids, ties, a, shape, pos, _ = _unpack(some, np.uint8, np.uint16)
        a, shape = a.reshape(-1, width), shape.reshape(-1, 2)
        # entries of a trigger stay together; what is ordered at once has a bounded size
        at = np.arange(len(a)) * width + shape[:, 0]
        order, trigger = _sorted_runs(_keys(a.ravel(), at, np.full(len(a), GRAM), GRAM))
        done = np.cumsum(shape[order, 1], dtype=np.int64)
        ends = np.append(np.flatnonzero(np.diff(trigger)) + 1, len(order))
        part = done[ends - 1] // TOGETHER
        cuts = np.append(ends[np.flatnonzero(np.diff(part))], len(order))
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for s, e in zip(np.append(0, cuts[:-1]).tolist(), cuts.tolist()):
            mine = order[s:e]
            entry, place, least = corpus_order(a[mine], shape[mine], ids[mine], length)
            entry = mine[entry]
            later = least < ids[entry]
            out.append((ids[entry[later]], ties[entry[later]], pos[entry[later]] + place[later]))
        return pa.Table.from_batches([_batch(rows + _flagged(*map(np.concatenate, zip(*out)), n))])

    return run


def remove_repeats(df: DataFrame, text: str = "text", key: str = "doc_id", length: int = LENGTH, with_kept: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans (start, end) of each row of df;
    with_kept adds the bytes that stay (cuts may fall inside a character).

    A byte goes if a string of `length` bytes (36 or more) over it also starts in a document with a smaller
    doc_id, as the texts stand in the input; overlaps count, and strings never cross documents.
    Null texts count as empty; shorter texts are never cut. A null doc_id counts as the smallest.
    Rows that share a doc_id don't cut each other. Extra columns are ignored; an empty table gives
    an empty result.
    """
    if length < GRAM + 8:
        raise ValueError(f"length must be at least {GRAM + 8}")
    spark = df.sparkSession
    left = length - GRAM
    rows = df.select(F.coalesce(F.col(key).cast("long"), F.lit(_NONE)).alias("_id"), F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias("_text"))
    total = rows.agg(F.sum(F.length("_text").cast("long"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET))
    marks = table(_parse(rows, n, length).repartition(n, "bucket").groupBy("bucket").applyInArrow(_dictionary(n), _BLOBS), "phrases")
    free_shuffles(spark)

    def finish(texts: pa.Table, found: pa.Table) -> pa.Table:
        places = _places(found)
        ids, size, gone, runs, sha, spans, kept = [], [], [], [], [], [], []
        for i, raw in zip(texts["_id"].to_pylist(), texts["_text"].to_pylist()):
            got = places.get((i, zlib.crc32(raw))) if places and len(raw) >= length else None
            cut: list[dict] = []
            rest = raw
            if got is not None and (got[1] != 1).any():
                p, k = got[0][got[1] != 1], got[1][got[1] != 1]
                starts = np.where(k == 0, np.maximum(p - left, 0), p)
                mask = _cover(len(raw), starts, np.minimum(p + length, len(raw)))
                edge = np.diff(np.concatenate(([0], mask.view(np.int8), [0])))
                cut = [{"start": int(s), "end": int(e)} for s, e in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))]
                rest = np.frombuffer(raw, np.uint8)[~mask].tobytes()
            for c, v in zip((ids, size, gone, runs, sha, spans, kept), (None if i == _NONE else i, len(raw), len(raw) - len(rest), len(cut), hashlib.sha256(rest).hexdigest(), cut, rest)):
                c.append(v)
        cols = {"doc_id": pa.array(ids, pa.int64()), "n_bytes": pa.array(size, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "n_spans": pa.array(runs, pa.int64()), "kept_sha256": pa.array(sha, pa.string()), "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))}
        return pa.table(cols | ({"kept": pa.array(kept, pa.binary())} if with_kept else {}))

    @F.pandas_udf("int")
    def home(ids):
        import pandas as pd

        return pd.Series(_home(ids.to_numpy(), n).astype(np.int32))

    # as many tasks as buckets, so that a task's part of the corpus doesn't grow
    homes = rows.withColumn("bucket", home("_id")).repartition(n, "bucket").groupBy("bucket")
    opened = homes.cogroup(marks.repartition(n, "bucket").groupBy("bucket")).applyInArrow(_open(n, length), _BLOBS)
    flagged = table(opened.repartition(n, "bucket").groupBy("bucket").applyInArrow(_order(n, length), _BLOBS), "flagged")
    free_shuffles(spark)
    found = marks.where("kind = 0").union(flagged)
    homes = rows.withColumn("bucket", home("_id")).repartition(n, "bucket").groupBy("bucket")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>" + (", kept binary" if with_kept else "")
    return homes.cogroup(found.repartition(n, "bucket").groupBy("bucket")).applyInArrow(finish, schema)
