"""Best-fit packing with exact-complement hashing.

All that packing needs to know is how many pieces there are of each length, at most `capacity`
counts. The plan is made on those counts: a sequence is begun by the longest piece, and the gap it
leaves is looked up among the lengths, the sums of two and the sums of three lengths still
available; a hit fills it exactly, as often as the counts allow. What no sum completes is packed
best-fit. The plan is a list of patterns (lengths, how many sequences), which the pieces of each
length then take up by rank; ranks are counted in two levels, so no task sees a whole length.
The pieces carry their ids to their sequences, where these are joined up in order.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from telospark.llm.common import cut, discard, small_enough, table
from telospark.llm.tokens import encoder, slices, trim

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Pieces on their way: the task that made them, their number among its pieces of that length, and
#: the ids as little-endian unsigned numbers of two bytes where the vocabulary allows, else four.
ENCODED = "doc_id long, piece int, start long, length long, part int, nth long, ids binary"


def _cut(n_of: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row of the text, piece, start and length of each piece of texts of n_of ids."""
    pieces = -(-n_of // capacity)
    doc = np.repeat(np.arange(len(n_of)), pieces)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = number * capacity
    return doc, number, start, np.minimum(capacity, n_of[doc] - start)


def _rows(df: DataFrame, text: str, key: str) -> DataFrame:
    return df.select(F.col(key).cast("long").alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))


def token_pieces(df: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096, text: str = "text", key: str = "doc_id", keeps_space: bool = False, with_ids: bool = False) -> DataFrame:
    """One row per piece: a text's ids and end_id, cut into pieces of `capacity` if longer. A null
    text counts as empty. with_ids adds the ids (array<int>)."""
    schema = PIECES + (", ids array<int>" if with_ids else "")

    def encode(batches):
        enc = None
        for batch in batches:
            for b in slices(batch, "_text", 3 << 20):
                enc = enc or encoder(tokenizer, keeps_space)
                ids, n_of = enc.encode(b.column(1), end_id)
                doc, number, start, length = _cut(n_of, capacity)
                ends = np.cumsum(length)
                raw = memoryview(ids.astype("<u4")).cast("B")
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), length.tolist())]
                cols = [b.column(0).take(pa.array(doc)), pa.array(number, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)
        trim()

    return _rows(df, text, key).mapInArrow(encode, schema)


def _encoded(df: DataFrame, tokenizer: str, end_id: int, capacity: int, text: str, key: str, keeps_space: bool) -> DataFrame:
    """The pieces on their way (ENCODED)."""

    def encode(batches):
        from pyspark import TaskContext

        enc, part = None, TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for b in slices(batch, "_text", 3 << 20):
                enc = enc or encoder(tokenizer, keeps_space)
                ids, n_of = enc.encode(b.column(1), end_id)
                doc, number, start, length = _cut(n_of, capacity)
                order = np.argsort(length, kind="stable")
                sorted_ = length[order]
                run = np.arange(len(order)) - np.searchsorted(sorted_, sorted_)
                nth = np.empty(len(order), np.int64)
                nth[order] = run + seen[sorted_]
                seen += np.bincount(length, minlength=capacity + 1)
                kind = np.dtype("<u2" if max(enc.size, end_id + 1) <= 1 << 16 else "<u4")
                edges = pa.array(np.concatenate(([0], np.cumsum(length))) * kind.itemsize, pa.int32())
                binary = pa.BinaryArray.from_buffers(pa.binary(), len(length), [None, edges.buffers()[1], pa.py_buffer(ids.astype(kind))])
                cols = [b.column(0).take(pa.array(doc)), pa.array(number, pa.int32()), pa.array(start), pa.array(length), pa.array(np.full(len(doc), part, np.int32)), pa.array(nth), binary]
                out = pa.RecordBatch.from_arrays(cols, ["doc_id", "piece", "start", "length", "part", "nth", "ids"])
                yield from (out.slice(at, 2000) for at in range(0, out.num_rows, 2000))
        trim()

    return _rows(df, text, key).mapInArrow(encode, ENCODED)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths, number of sequences) that use up counts (length: pieces).

    Exact fills first: singles for every length, then pairs, then triples, longest length first;
    then best-fit decreasing over what is left.
    """
    left = np.zeros(capacity + 1, np.int64)
    for n, c in counts.items():
        left[n] = c
    out: list[tuple[tuple[int, ...], int]] = []

    def take(*lengths: int) -> bool:
        need: dict[int, int] = {}
        for n in lengths:
            need[n] = need.get(n, 0) + 1
        k = min(int(left[n]) // m for n, m in need.items())
        if k > 0:
            for n, m in need.items():
                left[n] -= k * m
            out.append((lengths, k))
        return k > 0

    if left[capacity]:
        take(capacity)
    for n in range(capacity - 1, 0, -1):  # one piece fills the gap
        if left[n] and 0 < capacity - n <= n:
            take(n, capacity - n)
    for n in range(capacity - 2, 0, -1):  # a hashed sum of two
        gap = capacity - n
        while left[n]:
            a = np.arange(1, gap // 2 + 1)
            have = np.minimum(left[a], left[gap - a])
            have[a == gap - a] //= 2
            best = int(have.argmax()) if len(have) else 0
            if not len(have) or not have[best] or not take(n, gap - int(a[best]), int(a[best])):
                break
    bits = sum(1 << int(n) for n in np.flatnonzero(left))
    sums, stale = 0, True
    for n in range(capacity - 3, 0, -1):  # a hashed sum of three
        gap = capacity - n
        while left[n]:
            if stale:
                bits = sum(1 << int(x) for x in np.flatnonzero(left))
                sums = 0
                for x in np.flatnonzero(left).tolist():
                    sums |= bits << x
                stale = False
            hit = False
            for a in np.flatnonzero(left[: gap - 1])[::-1].tolist():
                rest = gap - a
                if not (sums >> rest) & 1:
                    continue
                b = np.flatnonzero((left[1:rest] > 0) & (left[rest - 1 : 0 : -1] > 0)) + 1
                for x in b.tolist():
                    if take(n, a, max(x, rest - x), min(x, rest - x)):
                        hit = stale = True
                        break
                if hit:
                    break
            if not hit:
                break
    gaps: list[int] = []  # best fit: open sequences by gap, each with its patterns
    opened: dict[int, list[list]] = {}

    def put(gap: int, pattern: tuple[int, ...], k: int) -> None:
        if gap not in opened:
            bisect.insort(gaps, gap)
            opened[gap] = []
        opened[gap].append([pattern, k])

    for n in range(capacity, 0, -1):
        c = int(left[n])
        while c:
            at = bisect.bisect_left(gaps, n)
            if at == len(gaps):
                each = capacity // n
                if c >= each:
                    put(capacity - each * n, (n,) * each, c // each)
                    c %= each
                else:
                    put(capacity - c * n, (n,) * c, 1)
                    c = 0
                continue
            gap = gaps[at]
            pattern, k = opened[gap][-1]
            used = min(k, c)
            opened[gap][-1][1] -= used
            if opened[gap][-1][1] == 0:
                opened[gap].pop()
                if not opened[gap]:
                    del opened[gap]
                    gaps.pop(at)
            put(gap - n, (*pattern, n), used)
            c -= used
    out += [(tuple(p), k) for group in opened.values() for p, k in group]
    return out


def _counts(pieces: DataFrame, capacity: int) -> dict[int, int]:
    counts = {int(r[0]): int(r[1]) for r in pieces.groupBy("length").agg(F.sum("n")).collect()}  # at most `capacity`
    bad = [x for x in counts if not 0 < x <= capacity]
    if bad:
        raise ValueError(f"pieces of lengths {bad[:3]} can't be packed into {capacity}")
    return counts


def _place(ranked: DataFrame, counts: dict[int, int], capacity: int) -> DataFrame:
    """ranked (length, _rank: 0-based among the pieces of a length) with sequence_id and offset."""
    # By length: at rank lo, the piece goes to sequence first + (rank - lo) at this offset.
    spans: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = dict.fromkeys(counts, 0)
    sequence = 0
    for pattern, k in plan(counts, capacity):
        at = 0
        for x in pattern:
            spans.setdefault(x, []).append((used[x], sequence, at))
            used[x] += k
            at += x
        sequence += k
    flat = {x: tuple(np.array(c, np.int64) for c in zip(*s)) for x, s in spans.items()}

    @F.pandas_udf("sequence_id long, offset long")
    def place(length, rank):
        import pandas as pd

        n, r = length.to_numpy(), rank.to_numpy()
        seq, off = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
        order = np.argsort(n, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(n[order])) + 1) if len(n) else []:
            lo, first, at = flat[int(n[rows[0]])]
            k = np.searchsorted(lo, r[rows], "right") - 1
            seq[rows], off[rows] = first[k] + r[rows] - lo[k], at[k]
        return pd.DataFrame({"sequence_id": seq, "offset": off})

    return ranked.withColumn("_p", place("length", "_rank")).withColumns({"sequence_id": F.col("_p.sequence_id"), "offset": F.col("_p.offset")}).drop("_rank", "_p")


def pack(pieces: DataFrame, capacity: int = 4096, block: int = 2_000) -> DataFrame:
    """pieces (doc_id, piece, start, length, ...) with sequence_id and offset.

    Pieces of one length are ranked by (hash block, doc_id, piece), so equal input gives equal
    output. A frequent length is ranked in blocks of about `block` rows. Every length is 1 to
    capacity. Repeated rows are pieces of their own; null doc_ids sort first; an empty table gives an
    empty result.
    """
    # one narrow pass for the counts, another for the ranks: the pieces are written once
    pieces = table(pieces, "pieces")
    counts = _counts(pieces.groupBy("length").agg(F.count("*").alias("n")), capacity)
    blocks = F.get(F.lit([1 + counts.get(x, 0) // block for x in range(capacity + 1)]), F.col("length").cast("int"))
    keyed = pieces.withColumn("_block", F.pmod(F.xxhash64("doc_id", "piece"), blocks).cast("int"))
    sizes = keyed.groupBy("length", "_block").count()
    before = F.sum("count").over(Window.partitionBy("length").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    based = sizes.select("length", "_block", F.coalesce(before, F.lit(0)).alias("_base"))
    rank = F.row_number().over(Window.partitionBy("length", "_block").orderBy(F.col("doc_id").asc_nulls_first(), "piece", "start")) - 1
    ranked = keyed.withColumn("_in", rank).join(based, ["length", "_block"]).withColumn("_rank", F.col("_base") + F.col("_in"))
    return _place(ranked, counts, capacity).drop("_block", "_in", "_base")


SEQUENCES = "sequence_id long, ids array<int>, pieces array<struct<doc_id: long, piece: int, start: long, offset: long>>"
PACKED = PIECES + ", sequence_id long, offset long"
#: Sequences that are joined up at once.
TOGETHER = 512


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and joined values of a list column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.diff(column.offsets.to_numpy()), column.flatten()


def _ids(column, n_of: np.ndarray) -> pa.Array:
    """All ids in a row of a column of lists or of bytes; n_of: how many each row has."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not pa.types.is_binary(column.type):
        return column.flatten()
    edges = np.frombuffer(column.buffers()[1], np.int32)[column.offset :][: len(column) + 1]
    size = int(edges[-1] - edges[0])
    kind = np.dtype("<u2" if size == 2 * int(n_of.sum()) else "<u4")
    return pa.array(np.frombuffer(column.buffers()[2], kind, size // kind.itemsize, int(edges[0])).astype(np.int32))


def _whole(t: pa.Table, capacity: int) -> pa.RecordBatch:
    seq, n_of = t["sequence_id"].to_numpy(), t["length"].to_numpy()
    ids = _ids(t["ids"], n_of)
    heads = np.flatnonzero(np.diff(seq, prepend=seq[0] - 1))
    ends = np.cumsum(n_of)
    at = ends - n_of
    begin = at - np.repeat(at[heads], np.diff(np.append(heads, len(seq))))
    if len(ids) != ends[-1] or not (begin == t["offset"].to_numpy()).all() or (begin + n_of).max() > capacity:
        raise ValueError("pieces overlap, leave gaps or exceed their sequence")
    cuts = pa.array(np.append(at[heads], ends[-1]), pa.int32())
    inner = pa.StructArray.from_arrays([*(t[c].combine_chunks() for c in ("doc_id", "piece", "start")), pa.array(begin)], ["doc_id", "piece", "start", "offset"])
    lists = pa.ListArray.from_arrays(pa.array(np.append(heads, len(seq)), pa.int32()), inner)
    return pa.RecordBatch.from_arrays([pa.array(seq[heads]), pa.ListArray.from_arrays(cuts, ids), lists], ["sequence_id", "ids", "pieces"])


def _join(batches, capacity: int):
    """Rows of sequences, from pieces in the order of (sequence_id, offset)."""
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        t = t if held is None else pa.concat_tables([held, t])
        seq = t["sequence_id"].to_numpy()
        heads = np.flatnonzero(np.diff(seq, prepend=seq[0] - 1))  # the last sequence may go on in the next batch
        for s in range(0, len(heads) - 1, TOGETHER):
            at = int(heads[s])
            yield _whole(t.slice(at, int(heads[min(s + TOGETHER, len(heads) - 1)]) - at), capacity)
        held = t.slice(int(heads[-1]))
    if held is not None:
        yield _whole(held, capacity)
    trim()


def _read(batches, with_ids: bool):
    """Rows of pieces, from sequences."""
    for b in batches:
        if not b.num_rows:
            continue
        size, ids = _flat(b.column(1))
        count, inner = _flat(b.column(2))
        offset = inner.field("offset").to_numpy()
        begin = offset + np.repeat(np.cumsum(size) - size, count)
        ends = np.append(begin[1:], size.sum())  # pieces lie side by side
        raw = memoryview(ids.to_numpy().astype("<u4")).cast("B")
        crc = [zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(begin.tolist(), ends.tolist())]
        seq = np.repeat(b.column(0).to_numpy(), count)
        cols = [*(inner.field(c) for c in ("doc_id", "piece", "start")), pa.array(ends - begin), pa.array(crc, pa.int64()), pa.array(seq), pa.array(offset)]
        if with_ids:
            cols.append(pa.ListArray.from_arrays(pa.array(np.append(begin, ends[-1]), pa.int32()), ids))
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] + ["ids"] * with_ids)
    trim()


def _dealt(packed: DataFrame) -> DataFrame:
    n = max(1, int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = packed.select("sequence_id", "offset", "doc_id", "piece", "start", "length", "ids")
    return rows.repartition(n, "sequence_id").sortWithinPartitions("sequence_id", "offset")


def sequences(packed: DataFrame, capacity: int = 4096) -> DataFrame:
    """The packed sequences: sequence_id, ids (those of its pieces, joined in order) and pieces
    (doc_id, piece, start and the offset where each begins). packed: of pack(), with ids (a list, or
    bytes as in ENCODED). Raises if a piece doesn't begin where the plan has put it."""
    return _dealt(packed).mapInArrow(lambda batches: _join(batches, capacity), SEQUENCES)


def sequence_pieces(packed: DataFrame, capacity: int = 4096, with_ids: bool = True) -> DataFrame:
    """The pieces as they lie in the sequences made: length, offset, ids_crc32 (little-endian
    unsigned 32-bit) and, with_ids, the ids are taken from there."""
    return _dealt(packed).mapInArrow(lambda batches: _read(_join(batches, capacity), with_ids), PACKED + (", ids array<int>" if with_ids else ""))


def packed_pieces(df: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096, with_ids: bool = True, text: str = "text", key: str = "doc_id", keeps_space: bool = False) -> DataFrame:
    """Encodes, cuts and packs documents, joins up their ids and gives the pieces of the sequences
    (see sequence_pieces).

    The ids are written once and exchanged once, to their sequences. Pieces of a length are ranked
    by the task that made them and their number there, so ranking takes no sort: a task's first
    rank of a length is the sum of the counts of the tasks before it. Null texts count as empty;
    repeated rows are documents of their own; an empty table gives an empty result; other columns
    are not read."""
    pieces = table(_encoded(df, tokenizer, end_id, capacity, text, key, keeps_space), "token-pieces")
    sizes = table(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "piece-counts")
    counts = _counts(sizes, capacity)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    based = cut(sizes.select("part", "length", F.coalesce(before, F.lit(0)).alias("_base")))
    discard(sizes)
    ranked = pieces.join(small_enough(based), ["part", "length"]).withColumn("_rank", F.col("_base") + F.col("nth"))
    return sequence_pieces(_place(ranked, counts, capacity), capacity, with_ids)


def pack_documents(df: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096, **options) -> DataFrame:
    """Encodes, cuts and packs documents (see token_pieces, pack)."""
    return pack(token_pieces(df, tokenizer, end_id, capacity, **options), capacity)
