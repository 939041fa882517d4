"""Collocations by contiguous pattern growth over projected occurrence pointers.

Words are counted first. Then each frequent word is a prefix: the pointers to its occurrences are
projected, each with the words that follow it within its piece, and sent to the prefix's task, where
patterns grow to the right, depth first: the extensions of a prefix are counted, and only frequent
ones are projected again and extended. Pointers stop at words that aren't frequent, since no
frequent pattern runs over one.

Pointers are aggregated where they are made, one row per prefix and block of text. A prefix of over
PART pointers is dealt into several tasks by what follows it, so that none gets more than about
PART; each of these grows its own patterns, and the counts that were split (those of the extensions by one
word) are summed afterwards. Which prefixes are that large is known from the word counts; their
list is bounded, because only a bounded number of words can each make up 1/HOT of all words.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telospark.llm.common import table

#: Pointers of a prefix that one task may get; larger prefixes are split.
PART = 500_000
#: At most so many prefixes can be in the list of large ones, by the threshold set with it.
HOT = 65_536
#: Bits of the filter of frequent words (2^25: 4 MB); full or not, it never loses a frequent word.
FILTER_BITS = 25
#: Positions aggregated at once, and bytes of text read at once.
BLOCK, BYTES = 1 << 20, 4 << 20
#: What ends a piece, as the contract's class, and the table that lowers A-Z and marks such ends.
ENDS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes(10 if c in ENDS else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))


class _Ids(dict):
    """Words to numbers, in the order of their first look-up; the end of a piece is 0."""

    def __init__(self) -> None:
        super().__init__({b"\n": 0, b"": -1})
        self.words = [b"\n"]

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.words)
        self.words.append(word)
        return n


def _chunks(raw: bytes) -> Iterator[bytes]:
    """A text in chunks of about BYTES that end between words."""
    start = 0
    while len(raw) - start > BYTES:
        end = raw.find(b" ", start + BYTES)
        if end < 0:
            break
        yield raw[start:end]
        start = end + 1
    yield raw[start:]


def _blocks(batches: Iterator[pa.RecordBatch], keep=None) -> Iterator[tuple[str, list[bytes], np.ndarray, np.ndarray]]:
    """(language, words, ids, places) of blocks of text of one language: ids of words with 0 at the ends
    of pieces, and the places (up to BLOCK) that the block answers for; two more ids follow them
    within a text. Texts are cut into blocks at any length."""
    open_: dict[str, tuple[_Ids, list[np.ndarray], int]] = {}

    def flush(lang: str, last: bool):
        ids, arrays, _ = open_.pop(lang)
        flat = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
        stop = len(flat) if last else len(flat) - 2
        yield lang, ids.words, flat, np.arange(max(0, stop))
        if not last and len(flat) > 1:  # the last two words wait for what follows them
            fresh = _Ids()
            tail = np.array([fresh[ids.words[i]] for i in flat[-2:].tolist()], np.int64)
            open_[lang] = (fresh, [tail], 2)

    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
            raw = text.as_buffer().to_pybytes() if text.is_valid else b""
            for chunk in _chunks(raw):
                chunk = chunk.translate(_TABLE)
                ids, arrays, n = open_.get(lang) or (_Ids(), [], 0)
                got = np.fromiter(map(ids.__getitem__, chunk.replace(b"\n", b" \n ").split(b" ")), np.int64)
                got = got[got >= 0]
                arrays.append(got)
                open_[lang] = (ids, arrays, n + len(got))
                if n + len(got) >= BLOCK:
                    yield from flush(lang, False)
            if lang in open_:
                ids, arrays, n = open_[lang]
                arrays.append(np.zeros(1, np.int64))  # a text ends its last piece
                open_[lang] = (ids, arrays, n + 1)
                if sum(n for _, _, n in open_.values()) >= 2 * BLOCK:  # many languages must not pile up
                    for other in list(open_):
                        yield from flush(other, True)
    for lang in list(open_):
        yield from flush(lang, True)


def _texts(df: DataFrame, text: str, lang: str) -> DataFrame:
    return df.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias("text"))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for lang, words, ids, places in _blocks(batches):
        n = np.bincount(ids[places], minlength=len(words))
        n[0] = 0
        some = np.flatnonzero(n)
        yield pa.record_batch({"lang": pa.array([lang] * len(some), pa.string()), "word": pa.array([words[i] for i in some.tolist()], pa.binary()), "n": pa.array(n[some], pa.int64())})


def word_counts(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, word (UTF-8 bytes), n: all words of all pieces."""
    counted = _texts(df, text, lang).mapInArrow(_count_words, "lang string, word binary, n long")
    return counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _place(lang: bytes, word: bytes) -> int:
    """A word's bit in the filter; the same as `_place_column`."""
    return zlib.crc32(lang + b" " + word) & ((1 << FILTER_BITS) - 1)


def _place_column() -> Column:
    return F.crc32(F.concat(F.encode("lang", "UTF-8"), F.lit(b" "), F.col("word"))).bitwiseAND((1 << FILTER_BITS) - 1)


def _filter(frequent: DataFrame) -> np.ndarray:
    """Bits of all frequent words; at most 2^FILTER_BITS / 64 rows reach the driver."""
    at = frequent.select(_place_column().alias("at"))
    parts = at.groupBy(F.shiftright("at", 6).alias("k")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("bits")).toArrow()
    bits = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    bits[parts["k"].to_numpy()] = parts["bits"].to_numpy()
    return bits.view(np.uint8)


def _project(bits, hot: dict[tuple[str, bytes], int], others: int):
    """Texts -> one row per frequent prefix, part and block: the distinct pairs of words that follow
    it, those that occur once ('ones') and the others with their counts ('many')."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = bits.value
        for lang, words, ids, places in _blocks(batches):
            name = lang.encode()
            at = np.fromiter((_place(name, w) for w in words), np.int64, len(words))
            kept = (flags[at >> 3] >> (at & 7)) & 1 == 1
            kept[0] = False
            # frequent words are numbered anew; 0 stands for all others and for ends
            number = np.zeros(len(words), np.int64)
            number[kept] = np.arange(1, kept.sum() + 1)
            own = [b""] + [w for w, k in zip(words, kept.tolist()) if k]
            flat = np.concatenate([number[ids], np.zeros(2, np.int64)])
            first = places[flat[places] > 0]
            a, b, c = flat[first], flat[first + 1], flat[first + 2]
            c = np.where(b > 0, c, 0)
            order = np.lexsort((c, b, a))
            a, b, c = a[order], b[order], c[order]
            new = np.flatnonzero(np.concatenate(([True], (np.diff(a) != 0) | (np.diff(b) != 0) | (np.diff(c) != 0)))) if len(a) else np.zeros(0, np.int64)
            n = np.diff(np.append(new, len(a)))
            a, b, c = a[new], b[new], c[new]
            some = b > 0  # a prefix that nothing follows has no extension
            a, b, c, n = a[some], b[some], c[some], n[some]
            tail = [w + b" " for w in own]
            pairs = [tail[x] + own[y] for x, y in zip(b.tolist(), c.tolist())]
            cuts = np.append(np.flatnonzero(np.diff(a, prepend=-1)), len(a)).tolist()
            rows: list[tuple] = []
            single = n == 1
            for s, e in zip(cuts[:-1], cuts[1:]):
                word = own[a[s]]
                ways = hot.get((lang, word), others)
                if ways == 1:
                    rows.append((word, 0, ways, b"\n".join(p for p, o in zip(pairs[s:e], single[s:e].tolist()) if o), b"\n".join(b"%s %d" % (p, k) for p, k in zip(pairs[s:e], n[s:e].tolist()) if k > 1)))
                    continue
                parts: dict[int, tuple[list[bytes], list[bytes]]] = {}
                for p, k in zip(pairs[s:e], n[s:e].tolist()):
                    mine = parts.setdefault(zlib.crc32(p) % ways, ([], []))
                    if k == 1:
                        mine[0].append(p)
                    else:
                        mine[1].append(b"%s %d" % (p, k))
                rows += [(word, part, ways, b"\n".join(x), b"\n".join(y)) for part, (x, y) in parts.items()]
            for i in range(0, len(rows), 20_000):
                w, p, k, x, y = zip(*rows[i : i + 20_000])
                yield pa.record_batch({"lang": pa.array([lang] * len(w), pa.string()), "prefix": pa.array(w, pa.binary()), "part": pa.array(p, pa.int32()), "ways": pa.array(k, pa.int32()), "ones": pa.array(x, pa.binary()), "many": pa.array(y, pa.binary())})

    return run


def _extend(pointers: Counter, least: int, partial: bool) -> Iterator[tuple[bytes, bytes | None, int]]:
    """Grows a prefix to the right, depth first. pointers: 'next' 'next but one' (or nothing) with
    counts. Yields (next, None, count), then its own extensions, before the next sibling. partial:
    the prefix is split, so that every extension by one word is given out to be summed."""
    by_next: dict[bytes, list[tuple[bytes, int]]] = {}
    for pair, n in pointers.items():
        x, _, y = pair.partition(b" ")
        by_next.setdefault(x, []).append((y, n))
    for x, projected in by_next.items():
        total = sum(n for _, n in projected)
        if total >= least or partial:
            yield x, None, total
        if total >= least:
            for y, n in projected:  # distinct already: a pattern of three words has one pair here
                if y and n >= least:
                    yield x, y, n


def _grow(least: int):
    """Rows of `_project`, sorted by prefix and part -> patterns of two and three words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            cols = list(zip(*out)) or [()] * 6
            out.clear()
            return pa.record_batch({k: pa.array(v, t) for k, v, t in zip(("lang", "w1", "w2", "w3", "n", "partial"), cols, (pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.bool_()))})

        def finish(key: tuple, pointers: Counter) -> None:
            lang, word, _, ways = key
            out.extend((lang, word, x, y, n, ways > 1) for x, y, n in _extend(pointers, least, ways > 1))

        now, pointers = None, Counter()
        for b in batches:
            for lang, word, part, ways, ones, many in zip(*(c.to_pylist() for c in b.columns)):
                key = (lang, word, part, ways)
                if key != now:
                    if now is not None:
                        finish(now, pointers)
                    now, pointers = key, Counter()
                    if len(out) > 20_000:
                        yield batch()
                if ones:
                    pointers.update(ones.split(b"\n"))
                if many:
                    for entry in many.split(b"\n"):
                        pair, _, n = entry.rpartition(b" ")
                        pointers[pair] += int(n)
        if now is not None:
            finish(now, pointers)
        yield batch()

    return run


def patterns(df: DataFrame, words: DataFrame, least: int = 10, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, w1, w2, w3 (null for two words), n: all patterns of two and three words with n >= least.
    words: the table of `word_counts`."""
    spark = df.sparkSession
    frequent = words.where(F.col("n") >= least)
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    large = max(PART, total // HOT + 1)  # fewer than HOT words can have as many
    hot = {(r["lang"], bytes(r["word"])): -(-r["n"] // PART) for r in frequent.where(F.col("n") >= large).collect()}
    bits = spark.sparkContext.broadcast(_filter(frequent))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // (16 * PART)))
    projected = _texts(df, text, lang).mapInArrow(_project(bits, hot, -(-large // PART)), "lang string, prefix binary, part int, ways int, ones binary, many binary")
    sorted_ = projected.repartition(tasks, "lang", "prefix", "part").sortWithinPartitions("lang", "prefix", "part")
    grown = table(sorted_.mapInArrow(_grow(least), "lang string, w1 binary, w2 binary, w3 binary, n long, partial boolean"), "patterns")
    summed = grown.where("partial and w3 is null").groupBy("lang", "w1", "w2").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    whole = grown.where("not partial or w3 is not null").select("lang", "w1", "w2", "w3", "n")
    return whole.union(summed.select("lang", "w1", "w2", F.lit(None).cast("binary").alias("w3"), "n"))


#: floor(1000000 * a * a / (l * r)), exactly: counts have at most 15 digits, so products fit 38; and
#: as a <= l and a <= r, the quotient fits a long.
_SCORE = "(cast(1000000 as decimal(7,0)) * (cast(a as decimal(15,0)) * cast(a as decimal(15,0)))) div (cast(l as decimal(15,0)) * cast(r as decimal(15,0)))"


def collocations(df: DataFrame, least: int = 10, most: int = 2000, inside: int = 50, text: str = "text", lang: str = "lang") -> DataFrame:
    """The `most` best phrases of two and three words of each language: lang, rank (from 1), phrase,
    a, l, r, n, score.

    A-Z are lowered; pieces end at `.,;:!?` and line ends; words are parted by spaces and tabs.
    a counts the phrase's places within pieces (at least `least`), n all words of the language. Of a
    phrase's cuts in two the one with the lowest score counts, ties to the shorter first part; l and r are the counts of its
    parts. A phrase inside a longer one with at least `inside` per cent of its count is dropped. Order: score and a descending, phrase
    ascending by UTF-8 bytes. Null texts count as empty, a null language as `und`; repeated rows
    count as often as they stand there; other columns are not read; a language without candidates
    has no row, an empty table gives an empty result.
    """
    words = table(word_counts(df, text, lang), "words")
    found = table(patterns(df, words, least, text, lang), "found")
    single = words.where(F.col("n") >= least)
    two = found.where("w3 is null").selectExpr("lang", "w1", "w2", "n as a")
    three = found.where("w3 is not null").selectExpr("lang", "w1", "w2", "w3", "n as a")
    first = single.selectExpr("lang", "word as w1", "n as f1")
    second, third = single.selectExpr("lang", "word as w2", "n as f2"), single.selectExpr("lang", "word as w3", "n as f3")
    head, rest = two.selectExpr("lang", "w1", "w2", "a as f12"), two.selectExpr("lang", "w1 as w2", "w2 as w3", "a as f23")

    longer = three.select("lang", F.expr("explode(array(struct(w1, w2), struct(w2 as w1, w3 as w2)))").alias("p"), "a").groupBy("lang", "p.w1", "p.w2").agg(F.max("a").alias("longest"))
    two = two.join(longer, ["lang", "w1", "w2"], "left").where(F.col("longest").isNull() | (100 * F.col("longest") < inside * F.col("a")))
    pairs = two.join(first, ["lang", "w1"]).join(second, ["lang", "w2"]).selectExpr("lang", "concat(w1, X'20', w2) as phrase", "a", "f1 as l", "f2 as r")
    triples = three.join(first, ["lang", "w1"]).join(third, ["lang", "w3"]).join(head, ["lang", "w1", "w2"]).join(rest, ["lang", "w2", "w3"])
    # the lower score has the larger product; both are floored before they are compared
    cut = lambda l, r: f"struct({_SCORE.replace('cast(l', f'cast({l}').replace('cast(r', f'cast({r}')} as score, {l} as l, {r} as r)"
    triples = triples.selectExpr("lang", "concat(w1, X'20', w2, X'20', w3) as phrase", "a", f"{cut('f1', 'f23')} as x", f"{cut('f12', 'f3')} as y")
    triples = triples.select("lang", "phrase", "a", F.when(F.col("y.score") < F.col("x.score"), F.col("y")).otherwise(F.col("x")).alias("c"))
    both = pairs.selectExpr("lang", "phrase", "a", "l", "r", f"{_SCORE} as score").union(triples.selectExpr("lang", "phrase", "a", "c.l", "c.r", "c.score"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase")))
    best = both.withColumn("rank", rank).where(F.col("rank") <= most)
    n = words.groupBy("lang").agg(F.sum("n").alias("n"))
    out = best.join(n, "lang")
    return out.select("lang", F.col("rank").cast("long").alias("rank"), F.col("phrase").cast("string").alias("phrase"), "a", "l", "r", "n", "score")
