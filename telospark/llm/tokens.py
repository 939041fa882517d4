"""Whole-text encoding with a public tokenizer; a word that a worker still knows is not encoded again."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words that a worker keeps encoded between batches; the memory bound of the cache (some 40 bytes a word).
CACHE_WORDS = 400_000

#: Marks at a word's end that a word-level tokenizer keeps together as one part.
_MARKS = ".,!?;:*#$%&|"


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places starts[i], starts[i] + 1, ... (counts[i] of them) of all i in a row."""
    ends = np.cumsum(counts, dtype=np.int32 if counts.sum() < 1 << 31 else np.int64)
    if not len(ends):
        return ends
    out = np.repeat((starts - ends + counts).astype(ends.dtype), counts)
    out += np.arange(len(out), dtype=ends.dtype)
    return out


class WordEncoder:
    """Encodes texts with a file of the `tokenizers` library.

    A text is cut before each ASCII space that follows a non-space; the tokenizers supported here
    never merge across such a cut, so the ids of a text are those of its pieces in a row. The
    pieces are encoded by the library; those that were seen lately are looked up. Texts with other
    runs of spaces go to the library whole. `keeps_space`: the tokenizer's words carry the space
    before them (byte-level); otherwise white space is dropped.
    """

    def __init__(self, path: str, keeps_space: bool):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.keeps_space = keeps_space
        # Byte-level vocabularies write a space as this letter; others mark the end of a word.
        table = self.tokenizer.get_vocab(with_added_tokens=True)
        self.size = max(table.values()) + 1
        self.marked = np.zeros(self.size, bool)
        self.marked[[i for t, i in table.items() if (t.startswith("Ġ") if keeps_space else t.endswith("</w>"))]] = True
        # The cache: word k has the ids flat[starts[k]:][:counts[k]] and was last met at round met[k].
        self.words = pa.array([], pa.large_string())
        self.flat = np.zeros(0, np.uint32)
        self.starts, self.counts, self.met = (np.zeros(0, np.int32) for _ in range(3))
        self.round = 0

    def _encode_new(self, words: list[str], parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(order, counts, ids): the words in the order in which they were encoded, how many ids each
        has, and these in a row. Words that are surely found again in a running text are encoded as
        one, which is cheaper; the others (0 parts) one by one. parts: marked tokens of a word."""
        alone, some = np.flatnonzero(parts == 0), np.flatnonzero(parts)
        chunks = [some[at : at + 4096] for at in range(0, len(some), 4096)]
        glue = "" if self.keeps_space else " "
        texts = [glue.join([words[i] for i in c.tolist()]) for c in chunks]
        order, counts, ids = [], [], []
        for c, e in zip(chunks, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            x = np.array(e.ids, dtype=np.uint32)
            # marked tokens: the first of each word, or the last of each of its parts
            at = np.flatnonzero(self.marked[x])
            ends = np.cumsum(parts[c])
            if len(at) != ends[-1]:
                alone = np.concatenate([alone, c])
                continue
            edges = np.append(at, len(x)) if self.keeps_space else np.concatenate(([0], at[ends - 1] + 1))
            order.append(c)
            counts.append(np.diff(edges))
            ids.append(x)
        for at in range(0, len(alone), 8192):
            c = alone[at : at + 8192]
            e = self.tokenizer.encode([words[i] for i in c.tolist()], is_pretokenized=True, add_special_tokens=False)
            order.append(c)
            ids.append(np.array(e.ids, dtype=np.uint32))
            counts.append(np.bincount(np.array(e.word_ids, dtype=np.int64), minlength=len(c)))
        return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (order, counts, ids))

    def _lookup(self, table: pa.Array, parts: np.ndarray) -> np.ndarray:
        """The cache's numbers of the words of table, new ones encoded and added."""
        self.round += 1
        known = pc.index_in(table, value_set=self.words)
        at = pc.fill_null(known, -1).to_numpy(zero_copy_only=False)
        new = np.flatnonzero(at < 0)
        if len(self.words) + len(new) > CACHE_WORDS and len(self.words):
            self._forget(at)
            at = pc.fill_null(pc.index_in(table, value_set=self.words), -1).to_numpy(zero_copy_only=False)
        at = at.copy()
        if len(new):
            fresh = table.take(pa.array(new))
            order, counts, ids = self._encode_new(fresh.to_pylist(), parts[new])
            at[new[order]] = len(self.words) + np.arange(len(new), dtype=np.int32)
            starts = len(self.flat) + np.cumsum(counts) - counts
            self.words = pa.concat_arrays([self.words, fresh.take(pa.array(order))])
            self.flat = np.concatenate([self.flat, ids.astype(np.uint32)])
            self.starts = np.concatenate([self.starts, starts.astype(np.int32)])
            self.counts = np.concatenate([self.counts, counts.astype(np.int32)])
            self.met = np.concatenate([self.met, np.zeros(len(new), np.int32)])
        self.met[at] = self.round
        return at

    def _forget(self, needed: np.ndarray) -> None:
        """Drops the words met least lately; at most half of the cache stays, besides those needed."""
        self.met[needed[needed >= 0]] = self.round
        half = np.partition(self.met, -(CACHE_WORDS // 2))[-(CACHE_WORDS // 2)] if len(self.met) > CACHE_WORDS // 2 else 0
        keep = np.flatnonzero((self.met > half) | (self.met == self.round))
        self.flat = self.flat[_spread(self.starts[keep], self.counts[keep])]
        self.words, self.counts, self.met = self.words.take(pa.array(keep)), self.counts[keep], self.met[keep]
        self.starts = (np.cumsum(self.counts) - self.counts).astype(np.int32)

    def _table(self, words: pa.Array, lead: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """The words as they are encoded, and their parts. lead: those that begin a text."""
        if self.keeps_space:  # the first piece of a text has no space before it
            spaced = pc.binary_join_element_wise(pa.scalar("", words.type), words, pa.scalar(" ", words.type))
            return pa.concat_arrays([spaced, words.take(pa.array(lead))]), np.repeat([1, 0], [len(words), len(lead)])
        core = pc.utf8_rtrim(words, characters=_MARKS)
        plain = pc.and_(pc.utf8_is_alpha(core), pc.utf8_is_alpha(pc.utf8_lower(core))).to_numpy(zero_copy_only=False)
        size, bare = (pc.binary_length(x).to_numpy(zero_copy_only=False) for x in (words, core))
        return words, np.where(plain | (bare == 0), (bare > 0).astype(np.int64) + (bare < size), 0)

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row as uint32, how many each text has); a null text has none.
        end_id is put behind each text."""
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        n = len(texts)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        split = pc.split_pattern(pc.fill_null(texts, "").cast(pa.large_string()), " ")
        first = split.offsets.to_numpy()  # every text has a piece at least
        coded = split.flatten().dictionary_encode()
        word_of, words = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
        del split, coded
        first = (first - first[0]).astype(np.int64)
        size = np.diff(first)
        blank = pc.or_(pc.equal(pc.binary_length(words), 0), pc.utf8_is_space(pc.utf8_slice_codeunits(words, 0, 1))).to_numpy(zero_copy_only=False)
        whole = np.zeros(n, bool)
        if blank.any():  # texts with a blank piece behind the first
            odd = blank[word_of]
            odd[first[:-1]] = False
            whole = np.add.reduceat(odd, first[:-1], dtype=np.int64) > 0
        leads = word_of[first[:-1]]
        lead = np.unique(leads)
        table, parts = self._table(words, lead)
        if self.keeps_space:
            word_of = word_of.copy()
            word_of[first[:-1]] = len(words) + np.searchsorted(lead, leads)
        used = np.zeros(len(table), bool)
        used[word_of if not whole.any() else word_of[np.repeat(~whole, size)]] = True
        used = np.flatnonzero(used)
        known = self._lookup(table.take(pa.array(used)), parts[used])
        starts, counts = np.zeros(len(table), np.int32), np.zeros(len(table), np.int32)
        starts[used], counts[used] = self.starts[known], self.counts[known]
        take = counts[word_of]
        if whole.any():
            take[np.repeat(whole, size)] = 0
        lengths = np.add.reduceat(take, first[:-1], dtype=np.int64)
        out = self.flat[_spread(starts[word_of], take)]
        if whole.any():
            at, rest = np.cumsum(lengths) - lengths, np.flatnonzero(whole)
            full = self.tokenizer.encode_batch([texts[int(i)].as_py() for i in rest], add_special_tokens=False)
            mine = {int(i): np.array(e.ids, np.uint32) for i, e in zip(rest, full)}
            out = np.concatenate([mine[i] if i in mine else out[at[i] : at[i] + lengths[i]] for i in range(n)])
            for i, x in mine.items():
                lengths[i] = len(x)
        if end_id is not None:
            out = np.insert(out, np.cumsum(lengths), np.uint32(end_id))
            lengths = lengths + 1
        return out, lengths


def encoder(path: str, keeps_space: bool) -> WordEncoder:
    """This process's encoder for a file. It outlives the task: functions come with each task by
    value, so their own globals don't."""
    import sys
    import types

    kept = sys.modules.setdefault("telospark_worker", types.ModuleType("telospark_worker")).__dict__
    if (path, keeps_space) not in kept:
        kept[path, keeps_space] = WordEncoder(path, keeps_space)
    return kept[path, keeps_space]


def trim() -> None:
    """Hands a worker's free memory back to the system; workers live on between stages."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library: nothing to hand back
        pass


def slices(batch: pa.RecordBatch, column: str, limit: int = 8 << 20):
    """Parts of a batch whose texts have about `limit` bytes at most (or one row)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to
