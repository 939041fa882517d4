"""Quality classification by nearest-neighbour voting in a latent-semantic space.

A text's terms are its words, hashed, and 4-grams of character classes over the whole text (letters
by case, digits, spaces, line ends, each ASCII punctuation mark by itself), hashed, and repeats of a
word by itself. On a bounded sample of labelled documents, TF-IDF weights and a truncated SVD are
fitted; the sample's latent vectors and labels (at most MAX_LABELLED) are broadcast. Every
document's vector meets all of them in blocked matrix products; the score is the similarity-weighted
label of the neighbours.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from telospark.llm.minhash import _constants, word_hashes
from telospark.llm.tokens import slices, trim

#: The documented bound of the labelled sample: fit and broadcast don't grow with the input.
MAX_LABELLED = 4096
#: Buckets of shapes, buckets of words, and repeated words.
SHAPES, WORDS = 2048, 2048
TERMS = SHAPES + WORDS + 1
RANK = 48
#: Length of the words' part of a vector against that of the shapes'.
WORD_SHARE = 0.5
NEIGHBOURS = 15
POWER = 8


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Class of each byte (6 bits), and the bytes' hashes."""
    kind = np.full(256, 40, np.uint32)  # other bytes
    kind[128:] = 1  # letters beyond ASCII, as lower case
    kind[97:123], kind[65:91], kind[48:58] = 1, 2, 3
    kind[32], kind[9:14] = 4, 5
    for n, c in enumerate(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"):
        kind[c] = 6 + n
    return kind, _constants()[0]


def features(raw: bytes, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Counts of a text's terms; none for texts of under four bytes."""
    kind, byte = tables
    b = np.frombuffer(raw, np.uint8)
    out = np.zeros(TERMS, np.float32)
    if len(b) < 4:
        return out
    k = kind[b]
    code = (k[:-3] << np.uint32(18)) | (k[1:-2] << np.uint32(12)) | (k[2:-1] << np.uint32(6)) | k[3:]
    code = (code * np.uint32(2654435761)) >> np.uint32(21)
    out[:SHAPES] = np.bincount(code, minlength=SHAPES)
    w = word_hashes(raw, byte)
    out[SHAPES:-1] = np.bincount((w >> np.uint64(53)).astype(np.int64), minlength=WORDS)
    out[-1] = 4 * (w[1:] == w[:-1]).sum()
    return out


def _sparse(x: np.ndarray) -> bytes:
    """The terms that a text has (16 bits each), then their counts (32 bits each)."""
    at = np.flatnonzero(x)
    return at.astype(np.uint16).tobytes() + x[at].tobytes()


def _dense(rows: list[bytes]) -> np.ndarray:
    out = np.zeros((len(rows), TERMS), np.float32)
    for x, b in zip(out, rows):
        n = len(b) // 6
        x[np.frombuffer(b, np.uint16, n)] = np.frombuffer(b, np.uint8)[2 * n :].copy().view(np.float32)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF; shapes and words have the same length each."""
    x = np.log1p(counts) * idf
    words = x[:, SHAPES:-1]
    return _unit(np.concatenate([_unit(x[:, :SHAPES]), _unit(words) * WORD_SHARE, x[:, -1:] / np.maximum(np.linalg.norm(x[:, :SHAPES], axis=1, keepdims=True), 1e-12)], axis=1))


def fit(df: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", limit: int = MAX_LABELLED) -> dict:
    """The model, fitted on at most `limit` labelled keys, those of the smallest key hashes, one row
    each (of rows that repeat a key, that of the least text hash)."""
    some = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).select(F.col(key).alias("_k"), F.col(label).cast("int").alias("_y")).groupBy("_k").agg(F.min("_y").alias("_y"))
    some = some.orderBy(F.xxhash64("_k"), "_k").limit(limit)  # a bounded sample, by parameter

    def run(batches):
        given = _tables()
        for batch in batches:
            for b in slices(batch, "_text"):
                x = [_sparse(features(t or b"", given)) for t in b.column(3).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(x, pa.binary())], ["_k", "_y", "_h", "x"])

    rows = df.select(F.col(key).alias("_k"), F.col(text).alias("_text")).join(F.broadcast(some), "_k").select("_k", "_y", F.xxhash64("_text").alias("_h"), "_text")
    # rows that repeat a key: the one of the least text hash, so that `limit` bounds what is collected
    one = rows.mapInArrow(run, "_k long, _y int, _h long, x binary").groupBy("_k").agg(F.min(F.struct("_h", "x", "_y")).alias("r")).select("_k", "r._y", "r.x")
    got = sorted(one.collect())
    if not got:
        return {"idf": np.ones(TERMS, np.float32), "axes": np.zeros((TERMS, 1), np.float32), "vectors": np.zeros((1, 1), np.float32), "labels": np.full(1, 0.5, np.float32), "prior": 0.5}
    y, raw = np.array([r[1] for r in got], np.float32), [bytes(r[2]) for r in got]
    del got
    have = np.zeros(TERMS)
    for b in raw:
        have[np.frombuffer(b, np.uint16, len(b) // 6)] += 1
    idf = np.log((1 + len(raw)) / (1 + have)).astype(np.float32) + 1
    w = np.empty((len(raw), TERMS), np.float32)
    for at in range(0, len(raw), 256):  # the driver holds one dense matrix
        w[at : at + 256] = _weigh(_dense(raw[at : at + 256]), idf)
    del raw
    # Truncated SVD by subspace iteration, deterministic.
    rank = min(RANK, *w.shape)
    q = np.linalg.qr(w.T @ (w @ np.random.default_rng(5).standard_normal((TERMS, rank), np.float32)))[0]
    for _ in range(6):
        q = np.linalg.qr(w.T @ (w @ q))[0]
    return {"idf": idf, "axes": q.astype(np.float32), "vectors": _unit(w @ q).astype(np.float32), "labels": y, "prior": float(y.mean())}


def vote(counts: np.ndarray, model: dict) -> np.ndarray:
    """Scores of a block of texts: weighted label of the NEIGHBOURS nearest labelled vectors. Both
    labels weigh as if they were equally frequent in the sample."""
    v = _unit(_weigh(counts, model["idf"]) @ model["axes"])
    out = np.empty(len(v), np.float64)
    y, p = model["labels"], min(max(model["prior"], 0.02), 0.98)
    k = min(NEIGHBOURS, len(y))
    for at in range(0, len(v), 512):
        s = v[at : at + 512] @ model["vectors"].T
        near = np.argpartition(-s, k - 1, axis=1)[:, :k]
        w = np.maximum(np.take_along_axis(s, near, 1), 1e-3).astype(np.float64) ** POWER
        good, bad = (w * y[near]).sum(1) / p, (w * (1 - y[near])).sum(1) / (1 - p)
        out[at : at + 512] = (good + 1e-12) / (good + bad + 2e-12)
    return np.clip(out, 0.0, 1.0)


def score(df: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """df with score (0 to 1, higher: label 1 likelier). Only the text counts. Null and empty texts
    and texts of under four bytes have no terms: the sample's share of label 1. Extra columns pass
    through; score replaces a column of its name; an empty table stays empty."""
    given = df.sparkSession.sparkContext.broadcast(model)
    names = [c for c in df.columns if c != "score"]
    at = names.index(text)
    rows = df.select(*names)
    schema = StructType([*rows.schema.fields, StructField("score", DoubleType())])

    def run(batches):
        tables = _tables()
        m = given.value
        for batch in batches:
            for b in slices(batch, text):
                raw = b.column(at).cast(pa.binary()).to_pylist()
                out = np.empty(len(raw))
                for s in range(0, len(raw), 256):
                    x = np.stack([features(t or b"", tables) for t in raw[s : s + 256]])
                    got = vote(x, m)
                    got[x.sum(axis=1) == 0] = m["prior"]
                    out[s : s + 256] = got
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], [*b.schema.names, "score"])
        trim()

    return rows.mapInArrow(run, schema)


def held_out(key: str = "doc_id"):
    """Rows kept from the fit: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(F.encode(F.col(key).cast("string"), "UTF-8")), F.lit(4)) == 2, F.lit(False))


def classify(df: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = 0.7) -> DataFrame:
    """df with held_out, score and predicted (1 if score >= threshold)."""
    model = fit(df, labels.where(~held_out(key)), text, key)
    out = score(df, model, text)
    return out.withColumns({"held_out": held_out(key), "predicted": (F.col("score") >= threshold).cast("int")})
