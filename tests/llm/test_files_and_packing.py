"""Sharding, token files and packing against brute force."""

import collections
import random
import zlib

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from telospark.llm import packing, queries, sharding, token_files
from telospark.llm.queries import tokenizer_path
from telospark.llm.tokens import WordEncoder

ODD = ["", None, " ", "  a", "a  b", "a \n b", "a\n b", " a b ", "x\n\n y", "don't 's  z", "<|endoftext|> hi", "é è́ x", "tab\t x", "ΑΣ ς", "中文 字 1234 ,,.", "w" * 5000, "the cat " * 3000, "the cat", "the cat"]
SCHEMA = "doc_id long, text string, size string, slot string, offset string, _part int, law int"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x", "y", "z", 1, 2) for i, t in enumerate(texts)], SCHEMA)


def raw(path, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path(path))
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@pytest.mark.parametrize("path,keeps", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_word_encoder_equals_the_library(path, keeps):
    import pyarrow as pa

    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("aB é\n\t.,'s  1中") for _ in range(60)) for _ in range(300)]
    ids, n = WordEncoder(tokenizer_path(path), keeps).encode(pa.array(texts))
    expect = raw(path, texts)
    assert n.tolist() == [len(e) for e in expect]
    assert ids.tolist() == [i for e in expect for i in e]


def test_shards_are_near_equal_and_gapless(spark):
    rng = random.Random(2)
    texts = ["t%d " % rng.randrange(500) * rng.randrange(1, 40) for _ in range(1500)] + ["one hot text " * 4] * 700 + [None, None, ""]
    df = frame(spark, texts).withColumn("doc_id", F.when(F.col("doc_id") == 5, None).otherwise(F.col("doc_id")))
    rows = sharding.shard_by_bytes(df, 6, parts=3).collect()
    assert len(rows) == len(texts)
    total = {}
    for r in rows:
        total.setdefault(r.shard, []).append(r)
        assert r.size == len((r.text or "").encode()) + 8 and r.law == "bytes" and r._part == 1
    assert sorted(total) == list(range(6))
    sums = [sum(r.size for r in s) for s in total.values()]
    assert max(sums) - min(sums) < 0.06 * sum(sums) / 6 + 1000
    for s in total.values():
        assert sorted(r.slot for r in s) == list(range(len(s)))
    few = {}
    for r in rows:
        few.setdefault(r.text, set()).add(r.shard)
    assert sum(len(v) > 1 for k, v in few.items() if k != "one hot text " * 4) <= 5
    again = sharding.shard_by_bytes(df.repartition(7), 6, parts=3)
    assert {(r.doc_id, r.shard, r.slot) for r in again.collect()} == {(r.doc_id, r.shard, r.slot) for r in rows}


@pytest.mark.parametrize("key", [7, None])
def test_equal_rows_are_spread_over_the_shards(spark, key):
    """Thousands of rows equal in text and doc_id, among others."""
    df = spark.createDataFrame([(key, "the same words")] * 3000 + [(100 + i, f"row {i} " * (i % 5)) for i in range(100)], "doc_id long, text string").repartition(6)
    rows = sharding.shard_by_bytes(df, 24, parts=2).collect()
    sizes = [0] * 24
    slots = {}
    for r in rows:
        sizes[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert len(rows) == 3100 and len(slots) == 24
    assert max(sizes) - min(sizes) <= 0.04 * sum(sizes) / 24 + 2 * max(r.size for r in rows)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert collections.Counter((r.doc_id, r.text) for r in rows) == collections.Counter((r.doc_id, r.text) for r in df.collect())


def test_sharding_of_nothing_and_of_one(spark):
    assert sharding.shard_by_bytes(frame(spark, ["a"]).limit(0), 4).collect() == []
    assert [(r.shard, r.slot) for r in sharding.shard_by_bytes(frame(spark, ["a"]), 4).collect()] in ([(0, 0)], [(3, 0)], [(1, 0)], [(2, 0)])


def test_the_sharding_query_exchanges_the_texts(spark, tiny, monkeypatch):
    real = sharding.shard_by_bytes
    monkeypatch.setattr(sharding, "shard_by_bytes", lambda *a, **k: real(*a, **k).withColumn("text", F.lit("moved")))
    assert {r.text_crc32 for r in queries.op1_histogram_sort(spark, tiny).collect()} == {zlib.crc32(b"moved")}
    monkeypatch.undo()
    plan = queries.op1_histogram_sort(spark, tiny)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("crc32") < plan.index("RepartitionByExpression") and "text#" in plan.split("RepartitionByExpression")[1].splitlines()[1]


def test_token_files_round_trip(spark, tmp_path):
    manifest = token_files.write_token_files(frame(spark, ODD), tokenizer_path("byte_bpe_50k.json"), folder=str(tmp_path / "t"), length=64, partitions=3)
    got = token_files.read_token_files(manifest).orderBy("doc_id").collect()
    start = 0
    everything = []
    for r, ids in zip(got, raw("byte_bpe_50k.json", ODD)):
        ids = [*ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
        everything += ids
    assert len(got) == len(ODD)
    back = []
    for row in manifest.orderBy("part").collect():
        f = token_files.TokenFile(row.file)
        for k in range(len(f)):
            ids, mask = f.sequence(k)
            assert len(ids) == 64 and not ids.flags.owndata
            back += ids[np.array(mask.to_pylist())].tolist()
    assert back == everything
    empty = token_files.write_token_files(frame(spark, ODD).limit(0), tokenizer_path("byte_bpe_50k.json"), folder=str(tmp_path / "e"))
    assert token_files.read_token_files(empty).collect() == []


def test_packing(spark):
    out = packing.pack_documents(frame(spark, ODD), tokenizer_path("word_bpe_49k.json"), capacity=256, with_ids=True).collect()
    docs, seqs = {}, {}
    for r in out:
        docs.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append(r)
    for i, ids in enumerate(raw("word_bpe_49k.json", ODD)):
        ids = [*ids, 1]
        pieces = sorted(docs[i], key=lambda r: r.piece)
        assert [x for r in pieces for x in r.ids] == ids
        assert [r.start for r in pieces] == list(range(0, len(ids), 256))
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in pieces)
    for s in seqs.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256
    assert packing.pack_documents(frame(spark, ODD).limit(0), tokenizer_path("word_bpe_49k.json")).collect() == []


def test_sequences_are_made_and_read(spark, tiny, monkeypatch):
    packed = packing.pack_documents(frame(spark, ODD), tokenizer_path("word_bpe_49k.json"), capacity=256, with_ids=True)
    made = packing.sequences(packed, 256)
    texts = {i: [*ids, 1] for i, ids in enumerate(raw("word_bpe_49k.json", ODD))}
    rows = made.collect()
    for r in rows:
        assert r.ids == [x for p in r.pieces for x in texts[p.doc_id][p.start : p.start + 256]] and 0 < len(r.ids) <= 256
    assert sum(len(r.ids) for r in rows) == sum(map(len, texts.values()))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "ids"]
    assert sorted(packing.sequence_pieces(packed, 256).collect()) == sorted(packed.select(*columns).collect())
    with pytest.raises(Exception, match="overlap"):
        packing.sequences(packed.withColumn("offset", F.col("offset") + 1), 256).collect()
    assert packing.sequence_pieces(packed.limit(0), 256).collect() == []
    real = packing._join

    def sevens(batches, capacity):
        for b in real(batches, capacity):
            ids = b.column(1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(ids.offsets, pa.array([7] * len(ids.values), pa.int32())), b.column(2)], b.schema.names)

    monkeypatch.setattr(packing, "_join", sevens)
    assert all(r.ids_crc32 == zlib.crc32(np.full(r.length, 7, "<u4").tobytes()) for r in queries.op5_complement_packing(spark, tiny).collect())


def test_the_pipeline_gives_out_ids(spark, tiny):
    out = corpus_pipeline.pack_sequences(spark, spark.read.parquet(f"{tiny}/documents.parquet"), tiny).collect()
    assert out and all(len(r.ids) == r.length and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in out)


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_every_piece_and_few_sequences(seed):
    rng = random.Random(seed)
    cap = rng.choice([50, 256, 1000])
    counts = {}
    for _ in range(rng.choice([1, 40, 3000])):
        n = min(cap, max(1, int(rng.lognormvariate(3, 1))))
        counts[n] = counts.get(n, 0) + 1
    used, sequences = {}, 0
    for pattern, k in packing.plan(counts, cap):
        assert sum(pattern) <= cap and k > 0
        sequences += k
        for n in pattern:
            used[n] = used.get(n, 0) + k
    assert used == counts
    assert sequences <= 1.1 * -(-sum(n * c for n, c in counts.items()) // cap) + 1


def test_plan_fills_gaps_exactly():
    assert sorted(packing.plan({7: 1, 3: 1, 5: 1, 4: 1, 1: 1}, 10)) == [((5, 4, 1), 1), ((7, 3), 1)]
    assert packing.plan({4: 1, 3: 1, 2: 1, 1: 1}, 10) == [((4, 3, 2, 1), 1)]
    assert packing.plan({}, 10) == []


def test_token_files_are_bounded_and_wide_enough(spark, tmp_path):
    """Several files a part keep the order; null and repeated ids have their places."""
    df = spark.createDataFrame([(None, "none of it"), (3, None), (3, "twice the same id"), (3, "twice the same id"), (9, "x " * 500), (4, "")], "doc_id long, text string")
    manifest = token_files.write_token_files(df, tokenizer_path("byte_bpe_50k.json"), folder=str(tmp_path / "m"), length=16, partitions=1, file_ids=1)
    got = token_files.read_token_files(manifest).collect()
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == [None, 3, 3, 3, 4, 9]
    assert sum(r.n_tokens for r in got) == sum(r.n_tokens for r in manifest.collect())
    wide = token_files.write_token_files(df, tokenizer_path("byte_bpe_50k.json"), end_id=70_000, folder=str(tmp_path / "w"), length=16, partitions=2)
    f = [token_files.TokenFile(r.file) for r in wide.collect()]
    assert all(x.sequence(0)[0].dtype == np.uint32 for x in f) and any(70_000 in x.sequence(k)[0] for x in f for k in range(len(x)))
    with pytest.raises(ValueError, match="fit"):
        token_files._Writer(str(tmp_path / "n.arrow"), 16).add(np.array([1 << 16], np.uint32))


def test_packing_of_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "none of it", 1), (3, None, 2), (3, "twice", 3), (3, "twice", 4), (9, "x " * 500, 5)], "doc_id long, text string, length int")
    out = packing.packed_pieces(df, tokenizer_path("word_bpe_49k.json"), capacity=128).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.piece, r.length) for r in out) == [(False, 3, 0, 1), (False, 3, 0, 2), (False, 3, 0, 2), (False, 9, 0, 128), (False, 9, 1, 128), (False, 9, 2, 128), (False, 9, 3, 117), (True, 0, 0, 4)]
    seqs = {}
    for r in out:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        assert [o for o, _ in sorted(s)] == [sum(n for _, n in sorted(s)[:k]) for k in range(len(s))]
    assert packing.packed_pieces(df.limit(0), tokenizer_path("word_bpe_49k.json")).collect() == []
