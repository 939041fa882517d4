"""Near-duplicate operators, repeats and fingerprints against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from telospark.llm import embedding_graph, fingerprints, minhash, repeats
from telospark.llm.common import components

SCHEMA = "doc_id long, text string, component_id string, kept string, bucket int, sig int, _text int"


def frame(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "x", "y", 1, 2, 3) for i, t in zip(ids or range(len(texts)), texts)], SCHEMA)


def forest(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def word_sets(texts):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def near_texts(n_families=12, seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéz") for _ in range(rng.randint(1, 6)))
    texts = ["", None, " \t\n", "one", "One", "two words", "ÀB c d e f", "àb c d e f", "same text here with six words", "SAME text  here\nwith six words"]
    for _ in range(n_families):
        base = [word() for _ in range(rng.choice([6, 40, 300]))]
        for _ in range(rng.randint(1, 9)):
            w = list(base)
            for _ in range(int(len(w) * rng.choice([0, 0.01, 0.02, 0.04, 0.07]))):
                w[rng.randrange(len(w))] = word()
            texts.append(" ".join(w))
    return texts


def check_components(rows, texts):
    s = word_sets(texts)
    links = [(i, j) for i in range(len(s)) for j in range(i) if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 75 * len(s[i] | s[j])]
    expect = forest(len(s), links)
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(texts)
    for i in range(len(texts)):
        assert got[i].component_id == expect[i], i
        assert got[i].n_shingles == len(s[i]) and got[i].kept == (expect[i] == i)


def test_near_duplicates(spark):
    texts = near_texts()
    check_components(minhash.near_duplicates(frame(spark, texts)).collect(), texts)


def test_near_duplicates_in_a_hot_group(spark):
    """Many copies of one text edited apart, so that a bucket holds several components."""
    rng = random.Random(9)
    base = ["w%d" % i for i in range(60)]
    texts = []
    for _ in range(260):
        w = list(base)
        for _ in range(rng.choice([1, 1, 2, 3, 4])):
            w[rng.randrange(60)] = "x%d" % rng.randrange(10**6)
        texts.append(" ".join(w))
    check_components(minhash.near_duplicates(frame(spark, texts)).collect(), texts)


def test_near_duplicates_in_a_large_partly_linked_group(spark, monkeypatch):
    """2,000 texts of one family, drifting apart: some pairs are linked, most aren't; several blocks
    a bucket. Rows that leave the block stage stay in proportion to the members."""
    rng = random.Random(4)
    line, texts = [["w%d" % i for i in range(60)] for _ in range(40)], []
    for k in range(2000):
        w = line[k % 40]
        for _ in range(rng.choice([1, 2, 3])):
            w[rng.randrange(60)] = "x%d" % rng.randrange(10**6) if rng.random() < 0.2 else "w%d" % rng.randrange(60)
        texts.append(" ".join(w))
    monkeypatch.setattr(minhash, "BLOCK", 64)
    made, real = [], minhash._likely
    monkeypatch.setattr(minhash, "_likely", lambda *a: made.append(minhash.table(real(*a), "made")) or made[0])
    check_components(minhash.near_duplicates(frame(spark, texts)).collect(), texts)
    assert made


def test_near_duplicates_odd_input(spark):
    assert minhash.near_duplicates(frame(spark, ["a"]).limit(0)).collect() == []
    t = "a b c d e f g"
    df = frame(spark, [t, t, t, "z", t], [4, 4, None, 9, 2])
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(4, 2, False), (4, 2, False), (None, None, True), (9, 9, True), (2, 2, True)], key=str)


def test_bayes_bounds_keep_what_is_likely():
    need = minhash.least_matches(0.75, 1e-5)
    rng = np.random.default_rng(0)
    same = rng.random((4000, minhash.HASHES)) < 0.76
    got = np.cumsum(same, axis=1)[:, minhash.STEP - 1 :: minhash.STEP]
    assert (got >= np.array(need)).all(axis=1).mean() > 0.999
    assert (np.cumsum(rng.random((4000, minhash.HASHES)) < 0.4, axis=1)[:, -1] >= need[-1]).mean() < 0.01


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)] + [(7, 7), (500, 500)]
    expect = forest(600, edges)
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: expect[i] for e in edges for i in e}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def cut_brute(texts, length=50):
    seen, out = set(), []
    for t in texts:
        b = (t or "").encode()
        mask = np.zeros(len(b), bool)
        mine = [b[i : i + length] for i in range(len(b) - length + 1)]
        for i, w in enumerate(mine):
            if w in seen:
                mask[i : i + length] = True
        seen |= set(mine)
        edge = np.diff(np.concatenate(([0], mask.view(np.int8), [0])))
        out.append((len(b), int(mask.sum()), int((edge == 1).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~mask].tobytes()).hexdigest()))
    return out


def repeat_texts(seed=4):
    rng = random.Random(seed)
    some = lambda n, letters="abcdefghéü ": "".join(rng.choice(letters) for _ in range(n))
    shared = [some(n) for n in (49, 50, 51, 80, 200, 700)]
    texts = ["", None, "short", "a" * 49, "a" * 50, "a" * 51, "ab" * 60, "a" * 400]
    for _ in range(60):
        parts = [some(rng.choice([0, 5, 60])) for _ in range(3)]
        for p in rng.sample(shared, 2):
            a = rng.randrange(0, 20)
            parts.insert(rng.randrange(len(parts)), p[a:])
        texts.append("".join(parts))
    return [*texts, texts[20], texts[20], some(3000)]


@pytest.mark.parametrize("hot", [200, 1])
def test_repeats(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    texts = repeat_texts()
    got = {r.doc_id: r for r in repeats.remove_repeats(frame(spark, texts), with_kept=True).collect()}
    assert len(got) == len(texts)
    for i, e in enumerate(cut_brute(texts)):
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == e, i
        assert hashlib.sha256(r.kept).hexdigest() == e[3] and sum(s.end - s.start for s in r.spans) == e[1]


@pytest.mark.parametrize("length", [50, 64, 400])
def test_the_corpus_order_is_that_of_a_naive_suffix_array(length):
    """Windows of phrases around shared triggers, ordered by the two suffix arrays."""
    rng = np.random.default_rng(length)
    texts, entries, shapes, ids = [], [], [], []
    grams = [rng.integers(97, 99, repeats.GRAM, np.uint8) for _ in range(4)]
    for i in range(120):
        side = lambda: rng.choice(np.frombuffer(b"ab", np.uint8), int(rng.integers(0, 2 * length)))
        if i and rng.random() < 0.5:
            t, p = texts[int(rng.integers(len(texts)))]
        else:
            before, after = side(), side()
            t, p = np.concatenate([before, grams[i % 4], after]), len(before)
            if len(t) < length:
                t = np.concatenate([t, np.full(length - len(t), 97, np.uint8)])
        texts.append((t, p))
        m = len(t) - length + 1
        start, end = max(p - (length - repeats.GRAM), 0), min(p, m - 1) + 1
        e, shape = repeats._entries(t.tobytes(), np.array([p]), np.array([start]), np.array([end - start]), length)
        entries.append(e), shapes.append(shape), ids.append(1000 - i)
    entry, place, least = repeats.corpus_order(np.concatenate(entries), np.concatenate(shapes), np.array(ids), length)
    def parts(e, r):
        """A window, cut behind its trigger."""
        t, p = texts[e]
        q = max(p - (length - repeats.GRAM), 0) + r
        return t[q : p + repeats.GRAM].tobytes(), t[p + repeats.GRAM : q + length].tobytes()

    naive = sorted((parts(e, r), e, r) for e in range(len(texts)) for r in range(int(shapes[e][0, 1])))
    got = [parts(e, r) for e, r in zip(entry.tolist(), place.tolist())]
    assert got == [w for w, _, _ in naive] and all(len(x) + len(y) == length for x, y in got)
    for trigger in {x[-repeats.GRAM :] for x, _ in got}:  # where no suffix begins another: the order of all bytes
        mine = [x + y for x, y in got if x == trigger]
        assert mine == sorted(mine)
    first = {}
    for w, e, _ in naive:
        first[w] = min(first.get(w, 10**6), ids[e])
    assert least.tolist() == [first[w] for w in got]


def test_repeats_with_hot_triggers(spark, monkeypatch):
    """Windows dealt one by one, and phrases by trigger, give the same bytes."""
    rng = random.Random(8)
    line = "a line that stands in every one of the documents, and goes on for a while; " * 2
    texts = ["".join(rng.choice("abcd ") for _ in range(rng.randrange(60))) + line[rng.randrange(9) :] + "".join(rng.choice("abcd ") for _ in range(rng.randrange(60))) for _ in range(300)]
    texts += [line[:70] + t[10:90] for t in texts[:50]]
    for hot, many in ((200, 4096), (3, 4096), (200, 3), (2, 2)):
        monkeypatch.setattr(repeats, "HOT", hot)
        monkeypatch.setattr(repeats, "MANY", many)
        monkeypatch.setattr(repeats, "TOGETHER", 500)
        got = {r.doc_id: r for r in repeats.remove_repeats(frame(spark, texts).repartition(5)).collect()}
        for i, e in enumerate(cut_brute(texts)):
            assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == e, (hot, many, i)


def test_repeats_odd_input(spark):
    assert repeats.remove_repeats(frame(spark, ["a"]).limit(0)).collect() == []
    t = "0123456789" * 8
    got = repeats.remove_repeats(frame(spark, [t, t, t, "z" + t], [5, 5, None, 9])).collect()
    assert sorted(((r.doc_id, r.n_removed) for r in got), key=str) == sorted([(5, 80), (5, 80), (None, 0), (9, 80)], key=str)
    with pytest.raises(ValueError):
        repeats.remove_repeats(frame(spark, [t]), length=20)


def vectors(seed=5):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((500, 16))
    x[100:160] = x[100] + 0.05 * rng.standard_normal((60, 16))
    x[200:230] = x[200]
    x[230] = 3 * x[200]
    chain = [x[300] / np.linalg.norm(x[300])]
    for _ in range(8):
        chain.append(chain[-1] + 0.06 * rng.standard_normal(16))
    x[300:309] = chain
    return x.astype(np.float32)


def test_near_vectors(spark):
    x = vectors()
    bad = [None, [0.0] * 16, [float("nan")] * 16, [None] + [1.0] * 15, [float("inf")] + [1.0] * 15, [], [1.0, 2.0], [2.0, 4.0]]
    rows = [(i, v.tolist(), 0, "x") for i, v in enumerate(x)] + [(1000 + i, v, 0, "x") for i, v in enumerate(bad)] + [(0, x[0].tolist(), 0, "x"), (None, x[0].tolist(), 0, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, n_links string")
    got = {r.vec_id: r for r in embedding_graph.near_vectors(df).collect()}
    assert len(got) == len(x) + len(bad) + 1
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    s = u @ u.T >= 0.95
    np.fill_diagonal(s, False)
    expect = forest(len(x), [tuple(p) for p in np.argwhere(s)])
    assert sum(got[i].n_links for i in range(len(x))) >= 0.97 * s.sum()
    for i in range(len(x)):
        assert got[i].n_links <= s[i].sum()
        assert got[i].component_id == expect[i] and got[i].kept == (expect[i] == i)
    for i in range(6):
        assert (got[1000 + i].n_links, got[1000 + i].component_id) == (0, 1000 + i)
    assert got[1006].n_links == 1 and got[1007].component_id == 1006
    assert got[None].n_links == 0 and got[None].component_id is None
    assert {r.recall for r in got.values()} == {got[0].recall} and got[0].recall >= 0.97
    assert embedding_graph.near_vectors(df.limit(0)).collect() == []


def test_clusters_larger_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(embedding_graph, "BLOCK", 64)
    x = vectors()[:240]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    links = (u @ u.T >= 0.95).sum() - len(x)
    got = sum(r.n_links for r in embedding_graph.near_vectors(df).collect())
    assert 0.97 * links <= got <= links


def test_graph_search_recall():
    x = embedding_graph.unit(vectors())
    found = embedding_graph.search(x, embedding_graph.build_graph(x.astype(np.float32)), 0.9)
    s = x @ x.T >= 0.9
    np.fill_diagonal(s, False)
    assert not (found & ~s).any() and found.sum() >= 0.97 * s.sum()


def nested_groups(seed=7):
    """10 groups of 5 tight sub-groups of 60 vectors, sub-groups at 0.985 to their group's centre."""
    rng = np.random.default_rng(seed)
    unit = lambda v: v / np.linalg.norm(v)
    out = []
    for _ in range(10):
        centre = unit(rng.standard_normal(64))
        for _ in range(5):
            side = rng.standard_normal(64)
            side = unit(side - side @ centre * centre)
            middle = 0.985 * centre + np.sqrt(1 - 0.985**2) * side
            out += [unit(middle + 0.002 * rng.standard_normal(64)) for _ in range(60)]
    return np.array(out)


def test_candidates_take_fewer_cosines_than_all_pairs(monkeypatch):
    """4,000 vectors, a third in one partly linked group, and small groups of linked ones."""
    rng = np.random.default_rng(1)
    x = rng.standard_normal((4_000, 64))
    x[:1_333] = x[0] + 0.2 * rng.standard_normal((1_333, 64))
    for i in range(1_333, 3_990, 7):
        x[i : i + 3] = x[i] + 0.15 * rng.standard_normal((3, 64))
    x = embedding_graph.unit(x)
    taken, plain = [], embedding_graph._cosines
    monkeypatch.setattr(embedding_graph, "_cosines", lambda a, b: taken.append(plain(a, b)) or taken[-1])
    graph = embedding_graph.build_graph(x.astype(np.float32), 0.95 - embedding_graph.SLACK)
    assert sum(t.size for t in taken) < 0.4 * len(x) ** 2 / 2
    found = embedding_graph.search(x, graph, 0.95)
    s = x @ x.T >= 0.95
    np.fill_diagonal(s, False)
    few = s.sum(axis=1) < 5
    assert few.sum() > 2_000 and s[few].sum() > 1_000
    assert not (found & ~s).any() and found.sum() >= 0.999 * s.sum() and found[few].sum() >= 0.99 * s[few].sum()


def test_tight_groups_inside_groups():
    x = embedding_graph.unit(nested_groups())
    found = embedding_graph.search(x, embedding_graph.build_graph(x.astype(np.float32), 0.95 - embedding_graph.SLACK), 0.95)
    s = x @ x.T >= 0.95
    np.fill_diagonal(s, False)
    assert (embedding_graph.compare(x, 0.95) == s).all()
    assert not (found & ~s).any() and found.sum() >= 0.999 * s.sum()
    assert len(set(embedding_graph._roots(found))) == len(set(embedding_graph._roots(s)))


def test_links_that_no_graph_finds_are_compared_or_raise(spark, monkeypatch):
    x = vectors()[:240]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    none = lambda x, *_: np.zeros((len(x), len(x)), bool)
    monkeypatch.setattr(embedding_graph, "search", none)
    u = embedding_graph.unit(x)
    assert sum(r.n_links for r in embedding_graph.near_vectors(df, tries=1).collect()) == (u @ u.T >= 0.95).sum() - len(x)
    monkeypatch.setattr(embedding_graph, "compare", none)
    with pytest.raises(RuntimeError):
        embedding_graph.near_vectors(df, tries=1)


def test_edited_texts(spark):
    rng = random.Random(6)
    texts = ["", None, "a", "ab", "abc", "tiny text", "é" * 10, "word " * 300] + [" ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(rng.choice([3, 40, 200]))) for _ in range(40)]
    texts += [texts[-1]] * 3
    ids = [i * 7 - 20 for i in range(len(texts))]
    got = {r.doc_id: r for r in fingerprints.compare_edited(frame(spark, texts, ids), parts=5).collect()}
    assert len(got) == len(texts)
    by = dict(zip(ids, texts))
    down = sorted(ids, reverse=True)
    prints = collections.defaultdict(set)
    for i, j in zip(down, down[1:] + down[:1]):
        t, nxt = by[i] or "", by[j] or ""
        k = len(t) // 3
        e = t[: len(t) - k] + nxt[:k]
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest(), i
        prints[t].add(r.fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if e == t:
            assert r.near_edited == 1 and r.fingerprint == r.edited_fingerprint
        if t == nxt:
            assert r.near_next == 1
        elif len(t) > 300 and len(nxt) > 300 and "word" not in t + nxt:
            assert r.near_edited > 0.3 > r.near_next
    assert all(len(v) == 1 for v in prints.values())


def twin(text):
    """The fingerprint in plain Python, from the definition of closed syncmers."""
    import regex
    import xxhash

    def mixed(*longs):
        seed = 42
        for v in longs:
            seed = xxhash.xxh64_intdigest((v % 2**64).to_bytes(8, "little"), seed=seed % 2**64)
        return seed - 2**64 if seed >= 2**63 else seed

    k, s = fingerprints.K, fingerprints.S
    spaceless = "".join(rf"\p{{{n}}}" for n in ("Han", "Hiragana", "Katakana", "Thai", "Lao", "Khmer", "Myanmar"))
    tokens = []
    for word in regex.split(r"[\x20\x09-\x0D]+", text or ""):
        for run in regex.findall(rf"[{spaceless}]|[^{spaceless}]+", word):
            tokens += [run] if len(run) <= fingerprints.LONG else list(run)
    if not tokens:
        return ""
    h = [0] * (k - 1) + [xxhash.xxh64_intdigest(w.encode(), seed=42) for w in tokens] + [1] * (k - 1)
    p = [mixed(*h[i : i + s]) for i in range(len(h) - s + 1)]
    found = set()
    for i in range(len(h) - k + 1):
        inner = p[i : i + k - s + 1]
        if min(inner[0], inner[-1]) <= min(inner[1:-1]):
            found.add(mixed(*inner[: k - s : s], inner[-1]) % 2**fingerprints.BITS)
    return " ".join(f"{x:X}" for x in sorted(found))


def test_fingerprints_equal_a_plain_twin_and_carry_the_likeness(spark):
    """Also longer than any cap, and over range edges."""
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefghé") for _ in range(rng.randrange(1, 30))) for _ in range(400)] + ["天地玄黃", "x天y"]
    texts = [None, "", "a", "a b", "天地"] + [rng.choice((" ", "\n", "\t ")).join(rng.choices(words, k=rng.choice((4, 60, 900)))) for _ in range(30)]
    rows = fingerprints.compare_edited(frame(spark, texts), parts=4).collect()
    edited = {}
    for i, t in enumerate(texts):
        t, nxt = t or "", texts[i - 1] or ""
        edited[i] = t[: len(t) - len(t) // 3] + nxt[: len(t) // 3]

    def jaccard(a, b):
        a, b = set(a.split()), set(b.split())
        return len(a & b) / len(a | b) if a | b else 1.0

    by = {r.doc_id: r for r in rows}
    assert max(len(r.fingerprint.split()) for r in rows) > 300
    for r in rows:
        assert r.fingerprint == twin(texts[r.doc_id]) and r.edited_fingerprint == twin(edited[r.doc_id])
        assert r.near_edited == jaccard(r.fingerprint, r.edited_fingerprint)
        assert r.near_next == jaccard(r.fingerprint, by[(r.doc_id - 1) % len(texts)].fingerprint)


def test_edited_texts_odd_input(spark):
    assert fingerprints.compare_edited(frame(spark, ["a"]).limit(0)).collect() == []
    assert fingerprints.compare_edited(frame(spark, ["abc def"])).first().near_next == 1
    got = fingerprints.compare_edited(frame(spark, ["a b", "c d", "e f"], [3, 3, None])).collect()
    assert len(got) == 3


def test_anchor_rule(spark):
    """Closed syncmers by definition, over word hashes taken from Spark."""
    words = ["w%d" % i for i in range(40)]
    df = spark.createDataFrame([(" ".join(words), words)], "t string, w array<string>")
    h = df.select(F.transform("w", lambda w: F.xxhash64(w))).first()[0]
    two = spark.createDataFrame(list(zip(h, h[1:])), "a long, b long").select(F.xxhash64("a", "b"))
    p = [r[0] for r in two.collect()]
    keep = [i for i in range(len(p) - 3) if min(p[i], p[i + 3]) <= min(p[i + 1 : i + 3])]
    got = df.select(fingerprints._closed(F.transform("w", lambda w: F.xxhash64(w)), 5, 2)).first()[0]
    assert len(got) == len(keep) and 0 < len(keep) < len(p) - 3


def test_texts_of_all_lengths_are_comparable(spark):
    """Near copies on both sides of 400 characters and of K words, and texts without spaces."""
    rng = random.Random(8)
    some = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    words = " ".join(some(5, "abcdefgh") for _ in range(67))
    han, code = some(600, "天地玄黃宇宙洪荒日月盈昃辰宿列張"), some(700, "ABCDEFabcdef0123456789+/")
    pairs = [(words[:399], words[:399] + "zz"), ("a b c d", "a b c d e"), (han, han[:300] + "人" + han[300:]), (code, code[:350] + "x" + code[350:])]
    df = spark.createDataFrame(pairs, "s string, t string")
    one = lambda c: fingerprints.hashes(fingerprints.anchors(F.col(c)))
    got = [r[0] for r in df.select(fingerprints.likeness(one("s"), one("t"))).collect()]
    assert got[0] > 0.75 and got[1] > 0.1 and got[2] > 0.9 and got[3] > 0.9


def test_all_anchors_have_positions(spark):
    """A passage of 50 words in two long texts is found at its places, and nothing is capped."""
    rng = random.Random(9)
    some = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n)]
    shared = some(50)
    texts = [" ".join(some(7000) + shared + some(9000)), " ".join(some(300) + shared + some(15000) + shared)]
    a, b = ({} for _ in texts)
    rows = fingerprints.compare_edited(frame(spark, texts)).select("doc_id", "anchors").collect()
    for into, r in zip((a, b), sorted(rows)):
        assert len(r.anchors) > 7000
        for x in r.anchors:
            into.setdefault(x.hash, []).append(x.pos)
    common = [(p, q) for h in a.keys() & b.keys() for p in a[h] for q in b[h] if 0 <= p < 16040]
    assert sum(p - q == 6700 for p, q in common) >= 10 and sum(p - q == 7000 - 15350 for p, q in common) >= 10
    assert {p for p, _ in common} <= set(range(7000, 7046))
