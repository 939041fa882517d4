"""Thin queries over the driver's tables: each applies one operator with production parameters to
its whole table and derives the digest columns of its contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telospark.llm import collocations, conversations, embedding_graph, fingerprints, licenses, minhash, mixing, packing, pii, quality, repeats, sharding, token_files

SHARDS = 24
PII_KEY = "an example key; callers bring their own secret"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents cross the exchange with their text; its digest is taken behind it."""
    out = sharding.shard_by_bytes(documents(spark, sf_dir), SHARDS)
    out = out.withColumn("text_crc32", F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")))
    return out.select("doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op2_pruned_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = embedding_graph.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), threshold=0.95)
    return out.select("vec_id", "n_links", "component_id", "kept")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write_token_files(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), end_id=2)
    return token_files.read_token_files(manifest)


def op4_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.pseudonymize(documents(spark, sf_dir), PII_KEY)
    return out.select("doc_id", "text", "lang", "source", "n_entities")


def op5_complement_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces as they lie in the sequences made."""
    out = packing.packed_pieces(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"), end_id=1, capacity=4096, with_ids=False)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op6_prefix_free_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(documents(spark, sf_dir), length=50).drop("spans")


def op7_minhash_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir), threshold=75)


def op8_closed_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_edited(documents(spark, sf_dir))


#: Shares of domains and, within each, of languages; sources share by their tokens.
WEIGHTS = {("web",): 0.5, ("books",): 0.3, ("forum",): 0.2} | {(d, k): w for d in ("web", "books", "forum") for k, w in (("en", 0.55), ("de", 0.15), ("fr", 0.15), ("es", 0.15))}


def domain_of():
    """The tables have no domain: sources 0-9 stand for web, 10-14 for books, others for forums."""
    n = F.expr("try_cast(regexp_extract(source, '([0-9]+)$', 1) as int)")
    return F.when(n < 10, "web").when(n < 15, "books").otherwise("forum")


def op9_hierarchical_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(documents(spark, sf_dir), WEIGHTS, domain_of(), fraction=0.8, epochs=2, seed=7)
    return out.select("doc_id", "domain", "lang", "source", "epoch", "n_tokens", "start")


def op10_neighbour_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = quality.classify(documents(spark, sf_dir), labels, threshold=0.7)
    return out.select("doc_id", "held_out", "score", "predicted")


def op11_pattern_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir), least=10, most=2000)


def op12_trie_mergesort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_license_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


QUERIES = {
    f.__name__: f
    for f in (op1_histogram_sort, op2_pruned_graph, op3_token_files, op4_surrogates, op5_complement_packing, op6_prefix_free_parsing, op7_minhash_bayes, op8_closed_syncmers, op9_hierarchical_mix, op10_neighbour_votes, op11_pattern_growth, op12_trie_mergesort, op13_license_join)
}


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _license_sql() -> str:
    """Every place and every block of every text, without the filters of the join."""
    phrases = ", ".join(f"({_list(p.split())}, '{label}')" for p, label in licenses.PHRASES.items())
    templates = ", ".join(f"({k}, '{t.label}', '{t.family}', {licenses.stride_of(len(t.text.split()))}, {_list(sorted(set(t.text.split())))})" for k, t in enumerate(licenses.TEMPLATES))
    return (
        "WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents), "
        f"p(q, label) AS (VALUES {phrases}), t(k, label, family, stride, own) AS (VALUES {templates}), "
        "o AS (SELECT doc_id, i, label FROM (SELECT doc_id, w, unnest(range(0, len(w))) AS i FROM d), p WHERE w[i + 1:i + len(q)] = q), "
        "b AS (SELECT doc_id, count(*) AS n, min(i) AS lo, max(i) AS hi, list(DISTINCT label) AS base FROM o GROUP BY doc_id), "
        "x AS (SELECT doc_id, stride, w[i + 1:i + 2 * stride] AS block FROM (SELECT doc_id, stride, w, unnest(range(0, len(w), stride)) AS i FROM d, (SELECT DISTINCT stride FROM t))), "
        "c AS (SELECT doc_id, label, family, len(list_intersect(own, block)) AS n, len(own) AS size FROM x JOIN t USING (stride)), "
        "m AS (SELECT doc_id, label, family, size, max(CAST(n AS DOUBLE) / size) AS score FROM c WHERE 5 * n >= 4 * size GROUP BY ALL), "
        "f AS (SELECT doc_id, max(score) AS score, list(DISTINCT label) AS more FROM (SELECT * FROM m QUALIFY rank() OVER (PARTITION BY doc_id, family ORDER BY score DESC, size DESC) = 1) GROUP BY doc_id) "
        "SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_base, lo AS first_word, hi AS last_word, array_to_string(list_sort(coalesce(base, [])), ',') AS base_labels, "
        "array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(more, [])))), ',') AS labels, CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE coalesce(score, 0.0) END AS score "
        "FROM d LEFT JOIN b USING (doc_id) LEFT JOIN f USING (doc_id)"
    )


_REACH = "r AS (SELECT a AS id, a AS root FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id), c AS (SELECT id, min(root) AS root FROM r GROUP BY id)"

#: SQL twins of the queries that SQL can express without trained models, tokenizers or our hashes.
ORACLE_SQL: dict[str, str] = {
    "op2_pruned_graph": (
        "WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE embedding IS NOT NULL AND list_sum(list_transform(embedding, lambda y: abs(y))) > 0), "
        "e AS (SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.vec_id <> q.vec_id AND list_cosine_similarity(p.x, q.x) >= 0.95), "
        f"{_REACH}, n AS (SELECT a, count(*) AS n FROM e GROUP BY a) "
        "SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(root, vec_id) AS component_id, coalesce(root, vec_id) = vec_id AS kept FROM embeddings LEFT JOIN n ON a = vec_id LEFT JOIN c ON id = vec_id"
    ),
    "op6_prefix_free_parsing": (
        "WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents), "
        "w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS i FROM d)), "
        "f AS (SELECT w.doc_id, i FROM w JOIN (SELECT s, min(doc_id) AS m FROM w GROUP BY s) USING (s) WHERE m < w.doc_id), "
        "g AS (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM f), "
        "k AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g) GROUP BY doc_id, run), "
        "q AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM k), "
        "t AS (SELECT q.doc_id, CAST(sum(b - a) AS BIGINT) AS removed, count(*) AS spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS rest FROM q JOIN d USING (doc_id) GROUP BY q.doc_id) "
        "SELECT d.doc_id, n AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(rest, h))) AS kept_sha256 FROM d LEFT JOIN t USING (doc_id)"
    ),
    "op7_minhash_bayes": (
        "WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents), "
        "s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS h FROM d), "
        "n AS (SELECT doc_id, CAST(len(h) AS BIGINT) AS n FROM s), x AS (SELECT doc_id, unnest(h) AS h FROM s), "
        "p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2), "
        "l AS (SELECT a, b FROM p JOIN n y ON y.doc_id = a JOIN n z ON z.doc_id = b WHERE 100 * c >= 75 * (y.n + z.n - c)), "
        f"e AS (SELECT a, b FROM l UNION SELECT b, a FROM l), {_REACH} "
        "SELECT doc_id, n AS n_shingles, coalesce(root, doc_id) AS component_id, coalesce(root, doc_id) = doc_id AS kept FROM n LEFT JOIN c ON id = doc_id"
    ),
    "op11_pattern_growth": (
        "WITH pc AS (SELECT doc_id, coalesce(lang, 'und') AS lang, row_number() OVER () AS d, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents), "
        "w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pc), "
        'u AS (SELECT lang, unnest(w) AS p FROM w), '
        'g2 AS (SELECT lang, unnest(list_transform(range(1, len(w)), lambda i: w[i:i + 1])) AS p FROM w WHERE len(w) > 1), '
        'g3 AS (SELECT lang, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2])) AS p FROM w WHERE len(w) > 2), '
        'f1 AS (SELECT lang, p, count(*) AS f FROM u GROUP BY ALL), n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f1 GROUP BY lang), '
        'f2 AS (SELECT lang, p, count(*) AS f FROM g2 GROUP BY ALL HAVING count(*) >= 10), f3 AS (SELECT lang, p, count(*) AS f FROM g3 GROUP BY ALL HAVING count(*) >= 10), '
        'm AS (SELECT lang, q, max(f) AS m FROM (SELECT lang, p[1:2] AS q, f FROM f3 UNION ALL SELECT lang, p[2:3], f FROM f3) GROUP BY ALL), '
        "c AS (SELECT f2.lang, array_to_string(f2.p, ' ') AS phrase, f2.f AS a, 1 AS k, x.f AS l, y.f AS r FROM f2 JOIN f1 x ON x.lang = f2.lang AND x.p = f2.p[1] JOIN f1 y ON y.lang = f2.lang AND y.p = f2.p[2] LEFT JOIN m ON m.lang = f2.lang AND m.q = f2.p WHERE m IS NULL OR 100 * m < 50 * f2.f "
        "UNION ALL SELECT f3.lang, array_to_string(f3.p, ' '), f3.f, 1, x.f, y.f FROM f3 JOIN f1 x ON x.lang = f3.lang AND x.p = f3.p[1] JOIN f2 y ON y.lang = f3.lang AND y.p = f3.p[2:3] "
        "UNION ALL SELECT f3.lang, array_to_string(f3.p, ' '), f3.f, 2, x.f, y.f FROM f3 JOIN f2 x ON x.lang = f3.lang AND x.p = f3.p[1:2] JOIN f1 y ON y.lang = f3.lang AND y.p = f3.p[3]), "
        's AS (SELECT *, CAST((1000000::HUGEINT * a * a) // (l::HUGEINT * r) AS BIGINT) AS score FROM c), '
        'b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1), '
        't AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM b QUALIFY rank <= 2000) '
        'SELECT t.lang, t.rank, phrase, a, l, r, n, score FROM t JOIN n USING (lang) '
    ),
    "op13_license_join": _license_sql(),
    "op12_trie_mergesort": (
        "WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS i, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL), "
        # crc32, a byte and then a bit at a time
        "k AS (SELECT c, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda s: ascii(s)::UBIGINT)), lambda h, b: list_reduce(list_prepend(xor(h, b), [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]), lambda y, z: xor(y >> 1, 3988292384::UBIGINT * (y & 1)))) AS h FROM (SELECT DISTINCT c FROM t)), "
        "ids AS (SELECT c, xor(h, 4294967295::UBIGINT) % 9 AS h FROM k), "
        "s AS (SELECT ids.c, 0 AS side, i, r, x FROM ids JOIN t ON t.c = ids.c - ids.c % 5 AND i < h UNION ALL SELECT ids.c, 1, i, r, x FROM ids JOIN t ON t.c = ids.c AND i >= h), "
        "q AS (SELECT ids.c, coalesce(list({'r': r, 'x': x} ORDER BY side, i) FILTER (i IS NOT NULL), []) AS s FROM ids LEFT JOIN s USING (c) GROUP BY ids.c), "
        "m AS (SELECT c, d, s[1:d] AS p, d = len(s) AS last FROM (SELECT c, s, unnest(range(0, len(s) + 1)) AS d FROM q)), "
        "n AS (SELECT p, d, min(c) AS c, count(*) AS n, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (last), '') AS ends FROM m GROUP BY p, d), "
        "o AS (SELECT *, coalesce((n - 1) * octet_length(encode(p[d].x)), 0) AS own, NOT EXISTS (SELECT 1 FROM n y WHERE y.d = n.d + 1 AND y.p[1:n.d] = n.p) AS leaf FROM n), "
        "u AS (SELECT p[1:e] AS p, sum(own) AS saved, count(*) FILTER (leaf) AS leaves, count(*) FILTER (d = e + 1) AS children FROM (SELECT *, unnest(range(0, d + 1)) AS e FROM o) GROUP BY ALL) "
        "SELECT o.c AS conv_id, o.d AS depth, y.c AS parent_conv_id, o.n AS n_convs, children AS n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(o.ends) AS ends_sha256 "
        "FROM o JOIN u ON u.p = o.p LEFT JOIN n y ON y.d = o.d - 1 AND y.p = o.p[1:o.d - 1]"
    ),
}
