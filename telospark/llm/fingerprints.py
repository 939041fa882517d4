"""Document fingerprints from closed syncmers over tokens; DataFrame functions only.

A token is a word, or one character where words say little: in scripts that are written without
spaces and in words of over LONG code points. The rule looks at the word alone, so texts of all
lengths and kinds are comparable. A k-mer is K tokens in a row; K - 1 marks stand before the first
and behind the last token, so that shorter texts have k-mers of the same kind. A k-mer is an anchor
if the smallest hash among its inner S-token substrings stands at its first or last place: a
property of the k-mer alone, so an edit moves only the anchors that it touches. All anchors are
kept, with their positions. The fingerprint is the whole set of their hashes, 32 bits each, and
likeness is that of two such sets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 5
S = 2
#: Bits of an anchor's hash in a fingerprint.
BITS = 32
#: Bytes of text of a range, the unit that one task sorts.
PART = 32 << 20
#: Words of more code points count as their characters.
LONG = 24
SPACELESS = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
_WORD = rf"[^\x20\x09-\x0D{SPACELESS}]"
TOKEN = rf"(?<!{_WORD}){_WORD}{{1,{LONG}}}+(?!{_WORD})|[^\x20\x09-\x0D]"


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _closed(h: Column, k: int, s: int) -> Column:
    """hash and pos (of the first token, from 0) of the closed syncmers over the token hashes h."""
    n = F.size(h)
    inner = F.transform(F.slice(h, 1, n - (s - 1)), lambda x, i: F.xxhash64(x, *(F.get(h, i + j) for j in range(1, s))))

    def closed(p: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            within = F.least(*(F.get(p, i + j) for j in range(1, k - s)))
            code = F.xxhash64(*(F.get(p, i + j) for j in range(0, k - s, s)), F.get(p, i + (k - s)))
            return F.when(F.least(x, F.get(p, i + (k - s))) <= within, F.struct(code.alias("hash"), i.alias("pos")))

        return F.array_compact(F.transform(F.slice(p, 1, n - k + 1), one))

    return F.when(n >= k, _let(inner, closed)).otherwise(F.array().cast("array<struct<hash:bigint,pos:int>>"))


def anchors(text: Column) -> Column:
    """All closed syncmers of a text in order, repeated ones too: array of hash and pos, the number
    of the first of their K tokens (from 0; less by up to K - 1 where marks stand before the text).
    A text without tokens has none."""
    marks = [F.array(*(F.lit(m).cast("long") for _ in range(K - 1))) for m in (0, 1)]
    tokens = F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda w: F.xxhash64(w))
    found = _let(tokens, lambda h: F.when(F.size(h) > 0, F.concat(marks[0], h, marks[1])).otherwise(h))
    return F.transform(_let(found, lambda h: _closed(h, K, S)), lambda a: F.struct(a["hash"].alias("hash"), (a["pos"] - (K - 1)).alias("pos")))


def hashes(found: Column) -> Column:
    """The distinct hashes of anchors, cut to BITS bits, ascending."""
    return F.array_sort(F.array_distinct(F.transform(found, lambda a: a["hash"].bitwiseAND((1 << BITS) - 1))))


def render(a: Column) -> Column:
    """The fingerprint of a set of hashes: all of them, ascending, in hex with a space between."""
    return F.array_join(F.transform(a, F.hex), " ")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets of hashes. 1 for two empty sets, 0 for one."""
    both = F.size(F.array_intersect(a, b))
    ratio = _let(both, lambda n: n / (F.size(a) + F.size(b) - n)).cast("double")
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(ratio)


def with_next(df: DataFrame, key: str, text: str, first: dict, derived: dict, parts: int) -> DataFrame:
    """df (key, text) with the columns of first (name: function of the text column) and of derived
    (name: (one of first, function of it)), and next_<c> for the text and each derived column: that of the row with the next smaller key, for the smallest key that of
    the largest. Rows are dealt by key ranges and sorted there. The last text of a range is also
    dealt to the next one, as a row before its first, so no task sees all rows and no text is
    broadcast: only the ranges' numbers and largest keys are."""
    probes = [i / parts for i in range(1, parts)]
    cuts = sorted(set(df.stat.approxQuantile(key, probes, 0.25 / parts))) if parts > 1 and df.head(1) else []
    part = F.size(F.filter(F.array(*(F.lit(int(c)) for c in cuts)).cast("array<bigint>"), lambda c: c < F.col(key)))
    df = df.select(key, text, F.when(F.col(key).isNull(), F.lit(-1)).otherwise(part).alias("_part"))
    ring = Window.orderBy("_part")  # over one narrow row per range
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    top = df.groupBy("_part").agg(F.max(key).alias("_top"))
    top = top.select(F.col("_part").alias("_at"), "_top", F.coalesce(F.lead("_part").over(ring), F.first("_part").over(whole)).alias("_to"))
    edges = df.join(F.broadcast(top), (F.col("_part") == F.col("_at")) & F.col(key).eqNullSafe(F.col("_top")))
    edges = edges.groupBy("_to").agg(F.max(text).alias(text)).select(F.lit(None).cast("long").alias(key), text, F.col("_to").alias("_part"), F.lit(0).alias("_own"))
    columns = [text, *derived]
    order = ["_own", F.col(key).asc_nulls_first(), text]
    back = Window.partitionBy("_part").orderBy(*order)
    # dealt and sorted before the derived columns are made: those are larger than the texts
    rows = df.withColumn("_own", F.lit(1)).unionByName(edges).repartition(parts, "_part").sortWithinPartitions("_part", *order)
    out = rows.withColumns({c: f(F.col(text)) for c, f in first.items()}).withColumns({c: f(F.col(of)) for c, (of, f) in derived.items()})
    out = out.withColumns({f"next_{c}": F.lag(c).over(back) for c in columns}).where("_own = 1")
    return out.select(key, *first, *columns, *(f"next_{c}" for c in columns))


def compare_edited(df: DataFrame, text: str = "text", key: str = "doc_id", parts: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next and
    anchors (array of hash and pos, all of the text's).

    The edited text replaces the last third (rounded down) of a text's code points by the first as
    many of the next document in descending doc_id order, the last document being followed by the
    first. Null texts count as empty. Null doc_ids come last in that order. Repeated doc_ids are
    ordered by text. A single document follows itself. An empty table gives an empty result; other
    columns are not read.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    if parts is None:
        total = rows.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
        parts = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PART))
    near = with_next(rows, "doc_id", "text", {"anchors": anchors}, {"a": ("anchors", hashes)}, parts)
    n = F.char_length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.substring(F.col("next_text"), F.lit(1), third))
    out = near.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("_edited"), "anchors", "a", "next_a")
    out = out.select("doc_id", "n_chars", F.sha2(F.encode("_edited", "UTF-8"), 256).alias("edited_sha256"), "anchors", "a", hashes(anchors(F.col("_edited"))).alias("e"), "next_a")
    return out.select("doc_id", "n_chars", "edited_sha256", render(F.col("a")).alias("fingerprint"), render(F.col("e")).alias("edited_fingerprint"), likeness(F.col("a"), F.col("e")).alias("near_edited"), likeness(F.col("a"), F.col("next_a")).alias("near_next"), "anchors")
