"""Context-preserving random positions.

A draw is a function of (seed, transcript, context, simulation, slot), by md5, so partitions, retries
and other engines agree; it is uniform with replacement over the positions of a context.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telospark.functions.sequences import GENETIC_CODE, context, context_of
from telospark.operators.annotate import STARTS

SEED = 101


def context_index(tx: DataFrame, kind: float) -> DataFrame:
    """Long form: transcript_id, context, cds_pos for every base of the coding sequence."""
    each = tx.where(F.length("cds") > 0).select("transcript_id", "cds", F.explode(F.sequence(F.lit(0), F.length("cds") - 1)).alias("cds_pos"))
    return each.select("transcript_id", context(F.col("cds"), F.col("cds_pos"), kind).alias("context"), "cds_pos")


def context_positions(tx: DataFrame, kind: float) -> DataFrame:
    """transcript_id, context, positions (ascending array)."""
    return context_index(tx, kind).groupBy("transcript_id", "context").agg(F.array_sort(F.collect_list("cds_pos")).alias("positions"))


def draw(parts: list[Column], n: Column) -> Column:
    """A number from 0 to n - 1, fixed by the parts."""
    digest = F.substring(F.md5(F.encode(F.concat_ws("|", *(p.cast("string") for p in parts)), "UTF-8")), 1, 8)
    return F.pmod(F.conv(digest, 16, 10).cast("long"), n.cast("long")).cast("int")


def slot_runs(variants: DataFrame, kind: float, more: list[str]) -> DataFrame:
    """Slots of each unit's substitutions, and of its indels (kind is 'sub' or 'indel'), numbered from 0 by
    trinucleotide (tri), then start, ref, alt and cds_pos: one row per distinct variant with its context, slot (its
    first) and m (how many it has), so that a unit has no more rows than its transcript has variants, however many
    mutations there are. The rows are dealt by unit."""
    order = ["tri", "start", "ref", "alt", "cds_pos"]
    distinct = variants.groupBy("unit", "transcript_id", "kind", *order, *more).agg(F.count("*").alias("m")).repartition("unit")
    before = Window.partitionBy("unit", "kind").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    known = F.when(F.col("kind") == "sub", context_of(F.col("tri"), kind)).otherwise(context_of(F.col("tri"), 0))
    return distinct.withColumn("context", known).withColumn("slot", F.coalesce(F.sum("m").over(before), F.lit(0)))


def draws(slotted: DataFrame, positions: DataFrame, first: int, last: int, seed: int = SEED) -> DataFrame:
    """Simulations first to last - 1 of each slot: sim and drawn (0-based cds place). Slots of a
    context that the transcript doesn't have are dropped; check with unseen()."""
    df = slotted.join(positions, ["transcript_id", "context"]).withColumn("sim", F.explode(F.sequence(F.lit(first), F.lit(last - 1))))
    pick = draw([F.lit(seed), F.col("transcript_id"), F.col("context"), F.col("sim"), F.col("slot")], F.size("positions"))
    return df.withColumn("drawn", F.get("positions", pick)).drop("positions")


#: The constants and turns of MD5 (RFC 1321).
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TURNS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _heads(given: np.ndarray, written: np.ndarray) -> np.ndarray:
    """The first eight hexadecimal digits, as numbers, of the MD5 digests of many padded messages of one block, each of
    given (16 unsigned 32-bit words a row) with each of written (words that are 0 where given aren't): a row for each
    of given. The last three steps don't reach these digits."""
    a, b, c, d = (np.full((len(given), len(written)), x, np.uint32) for x in _START)
    t = np.empty_like(a)
    many = [given[:, g, None] | written[:, g] if written[:, g].any() else None for g in range(16)]
    one = [int(given[0, g]) if (given[:, g] == given[0, g]).all() else None for g in range(16)]
    for i in range(61):
        turn = i // 16
        if turn == 0:
            np.bitwise_xor(c, d, out=t)
            t &= b
            t ^= d
            g = i
        elif turn == 1:
            np.bitwise_xor(b, c, out=t)
            t &= d
            t ^= c
            g = (5 * i + 1) % 16
        elif turn == 2:
            np.bitwise_xor(b, c, out=t)
            t ^= d
            g = (3 * i + 5) % 16
        else:
            np.invert(d, out=t)
            t |= b
            t ^= c
            g = 7 * i % 16
        a += t
        # most words are equal in all messages, or in all of a row
        if many[g] is not None:
            a += many[g]
            a += np.uint32(_SINES[i])
        elif one[g] is not None:
            a += np.uint32((one[g] + _SINES[i]) % 2**32)
        else:
            a += given[:, g, None] + np.uint32(_SINES[i])
        by = _TURNS[turn][i % 4]
        np.left_shift(a, np.uint32(by), out=t)
        a >>= np.uint32(32 - by)
        a |= t
        a += b
        a, b, c, d = d, a, b, c
    b += np.uint32(_START[0])
    return b.byteswap()


#: Messages that are hashed together.
TOGETHER = 65_536


def numbers(before: list[bytes], after: list[bytes], first: int, last: int) -> np.ndarray:
    """What draw() takes its remainders of, for the parts before[i], sim, after[i] with their bars, sim from first to
    last - 1: one row for each i. For use in a task, for many i at once: those whose parts are as long go together."""
    out = np.empty((len(before), last - first), np.uint32)
    sizes: dict[tuple[int, int], list[int]] = {}
    for i, (x, y) in enumerate(zip(before, after)):
        sizes.setdefault((len(x), len(y)), []).append(i)
    alike = []
    for (n, m), rows in sizes.items():
        text = [np.frombuffer(b"".join(part[i] for i in rows), np.uint8).reshape(len(rows), -1) for part in (before, after)]
        alike.append((n, m, np.array(rows), *text))
    done = first
    while done < last:
        digits = len(str(done))
        end = min(last, 10**digits)
        figures = (np.arange(done, end)[:, None] // 10 ** np.arange(digits - 1, -1, -1) % 10 + 48).astype(np.uint8)
        for n, m, rows, head, tail in alike:
            size = n + digits + m
            if size >= 56:  # more than one block
                for i in rows:
                    out[i, done - first : end - first] = [int(hashlib.md5(before[i] + b"%d" % sim + after[i]).hexdigest()[:8], 16) for sim in range(done, end)]
                continue
            text, written = np.zeros((len(rows), 64), np.uint8), np.zeros((end - done, 64), np.uint8)
            text[:, :n], text[:, n + digits : size], text[:, size] = head, tail, 128
            text[:, 56:] = np.frombuffer((8 * size).to_bytes(8, "little"), np.uint8)
            written[:, n : n + digits] = figures
            text, written = text.view("<u4"), written.view("<u4")
            wide = min(len(written), TOGETHER)
            high = TOGETHER // wide
            for b in range(0, len(written), wide):
                at = slice(done - first + b, done - first + min(b + wide, len(written)))
                for a in range(0, len(rows), high):
                    out[rows[a : a + high], at] = _heads(text[a : a + high], written[b : b + wide])
        done = end
    return out


def unseen(slotted: DataFrame, positions: DataFrame) -> DataFrame:
    return slotted.join(positions, ["transcript_id", "context"], "left_anti")


def _residue(codon: Column) -> Column:
    """Amino acid of a codon, '*' for stops, X for unknown ones: its place in the code's order."""
    at = [F.position(F.substring(codon, i, 1), F.lit("TCAG")) for i in (1, 2, 3)]
    known = (F.length(codon) == 3) & (F.least(*at) > 0)
    return F.when(known, F.substring(F.lit(GENETIC_CODE), 16 * at[0] + 4 * at[1] + at[2] - 20, F.lit(1))).otherwise(F.lit("X"))


def _substituted() -> list[str]:
    """For each of the 64 codons, in the code's order: the residues of its twelve (base by base, A, C,
    G, T) substitutions."""
    codons = [x + y + z for x in "TCAG" for y in "TCAG" for z in "TCAG"]
    code = dict(zip(codons, GENETIC_CODE))
    return ["".join(code[c[:i] + b + c[i + 1 :]] for i in range(3) for b in "ACGT") for c in codons]


def snv_effects(tx: DataFrame, key: str = "transcript_id", carried: list[str] | None = None, changed: bool = False) -> DataFrame:
    """Every substitution of every coding base, worked out once from its codon: the key (and what is
    carried), drawn, cds_ref, cds_alt, effect, aa_off and short. Rows whose base is the reference
    have a null effect; changed: without rows of a null effect. Equal to annotate(), without making a
    mutant protein for each.

    A codon's residues after its twelve substitutions are one look-up a codon. The rows of a null
    effect are left out before anything is worked out: a filter on the effect would be pushed below
    and work out every step of it anew."""
    keep = list(dict.fromkeys([key, *(carried or [])]))
    each = tx.where(F.length("cds") > 0)
    each = each.where("protein is not null") if changed else each
    each = each.select(*dict.fromkeys([*keep, "cds", "protein"]), F.explode(F.sequence(F.lit(0), F.floor((F.length("cds") - 1) / 3).cast("int"))).alias("_i"))
    each = each.withColumn("_old", F.substring(F.col("cds"), 3 * F.col("_i") + 1, F.lit(3)))
    at = [F.position(F.substring(F.col("_old"), i, 1), F.lit("TCAG")) for i in (1, 2, 3)]
    known = (F.length("_old") == 3) & (F.least(*at) > 0)
    number = F.when(known, 16 * at[0] + 4 * at[1] + at[2] - 21)
    each = each.withColumn("_code", number).withColumns({"_to": F.get(F.array(*map(F.lit, _substituted())), F.col("_code")), "_a": F.coalesce(F.substring(F.lit(GENETIC_CODE), F.col("_code") + 1, F.lit(1)), F.lit("X"))})
    each = each.withColumns({"_n": F.length("protein"), "_wild": F.concat(F.lit("p."), F.substring(F.col("protein"), F.col("_i") + 1, F.lit(1)), (F.col("_i") + 1).cast("string"))})
    each = each.withColumn("_v", F.explode(F.sequence(F.lit(0), 4 * F.length("_old") - 1)))
    at, base = F.shiftright("_v", 2), F.col("_v").bitwiseAND(3)
    each = each.withColumns({"drawn": 3 * F.col("_i") + at, "cds_ref": F.substring(F.col("_old"), at + 1, F.lit(1)), "cds_alt": F.substring(F.lit("ACGT"), base + 1, F.lit(1))})
    each = each.where("cds_ref <> cds_alt") if changed else each
    new = F.concat(F.substring(F.col("_old"), F.lit(1), at), F.col("cds_alt"), F.substring(F.col("_old"), at + 2, F.lit(3)))
    each = each.withColumn("_b", F.when(F.col("_to").isNotNull(), F.substring(F.col("_to"), F.col("_v") + 1, F.lit(1))).otherwise(_residue(new)))
    effect = (
        F.when((F.col("cds_ref") == F.col("cds_alt")) | F.col("protein").isNull(), F.lit(None).cast("string"))
        .when((F.col("_i") == 0) & new.isin(*STARTS), "AlternateStartCodon")
        .when(F.col("_i") == 0, "StartLoss")
        .when((F.col("_i") > F.col("_n")) | (F.col("_a") == F.col("_b")), "Silent")
        .when(F.col("_i") == F.col("_n"), "StopLoss")
        .when(F.col("_b") == "*", "PrematureStop")
        .otherwise("Substitution")
    )
    each = each.withColumn("effect", effect).withColumn("aa_off", F.when(F.col("effect").isNotNull() & (F.col("effect") != "StartLoss"), F.col("_i")))
    return each.withColumn("short", F.concat("_wild", "_b")).select(*keep, "drawn", "cds_ref", "cds_alt", "effect", "aa_off", "short")
