"""SQL twins of the analyses that users run: annotation, scores, permutation tests and motif tests.

They follow the definitions and nothing of the library's way: mutant sequences are translated whole,
simulations are drawn one by one, tails are summed term by term.
"""

from __future__ import annotations

#: Simulations of all units; only those without a hundred hits in these go on.
FIRST = 1_000
#: Of the synthetic transcripts: residues, and the third of bases that decay doesn't reach on each strand.
RESIDUES, SAFE = 31, "CASE WHEN minus THEN 90 / 3.0 ELSE 103 / 3.0 END"
SNVS = "('Substitution', 'Silent', 'AlternateStartCodon', 'PrematureStop', 'StartLoss', 'StopLoss')"
INDELS = "('Deletion', 'Insertion', 'FrameShift')"


def protein(cds: str, code: str) -> str:
    return f"split_part(array_to_string([{code}[substr({cds}, 3 * k + 1, 3)] FOR k IN range(0, length({cds}) // 3)], ''), '*', 1)"


def effects(given: str, code: str) -> str:
    """CTEs from `given` (cds, minus, p, a: the base at p replaced by a, or deleted) to `eff`, with
    effect, off (place), size and new (the mutant protein), protein and short."""
    n = RESIDUES
    return (
        f"e1 AS (SELECT *, substr(cds, 1, p) || a || substr(cds, p + 2) || 'GCCTAAGC' AS whole FROM {given}), "
        f"e2 AS (SELECT *, {protein('whole', code)} AS new, {protein('cds', code)} AS protein FROM e1), "
        "e3 AS (SELECT *, CASE WHEN a <> '' THEN p // 3 ELSE coalesce(list_filter(range(0, least(length(protein), length(new)) + 1), lambda k: (protein || '*')[k + 1] <> (new || '*')[k + 1])[1], least(length(protein), length(new)) + 1) END AS off FROM e2), "
        "e4 AS (SELECT *, CASE WHEN left(whole, 3) IN ('CTG', 'TTG') THEN 'AlternateStartCodon' WHEN left(whole, 3) <> 'ATG' THEN 'StartLoss' WHEN new = protein THEN 'Silent' WHEN a = '' THEN 'FrameShift' "
        f"WHEN off < {n} AND length(new) = off THEN 'PrematureStop' WHEN off >= {n} AND length(new) > {n} THEN 'StopLoss' ELSE 'Substitution' END AS effect FROM e3), "
        "eff AS (SELECT *, CASE WHEN effect <> 'StartLoss' THEN off END AS aa_off, CASE WHEN effect <> 'StartLoss' THEN length(new) END AS size, "
        "CASE effect WHEN 'Silent' THEN 'silent' WHEN 'StartLoss' THEN 'p.M1?' WHEN 'AlternateStartCodon' THEN 'p.M1?' WHEN 'FrameShift' THEN 'p.' || (protein || '*')[off + 1] || (off + 1) || 'fs' ELSE 'p.' || (protein || '*')[off + 1] || (off + 1) || (new || '*')[off + 1] END AS short, "
        f"size IS NULL OR size = 0 OR size > {n} - {SAFE} AS escapes FROM e4)"
    )


def variants(tx: str, code: str) -> str:
    """CTEs to `eff`, of the mutations of the queries."""
    place = "a0 + CASE WHEN minus THEN CASE WHEN p < 53 THEN 153 - p WHEN p < 93 THEN 100 - (p - 53) ELSE 60 - (p - 93) END ELSE CASE WHEN p < 40 THEN 1 + p WHEN p < 93 THEN 101 + p - 40 ELSE 154 + p - 93 END END"
    turned = lambda c: f"CASE WHEN minus THEN translate({c}, 'ACGT', 'TGCA') ELSE {c} END"
    return (
        f"m0 AS (SELECT 'T' || doc_id AS tx, 'G' || (doc_id % 40) AS gene, doc_id * 1000 AS a0, cds, doc_id % 2 = 1 AS minus, i, CAST('0x' || substr(md5('m|T' || doc_id || '|' || i), 1, 8) AS BIGINT) % 93 AS p FROM {tx}, range(0, 12) r(i)), "
        "m1 AS (SELECT *, substr(cds, p + 1, 1) AS b, CASE WHEN i >= 10 THEN '' ELSE translate(substr(cds, p + 1, 1), 'ACGT', 'CATG') END AS a FROM m0), "
        f"m2 AS (SELECT *, CAST({place} AS BIGINT) AS start, {turned('b')} AS ref, {turned('a')} AS alt FROM m1), " + effects("m2", code)
    )


def annotated(tx: str, code: str) -> str:
    return f"WITH {variants(tx, code)} SELECT gene, tx AS transcript_id, start, ref, alt, CAST(p AS INTEGER) AS cds_pos, effect, CAST(aa_off AS INTEGER) AS aa_off, short FROM eff"


def network(layers: list, split: int, peptide: str, residues: str) -> str:
    """P(label 1) of a net on the features of a peptide: bag of the rest, residues at `split` end
    places (the last place empty), and the last pair."""
    n = len(residues)
    s, w0 = f"right({peptide}, {split})", layers[0][0]
    bag = lambda x: f"[CAST(length({x}) - length(replace({x}, r, '')) AS DOUBLE) FOR r IN {list(residues)}]"
    rest = f"left({peptide}, greatest(length({peptide}) - {split}, 0))" if split else peptide
    units = []
    for j in range(w0.shape[1]):
        w = [float(v) for v in w0[:, j]]
        terms = [f"list_dot_product({bag(rest)}, {w[:n]})", str(float(layers[0][1][j]))]
        for k in range(1, split):
            at = f"instr('{residues}', CASE WHEN length({s}) > {k} THEN ({s})[length({s}) - {k}] ELSE '-' END)"
            terms.append(f"coalesce({w[n + k * n : n + (k + 1) * n]}[CAST(nullif({at}, 0) AS INTEGER)], 0)")
        if split:
            one, two = (f"instr('{residues}', ({s})[length({s}) - {k}])" for k in (1, 0))
            terms.append(f"CASE WHEN length({s}) >= 2 AND {one} > 0 AND {two} > 0 THEN {w[n + split * n :]}[CAST(({one} - 1) * {n} + {two} AS INTEGER)] ELSE 0 END")
        units.append("greatest(0.0, " + " + ".join(terms) + ")")
    x = f"[{', '.join(units)}]"
    for k, (w, b) in enumerate(layers[1:], 1):
        rows = [f"list_dot_product(h, {[float(v) for v in w[:, j]]}) + {float(b[j])}" for j in range(w.shape[1])]
        if k < len(layers) - 1:
            x = f"list_transform([{x}], lambda h: [{', '.join(f'greatest(0.0, {r})' for r in rows)}])[1]"
        else:
            x = f"list_transform([{x}], lambda h: 1 / (1 + exp(-({rows[0]}))))[1]"
    return x


def wild_types(tx: str, code: str, specific, bag, residues: str) -> str:
    one, two = (network(m.net, m.split, "pep", residues) for m in (specific, bag))
    return f"SELECT tx AS transcript_id, round(a, 6) AS specific, round(b, 6) AS bag, round(a - b, 6) AS potential FROM (SELECT tx, {one} AS a, {two} AS b FROM (SELECT 'T' || doc_id AS tx, right({protein('cds', code)}, 23) AS pep FROM {tx}))"


def scores(tx: str, code: str, specific, bag, residues: str, raw: bool) -> str:
    """Scores of the mutations at the C-terminus."""
    n = RESIDUES
    one, two = network(specific.net, specific.split, "pep", residues), network(bag.net, bag.split, "pep", residues)
    kept = f"(effect IN {SNVS} AND a <> '' AND (effect <> 'PrematureStop' OR escapes)) OR (effect IN {INDELS} AND a = ''{'' if raw else ' AND escapes'})"
    there = f"size > 0 AND (effect IN {INDELS} OR effect = 'PrematureStop' OR (effect IN {SNVS} AND off > {n} - 23))"
    values = "round(m.a - w.a, 6) AS delta_specific_score, round(m.a, 6) AS specific_score" if raw else "round((m.a - m.b) - (w.a - w.b), 6) AS delta_degron_potential"
    return (
        f"WITH {variants(tx, code)}, v AS (SELECT *, right(new, 23) AS mine, right(protein, 23) AS wild FROM eff WHERE ({kept}) AND {there}), "
        f"s AS MATERIALIZED (SELECT pep, {one} AS a, {'0' if raw else two} AS b FROM (SELECT DISTINCT unnest([mine, wild]) AS pep FROM v)) "
        f"SELECT gene AS hugo_symbol, tx AS transcript_id, '1' AS chromosome, start AS start_position, start AS end_position, short AS hgvsp_short, {values} FROM v JOIN s m ON m.pep = mine JOIN s w ON w.pep = wild"
    )


def permutation(tx: str, code: str, value: str, column: str, only: str, indels: bool, side: str, empty_hits: bool, simulations: int) -> str:
    """A test, simulated one draw after the other; units that have their hundred hits after FIRST
    simulations need no more. value: what an effect at `off` counts; only: the
    transcripts that are tested."""
    kept_sub, kept_indel = "(effect <> 'PrematureStop' OR escapes)", "escapes"
    sub = f"effect IN {SNVS} AND a <> ''"
    indel = f"effect IN {INDELS} AND a = ''"
    tri = "substr(cds, greatest(p, 1), 1) || substr(cds, p + 1, 1) || substr(cds, least(p + 2, length(cds)), 1)"
    chosen = f"({sub})" + (f" OR ({indel})" if indels else "")
    number = lambda t: f"CAST('0x' || substr(md5('101|' || c.tx || '|' || {t} || '|' || sim || '|' || slot), 1, 8) AS BIGINT)"
    kinds = "['A','C','G','T','']" if indels else "['A','C','G','T']"

    def phase(n: int, units: str, start: int, end: int) -> str:
        """hits<n>: the simulations of some units that are hits."""
        deletions = f" UNION ALL SELECT c.tx, sim, c.slot, CAST({number(chr(39) + 'None' + chr(39))} % 96 AS INTEGER), '' FROM slots c JOIN {units} USING (tx), range({start}, {end}) s(sim) WHERE c.a = '' AND draws_indel" if indels else ""
        return (
            f"drawn{n} AS (SELECT c.tx, sim, c.slot, CAST(places[1 + {number('c.tri')} % len(places)] AS INTEGER) AS p, c.a FROM slots c JOIN {units} USING (tx) JOIN spots ON spots.tx = c.tx AND spots.tri = c.tri, range({start}, {end}) s(sim) WHERE c.a <> '' AND draws_sub{deletions}), "
            f"sums{n} AS (SELECT tx, sim, sum(v) FILTER (keep) AS v, count(*) FILTER (keep) AS kept FROM drawn{n} JOIN told USING (tx, p, a) GROUP BY tx, sim), "
            f"hits{n} AS MATERIALIZED (SELECT tx, sim FROM {units} CROSS JOIN range({start}, {end}) s(sim) LEFT JOIN sums{n} USING (tx, sim) WHERE {hit}), "
        )

    hit = f"coalesce(v, 0) {side} seen" + (" OR coalesce(kept, 0) = 0" if empty_hits else "")
    return (
        f"WITH {variants(tx, code)}, obs AS MATERIALIZED (SELECT *, {value} AS v, CASE WHEN a <> '' THEN {kept_sub} ELSE {kept_indel} END AS keep FROM eff WHERE {only}), "
        "info AS (SELECT tx, any_value(gene) AS gene, count(*) AS total, avg(aa_off / 32.0) AS position FROM obs GROUP BY tx), "
        f"unit AS (SELECT tx, bool_or(a <> '') AS subs, bool_or(a = '' AND keep) AS draws_indel, bool_or(a <> '' AND keep) AS draws_sub, coalesce(sum(v) FILTER (keep), 0) AS seen FROM obs WHERE {chosen} GROUP BY tx), "
        f"busy AS MATERIALIZED (SELECT tx, seen, {'draws_sub' if indels else 'true AS draws_sub'}, draws_indel FROM unit WHERE (subs OR draws_indel) AND seen > 0), "
        f"slots AS MATERIALIZED (SELECT tx, a, {tri} AS tri, row_number() OVER (PARTITION BY tx, a = '' ORDER BY {tri}, start, ref, alt, p) - 1 AS slot FROM obs WHERE {chosen}), "
        f"spots AS MATERIALIZED (SELECT tx, tri, list(p ORDER BY p) AS places FROM (SELECT 'T' || doc_id AS tx, p, {tri} AS tri FROM {tx}, range(0, 96) r(p)) GROUP BY tx, tri), "
        f"g AS (SELECT 'T' || doc_id AS tx, cds, doc_id % 2 = 1 AS minus, CAST(p AS INTEGER) AS p, a FROM {tx}, range(0, 96) r(p), (SELECT unnest({kinds}) AS a) WHERE substr(cds, p + 1, 1) <> a AND 'T' || doc_id IN (SELECT tx FROM busy)), "
        + effects("g", code).replace("e1 AS", "f1 AS").replace("e2 AS", "f2 AS").replace("e3 AS", "f3 AS").replace("e4 AS", "f4 AS").replace("FROM e1", "FROM f1").replace("FROM e2", "FROM f2").replace("FROM e3", "FROM f3").replace("FROM e4", "FROM f4").replace("eff AS", "all_eff AS")
        + f", told AS MATERIALIZED (SELECT tx, p, a, {value} AS v, CASE WHEN a <> '' THEN {kept_sub} ELSE {kept_indel} END AS keep FROM all_eff), "
        + phase(1, "busy", 0, FIRST)
        + "later AS MATERIALIZED (SELECT * FROM busy WHERE tx NOT IN (SELECT tx FROM hits1 GROUP BY tx HAVING count(*) >= 100)), "
        + phase(2, "later", FIRST, simulations)
        + "hits AS (SELECT tx, list(sim ORDER BY sim) FILTER (sim IS NOT NULL) AS h FROM busy LEFT JOIN (SELECT * FROM hits1 UNION ALL SELECT * FROM hits2) USING (tx) GROUP BY tx), "
        f"r AS (SELECT gene, seen, CASE WHEN h.tx IS NULL THEN 1.0 WHEN len(h) >= 100 THEN 100.0 / (h[100] + 1) ELSE coalesce(len(h), 0) / {simulations}.0 END AS pvalue, total, position FROM unit JOIN info USING (tx) LEFT JOIN hits h USING (tx) WHERE subs OR draws_indel), "
        f"q AS (SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY pvalue) AS k FROM r) "
        f"SELECT gene, CAST(seen AS DOUBLE) AS {column}, round(pvalue, 9) AS pvalue, total AS total_muts, round(position, 9) AS average_position, round(least(1.0, min(pvalue * n / k) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 9) AS qvalue FROM q"
    )


def motif_tests(counts: str, key: str, hits: str, trials: str, share: str, odds: str, factor: str) -> str:
    """Exact tests of counts (a query with top_ct): tails term by term, odds, Bonferroni and BH; null
    where they aren't finite."""
    term = f"exp(lgamma(t + 1) - lgamma(i + 1) - lgamma(t - i + 1) + i * ln(s) + (t - i) * ln(1 - s))"
    tail = f"CASE WHEN s IS NULL THEN NULL WHEN h <= 0 THEN 1.0 WHEN s <= 0 THEN 0.0 ELSE least(1.0, list_sum([{term} FOR i IN range(CAST(h AS BIGINT), CAST(t AS BIGINT) + 1)])) END"
    return (
        f"WITH c AS ({counts}), x AS (SELECT *, CAST({hits} AS DOUBLE) AS h, CAST({trials} AS DOUBLE) AS t, CAST({share} AS DOUBLE) AS s, {odds} AS o FROM c), "
        f"y AS (SELECT *, {tail} AS pvalue FROM x), "
        "z AS (SELECT *, count(*) OVER () AS tests, row_number() OVER (ORDER BY pvalue NULLS LAST) AS k FROM y) "
        f"SELECT {key}, round(pvalue, 6) AS pvalue, round(CASE WHEN o > 0 AND isfinite(o) THEN log2(o) END, 6) AS log_or, round({factor}, 2) AS adjusted_pvalue, "
        "round(CASE WHEN pvalue IS NOT NULL THEN least(1.0, min(pvalue * tests / k) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) END, 6) AS qvalue FROM z"
    )
