"""The plans that the operators rely on."""

import contextlib
import io

import pytest

from telospark.plans import queries as core


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("name", ["interval_overlap_any", "interval_before_end", "overlap_count", "membership_filter", "ddg_mean_distinct"])
def test_range_joins_are_hash_joins(spark, tiny, name):
    p = plan(core.QUERIES[name](spark, tiny))
    assert "HashJoin" in p or "SortMergeJoin" in p
    assert "NestedLoop" not in p and "Cartesian" not in p


def test_scans_read_only_what_they_need(spark, tiny):
    p = plan(core.QUERIES["interval_overlap_any"](spark, tiny))
    read = [line for line in p.splitlines() if "ReadSchema" in line]
    assert read and not any("l_extendedprice" in line or "p_name" in line for line in read)
    p = plan(core.QUERIES["membership_filter"](spark, tiny))
    assert "GreaterThan(p_size,40)" in p


@pytest.mark.parametrize("name", ["rev_comp", "chasm_context", "motif_matches", "residue_bag", "class_label", "terminal_filter"])
def test_row_functions_neither_shuffle_nor_leave_the_jvm(spark, tiny, name):
    p = plan(core.QUERIES[name](spark, tiny))
    assert "Exchange" not in p and "Python" not in p and "Arrow" not in p


def test_bh_windows_see_distinct_values(spark, tiny):
    p = plan(core.QUERIES["bh_fdr"](spark, tiny))
    assert p.index("Window") > 0 and "Python" not in p


def test_checkpoints_hold_no_sequences_and_no_texts(spark, tiny, monkeypatch):
    """What the permutation tests and the trimmed curve write down between their steps is narrow."""
    from telospark.functions import stats
    from telospark.operators import filters, motifs, permutation
    from telospark.plans import analysis
    from telospark.sources import scratch

    held, real = [], scratch.cut

    def watched(df):
        held.append(df.columns)
        return real(df)

    for module in (stats, filters, motifs, permutation, analysis):
        monkeypatch.setattr(module, "cut", watched)
    tx = core.transcripts(spark, tiny).limit(12)
    muts = core.mutations(spark, tiny).join(tx.select("transcript_id"), "transcript_id")
    spans = tx.select(tx.gene.alias("key")).distinct().selectExpr("key", "5 as start", "12 as end")
    analysis.run("degrons", muts, tx, 30, spans=spans)
    core.QUERIES["trimmed_auc_curve"](spark, tiny).collect()
    assert len(held) > 8
    assert not {c for columns in held for c in columns} & {"text", "cds", "utr3", "protein", "mut_protein", "frames", "stops"}


def test_annotation_stands_once_in_a_plan(spark, tiny):
    """The filter on the effect doesn't work the effect out a second time."""
    from telospark.plans import analysis

    good, _ = analysis.annotated(core.mutations(spark, tiny), core.transcripts(spark, tiny))
    text = good.select("transcript_id", "effect")._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("PrematureStop") == 1


def test_substitutions_are_worked_out_once(spark, tiny):
    """No filter stands below them that works their codons out anew."""
    text = core.QUERIES["snv_effects"](spark, tiny)._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in text.split("\n") if "Filter " in line]
    assert filters and not any("TCAG" in line or "StartLoss" in line for line in filters)


def test_scored_variants_are_annotated_once(spark, tiny):
    for name in ("score_mutations", "score_mutations_raw"):
        text = core.QUERIES[name](spark, tiny)._jdf.queryExecution().optimizedPlan().toString()
        made = [line for line in text.split("\n") if "Generate " in line and line.rstrip().endswith("]") and "[_v#" in line[-20:]]
        assert len(made) == 1 and text.count("ArrowEvalPython") == 1
