"""Named queries against their SQL on the smallest tables.

Every area is checked by default; PATCHSIEVE_ALL=1 runs every query.
"""

import os

import pytest

import __spark_entry__ as entry
from compare import compare, duck
from patchsieve.operators import metrics
from patchsieve.session import cut_lineage

FOLDER = "/root/testdata/sf0.001"
DEFAULT = """merge_evidence investigation_view evidence_flags explanation evidence_gaps evidence_projection decision_summary commit_features
commit_vector file_vector flagship risk_output blend_scores top_cut_capture candidate_ranking repo_precision global_classification language
file_header line_coordinates range_hits commit_features_from_diffs history_features recent_history cheap_evidence historical_evidence
resolve_refs revert_map merge_labels line_overlap_attribution ambiguous_evidence global_chrono_split path_overlap_category file_identity
reference_chain message_mentions content_restoration region_overlap same_function attribution_rollups bootstrap_ci mann_whitney concentration
coverage_numeric label_composition supervision_populations reconcile evidence_pairs observation_time write_read_examples fingerprint
population_eval feature_summary attribution_report_files attribution_report_changes attribution_report_nested population_report pairwise_ranker_fit
validate_contract_full validate_experimental assemble_features_full diversity_breakdown top_cut_capture_by_split train_report_counts
pu_recommendation_computed content_correspondence_shared paired_bootstrap""".split()
NAMES = sorted(entry.queries()) if os.environ.get("PATCHSIEVE_ALL") else DEFAULT


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    problem = compare(spark, con, name, entry.queries()[name], entry.oracle_sql().get(name), FOLDER)
    assert problem is None


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 1


def test_scans_read_only_what_is_used(spark, capsys, monkeypatch):
    """The flagship writes its ranking once: what is written reads the columns in use, and nothing else is read."""
    written = []

    def kept(df):
        written.append(df)
        return cut_lineage(df)

    monkeypatch.setattr(metrics, "reused", kept)
    entry.queries()["flagship"](spark, FOLDER).explain("formatted")
    assert "ReadSchema" not in capsys.readouterr().out and len(written) == 1
    written[0].explain("formatted")
    schemas = [x for x in capsys.readouterr().out.splitlines() if "ReadSchema" in x]
    assert schemas and not any(c in x for x in schemas for c in ("l_shipdate", "l_extendedprice"))
    entry.queries()["history_features"](spark, FOLDER).explain("formatted")
    assert "CartesianProduct" not in capsys.readouterr().out


@pytest.mark.parametrize("name", ["merge_evidence", "investigation_view", "evidence_projection", "decision_summary"])
def test_no_evidence_is_shuffled(spark, capsys, name):
    """Arrays of entries are made after the last join of the files; an exchange carries plain values."""
    entry.queries()[name](spark, FOLDER).explain("formatted")
    sections = capsys.readouterr().out.split("\n\n")
    exchanged = [x.split("Input ", 1)[1].splitlines()[0] for x in sections if ") Exchange" in x and "Input " in x]
    assert exchanged and not any(c in x for x in exchanged for c in ("evidence#", "history#", "__cheap#"))


def test_status_pattern_collects_nothing(spark, capsys):
    """A change is one row of marks: links meet two rows, and no set is collected."""
    entry.queries()["status_pattern"](spark, FOLDER).explain("formatted")
    plan = capsys.readouterr().out
    assert "collect_set" not in plan and "Union" not in plan


@pytest.mark.parametrize("name", ["merge_evidence", "investigation_view", "evidence_flags", "evidence_gaps"])
def test_only_what_others_follow_from_is_shuffled(spark, capsys, name):
    """Columns that follow from the plain values of a file are made after its last exchange, and order columns have no copies."""
    entry.queries()[name](spark, FOLDER).explain("formatted")
    sections = capsys.readouterr().out.split("\n\n")
    exchanged = [x.split("Input ", 1)[1].splitlines()[0] for x in sections if ") Exchange" in x and "Input " in x]
    assert exchanged and not any(c in x for x in exchanged for c in ("function_declarations_added#", "indent_sum#", "language_name#", "__o0#"))


def test_texts_are_not_dealt_by_repository(spark, capsys):
    """Positions of changes are found on their ids: no ordered slice holds messages."""
    entry.queries()["active_fixes"](spark, FOLDER).explain("formatted")
    sections = capsys.readouterr().out.split("\n\n")
    exchanged = [x.split("Input ", 1)[1].splitlines()[0] for x in sections if ") Exchange" in x and "Input " in x]
    assert exchanged and not any(c in x for x in exchanged for c in ("text#", "message#"))


def test_examples_read_the_lines_once(spark, capsys):
    entry.queries()["audit_sample"](spark, FOLDER).explain("formatted")
    plan = capsys.readouterr().out.split("== Initial Plan ==")[-1].split("\n\n")[0]
    assert plan.count("SortMergeJoin") + plan.count("BroadcastHashJoin") <= 2


def test_a_window_of_touches_is_sorted_once(spark, capsys):
    """The last touches are looked back for in the order of the pass; no set of rows seen, no second sort by a count."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        entry.queries()["recent_history"](spark, FOLDER).explain("formatted")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    plan = capsys.readouterr().out
    assert "lag(" in plan and "__k#" not in plan and "keys=[repo#" not in plan
