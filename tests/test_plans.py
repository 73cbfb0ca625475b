"""What the plans of the operators must and must not look like."""

import os
import re

import pytest

import __spark_entry__ as entry
from prepkit.operators import frequency, quality, stats
from prepkit.operators import transform as tr
from prepkit.operators.ordered import fill

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables are not here")


def plan(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_filters_and_columns_reach_the_files(spark):
    text = plan(entry.queries()["t_filter_rows"](spark, SF_DIR))
    assert "EqualTo(o_orderstatus,F)" in text and "GreaterThan(o_totalprice,100000.0)" in text
    pruned = plan(entry.queries()["t_filter_rows"](spark, SF_DIR).select("o_orderkey"))
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string,o_totalprice:double>" in pruned


def test_statistics_read_only_their_columns(spark):
    df = entry.table(spark, SF_DIR, "lineitem")
    assert "ReadSchema: struct<l_quantity:double>" in plan(stats.column_stats(df, ["moments"], ["l_quantity"]))


def test_top_values_are_cut_before_the_shuffle(spark):
    df = entry.table(spark, SF_DIR, "documents")
    assert "WindowGroupLimit" in plan(frequency.top_values(df, k=5))
    counted = plan(frequency.text_counts(df))
    assert not re.search(r"hashpartitioning\([^)]*value#", counted)
    assert plan(quality.outlier_samples(entry.table(spark, SF_DIR, "events"), ["event_id"])).count(
        "WindowGroupLimit") >= 2


def test_whole_rows_are_grouped_by_digest(spark):
    text = plan(frequency.row_counts(entry.table(spark, SF_DIR, "documents")))
    shuffles = [line for line in text.splitlines() if "hashpartitioning" in line]
    assert shuffles and all(", text#" not in line and "(text#" not in line for line in shuffles)
    assert "sha2(" in text


def test_fitted_statistics_are_constants(spark):
    df = entry.table(spark, SF_DIR, "events")
    text = plan(tr.transform(df, "scale_standard", tr.Params(columns=["value"])))
    assert "Exchange" not in text and "Join" not in text


def test_a_fill_sorts_no_rows_in_one_task(spark):
    df = entry.table(spark, SF_DIR, "events")
    text = plan(fill(df, ["value"], ["event_id"], rows_per_bucket=50))
    assert re.search(r"windowspecdefinition\(__bucket#\d+L?, __key_0#", text)
    # the window without a partition runs over one row per bucket
    assert len(re.findall(r"windowspecdefinition\(__bucket#\d+L? ASC", text)) <= 1
