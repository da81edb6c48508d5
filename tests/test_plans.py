"""Shape of the physical plans, and the registered queries against SQL."""
import math
import os
import re
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from tidekeep.plans.catalog import CATALOG, Tables

FOLDER = "/root/testdata/sf0.001"
TABLES = """region nation customer supplier part orders lineitem events documents embeddings pages
benchmark labels conversations""".split()
needs_data = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the data folder")


def explain(df):
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


@needs_data
@pytest.mark.parametrize("name", [
    "cmp_1_review_queue", "cmp_2_run_case", "tml_1_case_timeline", "agg_10_disproportion",
    "agg_14_overview", "ent_5_extract_entities", "txt_4_detect_language", "ml_1_standardised"])
def test_no_python_in_the_plan(spark, name):
    text = explain(CATALOG[name](Tables(spark, FOLDER)))
    assert "Python" not in text and "CartesianProduct" not in text
    assert "BroadcastNestedLoop" not in text


@needs_data
def test_queue_shuffles_no_text(spark):
    text = explain(CATALOG["cmp_1_review_queue"](Tables(spark, FOLDER)))
    for exchange in re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: (.*)\nArguments: (.*)", text):
        assert not re.search(r"\btext#", exchange[0])
    assert "ReadSchema: struct<c_custkey:bigint,c_nationkey:int,c_acctbal:double>" in text


@needs_data
def test_no_single_task_rank(spark):
    text = explain(CATALOG["srt_1_ranked_queue"](Tables(spark, FOLDER)))
    rows = re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: (.*)\nArguments: SinglePartition", text)
    assert rows and not any("message_id" in r for r in rows)


@needs_data
@pytest.mark.parametrize("name, carried", [
    ("tml_1_case_timeline", ()), ("tml_2_extended_timeline", ()), ("grd_3_invented_amounts", ()),
    ("grd_4_retention_pressure", ()), ("rev_1_review_transition", ()),
    ("drf_3_serve_decision", ("_draft",)), ("cmp_2_run_case", ("_draft",))])
def test_texts_stay_out_of_the_exchanges(spark, name, carried):
    """With no broadcast of data to hide behind; ``_draft`` is null for texts no plan can serve."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "-1")
        text = explain(CATALOG[name](Tables(spark, FOLDER)))
    finally:
        spark.conf.set(key, before)
    moved = re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: (.*)\n", text)
    assert moved
    for columns in moved:
        names = set(re.findall(r"(\w+)#", columns))
        assert not names & ({"candidate", "text", "_clow", "_low", "draft_message", "_draft"}
                            - set(carried)), columns


def test_every_query_has_sql_or_a_reason():
    missing = set(CATALOG) - set(entry.oracle_sql())
    assert missing == {"ml_4_boosted_trees_scores", "ml_7_text_heads", "ml_8_trained_queue",
                       "ml_9_bakeoff", "ml_9_tuning"}
    assert not set(entry.oracle_sql()) - set(entry.queries())


@pytest.mark.parametrize("missing", ["public_tokenizers", "tidekeep.llm", "corpus_pipeline"])
def test_entry_without_the_corpus_operators(missing):
    code = (f"import sys; sys.modules['{missing}'] = None; import __spark_entry__ as e;"
            "names = e.queries(); assert not any(n.startswith('op') or n == 'pipeline'"
            " for n in names); assert set(e.oracle_sql()) <= set(names); print(len(names))")
    run = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True,
                         cwd=os.path.dirname(entry.__file__))
    assert run.returncode == 0 and int(run.stdout) == len(CATALOG), run.stderr


def cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        str(tuple(cell(r[i]) for i in order)) for r in rows)


@needs_data
@pytest.mark.parametrize("name", [
    "cmp_1_review_queue", "tml_2_extended_timeline", "agg_14_overview",
    "spl_1_message_split", "rev_1_review_transition", "clf_4_token_ids", "srt_1_ranked_queue",
    "ml_3_optimality", "agg_18_report_fitted", "ml_8_count_queue", "ml_9_bakeoff_exact",
    "str_1_hot_customers", "str_3_status_over_log", "udf_1_sql_functions", "udf_1_sql_views"])
def test_against_sql(spark, name):
    engine = duckdb.connect()
    for t in TABLES:
        engine.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = entry.queries()[name](spark, FOLDER)
    result = engine.execute(entry.oracle_sql()[name])
    want = table([d[0] for d in result.description], result.fetchall())
    assert table(df.columns, [tuple(r) for r in df.collect()]) == want


@needs_data
def test_flagship(spark):
    assert entry.entry(spark).count() > 0
