"""Physical plans: what is read, what is shuffled, what is joined how."""

import re

import pytest
from pyspark.sql import functions as F

from turnloom import schemas
from turnloom.operators import pairs, split
from turnloom.plans import bindings
from turnloom.plans.catalog import QUERIES


def plan_of(frame, mode="formatted"):
    return frame.sparkSession._jvm.PythonSQLUtils.explainString(frame._jdf.queryExecution(), mode)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_query_pairs_every_row_with_every_other(spark, sf_dir, name):
    plan = plan_of(QUERIES[name](spark, sf_dir), "simple")
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def exchanges(plan):
    """Output columns of every shuffle in a formatted plan."""
    found = re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[([^\n]*)\]", plan)
    return [{re.sub(r"#\d+L?$", "", c) for c in columns.split(", ")} for columns in found]


def test_drop_reasons_shuffle_no_text(spark, sf_dir):
    shuffled = exchanges(plan_of(QUERIES["drop_reasons"](spark, sf_dir)))
    assert shuffled and not any({"text", "context_text"} & columns for columns in shuffled)


def test_pairs_shuffle_lines_once_before_deduplication(spark, sf_dir):
    rules = bindings.PAIR_RULES
    lines = bindings.conversation_lines(spark, sf_dir)
    built = pairs.build_pairs(pairs.candidates(pairs.attach_context(lines, rules), rules))
    assert len(exchanges(plan_of(built))) == 1
    assert len(exchanges(plan_of(pairs.drop_duplicates(built)))) == 2


def test_nested_episodes_need_no_shuffle(spark):
    episodes = spark.createDataFrame([], "episode_id long, title string, url string, lines array<struct<speaker:string,text:string,scene:int>>")
    rules = pairs.PairRules()
    built = pairs.build_pairs(pairs.candidates(pairs.attach_context_nested(episodes, rules), rules))
    assert exchanges(plan_of(built)) == []
    assert built.columns == pairs.build_pairs(
        pairs.candidates(pairs.attach_context(pairs.explode_lines(episodes), rules), rules)).columns


def test_split_does_not_move_pairs(spark):
    rows = spark.createDataFrame([("a", 1)], "episode string, target_words int")
    main = plan_of(split.split_pairs(rows), "simple").split("Subquery")[0]
    assert "Join" not in main and "Exchange" not in main


def test_scans_read_only_what_is_needed(spark, sf_dir):
    schema = lambda name: re.findall(r"ReadSchema: struct<([^>]*)>", plan_of(QUERIES[name](spark, sf_dir)))
    assert schema("text_clean_wc") == ["doc_id:bigint,text:string"]
    assert schema("dialogue_totals") == ["conv_id:bigint,role:string"]
    assert set(schema("resume_remaining")) == {"doc_id:bigint"}
    assert schema("spot_check_sample") == ["doc_id:bigint,source:string"]


def test_filters_reach_the_scan(spark, sf_dir):
    lines = bindings.table(spark, sf_dir, "conversations").filter(F.col("role") == "assistant")
    assert "PushedFilters: [IsNotNull(role), EqualTo(role,assistant)]" in plan_of(lines)


def test_hot_replies_are_limited_before_the_shuffle(spark, sf_dir):
    for name in ("dedupe_first", "url_canonical_first", "pairs_build"):
        plan = plan_of(QUERIES[name](spark, sf_dir), "simple")
        assert re.search(r"WindowGroupLimit .*Partial", plan)


def test_schemas_match_what_is_built(spark, sf_dir):
    documents = pairs.pair_documents(bindings.conversation_pairs(spark, sf_dir)).select("messages", "meta")
    shape = lambda t: re.sub(r"[^a-z_:<>,]", "", t.simpleString())
    assert shape(documents.schema) == shape(schemas.PAIR)


def test_pages_number_their_lines_without_a_shuffle(spark, sf_dir):
    assert exchanges(plan_of(QUERIES["html_dialogue"](spark, sf_dir))) == []


def test_every_outcome_of_the_pair_rules_occurs(spark):
    found = {r["reason"]: r["rows"] for r in QUERIES["drop_reasons_all"](spark, "/root/testdata/sf0.01").collect()}
    assert found.keys() == {
        "kept", "duplicate", "target_too_short", "target_too_long", "target_junk", "target_needs_visual", "no_context",
        "prev_is_assistant", "prompt_too_short"} and all(found.values())
