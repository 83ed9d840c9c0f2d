"""Catalogue queries on random conversations that hit every rule, against the same SQL."""

import random

import duckdb
import pytest
from check_catalog import difference

from turnloom import fixed
from turnloom.plans.catalog import QUERIES

NAMES = (
    "pairs_build", "pairs_build_scenes", "drop_reasons", "turn_merge", "group_split", "split_summary",
    "message_counts", "prompt_completion", "token_checks", "loss_mask", "shape_errors", "error_report",
    "chat_errors", "dialogue_context", "length_profile", "mean_words", "scene_counter", "dialogue_totals",
)
WORDS = ("one", "two", "Three", "four.", "five,", "six")


def text_of(rng):
    if rng.random() < 0.15:
        return "Exactly  the same long reply. " * 14
    count = rng.choice((3, 15, 25, 59, 60, 61, 90, 159, 160, 161))
    words = [rng.choice(WORDS) for _ in range(count)]
    if rng.random() < 0.15:
        words[rng.randrange(count)] = rng.choice(fixed.POINTING_PHRASES)
    return rng.choice(("", " ")) + rng.choice((" ", "  ", "\n", " \t ")).join(words)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(1)
    rows = [
        (conv, turn, rng.choice(("user", "assistant", "assistant", "Assistant", "system")), text_of(rng))
        for conv in range(120) for turn in range(rng.randrange(1, 14))
    ]
    rng.shuffle(rows)
    folder = tmp_path_factory.mktemp("random")
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    frame.repartition(5).write.parquet(f"{folder}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet/*.parquet'")
    reasons = dict(con.execute("SELECT role, count(*) FROM conversations GROUP BY role").fetchall())
    assert len(reasons) == 4
    return con, str(folder)


@pytest.mark.parametrize("name", NAMES)
def test_random_dialogues(spark, tables, name):
    con, folder = tables
    assert difference(spark, con, folder, name) is None


def test_every_reason_occurs(spark, tables):
    found = {r["reason"] for r in QUERIES["drop_reasons"](spark, tables[1]).collect()}
    assert found == {
        "kept", fixed.TOO_SHORT, fixed.TOO_LONG, fixed.NEEDS_VISUAL, fixed.NO_CONTEXT, fixed.PROMPT_TOO_SHORT,
        fixed.DUPLICATE, "prev_is_assistant"}
