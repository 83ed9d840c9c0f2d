import pytest
from pyspark.sql import functions as F

from turnloom import schemas
from turnloom.operators import profile, validate


def chats(spark, rows):
    return spark.createDataFrame(
        [(k, None if m is None else [{"role": r, "content": c} for r, c in m]) for k, m in rows],
        "k string, messages array<struct<role:string,content:string>>")


FIXTURE = [
    ("a", [("user", "x")]), ("b", [("user", "x"), ("assistant", "y")]),
    ("c", [("user", "x"), ("assistant", "y"), ("user", "z")]), ("d", [("user", "x"), ("assistant", " \t ")]),
    ("e", [("user", "Penny: hello"), ("assistant", "y")]), ("f", [("user", "Magnets: hello"), ("assistant", "y")]),
    ("g", [("user", "Mrs. Cooper: hi"), ("assistant", "y")]),
    ("h", [(r, "x") for r in ("user", "assistant", "system", "user", "assistant")]), ("i", None),
    ("j", [("user", None), ("assistant", "y")]), ("k", [(None, "x"), ("assistant", "y")]),
]
WANTED = {
    ("a", -1, validate.TOO_FEW), ("c", -1, validate.LAST_ROLE), ("d", 1, validate.EMPTY),
    ("e", 0, validate.LEAK), ("h", 2, validate.ORDER), ("h", 3, validate.ORDER), ("h", 4, validate.ORDER),
    ("i", -1, validate.TOO_FEW), ("j", 0, validate.EMPTY), ("k", 0, validate.ORDER),
}


def keyed(rows):
    return {(r["k"], r["position"], r["rule"]) for r in rows}


def test_row_rules(spark):
    errors = validate.row_errors(chats(spark, FIXTURE), ["k"]).collect()
    assert keyed(errors) == WANTED
    details = {(r["k"], r["position"]): r["detail"] for r in errors}
    assert details["a", -1] == "only 1 messages" and details["i", -1] == "only 0 messages"
    assert details["c", -1] == "ends with user, expected assistant"
    assert details["h", 2] == "message 2 has role system, expected user"
    assert details["k", 0] == "message 0 has role None, expected user"


def test_row_rules_do_not_shuffle(spark):
    plan = validate.row_errors(chats(spark, FIXTURE), ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_turn_rules_agree_with_row_rules(spark):
    turns = [(k, i, r, c) for k, m in FIXTURE if m for i, (r, c) in enumerate(m)]
    frame = spark.createDataFrame(turns, "k string, turn int, role string, text string")
    assert keyed(validate.turn_errors(frame, "k").collect()) == {e for e in WANTED if e[0] != "i"}


def test_report_shows_the_first_errors_and_counts_the_rest(spark):
    errors = validate.row_errors(chats(spark, FIXTURE), ["k"])
    first, count = validate.error_report(errors, ["k", "position"], shown=4)
    assert [r["k"] for r in first.collect()] == ["a", "c", "d", "e"]
    assert count.first().asDict() == {"errors": 10, "not_shown": 6}


def test_isolation(spark):
    rows = spark.createDataFrame([
        ("e1", "yes", "train"), ("e2", "no", "train"), ("e2", "YES", "heldout"), ("e3", "Yes", "heldout"),
        ("e3", "other", "heldout"),
    ], "episode string, target string, split string")
    report = validate.isolation_report(rows)
    assert {r["check"]: r["rows"] for r in report.collect()} == {
        "train_episodes": 2, "heldout_episodes": 2, "shared_episodes": 1, "leaked_targets": 2}
    lines = validate.isolation_errors(report, validate.shared_episodes(rows).limit(3)).collect()
    assert {r["detail"] for r in lines} == {
        "1 episode(s) in BOTH splits: e2", "2 held-out target(s) appear verbatim in train"}


def test_phrases_count_once_per_reply(spark):
    rows = spark.createDataFrame([("bazinga my spot Bazinga",), ("nothing",)], "t string")
    hits = {r["phrase"]: r["rows"] for r in profile.phrase_hits(rows, F.col("t")).collect()}
    assert hits == {"bazinga": 1, "my spot": 1}
    summary = profile.phrase_summary(rows, F.col("t")).first()
    assert (summary["hits"], summary["rows_with_hit"], summary["rows"], summary["percent"]) == (2, 1, 2, 50.0)


def test_profile_uses_the_truncated_index(spark):
    rows = spark.createDataFrame([("s", v) for v in range(1, 9)] + [("t", 4)] * 1000, "split string, v int")
    got = {r["split"]: tuple(r)[1:] for r in profile.truncated_index_profile(rows, ["split"], F.col("v")).collect()}
    assert got == {"s": (8, 1, 3, 5, 7, 8), "t": (1000, 4, 4, 4, 4, 4)}


def test_trainable_rows_fail_on_the_first_problem(spark):
    good = chats(spark, [("b", FIXTURE[1][1])])
    assert validate.require_trainable(good, F.col("k")).count() == 1
    for name in ("a", "c", "d", "h", "i", "j"):
        bad = chats(spark, [r for r in FIXTURE if r[0] == name])
        with pytest.raises(Exception, match=f"row {name} is no chat"):
            validate.require_trainable(bad, F.col("k")).collect()


def test_evaluable_rows_need_an_episode(spark):
    rows = chats(spark, [("b", FIXTURE[1][1])])
    named = rows.withColumn("meta", F.struct(F.lit("pilot").alias("episode")))
    assert validate.require_evaluable(named, F.col("k")).count() == 1
    with pytest.raises(Exception, match="cannot be evaluated"):
        validate.require_evaluable(rows.withColumn("meta", F.struct(F.lit("").alias("episode"))), F.col("k")).collect()


def test_prompt_and_completion(spark):
    row = validate.prompt_completion(chats(spark, [FIXTURE[1]]), ["k"]).first()
    assert [m["content"] for m in row["prompt"]] == ["x"] and [m["content"] for m in row["completion"]] == ["y"]


@pytest.mark.parametrize("prompt, full, error", [
    ([1, 2], [1, 2, 3, 9], None), ([1, 2], [2, 1, 3, 9], "prompt_not_a_prefix"),
    ([1, 2], [1, 2, 3, 4, 5, 9], "too_many_tokens"), ([1, 2], [1, 2], "no_end_token"),
    ([1, 9], [1, 9, 3], "no_end_token"),
])
def test_token_rules(spark, prompt, full, error):
    frame = spark.createDataFrame([(prompt, full)], "p array<int>, f array<int>")
    got = frame.select(validate.token_error(F.col("p"), F.col("f"), 9, 5).alias("e")).first()["e"]
    assert got == error


@pytest.mark.parametrize("labels, right", [
    ([-100, -100, 3, 4], True), ([-100, 2, 3, 4], False), ([-100, -100, -100, 4], False), ([-100], False),
])
def test_loss_mask(spark, labels, right):
    frame = spark.createDataFrame([(labels, [1, 2, 3, 4])], "l array<int>, f array<int>")
    checked = frame.select(
        validate.mask_is_right(F.col("l"), F.col("f"), F.lit(2)).alias("ok"),
        validate.masked_labels(F.col("f"), F.lit(2)).alias("made")).first()
    assert checked["ok"] is right and checked["made"] == [-100, -100, 3, 4]


def test_empty_frames_are_refused(spark):
    with pytest.raises(ValueError, match="train split is empty"):
        validate.require_rows(spark.createDataFrame([], schemas.PAIR), "train split is empty")
