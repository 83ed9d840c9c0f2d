import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from turnloom import schemas
from turnloom.operators import ordered, pairs

RULES = pairs.PairRules(
    target="alpha", context_turns=3, min_target_words=3, min_prompt_words=2, max_target_words=6)

SCRIPT = [
    (0, "Alpha", "one two three four"), (0, "Beta", "hey there friend"), (0, "Alpha", "yes  I can"),
    (0, "Alpha", "and one more thing"), (1, "Alpha", "opening line goes here"), (1, "Gamma", "ok"),
    (1, "Alpha", "short one"), (1, "Gamma", "go"), (1, "Alpha", "a b c d e f g"), (1, "Beta", "look"),
    (1, "Alpha", "put these away now"), (1, "Beta", "x"), (1, "Alpha", "fine by me then"),
    (2, "Beta", "hi"), (2, "Alpha", "reply to single word"), (2, "Beta", "well then"),
    (2, "Alpha", "YES i can"), (2, "Past Alpha", "not the target speaker"), (2, "Beta", "so what"),
    (2, "alpha", "lowercase speaker counts too"),
]
WANTED = {
    2: [("user", "hey there friend"), ("assistant", "yes I can")],
    12: [("user", "look"), ("assistant", "put these away now"), ("user", "x"), ("assistant", "fine by me then")],
    19: [("user", "not the target speaker so what"), ("assistant", "lowercase speaker counts too")],
}
REASONS = {
    "kept": 3, "no_context": 2, "prev_is_alpha": 1, "target_too_short": 1, "target_too_long": 1,
    "target_needs_visual": 1, "prompt_too_short": 1, "duplicate": 1,
}


def script_lines(spark, shuffled=False):
    rows = [(1, "pilot", i, who, said, scene) for i, (scene, who, said) in enumerate(SCRIPT)]
    if shuffled:
        random.Random(3).shuffle(rows)
    return spark.createDataFrame(rows, "episode_id long, title string, line int, speaker string, text string, scene int")


def found(frame):
    documents = pairs.pair_documents(frame).collect()
    return {r["line"]: [(m["role"], m["content"]) for m in r["messages"]] for r in documents}


def test_fixture_pairs_and_reasons(spark):
    judged = pairs.candidates(pairs.attach_context(script_lines(spark), RULES), RULES)
    assert {r["reason"]: r["rows"] for r in pairs.drop_reasons(judged).collect()} == REASONS
    kept = pairs.drop_duplicates(pairs.build_pairs(judged))
    assert found(kept) == WANTED
    meta = {r["line"]: r["meta"] for r in pairs.pair_documents(kept).collect()}
    assert (meta[12]["episode"], meta[12]["scene"], meta[12]["target_words"]) == ("pilot", 1, 4)


def test_row_order_and_partitioning_do_not_matter(spark):
    shuffled = script_lines(spark, shuffled=True).repartition(7, "text")
    assert found(pairs.pairs_from_lines(shuffled, RULES)) == WANTED


def test_nested_episodes_agree_with_lines(spark):
    lines = [{"speaker": w, "text": t, "scene": s} for s, w, t in SCRIPT]
    episodes = spark.createDataFrame(
        [(1, "pilot", "u", lines)], "episode_id long, title string, url string, lines " + schemas.EPISODE["lines"].dataType.simpleString())
    assert found(pairs.pairs_from_episodes(episodes, RULES)) == WANTED
    assert found(pairs.pairs_from_lines(pairs.explode_lines(episodes), RULES)) == WANTED


def test_no_context_turns_drops_every_long_enough_candidate(spark):
    rules = pairs.PairRules(target="alpha", context_turns=0, min_target_words=3, max_target_words=6)
    judged = pairs.candidates(pairs.attach_context(script_lines(spark), rules), rules)
    reasons = {r["reason"]: r["rows"] for r in pairs.drop_reasons(judged).collect()}
    past_the_reply_rules = sum(REASONS[r] for r in ("kept", "no_context", "prev_is_alpha", "prompt_too_short", "duplicate"))
    assert reasons["no_context"] == past_the_reply_rules == 8 and "kept" not in reasons


def test_filler_replies_are_reached_only_below_their_length(spark):
    rows = [(1, "t", 0, "Beta", "is this a question", 0), (1, "t", 1, "Alpha", "Thank you!", 0)]
    frame = spark.createDataFrame(rows, "episode_id long, title string, line int, speaker string, text string, scene int")
    for shortest, reason in ((2, "target_junk"), (3, "target_too_short")):
        rules = pairs.PairRules(target="alpha", min_target_words=shortest)
        judged = pairs.candidates(pairs.attach_context(frame, rules), rules)
        assert [r["reason"] for r in judged.collect()] == [reason]


@pytest.mark.parametrize("n, block", [(1, 2), (3, 4), (3, 5), (5, 3), (2, 64)])
def test_look_back_across_blocks_equals_a_plain_window(spark, n, block):
    sizes = {"hot": 97, "cold": 6, "one": 1}
    rows = [(k, i, f"{k}{i}") for k, size in sizes.items() for i in range(size)]
    random.Random(0).shuffle(rows)
    frame = spark.createDataFrame(rows, "k string, i int, v string")
    got = ordered.look_back(frame, ["k"], "i", {"before": F.col("v")}, n, block).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["before"] == [f"{r['k']}{j}" for j in range(max(0, r["i"] - n), r["i"])]


def test_context_stops_at_a_scene_that_returns_later(spark):
    rows = [(1, "t", 0, "Beta", "early words here", 0), (1, "t", 1, "Beta", "other scene words", 1),
            (1, "t", 2, "Alpha", "back in scene zero", 0)]
    frame = spark.createDataFrame(rows, "episode_id long, title string, line int, speaker string, text string, scene int")
    judged = pairs.candidates(pairs.attach_context(frame, RULES), RULES)
    assert [r["reason"] for r in judged.collect()] == ["no_context"]


def test_first_duplicate_in_source_order_wins(spark):
    rows = [(e, l, f"{e}-{l}", "same text" if (e + l) % 3 else f"own {e} {l}") for e in range(30) for l in range(20)]
    random.Random(1).shuffle(rows)
    frame = spark.createDataFrame(rows, "e int, l int, label string, t string").repartition(6)
    got = {r["t"]: r["label"] for r in ordered.first_per_key(frame, F.col("t"), ["e", "l"]).collect()}
    want = {}
    for e, l, label, t in sorted(rows):
        want.setdefault(t, label)
    assert got == want


def test_first_per_key_limits_on_the_map_side(spark):
    frame = spark.range(100).select("id", (F.col("id") % 2).alias("k"))
    plan = ordered.first_per_key(frame, F.col("k"), ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


@pytest.mark.parametrize("block", [2, 7, 1000])
def test_running_total_and_dense_position(spark, block):
    positions = {"hot": list(range(0, 90, 3)), "cold": [5, 6, 40]}
    rows = [(k, p, (p * 7) % 5) for k, ps in positions.items() for p in ps]
    frame = spark.createDataFrame(rows, "k string, p int, v int")
    got = ordered.running_total(frame, ["k"], "p", F.col("v"), "s", block).collect()
    for r in got:
        assert r["s"] == sum(v for k, p, v in rows if k == r["k"] and p <= r["p"])
    dense = ordered.dense_position(frame, ["k"], "p", "d", block).collect()
    assert all(r["d"] == positions[r["k"]].index(r["p"]) for r in dense)
    assert {r["k"] for r in ordered.position_gaps(frame, ["k"], "p").collect()} == {"hot", "cold"}


def test_weighted_positions_with_a_hot_value(spark):
    rng = random.Random(5)
    values = [7] * 500 + [rng.randrange(2000) for _ in range(900)]
    counts = Counter(values)
    frame = spark.createDataFrame(list(counts.items()), "v int, n long")
    for r in ordered.weighted_positions(frame, [], "v", "n").collect():
        assert r["before"] == sum(1 for x in values if x < r["v"])


def test_digest_rank_is_the_digest_order(spark):
    import hashlib

    names = [f"name {i}" for i in range(300)]
    frame = spark.createDataFrame([(n,) for n in names], "name string")
    ranks = {r["name"]: (r["digest_rank"], r["digest_total"]) for r in ordered.digest_rank(frame, "name", 4).collect()}
    order = sorted(names, key=lambda n: hashlib.md5(f"4:{n}".encode()).hexdigest())
    assert ranks == {n: (i + 1, 300) for i, n in enumerate(order)}
