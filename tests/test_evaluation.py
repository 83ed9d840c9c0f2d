import hashlib
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnloom import fixed
from turnloom.operators import bootstrap, choice, profile, report, similarity
from turnloom.plans import evaluation


def totals(spark, rows):
    return spark.createDataFrame(rows, "cluster string, total double, members long")


# --- intervals ---

def test_interval_interpolates_linearly(spark):
    row = bootstrap.interval(spark.range(1, 9).select(F.col("id").cast("double").alias("estimate"))).first()
    assert (row["samples"], row["low"], row["high"]) == (8, pytest.approx(1.175), pytest.approx(7.825))


def test_cluster_estimates_are_ratios_of_drawn_sums(spark):
    clusters = [("a", 3.0, 1), ("b", 0.0, 3), ("c", 1.5, 2), ("d", -2.0, 4), ("e", 0.5, 1)]
    got = {r["sample"]: r["estimate"] for r in bootstrap.cluster_estimates(totals(spark, clusters), 40, 7).collect()}
    order = sorted(clusters, key=lambda c: hashlib.md5(f"7:{c[0]}".encode()).hexdigest())
    for sample in range(40):
        drawn = []
        for slot in range(5):
            digest = hashlib.md5(f"7:{sample}:{slot // 4}".encode()).hexdigest()
            drawn.append(order[int(digest[8 * (slot % 4):8 * (slot % 4) + 8], 16) % 5])
        assert got[sample] == pytest.approx(sum(c[1] for c in drawn) / sum(c[2] for c in drawn))
    assert len(got) == 40


def test_equal_differences_collapse_the_interval(spark):
    clusters = [(f"c{i}", 0.25 * n, n) for i, n in enumerate((1, 2, 5, 9))]
    row = bootstrap.interval(bootstrap.cluster_estimates(totals(spark, clusters), 50)).first()
    assert row["low"] == pytest.approx(0.25) and row["high"] == pytest.approx(0.25)


def test_exact_clusters_equal_the_numpy_matrix(spark):
    rng = random.Random(0)
    clusters = [(f"c{i:02d}", rng.uniform(-2, 2), rng.randrange(1, 9)) for i in range(23)]
    got = bootstrap.cluster_estimates_exact(totals(spark, clusters), 200, 5).orderBy("sample").collect()
    sampled = np.random.default_rng(5).integers(23, size=(200, 23))
    sums, counts = np.array([c[1] for c in clusters]), np.array([c[2] for c in clusters])
    assert [r["estimate"] for r in got] == pytest.approx(sums[sampled].sum(axis=1) / counts[sampled].sum(axis=1))


def difference_rows(spark, strata, seed=1):
    rng = random.Random(seed)
    return [(s, i, rng.choice((-1, 0, 0, 1))) for s, n in strata.items() for i in range(n)]


def test_exact_strata_equal_one_numpy_generator(spark):
    strata = {"z": 31, "a": 17}
    rows = difference_rows(spark, strata)
    frame = spark.createDataFrame(rows, "stratum string, slot int, difference int")
    got = bootstrap.stratified_estimates_exact(frame, list(strata), 100, 2).orderBy("sample").collect()
    rng, sums = np.random.default_rng(2), np.zeros(100)
    for s, n in strata.items():
        values = np.array([d for t, _, d in rows if t == s])
        sums += values[rng.integers(n, size=(100, n))].sum(axis=1)
    assert [r["estimate"] for r in got] == pytest.approx(sums / 48)
    with pytest.raises(ValueError, match="subjects without results"):
        bootstrap.stratified_estimates_exact(frame, ["a", "nope"], 5)


def test_strata_modes_agree_in_distribution(spark):
    rows = difference_rows(spark, {"hot": 400, "cold": 30})
    frame = spark.createDataFrame(rows, "stratum string, slot int, difference int")
    counts = bootstrap.stratum_counts(frame, "stratum", "difference")
    d = np.array([r[2] for r in rows])
    for method in (bootstrap.stratified_estimates, bootstrap.stratified_estimates_multinomial):
        values = np.array([r["estimate"] for r in method(counts, 1500, 3).collect()])
        assert len(values) == 1500
        assert values.mean() == pytest.approx(d.mean(), abs=0.004)
        assert values.std() == pytest.approx(d.std() / math.sqrt(len(d)), rel=0.1)
        again = sorted(r["estimate"] for r in method(counts, 1500, 3).collect())
        assert again == sorted(values)


# --- similarity ---

def test_scores_and_metrics(spark):
    rows = spark.createDataFrame([
        (0, "e1", [1.0, 0.0], [1.0, 1.0], [2.0, 0.0], ("hi", 2, False), ("", 0, True), 3, 9, 400),
        (1, "e2", [0.0, 3.0], [0.0, 0.0], [0.0, -1.0], ("", 4, True), ("yo", 2, False), 9, 9, 10),
    ], "index long, episode string, ref array<double>, b array<double>, s array<double>, "
       "base struct<text:string,tokens:int,hit_token_limit:boolean>, sft struct<text:string,tokens:int,hit_token_limit:boolean>, "
       "base_encoder_tokens int, sft_encoder_tokens int, reference_tokens int")
    scored = similarity.score_pairs(rows, "ref", "b", "s")
    got = scored.orderBy("index").collect()
    assert [r["base_cosine"] for r in got] == pytest.approx([1 / math.sqrt(2), 0.0])
    assert [r["sft_cosine"] for r in got] == pytest.approx([1.0, -1.0])
    metrics = evaluation.similarity_metrics(scored, 8, samples=20)
    assert metrics["examples"] == 2 and metrics["episodes"] == 2 and metrics["fraction_sft_higher"] == 0.5
    assert metrics["base"]["empty_responses"] == 1 and metrics["base"]["embedding_truncations"] == 1
    assert metrics["sft"]["generation_limit_hits"] == 1 and metrics["sft"]["embedding_truncations"] == 2
    assert metrics["reference_embedding_truncations"] == 2
    assert metrics["mean_paired_difference"] == pytest.approx((1 - 1 / math.sqrt(2) - 1) / 2)
    assert evaluation.similarity_metrics(scored, 8, samples=20, mode="exact")["examples"] == 2


def test_correlations_with_ties(spark):
    rng = random.Random(2)
    points = [(5, rng.randrange(50)) for _ in range(100)] + [(rng.randrange(40), rng.randrange(50)) for _ in range(200)]
    row = similarity.correlations(spark.createDataFrame(points, "x int, y int"), F.col("x"), F.col("y")).first()
    x, y = np.array(points, dtype=float).T

    def ranks(v):
        return np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])

    assert row["rows"] == 300
    assert row["pearson"] == pytest.approx(np.corrcoef(x, y)[0, 1])
    assert row["spearman"] == pytest.approx(np.corrcoef(ranks(x), ranks(y))[0, 1])


# --- multiple choice ---

def item_rows(subjects=fixed.SUBJECTS, tests=3, shift=0):
    rows = []
    for s in subjects:
        for split_name, n in (("dev", 6), ("test", tests)):
            for i in range(n):
                answer = (i + (shift if split_name == "test" else 0)) % 4
                rows.append((s, split_name, i, f"{s} {split_name} {i}?", [f"c{j}" for j in range(4)], answer))
    return rows


ITEM = "subject string, split string, idx int, question string, choices array<string>, answer int"


def examples(spark, rows):
    items = spark.createDataFrame(rows, ITEM)
    return choice.few_shot_examples(items, choice.freeze_manifest(items))


def test_few_shot_examples(spark):
    got = examples(spark, item_rows()).collect()
    assert len(got) == 9
    one = next(r for r in got if r["subject"] == fixed.SUBJECTS[1] and r["idx"] == 2)
    roles = [m["role"] for m in one["messages"]]
    assert roles == ["system"] + ["user", "assistant"] * 5 + ["user"] and one["answer"] == "C"
    assert one["messages"][0]["content"] == fixed.CHOICE_INSTRUCTION
    assert one["messages"][1]["content"] == f"{fixed.SUBJECTS[1]} dev 0?\nA. c0\nB. c1\nC. c2\nD. c3"
    assert [m["content"] for m in one["messages"][2::2]][:5] == ["A", "B", "C", "D", "A"]


def test_test_labels_do_not_reach_prompts(spark):
    prompts = lambda shift: examples(spark, item_rows(shift=shift)).select("subject", "idx", F.to_json("messages"))
    assert prompts(0).exceptAll(prompts(1)).isEmpty()
    assert prompts(0).count() == prompts(1).count()


def test_bad_items_are_refused(spark):
    same = item_rows()
    same[-1] = (*same[-1][:3], f"{fixed.SUBJECTS[2]} dev 1?", *same[-1][4:])
    with pytest.raises(Exception, match="own demonstrations"):
        examples(spark, same).collect()
    for bad in ((["a"] * 3, 0), (["a"] * 4, 4)):
        rows = item_rows()
        rows[-1] = (*rows[-1][:4], *bad)
        with pytest.raises(Exception, match="four choices|answer between"):
            examples(spark, rows).collect()


def test_manifest_rules_and_overlap(spark):
    items = spark.createDataFrame(item_rows(), ITEM)
    manifest = choice.freeze_manifest(items)
    choice.check_manifest(manifest)
    with pytest.raises(ValueError, match="nothing else"):
        choice.check_manifest(manifest.filter(F.col("subject") != fixed.SUBJECTS[0]))
    with pytest.raises(ValueError, match="5 demonstrations"):
        choice.check_manifest(manifest.filter("NOT (split = 'dev' AND idx = 4)"))
    assert choice.question_overlap(items).isEmpty()
    crossed = items.union(spark.createDataFrame(
        [(fixed.SUBJECTS[0], "test", 9, f"{fixed.SUBJECTS[1]} dev 0?", ["a"] * 4, 0)], ITEM))
    assert choice.question_overlap(crossed).count() == 1


def test_items_follow_the_manifest_order(spark):
    items = spark.createDataFrame(item_rows(), ITEM)
    manifest = choice.freeze_manifest(items).filter("split = 'dev'").withColumn("place", 4 - F.col("idx"))
    demos = choice.demonstrations(items, manifest).first()
    assert [q.split()[-1] for q in demos["demo_questions"]] == ["4?", "3?", "2?", "1?", "0?"]


def test_letter_tokens(spark):
    frame = spark.createDataFrame([([[1], [2], [3], [4]],), ([[1], [2], [3], [3]],), ([[1, 5], [2], [3], [4]],)], "t array<array<int>>")
    assert [r[0] for r in frame.select(choice.letters_are_tokens(F.col("t"))).collect()] == [True, False, False]


def test_predictions(spark):
    frame = spark.createDataFrame([(0, [0.0, 2.0, 2.0, 1.0, 5.0])], "i int, z array<double>")
    row = choice.predict(frame, ["i"], "z", (0, 1, 2, 3)).first()
    e = np.exp([0.0, 2.0, 2.0, 1.0])
    assert row["prediction"] == "B" and row["unconstrained_top_token"] == 4
    assert [row["choice_probabilities"][x] for x in "ABCD"] == pytest.approx(list(e / e.sum()))
    assert row["answer_letter_probability_mass"] == pytest.approx(e.sum() / (e.sum() + math.exp(5)))
    bad = spark.createDataFrame([(0, [0.0, float("nan"), 0.0, 0.0])], "i int, z array<double>")
    with pytest.raises(Exception, match="infinite or not a number"):
        choice.predict(bad, ["i"], "z", (0, 1, 2, 3)).collect()


# Published counts: base right, sft right, questions, and the discordant pairs overall.
PUBLISHED = {"high_school_physics": (67, 71, 151), "college_physics": (49, 48, 102), "conceptual_physics": (150, 155, 235)}


def published_rows(spark):
    rows, gained = [], {"high_school_physics": 14, "college_physics": 6, "conceptual_physics": 15}
    for subject, (base, sft, n) in PUBLISHED.items():
        up = gained[subject]
        down = base + up - sft
        marks = [(0, 1)] * up + [(1, 0)] * down + [(1, 1)] * (base - down) + [(0, 0)] * (n - base - up)
        for i, (b, s) in enumerate(marks):
            rows.append((subject, i, "A", ("A" if b else "B", 1.0), ("A" if s else "C", 0.5)))
    return spark.createDataFrame(
        rows, "subject string, index int, answer string, base struct<prediction:string,answer_letter_probability_mass:double>, "
              "sft struct<prediction:string,answer_letter_probability_mass:double>")


@pytest.mark.parametrize("mode", ["portable", "multinomial", "exact"])
def test_published_accuracies(spark, mode):
    metrics = evaluation.choice_metrics(published_rows(spark), mode=mode, samples=2000)
    assert metrics["questions"] == 488
    for subject, (base, sft, n) in PUBLISHED.items():
        scope = metrics["by_subject"][subject]
        assert (scope["base"]["correct"], scope["sft"]["correct"], scope["questions"]) == (base, sft, n)
        assert scope["base"]["accuracy"] == pytest.approx(base / n)
    overall = metrics["overall"]
    assert (overall["base"]["correct"], overall["sft"]["correct"]) == (266, 274)
    assert overall["base"]["accuracy"] == pytest.approx(0.5450819672131147)
    assert overall["sft"]["accuracy"] == pytest.approx(0.5614754098360656)
    assert overall["accuracy_difference"] == pytest.approx(0.016393442622950838)
    assert overall["base"]["mean_answer_letter_probability_mass"] == 1.0
    assert (metrics["base_correct_sft_wrong"], metrics["base_wrong_sft_correct"]) == (27, 35)
    low, high = metrics["paired_accuracy_difference_95_ci"]
    assert low == pytest.approx(-0.0143, abs=0.006) and high == pytest.approx(0.0451, abs=0.006)


def test_missing_subject_is_refused(spark):
    with pytest.raises(ValueError, match="subjects without results"):
        evaluation.choice_metrics(published_rows(spark).filter("subject <> 'college_physics'"))


# --- plot frames ---

def test_similarity_bars(spark):
    metrics = spark.createDataFrame(
        [(0.18636355661366083, 0.20412479646124834, 0.017761239847587512, 0.006107079900463979, 0.028523358508634068)],
        "base_cosine double, sft_cosine double, difference double, low double, high double")
    got = report.similarity_bars(metrics).orderBy("place").collect()
    assert [(r["model"], r["label"]) for r in got] == [("Base", "0.1864"), ("SFT", "0.2041")]
    assert got[0]["axis_upper"] == pytest.approx(0.20412479646124834 * 1.6)
    assert got[0]["caption"] == "SFT minus base: +0.0178\n95% CI [0.0061, 0.0285]"
    low = report.similarity_bars(metrics.withColumn("sft_cosine", F.lit(0.01)).withColumn("base_cosine", F.lit(0.02)))
    assert low.first()["axis_upper"] == 0.32


def test_length_and_accuracy_bars(spark):
    lengths = report.length_bars(spark.createDataFrame([(102.32681, 25.45597)], "base_tokens double, sft_tokens double"))
    assert [r["label"] for r in lengths.orderBy("place").collect()] == ["102.3", "25.5"]
    scopes = choice.accuracy_by_subject(evaluation.choice_rows(published_rows(spark)))
    bars = report.accuracy_bars(scopes).orderBy("place", "model").collect()
    assert [r["label"] for r in bars if r["model"] == "Base"] == ["44.37%", "48.04%", "63.83%", "54.51%"]
    assert [r["subject"] for r in bars if r["model"] == "SFT"] == [
        "High-school physics", "College physics", "Conceptual physics", "Overall"]


def test_model_plug_in_batches(spark):
    def load():
        return lambda batch: batch.assign(size=len(batch))[["id", "size"]]

    got = evaluation.apply_model(spark.range(0, 10, 1, 1), load, "id long, size long", 4).collect()
    assert [r["size"] for r in got] == [4] * 8 + [2] * 2
    with pytest.raises(ValueError):
        evaluation.apply_model(spark.range(1), load, "id long, size long", 0)


def test_dialogue_totals(spark):
    lines = spark.createDataFrame([(1, "Sheldon"), (1, "Beta"), (2, "sheldon")], "episode_id long, speaker string")
    assert profile.dialogue_totals(lines).first().asDict() == {"episodes": 2, "lines": 3, "target_lines": 2}


def test_context_window_rules(spark):
    frame = spark.createDataFrame([([1, 2, 3],)], "t array<int>").select(
        similarity.fits_context(F.col("t"), 4, 7), similarity.fits_context(F.col("t"), 5, 7),
        similarity.shorter_than_context(F.col("t"), 4), similarity.shorter_than_context(F.col("t"), 3))
    assert tuple(frame.first()) == (True, False, True, False)


def test_generation_struct(spark):
    frame = spark.createDataFrame([([5, 7, 2], " \n hi  there\n")], "t array<int>, s string")
    made = frame.select(similarity.generation(F.col("t"), F.col("s"), (2,), 3).alias("g")).first()["g"]
    assert made.asDict() == {"text": "hi  there", "tokens": 2, "hit_token_limit": False}


# --- missing predictions, moments, exact draws, whole evaluations ---

def test_missing_predictions_count_as_wrong(spark):
    rows = [("s", "A", "A", "A")] * 50 + [("s", "A", "A", None)] * 50 + [("s", "A", None, "A")] * 50
    marked = choice.mark_correct(
        spark.createDataFrame(rows, "subject string, answer string, base string, sft string"),
        F.col("answer"), F.col("base"), F.col("sft"))
    overall = next(r for r in choice.accuracy_by_subject(marked).collect() if r["scope"] == "overall")
    assert (overall["base_correct_sft_wrong"], overall["base_wrong_sft_correct"]) == (50, 50)
    counts = bootstrap.stratum_counts(marked, "subject", "difference")
    assert counts.first().asDict() == {"stratum": "s", "members": 150, "minus": 50, "zero": 50}
    bounds = bootstrap.interval(bootstrap.stratified_estimates_multinomial(counts, 400)).first()
    assert bounds["low"] < 0 < bounds["high"] < 0.25
    with pytest.raises(Exception, match="-1, 0 or 1"):
        bootstrap.stratum_counts(marked.withColumn("difference", F.lit(None).cast("int")), "subject", "difference").collect()


def test_correlations_keep_small_spreads_of_large_values(spark):
    rng = random.Random(8)
    rows = [("a", 1e8 + rng.random(), 1e8 + i / 400 + rng.random()) for i in range(400)]
    rows += [("b", 5.0, float(i)) for i in range(9)] + [("c", None, 1.0), ("c", 2.0, 3.0)]
    frame = spark.createDataFrame(rows, "k string, x double, y double")
    got = {r["k"]: r for r in similarity.correlations(frame, F.col("x"), F.col("y"), ["k"]).collect()}
    wanted = frame.filter("k = 'a'").agg(F.corr("x", "y")).first()[0]
    assert got["a"]["pearson"] == pytest.approx(wanted, abs=1e-7) and got["a"]["rows"] == 400
    assert (got["b"]["pearson"], got["b"]["spearman"]) == (None, None) and got["c"]["rows"] == 1
    one = similarity.correlations(frame.filter("k = 'a'"), F.col("x"), F.col("y")).first()
    assert one["pearson"] == pytest.approx(got["a"]["pearson"]) and one["spearman"] == pytest.approx(got["a"]["spearman"])


@pytest.mark.parametrize("bound, count", [(23, 5000), (3_000_000_000, 4000), (1 << 31, 3000), (7, 1)])
def test_chunks_of_draws_equal_one_generator(bound, count):
    whole = np.random.default_rng(11).integers(bound, size=count)
    made, first = [], 0
    while sum(map(len, made)) < count:
        draws, valid = bootstrap.bounded_draws(11, first, 777, bound)
        made.append(draws[valid])
        first += 777
    assert np.concatenate(made)[:count].tolist() == whole.tolist()


def test_parallel_draws_of_several_strata(spark, monkeypatch):
    monkeypatch.setattr(bootstrap, "CHUNK", 97)
    strata = [("a", 31), ("b", 1), ("c", 1000), ("d", 3)]
    got = {}
    for r in bootstrap.sequential_draws(spark, strata, 20, 4).collect():
        got.setdefault((r["stratum"], r["sample"]), []).append(r["slot"])
    rng = np.random.default_rng(4)
    for name, size in strata:
        for sample, drawn in enumerate(rng.integers(size, size=(20, size))):
            assert sorted(got[name, sample]) == sorted(drawn.tolist())


def test_cluster_ranges_keep_the_distribution(spark, monkeypatch):
    monkeypatch.setattr(bootstrap, "RANGE_SLOTS", 16)
    rng = random.Random(6)
    clusters = [(f"c{i}", rng.uniform(-1, 1), 1) for i in range(100)]
    values = np.array([c[1] for c in clusters])
    got = np.array([r["estimate"] for r in bootstrap.cluster_estimates_multinomial(totals(spark, clusters), 1500, 2).collect()])
    assert len(got) == 1500 and got.mean() == pytest.approx(values.mean(), abs=0.01)
    assert got.std() == pytest.approx(values.std() / 10, rel=0.1)
    assert bootstrap.cluster_estimates_multinomial(totals(spark, clusters).limit(0), 5).count() == 0


def test_missing_items_and_subjects_are_refused(spark):
    items = spark.createDataFrame(item_rows(), ITEM)
    manifest = choice.freeze_manifest(items)
    for missing in ("subject = 'college_physics' AND split = 'test' AND idx = 1", "split = 'dev' AND idx = 3"):
        with pytest.raises(Exception, match="the data lack"):
            choice.few_shot_examples(items.filter(f"NOT ({missing})"), manifest).collect()
    stray = spark.createDataFrame([("zoology", "test", 0, 0)], manifest.schema)
    more = items.unionByName(items.filter("split = 'test' AND idx = 0").limit(1).withColumn("subject", F.lit("zoology")))
    with pytest.raises(Exception, match="no demonstrations"):
        choice.few_shot_examples(more, manifest.unionByName(stray)).collect()


def test_choices_from_data_to_metrics(spark, tmp_path):
    ask = lambda s, k: {"question": f"{s} {k}", "choices": list("wxyz"), "answer": len(k) % 4}
    document = {"dataset": "d", "revision": "r", "subjects": [
        {"subject": s, "dev": [ask(s, f"d{i}") for i in range(5)], "test": [ask(s, "t" * i) for i in range(1, 8)]}
        for s in ("s", "t")]}
    data = tmp_path / "data.json"
    data.write_text(json.dumps(document))

    def load(fail):
        def model(batch):
            if fail:
                raise RuntimeError("out of memory")
            one = np.eye(5)
            right = ["ABCD".index(a) for a in batch["answer"]]
            return batch[["index", "subject", "answer"]].assign(
                base_logits=[one[4] + one[0] for _ in right], sft_logits=[4 * one[r] for r in right])
        return lambda: model

    def run(fail=False, window=50, letters=((0,), (1,), (2,), (3,))):
        return evaluation.evaluate_choices(
            spark, str(data), str(tmp_path / "manifest"), str(tmp_path / "run"), str(tmp_path / "metrics.json"), {"seed": 0},
            load(fail), letters, lambda d: d.withColumn("prompt_tokens", F.array_repeat(F.lit(1), 20)), window,
            spark.createDataFrame([(i, x) for i, x in enumerate("ABCD?")], "token int, text string"), ["s", "t"], samples=50, rows_per_step=5)

    with pytest.raises(ValueError, match="token of its own"):
        run(letters=((0,), (0,), (2,), (3,)))
    with pytest.raises(Exception, match="does not fit"):
        run(window=20)
    with pytest.raises(Exception, match="out of memory"):
        run(fail=True)
    metrics = run()
    assert metrics == {k: v for k, v in json.loads((tmp_path / "metrics.json").read_text()).items() if k != "run"}
    assert metrics["questions"] == 14 and metrics["overall"]["sft"]["correct"] == 14
    assert metrics["overall"]["base"]["correct"] == sum(len("t" * i) % 4 == 0 for i in range(1, 8)) * 2
    assert run(fail=True) == metrics  # a finished run loads no model


def test_replies_from_data_to_metrics(spark, tmp_path):
    rows = [{"messages": [{"role": "user", "content": f"q{i}"}, {"role": "assistant", "content": f"a{i}"}],
             "meta": {"episode": f"e{i % 3}", "scene": 0, "target_words": 1}} for i in range(9)]
    data = tmp_path / "heldout.jsonl"
    data.write_text("\n".join(map(json.dumps, rows)) + "\n\n")

    def load(fail):
        def model(batch):
            if fail and 7 in set(batch["index"]):
                raise RuntimeError("stopped")
            reply = lambda text: {"text": text, "tokens": 2, "hit_token_limit": False}
            return batch.assign(base=[reply("no")] * len(batch), sft=[reply(x) for x in batch["reference"]])
        return lambda: model

    def encode(frame):
        vector = lambda c: F.array(F.length(c).cast("double"), F.when(F.col("reference") == c, 1.0).otherwise(-1.0))
        return frame.withColumns({
            "reference_vector": vector(F.col("reference")), "base_vector": vector(F.col("base.text")),
            "sft_vector": vector(F.col("sft.text")), "reference_tokens": F.lit(3), "base_encoder_tokens": F.lit(3),
            "sft_encoder_tokens": F.lit(9)})

    def run(fail=False, window=40):
        return evaluation.evaluate_replies(
            spark, str(data), str(tmp_path / "run"), str(tmp_path / "metrics.json"), {"seed": 0}, load(fail), encode, 8,
            lambda d: d.withColumn("prompt_tokens", F.array_repeat(F.lit(1), 8)), window, 16, rows_per_step=4, samples=50)

    with pytest.raises(Exception, match="no room"):
        run(window=20)
    with pytest.raises(Exception, match="stopped"):
        run(fail=True)
    metrics = run()
    assert metrics["examples"] == 9 and metrics["episodes"] == 3 and metrics["fraction_sft_higher"] == 1.0
    assert metrics["sft"]["embedding_truncations"] == 9 and metrics["sft"]["mean_cosine_similarity"] == pytest.approx(1.0)
    assert run(fail=True) == metrics


def test_accuracy_gain(spark):
    row = report.accuracy_gain(spark.createDataFrame([(0.016393, -0.014344, 0.045082)], "difference double, low double, high double")).first()
    assert row["caption"] == "SFT minus base: +1.64 points\n95% CI [-1.43, +4.51]"


def test_poisson_weights_are_those_of_a_poisson_variable():
    weights = bootstrap.poisson_weights(np.arange(400) * 7919 - 1000, 3000)
    assert weights.mean() == pytest.approx(1, abs=0.01) and weights.var() == pytest.approx(1, abs=0.02)
    assert abs(np.corrcoef(weights[0], weights[1])[0, 1]) < 0.1 and abs(np.corrcoef(weights[:, 0], weights[:, 1])[0, 1]) < 0.2


def test_one_pass_resampling_does_not_depend_on_how_rows_are_dealt(spark):
    draw = np.random.default_rng(3)
    rows = [(f"c{int(c)}", float(d)) for c, d in zip(draw.integers(0, 300, 4000), draw.normal(0.2, 1, 4000))] + [("c1", None)]
    table = spark.createDataFrame(rows, "cluster string, difference double")
    args = (F.col("cluster"), F.col("difference"), 500)
    one = {r["sample"]: r["estimate"] for r in bootstrap.cluster_estimates_poisson(table.repartition(1), *args).collect()}
    many = {r["sample"]: r["estimate"] for r in bootstrap.cluster_estimates_poisson(table.repartition(7, "difference"), *args).collect()}
    assert one.keys() == many.keys() == set(range(500))
    assert all(one[k] == pytest.approx(many[k], rel=1e-9) for k in one)
    totals = {}
    for c, d in rows[:-1]:
        t, m = totals.get(c, (0, 0))
        totals[c] = t + d, m + 1
    ratio = sum(t for t, _ in totals.values()) / 4000
    spread = sum((t - ratio * m) ** 2 for t, m in totals.values()) ** 0.5 / 4000
    values = np.array(list(one.values()))
    assert values.mean() == pytest.approx(ratio, abs=5 * spread / 500**0.5) and values.std() == pytest.approx(spread, rel=0.2)
    assert bootstrap.cluster_estimates_poisson(table.limit(0), *args).where("estimate is not null").isEmpty()
