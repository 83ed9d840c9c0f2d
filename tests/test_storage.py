import hashlib
import json
import shutil

import pytest
from pyspark.sql import functions as F

from turnloom import schemas
from turnloom.operators import choice, pairs, resume
from turnloom.plans import dialogue, evaluation, training
from turnloom.session import checkpoint_dir
from turnloom.sources import files, sinks
from turnloom.streaming.resume import append_stream


def jsonl(path, *rows):
    path.write_text("".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in rows))
    return str(path)


ROW = {"messages": [{"role": "user", "content": "q w e"}, {"role": "assistant", "content": "a"}],
       "meta": {"episode": "e", "scene": 0, "target_words": 1}}


# --- readers ---

def test_json_lines_keep_file_order(spark, tmp_path):
    rows = [dict(ROW, meta={"episode": f"e{i}", "scene": i, "target_words": 1}) for i in range(50)]
    path = jsonl(tmp_path / "p.jsonl", *rows)
    got = files.read_json_lines(spark, path, schemas.PAIR).orderBy(*files.SOURCE_ORDER).collect()
    assert [r["meta"]["scene"] for r in got] == list(range(50))


def test_bad_and_blank_lines(spark, tmp_path):
    blank = jsonl(tmp_path / "blank.jsonl", ROW, "\t", ROW, "")
    with pytest.raises(Exception, match="blank line"):
        files.read_json_lines(spark, blank, schemas.PAIR).collect()
    assert files.read_json_lines(spark, blank, schemas.PAIR, skip_blank=True).count() == 2
    bad = jsonl(tmp_path / "bad.jsonl", ROW, "{not json")
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        files.read_json_lines(spark, bad, schemas.PAIR).collect()


def test_episode_array_keeps_places_and_empty_episodes(spark, tmp_path):
    line = {"speaker": "A", "text": "t", "scene": 0}
    path = tmp_path / "raw.json"
    path.write_text(json.dumps([{"title": "x", "url": "u", "lines": []}, {"title": "y", "url": "v", "lines": [line]}], indent=1))
    got = files.read_episodes(spark, str(path)).orderBy("episode_id").collect()
    assert [(r["episode_id"], r["title"], len(r["lines"])) for r in got] == [(0, "x", 0), (1, "y", 1)]


def test_choice_documents(spark, tmp_path):
    q = lambda t: {"question": t, "choices": list("abcd"), "answer": 1}
    data = tmp_path / "data.json"
    data.write_text(json.dumps({"dataset": "d", "revision": "r", "subjects": [
        {"subject": "s", "dev": [q(f"d{i}") for i in range(5)], "test": [q("t0"), q("t1")]}]}))
    manifest = tmp_path / "manifest.json"
    digest = hashlib.sha256(data.read_bytes()).hexdigest()
    manifest.write_text(json.dumps({"dataset": "d", "revision": "r", "split": "test", "shots": 5, "data_sha256": digest,
                                    "subjects": {"s": {"dev_indices": [0, 1, 2, 3, 4], "test_indices": [1]}}}))
    items = choice.explode_items(files.read_json_document(spark, str(data), schemas.CHOICE_DATA))
    frozen = choice.explode_manifest(files.read_json_document(spark, str(manifest), schemas.CHOICE_MANIFEST))
    got = choice.few_shot_examples(items, frozen, ["s"]).collect()
    assert [(r["idx"], r["answer"]) for r in got] == [(1, "B")]
    found = files.file_digests(spark, str(data))
    files.require_digest(found, digest)
    with pytest.raises(ValueError, match="frozen for"):
        files.require_digest(found, "0" * 64)


def test_choice_data_is_frozen_once(spark, tmp_path):
    q = lambda t: {"question": t, "choices": list("abcd"), "answer": 1}
    document = {"dataset": "d", "revision": "r", "subjects": [
        {"subject": s, "dev": [q(f"{s} d{i}") for i in range(6)], "test": [q(f"{s} t{i}") for i in range(n)]}
        for s, n in (("s", 2), ("t", 3))]}
    data, manifest = tmp_path / "data.json", tmp_path / "manifest.json"
    data.write_text(json.dumps(document))
    items, frozen = evaluation.prepare_choice_data(spark, str(data), str(manifest), ["s", "t"])
    assert choice.few_shot_examples(items, frozen, ["s", "t"]).count() == 5
    saved = json.loads((manifest / "header.json").read_text())
    chosen = spark.read.parquet(str(manifest / "items")).filter("subject = 't'").collect()
    assert sorted((r["split"], r["idx"]) for r in chosen) == [("dev", i) for i in range(5)] + [("test", i) for i in range(3)]
    evaluation.prepare_choice_data(spark, str(data), str(manifest), ["s", "t"], landed_anew=True)
    with pytest.raises(ValueError, match="another manifest"):
        evaluation.require_same_manifest(frozen.filter("idx > 0"), frozen)
    assert saved["data_sha256"] == hashlib.sha256(data.read_bytes()).hexdigest()
    evaluation.prepare_choice_data(spark, str(data), str(manifest), ["s", "t"])
    with pytest.raises(ValueError, match="nothing else"):
        evaluation.prepare_choice_data(spark, str(data), str(manifest), ["s"])
    data.write_text(json.dumps(document) + " ")
    with pytest.raises(ValueError, match="frozen for"):
        evaluation.prepare_choice_data(spark, str(data), str(manifest), ["s", "t"])


# --- writers ---

def test_json_document_is_replaced_in_one_step(spark, tmp_path):
    path = tmp_path / "metrics.json"
    sinks.write_json_document(spark, str(path), {"a": 1})
    sinks.write_json_document(spark, str(path), {"a": 2, "b": "é"})
    assert json.loads(path.read_text()) == {"a": 2, "b": "é"}
    with pytest.raises(ValueError):
        sinks.write_json_document(spark, str(path), {"a": float("nan")})
    assert json.loads(path.read_text())["a"] == 2
    assert files.read_settings(spark, str(path)) == {"a": 2, "b": "é"}
    assert files.read_settings(spark, str(tmp_path / "none.json")) is None
    assert [p.name for p in tmp_path.iterdir() if p.suffix == ".tmp"] == []


def test_non_finite_values_fail_the_write(spark):
    rows = spark.createDataFrame([(1.0,), (None,)], "x double")
    assert sinks.finite_or_fail(rows, ["x"]).count() == 2
    with pytest.raises(Exception, match="not JSON compliant"):
        sinks.finite_or_fail(rows.union(spark.createDataFrame([(float("inf"),)], "x double")), ["x"]).collect()


def test_append_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(5)], "index long, text string")
    sinks.append_results(rows.filter("index < 3"), path, ["index"])
    sinks.append_results(rows, path, ["index"])
    sinks.append_results(rows, path, ["index"])
    saved = spark.read.schema(rows.schema).json(path)
    assert sorted(r["index"] for r in saved.collect()) == [0, 1, 2, 3, 4]
    assert resume.require_prefix(saved, 5) == 5
    assert resume.remaining(rows, saved, ["index"]).isEmpty()


def test_resume_gates(spark):
    ids = lambda *v: spark.createDataFrame([(i,) for i in v], "index long")
    assert resume.require_prefix(ids(0, 1, 2), 3) == 3
    assert resume.require_prefix(ids(0).filter("false"), 3) == 0
    for bad in (ids(0, 2), ids(1, 2), ids(0, 0, 1), ids(0, 1, 2, 3)):
        with pytest.raises(ValueError, match="first of the inputs"):
            resume.require_prefix(bad, 3)
    resume.require_same_settings(None, {"a": 1})
    resume.require_same_settings({"a": 1, "b": 2}, {"b": 2, "a": 1})
    with pytest.raises(ValueError, match="other settings"):
        resume.require_same_settings({"a": 1}, {"a": 2})


def test_saved_predictions_must_match_the_examples(spark):
    wanted = spark.createDataFrame([(0, "s", "A"), (1, "s", "B")], "place int, subject string, answer string")
    assert resume.prefix_mismatches(wanted.limit(1), wanted, "place", ["subject", "answer"]).isEmpty()
    changed = wanted.withColumn("answer", F.lit("A"))
    assert resume.prefix_mismatches(changed, wanted, "place", ["subject", "answer"]).count() == 1
    extra = spark.createDataFrame([(7, "s", "A")], wanted.schema)
    assert resume.prefix_mismatches(extra, wanted, "place", ["subject", "answer"]).count() == 1


def test_checksum_sets(spark, tmp_path):
    for name, body in (("a", "1"), ("b", "2")):
        (tmp_path / name).write_text(body)
    found = files.file_digests(spark, str(tmp_path)).select("path", "sha256")
    assert resume.compare_checksums(found, found).isEmpty()
    other = found.withColumn("sha256", F.when(F.col("path").endswith("a"), "x").otherwise(F.col("sha256")))
    assert resume.compare_checksums(found, other).count() == 1
    assert resume.compare_checksums(found, found.limit(1)).count() == 1


# --- whole jobs ---

def dialogue_lines(spark):
    rows = []
    for e in range(30):
        for i in range(12):
            who = "Sheldon" if i % 2 else "Beta"
            rows.append((e, f"Episode {e:02d}", i, who, f"words number {e} {i} said by {who} here", i // 6))
    return spark.createDataFrame(rows, "episode_id long, title string, line int, speaker string, text string, scene int")


@pytest.mark.parametrize("exact", [False, True])
def test_build_and_validate(spark, tmp_path, exact):
    rules = pairs.PairRules(min_target_words=5)
    made = dialogue.build_dataset(dialogue_lines(spark), str(tmp_path), rules, exact_split=exact)
    assert {r["reason"]: r["rows"] for r in made["reasons"].collect()} == {"kept": 180}
    summary = {r["scope"]: (r["pairs"], r["episodes"]) for r in made["summary"].collect()}
    assert summary == {"all": (180, 30), "train": (162, 27), "heldout": (18, 3)}
    checked = dialogue.validate_dataset(spark, str(tmp_path))
    assert {r["split"]: r["rows"] for r in checked["lengths"].collect()} == {"train": 162, "heldout": 18}
    assert {(r["split"], r["messages"], r["rows"]) for r in checked["turns"].collect() if r["split"] == "heldout"} <= {
        ("heldout", n, k) for n in (2, 4) for k in range(19)}
    assert checked["phrases"].isEmpty()
    assert {(r["split"], r["hits"], r["percent"]) for r in checked["phrase_summary"].collect()} == {
        ("train", 0, 0.0), ("heldout", 0, 0.0)}
    parts = sorted((tmp_path / "splits" / "split=train").glob("part-*"))
    written = [json.loads(l)["meta"]["episode"] for p in parts for l in p.read_text().splitlines()]
    assert written == sorted(written) and len(written) == 162
    ready = training.training_rows(spark, str(tmp_path / "splits" / "split=train"))
    assert ready.count() == 162
    manifest = training.run_manifest(spark, str(parts[0]), {"seed": 0}, "r1", {"x": "1"})
    assert manifest["dataset_sha256"] == hashlib.sha256(parts[0].read_bytes()).hexdigest()
    many = training.run_manifest(spark, str(tmp_path / "splits" / "split=train"), {}, "r1", {})
    assert many["training_examples"] == 162 and len(many["dataset_sha256"]) == 64


def test_validation_reports_every_kind_of_problem(spark, tmp_path):
    bad = {"messages": [{"role": "user", "content": "Penny: x"}, {"role": "assistant", "content": "Same"}],
           "meta": {"episode": "e", "scene": 0, "target_words": 1}}
    for name, row in (("train", ROW), ("heldout", bad)):
        folder = tmp_path / "splits" / f"split={name}"
        folder.mkdir(parents=True)
        jsonl(folder / "p.jsonl", row, dict(bad, meta=dict(bad["meta"], episode="f")))
    with pytest.raises(ValueError) as caught:
        dialogue.validate_dataset(spark, str(tmp_path))
    text = str(caught.value)
    assert text.count("speaker-name prefix") == 3
    assert "2 episode(s) in BOTH splits: e, f" in text and "2 held-out target(s)" in text


@pytest.mark.parametrize("empty", ["train", "heldout"])
def test_empty_split_is_refused(spark, tmp_path, empty):
    for name in ("train", "heldout"):
        folder = tmp_path / "splits" / f"split={name}"
        folder.mkdir(parents=True)
        jsonl(folder / "p.jsonl", *([] if name == empty else [ROW]))
    with pytest.raises(ValueError, match=f"no rows in the {empty} split"):
        dialogue.validate_dataset(spark, str(tmp_path))


def test_steps_resume_after_a_failure(spark, tmp_path):
    inputs = spark.range(0, 11, 1, 3).withColumnRenamed("id", "index")
    calls = str(tmp_path / "calls")

    def load(broken_at):
        def model(batch):
            with open(calls, "a") as log:
                log.write("".join(f"{i}\n" for i in batch["index"]))
            if broken_at in set(batch["index"]):
                raise RuntimeError("model crashed")
            return batch.assign(text="t" + batch["index"].astype(str))
        return lambda: model

    run = lambda broken, seed=0: evaluation.run_in_steps(
        inputs, str(tmp_path / "run"), {"seed": seed}, load(broken), "index long, text string", 2, 4)
    with pytest.raises(Exception, match="model crashed"):
        run(5)
    before = open(calls).read().split()
    assert sorted(r["index"] for r in run(None).collect()) == list(range(11))
    after = open(calls).read().split()[len(before):]
    assert sorted(map(int, after)) == list(range(4, 11))
    run(None)
    assert len(open(calls).read().split()) == len(before) + len(after)
    with pytest.raises(ValueError, match="other settings"):
        run(None, seed=1)


def test_results_are_saved_with_their_settings(spark, tmp_path):
    rows = spark.createDataFrame([(0, 0.5), (1, -0.25)], "index long, difference double")
    save = lambda frame, metrics: evaluation.save_results(
        frame, ["difference"], metrics, {"seed": 0}, str(tmp_path / "out"), str(tmp_path / "metrics.json"))
    save(rows, {"mean": 0.125})
    assert json.loads((tmp_path / "metrics.json").read_text()) == {"mean": 0.125, "run": {"seed": 0}}
    with pytest.raises(Exception, match="not JSON compliant"):
        save(rows.withColumn("difference", F.lit(float("nan"))), {"mean": 0.0})
    assert json.loads((tmp_path / "metrics.json").read_text())["mean"] == 0.125
    assert sorted(r["difference"] for r in spark.read.schema(rows.schema).json(str(tmp_path / "out/scored")).collect()) == [-0.25, 0.5]
    save(rows.filter("index = 0"), {"mean": 0.5})
    assert spark.read.schema(rows.schema).json(str(tmp_path / "out/scored")).count() == 1
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["scored"]


def test_training_argument_rules():
    good = dict.fromkeys(training.POSITIVE, 1)
    assert training.argument_errors(good, True, True, None, True) == []
    assert training.argument_errors({**good, "cpu": True}, True, False, True, False) == []
    bad = training.argument_errors({**good, "epochs": 0, "max_steps": 0}, False, False, None, False)
    assert len(bad) == 5


def test_token_gate(spark):
    rows = spark.createDataFrame([([1], [1, 9])], "prompt_ids array<int>, full_ids array<int>")
    assert training.require_tokens(rows, 9, 5).count() == 1
    with pytest.raises(Exception, match="no_end_token"):
        training.require_tokens(rows, 8, 5).collect()


def test_stream_resumes_without_repeating(spark, tmp_path):
    source, sink, progress = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "progress")
    source.mkdir()
    schema = schemas._struct(index=schemas.LONG, text=schemas.STRING)

    def run():
        query = append_stream(spark, str(source), schema, lambda d: d.withColumn("n", F.length("text")), sink, progress)
        query.awaitTermination()
        return sorted(r["index"] for r in spark.read.schema("index long, n int").json(sink).collect())

    jsonl(source / "1.json", {"index": 0, "text": "a"}, {"index": 1, "text": "b"})
    assert run() == [0, 1]
    jsonl(source / "2.json", {"index": 2, "text": "c"})
    assert run() == [0, 1, 2] and run() == [0, 1, 2]


def test_checkpoint_folder_of_the_session_is_used(spark):
    named = spark.conf.get("spark.checkpoint.dir")
    assert checkpoint_dir(spark) == named
    assert named in spark.sparkContext.getCheckpointDir()


def test_episodes_of_several_files_stay_apart(spark, tmp_path):
    line = lambda who, text: {"speaker": who, "text": text, "scene": 0}
    folder = tmp_path / "raw"
    folder.mkdir()
    for k in range(3):
        (folder / f"{k}.json").write_text(json.dumps([
            {"title": f"t{k}{i}", "url": "u", "lines": [line("Beta", f"one two three {k}{i}"), line("Sheldon", f"four five six {k}{i}")]}
            for i in range(2)]))
    episodes = files.read_episodes(spark, str(folder))
    assert sorted((r["episode_id"], r["title"]) for r in episodes.collect()) == [(2 * k + i, f"t{k}{i}") for k in range(3) for i in range(2)]
    rules = pairs.PairRules(min_target_words=2, min_prompt_words=2)
    lines = pairs.explode_lines(episodes)
    made = pairs.build_pairs(pairs.candidates(pairs.attach_context(lines, rules), rules)).collect()
    assert len(made) == 6 and all(len(r["prompt"]) == 1 for r in made)


def test_a_failed_swap_leaves_the_old_rows(spark, tmp_path):
    path = tmp_path / "rows"
    sinks.replace_folder(spark, str(path), lambda new: spark.range(3).write.parquet(new))

    def vanish(new):
        spark.range(5).write.parquet(new)
        shutil.rmtree(new)  # the second rename finds nothing to move

    with pytest.raises(OSError, match="still there"):
        sinks.replace_folder(spark, str(path), vanish)
    assert spark.read.parquet(str(path)).count() == 3 and [p.name for p in tmp_path.iterdir()] == ["rows"]


def test_files_are_hashed_in_pieces(spark, tmp_path, monkeypatch):
    big = tmp_path / "a b.bin"
    big.write_bytes(bytes(range(256)) * 50_000)
    found = files.file_digests(spark, str(tmp_path)).collect()
    assert [(r["bytes"], r["sha256"]) for r in found] == [(12_800_000, hashlib.sha256(big.read_bytes()).hexdigest())]


def test_errors_come_in_the_order_of_the_files(spark, tmp_path):
    wrong = {"messages": [{"role": "assistant", "content": "Penny: x"}, {"role": "assistant", "content": "b"}],
             "meta": {"episode": "e", "scene": 0, "target_words": 1}}
    other = dict(wrong, meta=dict(wrong["meta"], episode="f"), messages=[*wrong["messages"][:1], {"role": "assistant", "content": "c"}])
    for name, row in (("train", wrong), ("heldout", other)):
        folder = tmp_path / "splits" / f"split={name}"
        folder.mkdir(parents=True)
        jsonl(folder / "p.jsonl", row)
    with pytest.raises(ValueError) as caught:
        dialogue.validate_dataset(spark, str(tmp_path))
    told = str(caught.value).splitlines()[1:]
    assert ["train" in x for x in told] == [True, True, False, False]
    assert "speaker-name" in told[0] and "has role" in told[1]
