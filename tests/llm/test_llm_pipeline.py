"""The pipeline: every stage against a brute-force version of its own input."""

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from turnloom.llm import queries
from turnloom.llm.common import scratch

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = queries.table(spark, SF_DIR, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, scratch(stage(spark, docs, SF_DIR))
        out.append((name, before, docs))
    return {name: (before, after) for name, before, after in out}


def ids(rows):
    return {r["doc_id"] for r in rows.select("doc_id").collect()}


def test_names_and_columns(stages):
    assert list(stages) == ["quality_rules", "line_dedup", "near_duplicates", "decontamination", "sentencepiece"]
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    assert all(after.columns == columns for _, after in list(stages.values())[:-1])


def test_quality_keeps_what_the_labels_call_good(stages):
    before, after = stages["quality_rules"]
    labels = dict(duckdb.sql(f"select doc_id, quality from '{SF_DIR}/labels.parquet'").fetchall())
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    kept = ids(after)
    for k, text in texts.items():
        words = text.encode().split()
        runs = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        seen, often = set(), set()
        for x in runs:
            (often if x in seen else seen).add(x)
        inside = {i + j for i, x in enumerate(runs) if x in often for j in range(3)}
        if len(words) < 50 or 100 * len(inside) > 50 * len(words):
            assert k not in kept
        elif labels.get(k) == 1:
            assert k in kept


def test_lines_of_the_earliest_text_stay(stages):
    before, after = stages["line_dedup"]
    docs = {r["doc_id"]: r["text"] for r in before.collect()}
    counts = {i: [len(x.encode().split()) for x in t.split("\n")] for i, t in docs.items()}
    runs = {}
    for i, text in docs.items():
        lines, n = text.split("\n"), counts[i]
        spans = {(0, len(lines))} if sum(n) else set()
        for k in range(len(lines)):
            spans |= {(k, next((e for e in range(k + 1, len(lines) + 1) if sum(n[k:e]) >= 50), None))}
            spans |= {(next((s for s in range(k, -1, -1) if sum(n[s : k + 1]) >= 50), None), k + 1)}
        runs[i] = {(a, b): tuple(lines[a:b]) for a, b in spans if a is not None and b is not None}
    first, wanted = {}, {}
    for i in sorted(runs):
        for (a, b), run in sorted(runs[i].items()):
            first.setdefault(run, (i, a))
    for i, text in docs.items():
        gone = {k for (a, b), run in runs[i].items() if first[run] < (i, a) for k in range(a, b)}
        lines = text.split("\n")
        if len(gone) < len(lines):
            wanted[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    assert {r["doc_id"]: r["text"] for r in after.collect()} == wanted
    assert all(r["n_chars"] == len(r["text"]) for r in after.collect())


def test_one_of_each_group_stays(stages):
    before, after = stages["near_duplicates"]
    sets = {}
    for r in before.collect():
        w = r["text"].lower().encode().split()
        sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    order = sorted(sets)
    for i, a in enumerate(order):
        for b in order[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert ids(after) == {k for k in sets if find(k) == k}


def test_no_benchmark_item_is_left(stages):
    before, after = stages["decontamination"]
    items = [r["text"].encode().split() for r in before.sparkSession.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    items = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in items if len(w) >= 5]
    kept = ids(after)
    for r in before.collect():
        w = r["text"].encode().split()
        own = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        shares = [len(x & own) / len(x) for x in items]
        if max(shares, default=0) == 1:
            assert r["doc_id"] not in kept
        if max(shares, default=0) < 0.5:
            assert r["doc_id"] in kept


def test_everything_left_is_encoded(stages):
    before, after = stages["sentencepiece"]
    rows = after.collect()
    assert {r["doc_id"] for r in rows} == ids(before) and all(r["parity"] and r["round_trip"] for r in rows)
    assert all(len(r["ids"]) == r["n_tokens"] > 0 for r in rows)


def test_registered():
    assert {"pipeline", *queries.QUERIES} <= set(__spark_entry__.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
