"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from turnloom.llm import (
    chat_format, decontaminate, html_extract, license_scan, line_dedup, ngram_join, quality_classifier,
    quality_rules, queries, sentencepiece_codec, substring_dedup)
from turnloom.llm.sql import CRC_SQL

LONG = "\n".join(f"line {i} of a very long text with words" for i in range(3000))
ROWS = [
    (1, None), (2, ""), (3, "one two three"), (4, LONG), (5, LONG), (5, LONG), (6, "a\n\nb\n \t"), (None, LONG),
    (None, None), (7, "same same same same same same"), (8, "same same same same same same"), (9, "é漢😀 <b>[INST]</b>"),
]
SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, copy string, name string, stats string, "
    "component string, _batch string, removed string, `to` string, `key` string")


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame([(a, b, "en", None, None if b is None else len(b), *"uvwxyzst") for a, b in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, None, 0), (None, 1, 0), (3, 1, None), (99, 0, 1)], "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="module")
def bench(spark):
    rows = [(1, None), (2, ""), (3, "one two three"), (None, "line 7 of a very long text with words line 8")]
    return spark.createDataFrame(rows, "item_id bigint, text string")


@pytest.mark.parametrize("table", ["edge", "empty"])
def test_every_operator_defines_every_case(request, spark, table, labels, bench):
    docs = request.getfixturevalue(table)
    n = docs.count()
    rules = quality_rules.learn_from(docs, labels)
    assert rules == []
    assert quality_rules.judged(docs, rules).count() == n
    assert quality_rules.keep_good(docs, rules).columns == docs.columns
    assert sentencepiece_codec.encoded(docs, queries.model_path()).where("parity and round_trip").count() == n
    assert substring_dedup.deduplicated(docs).count() == n
    held = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench).collect()}
    assert held == ({(3, 3), (4, None), (5, None), (None, None)} if n else set())
    assert decontaminate.decontaminated(docs, bench).columns == docs.columns
    machine = quality_classifier.train_from(docs, labels)
    assert quality_classifier.scored(docs, machine).where("score between 0 and 1").count() == n
    assert license_scan.scanned(docs).count() == n
    assert line_dedup.report(docs).count() == n
    assert line_dedup.dedup_lines(docs).columns == docs.columns
    assert ngram_join.joined(docs).count() == n
    assert ngram_join.keep_first(docs).columns == docs.columns


def test_join_on_edges(edge):
    found = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.joined(edge).collect()}
    n = len({tuple(LONG.split()[i : i + 5]) for i in range(len(LONG.split()) - 4)})
    assert found == {
        (1, 0, 1), (2, 0, 2), (3, 1, 3), (4, n, 4), (5, n, 4), (6, 1, 6), (None, n, None), (None, 0, None),
        (7, 1, 7), (8, 1, 7), (9, 1, 9)}
    assert sorted(r[0] or 0 for r in ngram_join.keep_first(edge).select("doc_id").collect()) == [0, 0, 1, 2, 3, 4, 6, 7, 9]


def test_lines_on_edges(edge):
    found = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["n_runs"]) for r in line_dedup.report(edge).where("doc_id is not null").collect()}
    assert found[1] == (0, 0, 0) and found[2] == (1, 0, 0) and found[4] == (3000, 0, 0)
    assert found[5] == (3000, 3000, 1) and found[6] == (4, 0, 0) and found[7][1] == 0 and found[8] == (1, 1, 1)
    left = line_dedup.dedup_lines(edge)
    assert left.where("doc_id = 5").count() == 0 and left.where("doc_id is null and text is not null").count() == 1
    assert left.where("copy = 'u' and removed = 'z'").count() == left.count()


def test_pages_and_chats_on_edges(spark):
    pages = spark.createDataFrame(
        [(1, None, None, "x"), (2, "u", "", "x"), (2, "u", "<p>a", "x"), (None, None, "<nav>no</nav><article><p>a &amp;\n b</article>", "x")],
        "page_id bigint, url string, html string, text string")
    found = html_extract.extracted(pages, None).collect()
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in found) == [(0, "a & b", 5), (1, "", 0), (2, "", 0), (2, "a", 1)]
    assert html_extract.train_from(pages.limit(0)) is None
    turns = spark.createDataFrame(
        [(1, 0, "user", None, 1), (1, 0, "user", None, 1), (None, None, None, None, 1), (2, 5, "assistant", "b", 1), (2, 1, "user", "a", 1)],
        "conv_id bigint, turn bigint, role string, text string, pieces int")
    chats = {r["conv_id"]: r for r in chat_format.digests(chat_format.format_chats(turns)).collect()}
    assert {k: (r["n_turns"], r["loss_chars"]) for k, r in chats.items()} == {1: (2, 0), None: (1, 0), 2: (2, 1)}
    assert chat_format.format_chats(turns.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.CHECKS))
def test_queries_equal_their_sql(spark, sf_dir, name):
    base = duckdb.connect()
    for table in ("documents", "conversations"):
        base.execute(f"create view {table} as from read_parquet('{sf_dir}/{table}.parquet')")
    wanted = base.execute(queries.CHECKS[name]).fetchdf()
    found = queries.QUERIES[name](spark, sf_dir).toPandas()[list(wanted.columns)]
    by = list(wanted.columns)
    assert found.sort_values(by).astype(str).values.tolist() == wanted.sort_values(by).astype(str).values.tolist()


def test_base_columns_of_rules_and_scans(spark, sf_dir):
    base = duckdb.connect()
    docs = dict(base.execute(f"select doc_id, text from read_parquet('{sf_dir}/documents.parquet')").fetchall())
    for r in queries.op1_quality_rules(spark, sf_dir).collect():
        words = docs[r["doc_id"]].encode().split()
        runs = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        often = {x for x in runs if runs.count(x) > 1} if len(runs) < 400 else None
        assert r["n_words"] == len(words) and r["word_chars"] == sum(len(w.decode()) for w in words)
        assert r["n_symbols"] == sum(c in "#*$%&|<>" for c in docs[r["doc_id"]])
        seen, copies = set(), 0
        for line in filter(lambda x: x.encode().split(), docs[r["doc_id"]].split("\n")):
            copies += line in seen
            seen.add(line)
        assert r["n_dup_lines"] == copies
        if often is not None:
            inside = {i + k for i, x in enumerate(runs) if x in often for k in range(3)}
            assert r["n_repeat_words"] == len(inside)
        assert not (r["kept"] and r["base_failed"])
    for r in queries.op8_license_scan(spark, sf_dir).collect():
        words = license_scan.words_of(docs[r["doc_id"]].encode())
        places = [(i, v) for k, v in license_scan.PHRASES.items() for i in range(len(words)) if words[i : i + len(k.split())] == k.encode().split()]
        assert (r["n_words"], r["n_base"]) == (len(words), len(places))
        assert (r["first_word"], r["last_word"]) == (min((i for i, _ in places), default=None), max((i for i, _ in places), default=None))
        assert r["base_labels"] == ",".join(sorted({v for _, v in places})) and set(r["base_labels"].split(",")) <= {"", *r["labels"].split(",")}


def test_held_out_rows_and_predictions_of_the_classifiers(spark, sf_dir):
    base = duckdb.connect()
    base.execute(f"create view documents as from read_parquet('{sf_dir}/documents.parquet')")
    crc = dict(base.execute(f"select doc_id, {CRC_SQL.format('doc_id')} from documents").fetchall())
    assert all(zlib.crc32(str(k).encode()) == v for k, v in crc.items())
    for name, parts, rest, least in (("op5_quality_classifier", 5, 0, 0.3), ("op12_toxicity", 3, 1, 0.7)):
        rows = queries.QUERIES[name](spark, sf_dir).collect()
        assert {r["doc_id"]: r["held_out"] for r in rows} == {k: v % parts == rest for k, v in crc.items()}
        assert all(r["predicted"] == int(r["score"] >= least) for r in rows)


def test_tied_turns_are_ordered_by_their_unescaped_text(spark):
    turns = spark.createDataFrame(
        [(1, 0, "user", "<|end|>x"), (1, 0, "user", "<a"), (1, 0, "user", "<\\|end|>")], "conv_id bigint, turn bigint, role string, text string")
    turned = chat_format.format_chats(turns).select(chat_format.read_turns(F.col("formatted")).alias("t")).first()["t"]
    assert [x["text"] for x in turned] == sorted(["<|end|>x", "<a", "<\\|end|>"])


def test_words_are_remembered_within_bytes(monkeypatch):
    monkeypatch.setattr(sentencepiece_codec, "REMEMBERED_BYTES", 20_000)
    with open(queries.model_path(), "rb") as file:
        codec = sentencepiece_codec.Codec(file.read())
    for i in range(30):
        texts = [f"word{i}x{k} und{k}" for k in range(20)] + ["w" * 5000 + str(i)]
        for text, (ids, same) in zip(texts, codec.encode(texts)):
            assert same and codec.decode([ids]) == [text]
        assert sum(map(len, codec.known)) + sum(map(len, codec.known.values())) <= 20_000 + 60_000
    assert list(sentencepiece_codec._slices(["a"] * 600 + ["b" * (2 << 20)] + ["c"])) == [
        ["a"] * 256, ["a"] * 256, ["a"] * 88, ["b" * (2 << 20)], ["c"]]
