"""Learned models, automata, codecs and the chat template."""

import hashlib
import random
import struct

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pages_by_hand import PAGES as BY_HAND
from pages_by_hand import marked
from turnloom.llm import chat_format, html_extract, license_scan, quality_classifier, quality_rules, queries
from turnloom.llm import sentencepiece_codec as codec


# --- quality rules ---

def test_rules_cover_what_is_bad_and_nothing_else(spark):
    draw = np.random.default_rng(0)
    table = {k: draw.random(3000) for k in ("a", "b", "c")}
    bad = ((table["a"] >= 0.8) & (table["b"] < 0.3)) | (table["c"] >= 0.95)
    rules = quality_rules.learn(table, bad)
    hits = np.any([r.hits(table) for r in rules], axis=0)
    assert (hits & bad).sum() > 0.9 * bad.sum() and (hits & ~bad).sum() < 0.1 * hits.sum()
    rows = spark.createDataFrame([tuple(map(float, x)) for x in zip(*table.values())], "a double, b double, c double")
    columns = {k: F.col(k) for k in "abc"}
    shown = rows.select(*[r.condition(columns).alias(f"r{i}") for i, r in enumerate(rules)]).toPandas().to_numpy()
    assert (shown.any(axis=1) == hits).all()
    assert quality_rules.learn(table, np.zeros(3000, bool)) == []


def test_rules_and_scores_on_labelled_documents(spark):
    sf_dir = "/root/testdata/sf0.01"
    labels = dict(duckdb.sql(f"select doc_id, quality from '{sf_dir}/labels.parquet'").fetchall())
    kept = {r["doc_id"]: r for r in queries.op1_quality_rules(spark, sf_dir).collect()}
    judged = [(labels[k], r["kept"]) for k, r in kept.items() if k in labels and not r["base_failed"]]
    assert sum(y == int(x) for y, x in judged) > 0.95 * len(judged)
    assert not any(y == 1 and not x for y, x in judged)
    scored = queries.op5_quality_classifier(spark, sf_dir).collect()
    held = [(labels[r["doc_id"]], r["predicted"]) for r in scored if r["held_out"] and r["doc_id"] in labels]
    assert len(held) > 40 and sum(a == b for a, b in held) > 0.9 * len(held)


# --- factorisation machine ---

def test_pairs_in_linear_time_equal_all_pairs():
    draw = np.random.default_rng(1)
    machine = quality_classifier.Machine(
        0.3, draw.normal(size=quality_classifier.SIZE), draw.normal(size=(quality_classifier.SIZE, 4)))
    slots, values = quality_classifier.features(b"some words and Some other words!\nsome words and\n12")
    naive = 0.3 + sum(machine.weights[s] * v for s, v in zip(slots, values))
    for i in range(len(slots)):
        for j in range(i):
            naive += machine.factors[slots[i]] @ machine.factors[slots[j]] * values[i] * values[j]
    assert machine.margin(slots, values) == pytest.approx(naive)


# --- recurrent labeller ---

def test_gradients_of_the_labeller():
    draw = np.random.default_rng(2)
    model = html_extract.Labeller()
    lengths = np.array([3, 1, 4])
    rows, labels = draw.normal(size=(8, html_extract.INPUTS)), draw.integers(0, 2, 8).astype(float)
    weight = np.array([1, 1, 0, 1, 1, 1, 1, 1.0])

    def loss():
        p = model._forward(rows, lengths)[0]
        return -(weight * (labels * np.log(p) + (1 - labels) * np.log(1 - p))).sum() / weight.sum()

    grads = model.gradients(rows, lengths, labels, weight)
    for part, grad in zip(model.parts, grads):
        flat = part.reshape(-1)
        for k in draw.integers(0, flat.size, 4):
            kept, step = flat[k], 1e-5
            flat[k] = kept + step
            up = loss()
            flat[k] = kept - step
            down = loss()
            flat[k] = kept
            assert grad.reshape(-1)[k] == pytest.approx((up - down) / (2 * step), abs=1e-7, rel=1e-4)


PAGES = {
    "<nav><a href=x>Home</a></nav><article><h1>T &amp; U</h1><p>One<b>two</b> <br>three<p>four</article><footer>f</footer>":
        "T & U Onetwo three four",
    "<script>var a='<p>no</p>'</script><main>a&nbsp;b<div class='comments'><p>so true</p></div></main>": "a b",
    "<article>broken <p title='a > b'>text": "broken text",
    "<div class=\"ad\">buy</div><!-- <article>x</article> -->": "",
}


def test_pages_by_their_elements():
    assert html_extract.extract(list(PAGES), None) == [PAGES[p] if PAGES[p] else "" for p in PAGES]


@pytest.mark.parametrize("page, text", [
    ("<article><p>a <svg viewBox='0 0 1 1'/> b</p><p>c</p></article>", "a b c"),
    ("<article><p>a <svg width=1 hidden/> b</p><svg/><p>c</p></article>", "a b c"),
    ("<article>a <svg><title>t</title><style/><g><path d='M0'/><text>no</text></g></svg> b</article>", "a b"),
    ("<article><datalist id=x><option value=1><option value=2></datalist><p>b</p></article><p>c", "b c"),
    ("<article><select><optgroup label=g><option>no<option>no</select><p>b</p></article>", "b"),
    ("<article><select><option>no<p>b</p></article><p>c</p>", "b c"),
    ("<div><option>no</div><p>b</p>", "b"),
    ("<option>no<p>b</p>", "b"),
    ("<p>a</p><svg><path><p>b</p></svg><p>c</p>", "a b c"),
    ("<svg><p>b</p><object data=x>c <template>d", "b c d"),
    ("<article><p>a</p><template><div><p>no</p></div></template><noscript><p>no</p></noscript><p>b</p></article>", "a b"),
    ("<p>a <svg><foreignObject><div>no</div></foreignObject></svg> b</p>", "a b"),
    ("<article><p>so <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds</p></article>", "so x=1 holds"),
    ("<div><template>no</div><p>b</p><template>no</template>c", "b c"),
])
def test_text_after_side_elements_stays(page, text):
    assert html_extract.extract([page], None) == [text]


def test_trained_labeller_reads_renamed_pages(spark, sf_dir):
    labeller = html_extract.train_from(queries.table(spark, sf_dir, "pages"))
    pages = [r["html"] for r in queries.table(spark, sf_dir, "pages").select("html").collect()]
    wanted = [" ".join(b.text for b in html_extract.blocks(p) if html_extract.told(b.path) == 1) for p in pages]
    assert sum(a == b for a, b in zip(html_extract.extract(pages, labeller), wanted)) > 0.98 * len(pages)
    renamed = [p.replace("<article>", '<div class="x9">').replace("</article>", "</div>") for p in pages]
    assert sum(a == b for a, b in zip(html_extract.extract(renamed, labeller), wanted)) > 0.9 * len(pages)


# --- licence automaton ---

def test_pages_marked_by_hand(spark):
    """Labels that do not come from the rule that taught the labeller: tables, lists, sections, words on body."""
    labeller = html_extract.train_from(queries.table(spark, "/root/testdata/sf0.1", "pages"))
    wanted = hit = extra = 0
    for page, inside in map(marked, BY_HAND):
        found = html_extract.blocks(page)
        kept = labeller.scores(html_extract.vectors([found]), np.array([len(found)])) >= 0.5
        wanted += len(inside)
        hit += sum(b.text in inside for b, k in zip(found, kept) if k)
        extra += sum(b.text not in inside for b, k in zip(found, kept) if k)
    assert hit >= 0.97 * wanted and extra <= 2


def test_matching_statistics_equal_brute_force():
    draw = random.Random(3)
    bodies = [[draw.randrange(4) for _ in range(30)] for _ in range(3)]
    tokens = [draw.randrange(4) for _ in range(200)]
    automaton = license_scan.SuffixAutomaton(bodies)

    def places(run):
        return {(k, i + len(run)) for k, b in enumerate(bodies) for i in range(len(b) - len(run) + 1) if b[i : i + len(run)] == run}

    for a, b, state in automaton.matches(tokens, 1):
        assert set(automaton.ends[state]) == places(tokens[a:b])
        assert b == len(tokens) or not places(tokens[a : b + 1])
        assert a == 0 or not places(tokens[a - 1 : b])


def test_licences_of_texts():
    scanner = license_scan.Scanner()
    mit = license_scan.TEMPLATES["mit"]
    half = " ".join(mit.split()[:40])
    for text, labels, n_base in (
        (f"x {mit} y", "mit", 0), (f"{half} other words", "mit", 0), ("Released under the MIT\nLicense.", "mit", 1),
        ("This work is licensed under the GNU General Public License, version 3.", "gpl", 0),
        ("Apache-License, VERSION 2! CC-BY-NC", "apache-2,cc-by-nc", 2), ("permission is hereby granted to all", "", 0), ("", "", 0),
    ):
        found = scanner.scan(text.encode())
        assert (found["labels"], found["n_base"]) == (labels, n_base), text


def test_every_place_of_a_template_is_a_span():
    scanner = license_scan.Scanner()
    isc, mit = license_scan.TEMPLATES["isc"], license_scan.TEMPLATES["mit"]
    other = " ".join(f"x{i}" for i in range(30))
    n, m = (len(license_scan.words_of(x.encode())) for x in (isc, mit))
    for between in (other, "and", ""):
        gap = len(between.split())
        found = scanner.scan(f"{isc} {between} {mit} {between} {isc} {between} {isc}".encode())["spans"]
        assert [(x["label"], x["start"], x["stop"], x["share"]) for x in found] == sorted([
            ("isc", 0, n, 1.0), ("mit", n + gap, n + gap + m, 1.0), ("isc", n + m + 2 * gap, 2 * n + m + 2 * gap, 1.0),
            ("isc", 2 * n + m + 3 * gap, 3 * n + m + 3 * gap, 1.0)])
    notice = "Released under the MIT License. "
    assert len(scanner.scan((notice * 3000).encode())["spans"]) == 3000
    # the first place of b lies in a longer chain of a, the second one stands alone
    both = " ".join(f"w{i}" for i in range(12))
    scanner = license_scan.Scanner({}, {"a": f"{both} a1 a2 a3 a4", "b": both}, {})
    assert [x["label"] for x in scanner.scan(f"{both} a1 a2 a3 a4 {other} {both}".encode())["spans"]] == ["a", "b"]


# --- SentencePiece ---

TEXTS = st.text(st.characters(codec="utf-8", exclude_characters="▁"), max_size=60) | st.text("ab \n\t.é漢😀<>", max_size=80)


@pytest.fixture(scope="module")
def pieces():
    with open(queries.model_path(), "rb") as file:
        return codec.Codec(file.read())


@settings(max_examples=150, deadline=None)
@given(batch=st.lists(TEXTS, max_size=4))
def test_parity_and_round_trip(pieces, batch):
    found = pieces.encode(batch)
    assert [x for x, _ in found] == pieces.expected(batch) and all(same for _, same in found)
    assert pieces.decode([x for x, _ in found]) == batch
    lists = [np.frombuffer(x, "<i4").tolist() for x, _ in found]
    assert pieces.tokenizer.decode_batch(lists, skip_special_tokens=False) == batch


def field(number, value):
    if isinstance(value, float):
        return bytes([number << 3 | 5]) + struct.pack("<f", value)
    if isinstance(value, int):
        return b"".join([_number(number << 3), _number(value)])
    return _number(number << 3 | 2) + _number(len(value)) + value


def _number(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def test_unigram_models_are_rebuilt():
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), ("▁", -3.0, 1), ("▁he", -2.0, 1), ("llo", -2.5, 1),
              ("l", -4.0, 1), ("o", -4.5, 1), ("h", -5.0, 1), ("e", -5.5, 1), ("▁hello", -8.0, 1)]
    data = b"".join(field(1, field(1, p.encode()) + field(2, s) + field(3, k)) for p, s, k in pieces)
    data += field(2, field(3, 1)) + field(3, field(1, b"identity") + field(3, 1) + field(4, 0) + field(5, 1))
    model = codec.Codec(data)
    assert model.model.kind == codec.UNIGRAM and not model.by_word
    batch = ["hello", "hello  lo", "", "ole", "hx"]
    found = model.encode(batch)
    assert all(same for _, same in found) and [x for x, _ in found] == model.expected(batch)
    assert model.decode([x for x, _ in found][:4]) == batch[:4]


# --- chats ---

CONTROL = st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<|end|>", "<|turn|>", "<|text|>", "\\", "<", "[", "a", "é\n"])


def test_any_text_comes_back(spark):
    draw = random.Random(5)
    said = [None, "", "</s>[INST] ok [/INST]", "<\\\\s>"]
    parts = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|end|>", "<|turn|>", "<|text|>", "<|image|>", "\\", "<", "[", "|>", "a", "é😀\n"]
    said += ["".join(draw.choice(parts) for _ in range(draw.randrange(9))) for _ in range(400)]
    rows = [(i // 5, i % 5, draw.choice(["user", "assistant", None, "<|text|>"]), t) for i, t in enumerate(said)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    chats = chat_format.format_chats(turns)
    back = chats.select("conv_id", chat_format.read_turns(F.col("formatted")).alias("turns"), chat_format.read_loss(F.col("pieces")).alias("loss"))
    for r in back.collect():
        own = [(x[2] or "", x[3] or "") for x in rows if x[0] == r["conv_id"]]
        assert [(t["role"], t["text"]) for t in r["turns"]] == own
        assert r["loss"] == "".join(t for role, t in own if role == "assistant")


def test_typed_parts(spark):
    part = lambda kind, **k: {x: k.get(x) for x in ("text", "ref", "width", "height", "seconds", "pages")} | {"kind": kind}
    rows = [(1, 0, "user", [part("text", text="see "), part("image", ref="i1", width=28, height=15), part("text", text=" </s>"),
                            part("audio", ref="a1", seconds=1.5), part("document", ref="d1", pages=2), part("odd", text="?"), part("image")]),
            (1, 1, "assistant", None)]
    schema = f"conv_id long, turn long, role string, parts {chat_format.PARTS}"
    r = chat_format.format_chats(spark.createDataFrame(rows, schema)).first()
    assert r["formatted"] == (
        "<|turn|>user<|text|>see <|image|> <\\/s><|audio|><|document|>?<|image|><|end|><|turn|>assistant<|text|><|end|>")
    assert [(a["kind"], a["ref"], a["place"], a["n_tokens"]) for a in r["attachments"]] == [
        ("image", "i1", 0, 4), ("audio", "a1", 1, 38), ("document", "d1", 2, 1024), ("image", None, 3, 1)]


def test_chats_stay_in_the_jvm(spark, sf_dir):
    plan = queries.op9_chat_format(spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_extra_conversation(spark, sf_dir):
    r = queries.op9_chat_format(spark, sf_dir).where("conv_id = -7").first()
    said = "</s>[INST] ok [/INST]"
    assert (r["n_turns"], r["loss_chars"]) == (2, len(said))
    assert r["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert r["turns_sha256"] == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
