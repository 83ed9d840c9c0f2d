import pytest
from pyspark.sql import functions as F

from turnloom.functions import arrays, text

NBSP, NEL, EM_SPACE = chr(0xA0), chr(0x85), chr(0x2003)
LONG_S, E_ACUTE = chr(0x17F), chr(0xE9)


def value(spark, column, **inputs):
    row = {k: v for k, v in inputs.items()}
    frame = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {_kind(v)}" for k, v in row.items()))
    return frame.select(column.alias("v")).first()["v"]


def _kind(v):
    if isinstance(v, list):
        return f"array<{_kind(v[0])}>"
    return {str: "string", int: "int", float: "double", bool: "boolean"}[type(v)]


@pytest.mark.parametrize("raw", [
    f"a{NBSP}b", f"a{NEL}b", f" a\t{EM_SPACE}b ", "a\x1cb", "a\x1fb\n", "a b",
])
def test_clean_folds_every_python_space(spark, raw):
    assert value(spark, text.clean(F.col("s")), s=raw) == " ".join(raw.split()) == "a b"


@pytest.mark.parametrize("raw", ["", " \n", f"{NBSP}a  b\x1f\n", "a", "\ta \n b"])
def test_strip_keeps_the_inside(spark, raw):
    assert value(spark, text.strip(F.col("s")), s=raw) == raw.strip()


@pytest.mark.parametrize("raw", ["", "   ", "  x y ", f"x{NBSP}y\x1dz", "\tone"])
def test_word_count(spark, raw):
    assert value(spark, text.word_count(F.col("s")), s=raw) == len(raw.split())
    assert value(spark, text.words_of_clean(text.clean(F.col("s"))), s=raw) == len(raw.split())


def test_normalize(spark):
    raw = chr(0x201C) + "Wait" + chr(0x2026) + chr(0x201D) + f"{NBSP}it" + chr(0x2019) + "s " + chr(0x2013) + chr(0x2014)
    assert value(spark, text.normalize(F.col("s")), s=raw) == '"Wait..." it\'s --'


@pytest.mark.parametrize("raw, junk", [
    ("Yes.", True), ("THANK YOU!", True), ("what?", True), ("what??", True), ("yes sir", False),
    (LONG_S + "ure", True), ("bye-bye", True), ("", False),
])
def test_junk(spark, raw, junk):
    assert value(spark, text.is_junk(F.col("s")), s=raw) is junk


@pytest.mark.parametrize("raw, points", [
    ("put These away", True), ("look over there", True), ("theses on it", False),
    (E_ACUTE + "these", False), ("these" + E_ACUTE, False), ("(those)", True), ("this_one", False),
])
def test_pointing_phrases_respect_letters_outside_ascii(spark, raw, points):
    assert value(spark, text.points_at_picture(F.col("s")), s=raw) is points


@pytest.mark.parametrize("raw, leaked", [
    ("Penny: hello", True), ("Sheldon (off): hi", True), ("Magnets: hello", False),
    ("Mrs. Cooper: hi", False), ("Mrs Cooper : hi", True), ("Penny:hello", False), (f"Penny:{NBSP}x", True),
    ("penny: hello", False),
])
def test_leaked_speaker(spark, raw, leaked):
    assert value(spark, text.leaked_speaker(F.col("s")), s=raw) is leaked


@pytest.mark.parametrize("url", ["http://x/a/#t", "http://x/a", "http://x/a///"])
def test_canonical_url(spark, url):
    assert value(spark, text.canonical_url(F.col("s")), s=url) == "http://x/a/"


@pytest.mark.parametrize("tokens, cap, kept, hit", [
    ([5, 7, 2, 9], 4, 2, False), ([5, 7], 2, 2, True), ([2, 5], 2, 0, False), ([5, 7], 3, 2, False),
])
def test_stop_tokens(spark, tokens, cap, kept, hit):
    assert value(spark, arrays.stop_position(F.col("t"), (2, 3)), t=tokens) == kept
    assert value(spark, arrays.hit_token_limit(F.col("t"), (2, 3), cap), t=tokens) is hit
    assert value(spark, arrays.cut_at_stop(F.col("t"), (2, 3)), t=tokens) == tokens[:kept]


def test_argmax_takes_the_first_tie_and_letters(spark):
    assert value(spark, arrays.letter(arrays.argmax(F.col("p"))), p=[0.1, 0.4, 0.4, 0.1]) == "B"


def test_softmax_survives_large_logits(spark):
    p = value(spark, arrays.softmax(F.col("p")), p=[1000.0, 1000.0, 0.0])
    assert p == pytest.approx([0.5, 0.5, 0.0])
    assert value(spark, arrays.log_sum_exp(F.col("p")), p=[1000.0, 1000.0]) == pytest.approx(1000.693147)


def test_finite_logits(spark):
    assert value(spark, arrays.all_finite(F.col("p")), p=[1.0, 2.0]) is True
    for bad in (float("nan"), float("inf"), float("-inf")):
        assert value(spark, arrays.all_finite(F.col("p")), p=[1.0, bad]) is False


def test_starts_with_and_slices(spark):
    assert value(spark, arrays.starts_with(F.col("a"), F.col("b")), a=[1, 2, 3], b=[1, 2]) is True
    assert value(spark, arrays.starts_with(F.col("a"), F.col("b")), a=[1], b=[1, 2]) is False
    assert value(spark, arrays.all_but_last(F.col("a")), a=[1, 2, 3]) == [1, 2]
    assert value(spark, arrays.last(F.col("a")), a=[1, 2, 3]) == 3
