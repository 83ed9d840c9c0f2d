"""Column functions against Python's own string and pattern semantics on random text."""

import random
import re

from pyspark.sql import functions as F

from turnloom import fixed
from turnloom.functions import text

CHARS = list("aZ.'-:() ,!?#_19") + [chr(c) for c in (
    0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0xA0, 0x1680, 0x2003, 0x200B, 0x2028, 0x2029,
    0x202F, 0x205F, 0x3000, 0x2019, 0x201C, 0x2026, 0x2014, 0xE9, 0xC9, 0x17F, 0x212A, 0x130, 0x131, 0xDF,
    0x300, 0x4E00, 0x1F600, 0x661)]
PIECES = [*fixed.POINTING_PHRASES, "Scene", "scene :", "Written by", "Series 2 Episode", "Penny", "Mrs Cooper", "Yes",
          "thank you", "ok", "(off)", "()", "tho" + chr(0x17F) + "e", "li" + chr(0x212A) + "e that"]


def samples():
    rng = random.Random(11)
    for _ in range(6000):
        parts = rng.choices(CHARS, k=rng.randrange(0, 9)) + rng.choices(PIECES, k=rng.randrange(0, 3))
        rng.shuffle(parts)
        yield "".join(parts)
    for piece in PIECES:
        for edge in CHARS:
            yield from (edge + piece, piece + edge, piece + edge + "x", piece + ":" + edge + "said it")


def python_pattern(java):
    flags = re.I if "(?i" in java else 0
    return re.compile(re.sub(r"^\(\?[a-zA-Z]+\)", "", java).replace(fixed.SPACE, r"\s"), flags)


def normalized(s):
    s = s.translate(str.maketrans(fixed.PUNCT_FROM, fixed.PUNCT_TO)).replace(*fixed.ELLIPSIS)
    return " ".join(s.split())


def test_random_texts(spark):
    rows = sorted(set(samples()))
    clean, normal = F.col("clean"), F.col("normal")
    frame = spark.createDataFrame([(s,) for s in rows], "s string").select(
        "s", text.clean(F.col("s")).alias("clean"), text.normalize(F.col("s")).alias("normal"),
        text.strip(F.col("s")).alias("strip"), text.word_count(F.col("s")).alias("words"),
        text.leaked_speaker(F.col("s")).alias("leaked"),
    ).select(
        "*", text.words_of_clean(clean).alias("clean_words"), text.is_junk(clean).alias("junk"),
        text.points_at_picture(clean).alias("points"), normal.rlike(fixed.SCENE_PATTERN).alias("scene"),
        normal.rlike(fixed.CREDITS_PATTERN).alias("credit"), normal.rlike(fixed.TITLE_PATTERN).alias("title"),
        F.regexp_extract(normal, fixed.SPEAKER_LINE_PATTERN, 1).alias("speaker"),
        F.regexp_extract(normal, fixed.SPEAKER_LINE_PATTERN, 2).alias("said"))
    scene, credit, title, line, prefix, junk = map(python_pattern, (
        fixed.SCENE_PATTERN, fixed.CREDITS_PATTERN, fixed.TITLE_PATTERN, fixed.SPEAKER_LINE_PATTERN,
        fixed.SPEAKER_PREFIX_PATTERN, fixed.JUNK_PATTERN))
    points = re.compile(rf"\b(?:{'|'.join(fixed.POINTING_PHRASES)})\b", re.I)
    seen = {"leaked": 0, "junk": 0, "points": 0, "scene": 0, "credit": 0, "title": 0, "speaker": 0}
    got = frame.collect()
    assert len(got) == len(rows)
    for r in got:
        s = r["s"]
        folded, plain = " ".join(s.split()), normalized(s)
        opening, named = line.match(plain), prefix.match(s)
        want = {
            "clean": folded, "normal": plain, "strip": s.strip(), "words": len(s.split()), "clean_words": len(s.split()),
            "leaked": bool(named and named.group(1).strip().lower() in fixed.CAST),
            "junk": bool(junk.match(folded)), "points": bool(points.search(folded)), "scene": bool(scene.match(plain)),
            "credit": bool(credit.match(plain)), "title": bool(title.match(plain)),
            "speaker": opening.group(1) if opening else "", "said": opening.group(2) if opening else "",
        }
        assert {k: r[k] for k in want} == want, repr(s)
        for name in seen:
            seen[name] += bool(want[name])
    assert min(seen.values()) > 0, seen
