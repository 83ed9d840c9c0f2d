"""Episode links and dialogue lines out of parsed pages."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom import fixed
from turnloom.functions import text
from turnloom.operators.ordered import first_per_key
from turnloom.operators.validate import require_empty


def episode_links(anchors: DataFrame, order: Sequence[str], limit: int = 0) -> DataFrame:
    """First anchor of every canonical URL whose text names an episode, in page order.

    A positive ``limit`` keeps the first links, a negative one drops that many
    from the end, 0 keeps all.
    """
    named = anchors.select(
        *order, text.normalize(F.col("text")).alias("title"),
        text.canonical_url(F.col("href")).alias("url"),
    ).filter(F.col("title").rlike(fixed.TITLE_PATTERN))
    links = first_per_key(named, F.col("url"), order)
    if limit > 0:
        return links.orderBy(*order).limit(limit)
    if limit < 0:
        dropped = links.orderBy(*[F.desc(c) for c in order]).limit(-limit)
        return links.join(dropped.select("url"), "url", "left_anti")
    return links


def first_per_url(pages: DataFrame, url: str, order: Sequence[str]) -> DataFrame:
    """First row of every canonical URL."""
    canonical = text.canonical_url(F.col(url))
    return first_per_key(pages.withColumn("canonical_url", canonical), F.col("canonical_url"), order)


def read_paragraphs(paragraphs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Judge every paragraph by itself: ``is_header, speaker, text``.

    Rows that are neither a scene header nor dialogue are gone before anything
    is shuffled. Headers are told by the text with its italics, speakers by the
    text without them.
    """
    texts = paragraphs.select(
        *keys, "place",
        text.normalize(F.col("full_text")).alias("full"),
        text.normalize(F.col("plain_text")).alias("plain"),
    )
    judged = _judgement(F.col("full"), F.col("plain"))
    # As a generated row, so that the filter below reads results instead of repeating the patterns.
    split = texts.select(*keys, "place", F.inline(F.array(judged)))
    spoken = ~F.col("is_credit") & (F.col("speaker") != "") & (F.col("text") != "")
    return split.filter(F.col("is_header") | spoken).drop("is_credit")


def _judgement(full: Column, plain: Column) -> Column:
    return F.struct(
        full.rlike(fixed.SCENE_PATTERN).alias("is_header"),
        full.rlike(fixed.CREDITS_PATTERN).alias("is_credit"),
        F.trim(F.regexp_extract(plain, fixed.SPEAKER_LINE_PATTERN, 1)).alias("speaker"),
        F.trim(F.regexp_replace(
            F.regexp_extract(plain, fixed.SPEAKER_LINE_PATTERN, 2), fixed.EMPTY_PARENS_PATTERN, "",
        )).alias("text"),
    )


def page_dialogue(pages: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, line, speaker, text, scene`` of ``keys, paragraphs`` rows, one row per page.

    A page numbers its own scenes and lines with array functions, so nothing is shuffled.
    """
    texts = F.transform("paragraphs", lambda p: F.struct(
        text.normalize(p.full_text).alias("full"), text.normalize(p.plain_text).alias("plain")))
    judged = F.transform(texts, lambda p: _judgement(p.full, p.plain))
    kept = F.filter(judged, lambda j: j.is_header | (~j.is_credit & (j.speaker != "") & (j.text != "")))
    # As a generated row, so that the arrays below read results instead of repeating the patterns.
    numbered = pages.select(*keys, F.inline(F.array(F.struct(kept.alias("_judged")))))
    cut = explode_scenes(numbered, keys, F.col("_judged"), lambda j: j.is_header)
    # every scene but the opening one has a header before its lines
    return cut.select(
        *keys, (F.col("line") - F.col("scene")).alias("line"), "text.speaker", "text.text", "scene")


def dialogue_lines(judged: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Number scenes and lines: ``keys, line, speaker, text, scene``.

    The windows run within one page, which is one input row, so their groups
    are as small as a page.
    """
    page = Window.partitionBy(*keys).orderBy("place")
    return (
        judged.withColumn("scene", F.sum(F.col("is_header").cast("int")).over(page).cast("int"))
        .filter(~F.col("is_header"))
        .withColumn("line", F.row_number().over(page) - 1)
        .select(*keys, "line", "speaker", "text", "scene")
    )


def pages_without_dialogue(pages: DataFrame, lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    return pages.select(*keys).join(lines.filter("line = 0").select(*keys), list(keys), "left_anti")


def require_complete(pages: DataFrame, lines: DataFrame, keys: Sequence[str]) -> None:
    """Refuse the whole run when there is no page, or any page without dialogue."""
    if pages.isEmpty():
        raise ValueError(fixed.ERROR_NO_LINKS)
    require_empty(pages_without_dialogue(pages, lines, keys), fixed.ERROR_NO_DIALOGUE)


def explode_scenes(
    rows: DataFrame, keys: Sequence[str], lines: Column, is_header: Callable[[Column], Column],
) -> DataFrame:
    """``keys, scene, line, text`` of texts already held as arrays of lines.

    Each array is cut at its headers and the pieces are exploded, so scene
    numbers need neither a window nor a shuffle. Headers themselves are dropped.
    """
    cut = rows.select(*keys, lines.alias("_lines")).withColumn("_heads", F.filter(
        F.transform("_lines", lambda l, i: F.when(is_header(l), i)), lambda i: i.isNotNull()))
    starts = F.concat(F.array(F.lit(0)), F.col("_heads"))
    ends = F.concat(F.col("_heads"), F.array(F.size("_lines")))
    pieces = F.transform(
        F.arrays_zip(starts.alias("start"), ends.alias("end")),
        lambda p, k: F.struct(
            k.alias("scene"), p.start.alias("_start"),
            F.slice("_lines", p.start + 1, p.end - p.start).alias("_part")))
    return (
        cut.select(*keys, F.inline(pieces))
        .select(*keys, "scene", "_start", F.posexplode("_part").alias("_at", "text"))
        .filter("scene = 0 OR _at > 0")  # later pieces open with their header
        .select(*keys, "scene", (F.col("_start") + F.col("_at")).alias("line"), "text")
    )
