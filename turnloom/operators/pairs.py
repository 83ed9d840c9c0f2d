"""Context-and-reply pairs from ordered dialogue lines.

A line frame has ``episode_id, title, line, speaker, text, scene``; ``line`` is
the dense zero-based position within the episode and ``(episode_id, line)`` is
the source order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom import fixed
from turnloom.functions import arrays, text
from turnloom.functions.hashing import text_key
from turnloom.operators.ordered import first_per_key, keep_trailing, look_back, trailing_matches

LINE_COLUMNS = ("episode_id", "title", "line", "speaker", "text", "scene")
MESSAGES_TYPE = "array<struct<role:string,content:string>>"


@dataclass(frozen=True)
class PairRules:
    target: str = fixed.TARGET_SPEAKER
    context_turns: int = fixed.CONTEXT_TURNS
    min_target_words: int = fixed.MIN_TARGET_WORDS
    min_prompt_words: int = fixed.MIN_PROMPT_WORDS
    max_target_words: int = fixed.MAX_TARGET_WORDS

    @property
    def follows_target(self) -> str:
        """Drop reason for a target line right after another target line."""
        return f"prev_is_{self.target}"


def explode_lines(episodes: DataFrame) -> DataFrame:
    """Line frame of nested episodes that carry an ``episode_id``."""
    return episodes.select(
        "episode_id", "title", F.posexplode("lines").alias("line", "_line")
    ).select("episode_id", "title", "line", "_line.speaker", "_line.text", "_line.scene")


# --- context ---

def attach_context(lines: DataFrame, rules: PairRules) -> DataFrame:
    """Clean every line once and look back over the preceding ones.

    The look-back keeps flags and texts in separate arrays so that reports
    which need no text shuffle none.
    """
    cleaned = lines.select(
        "episode_id", "title", "line",
        F.coalesce(F.col("scene"), F.lit(0)).alias("scene"),
        F.coalesce(F.lower("speaker") == rules.target, F.lit(False)).alias("is_target"),
        text.clean(F.coalesce(F.col("text"), F.lit(""))).alias("text"),
    ).withColumn("words", text.words_of_clean(F.col("text")))
    return look_back(
        judge_replies(cleaned, rules), ["episode_id"], "line",
        {"context_flags": F.struct("is_target", "words", "scene"), "context_text": F.col("text")},
        rules.context_turns,
    )


def attach_context_nested(episodes: DataFrame, rules: PairRules) -> DataFrame:
    """The same for nested episodes, where the lines already lie together: no shuffle."""
    n = max(rules.context_turns, 0)
    cleaned = F.transform("lines", lambda l: F.struct(
        F.coalesce(F.lower(l.speaker) == rules.target, F.lit(False)).alias("is_target"),
        text.clean(F.coalesce(l.text, F.lit(""))).alias("text"),
        F.coalesce(l.scene, F.lit(0)).alias("scene"),
    ))
    counted = F.transform("_lines", lambda l: F.struct(
        l.is_target.alias("is_target"), l.text.alias("text"), l.scene.alias("scene"),
        text.words_of_clean(l.text).alias("words"),
    ))
    windowed = F.transform("_lines", lambda l, i: F.struct(
        l.alias("own"),
        F.slice("_lines", F.greatest(i - n, F.lit(0)) + 1, F.least(i, F.lit(n))).alias("context"),
    ))
    exploded = (
        episodes.withColumn("_lines", cleaned)
        .withColumn("_lines", counted)
        .select("episode_id", "title", F.posexplode(windowed).alias("line", "_row"))
        .select("episode_id", "title", "line", "_row.own.*", "_row.context")
    )
    return (
        judge_replies(exploded, rules)
        .withColumns({
            "context_flags": F.transform("context", lambda c: F.struct(
                c.is_target.alias("is_target"), c.words.alias("words"), c.scene.alias("scene"))),
            "context_text": F.transform("context", lambda c: c.text),
        })
        .drop("context")
    )


# --- rejection ---

def judge_replies(lines: DataFrame, rules: PairRules) -> DataFrame:
    """Add the reply's own drop reason, and the duplicate key of replies without one."""
    usable = F.col("is_target") & F.col("rejected").isNull()
    return lines.withColumn(
        "rejected", F.when(F.col("is_target"), reject_target(rules))
    ).withColumn("reply_key", F.when(usable, text_key(F.col("text"))))


def reject_target(rules: PairRules) -> Column:
    """First reason the reply itself is unusable; null to go on."""
    words, reply = F.col("words"), F.col("text")
    return (
        F.when(words < rules.min_target_words, fixed.TOO_SHORT)
        .when(words > rules.max_target_words, fixed.TOO_LONG)
        .when(text.is_junk(reply), fixed.JUNK)
        .when(text.points_at_picture(reply), fixed.NEEDS_VISUAL)
    )


def candidates(with_context: DataFrame, rules: PairRules) -> DataFrame:
    """Every line of the target speaker with its context and drop ``reason`` (null = keep)."""
    in_scene = trailing_matches(F.transform("context_flags", lambda c: c.scene), F.col("scene"))
    user_words = F.aggregate(
        F.filter("context_flags", lambda c: ~c.is_target), F.lit(0), lambda acc, c: acc + c.words)
    return (
        with_context.filter("is_target")
        .withColumn("_depth", in_scene)
        .withColumns({
            "context_flags": keep_trailing(F.col("context_flags"), F.col("_depth")),
            "context_text": keep_trailing(F.col("context_text"), F.col("_depth")),
        })
        .withColumn(
            "reason",
            F.when(F.col("rejected").isNotNull(), F.col("rejected"))
            .when(F.col("_depth") == 0, fixed.NO_CONTEXT)
            .when(arrays.last(F.col("context_flags")).is_target, rules.follows_target)
            .when(user_words < rules.min_prompt_words, fixed.PROMPT_TOO_SHORT),
        )
        .drop("_depth", "rejected", "is_target")
    )


def merge_turns(flags: Column, texts: Column) -> Column:
    """Messages of a context: same-role neighbours joined, leading replies dropped."""
    turns = F.zip_with(flags, texts, lambda f, t: F.struct(
        text.role_of(f.is_target).alias("role"), t.alias("content")))

    def add(done: Column, turn: Column) -> Column:
        newest = arrays.last(done)
        joined = F.struct(
            newest.role.alias("role"), F.concat_ws(" ", newest.content, turn.content).alias("content"))
        return (
            F.when((F.size(done) == 0) & (turn.role != "user"), done)
            .when(F.coalesce(newest.role == turn.role, F.lit(False)),
                  F.concat(arrays.all_but_last(done), F.array(joined)))
            .otherwise(F.concat(done, F.array(turn)))
        )

    return F.aggregate(turns, F.array().cast(MESSAGES_TYPE), add)


def build_pairs(judged: DataFrame) -> DataFrame:
    """Kept candidates as ``episode_id, line, episode, scene, target_words, prompt, target``."""
    return judged.filter(F.col("reason").isNull()).select(
        "episode_id", "line", F.col("title").alias("episode"), "scene",
        F.col("words").alias("target_words"),
        merge_turns(F.col("context_flags"), F.col("context_text")).alias("prompt"),
        F.col("text").alias("target"), "reply_key",
    )


def drop_duplicates(pairs: DataFrame) -> DataFrame:
    """Keep the first pair of every reply text, ignoring case."""
    return first_per_key(pairs, F.col("reply_key"), ["episode_id", "line"]).drop("reply_key")


def pairs_from_lines(lines: DataFrame, rules: PairRules = PairRules()) -> DataFrame:
    return drop_duplicates(build_pairs(candidates(attach_context(lines, rules), rules)))


def pairs_from_episodes(episodes: DataFrame, rules: PairRules = PairRules()) -> DataFrame:
    return drop_duplicates(build_pairs(candidates(attach_context_nested(episodes, rules), rules)))


def pair_messages() -> Column:
    reply = F.struct(F.lit("assistant").alias("role"), F.col("target").alias("content"))
    return F.concat(F.col("prompt"), F.array(reply))


def pair_documents(pairs: DataFrame) -> DataFrame:
    """Nested ``messages`` and ``meta`` next to the source order and any split column."""
    meta = F.struct("episode", "scene", "target_words")
    keep = [c for c in ("episode_id", "line", "split") if c in pairs.columns]
    return pairs.select(*keep, pair_messages().alias("messages"), meta.alias("meta"))


# --- reports ---

def drop_reasons(judged: DataFrame) -> DataFrame:
    """Rows per outcome in one aggregation, duplicates included."""
    outcome = F.coalesce(F.col("reason"), F.lit("kept"))
    grouped = judged.groupBy(outcome.alias("reason")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct(F.when(F.col("reason").isNull(), F.col("reply_key"))).alias("unique"),
    )
    kept = F.col("reason") == "kept"
    parts = F.when(kept, F.array(
        F.struct(F.lit("kept").alias("reason"), F.col("unique").alias("rows")),
        F.struct(F.lit(fixed.DUPLICATE).alias("reason"), (F.col("rows") - F.col("unique")).alias("rows")),
    )).otherwise(F.array(F.struct("reason", "rows")))
    return grouped.select(F.inline(parts)).filter("rows > 0").orderBy(F.desc("rows"), "reason")
