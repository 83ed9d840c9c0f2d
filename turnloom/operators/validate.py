"""Row rules, cross-split rules and training-row rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom import fixed
from turnloom.functions import arrays, text
from turnloom.functions.hashing import text_key

TOO_FEW = "too_few_messages"
LAST_ROLE = "last_role"
EMPTY = "empty_message"
LEAK = "speaker_leak"
ORDER = "role_order"

_ERROR = "array<struct<position:int,rule:string,detail:string>>"


#: Rules in the order in which one row's errors are told.
RULES = (TOO_FEW, LAST_ROLE, EMPTY, LEAK, ORDER)


def rule_place(rule: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, RULES)), rule)


def guard(rows: DataFrame, ok: Column, message: Column | str) -> DataFrame:
    """Pass rows through; the first row that breaks ``ok`` fails the job."""
    text_of = F.lit(message) if isinstance(message, str) else message
    checked = F.when(F.coalesce(ok, F.lit(False)), True).otherwise(
        F.raise_error(text_of).cast("boolean"))
    return rows.filter(checked)


def require_rows(rows: DataFrame, message: str) -> DataFrame:
    """Refuse an empty frame before any other check runs."""
    if rows.isEmpty():
        raise ValueError(message)
    return rows


def require_empty(problems: DataFrame, message: str) -> None:
    """Refuse to go on while ``problems`` has rows; shows a few of them."""
    found = problems.limit(3).collect()
    if found:
        raise ValueError(f"{message}: {[row.asDict() for row in found]}")


def expected_role(position: Column) -> Column:
    return F.when(position % 2 == 0, "user").otherwise("assistant")


def _shown(role: Column) -> Column:
    return F.coalesce(role, F.lit("None"))


def _error(rule: str, position: Column, template: str, *values: Column) -> Column:
    return F.struct(
        position.cast("int").alias("position"), F.lit(rule).alias("rule"),
        F.format_string(template, *values).alias("detail"))


def _message_errors(position: Column, role: Column, content: Column, cast: Sequence[str]) -> Column:
    """Array of the three per-message rules' errors."""
    wanted = expected_role(position)
    return F.array_compact(F.array(
        F.when(text.is_blank(content), _error(EMPTY, position, fixed.ERROR_EMPTY, position)),
        F.when(text.leaked_speaker(content, cast), _error(LEAK, position, fixed.ERROR_LEAK, position)),
        F.when(~role.eqNullSafe(wanted),
               _error(ORDER, position, fixed.ERROR_ORDER, position, _shown(role), wanted)),
    ))


def _too_few(count: Column) -> Column:
    return _error(TOO_FEW, F.lit(-1), fixed.ERROR_TOO_FEW, count)


def _wrong_end(role: Column) -> Column:
    return _error(LAST_ROLE, F.lit(-1), fixed.ERROR_LAST_ROLE, _shown(role))


def row_errors(
    rows: DataFrame, keys: Sequence[str], messages: str = "messages",
    cast: Sequence[str] = fixed.CAST,
) -> DataFrame:
    """Long error frame ``keys, position, rule, detail`` of nested chats.

    Each row judges itself: only errors are exploded and nothing is shuffled.
    A row with fewer than two messages gets that error alone.
    """
    chat = F.col(messages)
    count = F.coalesce(F.size(chat), F.lit(0))
    count = F.when(count < 0, 0).otherwise(count)
    ending = arrays.last(chat).role
    found = F.when(count < 2, F.array(_too_few(count)).cast(_ERROR)).otherwise(F.concat(
        F.when(~ending.eqNullSafe(F.lit("assistant")), F.array(_wrong_end(ending)).cast(_ERROR))
        .otherwise(F.array().cast(_ERROR)),
        F.flatten(F.transform(
            chat, lambda m, j: _message_errors(j, m.role, m.content, cast).cast(_ERROR))),
    ))
    return rows.select(*keys, F.inline(found))


def turn_errors(
    turns: DataFrame, key: str, position: str = "turn", role: str = "role", content: str = "text",
    cast: Sequence[str] = fixed.CAST,
) -> DataFrame:
    """The same rules over one row per message, without collecting a chat into a row.

    Message rules are row-local. Chat rules need one aggregate per chat, which
    combines on the map side. Only an opening message must ask whether its chat
    is too short, so the position is part of the join key and a long chat's
    errors stay spread.
    """
    local = turns.select(key, F.inline(
        _message_errors(F.col(position), F.col(role), F.col(content), cast).cast(_ERROR)))
    chats = turns.groupBy(key).agg(
        F.count(F.lit(1)).alias("_count"), F.max_by(role, position).alias("_ending"),
        F.min(position).cast("int").alias("position"))
    short = chats.filter(F.col("_count") < 2).select(key, "position")
    chat_level = chats.select(key, F.inline(
        F.when(F.col("_count") < 2, F.array(_too_few(F.col("_count"))))
        .when(~F.col("_ending").eqNullSafe(F.lit("assistant")), F.array(_wrong_end(F.col("_ending"))))
        .otherwise(F.array().cast(_ERROR))))
    return chat_level.unionByName(local.join(short, [key, "position"], "left_anti"))


def error_report(
    errors: DataFrame, order: Sequence[str], shown: int = fixed.ERROR_REPORT_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """The first errors in order, and the number left out."""
    first = errors.orderBy(*order).limit(shown)
    total = errors.agg(F.count(F.lit(1)).alias("errors"))
    return first, total.withColumn("not_shown", F.greatest(F.col("errors") - shown, F.lit(0)))


# --- cross-split rules ---

def shared_episodes(rows: DataFrame, episode: str = "episode", split: str = "split") -> DataFrame:
    """Episodes present in both splits, from one map-side combined aggregate."""
    return _sides(rows, F.col(episode).alias("episode"), split).filter(
        (F.col("in_train") > 0) & (F.col("in_heldout") > 0)).select("episode")


def _sides(rows: DataFrame, key: Column, split: str) -> DataFrame:
    return rows.groupBy(key).agg(
        F.count_if(F.col(split) == "train").alias("in_train"),
        F.count_if(F.col(split) == "heldout").alias("in_heldout"),
    )


def isolation_report(
    rows: DataFrame, episode: str = "episode", target: str = "target", split: str = "split",
) -> DataFrame:
    """``check, rows``: episodes per split, shared episodes, held-out replies seen in train."""
    # both kinds of keys in one aggregate: rows are read and shuffled once
    keys = F.array(
        F.struct(F.lit("episode").alias("kind"), F.col(episode).cast("string").cast("binary").alias("_key")),
        F.struct(F.lit("target").alias("kind"), text_key(F.col(target)).alias("_key")))
    sides = rows.select(split, F.inline(keys)).groupBy("kind", "_key").agg(
        F.count_if(F.col(split) == "train").alias("in_train"),
        F.count_if(F.col(split) == "heldout").alias("in_heldout"))
    train, heldout, is_episode = F.col("in_train") > 0, F.col("in_heldout") > 0, F.col("kind") == "episode"
    return sides.agg(
        F.count_if(is_episode & train).alias("train_episodes"),
        F.count_if(is_episode & heldout).alias("heldout_episodes"),
        F.count_if(is_episode & train & heldout).alias("shared_episodes"),
        F.coalesce(F.sum(F.when(~is_episode & train, F.col("in_heldout"))), F.lit(0)).alias("leaked_targets"),
    ).unpivot([], ["train_episodes", "heldout_episodes", "shared_episodes", "leaked_targets"], "check", "rows")


def isolation_errors(report: DataFrame, first_shared: DataFrame) -> DataFrame:
    """Error lines of the two isolation rules. ``first_shared``: at most three episodes."""
    names = first_shared.agg(F.concat_ws(", ", F.array_sort(F.collect_list("episode")))).scalar()
    return report.filter(F.col("check").isin("shared_episodes", "leaked_targets") & (F.col("rows") > 0)).select(
        F.when(F.col("check") == "shared_episodes", F.format_string(fixed.ERROR_SHARED, "rows", names))
        .otherwise(F.format_string(fixed.ERROR_LEAKED, "rows")).alias("detail"))


# --- training rows ---

def chat_is_trainable(messages: Column) -> Column:
    """Even number of messages, at least two, strictly alternating, none blank."""
    return (F.size(messages) >= 2) & (F.size(messages) % 2 == 0) & F.forall(
        F.transform(messages, lambda m, j: m.role.eqNullSafe(expected_role(j)) & ~text.is_blank(m.content)),
        lambda ok: ok)


def require_trainable(rows: DataFrame, label: Column, messages: str = "messages") -> DataFrame:
    return guard(rows, chat_is_trainable(F.col(messages)),
                 F.format_string(fixed.ERROR_NOT_TRAINABLE, label.cast("string")))


def require_evaluable(
    rows: DataFrame, label: Column, messages: str = "messages", episode: str = "meta.episode",
) -> DataFrame:
    """The evaluation input rule: a trainable chat with a non-empty episode."""
    ok = chat_is_trainable(F.col(messages)) & (F.length(F.col(episode)) > 0)
    return guard(rows, ok, F.format_string(fixed.ERROR_NOT_EVALUABLE, label.cast("string")))


def prompt_completion(rows: DataFrame, keys: Sequence[str], messages: str = "messages") -> DataFrame:
    chat = F.col(messages)
    return rows.select(
        *keys, arrays.all_but_last(chat).alias("prompt"),
        F.array(arrays.last(chat)).alias("completion"))


def token_error(
    prompt_ids: Column, full_ids: Column, end_token: int, max_tokens: int = fixed.MAX_TOKENS,
) -> Column:
    """First token rule a row breaks, or null."""
    completion = arrays.tail_after(full_ids, F.size(prompt_ids))
    return (
        F.when(~arrays.starts_with(full_ids, prompt_ids), "prompt_not_a_prefix")
        .when(F.size(full_ids) > max_tokens, "too_many_tokens")
        .when((F.size(completion) == 0) | ~F.array_contains(completion, end_token), "no_end_token")
    )


def masked_labels(full_ids: Column, prompt_length: Column) -> Column:
    """Labels that train on the completion only."""
    mask = F.array_repeat(F.lit(fixed.MASKED_LABEL), prompt_length)
    return F.concat(mask, arrays.tail_after(full_ids, prompt_length))


def mask_is_right(labels: Column, full_ids: Column, prompt_length: Column) -> Column:
    head = F.slice(labels, F.lit(1), prompt_length)
    return (
        (F.size(head) == prompt_length)
        & F.forall(head, lambda x: x == fixed.MASKED_LABEL)
        & (arrays.tail_after(labels, prompt_length) == arrays.tail_after(full_ids, prompt_length))
    )
