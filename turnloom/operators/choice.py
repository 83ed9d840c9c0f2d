"""Paired multiple-choice evaluation.

An item frame has ``subject, split, idx, question, choices, answer`` with split
``dev`` or ``test``; a manifest frame has ``subject, split, place, idx`` and
lists the selected items in order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom import fixed
from turnloom.functions import arrays
from turnloom.functions.hashing import sha256
from turnloom.operators.validate import guard

DEV, TEST = "dev", "test"


def explode_items(data: DataFrame) -> DataFrame:
    """Item frame of a nested choice-data document."""
    subject = data.select(F.explode("subjects").alias("s"))

    def side(split: str) -> DataFrame:
        return subject.select(
            F.col("s.subject").alias("subject"), F.lit(split).alias("split"),
            F.posexplode(f"s.{split}").alias("idx", "q")
        ).select("subject", "split", "idx", "q.question", "q.choices", "q.answer")

    return side(DEV).unionByName(side(TEST))


def explode_manifest(manifest: DataFrame) -> DataFrame:
    """Manifest frame of a nested manifest document."""
    subject = manifest.select(F.explode("subjects").alias("subject", "s"))

    def side(split: str) -> DataFrame:
        return subject.select(
            "subject", F.lit(split).alias("split"),
            F.posexplode(f"s.{split}_indices").alias("place", "idx"))

    return side(DEV).unionByName(side(TEST))


def freeze_manifest(items: DataFrame, shots: int = fixed.SHOTS) -> DataFrame:
    """Select the first ``shots`` dev items and every test item."""
    return items.filter((F.col("split") == TEST) | (F.col("idx") < shots)).select(
        "subject", "split", F.col("idx").alias("place"), "idx")


def manifest_summary(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("subject", "split").agg(
        F.count(F.lit(1)).alias("items"), F.min("idx").alias("first"), F.max("idx").alias("last"))


def check_manifest(
    manifest: DataFrame, subjects: Sequence[str] = fixed.SUBJECTS, shots: int = fixed.SHOTS,
) -> None:
    """Exactly the expected subjects, each with ``shots`` demonstrations."""
    found = manifest.filter(F.col("split") == DEV).groupBy("subject").agg(
        F.count(F.lit(1)).alias("demos")).limit(len(subjects) + 1).collect()
    if {r["subject"] for r in found} != set(subjects):
        raise ValueError(f"the manifest must list {sorted(subjects)} and nothing else")
    if any(r["demos"] != shots for r in found):
        raise ValueError(f"every subject needs {shots} demonstrations in the manifest")


def question_text(question: Column, choices: Column, answer: Column) -> Column:
    """Question and lettered choices, one per line."""
    listed = F.concat_ws("\n", F.transform(
        choices, lambda c, i: F.concat(arrays.letter(i), F.lit(". "), c)))
    ok = (F.size(choices) == 4) & answer.between(0, 3)
    return F.when(F.coalesce(ok, F.lit(False)), F.concat(question, F.lit("\n"), listed)).otherwise(
        F.raise_error(F.lit("a question needs four choices and an answer between 0 and 3")))


def select_items(items: DataFrame, manifest: DataFrame) -> DataFrame:
    """Items named by the manifest, with their place in its lists; one that is missing fails the job."""
    found = manifest.join(items.withColumn("_known", F.lit(True)), ["subject", "split", "idx"], "left")
    return guard(found, F.col("_known"), F.format_string(
        "the data lack %s item %s of %s", "split", F.col("idx").cast("string"), "subject")).drop("_known")


def demonstrations(items: DataFrame, manifest: DataFrame) -> DataFrame:
    """One row per subject: its demonstration messages and questions, in order.

    Every demonstration that the manifest lists is taken; :func:`check_manifest` says how many.
    """
    chosen = manifest.filter(F.col("split") == DEV)
    shown = F.array_sort(F.collect_list(F.struct(
        "place", "question",
        question_text(F.col("question"), F.col("choices"), F.col("answer")).alias("asked"),
        arrays.letter(F.col("answer")).alias("answered"))))
    return (
        select_items(items, chosen).groupBy("subject").agg(shown.alias("_shown"))
        .select(
            "subject",
            F.flatten(F.transform("_shown", lambda d: F.array(
                message(F.lit("user"), d.asked), message(F.lit("assistant"), d.answered)
            ))).alias("demo_messages"),
            F.transform("_shown", lambda d: d.question).alias("demo_questions"))
    )


def message(role: Column, content: Column) -> Column:
    return F.struct(role.alias("role"), content.alias("content"))


def few_shot_examples(
    items: DataFrame, manifest: DataFrame, subjects: Sequence[str] = fixed.SUBJECTS,
    shots: int = fixed.SHOTS, instruction: str = fixed.CHOICE_INSTRUCTION,
) -> DataFrame:
    """``subject, idx, place, messages, answer`` per selected test item.

    The manifest must name exactly ``subjects`` with ``shots`` demonstrations each, so these are a
    handful of rows: they are broadcast, and the test items stay where they are, however many of
    them one subject holds. An item or a subject that is missing fails the job.
    """
    check_manifest(manifest, subjects, shots)
    demos = demonstrations(items, manifest)
    tests = select_items(items, manifest.filter(F.col("split") == TEST))
    joined = guard(
        tests.join(F.broadcast(demos), "subject", "left"), F.col("demo_messages").isNotNull(),
        F.format_string("no demonstrations for subject %s", "subject"))
    checked = guard(
        joined, ~F.array_contains("demo_questions", F.col("question")),
        fixed.ERROR_OVERLAP)
    asked = question_text(F.col("question"), F.col("choices"), F.col("answer"))
    return checked.select(
        "subject", "idx", "place",
        F.concat(
            F.array(message(F.lit("system"), F.lit(instruction))),
            F.col("demo_messages"), F.array(message(F.lit("user"), asked)),
        ).alias("messages"),
        arrays.letter(F.col("answer")).alias("answer"))


def question_overlap(items: DataFrame) -> DataFrame:
    """Questions used both as a dev and as a test item, within or across subjects."""
    return items.groupBy(sha256(F.col("question")).alias("question_key")).agg(
        F.count_if(F.col("split") == DEV).alias("dev_items"),
        F.count_if(F.col("split") == TEST).alias("test_items"),
    ).filter((F.col("dev_items") > 0) & (F.col("test_items") > 0))


# --- predictions from logits ---

def letters_are_tokens(token_ids: Column) -> Column:
    """Every letter encodes to one token and no two share it."""
    return F.forall(token_ids, lambda t: F.size(t) == 1) & (
        F.size(F.array_distinct(F.flatten(token_ids))) == len(fixed.LETTERS))


def predict(
    rows: DataFrame, keys: Sequence[str], logits: str, letter_tokens: Sequence[int],
    vocabulary: DataFrame | None = None,
) -> DataFrame:
    """Letter probabilities, their share of all mass, and both arg-maxima.

    ``letter_tokens`` are zero-based vocabulary positions of A, B, C and D. With a ``vocabulary``
    of ``token, text`` the unconstrained arg-maximum is given as text, as prediction rows have it.
    """
    checked = guard(rows, arrays.all_finite(F.col(logits)), fixed.ERROR_LOGITS)
    letters = F.array(*[F.element_at(F.col(logits), t + 1) for t in letter_tokens])
    scored = checked.withColumn("_letters", letters).select(
        *keys,
        arrays.softmax(F.col("_letters")).alias("_p"),
        F.exp(arrays.log_sum_exp(F.col("_letters")) - arrays.log_sum_exp(F.col(logits)))
        .alias("answer_letter_probability_mass"),
        arrays.argmax(F.col(logits)).alias("unconstrained_top_token"))
    if vocabulary is not None:
        # as many rows as one model's logits have entries
        names = F.broadcast(vocabulary.select(
            F.col("token").alias("unconstrained_top_token"), F.col("text").alias("_text")))
        scored = scored.join(names, "unconstrained_top_token", "left").withColumn(
            "unconstrained_top_token", F.col("_text"))
    return scored.select(
        *keys, arrays.letter(arrays.argmax(F.col("_p"))).alias("prediction"),
        F.map_from_arrays(F.array(*[F.lit(x) for x in fixed.LETTERS]), F.col("_p"))
        .alias("choice_probabilities"),
        "answer_letter_probability_mass", "unconstrained_top_token")


# --- metrics ---

def mark_correct(rows: DataFrame, answer: Column, base: Column, sft: Column) -> DataFrame:
    """Add ``base_right``, ``sft_right`` and their ``difference`` in {-1, 0, 1}; null is not right."""
    def right(prediction: Column) -> Column:
        return F.coalesce(prediction == answer, F.lit(False)).cast("int")

    return rows.withColumns({"base_right": right(base), "sft_right": right(sft)}).withColumn("difference", F.col("sft_right") - F.col("base_right"))


def accuracy_by_subject(rows: DataFrame, subject: str = "subject", masses: bool = False) -> DataFrame:
    """Questions, correct counts and accuracies per subject and overall.

    Rows are summed per subject first, so the grouping sets expand one row per
    subject instead of every row. The overall row weighs every question the same.
    """
    mass_names = [f"{m}_mass" for m in fixed.MODELS] if masses else []
    summed = rows.groupBy(subject).agg(
        F.count(F.lit(1)).alias("questions"),
        F.sum("base_right").alias("base_correct"), F.sum("sft_right").alias("sft_correct"),
        F.count_if(F.col("difference") == -1).alias("base_correct_sft_wrong"),
        F.count_if(F.col("difference") == 1).alias("base_wrong_sft_correct"),
        *[F.sum(name).alias(name) for name in mass_names],
    )
    counts = ["questions", "base_correct", "sft_correct", "base_correct_sft_wrong", "base_wrong_sft_correct"]
    n = F.sum("questions")
    return summed.groupingSets([[subject], []], subject).agg(
        F.when(F.grouping(subject) == 1, "overall").otherwise(F.col(subject)).alias("scope"),
        *[F.sum(name).alias(name) for name in counts],
        (F.sum("base_correct") / n).alias("base_accuracy"),
        (F.sum("sft_correct") / n).alias("sft_accuracy"),
        (F.sum("sft_correct") / n - F.sum("base_correct") / n).alias("accuracy_difference"),
        *[(F.sum(f"{m}_mass") / n).alias(f"{m}_mean_answer_letter_probability_mass")
          for m in fixed.MODELS if masses],
    ).drop(subject)


def require_subjects(rows: DataFrame, subjects: Sequence[str], subject: str = "subject") -> None:
    """Every expected subject has results."""
    seen = {r[0] for r in rows.filter(F.col(subject).isin(*subjects)).select(subject).distinct().collect()}
    missing = [s for s in subjects if s not in seen]
    if missing:
        raise ValueError(f"{fixed.ERROR_SUBJECTS}: {missing}")
