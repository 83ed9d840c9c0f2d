"""Plot-ready frames of evaluation metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom import fixed
from turnloom.functions.text import percent_label, signed_label

# --- fixed values: figure scales and labels ---
SIMILARITY_FLOOR = 0.32
SIMILARITY_HEADROOM = 1.6
LENGTH_HEADROOM = 1.3
MODEL_LABELS = {"base": "Base", "sft": "SFT"}
SUBJECT_LABELS = {
    "high_school_physics": "High-school physics",
    "college_physics": "College physics",
    "conceptual_physics": "Conceptual physics",
}


def _bars(metrics: DataFrame, suffix: str, digits: int, upper: Column) -> DataFrame:
    columns = [f"{m}_{suffix}" for m in fixed.MODELS]
    sides = F.array(*[
        F.struct(F.lit(i).alias("place"), F.lit(MODEL_LABELS[m]).alias("model"), F.col(c).alias("value"))
        for i, (m, c) in enumerate(zip(fixed.MODELS, columns))])
    others = [c for c in metrics.columns if c not in columns]
    return metrics.select(*others, upper.alias("axis_upper"), F.inline(sides)).withColumn(
        "label", F.format_string(f"%.{digits}f", "value"))


def similarity_bars(metrics: DataFrame) -> DataFrame:
    """Two bars with the paired interval from one row ``base_cosine, sft_cosine, difference, low, high``."""
    top = F.greatest("base_cosine", "sft_cosine")
    upper = F.greatest(F.lit(SIMILARITY_FLOOR), top * SIMILARITY_HEADROOM)
    return _bars(metrics, "cosine", 4, upper).withColumn(
        "caption", F.concat(
            F.lit("SFT minus base: "), signed_label(F.col("difference"), 4),
            F.format_string("\n95%% CI [%.4f, %.4f]", "low", "high")))


def length_bars(metrics: DataFrame) -> DataFrame:
    """Two bars from one row ``base_tokens, sft_tokens``."""
    return _bars(metrics, "tokens", 1, F.greatest("base_tokens", "sft_tokens") * LENGTH_HEADROOM)


def accuracy_bars(
    by_subject: DataFrame, subjects: Sequence[str] = fixed.SUBJECTS,
    labels: dict[str, str] | None = None,
) -> DataFrame:
    """Accuracy in percent per scope and model; subjects in the given order, then overall."""
    names = {**(labels or SUBJECT_LABELS), "overall": "Overall"}
    place, title = F.lit(None).cast("int"), F.col("scope")
    for i, scope in enumerate([*subjects, "overall"]):
        place = F.when(F.col("scope") == scope, i).otherwise(place)
        title = F.when(F.col("scope") == scope, names.get(scope, scope)).otherwise(title)
    sides = F.array(*[
        F.struct(F.lit(MODEL_LABELS[m]).alias("model"), (F.col(f"{m}_accuracy") * 100).alias("percent"))
        for m in fixed.MODELS])
    return by_subject.select(
        place.alias("place"), title.alias("subject"), "questions", F.inline(sides)
    ).filter("place is not null").withColumn("label", percent_label(F.col("percent")))


def accuracy_gain(metrics: DataFrame) -> DataFrame:
    """Gain and interval in percentage points from one row ``difference, low, high`` of shares."""
    points = metrics.select(*[(F.col(c) * 100).alias(c) for c in ("difference", "low", "high")])
    return points.withColumn("caption", F.concat(
        F.lit("SFT minus base: "), signed_label(F.col("difference"), 2),
        F.format_string(" points\n95%% CI [%+.2f, %+.2f]", "low", "high")))
