"""Training rows: argument rules, row rules, projection and run manifest."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom import fixed, schemas
from turnloom.functions.text import is_blank
from turnloom.operators import validate
from turnloom.sources import files

# --- fixed values: numeric settings that must be positive ---
POSITIVE = (
    "epochs", "learning_rate", "batch_size", "gradient_accumulation_steps", "max_length", "lora_rank",
)


def argument_errors(
    arguments: Mapping, train_file_exists: bool, output_is_empty: bool,
    resume_has_state: bool | None, gpu: bool,
) -> list[str]:
    """Every broken rule of a training run's settings. ``resume_has_state`` is None without a resume."""
    steps = arguments.get("max_steps", -1)
    rules = [(arguments[name] > 0, f"{name} is not above zero") for name in POSITIVE]
    rules += [
        (steps > 0 or steps == -1, "max_steps is neither above zero nor -1 for all steps"),
        (train_file_exists, "the rows to train on are not there"),
        (output_is_empty or resume_has_state is not None, "the output folder has files of another run"),
        (resume_has_state is not False, "the checkpoint to go on from holds no state"),
        (gpu or arguments.get("cpu", False), "there is no GPU and cpu is not set"),
    ]
    return [told for holds, told in rules if not holds]


def training_rows(spark: SparkSession, path: str) -> DataFrame:
    """Prompt and completion of every row of a pair file; the first bad row fails the job."""
    rows = validate.require_rows(
        files.read_json_lines(spark, path, schemas.PAIR, skip_blank=True), fixed.ERROR_NO_TRAINING)
    checked = validate.require_trainable(rows, F.col("source_row"))
    return validate.prompt_completion(checked, files.SOURCE_ORDER)


def require_tokens(rows: DataFrame, end_token: int, max_tokens: int) -> DataFrame:
    """Rows with ``prompt_ids`` and ``full_ids``; the first broken token rule fails the job."""
    error = validate.token_error(F.col("prompt_ids"), F.col("full_ids"), end_token, max_tokens)
    return validate.guard(rows, error.isNull(), F.coalesce(error, F.lit("")))


def dataset_digest(digests: DataFrame) -> str:
    """The digest of a single file, or one over all files' digests, folded by prefix."""
    few = digests.select("sha256").limit(2).collect()
    if len(few) == 1:
        return few[0][0]
    fold = F.sha2(F.concat_ws("", F.array_sort(F.collect_list("sha256"))), 256)
    by_prefix = digests.groupBy(F.substring("sha256", 1, 3)).agg(fold.alias("sha256"))
    return by_prefix.agg(fold).first()[0]


def run_manifest(
    spark: SparkSession, path: str, arguments: Mapping, revision: str, packages: Mapping[str, str],
    artefacts: Mapping[str, str] | None = None,
) -> dict:
    """Settings of a run with the digest of its data files and their row count.

    ``artefacts`` names further files, such as an adapter, its configuration, a manifest or a
    script; each adds ``<name>_sha256``.
    """
    further = {
        f"{name}_sha256": dataset_digest(files.file_digests(spark, place))
        for name, place in (artefacts or {}).items()}
    return further | {
        "arguments": dict(arguments), "model_revision": revision,
        "dataset_sha256": dataset_digest(files.file_digests(spark, path)),
        "training_examples": spark.read.text(path).filter(~is_blank(F.col("value"))).count(),
        "packages": dict(packages),
    }
