"""Paired evaluations: gates, model plug-in, and metrics documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom import fixed, schemas
from turnloom.functions import arrays
from turnloom.operators import batching, bootstrap, choice, ordered, resume, similarity, validate
from turnloom.session import settle
from turnloom.sources import files, sinks

def prepare_choice_data(
    spark: SparkSession, data_path: str, manifest_path: str,
    subjects: Sequence[str] = fixed.SUBJECTS, shots: int = fixed.SHOTS, landed_anew: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Item and manifest frames of a landed data file, frozen on first use.

    A manifest is a folder: ``header.json`` and a table of the selected items, so it has any size.
    A single JSON document with lists of indices is read as well. With a manifest, the file must
    have its digest; with ``landed_anew``, freezing the data again must give the same manifest.
    """
    digests = files.file_digests(spark, data_path)
    source, items = files.read_choice_items(spark, data_path)
    rebuilt = choice.freeze_manifest(items.filter(F.col("subject").isin(*subjects)), shots)
    header_path = f"{manifest_path}/header.json"
    if not files.exists(spark, manifest_path):
        header = {
            "dataset": source["dataset"], "revision": source["revision"], "split": choice.TEST,
            "shots": shots, "data_sha256": digests.first()["sha256"]}
        sinks.replace_folder(spark, f"{manifest_path}/items", lambda new: rebuilt.write.parquet(new))
        sinks.write_json_document(spark, header_path, header)
    if files.exists(spark, header_path):
        header = files.read_settings(spark, header_path)
        manifest = spark.read.schema(rebuilt.schema).parquet(f"{manifest_path}/items")
    else:
        document = files.read_json_document(spark, manifest_path, schemas.CHOICE_MANIFEST)
        header = document.drop("subjects").first().asDict()
        manifest = choice.explode_manifest(document)
    files.require_digest(digests, header["data_sha256"])
    choice.check_manifest(manifest, subjects, shots)
    if landed_anew:
        require_same_manifest(rebuilt, manifest)
    return items, manifest


def require_same_manifest(rebuilt: DataFrame, frozen: DataFrame) -> None:
    """Freezing the landed data again selects the same items at the same places."""
    columns = ["subject", "split", "place", "idx"]
    rebuilt, frozen = (x.select(*[F.col(c).cast("string") for c in columns]) for x in (rebuilt, frozen))
    validate.require_empty(
        rebuilt.exceptAll(frozen).unionAll(frozen.exceptAll(rebuilt)), "the landed data give another manifest")


def apply_model(
    rows: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str,
    batch_size: int, lengths: str | None = None, token_budget: int | None = None,
) -> DataFrame:
    """Run a caller's model over rows in batches; it is loaded once per task.

    ``load`` returns a function from a batch of rows to a batch of results. With ``token_budget``, rows
    of about equal length (column ``lengths``) go together, as many as fit the budget when all are padded
    to the longest, ``batch_size`` at most; results come back in the order of the rows. A
    model that must fit a context window checks it with
    :func:`turnloom.operators.similarity.fits_context` beforehand.
    """
    if batch_size < 1:
        raise ValueError("a batch needs room for one row")
    if token_budget is not None and (token_budget < 1 or lengths is None):
        raise ValueError("a token budget must be positive and needs a column of lengths")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            if token_budget is None:
                for start in range(0, len(batch), batch_size):
                    yield model(batch.iloc[start:start + batch_size])
            elif len(batch):
                packed = batching.pack(batch[lengths].to_numpy(), token_budget, batch_size)
                found = pd.concat([model(batch.iloc[places]) for places in packed], ignore_index=True)
                if len(found) != len(batch):
                    raise ValueError("a model gives one result per row")
                yield found.iloc[np.argsort(np.concatenate(packed), kind="stable")]

    return rows.mapInPandas(run, schema)


def run_in_steps(
    inputs: DataFrame, out: str, settings: dict, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]],
    schema: str, batch_size: int, rows_per_step: int, lengths: str | None = None, token_budget: int | None = None,
) -> DataFrame:
    """Run a model over inputs with a dense ``index``, resuming where an earlier run stopped.

    A run with other settings is refused. Inputs that are left are written once, by step, and each
    step appends one index range as one job that reads its own step only, so saved results are
    always the first of the inputs; a finished run loads no model.
    """
    spark = inputs.sparkSession
    settings_path, results_path = f"{out}/run.json", f"{out}/results"
    resume.require_same_settings(files.read_settings(spark, settings_path), settings)
    sinks.write_json_document(spark, settings_path, settings)
    results = lambda: spark.read.schema(schema).json(results_path)
    total = inputs.count()
    saved = resume.require_prefix(results(), total) if files.exists(spark, results_path) else 0
    if saved < total:
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        left = inputs.filter(F.col("index") >= saved).withColumn(
            "_step", F.floor((F.col("index") - saved) / rows_per_step))
        spread = left.repartition(tasks, "_step", F.pmod("index", F.lit(tasks)))
        sinks.replace_folder(
            spark, f"{out}/inputs", lambda new: spread.write.partitionBy("_step").parquet(new))
        for step in range(-(-(total - saved) // rows_per_step)):
            rows = spark.read.schema(inputs.schema).parquet(f"{out}/inputs/_step={step}")
            apply_model(rows, load, schema, batch_size, lengths, token_budget).write.mode("append").json(results_path)
    return results()


def require_saved_inputs(results: DataFrame, inputs: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Saved rows repeat the inputs at their index."""
    validate.require_empty(
        resume.prefix_mismatches(results, inputs, "index", columns).select("index"), fixed.ERROR_SAVED_ROWS)
    return results


def indexed(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Rows with a dense ``index`` in the order of columns that together are unique."""
    return ordered.value_rank(rows.withColumn("_order", F.struct(*order)), "_order", "index").drop("_order").withColumn(
        "index", F.col("index").cast("long"))


def evaluate_replies(
    spark: SparkSession, data_path: str, out: str, metrics_path: str, settings: dict,
    load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], encode: Callable[[DataFrame], DataFrame],
    encoder_limit: int, prompt_tokens: Callable[[DataFrame], DataFrame], window: int, new_tokens: int,
    batch_size: int = 16, rows_per_step: int = 100_000, samples: int = fixed.BOOTSTRAP_SAMPLES,
    seed: int = fixed.SEED, mode: str = "multinomial",
) -> dict:
    """Generate, encode, score and save both models' replies to held-out chats; can be stopped.

    ``prompt_tokens`` adds the token ids of each prompt, which must leave room for ``new_tokens``.
    ``load`` gives a function from ``index, episode, prompt, reference`` rows to generation rows;
    ``encode`` adds ``reference_vector, base_vector, sft_vector, reference_tokens`` and each model's
    ``<model>_encoder_tokens``.
    """
    rows = validate.require_rows(
        files.read_json_lines(spark, data_path, schemas.PAIR, skip_blank=True), fixed.ERROR_EMPTY_SPLIT.format("held-out"))
    checked = validate.require_evaluable(rows, F.col("source_row"))
    inputs = settle(indexed(checked, files.SOURCE_ORDER).select(
        "index", F.col("meta.episode").alias("episode"), arrays.all_but_last(F.col("messages")).alias("prompt"),
        arrays.last(F.col("messages")).content.alias("reference")))
    fitting = validate.guard(
        prompt_tokens(inputs), similarity.fits_context(F.col("prompt_tokens"), new_tokens, window),
        F.format_string("prompt %s leaves no room for a reply", F.col("index").cast("string")))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schemas.GENERATION_ROW.fields)
    results = run_in_steps(
        fitting.select(*inputs.columns), out, settings, load, schema, batch_size, rows_per_step)
    require_saved_inputs(results, inputs, ["episode", "prompt", "reference"])
    scored = settle(similarity.score_pairs(encode(results), "reference_vector", "base_vector", "sft_vector").drop(
        "reference_vector", "base_vector", "sft_vector"))
    metrics = similarity_metrics(scored, encoder_limit, samples, seed, mode)
    save_results(scored, ["base_cosine", "sft_cosine"], metrics, settings, out, metrics_path)
    return metrics


def evaluate_choices(
    spark: SparkSession, data_path: str, manifest_path: str, out: str, metrics_path: str, settings: dict,
    load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], letter_tokens: Sequence[Sequence[int]],
    prompt_tokens: Callable[[DataFrame], DataFrame], window: int, vocabulary: DataFrame | None = None,
    subjects: Sequence[str] = fixed.SUBJECTS, shots: int = fixed.SHOTS, batch_size: int = 16,
    rows_per_step: int = 100_000, samples: int = fixed.BOOTSTRAP_SAMPLES, seed: int = fixed.SEED,
    mode: str = "multinomial",
) -> dict:
    """Score both models on the frozen multiple-choice items; can be stopped.

    ``letter_tokens`` are the token ids of A, B, C and D: one each, all different. ``load`` gives a
    function from ``index, subject, messages, answer`` rows to ``index, base_logits, sft_logits``.
    """
    letters = spark.range(1).select(F.array(*[F.array(*map(F.lit, t)) for t in letter_tokens]).alias("t"))
    if not letters.select(choice.letters_are_tokens(F.col("t"))).first()[0]:
        raise ValueError("every letter needs a token of its own")
    items, manifest = prepare_choice_data(spark, data_path, manifest_path, subjects, shots)
    examples = validate.require_rows(
        choice.few_shot_examples(items, manifest, subjects, shots), "there are no items to evaluate")
    examples = settle(indexed(examples, ["subject", "place"]))
    inputs = validate.guard(
        prompt_tokens(examples), similarity.shorter_than_context(F.col("prompt_tokens"), window),
        F.format_string("prompt %s does not fit the model", F.col("index").cast("string")))
    logits = run_in_steps(
        inputs.select("index", "subject", "messages", "answer"), out, settings, load,
        "index long, subject string, answer string, base_logits array<double>, sft_logits array<double>",
        batch_size, rows_per_step)
    require_saved_inputs(logits, examples, ["subject", "answer"])
    one_each = [t[0] for t in letter_tokens]
    joined = examples.select("index", "subject", "idx", "answer")
    for model in fixed.MODELS:
        scored = choice.predict(logits, ["index"], f"{model}_logits", one_each, vocabulary)
        names = [c for c in scored.columns if c != "index"]
        joined = joined.join(scored.select("index", F.struct(*names).alias(model)), "index")
    joined = settle(joined)
    # the strata of exact draws number their own rows
    rows = ordered.dense_position(joined, ["subject"], "idx", "_slot").withColumn("index", F.col("_slot")).drop("_slot")
    metrics = choice_metrics(rows, subjects, samples, seed, mode)
    save_results(joined, [], metrics, settings, out, metrics_path)
    return metrics


def similarity_metrics(
    rows: DataFrame, encoder_limit: int, samples: int = fixed.BOOTSTRAP_SAMPLES,
    seed: int = fixed.SEED, mode: str = "multinomial",
) -> dict:
    """Metrics document of scored generation rows; ``mode``: multinomial, poisson, portable or exact.

    ``rows``: ``index, episode, reference_tokens`` and per model the generation
    struct, ``<model>_cosine`` and ``<model>_encoder_tokens``, plus ``difference``.
    """
    if mode == "poisson":
        drawn = bootstrap.cluster_estimates_poisson(rows, F.col("episode"), F.col("difference"), samples, seed)
        episodes = rows.select("episode").distinct().count()
    else:
        totals = settle(similarity.cluster_totals(rows, "episode"))
        estimates = {
            "multinomial": bootstrap.cluster_estimates_multinomial, "portable": bootstrap.cluster_estimates,
            "exact": bootstrap.cluster_estimates_exact}[mode]
        drawn, episodes = estimates(totals, samples, seed), totals.count()
    bounds = bootstrap.interval(drawn).first()
    paired = similarity.paired_summary(rows).first()
    models = {
        r["model"]: {k: v for k, v in r.asDict().items() if k != "model"}
        for r in similarity.model_metrics(similarity.long_form(rows, ["index"]), encoder_limit).collect()
    }
    return {
        "examples": paired["examples"], "episodes": episodes, **models,
        "mean_paired_difference": paired["mean_paired_difference"],
        "paired_difference_episode_bootstrap_95_ci": [bounds["low"], bounds["high"]],
        "fraction_sft_higher": paired["fraction_sft_higher"],
        "embedding_max_sequence_length": encoder_limit,
        "reference_embedding_truncations": rows.filter(
            F.col("reference_tokens") > encoder_limit).count(),
        "interpretation": fixed.SIMILARITY_NOTE,
    }


def save_results(
    rows: DataFrame, finite: Sequence[str], metrics: dict, settings: dict, out: str, metrics_path: str,
) -> None:
    """Write scored rows, then the metrics with the settings that produced them.

    A NaN or infinity in ``finite`` columns or in the metrics fails the write.
    """
    checked = sinks.finite_or_fail(rows, finite)
    sinks.replace_folder(rows.sparkSession, f"{out}/scored", lambda new: checked.write.json(new))
    sinks.write_json_document(rows.sparkSession, metrics_path, {**metrics, "run": settings})


def choice_rows(predictions: DataFrame) -> DataFrame:
    """Flatten prediction structs into right/wrong marks and letter masses."""
    marked = choice.mark_correct(
        predictions, F.col("answer"), F.col("base.prediction"), F.col("sft.prediction"))
    return marked.withColumns({
        f"{m}_mass": F.col(f"{m}.answer_letter_probability_mass") for m in fixed.MODELS})


def choice_metrics(
    predictions: DataFrame, subjects: Sequence[str] = fixed.SUBJECTS,
    samples: int = fixed.BOOTSTRAP_SAMPLES, seed: int = fixed.SEED, mode: str = "multinomial",
) -> dict:
    """Metrics document of paired predictions; ``mode``: multinomial, portable or exact.

    ``exact`` needs dense zero-based ``index`` values per subject.
    """
    rows = choice_rows(predictions)
    choice.require_subjects(rows, subjects)
    scopes = {r["scope"]: r for r in choice.accuracy_by_subject(rows, masses=True).collect()}
    if mode == "exact":
        drawn = bootstrap.stratified_estimates_exact(
            rows.select(F.col("subject").alias("stratum"), F.col("index").alias("slot"), "difference"),
            subjects, samples, seed)
    else:
        counts = bootstrap.stratum_counts(rows, "subject", "difference")
        method = {"portable": bootstrap.stratified_estimates,
                  "multinomial": bootstrap.stratified_estimates_multinomial}[mode]
        drawn = method(counts, samples, seed)
    bounds = bootstrap.interval(drawn).first()
    overall = scopes["overall"]
    return {
        "questions": overall["questions"],
        "by_subject": {s: _scope(scopes[s]) for s in subjects},
        "overall": _scope(overall),
        "paired_accuracy_difference_95_ci": [bounds["low"], bounds["high"]],
        "base_correct_sft_wrong": overall["base_correct_sft_wrong"],
        "base_wrong_sft_correct": overall["base_wrong_sft_correct"],
    }


def _scope(row) -> dict:
    values = {"questions": row["questions"]}
    for m in fixed.MODELS:
        values[m] = {
            "correct": row[f"{m}_correct"], "accuracy": row[f"{m}_accuracy"],
            "mean_answer_letter_probability_mass": row[f"{m}_mean_answer_letter_probability_mass"],
        }
    values["accuracy_difference"] = row["accuracy_difference"]
    return values
