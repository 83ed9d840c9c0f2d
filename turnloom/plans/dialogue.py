"""Pages to validated training data: parse, build, split, check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom import fixed, schemas
from turnloom.functions import arrays, text
from turnloom.operators import pairs, profile, split, transcript, validate
from turnloom.session import settle
from turnloom.sources import files, sinks
from turnloom.sources.pages import paragraph_arrays


def parse_pages(pages: DataFrame) -> DataFrame:
    """Line frame of ``episode_id, title, url, html`` pages; fails unless every page has dialogue."""
    lines = settle(transcript.page_dialogue(paragraph_arrays(pages, ["episode_id"]), ["episode_id"]))
    transcript.require_complete(pages, lines, ["episode_id"])
    return lines


def scrape(pages: DataFrame, path: str) -> DataFrame:
    """Write all episodes or, when any page fails, nothing. Returns the totals."""
    lines = parse_pages(pages)
    sinks.write_episode_lines(lines, pages.select("episode_id", "title", "url"), path)
    return profile.dialogue_totals(lines)


def build_dataset(
    lines: DataFrame, out: str, rules: pairs.PairRules = pairs.PairRules(),
    fraction: float = fixed.HELDOUT_FRACTION, seed: int = fixed.SEED, exact_split: bool = False,
) -> dict[str, DataFrame]:
    """Write ``out/judged`` and ``out/pairs`` (parquet) and ``out/splits`` (JSON lines per split).

    Judged lines and pairs are read back from their tables, so the look-back
    runs once and a lost executor costs no more than its own tasks.
    """
    spark = lines.sparkSession
    judged = pairs.candidates(pairs.attach_context(lines, rules), rules)
    sinks.replace_folder(spark, f"{out}/judged", lambda new: judged.write.parquet(new))
    judged = spark.read.parquet(f"{out}/judged")
    unique = pairs.drop_duplicates(pairs.build_pairs(judged))
    sinks.replace_folder(spark, f"{out}/pairs", lambda new: unique.write.parquet(new))
    kept = spark.read.parquet(f"{out}/pairs")
    divide = split.split_pairs_exact if exact_split else split.split_pairs
    divided = divide(kept, fraction=fraction, seed=seed)
    sinks.write_pair_lines(divided, f"{out}/splits")
    return {"reasons": pairs.drop_reasons(judged), "summary": split.split_summary(divided)}


def read_splits(spark: SparkSession, out: str) -> DataFrame:
    """Both splits as one frame, in a form that sorts back to file order."""
    sides = [
        files.read_json_lines(spark, f"{out}/splits/split={name}", schemas.PAIR).withColumn(
            "split", F.lit(name))
        for name in (split.TRAIN, split.HELDOUT)
    ]
    for name, side in zip((split.TRAIN, split.HELDOUT), sides):
        validate.require_rows(side, fixed.ERROR_EMPTY_SPLIT.format(name))
    return sides[0].unionByName(sides[1])


def validate_dataset(spark: SparkSession, out: str) -> dict[str, DataFrame]:
    """Check and profile both splits; raises with the first errors when a rule is broken."""
    rows = settle(read_splits(spark, out))  # parsed once
    flat = rows.select(
        "split", F.col("meta.episode").alias("episode"),
        arrays.last(F.col("messages")).content.alias("target"))
    isolation = settle(validate.isolation_report(flat))
    shared = validate.shared_episodes(flat).orderBy("episode").limit(3)
    location = F.concat_ws(":", "split", "source_file", F.col("source_row").cast("string"))
    errors = validate.row_errors(rows, ["split", *files.SOURCE_ORDER]).withColumn("at", location)
    errors = errors.withColumn("_side", F.when(F.col("split") == split.TRAIN, 0).otherwise(1)).withColumn(
        "_rule", validate.rule_place(F.col("rule")))
    first, count = validate.error_report(errors, ["_side", *files.SOURCE_ORDER, "position", "_rule"])
    problems = [f"{r['at']}: {r['detail']}" for r in first.collect()]
    problems += [r["detail"] for r in validate.isolation_errors(isolation, shared).collect()]
    if problems:
        hidden = count.first()["not_shown"]
        shown = problems[: fixed.ERROR_REPORT_ROWS]
        hidden += len(problems) - len(shown)
        raise ValueError("\n  ".join(["FAILED", *shown, *([f"... and {hidden} more"] if hidden else [])]))
    return {
        "isolation": isolation,
        "lengths": profile.truncated_index_profile(
            flat, ["split"], text.word_count(F.col("target"))),
        "turns": profile.message_counts(rows, ["split"]),
        "phrases": profile.phrase_hits(flat, F.col("target"), keys=["split"]),
        "phrase_summary": profile.phrase_summary(flat, F.col("target"), keys=["split"]),
    }
