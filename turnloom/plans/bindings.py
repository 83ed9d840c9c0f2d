"""How the driver's tables stand in for dialogue, model outputs and questions.

The tables hold no transcripts, generations or multiple-choice items, so each
frame an operator needs is derived from whole tables here.
"""

from __future__ import annotations

import dataclasses
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.functions import text
from turnloom.operators import choice, pairs, similarity
from turnloom.operators.ordered import look_back
from turnloom.session import checkpoint_dir, settle
from turnloom.sources import sinks

CONST_SCENE = "0"
SHORT_SCENES = "turn div 3"
PAIR_RULES = pairs.PairRules(
    target="assistant", context_turns=3, min_target_words=60, min_prompt_words=20,
    max_target_words=160)
SUBJECTS = ("subject_0", "subject_1", "subject_2")
LANGUAGES = ("en", "fr", "de", "es")
PHRASES = ("license", "worthless", "notice", "tion of the", "hot beverage")
STOPS = (1, 13)
TOKEN_CAP = 120
END_TOKEN = 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- dialogue ---

def conversation_lines(spark: SparkSession, sf_dir: str, scene: str = CONST_SCENE) -> DataFrame:
    """Conversations as episodes, turns as lines, roles as speakers."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("episode_id"), F.col("conv_id").cast("string").alias("title"),
        F.col("turn").alias("line"), F.col("role").alias("speaker"), "text",
        F.expr(scene).cast("int").alias("scene"))


#: Turns that get another role or text, so that every rule meets lines that break it; Spark and check SQL share it.
ALTERED_ROLE = "CASE WHEN conv_id % 5 = 0 AND turn % 4 = 2 THEN 'assistant' ELSE role END"
ALTERED_TEXT = """CASE (conv_id * 7 + turn) % 13 WHEN 3 THEN 'Oh' WHEN 5 THEN concat('Look at this one ', text)
  WHEN 7 THEN 'It is said again and again' WHEN 8 THEN 'It is said again and again' WHEN 9 THEN ' ' ELSE text END"""
ALL_RULES = dataclasses.replace(PAIR_RULES, min_target_words=1)


def altered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judged lines of conversations in which some turns are altered."""
    lines = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("episode_id"), F.col("conv_id").cast("string").alias("title"), F.col("turn").alias("line"),
        F.expr(ALTERED_ROLE).alias("speaker"), F.expr(ALTERED_TEXT).alias("text"), F.expr(SHORT_SCENES).cast("int").alias("scene"))
    return pairs.candidates(pairs.attach_context(lines, ALL_RULES), ALL_RULES)


def judged_lines(spark: SparkSession, sf_dir: str, scene: str = CONST_SCENE) -> DataFrame:
    lines = conversation_lines(spark, sf_dir, scene)
    return pairs.candidates(pairs.attach_context(lines, PAIR_RULES), PAIR_RULES)


def conversation_pairs(spark: SparkSession, sf_dir: str, scene: str = CONST_SCENE) -> DataFrame:
    return pairs.drop_duplicates(pairs.build_pairs(judged_lines(spark, sf_dir, scene)))


def settled_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs, stored once: splitting reads them for the episode order and for the rows."""
    return settle(conversation_pairs(spark, sf_dir).select("episode_id", "line", "episode", "target_words"))


def shown(messages: str | Column) -> Column:
    """Messages as one comparable string."""
    return F.concat_ws("\n", F.transform(messages, lambda m: F.concat_ws(": ", m.role, m.content)))


def raw_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn with the turns before it as an unmerged chat, so row rules find errors."""
    return chats_of(conversation_lines(spark, sf_dir))


def chats_of(lines: DataFrame) -> DataFrame:
    """Every line with the three lines before it as one chat."""
    own = F.struct(F.col("speaker").alias("role"), F.col("text").alias("content"))
    return look_back(lines, ["episode_id"], "line", {"before": own}, 3).select(
        F.col("episode_id").alias("conv_id"), F.col("line").alias("turn"),
        F.concat("before", F.array(own)).alias("messages"))


def html_safe(value: Column) -> Column:
    return F.replace(F.replace(value, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def document_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as transcript pages: one paragraph per line, of five kinds in turn."""
    def paragraph(line: Column, i: Column) -> Column:
        kind = i % 7
        return (
            F.when(kind == 0, F.concat(F.lit("<p>Alpha <i>(quietly)</i>: "), line, F.lit(" ()</p>")))
            .when(kind == 3, F.concat(F.lit("<p><em>Scene: "), line, F.lit("</em></p>")))
            .when(kind == 5, F.concat(F.lit("<p>Written by: "), line, F.lit("</p>")))
            .when(kind == 6, F.concat(F.lit("<p><em>"), line, F.lit("</em></p>")))
            .otherwise(F.concat(F.lit("<p>Mrs. Beta (off): "), line, F.lit("</p>")))
        )

    body = F.concat_ws("", F.transform(F.split(html_safe(F.col("text")), "\n"), paragraph))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(
        F.lit('<p>Menu: home</p><div class="post-entry">'), body, F.lit("</div>")).alias("html"))


def link_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as a link list: one episode link and one other link each."""
    return table(spark, sf_dir, "pages").select("page_id", F.concat(
        F.lit('<a href="/about">About</a> <a href="'), html_safe(F.col("url")),
        F.lit('">series 1  Episode '), F.col("page_id").cast("string"), F.lit(" <b>Part</b></a>"),
    ).alias("html"))


def array_documents(spark: SparkSession, sf_dir: str) -> str:
    """A folder of JSON array documents of conversations as episodes, about 2,000 in each."""
    lines = F.struct(
        F.col("turn").alias("_turn"), F.col("role").alias("speaker"), "text", F.lit(0).alias("scene"))
    episodes = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(lines)).alias("lines"))
    path = f"{checkpoint_dir(spark).rstrip('/')}/arrays-{uuid.uuid4().hex}"
    shown = episodes.select("conv_id", F.struct(
        F.col("conv_id").cast("string").alias("title"), F.concat(F.lit("/"), F.col("conv_id").cast("string")).alias("url"),
        F.transform("lines", lambda x: x.dropFields("_turn")).alias("lines")).alias("episode"))
    sinks.write_json_arrays(shown.select("conv_id", "episode.*"), path, ["conv_id"], 4 + episodes.count() // 2000)
    return path


def benchmark_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of eight letters or more of the benchmark, as a table of phrases."""
    words = F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("phrase")
    return table(spark, sf_dir, "benchmark").select(words).where("length(phrase) >= 8").distinct()


# --- tokens ---

def word_lengths(value: Column) -> Column:
    """Toy tokenizer: a word's token is its length."""
    return F.transform(F.split(text.clean(value), " "), lambda w: F.length(w))


def tokenized_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs as token ids; some lack the end token, some do not keep the prompt."""
    base = conversation_pairs(spark, sf_dir).select(
        F.col("episode_id").alias("conv_id"), F.col("line").alias("turn"), "target_words",
        F.transform(F.split(shown("prompt"), " "), lambda w: F.length(w) + 10).alias("prompt_ids"),
        F.transform(F.split("target", " "), lambda w: F.length(w) + 10).alias("reply_ids"))
    ending = F.when(F.col("target_words") % 5 == 0, F.array().cast("array<int>")).otherwise(
        F.array(F.lit(END_TOKEN)))
    opening = F.when(F.col("target_words") % 7 == 0, F.array(F.lit(0))).otherwise(
        F.array().cast("array<int>"))
    return base.withColumn(
        "full_ids", F.concat(opening, "prompt_ids", "reply_ids", ending)).drop("reply_ids")


# --- paired similarity ---

def scored_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as a reference, its two successors as the models' replies."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    count = table(spark, sf_dir, "embeddings").agg(F.count(F.lit(1))).scalar()

    def shifted(by: int, name: str) -> DataFrame:
        return vectors.select(
            ((F.col("vec_id") - by + count) % count).alias("vec_id"), F.col("embedding").alias(name))

    joined = vectors.join(shifted(1, "base_vector"), "vec_id").join(shifted(2, "sft_vector"), "vec_id")
    return similarity.score_pairs(joined, "embedding", "base_vector", "sft_vector").select(
        "vec_id", "label", "base_cosine", "sft_cosine", "difference")


def generation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored rows with made-up reply texts and token counts per label."""
    def reply(words: Column, hit: Column) -> Column:
        return F.struct(
            F.when(words == 0, "").otherwise(F.repeat(F.lit("w "), words)).alias("text"),
            (words * 3).cast("int").alias("tokens"), hit.alias("hit_token_limit"))

    label = F.col("label")
    return scored_vectors(spark, sf_dir).withColumns({
        "base": reply(label, label == 9), "sft": reply(label + 1, label >= 8),
        "base_encoder_tokens": label * 50, "sft_encoder_tokens": label * 60,
    })


# --- multiple choice ---

def choice_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts as questions about their own word count, in three subjects."""
    words = text.word_count(F.col("text"))
    place = (F.col("item_id") / len(SUBJECTS)).cast("int")
    dev = place < 5
    return table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("subject_"), (F.col("item_id") % len(SUBJECTS)).cast("string")).alias("subject"),
        F.when(dev, choice.DEV).otherwise(choice.TEST).alias("split"),
        F.when(dev, place).otherwise(place - 5).alias("idx"),
        F.col("text").alias("question"),
        F.array(*[(words + i).cast("string") for i in range(4)]).alias("choices"),
        (F.length("text") % 4).alias("answer"))


def graded_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents: language as subject, quality as answer, two length rules as models."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    joined = labels.join(documents, "doc_id").withColumnRenamed("lang", "subject")
    return choice.mark_correct(
        joined, F.col("quality"),
        (F.col("n_chars") > 1500).cast("int"), (F.col("n_chars") > 300).cast("int"))


def logit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("logits"))


def exact_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark lines as dev questions, document lines as test questions."""
    def lines(name: str, split: str) -> DataFrame:
        return table(spark, sf_dir, name).select(
            F.lit(split).alias("split"), F.explode(F.split("text", "\n")).alias("question"))

    return lines("benchmark", choice.DEV).unionByName(lines("documents", choice.TEST))
