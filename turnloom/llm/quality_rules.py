"""Quality rules: a decision list learned by sequential covering.

Statistics of every text are made in Arrow batches. Rules are grown and pruned on the driver from
the statistics of a bounded sample of labelled rows and come back as one Spark conditional
expression, which judges every row inside the JVM.

Defined cases: a null or empty text has zero statistics and fails the base rules; rows with equal
ids are judged one by one; a null id is kept as null; without labelled rows of both classes the
list is empty and only the base rules decide; columns are picked by name, so others may clash.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from turnloom.llm.common import lowest, small_batches

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\f\r"
#: At most this many labelled rows, those with the smallest digests of their ids, teach the rules.
SAMPLE_ROWS = 20_000

_NAMES = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct",
    "n_upper", "n_marks", "n_digits"]
STATS = StructType([StructField(x, LongType()) for x in _NAMES])
_MARKS = "!?"
_DIGITS = "0123456789"


def repeated_words(words: list[bytes], width: int = 3) -> tuple[int, int]:
    """Words inside windows that occur at least twice, and the number of distinct words."""
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    n = len(ids) - width + 1
    if n < 2:
        return 0, len(numbers)
    keys = ids[:n]
    for step in range(1, width):
        # ranks instead of products keep any vocabulary within 64 bits
        keys = keys * len(numbers) + ids[step : step + n]
        if step + 1 < width and len(numbers) > 1 << 20:
            keys = np.unique(keys, return_inverse=True)[1]
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edges = np.zeros(len(ids) + 1, np.int64)
    edges[:n] += twice
    edges[width : width + n] -= twice
    return int((np.cumsum(edges[:-1]) > 0).sum()), len(numbers)


def statistics(text: str | None) -> tuple[int, ...]:
    """The statistics of one text, in the order of STATS."""
    if not text:
        return (0,) * len(_NAMES)
    words = text.encode().split()
    seen: set[str] = set()
    repeats = lines = 0
    for line in text.split("\n"):
        if line.strip(BLANKS):
            lines += 1
            repeats += line in seen
            seen.add(line)
    covered, distinct = repeated_words(words)
    ascii_upper = sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    return (
        len(words), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)),
        repeats, covered, lines, distinct, ascii_upper, sum(map(text.count, _MARKS)),
        sum(map(text.count, _DIGITS)))


@F.arrow_udf(STATS)
def text_statistics(text: pa.Array) -> pa.Array:
    columns = np.array([statistics(x) for x in text.to_pylist()], np.int64)
    columns = columns.reshape(-1, len(_NAMES))
    return pa.StructArray.from_arrays(
        [pa.array(columns[:, i]) for i in range(len(_NAMES))], names=_NAMES)


def features(stats: Column) -> dict[str, Column]:
    """What rules may test: counts as shares, never null."""
    def share(part: str, whole: str) -> Column:
        return stats[part] / F.greatest(stats[whole], F.lit(1))

    return {
        "words": stats["n_words"].cast("double"),
        "word_length": share("word_chars", "n_words"),
        "symbol_share": share("n_symbols", "word_chars"),
        "repeated_line_share": share("n_dup_lines", "n_lines"),
        "repeated_word_share": share("n_repeat_words", "n_words"),
        "distinct_share": share("n_distinct", "n_words"),
        "line_words": share("n_words", "n_lines"),
        "upper_share": share("n_upper", "word_chars"),
        "mark_share": share("n_marks", "word_chars"),
        "digit_share": share("n_digits", "word_chars"),
    }


def base_failed(stats: Column) -> Column:
    return (stats["n_words"] < 50) | (100 * stats["n_repeat_words"] > 50 * stats["n_words"])


@dataclass
class Rule:
    """Rejects rows that meet all (feature, is_at_least, threshold) tests."""

    tests: list[tuple[str, bool, float]] = field(default_factory=list)

    def hits(self, table: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(table.values()))), bool)
        for name, at_least, threshold in self.tests:
            out &= table[name] >= threshold if at_least else table[name] < threshold
        return out

    def condition(self, columns: dict[str, Column]) -> Column:
        out = F.lit(True)
        for name, at_least, threshold in self.tests:
            test = columns[name] >= threshold if at_least else columns[name] < threshold
            out = out & test
        return out


def _grow(table, bad: np.ndarray, cuts: dict[str, np.ndarray], depth: int) -> Rule:
    """Add the test with the largest information gain until only bad rows are covered."""
    rule, inside = Rule(), np.ones(len(bad), bool)
    for _ in range(depth):
        p, n = int((inside & bad).sum()), int((inside & ~bad).sum())
        if not p or not n:
            break
        best, gain = None, 1e-9
        before = np.log2(p / (p + n))
        for name, values in table.items():
            for cut in cuts[name]:
                above = values >= cut
                for at_least in (True, False):
                    chosen = inside & (above if at_least else ~above)
                    q = int((chosen & bad).sum())
                    m = int(chosen.sum()) - q
                    if q and (now := q * (np.log2(q / (q + m)) - before)) > gain:
                        best, gain = (name, at_least, float(cut)), now
        if best is None:
            break
        rule.tests.append(best)
        inside &= table[best[0]] >= best[2] if best[1] else table[best[0]] < best[2]
    return rule


def _worth(rule: Rule, table, bad: np.ndarray) -> float:
    hits = rule.hits(table)
    p = int((hits & bad).sum())
    return (2 * p - int(hits.sum())) / max(1, int(hits.sum()))


def learn(
    table: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.95, depth: int = 4,
    most_rules: int = 12,
) -> list[Rule]:
    """Sequential covering: grow a rule on two thirds, prune it on the rest, remove what it covers.

    A rule joins the list only if at least `precision` of the rows it rejects on either part are
    bad, so clean rows stay.
    """
    rules: list[Rule] = []
    cuts = {k: np.unique(np.quantile(v, np.linspace(0.01, 0.99, 50))) for k, v in table.items()}
    left = np.ones(len(bad), bool)
    third = np.arange(len(bad)) % 3 == 2
    for _ in range(most_rules):
        grow = {k: v[left & ~third] for k, v in table.items()}
        prune = {k: v[left & third] for k, v in table.items()}
        grow_bad, prune_bad = bad[left & ~third], bad[left & third]
        if not grow_bad.any() or not prune_bad.any():
            break
        rule = _grow(grow, grow_bad, cuts, depth)
        if not rule.tests:
            break
        while len(rule.tests) > 1:
            shorter = Rule(rule.tests[:-1])
            if _worth(shorter, prune, prune_bad) < _worth(rule, prune, prune_bad):
                break
            rule = shorter
        sound = 2 * precision - 1
        if _worth(rule, prune, prune_bad) < sound or _worth(rule, grow, grow_bad) < sound:
            break
        rules.append(rule)
        left &= ~rule.hits(table)
    return rules


def verdict(rules: list[Rule], stats: Column) -> Column:
    """The ordered list as one conditional expression: the first rule that holds rejects."""
    columns, out = features(stats), None
    for rule in rules:
        condition = rule.condition(columns)
        out = F.when(condition, False) if out is None else out.when(condition, False)
    return F.lit(True) if out is None else out.otherwise(True)


def learn_from(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS):
    """Rules from labelled documents that pass the base rules; 0 in `quality` marks the bad ones."""
    small_batches(documents.sparkSession)
    marked = lowest(
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .where("doc_id is not null and quality is not null"), ["doc_id"], sample_rows)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    stats = F.col("stats")
    rows = (
        texts.join(F.broadcast(marked), "doc_id")  # at most sample_rows rows of two integers
        .select("doc_id", "quality", text_statistics("text").alias("stats"))
        .where(~base_failed(stats))
        .select("doc_id", "quality", *[v.alias(k) for k, v in features(stats).items()])
        .orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample_rows).collect())
    if not rows:
        return []
    names = list(features(F.col("stats")))
    table = {k: np.array([r[k] for r in rows], float) for k in names}
    bad = np.array([r["quality"] == 0 for r in rows])
    return learn(table, bad) if bad.any() and not bad.all() else []


def judged(documents: DataFrame, rules: list[Rule]) -> DataFrame:
    """One row per document with its statistics, base_failed and kept."""
    small_batches(documents.sparkSession)
    stats = F.col("stats")
    return (
        documents.select(F.col("doc_id").cast("long").alias("doc_id"),
                         text_statistics(F.col("text").cast("string")).alias("stats"))
        .select("doc_id", "stats.*", base_failed(stats).alias("base_failed"),
                (~base_failed(stats) & verdict(rules, stats)).alias("kept")))


def keep_good(documents: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows, with all their columns, that neither the base rules nor the list reject."""
    small_batches(documents.sparkSession)
    stats = text_statistics(F.col("text").cast("string"))
    return documents.where(~base_failed(stats) & verdict(rules, stats))
