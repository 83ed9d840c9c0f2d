"""Array functions: messages, token ids, vectors and logits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnloom import fixed


# --- elements ---

def last(items: Column) -> Column:
    return F.try_element_at(items, F.lit(-1))


def all_but_last(items: Column) -> Column:
    return F.slice(items, F.lit(1), F.greatest(F.size(items) - 1, F.lit(0)))


def suffix(items: Column, length: Column) -> Column:
    """The last ``length`` elements."""
    return F.slice(items, F.size(items) - length + 1, length)


def tail_after(items: Column, length: Column) -> Column:
    """Everything after the first ``length`` elements."""
    return F.slice(items, length + 1, F.greatest(F.size(items) - length, F.lit(0)))


def starts_with(full: Column, prefix: Column) -> Column:
    return F.slice(full, F.lit(1), F.size(prefix)) == prefix


# --- stop tokens ---

def stop_position(tokens: Column, stops: Sequence[int]) -> Column:
    """Number of tokens before the first stop token; all of them if there is none."""
    at = F.array_position(F.transform(tokens, lambda t: t.isin(*stops)), F.lit(True))
    return F.when(at > 0, at - 1).otherwise(F.size(tokens)).cast("int")


def cut_at_stop(tokens: Column, stops: Sequence[int]) -> Column:
    return F.slice(tokens, F.lit(1), stop_position(tokens, stops))


def hit_token_limit(tokens: Column, stops: Sequence[int], cap: int) -> Column:
    return (stop_position(tokens, stops) == F.size(tokens)) & (F.size(tokens) == cap)


# --- vectors ---

def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(left: Column, right: Column) -> Column:
    return total(F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double")))


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(
        vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def all_finite(values: Column) -> Column:
    return F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def log_sum_exp(values: Column) -> Column:
    top = F.array_max(values)
    return top + F.log(total(F.transform(values, lambda x: F.exp(x - top))))


def softmax(values: Column) -> Column:
    top = F.array_max(values)
    shifted = F.transform(values, lambda x: F.exp(x - top))
    mass = total(shifted)
    return F.transform(shifted, lambda x: x / mass)


def argmax(values: Column) -> Column:
    """Zero-based position of the largest value; the first one on ties."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def letter(index: Column, letters: str = fixed.LETTERS) -> Column:
    return F.substring(F.lit(letters), index + 1, F.lit(1))
