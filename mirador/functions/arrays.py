"""Training-side arithmetic over arrays, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IGNORED = -100


def label_mask(ids: Column, prompt_len: Column, pad_id: Column) -> Column:
    """ids with the prompt and every pad replaced by -100."""
    return F.transform(ids, lambda v, i: F.when((i < prompt_len) | (v == pad_id), F.lit(IGNORED)).otherwise(v))


def prompt_length(attention_mask: Column) -> Column:
    return F.aggregate(attention_mask, F.lit(0), lambda a, x: a + x.cast("int"))


def log_sum_exp(logits: Column) -> Column:
    top = F.array_max(logits).cast("double")
    return top + F.log(F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x.cast("double") - top)))


def log_softmax(logits: Column) -> Column:
    """All components' log-probabilities; the sum over them is made once."""
    bound = F.transform(F.array(log_sum_exp(logits)), lambda s: F.transform(logits, lambda v: v.cast("double") - s))
    return F.get(bound, F.lit(0))


def completion_logprob(logits: Column, ids: Column, attention_mask: Column, prompt_len: Column) -> Column:
    """Summed log-softmax of the tokens after the prompt; row t of logits predicts token t + 1; pads count nothing."""
    each = F.transform(F.sequence(F.lit(1), F.size(ids) - 1), lambda t: F.when((t - 1 >= F.greatest(prompt_len - 1, F.lit(0))) & (F.get(attention_mask, t) == 1), F.get(F.get(logits, t - 1), F.get(ids, t)).cast("double") - log_sum_exp(F.get(logits, t - 1))).otherwise(F.lit(0.0)))
    return F.when(F.size(ids) < 2, F.lit(0.0)).otherwise(F.aggregate(each, F.lit(0.0), lambda a, x: a + x))


def preference_loss(policy_chosen: Column, policy_rejected: Column, reference_chosen: Column, reference_rejected: Column, beta: float) -> Column:
    """-log sigmoid(beta * margin) of one pair, stable for any margin."""
    x = F.lit(beta) * ((policy_chosen - policy_rejected) - (reference_chosen - reference_rejected))
    return F.greatest(-x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def interpolate(x: Column, xs: Column, ys: Column) -> Column:
    """Piecewise-linear through the points (xs, ys), xs rising, constant beyond the ends; null stays null and NaN NaN."""
    n = F.size(xs)
    at = F.size(F.filter(xs, lambda v: v <= x))
    x0, x1 = F.get(xs, at - 1), F.get(xs, at)
    y0, y1 = F.get(ys, at - 1), F.get(ys, at)
    return F.when(x.isNull() | F.isnan(x), x).when(at <= 0, F.get(ys, F.lit(0))).when(at >= n, F.get(ys, n - 1)).otherwise(y0 + (y1 - y0) * (x - x0) / (x1 - x0))
