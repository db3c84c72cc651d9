"""Scores of answers and responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def exact_match(prediction: Column, answer: Column, norm=T.normal_answer) -> Column:
    return norm(prediction) == norm(answer)


def alias_match(prediction: Column, answers: Column, norm=T.normal_answer) -> Column:
    """Whether a prediction equals any answer that is not empty."""
    return F.coalesce(T.let(norm(prediction), lambda p: (p != "") & F.array_contains(F.transform(answers, norm), p)), F.lit(False))


def _words(tokens: Column) -> Column:
    return F.filter(F.split(tokens, " "), lambda w: w != "")


def token_f1(prediction: Column, answer: Column, norm=T.normal_answer) -> Column:
    """F1 of two multisets of words, row-locally; both empty: 1, one empty: 0."""

    def of(p: Column, a: Column) -> Column:
        common = F.aggregate(F.array_distinct(p), F.lit(0), lambda n, w: n + F.least(F.size(F.filter(p, lambda x: x == w)), F.size(F.filter(a, lambda x: x == w))))
        n = F.size(p) + F.size(a)
        return T.let(common, lambda c: F.when(n == 0, 1.0).when(c == 0, 0.0).otherwise(2.0 * c / n))

    return T.let(_words(norm(prediction)), lambda p: T.let(_words(norm(answer)), lambda a: of(p, a)))


def best_f1(prediction: Column, answers: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(answers, lambda a: token_f1(prediction, a))), F.lit(0.0))


def expected_action(state: Column) -> Column:
    return F.when(state == "MISSING", "REQUEST_INFORMATION").when(state == "CONFLICT", "REQUEST_CONFIRMATION").otherwise("ANSWER")


def first_error(parsed_action: Column, expected: Column, correct: Column) -> Column:
    """FORMAT_ERROR, OK, ACTION_ERROR, or ACTION_ERROR_DIRECT_CORRECT for a direct answer that is right."""
    return F.when(parsed_action.isNull(), "FORMAT_ERROR").when(parsed_action == expected, "OK").when((parsed_action == "ANSWER") & F.coalesce(correct, F.lit(False)), "ACTION_ERROR_DIRECT_CORRECT").otherwise("ACTION_ERROR")


def full_error(parsed_action: Column, correct: Column) -> Column:
    return F.when(parsed_action.isNull(), "FORMAT_ERROR").when(parsed_action != "ANSWER", "ACTION_ERROR").when(F.coalesce(correct, F.lit(False)), "OK").otherwise("ANSWER_ERROR")


def recall(said: Column, reference: Column) -> Column:
    """The part of the reference's content words that is said; NULL without any."""
    r = T.content_words(reference)
    return F.when(F.size(r) > 0, F.size(F.array_intersect(r, T.content_words(said))) / F.size(r))


def mention_label(matched: Column, mentioned: Column) -> Column:
    """GAP_MATCH for a mention or two matched words, GAP_PARTIAL for one, else GAP_MISMATCH."""
    return F.when(mentioned | (matched >= 2), "GAP_MATCH").when(matched == 1, "GAP_PARTIAL").otherwise("GAP_MISMATCH")


def stage_pass(calls: DataFrame, by: list[str], want_correct: Column) -> DataFrame:
    """Per sample and stage: whether all its calls ended well with the wanted outcome; absent calls give no row."""
    good = F.coalesce((F.col("status") == "SUCCESS") & (F.col("answer_correct") == want_correct), F.lit(False))
    return calls.groupBy(*by).agg(F.min(good).alias("passed"), F.count(F.lit(1)).alias("calls"))
