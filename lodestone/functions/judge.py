"""Judging of answers: correctness by containment or similarity, refusals, robustness."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.text import is_refusal, normalize_answer

# The kinds of documents given with a question.
EMPTY, TRUTH, SIMILAR, DIFFERENT, REAL = "empty", "ground-truth-docs", "lexical-similar-no-answer-docs", "lexical-diff-with-answer-docs", "real-world-docs"


#: The similarity from which answers count as alike.
ALIKE = 0.9


def within(said: Column, truth: Column, empty_is_correct: bool = True) -> Column:
    """contained, of texts that are normalised already."""
    hit = F.contains(said, truth) | F.contains(truth, said)
    return F.coalesce(hit if empty_is_correct else hit & (said != "") & (truth != ""), F.lit(False))


def contained(prediction: Column, truth: Column, empty_is_correct: bool = True) -> Column:
    """One normalised text contains the other. An empty one is contained in any, unless told otherwise."""
    return within(normalize_answer(prediction), normalize_answer(truth), empty_is_correct)


def dot(a: Column, b: Column) -> Column:
    """The dot product of float arrays, summed in doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def is_correct(prediction: Column, truth: Column, similarity: Column | None = None, threshold: float = ALIKE) -> Column:
    """contained, or a similarity, computed before for the rows that need it, of at least threshold."""
    hit = contained(prediction, truth)
    return hit if similarity is None else hit | F.coalesce(similarity >= threshold, F.lit(False))


def says_nothing(prediction: Column, correct: Column) -> Column:
    return ~correct & is_refusal(prediction)


def is_robust(correct: Column, no_info: Column, knows: Column, doc_kind: Column) -> Column:
    """A model that knows the answer must be right; else it must be right with the answer's documents, refuse without the answer, and either in the wild."""
    return (
        F.when(knows, correct)
        .when(doc_kind.isin(TRUTH, DIFFERENT), correct)
        .when(doc_kind == SIMILAR, no_info)
        .when(doc_kind == REAL, correct | no_info)
        .otherwise(False)
    )
