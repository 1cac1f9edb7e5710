"""What a question must be like before anything is searched for it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern import errors

# Bounds of a request.
LONGEST_QUESTION, MOST_RESULTS = 2_000, 50
LANGUAGES = ("fa", "en", "mixed")


def request_error(question: Column, terms: Column, top_k: Column | None = None, language: Column | None = None) -> Column:
    """Code of what is wrong with a request, or null: bounds first, then whether the question holds any term.

    A null top_k or language stands for the default; a null question is not valid.
    """
    wrong = question.isNull() | ~F.length(question).between(1, LONGEST_QUESTION)
    if top_k is not None:
        wrong = wrong | (top_k.isNotNull() & ~top_k.between(1, MOST_RESULTS))
    if language is not None:
        wrong = wrong | (language.isNotNull() & ~language.isin(*LANGUAGES))
    return F.when(wrong, errors.VALIDATION_ERROR).when(F.size(terms) == 0, errors.INVALID_QUESTION)
