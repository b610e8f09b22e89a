"""Label cleaning, tokens and lexical likeness, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words and phrases that say nothing in a label, and words that carry clinical meaning.
FILLERS = ["and", "or", "nos", "nec", "not otherwise specified", "not elsewhere classified", "of", "the", "in", "due to", "type"]
CLINICAL = ["with", "without", "not", "no", "nor", "other", "due", "in", "of", "against", "between", "during", "before", "after", "above", "below", "under", "over", "further"]


def squish(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def clean(text: Column) -> Column:
    """Lower case; all but a-z, 0-9 and white space to spaces; single spaces."""
    return squish(F.regexp_replace(F.lower(text), r"[^a-z0-9\s]", " "))


def strip_fillers(text: Column, fillers: list[str] = FILLERS) -> Column:
    """Lower case without the phrases, on word boundaries, longest first."""
    out = F.lower(text)
    for phrase in sorted(fillers, key=lambda w: (-len(w), w)):
        out = F.regexp_replace(out, r"\b" + phrase.replace(" ", r"\s+") + r"\b", " ")
    return squish(out)


def label_text(code: Column, label: Column, *, with_code: bool = True, strip: bool = False) -> Column:
    text = strip_fillers(clean(label)) if strip else clean(label)
    return F.concat_ws(" ", code, text) if with_code else text


def tokens(text: Column) -> Column:
    """Distinct non-empty tokens in order."""
    return F.array_remove(F.array_distinct(F.split(F.regexp_replace(F.lower(text), r"[^a-z0-9 ]", " "), r"\s+")), "")


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def overlap(a: Column, b: Column) -> Column:
    least = F.least(F.size(a), F.size(b))
    return F.when(least == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / least)


def first_token_equal(a: Column, b: Column) -> Column:
    return F.coalesce((F.get(a, F.lit(0)) == F.get(b, F.lit(0))).cast("int"), F.lit(0))


def edit_distance(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def number_part(code: Column) -> Column:
    return F.regexp_replace(code, "[^0-9]", "").try_cast("int")


def letter_part(code: Column) -> Column:
    return F.regexp_replace(code, "[^A-Za-z]", "")
