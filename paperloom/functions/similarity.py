"""Character-set similarity of two texts."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def character_set(text: Column) -> Column:
    """Distinct lower-cased letters and digits of a text."""
    kept = F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))
    return F.filter(F.array_distinct(F.split(kept, "")), lambda c: c != "")


@F.pandas_udf(T.StringType())
def _character_key(texts: pd.Series) -> pd.Series:
    kept: dict[str, str] = {}

    def key(text: str) -> str:
        if "Σ" in text:  # the one letter whose lower case depends on what stands around it
            text = "".join(c for c in text if unicodedata.category(c)[0] in "LN").lower()
        chars = set(text)
        for c in chars - kept.keys():
            kept[c] = c.lower() if unicodedata.category(c)[0] in "LN" else ""
        return "".join(sorted(set("".join(kept[c] for c in chars))))

    return texts.map(key, na_action="ignore")


def character_key(text: Column) -> Column:
    """The character set as one short string, in order: equal keys are equal sets."""
    return _character_key(text)


def set_similarity(a: Column, b: Column, text_a: Column, text_b: Column) -> Column:
    """Jaccard of two character sets; an empty text is like nothing, two sets without characters are equal."""
    common = F.size(F.array_intersect(a, b))
    return (
        F.when((F.length(text_a) == 0) | (F.length(text_b) == 0), 0.0)
        .when((F.size(a) == 0) & (F.size(b) == 0), 1.0)
        .when((F.size(a) == 0) | (F.size(b) == 0), 0.0)
        .otherwise(common / (F.size(a) + F.size(b) - common))
    )


def text_similarity(a: Column, b: Column) -> Column:
    return set_similarity(character_set(a), character_set(b), a, b)
