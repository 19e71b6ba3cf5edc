"""Paragraph identity: which stored paragraph an HTML element is.

Exact text first, then the most similar text above a threshold.  Similarity looks at character
sets only, so all work is on distinct sets, held as short strings: texts that share a set are compared
once.  A set meets those of a size that can reach the threshold (an equi-join, no cross join), of
these only the ones that a comparison of bitmaps leaves are scored, and texts are never joined on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import character_key
from ..functions.text import strip

THRESHOLD = 0.8


def _keys(left: DataFrame, right: DataFrame, by: list[str]) -> Column | None:
    cond = None
    for c in by:
        term = left[c].eqNullSafe(right[f"_b_{c}"])
        cond = term if cond is None else cond & term
    return cond


def text_index(paragraphs: DataFrame, by: list[str]) -> DataFrame:
    """Build side: stripped text -> the last paragraph with it, at the position of the first; blank ones go."""
    texts = paragraphs.withColumn("_text", strip(F.col("text"))).where(F.col("_text") != "")
    return texts.groupBy(*by, "_text").agg(F.max_by("para_id", "ord").alias("para_id"), F.min("ord").alias("pos"))


def exact_match(elements: DataFrame, paragraphs: DataFrame, by: list[str]) -> DataFrame:
    """Adds ``match`` (para_id) where the element's stripped text is a paragraph's."""
    index = text_index(paragraphs, by).select(*[F.col(c).alias(f"_b_{c}") for c in by], F.col("_text").alias("_b_text"), F.col("para_id").alias("match"))
    same = strip(F.col("text")) == F.col("_b_text")
    keys = _keys(elements, index, by)
    return elements.join(index, same if keys is None else keys & same, "left").select(*elements.columns, "match")


#: 64-bit words of the bitmap of a set.
BITMAP = 2


def bitmap(key: Column) -> list[Column]:
    """A set as ``BITMAP`` words with the bits that its characters hash to."""

    def word(part: int) -> Column:
        def bit(c: Column) -> Column:
            place = F.pmod(F.floor(F.ascii(c) / BITMAP), F.lit(64)).cast("int")
            return F.when(F.pmod(F.ascii(c), F.lit(BITMAP)) == part, F.call_function("shiftleft", F.lit(1).cast("long"), place)).otherwise(F.lit(0).cast("long"))

        return F.aggregate(F.filter(F.split(key, ""), lambda c: c != ""), F.lit(0).cast("long"), lambda a, c: a.bitwiseOR(bit(c)))

    return [word(i) for i in range(BITMAP)]


def _only(a: list[Column], b: list[Column]) -> Column:
    """How many bits are in a and not in b: so many elements at least are in a's set alone."""
    total = F.lit(0)
    for x, y in zip(a, b, strict=True):
        total = total + F.bit_count(x.bitwiseAND(F.bitwise_not(y)))
    return total


def similar_sets(asked: DataFrame, sets: DataFrame, by: list[str], threshold: float) -> DataFrame:
    """asked (by.., chars), sets (by.., chars, id, pos), each distinct -> by.., chars, match, score: the best above
    the threshold, of equal scores the one with the smallest pos."""
    words = [f"_w{i}" for i in range(BITMAP)]
    left = asked.withColumn("n", F.length("chars")).withColumns(dict(zip(words, bitmap(F.col("chars")), strict=True)))
    right = sets.select(*[F.col(c).alias(f"_b_{c}") for c in by], F.col("chars").alias("_bc"), F.length("chars").alias("_bn"), "id", "pos", *[w.alias(f"_b{n}") for n, w in zip(words, bitmap(F.col("chars")), strict=True)])
    # sizes that can be reached: common / union > t needs t * n < m < n / t; two empty sets are equal
    low, high = F.floor(F.col("n") * F.lit(threshold)).cast("int"), F.ceil(F.col("n") / F.lit(threshold)).cast("int")
    sized = left.withColumn("_m", F.explode(F.sequence(low, high)))
    keys, size = _keys(sized, right, by), F.col("_m") == F.col("_bn")
    mine, other = [F.col(w) for w in words], [F.col(f"_b{w}") for w in words]
    most = F.least(F.col("n") - _only(mine, other), F.col("_bn") - _only(other, mine))  # no more can be common
    near = (F.col("n") == 0) | (most > F.lit(threshold) * (F.col("n") + F.col("_bn") - most))
    pairs = sized.join(right, (size if keys is None else keys & size) & near)
    # characters that go when those of the other set are taken out
    common = F.col("n") - F.length(F.call_function("translate", F.col("chars"), F.col("_bc"), F.lit("")))
    score = F.when(F.col("n") == 0, 1.0).otherwise(common / (F.col("n") + F.col("_bn") - common))
    scored = pairs.withColumn("score", score).where(F.col("score") > threshold)
    best = scored.groupBy(*by, "chars").agg(F.min(F.struct((-F.col("score")).alias("neg"), "pos", "id")).alias("_best"))
    return best.select(*by, "chars", F.col("_best.id").alias("match"), (-F.col("_best.neg")).alias("score"))


def most_similar(probes: DataFrame, builds: DataFrame, by: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """probes (by.., text, ..), builds (by.., text, id, pos) -> the probes that match, with match and score.

    The best score above the threshold; of equal scores the smallest pos.  Empty texts match nothing.
    """
    keyed = probes.where(F.length("text") > 0).withColumn("_chars", character_key(F.col("text")))
    sets = builds.where(F.length("text") > 0).select(*by, character_key(F.col("text")).alias("chars"), F.struct("pos", "id").alias("_first"))
    sets = sets.groupBy(*by, "chars").agg(F.min("_first").alias("_first")).select(*by, "chars", "_first.id", "_first.pos")
    best = similar_sets(keyed.select(*by, F.col("_chars").alias("chars")).distinct(), sets, by, threshold)
    best = best.select(*[F.col(c).alias(f"_b_{c}") for c in by], F.col("chars").alias("_bc"), "match", "score")
    keys, same = _keys(keyed, best, by), F.col("_chars") == F.col("_bc")
    return keyed.join(best, same if keys is None else keys & same).select(*probes.columns, "match", "score")


def assign_ids(elements: DataFrame, paragraphs: DataFrame, by: list[str], threshold: float = THRESHOLD, exact_only: Column | None = None) -> DataFrame:
    """Adds ``match``: an element's own id, else the exact match, else the most similar one.

    elements: by.., text, id (null or empty without one).  Several elements may get one paragraph.
    Elements for which ``exact_only`` holds are not matched by likeness.
    """
    has = F.coalesce(F.col("id"), F.lit("")) != ""
    exact = exact_match(elements, paragraphs, by)
    ask = F.col("match").isNull() & ~has & (strip(F.col("text")) != "")
    if exact_only is not None:
        ask = ask & ~exact_only
    exact = exact.withColumn("_chars", character_key(F.when(ask, strip(F.col("text")))))
    builds = text_index(paragraphs, by).select(*by, character_key(F.col("_text")).alias("chars"), F.struct("pos", F.col("para_id").alias("id")).alias("_first"))
    builds = builds.groupBy(*by, "chars").agg(F.min("_first").alias("_first")).select(*by, "chars", "_first.id", "_first.pos")
    asked = exact.where(F.col("_chars").isNotNull()).select(*by, F.col("_chars").alias("chars")).distinct()
    near = similar_sets(asked, builds, by, threshold)
    near = near.select(*[F.col(c).alias(f"_b_{c}") for c in by], F.col("chars").alias("_bc"), F.col("match").alias("_near"))
    keys, same = _keys(exact, near, by), F.col("_chars") == F.col("_bc")
    joined = exact.join(near, same if keys is None else keys & same, "left")
    return joined.select(*elements.columns, F.when(has, F.col("id")).otherwise(F.coalesce("match", "_near")).alias("match"))
