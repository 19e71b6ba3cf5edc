"""Personal data: fixed patterns, and terms that reveal the protected entities.

The patterns find protected entities (an e-mail address, an IP address, a card or a phone
number).  A term in a document of an entity discloses it when, over the whole corpus, seeing the term says
almost as much as seeing the entity: PMI(term, entity) / IC(entity) with document counts,

    IC(e) = log2(N / df(e))        PMI(t, e) = log2(P(e | t) * N / df(e))

At ``generalise`` of it a term is replaced by a general mark, at ``remove`` it is taken out.
P(e | t) is df(t, e) / df(t), drawn towards independence, df(e) / N, with the weight of
``support`` contexts: no pair is left out for standing in few contexts, it only counts for less.
Copies of one text are one context, so they weigh as one: the words beside the mention tell.
A flagged term goes wherever it stands in the documents of its entity.  Where P(e | t), so drawn,
reaches ``reveal``, the term gives the entity away on its own and goes in every document.

Scale.  Patterns run where a document is read, each in linear time of the text, so very long
runs of digits or letters cost no more than others.  Only documents with entities are kept aside
and only their terms shuffled, those that are too frequent to reach the threshold not beyond a
first count; which documents hold the others is asked of every document, so that those are known in
which a term reveals on its own.  Terms are broadcast only up to ``BROADCAST_TERMS`` after counting them; beyond
that all occurrences are shuffled and joined.  A document of many entities gives each of them with
each of its rare terms.  Tables go as they are consumed; the spans stay.

Defined results.  Null text is empty and has no spans; very long texts are whole.  Spans of one kind
never overlap; spans of different kinds may.  A term is what white space separates, without
punctuation at its ends; where a script writes no spaces that is a whole run.  All rows count, with a
null id too; rows equal in id and text get equal spans.  A term's stronger action holds where two
entities flag it.  An empty table gives none; other columns are ignored, or pass through ``sanitise``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, bound_batches, position

KINDS = ("email", "ip", "card", "phone")
#: Words on either side of a mention that tell its context from others, and the characters searched for them.
WINDOW, REACH = 5, 120
#: Candidate terms sent to all workers at most (8 bytes each).
BROADCAST_TERMS = 1_000_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")  # matches wherever a digit stands, so it never starts again within a run
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_PUNCT = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def emails(text: str) -> list[tuple[int, int]]:
    """Each '@' with its longest local part to the left that the last match leaves free."""
    out, free = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            out.append((start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def ips(text: str) -> list[tuple[int, int]]:
    """Runs of dotted numbers, cut in fours from the left; a four with a part above 255 is dropped."""
    out = []
    for run in _DOTTED.finditer(text):
        if run.group().count(".") < 3:
            continue
        parts, at = run.group().split("."), run.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in four):
                out.append((at, end))
            at = end + 1
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _DIGITS.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 8 <= sum("0" <= c <= "9" for c in m.group()) <= 15]


_FINDERS = (emails, ips, cards, phones)
_HAS_DIGIT = re.compile("[0-9]")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """All spans of the fixed patterns, by kind as listed, then start."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if _HAS_DIGIT.search(text):
        for kind, find in zip(KINDS[1:], _FINDERS[1:], strict=True):
            out += [(kind, a, b) for a, b in find(text)]
    return out


def _hash(value: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(value.encode("utf-8", "surrogatepass")) - (1 << 63)


def term_of(token: str) -> str:
    """A token as a term; empty if it is none (short, or with digits)."""
    term = token.strip(_PUNCT).lower()
    return term if len(term) >= 3 and "@" not in term and not _HAS_DIGIT.search(term) else ""


def entity_of(kind: str, value: str) -> int:
    return _hash(f"{kind}:{value.lower() if kind == 'email' else ''.join(c for c in value if c.isdigit() or c == '.' and kind == 'ip')}")


_TOKEN = re.compile(r"\S+")


def mentions_of(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """(entity, context) of each mention."""
    out = []
    for kind, a, b in spans:
        around = text[max(0, a - REACH) : a].split()[-WINDOW:] + text[b : b + REACH].split()[:WINDOW]
        out.append((entity_of(kind, text[a:b]), _hash(" ".join(around))))
    return out


def occurrences(text: str, spans: list[tuple[str, int, int]]) -> Iterator[tuple[int, int, int]]:
    """(term, start, end) of all terms outside the spans, in order."""
    taken, at, end = sorted((a, b) for _, a, b in spans), 0, 0
    for m in _TOKEN.finditer(text):
        x, y = m.span()
        while at < len(taken) and taken[at][0] < y:
            end = max(end, taken[at][1])
            at += 1
        if end <= x and (term := term_of(token := m.group())):
            yield _hash(term), x + len(token) - len(token.lstrip(_PUNCT)), y - len(token) + len(token.rstrip(_PUNCT))


_MENTIONS = T.ArrayType(T.StructType([T.StructField("entity", T.LongType(), False), T.StructField("near", T.LongType(), False)]), False)
_SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType(), False), T.StructField("start", T.IntegerType(), False), T.StructField("end", T.IntegerType(), False)]), False)
_PA_SPANS = pa.list_(pa.struct([pa.field("kind", pa.string(), False), pa.field("start", pa.int32(), False), pa.field("end", pa.int32(), False)]))
_PA_MENTIONS = pa.list_(pa.struct([pa.field("entity", pa.int64(), False), pa.field("near", pa.int64(), False)]))
_TERMS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType(), False), T.StructField("end", T.IntegerType(), False), T.StructField("action", T.StringType(), False)]), False)


def row_key():
    return F.xxhash64("doc_id", "text")


def doc_key():
    """The id as text; a null id is empty, and told from an empty one by ``row_key``."""
    return F.coalesce(F.col("doc_id").cast("string"), F.lit(""))


def find_base(docs: DataFrame) -> DataFrame:
    """doc_id, row_key, base (spans), mentions, body (the text if it has mentions) of each row."""
    bound_batches(docs.sparkSession)
    source = docs.select("doc_id", row_key().alias("row_key"), "text")
    schema = T.StructType([source.schema["doc_id"], source.schema["row_key"], T.StructField("base", _SPANS, False), T.StructField("mentions", _MENTIONS, False), T.StructField("body", T.StringType())])
    names = ("kind", "start", "end"), ("entity", "near")

    def run(batches):
        for batch in batches:
            base, mentions, body = [], [], []
            for value in batch.column(2):
                text = value.as_py() or ""
                spans = base_spans(text)
                base.append([dict(zip(names[0], s, strict=True)) for s in spans])
                mentions.append([dict(zip(names[1], m, strict=True)) for m in mentions_of(text, spans)])
                body.append(text if spans else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(base, _PA_SPANS), pa.array(mentions, _PA_MENTIONS), pa.array(body, pa.string())], names=schema.names)

    return source.mapInArrow(run, schema)


def held_terms(rows: DataFrame) -> DataFrame:
    """(doc, row_key, base, body) -> doc, row_key, term of each row's distinct terms."""

    def run(batches):
        for batch in batches:
            for doc, key, base, body in zip(*batch.columns, strict=True):
                terms = sorted({t for t, _, _ in occurrences(body.as_py(), [tuple(s.values()) for s in base.as_py()])})
                yield pa.RecordBatch.from_arrays([pa.array([doc.as_py()] * len(terms), pa.string()), pa.array([key.as_py()] * len(terms), pa.int64()), pa.array(terms, pa.int64())], names=["doc", "row_key", "term"])

    return rows.select("doc", "row_key", "base", "body").mapInArrow(run, "doc string, row_key long, term long").distinct()


def sent(terms: DataFrame, *columns: str) -> dict[str, np.ndarray] | None:
    """These columns of the terms, to be broadcast; None if there are more than ``BROADCAST_TERMS``."""
    if terms.limit(BROADCAST_TERMS + 1).count() > BROADCAST_TERMS:
        return None
    got = terms.select(*columns).toArrow()
    return {c: got.column(c).to_numpy(zero_copy_only=False) for c in columns}


class TermsOf:
    """token -> hash of its term, None if it is none or not among the wanted ones; remembers what it has seen."""

    def __init__(self, wanted=None, most: int = 300_000):
        self.wanted, self.most, self.known = wanted, most, {}

    def __call__(self, text: str) -> set[int]:
        known, out = self.known, set()
        for token in set(text.split()):
            h = known.get(token, 0)
            if h == 0:
                term = term_of(token)
                h = _hash(term) if term else None
                if h is not None and self.wanted is not None and h not in self.wanted:
                    h = None
                if len(known) > self.most:
                    known.clear()
                if len(token) <= 64:
                    known[token] = h
            if h is not None:
                out.add(h)
        return out


def holders(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, row_key): which rows of all documents hold which of the given distinct terms."""
    few = sent(terms, "term")
    wanted = None if few is None else docs.sparkSession.sparkContext.broadcast(np.sort(few["term"]))

    def run(batches):
        terms_of = TermsOf(None if wanted is None else set(wanted.value.tolist()))
        for batch in batches:
            found, keys = [], []
            for key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = terms_of(text or "")
                found += own
                keys += [key] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(keys, pa.int64())], names=["term", "row_key"])

    held = docs.select(row_key().alias("row_key"), "text").mapInArrow(run, "term long, row_key long")
    return held if wanted is not None else held.join(terms, "term", "left_semi")


def disclosing_terms(docs: DataFrame, found: DataFrame, t: Scratch, generalise: float = 0.8, remove: float = 0.95, support: int = 2, reveal: float = 0.5) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The pairs above the disclosure thresholds.

    The distinct rows with entities; (doc, row_key, flags) of the terms that go beside their own; (term,
    action) of those that reveal an entity in other documents; and the row_key of all documents with such a term.
    """
    total, row = docs.count(), ["doc", "row_key"]
    rows = found.where(F.size("mentions") > 0).withColumn("doc", doc_key())
    # rows equal in id and text are one here, and count as often as they stand in the table
    rows = t.write(rows.groupBy(*row).agg(F.first("base").alias("base"), F.first("mentions").alias("mentions"), F.first("body").alias("body"), F.count("*").alias("rows")), "entity-rows")
    # one context a document, however often it mentions the entity
    mentions = rows.select(*row, "rows", F.explode("mentions").alias("m")).groupBy(*row, "rows", F.col("m.entity").alias("entity")).agg(F.min("m.near").alias("near"))
    # P(e | t) is at most df_both / df_term, so a term of more documents than ``most`` can't reach the threshold
    most = F.col("df_entity") * F.pow(F.lit(total) / F.col("df_entity"), F.lit(1 - generalise)) * 1.000001
    entities = mentions.groupBy("entity").agg(F.sum("rows").alias("df_entity")).withColumn("most", most)
    mentions = t.write(mentions.join(entities, "entity"), "mentions")
    bounds = mentions.groupBy(*row).agg(F.max("most").alias("bound"))
    held = t.write(held_terms(rows), "held")
    least = held.join(rows.select(*row, "rows"), row).groupBy("term").agg(F.sum("rows").alias("df_least"))
    rare = t.write(held.join(least, "term").join(bounds, row).where(F.col("df_least") <= F.col("bound")).select(*row, "term", "bound"), "rare")
    terms = t.write(rare.select("term").distinct(), "terms")
    held_by = t.write(holders(docs, terms) if not terms.isEmpty() else rare.select("term", "row_key"), "holders")
    counts = held_by.groupBy("term").agg(F.count("*").alias("df_term"))
    counted = rare.join(counts, "term").where(F.col("df_term") <= F.col("bound"))
    pairs = t.write(counted.join(mentions, row).where(F.col("df_term") <= F.col("most")).select(*row, "rows", "entity", "term", "near", "df_term", "df_entity"), "pairs")
    joint = pairs.groupBy("entity", "term", "df_term", "df_entity").agg(F.sum("rows").alias("df_both"), F.count_distinct("near").alias("contexts"))
    # documents of the term in the measure of contexts, in which copies are one
    seen = F.col("contexts") * F.col("df_term") / F.col("df_both")
    given = (F.col("contexts") + support * F.col("df_entity") / F.lit(total)) / (seen + support)
    ratio = F.log2(F.lit(total) * F.col("given") / F.col("df_entity")) / F.greatest(F.log2(F.lit(total) / F.col("df_entity")), F.lit(1e-9))
    flagged = joint.withColumn("given", given).withColumn("ratio", ratio).where(F.col("ratio") >= generalise)
    action = F.when(F.col("ratio") >= remove, "remove").otherwise("generalise").alias("action")
    flagged = t.write(flagged.select("entity", "term", action, ((F.col("given") >= reveal) & (F.col("df_term") > F.col("df_both"))).alias("alone")), "flagged")
    # of two actions "remove", the later by name, is the stronger
    alone = t.write(flagged.where("alone").groupBy("term").agg(F.max("action").alias("action")), "alone")
    where_alone = t.write(held_by.join(alone, "term", "left_semi").select("row_key").distinct(), "where-alone")
    beside = pairs.select(*row, "entity", "term").join(flagged, ["entity", "term"]).groupBy(*row, "term").agg(F.max("action").alias("action"))
    beside = t.write(beside.groupBy(*row).agg(F.collect_list(F.struct("term", "action")).alias("flags")), "beside")
    t.drop("mentions", "held", "rare", "terms", "pairs", "flagged", "holders")
    return rows, beside, alone, where_alone


_PLACES = "doc string, row_key long, start int, end int, action string"


def _placed(found: list[tuple]) -> pa.RecordBatch:
    """(doc, row_key, start, end, action) rows."""
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.string())
    columns = list(zip(*found, strict=True)) or [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc", "row_key", "start", "end", "action"])


def places_beside(rows: DataFrame, beside: DataFrame) -> DataFrame:
    """Where the flagged terms of a row's own entities stand."""
    joined = rows.join(beside, ["doc", "row_key"]).select("doc", "row_key", "base", "body", "flags")

    def run(batches):
        for batch in batches:
            out = []
            for doc, key, base, body, flags in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                action = {f["term"]: f["action"] for f in flags}
                out += [(doc, key, x, y, action[h]) for h, x, y in occurrences(body, [tuple(s.values()) for s in base]) if h in action]
            yield _placed(out)

    return joined.mapInArrow(run, _PLACES)


def places_alone(docs: DataFrame, alone: DataFrame, where: DataFrame) -> DataFrame:
    """Where in the documents that hold them (``where``) the terms stand that reveal an entity on their own."""
    few = sent(alone, "term", "action")
    wanted = None if few is None else docs.sparkSession.sparkContext.broadcast(dict(zip(few["term"].tolist(), few["action"].tolist(), strict=True)))
    where = where.select(F.col("row_key").alias("_w"))
    where = F.broadcast(where) if where.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS else where
    source = docs.select(doc_key().alias("doc"), row_key().alias("row_key"), "text").join(where, F.col("row_key") == F.col("_w"), "left_semi")

    def run(batches):
        action = None if wanted is None else wanted.value
        for batch in batches:
            out = []
            for doc, key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = occurrences(text or "", base_spans(text or ""))
                out += [(doc, key, x, y, str(h) if action is None else action[h]) for h, x, y in found if action is None or h in action]
            yield _placed(out)

    placed = source.mapInArrow(run, _PLACES)
    if wanted is not None:
        return placed
    named = alone.select(F.col("term").cast("string").alias("_term"), F.col("action").alias("_action"))
    return placed.join(named, F.col("action") == F.col("_term")).select("doc", "row_key", "start", "end", F.col("_action").alias("action"))


def find_spans(docs: DataFrame, **thresholds) -> DataFrame:
    """doc_id, row_key, base, terms (array of start, end, action) of each row."""
    t = Scratch(docs.sparkSession, "pii")
    found = t.write(find_base(docs), "base")
    rows, beside, alone, where = disclosing_terms(docs, found, t, **thresholds)
    places = places_beside(rows, beside)
    if not alone.isEmpty():
        places = places.unionByName(places_alone(docs, alone, where))
    places = places.groupBy("doc", "row_key", "start", "end").agg(F.max("action").alias("action"))
    places = places.groupBy(F.col("doc").alias("_d"), F.col("row_key").alias("_k")).agg(F.sort_array(F.collect_list(F.struct("start", "end", "action"))).alias("_terms"))
    joined = found.join(places, (doc_key() == F.col("_d")) & (F.col("row_key") == F.col("_k")), "left")
    out = t.write(joined.select("doc_id", "row_key", "base", F.coalesce("_terms", F.array().cast(_TERMS)).alias("terms")), "spans")
    t.drop("base", "entity-rows", "alone", "where-alone", "beside")
    return out


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """Replaces spans from the left; of overlapping ones the first, longest gives the mark of all."""
    out, at, end, mark = [], 0, -1, ""
    for a, b, m in sorted(spans, key=lambda s: (s[0], -s[1])):
        if a < end:
            end = max(end, b)
            continue
        if end >= 0:
            out.append(mark)
            at = end
        out.append(text[at:a])
        end, mark = b, m
        at = a
    if end >= 0:
        out.append(mark)
        at = end
    return "".join(out) + text[at:]


def sanitise(docs: DataFrame, **thresholds) -> DataFrame:
    """``docs`` with its texts sanitised; all columns stay.  Null texts stay null."""
    spans = find_spans(docs, **thresholds).where((F.size("base") > 0) | (F.size("terms") > 0))
    # rows equal in id and text have equal spans; one of them is enough to join
    spans = spans.groupBy(F.col("doc_id").alias("__id"), F.col("row_key").alias("__row")).agg(F.first("base").alias("__base"), F.first("terms").alias("__terms"))
    columns = docs.columns
    joined = docs.withColumn("__key", row_key()).join(spans, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__row")), "left")
    source = joined.select(*columns, "__base", "__terms")
    where = position(columns, "text")
    schema = T.StructType(source.schema.fields[:-2])

    def run(batches):
        for batch in batches:
            texts = []
            for value, base, terms in zip(batch.column(where), batch.column(len(columns)), batch.column(len(columns) + 1), strict=True):
                text = value.as_py()
                if text and base.is_valid:
                    marks = [(s["start"], s["end"], f"[{s['kind'].upper()}]") for s in base.as_py()]
                    marks += [(s["start"], s["end"], "[TERM]" if s["action"] == "generalise" else "") for s in terms.as_py() or []]
                    text = redact(text, marks)
                texts.append(text)
            arrays = list(batch.columns[: len(columns)])
            arrays[where] = pa.array(texts, batch.column(where).type)
            yield pa.RecordBatch.from_arrays(arrays, names=columns)

    return source.mapInArrow(run, schema)


def digest(spans: DataFrame) -> DataFrame:
    """The columns that the query returns, from ``find_spans``."""

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.array_join(F.transform("base", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    more = F.transform("terms", lambda s: F.concat_ws(":", F.lit("term"), s["start"], s["end"]))
    every = F.concat(F.transform("base", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), more)
    return spans.select("doc_id", *[count(k) for k in KINDS], F.sha2(base.cast("binary"), 256).alias("base_sha256"), F.array_join(every, ",").alias("spans"))
