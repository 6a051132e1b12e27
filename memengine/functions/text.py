"""Text expressions: normal forms, keys and hashes, buckets, markers, signals."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memengine.config import PREDICATE

# Contractions, in the order in which they are rewritten.
CONTRACTIONS = [
    (r"i\s*m", "i'm"), ("dont", "don't"), ("cant", "can't"), ("wont", "won't"), ("doesnt", "doesn't"),
    ("didnt", "didn't"), ("im", "i'm"), ("ive", "i've"), ("ill", "i'll"),
]
# What puts a text into a temporal bucket, first match first.
BUCKETS = [
    ("transition", r"(used to|no longer|not anymore|but now|now i)"),
    ("future", r"(planning to|going to|will|intend to|next\s+month|next\s+year)"),
    ("past", r"(formerly|previously|ago|last\s+week|yesterday)"),
    ("current", r"(today|currently|now|this\s+week)"),
]
# Temporal markers, their kind and confidence.
MARKERS = [
    ("used to", "past", 0.9), ("previously", "past", 0.85), ("before", "past", 0.7), ("formerly", "past", 0.85), ("last (?:time|week|month|year|decade)", "past", 0.75),
    ("no longer", "change", 0.9), ("not anymore", "change", 0.85), ("stopped", "change", 0.8), ("quit", "change", 0.75), ("left", "change", 0.7), ("moved (?:to|from)", "change", 0.85),
    ("actually", "correction", 0.6), ("wait", "correction", 0.65), ("sorry", "correction", 0.5), ("correction", "correction", 0.9), ("my (?:former|ex|late)", "former", 0.85),
]
# Words that tell what a change is about, first match first.
CHANGES = [
    ("location", r"\b(live|living|address|city|country|home|move)"),
    ("profession", r"\b(work|job|career|company|role|title|position|employ)"),
    ("preference", r"\b(like|love|hate|prefer|favorite|enjoy)"),
    ("identity", r"\b(name|age|gender|pronoun|married|single)"),
]
# Markers that the risk check and the fallback trigger look for.
RISK_MARKERS = r"(used to|no longer|not anymore|formerly|previously|currently|today|yesterday|tomorrow|last\s+week|next\s+week|now)"
TRIGGER_MARKERS = r"(used to|no longer|not anymore|formerly|previously|currently|now|last\s+week|next\s+week)"
# First person, words of personal facts, pronouns.
FIRST_PERSON = r"(?:\bi\b|\bim\b|\bi'm\b|\bi\s+am\b|\bmy\b|\bwe\b|\bour\b)"
FACT_CUES = (
    r"(?:\bname\s+is\b|\bcall\s+me\b|\bi(?:'m|\s+am|m)\b|\bmarried\b|\bsingle\b|\bwife\b|\bhusband\b|\bpartner\b|\blive\s+in\b|\bfrom\b|\bstudy\b|\bstudied\b"
    r"|\bwork\s+as\b|\bwork\s+at\b|\blove\b|\blike\b|\bprefer\b|\bfavorite\b|\bplan\b|\bplanning\b|\bgoing\s+to\b|\bgonna\b|\bwill\b|\bstart\b|\bgym\b|\bfitness\b)"
)
PRONOUNS = r"\b(he|she|they|him|her|them|their|his|hers)\b"
# Sentences that the fallback recognises, what it says instead, and its confidence.
FALLBACKS = [
    (r"(?i)(?:my\s+name\s+is|i\s+go\s+by|call\s+me)\s+([^.!?,]+)", "My name is ", 0.86),
    (r"(?i)(?:i\s+live\s+in|i\s+moved\s+to|i\s+am\s+based\s+in)\s+([^.!?,]+)", "I live in ", 0.82),
    (r"(?i)(?:my\s+favorite\s+[^\s]+\s+is|i\s+prefer)\s+([^.!?,]+)", "I prefer ", 0.78),
    (r"(?i)(?:i\s+work\s+as|i\s+am\s+a|i\s+work\s+at)\s+([^.!?,]+)", "I work as ", 0.75),
]
# Pronouns that stand for an entity named before.
MENTION_PRONOUNS = ["he", "she", "they", "him", "her", "them", "his", "hers", "their"]
DIGITS36 = "0123456789abcdefghijklmnopqrstuvwxyz"


@F.pandas_udf(T.StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfkc(text: Column) -> Column:
    """Only texts with characters beyond ASCII need Python; callers with ASCII input skip it."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), _nfkc(text)).otherwise(text)


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def one_apostrophe(text: Column) -> Column:
    return F.regexp_replace(text, "['`‘’]", "'")


def match_form(text: Column, ascii_only: bool = True) -> Column:
    """Lower-case form for comparison: apostrophes, spaces, case, contractions."""
    out = text if ascii_only else nfkc(text)
    out = F.lower(collapse(one_apostrophe(out)))
    for pattern, new in CONTRACTIONS:
        out = F.regexp_replace(out, rf"(?i)\b{pattern}\b", new)
    return out


def extraction_form(text: Column, ascii_only: bool = True) -> Column:
    """The form for extraction keeps the case; a contraction takes the case of what it replaces."""
    out = collapse(one_apostrophe(text if ascii_only else nfkc(text)))
    for pattern, new in CONTRACTIONS:
        upper, title = pattern.upper().replace(r"\S", r"\s"), pattern[0].upper() + pattern[1:]
        out = F.regexp_replace(out, rf"\b{upper}\b", new.upper())
        out = F.regexp_replace(out, rf"\b{title[0]}(?i:{pattern[1:]})\b", new[0].upper() + new[1:])
        out = F.regexp_replace(out, rf"\b{pattern[0]}(?i:{pattern[1:]})\b", new)
    return out


def normal_operations(text: Column) -> Column:
    """Names of the steps of match_form that change the text, in order."""
    a = one_apostrophe(text)
    b = collapse(a)
    c = F.lower(b)
    d = match_form(text)
    steps = [("apostrophe_normalized", a != text), ("whitespace_collapsed", b != a), ("contractions_normalized", d != c), ("lowercased", c != b)]
    made = F.array(*(F.when(changed, F.lit(name)) for name, changed in steps))
    return F.filter(made, lambda x: x.isNotNull())


def canonical_token(text: Column) -> Column:
    return collapse(F.lower(text))


def predicate(types: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in PREDICATE.items() for x in pair))
    return F.try_element_at(table, F.coalesce(F.get(types, F.lit(0)), F.lit("preference")))


def first_match(text: Column, table: list[tuple[str, str]], default: str) -> Column:
    out = F.lit(default)
    for name, pattern in reversed(table):
        out = F.when(text.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def temporal_bucket(text: Column) -> Column:
    return first_match(F.lower(text), BUCKETS, "unspecified")


def change_type(text: Column) -> Column:
    return F.when(has_marker(text), first_match(F.lower(text), CHANGES, "general"))


def is_temporal_update(text: Column, memory_type: Column) -> Column:
    about = change_type(text)
    broad = memory_type.isin("identity", "location", "profession", "preference", "project", "relational", "emotional")
    return F.coalesce(F.when(about == "general", broad).otherwise(about == memory_type), F.lit(False))


def has_marker(text: Column) -> Column:
    return text.rlike("(?i)" + "|".join(rf"\b{p}\b" for p, _, _ in MARKERS))


def markers(text: Column) -> Column:
    """array<struct<phrase, kind, confidence>> of all temporal markers."""

    def found(pattern: str, kind: str, confidence: float) -> Column:
        told = lambda x: F.struct(x.alias("phrase"), F.lit(kind).alias("kind"), F.lit(confidence).alias("confidence"))
        return F.transform(F.regexp_extract_all(text, F.lit(rf"(?i)\b({pattern})\b"), F.lit(1)), told)

    return F.concat(*(found(*m) for m in MARKERS))


def repetition(text: Column) -> Column:
    """Share of the most frequent token (0 below four tokens)."""
    # Unwanted characters go once from the whole text; what is left of a token is the same.
    cleaned = F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9'@.\-\s]+", ""), r"\s+", " "))
    # An array of one, so that the sorted tokens are made once and not for each of their uses.
    words = F.array_sort(F.filter(F.split(cleaned, " "), lambda x: x != ""))

    def share(w: Column) -> Column:
        # Runs of equal tokens: where one starts, and where the next does.
        starts = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: (i == 0) | (F.get(w, i) != F.get(w, i - 1)))
        ends = F.concat(F.slice(starts, 2, F.greatest(F.size(starts), F.lit(1))), F.array(F.size(w)))
        return F.array_max(F.zip_with(ends, starts, lambda b, a: b - a)) / F.size(w)

    got = F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) < 4, F.lit(0.0)).otherwise(share(w))), F.lit(0))
    return F.when(text.isNull(), F.lit(None).cast("double")).otherwise(got)


def risk_signals(text: Column, score: Column, threshold: Column, n_entities: Column, n_types: Column, bucket: Column) -> Column:
    made = F.array(
        F.when(repetition(text) >= 0.6, F.lit("REPETITIVE_NOISE")),
        F.when((score >= threshold) & (n_entities == 0) & (n_types == 0), F.lit("LOW_STRUCTURE_HIGH_SCORE")),
        F.when(F.lower(text).rlike(RISK_MARKERS) & (bucket == "unspecified"), F.lit("AMBIGUOUS_TEMPORAL")),
    )
    return F.filter(made, lambda x: x.isNotNull())


def ambiguity_reasons(text: Column, score: Column, threshold: Column, types: Column, n_entities: Column, bucket: Column) -> Column:
    low = F.lower(text)
    weak = (score < threshold) | (F.size(types) == 0) | (n_entities == 0)
    made = F.array(
        F.when(F.abs(score - threshold) <= 0.08, F.lit("GRAY_ZONE_SCORE")),
        F.when(low.rlike(FIRST_PERSON) & low.rlike(FACT_CUES) & weak, F.lit("PERSONAL_FACT_CUE")),
        F.when(low.rlike(PRONOUNS) & ((n_entities == 0) | F.array_contains(types, "relational")), F.lit("PRONOUN_RELATION_AMBIGUITY")),
        F.when(low.rlike(TRIGGER_MARKERS) & (bucket == "unspecified"), F.lit("UNRESOLVED_TEMPORAL_SHIFT")),
    )
    return F.filter(made, lambda x: x.isNotNull())


def fallback_facts(text: Column) -> Column:
    """array<struct<text, confidence>> of what the sentence patterns find."""
    trimmed = F.trim(text)
    made = []
    for pattern, told, confidence in FALLBACKS:
        hit = F.trim(F.regexp_extract(trimmed, pattern, 1))
        made.append(F.when(hit != "", F.struct(F.concat(F.lit(told), hit).alias("text"), F.lit(confidence).alias("confidence"))))
    return F.filter(F.array(*made), lambda x: x.isNotNull())


def _codes(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))


def _signed(x: Column) -> Column:
    return F.when(x >= 2**31, x - 2**32).otherwise(x)


def base36(x: Column) -> Column:
    sign = F.when(x < 0, F.lit("-")).otherwise(F.lit(""))
    return F.concat(sign, F.lower(F.conv(F.abs(x).cast("string"), 10, 36)))


def _fold(text: Column, seed: int, step) -> Column:
    return F.aggregate(_codes(text), F.lit(seed).cast("long"), step)


def djb2(text: Column) -> Column:
    return _signed(_fold(text, 5381, lambda h, c: (h * 33 + c).bitwiseAND(F.lit(0xFFFFFFFF))))


def fnv1a(text: Column) -> Column:
    return _fold(text, 2166136261, lambda h, c: (h.bitwiseXOR(c) * 16777619).bitwiseAND(F.lit(0xFFFFFFFF)))


def hash31(text: Column) -> Column:
    return _signed(_fold(text, 0, lambda h, c: (h * 31 + c).bitwiseAND(F.lit(0xFFFFFFFF))))


def canonical_key(scope: Column, subject: Column, predicate_: Column, object_: Column, bucket: Column) -> Column:
    return F.concat(F.lit("ck_"), base36(F.abs(djb2(F.concat_ws("|", scope, subject, predicate_, object_, bucket)))))


def entity_id(kind: Column, mention: Column) -> Column:
    return F.concat(F.lit("ent_"), kind, F.lit("_"), base36(fnv1a(mention)))


def content_hash(text: Column) -> Column:
    return base36(hash31(text))


def mention_form(kind: Column, mention: Column) -> Column:
    low = canonical_token(mention)
    return F.when(kind == "person", F.trim(F.regexp_replace(low, r"^(?:my|our)\s+(?:wife|husband|partner|friend)\s+", ""))).otherwise(low)


def is_pronoun(mention: Column) -> Column:
    return canonical_token(mention).isin(*MENTION_PRONOUNS)
