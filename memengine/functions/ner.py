"""Fact extraction from sentences: rule packs behind one Arrow UDF, and the pure-column subset.

``analyze`` runs all packs over a text once and returns a struct. Numbers, e-mails, named entities,
possessions and type words have column forms too, which stay inside Catalyst.
"""

from __future__ import annotations

import json
import re
from datetime import datetime, timedelta, timezone
from functools import cache, lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from memengine.functions import packs

ENTITY = T.StructType([T.StructField("kind", T.StringType()), T.StructField("value", T.StringType()), T.StructField("raw", T.StringType()), T.StructField("confidence", T.DoubleType())])
SIGNAL = T.StructType([T.StructField("pack", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("value", T.StringType())])
ANALYSIS = T.StructType(
    [
        T.StructField("specificity", T.DoubleType()),
        T.StructField("types", T.ArrayType(T.StringType())),
        T.StructField("entities", T.ArrayType(ENTITY)),
        T.StructField("signals", T.ArrayType(SIGNAL)),
    ]
)


@cache
def _compiled(pack: str) -> list[tuple[str, re.Pattern, float]]:
    # \b, \w and \d are ASCII here as in the published rules.
    return [(kind, re.compile(p, re.IGNORECASE | re.ASCII), c) for kind, p, c in packs.PACKS[pack][0]]


def _fine(pack: str, kind: str, value: str, raw: str, text: str, span: tuple[int, int]) -> bool:
    low = value.lower()
    head = low.split()[0] if low.split() else ""
    if pack == "names":
        words = low.split()
        bad = head in packs.NO_NAME or any(w in packs.PROFESSIONS for w in words) or low.endswith("ing")
        bad = bad or low in packs.PEOPLES
        return not bad and (kind != "bigram" or head not in packs.NO_PLACE)
    if pack == "places":
        idiom = low in packs.NO_LOCATION.get(kind, ()) or low in packs.COMPANIES
        return not idiom and head not in packs.NO_PLACE and len(low) > 1 and not low.isdigit()
    if pack == "preferences":
        if kind == "into" and head in ("trouble", "debt", "fights"):
            return False
        if kind in ("hate", "love") and re.match(r"to (?:say|admit|break|be|tell)\b", low):
            return False
        return low not in packs.NO_SUBJECT and head not in ("it", "that", "this", "you", "your")
    if pack == "education" and kind in packs.INSTITUTION_KINDS:
        return not any(x in low if " " in x else head == x for x in packs.NO_SCHOOL)
    if pack == "contact" and kind in ("userName", "relationship"):
        return low not in packs.PEOPLES and head not in packs.NO_NAME and not low.endswith("ing")
    if pack == "identity":
        if kind == "age":
            return 5 <= int(value) <= 120
        return kind != "childrenCount" or not value.isdigit() or int(value) <= 20
    if pack == "contact" and kind == "phoneNumber":
        digits = re.sub(r"\D", "", value)[-10:]
        return len(digits) == 10 and digits[:3] != "555" and 200 <= int(digits[:3]) <= 999
    if pack == "health":
        limits = {"bloodSugar": (20, 700), "bmi": (10, 80), "heartRate": (25, 250)}
        if kind in limits:
            return limits[kind][0] <= float(value) <= limits[kind][1]
        if kind == "bloodPressure":
            s, d = map(int, value.split("/"))
            return 60 <= s <= 260 and 30 <= d <= 160 and s > d
    if pack == "education" and kind == "gpa":
        return float(value) <= 5
    if pack == "temporal" and kind == "dateIso":
        return _date(value, None) is not None
    if pack == "negation":
        return kind not in packs.NEEDS_CUE or re.search(packs.STRONG_CUE, _around(text, span, 8), re.IGNORECASE) is not None
    if pack == "jobs":
        return head not in ("home", "my", "it") and len(low) > 1
    return True


#: What the values of contact rules are; the others are persons.
CONTACT_ENTITY = {"phoneNumber": "number", "phoneInternational": "number", "streetAddress": "place", "cityStateZip": "place", "employment": "organization", "preferredContactMethod": None, "contactMethodAvoid": None}


def _contact(kind: str, value: str) -> str:
    """A contact value in one form: numbers with the country's code, short forms of streets."""
    if kind == "phoneNumber":
        return "+1" + re.sub(r"\D", "", value)[-10:]
    if kind == "phoneInternational":
        return "+" + re.sub(r"\D", "", value)
    if kind == "streetAddress":
        return " ".join(packs.STREETS.get(w.rstrip("."), w) for w in value.split())
    return value


def _around(text: str, span: tuple[int, int], words: int) -> str:
    before, after = text[: span[0]].split()[-words:], text[span[1] :].split()[:words]
    return " ".join(before + after)


def _date(raw: str, now: datetime | None) -> str | None:
    try:
        return datetime.strptime(raw, "%Y-%m-%d").date().isoformat()
    except ValueError:
        return None


MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
DAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800, "month": 30 * 86400, "year": 365 * 86400}
NAMED_TIMES = {"noon": "12:00", "midnight": "00:00", "dawn": "06:00", "dusk": "18:00", "sunrise": "06:00", "sunset": "18:00"}


def duration_seconds(amount: int, unit: str) -> int | None:
    return SECONDS[unit.rstrip("s")] * amount if unit.rstrip("s") in SECONDS else None


def shift(day: datetime, amount: int, unit: str) -> datetime:
    """Calendar arithmetic; days past a month's end roll into the next."""
    unit = unit.rstrip("s")
    if unit in ("month", "year"):
        months = day.year * 12 + day.month - 1 + amount * (12 if unit == "year" else 1)
        return datetime(months // 12, months % 12 + 1, 1, tzinfo=day.tzinfo) + timedelta(days=day.day - 1)
    return day + timedelta(seconds=SECONDS[unit] * amount)


def relative_period(modifier: str, period: str, now: datetime) -> str:
    """ISO date of last/this/next week, month, year or weekday."""
    step = {"last": -1, "this": 0, "next": 1}[modifier]
    if period in DAYS:
        ahead = (DAYS.index(period) - now.weekday()) % 7
        if step == 1 and ahead == 0:
            ahead = 7
        if step == -1:
            ahead = ahead - 7 if ahead else -7
        return (now + timedelta(days=ahead)).date().isoformat()
    return shift(now, step, period).date().isoformat()


def resolve_time(kind: str, value: str, now: datetime) -> str:
    """A temporal value in a fixed form (ISO date, HH:MM, seconds), or itself in lower case."""
    low = value.lower().strip()
    if kind == "dateIso":
        return low
    if kind == "relativePresent":
        return now.date().isoformat()
    if kind == "relativePast":
        return (now - timedelta(days=1)).date().isoformat()
    if kind == "relativeFuture":
        return (now + timedelta(days=1)).date().isoformat()
    if kind == "relativePeriod":
        return relative_period(*low.split(maxsplit=1), now)
    if kind == "relativeCount":
        m = re.search(r"(\d+)\s+([a-z]+)", low)
        return shift(now, int(m[1]) * (-1 if "ago" in low else 1), m[2]).date().isoformat()
    if kind == "absoluteTime":
        m = re.match(r"(\d{1,2})(?::(\d{2}))?\s*(am|pm)", low)
        return f"{int(m[1]) % 12 + (12 if m[3] == 'pm' else 0):02d}:{m[2] or '00'}"
    if kind == "absoluteTime24h":
        h, m = low.split(":")
        return f"{int(h):02d}:{m}"
    if kind == "timeReference":
        return NAMED_TIMES[low]
    if kind == "duration":
        n, unit = low.split()
        return f"{duration_seconds(int(n), unit)}s"
    if kind == "dateNumeric":
        m, d, y = map(int, low.split("/"))
        return _valid(y + 2000 if y < 100 else y, m, d) or low
    if kind == "absoluteDate":
        month = next((k + 1 for k, name in enumerate(MONTHS) if re.search(rf"\b{name}", low)), None)
        day, year = re.search(r"\b(\d{1,2})(?:st|nd|rd|th)?\b", low), re.search(r"\b(\d{4})\b", low)
        return (_valid(int(year[1]) if year else now.year, month, int(day[1])) if month and day else None) or low
    return low


def _valid(y: int, m: int, d: int) -> str | None:
    try:
        return datetime(y, m, d).date().isoformat()
    except ValueError:
        return None


def analyze_text(text: str | None, now_ms: int, only: str | None = None) -> dict:
    """All packs (or one) over one text: specificity, types, entities (first of a kind and value wins), signals."""
    text = text or ""
    now = datetime.fromtimestamp(now_ms / 1000, timezone.utc)
    entities: dict[tuple[str, str], dict] = {}
    signals: dict[tuple[str, str, str], dict] = {}
    features: set[str] = set()
    types: list[str] = []

    def add(pack: str, kind: str | None, value: str, raw: str, confidence: float) -> None:
        if kind:
            entities.setdefault((kind, value), {"kind": kind, "value": value, "raw": raw, "confidence": max(0.5, min(0.98, confidence))})

    for pack, (_, entity, feature) in packs.PACKS.items():
        if only not in (None, pack):
            continue
        for kind, pattern, confidence in _compiled(pack):
            for m in pattern.finditer(text):
                raw = (m.group(1) or "").strip().rstrip(".;,")
                if pack == "education" and kind in packs.INSTITUTION_KINDS:
                    raw = (m.group(m.lastindex) or "").strip().rstrip(".;,")
                if pack == "names":
                    raw = re.sub(r"\s+(?:and|or|but)\b.*$", "", raw, flags=re.IGNORECASE)
                if not raw or not _fine(pack, kind, raw, m.group(0), text, m.span()):
                    continue
                value = resolve_time(kind, raw, now) if pack == "temporal" else re.sub(r"\s+", " ", raw.lower())
                if pack == "numbers":
                    value = raw.replace(",", "")
                if pack == "contact":
                    value = _contact(kind, value)
                signals.setdefault((pack, kind, value), {"pack": pack, "kind": kind, "value": value})
                features.add(feature)
                mine = entity if (pack, kind) not in {("relational", k) for k in ("relationMention", "relationStatus", "relationCount")} else None
                if pack == "routines" and kind == "temporalChange":
                    features.add("temporalChanges")
                    mine = None
                if pack == "education" and kind not in packs.INSTITUTION_KINDS:
                    mine = None
                if pack == "contact":
                    mine = CONTACT_ENTITY.get(kind, entity)
                add(pack, mine, value, raw, confidence)
                if pack == "places" and m.lastindex == 2 and m.group(2):
                    second = m.group(2).strip().lower()
                    if _fine(pack, kind, second, second, text, m.span()):
                        add(pack, entity, second, m.group(2).strip(), max(0.72, confidence - 0.06))
                if pack == "preferences" and kind == "prefer":
                    other = re.match(r"\s+(?:over|to)\s+([\w'’& \-]+)", text[m.end(1) :])
                    if other:
                        features.add("preferenceComparisons")
                        add(pack, entity, f"{value} over {other[1].strip().lower()}", m.group(0), confidence)
                said = packs.PACK_TYPES.get(pack)
                if pack == "contact":
                    said = {"streetAddress": "location", "cityStateZip": "location", "employment": "profession", "relationship": "relational"}.get(kind, said)
                if (pack, kind) == ("routines", "temporalChange"):
                    said = "temporal"
                if said and said not in types:
                    types.append(said)
                if pack == "routines" and kind != "temporalChange":
                    # A habit is a preference that comes at times.
                    features.add("preferenceSignals")
                    types.extend(x for x in ("temporal",) if x not in types)
    for pack, feature in (("preferences", "preferenceSignals"), ("routines", "routineSignals"), ("negation", "negationSignals")):
        if any(s[0] == pack for s in signals):
            features.add(feature)
    for feature, pattern, confidence in (("emails", packs.EMAIL, 0.95), ("namedEntities", packs.NAMED, 0.85)):
        for m in re.finditer(pattern, text, re.ASCII):
            features.add(feature)
            add("basic", "person", m.group(1).lower(), m.group(1), confidence)
    if any(re.search(p, text, re.IGNORECASE | re.ASCII) for p in packs.POSSESSIONS):
        features.add("possessions")
        if "identity" not in types:
            types.append("identity")
    low = text.lower()
    for name, pattern in packs.CLASSIFY:
        if name not in types and re.search(pattern, low, re.ASCII):
            types.append(name)
    if "profession" not in types and any(re.search(rf"\b{w}\b", low) for w in packs.PROFESSIONS):
        types.append("profession")
    if "relational" not in types and re.search(packs.STATUS, low) and not re.search(packs.IDIOM, low):
        types.append("relational")
    score = min(1.0, sum(packs.WEIGHTS[f] for f in sorted(features)))
    return {"specificity": score, "types": types, "entities": list(entities.values()), "signals": list(signals.values())}


@lru_cache(maxsize=1 << 13)
def _analyzed(text: str, now_ms: int, only: str | None) -> dict:
    return analyze_text(text, now_ms, only)


def _analyze_once(text: str | None, now_ms: int, only: str | None) -> dict:
    """analyze_text; what short texts give is remembered, as they come often. The result must not be changed."""
    return _analyzed(text, now_ms, only) if text is not None and len(text) <= 256 else analyze_text(text, now_ms, only)


@F.arrow_udf(ANALYSIS)
def _analyze(text: pa.Array, now_ms: pa.Array, only: pa.Array) -> pa.Array:
    at: dict[tuple, int] = {}
    places = [at.setdefault(k, len(at)) for k in zip(text.to_pylist(), now_ms.to_pylist(), only.to_pylist())]
    return pa.array([_analyze_once(*k) for k in at], to_arrow_type(ANALYSIS)).take(pa.array(places, pa.int32()))


def analyze(text: Column, now_ms: Column, only: str | None = None) -> Column:
    """Analysis by all packs, or by one."""
    return _analyze(text, now_ms.cast("long"), F.lit(only).cast("string"))


# --------------------------------------------------------------------------- pure columns


def numbers(text: Column) -> Column:
    """array<string> of currency amounts, percentages and plain numbers, in the order of the rules."""
    found = [F.regexp_extract_all(text, F.lit(p if k == "plain" else f"(?i){p}"), F.lit(1)) for k, p, _ in packs.NUMBERS]
    return F.transform(F.concat(*found), lambda x: F.replace(x, F.lit(","), F.lit("")))


def emails(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(packs.EMAIL), F.lit(1)), F.lower)


def named(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(packs.NAMED), F.lit(1)), F.lower)


def possessions(text: Column) -> Column:
    return F.concat(*(F.transform(F.regexp_extract_all(text, F.lit(f"(?i){p}"), F.lit(1)), F.lower) for p in packs.POSSESSIONS))


def types_by_words(text: Column) -> Column:
    """array<string> of memory types that words of the text speak for."""
    low = F.lower(text)
    words = "|".join(packs.PROFESSIONS)
    hits = []
    for name, pattern in packs.CLASSIFY:
        hit = low.rlike(pattern)
        if name == "profession":
            hit = hit | low.rlike(rf"\b(?:{words})\b")
        if name == "relational":
            hit = hit | (low.rlike(packs.STATUS) & ~low.rlike(packs.IDIOM))
        hits.append(F.when(hit, F.lit(name)))
    return F.filter(F.array(*hits), lambda x: x.isNotNull())


def basic_specificity(text: Column) -> Column:
    """The part of the score that numbers, e-mails, named entities and possessions give."""
    w = packs.WEIGHTS
    parts = (("numbers", numbers), ("emails", emails), ("namedEntities", named), ("possessions", possessions))
    total = F.lit(0.0)
    for name, f in parts:
        total = total + F.when(F.size(f(text)) > 0, F.lit(w[name])).otherwise(F.lit(0.0))
    return F.least(F.lit(1.0), total)


# --------------------------------------------------------------------------- plain helpers


def mention_form(kind: str, value: str) -> str:
    import unicodedata

    low = re.sub(r"\s+", " ", unicodedata.normalize("NFKC", value).lower()).strip()
    return re.sub(r"^(?:my|our)\s+(?:wife|husband|partner|friend)\s+", "", low) if kind == "person" else low


def entity_id(kind: str, said: str) -> str:
    h = 2166136261
    for c in said.encode("utf-16-le", "surrogatepass")[::2] if said.isascii() else map(ord, said):
        h = ((h ^ c) * 16777619) & 0xFFFFFFFF
    digits = ""
    while h:
        h, r = divmod(h, 36)
        digits = "0123456789abcdefghijklmnopqrstuvwxyz"[r] + digits
    return f"ent_{kind}_{digits or '0'}"


def edit_distance(a: str, b: str, most: int) -> int:
    """Edit distance, or most + 1 beyond it."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(prev + (x != y), row[j] + 1, row[j - 1] + 1)
        if min(row) > most:
            return most + 1
    return min(row[-1], most + 1)


def recover_facts(answer: str, default: float) -> list[tuple[str, float]]:
    """(text, confidence) of a model's answer: JSON bare, fenced or with words around; the surest of each text."""
    fence = re.search(r"```(?:json)?\s*(.*?)```", answer, re.DOTALL)
    tries = [answer, fence[1] if fence else "", answer[answer.find("{") : answer.rfind("}") + 1], answer[answer.find("[") : answer.rfind("]") + 1]]
    for t in tries:
        try:
            data = json.loads(t)
        except ValueError:
            continue
        facts = data.get("facts", []) if isinstance(data, dict) else data
        if not isinstance(facts, list):
            continue
        best: dict[str, tuple[str, float]] = {}
        for f in facts:
            told = f.get("text") if isinstance(f, dict) else f
            if not isinstance(told, str) or not told.strip():
                continue
            sure = f.get("confidence", default) if isinstance(f, dict) else default
            sure = min(1.0, max(0.0, float(sure))) if isinstance(sure, (int, float)) else default
            k = told.strip().lower()
            if k not in best or sure > best[k][1]:
                best[k] = (told.strip(), sure)
        return list(best.values())
    return []
