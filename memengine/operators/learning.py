"""From utterances to writes: fusion, policy, contradictions, linking, and the learning pipeline."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memengine.config import DEFAULT, Config
from memengine.functions import ner, scoring, text, vectors
from memengine.functions.checkpoint import cut
from memengine.functions.embed import hashed_vector
from memengine.operators import lifecycle, retrieval
from memengine.sources.tables import dealt

# --------------------------------------------------------------------------- fusion and policy


def fusion_pairs(candidates: DataFrame) -> DataFrame:
    """(canonical_key, d, f): the first deterministic and the first fallback candidate of each key.

    candidates: (canonical_key, source, score, threshold, accepted, confidence, ord).
    """
    first = lambda source: F.min_by(F.when(F.col("source") == source, F.struct("accepted", "score", "threshold", "confidence")), F.when(F.col("source") == source, F.col("ord")))
    return candidates.groupBy("canonical_key").agg(first("deterministic").alias("d"), first("fallback").alias("f"))


def fuse(candidates: DataFrame) -> DataFrame:
    """One decision per canonical key from the candidates of both sources."""
    g = fusion_pairs(candidates)
    sure = F.coalesce(F.col("f.confidence"), F.lit(0.0)) >= 0.72
    f_loose = F.col("f.accepted") | (F.col("f.score") >= F.col("f.threshold") + 0.03) | sure
    f_strict = F.col("f.accepted") & ((F.col("f.score") >= F.col("f.threshold") + 0.08) | sure)
    both, only_d = F.col("d").isNotNull() & F.col("f").isNotNull(), F.col("d").isNotNull()
    return g.select(
        "canonical_key",
        F.when(both, F.col("d.accepted") | f_loose).when(only_d, F.col("d.accepted")).otherwise(f_strict).alias("accepted"),
        F.when(both, F.when(F.col("d.accepted"), F.lit("deterministic")).otherwise(F.lit("fallback"))).when(only_d, F.lit("deterministic")).otherwise(F.lit("fallback")).alias("source"),
        F.when(both, F.col("d.accepted") & f_loose).otherwise(F.lit(False)).alias("agreement"),
    )


def policy_matches(candidates: DataFrame, mem: DataFrame) -> DataFrame:
    """candidates with same_id (active row of the same key) and best (id, object: newest active row of the predicate).

    Both sides have scope, canonical_key and predicate; only rows of the candidate's own scope match, where a
    scope is one user's store. Candidates of one batch do not see each other.
    """
    active = mem.filter("status = 'active' and canonical_key is not null")
    by_key = active.groupBy("scope", "canonical_key").agg(F.min("id").alias("same_id"))
    newest = active.groupBy("scope", "predicate").agg(F.max_by(F.struct("id", "object"), F.struct("updated_at", F.col("seq") * -1)).alias("best"))
    return candidates.join(by_key, ["scope", "canonical_key"], "left").join(newest, ["scope", "predicate"], "left")


def decide(candidates: DataFrame, mem: DataFrame) -> DataFrame:
    """(id, action, reason, target_id) of each candidate (id, scope, canonical_key, predicate, object, bucket)."""
    j = policy_matches(candidates, mem)
    none, moved = F.col("best").isNull(), F.col("bucket").isin("transition", "past")
    action = F.when(F.col("same_id").isNotNull(), "IGNORE").when(none, "ADD").when(moved, "SUPERSEDE").when(F.col("best.object") != F.col("object"), "UPDATE").otherwise("ADD")
    reason = (
        F.when(F.col("same_id").isNotNull(), "EXACT_CANONICAL_DUPLICATE").when(none, "NO_ACTIVE_MATCH").when(moved, "TRANSITIONAL_REPLACEMENT")
        .when(F.col("best.object") != F.col("object"), "SAME_PREDICATE_NEW_VALUE").otherwise("LOW_CONFIDENCE_MATCH")
    )
    target = F.when(F.col("same_id").isNotNull(), F.col("same_id")).when(action.isin("SUPERSEDE", "UPDATE"), F.col("best.id"))
    return j.select("id", action.alias("action"), reason.alias("reason"), target.alias("target_id"))


def contradictions(new: DataFrame, mem: DataFrame, manual: bool = False, cfg: Config = DEFAULT) -> DataFrame:
    """(new_id, id, similarity, match, resolution) of conflicting pairs; parallel ones are dropped."""
    near = retrieval.top_k_per_domain(new, mem, cfg.contradiction_k, cfg.contradiction_cos)
    a = new.select(F.col("id").alias("new_id"), F.col("types").alias("ta"), F.col("entities").alias("ea"), F.col("conflict_domain").alias("da"), text.has_marker(F.col("content")).alias("marked"))
    b = mem.select("id", F.col("types").alias("tb"), F.col("entities").alias("eb"), F.col("conflict_domain").alias("db"))
    j = near.join(a, "new_id").join(b, "id")
    match = scoring.attribute_match(F.col("ta"), F.col("tb"), F.col("ea"), F.col("eb"), F.col("da"), F.col("db"))
    j = j.withColumn("match", match)
    return j.select("new_id", "id", "similarity", "match", resolution(F.col("ta"), F.col("marked"), F.col("match"), manual, cfg).alias("resolution")).filter("resolution <> 'parallel'")


def resolution(types: Column, marked: Column, match: Column, manual: bool = False, cfg: Config = DEFAULT) -> Column:
    if manual:
        return F.lit("pending")
    kind = F.coalesce(F.get(types, F.lit(0)), F.lit("preference"))
    return (
        F.when(marked & kind.isin("identity", "location"), "supersede")
        .when(match > cfg.match_cutoff, F.when(marked, F.lit("supersede")).otherwise(F.lit("pending")))
        .otherwise("parallel")
    )


def session_recurrence(turns: DataFrame, similarity: Column, cfg: Config = DEFAULT) -> DataFrame:
    """turns (session, content, pos): the similarity to the last equal content of the session, if high enough."""
    w = Window.partitionBy("session", "content").orderBy("pos")
    seen = F.lag("pos").over(w).isNotNull()
    return turns.withColumn("recurrence", F.when(seen & (similarity > cfg.recurrence_cos), similarity).otherwise(F.lit(0.0)))


def last_seen(mentions: DataFrame) -> DataFrame:
    """mentions (conv_id, kind, pos, entity): the last entity of the kind before each mention."""
    w = Window.partitionBy("conv_id", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return mentions.withColumn("last_entity", F.last("entity", ignorenulls=True).over(w))


# --------------------------------------------------------------------------- linking


class Linker:
    """Ordered state of one scope: pronoun, exact, fuzzy (two edits, four letters), or new."""

    def __init__(self) -> None:
        self.by_mention: dict[str, str] = {}
        self.by_kind: dict[str, list[str]] = {}
        self.mention: dict[str, str] = {}
        self.last: dict[str, str] = {}

    def link(self, conv: object, kind: str, value: str) -> tuple[str, str]:
        said = ner.mention_form(kind, value)
        seen = f"{conv}:{kind}"
        if said in text.MENTION_PRONOUNS and seen in self.last:
            return self.last[seen], "pronoun"
        found, how = self.by_mention.get(f"{kind}:{said}"), "exact"
        if found is None:
            how = "fuzzy"
            for ident in self.by_kind.get(kind, []):
                other = self.mention[ident]
                if len(said) >= 4 and len(other) >= 4 and ner.edit_distance(said, other, 2) <= 2:
                    found = ident
                    break
        if found is None:
            found, how = ner.entity_id(kind, said), "new"
            if found not in self.by_kind.setdefault(kind, []):
                self.by_kind[kind].append(found)
        self.by_mention[f"{kind}:{said}"] = found
        self.mention[found] = said
        self.last[seen] = found
        return found, how


def link_entities(mentions: DataFrame, scope: str = "scope") -> DataFrame:
    """mentions (scope, conv_id, pos, kind, value) with canonical_id and how; folded in order within a scope.

    A scope is one store (a user). Its linker state depends on the order of all its mentions, so a scope is
    one unit of work; scopes run in parallel.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["pos", "kind", "value"], kind="stable")
        linker = Linker()
        got = [linker.link(c, k, v) for c, k, v in zip(pdf["conv_id"], pdf["kind"], pdf["value"])]
        return pdf.assign(canonical_id=[g[0] for g in got], how=[g[1] for g in got])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in mentions.schema)
    return mentions.groupBy(scope).applyInPandas(fold, f"{fields}, canonical_id string, how string")


# --------------------------------------------------------------------------- evaluation and learning


def evaluate(utterances: DataFrame, now_ms: int, cfg: Config = DEFAULT, novelty: Column | None = None) -> DataFrame:
    """Each utterance (conv_id, pos, text) with its facts: types, entities, score, threshold, canonical form, signals.

    The scope of an utterance is ``c`` and its conversation.
    """
    return judge(analyzed(utterances, now_ms).withColumn("novelty", F.lit(1.0) if novelty is None else novelty), cfg)


def analyzed(utterances: DataFrame, now_ms: int) -> DataFrame:
    """utterances with their clean text and what the rule packs find in it: specificity, types, entities."""
    a = utterances.withColumn("clean", text.extraction_form(F.col("text"), ascii_only=False))
    a = a.withColumn("ner", ner.analyze(F.col("clean"), F.lit(now_ms)))
    # The UDF's struct is used many times later; the barrier keeps Catalyst from running it each time.
    return a.select("*", F.col("ner.specificity").alias("specificity"), F.col("ner.types").alias("types"), F.col("ner.entities").alias("entities")).drop("ner")


def judge(a: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Analyzed utterances with novelty: score, threshold, canonical form, signals."""
    a = session_recurrence(a.withColumn("session", F.col("conv_id")).withColumn("content", F.col("clean")), F.lit(1.0), cfg)
    a = a.withColumn("score", scoring.quality(F.col("novelty"), F.col("specificity"), F.col("recurrence"), cfg))
    a = a.withColumn("threshold", scoring.type_threshold(F.col("types"), cfg)).withColumn("bucket", text.temporal_bucket(F.col("clean")))
    ids = F.array_sort(F.transform("entities", lambda e: text.entity_id(e["kind"], text.mention_form(e["kind"], e["value"]))))
    a = a.withColumn("predicate", text.predicate(F.col("types")))
    a = a.withColumn("object", F.when(F.size("entities") > 0, F.array_join(ids, "+")).otherwise(text.canonical_token(F.col("clean"))))
    a = a.withColumn("scope", F.concat(F.lit("c"), F.col("conv_id").cast("string")))
    a = a.withColumn("canonical_key", text.canonical_key(F.col("scope"), F.lit("user"), F.col("predicate"), F.col("object"), F.col("bucket")))
    signals = text.risk_signals(F.col("clean"), F.col("score"), F.col("threshold"), F.size("entities"), F.size("types"), F.col("bucket"))
    a = a.withColumn("risks", signals)
    ok = (F.col("score") >= F.col("threshold")) & (F.col("novelty") >= cfg.min_novelty) & (F.size("risks") == 0)
    a = a.withColumn("accepted", ok)
    reasons = text.ambiguity_reasons(F.col("clean"), F.col("score"), F.col("threshold"), F.col("types"), F.size("entities"), F.col("bucket"))
    return a.withColumn("reasons", reasons).drop("session", "content")


def fallbacks(evaluated: DataFrame) -> DataFrame:
    """(conv_id, pos, text, confidence): facts that the sentence patterns give for ambiguous utterances."""
    asked = evaluated.filter(F.size("reasons") > 0)
    return asked.select("conv_id", "pos", F.explode(text.fallback_facts(F.col("clean"))).alias("x")).select("conv_id", "pos", F.col("x.text").alias("text"), F.col("x.confidence").alias("confidence"))


def model_fallback(asked: DataFrame, complete: Callable[[str], str | None], confidence: float = 0.74) -> DataFrame:
    """Facts by a language model that the caller gives: ``complete`` maps a prompt to its answer.

    The answer is JSON with a list ``facts``, bare, fenced or with words around; others give nothing.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for conv, pos, said in zip(b["conv_id"], b["pos"], b["text"]):
                for fact, sure in ner.recover_facts(complete(said) or "", confidence):
                    rows.append((conv, pos, fact, sure))
            yield pd.DataFrame(rows, columns=["conv_id", "pos", "text", "confidence"])

    return asked.select(F.col("conv_id").cast("long"), F.col("pos").cast("long"), "text").mapInPandas(run, "conv_id long, pos long, text string, confidence double")


def novelty(said: DataFrame, mem: DataFrame) -> DataFrame:
    """said (conv_id, pos, text, ...) with novelty: 1 - the similarity to the nearest active row of its scope; 1 without one."""
    scope = F.concat(F.lit("c"), F.col("conv_id").cast("string"))
    known = mem.filter("status = 'active' and embedding is not null").select("id", "scope", "embedding")
    # Only utterances of scopes that have a memory are embedded and compared.
    asked = said.withColumn("scope", scope).join(known.select("scope").distinct(), "scope", "left_semi")
    ident = F.concat_ws(" ", "conv_id", "pos", "text")  # a fallback may give several facts for an utterance
    asked = asked.select(ident.alias("id"), "scope", hashed_vector(text.extraction_form(F.col("text"), ascii_only=False)).alias("embedding")).dropDuplicates(["id"])
    near = vectors.nearest_of_each(cut(asked), known, 1, 0.0, "scope").select(F.col("new_id").alias("__id"), "similarity")
    out = said.withColumn("__id", ident).join(near, "__id", "left").drop("__id")
    return out.withColumn("novelty", F.lit(1.0) - F.coalesce("similarity", F.lit(0.0))).drop("similarity")


def learn(utterances: DataFrame, mem: DataFrame, now_ms: int, cfg: Config = DEFAULT) -> DataFrame:
    """Decisions of a batch: one row for each candidate, and whether it is written.

    mem has scope and canonical form (``tables.canonical``). Utterances are scored with their novelty against the
    store of their own scope. Candidates of a batch are deduplicated by origin and key (best score), fused over
    origins and held against the stored rows of their scope; of those that are not ignored, the newest of a
    conversation and predicate is written.

    Texts are analyzed before any join, over all cores: a shuffle of such short rows would leave them in a task
    or two. mem is read once, for the columns that decisions need.
    """
    mem = cut(mem.select("id", "seq", "scope", "status", "updated_at", "predicate", "object", "canonical_key", "embedding"))
    said = cut(analyzed(utterances.select("conv_id", "pos", "text"), now_ms))
    direct = judge(novelty(said, mem), cfg)
    direct = cut(direct.withColumn("origin", F.lit("deterministic")).withColumn("confidence", F.lit(None).cast("double")))  # read three times
    again = dealt(fallbacks(direct), "conv_id", "pos")
    extra = judge(novelty(cut(analyzed(again.select("conv_id", "pos", "text"), now_ms)), mem), cfg).withColumn("origin", F.lit("fallback"))
    sure = again.groupBy("conv_id", "pos", "text").agg(F.max("confidence").alias("confidence"))
    extra = extra.join(sure, ["conv_id", "pos", "text"])
    extra = extra.withColumn("accepted", F.col("accepted") | ((F.col("confidence") >= 0.80) & (F.size("risks") == 0)))
    cols = ["conv_id", "pos", "text", "clean", "origin", "confidence", "score", "novelty", "threshold", "accepted", "types", "entities", "scope", "predicate", "object", "bucket", "canonical_key", "risks"]
    every = direct.select(*cols).unionByName(extra.select(*cols))
    w = Window.partitionBy("origin", "canonical_key").orderBy(F.desc("score"), "pos")
    best = cut(every.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn"))
    fused = fuse(best.select("canonical_key", F.col("origin").alias("source"), "score", "threshold", "accepted", "confidence", F.col("pos").alias("ord")))
    chosen = best.join(fused.select("canonical_key", F.col("source").alias("origin"), F.col("accepted").alias("fused")), ["canonical_key", "origin"])
    kept = chosen.filter("fused and accepted").withColumn("id", F.concat(F.col("canonical_key"), F.lit("_"), F.col("conv_id").cast("string")))
    decided = decide(kept.select("id", "scope", "canonical_key", "predicate", "object", "bucket"), mem)
    out = kept.join(decided, "id")
    newest = Window.partitionBy("conv_id", "predicate", F.col("action") == "IGNORE").orderBy(F.desc("pos"), "id")
    out = out.withColumn("written", (F.col("action") != "IGNORE") & (F.row_number().over(newest) == 1))
    return out.select(
        "id", "conv_id", "pos", "text", "origin", "score", "novelty", "scope", "types", F.transform("entities", lambda e: e["value"]).alias("entities"), "predicate", "object", "bucket", "canonical_key",
        "action", "reason", "target_id", "written",
    )


def new_rows(decided: DataFrame, mem: DataFrame, now_ms: int) -> DataFrame:
    """The written decisions as rows of the memory table; columns of mem that they don't tell are null."""
    told = {
        "id": F.col("id"), "content": F.col("text"), "types": F.col("types"), "status": F.lit("active"), "created_at": F.lit(now_ms), "updated_at": F.lit(now_ms), "valid_from": F.lit(now_ms),
        "base_strength": F.lit(1.0), "current_strength": F.lit(1.0), "pinned": F.lit(False), "mention_count": F.lit(1), "last_accessed_at": F.lit(now_ms), "entities": F.col("entities"),
        "source_conversation_ids": F.array("scope"), "conflict_domain": scoring.domain(F.col("types")), "embedding": hashed_vector(F.col("text")), "scope": F.col("scope"),
        "predicate": F.col("predicate"), "object": F.col("object"), "bucket": F.col("bucket"), "canonical_key": F.col("canonical_key"),
    }
    return decided.filter("written").select(*(told.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in mem.schema))


def conflicts(fresh: DataFrame, mem: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Contradictions of new rows with stored rows of their own scope."""
    own = lambda f: f.withColumn("conflict_domain", F.concat_ws("|", "scope", "conflict_domain"))
    return contradictions(own(fresh), own(mem), cfg=cfg)


def write(decided: DataFrame, mem: DataFrame, now_ms: int, cfg: Config = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(the next snapshot of mem, contradictions found): new rows, then what policy and contradictions supersede."""
    decided = cut(decided)  # read three times
    fresh = cut(new_rows(dealt(decided, "id"), mem, now_ms))
    marked = decided.filter("written and action in ('SUPERSEDE', 'UPDATE')")
    by_policy = marked.select(F.col("target_id").alias("old_id"), F.col("id").alias("new_id"), text.has_marker(F.col("text")).alias("temporal"))
    gone = by_policy.select(F.col("old_id").alias("id")).distinct()
    # Contradictions are looked for among rows that the policy has left active.
    found = cut(conflicts(fresh, mem.join(gone, "id", "left_anti"), cfg))
    told = fresh.select(F.col("id").alias("new_id"), text.has_marker(F.col("content")).alias("temporal"))
    by_conflict = found.filter("resolution = 'supersede'").select(F.col("id").alias("old_id"), "new_id").join(told, "new_id").select("old_id", "new_id", "temporal")
    links = by_policy.unionByName(by_conflict).groupBy("old_id").agg(F.min_by(F.struct("new_id", "temporal"), "new_id").alias("x")).select("old_id", "x.*")
    return lifecycle.supersede(mem.unionByName(fresh), links, now_ms), found


def chained(asked: DataFrame, extractors: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Facts (conv_id, pos, text, confidence) of the first extractor that has any for an utterance; none without extractors."""
    out, rest = None, asked
    for extract in extractors:
        got = cut(extract(rest))
        out = got if out is None else out.unionByName(got)
        rest = rest.join(got.select("conv_id", "pos").distinct(), ["conv_id", "pos"], "left_anti")
    return noop(asked) if out is None else out


def noop(asked: DataFrame) -> DataFrame:
    """The extractor that never finds a fact."""
    return asked.limit(0).select(F.col("conv_id").cast("long"), F.col("pos").cast("long"), "text", F.lit(0.0).alias("confidence"))


def pattern_fallback(asked: DataFrame) -> DataFrame:
    """Facts that the sentence patterns give."""
    clean = text.extraction_form(F.col("text"), ascii_only=False)
    found = asked.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("pos").cast("long").alias("pos"), F.explode(text.fallback_facts(clean)).alias("x"))
    return found.select("conv_id", "pos", F.col("x.text").alias("text"), F.col("x.confidence").alias("confidence"))
