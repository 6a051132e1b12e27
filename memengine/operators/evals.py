"""Quality gates of learning: small conversations with what they must give, and the measured shares.

Stored facts are learned first, then the conversations are held against them; every number below comes from
the operators themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memengine.config import DEFAULT, Config
from memengine.operators import learning
from memengine.sources.tables import canonical, empty_memories

# The gates; "most" gates bound from above.
GATES = {
    "meaningful_recall": (0.90, "least"), "noise_false_positives": (0.05, "most"), "assistant_contamination": (0.0, "most"), "supersession": (0.90, "least"), "canonicalization": (0.95, "least"),
    "entity_link": (0.85, "least"), "temporal_state": (0.90, "least"), "policy_decision": (0.88, "least"), "stability": (1.0, "least"),
}
STORED = [(1, "I live in Denver."), (2, "My name is Maria Lopez."), (3, "I work as a nurse."), (5, "I live in Oslo."), (6, "I live in Leeds.")]
# (conversation, turn, role, text, what the policy must do; None: nothing may be learned). A fact that is known word
# for word is ignored by the policy, or not even a candidate as it has no novelty.
TURNS = [
    (1, 0, "user", "I used to live in Denver but now I live in Austin.", "SUPERSEDE"),
    (1, 1, "assistant", "I live in the cloud and my name is Helper.", None),
    (2, 0, "user", "My name is Maria Lopez.", "IGNORE"),
    (2, 1, "user", "thanks thanks thanks thanks", None),
    (3, 0, "user", "I work as a teacher at Riverside School in Boston since 2021.", "UPDATE"),
    (3, 1, "user", "ok", None),
    (4, 0, "user", "I live in Lisbon.", "ADD"),
    (4, 1, "user", "My favorite color is green.", "ADD"),
    (4, 2, "assistant", "My favorite color is blue.", None),
    (5, 0, "user", "I used to live in Oslo but now I live in Riga.", "SUPERSEDE"),
    (5, 1, "user", "hello there", None),
    (6, 0, "user", "I moved from Leeds to Perth on 2024-01-15 and I live in Perth.", "UPDATE"),
    (7, 0, "user", "My email is anna.berg@example.com.", "ADD"),
    (7, 1, "user", "lol", None),
    (8, 0, "user", "I prefer tea over coffee.", "ADD"),
    (8, 1, "user", "what time is it", None),
    (9, 0, "user", "My wife's name is Parastoo.", "ADD"),
    (9, 1, "user", "can you help me with this", None),
    (10, 0, "user", "I'm allergic to penicillin.", "ADD"),
    (10, 1, "user", "sounds good", None),
]
# Two ways to say a fact that must have one key.
SAME = [("I live in Lisbon.", "i live in lisbon"), ("My name is Maria Lopez.", "my name is maria lopez"), ("I work at OpenAI.", "i  work at OpenAI"), ("I prefer tea over coffee.", "I prefer tea over coffee")]
# (mention kind, value, which entity it is)
MENTIONS = [("person", "Sarah", "a"), ("person", "Sarha", "a"), ("person", "her", "a"), ("person", "my wife Sarah", "a"), ("person", "Bernard", "b"), ("person", "bernard", "b"), ("place", "Lisbon", "c"), ("place", "lisbon", "c")]
STATES = [("I used to live in Oslo but now I live in Riga.", "transition"), ("I previously lived in Oslo.", "past"), ("I currently live in Riga.", "current"), ("I will move to Lyon next year.", "future"), ("I like tea.", "unspecified")]


def measure(spark: SparkSession, now_ms: int, cfg: Config = DEFAULT) -> DataFrame:
    """(metric, value, gate, passed) of each gate."""
    said = spark.createDataFrame(TURNS, "conv_id long, pos int, role string, text string, wanted string")
    stored = spark.createDataFrame([(c, 0, t) for c, t in STORED], "conv_id long, pos int, text string")
    nothing = canonical(empty_memories(spark).withColumn("seq", F.lit(0).cast("long")))
    mem, _ = learning.write(learning.learn(stored, nothing, now_ms - 1000, cfg), nothing, now_ms - 1000, cfg)
    # Learning takes users' turns alone.
    runs = [{(r.conv_id, r.pos): r for r in learning.learn(said.filter("role = 'user'").select("conv_id", "pos", "text"), mem, now_ms, cfg).collect() if r.origin == "deterministic"} for _ in (0, 1)]
    got = runs[0]
    meaningful = [(c, p) for c, p, role, _, want in TURNS if want not in (None, "IGNORE") and role == "user"]
    noise = [(c, p) for c, p, role, _, want in TURNS if not want and role == "user"]
    robot = [(c, p) for c, p, role, _, _ in TURNS if role == "assistant"]
    wanted = {(c, p): want for c, p, _, _, want in TURNS if want}
    names = {r.content: r.id for r in mem.collect()}
    moved = [k for k, want in wanted.items() if want == "SUPERSEDE"]
    before = {c: names.get(t) for c, t in STORED}
    pairs = [(k, i, t) for k, pair in enumerate(SAME) for i, t in enumerate(pair)]
    keys = {(r.conv_id, r.pos): r.canonical_key for r in learning.evaluate(spark.createDataFrame(pairs, "conv_id long, pos int, text string"), now_ms, cfg).collect()}
    rows = [("u", 1, k, kind, value) for k, (kind, value, _) in enumerate(MENTIONS)]
    linked = {r.pos: r.canonical_id for r in learning.link_entities(spark.createDataFrame(rows, "scope string, conv_id long, pos long, kind string, value string")).collect()}
    agree = [(linked[i] == linked[j]) == (MENTIONS[i][2] == MENTIONS[j][2]) for i in range(len(MENTIONS)) for j in range(i)]
    states = {r.pos: r.bucket for r in learning.evaluate(spark.createDataFrame([(1, k, t) for k, (t, _) in enumerate(STATES)], "conv_id long, pos int, text string"), now_ms, cfg).collect()}
    share = lambda hits: sum(hits) / len(hits)
    decided = lambda run: {k: (r.action, r.reason, r.target_id, r.canonical_key, r.written) for k, r in run.items()}
    values = {
        "meaningful_recall": share([k in got for k in meaningful]),
        "noise_false_positives": share([k in got for k in noise]),
        "assistant_contamination": float(sum(k in got for k in robot)),
        "supersession": share([k in got and got[k].action == "SUPERSEDE" and got[k].target_id == before[k[0]] for k in moved]),
        "canonicalization": share([keys[k, 0] == keys[k, 1] for k in range(len(SAME))]),
        "entity_link": share(agree),
        "temporal_state": share([states[k] == want for k, (_, want) in enumerate(STATES)]),
        "policy_decision": share([got[k].action == want if k in got else want == "IGNORE" for k, want in wanted.items()]),
        "stability": float(decided(runs[0]) == decided(runs[1])),
    }
    out = [(m, float(v), g, v >= g if kind == "least" else v <= g) for m, v in values.items() for g, kind in [GATES[m]]]
    return spark.createDataFrame(out, "metric string, value double, gate double, passed boolean")
