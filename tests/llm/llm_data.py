"""Small tables for the tests of the training-data operators."""

import random

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, score double, spans string"


def make_docs(spark, texts, start=0):
    """documents with clashing extra columns; texts may hold None."""
    rows = [(start + i, t, ("en", "de")[i % 2], "s", len(t or ""), 1, 0.5, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC_SCHEMA)


def prose(rng: random.Random, n: int, vocab: int = 400) -> str:
    return " ".join("".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(2 + k % 2)) for k in (rng.randrange(vocab) for _ in range(n)))


#: Texts at the edges: null, empty, blank, one word, repeated, no spaces, control characters, wide letters.
EDGES = [None, "", "   \n\t ", "word", "word", "a" * 5000, "é" * 700, "x\x00y", "😀 “quoted” ▁▁ text\r\n\r\n", "no letters 123".replace("no letters", "")]
