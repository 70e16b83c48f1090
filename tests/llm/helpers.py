"""Small fixtures and plain references for the training-data operators."""

from __future__ import annotations

import random

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


def edited(text: str, seed: int, n: int) -> str:
    r, words = random.Random(seed), text.split()
    for _ in range(n):
        words[r.randrange(len(words))] = f"new{r.randrange(10**6)}"
    return " ".join(words)


DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(spark, rows, schema=DOC):
    """rows: (doc_id, text) or (doc_id, text, source)."""
    out = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1]) if r[1] else 0) for r in rows]
    return spark.createDataFrame(out, schema)


def tuples(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.select(*columns).collect()), key=repr)
