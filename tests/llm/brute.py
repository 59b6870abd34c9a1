"""Brute-force versions of operators, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter


def repeats(rows: list[tuple[int, str | None]], length: int = 50) -> dict[int, tuple]:
    first: dict[bytes, int] = {}
    for doc_id, text in rows:
        b = (text or "").encode()
        for k in range(len(b) - length + 1):
            s = b[k : k + length]
            first[s] = min(first.get(s, doc_id), doc_id)
    out = {}
    for doc_id, text in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < doc_id:
                gone[k : k + length] = b"\1" * length
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out[doc_id] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def losses(rows: list[tuple[int | None, str | None]], good: set[int], mix: float = 0.7) -> list[tuple]:
    """doc_id, tokens, loss under the target and the background model and their difference, of every row."""
    lower = {c: c + 32 for c in range(65, 91)}
    texts = [(k, [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower)), None]) for k, t in rows]
    types = len({w for _, t in texts for w in t})

    def model(chosen):
        one = Counter(w for t in chosen for w in t)
        two = Counter(p for t in chosen for p in zip([None, *t], t))
        tokens = sum(one.values())

        def loss(t):
            total = 0.0
            for v, w in zip([None, *t], t):
                p = (one[w] + 1) / (tokens + types)
                total -= math.log(mix * two[v, w] / one[v] + (1 - mix) * p if one[v] else p)
            return total / len(t)

        return loss

    target, background = model([t for k, t in texts if k in good]), model([t for _, t in texts])
    return [(k, len(t), target(t), background(t), target(t) - background(t)) for k, t in texts]


def nearest_examples(rows: list[tuple[int, str | None]], examples: dict[int, str], features, k: int = 15) -> dict[int, list[tuple[int, float]]]:
    """The examples (by the smallest doc_id of each text) with the largest TF-IDF cosines to each row, over all features of both.

    features: those of one word.
    """

    def counts(text):
        return Counter(f for w in re.findall(rb"[a-z\x80-\xff]+", text.lower().encode()) for f in features(w))

    every = {d: counts(t or "") for d, t in rows}
    df = Counter(t for c in every.values() for t in c)

    def vector(c):
        v = {t: (1 + math.log(n)) * (math.log((1 + len(rows)) / (1 + df[t])) + 1) for t, n in c.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()}

    made = {d: vector(counts(t)) for d, t in examples.items()}
    out = {}
    for d, c in every.items():
        v = vector(c)
        cosines = ((e, sum(x * w.get(t, 0) for t, x in v.items())) for e, w in made.items())
        out[d] = sorted(((e, x) for e, x in cosines if x > 0), key=lambda ex: (-round(ex[1], 9), ex[0]))[:k]
    return out
