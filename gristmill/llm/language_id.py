"""Operator 10: language identification in two levels.

The family of languages is predicted first; within it, one-versus-one linear support vector machines tell the closely
related languages apart. Features are hashed byte n-grams of texts in lower case, as shares of a text's n-grams. The machines are trained on at most PER_LANGUAGE texts of each language, those with
the smallest hash of doc_id among the training rows; scoring reads every whole text.

Null text, or text without a letter: ``und`` with score 0. Labels that are null are not learned; a language outside the
table of families is a family of its own. With no labelled rows at all, every text is ``und``. Repeated rows and ties:
each row has its result; equal votes go to the language with the larger summed margin, then the first in code order. Rows
with a null doc_id are scored but not learned. Very long texts are read whole. Columns other than doc_id, text and lang may
have any names. Empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, cut, fresh, letters, release, slices, table, utf8

#: Texts of each language that training takes at most.
PER_LANGUAGE = 1500
BITS = 15
BUCKETS = 1 << BITS
GRAMS = (1, 2, 3)
SCALE = 10.0

#: Families of languages by ISO 639-1 code.
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr uz",
    "indic": "bn gu hi mr ne pa ur",
    "semitic": "am ar he mt",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


_LETTERS = letters()


def _grams(data: np.ndarray) -> list[np.ndarray]:
    """Buckets of the n-grams that start at each byte, by length."""
    b = _LETTERS[data].astype(np.uint32)
    out, h = [], np.zeros(len(b), np.uint32)
    for k in range(max(GRAMS)):
        h = h[: max(len(b) - k, 0)] * np.uint32(0x9E3779B1) + b[k:] + np.uint32(1)
        if k + 1 in GRAMS:
            x = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA77)
            out.append((x >> np.uint32(32 - BITS)).astype(np.int32))
    return out


def _counted(offsets: np.ndarray) -> np.ndarray:
    """Number of n-grams of each text."""
    size = np.diff(offsets)
    return np.maximum(sum(np.maximum(size - g + 1, 0) for g in GRAMS), 1)


class Features:
    """Buckets and counts of the n-grams of each text, one text after the other; a text's values are shares of its n-grams."""

    def __init__(self, texts: pa.Array):
        data, offsets = utf8(texts)
        bucket, count, ends, total = [np.empty(0, np.uint16)], [np.empty(0, np.uint32)], [0], []
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            key = np.concatenate(_grams(data[a:b]))
            some, n = np.unique(key, return_counts=True)
            bucket.append(some.astype(np.uint16))
            count.append(n.astype(np.uint32))
            ends.append(ends[-1] + len(some))
            total.append(max(len(key), 1))
        self.bucket, self.count, self.ends, self.total = np.concatenate(bucket), np.concatenate(count), ends, total

    def __len__(self) -> int:
        return len(self.total)

    def __getitem__(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        on = slice(self.ends[k], self.ends[k + 1])
        return self.bucket[on], SCALE * self.count[on] / self.total[k]


def _margins(texts: pa.Array, weights: list[np.ndarray]) -> np.ndarray:
    """Margin of each machine for each text."""
    data, offsets = utf8(texts)
    grams = _grams(data)
    out = np.zeros((len(weights), len(offsets) - 1))
    for size, key in zip(GRAMS, grams, strict=True):
        first = np.minimum(offsets[:-1], len(key))
        last = np.maximum(np.minimum(offsets[1:] - size + 1, len(key)), first)
        for k, w in enumerate(weights):
            run = np.r_[0.0, np.cumsum(w[key], dtype=np.float64)]
            out[k] += run[last] - run[first]
    out *= SCALE / _counted(offsets)
    return out + np.array([w[-1] for w in weights])[:, None]


def train_svm(rows: Features, y: np.ndarray, c: float = 10.0, rounds: int = 20) -> np.ndarray:
    """Weights and, last, the bias of a linear machine with squared hinge loss, by dual coordinate descent."""
    w, alpha, rng = np.zeros(BUCKETS + 1), np.zeros(len(rows)), np.random.default_rng(0)
    q = np.array([(v * v).sum() + 1 for _, v in map(rows.__getitem__, range(len(rows)))]) + 0.5 / c
    for _ in range(rounds):
        most = 0.0
        for i in rng.permutation(len(rows)):
            bucket, value = rows[i]
            g = y[i] * (w[bucket] @ value + w[-1]) - 1 + alpha[i] * 0.5 / c
            new = max(alpha[i] - g / q[i], 0.0)
            step = (new - alpha[i]) * y[i]
            if step:
                w[bucket] += step * value
                w[-1] += step
                most = max(most, abs(g))
            alpha[i] = new
        if most < 1e-2:
            break
    return w


def _machines(languages: list[str]) -> tuple[list[str], list[tuple[int, str, str]], list[tuple[str, int, bool]]]:
    """Families of the languages, the machines (number and the two that it tells apart: families first, then the languages of
    each), and which machines learn from a language, on which side."""
    families = sorted({FAMILY_OF.get(x, x) for x in languages})
    pairs = list(combinations(families, 2))
    learn = [(x, k, FAMILY_OF.get(x, x) == a) for k, (a, b) in enumerate(pairs) for x in languages if FAMILY_OF.get(x, x) in (a, b)]
    for f in families:
        for a, b in combinations([x for x in languages if FAMILY_OF.get(x, x) == f], 2):
            learn += [(a, len(pairs), True), (b, len(pairs), False)]
            pairs.append((a, b))
    return families, [(k, a, b) for k, (a, b) in enumerate(pairs)], learn


def _learned(rows: pa.Table) -> pa.Table:
    """The weights of one machine, from the lower-case texts of its two sides."""
    release()
    rows = rows.sort_by([("lang", "ascending"), ("text", "ascending")])
    number, y = rows["machine"][0].as_py(), np.where(rows["first"].to_numpy(), 1.0, -1.0)
    weights = train_svm(Features(rows["text"]), y).astype(np.float32)
    return pa.table([pa.array([number], pa.int32()), pa.array([weights.tobytes()], pa.binary())], names=["machine", "weights"])


def train(sample: DataFrame) -> dict | None:
    """Model from lower-case texts with their languages: families, and the machines between families and between languages of a
    family. Each machine is trained in a task of its own; the driver gets their weights."""
    languages = sorted(r["lang"] for r in sample.select("lang").distinct().collect())
    if not languages:
        return None
    families, machines, learn = _machines(languages)
    weights = {}
    if learn:
        sides = sample.sparkSession.createDataFrame(learn, "lang string, machine int, first boolean")
        got = sample.join(F.broadcast(sides), "lang").groupBy("machine").applyInArrow(_learned, "machine int, weights binary").toArrow()
        weights = {k: np.frombuffer(w, np.float32) for k, w in zip(got["machine"].to_pylist(), got["weights"].to_pylist(), strict=True)}
    made = [(a, b, weights[k]) for k, a, b in machines]
    between = len(families) * (len(families) - 1) // 2
    within, at = {}, between
    for f in families:
        names = [x for x in languages if FAMILY_OF.get(x, x) == f]
        n = len(names) * (len(names) - 1) // 2
        within[f] = (names, made[at : at + n])
        at += n
    return {"families": families, "between": made[:between], "within": within}


def _vote(names: list[str], machines: list, margins: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the winner and its score: the mean probability against the others."""
    votes, total, chance = (np.zeros((len(names), n)) for _ in range(3))
    for (a, b, _), m in zip(machines, margins, strict=True):
        i, j = names.index(a), names.index(b)
        p = 1 / (1 + np.exp(-np.clip(4 * m, -50, 50)))
        for k, sign, chances in ((i, m, p), (j, -m, 1 - p)):
            votes[k] += sign > 0
            total[k] += sign
            chance[k] += chances
    best = np.argmax(votes * 1e6 + total, axis=0)
    return best, chance[best, np.arange(n)] / max(len(names) - 1, 1) if len(names) > 1 else np.ones(n)


def predict(model: dict, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """Language and score of lower-case texts."""
    n, families = len(texts), model["families"]
    all_machines = [*model["between"], *(m for f in families for m in model["within"][f][1])]
    margins = _margins(texts, [w for _, _, w in all_machines])
    at = len(model["between"])
    best, score = _vote(families, model["between"], list(margins[:at]), n)
    lang, out = [""] * n, np.zeros(n)
    for f, name in enumerate(families):
        names, machines = model["within"][name]
        on = np.flatnonzero(best == f)
        winner, chance = _vote(names, machines, list(margins[at : at + len(machines), on]), len(on))
        at += len(machines)
        for k, i in enumerate(on):
            lang[i] = names[winner[k]]
        out[on] = score[on] * chance
    return lang, out


_OUT = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])


def _hashed(n: int) -> F.Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n))


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> dict | None:
    """Trains on rows whose crc32(doc_id) mod 4 is not 2: per_language texts of each language at most."""
    rows = docs.select("doc_id", F.lower("text").alias("text"), "lang").where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (_hashed(4) != 2))
    chosen = bounded_sample(rows.select("doc_id", "lang"), "lang", "doc_id", per_language).withColumnRenamed("lang", "chosen")
    sample = rows.join(F.broadcast(chosen), (rows.doc_id == chosen.doc_id) & (rows.lang == chosen.chosen), "left_semi").select("text", "lang").dropDuplicates()
    # the chosen keys, per_language for each language at most, are broadcast: texts are not shuffled for them
    return train(cut(sample))  # at most per_language texts of each language


def identify(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, lang_pred and score of every row of docs."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("text"))
    none = F.coalesce(~F.col("text").rlike(r"\p{L}"), F.lit(True))
    if model is None:
        return d.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    flagged = d.select("doc_id", F.when(~none, F.col("text")).alias("text"))
    scored = flagged.mapInArrow(lambda batches: _known(batches, model), "doc_id long, lang_pred string, score double")
    return scored


def identified_rows(docs: DataFrame, model: dict | None) -> DataFrame:
    """The rows of docs in which a language was found, with all their columns; nothing is shuffled."""
    if model is None:
        return docs.where("false")
    (lower,) = fresh(docs, "lower")
    flagged = docs.withColumn(lower, F.when(F.col("text").rlike(r"\p{L}"), F.lower("text")))
    return flagged.mapInArrow(lambda batches: _found(batches, model, lower), docs.schema)


def _languages(texts: pa.Array, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """Language and score of lower-case texts, ``und`` where the text is null."""
    valid = np.flatnonzero(texts.is_valid().to_numpy(zero_copy_only=False))
    lang, score = np.full(len(texts), "und", object), np.zeros(len(texts))
    for part in slices(pa.RecordBatch.from_arrays([texts.take(pa.array(valid))], names=["text"]), "text", 2 << 20):
        some, valid = valid[: part.num_rows], valid[part.num_rows :]
        lang[some], score[some] = predict(model, part.column("text"))
    return lang, score


def _found(batches: Iterator[pa.RecordBatch], model: dict, lower: str) -> Iterator[pa.RecordBatch]:
    release()
    for batch in batches:
        lang, _ = _languages(batch.column(lower), model)
        yield batch.drop_columns([lower]).filter(pa.array(lang != "und"))


def _known(batches: Iterator[pa.RecordBatch], model: dict) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lang, score = _languages(batch.column("text"), model)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang.tolist(), pa.string()), pa.array(score)], schema=_OUT)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs)).select("doc_id", F.coalesce(_hashed(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
