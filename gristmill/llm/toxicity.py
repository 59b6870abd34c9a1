"""Operator 6: toxicity by the nearest labelled examples.

Terms are words and their first bytes, in lower case, each hashed to one of FEATURES features, as usual for texts of any
vocabulary; document frequencies of all features are counted over all documents. A bounded sample of labelled rows are the
examples. A document's nearest examples by exact TF-IDF cosine over all features of both are found with an inverted index.
Examples come in blocks of like ones (of one language, about). Terms that more than DENSE of a block have are kept as whole rows
there, and a product for each block adds them up for some documents at a time, which are grouped so that they have many of these
terms in common; the other lists are read whole. Sums in single precision only choose candidates, by a margin; their cosines are then
computed in double precision. Neighbours vote, weighted by nearness and by the share of their class that was sampled; a
logistic curve over left-one-out votes of the examples calibrates the votes. Evidence are the doc_ids and cosines of the
nearest examples.

Labels are learned only from rows whose crc32(doc_id) mod 5 is not 0, at most PER_LABEL rows of each label, equal texts
once. A document without any feature of an example (also null or empty text) gets the share of toxic rows among examples without terms.
Very long texts count whole. Null labels are not learned; a doc_id with both labels is toxic; without labelled rows every score is 0. Repeated rows: each has
its result. Ties between examples: the smaller doc_id first. A null doc_id counts as not held out. Columns other than
doc_id and text may have any names. Empty table: no rows.
"""

from __future__ import annotations

import pickle
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, cut, kept, letters, mix64, slices, table, utf8

#: Labelled rows of each label that are learned from at most.
PER_LABEL = 6000
NEIGHBOURS = 15
#: Features that terms are hashed to (a power of two); frequencies take 8 bytes each, on the driver and in each worker.
FEATURES = 1 << 20
#: What single precision may be wrong by.
MARGIN = 1e-4
#: Examples whose postings are dealt to their lists at a time, while an index is built: FIRST blocks of BLOCK.
BLOCK = 256
FIRST = 4
#: Share of a block's examples that have a term, above which it is a whole row there; the same of all examples, for the main directions.
DENSE = 0.08
OFTEN = 0.06
#: Examples whose votes calibrate the curve, at least, where there are as many.
CALIBRATED = 2000
#: Main directions by whose sides texts are grouped.
AXES = 3
#: Sums of texts and examples that are held at a time, about, and postings that are read at a time.
TOGETHER = 1_500_000
POSTINGS = 200_000
PREFIXES = (4, 5, 6, 7)

_LETTERS = letters()
_BASE = 0x9E3779B97F4A7C15
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64))


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features of the terms of lower-case texts and the row of each: words, and their first bytes."""
    data, offsets = utf8(texts)
    n = len(data)
    b = _LETTERS[data]
    inside = b != 32
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    space = np.r_[True, ~inside]
    start = np.flatnonzero(inside & (space[:n] | edge[:n]))
    end = np.flatnonzero(inside & (np.r_[~inside[1:], True] | edge[1:])) + 1
    powers = np.full(n + 1, pow(_BASE, -1, 1 << 64), np.uint64)
    powers[:1] = 1
    np.cumprod(powers, out=powers)
    sums = np.r_[np.uint64(0), np.cumsum(_BYTE[b] * powers[:n], dtype=np.uint64)]
    raise_ = np.full(n + 1, _BASE, np.uint64)
    raise_[:1] = 1
    np.cumprod(raise_, out=raise_)
    row = np.searchsorted(offsets, start, side="right") - 1
    size = end - start
    hashes, rows = [mix64((sums[end] - sums[start]) * raise_[start] + np.uint64(1))], [row]
    for p in PREFIXES:
        on = size > p
        s = start[on]
        hashes.append(mix64((sums[s + p] - sums[s]) * raise_[s] + np.uint64(2)))
        rows.append(row[on])
    return np.concatenate(hashes) >> np.uint64(65 - FEATURES.bit_length()), np.concatenate(rows)


def _held_out() -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))


def counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, feature and count of the features of each text; ordered by row."""
    feature, row = terms(texts)
    cell, count = np.unique(row * FEATURES + feature.astype(np.int64), return_counts=True)
    return *np.divmod(cell, FEATURES), count


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each task's rows that have each feature."""
    n = np.zeros(FEATURES, np.int64)
    for batch in batches:
        for part in slices(batch, "text", 2 << 20):
            n += np.bincount(counts(part.column("text"))[1], minlength=FEATURES)
    on = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(on), pa.array(n[on])], names=["feature", "n"])


def document_frequency(texts: DataFrame) -> np.ndarray:
    """Rows of texts (lower case) that have each feature: FEATURES numbers, whatever the input."""
    part = texts.select("text").mapInArrow(_counted, "feature long, n long")
    found = part.groupBy("feature").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(FEATURES, np.int64)
    out[found.column("feature").to_numpy()] = found.column("n").to_numpy()
    return out


def weighted(row: np.ndarray, feature: np.ndarray, count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF weights, with which each row has unit length over all its features."""
    weight = (1 + np.log(count)) * idf[feature]
    norm = np.sqrt(np.bincount(row, weights=weight * weight))
    return weight / np.maximum(norm[row], 1e-300)


class InvertedIndex:
    """Lists of the examples that have each term, and whole rows of weights for terms that many examples of a block have.

    A block are the examples on the same sides of the main directions, of one language about: a term that is frequent in one
    language is a whole row there only. Inside the index examples have places, by which those of a block come together.
    """

    def __init__(self, row: np.ndarray, number: np.ndarray, weight: np.ndarray, ids: np.ndarray, terms: int):
        """Postings are ordered by row; they are dealt to their lists some examples at a time, so nothing sorts all of them."""
        self.ids, self.n, self.terms = ids, len(ids), terms
        self.own, self.own_number, self.own_weight = np.searchsorted(row, np.arange(self.n + 1)), number, weight
        self.axes, self.axis_of, self.middle, side = self._axes(row, number, weight)
        self.example = np.argsort(side, kind="stable")
        self.place = np.argsort(self.example, kind="stable")
        self.cuts = np.unique(np.r_[0, np.flatnonzero(np.diff(side[self.example])) + 1, self.n])
        sizes = np.diff(self.cuts)
        block = (np.searchsorted(self.cuts, self.place, side="right") - 1).astype(np.int8)
        having = np.zeros((len(sizes), terms), np.int32)
        of = block[row]
        for b in range(len(sizes)):
            having[b] = np.bincount(number[of == b], minlength=terms)
        often = having > DENSE * sizes[:, None]
        self.dense = np.flatnonzero(often.any(axis=0))  # terms that are a whole row in some block
        self.dense_at = np.full(terms, -1, np.int32)
        self.dense_at[self.dense] = np.arange(len(self.dense), dtype=np.int32)
        self.dense_row = np.where(often[:, self.dense], np.cumsum(often[:, self.dense], axis=1) - 1, -1).astype(np.int32)
        self.whole = [np.zeros((k, size), np.float32) for k, size in zip(often.sum(axis=1).tolist(), sizes.tolist(), strict=True)]
        having[often] = 0
        self.start = np.r_[0, np.cumsum(having.sum(axis=0), dtype=np.int64)]
        self.postings = np.empty(self.start[-1], np.int64)  # of a place and a weight, which are read together
        self.row, self.weight = self.postings.view(np.uint32)[::2], self.postings.view(np.float32)[1::2]
        del having, often
        filled = self.start[:-1].copy()
        for begin in range(0, self.n, FIRST * BLOCK):
            some = slice(self.own[begin], self.own[min(begin + FIRST * BLOCK, self.n)])
            r, k, w, o = self.place[row[some]], number[some], weight[some].astype(np.float32), of[some]
            at = self.dense_at[k]
            at = np.where(at >= 0, self.dense_row[o, at], -1) if len(self.dense) else at
            on = at >= 0
            for b, whole in enumerate(self.whole):
                here = on & (o == b)
                whole[at[here], r[here] - self.cuts[b]] = w[here]
            r, k, w = r[~on], k[~on], w[~on]
            if not len(k):
                continue
            order = np.argsort(k, kind="stable")
            r, k, w = r[order], k[order], w[order]
            first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            size, of_ = np.diff(np.r_[first, len(k)]), k[first]
            at = np.repeat(filled[of_] - first, size) + np.arange(len(k))
            self.row[at], self.weight[at] = r, w
            filled[of_] += size

    def _axes(self, row: np.ndarray, number: np.ndarray, weight: np.ndarray, rounds: int = 15) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Main directions of the terms that many examples have, the place of each term in them (or -1), where the examples'
        middle lies on them, and the side of each example: they tell languages apart, about."""
        often = np.bincount(number, minlength=self.terms) > OFTEN * self.n
        axis_of = np.where(often, np.cumsum(often) - 1, -1).astype(np.int32)
        at = axis_of[number]
        on = at >= 0
        matrix = np.zeros((int(often.sum()), self.n), np.float32)
        matrix[at[on], row[on]] = weight[on]
        axes = np.random.default_rng(0).normal(size=(len(matrix), AXES)).astype(np.float32)
        for _ in range(rounds):
            along = matrix.T @ axes
            axes = np.linalg.qr(matrix @ (along - along.mean(axis=0)))[0] if min(axes.shape) else axes
        along = matrix.T @ axes
        middle = along.mean(axis=0) if self.n else np.zeros(axes.shape[1], np.float32)
        return axes, axis_of, middle, self._side(along, middle)

    @staticmethod
    def _side(along: np.ndarray, middle: np.ndarray) -> np.ndarray:
        return (along > middle) @ (1 << np.arange(len(middle)))

    def _sides(self, row: np.ndarray, number: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
        """On which sides of the main directions n texts lie."""
        at = self.axis_of[number]
        on = at >= 0
        row, at, weight = row[on], at[on], weight[on]
        along = [np.bincount(row, weights=weight * axis[at], minlength=n) for axis in self.axes.T]
        return self._side(np.stack(along, axis=1), self.middle)

    def nearest(self, row: np.ndarray, number: np.ndarray, weight: np.ndarray, n: int, k: int, but: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For n texts with these vectors (ordered by row): text, example and cosine of the k largest cosines above 0 of each
        text, from the largest, the smaller doc_id first at ties; but: an example for each text that is left out."""
        ends = np.searchsorted(row, np.arange(n + 1))
        out, together = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))], max(1, TOGETHER // max(self.n, 1))
        side = self._sides(row, number, weight, n)
        # texts on the same sides come together: they have many terms in common, and need fewer of the whole rows
        order = np.argsort(side, kind="stable")
        cuts = sorted({*range(0, n, together), *np.flatnonzero(np.diff(side[order])) + 1, n})
        for begin, end in zip(cuts, cuts[1:]):
            some = order[begin:end]
            at, of = _ranges(ends[some], ends[some + 1])
            text, example, cosine = self._some(of, number[at], weight[at], end - begin, k, None if but is None else but[some])
            out.append((some[text], example, cosine))
        text, example, cosine = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.argsort(text, kind="stable")
        return text[order], example[order], cosine[order]

    def _products(self, row: np.ndarray, number: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
        """Products of n texts with the whole rows of each block, by places."""
        total, at = np.empty((n, self.n), np.float32), self.dense_at[number]
        on = at >= 0
        row, at, weight = row[on], at[on], weight[on]
        for b, whole in enumerate(self.whole):
            mine = self.dense_row[b, at]
            on = mine >= 0
            asked = np.zeros((n, len(whole)), np.float32)
            asked[row[on], mine[on]] = weight[on]
            used = np.flatnonzero(asked.any(axis=0))
            # few rows are worth a copy of them
            total[:, self.cuts[b] : self.cuts[b + 1]] = asked[:, used] @ whole[used] if len(used) < len(whole) / 2 else asked @ whole
        return total

    def _some(self, row: np.ndarray, number: np.ndarray, weight: np.ndarray, n: int, k: int, but: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        total = self._products(row, number, weight, n)
        begin, end = self.start[number], self.start[number + 1]
        on = end > begin
        ends = np.searchsorted(row[on], np.arange(n + 1)).tolist()
        begin, end, heavy = begin[on], end[on], weight[on].astype(np.float32)
        texts, examples = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for t in range(n):
            mine = slice(ends[t], ends[t + 1])
            found = self._candidates(total[t], begin[mine], end[mine], heavy[mine], k, None if but is None else int(self.place[but[t]]))
            texts.append(np.full(len(found), t))
            examples.append(self.example[found])
        text, example = np.concatenate(texts), np.concatenate(examples)
        cosine = self._cosines(row, number, weight, n, text, example)
        order = np.lexsort((self.ids[example], -np.round(cosine, 12), text))
        text = text[order]
        place = np.arange(len(text)) - np.searchsorted(text, text)
        order = order[place < k]
        return text[place < k], example[order], cosine[order]

    def _candidates(self, total: np.ndarray, begin: np.ndarray, end: np.ndarray, weight: np.ndarray, k: int, but: int | None) -> np.ndarray:
        """Places that may be among the k nearest of one text; total: its products with the whole rows, begin and end: its lists.
        All lists are read: a text's nearest examples are hardly nearer than others, so bounds would leave out few."""
        sums, size, a = total.astype(np.float64), end - begin, 0
        until = np.cumsum(size)
        while a < len(size):
            b = max(a + 1, int(np.searchsorted(until, until[a] - size[a] + POSTINGS, side="right")))
            s, stop = size[a:b], until[a:b] - (until[a] - size[a])
            at = np.repeat(begin[a:b] - (stop - s), s)
            at += np.arange(stop[-1])
            read = self.postings.take(at)
            part = read.view(np.float32)[1::2] * np.repeat(weight[a:b], s)
            sums += np.bincount(read.view(np.uint32)[::2], weights=part, minlength=self.n)
            a = b
        if but is not None:
            sums[but] = 0
        least = np.partition(sums, -k)[-k] if self.n > k else 0.0
        return np.flatnonzero((sums > 0) & (sums >= least - MARGIN))

    def _cosines(self, row: np.ndarray, number: np.ndarray, weight: np.ndarray, n: int, text: np.ndarray, example: np.ndarray) -> np.ndarray:
        """Inner products of pairs of texts (ordered) and examples, in double precision."""
        out, asked = np.zeros(len(text)), np.zeros(self.terms)
        ends, pairs = np.searchsorted(row, np.arange(n + 1)).tolist(), np.searchsorted(text, np.arange(n + 1)).tolist()
        begin, end = self.own[example].tolist(), self.own[example + 1].tolist()
        for t in range(n):
            mine = number[ends[t] : ends[t + 1]]
            asked[mine] = weight[ends[t] : ends[t + 1]]
            for pair in range(pairs[t], pairs[t + 1]):
                at = slice(begin[pair], end[pair])
                out[pair] = asked.take(self.own_number[at]) @ self.own_weight[at]
            asked[mine] = 0
        return out


def _ranges(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, and the range of each."""
    size = (end - begin).astype(np.int64)
    of = np.repeat(np.arange(len(size)), size)
    return np.arange(len(of)) + (begin - np.cumsum(size) + size)[of], of


class Examples:
    """The index of a model's examples, as each worker builds it from their features."""

    def __init__(self, model: dict):
        sizes = np.array([len(f) // 4 for f in model["features"]], np.int64)
        some = np.flatnonzero(sizes)
        feature = np.frombuffer(b"".join(model.pop("features")), "<i4")
        weight = np.log(np.frombuffer(b"".join(model.pop("counts")), "<u4").astype(np.float64))
        weight += 1
        weight *= model["idf"][feature]
        row = np.repeat(np.arange(len(some), dtype=np.int32), sizes[some])
        norm = np.sqrt(np.bincount(row, weights=weight * weight, minlength=len(some)))
        weight /= np.maximum(norm, 1e-300)[row]
        self.idf, self.number = model["idf"], np.full(FEATURES, -1, np.int32)
        having = np.bincount(feature, minlength=FEATURES)
        known = np.argsort(-having, kind="stable")[: np.count_nonzero(having)]  # frequent ones together, where caches keep them
        self.number[known] = np.arange(len(known), dtype=np.int32)
        number = self.number[feature]
        del feature
        for a, b in zip((ends := np.r_[0, np.cumsum(sizes[some])].tolist()), ends[1:]):  # frequent terms of an example first
            order = np.argsort(number[a:b])
            number[a:b], weight[a:b] = number[a:b][order], weight[a:b][order]
        self.index = InvertedIndex(row, number, weight, model["ids"][some], len(known))
        self.toxic, self.class_weight = model["toxic"][some], model["class_weight"]

    def asked(self, row: np.ndarray, feature: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, number and weight of the examples' features in texts; the weights are those of texts with all their features."""
        weight = weighted(row, feature, count, self.idf)
        on = self.number[feature] >= 0
        return row[on], self.number[feature[on]], weight[on]

    def votes(self, text: np.ndarray, example: np.ndarray, cosine: np.ndarray, n: int) -> np.ndarray:
        """Share of toxic votes among the neighbours of each of n texts; NaN without neighbours."""
        near = self.class_weight[self.toxic[example]] / (np.sqrt(np.maximum(2 - 2 * cosine, 0)) + 0.1)
        with np.errstate(invalid="ignore"):
            return np.bincount(text, weights=near * self.toxic[example], minlength=n) / np.bincount(text, weights=near, minlength=n)

    def left_out(self, some: np.ndarray) -> np.ndarray:
        """Votes on some examples (places in the index), each left out of the search."""
        own = self.index
        at, of = _ranges(own.own[some], own.own[some + 1])
        return self.votes(*own.nearest(of, own.own_number[at], own.own_weight[at], len(some), NEIGHBOURS, some), len(some))


def examples_of(shared, key: str) -> Examples:
    """One for each Python worker, which Spark uses for many tasks."""
    return kept(key, lambda: Examples(pickle.loads(zlib.decompress(shared.value))))


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a weighted logistic curve, with a little regularization, by Newton's method."""
    a, b = 4.0, -2.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a * x + b)))
        g = np.array([(w * (p - y) * x).sum() + 1e-2 * (a - 4), (w * (p - y)).sum() + 1e-2 * (b + 2)])
        v = w * p * (1 - p)
        h = np.array([[(v * x * x).sum() + 1e-2, (v * x).sum()], [(v * x).sum(), v.sum() + 1e-2]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features and counts of each example: what a long text has of them is bounded."""
    for batch in batches:
        for part in slices(batch, "text", 2 << 20):
            row, feature, count = counts(part.column("text"))
            ends = np.searchsorted(row, np.arange(part.num_rows + 1)).tolist()
            cut_up = lambda x, t: pa.array([x[a:b].astype(t).tobytes() for a, b in zip(ends, ends[1:])], pa.binary())  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("toxic"), cut_up(feature, "<i4"), cut_up(count, "<u4")], names=["doc_id", "toxic", "features", "counts"])


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> dict | None:
    """Examples and calibration from labelled rows that are not held out. The driver gathers the examples' features, and
    sends them to the workers, which build the index; left-one-out votes are made there too."""
    spark = docs.sparkSession
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(~_held_out())
    marks = cut(marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    total = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not total:
        return None
    chosen = bounded_sample(marks, "toxic", "doc_id", per_label)
    sample = texts.join(F.broadcast(chosen), "doc_id").groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic"))
    examples = sample.mapInArrow(_listed, "doc_id long, toxic int, features binary, counts binary").toArrow().sort_by("doc_id")  # at most per_label texts of each label
    if not examples.num_rows:
        return None
    toxic, ids = examples.column("toxic").to_numpy(), examples.column("doc_id").to_numpy()
    features, numbers = (examples.column(c).to_pylist() for c in ("features", "counts"))
    everything = texts.count()
    idf = np.log((1 + everything) / (1 + document_frequency(texts))) + 1
    # each example stands for as many labelled rows of its class
    scale = np.array([total.get(k, 0) / max(int((toxic == k).sum()), 1) for k in (0, 1)])
    model = {"features": features, "counts": numbers, "ids": ids, "toxic": toxic, "idf": idf, "class_weight": scale}
    shared, key = spark.sparkContext.broadcast(zlib.compress(pickle.dumps(model), 1)), uuid.uuid4().hex
    some = sum(1 for f in features if f)
    rest = np.array([not f for f in features])
    share = scale[toxic[rest]]
    without = float(((share * toxic[rest]).sum() + total.get(1, 0) / sum(total.values())) / (share.sum() + 1))
    step = max(1, some // CALIBRATED)

    def tried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            e, at = examples_of(shared, key), batch.column("id").to_numpy() * step
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(e.left_out(at)), pa.array(e.toxic[at].astype(np.int32))], names=["vote", "toxic"])

    made = spark.range(0, -(-some // step), 1, spark.sparkContext.defaultParallelism).mapInArrow(tried, "vote double, toxic int").toArrow()
    vote, y = made.column("vote").to_numpy(), made.column("toxic").to_numpy()
    vote, y = vote[np.isfinite(vote)], y[np.isfinite(vote)]
    w = scale[y]
    return {"shared": shared, "key": key, "without": without, "curve": _logistic(vote, y.astype(float), w / w.mean()) if len(y) else (6.0, -3.0)}


_OUT = ["doc_id", "score", "nearest", "cosines"]


def _score(batches: Iterator[pa.RecordBatch], model: dict) -> Iterator[pa.RecordBatch]:
    e = examples_of(model["shared"], model["key"])
    slope, shift = model["curve"]
    for batch in batches:
        for part in slices(batch, "text", 2 << 20):
            n = part.num_rows
            text, example, cosine = e.index.nearest(*e.asked(*counts(part.column("text"))), n, NEIGHBOURS)
            votes = e.votes(text, example, cosine, n)
            score = np.where(np.isfinite(votes), 1 / (1 + np.exp(-(slope * votes + shift))), model["without"])
            ends = pa.array(np.searchsorted(text, np.arange(n + 1)).astype(np.int32))
            near, cosines = (pa.ListArray.from_arrays(ends, pa.array(x)) for x in (e.index.ids[example], cosine))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score), near, cosines], names=_OUT)


def toxicity(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, score, nearest (doc_ids of examples), cosines of every row."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    if model is None:
        return texts.select("doc_id", F.lit(0.0).alias("score"), F.array().cast("array<long>").alias("nearest"), F.array().cast("array<double>").alias("cosines"))
    return texts.mapInArrow(lambda batches: _score(batches, model), "doc_id long, score double, nearest array<long>, cosines array<double>")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", _held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "nearest")
