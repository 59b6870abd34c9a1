"""Operator 3: near-duplicates by b-bit MinHash.

A document's set holds its distinct five-word shingles. Of PERMUTATIONS minima of the set, bands of ROWS minima make
candidates, and the low BITS of each minimum, packed in longs, estimate the similarity of candidates by bit counts,
corrected for the chance that differing minima agree in those bits. Candidates whose estimate is not far too low are
confirmed on their full sets; confirmed links make components.

Documents with equal sets are one class, which is one node of the links. Within a band's bucket of at most SMALL classes
all pairs are candidates; in a larger one all are compared with HUBS of them, and then only those that are still in
different components with each other, and only where a shingle that both hold comes early enough in both sets, ordered
from the rarest shingle on: with a similarity of 0.75 or more, the first common shingle leaves room behind it, in both
sets, for all that they must share. So neither copies of copies nor common passages make all pairs, and no link is lost.
Pairs whose sizes alone forbid the similarity are no candidates. A pair at similarity 0.75 shares no band with a chance of
(1 - 0.75**4)**32 = 5e-6, and an estimate below LEAST_ESTIMATE with about the same.

Documents with one to four words have their whole sequence of words as one shingle; null texts and texts without words
have an empty set and link with nothing. Very long texts: one row of 8 bytes a shingle, read whole. Rows with a null doc_id
come after all others and have a null component_id if they are alone. Rows with the same doc_id and different texts are
different nodes; repeated rows are members of one class. Ties: the smallest doc_id names a component. Columns other than
doc_id and text may have any names. Empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, cut, documents, fresh, mix64, one_of_each, release, slices, table, utf8, words

SHINGLE = 5
PERMUTATIONS, ROWS, BITS = 128, 4, 4
BANDS = PERMUTATIONS // ROWS
SMALL = 16
#: Members of a large bucket that all others are compared with first.
HUBS = 2
#: Estimates below it are not confirmed: four and a half standard deviations (0.04) of the estimate under 0.75.
LEAST_ESTIMATE = 0.57
#: Bits of the bitmap that finds the texts of candidates, at most (16 MB); where it is full, more rows than needed go along.
FILTER = 1 << 27

_NULL_ID = (1 << 63) - 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64))
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def shingles(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the shingles of texts, repeats included, text after text, and the offsets of the texts."""
    data, offsets = utf8(texts)
    n = len(data)
    start, end, first = words(data, offsets)
    sums = np.r_[np.uint64(0), np.cumsum(_BYTE[_LOWER[data]] * _powers(_INVERSE, n), dtype=np.uint64)]
    word = mix64((sums[end] - sums[start]) * _powers(_BASE, n + 1)[end] + (end - start).astype(np.uint64))
    count = np.diff(first)
    out_n = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    bounds = np.r_[0, np.cumsum(out_n)]
    at = np.repeat(first[:-1] - bounds[:-1], out_n) + np.arange(bounds[-1])
    length = np.repeat(np.minimum(count, size), out_n)
    padded = np.r_[word, np.zeros(size, np.uint64)]
    h = length.astype(np.uint64)
    for k in range(size):
        h = h * _BASE + np.where(length > k, padded[at + k], np.uint64(0))
    return mix64(h), bounds


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in ascending order, and the offsets of the texts."""
    h, bounds = shingles(texts, size)
    parts = [np.unique(h[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    return np.concatenate([np.empty(0, np.uint64), *parts]), np.r_[0, np.cumsum([len(p) for p in parts], dtype=np.int64)]


_RNG = np.random.default_rng(7)
_XOR = _RNG.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32)
_FACTOR = _RNG.integers(0, 1 << 31, PERMUTATIONS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def minima(sets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """PERMUTATIONS minima of each set, as columns; sets must not be empty."""
    x = (sets >> np.uint64(32)).astype(np.uint32)
    out = np.empty((PERMUTATIONS, len(starts)), np.uint32)
    for k in range(PERMUTATIONS):
        v = (x ^ _XOR[k]) * _FACTOR[k]
        v ^= v >> np.uint32(15)
        v *= np.uint32(0x85EBCA6B)
        v ^= v >> np.uint32(13)
        out[k] = np.minimum.reduceat(v, starts)
    return out


def packed(mins: np.ndarray) -> np.ndarray:
    """Low BITS of the minima, packed into longs: one row for each set."""
    per = 64 // BITS
    low = (mins & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(-1, per, mins.shape[1])
    shift = (np.arange(per, dtype=np.uint64) * np.uint64(BITS))[None, :, None]
    return np.bitwise_or.reduce(low << shift, axis=1).T.copy().view(np.int64)


def band_keys(mins: np.ndarray) -> np.ndarray:
    h = np.repeat(np.arange(1, BANDS + 1, dtype=np.uint64)[:, None], mins.shape[1], axis=1)
    for k in range(ROWS):
        h = mix64(h * _BASE + mins[k::ROWS].astype(np.uint64))
    return h.T.copy().view(np.int64)


_SKETCH = "id long, mark long, n_shingles long, digest binary, signature array<long>, bands array<long>"


def _list(values: np.ndarray, width: int) -> pa.Array:
    n = len(values) // width
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(values))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    for batch in batches:
        for part in slices(batch, "text", 1 << 20):
            sets, bounds = shingle_sets(part.column("text"))
            n = np.diff(bounds)
            some = np.flatnonzero(n)
            signature, bands = np.zeros((len(n), PERMUTATIONS * BITS // 64), np.int64), np.zeros((len(n), BANDS), np.int64)
            if len(some):
                mins = minima(sets, bounds[:-1][some])
                signature[some], bands[some] = packed(mins), band_keys(mins)
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("mark"), pa.array(n), digests(sets, bounds), _list(signature.ravel(), signature.shape[1]), _list(bands.ravel(), BANDS)],
                names=["id", "mark", "n_shingles", "digest", "signature", "bands"],
            )


def digests(sets: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """16 bytes that stand for each set: sum and exclusive or of its scrambled shingles."""
    out = np.zeros((len(bounds) - 1, 2), np.uint64)
    some = np.flatnonzero(np.diff(bounds))
    if len(some):
        out[some, 0] = np.add.reduceat(sets, bounds[:-1][some])
        out[some, 1] = np.bitwise_xor.reduceat(mix64(sets + np.uint64(1)), bounds[:-1][some])
    return pa.array([x.tobytes() for x in out], pa.binary())


def _sets(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """Digests and sets of the rows whose place is marked in the bitmap."""
    release()
    bitmap = shared.value
    for batch in batches:
        place = batch.column("place").to_numpy()
        on = np.flatnonzero(bitmap[place >> 3] >> (place & 7).astype(np.uint8) & 1)
        for part in slices(batch.take(pa.array(on)), "text", 1 << 20):
            sets, bounds = shingle_sets(part.column("text"))
            yield pa.RecordBatch.from_arrays([digests(sets, bounds), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(sets.view(np.int64)))], names=["digest", "shingles"])


def estimate(a: Column, b: Column) -> Column:
    """Similarity estimated from two packed signatures, corrected for chance agreement of low bits."""
    longs = PERMUTATIONS * BITS // 64
    ones = F.lit(int("1" * 16, 16))
    differ = F.lit(0)
    for k in range(longs):
        x = a.getItem(k).bitwiseXOR(b.getItem(k))
        x = x.bitwiseOR(F.shiftright(x, 1))
        x = x.bitwiseOR(F.shiftright(x, 2))
        differ = differ + F.bit_count(x.bitwiseAND(ones))
    agree, chance = 1 - differ / PERMUTATIONS, 2.0**-BITS
    return (agree - chance) / (1 - chance)


def components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node) of the ends of edges (a, b), by alternating large and small stars."""
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        e = cut(small.select("u", F.col("m").alias("v")).unionByName(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct())
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == seen:
            break
        seen = tuple(now)
    ends = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return ends.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _sizes(a: str, b: str) -> Column:
    """Whether sets of these sizes can have a similarity of 0.75 at all."""
    return 100 * F.least(a, b) >= 75 * F.greatest(a, b)


def _likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) whose signatures do not speak against a similarity of 0.75."""
    of = lambda end, mark: classes.select(F.col("node").alias(end), F.col("signature").alias(mark))
    pairs = pairs.join(of("b", "mb"), "b").join(of("a", "ma"), "a")
    return pairs.where(estimate(F.col("ma"), F.col("mb")) >= LEAST_ESTIMATE).select("a", "b")


def _sets_of(nodes: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """node and shingles (its full set) of these nodes.

    Texts are not shuffled for it: a bitmap over hashes of the smallest doc_ids of the nodes shows each task which rows may
    be wanted, and their sets meet the nodes by digest.
    """
    spark = docs.sparkSession
    wanted = cut(classes.join(nodes, "node", "left_semi").select("node", "digest", "rep"))
    bits = min(FILTER, 1 << max(15, (16 * wanted.count()).bit_length()))
    place = lambda column: F.pmod(F.xxhash64(column), F.lit(bits))
    at = place("rep")
    pages = wanted.groupBy(F.shiftright(at, 15).alias("page")).agg(F.bitmap_construct_agg(at.bitwiseAND(F.lit(32767))).alias("bits")).collect()  # bits / 8 bytes in all
    bitmap = np.zeros((bits >> 15, 1 << 12), np.uint8)
    for r in pages:
        bitmap[r["page"]] = np.frombuffer(bytes(r["bits"]), np.uint8)
    shared = spark.sparkContext.broadcast(bitmap.ravel())
    found = docs.select("text", place("id").alias("place")).mapInArrow(lambda batches: _sets(batches, shared), "digest binary, shingles array<long>")
    found = found.groupBy("digest").agg(F.first("shingles").alias("shingles"))  # equal sets, once
    return cut(found.join(wanted.select("digest", "node"), "digest").select("node", "shingles"))


def _early_pairs(apart: DataFrame, sets: DataFrame) -> DataFrame:
    """Likely pairs of different components with a common shingle that comes early enough in both sets, from the rarest on."""
    shingle = cut(sets.select("node", F.explode("shingles").alias("shingle")))
    ranked = shingle.join(shingle.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")), "shingle")
    order = ranked.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "shingle"))).alias("all"))  # of one document
    some = F.size("all") - F.ceil(0.75 * F.size("all")).cast("int") + 1
    early = order.select("node", F.posexplode(F.slice("all", F.lit(1), some)).alias("at", "s")).where("s.n > 1").select("node", "at", F.col("s.shingle").alias("shingle"))
    early = cut(early.join(apart, "node"))
    mixed = early.groupBy("shingle").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("shingle")
    x = early.join(mixed, "shingle", "left_semi").withColumn("behind", F.col("size") - F.col("at"))
    y = x.select("shingle", *(F.col(c).alias(f"{c}2") for c in ("node", "size", "component", "signature", "behind")))
    # 7 * common >= 3 * (sum of sizes) is a similarity of 0.75; common is no more than what comes from here on, in both
    room = 7 * F.least("behind", "behind2") >= 3 * (F.col("size") + F.col("size2"))
    likely = estimate(F.col("signature"), F.col("signature2")) >= LEAST_ESTIMATE
    pairs = x.join(y, (x.shingle == y.shingle) & (F.col("component") < F.col("component2")) & _sizes("size", "size2") & room & likely)
    return pairs.select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b")).distinct()


def _confirmed(candidates: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) whose full sets have a similarity of 0.75 at least."""
    # a set travels once for each pair of which it is the larger end; the smaller end may be the hub of many
    ends = candidates.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b").join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
    common = F.size(F.array_intersect("sa", "sb"))
    linked = ends.withColumn("common", common).where(100 * F.col("common") >= 75 * (F.size("sa") + F.size("sb") - F.col("common")))
    return cut(linked.select("a", "b"))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()


def _grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (id, mark, n_shingles, digest) of docs, and the classes: digest, rep (smallest id), component, label (its smallest id)."""
    d = documents(docs).select(F.coalesce("doc_id", F.lit(_NULL_ID)).alias("id"), F.xxhash64("text").alias("mark"), "text")
    sketch = cut(d.mapInArrow(_sketch, _SKETCH))
    same = sketch.where("n_shingles > 0").groupBy("digest").agg(F.min("id").alias("rep"), *(F.first(c).alias(n) for c, n in (("n_shingles", "size"), ("signature", "signature"), ("bands", "bands"))))
    classes = cut(same.withColumn("node", F.monotonically_increasing_id()))  # written once, so the numbers stay
    member = F.struct("node", "size")
    keys = classes.select("node", "size", F.explode("bands").alias("band"))
    hubs = [F.min(F.struct(F.xxhash64("node", F.lit(k)).alias("h"), "node", "size")) for k in range(HUBS - 1)]
    hubs = F.array_distinct(F.array(F.min(member), *(F.struct(h["node"].alias("node"), h["size"].alias("size")) for h in hubs)))
    buckets = keys.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = cut(keys.join(buckets, "band"))
    small = members.where(F.col("n") <= SMALL).select("band", "node", "size")
    other = small.select("band", F.col("node").alias("node2"), F.col("size").alias("size2"))
    pairs = small.join(other, "band").where((F.col("node") < F.col("node2")) & _sizes("size", "size2")).select(F.col("node").alias("a"), F.col("node2").alias("b"))
    large = members.where(F.col("n") > SMALL)
    hubs = large.groupBy("band").agg(hubs.alias("hubs"))
    beside = large.join(hubs, "band").select("node", "size", F.explode("hubs").alias("hub")).where((F.col("node") != F.col("hub.node")) & _sizes("size", "hub.size"))
    pairs = pairs.unionByName(beside.select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b"))).distinct()
    candidates = cut(_likely(pairs, classes))
    links = _confirmed(candidates, _sets_of(_ends(candidates), classes, d))
    found = cut(components(links))
    # in large buckets, whatever is still apart is compared with what lies in other components
    apart = large.select("band", "node", "size").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = apart.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("band")
    apart = cut(apart.join(mixed, "band", "left_semi").select("node", "size", "component").distinct())
    if not apart.isEmpty():
        sets = _sets_of(apart, classes, d)
        more = _confirmed(cut(_early_pairs(apart.join(classes.select("node", "signature"), "node"), sets)), sets)
        if not more.isEmpty():
            found = cut(components(links.unionByName(more)))
    grouped = classes.select("node", "digest", "rep").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = grouped.groupBy("component").agg(F.min("rep").alias("label"))
    return sketch.select("id", "mark", "n_shingles", "digest"), grouped.join(least, "component").select("digest", "rep", "component", "label")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    rows, classes = _grouped(docs)
    out = rows.join(classes.select("digest", "label"), "digest", "left").withColumn("label", F.when(F.col("n_shingles") > 0, F.col("label")).otherwise(F.col("id")))
    plain = lambda c: F.when(F.col(c) != _NULL_ID, F.col(c))
    return out.select(plain("id").alias("doc_id"), "n_shingles", plain("label").alias("component_id"), (F.col("id") == F.col("label")).alias("kept"))


def near_duplicate_rows(docs: DataFrame) -> DataFrame:
    """One row of each group, with all columns of docs, and every row without words.

    Of a group, the row with the smallest doc_id stays (null is the largest), of those with the same doc_id the one whose
    text has the smallest hash, and of repeated rows any one.
    """
    rows, classes = _grouped(docs)
    stays = rows.where("n_shingles > 0").join(classes.select("digest", "component"), "digest").groupBy("component").agg(F.min(F.struct("id", "mark")).alias("s"))
    id_, mark = fresh(docs, "id", "mark")
    keyed = docs.withColumns({id_: F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)), mark: F.xxhash64(F.coalesce("text", F.lit("")))})
    words = F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    kept = keyed.where(words).join(stays.select(F.col("s.id").alias(id_), F.col("s.mark").alias(mark)), [id_, mark], "left_semi")
    return one_of_each(kept, [id_, mark]).select(*docs.columns).unionByName(docs.where(~words))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS sh FROM w
), n AS (SELECT doc_id, count(*) AS k FROM s GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.k, nb.k HAVING 100 * count(*) >= 75 * (na.k + nb.k - count(*))
), reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
c AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n.k, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""
