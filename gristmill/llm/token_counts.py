"""Operator 13: token counts by overlap resynchronisation.

A text of more than SPAN characters is cut into spans, and each span is encoded with OVERLAP characters of both of its
neighbours, with offsets, by tasks of their own. Where two encodings overlap, they are spliced at a common boundary of
words (the pieces that the pre-tokenizer cuts, which no merge crosses). That boundary is proven, from the first span on:

- The pre-tokenizer goes from left to right and never looks back, so what follows a true boundary does not depend on what
  lies before it: from the common boundary on, the right encoding is that of the whole text.
- It looks ahead by a bounded number of characters, and added tokens have a bounded length: boundaries of the left encoding
  that lie at least ``margin`` characters before its end are true ones.

Tokens of a text = sum over its seams of (tokens of the left encoding before the boundary - those of the right one) + tokens
of the last encoding. Where some seam has no common boundary (a word longer than the overlap), the text is done again with
spans and overlaps that are WIDEN times wider, until all seams hold or it is one span. A tokenizer for which the proof does
not hold (another pre-tokenizer, a normalizer, added tokens that take white space) and sentencepiece models encode whole texts.

Null or empty text: no bytes, no tokens. Each row is counted, also where doc_id is null or rows are repeated; repeated long
rows are encoded once. There are no ties. Columns other than doc_id and text may have any names. Empty table: no rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import partial
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents, kept, slices, table
from .tokens import default_tokenizer, encoder

SPAN, OVERLAP, WIDEN = 16384, 512, 8
#: Characters by which a pre-tokenizer of this kind looks ahead: a contraction of three.
AHEAD = 3
LIMIT = 1024

_COUNTED = "doc_id long, n_bytes long, n_tokens long"
_SIDES = "doc_id long, digest binary, n_bytes long, times long, seam int, side string, places array<int>, before array<int>, tokens long"


def margin(path: str) -> int | None:
    """How far before its end an encoding can be wrong; None for a tokenizer without that proof."""
    if not path.endswith(".json"):
        return None
    spec = json.loads(Path(path).read_text(encoding="utf-8"))
    words, after = spec.get("pre_tokenizer") or {}, spec.get("post_processor") or {}
    added = spec.get("added_tokens") or []
    plain = spec.get("normalizer") is None and words.get("type") == "ByteLevel" and words.get("use_regex", True) and not words.get("add_prefix_space")
    plain = plain and spec["model"].get("type") == "BPE" and (not after or after.get("type") == "ByteLevel" and not after.get("trim_offsets", True))
    for t in added:
        s = t["content"]
        folds = any(s[k:] == s[: len(s) - k] for k in range(1, len(s)))  # a token that overlaps itself can be found elsewhere
        plain = plain and not (t["single_word"] or t["lstrip"] or t["rstrip"] or folds)
    return AHEAD + max([0, *(len(t["content"]) for t in added)]) if plain else None


def _sentencepiece(path: str):
    import sentencepiece

    return kept(("sentencepiece", path), lambda: sentencepiece.SentencePieceProcessor(model_file=path))


def _plain(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def count_batch(batch: pa.RecordBatch, path: str, proven: bool) -> Iterator[pa.RecordBatch]:
    """Counts of whole texts."""
    for part in slices(batch, "text", 6 << 20):
        texts = part.column("text")
        if path.endswith(".model"):
            n = [len(x) for x in _sentencepiece(path).encode(texts.to_pylist())]
        elif proven:
            n = np.diff(encoder(path).ids(texts)[1])
        else:
            n = [len(e.ids) for e in kept(("plain", path), lambda: _plain(path)).encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])


def boundaries(text: str, path: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Characters at which words begin, the tokens before each, and the number of all tokens."""
    e = encoder(path).tokenizer.encode(text, add_special_tokens=False)
    word = np.array([-1 if w is None else w for w in e.word_ids], np.int64)
    first = np.flatnonzero(np.r_[True, (word[1:] != word[:-1]) | (word[1:] < 0)]) if len(word) else np.empty(0, np.int64)
    start = np.fromiter((a for a, _ in e.offsets), np.int64, len(word))
    return start[first], first, len(word)


def sides_batch(batches: Iterator[pa.RecordBatch], path: str, overlap: int, unsure: int) -> Iterator[pa.RecordBatch]:
    """For each encoded span, what it says of the seam on its left and of that on its right; the last one, how many tokens it has."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            at, before, total = boundaries(r["text"], path)
            head = [r["doc_id"], r["digest"], r["n_bytes"], r["times"]]
            if r["k"] > 0:
                inside = at < r["left"] + overlap
                out.append([*head, r["k"], "right", at[inside] - r["left"], before[inside], None])
            if r["k"] + 1 < r["spans"]:
                seam = len(r["text"]) - r["right"]
                last = len(r["text"]) - (0 if r["k"] + 2 == r["spans"] and r["right"] < overlap else unsure)  # a text's end hides nothing
                inside = (at >= seam - overlap) & (at <= last)
                out.append([*head, r["k"] + 1, "left", at[inside] - seam, before[inside], None])
            else:
                out.append([*head, None, None, None, None, total])
        types = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64()]
        names = [f.split()[0] for f in _SIDES.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(types)], names=names)


def _spliced(long: DataFrame, path: str, span: int, overlap: int, unsure: int) -> DataFrame:
    """doc_id, digest, n_bytes, times and n_tokens (NULL where a seam has no common boundary) of long texts."""
    pieces = long.withColumn("pieces", F.regexp_extract_all("text", F.lit(f"(?s).{{1,{span}}}"), F.lit(0)))
    at = lambda k: F.element_at("pieces", k)
    n = F.size("pieces")
    whole = lambda k: F.struct(
        F.when(k > 1, F.right(at(F.greatest(k - 1, F.lit(1))), F.lit(overlap))).otherwise("").alias("left"), at(k).alias("own"),
        F.when(k < n, F.left(at(F.least(k + 1, n)), F.lit(overlap))).otherwise("").alias("right"),
    )
    spans = pieces.select("doc_id", "digest", "n_bytes", n.alias("spans"), F.posexplode(F.transform(F.sequence(F.lit(1), n), whole)).alias("k", "s"))
    text = F.concat("s.left", "s.own", "s.right").alias("text")
    spans = spans.select("doc_id", "digest", "n_bytes", "spans", "k", text, F.length("s.left").alias("left"), F.length("s.right").alias("right"))
    # dealt by document and span: each is encoded by itself, once for all repeated rows
    spans = spans.groupBy("doc_id", "digest", "k").agg(*(F.first(c).alias(c) for c in ("n_bytes", "spans", "text", "left", "right")), F.count(F.lit(1)).alias("times"))
    sides = spans.mapInArrow(partial(sides_batch, path=path, overlap=overlap, unsure=unsure), _SIDES)
    of = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    keys = ["doc_id", "digest", "n_bytes", "times"]
    seams = sides.groupBy(*keys, "seam").agg(*(of(s, c).alias(f"{s}_{c}") for s in ("left", "right") for c in ("places", "before")), F.max("tokens").alias("last"))
    common = F.array_min(F.array_intersect("left_places", "right_places"))
    before = lambda s: F.get(f"{s}_before", F.array_position(f"{s}_places", F.col("common")).cast("int") - 1)
    seams = seams.withColumn("common", common)
    tokens = F.when(F.col("seam").isNull(), F.col("last")).otherwise((before("left") - before("right")).cast("long"))
    return seams.select(*keys, tokens.alias("tokens")).groupBy(*keys).agg(F.when(F.count("tokens") == F.count(F.lit(1)), F.sum("tokens")).alias("n_tokens"))


def token_counts(docs: DataFrame, path: str | None = None, span: int = SPAN, overlap: int = OVERLAP, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row, as the tokenizer at path counts whole texts."""
    path = path or default_tokenizer()
    d = documents(docs).withColumn("n_bytes", F.octet_length("text").cast("long"))
    unsure = margin(path)
    is_long = F.length("text") > span if unsure is not None else F.lit(False)
    out = d.where(~is_long).mapInArrow(lambda batches: (x for b in batches for x in count_batch(b, path, unsure is not None)), _COUNTED)
    pending = d.where(is_long).withColumn("digest", F.unhex(F.sha2("text", 256)))
    while unsure is not None:
        counted = cut(_spliced(pending, path, span, overlap, unsure))
        each = counted.where("n_tokens IS NOT NULL").withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times"))))
        out = out.unionByName(each.select("doc_id", "n_bytes", "n_tokens"))
        failed = counted.where("n_tokens IS NULL").select(F.col("doc_id").alias("id"), F.col("digest").alias("key"))
        if failed.isEmpty():
            break
        span, overlap = span * WIDEN, overlap * WIDEN
        again = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("key"))
        pending = pending.join(failed, again, "left_semi")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
