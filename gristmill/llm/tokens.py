"""Token ids of whole texts, by the tokenizers library, as little-endian unsigned 32-bit bytes."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import kept, slices

#: Pieces of text whose ids a Python worker remembers (about 200 bytes each); beyond it, it starts anew.
REMEMBERED = 800_000
#: The id that ends each document.
END = 0
#: A word and the punctuation after it: the pre-tokenizer cuts between them (but an apostrophe may open a contraction).
_WORD_AND_MARKS = re.compile(r"([^\W\d_]+)([!-&(-/:-@\[-`{-~]+)")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of texts; equal to encoding each whole text at once.

    The byte-level pre-tokenizer always cuts before a single space that a character other than white space
    follows, and no merge crosses that cut, so what lies between such spaces is encoded once and remembered.
    A text with other runs of white space after a space is encoded whole, and so is one that holds an added token.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = sorted({t.content for t in self.tokenizer.get_added_tokens_decoder().values()})
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.spaced = np.zeros(max(vocabulary.values()) + 1, bool)
        self.spaced[[i for token, i in vocabulary.items() if token[0] == "Ġ"]] = True
        self.known: dict[str, int] = {}
        self.pool, self.ends = np.empty(0, "<u4"), np.zeros(1, np.int64)

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, each behind one space: encoded as one text, which is cut where a token opens with the space."""
        if not pieces:
            return np.empty(0, "<u4"), np.zeros(1, np.int64)
        text = " " + " ".join(pieces)
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
        starts = np.flatnonzero(self.spaced[ids])
        assert len(starts) == len(pieces)
        return ids, np.r_[starts, len(ids)]

    def _remember(self, pieces: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        self.known.update(zip(pieces, range(len(self.ends) - 1, len(self.ends) - 1 + len(pieces)), strict=True))
        self.pool, self.ends = np.concatenate([self.pool, ids]), np.r_[self.ends, self.ends[-1] + ends[1:]]

    def _learn(self, new: list[str]) -> None:
        """Remembers the ids of pieces; a word is encoded once for all punctuation that follows it."""
        split = [m.groups() if (m := _WORD_AND_MARKS.fullmatch(p)) else (p, "") for p in new]
        unknown = [w for w in dict.fromkeys(w for w, _ in split) if w not in self.known]
        self._remember(unknown, *self._pieces(unknown))
        marked = [k for k, (_, mark) in enumerate(split) if mark]
        if not marked:
            return
        at = np.array([self.known[split[k][0]] for k in marked])
        marks = pa.array([split[k][1] for k in marked], pa.string()).dictionary_encode()
        tails = [self._whole(m) for m in marks.dictionary.to_pylist()]
        which = marks.indices.to_numpy()
        pool = np.concatenate([self.pool, *tails])
        tail_ends = len(self.pool) + np.r_[0, np.cumsum([len(t) for t in tails])]
        starts = np.column_stack([self.ends[:-1][at], tail_ends[:-1][which]]).ravel()
        lengths = np.column_stack([np.diff(self.ends)[at], np.diff(tail_ends)[which]]).ravel()
        ids, ends = _gather(pool, starts, lengths)
        self._remember([new[k] for k in marked], ids, ends[::2])

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one text after the other, and the offsets of the texts."""
        given = pc.fill_null(texts.cast(pa.string()), "")
        added = np.zeros(len(given), bool)
        for token in self.added:
            added |= pc.match_substring(given, token).to_numpy(zero_copy_only=False)
        lists = pc.split_pattern(pc.if_else(pa.array(~added), given, ""), " ")
        bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        parts = lists.flatten().dictionary_encode()
        piece, pieces = parts.indices.to_numpy(), parts.dictionary
        names, get = pieces.to_pylist(), self.known.get
        at = np.array([get(p, -1) for p in names], np.int64)
        missing = np.flatnonzero(at < 0).tolist()
        odd = [k for k in missing if not (p := names[k]) or p[0].isspace()]
        if len(self.known) + 2 * len(missing) > REMEMBERED:
            self.known, self.pool, self.ends = {}, np.empty(0, "<u4"), np.zeros(1, np.int64)
            missing, get = range(len(names)), self.known.get
        skip = set(odd)
        self._learn([names[k] for k in missing if k not in skip])
        for k in missing:
            at[k] = get(names[k], -1) if k not in skip else len(self.ends) - 1
        is_odd = np.zeros(len(names), bool)
        is_odd[odd] = True
        pool, ends = self.pool, np.r_[self.ends, self.ends[-1]]
        first = bounds[:-1]
        heads = [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(pc.list_element(lists, 0).to_pylist(), add_special_tokens=False)]
        odd_part = is_odd[piece]
        odd_part[first] = False
        for text in np.unique(np.searchsorted(bounds, np.flatnonzero(odd_part), side="right") - 1):
            heads[text] = self._whole(texts[int(text)].as_py())
            at_text = slice(bounds[text], bounds[text + 1])
            odd_part[at_text] = True
        for text in np.flatnonzero(added).tolist():
            heads[text] = self._whole(given[text].as_py())
        starts, lengths = ends[:-1][at][piece], np.diff(ends)[at][piece]
        lengths[odd_part] = 0
        starts[first] = len(pool) + np.r_[0, np.cumsum([len(h) for h in heads])][:-1]
        lengths[first] = [len(h) for h in heads]
        pool = np.concatenate([pool, *heads])
        out, after = _gather(pool, starts, lengths)
        return out, after[bounds]


def _gather(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of the pool, one after the other, and the offsets of the runs."""
    after = np.cumsum(lengths, dtype=np.int64)
    total = int(after[-1]) if len(after) else 0
    return pool[np.repeat(starts - (after - lengths), lengths) + np.arange(total)], np.r_[0, after]


def encoder(path: str) -> Encoder:
    """One for each Python worker, which Spark uses for many tasks."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return kept(("encoder", path), lambda: Encoder(path))


def ids_of(batch: pa.RecordBatch, path: str, size: int = 6 << 20) -> Iterator[tuple[int | None, bytes]]:
    """(doc_id, ids with the end id as bytes) of each row of a batch, a bounded part at a time."""
    end = END.to_bytes(4, "little")
    for part in slices(batch, "text", size):
        ids, bounds = encoder(path).ids(part.column("text"))
        for row, doc_id in enumerate(part.column("doc_id").to_pylist()):
            yield doc_id, ids[bounds[row] : bounds[row + 1]].tobytes() + end


def crc32(ids: bytes) -> int:
    return zlib.crc32(ids)
