"""The sorting of op1: its files, and collections of fragments by seed."""

import random
import sys

import numpy as np
from gristmill.llm import repeats as rp

R = random.Random(3)
OPENED: list[str] = []
WATCHED: list[str] = []
# a hook cannot be taken away again, but only looks while a folder is watched
sys.addaudithook(lambda event, args: OPENED.append(args[0]) if event == "open" and WATCHED and str(args[0]).startswith(WATCHED[0]) else None)


def collection(n):
    """Rows of two letters, so that many strings are equal, and their lengths."""
    base = [R.choice([1, 2]) for _ in range(120)]
    lengths = np.array([R.randint(rp.LENGTH, rp.WIDTH) for _ in range(n)])
    contents = np.zeros((n, rp.WIDTH), np.uint8)
    for r, k in enumerate(lengths):
        at = R.randint(0, 120 - k)
        contents[r, :k] = base[at : at + k]
    return contents, lengths


def test_files_are_not_written_anew(tmp_path):
    """Each round writes over the two files; a file truncated in each of 99 rounds can go to the disk as often."""
    contents, lengths = collection(40)
    WATCHED.append(str(tmp_path))
    rp.sort_collection(contents, lengths, str(tmp_path))
    WATCHED.clear()
    assert len(OPENED) == 2


def test_smallest_by_string():
    contents, lengths = collection(60)
    doc = np.array([R.randint(0, 999) for _ in range(60)])
    strings = {}
    for r, k in enumerate(lengths):
        for at in range(k - rp.LENGTH + 1):
            x = contents[r, at : at + rp.LENGTH].tobytes()
            strings[x] = min(strings.get(x, rp._LAST), doc[r])
    got = rp.smallest_by_string(contents, lengths, doc)
    for r, k in enumerate(lengths):
        assert got[r, : k - rp.LENGTH + 1].tolist() == [strings[contents[r, at : at + rp.LENGTH].tobytes()] for at in range(k - rp.LENGTH + 1)]
        assert (got[r, k - rp.LENGTH + 1 :] == rp._LAST).all()


def test_collections(monkeypatch):
    """Each fragment once, those of a seed together, and no collection larger than its limit and one seed."""
    monkeypatch.setattr(rp, "COLLECTION", 8)
    seed = np.array([R.choice([5, 5, 5, *range(60)]) for _ in range(300)], np.uint64)
    which = np.flatnonzero(seed % np.uint64(3) > 0)
    parts = rp.collections(seed, which)
    assert sorted(np.concatenate(parts)) == which.tolist()
    owners = [set(seed[p].tolist()) for p in parts]
    assert sum(map(len, owners)) == len(set().union(*owners))
    most = np.bincount(seed[which].astype(int)).max()
    assert max(map(len, parts)) < 8 + most and len(parts) > 10
    assert rp.collections(seed, which[:0]) == []
