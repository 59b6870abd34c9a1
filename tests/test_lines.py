"""Lines with their places, journals of lines, and equal lines as runs of their own."""

import json

import pytest
from gristmill.sources.envelopes import read_envelopes
from gristmill.sources.journal import OtherIdentity, read_lines
from gristmill.sources.lines import read_placed


def line(case, repetition=1, suite="s", n=1, **more):
    return json.dumps({"kind": "attempt", "identity": {"suite": suite, "n": n}, "case_id": case, "repetition": repetition, "input": 1, "seconds": 0.5, "result": {"r": n}} | more)


def test_places(spark, tmp_path):
    texts = {"a.txt": "é\n\nlast of many\nx\r\nend", "b.txt": "".join(f"line {k} {'y' * (k % 50)}\n" for k in range(3000)), "c.txt": ""}
    for name, t in texts.items():
        (tmp_path / name).write_bytes(t.encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        got = sorted((r["file"].rsplit("/", 1)[1], r["place"], r["value"], r["last"]) for r in read_placed(spark, str(tmp_path)).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = []
    for name, t in texts.items():
        at, parts = 0, t.removesuffix("\n").split("\n") if t else []
        for k, p in enumerate(parts):
            want.append((name, at, p, k + 1 == len(parts)))
            at += len(p.encode()) + 1
    assert got == sorted(want)


def test_last_line_wins_and_torn_ends(spark, tmp_path):
    (tmp_path / "1").write_text(line("a", seconds=1) + "\n\n" + line("b") + "\n" + line("a", seconds=2) + "\n" + line("c", suite="other", n=7) + "\n" + line("a", seconds=9)[:-9])
    (tmp_path / "2").write_text(line("b", seconds=5) + "\n" + line("b", 2) + "\n")
    got = sorted((r["case_id"], r["repetition"], r["seconds"]) for r in read_lines(spark, str(tmp_path), "s", '{"n": 1, "suite": "s"}').collect())
    assert got == [("a", 1, 2.0), ("b", 1, 5.0), ("b", 2, 0.5)]
    with pytest.raises(OtherIdentity):
        read_lines(spark, str(tmp_path), "s", '{"n": 2, "suite": "s"}')


@pytest.mark.parametrize("bad", ["torn {", "[]", line("a", repetition=0), line("a", repetition=1.5), line("a", seconds=-1), line("a", result=[]), line("a", kind="x"), line(3)])
def test_damaged(spark, tmp_path, bad):
    (tmp_path / "1").write_text(bad + "\n" + line("b") + "\n")
    with pytest.raises(ValueError):
        read_lines(spark, str(tmp_path))


def test_equal_lines_are_runs_of_their_own(spark, tmp_path):
    (tmp_path / "e").write_text('{"payload": 1}\n' * 3)
    assert read_envelopes(spark, str(tmp_path)).select("run_id").distinct().count() == 3
