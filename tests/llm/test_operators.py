"""The training-data operators against brute force, on small tables with nulls, ties, repeats and long texts."""

import random
import sys
import zlib
from functools import lru_cache
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from conftest import DATA  # noqa: E402
from gristmill.llm import near_dedup as nd  # noqa: E402
from gristmill.llm import neighbours as nb  # noqa: E402
from gristmill.llm import language_id, registry  # noqa: E402
from gristmill.llm import toxicity as tx  # noqa: E402
from gristmill.llm.exact_dedup import exact_dedup, exact_dedup_rows, stream_state  # noqa: E402
from gristmill.llm.language_id import fit as fit_languages  # noqa: E402
from gristmill.llm.language_id import identify  # noqa: E402
from gristmill.llm.language_model import cross_entropy_difference  # noqa: E402
from gristmill.llm.mixing import CAP, Mix, permuted, shard_counts, targets  # noqa: E402
from gristmill.llm.neighbours import nearest_neighbours  # noqa: E402
from gristmill.llm.packing import best_fit, pack, padded_length  # noqa: E402
from gristmill.llm.records import crc32c, masked, read_records, record_table, write_records  # noqa: E402
from gristmill.llm.repeats import remove_repeats  # noqa: E402
from gristmill.llm.tokens import default_tokenizer  # noqa: E402
from gristmill.llm.toxicity import fit as fit_toxicity  # noqa: E402
from gristmill.llm.toxicity import toxicity  # noqa: E402

R = random.Random(5)
WORDS = [f"w{k}é" if k % 7 == 0 else f"word{k}" for k in range(400)]


def prose(n):
    return " ".join(R.choice(WORDS) for _ in range(n))


BASE = prose(80)
ODD = [(900, None), (901, ""), (902, " \t\n"), (903, "a"), (904, "x" * 3000), (905, "😀 ünï  code\r\n"), (906, prose(5000)), (907, "end <|endoftext|> of a text  <|endoftext|>!")]
#: Null and empty texts, repeats with other ids, shared passages, near copies.
ROWS = [(k, prose(R.randint(1, 120))) for k in range(30)] + [(100 + k, BASE) for k in range(4)] + [(200 + k, f"{prose(10)} {BASE} {prose(10)}") for k in range(5)] + [(300 + k, BASE.replace(" ", " x ", k + 1)) for k in range(6)] + ODD


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", f"src{k % 3}" if k % 5 else None, "clash", "clash") for k, t in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n long, id string".replace("n long", "n string")).repartition(5)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def encoded():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_tokenizer())
    return {k: np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4") for k, x in ROWS}


@pytest.mark.parametrize("hot", [1 << 15, 2])  # with 2, most shared seeds are hot ones
def test_op1(docs, none, hot):
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in remove_repeats(docs, hot).collect()}
    assert got == brute.repeats(ROWS)
    assert remove_repeats(none).count() == 0


def test_op2_round_trip(spark, docs, none, tmp_path):
    manifest = write_records(docs, f"file://{tmp_path}/r")
    ids, at = encoded(), 0
    for r in record_table(spark, manifest).orderBy("doc_id").collect():
        x = ids[r["doc_id"]]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(x), zlib.crc32(x.tobytes()))
        at += len(x)
        assert next(read_records(r["path"], rows=[r["row"]])) == (r["doc_id"], x.tobytes())
    assert record_table(spark, write_records(none, f"file://{tmp_path}/none")).count() == 0


def test_checksum():
    assert crc32c([b"123456789", b"\0" * 32, b"a" * 1000])[:2].tolist() == [0xE3069283, 0x8A9136AA]
    assert masked(np.array([0], np.uint32)).tolist() == [0xA282EAD8]


def test_damaged_record(docs, tmp_path):
    path = write_records(docs, f"file://{tmp_path}/d").first()["path"].removeprefix("file://") + ".rec"
    data = bytearray(Path(path).read_bytes())
    data[40] ^= 1
    Path(path).write_bytes(data)
    with pytest.raises(ValueError):
        list(read_records("file://" + path.removesuffix(".rec")))


def sets(rows):
    out = {}
    for k, t in rows:
        w = [x for x in __import__("re").findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))]
        out[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    return out


def reachable(s):
    comp = {k: k for k in s}
    ids = sorted(s)
    for _ in ids:
        for i, a in enumerate(ids):
            for b in ids[:i]:
                n = len(s[a] & s[b])
                if n and 100 * n >= 75 * (len(s[a]) + len(s[b]) - n):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    return comp


@pytest.mark.parametrize("small", [16, 1])  # with 1, every bucket is a large one
def test_op3(spark, docs, none, monkeypatch, small):
    monkeypatch.setattr(nd, "SMALL", small)
    monkeypatch.setattr(nd, "HUBS", 1 if small == 1 else 4)
    s = sets(ROWS)
    wanted = {k: (len(s[k]), c, c == k) for k, c in reachable(s).items()}
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in nd.near_duplicates(docs).collect()} == wanted
    assert nd.near_duplicate_rows(docs).count() == sum(v[2] for v in wanted.values())
    assert nd.near_duplicates(none).count() == 0


def test_estimate(spark):
    a, b = ({R.getrandbits(60) for _ in range(300)} for _ in range(2))
    x, y = np.array(sorted(a), np.uint64), np.array(sorted(set(list(a)[:250]) | set(list(b)[:50])), np.uint64)
    marks = [nd.packed(nd.minima(nd.mix64(v), np.array([0])))[0].tolist() for v in (x, y)]
    got = spark.createDataFrame([marks], "a array<long>, b array<long>").select(nd.estimate(F.col("a"), F.col("b"))).first()[0]
    assert abs(got - 250 / 350) < 0.2


def test_op4(docs, none):
    mix = Mix(docs, block=16, strip=512, slots=64)
    got = mix.taken().toPandas()
    words = {k: len(__import__("re").findall(r"[^\x20\x09-\x0D]+", t or "")) for k, t in ROWS}
    assert dict(zip(got.doc_id, got["size"])) == words and (got.taken <= CAP * got["size"]).all()
    for target, part in got.groupby("target"):
        assert abs(part.taken.sum() - target) <= 16 * (1 + target / 100) + 16
    again = Mix(docs.repartition(2), block=16, strip=512, slots=64).taken().toPandas()
    assert dict(zip(got.doc_id, got.taken)) == dict(zip(again.doc_id, again.taken))
    out = mix.documents(docs)
    assert out.columns == docs.columns
    assert out.select(F.sum(F.regexp_count("text", F.lit(r"([^\x20\x09-\x0D]+)")))).first()[0] == got.taken.sum()
    assert Mix(none).taken().count() == 0


def clashing(spark, rows):
    """Rows with columns named as the operators name their own, and with rows repeated."""
    names = ["_id", "id", "mark", "digest", "same", "runs", "turn", "whole", "begins", "ends", "before", "_source", "_size", "text_sha256", "TEXT_SHA256_".lower(), "place", "node"]
    data = [(k, t, "en", f"s{i % 2}", *("x" for _ in names)) for i, (k, t) in enumerate(rows)]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, " + ", ".join(f"{n} string" for n in names)).repartition(3)


def test_clashing_names_null_ids_and_repeated_rows(spark):
    rows = [(1, BASE), (1, BASE), (1, BASE + " more"), (None, BASE + " less"), (None, prose(30)), (None, prose(40)), (None, None), (None, ""), (2, "a b"), (2, "a b"), (3, "A B"), (4, " ")]
    table = clashing(spark, rows)
    kept = exact_dedup_rows(table)
    texts = [r["text"] for r in kept.collect()]
    assert kept.columns == table.columns and sorted(x or "" for x in texts) == sorted({t or "" for _, t in rows})
    near = nd.near_duplicate_rows(table)
    texts = sorted(r["text"] or "" for r in near.collect())
    # one of the four near copies of BASE, one of "a b" and "A B", both other prose rows, and all three rows without words
    assert near.columns == table.columns and len(texts) == 7 and sum(t.startswith(BASE) for t in texts) == 1 and texts[:3] == ["", "", " "]
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in nd.near_duplicates(table).collect())
    assert got.count(("1", 76, "1")) == 2 and ("None", 77, "1") in got and got.count(("2", 1, "2")) == 2 and ("3", 1, "2") in got
    mix = Mix(table, block=16, strip=64, slots=16)
    out = mix.documents(table)
    assert out.columns == table.columns and out.select(F.sum(F.regexp_count("text", F.lit(r"([^\x20\x09-\x0D]+)")))).first()[0] == mix.taken().agg(F.sum("taken")).first()[0]


def test_op4_texts(docs):
    """Each row's text holds the words of the slots that it fills, block by block."""
    import re

    mix = Mix(docs, block=16, strip=512, slots=64)
    runs = {}
    for r in mix.filled().join(mix.placed.where("size > 0"), ["source_no", "strip", "begin"]).collect():
        runs.setdefault((r["doc_id"], r["turn"]), []).append((r["word_begin"], r["word_end"]))
    words = {k: re.findall(r"[^\x20\x09-\x0D]+", t or "") for k, t in ROWS}
    wanted = sorted((k, " ".join(" ".join(words[k][a:b]) for a, b in sorted(x))) for (k, _), x in runs.items())
    assert sorted((r["doc_id"], " ".join(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))) for r in mix.documents(docs).collect()) == wanted
    # the slots of each source are the first of its passes, each pass over all its blocks
    for k, (total, blocks) in enumerate(zip(mix.totals, mix.blocks)):
        got = sorted((r["turn"], r["block"]) for r in mix.slots().where(f"source_no = {k}").collect())
        assert len(got) == total == len(set(got)) and all(b in range(blocks) for _, b in got)
        assert all(sum(t == turn for t, _ in got) == min(blocks, total - turn * blocks) for turn in {t for t, _ in got})


def test_op4_draws():
    assert targets([100, 10], [1.0, 1.0]) == [80.0, 30.0]
    parts = [shard_counts([1000, 300, 0], 7, s) for s in range(7)]
    assert [sum(c[k] for _, c in parts) for k in range(3)] == [1000, 300, 0]
    assert [f[0] for f, _ in parts] == np.r_[0, np.cumsum([c[0] for _, c in parts])[:-1]].tolist()
    for n in (1, 2, 37, 1000):
        assert sorted(permuted(np.arange(n), n, 3).tolist()) == list(range(n))


def test_op5(docs, none):
    ids = encoded()
    got = pack(docs).toPandas().sort_values(["sequence_id", "offset"])
    for r in got.itertuples():
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert (r.doc_tokens, r.ids_crc32, r.ids) == (len(ids[r.doc_id]), zlib.crc32(piece.tobytes()), piece.tobytes())
    assert got.length.sum() == sum(map(len, ids.values()))
    for _, s in got.groupby("sequence_id"):
        assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= 1024
    assert pack(none).count() == 0
    assert [padded_length(n) for n in (1, 512, 513)] == [1, 512, 1024]


def test_best_fit():
    lengths = [R.randint(1, 50) for _ in range(300)]
    windows, _, n = best_fit(lengths, 50)
    rooms: list[int] = []
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):  # by looking at every window
        fits = [r for r in rooms if r >= lengths[k]]
        if fits:
            rooms[rooms.index(min(fits))] -= lengths[k]
        else:
            rooms.append(50 - lengths[k])
    assert n == len(rooms) and sorted(50 - r for r in rooms) == sorted(sum(x for x, w in zip(lengths, windows) if w == v) for v in range(n))


def test_op6(spark, none):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = fit_toxicity(d, labels)
    got = toxicity(d, model).join(labels, "doc_id").where("crc32(cast(doc_id AS string)) % 5 = 0").toPandas()
    assert ((got.score >= 0.5) == (got.toxic == 1)).mean() >= 0.9 and got.score.between(0, 1).all()
    right = [got[got.toxic == k].score for k in (0, 1)]  # a constant score would give a half
    assert np.mean([[(b > a) + (b == a) / 2 for a in right[0]] for b in right[1]]) >= 0.9
    odd = toxicity(spark.createDataFrame([(1, None), (2, ""), (None, "a" * 100_000)], "doc_id long, text string"), model).collect()
    assert all(0 <= r["score"] <= 1 for r in odd)
    assert toxicity(none, model).count() == 0 and fit_toxicity(d, labels.where("false")) is None


def test_op7(spark, none):
    v = spark.read.parquet(f"{DATA}/embeddings.parquet")
    bad = spark.createDataFrame([(-1, None), (-2, [0.0] * 64), (-3, [float("nan")] * 64), (-4, [None] * 64), (-5, [1.0])], "vec_id long, embedding array<float>").withColumn("label", F.lit(0))
    all_ = v.unionByName(bad, allowMissingColumns=True)
    got = nearest_neighbours(all_, all_.where("vec_id % 20 = 0")).toPandas()
    p = v.toPandas()
    e, hits = np.stack(p.embedding).astype(float), 0
    for q, part in got.groupby("query_id"):
        s = e @ e[p.vec_id == q][0]
        best = [int(x) for x in p.vec_id.values[np.lexsort((p.vec_id, -s))] if x != q][:20]
        hits += len(set(best) & set(part.vec_id))
        assert part["rank"].tolist() == list(range(1, 21)) and not (part.score.diff()[1:] > 0).any()
    assert hits >= 0.9 * len(got) and (got.vec_id >= 0).all()
    assert nearest_neighbours(v.where("false"), v).count() == 0


def test_op8(docs, none):
    got = {r["doc_id"]: r for r in cross_entropy_difference(docs, docs.where("doc_id BETWEEN 100 AND 103").select("doc_id")).collect()}
    assert got[100]["score"] < min(got[k]["score"] for k in range(30) if got[k]["n_tokens"] > 20)
    assert got[900]["n_tokens"] == 1 and got[100]["n_tokens"] == 81
    assert all(np.isclose(r["score"], r["loss_target"] - r["loss_background"]) for r in got.values())
    assert cross_entropy_difference(none, none).count() == 0


def test_op9(spark, docs, none, tmp_path):
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup(docs).collect()}
    for k, t in ROWS:
        group = [j for j, u in ROWS if (u or "") == (t or "")]
        assert got[k] == (max(group), len(group), k == max(group))
    twice = docs.unionByName(docs)
    assert exact_dedup_rows(twice).count() == len({t or "" for _, t in ROWS})
    assert exact_dedup(none).count() == 0
    # later arrivals meet the state of earlier ones
    rows = spark.createDataFrame([(b"k", 1, "here")], "digest binary, id long, locator string")
    stream_state(rows, str(tmp_path / "s"))
    later = stream_state(rows.withColumn("id", F.lit(7).cast("long")), str(tmp_path / "s")).first()
    assert (later["stay_id"], later["group_size"]) == (7, 2)


def test_op10(spark, none):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = fit_languages(d)
    got = identify(d, model).join(d, "doc_id").where("crc32(cast(doc_id AS string)) % 4 = 2").toPandas()
    assert (got.lang_pred == got.lang).mean() >= 0.97
    odd = identify(spark.createDataFrame([(1, None), (2, "123 !"), (3, "x" * 50_000)], "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in odd[:2]] == ["und", "und"] and odd[2]["lang_pred"] != "und"
    assert identify(none, model).count() == 0 and fit_languages(d.where("false")) is None


def test_op10_machines_learn_in_tasks(spark, monkeypatch):
    """The driver holds no texts and no features: it trains nothing itself."""
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    wanted = identify(d, fit_languages(d)).toPandas()
    monkeypatch.setattr(language_id, "train_svm", lambda *_: pytest.fail("trained by the driver"))
    model = fit_languages(d)
    assert identify(d, model).toPandas().equals(wanted)
    one = d.where("lang = 'en'")
    assert set(identify(one, fit_languages(one)).toPandas().lang_pred) <= {"en", "und"}


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, wanted = registry.QUERIES[name](spark, DATA), con.execute(registry.ORACLE_SQL[name])
    names = sorted(got.columns)
    at = [[c[0] for c in wanted.description].index(n) for n in names]
    plain = lambda rows: sorted(map(str, rows))
    assert plain(tuple(r) for r in got.select(*names).collect()) == plain(tuple(r[k] for k in at) for r in wanted.fetchall())


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline

    docs.write.parquet(f"{tmp_path}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, kept, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns, name
        path = f"{tmp_path}/{name}"
        out.write.parquet(path)
        kept = spark.read.parquet(path)
    assert kept.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0
    ids = {r["doc_id"] for r in spark.read.parquet(f"{tmp_path}/near_dedup").collect()}
    assert 900 not in ids and 902 not in ids and len(ids & {100, 101, 102, 103}) <= 1 and set(range(30)) - ids <= {k for k, t in ROWS if len(t or "") < 12}


def test_pipeline_rows(spark, docs, tmp_path):
    """The pipeline's pieces are those that brute force gives: filters by hand, texts from the mix's slots, cuts and the number
    of sequences by looking at every window."""
    import re

    import corpus_pipeline

    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    last = {t: k for k, t in sorted(ROWS) if any(c.isalpha() for c in t or "")}  # of equal texts the largest doc_id
    unique = [(k, t) for t, k in last.items()]
    near = [(k, t) for k, t in unique if reachable(sets(unique))[k] == k]
    mix = Mix(docs.where(F.col("doc_id").isin([k for k, _ in near])))
    words = {k: re.findall(r"[^\x20\x09-\x0D]+", t) for k, t in near}
    assert {r["doc_id"]: r["size"] for r in mix.taken().collect()} == {k: len(w) for k, w in words.items()}
    # a row for each turn of a document, with the words of its slots
    rows = mix.documents(docs.where(F.col("doc_id").isin([*words]))).collect()
    runs = {}
    for r in mix.filled().join(mix.placed.where("size > 0"), ["source_no", "strip", "begin"]).collect():
        runs.setdefault((r["doc_id"], r["turn"]), []).append((r["word_begin"], r["word_end"]))
    assert sorted((r["doc_id"], " ".join(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))) for r in rows) == sorted((k, " ".join(w for a, b in sorted(x) for w in words[k][a:b])) for (k, _), x in runs.items())
    from tokenizers import Tokenizer

    t, pieces = Tokenizer.from_file(default_tokenizer()), []
    for r in rows:
        ids = np.array([*t.encode(r["text"], add_special_tokens=False).ids, 0], "<u4")
        pieces += [(r["doc_id"], a, len(ids[a : a + 1024]), zlib.crc32(ids[a : a + 1024].tobytes()), len(ids)) for a in range(0, len(ids), 1024)]
    assert sorted(zip(got.doc_id, got.start, got.length, got.ids_crc32, got.doc_tokens)) == sorted(pieces) and len(pieces) > len(near) > 30
    for _, part in got.groupby(got.sequence_id // 2**40):
        rooms: list[int] = []
        for n in sorted(part.length, reverse=True):
            fits = [r for r in rooms if r >= n]
            if fits:
                rooms[rooms.index(min(fits))] -= n
            else:
                rooms.append(1024 - n)
        assert sorted(1024 - r for r in rooms) == sorted(part.groupby("sequence_id").length.sum())
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1]]


def test_pipeline_of_odd_tables(spark, none, tmp_path):
    import corpus_pipeline

    none.write.parquet(f"{tmp_path}/empty/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
    rows = [(None, BASE), (None, None), (1, None), (2, ""), (3, " "), (4, prose(30)), (4, prose(30)), (5, "12 34")]
    clashing(spark, rows).write.parquet(f"{tmp_path}/odd/documents.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    assert {r["doc_id"] for r in got} <= {None, 4} and 4 in {r["doc_id"] for r in got}


def test_op8_losses(spark, docs):
    """All words count, also those beyond the 2000 most frequent ones."""
    rows = [*ROWS, (None, "no id"), *((1000 + k, " ".join(f"Rare{k}x{j} the" for j in range(50))) for k in range(60))]
    good = {100, 205, 900, 1003, 1004}
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in cross_entropy_difference(table, spark.createDataFrame([(k,) for k in good] * 2, "doc_id long")).collect()}
    for wanted in brute.losses(rows, good):
        r = got[wanted[0]]
        assert r["n_tokens"] == wanted[1] and np.allclose([r["loss_target"], r["loss_background"], r["score"]], wanted[2:], atol=1e-9)
    assert len(got) == len(rows)


@pytest.mark.parametrize("spread", [0, 0.25, 0.5, "few long"])
def test_op7_recall(spread):
    """Of one shard, far larger than LEAST, so that the index decides; vectors of equal and of varied lengths."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    n = nb.SHARD
    v = rng.normal(size=(n, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v *= np.where(np.arange(n) % 5000 == 7, 100, 1)[:, None] if spread == "few long" else np.exp(spread * rng.normal(size=(n, 1)))
    rows = lambda k: pa.table({"vec_id": k, "vector": pa.array(list(v[k]), pa.list_(pa.float64()))})
    asked = np.arange(500, 540)
    assert nb.LEAST < nb.SHARE * n
    got = nb.search(rows(np.arange(n)), rows(asked), v[: nb.PIVOTS].copy(), 20).to_pandas()
    hits = 0
    for q, part in got.groupby("query_id"):
        s = v @ v[q]
        s[q] = -np.inf
        hits += len(set(np.argsort(-s)[:20]) & set(part.vec_id))
    print(spread, hits / (20 * len(asked)))
    assert hits >= 0.9 * 20 * len(asked)


def test_op6_groups_texts_for_whole_rows():
    """Texts of unlike languages, mixed, are multiplied with the whole rows of their own terms only."""
    rng = np.random.default_rng(3)
    row, number = np.repeat(np.arange(400), 20), (rng.random((400, 40)).argsort(axis=1)[:, :20] + 40 * (np.arange(400) % 2)[:, None]).ravel()
    index = tx.InvertedIndex(row, number.astype(np.int32), np.full(len(row), 20**-0.5), np.arange(400), 80)
    assert len(index.dense) == 80 and not len(index.row)
    used, whole = [], index._some
    index._some = lambda r, k, w, n, *rest: (used.append(len(np.unique(k))), whole(r, k, w, n, *rest))[1]
    text, example, cosine = index.nearest(row, number, index.own_weight, 400, 5, np.arange(400))
    assert max(used) == 40
    all_ = np.zeros((400, 80))
    all_[row, number] = 20**-0.5
    all_ = all_ @ all_.T
    np.fill_diagonal(all_, 0)
    for t in range(400):
        wanted = np.lexsort((np.arange(400), -np.round(all_[t], 12)))[:5]
        assert example[text == t].tolist() == wanted.tolist() and np.allclose(cosine[text == t], all_[t][wanted])


def test_op6_whole_rows_by_language():
    """Terms that are frequent in a language which few examples have are whole rows there, and take no room elsewhere."""
    rng = np.random.default_rng(5)
    n, few = 1000, np.arange(1000) % 10 == 3
    row, number = np.repeat(np.arange(n), 20), (rng.random((n, 40)).argsort(axis=1)[:, :20] + 40 * few[:, None]).ravel()
    weight = rng.random(len(row)) + 0.5
    weight /= np.sqrt(np.bincount(row, weights=weight**2))[row]
    index = tx.InvertedIndex(row, number.astype(np.int32), weight, np.arange(n)[::-1].copy(), 80)
    assert not len(index.row) and sum(x.size for x in index.whole) == 40 * n
    text, example, cosine = index.nearest(row, number, weight, n, 5, np.arange(n))
    all_ = np.zeros((n, 80))
    all_[row, number] = weight
    all_ = all_ @ all_.T
    np.fill_diagonal(all_, 0)
    for t in range(n):
        wanted = np.lexsort((index.ids, -np.round(all_[t], 12)))[:5]
        assert example[text == t].tolist() == wanted.tolist() and np.allclose(cosine[text == t], all_[t][wanted])


def test_op6_neighbours(spark, monkeypatch):
    """Exact cosines over all terms of the examples; toxic words need not be frequent for a text to have neighbours."""
    monkeypatch.setattr(tx, "BLOCK", 4)
    monkeypatch.setattr(tx, "FIRST", 2)
    rows = [(k, f"{t} Ünique{k}" if t else t) for k, t in ROWS]
    labels = [(k, int(k % 3 == 0)) for k, t in rows if k % 2 == 0]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in toxicity(table, fit_toxicity(table, spark.createDataFrame(labels, "doc_id long, toxic int"))).collect()}
    texts = dict(rows)
    examples = {k: texts[k] for k, _ in labels if zlib.crc32(str(k).encode()) % 5 and texts[k] and texts[k].strip()}
    features = lru_cache(maxsize=None)(lambda w: tx.terms(pa.array([w], pa.binary()))[0].tolist())
    for k, wanted in brute.nearest_examples(rows, examples, features).items():
        assert np.allclose(got[k]["cosines"], [x for _, x in wanted], atol=1e-9) and len(got[k]["nearest"]) == len(wanted)
    assert got[1]["nearest"]
    # a word of an example among many that no example has is far from it, also where all of them are new
    word, own = "lonelyterm", next(k for k in range(950, 960) if zlib.crc32(str(k).encode()) % 5)
    table = table.unionByName(spark.createDataFrame([(own, word)], table.schema))
    odd = [(1, word), (2, " ".join([word, *(f"neu{chr(97 + k)}x" for k in range(20))]))]
    near = toxicity(spark.createDataFrame(odd, "doc_id long, text string"), fit_toxicity(table, spark.createDataFrame([*labels, (own, 1)], "doc_id long, toxic int"))).orderBy("doc_id").collect()
    assert near[0]["cosines"][0] > 0.99 and max(near[1]["cosines"]) < 0.5
