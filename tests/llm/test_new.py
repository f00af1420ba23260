"""Manifest, MinHash and hard negatives against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import hardneg, manifest, minhash, queries

WORDS = [f"{a}{b}" for a in "bcdfgklmnprst" for b in ("an", "el", "or", "ist", "um", "eth")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def twin(name, table, df):
    """The rows of a query's SQL over ``df`` in place of ``table``."""
    db = duckdb.connect()
    db.register(table, df.toArrow())
    got = db.execute(queries.ORACLE[name])
    names = [c[0] for c in got.description]
    return names, sorted(map(repr, got.fetchall()))


def same(df, name, table, source):
    names, want = twin(name, table, source)
    return sorted(map(repr, map(tuple, df.select(*names).collect()))) == want


# --- manifest

def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree_by_hand(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i:i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def path_by_hand(levels, at):
    out = []
    for nodes in levels[:-1]:
        if (at ^ 1) < len(nodes):
            out.append(nodes[at ^ 1])
        at >>= 1
    return out


def by_hand(docs):
    """(doc_id, leaf, subroot, root, siblings) of (doc_id, source, lang, n_chars, text) rows."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = {i: H(*map(field, d)) for i, d in enumerate(docs)}
    groups = {}
    for i, d in enumerate(docs):
        groups.setdefault(d[2], []).append(i)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: sorted(groups[g], key=lambda i: (docs[i][0] is not None, docs[i][0] or 0, leaf[i])) for g in names}
    low = {g: tree_by_hand([leaf[i] for i in trees[g]]) for g in names}
    high = tree_by_hand([low[g][-1][0] for g in names])
    return sorted(repr((docs[i][0], leaf[i], low[g][-1][0], high[-1][0], path_by_hand(low[g], at) + path_by_hand(high, k)))
                  for k, g in enumerate(names) for at, i in enumerate(trees[g]))


def dataset(seed, n):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice(["en", "de", None, "É", "z"]), rng.choice([None, i * 7]), rng.choice([None, "", "tëxt", "x" * 3000])) for i in range(n)]
    return rows + [(None, "a", "en", 1, "no id")] * 3 + [(5, "a", "en", 1, "twice")] * 2 + [(2 ** 40, "a", "only", 1, "alone")]


def leaves_of(df):
    hash_ = manifest.leaf([F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")])
    return df.select("lang", "doc_id", hash_.alias("hash"), F.col("doc_id").alias("row"))


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("span", [1, 2, 12])
def test_manifest_by_hand(spark, monkeypatch, span):
    monkeypatch.setattr(manifest, "SPAN", span)
    docs = dataset(1, 150)
    made = manifest.build(leaves_of(spark.createDataFrame(docs, SCHEMA)), "lang", ["doc_id"], "row")
    got = manifest.prove(made).withColumn("s", manifest.siblings(F.col("path")))
    assert sorted(repr((r["row"], r["hash"], r["subroot"], r["root"], r["s"])) for r in got.collect()) == by_hand(docs)
    assert got.where(manifest.folded(F.col("hash"), F.col("path")) != F.col("root")).count() == 0
    assert got.where(manifest.folded(F.sha2("hash", 256), F.col("path")) == F.col("root")).count() == 0


def test_proofs_of_some_leaves_from_a_stored_manifest(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(manifest, "SPAN", 4)
    made = manifest.build(leaves_of(spark.createDataFrame(dataset(2, 300), SCHEMA)), "lang", ["doc_id"], "row")
    made.write(str(tmp_path))
    stored = manifest.read(spark, str(tmp_path))
    every = {r["hash"]: r["path"] for r in manifest.prove(made).collect()}
    some = manifest.prove(stored, stored.leaves.where("row % 13 = 4")).collect()
    assert some and all(every[r["hash"]] == r["path"] for r in some)


def test_least_union_of_missing_nodes():
    rng = random.Random(5)
    for _ in range(200):
        n = rng.randint(1, 70)
        places = np.array(sorted(rng.sample(range(n), rng.randint(1, n))))
        levels = tree_by_hand([H(str(i)) for i in range(n)])
        wanted = manifest.missing(places, n)
        assert len(wanted) == manifest.height(n) == len(levels) - 1
        # A node is asked for exactly if it is a sibling on a path and holds none of the leaves.
        for d, nodes in enumerate(levels[:-1]):
            on_path = {int(p) >> d for p in places}
            assert set(wanted[d].tolist()) == {x ^ 1 for x in on_path if (x ^ 1) < len(nodes)} - on_path
        got = [(w, np.array([levels[d][i] for i in w], object)) for d, w in enumerate(wanted)]
        found, root = manifest.expand(places, np.array([levels[0][i] for i in places], object), n, got)
        assert root == levels[-1][0]
        paths = manifest._paths(places, found).to_pylist()
        assert [[s["left"] or s["right"] for s in p if s["left"] or s["right"]] for p in paths] == [path_by_hand(levels, int(at)) for at in places]


def test_manifest_query_on_edges(spark, tmp_path):
    rows = dataset(3, 120)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", hash string, place int")
    for name, part in (("all", df), ("one", df.limit(1)), ("none", df.limit(0))):
        part.write.parquet(str(tmp_path / name / "documents.parquet"))
        source = spark.read.parquet(str(tmp_path / name / "documents.parquet"))
        got = queries.op11_manifest(spark, str(tmp_path / name))
        assert same(got, "op11_manifest", "documents", source.drop("hash", "place"))
    changed = {r["doc_id"] for r in queries.op11_manifest(spark, str(tmp_path / "all")).where("NOT verified").collect()}
    assert changed == {r[0] for r in rows if r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0}


# --- MinHash

def set_by_hand(text):
    w = re.findall(r"[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i:i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()


def near_by_hand(docs):
    sets = [set_by_hand(t) for _, t in docs]
    label = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = label[i], label[j]
                if a != b:
                    label = [b if x == a else x for x in label]
    least = {}
    for (d, _), x in zip(docs, label):
        least[x] = min((v for v in (least.get(x), d) if v is not None), default=None)
    out = []
    for (d, _), x, s in zip(docs, label, sets):
        c = least[x] if s else d
        out.append(repr((d, len(s), c, d is not None and d == c)))
    return sorted(out)


def near_copies(rng, text, n, most):
    out = []
    for _ in range(n):
        w = text.split()
        for _ in range(rng.randint(0, most)):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        out.append(" ".join(w))
    return out


EDGES = [None, "", " \n", "One", "one", "two words here", "A b C d", "a B c d", "a b c d e", "a b c d e f", "\U0001f600 ß é \x00 x", "x\x0by\x0cz w\rv"]


@pytest.mark.parametrize("held", [2048, 3])
def test_near_duplicates_by_hand(spark, monkeypatch, held):
    """Families whose members are alike by 0.5 to 1, so that many links are close to the bound, and chains of links are long."""
    monkeypatch.setattr(minhash, "HELD", held)
    rng = random.Random(7)
    texts = [t for _ in range(6) for t in near_copies(rng, prose(rng, rng.choice([12, 60, 200])), 40, 9)] + [prose(rng, 50) for _ in range(60)] + EDGES + [prose(random.Random(1), 30_000)] * 2
    docs = [(rng.choice([i, i, i, i, 7, None]), t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, sid string, n int")
    got = minhash.near_duplicates(df)
    assert sorted(repr((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"])) for r in got.collect()) == near_by_hand(docs)
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_signature_agreement_estimates_likeness():
    rng = np.random.Generator(np.random.PCG64(3))
    shared = rng.integers(0, 1 << 63, 800, np.uint64)
    agree = []
    for _ in range(60):
        a, b = (np.unique(np.concatenate([shared, rng.integers(0, 1 << 63, 100, np.uint64)])) for _ in range(2))
        agree.append((minhash.signature(a) == minhash.signature(b)).mean())
        shared = rng.integers(0, 1 << 63, 800, np.uint64)
    assert abs(np.mean(agree) - 0.8) < 0.02 and min(agree) * 160 > minhash.LEAST_AGREE


# --- hard negatives

def test_hard_negatives_twin_on_edges(spark, tmp_path):
    rng = np.random.Generator(np.random.PCG64(4))
    rows = [(i, rng.normal(0.02, 0.1, 16).tolist(), int(rng.integers(0, 4))) for i in range(700)]
    rows += [(i, [0.25] * 16, i % 4) for i in range(700, 1100)]  # many ties
    rows += [(1101, None, 1), (1102, [0.1] * 15 + [None], 1), (1103, [0.1] * 15 + [float("nan")], 1), (1200, [0.1] * 15 + [float("inf")], 1), (1300, [0.1] * 16, None),
             (None, [0.1] * 16, 1), (1400, [], 1), (1401, [], 1), (1402, [], 2), (1500, [0.5, 0.5], 1), (1501, [0.5, 0.4], 1), (1502, [0.3, 0.4], 2),
             (1600, [0.2] * 16, 3), (1600, [0.2] * 16, 3), (1600, [0.3] * 16, 2), (1601, [0.0] * 16, 3), (1700, [0.0] * 16, 3)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, anchor string, block int")
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    got = queries.op13_hard_negatives(spark, str(tmp_path))
    assert got.count() > 100
    assert same(got, "op13_hard_negatives", "embeddings", df.select("vec_id", "embedding", "label"))
    df.limit(0).write.parquet(str(tmp_path / "none" / "embeddings.parquet"))
    assert queries.op13_hard_negatives(spark, str(tmp_path / "none")).count() == 0


def test_hard_negatives_in_small_blocks(spark, monkeypatch):
    rng = np.random.Generator(np.random.PCG64(6))
    df = spark.createDataFrame([(i, rng.normal(0.1, 0.1, 8).tolist(), int(rng.integers(0, 3))) for i in range(400)], "vec_id long, embedding array<double>, label int")
    mine = lambda: sorted(map(repr, hardneg.mine(df, F.col("id") % 10 == 0, positives=3, negatives=4).collect()))
    whole = mine()
    monkeypatch.setattr(hardneg, "ANCHOR_ROWS", 7)
    monkeypatch.setattr(hardneg, "BLOCK_ROWS", 23)
    assert mine() == whole and len(whole) > 200


def test_scores_beyond_doubles_stay_whole_numbers(spark):
    big = float(2 ** 50)
    rows = [(0, [big, 1.0], 1), (1, [big, 1.0], 1), (2, [big / 2, 3.0], 0), (3, [big / 2, 2.0], 0), (4, [1e300, 1.0], 0), (5, [1e15, 1.0], 0)]
    got = hardneg.mine(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), F.col("id") == 0).collect()
    assert [(r["negative_id"], r["positive_score"]) for r in got] == []
    small = [(i, [v * 2.0 ** 20, w], k) for i, v, w, k in [(0, 1, 1.0, 1), (1, 1, 2.0, 1), (2, 0.5, 3.0, 0), (3, 0.5, 2.0, 0)]]
    got = hardneg.mine(spark.createDataFrame(small, "vec_id long, embedding array<double>, label int"), F.col("id") == 0).collect()
    score = lambda a, b: sum(int(256 * x) * int(256 * y) for x, y in zip(a[1], b[1]))
    assert [(r["rank"], r["negative_id"], r["negative_score"]) for r in got] == [(1, 2, score(small[0], small[2])), (2, 3, score(small[0], small[3]))]
    assert 256 * 2 ** 20 * 256 * 2 ** 20 > hardneg.EXACT


def test_windows_hold_no_rows():
    keys = iter([((1, 0, -100, 0, 5), None), ((1, 0, -90, 1, 6), None), ((1, 0, -90, 1, 7), None), ((1, 0, -50, 0, 8), None), ((1, 0, -40, 1, 9), None), ((1, 0, -14, 1, 10), None), ((2, 0, -9, 1, 3), None)])
    assert list(hardneg.windows(keys, 5, 2, 30, 90)) == [(1, 5, 1, 6, 100, 90), (1, 5, 2, 7, 100, 90), (1, 8, 1, 9, 50, 40)]
