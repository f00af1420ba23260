"""The training-data operators against brute force, exact round trips and held-out labels."""

from __future__ import annotations

import hashlib
import itertools
import os
import random
import re
import subprocess
import sys
import time
import zlib

import duckdb
import numpy as np
import pyspark
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tessella.llm import bpe, chats, decontaminate, langid, maintext, queries, secrets, simhash, syncmers, toxicity, urls
from tessella.llm.common import table
from tessella.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, fp string, spans string, ids string, blob string, range string, id string"
WORDS = [f"{a}{b}" for a in "bcdfgklmnprst" for b in ("an", "el", "or", "ist", "um", "eth")]


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


def documents(spark, rows):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0.5, "x", "x", "x", "x", "x", "x") for i, t in rows], SCHEMA)


EDGES = [(None, "no id here at all"), (1, None), (2, ""), (3, " \n\t "), (4, prose(4, 60)), (4, prose(4, 60)), (5, prose(4, 60)),
         (6, prose(6, 40_000)), (7, "\U0001f600 ß é é <|endoftext|> \x00"), (8, "one"), (None, None), (9, prose(4, 59) + " other")]


def rows(df, *columns):
    return sorted(map(repr, (tuple(r[c] for c in columns) for r in df.collect())))


# --- near duplicates

def fingerprint_by_hand(text: str) -> int:
    import xxhash

    w = re.findall(r"[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    runs = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups_by_hand(codes):
    label = {c: c for c in codes}

    def find(x):
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    for a, b in itertools.combinations(sorted(codes), 2):
        if bin(a ^ b).count("1") <= 3:
            label[find(b)] = find(a)
    return {c: find(c) for c in codes}


def test_fingerprints_by_hand():
    for text in [t or "" for _, t in EDGES] + ["ÀB c", "a b", "a b c", "A b C D"]:
        assert simhash.fingerprint(text) % (1 << 64) == fingerprint_by_hand(text)


def test_near_duplicates_by_hand(spark):
    got = simhash.near_duplicates(documents(spark, EDGES)).collect()
    assert len(got) == len(EDGES)
    by_hand = groups_by_hand({fingerprint_by_hand(t or "") for _, t in EDGES})
    least = {}
    for i, t in EDGES:
        root = by_hand[fingerprint_by_hand(t or "")]
        least[root] = min(x for x in (least.get(root), i) if x is not None) if (i is not None or least.get(root) is not None) else None
    expected = sorted(map(repr, ((i, f"{fingerprint_by_hand(t or ''):016x}", least[by_hand[fingerprint_by_hand(t or "")]]) for i, t in EDGES)))
    assert sorted(map(repr, map(tuple, got))) == expected
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


@pytest.mark.parametrize("node_rows", [4096, 8])
def test_links_find_every_group(spark, node_rows):
    """Random codes with balls around some of them, with and without refined nodes."""
    rng = random.Random(3)
    codes = {rng.getrandbits(64) for _ in range(200)}
    for c in list(codes)[:30]:
        for _ in range(20):
            codes.add(c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 6))))
    df = spark.createDataFrame([(c - (1 << 64) if c >> 63 else c,) for c in codes], "fp long")
    got = {r["fp"] % (1 << 64): r["group"] % (1 << 64) for r in components(simhash.links(df, node_rows=node_rows)).collect()}
    expected = groups_by_hand(codes)
    same = {}
    for c, root in expected.items():
        same.setdefault(root, set()).add(got.get(c, c))
    assert all(len(g) == 1 for g in same.values())
    assert len({next(iter(g)) for g in same.values()}) == len(same)


def test_one_node_by_brute_force():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    codes = np.unique(np.concatenate([base, *[b ^ (np.uint64(1) << rng.integers(0, 64, 30, dtype=np.uint64)) for b in base]]))
    codes = codes[np.argsort(simhash.gray_rank(codes))]
    label = simhash.linked(codes)
    expected = groups_by_hand(set(map(int, codes)))
    pairs = {}
    for c, k in zip(map(int, codes), label.tolist(), strict=True):
        pairs.setdefault(expected[c], set()).add(k)
    assert all(len(x) == 1 for x in pairs.values()) and len(pairs) == len(set(label.tolist()))


def test_keep_one(spark):
    docs = documents(spark, EDGES)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [1, 4, 6, 7, 8]
    assert simhash.keep_one(documents(spark, [(None, "a b c"), (None, "a b c")])).count() == 1


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(100, 180)]
    star = [(0, i) for i in range(1, 60)]
    got = {r["fp"]: r["group"] for r in components(spark.createDataFrame(path + star, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 181)} | {i: 0 for i in range(60)}


# --- byte-pair encoding

@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.vocabulary_path())


@pytest.fixture(scope="module")
def coder():
    return bpe.TextCoder(bpe.read_vocabulary(queries.vocabulary_path()))


def same_as_library(coder, tokenizer, text):
    ids = tokenizer.encode(text, add_special_tokens=False).ids
    assert coder.ids(text) == ids
    assert coder.decode(ids) == tokenizer.decode(ids, skip_special_tokens=False)
    assert coder.digest(text)[2] == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_encoding_of_any_text(coder, tokenizer, text):
    same_as_library(coder, tokenizer, text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aeilnorstthé!?.-'1½ <|endoftext>", max_size=80))
def test_encoding_of_common_letters(coder, tokenizer, text):
    same_as_library(coder, tokenizer, text)


def test_encoding_of_long_words(coder, tokenizer):
    for text in ("z" * 5000, "abc" * 2000, "!" * 3000, "aaaaaaa", "lll" * 7, "ΑΣ ΣΑΣ İ ǅ", "a<|endoftext|>b <|startoftext|>", "\x1c\x85\u2028x"):
        same_as_library(coder, tokenizer, text)


def test_encoding_query(spark, tokenizer):
    docs = documents(spark, EDGES).drop("ids")
    got = bpe.encode(docs, bpe.read_vocabulary(queries.vocabulary_path()), keep=("doc_id",), digests=True).collect()
    expected = []
    for i, t in EDGES:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        expected.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                         hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected))


def test_decoding_query(spark, tokenizer):
    vocabulary = bpe.read_vocabulary(queries.vocabulary_path())
    coded = bpe.encode(documents(spark, EDGES).drop("ids"), vocabulary, keep=("doc_id",))
    got = bpe.decode(coded, vocabulary, keep=("doc_id",)).collect()
    expected = [(i, tokenizer.decode(tokenizer.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False)) for i, t in EDGES]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected))


# --- toxicity

def maximal_by_hand(scores):
    """All maximal scoring segments by their definition: the best segment, then those of what lies left and right of it."""
    def best(lo, hi):
        top = None
        for a in range(lo, hi):
            for b in range(a + 1, hi + 1):
                s = sum(scores[a:b])
                if s > 0 and (top is None or s > top[2] or (s == top[2] and (b - a) < top[1] - top[0])):
                    top = (a, b, s)
        if top is None:
            return []
        return [*best(lo, top[0]), top, *best(top[1], hi)]
    return best(0, len(scores))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([-4.0, -1.5, -0.75, 0.5, 1.25, 3.0]), max_size=14))
def test_segments_by_their_definition(scores):
    got = toxicity.segments(np.array(scores))
    assert sorted(round(s, 9) for *_, s in got) == sorted(round(s, 9) for *_, s in maximal_by_hand(scores))
    assert all(abs(sum(scores[a:b]) - s) < 1e-9 for a, b, s in got)


def test_extreme_value_root():
    scores, weights = np.array([-1.0, 2.0]), np.array([0.8, 0.2])
    rate, scale = toxicity.extreme_value(scores, weights)
    assert abs(0.8 * np.exp(-rate) + 0.2 * np.exp(2 * rate) - 1) < 1e-6 and scale > 0


def test_toxic_documents_are_found(spark):
    insults = ["blorgh", "snarfel", "gruntok"]
    rng = random.Random(5)
    docs, labels = [], []
    for i in range(400):
        words = prose(i, 50).split()
        if i % 4 == 0:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(insults))
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(i % 4 == 0)))
    extra = [(None, None), (1000, ""), (1001, prose(9, 30_000)), (1001, prose(9, 30_000)), (1002, prose(1, 20) + " blorgh snarfel gruntok")]
    frame, marks = documents(spark, docs + extra), spark.createDataFrame([*labels, (None, 1, 1), (3, 1, None), (0, 1, 1)], "doc_id long, quality int, toxic int")
    held = toxicity.held_out("doc_id")
    model = toxicity.fit(frame, marks, train=~held)
    got = toxicity.score(frame, model, keep={"doc_id": frame["doc_id"], "held_out": held}).collect()
    assert len(got) == len(docs) + len(extra)
    for r in got:
        assert 0 <= r["score"] <= 1
        assert (r["score"] >= 0.5) == (r["doc_id"] == 1002 or (r["doc_id"] is not None and r["doc_id"] < 400 and r["doc_id"] % 4 == 0))
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    clean = toxicity.reject(frame, model)
    assert clean.columns == frame.columns and clean.count() == 300 + 4


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = documents(spark, EDGES)
    model = toxicity.fit(docs, none)
    assert toxicity.reject(docs, model).count() == len(EDGES)
    assert toxicity.score(documents(spark, []), model).count() == 0


# --- languages

def pieces_by_hand(sample, word):
    n, at = 0, 0
    while at < len(word):
        size = 1
        while at + size < len(word) and word[at:at + size + 1] in sample:
            size += 1
        at, n = at + size, n + 1
    return n


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab c", max_size=40), st.text(alphabet="ab cd", max_size=20))
def test_pieces_are_longest_matches(sample, word):
    assert langid.WordAutomaton(sample).pieces(word) == pieces_by_hand(sample, word)


def test_language_of_held_out_documents(spark, sf_dir):
    got = queries.QUERIES["op5_language"](spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert len(got) > 20 and sum(r["lang"] == r["lang_pred"] for r in got) / len(got) > 0.9


def test_workers_need_no_copy_of_the_package(spark, tmp_path):
    """The operators with a broadcast model run where the package cannot be imported."""
    script = tmp_path / "apart.py"
    script.write_text(f"""
import os, sys
sys.path.insert(0, {os.getcwd()!r})
from pyspark.sql import SparkSession, functions as F
spark = SparkSession.builder.master("local-cluster[1,1,1024]").config("spark.ui.enabled", "false").config("spark.executorEnv.PYTHONPATH", "").config("spark.checkpoint.dir", {str(tmp_path / 'c')!r}).config("spark.sql.shuffle.partitions", 2).getOrCreate()
from tessella.llm import decontaminate, langid, toxicity, hardneg, minhash
def lacks(_):
    try:
        import tessella
    except ImportError:
        yield True
assert spark.sparkContext.parallelize([0], 1).mapPartitions(lacks).collect() == [True]
docs = spark.createDataFrame([(i, f"some words here number {{'abcdefgh'[i % 8]}} " * 9 + ("vile" if i % 2 else ""), "en") for i in range(40)], "doc_id long, text string, lang string")
langid.predict(docs, langid.fit(docs, F.lit(True))).collect()
model = toxicity.fit(docs, docs.selectExpr("doc_id", "int(doc_id % 2) toxic"))
toxicity.score(docs, model).collect()
toxicity.reject(docs, model).collect()
decontaminate.drop_contaminated(docs, docs.selectExpr("doc_id item_id", "text").limit(2)).collect()
minhash.near_duplicates(docs).collect()
vectors = spark.createDataFrame([(i, [float(i), 1.0], i % 2) for i in range(30)], "vec_id long, embedding array<double>, label int")
hardneg.mine(vectors, F.col("id") % 10 == 0).collect()
print("done")
spark.stop()
""")
    clean = {k: v for k, v in os.environ.items() if k != "PYTHONPATH" and not k.startswith(("PYSPARK", "SPARK"))} | {"SPARK_SCALA_VERSION": "2.13", "SPARK_HOME": os.path.dirname(pyspark.__file__), "PYSPARK_PYTHON": sys.executable}
    ran = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=clean, capture_output=True, text=True, timeout=300)
    assert ran.stdout.strip().endswith("done"), ran.stderr[-3000:]


@pytest.mark.parametrize("name", ["__blob", "__id", "__spans", "__kept_id", "__content", "blob", "fp"])
def test_working_columns_do_not_clash(spark, name):
    docs = spark.createDataFrame([(1, "password: abcdefghij", "mine"), (2, "nothing to see here at all", "mine"), (2, "nothing to see here at all", "mine")], f"doc_id long, text string, `{name}` string")
    assert [r[2] for r in secrets.redact(docs).collect()] == ["mine"] * 3
    assert [r[2] for r in simhash.keep_one(docs).collect()] == ["mine"] * 2


def test_turns_of_other_roles_are_other_turns(spark):
    log = spark.createDataFrame([(1, 0, "a\ntb", None), (2, 0, "a", "b\n-"), (3, 0, "1", "r"), (4, 0, "1r", "")], "conv_id long, turn long, role string, text string")
    assert chats.render(log).count() == 4


def test_equal_words_are_compared_in_linear_time():
    items = decontaminate.Block(tuple((k, "same " * 60) for k in range(40)))
    began = time.time()
    found = decontaminate.Index(items).overlaps("same " * 5000)
    assert len(found) == 40 and all(r[1:] == (0, 60, 1.0) for r in found) and time.time() - began < 5


def test_language_edges(spark):
    docs = documents(spark, [*EDGES, (20, "12 34 !!")])
    sample = langid.fit(docs, F.col("doc_id").isNotNull())
    got = {(r["doc_id"], r["lang_pred"]) for r in langid.predict(docs, sample, keep={"doc_id": docs["doc_id"]}).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (20, "und"), (4, "en"), (6, "en"), (None, "en"), (None, "und")} <= got
    assert langid.fit(documents(spark, []), F.col("doc_id").isNotNull()).texts == ()


@pytest.mark.parametrize("same", [None, 7])
def test_language_sample_is_bounded(spark, monkeypatch, same):
    """Rows of one id, null or not, are sampled like any others; copies count once."""
    monkeypatch.setattr(langid, "SAMPLE_ROWS", 5)
    # Each text has a word of its own.
    own = lambda k: "q" + "".join(chr(ord("a") + int(c)) for c in f"{k:03}")
    docs = documents(spark, [(same, f"{prose(k, 30)} {own(k)}") for k in range(300)] + [(same, f"{prose(1, 30)} {own(1)}")] * 300)
    (_, text), = langid.fit(docs, F.lit(True)).texts
    assert sum(w.startswith("q") for w in text.split()) == 5


def test_language_sample_is_drawn_from_whole_texts(spark, monkeypatch):
    """Words at the end of a very long text are as likely to be learned as those at its beginning."""
    monkeypatch.setattr(langid, "SAMPLE_LETTERS", 4_000)
    words = ["".join(random.Random(k).choices("bcdfgaeiou", k=7)) for k in range(6_000)]
    (_, text), = langid.fit(documents(spark, [(1, " ".join(words))]), F.lit(True)).texts
    assert 4_000 <= len(text) <= 4_100
    at = [words.index(w) for w in text.split()]
    assert sum(k < 2_000 for k in at) > 100 and sum(k >= 4_000 for k in at) > 100


@pytest.mark.parametrize("text", ["\u00bd \u00b2 3", "\u2168 \u2460", "12 34"])
def test_numerals_are_no_letters(spark, text):
    docs = documents(spark, [(1, prose(1, 50))])
    got = langid.predict(documents(spark, [(2, text)]), langid.fit(docs, F.lit(True))).collect()
    assert [(r["lang_pred"], r["score"]) for r in got] == [("und", 0.0)]


def test_every_language_is_learned(spark):
    """More than two hundred languages, one of short texts alone, one of long ones; letterless texts teach nothing."""
    letters = [chr(0x4E00 + k) * 3 for k in range(230)]
    docs = [(k, f"{w} " * 10, f"l{k}") for k, w in enumerate(letters)] + [(1000, "blip blop", "short"), (1001, "zork " * 30_000, "long"), (1002, "12 34 " * 9, "none")]
    docs += [(2000 + k, prose(k, 60), "prose") for k in range(20)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    sample = langid.fit(frame, F.lit(True))
    assert {name for name, _ in sample.texts} == {lang for *_, lang in docs} - {"none"}
    of = langid.Identifier(sample)
    assert [of.predict(t)[0] for t in (letters[3], letters[229], "blip blop blip", "zork zork", prose(99, 30))] == ["l3", "l229", "short", "long", "prose"]


# --- syncmers

def test_anchors_need_no_context():
    inner = prose(1, 80)
    at, h = syncmers._anchors(syncmers._code_points(inner))
    for before, after in (("", prose(2, 9)), (prose(3, 7), ""), (prose(5, 30), prose(6, 30))):
        around_at, around_h = syncmers._anchors(syncmers._code_points(before + inner + after))
        shifted = set(zip((around_at - len(before)).tolist(), around_h.tolist(), strict=True))
        assert set(zip(at.tolist(), h.tolist(), strict=True)) <= shifted
        assert sum(0 <= p <= len(inner) - syncmers.K for p, _ in shifted) == len(at)


def test_anchors_are_closed_syncmers():
    codes = syncmers._code_points(prose(8, 60))
    at, _ = syncmers._anchors(codes)

    def inner_hash(i):
        one, _ = None, None
        h = 0
        for c in codes[i:i + syncmers.S].tolist():
            h = (h + c + 1) * int(syncmers._BASE) % (1 << 64)
        return int(syncmers._mix(np.array([h], np.uint64))[0])

    expected = []
    for i in range(len(codes) - syncmers.K + 1):
        own = [inner_hash(i + j) for j in range(syncmers.K - syncmers.S + 1)]
        if min(own) in (own[0], own[-1]):
            expected.append(i)
    assert at.tolist() == expected


def test_long_texts_in_chunks(monkeypatch):
    text = prose(11, 3000)
    whole = syncmers.to_text(*syncmers.sketch(text))
    monkeypatch.setattr(syncmers, "CHUNK", 1000)
    assert syncmers.to_text(*syncmers.sketch(text)) == whole


def test_fingerprints_of_edited_texts(spark):
    own = sorted(EDGES, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    got = syncmers.compare_with_next(documents(spark, EDGES)).collect()
    expected = []
    mark = lambda t: syncmers.to_text(*syncmers.sketch(t))
    for k, (i, t) in enumerate(own):
        t, following = t or "", own[(k + 1) % len(own)][1] or ""
        e = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        expected.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), mark(t), mark(e), syncmers.likeness(mark(t), mark(e)), syncmers.likeness(mark(t), mark(following))))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected))
    # Ids next to each other beyond a double's whole numbers share a range; their order stays.
    wide = [((1 << 60) + k, prose(k, 40)) for k in range(40)] + [(-(1 << 60), prose(77, 40))]
    close = {r["doc_id"]: r for r in syncmers.compare_with_next(documents(spark, wide)).collect()}
    for k in range(40):
        following = prose(k + 1, 40) if k < 39 else prose(77, 40)
        e = syncmers.edited(prose(k, 40), following)
        assert close[(1 << 60) + k]["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
    assert syncmers.compare_with_next(documents(spark, [])).count() == 0
    assert syncmers.compare_with_next(documents(spark, [(3, prose(1, 30))])).first()["near_next"] == 1.0


def test_likeness():
    a, b = prose(1, 400), prose(2, 400)
    mark = lambda t: syncmers.to_text(*syncmers.sketch(t))
    assert syncmers.likeness(mark(a), mark(a)) == 1.0 and syncmers.likeness(mark(a), mark(b)) < 0.1
    assert 0.3 < syncmers.likeness(mark(a), mark(a[: len(a) // 2] + b[: len(a) // 2])) < 0.75


# --- main text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x="</p><p>no</p>";</script></head><body>
<header><h1>Site name</h1></header><nav><ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul></nav>
<div class="cookie-notice">We use cookies on this site and that is what we do for you and for all of us.</div>
<article><h1>A title</h1><p>It was the best of times, it was the worst of times &amp; it
 was&nbsp;the age of <b>wis</b>dom for all of us.<br>Next line<p>Short.</p><div class="ad">Buy this now</div>
<form><p>Your name</p></form><p>&#x41;nd then there was one more of the things that he had said to her, and so on.</p>
<section class="comments"><p>I think that this was the best of all the things that I have read here.</p></section></article>
<aside><p>This is all about the other things that you may like to read on this site, and so on.</p></aside>
<footer>&copy; 2024 the owners of the site</footer><!-- x <p>no</p> --></body></html>"""


def test_main_text_of_an_article():
    assert maintext.main_text(PAGE) == ("A title\nIt was the best of times, it was the worst of times & it was the age of wisdom for all of us. Next line\nShort.\n"
                                        "And then there was one more of the things that he had said to her, and so on.")


def test_main_text_without_an_article():
    long = "It was said that there was a lot of it in the house, and that we were to go there with all of them."
    page = f"<body><div><a href=x>Home</a> <a href=y>News</a></div><h2>Title</h2><p>{long}</p><p>Short one</p><p>{long}</p><div><a href=z>next</a></div><p>{'x ' * 4}</p><div class=footer>{long}</div>"
    assert maintext.main_text(page) == f"Title\n{long}\nShort one\n{long}"


LONG_TEXT = "It was said that there was a lot of it in the house, and that we were to go there with all of them."


@pytest.mark.parametrize("name", ["layout with-sidebar", "content-sidebar-wrap", "no-sidebar", "has-sidebar", "content-sidebar", "page-sidebar", "sidebar", "widget-area"])
@pytest.mark.parametrize("inner", ["main", "article", "div"])
def test_wrappers_do_not_rule_out_the_page(name, inner):
    if inner == "div" and name in ("sidebar", "widget-area"):
        return
    page = f"<body><nav>Menu</nav><div class='{name}'><{inner}><h1>Title</h1><p>{LONG_TEXT}</p><p>{LONG_TEXT}</p></{inner}></div><footer>End</footer>"
    assert maintext.main_text(page).endswith(f"{LONG_TEXT}\n{LONG_TEXT}") and (inner == "div" or maintext.main_text(page).startswith("Title"))


FOREIGN = [
    "W lesie za miastem mieszkał stary zegarmistrz, który każdego ranka naprawiał zegary przyniesione przez sąsiadów z całej okolicy.",
    "Старый часовщик жил в лесу за городом и каждое утро чинил часы, которые приносили ему соседи со всей округи, не беря денег.",
    "Şehrin dışındaki ormanda yaşlı bir saatçi yaşıyordu ve her sabah komşularının getirdiği saatleri büyük bir sabırla onarıyordu.",
    "城外的森林里住着一位老钟表匠，每天早晨他都会修理邻居们从各处带来的钟表，从来不收一分钱。",
    "町の外の森に年老いた時計職人が住んでいて、毎朝、近所の人々が持ってくる時計を修理していました。",
    "นอกเมืองมีช่างทำนาฬิกาชราคนหนึ่งอาศัยอยู่ในป่าและทุกเช้าเขาจะซ่อมนาฬิกาที่เพื่อนบ้านนำมาจากทั่วทุกสารทิศโดยไม่คิดเงิน" * 2,
]


@pytest.mark.parametrize("text", FOREIGN)
def test_main_text_in_languages_without_a_list(text):
    page = f"<body><div><a href=a>One</a> <a href=b>Two</a></div><h2>T</h2><p>{text}</p><p>{text}</p><div><a href=c>{text}</a></div><div class=footer>{text}</div><p>{LONG_TEXT}</p>"
    assert maintext.main_text(page.replace(f"<p>{LONG_TEXT}</p>", "")) == f"T\n{text}\n{text}"
    # One sentence in a listed language, as of a notice, does not hide the rest.
    assert f"{text}\n{text}" in maintext.main_text(page.replace(f"<p>{text}</p>", f"<p>{text}</p>" * 4, 1))


def test_names_around_and_inside_an_article():
    rest = "".join(f"<div class='{c}'><p>{LONG_TEXT}</p></div>" for c in ("sidebar", "left-sidebar", "sidebar-left", "footer-inner", "cookie-notice", "site_header", "comment-list", "ad"))
    page = f"<div class='related'><article><p>{LONG_TEXT} Teaser.</p></article></div><article><div class='entry-header'><h1>Title</h1></div><p>{LONG_TEXT}</p><div class='post-header'>More</div></article>{rest}"
    assert maintext.main_text(page) == f"Title\n{LONG_TEXT}\nMore"
    assert maintext.main_text(f"<div class='entry-header'><h1>Title</h1></div><p>{LONG_TEXT}</p>{rest}") == f"Title\n{LONG_TEXT}"


def test_main_text_of_deep_and_broken_pages_takes_linear_time():
    import time

    line = "The cat and the dog are in the house because it is raining on all of the roofs of the town."
    for broken in ("<div></ul>", "<li><p></dl></table>", "<td></li></tr>"):
        start = time.time()
        text = maintext.main_text(broken * 20_000 + f"<div><p>{line} {line}</p></div>")
        assert time.time() - start < 10
        assert text.endswith(f"{line} {line}")
    # A cell ends the one before it, but not that of the table around it.
    nested = maintext.blocks("<article><table><tr><td>one<table><tr><td>two<td>three</table>four</table><p>five</article>")
    assert [b.text for b in nested] == ["one", "two", "three", "four", "five"] and all(b.article for b in nested)


def test_main_text_edges(spark):
    pages = [(1, "u", None), (2, "u", ""), (3, None, "<p>" + "a < b and the rest of it is here for all of us to see, is it not so? " * 2), (None, "u", "<!-- open"), (4, "u", "<script>x"),
             (5, "u", "<p>" + prose(1, 30_000)), (5, "u", "<p>" + prose(1, 30_000)), (6, "u", "plain"), (7, "u", "<" * 3000), (8, "u", "<p a='" * 500)]
    df = spark.createDataFrame([(*p, "x", 1) for p in pages], "page_id long, url string, html string, text string, n_chars int")
    got = maintext.extract(df, "html", {"page_id": df["page_id"]}).collect()
    assert len(got) == len(pages) and all(r["n_chars"] == len(r["text"]) for r in got)
    assert {r["page_id"]: r["text"] for r in got}[3].startswith("a < b and")
    assert maintext.extract(df.limit(0)).count() == 0


# --- secrets

BY_HAND = {
    "assign": (r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]+", 0, 32),
}


def base_by_hand(text):
    found = []
    for k, (kind, (pattern, group, least)) in enumerate(BY_HAND.items()):
        found += [(m.start(), k, kind, m.end()) for m in re.finditer(pattern, text) if len(m[group]) >= least]
    return [f"{kind}:{a}:{b}" for a, _, kind, b in sorted(found)]


SECRETS = ["token: secret: abcdefgh", "token=secret=abcdefgh1 é AKIA" + "A" * 12, "\U0001f600\U0001f600 Password = \"hunter2hunter2\"", "AKIAAKIA" + "Z" * 8, "a" * 31, "f" * 32, "0" * 40 + " " + "b" * 33,
           "api_key:aaaaaaaa apikey='bbbbbbbb", "token==abcdefgh", "AKIAshort AKIA0123456789AB", "secret:", "x" * 50_000 + " passwd=12345678", "gh" + "p_" + "a1" * 20]


def test_secrets_by_hand(spark):
    docs = documents(spark, [(i, t) for i, t in enumerate(SECRETS)] + EDGES)
    got = secrets.report(docs).collect()
    assert len(got) == len(SECRETS) + len(EDGES)
    texts = [*SECRETS, *[t or "" for _, t in EDGES]]
    expected = sorted((hashlib.sha256(",".join(base_by_hand(t)).encode()).hexdigest(), *[sum(s.startswith(k) for s in base_by_hand(t)) for k in BY_HAND]) for t in texts)
    assert sorted((r["base_sha256"], r["n_assign"], r["n_access"], r["n_hex"]) for r in got) == expected
    assert any("github:0:" in r["spans"] for r in got)
    assert secrets.report(documents(spark, [])).count() == 0


def test_ledger_scans_only_what_it_has_not_seen(spark):
    first = documents(spark, [(1, SECRETS[0]), (2, SECRETS[5]), (3, SECRETS[5])])
    ledger = secrets.scan(first)
    assert ledger.count() == 2 * len(secrets.RULES)
    later = documents(spark, [(1, SECRETS[0]), (4, SECRETS[5]), (5, "new text"), (6, None)])
    fresh = secrets.scan(later, ledger)
    assert {r["blob"] for r in fresh.collect()} == {hashlib.sha256(t.encode()).hexdigest() for t in ("new text", "")}
    newer = (*secrets.BASE[:2], secrets.Rule("hex", secrets.BASE[2].pattern, version=2), *secrets.MORE)
    assert {(r["rule"], r["version"]) for r in secrets.scan(first, ledger, newer).collect()} == {("hex", 2)}
    assert rows(secrets.report(later, ledger), "doc_id", "spans") == rows(secrets.report(later), "doc_id", "spans")


def test_redaction(spark):
    docs = documents(spark, [(1, "a token=abcdefgh1 b " + "f" * 32), (2, "\U0001f600 clean"), (3, None)])
    got = secrets.redact(docs)
    assert got.columns == docs.columns
    assert {r["doc_id"]: r["text"] for r in got.collect()} == {1: "a [secret] b [secret]", 2: "\U0001f600 clean", 3: None}


def test_redaction_of_whole_private_keys(spark):
    """The key's body goes with its header: with and without an END line, escaped, indented, encrypted, cut; prose around stays."""
    rng = random.Random(4)
    body = ["".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=64)) for _ in range(25)] + ["Qx7/cbAu5+Zw9A=="]
    begin, end = "-----BEGIN RSA PRIVATE " + "KEY-----", "-----END RSA PRIVATE " + "KEY-----"
    cases = [
        ("a " + "\n".join([begin, *body, end]) + "\nThe rest stays.", "a [secret]\nThe rest stays."),
        ("a " + "\r\n".join([begin, "Proc-Type: 4,ENCRYPTED", "DEK-Info: AES-128-CBC,00FF", "", *body, end]) + " b", "a [secret] b"),
        ('{"k": "' + "\\n".join([begin, *body, end]) + '"}', '{"k": "[secret]"}'),
        ("a " + " ".join([begin, *body, end]) + " b", "a [secret] b"),
        ("a\n  " + "\n  ".join([begin, *body, end]) + "\nb", "a\n  [secret]\nb"),
        ("\n".join([begin, *body, "The rest stays here."]), "[secret]The rest stays here."),
        ("\n".join([begin, *body])[:-7], "[secret]"),
        ("\n".join([begin, *body[:2], end, "and", begin, *body[2:4], end]), "[secret]\nand\n[secret]"),
        (begin + " is how a key begins.", "[secret] is how a key begins."),
        ("\n".join([begin, *body * 4000, end]) + " b", "[secret] b"),
        ("\n".join([begin, *body * 4000]), "[secret]"),
        (begin * 5000, "[secret]" * 5000),
    ]
    got = {r["doc_id"]: r["text"] for r in secrets.redact(documents(spark, [(k, t) for k, (t, _) in enumerate(cases)])).collect()}
    assert got == {k: clean for k, (_, clean) in enumerate(cases)}
    # The SQL twin takes the same spans with another library.
    db = duckdb.connect()
    db.execute("create table documents (doc_id bigint, text varchar)")
    small = [(k, t) for k, (t, _) in enumerate(cases) if len(t) < 5000]
    db.executemany("insert into documents values (?, ?)", small)
    twin = db.execute(f"select doc_id, spans from ({queries.ORACLE['op8_secrets']})").fetchall()
    assert rows(secrets.report(documents(spark, small)), "doc_id", "spans") == sorted(map(repr, twin))


# --- URLs

def rule_by_hand(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [r for r in urls.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.name), default=None)
    return host, path, best.name if best else None, best.verdict if best else None


URLS = ["http://A.Example.NET/en/1", "http://example.net/en", "http://example.net/de/", "http://net/", "http://net", "x.com/de/", None, "", "ftp://a.b.example.com/de/x?y://z/", "https://org/fr/2#a",
        "http://myexample.com/de/1", "http://É.org/fr/é", "http://h?x/y", "://", "a://b://c/d"]


def test_rules_by_hand(spark):
    df = spark.createDataFrame([(i, u, "x", "x", 1.0) for i, u in enumerate(URLS)], "page_id long, url string, html string, host string, purity double")
    got = {r["page_id"]: r for r in urls.judge(df).collect()}
    assert len(got) == len(URLS)
    for i, u in enumerate(URLS):
        host, path, rule, verdict = rule_by_hand(u)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        assert got[i]["verdict"] in ("allow", "block") and verdict in (None, got[i]["verdict"])
    assert urls.judge(df.limit(0)).count() == 0


def test_templates_of_one_kind_are_rejected(spark):
    """A branch that rules block throughout stays a branch of its own, and unruled pages in it are rejected."""
    rules = (urls.UrlRule("a.com", "/spam/old", "block"), urls.UrlRule("a.com", "/news/", "allow"))
    pages = [(i, f"http://a.com/spam/old{i}") for i in range(60)] + [(100 + i, f"http://a.com/news/{i}") for i in range(60)] + [(200, "http://a.com/spam/77"), (201, "http://a.com/misc/1")]
    got = {r["page_id"]: r for r in urls.judge(spark.createDataFrame(pages, "page_id long, url string"), rules).collect()}
    assert got[200]["verdict"] == "block" and got[201]["verdict"] == "allow"
    assert got[200]["template"].startswith("a.com/spam/")


def generalised_by_hand(path):
    def one(seg):
        end = re.search(r"(\.[a-z]{1,5})$", seg)
        end = end[1] if end else ""
        if re.fullmatch(r"[0-9]+(\.[a-z]{1,5})?", seg):
            return "<n>" + end
        if re.fullmatch(r"[0-9a-fA-F-]{8,}(\.[a-z]{1,5})?", seg):
            return "<h>" + end
        return "<m>" + end if re.search(r"[0-9]{4,}", seg) else seg
    return [one(x) for x in path.split("/") if x]


def tree_by_hand(pages):
    """Template and purity of each (host, segments, label) page, node by node and depth first."""
    out = [None] * len(pages)

    def purity(ids):
        labels = [pages[i][2] for i in ids if pages[i][2] is not None]
        return (sum(labels) + urls.WEIGHT / 2) / (len(labels) + urls.WEIGHT)

    def grow(node, ids, depth):
        if sum(pages[i][2] is not None for i in ids) < urls.LEAST_LABELLED:
            return {node: ids}
        by = {}
        for i in ids:
            segs = pages[i][1]
            by.setdefault(segs[depth] if depth < len(segs) else "", []).append(i)
        branches = {}
        for seg, own in by.items():
            branches.setdefault(seg if seg == "" or len(own) >= urls.LEAST_PAGES else "<*>", []).extend(own)
        known = []
        for name, own in branches.items():
            labels = [pages[i][2] for i in own if pages[i][2] is not None]
            if name and len(labels) >= urls.LEAST_LABELLED:
                known.append((sum(labels) / len(labels), name, sum(labels), len(labels)))
        groups, b, n = [], 0, 0
        for share, name, blocked, labelled in sorted(known):
            p = (b + blocked) / (n + labelled)
            if not groups or share - b / n > urls.LEAST_Z * (p * (1 - p) * (1 / n + 1 / labelled)) ** 0.5:
                groups.append([])
            groups[-1].append(name)
            b, n = b + blocked, n + labelled
        merged = {name: f"<{k}>" for k, g in enumerate(groups, 1) for name in g if len(g) > 1}
        children = {}
        for name, own in branches.items():
            children.setdefault(merged.get(name, name), []).extend(own)
        found = {}
        for name, own in children.items():
            found |= {f"{node}/": own} if name == "" else grow(f"{node}/{name}", own, depth + 1)
        return found

    for host in {p[0] for p in pages}:
        for node, ids in grow(host, [i for i, p in enumerate(pages) if p[0] == host], 0).items():
            for i in ids:
                out[i] = (node, round(purity(ids), 6))
    return out


def test_trees_by_hand(spark):
    """Two hundred random hosts, with literal, variable and wildcard segments up to seven deep."""
    rng, pages = random.Random(3), []
    for host in range(200):
        names = [rng.sample(["spam", "news", "a", "b", "c", "x1", "en", "de", str(rng.randrange(99)), "deadbeef00"], rng.randint(1, 5)) for _ in range(7)]
        bad = {n for level in names for n in level if rng.random() < 0.4}
        for _ in range(rng.choice([3, 20, 60, 150])):
            segs = [rng.choice(level) if rng.random() < 0.8 else f"v{rng.randrange(50)}" for level in names[:rng.randint(0, 7)]]
            label = None if rng.random() < 0.4 else int(any(x in bad for x in segs)) if rng.random() < 0.9 else rng.randrange(2)
            pages.append((f"h{host}.com", segs, label))
    df = spark.createDataFrame([(i, h, "/".join(s), b) for i, (h, s, b) in enumerate(pages)], "i long, host string, path string, blocked int")
    df = df.withColumn("shape", F.array_join(urls.generalised(F.col("path")), "/"))
    got = {r["i"]: (r["template"], round(r["purity"], 6)) for r in df.select("i", "host", "shape").join(urls.template_tree(df.select("host", "shape", "blocked")), ["host", "shape"]).collect()}
    want = tree_by_hand([(h, generalised_by_hand("/".join(s)), b) for h, s, b in pages])
    assert [got[i] for i in range(len(pages))] == want
    # Equal branches do merge, and deep ones do stay apart.
    assert any("<1>" in t for t, _ in want) and any(t.count("/") >= 5 for t, _ in want)


@pytest.mark.parametrize("labelled", [4, 10, 14, 32, 500])
def test_labels_of_one_branch_do_not_judge_its_siblings(spark, labelled):
    pages = [(i, f"http://x.example.com/de/{i}") for i in range(labelled)] + [(10_000 + i, f"http://x.example.com/en/{i}") for i in range(30)] + [(20_000, "http://x.example.com"), (20_001, "http://x.example.com/fr/1")]
    got = urls.judge(spark.createDataFrame(pages, "page_id long, url string")).where("rule IS NULL").collect()
    assert len(got) == 32 and {r["verdict"] for r in got} == {"allow"}


def test_deep_branches_have_verdicts_of_their_own(spark):
    rules = (urls.UrlRule("a.com", "/a/b/c/d/spam/o", "block"), urls.UrlRule("a.com", "/a/b/c/d/news/o", "allow"))
    pages = [(i, f"http://a.com/a/b/c/d/{kind}/{'o' if i % 2 else 'p'}{i}") for i, kind in enumerate(["spam"] * 100 + ["news"] * 100)]
    got = {r["page_id"]: r for r in urls.judge(spark.createDataFrame(pages, "page_id long, url string"), rules).collect()}
    assert {got[i]["verdict"] for i in range(100)} == {"block"} and {got[i]["verdict"] for i in range(100, 200)} == {"allow"}


# --- conversations

def collapse_by_hand(log):
    talks = {}
    for c, t, r, x in set(log):
        talks.setdefault(c, []).append((t is not None, t or 0, hashlib.md5(((f"{len(r)}r{r}" if r is not None else "-") + (("t" + x) if x is not None else "-")).encode()).hexdigest(), r, x))
    whole = {c: tuple(v[2] for v in sorted(talk, key=lambda v: v[:3])) for c, talk in talks.items()}
    kept = {}
    for c in sorted(whole, key=lambda c: (c is None, c or 0)):
        longer = any(len(o) > len(whole[c]) and o[: len(whole[c])] == whole[c] for o in whole.values())
        if not longer and whole[c] not in kept:
            kept[whole[c]] = c
    return {c: talks[c] for c in kept.values()}


def test_snapshots_collapse(spark):
    rng = random.Random(2)
    log = []
    for c in range(60):
        base = rng.randrange(6)
        for t in range(rng.randint(1, 9)):
            log.append((c, t + 3, "user" if t % 2 == 0 else "bot", f"{base} says {t}"))
    log += [(70, t, "user", f"long {t}") for t in range(100)] + [(71, t, "user", f"long {t}") for t in range(64)] + log[:5]
    log += [(None, 1, None, None), (80, None, "user", "x"), (80, None, "user", "y"), (81, 1, "user", ""), (82, 1, "user", "x"), (82, 1, "bot", "x")]
    df = spark.createDataFrame([(*r, "x", 1) for r in log], "conv_id long, turn long, role string, text string, hash string, place int").repartition(5)
    expected = collapse_by_hand(log)
    got = {}
    for r in chats.render(df).collect():
        got.setdefault(r["conv_id"], []).append((r["part"], r["n_turns"], r["conv_turns"], r["text"]))
    assert set(got) == set(expected)
    for c, parts in got.items():
        lines = [f"<|im_start|>{r or ''}\n{x or ''}<|im_end|>\n" for *_, r, x in sorted(expected[c], key=lambda v: v[:3])]
        assert "".join(p[3] for p in sorted(parts)) == "".join(lines)
        assert all(p[2] == len(lines) and p[1] <= chats.PART_TURNS for p in parts)
    assert chats.render(df.limit(0)).count() == 0


# --- decontamination

def test_masks_meet_every_stretch():
    """Any two substitutions in a stretch leave some mask's open places untouched."""
    for bad in itertools.combinations(range(decontaminate.STRETCH), 2):
        assert any(not {at + p for p in mask} & set(bad) for mask in decontaminate.MASKS for at in range(decontaminate.STRETCH - mask[-1]))


def test_substituted_passages_are_found(spark):
    item = prose(50, 40).split()
    rng = random.Random(1)
    docs = []
    for i in range(60):
        w = list(item) if i % 3 else item[5:5 + decontaminate.STRETCH]
        for at in rng.sample(range(len(w)), len(w) // 6):
            w[at] = "zzz"
        docs.append((i, f"{prose(100 + i, 30)}. {' '.join(w).upper()}! {prose(200 + i, 30)}"))
    clean = [(1000 + i, prose(300 + i, 200)) for i in range(40)]
    tests = spark.createDataFrame([(1, " ".join(item), 0), (1, " ".join(item), 0), (2, "a b", 0), (3, None, 0), (4, "lone six word item of test", 0)], "item_id long, text string, likeness int")
    frame = documents(spark, [*docs, *clean, *EDGES, (2000, "the lone six word item of test."), (2001, "lone six word thing of test")])
    got = decontaminate.overlaps(frame, tests, {"doc_id": frame["doc_id"]}).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [*[(i, 1) for i in range(60)], (2000, 4)] and all(r["likeness"] >= 0.8 for r in got)
    kept = decontaminate.drop_contaminated(frame, tests)
    assert kept.columns == frame.columns and kept.count() == len(clean) + len(EDGES) + 1
    assert decontaminate.overlaps(frame, tests.limit(0), {"doc_id": frame["doc_id"]}).count() == 0
    assert decontaminate.overlaps(documents(spark, []), tests, {}).count() == 0


def test_one_substitution_in_short_items():
    for n in range(decontaminate.LEAST_WORDS, decontaminate.STRETCH):
        item = prose(60, 40).split()[:n]
        index = decontaminate.Index(decontaminate.Block(((1, " ".join(item)),)))
        assert [r[0] for r in index.overlaps(f"{prose(61, 9)} {' '.join(item)} {prose(62, 9)}")] == [1]
        for k in range(n):
            changed = [*item[:k], "zzz", *item[k + 1:]]
            assert bool(index.overlaps(f"{prose(61, 9)} {' '.join(changed)} {prose(62, 9)}")) == (n >= 7)
            assert not index.overlaps(" ".join([*changed[: k - 1], "yyy", *changed[k:]] if k else ["zzz", "yyy", *item[2:]]))


def test_shortest_items_fill_whole_lines(spark):
    tests = spark.createDataFrame([(1, "Name the river"), (2, "blue"), (3, "?!"), (4, "\u4f55\u6642")], "item_id long, text string")
    frame = documents(spark, [(1, "name the river"), (2, "a\n Name the river?\nb"), (3, "can you name the river now"), (4, "Blue."), (5, "blue sky"), (6, "\u4f55\u6642\uff1f"), (7, "\u4f55\u6642\u304b"), (8, "?!")])
    got = decontaminate.overlaps(frame, tests, {"doc_id": frame["doc_id"]}).collect()
    assert sorted((r["doc_id"], r["item_id"], r["likeness"]) for r in got) == [(1, 1, 1.0), (2, 1, 1.0), (4, 2, 1.0), (6, 4, 1.0)]


def test_scripts_without_spaces_are_found():
    rng = random.Random(7)
    for first, last in ((0x4E00, 0x9FA0), (0x3041, 0x3090), (0x0E01, 0x0E2E)):
        make = lambda n: "".join(chr(rng.randrange(first, last)) for _ in range(n))  # noqa: E731, B023
        for n in (10, 12, 13, 20, 25, 26, 40):
            item = make(n)
            index = decontaminate.Index(decontaminate.Block(((1, item),)))
            for _ in range(20):
                changed = list(item)
                for at in rng.sample(range(min(n, 26)), 2 * min(n, 26) // 13):
                    changed[at] = make(1)
                assert index.overlaps(f"{make(30)}{''.join(changed)}{make(30)}")
            assert not index.overlaps(make(300))
        # Thirteen common characters in a row are a phrase, not a test item.
        item, part = make(40), slice(10, 23)
        assert not decontaminate.Index(decontaminate.Block(((1, item),))).overlaps(make(30) + item[part] + make(30))


def test_blocks_do_not_change_the_result(spark, sf_dir, monkeypatch):
    docs, tests = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    whole = rows(decontaminate.overlaps(docs, tests, {"doc_id": docs["doc_id"]}), "doc_id", "item_id", "first_word", "n_words")
    monkeypatch.setattr(decontaminate, "BLOCK_HASHES", 2000)
    assert rows(decontaminate.overlaps(docs, tests, {"doc_id": docs["doc_id"]}), "doc_id", "item_id", "first_word", "n_words") == whole


# --- queries with SQL twins, and the pipeline

@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql_twins(spark, sf_dir, name):
    got = queries.QUERIES[name](spark, sf_dir)
    db = duckdb.connect()
    for t in ("documents", "pages", "conversations", "embeddings"):
        db.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    cursor = db.execute(queries.ORACLE[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(got.columns)
    assert rows(got, *columns) == sorted(map(repr, cursor.fetchall()))


def test_pipeline(spark, sf_dir, tmp_path):
    import corpus_pipeline

    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, sf_dir)
        if k + 1 < len(corpus_pipeline.STAGES):
            assert made.columns == docs.columns
        made.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
    assert rows(corpus_pipeline.run(spark, sf_dir), *docs.columns) == rows(docs, *docs.columns)


def test_pipeline_stages_on_edges(spark, sf_dir, tmp_path):
    import corpus_pipeline

    for name, source in (("edges", documents(spark, EDGES)), ("none", documents(spark, []))):
        docs = source
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            made = stage(spark, docs, sf_dir)
            made.write.parquet(str(tmp_path / name / str(k)))
            docs = spark.read.parquet(str(tmp_path / name / str(k)))
        assert docs.count() == (5 if name == "edges" else 0) + (name == "edges")
