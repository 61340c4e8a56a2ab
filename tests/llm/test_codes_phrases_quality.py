"""Vector codes, phrase mining and quality ranking against plain versions."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from inkloom.llm import codes, language, phrases, quality

DATA = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<double>, label int, code string, error string, slot int"
DOCS = "doc_id long, text string, lang string, words string, n string, rank int, score string, predicted string"


# --- vector codes -------------------------------------------------------------


def plain_codes(rows, parts, entries, rounds):
    """[(vec_id, label, code, error)] and codebooks, by comparing every part with every entry."""
    kept = [(i, [int(np.floor(4096 * x)) for x in v], label) for i, v, label in rows
            if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, _ in kept), default=0) // parts)
    kept = [(i, v + [0] * (parts * width - len(v)), label) for i, v, label in kept]
    first = sorted(((i, v) for i, v, _ in kept if i is not None))[:entries]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v in first] for p in range(parts)]

    def nearest(p, v):
        return min((sum((a - b) ** 2 for a, b in zip(cut(v, p), e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        found = [[nearest(p, v)[1] for p in range(parts)] for _, v, _ in kept]
        for p in range(parts):
            groups = {}
            for (_, v, _), f in zip(kept, found):
                groups.setdefault(f[p], []).append(cut(v, p))
            books[p] = [[sum(c) // len(c) for c in zip(*groups[k])] if k in groups else e for k, e in enumerate(books[p])]
    out = []
    for i, v, label in kept:
        best = [nearest(p, v) for p in range(parts)]
        out.append((i, label, "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best)))
    return out, books


@pytest.mark.parametrize("case", ["usual", "few", "odd", "grid"])
def test_codes_against_all_entries(spark, case):
    rng = random.Random(case)
    if case == "grid":  # many ties between entries
        rows = [(i, [rng.choice([-1.0, 0.0, 1.0]) for _ in range(16)], rng.choice([None, 1, 2])) for i in range(150)]
    else:
        size = 3 if case == "few" else 120
        rows = [(rng.randrange(10**6), [rng.gauss(0, 0.3) for _ in range(rng.choice([13, 15]) if case == "odd" else 16)], rng.choice([None, 1, 2])) for _ in range(size)]
    rows += rows[:2]
    rows += [(7, None, 1), (8, [1.0, None] * 8, 1), (9, [float("nan")] * 16, 1), (10, [float("inf")] * 16, None), (None, [0.25] * 13, 2)]
    frame = spark.createDataFrame([(*r, "x", "x", 0) for r in rows], VECTORS)
    found = codes.compress(frame).collect()
    want, books = plain_codes(rows, 8, 16, 6)
    assert sorted(((r["vec_id"], r["label"], r["code"], r["error"]) for r in found), key=repr) == sorted(want, key=repr)
    sums = Counter()
    for _, label, _, error in want:
        sums[label] += error
    assert all(r["label_error"] == sums[r["label"]] for r in found)
    told = ",".join(str(x) for part in books for entry in part for x in entry)
    assert {r["codebooks_sha256"] for r in found} == {hashlib.sha256(told.encode()).hexdigest()}


def test_codes_of_nothing(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert codes.compress(empty).collect() == []
    hollow = spark.createDataFrame([(1, [], 1, "x", "x", 0), (2, None, 1, "x", "x", 0)], VECTORS)
    assert [(r["code"], r["error"]) for r in codes.compress(hollow).collect()] == [("00" * 8, 0)]
    with pytest.raises(OverflowError):
        codes.compress(spark.createDataFrame([(1, [1e6], 1, "x", "x", 0)], VECTORS))


def test_neighbour_lists_skip_entries():
    """The walk gives the nearest entry without a look at all of them."""
    rng = np.random.default_rng(3)
    entries = rng.integers(-4000, 4000, (64, 4))
    queries = entries[rng.integers(0, 64, 500)] + rng.integers(-60, 60, (500, 4))
    lists = codes.Lists.of(entries)
    best, least = lists.nearest(queries)
    apart = ((queries[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (best == apart.argmin(axis=1)).all() and (least == apart.min(axis=1)).all()


# --- phrases ------------------------------------------------------------------


def plain_phrases(docs, least, covered, keep):
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    counts, total = {}, Counter()
    for text, lang in docs:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\n-\r]", lower(text)):
            w = re.findall("[^ \t]+", piece)
            total[lang] += len(w)
            for n in range(1, 5):
                for i in range(len(w) - n + 1):
                    counts.setdefault(lang, Counter())[tuple(w[i : i + n])] += 1
    out = []
    for lang, f in counts.items():
        rows = []
        named = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        for p, a in named.items():
            cuts = [(2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            inside = any(len(q) > len(p) and 100 * b >= covered * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in named.items())
            if not inside:
                rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for place, (score, a, p, left, right) in enumerate(sorted(rows)[:keep], 1):
            out.append((lang, place, p.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def phrase_docs(seed, size=260):
    rng = random.Random(seed)
    fixed = ["New York City", "in the end", "ça va bien", "of the the of", "x\ty z"]
    docs = []
    for i in range(size):
        said = [rng.choice(fixed) if rng.random() < 0.4 else f"W{rng.randrange(12)}" for _ in range(rng.randrange(30))]
        docs.append(("".join(w + rng.choice([" ", " ", " ", "  ", ". ", ",", "\n", "\r"]) for w in said), rng.choice(["en", "en", "fr", None])))
    return docs + [(None, "en"), ("", None), ("word " * 3000, "en"), ("É " * 40, "de"), docs[0], docs[0]]


@pytest.mark.parametrize("way", ["usual", "divided", "in pieces", "many words"])
def test_phrases_against_plain_counts(spark, monkeypatch, way):
    docs = phrase_docs(way)
    if way == "in pieces":
        monkeypatch.setattr(phrases, "HELD", 50)
    if way == "many words":
        monkeypatch.setattr(phrases, "SENT_WORDS", 0)
    if way in ("divided", "in pieces"):
        monkeypatch.setattr(phrases, "ROUTE_SUFFIXES", 40)
        monkeypatch.setattr(phrases, "UNDIVIDED", 3)
        monkeypatch.setattr(phrases, "LARGE", 0)
        ran = []
        real = phrases._in_pieces
        monkeypatch.setattr(phrases, "_in_pieces", lambda *a: ran.append(1) or real(*a))
    frame = spark.createDataFrame([(i, t, g, "x", "x", 0, "x", "x") for i, (t, g) in enumerate(docs)], DOCS).repartition(4)
    found = phrases.mine_phrases(frame, least=8, covered=80, keep=25).collect()
    assert sorted(map(tuple, found)) == plain_phrases(docs, 8, 80, 25)
    assert way not in ("divided", "in pieces") or ran


def test_phrases_of_nothing(spark):
    empty = spark.createDataFrame([], DOCS)
    assert phrases.mine_phrases(empty).collect() == []
    short = spark.createDataFrame([(1, "one two", "en", "x", "x", 0, "x", "x"), (2, None, None, "x", "x", 0, "x", "x")], DOCS)
    assert phrases.mine_phrases(short).collect() == []


def test_equal_partitions():
    rng = np.random.default_rng(1)
    keys = rng.integers(1, 4, (4, 3000)).astype(np.uint64)
    keys[2:, rng.random(3000) < 0.3] = 0
    keys[3, keys[2] == 0] = 0
    weights = rng.integers(1, 4, 3000)
    want = Counter()
    for column, weight in zip(keys.T.tolist(), weights.tolist()):
        for d in range(2, 5):
            if 0 not in column[:d]:
                want[tuple(column[:d])] += weight
    pointers, depth, count = phrases.equal_partitions(keys, weights, 60)
    got = {tuple(keys[:d, p].tolist()): n for p, d, n in zip(pointers, depth, count)}
    assert got == {k: n for k, n in want.items() if n >= 60} and len(got) == len(pointers)


# --- quality ------------------------------------------------------------------


def test_quality_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{DATA}/../sf0.01/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/../sf0.01/labels.parquet")
    ranking = quality.train(docs.where(~language.held_out()), labels.where(~language.held_out()))
    judged = quality.rank(docs.where(language.held_out()), ranking).join(labels, "doc_id").toPandas()
    assert judged.score.between(0, 1).all() and ((judged.score >= quality.ACCEPTED) == judged.predicted).all()
    assert (judged.predicted == judged.quality).mean() >= 0.95
    good, bad = judged.score[judged.quality == 1].to_numpy(), judged.score[judged.quality == 0].to_numpy()
    assert (good[:, None] > bad[None, :]).mean() >= 0.98


def test_ranking_is_the_minimum_of_the_pair_loss():
    rng = np.random.default_rng(2)
    labels = (rng.random(300) < 0.7).astype(int)
    found = rng.normal(size=(300, 5)) + labels[:, None] * [1, 0.5, 0, 0, -0.7]
    ranking = quality.fit(found, labels, rounds=40)
    scaled = (found - ranking.center) / ranking.spread
    better, worse = quality.preference_pairs(labels)
    gap = scaled[better] - scaled[worse]
    loss = lambda w: np.log1p(np.exp(-(gap @ w))).mean() + quality.RIDGE / 2 * (w @ w)
    least = loss(ranking.weights)
    for step in np.eye(5) * 0.01:
        assert least <= loss(ranking.weights + step) + 1e-12 and least <= loss(ranking.weights - step) + 1e-12
    share = (labels == 0).mean()
    assert abs((ranking.score(found) < quality.ACCEPTED).mean() - share) <= 0.01


def test_quality_of_odd_texts(spark):
    texts = [None, "", "!", "a" * 200_000, "word " * 50_000, "é\x00\n\t"]
    rows = [(i, t, "en", "x", "x", 0, "x", "x") for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(0, 1), (2, 0), (3, 1), (4, 0), (4, 0), (None, 1), (5, None)], "doc_id long, quality int")
    out = {r["doc_id"]: r for r in quality.rank(frame, quality.train(frame, labels)).collect()}
    assert set(out) == set(range(6)) and all(0 <= r["score"] <= 1 for r in out.values())
    assert out[0]["score"] == out[1]["score"]
    untaught = quality.train(frame, labels.where("quality = 1"))
    assert {r["predicted"] for r in quality.rank(frame, untaught).collect()} == {1}
    assert quality.rank(frame.where("false"), untaught).collect() == []


def test_features_do_not_depend_on_the_batch():
    texts = pq.read_table(f"{DATA}/documents.parquet").column("text").combine_chunks()
    whole = quality.features(texts)
    assert all(np.allclose(quality.features(texts[i : i + 1])[0], whole[i]) for i in range(0, 200, 17))
    assert not quality.features(pa.array([None, ""], pa.string())).any()


def test_every_labelled_row_teaches(spark, monkeypatch):
    monkeypatch.setattr(quality, "CHUNK_ROWS", 40)
    words = ["plain", "words", "of", "a", "text", "!!", "??", "x1", "22"]
    rows = [(i, " ".join(words[(i * k + k) % (5 if i % 7 else 9)] for k in range(1, 12)), int(i % 7 > 0)) for i in range(700)]
    frame = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    ranking = quality.train(frame, labels)
    found = quality.features(pa.array([r[1] for r in rows]))
    assert np.allclose(ranking.center, found.mean(axis=0)) and np.allclose(ranking.spread, np.where(found.std(axis=0) > 1e-9, found.std(axis=0), 1))
    strength = ranking.strength(found)
    assert np.isclose(ranking.least, np.quantile(strength, 100 / 700, method="midpoint"))
    dealt = quality._dealt(labels.selectExpr("doc_id", "quality as label"), {0: 100, 1: 600}).toPandas()
    assert dealt.own.sum() == 700 and sorted(dealt[dealt.own].doc_id) == list(range(700))
    assert set(dealt[dealt.label == 0].chunk) == set(dealt.chunk) and (dealt.groupby("chunk").label.nunique() == 2).all()
