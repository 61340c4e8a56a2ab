"""Every operator against its plain version, with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inkloom.llm import chat, chunks, decontaminate, language, lines, minhash, packing, pii, pivots, suffixes
from inkloom.llm.blocks import BYTE_VALUES, KeyIndex, text_blocks, word_starts_per_row
from inkloom.llm.blocks import words as word_table
from tests.llm import brute

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, score string, h string, n string, lead string, items string"


def frame(spark, rows):
    """Documents with columns that operators use as names of their own."""
    return spark.createDataFrame([(*r, *[None] * (4 - len(r)), "x", "x", "x", "x", "x") for r in rows], DOCS)


@pytest.fixture(scope="module")
def corpus():
    return random.Random(5)


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}é" for _ in range(n))


def test_words_and_blocks():
    texts = ["Ab cD-9é", None, "", "zz" * 40, "a", "É1 x"]
    for limit in (1, 8, 1 << 20):
        found = []
        for block in text_blocks(pa.array(texts), limit):
            w = word_table(block)
            found += [(block.first + r, block.data[a:b].tobytes().decode()) for r, a, b in zip(w.rows, w.starts, w.ends)]
        assert [(i, brute.lower(x)) for i, x in found] == [(i, x) for i, t in enumerate(texts) for x in brute.words(t)]


def test_key_index():
    keys = np.unique(np.random.default_rng(0).integers(0, 1 << 32, 5000).astype(np.uint64))
    index = KeyIndex(keys)
    assert (index.find(keys) == np.arange(len(keys))).all()
    assert (index.find(keys + np.uint64(1 << 40)) == -1).all()


def test_code_lengths(spark):
    samples = {"aa": ["ab abc abca é", "Zebra"], "bb": ["xyz zyx", "é é"]}
    rows = [(i, t, lang) for i, (lang, t) in enumerate((g, t) for g, ts in samples.items() for t in ts)]
    trees = language.train(frame(spark, rows))
    texts = ["abc", "xyz", "qqq abc é xyz", "A", "ABCA zebra"]
    trees.index()
    for lang, got in zip(trees.languages, _lengths(trees, texts)):
        want = [brute.code_length(samples[lang], t, language.ORDER) for t in texts]
        assert np.allclose(got, want)


def _lengths(trees, texts):
    for block in text_blocks(pa.array(texts)):
        at = block.bounds[:-1]
        return [np.add.reduceat(bits, at) for bits in trees.code_lengths(language.grams(block))]


def test_language_cases(spark):
    rows = [(1, "the the then", "en"), (2, "der die das", "de"), (3, None, "de"), (4, "", None), (5, "123 !?", None), (None, "the", None), (6, "the " * 400_000, None), (6, "the", "en")]
    docs = frame(spark, rows)
    trees = language.train(docs)
    got = language.identify(docs, trees).collect()
    assert [r.lang_pred for r in got] == ["en", "de", "und", "und", "und", "en", "en", "en"]
    assert all(0 <= r.score <= 1 for r in got)  # the input's own score column is replaced
    empty = language.train(docs.where("false"))
    assert {(r.lang_pred, r.score) for r in language.identify(docs, empty).collect()} == {("und", 0.0)}
    assert language.identify(docs.where("false"), trees).count() == 0


def test_many_languages_in_bounded_cells(spark):
    """No language is left out, however many there are; a tight bound takes grams, not languages."""
    names = [f"{a}{b}" for a in "abcdefghijklmnop" for b in "abcdefghijklmnopqrst"]  # 320 languages
    rows = [(i, f"{n}u{n}o {n}{n}a {n}u", n) for i, n in enumerate(names) for _ in range(2)]
    trees = language.train(frame(spark, rows), max_cells=320 * 2000)
    assert trees.languages == sorted(names)
    assert all(c.shape[0] == 320 and c.shape[1] <= 2000 and c.dtype == np.float32 for c in trees.costs)
    assert len(trees.gram_keys[-1]) == 2000 < len(language.train(frame(spark, rows)).gram_keys[-1])
    judged = language.identify(frame(spark, rows).withColumn("truth", F.col("lang")), trees)
    assert judged.where("truth = lang_pred").count() >= 0.9 * len(rows)


def test_language_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    trees = language.train(docs.where(~language.held_out()))
    judged = language.identify(docs.where(language.held_out()).withColumn("truth", F.col("lang")), trees)
    assert judged.where("truth = lang_pred").count() >= 0.95 * judged.count()


@pytest.mark.parametrize("hot_texts,limit", [(50_000, 1 << 19), (1, 1 << 19), (50_000, 64)])
def test_shared_bytes(spark, corpus, hot_texts, limit):
    base = [bytes(corpus.choices(b"ab", k=150)).decode() for _ in range(3)] + ["é" * 60, "a" * 300]
    docs = {i: None if i == 7 else "" if i == 8 else "".join(corpus.choice(base)[: corpus.randrange(20, 300)] for _ in range(corpus.randrange(1, 4))) for i in range(40)}
    docs[50] = docs[51] = docs[3]
    docs[52] = "short"
    docs[53] = "short"
    rows = [*docs.items(), (3, docs[3]), (None, docs[3])]
    got = suffixes.drop_shared(frame(spark, rows), hot_texts=hot_texts, limit=limit).collect()
    want = brute.shared_bytes(docs, 50)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.n_removed == 0 and bytes(r.kept).decode() == docs[3]
        else:
            assert (r.n_removed, r.n_spans, bytes(r.kept)) == want[r.doc_id]
    assert suffixes.drop_shared(frame(spark, [])).count() == 0


def test_shared_prefixes(corpus):
    for size in (1, 5, 60, 400):
        symbols = np.array([corpus.choice([1, 2, 3]) for _ in range(size)] + [0])
        for length in (1, 3, 8, 20):
            order, group = suffixes.shared_prefixes(symbols, length)
            head = lambda i: tuple(symbols[i : i + length])
            for a, b, x, y in zip(order, order[1:], group, group[1:]):
                if max(a, b) + length <= size:
                    assert (head(a) == head(b)) == (x == y)


def test_expansion_starts_where_intervals_are_short(corpus, monkeypatch):
    text = " ".join(corpus.choice(["alpha", "beta", "gamma", "delta", "kappa"]) + str(corpus.randrange(1000)) for _ in range(800))
    symbols = np.append(np.frombuffer(text.encode(), np.uint8).astype(np.int64) + 1, 0)
    extended, within = [], suffixes._within
    monkeypatch.setattr(suffixes, "_within", lambda counts: extended.append(int(counts.sum())) or within(counts))
    suffixes.shared_prefixes(symbols, 50)
    assert sum(extended) < len(symbols)


def test_texts_meet_by_more_than_two_words(corpus):
    word = lambda: "".join(chr(corpus.randrange(33, 127)) for _ in range(60))
    texts = pa.array([word() + "of the same word" + word() for _ in range(300)])
    keys = pa.array(np.arange(300))
    found = pa.Table.from_batches(suffixes._minimizers(50)(iter([pa.RecordBatch.from_arrays([keys, texts], ["key", "text"])])))
    assert found.num_rows == len(set(found["h"].to_pylist()))


def test_spans_do_not_depend_on_batches_and_blocks(corpus):
    base = [["".join(corpus.choices("ab", k=40)) + str(h) + "".join(corpus.choices("ab", k=49)) for _ in range(4)] for h in range(10)]
    plain = [(h, corpus.choice(base[h])[: corpus.choice([60, 90])].encode(), doc, doc % 7) for h in range(9) for doc in range(30)]
    rows = sorted(plain + [(9 | suffixes._HOT, corpus.choice(base[9])[:50].encode(), doc, doc % 7) for doc in range(30)])
    table = pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.int64(), pa.int64()))], ["h", "seg", "doc_id", "at"])
    spans = lambda size, limit: sorted(
        tuple(r.values()) for b in suffixes._removed(50, limit)(iter(table.to_batches(max_chunksize=size))) for r in b.to_pylist()
    )
    want = spans(1000, 1 << 19)
    assert want and all(spans(size, limit) == want for size, limit in ((1, 1), (7, 100), (64, 1), (1000, 500)))


def test_optimal_bounds(corpus):
    for _ in range(30):
        lengths = sorted(corpus.sample(range(1, 60), corpus.randrange(1, 8)))
        counts = [corpus.randrange(1, 9) for _ in lengths]
        buckets = corpus.randrange(1, 5)
        arrays = [np.array(x, np.int64) for x in (lengths, counts, [a * b for a, b in zip(lengths, counts)])]
        bounds = packing.optimal_bounds(*arrays, buckets)
        pad = lambda cut: sum(n * (min(c for c in cut if c >= x) - x) for x, n in zip(lengths, counts))
        best = min(pad((*cut, lengths[-1])) for k in range(min(buckets, len(lengths))) for cut in itertools.combinations(lengths[:-1], k))
        assert pad(bounds) == best and len(bounds) <= buckets


def test_packing(spark, corpus):
    rows = [(i, prose(corpus, corpus.choice([3, 4, 5, 90, 700, 3000]))) for i in range(300)] + [(300, None), (301, ""), (302, "one, two"), (302, "one, two")]
    packed = packing.pack(frame(spark, rows), buckets=4, budget=2000, shard_docs=40).collect()
    assert len(packed) == len(rows)
    sizes = {(r.doc_id): r.n_tokens for r in packed}
    assert sizes[300] == sizes[301] == 0 and sizes[302] == 3
    batches = {}
    for r in packed:
        assert r.n_tokens <= r.bucket_length
        batches.setdefault((r.bucket, r.shard, r.batch), []).append(r)
    for rows_ in batches.values():
        assert len(rows_) * rows_[0].bucket_length <= 2000 or len(rows_) == 1
        assert sorted(r.slot for r in rows_) == list(range(len(rows_)))
    assert packing.pack(frame(spark, [])).count() == 0
    edges = [1, 5, 1023, 1024, 1025, 2047, 2048, 2049, 5000, 10**6, 10**9 + 7]
    bins = [r[0] for r in spark.createDataFrame([(x,) for x in edges], "x long").select(packing._bin(F.col("x"))).collect()]
    assert all(x <= b <= x * 1.002 + 1 for x, b in zip(edges, bins)) and bins[:4] == edges[:4]


def test_packing_bounds_are_lengths_of_documents(spark):
    sizes = [0, 3, 1025, 1026, 5001, 9001, 9002, 70_001]
    packed = packing.pack(frame(spark, [(n, "x") for n in sizes]), length=F.col("doc_id"), buckets=8).collect()
    bounds = {r.n_tokens: r.bucket_length for r in packed}
    assert bounds == {0: 0, 3: 3, 1025: 1026, 1026: 1026, 5001: 5001, 9001: 9002, 9002: 9002, 70_001: 70_001}
    few = packing.pack(frame(spark, [(n, "x") for n in sizes]), length=F.col("doc_id"), buckets=2).collect()
    assert {r.bucket_length for r in few} == {9002, 70_001} and all(r.n_tokens <= r.bucket_length for r in few)


@pytest.mark.parametrize("block_bytes", [4 << 20, 40])
def test_contamination(spark, corpus, block_bytes):
    items = [(i, prose(corpus, n, 12)) for i, n in enumerate([3, 1, 13, 14, 30, 30, 25, 2])] + [(2, prose(corpus, 20, 12)), (9, None), (10, ""), (11, "...")]
    items.append((12, items[4][1]))
    docs = {i: prose(corpus, corpus.randrange(0, 60), 14) + " " + corpus.choice(items[:8])[1].upper() for i in range(40)}
    docs |= {50: None, 51: "", 52: "?!", 53: items[4][1] + "x"}
    bench = spark.createDataFrame([*items, (None, "w1é")], "item_id long, text string")
    rows = [*docs.items(), (0, docs[0])]
    got = decontaminate.decontaminate(frame(spark, rows), bench, block_bytes=block_bytes).collect()
    want = brute.contamination(docs, items)
    assert len(got) == len(rows)
    for r in got:
        n_words, n_hit, names = want[r.doc_id]
        assert (r.n_words, r.n_hit, sorted(r.hit_items)) == (n_words, n_hit, names)
        assert r.contaminated == (n_hit > 0 and 20 * n_hit >= n_words) and r.items == "x"
    none = decontaminate.decontaminate(frame(spark, rows), bench.where("false")).agg(F.sum("n_hit")).first()[0]
    assert none == 0 and decontaminate.decontaminate(frame(spark, []), bench).count() == 0


def test_contamination_of_neighbouring_items():
    """A window that reaches back over a shorter item joins the range before it, too."""
    a, b = (" ".join(f"{c}{i}" for i in range(n)) for c, n in (("a", 100), ("b", 13)))
    items = [("1", a), ("2", b), ("3", "b2 b3"), ("4", "a5")]
    found = decontaminate.prepare(items)
    for text, want in ((f"{a} {b}", 113), (f"{b} {a}", 113), (f"{b} {b} x {b}", 39), (f"x {a} b2 b3 {b}", 115)):
        block = next(text_blocks(pa.array([text])))
        split = word_table(block)
        (_, spans, names), = found.hits(split, word_starts_per_row(split, block.rows))
        n_hit = sum(stop - start for start, stop in spans)
        assert (n_hit, sorted(names)) == (want, brute.contamination({0: text}, items)[0][2])
        assert n_hit == brute.contamination({0: text}, items)[0][1]


def test_personal_data(spark):
    texts = [
        "a@b.c_d@e.f x@y a@b@c.d é +1 (20) 300-4000 end", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4", "4111 1111 1111 1111 and 4111111111111112",
        "5--12 3 4", "+1 2", "+123456789012345678", None, "", "no data", "x" * 50_000, "7" * 50_000, "é@b.co m@n-o.p.q.", "1 " * 20_000,
        "%@a.b,+49 30 1234567 +49 30 1234567", "12.12.12.12@host.example.com",
    ]
    rows = list(enumerate(texts)) + [(0, texts[0]), (None, texts[0])]
    got = pii.sanitize(frame(spark, rows)).select("doc_id", pii.listed(F.col("base")).alias("base"), "clean_text").collect()
    assert len(got) == len(rows)
    for r in got:
        text = texts[r.doc_id if r.doc_id is not None else 0]
        assert r.base == brute.personal(text)
        assert (r.clean_text is None) == (text is None)
    assert pii.sanitize(frame(spark, [])).count() == 0


def test_personal_data_of_long_texts(spark):
    """Many matches in one text, and every number of spans around the chunks of the fold."""
    texts = [" ".join(f"é{i} a{i}@b.co" for i in range(n)) for n in (1, 63, 64, 65, 128, 129, 200)] + [" ".join(f"u{i}@host.example" for i in range(100_000))]
    got = pii.sanitize(frame(spark, list(enumerate(texts)))).select("doc_id", "clean_text", pii.listed(F.col("base")).alias("base")).collect()
    for r in got:
        assert r.base == brute.personal(texts[r.doc_id])
    clean = {r.doc_id: r.clean_text for r in got}
    assert clean[7] == " ".join(["[EMAIL]"] * 100_000)
    assert clean[5] == " ".join(f"é{i} [EMAIL]" for i in range(129))


def test_overlapping_spans_go_to_the_earlier(spark):
    rows = spark.createDataFrame([("abcdefghij" * 30, [(i * 3, i * 3 + w, 0, "") for i in range(n)]) for n in (3, 90) for w in (2, 3, 5, 40)], f"text string, spans {pii.SPAN}")
    for r in rows.select("text", "spans", pii._replaced(F.col("text"), F.col("spans")).alias("out")).collect():
        want, at = "", 0
        for s in r.spans:
            want += r.text[at : max(at, s.start)] + ("[EMAIL]" if s.start >= at else "")
            at = max(at, s.end)
        assert r.out == want + r.text[at:]


def test_disclosing_terms(spark, corpus):
    plain = [(i, f"the mail of staff number{chr(97 + i % 20)} is somewhere in here") for i in range(2000)]
    told = [(5000 + i, f"ask Zorblatt the captain at zz@ship.example today, {i}") for i in range(3)] + [(5003, "ask Zorblatt the captain at zz@ship.example today, 0")]
    got = {r.doc_id: r for r in pii.sanitize(frame(spark, plain + told)).select("doc_id", "clean_text", pii.listed(F.col("spans")).alias("spans")).collect()}
    assert got[5000].spans.startswith("removed:0:3,removed:4:12")  # ask, Zorblatt: only ever near this address
    assert "zz@" not in got[5001].clean_text and "Zorblatt" not in got[5001].clean_text and " the " in got[5001].clean_text
    assert got[3].spans == "" and got[3].clean_text == plain[3][1]


def test_disclosing_terms_of_frequent_entities(spark):
    """Neither a small table, a frequent entity nor copies of a text hide what gives an entity away."""
    filler = [f"the plain note of {x}{y}" for x in ("alpha", "beta", "gamma") for y in "abcdefghij"]
    told = [f"the Zorblatt wrote to zz@ship.example {i}" for i in range(20)]
    mixed = ["mostly Quibble here", *[f"the Quibble at qq@ship.example {i}" for i in range(5)]]
    texts = [*filler, *told, *mixed]
    rows = list(enumerate(texts))
    copies = [*rows, *[(1000 + i, told[0]) for i in range(400)], *[(2000 + i, mixed[1]) for i in range(100)], *[(3000 + i, mixed[0]) for i in range(30)]]
    for docs in (rows, copies):
        docs_ = frame(spark, docs)
        held = docs_.select("doc_id", "text", pii.base_spans(F.col("text")).alias("base")).where(F.size("base") > 0)
        for round_keys in (1, pii.BROADCAST_COPIES):
            pairs = pii.disclosing_terms(docs_, held, pii.BITS, pii.SUPPORT, pii.CERTAIN, round_keys=round_keys)
            got = {(r.entity, r.term): r.certain for r in pairs.collect()}
            assert got == {("0:zz@ship.example", t): True for t in ("zorblatt", "wrote")} | {("0:qq@ship.example", "quibble"): False}
        clean = {r.doc_id: r.clean_text for r in pii.sanitize(docs_).collect()}
        assert clean[30] == "the   to [EMAIL] 0" and clean[51] == "the [GENERALISED] at [EMAIL] 0"
        assert clean[0] == texts[0] and clean[50] == texts[50]


def test_lines(spark, corpus):
    rows = [(i, "\n".join(corpus.choice(["menu", " menu ", "foot", "", f"only {i}", f"x{i % 9}"]) for _ in range(corpus.randrange(1, 9))), None, f"s{i % 3}") for i in range(90)]
    rows += [(100, None, None, "s1"), (101, "", None, "s1"), (102, "menu\n", None, None)] + [(103, "copy\ncopy2", None, "s2")] * 40
    got = lines.drop_boilerplate(frame(spark, rows), host="source", ratio=0.3).collect()
    want = brute.without_boilerplate([(r[0], r[3], r[1]) for r in rows], 0.3, lines.LEAST_PAGES)
    assert len(got) == len(rows)
    for r in got:
        assert r.kept_text == want[r.doc_id] and r.lead == "x"
    assert {r.kept_text for r in got if r.doc_id == 103} == {"copy\ncopy2"}
    assert lines.drop_boilerplate(frame(spark, []), host="source").count() == 0


def test_top_k(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, [float(x) for x in rng.normal(0, 0.2, 6)]) for i in range(400)]
    vectors += [(400 + i, vectors[7][1]) for i in range(20)] + [(900, None), (950, [0.1, None, 0.1, 0.1, 0.1, 0.1]), (951, [float("nan")] * 6), (952, [float("inf")] * 6)]
    vectors += [(1000, [0.5, 0.5]), (1001, [0.1, -0.5]), (1050, [0.0, 0.0]), (None, vectors[0][1]), (1100, []), (60, vectors[60][1])]
    points = pivots.quantized(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"))
    ints = [(i, [math.floor(256 * x) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = set()
    for q, v in dict(x for x in ints if x[0] % 50 == 0).items():
        best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ints if i != q and len(w) == len(v))[:5]
        want |= {(q, rank, i, -s) for rank, (s, i) in enumerate(best, 1)}
    for block in (4096, 3):
        got = pivots.top_k(points, points.where("vec_id % 50 = 0"), query_block=block).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert pivots.top_k(points.where("false"), points.where("false")).count() == 0


@pytest.mark.parametrize("partners", [4000, 3])
def test_near_duplicates(spark, corpus, partners):
    docs = {}
    for family in range(6):
        base = prose(corpus, 120).split()
        for copy in range(12):
            changed = list(base)
            for _ in range(corpus.choice([0, 1, 2, 3, 6])):
                changed[corpus.randrange(len(changed))] = f"q{corpus.random()}"
            docs[family * 100 + copy] = " ".join(changed)
    docs |= {1000: None, 1001: "", 1002: "?!", 1003: "three words here", 1004: "Three WORDS here", 1005: "x " * 50_000, 1006: "x " * 45_000}
    rows = [*docs.items(), (0, docs[0]), (None, docs[0])]
    data = frame(spark, rows)
    labels = {r.doc_id: r.class_id for r in minhash.near_duplicates(data, partners=partners).collect()}
    assert labels.pop(None) is None and labels == brute.near_classes(docs)
    assert minhash.near_duplicates(data).count() == len(rows)
    assert minhash.near_duplicates(frame(spark, [])).count() == 0


def test_signatures_estimate_weighted_jaccard():
    words_ = [f"t{i}" for i in range(400)]
    a, b = " ".join(words_[:300] + words_[:40]), " ".join(words_[60:300] + words_[:40] + words_[300:330])
    block = next(text_blocks(pa.array([a, b])))
    cells, bounds, _ = minhash.shingle_cells(block)
    ranks = minhash.signatures(cells, bounds, 4096)
    x, y = brute.shingles(a), brute.shingles(b)
    assert abs((ranks[0] == ranks[1]).mean() - sum((x & y).values()) / sum((x | y).values())) < 0.03


def test_chunks(corpus):
    texts = ["", "a" * 700, prose(corpus, 300), "é" * 500, "z", prose(corpus, 7)]
    gear = [int(v) & 0xFFFF for v in BYTE_VALUES]
    block = next(text_blocks(pa.array(texts)))
    for text, start, edges in zip(texts, block.bounds, chunks.boundaries(block)):
        got = [e - start for e in edges]
        assert got == brute.gear_chunks(text.encode(), gear, chunks.REACH, chunks.LEAST, chunks.MOST, int(chunks._MASK))


def test_substring_dedup(spark, corpus):
    passage = prose(corpus, 60, 10**6)
    docs = {i: f"{prose(corpus, 40, 10**6)} {passage} {prose(corpus, 30, 10**6)}" for i in range(5)}
    docs |= {10: prose(corpus, 200, 10**6), 11: None, 12: ""}
    docs[13] = docs[10]
    rows = [*docs.items(), (10, docs[10]), (None, docs[10])]
    got = chunks.drop_repeats(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id in range(1, 5):
            assert len(passage.encode()) * 0.5 < r.n_removed <= len(passage.encode()) + 2 * chunks.MOST
        elif r.doc_id == 13:
            assert r.kept_text == "" and r.n_removed == len(docs[10].encode())
        else:
            assert r.n_removed == 0 and r.kept_text == docs[r.doc_id if r.doc_id is not None else 10]
    assert chunks.drop_repeats(frame(spark, [])).count() == 0


def test_short_repeats(spark, corpus):
    """Copies of short texts, and single repeated chunks below 64 bytes, are removed."""
    short = {1: "ok", 2: "a line of some forty bytes, all of it ascii", 3: "x" * 63}
    rows = [*short.items(), *[(i + 10, t) for i, t in short.items()], (20, "no copy")]
    got = {r.doc_id: (r.n_removed, r.kept_text) for r in chunks.drop_repeats(frame(spark, rows)).collect()}
    assert got == {**{i: (0, t) for i, t in short.items()}, **{i + 10: (len(t), "") for i, t in short.items()}, 20: (0, "no copy")}
    text = prose(corpus, 400, 10**6)
    data = text.encode()
    block = next(text_blocks(pa.array([text])))
    edges = list(next(iter(chunks.boundaries(block))))
    alone = next((a, b) for a, b in zip(edges, edges[1:]) if b - a < 64 and b < len(data))
    other = data[slice(*alone)].decode() + prose(corpus, 400, 10**6)
    r = chunks.drop_repeats(frame(spark, [(1, text), (2, other)])).where("doc_id = 2").first()
    assert r.n_removed == alone[1] - alone[0] and other.endswith(r.kept_text)


def test_chat_round_trip(spark, corpus):
    pieces = ["\\", "#", "###", "</turn>", "</", "turn>", "\n", "é", ": ", "### user: ", "\\h", "ok", "", "\U0001f600"]
    rows = [(c, t, corpus.choice(["user", "assistant", "sys: ###", None]), None if corpus.random() < 0.1 else "".join(corpus.choices(pieces, k=corpus.randrange(9)))) for c in [1, 2, 3, None, 5] for t in [0, 1, 2, 2, 3, 7]]
    rows += [(9, 0, "assistant", "###" * 5000), (9, 0, "assistant", "###" * 5000)]
    table = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    made = chat.format_conversations(table)
    got = {r.conv_id: r for r in made.collect()}
    back = {r.conv_id: r for r in chat.read_back(made).collect()}
    low = lambda x: (x is not None, x or "")
    for conv in [1, 2, 3, None, 5, 9]:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1], low(r[2]), low(r[3])))
        turns = [(r[2] or "", r[3] or "") for r in own]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert chat.parse(got[conv].formatted) == turns
        assert back[conv].loss_chars == len(loss) and back[conv].loss_sha256 == brute.digest(loss)
        assert back[conv].turns_sha256 == brute.digest("".join(f"{a}\n{b}\n" for a, b in turns))
        assert back[conv].formatted_chars == len(got[conv].formatted)
    assert chat.format_conversations(table.where("false")).count() == 0
    assert hashlib.sha256(b"").hexdigest() == brute.digest("")


def test_busy_chunks(spark):
    """Digests of any frequency: the same rows whether none, some or all of the repeated ones travel to the chunks."""
    rng = random.Random(9)
    passages = ["".join(rng.choice("abcdefgh ") for _ in range(700)) for _ in range(5)]
    rows = [(i, f"{i} " + passages[0] + (passages[rng.randrange(5)] if i % 3 else "")) for i in range(90)]
    rows += [(7, rows[7][1]), (None, passages[0]), (200, None), (201, "")]
    docs = frame(spark, rows)
    results = [sorted(map(str, chunks.drop_repeats(docs, hot=hot).collect())) for hot in (0, 20, 1000)]
    assert results[0] == results[1] == results[2]
    removed = {r.doc_id: r.n_removed for r in chunks.drop_repeats(docs, hot=20).collect()}
    assert removed[0] == 0 and all(removed[i] > 500 for i in range(1, 90))
