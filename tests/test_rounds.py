"""Operators that work in rounds: lineage cuts stay small, and rounds grow with the logarithm of the longest chain."""

import random
import time

from pyspark.sql import functions as F

from inkloom import scale
from inkloom.operators import dedupe, edits, glossary, grouping, reading, spatial
from inkloom.session import _file_system, _WRITTEN, materialize, release, scratch_scope

CHANGE = "project_id long, entry_id long, source_term string, lang string, translation string, note string, seq long, op string"


def estimate(frame):
    return int(str(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def exists(spark, path):
    files, place = _file_system(spark, path)
    return files.exists(place)


def test_cut_takes_the_size_of_its_files(spark):
    rows = spark.range(1000).withColumn("v", F.col("id") * 3)
    for _ in range(30):
        rows = materialize(rows.join(rows.select("id", F.col("v").alias("w")), "id").select("id", F.col("w").alias("v")), rows)
    files, place = _file_system(spark, _WRITTEN[rows])
    assert estimate(rows) <= files.getContentSummary(place).getLength() * 4
    assert {tuple(r) for r in rows.collect()} == {(i, 3 * i) for i in range(1000)}


def test_cut_files_are_removed(spark):
    kept = materialize(spark.range(5))
    path = _WRITTEN[kept]
    assert exists(spark, path)
    release(kept)
    assert not exists(spark, path)
    with scratch_scope(spark):
        path = _WRITTEN[materialize(spark.range(5))]
    assert not exists(spark, path)


def test_cut_keeps_names_and_types(spark):
    rows = spark.sql("select 1 as a, 'x' as A, array(struct(1 as p, null as q)) as s")
    rows = rows.select("*", F.lit(2).alias("a"))
    again = materialize(rows.drop("s"))
    assert again.columns == ["a", "A", "a"] and [tuple(r) for r in again.collect()] == [(1, "x", 2)]


def test_carried_values_of_hot_groups(spark):
    rng = random.Random(5)
    rows = [(g, i, rng.choice([None, None, i * 10])) for g in "ab" for i in range(300)] + [(None, 1, 7), (None, 2, None)]
    frame = spark.createDataFrame(rows, "g string, i int, v int").repartition(5)
    for ahead in (False, True):
        told = {
            limit: sorted(map(tuple, scale.carried(frame, ["g"], ["i"], F.col("v"), "w", limit, ahead).collect()), key=repr)
            for limit in (10, 1000)
        }
        assert told[10] == told[1000]
        for g, i, _, w in told[1000]:
            beside = [v for h, j, v in rows if h == g and v is not None and (j > i if ahead else j < i)]
            assert w == ((beside[0] if ahead else beside[-1]) if beside else None)


def replayed(changes):
    """The log one entry after the other: (project, term) -> owner, and the rows that count."""
    concepts, term_of = {}, {}
    for project, entry, term, lang, text, note, seq, op in sorted(changes, key=lambda c: c[6]):
        held = term_of.get((project, entry))
        if op == "remove":
            term_of.pop((project, entry), None)
            if held and concepts.get((project, held), {}).get("owner") == entry:
                del concepts[project, held]
            continue
        key = term.lower()
        if held and held != key and concepts.get((project, held), {}).get("owner") == entry:
            del concepts[project, held]
        term_of[project, entry] = key
        fresh = (project, key) not in concepts
        concept = concepts.setdefault((project, key), {"owner": entry, "said": {}, "note": None})
        if fresh or concept["owner"] == entry:
            concept |= {"term": term, "said": {}, "note": None}
        concept["said"][lang] = text
        concept["note"] = note or concept["note"]
    return sorted(
        (p, c["owner"], c["term"], lang, text, c["note"]) for (p, _), c in concepts.items() for lang, text in c["said"].items()
    )


def test_glossary_log_with_ids_that_change_their_term(spark):
    rng = random.Random(11)
    for size in (60, 400):
        changes = [
            (rng.randrange(3), rng.randrange(6), rng.choice(["Sun", "sun", "Moon", "Star"]), rng.choice(["ja", "en"]), f"t{seq}",
             f"n{seq}" if rng.random() < 0.3 else None, seq, "remove" if rng.random() < 0.35 else "put")
            for seq in range(size)
        ]
        frame = spark.createDataFrame(changes, CHANGE)
        empty = frame.select("project_id", "entry_id", "source_term", "lang", "translation", "note").where("false")
        found = glossary.upsert_glossary(empty, frame).collect()
        assert sorted(map(tuple, found), key=repr) == sorted(replayed(changes), key=repr)


def test_many_lives_of_one_term(spark, monkeypatch):
    cuts = []
    monkeypatch.setattr(glossary, "materialize", lambda *a, **k: cuts.append(1) or materialize(*a, **k))
    lives = 100_000
    seq = spark.range(2 * lives + 1).select(F.col("id").alias("seq"))
    changes = seq.select(
        F.lit(1).cast("long").alias("project_id"), F.floor(F.col("seq") / 2 % 7).alias("entry_id"), F.lit("Sun").alias("source_term"),
        F.lit("ja").alias("lang"), F.concat(F.lit("t"), "seq").alias("translation"), F.lit(None).cast("string").alias("note"), "seq",
        F.when(F.col("seq") % 2 == 0, "put").otherwise("remove").alias("op"),
    )
    empty = changes.select("project_id", "entry_id", "source_term", "lang", "translation", "note").where("false")
    [row] = glossary.upsert_glossary(empty, changes).collect()
    assert (row["entry_id"], row["translation"]) == (lives % 7, f"t{2 * lives}")
    assert len(cuts) <= 20


def moved_in_turn(n, moves):
    """The pages after one move after the other."""
    order = list(range(1, n + 1))
    for _, page, offset, position in moves:
        at = order.index(page)
        if position is not None:
            to = position - 1 if 1 <= position <= n else at
        else:
            to = min(max(at + (offset or 0), 0), n - 1)
        order.insert(to, order.pop(at))
    return order


MOVES = "project_id long, seq long, page_id long, offset long, position long"


def test_moves_of_all_kinds(spark):
    rng = random.Random(8)
    for n, count in ((1, 9), (5, 60), (300, 2500)):
        moves = [(s, rng.randint(1, n), rng.choice([None, rng.randint(-n, n)]), rng.choice([None, None, rng.randint(-2, n + 2)])) for s in range(count)]
        listed = [(4, *m) for m in moves] + [(4, 1, 9_999, 1, None), (77, 1, 1, 1, None)]
        pages = spark.createDataFrame([(p, i, i) for p in (4, 5) for i in range(1, n + 1)], "project_id long, page_id long, page_index long")
        frame = spark.createDataFrame(listed, MOVES).repartition(3)
        for limit in (3, 10_000):
            out = reading.move_pages(pages, frame, limit=limit).orderBy("project_id", "page_index").collect()
            assert [r.page_id for r in out if r.project_id == 4] == moved_in_turn(n, moves)
            assert [r.page_index for r in out] == [*range(1, n + 1)] * 2 and [r.page_id for r in out if r.project_id == 5] == list(range(1, n + 1))


def test_many_moves_of_one_project(spark):
    rng = random.Random(9)
    n, count = 20_000, 50_000
    moves = [(s, rng.randint(1, n), rng.randint(-400, 400), None if rng.random() < 0.7 else rng.randint(1, n)) for s in range(count)]
    pages = spark.range(1, n + 1).select(F.lit(1).cast("long").alias("project_id"), F.col("id").alias("page_id"), F.col("id").alias("page_index"))
    frame = spark.createDataFrame([(1, *m) for m in moves], MOVES)
    out = reading.move_pages(pages, frame).orderBy("page_index").collect()
    assert [r.page_id for r in out] == moved_in_turn(n, moves)


def replayed_history(log, keep, first=""):
    undo, redo, now = [], [], first
    for _, action, state in log:
        if action == "edit":
            undo = (undo if undo[-1:] == [now] else [*undo, now])[-keep:]
            redo, now = [], state
        elif action == "undo" and undo:
            redo, now = [*redo, now], undo[-1]
            undo = undo[:-1]
        elif action == "redo" and redo:
            undo, now = [*undo, now], redo[-1]
            redo = redo[:-1]
    return undo, redo, now


def test_long_edit_logs(spark):
    """A log of 100,000 entries beside short ones; as many jobs as for a short one."""
    rng = random.Random(12)
    logs = {p: [(s, rng.choice(["edit", "edit", "undo", "redo"]), f"s{rng.randrange(4)}") for s in range(size)] for p, size in ((1, 100_000), (2, 700), (3, 5))}
    frame = spark.createDataFrame([(p, *e) for p, log in logs.items() for e in log], "page_id long, seq long, action string, state string")
    start = spark.createDataFrame([(1, "s0"), (3, None), (9, "x")], "page_id long, state string")
    out = edits.replay_edits(frame.repartition(6), start, keep=20).collect()
    first = {1: "s0"}
    assert {r.page_id: (r.undo, r.redo, r.current) for r in out} == {p: replayed_history(log, 20, first.get(p, "")) for p, log in logs.items()}


def crowd(rng, size):
    """Boxes crowded in one corner, some on one spot, and one far away."""
    spots = [(rng.random() * 1e-3, rng.random() * 1e-3) for _ in range(size - 8)]
    return [*spots, *spots[:3], spots[0], (0.5, 0.5), (0.5, 0.5), (1.0, 1.0), (1.0, 0.0)]


def test_nearest_box_in_a_crowded_corner(spark):
    rng = random.Random(3)
    rows = [(g, i, i % 7, *p, 0.0, 0.0) for g, size in ((1, 900), (2, 40), (3, 700)) for i, p in enumerate(crowd(rng, size))]
    rows += [(4, i, i % 3, 0.25, 0.25, 0.0, 0.0) for i in range(90)]
    frame = spark.createDataFrame(rows, "group_id long, glyph_id long, ord int, x double, y double, width double, height double").repartition(5)
    want = {}
    for g, i, _, x, y, *_ in rows:
        ranked = [((x - u) ** 2 + (y - v) ** 2, o, j) for h, j, o, u, v, *_ in rows if h == g and j != i]
        want[g, i] = min(ranked)[2]
    for limit in (30, 512):
        out = spatial.nearest_neighbour(frame, limit=limit).collect()
        assert {(r.group_id, r.glyph_id): r.neighbour for r in out} == want and len(out) == len(rows)


def test_comparisons_per_box_stay_few(spark):
    """100,000 boxes in one corner and one outlier."""
    far = F.col("id") == 7
    places = materialize(
        spark.range(100_000).select(
            F.lit(1).alias("group_id"), F.when(far, 1.0).otherwise(F.rand(1) * 1e-3).alias("cx"),
            F.when(far, 1.0).otherwise(F.rand(2) * 1e-3).alias("cy"), F.lit(0).alias("ord"), F.col("id").alias("key"),
        )
    )
    blocks = materialize(spatial._blocks(places, "group_id", 10**6))
    assert blocks.groupBy("_block").count().agg(F.max("count")).first()[0] < 2 * spatial.LEAF_PLACES
    levels = spatial._tree(blocks, "group_id", 100_000)
    met = spatial._met_in_tree(blocks, levels, "group_id").groupBy("cx", "cy").count()
    row = met.agg(F.count("*").alias("n"), F.avg("count").alias("mean"), F.max("count").alias("most")).first()
    # besides, every level shows at most FANOUT nodes for each one that is followed
    assert row["n"] == 100_000 and row["mean"] + len(levels) * spatial.FANOUT * 2 < 200


def merged_in_turn(blobs, median):
    """The first fitting pair of the list, as often as there is one."""
    gap, ceiling = median * 0.15, median * 1.25
    blobs = list(blobs)

    def fits(a, b):
        near = a[2] - gap < b[4] and b[2] < a[4] + gap and a[3] - gap < b[5] and b[3] < a[5] + gap
        return near and max(max(a[4], b[4]) - min(a[2], b[2]), max(a[5], b[5]) - min(a[3], b[3])) <= ceiling

    while pair := next(((i, j) for i in range(len(blobs)) for j in range(i + 1, len(blobs)) if fits(blobs[i], blobs[j])), None):
        a, b = blobs[pair[0]], blobs.pop(pair[1])
        blobs[pair[0]] = (*a[:2], min(a[2], b[2]), min(a[3], b[3]), max(a[4], b[4]), max(a[5], b[5]))
    return blobs


def test_fragments_merge_as_in_turn(spark):
    rng = random.Random(21)
    rows = []
    for group in range(40):
        for i in range(rng.choice([1, 2, 6, 25])):
            rows.append((group, i, (i * 7) % 5, rng.random() * 30, rng.random() * 30, 0.5 + rng.random() * 8, 0.5 + rng.random() * 8))
    frame = spark.createDataFrame(rows, "group_id long, glyph_id long, ord int, x double, y double, width double, height double")
    want = set()
    for group in range(40):
        own = sorted((o, i, x, y, x + w, y + h) for g, i, o, x, y, w, h in rows if g == group)
        sizes = sorted(max(w, h) for g, _, _, _, _, w, h in rows if g == group)
        want |= {(group, i, x, y, r - x, b - y) for _, i, x, y, r, b in merged_in_turn(own, sizes[len(sizes) // 2])}
    for limit in (512, 4):
        out = grouping.merge_glyph_fragments(frame, limit).collect()
        found = {(r.group_id, r.glyph_id, r.x, r.y, r.width, r.height) for r in out}
        assert found == want or limit == 4


def test_many_fragments_of_one_group(spark):
    rng = random.Random(22)
    rows = [(1, i, i, rng.random() * 120, rng.random() * 120, 1 + rng.random() * 4, 1 + rng.random() * 4) for i in range(512)]
    frame = materialize(spark.createDataFrame(rows, "group_id long, glyph_id long, ord int, x double, y double, width double, height double"))
    grouping.merge_glyph_fragments(frame.limit(5)).collect()
    began = time.perf_counter()
    out = grouping.merge_glyph_fragments(frame).collect()
    took = time.perf_counter() - began
    own = [(o, i, x, y, x + w, y + h) for _, i, o, x, y, w, h in rows]
    sizes = sorted(max(w, h) for *_, w, h in rows)
    assert {r.glyph_id for r in out} == {i for _, i, *_ in merged_in_turn(own, sizes[256])}
    assert took < 15, took


def test_ranked_values_of_large_groups(spark):
    rng = random.Random(31)
    rows = [("a", rng.gauss(0, 1) * 10 ** rng.randrange(-9, 9)) for _ in range(3000)] + [("b", float(rng.randrange(4))) for _ in range(500)]
    rows += [("c", 1.5), ("d", None), ("a", None), (None, 2.0), (None, 1.0)] + [("e", 5.0)] * 900 + [("e", float(i)) for i in range(200)]
    frame = spark.createDataFrame(rows, "g string, v double").repartition(7)
    ranks = {"low": F.floor((F.col("_n") - 1) / 2), "high": F.floor(F.col("_n") / 2), "first": F.lit(0), "last": F.col("_n") - 1}
    want = {}
    for g in {g for g, v in rows if v is not None}:
        own = sorted(v for h, v in rows if h == g and v is not None)
        want[g] = (own[(len(own) - 1) // 2], own[len(own) // 2], own[0], own[-1])
    for limit in (20, 10_000):
        out = scale.ranked_values(frame, ["g"], "v", ranks, limit).collect()
        found = {r.g: tuple(r)[1:] for r in out}
        assert {g: v for g, v in found.items() if g} == {g: v for g, v in want.items() if g} and len(out) == len(found)


def test_median_of_many_distinct_values(spark):
    """The work of one large group is spread: no shuffle of its values, one or two rounds."""
    frame = spark.range(2_000_000).select(F.lit(1).alias("g"), (F.hash("id") + F.col("id") / 2e6).alias("v"))
    found = grouping.upper_median(frame, ["g"], "v", limit=100_000).first()["median"]
    assert found == frame.orderBy("v").offset(1_000_000).first()["v"]


def test_terms_found_by_hashes(spark, monkeypatch):
    rng = random.Random(41)
    word = lambda: "".join(rng.choice("abcé ") for _ in range(rng.randrange(1, 7)))
    terms = [(p, i, word() * rng.choice([1, 1, 4]), "en", f"t{i}") for i in range(300) for p in (1, 2) if rng.random() < 0.7]
    terms += [(1, 900, "Élan", "en", "x"), (1, 901, "élan", "en", "y"), (3, 902, "😀 ok", "en", "z")]
    texts = [(p, i, f"r{i}", "".join(word() for _ in range(rng.randrange(30)))) for i in range(200) for p in (1, 2)]
    texts += [(1, 900, "a", "ELAN elan"), (3, 901, "b", "say 😀 OK!"), (1, 902, "c", None), (1, 903, "d", ""), (None, 904, "e", "elan"), (2, 905, "f", "abc" * 200_000)]
    frame = spark.createDataFrame(texts, "project_id long, page_id long, region_id string, source_text string").repartition(3)
    listed = spark.createDataFrame(terms, "project_id long, entry_id long, source_term string, lang string, translation string")
    want = sorted(map(tuple, glossary.glossary_hits(frame, listed, "en").collect()), key=repr)
    monkeypatch.setattr(glossary, "small_table", lambda df: None)
    monkeypatch.setattr(glossary.termscan, "BLOCK", 500)
    for most in (glossary.SENT_TERMS, 0):  # by hashes, by a join of grams
        monkeypatch.setattr(glossary, "SENT_TERMS", most)
        assert sorted(map(tuple, glossary.glossary_hits(frame, listed, "en").collect()), key=repr) == want and len(want) > 500


def test_a_million_terms(spark):
    """No text is shuffled, and every planted term is found."""
    terms = spark.range(1_000_000).select(
        (F.col("id") % 3).alias("project_id"), F.col("id").alias("entry_id"), F.concat(F.lit("term "), F.sha1(F.col("id").cast("string")).substr(1, 12)).alias("source_term"),
        F.lit("en").alias("lang"), F.concat(F.lit("t"), "id").alias("translation"),
    )
    texts = spark.range(4000).select(
        (F.col("id") * 250 % 3).alias("project_id"), F.col("id").alias("page_id"), F.lit("r").alias("region_id"),
        F.concat(F.lit("so the "), F.repeat(F.lit("usual words go on "), 20), F.lit("TERM "), F.sha1((F.col("id") * 250).cast("string")).substr(1, 12), F.lit(".")).alias("source_text"),
    )
    found = glossary.glossary_hits(texts, terms, "en")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert {(r.page_id, r.entry_id) for r in found.collect()} == {(i, 250 * i) for i in range(4000)}


def test_many_echoes_on_one_page(spark):
    """20,000 unframed regions that show a handful of texts: their links grow with the regions, not with the pairs."""
    words = F.array(*[F.lit(t) for t in ("abcdef", "ghijkl", "mnopqr", "stuvwx")])
    regions = spark.range(20_000).select(
        F.lit(1).alias("page_id"), F.format_string("r%05d", "id").alias("region_id"), F.col("id").cast("int").alias("ord"),
        (F.col("id") % 200 / 200).alias("x"), (F.floor(F.col("id") / 200) / 100).alias("y"), F.lit(0.001).alias("width"), F.lit(0.001).alias("height"),
        F.element_at(words, (F.col("id") % 4 + 1).cast("int")).alias("source_text"),
        F.lit(False).alias("framed"), (F.col("id") % 100 / 100).alias("confidence"), F.lit("automatic").alias("direction"),
    )
    keyed = regions.withColumn("key", F.col("source_text"))
    assert dedupe._echo_candidates(keyed).count() == 20_000 - 4
    out = {r.source_text: r.confidence for r in dedupe.dedupe_regions(regions).collect()}
    assert out == {"abcdef": 0.96, "ghijkl": 0.97, "mnopqr": 0.98, "stuvwx": 0.99}
