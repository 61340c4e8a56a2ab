"""Glossary resolution against page texts, and last-write-wins glossary maintenance.

A term matches a text when it occurs in it, ignoring case and accents.  Up to
``SENT_TERMS`` terms travel to the texts, so no text is shuffled: few are tested one by
one, many are looked up by the hashes of the text's windows (``termscan``).  Above that,
the first letters of a term (its gram) are joined with the grams of the texts, and only
those few hits are verified.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkloom.functions.languages import base_language, normalize_tag
from inkloom.functions.ordering import natural_key
from inkloom.functions.text import fold, none_if_blank, strip
from inkloom.operators import termscan
from inkloom.scale import carried, number_rows, small_table
from inkloom.session import materialize

GRAM_LENGTH = 4
#: Up to so many terms per project it is cheaper to test each term than to hash the windows of the text.
DIRECT_TERMS = 64
#: Terms, and bytes of terms, that are sent to every Python worker; above, texts are joined with terms by grams.
SENT_TERMS = 2_000_000
SENT_BYTES = 128 << 20
#: Times the pointers between lives are doubled before they are written.
DOUBLINGS = 2


def terms_for_language(glossary: DataFrame, language: str) -> DataFrame:
    """One row per entry that has a translation for the exact tag, else for its base language."""
    target = F.lower(normalize_tag(F.lit(language)))
    key = F.lower(normalize_tag(F.col("lang")))
    exact = F.max(F.when((key == target) & (F.col("translation") != ""), F.col("translation")))
    base = F.max(F.when(key == base_language(target), F.col("translation")))
    return (
        glossary.groupBy("project_id", "entry_id", "source_term")
        .agg(F.coalesce(exact, base).alias("preferred_translation"))
        .where(F.col("preferred_translation").isNotNull() & (strip(F.col("source_term")) != ""))
    )


def _grams(folded: Column, lengths: list[int]) -> Column:
    """Distinct substrings of the given lengths, found in one scan of the text each."""
    found = [F.regexp_extract_all(folded, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in lengths]
    return F.array_distinct(F.flatten(F.array(*found)))


def glossary_hits(
    texts: DataFrame, glossary: DataFrame, language: str, text: str = "source_text", carry: Sequence[str] = ()
) -> DataFrame:
    """(project_id, page_id, region_id, entry_id, source_term, preferred_translation) per text and term found in it.

    ``carry`` names further columns of ``texts`` that every hit keeps.
    """
    own = ["project_id", "page_id", "region_id", *carry]
    folded_term = fold(F.col("source_term"))
    terms = terms_for_language(glossary, language).withColumns(
        {"folded_term": folded_term, "gram": F.left(folded_term, F.lit(GRAM_LENGTH))}
    )
    rows = texts.select(*own, fold(F.col(text)).alias("folded"))
    keep = [*own, "entry_id", "source_term", "preferred_translation"]

    local = small_table(terms)
    if local is not None:
        # the checked-small glossary travels to the texts: no text is shuffled
        most = local.groupBy("project_id").count().agg(F.max("count")).first()[0] or 0
        if most <= DIRECT_TERMS:
            term = F.struct("folded_term", "entry_id", "source_term", "preferred_translation")
            listed = local.groupBy("project_id").agg(F.collect_list(term).alias("terms"))
            hits = F.filter("terms", lambda t: F.contains(F.col("folded"), t["folded_term"]))
            found = rows.join(F.broadcast(listed), "project_id").select(*own, F.explode(hits).alias("t"))
            return found.select(*own, "t.entry_id", "t.source_term", "t.preferred_translation")

    sent = (terms if local is None else local).select(
        "project_id", "folded_term", "entry_id", "source_term", "preferred_translation"
    )
    weight = F.sum(F.octet_length("folded_term") + F.octet_length("source_term") + F.octet_length("preferred_translation"))
    size = sent.agg(F.count(F.lit(1)).alias("n"), weight.alias("bytes")).first()
    if size["n"] <= SENT_TERMS and (size["bytes"] or 0) <= SENT_BYTES:
        # so do more terms, but too many to be tested by expressions
        shared = texts.sparkSession.sparkContext.broadcast(sent.toArrow())
        kinds = {**dict(rows.dtypes), **dict(sent.dtypes)}
        schema = ", ".join(f"{c} {kinds[c]}" for c in keep)
        return rows.where(F.col("project_id").isNotNull()).mapInArrow(termscan.scan(shared, own), schema)

    lengths = list(range(1, GRAM_LENGTH + 1))
    keys = rows.select("project_id", "page_id", "region_id", F.explode(_grams(F.col("folded"), lengths)).alias("gram"))
    candidates = keys.join(terms, ["project_id", "gram"]).drop("gram")
    return (
        candidates.join(rows, ["project_id", "page_id", "region_id"])
        .where(F.contains("folded", F.col("folded_term")))
        .select(*keep)
    )


def resolve_glossary(texts: DataFrame, glossary: DataFrame, language: str, text: str = "source_text") -> DataFrame:
    """Terms relevant to each page in the target language."""
    hits = glossary_hits(texts, glossary, language, text)
    return hits.drop("region_id").dropDuplicates(["page_id", "entry_id"])


def order_terms(glossary: DataFrame) -> DataFrame:
    """Entries of each project in natural term order (1-based ``position``)."""
    entries = glossary.select("project_id", "entry_id", "source_term").distinct()
    order = [natural_key(F.col("source_term")), F.col("source_term"), F.col("entry_id")]
    return number_rows(entries, ["project_id"], order, "position")


def _lives(writes: DataFrame, removals: DataFrame) -> DataFrame:
    """Every life a concept could have: (project_id, term_key, birth, owner, death, next_birth).

    Whichever write a life begins with, the first removal of its writer after it ends the
    life, and the first write after that begins the next one; so both are known for every
    write, without knowing which of them begins a life.
    """
    key = ["project_id", "term_key"]
    entry = ["project_id", "entry_id"]
    # the term an id holds ends when the id is removed or written under another term
    log = writes.withColumn("kind", F.lit(1)).unionByName(removals.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    held = carried(log, entry, ["seq", "kind", "term_key"], F.col("term_key"), "held")
    left = (F.col("kind") == 0) | (F.col("held") != F.col("term_key"))
    ends = held.where(left & F.col("held").isNotNull()).select(*entry, "seq", F.col("held").alias("term_key")).distinct()

    births = writes.groupBy(*key, "seq").agg(F.min("entry_id").alias("entry_id"))
    # an end at the moment of a birth does not end it, and a birth at the moment of an end is lost
    log = births.withColumn("kind", F.lit(1)).unionByName(ends.withColumn("kind", F.lit(0)))
    ended = carried(log, [*key, "entry_id"], ["seq", "kind"], F.when(F.col("kind") == 0, F.col("seq")), "death", ahead=True)
    ended = ended.where(F.col("kind") == 1).select(*key, F.col("seq").alias("birth"), F.col("entry_id").alias("owner"), "death")
    ended = materialize(ended)
    asks = ended.select(*key, F.coalesce("death", "birth").alias("seq"), F.lit(1).alias("kind"), "birth", "owner", "death")
    marks = ended.select(*key, F.col("birth").alias("seq"), F.lit(0).alias("kind"))
    log = asks.unionByName(marks, allowMissingColumns=True)
    told = carried(log, key, ["seq", "kind", "birth"], F.when(F.col("kind") == 0, F.col("seq")), "next_birth", ahead=True)
    following = F.when(F.col("death").isNotNull(), F.col("next_birth")).alias("next_birth")
    return told.where(F.col("kind") == 1).select(*key, "birth", "owner", "death", following)


def _last_lives(lives: DataFrame) -> DataFrame:
    """The life of every concept that no other follows, by doubling the pointers from each life to a later one.

    After r rounds a pointer spans 4**r lives, so the rounds grow with the logarithm of the longest chain.
    """
    key = ["project_id", "term_key"]
    first = lives.groupBy(*key).agg(F.min("birth").alias("birth"))
    lone = lives.join(first, [*key, "birth"], "left_semi").where(F.col("next_birth").isNull())
    # only first lives and those that follow another can be on a chain: there are no more of them than removals and terms
    onward = lives.where(F.col("next_birth").isNotNull()).select(*key, F.col("next_birth").alias("birth")).distinct()
    chains = lives.join(lone, key, "left_anti").join(onward.unionByName(first).distinct(), [*key, "birth"], "left_semi")
    span = materialize(chains.select(*key, "birth", F.coalesce("next_birth", "birth").alias("to"), F.col("next_birth").isNotNull().alias("more")))
    while True:
        heads = span.join(first, [*key, "birth"], "left_semi")
        if heads.where("more").isEmpty():
            break
        longer = span
        for _ in range(DOUBLINGS):
            onward = longer.select(*key, F.col("birth").alias("to"), F.col("to").alias("_to"), F.col("more").alias("_more"))
            longer = longer.join(onward, [*key, "to"]).select(*key, "birth", F.col("_to").alias("to"), F.col("_more").alias("more"))
        span = materialize(longer, instead_of=span)
    reached = heads.select(*key, F.col("to").alias("birth"))
    return lone.unionByName(lives.join(reached, [*key, "birth"], "left_semi"))


def upsert_glossary(base: DataFrame, changes: DataFrame) -> DataFrame:
    """Apply a change log to a glossary; the last write of a (term, language) wins.

    ``base(project_id, entry_id, source_term, lang, translation, note)`` holds the
    stored rows.  ``changes`` adds ``seq`` and ``op`` ('put' or 'remove'; a removal
    names only the entry).  A put of several languages is several rows with one seq.

    Entries that share a term (ignoring case) are one concept, owned by the id that
    wrote it first.  A put by the owner replaces all translations and the note; a
    put by another id merges its translations and replaces the note only if given.
    Removing the owner removes the concept; the next put starts it anew.  An id that
    is written under another term leaves its former term.
    """
    key = ["project_id", "term_key"]
    stored = base.select("*", F.lit(-1).cast("long").alias("seq"), F.lit("put").alias("op"))
    log = stored.unionByName(changes.select(*stored.columns)).withColumns(
        {
            "lang": normalize_tag(F.col("lang")),
            "translation": none_if_blank(F.col("translation")),
            "note": none_if_blank(F.col("note")),
            "source_term": strip(F.col("source_term")),
        }
    )
    log = materialize(log.withColumn("term_key", F.lower("source_term")))
    puts = log.where(F.col("op") == "put").drop("op")
    writes = puts.select(*key, "entry_id", "seq").distinct()
    lives = materialize(_lives(writes, log.where(F.col("op") == "remove").select("project_id", "entry_id", "seq")))
    last = _last_lives(lives).where(F.col("death").isNull()).select(*key, F.col("birth").alias("since"), "owner")

    live = puts.join(last, key).where(F.col("seq") >= F.col("since"))
    by_owner = F.col("entry_id") == F.col("owner")
    resets = live.where(by_owner).groupBy(*key).agg(
        F.max("seq").alias("reset"), F.max_by("source_term", "seq").alias("kept_term")
    )
    current = live.join(resets, key).where(F.col("seq") >= F.col("reset"))
    concepts = current.groupBy(*key).agg(
        F.first("owner").alias("entry_id"),
        F.first("kept_term").alias("source_term"),
        F.max_by("note", F.when(F.col("note").isNotNull(), F.col("seq"))).alias("note"),
    )
    translations = (
        current.where(F.col("translation").isNotNull() & F.col("lang").isNotNull())
        .groupBy(*key, "lang")
        .agg(F.max_by("translation", F.struct("seq", "entry_id")).alias("translation"))
    )
    return concepts.join(translations, key, "left").select(
        "project_id", "entry_id", "source_term", "lang", "translation", "note"
    )
