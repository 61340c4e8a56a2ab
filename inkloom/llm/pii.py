"""Personal data: base patterns, and terms whose co-occurrence reveals a protected entity, in DataFrame functions only.

Base spans come from four patterns.  Every distinct value found (an e-mail address, an
ip, a card or phone number) is a protected entity.  Over the N different texts (equal ones
count once) the operator counts for every entity e and term t (a lower-cased word within
``CONTEXT`` code points of e) the texts n(t, e), n(t) and n(e).  The pointwise mutual
information log2(n(t, e) N / (n(t) n(e))) is at most log2(N / n(e)), which is small for a
frequent entity or a small table.  So a term found with e in at least ``SUPPORT`` texts, and
more often than by chance, discloses e when its information reaches ``BITS`` or the share
``MOST`` of that maximum, or when n(t, e) / n(t), the chance that the term gives e away,
reaches ``CERTAIN``.  In every document that holds e the term is generalised; where it
is certain, it is removed.

Only (entity, term) pairs, counts and 64-bit keys of texts are shuffled.  Texts meet the disclosing terms of
their document by broadcast if these are few, else by a join on the id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkloom.functions.boxes import let
from inkloom.session import checkpointed

CONTEXT = 80
#: Spans of a text up to which it is cut by substrings, and values that one fold appends.
CHUNK = 64
SUPPORT = 2
BITS = 8.0
MOST = 0.9
CERTAIN = 0.9
#: Documents with disclosing terms, and such terms of all of them, that may be broadcast (a few MB).
BROADCAST_DOCS = 20_000
BROADCAST_TERMS = 200_000
#: Keys of repeated texts that are broadcast at a time (some ten MB); more of them take several rounds.
BROADCAST_COPIES = 500_000

KINDS = ["email", "ip", "card", "phone", "generalised", "removed"]
#: Patterns as fixed by the contract; possessive repeats and the guards before them only
#: spare the regex engine attempts that must fail (a run's later starts fail as its first does).
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this has no match of the kind.
HINTS = {"email": "@", "ip": ".", "phone": "+"}
TERM = r"(?<!\p{L})\p{L}{3,}(?!\p{L})"
SPAN = "array<struct<start: int, end: int, kind: int, value: string>>"


def _before(values: Column, combine, chunk: int = CHUNK) -> Column:
    """For every value, what ``combine`` makes of 0 and all values before it; the last entry is for the end.

    A fold that appends to an array copies it at every step, so it runs over ``chunk`` values
    at a time: the chunks' own results are folded first, then every chunk from where it begins.
    ``combine`` must be associative.
    """

    def fold(start: Column, part: Column) -> Column:
        return F.aggregate(part, F.array(start), lambda out, x: F.array_append(out, combine(F.element_at(out, -1), x)))

    def chunked(all_: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / chunk).cast("int"))
        part = lambda c: F.slice(all_, c * chunk + 1, F.lit(chunk))
        whole = F.transform(numbers, lambda c: F.aggregate(part(c), F.lit(0), combine))
        return let(
            fold(F.lit(0), whole),
            lambda begin: F.array_append(
                F.flatten(F.transform(numbers, lambda c: F.slice(fold(begin[c], part(c)), F.lit(1), F.size(part(c))))), F.element_at(begin, -1)
            ),
        )

    return let(values, lambda all_: F.when(F.size(all_) > chunk, chunked(all_)).otherwise(fold(F.lit(0), all_)))


def _located(text: Column, pattern: Column, kind: int) -> Column:
    """Spans of all matches: the lengths of the pieces between them give the places."""
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("piece"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("match"))

    def spans(pair: Column) -> Column:
        lengths = F.transform(pair, lambda p: F.length(p["piece"]) + F.coalesce(F.length(p["match"]), F.lit(0)))
        placed = lambda before: F.transform(pair, lambda p, i: F.struct(before[i].alias("at"), p["piece"].alias("piece"), p["match"].alias("match")))
        matched = F.filter(let(_before(lengths, lambda x, y: x + y), placed), lambda p: p["match"].isNotNull())

        def span(p: Column) -> Column:
            start = p["at"] + F.length(p["piece"])
            return F.struct(start.alias("start"), (start + F.length(p["match"])).alias("end"), F.lit(kind).alias("kind"), p["match"].alias("value"))

        return F.transform(matched, span)

    return let(pairs, spans)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    """The doubled every second digit from the right makes the sum divisible by ten."""
    digits = F.reverse(_digits(value))
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(digits)),
        F.lit(0),
        lambda sum_, i: sum_
        + F.when(i % 2 == 1, F.substring(digits, i, F.lit(1)).cast("int")).otherwise(
            F.substring(digits, i, F.lit(1)).cast("int") * 2 - F.when(F.substring(digits, i, F.lit(1)) >= "5", F.lit(9)).otherwise(F.lit(0))
        ),
    )
    return total % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(
            F.split(value, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.right(p, F.lit(3)).cast("int"), F.lit(0)) <= 255)
        )
    if kind == "card":
        return F.when(F.length(_digits(value)).between(12, 19), _luhn(value)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _checked(kind: str):
    return lambda span: _valid(kind, span["value"])


def base_spans(text: Column) -> Column:
    """Array of all base spans by start, then kind; places count code points."""
    every = []
    for number, kind in enumerate(KINDS[:4]):
        pattern = F.lit(PATTERNS[kind])
        hint = F.contains(text, F.lit(HINTS[kind])) if kind in HINTS else text.rlike("[0-9]")
        possible = F.when(hint, text.rlike(PATTERNS[kind]))
        found = F.when(possible, _located(text, pattern, number)).otherwise(F.array().cast(SPAN))
        every.append(F.filter(found, _checked(kind)))
    joined = F.array_sort(F.concat(*[F.transform(s, lambda x: F.struct(x["start"], x["kind"], x["end"], x["value"])) for s in every]))
    out = F.transform(
        joined,
        lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), x["value"].alias("value")),
    )
    return F.when(text.isNull(), F.array().cast(SPAN)).otherwise(out)


def _entity(span: Column) -> Column:
    """The protected value behind a span: addresses in lower case, numbers as their digits."""
    value = F.when(span["kind"].isin(0, 1), F.lower(span["value"])).otherwise(_digits(span["value"]))
    return F.concat(span["kind"].cast("string"), F.lit(":"), value)


def _terms(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower))


def _nearby(text: Column, base: Column) -> Column:
    """(entity, terms) of every span: the whole words near it.

    Spaces keep words at the text's own ends, cut words fall away.  As in ``_replaced``, a text of
    many spans is cut as an array of its characters.
    """
    inside = lambda part: F.regexp_extract_all(part, F.lit(r"(?<=[^\p{L}])\p{L}{3,}(?=[^\p{L}])"), F.lit(0))

    def near(cut) -> Column:
        def of(span: Column) -> Column:
            low = F.greatest(span["start"] + 1 - CONTEXT, F.lit(1))
            before = cut(low, span["start"] + 2 - low)
            after = F.concat(F.lit(" "), cut(span["end"] + 2, F.lit(CONTEXT)))
            terms = F.array_distinct(F.transform(F.concat(inside(before), inside(after)), F.lower))
            return F.struct(_entity(span).alias("entity"), F.array_append(terms, F.lit("")).alias("terms"))

        return F.transform(base, of)

    padded = F.concat(F.lit(" "), text, F.lit(" "))
    by_walk = let(padded, lambda p: near(lambda at, size: F.substring(p, at, size)))
    by_array = let(F.split(padded, ""), lambda chars: near(lambda at, size: F.array_join(F.slice(chars, at, size), "")))
    return F.when(F.size(base) > CHUNK, by_array).otherwise(by_walk)


def _texts_per_term(docs: DataFrame, wanted: DataFrame, round_keys: int) -> tuple[DataFrame, int]:
    """(term, n_term) of the ``wanted`` terms over different texts, and how many texts differ.

    A text with c copies adds c to the rows of (term, c), so rows / c counts it once.  Rows
    learn their c from the broadcast keys of repeated texts; a round takes the rows
    of its share of the keys, so every text is split into terms in one round only.
    """
    texts = docs.where(F.col("text").isNotNull()).select(F.xxhash64("text").alias("key"), "text")
    repeated = checkpointed(texts.groupBy("key").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1"))
    keys, more = repeated.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("copies") - 1), F.lit(0))).first()
    rounds = max(1, -(-keys // round_keys))
    counted = []
    for k in range(rounds):
        mine = F.pmod("key", F.lit(rounds)) == k
        rows = texts.where(mine).join(F.broadcast(repeated.where(mine)), "key", "left")
        seen = rows.select(F.explode(_terms(F.col("text"))).alias("term"), F.coalesce("copies", F.lit(1)).alias("copies"))
        found = seen.join(wanted, "term", "left_semi").groupBy("term", "copies").agg(F.count(F.lit(1)).alias("rows"))
        counted.append(found if rounds == 1 else checkpointed(found))
    every = counted[0]
    for part in counted[1:]:
        every = every.unionByName(part)
    return every.groupBy("term").agg(F.sum(F.expr("rows div copies")).alias("n_term")), texts.count() - more


def disclosing_terms(
    docs: DataFrame, found: DataFrame, bits: float, support: int, certain: float, most: float = MOST, round_keys: int = BROADCAST_COPIES
) -> DataFrame:
    """(entity, term, certain) of every pair beyond the thresholds; ``found`` has the texts with base spans, written once."""
    marked = found.where(F.size("base") > 0).select(F.xxhash64("text").alias("key"), F.explode(_nearby(F.col("text"), F.col("base"))).alias("near"))
    pairs = marked.select("key", "near.entity", F.explode("near.terms").alias("term"))
    # a pair with the empty term counts the texts of the entity itself
    counted = pairs.distinct().groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_pair")).where(F.col("n_pair") >= support)
    counted = checkpointed(counted)
    entities = counted.where("term = ''").select("entity", F.col("n_pair").alias("n_entity"))
    joint = counted.where("term <> ''")
    wanted = joint.select("term").distinct()
    if wanted.count() <= BROADCAST_TERMS:
        wanted = F.broadcast(wanted)
    n_term, total = _texts_per_term(docs, wanted, round_keys)
    highest = F.log2(float(total) / F.col("n_entity"))
    information = F.log2(F.col("n_pair") * float(total) / (F.col("n_term") * F.col("n_entity")))
    sure = F.col("n_pair") >= F.col("n_term") * certain
    return (
        joint.join(entities, "entity")
        .join(n_term, "term")
        .where((information > 0) & (sure | (information >= F.least(F.lit(bits), most * highest))))
        .select("entity", "term", sure.alias("certain"))
    )


def _term_spans(text: Column, terms: Column, kind: int) -> Column:
    """Occurrences of whole terms, whatever their case."""
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join(terms, "|"), F.lit(r")(?!\p{L})"))
    return F.when(F.size(terms) > 0, _located(text, pattern, kind)).otherwise(F.array().cast(SPAN))


def _replaced(text: Column, spans: Column) -> Column:
    """The text with every span's kind in brackets, or nothing for removed terms; overlaps go to the earlier span."""
    names = F.array(*[F.lit("" if k == "removed" else f"[{k.upper()}]") for k in KINDS])

    def pieces(cut) -> Column:
        """Every span as the text since the end before it and its name, then the rest."""
        ends = F.transform(spans, lambda s: s["end"])

        def joined(done: Column) -> Column:
            def piece(s: Column, i: Column) -> Column:
                label = F.when(s["start"] >= done[i], F.element_at(names, s["kind"] + 1)).otherwise("")
                return F.concat(cut(done[i], F.greatest(s["start"] - done[i], F.lit(0))), label)

            last = F.element_at(done, -1)
            return F.concat(F.array_join(F.transform(spans, piece), ""), cut(last, F.greatest(F.length(text) - last, F.lit(0))))

        return let(_before(ends, lambda x, y: F.greatest(x, y)), joined)

    # a substring walks the text from its start, so a text of many spans is cut as an array of its characters
    by_walk = pieces(lambda at, size: F.substring(text, at + 1, size))
    by_array = let(F.split(text, ""), lambda chars: pieces(lambda at, size: F.array_join(F.slice(chars, at + 1, size), "")))
    return F.when(F.size(spans) == 0, text).when(F.size(spans) > CHUNK, by_array).otherwise(by_walk)


def sanitize(docs: DataFrame, bits: float = BITS, support: int = SUPPORT, certain: float = CERTAIN) -> DataFrame:
    """(doc_id, base, spans, clean_text) of every row.

    ``base`` are the pattern spans, ``spans`` these and the disclosing terms, both arrays of
    (start, end, kind, value) by start, then kind (its place in ``KINDS``), in code points.  A null text has
    no spans and stays null; a row with a null id gets base spans only; rows that
    repeat an id share its terms.  Other columns take no part.
    """
    found = docs.select("doc_id", "text", base_spans(F.col("text")).alias("base"))
    held = checkpointed(found.where(F.size("base") > 0))
    pairs = disclosing_terms(docs, held, bits, support, certain)
    entities = held.select("doc_id", F.explode("base").alias("span")).select("doc_id", _entity(F.col("span")).alias("entity")).distinct()
    per_doc = (
        entities.join(pairs, "entity")
        .groupBy("doc_id", "term")
        .agg(F.max("certain").alias("certain"))
        .groupBy("doc_id")
        .agg(
            F.sort_array(F.collect_list(F.when(~F.col("certain"), F.col("term")))).alias("generalise"),
            F.sort_array(F.collect_list(F.when(F.col("certain"), F.col("term")))).alias("remove"),
        )
    )
    per_doc = checkpointed(per_doc)
    size = per_doc.agg(F.count(F.lit(1)), F.sum(F.size("generalise") + F.size("remove"))).first()
    if size[0] <= BROADCAST_DOCS and (size[1] or 0) <= BROADCAST_TERMS:
        per_doc = F.broadcast(per_doc)
    none = F.array().cast("array<string>")
    joined = found.join(per_doc, "doc_id", "left").select(
        "doc_id",
        "text",
        "base",
        F.concat(
            F.col("base"),
            _term_spans(F.col("text"), F.coalesce("generalise", none), 4),
            _term_spans(F.col("text"), F.coalesce("remove", none), 5),
        ).alias("every"),
    )
    ordered = F.array_sort(F.transform("every", lambda x: F.struct(x["start"], x["kind"], x["end"], x["value"])))
    spans = F.transform(
        ordered,
        lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), x["value"].alias("value")),
    )
    return joined.select("doc_id", "text", "base", spans.alias("spans")).select(
        "doc_id", "base", "spans", _replaced(F.col("text"), F.col("spans")).alias("clean_text")
    )


def listed(spans: Column) -> Column:
    """``kind:start:end`` of all spans, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")
