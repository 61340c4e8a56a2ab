"""Glossary, language, quality and accuracy queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkloom.functions.languages import DEFAULT_LOCALES, normalize_tag, resolve_target
from inkloom.operators import glossary, quality
from inkloom.plans.catalog import query
from inkloom.scale import number_rows

TERMS_SQL = """
terms AS (SELECT project_id, entry_id, source_term,
    coalesce(max(translation) FILTER (lower(lang) = 'zh-hant' AND translation <> ''),
             max(translation) FILTER (lower(lang) = 'zh')) AS preferred_translation
  FROM fx_glossary GROUP BY ALL HAVING preferred_translation IS NOT NULL)
"""


def resolve_sql(view: str) -> str:
    return f"""WITH {TERMS_SQL} SELECT DISTINCT t.project_id, x.page_id, t.entry_id, t.source_term, t.preferred_translation
    FROM {view} x JOIN terms t ON t.project_id = x.project_id
     AND contains(strip_accents(lower(x.source_text)), strip_accents(lower(t.source_term)))"""


@query("resolve_glossary", resolve_sql("fx_texts"), ("fx_texts", "fx_glossary"))
def _(v):
    return glossary.resolve_glossary(v.texts(), v.glossary(), "zh_hant")


@query("resolve_glossary_documents", resolve_sql("fx_document_texts"), ("fx_document_texts", "fx_glossary"))
def _(v):
    return glossary.resolve_glossary(v.document_texts(), v.glossary(), "zh-Hant")


@query(
    "order_terms",
    """SELECT project_id, entry_id, source_term,
         row_number() OVER (PARTITION BY project_id ORDER BY strip_accents(lower(source_term)), source_term, entry_id) AS position
       FROM (SELECT DISTINCT project_id, entry_id, source_term FROM fx_glossary)""",
    ("fx_glossary",),
)
def _(v):
    return glossary.order_terms(v.glossary())


CHANGES_SQL = """
changes AS (SELECT user_id % 10 AS project_id, event_id % 23 AS entry_id,
    CASE WHEN event_id % 2 = 0 THEN 'Term ' ELSE 'TERM ' END || (event_id % 23 % 9) AS source_term,
    CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN 'remove' ELSE 'put' END AS op,
    (['zh', 'en', 'ja'])[k % 3 + 1] AS lang, 't' || k AS translation,
    CASE WHEN k % 4 = 0 THEN 'n' || k END AS note, event_id AS seq
  FROM (SELECT *, regexp_extract(props, '[0-9]+', 0)::INTEGER AS k FROM events))
"""


def glossary_changes(v):
    key, k = F.col("event_id"), F.regexp_extract("props", "[0-9]+", 0).cast("int")
    return v.raw("events").select(
        (F.col("user_id") % 10).alias("project_id"),
        (key % 23).alias("entry_id"),
        F.concat(F.when(key % 2 == 0, "Term ").otherwise("TERM "), key % 23 % 9).alias("source_term"),
        F.array(F.lit("zh"), F.lit("en"), F.lit("ja"))[k % 3].alias("lang"),
        F.concat(F.lit("t"), k).alias("translation"),
        F.when(k % 4 == 0, F.concat(F.lit("n"), k)).alias("note"),
        key.alias("seq"),
        F.when((F.col("event_type") == "error") & (key % 3 == 0), "remove").otherwise("put").alias("op"),
    )


@query(
    "upsert_glossary",
    f"""WITH RECURSIVE {CHANGES_SQL},
    puts AS (SELECT *, lower(source_term) AS term_key FROM changes WHERE op = 'put'),
    removals AS (SELECT r.project_id, r.entry_id, lower('Term ' || (r.entry_id % 9)) AS term_key, r.seq FROM changes r WHERE op = 'remove'),
    lives AS (
      SELECT project_id, term_key, arg_min(entry_id, seq) AS owner, min(seq) AS born, 0 AS life FROM puts GROUP BY ALL
      UNION ALL
      SELECT l.project_id, l.term_key, n.entry_id, n.seq, l.life + 1
      FROM lives l,
        LATERAL (SELECT min(r.seq) AS died FROM removals r WHERE r.project_id = l.project_id AND r.term_key = l.term_key
                  AND r.entry_id = l.owner AND r.seq > l.born) d,
        LATERAL (SELECT p.entry_id, p.seq FROM puts p WHERE p.project_id = l.project_id AND p.term_key = l.term_key
                  AND p.seq > d.died ORDER BY p.seq LIMIT 1) n
      WHERE d.died IS NOT NULL),
    last_life AS (SELECT project_id, term_key, arg_max(owner, life) AS owner, max(born) AS born FROM lives GROUP BY ALL),
    living AS (SELECT * FROM last_life l WHERE NOT EXISTS (SELECT 1 FROM removals r WHERE r.project_id = l.project_id
        AND r.term_key = l.term_key AND r.entry_id = l.owner AND r.seq > l.born)),
    resets AS (SELECT l.project_id, l.term_key, l.owner, max(p.seq) AS reset, arg_max(p.source_term, p.seq) AS kept_term
       FROM living l JOIN puts p ON p.project_id = l.project_id AND p.term_key = l.term_key AND p.entry_id = l.owner AND p.seq >= l.born
       GROUP BY ALL),
    current_rows AS (SELECT p.*, r.owner, r.kept_term FROM puts p JOIN resets r ON p.project_id = r.project_id AND p.term_key = r.term_key AND p.seq >= r.reset),
    notes AS (SELECT project_id, term_key, arg_max(note, seq) FILTER (note IS NOT NULL) AS note FROM current_rows GROUP BY ALL)
    SELECT project_id, owner AS entry_id, kept_term AS source_term, lang, arg_max(translation, seq) AS translation, any_value(note) AS note
    FROM (SELECT c.project_id, c.term_key, c.owner, c.kept_term, c.lang, c.translation, c.seq, n.note
          FROM current_rows c JOIN notes n ON n.project_id = c.project_id AND n.term_key = c.term_key)
    GROUP BY project_id, owner, kept_term, lang""",
)
def _(v):
    changes = glossary_changes(v)
    empty = changes.select("project_id", "entry_id", "source_term", "lang", "translation", "note").where(F.lit(False))
    return glossary.upsert_glossary(empty, changes)


RAW_CODES = """(['zh_hant', 'EN-us', 'ja', 'x--y', 'zh-HANT-hk', 'sr_latn_rs', 'auto', ' fr_ca '])"""


@query(
    "normalize_language_codes",
    f"""WITH raw AS (SELECT {RAW_CODES}[item_id % 8 + 1] AS code FROM benchmark)
    SELECT code, CASE code WHEN 'zh_hant' THEN 'zh-Hant' WHEN 'EN-us' THEN 'en-US' WHEN 'ja' THEN 'ja' WHEN 'zh-HANT-hk' THEN 'zh-Hant-HK'
       WHEN 'sr_latn_rs' THEN 'sr-Latn-RS' WHEN 'auto' THEN 'auto' WHEN ' fr_ca ' THEN 'fr-CA' END AS tag, count(*) AS uses
    FROM raw GROUP BY code""",
)
def _(v):
    codes = F.array(
        *[F.lit(c) for c in ("zh_hant", "EN-us", "ja", "x--y", "zh-HANT-hk", "sr_latn_rs", "auto", " fr_ca ")]
    )
    raw = v.raw("benchmark").select(F.get(codes, (F.col("item_id") % 8).cast("int")).alias("code"))
    return raw.groupBy("code").agg(F.count(F.lit(1)).alias("uses")).withColumn("tag", normalize_tag(F.col("code")))


@query(
    "resolve_target_language",
    f"""WITH asked AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN ' ja-JP ' ELSE 'Auto' END AS code,
       CASE doc_id % 7 WHEN 0 THEN 'zh' WHEN 1 THEN 'zh_TW' WHEN 2 THEN 'zh-Hant-CN' WHEN 3 THEN 'zh-CN' WHEN 4 THEN 'zh-Hans-TW'
          ELSE lang || '_' || upper(lang) END AS preferred FROM documents)
    SELECT doc_id, CASE WHEN lower(trim(code)) <> 'auto' THEN trim(code)
       WHEN preferred IN ('zh-CN', 'zh-Hans-TW') THEN 'zh-Hans' WHEN preferred LIKE 'zh%' THEN 'zh-Hant'
       ELSE CASE split_part(preferred, '_', 1) {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in DEFAULT_LOCALES.items())} ELSE 'en-US' END END AS target
    FROM asked""",
)
def _(v):
    doc = F.col("doc_id")
    preferred = F.concat("lang", F.lit("_"), F.upper("lang"))
    for i, code in enumerate(("zh", "zh_TW", "zh-Hant-CN", "zh-CN", "zh-Hans-TW")):
        preferred = F.when(doc % 7 == i, F.lit(code)).otherwise(preferred)
    code = F.when(doc % 5 == 0, " ja-JP ").otherwise("Auto")
    return v.raw("documents").select("doc_id", resolve_target(code, preferred).alias("target"))


@query(
    "qa_check",
    rf"""WITH {TERMS_SQL}, judged AS (SELECT x.*, ((page_id + ord) % 10)::DOUBLE / 10 AS c, trim(translated_text) AS tr FROM fx_texts x),
    wrong AS (SELECT DISTINCT j.page_id, j.region_id FROM judged j JOIN terms t ON t.project_id = j.project_id
       AND contains(lower(j.source_text), lower(t.source_term)) AND NOT contains(lower(j.tr), lower(t.preferred_translation)))
    SELECT j.page_id, j.region_id, concat_ws(',',
       CASE WHEN length(tr) > greatest(1, length(source_text)) * 1.8::DOUBLE THEN 'excessiveLength' END,
       CASE WHEN w.region_id IS NOT NULL THEN 'glossaryMismatch' END,
       CASE WHEN tr = '' THEN 'missingTranslation' END, CASE WHEN c < 0.65 THEN 'modelUncertain' END,
       CASE WHEN regexp_extract_all(source_text, '\p{{Nd}}+(?:[.,]\p{{Nd}}+)*') <> regexp_extract_all(tr, '\p{{Nd}}+(?:[.,]\p{{Nd}}+)*') THEN 'numberMismatch' END) AS qa_flags
    FROM judged j LEFT JOIN wrong w ON w.page_id = j.page_id AND w.region_id = j.region_id""",
    ("fx_texts", "fx_glossary"),
)
def _(v):
    return flagged_texts(v).select("page_id", "region_id", F.array_join("qa_flags", ",").alias("qa_flags"))


def flagged_texts(v):
    texts = v.texts().withColumn("translation_confidence", ((F.col("page_id") + F.col("ord")) % 10).cast("double") / 10)
    return quality.qa_check(texts, v.glossary(), "zh-Hant")


REGION_FLAGS_SQL = r"""
flagged AS (SELECT page_id, page_id % 50 AS project_id, region_id, list_filter([
   CASE WHEN length(trim(translated_text)) > greatest(1, length(source_text)) * 1.35::DOUBLE THEN 'excessiveLength' END,
   CASE WHEN trim(translated_text) = '' THEN 'missingTranslation' END,
   CASE WHEN confidence < 0.65 THEN 'modelUncertain' END,
   CASE WHEN regexp_extract_all(source_text, '[0-9]+') <> regexp_extract_all(translated_text, '[0-9]+') THEN 'numberMismatch' END],
   lambda f: f IS NOT NULL) AS flags FROM fx_regions)
"""


def flagged_regions(v):
    regions = v.regions().withColumns(
        {"project_id": F.col("page_id") % 50, "translation_confidence": F.col("confidence")}
    )
    return quality.qa_check(regions, None, "en", "compact")


@query(
    "qa_summary",
    f"""WITH {REGION_FLAGS_SQL}, each AS (SELECT project_id, unnest(flags) AS flag FROM flagged)
    SELECT flag, project_id, count(*) AS regions, 0::TINYINT AS all_projects FROM each GROUP BY flag, project_id
    UNION ALL SELECT flag, NULL, count(*), 1 FROM each GROUP BY flag""",
    ("fx_regions",),
)
def _(v):
    return quality.qa_summary(flagged_regions(v))


@query(
    "qa_warning_share",
    f"""WITH {REGION_FLAGS_SQL}, by_page AS (SELECT project_id, page_id, bool_or(len(flags) > 0) AS warned FROM flagged GROUP BY ALL)
    SELECT project_id, count(*) AS pages, count(*) FILTER (warned) AS warned_pages,
      round(count(*) FILTER (warned)::DOUBLE / count(*), 6) AS share FROM by_page GROUP BY project_id""",
    ("fx_regions",),
)
def _(v):
    return quality.warning_share(flagged_regions(v)).withColumn("share", F.round("share", 6))


@query(
    "apply_translations",
    """WITH items AS (SELECT region_id, CASE WHEN ord % 3 <> 0 THEN ' *' || source_text || ' ' END AS display,
        CASE WHEN ord % 4 <> 0 THEN source_text ELSE ' ' END AS translated, CASE WHEN ord % 2 = 0 THEN lower(source_text) ELSE '' END AS literal
      FROM fx_texts WHERE ord % 5 <> 4),
    usable AS (SELECT region_id, nullif(trim(coalesce(display, translated), E' \\n'), '') AS d, nullif(trim(literal, E' \\n'), '') AS l FROM items)
    SELECT t.page_id, t.region_id, coalesce(d, translated_text) AS translated_text,
      CASE WHEN d IS NOT NULL THEN coalesce(l, d) END AS literal_text,
      CASE WHEN d IS NOT NULL THEN t.speaker || '!' ELSE t.speaker END AS speaker,
      CASE WHEN d IS NOT NULL THEN least(greatest((t.ord::DOUBLE - 1) / 4, 0.0::DOUBLE), 1.0::DOUBLE) END AS translation_confidence,
      CASE WHEN d IS NULL THEN 'missingTranslation'
           WHEN trim(source_text, E' \\n') = d THEN 'modelUncertain' ELSE 'modelUncertain,reviewAdjusted' END AS qa_flags
    FROM fx_texts t LEFT JOIN usable u ON u.region_id = t.region_id AND d IS NOT NULL""",
    ("fx_texts",),
)
def _(v):
    texts = v.texts()
    none = F.lit(None).cast("string")
    regions = texts.withColumns(
        {
            "literal_text": none,
            "tone": none,
            "translation_confidence": F.lit(None).cast("double"),
            "qa_flags": F.array().cast("array<string>"),
        }
    )
    ord_ = F.col("ord")
    items = texts.where(ord_ % 5 != 4).select(
        "region_id",
        F.when(ord_ % 2 == 0, F.lower("source_text")).otherwise("").alias("literal"),
        F.when(ord_ % 3 != 0, F.concat(F.lit(" *"), F.col("source_text"), F.lit(" "))).alias("display"),
        F.when(ord_ % 4 != 0, F.col("source_text")).otherwise(" ").alias("translated"),
        F.concat("speaker", F.lit("!")).alias("speaker"),
        F.lit(" ").alias("tone"),
        ((ord_.cast("double") - 1) / 4).alias("confidence"),
        F.array(F.lit("modelUncertain"), F.lit("unknownFlag")).alias("flags"),
    )
    drafts = texts.select("region_id", F.col("source_text").alias("display"))
    return quality.apply_translations(regions, items, drafts).select(
        "page_id", "region_id", "translated_text", "literal_text", "speaker", "translation_confidence",
        F.array_join("qa_flags", ",").alias("qa_flags"),
    )


@query(
    "normalize_script",
    """SELECT region_id, lang, CASE lang WHEN 'zh_Hant' THEN translate(translated_text, 'éèê', 'eee')
        WHEN 'zh-Hans-CN' THEN translate(translated_text, 'aou', 'áóú') ELSE translated_text END AS translated_text
    FROM (SELECT *, (['zh_Hant', 'zh-Hans-CN', 'ja'])[page_id % 3 + 1] AS lang FROM fx_texts)""",
    ("fx_texts",),
)
def _(v):
    pairs = [("zh-hant", a, "e") for a in "éèê"] + [("zh-hans", a, b) for a, b in zip("aou", "áóú")]
    mapping = v.spark.createDataFrame(pairs, "script string, from_char string, to_char string")
    langs = F.array(F.lit("zh_Hant"), F.lit("zh-Hans-CN"), F.lit("ja"))
    texts = v.texts().withColumn("lang", F.get(langs, (F.col("page_id") % 3).cast("int")))
    return quality.normalize_script(texts, mapping).select("region_id", "lang", "translated_text")


@query(
    "accept_transcripts",
    """SELECT region_id, kind, trim(text, E' \\n') AS text FROM (
      SELECT region_id, (['dialogue', 'caption', 'sfx', 'title'])[ord % 4 + 1] AS kind,
         CASE WHEN page_id % 6 = 0 THEN 'S F X : ' ELSE ' ' END || source_text AS text FROM fx_texts)
    WHERE kind <> 'sfx' AND NOT starts_with(lower(replace(text, ' ', '')), 'sfx:') AND trim(text) <> ''""",
    ("fx_texts",),
)
def _(v):
    kinds = F.array(*[F.lit(k) for k in (" Dialogue", "caption", "sfx", "TITLE")])
    items = v.texts().select(
        "region_id",
        F.get(kinds, (F.col("ord") % 4).cast("int")).alias("kind"),
        F.concat(F.when(F.col("page_id") % 6 == 0, "S F X : ").otherwise(" "), F.col("source_text")).alias("text"),
    )
    return quality.accept_transcripts(items)


@query(
    "plausible_boxes",
    """SELECT region_id FROM fx_regions WHERE CASE WHEN length(replace(source_text, ' ', '')) > 0
      THEN width * height / length(replace(source_text, ' ', '')) <= 0.003 ELSE width > 0 AND height > 0 AND width * height <= 0.15 END""",
    ("fx_regions",),
)
def _(v):
    return quality.plausible_boxes(v.regions(), 0.003, 0.15).select("region_id")


@query(
    "char_overlap",
    r"""WITH p AS (SELECT region_id, lower(regexp_replace(source_text, '\s+', '', 'g')) AS a, lower(regexp_replace(translated_text, '\s+', '', 'g')) AS b FROM fx_texts),
    s AS (SELECT region_id, CASE WHEN length(a) <= length(b) THEN a ELSE b END AS short, CASE WHEN length(a) <= length(b) THEN b ELSE a END AS long FROM p),
    cs AS (SELECT region_id, ch, count(*) AS n FROM (SELECT region_id, unnest(string_split(short, '')) AS ch FROM s WHERE short <> '') GROUP BY ALL),
    cl AS (SELECT region_id, ch, count(*) AS n FROM (SELECT region_id, unnest(string_split(long, '')) AS ch FROM s WHERE long <> '') GROUP BY ALL),
    shared AS (SELECT region_id, sum(least(cs.n, cl.n)) AS n FROM cs JOIN cl USING (region_id, ch) GROUP BY region_id)
    SELECT region_id, round(coalesce(n, 0)::DOUBLE / greatest(length(short), 1), 6) AS overlap FROM s LEFT JOIN shared USING (region_id)""",
    ("fx_texts",),
)
def _(v):
    return quality.char_overlap(v.texts(), "source_text", "translated_text").select(
        "region_id", F.round("overlap", 6).alias("overlap")
    )


@query(
    "accuracy_report",
    """WITH scored AS (SELECT page, expected = observed AS exact, levenshtein(translate(expected, letters, marks), translate(observed, letters, marks)) AS edits, length(expected) AS chars FROM fx_truth, fx_letters),
    sums AS (SELECT page, count(*) AS lines, count(*) FILTER (exact) AS exact_lines, sum(edits)::BIGINT AS edits, sum(chars)::BIGINT AS characters,
       grouping(page)::INTEGER AS overall FROM scored GROUP BY ROLLUP (page))
    SELECT *, round(edits::DOUBLE / characters, 6) AS cer FROM sums""",
    ("fx_truth", "fx_letters"),
)
def _(v):
    return quality.accuracy_report(v.truth()).withColumn("cer", F.round("cer", 6))


@query(
    "latency_report",
    """WITH numbered AS (SELECT *, row_number() OVER (PARTITION BY model, configuration ORDER BY ts, event_id) AS i,
         count(*) OVER (PARTITION BY model, configuration) AS calls FROM fx_samples)
    SELECT model, configuration, any_value(calls) AS calls, round(median(ms) FILTER (i > least(3, calls - 1)), 6) AS warm_median_ms,
       max(ms) FILTER (i = 1) AS cold_ms FROM numbered GROUP BY model, configuration""",
    ("fx_samples",),
)
def _(v):
    samples = v.samples()
    numbered = number_rows(samples, ["model", "configuration"], [F.col("ts"), F.col("event_id")], "iteration")
    return quality.latency_report(samples, numbered).withColumn("warm_median_ms", F.round("warm_median_ms", 6))


@query(
    "output_delta",
    """WITH o AS (SELECT line_id % 5 AS model, line_id // 5 % 4 AS configuration, t * 8 + class AS position, avg(score) AS value
        FROM fx_scores GROUP BY ALL)
    SELECT a.model, a.configuration, round(max(abs(a.value - b.value)), 6) AS max_delta
    FROM o a JOIN o b ON a.model = b.model AND a.position = b.position AND b.configuration = 0 GROUP BY ALL""",
    ("fx_scores",),
)
def _(v):
    line = F.col("line_id")
    outputs = (
        v.scores()
        .groupBy(
            (line % 5).alias("model"),
            (F.floor(line / 5) % 4).alias("configuration"),
            (F.col("t") * 8 + F.col("class")).alias("position"),
        )
        .agg(F.avg("score").alias("value"))
    )
    return quality.output_delta(outputs, 0).withColumn("max_delta", F.round("max_delta", 6))


@query(
    "device_histogram",
    """SELECT event_type AS model, user_id % 4 AS configuration, count(*) FILTER (event_id % 3 = 0) AS cpu,
      count(*) FILTER (event_id % 3 = 1) AS gpu, count(*) FILTER (event_id % 3 = 2) AS ane FROM events GROUP BY ALL""",
)
def _(v):
    device = F.array(F.lit("cpu"), F.lit("gpu"), F.lit("ane"))[(F.col("event_id") % 3).cast("int")]
    return quality.device_histogram(v.samples().withColumn("device", device), ["cpu", "gpu", "ane"])
