"""Model reply, prompt, translation and region-merging queries."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import functions as F

from inkloom.operators import dedupe, responses
from inkloom.operators.glossary import resolve_glossary
from inkloom.plans.catalog import query
from inkloom.plans.text_queries import TERMS_SQL
from inkloom.plans.views_sql import coverage

PARSED_SQL = """
items AS (SELECT conv_id AS request_id, turn, concat_ws('-', conv_id, turn) AS region_id, text AS translated, (turn % 10)::DOUBLE / 10 AS confidence,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, count(*) OVER (PARTITION BY conv_id) AS total
  FROM conversations WHERE NOT (conv_id % 7 = 0 AND turn = 1)),
parsed AS (SELECT * FROM items WHERE request_id % 11 <> 0 AND (request_id % 5 <> 0 OR (n = 1 AND total > 1)))
"""


@query(
    "parse_responses",
    f"WITH {PARSED_SQL} SELECT request_id, region_id, translated AS translated_text, confidence FROM parsed",
)
def _(v):
    items = responses.parse_responses(v.responses(), v.expected_ids(), usable=responses.USABLE)
    return items.select("request_id", "region_id", F.col("translatedText").alias("translated_text"), "confidence")


@query(
    "response_status",
    f"""WITH {PARSED_SQL}, c AS (SELECT request_id, count(*) AS n FROM parsed GROUP BY request_id)
    SELECT r.request_id, CASE WHEN n > 0 THEN 'parsed' WHEN r.request_id % 11 = 0 THEN 'no answer' ELSE 'unusable' END AS status, coalesce(n, 0) AS rows
    FROM fx_responses r LEFT JOIN c USING (request_id)""",
    ("fx_responses",),
)
def _(v):
    items = responses.parse_responses(v.responses(), v.expected_ids(), usable=responses.USABLE)
    return responses.response_status(v.responses(), items)


@query(
    "response_health",
    rf"""WITH {PARSED_SQL}, sizes AS (SELECT request_id, any_value(total) AS total FROM items GROUP BY request_id)
    SELECT request_id, request_id % 11 <> 0 AND (request_id % 5 <> 0 OR total > 1) AS complete,
      CASE WHEN request_id % 11 = 0 THEN trim(substr(text, 8)) WHEN request_id % 3 = 0 THEN 'two speakers [a]' ELSE trim(text) END AS reasoning,
      CASE WHEN contains(text, '}}') THEN body || repeat(']', greatest(0, (len(body) - len(replace(body, '[', ''))) - (len(body) - len(replace(body, ']', ''))))) ELSE text END AS repaired,
      len(text) > 270 AND (len(text) - len(replace(text, right(text, 90), ''))) / 90 >= 3 AS looping
    FROM (SELECT *, regexp_extract(text, '(?s)^(.*\}})', 1) AS body FROM fx_responses) JOIN sizes USING (request_id)""",
    ("fx_responses",),
)
def _(v):
    return responses.response_health(v.responses()).drop("model", "text")


@query(
    "response_rates",
    f"""WITH {PARSED_SQL}, sizes AS (SELECT request_id, any_value(total) AS total FROM items GROUP BY request_id)
    SELECT model, count(*) AS replies, round(avg((request_id % 11 <> 0 AND (request_id % 5 <> 0 OR total > 1))::INTEGER), 6) AS complete_rate
    FROM fx_responses JOIN sizes USING (request_id) GROUP BY model""",
    ("fx_responses",),
)
def _(v):
    rates = responses.health_rates(responses.response_health(v.responses()))
    return rates.select("model", "replies", F.round("complete_rate", 6).alias("complete_rate"))


def prompt_sql(items: str, task: str, source: str) -> str:
    head = (
        f"{task} into zh-Hant, using only Traditional Chinese characters, no Simplified ones. Reading order: rightToLeft. Length: balanced.\n"
        "Style: no further guide.\n"
        "Answer with one JSON array of objects with id, literalTranslation, displayTranslation, speakerID, tone, "
        "confidence and qaFlags; keep every id and the order.\nTerms:\n"
    ).replace("\n", "' || chr(10) || '")
    return f"""WITH {TERMS_SQL},
    hits AS (SELECT DISTINCT x.page_id, t.source_term, t.preferred_translation FROM fx_texts x JOIN terms t ON t.project_id = x.project_id
       AND contains(strip_accents(lower(x.source_text)), strip_accents(lower(t.source_term)))),
    words AS (SELECT page_id, '[' || string_agg('{{"sourceTerm":' || to_json(source_term) || ',"preferredTranslation":' || to_json(preferred_translation) || '}}', ',' ORDER BY source_term) || ']' AS terms FROM hits GROUP BY page_id),
    spoken AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY ord, region_id) AS n FROM fx_texts WHERE trim(source_text) <> ''),
    asked AS (SELECT page_id, {source} AS batch, count(*) AS regions, '[' || string_agg('{{"index":' || {items} || '}}', ',' ORDER BY n) || ']' AS body FROM spoken GROUP BY ALL)
    SELECT a.page_id, a.batch, a.regions, '{head}' || coalesce(terms, '[]') || chr(10) || 'Regions:' || chr(10) || body AS prompt FROM asked a LEFT JOIN words w ON w.page_id = a.page_id"""


ITEM = """{n} || ',"id":"' || region_id || '","sourceText":' || to_json(source_text) || CASE WHEN translated_text <> '' THEN ',"existingTranslation":' || to_json(translated_text) ELSE '' END
 || ',"approximateCharacterLimit":' || greatest(8, ceil(greatest(length(source_text), 1) * 1.55::DOUBLE)::INTEGER)"""


@query(
    "build_prompts",
    prompt_sql(ITEM.replace("{n}", "n"), "Translate every sourceText", "0::INTEGER"),
    ("fx_texts", "fx_glossary"),
)
def _(v):
    terms = resolve_glossary(v.texts(), v.glossary(), "zh-Hant")
    return responses.build_prompts(v.texts(), terms, "zh-Hant")


@query(
    "build_region_prompts",
    prompt_sql(ITEM.replace("{n}", "n"), "Translate every sourceText", "(n - 1)::INTEGER"),
    ("fx_texts", "fx_glossary"),
)
def _(v):
    terms = resolve_glossary(v.texts(), v.glossary(), "zh-Hant")
    return responses.build_prompts(v.texts(), terms, "zh-Hant", single=True)


@query(
    "build_review_prompts",
    prompt_sql(
        ITEM.replace("{n}", "n") + """ || ',"draft":' || to_json('D' || ord)""", "Review and correct the drafts", "0::INTEGER"
    ),
    ("fx_texts", "fx_glossary"),
)
def _(v):
    texts = v.texts()
    terms = resolve_glossary(texts, v.glossary(), "zh-Hant")
    drafts = texts.select("region_id", F.concat(F.lit("D"), "ord").alias("draft"))
    return responses.build_prompts(texts, terms, "zh-Hant", drafts=drafts)


def stub_translator() -> Callable[[str], str]:
    """A deterministic stand-in for a model: prefixes every text and forgets each third region."""

    def answer(prompt: str) -> str:
        asked = json.loads(prompt.split("\nRegions:\n", 1)[1])
        items = [
            {"id": r["id"], "displayTranslation": "T:" + r["sourceText"], "confidence": 0.9, "qaFlags": []}
            for r in asked
            if r["index"] % 3
        ]
        return "<think>short</think>\n" + json.dumps(items, ensure_ascii=False)

    return answer


def failing_once() -> Callable[[str], str]:
    """Fails on every first attempt for even rows and always for rows that end in 7."""

    def answer(prompt: str) -> str:
        text, _, note = prompt.partition("\n")
        if text.endswith("7"):
            raise ValueError("no answer")
        if int(text) % 2 == 0 and not note:
            return ""
        return "ok " + text

    return answer


@query(
    "batch_infer",
    """SELECT o_orderkey AS row_id, CASE WHEN o_orderkey % 10 = 7 THEN 3 WHEN o_orderkey % 2 = 0 THEN 2 ELSE 1 END AS attempt,
      CASE WHEN o_orderkey % 10 <> 7 THEN 'ok ' || o_orderkey END AS text, CASE WHEN o_orderkey % 10 = 7 THEN 'ValueError: no answer' END AS error FROM orders""",
)
def _(v):
    rows = v.raw("orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_orderkey").cast("string").alias("prompt"))
    return responses.batch_infer(rows, failing_once, accept=bool)


@query(
    "translate_pages",
    r"""WITH spoken AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY ord, region_id) AS n FROM fx_texts),
    t AS (SELECT *, n % 3 <> 0 OR (n // 3) % 3 <> 0 AS done, 'T:' || trim(source_text, E' \n') AS tr FROM spoken)
    SELECT page_id, region_id, CASE WHEN done THEN tr ELSE translated_text END AS translated_text,
      CASE WHEN NOT done THEN 'missingTranslation'
           ELSE concat_ws(',', CASE WHEN length(tr) > greatest(1, length(source_text)) * 1.8::DOUBLE THEN 'excessiveLength' END) END AS qa_flags,
      CASE WHEN done THEN 0.9::DOUBLE END AS translation_confidence FROM t""",
    ("fx_texts",),
)
def _(v):
    none = F.lit(None).cast("string")
    regions = v.texts().withColumns(
        {
            "literal_text": none, "tone": none, "translation_confidence": F.lit(None).cast("double"),
            "qa_flags": F.array().cast("array<string>"),
        }
    )
    done = responses.translate_pages(regions, None, stub_translator, "zh-Hant")
    return done.select(
        "page_id", "region_id", "translated_text", F.array_join("qa_flags", ",").alias("qa_flags"), "translation_confidence"
    )


SHARED = "list_sum(list_transform(list_distinct(string_split(k.key, '')), lambda c: least(len(k.key) - len(replace(k.key, c, '')), len(e[1].key) - len(replace(e[1].key, c, '')))))"
MATCH = f"""({coverage('k', '(e[1])')} >= 0.82 OR (k.key <> '' AND k.key = e[1].key AND {coverage('k', '(e[1])')} >= 0.25)
  OR ((NOT k.framed OR NOT e[1].framed) AND len(k.key) >= 4 AND len(e[1].key) >= 4 AND {SHARED}::DOUBLE / least(len(k.key), len(e[1].key)) >= 0.7))"""
FIRST = "(CASE WHEN k.framed <> e[1].framed THEN k.framed ELSE k.width * k.height <= e[1].width * e[1].height END)"


def _pick(name: str) -> str:
    if name == "confidence":
        return "confidence: greatest(k.confidence, e[1].confidence)"
    if name == "direction":
        return f"direction: CASE WHEN (CASE WHEN {FIRST} THEN k.direction ELSE e[1].direction END) = 'automatic' THEN (CASE WHEN {FIRST} THEN e[1].direction ELSE k.direction END) ELSE (CASE WHEN {FIRST} THEN k.direction ELSE e[1].direction END) END"
    return f"{name}: CASE WHEN {FIRST} THEN k.{name} ELSE e[1].{name} END"


DEDUPE_FIELDS = ("id", "x", "y", "width", "height", "key", "framed", "confidence", "direction")


@query(
    "dedupe_regions",
    f"""WITH r AS (SELECT page_id, ord, region_id AS id, x, y, width, height, lower(replace(source_text, ' ', '')) AS key, suppkey % 2 = 0 AS framed, confidence,
        CASE WHEN partkey % 3 = 0 THEN 'vertical' ELSE 'automatic' END AS direction FROM fx_regions),
    lists AS (SELECT page_id, list({{{', '.join(f'{f}: {f}' for f in DEDUPE_FIELDS)}}} ORDER BY ord, id) AS l FROM r GROUP BY page_id),
    done AS (SELECT page_id, list_reduce(list_transform(l, lambda e: [e]), lambda acc, e:
       CASE WHEN coalesce(list_position(list_transform(acc, lambda k: {MATCH}), true), 0) = 0 THEN list_concat(acc, e)
            ELSE list_transform(acc, lambda k, i: CASE WHEN i = list_position(list_transform(acc, lambda k: {MATCH}), true) THEN {{{', '.join(_pick(f) for f in DEDUPE_FIELDS)}}} ELSE k END) END) AS k FROM lists)
    SELECT page_id, r.id AS region_id, r.framed AS framed, r.confidence AS confidence, r.direction AS direction FROM (SELECT page_id, unnest(k) AS r FROM done)""",
    ("fx_regions",),
)
def _(v):
    regions = v.regions().select(
        "page_id", "region_id", "ord", "x", "y", "width", "height", "source_text", (F.col("suppkey") % 2 == 0).alias("framed"),
        "confidence", F.when(F.col("partkey") % 3 == 0, "vertical").otherwise("automatic").alias("direction"),
    )
    return dedupe.dedupe_regions(regions).select("page_id", "region_id", "framed", "confidence", "direction")
