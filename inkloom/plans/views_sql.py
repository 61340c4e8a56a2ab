"""The adapter views as SQL common table expressions, and small SQL snippets for the oracles."""

from __future__ import annotations

LINE_COLUMNS = """
    l_orderkey AS page_id,
    concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::BIGINT) AS region_id,
    l_linenumber AS ord,
    ((l_partkey * 37) % 70)::DOUBLE / 100 AS x,
    ((l_suppkey * 53) % 70)::DOUBLE / 100 AS y,
    (10 + l_quantity % 21)::DOUBLE / 100 AS width,
    (8 + l_partkey % 23)::DOUBLE / 100 AS height,
    ((l_partkey * 7 + l_linenumber * 13) % 100)::DOUBLE / 100 AS confidence,
    l_suppkey % 4 <> 0 AS mask_complete,
    l_partkey AS partkey, l_suppkey AS suppkey
"""

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "fx_pages": ((), """
        SELECT o_orderkey AS page_id, o_custkey % 50 AS project_id,
               'Page ' || (o_orderkey % 997) AS title,
               'ch' || (o_orderkey % 20) || '/p' || (o_orderkey % 137) || '-' || o_orderkey || '.png' AS rel_path,
               (800 + 100 * (o_orderkey % 5))::INTEGER AS pixel_width,
               (1200 + 100 * (o_orderkey % 7))::INTEGER AS pixel_height
        FROM orders"""),
    "fx_artifacts": ((), """
        SELECT page_id, kind, modified_at FROM (
          SELECT o_orderkey AS page_id, 'mask' AS kind, o_orderdate + to_hours((o_orderkey * 1 % 48)::INTEGER) AS modified_at
          FROM orders WHERE o_orderpriority <> '5-LOW'
          UNION ALL SELECT o_orderkey, 'background', o_orderdate + to_hours((o_orderkey * 3 % 48)::INTEGER)
          FROM orders WHERE o_orderpriority <> '5-LOW' AND o_orderkey % 11 <> 0
          UNION ALL SELECT o_orderkey, 'preview', o_orderdate + to_hours((o_orderkey * 5 % 48)::INTEGER)
          FROM orders WHERE o_orderstatus IN ('F', 'P')
          UNION ALL SELECT o_orderkey, 'output', o_orderdate + to_hours((o_orderkey * 7 % 48)::INTEGER)
          FROM orders WHERE o_orderstatus = 'F')"""),
    "fx_boxes": ((), f"SELECT {LINE_COLUMNS} FROM lineitem"),
    "fx_regions": (("fx_boxes",), """
        SELECT b.*, CASE WHEN ord = 7 THEN '' ELSE p_name END AS source_text,
               CASE WHEN partkey % 9 = 0 THEN ''
                    ELSE upper(p_name) || CASE WHEN suppkey % 10 = 0 THEN ' 12' ELSE '' END END AS translated_text
        FROM fx_boxes b JOIN part ON p_partkey = partkey"""),
    "fx_detections": (("fx_boxes",), """
        SELECT page_id, 'd' || region_id AS det_id, ord, least(x + 0.03::DOUBLE, 1.0::DOUBLE) AS x,
               greatest(y - 0.02::DOUBLE, 0.0::DOUBLE) AS y, width, height, confidence
        FROM fx_boxes WHERE suppkey % 3 = 0"""),
    "fx_texts": ((), """
        SELECT a.conv_id AS page_id, a.conv_id % 4 AS project_id, concat_ws('-', a.conv_id, a.turn) AS region_id,
               a.turn AS ord, a.text AS source_text, coalesce(b.text, '') AS translated_text, a.role AS speaker
        FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1"""),
    "fx_pairs": ((), """
        SELECT item_id, pos, concat_ws(' ', w[2 * pos + 1], w[2 * pos + 2]) AS source_term
        FROM (SELECT item_id, w, unnest(range(0, (len(w) + 1) // 2)) AS pos FROM (SELECT item_id, string_split(text, ' ') AS w FROM benchmark))"""),
    "fx_glossary": (("fx_pairs",), """
        SELECT item_id % 4 AS project_id, item_id * 100000 + pos AS entry_id, source_term, lang, translation FROM (
          SELECT item_id, pos, source_term, (['zh-Hant', 'zh', 'en', 'ja'])[item_id % 4 + 1] AS lang, 'to ' || source_term AS translation FROM fx_pairs
          UNION ALL
          SELECT item_id, pos, source_term, 'zh', source_term || '_zh' FROM fx_pairs WHERE item_id % 3 = 0)"""),
    "fx_document_texts": ((), """
        SELECT doc_id AS page_id, doc_id % 4 AS project_id, doc_id::VARCHAR AS region_id, text AS source_text
        FROM documents"""),
    "fx_truth": ((), r"""
        SELECT page, doc_id, line_no, expected,
               CASE line_no % 3 WHEN 0 THEN replace(expected, 'e', 'c')
                                WHEN 1 THEN substr(expected, 1, length(expected) - 1)
                                ELSE expected END AS observed
        FROM (SELECT source AS page, doc_id, (line_no - 1)::INTEGER AS line_no, trim(line) AS expected
              FROM (SELECT source, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS line_no
                    FROM (SELECT source, doc_id,
                                 regexp_extract_all(text, '[^\n]{1,80}') AS lines
                          FROM documents))
              WHERE trim(line) <> '')"""),
    # DuckDB counts edits in bytes: every other letter of the corpus gets a one-byte mark of its own
    "fx_letters": ((), """
        SELECT string_agg(c, '' ORDER BY c) AS letters, (SELECT string_agg(chr(n::INTEGER), '' ORDER BY n) FROM range(1, 32) t(n) WHERE n <> 10) AS marks
        FROM (SELECT DISTINCT unnest(string_split(text, '')) AS c FROM documents) WHERE unicode(c) > 127"""),
    "fx_scores": ((), """
        SELECT line_id, ((pos - 1) // 8)::INTEGER AS t, ((pos - 1) % 8)::INTEGER AS class, score::DOUBLE AS score
        FROM (SELECT vec_id AS line_id, unnest(embedding) AS score, generate_subscripts(embedding, 1) AS pos
              FROM embeddings)"""),
    "fx_cells": ((), """
        SELECT DISTINCT l_suppkey AS group_id, l_linenumber::BIGINT AS y, l_partkey % 60 AS x FROM lineitem"""),
    "fx_components": (("fx_boxes",), """
        SELECT *, floor((w * h)::DOUBLE * (1 + partkey % 9) / 10)::BIGINT AS area FROM (
          SELECT page_id, 'k' || region_id AS component_id, (partkey * 37) % 70 * 10 AS min_x,
                 (suppkey * 53) % 70 * 10 AS min_y, round(width * 1000)::BIGINT AS w, round(height * 1000)::BIGINT AS h,
                 partkey, suppkey FROM fx_boxes)"""),
    "fx_lines": (("fx_boxes",), """
        SELECT page_id AS balloon_id, region_id AS line_id, ord, x, y,
               CASE WHEN partkey % 2 = 0 THEN width / 4 ELSE width END AS width,
               CASE WHEN partkey % 2 = 0 THEN height ELSE height / 4 END AS height, confidence
        FROM fx_boxes"""),
    "fx_responses": ((), r"""
        SELECT conv_id AS request_id, 'm' || (conv_id % 3) AS model,
               CASE WHEN conv_id % 11 = 0 THEN '<think>checking names '
                    WHEN conv_id % 3 = 0 THEN '<think>two speakers [a]</think>' || chr(10)
                    ELSE 'Here is the result: ' END
               || CASE WHEN conv_id % 5 = 0 THEN substr(body, 1, length(body) - 10) ELSE body END AS text
        FROM (SELECT conv_id, '[' || string_agg('{"id":"' || conv_id || '-' || turn || '","translatedText":"'
                     || replace(replace(replace(text, '\', '\\'), '"', '\"'), chr(10), '\n')
                     || '","confidence":0.' || (turn % 10) || '}', ',' ORDER BY turn) || ']' AS body
              FROM conversations WHERE NOT (conv_id % 7 = 0 AND turn = 1) GROUP BY conv_id)"""),
    "fx_expected": ((), """
        SELECT conv_id AS request_id, concat_ws('-', conv_id, turn) AS region_id FROM conversations"""),
    "fx_events": ((), """
        SELECT event_id, ts, user_id AS job_id, event_id % 500 AS page_id,
               CASE event_type WHEN 'signup' THEN 'started' WHEN 'view' THEN 'activity' WHEN 'click' THEN 'progress'
                    WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' END AS kind,
               regexp_extract(props, '[0-9]+', 0)::INTEGER AS k, value
        FROM events"""),
    "fx_edits": (("fx_boxes",), """
        SELECT region_id, page_id, event_id AS seq,
               CASE WHEN event_type IN ('signup', 'purchase') THEN 's' || (k % 5) END AS source_text,
               CASE WHEN event_type IN ('view', 'purchase') THEN 't' || (k % 5) END AS translated_text,
               CASE WHEN event_type = 'click' THEN k::DOUBLE / 100 END AS new_x,
               event_type = 'error' AS clear_font_size
        FROM (SELECT event_id, user_id, (1 + event_id % 7)::INTEGER AS ord, event_type,
                     regexp_extract(props, '[0-9]+', 0)::INTEGER AS k FROM events) e
        JOIN fx_boxes b ON b.page_id = e.user_id AND b.ord = e.ord"""),
    "fx_samples": ((), """
        SELECT event_type AS model, user_id % 4 AS configuration, ts, event_id, value AS ms FROM events"""),
}


def with_views(body: str, *names: str) -> str:
    """``body`` preceded by the named views and the views they need."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in VIEWS[name][0]:
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    parts = [f"{name} AS ({VIEWS[name][1]})" for name in ordered]
    body = body.strip()
    if not parts:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ",\n".join(parts) + ",\n" + body[15:]
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(parts) + ",\n" + body[5:]
    return "WITH " + ",\n".join(parts) + "\n" + body


def overlap_area(a: str, b: str) -> str:
    return (
        f"(greatest(least({a}.x + {a}.width, {b}.x + {b}.width, 1.0::DOUBLE) - greatest({a}.x, {b}.x, 0.0::DOUBLE), 0.0::DOUBLE)"
        f" * greatest(least({a}.y + {a}.height, {b}.y + {b}.height, 1.0::DOUBLE) - greatest({a}.y, {b}.y, 0.0::DOUBLE), 0.0::DOUBLE))"
    )


def area(a: str) -> str:
    return f"({a}.width * {a}.height)"


def coverage(a: str, b: str) -> str:
    """Shared area over the smaller area; both areas are positive in the views."""
    return f"({overlap_area(a, b)} / least({area(a)}, {area(b)}))"


def iou(a: str, b: str) -> str:
    return f"({overlap_area(a, b)} / ({area(a)} + {area(b)} - {overlap_area(a, b)}))"


def r6(expression: str) -> str:
    return f"round({expression}, 6)"
