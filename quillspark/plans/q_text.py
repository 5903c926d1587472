"""Text-column queries over whole documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import textops as TX
from ..sources.tables import table
from .registry import register


def _re(p: str) -> str:
    return p.replace("'", "''")


@register("mask_pii", f"""
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text,
         '{_re(TX.EMAIL)}', '{TX.EMAIL_MASK}', 'g'),
         '{_re(TX.PHONE)}', '{TX.PHONE_MASK}', 'g'),
         '{_re(TX.CARD)}', '{TX.CARD_MASK}', 'g') AS masked
FROM documents""")
def q_mask_pii(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", TX.mask_pii(F.col("text")).alias("masked"))


@register("extract_json", r"""
WITH b AS (SELECT event_id, regexp_extract(props, '(?s)\{.*\}', 0) AS blk FROM events),
c AS (SELECT event_id, regexp_replace(regexp_replace(regexp_replace(blk, '//[^\n]*', '', 'g'), ',\s*\}', '}', 'g'),
                                      ',\s*\]', ']', 'g') AS js FROM b)
SELECT event_id, CASE WHEN js <> '' THEN js END AS json_text, json_extract_string(CASE WHEN js <> '' THEN js END, '$.k') AS k
FROM c""")
def q_extract_json(spark, sf):
    e = table(spark, sf, "events")
    js = TX.extract_json_text(F.col("props"))
    return e.select("event_id", js.alias("json_text"), F.get_json_object(js, "$.k").alias("k"))


@register("extract_action", r"""
SELECT conv_id, turn, trim(regexp_extract(text, '(?im)^Action:\s*(.+?)$', 1)) AS action,
       trim(regexp_extract(text, '(?ims)^Action Input:\s*(.+?)$', 1)) AS action_input
FROM conversations""")
def q_extract_action(spark, sf):
    c = table(spark, sf, "conversations")
    a, ai = TX.extract_action(F.col("text"))
    return c.select("conv_id", "turn", a.alias("action"), ai.alias("action_input"))


@register("last_turns", """
SELECT conv_id, turn, role, text FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 5
ORDER BY conv_id, turn""")
def q_last_turns(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    return TX.last_turns(c, "conv_id", "turn", 5).orderBy("conv_id", "turn")


@register("conversation_log", """
SELECT conv_id, turn, role, length(text) AS n_chars FROM conversations
ORDER BY conv_id, turn""")
def q_conversation_log(spark, sf):
    c = table(spark, sf, "conversations")
    return (c.select("conv_id", "turn", "role", F.length("text").cast("long").alias("n_chars"))
             .orderBy("conv_id", "turn"))


def _prio_sql():
    hi = " OR ".join(f"contains(lower(text), '{w}')" for w in TX.HIGH_WORDS)
    me = " OR ".join(f"contains(lower(text), '{w}')" for w in TX.MEDIUM_WORDS)
    return f"SELECT doc_id, CASE WHEN {hi} THEN 'high' WHEN {me} THEN 'medium' ELSE 'low' END AS priority FROM documents"


@register("text_priority", _prio_sql())
def q_text_priority(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", TX.text_priority(F.col("text")).alias("priority"))


# Replies as a model writes them, derived from every turn: contacts, a JSON block with a comment and trailing commas, an action.
_REPLIES = """replies AS (
  SELECT conv_id, turn,
         text || ' call 555-' || lpad(CAST(length(text) % 1000 AS VARCHAR), 3, '0') || CASE WHEN turn % 2 = 0 THEN '-' ELSE '.' END
              || lpad(CAST(turn * 37 % 10000 AS VARCHAR), 4, '0') || ', write user' || turn || '@example.com, card 4111-1111 1111-'
              || lpad(CAST(length(text) % 10000 AS VARCHAR), 4, '0') AS contacts,
         text || ' {"k": ' || turn || ', // of this turn' || chr(10) || '"tags": ["a", "b", ], "n": {"size": ' || length(text) || ',' || chr(10) || ' }, } done' AS json,
         text || chr(10) || 'action: tool_' || turn || ' ' || chr(10) || 'Action Input:  ' || length(text) || ' rows' || chr(10) || 'end' AS steps
  FROM conversations WHERE text IS NOT NULL)"""


def _replies(spark, sf):
    c = table(spark, sf, "conversations").filter(F.col("text").isNotNull())
    text, turn, size = F.col("text"), F.col("turn").cast("string"), F.length("text")
    digits = lambda n, width: F.lpad(n.cast("string"), width, "0")
    contacts = F.concat(text, F.lit(" call 555-"), digits(size % 1000, 3), F.when(F.col("turn") % 2 == 0, "-").otherwise("."),
                        digits(F.col("turn") * 37 % 10000, 4), F.lit(", write user"), turn, F.lit("@example.com, card 4111-1111 1111-"), digits(size % 10000, 4))
    json = F.concat(text, F.lit(' {"k": '), turn, F.lit(', // of this turn\n"tags": ["a", "b", ], "n": {"size": '), size.cast("string"), F.lit(",\n }, } done"))
    steps = F.concat(text, F.lit("\naction: tool_"), turn, F.lit(" \nAction Input:  "), size.cast("string"), F.lit(" rows\nend"))
    return c.select("conv_id", "turn", contacts.alias("contacts"), json.alias("json"), steps.alias("steps"))


@register("mask_pii_replies", f"""WITH {_REPLIES}
SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(contacts,
         '{_re(TX.EMAIL)}', '{TX.EMAIL_MASK}', 'g'),
         '{_re(TX.PHONE)}', '{TX.PHONE_MASK}', 'g'),
         '{_re(TX.CARD)}', '{TX.CARD_MASK}', 'g') AS masked
FROM replies""")
def q_mask_pii_replies(spark, sf):
    return _replies(spark, sf).select("conv_id", "turn", TX.mask_pii(F.col("contacts")).alias("masked"))


@register("extract_json_replies", f"WITH {_REPLIES}" + r""",
b AS (SELECT conv_id, turn, regexp_extract(json, '(?s)\{.*\}', 0) AS blk FROM replies),
c AS (SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(blk, '//[^\n]*', '', 'g'), ',\s*\}', '}', 'g'),
                                           ',\s*\]', ']', 'g') AS js FROM b)
SELECT conv_id, turn, json_extract_string(js, '$.k') AS k, json_extract_string(js, '$.tags[1]') AS second_tag,
       json_extract_string(js, '$.n.size') AS size FROM c""")
def q_extract_json_replies(spark, sf):
    js = TX.extract_json_text(F.col("json"))
    part = lambda path: F.get_json_object(js, path)
    return _replies(spark, sf).select("conv_id", "turn", part("$.k").alias("k"), part("$.tags[1]").alias("second_tag"), part("$.n.size").alias("size"))


@register("extract_action_replies", f"""WITH {_REPLIES}
SELECT conv_id, turn, 'tool_' || turn AS action,
       contains(steps, 'Action Input:') AS has_input,
       trim(regexp_extract(steps, '(?im)^Action Input:\\s*(.+?)$', 1)) AS action_input
FROM replies""")
def q_extract_action_replies(spark, sf):
    a, given = TX.extract_action(F.col("steps"))
    return _replies(spark, sf).select("conv_id", "turn", a.alias("action"), (given != "").alias("has_input"), given.alias("action_input"))
