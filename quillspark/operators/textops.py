"""Text column jobs.

All of these are built-in regex / string functions evaluated JVM-side over
whole texts.  Java patterns use ``(?d)`` (UNIX_LINES) so that ``^``/``$``
match at ``\\n`` only, like Python's ``re.MULTILINE``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values that must equal the reference: masking patterns and masks, in order.
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
EMAIL_MASK = "***@***.***"
PHONE = r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b"
PHONE_MASK = "***-***-****"
CARD = r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b"
CARD_MASK = "****-****-****-****"

# Fixed values that must equal the reference: recommendation priority words.
HIGH_WORDS = ["critical", "urgent", "risk", "alert", "immediately", "reduce", "loss"]
MEDIUM_WORDS = ["improve", "increase", "focus", "optimize", "review", "monitor"]

# Fixed values that must equal the reference: what is cut out of a JSON block, and the lines of an action.
COMMENT, COMMA_BRACE, COMMA_BRACKET = r"(?d)//.*", r",\s*\}", r",\s*\]"
ACTION, ACTION_INPUT = r"(?imd)^Action:\s*(.+?)$", r"(?imsd)^Action Input:\s*(.+?)$"


def mask_pii(c: Column) -> Column:
    c = F.regexp_replace(c, EMAIL, EMAIL_MASK)
    c = F.regexp_replace(c, PHONE, PHONE_MASK)
    return F.regexp_replace(c, CARD, CARD_MASK)


def extract_json_text(c: Column) -> Column:
    """Widest ``{...}`` block with ``//`` comments and trailing commas removed."""
    block = F.regexp_extract(c, r"(?s)\{.*\}", 0)
    block = F.regexp_replace(block, COMMENT, "")
    block = F.regexp_replace(block, COMMA_BRACE, "}")
    block = F.regexp_replace(block, COMMA_BRACKET, "]")
    return F.when(block != "", block)


def extract_action(c: Column) -> tuple[Column, Column]:
    action = F.regexp_extract(c, ACTION, 1)
    action_input = F.regexp_extract(c, ACTION_INPUT, 1)
    return F.btrim(action), F.btrim(action_input)


def text_priority(c: Column) -> Column:
    low = F.lower(c)
    high = F.lit(False)
    for w in HIGH_WORDS:
        high = high | low.contains(w)
    med = F.lit(False)
    for w in MEDIUM_WORDS:
        med = med | low.contains(w)
    return F.when(high, "high").when(med, "medium").otherwise("low")


def last_turns(df: DataFrame, conv: str, order: str, n: int = 5) -> DataFrame:
    """Newest ``n`` messages per conversation.

    ``row_number() <= n`` lets Spark insert a partial WindowGroupLimit before
    the shuffle, so a huge conversation ships at most n rows per map task.
    """
    w = Window.partitionBy(conv).orderBy(F.col(order).desc())
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")
