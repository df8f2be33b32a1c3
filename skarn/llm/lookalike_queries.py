"""Problem 7: texts that look alike but are made of other characters."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.llm.lookalike import LOOKALIKE_HYPHENS, LOOKALIKE_LETTERS, lookalike_classes, lookalike_pairs, normalized
from skarn.plans.tables import spread, table


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every two documents whose texts look the same but are not equal."""
    return lookalike_pairs(spread(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id"), "doc_id", "text").select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"))


def p7_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's text in its one form."""
    return normalized(spread(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id"), "doc_id", "text")


def p7_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class membership of every document that looks like a different one."""
    rows = lookalike_classes(spread(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id"), "doc_id", "text")
    return rows.select(F.col("id").alias("doc_id"), F.hex("look").alias("class_id"), F.hex("raw").alias("text_id"))


QUERIES = {"p7_found": p7_found, "p7_normalized": p7_normalized, "p7_classes": p7_classes}


# What the SQL folds, told by code points and by Unicode's own compatibility forms, without the operator's tables of segments.
_BLANKS = [0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]
_WIDTHLESS = [0xAD, 0x34F, 0x61C, 0x180E, 0x200B, 0x200C, 0x200E, 0x200F, *range(0x2060, 0x2065), *range(0x206A, 0x2070), *range(0xFE00, 0xFE10), 0xFEFF, *range(0xFFF9, 0xFFFC)]
_OTHER_WIDTHS = [*range(0xFF01, 0xFFA0), *range(0xFFA1, 0xFFDD), *range(0xFFE0, 0xFFE7)]
_JOINED = [0x132, 0x133, 0x13F, 0x140, 0x149, *range(0x1C4, 0x1CD), *range(0x1F1, 0x1F4), *range(0x2160, 0x2180), *range(0xFB00, 0xFB07), *range(0xFB50, 0xFBB2), *range(0xFE80, 0xFEFD)]


def _sql() -> str:
    """The same pairs by plain SQL: single characters by one translate(), joined ones by replace(), canonical composition at the end."""
    single = {chr(o): " " for o in _BLANKS} | LOOKALIKE_LETTERS | LOOKALIKE_HYPHENS
    several = {}
    for o in _OTHER_WIDTHS + _JOINED:
        to = unicodedata.normalize("NFKC", chr(o))
        to = "".join(LOOKALIKE_LETTERS.get(c, c) for c in to)
        (single if len(to) == 1 else several)[chr(o)] = to
    # letters with an accent whose base looks like another
    for o in (*range(0x370, 0x530), *range(0x1F00, 0x2000)):
        first, *marks = unicodedata.normalize("NFD", chr(o))
        if marks and first in LOOKALIKE_LETTERS:
            several[chr(o)] = LOOKALIKE_LETTERS[first] + "".join(marks)
    gone = "".join(map(chr, _WIDTHLESS)) + "\u200d"
    quoted = lambda text: text.replace("'", "''")
    text = "regexp_replace(text, '([\\x{1F000}-\\x{1FAFF}])\\x{200D}([\\x{1F000}-\\x{1FAFF}])', '\\1\ue000\\2', 'g')"
    for ch, to in several.items():
        text = f"replace({text}, '{ch}', '{quoted(to)}')"
    text = f"translate(nfc_normalize(translate({text}, '{gone}', '')), '{''.join(single)}', '{quoted(''.join(single.values()))}')"
    return f"""
WITH f AS (SELECT doc_id, text, nfc_normalize(replace({text}, '\ue000', '\u200d')) AS form FROM documents WHERE text IS NOT NULL),
g AS (SELECT * FROM f WHERE regexp_matches(form, '[\\p{{L}}\\p{{N}}]'))
SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM g a JOIN g b ON a.form = b.form AND a.doc_id < b.doc_id WHERE a.text <> b.text"""


SQL = {"p7_found": _sql()}
