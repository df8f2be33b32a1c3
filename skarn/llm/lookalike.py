"""One consistent form for text that looks the same but is made of other characters.

A text is checked first: plain ASCII is stable as it stands. Otherwise only the
unstable segments are isolated (characters that fail the quick check, with the
base letter before them and the marks after them as context), brought to their
canonical form, and spliced into the text, which is otherwise left alone.
"""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.plans.stage import write_stage

# Letters of other scripts and blocks that have the shape of a Latin letter, and what they look like.
LOOKALIKE_LETTERS = {
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ν": "v", "ο": "o", "ϲ": "c", "Ϲ": "C", "ϳ": "j", "Ϳ": "J",
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "У": "Y", "Ѕ": "S", "І": "I", "Ј": "J", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y", "Ӏ": "I", "Ѵ": "V", "Ԍ": "G", "Ӕ": "Æ", "Ә": "Ə",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ѵ": "v", "ү": "y", "ӕ": "æ", "ә": "ə",
    # Armenian, Latin and Cherokee
    "օ": "o", "ո": "n", "ս": "u", "հ": "h", "Տ": "S", "Լ": "L", "Օ": "O", "ɡ": "g", "ɑ": "a", "Ꭺ": "A", "Ꭼ": "E", "Ꭻ": "J", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮯ": "C", "Ꮲ": "P", "Ꮪ": "S", "Ꮓ": "Z", "Ꮮ": "L", "Ꭱ": "R", "Ꭲ": "T", "Ꮩ": "V", "Ꭰ": "D", "Ꮐ": "G", "Ᏼ": "B", "Ꮶ": "K", "Ꭵ": "i", "Ꮢ": "R", "Ꮤ": "W", "Ꮥ": "S", "Ꮷ": "d", "µ": "μ",
    # Coptic
    "Ⲁ": "A", "Ⲃ": "B", "Ⲉ": "E", "Ⲏ": "H", "Ⲓ": "I", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲟ": "O", "ⲟ": "o", "Ⲣ": "P", "ⲣ": "p", "Ⲥ": "C", "ⲥ": "c", "Ⲧ": "T", "Ⲩ": "Y", "Ⲭ": "X",
    # Lisu
    "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L", "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
    # Canadian syllabics
    "ᗅ": "A", "ᗷ": "B", "ᑕ": "C", "ᗪ": "D", "ᖴ": "F", "ᕼ": "H", "ᒍ": "J", "ᒪ": "L", "ᑭ": "P", "ᖇ": "R", "ᑌ": "U", "ᐯ": "V", "᙭": "X", "ᑯ": "d", "ᑲ": "b",
}
# First code points of the mathematical alphabets of plain upright shape (26 capitals, 26 small letters each), and of their digits.
_PLAIN_ALPHABETS, _PLAIN_DIGITS = (0x1D5A0, 0x1D670), (0x1D7E2, 0x1D7F6)
# Blanks that are no space separators, and characters without width that are no format characters.
_MORE_BLANKS, _MORE_WIDTHLESS = {0x2800, 0x3164, 0xFFA0}, {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}
# Hyphens of the shape of the ASCII hyphen.
LOOKALIKE_HYPHENS = {"‐": "-", "‑": "-", "˗": "-", "⁃": "-", "﹣": "-", "֊": "-"}
# Order controls (they have no width but move what is seen) and the joiners that can change it.
_ORDER_CONTROLS = set("‪‫‬‭‮⁦⁧⁨⁩")
#: Those that turn the order to right-to-left; without them, and without such letters, the others move nothing.
_TURNING = set("\u202b\u202e\u2067")
_NON_JOINER, _JOINER = "‌", "‍"
#: Decomposition tags under which a character only differs in width or joining.
_SAME_LOOK_TAGS = {"<wide>", "<narrow>", "<noBreak>", "<small>", "<initial>", "<medial>", "<final>", "<isolated>", "<vertical>"}


def _folded(ch: str) -> str | None:
    """What one character is replaced by; None if it stays as it is."""
    if ch in LOOKALIKE_LETTERS:
        return LOOKALIKE_LETTERS[ch]
    if ch in LOOKALIKE_HYPHENS:
        return "-"
    category, o = unicodedata.category(ch), ord(ch)
    if category == "Zs" or o in _MORE_BLANKS:
        return " "
    if category == "Cf" and ch not in _ORDER_CONTROLS or o in _MORE_WIDTHLESS:
        return ""
    if any(first <= o < first + 52 for first in _PLAIN_ALPHABETS) or any(first <= o < first + 10 for first in _PLAIN_DIGITS):
        return unicodedata.normalize("NFKD", ch)
    tag, *codes = (unicodedata.decomposition(ch) or "-").split()
    joined = tag == "<compat>" and category[0] == "L" and len(codes) > 1 or 0x2160 <= o <= 0x217F
    if tag in _SAME_LOOK_TAGS or joined:
        return "".join(LOOKALIKE_LETTERS.get(c, c) for c in unicodedata.normalize("NFKD", ch))
    return None


def _joins(ch: str) -> bool:
    """Whether a joiner next to this character can be seen: pictographs and scripts with joining letters."""
    o = ord(ch)
    return unicodedata.category(ch) in ("So", "Sk") and o > 0x2000 or o in (0xFE0F, 0x20E3) or 0x0600 <= o <= 0x08FF or 0x0900 <= o <= 0x0DFF or 0x1800 <= o <= 0x18AF


@lru_cache(maxsize=1)
def _tables() -> tuple[dict[int, str], re.Pattern]:
    """The map of replaced characters, and the pattern of unstable segments: a base letter with what follows it."""
    table, unstable = {}, []
    for o in range(0x80, sys.maxunicode + 1):
        ch = chr(o)
        if 0xD800 <= o <= 0xDFFF or unicodedata.category(ch) in ("Cn", "Co"):
            continue
        to = _folded(ch)
        if to is not None:
            table[o] = to
        # "Maybe" and "No" of the quick check: combining marks, and all that canonical composition would change.
        if to is not None or unicodedata.combining(ch) or not unicodedata.is_normalized("NFC", ch) or 0x1160 <= o <= 0x11FF:
            unstable.append(o)
        elif any(c in LOOKALIKE_LETTERS for c in unicodedata.normalize("NFD", ch)):
            unstable.append(o)  # a composed letter whose base is replaced
    ranges: list[list[int]] = []
    for o in unstable:
        if ranges and ranges[-1][1] == o - 1:
            ranges[-1][1] = o
        else:
            ranges.append([o, o])
    marks = "".join(f"{chr(a)}-{chr(b)}" for a, b in ranges)
    return table, re.compile(f"(?:[^{marks}])?[{marks}]+", re.S)


def _moves_nothing(text: str) -> bool:
    """Whether the order controls of a text can't be seen: nothing in it runs from right to left."""
    return not any(c in _TURNING or unicodedata.bidirectional(c) in ("R", "AL", "AN") for c in text)


def _canonical(segment: re.Match) -> str:
    """The canonical form of one unstable segment."""
    table, _ = _tables()
    text = unicodedata.normalize("NFD", segment.group())
    if _JOINER in text or _NON_JOINER in text:
        whole, end = segment.string, segment.end()
        around = text + (whole[end] if end < len(whole) else "")
        kept = []
        for i, ch in enumerate(text):
            seen = ch in (_JOINER, _NON_JOINER) and i > 0 and i + 1 < len(around) and _joins(around[i - 1]) and _joins(around[i + 1])
            kept.append(ch if seen else ch.translate(table))
        text = "".join(kept)
    else:
        text = text.translate(table)
    return unicodedata.normalize("NFC", text)


def look(text: str | None) -> str | None:
    """The one form of all texts that look like this one. Null stays null; ASCII and empty texts stay as they are.

    Folded: full and half width, composed and combining accents, characters without width (joiners stay where
    pictographs or joining scripts are on both sides, order controls where something runs from right to left), all
    blanks of one space's kind, ligatures and presentation forms, Roman numeral signs, plain upright mathematical
    letters, look-alike letters and hyphens. Kept: case, accents, raised and circled digits,
    number of blanks and line breaks, all other marks. Applying it twice changes nothing more.
    """
    if text is None or text.isascii():
        return text
    if not _ORDER_CONTROLS.isdisjoint(text) and _moves_nothing(text):
        text = text.translate({ord(c): None for c in _ORDER_CONTROLS})
    pattern = _tables()[1]
    out = pattern.sub(_canonical, text)
    if not unicodedata.is_normalized("NFC", out):  # a removed character had kept a letter and its mark apart
        out = unicodedata.normalize("NFC", unicodedata.normalize("NFD", out).translate(_tables()[0] if not (_JOINER in out or _NON_JOINER in out) else {}))
    return out


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        plain = pc.string_is_ascii(texts).to_pylist()
        looks, raws, keep = [], [], []
        for i, (t, ascii_only) in enumerate(zip(texts.to_pylist(), plain)):
            if t is None:
                continue
            form = t if ascii_only else look(t)
            if not any(map(str.isalnum, form)):
                continue
            raw = hashlib.md5(t.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()
            raws.append(raw)
            looks.append(raw if form == t else hashlib.md5(form.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest())
            keep.append(i)
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(keep, pa.int32())), pa.array(looks, pa.binary()), pa.array(raws, pa.binary())], ["id", "look", "raw"])


def look_digests(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, look, raw): 128-bit digests of each text's one form and of the text itself. Null texts and texts without a letter or digit are left out; rows of equal id are kept."""
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(_digests, f"id {kind}, look binary, raw binary")


def lookalike_classes(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, look, raw) of the texts that look like another, different text. One look is one class; one raw is one text in it."""
    rows = write_stage(look_digests(docs, key, text), "looks")
    mixed = rows.groupBy("look").agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).where(F.col("lo") != F.col("hi")).select("look")
    return rows.join(mixed, "look", "left_semi").select("id", "look", "raw")


def lookalike_pairs(docs: DataFrame, key: str, text: str, most_copies: int = 64) -> DataFrame:
    """(a, b), a < b: every two ids whose texts look the same but are not equal strings.

    Exact copies are collapsed first: pairs are formed between different texts of one look and then spread over the
    copies of either text. A text with more than ``most_copies`` copies is represented by its least id;
    ``lookalike_classes`` has the membership of all its copies, so no link is lost. Repeated ids count once.
    """
    rows = lookalike_classes(docs, key, text).distinct()
    sized = rows.groupBy("look", "raw").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))
    large = sized.where(F.col("n") > most_copies).select("look", "raw", "rep")
    members = rows.join(large, ["look", "raw"], "left").where(F.col("rep").isNull() | (F.col("id") == F.col("rep"))).select("look", "raw", "id")
    a, b = members.select("look", F.col("raw").alias("raw_a"), F.col("id").alias("a")), members.select("look", F.col("raw").alias("raw_b"), F.col("id").alias("b"))
    return a.join(b, "look").where((F.col("a") < F.col("b")) & (F.col("raw_a") != F.col("raw_b"))).select("a", "b").distinct()


def normalized(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text, changed): each text in its one form. Null stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old = batch.column(1)
            if not old.null_count and pc.all(pc.string_is_ascii(old)).as_py():
                new, changed = old, pa.array([False] * len(old))
            else:
                texts = old.to_pylist()
                forms = [look(t) for t in texts]
                new, changed = pa.array(forms, pa.string()), pa.array([a != b for a, b in zip(texts, forms)])
            yield pa.RecordBatch.from_arrays([batch.column(0), new, changed], [key, text, "changed"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.col(text).cast("string").alias(text)).mapInArrow(run, f"{key} {kind}, {text} string, changed boolean")
