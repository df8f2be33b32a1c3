"""Splitting oversized texts at natural boundaries, and auditing earlier cuts.

Everything is a Spark SQL expression: one bounded-quantifier regular expression
breaks a text into blocks (fenced code, HTML table, pipe table, text run), a
second one consumes each text run up to the limit, its alternatives ordered by
the strength of the boundary they end at, single characters last. Overlap comes
from looking back from each cut with array functions. All repeated groups are
possessive, so that Java's matcher walks long texts in a loop, not recursively.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.plans.skew import ROWS_PER_SALT, hot_keys, replicated, salted

#: New characters a piece may bring, characters it may repeat, least repeat that counts, and the section limit.
PIECE_CHARS, OVERLAP_CHARS, LEAST_OVERLAP, SECTION_CHARS = 500, 100, 30, 4000

_EOL = r"(?:\n|\z)"
_LINE = rf"[^\n]*+{_EOL}"


def _fence(sign: str, group: int) -> str:
    close = rf" {{0,3}}\{group}{sign}*+[ \t\r]*+{_EOL}"
    return rf" {{0,3}}({sign}{{3,}}+){_LINE}(?:(?!{close}){_LINE})*+(?:{close})?+"


def _html_table(depth: int) -> str:
    inner = rf"(?!</?table\b)[\s\S]" + (rf"|{_html_table(depth - 1)}" if depth else "")
    return rf"<table\b(?:{inner})*+(?:</table>|\z)"


_DELIMITER = rf"(?=[^\n]*\|)(?=[^\n]*-)[ \t]*+[|:\- \t\r]++{_EOL}"
_PIPE_START = rf"[^\n|]*+\|[^\n]*+\n{_DELIMITER}"
_PIPE = rf"{_PIPE_START}(?:[^\n|]*+\|{_LINE})*+"
_HTML = rf" {{0,3}}{_html_table(3)}[^\n]*+{_EOL}"
_BLOCK_START = rf"(?: {{0,3}}(?:`{{3,}}|~{{3,}})| {{0,3}}<table\b|{_PIPE_START})"
_RUN = rf"(?:(?!{_BLOCK_START})(?:[^\n]++{_EOL}|\n))++"
#: A whole text as a sequence of blocks; precedence is fence, HTML table, pipe table, text.
BLOCKS = rf"(?i)(?:{_fence('`', 1)}|{_fence('~', 2)}|{_HTML}|{_PIPE}|{_RUN})"
_IS_BLOCK = rf"(?i)\A{_BLOCK_START}"
_UNCLOSED = rf"(?i)\A(?: {{0,3}}(`{{3,}}+){_LINE}(?:(?! {{0,3}}\1`*+[ \t\r]*+{_EOL}){_LINE})*+| {{0,3}}(~{{3,}}+){_LINE}(?:(?! {{0,3}}\2~*+[ \t\r]*+{_EOL}){_LINE})*+)\z"


def _piece_pattern(limit: int) -> str:
    half = max(1, limit // 2)
    return rf"(?s)(?:.{{1,{limit}}}\z|.{{{half},{limit}}}(?<=\n\n)|.{{{half},{limit}}}(?<=\n)|.{{{half},{limit}}}(?<=[.!?。]\s|[。！？])|.{{1,{limit}}}(?<=\s)|.{{1,{limit}}})"


def _sql(pattern: str) -> Column:
    return F.lit(pattern)


def blocks(text: Column) -> Column:
    """array<string> of a text's blocks in order; joined, they are the text. Null gives null, an empty text an empty array."""
    return F.filter(F.regexp_extract_all(text, _sql(BLOCKS), F.lit(0)), lambda b: b != "")


def is_block(part: Column) -> Column:
    """Whether a part from ``blocks`` is code or a table, not text."""
    return part.rlike(_IS_BLOCK)


def is_blank(text: Column) -> Column:
    return ~text.rlike(r"(?U)\S")


def pieces(text: Column, limit: int = PIECE_CHARS, overlap: int = OVERLAP_CHARS) -> Column:
    """array<struct<text, repeated, atomic>>: the pieces of a text.

    A piece brings at most ``limit`` new characters (code points) and begins with at most ``overlap`` characters
    repeated from the end of the piece before it, from the start of a word where there is one. Code blocks and
    tables stay whole, whatever their size, and neither give nor take a repeat. Blank runs give no piece. The new
    parts, joined, are the text without its blank runs and blank rests of runs. Null gives null; a blank text gives no
    pieces.
    """
    least = min(LEAST_OVERLAP, overlap)

    def tail(before: Column) -> Column:
        last = F.right(before, F.lit(overlap))
        return F.when(F.length(before) > overlap, F.regexp_replace(last, rf"(?s)\A\S{{0,{max(0, overlap - least - 1)}}}\s(?=\S)", "")).otherwise(before)

    def cut(run: Column) -> Column:
        new = F.filter(F.regexp_extract_all(run, _sql(_piece_pattern(limit)), F.lit(0)), lambda p: ~is_blank(p))
        before = F.concat(F.array(F.lit("")), F.slice(new, 1, F.greatest(F.size(new) - 1, F.lit(0))))
        back = F.transform(F.slice(before, 1, F.size(new)), tail if overlap else lambda _: F.lit(""))
        return F.zip_with(new, back, lambda p, r: F.struct(F.concat(r, p).alias("text"), F.length(r).alias("repeated"), F.lit(False).alias("atomic")))

    whole = lambda b: F.array(F.struct(b.alias("text"), F.lit(0).alias("repeated"), F.lit(True).alias("atomic")))
    return F.flatten(F.transform(F.filter(blocks(text), lambda b: ~is_blank(b)), lambda b: F.when(is_block(b), whole(b)).otherwise(cut(b))))


def is_one_block(cut: Column) -> Column:
    """Whether ``pieces`` left a text as it is: one code block or table and, but for blanks, nothing else."""
    return F.aggregate(cut, F.lit(0), lambda n, p: n + F.when(p["atomic"], 1).otherwise(2)) == 1


def with_pieces(rows: DataFrame, limit: int = PIECE_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """Rows with the column ``pieces`` of their text. A generator of one row, so that it is made once however often it is read."""
    return rows.select("*", F.inline(F.array(F.struct(pieces(F.col("text"), limit, overlap).alias("pieces")))))


def one_row_per_key(rows: DataFrame, key: str, *columns: str) -> DataFrame:
    """One of the copied rows of each key (the least, so that the choice doesn't depend on the order). Null keys are left out."""
    value = F.struct(*columns)
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(value).alias("_v")).select(key, "_v.*")


def oversized_sections(parents: DataFrame, limit: int = SECTION_CHARS, piece: int = PIECE_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """Sections over the limit with what the splitter makes of them: (parent_id, rel_path, parent_idx, text, pieces).

    A section counts if its text is longer than ``limit`` and the splitter does not leave it as one code block or table.
    Of copied rows one counts; null and empty texts are never over the limit.
    """
    long = parents.where(F.col("parent_id").isNotNull() & (F.length("text") > limit)).select("parent_id", "rel_path", "parent_idx", "text")
    return with_pieces(one_row_per_key(long, "parent_id", "rel_path", "parent_idx", "text"), piece, overlap).where(~is_one_block(F.col("pieces")))


def split_sections(sections: DataFrame) -> DataFrame:
    """One row per piece of sections (parent_id, rel_path, parent_idx, pieces), with chunk_id and child_idx from 0."""
    return sections.select("parent_id", "rel_path", "parent_idx", F.posexplode("pieces").alias("child_idx", "p")).select(
        F.sha1(F.concat_ws("::", "rel_path", F.col("parent_idx").cast("string"), F.col("child_idx").cast("string"))).alias("chunk_id"),
        "parent_id", "rel_path", "parent_idx", "child_idx",
        F.col("p.text").alias("text"), F.col("p.repeated").alias("n_repeated"), F.col("p.atomic").alias("atomic"),
    )


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\A\s+|\s+\z", "")


def _atoms(cut: Column) -> Column:
    """The code blocks and tables among pieces."""
    return F.transform(F.filter(cut, lambda p: p["atomic"]), lambda p: p["text"])


def _part_of_block(text: Column, cut: Column, whole: Column) -> Column:
    """Whether a stored piece holds only a part of a code block or table; ``cut``: what the splitter makes of the piece; ``whole``: the trimmed blocks of its section, null if that is unknown."""
    atoms = _atoms(cut)
    known = F.coalesce(whole, F.array().cast("array<string>"))
    inside = lambda t: F.exists(known, lambda b: (b != t) & F.contains(b, t)) & ~F.array_contains(known, t)
    opened = F.exists(atoms, lambda b: b.rlike(_UNCLOSED) & ~F.array_contains(known, _trimmed(b)))
    tables = F.regexp_count(F.lower(text), F.lit("<table\\b")) != F.regexp_count(F.lower(text), F.lit("</table>"))
    html = tables & ~F.array_contains(known, _trimmed(text)) & ~F.exists(atoms, lambda b: b.rlike(r"(?i)\A[ ]{0,3}(`{3}|~{3})"))
    lost = F.exists(F.filter(blocks(text), lambda b: ~is_block(b)), lambda b: b.rlike(r"(?m)\A(?:[ \t]*\|[^\n]*\|[ \t]*\n){2,}\z")) & whole.isNull()
    return inside(_trimmed(text)) | F.exists(atoms, lambda b: inside(_trimmed(b))) | opened | html | lost


def audit_pieces(children: DataFrame, parents: DataFrame, limit: int = PIECE_CHARS, overlap: int = OVERLAP_CHARS, rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """Pieces of a former run that are wrongly cut: (chunk_id, parent_id, too_long, part, no_repeat, mid_word).

    The splitter cuts both the section, for its code blocks and tables, and the stored piece itself: a piece of more
    than limit and overlap is too long if the splitter would cut it. A piece is compared with each piece of its section whose child_idx is one lower; the two meet in an equi-join on
    (parent_id, child_idx), so one section with very many pieces is spread like any other rows; where pieces meet their
    section's blocks, such a section is salted. Blank and null pieces are never wrong. A piece whose section is unknown is judged by its own text. Of copied rows one counts.
    """
    once = one_row_per_key(children.select("chunk_id", "parent_id", "child_idx", "text"), "chunk_id", "parent_id", "child_idx", "text")
    wanted = children.select("parent_id").distinct()
    texts = one_row_per_key(parents.select("parent_id", "text").join(wanted, "parent_id", "left_semi"), "parent_id", "text")
    block_lists = with_pieces(texts, limit, overlap).select("parent_id", F.transform(_atoms(F.col("pieces")), _trimmed).alias("whole"))
    hot = hot_keys(children.select("parent_id"), ["parent_id"], rows_per_salt)
    solid = once.where(F.col("text").isNotNull() & ~is_blank(F.col("text")))
    judged = (
        with_pieces(salted(solid, hot, ["parent_id"], F.col("chunk_id")), limit + overlap, 0)
        .join(replicated(block_lists, hot, ["parent_id"]), ["parent_id", "salt"], "left")
        .select("chunk_id", "parent_id", "child_idx", "text", is_one_block(F.col("pieces")).alias("one_block"), _part_of_block(F.col("text"), F.col("pieces"), F.col("whole")).alias("part"))
    )
    plain = ~F.col("one_block") & ~F.col("part")
    before = judged.where(plain).select("parent_id", (F.col("child_idx") + 1).alias("child_idx"), F.right("text", F.lit(overlap)).alias("end"), (F.length("text") > overlap).alias("gives"))
    t, end = F.col("text"), F.col("end")
    repeat = F.coalesce(F.get(F.filter(F.sequence(F.lit(overlap), F.lit(1), F.lit(-1)), lambda k: (k <= F.length(end)) & (F.substring(end, -k, k) == F.substring(t, F.lit(1), k))), F.lit(0)), F.lit(0))
    joined = judged.join(before, ["parent_id", "child_idx"], "left").withColumn("k", F.when(plain & end.isNotNull(), repeat))
    word = lambda c: c.rlike(r"(?U)\A\w\z")
    no_repeat = F.col("gives") & (F.col("k") < LEAST_OVERLAP)
    mid_word = word(F.right(end, F.lit(1))) & word(F.substring(t, F.col("k") + 1, F.lit(1)))
    flags = joined.select(
        "chunk_id", "parent_id",
        ((F.length(t) > limit + overlap) & ~F.col("one_block")).alias("too_long"), "part",
        F.coalesce(F.col("k").isNotNull() & no_repeat, F.lit(False)).alias("no_repeat"), F.coalesce(F.col("k").isNotNull() & mid_word, F.lit(False)).alias("mid_word"),
    )
    wrong = flags.where(F.col("too_long") | F.col("part") | F.col("no_repeat") | F.col("mid_word"))
    return wrong.groupBy("chunk_id", "parent_id").agg(*(F.max(c).alias(c) for c in ("too_long", "part", "no_repeat", "mid_word")))
