"""Scalar expressions over text, all of them built-in SQL functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TRUNCATION_MARKER = "\n\n[TRUNCATED]"
# What makes a query code-like (dotted call, CamelCase, sys_ table, a known receiver).
CODE_LIKE = r"(?U)\b[a-z_$][\w$]*\.[a-z_$][\w$]*|\b[A-Z][a-z0-9]+[A-Z]\w*|\bsys_\w+|\b(?:gs|gr|g_form|g_user|current|previous)\b"
# Identifiers in code and headings, and what only looks like one.
DOTTED_SYMBOL = r"\b[A-Za-z_$][A-Za-z0-9_$]*(?:\.[A-Za-z_$][A-Za-z0-9_$]*)+"
CAMEL_SYMBOL = r"\b[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]*)+\b"
HEADING_METHOD = r"\b([a-z][A-Za-z0-9_]*)\\?\("
URL_TAILS = ["com", "org", "net", "io", "gov", "edu", "co", "uk", "html", "htm", "md", "xml", "json", "csv", "xlsx", "pdf", "txt", "png", "jpg", "jpeg", "gif", "svg", "zip", "do", "js", "css"]
NOISE_SYMBOLS = ["function", "return", "var", "let", "const", "if", "else", "for", "while", "true", "false", "null", "undefined", "new", "this", "typeof", "class", "String", "Number", "Boolean", "Object", "Array", "JSON", "Math", "Date"]

# Words that no search by content looks for.
STOPWORDS = """a an the is are was were be been do does did how what why when where which who can i my me you it its to of in on for with
and or but if not no so that this these from by at as we our have has want need get got use using there then than into out up down about
should would could will just any""".split()
#: Word boundaries between letters of all scripts, not of ASCII only.
UNICODE_EDGES = "(?U)"
#: An identifier among content terms: three or more characters, dots inside.
CONTENT_TERM = r"[A-Za-z_][A-Za-z0-9_.]{2,}"

#: A term of the lexical index: a run of letters and digits of the lower-cased text.
TERM = r"[\p{L}\p{N}]+"


def _strings(values: list[str]) -> Column:
    return F.array(*(F.lit(v) for v in values))


def terms(text: Column) -> Column:
    """array<string> of a text's terms in order; null for null."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TERM})"), F.lit(1))


def approx_tokens(text: Column) -> Column:
    """Token estimate: a quarter of the characters, at least 1; null counts as empty."""
    return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(text, F.lit(""))) / 4).cast("int"))


def truncate_chars(text: Column, most: int, marker: str = TRUNCATION_MARKER) -> Column:
    """struct<text, truncated>: cut to ``most`` characters with the marker.

    The cut is at the last line feed if that keeps 8/10 of the room, else at the last blank if that keeps more than
    half, else exactly at the limit. With no room for the marker only the (stripped) marker is left. Null gives null.
    """
    room = most - len(marker)
    if room <= 0:
        cut = F.lit(marker.strip())
    else:
        head = F.substring(text, 1, room)
        last = lambda sep: F.when(F.locate(sep, F.reverse(head)) > 0, F.length(head) - F.locate(sep, F.reverse(head))).otherwise(-1)
        at = F.when(last("\n") >= room * 0.8, last("\n")).otherwise(last(" "))
        cut = F.concat(F.when(at > room * 0.5, F.substring(head, F.lit(1), at)).otherwise(head), F.lit(marker))
    over = F.length(text) > most
    return F.struct(F.when(over, cut).otherwise(text).alias("text"), over.alias("truncated"))


def words(text: Column) -> Column:
    """array<string> of a text split at blanks."""
    return F.filter(F.split(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), " "), lambda w: w != "")


def truncate_words(text: Column, most: int, marker: str = TRUNCATION_MARKER) -> Column:
    """The text, or its first ``most`` words joined by single blanks and the marker."""
    return F.when(F.size(words(text)) <= most, text).otherwise(F.concat(F.array_join(F.slice(words(text), 1, most), " "), F.lit(marker)))


def snippet(text: Column, most_words: int) -> Column:
    """Excerpt: white space collapsed, then at most so many words."""
    return truncate_words(F.array_join(words(text), " "), most_words)


def item_cost(*fields: str) -> Column:
    """Characters of a row's fields as a JSON object with a blank after each comma and colon, and \\u escapes for all that is not printable ASCII.

    Made from the compact, unescaped form: two blanks a field less one, five characters more for an escaped one, six
    on top of that for one outside the basic plane, which takes two escapes and counts as one character before.
    """
    compact = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    escaped, astral = F.regexp_count(compact, F.lit(r"[^\x{00}-\x{7E}]")), F.regexp_count(compact, F.lit(r"[\x{10000}-\x{10FFFF}]"))
    return F.length(compact) + (2 * len(fields) - 1) + 5 * escaped + 6 * astral


def parent_id(rel_path: Column, parent_idx: Column) -> Column:
    return F.sha1(F.concat_ws("::", rel_path, parent_idx.cast("string")))


def chunk_id(rel_path: Column, parent_idx: Column, child_idx: Column) -> Column:
    return F.sha1(F.concat_ws("::", rel_path, parent_idx.cast("string"), child_idx.cast("string")))


def point_uuid(chunk: Column) -> Column:
    """UUID text of the first 32 hex digits of an id."""
    return F.concat_ws("-", *(F.substring(chunk, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def is_code_like(query: Column) -> Column:
    return query.rlike(CODE_LIKE)


def query_symbols(query: Column) -> Column:
    """Code-like symbols of a query, in the order first seen."""
    return F.array_distinct(F.filter(F.regexp_extract_all(query, F.lit(CODE_LIKE), F.lit(0)), lambda s: s != ""))


def content_terms(text: Column, most: int = 6) -> Column:
    """The longest identifiers of a text that are no stopwords: unique, longest first, ties in text order."""
    found = F.filter(F.array_distinct(F.regexp_extract_all(text, F.lit(CONTENT_TERM), F.lit(0))), lambda t: ~F.lower(t).isin(STOPWORDS))
    keyed = F.transform(found, lambda t, i: F.struct((-F.length(t)).alias("k"), i.alias("i"), t.alias("t")))
    return F.slice(F.transform(F.array_sort(keyed), lambda s: s["t"]), 1, most)


def code_symbols(code: Column) -> Column:
    """Sorted unique API symbols of fenced code: dotted names that are no URL or file and hold no noise word, and CamelCase names."""
    noise, tails = _strings(NOISE_SYMBOLS), _strings(URL_TAILS)
    dotted = F.filter(F.regexp_extract_all(code, F.lit(UNICODE_EDGES + DOTTED_SYMBOL), F.lit(0)), lambda s: ~F.array_contains(tails, F.lower(F.substring_index(s, ".", -1))) & ~F.arrays_overlap(F.split(s, r"\."), noise))
    camel = F.filter(F.regexp_extract_all(code, F.lit(UNICODE_EDGES + CAMEL_SYMBOL), F.lit(0)), lambda s: ~F.array_contains(noise, s))
    return F.sort_array(F.array_distinct(F.concat(dotted, camel)))


def heading_symbols(heading: Column) -> Column:
    """Sorted unique API symbols of a heading: called names and CamelCase names."""
    noise = _strings(NOISE_SYMBOLS)
    found = F.concat(F.regexp_extract_all(heading, F.lit(UNICODE_EDGES + HEADING_METHOD), F.lit(1)), F.regexp_extract_all(heading, F.lit(UNICODE_EDGES + CAMEL_SYMBOL), F.lit(0)))
    return F.sort_array(F.array_distinct(F.filter(found, lambda s: ~F.array_contains(noise, s))))


def unescape_markdown(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\`*_{}\[\]()#+\-.!|~])", "$1")


def file_stem(rel_path: Column) -> Column:
    return F.regexp_replace(F.substring_index(rel_path, "/", -1), r"(?<=.)\.[^.]*$", "")


def embed_text(title: Column, rel_path: Column, h_path: Column, text: Column) -> Column:
    """What is embedded for a piece: title with those words of the file name that it lacks, breadcrumb, blank line, text."""
    stem = F.filter(F.split(F.regexp_replace(file_stem(rel_path), "[-_]+", " "), " "), lambda w: (w != "") & ~F.contains(F.lower(title), F.lower(w)))
    head = F.trim(F.concat_ws(" ", title, F.array_join(stem, " ")))
    return F.concat(F.concat_ws("\n", F.when(head != "", head), F.when(h_path != "", h_path)), F.lit("\n\n"), text)


def dedupe_key(text: Column) -> Column:
    """What counts as the same message: lower case, letters a-z, digits and blanks only, the first 80 characters."""
    return F.substring(F.regexp_replace(F.lower(text), "[^a-z0-9 ]", ""), 1, 80)


def slug(text: Column, most: int = 40) -> Column:
    return F.regexp_replace(F.substring(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), 1, most), "^-+|-+$", "")
