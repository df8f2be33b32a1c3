"""Lines repeated across the documents of one source, and texts without them.

1. Each line that counts has its letters (the identity of a line) and a masked form (numbers, dates and names taken
   out), of which VALUES min-hash values are kept; each four of them are a band.
2. Lines of one source that share a band are one bucket. Only lines in buckets of many lines go on.
3. A bucket's leader is the line that stands in most paths. A line joins it if it agrees with it in AGREE min-hash
   values and the shingles of both masked forms are SIMILAR; nothing is a member unverified.
4. A cluster that stands in many paths is taken out; a line that alone stands in many paths leads itself, so lines
   with the same letters are found whatever the hashing does.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.plans.skew import ROWS_PER_SALT, hot_keys, replicated, salted
from skarn.plans.stage import write_stage

#: Documents of one source in which a line must stand; letters below which a line does not count.
MIN_PATHS, MIN_LETTERS = 10, 12
#: Locality-sensitive hashing: bands, min-hash values of 16 bits in each, and letters of a shingle.
BANDS, BAND_ROWS, SHINGLE = 4, 4, 5
#: A member's min-hash values (of BANDS x BAND_ROWS) that must equal its leader's, and the share of all shingles of both that must be common.
AGREE, SIMILAR = 11, 0.8
#: A list of at most so many 16-byte keys (5 MB) may be broadcast; beyond it the join shuffles.
MAX_BROADCAST_KEYS = 300_000

_ASCII_DROP = {i: None for i in range(128) if not chr(i).isalpha() and chr(i) != "\n"}
_DROP = re.compile(r"[^\w\n]+|[\d_]+|[²³¹¼-¾⁰-↉①-⒛⓪-⓿❶-➓]+")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})")
_DATE_WORDS = re.compile(r"\b(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?|mon(?:day)?|tue(?:sday)?|wed(?:nesday)?|thu(?:rsday)?|fri(?:day)?|sat(?:urday)?|sun(?:day)?)\b", re.I)
#: Names: capitalized words in a row, after a word in small letters, a comma or a colon.
_NAMES = re.compile(r"(?<=[a-zß-ÿ,:] )(?:[A-Z][^\W\d_]+[ .]*){2,}")


def letters_of(text: str) -> str:
    """The lower-cased letters of a text and its line feeds, nothing else."""
    low = text.lower()
    return low.translate(_ASCII_DROP) if low.isascii() else _DROP.sub("", low)


def counted_lines(text: str | None, min_letters: int = MIN_LETTERS) -> list[tuple[int, str]]:
    """(line number from 1, letters) of the lines that count: outside fenced code, not starting with ``#``, ``|`` or ``<``, with enough letters. Null and empty texts have none."""
    if not text:
        return []
    lines, keys, out, fence = text.split("\n"), letters_of(text).split("\n"), [], None
    fenced = "```" in text or "~~~" in text
    for n, (line, key) in enumerate(zip(lines, keys), 1):
        if fenced and (fence or line.lstrip(" ")[:1] in ("`", "~")):
            m = _FENCE.match(line)
            if fence:
                if m and m.group(1).startswith(fence) and not line[m.end() :].strip():
                    fence = None
                continue
            if m:
                fence = m.group(1)
                continue
        if len(key) >= min_letters and line[0] not in "#|<":
            out.append((n, key))
    return out


def masked(line: str, letters: str) -> str:
    """The letters of a line without dates and names; all its letters if fewer than MIN_LETTERS would be left."""
    form = letters_of(_DATE_WORDS.sub(" ", _NAMES.sub(" ", line)))
    return form if len(form) >= MIN_LETTERS else letters


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def form_shingles(forms: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the letter shingles of each form, one after another, and where each form's begin."""
    raw = [f.encode() for f in forms]
    sizes = np.fromiter((max(SHINGLE, len(m)) for m in raw), np.int64, len(raw))
    text = np.frombuffer(b"".join(m if len(m) >= SHINGLE else m.ljust(SHINGLE, b"\0") for m in raw), np.uint8)
    ends = np.cumsum(sizes)
    grams = np.zeros(len(text), np.uint64)
    for i in range(SHINGLE):
        grams[: len(text) - i] = grams[: len(text) - i] * np.uint64(0x100000001B3) + text[i:]
    inside = np.ones(len(text), bool)
    for i in range(1, SHINGLE):
        inside[ends - i] = False
    return _mixed(grams[inside]), np.concatenate([[0], np.cumsum(sizes - SHINGLE + 1)[:-1]])


#: Each min-hash value has a hash function of its own: two odd multipliers with a shift between them.
_FIRST, _SECOND = (np.random.default_rng(4021).integers(1, 2**63, size=(2, BANDS * BAND_ROWS), dtype=np.uint64) | np.uint64(1))


def min_hashes(forms: list[str]) -> np.ndarray:
    """[len(forms), BANDS x BAND_ROWS] min-hash values of 16 bits; a band's values are neighbours."""
    grams, starts = form_shingles(forms)
    out = np.empty((len(forms), BANDS * BAND_ROWS), np.uint16)
    for j in range(BANDS * BAND_ROWS):
        h = grams * _FIRST[j]
        h = (h ^ (h >> np.uint64(32))) * _SECOND[j]
        least = np.minimum.reduceat((h >> np.uint64(32)).astype(np.uint32), starts)
        out[:, j] = (least * np.uint32(0x9E3779B1)) >> np.uint32(16)  # the least hash of many has high bits of zero
    return out


def similarity(a: str, b: str) -> float:
    """Share of common letter shingles of two masked forms."""
    x, y = (set(form_shingles([f])[0].tolist()) for f in (a, b))
    return len(x & y) / len(x | y)


_BAND_NAMES = [f"band{b}" for b in range(BANDS)]


def _hash_of(letters: str) -> int:
    return xxhash.xxh3_64_intdigest(letters)


def section_lines(parents: DataFrame) -> DataFrame:
    """One row per section with lines that count: (parent_id, rel_path, line_no[], letters[], band0[], ...).

    ``letters`` is a 64-bit hash of a line's letters; a band has four min-hash values of its masked form. Repeated
    rows stay; rows with null id, path or text have no lines.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, paths, rows, numbers, where = batch.column(0).to_pylist(), batch.column(1).to_pylist(), [], [], {}
            offsets, at, forms = [0], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                lines = counted_lines(text) if ids[i] is not None and paths[i] is not None else []
                if not lines:
                    continue
                rows.append(i)
                whole = text.split("\n")
                for n, key in lines:
                    numbers.append(n)
                    found = where.setdefault(key, len(where))
                    if found == len(forms):
                        forms.append(masked(whole[n - 1], key))
                    at.append(found)
                offsets.append(len(numbers))
            if not rows:
                continue
            at = np.array(at)
            hashes = np.fromiter(map(_hash_of, where), np.uint64, len(where)).view(np.int64)[at]
            bands = min_hashes(forms).view(np.int64)[at]
            offsets = pa.array(offsets, pa.int32())
            lists = [numbers_array(offsets, np.array(numbers, np.int32)), numbers_array(offsets, hashes)] + [numbers_array(offsets, np.ascontiguousarray(bands[:, b])) for b in range(BANDS)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows)), *lists], ["parent_id", "rel_path", "line_no", "letters", *_BAND_NAMES])

    schema = "parent_id string, rel_path string, line_no array<int>, letters array<bigint>, " + ", ".join(f"{b} array<bigint>" for b in _BAND_NAMES)
    return parents.select("parent_id", "rel_path", "text").mapInArrow(run, schema)


def numbers_array(offsets: pa.Array, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(offsets, pa.array(values))


def sourced_lines(parents: DataFrame, files: DataFrame, rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """``section_lines`` with the source of the section's file, written as a stage table. Sections whose path is not in files, or has no source there, are left out. A path with very many sections is salted."""
    sources = files.where(F.col("rel_path").isNotNull() & F.col("source").isNotNull()).groupBy("rel_path").agg(F.min("source").alias("source"))
    hot = hot_keys(parents.select("rel_path"), ["rel_path"], rows_per_salt)
    lines = salted(section_lines(parents), hot, ["rel_path"], F.col("parent_id"))
    return write_stage(lines.join(replicated(sources, hot, ["rel_path"]), ["rel_path", "salt"]).drop("salt"), "lines")


def _keep(rows: DataFrame, wanted: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key is in ``wanted``; that side is broadcast only after its size was checked."""
    listed = write_stage(wanted, "keys")
    small = listed.count() <= MAX_BROADCAST_KEYS
    return rows.join(F.broadcast(listed) if small else listed, on, "left_semi")


def bucket_lines(sections: DataFrame, min_paths: int = MIN_PATHS) -> DataFrame:
    """(source, parent_id, path, line_no, letters, bands[]) of the lines that share a band, or all letters, with at least ``min_paths`` lines of their source, themselves included; a stage table, no row twice.

    Lines with the same letters may be masked differently (names are told by capitals), so letters are a bucket too.
    """
    fields = ["line_no", "letters", *_BAND_NAMES]
    lines = sections.select("source", "parent_id", F.xxhash64("rel_path").alias("path"), F.explode(F.arrays_zip(*fields)).alias("l"))
    lines = lines.select("source", "parent_id", "path", F.col("l.line_no").alias("line_no"), F.col("l.letters").alias("letters"), F.array(*(F.col(f"l.{b}") for b in _BAND_NAMES)).alias("bands"))
    keys = F.posexplode(F.concat("bands", F.array("letters"))).alias("band", "bucket")
    buckets = lines.select("source", keys).groupBy("source", "band", "bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_paths).drop("n")
    placed = lines.select("*", keys)
    return write_stage(_keep(placed, buckets, ["source", "band", "bucket"]).drop("band", "bucket").distinct(), "bucketed")


def agreeing(pairs: DataFrame, least: int = AGREE) -> DataFrame:
    """Rows of ``pairs`` of which at least ``least`` of the 16-bit min-hash values in bands and leader_bands are equal; these two columns are dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (batch.column(c).flatten().to_numpy().view(np.uint16).reshape(batch.num_rows, -1) for c in ("bands", "leader_bands"))
                yield batch.filter(pa.array((a == b).sum(axis=1) >= least)).select(names)

    names = [c for c in pairs.columns if c not in ("bands", "leader_bands")]
    return pairs.mapInArrow(run, pairs.select(*names).schema)


def masked_forms(parents: DataFrame, wanted: DataFrame) -> DataFrame:
    """(letters, form) of the lines (parent_id, letters) of sections; lines that are not there have no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[int, str] = {}
            for text, keys in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys, whole = set(keys), text.split("\n")
                for n, key in counted_lines(text):
                    h = int(np.uint64(_hash_of(key)).view(np.int64))
                    if h in keys:
                        form = masked(whole[n - 1], key)
                        out[h] = min(form, out.get(h, form))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), pa.array(list(out.values()))], ["letters", "form"])

    keyed = write_stage(wanted.groupBy("parent_id").agg(F.collect_set("letters").alias("keys")), "sections")
    texts = parents.where(F.col("text").isNotNull()).select("parent_id", "text")
    small = keyed.count() <= MAX_BROADCAST_KEYS // 10
    picked = texts.join(F.broadcast(keyed) if small else keyed, "parent_id").select("text", "keys")
    return picked.mapInArrow(run, "letters bigint, form string").groupBy("letters").agg(F.min("form").alias("form"))


def similar_forms(pairs: DataFrame, least: float = SIMILAR) -> DataFrame:
    """Rows of ``pairs`` whose masked forms (columns form and leader_form) share enough shingles; these two columns are dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [similarity(a, b) >= least for a, b in zip(batch.column("form").to_pylist(), batch.column("leader_form").to_pylist())]
            yield batch.filter(pa.array(good, pa.bool_())).select(names)

    names = [c for c in pairs.columns if c not in ("form", "leader_form")]
    return pairs.mapInArrow(run, pairs.select(*names).schema)


def line_clusters(parents: DataFrame, files: DataFrame, min_paths: int = MIN_PATHS) -> tuple[DataFrame, DataFrame]:
    """Near-duplicate clusters: (source, letters, n_own, cluster, n_paths), and the lines in their buckets (see ``bucket_lines``).

    A bucket's leader is the line that stands in most paths (ties: least letters hash), and a line that stands in
    ``min_paths`` paths leads itself. A cluster has its leader and the lines that share a bucket with it, agree with it in
    AGREE min-hash values and are SIMILAR to it by their shingles; it counts if it stands in at least ``min_paths``
    paths of its source; its name is the leader's letters hash. A line is in the cluster with most paths of its leaders (ties: least name). ``n_own`` is the number of paths
    with the line's own letters.
    """
    lines = bucket_lines(sourced_lines(parents, files), min_paths)
    once = write_stage(lines.groupBy("source", "letters", "path").agg(F.min("bands").alias("bands"), F.min("parent_id").alias("parent_id")), "once")
    kinds = write_stage(once.groupBy("source", "letters").agg(F.count(F.lit(1)).alias("n"), F.min("bands").alias("bands"), F.min("parent_id").alias("parent_id")), "kinds")
    placed = kinds.select("source", "letters", "n", F.posexplode("bands").alias("band", "bucket"))
    # paths of a bucket's lines counted more than once if they hold several of them: a bound that loses no cluster
    buckets = placed.groupBy("source", "band", "bucket").agg(F.sum("n").alias("most"), F.min(F.struct(-F.col("n"), F.col("letters"))).alias("l")).where(F.col("most") >= min_paths).select("source", "band", "bucket", F.col("l.letters").alias("leader"))
    led = placed.join(buckets, ["source", "band", "bucket"]).where(F.col("letters") != F.col("leader")).select("source", "letters", "leader").distinct()
    bands = kinds.select("source", "letters", "bands")
    agreed = write_stage(agreeing(led.join(bands, ["source", "letters"]).join(bands.select("source", F.col("letters").alias("leader"), F.col("bands").alias("leader_bands")), ["source", "leader"])), "agreed")
    ends = agreed.select("source", F.explode(F.array("letters", "leader")).alias("letters")).distinct()
    forms = write_stage(masked_forms(parents, kinds.join(ends, ["source", "letters"], "left_semi").select("parent_id", "letters")), "forms")
    verified = similar_forms(agreed.join(forms, "letters").join(forms.select(F.col("letters").alias("leader"), F.col("form").alias("leader_form")), "leader")).select("source", "letters", "leader")
    leaders = buckets.select("source", F.col("leader").alias("letters")).unionByName(kinds.where(F.col("n") >= min_paths).select("source", "letters")).distinct()
    members = write_stage(verified.unionByName(leaders.select("source", "letters", F.col("letters").alias("leader"))), "members")
    paths = members.join(once, ["source", "letters"]).select("source", "leader", "path").distinct()
    frequent = paths.groupBy("source", "leader").agg(F.count(F.lit(1)).alias("n_paths")).where(F.col("n_paths") >= min_paths)
    best = members.join(frequent, ["source", "leader"]).groupBy("source", "letters").agg(F.min(F.struct((-F.col("n_paths")).alias("less"), "leader")).alias("best"))
    own = kinds.select("source", "letters", F.col("n").alias("n_own"))
    return best.join(own, ["source", "letters"]).select("source", "letters", "n_own", F.col("best.leader").alias("cluster"), (-F.col("best.less")).alias("n_paths")), lines


def repeated_lines(parents: DataFrame, files: DataFrame, min_paths: int = MIN_PATHS) -> DataFrame:
    """(parent_id, line_no) of each occurrence of a clustered line whose own letters stand in at least ``min_paths`` different paths of one source.

    Lines are the same if their letters are. Copied rows of a section count once; empty inputs give no rows.
    """
    clusters, lines = line_clusters(parents, files, min_paths)
    same = clusters.where(F.col("n_own") >= min_paths).select("source", "letters")
    return _keep(lines, same, ["source", "letters"]).select("parent_id", "line_no").distinct()


def cleaned_sections(parents: DataFrame, files: DataFrame, min_paths: int = MIN_PATHS) -> DataFrame:
    """(parent_id, text, n_removed): each section's text without the lines of frequent clusters of its source. Sections without such lines keep their text; null stays null; of copied rows one counts."""
    clusters, lines = line_clusters(parents, files, min_paths)
    gone = _keep(lines, clusters.select("source", "letters"), ["source", "letters"]).groupBy("parent_id").agg(F.collect_set("line_no").alias("gone"))
    once = parents.where(F.col("parent_id").isNotNull()).groupBy("parent_id").agg(F.min("text").alias("text"))
    rows = once.join(gone, "parent_id", "left")
    kept = F.array_join(F.filter(F.split("text", "\n", -1), lambda _, i: ~F.array_contains(F.col("gone"), i + 1)), "\n")
    return rows.select("parent_id", F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("text"), F.coalesce(F.size("gone"), F.lit(0)).alias("n_removed"))
