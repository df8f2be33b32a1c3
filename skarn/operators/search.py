"""The whole search for a batch of questions, under a profile: filter, search, fuse, dedupe, rerank, boost, promote, cap."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.functions import text as X
from skarn.operators import fusion, lexical, ranked, vector
from skarn.plans.stage import write_stage

# What each kind of answer may hold.
CAPS = {
    "search": {"max_results": 8, "max_words_per_result": 150, "max_chars_total": 6000},
    "section": {"max_chars": 8000},
    "outline": {"max_chars": 3000},
    "lexical": {"max_hits": 20, "max_chars_total": 4000},
    "research": {"max_words": 900, "max_results": 6, "max_chars_total": 6000},
    "stats": {"max_chars": 500},
    "ingest": {"max_chars": 1000},
}
MODES = ("dense", "sparse", "hybrid")


@dataclass(frozen=True)
class Profile:
    """A search policy: sources it reaches (None: all), types it favours, facets it accepts, whether code-like questions are looked up line by line."""

    name: str
    sources: tuple[str, ...] | None = None
    boost: tuple[str, ...] = ()
    facets: tuple[str, ...] = ("tags",)
    lexical_for_code: bool = True


PROFILES = {
    p.name: p
    for p in (
        Profile("general"),
        Profile("servicenow", ("official",), ("api", "reference"), ("release", "product", "classification", "tags")),
        Profile("personal", ("personal", "wiki", "custom-app", "code-graph")),
    )
}


def build_filter(sources: tuple[str, ...] | None = None, doc_types: tuple[str, ...] | None = None, facets: dict[str, str | list[str]] | None = None, symbols: tuple[str, ...] | None = None) -> Column | None:
    """AND of conditions over the columns source, doc_type, facets (map of lists) and api_symbols; a list means any of its values, an array column matches if any element does. Types are compared in lower case. No condition: None."""
    parts: list[Column] = []
    if sources:
        parts.append(F.col("source").isin(*sources))
    if doc_types:
        parts.append(F.lower("doc_type").isin(*(t.lower() for t in doc_types)))
    for key, value in (facets or {}).items():
        wanted = [value] if isinstance(value, str) else list(value)
        parts.append(F.coalesce(F.arrays_overlap(F.col("facets")[key], F.array(*(F.lit(v) for v in wanted))), F.lit(False)))
    if symbols:
        parts.append(F.coalesce(F.arrays_overlap("api_symbols", F.array(*(F.lit(s) for s in symbols))), F.lit(False)))
    return reduce(lambda a, b: a & b, parts) if parts else None


def allowed_facets(profile: Profile, facets: dict | None) -> dict:
    """The facets, or ValueError naming those the profile doesn't support."""
    rejected = sorted(set(facets or {}) - set(profile.facets))
    if rejected:
        raise ValueError(f"profile {profile.name!r} does not support facets {rejected}; supported: {list(profile.facets)}")
    return dict(facets or {})


@dataclass
class Search:
    """One search over sections (doc_id, rel_path, text, source, doc_type, facets, ...); encoder and reranker can be replaced by model-backed ones."""

    profile: Profile
    mode: str = "hybrid"
    candidates: int = 30
    encode: Callable[[DataFrame, str, str], DataFrame] = vector.hashed_embedding
    rerank: Callable[[DataFrame, DataFrame, DataFrame, int], DataFrame] = fusion.overlap_rerank
    extra: dict = field(default_factory=dict)

    def run(self, questions: DataFrame, sections: DataFrame, k: int = 8, facets: dict | None = None, doc_types: tuple[str, ...] | None = None) -> DataFrame:
        """(query_id, doc_id, rel_path, rank, score, considered, used_lexical) for questions (query_id, text).

        ``considered`` is the number of candidates before deduplication, ``used_lexical`` whether line search found
        anything to promote. Filters go into each arm. k is cut to the most results an answer may hold. An unknown
        mode or facet is a ValueError; no questions or sections give no rows.
        """
        if self.mode not in MODES:
            raise ValueError(f"unknown mode {self.mode!r}; one of {MODES}")
        k = min(k, CAPS["search"]["max_results"])
        keep = build_filter(self.profile.sources, doc_types, allowed_facets(self.profile, facets))
        inside = sections.where(keep) if keep is not None else sections
        arms, depth = [], self.candidates * (fusion.PREFETCH if self.mode == "hybrid" else 1)
        if self.mode != "sparse":
            points = self.encode(inside, "doc_id", "text").withColumnRenamed("doc_id", "point_id")
            arms.append(vector.dense_topk(self.encode(questions, "query_id", "text"), points, depth).withColumnRenamed("point_id", "doc_id"))
        if self.mode != "dense":
            # the stand-in needs no texts if the only arm tells how many terms are there
            own = self.mode == "sparse" and self.rerank is fusion.overlap_rerank
            arms.append(lexical.sparse_topk(questions, sections, depth, keep=keep, matched=own))
        # read several times: an arm is a pass over all sections
        hits = write_stage(fusion.rrf(arms, self.candidates) if len(arms) > 1 else arms[0], "fused")
        counted = hits.groupBy("query_id").agg(F.count(F.lit(1)).cast("int").alias("considered"))
        top = self.rerank(fusion.best_per_parent(hits, "doc_id"), questions, inside, k)
        once = inside.groupBy("doc_id").agg(F.min(F.struct("rel_path", "doc_type")).alias("v"))
        hits = write_stage(top.join(once, "doc_id").select("query_id", "doc_id", "v.rel_path", "v.doc_type", "rank", "score"), "reranked")
        if self.profile.boost:
            hits = fusion.boosted(hits, F.col("doc_type").isin(*self.profile.boost))
        if self.profile.lexical_for_code:
            hits = self._promote(hits, questions, inside)
        else:
            hits = hits.withColumn("used_lexical", F.lit(False))
        return hits.join(counted, "query_id").select("query_id", "doc_id", "rel_path", "rank", "score", "considered", "used_lexical")

    @staticmethod
    def _promote(hits: DataFrame, questions: DataFrame, inside: DataFrame) -> DataFrame:
        """Hits that hold one of the first three code symbols of a code-like question go first. Only the texts of such questions' hits are read."""
        symbols = questions.where(X.is_code_like(F.col("text"))).select("query_id", F.slice(X.query_symbols(F.col("text")), 1, 3).alias("_symbols"))
        asked = write_stage(hits.join(symbols, "query_id").select("query_id", "doc_id", "_symbols"), "asked")
        texts = ranked.thinned(inside.select("doc_id", F.col("text").alias("_text")), asked, "doc_id")
        there = asked.join(texts, "doc_id").where(F.exists("_symbols", lambda s: F.contains(F.col("_text"), s)))
        marked = write_stage(fusion.boosted(hits.join(there.select("query_id", "doc_id", F.lit(True).alias("_hit")).distinct(), ["query_id", "doc_id"], "left").fillna(False, "_hit"), F.col("_hit")), "marked")
        used = marked.groupBy("query_id").agg(F.max("_hit").alias("used_lexical"))
        return marked.drop("_hit").join(used, "query_id")


BAD_REQUEST, BACKEND_UNAVAILABLE = "BAD_REQUEST", "BACKEND_UNAVAILABLE"


@dataclass(frozen=True)
class Answer:
    """What a search tool gives back: items and citations, or the kind of error and what it says."""

    error: str | None = None
    message: str = ""
    items: DataFrame | None = None
    citations: DataFrame | None = None


def citations(kept: DataFrame, key: str = "rel_path") -> DataFrame:
    """(query_id, citations[]): the files of the kept items in the order first seen, each once. An answer has a bounded number of items."""
    first = kept.where(F.col(key).isNotNull()).groupBy("query_id", key).agg(F.min("rank").alias("_rank"))
    listed = F.array_sort(F.collect_list(F.struct("_rank", key)))
    return first.groupBy("query_id").agg(F.transform(listed, lambda s: s[key]).alias("citations"))


def answered(find: Callable[[], DataFrame], texts: DataFrame, max_words: int = 150, max_chars: int = 6000) -> Answer:
    """Run a search and cap its answer. A wrong argument is BAD_REQUEST, anything that fails behind it BACKEND_UNAVAILABLE; citations are those of the items that were kept."""
    try:
        hits = write_stage(find(), "hits")
        kept = write_stage(capped_answer(hits, texts, max_words, max_chars), "answer")
        return Answer(items=kept, citations=citations(kept.join(hits.select("query_id", "rank", "rel_path"), ["query_id", "rank"])))
    except ValueError as error:
        return Answer(BAD_REQUEST, str(error))
    except Exception as error:
        return Answer(BACKEND_UNAVAILABLE, f"{type(error).__name__}: {error}")


#: The longest pattern of a line search.
MOST_PATTERN = 500


def find_lines(sections: DataFrame, pattern: str, profile: Profile, folder: str | None = None, fixed: bool = True, max_per_file: int | None = None, context: int = 0) -> tuple[DataFrame, DataFrame]:
    """Lines of the sections (rel_path, text, source) that a profile reaches, and the files (rel_path), each once. ValueError for an empty or too long pattern, and for a folder unless the profile is that of the official source."""
    if not pattern or len(pattern) > MOST_PATTERN:
        raise ValueError(f"a pattern has 1 to {MOST_PATTERN} characters")
    if folder is not None and profile.sources != ("official",):
        raise ValueError(f"profile {profile.name!r} can't be restricted to a folder")
    keep = build_filter(profile.sources)
    inside = sections if keep is None else sections.where(keep)
    if folder is not None:
        inside = inside.where(F.startswith("rel_path", F.lit(folder.strip("/") + "/")))
    hits = lexical.line_search(inside, pattern, fixed, "rel_path", max_per_file, context)
    return hits, hits.select("rel_path").distinct()


def capped_answer(hits: DataFrame, texts: DataFrame, max_words: int = 150, max_chars: int = 6000) -> DataFrame:
    """(query_id, rank, doc_id, snippet, running): the prefix of each answer whose items fit, as JSON, into ``max_chars``; the first is always kept."""
    # snippets are made before the shuffle, of texts that may be among the hits
    snippets = ranked.thinned(texts.select("doc_id", "text"), hits, "doc_id").select("doc_id", X.snippet(F.col("text"), max_words).alias("snippet"))
    rows = hits.select("query_id", "rank", "doc_id").join(snippets, "doc_id")
    return fusion.running_cap(rows, "query_id", "rank", X.item_cost("rank", "doc_id", "snippet"), max_chars, CAPS["search"]["max_results"])
