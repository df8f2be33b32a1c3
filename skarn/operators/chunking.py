"""Documents to blocks, parents and children; metadata. Python runs in Arrow batches, one pass per document."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from skarn.functions import segment as S
from skarn.functions.text import chunk_id, code_symbols, heading_symbols, parent_id

_CHILDREN = "array<struct<child_idx:int,h_path:string,text:string>>"


_SECTION_FIELDS = ["rel_path", "parent_idx", "h_path", "text", "code", "heads", "children"]
_SECTION_ROW = f"rel_path string, parent_idx int, h_path string, text string, code string, heads string, children {_CHILDREN}"


def _section_rows(path: str, found: list[S.Section]) -> list[tuple]:
    rows = []
    for i, s in enumerate(found):
        code = "\n".join(b.text for b in s.blocks if b.kind == "code")
        heads = "\n".join(b.text for b in s.blocks if b.kind == "heading")
        rows.append((path, i, s.blocks[0].h_path, s.text, code, heads, [{"child_idx": j, "h_path": h, "text": t} for j, (h, t) in enumerate(s.children)]))
    return rows


def _with_symbols(rows: DataFrame, *more: str) -> DataFrame:
    symbols = F.sort_array(F.array_distinct(F.concat(code_symbols(F.col("code")), heading_symbols(F.col("heads")))))
    return rows.select(parent_id(F.col("rel_path"), F.col("parent_idx")).alias("parent_id"), "rel_path", "parent_idx", "h_path", "text", symbols.alias("api_symbols"), "children", *more)


def sections(docs: DataFrame, least: int = S.PARENT_MIN, most: int = S.PARENT_MAX, size: int = S.CHILD_CHARS, overlap: int = S.CHILD_OVERLAP) -> DataFrame:
    """(rel_path, parent_idx, h_path, text, api_symbols, children[]) of documents (rel_path, text). Null and empty texts have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [r for path, text in zip(pdf["rel_path"], pdf["text"]) for r in _section_rows(path, S.segment(text or "", least, most, size, overlap))]
            yield pd.DataFrame(rows, columns=_SECTION_FIELDS)

    return _with_symbols(docs.where(F.col("rel_path").isNotNull()).select("rel_path", "text").mapInPandas(run, _SECTION_ROW))


def sections_or_errors(docs: DataFrame) -> DataFrame:
    """``sections`` with a column ``error``: a document that can't be cut has one row with its path and the error's text, and the others go on."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, text in zip(pdf["rel_path"], pdf["text"]):
                try:
                    rows += _section_rows(path, S.segment(text or ""))
                except Exception as error:
                    rows.append((path, *[None] * 6, f"{type(error).__name__}: {error}"))
            yield pd.DataFrame([(*r, None) if len(r) == 7 else r for r in rows], columns=[*_SECTION_FIELDS, "error"])

    out = docs.where(F.col("rel_path").isNotNull()).select("rel_path", "text").mapInPandas(run, f"{_SECTION_ROW}, error string")
    return _with_symbols(out, "error")


def parents(sectioned: DataFrame) -> DataFrame:
    return sectioned.drop("children")


def children(sectioned: DataFrame) -> DataFrame:
    """(chunk_id, parent_id, rel_path, parent_idx, child_idx, h_path, text, api_symbols): the children, with their parent's symbols."""
    rows = sectioned.select("parent_id", "rel_path", "parent_idx", "api_symbols", F.explode("children").alias("c"))
    return rows.select(chunk_id(F.col("rel_path"), F.col("parent_idx"), F.col("c.child_idx")).alias("chunk_id"), "parent_id", "rel_path", "parent_idx", "c.child_idx", "c.h_path", "c.text", "api_symbols")


def blocks(docs: DataFrame) -> DataFrame:
    """(rel_path, block_idx, kind, level, h_path, text) of each document's blocks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, i, b.kind, b.level, b.h_path, b.text) for p, t in zip(pdf["rel_path"], pdf["text"]) for i, b in enumerate(S.read_blocks(S.split_front(t or "")[1]))]
            yield pd.DataFrame(rows, columns=["rel_path", "block_idx", "kind", "level", "h_path", "text"])

    return docs.where(F.col("rel_path").isNotNull()).select("rel_path", "text").mapInPandas(run, "rel_path string, block_idx int, kind string, level int, h_path string, text string")


def metadata(docs: DataFrame) -> DataFrame:
    """(rel_path, doc_title, doc_type, facets, warnings). Facets are lists; malformed frontmatter gives a warning, never an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [{"rel_path": p} | S.describe(t or "", p) for p, t in zip(pdf["rel_path"], pdf["text"])]
            yield pd.DataFrame(rows, columns=["rel_path", "doc_title", "doc_type", "facets", "warnings"])

    return docs.where(F.col("rel_path").isNotNull()).select("rel_path", "text").mapInPandas(run, "rel_path string, doc_title string, doc_type string, facets map<string,array<string>>, warnings array<string>")


@udtf(returnType="parent_idx int, child_idx int, h_path string, text string", useArrow=True)
class _ChunkDocument:
    def eval(self, text: str):
        for i, s in enumerate(S.segment(text or "")):
            for j, (h, t) in enumerate(s.children):
                yield i, j, h, t


def register_sql(spark: SparkSession) -> None:
    """Make ``chunk_document(text)`` a table function of SQL: ``FROM docs, LATERAL chunk_document(docs.text)``."""
    spark.udtf.register("chunk_document", _ChunkDocument)
