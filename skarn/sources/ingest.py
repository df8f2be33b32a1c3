"""Adding one document to the index at once, and the nightly pass."""

from __future__ import annotations

import fcntl
import os
import time
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.operators import catalog, chunking
from skarn.sources.readers import Snapshots, literal_document

MOST_CHUNKS, MOST_AGE_HOURS = 400, 20


@dataclass(frozen=True)
class Receipt:
    rel_path: str
    sha256: str
    n_parents: int
    n_chunks: int
    replaced: bool


@contextmanager
def exclusive(path: str):
    """A file lock that fails at once if another process holds it."""
    with open(path, "w") as f:
        try:
            fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except BlockingIOError as error:
            raise RuntimeError(f"{path} is held by another process") from error
        yield


def ingest(spark: SparkSession, store: Snapshots, overwrite: bool = False, **document: str) -> Receipt:
    """Chunk one document and replace its rows in the store. ValueError for a bad document, a path that is taken (unless ``overwrite``), the official source, or more than MOST_CHUNKS pieces."""
    docs = literal_document(spark, **document)
    path, text = docs.first()
    if docs.select(catalog.source_of(F.col("rel_path"))).first()[0] == "official":
        raise ValueError("the official source is not written to")
    sections = chunking.sections(docs).cache()
    rows = chunking.children(sections)
    n = rows.count()
    if n > MOST_CHUNKS:
        raise ValueError(f"{n} pieces; {MOST_CHUNKS} at most")
    old = store.read() if store.current() else rows.limit(0)
    taken = bool(old.where(F.col("rel_path") == path).limit(1).count())
    if taken and not overwrite:
        raise ValueError(f"{path} is taken")
    if store.key:
        store.replace(rows, docs.select("rel_path"))
    else:
        store.write(catalog.replace_files(old, rows, docs.select("rel_path")))
    digest = docs.select(F.sha2("text", 256)).first()[0]
    return Receipt(path, digest, sections.count(), n, taken)


def due(stamp: str, now: float | None = None, hours: float = MOST_AGE_HOURS) -> bool:
    """Whether the last successful pass, whose time is the stamp file's, is older than so many hours or never was."""
    return not os.path.exists(stamp) or (now or time.time()) - os.path.getmtime(stamp) >= hours * 3600


def nightly(stamp: str, lock: str, *steps: Callable[[], object], hours: float = MOST_AGE_HOURS) -> bool:
    """Run the steps if a pass is due; the stamp is set only after all succeeded. False if it wasn't due."""
    if not due(stamp, hours=hours):
        return False
    with exclusive(lock):
        for step in steps:
            step()
        with open(stamp, "w") as f:
            f.write(str(time.time()))
    return True


def synthesized(docs: DataFrame) -> DataFrame:
    """Documents with a frontmatter block made from the file name where there is none."""
    stem = F.regexp_replace(F.regexp_replace(F.substring_index("rel_path", "/", -1), r"(?<=.)\.[^.]*$", ""), "[-_]+", " ")
    head = F.concat(F.lit('---\ntitle: "'), F.replace(stem, F.lit('"'), F.lit("'")), F.lit('"\n---\n'))
    return docs.withColumn("text", F.when(F.startswith("text", F.lit("---\n")), F.col("text")).otherwise(F.concat(head, F.coalesce("text", F.lit("")))))
