"""Filling containers of fixed capacity by lexical retrieval.

1. Documents are put into shards of about SHARD_DOCS: a large source is cut by a hash, small ones share a shard. A shard
   depends on the data only, so that any partitioning gives the same containers.
2. Each shard has an inverted index of its tokens. The longest unused item seeds a container; the index returns the BM25
   scores of the seed's neighbours, and those that are unused and fit enter in the order of their score. Towards the end
   only those that nearly fill the gap compete, since little unused room is the aim.
3. Items of badly filled containers go through a second round: they are pooled into shards anew and all are packed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.llm.tokens import TOKENIZER_PATH, encoder
from skarn.plans.stage import write_stage

#: Documents of a shard; tokens at which a shard is worked off earlier; the fill below which a container's items get a second round.
SHARD_DOCS, SHARD_TOKENS, AGAIN_BELOW = 512, 4_000_000, 0.97
#: BM25, and the part of a shard's documents above which a token tells nothing and has no postings.
K1, B, COMMON = 1.2, 0.75, 0.25
#: Towards the end of a container only items within this part of the largest fitting one compete.
NEARLY = 0.95
#: Sources that may be broadcast (5 MB); beyond that the join shuffles.
MAX_BROADCAST_SOURCES = 100_000


class InvertedIndex:
    """Postings (document, weight) of each token of a shard, for BM25 scores of documents as queries."""

    def __init__(self, terms: list[np.ndarray], counts: list[np.ndarray]) -> None:
        self.n = n = len(terms)
        flat = np.concatenate(terms) if n else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(n), [len(t) for t in terms])
        tf = np.concatenate(counts).astype(np.float64) if n else np.zeros(0)
        sizes = np.bincount(owner, tf, n)
        norm = K1 * (1 - B + B * sizes / max(1.0, float(sizes.mean()) if n else 1.0))
        order = np.argsort(flat, kind="stable")
        used, start, df = np.unique(flat[order], return_index=True, return_counts=True)
        # a token of one document only can't match another
        useful = (df > 1) & (df <= max(2, COMMON * n))
        keep = np.repeat(useful, df)
        self.docs = owner[order][keep]
        idf = np.repeat(np.log1p((n - df + 0.5) / (df + 0.5)), df)[keep]
        weight = tf[order][keep]
        self.weights = idf * weight * (K1 + 1) / (weight + norm[self.docs])
        self.starts, self.stops = np.cumsum(df[useful]) - df[useful], np.cumsum(df[useful])
        self.lists = np.searchsorted(used[useful], flat)  # of each document's tokens, in order
        self.known = np.repeat(useful, df)[np.argsort(order, kind="stable")] if n else np.zeros(0, bool)
        self.first = np.concatenate([[0], np.cumsum([len(t) for t in terms])]).astype(np.int64)

    def scores(self, doc: int) -> np.ndarray:
        """Each document's score for the tokens of one: the sum over the postings of its tokens."""
        mine = slice(self.first[doc], self.first[doc + 1])
        lists = self.lists[mine][self.known[mine]]
        start, n = self.starts[lists], self.stops[lists] - self.starts[lists]
        at = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.bincount(self.docs[at], self.weights[at], self.n)


def fill(sizes: np.ndarray, owner: np.ndarray, index: InvertedIndex, capacity: int) -> list[list[int]]:
    """Containers as lists of item numbers; each item is in one. ``sizes`` are at most ``capacity``; ``owner`` is the document of an item. Ties go to the first item."""
    free = np.ones(len(sizes), bool)
    out = []
    for seed in np.argsort(-sizes, kind="stable"):
        if not free[seed]:
            continue
        box, gap, relevance = [int(seed)], capacity - int(sizes[seed]), None
        free[seed] = False
        while gap > 0:
            fits = np.flatnonzero(free & (sizes <= gap))
            if not len(fits):
                break
            longest = sizes[fits].max()
            if gap < 2 * longest:
                fits = fits[sizes[fits] >= NEARLY * longest]
            if len(fits) > 1:
                relevance = np.round(index.scores(owner[seed]), 6) if relevance is None else relevance
                best = int(fits[np.argmax(relevance[owner[fits]])])
            else:
                best = int(fits[0])
            box.append(best)
            free[best] = False
            gap -= int(sizes[best])
        out.append(box)
    return out


def _shard(docs: DataFrame) -> DataFrame:
    """(shard, place, doc_id, text): documents with their shard and their place in its order."""
    sizes = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    large = write_stage(sizes.where(F.col("n") > SHARD_DOCS).select(F.col("source").alias("_source"), F.ceil(F.col("n") / SHARD_DOCS).alias("parts")), "large")
    pooled = sizes.where(F.col("n") <= SHARD_DOCS).agg(F.sum("n")).first()[0] or 0
    near = F.broadcast if large.count() <= MAX_BROADCAST_SOURCES else (lambda side: side)
    place = F.xxhash64("doc_id", "text")
    rows = docs.join(near(large), F.col("source").eqNullSafe(F.col("_source")), "left")
    source = F.xxhash64("source")
    shard: Column = F.when(F.col("parts").isNull(), F.concat(F.lit("p"), F.pmod(source, F.lit(-(-pooled // SHARD_DOCS) or 1)).cast("string")))
    shard = shard.otherwise(F.concat_ws(".", F.hex(source), F.pmod(place, F.col("parts")).cast("string")))
    return rows.select(shard.alias("shard"), place.alias("place"), "doc_id", "text")


_ROW = "pack_name string, container_id string, slot int, doc_id {kind}, piece int, first_token bigint, n_tokens bigint"
_LEFT = _ROW + ", shard string, terms array<int>, counts array<int>"


class _Out:
    """Rows of a task's output, as record batches."""

    def __init__(self, id_type: pa.DataType, left: bool) -> None:
        self.rows: list[tuple] = []
        types = [pa.string(), pa.string(), pa.int32(), id_type, pa.int32(), pa.int64(), pa.int64()]
        names = ["pack_name", "container_id", "slot", "doc_id", "piece", "first_token", "n_tokens"]
        if left:
            types, names = types + [pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())], [*names, "shard", "terms", "counts"]
        self.schema = pa.schema(zip(names, types))

    def add(self, *row) -> None:
        self.rows.append(row + (None,) * (len(self.schema) - len(row)))

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [()] * len(self.schema)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, self.schema)], schema=self.schema)


def _boxes(name: str, capacity: int, label: str, items: list[tuple], index: InvertedIndex, out: _Out, again: str | None) -> None:
    """Pack the items (document of the index, doc_id, piece, first_token, n_tokens, terms, counts) of one shard; with ``again``, items of badly filled containers are handed on with that shard."""
    if not items:
        return
    sizes, owner = np.array([x[4] for x in items], np.int64), np.array([x[0] for x in items], np.int64)
    for number, box in enumerate(fill(sizes, owner, index, capacity)):
        if again is not None and sizes[box].sum() < AGAIN_BELOW * capacity:
            for k in box:
                _, doc_id, piece, first, n, terms, counts = items[k]
                out.add(name, None, -1, doc_id, piece, first, n, again, terms, counts)
        else:
            for slot, k in enumerate(box):
                out.add(name, f"{name}-{label}-{number}", slot, *items[k][1:5])


def _first_round(sharded: DataFrame, limits: list[tuple[str, int]], tokenizer: str, kind: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, out, shard, block, tokens, part = encoder(tokenizer).encode_ordinary, None, None, [], 0, 0

        def work() -> Iterator[pa.RecordBatch]:
            label = f"{shard}.{part}"
            index = InvertedIndex([d[1] for d in block], [d[2] for d in block])
            for name, capacity in limits:
                items = []
                for i, (doc_id, terms, counts, n) in enumerate(block):
                    if n == 0:
                        out.add(name, None, 0, doc_id, 0, 0, 0)
                        continue
                    full, rest = divmod(n, capacity) if n > capacity else (0, n)
                    for piece in range(full):  # full containers of their own
                        out.add(name, f"{name}-{label}-d{i}.{piece}", 0, doc_id, piece, piece * capacity, capacity)
                    if rest:
                        items.append((i, doc_id, full, full * capacity, rest, terms, counts))
                _boxes(name, capacity, label, items, index, out, shard)
            yield out.batch()

        for batch in batches:
            out = out or _Out(batch.schema.field(1).type, True)
            for name, doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                if block and (name != shard or len(block) >= 4 * SHARD_DOCS or tokens >= SHARD_TOKENS):
                    yield from work()
                    block, tokens, part = [], 0, part + 1 if name == shard else 0
                shard = name
                ids = np.array(encode(text) if text else [], np.int32)
                terms, counts = np.unique(ids, return_counts=True)
                block.append((doc_id, terms, counts.astype(np.int32), len(ids)))
                tokens += len(ids)
        if block:
            yield from work()

    ordered = sharded.repartition("shard").sortWithinPartitions("shard", "place", "doc_id").select("shard", "doc_id", "text")
    return ordered.mapInArrow(run, _LEFT.format(kind=kind))


def _second_round(left: DataFrame, limits: list[tuple[str, int]], kind: str) -> DataFrame:
    capacities = dict(limits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, key, block, part = None, None, [], 0

        def work() -> Iterator[pa.RecordBatch]:
            index = InvertedIndex([np.array(x[5], np.int64) for x in block], [np.array(x[6], np.int64) for x in block])
            items = [(i, *x[1:]) for i, x in enumerate(block)]
            _boxes(key[0], capacities[key[0]], f"again{key[1]}.{part}", items, index, out, None)
            yield out.batch()

        for batch in batches:
            out = out or _Out(batch.schema.field("doc_id").type, False)
            for name, pool, *item in zip(*(c.to_pylist() for c in batch.columns)):
                if block and ((name, pool) != key or len(block) >= 4 * SHARD_DOCS):
                    yield from work()
                    block, part = [], part + 1 if (name, pool) == key else 0
                key = (name, pool)
                block.append((None, *item))
        if block:
            yield from work()

    sizes = {r[0]: r[1] for r in left.groupBy("pack_name").count().collect()}
    pools = F.create_map(*(F.lit(x) for name, _ in limits for x in (name, -(-sizes.get(name, 0) // SHARD_DOCS) or 1)))
    pooled = left.withColumn("pool", F.pmod(F.xxhash64("shard"), pools[F.col("pack_name")]).cast("int"))
    order = ["pack_name", "pool", "shard", F.xxhash64("doc_id", "terms"), "doc_id", "piece"]
    ordered = pooled.repartition("pack_name", "pool").sortWithinPartitions(*order)
    return ordered.select("pack_name", "pool", "doc_id", "piece", "first_token", "n_tokens", "terms", "counts").mapInArrow(run, _ROW.format(kind=kind))


def packed(docs: DataFrame, limits: list[tuple[str, int]], tokenizer: str = TOKENIZER_PATH) -> DataFrame:
    """The container of each document or piece: (pack_name, container_id, slot, doc_id, piece, first_token, n_tokens).

    ``docs`` has (doc_id, source, text), ``limits`` (name, capacity in tokens). A text is cut only if it alone is
    larger than the capacity: into pieces of the whole capacity and a rest, numbered from 0, that start at
    ``first_token``. Texts without tokens (null, empty) have a row with a null container and 0 tokens. Each row of
    ``docs`` is packed once for each limit, repeated and null ids too; containers are named by shard and number. The
    result does not depend on the partitioning. Limits below one token are an error.
    """
    if any(capacity < 1 for _, capacity in limits):
        raise ValueError("a container must hold at least one token")
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "source", F.col("text").cast("string").alias("text"))
    first = write_stage(_first_round(_shard(rows), limits, tokenizer, kind), "packed")
    names = ["pack_name", "container_id", "slot", "doc_id", "piece", "first_token", "n_tokens"]
    left = first.where(F.col("slot") < 0)
    return first.where(F.col("slot") >= 0).select(*names).unionByName(_second_round(left, limits, kind))
