"""Token counts by a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The rank file of a byte-level BPE; any file of that form will do.
TOKENIZER_PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges of these rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoder(path: str = TOKENIZER_PATH) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def counted(docs: DataFrame, keys: list[str], text: str, path: str = TOKENIZER_PATH) -> DataFrame:
    """(keys..., n_tokens) of each row; null and empty texts have 0 tokens. Special tokens in a text are ordinary text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode_ordinary
        for batch in batches:
            sizes = np.fromiter((len(encode(t)) if t else 0 for t in batch.column(len(keys)).to_pylist()), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(sizes)], [*keys, "n_tokens"])

    schema = ", ".join(f"{k} {docs.schema[k].dataType.simpleString()}" for k in keys) + ", n_tokens bigint"
    return docs.select(*keys, F.col(text).cast("string").alias("_text")).mapInArrow(run, schema)
