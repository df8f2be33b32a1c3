"""Helpers shared by the tests."""

from collections.abc import Iterable


def rows(df, *columns: str) -> list[tuple]:
    """The rows of a DataFrame, sorted, as tuples."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=str)


def same(df, expected: Iterable[tuple]) -> bool:
    return rows(df) == sorted((tuple(e) for e in expected), key=str)


def hard_tables(source: str, out: str, empty: bool) -> str:
    """The tables of a data folder, emptied, or with nulls in every column, repeated rows and extra columns of clashing names."""
    import glob
    import os

    import numpy as np
    import pyarrow as pa
    import pyarrow.parquet as pq

    r = np.random.default_rng(3)
    os.makedirs(out, exist_ok=True)
    for path in glob.glob(f"{source}/*.parquet"):
        t = pq.read_table(path)
        if os.path.basename(path) not in ("mix_targets.parquet", "pack_limits.parquet"):
            if empty:
                t = t.slice(0, 0)
            else:
                gone = {c: r.random(t.num_rows) < 0.06 for c in t.column_names}
                t = pa.table({c: pa.array([None if g else v for g, v in zip(gone[c], t[c].to_pylist())], t.schema.field(c).type) for c in t.column_names})
                t = pa.concat_tables([t, t.slice(0, max(1, t.num_rows // 5)), t.slice(0, 3)])
                for extra in ("salt", "target", "kind", "cid", "rank", "score", "look", "raw", "record_key", "holder", "words", "query_id", "n", "_v"):
                    if extra not in t.column_names:
                        t = t.append_column(extra, pa.array(["x"] * t.num_rows))
        pq.write_table(t, f"{out}/{os.path.basename(path)}")
    return out
