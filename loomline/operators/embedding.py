"""The embedder hook: texts to vectors by a model that is opened once a Python worker."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable, Iterator, Sequence
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

#: A batch function: an array of shape (texts, dimension) for a list of texts.
Embed = Callable[[list[str]], Sequence]


def _opened(key: str, make: bytes):
    """The model of a key, opened when a worker first asks for it. Functions come to a worker
    anew with every task, so models are kept at a module that stays; the last one stays."""
    held = sys.__dict__.setdefault("_loomline_models", {})
    if key not in held:
        held.clear()
        held[key] = cloudpickle.loads(make)()
    return held[key]


def batches_of(texts: list[str], max_rows: int, max_bytes: int):
    """Slices of consecutive texts of at most max_rows and max_bytes; a longer text is alone."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t.encode("utf-8", "replace"))
        if i > start and (i - start >= max_rows or size + n > max_bytes):
            yield texts[start:i]
            start, size = i, 0
        size += n
    if start < len(texts):
        yield texts[start:]


def embed(df: DataFrame, open_model: Callable[[], Embed], dim: int, text: str = "text", out: str = "embedding", max_rows: int = 256, max_bytes: int = 4 << 20) -> DataFrame:
    """`df` with a column `out` of `dim` doubles, or with it replaced.

    open_model() gives the model, a function of a list of texts; it is called once in each Python
    worker that has a text, not once a batch or task. The model is asked for batches of at most
    max_rows texts and max_bytes of UTF-8 (a longer text is a batch of its own, whole), and each
    distinct text of an Arrow batch once. A result that isn't of shape (texts, dim), or that isn't
    finite, fails the query. Null texts have a null vector and aren't asked; empty texts are asked.
    Repeated rows get equal vectors. An empty table opens no model. Other columns pass unchanged.
    """
    if dim < 1:
        raise ValueError("dim must be 1 or more")
    key, made = uuid.uuid4().hex, cloudpickle.dumps(open_model)
    ask = _asker(key, made, dim, max_rows, max_bytes)
    at = next((c for c in df.columns if c.lower() == text.lower()), None)
    if at is None:
        raise ValueError(f"no column {text}")
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() != out.lower()]
    vectors = F.arrow_udf(ask, ArrayType(DoubleType()))
    return df.select(*kept, vectors(F.col(f"`{at}`").cast("string")).alias(out))


def _asker(key: str, made: bytes, dim: int, max_rows: int, max_bytes: int):
    def ask(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            distinct = column.dictionary_encode()
            texts, found = distinct.dictionary.to_pylist(), []
            for some in batches_of(texts, max_rows, max_bytes):
                got = np.asarray(_opened(key, made)(some), dtype=np.float64)
                if got.shape != (len(some), dim):
                    raise ValueError(f"the embedder gave {got.shape} for {len(some)} texts of dimension {dim}")
                if not np.isfinite(got).all():
                    raise ValueError("the embedder gave a value that isn't finite")
                found.append(got)
            rows = np.concatenate(found) if found else np.zeros((0, dim))
            flat = pa.FixedSizeListArray.from_arrays(pa.array(rows.reshape(-1)), dim).cast(pa.list_(pa.float64()))
            yield flat.take(distinct.indices)

    return ask


def hash_embedder(dim: int) -> Callable[[], Embed]:
    """A model that needs no weights: value k is the first 32 bits of md5("k:text") on -1 to 1.
    Equal in any engine and run; texts that differ at all are unrelated."""

    def open_model():
        def one(text: str) -> list[float]:
            return [int(md5(f"{k}:{text}".encode()).hexdigest()[:8], 16) / 2**31 - 1 for k in range(dim)]

        return lambda texts: [one(t) for t in texts]

    return open_model
