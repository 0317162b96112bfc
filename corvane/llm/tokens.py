"""Sizes of texts in tokens of a public byte-level BPE; its vocabulary file is read from a path that is a parameter."""

from __future__ import annotations

import base64
import functools

import pyarrow as pa
from pyspark.sql import DataFrame

from corvane.runtime import spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-splitting pattern that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.lru_cache(maxsize=2)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str | None, path: str = VOCABULARY) -> int:
    return len(encoder(path).encode_ordinary(text)) if text else 0


def with_tokens(docs: DataFrame, keep: list[str], path: str = VOCABULARY) -> DataFrame:
    """The columns ``keep`` and n_tokens (0 for a null or empty text)."""
    kept = docs.select(*keep, "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "text") + ", n_tokens int"

    def count(batches):
        enc = encoder(path)
        for t in batches:
            n = [len(enc.encode_ordinary(x)) if x else 0 for x in t.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(t.column(c) for c in keep), pa.array(n, pa.int32())], names=[*keep, "n_tokens"])

    return spread(kept).mapInArrow(count, schema)
