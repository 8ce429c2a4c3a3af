"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Texts up to this many characters are remembered by a worker, as many are repeated.
REMEMBER, REMEMBERED = 4000, 20_000


@lru_cache(maxsize=2)
def _encoding(path: str):  # noqa: ANN202
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(path: str, text: str, seen: dict[str, int]) -> int:
    if not text:
        return 0
    short = len(text) <= REMEMBER
    if short and text in seen:
        return seen[text]
    n = len(_encoding(path).encode_ordinary(text))
    if short and len(seen) < REMEMBERED:
        seen[text] = n
    return n


def with_token_counts(docs: DataFrame, keep: list[str], text: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``keep`` and ``n_tokens`` of every document; null and empty texts have 0. No shuffle."""
    schema = docs.select(*keep).schema
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, int] = {}
        for pdf in batches:
            out = pdf[keep].copy()
            out["n_tokens"] = [count_tokens(vocabulary, t, seen) for t in pdf["__text"]]
            yield out

    return docs.select(*keep, F.col(text).alias("__text")).mapInPandas(count, f"{ddl}, n_tokens bigint")
