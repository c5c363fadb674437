"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
RANKS = "byte_bpe_50k.tiktoken"
# Fixed value: the pattern that cuts texts before this vocabulary applies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


@lru_cache(maxsize=4)
def encoder(path: str):
    """The byte-level encoder of a ranks file, once per worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(df: DataFrame, text: str, keep: list[str], path: str = f"{TOKENIZERS}/{RANKS}") -> DataFrame:
    """keep + (tokens): null and empty texts have 0."""
    schema = T.StructType([*[df.schema[k] for k in keep], T.StructField("tokens", T.LongType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        for b in batches:
            o = b[keep].copy()
            o["tokens"] = [len(enc.encode_ordinary(t)) if t else 0 for t in b["__text"]]
            yield o

    return df.select(*keep, F.col(text).alias("__text")).mapInPandas(run, schema)
