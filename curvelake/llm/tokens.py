"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: the tokenizer's file of ranks on the driver, from where Spark sends it to the executors
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges of the rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def _tokenizer(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def with_token_counts(
    df: DataFrame, id_column: str, text_column: str, carry: list[str] | None = None, tokenizer: str = TOKENIZER, pattern: str = PATTERN, variety: bool = False
) -> DataFrame:
    """``(id, *carry, n_tokens)``: the size of each whole text; 0 for an empty text, rows with a null text or id are left out.

    ``tokenizer`` is a file of ranks; strings of special tokens in a text count as ordinary text. With
    ``variety`` also ``different`` and ``pairs``: the different tokens, and different pairs of neighbours.
    """
    carry = carry or []
    rows = df.select(F.col(id_column).cast("long").alias("id"), *carry, F.col(text_column).alias("text")).where("id is not null and text is not null")
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.drop("text").schema) + ", n_tokens bigint" + ", different bigint, pairs bigint" * variety
    df.sparkSession.sparkContext.addFile(tokenizer)
    name = os.path.basename(tokenizer)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _tokenizer(SparkFiles.get(name), pattern).encode_ordinary
        for b in batches:
            sizes = []
            for text in b["text"]:
                t = encode(text)
                sizes.append((len(t), len(set(t)), len(set(zip(t, t[1:])))) if variety else (len(t),))
            columns = ["n_tokens", "different", "pairs"][: 1 + 2 * variety]
            yield b.drop(columns="text").assign(**dict(zip(columns, np.array(sizes, np.int64).reshape(-1, len(columns)).T)))

    return rows.mapInPandas(count, kind)
