"""Sizes of texts in tokens of a public tokenizer, whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The vocabulary used where none is named; its file is looked up in the installed package of public tokenizers.
VOCABULARY = "byte_bpe_50k.tiktoken"


@lru_cache(maxsize=2)
def encoding(path: str):
    """The byte-level encoder of a file of ranks; a bare name is one of the installed public vocabularies."""
    import public_tokenizers
    import tiktoken

    with open(path if "/" in path else public_tokenizers.path(path), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """Tokens of a whole text; null and empty texts have none."""

    @F.pandas_udf("int")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = encoding(vocabulary)
        for part in parts:
            yield pd.Series([len(t) for t in coder.encode_ordinary_batch(part.fillna("").tolist(), num_threads=1)], dtype="int32")

    return count(text)
