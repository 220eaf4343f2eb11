"""Word-piece ids and counts with a vocabulary file of one piece a line."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


@functools.lru_cache(maxsize=4)
def tokenizer(vocab: str, lowercase: bool = True):
    """The library's tokenizer, made once per worker and vocabulary."""
    from tokenizers.implementations import BertWordPieceTokenizer

    return BertWordPieceTokenizer(vocab, lowercase=lowercase)


def counter(vocab: str, special: bool = False) -> Callable[[], Callable[[str], int]]:
    """What ``atoms.partition`` takes as its token counter."""
    return lambda: lambda text: len(tokenizer(vocab).encode(text, add_special_tokens=special).ids)


def token_ids(text: Column, vocab: str, special: bool = False) -> Column:
    """Ids of a text's word pieces; null for null. ``special`` adds the first and last marks."""

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = tokenizer(vocab)
        for batch in batches:
            yield batch.map(lambda t: None if t is None else known.encode(t, add_special_tokens=special).ids)

    return encode(text)


def count_tokens(text: Column, vocab: str, special: bool = False) -> Column:
    return F.size(token_ids(text, vocab, special))
