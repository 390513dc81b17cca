"""Optional tokenizer hook (Arrow-batched pandas UDFs).

The default reasoning-token count is the native whitespace count
(``whitespace_token_count``). When a real tokenizer is wanted, these UDFs
load a ``tokenizers`` JSON file once per task (the iterator form) and
process whole Arrow batches. The file path must be readable from every
executor.
"""

from __future__ import annotations

from typing import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _load(path: str):
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


def token_count_udf(tokenizer_path: str):
    """Column -> long: number of tokens (no special tokens); 0 for ''."""

    @F.pandas_udf(T.LongType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tok = _load(tokenizer_path)
        for s in batches:
            texts = s.fillna("").tolist()
            enc = tok.encode_batch(texts, add_special_tokens=False)
            yield pd.Series([len(e.ids) if t else 0 for e, t in zip(enc, texts)])

    return count


def token_texts_udf(tokenizer_path: str):
    """Column -> array<string>: each token's text, cut at token start
    offsets so that the pieces concatenate back to the input exactly (the
    property the loss mask relies on)."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def pieces(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tok = _load(tokenizer_path)
        for s in batches:
            texts = s.fillna("").tolist()
            out = []
            for e, t in zip(tok.encode_batch(texts, add_special_tokens=False), texts):
                starts = [o[0] for o in e.offsets]
                if not starts:
                    out.append([t] if t else [])
                    continue
                starts[0] = 0
                bounds = starts + [len(t)]
                out.append([t[bounds[i]:bounds[i + 1]] for i in range(len(starts))])
            yield pd.Series(out)

    return pieces


def count_with(udf) -> "callable":
    """Adapt a token-count UDF to the ``token_count`` argument of
    ``grade_traces`` (a Column -> Column function)."""
    return lambda c: udf(c) if isinstance(c, Column) else udf(F.col(c))


def token_ids_udf(tokenizer_path: str):
    """Column -> array<int>: token ids (no special tokens)."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tok = _load(tokenizer_path)
        for s in batches:
            texts = s.fillna("").tolist()
            yield pd.Series([list(e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)])

    return ids


def encode_for_mask(df, prompt_col: str, response_col: str, tokenizer_path: str):
    """Prompt + response text -> ``token_texts`` and ``labels`` for the loss
    mask: prompt labels are -100, response labels are the response token ids
    (the shape a supervised-training encoder produces). Tokenization runs in
    Arrow-batched pandas UDFs; the rest stays in Spark expressions."""
    texts, ids = token_texts_udf(tokenizer_path), token_ids_udf(tokenizer_path)
    d = df.withColumns({"_pt": texts(F.col(prompt_col)), "_rt": texts(F.col(response_col)),
                        "_rid": ids(F.col(response_col))})
    return (d.withColumns({"token_texts": F.concat("_pt", "_rt"),
                           "labels": F.concat(F.array_repeat(F.lit(-100), F.size("_pt")), F.col("_rid"))})
            .drop("_pt", "_rt", "_rid"))
