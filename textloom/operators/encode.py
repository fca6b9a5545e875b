"""Ids of subword tokenizers, and vectors of texts from those of their tokens."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let

#: How many ids a text gets at most, the special ones included, and what goes before texts.
MOST_IDS = 512
PREFIXES = {"query": "query: ", "passage": "passage: "}


@cache
def tokenizer(path: str, most: int = MOST_IDS):
    """A tokenizer file (word pieces or a unigram model) whose texts begin and end with its special tokens, cut to ``most`` ids."""
    from tokenizers import Tokenizer, processors

    with open(path, encoding="utf-8") as f:
        kind = json.load(f)["model"]["type"]
    ends = {"WordPiece": ("[CLS]", "[SEP]"), "Unigram": ("<s>", "</s>")}
    if kind not in ends:
        raise ValueError(f"{path} holds a {kind} model, not WordPiece or Unigram")
    out = Tokenizer.from_file(path)
    ids = {t: out.token_to_id(t) for t in ends[kind]}
    if None in ids.values():
        raise ValueError(f"{path} lacks one of {', '.join(ids)}")
    a, b = ids
    out.post_processor = processors.TemplateProcessing(single=f"{a} $A {b}", special_tokens=list(ids.items()))
    out.enable_truncation(most)
    out.no_padding()
    return out


def encode(df: DataFrame, path: str, text: str = "text", out: str = "ids", most: int = MOST_IDS) -> DataFrame:
    """df with the ids of a text by the tokenizer file at ``path``, which every executor can read.

    The first ``most`` ids count, the closing one among them; null texts have null ids, empty ones the two special ids.
    """

    @F.pandas_udf("array<int>")
    def ids(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t = tokenizer(path, most)
        for s in parts:
            found = iter(t.encode_batch([x for x in s if x is not None]))
            yield pd.Series([None if x is None else next(found).ids for x in s], dtype=object)

    return df.withColumn(out, ids(F.col(text)))


def prefixed(kind: str, text: Column) -> Column:
    """V2: a text as a query or a passage."""
    return F.concat(F.lit(PREFIXES[kind]), text)


def pooled(tokens: Column, mask: Column) -> Column:
    """The mean of the token vectors under the mask, of length 1; all zero if none is or the mean is zero."""
    kept = F.transform(F.filter(F.arrays_zip(tokens.alias("v"), mask.alias("m")), lambda x: F.coalesce(x["m"], F.lit(0)) != 0), lambda x: x["v"])
    zero = F.transform(tokens[0], lambda x: F.lit(0.0))
    total = let(kept, lambda k: F.aggregate(k, zero, lambda s, v: F.zip_with(s, v, lambda a, b: a + b), lambda s: F.transform(s, lambda a: a / F.greatest(F.size(k), F.lit(1)))))
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return let(total, lambda v: let(norm(v), lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(x))))


def usable(header: DataFrame, model: str, width: int) -> DataFrame:
    """V3: headers (model, width) of stored vectors, with whether they fit the model in use; others must be embedded anew."""
    return header.withColumn("usable", F.coalesce((F.col("model") == model) & (F.col("width") == width), F.lit(False)))


def upsert(vectors: DataFrame, fresh: DataFrame, gone: DataFrame) -> DataFrame:
    """V4: vectors by vec_id, with fresh ones in place of old ones, and without those gone; a fresh one stays."""
    left = fresh.select("vec_id").unionByName(gone.select("vec_id"))
    return vectors.join(left, "vec_id", "left_anti").unionByName(fresh.select(*vectors.columns))
