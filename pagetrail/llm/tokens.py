"""Sizes of texts in tokens of a byte-level BPE vocabulary file."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the vocabulary splits text before merging (fixed value of the public vocabulary).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@cache
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _sizes(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    encode = encoder(path).encode_ordinary
    for batch in batches:
        tokens, prompts = [], []
        for text in batch.column("text").to_pylist():
            tokens.append(len(encode(text)) if text else 0)
            line = text.find("\n") + 1 if text else 0
            prompts.append(len(encode(text[:line])) if 0 < line < len(text or "") else 0)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("source"), pa.array(tokens, pa.int64()), pa.array(prompts, pa.int64())],
            names=["doc_id", "source", "tokens", "prompt_tokens"],
        )


def token_sizes(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, tokens, prompt_tokens) of every document.

    ``prompt_tokens`` are those of the first line where a text has several, else 0. Null and empty
    texts have 0 tokens. ``source`` comes out trimmed and lower-cased.
    """
    slim = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.lower(F.trim("source")).alias("source"), "text")
    return slim.mapInArrow(lambda it: _sizes(it, vocabulary), "doc_id bigint, source string, tokens bigint, prompt_tokens bigint")
