"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the splitting pattern of the byte-level vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def encoding(path: str):
    return encoding_of(Path(path).read_bytes())


@lru_cache(maxsize=2)
def encoding_of(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", tokenizer: str = TOKENIZER, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, n_tokens, *carry): the whole text's size; null and empty texts have 0 tokens. The texts are read once and not moved."""

    vocabulary = Path(tokenizer).read_bytes()  # sent along, so executors need no file; some 800 KB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding_of(vocabulary).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), *(batch.column(i) for i in range(2, batch.num_columns))], ["id", "n_tokens", *carry])

    rows = df.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"), *(F.col(c) for c in carry))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, n_tokens bigint" + "".join(f", {c} {rows.schema[c].dataType.simpleString()}" for c in carry)
    return rows.mapInArrow(run, schema)
