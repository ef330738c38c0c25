"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Folder of the vocabulary files; a parameter, never copied.
VOCABULARIES = "/opt/tokenizers"
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Characters after which a long text is cut, at the next place where the tokenizer's pattern cuts in any case: its time would
#: otherwise grow faster than the text.
PIECE = 20_000
#: After a letter or digit before any other mark, between letters and digits, and before blanks: no token reaches across.
_CUT = r"(?<=[\p{L}\p{N}])(?=[^\s\p{L}\p{N}])|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})|(?<=\S)(?=\s)"


def _encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    # the usual pattern of byte-level vocabularies: contractions, words, numbers, marks and blanks apart
    pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("sizes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _pieces(text: str, piece: int | None = None) -> Iterator[str]:
    import regex

    cut, at = regex.compile(_CUT), 0
    while m := cut.search(text, at + (piece or PIECE)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def sized(documents: DataFrame, keep: list[str], text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``keep`` columns and ``tokens``, the whole text's size; a null text has 0 tokens."""
    path = vocabulary or os.path.join(VOCABULARIES, VOCABULARY)
    source = documents.select(*keep, documents[text].alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]) + ", tokens bigint"

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for b in batches:
            n = [sum(len(encoder.encode_ordinary(p)) for p in _pieces(t)) if t else 0 for t in b.column("__text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns - 1)), pa.array(n, pa.int64())], names=[*b.schema.names[:-1], "tokens"])

    return source.mapInArrow(measure, schema)
