"""Encoding of a corpus with a public byte-level BPE tokenizer (tree concatenation).

A short text is encoded at once. A long one is halved until the leaves are short, the leaves are encoded on
their own, and each join is repaired: a window of tokens around it is encoded again and grows until its first
token equals the left half's and its last the right half's. A token sequence is the BPE encoding of its bytes
exactly if every neighbouring pair is the encoding of its own bytes, so agreement on a token at either end
proves the whole. Window edges lie only where the pre-tokenizer's decisions can't depend on what lies beyond.

Very long texts (``spread_chars``) are cut into leaves that travel as rows of their own, so that one document
is encoded by many tasks; their joins are repaired when the leaves meet again.

Defined results: a null text and an empty text both have the empty list. Text that looks like a special token
is plain text. Repeated rows are encoded each. Extra columns of the input are not read.
"""

from __future__ import annotations

import base64
import os
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKENIZERS = "/opt/tokenizers"
#: The published pre-tokenization pattern of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of a leaf, and of a text beyond which its leaves are encoded by tasks of their own.
LEAF_CHARS = 32_768
SPREAD_CHARS = 4 * LEAF_CHARS


@lru_cache(maxsize=4)
def encoding(name: str = "byte_bpe_50k", folder: str = TOKENIZERS):
    """The tokenizer, once per Python worker."""
    import tiktoken

    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _kind(c: str) -> str:
    """The pattern's class of a character: letter, number, space, other; `X` where engines disagree about white space, or for what is no whole character."""
    if c == "\ufffd" or "\x1c" <= c <= "\x1f":
        return "X"
    return "S" if c.isspace() else {"L": "L", "N": "N"}.get(unicodedata.category(c)[0], "O")


def _edge(before: str, after: str) -> bool:
    """Whether pre-tokens on either side of this place are the same when the text is cut here.

    A change of class ends a pre-token, but for a space, which joins what follows, and an apostrophe, which may begin a contraction; within a run
    of one class the pre-token goes on whatever lies farther, unless a contraction reaches into it.
    """
    if not before or not after:
        return True
    a, b = _kind(before[-1]), _kind(after[0])
    if a in "SX" or b == "X":
        return False
    if b == "S":
        return True
    if "'" in before[-3:] and b == "L":
        return False
    return a != b or after[0] != "'"


def join(enc, left: list[int], right: list[int]) -> list[int]:
    """The encoding of the two texts' concatenation from their encodings."""
    if not left or not right:
        return [*left, *right]
    w = 8
    within = lambda token: enc.decode_bytes([token])[0] & 0xC0 == 0x80  # noqa: E731  it begins inside a character
    while True:
        i, j = max(0, len(left) - w), min(len(right), w)
        while i > 0 and within(left[i]):
            i -= 1
        while j < len(right) and within(right[j]):
            j += 1
        context, tail = enc.decode_bytes(left[max(0, i - 16) : i]), enc.decode_bytes(right[j : j + 16])
        text = enc.decode_bytes(left[i:] + right[:j]).decode()
        before, after = context.decode(errors="replace"), tail.decode(errors="replace")
        ids = enc.encode_ordinary(text)
        at_left = i == 0 or (ids[0] == left[i] and _edge(before, text))
        at_right = j == len(right) or (ids[-1] == right[j - 1] and _edge(text, after))
        if at_left and at_right:
            return [*left[:i], *ids, *right[j:]]
        w *= 2


def encode(enc, text: str, leaf: int = LEAF_CHARS) -> list[int]:
    """The ids of a text, by halves where it is longer than a leaf."""
    if len(text) <= leaf:
        return enc.encode_ordinary(text)
    parts = [enc.encode_ordinary(text[i : i + leaf]) for i in range(0, len(text), leaf)]
    return join_all(enc, parts)


def join_all(enc, parts: list[list[int]]) -> list[int]:
    """Joins neighbours level by level, as a tree, so that no id is copied more than log(n) times."""
    while len(parts) > 1:
        parts = [join(enc, *parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0] if parts else []


def _list_array(buffers: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(buffers) + 1, dtype=np.int32)
    np.cumsum([len(b) for b in buffers], out=offsets[1:])
    values = np.concatenate(buffers) if buffers else np.empty(0, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32, copy=False)))


def _ids_of(enc, text: str | None) -> np.ndarray:
    if not text:
        return np.empty(0, dtype=np.int32)
    if len(text) <= LEAF_CHARS:
        return np.frombuffer(enc._core_bpe.encode_to_tiktoken_buffer(text, set()), dtype=np.uint32).view(np.int32)
    return np.asarray(encode(enc, text), dtype=np.int32)


def _encoder(name: str, folder: str, id_col: str, count_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(name, folder)
        for b in batches:
            texts = b.column("text")
            for at in range(0, b.num_rows, 2048):  # bounds what a task holds
                ids = [_ids_of(enc, t) for t in texts.slice(at, 2048).to_pylist()]
                out = pa.array([len(x) for x in ids], pa.int64()) if count_only else _list_array(ids)
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(at, 2048) for c in b.schema.names if c != "text"), out], [*(c for c in b.schema.names if c != "text"), "n_tokens" if count_only else "ids"])

    return run


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS, count_only: bool = False, keep: tuple[str, ...] = (), spread_chars: int = SPREAD_CHARS) -> DataFrame:
    """Each row's ``ids`` (ARRAY<INT>), or with ``count_only`` its ``n_tokens``.

    The result has ``id_col``, the columns of ``keep``, and ids or n_tokens. Texts of up to ``spread_chars``
    characters need no shuffle; longer ones are encoded as leaves by many tasks and put together per row.
    """
    base = df.select(F.col(id_col).alias("_id"), *(F.col(c).alias(f"_k_{c}") for c in keep), F.col(text_col).alias("text"))
    keys = [c for c in base.columns if c != "text"]
    fields = [base.schema[c] for c in keys]
    value = T.StructField("n_tokens", T.LongType()) if count_only else T.StructField("ids", T.ArrayType(T.IntegerType()))
    long = F.length("text") > spread_chars
    short = base.filter(~F.coalesce(long, F.lit(False))).mapInArrow(_encoder(tokenizer, folder, "_id", count_only), T.StructType([*fields, value]))

    leaf_chars = min(spread_chars, LEAF_CHARS)
    leaves = (
        base.filter(long)
        .withColumn("_row", F.monotonically_increasing_id())
        .select("*", F.posexplode(F.expr(f"transform(sequence(0, CAST((length(text) - 1) div {leaf_chars} AS INT)), i -> substring(text, i * {leaf_chars} + 1, {leaf_chars}))")).alias("_leaf", "_part"))
        .drop("text")
        .withColumnRenamed("_part", "text")
        .repartition("_row", "_leaf")
    )
    leaf_ids = leaves.mapInArrow(_encoder(tokenizer, folder, "_id", False), T.StructType([*fields, T.StructField("_row", T.LongType()), T.StructField("_leaf", T.IntegerType()), T.StructField("ids", T.ArrayType(T.IntegerType()))]))

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(tokenizer, folder)
        for b in batches:
            whole = [np.asarray(join_all(enc, [x["ids"] for x in row]), dtype=np.int32) for row in b.column("_parts").to_pylist()]
            out = pa.array([len(x) for x in whole], pa.int64()) if count_only else _list_array(whole)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keys), out], [*keys, value.name])

    grouped = leaf_ids.groupBy("_row").agg(*(F.first(c).alias(c) for c in keys), F.array_sort(F.collect_list(F.struct("_leaf", "ids"))).alias("_parts")).drop("_row")
    long_ids = grouped.mapInArrow(together, T.StructType([*fields, value]))
    both = short.unionByName(long_ids)
    return both.select(F.col("_id").alias(id_col), *(F.col(f"_k_{c}").alias(c) for c in keep), value.name)
