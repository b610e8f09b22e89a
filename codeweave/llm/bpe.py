"""Byte-level BPE by the tiktoken library with a local rank file.

Long texts are cut where the pattern must begin a new match anyway (a lone space
between two other characters), so pieces never change; ids decode to raw bytes.
Nulls and empty texts have no ids. Repeated rows give repeated rows. Text without
a safe boundary is encoded whole.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, unused

#: Characters after which a long text is cut at the next safe boundary.
CUT = 1 << 16
_SAFE = re.compile(r"(?<=\S) (?=\S)")


@lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str):
    """The tiktoken encoding without special tokens, once for each worker process."""
    import tiktoken

    with open(rank_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, cut: int = CUT) -> Iterator[str]:
    """The text in parts that end before a lone space, at least `cut` characters each but the last."""
    begin = 0
    while len(text) - begin > cut:
        at = _SAFE.search(text, begin + cut)
        if not at:
            break
        yield text[begin : at.start()]
        begin = at.start()
    yield text[begin:] if begin else text


def encode_text(enc, text: str, cut: int = CUT) -> np.ndarray:
    if len(text) <= cut:
        return enc.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)
    return np.concatenate([enc.encode_to_numpy(p, disallowed_special=()).astype("<u4", copy=False) for p in pieces(text, cut)])


def encode(df: DataFrame, rank_file: str, pattern: str, *, text_col: str = "text", keep: list[str] | None = None, cut: int = CUT, decode: bool = False) -> DataFrame:
    """Columns `keep` (default: all but the text) with n_tokens long, token_ids binary (little-endian unsigned 32-bit) and,
    if `decode`, decoded binary: the bytes that the ids stand for. Kept columns named like these are replaced.

    Texts of over `cut` characters are cut before a lone space between two other characters, which is safe for patterns like the
    public one, in which such a space begins a match; for another kind of pattern give a `cut` beyond the longest text.
    rank_file must be at the same path on every executor. One narrow pass; memory is bounded by one text and BATCH_BYTES."""
    new = ["n_tokens", "token_ids", *["decoded"] * decode]
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() not in {text_col.lower(), *new}]
    text = unused(keep, "text")[0]
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)
        table = [enc.decode_single_token_bytes(i) for i in range(enc.n_vocab)] if decode else []
        for whole in batches:
            for batch in slices(whole, text):
                ids = [encode_text(enc, t or "", cut) for t in batch.column(text).to_pylist()]
                out = [batch.column(c) for c in keep]
                out += [pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())]
                if decode:
                    out.append(pa.array([b"".join(map(table.__getitem__, x.tolist())) for x in ids], pa.binary()))
                yield pa.RecordBatch.from_arrays(out, names=[*keep, *new])

    schema = source.drop(text).schema.add("n_tokens", "long").add("token_ids", "binary")
    return source.mapInArrow(run, schema.add("decoded", "binary") if decode else schema)


def decode(df: DataFrame, rank_file: str, pattern: str, *, ids_col: str = "token_ids") -> DataFrame:
    """df with decoded binary, the raw bytes of the ids (null: null)."""
    columns = [c for c in df.columns if c != "decoded"]
    source = df.select(*[F.col(f"`{c}`") for c in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)
        table = [enc.decode_single_token_bytes(i) for i in range(enc.n_vocab)]
        for whole in batches:
            for batch in slices(whole, ids_col):
                texts = [None if x is None else b"".join(map(table.__getitem__, np.frombuffer(x, "<u4").tolist())) for x in batch.column(ids_col).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], names=[*columns, "decoded"])

    return source.mapInArrow(run, df.select(*source.columns).schema.add("decoded", "binary"))
