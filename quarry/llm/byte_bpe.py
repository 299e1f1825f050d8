"""Byte-level BPE: overlapping chunk encoding, and decoding.

Texts of up to `chunk` code points are one chunk. Longer ones are cut into chunks that overlap, which are
pre-tokenised in parallel, whichever executor has them. The pattern looks only ahead, never back, so two
runs that both have a boundary at a position agree from there on. It looks LOOKAHEAD code points ahead at most
(a contraction cut short isn't one), so a chunk's boundaries in its last LOOKAHEAD count only where the text ends too.
Stitching takes the first shared position in each overlap; where none is found (one run of letters as long as
the overlap), it scans on from the last boundary that is certain. Then the pieces are encoded by rank. Decoding joins
the bytes of the ids.

Nulls and odd rows: a null text is an empty one (no ids, the digest of nothing). Rows that repeat a
(doc_id, text) each give their row; a task cuts such a text once. Rows are told apart by nothing else, so there are no ties.
A null doc_id stays null. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.scratch import small_batches
from quarry.llm.stores import Store

CHUNK, OVERLAP = 32_768, 1_024
#: Code points from the start of a match, and beyond its end, that the pattern may look at.
LOOKAHEAD = 3


class ByteBPE(Store):
    """piece -> its ids as little-endian unsigned 32-bit bytes, encoded on first use."""

    def __init__(self, ranks_file: str, pattern: str):
        super().__init__()
        import tiktoken

        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.core = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.find = regex.compile(pattern).finditer
        self.pieces = regex.compile(pattern).findall
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for b, i in ranks.items():
            self.bytes_of[i] = b

    def __missing__(self, piece: str) -> bytes:
        out = self.old.get(piece)
        if out is None:
            out = np.asarray(self.core._encode_single_piece(piece.encode("utf-8")), "<u4").tobytes()
        return self.keep(piece, out, 33 + len(out))

    def encode_pieces(self, pieces: list[str]) -> bytes:
        return b"".join(map(self.__getitem__, pieces))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def boundaries(self, chunk: str) -> np.ndarray:
        """The starts of the pieces of a chunk."""
        return np.fromiter((m.start() for m in self.find(chunk)), np.int64)

    def certain(self, text: str, start: int, end: int, own: np.ndarray) -> np.ndarray:
        """Those of a chunk's boundaries that what follows the chunk can't change, if its first one is right."""
        return own if end >= len(text) else own[(own <= end - LOOKAHEAD) | (own == start)]

    def stitch(self, text: str, chunks: list[tuple[int, int, np.ndarray]]) -> list[str]:
        """The pieces of text, from (start, end, boundaries in the chunk) of its chunks in order.

        A chunk's boundaries may be trusted only from one on that is known to be right. A chunk that is one piece has none
        to share; what it holds is scanned with the next that has.
        """
        start, end, own = chunks[0]
        sure = self.certain(text, start, end, own + start)
        for k, (start, end, own) in enumerate(chunks[1:], 2):
            own = self.certain(text, start, end, own + start)
            shared = np.intersect1d(sure, own, assume_unique=True)
            if len(shared):
                at = int(shared[0])
                sure = np.concatenate([sure[sure < at], own[own >= at]])
            elif len(own) > 1 or k == len(chunks):
                at = int(sure[-1])
                sure = np.concatenate([sure[:-1], self.certain(text, at, end, at + self.boundaries(text[at:end]))])
        cuts = [*sure.tolist(), len(text)]
        return [text[a:b] for a, b in zip(cuts, cuts[1:])]


_CODERS: dict[tuple[str | None, str | None], ByteBPE] = {}


def coder(ranks_file: str | None = None, pattern: str | None = None) -> ByteBPE:
    if (ranks_file, pattern) not in _CODERS:
        import public_tokenizers as known

        _CODERS[ranks_file, pattern] = ByteBPE(ranks_file or known.path("byte_bpe_50k.tiktoken"), pattern or known.PATTERN)
    return _CODERS[ranks_file, pattern]


def cut(text: str, chunk: int, overlap: int) -> Iterator[tuple[int, str]]:
    for at in range(0, max(1, len(text)), chunk):
        yield at, text[at : at + chunk + overlap]


def encode_table(docs: DataFrame, finish: Callable[[ByteBPE, bytes], tuple], schema: str, arrow: list[pa.DataType], chunk: int = CHUNK, overlap: int = OVERLAP, ranks_file: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id and what `finish` makes of the coder and the ids of each whole text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = [x.strip().split()[0] for x in schema.split(",")]
    pair = small_batches(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    names = ["doc_id", "key", "task", "n", "at", "part"]

    def dealt_types(b: pa.RecordBatch) -> list[pa.DataType]:
        return [b.column(0).type, pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string()]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(ranks_file, pattern)
        for b in batches:
            rows = [finish(bpe, bpe.encode_pieces(bpe.pieces(t))) for t in b.column(1).to_pylist()]
            cols = list(zip(*rows)) or [[]] * len(fields)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, arrow))], names=["doc_id", *fields])

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each text's chunks once, and at the end a row of n = -1 per text whose `at` is the number of its rows."""
        rows: Counter = Counter()
        for b in batches:
            for i, t, key, task in zip(*(c.to_pylist() for c in b.columns)):
                rows[i, key, task] += 1
                if rows[i, key, task] > 1:
                    continue
                for n, (at, part) in enumerate(cut(t, chunk, overlap)):
                    yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((i, key, task, n, at, part), dealt_types(b))], names=names)
        for (i, key, task), n in rows.items():
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((i, key, task, -1, n, ""), dealt_types(b))], names=names)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(ranks_file, pattern)
        for b in batches:
            found = [bpe.boundaries(t).tolist() for t in b.column("part").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.list_(pa.int64()))], names=[*b.schema.names, "cuts"])

    def join(group: pd.DataFrame) -> pd.DataFrame:
        bpe = coder(ranks_file, pattern)
        group = group.sort_values("n")
        copies = int(group["at"].iloc[0])
        group = group.iloc[1:]
        parts = list(zip(group["at"], group["part"], group["cuts"]))
        text = "".join(p[:chunk] for _, p, _ in parts)
        pieces = bpe.stitch(text, [(at, at + len(p), np.asarray(c, np.int64)) for at, p, c in parts])
        row = finish(bpe, bpe.encode_pieces(pieces))
        return pd.DataFrame([(group["doc_id"].iloc[0], *row)] * copies, columns=["doc_id", *fields])

    short = pair.filter(F.length("text") <= chunk).mapInArrow(whole, f"doc_id {kind}, {schema}")
    rows = f"doc_id {kind}, key long, task int, n long, at long, part string"
    # of one task's rows, so that a text that repeats all over the table meets itself in no group
    parts = pair.filter(F.length("text") > chunk).select("doc_id", "text", F.xxhash64("text").alias("key"), F.spark_partition_id().alias("task")).mapInArrow(chunks, rows)
    dealt = parts.repartition("doc_id", "key", "task", "n").mapInArrow(split, f"{rows}, cuts array<long>")
    long = dealt.groupBy("doc_id", "key", "task").applyInPandas(join, f"doc_id {kind}, {schema}")
    return short.unionByName(long)


def encode(docs: DataFrame, **options: object) -> DataFrame:
    """doc_id and ids (binary: little-endian unsigned 32-bit) per document."""
    return encode_table(docs, lambda bpe, ids: (ids,), "ids binary", [pa.binary()], **options)


def decode(tokens: DataFrame, ranks_file: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id and the decoded bytes of a table (doc_id, ids binary); null ids decode to nothing."""
    kind = tokens.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(ranks_file, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([bpe.decode(x or b"") for x in b.column(1).to_pylist()], pa.binary())], names=["doc_id", "bytes"])

    return small_batches(tokens).select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, bytes binary")


def round_trip(docs: DataFrame, **options: object) -> DataFrame:
    """Per document: n_tokens, and SHA-256 of the ids and of the bytes they decode to."""

    def digest(bpe: ByteBPE, ids: bytes) -> tuple[int, str, str]:
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()

    return encode_table(docs, digest, "n_tokens long, ids_sha256 string, decoded_sha256 string", [pa.int64(), pa.string(), pa.string()], **options)
