"""Token-id output: a wavelet matrix per shard.

Documents are put in ascending doc_id order by range, encoded, closed with an end id each, and packed into
shards of about `shard_tokens` ids (a document is never split). Each shard becomes one compressed file image
that answers access, rank (count up to a position) and select (place of the k-th occurrence) on its
own. Images are stored through Spark's writer, one per row of a Parquet table: on a remote store Python
workers can't open paths, and the writer's commit protocol keeps a retried task from leaving halves.

The image: magic, counts, document ids and lengths, then per bit-plane (most significant first) the number of
zeros, a directory of ones before each 512-bit block, and the plane, all compressed by zstandard.

Nulls and odd rows: a null or empty text is the end id alone. Null doc_ids come first; equal doc_ids
stand by text, nulls first. Repeated rows are written as often as they occur. Extra columns are ignored. An empty table gives no shard and
an empty result.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm import scratch
from quarry.llm.scratch import small_batches

MAGIC, BITS, BLOCK = b"QWM1", 16, 512
SHARD_TOKENS, END = 1 << 18, 0
#: Characters of neither letters, digits nor white space that often end a word.
MARKS = ",.!?:;%&*#$|)\""
#: Words beside which white space may join in: empty, or with white space at an end.
LOOSE = r"^$|^[\s\v\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|[\s\v\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]$"
#: Bytes of text that are encoded together; a larger one alone.
TOGETHER = 12 << 20


class WaveletMatrix:
    """Bit-planes over a sequence of ids below 2**16; `zeros[l]` ids go left at level l."""

    def __init__(self, n: int, zeros: list[int], planes: list[np.ndarray], ranks: list[np.ndarray]):
        self.n, self.zeros, self.planes, self.ranks = n, zeros, planes, ranks

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        a = np.ascontiguousarray(ids, np.uint16)
        zeros, planes, ranks = [], [], []
        for level in range(BITS):
            bits = (a & (1 << (BITS - 1 - level))) != 0
            ones = np.flatnonzero(bits)
            planes.append(np.packbits(bits, bitorder="little"))
            ranks.append(np.concatenate([[0], np.cumsum(np.bincount(ones // BLOCK, minlength=-(-len(a) // BLOCK)))]).astype("<u4"))
            zeros.append(len(a) - len(ones))
            a = np.concatenate([a[np.flatnonzero(~bits)], a[ones]])
        return cls(len(a), zeros, planes, ranks)

    def bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i >> 3] >> (i & 7)) & 1

    def ones(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        block = i // BLOCK
        first = block * BLOCK // 8
        rest = np.unpackbits(self.planes[level][first : (i + 7) >> 3], bitorder="little")[: i - block * BLOCK]
        return int(self.ranks[level][block]) + int(rest.sum())

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(BITS):
            b, one = self.bit(level, i), self.ones(level, i)
            value = value << 1 | b
            i = self.zeros[level] + one if b else i - one
        return value

    def span(self, symbol: int, end: int | None = None) -> tuple[int, int]:
        """Where occurrences of symbol among the first `end` ids stand below the last plane."""
        lo, hi = 0, self.n if end is None else end
        for level in range(BITS):
            a, b = self.ones(level, lo), self.ones(level, hi)
            if symbol >> (BITS - 1 - level) & 1:
                lo, hi = self.zeros[level] + a, self.zeros[level] + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def rank(self, symbol: int, end: int | None = None) -> int:
        lo, hi = self.span(symbol, end)
        return hi - lo

    def find_bit(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) such bit of a plane, by bisection over the directory."""
        ranks = self.ranks[level].astype(np.int64)
        if not bit:
            ranks = np.minimum(np.arange(len(ranks)) * BLOCK, self.n) - ranks
        block = int(np.searchsorted(ranks, k, side="right")) - 1
        rest = np.unpackbits(self.planes[level][block * BLOCK // 8 : (block + 1) * BLOCK // 8], bitorder="little")[: self.n - block * BLOCK]
        return block * BLOCK + int(np.flatnonzero(rest == bit)[k - int(ranks[block])])

    def select(self, symbol: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of symbol."""
        lo, hi = self.span(symbol)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        i = lo + k
        for level in reversed(range(BITS)):
            one = symbol >> (BITS - 1 - level) & 1
            i = self.find_bit(level, one, i - self.zeros[level] if one else i)
        return i

    def ids(self) -> np.ndarray:
        """The whole sequence, undoing the planes from the last to the first."""
        out = np.zeros(self.n, np.uint16)
        for level in reversed(range(BITS)):
            bits = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            z, up = self.zeros[level], np.empty(self.n, np.uint16)
            up[np.flatnonzero(~bits)] = out[:z]
            up[np.flatnonzero(bits)] = out[z:] | np.uint16(1 << (BITS - 1 - level))
            out = up
        return out


def pack(doc_ids: list[int | None], lengths: list[int], wm: WaveletMatrix) -> bytes:
    """The file image of one shard."""
    z = zstandard.ZstdCompressor(level=1)
    known = np.array([i is not None for i in doc_ids], bool)
    parts = [np.packbits(known).tobytes(), np.array([i or 0 for i in doc_ids], "<i8").tobytes(), np.array(lengths, "<u4").tobytes()]
    for plane, ranks in zip(wm.planes, wm.ranks):
        parts += [ranks.tobytes(), plane.tobytes()]
    packed = [z.compress(p) for p in parts]
    head = struct.pack("<4sQI", MAGIC, wm.n, len(doc_ids)) + struct.pack(f"<{BITS}Q", *wm.zeros) + struct.pack(f"<{len(packed)}I", *map(len, packed))
    return head + struct.pack("<I", zlib.crc32(head)) + b"".join(packed)


def unpack(image: bytes) -> tuple[list[int | None], np.ndarray, WaveletMatrix]:
    """Document ids, lengths and the wavelet matrix of a file image."""
    magic, n, docs = struct.unpack_from("<4sQI", image)
    count = 3 + 2 * BITS
    end = 16 + 8 * BITS + 4 * count
    if magic != MAGIC or struct.unpack_from("<I", image, end)[0] != zlib.crc32(image[:end]):
        raise ValueError("not a wavelet matrix file, or a damaged one")
    zeros = list(struct.unpack_from(f"<{BITS}Q", image, 16))
    z, at, parts = zstandard.ZstdDecompressor(), end + 4, []
    for size in struct.unpack_from(f"<{count}I", image, 16 + 8 * BITS):
        parts.append(z.decompress(image[at : at + size]))
        at += size
    known = np.unpackbits(np.frombuffer(parts[0], np.uint8), count=docs).view(bool)
    ids = [int(i) if k else None for i, k in zip(np.frombuffer(parts[1], "<i8"), known)]
    return ids, np.frombuffer(parts[2], "<u4"), WaveletMatrix(n, zeros, [np.frombuffer(p, np.uint8) for p in parts[4::2]], [np.frombuffer(p, "<u4") for p in parts[3::2]])


def gather(table: np.ndarray, sizes: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """The entries of a table of stretches of these sizes, one after the other."""
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else np.zeros(0, np.int64)
    out = [np.zeros(0, table.dtype)]
    for k in range(0, len(entries), 1 << 17):  # what is gathered at a time stays in the cache
        e = entries[k : k + (1 << 17)]
        size = sizes[e]
        out.append(table[np.repeat(starts[e] - (np.cumsum(size) - size), size) + np.arange(size.sum())])
    return np.concatenate(out)


def tail_table(words: pa.Array, after: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The distinct ends of words, each word's from byte `after` on, and the number of each word's end among them."""
    words = words.cast(pa.large_string())
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    at = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int64)
    start, size = at[:-1] + after, np.diff(at) - after
    code = np.zeros(len(words), np.int64)  # of ends of up to 7 bytes: these and their number
    for k in range(min(7, int(size.max(initial=0)))):
        more = size > k
        code[more] |= data[start[more] + k].astype(np.int64) << (8 * k)
    code |= np.minimum(size, 8) << 56
    long = np.flatnonzero(size > 7)
    names: dict[bytes, int] = {}
    for i in long.tolist():
        code[i] = -1 - names.setdefault(data[start[i] : start[i] + size[i]].tobytes(), len(names))
    _, first, number = np.unique(code, return_index=True, return_inverse=True)
    return [data[start[i] : start[i] + size[i]].tobytes().decode() for i in first.tolist()], number


class WordCoder:
    """Encodes many texts at once, each distinct word once.

    The pre-tokeniser always breaks before a space that stands between two other characters, and never looks
    back, so texts without other runs of white space are the encodings of their first word and of a space
    and each further word. The rest are encoded whole.
    """

    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer

        self.core = Tokenizer.from_file(tokenizer_file)
        if self.core.get_vocab_size() > 1 << BITS:
            raise ValueError("ids must fit in 16 bits")
        pieces = [self.core.id_to_token(i) or "" for i in range(self.core.get_vocab_size())]
        self.kept = pa.array([], pa.string()), np.zeros(0, np.uint16), np.zeros(0, np.int64)
        self.begins = np.array([p.startswith("\u0120") for p in pieces])  # with a space

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, np.uint16) for e in self.core.encode_batch_fast(texts, add_special_tokens=False)]

    def spaced(self, words: list[str], at_once: int = 2_000) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a space and each word, one after the other, and their numbers.

        Words are encoded as one text, which is cut where an id begins with a space: each word has one such.
        """
        ids, sizes = [np.zeros(0, np.uint16)], [np.zeros(0, np.int64)]
        for k in range(0, len(words), at_once):
            part = words[k : k + at_once]
            ids.append(self.whole([" " + " ".join(part)])[0])
            starts = np.flatnonzero(self.begins[ids[-1]])
            if len(starts) != len(part):
                raise ValueError("this tokenizer doesn't break before each space")
            sizes.append(np.diff(starts, append=len(ids[-1])))
        return np.concatenate(ids), np.concatenate(sizes)

    def words(self, known: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a space and each of the distinct words, and their numbers.

        A run of marks after a letter or digit is a piece of its own, so what stands before it is encoded once for all
        its endings. What was encoded for the last texts is kept.
        """
        stem = pc.utf8_rtrim(known, MARKS)
        ended = pc.and_(pc.match_substring_regex(stem, r"[\p{L}\p{N}]$"), pc.not_equal(stem, known)).to_numpy(zero_copy_only=False)
        coded = pc.if_else(pa.array(ended), stem, known).dictionary_encode()
        first, stems = coded.indices.to_numpy(), coded.dictionary
        at = pc.index_in(stems, value_set=self.kept[0]).to_numpy(zero_copy_only=False)
        new = np.isnan(at) if at.dtype.kind == "f" else np.zeros(len(at), bool)
        ids, sizes = self.spaced(stems.filter(pa.array(new)).to_pylist())
        old = np.where(new, 0, at).astype(np.int64)
        held = len(self.kept[2])
        both = np.concatenate([self.kept[1], ids]), np.concatenate([self.kept[2], sizes])
        entry = np.where(new, held + np.cumsum(new) - 1, old)
        sizes = both[1][entry]
        self.kept = stems, gather(both[0], both[1], entry), sizes
        marked = np.flatnonzero(ended)
        tails, number = tail_table(known.take(pa.array(marked)), pc.binary_length(stem.take(pa.array(marked))).to_numpy())
        tail_ids = [np.zeros(0, np.uint16), *self.whole(tails)]
        second = np.zeros(len(known), np.int64)
        second[marked] = number + 1
        sizes = np.concatenate([self.kept[2], [len(x) for x in tail_ids]])
        pairs = np.stack([first.astype(np.int64), len(stems) + second], 1)
        return gather(np.concatenate([self.kept[1], *tail_ids]), sizes, pairs.ravel()), sizes[pairs].sum(1)

    def encode(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, each text's followed by the end id if there is one, and their numbers."""
        n = len(texts)
        split = pc.split_pattern(texts, " ")
        at = split.offsets.to_numpy().astype(np.int64)
        coded = split.values.slice(at[0], at[-1] - at[0]).dictionary_encode()
        at -= at[0]
        word, known = coded.indices.to_numpy(), coded.dictionary
        loose = pc.match_substring_regex(known, LOOSE).to_numpy(zero_copy_only=False)
        ids, sizes = self.words(pc.if_else(pa.array(loose), "x", known))
        # further entries: each text's first word, its end, and texts to encode whole
        hit = np.concatenate([[0], np.cumsum(loose[word])])
        rest = np.flatnonzero(hit[at[1:]] > hit[at[:-1]])
        firsts = self.whole(split.values.take(pa.array(split.offsets.to_numpy()[:-1])).to_pylist())
        others = self.whole(texts.take(pa.array(rest)).to_pylist())
        close = np.array([] if end is None else [end], np.uint16)
        table = np.concatenate([ids, *firsts, *others, close])
        sizes = np.concatenate([sizes, [len(x) for x in firsts], [len(x) for x in others], [len(close)]]).astype(np.int64)
        word = word.astype(np.int32)
        word[at[:-1]] = len(known) + np.arange(n)
        keep = np.ones(len(word), bool)
        for k, i in enumerate(rest):
            keep[at[i] + 1 : at[i + 1]] = False
            word[at[i]] = len(known) + n + k
        owner = np.repeat(np.arange(n, dtype=np.int32), np.diff(at))[keep]
        stops = np.cumsum(np.bincount(owner, minlength=n))  # every text has an entry, so these are where its end goes
        word = np.insert(word[keep], stops, len(sizes) - 1)
        stops = stops + np.arange(1, n + 1)
        per = np.concatenate([[0], np.cumsum(sizes[word])])[stops]
        return gather(table, sizes, word), np.diff(per, prepend=0)


_CODERS: dict[str | None, WordCoder] = {}


def coder(tokenizer_file: str | None) -> WordCoder:
    if tokenizer_file not in _CODERS:
        import public_tokenizers

        _CODERS[tokenizer_file] = WordCoder(tokenizer_file or public_tokenizers.path("byte_bpe_50k.json"))
    return _CODERS[tokenizer_file]


SHARD_ARROW = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
SHARD = "part int, seq int, n_docs long, n_tokens long, image binary"


def build_shards(docs: DataFrame, tokenizer_file: str | None = None, end: int | None = END, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """The shards' file images in doc_id order: (part, seq) is the order of the shards."""
    if docs.schema["doc_id"].dataType.simpleString() not in ("bigint", "int", "smallint", "tinyint"):
        raise TypeError("doc_id must be an integer column")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, seq = coder(tokenizer_file), TaskContext.get().partitionId(), 0
        ids: list[int | None] = []
        rows: list[np.ndarray] = []
        held = 0
        kind = SHARD_ARROW

        def flush() -> pa.RecordBatch:
            nonlocal ids, rows, held, seq
            image = pack(ids, [len(r) for r in rows], WaveletMatrix.build(np.concatenate(rows)))
            out = pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((part, seq, len(ids), held, image), kind)], names=["part", "seq", "n_docs", "n_tokens", "image"])
            ids, rows, held, seq = [], [], 0, seq + 1
            return out

        def together() -> Iterator[pa.Table]:
            some: list[pa.RecordBatch] = []
            size = 0
            for b in batches:
                some.append(b)
                size += b.column(1).nbytes
                if size >= TOGETHER:
                    yield pa.Table.from_batches(some)
                    some, size = [], 0
            if some:
                yield pa.Table.from_batches(some)

        for t in together():
            texts = pc.fill_null(t.column(1).combine_chunks(), "")
            texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
            tokens, sizes = words.encode(texts, end)
            at = 0
            for i, n in zip(t.column(0).to_pylist(), sizes.tolist()):
                ids.append(i)
                rows.append(tokens[at : at + n])
                at += n
                held += n
                if held >= shard_tokens:
                    yield flush()
            rows = [r.copy() for r in rows]  # a view would hold the whole block
        if ids:
            yield flush()

    ordered = small_batches(docs).select("doc_id", "text").repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    return ordered.mapInArrow(run, SHARD)


def write_shards(docs: DataFrame, path: str, **options: object) -> None:
    build_shards(docs, **options).write.option("compression", "none").parquet(path)


def with_starts(shards: DataFrame) -> DataFrame:
    """Shards with `start`, the ids of all shards before. Only sums per part meet in one task."""
    sums = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(F.col("part").alias("_part"), before.alias("_base"))
    own = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = shards.select(F.col("part").alias("_part"), F.col("seq").alias("_seq"), own.alias("_own")).join(sums, "_part").select("_part", "_seq", (F.col("_base") + F.col("_own")).alias("start"))
    return shards.join(starts, (shards["part"] == F.col("_part")) & (shards["seq"] == F.col("_seq"))).drop("_part", "_seq")


def read_documents(shards: DataFrame) -> DataFrame:
    """Per document, from the file images: start, n_tokens and the CRC-32 of its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, image in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids, lengths, wm = unpack(image)
                tokens = wm.ids().astype("<u4")
                ends = np.cumsum(lengths, dtype=np.int64)
                crc = [zlib.crc32(tokens[e - n : e]) for e, n in zip(ends.tolist(), lengths.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(start + ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return small_batches(with_starts(shards)).select("start", "image").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def write_and_read(docs: DataFrame, **options: object) -> DataFrame:
    """Write the shards in the shared folder and report from what is read back."""
    path = f"{scratch.folder(docs.sparkSession)}/wavelet-{scratch.unique()}"
    write_shards(docs, path, **options)
    return read_documents(docs.sparkSession.read.schema(SHARD).parquet(path))
