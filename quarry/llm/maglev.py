"""Sharding by a permutation-filled lookup table.

Every shard has its own permutation of the slots of a prime-sized table (an offset and a stride from its name).
Shards take turns; at a turn a shard claims the next slot of its permutation that is still free, until
none is. A document's slot is a hash of its id modulo the size, its shard what the table says: constant time, near-even
shares, and few moves when a shard is added or removed. The table has `size` entries whatever the data,
so it may be broadcast.

Nulls and odd rows: a null doc_id places as the empty string. Repeated ids share a place. Extra columns are
ignored by `place`, and passed through by `deal`. A slot that two shards want goes to the one whose turn it is, so there are no ties. An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.scratch import fresh

SHARDS, SIZE = 64, 65_537


def _number(name: str, salt: str) -> int:
    return int(hashlib.md5(f"{salt}:{name}".encode()).hexdigest()[:15], 16)


def lookup_table(names: list[str], size: int = SIZE, turns: dict[str, int] | None = None) -> list[int]:
    """The index into names of the shard that holds each slot; `turns` gives a shard more claims a round."""
    if not names or len(set(names)) < len(names):
        raise ValueError("shards need distinct names")
    if size < len(names) or any(size % p == 0 for p in range(2, int(size**0.5) + 1)):
        raise ValueError("size must be a prime of at least the number of shards")
    offset = [_number(n, "offset") % size for n in names]
    stride = [_number(n, "stride") % (size - 1) + 1 for n in names]
    table, free = [-1] * size, size
    at = offset[:]
    while True:
        for k, name in enumerate(names):
            for _ in range((turns or {}).get(name, 1)):
                while table[at[k]] >= 0:
                    at[k] = (at[k] + stride[k]) % size
                table[at[k]] = k
                free -= 1
                if not free:
                    return table


def shard_names(n: int = SHARDS) -> list[str]:
    return [f"shard-{i:05d}" for i in range(n)]


def slot(key: Column, size: int = SIZE) -> Column:
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15)
    return F.conv(digits, 16, 10).cast("long") % size


def deal(docs: DataFrame, names: list[str] | None = None, size: int = SIZE, key: str = "doc_id", into: tuple[str, str] = ("slot", "shard")) -> DataFrame:
    """docs with the slot and the shard of each row; a broadcast join on the slot, nothing is shuffled."""
    names = names or shard_names()
    held = lookup_table(names, size)
    s = fresh(docs, "_at")
    table = docs.sparkSession.createDataFrame([(i, names[k]) for i, k in enumerate(held)], f"{s} long, `{into[1]}` string")
    return docs.withColumn(s, slot(F.col(key), size)).join(F.broadcast(table), s).withColumnRenamed(s, into[0])


def place(docs: DataFrame, **options: object) -> DataFrame:
    """doc_id, slot, shard and the text's bytes, one row per document."""
    d = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return deal(d, **options).select("doc_id", "slot", "shard", "n_bytes")


def oracle(n: int = SHARDS, size: int = SIZE) -> str:
    """The same placement in DuckDB; the table is written out as text."""
    held = ",".join(map(str, lookup_table(shard_names(n), size)))
    return f"""
    WITH t AS (SELECT string_split('{held}', ',') AS held),
    d AS (SELECT doc_id, CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15)) AS BIGINT) % {size} AS slot,
                 CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes FROM documents)
    SELECT doc_id, slot, 'shard-' || lpad(held[slot + 1], 5, '0') AS shard, n_bytes FROM d, t"""
