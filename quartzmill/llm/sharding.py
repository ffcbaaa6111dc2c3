"""Sharding by a permutation-filled lookup table (operator 6), placement in DataFrame functions only.

Every shard prefers the slots of a table of prime size in an order of its own,
offset + j * skip; the shards take turns claiming their next free slot until the
table is full, a shard of weight w having w turns a round.  A row's slot is the
hash of its key modulo the table size, so placement is one lookup in a broadcast
table whose size is the parameter ``SLOTS``, not the data.  Shares differ by at
most one turn, and a removed shard moves few slots but its own.

Defined cases: a row with a null key is placed by its text (null counts as
empty), so null keys do not meet in one shard; equal keys share a shard;
repeated rows each keep their row; a text's length does not matter, as only its
bytes are counted; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS = 65537
SHARDS = 64


def _number(text: str) -> int:
    return int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "big")


def fill(shards: dict[str, int], slots: int = SLOTS) -> list[int]:
    """The table: for each slot the shard's place in ``shards`` (name -> weight)."""
    if slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("the table's size must be prime")
    live = [(i, w) for i, w in enumerate(shards.values()) if w > 0]
    if not live or sum(w for _, w in live) > slots:
        raise ValueError("need a shard of positive weight, and a slot for every turn of a round")
    names = list(shards)
    at = {i: _number(f"offset:{names[i]}") % slots for i, _ in live}
    skip = {i: _number(f"skip:{names[i]}") % (slots - 1) + 1 for i, _ in live}
    table, left = [-1] * slots, slots
    while left:
        for i, weight in live:
            for _ in range(min(weight, left)):
                while table[at[i]] >= 0:
                    at[i] = (at[i] + skip[i]) % slots
                table[at[i]] = i
                left -= 1
    return table


def slot(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a string key: the first 60 bits of its MD5 modulo the table size."""
    return F.pmod(F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long"), F.lit(slots)).cast("int")


def lookup(spark: SparkSession, table: list[int]) -> DataFrame:
    """``(slot, shard)``, one row a slot."""
    packed = ",".join(map(str, table))
    one = spark.range(1).select(F.posexplode(F.split(F.lit(packed), ",")).alias("slot", "shard"))
    return one.select("slot", F.col("shard").cast("int").alias("shard"))


def place(df: DataFrame, key: Column, shards: dict[str, int] | None = None, slots: int = SLOTS) -> DataFrame:
    """``df`` with ``slot`` and ``shard``, which replace columns of these names; ``key`` is a string that is never null."""
    shards = shards or {f"shard-{i:03d}": 1 for i in range(SHARDS)}
    table = lookup(df.sparkSession, fill(shards, slots))
    # the broadcast has exactly ``slots`` rows of two numbers
    own = [F.col(f"`{c}`") for c in df.columns if c.lower() not in ("slot", "shard")]
    return df.select(*own, slot(key, slots).alias("slot")).join(F.broadcast(table), "slot")


def write_shards(placed: DataFrame, path: str, files_per_shard: int = 8) -> None:
    """Write a folder a shard; each shard is dealt over ``files_per_shard`` tasks, so a heavy key holds up none alone."""
    salt = F.pmod(F.xxhash64(*placed.columns), F.lit(files_per_shard))
    placed.withColumn("__salt", salt).repartition("shard", "__salt").drop("__salt").write.partitionBy("shard").parquet(path)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce("text", F.lit(""))
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), text))
    rows = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), key.alias("__key"))
    return place(rows, F.col("__key")).select("doc_id", F.col("slot").cast("int").alias("slot"), "shard", "n_bytes")


def sql(shards: int = SHARDS, slots: int = SLOTS) -> str:
    table = ",".join(map(str, fill({f"shard-{i:03d}": 1 for i in range(shards)}, slots)))
    return f"""
WITH keyed AS (
  SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes,
    CAST(('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'text:' || coalesce(text, ''))), 1, 15))::BIGINT % {slots} AS INTEGER) AS slot
  FROM documents),
shard_table AS (SELECT unnest(range({slots}))::INTEGER AS slot, unnest(string_split('{table}', ','))::INTEGER AS shard)
SELECT doc_id, slot, shard, n_bytes FROM keyed JOIN shard_table USING (slot)"""
