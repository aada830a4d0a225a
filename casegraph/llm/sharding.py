"""Consistent sharding through a lookup table that shards fill by their own permutations.

The table has a prime number M of slots.  Shard i has an offset and a step, both from a hash of its
name; because M is prime, ``(offset + j * step) mod M`` runs through all slots, which is the order
the shard prefers them in.  Shards take turns, and each turn claims the shard's next slot that is
still free, until the table is full; so shards own equal shares (within one slot), and adding or
removing a shard moves few slots.  A key's shard is the owner of slot ``hash(key) mod M``.

Only DataFrame and SQL functions are used.  The table is filled by one ``aggregate`` over the M
turns; its cost depends on M alone.  It has exactly M rows of two integers, so it is broadcast, and
placing a row costs one lookup whatever the number of shards.

Defined results: a null key is placed like the text ``null``; rows with equal keys share a shard
(spread the files of a shard with ``files_per_shard``); further columns stay as they are; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casegraph.llm.common import free_name, row_keys, table

#: Number of shards of the registered query, and a prime over 100 times as large.
SHARDS = 16
SLOTS = 2053


def text_hash(text: Column) -> Column:
    """The first 60 bits of the text's md5, as a long."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def lookup_table(spark: SparkSession, shards: int = SHARDS, slots: int = SLOTS, prefix: str = "shard-") -> DataFrame:
    """``slot, shard``: the owner of every slot.  ``slots`` must be prime and at least ``shards``."""
    if shards < 1 or slots < shards or slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime number that is not below the number of shards")
    name = F.concat(F.lit(prefix), F.col("id").cast("string"))
    preferences = (
        spark.range(shards)
        .select(
            F.col("id").cast("int").alias("shard"),
            (text_hash(F.concat(name, F.lit("/offset"))) % slots).cast("int").alias("offset"),
            (text_hash(F.concat(name, F.lit("/step"))) % (slots - 1) + 1).cast("int").alias("step"),
        )
        .agg(F.sort_array(F.collect_list(F.struct("shard", "offset", "step"))).alias("prefs"))
    )
    at = f"cast((prefs[t % {shards}].offset + cast(j as bigint) * prefs[t % {shards}].step) % {slots} as int)"
    # A turn happens in two steps, so that the slot found is computed once.
    turns = f"""
      aggregate(
        sequence(0, {slots - 1}),
        named_struct('owner', array_repeat(-1, {slots}), 'next', array_repeat(0, {shards})),
        (s, t) -> transform(
          array(array_min(filter(
            sequence(element_at(s.next, t % {shards} + 1), {slots - 1}),
            j -> element_at(s.owner,
                   {at} + 1) = -1
          ))),
          j -> named_struct(
            'owner', concat(
              slice(s.owner, 1, {at}),
              array(t % {shards}),
              slice(s.owner, {at} + 2, {slots})),
            'next', concat(
              slice(s.next, 1, t % {shards}), array(j + 1), slice(s.next, t % {shards} + 2, {shards})))
        )[0],
        s -> s.owner)
    """
    return preferences.select(F.posexplode(F.expr(turns)).alias("slot", "shard"))


def placed(df: DataFrame, key: Column, owners: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``df`` with the columns ``slot`` and ``shard`` of every row's key (new names where they are taken)."""
    slot, shard = free_name(df, "slot"), free_name(df, "shard")
    named = F.broadcast(owners.select(F.col("slot").alias(slot), F.col("shard").alias(shard)))
    at = (text_hash(F.coalesce(key.cast("string"), F.lit("null"))) % slots).cast("int")
    return df.withColumn(slot, at).join(named, slot)


def write_shards(df: DataFrame, key: Column, owners: DataFrame, path: str, files_per_shard: int = 8) -> None:
    """One folder for each shard; a shard with many rows is written by ``files_per_shard`` tasks."""
    out = placed(df, key, owners)
    shard = out.columns[-1]
    salt = F.pmod(row_keys(df)[0], F.lit(files_per_shard))
    out.repartition(shard, salt).write.partitionBy(shard).parquet(path)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return placed(docs, F.col("doc_id"), lookup_table(spark)).select("doc_id", "slot", "shard")


_PREFS = f"""
  prefs AS (
    SELECT list(o ORDER BY i) AS offs, list(s ORDER BY i) AS steps FROM (
      SELECT i,
        CAST(('0x' || substr(md5('shard-' || i || '/offset'), 1, 15))::BIGINT % {SLOTS} AS BIGINT) AS o,
        CAST(('0x' || substr(md5('shard-' || i || '/step'), 1, 15))::BIGINT % {SLOTS - 1} + 1 AS BIGINT) AS s
      FROM range({SHARDS}) r(i)))
"""

#: One row for each turn: the slot it claims is the first free one in the order its shard prefers.
ORACLE = f"""
WITH RECURSIVE {_PREFS},
turns(turn, slot, taken) AS (
  SELECT 0::BIGINT, offs[1], [offs[1]] FROM prefs
  UNION ALL
  SELECT turn + 1, claimed, list_append(taken, claimed) FROM (
    SELECT turn, taken,
      list_filter(
        list_transform(range({SLOTS}), lambda j: (offs[(turn + 1) % {SHARDS} + 1] + j * steps[(turn + 1) % {SHARDS} + 1]) % {SLOTS}),
        lambda x: NOT list_contains(taken, x))[1] AS claimed
    FROM turns, prefs WHERE turn < {SLOTS - 1})
)
SELECT d.doc_id, CAST(t.slot AS INTEGER) AS slot, CAST(t.turn % {SHARDS} AS INTEGER) AS shard
FROM documents d
JOIN turns t ON t.slot = ('0x' || substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), 'null')), 1, 15))::BIGINT % {SLOTS}
"""
