"""Jump consistent hashing of stable keys to shards.

The jump hash of Lamping and Veach (2014) draws from a linear congruential generator whose state
is the key.  A key's last jump below the shard count is its shard: no ring or table of points is
kept, and when a shard is appended only the keys that jump to it move.

Law: `key`.  The key is the first 60 bits of md5(text of doc_id), so it is the same in every run
and every engine.

Cases: a null doc_id is the empty key, so all such rows share a shard.  Null texts have size 1
(no bytes plus 1) and the CRC of the empty string.  Repeated rows each get a slot of their own.
Very long texts are read whole; rows of equal ids and texts are numbered in any order, as they are
the same.  An empty table gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, number_within, read

# Fixed values of the published algorithm: the generator's multiplier (increment 1).
MULTIPLIER = 2862933555777941757
LIMB = 16
#: Blocks that the rows of a shard are dealt to before they are numbered.
BLOCKS = 1024


def stable_key(value: Column) -> Column:
    """60 bits of a value's text, as a long that is not negative."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def _next_state(state: Column) -> Column:
    """state * MULTIPLIER + 1 modulo 2**64, in 16-bit limbs as ANSI mode traps wrapping products."""
    mask = F.lit((1 << LIMB) - 1).cast("long")
    a = [F.lit((MULTIPLIER >> LIMB * i) & ((1 << LIMB) - 1)).cast("long") for i in range(4)]
    k = [F.shiftrightunsigned(state, LIMB * i).bitwiseAND(mask) for i in range(4)]
    total, carry = None, F.lit(1).cast("long")
    for i in range(4):
        column = carry
        for j in range(i + 1):
            column = column + k[j] * a[i - j]
        part = F.shiftleft(column.bitwiseAND(mask), LIMB * i)
        total = part if total is None else total.bitwiseOR(part)
        carry = F.shiftright(column, LIMB)
    return total


def jumps(key: Column, shards: int, soon: int | None = None) -> Column:
    """struct<state, shard, next>: the last jump below `shards` and the one after it.

    A key jumps some ln(shards) times.  A few times as many steps end all but one walk in millions;
    the rest take as many more as there are shards, of which each jump passes one at least.  soon:
    the steps that all keys take, 8 + 4 * bits of shards by default."""
    n = F.lit(shards).cast("long")

    def jumped(at):
        return F.transform(
            F.array(_next_state(at["state"])),
            lambda s: F.struct(
                s.alias("state"),
                at["next"].alias("shard"),
                F.floor((at["next"] + 1) * (F.lit(float(1 << 31)) / (F.shiftrightunsigned(s, 33) + 1).cast("double"))).cast("long").alias("next"),
            ),
        )[0]

    step = lambda at, _: F.when(at["next"] >= n, at).otherwise(jumped(at))
    start = F.struct(key.cast("long").alias("state"), F.lit(-1).cast("long").alias("shard"), F.lit(0).cast("long").alias("next"))
    soon = min(shards, soon or 8 + 4 * shards.bit_length())
    first = F.aggregate(F.sequence(F.lit(1), F.lit(soon)), start, step)
    if soon == shards:
        return first
    more = lambda at: F.when(at["next"] >= n, F.expr("cast(array() as array<int>)")).otherwise(F.sequence(F.lit(1), F.lit(shards)))
    return F.transform(F.array(first), lambda at: F.aggregate(more(at), at, step))[0]


def jump_hash(key: Column, shards: int) -> Column:
    """The shard (0 to shards - 1) of a 64-bit key."""
    return jumps(key, shards)["shard"].cast("int")


def shard_documents(docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size, text_crc32, law, shard, slot, grown_shard for each row of docs.

    The text is read once; what is numbered are rows of a few numbers.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    walked = docs.select(F.col(key), body.alias("_body"), jumps(stable_key(F.col(key)), shards).alias("_walk"))
    slim = materialize(
        walked.select(
            F.col(key),
            (F.octet_length("_body").cast("long") + 1).alias("size"),
            F.crc32(F.col("_body").cast("binary")).alias("text_crc32"),
            F.col("_walk.shard").cast("int").alias("shard"),
            # with one shard more, a key moves to it if that is its next jump, and stays otherwise
            F.when(F.col("_walk.next") == shards, F.lit(shards)).otherwise(F.col("_walk.shard").cast("int")).alias("grown_shard"),
        ).withColumn("_block", F.conv(F.substring(F.md5(F.concat_ws("/", F.col(key).cast("string"), F.col("text_crc32").cast("string")).cast("binary")), 1, 8), 16, 10).cast("long") % BLOCKS)
    )
    done = number_within(slim, ["shard"], "_block", [F.col(key), F.col("text_crc32"), F.col("size")], "slot")
    return done.select(key, "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read(spark, sf_dir, "documents"), shards=8)
