"""Operator 1, sharding [native]: jump consistent hashing.

Lamping and Veach's jump hash maps a stable key to one of ``n`` shards without a
ring table: a 64-bit linear congruential sequence seeded with the key decides at
which shard counts the key would have moved; the last such jump below ``n`` is
its shard.  Going from ``n`` to ``n + 1`` shards moves about ``1 / (n + 1)`` of
the keys, all of them into the new shard.

Everything is built-in Catalyst expressions.  The 64-bit wrapping product is
taken on 32-bit halves because ANSI arithmetic rejects overflow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jsonmend.llm.common import read_table, text_or_empty

#: The multiplier of the published jump hash (fixed value).
LCG = 2862933555777941757
_M32 = 0xFFFFFFFF
#: Jump steps folded before the (rare) full-length fold; the expected count is ln(n) + 1.
_FIRST_STEPS = 64
#: Most rows of the slot-offset table, which bounds what is broadcast.
SLOT_TABLE_ROWS = 65_536


def _low_product(x: Column, c: int) -> Column:
    """(x * c) mod 2**32 plus a multiple of 2**32, for x below 2**32, without overflow."""
    return x * F.lit(c & 0xFFFF) + F.shiftleft((x * F.lit(c >> 16)).bitwiseAND(F.lit(0xFFFF)), 16)


def _step(state: Column, shards: int) -> Column:
    hi, lo = state["hi"], state["lo"]
    a_hi, a_lo = LCG >> 32, LCG & _M32
    p0, p1 = lo * F.lit(a_lo & 0xFFFF), lo * F.lit(a_lo >> 16)
    low = p0 + F.shiftleft(p1.bitwiseAND(F.lit(0xFFFF)), 16) + F.lit(1)
    high = F.shiftright(low, 32) + F.shiftright(p1, 16) + _low_product(lo, a_hi) + _low_product(hi, a_lo)
    new_hi = high.bitwiseAND(F.lit(_M32))
    jump = ((state["j"] + 1) * (F.lit(2147483648.0) / (F.shiftright(new_hi, 1) + 1))).cast("long")
    moved = F.struct(new_hi.alias("hi"), low.bitwiseAND(F.lit(_M32)).alias("lo"), state["j"].alias("b"), jump.alias("j"))
    return F.when(state["j"] < shards, moved).otherwise(state)


def jump_hash(key: Column, shards: int) -> Column:
    """Shard in ``[0, shards)`` of a long key; a null key counts as -1."""
    if shards < 1:
        raise ValueError("shards must be positive")
    key = F.coalesce(key.cast("long"), F.lit(-1).cast("long"))
    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("hi"),
        key.bitwiseAND(F.lit(_M32)).alias("lo"),
        F.lit(-1).cast("long").alias("b"),
        F.lit(0).cast("long").alias("j"),
    )

    def fold(state: Column, steps: int) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), state, lambda s, _: _step(s, shards))

    out = fold(start, min(shards, _FIRST_STEPS))
    if shards > _FIRST_STEPS:
        out = F.when(out["j"] < shards, fold(out, shards - _FIRST_STEPS)).otherwise(out)
    return out["b"].cast("int")


def assign_shards(
    docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: id, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``key``: the id and the shard count alone decide the shard, so
    equal texts under different ids may lie in different shards.  ``slot``
    numbers each shard's rows gaplessly from 0, ordered by sub-bucket, id, size
    and checksum.  A null text has size 1 and checksum 0, a null id is placed as
    key -1, identical rows get distinct slots, an empty table gives no row.

    A shard is far too large for one sorted window, so rows are numbered within
    hashed sub-buckets and shifted by the sub-bucket's offset.  Identical rows
    are counted first and expanded last, so a repeated row never fills a window.
    The offset table has at most ``SLOT_TABLE_ROWS`` rows (plus one per shard).
    """
    buckets = max(1, SLOT_TABLE_ROWS // shards)
    text = F.encode(text_or_empty(text_col), "utf-8")
    base = (
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
        )
        .groupBy("doc_id", "size", "text_crc32")
        .agg(F.count(F.lit(1)).alias("copies"))
        .withColumn("shard", jump_hash(F.col("doc_id"), shards))
        .withColumn("bucket", F.pmod(F.col("text_crc32") + F.pmod(F.coalesce("doc_id", F.lit(-1)), F.lit(buckets)), F.lit(buckets)))
    )
    cell = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        base.groupBy("shard", "bucket")
        .agg(F.sum("copies").alias("rows"))
        .select("shard", "bucket", F.coalesce(F.sum("rows").over(cell), F.lit(0)).alias("offset"))
    )
    inner = (
        Window.partitionBy("shard", "bucket")
        .orderBy("doc_id", "size", "text_crc32")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    numbered = (
        base.withColumn("before", F.coalesce(F.sum("copies").over(inner), F.lit(0)))
        .join(F.broadcast(offsets), ["shard", "bucket"])
        .withColumn("first", F.col("offset") + F.col("before"))
        .withColumn("slot", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("copies") - 1)))
    )
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot",
        jump_hash(F.col("doc_id"), shards + 1).alias("grown_shard"),
    )


def write_shards(docs: DataFrame, shards: int, path: str, id_col: str = "doc_id") -> None:
    """Write all columns of ``docs`` as Parquet partitioned by ``shard_no``.

    An input column of that name is replaced.  Each shard is dealt over several
    writers by a hash of its rows, so that none writes a whole shard.
    """
    out = docs.withColumn("shard_no", jump_hash(F.col(id_col), shards))
    out.repartition("shard_no", F.pmod(F.xxhash64(F.col(id_col)), F.lit(16))).write.partitionBy("shard_no").parquet(path)


def op1_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(read_table(spark, sf_dir, "documents"), 16)


def _crc_nibbles() -> str:
    """SQL list of the 16 reflected crc32 entries, from the polynomial."""
    table = []
    for c in range(16):
        for _ in range(4):
            c = c >> 1 ^ (3988292384 if c & 1 else 0)
        table.append(c)
    return f"({table}::BIGINT[])"


def _oracle(shards: int = 16) -> str:
    """DuckDB: the jump sequence unrolled in CTEs, crc32 by a fold over the bytes."""
    buckets = SLOT_TABLE_ROWS // shards
    half = f"xor((v) >> 4, {_crc_nibbles()}[1 + ((v) & 15)])"
    fold = half.replace("(v)", f"({half.replace('(v)', '(xor(c, x))')})")
    steps = [
        "base AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, xor(list_reduce("
        "list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT)), "
        f"lambda c, x: {fold}), 4294967295::BIGINT) AS text_crc32 FROM documents)",
        "s0 AS (SELECT *, ((coalesce(doc_id, -1)::HUGEINT + 18446744073709551616) % 18446744073709551616) AS k, "
        "-1::BIGINT AS b, 0::BIGINT AS j, -1::BIGINT AS bg, 0::BIGINT AS jg FROM base)",
    ]
    for n in range(1, shards + 2):
        steps.append(
            f"t{n} AS (SELECT *, (k * {LCG} + 1) % 18446744073709551616 AS k2 FROM s{n - 1}), "
            f"s{n} AS (SELECT doc_id, size, text_crc32, k2 AS k, CASE WHEN j < {shards} THEN j ELSE b END AS b, "
            f"CASE WHEN j < {shards} THEN trunc((j + 1) * (2147483648.0::DOUBLE / ((k2 >> 33) + 1)::DOUBLE))::BIGINT ELSE j END AS j, "
            f"CASE WHEN jg < {shards + 1} THEN jg ELSE bg END AS bg, "
            f"CASE WHEN jg < {shards + 1} THEN trunc((jg + 1) * (2147483648.0::DOUBLE / ((k2 >> 33) + 1)::DOUBLE))::BIGINT ELSE jg END AS jg FROM t{n})"
        )
    return (
        "WITH " + ", ".join(steps) + f" SELECT doc_id, size, text_crc32, 'key' AS law, b::INTEGER AS shard, "
        f"row_number() OVER (PARTITION BY b ORDER BY (text_crc32 + ((coalesce(doc_id, -1) % {buckets}) + {buckets}) % {buckets}) % {buckets}, doc_id, size, text_crc32) - 1 AS slot, "
        f"bg::INTEGER AS grown_shard FROM s{shards + 1}"
    )


ORACLE = _oracle()
