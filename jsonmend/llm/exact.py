"""Operator 10, exact deduplication by deterministic block naming.

A normalised text (every ASCII white-space character deleted) is cut into
fixed-size blocks.  Level 0 sorts the distinct blocks and gives each its rank as
an integer name; level k names the distinct pairs of adjacent level k-1 names;
after log2(blocks) levels every document has one name.  Two documents with the
same number of blocks share it exactly if their texts are equal: names stand for
contents, never for hashes, so identities cannot collide.

How it is dealt out: the distinct blocks are found with partial aggregation, so
a block shared by a third of the corpus crosses the network once a task.  The
blocks' texts are shuffled once.  Blocks sort by 64-bit hash and length, which
also carry the names back to the documents; where two different blocks share
both (checked, never assumed), those are sorted, named and joined by content
instead.  Ranks are gapless and the same however the rows are partitioned: a
global sort numbers rows within its partitions, and the partitions' counts shift
them.  Each level's names are written to the shared folder before use, which
fixes them against recomputation; joins have fresh exchanges on both sides, so
that hot names can be split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jsonmend.llm.common import SPACE_CLASS, discard, fresh, materialize, read_table, text_or_empty

#: Bytes in a block.
BLOCK = 4096


def normalized(text: Column) -> Column:
    return F.regexp_replace(text, SPACE_CLASS + "+", "")


def _named(distinct: DataFrame, order: list[str], label: str) -> DataFrame:
    """Distinct rows with their rank in ``order`` as ``name``, from 0 without gaps."""
    numbered = materialize(distinct.orderBy(*order).withColumn("at", F.monotonically_increasing_id()), label)
    part = F.shiftright("at", 33)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = numbered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("rows")).withColumn("first", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    offsets = F.broadcast(offsets.select("part", "first"))  # one row a partition
    place = F.col("at") - F.shiftleft(part, 33) + F.col("first")
    return numbered.join(offsets, part == F.col("part")).withColumn("name", place.cast("long")).drop("at", "part", "first")


def _block_names(rows: DataFrame) -> DataFrame:
    """``rows`` (…, block) with ``block`` replaced by its integer ``name``."""
    rows = rows.withColumns({"h": F.xxhash64("block"), "len": F.octet_length("block")})
    blocks = rows.select("block").distinct().select(F.xxhash64("block").alias("h"), F.octet_length("block").alias("len"))
    blocks = materialize(blocks.groupBy("h", "len").agg(F.count(F.lit(1)).alias("blocks")), "blocks")
    names = _named(blocks.filter("blocks = 1").select("h", "len"), ["h", "len"], "block-names")
    clashes = blocks.filter("blocks > 1").select("h", "len")
    named = rows.drop("block").join(names, ["h", "len"]).drop("h", "len")
    if clashes.isEmpty():
        return named
    own = rows.join(clashes, ["h", "len"], "left_semi")
    by_content = _named(own.select("block").distinct(), ["block"], "clash-names").withColumn("name", -1 - F.col("name"))
    return named.unionByName(own.join(by_content, "block").drop("block", "h", "len"))


def block_identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """Distinct documents with their identity: doc_id, n_points, text_sha256, blocks, copies, name.

    Rows that agree in id, original length and normalised text are one entry
    with ``copies`` > 1.  (``blocks``, ``name``) is equal exactly for equal
    normalised texts.  Null counts as the empty text, which has one empty block.
    """
    text = text_or_empty(text_col)
    data = F.encode(normalized(text), "utf-8")
    base = docs.select(F.col(id_col).alias("doc_id"), F.length(text).cast("long").alias("n_points"), data.alias("data"))
    cut = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.substring(F.col("data"), k * block + 1, F.lit(block)))
    rows = (
        base.withColumn("text_sha256", F.sha2("data", 256))
        .withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.octet_length("data") / block)).cast("int"))
        .select("doc_id", "n_points", "text_sha256", "blocks", F.posexplode(cut).alias("pos", "block"))
    )
    named = _block_names(rows)
    key = ["doc_id", "n_points", "text_sha256", "blocks"]
    level = materialize(named.groupBy(*key, "pos").agg(F.min("name").alias("name"), F.count(F.lit(1)).alias("copies")), "names-0")
    most = level.agg(F.max("blocks")).first()[0] or 1
    finished = level.filter("blocks = 1").drop("pos")
    level = level.filter("blocks > 1")
    width, step = 1, 0
    while width < most:
        width, step = width * 2, step + 1
        pairs = (
            level.groupBy(*key, F.shiftright("pos", 1).alias("pos"))
            .agg(
                F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left"),
                F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-(1 << 62))).alias("right"),
                F.max("copies").alias("copies"),
            )
        )
        pairs = materialize(pairs, f"pairs-{step}")
        names = _named(pairs.select("left", "right").distinct(), ["left", "right"], f"pair-names-{step}")
        level = materialize(pairs.join(names, ["left", "right"]).drop("left", "right"), f"names-{step}")
        discard(pairs)
        finished = finished.unionByName(level.filter((F.col("blocks") <= width)).drop("pos"))
        level = level.filter(F.col("blocks") > width)
    return finished


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without ASCII white space.  Of each group the
    row with the longest original text stays, then the smallest id (null ids
    last); of wholly identical rows one stays.  Null text counts as empty; an
    empty table gives no row.
    """
    entries = materialize(block_identities(docs, id_col, text_col, block), "identities")
    order = F.struct(-F.col("n_points"), F.col("doc_id").isNull(), F.col("doc_id"), F.col("n_points").alias("points"), F.col("text_sha256"))
    groups = entries.groupBy("blocks", "name").agg(F.sum("copies").alias("group_size"), F.min(order).alias("keep"))
    groups = materialize(groups.select("blocks", "name", "group_size", F.col("keep.doc_id").alias("keep_id"), F.col("keep.points").alias("keep_points")), "groups")
    joined = entries.join(groups, ["blocks", "name"])
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_points") == F.col("keep_points"))
    rows = joined.withColumn("stays", stays).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return rows.select(
        "doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), (F.col("stays") & (F.col("copy") == 1)).alias("kept"), "text_sha256",
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    kept = materialize(
        exact_groups(docs, id_col, text_col).groupBy("doc_id", "text_sha256").agg(F.max(F.col("kept").cast("int")).alias("kept"), F.count(F.lit(1)).alias("rows")).filter("kept = 1"),
        "kept",
    )
    taken = [F.col(f"`{c}`") for c in docs.columns]
    own_id, own_sha, own_size = (fresh(docs, n) for n in ("__id", "__sha", "__size"))
    tag = docs.select("*", F.col(id_col).alias(own_id), F.sha2(F.encode(normalized(text_or_empty(text_col)), "utf-8"), 256).alias(own_sha))
    kept = kept.select(F.col("doc_id").alias(own_id), F.col("text_sha256").alias(own_sha), "rows")
    match = lambda k: tag[own_id].eqNullSafe(k[own_id]) & (tag[own_sha] == k[own_sha])
    one, many = kept.filter("rows = 1"), kept.filter("rows > 1")
    out = tag.join(one, match(one), "left_semi").select(*taken)
    if not many.isEmpty():  # an id with several equal texts: the longest original stays, once
        several = tag.join(many, match(many), "left_semi").withColumn(own_size, F.length(text_or_empty(text_col)))
        best = several.groupBy(own_id, own_sha).agg(F.max_by(F.struct(*taken), F.col(own_size)).alias("row"))
        out = out.unionByName(best.select("row.*"))
    return out


def op10_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(read_table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents),
r AS (SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, row_number() OVER w AS k
  FROM d WINDOW w AS (PARTITION BY t ORDER BY n DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, k = 1 AS kept, sha256(t) AS text_sha256 FROM r
"""
