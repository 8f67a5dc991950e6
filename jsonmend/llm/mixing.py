"""Operator 6, mixing sources to target weights [native]: entropy balancing.

Among all document rates r_i between 0 and ``MOST`` whose words meet every
source's target, entropy balancing takes those nearest to 1 in relative
entropy.  The optimum is an exponential tilt, r_i = min(MOST, exp(lambda_s *
x_i)), x_i being the document's size over its source's mean, and lambda_s the
root of the convex dual's gradient.  Each Newton step is one distributed
aggregation over the (source, size) histogram, guarded by bisection brackets;
the multipliers stay in a table, one row a source.

Rates become whole copies by hashed rounding: the floor, plus one where a
uniform hash of the document falls under the fraction.  A bounded, hashed set
of each source's documents is held back and rounded last, largest first, each
taking the number of copies that best cancels what is left; it absorbs the
rounding noise of the rest.  Sources of up to ``HELD`` documents are rounded
that way alone.

Everything is DataFrame operations.  Repeated rows are counted first and
numbered by expansion, so that each gets its own hash.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jsonmend.llm.common import WORD_CLASS, discard, fresh, materialize, read_table

#: The most copies of a document, and the most of a source's size that its target may be.
MOST = 3
#: Source weights, repeating in code point order of the sources, null last.
WEIGHTS = (1, 2, 3)
#: Documents of a source that are rounded last.
HELD = 512
_STEPS, _CLOSE = 60, 1e-9


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_CLASS)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """A non-null key that sorts like the source by code point, null last."""
    return F.when(source.isNull(), F.lit("2")).otherwise(F.concat(F.lit("1"), source.cast("string")))


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """(src, source_size, docs, target) from rows (src, size, rows).

    Water filling in closed form: in ascending order of cap over weight, a
    source is capped if the level that the sources from it on could share would
    reach its cap.  The windows hold one row a source.
    """
    per = materialize(sizes.groupBy("src").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.sum("rows").alias("docs")), "sources")
    rank = F.row_number().over(Window.orderBy("src"))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((rank - 1) % len(weights) + 1).cast("int")).cast("long")
    per = per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    every = Window.partitionBy()
    up = Window.orderBy(F.col("cap") / F.col("weight"), "src").rowsBetween(Window.unboundedPreceding, -1)
    wide = lambda c: c.cast("decimal(19,0)")
    per = per.withColumns(
        {
            "total": F.sum("source_size").over(every),
            "left": F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(up), F.lit(0)),
            "heavy": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(up), F.lit(0)),
            "all_weight": F.sum("weight").over(every),
        }
    )
    per = per.withColumn("capped", wide(F.col("cap")) * wide(F.col("heavy")) <= wide(F.col("weight")) * wide(F.col("left")))
    held = lambda c: F.sum(F.when("capped" if isinstance(c, str) else F.col("capped"), c).otherwise(0)).over(every)
    level = (F.col("total") - held(F.col("cap"))).cast("double") / F.nullif(F.col("all_weight") - held(F.col("weight")), F.lit(0)).cast("double")
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("weight") * level)
    return materialize(per.select("src", "source_size", "docs", target.alias("target")), "targets")


def _rate(lam: Column, x: Column, most: int) -> Column:
    return F.least(F.lit(float(most)), F.exp(F.least(lam * x, F.lit(math.log(most) + 1))))


def balance(sizes: DataFrame, targets: DataFrame, most: int = MOST) -> DataFrame:
    """``targets`` with the multiplier ``lam`` and the size scale of every source with words."""
    hist = materialize(sizes.filter("size > 0").groupBy("src", "size").agg(F.sum("rows").alias("n")), "size-histogram")
    shape = hist.groupBy("src").agg((F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("scale"), F.min("size").alias("least"))
    state = targets.join(shape, "src").withColumns(
        {
            "lam": F.lit(0.0),
            "low": F.when(F.col("target") >= F.col("source_size"), F.lit(0.0)).otherwise(F.lit(-1e6)),
            "high": F.when(F.col("target") >= F.col("source_size"), F.log(F.lit(float(most))) * F.col("scale") / F.col("least")).otherwise(F.lit(0.0)),
        }
    )
    # a target at the cap leaves no freedom: every rate is ``most``
    state = state.withColumn("lam", F.when(F.col("target") >= F.col("source_size") * most, F.col("high")).otherwise(F.col("lam")))
    state = materialize(state, "dual-0")
    for step in range(1, _STEPS + 1):
        x = F.col("size") / F.col("scale")
        words = F.col("n") * F.col("size") * _rate(F.col("lam"), x, most)
        slope = F.when(F.col("lam") * x < F.log(F.lit(float(most))), words * x).otherwise(0.0)
        sums = hist.join(state, "src").groupBy("src").agg(F.sum(words).alias("words"), F.sum(slope).alias("slope"))
        now = state.join(sums, "src").withColumn("over", F.col("words") - F.col("target"))
        now = now.withColumn("high", F.when(F.col("over") > 0, F.col("lam")).otherwise(F.col("high")))
        now = now.withColumn("low", F.when(F.col("over") <= 0, F.col("lam")).otherwise(F.col("low")))
        newton = F.col("lam") - F.col("over") / F.col("slope")
        inside = (F.col("slope") > 0) & (newton > F.col("low")) & (newton < F.col("high"))
        close = F.abs(F.col("over")) <= F.col("target") * _CLOSE
        lam = F.when(close, F.col("lam")).when(inside, newton).otherwise((F.col("low") + F.col("high")) / 2)
        older = state
        state = materialize(now.withColumns({"lam": lam, "close": close}).drop("words", "slope", "over").select("src", "source_size", "docs", "target", "scale", "least", "lam", "low", "high", "close"), f"dual-{step}")
        discard(older)
        if state.filter("NOT close").isEmpty():
            break
        state = state.drop("close")
    else:
        warnings.warn(f"{state.count()} sources have not met their targets within {_CLOSE} after {_STEPS} steps; the last multipliers stay", stacklevel=2)
    return state.select("src", "source_size", "docs", "target", "scale", "lam")


def _uniform(*cols: Column) -> Column:
    """A hash in [0, 1)."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 53)) / float(1 << 53)


def document_copies(docs: DataFrame, weights=WEIGHTS, most: int = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per input row: doc_id, src, n, size, source_size, target, copies, taken.

    ``size`` counts runs without ASCII white space (null: 0); ``n`` numbers the
    rows that agree in id, source and size from 1.  Null sources are one source;
    documents without words are taken once and count nothing.  The result
    depends on the rows alone, so reruns agree; an empty table gives no row.
    """
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), source_key(F.col(source_col)).alias("src"), word_count(F.col(text_col).cast("string")).alias("size"))
    sizes = materialize(picked.groupBy("doc_id", "src", "size").agg(F.count(F.lit(1)).alias("rows")), "sizes")
    targets = source_targets(sizes, weights, most)
    dual = balance(sizes, targets, most)
    known = targets.join(dual.select("src", "scale", "lam"), "src", "left")
    key = (F.coalesce("doc_id", F.lit(-1)), F.col("src"), F.col("size"))
    rows = sizes.join(materialize(known, "tilts"), "src").withColumn("n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    rows = rows.withColumns(
        {
            "rate": F.when(F.col("size") > 0, _rate(F.col("lam"), F.col("size") / F.col("scale"), most)).otherwise(1.0),
            # a golden-ratio walk spreads the repeats of one row evenly
            "u": (_uniform(*key) + F.col("n") * 0.6180339887498949) % 1.0,
            "pick": _uniform(*key, F.col("n"), F.lit(7)),
        }
    )
    rows = materialize(rows.select("doc_id", "src", "n", "size", "source_size", "target", "rate", "u", "pick", "docs"), "rates")
    rounded = (F.floor("rate") + (F.col("u") < F.col("rate") - F.floor("rate")).cast("long")).cast("long")
    likely = (F.col("size") > 0) & (F.col("pick") * F.col("docs") < 4 * HELD)
    order = Window.partitionBy("src").orderBy("pick", "doc_id", "size", "n")
    near = materialize(rows.filter(likely).withColumn("place", F.row_number().over(order)), "held-candidates")
    rest = rows.filter(~likely).unionByName(near.filter(F.col("place") > HELD).drop("place")).withColumn("copies", rounded)
    spent = rest.groupBy("src").agg(F.sum(F.col("copies") * F.col("size")).alias("spent"))
    one = F.struct(F.col("size").alias("size"), F.col("rate").alias("rate"), F.col("doc_id").alias("doc_id"), F.col("n").alias("n"))
    held = near.filter(F.col("place") <= HELD).groupBy("src").agg(F.sort_array(F.collect_list(one), asc=False).alias("docs"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    held = held.join(spent, "src", "left").withColumn("left", F.col("target") - F.coalesce("spent", F.lit(0)))

    def take(state: Column, d: Column) -> Column:
        short = state["left"] - state["due"]
        copies = F.greatest(F.lit(0), F.least(F.lit(most), F.round(d["rate"] + short / d["size"]))).cast("long")
        done = F.struct(d["doc_id"].alias("doc_id"), d["n"].alias("n"), d["size"].alias("size"), copies.alias("copies"))
        return F.struct((state["left"] - copies * d["size"]).alias("left"), (state["due"] - d["rate"] * d["size"]).alias("due"), F.concat(state["done"], F.array(done)).alias("done"))

    due = F.aggregate("docs", F.lit(0.0), lambda a, d: a + d["rate"] * d["size"])
    none = F.array().cast("array<struct<doc_id:bigint,n:bigint,size:bigint,copies:bigint>>")
    start = F.struct(F.col("left").alias("left"), due.alias("due"), none.alias("done"))
    held = held.select("src", "source_size", "target", F.explode(F.aggregate("docs", start, take)["done"]).alias("d")).select("src", "source_size", "target", "d.*")
    columns = ["doc_id", "src", "n", "size", "source_size", "target", "copies"]
    return rest.select(*columns).unionByName(held.select(*columns)).withColumn("taken", F.col("copies") * F.col("size"))


def mix_documents(docs: DataFrame, weights=WEIGHTS, most: int = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs``, with all their columns, repeated by their copies (none: gone)."""
    own = [fresh(docs, n) for n in ("__id", "__src", "__size", "__n")]
    copies = document_copies(docs, weights, most, id_col, text_col, source_col)
    copies = materialize(copies.select(*[F.col(c).alias(o) for c, o in zip(("doc_id", "src", "size", "n"), own, strict=True)], "copies"), "copies")
    keys = (F.col(id_col).cast("long"), source_key(F.col(source_col)), word_count(F.col(text_col).cast("string")))
    tag = docs.select("*", *[k.alias(o) for k, o in zip(keys, own, strict=False)])
    if copies.filter(F.col(own[3]) > 1).isEmpty():
        tag = tag.withColumn(own[3], F.lit(1).cast("long"))
    else:
        repeats = Window.partitionBy(*own[:3]).orderBy(F.xxhash64(text_col))
        tag = tag.withColumn(own[3], F.row_number().over(repeats).cast("long"))
    chosen = copies.filter("copies > 0").select(*own, F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    match = tag[own[0]].eqNullSafe(chosen[own[0]])
    for o in own[1:]:
        match = match & (tag[o] == chosen[o])
    return tag.join(chosen, match).select(*[tag[f"`{c}`"] for c in docs.columns])


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = document_copies(read_table(spark, sf_dir, "documents"))
    source = F.when(F.col("src") != "2", F.substring(F.col("src"), F.lit(2), F.length("src")))
    return mixed.select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", "taken", source.alias("source"), "copies")
