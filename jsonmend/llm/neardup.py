"""Operator 4, near-duplicates: SuperMinHash, banding, verification, union-find.

SuperMinHash (Ertl) gives each shingle a random permutation of the signature's
slots and the values j + r_j along it; a slot keeps its minimum.  The ranks are
correlated over slots, which lowers the estimator's variance below MinHash, and
a level j can be skipped once every slot holds a value under j.  Here whole
batches of documents run through the levels together in NumPy.

Bands of the signature are hashed to bucket keys.  The number of bands follows
from the similarity and ``MISS``, the chance that a pair exactly at the
threshold meets in no bucket.

A bucket is never expanded into all its pairs.  Its members are compared with
one leader; union-find merges what is linked.  Only buckets that still hold
several components go on, and there only members outside the largest one
(minors).  They are compared with their bucket if that is up to ``FEW`` pairs,
less those that the distances to the common leader rule out (Jaccard distance is
a metric) or that sizes rule out.

Larger buckets are decided around centres.  A centre is the document that meets
most of a bucket's members elsewhere too, so one serves many buckets.  Members
are compared with it, and with further leaders while those find links.  What
stays apart is held as its difference from the centre.  A shingle in only one
document's difference counts in every distance of that document; the number of
such lone shingles and the size of the rest bound the distance of any two
documents from below, and most are ruled out by the least values of the other
components alone.  A prefix join over the remaining differences, rarest shingle
first, complete for the threshold, decides the rest.  Every link is confirmed on
the full shingle sets.

A shingle is held as a 64-bit hash of its words' 64-bit SipHash values.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jsonmend.llm.common import discard, fresh, materialize, read_table, release, small_batches, text_slices
from jsonmend.llm.components import components

#: Signature slots in a band.
ROWS = 4
#: Highest chance that a pair at the threshold shares no band.
MISS = 1e-7
#: Pairs of minors and members up to which a bucket is compared outright.
FEW = 1024
#: Minors of a bucket up to which it gets no further leader.
STRANGERS = 32
#: Most rounds of leaders after the centres; they end once few links are found.
STARS = 8
_GOLDEN = 0x9E3779B97F4A7C15


def bands_for(percent: int, rows: int = ROWS, miss: float = MISS) -> int:
    return math.ceil(math.log(miss) / math.log(1 - (percent / 100) ** rows))


def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser, on wrapping 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text.

    Words are runs without ASCII white space, A-Z folded; a text with fewer
    than ``width`` words has its whole sequence as one shingle, one without
    words (or null) has none.
    """
    split = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]
    words = [w for s in split for w in s]
    hashes = pd.util.hash_array(np.array(words, dtype=object), categorize=False) if words else np.zeros(0, np.uint64)
    out, at = [], 0
    for s in split:
        n = len(s)
        h = hashes[at : at + n]
        at += n
        if not n:
            out.append(h)
            continue
        size = min(width, n)
        acc = np.full(n - size + 1, size, dtype=np.uint64)
        for k in range(size):
            acc = _mix(acc * np.uint64(0xD6E8FEB86659FD93) + h[k : n - size + 1 + k])
        out.append(np.unique(acc))
    return out


def super_minhash(sets: list[np.ndarray], slots: int) -> np.ndarray:
    """(len(sets), slots) signature; a slot is level << 32 | r, an empty set keeps the maximum."""
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    signature = np.full((len(sets), slots), top, dtype=np.uint64)
    flat = signature.reshape(-1)
    elements = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    perm = None
    for level in range(slots):
        if not len(elements):
            break
        x = _mix(elements + np.uint64(_GOLDEN * (level + 1) & 0xFFFFFFFFFFFFFFFF))
        k = level + (((x & np.uint64(0xFFFFFFFF)) * np.uint64(slots - level)) >> np.uint64(32)).astype(np.int64)
        value = np.uint64(level) << np.uint64(32) | x >> np.uint64(32)
        if perm is None:
            slot = k
        else:
            rows = np.arange(len(elements))
            slot = perm[rows, k].astype(np.int64)
            perm[rows, k] = perm[:, level]
        np.minimum.at(flat, doc * slots + slot, value)
        open_docs = signature.max(axis=1) >= np.uint64(level + 1) << np.uint64(32)
        keep = open_docs[doc]
        if perm is None:
            elements, doc, k = elements[keep], doc[keep], k[keep]
            perm = np.tile(np.arange(slots, dtype=np.uint16), (len(elements), 1))
            perm[np.arange(len(elements)), k] = 0
        elif not keep.all():
            elements, doc, perm = elements[keep], doc[keep], perm[keep]
    return signature


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(documents, bands) bucket keys; a key names its band too."""
    acc = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(signature), bands))
    parts = signature.reshape(len(signature), bands, rows)
    for k in range(rows):
        acc = _mix(acc * np.uint64(0xD6E8FEB86659FD93) + parts[:, :, k])
    return acc.view(np.int64)


def _batched(batches: Iterator[pa.RecordBatch], width: int):
    """(ids, sets) of runs of about half a million characters."""
    for batch in batches:
        for start in range(0, batch.num_rows, 1024):
            part = batch.slice(start, 1024)
            texts = part.column(1).to_pylist()
            for a, b in text_slices([t or "" for t in texts], 500_000):
                yield part.column(0).slice(a, b - a), shingle_sets(texts[a:b], width)
    release()


def _print_of(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _sketches(width: int, bands: int, rows: int):
    def run(batches):
        for ids, sets in _batched(batches, width):
            keys = band_keys(super_minhash(sets, bands * rows), bands, rows)
            yield pa.RecordBatch.from_arrays(
                [
                    ids,
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_print_of(s) for s in sets], pa.binary()),
                    pa.array([list(k) if len(s) else [] for k, s in zip(keys, sets, strict=True)], pa.list_(pa.int64())),
                ],
                ["doc_id", "n", "print", "keys"],
            )

    return run


def _sets(width: int):
    def run(batches):
        for ids, sets in _batched(batches, width):
            yield pa.RecordBatch.from_arrays([ids, pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["doc_id", "shingles"])

    return run


class _Search:
    """The link search over one corpus; ``percent`` is the similarity threshold."""

    def __init__(self, docs: DataFrame, percent: int, width: int):
        self.docs, self.percent, self.width = docs, percent, width
        self.checked: list[DataFrame] = []
        self.edges: list[DataFrame] = []

    def linked(self, inter: Column, n_a: Column, n_b: Column) -> Column:
        return 100 * inter >= self.percent * (n_a + n_b - inter)

    def sizes_fit(self, n_a: Column, n_b: Column) -> Column:
        """No pair whose sizes differ more can reach the threshold."""
        return 100 * F.least(n_a, n_b) >= self.percent * F.greatest(n_a, n_b)

    def load_sets(self, ids: DataFrame, repeated: bool) -> None:
        own = self.docs.join(ids, "doc_id", "left_semi")
        sets = own.mapInArrow(_sets(self.width), "doc_id long, shingles array<long>")
        self.sets = materialize(sets.distinct() if repeated else sets, "shingle-sets")

    def check(self, pairs: DataFrame) -> DataFrame:
        """(a, b, inter, n_a, n_b) of distinct pairs; links become edges."""
        a = self.sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("set_a"))
        b = self.sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("set_b"))
        both = pairs.select("a", "b").distinct().join(a, "a").join(b, "b")
        out = both.select("a", "b", F.size(F.array_intersect("set_a", "set_b")).cast("long").alias("inter"), F.size("set_a").cast("long").alias("n_a"), F.size("set_b").cast("long").alias("n_b"))
        out = materialize(out, "checked")
        self.checked.append(out)
        self.edges.append(out.filter(self.linked(F.col("inter"), F.col("n_a"), F.col("n_b"))).select("a", "b"))
        return out

    def components(self) -> DataFrame:
        edges = self.edges[0]
        for more in self.edges[1:]:
            edges = edges.unionByName(more)
        return components(edges)

    def remaining(self, members: DataFrame) -> DataFrame:
        """Members of buckets with several components, with comp, ``minor`` and the bucket's pairs of minors and members."""
        labelled = members.join(self.labels, members["doc_id"] == self.labels["node"], "left").select(members["*"], F.coalesce("comp", "doc_id").alias("comp"))
        labelled = materialize(labelled, "labelled")
        parts = labelled.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("rows"))
        major = parts.groupBy("key").agg(F.max(F.struct("rows", "comp")).alias("major"), F.sum("rows").alias("all"), F.count(F.lit(1)).alias("comps"))
        major = materialize(major.filter("comps > 1").select("key", F.col("major.comp").alias("major"), ((F.col("all") - F.col("major.rows")) * F.col("all")).alias("pairs")), "majors")
        return materialize(labelled.join(major, "key").withColumn("minor", F.col("comp") != F.col("major")).drop("major"), "remaining")

    def few(self, rest: DataFrame) -> DataFrame:
        """Pairs of minor members with members of other components of their bucket."""
        known = self.checked[0].select(F.col("a").alias("doc_id"), F.col("b").alias("leader"), (F.col("inter") / (F.col("n_a") + F.col("n_b") - F.col("inter"))).alias("near"))
        rest = rest.join(known, ["doc_id", "leader"], "left").withColumn("near", F.when(F.col("doc_id") == F.col("leader"), 1.0).otherwise(F.col("near")))
        x, y = rest.filter("minor").alias("x"), rest.alias("y")
        apart = (F.col("x.comp") != F.col("y.comp")) & (~F.col("y.minor") | (F.col("x.doc_id") < F.col("y.doc_id")))
        reach = F.abs(F.col("x.near") - F.col("y.near")) <= 1 - self.percent / 100 + 1e-9
        fit = self.sizes_fit(F.col("x.n"), F.col("y.n")) & F.coalesce(reach, F.lit(True))
        pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & apart & fit)
        return pairs.select(F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b"))

    def centres(self, crowded: DataFrame) -> DataFrame:
        """(key, centre): the document round which a crowded bucket is decided; it need not be a member.

        A document in many crowded buckets lies in the middle of its kind.  Each
        member's home is the best such document of its buckets, and a bucket
        takes the home of most members, so that kindred buckets share a centre.
        """
        often = materialize(crowded.groupBy("doc_id").agg(F.count(F.lit(1)).alias("buckets")), "buckets-of")
        best = F.max(F.struct("buckets", (-F.col("doc_id")).alias("first"))).alias("best")
        tops = materialize(crowded.select("key", "doc_id").join(often, "doc_id").groupBy("key").agg(best), "tops")
        homes = materialize(crowded.select("key", "doc_id").join(tops, "key").groupBy("doc_id").agg((-F.max("best")["first"]).alias("home")), "homes")
        votes = crowded.select("key", "doc_id").join(homes, "doc_id").groupBy("key", "home").agg(F.count(F.lit(1)).alias("votes"))
        most = F.max(F.struct("votes", (-F.col("home")).alias("first")))
        return materialize(votes.groupBy("key").agg((-most["first"]).alias("centre")), "centres")

    def reachable(self, rows: DataFrame, label: str) -> DataFrame:
        """``rows`` (centre, doc_id, comp, n, lone, rest, …) without those that no other component reaches; adds far, near, slack.

        For two documents of one centre the distance is at least lone + lone' +
        abs(rest - rest'), and it must not exceed k (n + n').  In units of 1 /
        (100 + percent): far = lone + rest - kn, near = lone - rest - kn, and
        both far + near' and near + far' must not be positive.  ``slack`` is kn -
        lone plus the most that another component has of it.
        """
        own, of_n = 100 + self.percent, 100 - self.percent
        rows = rows.withColumns({"far": own * (F.col("lone") + F.col("rest")) - of_n * F.col("n"), "near": own * (F.col("lone") - F.col("rest")) - of_n * F.col("n"), "left": of_n * F.col("n") - own * F.col("lone")})
        parts = rows.groupBy("centre", "comp").agg(F.min("far").alias("far"), F.min("near").alias("near"), F.min(-F.col("left")).alias("gap"))
        parts, names = materialize(parts, f"{label}-parts"), ("far", "near", "gap")
        first = materialize(parts.groupBy("centre").agg(*[F.min(F.struct(n, "comp")).alias(n) for n in names]), f"{label}-least")
        other = [F.min(F.when(F.col("p.comp") != F.col(f"f.{n}.comp"), F.col(f"p.{n}"))).alias(f"{n}_2") for n in names]
        second = parts.alias("p").join(first.alias("f"), F.col("p.centre") == F.col("f.centre")).groupBy(F.col("p.centre").alias("centre")).agg(*other)
        least = first.join(second, "centre").select("centre", *[F.col(n).alias(f"{n}_1") for n in names], *[f"{n}_2" for n in names])
        others = {n: F.when(F.col(f"{n}_1.comp") != F.col("comp"), F.col(f"{n}_1.{n}")).otherwise(F.col(f"{n}_2")) for n in names}
        kept = rows.join(materialize(least, f"{label}-bounds"), "centre").filter((F.col("far") + others["near"] <= 0) & (F.col("near") + others["far"] <= 0))
        return materialize(kept.withColumn("slack", F.col("left") - others["gap"]).drop("left", *[f"{n}_{k}" for n in names for k in (1, 2)]), label)

    def many(self, crowded: DataFrame, centres: DataFrame) -> DataFrame:
        """Pairs of crowded buckets that complete their links, without comparing all.

        With away(x) the symmetric difference of x and the centre, two sets
        differ in |away(x) ^ away(y)| shingles, and at the threshold t in at most
        k (|x| + |y|) with k = (1 - t) / (1 + t).  So a linked pair either has
        |away(x)| + |away(y)| within that, and then both are linked to the
        document of least |away| - k size, one pair each; or it shares an away
        shingle, and is found by the prefix join, which also decides it.
        """
        placed = crowded.join(centres, "key").groupBy("centre", "doc_id").agg(F.min("comp").alias("comp"))
        middle = self.sets.select(F.col("doc_id").alias("centre"), F.col("shingles").alias("middle"))
        rows = placed.join(self.sets, "doc_id").join(middle, "centre")
        own, missing = F.array_except("shingles", "middle"), F.array_except("middle", "shingles")
        rows = materialize(rows.select("centre", "doc_id", "comp", F.size("shingles").cast("long").alias("n"), own.alias("own"), missing.alias("missing")), "away")
        # first only what the documents have and the centre lacks
        held = rows.select("centre", "doc_id", F.explode("own").alias("token")).groupBy("centre", "token").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("holders"))
        lone = materialize(held.filter("holders = 1").groupBy("centre", "doc_id").agg(F.count(F.lit(1)).alias("lone")), "lone-shingles")
        rows = rows.join(lone, ["centre", "doc_id"], "left").select("centre", "doc_id", "comp", "n", F.coalesce("lone", F.lit(0)).alias("lone"), F.concat("own", "missing").alias("away"))
        rows = self.reachable(rows.withColumn("rest", F.size("away") - F.col("lone")), "reachable-own").select("centre", "doc_id", "comp", "n", "away")
        # then the whole differences of those left
        held = materialize(rows.select("centre", "doc_id", F.explode("away").alias("token")), "away-shingles")
        holders = held.groupBy("centre", "token").agg(F.count(F.lit(1)).alias("holders"))
        alone = F.col("holders") == 1
        order = F.sort_array(F.collect_list(F.when(~alone, F.struct("holders", "token"))))["token"].alias("shared")
        sorted_rows = held.join(holders, ["centre", "token"]).groupBy("centre", "doc_id").agg(F.count(F.when(alone, 1)).alias("lone"), order)
        rows = rows.drop("away").join(materialize(sorted_rows, "ordered"), ["centre", "doc_id"], "left")
        rows = rows.withColumns({"lone": F.coalesce("lone", F.lit(0)), "shared": F.coalesce("shared", F.array().cast("array<long>"))})
        rows = self.reachable(rows.withColumn("rest", F.size("shared").cast("long")), "reachable")
        inner = rows.groupBy("centre").agg(F.min(F.struct("far", "doc_id", "comp")).alias("b"))
        within = rows.join(materialize(inner, "inner"), "centre").filter((F.col("far") + F.col("b.far") <= 0) & (F.col("comp") != F.col("b.comp")))
        pairs = within.select(F.least("doc_id", "b.doc_id").alias("a"), F.greatest("doc_id", "b.doc_id").alias("b"))
        counts = rows.groupBy("centre", "comp").agg(F.count(F.lit(1)).alias("rows")).groupBy("centre").agg(F.max(F.struct("rows", "comp")).alias("major"))
        length = F.floor(F.col("slack") / (100 + self.percent)) + 1
        rows = rows.join(materialize(counts, "majors-of"), "centre").withColumn("minor", F.col("comp") != F.col("major.comp")).drop("major")
        rows = rows.filter(length > 0).withColumn("prefix", F.slice("shared", F.lit(1), length.cast("int")))
        rows = materialize(rows.withColumn("token", F.explode("prefix")), "prefixes")
        x, y = rows.filter("minor").alias("x"), rows.alias("y")
        apart = (F.col("x.comp") != F.col("y.comp")) & (~F.col("y.minor") | (F.col("x.doc_id") < F.col("y.doc_id")))
        bound = (F.col("x.far") + F.col("y.near") <= 0) & (F.col("x.near") + F.col("y.far") <= 0)
        differ = F.col("x.lone") + F.col("x.rest") + F.col("y.lone") + F.col("y.rest") - 2 * F.size(F.array_intersect("x.shared", "y.shared"))
        both = F.col("x.n") + F.col("y.n")
        close = 100 * (both - differ) >= self.percent * (both + differ)
        once = F.element_at(F.array_intersect("x.prefix", "y.prefix"), 1) == F.col("x.token")
        found = x.join(y, (F.col("x.centre") == F.col("y.centre")) & (F.col("x.token") == F.col("y.token")) & apart & bound & once & close)
        return pairs.unionByName(found.select(F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b")))

    def stars(self, crowded: DataFrame, centres: DataFrame) -> DataFrame:
        """Crowded buckets after their minors met the centre, and further leaders while those find links."""
        base = ["key", "doc_id", "n", "leader"]
        own = self.labels.select(F.col("node").alias("centre"), F.col("comp").alias("found"))
        to = materialize(centres.join(own, "centre", "left").select("key", F.col("centre").alias("id"), F.coalesce("found", "centre").alias("to_comp")), "centres-of")
        tried = self.check(crowded.join(to, "key").filter("comp <> to_comp").select(F.col("doc_id").alias("a"), F.col("id").alias("b")))
        for star in range(STARS):
            linked = self.edges[-1].count()
            if linked:
                self.labels = self.components()
                crowded = self.remaining(crowded.select(*base))
            if 10 * linked < tried.count():
                break  # the members left are mostly strangers
            pick = F.struct(F.xxhash64("doc_id", F.lit(star)).alias("rank"), F.col("doc_id").alias("id"), F.col("comp").alias("comp"))
            lone = crowded.filter("minor")
            leaders = lone.groupBy("key").agg(F.min(pick).alias("to"), F.count(F.lit(1)).alias("left")).filter(F.col("left") > STRANGERS)
            leaders = materialize(leaders.select("key", "to.id", F.col("to.comp").alias("to_comp")), "leaders")
            tried = self.check(lone.join(leaders, "key").filter("comp <> to_comp").select(F.col("doc_id").alias("a"), F.col("id").alias("b")))
        return crowded

    def run(self, members: DataFrame) -> DataFrame:
        """(node, comp) after every pair that meets in a bucket is decided."""
        self.check(members.filter("doc_id <> leader").select(F.col("doc_id").alias("a"), F.col("leader").alias("b")))
        self.labels = self.components()
        rest = self.remaining(members)
        if rest.isEmpty():
            return self.labels
        crowded = rest.filter(F.col("pairs") > FEW)
        pairs = self.few(rest.filter(F.col("pairs") <= FEW))
        if not crowded.isEmpty():
            crowded = materialize(crowded, "crowded")
            centres = self.centres(crowded)
            pairs = pairs.unionByName(self.many(self.stars(crowded, centres), centres))
        self.check(pairs)
        return self.components()


def near_groups(docs: DataFrame, percent: int = 80, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Documents are linked at Jaccard similarity ``percent`` / 100 or more of
    their sets of ``width``-word shingles; a component's id is its smallest
    doc_id.  A text without words is linked with nothing.  Rows that share a
    doc_id are one document and always in one component; a row with a null id
    is linked with nothing, has component_id null and stays.  An empty table
    gives no row.
    """
    bands = bands_for(percent)
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketch = materialize(docs.mapInArrow(_sketches(width, bands, ROWS), "doc_id long, n long, print binary, keys array<long>"), "sketches")
    usable = sketch.filter("n > 0 AND doc_id IS NOT NULL")
    reps = materialize(usable.groupBy("print", "n").agg(F.min(F.struct("doc_id", "keys")).alias("rep")).select("print", "n", "rep.*"), "representatives")
    rows = reps.select("doc_id", "n", F.explode("keys").alias("key"))
    buckets = rows.groupBy("key").agg(F.min("doc_id").alias("leader"), F.max("doc_id").alias("most")).filter("leader <> most").drop("most")
    members = materialize(rows.join(materialize(buckets, "buckets"), "key"), "members")

    search = _Search(docs.filter("doc_id IS NOT NULL"), percent, width)
    several = materialize(sketch.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "repeated-ids")
    repeated = not several.isEmpty()
    if repeated:  # the sets under one id are one document
        own = usable.join(several, "doc_id").select("print", "n", F.col("doc_id").alias("id")).join(reps.select("print", "n", "doc_id"), ["print", "n"])
        search.edges.append(own.select(F.col("id").alias("a"), F.col("doc_id").alias("b")))
    search.load_sets(members.select("doc_id").distinct(), repeated)
    labels = search.run(members)
    low = materialize(labels.groupBy("comp").agg(F.min("node").alias("component_id")), "component-ids")
    named = materialize(labels.join(low, "comp").select(F.col("node").alias("doc_id"), "component_id"), "components")
    by_set = materialize(reps.join(named, "doc_id").select("print", "n", "component_id"), "set-components")
    out = sketch.select("doc_id", "n", "print").join(by_set, ["print", "n"], "left")
    if repeated:
        by_id = named.withColumnRenamed("component_id", "own_id")
        out = out.join(by_id, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "own_id"))
    lone = reps.select("print", "n", F.col("doc_id").alias("rep"))
    out = out.join(lone, ["print", "n"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "rep", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def drop_near_copies(docs: DataFrame, percent: int = 80, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one document a component."""
    own = fresh(docs, "__gone")
    gone = materialize(near_groups(docs, percent, width, id_col, text_col).filter("NOT kept").select(F.col("doc_id").alias(own)).distinct(), "near-copies")
    return docs.join(gone, docs[f"`{id_col}`"] == gone[own], "left_anti")


def op4_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(read_table(spark, sf_dir, "documents"), percent=85, width=3)


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 1), lambda k: ws[k] || ' ' || ws[k + 1] || ' ' || ws[k + 2]) END) AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n FROM s),
e AS (SELECT doc_id, unnest(sh) AS t FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM e a JOIN e b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * i >= 85 * (nx.n + ny.n - i)),
g AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT doc_id AS x, doc_id AS c FROM n UNION SELECT g.y, r.c FROM r JOIN g ON g.x = r.x)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, min(r.c) AS component_id, n.doc_id = min(r.c) AS kept FROM n JOIN r ON r.x = n.doc_id GROUP BY n.doc_id, n.n
"""
