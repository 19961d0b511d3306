"""A Merkle manifest of a data set: a tree of digests per source, and proofs that a document belongs to it.

Nodes are content-addressed records (digest -> up to 16 child digests), kept by height. To prove documents, requests
descend from the root by the digits of their rank. Requests that share leading digits share the way down, so a record
is fetched once for all leaves below it and the work grows with the number of nodes. On the way the children that are
not chosen are collected; reversed, these segments lead from the leaf to the root.

Ranks of documents within a source come from a range partitioning and the row counts of its parts, so no source is
sorted by one task, however large it is. Only depths (a number per tree) reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, remainder

#: Children of a node.
FAN = 16
#: What a leaf's digest is of, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_SEATS = 33  # bits of the row's place in monotonically_increasing_id
_HEIGHTS = 15  # 16 ** 15 leaves are more than a long counts


def digest(*texts: Column) -> Column:
    return F.sha2(F.concat(*texts), 256)


def field(column: Column) -> Column:
    """`-` for null, else the UTF-8 length, a colon and the value."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(**changed: Column) -> Column:
    """A document's digest, with some of its fields replaced."""
    return digest(*[field(changed.get(name, F.col(name))) for name in FIELDS])


def lower_ascii(text: Column) -> Column:
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, letters, letters.lower())


def height_of(leaves: Column) -> Column:
    """Levels above so many leaves: none above one, one above 16, two above 17."""
    height = F.lit(0)
    for level in range(_HEIGHTS):
        height = height + (leaves > FAN**level).cast("int")
    return height


def _seated(rows: DataFrame, *order: str) -> DataFrame:
    """`rows` in order over all partitions, nulls first, with columns `part` and `seat` (the place within it).

    The checkpoint fixes who sits where, so a lost executor cannot deal the rows anew.
    """
    dealt = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order))
    place = F.monotonically_increasing_id()
    return dealt.select("*", F.shiftright(place, _SEATS).alias("part"), place.bitwiseAND((1 << _SEATS) - 1).alias("seat"))


def _shifts(seated: DataFrame, *group: str) -> DataFrame:
    """Per part and group: `shift`, to be added to a seat to get the rank within the group. One row each."""
    before = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = seated.groupBy("part", *group).agg(F.min("seat").alias("first"), F.count(F.lit(1)).alias("count"))
    return counts.select("part", *group, "count", (F.coalesce(F.sum("count").over(before), F.lit(0)) - F.col("first")).alias("shift"))


@dataclass(frozen=True)
class Tree:
    """Trees, one for each `tree`: `tops` (tree, leaves, digest, height), and records (digest, children) by height."""

    tops: DataFrame
    records: list[DataFrame]


def grow(leaves: DataFrame) -> Tree:
    """Trees over leaves (tree, rank, leaves, digest), where `leaves` is the number of leaves in the tree.

    A level is 16 times smaller than the one below it; every run of children is a group of its own.
    """
    tallest = leaves.agg(F.max(height_of(F.col("leaves")))).first()[0] or 0
    nodes, tops, records = leaves.withColumn("width", F.col("leaves")), [], []
    for level in range(tallest + 1):
        tops.append(nodes.where("width = 1").select("tree", "leaves", "digest", F.lit(level).alias("height")))
        if level == tallest:
            break
        run = F.sort_array(F.collect_list(F.struct("rank", "digest")))
        runs = (
            nodes.where("width > 1")
            .groupBy("tree", F.floor(F.col("rank") / FAN).alias("rank"))
            .agg(run.alias("run"), F.first("leaves").alias("leaves"), F.first("width").alias("width"))
            .withColumn("children", F.col("run.digest"))
        )
        nodes = cut(runs.select(
            "tree", "rank", "leaves", "children", F.ceil(F.col("width") / FAN).alias("width"),
            digest(F.array_join("children", "")).alias("digest")))
        records.append(nodes.select("digest", "children").dropDuplicates(["digest"]))
    out = tops[0]
    for more in tops[1:]:
        out = out.unionByName(more)
    return Tree(cut(out), records)


def _segment(children: Column, digit: Column) -> Column:
    """The children before and after the chosen one, each as one text."""
    return F.struct(
        F.array_join(F.slice(children, F.lit(1), digit), "").alias("before"),
        F.array_join(F.slice(children, digit + 2, F.lit(FAN)), "").alias("after"))


def _step_down(nodes: DataFrame, records: DataFrame) -> DataFrame:
    """All children of `nodes` (digest, rank, path, ...), with the segment of unselected children added to the path."""
    found = nodes.join(records, "digest")
    kept = [c for c in nodes.columns if c not in ("digest", "rank", "path")]
    return found.select("rank", "path", "children", *kept, F.posexplode("children").alias("digit", "digest")).select(
        "digest", (F.col("rank") * FAN + F.col("digit")).alias("rank"),
        F.concat("path", F.array(_segment(F.col("children"), F.col("digit")))).alias("path"), *kept)


@dataclass(frozen=True)
class Manifest:
    """`leaves`: (source, rank, tree, leaves, digest, doc_id, ...) of every document; the trees of the sources, and
    the tree of their roots, whose leaves are ranked as the sources are."""

    leaves: DataFrame
    sources: Tree
    whole: Tree


def manifest(docs: DataFrame, also: dict[str, Column] | None = None) -> Manifest:
    """The manifest of `docs`, ordered by id within a source; sources are in the order of their bytes, null first.

    Documents without an id come first; equal ids are in the order of their digests. Null fields count as `-`, an
    empty text as `0:`, so the two differ. Other columns of `docs` play no part. `also` adds columns to the leaves.
    """
    also = also or {}
    # Texts are read and hashed here, once.
    rows = cut(docs.select(
        "source", "doc_id", leaf_digest().alias("digest"), *[c.alias(name) for name, c in also.items()]))
    seated = _seated(rows, "source", "doc_id", "digest")
    shifts = cut(_shifts(seated, "source"))
    named = _seated(shifts.groupBy("source").agg(F.sum("count").alias("leaves")), "source")
    trees = named.join(_shifts(named).select("part", "shift"), "part").select(
        F.col("source").alias("name"), "leaves", (F.col("seat") + F.col("shift")).alias("tree"))
    trees = cut(trees)
    known = shifts.join(trees, F.col("source").eqNullSafe(F.col("name"))).select(
        "part", F.col("source").alias("name"), "tree", "leaves", "shift")
    match = (seated["part"] == known["part"]) & seated["source"].eqNullSafe(known["name"])
    leaves = cut(seated.join(known, match).select(
        "source", "tree", "leaves", (F.col("seat") + F.col("shift")).alias("rank"), "digest", "doc_id", *also))
    sources = grow(leaves.select("tree", "rank", "leaves", "digest"))
    tops = sources.tops.select(
        F.lit(0).alias("tree"), F.col("tree").alias("rank"), F.lit(trees.count()).alias("leaves"), "digest")
    return Manifest(leaves, sources, grow(tops))


def runs_of_leaves(made: Manifest) -> DataFrame:
    """Every run of leaves, found from the root: (tree, rank of the run, children, alone, path, subroot, root).

    `path` has the unselected children above the run, top first. A source of one document has no run: its leaf is
    the only child, and `alone` is true.
    """
    nodes = made.whole.tops.select(
        "digest", F.lit(0).cast("long").alias("rank"), F.array().cast("array<struct<before:string,after:string>>").alias("path"),
        F.col("digest").alias("root"))
    for records in reversed(made.whole.records):
        nodes = _step_down(nodes, records)
    found = nodes.withColumnRenamed("rank", "tree").withColumnRenamed("digest", "subroot")
    tops = made.sources.tops.select("tree", "height")
    starts = cut(found.join(tops, "tree").select(
        "tree", F.col("subroot").alias("digest"), F.lit(0).cast("long").alias("rank"), "path", "subroot", "root", "height"))
    tallest = len(made.sources.records)
    nodes = starts.where(F.col("height") == tallest)
    for height in range(tallest, 1, -1):
        below = _step_down(nodes, made.sources.records[height - 1])
        nodes = below.unionByName(starts.where(F.col("height") == height - 1))
    alone = starts.where("height = 0").select(
        "tree", "rank", F.array("digest").alias("children"), F.lit(True).alias("alone"), "path", "subroot", "root")
    if not tallest:
        return alone
    runs = nodes.join(made.sources.records[0], "digest").select(
        "tree", "rank", "children", F.lit(False).alias("alone"), "path", "subroot", "root")
    return runs.unionByName(alone)


def proofs(made: Manifest, *also: str) -> DataFrame:
    """Per document: doc_id, leaf, subroot, root, and `path`, the segments (before, after) from the leaf to the root."""
    digit = (F.col("rank") % FAN).cast("int")
    wanted = F.sort_array(F.collect_list(F.struct(digit.alias("digit"), "doc_id", *also)))
    asked = made.leaves.groupBy("tree", F.floor(F.col("rank") / FAN).alias("rank")).agg(wanted.alias("asked"))
    each = runs_of_leaves(made).join(asked, ["tree", "rank"]).withColumn("one", F.explode("asked"))
    chosen = F.col("one.digit")
    own = F.when(F.col("alone"), F.slice("path", 1, 0)).otherwise(F.array(_segment(F.col("children"), chosen)))
    return each.select(
        "one.doc_id", F.get("children", chosen).alias("leaf"), "subroot", "root",
        F.concat(own, F.reverse("path")).alias("path"), *[f"one.{name}" for name in also])


def fold(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and its path."""
    return F.aggregate(path, leaf, lambda below, at: digest(at["before"], below, at["after"]))


def proof_digest(path: Column) -> Column:
    """One digest of all siblings, from the leaf's to the root's, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda at: F.concat(at["before"], at["after"])), ""), 256)


def tampered(divisor: int = 5) -> Column:
    """Rows to tamper with: those whose id's crc32 `divisor` divides; a missing id counts as empty text."""
    return remainder("doc_id", divisor) == 0


def audit(docs: DataFrame, change: Column | None = None) -> DataFrame:
    """Every document's proof, and the root that follows when the rows of `change` have lower-case texts.

    Columns doc_id, leaf, subroot, root, proof_sha256, folded_root, verified. A document whose text has no capital
    stays as it is, and so does a null text. Repeated rows are separate leaves, with a row each. An empty table gives no row.
    """
    change = tampered() if change is None else change
    altered = F.when(change, leaf_digest(text=lower_ascii(F.col("text"))))
    found = proofs(manifest(docs, {"altered": altered}), "altered")
    return found.select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"),
        fold(F.coalesce("altered", "leaf"), F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
