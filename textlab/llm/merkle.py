"""Merkle manifest of a dataset, with proofs built by pointer jumping.

Every row is a leaf, the SHA-256 of its listed columns.  The leaves of a group
(a source) ascend by key; every ``FAN`` consecutive nodes, the last run fewer,
become one node, the digest of theirs, until one is left, the group's subroot.
The subroots, by group, are the leaves of the top tree, which ends in the root.

*Numbers.*  A node is (tree, level, place); the top tree is tree -1, and a
group's last node is the top tree's leaf (-1, 0, tree).  Leaves get their places
from a range partitioning by (group, key, leaf) and the counts of its (partition,
group) pairs, so that no group, however large, is in one task.

*Levels.*  A level is one grouping of the level below by (tree, place // FAN):
``FAN`` rows a group, a sixteenth of the rows each time.

*Proofs.*  Each inner node holds a pointer to its parent and a segment: the
digests of its siblings left and right of it.  In every round a self-join sends
each pointer to its target's target and joins the two segments, so that the
distance doubles: the logarithm of the height in rounds.  A target of more than
``HOT`` rows is dealt out to copies of itself, one for each ``HOT`` rows; the
list of these targets is at most a ``HOT``-th of the inner nodes; up to
``BROADCAST_ROWS`` it is broadcast, so that the pointers are not dealt by target
first.  Leaves take their last jump at the
end, one run of ``FAN`` leaves at a time, so that the proofs of all leaves
(about a kilobyte a level) never travel.

Only built-in functions are used.  Numbers that reach the driver: the largest
group, the number of groups, the root.

Cases: a null group comes first and a null key before all keys; equal keys are
ordered by leaf digest (equal leaves are interchangeable); null values are
written ``-``, empty ones ``0:``; one leaf is a tree without siblings; an empty
table gives an empty result; input columns named like an output are replaced,
other columns are dropped, as the manifest has one row per leaf.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, materialise_table

FAN = 16
HOT = 256
BROADCAST_ROWS = 1_000_000
TOP = -1
EMPTY_SEGMENT = "array<struct<left: string, right: string>>"


def field(value: Column) -> Column:
    """A value as ``-`` if null, else its UTF-8 byte count, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*(p.cast("string") for p in parts)), 256)


def leaf_digest(*values: Column) -> Column:
    return digest(*map(field, values))


def placed(leaves: DataFrame) -> DataFrame:
    """``leaves`` (grp, key, leaf, ...) plus ``tree``, ``place`` and ``count``:
    the group's number, the leaf's place in it and the group's size."""
    order = [F.col("grp").asc_nulls_first(), F.col("key").asc_nulls_first(), F.col("leaf")]
    # the number of a row in its sorted partition comes with the partition's number
    ranged = materialise(leaves.repartitionByRange(*order[:2]).sortWithinPartitions(*order)
                         .withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    stats = ranged.groupBy(part.alias("part"), "grp").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    by_group = Window.partitionBy("grp").orderBy("part")
    stats = materialise(stats.withColumn("before", F.coalesce(F.sum("n").over(by_group.rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0))).withColumn("count", F.sum("n").over(Window.partitionBy("grp"))))
    starts = stats.where("before = 0")  # one row a group
    parts = starts.groupBy("part").agg(F.count("*").alias("groups"))  # one row a partition
    parts = parts.select("part", F.coalesce(F.sum("groups").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("trees"))
    trees = starts.join(parts, "part").select(
        F.col("grp").alias("g"), (F.col("trees") + F.row_number().over(Window.partitionBy("part").orderBy("first")) - 1)
        .cast("long").alias("tree"))
    stats = stats.join(trees, stats.grp.eqNullSafe(trees.g)).select("part", "grp", "first", "before", "count", "tree")
    r, s = ranged.withColumn("part", part).alias("r"), stats.alias("s")
    return (r.join(s, (F.col("r.part") == F.col("s.part")) & F.col("r.grp").eqNullSafe(F.col("s.grp")))
            .select("r.*", "s.tree", "s.count", (F.col("at") - F.col("first") + F.col("before")).alias("place"))
            .drop("at", "part"))


def runs_of(nodes: DataFrame, *extra: str) -> DataFrame:
    """Runs of ``FAN`` nodes (tree, place, digest): the run's ``kids`` in order
    and its own digest, which is the next level's node."""
    kid = F.struct("place", "digest", *extra)
    run = (nodes.groupBy("tree", (F.col("place") / FAN).cast("long").alias("up"))
           .agg(F.array_sort(F.collect_list(kid)).alias("kids"), F.first("count").alias("count")))
    return run.withColumn("up_digest", F.sha2(F.array_join("kids.digest", ""), 256))


def siblings(kids: str, at: Column) -> Column:
    """The digests left and right of the kid at position ``at`` (from 0)."""
    every = F.col(kids)["digest"]
    return F.struct(F.array_join(F.slice(every, F.lit(1), at), "").alias("left"),
                    F.array_join(F.slice(every, at + 2, F.lit(FAN)), "").alias("right"))


def _pointers(run: DataFrame, level: int, height: Column | int) -> DataFrame:
    """One row per kid of the runs of ``level``: its parent and its segment."""
    last = F.col("level") + 1 == height
    at_top = F.col("tree") == TOP
    row = run.select("tree", F.lit(level).cast("long").alias("level"), "up", "kids", "count",
                     F.posexplode("kids").alias("at", "kid"))
    up_tree = F.when(last & ~at_top, F.lit(TOP)).otherwise(F.col("tree"))
    return row.select(
        "tree", "level", F.col("kid.place").alias("place"), up_tree.cast("long").alias("to_tree"),
        F.when(last & ~at_top, F.lit(0)).otherwise(F.col("level") + 1).cast("long").alias("to_level"),
        F.when(last & ~at_top, F.col("tree")).otherwise(F.col("up")).alias("to_place"),
        F.array(siblings("kids", F.col("at"))).alias("segment"),
        F.when(at_top & (F.col("level") == 0), F.col("kid.digest")).alias("subroot"))


def height_of(count: Column) -> Column:
    """Levels above ``count`` leaves."""
    steps, width = F.lit(0), 1
    while width < 1 << 62:
        steps = steps + (count > width).cast("int")
        width *= FAN
    return steps.cast("long")


def levels(leaves: DataFrame, most: int) -> tuple[list[DataFrame], DataFrame]:
    """Pointers of the inner nodes of trees of at most ``most`` leaves, from
    level 1 on, and the last node of each tree (tree, digest)."""
    pointers, lasts, level, width = [], [], 0, 1
    nodes = leaves
    while True:
        lasts.append(nodes.where(F.col("count") <= width).select("tree", "digest"))
        if width >= most:
            break
        run = runs_of(nodes.where(F.col("count") > width))
        if level:
            pointers.append(_pointers(run, level, height_of(F.col("count"))))
        nodes = materialise(run.select("tree", F.col("up").alias("place"), F.col("up_digest").alias("digest"), "count"))
        level, width = level + 1, width * FAN
    return pointers, reduce(DataFrame.unionAll, lasts)


def jump(pointers: DataFrame, top_height: int, steps: int) -> DataFrame:
    """Doubles the distance of all pointers until they are at the root.
    ``steps`` is the longest way there."""
    to, node = ("to_tree", "to_level", "to_place"), ("tree", "level", "place")
    at_root = (F.col("to_tree") == TOP) & (F.col("to_level") == top_height)
    distance = 1
    while distance < steps:
        moving = pointers.where(~at_root)
        hot = materialise(moving.groupBy(*to).agg(F.count("*").alias("n")).where(F.col("n") > HOT).select(
            *to, F.ceil(F.col("n") / HOT).alias("copies")))
        if hot.count() <= BROADCAST_ROWS:  # then the rows that point to one node never meet in one task
            hot = F.broadcast(hot)
        dealt = moving.join(hot, list(to), "left").withColumn(
            "copy", F.coalesce(F.pmod(F.xxhash64(*node), F.col("copies")), F.lit(0)))
        targets = pointers.select(*(F.col(a).alias(b) for a, b in zip(node, to)), *(F.col(a).alias(f"{a}2") for a in to),
                                  F.col("segment").alias("segment2"), F.col("subroot").alias("subroot2"))
        targets = targets.join(hot, list(to), "left").withColumn(
            "copy", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("copies", F.lit(1)) - 1))).drop("copies")
        far = dealt.join(targets, [*to, "copy"]).select(
            *node, *(F.col(f"{a}2").alias(a) for a in to), F.concat("segment", "segment2").alias("segment"),
            F.coalesce("subroot", "subroot2").alias("subroot"))
        pointers = materialise_table(pointers.where(at_root).unionByName(far), "merkle-pointers")
        distance *= 2
    return pointers


def fold(start: Column, segment: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(segment, start, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def manifest(rows: DataFrame, key: str, group: str, values: Sequence[Column], shown: Column | None = None) -> DataFrame:
    """One row per row of ``rows``: ``key``, ``leaf`` (digest of ``values``),
    ``subroot``, ``root``, ``proof`` (the siblings' digests from the leaf up, as
    ``left`` and ``right`` strings a level), ``proof_sha256``, ``folded_root``
    and ``verified``: whether the digest ``shown`` (the leaf where null or not
    given) leads to the root with the leaf's proof."""
    none = F.lit(None).cast("string")
    digests = materialise_table(rows.select(F.col(group).alias("grp"), F.col(key).alias("key"), leaf_digest(*values).alias("leaf"),
                                            (none if shown is None else shown).alias("shown")), "merkle-digests")
    leaves = materialise_table(placed(digests).select(
        "tree", "place", "key", F.col("leaf").alias("digest"), F.coalesce("shown", "leaf").alias("shown"), "count"), "merkle-leaves")
    most, n_trees = leaves.agg(F.max("count"), F.max("tree")).first()
    n_trees, most = (n_trees + 1, most) if most else (1, 1)

    below, subroots = levels(leaves.select("tree", "place", "digest", "count"), most)
    tops = materialise(subroots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("place"), "digest",
                                       F.lit(n_trees).cast("long").alias("count")))
    above, roots = levels(tops, n_trees)
    if n_trees > 1:
        above.insert(0, _pointers(runs_of(tops), 0, height_of(F.col("count"))))
    root = next((r.digest for r in roots.collect()), None)  # one row, or none
    heights = [next(h for h in range(64) if FAN ** h >= n) for n in (most, n_trees)]

    home, inner = ("to_tree", "to_level", "to_place"), below + above
    single = F.col("count") == 1
    runs = runs_of(leaves, "key", "shown").withColumns({
        "to_tree": F.when(F.col("count") <= FAN, F.lit(TOP)).otherwise(F.col("tree")).cast("long"),
        "to_level": F.when(F.col("count") <= FAN, F.lit(0)).otherwise(F.lit(1)).cast("long"),
        "to_place": F.when(F.col("count") <= FAN, F.col("tree")).otherwise(F.col("up"))})
    if inner:
        pointers = jump(materialise_table(reduce(DataFrame.unionByName, inner), "merkle-pointers"), heights[1], max(0, heights[0] - 1) + heights[1])
        ways = pointers.select(*(F.col(a).alias(b) for a, b in zip(("tree", "level", "place"), home)), "segment", "subroot")
        runs = runs.join(ways, list(home), "left")
    else:
        runs = runs.withColumns({"segment": F.lit(None).cast(EMPTY_SEGMENT), "subroot": F.lit(None).cast("string")})
    runs = runs.withColumns({"segment": F.coalesce("segment", F.array().cast(EMPTY_SEGMENT)),
                             "subroot": F.coalesce("subroot", F.lit(root))})
    out = runs.select("kids", "segment", "subroot", "count", F.posexplode("kids").alias("at", "kid"))
    own = F.when(single, F.array().cast(EMPTY_SEGMENT)).otherwise(F.array(siblings("kids", F.col("at"))))
    out = out.select(F.col("kid.key").alias(key), F.col("kid.digest").alias("leaf"), "subroot", F.lit(root).alias("root"),
                     F.concat(own, F.col("segment")).alias("proof"), F.col("kid.shown").alias("shown"))
    listed = F.array_join(F.transform("proof", lambda s: F.concat(s["left"], s["right"])), "")
    return (out.withColumns({"proof_sha256": F.sha2(listed, 256), "folded_root": fold(F.col("shown"), F.col("proof"))})
            .withColumn("verified", F.col("folded_root") == F.col("root")).drop("shown"))
