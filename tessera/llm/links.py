"""From candidate keys to connected components of similar sets, with DataFrame operations only.

Nodes carry a signature of K four-bit symbols, packed sixteen to a long.  Two nodes that share a key are
candidates; a candidate pair counts as a link once its full sets confirm the similarity.  A group is compared with
its smallest member, what is far from that with some more members.  Nodes that this leaves outside their family's
main component are compared with it until a link is found, then with one another, in slices of bounded size on either
side, so that no task gets a whole family, and inside joins that return confirmed links alone.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, release

#: Members of a group or family that a task holds, and outsiders that come by them.
SLICE, OUTSIDERS = 1000, 10_000
#: Nodes of a family that all nodes without a link to its main component are compared with, before these are in pairs.
LEADERS = 16
#: Bits of the filter that goes before a join: 16 MB at most, whatever the tables hold.
BITS = 1 << 27


def among(df: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """Rows of df that may have one of the longs `wanted` (its first column), before a shuffle brings them together.

    A bitmap of hashes, of at most BITS bits, goes to all tasks.  It lets rows through that the join then drops, but holds
    back none that it keeps; with very many longs it holds back few.  The join that follows has to be an inner one, as
    Spark would push a semi-join below the filter.
    """
    place = lambda c: F.pmod(F.xxhash64(F.lit("bit"), c), F.lit(BITS))
    bits = wanted.select(place(F.col(wanted.columns[0])).alias("p")).select(F.expr("p div 32768").alias("bucket"), (F.col("p") % 32768).alias("bit"))
    # Longs are read where they lie; a binary would be copied for every row.  A long's first byte is its highest.
    longs = F.transform(F.array("map"), lambda m: F.transform(F.sequence(F.lit(1), F.lit(4089), F.lit(8)), lambda i: F.conv(F.hex(F.substring(m, i, F.lit(8))), 16, -10).cast("long")))[0]
    maps = F.broadcast(bits.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("map")).select("bucket", longs.alias("map")))
    held = df.withColumn("p", place(F.col(column))).withColumns({"bucket": F.expr("p div 32768"), "bit": (F.col("p") % 32768).cast("int")}).join(maps, "bucket")
    inside = F.expr("shiftrightunsigned(get(map, bit div 64), 56 - (bit div 8) % 8 * 8 + bit % 8)")
    return held.filter(inside.bitwiseAND(F.lit(1)) != 0).select(*df.columns)


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Connected components of edges (a, b) of longs: each node with the smallest node it reaches, (node, comp).

    Alternates large-star and small-star contractions; each needs one shuffle by node and pre-aggregates, and
    hubs are left to the skew handling of joins.  Self-loops and repeated edges are harmless; no edges, no rows.
    """
    edges = scratch.table(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a > b").distinct()
        large = scratch.table(large, done=(edges,))
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("low").alias("b")), F.struct("a", F.col("low").alias("b")))).alias("e"))
        edges = scratch.table(small.select("e.*").filter("a > b").distinct(), done=(large,))
        # Done once every node above has one below, which has none: another round would change nothing.
        ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up")))
        ends = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("low"))
        if ends.filter("ups > 1 or (ups = 1 and low = 0)").isEmpty():
            found = edges.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())
            return scratch.table(found, done=(edges,))


def distance(left: Column, right: Column, longs: int) -> Column:
    """Number of four-bit symbols in which two packed signatures differ."""

    def differing(i: int) -> Column:
        x = left[i].bitwiseXOR(right[i])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        return F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))

    return reduce(lambda x, y: x + y, [differing(i) for i in range(longs)])


def similar(left: Column, right: Column, percent: int) -> Column:
    """True if 100 * |intersection| >= percent * |union| for two arrays of distinct items."""
    # The intersection is named once, as a join's condition would make it anew wherever it is named.
    shared = F.size(F.array_intersect(left, right))
    return comparable(F.size(left), F.size(right), percent) & ((100 + percent) * shared >= percent * (F.size(left) + F.size(right)))


def comparable(left: Column, right: Column, percent: int) -> Column:
    """False if the sizes alone rule out the similarity."""
    return 100 * F.least(left, right) >= percent * F.greatest(left, right)


def _slices(count: Column, size: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(count / size))


def _each(slices: str) -> Column:
    """A row for each number of a slice."""
    return F.explode(F.sequence(F.lit(0).cast("long"), F.col(slices) - 1))


def near_components(
    nodes: DataFrame,
    keys: DataFrame,
    sets_of: Callable[[DataFrame], DataFrame],
    *,
    percent: int,
    apart_by: Callable[[Column, Column], Column],
    most: int,
    scratch: Scratch,
    expand: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Components (node, comp) of the nodes that have a link.

    nodes: (node, q); keys: (key, node), both with or without repeats; sets_of(df of node) gives (node, items), of which
    expand, if given, makes the set where it is compared: sets that are larger than what they are made of are neither
    stored nor shuffled.  A link is a pair that shares a key, whose q are at most `most` apart by apart_by (a metric, or 0 just for
    pairs that share a key), and whose full sets are `percent` similar.
    """
    def described(df: DataFrame, side: str) -> DataFrame:
        return df.join(nodes.select(F.col("node").alias(side), F.col("q").alias(f"q{side}")), side)

    made = expand or (lambda c: c)
    apart = apart_by(F.col("qa"), F.col("qb"))
    # First, every group's nodes against its smallest.
    low = keys.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("high")).filter("a < high").select("key", "a")
    low = scratch.table(low)
    pairs = scratch.table(among(keys.withColumnRenamed("node", "b"), "key", low).join(low, "key").filter("a < b").distinct(), done=(low,))
    met = scratch.table(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct())
    nodes = scratch.table(among(nodes, "node", met).join(met, "node").dropDuplicates(["node"]), done=(met,))
    first = pairs.select("a", "b").distinct()
    # Where sharing a key is all that q tells, these pairs are near and none of them is left over.
    first = described(described(first, "a"), "b").select("a", "b", apart.alias("d")).filter(F.col("d") <= 2 * most) if most else first.withColumn("d", F.lit(0))
    first = scratch.table(first)
    parts, rest = [first], None
    if not most:
        # Of two that share a key one is its group's smallest, and they are compared as such, or both are among several others.
        several = pairs.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1").select("key")
        several = scratch.table(pairs.join(several, "key").select(F.col("b").alias("node")).distinct(), done=(pairs,))
    if most:
        # Then what is far from it against about the square root of its number.  A pair (a, b) with at most `most`
        # differences of which a has left, being near a leader, is still related through that leader: b is within 2 * most.
        rest = pairs.join(first.filter(F.col("d") <= most), ["a", "b"], "left_anti").select("key", F.col("b").alias("node"))
        rest = scratch.table(rest, done=(pairs,))
        many = rest.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1").select("key", "size", _slices(F.col("size"), SLICE).alias("slices"))
    if most and not many.isEmpty():
        leads = F.pmod(F.xxhash64("node", F.lit(1)), F.ceil(F.sqrt("size"))) == 0
        known = rest.join(many, "key").select("key", F.col("node").alias("b"), leads.alias("leads"), "slices", F.pmod(F.xxhash64("node", F.lit(2)), "slices").alias("slice"))
        known = scratch.table(described(known, "b"), done=(rest,))
        other = [F.col("key").alias("k"), _each("slices").alias("s"), *(F.col(f"{c}b").alias(f"{c}a") for c in ("", "q"))]
        here = (F.col("key") == F.col("k")) & (F.col("slice") == F.col("s"))
        second = known.join(known.filter("leads").select(*other), here & (F.col("a") != F.col("b")) & (apart <= 2 * most)).select("key", "a", "b", apart.alias("d"))
        second = scratch.table(second)
        # At last the pairs of what no leader is near to.
        left = known.filter("not leads").join(second.filter(F.col("d") <= most).select("key", "b").distinct(), ["key", "b"], "left_anti").drop("leads")
        left = scratch.table(left, done=(known,))
        third = left.join(left.select(*other), here & (F.col("a") < F.col("b")) & (apart <= most)).select("a", "b", apart.alias("d"))
        third = scratch.table(third, done=(left,))
        parts += [second.select("a", "b", "d"), third]
    stars = reduce(DataFrame.unionByName, parts).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "d")
    stars = scratch.table(stars.dropDuplicates(["a", "b"]), done=(first, *([second, third] if len(parts) > 1 else [rest] if most else [])))
    wanted = scratch.table(stars.select(F.col("a").alias("node")).unionByName(stars.select(F.col("b").alias("node"))).distinct())
    sets = scratch.table(sets_of(wanted), done=(wanted,))

    near = stars.filter(F.col("d") <= most).select("a", "b")
    near = near.join(sets.select(F.col("node").alias("a"), F.col("items").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("items").alias("y")), "b")
    # A number that Spark can't move keeps the sets from being made anew wherever the condition names them.
    near = near.select("a", "b", made(F.col("x")).alias("x"), made(F.col("y")).alias("y"), F.monotonically_increasing_id().alias("at"))
    links = scratch.table(near.filter((F.col("at") >= 0) & similar(F.col("x"), F.col("y"), percent)).select("a", "b"))
    release(scratch.spark)
    comps = components(links, scratch)
    families = components(stars.select("a", "b"), scratch)
    scratch.drop(stars)
    placed = families.withColumnRenamed("comp", "family").join(comps, "node", "left").select("node", "family", F.coalesce("comp", "node").alias("comp"))
    if not most:
        placed = placed.join(several, "node")
    placed = scratch.table(placed, done=(families, *(() if most else (several,))))
    sizes = placed.groupBy("family", "comp").count()
    split = sizes.groupBy("family").agg(F.max(F.struct("count", "comp")).alias("main"), F.sum("count").alias("size"), F.count("*").alias("comps")).filter("comps > 1")
    split = split.select("family", F.col("main.comp").alias("main"), _slices(F.col("size"), SLICE).alias("inners"), _slices(F.col("size") - F.col("main.count"), OUTSIDERS).alias("outers"))
    split = scratch.table(split)
    release(scratch.spark)
    members = placed.join(split, "family").join(nodes, "node").join(sets, "node")
    members = scratch.table(members.select("family", "node", "comp", "main", "q", "items", "inners", "outers"), done=(placed, split, sets, nodes))

    def met(outer: DataFrame, inner: DataFrame, how: str, further: list[Column]) -> DataFrame:
        """Rows of outer that have a link in inner (how: semi), or all their links (inner), slice by slice."""
        slices = ["family", "inner_slice", "outer_slice"]
        inner = inner.withColumn("outer_slice", _each("outers")).withColumn("inner_slice", F.pmod("node", "inners")).select(*slices, "node", "comp", "q", "items")
        outer = outer.withColumn("inner_slice", _each("inners")).withColumn("outer_slice", F.pmod(F.xxhash64("node"), "outers")).select(*slices, "node", "comp", "main", "q", "items")
        if expand:
            # Dealt out as the join needs them, then made into sets: once for each row, and not for each pair.
            inner, outer = (df.repartition(*slices).withColumn("items", expand(F.col("items"))) for df in (inner, outer))
        inner = inner.select(*slices, *(F.col(c).alias(f"m_{c}") for c in ("node", "comp", "q", "items")))
        on = [*(outer[c] == inner[c] for c in slices), *further, apart_by(F.col("q"), F.col("m_q")) <= most, similar(F.col("items"), F.col("m_items"), percent)]
        return outer.hint("merge").join(inner, reduce(lambda x, y: x & y, on), how)

    # A link to any of the main component is enough, and to any node that has come to it; only what is left is compared in pairs.
    outside = members.filter("comp <> main")
    taken = met(outside, members.filter("comp = main"), "left_semi", []).select("node", "main").distinct()
    taken = scratch.table(taken)
    outside = outside.join(taken.select("node", F.lit(True).alias("taken")), "node", "left").withColumn("taken", F.col("taken").isNotNull())
    outside = scratch.table(outside, done=(members,))
    apart_yet = outside.filter("not taken")
    later = met(apart_yet, outside.filter("taken"), "left_semi", [F.col("comp") != F.col("m_comp")]).select("node", "main").distinct()
    later = scratch.table(later)
    # Of the rest, LEADERS of each family at first: what they bring together is not compared in pairs.
    rank = F.struct(F.xxhash64("node", F.lit(3)), "node")
    least = apart_yet.groupBy("family", F.pmod(F.xxhash64("node", F.lit(4)), F.lit(LEADERS)).alias("part")).agg(F.min(rank).alias("lead")).select(F.col("lead.node").alias("node"))
    leaders = apart_yet.join(least, "node", "left_semi")
    led = met(apart_yet, leaders, "inner", [F.col("comp") != F.col("m_comp")]).select(F.col("comp").alias("a"), F.col("m_comp").alias("b"))
    led = scratch.table(led.distinct())
    groups = components(led, scratch)
    grouped = apart_yet.join(groups.select(F.col("node").alias("comp"), F.col("comp").alias("group")), "comp", "left")
    grouped = scratch.table(grouped.withColumn("comp", F.coalesce("group", "comp")).drop("group"), done=(outside, groups))
    among_them = met(grouped, grouped, "inner", [F.col("comp") != F.col("m_comp"), F.col("node") < F.col("m_node")]).select(F.col("node").alias("a"), F.col("m_node").alias("b"))
    among_them = scratch.table(among_them.unionByName(led), done=(grouped, led))
    to_main = taken.unionByName(later).select(F.col("main").alias("a"), F.col("node").alias("b"))
    late = scratch.table(to_main.unionByName(among_them).distinct(), done=(taken, later, among_them))
    if late.isEmpty():
        scratch.drop(links, late)
        return comps
    found = components(links.unionByName(late), scratch)
    scratch.drop(links, late, comps)
    return found
