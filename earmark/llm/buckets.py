"""Links between members of hash buckets, without all pairs of a bucket.

Members of small buckets meet at once where the caller asks for it. In the others every member first meets the hub that it
shares most buckets with; then, in ``ROUNDS`` rounds, members outside the largest component of a very large bucket meet a few
members of it. Only members that are still apart meet all others that they can be reached
from through buckets, in blocks that compare full sets and give the links alone: a pair within one component need not be
compared to find the components.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from earmark.llm.graph import connected_components
from earmark.llm.store import forget, settle

BLOCK = 1024          # members that meet in one block
BLOCK_SET = 1 << 20   # elements of all their sets
COLUMNS = 2048        # shared elements that are compared at a time
MANY = 16 * BLOCK     # members of a bucket from which on rounds come before blocks
ROUNDS = 2
HUBS = 2              # members of the largest component that each member outside meets in a round
#: The order of ids under an exclusive or differs by salt, so that one group has several hubs.
SALTS = [0x2545F4914F6C, 0x1B873593CC9E, 0x385495AB38B3, 0x5BD1E9955BD1]


def linked_sets(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` whose ``set`` arrays (by ``id``) overlap in ``percent`` of their union."""
    # the set of b travels with its pair to the set of a, which is sent once
    both = pairs.join(sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b")
    both = both.join(sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a")
    common = F.size(F.array_intersect("set_a", "set_b"))
    union = F.size("set_a") + F.size("set_b") - common
    return both.where(common * 100 >= union * percent).select("a", "b").distinct()


def link_classes(classes: DataFrame, sets_of, percent: int, may_link=None, known: DataFrame | None = None,
                 bands: list[str] | None = None, spare: bool = False, few: int = 1) -> DataFrame:
    """``(node, component)`` of all classes with a link.

    ``classes``: ``rep`` (long), ``bands`` (array of bucket keys) and what ``may_link`` looks at. ``sets_of(ids)`` gives
    ``id, set`` for a table of ``id``; sets link when they overlap in ``percent`` of their union. ``may_link(p, q)`` gives a
    condition that all links fulfil, from two functions that name columns of either side. ``known``: links that hold in any
    case. ``bands``: columns with one bucket key each, in place of the array; they are handled one at a time, which needs less
    disk. ``spare``: ``classes`` is a table of ``settle`` that nobody needs once its buckets are found, and goes then.
    ``few``: in buckets of up to so many members all pairs meet, and the rest of the work sees larger buckets only.
    """
    looked_at = [c for c in classes.columns if c not in ("rep", "bands", *(bands or []))] if may_link is not None else []
    carried = looked_at if few > 1 else []
    shared = _shared(classes, bands)
    # what may_link looks at follows once for each member that is left, not with every bucket key
    seen = settle(classes.select("rep", *carried).join(shared.select("rep").distinct(), "rep", "left_semi")) if carried else classes
    if spare:
        forget(classes)

    def confirmed(pairs, checked=None):
        """Links among ``pairs``, and among the ``checked`` ones, which pass ``may_link``."""
        pairs = pairs.where("a < b").distinct()
        if may_link is not None:
            for end in ("a", "b"):
                pairs = pairs.join(seen.select(F.col("rep").alias(end),
                                               *[F.col(c).alias(f"{end}_{c}") for c in looked_at]), end)
            pairs = pairs.where(may_link(lambda c: F.col(f"a_{c}"), lambda c: F.col(f"b_{c}"))).select("a", "b").distinct()
        if checked is not None:
            pairs = pairs.unionByName(checked).distinct()
        pairs = settle(pairs)
        if pairs.isEmpty():
            forget(pairs)
            return None
        ends = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
        ends = settle(ends)
        sets = settle(sets_of(ends))
        out = settle(linked_sets(pairs, sets, percent))
        for table in (ends, sets, pairs):
            forget(table)
        return out

    large = shared.where(F.col("members") > few)
    small = shared.where(F.col("members") <= few).select("key", "rep")
    small = _small_pairs(small.join(seen, "rep") if carried else small, carried, may_link) if few > 1 else None
    links = [x for x in (confirmed(_chosen(large.where("rep != hub"), 1), small), known) if x is not None]
    found = _components(links, shared)
    if links and links[0] is not known:
        forget(links[0])
    for r in range(ROUNDS + 1):
        apart = _apart(large, found)
        largest = apart.agg(F.max("members")).first()[0]
        if largest is None:
            break
        # small buckets need no rounds: their members can meet at once
        last = r == ROUNDS or largest <= MANY
        more = _all_members(apart, sets_of, percent) if last else confirmed(_other_hubs(apart, r))
        if more is not None and not more.isEmpty():
            # components so far are stars already, and stand for all links before
            before, found = found, _components([found.toDF("a", "b"), more], shared)
            forget(before)
        if more is not None:
            forget(more)
        forget(apart)
        if last:
            break
    for table in (shared, *([seen] if carried else [])):
        forget(table)
    return found


def _chosen(pairs: DataFrame, n: int) -> DataFrame:
    """For each ``rep`` the ``n`` hubs that it shares most buckets with; a member has no more hubs than bands."""
    counted = pairs.groupBy("rep", "hub").agg(F.count(F.lit(1)).alias("buckets"))
    best = counted.groupBy("rep").agg(F.slice(F.sort_array(F.collect_list(F.struct("buckets", "hub")), False), 1, n).alias("best"))
    best = best.select("rep", F.explode("best.hub").alias("hub"))
    return best.select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b"))


def _small_pairs(small: DataFrame, carried: list[str], may_link) -> DataFrame:
    """All pairs ``a < b`` of buckets of bounded size that may link; a pair may come from several buckets."""
    rows = small.groupBy("key").agg(F.collect_list(F.struct("rep", *carried)).alias("all"))
    pairs = rows.select(F.explode("all").alias("p"), "all").select("p", F.explode("all").alias("q")).where("p.rep < q.rep")
    if may_link is not None:
        pairs = pairs.where(may_link(lambda c: F.col(f"p.{c}"), lambda c: F.col(f"q.{c}")))
    return pairs.select(F.col("p.rep").alias("a"), F.col("q.rep").alias("b"))


def _shared(classes: DataFrame, bands: list[str] | None) -> DataFrame:
    """``key, rep, hub, members`` of all buckets with two members or more.

    Most buckets have one member, so the entries are by far the largest table. They are dealt by key once, as two longs each, and
    buckets are counted and given to their members where they lie. A large bucket passes through one task as a stream.
    """
    out = None
    for band in bands or [None]:
        entries = classes.select("rep", F.explode("bands").alias("key") if band is None else F.col(band).alias("key"))
        entries = entries.repartition("key")
        # the salt follows from the key, so that all members of a bucket have the same
        salt = F.get(F.array(*[F.lit(s) for s in SALTS]), F.pmod("key", F.lit(len(SALTS))).cast("int"))
        hubs = entries.groupBy("key").agg(F.min(F.col("rep").bitwiseXOR(salt)).alias("hub"), F.count(F.lit(1)).alias("members"))
        hubs = hubs.where("members > 1").select("key", F.col("hub").bitwiseXOR(salt).alias("hub"), "members")
        part = settle(entries.join(hubs.hint("shuffle_hash"), "key").select("key", "rep", "hub", "members"))
        out = part if out is None else out.unionByName(part)
    return out


def _components(links: list[DataFrame], shared: DataFrame) -> DataFrame:
    if not links:
        return shared.select(F.col("rep").alias("node"), F.col("rep").alias("component")).where("false")
    total = links[0]
    for more in links[1:]:
        total = total.unionByName(more)
    return _named(total)


def _named(links: DataFrame) -> DataFrame:
    stars = connected_components(links)
    out = settle(stars)
    forget(stars)
    return out


def _apart(shared: DataFrame, found: DataFrame) -> DataFrame:
    """Members of buckets that hold several components, with the largest component of their bucket as ``main``."""
    named = settle(shared.select("key", "rep", "members").join(found, shared.rep == found.node, "left").select(
        "key", "rep", "members", F.coalesce("component", "rep").alias("component")))
    parts = named.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    parts = parts.groupBy("key").agg(F.count(F.lit(1)).alias("parts"), F.max(F.struct("n", "component")).alias("top"))
    mixed = settle(parts.where("parts > 1").select("key", F.col("top.component").alias("main")))
    out = settle(named.join(mixed, "key"))
    forget(named)
    forget(mixed)
    return out


def _other_hubs(apart: DataFrame, r: int) -> DataFrame:
    """Each member outside the main component with HUBS members of it, others in every bucket and round."""
    salt = F.shiftrightunsigned(F.xxhash64("key", F.lit(r)), 8)
    hubs = apart.where("component = main").groupBy("key").agg(F.min(F.col("rep").bitwiseXOR(salt)).alias("hub"))
    hubs = settle(hubs.select("key", F.col("hub").bitwiseXOR(salt).alias("hub")))
    return _chosen(apart.where("component != main").select("key", "rep").join(hubs, "key"), HUBS)


def _all_members(apart: DataFrame, sets_of, percent: int) -> DataFrame:
    """Links between different components among all members that buckets connect, enough to join the components."""
    first = apart.groupBy("key").agg(F.min("rep").alias("first"))
    ties = apart.join(first, "key").select(F.col("rep").alias("a"), F.col("first").alias("b"))
    clusters = _named(ties)
    named = clusters.select(F.col("node").alias("rep"), F.col("component").alias("cluster"))
    members = settle(apart.select("rep", "component").distinct().join(named, "rep"))
    sets = sets_of(members.select(F.col("rep").alias("id")).distinct())
    held = settle(members.join(sets, members.rep == sets.id).select("cluster", "rep", "component", "set"))
    rows = held
    sizes = rows.groupBy("cluster").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum(F.size("set")) / BLOCK_SET))
                                        .cast("int").alias("blocks"))
    sizes = settle(sizes)
    rows = rows.join(sizes, "cluster").withColumn("block", F.pmod(F.xxhash64("rep", F.lit(11)), "blocks").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("cluster", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block",
                       "rep", "component", "set")

    def meet(table: pa.Table) -> pa.Table:
        low, high = (table.column(c)[0].as_py() for c in ("low", "high"))
        a, b = block_links(table.sort_by("rep"), low, high, percent)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    out = settle(rows.groupBy("cluster", "low", "high").applyInArrow(meet, "a long, b long"))
    for table in (clusters, members, held, sizes):
        forget(table)
    return out


def block_links(table: pa.Table, low: int, high: int, percent: int) -> tuple[list, list]:
    """Links that join different components, among the members of one block or between those of two."""
    block = table.column("block").to_numpy()
    rep, component = table.column("rep").to_numpy(), table.column("component").to_numpy()
    sets = table.column("set").combine_chunks()
    offsets, values = sets.offsets.to_numpy(), sets.flatten().to_numpy()
    size = np.diff(offsets)
    row = np.repeat(np.arange(len(rep)), size)
    _, column, times = np.unique(values, return_inverse=True, return_counts=True)
    # elements of one set only add nothing to an intersection
    several = times[column] > 1
    row, column = row[several], np.unique(column[several], return_inverse=True)[1]
    left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
    place = np.full(len(rep), -1)
    common = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        x, y = np.searchsorted(column, [start, start + COLUMNS])
        sides = []
        for side in (left, right):
            place[:] = -1
            place[side] = np.arange(len(side))
            own = place[row[x:y]]
            has = own >= 0
            flags = np.zeros((len(side), COLUMNS), np.float32)
            flags[own[has], column[x:y][has] - start] = 1
            sides.append(flags)
        common += sides[0] @ sides[1].T
    union = size[left][:, None] + size[right][None, :] - common
    linked = (common * 100 >= union * percent) & (component[left][:, None] != component[right][None, :])
    if low == high:
        linked &= np.arange(len(left))[:, None] < np.arange(len(right))[None, :]
    names = {}

    def find(c):
        while names.setdefault(c, c) != c:
            names[c] = names[names[c]]
            c = names[c]
        return c

    a, b = [], []
    for i, j in zip(*(x.tolist() for x in np.nonzero(linked))):
        p, q = find(component[left[i]].item()), find(component[right[j]].item())
        if p != q:
            names[max(p, q)] = min(p, q)
            x, y = rep[left[i]].item(), rep[right[j]].item()
            a.append(min(x, y))
            b.append(max(x, y))
    return a, b
