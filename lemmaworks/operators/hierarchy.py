"""Parent-child rows to full hierarchies, by leaf peeling.

Leaves send what they gathered (descendants, subtree sizes) to their parents and are taken off, round by
round; in the reverse order each node takes its parent's path and adds itself.  Nodes that are never
peeled lie on cycles.  Nodes whose edges stay inside one group (the part of an id before ``::``) of bounded
size are peeled inside one task, many groups at a time; all others are peeled by rounds of joins over the
whole cluster, so neither a huge tree nor edges between groups need one task's memory.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lemmaworks.session import ship_code, stage, unstage

#: A group of more nodes than this is peeled by joins; tasks hold about this many nodes at a time.
GROUP_LIMIT = 50_000
MAX_ROUNDS = 100_000
#: Entries of paths that a task holds at a time.
PATH_ENTRIES = 500_000


def group_of(c: Column) -> Column:
    """The part of an id before ``::``; the whole id if there is none."""
    return F.when(F.instr(c, "::") > 0, F.substring_index(c, "::", 1)).otherwise(c)


def resolve_entries(trees: DataFrame, id_col: str = "stmt_id", deps_col: str = "depends_on") -> tuple[DataFrame, DataFrame]:
    """``(nodes, edges)``: nodes (id); edges (src, dst, pos), each pair once at its first position.

    Null and blank entries, and entries that name no row, are left out.  An entry is the id of a row, or its
    part after ``::`` within the group of the row's own id; blanks around it do not count.  Rows of one id
    are merged; rows without id are left out.
    """
    rows = trees.select(F.col(id_col).alias("src"), F.col(deps_col).alias("deps")).where("src is not null")
    nodes = stage(rows.select(F.col("src").alias("id")).distinct(), "nodes")
    strip = lambda c: F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    raw = rows.select("src", F.posexplode("deps").alias("pos", "e")).select("src", "pos", strip(F.col("e")).alias("e")).where("e <> ''")
    raw = raw.groupBy("src", "e").agg(F.min("pos").alias("pos")).withColumn("within", F.concat(group_of(F.col("src")), F.lit("::"), F.col("e")))
    full = raw.join(nodes.select(F.col("id").alias("e"), F.lit(True).alias("is_full")), "e", "left")
    part = full.join(nodes.select(F.col("id").alias("within"), F.lit(True).alias("is_part")), "within", "left")
    dst = F.when(F.col("is_full"), F.col("e")).when(F.col("is_part"), F.col("within"))
    edges = part.select("src", dst.alias("dst"), "pos").where("dst is not null").groupBy("src", "dst").agg(F.min("pos").alias("pos"))
    return nodes, stage(edges, "edges")


def _places(nodes: DataFrame, edges: DataFrame, limit: int) -> DataFrame:
    """(id, bucket) of every node: the bucket of its group, or null if it needs the joins."""
    g = nodes.select("id", group_of(F.col("id")).alias("g"))
    size = g.groupBy("g").agg(F.count("*").alias("n"))
    # groups tied by an edge between groups
    ends = edges.select(group_of(F.col("src")).alias("a"), group_of(F.col("dst")).alias("b")).where("a <> b")
    crossed = ends.select(F.col("a").alias("g")).union(ends.select("b")).distinct()
    wide = size.where(F.col("n") > limit).select("g").union(crossed).distinct().withColumn("wide", F.lit(True))
    total = nodes.count()
    buckets = max(1, -(-total // max(1, min(limit, 5_000))))
    return stage(
        g.join(wide, "g", "left").select("id", F.when(F.col("wide").isNull(), F.pmod(F.xxhash64("g"), F.lit(buckets)).cast("int")).alias("bucket")), "places"
    )


def hierarchy(trees: DataFrame, id_col: str = "stmt_id", deps_col: str = "depends_on", limit: int = GROUP_LIMIT) -> DataFrame:
    """(id, parent, root, depth, path, subtree_size, status) of every distinct id.

    The parent is the first entry that names a row; a row naming itself is a cycle of one.  ``status`` is
    'tree'; 'cycle' for nodes on a cycle of parents; 'below_cycle' for nodes whose chain of parents runs into
    one.  Root, depth and path are null for the latter two, and the subtree size is null on a cycle.  A root
    has depth 0 and a path of itself.
    """
    ship_code(trees.sparkSession)
    nodes, edges = resolve_entries(trees, id_col, deps_col)
    first = edges.groupBy("src").agg(F.min_by("dst", F.struct("pos", "dst")).alias("parent"))
    place = _places(nodes, first.select("src", F.col("parent").alias("dst")), limit)
    tree = stage(place.join(first, place["id"] == first["src"], "left").select("id", "parent", "bucket"), "parents")
    schema = "id string, parent string, root string, depth int, path array<string>, subtree_size bigint, status string"
    near = tree.where("bucket is not null").select("bucket", "id", "parent").groupBy("bucket").applyInPandas(_peel_local, schema)
    far = tree.where("bucket is null").select("id", "parent")
    if not far.limit(1).count():
        return near
    return near.unionByName(_peel_by_joins(far))


def _peel_local(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole groups; rows leave in batches of bounded paths, and a path is made when its row leaves, so that a chain needs no
    more memory than a star."""
    got = pd.concat(list(frames))
    ids, parent = got["id"].tolist(), {k: (v if isinstance(v, str) else None) for k, v in zip(got["id"], got["parent"])}
    waiting, size = defaultdict(int), dict.fromkeys(ids, 1)
    for v in parent.values():
        if v is not None:
            waiting[v] += 1
    order = [i for i in ids if not waiting[i]]
    for i in order:
        p = parent[i]
        if p is not None:
            size[p] += size[i]
            waiting[p] -= 1
            if not waiting[p]:
                order.append(p)
    peeled, root = set(order), {}
    for i in reversed(order):
        p = parent[i]
        root[i] = i if p is None else root.get(p)
    rows, held = [], 0

    def batch():
        out = pd.DataFrame(rows, columns=["id", "parent", "root", "depth", "path", "subtree_size", "status"])
        return out.astype({"depth": "Int32", "subtree_size": "Int64"})

    for i in reversed(order):
        path = None
        if root[i] is not None:
            path, at = [], i
            while at is not None:
                path.append(at)
                at = parent[at]
            path.reverse()
        rows.append((i, parent[i], root[i], len(path) - 1 if path else None, path, size[i], "tree" if path else "below_cycle"))
        held += len(path or ())
        if held > PATH_ENTRIES:
            yield batch()
            rows, held = [], 0
    rows += [(i, parent[i], None, None, None, None, "cycle") for i in ids if i not in peeled]
    yield batch()


def _peel_by_joins(tree: DataFrame) -> DataFrame:
    """The same by rounds of joins; every round is written out."""
    live = stage(tree.select("id", "parent", F.lit(1).cast("long").alias("size")), "live")
    rounds: list[DataFrame] = []
    for _ in range(MAX_ROUNDS):
        busy = live.where("parent is not null").select(F.col("parent").alias("id")).distinct()
        leaves = stage(live.join(busy, "id", "left_anti"), "leaves")
        if not leaves.limit(1).count():
            unstage(leaves)
            break
        rounds.append(leaves)
        sent = leaves.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.sum("size").alias("got"))
        rest = live.join(leaves.select("id"), "id", "left_anti").join(sent, "id", "left").select("id", "parent", (F.col("size") + F.coalesce("got", F.lit(0))).alias("size"))
        nxt = stage(rest, "live")
        unstage(live)
        live = nxt
    else:
        raise RuntimeError(f"a hierarchy is deeper than {MAX_ROUNDS}")
    none = lambda t: F.lit(None).cast(t)
    done = stage(live.select("id", "parent", none("array<string>").alias("path"), none("long").alias("size"), F.lit("cycle").alias("status")), "cycles")
    parts = [done]
    paths = done.select("id", "path")
    for leaves in reversed(rounds):
        up = paths.select(F.col("id").alias("parent"), F.col("path").alias("up"), F.lit(True).alias("found"))
        here = leaves.join(up, "parent", "left").select(
            "id", "parent", F.when(F.col("parent").isNull(), F.array("id")).when(F.col("up").isNotNull(), F.concat("up", F.array("id"))).alias("path"), "size"
        )
        here = stage(here.withColumn("status", F.when(F.col("path").isNotNull(), "tree").otherwise("below_cycle")), "paths")
        parts.append(here)
        paths = paths.unionByName(here.select("id", "path"))
        if len(parts) % 16 == 0:
            paths = stage(paths, "all_paths")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("id", "parent", F.get("path", F.lit(0)).alias("root"), (F.size("path") - 1).alias("depth_"), "path", F.col("size").alias("subtree_size"), "status").select(
        "id", "parent", "root", F.when(F.col("path").isNotNull(), F.col("depth_")).cast("int").alias("depth"), "path", "subtree_size", "status"
    )


def descendants(h: DataFrame) -> DataFrame:
    """(ancestor, descendant, distance) of every node and all nodes below it, from the paths, as rows:
    a root with a third of all rows below it makes no giant list."""
    p = h.where("path is not null").select("id", "depth", F.posexplode("path").alias("at", "ancestor"))
    return p.where("ancestor <> id").select("ancestor", F.col("id").alias("descendant"), (F.col("depth") - F.col("at")).alias("distance"))


def cycle_members(trees: DataFrame, id_col: str = "stmt_id", deps_col: str = "depends_on", limit: int = GROUP_LIMIT) -> DataFrame:
    """(id) of nodes that can be reached from themselves by any entries.

    Nodes without a way in or without a way out are peeled off from both ends; what remains are cycles and
    ways between cycles, of which the strongly connected parts are kept.
    """
    ship_code(trees.sparkSession)
    nodes, edges = resolve_entries(trees, id_col, deps_col)
    place = _places(nodes, edges, limit)
    tied = stage(edges.select("src", "dst").join(place.withColumnRenamed("id", "src"), "src").select("bucket", "src", "dst"), "tied")
    near = tied.where("bucket is not null").groupBy("bucket").applyInPandas(_cycles_local, "id string")
    far = tied.where("bucket is null").select("src", "dst")
    if not far.limit(1).count():
        return near
    return near.unionByName(_cycles_by_joins(far))


def _cycles_local(pdf: pd.DataFrame) -> pd.DataFrame:
    out, into = defaultdict(list), defaultdict(list)
    loops = set()
    for s, d in zip(pdf["src"], pdf["dst"]):
        if s == d:
            loops.add(s)
        else:
            out[s].append(d)
            into[d].append(s)
    live = set(out) | set(into)
    n_out, n_in = {v: len(out[v]) for v in live}, {v: len(into[v]) for v in live}
    queue = [v for v in live if not n_out[v] or not n_in[v]]
    gone = set(queue)
    for v in queue:
        for w in into[v]:
            n_out[w] -= 1
            if not n_out[w] and w not in gone:
                gone.add(w)
                queue.append(w)
        for w in out[v]:
            n_in[w] -= 1
            if not n_in[w] and w not in gone:
                gone.add(w)
                queue.append(w)
    live -= gone
    return pd.DataFrame({"id": sorted(loops | _on_cycles(live, out))}, dtype=object)


def _on_cycles(live: set, out: dict) -> set:
    """Nodes of strongly connected parts of two nodes or more: one walk in depth over all nodes, without recursion."""
    number, low, stack, held, found = {}, {}, [], set(), set()
    for first in live:
        if first in number:
            continue
        todo = [(first, iter(out[first]))]
        number[first] = low[first] = len(number)
        stack.append(first)
        held.add(first)
        while todo:
            v, ways = todo[-1]
            for w in ways:
                if w not in live:
                    continue
                if w not in number:
                    number[w] = low[w] = len(number)
                    stack.append(w)
                    held.add(w)
                    todo.append((w, iter(out[w])))
                    break
                if w in held:
                    low[v] = min(low[v], number[w])
            else:
                todo.pop()
                if todo:
                    low[todo[-1][0]] = min(low[todo[-1][0]], low[v])
                if low[v] == number[v]:
                    part = []
                    while not part or part[-1] != v:
                        part.append(stack.pop())
                    held.difference_update(part)
                    found.update(part if len(part) > 1 else ())
    return found


def _cycles_by_joins(edges: DataFrame) -> DataFrame:
    loops = edges.where("src = dst").select(F.col("src").alias("id")).distinct()
    live = _trim(stage(edges.where("src <> dst").distinct(), "live"))
    found = stage(loops, "loops")
    while live.limit(1).count():
        color = stage(live.select(F.col("src").alias("id")).union(live.select("dst")).distinct().withColumn("color", F.col("id")), "color")
        while True:  # the greatest node that reaches each node
            sent = live.join(color.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.max("color").alias("got"))
            nxt = stage(color.join(sent, "id", "left").select("id", F.greatest("color", F.coalesce("got", "color")).alias("color"), (F.col("got") > F.col("color")).alias("moved")), "color")
            moved = nxt.where("moved").limit(1).count()
            unstage(color)
            color = nxt.select("id", "color")
            if not moved:
                break
        color = stage(color, "color")
        back = stage(color.where("id = color"), "back")
        inner = stage(
            live.join(color.select(F.col("id").alias("src"), F.col("color").alias("a")), "src").join(color.select(F.col("id").alias("dst"), F.col("color").alias("b")), "dst").where("a = b").select("src", "dst", "a"), "inner"
        )
        while True:  # what reaches the root of its color
            more = inner.join(back.select(F.col("id").alias("dst")), "dst").select(F.col("src").alias("id"), F.col("a").alias("color")).distinct().join(back, ["id", "color"], "left_anti")
            more = stage(more, "more")
            if not more.limit(1).count():
                break
            back = stage(back.unionByName(more), "back")
        parts = back.groupBy("color").agg(F.count("*").alias("n")).where("n > 1").select("color")
        found = stage(found.unionByName(back.join(parts, "color", "left_semi").select("id")), "found")
        rest = live.join(back.select(F.col("id").alias("src")), "src", "left_anti").join(back.select(F.col("id").alias("dst")), "dst", "left_anti")
        live = _trim(stage(rest.select("src", "dst"), "live"))
    return found.distinct()


def _trim(live: DataFrame) -> DataFrame:
    """Take off nodes without a way in or without a way out until none is left."""
    before = live.count()
    while before:
        nxt = live.join(live.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        nxt = stage(nxt.join(live.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"), "live")
        unstage(live)
        live, after = nxt, nxt.count()
        if after == before:
            break
        before = after
    return live
