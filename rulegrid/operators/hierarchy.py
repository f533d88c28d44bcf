"""Problem 1: parent-child rows to full hierarchies, by leaf peeling, Euler tours and parallel list ranking.

1. `loops` peels leaves in doubling steps: what survives 2^k peelings is the image of the 2^k-th parent map, so
   squaring that map peels 1, 2, 4, ... layers. The survivors only shrink; when a step no longer shrinks them they
   are exactly the rows on loops, and the rows that still have an ancestor among them are those below.
2. Loop rows lose their parent edge, which leaves a forest. Its Euler tour has two elements per row, the entry 2*id
   and the exit 2*id+1; each element's successor comes from the first child, the next sibling or the parent.
   Children are ordered by id within blocks of 2^BLOCK_BITS ids and the blocks are then chained, so the children
   of one hot parent are never one group.
3. List ranking: all elements of a block of ids are contracted in numpy to their exit from the block; only the
   elements entered from another block remain, and pointer doubling ranks those in log2 of their number of rounds.
4. The entry and exit ranks (counted from the tour's end) give depth, root, number of descendants and, by interval
   nesting, the ancestors. Paths are read off in one sorted pass per segment of 2^SEGMENT_BITS tour positions; rows
   open across a segment's border are carried into it, so that no pass needs a whole tree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rulegrid.runtime import checkpointed

BLOCK_BITS = 14
SEGMENT_BITS = 16
SEPARATOR = "/"
END = -(1 << 62)


def current_rows(clauses: DataFrame) -> DataFrame:
    """(id, parent_id) of the current row of each id: the latest created_at, the greatest parent_id on a tie."""
    return (
        clauses.where("id IS NOT NULL")
        .groupBy(F.col("id").cast("long").alias("id"))
        .agg(F.max(F.struct("created_at", F.col("parent_id").cast("long").alias("parent_id"))).alias("row"))
        .select("id", "row.parent_id")
    )


def _existing_parents(rows: DataFrame) -> DataFrame:
    """A parent that is not a row becomes null."""
    known = rows.select(F.col("id").alias("parent_id"))
    there = rows.where("parent_id IS NOT NULL").join(known, "parent_id").select("id", "parent_id")
    return there.unionByName(rows.select("id").join(there.select("id"), "id", "left_anti").withColumn("parent_id", F.lit(None).cast("long")))


def loops(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From (id, parent_id), parents non-null: (id, anchor) of the rows whose walk never ends, anchor being a row on
    their loop, and (id, cycle_id) of the rows on loops."""
    jump = checkpointed(edges.select("id", F.col("parent_id").alias("anchor")))
    kept = -1
    while True:
        heads = jump.select("anchor").distinct().count()
        if heads == 0 or heads == kept:
            break
        kept = heads
        far = jump.select(F.col("id").alias("anchor"), F.col("anchor").alias("next"))
        jump = checkpointed(jump.join(far, "anchor").select("id", F.col("next").alias("anchor")))
    # On the loops only: the smallest id of each, by doubling the reach of a running minimum.
    ring = jump.select(F.col("anchor").alias("id")).distinct()
    low = checkpointed(edges.join(ring, "id", "left_semi").select("id", F.col("parent_id").alias("next"), F.least("id", "parent_id").alias("low")))
    before = None
    while heads:
        total = low.agg(F.sum("low")).first()[0]
        if total == before:
            break
        before = total
        ahead = low.select(F.col("id").alias("next"), F.col("next").alias("after"), F.col("low").alias("low2"))
        low = checkpointed(low.join(ahead, "next").select("id", F.col("after").alias("next"), F.least("low", "low2").alias("low")))
    return jump, low.select("id", F.col("low").alias("cycle_id"))


def _successors(forest: DataFrame) -> DataFrame:
    """(id, parent_id, first_child, next_sibling): the links of the Euler tour."""
    block = F.shiftright("id", BLOCK_BITS).alias("block")
    kids = forest.where("parent_id IS NOT NULL").select("id", "parent_id", block)
    near = Window.partitionBy("parent_id", "block").orderBy("id")
    kids = kids.withColumn("next", F.lead("id").over(near)).withColumn("opens", F.lag("id").over(near).isNull())
    heads = kids.where("opens").select("parent_id", "block", F.col("id").alias("head"))
    chain = Window.partitionBy("parent_id").orderBy("block")
    heads = heads.withColumn("next_head", F.lead("head").over(chain)).withColumn("is_first", F.lag("head").over(chain).isNull())
    linked = kids.where("next IS NOT NULL").select("id", "parent_id", F.col("next").alias("next_sibling")).unionByName(
        kids.where("next IS NULL").join(heads.select("parent_id", "block", "next_head"), ["parent_id", "block"], "left").select("id", "parent_id", F.col("next_head").alias("next_sibling"))
    )
    return (
        linked.unionByName(forest.where("parent_id IS NULL").select("id", "parent_id", F.lit(None).cast("long").alias("next_sibling")))
        .join(heads.where("is_first").select(F.col("parent_id").alias("id"), F.col("head").alias("first_child")), "id", "left")
    )


_CONTRACTED = "id long, parent_id long, in_to long, in_steps long, in_sum long, in_last long, out_to long, out_steps long, out_sum long, out_last long"


def _contract(links: pd.DataFrame) -> pd.DataFrame:
    """Follows the tour from both elements of each row to the first element outside this block (END at a tour's end).

    in_/out_: that element, the number of steps, the sum of +1 per entry and -1 per exit passed, the last element passed.
    """
    links = links.sort_values("id", ignore_index=True)
    ids = links["id"].to_numpy("i8")
    n = len(ids)
    after_in = np.where(links["first_child"].isna(), 2 * ids + 1, 2 * links["first_child"].fillna(0).to_numpy("i8"))
    sibling, parent = links["next_sibling"], links["parent_id"]
    after_out = np.where(~sibling.isna(), 2 * sibling.fillna(0).to_numpy("i8"), np.where(parent.isna(), END, 2 * parent.fillna(0).to_numpy("i8") + 1))
    to = np.concatenate([after_in, after_out]).astype("i8")
    at = np.searchsorted(ids, to >> 1)
    inside = (to != END) & (at < n)
    inside[inside] = ids[at[inside]] == to[inside] >> 1
    local = np.where(inside, at + n * (to & 1), -1)
    steps, total, last = np.ones(2 * n, "i8"), np.repeat(np.array([1, -1], "i8"), n), np.concatenate([2 * ids, 2 * ids + 1])
    while (moving := np.flatnonzero(local >= 0)).size:
        hop = local[moving]
        add_steps, add_total, new = steps[hop], total[hop], (to[hop], last[hop], local[hop])
        steps[moving] += add_steps
        total[moving] += add_total
        to[moving], last[moving], local[moving] = new
    return pd.DataFrame({"id": ids, "parent_id": links["parent_id"].astype("Int64"), "in_to": to[:n], "in_steps": steps[:n], "in_sum": total[:n], "in_last": last[:n], "out_to": to[n:], "out_steps": steps[n:], "out_sum": total[n:], "out_last": last[n:]})


def ranked(forest: DataFrame) -> DataFrame:
    """(id, parent_id, root, depth, entry, exit) of a forest (id, parent_id): entry > exit are ranks from the end of the
    root's tour, so a is an ancestor of b exactly if they share the root and entry_a > entry_b and exit_a < exit_b."""
    links = _successors(forest)
    blocks = links.withColumn("block", F.shiftright("id", BLOCK_BITS)).groupBy("block")
    local = checkpointed(blocks.applyInPandas(_contract, _CONTRACTED))
    entered = local.select(F.col("in_to").alias("e")).unionByName(local.select(F.col("out_to").alias("e"))).where(F.col("e") != END).distinct()
    doors = entered.withColumn("id", F.shiftright("e", 1)).join(local, "id").withColumn("is_out", F.col("e").bitwiseAND(F.lit(1)) == 1)
    pick = lambda name: F.when(F.col("is_out"), F.col(f"out_{name}")).otherwise(F.col(f"in_{name}")).alias(name)
    doors = checkpointed(doors.select("e", pick("to"), pick("steps"), pick("sum"), pick("last")))
    while doors.where(F.col("to") != END).limit(1).count():
        ahead = doors.select(F.col("e").alias("to"), F.col("to").alias("to2"), F.col("steps").alias("steps2"), F.col("sum").alias("sum2"), F.col("last").alias("last2"))
        moved = doors.where(F.col("to") != END).join(ahead, "to").select("e", F.col("to2").alias("to"), (F.col("steps") + F.col("steps2")).alias("steps"), (F.col("sum") + F.col("sum2")).alias("sum"), F.col("last2").alias("last"))
        doors = checkpointed(doors.where(F.col("to") == END).unionByName(moved))
    ends = doors.select("e", "steps", "sum", "last")
    full = local
    for side in ("in", "out"):
        tail = ends.select(F.col("e").alias(f"{side}_to"), *[F.col(c).alias(f"{side}_{c}2") for c in ("steps", "sum", "last")])
        full = full.join(tail, f"{side}_to", "left")
    whole = lambda side, c: F.col(f"{side}_{c}") + F.coalesce(F.col(f"{side}_{c}2"), F.lit(0))
    return full.select(
        "id",
        "parent_id",
        F.shiftright(F.coalesce("in_last2", "in_last"), 1).alias("root"),
        (-whole("in", "sum")).cast("int").alias("depth"),
        whole("in", "steps").alias("entry"),
        whole("out", "steps").alias("exit"),
    )


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Reads paths off rows sorted by (root, segment, entry from high to low); the stack holds the open ancestors:
    (exit, path, value in force, its holder, the holder's depth, own depth)."""
    place, stack = None, []
    for pdf in batches:
        out = []
        for i, root, seg, entry, leave, carried, label, value, depth in zip(*(pdf[c].tolist() for c in ("id", "root", "segment", "entry", "exit", "carried", "label", "value", "depth"))):
            if place != (root, seg):
                place, stack = (root, seg), []
            while stack and stack[-1][0] > entry:
                stack.pop()
            path = f"{stack[-1][1]}{SEPARATOR}{label}" if stack else label
            held = (value, i, depth) if value is not None else stack[-1][2:] if stack else (None, None, None)
            stack.append((leave, path, *held))
            if not carried:
                out.append((i, path, held[0], held[1], None if held[1] is None else depth - held[2]))
        yield pd.DataFrame(out, columns=["id", "path", "value", "holder", "distance"]).astype({"holder": "Int64", "distance": "Int64"})


def walked(tour: DataFrame, label: str | None = None, value: str | None = None) -> DataFrame:
    """(id, path, value, holder, distance) from the output of `ranked`: the labels (else the ids) from the root down,
    and the value of the nearest row at or above that has one, with that row's id and how far above it is.

    tour carries the columns named by `label` and `value`.
    """
    seg = lambda c: F.shiftright(c, SEGMENT_BITS)
    base = tour.select(
        "id", "root", "entry", "exit", "depth", F.coalesce(F.col(label).cast("string"), F.lit("")).alias("label") if label else F.col("id").cast("string").alias("label"),
        F.col(value).cast("string").alias("value") if value else F.lit(None).cast("string").alias("value"),
    )
    own = base.withColumns({"segment": seg("entry"), "carried": F.lit(False)})
    open_over = base.where(seg("exit") < seg("entry")).withColumn("segment", F.explode(F.sequence(seg("exit"), seg("entry") - 1))).withColumn("carried", F.lit(True))
    rows = own.unionByName(open_over).repartition("root", "segment").sortWithinPartitions("root", "segment", F.desc("entry"))
    return rows.mapInPandas(_walk, "id long, path string, value string, holder long, distance long")


def paths(tour: DataFrame) -> DataFrame:
    """(id, path) with the ids from the root down."""
    return walked(tour).select("id", "path")


def inherited(clauses: DataFrame, label: Column, value: Column) -> DataFrame:
    """(id, path, value, holder, distance) over the trees of `clauses`, label and value being those of the current row.

    Loop rows are roots, as in `hierarchy`.
    """
    rows = current_rows(clauses)
    carried = clauses.where("id IS NOT NULL").groupBy(F.col("id").cast("long").alias("id")).agg(F.max(F.struct("created_at", F.col("parent_id").cast("long").alias("p"), label.alias("label"), value.alias("value"))).alias("c"))
    edges = checkpointed(_existing_parents(rows))
    _, rings = loops(edges.where("parent_id IS NOT NULL"))
    rings = checkpointed(rings)
    forest = edges.join(rings, "id", "left").select("id", F.when(F.col("cycle_id").isNull(), F.col("parent_id")).alias("parent_id"))
    return walked(ranked(forest).join(carried.select("id", "c.label", "c.value"), "id"), "label", "value")


def hierarchy(clauses: DataFrame, with_paths: bool = True) -> DataFrame:
    """(id, root, depth, n_descendants, entry, exit, cycle_id[, path]) of the current row of every id.

    clauses: id, parent_id, created_at. A parent that is null or does not exist makes its child a root at depth 0;
    parents may lie in another circular. Rows on a loop are roots of what hangs below them; they and all rows below
    carry cycle_id, the smallest id on the loop, and it is null elsewhere. Descendants of a row are the rows of the
    same root whose (exit, entry) interval lies within its own. A row that is its own parent is a loop of one.
    Repeated rows count once, a null id is left out, an empty table gives an empty result.
    """
    rows = checkpointed(_existing_parents(current_rows(clauses)))
    reach, rings = loops(rows.where("parent_id IS NOT NULL"))
    rings = checkpointed(rings)
    forest = rows.join(rings, "id", "left").select("id", F.when(F.col("cycle_id").isNull(), F.col("parent_id")).alias("parent_id"))
    tour = ranked(forest)
    if with_paths:
        tour = checkpointed(tour)
    whole = tour.join(rings.select(F.col("id").alias("root"), "cycle_id"), "root", "left")
    out = whole.select("id", "root", "depth", ((F.col("entry") - F.col("exit") - 1) / 2).cast("long").alias("n_descendants"), "entry", "exit", "cycle_id")
    return out.join(paths(tour), "id") if with_paths else out


def closure(clauses: DataFrame) -> DataFrame:
    """(ancestor_id, descendant_id, distance): every row with each of its ancestors, itself excluded."""
    path = F.slice(F.reverse(F.transform(F.split("path", "/"), lambda x: x.cast("long"))), 2, 1 << 30)
    spread = hierarchy(clauses).select("id", F.posexplode(path).alias("pos", "ancestor_id"))
    return spread.select("ancestor_id", F.col("id").alias("descendant_id"), (F.col("pos") + 1).alias("distance"))
