"""Clusters of rows that name others as their parents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.lineage import cut

#: Rows, and bytes, that a task links at once.
SLAB, SLAB_BYTES = 100_000, 64 << 20
#: Rows of clusters that a task handles one after the other, about.
A_TASK = 250_000


def _least(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``n`` numbers the least that links (a, b) lead to: ends of links hook to the smaller, hooks are followed up."""
    least = np.arange(n)
    while len(a):
        x, y = least[a], least[b]
        low = np.minimum(x, y)
        np.minimum.at(least, x, low)
        np.minimum.at(least, y, low)
        while (up := least[least]).tobytes() != least.tobytes():
            least = up
        apart = least[a] != least[b]
        a, b = a[apart], b[apart]
    return least


def _linked(slab: pa.Table) -> pa.Table:
    """A slab with the smallest txid that parents within it lead to, whether any do, and the parents that lie elsewhere."""
    ids, lists = slab["txid"].combine_chunks(), slab["parents"].combine_chunks()
    order = pc.sort_indices(ids).to_numpy()
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.arange(len(ids))
    child, parent = pc.list_parent_indices(lists).to_numpy(), pc.list_flatten(lists)
    here = pc.index_in(parent, value_set=ids)
    inside = here.is_valid().to_numpy(zero_copy_only=False)
    least = _least(len(ids), rank[child[inside]], rank[here.drop_null().to_numpy()])
    several = np.bincount(least, minlength=len(ids))[least] > 1
    outside = ~inside & parent.is_valid().to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(np.bincount(child[outside], minlength=len(ids)))]).astype(np.int32)
    elsewhere = pa.ListArray.from_arrays(pa.array(ends), parent.filter(pa.array(outside)))
    columns = {"cluster": ids.take(pa.array(order[least[rank]])), "linked": pa.array(several[rank]), "_elsewhere": elsewhere}
    for name, column in columns.items():
        slab = slab.append_column(name, column)
    return slab


def _slabs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= SLAB or sum(b.nbytes for b in held) >= SLAB_BYTES:
            yield from _linked(pa.Table.from_batches(held)).to_batches(10_000)
            held = []
    if held:
        yield from _linked(pa.Table.from_batches(held)).to_batches(10_000)


def _roots(links: DataFrame) -> DataFrame:
    """(label, root): the smallest label that links (a, b), of different labels, lead to.

    A round hooks each label to its smallest neighbour, follows hooks to their ends, and goes on with the links between ends.
    """
    roots = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = cut(both.groupBy(F.col("a").alias("label")).agg(F.least("label", F.min("b")).alias("root")))
        while True:
            far = hooks.select(F.col("label").alias("root"), F.col("root").alias("_far"))
            jumped = cut(hooks.join(far, "root").select("label", F.col("_far").alias("root"), (F.col("_far") != F.col("root")).alias("_moved")))
            hooks = jumped.select("label", "root")
            if jumped.filter("_moved").isEmpty():
                break
        if roots is None:
            roots = hooks
        else:
            roots = cut(roots.join(hooks.select(F.col("label").alias("root"), F.col("root").alias("_far")), "root", "left").select("label", F.coalesce("_far", "root").alias("root")))
        near = lambda end: hooks.select(F.col("label").alias(end), F.col("root").alias(f"_{end}"))  # noqa: B023, E731
        links = cut(links.join(near("a"), "a").join(near("b"), "b").filter("_a <> _b").select(F.col("_a").alias("a"), F.col("_b").alias("b")).distinct())
        if links.isEmpty():
            return roots


def clustered(rows: DataFrame) -> DataFrame:
    """``rows`` (txid, parents, ...) with ``cluster``, the smallest txid that parents among the rows lead to in any direction, and
    ``linked``, whether the cluster has more than one.

    A task links the rows of a slab at once, as relatives mostly lie close together; parents that aren't in their child's slab are
    looked up by a join, and only clusters that these link go through rounds of joins.
    """
    schema = StructType(list(rows.schema)).add("cluster", rows.schema["txid"].dataType).add("linked", "boolean").add("_elsewhere", rows.schema["parents"].dataType)
    local = cut(rows.mapInArrow(_slabs, schema))
    ends = local.select("cluster", F.explode("_elsewhere").alias("txid")).join(local.select("txid", F.col("cluster").alias("b")), "txid")
    links = cut(ends.select(F.col("cluster").alias("a"), "b").filter("a <> b").distinct())
    if links.isEmpty():
        return local.drop("_elsewhere")
    found = local.join(_roots(links).withColumnRenamed("label", "cluster"), "cluster", "left")
    return cut(found.select(*rows.columns, F.coalesce("root", "cluster").alias("cluster"), (F.col("linked") | F.col("root").isNotNull()).alias("linked")))


def together(rows: DataFrame) -> DataFrame:
    """``rows`` dealt and sorted by cluster, so that tasks meet one after the other."""
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, rows.count() // A_TASK + 1)
    return rows.repartition(tasks, "cluster").sortWithinPartitions("cluster")


def one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict[str, list]]]:
    """For each batch of rows sorted by cluster the clusters that end in it, as columns."""
    open_: dict[str, list] = {}
    for batch in batches:
        own = batch.to_pydict()
        keys, begin, out = own["cluster"], 0, []
        for at in [*(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]:
            part = {n: c[begin:at] for n, c in own.items()}
            if open_ and part["cluster"] and open_["cluster"][0] == part["cluster"][0]:
                open_ = {n: c + part[n] for n, c in open_.items()}
            elif part["cluster"]:
                if open_:
                    out.append(open_)
                open_ = part
            begin = at
        yield out
    if open_:
        yield [open_]
