"""Components solved within a worker: rows of one bucket or scope stand together, and what is too large or leaves its bucket is handed back.

Rows come dealt by bucket or scope and sorted within partitions, so that a worker holds one bucket or scope at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Nodes whose numbers agree but for so many low bits share a bucket.
BUCKET_BITS = 12
#: Buckets of more edges than this are handed back whole.
BUCKET_EDGES = 1_000_000
#: Rows a partition holds: partitions grow with the input, so that a task's memory doesn't.
PART_ROWS = 400_000


def parts(df: DataFrame, rows: int) -> int:
    return max(df.sparkSession.sparkContext.defaultParallelism, rows // PART_ROWS + 1)


def tarjan(n: int, first: list[int], to: list[int]) -> list[int]:
    """Number of the strong component of each of n nodes; the edges of v lead to to[first[v]:first[v + 1]]."""
    order, low, comp, at = [0] * n, [0] * n, [-1] * n, first[:n]
    open_, count, done = [], 0, 0
    for root in range(n):
        if order[root]:
            continue
        count += 1
        order[root] = low[root] = count
        open_.append(root)
        path = [root]
        while path:
            v = path[-1]
            if (i := at[v]) < first[v + 1]:
                at[v], w = i + 1, to[i]
                if not order[w]:
                    count += 1
                    order[w] = low[w] = count
                    open_.append(w)
                    path.append(w)
                elif comp[w] < 0 and order[w] < low[v]:
                    low[v] = order[w]
                continue
            path.pop()
            if path and low[v] < low[path[-1]]:
                low[path[-1]] = low[v]
            if low[v] == order[v]:
                while True:
                    w = open_.pop()
                    comp[w] = done
                    if w == v:
                        break
                done += 1
    return comp


def _bucket_components(bucket: int, src: np.ndarray, dst: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, bool]]:
    """(node, root) of cycles that stay in the bucket, and the edges that may lie on a cycle that leaves it.

    All nodes outside are taken for one, node 0; what shares its component may be on a cycle through outside.
    """
    nodes, i = np.unique(np.concatenate([src, dst]), return_inverse=True)
    mine = nodes >> BUCKET_BITS == bucket
    number = np.where(mine, np.cumsum(mine), 0)
    s, d = number[i[: len(src)]], number[i[len(src) :]]
    n = int(mine.sum()) + 1
    by = np.argsort(s, kind="stable")
    first = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=n))])
    comp = np.array(tarjan(n, first.tolist(), d[by].tolist()))
    size, own, of = np.bincount(comp), nodes[mine], comp[1:]
    least = np.full(len(size), np.iinfo(np.int64).max)
    np.minimum.at(least, of, own)
    inside = (of != comp[0]) & (size[of] > 1)
    out = [(own[inside], least[of[inside]], False)]
    if size[comp[0]] > 1:
        left = (s > 0) & (comp[s] == comp[0]) & (comp[d] == comp[0])
        out.append((src[left], dst[left], True))
    return out


def bucket_cycles(edges: DataFrame, n_parts: int) -> DataFrame:
    """(node, root, rest) of edges between 64-bit nodes: members of cycles within buckets, or edges (src, dst) that are left."""
    bucket = lambda c: F.shiftright(c, BUCKET_BITS)
    both = edges.select("src", "dst", F.explode(F.array_distinct(F.array(bucket("src"), bucket("dst")))).alias("bucket"))

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = lambda node, root, rest: pa.RecordBatch.from_arrays([pa.array(node), pa.array(root), pa.array(np.full(len(node), rest))], ["node", "root", "rest"])
        held, was, n, over = [], None, 0, False
        own = lambda s, d: (s[s >> BUCKET_BITS == was], d[s >> BUCKET_BITS == was], True)
        flush = lambda: [row(*x) for x in _bucket_components(was, *(np.concatenate(c) for c in zip(*held, strict=True)))] if held else []
        for batch in batches:
            s, d, b = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            ends = [0, *(np.flatnonzero(b[1:] != b[:-1]) + 1).tolist(), len(b)]
            for lo, hi in zip(ends, ends[1:], strict=False):
                if lo == hi:
                    continue
                if b[lo] != was:
                    yield from flush()
                    held, was, n, over = [], int(b[lo]), 0, False
                held.append((s[lo:hi], d[lo:hi]))
                n += hi - lo
                if over := over or n > BUCKET_EDGES:
                    yield from (row(*own(*x)) for x in held)
                    held = []
        yield from flush()

    return both.repartition(n_parts, "bucket").sortWithinPartitions("bucket").mapInArrow(solved, "node long, root long, rest boolean")


def _components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node of the component of each of n nodes, by edges (a, b); grandparents are hooked, so rounds are few on long paths too."""
    parent = np.arange(n)
    while True:
        up = parent[parent]
        to = np.minimum(up[a], up[b])
        now = up.copy()
        for x in (a, b):
            np.minimum.at(now, parent[x], to)
            np.minimum.at(now, x, to)
        now = now[now]
        if np.array_equal(now, parent):
            return now
        parent = now


def _codes(c: pa.Array) -> tuple[np.ndarray, int]:
    """Dense numbers of the values in order of appearance, with -1 for null, and how many there are."""
    d = c.dictionary_encode()
    return d.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), len(d.dictionary)


def _within(scope: np.ndarray, c: pa.Array) -> tuple[np.ndarray, int]:
    """Dense numbers of the pairs of scope and value, with -1 where the value is null."""
    code, n = _codes(c)
    return _codes(pa.array(scope * n + code, mask=code < 0))


def _lcom(scope: np.ndarray, n: int, method: pa.Array, field: pa.Array) -> np.ndarray:
    """For each of n scopes the number of components of methods that share a field; all scopes of a batch at once."""
    m, n_methods = _within(scope, method)
    f, n_fields = _within(scope, field)
    of = np.zeros(n_methods, dtype=np.int64)
    of[m[m >= 0]] = scope[m >= 0]
    linked = (m >= 0) & (f >= 0)
    root = _components(n_methods + n_fields, m[linked], f[linked] + n_methods)[:n_methods]
    return np.bincount(of[root == np.arange(n_methods)], minlength=n)


def scope_components(method_fields: DataFrame, n_parts: int, local_rows: int) -> DataFrame:
    """(scope, lcom) of scopes of up to local_rows rows; rows of larger ones come back as they are, without lcom.

    A worker holds a batch and the scope that it ends in.
    """
    schema = method_fields.select("scope", F.lit(0).cast("long").alias("lcom"), "method", "field").schema
    for f in schema:
        f.nullable = True

    def out(scope: pa.Array, lcom: pa.Array | None, method: pa.Array, field: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([scope, pa.nulls(len(scope), pa.int64()) if lcom is None else lcom, method, field], ["scope", "lcom", "method", "field"])

    def closed(cols: list[pa.Array]) -> Iterator[pa.RecordBatch]:
        scope, n = _codes(cols[0])
        if not n:
            return
        size = np.bincount(scope, minlength=n)
        over = (size > local_rows)[scope]
        if over.any():
            yield out(cols[0].filter(pa.array(over)), None, *(c.filter(pa.array(over)) for c in cols[1:]))
        lcom, few = _lcom(scope, n, *cols[1:]), size <= local_rows
        first = np.concatenate([[0], np.cumsum(size)[:-1]])[few]
        yield out(cols[0].take(pa.array(first)), pa.array(lcom[few], pa.int64()), *(pa.nulls(len(first), c.type) for c in cols[1:]))

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, large = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = batch.columns if held is None else [pa.concat_arrays(c) for c in zip(held, batch.columns, strict=True)]
            scope, n = _codes(cols[0])
            lo, hi = 0, int(np.searchsorted(scope, n - 1))
            if large is not None and cols[0][0] == large:
                lo = int(np.searchsorted(scope, 1))
                yield out(cols[0][:lo], None, *(c[:lo] for c in cols[1:]))
                if n == 1:
                    continue
            yield from closed([c[lo:hi] for c in cols])
            held, large = [c[hi:] for c in cols], None
            if len(held[0]) > local_rows:
                yield out(held[0], None, *held[1:])
                held, large = None, cols[0][hi]
        if held is not None:
            yield from closed(held)

    rows = method_fields.where("scope is not null").select("scope", "method", "field")
    return rows.repartition(n_parts, "scope").sortWithinPartitions("scope").mapInArrow(solved, schema)
