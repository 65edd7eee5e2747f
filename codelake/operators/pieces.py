"""Components of pieces of a graph, each as its links lie in a task."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, ByteType, IntegerType, LongType, ShortType, StringType, StructField, StructType

#: Ids that Arrow orders as Spark does.
ORDERED = (ByteType(), ShortType(), IntegerType(), LongType(), StringType())


def fits(edges: DataFrame) -> bool:
    src, dst = edges.schema["src"].dataType, edges.schema["dst"].dataType
    return src == dst and src in ORDERED


def least(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The smallest node of the component of each of the nodes 0 … n - 1 (Tarjan); links are sorted by ``src``."""
    first, to = np.searchsorted(src, np.arange(n + 1)).tolist(), dst.tolist()
    at, seen, low, out, opened, k = first[:], [0] * n, [0] * n, [-1] * n, [], 0
    for root in range(n):
        path = [] if seen[root] else [root]
        while path:
            v = path[-1]
            if not seen[v]:
                k += 1
                seen[v] = low[v] = k
                opened.append(v)
            if at[v] < first[v + 1]:
                w = to[at[v]]
                at[v] += 1
                if not seen[w]:
                    path.append(w)
                elif out[w] < 0:
                    low[v] = min(low[v], seen[w])
                continue
            path.pop()
            if path:
                low[path[-1]] = min(low[path[-1]], low[v])
            if low[v] == seen[v]:
                members = [opened.pop()]
                while members[-1] != v:
                    members.append(opened.pop())
                smallest = min(members)
                for m in members:
                    out[m] = smallest
    return np.array(out, np.int64)


def _solved(src: pa.Array, dst: pa.Array, schema: pa.Schema) -> pa.RecordBatch:
    coded = pa.concat_arrays([src, dst]).dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    ids, n = coded.dictionary.take(order), len(order)
    place = np.full(n + 1, -1, np.int64)  # the last one is that of nulls
    place[order.to_numpy()] = np.arange(n)
    ends = place[coded.indices.fill_null(n).to_numpy(zero_copy_only=False)]
    a, b = ends[: len(src)], ends[len(src) :]
    real = (a >= 0) & (b >= 0) & (a != b)
    links = np.unique(a[real] * n + b[real])
    a, b = links // max(n, 1), links % max(n, 1)
    low = least(n, a, b)
    a, b = low[a], low[b]
    links = np.unique(a[a != b] * n + b[a != b])
    src = np.concatenate([np.arange(n), links // max(n, 1)])
    dst = np.concatenate([low, links % max(n, 1)])
    inside = np.arange(len(src)) < n
    return pa.RecordBatch.from_arrays([ids.take(pa.array(src)).cast(schema.field(0).type), ids.take(pa.array(dst)).cast(schema.field(1).type), pa.array(inside)], schema=schema)


def contracted(edges: DataFrame, piece: int) -> DataFrame:
    """src, dst, inside. A task takes its ``edges(src, dst)`` in pieces of about ``piece`` links. Of each piece:
    every node with the smallest one of its component there (inside), and the links between these smallest
    ones. Pieces may share nodes. Null ends are no nodes."""
    kind = edges.schema["src"].dataType
    schema = StructType([StructField("src", kind), StructField("dst", kind), StructField("inside", BooleanType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= piece:
                yield _solved(*(pa.concat_arrays([b.column(k) for b in held]) for k in (0, 1)), arrow)
                held, n = [], 0
        if held:
            yield _solved(*(pa.concat_arrays([b.column(k) for b in held]) for k in (0, 1)), arrow)

    return edges.select("src", "dst").mapInArrow(run, schema)
