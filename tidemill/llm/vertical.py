"""Which keys occur with several owners, counted in fragments of the keys' order.

Tasks send batches of keys to fragments, a row per batch and fragment; each fragment's task sorts
its keys and answers every batch; the answers of a batch meet again with what was kept about it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

#: What ``fragment_rows`` makes.
SENT = "fragment long, batch long, lone binary, owner binary, multi binary"


def table_bytes(table: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_batch(table)
    return sink.getvalue().to_pybytes()


def fragment_rows(number: int, meta: pa.RecordBatch, keys: np.ndarray, owner: np.ndarray, fragments: int, kind: str) -> pa.RecordBatch:
    """The rows of one batch: ``meta`` for later, and for each fragment its keys (64 bits).

    A key of one owner goes with the owner (numpy type ``kind``); one that several have goes
    once, without owners: they are known to share it. So a key of very many owners arrives once a
    batch. The fragment gives the high bits of a key, 32 low bits tell keys apart inside it.
    """
    batch = (TaskContext.get().partitionId() << 32) | number
    order = np.argsort(keys, kind="stable")
    keys, owner = keys[order], owner[order]
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(first)
    lone = np.diff(np.append(at, len(keys))) == 1
    keys, owner = keys[at], owner[at]
    place = ((keys >> np.uint64(32)) * np.uint64(fragments)) >> np.uint64(32)
    edges = np.searchsorted(place, np.arange(fragments + 1, dtype=np.uint64))
    low = (keys & np.uint64(0xFFFFFFFF)).astype("<u4")
    to, alone, owners, multi = [-1 - batch], [table_bytes(meta)], [b""], [b""]
    for f in np.flatnonzero(np.diff(edges)):
        here = slice(edges[f], edges[f + 1])
        mine = lone[here]
        to.append(int(f))
        alone.append(low[here][mine].tobytes())
        owners.append(owner[here][mine].astype(kind).tobytes())
        multi.append(low[here][~mine].tobytes())
    return pa.RecordBatch.from_pydict({
        "fragment": pa.array(to, pa.int64()), "batch": pa.array([batch] * len(to), pa.int64()),
        "lone": pa.array(alone, pa.binary()), "owner": pa.array(owners, pa.binary()), "multi": pa.array(multi, pa.binary()),
    })


def answer_batches(sent: DataFrame, kind: str, finish: Callable[[pa.Table, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """``finish(meta, owners)`` for each batch: the owners of keys that nothing else has.

    Chance agreement of low bits can only make that list too short.
    """

    def count(key: tuple, rows: pa.Table) -> pa.Table:
        batches = rows.column("batch")
        if key[0].as_py() < 0:
            return pa.table({"batch": batches, "meta": rows.column("lone"), "owner": pa.nulls(len(batches), pa.binary())})
        lone = [np.frombuffer(x, "<u4") for x in rows.column("lone").to_pylist()]
        multi = [np.frombuffer(x, "<u4") for x in rows.column("multi").to_pylist()]
        both = np.concatenate([*lone, *multi])
        order = np.argsort(both, kind="stable")
        ranked = both[order]
        twin = ranked[1:] == ranked[:-1]
        same = np.zeros(len(ranked), bool)
        same[1:] |= twin
        same[:-1] |= twin
        shared = np.empty(len(both), bool)
        shared[order] = same
        out, at = [], 0
        for mine, owners in zip(lone, rows.column("owner").to_pylist(), strict=True):
            out.append(np.frombuffer(owners, kind)[~shared[at : at + len(mine)]].tobytes())
            at += len(mine)
        return pa.table({"batch": batches, "meta": pa.nulls(len(batches), pa.binary()), "owner": pa.array(out, pa.binary())})

    def gather(key: tuple, rows: pa.Table) -> pa.Table:
        meta = next(x for x in rows.column("meta").to_pylist() if x is not None)
        owners = b"".join(x for x in rows.column("owner").to_pylist() if x)
        return finish(pa.ipc.open_stream(meta).read_all(), np.frombuffer(owners, kind))

    counted = sent.groupBy("fragment").applyInArrow(count, "batch long, meta binary, owner binary")
    return counted.groupBy("batch").applyInArrow(gather, schema)
