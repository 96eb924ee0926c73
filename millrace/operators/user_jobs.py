"""Jobs of user functions over bytes: map(line) gives pairs, reduce(key, values) gives a result."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from operator import itemgetter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship_package

Pair = tuple[bytes, bytes]
MapFn = Callable[[bytes], Iterable[Pair] | None]
ReduceFn = Callable[[bytes, Iterator[bytes]], bytes]
ROWS = 10_000


def _check(name: str, fn, arity: int) -> None:
    if not callable(fn):
        raise TypeError(f"{name} isn't a function")
    try:
        inspect.signature(fn).bind(*[b""] * arity)
    except TypeError:
        raise TypeError(f"{name} must take {arity} argument{'s' * (arity > 1)}") from None
    except ValueError:  # built-in functions may tell no signature
        return


def _batches(rows: Iterable[tuple], names: list[str]):
    import pyarrow as pa

    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*held)], names=names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*held)], names=names)


def _stream(batches) -> Iterator[Pair]:
    for b in batches:
        yield from zip(b.column(0).to_pylist(), b.column(1).to_pylist())


def map_lines(rows: DataFrame, map_fn: MapFn, combine: ReduceFn | None = None) -> DataFrame:
    """(key, value), both binary, of map_fn over lines (column value); None or nothing emits no pair.

    combine, if given, folds a key's values of up to ROWS pairs into one before the shuffle.
    """
    _check("map", map_fn, 1)
    ship_package(rows.sparkSession)

    def emit(batches):
        for b in batches:
            for line in b.column(0).to_pylist():
                yield from map_fn(line) or ()

    def run(batches):
        found = emit(batches)
        if combine is None:
            yield from _batches(found, ["key", "value"])
            return
        while True:
            some: dict[bytes, list[bytes]] = {}
            count = 0
            for k, v in found:
                some.setdefault(k, []).append(v)
                count += 1
                if count == ROWS:
                    break
            if not some:
                return
            yield from _batches(((k, combine(k, iter(vs))) for k, vs in some.items()), ["key", "value"])

    return rows.select(F.col("value").cast("binary")).mapInArrow(run, "key binary, value binary")


def reduce_pairs(pairs: DataFrame, reduce_fn: ReduceFn, reducers: int | None = None) -> DataFrame:
    """(key, result) of reduce_fn, called once for each key with an iterator of its values in any order.

    Pairs are sorted by key on disk where need be and pass as a stream, so a key's values never gather.
    An error of the function fails the job.
    """
    _check("reduce", reduce_fn, 2)
    ship_package(pairs.sparkSession)

    def run(batches):
        groups = groupby(_stream(batches), key=itemgetter(0))
        yield from _batches(((k, reduce_fn(k, (v for _, v in vs))) for k, vs in groups), ["key", "result"])

    dealt = pairs.repartition(reducers, "key") if reducers else pairs.repartition("key")
    return dealt.sortWithinPartitions("key").mapInArrow(run, "key binary, result binary")


def run_user_job(
    rows: DataFrame, map_fn: MapFn, reduce_fn: ReduceFn, reducers: int | None = None, combine: ReduceFn | None = None
) -> DataFrame:
    """(key, result) of a user's map and reduce over lines."""
    _check("reduce", reduce_fn, 2)
    return reduce_pairs(map_lines(rows, map_fn, combine), reduce_fn, reducers)
