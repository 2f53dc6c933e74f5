"""Aggregates that users write themselves: F09.

An aggregator has a zero, takes rows (update), joins two states (merge) and ends in a result (finish). States are made within
each task before anything is shuffled: a task keeps at most ``most_keys`` states and hands them on when it has more. States of one key
are then merged in two steps, first those of each of ``salts`` shares, then the shares, so a key that every task holds is never
one group of all its states. Both steps run over sorted states and hold one at a time; no key costs a call of its own. A state's share is that of its task, so a task that runs again gives the same. merge must not depend
on the order of states.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


class Aggregator:
    """state and output are DDL; a state is a tuple of the state's columns, a result one of the output's."""

    state: str
    output: str
    columns: list[str]  # what update reads, in order

    def zero(self) -> tuple:
        raise NotImplementedError

    def update(self, state: tuple, row: tuple) -> tuple:
        raise NotImplementedError

    def merge(self, a: tuple, b: tuple) -> tuple:
        raise NotImplementedError

    def finish(self, state: tuple) -> tuple:
        raise NotImplementedError


def _arrow(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


def aggregate(df: DataFrame, keys: list[str], agg: Aggregator, most_keys: int = 50_000, salts: int = 32) -> DataFrame:
    """keys and the aggregator's output, one row for each key; a null key is a key. Rows go through Arrow in batches."""
    kinds = {f.name: f.dataType.simpleString() for f in df.select(*keys).schema.fields}
    by = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    n = len(keys)
    inner, outer = _arrow(f"{by}, {agg.state}"), _arrow(f"{by}, {agg.output}")

    def columns(rows: list[tuple], schema: pa.Schema) -> list[pa.Array]:
        return [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[tuple, tuple] = {}
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                k = row[:n]
                states[k] = agg.update(states[k] if k in states else agg.zero(), row[n:])
                if len(states) > most_keys:
                    yield pa.RecordBatch.from_arrays(columns([(*k, *s) for k, s in states.items()], inner), schema=inner)
                    states.clear()
        yield pa.RecordBatch.from_arrays(columns([(*k, *s) for k, s in states.items()], inner), schema=inner)

    def merged(made, schema: pa.Schema):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last, state = (), None
            for b in batches:
                out = []
                for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    k = row[:n]
                    if state is not None and (k == last or all(x == y or (x != x and y != y) for x, y in zip(k, last, strict=True))):  # NaN is a key too
                        state = agg.merge(state, row[n:])
                        continue
                    if state is not None:
                        out.append((*last, *made(state)))
                    last, state = k, row[n:]
                yield pa.RecordBatch.from_arrays(columns(out, schema), schema=schema)
            if state is not None:
                yield pa.RecordBatch.from_arrays(columns([(*last, *made(state))], schema), schema=schema)

        return run

    session = df.sparkSession
    parts = max(session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions")))  # stated, as few bytes would be put into one task
    states = df.select(*keys, *agg.columns).mapInArrow(partial, f"{by}, {agg.state}")
    dealt = states.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts))).repartition(parts, *keys, "_salt").drop("_salt")
    few = dealt.sortWithinPartitions(*keys).mapInArrow(merged(lambda s: s, inner), f"{by}, {agg.state}")
    return few.repartition(parts, *keys).sortWithinPartitions(*keys).mapInArrow(merged(agg.finish, outer), f"{by}, {agg.output}")


class MarketPrices(Aggregator):
    """A market's outcomes: how many, the sum of their prices, the cheapest one, and what buying all of them once gains."""

    columns = ["token_id", "price"]
    state = "n long, total double, least double, token string"
    output = "outcomes long, total double, cheapest string, gain double"

    def zero(self):
        return (0, 0.0, None, None)

    def update(self, state, row):
        (token, price), (n, total, least, kept) = row, state
        if price is None:
            return state
        if least is None or price < least or (price == least and (token or "") < (kept or "")):
            least, kept = price, token
        return (n + 1, total + price, least, kept)

    def merge(self, a, b):
        cheap = min((x for x in (a, b) if x[2] is not None), key=lambda x: (x[2], x[3] or ""), default=(0, 0.0, None, None))
        return (a[0] + b[0], a[1] + b[1], cheap[2], cheap[3])

    def finish(self, state):
        return (state[0], state[1], state[3], 1.0 - state[1])
