"""Sequential passes over ordered groups, cut into ranges that run at the same time.

Some results depend on a state that every row of a group hands to the next: the
open headings of a document, the paragraph being read, the room left in a row. A
group may be any size, so it isn't given to one task. Rows are dealt by ranges of
(group, order) and written. Where a group goes on in the next range, its rows in the
range are run for the state they end in; a range that is one such group through is
run again from the state of the range before, until no state changes. States of this
kind are forgotten soon (a strong heading, a new paragraph), so that is one round
more as a rule, and never more than there are ranges in one group. Then all ranges
run at the same time. The driver holds two keys and a state per range.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from stratafold.session import saved, ship

#: Rows of a range.
RANGE_ROWS = 100_000
#: What a step does: (state, this row's inputs) to (state, this row's outputs). States are JSON values.
Step = Callable[[Any, tuple], tuple[Any, tuple]]


def folded(df: DataFrame, group: list[str], order: list[str], inputs: list[str], step: Step, start: Any, outputs: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """`df` with the columns `outputs` (a DDL string) that `step` gives row by row, in `order` inside each group.

    Rows of equal order keep no order of their own: name a unique one. Null group
    keys are a group. An empty table stays empty.
    """
    spark = df.sparkSession
    ship(spark)
    added = T.StructType.fromDDL(outputs)
    schema = T.StructType([*df.schema.fields, *added.fields])
    arrow = to_arrow_schema(schema)
    own_names, all_names = df.columns, schema.names
    asked = [*group, *inputs]
    width = len(group)
    keys = [F.col(c) for c in (*group, *order)]
    fresh = json.dumps(start)  # a step may change its state in place
    ranges = max(1, -(-df.count() // range_rows))
    dealt = saved(df.repartitionByRange(ranges, *keys).withColumn("_range", F.spark_partition_id()))

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Iterator[tuple]]]:
        for batch in batches:
            yield batch, zip(batch.column("_range").to_pylist(), *(batch.column(c).to_pylist() for c in asked))

    def told(some: DataFrame) -> DataFrame:
        return some.repartition(F.col("_range")).sortWithinPartitions("_range", *keys)

    def ends(some: DataFrame, before: dict[int, str]) -> dict[int, str]:
        """The state that each range's rows, all of one group, end in, as JSON texts."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            here, state, out = None, None, {}
            for _, rows in rows_of(batches):
                for row in rows:
                    if row[0] != here:
                        if here is not None:
                            out[here] = json.dumps(state)
                        here, state = row[0], json.loads(before.get(row[0], fresh))
                    state, _ = step(state, row[width + 1 :])
            if here is not None:
                out[here] = json.dumps(state)
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int32()), pa.array(list(out.values()), pa.string())], ["range", "state"])

        found = told(some.select("_range", *dict.fromkeys([*group, *order, *inputs]))).mapInArrow(run, "range int, state string")
        return {r.range: r.state for r in found.collect()}  # one row per range

    before: dict[int, str] = {}
    if ranges > 1:
        key = F.struct(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(group)))
        bounds = saved(dealt.groupBy("_range").agg(F.min(key).alias("first"), F.max(key).alias("last")))
        held = sorted(bounds.collect(), key=lambda r: r["_range"])  # one row per range
        goes_on = {b["_range"]: a["_range"] for a, b in zip(held, held[1:]) if a["last"] == b["first"]}
        through = {r["_range"] for r in held if r["first"] == r["last"]}
        tails = F.broadcast(bounds.filter(F.col("_range").isin(*goes_on.values())).select(F.col("_range").alias("_r"), "last.*"))
        same = F.col("_range") == F.col("_r")
        for i, c in enumerate(group):
            same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
        tail = dealt.join(tails, same, "left_semi")
        ended: dict[int, str] = {}
        again = set(goes_on.values())
        while again:
            ended.update(ends(tail.filter(F.col("_range").isin(*again)), {r: s for r, s in before.items() if r in through}))
            new = {b: ended[a] for b, a in goes_on.items() if before.get(b, fresh) != ended[a]}
            before.update(new)
            again = {r for r in new if r in through and r in ended}

    def pass_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = key = state = None
        for batch, rows in rows_of(batches):
            out = []
            for row in rows:
                own = row[1 : width + 1]
                if row[0] != here:
                    here, state = row[0], json.loads(before.get(row[0], fresh))
                elif own != key:
                    state = json.loads(fresh)
                key = own
                state, values = step(state, row[width + 1 :])
                out.append(values)
            columns = list(zip(*out)) if out else [()] * len(added)
            made = [pa.array(list(c), arrow.field(f.name).type) for c, f in zip(columns, added)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own_names), *made], names=all_names)

    return told(dealt).mapInArrow(pass_, schema)
