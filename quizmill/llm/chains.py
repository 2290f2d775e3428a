"""Running values along chains that may be longer than a task: sorted runs, each carried on to the next."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quizmill.storage import materialize

FOLDS = {
    "sum": (np.cumsum, np.subtract, np.add),
    "xor": (np.bitwise_xor.accumulate, np.bitwise_xor, np.bitwise_xor),
}
TOTALS = {"sum": F.sum, "xor": F.bit_xor}


def _run(chain: int, folded: dict[int, str], names: list[str]):
    """Folds the columns of a sorted part along its chains; ends with a row of the last chain's totals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, carried = TaskContext.get().partitionId(), None, dict.fromkeys(folded, np.int64(0))
        kinds = None
        for batch in batches:
            if not batch.num_rows:
                continue
            kinds = kinds or batch.schema
            keys = batch.column(chain).to_numpy()
            starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            sizes = np.diff(starts, append=len(keys))
            columns = list(batch.columns)
            for c, fold in folded.items():
                through, less, plus = FOLDS[fold]
                own = columns[c].to_numpy()
                whole = through(own)
                whole = less(whole, np.repeat(less(whole[starts], own[starts]), sizes))
                if keys[0] == last:
                    whole[: sizes[0]] = plus(whole[: sizes[0]], carried[c])
                carried[c] = whole[-1]
                columns[c] = pa.array(whole)
            last = keys[-1]
            n = len(keys)
            columns += [pa.array(np.full(n, part)), pa.array(np.zeros(n, bool))]
            yield pa.RecordBatch.from_arrays(columns, names=names)
        if last is not None:
            row = [pa.array([carried[c]] if c in folded else [last] if c == chain else [None], f.type) for c, f in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*row, pa.array([part], pa.int64()), pa.array([True])], names=names)

    return run


def run_along(df: DataFrame, chain: str, order: list, folds: dict[str, str], name: str) -> DataFrame:
    """``df`` with each column of ``folds`` (whole numbers, never null) replaced by its running ``sum`` or
    ``xor`` along the rows of equal ``chain`` (a whole number, never null) in the order of ``order``.

    Rows are dealt out by range, so a chain may span many tasks; equal rows of ``order`` stay together. A
    task reads its rows once and holds a batch at a time. What a chain has from earlier tasks is added from
    a table of one row a task.
    """
    kinds = T.StructType(
        [T.StructField(f.name, f.dataType) for f in df.schema]
        + [T.StructField("_part", T.LongType()), T.StructField("_last", T.BooleanType())]
    )
    at = {df.columns.index(c): fold for c, fold in folds.items()}
    runs = _run(df.columns.index(chain), at, kinds.names)
    ordered = df.repartitionByRange(chain, *order).sortWithinPartitions(chain, *order)
    written = materialize(ordered.mapInArrow(runs, kinds), name)
    so_far = W.partitionBy(chain).orderBy("_part")
    before = (
        written.where("_last")
        .select(
            F.lead("_part").over(W.orderBy("_part")).alias("_part"), F.col(chain),
            *(TOTALS[fold](c).over(so_far).alias(f"_{c}") for c, fold in folds.items()),
        )
        .where("_part is not null")
    )
    # one row for each part at most
    joined = written.where("not _last").join(F.broadcast(before), ["_part", chain], "left")
    both = {
        c: F.col(c) + F.coalesce(f"_{c}", F.lit(0)) if fold == "sum" else F.col(c).bitwiseXOR(F.coalesce(f"_{c}", F.lit(0)))
        for c, fold in folds.items()
    }
    return joined.select(*(both.get(c, F.col(c)).alias(c) for c in df.columns))
