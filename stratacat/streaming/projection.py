"""Incremental projection: the log as a stream, each batch folded into the catalog that the last one left."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from stratacat.operators.projection import CATALOG, COLUMNS, Fold

LOG = "member string, seq long, op_id string, op_type string, blob_refs array<string>, args map<string,string>, created_at timestamp, state string"


#: Of an entry's states the later counts; done stays done.
RANK = {"intent": 0, "failed": 1, "done": 2}


def read_log(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """The log's Parquet files as a stream. An entry may come again, as it was or with its later state: the fold takes each once."""
    return spark.readStream.schema(LOG).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def _fold_batch(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
    """State: the catalog's rows, the next seq and what came early. Entries apply in the order of seq without a gap; the changed catalog goes out whole.

    An entry that is still an intent holds up those after it until it comes again as done or failed. Entries before the next seq have been taken and don't count again, so nothing else is remembered of them.
    """
    import json

    member = key[0]
    rows, due, early = json.loads(state.get[0]) if state.exists else ([], 0, [])
    fold = Fold(member, rows)
    waiting = {e[0]: e for e in early}
    for pdf in frames:
        for r in pdf.itertuples(index=False):
            if r.seq >= due and (int(r.seq) not in waiting or RANK[r.state] > RANK[waiting[int(r.seq)][6]]):
                waiting[int(r.seq)] = [int(r.seq), r.op_id, r.op_type, list(r.blob_refs if r.blob_refs is not None else ()), dict(r.args or ()), str(r.created_at), r.state]
    while due in waiting and waiting[due][6] != "intent":
        _, op_id, op, refs, args, at, done = waiting.pop(due)
        if done == "done":
            fold.apply(op, args, refs, op_id, at)
        due += 1
    state.update((json.dumps([list(fold.rows.values()), due, list(waiting.values())]),))
    out = pd.DataFrame(list(fold.rows.values()), columns=COLUMNS)
    for c in ("created_at", "updated_at", "last_scanned"):
        out[c] = pd.to_datetime(out[c])
    yield out.assign(size=out["size"].astype("int64"))


def project_stream(log: DataFrame) -> DataFrame:
    """CATALOG rows of each member whose log went on, as of then."""
    return log.groupBy("member").applyInPandasWithState(_fold_batch, CATALOG, "state string", "update", "NoTimeout")


def start(log: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """sink takes each batch's catalogs and its number; a batch may come again after a failure, with the same number."""
    return project_stream(log).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(availableNow=True).start()
