"""The edit log and incremental scans as streams."""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def latest_values(log: DataFrame) -> DataFrame:
    """A stream of log rows (id, field, value, seq) as the running last value of each (id, field): a maximum, so late rows don't matter."""
    return log.groupBy("id", "field").agg(F.max_by("value", "seq").alias("value"), F.max("seq").alias("seq"))


OUT, STATE = "id long, n_edits long, n_undone long, value double", "seqs array<long>, values array<double>, back_seqs array<long>, back_values array<double>, undone long"


def _fold(depth: int):
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seqs, values, back_seqs, back_values, undone = (list(x) if isinstance(x, (list, tuple)) or hasattr(x, "tolist") else x for x in (state.get if state.exists else ([], [], [], [], 0)))
        stands, back = list(zip(seqs, values)), list(zip(back_seqs, back_values))
        rows = pd.concat(list(batches)).sort_values("seq")
        for action, seq, value in zip(rows["action"], rows["seq"], rows["value"]):
            if action == "undo":
                if stands:
                    back.append(stands.pop())
                    undone += 1
            elif action == "redo":
                if back:
                    stands.append(back.pop())
                    undone -= 1
            else:
                stands.append((int(seq), float(value)))
                stands, back = stands[-depth:], []
        state.update(([s for s, _ in stands], [v for _, v in stands], [s for s, _ in back], [v for _, v in back], undone))
        yield pd.DataFrame({"id": [key[0]], "n_edits": [len(stands)], "n_undone": [undone], "value": [stands[-1][1] if stands else None]})

    return step


def undoable(log: DataFrame, depth: int = 100) -> DataFrame:
    """A stream of (id, action, seq, value), action "edit", "undo" or "redo", folded for each id: how many edits stand, how many undos do, and the value in force.

    An edit ends what could be redone. The state of an id is two stacks of at most depth edits together, so it is bounded.
    """
    return log.groupBy("id").applyInPandasWithState(_fold(depth), OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def publish(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True):
    """Micro-batches into sink(batch, number); with once, what is there now and then stop."""
    writer = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
