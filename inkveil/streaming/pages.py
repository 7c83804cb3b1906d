"""Streams of pages and of edits."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor
from pyspark.sql.types import StructType

from ..operators import detect as D, policy


def detect_stream(words: DataFrame, pages: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str):
    """Detects in every micro-batch of a stream of words; pages must come whole within one.

    Reading order needs windows that streams lack, so each batch is handled as a table.
    """

    def each(batch: DataFrame, number: int) -> None:
        write(D.suppress(D.detect(D.on_pages(batch, pages))), number)

    return words.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: What happens to a page: kind ``seed`` for a box that was found on it, or an edit (policy.EDIT_KINDS).
EVENT = (
    "doc_id long, page_no int, box_id string, seq long, kind string, handle string, dx double, dy double, label string, style string, enabled boolean, "
    "x double, y double, w double, h double, source string, width double, height double"
)
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PAGE = ["doc_id", "page_no"]
_KINDS = {c: {"long": int, "int": int, "double": float, "string": str, "boolean": bool}[kind] for c, kind in (x.split() for x in EVENT.split(", "))}


class PageLog(StatefulProcessor):
    """What is known of a page: its first seeds and all edits.  Gives the whole log of pages that something happened to.

    A page is seeded once: seeds that come in a later batch are passed over.  Edits are kept in
    any order, as a late one may have to be applied before others; box and seq name an edit, so
    one that comes again is not kept twice.
    """

    def init(self, handle) -> None:
        self.kept = handle.getMapState("kept", "box_id string, seq long, kind string", EVENT)
        self.seeded = handle.getValueState("seeded", "yes boolean")

    def handleInputRows(self, key, rows, timerValues):
        new = pd.concat(list(rows))
        first = not self.seeded.exists()
        for values in new.itertuples(index=False, name=None):
            event = dict(zip(new.columns, values))
            if event["kind"] == "seed" and not first:
                continue
            seq = -1 if pd.isna(event["seq"]) else int(event["seq"])
            # Whole numbers of a batch with gaps come as floats, and gaps as NaN.
            row = tuple(None if v is None or v != v else _KINDS[c](v) for c, v in event.items())
            self.kept.updateValue((event["box_id"], seq, event["kind"]), row)
        if first and (new["kind"] == "seed").any():
            self.seeded.update((True,))
        kept = list(self.kept.values())
        if kept:
            yield pd.DataFrame(kept, columns=new.columns)

    def close(self) -> None:
        pass


def folded(log: DataFrame) -> DataFrame:
    """The boxes of the pages of a log of events, by the same fold as for tables."""
    boxes = log.where("kind = 'seed'").select(*_PAGE, "box_id", *"xywh", "label", "source", "style", "enabled")
    edits = log.where("kind <> 'seed'").drop("source", "width", "height")
    sizes = log.groupBy(*_PAGE).agg(F.max("width").alias("width"), F.max("height").alias("height"))
    return policy.apply_edits(boxes, edits, sizes)


def edit_log(events: DataFrame, save: Callable[[DataFrame, DataFrame, int], None], checkpoint: str):
    """Folds a stream of events (EVENT) into boxes, keeping each page's log as state in the checkpoint.

    After every batch save(boxes, pages, number) gets the boxes of the pages that changed, and
    those pages, whose boxes of earlier batches they replace; other pages are not touched.
    Whatever the split into batches, and after a restart, a page ends with the boxes that one
    fold over all its events gives.  Needs the RocksDB state store, which is set here if unset.
    """
    spark = events.sparkSession
    key = "spark.sql.streaming.stateStore.providerClass"
    if not spark.conf.get(key, "").endswith("RocksDBStateStoreProvider"):
        spark.conf.set(key, ROCKS)
    logs = events.groupBy(*_PAGE).transformWithStateInPandas(PageLog(), StructType.fromDDL(EVENT), "Update", "None")

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        save(folded(batch), batch.select(*_PAGE).distinct(), number)
        batch.unpersist()

    return logs.writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def edit_stream(edits: DataFrame, load: Callable[[], tuple[DataFrame, DataFrame]], save: Callable[[DataFrame, int], None], checkpoint: str):
    """Folds each micro-batch of edits into the boxes; load() gives boxes and pages, save() keeps the new boxes.

    For boxes that a table holds; ``edit_log`` keeps them as state and touches only pages that change.
    """

    def each(batch: DataFrame, number: int) -> None:
        boxes, pages = load()
        save(policy.apply_edits(boxes, batch, pages), number)

    return edits.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
