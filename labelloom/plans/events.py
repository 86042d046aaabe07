"""Events of a run: handlers that are tables in, tables out, called in the order of their registration, and resumed where a run broke off."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: The state of a run: tables by name. A handler returns those that it made or changed.
State = dict[str, DataFrame]
Handler = Callable[[State, str], State]


class Run:
    """Handlers by event. What each one returns is written below `folder` before the next is called, and read back by it.

    A run over the same folder does not call again what was done: it takes the tables that were written. A handler counts as done once
    its last table and a mark are there, so one that broke off is called anew, with the state it had.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.handlers: dict[str, list[tuple[str, Handler]]] = defaultdict(list)
        self.called: list[str] = []
        self._fired = 0

    def on(self, event: str, name: str, handler: Handler) -> None:
        """Handlers of an event are told apart by name."""
        if any(name == other for other, _ in self.handlers[event]):
            raise ValueError(f"{event} has a handler {name} already")
        self.handlers[event].append((name, handler))

    def _done(self, path: str) -> list[str] | None:
        jvm = self.spark.sparkContext._jvm
        mark = jvm.org.apache.hadoop.fs.Path(f"{path}/done")
        if not mark.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(mark):
            return None
        return [r.table for r in self.spark.read.schema("table string").json(f"{path}/done").collect()]

    def fire(self, event: str, state: State) -> State:
        """The state after all handlers of an event. An event without handlers changes nothing; firing it again later is another step of the run."""
        state, step = dict(state), self._fired
        self._fired += 1
        for k, (name, handler) in enumerate(self.handlers[event]):
            path = f"{self.folder}/{step:06d}-{event}/{k:03d}-{name}"
            tables = self._done(path)
            if tables is None:
                self.called.append(f"{event}.{name}")
                try:
                    made = handler(dict(state), event)
                except Exception as wrong:
                    raise RuntimeError(f"handler {name} of {event}: {wrong}") from wrong
                for table, df in made.items():
                    df.write.mode("overwrite").parquet(f"{path}/{table}")
                tables = list(made)
                self.spark.createDataFrame([(t,) for t in tables], "table string").coalesce(1).write.mode("overwrite").json(f"{path}/done")
            state |= {t: self.spark.read.parquet(f"{path}/{t}") for t in tables}
        return state
