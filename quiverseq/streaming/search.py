"""Query records as a stream: each micro-batch is one search over the same database."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from quiverseq.plans.search import Options, Search


def search_stream(queries: DataFrame, db: DataFrame, options: Options, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Starts a stream of (qno, description, residues) whose hits go to sink(hits, batch number).

    sink must consume the hits before it returns: what they are read from is discarded then. A repeated batch number (after a restart) means the same queries, so an idempotent sink gives each hit once.
    """

    def batch(rows: DataFrame, number: int) -> None:
        if not rows.isEmpty():
            search = Search(rows, db, options)
            try:
                sink(search.hits(), number)
            finally:
                search.close()

    return queries.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
