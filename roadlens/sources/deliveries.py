"""A sink that hands rows to a receiver, each once: a Spark data source with a journal of what was delivered."""

from __future__ import annotations

import hashlib
import importlib
import json
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from roadlens.session import ship

FORMAT = "roadlens_deliveries"
# Attempts for a row, and the pause after one that failed.
ATTEMPTS, PAUSE = 2, 0.8


def attempted(send: Callable[[dict], int], row: dict, attempts: int = ATTEMPTS, pause: float = PAUSE, errors: tuple = (OSError,)) -> tuple[int, int]:
    """(status, attempts) of a row: again after a network error (status 0) and after a status of 500 or more."""
    status, n = 0, 0
    for n in range(1, attempts + 1):  # noqa: B007
        try:
            status = int(send(row))
        except errors:
            status = 0
        if 0 < status < 500:
            break
        time.sleep(pause)
    return status, n


class Journal:
    """Marks of delivered ids below a folder, one small file each, in any store that Arrow opens by its address."""

    def __init__(self, url: str):
        self.store, self.folder = fs.FileSystem.from_uri(url)

    def _place(self, name: str) -> str:
        digest = hashlib.sha256(name.encode()).hexdigest()
        return f"{self.folder}/sent/{digest[:2]}/{digest}"

    def has(self, name: str) -> bool:
        return self.store.get_file_info(self._place(name)).type != fs.FileType.NotFound

    def add(self, name: str, status: int) -> None:
        self.put(self._place(name), {"id": name, "status": status})

    def put(self, place: str, value: dict) -> None:
        self.store.create_dir(place.rsplit("/", 1)[0], recursive=True)
        with self.store.open_output_stream(place) as out:
            out.write(json.dumps(value).encode())


@dataclass
class Delivered(WriterCommitMessage):
    """Counts of one task: rows sent now, rows that were known, rows that failed."""

    sent: int
    known: int
    failed: int


class _Writer(DataSourceWriter):
    def __init__(self, options: dict[str, str], run: str):
        self.receiver, self.journal, self.run = options["receiver"], options["journal"], run
        self.key = options.get("key", "decision_id")
        self.attempts, self.pause = int(options.get("attempts", ATTEMPTS)), float(options.get("pause", PAUSE))

    def write(self, rows: Iterator[Row]) -> Delivered:
        module, _, name = self.receiver.partition(":")
        send, journal, failed, done = getattr(importlib.import_module(module), name), Journal(self.journal), [], Delivered(0, 0, 0)
        for row in rows:
            key = str(row[self.key])
            if journal.has(key):
                done.known += 1
                continue
            status, n = attempted(send, row.asDict(recursive=True), self.attempts, self.pause)
            if 200 <= status < 300:
                journal.add(key, status)
                done.sent += 1
            else:
                failed.append({"id": key, "status": status, "attempts": n})
        done.failed = len(failed)
        if failed:
            journal.put(f"{journal.folder}/failed/{self.run}-{uuid.uuid4().hex}", {"rows": failed})
        return done

    def commit(self, messages: list[Delivered | None]) -> None:
        tasks = [m for m in messages if m is not None]
        journal = Journal(self.journal)
        journal.put(f"{journal.folder}/runs/{self.run}", {k: sum(getattr(m, k) for m in tasks) for k in ("sent", "known", "failed")})

    def abort(self, messages: list[Delivered | None]) -> None:
        """What was delivered stays in the journal: a later run goes on from there."""


class DeliverySource(DataSource):
    """Write-only.  Options: ``receiver`` (module:function, takes a row as dict, returns a status), ``journal`` (address
    of a folder that executors share), ``key``, ``attempts``, ``pause``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(dict(self.options), uuid.uuid4().hex)


def deliver_once(rows: DataFrame, receiver: str, journal: str, key: str = "decision_id", **options: str | int | float) -> None:
    """Hand each row to the receiver once, by ``key``; of rows with one key one is sent, and a null key is the row's digest.

    A row whose key the journal has is passed over, so a task that is lost midway, or a run after an aborted one,
    goes on behind the last row that was marked.  Between a receiver's answer and its mark lies one file: a
    worker that dies just there sends that row again, with the same key, by which the receiver tells.  Rows are
    tried twice on network errors and statuses of 500 or more; those that still fail are listed below
    ``journal/failed``, stay without a mark, and don't fail the run.  ``journal/runs`` has the counts of each run.
    """
    spark = rows.sparkSession
    ship(spark)
    spark.dataSource.register(DeliverySource)
    whole = F.sha2(F.to_json(F.struct(*rows.columns)), 256)
    one = rows.withColumn(key, F.coalesce(F.col(key).cast("string"), whole)).dropDuplicates([key])
    one.write.format(FORMAT).mode("append").options(receiver=receiver, journal=journal, key=key, **options).save()
