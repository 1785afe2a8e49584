"""A log of commits with checkpoints, on any file system that can create a file only if it is absent.

Layout below a folder::

    commits/<block>/<number>.parquet   the rows of one commit
    checkpoints/<number>/              the rows of all commits up to that number

Numbers have no gaps: a writer takes the next one, and if another writer was first,
the one after that. So two writers never overwrite each other, and what a reader
sees is the newest checkpoint and the commits after it, whatever the log's age.
Every so many commits the writer that finds it due writes a checkpoint. What two
checkpoints have replaced is deleted once it is a day old, so that frames that were
read before can still be used.
"""

from __future__ import annotations

import io
import time
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tablekeep.sources import files
from tablekeep.sources.listing import Stores
from tablekeep.sources.small import plain_rows, small_frame

EVERY = 24  # commits from one checkpoint to the next
BLOCK = 1000  # commits in a folder
COMMITS_TASK = 10_000  # commits that a task writes
COMMITS_READ = 5000  # and that one reads
COMMIT_BYTES = 200  # of a commit's row in a checkpoint, about
PLACE = "__place"  # the column of a row's place among those appended together
KEPT_SECONDS = 86400
CHECKPOINT_FILE_BYTES = 128 << 20

# the newest commit and checkpoint this process knows of, by folder; only a hint
_newest: dict[str, tuple[int, int]] = {}


class CommitLog:
    """Rows of one schema, appended commit by commit."""

    def __init__(self, spark: SparkSession, folder: str, ddl: str, every: int = EVERY):
        self.spark, self.folder, self.ddl, self.every = spark, folder.rstrip("/"), ddl, every
        self.schema = T.StructType.fromDDL(ddl)

    def append(self, rows: Iterable[dict | tuple]) -> int:
        """Add rows as one commit and return its number. Without rows nothing is written."""
        rows = plain_rows(rows, self.schema.names)
        last, checkpoint = _newest.get(self.folder) or self._found()
        if not rows:
            return last
        buffer = io.BytesIO()
        pq.write_table(pa.Table.from_pylist(rows, schema=to_arrow_schema(self.schema)), buffer)
        number = last + 1
        while not files.write_new(self.spark, self._commit(number), buffer.getvalue()):
            number += 1
        known = _newest.get(self.folder, (0, 0))
        _newest[self.folder] = max(number, known[0]), max(checkpoint, known[1])
        if number - _newest[self.folder][1] >= self.every:
            self.checkpoint(number)
        return number

    def append_each(self, rows: DataFrame) -> int:
        """Add every row of a frame as a commit of its own and return the newest number.

        Tasks write the commits at the same time, each at the number that its row's place in the frame
        gives it, or after all of them if another writer has taken that. A commit says whose it is, so a
        task that is run again finds what it has written. When all are there, a checkpoint takes
        the place of those that single appends would have written on the way. Stores that
        tasks cannot create a file in only if it is absent get the rows one by one.
        """
        if files.local_path(self.spark, self.folder) is None:
            for row in rows.toLocalIterator():
                self.append([row.asDict()])
            return self.append([])
        token, names = uuid.uuid4().hex, self.schema.names
        staged = f"{self.folder}/_appending-{token}"
        kinds = [
            (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in self.schema.fields
        ]
        rows.select(*kinds, F.monotonically_increasing_id().alias(PLACE)).write.parquet(staged)
        kept = self.spark.read.parquet(staged)
        counts = kept.groupBy(F.shiftright(PLACE, 33).alias("part")).count().orderBy("part").collect()
        starts, first = {}, self._found()[0] + 1
        after = first
        for part, count in counts:
            starts[part], after = after, after + count
        kind, folder, block = to_arrow_schema(self.schema), self.folder, BLOCK

        def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            stores, newest = Stores(), 0
            for batch in batches:
                places = batch.column(batch.num_columns - 1).to_pylist()
                table = pa.Table.from_batches([batch]).select(names).cast(kind)
                for i, place in enumerate(places):
                    number = starts[place >> 33] + (place & ((1 << 33) - 1))
                    own, other = f"{token}-{number}".encode(), after
                    buffer = io.BytesIO()
                    row = table.slice(i, 1).replace_schema_metadata({b"commit": own})
                    pq.write_table(row, buffer, compression="none", use_dictionary=False, write_statistics=False)
                    while True:
                        path = f"{folder}/commits/{number // block:09d}/{number:012d}.parquet"
                        system, plain = stores.of(path)
                        if system.create_new(plain, buffer.getvalue()):
                            break
                        with system.read(plain) as file:
                            if (pq.read_schema(file).metadata or {}).get(b"commit") == own:
                                break
                        number, other = other, other + 1
                    newest = max(newest, number)
            yield pa.record_batch([pa.array([newest], pa.int64())], names=["newest"])

        parts = max(self.spark.sparkContext.defaultParallelism, (after - first) // COMMITS_TASK)
        done = kept.repartition(parts).mapInArrow(written, "newest long")
        last = max(done.agg(F.max("newest")).first()[0] or 0, first - 1)
        files.delete(self.spark, staged)
        checkpoint = max(self._checkpoints(), default=0)
        known = _newest.get(self.folder, (0, 0))
        _newest[self.folder] = max(last, known[0]), max(checkpoint, known[1])
        if last - checkpoint >= self.every:
            self.checkpoint(last - (last - checkpoint) % self.every)
        return last

    def read(self, until: int | None = None) -> DataFrame:
        """Every row of every commit: the newest checkpoint and the commits after it.

        A few commits come by way of the driver, as opening each as a table would be a job; many are
        opened by tasks.
        """
        checkpoint, commits = self._state(until)
        after = self._rows(commits)
        if not checkpoint:
            return after
        return self.spark.read.schema(self.schema).parquet(self._checkpoint(checkpoint)).unionAll(after)

    def _rows(self, commits: list[int]) -> DataFrame:
        if not commits:
            return small_frame(self.spark, [], self.ddl)
        kind = to_arrow_schema(self.schema)
        if len(commits) > BLOCK:
            return self._task_rows(commits, kind)
        parts = [io.BytesIO(files.read_bytes(self.spark, self._commit(n))) for n in commits]
        rows = pa.concat_tables([pq.read_table(part, schema=kind) for part in parts])
        return self.spark.createDataFrame(rows, self.schema)

    def _task_rows(self, commits: list[int], kind: pa.Schema) -> DataFrame:
        ends = [commits[min(i + COMMITS_READ, len(commits)) - 1] for i in range(0, len(commits), COMMITS_READ)]
        spans = [(commits[i * COMMITS_READ], end) for i, end in enumerate(ends)]
        folder, block = self.folder, BLOCK

        def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            stores = Stores()
            for batch in batches:
                for first, last in zip(*[c.to_pylist() for c in batch.columns]):
                    tables = []
                    for number in range(first, last + 1):
                        system, plain = stores.of(f"{folder}/commits/{number // block:09d}/{number:012d}.parquet")
                        if system.one(plain) is not None:  # another writer's may not be there yet
                            with system.read(plain) as file:
                                table = pq.ParquetFile(file).read(use_threads=False)
                            tables.append(table.replace_schema_metadata(None).cast(kind))
                    yield from pa.concat_tables(tables).combine_chunks().to_batches()

        frame = self.spark.createDataFrame(spans, "first long, last long")
        return frame.repartition(len(spans)).mapInArrow(opened, self.schema)

    def checkpoint(self, number: int) -> None:
        """Write the rows of all commits up to a number as one table.

        Not while there are gaps below it: those who took these numbers are still at it.
        """
        target = self._checkpoint(number)
        if files.exists(self.spark, target):
            return
        before = self._checkpoints(number)
        commits = self._commits(max(before, default=0), number)
        if len(commits) != number - max(before, default=0):
            return
        size = files.size_bytes(self.spark, self._checkpoint(before[-1])) if before else 0
        hidden = f"{self.folder}/checkpoints/_{uuid.uuid4().hex}"
        rows, wide = self.read(number), 1 + (size + len(commits) * COMMIT_BYTES) // CHECKPOINT_FILE_BYTES
        rows = rows.repartition(wide) if len(commits) > BLOCK else rows.coalesce(wide)
        rows.write.parquet(hidden)
        try:
            files.rename(self.spark, hidden, target)
        except IOError:  # another writer has made the same one
            files.delete(self.spark, hidden)
        known = _newest.get(self.folder, (0, 0))
        _newest[self.folder] = max(number, known[0]), max(number, known[1])
        if len(before) > 1:
            self._vacuum(before[:-1])

    def _vacuum(self, old: list[int]) -> None:
        """Delete checkpoints that have two newer ones, and the commits in them, by age."""
        limit = (time.time() - KEPT_SECONDS) * 1000
        for number in old:
            path = self._checkpoint(number)
            if files.modified_millis(self.spark, path) > limit:
                return
            for commit in self._commits(0, number):
                files.delete(self.spark, self._commit(commit))
            files.delete(self.spark, path)

    def _commit(self, number: int) -> str:
        return f"{self.folder}/commits/{number // BLOCK:09d}/{number:012d}.parquet"

    def _checkpoint(self, number: int) -> str:
        return f"{self.folder}/checkpoints/{number:012d}"

    def _checkpoints(self, until: int | None = None) -> list[int]:
        found = [int(n) for n in files.children(self.spark, f"{self.folder}/checkpoints")]
        return [n for n in found if until is None or n <= until]

    def _commits(self, after: int, until: int | None = None) -> list[int]:
        """The numbers of commits after one, from the folders that can hold them."""
        found = []
        for block in files.children(self.spark, f"{self.folder}/commits"):
            if int(block) >= (after + 1) // BLOCK:
                names = files.children(self.spark, f"{self.folder}/commits/{block}")
                found += [int(n.split(".")[0]) for n in names]
        return sorted(n for n in found if n > after and (until is None or n <= until))

    def _state(self, until: int | None = None) -> tuple[int, list[int]]:
        """The newest checkpoint, 0 if there is none, and the commits after it."""
        checkpoint = max(self._checkpoints(until), default=0)
        return checkpoint, self._commits(checkpoint, until)

    def paths(self) -> list[str]:
        """What a reader opens."""
        checkpoint, commits = self._state()
        tables = [self._checkpoint(checkpoint)] if checkpoint else []
        return tables + [self._commit(n) for n in commits]

    def _found(self) -> tuple[int, int]:
        checkpoint = max(self._checkpoints(), default=0)
        last = checkpoint
        for number in self._commits(checkpoint):
            if number > last + 1:
                break  # a gap of writers that are at it, or died
            last = number
        return last, checkpoint
