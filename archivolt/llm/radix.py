"""Out-of-core aggregation by recursive radix partitioning, for use inside a task.

A task gets its rows as Arrow batches. They are held in memory up to a limit;
beyond it they are split to files by four bits of a 64-bit hash, and a file
still beyond the limit is split again by the next four bits. Each part is then
aggregated by DuckDB. What a key needs is therefore bounded by the rows of its
own hash, not by the task.
"""

from __future__ import annotations

import shutil
import uuid
from collections.abc import Iterator
from pathlib import Path
from urllib.parse import urlparse

import pyarrow as pa
import pyarrow.compute as pc

BITS = 4
LIMIT_BYTES = 64 << 20


def local_path(uri: str) -> Path:
    """The shared folder as a path; it has to be mounted on the executors."""
    parsed = urlparse(uri)
    if parsed.scheme not in ("", "file"):
        raise ValueError(f"radix spilling needs a mounted shared folder, not {uri}")
    return Path(parsed.path)


def _aggregate(table: pa.Table, sql: str, spill: Path, limit: int) -> pa.Table:
    import duckdb

    con = duckdb.connect(config={"threads": 1, "memory_limit": f"{max(256, 4 * limit >> 20)}MB", "temp_directory": str(spill / "duckdb")})
    try:
        con.register("part", table)
        got = con.sql(sql).to_arrow_table()
    finally:
        con.close()
    return got


def _split(batches: Iterator[pa.RecordBatch], depth: int, at: Path) -> list[Path]:
    at.mkdir(parents=True, exist_ok=True)
    writers: dict[int, pa.ipc.RecordBatchFileWriter] = {}
    paths: dict[int, Path] = {}
    for batch in batches:
        bits = pc.bit_wise_and(pc.shift_right(batch.column("h"), BITS * depth), (1 << BITS) - 1)
        for v in pc.unique(bits).to_pylist():
            if v not in writers:
                paths[v] = at / f"{v}.arrow"
                writers[v] = pa.ipc.new_file(str(paths[v]), batch.schema)
            writers[v].write_batch(batch.filter(pc.equal(bits, v)))
    for w in writers.values():
        w.close()
    return list(paths.values())


def _read(path: Path) -> Iterator[pa.RecordBatch]:
    with pa.memory_map(str(path)) as source:
        reader = pa.ipc.open_file(source)
        for i in range(reader.num_record_batches):
            yield reader.get_batch(i)


def _parts(batches: Iterator[pa.RecordBatch], depth: int, at: Path, limit: int) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size > limit and depth * BITS < 60:

            def rest(held=held, batches=batches):
                yield from held
                yield from batches

            for path in _split(rest(), depth, at / f"d{depth}"):
                # the hash bits of one file don't split again where it holds one hash only
                first = {h for b in _read(path) for h in pc.unique(b.column("h")).to_pylist()[:2]}
                yield from _parts(_read(path), 15 if len(first) == 1 else depth + 1, at / f"d{depth}-{path.stem}", limit)
                path.unlink()
            return
    if held:
        yield pa.Table.from_batches(held)


def aggregator(sql: str, shared: str, limit: int = LIMIT_BYTES):
    """A mapInArrow function that runs ``sql`` over the view ``part`` for each radix part of its rows.

    The rows need a bigint column ``h``, the hash of the grouping key; ``sql``
    must group by that key, so parts are independent.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = local_path(shared) / f"radix-{uuid.uuid4().hex}"
        at.mkdir(parents=True, exist_ok=True)
        try:
            for part in _parts((b for b in batches if b.num_rows), 0, at, limit):
                yield from _aggregate(part, sql, at, limit).to_batches()
        finally:
            shutil.rmtree(at, ignore_errors=True)

    return run
