"""Problem 5: how often every distinct term occurs, in how many records, and whether it is too rare or too common.

Recursive radix spilling: each map task counts its own records' terms with DuckDB and writes (hash, scope, term, counts) to
the shared folder. Their number and size set how many leading hash bits part them: the shuffle then lays each partition on disk,
by arithmetic alone. A task takes one partition; one that is larger than a leaf is split by further bits into files of the shared
folder (on any file system that Arrow knows), again and again until each part is a leaf or no bits are left, and each leaf is
aggregated by DuckDB, which has a memory limit and spills by itself where the shared folder is a path of files. A term's rows are
at most one for each flush of a map task, so a term that fills a third of the collection is no heavier than another.

Defined results: null texts and null token lists are no records; an empty text or list is a record without terms; null
elements of a list are no terms; a repeated record id counts once (its first row by the order column).
"""

from __future__ import annotations

import math
import os
import shutil
import uuid
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tavuflow.session import bounded, materialize, shared_dir

#: Hash bits, those that part the shuffle at most, and further bits of each split.
HASH_BITS, FIRST_BITS, MORE_BITS = 31, 16, 4
#: Rows and bytes of partial counts in a leaf, about.
LEAF_ROWS, LEAF_BYTES = 1_000_000, 32 << 20
#: DuckDB's memory in a Python worker; beyond it, it spills.
MEMORY = "160MB"
#: Terms a map task holds before it flushes its partial counts.
FLUSH_TERMS = 400_000
#: Elements handed to DuckDB at once.
SLICE_TERMS = 500_000

# Fixed value: a run of characters other than Unicode white space.
SPACE_PATTERN = r"\p{IsWhite_Space}+"

_PARTIAL = T.StructType(
    [T.StructField("h", T.IntegerType()), T.StructField("scope", T.StringType()), T.StructField("term", T.StringType()), T.StructField("n", T.LongType()), T.StructField("records", T.LongType())]
)
_TOTAL = T.StructType(_PARTIAL.fields[1:])
_ARROW = pa.schema([("h", pa.int32()), ("scope", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("records", pa.int64())])


def _connect(spill: str | None):
    import duckdb

    con = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "preserve_insertion_order": False})
    if spill:
        os.makedirs(spill, exist_ok=True)
        con.execute(f"set temp_directory = '{spill}'").fetchall()
    else:
        con.execute("set temp_directory = ''").fetchall()
    return con


def split_terms(text: Column) -> Column:
    """The runs of non-space of a text, as an array without empty elements."""
    return F.filter(F.split(text, SPACE_PATTERN), lambda x: x != "")


def first_rows(df: DataFrame, key: str, order: list[Column], value: str) -> DataFrame:
    """One row for each key, the first by order among those whose value is not null (a null key keeps all its rows).

    Repeated keys are the exception: only keys are shuffled to find them, and only the rows of repeated keys are ranked.
    """
    known = df.filter(F.col(value).isNotNull())
    twice = bounded(materialize(known.groupBy(key).count().filter(f"count > 1 and {key} is not null").select(key), "repeated"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    ranked = known.join(twice, key, "left_semi").withColumn("_rn", rank).filter("_rn = 1").drop("_rn")
    return known.join(twice, key, "left_anti").unionByName(ranked)


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of each slice of records, merged in the task and flushed when they are many; and, under the term null, the number
    of records of each scope."""
    con = _connect(None)
    con.execute("create table held (scope varchar, term varchar, n bigint, records bigint)").fetchall()
    query = """
        select cast(hash(term) >> 32 as bigint) & 2147483647 as h, scope, term, sum(n)::bigint as n, sum(records)::bigint as records
        from held group by scope, term"""

    def flush() -> Iterator[pa.RecordBatch]:
        out = con.sql(query).to_arrow_table()
        con.execute("truncate held").fetchall()
        out = out.set_column(0, "h", out.column(0).cast(pa.int32()))
        yield from out.combine_chunks().to_batches(max_chunksize=100_000)

    sizes_: dict[str, int] = {}
    for batch in batches:
        for own in pc.value_counts(batch.column("scope")).to_pylist():
            sizes_[own["values"]] = sizes_.get(own["values"], 0) + own["counts"]
        terms = batch.column("terms")
        sizes = terms.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + SLICE_TERMS, side="right")))
            part = batch.slice(start, stop - start)
            lists = part.column("terms")
            rec = np.repeat(np.arange(len(lists), dtype=np.int32), sizes[start:stop])
            flat = lists.flatten()
            scope = part.column("scope").dictionary_encode().take(pa.array(rec))
            slice_ = pa.table({"scope": scope.cast(pa.string()), "term": flat, "rec": rec})
            con.register("slice_", slice_)
            con.execute(
                """insert into held select scope, term, sum(c)::bigint, count(*) from
                   (select scope, term, rec, count(*) as c from slice_ where term is not null group by all) group by scope, term"""
            ).fetchall()
            con.unregister("slice_")
            start = stop
            if con.execute("select count(*) from held").fetchall()[0][0] > FLUSH_TERMS:
                yield from flush()
    yield from flush()
    con.close()
    yield pa.RecordBatch.from_pylist([{"h": 0, "scope": k, "term": None, "n": 0, "records": v} for k, v in sizes_.items()], _ARROW)


def _aggregate(batches: Iterator[pa.RecordBatch], local: str | None) -> Iterator[pa.RecordBatch]:
    """The sums of each scope and term, by DuckDB out of core."""
    spill = f"{local}/{uuid.uuid4().hex}" if local else None  # files of two tasks must not meet
    con = _connect(spill)
    try:
        con.register("parts", pa.RecordBatchReader.from_batches(_ARROW, batches))
        out = con.sql("select scope, term, sum(n)::bigint as n, sum(records)::bigint as records from parts group by scope, term")
        yield from out.to_arrow_reader(100_000)
    finally:
        con.close()
        if spill:
            shutil.rmtree(spill, ignore_errors=True)


def _spilled(uri: str):
    """The file system and path of a folder of this task."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1) if "://" in uri else f"file://{uri.removeprefix('file:')}")
    path = f"{path}/{uuid.uuid4().hex}"
    system.create_dir(path, recursive=True)
    return system, path


def totals(batches: Iterator[pa.RecordBatch], bits: int, uri: str, leaf_bytes: int) -> Iterator[pa.RecordBatch]:
    """The sums of a partition whose rows agree in so many leading hash bits: of a leaf at once, of a larger one part by part."""
    local = uri.removeprefix("file://").removeprefix("file:") if uri.startswith(("file:", "/")) else None
    if bits >= HASH_BITS:
        yield from _aggregate(batches, local)
        return
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size > leaf_bytes:
            break
    else:
        yield from _aggregate(iter(held), local)
        return
    more = min(MORE_BITS, HASH_BITS - bits)
    system, path = _spilled(uri)
    writers: dict[int, tuple] = {}
    try:
        while held:
            part = held.pop()
            bucket = part.column("h").to_numpy() >> (HASH_BITS - bits - more) & ((1 << more) - 1)
            for b in np.unique(bucket):
                if b not in writers:
                    sink = system.open_output_stream(f"{path}/{b}")
                    writers[b] = (sink, pa.ipc.new_stream(sink, _ARROW, options=pa.ipc.IpcWriteOptions(compression="zstd")))
                writers[b][1].write_batch(part.take(pa.array(np.flatnonzero(bucket == b))))
            if not held and (after := next(batches, None)) is not None:
                held.append(after)
        for sink, writer in writers.values():
            writer.close()
            sink.close()
        for b in sorted(writers):
            with system.open_input_stream(f"{path}/{b}") as source:
                yield from totals(iter(pa.ipc.open_stream(source)), bits + more, uri, leaf_bytes)
            system.delete_file(f"{path}/{b}")
    finally:
        system.delete_dir(path)


def term_frequencies(records: DataFrame, rare: int = 2, common: float = 0.1, leaf_rows: int = LEAF_ROWS, leaf_bytes: int = LEAF_BYTES) -> DataFrame:
    """(scope, term, n, records, scope_records, mark) of records (scope, terms array<string>), one row for each record.

    mark is rare (in at most so many records), else common (in at least this share of the scope's records), else null.
    """
    spark = records.sparkSession
    held = records.select("scope", "terms").filter("terms is not null")
    uri = f"{shared_dir(spark)}/tavuflow/spill"
    partial = materialize(held.mapInArrow(_partial, _PARTIAL), "terms")
    counts = partial.filter("term is not null")
    found = counts.agg(F.count("*").alias("rows"), F.sum(F.octet_length("term") + F.octet_length("scope") + 20).alias("bytes")).first()
    wanted = max(found["rows"] / leaf_rows, (found["bytes"] or 0) / leaf_bytes, int(spark.conf.get("spark.sql.shuffle.partitions")))
    bits = min(FIRST_BITS, math.ceil(math.log2(max(wanted, 1))))
    placed = counts.repartitionById(1 << bits, F.shiftright("h", HASH_BITS - bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from totals((b.select(_ARROW.names).cast(_ARROW) for b in batches), bits, uri, leaf_bytes)

    summed = placed.mapInArrow(run, _TOTAL)
    sizes = F.broadcast(partial.filter("term is null").groupBy("scope").agg(F.sum("records").alias("scope_records")))  # one row for each scope
    mark = F.when(F.col("records") <= rare, "rare").when(F.col("records") >= F.col("scope_records") * F.lit(Decimal(str(common))), "common")
    return summed.join(sizes, "scope").withColumn("mark", mark)
