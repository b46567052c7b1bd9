"""Shared helpers of the training-data operators: scratch tables and native span search."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_RUN = uuid.uuid4().hex[:12]


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as a URI or path.

    It is what ``spark.checkpoint.dir`` names.  Only where that is unset and the session is local
    (tests) it is a folder below the warehouse.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"


def _run_folder(spark: SparkSession):
    """(file system, path) of this process's folder in the shared one."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/linkgraph-{_RUN}")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing else uses.

    It lasts as long as the driver: results may be read until then, and all of it is deleted when the
    driver's JVM ends (``drop_scratch`` does so earlier; a driver that is killed leaves it).
    """
    fs, folder = _run_folder(spark)
    if not fs.exists(folder):
        fs.mkdirs(folder)
        fs.deleteOnExit(folder)
    return f"{shared_dir(spark)}/linkgraph-{_RUN}/{name}-{uuid.uuid4().hex[:8]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as a table in the shared folder and read it again.

    Lost executors then cost a read and no recomputation, and later jobs on the result
    don't run the plan above it once more.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written.scratch = path
    return written


def release(df: DataFrame) -> None:
    """Delete the table that ``materialize`` returned as ``df``; for any other frame nothing."""
    if path := getattr(df, "__dict__", {}).get("scratch"):
        spark = df.sparkSession
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def drop_scratch(spark: SparkSession) -> None:
    """Delete what this process has materialized.  Results that still read it become invalid."""
    fs, folder = _run_folder(spark)
    fs.delete(folder, True)


def partitions_for(df: DataFrame, each: int) -> int:
    """One partition for each ``each`` bytes that Catalyst expects of the rows (for a table, of its
    files), and as many as shuffle partitions at least; also where it has no figure."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-size // each)) if size < 1 << 60 else least


_HELD: dict[str, Any] = {}
_OWNER = [""]


def owned_by(owner: str) -> None:
    """Forget what other operators' tasks have kept in this Python worker."""
    if _OWNER[0] != owner:
        _OWNER[0] = owner
        _HELD.clear()


def held(key: str, build: Callable[[], Any]) -> Any:
    """What ``build`` makes, kept in this Python worker until another key is asked for or another
    operator's task begins: workers outlive their stage, and tables shouldn't stay through the next."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = build()
    return _HELD[key]


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow whose tasks give freed memory back when they end."""

    owner = f"{run.__module__}.{run.__qualname__}"

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owned_by(owner)
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):
                pass  # not glibc

    return df.mapInArrow(tidy, schema)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have: ``name``, with underscores as needed."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_or_empty(name: str = "text") -> str:
    return f"coalesce({quoted(name)}, '')"


#: Values that a running sum walks one by one; code points of a piece that a long text is cut into.
RUN, PIECE = 256, 4096


#: The native operators write their expressions as SQL text: it is parsed at once, where building
#: thousands of Column objects takes the driver seconds.


def literal(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def quoted(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def let(value: str, name: str, use: str) -> str:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return f"get(transform(array({value}), {name} -> {use}), 0)"


def running(values: str, combine: str = "{} + {}") -> str:
    """array<int>, one longer than the array<int> ``values``: what ``combine`` makes of 0 and all values
    before each place, and of all.

    Appending to an array copies it, so runs of RUN values are walked on their own and joined then:
    the work is RUN for each value, however many there are.  Short arrays are one run.
    """
    begin = "named_struct('at', 0, 'out', cast(array() as array<int>))"
    walk = lambda what, x: f"aggregate({what}, {begin}, (acc, x) -> named_struct('at', {combine.format('acc.at', x)}, 'out', concat(acc.out, array(acc.at))))"
    whole = lambda walked: let(walked, "f", "concat(f.out, array(f.at))")
    places = f"sequence(k * {RUN}, least((k + 1) * {RUN}, size({values})) - 1)"
    runs = f"transform(sequence(0, cast((size({values}) - 1) div {RUN} as int)), k -> {walk(places, f'{values}[x]')})"
    shifted = f"flatten(zip_with(runs, f.out, (r, before) -> transform(r.out, y -> {combine.format('before', 'y')})))"
    long = let(runs, "runs", let(walk("runs", "x.at"), "f", f"concat({shifted}, array(f.at))"))
    return f"if(size({values}) <= {RUN}, {whole(walk(values, 'x'))}, {long})"


def pieces_of(text: str) -> str:
    """A text cut into pieces of PIECE code points, for ``cut_out``."""
    return f"if(length({text}) <= {PIECE}, array({text}), regexp_extract_all({text}, '(?s).{{1,{PIECE}}}', 0))"


def cut_out(pieces: str, start: str, end: str) -> str:
    """The code points ``start`` to ``end`` of a cut text.  Only the pieces they are in are read: a
    substring of the whole text would be counted from its beginning each time."""
    first, last = f"cast(({start}) div {PIECE} as int)", f"cast((({end}) - 1) div {PIECE} as int)"
    # slice copies what it is given, so it is left to the spans that need it
    two = f"if({last} = {first}, {pieces}[{first}], concat({pieces}[{first}], {pieces}[{last}]))"
    near = f"if({last} - {first} < 2, {two}, array_join(slice({pieces}, {first} + 1, {last} - {first} + 1), ''))"
    return f"if(({end}) > ({start}), substring({near}, ({start}) - {first} * {PIECE} + 1, ({end}) - ({start})), '')"


def find_spans(text: str, pattern: str, guard: str = "true") -> str:
    """All leftmost non-overlapping matches of a Java pattern, as array<struct<start,end,value>>, or null.

    Offsets count code points; ``end`` is exclusive.  The pattern may not match the empty
    string.  Matches and the pieces between them come from two passes of the same matcher
    (regexp_extract_all, split), so their lengths add up to the offsets.  ``guard`` is a cheap
    necessary condition; where it is false no pass runs, and without a match the second doesn't.
    """
    rx = literal(pattern)
    lengths = f"zip_with(ms, slice(split({text}, {rx}, -1), 1, size(ms)), (m, p) -> named_struct('p', length(p), 'm', length(m), 'value', m))"
    spans = "zip_with(xs, slice(es, 2, size(xs)), (s, e) -> named_struct('start', e - s.m, 'end', e, 'value', s.value))"
    placed = let("transform(xs, s -> s.p + s.m)", "ls", let(running("ls"), "es", spans))
    found = let(lengths, "xs", placed)
    return f"if({guard}, {let(f'regexp_extract_all({text}, {rx}, 0)', 'ms', f'if(size(ms) > 0, {found}, null)')}, null)"


def joined_spans(spans: str) -> str:
    """kind:start:end of array<struct<start,rank,kind,end>>, by start and then rank, comma-joined."""
    return f"array_join(transform(array_sort({spans}), s -> concat_ws(':', s.kind, cast(s.start as string), cast(s.end as string))), ',')"
