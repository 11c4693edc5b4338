"""Shared parts of the text operators: the shared folder, units of text, routing and byte-level text kernels.

Four ideas carry the operators of this subpackage:

* **Shared folder.** Everything that one job hands to the next goes to the folder named by
  ``spark.checkpoint.dir`` (a store that the driver and all executors see), never to a
  machine-local folder. Lost executors can therefore be replaced at any time.
* **Units.** Operators that go through the texts several times first pack them into units of a few MB: a row
  of the shared folder each, so that every later pass sees the same units, however it is planned.
* **Routing** (``ask``). Units ask hash shards about their distinct keys, shards merge what all units say and answer.
  A key that a third of all documents hold is one entry per unit, and no text is shuffled. Shards have a
  bounded share of the input; where there are more than ``FAN`` of them, messages go through relays, so that neither their
  number nor what a task holds grows with the square of the input.
* **Byte kernels.** Words, windows and hashes are computed with numpy on Arrow's own buffers.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 19  # text bytes that one numpy kernel call works on (a longer text is one call)
BATCH_BYTES = 1 << 20  # of an Arrow batch between the JVM and Python
UNIT_BYTES = 1 << 22  # text bytes of a unit (a longer text is a unit of its own)
SHARD_BYTES = 1 << 22  # text bytes for each shard
FAN = 4096  # shards that a unit sends to directly, and bundles of units that a relay works for
BUCKETS = 4096  # folders that answers are written to, at most
BITS = 62  # of a hash that is a key of the routing
LAST_ID = np.iinfo(np.int64).max  # a null doc_id sorts after all others


_libc = ctypes.CDLL(None)

# ---------------------------------------------------------------- shared folder


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a local one of our own only where that is unset and Spark is one process (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        root = f"/tmp/checkpoints/{spark.sparkContext.applicationId}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


made: list[str] = []  # paths handed out by scratch, for callers that clear up


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    made.append(f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}")
    return made[-1]


def drop_path(spark: SparkSession, *paths: str) -> None:
    """Remove finished intermediate tables."""
    jvm = spark._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def drop_told(spark: SparkSession, *told: str) -> None:
    """Remove answers that no later pass reads."""
    drop_path(spark, *(path.rpartition("?")[0] for path in told))


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def drop(*kept: DataFrame) -> None:
    """Remove tables that keep wrote and that no later job reads."""
    for df in kept:
        drop_path(df.sparkSession, df.kept_at)


def keep_only(work: Callable[[], DataFrame], name: str) -> DataFrame:
    """The result of work, kept; all else that work left in the shared folder is removed."""
    before = len(made)
    out = keep(work(), name)
    drop_path(out.sparkSession, *(p for p in made[before:] if p != out.kept_at))
    del made[before:]
    return out


def filesystem(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri)


def write_arrays(path: str, name: str, shard: int, arrays: dict[str, np.ndarray]) -> None:
    """One file for each array of a shard. A repeated task writes the same bytes again, whole or not at all."""
    fs, root = filesystem(path)
    fs.create_dir(root, recursive=True)
    for k, values in arrays.items():
        part = f"{root}/.{name}-{k}-{shard}-{uuid.uuid4().hex}"
        with fs.open_output_stream(part, compression=None) as out:
            out.write(np.ascontiguousarray(values))
        fs.move(part, f"{root}/{name}-{k}-{shard}")


def mapped(path: str, name: str, shard: int, kinds: dict[str, str]) -> dict[str, np.ndarray]:
    """A shard's arrays as read-only memory maps (out of a remote store, as one shard's bytes in memory)."""
    fs, root = filesystem(path)
    out = {}
    for k, kind in kinds.items():
        file = f"{root}/{name}-{k}-{shard}"
        if not fs.get_file_info(file).size:
            out[k] = np.empty(0, kind)
        elif isinstance(fs, pyarrow.fs.LocalFileSystem):
            out[k] = np.memmap(file, kind, "r")
        else:
            with fs.open_input_stream(file, compression=None) as raw:
                out[k] = np.frombuffer(raw.readall(), kind)
    return out


def columnwise(spark: SparkSession) -> None:
    """Arrow batches of this session's Python functions are small: what a task holds follows from BATCH_BYTES, not from the rows' lengths."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def plain(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with its columns renamed to c0, c1, ..., so that none clashes with those an operator makes, and the new name of each."""
    names = {n: f"c{i}" for i, n in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


# ---------------------------------------------------------------- rows of files


def row_key(docs: DataFrame) -> DataFrame:
    """docs with ``_file`` and ``_row``, which tell its rows apart and are the same in every scan (docs is written first if it is no plain scan of Parquet)."""
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:
        docs = keep(docs, "docs")
    return docs.withColumns({"_file": F.xxhash64("_metadata.file_path"), "_row": F.col("_metadata.row_index")})


def with_split(docs: DataFrame) -> DataFrame:
    """docs with ``_split`` (long), the file of each row and the run of rows that it stands in, and the row_key.

    It follows from the row's place in its file alone, so scans that are planned later, with other executors or
    split sizes, agree on it. Runs have as many rows as a task of the present plan has on average.
    It is a routing key only: results never depend on how rows are dealt to splits.
    """
    columnwise(docs.sparkSession)
    docs = row_key(docs)
    rows, tasks = docs.groupBy(F.spark_partition_id()).count().agg(F.sum("count"), F.count(F.lit(1))).first()
    run = max(1, -(-(rows or 0) // max(1, tasks)))
    return docs.withColumn("_split", F.xxhash64("_file", F.floor(F.col("_row") / run)))


def _row_groups(size: int) -> dict:
    """Options of a Parquet writer whose rows may be large."""
    return {"parquet.block.size": size, "parquet.page.size.row.check.min": 4, "parquet.block.size.row.check.min": 4, "parquet.enable.dictionary": "false"}


def deliver(answers: DataFrame, name: str, known: DataFrame, by: str = "_split") -> str:
    """Write answers so that a task can read those with one value of the column ``by`` (long).

    Each value that known has gets a row of nulls too, which tells one without answers from an unknown one. The table has
    at most BUCKETS folders, and files are sorted, so that a reader skips what others asked for.
    """
    spark = answers.sparkSession
    path = scratch(spark, name)
    known = known.select(by).distinct()
    buckets = max(1, min(BUCKETS, -(-known.count() // 4)))
    rows = answers.unionByName(known, allowMissingColumns=True).withColumn("_bucket", F.pmod(F.col(by).bitwiseXOR(F.shiftright(by, 33)), F.lit(buckets)))
    rows = rows.repartition(buckets, "_bucket").sortWithinPartitions("_bucket", by)
    rows.write.options(**_row_groups(1 << 20)).partitionBy("_bucket").parquet(path)
    return f"{path}?{buckets}"


def delivered(told: str, value: int, columns: list[str], by: str = "_split") -> pa.Table | None:
    """On an executor: the answers for one value, None if there are none. The first column of an answer is never null."""
    path, _, buckets = told.rpartition("?")
    fs, root = filesystem(path)
    folder = f"{root}/_bucket={(value ^ value >> 33) % int(buckets)}"  # units of different tasks differ in their upper bits
    files = [] if fs.get_file_info(folder).type == pyarrow.fs.FileType.NotFound else [f.path for f in fs.get_file_info(pyarrow.fs.FileSelector(folder)) if f.path.endswith(".parquet")]
    got = [t for f in sorted(files) if (t := pq.read_table(f, columns=[by, *columns], filesystem=fs, partitioning=None, filters=[(by, "=", value)])).num_rows]
    if not got:
        raise ValueError(f"{path} doesn't know {value}: rows have moved since it was written")
    found = pa.concat_tables(got).drop_columns([by])
    found = found.filter(pc.is_valid(found.column(columns[0])))
    return found if found.num_rows else None


def by_split(batches: Iterator[pa.RecordBatch], text: str | None = "text") -> Iterator[tuple[int | None, pa.RecordBatch]]:
    """Batches cut so that each has rows of one split and about SLICE_BYTES of text (a longer row comes alone)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index("_split")
        split = batch.column(at).to_pylist() if at >= 0 else [None] * batch.num_rows
        size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_pylist() if text else [0] * batch.num_rows
        start = total = 0
        for i in range(batch.num_rows):
            if i > start and (split[i] != split[start] or total + size[i] > SLICE_BYTES):
                yield split[start], batch.slice(start, i - start)
                start, total = i, 0
            total += size[i]
        yield split[start], batch.slice(start)
    release()


# ---------------------------------------------------------------- units


def units(docs: DataFrame, name: str, *longs: str) -> DataFrame:
    """The rows of docs (doc_id long, text, further long columns) packed into units, a row each, in the shared folder."""
    columnwise(docs.sparkSession)
    docs = docs.select("doc_id", "text", *longs)
    path = scratch(docs.sparkSession, name)
    packed = docs.mapInArrow(_pack(UNIT_BYTES), "n long, columns binary, at binary, body binary").withColumn("unit", F.monotonically_increasing_id())
    # few units to a row group: readers hold a row group at once
    packed.write.options(**_row_groups(2 * UNIT_BYTES), compression="none").parquet(path)
    return docs.sparkSession.read.schema(packed.schema).parquet(path)


def _pack(unit_bytes: int):
    def send(held):
        batch = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        data, at = text_buffer(batch)
        ids_ = batch.column(0).cast(pa.int64())
        null = np.packbits(ids_.is_null().to_numpy(zero_copy_only=False)).tobytes()
        longs = [pc.fill_null(batch.column(i).cast(pa.int64()), 0).to_numpy(zero_copy_only=False) for i in (0, *range(2, batch.num_columns))]
        columns = null + b"".join(planes(x) for x in longs)
        return table(n=[batch.num_rows], columns=pa.array([squeeze(columns)], pa.binary()), at=pa.array([squeeze(planes(np.diff(at)))], pa.binary()), body=pa.array([squeeze(data.tobytes())], pa.binary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for _, batch in by_split(batches):
            for i in range(0, batch.num_rows, step := max(1, batch.num_rows * unit_bytes // max(1, 2 * SLICE_BYTES))):
                part = batch.slice(i, step)
                n = pc.sum(pc.binary_length(part.column(1))).as_py() or 0
                if held and size + n > unit_bytes:
                    yield send(held)
                    held, size = [], 0
                held.append(part)
                size += n
        if held:
            yield send(held)

    return run


class Unit:
    """A unit on an executor: data and at (bytes of all texts and where each starts), ids (null is LAST_ID), null (a mask) and the further long columns."""

    def __init__(self, unit: int, n: int, columns: bytes, at: bytes, body: bytes):
        self.unit, self.n = unit, n
        raw = unsqueeze(columns)
        cut = (n + 7) // 8
        self.null = np.unpackbits(np.frombuffer(raw[:cut], np.uint8))[:n].astype(bool)
        first, *self.longs = (unplanes(raw[cut + i : cut + i + 8 * n], "<i8") for i in range(0, len(raw) - cut, 8 * n))
        self.ids = np.where(self.null, LAST_ID, first)
        self.doc_id = pa.array(first, mask=self.null)
        self.at = np.concatenate([[0], np.cumsum(unplanes(unsqueeze(at), "<i8"))])
        self.data = np.frombuffer(unsqueeze(body), np.uint8)

    def slices(self) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """Runs of rows with about SLICE_BYTES of text: the rows, their bytes and where each text starts."""
        a = 0
        while a < self.n:
            b = max(a + 1, int(np.searchsorted(self.at, self.at[a] + SLICE_BYTES, "right")) - 1)
            yield slice(a, b), self.data[self.at[a] : self.at[b]], self.at[a : b + 1] - self.at[a]
            a = b

    def text(self, row: int) -> bytes:
        return self.data[self.at[row] : self.at[row + 1]].tobytes()


def each_unit(work: Callable[[Unit], Iterator[pa.RecordBatch]]):
    """A function for mapInArrow over units."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {k: batch.column(i) for i, k in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                yield from work(Unit(*(column[k][i].as_py() for k in ("unit", "n", "columns", "at", "body"))))
                release()

    return run


def release() -> None:
    """Give memory that is free back to the system: workers wait between tasks and would keep it."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def shard_count(docs: DataFrame) -> int:
    """Shards for the texts of docs, SHARD_BYTES each."""
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return max(1, size // SHARD_BYTES)


# ---------------------------------------------------------------- routing


def shard_of(keys: np.ndarray, shards: int, bits: int = BITS) -> np.ndarray:
    """Shards are ranges of keys (below 2**bits)."""
    whole = min(bits, 62 - shards.bit_length())
    return (keys >> (bits - whole)) * shards >> whole


def _cut(shard: np.ndarray) -> list[tuple[int, int]]:
    cut = np.flatnonzero(np.diff(shard, prepend=-1))
    return list(zip(cut.tolist(), [*cut[1:].tolist(), len(shard)], strict=True))


def pack(keys: np.ndarray | None, values: list[np.ndarray]) -> bytes:
    """Ascending keys (gap coded; None: no keys) and arrays aligned with them."""
    head = gaps(keys) if keys is not None else b""
    body = b"".join(planes(v) for v in values)
    return len(head).to_bytes(8, "little") + head + (squeeze(body) if body else b"")


def unpack(data: bytes, kinds: list[str], keyed: bool = True) -> tuple[np.ndarray | None, list[np.ndarray]]:
    cut = 8 + int.from_bytes(data[:8], "little")
    keys = ungaps(data[8:cut]) if keyed else None
    if not kinds or cut == len(data):
        return keys, [np.empty(0, k) for k in kinds]
    body, out, at = unsqueeze(data[cut:]), [], 0
    n = len(body) // sum(np.dtype(k).itemsize for k in kinds)
    for k in kinds:
        size = n * np.dtype(k).itemsize
        out.append(unplanes(body[at : at + size], k))
        at += size
    return keys, out


MESSAGE = "shard long, bundle long, units binary, sizes binary, body binary"


def _message(rows: list[tuple[int, int, list[int], list[bytes]]]) -> pa.RecordBatch:
    """Messages (shard, bundle, units, a body for each unit)."""
    shard, bundle, of, bodies = zip(*rows, strict=True) if rows else ((), (), (), ())
    return table(
        shard=pa.array(shard, pa.int64()), bundle=pa.array(bundle, pa.int64()), units=pa.array([np.array(u, "<i8").tobytes() for u in of], pa.binary()),
        sizes=pa.array([np.array([len(x) for x in b], "<i8").tobytes() for b in bodies], pa.binary()), body=pa.array([b"".join(b) for b in bodies], pa.binary()),
    )


def _parts(messages: pa.Table) -> Iterator[tuple[int, int, int, bytes]]:
    """(message, shard, unit, body) of all messages."""
    for i, (shard, of, sizes, body) in enumerate(zip(*(messages.column(k).to_pylist() for k in ("shard", "units", "sizes", "body")), strict=True)):
        at = 0
        for unit, size in zip(np.frombuffer(of, "<i8").tolist(), np.frombuffer(sizes, "<i8").tolist(), strict=True):
            yield i, shard, unit, body[at : at + size]
            at += size


def _send(leaf, shards: int, bits: int):
    def work(unit: Unit):
        keys, values = leaf(unit)
        if len(keys):
            shard = shard_of(keys, shards, bits)
            yield _message([(int(shard[a]), 0, [unit.unit], [pack(keys[a:b], [v[a:b] for v in values])]) for a, b in _cut(shard)])

    return each_unit(work)


def _recut(coarse: int, fine: int, bits: int, kinds: list[str]):
    """A relay on the way up: the messages of a coarse shard and a bundle of units, cut into fine shards."""

    def run(key: tuple, messages: pa.Table) -> pa.Table:
        out: dict[int, tuple[list, list]] = {}
        for _, _, unit, body in _parts(messages):
            keys, values = unpack(body, kinds)
            shard = shard_of(keys, coarse * fine, bits)
            for a, b in _cut(shard):
                of, bodies = out.setdefault(int(shard[a]), ([], []))
                of.append(unit)
                bodies.append(pack(keys[a:b], [v[a:b] for v in values]))
        return pa.Table.from_batches([_message([(s, key[1].as_py(), *x) for s, x in sorted(out.items())])])

    return run


def _answer(merge, kinds: list[str], direct: bool):
    """A shard: merge(shard, keys, values, unit index) gives a mask of the keys to answer (None: all, without keys), the answers' arrays for all keys, and perhaps facts, whole numbers. direct: a row for each unit."""

    def run(key: tuple, messages: pa.Table) -> pa.Table:
        parts = list(_parts(messages))
        got = [unpack(body, kinds) for *_, body in parts]
        size = [len(k) for k, _ in got]
        keys = np.concatenate([k for k, _ in got])
        values = [np.concatenate([v[i] for _, v in got]) for i in range(len(kinds))]
        known = {u: i for i, u in enumerate(sorted({unit for _, _, unit, _ in parts}))}
        of = np.repeat(np.array([known[unit] for _, _, unit, _ in parts]), size)
        del got
        mask, answers, *facts = merge(key[0].as_py(), keys, values, of)
        bundles = messages.column("bundle").to_pylist()
        rows: dict[int, tuple[int, int, list, list]] = {}
        at = 0
        for (i, shard, unit, _), n in zip(parts, size, strict=True):
            own = np.arange(at, at + n) if mask is None else at + np.flatnonzero(mask[at : at + n])
            at += n
            if len(own):
                row = rows.setdefault(i, (shard, bundles[i], [], []))
                row[2].append(unit)
                row[3].append(pack(None if mask is None else keys[own], [a[own] for a in answers]))
        told = [(parts[0][1], 0, [-1 - key[0].as_py() % BUCKETS], [np.array(x, "<i8").tobytes()]) for x in facts]
        out = pa.Table.from_batches([_message([*rows.values(), *told])])
        release()
        return _unbundle(out) if direct else out

    return run


ANSWER = "unit long, shard long, body binary"


def _unbundle(messages: pa.Table) -> pa.Table:
    """A relay on the way down: a row for each unit and shard."""
    _, shard, unit, body = zip(*_parts(messages), strict=True) if messages.num_rows else ((), (), (), ())
    return pa.Table.from_batches([table(unit=pa.array(unit, pa.int64()), shard=pa.array(shard, pa.int64()), body=pa.array(body, pa.binary()))])


def ask(asking: DataFrame, leaf, kinds: list[str], merge, shards: int, name: str, bits: int = BITS, fan: int | None = None) -> str:
    """Ask all shards about the keys of all units; gives the path of the answers, for ``told``.

    leaf(unit) gives a unit's ascending distinct keys (below 2**bits) and arrays of the given kinds, aligned with them. Where there are more
    than ``fan`` shards, units send to ``fan`` coarse ones, relays for each of these and a bundle of units cut their messages up,
    and relays take the answers apart again: the number of messages is about units * fan, not units * shards.
    """
    fan = fan or FAN
    coarse, fine = (shards, 1) if shards <= fan else (fan, -(-shards // fan))
    messages = asking.mapInArrow(_send(leaf, coarse, bits), MESSAGE)
    if fine > 1:
        bundled = messages.withColumn("bundle", F.pmod(F.xxhash64("units"), F.lit(max(2, fan // 16))))
        messages = bundled.groupBy("shard", "bundle").applyInArrow(_recut(coarse, fine, bits, kinds), MESSAGE)
    answers = messages.groupBy("shard").applyInArrow(_answer(merge, kinds, fine == 1), ANSWER if fine == 1 else MESSAGE)
    if fine > 1:
        answers = answers.groupBy((F.col("shard") / fine).cast("long").alias("coarse"), "bundle").applyInArrow(_unbundle, ANSWER)
    return deliver(answers, name, asking, "unit")


def told(path: str, unit: int, kinds: list[str], keyed: bool = True) -> tuple[np.ndarray | None, list[np.ndarray]]:
    """On an executor: a unit's answers in ascending order of keys, with the keys if the answers have them."""
    found = delivered(path, unit, ["body", "shard"], "unit")
    bodies = [] if found is None else found.sort_by("shard").column("body").to_pylist()
    got = [unpack(x, kinds, keyed) for x in bodies]
    keys = np.concatenate([k for k, _ in got]) if keyed and got else np.empty(0, np.int64) if keyed else None
    return keys, [np.concatenate([v[i] for _, v in got]) if got else np.empty(0, k) for i, k in enumerate(kinds)]


def facts(spark: SparkSession, path: str, n: int) -> list[int]:
    """The sums over all shards of the n facts that merge gave."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i8").reshape(-1, n).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array([int(x)]) for x in got], [f"f{i}" for i in range(n)])

    rows = spark.read.schema("unit long, body binary").parquet(path.rpartition("?")[0]).where("unit < 0").select("body")
    return [int(x or 0) for x in rows.mapInArrow(read, ", ".join(f"f{i} long" for i in range(n))).groupBy().sum().first()]


def member(have: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Positions in the sorted array have, -1 where missing."""
    if not len(have):
        return np.full(len(asked), -1)
    at = np.minimum(np.searchsorted(have, asked), len(have) - 1)
    return np.where(have[at] == asked, at, -1)


def groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal keys (the last one first) together, and where their groups start in it."""
    order = np.lexsort(keys) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    return order, np.flatnonzero(new)


# ---------------------------------------------------------------- columns


def ids(batch: pa.RecordBatch, name: str = "doc_id") -> np.ndarray:
    """An integer column as int64; null becomes LAST_ID."""
    column = batch.column(batch.schema.get_field_index(name)).cast(pa.int64())
    return pc.fill_null(column, int(LAST_ID)).to_numpy(zero_copy_only=False)


def text_buffer(batch: pa.RecordBatch, name: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows and the n + 1 offsets of the rows; null is empty."""
    column = pc.fill_null(batch.column(batch.schema.get_field_index(name)).cast(pa.large_string()), "")
    n = len(column)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    if data is None or at[-1] == at[0]:
        return np.empty(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def bytes_of(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column without nulls, and the n + 1 offsets of its values."""
    chunks = [x.cast(pa.large_binary()) for x in column.chunks] or [pa.array([], pa.large_binary())]
    array = pa.concat_arrays(chunks)
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8), at


# ---------------------------------------------------------------- hashing


def _table(seed: int, n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


ODD = _table(11, 8)
ODD_ROW = _table(12, 4096)
BYTE = [_table(21, 256), _table(22, 256)]
_fold = np.arange(256)
_fold[65:91] += 32
LOWER = _fold.astype(np.uint8)
BYTE_LOWER = [t[_fold] for t in BYTE]
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the k-th odd base and of its inverse modulo 2**64."""
    have = _powers.get(k)
    if have is None or len(have[0]) < n:
        size = 1 << max(17, (n - 1).bit_length())
        base = int(ODD[k])
        up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        have = np.cumprod(up), np.cumprod(down)
        if size <= SLICE_BYTES * 2:
            _powers[k] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_hash(values: np.ndarray, k: int) -> np.ndarray:
    """n + 1 prefix sums of values[i] * base**i."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(k, max(1, len(values)))[0][: len(values)], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the ranges [start, end); equal sequences have equal hashes wherever they stand."""
    return (prefix[end] - prefix[start]) * powers(k, len(prefix))[1][start]


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ and, per row, the index of its first word (n + 1 values)."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(at), np.int64)
    space = SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    before = np.empty(len(data), bool)
    before[0], before[1:] = True, space[:-1]
    start = np.flatnonzero(~space & (before | edge[:-1]))
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = True, space[1:]
    end = np.flatnonzero(~space & (after | edge[1:])) + 1
    return start, end, np.searchsorted(start, at)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, k: int, lower: bool = False) -> np.ndarray:
    return mix(range_hash(prefix_hash((BYTE_LOWER if lower else BYTE)[k][data], k), start, end, k))


def windows(first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts (word indexes) of all n-word windows inside rows, and the row of each."""
    count = np.maximum(np.diff(first) - (n - 1), 0)
    row = np.repeat(np.arange(len(count)), count)
    inside = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    return first[row] + inside, row


def window_hashes(hashes: np.ndarray, start: np.ndarray, n: int, k: int) -> np.ndarray:
    return mix(range_hash(prefix_hash(hashes, k + 2), start, start + n, k + 2))


def covered(start: np.ndarray, n: int, size: int) -> np.ndarray:
    """Mask of the positions in [s, s + n) for any s."""
    edge = np.zeros(size + 1, np.int32)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + n, -1)
    return np.cumsum(edge[:-1]) > 0


# ---------------------------------------------------------------- packed arrays


def gaps(values: np.ndarray) -> bytes:
    """Ascending non-negative integers, their gaps Golomb-Rice coded: about log2(mean gap) + 1.5 bits each, whole bytes of low bits apart."""
    n = len(values)
    if not n:
        return b""
    first = int(values[0])
    gap = np.diff(values.astype(np.int64))
    k = max(0, int(gap.mean() * 0.7).bit_length()) if n > 1 else 0
    high = gap >> k
    unary = np.zeros(int(high.sum()) + n - 1, np.uint8)
    unary[np.cumsum(high + 1) - 1] = 1
    whole, rest = k // 8, k % 8
    low = np.ascontiguousarray(gap.view(np.uint8).reshape(-1, 8)[:, :whole].T).tobytes()
    bits = np.empty((n - 1, rest), np.uint8)
    for i in range(rest):
        bits[:, i] = gap >> (8 * whole + i) & 1
    return n.to_bytes(8, "little") + first.to_bytes(8, "little") + bytes([k]) + low + np.packbits(bits).tobytes() + np.packbits(unary).tobytes()


def ungaps(data: bytes) -> np.ndarray:
    if not data:
        return np.empty(0, np.int64)
    n, first, k = int.from_bytes(data[:8], "little"), int.from_bytes(data[8:16], "little"), data[16]
    m, whole, rest = n - 1, k // 8, k % 8
    a = 17 + m * whole
    b = a + (m * rest + 7) // 8
    out = np.empty(n, np.int64)
    out[0] = first
    gap = out[1:]
    gap[:] = np.diff(np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, offset=b)))[:m], prepend=-1) - 1 << k
    if whole:
        low = np.zeros((m, 8), np.uint8)
        low[:, :whole] = np.frombuffer(data[17:a], np.uint8).reshape(whole, m).T
        gap |= low.reshape(-1).view(np.int64)
    bits = np.unpackbits(np.frombuffer(data[a:b], np.uint8))[: m * rest].reshape(m, rest)
    for i in range(rest):
        gap |= bits[:, i].astype(np.int64) << (8 * whole + i)
    return np.cumsum(out, out=out)


def planes(values: np.ndarray) -> bytes:
    """An integer array by byte significance, which the shuffle's codec compresses well."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


def unplanes(data: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).reshape(-1).view(dtype)


def squeeze(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def unsqueeze(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def table(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], list(columns))
