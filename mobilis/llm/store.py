"""Content-addressed store of token ids.

Layout below one folder, all written by Spark (Parquet, so a lost task only
repeats its own files):

* ``chunks/``: digest, number of ids, ids (little-endian, 16 bits where all ids
  fit, else 32); each distinct chunk once;
* ``recipes/``: in ascending doc_id order over the files, each document's number
  of ids, the digests of its chunks in order, and their Merkle root;
* ``manifest/``: for each file of recipes its name, documents, ids, first and last
  doc_id, and the Merkle root over its documents' roots.

Chunks are cut where a rolling hash over ``WINDOW`` ids ends in zeros, so a passage
that two documents share is cut alike in both wherever it stands.  Reading first
holds the files of recipes against the manifest, then decodes every chunk, checks it
against its digest, and joins recipes to the chunks' sizes and checksums; CRC-32 of a
document follows from those of its chunks, so chunk bodies never move once written.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mobilis.llm.shared import joined_to_unique, stored
from mobilis.llm.tokens import ID, encoder

WINDOW, ZERO_BITS, LEAST, MOST = 8, 8, 64, 1024
#: Roots that one group of the manifest puts together at once.
FAN = 4096

_KEYS = np.random.Generator(np.random.PCG64(3)).integers(0, 2**32, 1 << 16, dtype=np.uint32)


def digest(ids: bytes) -> bytes:
    return hashlib.blake2b(ids, digest_size=16).digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    """Root of a binary hash tree; an odd node moves up as it is."""
    level = leaves or [digest(b"")]
    while len(level) > 1:
        pairs = [digest(b"\x01" + a + b) for a, b in zip(level[::2], level[1::2], strict=False)]
        level = pairs + level[len(pairs) * 2 :]
    return level[0]


def boundaries(ids: np.ndarray, starts: list[int]) -> list[list[int]]:
    """End positions of the chunks of each document of a batch; a document begins at each of ``starts``."""
    if len(ids) >= WINDOW:
        keyed = _KEYS[ids & np.uint32(0xFFFF)] ^ (ids >> np.uint32(16))
        rolled = np.zeros(len(ids) - WINDOW + 1, dtype=np.uint32)
        for j in range(WINDOW):
            rolled = (rolled << np.uint32(1)) + keyed[j : j + len(rolled)]
        marks = np.flatnonzero(rolled < np.uint32(1 << (32 - ZERO_BITS))) + WINDOW
    else:
        marks = np.zeros(0, dtype=np.int64)
    stops = [*starts[1:], len(ids)]
    near = np.searchsorted(marks, starts).tolist()
    far = np.searchsorted(marks, stops, side="right").tolist()
    marks = marks.tolist()
    out = []
    for start, stop, a, b in zip(starts, stops, near, far, strict=True):
        ends, last = [], start
        for m in marks[a:b]:
            if m - last < LEAST:  # also all windows that reach back into the document before
                continue
            while m - last > MOST:
                last += MOST
                ends.append(last)
            if m - last >= LEAST:
                ends.append(m)
                last = m
        while stop - last > MOST:
            last += MOST
            ends.append(last)
        if last < stop or not ends:
            ends.append(stop)
        out.append(ends)
    return out


def _wide(body: bytes, n: int) -> bytes:
    return np.frombuffer(body, dtype="<u2").astype(ID).tobytes() if len(body) == 2 * n else body


@lru_cache(maxsize=4096)
def _shift(n_bytes: int) -> tuple[int, ...]:
    """Images of the 32 bits of a CRC-32 register under ``n_bytes`` zero bytes."""
    def times(op, x):
        out, k = 0, 0
        while x:
            if x & 1:
                out ^= op[k]
            x >>= 1
            k += 1
        return out

    power = [0xEDB88320] + [1 << k for k in range(31)]  # one zero bit
    result = tuple(1 << k for k in range(32))
    bits = n_bytes * 8
    while bits:
        if bits & 1:
            result = tuple(times(power, x) for x in result)
        power = [times(power, x) for x in power]
        bits >>= 1
    return result


def joined_crc(crc: int, other: int, n_bytes: int) -> int:
    """CRC-32 of two strings together, from theirs and the second one's length."""
    for k, image in enumerate(_shift(n_bytes)):
        if crc >> k & 1:
            other ^= image
    return other


def _encoded(docs: DataFrame, tokenizer: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], dtype=ID).tobytes()
        task, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                some = batch.slice(first, 512)
                out: dict[str, list] = {c: [] for c in ("kind", "key", "doc_id", "n_ids", "chunks", "root", "body")}
                seen: set[bytes] = set()
                chunks: list[tuple[bytes, int, bytes]] = []
                found = [ids + end for ids in encoder(tokenizer).encode(some.column("text"))]
                sizes = [len(ids) // ID.itemsize for ids in found]
                whole = b"".join(found)
                values = np.frombuffer(whole, dtype=ID)
                width = 2 if values.max() < 1 << 16 else ID.itemsize
                bodies = values.astype("<u2").tobytes() if width == 2 else whole
                starts = [0, *np.cumsum(sizes).tolist()[:-1]]
                for name, size, last, stops in zip(some.column("doc_id").to_pylist(), sizes, starts, boundaries(values, starts), strict=True):
                    recipe = []
                    for stop in stops:
                        part = digest(whole[last * ID.itemsize : stop * ID.itemsize])
                        recipe.append(part)
                        if part not in seen:
                            seen.add(part)
                            chunks.append((part, stop - last, bodies[last * width : stop * width]))
                        last = stop
                    key = task.to_bytes(8) + row.to_bytes(8)
                    row += 1
                    for c, v in zip(out.values(), (0, key, name, size, recipe, merkle_root(recipe), None), strict=True):
                        c.append(v)
                n = len(chunks)
                keys, sizes, bodies = zip(*chunks, strict=True) if n else ((), (), ())
                for c, v in zip(out.values(), ([1] * n, keys, [None] * n, sizes, [None] * n, [None] * n, bodies), strict=True):
                    c.extend(v)
                kinds = [pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out.values(), kinds, strict=True)], list(out))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "kind int, key binary, doc_id long, n_ids long, chunks array<binary>, root binary, body binary")


def _running(column: str, total: str):
    """Per task: the running total of a column before each row, and the task's number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.column(column).to_numpy()
            before = done + np.cumsum(n) - n
            done += int(n.sum())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(before, pa.int64()), pa.array(np.full(len(n), part), pa.int32())], [*batch.schema.names, total, "part"]
            )

    return run


def with_starts(rows: DataFrame, count: str, order: list[str]) -> DataFrame:
    """Add ``start``, the total of ``count`` over all rows before in ``order``.

    Rows are sorted by range; each task adds up its own, and the tasks' totals (one
    row a task) give what goes before it.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    ranged = rows.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
    local = stored(ranged.mapInArrow(_running(count, "local"), f"{schema}, local long, part int"))
    # one row a task of the shuffle, as many as the session sets: small enough for one window and a broadcast
    totals = local.groupBy("part").agg(F.sum(count).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return local.join(F.broadcast(base), "part").withColumn("start", F.col("local") + F.col("base")).drop("local", "base")


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of all documents, each followed by ``end_id``, below ``path``.

    Null texts are empty documents; repeated rows and ids are documents of their
    own; a null id sorts first.  Other columns are not read.  Equal chunks are stored
    once within one write; each write has a folder of its own.
    """
    spark = docs.sparkSession
    columns = ["doc_id", "n_ids", "chunks", "root", "body"]
    # one pass over the texts makes both kinds of rows; equal chunks meet after each task has dropped its own repeats
    once = _encoded(docs, tokenizer, end_id, id_col, text_col).groupBy("kind", "key").agg(*[F.first(c).alias(c) for c in columns])
    once.write.partitionBy("kind").option("compression", "zstd").parquet(f"{path}/raw")
    raw = spark.read.schema("key binary, doc_id long, n_ids long, chunks array<binary>, root binary, body binary")
    if _there(spark, f"{path}/raw/kind=1"):
        _move(spark, f"{path}/raw/kind=1", f"{path}/chunks")
        recipes = raw.parquet(f"{path}/raw/kind=0").select("doc_id", "n_ids", "chunks", "root")
    else:
        spark.createDataFrame([], "key binary, n_ids long, body binary").write.parquet(f"{path}/chunks")
        recipes = spark.createDataFrame([], "doc_id long, n_ids long, chunks array<binary>, root binary")
    ordered = recipes.repartitionByRange("doc_id", "root").sortWithinPartitions("doc_id", "root")
    ordered.write.option("compression", "zstd").parquet(f"{path}/recipes")
    _manifest(_recipes(spark, path)).write.parquet(f"{path}/manifest")


def _recipes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("doc_id long, n_ids long, chunks array<binary>, root binary").parquet(f"{path}/recipes")


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """Recipes with a number: the same files are split in the same way, so a plan that reads them twice finds the same."""
    return _recipes(spark, path).withColumn("row", F.monotonically_increasing_id())


def _manifest(recipes: DataFrame) -> DataFrame:
    """file, root, n_documents, n_ids, first_doc, last_doc of each file of recipes.

    The root over a file's documents is made in levels of at most ``FAN`` a group,
    so no task holds the roots of a whole file.
    """
    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([merkle_root(x) for x in batch.column("leaves").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([found, *batch.columns[1:]], ["root", *batch.schema.names[1:]])

    level = recipes.select(
        F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at"), "root", F.lit(1).cast("long").alias("n_documents"), "n_ids", F.col("doc_id").alias("first_doc"), F.col("doc_id").alias("last_doc")
    )
    for _ in range(3):
        leaves = F.transform(F.array_sort(F.collect_list(F.struct("at", "root"))), lambda x: x["root"])
        grouped = level.groupBy("file", F.floor(F.col("at") / FAN).alias("at")).agg(
            leaves.alias("leaves"), F.sum("n_documents").alias("n_documents"), F.sum("n_ids").alias("n_ids"), F.min("first_doc").alias("first_doc"), F.max("last_doc").alias("last_doc")
        )
        level = grouped.select("leaves", "file", "at", "n_documents", "n_ids", "first_doc", "last_doc").mapInArrow(
            roots, "root binary, file string, at long, n_documents long, n_ids long, first_doc long, last_doc long"
        )
    return level.drop("at")


def verify(spark: SparkSession, path: str) -> None:
    """Fail if a file of recipes is missing, added or altered; the driver sees one row at most."""
    told = spark.read.schema("root binary, file string, n_documents long, n_ids long, first_doc long, last_doc long").parquet(f"{path}/manifest")
    facts = ["root", "n_documents", "n_ids", "first_doc", "last_doc"]
    left, right = (df.select("file", F.struct(*facts).alias(name)) for df, name in ((told, "told"), (_manifest(_recipes(spark, path)), "there")))
    wrong = left.join(right, "file", "full").where(~F.col("told").eqNullSafe(F.col("there"))).head(1)
    if wrong:
        raise ValueError(f"recipes {wrong[0]['file']} are not as the manifest tells: {wrong[0]['told']}, found {wrong[0]['there']}")


def _files(spark: SparkSession, path: str):
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _there(spark: SparkSession, path: str) -> bool:
    files, place = _files(spark, path)
    return files.exists(place)


def _move(spark: SparkSession, path: str, to: str) -> None:
    files, place = _files(spark, path)
    if not files.rename(place, _files(spark, to)[1]):
        raise OSError(f"could not move {path} to {to}")


def _checked_chunks(spark: SparkSession, path: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crcs = []
            for key, n, body in zip(*(batch.column(c).to_pylist() for c in ("key", "n_ids", "body")), strict=True):
                ids = _wide(body, n)
                if digest(ids) != key:
                    raise ValueError(f"chunk {key.hex()} does not hold what its digest says")
                crcs.append(zlib.crc32(ids))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("n_ids"), pa.array(crcs, pa.int64())], ["key", "n", "crc"])

    return spark.read.parquet(f"{path}/chunks").select("key", "n_ids", "body").mapInArrow(run, "key binary, n long, crc long")


def _met(uses: DataFrame, chunks: DataFrame) -> DataFrame:
    """Uses (key, ...) with what their chunks hold, null where one is missing.

    A chunk may have any part of the uses (that of all empty documents, or of a page
    copied often): such chunks meet theirs by a broadcast, at most a thousand of them,
    each of bounded size.
    """
    counts = stored(uses.groupBy("key").agg(F.count(F.lit(1)).alias("n_uses")))
    total = counts.agg(F.coalesce(F.sum("n_uses"), F.lit(0))).first()[0]
    return joined_to_unique(uses, counts.join(chunks, "key", "left"), "key", "n_uses", total)


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files.

    The files of recipes are held against the manifest; every chunk is decoded and
    checked against its digest; a document whose chunks do not add up to its size or
    Merkle root fails the job.
    """
    verify(spark, path)
    uses = _numbered(spark, path).select("row", "doc_id", "n_ids", "root", F.posexplode("chunks").alias("pos", "key"))
    met = _met(uses, stored(_checked_chunks(spark, path)))  # decoded once; a key, a length and a checksum each
    listed = met.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_ids").alias("n_ids"), F.first("root").alias("root"), F.array_sort(F.collect_list(F.struct("pos", "key", "n", "crc"))).alias("parts")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crcs = []
            for name, n, root, parts in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_ids", "root", "parts")), strict=True):
                crc = 0
                if sum(p["n"] or 0 for p in parts) != n or merkle_root([p["key"] for p in parts]) != root:
                    raise ValueError(f"document {name} does not follow from its chunks")
                for p in parts:
                    crc = joined_crc(crc, p["crc"], p["n"] * ID.itemsize)
                crcs.append(crc)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_ids"), pa.array(crcs, pa.int64())], ["doc_id", "n_tokens", "ids_crc32"])

    # sorting by range reads its input twice
    found = stored(listed.select("doc_id", "n_ids", "root", "parts").mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long"))
    return with_starts(found, "n_tokens", ["doc_id", "ids_crc32"]).select("doc_id", "start", "n_tokens", "ids_crc32")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id and ids (little-endian 32-bit) of each document, rebuilt from its chunks.

    A missing or altered chunk or file fails the job as in :func:`read_summary`.
    """
    verify(spark, path)
    uses = _numbered(spark, path).select("row", "doc_id", "n_ids", F.posexplode("chunks").alias("pos", "key"))
    met = _met(uses, spark.read.parquet(f"{path}/chunks").select("key", F.col("n_ids").alias("n"), "body"))
    listed = met.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_ids").alias("n_ids"), F.array_sort(F.collect_list(F.struct("pos", "key", "n", "body"))).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for name, n, parts in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_ids", "parts")), strict=True):
                chunks = [_wide(p["body"] or b"", p["n"] or 0) for p in parts]
                if sum(map(len, chunks)) != n * ID.itemsize or any(digest(c) != p["key"] for c, p in zip(chunks, parts, strict=True)):
                    raise ValueError(f"document {name} does not follow from its chunks")
                found.append(b"".join(chunks))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.binary())], ["doc_id", "ids"])

    return listed.select("doc_id", "n_ids", "parts").mapInArrow(run, "doc_id long, ids binary")
