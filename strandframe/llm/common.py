"""Shared pieces of the text operators: tables, work folders, word hashing.

Words are hashed straight from the Arrow byte buffers, eight bytes at a time for all
words of a chunk, so no Python string per word is ever made. Every step is followed by a
finaliser, so hashes of words and of word sequences are not linear in what stands where,
and a key drawn for each run keeps texts from being made to collide. Where any range of
words has to be hashed, polynomials modulo the prime 2**61 - 1 do it.
"""

from __future__ import annotations

import gc
import hashlib
import os
import secrets
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled by one round of numpy passes; keeps temporaries in cache.
CHUNK_BYTES = 1 << 20

U = np.uint64
_MULT = [U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0xD6E8FEB86659FD93), U(0xA0761D6478BD642F), U(0xE7037ED1A0B428DB)]
#: Odd multipliers of the left and the right part of a sequence, for two independent hashes.
_SIDES = [(U(0xD1B54A32D192ED03), U(0x8CB92BA72F3D8DD7)), (U(0xDB4F0B9175AE2165), U(0xBBE0563303A4615F))]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir, which all executors share.

    Only where that setting is absent (local tests) a temporary folder is used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or "file://" + os.path.join(tempfile.gettempdir(), "strandframe")
    return f"{base.rstrip('/')}/strandframe-{uuid.uuid4().hex}"


#: Spark's setting that removes the shuffle files of an execution when it ends, not when the driver next collects its garbage.
FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, path: str) -> DataFrame:
    """Writes df as Parquet and reads it again: lineage is cut at a table that outlives executors.

    The shuffle files of the write go with its end: what comes after reads the table.
    """
    conf = df.sparkSession.conf
    was = conf.get(FILE_CLEANUP, None)
    conf.set(FILE_CLEANUP, "true")
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        conf.unset(FILE_CLEANUP) if was is None else conf.set(FILE_CLEANUP, was)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_dir(spark: SparkSession, *paths: str) -> None:
    """Removes folders of intermediate tables through Hadoop's file system."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Lets go of shuffle files of finished jobs: Spark deletes them when the driver collects its garbage.

    Called between the stored steps of an operator that would else hold the files of all of them at once.
    """
    gc.collect()
    spark._jvm.System.gc()


def keyed_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", row: bool = False) -> DataFrame:
    """(doc_id long, text string), whatever else docs holds; a null text is empty. row: with the row key."""
    out = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return out.select("doc_id", row_key("doc_id", "text").alias("row"), "text") if row else out


def row_key(key: str, text: str):
    """64 bits of the SHA-256 of a row's id and text: with the id it tells rows apart that share an id, or have none.

    Rows that are equal in both have the same key; whatever is joined on it holds one row for each key.
    """
    digest = F.sha2(F.concat_ws(":", F.coalesce(F.col(key).cast("long").cast("string"), F.lit("-")), F.coalesce(F.col(text).cast("string"), F.lit(""))), 256)
    high, low = (F.conv(F.substring(digest, a, 8), 16, 10).cast("long") for a in (1, 9))
    return F.shiftleft(high, 32).bitwiseOR(low)


#: Rows of one Arrow batch. Whole texts travel in them, and some are very long.
BATCH_ROWS = 512


#: Rows of a lookup table sent to all executors at most, and pieces that a key's rows are dealt to beyond it.
LOOKUP_ROWS, SALTS = 20_000, 64


def join_lookup(df: DataFrame, lookup: DataFrame, key: str, salt: list[str]) -> DataFrame:
    """df left-joined to a stored table with one short row per key.

    The table is counted: up to LOOKUP_ROWS it goes to all executors and df is not moved;
    beyond that both sides are dealt by key and salt, so that a key with a third of df's
    rows is spread over SALTS tasks. salt: columns of df that tell its rows apart.
    """
    if lookup.count() <= LOOKUP_ROWS:
        return df.join(F.broadcast(lookup), key, "left")
    salted = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return df.withColumn("_salt", F.pmod(F.xxhash64(*salt), F.lit(SALTS))).join(salted, [key, "_salt"], "left").drop("_salt")


def map_batches(df: DataFrame, f, schema) -> DataFrame:
    """mapInArrow over batches of BATCH_ROWS rows at most, which leaves out empty batches.

    The session's limit of rows in a batch is lowered where it is higher, and stays so: results are
    lazy, and Spark reads the limit when they are computed.
    """
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in f(batches):
            if out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x ^ (x >> U(30))
    x = x * _MULT[0]
    x ^= x >> U(27)
    x *= _MULT[1]
    x ^= x >> U(31)
    return x


def fresh_key() -> int:
    """A key for the word hashes of one run."""
    return secrets.randbits(63)


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Everything in ASCII but letters and digits parts words, for texts compared without punctuation.
_IS_MARK = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def text_buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls count as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = pc.fill_null(arr, "")
    kind = np.int64 if pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type) else np.int32
    _, off, data = arr.buffers()
    offsets = np.frombuffer(off, kind)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64) if len(arr) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about limit bytes; a longer text stands alone."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to
        at = to


class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of consecutive texts.

    starts, ends: byte positions in data; first[i]:first[i+1] are the words of text i;
    hashes: 64-bit hash of each word's bytes under the key.
    """

    __slots__ = ("data", "starts", "ends", "first", "hashes")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, marks: bool = False, key: int = 0):
        """data: the bytes from offsets[0] to offsets[-1]; offsets may start anywhere. marks: punctuation parts words too."""
        offsets = offsets - offsets[0]
        if lower:
            data = _LOWER[data]
        n = len(data)
        space = np.ones(n + 1, bool)
        space[:n] = (_IS_MARK if marks else _IS_SPACE)[data]
        word = ~space[:n]
        before = np.empty(n, bool)
        if n:
            before[0] = True
            before[1:] = space[: n - 1]
            cuts = offsets[1:-1]
            cuts = cuts[cuts < n]
            before[cuts] = True
            after = space[1:].copy()
            after[cuts[cuts > 0] - 1] = True
        else:
            after = before
        self.data = data
        self.starts = np.flatnonzero(word & before)
        self.ends = np.flatnonzero(word & after) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.hashes = word_hashes(data, self.starts, self.ends, key)


#: Longer words, in bytes, are hashed by BLAKE2.
SHORT_WORD = 32
_LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], U)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: int = 0) -> np.ndarray:
    """Hash of data[starts[i]:ends[i]] for each i, eight bytes a step."""
    n = ends - starts
    if not len(n):
        return np.zeros(0, U)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", buffer=padded, strides=(1,))
    start = mix(np.array([key], U) + _MULT[4])
    h = mix((eight[starts] & _LOW_BYTES[np.minimum(n, 8)]) ^ (n.astype(U) * _MULT[3] + start))
    for done in range(8, SHORT_WORD, 8):
        more = np.flatnonzero(n > done)
        if not len(more):
            return h
        part = eight[starts[more] + done] & _LOW_BYTES[np.minimum(n[more] - done, 8)]
        h[more] = mix(h[more] * _MULT[2] ^ part)
    for i in np.flatnonzero(n > SHORT_WORD).tolist():
        digest = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, key=key.to_bytes(8, "little")).digest()
        h[i] = U(int.from_bytes(digest, "little"))
    return h


def words_of(data: np.ndarray, offsets: np.ndarray, lo: int, hi: int, lower: bool = False, marks: bool = False, key: int = 0) -> Words:
    return Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1], lower, marks, key)


def gram_hashes(h: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """Hash of each k consecutive word hashes (positions 0 .. len-k), put together from halves by doubling."""
    n = len(h) - k + 1
    if n < 1 or k < 1:
        return np.zeros(0, U)
    left, right = _SIDES[which]
    have, size, out, done = h, 1, None, 0
    while True:
        if k & size:
            part = have[done : done + n]
            out = part if out is None else mix(out * left + part * right)
            done += size
        if 2 * size > k:
            return mix(out * left + U(k))
        have = mix(have[:-size] * left + have[size:] * right)
        size *= 2


_P = U((1 << 61) - 1)
_LOW30, _LOW31 = U((1 << 30) - 1), U((1 << 31) - 1)


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo 2**61 - 1."""
    x = (x & _P) + (x >> U(61))
    return np.where(x >= _P, x - _P, x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product modulo 2**61 - 1 of numbers below it, from halves of 31 bits."""
    ah, al, bh, bl = a >> U(31), a & _LOW31, b >> U(31), b & _LOW31
    middle = ah * bl + al * bh
    return _reduced(U(2) * ah * bh + (middle >> U(30)) + ((middle & _LOW30) << U(31)) + al * bl)


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**61 - 1, kept for the two latest bases."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        if have is None and len(_POWERS) > 3:
            _POWERS.clear()
        have = np.ones(1, U)
        while len(have) < n:
            have = np.concatenate([have, times(have, np.array([pow(base, len(have), int(_P))], U))])
        _POWERS[base] = have
    return have[:n]


class Ranges:
    """Hashes of any ranges of a sequence of word hashes, by sums of a polynomial modulo 2**61 - 1."""

    def __init__(self, hashes: np.ndarray, key: int):
        self.base = 2 + key % ((1 << 61) - 4)
        self.back = pow(self.base, -1, int(_P))
        n = len(hashes)
        terms = times(_reduced(hashes), powers(self.base, n))
        high = np.zeros(n + 1, U)
        low = np.zeros(n + 1, U)
        np.cumsum(terms >> U(31), out=high[1:])
        np.cumsum(terms & _LOW31, out=low[1:])
        high = _reduced(high)
        self.sums = _reduced(_reduced((high >> U(30)) + ((high & _LOW30) << U(31))) + _reduced(low))

    def between(self, a: np.ndarray, b: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        """Of words a .. b - 1, as if the word numbered `at` (a itself, if not given) were the first of all."""
        return times(_reduced(self.sums[b] + (_P - self.sums[a])), powers(self.back, len(self.sums) + 1)[a if at is None else at])


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def components(spark: SparkSession, edges: DataFrame, work: str) -> DataFrame:
    """(node, label): label is the smallest node that links reach.

    edges has columns a, b. Labels travel along edges and then jump to their own
    label, so a chain of length n takes about log n rounds; each round is a stored table.
    """
    both = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{work}/edges")
    lab = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label")), f"{work}/label-0")
    k = 0
    while True:
        k += 1
        near = both.join(lab.select(F.col("node").alias("b"), F.col("label").alias("l")), "b").groupBy("a").agg(F.min("l").alias("l"))
        low = lab.join(near, lab.node == near.a).select("node", F.col("label").alias("was"), F.least("label", "l").alias("label"))
        up = low.select(F.col("node").alias("label"), F.col("label").alias("higher"))
        new = low.join(up, "label", "left").select("node", F.coalesce("higher", "label").alias("label"), (F.coalesce("higher", "label") != F.col("was")).alias("moved"))
        new = stored(new, f"{work}/label-{k}")
        lab = new.select("node", "label")
        if new.where("moved").isEmpty():
            return lab
