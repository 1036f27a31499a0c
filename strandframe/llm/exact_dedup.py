"""Exact dedup with a cuckoo-filter index of live digests.

Texts are equal when identical after lower-casing A-Z. Each map task first folds its own
copies into one entry per digest, as long as it has room for HELD_DIGESTS of them, so a
group of copies that holds a third of all rows sends about one entry per task; entries are
dealt by digest prefix, and every bucket of digests is held by a CuckooIndex: a filter hit
is verified against the bucket's stored digests, an entry with a later row deletes the live
one and inserts its own, and overflow rebuilds the filter at twice the size from the
stored keys.

Nulls count as empty texts, empty texts are equal to each other, repeated rows count in
group_size. Of equal texts exactly one row stays: the one with the largest doc_id; of rows
that share this id the one whose text's SHA-256 is largest, and of equal rows any one. A row
without an id comes before all others, so keep_id is null only where no row of the group
has an id. An empty table gives an empty result, other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Digests are spread over this many buckets; one bucket is held in memory at a time.
BUCKETS = 1 << 16
#: Distinct digests that a task folds copies into before it hands them on.
HELD_DIGESTS = 200_000


class CuckooIndex:
    """Cuckoo filter over byte keys, with the keys themselves stored by bucket.

    The filter answers "certainly absent" or "maybe"; a "maybe" is settled by the
    stored keys of the two buckets, so answers are exact. value is what a live key carries.
    """

    SLOTS = 4
    MAX_KICKS = 200

    def __init__(self, capacity: int = 64):
        n = 1
        while n * self.SLOTS < capacity:
            n *= 2
        self._clear(n)

    def _clear(self, n: int) -> None:
        self.n = n
        self.prints: list[list[int]] = [[] for _ in range(n)]
        self.content: list[list[tuple[bytes, object]]] = [[] for _ in range(n)]
        self.size = 0

    def _places(self, key: bytes) -> tuple[int, int, int]:
        h = int.from_bytes(hashlib.blake2b(key, digest_size=12).digest(), "little")
        mark = (h & 0xFFFF) or 1
        first = (h >> 16) & (self.n - 1)
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995)) & (self.n - 1)

    def find(self, key: bytes):
        """The value of a live key, or None."""
        mark, a, b = self._places(key)
        for at in (a, b):
            if mark in self.prints[at]:
                for k, v in self.content[at]:
                    if k == key:
                        return v
        return None

    def delete(self, key: bytes) -> bool:
        mark, a, b = self._places(key)
        for at in (a, b):
            if mark in self.prints[at]:
                for i, (k, _) in enumerate(self.content[at]):
                    if k == key:
                        del self.prints[at][i], self.content[at][i]
                        self.size -= 1
                        return True
        return False

    def insert(self, key: bytes, value: object) -> None:
        """key must not be live."""
        mark, a, b = self._places(key)
        entry = (key, value)
        for at in (a, b):
            if len(self.prints[at]) < self.SLOTS:
                self.prints[at].append(mark)
                self.content[at].append(entry)
                self.size += 1
                return
        at = a
        for kick in range(self.MAX_KICKS):
            slot = kick % self.SLOTS
            mark, self.prints[at][slot] = self.prints[at][slot], mark
            entry, self.content[at][slot] = self.content[at][slot], entry
            at = self._other(at, mark)
            if len(self.prints[at]) < self.SLOTS:
                self.prints[at].append(mark)
                self.content[at].append(entry)
                self.size += 1
                return
        keys = [e for bucket in self.content for e in bucket] + [entry]
        self._clear(2 * self.n)
        for k, v in keys:
            self.insert(k, v)

    def items(self) -> Iterator[tuple[bytes, object]]:
        for bucket in self.content:
            yield from bucket


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_sha256, tie): SHA-256 of each text with A-Z lower-cased, and 64 bits of that of the text as it is."""

    def run(batches):
        for batch in batches:
            data, off = C.text_buffers(batch.column(1))
            sha, tie = [], []
            for lo, hi in C.row_chunks(off):
                part = data[off[lo] : off[hi]].tobytes()
                low = part.lower()
                cuts = (off[lo : hi + 1] - off[lo]).tolist()
                for a, b in zip(cuts, cuts[1:]):
                    sha.append((held := hashlib.sha256(low[a:b])).hexdigest())
                    same = low[a:b] == part[a:b]
                    tie.append(int.from_bytes((held if same else hashlib.sha256(part[a:b])).digest()[:8], "big", signed=True))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sha, pa.string()), pa.array(tie, pa.int64())], ["doc_id", "text_sha256", "tie"])

    return C.map_batches(C.keyed_texts(docs, key, text), run, "doc_id long, text_sha256 string, tie long")


def _key(doc_id: int | None, tie: int, place: int) -> tuple:
    """Orders the rows of a group: the largest stays."""
    return (doc_id is not None, doc_id or 0, tie, place)


def fold_copies(keyed: DataFrame) -> DataFrame:
    """(bucket, digest, doc_id, tie, place, n): the copies that a task holds, as one entry per digest with the row that stays of them.

    keyed: doc_id, text_sha256, tie, place.
    """

    def run(batches):
        held: dict[str, list] = {}

        def out():
            cols = [[int(d[:4], 16) for d in held], list(held), [v[0][1] if v[0][0] else None for v in held.values()], [v[0][2] for v in held.values()], [v[0][3] for v in held.values()], [v[1] for v in held.values()]]
            held.clear()
            kinds = (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["bucket", "digest", "doc_id", "tie", "place", "n"])

        for batch in batches:
            for doc_id, digest, tie, place in zip(*(c.to_pylist() for c in batch.columns)):
                row, got = _key(doc_id, tie, place), held.get(digest)
                if got is None:
                    held[digest] = [row, 1]
                else:
                    got[1] += 1
                    if row > got[0]:
                        got[0] = row
            if len(held) > HELD_DIGESTS:
                yield out()
        yield out()

    return C.map_batches(keyed, run, "bucket int, digest string, doc_id long, tie long, place long, n long")


def survivors(entries: DataFrame) -> DataFrame:
    """(text_sha256, keep_id, keep_place, group_size) from entries, through one CuckooIndex per bucket."""

    def out(index: CuckooIndex) -> pa.RecordBatch:
        rows = [(k.hex(), row[1] if row[0] else None, row[3], n) for k, (row, n) in index.items()]
        cols = list(zip(*rows)) or [[], [], [], []]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["text_sha256", "keep_id", "keep_place", "group_size"])

    def run(batches):
        index, at = CuckooIndex(), None
        for batch in batches:
            for bucket, digest, doc_id, tie, place, n in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket != at:
                    if index.size:
                        yield out(index)
                    index, at = CuckooIndex(), bucket
                key, row = bytes.fromhex(digest), _key(doc_id, tie, place)
                live = index.find(key)
                if live is None:
                    index.insert(key, (row, n))
                else:
                    index.delete(key)
                    index.insert(key, (max(row, live[0]), n + live[1]))
        if index.size:
            yield out(index)

    dealt = entries.repartition("bucket").sortWithinPartitions("bucket")
    return C.map_batches(dealt, run, "text_sha256 string, keep_id long, keep_place long, group_size long")


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", work: str | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs.

    Digests are stored once below spark.checkpoint.dir and read twice; places in the stored table tell equal rows apart.
    """
    spark = docs.sparkSession
    keyed = digests(docs, key, text).withColumn("place", F.monotonically_increasing_id())
    keyed = C.stored(keyed, f"{work or C.shared_dir(spark)}/digests")
    found = survivors(fold_copies(keyed))
    return keyed.join(found, "text_sha256", "left").select("doc_id", "keep_id", "group_size", (F.col("place") == F.col("keep_place")).alias("kept"), "text_sha256")
