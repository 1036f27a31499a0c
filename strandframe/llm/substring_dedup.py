"""Substring dedup over a log-structured fingerprint index.

A window is WINDOW consecutive words. A word goes if it is covered by a window whose
word sequence also starts earlier (smaller doc_id, or same document and earlier start),
judged on the input.

The index holds window fingerprints: the smallest hash of the ANCHOR-word grams inside a
window. Equal windows have equal fingerprints and neighbouring windows mostly share one,
so there are about seven times fewer of them than windows. Documents come in batches by
doc_id. Each batch becomes a sorted immutable run (a bucketed table, fingerprint -> first
document), is merge-joined bucket by bucket with the runs of history, and FANOUT runs of
a level are compacted into one of the next. What the joins return - fingerprints held by
an earlier run or twice in the batch - are candidates only: the windows behind them are
verified by two independent 64-bit hashes of their words under a random key, whose first
place in (doc_id, start) order decides. Documents that equal an earlier one word for word
are settled by the SHA-256 of their words and take no part.

An index lasts: it lives in a folder with its key and a manifest of its runs, can be opened
by another session, and takes further batches of larger doc_ids. Beside the fingerprints it
then holds the windows of candidates, and a batch is judged by merge joins with both; of
history's texts only those are read whose fingerprints the batch is the first to repeat.

Null and empty texts have no words and the hash of the empty text. Texts of fewer than
WINDOW words lose nothing. Rows that share a doc_id are told apart by a row key; none of
them is earlier than another, so equal ones keep the same words. A row without a doc_id
has no place in the order: it loses what it repeats of itself only, and nothing is repeated
of it. Ties in place cannot occur within a document. An empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

WINDOW = 20
ANCHOR = 8
BATCHES = 4
FANOUT = 3


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` consecutive values, by doubling."""
    have, span = x, 1
    while 2 * span <= width:
        have = np.minimum(have[:-span], have[span:])
        span *= 2
    rest = width - span
    return np.minimum(have[: len(have) - rest], have[rest:]) if rest else have


class _Chunk:
    """Texts hashed together: what they need is worked out for all of them when the first one asks for it."""

    def __init__(self, words: C.Words, salt: int):
        self.words, self.salt = words, salt
        self.held: dict[str, np.ndarray] = {}

    def grams(self, what: str) -> np.ndarray:
        if what not in self.held:
            w = self.words
            if what == "anchors":
                self.held[what] = C.gram_hashes(w.hashes, ANCHOR)
            elif what == "first":
                self.held[what] = C.gram_hashes(w.hashes, WINDOW, 0)
            else:
                # Windows under the second key rest on words under the second key.
                self.held[what] = C.gram_hashes(C.word_hashes(w.data, w.starts, w.ends, self.salt ^ 0x5DEECE66D), WINDOW, 1)
        return self.held[what]


class _Text:
    """One text of a chunk, by its word numbers a .. b - 1."""

    __slots__ = ("row", "chunk", "i", "a", "b")

    def __init__(self, row: int, chunk: _Chunk, i: int, a: int, b: int):
        self.row, self.chunk, self.i, self.a, self.b = row, chunk, i, a, b

    def __len__(self) -> int:
        return self.b - self.a

    def windows(self, what: str) -> np.ndarray:
        """Hash of each window: "first" or "second"."""
        return self.chunk.grams(what)[self.a : max(self.a, self.b - WINDOW + 1)]

    def fingerprints(self) -> np.ndarray:
        """Fingerprint of each window."""
        if len(self) < WINDOW:
            return np.zeros(0, C.U)
        return sliding_min(self.chunk.grams("anchors")[self.a : self.b - ANCHOR + 1], WINDOW - ANCHOR + 1)

    def first_places(self, at: np.ndarray | None = None) -> np.ndarray:
        """First position of each distinct window, in order; of those at the given positions only."""
        w1 = self.windows("first")
        if at is not None:
            w1 = w1[at]
        if not len(w1):
            return np.zeros(0, np.int64)
        order = np.argsort(w1, kind="stable")
        rising = w1[order]
        same = rising[1:] == rising[:-1]
        if same.any():
            w2 = self.windows("second") if at is None else self.windows("second")[at]
            if (w2[order[1:]][same] != w2[order[:-1]][same]).any():
                # Windows that differ share their first hash: sort by both.
                order = np.lexsort((np.arange(len(w1)), w2, w1))
                same = (w1[order[1:]] == w1[order[:-1]]) & (w2[order[1:]] == w2[order[:-1]])
            order = order[np.concatenate([[True], ~same])]
        elif at is None:
            return np.arange(len(w1))
        return np.sort(order if at is None else at[order])


def _per_text(batch: pa.RecordBatch, column: int, salt: int) -> Iterator[_Text]:
    """Each text of a batch."""
    data, off = C.text_buffers(batch.column(column))
    for lo, hi in C.row_chunks(off):
        words = C.words_of(data, off, lo, hi, key=salt)
        chunk, first = _Chunk(words, salt), words.first.tolist()
        for i in range(hi - lo):
            yield _Text(lo + i, chunk, i, first[i], first[i + 1])


def _int_lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0] + [len(p) for p in parts]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(C.signed(np.concatenate([np.zeros(0, C.U), *parts]))))


def sketches(given: DataFrame, salt: int) -> DataFrame:
    """doc_id, row, n_words, s1 and s2 (128 bits of the SHA-256 of the words), prints and twice (its fingerprints; those that it holds in equal windows).

    given: doc_id, row, text.
    """

    def run(batches):
        for batch in batches:
            n, s1, s2, prints, twice = [], [], [], [], []
            texts = batch.column(2)
            for t in _per_text(batch, 2, salt):
                n.append(len(t))
                digest = hashlib.sha256(b" ".join(texts[t.row].as_buffer().to_pybytes().split())).digest()
                s1.append(int.from_bytes(digest[:8], "little", signed=True))
                s2.append(int.from_bytes(digest[8:16], "little", signed=True))
                f = t.fingerprints()
                prints.append(np.unique(f))
                first = t.first_places()
                if len(first) < len(f):
                    again = np.ones(len(f), bool)
                    again[first] = False
                    twice.append(np.unique(f[again]))
                else:
                    twice.append(f[:0])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), _int_lists(prints), _int_lists(twice)],
                ["doc_id", "row", "n_words", "s1", "s2", "prints", "twice"],
            )

    return C.map_batches(given, run, "doc_id long, row long, n_words long, s1 long, s2 long, prints array<long>, twice array<long>")


class SortedRuns:
    """Sorted immutable runs of rows, each a bucketed table in a folder; `fanout` runs of a level are merged into one of the next.

    merge: what makes one row of rows with equal keys, as columns of an aggregation.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], merge: list, buckets: int, fanout: int, runs: list[tuple[int, str]] = ()):
        self.spark, self.path, self.schema, self.keys, self.merge, self.buckets, self.fanout = spark, path, schema, keys, merge, buckets, fanout
        #: (level, name), oldest first.
        self.runs = [tuple(r) for r in runs]
        #: Tables of this session by the name of their run.
        self.tables: dict[str, str] = {}
        #: Runs that were merged into others: their files go once the manifest no longer names them.
        self.merged: list[str] = []

    def table(self, name: str) -> DataFrame:
        """A run as a bucketed table; one that another session wrote is declared over its files."""
        if name not in self.tables:
            held, by = f"run_{uuid.uuid4().hex}", self.keys[0]
            self.spark.sql(f"CREATE TABLE {held} ({self.schema}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{name}'")
            self.tables[name] = held
        return self.spark.table(self.tables[name])

    def write(self, rows: DataFrame) -> str:
        """A new run of rows, one for each key."""
        name, held, key = uuid.uuid4().hex, f"run_{uuid.uuid4().hex}", self.keys[0]
        one = rows.groupBy(*self.keys).agg(*self.merge)
        one.repartition(self.buckets, key).write.bucketBy(self.buckets, key).sortBy(key).format("parquet").option("path", f"{self.path}/{name}").saveAsTable(held)
        self.tables[name] = held
        return name

    def append(self, name: str) -> None:
        """Takes a run that is written into the list, and merges runs while a level has enough of them."""
        self.runs.append((0, name))
        while len(same := [r for level, r in self.runs if level == self.runs[-1][0]]) >= self.fanout:
            level, rows = self.runs[-1][0], None
            for r in same:
                part = self.table(r)
                rows = part if rows is None else rows.union(part)
            self.runs = [r for r in self.runs if r[0] != level] + [(level + 1, self.write(rows))]
            self.merged += same

    def clean(self) -> None:
        for name in self.merged:
            self.forget(name)
            C.drop_dir(self.spark, f"{self.path}/{name}")
        self.merged = []

    def forget(self, name: str) -> None:
        """Takes a table out of the session's catalog; its files stay."""
        if name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop(name)}")


class FingerprintIndex:
    """Fingerprints of all documents so far, and digests of whole documents, as sorted runs in a folder that all executors share.

    Opened on a folder that holds an index, it goes on with it: manifests are numbered, and the last that is
    complete names the runs. A run is written before the manifest that names it, so a job that dies leaves the index as it was.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None, fanout: int = FANOUT):
        self.spark, self.path = spark, path
        found = self._manifest()
        self.version = found.get("version", 0)
        self.salt = found.get("salt") or C.fresh_key()
        self.buckets = found.get("buckets") or buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        #: Largest doc_id taken in; a batch must begin behind it.
        self.last = found.get("last")

        def runs(name: str, schema: str, keys: list[str], *merge) -> SortedRuns:
            return SortedRuns(spark, f"{path}/{name}", schema, keys, list(merge), self.buckets, fanout, found.get(name, ()))

        least = F.min("doc_id").alias("doc_id")
        self.prints = runs("prints", "fp BIGINT, doc_id BIGINT, n BIGINT", ["fp"], least, F.sum("n").alias("n"))
        self.wholes = runs("wholes", "s1 BIGINT, s2 BIGINT, n_words BIGINT, doc_id BIGINT", ["s1", "s2", "n_words"], least)
        self.windows = runs("windows", "w1 BIGINT, w2 BIGINT, doc_id BIGINT", ["w1", "w2"], least)

    def _manifest(self) -> dict:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        files = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(at):
            return {}
        done = [x.getPath() for x in files.listStatus(at)]
        whole = [int(x.getName()) for x in done if files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS"))]
        return json.loads(self.spark.read.text(f"{self.path}/manifest/{max(whole)}").first()[0]) if whole else {}

    def commit(self) -> None:
        """Writes the next manifest, then deletes the files of merged runs."""
        self.version += 1
        text = json.dumps({"version": self.version, "salt": self.salt, "buckets": self.buckets, "last": self.last, "prints": self.prints.runs, "wholes": self.wholes.runs, "windows": self.windows.runs})
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/manifest/{self.version}")
        for runs in (self.prints, self.wholes, self.windows):
            runs.clean()

    def close(self) -> None:
        """Leaves the session's catalog as it was; the index stays in its folder."""
        for runs in (self.prints, self.wholes, self.windows):
            for name in list(runs.tables):
                runs.forget(name)

    def add_wholes(self, known: DataFrame, work: str) -> DataFrame:
        """(doc_id, row) of the rows of known with windows that are no copies of an earlier document, word for word."""
        fit = known.where(f"n_words >= {WINDOW} and doc_id is not null")
        own = self.wholes.write(fit.select("s1", "s2", "n_words", "doc_id"))
        new = self.wholes.table(own)
        for _, r in self.wholes.runs:
            new = new.join(self.wholes.table(r).select("s1", "s2", "n_words"), ["s1", "s2", "n_words"], "left_anti")
        # By doc_id as well, so that a text which a third of all rows hold is not one key.
        firsts = fit.join(new, ["s1", "s2", "n_words", "doc_id"], "left_semi")
        out = C.stored(firsts.select("doc_id", "row").distinct(), f"{work}/first")
        self.wholes.append(own)
        return out

    def add(self, batch: DataFrame, work: str) -> DataFrame:
        """Takes a batch (fp, doc_id, n) in; returns (doc_id, fp) of all fingerprints now known to occur more than once, in the batch and in history.

        n is 2 if the document holds equal windows under the fingerprint. Of an older run the first document with each such
        fingerprint is returned; further ones were returned with their own batch.
        """
        own = self.prints.write(batch)
        here = self.prints.table(own)
        old = None
        for _, run in self.prints.runs:
            met = self.prints.table(run).select("fp", "doc_id").join(here.select("fp"), "fp")
            old = met if old is None else old.union(met)
        again = here.where("n > 1").select("fp")
        if old is not None:
            old = C.stored(old, f"{work}/old")
            again = again.union(old.select("fp")).distinct()
        now = batch.join(again, "fp", "left_semi").select("doc_id", "fp")
        hits = C.stored(now if old is None else now.union(old.select("doc_id", "fp")), f"{work}/hits")
        self.prints.append(own)
        return hits

    def add_windows(self, windows: DataFrame) -> DataFrame:
        """Takes candidate windows (w1, w2, doc_id, ..) in; returns those that also start in an earlier document, of these or of history.

        Windows are complete for a fingerprint from the batch on in which it was first seen twice: those of the one document that
        held it until then must be among them.
        """
        own = self.windows.write(windows.select("w1", "w2", "doc_id"))
        new = self.windows.table(own)
        least = new
        for _, r in self.windows.runs:
            least = least.union(self.windows.table(r).join(new.select("w1", "w2"), ["w1", "w2"], "left_semi"))
        least = least.groupBy("w1", "w2").agg(F.min("doc_id").alias("least"))
        self.windows.append(own)
        return windows.join(least, ["w1", "w2"]).where("doc_id > least").drop("least")


def print_rows(known: DataFrame) -> DataFrame:
    """(fp, doc_id, n) as the index takes them."""
    return known.select("doc_id", "twice", F.explode("prints").alias("fp")).select("fp", "doc_id", (1 + F.array_contains("twice", F.col("fp")).cast("int")).alias("n"))


def candidate_prints(known: DataFrame, index: FingerprintIndex, work: str, batches: int = BATCHES) -> DataFrame:
    """(doc_id, fp): for each document its fingerprints that occur more than once, found batch by batch."""
    cuts = known.agg(F.percentile_approx("doc_id", [(b + 1) / batches for b in range(batches - 1)], 10_000).alias("c")).first().c if batches > 1 else []
    cuts = sorted(set(cuts or []))
    rows, hits = print_rows(known), None
    for k, (lo, hi) in enumerate(zip([None, *cuts], [*cuts, None])):
        part = rows
        if lo is not None:
            part = part.where(F.col("doc_id") > lo)
        if hi is not None:
            part = part.where(F.col("doc_id") <= hi)
        got = index.add(part, f"{work}/batch-{k}")
        # Without a manifest yet nothing needs the merged runs.
        index.prints.clean()
        hits = got if hits is None else hits.union(got)
    return hits


def candidate_windows(given: DataFrame, candidates: DataFrame, salt: int) -> DataFrame:
    """(w1, w2, doc_id, row, place): the windows under candidate fingerprints, with their own hashes and where each first starts.

    candidates: doc_id, row, prints.
    """

    def run(batches):
        for batch in batches:
            cols: list[list[np.ndarray]] = [[np.zeros(0, C.U)], [np.zeros(0, C.U)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]]
            ids, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            prints = batch.column(3)
            for t in _per_text(batch, 2, salt):
                if not prints[t.row].is_valid or len(t) < WINDOW:
                    continue
                at = np.flatnonzero(np.isin(t.fingerprints(), np.sort(np.asarray(prints[t.row].values).view(C.U))))
                if not len(at):
                    continue
                at = t.first_places(at)
                w1, w2 = t.windows("first"), t.windows("second")
                for col, x in zip(cols, (w1[at], w2[at], np.full(len(at), ids[t.row], np.int64), np.full(len(at), keys[t.row], np.int64), at.astype(np.int32))):
                    col.append(x)
            w1, w2, d, r, p = (np.concatenate(c) for c in cols)
            yield pa.RecordBatch.from_arrays([pa.array(C.signed(w1)), pa.array(C.signed(w2)), pa.array(d), pa.array(r), pa.array(p)], ["w1", "w2", "doc_id", "row", "place"])

    # A left join, as in the last step: both then read one shuffle of the texts.
    with_prints = given.join(candidates, ["doc_id", "row"], "left").select("doc_id", "row", "text", "prints")
    return C.map_batches(with_prints, run, "w1 long, w2 long, doc_id long, row long, place int")


def _places(later: DataFrame) -> DataFrame:
    return later.groupBy("doc_id", "row").agg(F.collect_list("place").alias("places"))


def repeated_places(windows: DataFrame) -> DataFrame:
    """(doc_id, row, places): starts of each row's windows that occur in an earlier document."""
    first = windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("least"))
    return _places(windows.join(first, ["w1", "w2"]).where("doc_id > least"))


def _kept(t: _Text, places: np.ndarray | None, copy: bool) -> np.ndarray:
    """Which words of a text stay."""
    n = len(t)
    stay = np.ones(n, bool)
    if n < WINDOW:
        return stay
    if copy:
        return np.zeros(n, bool)
    first, at = t.first_places(), np.zeros(0, np.int64)
    if len(first) < n - WINDOW + 1:
        gone = np.ones(n - WINDOW + 1, bool)
        gone[first] = False
        at = np.flatnonzero(gone)
    if places is not None and len(places):
        at = np.union1d(at, places)
    if len(at):
        steps = np.zeros(n + 1, np.int32)
        steps[at] += 1
        steps[at + WINDOW] -= 1
        stay = np.cumsum(steps[:n]) == 0
    return stay


def _joined(words: C.Words, i: int, stay: np.ndarray) -> bytes:
    """The words of text i that stay, joined by one space."""
    a, b = int(words.first[i]), int(words.first[i + 1])
    at = np.flatnonzero(stay) + a
    if not len(at):
        return b""
    lo, hi = int(words.starts[a]), int(words.ends[b - 1])
    steps = np.zeros(hi - lo + 2, np.int8)
    starts, ends = words.starts[at] - lo, words.ends[at] - lo
    # Each kept word and the byte behind it, which becomes the space.
    steps[starts] += 1
    np.add.at(steps, ends + 1, -1)
    part = np.full(hi - lo + 1, 32, np.uint8)
    part[: hi - lo] = words.data[lo:hi]
    part[ends] = 32
    return part[np.cumsum(steps[:-1]) > 0].tobytes()[:-1]


def _without_repeats(given: DataFrame, first: DataFrame, places: DataFrame, salt: int, digest: bool) -> DataFrame:
    told = first.withColumn("first", F.lit(True)).join(places, ["doc_id", "row"], "left")
    joined = given.join(told, ["doc_id", "row"], "left").select("doc_id", "text", "places", (F.col("doc_id").isNull() | F.coalesce("first", F.lit(False))).alias("first"))

    def run(batches):
        for batch in batches:
            n, removed, out = [], [], []
            places, firsts = batch.column(2), batch.column(3).to_pylist()
            for t in _per_text(batch, 1, salt):
                p = places[t.row]
                stay = _kept(t, np.asarray(p.values) if p.is_valid else None, not firsts[t.row])
                kept = _joined(t.chunk.words, t.i, stay)
                n.append(len(t))
                removed.append(len(t) - int(stay.sum()))
                out.append(hashlib.sha256(kept).hexdigest() if digest else kept.decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(out, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    done = C.map_batches(joined, run, "doc_id long, n_words long, n_removed long, kept string")
    return done.withColumnRenamed("kept", "kept_sha256") if digest else done.withColumnRenamed("kept", "text")


def _by_row(hits: DataFrame, first: DataFrame) -> DataFrame:
    """(doc_id, row, prints) of the rows that take part."""
    return hits.groupBy("doc_id").agg(F.collect_set("fp").alias("prints")).join(first, "doc_id").select("doc_id", "row", "prints")


def dedup_substrings(docs: DataFrame, key: str = "doc_id", text: str = "text", digest: bool = False, batches: int = BATCHES, work: str | None = None) -> DataFrame:
    """doc_id, n_words, n_removed and the kept text, or with digest its SHA-256 (kept_sha256), for every row."""
    spark = docs.sparkSession
    work = work or C.shared_dir(spark)
    given = C.keyed_texts(docs, key, text, row=True)
    index = FingerprintIndex(spark, f"{work}/index")
    try:
        known = C.stored(sketches(given, index.salt), f"{work}/known")
        # Of documents with the same words only the first takes part; the others lose everything.
        first = index.add_wholes(known, work)
        taking = known.join(first, ["doc_id", "row"], "left_semi").select("doc_id", "prints", "twice")
        candidates = C.stored(_by_row(candidate_prints(taking, index, work, batches), first), f"{work}/candidates")
    finally:
        index.close()
    C.drop_dir(spark, f"{work}/index")
    C.release(spark)
    places = repeated_places(candidate_windows(given, candidates, index.salt))
    return _without_repeats(given, first, places, index.salt, digest)


def add_batch(docs: DataFrame, history: DataFrame, path: str, key: str = "doc_id", text: str = "text", work: str | None = None) -> DataFrame:
    """doc_id, n_words, n_removed and the kept text of a batch, judged against all batches that the index at path has taken in.

    docs: the batch, whose doc_ids are larger than all before it, else ValueError. history: the documents of earlier
    batches, of which those are read that first share a fingerprint with this one.
    """
    spark = docs.sparkSession
    work = work or C.shared_dir(spark)
    index = FingerprintIndex(spark, path)
    try:
        given = C.keyed_texts(docs, key, text, row=True)
        known = C.stored(sketches(given, index.salt), f"{work}/known")
        ends = known.agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).first()
        if index.last is not None and ends.lo is not None and ends.lo <= index.last:
            raise ValueError(f"the batch begins at {ends.lo}, but the index holds documents up to {index.last}")
        first = index.add_wholes(known, work)
        hits = index.add(print_rows(known.join(first, ["doc_id", "row"], "left_semi")), f"{work}/batch")
        old_ids = C.stored(hits.join(first, "doc_id", "left_anti").select("doc_id").distinct(), f"{work}/old-ids")
        old = C.keyed_texts(history, key, text, row=True).join(old_ids, "doc_id", "left_semi")
        candidates = C.stored(_by_row(hits, first.union(old.select("doc_id", "row").distinct())), f"{work}/candidates")
        windows = C.stored(candidate_windows(given.union(old), candidates, index.salt), f"{work}/windows")
        places = C.stored(_places(index.add_windows(windows)).join(first, ["doc_id", "row"], "left_semi"), f"{work}/places")
        index.last = ends.hi if ends.hi is not None else index.last
        index.commit()
    finally:
        index.close()
    return _without_repeats(given, first, places, index.salt, False)
