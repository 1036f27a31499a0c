"""N-gram Jaccard join by parity sketches.

A document is its set of distinct k-word shingles; two link when
100 * |A n B| >= percent * |A u B|. With J = percent / 100 that bounds the symmetric
difference: |A ^ B| <= (1 - J) / (1 + J) * (|A| + |B|).

Parity sketches: the shingles of a set are dealt by hash to the blocks of a sketch, and
each block is the XOR of the 64-bit hashes dealt to it. Every shingle in which two sets
differ changes one block, so the number of unequal blocks, like the Hamming distance of
single-bit sketches, is a lower bound of the symmetric difference. Sets are sorted into
size bands; a pair of bands has a largest difference d, and sketches of d + 1 + spare
blocks have at least 1 + spare equal blocks for every pair that links. Equal blocks are
found by one shuffle of block values (pigeonhole join). A block that is empty in a set
says nothing and is not sent: if either set of a pair has at most `spare` empty blocks,
one of their equal blocks is not empty. Sets with more go on to the next level, a sketch
of the same shape under another hash; both sets of a pair that the first level could miss
do. At the last of LEVELS, which few in a million reach, empty blocks are sent as well.

Pairs that share a block are pruned by 512-bit parity sketches and then verified on the
shingles of their texts. Documents with equal sets form one class and only classes are
joined. Within a block all members are first joined to its smallest member, then to its
largest, and after each round members already connected need no further test; what is
left is compared by sketch inside the join of the block with itself, and only pairs that
may link come out of it. So no link between different texts is lost, and a group of near
copies costs about as many rows as it has members, not their square.

Shingles are hashed to 64 bits under a key drawn for each run, in a way that is not linear
in the words; sizes and candidates rest on these hashes, links on the words themselves.

Null and empty texts have no shingles, link with nothing and are their own component;
with fewer than k words the whole sequence is the one shingle. Every row counts by its own
text: rows that share an id are told apart by a row key, each links as its text does, and
equal rows repeat their result. A row without an id links like any other and gets the
smallest id of its component, null if no row of it has one. Ties go to the smallest
doc_id; extra columns are ignored and an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

SKETCH_WORDS = 8
#: Sketches under different hashes for sets with too many empty blocks, and the share of sets that may go on to the next.
LEVELS, GO_ON = 5, 0.05


def shingle_sets(words: C.Words, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    grams = C.gram_hashes(words.hashes, k)
    first = words.first
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= k:
            yield np.unique(grams[a : b - k + 1])
        elif b > a:
            yield C.gram_hashes(words.hashes[a:b], b - a)
        else:
            yield np.zeros(0, C.U)


def class_id(s: np.ndarray, which: int = 0) -> int:
    """64-bit identity of a set; which: 0 or, for the few ids that two sets share, 1."""
    if not len(s):
        return 0
    with np.errstate(over="ignore"):
        return int(C.signed(C.mix(np.array([np.add.reduce(C.mix(s ^ C._MULT[4 - which])) + C.U(len(s))])))[0])


class Bands:
    """Size bands and the sketches of each pair of neighbouring bands, for a similarity of percent / 100."""

    def __init__(self, percent: int):
        self.percent = percent
        self.known: dict[int, list[tuple[int, int, int]]] = {}

    def largest_partner(self, n: int) -> int:
        return 100 * n // self.percent

    def difference(self, total: int) -> int:
        """Largest symmetric difference of a linked pair whose sizes add up to total."""
        return (100 - self.percent) * total // (100 + self.percent)

    def start(self, n: int) -> int:
        """First size of n's band; band starts are 1 and then each largest partner plus one."""
        a = 1
        while (b := self.largest_partner(a) + 1) <= n:
            a = b
        return a

    def schemes(self, n: int) -> list[tuple[int, int, int]]:
        """(first, difference, spare) of the sketches a set of n takes part in: as the smaller and as the larger of a pair.

        A scheme is known by the first size of the smaller set's band.
        """
        if n not in self.known:
            own = self.start(n)
            out = [own]
            if own > 1 and self.largest_partner(own - 1) >= n:
                out.append(self.start(own - 1))
            self.known[n] = [(a, d := self.difference((e := self.largest_partner(a)) + self.largest_partner(e)), self.spare(a, d)) for a in out]
        return self.known[n]

    @staticmethod
    def spare(n: int, d: int) -> int:
        """Spare blocks with which at most GO_ON of the sets of n have more empty blocks, or the best there are."""
        best, at = 2.0, 0
        for s in range(d // 3 + 4):
            blocks = d + 1 + s
            mean = blocks * (1 - 1 / blocks) ** n
            term, some = math.exp(-mean), 0.0
            for k in range(s + 1):
                some += term
                term *= mean / (k + 1)
            if 1 - some < best:
                best, at = 1 - some, s
            if best <= GO_ON:
                break
        return at


def block_keys(s: np.ndarray, bands: Bands) -> list[np.ndarray]:
    """Keys of the blocks that a set sends: a hash of scheme, level, block number and XOR."""
    out = []
    for first, d, spare in bands.schemes(len(s)):
        blocks = d + 1 + spare
        for level in range(LEVELS):
            seed = C.U((first * LEVELS + level) * int(C._MULT[3]) % 2**64)
            h = C.mix(s + seed)
            at = ((h >> C.U(32)) * C.U(blocks)) >> C.U(32)
            order = np.argsort(at, kind="stable")
            at, h = at[order].astype(np.int64), C.mix(s[order] ^ C._MULT[2])
            edge = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            full, xor = at[edge], np.bitwise_xor.reduceat(h, edge)
            done = blocks - len(full) <= spare
            if not done and level == LEVELS - 1:
                missing = np.setdiff1d(np.arange(blocks), full)
                full, xor = np.r_[full, missing], np.r_[xor, np.zeros(len(missing), C.U)]
            out.append(C.mix(xor ^ C.mix(full.astype(C.U) * C._MULT[1] + seed)))
            if done:
                break
    return out


def sketch(s: np.ndarray) -> np.ndarray:
    """512 parity bits of a set."""
    bits = np.bincount((C.mix(s ^ C._MULT[1]) & C.U(64 * SKETCH_WORDS - 1)).astype(np.int64), minlength=64 * SKETCH_WORDS) & 1
    return np.packbits(bits.astype(bool)).view(np.int64)


def classes(docs: DataFrame, k: int, key: str = "doc_id", text: str = "text", salt: int = 0) -> DataFrame:
    """(doc_id, row, n, cls, other, sketch): the shingle set of every document; other is a second identity. salt: key of the word hashes."""

    def run(batches):
        for batch in batches:
            data, off = C.text_buffers(batch.column(2))
            n, cls, other, parity = [], [], [], []
            for lo, hi in C.row_chunks(off):
                for s in shingle_sets(C.words_of(data, off, lo, hi, lower=True, key=salt), k):
                    n.append(len(s))
                    cls.append(class_id(s))
                    other.append(class_id(s, 1))
                    parity.append(sketch(s))
            flat = pa.array(np.concatenate(parity) if parity else np.zeros(0, np.int64))
            offsets = pa.array(np.arange(len(n) + 1, dtype=np.int32) * SKETCH_WORDS)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(other, pa.int64()), pa.ListArray.from_arrays(offsets, flat)], ["doc_id", "row", "n", "cls", "other", "sketch"])

    return C.map_batches(C.keyed_texts(docs, key, text, row=True), run, "doc_id long, row long, n long, cls long, other long, sketch array<long>")


def block_rows(docs: DataFrame, k: int, percent: int, clashing: frozenset[int], text: str = "text", salt: int = 0) -> DataFrame:
    """(block, cls): what every class sends to the pigeonhole join; a class is left out where this task has sent it already."""

    def run(batches):
        bands = Bands(percent)
        sent: set[int] = set()
        for batch in batches:
            data, off = C.text_buffers(batch.column(0))
            keys, cls, times = [np.zeros(0, C.U)], [], []
            for lo, hi in C.row_chunks(off):
                for s in shingle_sets(C.words_of(data, off, lo, hi, lower=True, key=salt), k):
                    c = class_id(s)
                    if c in clashing:
                        c = class_id(s, 1)
                    if not len(s) or c in sent:
                        continue
                    if len(sent) > 500_000:
                        sent.clear()
                    sent.add(c)
                    for v in block_keys(s, bands):
                        keys.append(v)
                        cls.append(c)
                        times.append(len(v))
            yield pa.RecordBatch.from_arrays([pa.array(C.signed(np.concatenate(keys))), pa.array(np.repeat(np.array(cls, np.int64), np.array(times, np.int64)))], ["block", "cls"])

    texts = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return C.map_batches(texts, run, "block long, cls long")


def word_shingles(text: str, k: int) -> set[tuple[bytes, ...]]:
    """The shingles of a text as words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    return set(zip(*(words[i:] for i in range(k)))) if len(words) >= k else {tuple(words)} if words else set()


def verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that link, tested on the words of one text of each.

    texts: (cls, text) of the classes in pairs. A class's text goes to each of its pairs, so a pair is one row.
    """
    left = texts.select(F.col("cls").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("cls").alias("b"), F.col("text").alias("tb"))

    def run(batches):
        for batch in batches:
            keep = []
            kept: tuple[object, set] = (None, set())
            for a, ta, tb in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3)):
                if kept[0] != a:
                    kept = (a, word_shingles(ta.as_py(), k))
                x, y = kept[1], word_shingles(tb.as_py(), k)
                both = len(x & y)
                keep.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    full = pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb")
    return C.map_batches(full, run, "a long, b long")


def told_apart(known: DataFrame) -> tuple[DataFrame, frozenset[int]]:
    """known with the second identity where two sets share the first, and those ids.

    Of n sets about n * n / 2**65 pairs share a 64-bit id: none below a billion documents, a few dozen at 10**10.5.
    """
    shared = known.groupBy("cls").agg(F.min("other").alias("lo"), F.max("other").alias("hi")).where("lo < hi").select("cls")
    clashing = frozenset(r.cls for r in shared.collect())
    if not clashing:
        return known, clashing
    return known.withColumn("cls", F.when(F.col("cls").isin(list(clashing)), F.col("other")).otherwise(F.col("cls"))), clashing


def link_classes(docs: DataFrame, known: DataFrame, clashing: frozenset[int], k: int, percent: int, work: str, key: str = "doc_id", text: str = "text", salt: int = 0) -> DataFrame:
    """(node, label) over linked classes: label is the smallest class of the component. known: classes(); work: a folder of this step alone."""
    spark = docs.sparkSession
    bands = Bands(percent)
    one = known.where("n > 0").groupBy("cls").agg(F.min(F.struct("doc_id", "row")).alias("at"), F.any_value("n").alias("n"), F.any_value("sketch").alias("sketch"))
    rows = block_rows(docs, k, percent, clashing, text, salt)
    # Stored by itself: the shuffle of all block values is gone before the next one is made, as both take most of the disk.
    shared = rows.groupBy("block").agg(F.min("cls").alias("least"), F.max("cls").alias("most")).where("least < most")
    shared = C.stored(shared.select("block"), f"{work}/blocks")
    members = C.stored(rows.join(shared, "block").distinct(), f"{work}/members")
    C.drop_dir(spark, f"{work}/blocks")
    one = C.stored(one.join(members.select("cls").distinct(), "cls", "left_semi"), f"{work}/classes")
    # One text of each class; of equal rows, which share the row key, the first that a task meets.
    place = one.select("cls", F.col("at.doc_id").alias("at_id"), F.col("at.row").alias("at_row"))
    texts = C.keyed_texts(docs, key, text, row=True).join(place, F.col("doc_id").eqNullSafe(F.col("at_id")) & (F.col("row") == F.col("at_row")))
    texts = texts.select("cls", "text").groupBy("cls").agg(F.first("text").alias("text"))
    texts = C.stored(texts, f"{work}/texts")
    facts = one.select("cls", "n", *[F.col("sketch")[i].alias(f"s{i}") for i in range(SKETCH_WORDS)])

    def side(of: str) -> DataFrame:
        """facts with all names ending in of."""
        return facts.select(*[F.col(c).alias(f"{c}_{of}") for c in facts.columns])

    # What sizes and parity sketches say of a pair: whether it may link.
    distance = sum((F.bit_count(F.col(f"s{i}_a").bitwiseXOR(F.col(f"s{i}_b"))) for i in range(1, SKETCH_WORDS)), F.bit_count(F.col("s0_a").bitwiseXOR(F.col("s0_b"))))
    fits = (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")) & ((100 + percent) * distance <= (100 - percent) * (F.col("n_a") + F.col("n_b")))

    def relabelled(lab: DataFrame | None) -> DataFrame:
        """(block, cls, label) of the blocks in which more than one component is left."""
        if lab is None:
            return members.withColumn("label", F.col("cls"))
        m = members.join(lab.withColumnRenamed("node", "cls"), "cls", "left").select("block", "cls", F.coalesce("label", "cls").alias("label"))
        open_ = m.groupBy("block").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("block")
        return m.join(open_, "block", "left_semi")

    links, lab, tested = None, None, None
    for turn in ("least", "most", "all"):
        m = C.stored(relabelled(lab), f"{work}/open-{turn}") if lab is not None else relabelled(None)
        if turn == "all":
            # Members are compared by their sketches inside the join: only what may link becomes a row.
            full = C.stored(m.withColumnRenamed("cls", "cls_a").join(side("a"), "cls_a"), f"{work}/sketched")
            other = full.select("block", *[F.col(c).alias(c.removesuffix("_a") + "_b") for c in full.columns if c != "block"])
            new = full.join(other, (full["block"] == other["block"]) & (F.col("cls_a") < F.col("cls_b")) & (F.col("label") != F.col("label_b")) & fits)
            new = new.select(F.col("cls_a").alias("a"), F.col("cls_b").alias("b")).distinct()
        else:
            hub = m.groupBy("block").agg((F.min if turn == "least" else F.max)(F.struct("cls", "label")).alias("hub"))
            met = m.join(hub, "block").where("label != hub.label")
            pairs = met.select(F.least("cls", "hub.cls").alias("cls_a"), F.greatest("cls", "hub.cls").alias("cls_b")).distinct()
            new = pairs.join(side("a"), "cls_a").join(side("b"), "cls_b").where(fits).select(F.col("cls_a").alias("a"), F.col("cls_b").alias("b"))
        if tested is not None:
            new = new.join(tested, ["a", "b"], "left_anti")
        new = C.stored(new, f"{work}/pairs-{turn}")
        if new.isEmpty():
            continue
        tested = new if tested is None else tested.union(new)
        found = C.stored(verified(new, texts, k, percent), f"{work}/links-{turn}")
        links = found if links is None else links.union(found)
        lab = C.components(spark, links, f"{work}/components-{turn}")
    return lab if lab is not None else spark.createDataFrame([], "node long, label long")


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text", work: str | None = None, row: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links reach, itself included) of every document; row: with the row key."""
    spark = docs.sparkSession
    work = work or C.shared_dir(spark)
    salt = C.fresh_key()
    known, clashing = told_apart(C.stored(classes(docs, k, key, text, salt), f"{work}/known"))
    lab = link_classes(docs, known, clashing, k, percent, f"{work}/linked", key, text, salt)
    least = known.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("least"))
    least = least.join(lab.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "least", F.coalesce("label", "cls").alias("label"))
    root = C.stored(least, f"{work}/least")
    top = root.groupBy("label").agg(F.min("least").alias("component_id"))
    of = C.stored(root.join(top, "label").select("cls", "component_id"), f"{work}/roots")
    C.drop_dir(spark, f"{work}/linked", f"{work}/least")
    found = known.select("doc_id", "row", "n", "cls").join(of, "cls", "left")
    return found.select("doc_id", *(["row"] if row else []), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_first(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each component, the one with the smallest doc_id; the schema stays.

    Of rows with that id only those stay that have the smallest row key, so equal rows stay together;
    rows without an id stay.
    """
    found = jaccard_components(docs, k, percent, row=True).where("doc_id is not null and n_shingles > 0")
    # Of the few rows that share their component's id, the smallest row key.
    named = found.where("doc_id = component_id").groupBy("component_id").agg(F.min("row").alias("least"), F.max("row").alias("most")).where("least < most").select("component_id", "least")
    second = found.where("doc_id = component_id").join(named, "component_id").where("row > least").select("doc_id", "row")
    gone = found.where("doc_id <> component_id").select("doc_id", "row").union(second).distinct()
    gone = gone.select(F.col("doc_id").alias("_gone_id"), F.col("row").alias("_gone_row"))
    same = (docs["doc_id"].cast("long") == F.col("_gone_id")) & (C.row_key("doc_id", "text") == F.col("_gone_row"))
    return docs.join(gone, same, "left_anti").select(*docs.columns)
