"""Benchmark decontamination: SimHash of item-sized windows, then exact verification.

Words are runs of letters and digits with A-Z lower-cased; shingles are five words, and an
item of fewer words is one shingle as it is. For an item of n words every n-word window of a
text is a candidate; a text of fewer words is itself the one window, and the share is still
that of the item's shingles. A window gets a SimHash of 256 bits. The multi-index compares
fingerprints by BLOCKS blocks of 64 bits: two within RADIUS agree in one block at least up to
RADIUS // BLOCKS bits, and only those pairs are compared in full. Items within RADIUS are
verified by the weighted share of their shingles that the window holds, with multiplicity:
SIMILARITY or more is contamination.

Blocks that must be equal would have to be three bits wide for such a radius, and nearly every
pair shares one of those; of unrelated pairs 0.3 in a hundred agree in a block of 64 bits up to
19, and none of 240,000 is within RADIUS. Of windows that share 0.8 with an item about one in
fifty thousand is beyond it. Windows without a single shingle of an item of that size have
similarity 0 to all of them and get no fingerprint.

The benchmark is sent to executors in blocks of at most BLOCK_CHARS, one pass over the
texts for each block, so a large benchmark costs passes and not memory. Items without words
match nothing, and null and empty texts hold nothing; ties between windows go to the first;
repeated items and rows each match; empty tables give an empty result; extra columns are
ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

SHINGLE = 5
SIMILARITY = 0.8
BLOCKS, RADIUS = 4, 79
#: Benchmark text sent to executors at once.
BLOCK_CHARS = 16 << 20
#: Words of a text, and pairs of window and item, that are handled at once.
STRETCH, PAIRS = 8192, 1 << 20
_GATE_BITS = 20

SCHEMA = "doc_id long, item_id long, similarity double, distance int, start_word long, n_words long, row long"


def simhashes(grams: np.ndarray, starts: np.ndarray, m: int) -> np.ndarray:
    """SimHashes, BLOCKS numbers each, of the windows of m shingles at starts, which rise."""
    out, at = np.empty((len(starts), BLOCKS), C.U), 0
    while at < len(starts):
        # A stretch of the text at a time, whatever its length.
        lo = int(starts[at])
        to = int(np.searchsorted(starts, lo + STRETCH))
        part = grams[lo : int(starts[to - 1]) + m]
        lanes = np.stack([C.mix(part ^ C._MULT[j]) for j in range(BLOCKS)], axis=1)
        sums = np.zeros((len(part) + 1, 64 * BLOCKS), np.int32)
        np.cumsum(np.unpackbits(lanes.view(np.uint8), axis=1), axis=0, out=sums[1:])
        first = starts[at:to] - lo
        out[at:to] = np.packbits(2 * (sums[first + m] - sums[first]) > m, axis=1).view("<u8")
        at = to
    return out


class MultiIndex:
    """Fingerprints of BLOCKS blocks; finds all within RADIUS."""

    def __init__(self, prints: np.ndarray):
        self.prints = prints

    def proposed(self, prints: np.ndarray) -> np.ndarray:
        """Pairs (position in prints * size of the index + position in the index) that agree in a block up to RADIUS // BLOCKS bits."""
        n, out = len(self.prints), [np.zeros(0, np.int64)]
        step = max(1, PAIRS // max(n, 1))
        for at in range(0, len(prints), step):
            part = prints[at : at + step]
            near = np.zeros((len(part), n), bool)
            for j in range(BLOCKS):
                near |= np.bitwise_count(part[:, j, None] ^ self.prints[None, :, j]) <= RADIUS // BLOCKS
            out.append(np.flatnonzero(near) + at * n)
        return np.concatenate(out)

    def find(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position in prints, position in the index, distance) of all pairs within RADIUS."""
        a, b = np.divmod(self.proposed(prints), max(len(self.prints), 1))
        distance = np.bitwise_count(prints[a] ^ self.prints[b]).sum(axis=1, dtype=np.int64)
        near = distance <= RADIUS
        return a[near], b[near], distance[near]


class Benchmark:
    """Items that share a shingle length: all of SHINGLE words or more, or all of `shingle` words."""

    def __init__(self, items: list[tuple[int, np.ndarray]], shingle: int):
        self.shingle = shingle
        by_size: dict[int, list[tuple[int, np.ndarray]]] = defaultdict(list)
        for item_id, h in items:
            by_size[len(h)].append((item_id, C.gram_hashes(h, shingle)))
        self.sizes = {}
        grams, sizes = [np.zeros(0, C.U)], [np.zeros(0, np.int64)]
        for n, held in sorted(by_size.items()):
            prints = np.concatenate([simhashes(g, np.zeros(1, np.int64), len(g)) for _, g in held])
            self.sizes[n] = ([i for i, _ in held], [Counter(g.tolist()) for _, g in held], MultiIndex(prints))
            own = np.unique(np.concatenate([g for _, g in held]))
            grams.append(own)
            sizes.append(np.full(len(own), n))
        # Each shingle with the sizes of the items that hold it, sorted by shingle.
        grams, sizes = np.concatenate(grams), np.concatenate(sizes)
        order = np.argsort(grams, kind="stable")
        self.grams, self.gram_sizes = grams[order], sizes[order]
        self.gate = np.zeros(1 << _GATE_BITS, bool)
        self.gate[(self.grams >> C.U(64 - _GATE_BITS)).astype(np.int64)] = True

    @staticmethod
    def of(items: list[tuple[int, str]], salt: int) -> list[Benchmark]:
        """The items by shingle length; those without words are left out."""
        held = defaultdict(list)
        for item_id, text in items:
            data, off = C.text_buffers(pa.array([text or ""]))
            h = C.Words(data, off, lower=True, marks=True, key=salt).hashes
            if len(h):
                held[min(SHINGLE, len(h))].append((item_id, h))
        return [Benchmark(x, k) for k, x in sorted(held.items())]

    def hits(self, grams: np.ndarray) -> np.ndarray:
        """Positions whose shingle is in some item."""
        at = np.flatnonzero(self.gate[(grams >> C.U(64 - _GATE_BITS)).astype(np.int64)])
        if len(at):
            left = np.searchsorted(self.grams, grams[at])
            at = at[(left < len(self.grams)) & (self.grams[np.minimum(left, len(self.grams) - 1)] == grams[at])]
        return at

    def matches(self, grams: np.ndarray, hits: np.ndarray) -> list[tuple[int, float, int, int, int]]:
        """(item_id, similarity, distance, first word, words) for one text; hits are positions in it."""
        n = len(grams)
        lo = np.searchsorted(self.grams, grams[hits], "left")
        hi = np.searchsorted(self.grams, grams[hits], "right")
        by_size: dict[int, list[int]] = defaultdict(list)
        for p, a, b in zip(hits.tolist(), lo.tolist(), hi.tolist()):
            for size in set(self.gram_sizes[a:b].tolist()):
                by_size[size].append(p)
        out = []
        for size, at in by_size.items():
            m = size - self.shingle + 1
            # A shorter text is its own window.
            width = min(m, n)
            marks = np.zeros(n + 1, np.int32)
            marks[np.array(at) + 1] = 1
            run = np.cumsum(marks)
            starts = np.flatnonzero(run[width:] - run[: n + 1 - width] > 0)
            ids, held, index = self.sizes[size]
            w, i, distance = index.find(simhashes(grams, starts, width))
            best: dict[int, tuple[float, int, int]] = {}
            for s, k, d in zip(starts[w].tolist(), i.tolist(), distance.tolist()):
                window = Counter(grams[s : s + width].tolist())
                share = sum(min(c, window[g]) for g, c in held[k].items() if g in window) / m
                if share >= SIMILARITY and (k not in best or share > best[k][0]):
                    best[k] = (share, d, s)
            out += [(ids[k], share, d, s, width + self.shingle - 1) for k, (share, d, s) in best.items()]
        return out


def _items(benchmark: DataFrame) -> list[DataFrame]:
    """The benchmark in blocks of at most about BLOCK_CHARS."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-chars // BLOCK_CHARS)
    return [items] if n <= 1 else [items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b) for b in range(n)]


def find_contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document and item that it holds: similarity, SimHash distance, the best window in words, and the document's row key."""
    spark, salt = docs.sparkSession, C.fresh_key()
    given, out = C.keyed_texts(docs, key, text, row=True), None
    for block in _items(benchmark):
        sent = spark.sparkContext.broadcast([tuple(r) for r in block.collect()])

        def run(batches, sent=sent):
            held = Benchmark.of(sent.value, salt)
            for batch in batches:
                data, off = C.text_buffers(batch.column(2))
                ids, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                rows = []
                for lo, hi in C.row_chunks(off):
                    words = C.words_of(data, off, lo, hi, lower=True, marks=True, key=salt)
                    for bench in held:
                        grams = C.gram_hashes(words.hashes, bench.shingle)
                        at = bench.hits(grams)
                        doc = np.searchsorted(words.first, at, "right") - 1
                        for d in np.unique(doc).tolist():
                            a, b = int(words.first[d]), int(words.first[d + 1]) - bench.shingle + 1
                            own = at[(doc == d) & (at < b)] - a
                            if len(own):
                                rows += [(ids[lo + d], *x, keys[lo + d]) for x in bench.matches(grams[a:b], own)]
                cols = list(zip(*rows)) or [[]] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "item_id", "similarity", "distance", "start_word", "n_words", "row"])

        found = C.map_batches(given, run, SCHEMA)
        out = found if out is None else out.union(found)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows whose text holds an item, with or without an id; the hits are stored and taken away by an anti join."""
    hits = find_contamination(docs, benchmark).select(F.col("doc_id").alias("_hit_id"), F.col("row").alias("_hit_row")).distinct()
    hits = C.stored(hits, f"{C.shared_dir(docs.sparkSession)}/hits")
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("_hit_id")) & (C.row_key("doc_id", "text") == F.col("_hit_row"))
    return docs.join(hits, same, "left_anti").select(*docs.columns)
