"""Line dedup by a deletion-neighbourhood join.

A line's words are its runs of characters without white space. Two lines are alike when
their words are equal, or when one becomes the other by one word edit (a word put in,
taken out or replaced) that is at most a fifth of the longer line, i.e. from LONGER words
on; below that one edit leaves a similarity under 0.8. A line goes when an earlier line
(smaller doc_id, then row key, then line number) is alike; lines are judged on the input,
not on what is left. Lines without a word always stay.

Equal lines are first folded into one entry with its earliest place; they are known by 128
bits of a BLAKE2 digest of their words. Each distinct line emits its neighbourhood as hashed
keys: itself, and itself without each of its words. Two lines that share the variant
without word i, deleted at the same i, differ in that word at most; a line that equals
another's variant is that line with a word taken out. So for every key the earliest place
is enough, nothing is paired, and a frequent key costs one partial minimum per task. As
hashes propose, the earliest line is verified word by word before a line goes. Keys are
polynomials modulo 2**61 - 1 under a base drawn for each run; a pair is lost only if such
a key is shared by chance with a line that is not alike.

Most lines have no neighbour. Before variants are emitted, a distinct line must agree with
another one in all but one of PIECES pieces: two lines of n and n or n - 1 words that are
alike differ inside one piece of the longer one, and have the words before and behind it in
common. This loses no pair; only the words of the pieces that may differ are then taken
out, which keeps the join small.

Texts are joined to what was found out about them by sort-merge joins at every size: the
lists of lines grow with the corpus and are never sent to all executors.

Null and empty texts have no lines to lose. Rows that share a doc_id are told apart by their
row key, in whose order their lines stand; equal rows share it and their places, so they
keep the same lines. A row without a doc_id has no place: it loses nothing and nothing is
compared with it. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: The longer of two lines that differ by an edit has this many words at least: one edit is then a fifth of it or less.
LONGER = 5
PIECES = 2
#: Piece keys of a line: as one of n words and as the shorter one beside a line of n + 1.
KEYS = 2 * PIECES


class _Lines:
    """Lines with words of a chunk of texts, with hashes of any range of their words."""

    def __init__(self, words: C.Words, offsets: np.ndarray, salt: int):
        feeds = np.flatnonzero(words.data == 10)
        n_texts = len(offsets) - 1
        text = np.repeat(np.arange(n_texts), np.diff(words.first))
        number = np.searchsorted(feeds, words.starts) - np.searchsorted(feeds, offsets[:-1])[text]
        # A line is a run of words with the same text and line number.
        edge = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (number[1:] != number[:-1])]) if len(text) else np.zeros(0, np.int64)
        self.a, self.b = edge, np.r_[edge[1:], len(text)].astype(np.int64) if len(text) else edge
        self.words, self.ranges = words, C.Ranges(words.hashes, salt)
        self.text, self.number = text[self.a], number[self.a]
        self.n = self.b - self.a

    def digests(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of each line's words."""
        data, w = self.words.data.tobytes(), self.words
        ends = w.ends[self.b - 1] if len(self.b) else self.b
        out = b"".join([hashlib.blake2b(b" ".join(data[x:y].split()), digest_size=16).digest() for x, y in zip(w.starts[self.a].tolist(), ends.tolist())])
        both = np.frombuffer(out, "<i8").reshape(-1, 2)
        return both[:, 0], both[:, 1]

    def keys(self) -> np.ndarray:
        """Hash of each line's words, as the neighbourhood join knows it."""
        return C.mix(self.ranges.between(self.a, self.b) + self.n.astype(C.U) * C._MULT[3])

    def piece_keys(self) -> tuple[np.ndarray, np.ndarray]:
        """For each line and (longer line of n or n + 1 words, piece): hash of the words before and behind the piece, and whether there is such a pair."""
        out, valid = np.zeros((len(self.a), KEYS), C.U), np.zeros((len(self.a), KEYS), bool)
        for more in (0, 1):
            longer = self.n + more
            for i in range(PIECES):
                before, behind = piece_bounds(longer, i)
                behind = longer - behind
                key = C.mix(self.ranges.between(self.a, self.a + before)) * C._MULT[0] + C.mix(self.ranges.between(self.b - behind, self.b)) * C._MULT[1]
                out[:, more * PIECES + i] = C.mix(key + longer.astype(C.U) * C._MULT[2] + C.U(i))
                valid[:, more * PIECES + i] = longer >= LONGER
        return out, valid

    def variants(self, open_: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(line, key with the word's position in it, key without) of the lines without single words.

        open_: for each line the numbers of the piece keys that another line shares; only words of those pieces are taken out.
        """
        taken = [np.zeros((2, 0), np.int64)]
        for line, numbers in enumerate(open_):
            n = int(self.n[line])
            for k in numbers:
                if k < PIECES:
                    x, y = piece_bounds(n, k)
                    taken.append(np.stack([np.full(y - x, line), np.arange(x, y)]))
        line, place = np.concatenate(taken, axis=1)
        a, b, n = self.a[line], self.b[line], self.n[line]
        # The words behind the one taken out move up by one.
        key = C._reduced(self.ranges.between(a, a + place) + self.ranges.between(a + place + 1, b, a + 1))
        plain = C.mix(key + (n - 1).astype(C.U) * C._MULT[3])
        return line, C.mix(plain ^ C.mix(place.astype(C.U) + C._MULT[2])), plain


def piece_bounds(n, i: int):
    """Words before piece i of a line of n words, and words up to its end."""
    return n * i // PIECES, n * (i + 1) // PIECES


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text", salt: int = 0) -> DataFrame:
    """(line, check, k0 .., doc_id, row, number) of every line with words; line and check are its digest, k0 .. its piece keys or null."""

    def run(batches):
        for batch in batches:
            data, off = C.text_buffers(batch.column(2))
            ids, rows = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            cols: list[list[np.ndarray]] = [[] for _ in range(5)]
            pieces, valid = [np.zeros((0, KEYS), C.U)], [np.zeros((0, KEYS), bool)]
            for lo, hi in C.row_chunks(off):
                found = _Lines(C.words_of(data, off, lo, hi, key=salt), off[lo : hi + 1] - off[lo], salt)
                for col, x in zip(cols, (*found.digests(), ids[lo:hi][found.text], rows[lo:hi][found.text], found.number)):
                    col.append(x)
                keys, there = found.piece_keys()
                pieces.append(keys)
                valid.append(there)
            line, check, doc, row, number = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in cols)
            keys, there = np.concatenate(pieces), np.concatenate(valid)
            yield pa.RecordBatch.from_arrays(
                [pa.array(line), pa.array(check), *[pa.array(C.signed(keys[:, i]), mask=~there[:, i]) for i in range(KEYS)], pa.array(doc.astype(np.int64)), pa.array(row.astype(np.int64)), pa.array(number.astype(np.int32))],
                ["line", "check", *[f"k{i}" for i in range(KEYS)], "doc_id", "row", "number"],
            )

    given = C.keyed_texts(docs, key, text, row=True).where("doc_id is not null")
    return C.map_batches(given, run, f"line long, check long, {', '.join(f'k{i} long' for i in range(KEYS))}, doc_id long, row long, number int")


def line_texts(docs: DataFrame, wanted: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(line, check, doc_id, row, number, shared, content) of the wanted lines. wanted: doc_id, row and list of (number, line, check, shared)."""

    def run(batches):
        for batch in batches:
            out = []
            for d, r, t, want in zip(*(c.to_pylist() for c in batch.columns)):
                parts = t.split("\n")
                out += [(w["line"], w["check"], d, r, w["number"], w["shared"], parts[w["number"]]) for w in want]
            cols = list(zip(*out)) or [[]] * 7
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["line", "check", "doc_id", "row", "number", "shared", "content"])

    given = C.keyed_texts(docs, key, text, row=True).join(wanted.hint("merge"), ["doc_id", "row"]).select("doc_id", "row", "text", "wanted")
    return C.map_batches(given, run, "line long, check long, doc_id long, row long, number int, shared array<int>, content string")


def neighbourhood(texts: DataFrame, salt: int) -> DataFrame:
    """(kind, key, line, check, doc_id, row, number): kind 0 without word i, i in the key; 1 the line itself; 2 without a word."""

    def run(batches):
        for batch in batches:
            ids = [np.asarray(batch.column(i)) for i in range(5)]
            kinds, keys, which = [np.zeros(0, np.int8)], [np.zeros(0, C.U)], [np.zeros(0, np.int64)]
            data, off = C.text_buffers(batch.column(6))
            shared = batch.column(5).to_pylist()
            for lo, hi in C.row_chunks(off):
                # Every content is one line with words.
                found = _Lines(C.words_of(data, off, lo, hi, key=salt), off[lo : hi + 1] - off[lo], salt)
                line, marked, plain = found.variants(shared[lo:hi])
                n = hi - lo
                keys += [marked, found.keys(), plain]
                kinds.append(np.repeat(np.array([0, 1, 2], np.int8), [len(marked), n, len(plain)]))
                which += [lo + line, np.arange(lo, hi), lo + line]
            at = np.concatenate(which)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(kinds)), pa.array(C.signed(np.concatenate(keys))), *[pa.array(x[at]) for x in ids]],
                ["kind", "key", "line", "check", "doc_id", "row", "number"],
            )

    return C.map_batches(texts.select("line", "check", "doc_id", "row", "number", "shared", "content"), run, "kind byte, key long, line long, check long, doc_id long, row long, number int")


def within_one_edit(a: list[bytes], b: list[bytes]) -> bool:
    """Whether one word edit at most turns a into b."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :]
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(line, check) of the lines whose proposed earlier line is alike. pairs: line, check, line_y, check_y."""
    x = texts.select("line", "check", F.col("content").alias("cx"))
    y = texts.select(F.col("line").alias("line_y"), F.col("check").alias("check_y"), F.col("content").alias("cy"))

    def run(batches):
        for batch in batches:
            ok = [within_one_edit(_words(cx), _words(cy)) for cx, cy in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["line", "check"]).filter(pa.array(ok, pa.bool_()))

    full = pairs.join(x, ["line", "check"]).join(y, ["line_y", "check_y"]).select("line", "check", "cx", "cy")
    return C.map_batches(full, run, "line long, check long").distinct()


def _words(line: str) -> list[bytes]:
    return line.encode("utf-8", "surrogatepass").split()


def removed_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", work: str | None = None) -> DataFrame:
    """(doc_id, row, numbers): the line numbers, from 0, that go.

    That is a stored table, so the others are removed as soon as nothing reads them any more.
    """
    spark = docs.sparkSession
    work = work or C.shared_dir(spark)
    salt = C.fresh_key()
    every = C.stored(lines(docs, key, text, salt), f"{work}/lines")
    place = F.struct("doc_id", "row", "number")
    pieces = [f"k{i}" for i in range(KEYS)]
    # Equal lines have equal piece keys.
    distinct = C.stored(every.groupBy("line", "check").agg(F.min(place).alias("place"), F.count("*").alias("copies"), *[F.max(k).alias(k) for k in pieces]), f"{work}/distinct")

    # Lines that agree with another in all but one piece, and in which pieces that may be.
    keys = distinct.select("line", "check", F.posexplode(F.array(*pieces)).alias("no", "key")).where("key is not null")
    # A line's own keys differ from each other, so a key held twice is held by two lines.
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    near = keys.join(shared, "key").groupBy("line", "check").agg(F.sort_array(F.collect_set(F.col("no").cast("int"))).alias("shared"))
    near = C.stored(distinct.select("line", "check", "place").join(near, ["line", "check"]), f"{work}/near")
    wanted = near.groupBy("place.doc_id", "place.row").agg(F.collect_list(F.struct(F.col("place.number").alias("number"), "line", "check", "shared")).alias("wanted"))
    texts = C.stored(line_texts(docs, wanted, key, text).dropDuplicates(["line", "check"]), f"{work}/texts")
    C.drop_dir(spark, f"{work}/near")

    rows = C.stored(neighbourhood(texts, salt), f"{work}/variants").select("kind", "key", "line", "check", place.alias("place"))
    replaced, own, shorter = (rows.where(f"kind = {k}").select("key", "line", "check", "place") for k in (0, 1, 2))
    pairs = None
    for one, other in ((replaced, replaced), (own, shorter), (shorter, own)):
        first = other.groupBy("key").agg(F.min(F.struct("place", "line", "check")).alias("y"))
        met = one.join(first, "key").where("y.place < place").select("line", "check", F.col("y.line").alias("line_y"), F.col("y.check").alias("check_y"))
        pairs = met if pairs is None else pairs.union(met)
    alike = C.stored(_verified(pairs.distinct(), texts), f"{work}/alike")
    C.drop_dir(spark, f"{work}/texts", f"{work}/variants")

    first_gone = distinct.join(alike, ["line", "check"]).select("place.doc_id", "place.row", "place.number")
    later = every.join(distinct.where("copies > 1").select("line", "check", "place"), ["line", "check"]).where(place != F.col("place")).select("doc_id", "row", "number")
    gone = C.stored(first_gone.union(later).groupBy("doc_id", "row").agg(F.collect_set("number").alias("numbers")), f"{work}/gone")
    C.drop_dir(spark, f"{work}/lines", f"{work}/distinct", f"{work}/alike")
    return gone


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", work: str | None = None) -> DataFrame:
    """doc_id, n_lines, n_removed and the text without the lines that go, for every row.

    n_lines counts the lines between line feeds, the empty ones too; an empty text has one.
    """
    gone = removed_lines(docs, key, text, work)

    def run(batches):
        for batch in batches:
            n, removed, out = [], [], []
            for t, numbers in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                parts = t.split("\n")
                n.append(len(parts))
                removed.append(len(numbers or ()))
                if numbers:
                    drop = set(numbers)
                    t = "\n".join([x for i, x in enumerate(parts) if i not in drop])
                out.append(t)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(out, pa.string())], ["doc_id", "n_lines", "n_removed", "text"])

    joined = C.keyed_texts(docs, key, text, row=True).join(gone.hint("merge"), ["doc_id", "row"], "left").select("doc_id", "text", "numbers")
    return C.map_batches(joined, run, "doc_id long, n_lines long, n_removed long, text string")


def drop_lines(docs: DataFrame) -> DataFrame:
    """docs with shortened texts and their n_chars, if there is such a column; a document that loses all its words goes.

    Rows without a doc_id stay as they are.
    """
    gone = removed_lines(docs).select(F.col("doc_id").alias("_gone_id"), F.col("row").alias("_gone_row"), F.col("numbers").alias("_gone_lines"))
    same = (docs["doc_id"].cast("long") == F.col("_gone_id")) & (C.row_key("doc_id", "text") == F.col("_gone_row"))
    joined = docs.join(gone.hint("merge"), same, "left").select(*docs.columns, "_gone_lines")
    text_at, chars_at = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches):
        for batch in batches:
            cols, lost = list(batch.columns[:-1]), batch.column(batch.num_columns - 1).to_pylist()
            if any(lost):
                texts, stay = cols[text_at].to_pylist(), [True] * batch.num_rows
                chars = cols[chars_at].to_pylist() if chars_at is not None else None
                for i, numbers in enumerate(lost):
                    if numbers:
                        drop = set(numbers)
                        texts[i] = "\n".join([x for k, x in enumerate(texts[i].split("\n")) if k not in drop])
                        stay[i] = bool(_words(texts[i]))
                        if chars is not None:
                            chars[i] = len(texts[i])
                cols[text_at] = pa.array(texts, cols[text_at].type)
                if chars is not None:
                    cols[chars_at] = pa.array(chars, cols[chars_at].type)
                yield pa.RecordBatch.from_arrays(cols, batch.schema.names[:-1]).filter(pa.array(stay, pa.bool_()))
            else:
                yield pa.RecordBatch.from_arrays(cols, batch.schema.names[:-1])

    return C.map_batches(joined, run, docs.schema)
