"""BPE encoding and decoding with a minimal acyclic lexicon.

Frequent words of the corpus are compiled, with their ids, into a minimal acyclic
automaton with shared suffixes; the number of words below each arc turns a path into
the word's rank, and the rank points at its ids. The automaton travels to executors as
one block of bytes of bounded size and is mapped from a file there. Words that it lacks
are merged exactly, by rank and then from the left.

A null text is empty and gives no ids; empty texts give no ids and an empty decoded
text. Very long words are merged with a heap, in n log n steps. An empty table gives an
empty result, other columns of the input are ignored, repeated rows repeat.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import os
import struct
import tempfile
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Words in the lexicon: the most frequent ones of all documents. It bounds what is broadcast.
LEXICON_WORDS = 1 << 16
#: Longest word in the lexicon, in bytes.
LEXICON_BYTES = 64
HEAD_BYTES = 4
#: Distinct white-space separated pieces that a worker remembers, each at most MEMO_CHARS long.
MEMO_PIECES, MEMO_CHARS = 600_000, 64
#: ASCII marks that end a piece in ordinary prose.
MARKS = "!\"#$%&()*+,-./:;<=>?@[]^_`{|}~"
#: Distinct words counted before a task hands on what it has.
COUNTED_WORDS = 100_000

#: Fixed by the tokenizer file: how words are cut, after NFC and lower-casing.
SUPPORTED_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, extra = [], 0
    for b in range(256):
        out.append(chr(b) if b in plain else chr(256 + extra))
        extra += b not in plain
    return out


class Bpe:
    """Vocabulary and merge ranks of a word-end BPE file of the tokenizers library."""

    def __init__(self, spec: str):
        import regex

        j = json.loads(spec)
        model, split = j["model"], j["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != WORD_END or split != SUPPORTED_SPLIT:
            raise ValueError("not a word-end BPE file of the supported kind")
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {x["content"]: x["id"] for x in j["added_tokens"]}
        self.names = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        self.numbers = [str(i) for i in range(max(self.names) + 1)]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.ranks = {(self.vocab[a], self.vocab[b]): r for r, (a, b) in enumerate(merges)}
        self.joined = [self.vocab[a + b] for a, b in merges]
        letters = _byte_letters()
        self.first = [self.vocab[x] for x in letters]
        self.last = [self.vocab[x + WORD_END] for x in letters]
        self.split, self.space = regex.compile(split), regex.compile(r"\s+")
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def pieces(self, text: str) -> list[str]:
        """The text normalised, in lower case, and cut at white space."""
        t = text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)
        # Letter by letter: a capital sigma at a word's end has no form of its own here.
        t = t.lower() if "Σ" not in t else "".join([c.lower() for c in t])
        # Python also splits at \x1c-\x1f, which the tokenizer does not count as white space.
        if any(c in t for c in "\x1c\x1d\x1e\x1f"):
            return [x for x in self.space.split(t) if x]
        return t.split()

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word: the pair of lowest rank, leftmost first, is joined until none is left."""
        first, ranks, joined, never = self.first, self.ranks, self.joined, len(self.joined)
        ids = [first[b] for b in word[:-1]]
        ids.append(self.last[word[-1]])
        n = len(ids)
        if n < 64:
            rank = [ranks.get(p, never) for p in zip(ids, ids[1:])]
            while rank and (r := min(rank)) < never:
                i = rank.index(r)
                ids[i : i + 2] = [joined[r]]
                del rank[i]
                if i:
                    rank[i - 1] = ranks.get((ids[i - 1], ids[i]), never)
                if i < len(rank):
                    rank[i] = ranks.get((ids[i], ids[i + 1]), never)
            return ids
        before, after, alive = list(range(-1, n - 1)), [*range(1, n), -1], [True] * n
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := ranks.get((ids[i], ids[i + 1]), never)) < never]
        heapq.heapify(heap)
        while heap:
            r, i, left, right = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j < 0 or ids[i] != left or ids[j] != right:
                continue
            ids[i], alive[j], after[i] = joined[r], False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a in (before[i], i):
                b = after[a] if a >= 0 else -1
                if b >= 0 and (r := ranks.get((ids[a], ids[b]), never)) < never:
                    heapq.heappush(heap, (r, a, ids[a], ids[b]))
        return [x for x, on in zip(ids, alive) if on]


class Lexicon:
    """Minimal acyclic automaton over words, read from one block of bytes (or a mapped file).

    Layout: counts of states, arcs, words, ids; then first arc of each state, target and
    rank offset of each arc, first id of each word, ids, and the arcs' labels.
    """

    HEAD = "<4q"

    def __init__(self, block):
        states, arcs, words, ids = struct.unpack_from(self.HEAD, block)
        view, at = memoryview(block), struct.calcsize(self.HEAD)
        parts = []
        for n in (states + 1, arcs, arcs, words + 1, ids):
            parts.append(view[at : at + 4 * n].cast("i"))
            at += 4 * n
        self.first, self.target, self.skip, self.start, self.ids = parts
        self.labels, self.base = block, at
        self.n = words
        self.heads: dict[bytes, tuple[int, int] | None] = {}

    @staticmethod
    def build(words: dict[bytes, list[int]]) -> bytes:
        """words: word -> ids. Words are added in sorted order and finished states are shared."""
        order = sorted(words)
        # A state is [final, {label: state}]; register maps a finished state's signature to its number.
        register: dict[tuple, int] = {}
        done: list[tuple[bool, tuple[tuple[int, int], ...]]] = []

        def finish(state: list) -> int:
            key = (state[0], tuple(sorted(state[1].items())))
            if key not in register:
                register[key] = len(done)
                done.append(key)
            return register[key]

        path: list[list] = [[False, {}]]
        last = b""
        for w in order:
            k = 0
            while k < min(len(w), len(last)) and w[k] == last[k]:
                k += 1
            for i in range(len(last), k, -1):
                path[i - 1][1][last[i - 1]] = finish(path.pop())
            for _ in range(k, len(w)):
                path.append([False, {}])
            path[-1][0] = True
            last = w
        for i in range(len(last), 0, -1):
            path[i - 1][1][last[i - 1]] = finish(path.pop())
        root = finish(path[0])
        below: list[int] = []
        for final, arcs in done:
            below.append(int(final) + sum(below[t] for _, t in arcs))
        number = [root] + [s for s in range(len(done)) if s != root]
        place = {s: i for i, s in enumerate(number)}
        first, target, skip, labels = [0], [], [], bytearray()
        for s in number:
            final, arcs = done[s]
            rank = int(final)
            for label, t in arcs:
                labels.append(label)
                # The sign bit marks a target at which a word may end.
                target.append(~place[t] if done[t][0] else place[t])
                skip.append(rank)
                rank += below[t]
            first.append(len(labels))
        start = np.cumsum([0] + [len(words[w]) for w in order])
        flat = [i for w in order for i in words[w]]
        head = struct.pack(Lexicon.HEAD, len(number), len(labels), len(order), len(flat))
        return head + b"".join(np.asarray(x, np.int32).tobytes() for x in (first, target, skip, start, flat)) + bytes(labels)

    def _walk(self, part: bytes, state: int, rank: int) -> tuple[int, int] | None:
        """(state, rank) behind part; a state at which a word may end comes as its complement."""
        base, first, target, skip, find = self.base, self.first, self.target, self.skip, self.labels.find
        for i in range(len(part)):
            if state < 0:
                state = ~state
            a = find(part[i : i + 1], base + first[state], base + first[state + 1])
            if a < 0:
                return None
            a -= base
            rank += skip[a]
            state = target[a]
        return state, rank

    def get(self, word: bytes) -> list[int] | None:
        """Ids of a word of the lexicon, else None. Where the first HEAD_BYTES lead is remembered."""
        head = word[:HEAD_BYTES]
        if head in self.heads:
            at = self.heads[head]
        else:
            if len(self.heads) > 50_000:
                self.heads.clear()
            at = self.heads[head] = self._walk(head, 0, 0)
        if at is not None and len(word) > HEAD_BYTES:
            at = self._walk(word[HEAD_BYTES:], *at)
        if at is None or at[0] >= 0:
            return None
        return self.ids[self.start[at[1]] : self.start[at[1] + 1]].tolist()


def mapped(block: bytes) -> mmap.mmap | bytes:
    """The block as a mapping of a file that is unlinked at once."""
    if not block:
        return block
    fd, path = tempfile.mkstemp(prefix="lexicon-")
    try:
        os.write(fd, block) if len(block) < 1 << 30 else [os.write(fd, block[i : i + (1 << 30)]) for i in range(0, len(block), 1 << 30)]
        return mmap.mmap(fd, len(block), access=mmap.ACCESS_READ)
    finally:
        os.close(fd)
        os.unlink(path)


class Encoder:
    """Encodes and decodes texts; remembers pieces between white space, in lower case and without their marks."""

    def __init__(self, spec: str, block: bytes | None):
        self.bpe = Bpe(spec)
        self.lexicon = Lexicon(mapped(block)) if block else None
        self.decoded: dict[str, str] = {}
        self.ids: _Memo = _Memo(self)
        self.exact = 0

    def piece_ids(self, piece: str) -> list[int]:
        """Ids of a piece that is normalised, in lower case and without white space."""
        out: list[int] = []
        for w in [piece] if piece.isalpha() else self.bpe.split.findall(piece):
            b = w.encode("utf-8", "surrogatepass")
            got = self.lexicon.get(b) if self.lexicon is not None and len(b) <= LEXICON_BYTES else None
            if got is None:
                self.exact += 1
                got = self.bpe.merge(b)
            out += got
        return out

    def encode_text(self, text: str) -> tuple[str, str, int]:
        """(ids joined by one space, decoded text, number of ids)."""
        if self.bpe.at_special is not None and "<|" in text and (parts := self.bpe.at_special.split(text))[1:]:
            ids, dec, n = [], [], 0
            for k, part in enumerate(parts):
                if k % 2:
                    got = (str(self.bpe.special[part]), part, 1)
                else:
                    got = self._plain(part)
                if got[2]:
                    ids.append(got[0])
                    dec.append(got[1])
                    n += got[2]
            return " ".join(ids), " ".join(dec), n
        return self._plain(text)

    def _plain(self, text: str) -> tuple[str, str, int]:
        pieces = self.bpe.pieces(text)
        if len(self.ids) > MEMO_PIECES:
            self.ids.clear()
            self.decoded.clear()
        ids = " ".join(map(self.ids.__getitem__, pieces))
        try:
            dec = " ".join(map(self.decoded.__getitem__, pieces))
        except KeyError:  # a piece too long to be remembered
            names, decoded = self.bpe.names, self.decoded
            dec = " ".join([decoded[p] if p in decoded else " ".join([names[int(i)] for i in self.ids[p].split()]) for p in pieces])
        return ids, dec, ids.count(" ") + 1 if ids else 0


class _Memo(dict):
    """Piece -> ids joined by a space; what is asked for first is worked out."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, piece: str) -> str:
        enc = self.encoder
        core = piece.rstrip(MARKS)
        if core != piece and core and core[-1].isalnum():
            # Marks after a letter or digit are a word of their own.
            tail = piece[len(core) :]
            out = f"{self[core]} {self[tail]}"
            dec = f"{enc.decoded[core]} {enc.decoded[tail]}" if core in enc.decoded and tail in enc.decoded else None
        else:
            ids = enc.piece_ids(piece)
            out = " ".join(map(enc.bpe.numbers.__getitem__, ids))
            dec = " ".join(map(enc.bpe.names.__getitem__, ids)) if len(piece) <= MEMO_CHARS else None
        if dec is not None and len(piece) <= MEMO_CHARS:
            self[piece] = out
            enc.decoded[piece] = dec
        return out


def decode_ids(spec: str, ids: list[int]) -> str:
    """Text of ids, with special tokens, as a file without a decoder gives it: tokens joined by a space."""
    names = Bpe(spec).names
    return " ".join(names[i] for i in ids if i in names)


_HELD: dict[tuple, object] = {}


def _once(key: tuple, make):
    """One object per Python worker and key: workers live longer than tasks."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def word_counts(docs: DataFrame, spec: str, text: str = "text") -> DataFrame:
    """(word binary, n): how often each word is in all documents."""
    name = hashlib.sha256(spec.encode()).hexdigest()

    def run(batches):
        bpe = _once(("bpe", name), lambda: Bpe(spec))
        counts: Counter = Counter()

        def out():
            words: Counter = Counter()
            for piece, n in counts.items():
                for w in [piece] if piece.isalpha() else bpe.split.findall(piece):
                    words[w] += n
            kept = [(b, n) for w, n in words.items() if len(b := w.encode("utf-8", "surrogatepass")) <= LEXICON_BYTES]
            counts.clear()
            return pa.RecordBatch.from_pydict({"word": pa.array([b for b, _ in kept], pa.binary()), "n": pa.array([n for _, n in kept], pa.int64())})

        for batch in batches:
            for t in batch.column(0).to_pylist():
                counts.update(bpe.pieces(t))
                if len(counts) > COUNTED_WORDS:
                    yield out()
        yield out()

    texts = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return C.map_batches(texts, run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, spec: str, text: str = "text", words: int = LEXICON_WORDS, work: str | None = None) -> bytes:
    """The automaton of the most frequent words: all from the least count on that leaves at most `words` of them.

    The count is found from how many words have each count, so no task sends more than its share of the lexicon.
    """
    counts = C.stored(word_counts(docs, spec, text), f"{work or C.shared_dir(docs.sparkSession)}/words")
    # Counts from 4096 on are taken together by powers of two: a few thousand rows at any size.
    step = F.expr("case when n < 4096 then n else shiftleft(1L, cast(floor(log2(n)) as int)) end")
    least, total = 1 << 62, 0
    for n, held in counts.groupBy(step.alias("least")).agg(F.count("*").alias("held")).orderBy(F.desc("least")).collect():
        total += held
        if total > words:
            break
        least = n
    top = counts.where(F.col("n") >= least).collect()
    bpe = Bpe(spec)
    return Lexicon.build({bytes(r.word): bpe.merge(bytes(r.word)) for r in top})


def encode(docs: DataFrame, spec: str, block: bytes | None, key: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """doc_id, n_tokens, and ids (array<int>) and decoded text, or with digest their SHA-256 (ids as decimals joined by a space)."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((spec, block))
    name = hashlib.sha256(spec.encode() + (block or b"")).hexdigest()

    def run(batches):
        enc = _once(("encoder", name), lambda: Encoder(*sent.value))
        for batch in batches:
            got = [enc.encode_text(t) for t in batch.column(1).to_pylist()]
            cols = {"doc_id": batch.column(0), "n_tokens": pa.array([n for _, _, n in got], pa.int64())}
            if digest:
                cols["ids_sha256"] = [hashlib.sha256(i.encode()).hexdigest() for i, _, _ in got]
                cols["decoded_sha256"] = [hashlib.sha256(d.encode("utf-8", "surrogatepass")).hexdigest() for _, d, _ in got]
            else:
                cols["ids"] = pa.array([list(map(int, i.split())) for i, _, _ in got], pa.list_(pa.int32()))
                cols["decoded"] = pa.array([d for _, d, _ in got], pa.string())
            yield pa.RecordBatch.from_pydict(cols)

    kind = "ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>, decoded string"
    return C.map_batches(C.keyed_texts(docs, key, text), run, f"doc_id long, n_tokens long, {kind}")


def read_spec(path: str) -> str:
    """The tokenizer file, read on the driver: it is part of the installed library, not of the data."""
    with open(path, encoding="utf-8") as f:
        return f.read()
