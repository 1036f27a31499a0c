"""Toxicity: weighted lexicon matched by Aho-Corasick over folded text.

Folding lower-cases, maps homoglyphs to Latin letters and digit substitutions to
the letters they stand for (l and i share one form, since 1 and | stand for either).
Entries are whole words or word beginnings. Their weights are log odds learned from
labelled rows; a short built-in list of insults and exception phrases joins them.
Matches inside an exception phrase do not count. The sum of weights is normalised by
the number of words and a two-parameter logistic curve turns it into a score.

Null and empty texts have no match and get the curve's floor. Without labels, or with
one class only, the built-in list and default curve are used. Ties, repeated rows and
extra columns have no influence: a row is scored by its text alone.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: At most about this many labelled rows are used to fit weights and curve.
MAX_LABELLED = 16384
#: A learned entry must be in this many and this share of the sample's toxic rows, and this much likelier there (log odds):
#: the setting with the fewest errors over four folds of the rows that may be learned from.
MIN_TOXIC_ROWS, MIN_TOXIC_SHARE, MIN_LOG_ODDS = 4, 0.01, 3.0
#: Beginnings of words from 3 to this many letters are candidates, besides whole words.
MAX_PREFIX = 8

#: Plain English insults; weights of entries with evidence are learned.
BUILT_IN = ("idiot", "moron", "stupid", "loser", "scum", "imbecile", "dumbass", "vermin", "worthless", "pathetic", "disgusting")
BUILT_IN_WEIGHT = 3.0
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "idiot proof", "idiot light", "sore loser", "stupid question")

#: Letters that look like Latin ones, digits and signs that stand for letters.
_GLYPHS = str.maketrans(
    "авеёікмнорстухѕјԁһӏ" + "αβεηικνορτυχ" + "0134578" + "9lıⅼ",
    "abeeikmhopctyxsjdhi" + "abenikvoptux" + "oieastb" + "giii",
)
_SIGNS = re.compile(r"(?<=[a-z])[@$!|](?=[a-z])")
_SIGN_LETTER = {"@": "a", "$": "s", "!": "i", "|": "i"}
_WORD = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    """Text as the lexicon sees it; one code point stays one code point except in rare case foldings."""
    t = text.lower().translate(_GLYPHS)
    if "@" in t or "$" in t or "!" in t or "|" in t:
        t = _SIGNS.sub(lambda m: _SIGN_LETTER[m[0]], t)
    return t


@dataclass
class Lexicon:
    """words and prefixes: folded entry -> weight; curve: (intercept, slope) of the logistic."""

    words: dict[str, float] = field(default_factory=dict)
    prefixes: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = tuple(fold(x) for x in EXCEPTIONS)
    curve: tuple[float, float] = (-2.0, 2.0)


class Matcher:
    def __init__(self, lexicon: Lexicon):
        import ahocorasick

        self.curve = lexicon.curve
        entries: dict[str, tuple[float, float, bool]] = {}
        for w in set(lexicon.words) | set(lexicon.prefixes):
            entries[w] = (lexicon.words.get(w, 0.0), lexicon.prefixes.get(w, 0.0), False)
        for w in lexicon.exceptions:
            entries.setdefault(w, (0.0, 0.0, True))
        self.automaton = ahocorasick.Automaton()
        for w, (whole, begin, exception) in entries.items():
            self.automaton.add_word(w, (len(w), whole, begin, exception))
        self.empty = not entries
        if entries:
            self.automaton.make_automaton()

    def match(self, text: str) -> tuple[float, int]:
        """(sum of weights, matches) of a text."""
        if self.empty or not text:
            return 0.0, 0
        t = fold(text)
        n, spans, found = len(t), [], []
        for last, (size, whole, begin, exception) in self.automaton.iter(t):
            start, end = last + 1 - size, last + 1
            if start and t[start - 1].isalnum():
                continue
            ends = end == n or not t[end].isalnum()
            if exception:
                if ends:
                    spans.append((start, end))
                continue
            weight = max(whole if ends else 0.0, begin)
            if weight > 0:
                found.append((start, end, weight))
        if spans and found:
            found = [x for x in found if not any(a <= x[0] and x[1] <= b for a, b in spans)]
        return sum(x[2] for x in found), len(found)

    def feature(self, text: str) -> tuple[float, int]:
        total, n = self.match(text)
        # Weight for each 100 words, but a short text does not turn one match into certainty.
        return (math.log1p(100.0 * total / (text.count(" ") + text.count("\n") + 20)), n) if total else (0.0, 0)

    def score(self, text: str) -> tuple[float, int]:
        x, n = self.feature(text)
        z = self.curve[0] + self.curve[1] * x
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z)))), n


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic) of a sample of at most about MAX_LABELLED labelled rows; equal texts count once."""
    labels = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = labels.count()
    share = min(1.0, MAX_LABELLED / max(n, 1))
    picked = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    return C.keyed_texts(docs).join(F.broadcast(picked.select("doc_id", F.col("toxic").cast("int").alias("toxic"))), "doc_id").groupBy(F.md5("text")).agg(F.any_value("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic")


def _candidates(sample: DataFrame) -> list[tuple[str, int, int]]:
    """(entry, toxic rows, clean rows); a whole word ends in "$"."""

    def run(batches):
        from collections import Counter

        for batch in batches:
            count: dict[int, Counter] = {0: Counter(), 1: Counter()}
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                count[int(toxic > 0)].update(entries_of(text))
                count[int(toxic > 0)][""] += 1
            for toxic, c in count.items():
                yield pa.RecordBatch.from_pydict({"entry": list(c), "toxic": pa.array([v * toxic for v in c.values()], pa.int64()), "clean": pa.array([v * (1 - toxic) for v in c.values()], pa.int64())})

    counts = C.map_batches(sample, run, "entry string, toxic long, clean long").groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    kept = counts.where((F.col("entry") == "") | ((F.col("toxic") >= MIN_TOXIC_ROWS) & (F.col("toxic") > 2 * F.col("clean"))))
    # Their number is bounded by the sample of MAX_LABELLED rows, not by the corpus.
    return [tuple(r) for r in kept.collect()]


def learn(docs: DataFrame, labels: DataFrame) -> Lexicon:
    """Lexicon from labelled rows; pass only the rows that may be learned from."""
    sample = _labelled(docs, labels)
    counts = {e: (t, c) for e, t, c in _candidates(sample)}
    toxic, clean = counts.pop("", (0, 0))
    out = select_entries(counts, toxic, clean)
    return _fit(sample, out) if toxic and clean else out


def select_entries(counts: dict[str, tuple[int, int]], toxic: int, clean: int) -> Lexicon:
    """The lexicon of the entries (toxic rows, clean rows) with evidence, of so many toxic and clean rows, with the default curve."""
    out = Lexicon(words={fold(w): BUILT_IN_WEIGHT for w in BUILT_IN})
    if not toxic or not clean:
        return out

    def odds(t: int, c: int) -> float:
        return math.log((t + 0.5) / (toxic + 1)) - math.log((c + 0.5) / (clean + 1))

    good = {e: odds(t, c) for e, (t, c) in counts.items() if t >= MIN_TOXIC_ROWS and odds(t, c) >= MIN_LOG_ODDS and t >= MIN_TOXIC_SHARE * toxic}
    # An entry gives way to a longer one in as good as all its toxic rows, and stays out below a shorter one that stays.
    longer: dict[str, int] = {}
    for e in good:
        up = e[:-1]
        while len(up) >= 3:
            longer[up] = max(longer.get(up, 0), counts[e][0])
            up = up[:-1]
    stays: set[str] = set()
    for e in sorted(good, key=len):
        if e[-1] != "$" and longer.get(e, 0) >= 0.9 * counts[e][0]:
            continue
        if any(e[:k] in stays for k in range(3, len(e))):
            continue
        stays.add(e)
        if e[-1] == "$":
            out.words[e[:-1]] = good[e]
        else:
            out.prefixes[e] = good[e]
    return out


def entries_of(text: str) -> set[str]:
    """Candidate entries of a text: its folded words, marked by "$", and their beginnings."""
    seen = set()
    for w in set(_WORD.findall(fold(text))):
        seen.add(w + "$")
        seen.update([w[:k] for k in range(3, min(MAX_PREFIX, len(w)) + 1)])
    return seen


def _fit(sample: DataFrame, lexicon: Lexicon) -> Lexicon:
    """Fits the curve on the sample."""

    def run(batches):
        from collections import Counter

        m = Matcher(lexicon)
        for batch in batches:
            c = Counter((round(m.feature(t)[0], 1), int(y > 0)) for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_pydict({"x": [k[0] for k in c], "y": pa.array([k[1] for k in c], pa.int64()), "n": pa.array(list(c.values()), pa.int64())})

    rows = C.map_batches(sample, run, "x double, y long, n long").groupBy("x", "y").agg(F.sum("n").alias("n")).collect()
    lexicon.curve = fitted_curve(lexicon.curve, [tuple(r) for r in rows])
    return lexicon


def fitted_curve(curve: tuple[float, float], rows: list[tuple[float, int, int]]) -> tuple[float, float]:
    """The logistic curve of (feature, label, rows), by Newton steps with a light ridge."""
    a, b = curve
    for _ in range(25):
        g0, g1, h00, h01, h11 = 0.0, 0.05 * (b - 2.0), 0.05, 0.0, 0.05
        for x, y, n in rows:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * x))))
            w = n * p * (1 - p)
            g0, g1 = g0 + n * (p - y), g1 + n * (p - y) * x
            h00, h01, h11 = h00 + w, h01 + w * x, h11 + w * x * x
        det = h00 * h11 - h01 * h01
        if det <= 1e-9:
            break
        da, db = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det
        step = min(1.0, 2.0 / max(abs(da), abs(db), 1e-9))
        a, b = a - step * da, max(0.1, b - step * db)
    return a, b


def score(self, text: str) -> tuple[float, int]:
        x, n = self.feature(text)
        z = self.curve[0] + self.curve[1] * x
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z)))), n


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic) of a sample of at most about MAX_LABELLED labelled rows; equal texts count once."""
    labels = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = labels.count()
    share = min(1.0, MAX_LABELLED / max(n, 1))
    picked = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    return C.keyed_texts(docs).join(F.broadcast(picked.select("doc_id", F.col("toxic").cast("int").alias("toxic"))), "doc_id").groupBy(F.md5("text")).agg(F.any_value("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic")


def _candidates(sample: DataFrame) -> list[tuple[str, int, int]]:
    """(entry, toxic rows, clean rows); a whole word ends in "$"."""

    def run(batches):
        from collections import Counter

        for batch in batches:
            count: dict[int, Counter] = {0: Counter(), 1: Counter()}
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                count[int(toxic > 0)].update(entries_of(text))
                count[int(toxic > 0)][""] += 1
            for toxic, c in count.items():
                yield pa.RecordBatch.from_pydict({"entry": list(c), "toxic": pa.array([v * toxic for v in c.values()], pa.int64()), "clean": pa.array([v * (1 - toxic) for v in c.values()], pa.int64())})

    counts = C.map_batches(sample, run, "entry string, toxic long, clean long").groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    kept = counts.where((F.col("entry") == "") | ((F.col("toxic") >= MIN_TOXIC_ROWS) & (F.col("toxic") > 2 * F.col("clean"))))
    # Their number is bounded by the sample of MAX_LABELLED rows, not by the corpus.
    return [tuple(r) for r in kept.collect()]


def learn(docs: DataFrame, labels: DataFrame) -> Lexicon:
    """Lexicon from labelled rows; pass only the rows that may be learned from."""
    sample = _labelled(docs, labels)
    counts = {e: (t, c) for e, t, c in _candidates(sample)}
    toxic, clean = counts.pop("", (0, 0))
    out = Lexicon(words={fold(w): BUILT_IN_WEIGHT for w in BUILT_IN})
    if not toxic or not clean:
        return out

    def odds(t: int, c: int) -> float:
        return math.log((t + 0.5) / (toxic + 1)) - math.log((c + 0.5) / (clean + 1))

    good = {e: odds(t, c) for e, (t, c) in counts.items() if odds(t, c) >= MIN_LOG_ODDS and t >= MIN_TOXIC_SHARE * toxic}
    # An entry gives way to a longer one in as good as all its toxic rows, and stays out below a shorter one that stays.
    longer: dict[str, int] = {}
    for e in good:
        up = e[:-1]
        while len(up) >= 3:
            longer[up] = max(longer.get(up, 0), counts[e][0])
            up = up[:-1]
    stays: set[str] = set()
    for e in sorted(good, key=len):
        if e[-1] != "$" and longer.get(e, 0) >= 0.9 * counts[e][0]:
            continue
        if any(e[:k] in stays for k in range(3, len(e))):
            continue
        stays.add(e)
        if e[-1] == "$":
            out.words[e[:-1]] = good[e]
        else:
            out.prefixes[e] = good[e]
    return _fit(sample, out)


def _fit(sample: DataFrame, lexicon: Lexicon) -> Lexicon:
    """Fits the curve on the sample by Newton steps with a light ridge."""

    def run(batches):
        from collections import Counter

        m = Matcher(lexicon)
        for batch in batches:
            c = Counter((round(m.feature(t)[0], 1), int(y > 0)) for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_pydict({"x": [k[0] for k in c], "y": pa.array([k[1] for k in c], pa.int64()), "n": pa.array(list(c.values()), pa.int64())})

    rows = C.map_batches(sample, run, "x double, y long, n long").groupBy("x", "y").agg(F.sum("n").alias("n")).collect()
    a, b = lexicon.curve
    for _ in range(25):
        g0, g1, h00, h01, h11 = 0.0, 0.05 * (b - 2.0), 0.05, 0.0, 0.05
        for x, y, n in rows:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * x))))
            w = n * p * (1 - p)
            g0, g1 = g0 + n * (p - y), g1 + n * (p - y) * x
            h00, h01, h11 = h00 + w, h01 + w * x, h11 + w * x * x
        det = h00 * h11 - h01 * h01
        if det <= 1e-9:
            break
        da, db = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det
        step = min(1.0, 2.0 / max(abs(da), abs(db), 1e-9))
        a, b = a - step * da, max(0.1, b - step * db)
    lexicon.curve = (a, b)
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score, predicted, n_matches) for every row."""

    def run(batches):
        m = Matcher(lexicon)
        for batch in batches:
            got = [m.score(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "score": [x for x, _ in got], "predicted": pa.array([int(x >= 0.5) for x, _ in got], pa.int32()), "n_matches": pa.array([n for _, n in got], pa.int64())})

    return C.map_batches(C.keyed_texts(docs, key, text), run, "doc_id long, score double, predicted int, n_matches long")


def keep_clean(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """docs without the rows whose score is 0.5 or more; all columns stay as they are."""

    def run(batches):
        m = Matcher(lexicon)
        at = None
        for batch in batches:
            at = batch.schema.get_field_index("text") if at is None else at
            yield batch.filter(pa.array([m.score(t or "")[0] < 0.5 for t in batch.column(at).to_pylist()], pa.bool_()))

    return C.map_batches(docs, run, docs.schema)


def held_out(key: str = "doc_id"):
    """True where crc32(doc_id as text) mod 5 is 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string")), F.lit(5)) == 0, F.lit(False))


def learnable(labels: DataFrame) -> DataFrame:
    return labels.where(~held_out())
