"""PII: pattern spans, and an information-theoretic pass over the documents that hold them.

Base spans are e-mail addresses, IP addresses, card and phone numbers, found by fixed
patterns, leftmost and non-overlapping for each kind. They are the protected entities.
Corpus co-occurrence then estimates how strongly a term of the same document, at any
distance, reveals an entity: with n(t,e) documents that hold term t and entity e, n(t)
and n(e) documents that hold them and N documents in all,

    disclosure(t, e) = log2( n(t,e) * N / (n(t) * n(e)) ) / log2(N / n(e))

the share of the entity's information that the term gives away. From
DISCLOSURE on, with at least MIN_TOGETHER documents together, the term is
generalised: each of its places in the documents that hold the entity joins the result
under the kind "term". All counts cover all documents; the tables that hold them grow
with the corpus and are joined, not sent. Entities of fewer than MIN_TOGETHER documents
can have no such term, so only the others meet the terms of their documents.

A null text is empty and has no span. Offsets are code points, ends exclusive. Ties do
not matter, since every term over the threshold is marked. Every row counts as a document of
its own and gets the spans of its own text, whether or not others share its id or it has
none; equal rows get equal spans. An empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

KINDS = ("email", "ip", "card", "phone")
#: A term is marked from this share of the entity's information, and this many documents, on.
DISCLOSURE, MIN_TOGETHER = 0.9, 2
#: Counted terms that a task holds before it hands them on.
HELD_TERMS = 200_000

_LOCAL = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# No match can begin inside a run of digits: the run's first digit would have matched.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TERM = re.compile(r"[^\W_]+")


def _emails(t: str) -> list[tuple[int, int]]:
    """Goes from @ to @: the local part is the run of its letters before the sign, back to the last match."""
    out, at, floor = [], t.find("@"), 0
    while at >= 0:
        start = at
        while start > floor and t[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(t, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            floor = m.end()
        else:
            floor = at + 1
        at = t.find("@", floor)
    return out


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join([c for c in s if "0" <= c <= "9"])


def base_spans(t: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the pattern spans, by kind and then start."""
    out = [("email", a, b) for a, b in _emails(t)] if "@" in t else []
    if not _DIGIT.search(t):
        return out
    if "." in t:
        for m in _IP.finditer(t):
            if all(len(p := x.lstrip("0")) <= 3 and int(p or "0") <= 255 for x in m[0].split(".")):
                out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(t):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and _luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in t:
        for m in _PHONE.finditer(t):
            if 9 <= len(_digits(m[0])) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def _entity(kind: str, s: str) -> int:
    """One number for an entity however it is written."""
    norm = s.lower() if kind in ("email", "ip") else _digits(s)
    return int.from_bytes(hashlib.blake2b(f"{kind}:{norm}".encode(), digest_size=8).digest(), "little", signed=True)


def _terms(t: str, spans: list[tuple[str, int, int]]) -> dict[str, list[tuple[int, int]]]:
    """Places of each term of a text; text inside any span is not a term."""
    inside: list[list[int]] = []
    for a, b in sorted((a, b) for _, a, b in spans):
        if inside and a <= inside[-1][1]:
            inside[-1][1] = max(inside[-1][1], b)
        else:
            inside.append([a, b])
    out, at = defaultdict(list), 0
    for m in _TERM.finditer(t):
        while at < len(inside) and inside[at][1] <= m.start():
            at += 1
        if at == len(inside) or inside[at][0] >= m.end():
            out[m[0].lower()].append(m.span())
    return out


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, row_key, base (kind, start, end), entities and, beside entities, terms (term, places) of every row."""

    def run(batches):
        span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        held = pa.list_(pa.struct([("term", pa.string()), ("places", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]))
        for batch in batches:
            base, terms, ents = [], [], []
            for t in batch.column(2).to_pylist():
                spans = base_spans(t)
                base.append([dict(zip(("kind", "start", "end"), s)) for s in spans])
                terms.append([{"term": w, "places": [dict(zip(("start", "end"), x)) for x in at]} for w, at in _terms(t, spans).items()] if spans else [])
                ents.append(sorted({_entity(k, t[a:b]) for k, a, b in spans}))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(base, span), pa.array(terms, held), pa.array(ents, pa.list_(pa.int64()))], ["doc_id", "row_key", "base", "terms", "entities"])

    return C.map_batches(C.keyed_texts(docs, key, text, row=True), run, "doc_id long, row_key long, base array<struct<kind:string,start:long,end:long>>, terms array<struct<term:string,places:array<struct<start:long,end:long>>>>, entities array<long>")


def document_frequency(docs: DataFrame, text: str = "text") -> DataFrame:
    """(term, n): in how many documents each term is. Terms are first added up within tasks."""

    def run(batches):
        counts: Counter = Counter()

        def out():
            got = pa.RecordBatch.from_pydict({"term": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())})
            counts.clear()
            return got

        for batch in batches:
            for t in batch.column(0).to_pylist():
                counts.update(set(_TERM.findall(t.lower())))
                if len(counts) > HELD_TERMS:
                    yield out()
        yield out()

    texts = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return C.map_batches(texts, run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def shared_entities(scanned: DataFrame) -> DataFrame:
    """(row, entity, n_e) for each row and entity of it that MIN_TOGETHER rows hold; n_e: how many hold it."""
    held = scanned.select("row", F.explode("entities").alias("entity"))
    return held.join(held.groupBy("entity").agg(F.count("*").alias("n_e")).where(F.col("n_e") >= MIN_TOGETHER), "entity").select("row", "entity", "n_e")


def disclosures(scanned: DataFrame, shared: DataFrame, frequency: DataFrame) -> DataFrame:
    """(entity, term, disclosure) for the terms that reveal an entity beyond the threshold."""
    total = scanned.agg(F.count("*").alias("total"))
    terms = scanned.select("row", F.explode("terms.term").alias("term"))
    pairs = shared.join(terms, "row").groupBy("entity", "term").agg(F.count("*").alias("n_te"), F.max("n_e").alias("n_e")).where(F.col("n_te") >= MIN_TOGETHER)
    # total is one row.
    joined = pairs.join(frequency.withColumnRenamed("n", "n_t"), "term").join(F.broadcast(total))
    share = F.log2(F.col("n_te") * F.col("total") / (F.col("n_t") * F.col("n_e"))) / F.log2(F.col("total") / F.col("n_e"))
    return joined.where(F.col("total") > F.col("n_e")).select("entity", "term", share.alias("disclosure")).where(F.col("disclosure") >= DISCLOSURE)


def find_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", work: str | None = None) -> DataFrame:
    """doc_id, row_key, base and terms (both arrays of kind, start, end) for every row."""
    spark = docs.sparkSession
    work = work or C.shared_dir(spark)
    # The row numbers hold as the table is stored.
    scanned = C.stored(scan(docs, key, text).withColumn("row", F.monotonically_increasing_id()), f"{work}/scanned")
    shared = C.stored(shared_entities(scanned), f"{work}/shared")
    told = disclosures(scanned, shared, document_frequency(docs, text))
    found = scanned.select("row", F.explode("terms").alias("x")).select("row", "x.*").join(shared.select("row", "entity"), "row")
    places = found.join(told.select("entity", "term"), ["entity", "term"]).select("row", F.explode("places").alias("at"))
    spans = places.groupBy("row").agg(F.sort_array(F.collect_set(F.struct(F.lit("term").alias("kind"), "at.start", "at.end"))).alias("terms"))
    none = F.expr("cast(array() as array<struct<kind:string,start:bigint,end:bigint>>)")
    return scanned.select("row", "doc_id", "row_key", "base").join(spans, "row", "left").select("doc_id", "row_key", "base", F.coalesce("terms", none).alias("terms"))


def sanitise(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the text with each base span replaced by <KIND> and each revealing term by <TERM>."""
    # Equal rows have equal spans, so one of them serves for each row key.
    spans = find_spans(docs, key, text).withColumn("spans", F.concat("base", "terms")).where(F.size("spans") > 0)
    spans = spans.groupBy(F.col("doc_id").alias("at_id"), F.col("row_key").alias("at_row")).agg(F.first("spans").alias("spans"))

    def run(batches):
        for batch in batches:
            out = []
            for t, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                parts, at = [], 0
                for s in sorted(spans or (), key=lambda s: (s["start"], -s["end"])):
                    if s["start"] >= at:
                        parts += [t[at : s["start"]], f"<{s['kind'].upper()}>"]
                    at = max(at, s["end"])
                out.append("".join([*parts, t[at:]]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    same = F.col("doc_id").eqNullSafe(F.col("at_id")) & (F.col("row") == F.col("at_row"))
    joined = C.keyed_texts(docs, key, text, row=True).join(spans, same, "left").select("doc_id", "text", "spans")
    return C.map_batches(joined, run, "doc_id long, text string")
