"""Crafted words, and rows that share an id, repeat or have none, against brute force in both orders."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from strandframe.llm import common, decontaminate, exact_dedup, line_dedup, ngram_join, pii, substring_dedup
from test_operators import WORD, alike, brute_spans, lower_ascii, shingles

SCHEMA = "doc_id long, text string"


def thue_morse(n, one, other):
    return [(one, other)[bin(i).count("1") % 2] for i in range(n)]


def hashes(text, key=0):
    data, off = common.text_buffers(pa.array([text]))
    return common.Words(data, off, key=key).hashes


@pytest.mark.parametrize("key", [0, 12345])
def test_sequences_that_cancel_in_powers_of_two(key):
    a, b = "".join(thue_morse(1024, "a", "b")), "".join(thue_morse(1024, "b", "a"))
    assert hashes(a, key) != hashes(b, key)
    for n in (16, 32, 1024, 4096):
        x, y = hashes(" ".join(thue_morse(n, "p", "q")), key), hashes(" ".join(thue_morse(n, "q", "p")), key)
        for which in (0, 1):
            assert common.gram_hashes(x, n, which)[0] != common.gram_hashes(y, n, which)[0]
        ends = np.array([0]), np.array([n])
        assert common.Ranges(x, 99).between(*ends) != common.Ranges(y, 99).between(*ends)


def test_ranges_against_integers():
    rng = np.random.default_rng(3)
    h = rng.integers(0, 1 << 63, 500, dtype=np.uint64) * np.uint64(2)
    p = (1 << 61) - 1
    for salt in (0, 7, 2**62):
        r = common.Ranges(h, salt)
        for a, b in ((0, 0), (0, 500), (3, 4), (17, 411), (500, 500)):
            assert int(r.between(np.array([a]), np.array([b]))[0]) == sum(int(x) * pow(r.base, i, p) for i, x in enumerate(h[a:b])) % p


def test_crafted_words_link_nothing_and_remove_nothing(spark):
    """Words and sequences that a polynomial modulo 2**64 cannot tell apart."""
    one, two = "".join(thue_morse(1024, "a", "b")), "".join(thue_morse(1024, "b", "a"))
    long_one, long_two = " ".join(thue_morse(1024, "p", "q")), " ".join(thue_morse(1024, "q", "p"))
    other = [f"w{i}" for i in range(20)]
    rows = [(1, one), (2, two), (3, " ".join(other[:10] + [one] + other[10:])), (4, " ".join(other[:10] + [two] + other[10:]))]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(docs, 3, 90).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4}
    assert [r.n_removed for r in substring_dedup.dedup_substrings(docs).collect()] == [0, 0, 0, 0]
    lines = spark.createDataFrame([(1, long_one), (2, long_two), (3, long_one)], SCHEMA)
    assert {r.doc_id: r.n_removed for r in line_dedup.dedup_lines(lines).collect()} == {1: 0, 2: 0, 3: 1}


BASE = [f"word{i}" for i in range(40)]


def awkward_rows():
    """Different rows of one id, three equal rows, rows without an id, and what they share."""
    t = " ".join(BASE)
    near = " ".join(BASE[:-1] + ["changed"])
    rows = [(5, t), (5, "quite another text of one id"), (5, t), (2, near), (None, t), (None, near), (None, "alone"), (7, t.upper()), (7, "quite another text of one id"), (9, None), (9, ""), (None, None)]
    rows += [(3, "a b c d e f\nshort\na b c d e g"), (3, "short\nx"), (3, "a b c d e f\nshort\na b c d e g"), (4, "short\n" + t + "\nmail x@y.zz and +1 (377) 555-0271"), (4, "mail q@y.zz"), (4, "mail x@y.zz")]
    return rows


def both_orders(spark):
    rows = awkward_rows()
    for given in (rows, rows[::-1], random.Random(4).sample(rows, len(rows))):
        yield given, spark.createDataFrame(given, SCHEMA).repartition(4)


def test_rows_without_or_with_one_id_in_ngram_join(spark):
    for rows, docs in both_orders(spark):
        sets = [shingles(t, 3) for _, t in rows]
        up = list(range(len(rows)))

        def root(x):
            while up[x] != x:
                x = up[x]
            return x

        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if a & b and 100 * len(a & b) >= 90 * len(a | b):
                    up[root(i)] = root(j)
        least = {}
        for i, (d, _) in enumerate(rows):
            if d is not None:
                least[root(i)] = min(d, least.get(root(i), d))
        want = Counter((d, len(s), least.get(root(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets)))
        got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs, 3, 90).collect())
        assert got == want
        kept = Counter(tuple(r) for r in ngram_join.keep_first(docs, 3, 90).collect())
        # All rows without an id, and of the others one id and text of each component.
        assert {k: n for k, n in kept.items() if k[0] is None} == {k: n for k, n in Counter(rows).items() if k[0] is None}
        assert kept[(2, " ".join(BASE[:-1] + ["changed"]))] == 1 and not any(t == " ".join(BASE) for d, t in kept if d == 5)
        assert kept[(5, "quite another text of one id")] == 1 and kept[(7, "quite another text of one id")] == 0


def test_rows_without_or_with_one_id_in_substring_dedup(spark):
    for rows, docs in both_orders(spark):
        words = [WORD.findall(t or "") for _, t in rows]
        least = {}
        for (d, _), w in zip(rows, words):
            for i in range(len(w) - 19):
                if d is not None:
                    x = tuple(w[i : i + 20])
                    least[x] = min(d, least.get(x, d))
        want = Counter()
        for (d, _), w in zip(rows, words):
            keep, own = [True] * len(w), set()
            for i in range(len(w) - 19):
                x = tuple(w[i : i + 20])
                if x in own or d is not None and least[x] < d:
                    keep[i : i + 20] = [False] * 20
                own.add(x)
            want[d, len(w), len(w) - sum(keep), " ".join(x for x, k in zip(w, keep) if k)] += 1
        assert Counter(tuple(r) for r in substring_dedup.dedup_substrings(docs).collect()) == want
        assert sum(want.values()) == len(rows)


def row_key(d, t):
    x = int(hashlib.sha256(f"{'-' if d is None else d}:{t or ''}".encode()).hexdigest()[:16], 16)
    return x - (1 << 64) if x >= 1 << 63 else x


def test_row_key(spark):
    rows = awkward_rows() + [(-3, "é\n日本")]
    got = spark.createDataFrame(rows, SCHEMA).select("doc_id", "text", common.row_key("doc_id", "text").alias("k")).collect()
    assert [r.k for r in got] == [row_key(r.doc_id, r.text) for r in got]


def test_rows_without_or_with_one_id_in_line_dedup(spark):
    for rows, docs in both_orders(spark):
        places = []
        for d, t in {(d, t or "") for d, t in rows if d is not None}:
            places += [((d, row_key(d, t), i), WORD.findall(line)) for i, line in enumerate(t.split("\n"))]
        want = Counter()
        for d, t in rows:
            parts = (t or "").split("\n")
            gone = [d is not None and any(p < (d, row_key(d, t), i) and alike(WORD.findall(line), w) for p, w in places) for i, line in enumerate(parts)]
            want[d, len(parts), sum(gone), "\n".join(x for x, g in zip(parts, gone) if not g)] += 1
        assert Counter(tuple(r) for r in line_dedup.dedup_lines(docs).collect()) == want
        n = sum(1 for d, t in rows if d is None) + sum(1 for (d, _, m, t), k in want.items() for _ in range(k) if d is not None and (not m or WORD.search(t)))
        assert line_dedup.drop_lines(docs).count() == n


def test_rows_without_or_with_one_id_in_exact_dedup(spark):
    for rows, docs in both_orders(spark):
        groups = defaultdict(list)
        for d, t in rows:
            groups[lower_ascii(t or "")].append(d)
        got = exact_dedup.exact_dedup(docs).collect()
        assert len(got) == len(rows)
        sha = {hashlib.sha256(x.encode()).hexdigest(): ids for x, ids in groups.items()}
        for r in got:
            ids = sha[r.text_sha256]
            assert r.group_size == len(ids) and r.keep_id == max((i for i in ids if i is not None), default=None)
            assert not r.kept or r.doc_id == r.keep_id
        assert Counter(r.text_sha256 for r in got if r.kept) == {x: 1 for x in sha}


def test_exact_dedup_hands_on_what_it_holds(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HELD_DIGESTS", 3)
    rows = [(i, f"t{i % 7}") for i in range(100)]
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: (max(j for j in range(100) if j % 7 == i % 7), sum(j % 7 == i % 7 for j in range(100))) for i in range(100)}


def test_rows_without_or_with_one_id_in_pii(spark):
    for rows, docs in both_orders(spark):
        want = Counter((d, str(brute_spans(t or ""))) for d, t in rows)
        got = pii.find_spans(docs).collect()
        assert Counter((r.doc_id, str([tuple(s) for s in r.base])) for r in got) == want
        clean = Counter((r.doc_id, r.text) for r in pii.sanitise(docs).collect())
        assert sum(clean.values()) == len(rows) and clean[4, "mail <EMAIL>"] == 2 and not any("@" in t for _, t in clean)


def test_rows_without_or_with_one_id_in_decontamination(spark):
    bench = spark.createDataFrame([(1, "another text of one id"), (2, " ".join(BASE[:30])), (2, " ".join(BASE[:30])), (None, "short x")], "item_id long, text string")
    for rows, docs in both_orders(spark):
        got = Counter((r.doc_id, r.item_id) for r in decontaminate.find_contamination(docs, bench).collect())
        want = Counter()
        for d, t in rows:
            low = " ".join(WORD.findall(lower_ascii(t or "")))
            want[d, 1] += "another text of one id" in low
            want[d, 2] += 2 * (" ".join(BASE[:30]) in low)
            want[d, None] += "short x" in low
        assert got == +want
        clean = Counter(tuple(r) for r in decontaminate.decontaminate(docs, bench).collect())
        assert clean == Counter((d, t) for d, t in rows if not any(x in " ".join(WORD.findall(lower_ascii(t or ""))) for x in ("another text of one id", " ".join(BASE[:30]), "short x")))
