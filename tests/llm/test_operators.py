"""The text operators against brute force, on small tables with awkward rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from strandframe.llm import bpe, common, decontaminate, exact_dedup, html_extract, licenses, line_dedup, ngram_join, pii, substring_dedup, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower_ascii(t):
    return t.translate({i: i + 32 for i in range(65, 91)})


def docs_of(spark, rows):
    """Documents with extra columns, some of whose names operators use themselves."""
    full = [(d, t, "x", None, 1, 2.0, "y") for d, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, digest string, cls string, n long, label double, key string").repartition(3)


def corpus(seed=1, n=60, vocabulary=40, longest=120):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeéß") for _ in range(rng.randrange(1, 7))) for _ in range(vocabulary)]
    passage = [rng.choice(words) for _ in range(60)]
    rows = []
    for i in range(n):
        k = rng.random()
        if k < 0.15 and rows:
            t = rng.choice(rows)[1]
        elif k < 0.4 and rows:
            w = (rng.choice(rows)[1] or "x").split(" ")
            for _ in range(rng.randrange(1, 4)):
                w[rng.randrange(len(w))] = rng.choice(words)
            t = " ".join(w)
        else:
            w = [rng.choice(words) for _ in range(rng.randrange(1, longest))]
            if rng.random() < 0.4:
                at = rng.randrange(len(w))
                a = rng.randrange(30)
                w[at:at] = passage[a : a + rng.randrange(15, 30)]
            t = "".join(x + rng.choice([" ", " ", " ", "\n", "  ", "\t"]) for x in w)
        rows.append((i * 3, t))
    rows += [(1000, ""), (1001, None), (1002, "   \n "), (1003, "One"), (1004, "one"), (1005, "z " * 300), (1006, "w" * 50_000), (1007, "A B"), (1008, "a b")]
    return rows


EMPTY = "doc_id long, text string"


def test_exact_dedup(spark):
    rows = corpus()
    groups = defaultdict(list)
    for d, t in rows:
        groups[lower_ascii(t or "")].append(d)
    got = {r.doc_id: tuple(r) for r in exact_dedup.exact_dedup(docs_of(spark, rows)).collect()}
    for d, t in rows:
        g = groups[lower_ascii(t or "")]
        assert got[d] == (d, max(g), len(g), d == max(g), hashlib.sha256(lower_ascii(t or "").encode()).hexdigest())
    assert exact_dedup.exact_dedup(spark.createDataFrame([], EMPTY)).collect() == []
    twice = exact_dedup.exact_dedup(spark.createDataFrame([(1, "a"), (1, "a"), (None, "a")], EMPTY)).collect()
    assert [r.group_size for r in twice] == [3, 3, 3]


def test_cuckoo_index_against_a_dict():
    rng, index, held = random.Random(2), exact_dedup.CuckooIndex(4), {}
    for _ in range(20_000):
        key = rng.randrange(3000).to_bytes(4, "big")
        assert index.find(key) == held.get(key)
        if key in held:
            assert index.delete(key)
            del held[key]
        else:
            index.insert(key, rng.random() or 1.0)
            held[key] = index.find(key)
            assert held[key] is not None
    assert dict(index.items()) == held and index.size == len(held) and not index.delete(b"absent")


def shingles(t, k):
    w = WORD.findall(lower_ascii(t or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_components(rows, k, percent):
    sets = {d: shingles(t, k) for d, t in rows}
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in ids}


@pytest.mark.parametrize("k, percent", [(3, 90), (5, 80), (1, 80)])
def test_ngram_join(spark, k, percent):
    rows = corpus(3, 80, 30, 60)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs_of(spark, rows), k, percent).collect()}
    assert got == brute_components(rows, k, percent)


def test_ngram_join_of_one_large_group(spark):
    rng = random.Random(4)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = f"v{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs_of(spark, rows), 3, 90).collect()}
    assert got == brute_components(rows, 3, 90)


def test_ngram_join_of_nothing(spark):
    assert ngram_join.jaccard_components(spark.createDataFrame([], EMPTY)).collect() == []
    assert [tuple(r) for r in ngram_join.jaccard_components(spark.createDataFrame([(5, None)], EMPTY)).collect()] == [(5, 0, 5)]


def test_components(spark, tmp_path):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(40)] + [(100 + rng.randrange(50), 100 + rng.randrange(50)) for _ in range(30)] + [(500, 500 + i) for i in range(1, 60)]
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    got = {r.node: r.label for r in common.components(spark, spark.createDataFrame(edges, "a long, b long"), f"file://{tmp_path}/c").collect()}
    assert got == {x: root(x) for x in list(up)}


def brute_substrings(rows):
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        w = WORD.findall(t or "")
        keep = [True] * len(w)
        for i in range(len(w) - 19):
            x = tuple(w[i : i + 20])
            if x in seen:
                keep[i : i + 20] = [False] * 20
            seen.add(x)
        out[d] = (len(w), len(w) - sum(keep), " ".join(x for x, k in zip(w, keep) if k))
    return out


@pytest.mark.parametrize("batches", [1, 4])
def test_substring_dedup(spark, batches):
    rows = corpus(6, 80, 12, 150)
    got = {r.doc_id: (r.n_words, r.n_removed, r.text) for r in substring_dedup.dedup_substrings(docs_of(spark, rows), batches=batches).collect()}
    want = brute_substrings(rows)
    assert got == want and sum(x[1] for x in want.values()) > 500
    assert substring_dedup.dedup_substrings(spark.createDataFrame([], EMPTY)).collect() == []


def test_substring_dedup_without_an_id(spark):
    w = [f"w{i}" for i in range(30)]
    rows = [(None, " ".join(w)), (5, " ".join(w)), (None, " ".join(w + w)), (6, " ".join(w[:25]))]
    got = sorted((str(r.doc_id), r.n_words, r.n_removed) for r in substring_dedup.dedup_substrings(docs_of(spark, rows)).collect())
    assert got == [("5", 30, 0), ("6", 25, 25), ("None", 30, 0), ("None", 60, 30)]


def test_fingerprint_runs_are_compacted(spark, tmp_path):
    at = f"file://{tmp_path}/index"
    index = substring_dedup.FingerprintIndex(spark, at, buckets=3, fanout=2)
    batches = [[(1, 10, 1), (2, 10, 1)], [(2, 20, 1), (3, 20, 2)], [(4, 30, 1), (3, 31, 1)], [(1, 40, 1), (9, 41, 1)]]
    got = []
    for k, b in enumerate(batches):
        got.append({tuple(r) for r in index.add(spark.createDataFrame(b, "fp long, doc_id long, n int"), f"file://{tmp_path}/i{k}").collect()})
        if k == 1:
            # Another session goes on from the folder alone.
            index.commit()
            index.close()
            index = substring_dedup.FingerprintIndex(spark.newSession(), at, fanout=2)
            assert index.buckets == 3
            spark = index.spark
    assert got == [set(), {(20, 2), (10, 2), (20, 3)}, {(31, 3), (20, 3)}, {(40, 1), (10, 1)}]
    assert [level for level, _ in index.prints.runs] == [2]
    index.commit()
    assert len(list((tmp_path / "index" / "prints").iterdir())) == 1
    index.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("run_")]


def test_substring_dedup_batch_by_batch(spark, tmp_path):
    rows = [r for r in corpus(6, 80, 12, 150) if r[0] < 900]
    want = brute_substrings(rows)
    got, at = {}, f"file://{tmp_path}/index"
    for k in range(4):
        batch = docs_of(spark, rows[k * 20 : (k + 1) * 20])
        history = docs_of(spark, rows[: k * 20] or [(0, None)])
        # Each batch comes in a session of its own.
        fresh = spark.newSession()
        batch.write.parquet(f"file://{tmp_path}/b{k}")
        history.write.parquet(f"file://{tmp_path}/h{k}")
        out = substring_dedup.add_batch(fresh.read.parquet(f"file://{tmp_path}/b{k}"), fresh.read.parquet(f"file://{tmp_path}/h{k}"), at)
        got |= {r.doc_id: (r.n_words, r.n_removed, r.text) for r in out.collect()}
    assert got == want and sum(x[1] for x in want.values()) > 500
    with pytest.raises(ValueError):
        substring_dedup.add_batch(docs_of(spark, rows[:1]), docs_of(spark, rows), at)


def one_edit(a, b):
    if a == b:
        return True
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = max(a, b, key=len), min(a, b, key=len)
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def alike(a, b):
    """The definition: equal words, or one word edit that is at most a fifth of the longer line."""
    return bool(a) and (a == b or max(len(a), len(b)) >= 5 and one_edit(a, b))


def test_line_dedup(spark):
    rng = random.Random(7)
    rows = []
    for d in range(70):
        lines = [" ".join(rng.choice("ab" if rng.random() < 0.9 else "cdé") for _ in range(rng.randrange(0, 11))) for _ in range(rng.randrange(0, 8))]
        rows.append((d, "\n".join(lines)))
    rows += [(900, None), (901, ""), (902, "\n\n"), (903, "a b c d e f\r\n" * 3), (904, "p " * 20_000), (905, "v w x y"), (906, "v w x y z"), (907, "v w x"), (908, "v w x y q"), (909, "東京都渋谷区\n東京都渋谷区")]
    seen, want = [], {}
    for d, t in rows:
        keep = []
        for line in (t or "").split("\n"):
            w = WORD.findall(line)
            if not any(alike(w, s) for s in seen):
                keep.append(line)
            if w:
                seen.append(w)
        want[d] = ((t or "").count("\n") + 1, (t or "").count("\n") + 1 - len(keep), "\n".join(keep))
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in line_dedup.dedup_lines(docs_of(spark, rows)).collect()}
    assert got == want and [got[d][1] for d in (905, 906, 907, 908, 909)] == [0, 1, 0, 1, 1]
    assert line_dedup.dedup_lines(spark.createDataFrame([], EMPTY)).collect() == []


def test_drop_lines_keeps_the_table(spark):
    rows = [(1, "a b c d e\nx y z", "s", 15), (2, "a b c d e", "s", 9), (3, None, "s", None), (4, "", "s", 0), (5, "q\na b c d f\nr", "s", 13)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    got = sorted(line_dedup.drop_lines(df).collect())
    assert [tuple(r) for r in got] == [(1, "a b c d e\nx y z", "s", 15), (3, None, "s", None), (4, "", "s", 0), (5, "q\nr", "s", 3)]


def test_drop_lines_takes_copies_of_short_lines(spark):
    rows = [(1, "All rights reserved.\na b c d e f g"), (2, "Les.\n\nsix other words are in here\nAll rights  reserved."), (3, "Les.\n東京都渋谷区"), (4, "東京都渋谷区\n\nLes too.\nLes too."), (5, "a b c d e f g\nAll rights reserved.")]
    got = {r.doc_id: r.text for r in line_dedup.drop_lines(docs_of(spark, rows)).collect()}
    assert got == {1: rows[0][1], 2: "Les.\n\nsix other words are in here", 3: "東京都渋谷区", 4: "\nLes too."}
    removed = {r.doc_id: r.n_removed for r in line_dedup.dedup_lines(docs_of(spark, rows)).collect()}
    assert removed == {1: 0, 2: 1, 3: 1, 4: 2, 5: 2}


def test_decontamination(spark):
    rng = random.Random(8)
    words = [f"t{i}" for i in range(4000)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(12, 60)))) for i in range(40)] + [(90, "short item"), (91, None), (94, " -- "), (92, items_twice := "one two three four five six seven eight"), (93, items_twice)]
    rows = []
    for d in range(60):
        w = [rng.choice(words) for _ in range(rng.randrange(0, 200))]
        if d % 3 == 0:
            leak = items[d % 40][1].split(" ")
            if d % 2:
                leak[rng.randrange(len(leak))] = "changed"
            if d % 9 == 0:
                leak = [x.upper() + "," for x in leak]
            at = rng.randrange(len(w) + 1)
            w[at:at] = leak
        rows.append((d, " ".join(w)))
    rows += [(100, None), (101, ""), (102, "One, TWO three! four five six seven eight."), (103, "a Short... item, t1 t2"), (104, "short t1 item"), (105, "short")]
    words_of = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", lower_ascii(t or ""))
    want = set()
    for d, t in rows:
        w = words_of(t)
        for i, x in items:
            b = words_of(x)
            k = min(5, len(b))
            m = len(b) - k + 1
            if not b:
                continue
            grams = Counter(tuple(b[j : j + k]) for j in range(m))
            best = 0
            for s in range(max(len(w) - len(b), 0) + 1):
                have = Counter(tuple(w[s + j : s + j + k]) for j in range(min(m, max(len(w) - k + 1, 0))))
                best = max(best, sum(min(n, have[g]) for g, n in grams.items()) / m)
            if best >= 0.8:
                want.add((d, i))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_contamination(docs_of(spark, rows), bench).collect()}
    assert got == want and {(102, 92), (102, 93), (103, 90)} <= got and len(got) > 15
    clean = decontaminate.decontaminate(docs_of(spark, rows), bench)
    assert {r.doc_id for r in clean.collect()} == {d for d, _ in rows} - {d for d, _ in want}
    assert decontaminate.find_contamination(spark.createDataFrame([], EMPTY), bench).collect() == []
    assert decontaminate.find_contamination(docs_of(spark, rows), spark.createDataFrame([], "item_id long, text string")).collect() == []


def test_decontamination_of_texts_shorter_than_an_item(spark):
    item = [f"t{i}" for i in range(50)]
    rows = [(1, item[:-1]), (2, item[:20] + item[21:]), (3, item[:45]), (4, item[:41]), (5, item[:30]), (6, item)]
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    docs = docs_of(spark, [(d, " ".join(w)) for d, w in rows])
    got = {r.doc_id: (r.similarity, r.start_word, r.n_words) for r in decontaminate.find_contamination(docs, bench).collect()}
    assert got == {1: (45 / 46, 0, 49), 2: (41 / 46, 0, 49), 3: (41 / 46, 0, 45), 4: (37 / 46, 0, 41), 6: (1.0, 0, 50)}
    assert [r.doc_id for r in decontaminate.decontaminate(docs, bench).collect()] == [5]


def _prints_at(rng, m, kept):
    """Fingerprints of an item of m random shingles and of a window that holds `kept` of them."""
    import numpy as np

    item = rng.integers(0, 1 << 63, m, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, m, dtype=np.uint64)
    window = np.r_[item[:kept], rng.integers(0, 1 << 63, m - kept, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, m - kept, dtype=np.uint64)]
    return [decontaminate.simhashes(x, np.zeros(1, np.int64), m)[0] for x in (item, window)]


def test_recall_of_windows_at_the_threshold():
    """Shares of 0.80 to 0.85: what the blocks propose and the radius holds, against all such windows."""
    import numpy as np

    rng, found, n = np.random.default_rng(15), 0, 0
    for m in (10, 15, 20, 25, 40, 55):
        for kept in {-(-8 * m // 10), 85 * m // 100}:
            pairs = [_prints_at(rng, m, kept) for _ in range(300)]
            for item, window in pairs:
                _, b, _ = decontaminate.MultiIndex(item[None, :]).find(window[None, :])
                found, n = found + len(b), n + 1
    assert n == 3000 and found >= 0.999 * n


def test_unrelated_windows_are_not_verified():
    import numpy as np

    rng = np.random.default_rng(16)
    prints = rng.integers(0, 1 << 63, (400, 4), dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, (400, 4), dtype=np.uint64)
    probes = rng.integers(0, 1 << 63, (500, 4), dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, (500, 4), dtype=np.uint64)
    index = decontaminate.MultiIndex(prints)
    assert len(index.proposed(probes)) < 0.01 * 400 * 500 and not len(index.find(probes)[0])


def test_decontamination_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 100)
    items = [(i, " ".join(f"w{i}x{j}" for j in range(12))) for i in range(20)]
    rows = [(i, "start " + t + " end") for i, t in items]
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_contamination(docs_of(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(i, i) for i in range(20)}


def test_multi_index_finds_all_within_radius(monkeypatch):
    import numpy as np

    monkeypatch.setattr(decontaminate, "PAIRS", 700)
    rng = np.random.default_rng(9)
    prints = rng.integers(0, 1 << 63, (50, 4), dtype=np.uint64)
    probes = prints[rng.integers(0, 50, 200)]
    for _ in range(110):
        at = rng.integers(0, 4, 200)
        flip = np.where(rng.random(200) < 0.9, np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64), np.uint64(0))
        probes[np.arange(200), at] ^= flip
    a, b, d = decontaminate.MultiIndex(prints).find(probes)
    distance = {(i, j): sum((int(x) ^ int(y)).bit_count() for x, y in zip(p, q)) for i, p in enumerate(probes) for j, q in enumerate(prints)}
    want = {k: v for k, v in distance.items() if v <= decontaminate.RADIUS}
    assert dict(zip(zip(a.tolist(), b.tolist()), d.tolist())) == want and 20 < len(want) < 200


@pytest.fixture(scope="module")
def tokenizer():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return bpe.read_spec(path), t


def test_bpe_equals_the_library(spark, tokenizer):
    spec, lib = tokenizer
    rows = corpus(10, 40)
    rows += [(2000 + i, t) for i, t in enumerate(["a\x1cb\x1fc", "ÀΣ ΟΔΟΣ İstanbul x² ½ ⅷ 12345 it's we'll 'S don't", "<|endoftext|>foo <|startoftext|> bar<|endoftext|>", "!" * 300, "日本語 한국어 👩‍👩‍👧 \x00\x01 nb\xa0sp x\x85y", "ẛ̣ ̈́ é", "word*** word%%% $$$", "(A)b-c_d.e", "<|EndOfText|>"])]
    docs = docs_of(spark, rows)
    block = bpe.build_lexicon(docs, spec, words=30)
    got = {r.doc_id: r for r in bpe.encode(docs, spec, block).collect()}
    plain = {r.doc_id: r for r in bpe.encode(docs, spec, None).collect()}
    for d, t in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert got[d].ids == plain[d].ids == ids and got[d].n_tokens == len(ids)
        assert got[d].decoded == lib.decode(ids, skip_special_tokens=False) == bpe.decode_ids(spec, ids)
    assert bpe.encode(spark.createDataFrame([], EMPTY), spec, bpe.build_lexicon(spark.createDataFrame([], EMPTY), spec)).collect() == []


def test_lexicon_is_minimal_and_exact():
    rng = random.Random(11)
    words = {bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 9))): [rng.randrange(100) for _ in range(rng.randrange(1, 4))] for _ in range(500)}
    lexicon = bpe.Lexicon(bpe.mapped(bpe.Lexicon.build(words)))
    for w, ids in words.items():
        assert lexicon.get(w) == ids
    for _ in range(3000):
        w = bytes(rng.choice(b"abcd") for _ in range(rng.randrange(0, 10)))
        assert lexicon.get(w) == words.get(w)
    many = {f"{a}{b}ing".encode(): [1] for a in "abcdefgh" for b in "ijklmnop"}
    assert len(bpe.Lexicon(bpe.Lexicon.build(many)).first) - 1 == 1 + 1 + 1 + 3  # root, after a, after b, i-n-g


E_MAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_spans(t):
    digits = lambda s: "".join(c for c in s if c in "0123456789")

    def luhn(d):
        s = 0
        for i, c in enumerate(d[::-1]):
            x = int(c) * (1 + i % 2)
            s += x - 9 * (x > 9)
        return s % 10 == 0

    out = [("email", m.start(), m.end()) for m in E_MAIL.finditer(t)]
    out += [("ip", m.start(), m.end()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", m.start(), m.end()) for m in CARD.finditer(t) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [("phone", m.start(), m.end()) for m in PHONE.finditer(t) if 9 <= len(digits(m[0])) <= 15]


def test_base_spans():
    rng = random.Random(12)
    bits = ["@", "a", ".", "1", "2", "55", "+", "-", " ", "(", ")", "4111 1111 1111 1111", "x@y.z", "é", "%", "0", "+1 (377) 555-0271", "10.0.0.1"]
    for _ in range(20_000):
        t = "".join(rng.choice(bits) for _ in range(rng.randrange(0, 25)))
        assert pii.base_spans(t) == brute_spans(t)
    for hard in ("1" * 30_000, "a" * 30_000, "1." * 20_000, "+1" + "(" * 30_000, "@" * 30_000):
        pii.base_spans(hard)


def test_pii(spark):
    filler = [(i, f"plain words number{i} the of and") for i in range(30)]
    rows = filler + [(100, "call Zebulon the agent at +1 (377) 555-0271 now"), (101, "ask Zebulon for the number +1 (377) 555-0271 please"), (102, "the zebulon"), (103, None), (104, ""), (105, "mail a@b.co")]
    got = {r.doc_id: r for r in pii.find_spans(docs_of(spark, rows)).collect()}
    assert len(got) == len(rows)
    terms = lambda d: {rows_by[d][s.start : s.end] for s in got[d].terms}
    rows_by = dict(rows)
    # 3 of 36 documents name zebulon, 2 of them beside the number: log2(2 * 36 / (3 * 2)) / log2(36 / 2) = 0.86
    assert "the" not in terms(100) and "Zebulon" not in terms(100)
    less = pii.find_spans(docs_of(spark, [r for r in rows if r[0] != 102])).where("doc_id = 101").first()
    assert {rows_by[101][s.start : s.end] for s in less.terms} == {"Zebulon"}
    clean = {r.doc_id: r.text for r in pii.sanitise(docs_of(spark, [r for r in rows if r[0] != 102])).collect()}
    assert clean[101] == "ask <TERM> for the number <PHONE> please" and clean[105] == "mail <EMAIL>" and clean[103] == ""
    assert pii.find_spans(spark.createDataFrame([], EMPTY)).collect() == []


def test_pii_terms_at_any_distance(spark):
    far = " the of and plain words" * 4
    rows = [(i, f"plain words number{i} the of and") for i in range(30)]
    rows += [(100, f"call +1 (377) 555-0271{far} Zebulon, zebulon"), (101, f"Zebulon{far} or +1 (377) 555-0271{far} ZEBULON"), (102, f"fax +1 (377) 555-0299{far} Quorl")]
    texts = dict(rows)
    got = {r.doc_id: [texts[r.doc_id][s.start : s.end] for s in r.terms] for r in pii.find_spans(docs_of(spark, rows)).collect()}
    assert {d: t for d, t in got.items() if t} == {100: ["Zebulon", "zebulon"], 101: ["Zebulon", "ZEBULON"]}


def test_toxicity(spark):
    rng = random.Random(13)
    rows, labels = [], []
    for d in range(600):
        w = [f"word{rng.randrange(300)}" for _ in range(rng.randrange(5, 60))]
        toxic = d % 6 == 0
        if toxic:
            for _ in range(2):
                w.insert(rng.randrange(len(w)), rng.choice(["glorb", "snarkle", f"zub{rng.choice('abcdef')}{rng.randrange(99)}"]))
        rows.append((d, " ".join(w)))
        labels.append((d, 1, int(toxic)))
    rows += [(900, None), (901, ""), (902, "a gl0rb and sn@rkle in ɡreek"), (903, "you idiot"), (904, "the trash can"), (905, "glorb " * 20_000)]
    docs = docs_of(spark, rows)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    lexicon = toxicity.learn(docs, toxicity.learnable(lab))
    assert "giorb" in lexicon.words and any(p.startswith("zub") for p in lexicon.prefixes)
    got = {r.doc_id: r for r in toxicity.score(docs, lexicon).withColumn("held_out", toxicity.held_out()).collect()}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    held = [d for d, _, _ in labels if got[d].held_out]
    assert len(held) > 80 and sum(got[d].predicted == (d % 6 == 0) for d in held) >= 0.97 * len(held)
    assert got[902].predicted == 1 and got[905].predicted == 1 and got[900].predicted == got[901].predicted == got[904].predicted == 0
    kept = {r.doc_id for r in toxicity.keep_clean(docs, lexicon).collect()}
    assert kept == {d for d, r in got.items() if not r.predicted}
    blank = toxicity.learn(docs, lab.limit(0))
    assert {r.doc_id: r.predicted for r in toxicity.score(docs.where("doc_id >= 900"), blank).collect()}[903] == 1
    assert toxicity.score(spark.createDataFrame([], EMPTY), lexicon).collect() == []


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style></head><body><div id="cookie-notice">We use cookies, many, many.</div>
<header><h1>Site name</h1></header><nav><ul><li><a href="/a">menu</a></ul></nav><div class="wrap"><div class="sidebar-{0}"><p>Side text, that is long. And longer.</p></div>
<div class="post-body c{0}"><h1>Title &amp; {0}</h1><p>First&nbsp;para, with <a href=x>a link</a> and <b>bold</b>.<p>Second &lt;para&gt;.<script>var a = "</p>";</script>
<ul><li>one<li>two</ul><form><label>mail</label></form><table><tr><td>x<td>y</table></div><div class="comments"><p>A reader says, at length, that this is nice.</p></div></div><footer>&copy; foot</footer></body></html>"""


def test_html(spark):
    rows = [(i, f"https://user@Host.example:80/{i}?q", PAGE.format(i)) for i in range(8)]
    rows += [(50, None, None), (51, "nohost", ""), (52, "http://x.org/", "just text &eacute; <b>here"), (53, "http://x.org/", "<p>a<p>b<br>c <"), (54, "http://host.example/e", "<div class='other'><p>Only one, other container.</p></div>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("path", F.lit(1)).withColumn("host", F.lit("h"))
    got = {r.page_id: r for r in html_extract.extract_pages(pages).collect()}
    for i in range(8):
        assert got[i].text == f"Title & {i} First para, with a link and bold. Second <para>. one two x y"
        assert got[i].path == "body/div.wrap/div.c#.post-body"
    assert (got[50].text, got[51].text, got[52].text, got[53].text) == ("", "", "just text é here", "a b c <")
    assert got[54].text == "Only one, other container."
    assert html_extract.extract_pages(pages.limit(0)).collect() == []
    html_extract.blocks("<div class='a'>x" * 20_000 + "<p " * 20_000)


@pytest.mark.parametrize("frame", ["div class='wrapper no-sidebar'", "div class='has-sidebar'", "div class='content-with-sidebar'", "div class='post format-standard'", "form action='/x'", "div class='sidebar-layout'"])
def test_html_frames_keep_the_article(frame):
    page = f"<body><{frame}><div class='story'><p>The article's text, in full. It is long, as <span class='share'>Tell all</span> articles are.</p></div><div class='sidebar'><p>Side text.</p></div><form><p>Your name</p></form></{frame.split()[0]}><div class='ad-box'>Buy, now.</div></body>"
    found = html_extract.blocks(page)
    assert [b.text for b in found] == ["The article's text, in full. It is long, as articles are."]
    assert html_extract.extract(found, None) == found[0].text
    short = "<body><div class='ad'>Much more text than the article has, so much that it is most.</div><article><p>Short.</p></article></body>"
    assert [b.text for b in html_extract.blocks(short)] == ["Short."]


def test_lookup_by_salt(spark, monkeypatch, tmp_path):
    rows = [(i, "k" if i % 3 else f"k{i}") for i in range(100)]
    df = spark.createDataFrame(rows, "i long, key string")
    look = spark.createDataFrame([("k", 1), ("k3", 2), ("no", 3)], "key string, v int")
    want = sorted(common.join_lookup(df, look, "key", ["i"]).collect())
    monkeypatch.setattr(common, "LOOKUP_ROWS", 0)
    assert sorted(common.join_lookup(df, look, "key", ["i"]).collect()) == want and len(want) == 100


def test_licenses(spark):
    rows = [
        ("a/LICENSE", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
        ("a/x.py", "print(1)"), ("a/b/y.py", "some words here"), ("a/b/z.py", "text\nLicensed under the Apache License, Version 2.0.\nmore text " + "w " * 50),
        ("a/c/COPYING", "This work is licensed under the GNU General Public License, version 3."), ("a/c/d/e.py", ""), ("q/r.py", None), (None, "plain"), ("top.py", "A license is a topic, not a notice"),
    ]
    files = spark.createDataFrame([(i, p, t, "x") for i, (p, t) in enumerate(rows)], "id long, path string, text string, own string")
    got = {r.id: (r.license, r.origin, r.from_dir) for r in licenses.scan_licenses(files, keys=("id",)).collect()}
    assert got == {0: ("MIT", "own", None), 1: ("MIT", "inherited", "a"), 2: ("MIT", "inherited", "a"), 3: ("Apache-2.0", "own", None), 4: ("GPL-3.0", "own", None), 5: ("GPL-3.0", "inherited", "a/c"), 6: (None, "none", None), 7: (None, "none", None), 8: (None, "none", None)}
    assert licenses.scan_licenses(files.limit(0)).collect() == []


def test_word_hashes():
    import pyarrow as pa

    rng = random.Random(14)
    texts = ["".join(rng.choice(" \t\nabAé.") for _ in range(rng.randrange(0, 30))) for _ in range(200)]
    data, off = common.text_buffers(pa.array(texts))
    w = common.Words(data, off)
    words = [x for t in texts for x in WORD.findall(t)]
    spans = [data[a:b].tobytes().decode() for a, b in zip(w.starts, w.ends)]
    assert spans == words and [len(WORD.findall(t)) for t in texts] == [b - a for a, b in zip(w.first, w.first[1:])]
    seen = {}
    for x, h in zip(words, w.hashes.tolist()):
        assert seen.setdefault(x, h) == h
    assert len(set(seen.values())) == len(seen)


def test_sets_that_share_an_identity(spark, monkeypatch):
    rows = corpus(3, 80, 30, 60)
    plain = ngram_join.class_id
    monkeypatch.setattr(ngram_join, "class_id", lambda s, which=0: plain(s, which) if which or not len(s) else plain(s) % 7 + 1)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs_of(spark, rows), 3, 90).collect()}
    assert got == brute_components(rows, 3, 90)
