"""Queries that SQL cannot express, over whole tables, against brute force; and the pipeline's stages."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from strandframe.llm import bpe, pii, queries, toxicity
from test_operators import WORD, alike, brute_components, brute_spans, lower_ascii

SF = "/root/testdata/sf0.001"


def table(spark, name, sf=SF):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def brute_score(lexicon, text):
    """The definition of a score: entries at word beginnings, found one by one."""
    t = toxicity.fold(text)
    found, spans = [], []
    for i in range(len(t)):
        if not t[i].isalnum() or i and t[i - 1].isalnum():
            continue
        for x in lexicon.exceptions:
            if t.startswith(x, i) and not t[i + len(x) : i + len(x) + 1].isalnum():
                spans.append((i, i + len(x)))
        for x in set(lexicon.words) | set(lexicon.prefixes):
            if t.startswith(x, i):
                whole = not t[i + len(x) : i + len(x) + 1].isalnum()
                weight = max(lexicon.words.get(x, 0.0) if whole else 0.0, lexicon.prefixes.get(x, 0.0))
                if weight > 0:
                    found.append((i, i + len(x), weight))
    found = [x for x in found if not any(a <= x[0] and x[1] <= b for a, b in spans)]
    total = sum(x[2] for x in found)
    x = math.log1p(100 * total / (text.count(" ") + text.count("\n") + 20))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, lexicon.curve[0] + lexicon.curve[1] * x)))), len(found)


def test_toxicity_query(spark):
    docs, labels = table(spark, "documents", "/root/testdata/sf0.01"), table(spark, "labels", "/root/testdata/sf0.01")
    lexicon = toxicity.learn(docs, toxicity.learnable(labels))
    assert len(lexicon.words) + len(lexicon.prefixes) > len(toxicity.BUILT_IN) - 1
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in queries.op1_toxicity(spark, "/root/testdata/sf0.01").collect():
        score, n = brute_score(lexicon, texts[r.doc_id])
        assert (r.score, r.n_matches, r.predicted) == (pytest.approx(score, abs=1e-9), n, int(r.score >= 0.5))
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_toxicity_matcher():
    rng = random.Random(21)
    lexicon = toxicity.Lexicon({"ab": 2.0, "abc": 1.0, "trash": 3.0, "b": 0.5}, {"ab": 1.0, "ca": 2.5}, ("trash can", "ab ab"), (-1.0, 1.5))
    m = toxicity.Matcher(lexicon)
    for _ in range(5000):
        t = "".join(rng.choice(["a", "b", "c", " ", "-", "trash", "can", "trash can", "4b", "é", "@", "\n"]) for _ in range(rng.randrange(0, 14)))
        assert m.score(t) == (pytest.approx(brute_score(lexicon, t)[0], abs=1e-12), brute_score(lexicon, t)[1])


def test_toxicity_learns_from_allowed_rows_alone(spark):
    """Labels of the held-out rows change nothing; entries are counted by rows."""
    docs, labels = table(spark, "documents", "/root/testdata/sf0.01"), table(spark, "labels", "/root/testdata/sf0.01")
    allowed = toxicity.learnable(labels)
    kept = {r.doc_id: r.toxic for r in allowed.collect()}
    assert kept and all(zlib.crc32(str(d).encode()) % 5 for d in kept)
    turned = labels.selectExpr("doc_id", "quality", "cast(case when crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 then 1 - toxic else toxic end as int) as toxic")
    assert toxicity.learn(docs, toxicity.learnable(turned)) == toxicity.learn(docs, allowed)
    rows = {}
    for r in docs.collect():
        if r.doc_id in kept:
            rows[r.text or ""] = max(rows.get(r.text or "", 0), kept[r.doc_id])
    want = {0: Counter(), 1: Counter()}
    for t, y in rows.items():
        words = set(re.findall(r"[^\W_]+", toxicity.fold(t)))
        want[y].update({w + "$" for w in words} | {w[:k] for w in words for k in range(3, 9) if len(w) >= k})
    got = {e: (t, c) for e, t, c in toxicity._candidates(toxicity._labelled(docs, allowed))}
    assert got.pop("") == (sum(rows.values()), len(rows) - sum(rows.values()))
    assert got == {e: (t, want[0][e]) for e, t in want[1].items() if t >= toxicity.MIN_TOXIC_ROWS and t > 2 * want[0][e]}


def test_bpe_query(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    lib.no_truncation()
    lib.no_padding()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for r in table(spark, "documents").collect():
        ids = lib.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id] = (len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False)))
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op4_bpe(spark, SF).collect()} == want


def brute_terms(texts):
    """For each text the spans of the terms that reveal one of its entities."""
    digits = lambda s: "".join(c for c in s if c in "0123456789")
    spans = [brute_spans(t) for t in texts]
    entities = [{(k, t[a:b].lower() if k in ("email", "ip") else digits(t[a:b])) for k, a, b in s} for t, s in zip(texts, spans)]
    frequency = Counter(w for t in texts for w in {m[0].lower() for m in re.finditer(r"[^\W_]+", t.lower())})
    free = []
    for t, s in zip(texts, spans):
        at = defaultdict(list)
        for m in re.finditer(r"[^\W_]+", t):
            if not any(a < m.end() and m.start() < b for _, a, b in s):
                at[m[0].lower()].append(m.span())
        free.append(at)
    n_e = Counter(e for s in entities for e in s)
    n_te = Counter((w, e) for s, at in zip(entities, free) for e in s for w in at)
    total, out = len(texts), []
    for s, at in zip(entities, free):
        got = set()
        for e in s:
            for w, places in at.items():
                n = n_te[w, e]
                if n >= pii.MIN_TOGETHER and total > n_e[e] and math.log2(n * total / (frequency[w] * n_e[e])) / math.log2(total / n_e[e]) >= pii.DISCLOSURE:
                    got |= {("term", a, b) for a, b in places}
        out.append(sorted(got))
    return out


def test_disclosure_on_random_texts(spark):
    rng = random.Random(22)
    names = [f"name{i}" for i in range(12)]
    entities = ["a@b.co", "+1 (377) 555-0271", "10.0.0.1", "x.y@z.org", "4111 1111 1111 1111"]
    rows = []
    for i in range(150):
        words = [rng.choice(["the", "of", "and", "plain", f"n{rng.randrange(60)}"]) for _ in range(rng.randrange(0, 12))]
        for e, held in zip(entities, (names[:3], names[3:5], names[5:9], names[9:], [])):
            if rng.random() < 0.08:
                words += [e, *rng.sample(held, min(len(held), 2))]
            elif held and rng.random() < 0.02:
                words.append(rng.choice(held).upper())
        rng.shuffle(words)
        rows.append((i if i % 9 else rng.choice([None, 3]), " ".join(words)))
    rows += [(500, None), (501, "")]
    want = Counter((d, str(s)) for (d, _), s in zip(rows, brute_terms([t or "" for _, t in rows])))
    got = pii.find_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, str([tuple(s) for s in r.terms])) for r in got) == want
    assert sum(n for (_, s), n in want.items() if s != "[]") > 10


def test_pii_query(spark):
    """op9 over a whole table: base spans, their digest, and terms."""
    sf = "/root/testdata/sf0.01"
    docs = table(spark, "documents", sf).collect()
    texts = [r.text or "" for r in docs]
    terms = brute_terms(texts)
    got = {r.doc_id: r for r in queries.op9_pii(spark, sf).collect()}
    write = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    for r, t, more in zip(docs, texts, terms):
        base, row = brute_spans(t), got[r.doc_id]
        assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == tuple(sum(s[0] == k for s in base) for k in pii.KINDS)
        assert row.base_sha256 == hashlib.sha256(write(base).encode()).hexdigest() and row.spans == write(base + more)
    assert any(terms)


def words_of(t):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", lower_ascii(t or ""))


def holds(text, item):
    """Whether the best window of the text has 0.8 of the item's shingles."""
    w, b = words_of(text), words_of(item)
    k = min(5, len(b))
    m = len(b) - k + 1
    if not b:
        return False
    grams = Counter(tuple(b[j : j + k]) for j in range(m))
    own = [tuple(w[j : j + k]) for j in range(max(len(w) - k + 1, 0))]
    if not set(own) & set(grams):
        return False
    width = min(m, len(own))
    return any(sum(min(n, have[g]) for g, n in grams.items()) >= 0.8 * m for s in range(len(own) - width + 1) for have in [Counter(own[s : s + width])])


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """The smallest tables, with cases for every stage."""
    rng = random.Random(23)
    docs = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in table(spark, "documents").collect()]
    bench = [r.text for r in table(spark, "benchmark").collect()]
    fresh = lambda n: [f"w{rng.randrange(10**7)}" for _ in range(n)]
    more, at = [], 10**6
    for i in range(12):
        # Near copies whose lines differ in two neighbouring words each, so that no line is alike.
        lines = [fresh(80) for _ in range(4)]
        for version in range(2 + i % 2):
            own = [list(x) for x in lines]
            for x in own if version else []:
                x[20:22] = fresh(2)
            more.append("\n".join(" ".join(x) for x in own))
        # A leak in a text of its own, and a text with lines seen before.
        more.append(" ".join(fresh(30)) + "\n" + " ".join(fresh(10) + words_of(bench[i]) + fresh(10)))
        more.append(" ".join(lines[0]) + "\n" + " ".join(fresh(20)))
    more += ["short line", "short line", "you idiot, you stupid moron, you scum", None, "", "\n \n"]
    docs += [(at + i, t, "en", "planted", len(t) if t is not None else None) for i, t in enumerate(more)]
    sf = f"file://{tmp_path_factory.mktemp('sf')}"
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{sf}/documents.parquet")
    for name in ("labels", "benchmark"):
        table(spark, name).write.parquet(f"{sf}/{name}.parquet")
    return sf


def test_pipeline_against_brute_force(spark, planted):
    lib = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    rows = {r.doc_id: tuple(r)[1:] for r in table(spark, "documents", planted).collect()}
    bench = [r.text for r in table(spark, "benchmark", planted).collect()]
    lexicon = toxicity.learn(table(spark, "documents", planted), toxicity.learnable(table(spark, "labels", planted)))
    wanted = []
    clean = {d: r for d, r in rows.items() if brute_score(lexicon, r[0] or "")[0] < 0.5}
    wanted.append(clean)
    seen, by_words, shortened = [], defaultdict(list), {}
    for d, r in sorted(clean.items()):
        keep = []
        for line in (r[0] or "").split("\n"):
            w = WORD.findall(line)
            near = [s for n in (len(w) - 1, len(w), len(w) + 1) for s in by_words[n]] if w else []
            if not any(alike(w, s) for s in near):
                keep.append(line)
            if w:
                by_words[len(w)].append(w)
        t = "\n".join(keep)
        if t == (r[0] or ""):
            shortened[d] = r
        elif WORD.search(t):
            shortened[d] = (t, *r[1:3], len(t))
    wanted.append(shortened)
    component = brute_components([(d, r[0]) for d, r in shortened.items()], 5, 80)
    wanted.append({d: r for d, r in shortened.items() if component[d][1] == d})
    wanted.append({d: r for d, r in wanted[-1].items() if not any(holds(r[0], x) for x in bench)})
    sizes = [len(rows)] + [len(x) for x in wanted]
    assert all(a > b for a, b in zip(sizes, sizes[1:])) and sizes[-1] > 150
    docs = table(spark, "documents", planted)
    for (name, stage), want in zip(corpus_pipeline.STAGES, wanted):
        out = stage(spark, docs, planted)
        assert out.columns == docs.columns, name
        assert {r.doc_id: tuple(r)[1:] for r in out.collect()} == want, name
        docs = out
    t = lib.Tokenizer.from_file(public.path(corpus_pipeline.TOKENIZER))
    t.no_truncation()
    t.no_padding()
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, planted).collect()}
    assert got.keys() == wanted[-1].keys()
    for d, r in wanted[-1].items():
        ids = t.encode(r[0] or "", add_special_tokens=False).ids
        assert got[d].ids == ids and got[d].n_tokens == len(ids) and got[d].decoded == t.decode(ids, skip_special_tokens=False)
