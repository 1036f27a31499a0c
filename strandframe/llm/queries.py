"""The queries op1_ .. op10_ and pipeline, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity as T

    docs = C.table(spark, sf_dir, "documents")
    lexicon = T.learn(docs, T.learnable(C.table(spark, sf_dir, "labels")))
    return T.score(docs, lexicon).select("doc_id", T.held_out().alias("held_out"), "score", "predicted", "n_matches")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import jaccard_components

    return jaccard_components(C.table(spark, sf_dir, "documents"), k=3, percent=90)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import dedup_substrings

    return dedup_substrings(C.table(spark, sf_dir, "documents"), digest=True)


def op4_bpe(spark: SparkSession, sf_dir: str, tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    import public_tokenizers

    from . import bpe as B

    docs = C.table(spark, sf_dir, "documents")
    spec = B.read_spec(public_tokenizers.path(tokenizer))
    return B.encode(docs, spec, B.build_lexicon(docs, spec), digest=True)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    out = dedup_lines(C.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find_contamination

    found = find_contamination(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "similarity", "start_word", "n_words")


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract_pages

    pages = extract_pages(C.table(spark, sf_dir, "pages"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "path")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan_licenses

    # The corpus as a tree: a folder for each source, in it one for each language.
    docs = C.table(spark, sf_dir, "documents")
    files = docs.select("doc_id", F.concat_ws("/", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")), F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"), "text")
    return scan_licenses(files, keys=("doc_id",))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pii as P

    found = P.find_spans(C.table(spark, sf_dir, "documents"))
    write = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in P.KINDS], F.sha2(write("base"), 256).alias("base_sha256"), write(F.concat("base", "terms")).alias("spans"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(C.table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return import_module("corpus_pipeline").run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_ngram_join": op2_ngram_join,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_bpe": op4_bpe,
    "op5_line_dedup": op5_line_dedup,
    "op6_decontamination": op6_decontamination,
    "op7_html": op7_html,
    "op8_licenses": op8_licenses,
    "op9_pii": op9_pii,
    "op10_exact_dedup": op10_exact_dedup,
    "pipeline": pipeline,
}

ORACLES: dict[str, str] = {
    "op2_ngram_join": r"""
        with recursive w as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') w from documents),
        s as (select distinct doc_id, case when len(w) < 3 then array_to_string(w, ' ') else array_to_string(w[i:i + 2], ' ') end sh
              from (select doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) i from w where len(w) > 0)),
        n as (select doc_id, count(*) n from s group by doc_id),
        p as (select a.doc_id x, b.doc_id y, count(*) c from s a join s b on a.sh = b.sh and a.doc_id <> b.doc_id group by 1, 2),
        l as (select x, y from p join n nx on nx.doc_id = x join n ny on ny.doc_id = y where 100 * c >= 90 * (nx.n + ny.n - c)),
        r(x, y) as (select x, y from l union select r.x, l.y from r join l on r.y = l.x),
        m as (select x, min(y) y from r group by x)
        select w.doc_id, cast(coalesce(n.n, 0) as bigint) n_shingles, least(w.doc_id, coalesce(m.y, w.doc_id)) component_id
        from w left join n using (doc_id) left join m on m.x = w.doc_id""",
    "op3_substring_dedup": r"""
        with w as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') w from documents),
        v as (select doc_id, i, row_number() over (partition by array_to_string(w[i:i + 19], ' ') order by doc_id, i) > 1 dup
              from (select doc_id, w, unnest(range(1, len(w) - 18)) i from w where len(w) >= 20)),
        t as (select doc_id, i, word, coalesce(max(cast(dup as int)) over (partition by doc_id order by i rows between 19 preceding and current row), 0) gone
              from (select doc_id, unnest(range(1, len(w) + 1)) i, unnest(w) word from w) left join v using (doc_id, i)),
        k as (select doc_id, sum(gone) g, string_agg(word, ' ' order by i) filter (gone = 0) kept from t group by doc_id)
        select doc_id, cast(len(w) as bigint) n_words, cast(coalesce(g, 0) as bigint) n_removed, sha256(coalesce(kept, '')) kept_sha256 from w left join k using (doc_id)""",
    "op5_line_dedup": r"""
        with parts as (select doc_id, string_split(coalesce(text, ''), chr(10)) p from documents),
        l as (select doc_id, no, p[no + 1] content, list_filter(string_split_regex(p[no + 1], '[\x20\x09-\x0D]+'), lambda x: x <> '') w
              from (select doc_id, p, unnest(range(0, len(p))) no from parts)),
        k as (select *, len(w) n, (doc_id, no) place from l where len(w) >= 1),
        e as (select w, any_value(n) n, min(place) place from k group by w),
        v as (select w, n, place, i, list_concat(w[1:i], w[i + 2:]) u from (select *, unnest(range(0, n)) i from e where n >= 5)),
        r as (select n, i, u, min(place) place from v group by n, i, u),
        s as (select u, min(place) place from v group by u),
        near as (select v.w from v join r using (n, i, u) where r.place < v.place
                 union select e.w from e join s on e.w = s.u where s.place < e.place
                 union select v.w from v join e on e.w = v.u where e.place < v.place),
        gone as (select k.doc_id, k.no from k join e using (w) where k.place > e.place
                 union select k.doc_id, k.no from k semi join near using (w)),
        g as (select doc_id, list(no) nos from gone group by doc_id)
        select p.doc_id, cast(len(p.p) as bigint) n_lines, cast(len(coalesce(nos, [])) as bigint) n_removed,
               sha256(array_to_string(list_filter(p.p, lambda x, i: not list_contains(coalesce(nos, []), i - 1)), chr(10))) kept_sha256
        from parts p left join g using (doc_id)""",
    "op6_decontamination": r"""
        with d as (select doc_id id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') w from documents),
        b as (select item_id id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') w from benchmark),
        i as (select id, w, least(5, len(w)) k from b where len(w) > 0),
        dg as (select id, k, n, i - 1 p, array_to_string(w[i:i + k - 1], ' ') g
               from (select id, w, k, len(w) - k + 1 n, unnest(range(1, len(w) - k + 2)) i from d cross join (select distinct k from i) where len(w) >= k)),
        bg as (select id, k, m, g, count(*) c from (select id, k, len(w) - k + 1 m, array_to_string(w[i:i + k - 1], ' ') g from (select id, w, k, unnest(range(1, len(w) - k + 2)) i from i)) group by 1, 2, 3, 4),
        h as (select dg.id doc_id, bg.id item_id, k, m, p, dg.g, c, dg.n, least(m, dg.n) width from dg join bg using (k, g)),
        s as (select distinct doc_id, item_id, k, m, width, s from (select doc_id, item_id, k, m, width, unnest(range(greatest(p - width + 1, 0), least(p, n - width) + 1)) s from h)),
        held as (select s.doc_id, s.item_id, s.k, s.m, s.width, s.s, h.g, least(count(*), any_value(h.c)) c from s join h on h.doc_id = s.doc_id and h.item_id = s.item_id and h.p between s.s and s.s + s.width - 1 group by 1, 2, 3, 4, 5, 6, 7),
        v as (select doc_id, item_id, k, m, width, s, sum(c) / m sim from held group by doc_id, item_id, k, m, width, s)
        select doc_id, item_id, max(sim) similarity, cast(arg_max(s, (sim, -s)) as bigint) start_word, cast(any_value(width + k - 1) as bigint) n_words from v where sim >= 0.8 group by doc_id, item_id""",
    "op10_exact_dedup": """
        with t as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') x from documents),
        g as (select x, max(doc_id) keep_id, count(*) n from t group by x)
        select doc_id, keep_id, cast(n as bigint) group_size, doc_id = keep_id kept, sha256(x) text_sha256 from t join g using (x)""",
}
