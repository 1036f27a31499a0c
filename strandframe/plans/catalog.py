"""Registry of the engine's own queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe import cli
from strandframe.functions import arrays, bits, codecs, dna
from strandframe.operators import archive
from strandframe.operators import assign as A
from strandframe.operators import bitarray as B
from strandframe.operators import bitmap as S
from strandframe.operators import genome as G
from strandframe.operators import kmers as K
from strandframe.operators import reads as R
from strandframe.operators import runs as W
from strandframe.operators import snps as V
from strandframe.operators import tally as T
from strandframe.sources import fastx, variants
from strandframe.streaming import ingest

from . import derived as D
from .derived import SQL_D, SQL_N, SQL_R

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def _long(*names: str):
    return [F.col(n).cast("long").alias(n) for n in names]


# Scans, ordinals, statistics


@query(f"with {SQL_D} select doc_id, source, seq from d")
def dna_reads(spark, sf):
    return D.documents(spark, sf)


@query(f"with {SQL_D} select cast(count(*) as bigint) reads, cast(sum(length(seq)) as bigint) bases, cast(min(length(seq)) as bigint) min_length, cast(max(length(seq)) as bigint) max_length from d")
def read_stats(spark, sf):
    return R.statistics(D.documents(spark, sf))


@query(f"with {SQL_D} select cast(length(seq) // 100 as bigint) hundreds, cast(count(*) as bigint) n from d group by 1")
def read_len_hist(spark, sf):
    return D.documents(spark, sf).groupBy(F.floor(F.length("seq") / 100).cast("long").alias("hundreds")).agg(F.count("*").alias("n"))


def _numbered(spark, sf):
    """Documents as reads of files named by source, numbered in file and record order."""
    docs = D.documents(spark, sf).where(F.length("seq") > 0).withColumn("file", F.coalesce("source", F.lit("")))
    return R.ordinals(docs, "file", "doc_id")


_RID = f"{SQL_D}, r as (select coalesce(source, '') file, doc_id, seq, row_number() over (order by coalesce(source, ''), doc_id) - 1 rid from d where length(seq) > 0)"


@query(f"with {_RID} select cast(rid as bigint) rid, doc_id, file from r")
def read_ordinal(spark, sf):
    return _numbered(spark, sf).select("rid", "doc_id", "file")


_CUM = f"{_RID}, c as (select file, count(*) n, sum(count(*)) over (order by file) cumulative from r group by file)"


@query(f"with {_CUM} select file, cast(n as bigint) n, cast(cumulative as bigint) cumulative from c")
def cumulative_reads(spark, sf):
    return R.cumulative(_numbered(spark, sf))


@query(f"with {_CUM} select file, cast(cumulative - lag(cumulative, 1, 0) over (order by file) as bigint) reads from c")
def file_summary(spark, sf):
    return R.summary(R.cumulative(_numbered(spark, sf)))


@query(f"with {_RID} select cast(rid as bigint) rid, file from r")
def rid_to_file(spark, sf):
    numbered = _numbered(spark, sf)
    return R.file_of(numbered.select("rid"), R.cumulative(numbered))


# Predicates and projections


@query(f"with {SQL_N} select doc_id, regexp_matches(seq, '[Nn]') has_n, length(seq) >= 68 long_enough, regexp_matches(seq, '^[ACGT]+$') only_bases from dn")
def read_predicates(spark, sf):
    return D.documents(spark, sf, D.BASES_N).select("doc_id", dna.has_n("seq").alias("has_n"), dna.long_enough("seq").alias("long_enough"), dna.only_bases("seq").alias("only_bases"))


@query(f"with {SQL_N} select doc_id, {D.SQL_RC.format('seq')} rc from dn")
def rev_comp(spark, sf):
    return D.documents(spark, sf, D.BASES_N).select("doc_id", dna.reverse_complement("seq").alias("rc"))


@query(
    f"with {SQL_D}, x as (select doc_id, seq, reverse(translate(seq, 'ACGT', 'TGCA')) rc, length(seq) n, length(seq) // 2 h from d) "
    "select doc_id, case when n % 2 = 1 then substring(rc, 1, h) || substring(seq, h + 1, 1) || substring(rc, h + 2) else rc end rc from x"
)
def rev_comp_inplace_compat(spark, sf):
    return D.documents(spark, sf).select("doc_id", dna.reverse_complement_in_place("seq").alias("rc"))


def _kmers_sql(k):
    return f"{SQL_D}, k as (select unnest(list_transform(range(1, length(seq) - {k - 2}), lambda i: substring(seq, i, {k}))) kmer from d where length(seq) >= {k})"


def _id_sql(s):
    return f"list_reduce(list_transform(string_split(translate({s}, 'ACGT', '0123'), ''), lambda c: cast(c as bigint)), lambda a, b: a * 4 + b)"


_DISTINCT8 = f"{_kmers_sql(8)}, u as (select distinct kmer from k)"


@query(
    f"with {_DISTINCT8}, i as (select kmer, {_id_sql('kmer')} id, {_id_sql('reverse(kmer)')} rev, {_id_sql(D.SQL_RC.format('kmer'))} rc from u) "
    "select kmer, kmer as text, id, rev as rev_id, rc as rc_id, least(id, rc) as min_id, ((id << 2) | 3) & 65535 as next_id, (id >> 2) | (cast(2 as bigint) << 14) as prev_id, "
    f"case when len(list_filter(range(1, 9), lambda j: substring(kmer, j, 1) > substring({D.SQL_RC.format('kmer')}, j, 1))) > 0 then rc else id end as compat_min_id from i"
)
def kmer_codes(spark, sf):
    u = K.counts(D.documents(spark, sf), 8).select("kmer").withColumn("id", dna.kmer_id("kmer"))
    return u.select(
        "kmer", dna.kmer_text("id", 8).alias("text"), "id", dna.reversed_id("kmer").alias("rev_id"), dna.rc_id("kmer").alias("rc_id"),
        F.least("id", dna.rc_id("kmer")).alias("min_id"), dna.next_id("id", F.lit(3).cast("long"), 8).alias("next_id"), dna.prev_id("id", F.lit(2), 8).alias("prev_id"),
        dna.min_id("kmer", 8).alias("compat_min_id"),
    )


@query(f"with {_DISTINCT8} select kmer, case when reverse(kmer) < reverse({D.SQL_RC.format('kmer')}) then -1 when reverse(kmer) > reverse({D.SQL_RC.format('kmer')}) then 1 else 0 end as ord, substring(kmer, 1, 3) || 'N' || substring(kmer, 5) as replaced from u")
def window_order(spark, sf):
    u = K.counts(D.documents(spark, sf), 8)
    return u.select("kmer", dna.compare_reversed("kmer", dna.reverse_complement("kmer")).alias("ord"), dna.substituted("kmer", F.lit("N"), F.lit(3)).alias("replaced"))


@query(f"with b as (select distinct substring(coalesce(text, ''), i, 1) c from (select text, unnest(range(1, length(coalesce(text, '')) + 1)) i from documents)) select c, regexp_matches(c, '^[ACGTacgt]$') is_base, regexp_matches(c, '^[{dna.LETTERS}{dna.LETTERS.lower()}]$') is_base_or_n from b")
def base_tests(spark, sf):
    letters = D.spread(D.table(spark, sf, "documents")).select(F.explode(F.filter(F.split(F.coalesce("text", F.lit("")), ""), lambda x: x != "")).alias("c")).distinct()
    return letters.select("c", dna.is_base("c").alias("is_base"), dna.is_base_or_n("c").alias("is_base_or_n"))


@query(f"with {_kmers_sql(8)} select kmer, cast(count(*) as bigint) n from k group by kmer")
def kmer_counts(spark, sf):
    return K.counts(D.documents(spark, sf), 8)


@query(f"with {_kmers_sql(8)} select least(kmer, reverse(translate(kmer, 'ACGT', 'TGCA'))) kmer, cast(count(*) as bigint) n from k group by 1")
def canonical_kmers(spark, sf):
    return K.counts(D.documents(spark, sf), 8, canonical=True)


@query(f"with {_kmers_sql(14)} select least(kmer, reverse(translate(kmer, 'ACGT', 'TGCA'))) kmer, cast(count(*) as bigint) n from k group by 1 order by n desc, kmer limit 20")
def kmer_topk(spark, sf):
    return K.top(D.documents(spark, sf), 14, 20)


@query("select doc_id, cast(length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) as bigint) newlines from documents")
def newline_count(spark, sf):
    t = F.coalesce("text", F.lit(""))
    return D.table(spark, sf, "documents").select("doc_id", (F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))).cast("long").alias("newlines"))


@query(
    "with b as (select page_id, coalesce(string_split(url, '/')[-1], '') base from pages) "
    "select page_id, base, string_split(base, '.')[1] first_stem, case when contains(base, '.') then array_to_string(string_split(base, '.')[1:-2], '.') else base end last_stem from b"
)
def file_names(spark, sf):
    """Base names, cut at the first and at the last dot."""
    base = F.coalesce(F.substring_index("url", "/", -1), F.lit(""))
    return D.table(spark, sf, "pages").select("page_id", base.alias("base"), F.substring_index(base, ".", 1).alias("first_stem"), F.regexp_replace(base, r"\.[^.]*$", "").alias("last_stem"))


# Genome index


def _contigs(spark, sf):
    return G.contigs(D.genome(spark, sf))


_CTG = f"{SQL_N}, c as (select doc_id, 'd' || doc_id chrom, seq, length(seq) len, sum(length(seq)) over (order by doc_id) - length(seq) off from dn)"
_WIN = f"{_CTG}, w as (select gpos, w from (select cast(off + pos - 1 as bigint) gpos, substring(seq, pos, 54) w from (select off, seq, unnest(range(1, len - 52)) pos from c where len >= 54)) where not contains(w, 'N'))"


@query(f"with {_CTG} select doc_id ctg_ord, chrom, cast(off as bigint) as \"offset\", cast(len as bigint) as length from c")
def ref_contigs(spark, sf):
    return _contigs(spark, sf).select("ctg_ord", "chrom", "offset", "length")


@query(f"with {_WIN} select substring(w, 41, 4) word, cast(count(*) as bigint) n, cast(count(distinct substring(w, 41, 14)) as bigint) seeds from w group by 1")
def ref_windows(spark, sf):
    """Windows by the first four bases of their seed."""
    per = T.seed_counts(_contigs(spark, sf))
    words = per.groupBy(F.shiftright("seed", 20).alias("w")).agg(F.sum("n").alias("n"), F.count("*").alias("seeds"))
    return words.select(dna.kmer_text("w", 4).alias("word"), "n", "seeds")


@query(f"with {_CTG} select cast(sum(greatest(len - 53, 0)) as bigint) windows, cast((select count(*) from (select unnest(range(1, len - 52)) pos, seq from c where len >= 54) where contains(substring(seq, pos, 54), 'N')) as bigint) with_n from c")
def windows_with_n(spark, sf):
    """Places of windows, and those left out since they hold an N."""
    ctg = _contigs(spark, sf)
    places = ctg.agg(F.sum(F.greatest(F.col("length") - 53, F.lit(0))).alias("windows"))
    return places.join(F.broadcast(T.window_count(ctg))).select("windows", (F.col("windows") - F.col("made")).alias("with_n"))  # one row each


@query(f"with {_WIN}, u as (select w, count(*) n, min(gpos) p from w group by w) select cast(n as bigint) copies, cast(count(*) as bigint) windows, cast(sum(p) as bigint) places from u group by n")
def window_dedup(spark, sf):
    """How often distinct windows occur, with the sum of their first places."""
    return W.copies(W.of_genome(_contigs(spark, sf)))


@query(f"with {_WIN} select cast(least(n, 257) as bigint) size, cast(count(*) as bigint) seeds from (select right(w, 14) s, count(*) n from (select distinct w from w) group by 1) group by 1")
def seed_bucket_hist(spark, sf):
    return W.bucket_histogram(W.of_genome(_contigs(spark, sf)))


@query(f"with {_WIN}, g as (select reverse(right(w, 8)) s, count(*) n from (select distinct w from w) group by 1) select s, cast(n as bigint) n, cast(sum(n) over (order by s) - n as bigint) first_rank from g")
def seed_ranks(spark, sf):
    """First rank of each group of windows that end alike, in the order of reversed windows."""
    groups = W.endings(W.of_genome(_contigs(spark, sf)), 8).select(F.reverse(dna.kmer_text("ending", 8)).alias("s"), "n")
    return G.first_ranks(groups.withColumn("code", dna.kmer_id("s")), "code", "n").select("s", "n", "first_rank")


@query(
    f"with {_WIN}, u as (select reverse(w) r, min(gpos) p from w group by w), k as (select r, p, row_number() over (order by r) rk from u) "
    "select substring(r, 1, 4) word, cast(min(rk) as bigint) first_rank, cast(max(rk) as bigint) last_rank, cast(sum(rk * (p % 997)) as bigint) mixed from k group by 1"
)
def window_rank(spark, sf):
    """Distinct windows in the order of their reversed text: ranks by the first four letters, and where the windows of each rank first stand."""
    return W.rank_sums(W.of_genome(_contigs(spark, sf)), 997)


def _kept_genome(spark, sf):
    """The genome written once and read again: its contigs are gone over several times, and letters cost more than bases."""
    path = f"{D.work_dir(spark)}/contigs"
    D.genome(spark, sf).write.parquet(path)
    return spark.read.parquet(path)


def _variants(records):
    """A variant in the middle of every contig: the base's complement."""
    half = (F.length("seq") / 2).cast("int")
    return records.where(F.length("seq") > 0).select("ord", "chrom", half.cast("long").alias("pos"), dna.complement(F.substring(F.col("seq"), half + 1, F.lit(1))).alias("alt"))


_OVERLAY = (
    f"{_CTG}, s as (select off, seq, len, len // 2 p from c where len > 0), x as (select off, seq, len, p, translate(substring(seq, p + 1, 1), 'ACGT', 'TGCA') alt, unnest(range(p - 53, p + 1)) st from s where len >= 54), "
    "ov as (select cast(off + st as bigint) gpos, substring(seq, st + 1, p - st) || alt || substring(seq, p + 2, 53 - (p - st)) w from x where st >= 0 and st + 54 <= len and alt <> 'N' and not contains(substring(seq, st + 1, 54), 'N'))"
)


@query(f"with {_OVERLAY} select gpos, w from ov")
def snp_overlay(spark, sf):
    records = _kept_genome(spark, sf)
    ctg = G.contigs(records)
    return G.alternate_windows(ctg, G.located(_variants(records), ctg), text=True)


@query(f"with {_CTG} select cast(off + len // 2 as bigint) gpos, translate(substring(seq, len // 2 + 1, 1), 'ACGT', 'TGCA') alt from c where len > 0")
def snp_list(spark, sf):
    """Variants by way of a list file: written, read, and put on the global axis."""
    rows = _variants(D.genome(spark, sf)).select(F.concat_ws("\t", F.concat(F.lit("rs"), F.col("ord").cast("string")), "chrom", F.col("pos").cast("string"), F.lower("alt")).alias("value"))
    unknown = rows.select(F.concat(F.lit("rs "), F.lit("nowhere 5 A")).alias("value")).limit(1)
    folder = f"{D.work_dir(spark)}/snps"
    D.write_lines(rows.union(unknown), folder)
    return G.located(variants.read_snps(spark, folder), _contigs(spark, sf)).select("gpos", "alt")


# Placing reads


def _probed(spark, sf):
    """Probes of all reads, and the runs of the genome."""
    return A.packed_probes(D.reads(spark, sf)), W.of_genome(_contigs(spark, sf))


def _assigned(spark, sf):
    return A.first_match(A.hits(*_probed(spark, sf), best=True))


_PROBE = (
    f"{SQL_R}, pq as (select rid, seq, length(seq) n, least(3, n - 67) tries, n // 10 skip, case when tries > 1 then (n - 54 - 2 * skip) // (tries - 1) else 0 end step from rd where length(seq) >= 68 and not contains(seq, 'N')), "
    "pr as (select rid, s, t, skip + t * step lead, substring(case when s = 0 then seq else reverse(translate(seq, 'ACGT', 'TGCA')) end, skip + step * t + 1, 54) w from pq cross join (values (0), (1)) a(s) cross join (values (0), (1), (2)) b(t) where t < tries)"
)
_HIT = f"{_WIN}, ix as (select w, right(w, 14) seed, min(gpos) p from w group by w), {_PROBE}, hit as (select r.rid, r.s, r.t, r.lead, x.p, hamming(r.w, x.w) h from pr r join ix x on right(r.w, 14) = x.seed where hamming(r.w, x.w) < 5)"
_BEST = f"{_HIT}, best as (select *, p - lead pos, row_number() over (partition by rid order by s, t, h, p) rn from hit)"
_PLACED = f"{_BEST}, pl as (select rd.rid, rd.seq, b.pos, coalesce(b.s = 0, true) fwd, case when contains(rd.seq, 'N') then 2 when b.rid is null then 1 else 0 end cls from rd left join (select * from best where rn = 1) b on rd.rid = b.rid)"


@query(f"with {_PROBE} select cast(rid as bigint) rid, s strand, t attempt, w from pr")
def read_probes(spark, sf):
    return A.probes(D.reads(spark, sf)).select("rid", "strand", "attempt", G.window_text().alias("w"))


@query(f"with {_HIT} select cast(rid as bigint) rid, s strand, t attempt, cast(h as int) mismatches, p gpos from hit")
def seed_join(spark, sf):
    return A.hits(*_probed(spark, sf)).select("rid", "strand", "attempt", "mismatches", "gpos")


@query(f"with {_HIT} select cast(h as int) mismatches, s strand, cast(count(*) as bigint) n from hit group by 1, 2")
def hamming_hits(spark, sf):
    return A.hit_counts(*_probed(spark, sf))


@query(f"with {_BEST} select cast(rid as bigint) rid, s strand, t attempt, cast(h as int) mismatches, p gpos, cast(pos as bigint) pos from best where rn = 1")
def assign_reads(spark, sf):
    return _assigned(spark, sf).select("rid", "strand", "attempt", "mismatches", "gpos", "pos")


@query(f"with {_BEST} select cast(count(*) as bigint) reads, cast(count(b.rid) as bigint) placed, cast(count(case when b.s = 1 then 1 end) as bigint) reversed, cast(coalesce(sum(b.h), 0) as bigint) mismatches from rd left join (select * from best where rn = 1) b on rd.rid = b.rid")
def placement_totals(spark, sf):
    """Share of reads placed, and on which strand."""
    got = D.reads(spark, sf).select("rid").join(_assigned(spark, sf), "rid", "left")
    return got.agg(F.count("*").alias("reads"), F.count("strand").alias("placed"), F.count(F.when(F.col("strand") == 1, 1)).alias("reversed"), F.coalesce(F.sum("mismatches"), F.lit(0)).cast("long").alias("mismatches"))


def _classified(spark, sf):
    return A.classified(D.reads(spark, sf), _assigned(spark, sf))


@query(f"with {_PLACED} select cls, fwd is_fwd, cast(count(*) as bigint) n from pl group by 1, 2")
def classify_reads(spark, sf):
    return _classified(spark, sf).groupBy("cls", "is_fwd").agg(F.count("*").alias("n"))


@query(f"with {_PLACED} select cast(rid as bigint) rid, case when fwd then seq else {D.SQL_RC.format('seq')} end seq from pl")
def canonical_reads(spark, sf):
    return A.canonical(_classified(spark, sf)).select("rid", "seq")


_ORDER = f"{_PLACED}, o as (select rid, cls, coalesce(pos, 0) pos, fwd, length(seq) n, row_number() over (order by cls, coalesce(pos, 0), (not fwd), rid) rk from pl)"


def _ordered(spark, sf):
    """Reads with their keys of archive order; stretch: of the genome, or of read numbers, as one long that rises with the order."""
    placed = _classified(spark, sf).select("rid", "cls", F.coalesce("pos", F.lit(0)).cast("long").alias("pos"), (~F.col("is_fwd")).cast("int").alias("rev"), F.length("seq").cast("long").alias("n"))
    # Placed reads may begin before the genome does; 2**58 stretches are enough for each class.
    at = F.when(F.col("cls") == 0, F.floor(F.col("pos") / (1 << 16)) + 1).otherwise(F.floor(F.col("rid") / 100_000_000))
    return placed.withColumn("stretch", F.shiftleft(F.col("cls").cast("long"), 58) + at)


@query(f"with {_ORDER} select cast(rid as bigint) rid, cls, cast(pos as bigint) pos, cast(rk as bigint) rk from o")
def read_order(spark, sf):
    return R.places(_ordered(spark, sf), "stretch", ["pos", "rev", "rid"]).select("rid", "cls", "pos", "rk")


_PART = f"{_PLACED}, pt as (select rid, cls, rid // {D.STRIDE} page, length(seq) n, row_number() over (partition by cls, rid // {D.STRIDE} order by coalesce(pos, 0), (not fwd), rid) i from pl)"


@query(
    f"with recursive {_PART}, g(cls, page, i, held, block) as (select cls, page, i, cast(n as bigint), cast(0 as bigint) from pt where i = 1 "
    "union all select p.cls, p.page, p.i, case when g.held + p.n >= 1000 then p.n else g.held + p.n end, case when g.held + p.n >= 1000 then g.block + 1 else g.block end from g join pt p on p.cls = g.cls and p.page = g.page and p.i = g.i + 1) "
    "select cast(pt.rid as bigint) rid, pt.cls, g.block from pt join g using (cls, page, i)"
)
def block_greedy(spark, sf):
    """Blocks that end before they would reach 1000 bases, within each page and class."""
    part = _ordered(spark, sf).withColumn("part", F.struct("cls", F.floor(F.col("rid") / D.STRIDE).alias("page")))
    return R.greedy_blocks(part.select("rid", "cls", "pos", "rev", "n", "part"), "part", ["pos", "rev", "rid"], "n", 1000).select("rid", "cls", "block")


@query(f"with {_PLACED} select cast(rid as bigint) rid, cls, cast((sum(length(seq)) over (partition by cls, page order by coalesce(pos, 0), (not fwd), rid) - length(seq)) // 1000 as bigint) block from (select *, rid // {D.STRIDE} page from pl)")
def block_assign(spark, sf):
    """Blocks of 1000 bases within each page and class."""
    part = _ordered(spark, sf).withColumn("part", F.struct("cls", F.floor(F.col("rid") / D.STRIDE).alias("page")))
    return R.blocks_by_sum(part, "part", ["pos", "rev", "rid"], "n", 1000).select("rid", "cls", "block")


@query(f"with {_PLACED}, b as (select rid, cls, page, length(seq) n, (sum(length(seq)) over (partition by cls, page order by coalesce(pos, 0), (not fwd), rid) - length(seq)) // 1000 block from (select *, rid // {D.STRIDE} page from pl)) select cls, cast(block as bigint) block, cast(count(*) as bigint) reads, cast(sum(n) as bigint) bases from b group by 1, 2")
def block_stats(spark, sf):
    part = _ordered(spark, sf).withColumn("part", F.struct("cls", F.floor(F.col("rid") / D.STRIDE).alias("page")))
    return R.blocks_by_sum(part, "part", ["pos", "rev", "rid"], "n", 1000).groupBy("cls", "block").agg(F.count("*").alias("reads"), F.sum("n").alias("bases"))


@query("select l_orderkey, l_linenumber, cast(ntile(8) over (partition by l_returnflag, l_suppkey order by l_orderkey, l_linenumber) as bigint) piece from lineitem")
def even_partition(spark, sf):
    rows = D.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.struct("l_returnflag", "l_suppkey").alias("part"))
    return R.even_parts(rows, "part", ["l_orderkey", "l_linenumber"], 8).select("l_orderkey", "l_linenumber", F.col("piece").cast("long").alias("piece"))


# Sets


def _a(spark, sf):
    return S.of_values(D.table(spark, sf, "lineitem").where("l_returnflag = 'R'"), "l_orderkey")


def _b(spark, sf):
    return S.of_values(D.table(spark, sf, "lineitem").where("l_linestatus = 'O'"), "l_orderkey")


_AB = "a as (select distinct l_orderkey x from lineitem where l_returnflag = 'R'), b as (select distinct l_orderkey x from lineitem where l_linestatus = 'O')"


@query(f"with {_AB} select x from a union select x from b")
def bitmap_union(spark, sf):
    return S.union(_a(spark, sf), _b(spark, sf))


@query(f"with {_AB} select x from a intersect select x from b")
def bitmap_intersect(spark, sf):
    return S.intersect(_a(spark, sf), _b(spark, sf))


@query(f"with {_AB} select x from a except select x from b")
def bitmap_except(spark, sf):
    return S.subtract(_a(spark, sf), _b(spark, sf))


@query(f"with {_AB} (select x from a except select x from b) union (select x from b except select x from a)")
def bitmap_xor(spark, sf):
    return S.symmetric_difference(_a(spark, sf), _b(spark, sf))


@query(f"with {_AB} select x from a union select x from b union select cast(c_custkey as bigint) from customer")
def bitmap_add_many(spark, sf):
    return S.add(S.union(_a(spark, sf), _b(spark, sf)), S.of_values(D.table(spark, sf, "customer"), "c_custkey"))


@query(f"with {_AB} select x from a except select cast(c_custkey as bigint) from customer")
def bitmap_remove_many(spark, sf):
    return S.remove(_a(spark, sf), S.of_values(D.table(spark, sf, "customer"), "c_custkey"))


@query(
    f"with {_AB}, n as (select (select count(*) from a) n_a, (select count(*) from b) n_b, (select count(*) from a semi join b using (x)) n_and, (select count(*) from (select x from a union select x from b)) n_or) "
    "select cast(n_a as bigint) n_a, cast(n_b as bigint) n_b, cast(n_and as bigint) n_and, cast(n_or as bigint) n_or, cast(n_or - n_and as bigint) n_xor, cast(n_a - n_and as bigint) n_andnot, n_and / n_or jaccard, n_and = n_a is_subset, n_and = n_a and n_a < n_b is_strict_subset, n_or = n_and as \"equals\", n_and > 0 intersects from n"
)
def bitmap_jaccard(spark, sf):
    return S.counts(_a(spark, sf), _b(spark, sf))


@query(f"with {_AB} select x, cast(row_number() over (order by x) as bigint) as rank from a")
def bitmap_rank(spark, sf):
    return S.ranked(_a(spark, sf))


@query(f"with {_AB} select cast(rk as bigint) as rank, x from (select x, row_number() over (order by x) - 1 rk from a) where rk in (0, 1, 10, 100)")
def bitmap_select(spark, sf):
    return S.select(_a(spark, sf), [0, 1, 10, 100])


@query(f"with {_AB} select x from a where not (x >= 100 and x < 3000) union all (select cast(i as bigint) from range(100, 3000) r(i) except select x from a)")
def bitmap_flip(spark, sf):
    return S.flip(_a(spark, sf), 100, 3000)


@query(f"with {_AB} select cast(count(*) as bigint) n, count(*) = 50 contained from a where x >= 10 and x < 60")
def bitmap_contains_range(spark, sf):
    return S.contains_range(_a(spark, sf), 10, 60)


@query(f"with {_AB} select x from a order by x limit 50 offset 25")
def bitmap_page(spark, sf):
    return S.page(_a(spark, sf), 25, 50)


@query(f"with {_AB}, u as (select x from a union select x from b), i as (select x from a intersect select x from b) select cast((select count(*) from u) as bigint) n_or, cast((select count(*) from i) as bigint) n_and, cast((select min(x) from u) as bigint) lowest, cast((select max(x) from u) as bigint) highest")
def bitmap_compact(spark, sf):
    """Union and intersection of compact bitmaps, one row for each 32,768 values."""
    a, b = S.compact(_a(spark, sf)), S.compact(_b(spark, sf))
    ends = S.union(_a(spark, sf), _b(spark, sf)).agg(F.min("x").alias("lowest"), F.max("x").alias("highest"))
    n_or, n_and = S.compact_or(a, b).agg(F.sum("n").alias("n_or")), S.compact_and(a, b).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_and"))
    return n_or.join(F.broadcast(n_and)).join(F.broadcast(ends))  # one row each


# Bits


def _numbers(spark, sf):
    return D.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") * 2654435761 + F.col("l_linenumber")).cast("long").alias("x"))


_X = "n as (select l_orderkey, l_linenumber, l_orderkey * 2654435761 + l_linenumber x from lineitem)"


@query(f"with {_X} select l_orderkey, l_linenumber, cast(bit_count(x) as int) ones, cast(bit_count(x) % 2 as int) parity, cast(length(ltrim(bin(x), '0')) - 1 as int) log2 from n")
def popcount(spark, sf):
    return _numbers(spark, sf).select("l_orderkey", "l_linenumber", bits.popcount("x").alias("ones"), bits.parity("x").alias("parity"), bits.floor_log2("x").alias("log2"))


@query(
    f"with {_X} select l_orderkey, l_linenumber, (x & 32) <> 0 tested, x | 32 as \"set\", x & ~cast(32 as bigint) cleared, xor(x, 32) changed, x & (-x) low_one, x & (x - 1) no_low_one, x | (x + 1) low_zero_set, "
    "(x & 1) = 0 is_even, bit_count(x) = 1 is_power, (x & 255) + (xor(x, 255) >> 1) averaged, cast(bit_count((x & (-x)) - 1) as int) low_index from n"
)
def bit_ops(spark, sf):
    x = _numbers(spark, sf)
    return x.select(
        "l_orderkey", "l_linenumber", bits.test_bit("x", 5).alias("tested"), bits.set_bit("x", 5).alias("set"), bits.clear_bit("x", 5).alias("cleared"), bits.change_bit("x", 5).alias("changed"),
        bits.lowest_one("x").alias("low_one"), bits.clear_lowest_one("x").alias("no_low_one"), bits.set_lowest_zero("x").alias("low_zero_set"), bits.is_even("x").alias("is_even"), bits.is_one_bit("x").alias("is_power"),
        (F.col("x").bitwiseAND(F.lit(255)) + F.shiftrightunsigned(F.col("x").bitwiseXOR(F.lit(255)), 1)).alias("averaged"), bits.lowest_one_index("x").alias("low_index"),
    )


@query(
    f"with {_X} select l_orderkey, l_linenumber, cast(1 as bigint) << cast(length(ltrim(bin(x), '0')) - 1 as bigint) high_one, "
    "case when x <= 1 then 1 else cast(1 as bigint) << cast(length(ltrim(bin(x - 1), '0')) as bigint) end next_power, "
    "((x & 6148914691236517205) << 1) | ((x >> 1) & 6148914691236517205) swapped from (select l_orderkey, l_linenumber, x & 4611686018427387903 x from n)"
)
def bit_powers(spark, sf):
    x = _numbers(spark, sf).withColumn("x", F.col("x").bitwiseAND(F.lit((1 << 62) - 1)))
    return x.select("l_orderkey", "l_linenumber", bits.highest_one("x").alias("high_one"), bits.next_power_of_2("x").alias("next_power"), bits.swap_groups("x", 1).alias("swapped"))


@query(
    f"with {_X}, y as (select l_orderkey, l_linenumber, x, l_orderkey y, ~x z from n) select l_orderkey, l_linenumber, (x & 1) = 1 is_odd, length(ltrim(bin(x), '0')) <> length(ltrim(bin(y), '0')) other_log, "
    "xor(x, 40) both_changed, case when (x & 8) <> 0 then x | 1024 else x & ~cast(1024 as bigint) end copied, case when ((x >> 2) & 1) <> ((x >> 9) & 1) then xor(x, 516) else x end exchanged, z & (-z) low_zero, "
    "cast(1 as bigint) << cast(62 as bigint) high_zero_of_max, x | (cast(1 as bigint) << cast(62 as bigint)) high_zero_set, cast(62 as int) high_zero_index, (x & y) + (xor(x, y) >> 1) mean, (x | y) - (xor(x, y) >> 1) ceil_mean, "
    "cast(length(ltrim(bin(x), '0')) as int) low_ones, x & 4080 middle, y << 13 turned_left, y turned_right, (y & 127) << 56 bytes_swapped, coalesce(list_filter(range(0, 64), lambda i: ((x >> cast(i as bigint)) & 1) = 1)[3], -1) third_one from y"
)
def bit_more(spark, sf):
    """Bit functions that popcount, bit_ops and bit_powers leave; x is below 2**62, so its two highest zeros are the sign and bit 62."""
    x = _numbers(spark, sf)
    low = F.col("x").bitwiseOR(F.expr("shiftleft(1L, 63)"))
    ones = F.expr("shiftleft(1L, 62) | (shiftleft(1L, 62) - 1)")
    return x.select(
        "l_orderkey", "l_linenumber", bits.is_odd("x").alias("is_odd"), bits.other_highest_one("x", "l_orderkey").alias("other_log"), bits.swap_unequal_bits("x", 3, 5).alias("both_changed"),
        bits.copy_bit("x", 3, 10).alias("copied"), bits.swap_bits("x", 2, 9).alias("exchanged"), bits.lowest_zero("x").alias("low_zero"), bits.highest_zero(low).alias("high_zero_of_max"),
        bits.set_highest_zero(low).bitwiseAND(ones).alias("high_zero_set"), bits.highest_zero_index(low).alias("high_zero_index"), bits.average("x", "l_orderkey").alias("mean"), bits.ceil_average("x", "l_orderkey").alias("ceil_mean"),
        bits.count_low_ones(bits.mask(62).bitwiseAND(F.expr("shiftrightunsigned(-1L, cast(64 - length(bin(x)) as int))"))).alias("low_ones"), F.col("x").bitwiseAND(bits.block(4, 8)).alias("middle"),
        bits.rotate_left("l_orderkey", 13).alias("turned_left"), bits.rotate_right(F.shiftleft("l_orderkey", 5), 5).alias("turned_right"), bits.swap_bytes(F.col("l_orderkey").bitwiseAND(F.lit(127))).alias("bytes_swapped"), bits.nth_one_index("x", 2).cast("long").alias("third_one"),
    )


@query("select l_orderkey, l_linenumber, true in_range from lineitem")
def random_index(spark, sf):
    """Random numbers stay within their bound, which is all that can be said of them."""
    r = bits.random_index(F.col("l_quantity"), 7)
    return D.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", ((r >= 0) & (r < F.col("l_quantity"))).alias("in_range"))


# Arrays


@query(
    "with a as (select l_orderkey, list(l_partkey order by l_linenumber, l_partkey, l_suppkey) a, list(l_suppkey order by l_linenumber, l_partkey, l_suppkey) b from lineitem group by l_orderkey), "
    "o as (select l_orderkey, list_append(a, 7) pushed, a[1:len(a) - 1] popped, a[3] third, a[1] front, a[-1] back, list_concat(a, b) joined, a = b same, list_transform(a, lambda x: 9) filled, "
    "case when len(a) >= 3 then a[1:3] else list_concat(a, list_transform(range(0, 3 - len(a)), lambda x: cast(0 as bigint))) end resized, list_concat(a[1:2], b, a[3:]) inserted, list_concat(a[1:1], a[4:]) erased, [0, 0] zeros from a) "
    "select l_orderkey, third, front, back, same, array_to_string(pushed, ',') pushed, array_to_string(popped, ',') popped, array_to_string(joined, ',') joined, array_to_string(filled, ',') filled, array_to_string(resized, ',') resized, array_to_string(inserted, ',') inserted, array_to_string(erased, ',') erased, array_to_string(zeros, ',') zeros from o"
)
def array_ops(spark, sf):
    """Growable arrays: the parts and suppliers of each order."""
    pair = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey")))
    rows = D.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(pair.alias("p")).select("l_orderkey", F.col("p.l_partkey").alias("a"), F.col("p.l_suppkey").alias("b"))
    value = lambda v: F.lit(v).cast("long")
    lists = {
        "pushed": arrays.push("a", value(7)), "popped": arrays.pop("a"), "joined": arrays.append("a", "b"), "filled": arrays.fill("a", value(9)), "resized": arrays.resized("a", 3, value(0)),
        "inserted": arrays.inserted("a", 2, "b"), "erased": arrays.erased("a", 1, 2), "zeros": arrays.zeros(2),
    }
    written = [F.array_join(x, ",").alias(n) for n, x in lists.items()]
    return rows.select("l_orderkey", arrays.at("a", 2).alias("third"), arrays.front("a").alias("front"), arrays.back("a").alias("back"), arrays.equals("a", "b").alias("same"), *written)


@query(
    f"with {_AB}, u as (select x from a where x >= 0 and x < 20000) select cast((select count(*) from u) as bigint) ones, cast(20000 - (select count(*) from u) as bigint) zeros, (select count(*) from u) = 20000 all_set, (select count(*) from u) = 0 all_clear, "
    "cast(coalesce((select min(x) from u), 20000) as bigint) first_set, cast((select min(i) from range(0, 20001) r(i) where i not in (select x from u)) as bigint) first_clear, "
    "cast(coalesce((select min(x) from u where x >= 500), 20000) as bigint) next_set, cast((select min(i) from range(500, 20001) r(i) where i not in (select x from u)) as bigint) next_clear"
)
def bitarray_scan(spark, sf):
    """An array of 20,000 bits: counts, first and next bits of either kind."""
    held = B.resized(_a(spark, sf), 20_000)
    return B.summary(held, 20_000).join(F.broadcast(B.next_set(held, 500, 20_000))).join(F.broadcast(B.next_clear(held, 500, 20_000)))  # one row each


@query(f"with {_AB}, c as (select distinct cast(c_custkey as bigint) x from customer), ch as (select x from a where x not in (select x from c) union select x from c where x not in (select x from a)) select b.x, ch.x is not null is_set from b left join ch using (x)")
def bitarray_change(spark, sf):
    """Bits turned round at the customers' numbers, and tested at the second set's."""
    return B.test(B.change(_a(spark, sf), S.of_values(D.table(spark, sf, "customer"), "c_custkey")), _b(spark, sf))


@query(f"with {_AB}, o as (select x from a where x >= 700 order by x limit 40), p as (select x from a where x <= 700 order by x desc limit 40) select x, true forward from o union all select x, false forward from p")
def bitmap_iterate(spark, sf):
    """Iterators moved to 700: the next 40 values and the 40 before."""
    a = _a(spark, sf)
    return S.following(a, 700, 40).withColumn("forward", F.lit(True)).union(S.preceding(a, 700, 40).withColumn("forward", F.lit(False)))


@query(f"with {_AB}, k as (select x, (row_number() over (order by x) - 1) // 256 batch from a) select cast(batch as bigint) batch, min(x) as \"first\", max(x) as \"last\", cast(count(*) as bigint) n from k group by 1")
def bitmap_batches(spark, sf):
    return S.in_batches(_a(spark, sf), 256)


@query(
    f"with {_AB}, g as (select x // 65536 chunk, count(*) n, min(x) lo, max(x) hi, sum(x) total from a group by 1) select cast(count(*) as bigint) chunks, cast(count(*) filter (n <= 4096) as bigint) list_chunks, cast(count(*) filter (n > 4096) as bigint) bit_chunks, "
    "cast(coalesce(sum(n) filter (n <= 4096), 0) as bigint) in_lists, cast(coalesce(sum(n) filter (n > 4096), 0) as bigint) in_bits, cast(sum(n) as bigint) cardinality, min(lo) least, max(hi) greatest, cast(sum(total) as varchar) total from g"
)
def bitmap_statistics(spark, sf):
    return S.statistics(_a(spark, sf))


# Variants


#: Alleles, frequencies and supports of the rows of the dump, by (doc_id + k) mod 5.
_ALLELES = (("A,C,", "0.6,0.4,", "300,200,"), ("G,T,A,", "0.5,0.25,0.25,", "300,200,250,"), ("C,AT,G,T,", "0.4,0.3,0.2,0.1,", "900,300,200,150,"), ("T,A,", "0.995,0.005,", "900,200,"), ("A,G,C,T,", "0.25,0.25,0.25,0.25,", "99,250,250,250,"))


def _dump_lines(spark, sf):
    """Six lines of a dump for each contig, in both trailing layouts, with every reason to be left out; comments and blank lines too."""
    six = D.genome(spark, sf).where(F.length("seq") > 0).select("ord", F.length("seq").alias("len"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("k"))
    d, k, v = F.col("ord"), F.col("k"), (F.col("ord") + F.col("k")) % 5
    start = (d * 7 + k * 31) % F.col("len")
    at = lambda i: F.element_at(F.array(*[F.lit(x[i]) for x in _ALLELES]), (v + 1).cast("int"))
    either = lambda c, a, b: F.when(c, a).otherwise(b)
    head = [
        d * 10 + k, F.concat(either(d % 17 == 0, "zz", "d"), d.cast("string")), start, start + either((d + k) % 13 == 0, 2, 1), F.concat(F.lit("rs"), (d * 10 + k).cast("string")), F.lit("0"), either((d + k) % 3 == 0, "-", "+"),
        F.lit("N"), F.lit("N"), F.lit("x"), either((d + 2 * k) % 11 == 0, "cDNA", "genomic"), either((d + k) % 7 == 0, "insertion", "single"),
    ]
    tail = F.when(k % 2 == 0, F.concat_ws("\t", at(0), at(2), at(1))).otherwise(F.concat_ws("\t", at(0), at(2), at(1), F.lit("note")))
    line = F.concat_ws("\t", *[c.cast("string") for c in head], tail)
    return six.select(F.when(k == 3, F.concat(F.lit("# comment\n\n"), line)).otherwise(line).alias("value"))


def _parsed(spark, sf):
    folder = f"{D.work_dir(spark)}/dump"
    D.write_lines(_dump_lines(spark, sf), folder)
    lines = spark.read.text(folder).select(F.split("value", "\t")[0].try_cast("long").alias("ord"), "value")
    return variants.parse_dump(lines), D.genome(spark, sf).select("chrom", "seq")


def _lists(i, quote):
    return "case v " + " ".join(f"when {j} then [{', '.join(quote + x + quote for x in row[i].split(',') if x)}]" for j, row in enumerate(_ALLELES)) + " end"


_SNP = (
    f"{SQL_N}, six as (select doc_id, seq, length(seq) len, unnest(range(0, 6)) k from dn where length(seq) > 0), "
    "r as (select doc_id * 10 + k ord, 'd' || doc_id chrom, doc_id, seq, (doc_id * 7 + k * 31) % len pos, (doc_id + k) % 5 v, (doc_id + k) % 3 = 0 minus from six where (doc_id + k) % 13 <> 0 and (doc_id + 2 * k) % 11 <> 0 and (doc_id + k) % 7 <> 0), "
    "one as (select *, substring(seq, pos + 1, 1) ref from (select *, row_number() over (partition by chrom, pos order by ord) rn from r) where rn = 1 and doc_id % 17 <> 0), "
    f"al as (select ord, chrom, pos, ref, {_lists(1, '')} fr, {_lists(2, '')} su, list_transform({_lists(0, chr(39))}, lambda x: case when minus and length(x) = 1 then translate(x, 'ACGT', 'TGCA') else x end) al from one where ref <> 'N'), "
    "cand as (select ord, chrom, pos, al[i] a, fr[i] f, i from (select *, unnest(range(1, len(al) + 1)) i from al where list_contains(al, ref)) where regexp_full_match(al[i], '[ACGT]') and al[i] <> ref and fr[i] >= 0.01 and su[i] >= 100), "
    "best as (select ord, chrom, pos, a, row_number() over (partition by ord order by f desc, i) rk from cand), "
    "sel as (select 'rs' || ord rsid, chrom, cast(pos as bigint) pos, a alt from best where rk = 1)"
)


@query(f"with {_SNP} select rsid, chrom, pos, alt from sel")
def snp_select(spark, sf):
    return V.select_snps(*_parsed(spark, sf), spacing=False)


@query(f"with {_SNP} select rsid, chrom, pos, alt from sel")
def snp_sink(spark, sf):
    """Selected variants written as a list file and read as any such list."""
    folder = f"{D.work_dir(spark)}/selected"
    variants.write_snps(V.select_snps(*_parsed(spark, sf), spacing=False), folder)
    return variants.read_snps(spark, folder).select("rsid", "chrom", "pos", "alt")


@query(
    f"with recursive {_SNP}, s(chrom, pos) as (select chrom, min(pos) from sel group by chrom union all select chrom, n from (select s.chrom, (select min(x.pos) from sel x where x.chrom = s.chrom and x.pos > s.pos + 54) n from s) where n is not null) "
    "select rsid, chrom, pos, alt from sel join s using (chrom, pos)"
)
def snp_spaced(spark, sf):
    return V.select_snps(*_parsed(spark, sf))


@query(
    """with recursive p as (select distinct source chrom, doc_id * 20 + len % 20 start from (select coalesce(source, '') source, doc_id, length(coalesce(text, '')) len from documents)),
    s as (select chrom, min(start) start from p group by chrom
          union all select chrom, n from (select s.chrom, (select min(p.start) from p where p.chrom = s.chrom and p.start > s.start + 54) n from s) where n is not null)
    select chrom, cast(start as bigint) start from s"""
)
def snp_spacing(spark, sf):
    docs = D.table(spark, sf, "documents")
    rows = docs.select(F.coalesce("source", F.lit("")).alias("chrom"), (F.col("doc_id") * 20 + F.length(F.coalesce("text", F.lit(""))) % 20).alias("start")).distinct()
    return V.spaced(rows)


# Codecs


@query(f"with {SQL_D} select doc_id, seq from d")
def lzma_round_trip(spark, sf):
    packed = D.documents(spark, sf).select("doc_id", codecs.lzma_encode(6)("seq").alias("z"))
    return packed.select("doc_id", codecs.lzma_decode("z").cast("string").alias("seq"))


@query(f"with {_RID} select cast(rid as bigint) rid, lpad(hex(rid), 10, '0') as key from r")
def sort_keys(spark, sf):
    """Five-byte big-endian keys, which order as the ordinals do."""
    return _numbered(spark, sf).select(codecs.from_big_endian(codecs.big_endian_key("rid")).alias("rid"), F.hex(codecs.big_endian_key("rid")).alias("key"))


@query("select cast(l_orderkey // 1024 as bigint) part, l_orderkey x from lineitem")
def packed_ids(spark, sf):
    """Order numbers packed as differences, a list for each thousand of them, and unpacked again."""
    rows = D.table(spark, sf, "lineitem").select(F.floor(F.col("l_orderkey") / 1024).alias("part"), "l_orderkey")
    lists = rows.groupBy("part").agg(F.sort_array(F.collect_list("l_orderkey")).alias("ids"))
    return lists.select("part", codecs.packed("ids").alias("bytes")).select("part", F.explode(codecs.unpacked("bytes")).alias("x"))


@query()
def crc64_per_file(spark, sf):
    return R.checksums(_numbered(spark, sf).select("file", "rid", "seq"), "file")


@query(f"with {SQL_R} select cast(rid as bigint) rid, seq from rd")
def archive_round_trip(spark, sf):
    """Reads placed, ordered, cut into compressed blocks and unpacked again."""
    placed = A.canonical(_classified(spark, sf))
    return archive.unpack(archive.cut_blocks(archive.ordered(placed), 1 << 20))


# Files: written from the tables, then read, indexed, encoded and decoded


def _genome_files(spark, sf, work):
    g = D.genome(spark, sf)
    return D.write_lines(g.select(D.fasta(F.col("chrom"), F.concat(F.lit("length "), F.length("seq").cast("string")), F.lower("seq")).alias("value")), f"{work}/genome", gzip=True)


def _read_files(spark, sf, work):
    r = D.reads(spark, sf)
    return D.write_lines(r.select(D.fastq(F.concat(F.lit("r"), F.col("rid").cast("string")), F.col("seq")).alias("value")), f"{work}/reads")


@query(f"with {SQL_N} select 'd' || doc_id as \"name\", 'length ' || length(seq) as \"comment\", lower(seq) seq, cast(null as varchar) qual from dn")
def fasta_scan(spark, sf):
    """FASTA with wrapped lines, gzipped, through Spark's reader."""
    return fastx.read_fastx(spark, _genome_files(spark, sf, D.work_dir(spark)), local=False).select("name", "comment", "seq", "qual")


@query(f"with {SQL_R} select 'r' || rid as \"name\", '' as \"comment\", seq, translate(seq, '{dna.LETTERS}', '@+I#F') qual from rd")
def fastq_scan(spark, sf):
    """FASTQ by way of a list file."""
    work = D.work_dir(spark)
    spark.createDataFrame([(p,) for p in _read_files(spark, sf, work)], "value string").coalesce(1).write.text(f"{work}/list")
    return fastx.read_fastx(spark, fastx.path_list(spark, f"{work}/list")).select("name", "comment", "seq", "qual")


@query(f"with {SQL_R} select cast(count(*) as bigint) reads, cast(max(rid) + 1 as bigint) next_rid, cast(sum(length(seq)) as bigint) bases from (select seq, row_number() over () - 1 rid from rd)")
def fastq_ordinals(spark, sf):
    """Reads of files are numbered without gaps."""
    reads = fastx.with_ordinals(fastx.read_fastx(spark, _read_files(spark, sf, D.work_dir(spark))))
    return reads.agg(F.countDistinct("rid").alias("reads"), (F.max("rid") + 1).alias("next_rid"), F.sum(F.length("seq").cast("long")).alias("bases"))


@query(f"with {_BEST} select cast(rid as bigint) rid, s strand, t attempt, cast(h as int) mismatches, p gpos, cast(pos as bigint) pos from best where rn = 1")
def stored_index(spark, sf):
    """Reads placed by an index that is stored in buckets of groups of seeds and opened again; seeds with more than 64 windows are looked up by a word."""
    path = f"{D.work_dir(spark)}/index"
    G.store_index(W.of_genome(_contigs(spark, sf)), path)
    return A.assign(D.reads(spark, sf), G.open_index(spark, path)).select("rid", "strand", "attempt", "mismatches", "gpos", "pos")


@query(f"with {SQL_R} select seq, cast(count(*) as bigint) n from rd group by 1")
def index_encode_decode(spark, sf):
    """The three commands one after the other, from files to files; decoding compares counts and checksums."""
    work = D.work_dir(spark)
    cli.build_index(spark, _genome_files(spark, sf, work), f"{work}/index", None)
    cli.encode_files(spark, f"{work}/index", _read_files(spark, sf, work), f"{work}/archive", archive.MIN_BLOCK)
    cli.decode_archive(spark, f"{work}/archive", f"{work}/out")
    return spark.read.text(f"{work}/out").groupBy(F.col("value").alias("seq")).agg(F.count("*").alias("n"))


@query(f"with {SQL_R} select '{archive.VERSION}' as \"version\", cast({archive.MIN_BLOCK} as bigint) block_bases, cast(count(*) as bigint) reads, cast(sum(length(seq)) as bigint) bases, cast(min(length(seq)) as bigint) min_length, cast(max(length(seq)) as bigint) max_length from rd")
def archive_header(spark, sf):
    """The header of an archive of reads that no window places."""
    work = D.work_dir(spark)
    none = spark.createDataFrame([], "seed int, hi long, lo long, gpos long")
    reads = D.reads(spark, sf).withColumn("file_ord", (F.floor(F.col("rid") / D.STRIDE) % 3).cast("int"))
    archive.encode(reads, none, f"{work}/archive", block_bases=archive.MIN_BLOCK)
    head = spark.read.parquet(f"{work}/archive/header")
    archive.check_header(head.collect())
    return head.select("version", "block_bases", *_long("reads", "bases", "min_length", "max_length"))


@query(f"with {_PLACED} select 'r' || rid as \"name\", cls, cast(pos as bigint) pos, fwd is_fwd from pl")
def stream_place(spark, sf):
    """Reads placed as their files arrive, in a stream that ends with the files there are."""
    work = D.work_dir(spark)
    _read_files(spark, sf, work)
    G.store_index(W.of_genome(_contigs(spark, sf)), f"{work}/index")
    ingest.place_arriving(spark, f"{work}/reads", G.open_index(spark, f"{work}/index"), f"{work}/placed", f"{work}/progress").awaitTermination()
    return spark.read.parquet(f"{work}/placed").select("name", "cls", "pos", "is_fwd")
