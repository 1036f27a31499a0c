"""Sequences derived from the text tables: letter i of the alphabet becomes ACGT[i mod 4], and j becomes N where N is wanted.

Genome: one contig for each row of `documents`, with N. Reads: each row of `pages` cut into
pieces of 80, 100 or 120 bases by its number, the rest included, with N; every other page as
its reverse complement. All are whole tables. Files are written from them for the queries
that read files.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.functions import dna

ALPHABET = "abcdefghijklmnopqrstuvwxyz"
BASES = "".join("ACGT"[i % 4] for i in range(26))
#: The same with N for j.
BASES_N = BASES[:9] + "N" + BASES[10:]
STRIDE = 10_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sequence(text: str, bases: str = BASES):
    return F.translate(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), "[^a-z]", ""), ALPHABET, bases)


def documents(spark: SparkSession, sf_dir: str, bases: str = BASES) -> DataFrame:
    """(doc_id, source, seq); spread over the cores, since a table may be one file."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return spread(docs).select("doc_id", "source", sequence("text", bases).alias("seq"))


def spread(df: DataFrame) -> DataFrame:
    """df in at least as many partitions as there are cores; larger inputs are split by their files already."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def genome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ord, chrom, seq) as the contig operator takes it."""
    return documents(spark, sf_dir, BASES_N).select(F.col("doc_id").alias("ord"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("chrom"), "seq")


def read_length(page: str) -> Column:
    return (80 + 20 * (F.col(page) % 3)).cast("int")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rid, seq): rid is page_id * STRIDE + place of the piece, from 1."""
    pages = spread(table(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", sequence("html", BASES_N).alias("seq"))
    pieces = pages.where(F.length("seq") >= 1).select("page_id", "seq", F.explode(F.sequence(F.lit(1), F.length("seq"), read_length("page_id"))).alias("off"))
    piece = F.substring(F.col("seq"), F.col("off"), read_length("page_id"))
    return pieces.select((F.col("page_id") * STRIDE + F.col("off")).alias("rid"), F.when(F.col("page_id") % 2 == 1, dna.reverse_complement(piece)).otherwise(piece).alias("seq"))


def work_dir(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir, which all executors share; a temporary one only where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or "file://" + os.path.join(tempfile.gettempdir(), "strandframe")
    return f"{base.rstrip('/')}/files-{uuid.uuid4().hex}"


def files_of(spark: SparkSession, folder: str) -> list[str]:
    """Paths of the part files of a folder, in order of name."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = [x.getPath().toString() for x in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)]
    return sorted(p for p in found if p.rsplit("/", 1)[1].startswith("part-"))


def write_lines(lines: DataFrame, folder: str, gzip: bool = False) -> list[str]:
    """Writes a string column, whose values may hold line feeds, as text files and gives their paths."""
    lines.write.mode("overwrite").text(folder, compression="gzip" if gzip else "none")
    return files_of(lines.sparkSession, folder)


def fasta(name: Column, comment: Column, seq: Column, width: int = 60) -> Column:
    """A FASTA record with its sequence in lines of `width`."""
    return F.concat(F.lit(">"), name, F.lit(" "), comment, F.lit("\n"), F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n"))


def fastq(name: Column, seq: Column) -> Column:
    """A FASTQ record; qualities begin with "@" where that is easily taken for a header."""
    return F.concat(F.lit("@"), name, F.lit("\n"), seq, F.lit("\n+\n"), F.translate(seq, dna.LETTERS, "@+I#F"))


#: The same views for DuckDB.
SQL_D = f"d as (select doc_id, source, translate(regexp_replace(lower(coalesce(text, '')), '[^a-z]', '', 'g'), '{ALPHABET}', '{BASES}') seq from documents)"
SQL_N = f"dn as (select doc_id, source, translate(regexp_replace(lower(coalesce(text, '')), '[^a-z]', '', 'g'), '{ALPHABET}', '{BASES_N}') seq from documents)"
SQL_RC = f"reverse(translate({{0}}, '{dna.LETTERS}', '{dna.PAIRS}'))"
SQL_R = f"""pg as (select page_id, 80 + 20 * (page_id % 3) size, translate(regexp_replace(lower(coalesce(html, '')), '[^a-z]', '', 'g'), '{ALPHABET}', '{BASES_N}') seq from pages),
 rd as (select rid, case when page_id % 2 = 1 then {SQL_RC.format("piece")} else piece end seq
        from (select page_id, page_id * {STRIDE} + off rid, substring(seq, off, size) piece from (select page_id, size, seq, unnest(range(1, length(seq) + 1, size)) off from pg where length(seq) >= 1)))"""
