"""Readers of the text formats of this field, as typed DataFrames, and the tab-separated sink.

All of them start from ``spark.read.text`` or ``csv``, so files are split and read in parallel. Records that span lines (FASTA,
tandem repeats) are split at the marks that open them.

Defined cases: lines of other kinds are left out; a field that is not a number is null where a number is due; empty files give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: repeat classes that are left out, and the columns of a tandem repeat table
LOW_CLASSES = ["Low_complexity", "Satellite", "Simple_repeat", "Unknown"]
TRF_COLUMNS = ["start", "end", "PeriodSize", "CopyNumber", "ConsensusSize", "PercentMatches", "PercentIndels", "Score", "A", "C", "G", "T", "Entropy", "Motif", "Sequence"]


def read_bed(spark: SparkSession, path: str, extra: str = "") -> DataFrame:
    """chrom, start, end and ``extra`` columns (a DDL string) of a file without header."""
    return spark.read.csv(path, sep="\t", schema="chrom string, start long, end long" + (f", {extra}" if extra else ""))


def _fields(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.text(path).select(F.split("value", "\t").alias("f")).where(F.col("f")[0] == kind)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """node, seq, len and tags of GFA S lines."""
    rows = _fields(spark, path, "S")
    return rows.select(F.col("f")[1].alias("node"), F.col("f")[2].alias("seq"), F.length(F.col("f")[2]).cast("long").alias("len"), F.expr("slice(f, 4, greatest(0, size(f) - 3))").alias("tags"))


def segment_positions(segments: DataFrame, reference: str) -> DataFrame:
    """chrom, start, end, node, orient (always forward) of the segments (node, tags) of which a tag places them on the reference, as in
    ``reference#0#chr1:10-25``; commas in numbers are dropped. A node placed by several tags has a row for each."""
    tags = F.transform(F.filter("tags", lambda t: t.contains(reference)), lambda t: F.replace(t, F.lit(","), F.lit("")))
    rows = segments.select("node", F.explode(tags).alias("t"))
    part = lambda k: F.regexp_extract("t", r"([^#:\s]+):(\d+)-(\d+)", k)
    placed = rows.where(F.col("t").rlike(r"[^#:\s]+:\d+-\d+"))
    return placed.select(part(1).alias("chrom"), part(2).cast("long").alias("start"), part(3).cast("long").alias("end"), "node", F.lit(">").alias("orient"))


def sequence_lengths(contigs: DataFrame) -> DataFrame:
    """chrom, length of sequences (name, seq)."""
    return contigs.select(F.col("name").alias("chrom"), F.length("seq").cast("long").alias("length"))


def read_lengths(spark: SparkSession, path: str) -> DataFrame:
    """chrom, length of a FASTA index."""
    return spark.read.csv(path, sep="\t", schema="chrom string, length long, offset long, bases long, width long").select("chrom", "length")


def walk_steps(walk):
    """array<struct<orient, node>> of text like >12<13."""
    orient, node = F.regexp_extract_all(walk, F.lit(r"([<>])[^<>]+"), 1), F.regexp_extract_all(walk, F.lit(r"[<>]([^<>]+)"), 1)
    return F.arrays_zip(orient.alias("orient"), node.alias("node"))


def read_walks(spark: SparkSession, path: str) -> DataFrame:
    """One row for each step of GFA W lines: sample, hap, contig, start, end, ord, orient, node."""
    f = F.col("f")
    rows = _fields(spark, path, "W").select(f[1].alias("sample"), f[2].alias("hap"), f[3].alias("contig"), f[4].cast("long").alias("start"), f[5].cast("long").alias("end"), F.posexplode(walk_steps(f[6])).alias("ord", "step"))
    return rows.select("sample", "hap", "contig", "start", "end", "ord", "step.orient", "step.node")


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """The nine fixed columns and one column for each sample, named by the #CHROM line."""
    lines = spark.read.text(path)
    header = lines.where(F.col("value").startswith("#CHROM")).first()[0].lstrip("#").split("\t")
    rows = lines.where(~F.col("value").startswith("#")).select(F.split("value", "\t").alias("f"))
    return rows.select(*[F.col("f")[k].cast("long").alias(c) if c == "POS" else F.col("f")[k].alias(c) for k, c in enumerate(header)])


def melt_genotypes(vcf: DataFrame, missing: str = ".") -> DataFrame:
    """CHROM, POS, ID, sample, gt (int; null if missing) and status of each call: CALLED, MISSING or, for -1, ABSENT."""
    fixed = ["CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT"]
    long = vcf.unpivot(["CHROM", "POS", "ID"], [c for c in vcf.columns if c not in fixed], "sample", "call")
    status = F.when(F.col("call") == missing, "MISSING").when(F.col("call") == "-1", "ABSENT").otherwise("CALLED")
    return long.select("CHROM", "POS", "ID", "sample", F.when(F.col("call") != missing, F.col("call").cast("int")).alias("gt"), status.alias("status"))


def _records(spark: SparkSession, path: str, mark: str) -> DataFrame:
    """name, body of the records of files in which a line that begins with ``mark`` opens one: the files are split at those marks, not at lines, so a
    record is whole wherever a split falls, and lines keep their order."""
    rows = spark.read.option("lineSep", "\n" + mark).text(path)
    text = F.regexp_replace("value", rf"^{mark}", "")  # of the first record of a file
    return rows.select(F.regexp_extract(text, r"^(\S+)", 1).alias("name"), F.regexp_replace(text, r"^[^\n]*\n?", "").alias("body")).where("name <> ''")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """name, seq of every record; a record is one row, as long as it may be."""
    return _records(spark, path, ">").select("name", F.regexp_replace("body", r"\s+", "").alias("seq"))


def write_annotation(df: DataFrame, path: str, columns: list[str]) -> None:
    """A tab-separated table of just these columns, in this order, with a header, sorted by its first three."""
    write_table(df.select(*columns).orderBy(*columns[:3]), path)


def mask_sequences(contigs: DataFrame, regions: DataFrame, by: str = "N") -> DataFrame:
    """name, seq with the half-open regions (chrom, start, end) overwritten."""
    from spanweave.operators.intervals import merge_intervals

    cuts = merge_intervals(regions).groupBy("chrom").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("cuts"))
    rows = contigs.join(cuts, contigs["name"] == cuts["chrom"], "left")
    done = F.aggregate("cuts", F.col("seq"), lambda s, c: F.overlay(s, F.repeat(F.lit(by), (c["end"] - c["start"]).cast("int")), (c["start"] + 1).cast("int")))
    return rows.select("name", F.coalesce(done, F.col("seq")).alias("seq"))


def read_trf(spark: SparkSession, path: str, shift: int = 1) -> DataFrame:
    """Tandem repeats of a .dat file: chrom from the line that begins with @ above, and the row's fields; starts are
    lowered by ``shift``."""
    lines = _records(spark, path, "@").select(F.col("name").alias("chrom"), F.explode(F.split("body", "\n")).alias("value"))
    f = F.split(F.trim("value"), " ")
    kept = lines.where(F.col("value").rlike(r"^\d+ ")).select("chrom", f.alias("f"))
    typed = [F.col("f")[k] if c in ("Motif", "Sequence") else F.col("f")[k].cast("double") for k, c in enumerate(TRF_COLUMNS)]
    typed[0], typed[1] = F.col("f")[0].cast("long") - shift, F.col("f")[1].cast("long")
    return kept.select("chrom", *[t.alias(c) for t, c in zip(typed, TRF_COLUMNS)])


def read_repeats(spark: SparkSession, path: str, excluded: list[str] = LOW_CLASSES) -> DataFrame:
    """chrom, start, end, strand, name, kind of a repeat annotation (.out), without the excluded classes."""
    f = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    rows = spark.read.text(path).where(F.col("value").rlike(r"^\s*\d+\s")).select(f.alias("f"))
    out = rows.select(F.col("f")[4].alias("chrom"), (F.col("f")[5].cast("long") - 1).alias("start"), F.col("f")[6].cast("long").alias("end"), F.when(F.col("f")[8] == "C", "-").otherwise("+").alias("strand"), F.col("f")[9].alias("name"), F.col("f")[10].alias("kind"))
    return out.where(~F.col("kind").rlike("|".join(excluded))) if excluded else out


def parse_paf(lines: DataFrame, column: str = "value", wide: bool = False) -> DataFrame:
    """Alignment pairs from PAF lines whose names are chr:s-e: both places in absolute coordinates, match and
    mismatch bases, orientation, identity, aligned length and match share of the block; a region's hit on itself is left out. ``wide``: the
    names (que_source, ref_source) and how much of each named region is aligned (que_ratio, ref_ratio) too."""
    f = F.split(column, "\t")
    cigar = F.regexp_extract(F.col(column), r"cg:Z:(\S+)", 1)
    wrong = F.aggregate(F.regexp_extract_all(cigar, F.lit(r"(\d+)X"), 1), F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))
    part = lambda k, i: F.regexp_extract(f[k], r"^(.*):(\d+)-(\d+)$", i)
    place = lambda k, i: part(k, 2).cast("long") - 1 + f[i].cast("long")
    ratio = lambda k, i, j: F.try_divide(f[j].cast("long") - f[i].cast("long"), part(k, 3).cast("long") - part(k, 2).cast("long"))
    more = [f[0].alias("que_source"), f[5].alias("ref_source"), ratio(0, 2, 3).alias("que_ratio"), ratio(5, 7, 8).alias("ref_ratio")] if wide else []
    rows = lines.select(
        part(5, 1).alias("ref_chr"), place(5, 7).alias("ref_start"), place(5, 8).alias("ref_end"),
        part(0, 1).alias("que_chr"), place(0, 2).alias("que_start"), place(0, 3).alias("que_end"),
        f[9].cast("long").alias("match_base"), wrong.alias("mismatch_base"), f[4].alias("orient"),
        (f[9].cast("long") / (f[9].cast("long") + wrong)).alias("identity"), f[10].cast("long").alias("align_len"), (f[9].cast("long") / f[10].cast("long")).alias("matchindel"), *more,
    )
    same = (F.col("ref_chr") == F.col("que_chr")) & (F.col("ref_start") == F.col("que_start")) & (F.col("ref_end") == F.col("que_end"))
    return rows.where(~same)


def write_table(df: DataFrame, path: str, by: list[str] | None = None, header: bool = True) -> None:
    """Tab-separated files, in folders by the values of ``by`` if given."""
    writer = df.write.mode("overwrite").option("sep", "\t").option("header", header)
    (writer.partitionBy(*by) if by else writer).csv(path)


def save_by_node(df: DataFrame, table: str, buckets: int = 64, by: list[str] | None = None, path: str | None = None) -> None:
    """A table in ``buckets`` by node, sorted by it, in folders by the values of ``by`` (walks: sample). Tables with equal bucket counts are joined by node without a shuffle, as often
    as they are used."""
    writer = df.repartition(buckets, "node").write.mode("overwrite").bucketBy(buckets, "node").sortBy("node")
    if by:
        writer = writer.partitionBy(*by)
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(table)
