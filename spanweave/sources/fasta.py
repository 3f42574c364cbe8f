"""Sequences in chunks: (name, chunk, start, seq), so that no row holds a contig and a range reads only the chunks it touches.

Chunk k of a sequence holds its letters from k * bases on; the last one may be shorter. ``start`` is 0-based.

Defined cases: a sequence without letters, or null, has no chunks; ranges are cut to what there is of the sequence, and those without letters, with a null
place or an unknown name have a null result; repeated ranges have a row each; letters before the first header of a file are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.operators.intervals import merge_intervals
from spanweave.operators.running import running

BASES = 1 << 20


def _cut(rows: DataFrame, bases: int) -> DataFrame:
    """name, chunk, at, part of stretches (name, pos, seq) of sequences, cut at chunk edges."""
    last = F.col("pos") + F.length("seq") - 1
    chunk = F.explode(F.sequence(F.expr(f"pos div {bases}"), F.floor(last / bases)))
    each = rows.where(F.length("seq") > 0).select("name", "pos", "seq", chunk.alias("chunk"))
    low = F.greatest(F.col("chunk") * bases, F.col("pos"))
    high = F.least((F.col("chunk") + 1) * bases, F.col("pos") + F.length("seq"))
    part = F.col("seq").substr((low - F.col("pos") + 1).cast("int"), (high - low).cast("int"))
    return each.select("name", "chunk", low.alias("at"), part.alias("part"))


def _put_together(parts: DataFrame, bases: int) -> DataFrame:
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda x: x["part"]), "")
    return parts.groupBy("name", "chunk").agg(text.alias("seq")).select("name", "chunk", (F.col("chunk") * bases).alias("start"), "seq")


def chunk_sequences(contigs: DataFrame, bases: int = BASES) -> DataFrame:
    """Chunks of whole sequences (name, seq)."""
    cut = _cut(contigs.select("name", F.lit(0).cast("long").alias("pos"), "seq"), bases)
    return cut.select("name", "chunk", F.col("at").alias("start"), F.col("part").alias("seq"))


def read_fasta_chunks(spark: SparkSession, path: str, bases: int = BASES) -> DataFrame:
    """Chunks of FASTA files. Lines are read by all tasks; which sequence a line belongs to, and where in it, follows from the headers and lengths of the lines
    before it, carried from one split of a file to the next. No index is needed, and no task reads a whole contig."""
    lines = spark.read.text(path).select(
        F.regexp_replace("value", r"\s+$", "").alias("line"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row")
    )
    header = F.col("line").startswith(">")
    named = F.when(header, F.struct("_block", "_row", F.regexp_extract("line", r"^>(\S*)", 1).alias("name")))
    rows = running(lines, ["_file"], ["_row"], "_head", named, "last").where(~header & F.col("_head").isNotNull())
    rows = rows.withColumn("seq", F.regexp_replace("line", r"\s", "")).withColumn("n", F.length("seq").cast("long"))
    rows = running(rows, ["_file", "_head"], ["_row"], "pos", F.col("n"), "sum").withColumn("pos", F.col("pos") - F.col("n"))
    return _put_together(_cut(rows.select(F.col("_head.name").alias("name"), "pos", "seq"), bases), bases)


def chunk_lengths(chunks: DataFrame) -> DataFrame:
    """chrom, length."""
    return chunks.groupBy(F.col("name").alias("chrom")).agg(F.max(F.col("start") + F.length("seq")).cast("long").alias("length"))


def fetch(chunks: DataFrame, regions: DataFrame, bases: int = BASES, closed: bool = False) -> DataFrame:
    """regions (chrom, start, end; 0-based and half-open, or 1-based with the end if ``closed``) with seq. Each distinct range is joined to the chunks it touches by
    (name, chunk); a name or chunk that many ranges touch is split by adaptive execution."""
    first = F.greatest(F.col("start") - (1 if closed else 0), F.lit(0)).cast("long")
    spots = regions.select("chrom", "start", "end", first.alias("_a"), F.col("end").cast("long").alias("_b")).distinct()
    touched = spots.where("_a < _b and chrom is not null").join(chunk_lengths(chunks), "chrom").withColumn("_b", F.least("_b", "length")).where("_a < _b")
    touched = touched.withColumn("chunk", F.explode(F.sequence(F.expr(f"_a div {bases}"), F.expr(f"(_b - 1) div {bases}"))))
    own = chunks.select(F.col("name").alias("chrom"), "chunk", F.col("start").alias("_s"), "seq")
    low, high = F.greatest("_a", "_s"), F.least(F.col("_b"), F.col("_s") + F.length("seq"))
    part = F.col("seq").substr((low - F.col("_s") + 1).cast("int"), (high - low).cast("int"))
    parts = touched.join(own, ["chrom", "chunk"]).select("chrom", "start", "end", "chunk", part.alias("part"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "part"))), lambda x: x["part"]), "")
    found = parts.groupBy("chrom", "start", "end").agg(text.alias("seq"))
    return regions.join(found, ["chrom", "start", "end"], "left")


def mask_chunks(chunks: DataFrame, regions: DataFrame, bases: int = BASES, by: str = "N") -> DataFrame:
    """chunks with the half-open regions (chrom, start, end) overwritten: what lies between cuts, and the cuts, put together once."""
    union = merge_intervals(regions.where("start < end")).select("chrom", F.greatest("start", F.lit(0)).cast("long").alias("start"), F.col("end").cast("long").alias("end"))
    limited = union.join(chunk_lengths(chunks), "chrom").withColumn("end", F.least("end", "length")).where("start < end")
    each = limited.withColumn("chunk", F.explode(F.sequence(F.expr(f"start div {bases}"), F.expr(f"(end - 1) div {bases}"))))
    inside = each.select(
        F.col("chrom").alias("name"), "chunk",
        F.struct(F.greatest(F.col("start") - F.col("chunk") * bases, F.lit(0)).cast("int").alias("s"), F.least(F.col("end") - F.col("chunk") * bases, F.lit(bases)).cast("int").alias("e")).alias("c"),
    )
    cuts = inside.groupBy("name", "chunk").agg(F.array_sort(F.collect_list("c")).alias("cuts"))
    rows = chunks.join(cuts, ["name", "chunk"], "left")
    before = lambda c, i: F.when(i == 0, F.lit(0)).otherwise(F.element_at("cuts", F.greatest(i, F.lit(1)))["e"])
    pieces = F.transform("cuts", lambda c, i: F.concat(F.col("seq").substr(before(c, i) + 1, c["s"] - before(c, i)), F.repeat(F.lit(by), c["e"] - c["s"])))
    rest = F.col("seq").substr(F.element_at("cuts", -1)["e"] + 1, F.length("seq"))
    done = F.when(F.col("cuts").isNull(), F.col("seq")).otherwise(F.concat(F.array_join(pieces, ""), rest))
    return rows.select("name", "chunk", "start", done.alias("seq"))
