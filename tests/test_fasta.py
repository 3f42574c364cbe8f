"""Sequences in chunks: many splits of a file, ranges across chunk edges, masking."""

import random

from spanweave.sources import fasta

RNG = random.Random(3)


def contigs():
    return {name: "".join(RNG.choice("ACGTacgtN") for _ in range(n)) for name, n in {"chr1": 5_000, "chr2": 1, "long": 120_000, "edge": 700}.items()}


def written(path, seqs):
    with open(path, "w") as f:
        f.write("stray\n")
        for k, (name, seq) in enumerate(seqs.items()):
            width = 60 + k
            f.write(f">{name} some text\n" + "".join(seq[i : i + width] + "\n" for i in range(0, len(seq), width)) + ("\n" if k == 1 else ""))
        f.write(">empty\n")


def test_chunks_of_a_file_of_many_splits(spark, tmp_path):
    seqs = contigs()
    written(f"{tmp_path}/a.fa", seqs)
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "2000")
    try:
        chunks = fasta.read_fasta_chunks(spark, f"{tmp_path}/a.fa", 700)
        assert spark.read.text(f"{tmp_path}/a.fa").rdd.getNumPartitions() > 10
        rows = chunks.collect()
    finally:
        spark.conf.set(key, before)
    got = {name: "".join(r.seq for r in sorted((r for r in rows if r.name == name), key=lambda r: r.chunk)) for name in {r.name for r in rows}}
    assert got == seqs and all(r.start == 700 * r.chunk and (len(r.seq) == 700 or r.start + len(r.seq) == len(seqs[r.name])) for r in rows)
    assert {(r.chrom, r.length) for r in fasta.chunk_lengths(chunks).collect()} == {(n, len(s)) for n, s in seqs.items()}


def test_ranges_and_masks(spark):
    seqs = contigs()
    whole = spark.createDataFrame([*seqs.items(), ("none", None), ("empty", "")], "name string, seq string")
    chunks = fasta.chunk_sequences(whole, 700)
    ranges = [(n, a, a + RNG.choice([1, 5, 699, 700, 701, 3_000])) for n in seqs for a in [0, 1, 699, 700, 1_399, *(RNG.randrange(len(seqs[n])) for _ in range(10))]]
    ranges += [ranges[0], ("edge", 690, 9_999), ("edge", 5, 5), ("edge", -3, 4), ("what", 0, 9), (None, 0, 9), ("edge", None, 9), ("none", 0, 5)]
    df = spark.createDataFrame(ranges, "chrom string, start long, end long")
    for closed in (False, True):
        found = fasta.fetch(chunks, df, 700, closed).collect()
        assert len(found) == len(ranges)
        for r in found:
            known = r.chrom in seqs and r.start is not None
            want = seqs[r.chrom][max(0, r.start - closed) : r.end] if known else ""
            assert r.seq == (want or None)
    masked = fasta.mask_chunks(chunks, df, 700).collect()
    want = {n: list(s) for n, s in seqs.items()}
    for n, a, b in ranges:
        if n in want and a is not None:
            for k in range(max(a, 0), min(b, len(want[n]))):
                want[n][k] = "N"
    got = {n: "".join(r.seq for r in sorted((r for r in masked if r.name == n), key=lambda r: r.chunk)) for n in seqs}
    assert got == {n: "".join(s) for n, s in want.items()}
    assert fasta.mask_chunks(chunks, df.limit(0), 700).count() == chunks.count() and fasta.fetch(chunks.limit(0), df, 700).where("seq is not null").count() == 0
