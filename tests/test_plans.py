"""The region plan from files, against a plain version, and taken up again."""

import math
import random

import numpy as np
import pandas as pd
import pytest

from spanweave.operators import model
from spanweave.plans import regions
from spanweave.plans.stages import Run

rng = random.Random(3)
SAMPLES = ["s1", "s2", "s3", "s4", "s5"]
WINDOWS = [("c1", s, min(s + 100, 620)) for s in range(0, 620, 50)] + [("c2", s, min(s + 100, 230)) for s in range(30, 230, 50)]
VARIANTS = [("c1", 20, "A", "G,TTTT"), ("c1", 95, "ACGTA", "A"), ("c1", 100, "AC", "A"), ("c1", 340, "G", "GTTTTTTTTTT"), ("c2", 31, "A" * 30, "C"), ("c2", 210, "A", "C"), ("c3", 5, "A", "C")]
CALLS = [[rng.choice(["0", "1", "2", "."]) for _ in SAMPLES] for _ in VARIANTS]
SEGMENT = "".join(rng.choice("ACGT") for _ in range(300))
HAPLOTYPES = [(*w, s, "".join(rng.choice("ACGT") for _ in range(40)) + SEGMENT[k : k + rng.randrange(60)]) for w in WINDOWS for k, s in enumerate(SAMPLES)] + [("c1", 0, 100, "s9", "NNN"), ("c1", 0, 100, "s8", None)]
DELTAS = [(*w, s, float(rng.randrange(9))) for w in WINDOWS[1:] for s in SAMPLES] + [(*WINDOWS[0], "s1", None), (*WINDOWS[0], "s2", 4.0)]
COPIES = [("c1", a, a + 20, s, float(rng.randrange(1, 30))) for a in (90, 130, 400) for s in SAMPLES] + [("c2", 0, 31, "s1", 3.0)]
BUBBLES = [("c1", 0, 210, 0.5, 0.2, 0.3, 0.4), ("c1", 0, 150, 0.9, 0.2, 0.1, 0.9), ("c2", 30, 300, 0.1, 0.05, 0.9, 0.5), ("c2", 0, 300, None, 1.0, 1.0, 1.0)]
FITTED = {
    "mean": [k / 10 for k in range(8)], "std": [1 + k / 5 for k in range(8)],
    "layers": [(np.array([[((i * 3 + j) % 5 - 2) / 3 for j in range(4)] for i in range(8)]), np.array([0.1, 0, -0.1, 0.2])), (np.array([[(i - j) / 2 for j in range(2)] for i in range(4)]), np.zeros(2))],
    "centroids": [[(k - 3) / 2, (k % 3) / 2] for k in range(8)],
}


@pytest.fixture()
def inputs(spark, tmp_path):
    (tmp_path / "in.bed").write_text("c1\t0\t300\nc1\t250\t620\nc2\t30\t230\n")
    head = "##fileformat=VCFv4.2\n" + "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *SAMPLES]) + "\n"
    (tmp_path / "in.vcf").write_text(head + "".join("\t".join([c, str(p), ".", r, a, ".", ".", ".", "GT", *calls]) + "\n" for (c, p, r, a), calls in zip(VARIANTS, CALLS)))
    place = "chrom string, start long, end long"
    tables = {
        "haplotypes": (HAPLOTYPES, place + ", sample string, seq string"), "segments": ([(SEGMENT,), (None,)], "seq string"), "deltas": (DELTAS, place + ", sample string, delta double"),
        "copies": (COPIES, place + ", sample string, copies double"), "bubbles": (BUBBLES, place + ", poly double, polyratio double, simple double, pathratio double"),
    }
    out = {"bed": str(tmp_path / "in.bed"), "vcf": str(tmp_path / "in.vcf")}
    for name, (rows, schema) in tables.items():
        out[name] = str(tmp_path / name)
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(out[name])
    return out


def trimmed(values):
    x = np.array([v for v in values if v is not None], float)
    if not len(x):
        return None, None
    lo, hi = np.quantile(x, [0.05, 0.95])
    x = np.sort(x[(x >= lo) & (x <= hi)])
    if len(x) < 2:
        return None, None
    gini = ((2 * np.arange(1, len(x) + 1) - len(x) - 1) * x).sum() / (len(x) * x.sum()) if x.sum() else None
    return x.std(ddof=1), gini


def entropy(calls):
    counts = pd.Series([c for c in calls if c != "."]).value_counts()
    if len(counts) < 2:
        return 0.0
    p = counts / counts.sum()
    return round(-(p * np.log2(p)).sum(), 5) / round(math.log2(len(counts)), 5)


def kmers(seq, k):
    turned = str.maketrans("ACGT", "TGCA")
    parts = [seq[i : i + k] for i in range(len(seq or "") - k + 1)]
    return {min(x, x[::-1].translate(turned)) for x in parts if "N" not in x}


def by_hand(k):
    sigmoid = lambda x, a, b: 1 / (1 + math.exp(-a * (x - b)))
    known, out = kmers(SEGMENT, k), {}
    for c, s, e in WINDOWS:
        near = [(p, p + len(r), len(r), max(map(len, a.split(","))), entropy(g)) for (vc, p, r, a), g in zip(VARIANTS, CALLS) if vc == c and p < e and s < p + len(r)]
        if not near:
            continue
        touched = len({x for a, b, *_ in near for x in range(a, b + 1)})
        match = max(e, max(n[1] for n in near)) - min(s, min(n[0] for n in near)) + 1 - touched
        similar = match / (match + sum(max(n[2], n[3]) for n in near))
        mean = sum(n[3] * n[4] for n in near) / sum(n[3] for n in near)
        sims = [len(kmers(q, k) & known) / len(kmers(q, k)) for *w, _, q in HAPLOTYPES if tuple(w) == (c, s, e) and kmers(q, k)]
        here = [(bc, a, b, p, r, m, h) for bc, a, b, p, r, m, h in BUBBLES if bc == c and a <= s and e <= b and p is not None]
        loci = {(lc, a, b) for lc, a, b, *_ in COPIES if lc == c and a < e and s < b}
        ginis = [g for g in (trimmed([n for *w, _, n in COPIES if tuple(w) == x])[1] for x in loci) if g is not None]
        row = {
            "sd_max": max(sims), "sd_var": trimmed(sims)[0], "Vscore": 1 - similar + mean, "TEgini": trimmed([x for *w, _, x in DELTAS if tuple(w) == (c, s, e)])[1] or 0.0,
            "sim_bubble": max((sigmoid(m, 3, 3) + (h < 0.5) for *_, m, h in here), default=0.01),
            "com_bubble": max((2 * sigmoid(sigmoid(r, 100, 0.1) * p, 3, 3) + (h < 0.5) for *_, p, r, m, h in here), default=0.01),
            "vntr_cov": float(bool(loci)), "vntr_gini_max": max(ginis, default=0.0),
        }
        if row["sd_var"] is None:
            continue
        x = (np.array([row[f] for f in model.FEATURES]) - FITTED["mean"]) / FITTED["std"]
        (w1, b1), (w2, b2) = FITTED["layers"]
        z = np.maximum(x @ w1 + b1, 0) @ w2 + b2
        q = 1 / (1 + ((z - np.array(FITTED["centroids"])) ** 2).sum(1))
        out[c, s, e] = (row, q / q.sum())
    return out


def test_decompose(spark, tmp_path, inputs):
    folder = str(tmp_path / "run")
    done, run = regions.decompose(spark, folder, inputs, FITTED, width=100, step=50, k=11)
    assert done.columns == ["chrom", "start", "end", "cluster", "simple", "CC1", "CC2", "CC3", "CC4", "CC5", "CC6", "CC7"]
    want = by_hand(11)
    features = {(r.chrom, r.start, r.end): r for r in run.table("features").collect()}
    assert set(features) == set(want) and len(want) > 6
    for place, (row, _) in want.items():
        for name, value in row.items():
            assert features[place][name] == pytest.approx(value, abs=1e-9), (place, name)
    for r in done.collect():
        q = want[r.chrom, r.start, r.end][1]
        assert r.cluster == model.LABELS[int(q.argmax())]
        assert [r[c] for c in model.LABELS] == pytest.approx(q.tolist(), abs=1e-9)
    assert len(run.computed) == 10

    again, run = regions.decompose(spark, folder, inputs, FITTED, width=100, step=50, k=11)
    assert run.computed == [] and sorted(map(tuple, again.collect())) == sorted(map(tuple, done.collect()))
    # other bubbles: their branch and what follows
    spark.createDataFrame(BUBBLES[:1], spark.read.parquet(inputs["bubbles"]).schema).write.parquet(inputs["bubbles"], mode="append")
    _, run = regions.decompose(spark, folder, inputs, FITTED, width=100, step=50, k=11)
    assert run.computed == ["bubbles", "features", "classes"]
    _, run = regions.decompose(spark, folder, inputs, FITTED | {"std": [2.0] * 8}, width=100, step=50, k=11)
    assert run.computed == ["classes"]


def test_stage_broken_off_is_computed_anew(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1\n")
    calls = []

    def make(path, fail):
        calls.append(path)
        df = spark.read.text(path)
        return df.selectExpr("raise_error('broken') AS x") if fail() else df

    paths = {"a": str(tmp_path / "a.txt")}
    with pytest.raises(Exception, match="broken"):
        Run(spark, str(tmp_path / "r"), paths).stage("one", lambda p: make(p, lambda: True), inputs=["a"])
    run = Run(spark, str(tmp_path / "r"), paths)
    assert run.stage("one", lambda p: make(p, lambda: False), inputs=["a"]).count() == 1 and run.computed == ["one"] and len(calls) == 2
    with pytest.raises(ValueError):
        run.stage("one", make, inputs=["a"])
    with pytest.raises(FileNotFoundError):
        Run(spark, str(tmp_path / "r"), {"a": str(tmp_path / "absent")})
    assert "one" in (tmp_path / "r" / "manifest.json").read_text()
