"""Balanced shards by label propagation under capacity quotas.

Rows of one group (equal texts) are linked, and so are rows that an edge table (src, dst, weight) joins. Every row starts in a
shard drawn by hash; the rows of one group in one starting shard move together, as a piece. In each round a piece weighs
the shards by its links: by how much of each link's weight lies there, the piece's own share with it. It proposes to move to
the heaviest shard that has room, and a shard admits proposals, the largest pieces first, while they fit its room (its
capacity less the pieces that are content where they are). A refused piece proposes again, perhaps another shard, in the next round, so
a group larger than a shard fills few shards.
Proposals are ranked in a bounded number of buckets, so no shard's movers meet in one task.
What a shard then holds beyond its capacity (unlinked rows first) is dealt to the shards
with room. Law: ``bytes``; every shard's bytes differ from the mean by about one row at most.

All orders over unbounded rows are taken in levels (totals of buckets, of blocks of them, then rows in a bucket); the rows of a
large group are spread over consecutive buckets.

Defined cases: null text has size 1 and counts as equal to the empty text; repeated rows and
repeated or null doc_id give one output row each; a group larger than a shard is split; an empty
table gives no rows; other columns are ignored. Edges of unknown or null nodes, loops and edges with weights that are not
positive count for nothing; several edges between two nodes add up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanweave.operators.running import running
from spanweave.llm.text import quoted
from spanweave.scratch import Scratch

SHARDS = 16
ROUNDS = 4
#: Rows in one bucket of an order, about, and buckets in one block.
BUCKET_ROWS = 2000
BLOCK_BUCKETS = 4096
#: Places for the parts of one group among the buckets.
_PARTS = 1 << 24


def _running(df: DataFrame, part: str | None, bucket: str, order: list, amount: Column, name: str) -> DataFrame:
    """``name``: what rows before this one, in the order (bucket, order) within ``part``, sum up to."""
    keys = [part] if part else ["_all"]
    df = df if part else df.withColumn("_all", F.lit(0))
    totals = df.groupBy(*keys, bucket).agg(F.sum(amount).alias("_sum"))
    n, low, high = totals.agg(F.count("*"), F.min(bucket), F.max(bucket)).first()
    blocks = max(1, n // BLOCK_BUCKETS)
    width = max(1, ((high or 0) - (low or 0)) // blocks + 1)
    totals = totals.withColumn("_block", F.floor((F.col(bucket) - F.lit(low or 0)) / F.lit(width)))
    before = running(totals, keys, [bucket], "_before", F.col("_sum"), "sum", inclusive=False).select(*keys, bucket, F.coalesce("_before", F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.withColumn("_inside", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
        .join(before, [*keys, bucket])
        .withColumn(name, F.col("_before") + F.col("_inside"))
        .drop("_before", "_inside", "_all")
    )


_PIECE = ["g", "start"]


def _links(base: DataFrame, edges: DataFrame | None) -> DataFrame:
    """g, start, link, w: how heavily each piece hangs on each link. A link is a group of several rows or a pair of pieces."""
    rows = base.groupBy(*_PIECE).agg(F.count("*").cast("double").alias("w"))
    several = rows.groupBy("g").agg(F.sum("w").alias("n")).where("n > 1").select("g")
    groups = rows.join(several, "g", "left_semi").select(*_PIECE, F.xxhash64(F.lit("group"), "g").alias("link"), "w")
    if edges is None:
        return groups
    at = base.where("node is not null").select("node", *_PIECE)
    side = lambda k: at.withColumnsRenamed({"node": k, "g": f"g_{k}", "start": f"start_{k}"})
    joined = edges.where("weight > 0 and src <> dst").select("src", "dst", F.col("weight").cast("double").alias("w")).join(side("src"), "src").join(side("dst"), "dst")
    a, b = (F.struct(F.col(f"g_{k}").alias("g"), F.col(f"start_{k}").alias("start")) for k in ("src", "dst"))
    pairs = joined.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), "w").where("a <> b").groupBy("a", "b").agg(F.sum("w").alias("w"))
    ends = pairs.select(F.explode(F.array("a", "b")).alias("p"), F.xxhash64(F.lit("edge"), "a", "b").alias("link"), "w")
    return groups.unionByName(ends.select("p.g", "p.start", "link", "w"))


def cut_weight(placed: DataFrame, links: DataFrame) -> float:
    """Weight that is cut: over all links, the products of what two different shards hold of it. placed: g, start, cur."""
    held = links.join(placed.select(*_PIECE, "cur"), _PIECE).groupBy("link", "cur").agg(F.sum("w").alias("m"))
    whole = held.groupBy("link").agg(((F.sum("m") * F.sum("m") - F.sum(F.col("m") * F.col("m"))) / 2).alias("c"))
    return float(whole.agg(F.coalesce(F.sum("c"), F.lit(0.0))).first()[0])


def _pick(rooms: list[float], shard: str) -> Column:
    return F.get(F.array(*map(F.lit, rooms)), F.col(shard))


def _propagate(tmp: Scratch, pieces: DataFrame, links: DataFrame, cap: float, shards: int, rounds: int) -> DataFrame:
    """pieces: g, start, cur, bytes. Moves pieces for some rounds; returns them with a new ``cur``."""
    first = links.groupBy(*_PIECE).agg(F.min("link").alias("own"), F.sum("w").alias("degree"))
    pieces = tmp.save(pieces.join(first.drop("degree"), _PIECE), "linked")
    links = tmp.save(links.join(first.drop("own"), _PIECE), "weighted")
    for k in range(rounds):
        at = links.join(pieces.select(*_PIECE, "cur"), _PIECE)
        held = at.groupBy("link", F.col("cur").alias("to")).agg(F.sum("w").alias("m"), F.max("degree").alias("d"))
        weighed = links.join(held, "link").groupBy(*_PIECE, "to").agg(F.sum(F.col("w") * F.col("m")).alias("gain"), F.max("d").alias("d"))
        # ties go to the more heavily linked neighbour, then the same way for pieces of one link
        rank = F.struct("gain", "d", F.xxhash64("own", "to", F.lit(k)))
        weighed = tmp.save(weighed.join(pieces, _PIECE).select(*_PIECE, "to", "cur", "bytes", "own", rank.alias("rank")), f"weighed{k}")
        best = weighed.groupBy(*_PIECE).agg(F.max_by("to", "rank").alias("best"), F.max("cur").alias("cur"), F.max("bytes").alias("bytes"))
        loads = {r[0]: r[1] for r in best.where("best = cur").groupBy("cur").agg(F.sum("bytes")).collect()}
        room = [max(0.0, cap - loads.get(s, 0)) for s in range(shards)]
        open_ = weighed.where((F.col("to") == F.col("cur")) | (F.col("bytes") <= _pick(room, "to")))
        moves = open_.groupBy(*_PIECE).agg(F.max_by("to", "rank").alias("to"), F.max("cur").alias("cur"), F.max("bytes").alias("bytes"), F.max("own").alias("own"))
        order = F.lit(63) - F.least(F.lit(63), F.floor(F.log2("bytes")))
        moves = tmp.save(moves.withColumn("bucket", order * 64 + F.pmod(F.xxhash64(*_PIECE, F.lit(k)), F.lit(64))), f"moves{k}")
        over = Window.partitionBy("to").orderBy("bucket")
        # at most shards * 4096 rows; a bucket that does not fit is passed over
        demand = moves.where("cur <> to").groupBy("to", "bucket").agg(F.sum("bytes").alias("b"))
        admitted = (
            demand.where(F.col("b") <= _pick(room, "to"))
            .withColumn("total", F.sum("b").over(over))
            .where(F.col("total") <= _pick(room, "to"))
            .select(F.col("to").alias("_to"), F.col("bucket").alias("_bucket"))
        )
        hit = (F.col("to") == F.col("_to")) & (F.col("bucket") == F.col("_bucket")) & (F.col("cur") != F.col("to"))
        after = moves.join(F.broadcast(admitted), hit, "left").select(
            *_PIECE, F.when(F.col("_to").isNotNull(), F.col("to")).otherwise(F.col("cur")).alias("cur"), "bytes", "own"
        )
        previous, pieces = pieces, tmp.save(after, f"pieces{k}")
        tmp.drop(previous, moves, weighed)
    return pieces


def balanced_shards(rows: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, edges: DataFrame | None = None, report: dict | None = None) -> DataFrame:
    """rows: any columns, with ``g`` (group) and ``size`` (long), and ``node`` if there are ``edges`` (src, dst, weight). Adds shard int and slot
    long. ``report``: a dictionary that gets the weight cut before and after the rounds."""
    spark = rows.sparkSession
    tmp = Scratch(spark, "shards")
    given = [c for c in rows.columns if c not in ("shard", "slot")]
    # the caller's other columns travel under names of their own
    names = {c: c if c in ("g", "size", "node") else f"c_{k}" for k, c in enumerate(given)}
    own = list(names.values())
    base = tmp.save(
        rows.select(*[F.col(quoted(c)).alias(n) for c, n in names.items()]).withColumn("_k", F.xxhash64(*own)).withColumn("start", F.pmod(F.xxhash64("_k", F.lit(1)), F.lit(shards)).cast("int")),
        "base",
    )
    total, n = base.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    cap, buckets = total / shards, max(1, n // BUCKET_ROWS)
    links = tmp.save(_links(base, edges), "links")
    pieces = base.groupBy(*_PIECE).agg(F.sum("size").alias("bytes")).select(*_PIECE, F.col("start").alias("cur"), "bytes")
    moved = _propagate(tmp, pieces, links, cap, shards, rounds)
    if report is not None:
        report.update(before=cut_weight(pieces, links), after=cut_weight(moved, links))
    parts = base.groupBy("g").agg(F.count("*").alias("_n")).where("_n > 1").select("g", F.ceil(F.col("_n") / BUCKET_ROWS).alias("_parts"))
    linked = F.pmod(F.xxhash64("g"), F.lit(buckets)) * _PARTS + F.pmod(F.xxhash64("_k", F.lit(4)), F.coalesce("_parts", F.lit(1)))
    alone = F.lit(buckets * _PARTS) + F.pmod(F.col("_k"), F.lit(buckets))
    placed = (
        base.join(moved.select(*_PIECE, "cur"), _PIECE, "left")
        .join(parts, "g", "left")
        .select(*own, "_k", "start", F.coalesce("cur", "start").alias("at"), F.when(F.col("cur").isNotNull(), linked).otherwise(alone).alias("bucket"))
    )
    placed = tmp.save(placed, "at")
    order = ["g", "_k", *own]
    after = tmp.save(_running(placed, "at", "bucket", order, F.col("size"), "begin"), "placed")
    tmp.drop(placed)
    placed = after
    stays = F.col("begin") + F.col("size") <= cap
    kept = {r[0]: r[1] for r in placed.where(stays).groupBy("at").agg(F.sum("size")).collect()}
    ends, run = [], 0.0
    for s in range(shards):
        run += max(0.0, cap - kept.get(s, 0))
        ends.append(run)
    pool = tmp.save(placed.where(~stays).withColumn("b2", F.pmod(F.xxhash64("_k", F.lit(2)), F.lit(buckets))), "pool")
    dealt = _running(pool, None, "b2", order, F.col("size"), "p")
    middle = F.col("p") + F.col("size") / 2
    shard = F.lit(shards - 1)
    for s in range(shards - 2, -1, -1):
        shard = F.when(middle < ends[s], s).otherwise(shard)
    done = tmp.save(
        placed.where(stays)
        .select(*own, "_k", F.col("at").alias("shard"))
        .unionByName(dealt.select(*own, "_k", shard.cast("int").alias("shard")))
        .withColumn("b3", F.pmod(F.xxhash64("_k", F.lit(3)), F.lit(max(1, buckets // shards)))),
        "done",
    )
    tmp.drop(base, placed, moved, pool, links)
    out = _running(done, "shard", "b3", ["_k", *own], F.lit(1), "slot")
    return out.select(*[F.col(n).alias(c) for c, n in names.items()], "shard", F.col("slot").cast("long").alias("slot"))


def documents_as_rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.unhex(F.md5(text)).alias("g"),
    )


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return balanced_shards(documents_as_rows(docs)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


QUERIES = {"op10_sharding": op10_sharding}
ORACLE: dict[str, str] = {}
