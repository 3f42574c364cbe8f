"""List ranking by pointer jumping: the members of chains or lists, numbered along them, in as many rounds of joins as the logarithm of the longest one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanweave.scratch import Scratch


def rank_chains(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, chain (the smaller of its two ends), place (links from that end) of every node of ``links`` (a, b: neighbours, once each, in either
    direction). Every node has one or two neighbours. A ring has no end, and is an error, like more than ``max_rounds`` rounds.

    Each link is two arcs, one for each direction. An arc (u -> v) points to the arc that goes on from v, and after each round twice as far;
    at the last one it knows the end of the chain in its direction and how far that is. Links with a null end are left out; a link to
    itself is left out as well, and its node is a chain of its own if it has no other."""
    tmp = Scratch(links.sparkSession, "chains")
    pairs = links.select("a", "b").where("a is not null and b is not null").distinct()
    alone = pairs.where("a = b").select("a")
    both = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    arcs = both.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(both.select(F.col("b").alias("u"), F.col("a").alias("v")))
    arcs = tmp.save(arcs, "arcs")
    onward = arcs.select(F.col("u").alias("v"), F.col("v").alias("w"))
    # of the arcs that leave v the one that does not go back; to_u -> to_v is the arc pointed to, null at an end
    step = arcs.join(onward, "v", "left").groupBy("u", "v").agg(F.max(F.when(F.col("w") != F.col("u"), F.col("w"))).alias("w"), F.count("w").alias("n"))
    now = tmp.save(
        step.select("u", "v", F.when(F.col("w").isNotNull(), F.col("v")).alias("to_u"), F.col("w").alias("to_v"), F.col("v").alias("end"), F.lit(1).cast("long").alias("far"), "n"),
        "round",
    )
    if now.where("n > 2").limit(1).count():
        raise ValueError("a node of a chain has more than two neighbours")
    for k in range(max_rounds):
        open_ = now.where("to_u is not null")
        if not open_.limit(1).count():
            break
        ahead = now.select(F.col("u").alias("to_u"), F.col("v").alias("to_v"), F.col("to_u").alias("_u"), F.col("to_v").alias("_v"), F.col("end").alias("_end"), F.col("far").alias("_far"))
        moved = open_.join(ahead, ["to_u", "to_v"]).select("u", "v", F.col("_u").alias("to_u"), F.col("_v").alias("to_v"), F.col("_end").alias("end"), (F.col("far") + F.col("_far")).alias("far"))
        after = tmp.save(moved.unionByName(now.where("to_u is null").select(moved.columns)), f"round{k}")
        tmp.drop(now)
        now = after
    else:
        raise ValueError("a ring, which has no end, or too many rounds")
    # a node's ends: those of the arcs that leave it; a node at an end has one
    ends = now.select(F.col("u").alias("node"), "end", "far").unionByName(now.select(F.col("end").alias("node"), F.col("end"), F.lit(0).cast("long").alias("far")).distinct())
    first = ends.groupBy("node").agg(F.min(F.struct("end", "far")).alias("m")).select("node", F.col("m.end").alias("chain"), F.col("m.far").alias("place"))
    rest = alone.join(first.select(F.col("node").alias("a")), "a", "left_anti")
    return first.unionByName(rest.select(F.col("a").alias("node"), F.col("a").alias("chain"), F.lit(0).cast("long").alias("place")))


def rank_lists(rows: DataFrame, longest: int) -> DataFrame:
    """id, head, place of every row of ``rows`` (id; prev, the id before it in its list, or null). No id is the prev of two rows; no list has more than
    ``longest`` rows. A ring is cut before its smallest id."""
    tmp = Scratch(rows.sparkSession, "lists")

    def jumped(now: DataFrame, name: str) -> DataFrame:
        # at: the row that the pointer has reached, place: links to it (to the head once at is null); low: the smallest id on the way
        now = tmp.save(now.select("id", F.col("prev").alias("at"), F.col("id").alias("head"), F.col("prev").isNotNull().cast("long").alias("place"), F.col("id").alias("low")), name)
        for k in range(max(1, longest).bit_length() + 1):
            if not now.where("at is not null").limit(1).count():
                break
            ahead = now.select(F.col("id").alias("at"), F.col("at").alias("_at"), F.col("head").alias("_head"), F.col("place").alias("_place"), F.col("low").alias("_low"))
            both = now.join(ahead, "at", "left")
            on = F.col("at").isNotNull()
            moved = both.select(
                "id", F.when(on, F.col("_at")).alias("at"), F.when(on, F.col("_head")).otherwise(F.col("head")).alias("head"),
                F.when(on, F.col("place") + F.col("_place")).otherwise(F.col("place")).alias("place"), F.least("low", "_low").alias("low"),
            )
            after = tmp.save(moved, f"{name}{k}")
            tmp.drop(now)
            now = after
        return now

    once = jumped(rows, "round")
    rings = once.where("at is not null").select("id", "low")
    lists = once.where("at is null").select("id", "head", "place")
    if not rings.limit(1).count():
        return lists
    cut = rings.join(rows, "id").select("id", F.when(F.col("id") != F.col("low"), F.col("prev")).alias("prev"))
    return lists.unionByName(jumped(cut, "ring").select("id", "head", "place"))
