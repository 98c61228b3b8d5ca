"""Near-duplicates by SimHash fingerprints and multi-index hashing."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterline.llm.common import column_function, staged

SHINGLE = 3
DISTANCE = 3
CROWD = 128  # owners of a segment value from which links go by hubs
FEW = 40_000  # fingerprints whose lookups, 32 each, Spark may broadcast: under 200 MB


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """A signed 64-bit number; a bit is set if it is in over half of the shingles' hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        words, shingle = [b" ".join(words)], 1
    join = b" ".join
    hashes = [xxhash.xxh64_intdigest(join(each), 42) for each in zip(*(words[i:] for i in range(shingle)))]
    bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    set_bits = bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes)
    return int(np.packbits(set_bits, bitorder="little").view("<i8")[0])


@column_function("long")
def fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(text) for text in texts], dtype="int64")


def links(prints: DataFrame) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints ``fp`` whose components are those of all links at 3 bits or fewer.

    The fingerprint has two segments of 32 bits, so linked ones differ by at most one bit in one of them. Each
    fingerprint owns its two segment values in the table. It looks up the values in the ball of radius 1 around
    each; of two values one bit apart only the one that has the bit set looks up the other, which finds every
    pair once. Candidates are verified on all 64 bits.

    A value that very many fingerprints own would give pairs with the square of their number. There the links
    go through hubs: around each member's other segment, all values in a small ball. Two members that differ
    by d bits there meet at a hub between them, and all who are near enough to a hub link to the least owner
    within one bit of it. That takes a fixed number of rows per member and links the same components.

    Spark sizes an exploded table like the table it comes from, dozens of times too low, and would broadcast it
    through the driver. So what is exploded is joined by sorting both sides, or filtered by the crowded values;
    owners and lookups of few fingerprints are left to Spark, as sorts in many small tasks take executors more memory.
    """
    few = prints.count() <= FEW
    segments = F.array(*[
        F.struct(F.lit(i).alias("segment"), own.alias("own"), other.alias("other"))
        for i, (own, other) in enumerate([_halves(0), _halves(1)])
    ])
    halves = prints.select("fp", F.explode(segments).alias("s")).select("fp", "s.*")
    table = halves.select("segment", F.col("own").alias("value"), "fp", "other")
    cleared = F.expr("transform(filter(sequence(0, 31), i -> (shiftright(own, i) & 1L) = 1L), i -> own ^ shiftleft(1L, i))")
    lookups = halves.select("segment", F.explode(cleared).alias("value"), "fp", "other")
    crowded = staged(table.groupBy("segment", "value").agg(F.count("*").alias("owners")).filter(F.col("owners") >= CROWD), "crowds")
    crowded = crowded.select("segment", "value")

    owners = table.join(crowded, ["segment", "value"], "left_anti")
    mine = owners.select("segment", "value", F.col("fp").alias("a"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE
    joined = mine if few else mine.hint("merge")
    same = joined.join(owners.select("segment", "value", F.col("fp").alias("b")), ["segment", "value"]).filter("a < b")
    next_to = joined.join(lookups.select("segment", "value", F.col("fp").alias("b")), ["segment", "value"])
    plain = same.unionByName(next_to).filter(near).select("a", "b")

    def ball(radius: int) -> str:
        hubs = "array(struct(other as hub, 0 as away))"
        if radius >= 1:
            hubs = f"concat({hubs}, transform(sequence(0, 31), i -> struct(other ^ shiftleft(1L, i) as hub, 1 as away)))"
        if radius >= 2:
            pairs = "flatten(transform(sequence(1, 31), i -> transform(sequence(0, i - 1), j -> struct(other ^ shiftleft(1L, i) ^ shiftleft(1L, j) as hub, 2 as away))))"
            hubs = f"concat({hubs}, {pairs})"
        return hubs

    keys = ["segment", "value", "hub"]
    inside = table.join(crowded, ["segment", "value"], "left_semi").select("segment", "value", "fp", F.explode(F.expr(ball(2))).alias("h")).select("segment", "value", "fp", "h.*")
    guests = lookups.join(crowded, ["segment", "value"], "left_semi").select("segment", "value", "fp", F.explode(F.expr(ball(1))).alias("h")).select("segment", "value", "fp", "h.*")
    anchors = inside.filter("away <= 1").groupBy(*keys).agg(F.min("fp").alias("anchor"))
    members = inside.unionByName(guests).join(anchors.hint("merge"), keys).filter("fp <> anchor")
    through = members.select(F.least("fp", "anchor").alias("a"), F.greatest("fp", "anchor").alias("b"))
    verified = through.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE)
    return plain.unionByName(verified).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _halves(segment: int):
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned("fp", 32)
    return (low, high) if segment == 0 else (high, low)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge; the root is the least node it reaches.

    Alternates two star steps until nothing changes: every node links its greater neighbours to the least
    one it knows, then itself and its lesser neighbours to the least. Each step only groups and joins by node,
    which adaptive execution splits where one node has very many edges; each round is written out.
    """
    edges = staged(edges.select("a", "b"), "edges")  # a < b
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = staged(large, "large")  # here a > b
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.greatest("b", "m").alias("x"), "m", "a")
        small = small.select(F.col("m").alias("a"), F.col("x").alias("b")).unionByName(small.select(F.col("m").alias("a"), F.col("a").alias("b")))
        edges = staged(small.filter("a < b").distinct(), "edges")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    roots = edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))
    return roots.unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()).groupBy("node").agg(F.min("root").alias("root"))


def near_duplicates(docs: DataFrame, keep_row: bool = False) -> DataFrame:
    """doc_id, fingerprint, component_id and ``first`` for every document; with ``keep_row`` also ``row``.

    ``first`` marks one row per component: the least doc_id, nulls last, and of rows that repeat it the first
    stored. Texts without words have the fingerprint zero and link like others. Null ids never name a component
    that has another id. An empty table gives no rows. Other columns are not looked at.
    """
    columns = ["doc_id", fingerprints(F.col("text")).alias("fp")]
    if keep_row:
        columns.append(F.struct(*[docs[name] for name in docs.columns]).alias("row"))
    rows = staged(docs.select(*columns).withColumn("rid", F.monotonically_increasing_id()), "fingerprints")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid"))
    prints = staged(rows.groupBy("fp").agg(least.alias("least")), "prints")
    roots = staged(components(links(prints.select("fp"))), "roots")
    rooted = prints.join(roots, prints["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    named = rooted.groupBy("root").agg(F.min("least").alias("least"))
    of_print = staged(rooted.drop("least").join(named, "root").select("fp", "least"), "components")
    return rows.join(of_print, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("least.doc_id").alias("component_id"),
        (F.col("rid") == F.col("least.rid")).alias("first"), *(["row"] if keep_row else []),
    )
