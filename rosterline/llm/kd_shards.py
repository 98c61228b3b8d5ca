"""Shards of equal bytes from a k-d tree over document metadata, with DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rosterline.llm.common import bucket_bits, hash_key, prefix_sums, staged

LEVEL_BITS = 20  # of a coordinate
TIE_BITS = 32  # of the hash that orders rows of equal coordinates
ROW_BITS = 10  # of these, the last, from the number of the stored row
DIGIT = 13  # bits that one histogram round settles


def text_bytes(text: str = "text") -> Column:
    return (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 1).cast("long")


def metadata() -> dict[str, Column]:
    """The dimensions: what is known of a document besides its text."""
    spread = lambda name: F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")).cast("double")
    number = F.col("doc_id").try_cast("double")  # of an id that is no finite number, a hash
    is_number = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < float("inf"))
    place = F.when(F.col("doc_id").isNull(), 0.0).when(is_number, number).otherwise(spread("doc_id"))
    return {"size": F.log(text_bytes()), "source": spread("source"), "lang": spread("lang"), "id": place}


def kd_shards(docs: DataFrame, target_bytes: float | None = None, shards: int | None = None,
              dimensions: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every document.

    Every node of the tree takes the dimension in which its rows spread widest, relative to all rows, and is cut
    at the weighted median: the bytes on both sides differ by no more than one document. Rows that are equal in
    that dimension are ordered by a hash, so that a value which a third of the rows share can be cut too.
    The median comes from histograms that settle 13 bits of the order a round, for all nodes of a level at
    once; the driver sees one row per node. Levels are cut until leaves reach ``target_bytes`` (or there are
    ``shards`` of them, a power of two).

    Null texts are 1 byte and count as empty for the checksum; null metadata is a value of its own; repeated
    rows can be cut apart, into 1,024 parts; fewer rows than leaves leave shards empty. Other columns are not looked at.
    """
    dimensions = dimensions or metadata()
    names = list(dimensions)
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    base = docs.select("doc_id", text_bytes().alias("size"), crc.alias("text_crc32"), hash_key("doc_id").alias("key"),
                       *[dimensions[name].alias(f"d_{name}") for name in names])
    base = staged(base.withColumn("rid", F.monotonically_increasing_id()), "metadata")
    total = base.agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"),
                     *[f(f"d_{name}").alias(f"{end}_{name}") for name in names for f, end in ((F.min, "low"), (F.max, "high"))]).first()
    levels = math.ceil(math.log2(shards)) if shards else max(0, math.ceil(math.log2((total["bytes"] or 1) / target_bytes)))
    steps = (1 << LEVEL_BITS) - 1
    # Rows that are equal in all of these lie beside each other, in 1,024 places that can be cut apart.
    same = F.xxhash64("key", "doc_id", "text_crc32", "size").bitwiseAND((1 << (TIE_BITS - ROW_BITS)) - 1)
    tie = F.shiftleft(same, ROW_BITS).bitwiseOR(F.xxhash64("rid").bitwiseAND((1 << ROW_BITS) - 1))
    places = []
    for name in names:
        low, high = total[f"low_{name}"], total[f"high_{name}"]
        scaled = (F.col(f"d_{name}") - low) / (high - low) * steps if low is not None and high > low else F.lit(0)
        places.append(F.shiftleft(F.floor(scaled).cast("long"), TIE_BITS).bitwiseOR(tie).alias(f"p_{name}"))
    rows = staged(base.select("doc_id", "size", "text_crc32", "key", *places), "places")
    node = F.lit(0)
    width = LEVEL_BITS + TIE_BITS
    for level in range(levels):
        spans = rows.groupBy(node.alias("node")).agg(
            F.sum("size").alias("bytes"),
            *[(F.shiftright(F.max(f"p_{n}"), TIE_BITS) - F.shiftright(F.min(f"p_{n}"), TIE_BITS)).alias(n) for n in names]).collect()
        widest = {row["node"]: max(names, key=lambda n: (row[n], -names.index(n))) for row in spans}
        need = {row["node"]: row["bytes"] / 2 for row in spans}  # bytes that should lie below the cut
        cut = dict.fromkeys(widest, 0)
        place = _by_node(node, {each: F.col(f"p_{dimension}") for each, dimension in widest.items()})
        for shift in range(width - DIGIT, -1, -DIGIT):
            head = _by_node(node, {each: F.lit(value) for each, value in cut.items()})
            # Rows that agree with the digits settled so far.
            left = F.shiftright(place, shift + DIGIT) == F.shiftright(head, shift + DIGIT)
            digits = F.shiftright(place, shift).bitwiseAND((1 << DIGIT) - 1)
            bins = rows.filter(left).groupBy(node.alias("node"), digits.alias("digit")).agg(F.sum("size").alias("bytes"))
            upto = F.sum("bytes").over(Window.partitionBy("node").orderBy("digit"))
            bins = bins.withColumn("upto", upto).withColumn("need", _by_node(F.col("node"), {each: F.lit(float(value)) for each, value in need.items()}))
            hits = bins.filter("upto >= need").groupBy("node").agg(F.min(F.struct("digit", (F.col("upto") - F.col("bytes")).alias("below"))).alias("hit"))
            for row in hits.collect():
                cut[row["node"]] |= row["hit"]["digit"] << shift
                need[row["node"]] -= row["hit"]["below"]
        above = place > _by_node(node, {each: F.lit(value) for each, value in cut.items()})
        # One stored column per level keeps the next level's plan short.
        rows = staged(rows.withColumn("node", (F.coalesce(node, F.lit(0)) * 2 + above.cast("int")).cast("int")), f"level{level}")
        node = F.col("node")
    placed = rows.withColumn("shard", node.cast("int")).withColumn("one", F.lit(1).cast("long")).withColumn("group", F.col("shard").cast("string"))
    placed = prefix_sums(placed, "group", "key", "one", ["doc_id", "size", "text_crc32"], bucket_bits(total["rows"]), "slot")
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _by_node(node: Column, values: dict[int, Column]) -> Column:
    if len(values) == 1:
        return next(iter(values.values()))
    out = None
    for each, value in sorted(values.items()):
        out = F.when(node == each, value) if out is None else out.when(node == each, value)
    return out if out is not None else F.lit(0)
