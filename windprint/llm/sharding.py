"""Minimax contiguous partition of documents into shards of near equal bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, text_of

#: Ordered cells that equal texts fall into: four hexadecimal digits of the text's MD5.
CELLS = 16**4


def shard_documents(
    docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text", block_rows: int = 50_000
) -> DataFrame:
    """Put every row into one of ``n_shards`` shards; rows of equal text stay together.

    A row weighs its UTF-8 bytes plus 8. Equal texts form atomic groups; groups are ordered by the MD5 of their
    text and gathered into ``CELLS`` ordered cells, so that the table of sizes is bounded at any input size. A group
    heavier than an even share of what is left gets a shard of its own (at most ``n_shards - 1`` of them). For the
    other cells the smallest capacity at which a greedy pass needs no more than the shards left is found by binary
    search. The cuts are made by a greedy pass that never exceeds that capacity and, within it, closes a shard at an
    even share of what is left, unless too much would remain to the right. Everything is exact integer arithmetic.

    Returns ``id_col, size, text_crc32, law, shard, slot, grown_shard``. Slots count from 0 in each shard without a
    gap. Nulls: a null text weighs 8 and counts as an empty text; a null id is an id like any other. Repeated rows
    each get a slot. An empty table gives an empty result; shards may stay empty where there are fewer groups than
    shards. Extra columns are ignored.
    """
    rows = materialize(
        docs.select(
            F.col(id_col).alias("id"),
            F.octet_length(text_of(text_col)).cast("long").alias("bytes"),
            F.crc32(text_of(text_col).cast("binary")).alias("crc"),
            F.md5(text_of(text_col).cast("binary")).alias("group"),
        ).withColumn("size", F.col("bytes") + 8),
        "shard-rows",
    )
    groups = materialize(rows.groupBy("group").agg(F.sum("size").alias("size"), F.count("*").alias("n")), "shard-groups")
    total, n_rows = groups.agg(F.sum("size"), F.sum("n")).first()
    heavy = groups.orderBy(F.desc("size"), "group").limit(n_shards - 1).select("group", "size").collect()
    alone, left = [], total or 0
    for g in heavy:
        if g["size"] * (n_shards - len(alone)) <= left:
            break
        alone.append(g["group"])
        left -= g["size"]
    cell = F.conv(F.substring("group", 1, 4), 16, 10).cast("int")
    starts = _cuts(groups.filter(~F.col("group").isin(alone)).groupBy(cell.alias("cell")).agg(F.sum("size").alias("size")), n_shards - len(alone))

    shard = F.lit(len(alone) - 1)
    for at in starts:
        shard = shard + (cell >= at).cast("int")
    for i, g in enumerate(alone):
        shard = F.when(F.col("group") == g, i).otherwise(shard)
    salts = max(64, (n_rows or 0) // (n_shards * block_rows))
    placed = rows.select("id", "size", "crc", shard.alias("shard"), F.pmod(F.xxhash64("id", "crc"), F.lit(salts)).cast("int").alias("salt"))
    counts = placed.groupBy("shard", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(counts.select("shard", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")), "shard-offsets")
    within = Window.partitionBy("shard", "salt").orderBy("id", "crc", "size")
    return placed.join(offsets, ["shard", "salt"]).select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("offset") + F.row_number().over(within) - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def _cuts(cells: DataFrame, shards: int) -> list[int]:
    """First cell of each shard, at the smallest capacity at which ``shards`` shards are enough.

    ``cells`` has at most ``CELLS`` rows (cell, size); they make one array of that bounded length.
    """
    listed = cells.agg(
        F.array_sort(F.collect_list(F.struct("cell", "size"))).alias("cells"),
        F.coalesce(F.max("size"), F.lit(0)).alias("most"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("total"),
    ).select("cells", F.expr("transform(cells, c -> c.size)").alias("sizes"), F.expr(f"greatest(most, (total + {shards - 1}) div {shards})").alias("low"), "most", "total")
    # at low + most each closed shard holds more than an even share, so the greedy pass always succeeds there
    search = """
        aggregate(sequence(1, 62), named_struct('low', low, 'high', low + most), (s, i) ->
          if(s.low >= s.high, s,
            if(aggregate(sizes, named_struct('n', 1, 'fill', 0L), (t, x) ->
                 if(t.fill + x <= s.low + (s.high - s.low) div 2,
                    named_struct('n', t.n, 'fill', t.fill + x), named_struct('n', t.n + 1, 'fill', x)), t -> t.n) <= %d,
               named_struct('low', s.low, 'high', s.low + (s.high - s.low) div 2),
               named_struct('low', s.low + (s.high - s.low) div 2 + 1, 'high', s.high))), s -> s.high)
    """ % shards
    # latest is what the greedy pass takes; earliest[j] is the prefix before which cut k-1-j would leave too much to the right
    earliest = """
        aggregate(reverse(sizes), named_struct('cuts', cast(array() as array<bigint>), 'fill', 0L, 'rest', total), (t, x) ->
          if(t.fill + x <= capacity, named_struct('cuts', t.cuts, 'fill', t.fill + x, 'rest', t.rest - x),
             named_struct('cuts', concat(t.cuts, array(t.rest)), 'fill', x, 'rest', t.rest - x)), t -> t.cuts)
    """
    greedy = """
        aggregate(cells, named_struct('starts', cast(array() as array<int>), 'fill', 0L, 'at', 0L), (t, c) ->
          if(size(t.starts) > 0 and t.fill + c.size <= capacity
               and (t.at < coalesce(get(earliest, {k} - 1 - size(t.starts)), 0L)
                    or (t.fill + c.size / 2.0) * ({k} - size(t.starts) + 1) <= total - t.at + t.fill),
             named_struct('starts', t.starts, 'fill', t.fill + c.size, 'at', t.at + c.size),
             named_struct('starts', concat(t.starts, array(c.cell)), 'fill', c.size, 'at', t.at + c.size)), t -> t.starts)
    """.format(k=shards)
    # each step's few numbers become literals: as columns they would be worked out again inside the next step's lambda
    listed = materialize(listed, "shard-cells")
    capacity = listed.select(F.expr(search).alias("capacity")).first()["capacity"]
    sized = listed.withColumn("capacity", F.lit(capacity).cast("long"))
    cuts = sized.select(F.expr(earliest).alias("cuts")).first()["cuts"]
    sized = sized.withColumn("earliest", F.array(*[F.lit(c) for c in cuts]).cast("array<bigint>"))
    return list(sized.select(F.expr(greedy).alias("starts")).first()["starts"])
