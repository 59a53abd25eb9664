"""Sharding by fixed virtual slots and a versioned, stored map from slots to shards.

Records are hashed by text into a fixed number of slots, bytes and rows are
summed for each slot, and slots are dealt to shards by size (law `bytes`: shards
near equal in bytes). The map from slots to shards is a small table with a
version, which is written and read again before records are placed. Rebalancing
edits it: slots move from the fullest shards to the emptiest, and records whose
slot stays don't move.

Equal texts are one group and share a slot. A group with more than an eighth of
a shard has slots of its own, numbered after the common ones. It is one slot, and
so on one shard, unless the group alone is larger than a fair share of all
bytes, total / shards: no division with such a group whole has shards near
equal, so only then is it dealt to several slots, by doc_id and, among
rows that are wholly equal, by their running number. There are at most
8 * shards groups with slots of their own and twice as many such slots, whatever
the corpus.

A record's size is its UTF-8 bytes plus one; its place in its shard has no gaps.
Places are counted in bins of about `BIN` records, dealt by hashes of id, text and
running number, so that one id, null ids or one text in most rows spread too.

Null text: as the empty text, size 1. Null doc_id: a value like others. Repeated
rows are sharded each; their places differ. Records of equal size, id and text
are interchangeable. Very long texts: a record is never cut, so a shard may
exceed its share by the largest record. Extra columns are ignored. An empty
table gives an empty result and map.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm._rounds import cut, shared_folder

SLOTS = 4096
#: A group of equal texts larger than this part of a shard has slots of its own.
LARGE = 8
BIN = 1 << 20
#: Hexadecimal digits of MD5 that make a hash number of 60 bits.
DIGITS = 15


@dataclass(frozen=True)
class Slot:
    """A virtual slot with what it holds."""

    slot: int
    bytes: int
    rows: int


@dataclass(frozen=True)
class Group:
    """A large group of equal texts, by their hash: its slots are first, first + 1, ..., first + pieces - 1."""

    text: int
    first: int
    pieces: int


@dataclass(frozen=True)
class ShardMap:
    """shard_of: slot -> shard; groups: those with slots of their own."""

    version: int
    shards: int
    shard_of: dict[int, int] = field(default_factory=dict)
    groups: tuple[Group, ...] = ()

    @classmethod
    def deal(cls, slots: Iterable[Slot], shards: int, groups: tuple[Group, ...] = ()) -> ShardMap:
        """First map: the largest slot that is left goes to the emptiest shard."""
        heap, out = [(0, s) for s in range(shards)], {}
        for x in sorted(slots, key=lambda x: (-x.bytes, x.slot)):
            size, shard = heapq.heappop(heap)
            out[x.slot] = shard
            heapq.heappush(heap, (size + x.bytes, shard))
        return cls(1, shards, out, groups)

    def rebalanced(self, slots: Iterable[Slot], shards: int | None = None, groups: tuple[Group, ...] | None = None, slack: float = 0.02) -> ShardMap:
        """Next version, for other sizes or another number of shards: as few slots as needed move."""
        shards, slots = shards or self.shards, {x.slot: x for x in slots}
        now = {k: self.shard_of.get(k, -1) for k in slots}
        load, held = [0] * shards, [[] for _ in range(shards)]
        homeless = []
        for k, x in slots.items():
            if 0 <= now[k] < shards:
                load[now[k]] += x.bytes
                held[now[k]].append(x)
            else:
                homeless.append(x)
        goal = sum(x.bytes for x in slots.values()) / shards
        for shard, mine in enumerate(held):
            for x in sorted(mine, key=lambda x: (-x.bytes, x.slot)):
                if load[shard] > goal * (1 + slack) and load[shard] - x.bytes >= goal * (1 - slack):
                    load[shard] -= x.bytes
                    homeless.append(x)
        heap = [(size, s) for s, size in enumerate(load)]
        heapq.heapify(heap)
        for x in sorted(homeless, key=lambda x: (-x.bytes, x.slot)):
            size, shard = heapq.heappop(heap)
            now[x.slot] = shard
            heapq.heappush(heap, (size + x.bytes, shard))
        return replace(self, version=self.version + 1, shards=shards, shard_of=now, groups=self.groups if groups is None else groups)

    def write(self, spark: SparkSession, path: str) -> None:
        """Add this version to the table at `path`: a row for each slot, which names its group if it has one."""
        of = {g.first + k: g for g in self.groups for k in range(g.pieces)}
        rows = [(self.version, self.shards, slot, shard, *((g.text, g.first, g.pieces) if (g := of.get(slot)) else (None, None, None))) for slot, shard in sorted(self.shard_of.items())]
        spark.createDataFrame(rows, "version int, shards int, slot int, shard int, group_text long, group_first int, group_pieces int").coalesce(1).write.mode("append").parquet(path)

    @classmethod
    def read(cls, spark: SparkSession, path: str, version: int | None = None) -> ShardMap:
        """The given version, or the last."""
        table = spark.read.parquet(path)
        version = version or table.agg(F.max("version")).first()[0]
        rows = table.where(F.col("version") == version).collect() if version else []  # a row for each slot: their number is fixed
        groups = {Group(r["group_text"], r["group_first"], r["group_pieces"]) for r in rows if r["group_text"] is not None}
        return cls(version or 1, rows[0]["shards"] if rows else 1, {r["slot"]: r["shard"] for r in rows}, tuple(sorted(groups, key=lambda g: g.first)))


def _number(x: Column) -> Column:
    """A hash number of 60 bits that is the same in any engine."""
    return F.conv(F.substring(F.md5(x), 1, DIGITS), 16, 10).cast("long")


def records(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, text (its hash number), id (a hash number of doc_id), n: wholly equal rows as one.

    Written to the checkpoint folder, so that texts are read once; some forty bytes a record.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    digest = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), _number(text).alias("text"))
    return cut(digest.groupBy("doc_id", "size", "text_crc32", "text").agg(F.count("*").alias("n")).withColumn("id", _number(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))))


def _copies(found: DataFrame) -> DataFrame:
    """A row for each record, with its running number among wholly equal ones; numbers are dealt in stretches."""
    stretch = 1 << 16
    starts = found.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(stretch).cast("long"))).alias("__from"))
    return starts.select("doc_id", "size", "text_crc32", "text", "id", F.explode(F.sequence("__from", F.least(F.col("__from") + stretch, F.col("n")) - 1)).alias("copy"))


def _slot(groups: DataFrame, rows: DataFrame, slots: int) -> DataFrame:
    """Adds virtual_slot to rows with text, id, copy. groups: at most 8 * shards rows."""
    piece = F.pmod(F.col("id") + F.col("copy"), F.col("pieces"))
    joined = rows.join(F.broadcast(groups), "text", "left")
    return joined.withColumn("virtual_slot", F.coalesce(F.col("first") + piece, F.pmod("text", F.lit(slots))).cast("int")).drop("first", "pieces")


def _groups(spark: SparkSession, groups: tuple[Group, ...]) -> DataFrame:
    return spark.createDataFrame([(g.text, g.first, g.pieces) for g in groups], "text long, first int, pieces int")


def slot_sizes(found: DataFrame, shards: int, slots: int = SLOTS, known: tuple[Group, ...] = ()) -> tuple[list[Slot], tuple[Group, ...]]:
    """(bytes and rows of each slot, groups with slots of their own). known: groups of an earlier map, which keep their slots."""
    spark = found.sparkSession
    sums = [F.sum(F.col("size") * F.col("n")).alias("bytes"), F.sum("n").alias("rows")]
    common = F.pmod("text", F.lit(slots)).cast("int")
    whole = {r["slot"]: r for r in found.groupBy(common.alias("slot")).agg(*sums).collect()}  # at most `slots` rows
    total = sum(r["bytes"] for r in whole.values())
    heavy = sorted(k for k, r in whole.items() if r["bytes"] * LARGE * shards > total)
    if not heavy:
        return [Slot(k, r["bytes"], r["rows"]) for k, r in sorted(whole.items())], known
    texts = found.where(common.isin(heavy)).groupBy("text").agg(*sums)
    large = texts.where(F.col("bytes") * F.lit(LARGE * shards) > F.lit(total)).orderBy("text").collect()  # less than 8 * shards
    groups, seen = list(known), {g.text for g in known}
    nxt = max([g.first + g.pieces for g in known], default=slots)
    for r in large:
        if r["text"] not in seen:
            pieces = 1 if r["bytes"] * shards <= total else -(-r["bytes"] * LARGE * shards // total)
            groups.append(Group(r["text"], nxt, pieces))
            nxt += pieces
    own = found.where(F.col("text").isin([g.text for g in groups]))
    pieces = _slot(_groups(spark, tuple(groups)), _copies(own), slots).groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect() if groups else []
    taken: dict[int, list[int]] = {}
    for r in own.groupBy(common.alias("slot")).agg(*sums).collect() if groups else ():
        taken[r["slot"]] = [r["bytes"], r["rows"]]
    left = [Slot(k, r["bytes"] - taken.get(k, (0, 0))[0], r["rows"] - taken.get(k, (0, 0))[1]) for k, r in sorted(whole.items())]
    return [x for x in left if x.rows] + [Slot(r["virtual_slot"], r["bytes"], r["rows"]) for r in sorted(pieces, key=lambda r: r["virtual_slot"])], tuple(groups)


def assign(found: DataFrame, shard_map: ShardMap, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot, shard, place (in the shard, from 0) of all records by a map."""
    spark = found.sparkSession
    dealt = spark.createDataFrame(sorted(shard_map.shard_of.items()), "virtual_slot int, shard int")
    placed = _slot(_groups(spark, shard_map.groups), _copies(found), slots).join(F.broadcast(dealt), "virtual_slot", "left")  # a row for each slot
    placed = placed.withColumn("shard", F.coalesce("shard", F.pmod("virtual_slot", F.lit(shard_map.shards))))  # a slot that the map was made without
    bins = max(1, -(-(found.agg(F.sum("n")).first()[0] or 0) // BIN))
    binned = placed.withColumn("bin", F.pmod(F.col("id") + F.col("text") + F.col("copy"), F.lit(bins)))
    counts = binned.groupBy("shard", "bin").agg(F.count("*").alias("rows"))
    before = F.coalesce(F.sum("rows").over(Window.partitionBy("shard").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ahead = counts.select("shard", "bin", before.alias("before"))
    within = F.row_number().over(Window.partitionBy("shard", "bin").orderBy("doc_id", "size", "text", "copy")) - 1
    numbered = binned.withColumn("within", within).join(ahead, ["shard", "bin"])
    return numbered.select("doc_id", "size", "text_crc32", "virtual_slot", "shard", (F.col("before") + F.col("within")).alias("place"))


def sharding(docs: DataFrame, shards: int = 16, slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """assign() by the map stored at `path`.

    Where there is none yet, the first version is dealt and stored. Where there is, a version that is
    rebalanced to the records and to `shards` follows it. Without a path the map is kept in the shared folder.
    """
    spark = docs.sparkSession
    new = path is None
    path = path or f"{shared_folder(spark)}/shard-map-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    new = new or not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
    found = records(docs)
    if new:
        sizes, groups = slot_sizes(found, shards, slots)
        ShardMap.deal(sizes, shards, groups).write(spark, path)
    else:
        last = ShardMap.read(spark, path)
        sizes, groups = slot_sizes(found, shards, slots, last.groups)
        last.rebalanced(sizes, shards, groups).write(spark, path)
    return assign(found, ShardMap.read(spark, path), slots)
