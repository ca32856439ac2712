"""Shards of nearly equal size by sampled splitters.

Each row has a place, one long: a hash of its text, then a hash of its id, then a few bits of its position in the file,
so equal texts lie side by side and any group can still be cut. Rows are drawn with probability in proportion to their
size; quantiles of the drawn places are the boundaries of ranges, which lie between texts. The ranges' exact bytes and
rows are counted. One that is overfull is drawn from again and subdivided, between texts while it has several, then
within a text's group; so a text that a third of all rows hold is spread over many ranges.

Ranges are put into shards on the driver: groups larger than a range first, each whole where a shard still has
room for it, then the others in order of place, each shard taking what it lacks. So shards differ by about the size of
one range, or of one row if that is larger, and a group of equal texts is in one shard unless it is larger than what a
shard has room for. Slots are a range's first slot in its shard and a row's number in its range, so no task numbers a
whole shard.

The driver holds a bounded sample and one row a range: ``RANGES``, or a range for each ``ROWS`` rows if those are more.
Everything else is counted over all rows. What the ranges are looked up in is sent to tasks: one entry a range.

Null texts count as empty. Rows without an id, and repeated rows, are sharded like any other. An empty table gives an
empty table. Added columns replace columns of the same names.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import stored, table

#: Ranges that all rows are cut into at least, rows of a range, and draws a range.
RANGES, ROWS, DRAWS = 1024, 1_000_000, 16
#: Bits of a place that the id and the position take; those above are the text's.
ID_BITS, POSITION_BITS = 20, 7
OWN_BITS = ID_BITS + POSITION_BITS
#: Places are looked up by their highest bits first.
BUCKET_BITS = 12
PLACE_BITS = 62


@dataclass
class Range:
    low: int  # the first place
    high: int  # the first place behind
    bytes: int = 0
    rows: int = 0
    texts: bool = True  # if it may hold several texts
    shard: int = 0
    slot: int = 0


def placed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Adds ``size`` (bytes of the text and one more) and ``_place``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    top = lambda c, bits: F.shiftrightunsigned(c, 64 - bits)
    of_text = F.shiftleft(top(F.xxhash64(text), PLACE_BITS - OWN_BITS), OWN_BITS)
    of_id = F.shiftleft(top(F.xxhash64(F.col(id_col), F.lit("id")), ID_BITS), POSITION_BITS)
    position = top(F.xxhash64(F.monotonically_increasing_id()), POSITION_BITS)
    return df.withColumns({"size": (F.octet_length(text) + 1).cast("long"), "_place": of_text.bitwiseOR(of_id).bitwiseOR(position)})


def in_ranges(rows: DataFrame, ranges: list[Range]) -> DataFrame:
    """Adds ``_range``, the number of the range that the row's place is in; rows in none are left out. The ranges go to
    all tasks, by the highest bits of places; their number is bounded (see above)."""
    shift = PLACE_BITS - BUCKET_BITS
    met: dict[int, list[tuple[int, int, int]]] = {}
    for n, r in enumerate(ranges):
        for b in range(r.low >> shift, (r.high - 1 >> shift) + 1):
            met.setdefault(b, []).append((r.low, r.high, n))
    lookup = rows.sparkSession.createDataFrame(sorted(met.items()), "_bucket int, _met array<struct<low:long,high:long,n:int>>")
    joined = rows.withColumn("_bucket", F.shiftright("_place", shift).cast("int")).join(F.broadcast(lookup), "_bucket")
    own = F.filter("_met", lambda r: (r["low"] <= F.col("_place")) & (F.col("_place") < r["high"]))
    return joined.withColumn("_range", F.get(own, F.lit(0))["n"]).where("_range is not null").drop("_bucket", "_met")


def _drawn(rows: DataFrame, ranges: list[Range], draws: list[int]) -> list[list[int]]:
    """For each range drawn places in order, about as many as ``draws`` says: a row's chance goes by its size."""
    own = rows.sparkSession.createDataFrame([(n, d / max(1, r.bytes)) for n, (r, d) in enumerate(zip(ranges, draws, strict=True))], "_range int, _by double")
    chance = F.shiftrightunsigned(F.xxhash64("_place", "size", F.lit("draw")), 11) / F.lit(float(1 << 53))
    drawn = in_ranges(rows.select("_place", "size"), ranges).join(F.broadcast(own), "_range").withColumn("times", F.floor(F.col("size") * F.col("_by") + chance).cast("int"))
    out: list[list[int]] = [[] for _ in ranges]
    for r in drawn.where("times > 0").select("_range", "_place", "times").collect():  # as many as draws say
        out[r._range] += [r._place] * r.times
    return [sorted(x) for x in out]


def subdivided(r: Range, places: list[int], parts: int) -> list[Range]:
    """``r`` cut at quantiles of the drawn places: between texts if it may hold several, with a text that fills a part by
    itself in a range of its own. Where no draw cuts it, it is halved."""
    unit = OWN_BITS if r.texts else 0
    drawn = [p >> unit << unit for p in places]
    edges = {drawn[i * len(drawn) // parts] for i in range(1, parts)} if drawn else set()
    if r.texts:
        for text, times in Counter(drawn).items():
            if times * parts >= len(drawn):
                edges |= {text, text + (1 << OWN_BITS)}
    edges = {e for e in edges if r.low < e < r.high} or {(r.low >> unit) + (r.high >> unit) >> 1 << unit}
    bounds = [r.low, *sorted(edges), r.high]
    return [Range(a, b, texts=r.texts and b - a > 1 << OWN_BITS) for a, b in zip(bounds, bounds[1:], strict=False)]


def splitters(rows: DataFrame, ranges: int = RANGES, most_rows: int = ROWS) -> tuple[list[Range], int]:
    """Ranges that hold all rows, with their exact bytes and rows, none overfull that can be cut, and the bytes above
    which one is. ``rows``: _place, size."""
    total = rows.agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).first()
    if not total.rows:
        return [], 0
    parts = max(ranges, -(-total.rows // most_rows))
    even_bytes, even_rows = -(-total.bytes // parts), -(-total.rows // parts)
    done, full = [], [Range(0, 1 << PLACE_BITS, total.bytes, total.rows)]
    while full:
        wanted = [max(2, -(-r.bytes // even_bytes), -(-r.rows // even_rows)) for r in full]
        pieces = [x for r, p, n in zip(full, _drawn(rows, full, [DRAWS * n for n in wanted]), wanted, strict=True) for x in subdivided(r, p, n)]
        for r in in_ranges(rows.select("_place", "size"), pieces).groupBy("_range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect():
            pieces[r._range].bytes, pieces[r._range].rows = r.bytes, r.rows
        over = lambda r: r.rows > 1 and r.high - r.low > 1 and (r.bytes > 2 * even_bytes or r.rows > 2 * even_rows)
        done += [r for r in pieces if r.rows and not over(r)]
        full = [r for r in pieces if over(r)]
    return sorted(done, key=lambda r: r.low), 2 * even_bytes


def allocate(ranges: list[Range], n_shards: int, most: int) -> None:
    """Sets each range's shard and first slot there. Groups of one text, and ranges over ``most`` bytes, which are one
    row or place, go first."""
    load = [0] * n_shards
    share = -(-sum(r.bytes for r in ranges) // n_shards)
    units: dict[tuple[int, bool], list[Range]] = {}
    for r in ranges:
        if not r.texts or r.bytes > most:
            units.setdefault((r.low >> OWN_BITS, r.texts), []).append(r)
    emptiest = lambda: min(range(n_shards), key=lambda s: (load[s], s))
    for size, _, unit in sorted(((sum(r.bytes for r in u), u[0].low, u) for u in units.values()), key=lambda x: (-x[0], x[1])):
        s = emptiest()
        whole = load[s] + size <= share + most // 2
        for r in unit:
            if not whole and load[s] + r.bytes // 2 > share:
                s = emptiest()
            r.shard, load[s] = s, load[s] + r.bytes
    small = [r for r in ranges if r.texts and r.bytes <= most]
    s, rest = 0, sum(r.bytes for r in small)
    for r in small:
        # measured against what is left for this shard and those behind it, so that errors don't add up
        while s < n_shards - 1 and load[s] and load[s] + r.bytes / 2 >= (rest + sum(load[s:])) / (n_shards - s):
            s += 1
        r.shard, load[s], rest = s, load[s] + r.bytes, rest - r.bytes
    slots = [0] * n_shards
    for r in ranges:
        r.slot, slots[r.shard] = slots[r.shard], slots[r.shard] + r.rows


def shards(df: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, ranges: int = RANGES, most_rows: int = ROWS) -> DataFrame:
    """Adds ``size`` (bytes of the text and one more), ``shard`` (from 0) and ``slot``, gapless from 0 in each shard, in
    order of range and place. Shards have nearly equal sizes. ``keep``: the columns of ``df`` that are carried along
    (all, if not given); what isn't needed, such as texts, need not be moved."""
    names = [c for c in (df.columns if keep is None else keep) if c not in ("size", "shard", "slot")]
    rows = stored(placed(df, id_col, text_col).select(*names, *([F.col(id_col).alias("_id")] if id_col not in names else []), "size", "_place"), "placed")
    cut, most = splitters(rows, ranges, most_rows)
    allocate(cut, n_shards, most)
    where = df.sparkSession.createDataFrame([(n, r.shard, r.slot) for n, r in enumerate(cut)], "_range int, shard int, _first long")
    number = F.row_number().over(Window.partitionBy("_range").orderBy("_place", id_col if id_col in names else "_id", "size"))
    numbered = in_ranges(rows, cut).join(F.broadcast(where), "_range").withColumn("slot", F.col("_first") + number - 1)
    return numbered.select(*names, "size", "shard", "slot")


def write_shards(df: DataFrame, path: str, n_shards: int = 16, **options) -> None:
    """The rows as Parquet in a folder ``shard=n`` for each shard; each file holds a stretch of slots, in order."""
    out = shards(df, n_shards, **options)
    out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op13_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of nearly equal bytes, by ranges of their texts' hashes."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text").withColumn("text_crc32", F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    out = shards(docs, 16, keep=["doc_id", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
