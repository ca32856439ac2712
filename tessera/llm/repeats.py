"""Removal of repeated byte strings by prefix-free parsing.

A rolling hash over every few bytes sets triggers: in each stretch of ``width`` bytes the leftmost position of the
least hash. Triggers depend on the bytes around them alone, so equal strings are cut at equal places wherever they
stand. Every string of the least length has one trigger that is its own, the first stretch's; the strings of one
trigger follow each other. Their phrase is what they span before the trigger, their suffix of the parse what they
span from it on.

Parse: phrases with their suffixes are counted by the hash of what follows the trigger in each of their strings (the
key) and by the hash of all that the strings span. A key that occurs once is no repeat. What occurs twice is
repeated as a whole. What remains stands at the edge of a repeat: it shares a key but differs somewhere.

Suffix arrays: a task orders the distinct phrases of its keys by their suffixes (read backwards from the trigger) and
the suffixes of the parse by what follows the trigger, each with the lengths of common prefixes. A string that
begins ``a`` bytes before its trigger stands in corpus order beside those whose phrase ends in the same ``a`` bytes
and whose parse goes on with the same rest: intervals of the two arrays, so counting the pairs of intervals of all
strings with the same ``a`` finds the repeats, and no text position is moved or sorted by itself. Keys whose distinct
phrases are too many for a task are resolved by counting their strings' hashes, which spreads over all tasks.

Null and empty texts and those shorter than the least length have nothing to remove. Repeated rows are documents of
their own, so a text of that length or more that stands in two rows goes whole. Matches never cross documents. An
empty table gives an empty table.
"""

from __future__ import annotations

import bisect
import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import Scratch, bucketed, table

#: Bytes that a rolling hash covers, and how many of its bits decide.
GRAM, POSITION_BITS = 8, 22
#: Distinct phrases of a key that one task orders together, in about 50 MB and three seconds; keys with more are
#: resolved by hashes.
KINDS = 1 << 16
#: Passes over the phrases' keys, so that a step's shuffle takes that share of the disk.
PASSES = 4
#: Phrases, of whole keys, that a task orders at a time.
ORDERED = 8192
MIX = np.uint64(0x9E3779B97F4A7C15)


def binary_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column, one value after the other, and their bounds."""
    if not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary())
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None and bounds[-1] > bounds[0] else np.empty(0, np.uint8)
    return raw, bounds - bounds[0]


def triggers(raw: np.ndarray, width: int) -> np.ndarray:
    """For each stretch of ``width`` gram positions, the leftmost position of the least hash."""
    n = len(raw) - GRAM + 1 - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    out = np.empty(n, np.int64)
    step, mask = (1 << POSITION_BITS) - width - GRAM, np.uint64((1 << POSITION_BITS) - 1)
    for s in range(0, n, step):
        e = min(n, s + step)
        part = raw[s : e + width + GRAM - 2]
        grams = np.lib.stride_tricks.as_strided(part, (len(part) - GRAM + 1, GRAM), (1, 1))
        h = np.ascontiguousarray(grams).view("<u8").reshape(-1) * MIX
        h ^= h >> np.uint64(32)
        h *= MIX
        h &= ~mask
        h |= np.arange(len(h), dtype=np.uint64)
        have = 1
        while have < width:
            more = min(have, width - have)
            h = np.minimum(h[:-more], h[more:])
            have += more
        out[s:e] = s + (h & mask).astype(np.int64)
    return out


def phrases(raw: np.ndarray, bounds: np.ndarray, min_bytes: int) -> tuple[np.ndarray, ...]:
    """document, first and last string start, trigger of every phrase; positions count from ``raw``'s start."""
    width = min_bytes * 5 // 8
    at = triggers(raw, width)
    starts, ends = bounds[:-1], bounds[1:]
    valid = np.zeros(len(at) + 1, np.int8)
    long = ends - starts >= min_bytes
    np.add.at(valid, starts[long], 1)
    np.add.at(valid, ends[long] - min_bytes + 1, -1)
    valid = np.cumsum(valid[:-1], dtype=np.int8).astype(bool)
    if not valid.any():
        return (np.empty(0, np.int64),) * 4
    doc_start = np.zeros(len(at), bool)
    doc_start[starts[long]] = True
    head = valid.copy()
    head[1:] &= doc_start[1:] | ~valid[:-1] | (at[1:] != at[:-1])
    tail = valid.copy()
    tail[:-1] &= head[1:] | ~valid[1:]
    low, high = np.flatnonzero(head), np.flatnonzero(tail)
    return np.searchsorted(bounds, low, side="right") - 1, low, high, at[low]


def parse(df: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """Where the strings of each trigger stand (low, high: first and last start; at: trigger; end: of what the longest
    strings span, cut at the document's end), the key, and hashes ``like`` of what the strings of each length span."""
    base, widest = lengths[0], lengths[-1]
    follows = base - base * 5 // 8 + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for whole in batches:
            for i, j in _slices(_lengths(whole.column(2)), 1 << 20):
                batch = whole.slice(i, j - i)
                raw, bounds = binary_buffers(batch.column(2))
                doc, low, high, at = phrases(raw, bounds, base)
                if not len(doc):
                    continue
                view, size = memoryview(raw), bounds[doc + 1]
                hashes = [np.fromiter((digest(view[a : a + follows]) for a in at.tolist()), np.uint64, len(at))]
                for m in lengths:
                    spans = zip(low.tolist(), np.minimum(high + m, size).tolist(), (high - low).tolist(), strict=True)
                    hashes.append(np.fromiter((digest(view[a:b], n) for a, b, n in spans), np.uint64, len(at)))
                base_at, rows = bounds[doc], pa.array(doc)
                places = (low, high, at, np.minimum(high + widest, size))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows)] + [pa.array(h.view(np.int64)) for h in hashes] + [pa.array((x - base_at).astype(np.int32)) for x in places],
                    names=["id", "th", "key", *(f"like_{m}" for m in lengths), "low", "high", "at", "end"],
                )

    like = "".join(f"like_{m} long, " for m in lengths)
    return df.mapInArrow(run, f"id long, th long, key long, {like}low int, high int, at int, end int")


def _lengths(column: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.binary_length(column).to_numpy(zero_copy_only=False)


def _slices(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    begin = held = 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > limit:
            yield begin, i
            begin, held = i, 0
        held += n
    if begin < len(sizes):
        yield begin, len(sizes)


def _shared(values: list[bytes], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of ``values`` by key and content, and what each shares with the one before it; -1 at a new key."""
    order = sorted(range(len(values)), key=lambda i: (keys[i], values[i]))
    shared = np.full(len(values), -1, np.int64)
    for n, (i, j) in enumerate(zip(order, order[1:], strict=False), 1):
        if keys[i] == keys[j]:
            a, b = values[i], values[j]
            least = min(len(a), len(b))
            differ = int.from_bytes(a[:least], "big") ^ int.from_bytes(b[:least], "big")
            shared[n] = least - (differ.bit_length() + 7) // 8
    return np.array(order, np.int64), shared


def _in_order(group: dict[str, list], lengths: tuple[int, ...]) -> pa.RecordBatch:
    """Repeated stretches of the phrases of whole keys, by the suffix arrays of dictionary and parse."""
    keys = np.array(group["key"], np.int64)
    low, high, at, end = (np.array(group[k], np.int64) for k in ("low", "high", "at", "end"))
    before = (at - low).tolist()
    phrase_order, phrase_shared = _shared([r[:n][::-1] for r, n in zip(group["raw"], before, strict=True)], keys)
    parse_order, parse_shared = _shared([r[n:] for r, n in zip(group["raw"], before, strict=True)], keys)
    times, found = np.minimum(np.array(group["n"], np.int64), 2), []
    phrase_class, parse_class = np.empty(len(keys), np.int64), np.empty(len(keys), np.int64)
    for m in lengths:
        last = np.minimum(high, end - m)
        repeated = np.zeros((len(keys), int((at - low).max()) + 1), bool)
        for a in range(repeated.shape[1]):
            here = np.flatnonzero((at - a >= low) & (at - a <= last))
            phrase_class[phrase_order] = np.cumsum(phrase_shared < a)
            parse_class[parse_order] = np.cumsum(parse_shared < m - a)
            cells = phrase_class[here] * (len(keys) + 1) + parse_class[here]
            by = np.argsort(cells, kind="stable")
            sorted_cells = cells[by]
            starts = np.flatnonzero(np.r_[True, sorted_cells[1:] != sorted_cells[:-1]][: len(by)])
            if len(starts):
                total = np.add.reduceat(times[here[by]], starts)
                repeated[here[by], a] = np.repeat(total > 1, np.diff(np.r_[starts, len(by)]))
        repeated[np.array(group[f"n_{m}"]) > 1] = False  # these are repeated as a whole
        edge = np.diff(np.pad(repeated, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        rows, first = np.nonzero(edge == 1)
        _, past = np.nonzero(edge == -1)
        found.append((rows, np.full(len(rows), m), at[rows] - past + 1, at[rows] - first + m))
    rows, m, start, end = (np.concatenate(x) for x in zip(*found, strict=True))
    return pa.RecordBatch.from_arrays(
        [pa.array(group["id"], pa.int64()).take(pa.array(rows)), pa.array(group["th"], pa.int64()).take(pa.array(rows))] + [pa.array(x.astype(np.int32)) for x in (m, start, end)],
        names=["id", "th", "m", "start", "end"],
    )


SPAN = "id long, th long, m int, start int, end int"


def edges(open_: DataFrame, docs: DataFrame, lengths: tuple[int, ...], scratch: Scratch) -> DataFrame:
    """Repeated stretches of phrases that don't occur twice as a whole. ``open_``: all distinct phrases of keys that
    have such phrases, with one of their places, ``n_`` by length, and ``kinds``, the number of the key's phrases."""
    widest = lengths[-1]
    text = F.substring(F.col("raw"), F.col("low") + 1, F.col("end") - F.col("low"))
    counts = [f"n_{m}" for m in lengths]
    # the table of documents lies by these columns, so neither grouping nor join moves its texts
    once = docs.groupBy("id", "th").agg(F.first("raw").alias("raw"))

    def fetched(some: DataFrame) -> DataFrame:
        return some.join(once, ["id", "th"]).select("key", "id", "th", "low", "high", "at", "end", F.col(f"n_{widest}").alias("n"), *counts, text.alias("raw"))

    def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        for batch in batches:
            rows = batch.to_pydict()
            for name, column in rows.items():
                held.setdefault(name, []).extend(column)
            if len(held["key"]) >= ORDERED:  # all but the last key, which may go on
                cut = bisect.bisect_left(held["key"], held["key"][-1])
                if cut:
                    yield _in_order({k: v[:cut] for k, v in held.items()}, lengths)
                    held = {k: v[cut:] for k, v in held.items()}
        if held and held["key"]:
            yield _in_order(held, lengths)

    few = fetched(open_.where(F.col("kinds") <= KINDS))
    found = few.repartition("key").sortWithinPartitions("key").mapInArrow(ordered, SPAN)

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = (1 << 63) - 1
        for batch in batches:
            for row in batch.to_pylist():
                view = memoryview(row["raw"])
                for m in lengths:
                    n = min(row["high"], row["end"] - m) - row["low"] + 1
                    if n < 1:
                        continue
                    h = [xxhash.xxh3_128_intdigest(view[i : i + m]) for i in range(n)]
                    places = np.arange(row["low"], row["low"] + n, dtype=np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([x >> 64 & mask for x in h], pa.int64()), pa.array([x & mask for x in h], pa.int64()), pa.array([row["id"]] * n, pa.int64()), pa.array([row["th"]] * n, pa.int64())]
                        + [pa.array(np.full(n, m, np.int32)), pa.array(places), pa.array([min(2, row["n"])] * n, pa.int64()), pa.array([row[f"n_{m}"] == 1] * n)],
                        names=["h1", "h2", "id", "th", "m", "start", "n", "edge"],
                    )

    many = fetched(open_.where(F.col("kinds") > KINDS))
    hashed = scratch.stored(many.mapInArrow(strings, "h1 long, h2 long, id long, th long, m int, start int, n long, edge boolean"), "strings")
    twice = scratch.stored(hashed.groupBy("m", "h1", "h2").agg(F.sum("n").alias("times")).where("times > 1").select("m", "h1", "h2"), "twice")
    counted = hashed.where("edge").join(twice, ["m", "h1", "h2"], "left_semi")
    return found.union(counted.select("id", "th", "m", "start", (F.col("start") + F.col("m")).cast("int").alias("end")))


def repeated_spans(docs: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """id, th, ``spans``: the repeated stretches (m: the strings' length, start, end) of each document that has any,
    not yet merged. What feeds a join is written first, so that the join has plain exchanges on both sides and a
    frequent key's rows can be split."""
    widest, like = lengths[-1], f"like_{lengths[-1]}"
    scratch = Scratch()
    # keys are met in passes, each with shuffles and tables of its own that go before the next begins; joins with repeated
    # keys are merges at every size, as their number has no bound
    part = F.pmod(F.shiftrightunsigned("key", 32), F.lit(PASSES)).cast("int")
    parsed, met = scratch.stored(parse(docs, lengths).withColumn("part", part), "phrases", "part"), []
    for p in range(PASSES):
        own = parsed.where(F.col("part") == p).drop("part")
        twice = scratch.stored(own.groupBy("key").agg(F.count("*").alias("times")).where("times > 1").select("key"), "keys")
        met.append(scratch.stored(own.join(twice.hint("merge"), "key", "left_semi"), "repeated"))
        scratch.discard(twice)
    scratch.discard(parsed)
    seen = functools.reduce(DataFrame.unionByName, met)
    place = F.min(F.struct("th", "id", "low", "high", "at", "end", *(f"like_{m}" for m in lengths[:-1]))).alias("p")
    kinds = scratch.stored(seen.groupBy("key", like).agg(F.count("*").alias(f"n_{widest}"), place).select("key", like, "p.*", f"n_{widest}"), "kinds")
    for m in lengths[:-1]:
        times = scratch.stored(kinds.groupBy("key", f"like_{m}").agg(F.sum(f"n_{widest}").alias(f"n_{m}")), f"times-{m}")
        wider = scratch.stored(kinds.join(times.hint("merge"), ["key", f"like_{m}"]), f"kinds-{m}")
        scratch.discard(kinds, times)
        kinds = wider
    edge = F.lit(False)
    for m in lengths:
        edge = edge | ((F.col(f"n_{m}") == 1) & (F.col("end") - F.col("low") >= m))
    groups = scratch.stored(kinds.groupBy("key").agg(F.count("*").alias("kinds"), F.max(edge).alias("open")).where("open and kinds > 1").select("key", "kinds"), "groups")
    wide = kinds.where(" or ".join(f"n_{m} > 1" for m in lengths)).select("key", like, *(f"n_{m}" for m in lengths))
    spans = [F.when((F.col(f"n_{m}") > 1) & (F.col("end") - F.col("low") >= m), F.struct(F.lit(m).alias("m"), F.col("low").alias("start"), F.least(F.col("high") + m, "end").alias("end"))) for m in lengths]
    found = []
    for p, own in enumerate(met):
        whole = own.join(wide.where(part == p).hint("merge"), ["key", like]).select("id", "th", F.inline(F.array_compact(F.array(*spans))))
        found.append(scratch.stored(whole.groupBy("id", "th").agg(F.collect_set(F.struct("m", "start", "end")).alias("spans")), "whole"))
        scratch.discard(own)
    rest = edges(kinds.join(groups, "key"), docs, lengths, scratch).select("id", "th", F.array(F.struct("m", "start", "end")).alias("spans"))
    every = functools.reduce(DataFrame.unionByName, [*found, rest])
    return scratch.result(every.groupBy("id", "th").agg(F.flatten(F.collect_list("spans")).alias("spans")), "spans")


def merged(spans: list[dict] | None, m: int) -> list[tuple[int, int]]:
    """Maximal stretches that the spans of strings of length ``m`` cover, in order."""
    out: list[list[int]] = []
    for a, b in sorted((s["start"], s["end"]) for s in spans or [] if s["m"] == m):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_bytes: int = 400, whole_characters: bool = False) -> DataFrame:
    """Adds ``removed``, array of struct of the maximal removed runs of UTF-8 bytes (start, end), and ``kept``,
    the remaining bytes: each byte goes that a string of ``min_bytes`` covers which also starts anywhere else.

    All strings are judged on the input. Other columns stay as they are; of the added names the added ones stay. With
    ``whole_characters`` what is left of a character that a run cuts is left out of ``kept`` as well.
    """
    return remove_repeats_of(df, {"": Cut(min_bytes, whole_characters)}, id_col, text_col)


@dataclass(frozen=True)
class Cut:
    """Strings of ``min_bytes`` that repeat go; of those runs, if ``words`` is set, such of more than ``words`` words or of
    ``or_bytes`` bytes. ``whole_characters``: what is left of a character that a run cuts goes too."""

    min_bytes: int
    whole_characters: bool = False
    words: int | None = None
    or_bytes: int = 0

    def goes(self, text: bytes, run: tuple[int, int]) -> bool:
        a, b = run
        return self.words is None or b - a >= self.or_bytes or whole_words(text, a, b) > self.words


def whole_words(text: bytes, a: int, b: int) -> int:
    """How many words stand in ``text[a:b]`` from their first to their last byte."""
    cut_words = [a and b > a and text[a - 1] > 32 and text[a] > 32, b < len(text) and b > a and text[b - 1] > 32 and text[b] > 32]
    return max(0, len(text[a:b].split()) - sum(map(bool, cut_words)))


def remove_repeats_of(df: DataFrame, cuts: dict[str, Cut | tuple], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``remove_repeats`` for several cuts at once: adds ``removed`` and ``kept``, followed by the cut's name, for each."""
    cuts = {k: c if isinstance(c, Cut) else Cut(*c) for k, c in cuts.items()}
    names, lengths = df.columns, tuple(sorted({c.min_bytes for c in cuts.values()}))
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = {"_repeat_id": F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))), "_repeat_th": F.xxhash64(text)}
    placed = bucketed(df.withColumns(own), list(own), "repeats")
    raw = text.cast("binary")
    docs = placed.select(F.col("_repeat_id").alias("id"), F.col("_repeat_th").alias("th"), raw.alias("raw"))
    spans = repeated_spans(docs, lengths).select(F.col("id").alias("_repeat_id"), F.col("th").alias("_repeat_th"), F.col("spans").alias("_repeat_spans"))
    joined = placed.join(spans, list(own), "left").select(*names, raw.alias("_repeat_raw"), "_repeat_spans")
    added = T._parse_datatype_string(", ".join(f"`removed{k}` array<struct<start:int,end:int>>, `kept{k}` binary" for k in cuts))
    keep = [f for f in df.schema.fields if f.name not in added.fieldNames()]
    schema = T.StructType(keep + added.fields)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(batch.schema.get_field_index("_repeat_raw"))
            lists = batch.column(batch.schema.get_field_index("_repeat_spans")).to_pylist()
            arrays = [batch.column(batch.schema.get_field_index(f.name)) for f in keep]
            for how in cuts.values():
                removed, kept = [], []
                for text, spans in zip(own, lists, strict=True):
                    value = text.as_py()
                    runs = [r for r in merged(spans, how.min_bytes) if how.goes(value, r)]
                    removed.append([{"start": a, "end": b} for a, b in runs])
                    if runs:
                        ends = [0, *(x for r in runs for x in r), len(value)]
                        value = b"".join(value[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True))
                        value = value.decode("utf-8", "ignore").encode() if how.whole_characters else value
                    kept.append(value)
                arrays += [pa.array(removed, kind), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.fieldNames())

    return joined.mapInArrow(cut, schema)


#: Passages of over 50 words, as ``text`` of ``op8_suffix_dedup`` and the pipeline leave them out: 51 words have 150 bytes
#: unless they have fewer than two letters on average. What repeats over 250 bytes goes whatever words it has.
PASSAGE = Cut(150, whole_characters=True, words=50, or_bytes=250)


def op8_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """What remains of every document without repeated strings of 400 bytes, as counts and a digest. Beside them
    ``text``, what remains without repeated passages of over 50 words (``PASSAGE``)."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text").withColumn("n_bytes", F.length(F.coalesce(F.col("text"), F.lit("")).cast("binary")).cast("long"))
    out = remove_repeats_of(docs, {"": Cut(400), "_passages": PASSAGE})
    return out.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        F.col("kept_passages").cast("string").alias("text"),
    )
