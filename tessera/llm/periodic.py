"""Periodic runs of words: stretches in which words one period apart are identical, as long as they go on.

Masking: a run of ``min_words`` words or more, and of ``periods`` periods or more, overlaps itself one period on in at
least ``overlap`` words. So each of its words lies in a gram of that many words which occurs again in the document; a
word outside all repeated grams is in no run, and runs can't cross it. Only the stretches between such words are
searched. Equal hashes of different grams could only leave more to search.

Main-Lorentz: a stretch is halved again and again. A run lies whole in one part and crosses its middle; as it has three
periods or more, one of the three squares of its period that begin at, around or end at the middle is inside it. All
parts of all stretches of a batch are halved at the same time, so a level is a few passes over arrays: for each
part and period, prefix hashes tell if one of the squares is there; those found are extended to both sides by
bisection. What is found is compared word for word, so results don't rest on hashes.

Null texts have no words. Words are what ``WORD`` matches; nothing else of a text counts. Rows are independent: repeated
rows, and rows without an id, get results of their own. An empty table gives an empty table. Added columns replace
columns of the same names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import expand, list_array, table, text_slices

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Primes below 2^31 and bases of the two prefix hashes: products fit 64 bits.
HASHES = ((2**31 - 1, 1_103_515_245), (2**31 - 19, 1_597_334_677))
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))

RUN = "struct<start:long,length:long,period:long>"
ADDED = f"n_words long, runs array<{RUN}>, strongest {RUN}, collapsed string"


def overlap(min_words: int, periods: int) -> int:
    """The fewest words by which a run overlaps itself, one period on."""
    return min(max(min_words - q, (periods - 1) * q) for q in range(1, min_words + 1))


def _mixed(x: np.ndarray, factor: np.uint64) -> np.ndarray:
    x = x * factor
    return x ^ x >> np.uint64(29)


def gram_hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """A hash of each ``n`` consecutive ids, by doubling."""
    size, part = 1, _mixed(ids.astype(np.uint64) + np.uint64(1), MIX[0])
    out, have = None, 0
    while True:
        if n & size:
            out = part if out is None else _mixed(out[: len(out) - size], MIX[1]) + part[have : have + len(out) - size]
            have += size
        if have == n or not len(part):
            return part if out is None else out
        part = _mixed(part[:-size], MIX[1]) + part[size:]
        size *= 2


def stretches(ids: np.ndarray, lengths: np.ndarray, gram: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the stretches of at least ``least`` ids, each inside one document, that grams cover which occur twice in
    their document."""
    none = np.empty(0, np.int64)
    if len(ids) < gram:
        return none, none
    doc = np.repeat(np.arange(len(lengths)), lengths)
    first = np.flatnonzero(doc[: len(ids) - gram + 1] == doc[gram - 1 :])
    if not len(first):
        return none, none
    h = gram_hashes(ids, gram)[first] ^ _mixed(doc[first].astype(np.uint64) + np.uint64(1), MIX[1])
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    again = np.zeros(len(first), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, first[again], 1)
    np.add.at(edge, first[again] + gram, -1)
    covered = np.cumsum(edge[:-1]) > 0
    begins = np.r_[True, doc[1:] != doc[:-1]]
    low = np.flatnonzero(covered & (begins | ~np.r_[False, covered[:-1]]))
    high = np.flatnonzero(covered & (np.r_[begins[1:], True] | ~np.r_[covered[1:], False])) + 1
    long = high - low >= least
    return low[long], high[long]


class Prefixes:
    """Prefix hashes of an id array; ``equal`` compares ranges of it."""

    def __init__(self, ids: np.ndarray):
        self.sums, self.powers = [], []
        for (prime, base), factor in zip(HASHES, MIX, strict=True):
            p = np.uint64(prime)
            power = np.ones(len(ids) + 1, np.uint64)
            have, step = 1, np.uint64(base)
            while have < len(power):
                more = min(have, len(power) - have)
                power[have : have + more] = power[:more] * step % p
                have, step = have + more, step * step % p
            values = _mixed(ids.astype(np.uint64) + np.uint64(1), factor) % p * power[:-1] % p
            self.powers.append(power)
            self.sums.append(np.concatenate([[np.uint64(0)], np.cumsum(values, dtype=np.uint64)]) % p)

    def equal(self, i: np.ndarray, apart: np.ndarray, n: np.ndarray) -> np.ndarray:
        """If the ``n`` ids from ``i`` are those from ``i + apart``."""
        out = np.ones(len(i), bool)
        for (prime, _), h, power in zip(HASHES, self.sums, self.powers, strict=True):
            p = np.uint64(prime)
            left = (h[i + n] + p - h[i]) % p * power[apart] % p
            j = i + apart
            out &= left == (h[j + n] + p - h[j]) % p
        return out

    def ahead(self, i: np.ndarray, apart: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many ids from ``i`` on are the same ``apart`` on, ``most`` at most."""
        low, high = np.zeros(len(i), np.int64), most.copy()
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_] + 1) // 2
            same = self.equal(i[open_], apart[open_], mid)
            low[open_[same]], high[open_[~same]] = mid[same], mid[~same] - 1
        return low

    def behind(self, i: np.ndarray, apart: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many ids before ``i`` are the same ``apart`` on, ``most`` at most."""
        low, high = np.zeros(len(i), np.int64), most.copy()
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_] + 1) // 2
            same = self.equal(i[open_] - mid, apart[open_], mid)
            low[open_[same]], high[open_[~same]] = mid[same], mid[~same] - 1
        return low


def _exact(ids: np.ndarray, at: int, apart: int, low: int, high: int) -> tuple[int, int]:
    """The stretch of period ``apart`` around ``at`` in [low, high), compared word for word."""
    same = ids[low : high - apart] == ids[low + apart : high]
    other = np.flatnonzero(~same) + low
    k = int(np.searchsorted(other, at))
    return (int(other[k - 1]) + 1 if k else low), (int(other[k]) if k < len(other) else high - apart) + apart


def runs_of(ids: np.ndarray, low: np.ndarray, high: np.ndarray, min_words: int, periods: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and smallest period of all runs in the stretches [low, high), in order of start and period."""
    held = expand(low, high - low)
    own = ids[held]
    ends = np.cumsum(high - low)
    begins = ends - (high - low)
    hashes, found = Prefixes(own), []
    left, right, inside = begins, ends, np.arange(len(low))
    while len(left):
        middle = (left + right) // 2
        counts = (right - left) // periods
        node = np.repeat(np.arange(len(left)), counts)
        period = expand(np.ones(len(left), np.int64), counts)
        for before in (0, 1, 2):  # the square that begins at, is around, or ends at the middle; each may be in a run of its own
            i = middle[node] - before * period
            hit = np.flatnonzero((i >= left[node]) & (i + 2 * period <= right[node]))
            hit = hit[hashes.equal(i[hit], period[hit], period[hit])]
            i, q, of = i[hit], period[hit], inside[node[hit]]
            start = i - hashes.behind(i, q, i - begins[of])
            end = i + q + hashes.ahead(i, q, ends[of] - i - q)
            # a wrong hash can only lengthen a stretch, so none that is long enough is lost here
            long = end - start >= np.maximum(min_words, periods * q)
            found.append(np.stack([start[long], end[long], q[long], i[long], of[long]]))
        left, right, inside = np.concatenate([left, middle]), np.concatenate([middle, right]), np.concatenate([inside, inside])
        large = right - left >= min_words
        left, right, inside = left[large], right[large], inside[large]
    if not found:
        return (np.empty(0, np.int64),) * 3
    start, end, q, i, of = np.concatenate(found, axis=1)
    # several parts and multiples of a period find the same stretch: the smallest period is the run's
    order = np.lexsort((q, end, start))
    first = np.r_[True, (start[order][1:] != start[order][:-1]) | (end[order][1:] != end[order][:-1])] if len(order) else np.empty(0, bool)
    out = set()
    for s, e, p, at, k in zip(*(x[order][first].tolist() for x in (start, end, q, i, of)), strict=True):
        if not np.array_equal(own[s : e - p], own[s + p : e]):
            s, e = _exact(own, at, p, int(begins[k]), int(ends[k]))
            if e - s < max(min_words, periods * p):
                continue
        out.add((int(held[s]), int(held[e - 1]) + 1, p))
    least: dict[tuple[int, int], int] = {}
    for s, e, p in out:
        least[s, e] = min(p, least.get((s, e), p))
    rows = sorted((s, p, e) for (s, e), p in least.items())
    s, p, e = (np.array(x, np.int64) for x in zip(*rows, strict=True)) if rows else (np.empty(0, np.int64),) * 3
    return s, e, p


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The first run (start, length, period) of the greatest length by period."""
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def find_runs(lists: list[list[str]], min_words: int = 24, periods: int = 3) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each list of words, in order of start and period."""
    code: dict[str, int] = {}
    lengths = np.array([len(x) for x in lists], np.int64)
    ids = np.fromiter((code.setdefault(w, len(code)) for x in lists for w in x), np.int64, int(lengths.sum()))
    low, high = stretches(ids, lengths, overlap(min_words, periods), min_words)
    out: list[list[tuple[int, int, int]]] = [[] for _ in lists]
    if len(low):
        ends = np.cumsum(lengths)
        start, end, period = runs_of(ids, low, high, min_words, periods)
        doc = np.searchsorted(ends, start, side="right")
        for d, s, n, q in zip(doc.tolist(), (start - (ends - lengths)[doc]).tolist(), (end - start).tolist(), period.tolist(), strict=True):
            out[d].append((s, n, q))
    return out


def collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> list[str]:
    """The words that no run contains after its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), bool)
    for s, n, q in runs:
        keep[s + q : s + n] = False
    return [words[i] for i in np.flatnonzero(keep).tolist()]


def periodic_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 24, periods: int = 3, rewrite: Callable[[object, list[str]], list[str]] | None = None) -> DataFrame:
    """Adds ``n_words``, ``runs`` in order of start and period, the ``strongest`` run (greatest length by period, ties:
    the first; null: no run), and ``collapsed``, the words that stay when each run keeps its first period only, joined
    by spaces. Runs have ``min_words`` words and ``periods`` (3 or more) periods at least.

    ``rewrite`` may change a row's words before they are judged; it gets the id and the words.
    """
    if periods < 3:
        raise ValueError("runs of fewer than three periods may cross a middle without a square there")
    new = T._parse_datatype_string(ADDED)
    keep = [f for f in df.schema.fields if f.name not in new.fieldNames()]
    schema = T.StructType(keep + new.fields)
    kind = pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            names = whole.schema.names
            texts = [t or "" for t in whole.column(names.index(text_col)).to_pylist()]
            for i, j in text_slices(texts):
                part = whole.slice(i, j - i)
                lists = [WORD.findall(t) for t in texts[i:j]]
                if rewrite:
                    lists = [rewrite(k, words) for k, words in zip(part.column(names.index(id_col)).to_pylist(), lists, strict=True)]
                runs = find_runs(lists, min_words, periods)
                flat = np.array([r for x in runs for r in x], np.int64).reshape(-1, 3)
                rows = pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(3)], fields=list(kind))
                best = [dict(zip(("start", "length", "period"), b, strict=True)) if (b := strongest(x)) else None for x in runs]
                yield pa.RecordBatch.from_arrays(
                    [part.column(names.index(f.name)) for f in keep]
                    + [pa.array([len(x) for x in lists], pa.int64()), list_array(rows, np.array([len(x) for x in runs], np.int64), kind), pa.array(best, kind)]
                    + [pa.array([" ".join(collapsed(x, r)) for x, r in zip(lists, runs, strict=True)], pa.string())],
                    names=schema.fieldNames(),
                )

    return df.mapInArrow(run, schema)


def planted(doc_id: int | None, words: list[str]) -> list[str]:
    """The words as ``op12_periodic_runs`` judges them: those of a tenth of the documents go on with a period of their
    own from some word on. A document without an id stays as it is."""
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    cycle = words[a : a + p]
    times, rest = divmod(n - a, len(cycle))
    return words[:a] + cycle * times + cycle[:rest]


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Runs of at least 24 words and three periods in every document: their number, the strongest, and digests of all of
    them and of the words that stay."""
    out = periodic_runs(table(spark, sf_dir, "documents", "doc_id", "text"), rewrite=planted)
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    return out.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("strongest.start").alias("start"),
        F.col("strongest.length").alias("length"),
        F.col("strongest.period").alias("period"),
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
