"""Language identification by interpolated Kneser-Ney character models.

Each language has a character model of order 5 over its words (the letters between two blanks). All languages' n-gram
probabilities stand in one sorted array of 64-bit hashes per order, with a row of probabilities and a row of back-off
weights for each n-gram seen in any language. A text goes to the language of the lowest cross-entropy per character.

Rejection is for texts that no learned language describes, so it goes by the cross-entropy with each word in the
language that describes it best: names, quotations and passages in another learned language don't raise it. What a
text exceeds its language's median by is measured in spreads for its length, and the limit is the quantile of that
measure over held-back texts which rejects a share of ``FALSE_REJECTION`` of texts like them.

Training reads a bounded sample of labelled rows, about ``per_language`` of each language, and calibration as many more
as ``calibrating`` says, all chosen by a hash of the id; prediction reads whole texts. Texts are lower-cased, letters
and marks of any script form words, everything else (digits and other numbers too) parts them. A word's entropy is
worked out once per task.

Null texts and texts without letters are `und` with score 0 (and rejected). Rows without a label are not learned
from. Repeated rows and ties are predicted each on its own; of equal entropies the smaller label wins. An empty
table, or one without labels, has no languages: everything is `und`. The model is a few MB: its size is bounded by
the sample's, not by the table's.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_texts, sums_by, table

#: Words: letters of any script, with marks.
LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
ORDER = 5
#: Labelled rows to learn from, about, for each language, and to calibrate with.
PER_LANGUAGE, CALIBRATING = 400, 1000
#: Share of texts like the learned ones that rejection may take.
FALSE_REJECTION = 0.002
#: Bits per character that spreads are never less than: for long texts, and for one of a single character.
LEAST_SPREAD, LEAST_WOBBLE = 0.02, 1.0
UNDETERMINED = "und"
_MIX = np.uint64(0x9E3779B97F4A7C15)
_EDGE = 32  # the blank at both ends of a word


def word_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams that end at each character of each word and its closing blank: an array of shape
    (ORDER, positions), n = 1 first, and each word's number of positions. Contexts stop at the opening blank."""
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    text = " " + " ".join(words) + " "
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    since = np.arange(1, len(code))  # of each position its distance to the word's opening blank
    opening = np.cumsum(lengths) - lengths
    since = since - np.repeat(opening, lengths)
    out = np.zeros((ORDER, len(code) - 1), np.uint64)
    for n in range(1, ORDER + 1):
        h = np.zeros(len(code) - 1, np.uint64)
        for back in range(n - 1, -1, -1):  # oldest first
            shifted = np.full(len(code) - 1, _EDGE, np.uint64)
            shifted[back:] = code[1 : len(code) - back]
            inside = since >= back
            h = np.where(inside, (h ^ shifted) * _MIX, h)
            h ^= np.where(inside, h >> np.uint64(29), np.uint64(0))
        # shorter contexts near the opening share their hash with lower orders; the length keeps orders apart
        out[n - 1] = (h + np.minimum(since + 1, n).astype(np.uint64)) * _MIX
    return out, lengths


def _depth(lengths: np.ndarray) -> np.ndarray:
    """The longest n-gram at each position: it may reach back to the opening blank."""
    opening = np.cumsum(lengths) - lengths
    return np.minimum(np.arange(int(lengths.sum())) - np.repeat(opening, lengths) + 2, ORDER)


@dataclass
class Models:
    """For each order the sorted n-gram hashes, their log probabilities and back-off weights by language."""

    languages: list[str]
    hashes: list[np.ndarray]
    log_p: list[np.ndarray]
    log_back: list[np.ndarray]
    floor: np.ndarray
    opening: np.ndarray | None = None  # log back-off weight of the blank that opens a word
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None
    wobble: np.ndarray | None = None
    limit: float = math.inf  # spreads above the median at which a text is rejected

    def excess(self, best: np.ndarray, h: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """Spreads by which entropies of texts in languages ``best`` exceed the languages' medians."""
        return (h - self.mean[best]) / np.sqrt(self.spread[best] ** 2 + self.wobble[best] ** 2 / chars)

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Sum over the word's characters of -log2 p, for each word and language."""
        grams, lengths = word_grams(words)
        depth = _depth(lengths)
        total = len(depth)
        score = np.zeros((total, len(self.languages)), np.float32)
        open_ = np.ones(total, bool)
        for n in range(ORDER, 0, -1):
            at = np.flatnonzero(open_ & (depth >= n))
            if len(at):
                h = self.hashes[n - 1]
                pos = np.minimum(np.searchsorted(h, grams[n - 1, at]), max(0, len(h) - 1))
                hit = h[pos] == grams[n - 1, at] if len(h) else np.zeros(len(at), bool)
                score[at[hit]] += self.log_p[n - 1][pos[hit]]
                open_[at[hit]] = False
                miss = at[~hit]
                if n > 1 and len(miss):  # back off by the context's weight: the n-gram before without its last character
                    ctx = grams[n - 2, miss - 1]
                    ok = (depth[miss] >= n) & (depth[miss] > 2)
                    h = self.hashes[n - 2]
                    pos = np.minimum(np.searchsorted(h, ctx), max(0, len(h) - 1))
                    hit = ok & (h[pos] == ctx) if len(h) else np.zeros(len(miss), bool)
                    score[miss[hit]] += self.log_back[n - 2][pos[hit]]
                    if n == 2:
                        score[miss[depth[miss] == 2]] += self.opening
                elif n == 1:
                    score[miss] += self.floor
        ends = np.cumsum(lengths)
        sums = np.concatenate([np.zeros((1, score.shape[1])), np.cumsum(score, axis=0, dtype=np.float64)])
        return -(sums[ends] - sums[ends - lengths]) / math.log(2)


def _kneser_ney(grams: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> tuple[list, list, list, float, float]:
    """One language's model from, per order, (hash, context hash, suffix hash, count) of its distinct n-grams.

    The highest order has counts; lower ones count the distinct n-grams that continue them. Returns hashes, log
    probabilities and log back-off weights per order, the log probability of an unseen character, and the log weight
    of the opening blank.
    """
    counts = [c.astype(float) for _, _, _, c in grams]
    order = [np.argsort(h) for h, *_ in grams]
    h, ctx, suf, counts = ([x[o] for x, o in zip(col, order, strict=True)] for col in ([g[0] for g in grams], [g[1] for g in grams], [g[2] for g in grams], counts))
    for n in range(len(grams) - 1):  # continuation counts of order n + 1 from distinct n-grams of order n + 2
        pos = np.searchsorted(h[n], suf[n + 1])
        pos[pos == len(h[n])] = 0
        ok = h[n][pos] == suf[n + 1]
        more = np.bincount(pos[ok], minlength=len(h[n])).astype(float)
        counts[n] = np.where(more > 0, more, counts[n])  # nothing precedes those that begin a word: they keep their counts
    log_p, log_back = [], []
    below, unseen, opening = None, 0.0, 0.0
    for n in range(len(grams)):
        once, twice = max(1, int((counts[n] == 1).sum())), max(1, int((counts[n] == 2).sum()))
        d = min(0.95, max(0.1, once / (once + 2 * twice)))
        ctx_keys, ctx_at = np.unique(ctx[n], return_inverse=True)
        total = np.bincount(ctx_at, counts[n])
        kinds = np.bincount(ctx_at)
        gamma = d * kinds / total
        if n == 0:
            vocab = len(h[0]) + 1
            p = (counts[0] - d) / total[0] + gamma[0] / vocab
            unseen = math.log(gamma[0] / vocab)
        else:
            pos = np.minimum(np.searchsorted(h[n - 1], suf[n]), len(h[n - 1]) - 1)
            lower = np.where(h[n - 1][pos] == suf[n], below[pos], math.exp(unseen))
            p = np.maximum(counts[n] - d, 0) / total[ctx_at] + gamma[ctx_at] * lower
            back = np.zeros(len(h[n - 1]))
            pos = np.minimum(np.searchsorted(h[n - 1], ctx_keys), len(h[n - 1]) - 1)
            ok = h[n - 1][pos] == ctx_keys
            back[pos[ok]] = np.log(gamma[ok])
            log_back.append(back)
            if n == 1:
                opening = float(np.log(gamma[ctx_keys == n + 1])[0])
        below = p
        log_p.append(np.log(np.maximum(p, 1e-12)))
    log_back.append(np.zeros(len(h[-1])))
    return h, log_p, log_back, unseen, opening


def _gram_table(words: list[str], weights: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """Distinct n-grams of weighted words: per order (hash, context hash, suffix hash, count)."""
    grams, lengths = word_grams(words)
    depth, weight = _depth(lengths), np.repeat(weights, lengths)
    out = []
    for n in range(1, ORDER + 1):
        at = np.flatnonzero(depth >= n)
        h, first, back = np.unique(grams[n - 1, at], return_index=True, return_inverse=True)
        one = at[first]
        ctx = np.where(depth[one] > 2, grams[n - 2, one - 1], np.uint64(n)) if n > 1 else np.zeros(len(h), np.uint64)
        suf = grams[n - 2, one] if n > 1 else np.zeros(len(h), np.uint64)
        out.append((h, ctx, suf, np.bincount(back, weight[at])))
    return out


def train(sample: dict[str, tuple[list[str], list[int]]]) -> Models:
    """Models from each language's distinct words and their counts."""
    languages = sorted(sample)
    each = [_kneser_ney(_gram_table(words, np.array(counts, float))) for words, counts in (sample[x] for x in languages)]
    hashes, log_p, log_back = [], [], []
    floor = np.array([x[3] for x in each])
    alone = Models(languages, [], [], [], floor, np.array([x[4] for x in each]))
    for n in range(ORDER):
        union = np.unique(np.concatenate([x[0][n] for x in each]))
        p, b = np.full((len(union), len(languages)), np.nan), np.zeros((len(union), len(languages)))
        for k, x in enumerate(each):
            pos = np.searchsorted(union, x[0][n])
            p[pos, k], b[pos, k] = x[1][n], x[2][n]
        hashes.append(union)
        log_p.append(p)
        log_back.append(b)
    alone.hashes, alone.log_p, alone.log_back = hashes, log_p, log_back
    _fill(alone, {x: sample[x][0] for x in languages})
    alone.log_p, alone.log_back = ([x.astype(np.float32) for x in y] for y in (log_p, log_back))  # every worker holds them
    return alone


def _fill(models: Models, words: dict[str, list[str]]) -> None:
    """Probabilities of n-grams that a language has not seen but another has: weight of the context times the lower
    order's probability, from the lowest order up."""
    every = sorted({w for x in words.values() for w in x})
    tables = _gram_table(every, np.ones(len(every)))
    for n in range(ORDER):
        h, ctx, suf, _ = tables[n]
        at = np.searchsorted(models.hashes[n], h)
        p = models.log_p[n]
        if n == 0:
            lower = np.repeat(models.floor[None], len(h), axis=0)
        else:
            below = np.searchsorted(models.hashes[n - 1], suf)
            lower = models.log_p[n - 1][below]
            pos = np.minimum(np.searchsorted(models.hashes[n - 1], ctx), len(models.hashes[n - 1]) - 1)
            known = models.hashes[n - 1][pos] == ctx
            lower = lower + np.where(known[:, None], models.log_back[n - 1][pos], 0.0)
            if n == 1:
                lower = lower + np.where((ctx == n + 1)[:, None], models.opening, 0.0)
        p[at] = np.where(np.isnan(p[at]), lower, p[at])


class Scorer:
    """Sums of word entropies per text, words remembered up to a bound of words and of their characters."""

    def __init__(self, models: Models, limit: int = 300_000, most_chars: int = 8_000_000):
        self.models, self.limit, self.most_chars, self.held = models, limit, most_chars, 0
        self.index: dict[str, int] = {}
        self.values = np.zeros((1 << 12, len(models.languages) + 1))

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bits by text and language, in the last column those of each word's best language, and each text's number of
        characters and words."""
        lists = [LETTERS.findall(t.lower()) for t in texts]
        counts = [len(x) for x in lists]
        words = [w for x in lists for w in x]
        if len(self.index) > self.limit or self.held > self.most_chars:
            self.index.clear()
            self.held = 0
        new = list(set(words).difference(self.index))
        if new:
            n = len(self.index)
            if n + len(new) > len(self.values):
                grown = np.zeros((2 * (n + len(new)), self.values.shape[1]))
                grown[:n] = self.values[:n]
                self.values = grown
            i = 0
            while i < len(new):
                j, held = i, 0
                while j < len(new) and (not held or held + len(new[j]) < 200_000):
                    held += len(new[j])
                    j += 1
                own = self.models.word_scores(new[i:j])
                self.values[n + i : n + j] = np.concatenate([own, own.min(axis=1, keepdims=True)], axis=1)
                self.held += held
                i = j
            self.index.update(zip(new, range(n, n + len(new)), strict=True))
        codes = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        counts_ = np.asarray(counts, np.int64)
        bits = np.zeros((len(texts), self.values.shape[1]))
        full = np.flatnonzero(counts_)
        if len(full):
            begin = (np.cumsum(counts_) - counts_)[full]
            bits[full] = np.add.reduceat(self.values[codes], begin, axis=0)
        chars = sums_by(np.fromiter(map(len, words), np.int64, len(words)) + 1, counts)
        return bits, chars, counts_


def calibrate(models: Models, own: dict[str, list[tuple[float, int]]], false_rejection: float = FALSE_REJECTION) -> None:
    """Medians, spreads and the limit, from the entropy per character and the number of characters n of held-back texts.

    The spread of a text is sqrt(spread^2 + wobble^2 / n). The limit is the texts' excess of rank (N + 1)(1 - share):
    of N + 1 exchangeable texts a share of at most ``false_rejection`` is beyond it. With too few texts for such a
    rank it is half as far again as the largest excess.
    """
    k = len(models.languages)
    models.mean, models.spread, models.wobble = np.full(k, 3.0), np.full(k, 1.0), np.full(k, 10.0)
    for i, name in enumerate(models.languages):
        if len(own.get(name, [])) < 5:
            continue
        h, chars = (np.array(x, float) for x in zip(*own[name], strict=True))
        mean = float(np.median(h))
        long = chars >= np.median(chars)
        models.mean[i] = mean
        models.spread[i] = max(LEAST_SPREAD, float(np.median(abs(h[long] - mean))) * 1.5)
        models.wobble[i] = max(LEAST_WOBBLE, float(np.median(abs(h - mean) * np.sqrt(chars))) * 1.5)
    every = [models.excess(np.full(len(x), models.languages.index(name)), *map(np.array, zip(*x, strict=True))) for name, x in own.items() if x]
    if every:
        ranked = np.sort(np.concatenate(every))
        rank = math.ceil((len(ranked) + 1) * (1 - false_rejection))
        models.limit = max(1.0, float(ranked[rank - 1] if rank <= len(ranked) else ranked[-1] * 1.5))


def own_entropies(rows: DataFrame, models: Models) -> DataFrame:
    """``lang``, ``h`` and ``chars`` of each whole text (columns lang, text): its language, the entropy per character
    with each word in its best language, and the length. Texts without letters or a language's model are left out."""
    handle = rows.sparkSession.sparkContext.broadcast(models)

    def make() -> Callable[[list[str]], dict[str, pa.Array]]:
        scorer = Scorer(handle.value)

        def run(texts: list[str]) -> dict[str, pa.Array]:
            bits, chars, _ = scorer(texts)
            return {"bits": pa.array(bits[:, -1]), "chars": pa.array(chars)}

        return run

    scored = map_texts(rows.where(F.col("lang").isin(*models.languages)).select("lang", "text"), "text", make, "bits double, chars long")
    return scored.where("chars > 0").select("lang", (F.col("bits") / F.col("chars")).alias("h"), "chars")


def learn(df: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", per_language: int = PER_LANGUAGE, calibrating: int = CALIBRATING) -> Models:
    """Models learned from about ``per_language`` labelled rows of each language and calibrated with about
    ``calibrating`` more; where a language has fewer rows, both get their share of them.

    A row is taken where a hash of its id falls under its language's share; tasks send each language's word counts,
    which are summed before they come to the driver, so what it gets is bounded by the sample's vocabulary.
    """
    rows = df.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("id"))
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row per language
    if not counts:
        return Models([], [], [], [], np.empty(0))
    draw = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << 30)) / float(1 << 30)
    share = F.element_at(F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, (per_language + calibrating) / n))]), F.col("lang"))
    part = rows.withColumn("draw", draw / share).where("draw < 1")
    cut = per_language / (per_language + calibrating) if min(counts.values()) > per_language + calibrating else 2 / 3

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, str], int] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for w in LETTERS.findall((text or "").lower()):
                    seen[lang, w] = seen.get((lang, w), 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], names=["lang", "word", "n"])

    words = part.where(F.col("draw") < cut).select("lang", "text").mapInArrow(count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toArrow()
    sample: dict[str, tuple[list, list]] = {lang: ([], []) for lang in counts}
    for lang, word, n in zip(*(words.column(c).to_pylist() for c in ("lang", "word", "n")), strict=True):
        sample[lang][0].append(word)
        sample[lang][1].append(n)
    sample = {lang: x for lang, x in sample.items() if x[0]}
    if not sample:
        return Models([], [], [], [], np.empty(0))
    models = train({lang: tuple(map(list, zip(*sorted(zip(*x, strict=True)), strict=True))) for lang, x in sample.items()})
    held: dict[str, list[tuple[float, int]]] = {}
    for lang, h, chars in own_entropies(part.where(F.col("draw") >= cut), models).collect():  # two numbers for each of about calibrating rows
        held.setdefault(lang, []).append((h, chars))
    calibrate(models, held)
    return models


def predict(df: DataFrame, models: Models, text_col: str = "text") -> DataFrame:
    """Adds ``lang_pred``, ``score`` (the softmax of what a hundred characters of the text's entropies say) and
    ``rejected``."""
    handle = df.sparkSession.sparkContext.broadcast(models)

    def make() -> Callable[[list[str]], dict[str, pa.Array]]:
        m = handle.value
        scorer = Scorer(m)

        def run(texts: list[str]) -> dict[str, pa.Array]:
            if not m.languages:
                return {"lang_pred": pa.array([UNDETERMINED] * len(texts)), "score": pa.array([0.0] * len(texts)), "rejected": pa.array([True] * len(texts))}
            bits, chars, words = scorer(texts)
            n = np.maximum(chars, 1)
            h, mixed = bits[:, :-1] / n[:, None], bits[:, -1] / n
            best = h.argmin(axis=1)
            away = (h - h.min(axis=1)[:, None]) * np.minimum(n, 100)[:, None]
            score = np.where(words > 0, 1 / np.exp2(-np.minimum(away, 500)).sum(axis=1), 0.0)
            rejected = (words == 0) | (m.excess(best, mixed, n) > m.limit)
            names = [m.languages[b] if w else UNDETERMINED for b, w in zip(best.tolist(), words.tolist(), strict=True)]
            return {"lang_pred": pa.array(names, pa.string()), "score": pa.array(score), "rejected": pa.array(rejected)}

        return run

    return map_texts(df, text_col, make, "lang_pred string, score double, rejected boolean")


def held_out(id_col: str = "doc_id") -> F.Column:
    """Rows that are never learned from: crc32 of the id as text is divisible by 5 (never so without an id)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the rows that aren't held out."""
    models = learn(table(spark, sf_dir, "documents", "doc_id", "text", "lang").where(~held_out()))
    out = predict(table(spark, sf_dir, "documents", "doc_id", "text"), models)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
