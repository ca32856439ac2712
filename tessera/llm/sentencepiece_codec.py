"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text is normalised (dummy prefix, spaces to U+2581), cut before each U+2581 that follows another character (no
piece of such a vocabulary crosses that place; the model is checked for it) and each distinct word is merged:
flat symbol arrays hold all words at once; every round finds the best pair rank of each word, merges its leftmost
occurrences at the same time, compacts the arrays and sets words aside in which no pair remains.

Nulls are read as empty texts; an empty text has no pieces. Rows, ties and other columns are kept as they are; an
empty table gives an empty table; a column that is named as a new one is replaced.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import WordIds, list_array, map_texts, sums_by, table

SPACE = "▁"
NONE = np.iinfo(np.int32).max


class PairTable:
    """Open-addressing table from pairs of symbols to (rank, merged symbol), probed by whole arrays."""

    def __init__(self, keys: np.ndarray, ranks: np.ndarray, merged: np.ndarray):
        self.bits = max(4, int(len(keys) * 4).bit_length())
        size = 1 << self.bits
        self.keys, self.at = np.full(size, -1, np.int64), np.zeros(size, np.int32)
        slot, left, self.probes = self._slot(keys), np.arange(len(keys)), 0
        while len(left):
            self.probes += 1
            free = self.keys[slot[left]] < 0
            put = left[free]
            self.keys[slot[put]], self.at[slot[put]] = keys[put], put  # of equal slots the last one stays
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & (size - 1)
        self.ranks, self.merged = np.append(ranks, NONE).astype(np.int32), np.append(merged, -1).astype(np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE if there is no such pair) and merged symbol of each key."""
        found, slot = np.full(len(keys), len(self.ranks) - 1, np.int64), self._slot(keys)
        left = np.arange(len(keys))
        for _ in range(self.probes):
            there = self.keys[slot]
            hit = there == keys[left]
            found[left[hit]] = self.at[slot[hit]]
            more = ~hit & (there >= 0)
            left, slot = left[more], (slot[more] + 1) & (len(self.keys) - 1)
            if not len(left):
                break
        return self.ranks[found], self.merged[found]


class PieceModel:
    """Tables of a BPE model file, and encoding and decoding with them."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm, kind = proto.normalizer_spec, pb.ModelProto.SentencePiece
        if proto.trainer_spec.model_type != pb.TrainerSpec.BPE or not proto.trainer_spec.byte_fallback:
            raise ValueError("a BPE model with byte fallback is needed")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("a model without character normalisation is needed")
        if any(p.type in (kind.USER_DEFINED, kind.UNUSED) for p in proto.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.prefix = norm.add_dummy_prefix
        pieces = [p.piece for p in proto.pieces]
        self.size = len(pieces)
        ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == kind.NORMAL}
        #: Whether each word can be merged on its own.
        self.by_word = not any(SPACE in p.lstrip(SPACE) for p in ids)
        self.split = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+", re.S)
        symbols = dict(ids)
        for c in sorted({c for p in ids for c in p} - ids.keys()):
            symbols[c] = self.size + len(symbols) - len(ids)  # characters of pieces that are no pieces themselves
        self.unknown = self.size + len(symbols) - len(ids)
        self.char = np.full(0x110000, self.unknown, np.int32)
        for p, i in symbols.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        scores = np.array([p.score for p in proto.pieces])
        rank_of = {s: r for r, s in enumerate(sorted({scores[i] for i in ids.values()}, reverse=True))}
        rank = {p: rank_of[scores[i]] for p, i in ids.items()}
        self.base = self.unknown + 1
        keys, ranks, merged = [], [], []
        for p, i in ids.items():
            for k in range(1, len(p)):
                if (a := symbols.get(p[:k])) is not None and (b := symbols.get(p[k:])) is not None:
                    keys.append(a * self.base + b)
                    ranks.append(rank[p])
                    merged.append(i)
        self.pairs = PairTable(np.array(keys, np.int64), np.array(ranks, np.int64), np.array(merged, np.int64))
        # Several occurrences of a pair may merge at once unless the merged piece can take part in a pair of the
        # same or a better rank, which the library would merge before the pair's next occurrence.
        self.safe = np.ones(self.base, bool)
        shared = {r for r, n in zip(*np.unique([rank[p] for p in ids if len(p) > 1], return_counts=True), strict=True) if n > 1}
        for p, r in rank.items():
            if r in shared:
                self.safe[ids[p]] = False
            for k in range(1, len(p)):
                for part in (p[:k], p[k:]):
                    if part in rank and rank[part] >= r:
                        self.safe[ids[part]] = False
        byte = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == kind.BYTE}
        self.bytes = np.array([byte[f"<0x{b:02X}>"] for b in range(256)], np.int32)
        self.is_byte = np.zeros(self.size, bool)
        self.is_byte[self.bytes] = True
        self.surface = [p.replace(SPACE, " ").encode() for p in pieces]
        for b in range(256):
            self.surface[self.bytes[b]] = bytes([b])
        for i, p in enumerate(proto.pieces):
            if p.type == kind.CONTROL:
                self.surface[i] = b""
            elif p.type == kind.UNKNOWN:
                self.surface[i] = proto.trainer_spec.unk_surface.encode()
        self.spaced = np.array([p.type == kind.NORMAL and p.piece.startswith(SPACE) for p in proto.pieces])

    def merge(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges all words to the end: final symbols of each word in order, and their numbers."""
        seg = np.repeat(np.arange(len(lengths)), lengths)
        sym = symbols.astype(np.int64)
        rank, new = np.full(len(sym), NONE, np.int32), np.full(len(sym), -1, np.int32)
        if len(sym) > 1:
            at = np.flatnonzero(seg[1:] == seg[:-1])
            rank[at], new[at] = self.pairs(sym[at] * self.base + sym[at + 1])
        out_seg, out_sym = [], []
        while len(sym):
            head = np.append(True, seg[1:] != seg[:-1])
            begin = np.flatnonzero(head)
            best = np.repeat(np.minimum.reduceat(rank, begin), np.diff(np.append(begin, len(sym))))
            if (done := best == NONE).any():
                out_seg.append(seg[done])
                out_sym.append(sym[done])
                seg, sym, rank, new, best = (x[~done] for x in (seg, sym, rank, new, best))
                if not len(sym):
                    break
            at = np.flatnonzero(rank == best)
            count = np.arange(len(at))
            run = np.append(True, at[1:] != at[:-1] + 1)
            in_run = count - np.maximum.accumulate(np.where(run, count, 0))
            first = np.append(True, seg[at[1:]] != seg[at[:-1]])
            at = at[(in_run % 2 == 0) & (first | self.safe[new[at]])]
            sym[at] = new[at]
            stay = np.ones(len(sym), bool)
            stay[at + 1] = False
            at = (np.cumsum(stay) - 1)[at]
            seg, sym, rank, new = seg[stay], sym[stay], rank[stay], new[stay]
            near = np.unique(np.concatenate([at, at[at > 0] - 1]))
            rank[near], new[near] = NONE, -1
            near = near[near < len(sym) - 1]
            near = near[seg[near] == seg[near + 1]]
            rank[near], new[near] = self.pairs(sym[near] * self.base + sym[near + 1])
        if not out_seg:
            return np.empty(0, np.int64), np.zeros(len(lengths), np.int64)
        seg, sym = np.concatenate(out_seg), np.concatenate(out_sym)
        return sym[np.argsort(seg, kind="stable")], np.bincount(seg, minlength=len(lengths))

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of normalised words, flat, and each word's number of ids."""
        flat, counts, i = [], [], 0
        while i < len(words):
            j, held = i, 0
            while j < len(words) and (not held or held + len(words[j]) <= 200_000):
                held += len(words[j])
                j += 1
            code = np.frombuffer("".join(words[i:j]).encode("utf-32-le", "surrogatepass"), np.uint32)
            sym, n = self.merge(self.char[code], np.fromiter(map(len, words[i:j]), np.int64, j - i))
            if (odd := sym >= self.size).any():
                sym, n = self._fall_back(words[i:j], sym, n, odd)
            flat.append(sym)
            counts.append(n)
            i = j
        return np.concatenate(flat or [np.empty(0, np.int64)]), np.concatenate(counts or [np.empty(0, np.int64)])

    def _fall_back(self, words: list[str], sym: np.ndarray, n: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Replaces symbols that are no pieces by the ids of their character's UTF-8 bytes."""
        out, count, at = [], n.copy(), 0
        width = np.array([len(self.surface[s].decode()) if s < self.size and not self.is_byte[s] else 1 for s in sym.tolist()])
        for k, word in enumerate(words):
            pos = 0
            for q in range(at, at + n[k]):
                if odd[q]:
                    raw = word[pos].encode()
                    out.extend(self.bytes[list(raw)].tolist())
                    count[k] += len(raw) - 1
                else:
                    out.append(int(sym[q]))
                pos += width[q]
            at += n[k]
        return np.array(out, np.int64), count

    def words(self, text: str) -> list[str]:
        """The normalised text, cut where no piece can cross."""
        if not text:
            return []
        text = (SPACE if self.prefix else "") + text.replace(" ", SPACE)
        return self.split.findall(text) if self.by_word else [text]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, as the library's decode has it."""
        raw = b"".join(map(self.surface.__getitem__, ids.tolist()))
        if self.prefix:
            shown = next((i for i in ids.tolist() if self.surface[i]), None)
            if shown is not None and self.spaced[shown]:
                raw = raw[1:]
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return self._decode_bytes(ids)

    def _decode_bytes(self, ids: np.ndarray) -> str:
        """Each byte that is no part of a character becomes U+FFFD."""
        text, run, seen = [], b"", False
        for i in [*ids.tolist(), None]:
            if i is not None and self.is_byte[i]:
                run += self.surface[i]
                continue
            while run:
                for k in range(1, min(4, len(run)) + 1):
                    try:
                        text.append(run[:k].decode())
                        run = run[k:]
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    text.append("�")
                    run = run[1:]
                seen = True
            if i is not None and self.surface[i]:
                s = self.surface[i].decode()
                text.append(s[1:] if self.prefix and not seen and self.spaced[i] else s)
                seen = True
        return "".join(text)


@functools.lru_cache(maxsize=2)
def model(path: str) -> PieceModel:
    """The model of a file, loaded once per worker."""
    return PieceModel(path)


@functools.lru_cache(maxsize=2)
def _memory(path: str) -> WordIds:
    """Ids of words met before, kept while the worker lives."""
    return WordIds(model(path).encode_words)


def encode_decode(df: DataFrame, model_path: str, text_col: str = "text", end_id: int | None = None, decoded: bool = True) -> DataFrame:
    """Adds ``ids`` array<int> of each whole text, with ``end_id`` last if given, and ``decoded``, the text that
    decoding those ids gives.

    A null text is empty: its ids are the end id alone, and it decodes to the empty text.
    """

    def make():
        m, memory = model(model_path), _memory(model_path)

        def run(texts: list[str]) -> dict[str, pa.Array]:
            lists = [m.words(t) for t in texts]
            counts = [len(x) for x in lists]
            flat, per_word = memory([w for x in lists for w in x])
            n = sums_by(per_word, counts)
            if end_id is not None:
                flat = np.insert(flat, np.cumsum(n), end_id)
                n = n + 1
            got = {"ids": list_array(flat, n)}
            if decoded:
                ends = np.cumsum(n)
                got["decoded"] = pa.array([m.decode(flat[e - k : e]) for e, k in zip(ends, n, strict=True)], pa.string())
            return got

        return run

    return map_texts(df, text_col, make, "ids array<int>" + ", decoded string" * decoded)


def op1_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Digests of the ids (end id last) and of the decoded text of every document."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    out = encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"), end_id=2)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
