"""Token ids by a `tokenizers` file, each distinct chunk between blanks encoded once per task."""

from __future__ import annotations

import functools
import itertools
import json
import os
import re
from collections.abc import Callable, Iterator

import numpy as np

from tessera.llm.common import WordIds, expand, sums_by

BLANKS = re.compile(r"[ \t\n\r]+")
#: Words of letters that are encoded as one text.
JOINED = 256
#: Latin letters, all of them letters to Unicode as well, and texts of nothing but these and ASCII.
_LATIN = "a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_OTHER = re.compile(f"[^\\x00-\\x7f{_LATIN}]|<\\|")
#: Runs of letters, runs of others with an apostrophe and the letters after them, runs of others.
_UNITS = re.compile(f"[{_LATIN}]+|[^{_LATIN} \\t\\n\\r']*'[^{_LATIN} \\t\\n\\r]*[{_LATIN}]*|[^{_LATIN} \\t\\n\\r']+")
#: Fixed value: the pattern of the tokenizers whose tokens end where a run of letters ends.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def splits_at_blanks(spec: dict) -> bool:
    """Whether a text's ids are those of its chunks between blanks, one after the other.

    True of tokenizers that drop white space before the merges and match no added token across it.
    """
    kinds = {"NFC", "NFD", "Lowercase", "Replace"}
    norm = (spec.get("normalizer") or {}).get("normalizers", [])
    pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    split = pre[0] if pre else {}
    pattern = (split.get("pattern") or {}).get("Regex", "")
    return (
        all(n["type"] in kinds for n in norm)
        and split.get("type") == "Split"
        and split.get("behavior") == "Removed"
        and bool(split.get("invert"))
        and r"[^\s" in pattern
        and not re.search(r"(?<!\^)\\s| [?+*]", pattern)
        and all(not BLANKS.search(t["content"]) and not t["lstrip"] and not t["rstrip"] and not t["single_word"] for t in spec.get("added_tokens", []))
    )


def lower_cases_runs(spec: dict) -> bool:
    """Whether a Latin text without control strings may be lower-cased in ASCII and cut at runs of letters."""
    norm = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
    return splits_at_blanks(spec) and "Lowercase" in norm and pre[0].get("pattern", {}).get("Regex") == _PATTERN and all(t["content"].startswith("<|") for t in spec.get("added_tokens", []))


def units(text: str) -> list[str]:
    """The text cut where a token ends whatever stands around: fewer distinct units than words with their marks.

    Composition changes nothing below U+0300, so such texts may be lower-cased in ASCII first.
    """
    if "<|" in text or (not text.isascii() and _OTHER.search(text)):
        return [c for c in BLANKS.split(text) if c]
    return _UNITS.findall(text.encode().lower().decode())


@functools.lru_cache(maxsize=2)
def _load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if lower_cases_runs(spec):
        cut = units
    else:
        cut = (lambda text: [c for c in BLANKS.split(text) if c]) if splits_at_blanks(spec) else None
    return Tokenizer.from_file(path), cut


@functools.lru_cache(maxsize=2)
def _memory(path: str) -> WordIds:
    """Ids of units met before, kept while the worker lives."""
    tokenizer, cut = _load(path)

    def each(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(itertools.chain.from_iterable(ids), np.int32, int(lengths.sum())), lengths

    suffix = getattr(tokenizer.model, "end_of_word_suffix", None)
    if not cut or not suffix:
        return WordIds(each)
    closing = np.zeros(tokenizer.get_vocab_size(), bool)
    closing[[i for token, i in tokenizer.get_vocab().items() if token.endswith(suffix)]] = True

    def joined(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Words in texts of many: each has one closing token, unless normalisation parts one of the text's words."""
        groups = [words[i : i + JOINED] for i in range(0, len(words), JOINED)]
        for group, e in zip(groups, tokenizer.encode_batch_fast(list(map(" ".join, groups)), add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.int32)
            ends = np.flatnonzero(closing[ids])
            yield (ids, np.diff(ends, prepend=-1)) if len(ends) == len(group) and ends[-1] == len(ids) - 1 else each(group)

    def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        letters = np.fromiter(map(str.isalpha, words), bool, len(words))
        order = np.concatenate([np.flatnonzero(letters), np.flatnonzero(~letters)])
        runs = [words[i] for i in order[: letters.sum()]]
        parts = [*joined(runs), each([words[i] for i in order[len(runs) :]])]
        flat, lengths = (np.concatenate(x) for x in zip(*parts, strict=True))
        back = np.argsort(order)
        starts = np.cumsum(lengths) - lengths
        return flat[expand(starts[back], lengths[back])], lengths[back]

    return WordIds(encode)


def make_encoder(path: str, end_id: int | None) -> Callable[[list[str]], tuple[np.ndarray, np.ndarray]]:
    """A function from whole texts to their flat ids, ``end_id`` after each if given, and each text's number of ids."""
    _, cut = _load(path)
    memory = _memory(path)

    def run(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if cut:
            chunks = [cut(t) for t in texts]
            flat, per_chunk = memory(list(itertools.chain.from_iterable(chunks)))
            lengths = sums_by(per_chunk, list(map(len, chunks)))
        else:
            flat, lengths = memory.encode(texts)
        if end_id is not None:
            flat, lengths = np.insert(flat, np.cumsum(lengths), end_id), lengths + 1
        return flat.astype(np.int32, copy=False), lengths

    return run
