"""Exact token ids at dictionary speed.

A BPE library spends most of its time on words that it has met before. Where the
tokenizer's own configuration proves that text may be cut at spaces without
changing an id, words are looked up in a bounded memo and only unseen ones go to
the library. Any other configuration, and any text with unusual white space for
the byte-level kind, is handed to the library whole.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import trim

MEMO_WORDS = 600_000
MEMO_CHARS = 48
#: Text that is encoded together: the more, the fewer distinct words are looked up.
ENCODE_BYTES = 5 << 20
TAILS = (",", ".")
#: Texts of the byte-level kind that may not be cut at each space: long runs of white space, runs at the end, other
#: white space or control characters.
_UNCUTTABLE = r"[ \n]{3}|[ \n]{2}\z|[\x00-\x09\x0b-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def family(config: dict) -> str:
    """``words``, ``bytes`` or ``whole``: how far a text may be cut beforehand.

    ``words``: white space is removed by the pre-tokenizer and no piece spans it.
    ``bytes``: the standard byte-level splitter, whose pieces carry white space only
    in front, so a cut between a visible character and a space changes nothing.
    """
    norm, pre = config.get("normalizer"), config.get("pre_tokenizer") or {}
    if any(t.get("lstrip") or t.get("rstrip") or re.search(r"\s", t["content"]) for t in config.get("added_tokens", [])):
        return "whole"
    if config.get("post_processor") or config.get("truncation") or config.get("padding"):
        return "whole"
    if norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
        return "bytes"
    steps = [n.get("type") for n in (norm or {}).get("normalizers", [])]
    parts = pre.get("pretokenizers", [])
    if (
        steps == ["NFC", "Replace", "Lowercase"]
        and len(parts) == 2
        and parts[0].get("type") == "Split"
        and parts[0].get("behavior") == "Removed"
        and parts[0].get("invert")
        and parts[0]["pattern"].get("Regex", "").endswith(r"[^\s\p{L}\p{N}]+")
        and parts[1].get("type") == "ByteLevel"
        and not parts[1].get("use_regex")
    ):
        return "words"
    return "whole"


def version_digest(path: str) -> str:
    """Names the tokenizer file and the library that reads it."""
    import tokenizers

    h = hashlib.sha256(f"tokenizers {tokenizers.__version__}\n".encode())
    with open(path, "rb") as f:
        for block in iter(lambda: f.read(1 << 20), b""):
            h.update(block)
    return h.hexdigest()


def _bare(word: str) -> str:
    """``word`` without a final comma or full stop that is surely a piece of its own.

    The letters before it are limited to those whose lower case and composed form end in a letter too.
    """
    return word[:-1] if word[-1:] in TAILS and "0" <= word[-2:-1] < "\u0130" and word[-2].isalnum() else word


class Encoder:
    """Token ids of whole texts, equal to the library's ``encode(text, add_special_tokens=False).ids``."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.family = family(json.load(f))
        self.memo: dict[str, bytes] = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _chunks(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The chunks of all texts, how many each text has, and which texts stay whole."""
        n = len(texts)
        if self.family == "words":
            parts, whole = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " "), np.zeros(n, bool)
        elif self.family == "bytes":
            whole = pc.match_substring_regex(texts, _UNCUTTABLE).to_numpy(zero_copy_only=False)
            plain = pc.if_else(pa.array(whole), "", texts)
            parts = pc.split_pattern(pc.replace_substring(pc.replace_substring(plain, " ", "\0 "), "\n", "\0\n"), "\0")
        else:
            return pa.array([], texts.type), np.zeros(n, np.int64), np.ones(n, bool)
        return parts.flatten(), pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64), whole

    def _looked_up(self, words: list[str]) -> list[bytes]:
        memo = self.memo
        found = list(map(memo.get, words))
        at = [i for i, x in enumerate(found) if x is None]
        if not at:
            return found
        # A final comma or full stop behind a plain letter or digit is a piece of its own, so such
        # a word is looked up without it.
        bares = [_bare(words[i]) for i in at]
        unseen = dict.fromkeys(bares)
        for w in [w for w in unseen if w in memo]:
            del unseen[w]
        unseen.update(dict.fromkeys(t for t in TAILS if t not in memo))
        made = dict(zip(unseen, self._library(list(unseen)), strict=True)) if unseen else {}
        tails = {t: made[t] if t in made else memo[t] for t in TAILS}
        for i, bare in zip(at, bares, strict=True):
            ids = made[bare] if bare in made else memo[bare]
            found[i] = ids + tails[words[i][-1]] if len(words[i]) > len(bare) else ids
        room = MEMO_WORDS - len(memo)
        if room > 0:
            for w, ids in made.items():
                if len(w) <= MEMO_CHARS:
                    memo[w] = ids
            # One batch may overshoot the bound by its own distinct words.
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row (little-endian unsigned 32-bit), and how many belong to each text. Null reads as empty."""
        texts = pc.fill_null(texts, "")
        chunks, per_text, whole = self._chunks(texts)
        coded = chunks.dictionary_encode()
        index = coded.indices.to_numpy(zero_copy_only=False)
        pieces = self._looked_up(coded.dictionary.to_pylist())
        size = np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4
        flat = np.frombuffer(b"".join(pieces), "<u4")
        sizes = size[index]
        ends = np.cumsum(sizes)
        shift = (np.cumsum(size) - size)[index] - (ends - sizes)
        ids = flat[np.repeat(shift, sizes) + np.arange(len(sizes) and ends[-1])]
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(per_text)])]
        counts = np.diff(bounds)
        if not whole.any():
            return ids, counts
        rest = iter(self._library([t for t, w in zip(texts.to_pylist(), whole, strict=True) if w]))
        parts = [np.frombuffer(next(rest), "<u4") if w else ids[bounds[i] : bounds[i + 1]] for i, w in enumerate(whole)]
        return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)

    def ids(self, text: str | None) -> np.ndarray:
        return self.encode(pa.array([text], pa.string()))[0]


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder per worker process and tokenizer file."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path)


def slices(batches: Iterator[pa.RecordBatch], text: int, most_bytes: int = 6 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of Arrow batches again, in batches whose texts have ``most_bytes`` together (or one row)."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(size) // most_bytes
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)
    trim()


def joined_ids(batch_ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with ``end_id`` behind each text, and the bounds of the texts in them."""
    bounds = np.concatenate([[0], np.cumsum(counts + 1)])
    out = np.full(int(bounds[-1]), end_id, "<u4")
    keep = np.ones(len(out), bool)
    keep[bounds[1:] - 1] = False
    out[keep] = batch_ids
    return out, bounds
