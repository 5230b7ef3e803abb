"""Token ids of texts by a given tokenizer file, with a bounded memo of the parts of words."""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np

from .common import LOWER, WHITE, mix

MEMO_ENTRIES = 300_000
CHUNK_CHARS = 4 << 20
LONG_WORD = 256  # bytes; longer words are not looked for among each other

# This split never matches across white space, so texts may be cut at it.
_WORDS_ONLY = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# White space and separators outside ASCII, and ASCII ones that libraries class differently.
_ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")
# Words of printable ASCII and Latin letters are split into parts here, as _WORDS_ONLY or the
# byte-level split do it; for these, lower case is the tokenizer's too. Other words stay whole.
_PART = re.compile(" ?[!-~\xc0-\xd6\xd8-\xf6\xf8-\xff]+|\n")
_GAP, _LETTER, _DIGIT, _MARK, _LINE, _ODD = range(6)


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte; printable bytes stand for themselves."""
    hidden = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b)]
    return {b: chr(256 + n) for n, b in enumerate(hidden)}


def _classes(spaced: bool) -> np.ndarray:
    out = np.full(256, _ODD, np.uint8)
    out[0x21:0x7F] = _MARK
    out[0x30:0x3A] = _DIGIT
    out[0x41:0x5B] = out[0x61:0x7B] = _LETTER
    out[[0x20] if spaced else WHITE] = _GAP
    out[[0x0A] if spaced else []] = _LINE
    return out


def _parts(data: np.ndarray, offsets: np.ndarray, spaced: bool, lower: bool):
    """The parts of texts that a merge model gets by themselves: bytes, first byte, byte after it, and where each text's begin.

    A part is a run of letters, of marks, or of digits (a single digit unless ``spaced``), or a
    short form such as 's; in ``spaced`` texts with the space before it, and a line end by itself.
    """
    n = len(data)
    kind = _classes(spaced)[data]
    at = np.flatnonzero(data[:-1] == 0xC3)
    at = at[(data[at + 1] != 0x97) & (data[at + 1] != 0xB7)]
    kind[at] = kind[at + 1] = _LETTER
    first = np.ones(n, bool)
    first[1:] = kind[1:] != kind[:-1]
    first |= (kind == _LINE) if spaced else (kind == _DIGIT)
    head = np.zeros(n + 1, bool)
    head[offsets[:-1]] = True
    head = head[:n]
    first |= head
    odd = kind == _ODD
    if odd.any():
        word = (kind != _GAP) & (kind != _LINE)
        begin = word & head
        begin[1:] |= word[1:] & ~word[:-1]
        number = np.cumsum(begin)
        some = np.zeros(number[-1] + 1, bool)
        some[number[odd]] = True
        odd = word & some[number]
        first &= ~odd | begin
    if lower:
        small = LOWER[data]
        up = at[(data[at + 1] < 0x9F)] + 1
        small[up] += 0x20
        data = np.where(odd, data, small)
    p = np.flatnonzero(first[:-1] & (data[:-1] == 0x27) & first[1:] & ~head[1:] & ~odd[:-1] & (kind[1:] == _LETTER))
    if spaced:
        p = p[head[p] | (data[p - 1] != 0x20)]
    if len(p):
        one = np.isin(data[p + 1], np.frombuffer(b"stmd", np.uint8))
        q = p[~one]
        q = q[q + 2 < n]
        q = q[~first[q + 2]]
        pair = data[q + 1].astype(np.int64) << 8 | data[q + 2]
        q = q[np.isin(pair, [int.from_bytes(x) for x in (b"re", b"ve", b"ll")])]
        for x, size in ((p[one], 2), (q, 3)):
            first[x + 1] = False
            first[(x + size)[x + size < n]] = True
    start = np.flatnonzero(first)
    end = np.append(start[1:], n)
    real = kind[start] != _GAP
    start, end = start[real], end[real]
    upto = np.searchsorted(start, offsets)
    if spaced and len(start):
        start = start - ((start > 0) & ~head[start] & (data[start - 1] == 0x20) & (kind[start] != _LINE))
    return data, start, end, upto


_LANES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)  # the first bytes of a lane


def _kinds(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal words share a kind: one word of each kind, and the kind of every word.

    Words are grouped by a hash of eight bytes at a time and then held against their kind's first
    word, byte by byte. Words that only share its hash, and long ones, are kinds of their own.
    """
    size = end - start
    lanes = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))

    def lane(word, skip, of):
        return lanes[start[word] + skip] & _LANES[np.minimum(size[of] - skip, 8)]

    key, at, skip = size.astype(np.uint64), np.flatnonzero(size <= LONG_WORD), 0
    while len(at):
        key[at] = mix(key[at] ^ lane(at, skip, at))
        skip += 8
        at = at[size[at] > skip]
    _, first, kind = np.unique(key, return_index=True, return_inverse=True)
    alone = (size > LONG_WORD) | (size != size[first[kind]])
    at, skip = np.flatnonzero(~alone), 0
    while len(at):
        alone[at] = lane(first[kind[at]], skip, at) != lane(at, skip, at)
        skip += 8
        at = at[~alone[at] & (size[at] > skip)]
    own = np.flatnonzero(alone)
    kind[own] = len(first) + np.arange(len(own))
    return np.concatenate([first, own]), kind


class Encoder:
    """``encode(texts)`` gives the ids of each text as little-endian 32-bit integers.

    The result equals ``Tokenizer.encode`` of the whole text. Where the file's pre-tokenizer
    provably never joins text across a single space or line end, texts are cut there, about
    ``CHUNK_CHARS`` characters of them at a time, and words of plain letters, digits and marks
    into the tokenizer's own parts. Each kind of part is looked up once a chunk in a memo of two
    generations of about ``MEMO_ENTRIES`` parts. New plain parts go to the merge model itself,
    past the tokenizer's normalizer and split; other new words to the tokenizer. Texts with other
    white space are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        self.added = [t["content"] for t in config["added_tokens"]]
        self.kind, self.lower = self._kind(config), "Lowercase" in json.dumps(config.get("normalizer"))
        self.tokenize = self.tokenizer.model.tokenize if self._bare(config) else None
        self.letters = _byte_letters()
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @staticmethod
    def _kind(config: dict) -> str:
        if any(" " in t["content"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in config["added_tokens"]):
            return "whole"
        before, split = config.get("normalizer"), config.get("pre_tokenizer") or {}
        if before is None and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space"):
            return "spaced"
        steps = split.get("pretokenizers") or [{}]
        if steps[0].get("behavior") == "Removed" and steps[0].get("invert") and steps[0].get("pattern") == {"Regex": _WORDS_ONLY}:
            if [x["type"] for x in (before or {}).get("normalizers", [])] in ([], ["NFC", "Replace", "Lowercase"]):
                return "words"
        return "whole"

    def _bare(self, config: dict) -> bool:
        """Whether parts of words may be given to the merge model as they are."""
        if config["model"]["type"] != "BPE":
            return False
        if self.kind == "spaced":
            return True
        steps = (config.get("pre_tokenizer") or {}).get("pretokenizers") or []
        if self.kind != "words" or len(steps) != 2:
            return False
        return steps[1]["type"] == "ByteLevel" and not steps[1].get("add_prefix_space") and not steps[1].get("use_regex")

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _may_cut(self, t: str) -> bool:
        """Whether a text may be cut at its white space, else it has to be encoded whole."""
        if self.kind == "whole" or _ODD_SPACE.search(t) or any(a in t for a in self.added):
            return False
        if self.kind == "words":
            return True
        if "  " in t or " \n" in t or "\n " in t or "\n\n\n" in t or "\t" in t or "\r" in t or "\v" in t or "\f" in t:
            return False
        return not t.endswith((" ", "\n\n"))

    def _learn(self, new: list[str]) -> None:
        memo, other, tokenize, plain = self.memo, new, self.tokenize, _PART.fullmatch
        if tokenize:
            other = []
            for u in new:
                if not plain(u):
                    other.append(u)
                    continue
                seen = u if u.isalnum() and u.isascii() else u.encode().decode("latin-1").translate(self.letters)
                memo[u] = array("I", [x.id for x in tokenize(seen)]).tobytes()
        for at in range(0, len(other), 4096):
            some = other[at : at + 4096]
            memo.update(zip(some, self._ids(some)))

    def _known(self, parts: list[str]) -> list[bytes]:
        """The ids of parts, by the memo."""
        if len(self.memo) > MEMO_ENTRIES:
            self.older, self.memo = self.memo, {}
        memo, older = self.memo, self.older
        new = [u for u in parts if u not in memo]
        if older and new:
            memo.update({u: older[u] for u in new if u in older})
            new = [u for u in new if u not in memo]
        if new:
            self._learn(new)
        return list(map(memo.__getitem__, parts))

    def _joined(self, texts: list[str]) -> list[bytes]:
        """The ids of texts that may be cut: each kind of part once, then all parts by their kinds."""
        raw = [t.encode() for t in texts]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw], dtype=np.int64)])
        if not offsets[-1]:
            return raw
        data, start, end, upto = _parts(np.frombuffer(b"".join(raw), np.uint8), offsets, self.kind == "spaced", self.lower)
        if not len(start):
            return [b""] * len(texts)
        first, kind = _kinds(data, start, end)
        whole = data.tobytes()
        known = self._known([whole[a:b].decode() for a, b in zip(start[first].tolist(), end[first].tolist())])
        size = np.fromiter(map(len, known), np.int64, len(known)) >> 2
        table, begin = np.frombuffer(b"".join(known), "<u4"), np.cumsum(size) - size
        size = size[kind]
        stop = np.cumsum(size)
        ids = table[np.repeat(begin[kind] - (stop - size), size) + np.arange(stop[-1])]
        cuts = np.concatenate([[0], stop])[upto].tolist()
        return [ids[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]

    def encode(self, texts: list[str]) -> list[bytes]:
        out, at = [], 0
        while at < len(texts):
            to, held = at, 0
            while to < len(texts) and held < CHUNK_CHARS:
                held += len(texts[to])
                to += 1
            cut = [self._may_cut(t) for t in texts[at:to]]
            joined = iter(self._joined([t for t, c in zip(texts[at:to], cut) if c]))
            out += [next(joined) if c else self._ids([t])[0] for t, c in zip(texts[at:to], cut)]
            at = to
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a tokenizer file, kept for the life of the Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
