"""Byte-level BPE: a vocabulary of ranks read from a file, encoding by a queue of merges, decoding.

Encoding follows the published scheme: the text is cut into pre-tokens by a fixed pattern; within each
pre-token the adjacent pair of lowest merge rank is joined until no pair has a rank. A heap holds the
pairs, symbols form a doubly linked list, and heap entries that an earlier merge has made stale are
skipped when they come up.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
import sys
import unicodedata
from array import array

SPECIAL = "<|endoftext|>"
#: Unicode's White_Space property, as the tokenizers library reads \s (Python's own \s has four more).
_SPACE = "\t-\r \x85\xa0  -     　"


@functools.cache
def _classes() -> tuple[str, str]:
    """Character classes for letters and numbers as ranges for `re`."""
    ranges: dict[str, list[str]] = {"L": [], "N": []}
    run, start = "", 0
    for code in range(sys.maxunicode + 2):
        kind = unicodedata.category(chr(code))[0] if code <= sys.maxunicode else ""
        if kind != run:
            if run in ranges:
                ranges[run].append(f"\\U{start:08x}-\\U{code - 1:08x}")
            run, start = kind, code
    return "".join(ranges["L"]), "".join(ranges["N"])


@functools.cache
def pretoken_pattern() -> re.Pattern:
    letters, numbers = _classes()
    return re.compile(
        f" ?[{letters}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{numbers}]+| ?[^{_SPACE}{letters}{numbers}]+"
        f"|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
    )


@functools.cache
def _byte_chars() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies, back to bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class BytePairEncoder:
    """Encodes and decodes with the vocabulary and merges of a tokenizer file (JSON)."""

    #: Cached pieces; at this many the cache starts anew, which bounds a worker's memory.
    MOST_CACHED = 800_000

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        back = _byte_chars()
        raw = lambda s: bytes(back[c] for c in s)
        vocab = {raw(s): i for s, i in spec["model"]["vocab"].items()}
        self.bytes_of: list[bytes] = [b""] * (1 + max([*vocab.values(), *(a["id"] for a in spec["added_tokens"])]))
        for s, i in vocab.items():
            self.bytes_of[i] = s
        self.special: dict[str, int] = {}
        for added in spec["added_tokens"]:
            self.special[added["content"]] = added["id"]
            self.bytes_of[added["id"]] = added["content"].encode()
        self.ids = [vocab[bytes([b])] for b in range(256)]
        #: Rank of a pair, whose ids are packed into one integer; what the pair of a rank becomes.
        self.ranks: dict[int, int] = {}
        self.merged: list[int] = []
        for merge in spec["model"]["merges"]:
            left, right = map(raw, merge.split(" ") if isinstance(merge, str) else merge)
            self.ranks[vocab[left] << 32 | vocab[right]] = len(self.merged)
            self.merged.append(vocab[left + right])
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.pattern = pretoken_pattern()
        self.ends = {c: self._token(c) for c in ",."}
        self.tokens: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.odd_space = re.compile(f" (?:[{_SPACE}]|$)")
        self.boundary = re.compile(f" (?=[^{_SPACE}])")

    def merge(self, data: bytes) -> list[int]:
        """Ids of one pre-token. A heap entry is rank * n + place; it is stale if the pair there has another rank by now."""
        ids = self.ids
        symbols = [ids[b] for b in data]
        n = len(symbols)
        if n < 2:
            return symbols
        rank_of, merged = self.ranks.get, self.merged
        at = [rank_of(a << 32 | b, -1) for a, b in zip(symbols, symbols[1:], strict=False)]
        heap = [rank * n + i for i, rank in enumerate(at) if rank >= 0]
        if not heap:
            return symbols
        at.append(-1)
        heapq.heapify(heap)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        push, pop = heapq.heappush, heapq.heappop
        while heap:
            rank, i = divmod(pop(heap), n)
            if at[i] != rank:
                continue  # stale
            j = after[i]
            symbols[i] = new = merged[rank]
            symbols[j] = at[j] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                at[i] = rank = rank_of(new << 32 | symbols[k], -1)
                if rank >= 0:
                    push(heap, rank * n + i)
            else:
                at[i] = -1
            h = before[i]
            if h >= 0:
                at[h] = rank = rank_of(symbols[h] << 32 | new, -1)
                if rank >= 0:
                    push(heap, rank * n + h)
        return [s for s in symbols if s >= 0]

    def _token(self, token: str) -> bytes:
        ids = array("I", self.merge(token.encode()))
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def _piece(self, piece: str) -> bytes:
        """Little-endian 32-bit ids of a stretch that ends where a pre-token ends."""
        out, tokens = [], self.tokens
        for token in self.pattern.findall(piece):
            got = tokens.get(token)
            if got is None:
                got = self._token(token)
                if len(token) < 64:
                    if len(tokens) >= self.MOST_CACHED:
                        tokens.clear()
                    tokens[token] = got
            out.append(got)
        return b"".join(out)

    def _plain(self, text: str) -> bytes:
        """A space before anything but white space always starts a pre-token, so the text may be cut there."""
        if not text:
            return b""
        parts = self.boundary.split(text) if self.odd_space.search(text) else text.split(" ")
        head, pieces, ends, out = parts[0], self.pieces, self.ends, []
        if head or len(parts) == 1:
            out.append(self._piece(head))
        for part in parts[1:]:
            got = pieces.get(part)
            if got is None:
                end = b""
                if not part.isalpha():
                    end = ends.get(part[-1]) if part else None
                    if end is None or not part[:-1].isalpha():
                        out.append(self._piece(" " + part))
                        continue
                    part = part[:-1]  # a word and its comma or full stop are a pre-token each
                    got = pieces.get(part)
                if got is None:
                    got = self._token(" " + part)
                    if len(part) < 64:
                        if len(pieces) >= self.MOST_CACHED:
                            pieces.clear()
                        pieces[part] = got
                if end:
                    out.append(got)
                    got = end
            out.append(got)
        return b"".join(out)

    def encode_packed(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; the special tokens' strings get their ids."""
        if self.cut is None or not self.cut.search(text):
            return self._plain(text)
        return b"".join(self.special[p].to_bytes(4, "little") if p in self.special else self._plain(p) for p in self.cut.split(text))

    def encode(self, text: str) -> list[int]:
        return unpack(self.encode_packed(text))

    def decode(self, ids) -> str:
        """Concatenated vocabulary strings; bytes that are not UTF-8 become U+FFFD, unknown ids nothing."""
        table = self.bytes_of
        most = len(table)
        return b"".join([table[i] for i in ids if 0 <= i < most]).decode("utf-8", errors="replace")


def unpack(packed: bytes) -> array:
    ids = array("I", packed)
    if sys.byteorder == "big":
        ids.byteswap()
    return ids


@functools.cache
def encoder(path: str) -> BytePairEncoder:
    """One per Python worker."""
    return BytePairEncoder(path)


def default_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
