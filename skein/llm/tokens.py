"""Vectorized word and token scanning of texts: the parts that the text operators share.

Texts of a batch are laid end to end as code units (bytes for ASCII, code points otherwise); everything else is array
arithmetic over that buffer. Byte-level BPE is additive over its pre-tokens, so a token count is a sum of per
pre-token counts, and those are looked up by a 64-bit hash in a bounded table; only unseen pre-tokens are encoded.
"""

from __future__ import annotations

import base64
import functools
import sys
import unicodedata

import numpy as np

OTHER, LETTER, NUMBER, SPACE = range(4)
_P = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Texts are worked on in slices of about this many code units, which bounds a worker's memory.
SLICE_UNITS = 2_000_000

#: The pre-token pattern of the public byte-level BPE vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_vocabulary() -> str:
    """The place of the public 50k byte-level BPE ranks; operators take any other path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@functools.cache
def _classes() -> np.ndarray:
    """The class of every code point."""
    out = np.zeros(sys.maxunicode + 1, np.uint8)
    for c in range(sys.maxunicode + 1):
        k = unicodedata.category(chr(c))[0]
        if k == "L":
            out[c] = LETTER
        elif k == "N":
            out[c] = NUMBER
        elif k == "Z" or c in (9, 10, 11, 12, 13, 0x85):
            out[c] = SPACE
    return out


@functools.cache
def _ascii_classes() -> np.ndarray:
    out = np.zeros(256, np.uint8)
    for c in range(128):
        s = chr(c)
        out[c] = LETTER if s.isalpha() else NUMBER if s.isdigit() else SPACE if s in " \t\n\x0b\x0c\r" else OTHER
    return out


class Slice:
    """Some texts end to end: units, the first unit of each text (offs, with the end), and the class of each unit."""

    def __init__(self, texts: list[str]):
        joined = "".join(texts)
        self.offs = np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))
        if joined.isascii():
            self.units = np.frombuffer(joined.encode("ascii"), np.uint8)
            self.cls = _ascii_classes()[self.units]
        else:
            self.units = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
            self.cls = _classes()[self.units]
        self.joined = joined


def slices(texts: list[str], limit: int = SLICE_UNITS):
    """(first, last, texts) in pieces of about limit units; a single longer text is a piece of its own."""
    i = size = 0
    for j, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield i, j, texts[i:j]
            i, size = j, 0
        size += len(t)
    if i < len(texts):
        yield i, len(texts), texts[i:]


def span_hash(units: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, by prefix sums of a polynomial modulo 2**64, mixed at the end."""
    n = len(units)
    with np.errstate(over="ignore"):
        power, inverse = _powers(n + 1)
        pre = np.zeros(n + 1, np.uint64)
        np.cumsum((units.astype(np.uint64) + np.uint64(1)) * power[:n], out=pre[1:])
        h = (pre[ends] - pre[starts]) * inverse[starts]
        return mix(h + (ends - starts).astype(np.uint64))


def mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(32))


_pow: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _pow or len(_pow[0]) < n:
        m = max(n, SLICE_UNITS + 100_000)
        with np.errstate(over="ignore"):
            _pow[:] = [np.cumprod(np.concatenate(([np.uint64(1)], np.full(m - 1, x, np.uint64)))) for x in (_P, _INV)]
    return _pow[0], _pow[1]


def pretokens(s: Slice) -> np.ndarray:
    """The first unit of every pre-token, ascending; texts are cut apart."""
    n = len(s.units)
    if not n:
        return np.zeros(0, np.int64)
    u, c = s.units, s.cls
    space = c == SPACE
    prev_space = np.concatenate(([False], space[:-1]))
    next_space = np.concatenate((space[1:], [False]))
    differs = np.concatenate(([True], c[1:] != c[:-1]))
    head = np.zeros(n + 1, bool)
    head[s.offs] = True  # each text begins a pre-token; empty texts share a place
    last = np.zeros(n, bool)
    ends = s.offs[1:][s.offs[1:] > s.offs[:-1]] - 1
    last[ends] = True
    head = head[:n]
    blank_before = np.concatenate(([False], u[:-1] == 32)) & ~head
    start = np.where(space, (differs & ~prev_space) | (~next_space & ~last), np.where(prev_space, ~blank_before, differs))
    start |= head
    q = np.flatnonzero((u == 39) & ~last)
    if len(q):  # contractions: an apostrophe that begins a match
        before = np.where(head[q], SPACE, c[np.maximum(q - 1, 0)])
        q = q[(before != OTHER) & ~blank_before[q]]
        a = u[q + 1]
        b = np.where(q + 2 < n, u[np.minimum(q + 2, n - 1)], 0)
        b = np.where(last[q + 1], 0, b)
        one = np.isin(a, [ord(x) for x in "stmd"])
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        for at, k in ((q[one], 2), (q[two], 3)):
            start[at + 1] = False
            after = at + k
            after = after[after < n]
            # what follows a contraction begins anew, unless a blank there belongs to a longer run of white space
            start[after[~space[after]]] = True
            start[after] |= head[after]
    return np.flatnonzero(start)


class Counter:
    """Token counts of pre-tokens under one vocabulary, with a hash table of 2**bits places that forgets on collision."""

    def __init__(self, vocabulary: str, bits: int = 20):
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("counts", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.keys = np.zeros(1 << bits, np.uint64)
        self.counts = np.zeros(1 << bits, np.int32)
        self.mask = np.uint64((1 << bits) - 1)

    def of(self, s: Slice, starts: np.ndarray) -> np.ndarray:
        """The number of tokens of each pre-token."""
        if not len(starts):
            return np.zeros(0, np.int32)
        ends = np.concatenate((starts[1:], [len(s.units)]))
        h = span_hash(s.units, starts, ends)
        place = (h & self.mask).astype(np.int64)
        out = self.counts[place]
        miss = np.flatnonzero(self.keys[place] != h)
        if len(miss):
            new, first, back = np.unique(h[miss], return_index=True, return_inverse=True)
            at = miss[first]
            n = np.array([len(self.encode(s.joined[a:b])) for a, b in zip(starts[at].tolist(), ends[at].tolist())], np.int32)
            out[miss] = n[back]
            where = (new & self.mask).astype(np.int64)
            self.keys[where], self.counts[where] = new, n
        return out


@functools.cache
def counter(vocabulary: str) -> Counter:
    return Counter(vocabulary)


def count_tokens(texts: list[str], vocabulary: str) -> np.ndarray:
    """The number of tokens of each text."""
    out = np.zeros(len(texts), np.int64)
    c = counter(vocabulary)
    for i, j, part in slices(texts):
        s = Slice(part)
        starts = pretokens(s)
        cum = np.concatenate(([0], np.cumsum(c.of(s, starts), dtype=np.int64)))
        out[i:j] = np.diff(cum[np.searchsorted(starts, s.offs)])
    return out


def word_spans(s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text number of the words (longest runs of a-z and 0-9 after lower-casing); texts are cut apart.

    The slice must hold lower-cased texts.
    """
    u = s.units
    n = len(u)
    is_word = ((u >= 97) & (u <= 122)) | ((u >= 48) & (u <= 57))
    edge = np.zeros(n + 1, np.int8)
    edge[:n] = is_word
    flips = np.diff(edge, prepend=0)
    # a text boundary inside a run of word characters cuts it
    inner = s.offs[1:-1]
    inner = np.unique(inner[(inner > 0) & (inner < n)])
    inner = inner[is_word[inner] & is_word[inner - 1]]
    starts, ends = np.flatnonzero(flips == 1), np.flatnonzero(flips == -1)
    if len(inner):
        starts, ends = np.sort(np.concatenate((starts, inner))), np.sort(np.concatenate((ends, inner)))
    return starts, ends, np.searchsorted(s.offs, starts, "right") - 1
