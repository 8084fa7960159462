"""Byte-level BPE over words (the pattern's matches), with a bounded cache of words.

Every match of the pattern is encoded on its own, so a text's ids are its words' ids in a row. A
word is merged here: of its neighbouring parts the pair of the least rank joins, the leftmost of
equals, until no pair is in the vocabulary. Long words are halved and reduced up a tree: ids of
neighbours join by merging anew a growing window around the cut, until the pairs of ids at both
of its ends stand as they are when merged alone. A row of ids all of whose neighbouring pairs
stand so is the encoding of its bytes: the first merge across two ids would also happen with
those two alone, as merges inside an id do not depend on what is around it.

A match depends only on the text from its start on. Two scans that both start a match at one
place therefore agree from there on, as far as both see the same text; and a match that ends
at least ``MARGIN`` characters before a cut is not changed by what follows the cut. The tree
and the overlap operators rest on these two facts.
"""

from __future__ import annotations

import base64
import heapq
import json
import re

import numpy as np
import regex
import tiktoken

#: A match that ends so many characters before a cut stands: the longest look-ahead ('re, 've, 'll) is 3.
MARGIN = 3
#: Words of each of the two generations kept per worker process; a word that neither has is encoded again.
CACHE_WORDS = 200_000
#: Bytes of a word up to which it is merged at once, and of its leaves beyond; ids that a join merges anew first.
PIECE, EDGE = 256, 4
#: Bytes up to which looking over all pairs costs less than a heap.
SHORT = 64
# Fixed value: the pattern for which the fast expression below gives the same matches.
FAST_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# The letter, number and white-space classes of the code points that the fast path admits.
_L = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
_N = r"0-9\xb2\xb3\xb9\xbc-\xbe"
_S = r"\t-\r \x85\xa0"
_FAST = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_OTHER = re.compile(r"[^\x00-ɏ‐-‧‰-⁞€]")


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_ranks(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """(ranks, special tokens) of a .tiktoken or a byte-level .json vocabulary."""
    if not path.endswith(".json"):
        with open(path, "rb") as f:
            return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, {}
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters = _byte_letters()
    special = {x["content"]: x["id"] for x in spec["added_tokens"]}
    ranks = {bytes(letters[c] for c in w): i for w, i in spec["model"]["vocab"].items() if w not in special}
    merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
    order = [spec["model"]["vocab"]["".join(m)] for m in merges]
    if any(x >= y for x, y in zip(order, order[1:], strict=False)):
        raise ValueError("merge priorities differ from the order of ids")
    return ranks, special


def merge(ranks: dict[bytes, int], piece: bytes) -> list[int]:
    """Ids of a piece: pairs of neighbouring parts join by least rank, the leftmost first."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    if n <= SHORT:
        return _merge_short(ranks, piece)
    end, back = list(range(1, n + 1)), list(range(-1, n - 1))  # part i is piece[i:end[i]], the one before it starts at back[i]
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if i < 0 or end[i] == 0 or end[i] >= n or end[end[i]] != stop:
            continue  # one of its parts has grown since
        j = end[i]
        end[i], end[j] = stop, 0
        if stop < n:
            back[stop] = i
            if (r := ranks.get(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        h = back[i]
        if h >= 0 and (r := ranks.get(piece[h:stop])) is not None:
            heapq.heappush(heap, (r, h, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


def _merge_short(ranks: dict[bytes, int], piece: bytes) -> list[int]:
    """merge of a few bytes: the ranks of all pairs in a list, its least one sought again each time."""
    get, none = ranks.get, 1 << 60
    parts = [piece[i : i + 1] for i in range(len(piece))]
    pairs = [get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
    while pairs and (least := min(pairs)) < none:
        i = pairs.index(least)
        joined = parts[i] + parts[i + 1]
        parts[i : i + 2] = [joined]
        del pairs[i]
        if i < len(pairs):
            pairs[i] = get(joined + parts[i + 1], none)
        if i:
            pairs[i - 1] = get(parts[i - 1] + joined, none)
    return [ranks[p] for p in parts]


class _Words(dict):
    """Ids of words; when a generation is full it becomes the older one, from which words in use come back."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.older = encode, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = np.array(self.encode(word), dtype="<u4").tobytes()
        if len(word) <= 48:
            if len(self) >= CACHE_WORDS:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids


class Encoder:
    """One vocabulary; special strings in a text become special ids if it has any.

    Words are merged here (``own``), or by an installed library's core, which gives the same ids
    and costs less: for operators whose method is not the encoding itself.
    """

    def __init__(self, path: str, pattern: str, own: bool = True):
        self.ranks, self.special = load_ranks(path)
        self.slow, self.fast = regex.compile(pattern), pattern == FAST_PATTERN
        if own:
            self.words = _Words(lambda word: self.reduce(word.encode("utf-8", "surrogatepass")))
        else:
            self.words = _Words(tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens=self.special)._encode_single_piece)
        self.bytes_of: list[bytes] = [b""] * (max([*self.ranks.values(), *self.special.values()]) + 1)
        for b, i in [*self.ranks.items(), *((s.encode(), i) for s, i in self.special.items())]:
            self.bytes_of[i] = b
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def forget(self) -> None:
        """Give the words' memory back, as idle worker processes stay beside later stages."""
        self.words.clear()
        self.words.older = {}

    def reduce(self, piece: bytes, leaf: int = PIECE) -> list[int]:
        """Ids of one word, by halves if it is long."""
        if len(piece) <= leaf:
            return merge(self.ranks, piece)
        half = len(piece) // 2
        return self.join(self.reduce(piece[:half], leaf), self.reduce(piece[half:], leaf))

    def stands(self, a: int, b: int) -> bool:
        """Whether two ids stay as they are when their bytes are merged together."""
        return merge(self.ranks, self.bytes_of[a] + self.bytes_of[b]) == [a, b]

    def join(self, a: list[int], b: list[int]) -> list[int]:
        """Ids of the bytes of both."""
        back = ahead = EDGE
        while True:
            left, right = max(0, len(a) - back), min(len(b), ahead)
            middle = merge(self.ranks, b"".join(self.bytes_of[i] for i in [*a[left:], *b[:right]]))
            firm_left = not left or self.stands(a[left - 1], middle[0])
            firm_right = right == len(b) or self.stands(middle[-1], b[right])
            if firm_left and firm_right:
                return a[:left] + middle + b[right:]
            back, ahead = back if firm_left else 2 * back, ahead if firm_right else 2 * ahead

    def pattern_for(self, text: str):
        return _FAST if self.fast and not _OTHER.search(text) else self.slow

    def matches(self, text: str) -> list[str]:
        return self.pattern_for(text).findall(text)

    def segments(self, text: str):
        """(part, special id or None): specials are taken out before words are matched."""
        for part in self.split.split(text) if self.split else [text]:
            if part:
                yield part, self.special.get(part) if self.split else None

    def ordinary(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, self.matches(text)))

    def ids(self, text: str) -> bytes:
        """Little-endian 32-bit ids of a text."""
        if not self.split or not any(s in text for s in self.special):
            return self.ordinary(text)
        return b"".join(self.ordinary(p) if i is None else np.uint32(i).astype("<u4").tobytes() for p, i in self.segments(text))


_open: dict[tuple[str, str, bool], Encoder] = {}


def encoder(path: str, pattern: str, own: bool = True) -> Encoder:
    """This process's encoder of a vocabulary."""
    if (path, pattern, own) not in _open:
        _open.clear()
        _open[path, pattern, own] = Encoder(path, pattern, own)
    return _open[path, pattern, own]
