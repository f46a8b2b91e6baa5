"""Byte-pair encoding of distinct words by one walk over their prefix trie.

The encoding of a prefix ends in one token only, and the tokens before it encode the prefix without that token.
So a trie node needs no more than its last token: a token ending there is the last one if it can stand behind the
last token of the node where it starts.  Two tokens can stand side by side if no merge across their border comes
before the merges that made them.

Distinct words in sorted order are the pre-order of their trie, and the path from the root is all that a
depth-first walk keeps: states of a prefix shared by many words are computed once, and memory is the longest word.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

_NEVER = 1 << 60


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(other)) for b in range(256)]


def shared(a: str, b: str) -> int:
    """Length of the common prefix, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


class TrieEncoder:
    """Encodes words over the symbols of a merge table.

    A symbol is one character.  With `suffix`, a word's last character is a symbol of its own, which the vocabulary
    writes as the character and the suffix; SHIFT moves such symbols out of the way of the others.
    """

    SHIFT = 0x10000

    def __init__(self, vocab: dict[str, int], merges: Iterable[tuple[str, str]], suffix: str = ""):
        self.suffix = suffix
        self.rank: dict[str, int] = {}
        self.pair: dict[tuple[str, str], int] = {}
        self.parts: dict[str, tuple[str, str]] = {}
        self.ids = {self._symbols(t): i for t, i in vocab.items()}
        for n, (a, b) in enumerate(merges):
            a, b = self._symbols(a), self._symbols(b)
            self.pair[a, b] = n
            self.parts[a + b] = (a, b)
            self.rank[a + b] = n
        self.usable = {t: t for t in self.ids if len(t) == 1 or t in self.parts}
        #: the usable tokens, from their last symbol to their first; at "" stands the token
        self.backwards: dict = {}
        for t in self.usable:
            node = self.backwards
            for symbol in reversed(t):
                node = node.setdefault(symbol, {})
            node[""] = t
        self.edges: dict[tuple[str, int], list[tuple[str, int]]] = {}
        self.fits: dict[tuple[str, str], bool] = {}

    def _symbols(self, token: str) -> str:
        if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix):
            token = token[: -len(self.suffix)]
            return token[:-1] + chr(ord(token[-1]) + self.SHIFT)
        return token

    def word(self, text: str) -> str:
        """The symbols of a word written in the byte alphabet."""
        return text[:-1] + chr(ord(text[-1]) + self.SHIFT) if self.suffix and text else text

    def _edge(self, token: str, side: int) -> list[tuple[str, int]]:
        """A token's left (0) or right (1) edge: the tokens met from it downwards, with the rank at which each is merged away."""
        edge = self.edges.get((token, side))
        if edge is None:
            if len(self.edges) > 20_000:
                self.edges.clear()
            edge, part, gone = [], token, _NEVER
            while part in self.parts:
                edge.append((part, gone))
                gone = self.rank[part]
                part = self.parts[part][side]
            edge.append((part, gone))
            edge.reverse()
            self.edges[token, side] = edge
        return edge

    def _stand(self, a: str, b: str) -> bool:
        """Whether a stays before b: walk both borders upwards in time and look for an earlier merge across."""
        left, right = self._edge(a, 1), self._edge(b, 0)
        i = j = 0
        while True:
            (x, x_gone), (y, y_gone) = left[i], right[j]
            across = self.pair.get((x, y))
            # of equal pairs the leftmost merges first: inside a before across, across before inside b
            if across is not None and across < x_gone and across <= y_gone:
                return False
            if x_gone == y_gone == _NEVER:
                return True
            if x_gone <= y_gone:
                i += 1
            else:
                j += 1

    def encode(self, words: Iterable[str]) -> dict[str, list[int]]:
        """The ids of each distinct word (given in symbols)."""
        out: dict[str, list[int]] = {}
        backwards, usable, fits, ids = self.backwards, self.usable, self.fits, self.ids
        if len(fits) > 300_000:
            fits.clear()
        last, begins = [""], [0]
        before = ""
        for word in sorted(set(words)):
            n = len(word)
            depth = min(len(last) - 1, n)
            while word[:depth] != before[:depth]:
                depth = depth - 1 if depth < 64 else shared(word, before)
            del last[depth + 1 :], begins[depth + 1 :]
            for end in range(depth + 1, n + 1):
                # one token alone stands at a node; most often it lengthens the token before it or is one symbol
                start = begins[-1]
                token = usable.get(word[start:end])
                if token is not None:
                    ahead = last[start]
                    ok = not ahead or fits.get((ahead, token))
                    if ok is None:
                        ok = fits[ahead, token] = self._stand(ahead, token)
                    if ok:
                        last.append(token)
                        begins.append(start)
                        continue
                if end > 1:
                    ahead, token = last[-1], usable.get(word[end - 1])
                    ok = fits.get((ahead, token))
                    if ok is None:
                        ok = fits[ahead, token] = token is not None and self._stand(ahead, token)
                    if ok:
                        last.append(token)
                        begins.append(end - 1)
                        continue
                node, start, ending = backwards, end, []
                while start:
                    start -= 1
                    node = node.get(word[start])
                    if node is None:
                        break
                    if "" in node:
                        ending.append(node[""])
                for token in reversed(ending):
                    ahead = last[end - len(token)]
                    if not ahead:
                        break
                    ok = fits.get((ahead, token))
                    if ok is None:
                        ok = fits[ahead, token] = self._stand(ahead, token)
                    if ok:
                        break
                else:
                    raise ValueError(f"no token ends in {word[:end]!r}")
                last.append(token)
                begins.append(end - len(token))
            found, end = [], n
            while end:
                found.append(ids[last[end]])
                end = begins[end]
            found.reverse()
            out[word] = found
            before = word
        return out


def load(path: str) -> tuple[TrieEncoder, dict]:
    """The encoder of a tokenizers JSON file, and the file's contents."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    merges = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
    encoder = TrieEncoder(model["vocab"], merges, model.get("end_of_word_suffix") or "")
    del spec["model"]  # the encoder holds what it needs of it
    return encoder, spec
