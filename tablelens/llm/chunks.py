"""Safe boundaries: cut a text into short pieces that a tokenizer encodes alike alone and in place.

Byte-level BPE with the usual pre-token pattern starts a new pre-token at a space that follows a
non-space, and gives the last white space of a run before a word a pre-token of its own. Pieces are
therefore a word with its leading space, a white-space run without its last character, or that one
character. Texts with white space outside ASCII don't have these boundaries (a run may mix both kinds);
``Pieces`` reports them as a whole. Special strings (added tokens) end a text for the pattern, so that a
white-space run before one is not cut: texts are split at them first.

Words repeat, so encodings are remembered per piece in a table of bounded size.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import chain

_S = r"\x20\x09-\x0D"
PIECES = re.compile(rf" ?[^{_S}]+|[{_S}]+(?![^{_S}])|[{_S}]")
#: White space outside ASCII (Unicode White_Space).
WIDE_SPACE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
ODD = ("  ", " \n", "\n ", "\n\n", "\t", "\r", "\x0b", "\x0c")


_HELD: dict[str, object] = {}


def held(name: str, make: Callable[[], object]):
    """What an operator keeps in its Python worker from task to task: only the last operator's, so that tables of
    stages before don't fill the worker's memory."""
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = make()
    return _HELD[name]


def release() -> None:
    """For operators that keep nothing: drop what others kept."""
    _HELD.clear()


class Remembered(dict):
    """piece -> encoding; missing pieces are encoded in one batch; emptied at ``most`` entries."""

    def __init__(self, encode: Callable[[list], list], most: int = 600_000, longest: int = 64):
        super().__init__()
        self.encode, self.most, self.longest = encode, most, longest
        self.once: list = []

    def learn(self, pieces) -> None:
        wanted = set(pieces)
        missing = [p for p in wanted if p not in self]
        if missing:
            if len(self) + len(missing) > self.most:
                self.clear()
                missing = list(wanted)
            self.update(zip(missing, self.encode(missing)))
            self.once += [p for p in missing if len(p) > self.longest]

    def forget_long(self) -> None:
        """Long pieces are kept for one text only."""
        for p in self.once:
            self.pop(p, None)
        self.once.clear()


class Pieces:
    """Encode texts piece by piece. ``encode(pieces) -> list of bytes`` sees pieces without wide white
    space; ``whole(text) -> bytes`` encodes a text that can't be cut. ``added``: the vocabulary file's
    added tokens; texts that hold one which looks at its neighbours are encoded whole."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], whole: Callable[[str], bytes], added: list[dict]):
        self.known = Remembered(lambda ps: self._encode(encode, ps))
        self.whole = whole
        # of two that start at one place the library takes the longer
        self.special = sorted((t["content"] for t in added), key=len, reverse=True)
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.apart = not any(t.get(k) for t in added for k in ("lstrip", "rstrip", "single_word"))

    @staticmethod
    def _encode(encode, pieces):
        out: dict[str, bytes | None] = {p: None for p in pieces if not p.isascii() and WIDE_SPACE.search(p)}
        todo = [p for p in pieces if p not in out]
        out.update(zip(todo, encode(todo)))
        return [out[p] for p in pieces]

    def cut(self, text: str) -> list[str]:
        if any(x in text for x in ODD):
            return PIECES.findall(text)
        out: list[str] = []
        for k, line in enumerate(text.split("\n")):
            if k:
                out.append("\n")
            first, *rest = line.split(" ")
            if first:
                out.append(first)
            out += [" " + w for w in rest]
        return out

    def __call__(self, text: str) -> bytes:
        if not any(x in text for x in self.special):
            return self._join(self.cut(text), text)
        if not self.apart:
            return self.whole(text)
        parts = self.split.split(text)  # every second one is a special string
        return b"".join([self._join([p] if k % 2 else self.cut(p), p) for k, p in enumerate(parts) if p])

    def many(self, texts: list[str]) -> list[bytes]:
        """The texts' encodings; what they miss in the table is encoded at once."""
        cuts = [None if any(x in t for x in self.special) else self.cut(t) for t in texts]
        self.known.learn(chain.from_iterable(c for c in cuts if c is not None))
        out = [self(t) if c is None else self._join(c, t, keep=True) for t, c in zip(texts, cuts)]
        self.known.forget_long()
        return out

    def _join(self, pieces: list[str], text: str, keep: bool = False) -> bytes:
        known = self.known
        try:
            out = b"".join(map(known.__getitem__, pieces))
        except KeyError:
            known.learn(pieces)
            try:
                out = b"".join(map(known.__getitem__, pieces))
            except TypeError:
                out = self.whole(text)
            if not keep:
                known.forget_long()
        except TypeError:
            out = self.whole(text)
        return out
