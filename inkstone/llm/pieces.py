"""Exact byte-pair encoding by a table of each prefix's last token.

For a merge vocabulary, the encoding of every prefix of a text ends in one token only, and two tokens may stand next to
each other exactly if encoding their joined text gives those two back. So a left-to-right pass over the automaton's
matches finds, for every prefix, the one token that ends it and fits the token before; the ids follow backwards, and
the number of tokens of every prefix is one more than that of the prefix before its last token.

The text is cut where no piece of the vocabulary can lie across the cut (before a run of spaces, around line ends), so
tables are kept for each distinct stretch and used again. The number of kept tables is bounded.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import ahocorasick

SPACE = "▁"
#: Stretches whose tables one worker keeps; beyond that all are dropped and built anew.
MAX_KEPT = 300_000
#: Longer stretches are not kept.
MAX_KEPT_CHARS = 40


class _Made(dict):
    """Whether merging ever makes a piece out of its own characters."""

    def __init__(self, model: PieceModel) -> None:
        self.model = model

    def __missing__(self, piece: str) -> bool:
        got = self[piece] = len(piece) == 1 or self.model.split(piece) is not None
        return got


class PieceModel:
    """The pieces of a sentencepiece BPE model with byte fallback, identity normalisation and a dummy prefix."""

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        t, n = m.trainer_spec, m.normalizer_spec
        if t.model_type != 2 or not t.byte_fallback or n.precompiled_charsmap or n.remove_extra_whitespaces or not n.add_dummy_prefix or t.treat_whitespace_as_suffix:
            raise ValueError("only BPE models with byte fallback, identity normalisation and a dummy prefix")
        self.pieces = [p.piece for p in m.pieces]
        self.ids = {p.piece: i for i, p in enumerate(m.pieces) if p.type == 1}
        # merges go by score, the best first; a lower rank is merged earlier
        order = sorted(self.ids.values(), key=lambda i: -m.pieces[i].score)
        self.rank = dict(zip((self.pieces[i] for i in order), range(len(order)), strict=True))
        self.byte_id = {int(p.piece[1:-1], 16): i for i, p in enumerate(m.pieces) if p.type == 6}
        self.surface: list[bytes] = [p.replace(SPACE, " ").encode() for p in self.pieces]
        for b, i in self.byte_id.items():
            self.surface[i] = bytes([b])
        for i, p in enumerate(m.pieces):
            if p.type in (2, 3):
                self.surface[i] = b" \xe2\x81\x87 " if p.type == 2 else b""
        if any(re.search(f"[^{SPACE}]{SPACE}|\n.|.\n", p, re.S) for p in self.ids):
            raise ValueError("a piece lies across a place where texts are cut")
        self.automaton = ahocorasick.Automaton()
        for p in self.ids:
            self.automaton.add_word(p, (p, len(p)))
        self.automaton.make_automaton()
        self._splits: dict[str, tuple[str, str] | None] = {}
        self._fits: dict[tuple[str, str], bool] = {}
        self._edges: tuple[dict, dict] = ({}, {})
        self._made = _Made(self)
        #: A run of Latin letters is cut from a full stop or comma after it where no piece has such a pair.
        letters = "A-Za-z\u00c0-\u024f"
        apart = "" if any(re.search(f"[{letters}][.,]", p) for p in self.ids) else f"{SPACE}*[{letters}]+(?=[.,])|"
        self.cut = re.compile(f"{apart}{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")

    def split(self, piece: str) -> tuple[str, str] | None:
        """The two parts whose merge makes the piece last; None for one character or a piece that merging never makes."""
        if piece not in self._splits:
            self._splits[piece] = self._last_merge(piece)
        return self._splits[piece]

    def _last_merge(self, piece: str) -> tuple[str, str] | None:
        parts, last = list(piece), None
        while len(parts) > 1:
            best = min(((self.rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.rank), default=None)
            if best is None:
                return None
            i = best[1]
            last = (parts[i], parts[i + 1])
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return last

    def _edge(self, piece: str, side: int) -> list[tuple[str, float]]:
        """What stands at one end of the piece while it is put together, each with the rank at which it is merged away."""
        known = self._edges[side].get(piece)
        if known is not None:
            return known
        whole, out, end = piece, [], 1 << 40
        while True:
            out.append((piece, end))
            parts = self.split(piece) if len(piece) > 1 else None
            if parts is None:
                self._edges[side][whole] = out
                return out
            end = self.rank[piece]
            piece = parts[side]

    def fits(self, left: str, right: str) -> bool:
        """Whether left and right next to each other stay apart: no merge across their border comes before both are whole."""
        key = (left, right)
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) > 2_000_000:
                self._fits.clear()
            known = self._fits[key] = self._apart(left, right)
        return known

    def _apart(self, left: str, right: str) -> bool:
        rank = self.rank
        edge = self._edge(right, 0)
        for a, end_l in self._edge(left, 1):
            for b, end_r in edge:
                r = rank.get(a + b)
                if r is not None and r < end_l and r <= end_r:
                    return False
        return True

    def table(self, stretch: str) -> tuple[list[str], list[int]]:
        """For every prefix of the stretch: its last token and its number of tokens, bytes of unknown characters counted."""
        n = len(stretch)
        last: list[str] = [""] * (n + 1)
        count = [0] * (n + 1)
        done = 0
        known, fits, made = self._fits, self.fits, self._made
        for end, (piece, size) in self.automaton.iter(stretch):
            e = end + 1
            if last[e]:
                continue
            while done + 1 < e:
                done += 1
                if not last[done]:
                    self._unknown(stretch, done, last, count)
            s = e - size
            if s:
                before = last[s]
                ok = known.get((before, piece))
                if ok is None:
                    ok = made[piece] and fits(before, piece)
            else:
                ok = made[piece]
            if ok:
                last[e], count[e] = piece, count[s] + 1
        while done < n:
            done += 1
            if not last[done]:
                self._unknown(stretch, done, last, count)
        return last, count

    def _unknown(self, stretch: str, x: int, last: list[str], count: list[int]) -> None:
        c = stretch[x - 1]
        last[x], count[x] = c, count[x - 1] + (1 if c in self.ids else len(c.encode()))

    def tokens(self, stretch: str) -> tuple[list[int], list[int]]:
        """Ids of the stretch, recovered backwards from its table, and the number of tokens of each of its prefixes."""
        last, count = self.table(stretch)
        back: list[int] = []
        e = len(stretch)
        while e:
            p = last[e]
            i = self.ids.get(p)
            if i is None:
                back.extend(self.byte_id[b] for b in reversed(p.encode()))
            else:
                back.append(i)
            e -= len(p)
        back.reverse()
        return back, count

    def stretches(self, text: str) -> list[str]:
        return self.cut.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def encode(self, text: str) -> list[int]:
        return [i for s in self.stretches(text) for i in self.tokens(s)[0]]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces joined, spaces restored, bytes put together (invalid ones replaced), the dummy space taken off."""
        return self.text_of(b"".join([self.surface[i] for i in ids]))

    @staticmethod
    def text_of(raw: bytes) -> str:
        return raw.removeprefix(b" ").decode("utf-8", "replace")


class Kept(dict):
    """What `make` gives for a stretch, kept for the next time; bounded."""

    def __init__(self, make: Callable[[str], object]) -> None:
        self.make = make

    def __missing__(self, stretch: str) -> object:
        got = self.make(stretch)
        if len(stretch) <= MAX_KEPT_CHARS and len(self) < MAX_KEPT:
            self[stretch] = got
        return got

    def trim(self) -> None:
        if len(self) >= MAX_KEPT:
            self.clear()


@lru_cache(maxsize=4)
def load(path: str) -> PieceModel:
    """One model for each worker process."""
    return PieceModel(path)
