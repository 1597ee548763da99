"""Token counts at every prefix (operator 5).

`PrefixCounts` holds, for one text, the exact number of tokens of each prefix: one running total for each stretch that
no token crosses, and inside a stretch its own prefix table (see `pieces`), filled from left to right: the number of a
prefix is one more than that of the prefix before its last token. Ids are never recovered: the total is the last entry of
the table, and truncation and budget questions are answered from it without a second encoding. `count` is the narrow pass
over a table; it needs no shuffle.

Nulls count as the empty text, which has no tokens. Repeated rows each give a row, rows with a null id too; an empty table
gives none; extra columns are not looked at. Very long texts need memory in proportion to their own length. Of prefixes with
equally many tokens the longest counts for a budget.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Mapping, Sequence
from functools import lru_cache
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_python, documents
from .pieces import Kept, PieceModel, load

Table = Sequence[int]


def table(model: PieceModel, stretch: str) -> Table:
    """Tokens of every prefix of the stretch, the empty one first; as bytes if they are small."""
    counts = model.table(stretch)[1]
    return bytes(counts) if max(counts) < 256 else counts


class PrefixCounts:
    """Number of tokens of every prefix of a text. Prefixes are counted in code points."""

    def __init__(self, model: PieceModel, text: str, tables: Mapping[str, Table] | None = None) -> None:
        """tables: prefix tables of stretches, if kept elsewhere."""
        self.text = text
        parts = model.stretches(text)
        own = (lambda x: table(model, x)) if tables is None else tables.__getitem__
        #: Prefix table of each stretch, and the tokens up to it.
        self.inside = list(map(own, parts))
        self.totals = [0, *accumulate([x[-1] for x in self.inside])]

    def _starts(self) -> list[int]:
        """Code points (of the text with its dummy space) up to each stretch."""
        return [0, *accumulate([len(x) - 1 for x in self.inside])]

    def at(self, n_chars: int) -> int:
        """Tokens of the first n_chars code points, as encoding just them would give."""
        if n_chars <= 0 or not self.inside:
            return 0
        x, starts = min(n_chars, len(self.text)) + 1, self._starts()
        k = bisect_right(starts, x) - 1
        return self.totals[k] + (self.inside[k][x - starts[k]] if k < len(self.inside) else 0)

    def total(self) -> int:
        return self.totals[-1]

    def fit(self, budget: int) -> int:
        """The longest prefix, in code points, of which neither it nor a shorter one has more tokens than the budget."""
        if budget >= 4 * len(self.text) + 1:  # a code point is four tokens at most
            return len(self.text)
        k, length = 0, 0
        for k, counts in enumerate(self.inside):
            left = budget - self.totals[k]
            if max(counts) > left:
                return max(0, length + next(j for j, c in enumerate(counts) if c > left) - 2)
            length += len(counts) - 1
        return len(self.text)


@lru_cache(maxsize=2)
def _tables(path: str) -> Kept:
    model = load(path)
    return Kept(lambda stretch: table(model, stretch))


def count(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, fit_chars: the length of the longest prefix within the limit."""

    def run(pdf: pd.DataFrame) -> Iterator[dict]:
        model, tables = load(model_path), _tables(model_path)
        n_bytes, n_tokens, fit_chars = [], [], []
        for text in pdf["text"]:
            counts = PrefixCounts(model, text, tables)
            n_bytes.append(len(text.encode()))
            n_tokens.append(counts.total())
            fit_chars.append(counts.fit(limit))
            tables.trim()
        yield {"n_bytes": n_bytes, "n_tokens": n_tokens, "fit_chars": fit_chars}

    out = by_python(documents(docs), run, "n_bytes long, n_tokens long, fit_chars long")
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "fit_chars")
