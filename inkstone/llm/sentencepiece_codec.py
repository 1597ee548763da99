"""SentencePiece encoding and decoding (operator 2).

`encode` gives every document's whole text as ids and the text decoded from them. The work is one narrow pass: no
shuffle, no state beyond a bounded table of stretches in each worker, so a lost task is simply run again.

Nulls count as the empty text, which has no ids and decodes to the empty text. Extra columns are not looked at.
Repeated rows each give a row, rows with a null id too; an empty table gives none. Very long texts need memory in
proportion to their own length only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import by_python, documents
from .pieces import Kept, load

#: Characters of texts whose results are handed on together.
PART = 4_000_000


@lru_cache(maxsize=2)
def _kept(path: str) -> tuple[Kept, Kept]:
    """For stretches: their ids as decimal text, and the bytes that these ids decode to."""
    model = load(path)
    ids = Kept(lambda stretch: ",".join(map(str, model.tokens(stretch)[0])))
    return ids, Kept(lambda stretch: b"".join([model.surface[int(i)] for i in ids[stretch].split(",")]))


def encode(docs: DataFrame, model_path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, ids (array of int) and decoded (both if asked for), n_tokens, ids_sha256, decoded_sha256."""
    names = (["ids", "decoded"] if with_ids else []) + ["n_tokens", "ids_sha256", "decoded_sha256"]
    kind = ("ids array<int>, decoded string, " if with_ids else "") + "n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(pdf: pd.DataFrame) -> Iterator[dict]:
        model = load(model_path)
        ids_of, bytes_of = _kept(model_path)
        id_text, raw_bytes = ids_of.__getitem__, bytes_of.__getitem__
        out: dict[str, list] = {c: [] for c in names}
        size = 0
        for text in pdf["text"]:
            stretches = model.stretches(text)
            ids = ",".join(map(id_text, stretches))
            decoded = model.text_of(b"".join(map(raw_bytes, stretches)))
            out["n_tokens"].append(ids.count(",") + bool(ids))
            out["ids_sha256"].append(hashlib.sha256(ids.encode()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
            if with_ids:
                out["ids"].append(np.array(ids.split(",") if ids else [], np.int32))
                out["decoded"].append(decoded)
            ids_of.trim()
            bytes_of.trim()
            size += len(text)
            if size >= PART:
                yield out
                out, size = {c: [] for c in names}, 0
        if out["n_tokens"]:
            yield out

    return by_python(documents(docs), run, kind)
