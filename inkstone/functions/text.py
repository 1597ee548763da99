"""Text: ideograph statistics, case-blind LIKE, titles, locations, model replies."""

from __future__ import annotations

import json
import re
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Ranges of ideographs. Fixed values.
IDEOGRAPHS = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2B73F}\x{2B740}-\x{2B81F}\x{2B820}-\x{2CEAF}\x{2CEB0}-\x{2EBEF}\x{30000}-\x{3134F}\x{F900}-\x{FAFF}"
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, _UP, _LOW)


def char_count(c: Column, chars: str = IDEOGRAPHS) -> Column:
    """Characters of a class, counted by code point."""
    return F.regexp_count(c, F.lit(f"[{chars}]"))


def unique_char_count(c: Column, chars: str = IDEOGRAPHS) -> Column:
    return F.size(F.array_distinct(F.regexp_extract_all(c, F.lit(f"([{chars}])"), F.lit(1))))


def like(c: Column, pattern: str) -> Column:
    """LIKE that folds ASCII case only; `*` and `%` stand for any run, `_` for one character."""
    folded = pattern.replace("*", "%").translate(str.maketrans(_UP, _LOW))
    return F.like(ascii_lower(c), F.lit(folded), F.lit("\x01"))


def title(content: Column) -> Column:
    """The only `# ` heading of a text; null if there is none or several."""
    found = F.regexp_extract_all(content, F.lit(r"(?m)^# (.+)$"), F.lit(1))
    return F.when(F.size(found) == 1, F.get(found, F.lit(0)))


def without_title(content: Column) -> Column:
    cut = F.regexp_replace(content, r"(?m)^# .+$\n?", "")
    return F.when(title(content).isNotNull(), F.ltrim(F.regexp_replace(cut, r"^\s+", ""))).otherwise(content)


def original_location(digest: Column) -> Column:
    return F.concat_ws("/", F.lit("originals"), F.substring(digest, 1, 2), F.substring(digest, 3, 2), digest)


def extracted_location(location: Column) -> Column:
    last = F.element_at(F.split(location, "/"), -1)
    return F.concat(F.concat_ws("/", F.lit("extracted"), F.substring(last, 1, 2), F.substring(last, 3, 2), last), F.lit(".md"))


def translator_status(translator: Column, own: Column) -> Column:
    t = F.coalesce(translator, F.lit(""))
    return F.when(t == "", "none").when(t.startswith("ai:") | t.startswith("mt:"), "ai").when(t == own, "self").otherwise("other")


def user_type(user: Column) -> Column:
    return F.when(user == "public", "public").when(user.startswith("user:"), "authenticated").otherwise("test")


def percent(done: Column, total: Column) -> Column:
    """Whole per cent, half up; null without a total."""
    return F.when(total > 0, F.floor(100 * done / total + F.lit(0.5)))


def first_filled(*cols: Column) -> Column:
    """The first that is neither null nor empty, the last as it is."""
    return F.coalesce(*(F.when(c != "", c) for c in cols[:-1]), cols[-1])


def utf16_offset(text: Column, code_points: Column) -> Column:
    """A place counted in code points as one counted in UTF-16 units."""
    before = F.substr(text, F.lit(1), code_points)
    return code_points + F.regexp_count(before, F.lit(r"[\x{10000}-\x{10FFFF}]"))


def _repaired(text: str) -> str:
    """Without commas before a closing bracket."""
    return re.sub(r",(\s*[}\]])", r"\1", text)


def _is_json(text: str) -> bool:
    try:
        json.loads(text)
    except ValueError:
        return False
    return True


def last_json_object(reply: str) -> str:
    """The last whole top-level object in a model's reply that is valid JSON; the reply without code fences if there is none.

    Depth is the running sum over the braces' places, whatever strings they stand in: an object goes from a brace that lifts it to one
    to the next that brings it back to none. Candidates are looked at from the last one on."""
    places = [m.start() for m in re.finditer(r"[{}]", reply)]
    depth = list(accumulate(1 if reply[i] == "{" else -1 for i in places))
    ends = [k for k, d in enumerate(depth) if d == 0 and reply[places[k]] == "}"]
    for n in reversed(range(len(ends))):
        at, k = ends[n - 1] if n else -1, ends[n]
        opened = next((j for j in range(at + 1, k) if depth[j] == 1 and reply[places[j]] == "{"), None)
        if opened is not None and _is_json(text := _repaired(reply[places[opened] : places[k] + 1])):
            return text
    bare = re.sub(r"^```(?:json)?\s*|\s*```$", "", reply)
    return _repaired(bare.strip())


@F.pandas_udf(StringType())
def json_object(reply: pd.Series) -> pd.Series:
    return reply.map(lambda x: None if x is None else last_json_object(x))


@F.pandas_udf(StringType())
def word_diff(old: pd.Series, new: pd.Series) -> pd.Series:
    """Word-level difference of two texts as `-gone`, `+new` and ` same` pieces, one per line."""
    import difflib

    def one(a: str, b: str) -> str:
        x, y = re.findall(r"\s+|\S+", a or ""), re.findall(r"\s+|\S+", b or "")
        out = []
        for op, i, j, k, m in difflib.SequenceMatcher(None, x, y, autojunk=False).get_opcodes():
            if op == "equal":
                out.append(" " + "".join(x[i:j]))
            else:
                out += ["-" + "".join(x[i:j])] * (j > i) + ["+" + "".join(y[k:m])] * (m > k)
        return "\n".join(out)

    return pd.Series([one(a, b) for a, b in zip(old, new, strict=True)])
