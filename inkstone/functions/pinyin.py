"""Numbered pinyin as tone marks, zhuyin or Wade-Giles.

Syllables are put together from initials and finals, so a syllable's form follows from a rule and no table of all
syllables is kept. Case matters; unknown syllables stay and get the tone's suffix.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fixed values.
MARKS = {"a": "āáǎàa", "e": "ēéěèe", "i": "īíǐìi", "o": "ōóǒòo", "u": "ūúǔùu", "ü": "ǖǘǚǜü"}
ZHUYIN_TONES = ("", "ˊ", "ˇ", "ˋ", "˙")
WADE_TONES = ("¹", "²", "³", "⁴", "⁵")
ZHUYIN_INITIALS = {"b": "ㄅ", "p": "ㄆ", "m": "ㄇ", "f": "ㄈ", "d": "ㄉ", "t": "ㄊ", "n": "ㄋ", "l": "ㄌ", "g": "ㄍ", "k": "ㄎ", "h": "ㄏ", "j": "ㄐ", "q": "ㄑ", "x": "ㄒ", "zh": "ㄓ", "ch": "ㄔ", "sh": "ㄕ", "r": "ㄖ", "z": "ㄗ", "c": "ㄘ", "s": "ㄙ"}
WADE_INITIALS = {"b": "p", "p": "p'", "m": "m", "f": "f", "d": "t", "t": "t'", "n": "n", "l": "l", "g": "k", "k": "k'", "h": "h", "j": "ch", "q": "ch'", "x": "hs", "zh": "ch", "ch": "ch'", "sh": "sh", "r": "j", "z": "ts", "c": "ts'", "s": "s"}
ZHUYIN_FINALS = {
    "a": "ㄚ", "o": "ㄛ", "e": "ㄜ", "ê": "ㄝ", "ai": "ㄞ", "ei": "ㄟ", "ao": "ㄠ", "ou": "ㄡ", "an": "ㄢ", "en": "ㄣ", "ang": "ㄤ", "eng": "ㄥ", "er": "ㄦ", "ong": "ㄨㄥ",
    "i": "ㄧ", "ia": "ㄧㄚ", "ie": "ㄧㄝ", "iao": "ㄧㄠ", "iu": "ㄧㄡ", "ian": "ㄧㄢ", "in": "ㄧㄣ", "iang": "ㄧㄤ", "ing": "ㄧㄥ", "iong": "ㄩㄥ",
    "u": "ㄨ", "ua": "ㄨㄚ", "uo": "ㄨㄛ", "uai": "ㄨㄞ", "ui": "ㄨㄟ", "uan": "ㄨㄢ", "un": "ㄨㄣ", "uang": "ㄨㄤ", "ueng": "ㄨㄥ",
    "ü": "ㄩ", "üe": "ㄩㄝ", "üan": "ㄩㄢ", "ün": "ㄩㄣ",
}
WADE_FINALS = {
    "a": "a", "o": "o", "e": "ê", "ai": "ai", "ei": "ei", "ao": "ao", "ou": "ou", "an": "an", "en": "ên", "ang": "ang", "eng": "êng", "er": "êrh", "ong": "ung",
    "i": "i", "ia": "ia", "ie": "ieh", "iao": "iao", "iu": "iu", "ian": "ien", "in": "in", "iang": "iang", "ing": "ing", "iong": "iung",
    "u": "u", "ua": "ua", "uo": "o", "uai": "uai", "ui": "ui", "uan": "uan", "un": "un", "uang": "uang", "ueng": "uêng",
    "ü": "ü", "üe": "üeh", "üan": "üan", "ün": "ün",
}
_SYLLABLE = re.compile(r"^(.+?)([1-5])$", re.S)


def _parts(base: str) -> tuple[str, str] | None:
    """Initial and final of a syllable in their underlying spelling; None if it is not one."""
    if base.startswith("y"):
        rest = base[1:]
        final = "ü" + rest[1:] if rest[:1] == "u" else rest if rest[:1] == "i" else {"ou": "iu", "e": "ie", "ong": "iong"}.get(rest, "i" + rest)
        return ("", final) if final in ZHUYIN_FINALS else None
    if base.startswith("w"):
        rest = base[1:]
        final = rest if rest == "u" else {"ei": "ui", "en": "un", "eng": "ueng"}.get(rest, "u" + rest)
        return ("", final) if final in ZHUYIN_FINALS else None
    initial = next((i for i in (base[:2], base[:1]) if i in ZHUYIN_INITIALS), "")
    final = base[len(initial) :]
    if initial in ("j", "q", "x") and final[:1] == "u":
        final = "ü" + final[1:]
    return (initial, final) if final in ZHUYIN_FINALS else None


@lru_cache(maxsize=4096)
def _zhuyin(base: str) -> str:
    parts = _parts(base)
    if parts is None:
        return base
    initial, final = parts
    bare = initial in ("zh", "ch", "sh", "r", "z", "c", "s") and final == "i"
    return ZHUYIN_INITIALS.get(initial, "") + ("" if bare else ZHUYIN_FINALS[final])


@lru_cache(maxsize=4096)
def _wade(base: str) -> str:
    parts = _parts(base)
    if parts is None or parts[1] not in WADE_FINALS:
        return base
    initial, final = parts
    if not initial:
        own = {"i": "i", "in": "yin", "ing": "ying", "iu": "yu", "ie": "yeh", "ian": "yen", "u": "wu", "ui": "wei", "un": "wên", "ueng": "wêng", "uo": "wo"}
        if final in own:
            return own[final]
        f = WADE_FINALS[final]
        return "y" + (f if f[0] == "ü" else f[1:]) if f[0] in "iü" else "w" + f[1:] if f[0] == "u" and final != "ong" else f
    if final == "i" and initial in ("zh", "ch", "sh", "r"):
        return WADE_INITIALS[initial] + "ih"
    if final == "i" and initial in ("z", "c", "s"):
        return {"z": "tzu", "c": "tz'u", "s": "ssu"}[initial]
    if base == "me":
        return base
    if final == "uo" and initial in ("g", "k", "h", "sh"):
        return WADE_INITIALS[initial] + "uo"
    if final == "ui" and initial in ("g", "k"):
        return WADE_INITIALS[initial] + "uei"
    return WADE_INITIALS[initial] + WADE_FINALS[final]


def _marked(syllable: str) -> str:
    m = _SYLLABLE.match(syllable)
    if not m:
        return syllable
    s, tone = m[1].replace("v", "ü"), int(m[2]) - 1
    if tone == 4:
        return s
    at = next((i for i, c in enumerate(s) if c in "ae"), s.find("o") if "ou" in s else max((i for i, c in enumerate(s) if c in MARKS), default=-1))
    return s if at < 0 else s[:at] + MARKS[s[at]][tone] + s[at + 1 :]


def _suffixed(base: Callable[[str], str], tones: tuple[str, ...]) -> Callable[[str], str]:
    def one(syllable: str) -> str:
        m = _SYLLABLE.match(syllable)
        return base(m[1].replace("v", "ü", 1)) + tones[int(m[2]) - 1] if m else syllable

    return one


FORMATS: dict[str, Callable[[str], str]] = {"marked-pinyin": _marked, "zhuyin": _suffixed(_zhuyin, ZHUYIN_TONES), "wade-giles": _suffixed(_wade, WADE_TONES)}


def convert(text: str, form: str) -> str:
    """Unknown forms, and `pinyin`, give the text as it is."""
    one = FORMATS.get(form)
    return text if one is None else " ".join(map(one, text.split(" ")))


def formatted(c: Column, form: str) -> Column:
    @F.pandas_udf(StringType())
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None else convert(v, form))

    return run(c) if form in FORMATS else c


def display_script(query: Column, simplified: Column, traditional: Column, preferred: str) -> tuple[Column, Column]:
    """Which script a headword is shown in and the other one, null if they are equal."""
    main = F.when((query == simplified) & (simplified != traditional), simplified).otherwise(simplified if preferred == "simplified" else traditional)
    other = F.when(main == simplified, traditional).otherwise(simplified)
    return main, F.when(other != main, other)
