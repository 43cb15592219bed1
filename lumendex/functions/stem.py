"""Stemmers: the two English ones, and a light one for other languages by their suffix tables.

Written from the published descriptions of the algorithms. stem(word) of a language, or stemmed(column, language) as a
vectorised function that stems each distinct word of a batch once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


# ---- the 1980 algorithm

def _consonants(w: str) -> list[bool]:
    out: list[bool] = []
    for i, c in enumerate(w):
        out.append(not (c in "aeiou" or c == "y" and i > 0 and out[i - 1]))
    return out


def _measure(w: str) -> int:
    """Vowel runs followed by consonants."""
    c = _consonants(w)
    return sum(1 for a, b in zip(c, c[1:]) if not a and b)


def _has_vowel(w: str) -> bool:
    return not all(_consonants(w))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _consonants(w)[-1]


def _short_end(w: str) -> bool:
    c = _consonants(w)
    return len(w) > 2 and c[-1] and not c[-2] and c[-3] and w[-1] not in "wxy"


# Suffixes of the algorithm's steps.
_PORTER_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize",
    "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
_PORTER_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_PORTER_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _longest(w: str, table) -> str | None:
    return max((s for s in table if w.endswith(s)), key=len, default=None)


def porter(w: str) -> str:
    if len(w) <= 2:
        return w
    for end, to in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(end):
            w = w[: len(w) - len(end)] + to
            break
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and _has_vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif _double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _short_end(w):
                    w += "e"
                break
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (_PORTER_2, _PORTER_3):
        s = _longest(w, table)
        if s and _measure(w[: -len(s)]) > 0:
            w = w[: -len(s)] + table[s]
    s = _longest(w, _PORTER_4)
    if s and _measure(w[: -len(s)]) > 1 and (s != "ion" or w[: -len(s)].endswith(("s", "t"))):
        w = w[: -len(s)]
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _short_end(w[:-1])):
        w = w[:-1]
    if _measure(w) > 1 and w.endswith("ll"):
        w = w[:-1]
    return w


# ---- its successor for English

# Exceptions and suffixes of the algorithm.
_WHOLE = {
    "skis": "ski", "skies": "sky", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news",
    "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_LEAVE = ("inning", "outing", "canning", "herring", "earring", "evening", "proceed", "exceed", "succeed")
_ENGLISH_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al",
    "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful",
    "lessli": "less", "li": "", "ogist": "og",
}
_ENGLISH_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
_ENGLISH_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")
_V = "aeiouy"


def _after_vowel_consonant(w: str, start: int = 0) -> int:
    for i in range(start + 1, len(w)):
        if w[i] not in _V and w[i - 1] in _V:
            return i + 1
    return len(w)


def _short_syllable(w: str) -> bool:
    if w.endswith("past"):
        return True
    if len(w) == 2:
        return w[0] in _V and w[1] not in _V
    return len(w) > 2 and w[-1] not in _V + "wxY" and w[-2] in _V and w[-3] not in _V


def english(w: str) -> str:
    if len(w) <= 2:
        return w
    if w in _WHOLE:
        return _WHOLE[w]
    w = w.removeprefix("'")
    w = "".join("Y" if c == "y" and (i == 0 or w[i - 1] in "aeiou") else c for i, c in enumerate(w))
    head = next((len(p) for p in ("gener", "commun", "arsen", "past", "univers", "later", "emerg", "organ", "inter") if w.startswith(p)), 0)
    r1 = head or _after_vowel_consonant(w)
    r2 = _after_vowel_consonant(w, r1) if r1 < len(w) else len(w)
    for end in ("'s'", "'s", "'"):
        if w.endswith(end):
            w = w[: -len(end)]
            break
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-3] + ("i" if len(w) > 4 else "ie")
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(c in _V for c in w[:-2]):
        w = w[:-1]
    if w.lower() in _LEAVE:
        return w.lower()
    s = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if s in ("eed", "eedly"):
        if len(w) - len(s) >= r1:
            w = w[: -len(s)] + "ee"
    elif s and any(c in _V for c in w[: -len(s)]):
        base = w[: -len(s)]
        if s == "ing" and base.endswith("y") and len(base) == 2 and base[0] not in _V:
            w = base[:-1] + "ie"
        elif base.endswith(("at", "bl", "iz")):
            w = base + "e"
        elif base.endswith(("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")):
            w = base if len(base) == 3 and base[0] in "aeo" else base[:-1]
        elif r1 >= len(base) and _short_syllable(base):
            w = base + "e"
        else:
            w = base
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _V:
        w = w[:-1] + "i"
    s = _longest(w, _ENGLISH_2)
    if s and len(w) - len(s) >= r1:
        base = w[: -len(s)]
        if s == "ogi":
            w = base + "og" if base.endswith("l") else w
        elif s == "li":
            w = base if base.endswith(tuple("cdeghkmnrt")) else w
        else:
            w = base + _ENGLISH_2[s]
    s = _longest(w, _ENGLISH_3)
    if s and len(w) - len(s) >= r1 and (s != "ative" or len(w) - len(s) >= r2):
        w = w[: -len(s)] + _ENGLISH_3[s]
    s = _longest(w, _ENGLISH_4)
    if s and len(w) - len(s) >= r2 and (s != "ion" or w[: -len(s)].endswith(("s", "t"))):
        w = w[: -len(s)]
    if w.endswith("e"):
        if len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short_syllable(w[:-1]):
            w = w[:-1]
    elif w.endswith("l") and len(w) - 1 >= r2 and w.endswith("ll"):
        w = w[:-1]
    return w.lower()


# ---- light stemmers: the longest suffix off, from a region after the first vowel and consonant

# Inflections of each language.
_LIGHT = {
    "french": "issements issement atrices atrice ateurs ateur ations ation logies logie ments ment ances ance ences ence ités ité ives ive ifs if euses euse eux ables able istes iste ismes isme ères ère ier ées ée és er ez aient ais ait ant ants ent ons es s e".split(),
    "german": "ungen ung heiten heit keiten keit lichen licher liches liche lich isch en em ern er es st e s n".split(),
    "spanish": "amientos amiento imientos imiento aciones ación adoras adores adora ador ancias ancia idades idad mente ables able ibles ible istas ista ismos ismo osas osos osa oso ivas ivos iva ivo ando iendo aron ieron aban aba ado ada ados adas ido ida idos idas ar er ir as es os a e o".split(),
    "italian": "azioni azione amenti amento imenti imento atrici atrice atori atore mente abili abile ibili ibile isti iste ista osi ose oso osa ivi ive ivo iva ando endo are ere ire ato ata ati ate uto uta uti ute ito ita iti ite i e a o".split(),
    "portuguese": "amentos amento imentos imento ações ação adoras adores adora ador idades idade mente áveis ável íveis ível istas ista ismos ismo osas osos osa oso ivas ivos iva ivo ando endo indo aram eram iram ado ada ados adas ido ida idos idas ar er ir as es os a e o".split(),
    "dutch": "heden heid ingen ing elijk lijk baar en s e".split(),
    "swedish": "heterna heten heter arna erna orna ande arne aste aren ades erns ade are ern ens het ast ad en ar er or as es at a e s".split(),
    "norwegian": "hetenes hetene hetens heter heten endes ande ende edes enes erte ede ane ene ens ers ets het ast ert en ar er as es et a e s".split(),
    "danish": "erendes erende hedens ethed erede heden heder endes ernes erens erets ered ende erne eren erer heds enes eres eret hed ene ere ens ers ets en er es et e s".split(),
    "finnish": "issa issä ista istä illa illä ilta iltä ille ssa ssä sta stä lla llä lta ltä lle ksi tta ttä ine na nä in en an än a ä i t".split(),
    "hungarian": "okkal ekkel ökkel oknak eknek öknek okban ekben ökben ban ben nak nek val vel ról ről tól től hoz hez höz ért ként okat eket öket ok ek ök at et öt on en ön t k".split(),
    "romanian": "iilor ilor ului elor iile ile ul ii ei ea i e a".split(),
    "russian": "иями ями ами ией иям ием иях ого ему ыми ими его ому ая яя ое ее ые ие ый ий ой ей ов ев ам ям ом ем ах ях ать ять ить ала ила ало ило али или ал ил ет ит ут ют а я о е ы и у ю ь".split(),
    "turkish": "larımız lerimiz ların lerin ları leri lar ler ının inin dan den tan ten da de ta te ın in ı i u ü".split(),
    "catalan": "aments ament acions ació adores adors adora ador itats itat ment ables able ibles ible istes ista ismes isme oses osos osa ós ives ius iva iu ant int ada ades ats at ida ides its it ar er ir es s a e o".split(),
}


def _light(suffixes: list[str], vowels: str = "aeiouyàâäáãåæéèêëíîïìóôöòõøúûüùœаеёиоуыэюяıőű") -> Callable[[str], str]:
    order = sorted(set(suffixes), key=len, reverse=True)

    def stem(w: str) -> str:
        region = next((i + 1 for i in range(1, len(w)) if w[i] not in vowels and w[i - 1] in vowels), len(w))
        least = max(3, region)
        for s in order:
            if w.endswith(s) and len(w) - len(s) >= least:
                return w[: -len(s)]
        return w

    return stem


LANGUAGES: dict[str, Callable[[str], str]] = {"none": lambda w: w, "english": english, "porter": porter, **{k: _light(v) for k, v in _LIGHT.items()}}
ALIASES = {"en": "english", "fr": "french", "de": "german", "es": "spanish", "it": "italian", "pt": "portuguese", "nl": "dutch", "sv": "swedish", "no": "norwegian", "nb": "norwegian", "da": "danish", "fi": "finnish", "hu": "hungarian", "ro": "romanian", "ru": "russian", "tr": "turkish", "ca": "catalan", "": "none"}


@lru_cache(1 << 16)
def stem(word: str, language: str = "english") -> str:
    return LANGUAGES[ALIASES.get(language, language)](word)


def stemmed(word: Column, language: str = "english") -> Column:
    LANGUAGES[ALIASES.get(language, language)]

    @F.pandas_udf(StringType())
    def f(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map({w: stem(w, language) for w in s.dropna().unique()})

    return f(word)
