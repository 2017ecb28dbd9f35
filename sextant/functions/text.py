"""Words and stems: the tokenizer as an expression, the English stemmer (Porter2) as a pandas UDF."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = r"[\p{L}\p{N}]+"
#: Dropped after stemming.
STOP_WORDS = frozenset("a an as at be by if in is it no of on or to and are but for not the was into such that then they this will with their there these".split())
#: What the tsvector engine drops, before stemming.
FULL_STOP_WORDS = frozenset(
    """i me my we us our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their
    theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the
    and but if or because as until while of at by for with about against between into through during before after above below to from up down in
    out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only
    own same so than too very s t can will just don should now""".split()
) - {"us"}


def tokens(text: Column) -> Column:
    """Lower-cased words in order; null of null."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


_VOWELS = "aeiouy"
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_WHOLE = dict(skis="ski", skies="sky", dying="die", lying="lie", tying="tie", idly="idl", gently="gentl", ugly="ugli", early="earli", only="onli", singly="singl") | {w: w for w in "sky news howe atlas cosmos bias andes".split()}
_AFTER_1A = frozenset("inning outing canning herring earring proceed exceed succeed".split())
_STEP2 = dict(ization="ize", ational="ate", fulness="ful", ousness="ous", iveness="ive", tional="tion", biliti="ble", lessli="less", entli="ent", ation="ate", alism="al", aliti="al", ousli="ous", iviti="ive", fulli="ful", enci="ence", anci="ance", abli="able", izer="ize", ator="ate", alli="al", bli="ble")
_STEP3 = dict(ational="ate", tional="tion", alize="al", icate="ic", iciti="ic", ical="ic", ness="", ful="")
_STEP4 = "ement ance ence able ible ment ant ent ism ate iti ous ive ize al er ic".split()


def _regions(w: str) -> tuple[int, int]:
    def after(start: int) -> int:
        m = re.compile(f"[{_VOWELS}][^{_VOWELS}]").search(w, start)
        return m.end() if m else len(w)

    m = re.match("gener|commun|arsen", w)
    r1 = m.end() if m else after(0)
    return r1, after(r1)


def _ends_short(w: str) -> bool:
    return bool(re.fullmatch(f"[{_VOWELS}][^{_VOWELS}]", w) or re.search(f"[^{_VOWELS}][{_VOWELS}][^{_VOWELS}wxY]$", w))


@functools.lru_cache(maxsize=1 << 17)
def stem(word: str) -> str:
    """Porter2 of a lower-case word, by its published steps."""
    if len(word) <= 2:
        return word
    if word in _WHOLE:
        return _WHOLE[word]
    w = word.lstrip("'")
    w = re.sub(f"^y|(?<=[{_VOWELS}])y", "Y", w)
    r1, r2 = _regions(w)
    for end in ("'s'", "'s", "'"):
        if w.endswith(end):
            w = w[: -len(end)]
            break
    # 1a
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(f"[{_VOWELS}].", w[:-1]):
        w = w[:-1]
    if w in _AFTER_1A:
        return w.replace("Y", "y")
    # 1b
    for end in ("eedly", "eed", "ingly", "edly", "ing", "ed"):
        if not w.endswith(end):
            continue
        at = len(w) - len(end)
        if end.startswith("eed"):
            w = w[:at] + "ee" if at >= r1 else w
        elif re.search(f"[{_VOWELS}]", w[:at]):
            w = w[:at]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif w.endswith(_DOUBLES):
                w = w[:-1]
            elif r1 >= len(w) and _ends_short(w):
                w += "e"
        break
    # 1c
    if re.search(f".[^{_VOWELS}][yY]$", w):
        w = w[:-1] + "i"
    # 2
    ends = [e for e in (*_STEP2, "ogi", "li") if w.endswith(e)]
    if ends:
        end = max(ends, key=len)
        at = len(w) - len(end)
        if at >= r1:
            if end in _STEP2:
                w = w[:at] + _STEP2[end]
            elif end == "ogi":
                w = w[:-1] if w[:at].endswith("l") else w
            elif w[at - 1 : at] in tuple("cdeghkmnrt"):
                w = w[:at]
    # 3
    ends = [e for e in (*_STEP3, "ative") if w.endswith(e)]
    if ends:
        end = max(ends, key=len)
        at = len(w) - len(end)
        if end == "ative":
            w = w[:at] if at >= r2 else w
        elif at >= r1:
            w = w[:at] + _STEP3[end]
    # 4
    ends = [e for e in (*_STEP4, "ion") if w.endswith(e)]
    if ends:
        end = max(ends, key=len)
        at = len(w) - len(end)
        if at >= r2 and (end != "ion" or w[:at].endswith(("s", "t"))):
            w = w[:at]
    # 5
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _ends_short(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


#: Words that are stemmed at once, about.
SLICE_WORDS = 1 << 18


def _mapped(lists: pa.Array, f: Callable[[str], str | None]) -> pa.Array:
    """Lists of words with ``f`` of each, without those of which it is None; null of null."""
    words = lists.flatten().dictionary_encode(null_encoding="encode")
    codes = words.indices.to_numpy(zero_copy_only=False)
    found = pa.array([None if w is None else f(w) for w in words.dictionary.to_pylist()], pa.string())
    there = pc.is_valid(found).to_numpy(zero_copy_only=False)[codes]
    lengths = pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(there)])[np.concatenate([[0], np.cumsum(lengths)])]
    return pa.ListArray.from_arrays(pa.array(before.astype(np.int32)), found.take(pa.array(codes[there])), mask=pc.is_null(lists))


def stem_array(text: Column, engine: str = "rust", strategy: str = "english", user_stop_words: Iterable[str] | None = None) -> Column:
    """Stems of a text's words, without stop words; null of null.

    Engine "rust" drops its stop words after stemming; "tsvector" drops the longer list before, as do the
    user's own words in both (``user_stop_words``; without that, those that ``set_user_stop_words`` gave the
    session); its strategy "simple" neither stems nor drops any but those.
    """
    if engine not in ("rust", "tsvector"):
        raise ValueError(f"invalid engine: {engine}")
    if strategy not in ("english", "simple"):
        raise ValueError(f"invalid strategy: {strategy}")
    if user_stop_words is None:
        spark = SparkSession.getActiveSession()
        user_stop_words = (spark.conf.get(_STOPS, "") or "").split("\n") if spark else ()
    own = frozenset(x.lower() for x in user_stop_words if x)
    if engine == "tsvector" and strategy == "simple":
        return F.filter(tokens(text), lambda x: ~x.isin(*own)) if own else tokens(text)

    def kept(word: str) -> str | None:
        """The stem, or None of a stop word."""
        if word in own or (engine == "tsvector" and word in FULL_STOP_WORDS):
            return None
        found = stem(word)
        return None if engine == "rust" and found in STOP_WORDS else found

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def run(lists: pa.Array) -> pa.Array:
        # in slices, so that no more than one's words are held; each different word is stemmed once
        ends = np.concatenate([[0], np.cumsum(pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False))])
        parts, a = [], 0
        while a < len(lists):
            b = max(a + 1, int(np.searchsorted(ends, ends[a] + SLICE_WORDS, "right")) - 1)
            parts.append(_mapped(lists.slice(a, b - a), kept))
            a = b
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.string()))

    return run(tokens(text))


def ordered_string(words: Column) -> Column:
    """The words of an array as one text, in order."""
    return F.concat_ws(" ", words)


_STOPS = "sextant.text.stopwords"


def set_user_stop_words(spark: SparkSession, words: Iterable[str] | None) -> None:
    """Replaces the session's own stop words; None clears them."""
    spark.conf.set(_STOPS, "\n".join(words or ()))


def user_stop_words(spark: SparkSession) -> DataFrame:
    """The session's own stop words: one column, ``stopword``."""
    words = [(x,) for x in (spark.conf.get(_STOPS, "") or "").split("\n") if x]
    return spark.createDataFrame(words, "stopword string")
