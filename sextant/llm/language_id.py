"""Language ID by Bayesian fusion of a page's evidence.

A naive Bayes model of character trigrams gives the likelihood of the text in each language. Summed over all
pages by Spark, what the texts say gives the rest: how often a language's pages declare each markup language,
and how the languages are spread on each host, smoothed towards the host's address suffix, and that towards
all pages. A page's own text is left out of its host's and suffix's counts, so it doesn't count twice.

The sums are joined back by declared language, suffix and host; nothing but the text model, whose size is
fixed, is broadcast.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import char_classes, code_points, cut, map_batches, mix, slices

#: Labelled documents that the text model uses at most, chosen by a hash of doc_id.
SAMPLE_ROWS = 10_000
#: Trigrams are counted in 2**BITS places.
BITS = 16
#: Weight of a trigram's log-likelihood, since neighbouring ones say much the same.
TEMPER = 0.2
#: Pages that a prior weighs as much as.
STRENGTH = 10.0
_OPEN = re.compile(r"<(?:(script)|style)\b", re.I)
_CLOSE = {True: re.compile(r"</script\s*>", re.I), False: re.compile(r"</style\s*>", re.I)}
_ENTITY = re.compile(r"&[#\w]{1,30};")
_HTML = re.compile(r"<html\b", re.I)
_LANG = re.compile(r"\blang\s*=\s*[\"']?\s*([a-z]{2,8})", re.I)
#: Characters of a page that one numpy pass works on.
_CHARS = 1 << 18


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # log-likelihoods by trigram and language


def _trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Row and place of every trigram that holds a letter, in order of rows; texts are set apart. A long text is taken in parts."""
    texts = [x.lower() for x in texts]
    rows, places = [], []

    def take(points: np.ndarray, row: np.ndarray) -> None:
        word = char_classes()[points] > 0
        points = np.where(word, points, np.uint32(32)).astype(np.uint64)
        if len(points) >= 3:
            keys = points[:-2] << np.uint64(42) | points[1:-1] << np.uint64(21) | points[2:]
            keep = np.flatnonzero(word[1:-1] | (word[:-2] & word[2:]))
            rows.append(row[keep + 1])
            places.append((mix(keys[keep]) >> np.uint64(64 - BITS)).astype(np.int64))

    for a, b in slices(texts, _CHARS):
        if b - a == 1:
            text = f" {texts[a]} "
            for i in range(0, max(1, len(text) - 2), _CHARS):  # a part's last two characters are the next one's first
                points = code_points(text[i : i + _CHARS + 2])
                take(points, np.full(len(points), a))
        else:
            sizes = np.fromiter((len(x) + 3 for x in texts[a:b]), np.int64, b - a)
            points = code_points(" " + " \x00 ".join(texts[a:b]) + " ")
            take(points, np.repeat(np.arange(a, b), sizes)[: len(points)])
    return np.concatenate([*rows, np.zeros(0, np.int64)]), np.concatenate([*places, np.zeros(0, np.int64)])


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, smoothing: float = 0.5) -> Model | None:
    """The text model of ``doc_id, text, lang``; null and empty languages, null texts and ids don't count. None without a language."""
    known = docs.where("doc_id is not null and lang is not null and trim(lang) <> ''")
    ids = known.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).distinct()
    sample = known.select("doc_id", F.lower(F.trim("lang")).alias("lang"), "text").where("text is not null").join(F.broadcast(ids), "doc_id").select("lang", "text")

    def count(batches):
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in slices(texts):
                row, place = _trigrams(texts[a:b])
                names, which = np.unique(langs[a:b], return_inverse=True)
                for k, name in enumerate(names):
                    totals = np.bincount(place[which[row] == k], minlength=1 << BITS)
                    used = np.flatnonzero(totals)
                    yield [pa.array([str(name)] * len(used), pa.string()), used.astype(np.int32), totals[used]]

    found = map_batches(sample, count, "lang string, place int, n long").groupBy("lang", "place").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(found["lang"].to_pylist()))
    if not languages:
        return None
    counts = np.full((1 << BITS, len(languages)), smoothing)
    which = np.array([languages.index(x) for x in found["lang"].to_pylist()])
    counts[found["place"].to_numpy(), which] += found["n"].to_numpy()
    return Model(languages, np.log(counts / counts.sum(0)).astype(np.float32))


def visible(html: str) -> str:
    """The text between tags, comments, scripts and styles; in one pass, however they are nested or left open.

    What isn't closed counts as a tag up to the next >, and where there is none as text.
    """
    out, at = [], 0
    absent: set[str] = set()  # what doesn't come any more
    while (start := html.find("<", at)) >= 0:
        out.append(html[at:start])
        end = -1
        if html.startswith("<!--", start):
            if "-->" not in absent:
                end = html.find("-->", start + 4) + 3
                if end < 3:
                    absent.add("-->")
                    end = -1
        elif m := _OPEN.match(html, start):
            kind = m.group(1) is not None
            if str(kind) not in absent:
                if close := _CLOSE[kind].search(html, m.end()):
                    end = close.end()
                else:
                    absent.add(str(kind))
        if end < 0:
            end = html.find(">", start + 1) + 1
            if not end:
                at = start
                break
        out.append(" ")
        at = end
    return _ENTITY.sub(" ", "".join([*out, html[at:]]))


def declared_language(html: str) -> str:
    """The ``lang`` of the first html tag, in lower case; "" without one."""
    tag = _HTML.search(html)
    end = html.find(">", tag.end()) if tag else -1
    found = _LANG.search(html, tag.end(), end) if end >= 0 else None
    return found.group(1).lower() if found else ""


def likelihoods(texts: list[str], model: Model) -> np.ndarray:
    """Tempered log-likelihood of each text in each language, less the largest; all 0 without a letter."""
    out = np.zeros((len(texts), len(model.languages)))
    for a, b in slices(texts):
        row, place = _trigrams(texts[a:b])
        if len(row):
            for k in range(len(model.languages)):
                out[a:b, k] = np.bincount(row, model.table[place, k], b - a)
    out *= TEMPER
    return out - out.max(1, keepdims=True)


def identify(pages: DataFrame, docs: DataFrame, sample_rows: int = SAMPLE_ROWS, strength: float = STRENGTH) -> DataFrame:
    """``page_id, lang, probability`` for every row of ``pages``; the text model is trained on ``docs``.

    Evidence that is missing (a null or empty page, no declared language, no host) says nothing: that part
    counts as a group of its own. Of equally likely languages the first by name wins. Repeated rows each get
    a result and each count for the host. Without a labelled document, lang and probability are null. ids that
    aren't whole numbers raise an error; other columns, whatever they are called, aren't read.
    """
    model = train(docs, sample_rows)
    if model is None:
        return pages.select(F.col("page_id").cast("long").alias("page_id"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("probability"))
    n = len(model.languages)
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def read(batches):
        for batch in batches:
            html = [x or "" for x in batch.column(2).to_pylist()]
            declared = [declared_language(x) for x in html]
            logs = likelihoods([visible(x) for x in html], shared.value)
            yield [batch.column(0), batch.column(1), pa.array(declared), pa.array(list(logs), pa.list_(pa.float64()))]

    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), F.col("html").cast("string").alias("html"))
    rows = cut(map_batches(rows, read, "page_id long, host string, declared string, logs array<double>"))
    likely = [F.exp(F.col("logs")[i]) for i in range(n)]
    whole = sum(likely[1:], likely[0])
    rows = rows.select("*", F.regexp_extract("host", r"([^.]*)$", 1).alias("suffix"), *[(x / whole).alias(f"p{i}") for i, x in enumerate(likely)])
    sums = lambda tag: [F.sum(f"p{i}").alias(f"{tag}{i}") for i in range(n)]
    by_host = rows.groupBy("host").agg(*sums("h"), F.count(F.lit(1)).alias("h"))
    by_suffix = rows.groupBy("suffix").agg(*sums("s"), F.count(F.lit(1)).alias("s"))
    by_declared = rows.groupBy("declared").agg(*sums("d"))
    of_all = rows.agg(*sums("g"), F.count(F.lit(1)).alias("g"), F.countDistinct("declared").alias("kinds"))
    joined = rows.join(by_host, "host").join(by_suffix, "suffix").join(by_declared, "declared").crossJoin(F.broadcast(of_all))

    def posterior(i: int) -> Column:
        c = lambda tag: F.greatest(F.col(f"{tag}{i}") - F.col(f"p{i}"), F.lit(0.0)) if tag in "hs" else F.col(f"{tag}{i}")
        overall = (c("g") + 1.0) / (F.col("g") + n)
        suffix = (c("s") + strength * overall) / (F.col("s") - 1 + strength)
        prior = (c("h") + strength * suffix) / (F.col("h") - 1 + strength)
        declared = (c("d") + 1.0) / (c("g") + F.col("kinds"))
        return F.col("logs")[i] + F.log(prior) + F.when(F.col("declared") == "", 0.0).otherwise(F.log(declared))

    scored = joined.select("page_id", F.array(*[posterior(i) for i in range(n)]).alias("z"))
    top = F.array_max("z")
    total = F.aggregate("z", F.lit(0.0), lambda s, x: s + F.exp(x - F.array_max("z")))
    names = F.array(*[F.lit(x) for x in model.languages])
    return scored.select("page_id", F.element_at(names, F.array_position("z", top).cast("int")).alias("lang"), (1 / total).alias("probability"))
