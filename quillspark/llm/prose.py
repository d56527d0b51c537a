"""Per-document text quality statistics and their robust Mahalanobis distance from prose.

A text is read as units (a block between blank lines; within one, items that a list mark begins stay apart from
running text). For every unit the statistics below are taken. Per language, the centre and covariance of prose are
estimated over all units of all documents: from the coordinate-wise median and quartiles, by concentration steps
that keep the units within a distance and estimate again (a distributed form of the minimum covariance
determinant). A unit's squared distance splits into one contribution per statistic; a document's figures are the
means over its units, weighted by characters, and its ``outlying_share`` is the share of its characters in units
farther from prose than ``CUTOFF``.

Standard deviations have a floor: layout (wrapped lines, no punctuation, capitals) may differ freely among prose,
so that a sample in which it hardly varies can't make it decisive.

Defined results: null, empty and blank texts have zero words, null statistics, and are never outlying. The word list
must be small (``MAX_WORDS``), which is checked. Unknown or odd language tags fall back to the words found.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.session import materialize

STATS = ("mean_word_length", "symbol_ratio", "digit_ratio", "line_punctuation", "common_words", "letter_words", "words_per_line")
#: Least standard deviation of each statistic among prose.
FLOORS = np.array([0.7, 0.025, 0.03, 0.5, 0.07, 0.07, 1.0])
#: Squared distance beyond which a unit isn't prose; steps of the estimate; least words of a unit that takes part in it.
CUTOFF, STEPS, FIT_WORDS, MAX_WORDS = 20.0, 3, 8, 100_000
_WORD, _DIGIT = re.compile(r"[^\W_]+"), re.compile(r"\d")
_ITEM = re.compile(r"\s*(?:[-*+•|>#]|\d{1,3}[.)]\s|\[|\{)")
_END = (".", "!", "?", "…", ":", ";", '."', '.”', ".»", ".)")


def units(text: str) -> list[list[str]]:
    """The units of a text, each as its non-blank lines."""
    out: list[list[str]] = []
    cur: list[str] = []
    was = None
    for line in text.replace("\r\n", "\n").split("\n"):
        if not line.strip():
            cur = []
            was = None
            continue
        item = _ITEM.match(line) is not None
        if not cur or item != was:
            cur = []
            out.append(cur)
        cur.append(line)
        was = item
    return out


def statistics(lines: list[str], common: dict[str, int], n_langs: int) -> tuple[list[float], int, list[int]]:
    """Statistics of a unit (that of common words left at zero), its number of words, and the common words of each language."""
    text = "\n".join(lines)
    words = _WORD.findall(text.lower())
    n, size = len(words), max(1, len("".join(text.split())))
    alnum = sum(map(len, words))
    digits = len(_DIGIT.findall(text))
    masks = bytes(map(common.get, words, repeat(0)))
    hits = [0] * n_langs
    for v in set(masks):
        if v:
            k = masks.count(v)
            for j in range(n_langs):
                if v >> j & 1:
                    hits[j] += k
    ended = sum(x.rstrip().endswith(_END) for x in lines)
    letters = sum(map(str.isalpha, words))
    return [alnum / n if n else 0.0, (size - alnum) / size, digits / size, ended / len(lines), 0.0, letters / n if n else 0.0, float(np.log1p(n / len(lines)))], n, hits


def _unit_rows(common: dict[str, int], langs: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):  # bounds what a task holds
                ids, lang_of, chars, words, stats = [], [], [], [], []
                part = b.slice(at, 1024)
                for i, (text, tag) in enumerate(zip(part.column("text").to_pylist(), part.column("lang").to_pylist())):
                    own = [(statistics(u, common, len(langs)), sum(map(len, u))) for u in units(text or "")]
                    if not own:
                        continue
                    total = np.sum([h for (_, _, h), _ in own], axis=0)
                    primary = (tag or "").lower().split("-")[0]
                    lang = int(total.argmax()) if total.max() > 0 else langs.index(primary) if primary in langs else 0
                    for (s, n, hits), size in own:
                        s[4] = hits[lang] / n if n else 0.0
                        ids.append(i)
                        lang_of.append(lang)
                        chars.append(size)
                        words.append(n)
                        stats.append(s)
                flat = np.asarray(stats, dtype=np.float32).reshape(-1)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(ids, pa.int64())), pa.array(lang_of, pa.int32()), pa.array(chars, pa.int64()), pa.array(words, pa.int64()), pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * len(STATS)), pa.array(flat))],
                    ["doc_id", "lang_no", "chars", "words", "stats"],
                )

    return run


def unit_table(docs: DataFrame, common_words: DataFrame) -> tuple[DataFrame, list[str]]:
    rows = common_words.select("lang", "word").distinct().limit(MAX_WORDS + 1).collect()
    if len(rows) > MAX_WORDS:
        raise ValueError("the list of common words is not small")
    langs = sorted({r.lang for r in rows if r.lang}) or ["en"]
    if len(langs) > 8:
        raise ValueError("more than eight languages")
    common: dict[str, int] = {}
    for r in rows:
        if r.lang and r.word:
            common[r.word] = common.get(r.word, 0) | 1 << langs.index(r.lang)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")
    return src.mapInArrow(_unit_rows(common, langs), "doc_id long, lang_no int, chars long, words long, stats array<float>"), langs


def _matrix(col: pa.Array) -> np.ndarray:
    return np.asarray(col.flatten(), dtype=np.float64).reshape(-1, len(STATS))


class Model:
    """Centre and precision of prose for each language."""

    def __init__(self, centre: np.ndarray, precision: np.ndarray):
        self.centre, self.precision = centre, precision

    def contributions(self, x: np.ndarray, lang: np.ndarray) -> np.ndarray:
        """Each statistic's part of the squared distance; a row's parts add up to it."""
        z = x - self.centre[lang]
        return z * np.einsum("nj,njk->nk", z, self.precision[lang])


def _with_floor(cov: np.ndarray) -> np.ndarray:
    """The covariance with standard deviations of at least their floors; correlations as they are."""
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    corr = np.clip(cov / np.outer(sd, sd), -0.9, 0.9)
    corr[np.diag_indices(len(sd))] = 1.0
    vals, vecs = np.linalg.eigh(corr)
    corr = (vecs * np.maximum(vals, 0.1)) @ vecs.T
    wide = np.maximum(sd, FLOORS)
    return corr * np.outer(wide, wide)


def fit(table: DataFrame, n_langs: int) -> Model:
    """The model from all units with enough words. What reaches the driver is a few dozen sums per language."""
    d = len(STATS)
    usable = table.filter(F.col("words") >= FIT_WORDS)
    q = usable.groupBy("lang_no").agg(*(F.percentile_approx(F.col("stats")[i], [0.25, 0.5, 0.75], 2000).alias(f"q{i}") for i in range(d))).collect()
    centre, cov = np.zeros((n_langs, d)), np.tile(np.diag(FLOORS**2), (n_langs, 1, 1))
    for r in q:
        quart = np.array([r[f"q{i}"] for i in range(d)])
        centre[r.lang_no] = quart[:, 1]
        cov[r.lang_no] = np.diag(np.maximum((quart[:, 2] - quart[:, 0]) / 1.349, FLOORS) ** 2)
    for _ in range(STEPS):
        model = Model(centre, np.linalg.inv(cov))

        def sums(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
            total = np.zeros((n_langs, 1 + d + d * d))
            for b in batches:
                x, lang = _matrix(b.column("stats")), np.asarray(b.column("lang_no"))
                near = model.contributions(x, lang).sum(1) <= CUTOFF
                for v in range(n_langs):
                    own = x[near & (lang == v)]
                    total[v] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
            n, width = total.shape
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(n), width), pa.int32()), pa.array(np.tile(np.arange(width), n), pa.int32()), pa.array(total.ravel())], ["lang_no", "at", "v"])

        got = usable.select("lang_no", "stats").mapInArrow(sums, "lang_no int, at int, v double").groupBy("lang_no", "at").agg(F.sum("v").alias("v")).collect()
        total = np.zeros((n_langs, 1 + d + d * d))
        for r in got:
            total[r.lang_no, r.at] = r.v
        for v in range(n_langs):
            if (n := total[v, 0]) > 10 * d:
                centre[v] = total[v, 1 : 1 + d] / n
                cov[v] = _with_floor(total[v, 1 + d :].reshape(d, d) / n - np.outer(centre[v], centre[v]))
    known = [v for v in range(n_langs) if cov[v].any() and centre[v].any()]
    for v in range(n_langs):
        if v not in known and known:  # a language without units takes the first one's
            centre[v], cov[v] = centre[known[0]], cov[known[0]]
    return Model(centre, np.linalg.inv(cov))


def quality_statistics(docs: DataFrame, common_words: DataFrame) -> DataFrame:
    """One row per document: word count, the statistics, squared distance, each statistic's contribution, and the outlying share."""
    made, langs = unit_table(docs, common_words)
    table = materialize(made, "prose-units")
    model = fit(table, len(langs))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = model.contributions(_matrix(b.column("stats")), np.asarray(b.column("lang_no")))
            c = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * c.shape[1]), pa.array(c.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, c], [*b.schema.names, "parts"])

    scored = table.mapInArrow(score, "doc_id long, lang_no int, chars long, words long, stats array<float>, parts array<double>")
    w = F.col("chars")
    mean = lambda col, i, to: (F.sum(F.col(col)[i].cast("double") * w) / F.sum(w)).alias(to)
    d2 = F.aggregate("parts", F.lit(0.0), lambda a, x: a + x)
    per_doc = scored.groupBy("doc_id").agg(
        F.sum("words").alias("word_count"),
        *(mean("stats", i, s) for i, s in enumerate(STATS)),
        *(mean("parts", i, f"from_{s}") for i, s in enumerate(STATS)),
        (F.sum(d2 * w) / F.sum(w)).alias("distance_squared"),
        (F.sum(F.when(d2 > CUTOFF, w).otherwise(0)) / F.sum(w)).alias("outlying_share"),
    )
    return docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(per_doc, "doc_id", "left").fillna({"word_count": 0, "outlying_share": 0.0})


def not_prose(docs: DataFrame, common_words: DataFrame, share: float = 0.5) -> DataFrame:
    """(doc_id) of the documents with more than ``share`` of their characters outside of prose."""
    return quality_statistics(docs, common_words).filter(F.col("outlying_share") > share).select("doc_id")
