"""Repairing the text of scanned pages.

Running headers, footers and page numbers are told by their place at a page's edge and a type size below the file's
body, or, where the size is missing, by recurring on the file's other pages. What is left is decoded line by line:
a path through a line's words takes a token as it stands, as a confusion of another word, as two fused words, or
together with the next one as one word that was split. Halves of a word broken at a line's end are joined to one word of the stream, with the hyphen where compounds are
counted more often than the word, and decoded like the others; a misreading is charged to the line that holds its half. A path's cost is the sum of its words' negative log shares in the
lines' own vocabulary and of the penalties of its repairs. Paragraphs are the cheapest cut of a page's lines by
dynamic programming over line gaps, line lengths and sentence ends.

Scale: the vocabulary is a table. Candidate repairs are made once per distinct word, looked up by joins, and travel to the lines they
occur in; a task decodes one line. The confusions of a word over SHORT signs aren't spelled out, as their number times their length grows with the square of the word's:
they are tried as hashes against the words of the same form (FORM), which every confusion leaves as it is. Fused words come from the neighbours that are
read and from the words frequent enough to be fused unread. All letter counts that a confusion can touch reach the driver; the alphabet bounds their number. Windows run within a page; what crosses a page is a join.

Defined results: null and empty texts are no case and have no words. A page scanned twice is two copies, each with its own lines.
A null size is neither small nor large. Lines of a null path form one file.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.session import materialize

#: Share of the body's size below which type is furniture; least share of a file's pages on which an edge line recurs.
SMALL, RECURS = 0.93, 0.34
#: Penalties (natural logarithms) of a confusion, of fused words and of a split word; lead of letters needed without the vocabulary.
CONFUSED, FUSED, SPLIT, LETTERS = 5.0, 5.0, 4.5, 8.0
#: Words up to this length have all their confusions spelled out; the confusions of longer ones are tried as hashes.
SHORT = 40
#: At most this share of a word's readings is one certain misreading of it.
MISREAD = 0.04
MARKS = r"\-‐¬­"  # for character classes: hyphens, the not sign, the soft hyphen

# What scanning takes for what (printed, read).
CONFUSIONS = (
    ("a", "@"), ("l", "|"), ("l", "1"), ("i", "1"), ("o", "0"), ("e", "c"), ("s", "5"), ("g", "9"), ("b", "6"), ("b", "8"), ("h", "b"), ("t", "f"), ("n", "ri"), ("m", "rn"), ("d", "cl"), ("w", "vv"),
    ("u", "ii"), ("i", "ï"), ("i", "î"), ("i", "l"), ("l", "i"), ("c", "e"), ("f", "t"), ("b", "h"), ("rn", "m"), ("cl", "d"), ("n", "u"), ("u", "n"), ("q", "g"), ("z", "2"),
)
NOISE = CONFUSIONS[:18]  # kinds that leave signs or letters seldom printed
#: Signs by what stands for their kind: what was printed and what was read have the same form.
FORM = {"@": "a", "c": "e", "0": "o", "5": "s", "9": "g", "q": "g", "6": "b", "8": "b", "h": "b", "f": "t", "2": "z", "|": "l", "1": "l", "i": "l", "ï": "l", "î": "l", "r": "l", "n": "ll", "u": "ll", "m": "lll", "d": "el", "w": "vv"}
_CONFUSED_SIGNS = "[" + "".join(sorted({re.escape(c) for pair in CONFUSIONS for side in pair for c in side})) + "]"
_PRIME, _RADIX = (1 << 61) - 1, 1_140_071_481_932_319_848
_SURE = re.compile(r"[^\W\d_][|·°~^@][^\W_]|[^\W\d_]?[|·°~^@][^\W\d_]|[^\W\d_][|·°~^@](?:\W|$)")
_GLUED = re.compile(r"[^\W\d_]{2}[,;.!?][^\W\d_]{2}(?!\.)")
_SPACED = re.compile(r"(?:(?<=\s)|^)(?:[^\W_]\s){2,}[^\W_](?=[\s.,;:!?]|$)")
_OPEN = re.compile(rf"([^\s{MARKS}]*(?:-[^\s{MARKS}]+)*?[^\W\d_])([{MARKS}])\s*$")
_TOKEN = re.compile(rf"[^\s{MARKS}_/()\[\]\"“”„«».,:;!?…]+")
_LETTERS = re.compile(r"[^\W\d_]")
_PAGE_NO = r"(?i)^\W*(?:(?:page|seite|página|pagina|p\.|s\.)\s*)?(?:[\dlIoO|]{1,5}|[ivxlc]{1,7})(?:\s*(?:/|of|von|de|sur)\s*[\dlIoO|]{1,5})?\W*$"


def _lines(pdf_lines: DataFrame) -> DataFrame:
    """The lines with ``copy``, ``furniture`` and, for text lines, the text before and after."""
    d = pdf_lines.select("line_id", F.coalesce("source_path", F.lit("")).alias("source_path"), "page_no", "line_no", F.coalesce("text", F.lit("")).alias("text"), "font_size", "bold", "baseline")
    d = d.withColumn("copy", F.row_number().over(Window.partitionBy("source_path", "page_no", "line_no").orderBy("line_id")))
    body = d.groupBy("source_path").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY font_size)").alias("body"), F.countDistinct("page_no").alias("pages"))
    edge = d.groupBy("source_path", "page_no").agg(F.min("line_no").alias("_first"), F.max("line_no").alias("_last"))
    d = d.join(body, "source_path").join(edge, ["source_path", "page_no"])
    d = d.withColumn("small", F.coalesce(F.col("font_size") < SMALL * F.col("body"), F.lit(False)))
    d = d.withColumn("place", F.when(F.col("line_no") - F.col("_first") <= 1, F.lit("top")).when(F.col("_last") - F.col("line_no") <= 1, F.lit("bottom")))
    d = d.withColumn("form", F.trim(F.regexp_replace(F.lower("text"), r"\d+", "0")))
    at_edge = d.filter("place IS NOT NULL")
    recurring = at_edge.groupBy("source_path", "place", "form").agg(F.countDistinct("page_no").alias("form_pages"))
    small_at = at_edge.filter("small").groupBy("source_path", "place").agg(F.countDistinct("page_no").alias("small_pages"))
    small_here = at_edge.filter("small").groupBy("source_path", "place", "page_no").agg(F.lit(True).alias("small_here"))
    d = d.join(recurring, ["source_path", "place", "form"], "left").join(small_at, ["source_path", "place"], "left").join(small_here, ["source_path", "place", "page_no"], "left")
    outermost = (F.col("line_no") == F.col("_first")) | (F.col("line_no") == F.col("_last"))
    no_size = F.col("font_size").isNull() & F.col("place").isNotNull()
    usual = (F.coalesce("small_pages", F.lit(0)) >= 0.5 * F.col("pages")) & F.col("small_here").isNull() & outermost & (F.size(F.split(F.trim("text"), r"\s+")) <= 8) & ~F.col("text").rlike(r"[,;.\-¬­]") & ~F.coalesce("bold", F.lit(False))
    repeats = (F.coalesce("form_pages", F.lit(0)) >= F.greatest(F.lit(3), RECURS * F.col("pages"))) & outermost
    keep = ["line_id", "source_path", "page_no", "line_no", "copy", "text", "font_size", "bold", "baseline", "body", "furniture"]
    d = materialize(d.withColumn("furniture", (F.trim("text") != "") & (F.col("small") | (no_size & (F.col("text").rlike(_PAGE_NO) | usual | repeats)))).select(*keep), "scan-places")  # read four times
    text = d.filter("NOT furniture")
    page = Window.partitionBy("source_path", "page_no", "copy").orderBy("line_no")
    text = text.withColumns({"_next": F.lead("text").over(page), "_next_id": F.lead("line_id").over(page), "_prev": F.lag("text").over(page), "_rank": F.row_number().over(page)})
    first = text.filter("copy = 1 AND _rank = 1").select("source_path", (F.col("page_no") - 1).alias("page_no"), F.col("text").alias("_over"), F.col("line_id").alias("_over_id"))
    last = text.filter("copy = 1 AND _next IS NULL").select("source_path", (F.col("page_no") + 1).alias("page_no"), F.col("text").alias("_under"))
    text = text.join(first, ["source_path", "page_no"], "left").join(last, ["source_path", "page_no"], "left")
    return d.filter("furniture").select(*keep, F.lit(None).cast("string").alias("after"), F.lit(None).cast("long").alias("next_id"), F.lit(None).cast("string").alias("before")).unionByName(
        text.select(*keep, F.coalesce("_next", "_over").alias("after"), F.coalesce("_next_id", "_over_id").cast("long").alias("next_id"), F.when(F.col("_rank") > 1, F.col("_prev")).otherwise(F.col("_under")).alias("before"))
    )


def _open_end(text: str | None) -> re.Match | None:
    """The fragment and the mark a line ends with, where a word may be broken."""
    read = (text or "").rstrip()
    if not re.search(rf"[{MARKS}]$", read[-1:]):
        return None
    return _OPEN.search(text, len(read) - len(read.rsplit(None, 1)[-1]))  # from the last word on: a search from every place of a long line is quadratic


def parse_line(text: str, before: str | None, after: str | None) -> dict:
    """The words of a line in lower case, without halves of broken words; sure signs of misreading; and the break at its end."""
    sure = bool(_SURE.search(text) or _GLUED.search(text) or _SPACED.search(text))
    body, broken = text, None
    m = _open_end(text)
    if m:
        w = re.match(r"\s*[(\"“„«]?(\S+)", after or "")
        right = re.sub(rf"[{MARKS}]$", "", w.group(1).strip(".,;:!?()[]\"“”„«»…'’").lower()) if w else ""
        goes_on = w and (w.group(1)[0].islower() or w.group(1)[0] in "@|·°~^")
        if goes_on or not w or m.group(2) not in "-‐":  # before a capital or a number, a plain hyphen is a word's own
            broken = (m.group(1).lower(), right, m.group(2))
            body = text[: m.start(1)]
    if before and (b := _open_end(before)) and re.match(r"\s*[^\W\d_]", text) and text.lstrip()[0].islower():
        body = re.sub(r"^\s*\S+", "", body, count=1)
    words = []
    for t in _TOKEN.findall(body):
        core = t.strip("'’*")
        if not _LETTERS.search(core) or (core.isupper() and len(core) > 1):
            words.append("")  # numbers and codes keep their place and take no part
            continue
        letters = len(_LETTERS.findall(core))
        digits = sum(map(str.isdigit, core))
        if digits and letters >= 2 and not core[:1].isupper() and not re.fullmatch(r"v?\d+[a-z]{0,3}", core):
            sure = True
        if re.search(r"[a-zß-ÿ]I[a-zß-ÿ]", core):
            sure = True
        words.append(core.lower())
    compounds = re.findall(r"(?<![\w-])[^\W\d_]+(?:-[^\W\d_]+)+(?![\w-])", body)
    return {"words": words, "sure": sure, "broken": broken, "compounds": [c.lower() for c in compounds]}


def confusions(word: str) -> list[tuple[str, bool]]:
    """What may have been printed where ``word`` was read: one confusion undone, or all of one kind (False), or a second one as well (True)."""
    out = []
    for printed, read in CONFUSIONS:
        at = word.find(read)
        if at < 0:
            continue
        out.append(word.replace(read, printed))
        while at >= 0:
            out.append(word[:at] + printed + word[at + len(read) :])
            at = word.find(read, at + 1)
    once = dict.fromkeys(out, False)
    twice = dict.fromkeys((w.replace(read, printed, 1) for w in once for printed, read in NOISE if read in w), True)  # noise comes in clusters
    return [(w, deep) for w, deep in (twice | once).items() if w != word]


def form(word: str) -> str:
    return "".join(FORM.get(c, c) for c in word)


def _hash(word: str, h: int = 0) -> int:
    for c in word:
        h = (h * _RADIX + ord(c)) % _PRIME
    return h


class _Edits:
    """A word whose copies with few changes are hashed and scored without being spelled out.

    A change is (place, signs taken out, signs put in); changes are in order and don't overlap.
    """

    def __init__(self, word: str, letters: Letters):
        self.word, self.letters = word, letters
        self.hashes, self.powers = [0], [1]
        for c in word:
            self.hashes.append((self.hashes[-1] * _RADIX + ord(c)) % _PRIME)
            self.powers.append(self.powers[-1] * _RADIX % _PRIME)
        self.places = {read: [m.start() for m in re.finditer(f"(?={re.escape(read)})", word)] for _, read in CONFUSIONS}

    def spell(self, changes: list[tuple[int, int, str]]) -> str:
        out, at = [], 0
        for place, taken, put in changes:
            out += [self.word[at:place], put]
            at = place + taken
        return "".join(out) + self.word[at:]

    def hash(self, changes: list[tuple[int, int, str]]) -> int:
        h, at = 0, 0
        for place, taken, put in [*changes, (len(self.word), 0, "")]:
            h = (h * self.powers[place - at] + self.hashes[place] - self.hashes[at] * self.powers[place - at]) % _PRIME
            h, at = _hash(put, h), place + taken
        return h

    def gain(self, changes: list[tuple[int, int, str]]) -> float:
        """The lead of the changed word's letters: only trigrams that a change touches count."""
        if len(changes) == 2 and changes[1][0] - changes[0][0] - changes[0][1] < 2:
            (a, k, put), (b, m, put2) = changes
            changes = [(a, b + m - a, put + self.word[a + k : b] + put2)]
        gain = 0.0
        for place, taken, put in changes:
            left, right = ("^^" + self.word[max(0, place - 2) : place])[-2:], (self.word[place + taken : place + taken + 2] + "$")[:2]
            gain += self.letters.sum(left + put + right) - self.letters.sum(left + self.word[place : place + taken] + right)
        return gain

    def first(self, read: str, printed: str, place: int = 0, taken: int = 0, put: str = "") -> list[tuple[int, int, str]] | None:
        """The changes where, after one change, the first ``read`` becomes ``printed``."""
        w, at = self.word, self.places[read]
        if at and at[0] + len(read) <= place:
            return [(at[0], len(read), printed), (place, taken, put)]
        lo = max(0, place - len(read) + 1)
        near = w[lo:place] + put + w[place + taken : place + taken + len(read) - 1]
        i = near.find(read)
        if i >= 0:  # in what was put in, or partly
            end = max(place - lo + len(put), i + len(read))
            lo2 = min(i, place - lo)
            return [(lo + lo2, place - lo - lo2 + taken + end - (place - lo) - len(put), near[lo2:i] + printed + near[i + len(read) : end])]
        k = bisect_left(at, place + taken)
        return [(place, taken, put), (at[k], len(read), printed)] if k < len(at) else None


def long_confusions(word: str, others: dict[int, list[str]], letters: Letters) -> tuple[dict[str, tuple[float, bool]], tuple[float, str] | None]:
    """Of the readings that ``confusions`` gives for a word: those among ``others`` (by hash) as {reading: (lead, second)}, and the best by its letters of the rest."""
    hits: dict[str, tuple[float, bool]] = {}
    best, best_of = -math.inf, None
    own = _Edits(word, letters)
    single = [(at, len(read), printed) for printed, read in CONFUSIONS for at in own.places[read]]
    whole = [_Edits(word.replace(read, printed), letters) for printed, read in CONFUSIONS if len(own.places[read]) > 1]  # all of one kind
    lead_of = {id(x): letters.score(x.word) - letters.score(word) for x in whole} | {id(own): 0.0}

    def tried() -> Iterator[tuple[_Edits, list, bool]]:
        yield from ((own, [c], False) for c in single)
        yield from ((x, [], False) for x in whole)
        for printed, read in NOISE:
            yield from ((own, changes, True) for c in single if (changes := own.first(read, printed, *c)))
            yield from ((x, [(x.places[read][0], len(read), printed)], True) for x in whole if x.places[read])

    for base, changes, deep in tried():
        h = base.hash(changes)
        if h == own.hashes[-1]:
            continue
        lead = lead_of[id(base)] + base.gain(changes)
        if h in others and (v := base.spell(changes)) in others[h]:
            hits.setdefault(v, (lead, deep))
        elif lead > best:
            best, best_of = lead, (base, changes)
    return hits, best_of and (best, best_of[0].spell(best_of[1]))


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = [parse_line(*x) for x in zip(*(b.column(c).to_pylist() for c in ("text", "before", "after")))]
        col = lambda f, kind: pa.array([f(g) for g in got], kind)
        yield pa.RecordBatch.from_arrays(
            [b.column("line_id"), b.column("next_id"), b.column("copy"), col(lambda g: g["words"], pa.list_(pa.string())), col(lambda g: g["sure"], pa.bool_()), col(lambda g: g["broken"] and g["broken"][0], pa.string()), col(lambda g: g["broken"] and g["broken"][1], pa.string()), col(lambda g: g["broken"] and g["broken"][2], pa.string()), col(lambda g: g["compounds"], pa.list_(pa.string()))],
            ["line_id", "next_id", "copy", "words", "sure", "left", "right", "mark", "compounds"],
        )


class Letters:
    """Letter-trigram log probabilities of the vocabulary's word types, from counts of trigrams and of their first two signs."""

    def __init__(self, counts: dict[str, float]):
        self.tri = self.bi = counts

    def score(self, word: str) -> float:
        return self.sum(f"^^{word}$")

    def sum(self, s: str) -> float:
        return sum(math.log((self.tri.get(s[i : i + 3], 0.0) + 0.01) / (self.bi.get(s[i : i + 2], 0.0) + 0.4)) for i in range(len(s) - 2))


def _places() -> Column:
    """Occurrences, those of a page's further scans not counted; at least one."""
    return F.greatest(F.count_if(F.col("copy") == 1), F.lit(1))


def _vocabulary(parsed: DataFrame) -> DataFrame:
    return parsed.select("copy", F.explode("words").alias("word")).filter("word <> ''").groupBy("word").agg(_places().alias("n"))


def _letters(vocabulary: DataFrame) -> Letters:
    padded = F.concat(F.lit("^^"), "word", F.lit("$"))
    known = vocabulary.filter("n > 1 AND length(word) > 2")
    tri = known.select(F.explode(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substr(padded, i, F.lit(3)))).alias("t")).groupBy("t").agg(F.count("*").alias("n"))
    # trigrams without a sign of a confusion are the same in a word and in what it may have been
    counts = tri.select("n", F.explode(F.array("t", F.substr("t", F.lit(1), F.lit(2)))).alias("t")).filter((F.length("t") < 3) | F.col("t").rlike(_CONFUSED_SIGNS)).groupBy("t").agg(F.sum("n").alias("n")).toArrow()
    return Letters({t: float(n) for t, n in zip(counts["t"].to_pylist(), counts["n"].to_pylist())})


def _candidates(letters: Letters):
    """For each word type: what it may have been, and the lead its letters give that reading."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            word, n, other, lead, deep = [], [], [], [], []
            for w, k in zip(b.column("word").to_pylist(), b.column("n").to_pylist()):
                if len(w) < 2 or len(w) > SHORT:
                    continue
                own = letters.score(w)
                for v, twice in confusions(w):
                    deep.append(twice)
                    word.append(w)
                    n.append(k)
                    other.append(v)
                    lead.append(letters.score(v) - own)
            yield pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(n, pa.int64()), pa.array(other, pa.string()), pa.array(lead, pa.float64()), pa.array(deep, pa.bool_())], ["word", "n", "other", "lead", "deep"])

    return run


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        forms = [form(w) for w in b.column("word").to_pylist()]
        keep = [i for i, f in enumerate(forms) if len(f) > SHORT]
        kept = b.take(pa.array(keep, pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array([hashlib.md5(forms[i].encode("utf-8", "surrogatepass")).hexdigest() for i in keep], pa.string()), kept.column("word"), kept.column("n"), kept.column("read")], ["form", "word", "n", "read"])


def _long_candidates(letters: Letters):
    """For the words over SHORT of one form: those of the vocabulary they may have been, and the best of what else they may have been."""

    def run(t: pa.Table) -> pa.Table:
        words, counts = t["word"].to_pylist(), t["n"].to_pylist()
        of = dict(zip(words, counts))
        others: dict[int, list[str]] = {}
        for w, known in zip(words, t["read"].to_pylist()):
            if known:
                others.setdefault(_hash(w), []).append(w)
        rows = []
        for w, n in zip(words, counts):
            if len(w) > SHORT:
                hits, best = long_confusions(w, others, letters)
                rows += [(w, n, v, lead, deep, of[v]) for v, (lead, deep) in hits.items()]
                if best and n == 1 and best[0] > LETTERS:
                    rows.append((w, n, best[1], best[0], False, None))
        kinds = (("word", pa.string()), ("n", pa.int64()), ("other", pa.string()), ("lead", pa.float64()), ("deep", pa.bool_()), ("other_n", pa.int64()))
        return pa.table({c: pa.array([r[i] for r in rows], kind) for i, (c, kind) in enumerate(kinds)})

    return run


def _repairs(parsed: DataFrame, vocabulary: DataFrame, joined: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(word, fix, fix_n, split, split_cost) of doubtful words, and (a, b, merged_n) of neighbours that may be one word.

    ``joined``: the words that broken halves make; those the vocabulary lacks are decoded as words read once.
    """
    letters = _letters(vocabulary)
    total = F.lit(float(max(1, vocabulary.agg(F.sum("n")).first()[0] or 1)))
    unseen = joined.select("word").distinct().join(vocabulary, "word", "left_anti").withColumn("n", F.lit(1).cast("long"))
    words = vocabulary.unionByName(unseen)
    cand = words.mapInArrow(_candidates(letters), "word string, n long, other string, lead double, deep boolean")
    of_form = vocabulary.withColumn("read", F.lit(True)).unionByName(unseen.withColumn("read", F.lit(False))).filter(F.length("word") * max(map(len, FORM.values())) > SHORT)
    long = of_form.mapInArrow(_forms, "form string, word string, n long, read boolean").groupBy("form").applyInArrow(_long_candidates(letters), "word string, n long, other string, lead double, deep boolean, other_n long")
    seen = cand.join(vocabulary.toDF("other", "other_n"), "other", "left").unionByName(long)
    # a reading is an error of a word that is much more frequent, or of one whose letters are far more usual
    frequent = (F.col("other_n") >= 2) & ((F.col("n") == 1) | ((F.col("n") == 2) & (F.col("other_n") >= 8)) | (F.col("n") <= F.when(F.col("deep"), MISREAD**2).otherwise(MISREAD) * F.col("other_n")))
    unusual = F.col("other_n").isNull() & (F.col("n") == 1) & (F.col("lead") > LETTERS) & (F.length("word") >= 5)
    fixes = seen.filter(frequent | unusual).groupBy("word").agg(F.max_by("other", F.struct(F.coalesce("other_n", F.lit(0)), "lead", "other")).alias("fix"), F.max(F.coalesce("other_n", F.lit(1))).alias("fix_n"))

    pair = F.explode(F.transform(F.sequence(F.lit(1), F.size("words") - 1), lambda i: F.struct(F.get("words", i - 1).alias("a"), F.get("words", i).alias("b"))))
    bigrams = parsed.filter("size(words) > 1").select("copy", pair.alias("p")).filter("p.a <> '' AND p.b <> ''").groupBy("p.a", "p.b").agg(_places().alias("pair_n"))
    va, vb = vocabulary.toDF("a", "a_n"), vocabulary.toDF("b", "b_n")
    whole = materialize(bigrams.withColumn("word", F.concat("a", "b")).join(vocabulary, "word").join(va, "a").join(vb, "b"), "scan-whole")
    few = lambda of: (F.col("n") <= 3) | (F.col("n") <= MISREAD / 2 * of)  # noqa: E731  fused words are rare beside the words side by side
    rarer = (F.least("a_n", "b_n") > F.col("n")) & (F.length("a") >= 2) & (F.length("b") >= 2) & (F.length("word") >= 5)
    plain = whole.filter(few(F.col("pair_n")) & rarer & (F.greatest("a_n", "b_n") >= 5)).select("word", "a", "b", "a_n", "b_n")
    # unread side by side: one of them is among the most frequent words, which are at most 1 / 0.0015
    usual = vocabulary.filter((F.col("n") >= total * 0.0015) & (F.length("word") >= 3))
    longer = vocabulary.filter("length(word) >= 7")
    first, last = usual.toDF("a", "a_n"), usual.toDF("b", "b_n")
    starts = longer.join(first, (F.substr("word", F.lit(1), F.lit(3)) == F.substr("a", F.lit(1), F.lit(3))) & F.startswith("word", "a")).withColumn("b", F.substr("word", F.length("a") + 1, F.length("word"))).join(vb, "b")
    closes = longer.join(last, (F.right("word", F.lit(3)) == F.right("b", F.lit(3))) & F.endswith("word", "b")).withColumn("a", F.substr("word", F.lit(1), F.length("word") - F.length("b"))).join(va, "a")
    small_word = few(F.least("a_n", "b_n") * MISREAD) & (F.least("a_n", "b_n") >= 2) & rarer & (F.length("a") >= 3) & (F.length("b") >= 3)
    cuts = plain.unionByName(starts.unionByName(closes).filter(small_word).select("word", "a", "b", "a_n", "b_n"))
    likely = F.log("a_n") + F.log("b_n")
    splits = cuts.groupBy("word").agg(F.max_by(F.concat_ws(" ", "a", "b"), F.struct(likely, "a")).alias("split"), F.min(2 * F.log(total) - likely).alias("split_cost"))
    doubtful = fixes.join(splits, "word", "full_outer")
    # the merged word must be likelier than its halves side by side by more than the penalty
    whole = whole.withColumnRenamed("n", "merged_n")
    gain = F.log("merged_n") + F.log(total) - F.log("a_n") - F.log("b_n")
    merges = whole.filter((gain > SPLIT) & (F.col("merged_n") > F.col("pair_n")) & (F.col("merged_n") > F.least("a_n", "b_n")) & (F.length("word") >= 4)).select("a", "b", "merged_n")
    return doubtful, merges


def decode(words: list[str], counts: dict[str, float], repairs: dict[str, tuple], merges: dict[tuple[str, str], float]) -> tuple[float, list[tuple[str, list[str], list[str]]]]:
    """The cheapest path over a line's words: (cost, [(kind, words read, words printed)])."""
    n = len(words)
    best: list[tuple[float, int, str, list[str]]] = [(0.0, -1, "", [])] + [(math.inf, -1, "", [])] * n
    for i in range(n):
        cost, w = best[i][0], words[i]
        doubt = repairs.get(w)
        options = [(cost + counts.get(w, 0.0) + (20.0 if doubt else 0.0), 1, "same", [w])]
        if doubt:
            if doubt[0] is not None:
                options.append((cost + doubt[1] + CONFUSED, 1, "confused", [doubt[0]]))
            if doubt[2] is not None:
                options.append((cost + doubt[3] + FUSED, 1, "fused", doubt[2].split()))
        if i + 1 < n and (w, words[i + 1]) in merges:
            options.append((cost + merges[w, words[i + 1]] + SPLIT, 2, "split", [w + words[i + 1]]))
        for c, k, kind, out in options:
            if c < best[i + k][0]:
                best[i + k] = (c, i, kind, out)
    path, i = [], n
    while i > 0:
        _, j, kind, out = best[i]
        path.append((kind, words[j:i], out))
        i = j
    return best[n][0], path[::-1]


def _decoded(parsed: DataFrame) -> DataFrame:
    """(line_id, ocr, changes, hyphen, joined): what decoding says about each text line."""
    vocabulary = materialize(_vocabulary(parsed), "scan-words")
    broken = parsed.filter("left IS NOT NULL").select(
        "line_id", "next_id", "left", F.element_at(F.split("left", "-"), -1).alias("first_half"), F.concat("left", F.lit("-"), "right").alias("compound"), F.concat(F.element_at(F.split("left", "-"), -1), F.element_at(F.split("right", "[-_/]"), 1)).alias("word"), F.concat("left", "right").alias("joined"), "mark"
    )
    doubtful, merges = _repairs(parsed, vocabulary, broken.filter("right <> ''"))
    doubtful, merges = materialize(doubtful, "scan-doubtful"), materialize(merges, "scan-merges")
    total = float(max(1, vocabulary.agg(F.sum("n")).first()[0] or 1))
    neg = lambda c: F.log(F.lit(total)) - F.log(c)
    at = parsed.select("line_id", F.explode("words").alias("word")).filter("word <> ''").distinct()
    of_words = at.join(doubtful, "word").join(vocabulary, "word").groupBy("line_id").agg(F.collect_list(F.struct("word", neg("n").alias("cost"), "fix", neg("fix_n").alias("fix_cost"), "split", "split_cost")).alias("doubts"))
    pair = F.explode(F.transform(F.sequence(F.lit(1), F.size("words") - 1), lambda i: F.struct(F.get("words", i - 1).alias("a"), F.get("words", i).alias("b"))))
    pairs = parsed.filter("size(words) > 1").select("line_id", pair.alias("p")).select("line_id", "p.a", "p.b").distinct()
    va, vb = vocabulary.toDF("a", "a_n"), vocabulary.toDF("b", "b_n")
    of_pairs = pairs.join(merges, ["a", "b"]).join(va, "a").join(vb, "b").groupBy("line_id").agg(F.collect_list(F.struct("a", "b", neg("merged_n").alias("cost"), neg("a_n").alias("a_cost"), neg("b_n").alias("b_cost"))).alias("merges"))

    # at the line's end: one word, or a compound with a hyphen of its own
    compounds = parsed.select("copy", F.explode("compounds").alias("compound")).groupBy("compound").agg(_places().alias("own_n"))
    # compounds of three parts are also known by their beginning or end
    heads = parsed.select("copy", F.explode("compounds").alias("compound")).select("copy", F.explode(F.expr("transform(sequence(1, size(split(compound, '-')) - 1), i -> substring_index(compound, '-', i))")).alias("left")).groupBy("left").agg(_places().alias("head_n"))
    ends = broken.join(compounds, "compound", "left").join(vocabulary, "word", "left").join(heads, "left", "left").join(doubtful.select("word", "fix"), "word", "left")
    own = (F.coalesce("own_n", F.lit(0)) > 0) & (F.coalesce("own_n", F.lit(0)) >= F.coalesce("n", F.lit(0)))
    # where the other half is lost or misread, the first half of a frequent compound speaks for the word's own hyphen
    own = own | (F.col("own_n").isNull() & F.col("n").isNull() & (F.coalesce("head_n", F.lit(0)) >= 3) & F.col("mark").isin("-", "‐"))
    # a joined word that was misread in one half or both: what stands before the break is this line's, what stands behind it the next line's
    fix = F.when(~own, F.col("fix"))
    behind = F.substr("word", F.length("first_half") + 1, F.length("word"))
    ends = ends.select(
        "line_id", "next_id", (~own).alias("hyphen"), F.when(own, F.col("compound")).otherwise(F.col("joined")).alias("joined"), F.col("word").alias("end_read"), fix.alias("end_printed"),
        F.coalesce(~fix.startswith(F.col("first_half")), F.lit(False)).alias("ocr_here"), F.coalesce(~fix.startswith(F.col("first_half")) & fix.endswith(behind), F.lit(False)).alias("_only_here"),
    ).withColumn("ocr_next", F.col("end_printed").isNotNull() & ~F.col("_only_here"))
    ends = ends.withColumn("ocr_here", F.col("end_printed").isNotNull() & (F.col("ocr_here") | F.col("_only_here"))).drop("_only_here")
    rows = parsed.select("line_id", "words", "sure").join(of_words, "line_id", "left").join(of_pairs, "line_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ocr, changes = [], []
            for words, sure, doubts, pairs_ in zip(*(b.column(c).to_pylist() for c in ("words", "sure", "doubts", "merges"))):
                repairs = {d["word"]: (d["fix"], d["fix_cost"], d["split"], d["split_cost"]) for d in doubts or ()}
                counts = {d["word"]: d["cost"] for d in doubts or ()}
                ab = {}
                for m in pairs_ or ():
                    ab[m["a"], m["b"]] = m["cost"]
                    counts.setdefault(m["a"], m["a_cost"])
                    counts.setdefault(m["b"], m["b_cost"])
                path = decode(words, counts, repairs, ab)[1] if repairs or ab else []
                found = [(" ".join(r), " ".join(p)) for k, r, p in path if k not in ("same", "")]
                ocr.append(bool(sure or found))
                changes.append(found)
            kind = pa.list_(pa.struct([("read", pa.string()), ("printed", pa.string())]))
            yield pa.RecordBatch.from_arrays([b.column("line_id"), pa.array(ocr, pa.bool_()), pa.array([[{"read": r, "printed": p} for r, p in c] for c in changes], kind)], ["line_id", "ocr", "changes"])

    done = rows.mapInArrow(run, "line_id long, ocr boolean, changes array<struct<read:string,printed:string>>")
    return done.join(ends, "line_id", "left")


def _prepared(pdf_lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    lines = materialize(_lines(pdf_lines), "scan-lines")
    text = lines.filter("NOT furniture AND trim(text) <> ''").select(F.col("line_id").cast("long").alias("line_id"), "next_id", F.col("copy").cast("int").alias("copy"), "text", "before", "after")
    return lines, materialize(text.mapInArrow(_parse, "line_id long, next_id long, copy int, words array<string>, sure boolean, left string, right string, mark string, compounds array<string>"), "scan-parsed")


def defects(pdf_lines: DataFrame) -> DataFrame:
    """(line_id, defect): furniture, hyphen, ocr."""
    lines, parsed = _prepared(pdf_lines)
    d = _decoded(parsed)
    return lines.filter("furniture").select("line_id", F.lit("furniture").alias("defect")).unionByName(d.filter("hyphen").select("line_id", F.lit("hyphen").alias("defect"))).unionByName(
        d.filter("ocr OR ocr_here").select("line_id").unionByName(d.filter("ocr_next AND next_id IS NOT NULL").select(F.col("next_id").alias("line_id"))).distinct().withColumn("defect", F.lit("ocr"))
    )


def repaired_line(text: str, changes: list[dict]) -> str:
    """The line with its misread words replaced, in the case they were read in, and stray marks taken out."""
    for c in changes or ():
        parts = [re.escape(p) for p in c["read"].split()]
        m = re.search(r"(?<![^\W_])" + r"\s+".join(parts) + r"(?![^\W_])", text, re.I)
        if m:
            new = c["printed"]
            new = new.upper() if m.group(0).isupper() and len(m.group(0)) > 1 else new[:1].upper() + new[1:] if m.group(0)[:1].isupper() else new
            text = text[: m.start()] + new + text[m.end() :]
    text = _SPACED.sub(lambda m: re.sub(r"\s", "", m.group(0)), text)
    text = re.sub(r"(?<=[^\W_])[·°~^](?=[^\W_])|[·°~^](?=\W|$)", "", text)
    return re.sub(r"(?<=[^\W\d_]{2}[,;.!?])(?=[^\W\d_]{2})", " ", text)


def cut_paragraphs(lines: list[dict]) -> list[int]:
    """Starts of the paragraphs of a page: the cut of least cost, by dynamic programming over where the last paragraph starts."""
    n = len(lines)
    gaps = [lines[i - 1]["baseline"] - lines[i]["baseline"] for i in range(1, n) if lines[i]["baseline"] is not None and lines[i - 1]["baseline"] is not None]
    usual = float(np.median(gaps)) if gaps else 0.0
    width = max((len(x["text"]) for x in lines), default=1)

    def boundary(i: int) -> float:
        """Cost of a paragraph's starting at line i; negative where the page speaks for it."""
        a, b = lines[i - 1], lines[i]
        cost = 1.5
        if usual > 0 and a["baseline"] is not None and b["baseline"] is not None:
            cost += 4.0 * (1.3 - min(3.0, (a["baseline"] - b["baseline"]) / usual))
        ended = a["text"].rstrip().endswith((".", "!", "?", ":", "…"))
        cost += -1.0 if ended else 3.0
        cost += -1.0 if len(a["text"]) < 0.6 * width and ended else 0.0
        if a["size"] and b["size"] and abs(a["size"] - b["size"]) > 0.15 * min(a["size"], b["size"]):
            cost -= 8.0
        return cost

    best, came = [0.0] * (n + 1), [0] * (n + 1)
    starts = [0.0] + [boundary(i) for i in range(1, n)]
    for j in range(1, n + 1):  # the last paragraph of lines 0..j-1 starts at i
        at, low = 0, math.inf
        inner = 0.0
        for i in range(j - 1, -1, -1):
            c = best[i] + starts[i] + inner
            if c < low:
                at, low = i, c
            inner += max(0.0, -starts[i])  # what a boundary left out would have gained
        best[j], came[j] = low, at
    out, j = [], n
    while j:
        out.append(came[j])
        j = came[j]
    return out[::-1]


def paragraphs(pdf_lines: DataFrame) -> DataFrame:
    """(source_path, page_no, copy, paragraph_no, text, goes_on): the repaired paragraphs of each page; ``goes_on`` where the next page continues the last."""
    lines, parsed = _prepared(pdf_lines)
    d = _decoded(parsed)
    t = lines.filter("NOT furniture AND trim(text) <> ''").drop("next_id").join(d, "line_id", "left")
    row = F.struct("line_no", "text", "baseline", F.col("font_size").alias("size"), "changes", "hyphen", "joined", "end_read", "end_printed", F.col("after").isNotNull().alias("more"))
    pages = t.groupBy("source_path", "page_no", "copy").agg(F.array_sort(F.collect_list(row)).alias("lines"))  # one page's lines

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            src, no, out, on = [], [], [], []
            for i, rows in enumerate(b.column("lines").to_pylist()):
                starts = cut_paragraphs(rows)
                for k, s in enumerate(starts):
                    e = starts[k + 1] if k + 1 < len(starts) else len(rows)
                    text, halves = "", []
                    for r in rows[s:e]:
                        fixed = repaired_line(r["text"].strip(), r["changes"])
                        text += fixed if not text or text.endswith(("\x01", "\x02")) else " " + fixed
                        if r["joined"] is not None and r["more"]:  # the halves meet; an own hyphen stays
                            text = re.sub(rf"[{MARKS}]\s*$", "\x01" if r["hyphen"] else "-\x02", text)
                            if r["end_printed"]:
                                halves.append({"read": r["end_read"], "printed": r["end_printed"]})
                    src.append(i)
                    no.append(k)
                    on.append(e == len(rows) and rows[-1]["more"] and not text.rstrip("\x01\x02").endswith((".", "!", "?", ":")))
                    text = re.sub(r"[\x01\x02]", "", text)
                    out.append(repaired_line(text, halves) if halves else text)
            take = pa.array(src, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("source_path").take(take), b.column("page_no").take(take), b.column("copy").take(take), pa.array(no, pa.int32()), pa.array(out, pa.string()), pa.array(on, pa.bool_())], ["source_path", "page_no", "copy", "paragraph_no", "text", "goes_on"])

    return pages.mapInArrow(run, "source_path string, page_no int, copy int, paragraph_no int, text string, goes_on boolean")


def repaired_markdown(conversions: DataFrame, pdf_lines: DataFrame) -> DataFrame:
    """(source_path, markdown): the Pdf conversions as continuous paragraphs, one row per path; without lines of their own they stay as they are."""
    p = paragraphs(pdf_lines).filter("copy = 1")
    one = p.groupBy("source_path").agg(F.array_sort(F.collect_list(F.struct("page_no", "paragraph_no", "text", "goes_on"))).alias("ps"))  # one document's text
    before = lambda i: F.when(i == 0, "").when(F.get("ps", i - 1)["goes_on"], " ").otherwise("\n\n")
    text = F.array_join(F.transform("ps", lambda x, i: F.concat(before(i), x["text"])), "")
    src = conversions.filter("format = 'Pdf'").groupBy(F.coalesce("source_path", F.lit("")).alias("source_path")).agg(F.max("markdown").alias("_was"))
    return src.join(one.select("source_path", text.alias("_new")), "source_path", "left").select("source_path", F.coalesce("_new", "_was").alias("markdown"))
