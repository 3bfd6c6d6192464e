"""Toxicity by a weighted lexicon, found by Aho-Corasick in folded text."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read, spare, stored, utf8

#: At most so many labelled rows of each class are learned from, and at most so many terms are kept.
SAMPLE_ROWS, MAX_TERMS = 10_000, 2_000
#: Terms that count even where the labels say nothing about them.
SEEDS = ("idiot", "moron", "stupid", "loser", "scum", "trash", "worthless", "pathetic", "disgusting", "clown", "imbecile", "retard", "bastard", "asshole", "bitch", "fuck", "fucking", "whore", "slut", "cunt")
SEED_WEIGHT = 2.0
#: Phrases within which a term does not count.
EXCEPTIONS = ("clown fish", "trash can", "trash bin", "class clown award", "sore loser rule", "recycling trash", "scum of the pond", "pond scum")

#: Letters of other scripts that look like Latin ones.
HOMOGLYPHS = dict(zip("аеорсухѕіјԁһкмтвнɡɑοαερυνικτχ", "aeopcyxsijdhkmtbhgaoaepuviktx", strict=True))
#: l and i are one letter after folding, as 1, ! and | may stand for either.
SIGNS = str.maketrans("013457@$!|", "oieastasii")
_FOLD = str.maketrans(HOMOGLYPHS | {"l": "i", "ı": "i"} | {chr(0xFF41 + k): chr(97 + k) if k != 11 else "i" for k in range(26)})
_SIGN = re.compile(r"[013457@$!|]+(?=[^\W\d_])")
#: At a word's end digits, @ and $ may be letters or not; closing ! and | are not.
_END = re.compile(r"(?<=[^\W\d_])[013457@$]+(?![^\W_])")
_WORD = re.compile(r"[^\W\d_]+")
#: In so many toxic documents a term has to be, however many there are.
SUPPORT = 4
PREFIXES = (4, 5, 6)


def _sign(m: re.Match) -> str:
    i, found = m.start(), m.group()
    before = m.string[i - 1 : i]
    inside = before.isalpha() or not before.isalnum() and found.strip("!|")
    return found.translate(SIGNS) if inside else found


def folded(text: str) -> str:
    """Lower case, look-alike letters as Latin ones, digits and signs before letters as the letters they stand for."""
    return _SIGN.sub(_sign, text.lower().translate(_FOLD))


def readings(text: str) -> list[str]:
    """A folded text, and where words end in digits or signs, the text with these as letters too. Both have one length."""
    ended = _END.sub(lambda m: m.group().translate(SIGNS), text)
    return [text] if ended == text else [text, ended]


@dataclass(frozen=True)
class Lexicon:
    """terms: (folded term, whole word or else start of a word, weight); score = 1 / (1 + exp(-(a + b * x)))."""

    terms: tuple[tuple[str, bool, float], ...]
    exceptions: tuple[str, ...]
    a: float = -5.0
    b: float = 6.0

    def matcher(self) -> Matcher:
        return Matcher(self)


class Matcher:
    def __init__(self, lexicon: Lexicon):
        self.lexicon, self.found = lexicon, ahocorasick.Automaton()
        own: dict[str, list[tuple[bool, float]]] = {}
        for term, whole, weight in lexicon.terms:
            own.setdefault(term, []).append((whole, weight))
        for phrase in lexicon.exceptions:
            own.setdefault(folded(phrase), []).append((True, -1.0))
        for term, kinds in own.items():
            self.found.add_word(term, (len(term), kinds))
        if own:
            self.found.make_automaton()

    def weight(self, text: str) -> float:
        """Sum over the words at which terms start, of the heaviest term in either reading, without those inside an
        exception phrase."""
        if not len(self.found):
            return 0.0
        best: dict[int, float] = {}
        free: list[tuple[int, int]] = []
        for text in readings(text):
            for end, (length, kinds) in self.found.iter(text):
                start = end - length + 1
                if start and text[start - 1].isalpha():
                    continue
                closed = not text[end + 1 : end + 2].isalpha()
                for whole, weight in kinds:
                    if whole and not closed:
                        continue
                    if weight < 0:
                        free.append((start, end))
                    else:
                        best[start] = max(weight, best.get(start, 0.0))
        return sum(w for at, w in best.items() if not any(i <= at <= j for i, j in free))

    def feature(self, raw: bytes) -> float:
        """Weight for each hundred words, on a logarithmic scale."""
        text = folded(raw.decode("utf-8", "replace"))
        weight = self.weight(text)
        return math.log1p(100 * weight / (len(text.split()) + 20)) if weight else 0.0

    def score(self, raw: bytes) -> float:
        return 1 / (1 + math.exp(-(self.lexicon.a + self.lexicon.b * self.feature(raw))))


def held_out(doc_id: str) -> F.Column:
    """Rows that are never learned from: crc32 of the id's text, modulo 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4)) == 2, F.lit(False))


def _select(words: DataFrame, toxic: int, clean: int, max_terms: int) -> list[tuple[str, bool, float]]:
    """Terms from rows (word, toxic, clean): in how many documents of each class. At most max_terms reach the driver."""
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
    fit = lambda df: df.withColumn("odds", odds).where((F.col("toxic") >= SUPPORT) & (F.col("odds") >= 2.5))
    top = lambda df: df.orderBy(F.desc(F.col("odds") * F.log(F.col("toxic") + 1.0)), "term").limit(max_terms).collect()
    length = F.explode(F.array(*[F.lit(k) for k in PREFIXES])).alias("k")
    starts = words.select("*", length).where(F.length("word") >= F.col("k"))
    starts = starts.groupBy(F.substring("word", F.lit(1), F.col("k")).alias("term")).agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.count_if(F.col("toxic") > 0).alias("n")
    )
    stems: dict[str, float] = {}
    for r in sorted(top(fit(starts.where("n >= 3"))), key=lambda r: len(r.term)):
        if not any(r.term.startswith(x) for x in stems):
            stems[r.term] = min(6.0, r.odds)
    terms = [(x, False, w) for x, w in stems.items()]
    for r in top(fit(words.withColumnRenamed("word", "term"))):
        if not any(r.term.startswith(x) for x in stems):
            terms.append((r.term, True, min(6.0, r.odds)))
    return terms


def _fit_logistic(rows: list[tuple[float, int, float]], ridge: float = 0.5) -> tuple[float, float]:
    """a, b of sigmoid(a + b * x) for rows (x, label, weight), by Newton steps with a ridge on b."""
    a, b = -3.0, 1.0
    for _ in range(50):
        g0 = g1 = h00 = h01 = h11 = 0.0
        for x, y, w in rows:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * x))))
            e, v = w * (p - y), w * p * (1 - p) + 1e-9
            g0, g1, h00, h01, h11 = g0 + e, g1 + e * x, h00 + v, h01 + v * x, h11 + v * x * x
        g0, g1, h00, h11 = g0 + 0.01 * (a + 3), g1 + ridge * b, h00 + 0.01, h11 + ridge
        det = h00 * h11 - h01 * h01
        da, db = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det
        step = min(1.0, 4 / (abs(da) + abs(db) + 1e-9))
        a, b = a - step * da, b - step * db
    return a, b


def learn(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    sample_rows: int = SAMPLE_ROWS,
    max_terms: int = MAX_TERMS,
    seeds: tuple[str, ...] = SEEDS,
    exceptions: tuple[str, ...] = EXCEPTIONS,
) -> Lexicon:
    """Terms, weights and the score's scale, from the labelled rows that are not held out.

    At most sample_rows rows of each class are used, those with the smallest hash of their id. Spark counts in how
    many documents of each class each folded word is; a term is a word, or a start of words of 4 to 6 letters that
    three or more words share, which is in toxic documents far more often. Its weight is its log odds. Seeds keep a
    fixed weight unless the labels speak against them.

    Of equal texts, and of repeated labels, one that is toxic counts. Null texts are empty; rows with a null id or label
    are not learned from. Terms with equal odds come in alphabetical order. Without documents or labels of both classes
    the lexicon is the seeds, with a fixed scale.
    """
    marked = labels.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{label}`").cast("int").alias("y"))
    marked = marked.where("id IS NOT NULL AND y IS NOT NULL").groupBy("id").agg(F.max("y").alias("y"))
    marked = marked.where(~held_out("id"))
    sizes = {r.y: r["count"] for r in marked.groupBy((F.col("y") > 0).cast("int").alias("y")).count().collect()}
    order = [F.crc32(F.concat(F.lit("learn"), F.col("id").cast("string"))), "id"]
    taken = marked.where("y > 0").orderBy(*order).limit(sample_rows).unionByName(marked.where("y = 0").orderBy(*order).limit(sample_rows))
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), utf8(f"`{text}`").alias("raw"))
    rows = rows.join(F.broadcast(taken), "id").groupBy("raw").agg(F.max("y").alias("y"))  # 2 * sample_rows ids
    rows = stored(rows.select("y", "raw"), "labelled")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
        n = {0: 0, 1: 0}
        for batch in batches:
            for y, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen[int(y > 0)].update({w for x in readings(folded(raw.decode("utf-8", "replace"))) for w in _WORD.findall(x)})
                n[int(y > 0)] += 1
        words = [*(seen[0].keys() | seen[1].keys())]
        cols = [pa.array([None, *words]), *(pa.array([n[y], *(seen[y][w] for w in words)], pa.int64()) for y in (1, 0))]
        yield pa.RecordBatch.from_arrays(cols, names=["word", "toxic", "clean"])

    words = rows.mapInArrow(count, "word string, toxic long, clean long").groupBy("word")
    words = stored(words.agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "words")
    totals = words.where("word IS NULL").first()
    toxic, clean = (totals.toxic, totals.clean) if totals else (0, 0)
    terms = _select(words.where("word IS NOT NULL"), toxic, clean, max_terms) if toxic and clean else []
    known = {folded(x): x for x in seeds}
    spoken = {r.word: (r.toxic, r.clean) for r in words.where(F.col("word").isin([*known])).collect()}
    for term in known:
        a, b = spoken.get(term, (0, 0))
        against = (a + 0.5) / (toxic + 1) < 2 * (b + 0.5) / (clean + 1) and b >= 3
        if not against and not any(t == term if whole else term.startswith(t) for t, whole, _ in terms):
            terms.append((term, True, SEED_WEIGHT))
    lexicon = Lexicon(tuple(sorted(terms)), exceptions)
    if not toxic or not clean:
        return lexicon

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = lexicon.matcher()
        for batch in batches:
            x = [round(matcher.feature(r), 1) for r in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.float64())], names=["y", "x"])

    # at most one row for each tenth of a logarithm and class
    bins = rows.mapInArrow(features, "y int, x double").groupBy("x", (F.col("y") > 0).cast("int").alias("y")).count().collect()
    share = {1: sizes.get(1, 0) / toxic, 0: sizes.get(0, 0) / clean}
    scale = 2000 / max(1, sizes.get(1, 0) + sizes.get(0, 0))
    a, b = _fit_logistic([(r.x, r.y, r["count"] * share[r.y] * scale) for r in bins])
    return Lexicon(lexicon.terms, exceptions, a, b)


def with_scores(docs: DataFrame, lexicon: Lexicon, name: str = "score", text: str = "text", keep_text: bool = False) -> DataFrame:
    """docs without the text (or, with keep_text, with it), and a double column `name`, 0 to 1. Whole texts; null counts as
    empty. The score sees the text alone, so repeated rows score alike. An empty table gives an empty result. Texts go to the
    workers once, as bytes."""
    rest = [c for c in docs.columns if c != text]
    (raw,) = spare(docs, "raw")
    kept = docs.select(*[F.col(f"`{c}`") for c in rest])
    given = docs.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text}`").cast("binary").alias(raw))
    names = [*rest, *[raw] * keep_text, name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = lexicon.matcher()
        for batch in batches:
            scores = pa.array([matcher.score(x.as_py() or b"") for x in batch.column(len(rest))], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest) + keep_text], scores], names=names)

    fields = [*kept.schema.fields, *[T.StructField(raw, T.BinaryType())] * keep_text, T.StructField(name, T.DoubleType())]
    out = given.mapInArrow(run, T.StructType(fields))
    if not keep_text:
        return out
    return out.select(*[F.col(raw).cast("string").alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns], name)


def drop_toxic(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """docs without those that score `threshold` or more, texts as they were; null texts score as empty and stay null. Extra columns
    stay, whatever they are called."""
    (score,) = spare(docs, "toxic_score")
    kept = with_scores(docs, lexicon, score, text, keep_text=True)
    return kept.where(F.col(score) < threshold).select(*[f"`{c}`" for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: whole texts. Rows with a null doc_id are scored and count as not held out."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = learn(docs, read(spark, sf_dir, "labels"))
    out = with_scores(docs, lexicon).withColumn("held_out", held_out("doc_id"))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
