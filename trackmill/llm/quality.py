"""Quality rules: counts of each text, and perplexity bands of its language."""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WHITESPACE, read, spare, stored, utf8

#: Letters of a gram, and what stands between words. A gram is four UTF-16 units, and so a number of 64 bits.
ORDER, GAP = 4, "\x02"
#: The model grows with the input and is cut into parts of about so many rows (12 bytes each); a worker holds one part at
#: a time. A row's cell is its language's bucket and, in it, the bucket of its context's last letter.
PART_ROWS, LANG_CELLS, LETTER_CELLS = 5_000_000, 1024, 64
#: Texts that a worker takes at once; more where each part has to be loaded for them.
ROWS_AT_ONCE, ROWS_FOR_PARTS = 200, 4000
#: A band is the median of log perplexity and so many times the scaled median deviation, but LEAST at least; for a text
#: of n words SHORT / sqrt(n) more, as short texts vary more.
WIDTH, LEAST, SHORT = 6.0, 0.12, 0.6
_BIN = 100
#: Grams that a task sums at once, and how many different ones it holds.
CODES_AT_ONCE, CODES_HELD = 4_000_000, 2_000_000


# ---- counts of a text

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
_MIX = np.uint64(0x9E3779B97F4A7C15)


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words in windows of `width` words that the text has twice or more, the first one included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    own = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    hashes = np.zeros(n, np.uint64)
    for k in range(width):
        hashes = hashes * _MIX + own[k : k + n]
    order = np.sort(hashes)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(hashes, twice)).tolist()
    found = Counter(tuple(words[i : i + width]) for i in at)
    inside = np.zeros(len(words) + 1, np.int64)
    for i in at:
        if found[tuple(words[i : i + width])] > 1:
            inside[i] += 1
            inside[i + width] -= 1
    return int((np.cumsum(inside) > 0).sum())


def text_counts(raw: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = raw.split()
    chars = len(raw.decode("utf-8", "replace")) - (len(raw) - len(raw.translate(None, WHITESPACE)))
    seen: set[bytes] = set()
    doubles = 0
    for line in raw.split(b"\n"):
        if line in seen:
            doubles += 1
        elif line.strip(WHITESPACE):
            seen.add(line)
    return len(words), chars, len(raw) - len(raw.translate(None, SYMBOLS)), doubles, repeated_words(words)


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 20) | (100 * n_repeat_words > 30 * n_words)


# ---- the model


def text_grams(text: str) -> list[str]:
    """All grams of a text, one for each letter and each word's end: the words with a gap after each, and a gap of the order's
    width before the first."""
    words = [w for w in text.translate(_SPACES).split(" ") if w]
    line = GAP * (ORDER - 1) + "".join(w + GAP for w in words)
    return [line[i : i + ORDER] for i in range(len(line) - ORDER + 1)]


_SPACES = dict.fromkeys(WHITESPACE, " ")


def gram_codes(raw: bytes) -> np.ndarray:
    """The grams of a UTF-8 text as numbers. Characters beyond 16 bits count as the replacement character, twice."""
    line = b" ".join(raw.split()).decode("utf-8", "replace")
    if not line:
        return np.zeros(0, np.uint64)
    u = np.frombuffer(line.encode("utf-16-le"), np.uint16).copy()
    u[(u >= 0xD800) & (u < 0xE000)] = 0xFFFD
    u[u == 32] = ord(GAP)
    gap = np.full(ORDER - 1, ord(GAP), np.uint16)
    u = np.concatenate([gap, u, gap[:1]]).astype(np.uint64)
    return (u[:-3] << np.uint64(48)) | (u[1:-2] << np.uint64(32)) | (u[2:-1] << np.uint64(16)) | u[3:]


def gram_texts(codes: np.ndarray) -> list[str]:
    units = np.column_stack([(codes >> np.uint64(16 * k)) & np.uint64(0xFFFF) for k in range(ORDER - 1, -1, -1)]).astype("<u2")
    line = units.tobytes().decode("utf-16-le")
    return [line[i : i + ORDER] for i in range(0, len(line), ORDER)]


@functools.lru_cache(1)
def _is_letter() -> np.ndarray:
    return np.array([chr(i).isalnum() for i in range(1 << 16)])


def _summed(codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(codes)
    codes, n = codes[order], n[order]
    first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.zeros(0, np.int64)
    return codes[first], np.add.reduceat(n, first) if len(codes) else n


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, gram, n) of a task's grams, which are summed first and sent when many are held."""
    new: dict[str, list[np.ndarray]] = {}
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def add(lang: str) -> None:
        codes, n = np.unique(np.concatenate(new.pop(lang)), return_counts=True)
        if lang in held:
            codes, n = _summed(np.r_[held[lang][0], codes], np.r_[held[lang][1], n])
        held[lang] = codes, n

    def rows(lang: str) -> Iterator[pa.RecordBatch]:
        codes, n = held.pop(lang)
        for i in range(0, len(codes), 100_000):
            texts = gram_texts(codes[i : i + 100_000])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(texts), pa.string()), pa.array(texts, pa.string()), pa.array(n[i : i + 100_000], pa.int64())], names=["lang", "gram", "n"])

    sizes: Counter = Counter()
    for batch in batches:
        for lang, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
            codes = gram_codes(raw.as_py())
            new.setdefault(lang, []).append(codes)
            sizes[lang] += len(codes)
            if sum(sizes.values()) > CODES_AT_ONCE:
                for x in [*new]:
                    add(x)
                sizes.clear()
                for x in [x for x in held if sum(len(c) for c, _ in held.values()) > CODES_HELD]:
                    yield from rows(x)
    for x in [*new]:
        add(x)
    for x in [*held]:
        yield from rows(x)


def _discounts(grams: DataFrame) -> DataFrame:
    """(lang, d1, d2, d3) of modified Kneser-Ney from how many grams were counted once, twice, three and four times."""
    n1, n2, n3, n4 = (F.count_if(F.col("n") == k).cast("double") for k in (1, 2, 3, 4))
    counts = grams.groupBy("lang").agg(n1.alias("n1"), n2.alias("n2"), n3.alias("n3"), n4.alias("n4"))
    y = F.col("n1") / F.greatest(F.col("n1") + 2 * F.col("n2"), F.lit(1.0))
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(b), F.col(a)), F.lit(0.0))
    inside = lambda c, k: F.greatest(F.lit(0.05 * k), F.least(F.lit(0.95 * k), c))
    return counts.select(
        "lang",
        inside(1 - 2 * y * ratio("n1", "n2"), 1).alias("d1"),
        inside(2 - 3 * y * ratio("n2", "n3"), 2).alias("d2"),
        inside(3 - 4 * y * ratio("n3", "n4"), 3).alias("d3"),
    )


def kneser_ney(counts: DataFrame) -> DataFrame:
    """(part, cell, key, value) from rows (lang, gram, n): log probabilities by hash of language and gram (part k for order
    k) and log weights of the next lower order by hash of language and context (part -k). Hashes have 64 bits; every
    gram and context has its own row. What a gram needs to be looked up is in one cell, but for single letters and
    empty contexts (parts -1 to 1), which all cells of a language need.

    Modified Kneser-Ney with interpolation: grams of the highest order have their counts, those of a lower order the
    number of different letters before them. All steps are groupings and joins on language and gram.
    """
    orders = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):
        lower = orders[k + 1].groupBy("lang", F.substring("gram", F.lit(2), F.lit(k)).alias("gram"))
        orders[k] = stored(lower.agg(F.count("*").alias("n")), f"grams{k}")
    below = orders[1].groupBy("lang").agg((1 / (F.count("*") + 1.0)).alias("p_rest"))
    parts = [below.select(F.lit(0).alias("part"), F.col("lang"), F.lit("").alias("gram"), F.log("p_rest").alias("value"))]
    lower = None
    for k in range(1, ORDER + 1):
        size = F.length("gram")
        rows = orders[k].join(F.broadcast(_discounts(orders[k])), "lang")  # a row for each language
        cut = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        rows = rows.withColumns({"cut": F.least(cut, F.col("n").cast("double")), "context": F.substring("gram", F.lit(1), size - 1), "rest": F.substring("gram", F.lit(2), size - 1)})
        totals = rows.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.sum("cut").alias("spared"))
        rows = rows.join(totals, ["lang", "context"])
        rows = rows.join(F.broadcast(below), "lang") if lower is None else rows.join(lower, ["lang", "rest"])
        p = (F.col("n") - F.col("cut") + F.col("spared") * F.col("p_rest")) / F.col("total")
        rows = stored(rows.select("lang", "gram", p.alias("p")), f"model{k}")
        parts.append(rows.select(F.lit(k).alias("part"), "lang", "gram", F.log("p").alias("value")))
        weight = F.log(F.col("spared") / F.col("total")).alias("value")
        parts.append(totals.select(F.lit(-k).alias("part"), "lang", F.col("context").alias("gram"), weight))
        lower = rows.select("lang", F.col("gram").alias("rest"), F.col("p").alias("p_rest"))
    model = parts[0]
    for part in parts[1:]:
        model = model.unionByName(part)
    letter = F.substring("gram", F.when(F.col("part") > 1, F.length("gram") - 1).otherwise(F.length("gram")), F.lit(1))
    inner = F.when(F.abs("part") > 1, F.pmod(F.xxhash64(letter), F.lit(LETTER_CELLS))).otherwise(F.lit(0))
    cell = (F.pmod(F.xxhash64("lang"), F.lit(LANG_CELLS)) * LETTER_CELLS + inner).cast("int").alias("cell")
    return model.select("part", cell, F.xxhash64("lang", "gram").alias("key"), F.col("value").cast("float").alias("value"))


@dataclass
class Part:
    """Sorted arrays of hashes, and for each hash its value."""

    keys: dict[int, np.ndarray]
    values: dict[int, np.ndarray]

    @classmethod
    def of(cls, rows: pa.Table) -> Part:
        part, key, value = (rows.column(c).to_numpy() for c in ("part", "key", "value"))
        keys, values = {}, {}
        for k in range(-ORDER, ORDER + 1):
            own = np.flatnonzero(part == k)
            own = own[np.argsort(key[own])]
            keys[k], values[k] = key[own].astype(np.int64), value[own].astype(np.float32)
        return cls(keys, values)

    def look(self, part: int, grams: list[bytes], seed: int) -> tuple[np.ndarray, np.ndarray]:
        """Whether each gram is there, and its value or 0."""
        digest = xxhash.xxh64_intdigest
        keys = np.array([digest(g, seed) for g in grams], np.uint64).view(np.int64)
        own = self.keys[part]
        if not len(own):
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.float32)
        at = np.minimum(np.searchsorted(own, keys), len(own) - 1)
        there = own[at] == keys
        return there, np.where(there, self.values[part][at], np.float32(0))

    def add_logs(self, grams: list[str], left: np.ndarray, total: np.ndarray, seed: int) -> None:
        """Add the log probabilities of the grams at `left` to `total`."""
        for k in range(ORDER, 0, -1):
            there, value = self.look(k, [grams[i][ORDER - k :].encode() for i in left.tolist()], seed)
            total[left[there]] += value[there]
            left = left[~there]
            if not len(left):
                return
            total[left] += self.look(-k, [grams[i][ORDER - k : -1].encode() for i in left.tolist()], seed)[1]
        total[left] += self.look(0, [b""], seed)[1][0]


def _bucket(text: str, size: int) -> int:
    """As pmod(xxhash64(text), size) in Spark, for a power of two."""
    return xxhash.xxh64_intdigest(text.encode(), 42) % size


@dataclass
class Model:
    """(first cell, last cell, broadcast Part) for each part. Only one is in memory at a time."""

    parts: list[tuple[int, int, Broadcast]]
    cells: dict[str, int] = field(default_factory=dict)

    def logs(self, wanted: dict[str, list[str]]) -> dict[str, np.ndarray]:
        """For each language the log probabilities of the last letters of the given grams."""
        jobs = []
        for lang, grams in wanted.items():
            base = _bucket(lang, LANG_CELLS) * LETTER_CELLS
            for c in {g[-2] for g in grams} - self.cells.keys():
                self.cells[c] = _bucket(c, LETTER_CELLS)
            cells = np.array([base + self.cells[g[-2]] for g in grams], np.int64) if len(self.parts) > 1 else None
            jobs.append((lang, xxhash.xxh64_intdigest(lang.encode(), 42), grams, cells, np.zeros(len(grams))))
        for first, last, shared in self.parts:
            for _, seed, grams, cells, total in jobs:
                left = np.arange(len(grams)) if cells is None else np.flatnonzero((cells >= first) & (cells <= last))
                if len(left):
                    shared.value.add_logs(grams, left, total, seed)
            if len(self.parts) > 1:
                vars(shared).pop("_value", None)
        return {lang: total for lang, _, _, _, total in jobs}


class Scorer:
    """Log probabilities of texts. What grams cost is remembered, up to a bound."""

    def __init__(self, model: Model):
        self.model = model
        self.known: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def logs(self, langs: list[str], texts: list[bytes]) -> list[float | None]:
        """Minus the log probability of each text for each letter or digit of it; null for texts without words. Signs add to a
        text's cost and not to its length."""
        of: dict[str, list[int]] = {}
        for i, lang in enumerate(langs):
            of.setdefault(lang, []).append(i)
        codes = [gram_codes(x) for x in texts]
        merged = {lang: np.unique(np.concatenate([codes[i] for i in own]), return_inverse=True) for lang, own in of.items()}
        missing = {}
        for lang, (own, _) in merged.items():
            have = self.known.get(lang)
            if have is None or len(have[0]) > CODES_HELD:
                have = self.known[lang] = (np.zeros(0, np.uint64), np.zeros(0))
            at = np.searchsorted(have[0], own)
            at[at == len(have[0])] = 0
            lacking = own if not len(have[0]) else own[have[0][at] != own]
            if len(lacking):
                missing[lang] = lacking
        found = self.model.logs({lang: gram_texts(x) for lang, x in missing.items()})
        out: list[float | None] = [None] * len(texts)
        for lang, (own, inverse) in merged.items():
            have = self.known[lang]
            if lang in missing:
                both = np.r_[have[0], missing[lang]]
                order = np.argsort(both)
                have = self.known[lang] = both[order], np.r_[have[1], found[lang]][order]
            if not len(own):
                continue
            each = have[1][np.searchsorted(have[0], own)][inverse]
            start = 0
            for i in of[lang]:
                n = len(codes[i])
                if n:
                    letters = int(_is_letter()[(codes[i] & np.uint64(0xFFFF)).astype(np.int64)].sum())
                    out[i] = -float(each[start : start + n].sum()) / max(1, letters)
                start += n
        return out


def cut_cells(sizes: dict[int, int], shared: dict[int, int], rows: int) -> list[tuple[int, int]]:
    """(first, last) of runs of cells that together have all cells. A run has about `rows` rows, what its languages share
    included; a cell is never cut."""
    runs: list[list[int]] = [[0, LANG_CELLS * LETTER_CELLS - 1]]
    held, langs = 0, set()
    for cell in sorted(sizes.keys() | {lang * LETTER_CELLS for lang in shared}):
        lang = cell // LETTER_CELLS
        more = sizes.get(cell, 0) + (0 if lang in langs else shared.get(lang, 0))
        if held and held + more > rows:
            runs[-1][1] = cell - 1
            runs.append([cell, LANG_CELLS * LETTER_CELLS - 1])
            held, langs = 0, set()
            more = sizes.get(cell, 0) + shared.get(lang, 0)
        held += more
        langs.add(lang)
    return [(a, b) for a, b in runs]


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """The model of all words of all documents; a null language is a language of its own. The driver holds one part at a
    time, and how many rows each cell has."""
    given = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("")).alias("lang"), utf8(f"`{text}`").alias("raw"))
    counts = given.mapInArrow(_gram_counts, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rows = stored(kneser_ney(stored(counts, "grams")), "model")
    common = F.abs("part") <= 1
    found = rows.groupBy("cell", common.alias("common")).count().collect()
    sizes = {r.cell: r["count"] for r in found if not r.common}
    runs = cut_cells(sizes, {r.cell // LETTER_CELLS: r["count"] for r in found if r.common}, PART_ROWS)
    if len(runs) > 1:
        rows = stored(rows.repartitionByRange(len(runs), "cell"), "model")  # a part is then in few files
    parts = []
    for first, last in runs:
        langs = F.col("cell").between(first - first % LETTER_CELLS, last)
        own = rows.where(F.when(common, langs).otherwise(F.col("cell").between(first, last)) & langs)
        parts.append((first, last, docs.sparkSession.sparkContext.broadcast(Part.of(own.select("part", "key", "value").toArrow()))))
    return Model(parts)


def with_counts(docs: DataFrame, model: Model, text: str = "text", lang: str = "lang") -> DataFrame:
    """docs without the text, and the counts of text_counts and log_perplexity (null for texts without words)."""
    rest = [c for c in docs.columns if c != text]
    own_lang, raw = spare(docs, "model_lang", "raw")
    given = docs.select(*[F.col(f"`{c}`") for c in rest], F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("")).alias(own_lang), utf8(f"`{text}`").alias(raw))
    at_once = ROWS_AT_ONCE if len(model.parts) == 1 else ROWS_FOR_PARTS
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Model(model.parts))
        for batch in batches:
            rows, logs = [], []
            for start in range(0, batch.num_rows, at_once):
                part = batch.slice(start, at_once)
                texts = part.column(len(rest) + 1).to_pylist()
                logs += scorer.logs(part.column(len(rest)).to_pylist(), texts)
                rows += map(text_counts, texts)
            cols = [pa.array([r[i] for r in rows], pa.int64()) for i in range(5)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], *cols, pa.array(logs, pa.float64())], names=[*rest, *counts, "log_perplexity"])

    fields = [*(T.StructField(c, T.LongType()) for c in counts), T.StructField("log_perplexity", T.DoubleType())]
    return given.mapInArrow(run, T.StructType([*(docs.schema[c] for c in rest), *fields]))


def perplexity_bands(scored: DataFrame, width: float = WIDTH, least: float = LEAST) -> DataFrame:
    """(lang, low, high) of log perplexity, from all rows that pass the base rules: the median, less and more `width`
    times the scaled median deviation, `least` at least. Medians are of a histogram, so that no language's values meet
    in one task."""

    def median(bins: DataFrame, name: str) -> DataFrame:
        upto = F.sum("n").over(Window.partitionBy("lang").orderBy("bin"))
        bins = bins.withColumns({"upto": upto, "all": F.sum("n").over(Window.partitionBy("lang"))})
        return bins.where(2 * F.col("upto") >= F.col("all")).groupBy("lang").agg((F.min("bin") / _BIN).alias(name))

    fit = scored.where(~base_failed(F.col("n_words"), F.col("n_repeat_words")))
    bins = fit.groupBy("lang", F.round(F.col("log_perplexity") * _BIN).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    bins = stored(bins, "bins")
    middle = median(bins, "middle")
    apart = bins.join(middle, "lang").withColumn("bin", F.abs(F.col("bin") - F.round(F.col("middle") * _BIN).cast("long")))
    spread = median(apart.groupBy("lang", "bin").agg(F.sum("n").alias("n")), "spread")
    reach = F.greatest(F.lit(least), width * 1.4826 * F.col("spread"))
    bands = middle.join(spread, "lang")
    return bands.select("lang", (F.col("middle") - reach).alias("low"), (F.col("middle") + reach).alias("high"))


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", width: float = WIDTH) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, perplexity, one row for each
    row of docs.

    Letters are counted in Spark over all documents, in grams of ORDER letters for each language, in words and from word to
    word, capitals and signs as they are; a modified Kneser-Ney model is made of the counts and kept in sorted arrays of 64-bit hashes, in as many parts as it takes. A
    document that passes the base rules is kept if its perplexity is within its language's band. Null text is empty:
    no words, fails the base rules, and has no perplexity. A null language is one of its own. Repeated rows are rows of
    their own; extra columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("")).alias("lang"), F.col(f"`{text}`").alias("text"))
    scored = stored(with_counts(rows, train(rows)), "scored")
    bands = perplexity_bands(scored, width)
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    x = F.col("log_perplexity")
    more = SHORT / F.sqrt(F.greatest(F.col("n_words"), F.lit(1)))
    inside = F.coalesce((x >= F.col("low") - more) & (x <= F.col("high") + more), F.lit(True))
    return scored.join(F.broadcast(bands), "lang", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & inside).alias("kept"), F.exp(x).alias("perplexity"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: all documents."""
    return judge(read(spark, sf_dir, "documents"))
