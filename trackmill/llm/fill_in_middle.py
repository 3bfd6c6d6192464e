"""Documents cut in three and dealt anew, so that a model learns to fill in the middle."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read, spare, utf8

#: Whether a byte is ASCII white space.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


class Cuts:
    """Converts cuts of one text between code points and UTF-8 bytes.

    Only characters of more than one byte are recorded: their places, and how many bytes the text has gained by each. Between
    two of them the two counts differ by a constant, so a cut is found by one search and an addition; a text that is all ASCII
    has an empty index.
    """

    def __init__(self, raw: bytes):
        at = np.flatnonzero(np.frombuffer(raw, np.uint8) >= 0xC0) if not raw.isascii() else np.zeros(0, np.int64)
        lead = np.frombuffer(raw, np.uint8)[at]
        excess = 1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)
        self.gained = np.concatenate([np.zeros(1, np.int64), np.cumsum(excess)])
        self.byte_at = at
        self.char_at = at - self.gained[:-1]
        self.n_chars = len(raw) - int(self.gained[-1])

    def to_bytes(self, chars):
        """The byte before which as many code points lie."""
        return chars + self.gained[np.searchsorted(self.char_at, chars, "left")]

    def to_chars(self, cut):
        """The code points before a byte at which a character starts or the text ends."""
        return cut - self.gained[np.searchsorted(self.byte_at, cut, "left")]


def token_ends(raw: bytes) -> np.ndarray:
    """The bytes after which tokens end. A token is a word with the white space before it, or the white space at the end."""
    if not raw:
        return np.zeros(0, np.int64)
    space = _SPACE[np.frombuffer(raw, np.uint8)]
    ends = np.flatnonzero(~space & np.append(space[1:], True)) + 1
    return np.append(ends, len(raw)) if space[-1] else ends


def fill_in_middle(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    unit: str = "token",
    rate: int = 50,
    spm: int = 80,
    seed: int = 42,
    marks: tuple[str, str, str] = ("<P>", "<S>", "<M>"),
) -> DataFrame:
    """docs with text as the training text, and n, form, prefix_chars, middle_chars, prefix_bytes, middle_bytes (or, where docs
    have such columns, the names with underscores before them).

    A text of n units (tokens, see token_ends, or code points, with unit="char") is cut twice; the cuts are the remainders by
    n + 1 of two numbers that a digest of the seed and the doc_id gives, so a task that runs again cuts alike. Of a hundred
    documents `rate` are dealt, and of a hundred of those `spm` are written suffix first: "psm" is P prefix S suffix M middle,
    "spm" is S suffix P prefix M middle, with the marks of P, S and M. The others, empty texts and texts that have a mark are
    "plain" and stay as they are; their counts of characters and bytes are null. Cuts in one measure are converted to the other by Cuts.

    Null text is an empty one; a null doc_id gives the digest of the word null. Rows are dealt each by itself: repeated rows and
    ids come out alike, very long texts are cut whole, extra columns stay, an empty table gives an empty result. Marks must not be
    empty, start inside or hold one another.
    """
    if unit not in ("token", "char"):
        raise ValueError("unit must be token or char")
    n, form, p_chars, m_chars, p_bytes, m_bytes, raw, key = spare(docs, "n", "form", "prefix_chars", "middle_chars", "prefix_bytes", "middle_bytes", "raw", "key")
    kept = [c for c in docs.columns if c != text]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], utf8(f"`{text}`").alias(raw), F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("null")).alias(key))
    p, s, m = (x.encode() for x in marks)

    def one(x: bytes, name: str) -> tuple:
        h = bytes.fromhex(hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()[:32])
        h1, h2, h3, h4 = (int.from_bytes(h[i : i + 4], "big") for i in (0, 4, 8, 12))
        cuts = ends = None
        if unit == "token":
            ends = token_ends(x)
            units = len(ends)
        else:
            cuts = Cuts(x)
            units = cuts.n_chars
        if not x or h3 % 100 >= rate or p in x or s in x or m in x:
            return x, units, "plain", None, None, None, None
        low, high = sorted((h1 % (units + 1), h2 % (units + 1)))
        cuts = cuts or Cuts(x)
        if ends is None:
            a, b = (int(cuts.to_bytes(c)) for c in (low, high))
        else:
            a, b = (int(ends[c - 1]) if c else 0 for c in (low, high))
            low, high = (int(cuts.to_chars(c)) for c in (a, b))
        prefix, middle, suffix = x[:a], x[a:b], x[b:]
        if h4 % 100 < spm:
            return s + suffix + p + prefix + m + middle, units, "spm", low, high - low, a, b - a
        return p + prefix + s + suffix + m + middle, units, "psm", low, high - low, a, b - a

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [one(x.as_py(), k.as_py()) for x, k in zip(batch.column(len(kept)), batch.column(len(kept) + 1))]
            cols = list(zip(*out)) or [()] * 7
            types = [pa.binary(), pa.int64(), pa.string(), *[pa.int64()] * 4]
            arrays = [pa.array(c, t) for c, t in zip(cols, types)]
            arrays[0] = arrays[0].cast(pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *arrays], names=[*kept, text, n, form, p_chars, m_chars, p_bytes, m_bytes])

    fields = [T.StructField(text, T.StringType()), T.StructField(n, T.LongType()), T.StructField(form, T.StringType())]
    fields += [T.StructField(c, T.LongType()) for c in (p_chars, m_chars, p_bytes, m_bytes)]
    out = rows.mapInArrow(dealt, T.StructType([*(docs.schema[c] for c in kept), *fields]))
    return out.select(*[f"`{c}`" for c in docs.columns], n, form, p_chars, m_chars, p_bytes, m_bytes)


def restored(output: Column, form: Column, marks: tuple[str, str, str] = ("<P>", "<S>", "<M>")) -> Column:
    """The text that fill_in_middle has dealt, rebuilt from its output and form alone."""
    split = F.split(output, "|".join(rf"\Q{x}\E" for x in marks), -1)  # first comes what is before the first mark: nothing
    first, second, middle = (F.element_at(split, i) for i in (2, 3, 4))
    return F.when(form == "plain", output).when(form == "psm", F.concat(first, middle, second)).otherwise(F.concat(second, middle, first))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: every document, cut between tokens."""
    out = fill_in_middle(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("text", 256).alias("output_sha256"),
        F.sha2(restored(F.col("text"), F.col("form")), 256).alias("restored_sha256"),
    )


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, 'null')) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS tokens FROM documents),
u AS (SELECT *, len(tokens) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS low, greatest(h1 % (n + 1), h2 % (n + 1)) AS high,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
                  WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(tokens[1:low], '') AS prefix, array_to_string(tokens[low + 1:high], '') AS middle, array_to_string(tokens[high + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN text ELSE prefix || middle || suffix END) AS restored_sha256
FROM p
"""
