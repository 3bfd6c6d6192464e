"""Lines that repeat across documents; two Bloom filters keep lines seen once out of the shuffle."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WHITESPACE, read, spare, stored, utf8

#: Bits of each filter for a line of the input, so that few lines found once are suspected, whatever the size.
BITS_PER_LINE = 10
#: Bits of a chunk; all probes of a key are in one chunk. A part (32 MB) is what is broadcast, and held, at a time.
CHUNK, PART_CHUNKS = 1 << 20, 256
#: Hashes that a task holds before it sends them.
HELD = 4_000_000
#: A key with more than one in HOT_SHARE of the suspected lines is not shuffled to its drop.
HOT_SHARE = 1000
_PROBES = 4


def line_keys(text: bytes) -> list[bytes]:
    """Of each line: ASCII white space stripped at both ends, A-Z lower-cased."""
    return [line.strip(WHITESPACE).lower() for line in text.split(b"\n")]


def _hashes(keys: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)


def _chunk_of(h: np.ndarray, chunks: int) -> np.ndarray:
    """Of a power of two chunks."""
    return (h & np.uint64(chunks - 1)).astype(np.int64)


def _places(h: np.ndarray) -> np.ndarray:
    """The places of each key in its chunk, a row for each."""
    step = (h >> np.uint64(32)) | np.uint64(1)
    at = h[:, None] + step[:, None] * np.arange(_PROBES, dtype=np.uint64)
    return ((at * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - CHUNK.bit_length() + 1)).astype(np.int64)


def _filters(batches: Iterator[pa.RecordBatch], chunks: int) -> Iterator[pa.RecordBatch]:
    """A task's two filters, a row for each chunk that is not empty: keys found in a document (once), and in two or more
    (twice). A chunk with few keys is sent as their hashes, which are its places, else as compressed bits."""

    def coded(h: np.ndarray, as_bits: bool) -> bytes:
        if not as_bits:
            return h.tobytes()
        bits = np.zeros(CHUNK, np.uint8)
        bits[_places(h).ravel()] = 1
        return zlib.compress(np.packbits(bits).tobytes(), 1)

    def rows(held: list[np.ndarray]) -> pa.RecordBatch:
        h, n = np.unique(np.concatenate(held) if held else np.zeros(0, np.uint64), return_counts=True)
        order = np.argsort(_chunk_of(h, chunks), kind="stable")
        h, n = h[order], n[order]
        of = _chunk_of(h, chunks)
        starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(h) else np.zeros(0, np.int64)
        out = []
        for i, j in zip(starts.tolist(), [*starts[1:].tolist(), len(h)]):
            as_bits = 64 * (j - i) > CHUNK // 4
            out.append((int(of[i]), as_bits, coded(h[i:j], as_bits), coded(h[i:j][n[i:j] > 1], as_bits)))
        types = (pa.int32(), pa.bool_(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=["chunk", "bits", "once", "twice"])

    held, size = [], 0
    for batch in batches:
        keys: list[bytes] = []
        for x in batch.column(0):
            keys += set(line_keys(x.as_py())) - {b""}
            if len(keys) > 100_000:
                held.append(_hashes(keys))
                size += len(keys)
                keys = []
        held.append(_hashes(keys))
        size += len(keys)
        if size > HELD:
            yield rows(held)
            held, size = [], 0
    yield rows(held)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in order of chunk. Twice: in a second filter, or in two first ones."""
    chunk, once, twice = None, np.zeros(CHUNK, np.uint8), np.zeros(CHUNK, np.uint8)

    def done() -> pa.RecordBatch:
        own = [(chunk, np.packbits(twice).tobytes())] if chunk is not None and twice.any() else []
        return pa.RecordBatch.from_arrays([pa.array([c for c, _ in own], pa.int32()), pa.array([x for _, x in own], pa.binary())], names=["chunk", "twice"])

    for batch in batches:
        for c, bits, a, b in zip(*batch.columns):
            if c.as_py() != chunk:
                yield done()
                chunk = c.as_py()
                once[:], twice[:] = 0, 0
            a, b = a.as_py(), b.as_py()
            if bits.as_py():
                a, b = (np.unpackbits(np.frombuffer(zlib.decompress(x), np.uint8)) for x in (a, b))
                twice |= b | (once & a)
                once |= a
            else:
                a, b = (_places(np.frombuffer(x, np.uint64)) for x in (a, b))
                twice[b.ravel()] = 1
                twice[a[once[a].all(axis=1)].ravel()] = 1
                once[a.ravel()] = 1
    yield done()


def chunks_for(lines: int) -> int:
    """A power of two of chunks with BITS_PER_LINE bits for each line at least."""
    return 1 << max(0, -(-lines * BITS_PER_LINE // CHUNK) - 1).bit_length()


def seen_twice(texts: DataFrame, chunks: int) -> list[Broadcast]:
    """The second filter of all documents' lines, in parts of PART_CHUNKS chunks. It may hold lines that are in one
    document only, and never lacks one that is in two. The driver holds one part at a time."""
    parts = texts.mapInArrow(lambda it: _filters(it, chunks), "chunk int, bits boolean, once binary, twice binary")
    parts = parts.repartition("chunk").sortWithinPartitions("chunk")
    merged = stored(parts.mapInArrow(_merged, "chunk int, twice binary"), "seen-twice")
    out = []
    for first in range(0, chunks, PART_CHUNKS):
        size = min(PART_CHUNKS, chunks - first)
        whole = bytearray(size * CHUNK // 8)
        for r in merged.where(F.col("chunk").between(first, first + size - 1)).toLocalIterator():
            at = (r.chunk - first) * CHUNK // 8
            whole[at : at + CHUNK // 8] = r.twice
        out.append(texts.sparkSession.sparkContext.broadcast(bytes(whole)))
    return out


def _suspected(h: np.ndarray, parts: list[Broadcast], chunks: int, each: int) -> np.ndarray:
    """Whether the second filter, in parts of `each` chunks, has each hash. One part is in memory at a time."""
    chunk, places = _chunk_of(h, chunks), _places(h)
    out = np.zeros(len(h), bool)
    for k, part in enumerate(parts):
        own = np.flatnonzero(chunk // each == k)
        if len(own):
            bits = np.frombuffer(part.value, np.uint8)
            at = places[own] + ((chunk[own] - k * each) * CHUNK)[:, None]
            out[own] = ((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=1)
            if len(parts) > 1:
                vars(part).pop("_value", None)
    return out


def line_dedup(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    min_docs: int = 10,
    keep_first: bool = False,
    chunks: int | None = None,
) -> DataFrame:
    """docs with repeated lines left out of their text, and n_lines, n_dropped, kept_sha256 (or, where docs have such
    columns, the names with underscores before them).

    A line's key is the line without ASCII white space at its ends and with A-Z lower-cased; empty keys never count.
    Keys found in at least `min_docs` (2 or more) rows of docs lose all their lines or, with keep_first, all but the
    first in the row with the smallest doc_id. The lines that stay are joined by "\\n".

    First pass: each task puts its documents' keys into two Bloom filters, and the filters are merged chunk by chunk.
    Their size follows from the counted lines (or is `chunks`, a power of two). Second pass: lines that miss the second
    filter stay where they are. Only suspects are shuffled, counted exactly by their whole keys (summed before the
    shuffle, so that a line in very many documents is a few rows), and joined back; keys with over 1/HOT_SHARE of the
    suspects, at most HOT_SHARE, are broadcast as digests instead. A null text is an empty one and has one empty line; it comes out empty. Rows with equal doc_id and text
    are documents of their own and are treated alike; with keep_first each of them keeps a first occurrence. Null
    doc_ids come last in the order. An empty table gives an empty result.
    """
    names = spare(docs, "n_lines", "n_dropped", "kept_sha256", "h", "raw", "gone", "to_id", "to_h")
    n_lines, n_dropped, kept_sha256, h, raw, gone, to_id, to_h = names
    given = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(f"`{text}`").alias("h"), utf8(f"`{text}`").alias("raw"))
    if chunks is None:
        chunks = chunks_for(docs.agg(F.sum(F.coalesce(F.regexp_count(f"`{text}`", F.lit("\n")), F.lit(0)) + 1)).first()[0] or 0)
    parts, each = seen_twice(given.select("raw"), chunks), PART_CHUNKS

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, at, keys = [], [], []
            for i, x in enumerate(batch.column(2)):
                for j, k in enumerate(line_keys(x.as_py())):
                    if k:
                        rows.append(i)
                        at.append(j)
                        keys.append(k)
            hit = np.flatnonzero(_suspected(_hashes(keys), parts, chunks, each)).tolist() if keys else []
            rows, at, keys = [rows[i] for i in hit], [at[i] for i in hit], [keys[i] for i in hit]
            had: set[tuple[int, bytes]] = set()
            news = [not ((i, k) in had or had.add((i, k))) for i, k in zip(rows, keys)]
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array(at, pa.int32()), pa.array(keys, pa.binary()), pa.array(news, pa.bool_())],
                names=["doc_id", "h", "line", "key", "is_new"],
            )

    schema = T.StructType([given.schema["doc_id"], given.schema["h"], T.StructField("line", T.IntegerType()), T.StructField("key", T.BinaryType()), T.StructField("is_new", T.BooleanType())])
    found = stored(given.mapInArrow(suspects, schema), "suspects")
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "h", "line")
    repeated = found.groupBy("key").agg(F.count_if("is_new").alias("n"), F.min(place).alias("place"))
    repeated = stored(repeated.where(F.col("n") >= min_docs), "repeated")
    hot = F.col("n") > max(1, found.count() // HOT_SHARE)
    digest = F.sha2("key", 256)
    often = repeated.where(hot).select(digest.alias("digest"), "place")
    dealt = found.withColumn("digest", digest).join(F.broadcast(often), "digest", "left")
    seldom = dealt.where("place IS NULL").drop("digest", "place").join(repeated.where(~hot).select("key", "place"), "key")
    drops = seldom.select("doc_id", "h", "line", "place").unionByName(dealt.where("place IS NOT NULL").select("doc_id", "h", "line", "place"))
    if keep_first:
        drops = drops.where(~place.eqNullSafe(F.col("place")))
    # a set: repeated rows have the same lines to drop
    drops = drops.groupBy(F.col("doc_id").alias(to_id), F.col("h").alias(to_h)).agg(F.collect_set("line").alias(gone))

    kept = [c for c in docs.columns if c != text]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], utf8(f"`{text}`").alias(raw), F.xxhash64(f"`{text}`").alias(h))
    same = F.col(f"`{doc_id}`").eqNullSafe(F.col(to_id)) & (F.col(h) == F.col(to_h))
    rows = rows.join(drops, same, "left").select(*[F.col(f"`{c}`") for c in kept], raw, gone)

    def rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, dropped, sums = [], [], [], []
            for x, out in zip(batch.column(len(kept)), batch.column(len(kept) + 1)):
                x, out = x.as_py(), set(out.as_py() or ())
                counts.append(x.count(b"\n") + 1)
                dropped.append(len(out))
                if out:
                    x = b"\n".join([line for i, line in enumerate(x.split(b"\n")) if i not in out])
                texts.append(x)
                sums.append(hashlib.sha256(x).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(kept)], pa.array(texts, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64()), pa.array(dropped, pa.int64()), pa.array(sums)],
                names=[*kept, text, n_lines, n_dropped, kept_sha256],
            )

    fields = [T.StructField(text, T.StringType()), T.StructField(n_lines, T.LongType()), T.StructField(n_dropped, T.LongType()), T.StructField(kept_sha256, T.StringType())]
    out = rows.mapInArrow(rebuilt, T.StructType([*(docs.schema[c] for c in kept), *fields]))
    return out.select(*[f"`{c}`" for c in docs.columns], n_lines, n_dropped, kept_sha256)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: keys in 10 or more documents lose all their lines."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs, min_docs=10).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS i FROM d),
k AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
hot AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10),
m AS (SELECT k.*, hot.key IS NOT NULL AS gone FROM k LEFT JOIN hot USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY r
"""
