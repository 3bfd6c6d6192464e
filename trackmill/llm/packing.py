"""Documents packed into sequences of a fixed number of tokens."""

from __future__ import annotations

import bisect
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read, spare, stored, utf8

CAPACITY, END_ID, SHARDS = 4096, 1, 128


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Ids(dict):
    """For a run of bytes without ASCII white space, its token ids as little-endian unsigned 32-bit integers.

    The vocabulary splits at white space and drops it, so that a text's ids are those of its runs, one after another.
    Runs repeat; a bounded number is kept. Runs of ASCII and Latin-1 letters, digits and signs need only be
    lower-cased and cut by the vocabulary's own pattern before its merges; all others go through the whole tokenizer.
    """

    PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
    PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")

    def __init__(self, path: str, runs: int):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.runs = runs
        self.whole = Tokenizer.from_file(path)
        self.merge = self.whole.model.tokenize
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.as_letters = {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in kept)}
        self.pieces: dict[str, bytes] = {}

    def __missing__(self, run: bytes) -> bytes:
        text = run.decode("utf-8", "replace")
        if self.PLAIN.fullmatch(text) and "<|" not in text:
            ids = b"".join([self.pieces.get(x) or self.piece(x) for x in self.PIECE.findall(text.lower())])
        else:
            ids = self.packed(self.whole.encode(text, add_special_tokens=False).ids)
        if len(self) >= self.runs:
            self.clear()
        self[run] = ids
        return ids

    def piece(self, text: str) -> bytes:
        letters = text if text.isascii() else text.encode().decode("latin-1").translate(self.as_letters)
        if len(self.pieces) >= self.runs // 2:
            self.pieces.clear()
        ids = self.pieces[text] = self.packed([t.id for t in self.merge(letters)])
        return ids

    @staticmethod
    def packed(ids: list[int]) -> bytes:
        return b"".join([i.to_bytes(4, "little") for i in ids])


#: Runs that a worker remembers, about 300 bytes each.
CACHED_RUNS = 500_000
_IDS: dict[tuple[str, int], _Ids] = {}


def token_bytes(text: bytes, path: str, cached_runs: int = CACHED_RUNS) -> bytes:
    """All ids of a text, four bytes each."""
    key = (path, cached_runs)
    if key not in _IDS:
        _IDS[key] = _Ids(path, cached_runs)
    return b"".join(map(_IDS[key].__getitem__, text.split()))


def token_pieces(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    vocabulary: str | None = None,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    with_ids: bool = False,
    cached_runs: int = CACHED_RUNS,
    extra: tuple[str, ...] = (),
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, with_ids the ids (binary, four bytes each), and the
    columns named in `extra`, which must not be called like one of these.

    A document is its ids and then end_id; only longer ones are cut, into pieces of `capacity` ids. A null text is
    empty and has end_id alone. Rows with equal doc_id are documents of their own. Extra columns are ignored.
    """
    path = vocabulary or default_vocabulary()
    given = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), utf8(f"`{text}`").alias("raw"), *[F.col(f"`{c}`") for c in extra])
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, piece, start, length, crc, raw = [], [], [], [], [], []
            for i, x in enumerate(batch.column(1)):
                ids = token_bytes(x.as_py(), path, cached_runs) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    row.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    raw += [part] if with_ids else []
            cols = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            more = [batch.column(2 + k).take(pa.array(row, pa.int64())) for k in range(len(extra))]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(raw, pa.binary())] * with_ids + more, names=names)

    fields = [given.schema["doc_id"], T.StructField("piece", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32"))]
    fields += [T.StructField("ids", T.BinaryType())] * with_ids + [given.schema[c] for c in extra]
    names = [f.name for f in fields]
    return given.mapInArrow(run, T.StructType(fields))


def packing_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Where the items of each length go: runs (length, from, to, per_sequence, sequence, offset).

    The items of a length are numbered; items from..to-1 go `per_sequence` to each sequence from `sequence` on, the
    first of them at `offset`. The plan knows counts only, at most one for each length, so its size is bounded by the
    capacity, not by the number of documents.

    Items over a third of the capacity go first, longest first: at most two fit in a sequence, and each is matched
    with the longest other one that fits. The shorter items, longest first, then go to the smallest gap that holds
    them, and to new sequences when there is none.
    """
    left = {k: n for k, n in counts.items() if n}
    taken: dict[int, int] = defaultdict(int)
    runs, gaps, opened, total = [], [], defaultdict(list), 0

    def put(length: int, n: int, each: int, first: int, gap: int) -> None:
        """n sequences of that gap from `first` on get `each` items."""
        runs.append((length, taken[length], taken[length] + n * each, each, first, capacity - gap))
        taken[length] += n * each
        left[length] -= n * each

    def leave(gap: int, first: int, n: int) -> None:
        if gap and n:
            if not opened[gap]:
                bisect.insort(gaps, gap)
            opened[gap].append((first, n))

    large = sorted(k for k in left if 3 * k > capacity)
    for a in reversed(large):
        i = bisect.bisect_right(large, min(a, capacity - a)) - 1
        while left[a]:
            while i >= 0 and not left[large[i]]:
                i -= 1
            b = large[i] if i >= 0 else 0
            if b == a and left[a] == 1:
                i -= 1
                continue
            n = left[a] // 2 if b == a else min(left[a], left[b]) if b else left[a]
            put(a, n, 1, total, capacity)
            if b:
                put(b, n, 1, total, capacity - a)
            leave(capacity - a - b, total, n)
            total += n
    for s in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        while left[s]:
            at = bisect.bisect_left(gaps, s)
            if at < len(gaps):
                gap = gaps[at]
                first, n = opened[gap].pop()
                if not opened[gap]:
                    gaps.pop(at)
            else:
                gap, first, n = capacity, total, -(-left[s] // (capacity // s))
                total += n
            each = min(gap // s, left[s])
            used = min(n, left[s] // each)
            put(s, used, each, first, gap)
            leave(gap - each * s, first, used)
            leave(gap, first + used, n - used)
    return runs


def pack(pieces: DataFrame, capacity: int = CAPACITY, length: str = "length") -> DataFrame:
    """pieces and sequence_id, offset: no sequence is longer than `capacity`, and each is gapless from 0.

    Lengths are counted in Spark; only the counts, one for each length up to the capacity, reach the driver, which
    plans which numbers of each length go where. Items get their number within their length from counts of hashed
    shards and a window over each shard, so that a length that very many items have is not one task. Lengths must be
    1 to capacity. Pieces should be a stored table: it is read more than once. Pieces as long as a sequence are one each,
    with a negative number, and need no plan. An empty table gives an empty result.
    """
    one = [(-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset")]
    full = pieces.where(F.col(length) == capacity).select(*pieces.columns, *one)
    pieces = pieces.where(F.col(length) < capacity)
    items = pieces.withColumn("pack_shard", F.pmod(F.xxhash64(*[c for c in pieces.columns if c != "ids"]), F.lit(SHARDS)))
    sizes = stored(items.groupBy(F.col(length).alias("pack_length"), "pack_shard").count(), "lengths")
    counts = {r[0]: r[1] for r in sizes.groupBy("pack_length").agg(F.sum("count")).collect()}  # at most capacity rows
    schema = "run_length long, run_from long, run_to long, run_each long, run_sequence long, run_offset long"
    plan = pieces.sparkSession.createDataFrame(packing_plan(counts, capacity), schema)
    before = Window.partitionBy("pack_length").orderBy("pack_shard").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("pack_before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    sizes = sizes.withColumnRenamed("pack_shard", "size_shard")
    order = Window.partitionBy(length, "pack_shard").orderBy(*[c for c in pieces.columns if c not in ("ids", length)])
    items = items.withColumn("pack_place", F.row_number().over(order) - 1)
    items = items.join(sizes, (F.col(length) == F.col("pack_length")) & (F.col("pack_shard") == F.col("size_shard")))
    number = F.col("pack_before") + F.col("pack_place")
    here = (F.col(length) == F.col("run_length")) & (number >= F.col("run_from")) & (number < F.col("run_to"))
    since = number - F.col("run_from")
    placed = items.join(F.broadcast(plan), here).select(
        *pieces.columns,
        (F.col("run_sequence") + F.floor(since / F.col("run_each"))).cast("long").alias("sequence_id"),
        (F.col("run_offset") + F.pmod(since, F.col("run_each")) * F.col(length)).cast("long").alias("offset"),
    )
    return placed.unionByName(full)


def pack_documents(docs: DataFrame, **options) -> DataFrame:
    """The pieces of all documents with their places; options as for token_pieces."""
    pieces = stored(token_pieces(docs, **options), "pieces")
    return pack(pieces, options.get("capacity", CAPACITY))


def in_file_order(docs: DataFrame, name: str) -> DataFrame:
    """docs and a long column `name`, which grows along a stored table: by file and row, or else by partition and row."""
    try:
        file, row = F.col("_metadata.file_name"), F.col("_metadata.row_index")
        part = F.coalesce(F.regexp_extract(file, r"part-(\d+)", 1).try_cast("long"), F.lit(0))
        return docs.select("*", (F.shiftleft(part, 33) + row).alias(name))
    except AnalysisException:  # not read from Parquet files
        return docs.withColumn(name, F.monotonically_increasing_id())


def pack_in_order(docs: DataFrame, **options) -> DataFrame:
    """As pack_documents, and place, the document's place in the stored table, and sequence_place, the place of the
    sequence's first piece: sequences read by it come in the order of the documents, as far as they can. Rows of one
    document (in a mixture of several epochs) are told apart by their place. Where docs has a column place, it is
    ignored."""
    (place,) = spare(docs, "place")
    pieces = stored(token_pieces(in_file_order(docs, place), extra=(place,), **options).withColumnRenamed(place, "place"), "pieces")
    out = stored(pack(pieces, options.get("capacity", CAPACITY)), "packed")
    first = out.where("offset = 0").select("sequence_id", F.col("place").alias("sequence_place"))
    return out.join(first, "sequence_id").select(*out.columns, "sequence_place")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: whole texts, sequences of 4096 tokens."""
    return pack_documents(read(spark, sf_dir, "documents"))
