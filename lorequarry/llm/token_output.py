"""Operator 8: token ids as a binary output of frequency-ranked, byte-aligned variable-length codes.

The format. A file is a Parquet file of blocks in ascending document order. A block holds whole documents:
`control`, one byte for four ids with two bits each (the number of data bytes less one), and `data`, the
little-endian bytes of each id's frequency rank, one to four. `docs` and `counts` give the documents and
their numbers of ids. A side table maps ranks to ids; rank 0 is the most frequent id of all documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, staged, tidied
from .pretokens import library_encoder

#: Ids after which a block is closed.
BLOCK_IDS = 1 << 18
#: Slots of a worker's table of pieces. It is the larger, the fewer pieces are merged again; this one takes 100 MB.
TABLE_BITS = 22

# For each control byte: the sizes of its four codes, and their sum.
_SIZES = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], np.int64)


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of the ranks (uint32)."""
    r = ranks.astype("<u4")
    size = 1 + (r > 0xFF).astype(np.uint8) + (r > 0xFFFF) + (r > 0xFFFFFF)
    codes = np.zeros(-(-len(r) // 4) * 4, np.uint8)
    codes[: len(r)] = size - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1).astype(np.uint8)
    used = np.arange(4) < size[:, None]
    return control.tobytes(), r.view(np.uint8).reshape(-1, 4)[used].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n ranks of pack(): sizes by table lookup of the control bytes, then one gather for each byte place."""
    size = _SIZES[np.frombuffer(control, np.uint8)].ravel()[:n]
    start = np.cumsum(size) - size
    raw = np.frombuffer(data, np.uint8)
    out = np.zeros(n, np.uint32)
    for k in range(4):
        has = np.flatnonzero(size > k)
        if not len(has):
            break
        out[has] |= raw[start[has] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def tokenize(docs: DataFrame, tokenizer: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Staged ids of each text with end_id appended, in ascending id_col over all partitions.

    ids: little-endian, 16 bits wide while they fit; _part: the place of the row's partition; _start: ids
    before the document in its partition. The bounds of the partitions are quantiles of id_col, taken
    before, so that each text is encoded once only. An id that is several quantiles has as many partitions, which its
    rows are dealt to in turn, and null ids have their share of partitions in front.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    bounds = np.array(source.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.1 / parts))
    rows, nulls = source.agg(F.count("*"), F.count_if(F.col("doc_id").isNull())).first()
    in_front = -(-parts * nulls // max(1, rows)) if nulls else 0

    def places(key: pa.Array, turn: int) -> np.ndarray:
        """The partition of each id; turn: rows that the task had before."""
        value = key.cast(pa.float64()).fill_null(-np.inf).to_numpy(zero_copy_only=False)
        turns = turn + np.arange(len(value))
        first = np.searchsorted(bounds, value)
        dealt = in_front + first + turns % np.maximum(np.searchsorted(bounds, value, "right") - first, 1)
        return np.where(np.isneginf(value), turns % max(1, in_front), dealt).astype(np.int32)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, turn = library_encoder(tokenizer, TABLE_BITS), 0
        for batch in batches:
            for part, texts in chunks(batch):
                flat, edges = encoder.encode(texts)
                flat = np.insert(flat, edges[1:], end_id)
                edges = edges + np.arange(len(edges))
                flat = flat.astype("<u2" if flat.max() <= 0xFFFF else "<u4")
                key = part.column("doc_id")
                place = places(key, turn)
                turn += len(key)
                ids = pa.array([flat[a:b].tobytes() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([key, pa.array(np.diff(edges)), ids, pa.array(place)], ["doc_id", "n_tokens", "ids", "_part"])

    def add_start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = 0
        for batch in batches:
            n = batch.column("n_tokens").to_numpy()
            ends = before + np.cumsum(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ends - n)], [*batch.schema.names, "_start"])
            before = int(ends[-1]) if len(ends) else before

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids binary, _part int"
    ordered = source.mapInArrow(tidied(encode), schema).repartitionById(parts + in_front, "_part").sortWithinPartitions("_part", "doc_id")
    return staged(ordered.mapInArrow(tidied(add_start), schema + ", _start long"), "tokens")


def wide(ids: bytes, n: int) -> np.ndarray:
    return np.frombuffer(ids, "<u2" if len(ids) == 2 * n else "<u4")


def id_counts(tokens: DataFrame) -> DataFrame:
    """id, n over all documents; each task sends a row for each id of the vocabulary at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1, np.int64)
        for batch in batches:
            for ids, n in zip(batch.column("ids").to_pylist(), batch.column("n_tokens").to_pylist(), strict=True):
                more = np.bincount(wide(ids, n))
                if len(more) > len(counts):
                    counts = np.concatenate([counts, np.zeros(len(more) - len(counts), np.int64)])
                counts[: len(more)] += more
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], ["id", "n"])

    return tokens.mapInArrow(tidied(run), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Encode whole texts and write the file format: the blocks as a table, and the table of ranks (rank, id).

    Texts are encoded once. The ids move once, to ascending id_col over all partitions. What the driver
    holds is one number for each id of the vocabulary. Blocks follow each other by `_part`, then `_start`,
    the number of ids before the block in its part.

    id_col is a number. A null or empty text has end_id only; a null id sorts first; repeated ids stand
    side by side, in any order; ids of one frequency are ranked by id; an empty table gives no blocks; other
    columns are never read, whatever their names. A very long text is
    encoded whole and fills a block of its own.
    """
    tokens = tokenize(docs, tokenizer, end_id, id_col, text_col)
    found = id_counts(tokens).orderBy(F.desc("n"), "id").toPandas()  # a row for each id of the vocabulary
    ids_by_rank = found["id"].to_numpy(np.int64)
    rank_of = np.zeros(int(ids_by_rank.max(initial=0)) + 1, np.uint32)
    rank_of[ids_by_rank] = np.arange(len(ids_by_rank), dtype=np.uint32)
    kind = tokens.schema["doc_id"].dataType.simpleString()

    def close(held: list[tuple], id_kind: pa.DataType) -> pa.RecordBatch:
        doc_ids, counts, ids, starts, parts = map(list, zip(*held, strict=True))
        control, data = pack(rank_of[np.concatenate(ids)])
        columns = [pa.array(parts[:1], pa.int32()), pa.array(starts[:1], pa.int64()), pa.array([doc_ids], pa.list_(id_kind)), pa.array([counts], pa.list_(pa.int64())), pa.array([control], pa.binary()), pa.array([data], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["_part", "_start", "docs", "counts", "control", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, follows = 0, None
        id_kind = None
        for batch in batches:
            id_kind = batch.schema.field("doc_id").type
            for doc_id, n, ids, start, part in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_tokens", "ids", "_start", "_part")), strict=True):
                if held and ((part, start) != follows or size >= BLOCK_IDS):
                    yield close(held, id_kind)
                    held, size = [], 0
                held.append((doc_id, n, wide(ids, n), start, part))
                size, follows = size + n, (part, start + n)
        if held:
            yield close(held, id_kind)

    blocks = tokens.mapInArrow(tidied(run), f"_part int, _start long, docs array<{kind}>, counts array<long>, control binary, data binary")
    ranks = docs.sparkSession.createDataFrame(list(enumerate(ids_by_rank.tolist())), "rank int, id long")
    return staged(blocks, "token_files"), staged(ranks, "token_ranks")


def read_tokens(blocks: DataFrame, ranks: DataFrame) -> DataFrame:
    """Read the files back: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    No rows move: the driver adds up one number for each part.
    """
    kind = blocks.schema["docs"].dataType.elementType.simpleString()
    id_of = ranks.orderBy("rank").toPandas()["id"].to_numpy(np.uint32)  # a row for each id of the vocabulary
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
    sums = blocks.groupBy("_part").agg(F.sum(total).alias("n")).orderBy("_part").toPandas()  # a row for each part
    before = dict(zip(sums["_part"].tolist(), (sums["n"].cumsum() - sums["n"]).tolist(), strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            id_kind = batch.schema.field("docs").type.value_type
            for i in range(batch.num_rows):
                part, start, docs, counts, control, data = (batch.column(c)[i] for c in ("_part", "_start", "docs", "counts", "control", "data"))
                n = np.array(counts.as_py(), np.int64)
                ids = id_of[unpack(control.as_py(), data.as_py(), int(n.sum()))].astype("<u4")
                ends = np.cumsum(n)
                crc = [zlib.crc32(ids[a:b]) for a, b in zip((ends - n).tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(docs.as_py(), id_kind), pa.array(ends - n + start.as_py() + before[part.as_py()]), pa.array(n), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return blocks.mapInArrow(tidied(run), f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")
