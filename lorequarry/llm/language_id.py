"""Operator 2: language by compression with per-language zstandard raw-content dictionaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, staged, tidied

#: The sample that is learned of: so many distinct texts of each language at most, a passage of so many characters of each.
TRAIN_ROWS, PASSAGE_CHARS = 400, 600
#: Bytes compressed at a time: all of a text is, but a long one must not become its own dictionary.
BLOCK_BYTES = 4096
LEVEL = 6
#: A smaller part between the best and the second size is rejected as narrow.
MARGIN = 0.01
UNKNOWN = "und"

_LETTER = regex.compile(r"\p{L}")
_ONLY_WORDS = bytes(c if chr(c).isalpha() or c >= 128 else 32 for c in range(256))


def normal(text: str) -> bytes:
    """Lower case; ASCII that isn't a letter is a space."""
    return text.lower().encode().translate(_ONLY_WORDS)


def train(docs: DataFrame, learn: Column, text_col: str, lang_col: str) -> dict[str, bytes]:
    """A raw-content dictionary for each language, of TRAIN_ROWS distinct texts where `learn` holds.

    The texts are those with the smallest hash; copies count once. Of each a passage of PASSAGE_CHARS is taken,
    at a place that the hash decides, and all passages are used. Hashes and passages move, texts don't; what
    reaches the driver is bounded for each language, and languages are a short list of labels.
    """
    rows = docs.filter(learn & docs[lang_col].isNotNull() & docs[text_col].isNotNull()).select(docs[lang_col].alias("lang"), docs[text_col].alias("text")).withColumn("hash", F.xxhash64("text"))
    counts = staged(rows.select("lang", "hash").distinct().groupBy("lang").agg(F.count("*").alias("n")), "languages")
    share = F.pmod("hash", F.lit(1 << 30)) < F.lit(2.0 * TRAIN_ROWS * (1 << 30)) / F.col("n")
    room = F.greatest(F.length("text") - PASSAGE_CHARS, F.lit(0)) + 1
    passage = F.substring("text", (F.pmod(F.shiftright("hash", 30), room) + 1).cast("int"), F.lit(PASSAGE_CHARS))
    some = rows.join(F.broadcast(counts), "lang").filter(share).select("lang", "hash", passage.alias("passage"))
    texts = some.groupBy("lang", "hash").agg(F.min("passage").alias("passage"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("hash"))
    picked = texts.withColumn("rank", first).filter(F.col("rank") <= TRAIN_ROWS).select("lang", "rank", "passage")
    found: dict[str, list[tuple[int, str]]] = {}
    for lang, rank, text in picked.collect():
        found.setdefault(lang, []).append((rank, text))
    often = [r["lang"] for r in counts.orderBy(F.desc("n"), "lang").collect()]  # a row for each language
    return {lang: b" ".join(normal(text) for _, text in sorted(found[lang])) for lang in often if lang in found}


class Judge:
    def __init__(self, dictionaries: dict[str, bytes]):
        self.langs = list(dictionaries)
        self.coders = []
        for raw in dictionaries.values():
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.coders.append(zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_checksum=False, write_content_size=False))

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        """The language with the smallest size, the margin to the next, and whether that is wide enough."""
        if not text or not self.langs or not _LETTER.search(text):
            return UNKNOWN, 0.0, False
        raw = normal(text)
        blocks = [raw[k : k + BLOCK_BYTES] for k in range(0, len(raw), BLOCK_BYTES)]
        sizes = [sum(len(c.compress(b)) for b in blocks) for c in self.coders]
        best = int(np.argmin(sizes))
        second = min(sizes[:best] + sizes[best + 1 :], default=2 * sizes[best])
        margin = 1 - sizes[best] / second
        return self.langs[best], margin, margin >= MARGIN


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The language of every whole text: id_col, held_out, lang_pred, score, confident.

    Learned of the rows whose crc32 of the id as text isn't 2 modulo 4 and that have a language; only the
    text enters a prediction. score is the part by which the best dictionary's size is below the second's;
    confident is false where that is under MARGIN, which rejects the prediction. No rows move.

    A null text, or one without a letter, is `und` with score 0; so is every text where nothing can be
    learned. A null id isn't held out; ties go to the language with the most texts to learn of, then by name;
    repeated rows get the same answer; a very long text is compressed whole, in blocks of BLOCK_BYTES; an empty
    table gives no rows; other columns are never read, whatever their names.
    """
    held_out = F.coalesce(F.crc32(docs[id_col].cast("string")) % 4 == 2, F.lit(False))
    dictionaries = train(docs, ~held_out, text_col, lang_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(dictionaries)
        for batch in batches:
            for part, _ in chunks(batch):
                found = [judge(t) for t in part.column("text").to_pylist()]
                lang, score, sure = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(sure, pa.bool_())], ["doc_id", "held_out", "lang_pred", "score", "confident"])

    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(docs[id_col].alias("doc_id"), held_out.alias("held_out"), docs[text_col].alias("text"))
    return source.mapInArrow(tidied(run), f"doc_id {kind}, held_out boolean, lang_pred string, score double, confident boolean").withColumnRenamed("doc_id", id_col)
