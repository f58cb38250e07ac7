"""Best-fit sequence packing planned on a length histogram.

Documents are tokenised into pieces of at most ``capacity`` tokens.  Only the
histogram of piece lengths (at most ``capacity`` rows) reaches the driver,
where best-fit decreasing runs on counts: many equal pieces fill many equal
sequences in one step.  Pieces then take the planned slots by joining on their
rank within their length.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tabwise.llm.scratch import Scratch
from tabwise.llm.textarrays import text_bytes

CAPACITY = 2048
#: Rows that one task ranks together, at most about.
RANK_GROUP = 512
#: Chunks and words of which a worker keeps the ids (about 150 bytes each).
CACHE_CHUNKS, CACHE_WORDS = 300_000, 600_000
#: A plan of more rows than this is joined by shuffling instead of a broadcast.
BROADCAST_SLOTS = 200_000

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"


# The pre-token pattern of the word tokenizer for plain lower-case text, and its plain characters.
PLAIN_TOKENS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z\u00df-\u00f6\u00f8-\u00ff0-9]+")
PLAIN = re.compile("[\x21-\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")


class WordEncoder(dict):
    """Token ids of whole texts through a cache: a chunk between ASCII white space -> its ids.

    For the word tokenizer, which composes and lower-cases characters, drops
    white space and never merges across it: the ids of a text are those of its
    chunks.  Chunks of plain characters (ASCII and Latin-1 letters) go to the
    tokenizer's BPE model pre-token by pre-token, all others through the whole
    tokenizer.  Texts that may spell out a special token keep their case.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.words = Tokenizer.from_file(path), {}
        visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}    # byte-level BPE shows these bytes as they are
        hidden = iter(range(256, 512))
        self.shown = [chr(b) if b in visible else chr(next(hidden)) for b in range(256)]

    def __missing__(self, chunk: bytes) -> bytes:
        if len(self) >= CACHE_CHUNKS:
            self.clear()
        text = chunk.decode()
        if PLAIN.fullmatch(text) and "<|" not in text:
            ids = b"".join([self.words.get(w) or self.word(w) for w in PLAIN_TOKENS.findall(text.lower())])
        else:
            ids = b"".join([i.to_bytes(4, "little") for i in self.tokenizer.encode(text, add_special_tokens=False).ids])
        self[chunk] = ids
        return ids

    def word(self, word: str) -> bytes:
        if len(self.words) >= CACHE_WORDS:
            self.words.clear()
        shown = word if word.isascii() else "".join([self.shown[b] for b in word.encode()])
        ids = b"".join([t.id.to_bytes(4, "little") for t in self.tokenizer.model.tokenize(shown)])
        self.words[word] = ids
        return ids

    def encode(self, text: bytes) -> bytes:
        """Little-endian uint32 ids of a UTF-8 text."""
        return b"".join(map(self.__getitem__, (text if b"<|" in text else text.lower()).split()))


_ENCODERS: dict[str, WordEncoder] = {}


def tokenise_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0, keep_ids: bool = True) -> DataFrame:
    """Pieces of at most ``capacity`` tokens: doc_id, piece, start, length, ids_crc32, ids.

    A document is its ids and then ``end_id``.  ``ids``: little-endian unsigned
    32-bit ids (null unless ``keep_ids``).
    """
    end = end_id.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ENCODERS.get(tokenizer_path)
        if encoder is None:
            encoder = _ENCODERS[tokenizer_path] = WordEncoder(tokenizer_path)
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            data, rows = data.tobytes(), []
            for doc, a, b in zip(batch.column(0).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                ids = encoder.encode(data[a:b]) + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    rows.append((doc, piece, at // 4, len(part) // 4, zlib.crc32(part), part if keep_ids else None))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            columns = zip(*rows) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)],
                                             names=[c.split()[0] for c in _PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, _PIECES)


def plan_best_fit(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: slots (length, rank_from, rank_to, first_sequence, per_sequence, offset).

    The pieces of ``length`` with ranks from rank_from to before rank_to fill
    consecutive sequences, ``per_sequence`` of them each, beginning at ``offset``.
    """
    room: dict[int, list[tuple[int, int]]] = {}     # free tokens -> (first sequence, sequences) with that much room
    slots, sequences = [], 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            free = next((r for r in range(length, capacity + 1) if room.get(r)), None)
            if free is None:
                free, per = capacity, capacity // length
                first, count = sequences, -(-left // per)
                sequences += count
            else:
                first, count = room[free].pop()
                per = free // length
            whole, odd = min(count, left // per), 0
            if whole:
                slots.append((length, rank, rank + whole * per, first, per, capacity - free))
                rank, left = rank + whole * per, left - whole * per
                room.setdefault(free - per * length, []).append((first, whole))
            if left and whole < count:
                odd = 1
                slots.append((length, rank, rank + left, first + whole, left, capacity - free))
                room.setdefault(free - left * length, []).append((first + whole, 1))
                rank, left = rank + left, 0
            if count > whole + odd:
                room.setdefault(free, []).append((first + whole + odd, count - whole - odd))
    return slots


def best_fit_packing(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """One row per piece of ``docs (doc_id, text)``: doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids].

    Sequences hold at most ``capacity`` tokens, gapless from offset 0.  A null
    or empty text is the single token ``end_id``.  Only documents longer than
    ``capacity`` are cut.  Rows with a null or repeated doc_id are packed as
    rows of their own; an empty table gives no rows.  Other columns are not
    read.  Ranking is done in hash groups of about RANK_GROUP rows, so a length
    that a third of all pieces have is spread over many tasks.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    spark = scratch.spark
    pieces = scratch.write(tokenise_pieces(docs, tokenizer_path, capacity, end_id, keep_ids), "pieces")
    if not keep_ids:
        pieces = pieces.drop("ids")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    slots = plan_best_fit(histogram, capacity)
    groups = -(-max(histogram.values(), default=1) // RANK_GROUP)
    grouped = pieces.withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)))
    sizes = grouped.groupBy("length", "_group").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("length", "_group", (F.sum("_n").over(Window.partitionBy("length").orderBy("_group")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("length", "_group").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = (grouped.withColumn("_inside", inside).join(before, ["length", "_group"])
              .withColumn("_rank", F.col("_before") + F.col("_inside")))
    plan = spark.createDataFrame(slots, "length long, rank_from long, rank_to long, first long, per long, at long")
    plan = F.broadcast(plan) if len(slots) <= BROADCAST_SLOTS else plan
    taken = ranked.join(plan, (ranked["length"] == plan["length"]) & (F.col("_rank") >= F.col("rank_from")) & (F.col("_rank") < F.col("rank_to")))
    nth = F.col("_rank") - F.col("rank_from")
    return taken.select("doc_id", "piece", "start", ranked["length"], "ids_crc32",
                        (F.col("first") + F.floor(nth / F.col("per"))).alias("sequence_id"),
                        (F.col("at") + (nth % F.col("per")) * ranked["length"]).alias("offset"), *(["ids"] if keep_ids else []))


def fill_sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves, from pieces that kept their ids."""
    inside = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.aggregate(inside, F.lit(b""), lambda acc, x: F.concat(acc, x["ids"])).alias("ids"))
