"""Alignment of two tokenizers' tokens by byte offsets, and corpus-wide counts of linked ids.

Coarse cuts are the tokenizers' own spans: character offsets of ``tokenizers``
and the spans of sentencepiece's result (``offset_mapping``, which took the place
of the immutable proto).  Tokens that are not whole characters, pieces of a
multibyte character or byte-fallback tokens, are refined with their decoded bytes.

Both tokenizers never merge across the point before white space (checked on
the vocabulary), so a text is aligned chunk by chunk, and workers keep the
alignments of frequent chunks.  Texts with other white space than space, tab and
line feed are one chunk.

Counts go by blocks of documents: a block sends each of its distinct pairs once,
gets back that pair's corpus-wide count, and its documents add up what they hold.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tabwise.llm.scratch import Scratch
from tabwise.llm.textarrays import text_bytes

#: Bytes of text of a block, and of a long text that are cut into chunks at once.
BLOCK, SEGMENT = 1 << 22, 1 << 20
#: Chunks of which a worker keeps the alignment (about 400 bytes each).
CACHE = 400_000

#: Links of a group that are listed one by one.
LARGE = 1 << 16

CHUNK = re.compile("[ \t\n]*[^ \t\n]+|[ \t\n]+")
CUT = re.compile("(?<=[^ \t\n])(?=[ \t\n])")
OTHER_SPACE = re.compile("[^\\S \t\n]")



def byte_ends(raw: np.ndarray, spans: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Byte offset where each token ends: its span in characters where it is whole characters, else by the decoded bytes."""
    at = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
    start, end = at[spans[:, 0]], at[spans[:, 1]]
    return np.where(end - start == sizes, end, np.cumsum(sizes))


class Groups(NamedTuple):
    """Tokens of both tokenizers and the groups between their common ends."""

    a: np.ndarray
    b: np.ndarray
    ends: np.ndarray       #: byte offset where each group ends
    group_a: np.ndarray    #: group of each token
    group_b: np.ndarray

    def written(self) -> list[str]:
        """a1,a2|b1 of every group."""
        out, i, j = [], 0, 0
        a, b = list(map(str, self.a.tolist())), list(map(str, self.b.tolist()))
        for n, m in zip(np.bincount(self.group_a).tolist(), np.bincount(self.group_b).tolist()):
            out.append(a[i] + "|" + b[j] if n == m == 1 else ",".join(a[i:i + n]) + "|" + ",".join(b[j:j + m]))
            i, j = i + n, j + m
        return out

    def links(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(group, pair, times) of the links, by group; of groups of very many, each pair once with how often."""
        n, m = np.bincount(self.group_a), np.bincount(self.group_b)
        first = np.concatenate([[0], np.cumsum(m)])
        large = n * m > LARGE
        own = np.flatnonzero(~large[self.group_a])
        places, size = _spread(first, self.group_a[own])
        group, pair = np.repeat(self.group_a[own], size), np.repeat(self.a[own], size) * width + self.b[places]
        times = np.ones(len(pair), np.int64)
        if large.any():
            for g in np.flatnonzero(large).tolist():
                x, k = np.unique(self.a[self.group_a == g], return_counts=True)
                y, l = np.unique(self.b[self.group_b == g], return_counts=True)
                group = np.append(group, np.full(len(x) * len(y), g))
                pair, times = np.append(pair, np.add.outer(x * width, y)), np.append(times, np.multiply.outer(k, l))
            order = np.argsort(group, kind="stable")
            group, pair, times = group[order], pair[order], times[order]
        return group, pair, times


class Aligner:
    """Groups of tokens of a byte-level BPE (A) and a sentencepiece model (B) between common byte offsets."""

    def __init__(self, byte_path: str, piece_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(byte_path), sentencepiece.SentencePieceProcessor(model_file=piece_path)
        self.a.encode_special_tokens = True
        visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}    # byte-level BPE shows these bytes as they are
        hidden = iter(range(256, 512))
        byte = {chr(b) if b in visible else chr(next(hidden)): b for b in range(256)}
        shown = {i: t for t, i in self.a.get_vocab(with_added_tokens=False).items()}
        self.a_bytes = [bytes(byte[c] for c in shown[i]) if i in shown else b"" for i in range(max(shown) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.chunked = not any(re.search("[^▁]▁|[\t\n]", p) for p in pieces)
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in entries], np.int64) for entries in (self.a_bytes, self.b_bytes))
        self.width = len(pieces)

    def align(self, text: str) -> Groups | None:
        """Groups of a text, or of chunks one after the other; None where the tokens' bytes are not the text's."""
        one = self.a.encode(text, add_special_tokens=False)
        other = self.b.encode("\n" + text, return_type="offset_mapping")     # a line feed keeps the model's own space apart
        a, b, raw = one.ids, other["ids"][2:], text.encode()
        if b"".join(map(self.a_bytes.__getitem__, a)) != raw or b"".join(map(self.b_bytes.__getitem__, b)) != raw:
            return None
        a, b, raw = np.array(a, np.int64), np.array(b, np.int64), np.frombuffer(raw, np.uint8)
        a_ends = byte_ends(raw, np.array(one.offsets, np.int64).reshape(-1, 2), self.a_sizes[a])
        b_ends = byte_ends(raw, np.maximum(np.array(other["offsets"][2:], np.int64).reshape(-1, 2) - 1, 0), self.b_sizes[b])
        ends = a_ends[np.isin(a_ends, b_ends, assume_unique=True)]
        return Groups(a, b, ends, np.searchsorted(ends, a_ends), np.searchsorted(ends, b_ends))

    def document(self, text: str) -> Iterator[tuple[str, bool]]:
        """(segment, whole): parts of space + text; whole ones are not to be cut into chunks."""
        text = " " + text
        if not self.chunked or OTHER_SPACE.search(text):
            yield text, True
            return
        at = 0
        while at < len(text):
            cut = CUT.search(text, at + SEGMENT) if len(text) - at > SEGMENT else None
            end = cut.start() if cut else len(text)
            yield text[at:end], False
            at = end


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def _aligner(paths: tuple[str, str]) -> Aligner:
    if paths not in _ALIGNERS:
        _ALIGNERS[paths] = Aligner(*paths)
    return _ALIGNERS[paths]


class _Chunks(dict):
    """Numbers of the chunks that a worker has seen, their alignments: sizes, the groups written out, and links.

    Looking up a new chunk gives it a number; ``learn`` then aligns all new ones.
    """

    def __init__(self, aligner: Aligner):
        super().__init__()
        self.aligner, self.new = aligner, []
        self.sizes, self.first, self.links, self.times = array("q"), array("q", [0]), array("q"), array("q")
        self.written, self.seen = [], np.zeros(0, np.int64)

    def __missing__(self, chunk: str) -> int:
        self.new.append(chunk)
        self[chunk] = number = len(self)
        return number

    def learn(self) -> None:
        new, self.new = self.new, []
        joined = [c for c in new if c[-1] not in " \t\n"]     # white space at a text's end would run into the next chunk
        found = self.aligner.align("".join(joined)) if len(joined) == len(new) else None
        if found is not None:
            ends = np.cumsum([len(c.encode()) for c in joined])
            if np.isin(ends, found.ends).all():
                self._keep(found, ends)
                return
        for chunk in new:
            found = self.aligner.align(chunk)
            if found is None:
                self.sizes.extend((-1, 0, 0, 0))
                self.first.append(len(self.links))
                self.written.append("")
            else:
                self._keep(found, found.ends[-1:])

    def _keep(self, found: Groups, ends: np.ndarray) -> None:
        """Add the chunks that end at ``ends``."""
        of_group, count = np.searchsorted(ends, found.ends), len(ends)
        group, pair, times = found.links(self.aligner.width)
        n_links = np.bincount(of_group[group], times, count).astype(np.int64)
        columns = [np.bincount(of_group[found.group_a], minlength=count), np.bincount(of_group[found.group_b], minlength=count),
                   np.bincount(of_group, minlength=count), n_links]
        self.sizes.frombytes(np.column_stack(columns).astype(np.int64).tobytes())
        self.first.frombytes((len(self.links) + np.cumsum(np.bincount(of_group[group], minlength=count))).astype(np.int64).tobytes())
        self.links.frombytes(pair.tobytes())
        self.times.frombytes(times.tobytes())
        written = found.written()
        cuts = np.searchsorted(of_group, np.arange(count + 1)).tolist()
        self.written.extend(";".join(written[i:j]) for i, j in zip(cuts[:-1], cuts[1:]))

    def shrink(self, limit: int) -> None:
        """Forget the chunks that were seen least, until half of ``limit`` are left."""
        keep = np.sort(np.argsort(-self.seen, kind="stable")[:limit // 2])
        places, size = _spread(np.frombuffer(self.first, np.int64).copy(), keep)
        chunks = list(self)
        kept = [(chunks[k], self.written[k]) for k in keep.tolist()]
        sizes = np.frombuffer(self.sizes, np.int64).reshape(-1, 4)[keep]
        links, times = np.frombuffer(self.links, np.int64)[places], np.frombuffer(self.times, np.int64)[places]
        self.clear()
        self.update((c, k) for k, (c, _) in enumerate(kept))
        self.written, self.seen = [w for _, w in kept], self.seen[keep] // 2
        self.sizes, self.links, self.times = (array("q", x.tobytes()) for x in (sizes, links, times))
        self.first = array("q", np.concatenate([[0], np.cumsum(size)]).astype(np.int64).tobytes())

    def numbers(self, text: str) -> np.ndarray | None:
        """Chunk numbers of space + text in order; None if its tokens' bytes are not its own."""
        parts = []
        for segment, whole in self.aligner.document(text):
            chunks = [segment] if whole else CHUNK.findall(segment)
            parts.append(np.fromiter(map(self.__getitem__, chunks), np.int64, len(chunks)))
        if self.new:
            self.learn()
        out = np.concatenate(parts)
        if len(self.seen) < len(self):
            self.seen = np.concatenate([self.seen, np.zeros(len(self), np.int64)])
        self.seen[out] += 1
        return out if np.frombuffer(self.sizes, np.int64)[4 * out].min() >= 0 else None


def _spread(first: np.ndarray, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places first[c]..first[c + 1] of all chunks c in order, and how many of each."""
    size = first[chunks + 1] - first[chunks]
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first[chunks] - ends + size, size), size


def _pack(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, byte by byte, compressed."""
    return zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _unpack(blob: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


_SIZES = ["n_a", "n_b", "n_groups", "n_links"]
_BLOCKS = pa.schema([("block", pa.int64()), ("doc_id", pa.list_(pa.int64())), *[(c, pa.list_(pa.int64())) for c in _SIZES],
                     ("groups_sha256", pa.list_(pa.string())), ("pairs", pa.binary()), ("holders", pa.binary()),
                     ("first", pa.binary()), ("step", pa.binary()), ("times", pa.binary())])
_BLOCKS_SQL = ("block long, doc_id array<long>, " + ", ".join(f"{c} array<long>" for c in _SIZES)
               + ", groups_sha256 array<string>, pairs binary, holders binary, first binary, step binary, times binary")


def alignment_blocks(docs: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """One row per block of documents: their sizes and digests, the block's distinct pairs with how many of its
    documents hold each, and each document's pairs (``first`` its first place, ``step`` from pair to pair, ``times`` linked)."""
    def block(rows: list[tuple], known: _Chunks, number: int) -> pa.RecordBatch:
        """``rows``: (doc_id, chunk numbers, digest)."""
        first = np.frombuffer(known.first, np.int64)
        chunks = np.concatenate([r[1] for r in rows])
        doc = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
        sizes = np.zeros((len(rows), 4), np.int64)
        np.add.at(sizes, doc, np.frombuffer(known.sizes, np.int64).reshape(-1, 4)[chunks])
        each, often = np.unique(doc * (len(known) + 1) + chunks, return_counts=True)
        doc, chunks = each // (len(known) + 1), each % (len(known) + 1)
        places, size = _spread(first, chunks)
        weight = np.frombuffer(known.times, np.int64)[places] * np.repeat(often, size)
        used, index = np.unique(np.frombuffer(known.links, np.int64)[places], return_inverse=True)
        key, inverse = np.unique(np.repeat(doc, size) * max(1, len(used)) + index, return_inverse=True)
        times = np.bincount(inverse, weight, len(key)).astype(np.int64)
        doc, index = key // max(1, len(used)), key % max(1, len(used))
        begin = np.searchsorted(doc, np.arange(len(rows) + 1))
        step = np.diff(index, prepend=0)
        starts = begin[:-1][np.diff(begin) > 0]
        step[starts] = index[starts]
        columns = [[number], [[r[0] for r in rows]], *[[sizes[:, k]] for k in range(4)], [[r[2] for r in rows]],
                   [used.tobytes()], [_pack(np.bincount(index, minlength=len(used)))], [_pack(begin)], [_pack(step)], [_pack(times)]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _BLOCKS)], schema=_BLOCKS)

    def blocks(batches):
        aligner = _aligner(paths)
        if not hasattr(aligner, "known"):
            aligner.known = _Chunks(aligner)
        known, count = aligner.known, TaskContext.get().partitionId() << 32
        rows, held, none = [], 0, np.zeros(0, np.int64)
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for doc, x, y in zip(batch.column(0).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                try:
                    text = data[x:y].tobytes().decode()
                except UnicodeDecodeError:      # no such text in bytes
                    text = ""
                chunks = known.numbers(text) if text else None
                if chunks is None and text:     # a chunk's tokens are not its bytes: what are those of the whole?
                    whole = np.array([known[" " + text]])
                    if known.new:
                        known.learn()
                    chunks = whole if known.sizes[4 * int(whole[0])] >= 0 else None
                rows.append((doc, none, "") if chunks is None else
                            (doc, chunks, hashlib.sha256(";".join(map(known.written.__getitem__, chunks.tolist())).encode()).hexdigest()))
                held += y - x
                if held >= BLOCK or len(known) > CACHE:
                    yield block(rows, known, count)
                    rows, held, count = [], 0, count + 1
                    if len(known) > CACHE:
                        known.shrink(CACHE)
        if rows:
            yield block(rows, known, count)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(blocks, _BLOCKS_SQL)


def _block_pairs(blocks: DataFrame) -> DataFrame:
    """(block, pair, holders) of every distinct pair of a block."""
    kind = pa.schema([("block", pa.int64()), ("pair", pa.int64()), ("holders", pa.int64())])

    def rows(batches):
        for batch in batches:
            for number, pairs, holders in zip(*(batch.column(k).to_pylist() for k in range(3))):
                pairs = np.frombuffer(pairs, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), number)), pa.array(pairs), pa.array(_unpack(holders))], schema=kind)

    return blocks.select("block", "pairs", "holders").mapInArrow(rows, "block long, pair long, holders long")


def count_links(docs: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """One row per row of ``docs (doc_id, text)``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``paths``: files of A (byte-level BPE) and B (sentencepiece).  Texts that are
    null, empty, or not the bytes of their tokens have no tokens: zeros and no
    digest.  Repeated rows and rows without doc_id are documents of their own.
    Long texts are aligned in segments.  An empty table gives none.  Other
    columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "alignment")
    blocks = scratch.write(alignment_blocks(docs, paths), "blocks")
    width = _aligner(paths).width
    sent = _block_pairs(blocks)
    counts = scratch.write(sent.groupBy("pair").agg(F.sum("holders").alias("n")), "counts")
    id_a = F.floor(F.col("pair") / width)
    best = counts.groupBy(id_a.alias("_a")).agg(F.max("n").alias("most"))
    counted = counts.withColumn("_a", id_a).join(best, "_a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    answers = sent.select("block", "pair").join(counted, "pair").select("block", "pair", "n", "best")
    kind = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in [*_SIZES, "n_best", "count_sum"]], ("groups_sha256", pa.string())])

    def total(left: pa.Table, right: pa.Table) -> pa.Table:
        pair = right["pair"].to_numpy()
        order = np.argsort(pair)        # as the block has them
        n, best = right["n"].to_numpy()[order], right["best"].to_numpy()[order].astype(np.int64)
        row = left.to_pylist()[0]
        first, times = _unpack(row["first"]), _unpack(row["times"])
        step = _unpack(row["step"])
        # Steps restart with each document: take off what the running sum had before its first.
        index = np.cumsum(step)
        begin = first[:-1]
        size = np.diff(first)
        before = np.concatenate([[0], index])[begin]
        index = index - np.repeat(before, size)
        doc = np.repeat(np.arange(len(size)), size)
        n_best, count_sum = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        np.add.at(n_best, doc, best[index] * times)
        np.add.at(count_sum, doc, n[index] * times)
        return pa.Table.from_arrays([pa.array(row["doc_id"], pa.int64()), *[pa.array(row[c], pa.int64()) for c in _SIZES],
                                     pa.array(n_best), pa.array(count_sum), pa.array(row["groups_sha256"], pa.string())], schema=kind)

    return blocks.drop("pairs", "holders").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        total, ", ".join(f"{f.name} {'string' if f.type == pa.string() else 'long'}" for f in kind))


def token_groups(docs: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """(doc_id, groups): every document's groups, each with its byte range in space + text and the ids of both
    tokenizers (no group where a text has no tokens)."""
    kind = pa.schema([("doc_id", pa.int64()), ("groups", pa.list_(pa.struct([
        ("start", pa.int64()), ("end", pa.int64()), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))])))])

    def groups(batches):
        aligner = _aligner(paths)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = aligner.align(" " + text) if text else None
                out = []
                if found is not None:
                    starts = np.concatenate([[0], found.ends[:-1]]).tolist()
                    cut_a, cut_b = (np.split(ids, np.flatnonzero(np.diff(of)) + 1) for ids, of in ((found.a, found.group_a), (found.b, found.group_b)))
                    out = [(s, e, x.tolist(), y.tolist()) for s, e, x, y in zip(starts, found.ends.tolist(), cut_a, cut_b)]
                rows = [dict(zip(("start", "end", "a", "b"), g)) for g in out]
                yield pa.RecordBatch.from_arrays([pa.array([doc], pa.int64()), pa.array([rows], kind.field(1).type)], schema=kind)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        groups, "doc_id long, groups array<struct<start: long, end: long, a: array<int>, b: array<int>>>")
