"""Packing of documents into sequences: first-fit decreasing by a tournament tree of capacities, in randomised groups of documents."""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from leafmill.llm.common import flat, slices, table

#: Bytes of text in a group, about, and partitions that groups are dealt to at most.
GROUP, PARTITIONS = 16 << 20, 50_000
#: Units whose ids one worker keeps, and bytes of pieces in one batch that it gives back.
UNITS, BATCH = 400_000, 8 << 20
#: One run of letters, a space before it or not: for such a unit the model alone gives the ids.
LETTERS = regex.compile(r" ?\p{L}+")


def _letters_of_bytes() -> list[str]:
    """The character by which byte-level vocabularies show each byte: itself where it is printable, else the next one from 256 on."""
    shown = [33 <= b < 127 or 161 <= b < 173 or b >= 174 for b in range(256)]
    return [chr(b if shown[b] else 256 + shown[:b].count(False)) for b in range(256)]


class Encoder:
    """Ids of texts by a byte-level BPE tokenizer, unit by unit; the ids of units that came before are looked up.

    A text is cut where its tokens part anyway: before a space that a visible character follows, and between an ASCII letter and another ASCII character
    that is none. Where an added token stands in a text (such as <|endoftext|>), the text is encoded whole. For tokenizers that part words by the usual pattern of
    byte-level BPE, without normalizer or prefix space.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel ones
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.shown = dict(enumerate(_letters_of_bytes()))
        self.visible = np.zeros(256, bool)
        self.visible[0x21:0x7F] = self.visible[0x80:] = True
        self.visible[[0xC2, 0xE1, 0xE2, 0xE3]] = False  # white space beyond ASCII begins with one of these
        self.letter = np.zeros(256, bool)
        self.letter[65:91] = self.letter[97:123] = True
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.ends = array("I"), array("q", [0])

    def _learn(self, units: list[str]) -> None:
        plain = [LETTERS.fullmatch(u) is not None for u in units]
        rest = iter(self.tokenizer.encode_batch_fast([u for u, p in zip(units, plain, strict=True) if not p], add_special_tokens=False))
        for unit, p in zip(units, plain, strict=True):
            self.known[unit] = len(self.ends) - 1
            self.ids.extend([t.id for t in self.model.tokenize(unit.encode().decode("latin-1").translate(self.shown))] if p else next(rest).ids)
            self.ends.append(len(self.ids))

    def cuts(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where units begin, and the end."""
        mark = np.zeros(len(data) + 1, bool)
        mark[:-2] = (data[:-1] == 0x20) & self.visible[data[1:]]
        mark[1:-1] |= self.letter[data[:-1]] & ~self.letter[data[1:]] & (data[1:] < 128)
        raw = data.tobytes() if self.added else b""
        for token in self.added:
            k = raw.find(token)
            while k >= 0:
                d = int(np.searchsorted(at, k, "right"))
                mark[at[d - 1] : at[d]] = False
                k = raw.find(token, int(at[d]))
        mark[at] = True
        return np.flatnonzero(mark)

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (null: none), one text after another, and how many each has."""
        data, at = flat(column)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(column), np.int64)
        cuts = self.cuts(data, at)
        units = pa.Array.from_buffers(pa.large_string(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
        names = units.dictionary.to_pylist()
        if len(self.known) > UNITS:
            self._clear()
        self._learn([u for u in names if u not in self.known])
        known = np.fromiter(map(self.known.__getitem__, names), np.int64, len(names))[units.indices.to_numpy()]
        ends = np.frombuffer(self.ends, np.int64)
        first, n = ends[known], ends[known + 1] - ends[known]
        total = np.concatenate([[0], np.cumsum(n)])
        ids = np.frombuffer(self.ids, np.uint32)[np.arange(total[-1]) + np.repeat(first - total[:-1], n)]
        del ends  # the arrays grow again only when nothing looks at them
        return ids, np.diff(total[np.searchsorted(cuts, at)])


def first_fit(sizes: list[int], room: int) -> list[int]:
    """Bin of each size: the first one with room for it. sizes: from the largest on, none above room.

    The tree's leaves are the bins; an inner node holds the most room below it, so that a bin is found, and its nodes are mended, in a logarithm of the bins.
    """
    leaves = 1 << max(0, len(sizes) - 1).bit_length()
    most, out = [room] * (2 * leaves), []
    for size in sizes:
        k = 1
        while k < leaves:
            k *= 2
            k += most[k] < size
        out.append(k - leaves)
        most[k] -= size
        while k > 1:
            k //= 2
            now = max(most[2 * k], most[2 * k + 1])
            if most[k] == now:
                break
            most[k] = now
    return out


def pack(tokens: np.ndarray, length: int) -> np.ndarray:
    """Columns document, start, length, sequence, offset of all pieces, by document and start. tokens: of each document, over 0.

    Full sequences of one document come first; what is left of each document, from the largest on, goes into the first sequence with room for it. Then the
    emptiest sequences are cut up to fill the gaps of the others. What remains after that, less than one sequence, makes sequences
    whose lengths are powers of two.
    """
    n = len(tokens)
    whole, rest = tokens // length, tokens % length
    doc = np.repeat(np.arange(n), whole)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(whole) - whole, whole)
    full = np.stack([doc, nth * length, np.full(len(doc), length), np.arange(len(doc)), np.zeros(len(doc), np.int64)])
    order = np.argsort(-rest, kind="stable")
    order = order[: np.count_nonzero(rest)]
    size, start = rest[order], whole[order] * length
    bins = np.array(first_fit(size.tolist(), length), np.int64)
    load = np.bincount(bins, size).astype(np.int64) if len(bins) else np.zeros(0, np.int64)
    kept = np.argsort(-load, kind="stable")[: int(size.sum()) // length]
    number = np.full(len(load), -1)
    number[kept] = np.arange(len(kept))
    stays = number[bins] >= 0
    # pieces of a sequence follow each other as they came
    by = np.lexsort((np.arange(len(bins)), bins))
    before = np.cumsum(size[by]) - size[by]
    offset = np.empty(len(bins), np.int64)
    offset[by] = before - before[np.searchsorted(bins[by], bins[by])]
    first = np.stack([order, start, size, number[bins], offset])[:, stays]
    left = int(size.sum()) - len(kept) * length
    powers = np.array([1 << b for b in range(left.bit_length() - 1, -1, -1) if left >> b & 1], np.int64)
    gaps = np.concatenate([length - load[kept], powers])
    at = np.concatenate([load[kept], np.zeros(len(powers), np.int64)])
    piece_ends, gap_ends = np.cumsum(size[~stays]), np.cumsum(gaps)
    ends = np.union1d(piece_ends, gap_ends[gaps > 0])
    begins = np.concatenate([[0], ends])[: len(ends)]
    p, g = np.searchsorted(piece_ends, begins, "right"), np.searchsorted(gap_ends, begins, "right")
    moved = np.stack([order[~stays][p], start[~stays][p] + begins - (piece_ends - size[~stays])[p], ends - begins, g, at[g] + begins - (gap_ends - gaps)[g]])
    full[3] += len(gaps)
    out = np.concatenate([first, moved, full], axis=1)
    return out[:, np.lexsort((out[1], out[0]))]


def _pieces(doc_ids: pa.Array, ids: np.ndarray, tokens: np.ndarray, length: int, group: int, kinds: pa.Schema) -> Iterator[pa.RecordBatch]:
    """A group's pieces. ids: of all its documents, one after another."""
    doc, start, size, sequence, offset = pack(tokens, length)
    ends = np.concatenate([[0], np.cumsum(size)])  # pieces in this order are all ids in their order
    step = max(1, BATCH // (4 * length))
    for a in range(0, len(doc), step):
        b = min(a + step, len(doc))
        places = ((ends[a : b + 1] - ends[a]) * 4).astype(np.int32)
        own = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(places), pa.py_buffer(ids[ends[a] : ends[b]])])
        columns = [pa.array(x[a:b]) for x in (start, size, tokens[doc], (group << 32) + sequence, offset)]
        yield pa.RecordBatch.from_arrays([doc_ids.take(pa.array(doc[a:b])), *columns[:2], own, *columns[2:]], schema=kinds)


def packed(docs: DataFrame, tokenizer: str, length: int = 1024, end: int = 0, seed: int = 0, group: int = GROUP) -> DataFrame:
    """doc_id, start, length, ids, doc_tokens, sequence_id, offset of every piece of every document; each id lies in one piece.

    A document's ids are those of its text, without special tokens of the tokenizer's own making, and `end`. ids: little-endian unsigned 32-bit
    numbers. Sequences have `length` ids; of each group, one rest of less becomes sequences whose lengths are powers of two, so that none needs padding.
    docs: doc_id, text; other columns are left aside. A null text counts as empty: `end` alone. Null doc_ids and repeated rows are documents of their own. An empty
    table gives no rows. tokenizer: path of a byte-level BPE tokenizer's file, which every machine has.

    Documents are dealt at random, by their place in the table, to groups of about `group` bytes, so that repeated rows spread too; a second reading of the table has
    to give the same order, as files do. Texts move once; ids are made, packed and returned where their group is.
    """
    total = docs.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1), F.lit(0))).first()[0]
    groups = max(1, -(-int(total) // group))
    parts = min(groups, PARTITIONS)
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.pmod(F.xxhash64(F.lit(seed), F.monotonically_increasing_id()), F.lit(groups)).alias("group"))
    dealt = rows.repartitionById(parts, F.pmod("group", F.lit(parts)).cast("int")).sortWithinPartitions("group")
    kinds = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.kept.get(tokenizer) or Encoder.kept.setdefault(tokenizer, Encoder(tokenizer))
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        now = None

        def closed() -> Iterator[pa.RecordBatch]:
            if held:
                yield from _pieces(pa.concat_arrays([h[0] for h in held]), np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held]), length, now, kinds)
                held.clear()

        for batch in (part for whole in batches for part in slices(whole, 1)):
            of = batch.column(2).to_numpy()
            cuts = np.flatnonzero(np.diff(of)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(of)], strict=True):
                if now != int(of[a]):
                    yield from closed()
                    now = int(of[a])
                ids, counts = encoder(batch.column(1).slice(a, b - a))
                held.append((batch.column(0).slice(a, b - a), np.insert(ids, np.cumsum(counts), end), counts + 1))
        yield from closed()

    return dealt.mapInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


#: One encoder for each tokenizer in a worker's life.
Encoder.kept = {}


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 ids: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    out = packed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
