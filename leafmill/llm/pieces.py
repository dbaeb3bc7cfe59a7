"""SentencePiece segmentations sampled by forward filtering and backward sampling over the piece lattice."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: The mark that stands for a space in pieces, and a code that stands for the same mark in a text.
MARK, LITERAL = 0x2581, 0x10FFFF
_ODD = re.compile("  |^ | $|▁")
_UNIT = re.compile(" *[^ ]+| +$")
#: Characters that are segmented together, and the length of a unit from which logarithms are summed.
TOGETHER, LONG = 400_000, 120
#: Bits of a draw and of the shares that it is held against, so that these are whole numbers, equal wherever a unit stands.
GRID = 24
#: Lattice edges of units that a task keeps for later texts, and the length up to which a unit is kept.
KEPT, SHORT = 1_500_000, 24
#: Bits of the hash table of pieces' beginnings.
SLOTS = 19
#: Weight that a character adds to each way through it, which cancels out; keeps sums within range.
_PER_CHAR = 4.0
_POWERS = np.exp(_PER_CHAR * np.arange(64))


def _uniform(seed: np.ndarray, unit: np.ndarray, step: int) -> np.ndarray:
    """Uniform numbers of GRID bits that depend on the arguments alone."""
    z = seed + (unit.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((step + 1) * 0xD1B54A32D192ED03 % 2**64)
    z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return ((z ^ z >> np.uint64(31)) >> np.uint64(64 - GRID)).astype(np.int64)


def units(text: str) -> list[str]:
    """A text as runs of spaces with the word after them, each without its first space; the text's own first space is added before."""
    if not text:
        return []
    return [u[1:] for u in _UNIT.findall(" " + text)] if _ODD.search(text) else text.split(" ")


@dataclass
class Lattice:
    """Edges of many units' lattices, sorted by the node they end at."""

    start: np.ndarray  # node that an edge starts at
    piece: np.ndarray  # its id; the number of pieces stands for the bytes of a character
    raw: np.ndarray  # code points
    first_char: np.ndarray  # of an edge, as place in raw
    key: np.ndarray  # for sampling: node it ends at, and share of the ways so far, in GRID bits
    firsts: np.ndarray  # first node of each unit
    lasts: np.ndarray  # and last one

    def joined(self, other: Lattice) -> Lattice:
        nodes, chars = int(self.lasts[-1]) + 1, len(self.raw)
        cat = np.concatenate
        return Lattice(cat([self.start, other.start + np.int32(nodes)]), cat([self.piece, other.piece]), cat([self.raw, other.raw]), cat([self.first_char, other.first_char + np.int32(chars)]), cat([self.key, other.key + (nodes << GRID)]), cat([self.firsts, other.firsts + nodes]), cat([self.lasts, other.lasts + nodes]))


class Pieces:
    """A piece's weight is (1 + its rank) ** -alpha; a way through the lattice weighs the product of its pieces.

    Ways stay within units (no piece of a model with spaces ahead goes over). A character that is no piece becomes its bytes.
    alpha: how far frequent pieces and short ways are preferred.
    """

    def __init__(self, proto: bytes, alpha: float = 1.0) -> None:
        model = sentencepiece.SentencePieceProcessor(model_proto=proto)
        n = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        byte = [i for i in range(n) if model.is_byte(i)]
        self.first_byte, self.size = byte[0], n
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        rank = np.full(n + 1, len(plain), np.float64)
        rank[plain] = np.arange(len(plain))
        self.weight = -alpha * np.log1p(rank)
        self.share = np.exp(self.weight)
        self.bytes = [b"" if model.is_control(i) or model.is_unknown(i) else bytes([i - byte[0]]) if model.is_byte(i) else names[i].replace("▁", " ").encode() for i in range(n)]
        self.stored = pa.array(self.bytes, pa.large_binary())
        self.sizes = np.array([len(b) for b in self.bytes])
        codes = sorted({ord(c) for i in plain for c in names[i]})
        self.code = np.zeros(0x110000, np.int32)
        self.code[codes] = np.arange(1, len(codes) + 1)
        self.codes = len(codes) + 1
        nodes: dict[tuple[int, int], int] = {}
        last: dict[int, int] = {}
        for i in plain:
            at = 0
            for c in names[i]:
                at = nodes.setdefault((at, int(self.code[ord(c)])), len(nodes) + 1)
            last[at] = i
        keys = np.array([a * self.codes + c for a, c in nodes], np.int64)
        self.slots, self.next = np.full(1 << SLOTS, -1, np.int64), np.zeros(1 << SLOTS, np.int64)
        at, left = self._slot(keys), np.arange(len(keys))
        following = np.fromiter(nodes.values(), np.int64, len(nodes))
        while len(left):
            free = left[self.slots[at[left]] < 0]
            _, first = np.unique(at[free], return_index=True)
            taken = free[first]
            self.slots[at[taken]], self.next[at[taken]] = keys[taken], following[taken]
            left = left[self.slots[at[left]] != keys[left]]
            at[left] = at[left] + 1 & (1 << SLOTS) - 1
        self.piece = np.full(len(nodes) + 1, -1, np.int64)
        self.piece[list(last)] = list(last.values())
        self.known: dict[str, int] = {}
        self.kept: Lattice | None = None

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOTS)).astype(np.int64)

    def _child(self, keys: np.ndarray) -> np.ndarray:
        """The node that each key (node and code) leads to, or -1: a hash table of open addresses."""
        at = self._slot(keys)
        there = self.slots[at]
        left = np.flatnonzero((there != keys) & (there >= 0))
        while len(left):
            at[left] = at[left] + 1 & (1 << SLOTS) - 1
            there[left] = self.slots[at[left]]
            left = left[(there[left] != keys[left]) & (there[left] >= 0)]
        return np.where(there == keys, self.next[at], -1)

    def _lattices(self, types: list[str]) -> tuple[np.ndarray, Lattice]:
        """Number of each type in a lattice that holds them all: the kept ones and, behind them, new ones, of which short ones are kept while there is room."""
        at = np.fromiter((self.known.get(t, -1) for t in types), np.int64, len(types))
        for room in (True, False):
            new = [k for k in np.flatnonzero(at < 0).tolist() if not room or len(types[k]) <= SHORT]
            if not new or room and self.kept is not None and len(self.kept.start) >= KEPT:
                continue
            more = self._lattice([types[k] for k in new])
            both = more if self.kept is None else self.kept.joined(more)
            at[new] = len(both.firsts) - len(new) + np.arange(len(new))
            if not room:
                return at, both
            self.kept = both
            self.known.update((types[k], int(at[k])) for k in new)
        return at, self.kept

    def _lattice(self, types: list[str]) -> Lattice:
        """The types' lattices."""
        sizes = np.fromiter(map(len, types), np.int64, len(types)) + 1
        raw = np.frombuffer((" " + " ".join(types)).encode("utf-32-le"), np.uint32).astype(np.int64)
        code = np.where(raw == MARK, LITERAL, np.where(raw == 32, MARK, raw))
        code = self.code[code].astype(np.int64)
        of = np.repeat(np.arange(len(types), dtype=np.int32), sizes)
        ends = np.cumsum(sizes)
        limit = ends.astype(np.int32)[of]
        at, node, depth = np.arange(len(code), dtype=np.int32), np.zeros(len(code), np.int64), 0
        starts, lasts, ids = [], [], []
        single = np.zeros(len(code), bool)
        while len(at):
            key = node * self.codes + code[at + depth]
            node = self._child(key)
            hit = node >= 0
            at, node = at[hit], node[hit]
            piece = self.piece[node]
            done = piece >= 0
            starts.append(at[done])
            lasts.append(at[done] + np.int32(depth + 1))
            ids.append(piece[done].astype(np.int32))
            if not depth:
                single[at[done]] = True
            depth += 1
            on = at + depth < limit[at]
            at, node = at[on], node[on]
        bare = np.flatnonzero(~single).astype(np.int32)
        starts.append(bare)
        lasts.append(bare + np.int32(1))
        ids.append(np.full(len(bare), self.size, np.int32))
        # edges of one length come in order of their ends, so each length is put behind those before it at the same end, without a sort
        room = np.zeros(len(code) + 2, np.int32)
        for x in lasts:
            room[x + 1] += 1
        room = np.cumsum(room, dtype=np.int32)
        total = int(room[-1])
        start, last, piece = np.empty(total, np.int32), np.empty(total, np.int32), np.empty(total, np.int32)
        for x, y, z in zip(starts, lasts, ids, strict=True):
            to = room[y]
            start[to], last[to], piece[to] = x, y, z
            room[y] += 1
        w = self.share[piece] * _POWERS[last - start]
        of_edge = of[start]
        level = last - (ends - sizes).astype(np.int32)[of_edge]
        first_char = start
        start, last = start + of_edge, last + of_edge  # as nodes: each type has one more than characters
        firsts = ends - sizes + np.arange(len(types))
        ways = np.zeros(len(code) + len(types))
        ways[firsts] = 1
        long = (sizes > LONG)[of_edge]
        few = np.flatnonzero(~long) if long.any() else np.arange(total)
        order = few[np.argsort(level[few].astype(np.uint8), kind="stable")]
        cuts = np.concatenate([[0], np.cumsum(np.bincount(level[few]))])
        s, t, v = start[order], last[order], w[order]
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            np.add.at(ways, t[i:j], ways[s[i:j]] * v[i:j])
        part = ways[start] * w / np.where(ways[last] > 0, ways[last], 1)
        if long.any():
            part[long] = self._logs(np.flatnonzero(long), start, last, w, level, firsts, len(ways))
        opens = np.flatnonzero(np.concatenate([[True], last[1:] != last[:-1]]))
        degree = np.diff(np.append(opens, total))
        for k in range(1, int(degree.max())):  # sums within each node, which do not depend on what stands before it
            e = opens[degree > k] + k
            part[e] += part[e - 1]
        key = (last.astype(np.int64) << GRID) + np.minimum(np.rint(part * 2.0**GRID), 2**GRID).astype(np.int64)
        closes = opens + degree - 1
        key[closes] = (last[closes].astype(np.int64) + 1) << GRID
        return Lattice(start, piece, raw.astype(np.int32), first_char, key, firsts, firsts + sizes)

    @staticmethod
    def _logs(e: np.ndarray, start: np.ndarray, last: np.ndarray, w: np.ndarray, level: np.ndarray, firsts: np.ndarray, nodes: int) -> np.ndarray:
        """The edges' shares of the ways to their ends by sums of logarithms, for units too long for plain sums."""
        alpha = np.full(nodes, -np.inf)
        alpha[firsts] = 0
        lw = np.log(w)
        order = e[np.argsort(level[e], kind="stable")]
        cuts = np.searchsorted(level[order], np.arange(1, level[order[-1]] + 2))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            x = order[a:b]
            np.logaddexp.at(alpha, last[x], alpha[start[x]] + lw[x])
        return np.exp(alpha[start[e]] + lw[e] - alpha[last[e]])

    def sample(self, texts: list[str], seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts on end, and how many each has. The ids of a text depend on the text and its seed alone."""
        parts = [units(t) for t in texts]
        counts = np.fromiter(map(len, parts), np.int64, len(parts))
        if not counts.sum():
            return np.zeros(0, np.int32), counts
        coded = pa.array([u for p in parts for u in p], pa.large_string()).dictionary_encode()
        kind = coded.indices.to_numpy().astype(np.int64)
        at, lattice = self._lattices(coded.dictionary.to_pylist())
        kind = at[kind]
        start, ids, raw, first_char, key, firsts, lasts = lattice.start, lattice.piece, lattice.raw, lattice.first_char, lattice.key, lattice.firsts, lattice.lasts
        doc = np.repeat(np.arange(len(parts)), counts)
        unit = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
        seed = seeds[doc]
        live, at, first, step, walks = np.arange(len(doc)), lasts[kind], firsts[kind], 0, []
        while len(live):
            e = np.searchsorted(key, (at.astype(np.int64) << GRID) + _uniform(seed[live], unit[live], step), "right")
            walks.append((live.astype(np.int32), e.astype(np.int32)))
            at = start[e]
            on = at > first
            live, at, first, step = live[on], at[on], first[on], step + 1
        size = np.zeros(len(doc), np.int64)
        for live, _ in walks:
            size[live] += 1
        place = np.cumsum(size)
        edges = np.empty(int(place[-1]), np.int64)
        for step in range(len(walks)):
            live, e = walks[step]
            walks[step] = None  # freed as it is placed
            edges[place[live] - 1 - step] = e
        out, per = ids[edges], np.bincount(doc, size, len(parts)).astype(np.int64)
        if (bare := np.flatnonzero(out == self.size)).size:
            spelled = {int(c): [self.first_byte + b for b in chr(c).encode()] for c in np.unique(raw[first_char[edges[bare]]])}
            wide = np.ones(len(out), np.int64)
            wide[bare] = [len(spelled[c]) for c in raw[first_char[edges[bare]]].tolist()]
            of = np.repeat(np.repeat(np.arange(len(doc)), size), wide)
            full = np.repeat(out, wide)
            full[full == self.size] = [b for c in raw[first_char[edges[bare]]].tolist() for b in spelled[c]]
            out, per = full, np.bincount(doc[of], minlength=len(parts))
        return out.astype(np.int32), per

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The texts as bytes: pieces on end, without the space that was added before."""
        ends = np.concatenate([[0], np.cumsum(self.sizes[ids])])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        data = self.stored.take(pa.array(ids)).buffers()[2] if len(ids) else None
        data = data.to_pybytes() if data is not None else b""
        return [data[a + 1 : b] if b > a else b"" for a, b in zip(ends[:-1], ends[1:], strict=True)]


def read_model(path: str = MODEL) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encoded(docs: DataFrame, proto: bytes | None = None, alpha: float = 1.0, seed: int = 0) -> DataFrame:
    """doc_id, ids, and decoded: what the ids decode to, as bytes; for every row.

    The sample depends on doc_id, text and seed alone; rows of equal doc_id and text get the same. A null text counts as empty
    and has no ids; a null doc_id is a key as any other. Texts of any length are encoded whole. docs: doc_id, text; other
    columns are left aside. The model's bytes (a vocabulary, of fixed size) go to the tasks.
    """
    proto = read_model() if proto is None else proto
    shared = docs.sparkSession.sparkContext.broadcast(proto)
    kinds = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(shared.value, alpha)
        for batch in batches:
            # only the texts that are segmented together are held as Python strings
            seeds = batch.column(1).to_numpy().view(np.uint64)
            group = np.cumsum(pc.fill_null(pc.utf8_length(batch.column(2)), 0).to_numpy(zero_copy_only=False)) // TOGETHER
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                texts = [t or "" for t in batch.column(2).slice(a, b - a).to_pylist()]
                ids, counts = pieces.sample(texts, seeds[a:b])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists, pa.array(pieces.decode(ids, counts), pa.binary())], schema=kinds)

    key = F.xxhash64(F.lit(seed), "doc_id", F.col("doc_id").isNull())
    docs = docs.select(F.col("doc_id").cast("long"), "text").select("doc_id", key.alias("key"), "text")
    return docs.mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def op2_sentencepiece(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    """Sampled ids of every whole text: doc_id, n_pieces, ids, decoded_sha256 (of the decoded bytes, which are the text's)."""
    out = encoded(table(spark, sf_dir, "documents") if docs is None else docs)
    return out.select("doc_id", F.size("ids").alias("n_pieces"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))
