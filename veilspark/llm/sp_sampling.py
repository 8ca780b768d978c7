"""Sampled SentencePiece segmentations by forward filtering and backward sampling, and lossless decoding.

A text's lattice has an edge for every piece that matches at a place (bytes where a character is no piece). The
forward pass sums the weights of all segmentations up to each place; the backward pass draws the last piece in
proportion to what leads to it, then the one before, and so on: an exact draw among all segmentations. No piece
holds a space after another character, so that a lattice falls apart before each run of spaces. Equal parts of
a batch share their forward pass, and a worker keeps those of short parts, KEPT_GROUPS characters at most; the
passes of all new parts advance together, one column of their lattices a round, long parts in blocks. The piece that
ends at a place is drawn by a number that the row key, the part's place and that place give, never batches or
partitions; so a long part's pieces can be drawn at all its places at once and followed from the end.

The vocabulary has ranks, not probabilities. A piece of rank r weighs (r + 1) ** -sharpness (Zipf's law for 1),
a byte as much as the last piece.

Defined results: null text is the empty text, its segmentation the one dummy space; the same text under another
key is drawn anew, repeated rows are drawn alike; a very long text costs in proportion to its length, with or without
spaces; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from veilspark.llm.common import slices, texts

#: Characters of a part that is kept, and of all that a worker keeps. Characters of a block, blocks whose maps are found at once.
KEPT_PART, KEPT_GROUPS = 48, 2_000_000
BLOCK, BLOCKS = 256, 512
SMALL, LIFT = 1e-150, 1e150


class Edges(NamedTuple):
    """Lattices of parts, one after another. Each character ends a group of edges; a part's groups follow each other.

    chars: groups of each part; count: edges of each group; start: the place in the part where an edge begins;
    piece: its id, or -1 - code point; share: the group's probability up to and with this edge.
    """

    chars: np.ndarray
    count: np.ndarray
    start: np.ndarray
    piece: np.ndarray
    share: np.ndarray

    def then(self, other: Edges) -> Edges:
        return Edges(*(np.concatenate(pair) for pair in zip(self, other, strict=True)))


NO_EDGES = Edges(*(np.empty(0, dtype=t) for t in (np.int64, np.int64, np.int32, np.int32, np.float64)))


class Vocabulary:
    def __init__(self, path: str, sharpness: float):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        self.ids: dict[str, int] = {}
        raw: list[bytes] = []
        self.byte_ids = np.zeros(256, dtype=np.int64)
        for i in range(self.size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[1:-1], 16)] = i
                raw.append(bytes([int(piece[1:-1], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                raw.append(b"")
            else:
                text = piece.replace("▁", " ")
                if re.search("[^ ] ", text):
                    raise ValueError(f"the piece {piece!r} has a space inside")
                self.ids[text] = i
                raw.append(text.encode())
        self.raw = pa.array(raw, pa.large_binary())
        self.longest = max(map(len, self.ids))
        self.log = -sharpness * np.log(np.arange(self.size) + 1.0)
        self.log[self.byte_ids] = self.log[-1]
        self.log -= np.log(np.exp(self.log).sum())
        self.weight = np.exp(self.log)
        self._index()
        self.known: dict[bytes, int] = {}
        self.kept = NO_EDGES

    def _index(self) -> None:
        """The pieces' prefixes as numbered nodes: (node, code point) pairs, sorted, and where they lead."""
        nodes, steps, ends = {"": 0}, {}, [-1]
        for text, piece in self.ids.items():
            for i, c in enumerate(text):
                if text[: i + 1] not in nodes:
                    nodes[text[: i + 1]] = len(nodes)
                    ends.append(-1)
                    steps[nodes[text[:i]] << 21 | ord(c)] = nodes[text[: i + 1]]
            ends[nodes[text]] = piece
        self.step_keys = np.array(sorted(steps), dtype=np.int64)
        self.step_to = np.array([steps[k] for k in self.step_keys.tolist()], dtype=np.int64)
        self.node_piece = np.array(ends, dtype=np.int64)
        self.first_node = np.zeros(0x110000, dtype=np.int32)  # by code point; 0: no piece begins so
        root = self.step_keys < 1 << 21
        self.first_node[self.step_keys[root]] = self.step_to[root]

    def lattices(self, parts: list[bytes]) -> Edges:
        """The forward pass of each part."""
        if not parts:
            return NO_EDGES
        line = [p.decode() for p in parts]
        chars = np.array([len(p) for p in line], dtype=np.int64)
        point = np.frombuffer("".join(line).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        part = np.repeat(np.arange(len(parts)), chars)
        begin = np.cumsum(chars) - chars
        place = np.arange(len(point)) - begin[part]
        left = chars[part] - place
        at, node = np.arange(len(point)), self.first_node[point].astype(np.int64)
        piece = np.where(node > 0, self.node_piece[node], -1)
        found = [(at, np.where(piece < 0, -1 - point, piece))]
        on = (node > 0) & (left > 1)
        at, node = at[on], node[on]
        for depth in range(1, self.longest):
            key = node << 21 | point[at + depth]
            step = np.minimum(np.searchsorted(self.step_keys, key), len(self.step_keys) - 1)
            hit = self.step_keys[step] == key
            at, node = at[hit], self.step_to[step[hit]]
            piece = self.node_piece[node]
            found.append((at[piece >= 0], piece[piece >= 0]))
            on = left[at] > depth + 1
            at, node = at[on], node[on]
        count = np.zeros(len(point), dtype=np.int64)
        for depth, (at, _) in enumerate(found):
            count[at + depth] += 1
        next_edge = np.cumsum(count) - count
        start, piece = (np.empty(int(count.sum()), dtype=np.int64) for _ in range(2))
        for depth, (at, pieces) in reversed(list(enumerate(found))):  # the longest first, a group's edges by their start
            edge = next_edge[at + depth]
            start[edge], piece[edge] = at, pieces
            next_edge[at + depth] += 1
        end = np.repeat(np.arange(len(point)), count)
        wide = 1 + (point >= 0x80).astype(np.int64) + (point >= 0x800) + (point >= 0x10000)
        weight = np.where(piece >= 0, self.weight[piece], self.weight[self.byte_ids[0]] ** wide[end])
        value = self._forward(chars, begin, part, place, count, start, end, weight)
        first, total, share = np.cumsum(count) - count, np.zeros(len(point)), np.empty(len(start))
        for k in range(int(count.max())):
            some = np.flatnonzero(count > k)
            total[some] += value[first[some] + k]
            share[first[some] + k] = total[some]
        share /= total[end]
        share[first + count - 1] = 1.0
        return Edges(chars, count, place[start].astype(np.int32), piece.astype(np.int32), share)

    def _forward(self, chars, begin, part, place, count, start, end, weight) -> np.ndarray:  # noqa: ANN001
        """What leads through each edge, relative to the others of its group.

        Parts fall into blocks of BLOCK characters, all of which advance together. What a block leads to depends on the
        `longest` places up to its begin, linearly: the map of every block but a part's last is found first, then the
        maps are applied one after another, then all blocks advance from what they begin with.
        """
        step = place // BLOCK
        per = -(-chars // BLOCK)
        first = np.cumsum(per) - per
        block = first[part] + step
        slot = start - begin[part[end]] - BLOCK * step[end] + self.longest - 1
        states = np.zeros((int(per.sum()), self.longest, 1))
        states[first, -1] = 1.0
        at = np.concatenate([[0], np.cumsum(count)])
        opens = np.concatenate([np.flatnonzero(np.diff(block, prepend=-1)), [len(block)]])  # the first character of each block
        follows = np.flatnonzero(np.diff(np.repeat(np.arange(len(per)), per)) == 0)  # blocks that another follows
        for i in range(0, len(follows), BLOCKS):
            some = follows[i : i + BLOCKS]
            low, high = some[0], some[-1] + 1
            rows, edges = slice(opens[low], opens[high]), slice(at[opens[low]], at[opens[high]])
            units = np.broadcast_to(np.eye(self.longest), (high - low, self.longest, self.longest))
            maps = self._advance(block[rows] - low, place[rows] % BLOCK, count[rows], slot[edges], weight[edges], units)[0]
            for b in some.tolist():
                state = (maps[b - low] * states[b, :, 0]).sum(axis=1)
                states[b + 1, :, 0] = state / state.max()
        value = np.empty(len(start))
        for low in range(0, len(states), BLOCKS * self.longest):
            high = min(low + BLOCKS * self.longest, len(states))
            rows, edges = slice(opens[low], opens[high]), slice(at[opens[low]], at[opens[high]])
            value[edges] = self._advance(block[rows] - low, place[rows] % BLOCK, count[rows], slot[edges], weight[edges], states[low:high])[1]
        return value

    def _advance(self, block, column, count, slot, weight, states) -> tuple[np.ndarray, np.ndarray]:  # noqa: ANN001
        """All blocks from their states (block, place, way): the last places of each, and what leads through each edge (by the
        first way). A column of all blocks a round; small weights are lifted on the way, for all ways alike."""
        ahead = self.longest
        alpha = np.zeros((len(states), ahead + BLOCK, states.shape[2]))
        alpha[:, :ahead] = states
        end = np.repeat(np.arange(len(count)), count)
        groups = np.argsort(column.astype(np.uint8), kind="stable")
        edges = np.argsort(column[end].astype(np.uint8), kind="stable")
        value = np.empty(len(slot))
        g = e = 0
        for c, many in enumerate(np.bincount(column).tolist()):
            mine_groups = groups[g : g + many]
            sizes = count[mine_groups]
            mine = edges[e : e + int(sizes.sum())]
            g, e = g + many, e + len(mine)
            led = alpha[block[end[mine]], slot[mine]] * weight[mine, None]
            value[mine] = led[:, 0]
            sums = np.add.reduceat(led, np.cumsum(sizes) - sizes)
            at = block[mine_groups]
            alpha[at, ahead + c] = sums
            low = at[sums.max(axis=1) < SMALL]
            if len(low):
                alpha[low, c : c + ahead + 1] *= LIFT
        return alpha[:, BLOCK:], value

    def edges_of(self, parts: list[bytes]) -> tuple[np.ndarray, Edges]:
        """The number of each part in the edges that are returned with them."""
        if len(self.kept.count) > KEPT_GROUPS:
            self.known, self.kept = {}, NO_EDGES
        new = [p for p in parts if p not in self.known]
        once = [p for p in new if len(p) > KEPT_PART]
        new = [p for p in new if len(p) <= KEPT_PART]
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        if new:
            self.kept = self.kept.then(self.lattices(new))
        numbers = dict(zip(once, range(len(self.known), len(self.known) + len(once)), strict=True))
        return np.array([numbers[p] if p in numbers else self.known[p] for p in parts], dtype=np.int64), self.kept.then(self.lattices(once)) if once else self.kept


@cache
def vocabulary(path: str, sharpness: float) -> Vocabulary:
    return Vocabulary(path, sharpness)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every bit of the result depends on every bit of x."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def split(raw: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """The distinct parts of all texts (each after its dummy space), and for each part its number, text and place."""
    data = b"".join([b" " + t for t in raw])
    ends = np.cumsum([len(t) + 1 for t in raw])
    begins = np.concatenate([[0], ends[:-1]])
    space = np.frombuffer(data, dtype=np.uint8) == 32
    opens = space.copy()
    opens[1:] &= ~space[:-1]
    opens[begins] = True
    opens[begins[ends - begins > 1] + 1] = False
    cuts = np.flatnonzero(opens)
    offsets = np.append(cuts, len(data))
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
    owner = np.searchsorted(ends, cuts, side="right")
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(), owner, (np.arange(len(cuts)) - np.searchsorted(cuts, begins)[owner]).astype(np.uint64)


def sample(v: Vocabulary, raw: list[bytes], keys: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all texts one after another, and how many each has."""
    parts, which, owner, places = split(raw)
    numbers, edges = v.edges_of(parts)
    which = numbers[which]
    base = np.cumsum(edges.chars) - edges.chars
    stop = np.cumsum(edges.count)
    stream = mixed(mixed(keys.astype(np.int64).view(np.uint64) + np.uint64(seed))[owner] + places * np.uint64(0x9E3779B97F4A7C15))
    chars = edges.chars[which]

    def drawn(of: np.ndarray, base: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The edge drawn for each place `end` of part `of`: the first of its group whose share is over a number of its own."""
        u = (mixed(stream[of] + end.astype(np.uint64)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
        group = base + end - 1
        high = stop[group] - 1
        low = high - edges.count[group] + 1
        for _ in range(v.longest.bit_length()):
            middle = (low + high) >> 1
            over = edges.share[middle] > u
            high, low = np.where(over, middle, high), np.where(over, low, np.minimum(middle + 1, high))
        return high

    at = np.flatnonzero(chars <= KEPT_PART)
    live, end = base[which[at]], chars[at]
    found_at, found_piece = [], []
    while len(at):
        edge = drawn(at, live, end)
        found_at.append(at)
        found_piece.append(edges.piece[edge])
        end = edges.start[edge].astype(np.int64)
        more = end > 0
        at, live, end = at[more], live[more], end[more]
    counts = np.zeros(len(which), dtype=np.int64)
    for a in found_at:
        counts[a] += 1
    paths = {}
    for p in np.flatnonzero(chars > KEPT_PART).tolist():  # drawn at all places, then followed from the end
        n = int(chars[p])
        edge = drawn(np.full(n, p), np.full(n, base[which[p]]), np.arange(1, n + 1))
        before, place, path = edges.start[edge].tolist(), n, []
        while place:
            path.append(place - 1)
            place = before[place - 1]
        paths[p] = edges.piece[edge[path[::-1]]]
        counts[p] = len(path)
    ends = np.cumsum(counts)
    out = np.empty(int(ends[-1]), dtype=np.int64)
    for turn, (a, p) in enumerate(zip(found_at, found_piece, strict=True)):
        out[ends[a] - 1 - turn] = p
    for p, pieces in paths.items():
        out[ends[p] - counts[p] : ends[p]] = pieces
    row = np.repeat(owner, counts)
    if out.min() < 0:  # characters outside the vocabulary become their bytes
        strange = np.flatnonzero(out < 0)
        codes = [chr(-1 - p).encode() for p in out[strange].tolist()]
        times = np.ones(len(out), dtype=np.int64)
        times[strange] = [len(c) for c in codes]
        spread = np.repeat(out < 0, times)
        out, row = np.repeat(out, times), np.repeat(row, times)
        out[spread] = v.byte_ids[np.frombuffer(b"".join(codes), dtype=np.uint8)]
    return out, np.bincount(row, minlength=len(raw))


def decode(v: Vocabulary, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """The texts of segmentations, one after another in ids, without their dummy spaces."""
    pieces = v.raw.take(pa.array(ids))
    offsets, ends = np.frombuffer(pieces.buffers()[1], dtype=np.int64)[: len(ids) + 1], np.cumsum(sizes)
    data = pieces.buffers()[2].to_pybytes()
    return [data[a + 1 : b] for a, b in zip(offsets[ends - sizes].tolist(), offsets[ends].tolist(), strict=True)]


def sampled_segmentations(docs: DataFrame, path: str | None = None, seed: int = 23, sharpness: float = 1.0, with_ids: bool = False) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (little-endian unsigned 32-bit ids), log_prob (of the drawn pieces), lossless; ids if asked for."""
    path = path or public_tokenizers.path("piece_bpe_32k.model")
    names = ["doc_id", "n_pieces", "ids_crc32", "log_prob", "lossless", *(["ids"] if with_ids else [])]

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path, sharpness)
        for batch in slices(batches):
            raw = texts(batch)
            keys = np.array([-1 if k is None else k for k in batch.column("doc_id").to_pylist()], dtype=np.int64)
            ids, sizes = sample(v, raw, keys, seed)
            ends = np.cumsum(sizes)
            bounds = list(zip((ends - sizes).tolist(), ends.tolist(), strict=True))
            packed = memoryview(ids.astype("<u4").tobytes())
            columns = [
                batch.column("doc_id"), pa.array(sizes), pa.array([zlib.crc32(packed[4 * a : 4 * b]) for a, b in bounds], pa.int64()),
                pa.array(np.add.reduceat(v.log[ids], ends - sizes)), pa.array([a == b for a, b in zip(decode(v, ids, sizes), raw, strict=True)]),
            ]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array([ids[a:b].tolist() for a, b in bounds], pa.list_(pa.int64()))] if with_ids else []), names)

    kinds = "doc_id long, n_pieces long, ids_crc32 long, log_prob double, lossless boolean" + (", ids array<long>" if with_ids else "")
    return docs.select("doc_id", "text").mapInArrow(draw, kinds)
