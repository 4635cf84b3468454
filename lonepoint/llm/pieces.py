"""SentencePiece BPE encoding with byte offsets, and decoding.

A text is normalised by longest-prefix replacement through the model's compiled character map, and every
normalised byte keeps the place of the source byte it comes from.  Pieces are found by score-ordered merges
and projected back along these places to spans of the source.  No piece of the models taken here joins a
space mark to text before it, so the text between two marks is encoded on its own and remembered.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lonepoint.llm.words import map_texts

MARK = "▁"
#: Bytes of chunks that a task remembers, about; beyond that the memory starts anew.  A chunk costs so many by itself.
REMEMBERED_BYTES, CHUNK_COST = 32 << 20, 300
#: Longest chunk that is merged in a table with others.
WIDEST = 32

_MARK = MARK.encode()
#: Ids as text, what they decode to, and the length of each piece's output, one byte each.
Chunk = tuple[str, bytes, bytes]
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6
_BPE = 2
_NEVER = 1 << 40


def _fields(data: bytes):
    """``(number, value)`` of a protocol buffer message; nested messages stay bytes."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        if key & 7 == 0:
            value, at = varint(at)
        elif key & 7 == 2:
            size, at = varint(at)
            value, at = data[at : at + size], at + size
        else:
            size = 4 if key & 7 == 5 else 8
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class CharMap:
    """Replacements of byte sequences: a double-array trie and the strings it points to."""

    def __init__(self, blob: bytes):
        self.units, self.strings = [], b""
        if blob:
            size = struct.unpack_from("<I", blob)[0]
            self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist()
            self.strings = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest mapped sequence at ``at`` and what replaces it."""
        if not self.units:
            return None
        found = None
        place = self._child(0, self.units[0])
        for i in range(at, len(data)):
            place ^= data[i]
            if place >= len(self.units):
                break
            unit = self.units[place]
            if unit & 0x800000FF != data[i]:
                break
            place = self._child(place, unit)
            if unit >> 8 & 1:
                value = self.units[place] & 0x7FFFFFFF
                found = i - at + 1, self.strings[value : self.strings.index(0, value)]
        return found

    @staticmethod
    def _child(place: int, unit: int) -> int:
        return place ^ ((unit >> 10) << ((unit & 0x200) >> 6))


class PieceModel:
    """A SentencePiece BPE model with byte fallback, read from its file's bytes."""

    def __init__(self, data: bytes):
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.byte_ids = [0] * 256
        self.output: list[bytes] = []
        kind_of_model, fallback, suffix = 1, 0, 0
        charmap, self.prefix, self.squeeze, self.escape = b"", True, True, True
        for number, value in _fields(data):
            if number == 1:
                part = {1: b"", 2: struct.pack("<f", 0.0), 3: _NORMAL} | dict(_fields(value))
                piece, kind = part[1].decode(), part[3]
                index = len(self.output)
                if kind == _NORMAL:
                    self.ids[piece] = index
                    self.scores[piece] = struct.unpack("<f", part[2])[0]
                    self.output.append(piece.replace(MARK, " ").encode())
                elif kind == _BYTE:
                    self.byte_ids[int(piece[3:5], 16)] = index
                    self.output.append(bytes([int(piece[3:5], 16)]))
                elif kind == _CONTROL:
                    self.output.append(b"")
                elif kind == _UNKNOWN:
                    self.output.append(" ⁇ ".encode())
                else:
                    raise ValueError(f"piece {piece!r}: user-defined and unused pieces are not supported")
            elif number == 2:
                spec = dict(_fields(value))
                kind_of_model, fallback, suffix = spec.get(3, 1), spec.get(35, 0), spec.get(24, 0)
            elif number == 3:
                spec = dict(_fields(value))
                charmap = spec.get(2, b"")
                self.prefix, self.squeeze, self.escape = (bool(spec.get(n, 1)) for n in (3, 4, 5))
        if kind_of_model != _BPE or not fallback or suffix or not self.escape:
            raise ValueError("only BPE models with byte fallback and leading space marks are supported")
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece of the model has a space mark inside")
        self.id_text = [str(i) for i in range(len(self.output))]
        self.plain = [len(o) for o in self.output]
        self._tabulate()
        self.marks = np.zeros(len(self.output), np.int64)
        for piece, index in self.ids.items():
            self.marks[index] = piece.count(MARK)
        self.chars = CharMap(charmap)
        joined = {c for p in self.ids if len(p) > 1 for c in p}
        alone = "" if "\n" in joined else "\n"
        self.chunks = re.compile(f"{MARK}+[^{MARK}{alone}]*|[^{MARK}{alone}]+" + (f"|{alone}" if alone else ""))
        self.memory: dict[str, Chunk] = {}
        self.held = 0

    def _tabulate(self) -> None:
        """Tables of single characters and of all pairs of pieces that make a piece."""
        singles = {ord(p): i for p, i in self.ids.items() if len(p) == 1}
        self.char_ids = np.full(max(singles, default=0) + 1, -1, np.int64)
        self.char_ids[list(singles)] = list(singles.values())
        order = sorted({s for s in self.scores.values()}, reverse=True)
        rank = {s: i for i, s in enumerate(order)}
        pairs = {}
        for piece, index in self.ids.items():
            for cut in range(1, len(piece)):
                left, right = self.ids.get(piece[:cut]), self.ids.get(piece[cut:])
                if left is not None and right is not None:
                    pairs[left * len(self.output) + right] = rank[self.scores[piece]], index
        keys = sorted(pairs) or [-1]
        self.pair_keys = np.array(keys, np.int64)
        self.pair_ranks = np.array([pairs.get(k, (_NEVER, 0))[0] for k in keys], np.int64)
        self.pair_ids = np.array([pairs.get(k, (_NEVER, 0))[1] for k in keys], np.int64)

    def normalise(self, text: str) -> tuple[str, list[int]]:
        """Normalised text, and for each of its bytes, and its end, the byte of the source it comes from."""
        data = text.encode()
        steps, at = [], 0
        while at < len(data):
            found = self.chars.longest(data, at)
            if found is None:
                width = 1 + (data[at] >= 0xC0) + (data[at] >= 0xE0) + (data[at] >= 0xF0)
                found = width, data[at : at + width]
            steps.append((at, *found))
            at += found[0]
        first = 0
        while self.squeeze and first < len(steps) and steps[first][2] == b" ":
            first += 1
        out, places = bytearray(), []
        if self.prefix and first < len(steps):
            out += _MARK
            places += [steps[first][0]] * 3
        after_space = self.squeeze
        for at, width, made in steps[first:]:
            if after_space:
                made = made.lstrip(b" ")
            if made:
                after_space = self.squeeze and made.endswith(b" ")
                same = made == data[at : at + width] and made != b" "
                made = made.replace(b" ", _MARK)
                out += made
                places += range(at, at + len(made)) if same else [at] * len(made)
        end = len(data)
        while self.squeeze and out.endswith(_MARK):
            end = places[-3]
            del out[-3:], places[-3:]
        return out.decode(), [*places, end]

    def merged(self, chunk: str) -> list[str]:
        """Merge neighbours, best score first and leftmost among equals, until no merge is a piece."""
        parts, scores = list(chunk), self.scores
        if len(parts) > 100:
            return self._merged_long(parts)
        none = float("-inf")
        best = [scores.get(a + b, none) for a, b in zip(parts, parts[1:])]
        while best:
            top = max(best)
            if top == none:
                break
            i = best.index(top)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del best[i]
            if i:
                best[i - 1] = scores.get(parts[i - 1] + parts[i], none)
            if i < len(best):
                best[i] = scores.get(parts[i] + parts[i + 1], none)
        return parts

    def _merged_long(self, parts: list[str]) -> list[str]:
        """The same with a heap of candidate pairs over a linked list."""
        n, scores = len(parts), self.scores
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < n:
                pair = parts[i] + parts[j]
                if pair in scores:
                    heapq.heappush(heap, (-scores[pair], i, j, pair))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, pair = heapq.heappop(heap)
            if not parts[i] or not parts[j] or right[i] != j or parts[i] + parts[j] != pair:
                continue
            parts[i], parts[j] = pair, ""
            right[i] = right[j]
            if right[j] < n:
                left[right[j]] = i
            offer(left[i], i)
            offer(i, right[i])
        return [p for p in parts if p]

    def learn(self, chunks: list[str]) -> None:
        """Encode chunks and remember them; short ones of known characters are merged all at once."""
        lengths = np.array([len(c) for c in chunks])
        symbols = self._symbols("".join(chunks))
        ends = np.cumsum(lengths)
        unknown = np.concatenate([[0], np.cumsum(symbols < 0)])
        plain = (lengths <= WIDEST) & (unknown[ends] == unknown[ends - lengths])
        for i in np.flatnonzero(~plain).tolist():
            self.memory[chunks[i]] = self._with_bytes(self.merged(chunks[i]))
        rows = np.flatnonzero(plain)
        if not len(rows):
            return
        # Rows of like length share a table.
        rows = rows[np.argsort(lengths[rows], kind="stable")]
        for part in np.split(rows, np.searchsorted(lengths[rows], [9, 13, 17, 25])):
            if len(part):
                width = int(lengths[part[-1]])
                at = (ends - lengths)[part][:, None] + np.arange(width)
                table = np.where(np.arange(width) < lengths[part][:, None], symbols[np.minimum(at, len(symbols) - 1)], -1)
                self._merge_table(table)
                counts = (table >= 0).sum(1).tolist()
                for i, n, ids in zip(part.tolist(), counts, table.tolist()):
                    ids = ids[:n]
                    text = ",".join([self.id_text[x] for x in ids])
                    raw = b"".join([self.output[x] for x in ids])
                    self.memory[chunks[i]] = text, raw, bytes([self.plain[x] for x in ids])

    def _symbols(self, text: str) -> np.ndarray:
        """The piece of each character, or -1."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        return np.where(codes < len(self.char_ids), self.char_ids[np.minimum(codes, len(self.char_ids) - 1)], -1)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair among the merges, best first, and the piece it makes."""
        keys = left.astype(np.int64) * len(self.output) + right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        known = (self.pair_keys[at] == keys) & (left >= 0) & (right >= 0)
        return np.where(known, self.pair_ranks[at], _NEVER), self.pair_ids[at]

    def _merge_table(self, table: np.ndarray) -> None:
        """Merge the rows of a table of symbols in place; each round takes every row's best, leftmost pair."""
        if table.shape[1] < 2:
            return
        ranks, made = self._ranks(table[:, :-1], table[:, 1:])
        places = np.arange(table.shape[1])
        active = np.arange(len(table))
        while True:
            best = ranks[active].argmin(1)
            go = ranks[active, best] < _NEVER
            active, best = active[go], best[go]
            if not len(active):
                return
            table[active, best] = made[active, best]
            # What stands after the merged pair moves one place to the left.
            shifted = np.minimum(places + (places > best[:, None]), len(places) - 1)
            rows = table[active[:, None], shifted]
            rows[:, -1] = -1
            table[active] = rows
            shifted = np.minimum(places[:-1] + (places[:-1] >= best[:, None]), len(places) - 2)
            moved, moved_made = ranks[active[:, None], shifted], made[active[:, None], shifted]
            moved[:, -1] = _NEVER
            line = np.arange(len(active))
            for side in (best - 1, best):
                inside = (side >= 0) & (side < len(places) - 1)
                a, b = line[inside], side[inside]
                moved[a, b], moved_made[a, b] = self._ranks(rows[a, b], rows[a, b + 1])
            ranks[active], made[active] = moved, moved_made

    def _with_bytes(self, parts: list[str]) -> Chunk:
        """A chunk in which characters without a piece become their bytes."""
        ids, sizes = [], []
        for part in parts:
            index = self.ids.get(part)
            made = [index] if index is not None else [self.byte_ids[b] for b in part.encode()]
            ids += made
            sizes += [len(self.output[i]) for i in made]
        return ",".join(map(str, ids)), b"".join([self.output[i] for i in ids]), bytes(sizes)

    def encode_all(self, texts: list[str | None]) -> list[Encoding]:
        split = []
        for text in texts:
            places = None
            if not text:
                normal = ""
            elif self.chars.units or self.squeeze or MARK in text:
                normal, places = self.normalise(text)
            else:
                # Nothing is replaced but spaces, so places follow from the marks alone.
                normal = (MARK if self.prefix else "") + text.replace(" ", MARK)
            split.append((self.chunks.findall(normal), places))
        if self.held >= REMEMBERED_BYTES:
            self.memory.clear()
            self.held = 0
        memory = self.memory
        new = {c for chunks, _ in split for c in chunks if c not in memory}
        if new:
            self.learn(list(new))
            # A character of a chunk is kept in its text, its output and its ids.
            self.held += CHUNK_COST * len(new) + 8 * sum(map(len, new))
        return [Encoding(self, [memory[c] for c in chunks], places) for chunks, places in split]

    def encode(self, text: str | None) -> Encoding:
        return self.encode_all([text])[0]

    def decode(self, ids: list[int]) -> str:
        """Text of the ids; the space of the first mark goes, bytes that make no character are replaced."""
        return self.finished(b"".join(self.output[i] for i in ids))

    def finished(self, raw: bytes) -> str:
        if self.prefix or self.squeeze:
            raw = raw.lstrip(b" ") if self.squeeze else raw.removeprefix(b" ")
        return raw.decode(errors="replace")


class Encoding:
    """Pieces of one text: ids, byte spans in the source, and the decoded text."""

    def __init__(self, model: PieceModel, chunks: list[Chunk], places: list[int] | None):
        self.model, self.chunks, self.places = model, chunks, places

    def ids(self) -> list[int]:
        return [int(i) for i in self.ids_text().split(",")] if self.chunks else []

    def ids_text(self) -> str:
        return ",".join([c[0] for c in self.chunks])

    def count(self) -> int:
        return sum([len(c[2]) for c in self.chunks])

    def decoded(self) -> str:
        return self.model.finished(b"".join([c[1] for c in self.chunks]))

    def ends(self) -> np.ndarray:
        """End of every piece in the source's bytes; a piece starts where the one before it ends."""
        sizes = np.frombuffer(b"".join([c[2] for c in self.chunks]), np.uint8).astype(np.int64)
        if self.places is None:
            # The mark before the text stands for no byte of it.
            return np.cumsum(sizes) - (1 if self.model.prefix and len(sizes) else 0)
        # Marks have three bytes in the normalised text and one in the output.
        marks = self.model.marks[np.array(self.ids(), np.int64)] if len(sizes) else sizes
        return np.array(self.places, np.int64)[np.cumsum(sizes + 2 * marks)]


def encode(docs: DataFrame, model: bytes) -> DataFrame:
    """``doc_id, ids, ends, decoded`` for every row: pieces, the source byte at which each ends, the text of the ids.

    A null or empty text has no pieces and is decoded as empty.  Repeated rows are encoded alike, an empty table gives no rows.
    Only ``doc_id`` and ``text`` are read; ``model`` is the content of a model file.
    """

    def run(pieces: PieceModel, piece: pa.RecordBatch) -> pa.RecordBatch:
        made = pieces.encode_all(piece.column(1).to_pylist())
        ids, ends = ([np.array(x, np.int64) for x in y] for y in ([m.ids() for m in made], [m.ends() for m in made]))
        at = pa.array(np.cumsum([0, *map(len, ids)]).astype(np.int32))
        return pa.RecordBatch.from_arrays(
            [
                piece.column(0),
                pa.ListArray.from_arrays(at, pa.array(np.concatenate(ids).astype(np.int32))),
                pa.ListArray.from_arrays(at, pa.array(np.concatenate(ends))),
                pa.array([m.decoded() for m in made], pa.string()),
            ],
            ["doc_id", "ids", "ends", "decoded"],
        )

    schema = "doc_id bigint, ids array<int>, ends array<bigint>, decoded string"
    return _with_model(docs.select("doc_id", "text"), model, run, schema)


def decode(encoded: DataFrame, model: bytes) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``; no ids, or null, give an empty text.

    Repeated rows are decoded alike, an empty table gives no rows.
    """

    def run(batches):
        pieces = PieceModel(model)
        for batch in batches:
            texts = [pieces.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


def encode_digests(docs: DataFrame, model: bytes) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256, spans_sha256``: digests of what ``encode`` and ``decode`` make.

    ``spans_sha256`` is over the pieces' ends as 64-bit little-endian integers.  Rows as in ``encode``.
    """

    def run(pieces: PieceModel, piece: pa.RecordBatch) -> pa.RecordBatch:
        columns: tuple[list, ...] = ([], [], [], [])
        for made in pieces.encode_all(piece.column(1).to_pylist()):
            columns[0].append(made.count())
            columns[1].append(hashlib.sha256(made.ids_text().encode()).hexdigest())
            columns[2].append(hashlib.sha256(made.decoded().encode()).hexdigest())
            columns[3].append(hashlib.sha256(made.ends().astype("<i8").tobytes()).hexdigest())
        kinds = (pa.int64(), pa.string(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays(
            [piece.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"],
        )

    return _with_model(
        docs.select("doc_id", "text"),
        model,
        run,
        "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, spans_sha256 string",
    )


def _with_model(docs: DataFrame, model: bytes, function, schema: str) -> DataFrame:
    """Apply ``function(model, rows)`` to bounded pieces; the model is read once per task."""
    loaded: list[PieceModel] = []

    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        if not loaded:
            loaded.append(PieceModel(model))
        return function(loaded[0], piece)

    return map_texts(docs, "text", run, schema)
