"""Piece encoding with a SentencePiece BPE vocabulary, seeded merge-dropout, and lossless decoding.

A unit is a run of spaces with the word after it. No piece of the vocabulary crosses a unit's edge (checked when it is
loaded), so units are encoded apart. An agenda takes the best-ranked merge of two neighbouring pieces again and again; a
candidate merge, known by its document, unit and place, is skipped for good when its keyed hash falls below the dropout
rate. Every occurrence of a word has a key of its own, so a word comes out in as many segmentations as chance gives it.

All units of a chunk of texts go through their agendas together: a chunk is one array of symbols, and each step takes the
next merge of every unit that still has one."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textkernels import mix

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DROPOUT, SEED = 0.1, 13
#: Units longer than this go through a heap one by one; the others step together.
SHORT = 63
#: Texts are taken together up to this many characters; a longer text is taken alone, whole.
CHUNK_CHARS = 500_000
SPACE = "▁"
_NEVER = float("inf")
_LOW = np.uint64(0xFFFFFFFF)


def read_model(path: str = MODEL) -> dict:
    """Pieces and scores of a BPE model with byte fallback, identity normalisation and a dummy prefix."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    size = m.get_piece_size()
    plain = [i for i in range(size) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))]
    pieces = {m.id_to_piece(i): i for i in plain}
    crossing = [p for p in pieces if SPACE in p.lstrip(SPACE)]
    if crossing or any("\n" in p for p in pieces) or any(c not in pieces for p in pieces for c in p):
        raise ValueError("pieces of this model cross word edges or hold characters that are no pieces; such models aren't supported")
    byte_ids = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    if any(not m.is_byte(i) for i in byte_ids):
        raise ValueError("this model has no byte fallback, so it can't encode every text without loss")
    return {"pieces": pieces, "rank": {p: -m.get_score(i) for p, i in pieces.items()}, "bytes": byte_ids, "size": size}


def unit_keys(start: np.ndarray, index: np.ndarray) -> np.ndarray:
    """32-bit keys of units by their document's key and their place in it."""
    return mix((start.astype(np.uint64) << np.uint64(32)) + index.astype(np.uint64)) >> np.uint64(32)


def skipped(key: int, start: int, middle: int, end: int, limit: int) -> bool:
    """Whether the merge of [start, middle) and [middle, end) is dropped: limit is the rate times 2^32."""
    h = (key ^ (start * 73856093 + middle * 19349663 + end * 83492791)) * 2654435761 & 0xFFFFFFFF
    return (h ^ (h >> 15)) * 2246822519 & 0xFFFFFFFF < limit


def segment_short(chars: list[str], rank: dict, key: int, limit: int) -> list[str]:
    parts, at, get, never = list(chars), list(range(len(chars) + 1)), rank.get, _NEVER
    ranks = [get(a + b, never) for a, b in zip(parts, parts[1:])]
    while ranks:
        best = min(ranks)
        if best == never:
            break
        i = ranks.index(best)
        if limit and skipped(key, at[i], at[i + 1], at[i + 2], limit):
            ranks[i] = never
            continue
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del at[i + 1], ranks[i]
        if i < len(ranks):
            ranks[i] = get(parts[i] + parts[i + 1], never)
        if i:
            ranks[i - 1] = get(parts[i - 1] + parts[i], never)
    return parts


def segment_long(chars: list[str], rank: dict, key: int, limit: int) -> list[str]:
    """The same by a heap, for units of any length."""
    n = len(chars)
    piece, end, before, after = list(chars), list(range(1, n + 1)), list(range(-1, n - 1)), [*range(1, n), -1]
    heap: list[tuple[float, int, int, int]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j >= 0 and (r := rank.get(piece[i] + piece[j])) is not None:
            heapq.heappush(heap, (r, i, j, end[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, j, stop = heapq.heappop(heap)
        if piece[i] is None or after[i] != j or end[j] != stop or piece[j] is None:
            continue
        if limit and skipped(key, i, j, stop, limit):
            continue
        piece[i], end[i], piece[j] = piece[i] + piece[j], stop, None
        after[i] = after[j]
        if after[i] >= 0:
            before[after[i]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [p for p in piece if p is not None]


class PairTable:
    """Merges by their two symbols, for arrays of pairs: an open-addressed table of key, rank and merged piece. Symbols below
    size are pieces; a character that is no piece is the symbol size + code point, which never merges."""

    BITS, NONE = 19, np.int32(2**31 - 1)
    SPAN = 1 << 21

    def __init__(self, model: dict):
        pieces, rank, self.size = model["pieces"], model["rank"], model["size"]
        order = {r: k for k, r in enumerate(sorted(set(rank.values())))}
        found = [(pieces[p[:j]] * self.SPAN + pieces[p[j:]], order[rank[p]], i) for p, i in pieces.items() for j in range(1, len(p)) if p[:j] in pieces and p[j:] in pieces]
        if len(order) >= 1 << 24 or 2 * len(found) > 1 << self.BITS or self.size + 0x110000 > self.SPAN:
            raise ValueError("this vocabulary is too large for the table of merges")
        self.keys = np.full(1 << self.BITS, -1, np.int64)
        self.rank, self.merged = np.full(1 << self.BITS, self.NONE), np.zeros(1 << self.BITS, np.int32)
        slots = self._slot(np.array([key for key, _, _ in found], np.int64)).tolist()
        for at, (key, r, i) in zip(slots, found):
            while self.keys[at] >= 0:
                at = (at + 1) & ((1 << self.BITS) - 1)
            self.keys[at], self.rank[at], self.merged[at] = key, r << 6, i
        self.char = np.arange(self.size, self.size + 0x110000, dtype=np.int32)
        for p, i in pieces.items():
            if len(p) == 1 and p != SPACE:
                self.char[ord(p)] = i
        self.char[ord(" ")] = pieces[SPACE]

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.BITS)).view(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Slots of the merges of pairs; the rank there (times 64) is NONE where there is no merge."""
        key = left.astype(np.int64) * self.SPAN + right
        at = self._slot(key)
        seen = self.keys[at]
        wrong = np.flatnonzero((seen != key) & (seen >= 0))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & ((1 << self.BITS) - 1)
            seen = self.keys[at[wrong]]
            wrong = wrong[(seen != key[wrong]) & (seen >= 0)]
        return at


def segment_units(symbols: np.ndarray, length: np.ndarray, keys: np.ndarray, table: PairTable, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, whether each still stands) after the agendas of many units of at most SHORT symbols, which follow one another
    in symbols; each step takes one candidate merge of every unit. The same as segment_short on each."""
    out, stands = symbols.copy(), np.ones(len(symbols), bool)
    many = length > 1
    own = np.repeat(many, length)
    where, length, keys = np.flatnonzero(own), length[many], keys[many]
    none = table.NONE
    sym, here = symbols[where], stands[where]
    first = np.cumsum(length) - length
    place = (np.arange(len(sym)) - np.repeat(first, length)).astype(np.int32)  # of a symbol's first character in its unit
    after, before = place + 1, place - 1  # places of the neighbours
    slot = np.zeros(len(sym), np.int64)
    rank = np.full(len(sym), none, np.int32)  # of the merge with the next symbol, times 64, plus place: the least goes first
    if len(sym):
        inner = np.flatnonzero(after != np.repeat(length, length))
        slot[inner] = table.find(sym[inner], sym[inner + 1])
        r = table.rank[slot[inner]]
        rank[inner] = np.where(r < none, r + place[inner], none)
    while len(first):
        best = np.minimum.reduceat(rank, first)
        live = best < none
        n = int(live.sum())
        if 2 * n < len(first):  # units that are done leave
            stay = np.repeat(live, length)
            out[where], stands[where] = sym, here
            where, sym, here, place, after, before, slot, rank = (x[stay] for x in (where, sym, here, place, after, before, slot, rank))
            length, keys, best = length[live], keys[live], best[live]
            first = np.cumsum(length) - length
            if not n:
                break
            f, own, stop = first, keys, length
        else:
            best, f, own, stop = best[live], first[live], keys[live], length[live]
        i = f + (best & 63)
        mid = after[i]
        j = f + mid
        end = after[j]
        if limit:
            h = (own ^ (place[i].astype(np.uint64) * np.uint64(73856093) + mid.astype(np.uint64) * np.uint64(19349663) + end.astype(np.uint64) * np.uint64(83492791))) * np.uint64(2654435761) & _LOW
            drop = ((h ^ (h >> np.uint64(15))) * np.uint64(2246822519) & _LOW) < np.uint64(limit)
            rank[i[drop]] = none
            do = ~drop
            i, j, end, f, stop = i[do], j[do], end[do], f[do], stop[do]
        sym[i] = table.merged[slot[i]]
        here[j] = False
        rank[i], rank[j] = none, none
        after[i] = end
        more = end < stop
        x, z = i[more], (f + end)[more]
        before[z] = place[x]
        got = table.find(sym[x], sym[z])
        r = table.rank[got]
        slot[x], rank[x] = got, np.where(r < none, r + place[x], none)
        led = before[i] >= 0
        x = i[led]
        z = f[led] + before[x]
        got = table.find(sym[z], sym[x])
        r = table.rank[got]
        slot[z], rank[z] = got, np.where(r < none, r + place[z], none)
    if len(where):
        out[where], stands[where] = sym, here
    return out, stands


class Coder:
    def __init__(self, model: dict, dropout: float = DROPOUT, seed: int = SEED):
        self.model, self.limit, self.seed, self.table = model, int(dropout * 2**32), seed, PairTable(model)
        surface = [b""] * model["size"]
        for p, i in model["pieces"].items():
            surface[i] = p.replace(SPACE, " ").encode("utf-8", "surrogatepass")
        for b, i in enumerate(model["bytes"]):
            surface[i] = bytes([b])
        self.width = np.array([len(x) for x in surface])
        self.at, self.pool = np.cumsum(self.width) - self.width, np.frombuffer(b"".join(surface), np.uint8)
        self.bytes = np.array(model["bytes"], np.int32)
        self.name = {i: p for p, i in model["pieces"].items() if len(p) == 1}

    def start(self, name) -> int:
        """The key of the document of this doc_id."""
        return zlib.crc32(str(name).encode("utf-8", "surrogatepass"), self.seed & 0xFFFFFFFF)

    def encode(self, text: str | None, start: int = 0) -> np.ndarray:
        """ids of the text; none for null or empty."""
        return self.encode_many([text], [start])[0]

    def _alone(self, symbols: list[int], key: int) -> list[int]:
        """Symbols of one unit of any length after its agenda."""
        pieces, size, name = self.model["pieces"], self.model["size"], self.name
        # a literal U+2581 is no space, so it must not merge like one
        chars = [name[s] if s < size else "\0" + SPACE if s == size + ord(SPACE) else chr(s - size) for s in symbols]
        return [pieces.get(p, size + ord(p[-1])) for p in segment_long(chars, self.model["rank"], key, self.limit)]

    def encode_many(self, texts: list[str | None], starts: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, one after another; where each text's ids begin, and the end)."""
        whole = "".join(" " + t for t in texts if t)
        sizes = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
        if not whole:
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        chars = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        begins = np.cumsum(sizes) - sizes
        line, space = chars == 10, chars == 32
        edge = line | (space & ~np.concatenate(([False], space[:-1])))
        edge[1:] |= line[:-1]
        edge[begins[sizes > 0]] = True
        first = np.flatnonzero(edge)
        length = np.diff(np.append(first, len(chars)))
        doc = np.searchsorted(begins + sizes, first, "right")
        index = np.arange(len(first)) - np.searchsorted(first, begins)[doc]
        keys = unit_keys(np.array(starts, np.uint64)[doc], index)
        symbols = self.table.char[chars]
        long = np.flatnonzero(length > SHORT)
        if len(long):
            # a long unit stands as one symbol while the others step, and then as what the heap makes of it
            alone = np.ones(len(symbols), bool)
            for u in long.tolist():
                alone[first[u] + 1 : first[u] + length[u]] = False
            parts = [self._alone(symbols[first[u] : first[u] + length[u]].tolist(), int(keys[u])) for u in long.tolist()]
            short = symbols[alone]
            shorter = np.where(length > SHORT, 1, length)
            out, stands = segment_units(short, shorter, keys, self.table, self.limit)
            at = (np.cumsum(shorter) - shorter)[long]
            pieces_of, last = [], 0
            for a, ids in zip(at.tolist(), parts):
                pieces_of += [out[last:a][stands[last:a]], np.array(ids, np.int32)]
                last = a + 1
            pieces_of.append(out[last:][stands[last:]])
            made = np.concatenate(pieces_of)
            counts = np.add.reduceat(stands.astype(np.int64), np.cumsum(shorter) - shorter)
            counts[long] = [len(x) for x in parts]
        else:
            out, stands = segment_units(symbols, length, keys, self.table, self.limit)
            made = out[stands]
            counts = np.add.reduceat(stands.astype(np.int64), first)
        owner = np.repeat(doc, counts)
        rare = made >= self.table.size
        if rare.any():
            made, owner = self._as_bytes(made, owner, rare)
        return made, np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(texts)))))

    def _as_bytes(self, made: np.ndarray, owner: np.ndarray, rare: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols that are no pieces as the pieces of their UTF-8 bytes."""
        points = np.where(rare, made - self.table.size, 0)
        times = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        times[~rare] = 1
        out, k = np.repeat(made, times), np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
        is_rare, point, total = np.repeat(rare, times), np.repeat(points, times), np.repeat(times, times)
        rest = point >> (6 * (total - 1 - k))
        lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[total]
        byte = np.where(k == 0, rest | lead, (rest & 0x3F) | 0x80)
        out[is_rare] = self.bytes[byte[is_rare]]
        return out, np.repeat(owner, times)

    def surfaces(self, ids: np.ndarray) -> bytes:
        """The bytes that ids stand for."""
        width = self.width[ids]
        shift = self.at[ids] - (np.cumsum(width) - width)
        return self.pool[np.repeat(shift, width) + np.arange(int(width.sum()))].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        return self.surfaces(ids)[1:].decode("utf-8", "surrogatepass")

    def lossless(self, texts: list[str | None], ids: np.ndarray, at: np.ndarray) -> list[bool]:
        """Whether the ids of each text decode to it."""
        if self.surfaces(ids) == "".join(" " + t for t in texts if t).encode("utf-8", "surrogatepass") and not any(at[i + 1] > at[i] for i, t in enumerate(texts) if not t):
            whole = np.cumsum(np.concatenate(([0], self.width[ids])))[at]
            want = np.cumsum([0] + [len(t.encode("utf-8", "surrogatepass")) + 1 if t else 0 for t in texts])
            if (whole == want).all():
                return [True] * len(texts)
        return [self.decode(ids[a:b]) == (t or "") for t, a, b in zip(texts, at[:-1], at[1:])]


_coders: dict[tuple, Coder] = {}


def _coder(shared, dropout: float, seed: int) -> Coder:
    name = (shared.id if hasattr(shared, "id") else id(shared), dropout, seed)
    if name not in _coders:
        _coders.clear()
        _coders[name] = Coder(shared.value, dropout, seed)
    return _coders[name]


def encode(docs: DataFrame, model_path: str = MODEL, dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids, lossless (whether decoding the ids gave the text again).

    Equal seeds and rows give equal ids wherever they run; dropout 0 gives the model's own encoding. Null and empty texts
    have no ids and are lossless; an empty table gives no rows. Repeated rows come out alike, and merges of equal rank go
    from the left; other columns are ignored, whatever their names. Each text is encoded whole, however long, in its own
    task; the vocabulary is sent once, as a broadcast of its fixed size."""
    shared = docs.sparkSession.sparkContext.broadcast(read_model(model_path))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared, dropout, seed)
        for batch in batches:
            names, texts = batch.column(0), batch.column(1)
            starts = [coder.start(n) for n in names.to_pylist()]
            first = 0
            while first < batch.num_rows:
                held, size = [], 0
                while first + len(held) < batch.num_rows and (not held or size <= CHUNK_CHARS):
                    held.append(texts[first + len(held)].as_py())
                    size += len(held[-1] or "")
                ids, at = coder.encode_many(held, starts[first : first + len(held)])
                same = coder.lossless(held, ids, at)
                yield pa.RecordBatch.from_arrays(
                    [names.slice(first, len(held)), pa.array(np.diff(at)), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32())), pa.array(same, pa.bool_())],
                    names=["doc_id", "n_tokens", "ids", "lossless"],
                )
                first += len(held)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids array<int>, lossless boolean")


def decode(encoded: DataFrame, model_path: str = MODEL) -> DataFrame:
    """doc_id and text of rows (doc_id, ids); null ids give null."""
    shared = encoded.sparkSession.sparkContext.broadcast(read_model(model_path))
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared, 0.0, 0)
        for batch in batches:
            texts = [None if x.as_py() is None else coder.decode(np.array(x.as_py(), np.int32)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")
