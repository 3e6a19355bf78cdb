"""Byte-level BPE by backtracking: longest token matches, kept only where neighbours fit, give the merges' own result.

A sequence of tokens is what the merges give exactly when every token and every pair of neighbours is. So a piece of text is
encoded from the left: the longest token that starts at a place (found for all places in one Aho-Corasick pass) is taken if it fits
the token before it, else the next shorter one; where none fits, the token before is given up and its end is marked as dead. Each
place dies once at most, so the time is linear in the piece. Whether two tokens fit is kept in a table as pairs turn up."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: Encoded pieces and pairs of tokens that a worker remembers, and the longest piece that it remembers (characters).
KNOWN_PIECES, KNOWN_PAIRS, KNOWN_CHARS = 400_000, 500_000, 64
#: Rows are handed on once they hold this many ids or characters.
CHUNK = 2_000_000


def byte_of() -> dict[str, int]:
    """The printable character that the files write for each byte: itself, or for the others 256 and up in turn."""
    shown = {b for a, z in ((0x21, 0x7E), (0xA1, 0xAC), (0xAE, 0xFF)) for b in range(a, z + 1)}
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_vocabulary(path: str = VOCABULARY) -> dict:
    """The file's digest as name, tokens (bytes, in the order of their merges), ids of them, the halves of each, the added tokens,
    and the pattern that splits texts."""
    with open(path, "rb") as f:
        body = f.read()
    whole = json.loads(body)
    model, before, byte = whole["model"], whole["pre_tokenizer"], byte_of()
    if model["merges"] is None or model.get("ignore_merges") or whole["normalizer"] or before["type"] != "ByteLevel" or before["add_prefix_space"] or not before["use_regex"]:
        raise ValueError(f"{path} is not a plain byte-level BPE")
    if any(t[k] for t in whole["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("added tokens with conditions are not supported")
    vocab = model["vocab"]
    tokens, ids, halves, place = [], [], [], {}
    for c in byte:
        place[c] = len(tokens)
        tokens.append(bytes([byte[c]]))
        ids.append(vocab[c])
        halves.append((place[c], place[c]))
    for merge in model["merges"]:
        a, b = merge.split(" ") if isinstance(merge, str) else merge
        if a + b in place:
            raise ValueError(f"two merges give {a + b}")
        place[a + b] = len(tokens)
        tokens.append(tokens[place[a]] + tokens[place[b]])
        ids.append(vocab[a + b])
        halves.append((place[a], place[b]))
    return {"name": hashlib.sha256(body).hexdigest(), "tokens": tokens, "ids": ids, "halves": halves, "added": [(t["content"], t["id"]) for t in whole["added_tokens"]], "split": public_tokenizers.PATTERN}


class Pieces(dict):
    """The ids of pieces of text, worked out where they are new; short ones are remembered, up to a bound."""

    def __init__(self, coder: Coder):
        super().__init__()
        self.coder = coder

    def __missing__(self, text: str) -> tuple[int, ...]:
        ids = self.coder.ids
        out = tuple(ids[k] for k in self.coder.encode_bytes(text.encode()))
        if len(text) <= KNOWN_CHARS:
            if len(self) >= KNOWN_PIECES:
                self.clear()
            self[text] = out
        return out


class Coder:
    """Encodes and decodes by one vocabulary. Inside, a token's number is the place of its merge."""

    def __init__(self, vocabulary: dict):
        tokens, self.ids, self.halves = vocabulary["tokens"], vocabulary["ids"], vocabulary["halves"]
        self.lengths = [len(t) for t in tokens]
        self.merged = {h: k for k, h in enumerate(self.halves) if h[0] != k}
        self.matches = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        number = {t: k for k, t in enumerate(tokens)}
        for t, k in number.items():
            self.matches.add_word(t.decode("latin-1"), k)
        self.matches.make_automaton()
        #: The longest token that begins a token and is shorter.
        self.shorter = [next((number[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in number), -1) for t in tokens]
        self.pairs: dict[int, bool] = {}
        self.pieces = Pieces(self)
        self.split = regex.compile(vocabulary["split"]).findall
        self.added = {t: (i,) for t, i in vocabulary["added"]}
        self.cut = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")").split if self.added else None
        spelled = dict(zip(self.ids, tokens)) | {i: t.encode() for t, i in vocabulary["added"]}
        width = np.zeros(max(spelled) + 1, np.int64)
        for i, t in spelled.items():
            width[i] = len(t)
        self.width, self.at = width, np.cumsum(width) - width
        self.pool = np.frombuffer(b"".join(spelled[i] for i in sorted(spelled)), np.uint8)

    def fits(self, a: int, b: int) -> bool:
        """Whether merging the two tokens' bytes together ends in just these two: no merge across their border comes before
        the merges that make them. The halves next to the border are taken apart, the later merge first."""
        limit = len(self.halves)
        merged, halves = self.merged, self.halves
        while True:
            over = merged.get((a, b))
            if over is not None and over < limit:
                return False
            left = a > b
            for _ in range(2):
                if left:
                    limit, a = a, halves[a][1]
                    if a != limit:
                        break
                else:
                    limit, b = b + 1, halves[b][0]
                    if b + 1 != limit:
                        break
                left = not left
            else:
                return True

    def encode_bytes(self, piece: bytes) -> list[int]:
        """The numbers of the tokens that the merges make of a piece."""
        n = len(piece)
        longest = [0] * n
        lengths, shorter, pairs = self.lengths, self.shorter, self.pairs
        for end, k in self.matches.iter(piece.decode("latin-1")):
            longest[end + 1 - lengths[k]] = k  # a later end is a longer token
        alive = bytearray(b"\1") * (n + 1)
        out: list[int] = []
        pos, token = 0, longest[0]
        while True:
            end = pos + lengths[token]
            ok = alive[end]
            if ok and out:
                pair = out[-1] << 32 | token
                ok = pairs.get(pair)
                if ok is None:
                    if len(pairs) >= KNOWN_PAIRS:
                        pairs.clear()
                    ok = pairs[pair] = self.fits(out[-1], token)
            if ok:
                out.append(token)
                pos = end
                if pos == n:
                    return out
                token = longest[pos]
            elif shorter[token] >= 0:
                token = shorter[token]
            else:
                alive[pos] = 0
                token = out.pop()
                pos -= lengths[token]

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; null is empty. An added token's name in the text is that token."""
        if not text:
            return []
        if self.cut and any(t in text for t in self.added):
            parts = self.cut(text)
            return list(chain.from_iterable(self.added[p] if p in self.added else self.encode(p) for p in parts if p))
        return list(chain.from_iterable(map(self.pieces.__getitem__, self.split(text))))

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids by the table of offsets; unknown ids are passed over, and bytes that are no UTF-8 become U+FFFD."""
        ids = ids[(ids >= 0) & (ids < len(self.width))]
        width = self.width[ids]
        shift = self.at[ids] - (np.cumsum(width) - width)
        return self.pool[np.repeat(shift, width) + np.arange(int(width.sum()))].tobytes().decode("utf-8", "replace")


_coders: dict[str, Coder] = {}


def _coder(name: str, shared) -> Coder:
    """The coder of a broadcast vocabulary, kept by a worker from task to task with the pieces that it knows."""
    if name not in _coders:
        _coders.clear()
        _coders[name] = Coder(shared.value)
    return _coders[name]


def encode(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id and ids of each row of docs, as the vocabulary's own library gives them without special tokens.

    Null and empty texts have no ids; an empty table gives no rows; rows that repeat a doc_id, and rows without one, each come
    out. Other columns are ignored, whatever their names. Each text is encoded whole, however long, in its own task; the
    vocabulary is sent once, as a broadcast of its fixed size, and what a worker remembers of pieces and pairs is bounded."""
    vocabulary = read_vocabulary(path)
    name, shared = vocabulary["name"], docs.sparkSession.sparkContext.broadcast(vocabulary)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(name, shared)
        for batch in batches:
            names, texts = batch.column(0), batch.column(1)
            first, held, size = 0, [], 0
            for i in range(batch.num_rows):
                held.append(coder.encode(texts[i].as_py()))
                size += len(held[-1])
                if size >= CHUNK or i + 1 == batch.num_rows:
                    ends = np.cumsum([0, *map(len, held)])
                    ids = pa.array(np.fromiter(chain.from_iterable(held), np.int32, int(ends[-1])))
                    yield pa.RecordBatch.from_arrays([names.slice(first, len(held)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids)], names=["doc_id", "ids"])
                    first, held, size = i + 1, [], 0

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, ids and text of rows (doc_id, ids); null ids give a null text, no ids the empty one. Ids outside the vocabulary
    and nulls among the ids are passed over; an empty table gives no rows, and other columns are ignored."""
    vocabulary = read_vocabulary(path)
    name, shared = vocabulary["name"], encoded.sparkSession.sparkContext.broadcast(vocabulary)
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(name, shared)
        for batch in batches:
            names, ids = batch.column(0), batch.column(1)
            first, held, size = 0, [], 0
            for i in range(batch.num_rows):
                one = ids[i].values
                held.append(None if one is None else coder.decode(one.drop_null().to_numpy(zero_copy_only=False)))
                size += len(held[-1] or "")
                if size >= CHUNK or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([names.slice(first, len(held)), ids.slice(first, len(held)), pa.array(held, pa.string())], names=["doc_id", "ids", "text"])
                    first, held, size = i + 1, [], 0

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, ids array<int>, text string")


def bpe_digest(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids joined by commas) and decoded_sha256 of each row; rows as in encode()."""
    return decode(encode(docs, path), path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )
