"""Merge-type (BPE) encoding and decoding with a SentencePiece vocabulary, by backtracking.

A token sequence is the merge encoding of a text exactly if every pair of neighbours is what
merging their joined text gives, so the encoding is searched left to right: the longest vocabulary
match at a position that is compatible with the token before it, a shorter one if the text behind
can't be finished, and a bitfield of positions that no encoding passes through. Matches come from
an Aho-Corasick automaton; compatibility is decided by merging two tokens again, and remembered.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterable

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import Shared, batch_of, map_batches

SPACE = "▁"
#: Entries that a worker remembers, of chunks (twice) and of pairs; then it starts anew.
MEMO = 250_000
#: Longer chunks are encoded but not remembered.
MEMO_CHARS = 64


def load_vocabulary(model: str | bytes) -> list[tuple[str, float, str]]:
    """(piece, score, kind) by id, kind one of n(ormal), b(yte), u(nknown), c(ontrol). model: path or bytes."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(**({"model_proto": model} if isinstance(model, bytes) else {"model_file": model}))
    return [(p.id_to_piece(i), p.get_score(i), "b" if p.is_byte(i) else "u" if p.is_unknown(i) else "c" if p.is_control(i) else "n") for i in range(p.get_piece_size())]


def chunk_pattern(pieces: Iterable[str]) -> re.Pattern:
    """Cuts where no piece can span: before a space mark that follows another character, and around line
    breaks if no piece has one. If a piece has a space mark inside, the text stays whole."""
    pieces = list(pieces)
    if any(SPACE in p.lstrip(SPACE) for p in pieces):
        return re.compile(r".+", re.S)
    if any("\n" in p for p in pieces):
        return re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
    return re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")


class MergeCodec:
    """Encodes as the library does a model with identity normalisation, a space put in front and byte fallback."""

    def __init__(self, vocabulary: list[tuple[str, float, str]]):
        self.vocabulary = vocabulary
        normal = {p: i for i, (p, _, kind) in enumerate(vocabulary) if kind == "n"}
        self.id_of, self.score = normal, [s for _, s, _ in vocabulary]
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(vocabulary) if kind == "b"}
        self.end = next(i for i, (p, _, kind) in enumerate(vocabulary) if kind == "c" and p == "</s>")
        self.machine = ahocorasick.Automaton()
        for p, i in normal.items():
            self.machine.add_word(p, (len(p) - 1, i))
        self.machine.make_automaton()
        self.size = [len(p) for p, _, _ in vocabulary]
        #: token: the next shorter one that it starts with, or -1
        self.shorter = [next((normal[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in normal), -1) if kind == "n" else -1 for p, _, kind in vocabulary]
        self.chunks, self.known = chunk_pattern(normal), frozenset(p for p in normal if len(p) == 1)
        #: (token before or -1, token): whether they may stand together
        self.pairs: dict[tuple[int, int], bool] = {}
        #: chunk: its ids; when one is full the other is emptied, and what is asked for again moves on
        self.memo: dict[str, str] = {}
        self.older: dict[str, str] = {}
        as_bytes = lambda p, kind: bytes([int(p[3:5], 16)]) if kind == "b" else b"" if kind == "c" else b" \xe2\x81\x87 " if kind == "u" else p.replace(SPACE, " ").encode()
        self.surface = {str(i): as_bytes(p, kind) for i, (p, _, kind) in enumerate(vocabulary)}

    def merged(self, text: str) -> list[int] | None:
        """The plain merge procedure: the pair with the best score first, the leftmost of equals. None if a
        character is left that is no piece."""
        parts: list[str | None] = list(text)
        left, right = [*range(-1, len(parts) - 1)], [*range(1, len(parts) + 1)]
        queue: list[tuple[float, int, int, str]] = []

        def offer(i: int) -> None:
            j = right[i] if i >= 0 else len(parts)
            if 0 <= i and j < len(parts) and (k := self.id_of.get(parts[i] + parts[j])) is not None:
                heapq.heappush(queue, (-self.score[k], i, j, parts[i] + parts[j]))

        for i in range(len(parts)):
            offer(i)
        while queue:
            _, i, j, joined = heapq.heappop(queue)
            if parts[i] is None or j >= len(parts) or parts[j] is None or right[i] != j or parts[i] + parts[j] != joined:
                continue
            parts[i], parts[j], right[i] = joined, None, right[j]
            if right[j] < len(parts):
                left[right[j]] = i
            offer(left[i])
            offer(i)
        ids = [self.id_of.get(p) for p in parts if p is not None]
        return None if None in ids else ids

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the text of both gives both; of b alone if a is -1."""
        if len(self.pairs) >= MEMO:
            self.pairs.clear()
        known = self.merged((self.vocabulary[a][0] if a >= 0 else "") + self.vocabulary[b][0]) == ([a, b] if a >= 0 else [b])
        self.pairs[a, b] = known
        return known

    def segment(self, text: str) -> list[int]:
        """A text of characters that all are pieces."""
        n, size, shorter, known = len(text), self.size, self.shorter, self.pairs.get
        longest = [-1] * n
        for end, (back, token) in self.machine.iter(text):
            longest[end - back] = token  # matches come by their end, so the last one is the longest
        failed = bytearray(n + 1)
        ids: list[int] = []
        pos, last, token = 0, -1, longest[0] if n else -1
        while pos < n:
            while token >= 0:
                if not failed[pos + size[token]]:
                    fits = known((last, token))
                    if self.compatible(last, token) if fits is None else fits:
                        break
                token = shorter[token]
            else:
                failed[pos] = 1
                if not ids:
                    # only with pieces that no merge reaches
                    return self.merged(text)
                token = ids.pop()
                pos -= size[token]
                token = shorter[token]
                last = ids[-1] if ids else -1
                continue
            ids.append(token)
            last = token
            pos += size[token]
            if pos < n:
                token = longest[pos]
        return ids

    def chunk(self, text: str) -> list[int]:
        """Characters that are no pieces become their bytes; what stands between them is encoded apart."""
        if self.known.issuperset(text):
            return self.segment(text)
        ids: list[int] = []
        run = ""
        for c in text:
            if c in self.known:
                run += c
                continue
            if run:
                ids += self.segment(run)
                run = ""
            ids += [self.bytes[b] for b in c.encode("utf-8", "replace")]
        return ids + self.segment(run) if run else ids

    def encode_joined(self, text: str) -> str:
        """The ids with the end id, in decimal, joined by one space."""
        if not text:
            return str(self.end)
        memo, older, parts = self.memo, self.older, []
        for c in self.chunks.findall(SPACE + text.replace(" ", SPACE)):
            if (known := memo.get(c)) is None:
                if (known := older.get(c)) is None:
                    known = " ".join(map(str, self.chunk(c)))
                if len(c) <= MEMO_CHARS:
                    memo[c] = known
                    if len(memo) >= MEMO:
                        older.clear()
                        self.memo, self.older = memo, older = older, memo
            parts.append(known)
        parts.append(str(self.end))
        return " ".join(parts)

    def encode(self, text: str) -> list[int]:
        return [*map(int, self.encode_joined(text).split())]

    def decode_joined(self, ids: str) -> bytes:
        """UTF-8 of the text: pieces joined, byte pieces as bytes, control pieces left out, the first space dropped."""
        out = b"".join(map(self.surface.__getitem__, ids.split()))
        return out[1:] if out[:1] == b" " else out

    def decode(self, ids: Iterable[int]) -> str:
        return self.decode_joined(" ".join(map(str, ids))).decode("utf-8", "replace")


def encode(documents: DataFrame, model: str | bytes) -> DataFrame:
    """doc_id, n_tokens, ids (array<int>, the end id last) for each row of documents(doc_id, text).

    A null text counts as empty and gives the end id alone; repeated rows are encoded one by one;
    other columns are ignored. No shuffle.
    """
    shared = Shared(documents.sparkSession, load_vocabulary(model))

    def start():
        codec = shared.build(MergeCodec)

        def each(batch):
            ids = [codec.encode(t or "") for t in batch["text"].to_pylist()]
            yield batch_of(doc_id=batch["doc_id"], n_tokens=pa.array([*map(len, ids)], pa.int64()), ids=pa.array(ids, pa.list_(pa.int32())))

        return each

    kind = documents.schema["doc_id"].dataType.simpleString()
    return map_batches(documents.select("doc_id", "text"), start, f"doc_id {kind}, n_tokens bigint, ids array<int>")


def decode(encoded: DataFrame, model: str | bytes) -> DataFrame:
    """doc_id, text for each row of encoded(doc_id, ids). Null or empty ids give the empty text."""
    shared = Shared(encoded.sparkSession, load_vocabulary(model))

    def start():
        codec = shared.build(MergeCodec)

        def each(batch):
            yield batch_of(doc_id=batch["doc_id"], text=pa.array([codec.decode(x or []) for x in batch["ids"].to_pylist()], pa.string()))

        return each

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return map_batches(encoded.select("doc_id", "ids"), start, f"doc_id {kind}, text string")


def roundtrip(documents: DataFrame, model: str | bytes) -> DataFrame:
    """Encode every text, then decode the ids: doc_id, n_tokens, ids_sha256, decoded_sha256 (query op9).

    A null text counts as empty: the end id alone, which decodes to the empty text; repeated rows are
    encoded one by one and alike; an empty table gives no rows; other columns are ignored. Time and
    memory grow in proportion to a text's length. No shuffle.
    """
    shared = Shared(documents.sparkSession, load_vocabulary(model))

    def start():
        from hashlib import sha256

        codec = shared.build(MergeCodec)

        def each(batch):
            n, of_ids, of_text = [], [], []
            for t in batch["text"].to_pylist():
                ids = codec.encode_joined(t or "")
                n.append(ids.count(" ") + 1)
                of_ids.append(sha256(ids.encode()).hexdigest())
                of_text.append(sha256(codec.decode_joined(ids).decode("utf-8", "replace").encode()).hexdigest())
            yield batch_of(doc_id=batch["doc_id"], n_tokens=pa.array(n, pa.int64()), ids_sha256=pa.array(of_ids, pa.string()), decoded_sha256=pa.array(of_text, pa.string()))

        return each

    kind = documents.schema["doc_id"].dataType.simpleString()
    return map_batches(documents.select("doc_id", "text"), start, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def encode_checked(documents: DataFrame, model: str | bytes) -> DataFrame:
    """doc_id, n_tokens, ids, ids_sha256, decoded_sha256: encode() and roundtrip() in one pass, and with their
    results for null and empty texts, repeated rows, empty tables and other columns."""
    shared = Shared(documents.sparkSession, load_vocabulary(model))

    def start():
        from hashlib import sha256

        codec = shared.build(MergeCodec)

        def each(batch):
            joined = [codec.encode_joined(t or "") for t in batch["text"].to_pylist()]
            ids = [[*map(int, x.split())] for x in joined]
            of_text = [sha256(codec.decode_joined(x).decode("utf-8", "replace").encode()).hexdigest() for x in joined]
            yield batch_of(
                doc_id=batch["doc_id"], n_tokens=pa.array([*map(len, ids)], pa.int64()), ids=pa.array(ids, pa.list_(pa.int32())),
                ids_sha256=pa.array([sha256(x.encode()).hexdigest() for x in joined], pa.string()), decoded_sha256=pa.array(of_text, pa.string()),
            )

        return each

    kind = documents.schema["doc_id"].dataType.simpleString()
    return map_batches(documents.select("doc_id", "text"), start, f"doc_id {kind}, n_tokens bigint, ids array<int>, ids_sha256 string, decoded_sha256 string")


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def model_bytes(spark: SparkSession, path: str | None = None) -> bytes:
    """The model file as bytes, read on the driver (half a MB; vocabularies are bounded by their file)."""
    with open(path or model_path(), "rb") as f:
        return f.read()
