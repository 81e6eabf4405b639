"""SentencePiece encoding and decoding as a weighted finite-state transducer.

The normaliser (a space before the text, spaces as U+2581), the pieces and the byte fallback are compiled into
one transducer: a trie of states whose final arcs write a piece at the cost of its negated score and return to
the start; a character without a piece writes its UTF-8 bytes at the fallback cost. Composed with a text it
is a lattice over the text's positions. A unigram model's pieces are its tropical-semiring shortest path. The
scores of a BPE model are ranks of merges, which do not add up: there the path starts at the arcs of single
characters, and of all neighbouring arcs those whose joint piece ranks best become one, until none can.

No piece holds U+2581 behind another character, so the path of a text is that of its space-led
segments, one behind the other; workers hold the paths of segments in a bounded cache.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

SPACE = "▁"
SEGMENTS = re.compile(f"[ {SPACE}]*[^ {SPACE}]+|[ {SPACE}]+")
FALLBACK = 10.0  # what a fallback costs beyond the dearest piece


class Transducer:
    """Compiled from (piece, score, kind) rows; kind is normal, byte or another one that no text matches.

    With `merges` the scores are ranks of merges (BPE), else they are summed up along a path (unigram).
    """

    room, longest = 300_000, 64  # segments held, and how long they may be

    def __init__(self, pieces: list[tuple[str, float, str]], dummy_prefix: bool = True, merges: bool = False):
        self.dummy_prefix = dummy_prefix
        self.path = self.merged if merges else self.shortest
        self.ranks: dict[str, tuple[float, int]] = {}
        self.start: dict = {}
        self.byte_id = {}
        self.costs = np.zeros(len(pieces))
        self.output: list[bytes] = [b""] * len(pieces)
        self.is_byte = np.zeros(len(pieces), bool)
        normal = [(i, p, -s) for i, (p, s, kind) in enumerate(pieces) if kind == "normal"]
        self.fallback = max((c for *_, c in normal), default=0.0) + FALLBACK
        for i, (piece, _, kind) in enumerate(pieces):
            if kind == "byte":
                self.byte_id[int(piece[3:5], 16)] = i
                self.output[i], self.is_byte[i] = bytes([int(piece[3:5], 16)]), True
        for i, piece, cost in normal:
            if SPACE in piece.lstrip(SPACE):
                raise ValueError(f"a piece holds a space behind another character: {piece!r}")
            state = self.start
            for c in piece:
                state = state.setdefault(c, {})
            if "" not in state or cost < state[""][0]:
                state[""] = (cost, i)
            self.ranks[piece] = state[""]
            self.costs[i], self.output[i] = cost, piece.replace(SPACE, " ").encode()
        if len(self.byte_id) != 256:
            raise ValueError("byte fallback needs all 256 byte pieces")
        self.held: dict[str, bytes] = {}

    def shortest(self, segment: str) -> list[int]:
        """Piece numbers of the cheapest path; of equal ones that whose last piece is longest, then the
        last but one, and so on."""
        n, start, fallback = len(segment), self.start, self.fallback
        segment = segment.replace(" ", SPACE)
        best, back = [0.0] + [float("inf")] * n, [(0, -1)] * (n + 1)
        for i in range(n):
            at, state, j, alone = best[i], start, i, True
            while j < n:
                state = state.get(segment[j])
                if state is None:
                    break
                j += 1
                final = state.get("")
                if final is not None:
                    alone = alone and j > i + 1
                    cost = at + final[0]
                    if cost < best[j]:
                        best[j], back[j] = cost, (i, final[1])
            if alone and at + fallback < best[i + 1]:
                best[i + 1], back[i + 1] = at + fallback, (i, -1)
        ids, j = [], n
        while j:
            i, piece = back[j]
            if piece < 0:
                ids += [self.byte_id[b] for b in reversed(segment[i:j].encode())]
            else:
                ids.append(piece)
            j = i
        return ids[::-1]

    def merged(self, segment: str) -> list[int]:
        """Piece numbers after all merges: always the neighbours whose joint piece has the best score, of
        equal ones the leftmost. The work is that of a heap of at most three entries a character."""
        segment, n, ranks = segment.replace(" ", SPACE), len(segment), self.ranks
        end, before = list(range(1, n + 1)), list(range(-1, n))  # of the arc that starts here; 0 where none does
        pairs = [(found[0], i, i + 1, i + 2) for i in range(n - 1) if (found := ranks.get(segment[i:i + 2]))]
        heapq.heapify(pairs)
        while pairs:
            _, i, j, k = heapq.heappop(pairs)
            if end[i] != j or end[j] != k:  # one of the two has been merged since
                continue
            end[i], end[j], before[k] = k, 0, i
            left = before[i]
            if left >= 0 and (found := ranks.get(segment[left:k])):
                heapq.heappush(pairs, (found[0], left, i, k))
            if k < n and (found := ranks.get(segment[i:end[k]])):
                heapq.heappush(pairs, (found[0], i, k, end[k]))
        ids, i = [], 0
        while i < n:
            found = ranks.get(segment[i:end[i]])
            ids += [found[1]] if found else [self.byte_id[b] for b in segment[i].encode()]
            i = end[i]
        return ids

    def _path(self, segment: str) -> bytes:
        ids = np.array(self.path(segment), np.int32).tobytes()
        if len(segment) <= self.longest:
            if len(self.held) >= self.room:
                self.held.clear()
            self.held[segment] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        get, path = self.held.get, self._path
        segments = SEGMENTS.findall(" " + text if self.dummy_prefix else text)
        return np.frombuffer(b"".join([get(s) or path(s) for s in segments]), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.output.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text[:1] == " " else text


def normalised(text: str) -> str:
    """What decoding gives back: U+2581 in a text cannot be told from a space."""
    return text.replace(SPACE, " ")


@lru_cache(maxsize=4)
def load(path: str) -> Transducer:
    """The transducer of a model file with the identity normaliser and byte fallback, on every worker."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    with open(path, "rb") as file:
        stored = sentencepiece_model_pb2.ModelProto.FromString(file.read())
    kinds, spec, rows = type(stored).SentencePiece, stored.trainer_spec, stored.pieces
    if spec.model_type not in (spec.UNIGRAM, spec.BPE):
        raise ValueError("the model is neither a unigram nor a BPE one")
    merges = spec.model_type == spec.BPE
    if merges and any(r.type in (kinds.USER_DEFINED, kinds.UNUSED) for r in rows):
        raise ValueError("user-defined and unused pieces of a BPE model have segmentation rules of their own")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    probe = "  ﬁ  ①"  # any other normaliser would rewrite these
    prefixed = model.normalize(probe) if hasattr(model, "normalize") else SPACE + probe.replace(" ", SPACE)
    plain = probe.replace(" ", SPACE)
    if prefixed not in (plain, SPACE + plain):
        raise ValueError("the model's normaliser is not the identity")

    def kind(i: int) -> str:
        if model.is_byte(i):
            return "byte"
        return "other" if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) else "normal"

    pieces = [(model.id_to_piece(i), model.get_score(i), kind(i)) for i in range(model.get_piece_size())]
    return Transducer(pieces, prefixed == SPACE + plain, merges)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ids array<int> of the model's path.

    Null and empty texts have no pieces; very long texts are encoded whole; repeated rows and equal texts alike;
    ties are settled as in `Transducer.shortest` and `Transducer.merged`; an empty table gives no rows; other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = load(path)
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), _lists([machine.encode(t) for t in batch.column(1).to_pylist()])], names=["id", "ids"])

    return docs.select(F.col(id_col).alias("id"), text.alias("text")).mapInArrow(
        run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*rows, np.zeros(0, np.int32)])))


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per input row: id, text. Null ids give the empty text; bytes that are no UTF-8 become U+FFFD."""
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = load(path)
        for batch in batches:
            ids = [np.array(x or [], np.int32) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([machine.decode(x) for x in ids], pa.string())], names=["id", "text"])

    return encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(
        run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per input row: id, n_pieces, n_byte_pieces, cost, ids_sha256, round_trip and, if asked for, ids.

    Texts are encoded and decoded again in one task; round_trip says that the decoded text is the
    normalised one. Odd rows are treated as in `encode`; ids_sha256 is over little-endian 32-bit numbers.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = load(path)
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            ids = [machine.encode(t) for t in texts]
            columns = [
                batch.column(0), pa.array([len(x) for x in ids], pa.int64()),
                pa.array([int(machine.is_byte[x].sum()) for x in ids], pa.int64()),
                pa.array([float(machine.costs[x].sum()) for x in ids], pa.float64()),
                pa.array([hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in ids], pa.string()),
                pa.array([machine.decode(x) == normalised(t) for x, t in zip(ids, texts, strict=True)], pa.bool_()),
            ]
            names = ["id", "n_pieces", "n_byte_pieces", "cost", "ids_sha256", "round_trip"]
            yield pa.RecordBatch.from_arrays([*columns, _lists(ids)] if with_ids else columns, names=names + ["ids"] * with_ids)

    schema = f"id {kind}, n_pieces long, n_byte_pieces long, cost double, ids_sha256 string, round_trip boolean"
    return docs.select(F.col(id_col).alias("id"), text.alias("text")).mapInArrow(
        run, schema + ", ids array<int>" * with_ids).withColumnRenamed("id", id_col)
