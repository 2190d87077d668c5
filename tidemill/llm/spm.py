"""SentencePiece encoding and decoding in numpy batches.

Texts are cut into units that no piece crosses.  The distinct units of a batch are laid
out by length, and all units of one length advance together: substring hashes probe the
sorted keys of the pieces, and vectorised maxima choose.

Unigram models are encoded by Viterbi: for each end position the best start is stored as a
backpointer.  A model of type BPE defines its result by merges in order of score, which
Viterbi over the same scores doesn't reproduce, so such models take the same layout with
vectorised merges.  See the README for how often the two differ.
"""

from __future__ import annotations

import heapq
import itertools
import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm.common import bound_batches, text_slices

SPACE = "▁"
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Units up to this length merge in lockstep; a longer one has a heap of its own.
_LOCKSTEP = 40
_UNKNOWN_PENALTY = 10.0
#: Units that an encoder remembers before it starts anew.
_REMEMBERED = 200_000


def _hashes(points: np.ndarray) -> np.ndarray:
    """Prefix hashes along the last axis, modulo 2**64."""
    out = np.zeros((*points.shape[:-1], points.shape[-1] + 1), np.uint64)
    for i in range(points.shape[-1]):
        out[..., i + 1] = out[..., i] * _BASE + points[..., i].astype(np.uint64) + np.uint64(1)
    return out


class Vocabulary:
    """Pieces of a model and what encoding needs of them."""

    def __init__(self, pieces: list[tuple[str, float]], kinds: list[str], model: str, unknown: int = 0, dummy_prefix: bool = True):
        """``kinds``: ``normal``, ``byte``, ``control``, ``unknown`` or ``unused`` for each piece; ``model``: ``unigram`` or ``bpe``."""
        self.model, self.unknown, self.dummy_prefix = model, unknown, dummy_prefix
        normal = [(p, s, i) for i, ((p, s), k) in enumerate(zip(pieces, kinds)) if k == "normal"]
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p, _, _ in normal):
            raise ValueError("a piece crosses the start of a word")
        self.longest = max((len(p) for p, _, _ in normal), default=1)
        keys = np.array([_hashes(np.array([ord(c) for c in p], np.uint32))[-1] for p, _, _ in normal], np.uint64)
        order = np.argsort(keys)
        self.keys = keys[order]
        if len(np.unique(keys)) != len(keys):
            raise ValueError("two pieces share a hash")
        self.ids = np.array([i for _, _, i in normal], np.int32)[order]
        self.lengths = np.array([len(p) for p, _, _ in normal], np.int32)[order]
        self.scores = np.array([s for _, s, _ in normal], np.float64)[order]
        self.by_text = {p: (s, i) for p, s, i in normal}
        self.worst = float(self.scores.min(initial=0.0)) - _UNKNOWN_PENALTY
        self.bytes = np.full(256, -1, np.int32)
        self.surface: list[bytes] = []
        for i, ((p, _), k) in enumerate(zip(pieces, kinds)):
            if k == "byte":
                self.bytes[int(p[3:5], 16)] = i
            self.surface.append(bytes([int(p[3:5], 16)]) if k == "byte" else p.encode() if k == "normal" else " ⁇ ".encode() if k == "unknown" else b"")
        self.inner = "".join(sorted({c for p, _, _ in normal if len(p) > 1 for c in p} - {SPACE}))

    @staticmethod
    def load(path: str) -> Vocabulary:
        """Read a SentencePiece model file."""
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as pb

        spec = pb.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        if spec.normalizer_spec.precompiled_charsmap or spec.normalizer_spec.remove_extra_whitespaces or spec.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models whose normaliser keeps texts as they are")
        model = {pb.TrainerSpec.UNIGRAM: "unigram", pb.TrainerSpec.BPE: "bpe"}[spec.trainer_spec.model_type]
        read = SentencePieceProcessor(model_file=path)
        tests = (("byte", read.is_byte), ("control", read.is_control), ("unknown", read.is_unknown), ("unused", read.is_unused))
        n = read.vocab_size()
        kinds = [next((k for k, f in tests if f(i)), "normal") for i in range(n)]
        if "unused" in kinds or any(p.type == pb.ModelProto.SentencePiece.USER_DEFINED for p in spec.pieces):
            raise ValueError("unused and user-defined pieces aren't supported")
        return Vocabulary([(read.id_to_piece(i), read.get_score(i)) for i in range(n)], kinds, model, read.unk_id(), spec.normalizer_spec.add_dummy_prefix)


@lru_cache(maxsize=4)
def _unit_pattern(inner: str) -> re.Pattern:
    inside = "".join(map(re.escape, inner))
    # characters that no longer piece holds stand alone
    return re.compile(f"{SPACE}*[{inside}]+|{SPACE}+|[^{inside}{SPACE}]" if inside else f"{SPACE}+|[^{SPACE}]", re.S)


class Encoder:
    """Encodes batches of texts."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.pattern = _unit_pattern(vocabulary.inner)
        self._forget()

    def _forget(self) -> None:
        """Start with no units known."""
        self.seen: dict[str, int] = {}
        self.ids, self.counts = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def _probe(self, hashes: np.ndarray, lengths) -> np.ndarray:
        """Row of each substring among the sorted pieces, or -1."""
        keys = self.v.keys
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        return np.where((keys[at] == hashes) & (self.v.lengths[at] == lengths), at, -1)

    def _points(self, units: list[str]) -> np.ndarray:
        return np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(units), -1)

    def _powers(self, n: int) -> np.ndarray:
        out = np.full(n + 1, _BASE, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    def _viterbi(self, units: list[str]) -> np.ndarray:
        """Starts of pieces (boolean) for units of one length."""
        n = len(units[0])
        sums, powers = _hashes(self._points(units)), self._powers(n)
        best = np.full((len(units), n + 1), -np.inf)
        best[:, 0] = 0
        back = np.zeros((len(units), n + 1), np.int32)
        for end in range(1, n + 1):
            for start in range(end - 1, max(-1, end - self.v.longest - 1), -1):
                at = self._probe(sums[:, end] - sums[:, start] * powers[end - start], end - start)
                score = np.where(at >= 0, self.v.scores[at], self.v.worst if start == end - 1 else -np.inf) + best[:, start]
                better = score > best[:, end]
                best[better, end] = score[better]
                back[better, end] = start
        cuts = np.zeros((len(units), n), bool)
        at = np.full(len(units), n)
        rows = np.arange(len(units))
        while (live := at > 0).any():
            at = np.where(live, back[rows, at], 0)
            cuts[rows[live], at[live]] = True
        return cuts

    def _merge(self, units: list[str]) -> np.ndarray:
        """Starts of pieces after merges in order of score, for units of one length."""
        n = len(units[0])
        sums, powers = _hashes(self._points(units)), self._powers(n)
        cuts = np.ones((len(units), n), bool)
        score = np.full((len(units), n), -np.inf)  # of joining the symbol that starts here with the next

        following = np.tile(np.arange(1, n + 1), (len(units), 1))  # where the symbol that starts here ends
        before = np.tile(np.arange(-1, n - 1), (len(units), 1))
        for i in range(n - 1):
            at = self._probe(sums[:, i + 2] - sums[:, i] * powers[2], 2)
            score[:, i] = np.where(at >= 0, self.v.scores[at], -np.inf)
        live = np.arange(len(units))
        while len(live):
            i = score[live].argmax(axis=1)
            go = score[live, i] > -np.inf
            live, i = live[go], i[go]
            if not len(live):
                break
            j = following[live, i]
            end = following[live, j]
            cuts[live, j] = False
            score[live, j] = -np.inf
            following[live, i] = end
            inside = end < n
            before[live[inside], end[inside]] = i[inside]
            for left, ok in ((i, inside), (before[live, i], before[live, i] >= 0)):
                rows, a = live[ok], left[ok]
                if len(rows):
                    b = following[rows, following[rows, a]]
                    at = self._probe(sums[rows, b] - sums[rows, a] * powers[b - a], b - a)
                    score[rows, a] = np.where(at >= 0, self.v.scores[at], -np.inf)
            score[live[~inside], i[~inside]] = -np.inf
        return cuts

    def _merge_long(self, unit: str) -> np.ndarray:
        """As :meth:`_merge`, for one unit of any length, in O(n log n)."""
        n, known = len(unit), self.v.by_text
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        cuts, heap = np.ones(n, bool), []

        def offer(a):
            if a >= 0 and end[a] < n:
                b = end[end[a]]
                if b - a <= self.v.longest and (hit := known.get(unit[a:b])):
                    heapq.heappush(heap, (-hit[0], a, end[a], b))

        for a in range(n - 1):
            offer(a)
        while heap:
            _, a, mid, b = heapq.heappop(heap)
            if cuts[a] and end[a] == mid and mid < n and cuts[mid] and end[mid] == b:
                cuts[mid] = False
                end[a] = b
                if b < n:
                    before[b] = a
                offer(a)
                offer(before[a])
        return cuts

    def _raw(self, c: str) -> list[int]:
        ids = [int(self.v.bytes[b]) for b in c.encode("utf-8", "surrogatepass")]
        return ids if min(ids) >= 0 else [self.v.unknown]

    def _units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct units, one after another, and the number of ids of each."""
        by_length: dict[int, list[int]] = {}
        for k, u in enumerate(units):
            by_length.setdefault(len(u), []).append(k)
        owner, ids = [], []
        for n, members in by_length.items():
            for first in range(0, len(members), max(1, (1 << 20) // n)):
                part = members[first : first + max(1, (1 << 20) // n)]
                texts = [units[k] for k in part]
                if self.v.model == "unigram":
                    cuts = self._viterbi(texts)
                elif n <= _LOCKSTEP:
                    cuts = self._merge(texts)
                else:
                    cuts = np.array([self._merge_long(t) for t in texts])
                row, start = np.nonzero(cuts)
                stop = np.append(start[1:], n)
                stop[np.append(row[1:] != row[:-1], True)] = n
                sums, powers = _hashes(self._points(texts)), self._powers(n)
                at = self._probe(sums[row, stop] - sums[row, start] * powers[stop - start], stop - start)
                found = np.where(at >= 0, self.v.ids[at], -1)
                sizes = np.ones(len(row), np.int64)
                misses = np.flatnonzero(found < 0)  # characters that no piece has become their bytes
                raws = [self._raw(texts[row[k]][start[k]]) for k in misses]
                sizes[misses] = [len(r) for r in raws]
                found = np.repeat(found, sizes)
                found[found < 0] = [i for r in raws for i in r]
                owner.append(np.repeat(np.array(part)[row], sizes))
                ids.append(found)
        if not units:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        owner, ids = np.concatenate(owner), np.concatenate(ids)
        order = np.argsort(owner, kind="stable")
        return ids[order].astype(np.int32), np.bincount(owner, minlength=len(units))

    def encode(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """Ids of each text; null stays null and the empty text has none."""
        if len(self.seen) > _REMEMBERED:
            self._forget()
        seen, rows = self.seen, []
        for t in texts:
            if not t:
                rows.append(None if t is None else [])
                continue
            t = t.replace(" ", SPACE)
            rows.append([seen.setdefault(u, len(seen)) for u in self.pattern.findall(SPACE + t if self.v.dummy_prefix else t)])
        ids, counts = self._units(list(itertools.islice(seen, len(self.counts), None)))
        self.ids, self.counts = np.concatenate([self.ids, ids]), np.concatenate([self.counts, counts])
        ids, counts = self.ids, self.counts
        starts = np.cumsum(counts) - counts
        out = []
        for row in rows:
            if row is None:
                out.append(None)
                continue
            row = np.array(row, np.int64)
            n = counts[row]
            shift = np.repeat(starts[row] - (np.cumsum(n) - n), n)
            out.append(ids[np.arange(int(n.sum())) + shift])
        return out

    def decode(self, rows) -> list[str | None]:
        """Texts of id sequences; bytes that aren't UTF-8 become U+FFFD."""
        pieces, space = self.v.surface, SPACE.encode()
        out = []
        for row in rows:
            if row is None:
                out.append(None)
                continue
            raw = b"".join([pieces[i] for i in row]).replace(space, b" ")
            out.append(raw[1 if self.v.dummy_prefix and raw[:1] == b" " else 0 :].decode("utf-8", "replace"))
        return out


_ENCODERS: dict[int, Encoder] = {}


def _encoder(shared) -> Encoder:
    """One encoder for each broadcast vocabulary and worker."""
    if id(shared.value) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[id(shared.value)] = Encoder(shared.value)
    return _ENCODERS[id(shared.value)]


def share(spark: SparkSession, vocabulary: Vocabulary):
    """The vocabulary for :func:`decode` on executors; its size is that of the model file."""
    return spark.sparkContext.broadcast(vocabulary)


def decode(ids: Column, shared) -> Column:
    """Texts of a column of piece ids.  Null gives null, an empty array the empty text."""

    @F.pandas_udf("string")
    def run(rows: pd.Series) -> pd.Series:
        return pd.Series(_encoder(shared).decode(rows), dtype=object)

    return run(ids)


def encode_documents(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", ids_col: str = "ids", check_col: str | None = None) -> DataFrame:
    """``docs`` with one more column of piece ids, array<int>.

    Every row and whole text is encoded: null gives null, the empty text an empty array, and
    repeated rows stay.  ``check_col`` names a further column that says whether decoding
    gives the text back; it is found in the worker that encoded, so that ids don't travel
    twice.  A text with the character U+2581 can't come back as it was; its check compares
    with spaces instead.  Columns of ``docs`` with these names are replaced.
    """
    bound_batches(docs.sparkSession)
    shared = share(docs.sparkSession, vocabulary)
    docs = docs.drop(ids_col, *([check_col] if check_col else []))
    schema = T.StructType([*docs.schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType()))])
    if check_col:
        schema.add(check_col, T.BooleanType())

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for part in text_slices(whole, text_col, 1 << 20):
                texts = part.column(part.schema.get_field_index(text_col)).to_pylist()
                work = _encoder(shared)
                ids = work.encode(texts)
                columns, names = [*part.columns, pa.array(ids, pa.list_(pa.int32()))], [*part.schema.names, ids_col]
                if check_col:
                    same = [x == (None if t is None else t.replace(SPACE, " ")) for x, t in zip(work.decode(ids), texts)]
                    columns.append(pa.array(same, pa.bool_()))
                    names.append(check_col)
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, schema)
