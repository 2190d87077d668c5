"""Removal of long byte strings that an earlier document has, by suffix arrays of anchored contexts.

Every window of ``WINDOW`` bytes has an anchor: its ``GRAM``-byte gram of least hash, leftmost
among ties.  Equal windows have equal anchors, so only grams that occur in several documents
matter, and a gram's occurrences with the bytes around them hold every window that the gram
anchors.  The steps:

1. Documents go to a table bucketed by id, once; later joins with it don't shuffle texts.
2. Later copies of a whole text are set aside: all their windows occur earlier.
3. Anchors are counted by hash range, in packed sorted arrays; grams of two or more
   documents are sent back to their documents.
4. Contexts of shared anchors meet by gram.  Equal contexts are one; an enhanced suffix
   array over the different ones of a gram is scanned with a stack for its
   common-prefix intervals of ``WINDOW`` bytes or more, and intervals whose occurrences have
   different bytes before them (or an edge) are the maximal repeat groups, with all
   occurrences.
5. The few grams with very many occurrences (at most ``HOT_GRAMS`` by the threshold's
   definition) don't meet in one task: each of their windows is a context of its own, with
   the window's hash for its gram, and equal windows are combined within their batch first.
   Hashes only bring windows together; everywhere bytes decide.
6. Covered ranges go back to the documents by id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import bound_batches, bucketed, by_key, in_slices, later_copies, materialize, pack, ragged, text_bytes, unpack

WINDOW = 50
GRAM = 24
#: Bytes of text for one bucket or range of grams.
PART_BYTES = 8 << 20
#: A gram is hot beyond this many occurrences, or beyond all occurrences / HOT_GRAMS if that is more.
HOT_LEAST = 1024
HOT_GRAMS = 1_000_000
_POSITION_BITS = np.uint64(22)
_POSITIONS = np.uint64((1 << 22) - 1)
_PIECE = 1 << 20
_CHUNK = 1 << 17
_FLUSH_BYTES = 8 << 20
_SOME_CONTEXTS = 8192
_STEP = 1 << 20  # a range of bytes packs as start * _STEP + length

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_VALUES = _mixed(np.arange(1, 257, dtype=np.uint64) * _MULTIPLIER) | np.uint64(1)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_MULTIPLIER), n, 1 << 64))


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of the ``size`` bytes from each position on, by doubling."""
    if len(data) < size:
        return np.zeros(0, np.uint64)
    width, at = 1, _BYTE_VALUES[data.astype(np.intp)]
    done, out = 0, None
    while True:
        if size & width:
            if out is None:
                out, done = at, width
            else:
                n = len(at) - done
                out = out[:n] * _power(width) + at[done : done + n]
                done += width
        if done == size:
            return _mixed(out[: len(data) - size + 1])
        at = at[: len(at) - width] * _power(width) + at[width:]
        width *= 2


def _sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    width = 1
    while width * 2 <= size:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    if width < size:
        x = np.minimum(x[: len(x) - (size - width)], x[size - width :])
    return x


def anchors(texts: list[bytes], window: int = WINDOW, gram: int = GRAM):
    """For chunks of documents: (bytes, document of each anchor, hash, first window, last window, offset).

    Windows are positions in the chunk; adding ``offset`` gives positions in the document.
    """
    pieces = [(d, a) for d, t in enumerate(texts) for a in range(0, max(len(t) - window + 1, 0), _PIECE)]
    chunk, size = [], 0
    for k, (d, a) in enumerate(pieces):
        chunk.append((d, a, texts[d][a : a + _PIECE + window - 1]))
        size += len(chunk[-1][2])
        if size >= _CHUNK or k == len(pieces) - 1:
            data = np.frombuffer(b"".join(p for _, _, p in chunk), np.uint8)
            lens = np.array([len(p) for _, _, p in chunk])
            ends = np.cumsum(lens)
            starts = ends - lens
            hashes = gram_hashes(data, gram)
            ranked = (hashes & ~_POSITIONS) | np.arange(len(hashes), dtype=np.uint64)
            least = (_sliding_min(ranked, window - gram + 1) & _POSITIONS).astype(np.int64)
            ok = np.ones(len(least), bool)
            for e in ends[:-1]:
                ok[max(e - window + 1, 0) : e] = False
            windows = np.flatnonzero(ok)
            at = least[windows]
            new = np.ones(len(at), bool)
            new[1:] = (at[1:] != at[:-1]) | (windows[1:] != windows[:-1] + 1)
            first = windows[new]
            last = windows[np.append(np.flatnonzero(new)[1:] - 1, len(windows) - 1)] if len(windows) else first
            owner = np.searchsorted(ends, first, side="right")
            shift = np.array([a for _, a, _ in chunk]) - starts
            # least hashes are small numbers; mixed again they are spread over all ranges
            yield data, np.array([d for d, _, _ in chunk])[owner], _mixed(hashes[at[new]]), first, last, shift[owner]
            chunk, size = [], 0


# ---- enhanced suffix array ------------------------------------------------------------------


def lcp_intervals(lcp: list[int], least: int) -> list[tuple[int, int, int]]:
    """(left, right, length) of all intervals of a suffix array with common prefixes of ``least`` or more.

    ``lcp[i]`` is the common prefix of suffixes i - 1 and i.  One scan with a stack; an
    interval comes after those inside it.
    """
    out, stack = [], []
    n = len(lcp)
    for i in range(1, n + 1):
        here = lcp[i] if i < n else 0
        left = i - 1
        while stack and stack[-1][0] > here:
            length, left = stack.pop()
            out.append((left, i - 1, length))
        if here >= least and (not stack or stack[-1][0] < here):
            stack.append((here, left))
    return out


def repeat_groups(data: bytes, starts: np.ndarray, stops: np.ndarray, left: np.ndarray, key: np.ndarray, least: int):
    """Maximal repeats among the suffixes ``data[start:stop]`` that share a ``key``.

    ``left`` is the byte before each suffix, or -1 - i at an edge, which differs from all
    others.  Gives (order, groups): ``order`` sorts the suffixes, ``groups`` holds arrays of
    first, last (in that order) and length.  All occurrences of a repeat lie between first
    and last; repeats whose occurrences all have the same byte before them are left out,
    as the repeat one byte longer has the same occurrences.
    """
    n = len(starts)
    if n < 2:
        return np.arange(n), tuple(np.zeros(0, np.int64) for _ in range(3))
    width = -(-int((stops - starts).max()) // 8) * 8
    source = np.frombuffer(data + bytes(width), np.uint8)
    table = source[starts[:, None] + np.arange(width)]
    table[np.arange(width) >= (stops - starts)[:, None]] = 0
    words = table.view(">u8")
    order = np.lexsort([*(words[:, k] for k in range(words.shape[1] - 1, -1, -1)), key])
    near = table[order]
    differ = near[1:] != near[:-1]
    common = np.where(differ.any(1), differ.argmax(1), width)
    sizes = (stops - starts)[order]
    common = np.minimum(common, np.minimum(sizes[1:], sizes[:-1]))
    common[key[order][1:] != key[order][:-1]] = 0
    found = np.array(lcp_intervals([0, *common.tolist()], least), np.int64).reshape(-1, 3)
    change = np.concatenate([[0], np.cumsum(left[order][1:] != left[order][:-1])])
    diverse = change[found[:, 1]] > change[found[:, 0]]
    return order, (found[diverse, 0], found[diverse, 1], found[diverse, 2])


def _covered(kmer, contexts: list[bytes], first_doc: np.ndarray, window: int):
    """Ranges (context, start, length) that a document before ``first_doc`` of the context has, for contexts sorted by ``kmer``."""
    lens = np.array([len(c) for c in contexts])
    data = b"".join(contexts)
    base = np.cumsum(lens) - lens
    count = lens - window + 1
    ctx = np.repeat(np.arange(len(contexts)), count)
    offset = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    start = base[ctx] + offset
    key = kmer[ctx]
    # windows that only one context has begin no repeat
    seen = gram_hashes(np.frombuffer(data, np.uint8), window)[start] ^ key
    value = np.argsort(seen, kind="stable")
    same = seen[value][1:] == seen[value][:-1]
    keep = np.zeros(len(seen), bool)
    keep[value[1:][same]] = True
    keep[value[:-1][same]] = True
    keep = np.flatnonzero(keep)
    ctx, offset, start, key = ctx[keep], offset[keep], start[keep], key[keep]
    raw = np.frombuffer(data, np.uint8)
    left = np.where(offset > 0, raw[np.maximum(start - 1, 0)].astype(np.int64), -1 - np.arange(len(start)))
    order, (low, high, length) = repeat_groups(data, start, base[ctx] + lens[ctx], left, key, window)
    if not len(low):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = high - low + 1
    head = np.cumsum(size) - size
    row = order[np.arange(int(size.sum())) + np.repeat(low - head, size)]  # every occurrence of every group
    least = np.repeat(np.minimum.reduceat(first_doc[ctx[row]], head), size)
    hit = first_doc[ctx[row]] > least
    row, length = row[hit], np.repeat(length, size)[hit]
    return ctx[row], offset[row], length


# ---- batches ------------------------------------------------------------------------------------


def _flushes(batches, most_bytes: int, extra: str | None = None):
    """(ids, texts, extras) of about ``most_bytes`` of text each."""
    ids, texts, more, size = [], [], [], 0
    for pdf in batches:
        for i, t, x in zip(pdf["_id"], pdf["_text"], pdf[extra] if extra else pdf["_id"]):
            raw = t.encode("utf-8", "surrogatepass")
            if len(raw) < WINDOW:
                continue
            ids.append(i)
            texts.append(raw)
            more.append(x)
            size += len(raw)
            if size >= most_bytes:
                yield np.array(ids, np.int64), texts, more
                ids, texts, more, size = [], [], [], 0
    if ids:
        yield np.array(ids, np.int64), texts, more


def _flush_bytes(parts: int) -> int:
    """Text that a task gathers before it sends a row to each range; more for more ranges, so that rows don't get small."""
    return min(max(_FLUSH_BYTES, parts << 12), 8 * _FLUSH_BYTES)


def _frames(rows):
    """Frames of some MB for (part, payload) rows."""
    parts, payloads, size = [], [], 0
    for part, payload in rows:
        parts.append(part)
        payloads.append(payload)
        size += len(payload)
        if size >= _PIECE:
            yield pd.DataFrame({"part": parts, "payload": payloads})
            parts, payloads, size = [], [], 0
    if parts:
        yield pd.DataFrame({"part": parts, "payload": payloads})


def _repeated(raw: np.ndarray, at: np.ndarray, key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, later): windows sorted by ``key`` and ``doc``, and whether a smaller ``doc`` has the same bytes under the same key.

    Different windows under one key may hide such a document, but never make one up.
    """
    order = np.lexsort((doc, key))
    key, doc, at = key[order], doc[order], at[order]
    same = np.append(False, key[1:] == key[:-1])
    table = np.lib.stride_tricks.sliding_window_view(raw, WINDOW)
    near = np.flatnonzero(same)
    for a in range(0, len(near), _CHUNK):
        some = near[a : a + _CHUNK]
        same[some] = (table[at[some]] == table[at[some - 1]]).all(1)
    return order, doc > doc[np.maximum.accumulate(np.where(same, 0, np.arange(len(at))))]


# ---- the steps as Spark jobs --------------------------------------------------------------------


def _shared_grams(docs: DataFrame, parts: int) -> DataFrame:
    """(kind, doc, gram, n): grams that several documents have, for each of these; kind 1 rows count a hot gram."""

    most_bytes = _flush_bytes(parts)

    def count(batches):
        for ids, texts, _ in _flushes(batches, most_bytes):
            found = [(g, d) for _, d, g, _, _, _ in anchors(texts)]
            if not found:
                continue
            grams, owner = np.concatenate([g for g, _ in found]), np.concatenate([d for _, d in found]).astype(np.uint32)
            order = np.argsort(grams, kind="stable")
            grams, owner = grams[order], owner[order]
            new = np.ones(len(grams), bool)
            new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
            grams, owner = grams[new], owner[new]
            head = np.flatnonzero(np.append(True, grams[1:] != grams[:-1]))
            n = np.diff(np.append(head, len(grams)))
            alone = np.zeros(len(grams), bool)
            alone[head[n == 1]] = True
            edges = np.searchsorted(grams, (np.arange(parts + 1, dtype=np.float64) * (2.0**64 / parts)).clip(0, 2.0**64 - 2048).astype(np.uint64))
            edges[-1] = len(grams)
            several = np.flatnonzero(n > 1)
            cuts = np.searchsorted(head[several], edges)
            turn = int(ids[0]) % parts
            none = np.zeros(0, np.uint64)

            def rows():
                for p in range(parts):
                    a, b = edges[p], edges[p + 1]
                    if a == b:
                        continue
                    one = alone[a:b]
                    groups = several[cuts[p] : cuts[p + 1]]
                    used, at = np.unique(owner[a:b][one], return_inverse=True)
                    yield p, pack(grams[a:b][one], at.astype(np.uint32), ids[used], grams[head[groups]], n[groups].astype(np.uint32), none, none.astype(np.int64))
                    if not one.all():  # known to be shared: these documents need no answer from other tasks
                        yield (p + turn) % parts, pack(none, none.astype(np.uint32), none.astype(np.int64), none, none.astype(np.uint32), grams[a:b][~one], ids[owner[a:b][~one]])

            yield from _frames(rows())

    def answer(batches):
        for _, payloads in by_key(batches, "part"):
            rows = [unpack(p) for p in payloads]
            grams = np.concatenate([r[0] for r in rows] + [r[3] for r in rows])
            counts = np.concatenate([np.ones(sum(len(r[0]) for r in rows), np.int64)] + [r[4].astype(np.int64) for r in rows])
            order = np.argsort(grams, kind="stable")
            head = np.flatnonzero(np.append(True, grams[order][1:] != grams[order][:-1])) if len(grams) else np.zeros(0, np.int64)
            distinct, total = grams[order][head], np.add.reduceat(counts[order], head) if len(head) else head
            shared = distinct[total > 1]
            doc, gram = [], []
            for r in rows:
                if len(shared) and len(r[0]):
                    hit = shared[np.minimum(np.searchsorted(shared, r[0]), len(shared) - 1)] == r[0]
                    doc.append(r[2][r[1][hit]])
                    gram.append(r[0][hit])
                doc.append(r[6])
                gram.append(r[5])
            del rows
            yield pd.DataFrame({"kind": 0, "doc": np.concatenate(doc), "gram": np.concatenate(gram).astype(np.int64), "n": 1})
            hot = total > HOT_LEAST
            yield pd.DataFrame({"kind": 1, "doc": 0, "gram": distinct[hot].astype(np.int64), "n": total[hot]})

    schema = "part int, payload binary"
    packed = docs.mapInArrow(in_slices(count, schema, "_text"), schema)
    spread = packed.repartition(parts, "part").sortWithinPartitions("part")
    return materialize(spread.mapInPandas(answer, "kind int, doc long, gram long, n long"), "shared-grams")


def _merged(doc: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(doc, code) of ranges, those of a document that touch made one, in pieces that a code can hold."""
    order = np.lexsort((start, doc))
    doc, start, size = doc[order], start[order], size[order]
    if not len(doc):
        return doc, start
    group = np.cumsum(np.append(0, doc[1:] != doc[:-1]))
    far = np.int64(1) << 42  # beyond any position, so that groups stay apart
    reach = np.maximum.accumulate(start + size + group * far)
    new = np.append(True, (start + group * far)[1:] > reach[:-1])
    new |= np.append(False, (start[1:] >> 18) != (start[:-1] >> 18))
    heads = np.flatnonzero(new)
    stop = np.maximum.reduceat(start + size, heads)
    return doc[heads], start[heads] * _STEP + stop - start[heads]


def _contexts(docs: DataFrame, parts: int, hot: np.ndarray) -> DataFrame:
    """Packed rows by range of the gram: contexts of shared anchors, windows of hot grams as contexts of their own, and known ranges.

    What an earlier document of the same batch has is known to go and travels as merged
    ranges; only the first document of a context or window needs to meet other batches.
    """
    shared = docs.sparkSession.sparkContext.broadcast(np.sort(hot))

    most_bytes = _flush_bytes(parts)

    def collect(batches):
        busy = shared.value
        for ids, texts, wanted in _flushes(batches, most_bytes, "_grams"):
            wanted = [np.sort(np.asarray(w, np.int64).view(np.uint64)) for w in wanted]
            contexts: dict[tuple[int, bytes], int] = {}
            where, doc, at, heat = [], [], [], []
            for data, owner, grams, first, last, shift in anchors(texts):
                keep = np.zeros(len(grams), bool)
                cuts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else []
                for a, b in zip(cuts, [*cuts[1:], len(owner)]):
                    w = wanted[owner[a]]
                    keep[a:b] = w[np.minimum(np.searchsorted(w, grams[a:b]), len(w) - 1)] == grams[a:b]
                if len(busy):
                    heated = keep & (busy[np.minimum(np.searchsorted(busy, grams), len(busy) - 1)] == grams)
                    if heated.any():
                        size = last[heated] - first[heated] + 1
                        start = ragged(first[heated], size)
                        heat.append((gram_hashes(data, WINDOW)[start], np.repeat(owner[heated], size), start + np.repeat(shift[heated], size)))
                        keep &= ~heated
                raw = data.tobytes()
                for k in np.flatnonzero(keep).tolist():
                    where.append(contexts.setdefault((int(grams[k]), raw[first[k] : last[k] + WINDOW]), len(contexts)))
                doc.append(ids[owner[keep]])
                at.append(first[keep] + shift[keep])
            known_doc, known_at, known_size = [], [], []
            if heat:
                key, owner, start = (np.concatenate(x) for x in zip(*heat))
                heat, raw = [], b"".join(texts)
                base = np.cumsum([0, *map(len, texts)])[owner] + start
                order, later = _repeated(np.frombuffer(raw, np.uint8), base, key, ids[owner])
                gone, order = order[later], order[~later]
                known_doc.append(ids[owner[gone]])
                known_at.append(start[gone])
                known_size.append(np.full(len(gone), WINDOW))
                for k, b in zip(key[order].tolist(), base[order].tolist()):
                    where.append(contexts.setdefault((k, raw[b : b + WINDOW]), len(contexts)))
                doc.append(ids[owner[order]])
                at.append(start[order])
            none = np.zeros(0, np.int64)
            doc, at, where = (np.concatenate(x) if x else none for x in (doc, at, [np.array(where, np.int64)]))
            grams = np.array([g for g, _ in contexts], np.uint64)
            bodies = [c for _, c in contexts]
            sizes = np.array([len(c) for c in bodies], np.int64)
            least = np.full(len(bodies), np.iinfo(np.int64).max)
            np.minimum.at(least, where, doc)
            later = doc > least[where]
            known_doc.append(doc[later])
            known_at.append(at[later])
            known_size.append(sizes[where[later]])
            doc, at, where = doc[~later], at[~later], where[~later]
            known_doc, known_code = _merged(*(np.concatenate(x) for x in (known_doc, known_at, known_size)))
            part = (grams >> np.uint64(32)).astype(np.int64) * parts >> 32
            order = np.argsort(part, kind="stable")
            edges = np.searchsorted(part[order], np.arange(parts + 1))
            by_part = np.argsort(part[where], kind="stable")
            cuts = np.searchsorted(part[where][by_part], np.arange(parts + 1))
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))

            def rows():
                for p in range(parts):
                    mine, uses = order[edges[p] : edges[p + 1]], by_part[cuts[p] : cuts[p + 1]]
                    told = slice(None) if p == int(ids[0]) % parts else slice(0)
                    body = np.frombuffer(b"".join([bodies[k] for k in mine]), np.uint8)
                    arrays = (grams[mine], sizes[mine].astype(np.uint8), body, (place[where[uses]] - edges[p]).astype(np.uint32), doc[uses], at[uses], known_doc[told], known_code[told])
                    if any(map(len, arrays)):
                        yield p, pack(*arrays)

            yield from _frames(rows())

    schema = "part int, payload binary"
    return docs.mapInArrow(in_slices(collect, schema, "_text"), schema)


def _cover_contexts(packed: DataFrame, parts: int) -> DataFrame:
    """(doc, code): ranges that an earlier document has, as start * 128 + length."""

    def cover(batches):
        for _, payloads in by_key(batches, "part"):
            contexts: dict[tuple[int, bytes], int] = {}
            use, docs, starts = [], [], []
            for p in payloads:
                grams, lens, body, which, doc, at, known_doc, known_code = unpack(p)
                if len(known_doc):
                    yield pd.DataFrame({"doc": known_doc, "code": known_code})
                body, ends = body.tobytes(), np.cumsum(lens.astype(np.int64)).tolist()
                place = np.array([contexts.setdefault((g, body[e - n : e]), len(contexts)) for g, e, n in zip(grams.tolist(), ends, lens.tolist())], np.int64)
                use.append(place[which])
                docs.append(doc)
                starts.append(at)
            use, docs, starts = np.concatenate(use), np.concatenate(docs), np.concatenate(starts)
            grams = np.array([g for g, _ in contexts], np.uint64)
            bodies = [c for _, c in contexts]
            lens = np.array([len(b) for b in bodies])
            first = np.full(len(bodies), np.iinfo(np.int64).max)
            np.minimum.at(first, use, docs)
            later = docs > first[use]
            yield pd.DataFrame({"doc": docs[later], "code": starts[later] * _STEP + lens[use[later]]})
            # the first document with a context may still share a part of it with an earlier one
            order = np.argsort(grams, kind="stable")
            _, size = np.unique(grams[order], return_counts=True)
            mixed = order[np.repeat(size > 1, size)]
            if not len(mixed):
                continue
            early = np.flatnonzero(~later)
            early = early[np.argsort(use[early], kind="stable")]
            cuts = np.flatnonzero(np.append(True, grams[mixed][1:] != grams[mixed][:-1]))
            cuts = [*cuts[np.append(True, np.diff(cuts // _SOME_CONTEXTS) > 0)], len(mixed)]
            for a, b in zip(cuts, cuts[1:]):  # whole grams, some thousand contexts at a time
                some = mixed[a:b]
                ctx, offset, length = _covered(grams[some], [bodies[k] for k in some], first[some], WINDOW)
                ctx = some[ctx]
                low, high = np.searchsorted(use[early], ctx), np.searchsorted(use[early], ctx, side="right")
                pick = early[ragged(low, high - low)]
                again = high - low
                out = pd.DataFrame({"doc": docs[pick], "code": (starts[pick] + np.repeat(offset, again)) * _STEP + np.repeat(length, again)})
                yield out.drop_duplicates()

    return packed.repartition(parts, "part").sortWithinPartitions("part").mapInPandas(cover, "doc long, code long")


def merged_ranges(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint (starts, stops) that packed ranges cover; ranges that touch are one."""
    codes = np.unique(codes)
    starts, stops = codes // _STEP, codes // _STEP + codes % _STEP
    reach = np.maximum.accumulate(stops)
    new = np.append(True, starts[1:] > reach[:-1])
    heads = np.flatnonzero(new)
    return starts[heads], reach[np.append(heads[1:] - 1, len(codes) - 1)]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """One row per input row: the id, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept``, the bytes that remain.

    A byte goes if it lies in a string of 50 bytes that also starts in a document with a
    smaller id; strings are judged on the input.  Texts are UTF-8 bytes, null is empty.
    Ids are integers and identify texts; rows that repeat an id share its result, and rows
    without an id neither lose nor remove anything.  Other columns are not read.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    source = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    size = source.agg(text_bytes("_text")).first()[0] or 0
    parts = partitions or int(min(max(size // PART_BYTES, 4), 1 << 16))
    buckets = max(parts // 5, 4)  # a table's buckets can be larger than what one task holds in arrays
    table = bucketed(source.withColumn("_digest", F.unhex(F.sha2("_text", 256))), buckets, "_id")
    copies = later_copies(table, ["_digest"])
    texts = table.where("_id is not null").select("_id", "_text").join(copies.hint("shuffle_hash"), "_id", "left_anti")
    few = max(2 * parts, spark.sparkContext.defaultParallelism)  # buckets have many small files
    answers = _shared_grams(texts.coalesce(few), parts)
    total = answers.where("kind = 0").count()
    hot = [r["gram"] for r in answers.where((F.col("kind") == 1) & (F.col("n") > max(HOT_LEAST, total // HOT_GRAMS))).select("gram").collect()]
    wanted = answers.where("kind = 0").groupBy(F.col("doc").alias("_id")).agg(F.collect_list("gram").alias("_grams"))
    asked = texts.join(wanted.hint("shuffle_hash"), "_id")  # no sort of texts
    codes = materialize(_cover_contexts(_contexts(asked, parts, np.array(hot, np.int64).view(np.uint64)), parts), "covered")
    ranges = codes.groupBy(F.col("doc").alias("_id")).agg(F.collect_list("code").alias("_codes"))

    @F.pandas_udf("kept binary, n_removed long, n_spans long")
    def cut(texts: pd.Series, codes: pd.Series) -> pd.DataFrame:
        rows = []
        for t, c in zip(texts, codes):
            if c is None:
                rows.append((None, 0, 0))
                continue
            raw = t.encode("utf-8", "surrogatepass")
            starts, stops = merged_ranges(np.asarray(c, np.int64))
            edges = [0, *(x for pair in zip(starts.tolist(), stops.tolist()) for x in pair), len(raw)]
            rows.append((b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])), int((stops - starts).sum()), len(starts)))
        return pd.DataFrame(rows, columns=["kept", "n_removed", "n_spans"])

    n_bytes = F.octet_length("_text").cast("long")
    copied = F.col("_copied").isNotNull() & (n_bytes >= WINDOW)
    joined = table.join(copies.withColumn("_copied", F.lit(True)), "_id", "left").join(ranges.hint("shuffle_hash"), "_id", "left")
    joined = joined.withColumn("_cut", cut(F.when(F.col("_codes").isNotNull(), F.col("_text")), F.col("_codes")))
    return joined.select(
        F.col("_id").alias(id_col),
        n_bytes.alias("n_bytes"),
        F.when(copied, n_bytes).otherwise(F.col("_cut.n_removed")).alias("n_removed"),
        F.when(copied, F.lit(1).cast("long")).otherwise(F.col("_cut.n_spans")).alias("n_spans"),
        F.when(copied, F.lit(b"")).otherwise(F.coalesce("_cut.kept", F.encode("_text", "utf-8"))).alias("kept"),
    )
