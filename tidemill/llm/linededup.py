"""Line deduplication by an exact set-similarity join.

A line is the set of its lower-cased words.  It goes if an earlier line, in the order of id
and line number, has a Jaccard similarity of at least ``threshold`` with it.  The steps:

1. A sketch counts words by hash over all documents; the input's size gives its own.  It orders
   the words of each line by rarity (the hash settles ties), the same way for all lines.
2. The first words of a line in that order, its prefix, are entries, one row each; two similar
   sets share one.  Words that the sketch has counted once are left out.  A word that the sketch
   has counted very often is keyed together with each later word of the prefix, as similar
   sets share a second one too.
3. Entries meet by word.  Equal sets are one, and a set stays a candidate if another passes the
   length filter, the positional filter and a bound by 128-bit parity signatures.  A word with
   very many different sets is cut into blocks, and each two blocks meet in a task of their own.
   Lines of a later copy of a whole text don't take part: the first copy stands for it.
4. The words of each candidate and its likeliest partner decide, those of equal sets too.  A
   candidate with more partners that this doesn't settle is compared with all of its words' groups.

Only entries, candidates and decisions move; texts stay in a table bucketed by id.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.functions.columns import quoted
from tidemill.llm.common import bound_batches, bucketed, contiguous_groups, discard, fold_ascii, later_copies, materialize, pack, ragged, staging, text_bytes, text_slices, unpack

#: Bits of a sketch's slots, at least and at most; in between a slot has about ``SLOT_WORDS`` words.
SKETCH_BITS = (24, 26)
SLOT_WORDS = 1 << 16
_BLOCKS = 64
#: Bytes of text whose entries make one partition.
PART_BYTES = 12 << 20
#: Occurrences beyond which a word is an entry only together with another word; more if a slot's mean comes near it.
HOT_WORD = 1 << 20
#: Different sets of one entry beyond which they are compared in blocks, and sets of a block.
MOST_SETS = 1 << 14
BLOCK_SETS = 1 << 12
#: Lines of one word without a decision, and of those they are compared with, that meet at once.
_ASKED_LINES, _MEMBER_LINES = 256, 2048
_CHUNK = 1 << 17
_FLUSH_BYTES = 6 << 20
_SOME_ENTRIES = 1 << 17  # that a task compares at once
_PAIRS = 1 << 20  # compared at once

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _byte_values() -> np.ndarray:
    folded = np.arange(256, dtype=np.uint64)
    folded[65:91] += np.uint64(32)
    return _mixed((folded + np.uint64(1)) * _MULTIPLIER)


_VALUES = _byte_values()


def words_of_bytes(line: bytes) -> frozenset[bytes]:
    return frozenset(line.lower().split())


def words_of_line(line: str) -> frozenset[bytes]:
    """The set of words of a line: runs without ASCII white space, A-Z lower-cased."""
    return words_of_bytes(line.encode("utf-8", "surrogatepass"))


@lru_cache(maxsize=2)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, modulo 2**64."""
    out = []
    for base in (_MULTIPLIER, np.uint64(pow(int(_MULTIPLIER), -1, 1 << 64))):
        p = np.full(1 << bits, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return tuple(out)


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of each word of a byte array: differences of one running sum, shifted back to the word's start."""
    word = (data != 32) & (data - np.uint8(9) > 4)
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    if len(word) and word[0]:
        edge = np.append(0, edge)
    if len(edge) % 2:
        edge = np.append(edge, len(data))
    start, stop = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64), start
    forth, back = _powers(len(data).bit_length())
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[data.astype(np.intp)] * forth[: len(data)], out=sums[1:])
    return _mixed((sums[stop] - sums[start]) * back[start]), start


def _chunks(ids, texts: list[bytes], most_bytes: int):
    """(ids, bytes, first byte of each document) for runs of about a million bytes of documents."""
    first = size = 0
    for i, t in enumerate(texts):
        size += len(t) + 1
        if size >= most_bytes or i == len(texts) - 1:
            part = texts[first : i + 1]
            lens = np.array([len(t) + 1 for t in part])
            yield ids[first : i + 1], np.frombuffer(b"\n".join(part) + b"\n", np.uint8), np.cumsum(lens) - lens
            first, size = i + 1, 0


def _flushes(batches, most_bytes: int):
    """(ids, texts as bytes) of some megabytes each."""
    import pyarrow as pa

    ids, texts, size = [], [], 0
    for batch in batches:
        for part in text_slices(batch, "_text", most_bytes):
            ids.append(part.column(part.schema.get_field_index("_id")).to_numpy())
            texts += part.column(part.schema.get_field_index("_text")).cast(pa.binary()).to_pylist()
            size += part.nbytes
            if size >= most_bytes:
                yield np.concatenate(ids), texts
                ids, texts, size = [], [], 0
    if texts:
        yield np.concatenate(ids), texts


def _level(count):
    """Rarity of a slot: 0 for one word at most, then three steps for each doubling."""
    return np.where(np.asarray(count) < 2, 0, np.minimum(3 * np.log2(np.maximum(count, 1)), 127)).astype(np.uint8)


def _sketch_shape(text_size: int) -> tuple[int, int]:
    """(bits of the sketch's slots, level from which a word is hot) for so many bytes of text.

    Words are taken to have 8 bytes.  Beyond the most bits a slot's mean is well above single
    words' counts, so a word is hot only at several times that.
    """
    words = max(text_size // 8, 1)
    bits = min(max((words // SLOT_WORDS).bit_length(), SKETCH_BITS[0]), SKETCH_BITS[1])
    return bits, int(_level(max(HOT_WORD, 8 * (words >> bits))))


def _summed(frames, keys: list[str]):
    """(keys, sum of the arrays) of a partition sorted by ``keys``; one payload and one sum are held at a time."""
    at, total = None, None
    for pdf in frames:
        for *key, payload in pdf[[*keys, "payload"]].itertuples(index=False):
            counts = unpack(payload)[0]
            if key != at:
                if at is not None:
                    yield at, total
                at, total = key, np.zeros(len(counts), np.int64)
            total += counts
    if at is not None:
        yield at, total


def _word_sketch(docs: DataFrame, bits: int, parts: int = _BLOCKS) -> np.ndarray:
    """The level of each hash slot, over all documents, which come in about ``parts`` tasks.

    Tasks' counts are summed in two steps, for each block of slots first those of about the root of
    their number, so that no worker gets the payloads of all tasks.
    """
    together = max(1, math.isqrt(parts))
    slots = 1 << bits
    shift = np.uint64(64 - bits)
    step = slots // _BLOCKS
    schema = "part int, some int, payload binary"

    def count(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        some = pa.array([TaskContext.get().partitionId() % together], pa.int32())

        sketch = np.zeros(slots, np.uint32)
        seen = False
        for ids, texts in _flushes(batches, _FLUSH_BYTES):
            for _, data, _ in _chunks(ids, texts, _CHUNK):
                np.add.at(sketch, (word_hashes(data)[0] >> shift).astype(np.int64), np.uint32(1))
                seen = True
        if seen:
            for b in range(_BLOCKS):
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), some, pa.array([pack(sketch[b * step : (b + 1) * step])], pa.binary())], ["part", "some", "payload"])

    def add(frames):
        for (b, some), total in _summed(frames, ["part", "some"]):
            yield pd.DataFrame({"part": [b], "some": [some], "payload": [pack(total)]})

    def finish(frames):
        for (b,), total in _summed(frames, ["part"]):
            yield pd.DataFrame({"part": [b], "payload": [pack(_level(total))]})

    with staging(docs.sparkSession):
        counted = docs.mapInArrow(count, schema)
        summed = counted.repartition("part", "some").sortWithinPartitions("part", "some").mapInPandas(add, schema)
        rows = summed.repartition(_BLOCKS, "part").sortWithinPartitions("part").mapInPandas(finish, "part int, payload binary").collect()
    out = np.zeros(slots, np.uint8)
    for r in rows:  # the sketch's size doesn't depend on the data
        out[r["part"] * step : (r["part"] + 1) * step] = unpack(r["payload"])[0]
    return out


def _needed(size: np.ndarray, other: np.ndarray, threshold: float) -> np.ndarray:
    """The least overlap with which two sizes reach the threshold."""
    return np.ceil(threshold / (1 + threshold) * (size + other) - 1e-9)


def _by_line_and_rarity(line: np.ndarray, level: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """The order by line, level and hash: a sort of packed numbers whose low bits are the index, with a full sort should their few bits of the hash be tied."""
    n = len(grams)
    index_bits, line_bits = max(n, 1).bit_length(), int(line[-1] if n else 0).bit_length()
    spare = 64 - line_bits - 7 - index_bits
    if spare >= 8:
        key = line.astype(np.uint64) << np.uint64(7) | level
        key = key << np.uint64(spare) | grams >> np.uint64(64 - spare)
        key = np.sort(key << np.uint64(index_bits) | np.arange(n, dtype=np.uint64))
        order = (key & np.uint64((1 << index_bits) - 1)).astype(np.int64)
        key >>= np.uint64(index_bits)
        tied = np.flatnonzero(key[1:] == key[:-1])
        if (grams[order[tied]] == grams[order[tied + 1]]).all():
            return order
    return np.lexsort((grams, level, line))


def _line_sets(ids, data: np.ndarray, heads: np.ndarray, sketch: np.ndarray):
    """Arrays of the distinct words of the lines of a chunk, by line and rarity, and of the lines."""
    grams, start = word_hashes(data)
    breaks = np.flatnonzero(data == 10)
    line = np.repeat(np.arange(len(breaks)), np.diff(np.searchsorted(start, breaks), prepend=0))  # lines end with their break
    level = sketch[(grams >> np.uint64(65 - len(sketch).bit_length())).astype(np.int64)].astype(np.uint64)
    order = _by_line_and_rarity(line, level, grams)
    grams, line, level = grams[order], line[order], level[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (line[1:] != line[:-1])
    grams, line, level = grams[new], line[new], level[new]
    first = np.flatnonzero(np.append(True, line[1:] != line[:-1])) if len(line) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(line)))
    number = line[first]
    begin = np.append(-1, breaks)[number] + 1
    doc = np.searchsorted(heads, begin, side="right") - 1
    count = np.searchsorted(breaks, heads)
    # signatures: for each of 128 bits the parity of the words that fall on it, so one word more or less flips one bit
    bits = np.uint64(1) << (grams >> np.uint64(58))
    upper = (grams >> np.uint64(57) & np.uint64(1)).astype(bool)
    none = np.uint64(0)
    if len(first):
        total = np.add.reduceat(_mixed(grams), first)
        mark, more = np.bitwise_xor.reduceat(np.where(upper, none, bits), first), np.bitwise_xor.reduceat(np.where(upper, bits, none), first)
    else:
        total = mark = more = np.zeros(0, np.uint64)
    return grams, level, first, size, ids[doc], number - count[doc], total, mark, more, begin, breaks[number]


def _equal_lines(lines: dict, order: np.ndarray, new: np.ndarray, bodies: list) -> np.ndarray:
    """``new`` (where a run of equal hashes begins in ``order``), also true for lines whose words differ after all."""
    chunk, begin, end = lines["chunk"], lines["begin"], lines["end"]
    text = lambda k: bodies[chunk[k]][begin[k] : end[k]]
    lead = None
    for i in np.flatnonzero(~new | np.append(~new[1:], False)).tolist():
        k = order[i]
        if new[i]:
            lead = text(k)
        elif text(k) != lead and words_of_bytes(text(k)) != words_of_bytes(lead):
            new[i] = True
    return new


_ENTRY = ["word", "mark", "more", "doc", "line", "form"]


def _entries(docs: DataFrame, sketch, hot: int, threshold: float, least_words: int) -> DataFrame:
    """Prefix entries, one row each: the word's hash, the set's signature, its place in the documents, and ``form``.

    ``line`` holds 32 bits of the set's hash below the line number, ``form`` the set's size, the
    word's place in the order and whether this entry settles equal sets.  Rows with a null word are lines
    whose set occurred before in the same batch, which its words confirm.
    """
    by_pairs = np.ceil(threshold * least_words - 1e-9) >= 2  # similar sets share two words at least

    def rows(word, *columns):
        import pyarrow as pa

        valid = None if word is not None else pa.nulls(len(columns[0]), pa.int64())
        arrays = [valid if word is None else pa.array(word.view(np.int64)), *(pa.array(c.astype(np.uint64, copy=False).view(np.int64)) for c in columns)]
        return pa.RecordBatch.from_arrays(arrays, _ENTRY)

    def work(batches):
        levels = sketch.value
        for ids, texts in _flushes(batches, _FLUSH_BYTES):
            names = ("size", "doc", "line", "key", "mark", "more", "begin", "end", "chunk")
            parts_of, bodies, base = [], [], 0
            for some, data, heads in _chunks(ids, texts, _CHUNK):
                grams, level, first, *facts = _line_sets(some, data, heads, levels)
                parts_of.append((grams, level, first + base, *facts, np.full(len(first), len(bodies))))
                bodies.append(data.tobytes())
                base += len(grams)
            grams, level, first, *facts = (np.concatenate(x) for x in zip(*parts_of))
            lines = dict(zip(names, facts))
            size, doc, line, key, mark, more = (lines[n] for n in names[:6])
            order = np.flatnonzero(size >= least_words)
            order = order[np.lexsort((line[order], doc[order], key[order]))]
            new = np.ones(len(order), bool)
            new[1:] = (key[order][1:] != key[order][:-1]) | (mark[order][1:] != mark[order][:-1]) | (more[order][1:] != more[order][:-1]) | (size[order][1:] != size[order][:-1])
            new = _equal_lines(lines, order, new, bodies)
            lead = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))] if len(order) else order
            gone = order[(doc[order] != doc[lead]) | (line[order] != line[lead])]  # not just a repeated row
            if len(gone):
                nothing = np.zeros(len(gone), np.uint64)
                yield rows(None, nothing, nothing, doc[gone], line[gone], nothing)

            def entries(owner, place, word, settles):
                for i in range(0, len(owner), 1 << 16):
                    here = slice(i, i + (1 << 16))
                    o = owner[here]
                    form = size[o] << 32 | place[here] << 1 | settles[here]
                    yield rows(_mixed(word[here]), mark[o], more[o], doc[o], line[o] << 32 | (key[o] >> np.uint64(32)).astype(np.int64), form)

            mine = order[new]
            n = size[mine]
            length = n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1
            owner, at = np.repeat(mine, length), ragged(first[mine], length)
            busy = np.flatnonzero(level[at] >= hot) if by_pairs else at[:0]
            shared = level[at] > 0
            shared[busy] = False
            o = owner[shared]
            settles = np.append(True, o[1:] != o[:-1])[: len(o)]
            yield from entries(o, at[shared] - first[o], grams[at[shared]], settles)
            if len(busy):  # a frequent word with each later word, one beyond the prefix included
                o, k = owner[busy], at[busy]
                later = first[o] + np.minimum(np.repeat(length, length)[busy] + 1, size[o]) - k - 1
                with_, o, k = ragged(k + 1, later), np.repeat(o, later), np.repeat(k, later)
                ok = level[with_] > 0
                with_, o, k = with_[ok], o[ok], k[ok]
                alone = np.ones(len(size), bool)
                alone[owner[shared]] = False
                settles = np.append(True, o[1:] != o[:-1])[: len(o)] & alone[o]
                yield from entries(o, k - first[o], _mixed(grams[k] * _MULTIPLIER + grams[with_]), settles)

    return docs.mapInArrow(work, ", ".join(f"{n} long" for n in _ENTRY))


def _filtered(x: tuple, y: tuple, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(may be similar, bits that differ) for sets given as (size, place, signature, signature), by length, position and signature."""
    needed = _needed(x[0], y[0], threshold)
    slack = x[0] + y[0] - 2 * needed  # words that one set only may have
    apart = np.bitwise_count(x[2] ^ y[2]) + np.bitwise_count(x[3] ^ y[3])
    ok = (np.minimum(x[0], y[0]) >= threshold * np.maximum(x[0], y[0]) - 1e-9) & (apart <= slack)
    # the words before the first shared one are in one set only; so must the rest allow enough
    ok &= x[1] + y[1] <= slack
    return ok & (needed <= np.minimum(x[0] - x[1], y[0] - y[1])), apart


def _near(facts: tuple, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """What a quick bound needs of each set: half a signature, and its share of the bits that may differ."""
    return facts[2], (facts[0] * ((1 - threshold) / (1 + threshold)) + 1e-3).astype(np.float32)


def _blocks_of_pairs(heads: np.ndarray, ends: np.ndarray, facts: tuple, threshold: float, meet=None):
    """(later, earlier) rows of the same group that pass the quick bound, for some rows of a group or some whole groups at once; ``meet`` says which rows meet at all."""
    mark, share = _near(facts, threshold)
    count = ends - heads
    small = np.repeat(count <= 24, count)
    row = np.flatnonzero(small)
    start = np.repeat(heads, count)[row]
    for i in range(0, len(row), _PAIRS >> 6):
        r, s = row[i : i + (_PAIRS >> 6)], start[i : i + (_PAIRS >> 6)]
        later, earlier = np.repeat(r, r - s), ragged(s, r - s)
        near = np.bitwise_count(mark[later] ^ mark[earlier]) <= share[later] + share[earlier]
        yield later[near], earlier[near]
    for a, b in zip(heads[count > 24].tolist(), ends[count > 24].tolist()):
        step = max(1, _PAIRS // (b - a))
        for i in range(a, b, step):
            j = min(i + step, b)
            near = np.bitwise_count(mark[i:j, None] ^ mark[None, a:j]) <= share[i:j, None] + share[None, a:j]
            later, earlier = np.nonzero(near)
            later, earlier = later + i, earlier + a
            ok = earlier < later
            if meet is not None:
                ok &= meet[later] != meet[earlier]
            yield later[ok], earlier[ok]


def _best_partners(heads: np.ndarray, facts: tuple, threshold: float, meet=None):
    """For rows of groups that start at ``heads``: (row, likeliest earlier row that passes, number that pass, rows with several partners and these partners).

    ``facts`` ends with the document and line of each row.  Where a group is compared in pieces, a
    row can come once for each.
    """
    doc, line = facts[4:]
    held, size = [], 0

    def settled():
        later, earlier, apart = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((apart, later))
        later, earlier = later[order], earlier[order]
        first = np.flatnonzero(np.append(True, later[1:] != later[:-1])) if len(later) else np.zeros(0, np.int64)
        count = np.diff(np.append(first, len(later)))
        several = np.repeat(count > 1, count)
        return later[first], earlier[first], count, np.unique(np.concatenate([later[several], earlier[several]]))

    for later, earlier in _blocks_of_pairs(heads, np.append(heads[1:], len(facts[0])), facts, threshold, meet):
        ok, apart = _filtered(tuple(f[later] for f in facts[:4]), tuple(f[earlier] for f in facts[:4]), threshold)
        later, earlier, apart = later[ok], earlier[ok], apart[ok]
        swap = (doc[later] < doc[earlier]) | (doc[later] == doc[earlier]) & (line[later] < line[earlier])
        held.append((np.where(swap, earlier, later), np.where(swap, later, earlier), apart))
        size += len(held[-1][0])
        if size >= _PAIRS:
            yield settled()
            held, size = [], 0
    if size:
        yield settled()


EQUAL, MEMBER, PAIR, HOT, SEEN = range(5)
_FOUND = ["kind", "doc", "line", "word", "doc2", "line2", "n", "mark", "more", "form"]
_FOUND_SCHEMA = ", ".join(f"{n} long" for n in _FOUND)


def _facts(mark: np.ndarray, more: np.ndarray, form: np.ndarray, doc: np.ndarray, line: np.ndarray) -> tuple:
    """(size, place, signature, signature, document, line) of entries, for :func:`_best_partners`."""
    return form >> 32, (form >> 1) & 0x7FFFFFFF, mark.view(np.uint64), more.view(np.uint64), doc, line


def _found(kind: int, doc, line, word=None, doc2=None, line2=None, n=None, mark=None, more=None, form=None):
    import pyarrow as pa

    def column(values):
        return pa.array(np.zeros(len(doc), np.int64) if values is None else values.astype(np.int64, copy=False) if values.dtype != np.uint64 else values.view(np.int64))

    return pa.RecordBatch.from_arrays([pa.array(np.full(len(doc), kind, np.int64)), *map(column, (doc, line, word, doc2, line2, n, mark, more, form))], _FOUND)


def _one_of_equals(rows: list[np.ndarray]):
    """(entries with one row for each word and set, the first by position, in order of word and position; the equal lines after them)."""
    word, mark, more, doc, line, form = rows
    # rows of one set are brought together by a hash; should it bring others between them, they stay apart and are compared
    code = _mixed((word * 3 ^ mark ^ (line & 0xFFFFFFFF)).view(np.uint64) * _MULTIPLIER + more.view(np.uint64))
    order = np.argsort(code)
    same = code[order][1:] == code[order][:-1]
    twice = np.append(same, False) | np.append(False, same)
    some = order[twice]
    some = some[np.lexsort((line[some], doc[some], code[some]))]
    lead = np.zeros(0, np.int64)
    if len(some):
        new = np.append(True, code[some][1:] != code[some][:-1])
        for x in (word, mark, more, line & 0xFFFFFFFF, form >> 32):
            new[1:] |= x[some][1:] != x[some][:-1]
        lead = some[np.maximum.accumulate(np.where(new, np.arange(len(some)), 0))]
    number = line >> 32
    later = ((doc[some] != doc[lead]) | (number[some] != number[lead])) & (form[some] & 1 > 0)  # not just a repeated row
    equal = _found(EQUAL, doc[some][later], number[some][later], doc2=doc[lead[later]], line2=number[lead[later]])
    if not (some != lead).any():
        return rows, equal
    keep = np.ones(len(word), bool)
    keep[some[some != lead]] = False
    return [x[keep] for x in rows], equal


def _candidates(entries: DataFrame, parts: int, threshold: float) -> DataFrame:
    """Rows of these kinds.

    ``SEEN``: a line whose words an earlier one of the same batch has.  ``EQUAL``: a line and an
    earlier one of equal signature.  ``PAIR``: a line and its likeliest partner, with the number
    of partners.  ``MEMBER``: a line of a word's group where some have several partners.
    ``HOT``: a set of a word that has very many.
    """

    def compared(rows, busy):
        word, mark, more, doc, line, form = rows
        heads = np.flatnonzero(np.append(True, word[1:] != word[:-1])) if len(word) else np.zeros(0, np.int64)
        count = np.diff(np.append(heads, len(word)))
        many = np.repeat(count > MOST_SETS, count)
        if busy is not None:
            many |= word == busy
        if many.any():
            yield _found(HOT, doc[many], line[many] >> 32, word[many], mark=mark[many], more=more[many], form=form[many])
        rest = np.flatnonzero(~many & np.repeat(count > 1, count))
        if len(rest):
            word, mark, more, doc, line, form = (x[rest] for x in rows)
            heads, number = np.flatnonzero(np.append(True, word[1:] != word[:-1])), line >> 32
            for late, early, n, again in _best_partners(heads, _facts(mark, more, form, doc, number), threshold):
                yield _found(PAIR, doc[late], number[late], doc2=doc[early], line2=number[early], n=n)
                yield _found(MEMBER, doc[again], number[again], word[again])

    def work(batches):
        held, size, busy = [], 0, None
        for batch in batches:
            columns = [c.fill_null(0).to_numpy() for c in batch.columns]
            if batch.column(0).null_count:
                null = batch.column(0).is_null().to_numpy(zero_copy_only=False)
                yield _found(SEEN, columns[3][null], columns[4][null])
                columns = [c[~null] for c in columns]
            held.append(columns)
            size += len(columns[0])
            if size < _SOME_ENTRIES:
                continue
            rows = [np.concatenate(x) for x in zip(*held)]
            cut = int(np.searchsorted(rows[0], rows[0][-1]))
            done, equal = _one_of_equals([x[:cut] for x in rows])
            yield equal
            yield from compared(done, busy)
            # the last word may go on; one of its equal sets is enough, and very many sets don't wait
            tail, equal = _one_of_equals([x[cut:] for x in rows])
            yield equal
            held, size = [tail], len(tail[0])
            if size > MOST_SETS or tail[0][0] == busy:
                busy, held, size = tail[0][0], [], 0
                yield from compared(tail, busy)
        if held:
            done, equal = _one_of_equals([np.concatenate(x) for x in zip(*held)])
            yield equal
            yield from compared(done, busy)

    spread = entries.repartition(parts, F.coalesce("word", F.xxhash64("doc", "line"))).sortWithinPartitions("word")
    return materialize(spread.mapInArrow(work, _FOUND_SCHEMA), "line-candidates")


def _hot_pairs(found: DataFrame, threshold: float) -> DataFrame:
    """``PAIR`` and ``MEMBER`` rows of words with very many sets: each two blocks of a word meet in a task of their own."""
    hot = found.where(F.col("kind") == HOT).select("word", "doc", "line", "mark", "more", "form")
    sizes = materialize(hot.groupBy("word").agg(F.ceil(F.count(F.lit(1)) / BLOCK_SETS).alias("blocks")), "line-hot")
    own = F.pmod(F.xxhash64("doc", "line"), F.col("blocks"))
    dealt = hot.join(sizes, "word").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("word", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), "own", "doc", "line", "mark", "more", "form")
    keys = ["word", "one", "two"]

    def work(frames):
        for pdf in contiguous_groups(frames, keys):
            for (word, one, two), part in pdf.groupby(keys, sort=False):
                part = part.drop_duplicates(["doc", "line"])
                doc, line, mark, more, form, own = (part[c].to_numpy() for c in ("doc", "line", "mark", "more", "form", "own"))
                for late, early, n, again in _best_partners(np.zeros(1, np.int64), _facts(mark, more, form, doc, line), threshold, None if one == two else own):
                    yield _found(PAIR, doc[late], line[late], doc2=doc[early], line2=line[early], n=n).to_pandas()
                    yield _found(MEMBER, doc[again], line[again], np.full(len(again), word)).to_pandas()

    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(work, _FOUND_SCHEMA)


def _bodies(table: DataFrame, lines: DataFrame) -> DataFrame:
    """``lines`` (doc, line, whole) with the SHA-256 of each, and its text if it is asked for as a whole."""
    asked = lines.groupBy(F.col("doc").alias("_id"), "line").agg(F.max("whole").alias("whole"))
    asked = asked.groupBy("_id").agg(F.collect_list(F.struct("line", "whole")).alias("_asked"))
    body = lambda x: F.element_at("_lines", (x["line"] + 1).cast("int"))
    fact = lambda x: F.struct(x["line"].alias("line"), F.unhex(F.sha2(body(x), 256)).alias("digest"), F.when(x["whole"], body(x)).alias("body"))
    split = table.join(asked.hint("shuffle_hash"), "_id").dropDuplicates(["_id"]).select("_id", F.split("_text", "\n", -1).alias("_lines"), "_asked")
    return split.select(F.col("_id").alias("doc"), F.inline(F.transform("_asked", fact)))


def _alike(a: frozenset, b: frozenset, threshold: float) -> bool:
    both = len(a & b)
    return both >= threshold * (len(a) + len(b) - both) - 1e-9


def _decided(table: DataFrame, found: DataFrame, threshold: float) -> DataFrame:
    """(doc, line) of all lines that go.

    Each candidate is compared with its likeliest partner first.  Those that have more
    partners and aren't settled by that are compared within their words' whole groups.
    """
    if not found.where(F.col("kind") == HOT).isEmpty():
        found = materialize(found.where(F.col("kind") != HOT).unionAll(_hot_pairs(found, threshold)), "line-candidates")
    gone = found.where(F.col("kind") == SEEN).select("doc", "line")
    pairs = found.where(F.col("kind").isin(EQUAL, PAIR)).groupBy("doc", "line", "doc2", "line2").agg(F.max("n").alias("n"))
    pairs = materialize(pairs, "line-pairs")  # n is 0 for equal sets
    members = found.where(F.col("kind") == MEMBER).select("doc", "line", "word")
    one, two = (lambda df, whole: df.select("doc", "line", F.lit(whole).alias("whole"))), (lambda df, whole: df.select(F.col("doc2").alias("doc"), F.col("line2").alias("line"), F.lit(whole).alias("whole")))
    equal, near = pairs.where("n = 0"), pairs.where("n > 0")
    asked = one(equal, False).unionAll(two(equal, False)).unionAll(one(near, True)).unionAll(two(near, True)).unionAll(one(members, True))
    bodies = materialize(_bodies(table, asked), "line-bodies")
    digests = bodies.select("doc", "line", "digest")
    others = digests.select(F.col("doc").alias("doc2"), F.col("line").alias("line2"), F.col("digest").alias("other"))
    equal = materialize(equal.join(digests, ["doc", "line"]).join(others, ["doc2", "line2"]).select("doc", "line", "doc2", "line2", (F.col("digest") == F.col("other")).alias("same")), "lines-equal")
    gone = gone.unionAll(equal.where("same").select("doc", "line"))
    written = equal.where("not same").drop("same")  # the same words in another order, spacing or case
    whole = bodies.where("body is not null").select("doc", "line", "body")
    judged = _judged(near, whole, threshold)
    gone = gone.unionAll(judged.where("same").select("doc", "line"))
    if not written.isEmpty():
        texts = materialize(_bodies(table, one(written, True).unionAll(two(written, True))), "line-bodies")
        gone = gone.unionAll(_judged(written.withColumn("n", F.lit(0)), texts.select("doc", "line", "body"), threshold).where("same").select("doc", "line"))
    left = judged.where("not same and n > 1").select("doc", "line")
    if not left.isEmpty():
        gone = gone.unionAll(_similar(whole, members, left, threshold))
    out = materialize(gone.groupBy(F.col("doc").alias("_id")).agg(F.sort_array(F.collect_set("line")).alias("_gone")), "lines-gone")
    discard(found, pairs, bodies, equal, judged)
    return out


def _judged(pairs: DataFrame, bodies: DataFrame, threshold: float) -> DataFrame:
    """(doc, line, same, n) of the lines of ``pairs``: whether a partner is similar, and the most partners it has."""

    @F.pandas_udf("boolean")
    def alike(one: pd.Series, other: pd.Series) -> pd.Series:
        return pd.Series([_alike(words_of_line(x), words_of_line(y), threshold) for x, y in zip(one, other)], dtype=bool)

    others = bodies.select(F.col("doc").alias("doc2"), F.col("line").alias("line2"), F.col("body").alias("other"))
    both = pairs.join(bodies, ["doc", "line"]).join(others, ["doc2", "line2"])
    judged = both.select("doc", "line", "n", alike("body", "other").alias("same"))
    return materialize(judged.groupBy("doc", "line").agg(F.max("same").alias("same"), F.max("n").alias("n")), "line-judged")


def _similar(bodies: DataFrame, members: DataFrame, left: DataFrame, threshold: float) -> DataFrame:
    """(doc, line) of those of ``left`` to which an earlier line under one of their words is similar; the lines of a word meet in blocks."""
    members = members.distinct()
    asked = members.join(left, ["doc", "line"], "left_semi")
    counts = asked.groupBy("word").agg(F.ceil(F.count(F.lit(1)) / _ASKED_LINES).alias("_p"))
    counts = members.join(counts, "word").groupBy("word").agg(F.max("_p").alias("_p"), F.ceil(F.count(F.lit(1)) / _MEMBER_LINES).alias("_q"))
    counts = materialize(counts, "line-words")
    place = F.xxhash64("doc", "line")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    queries = asked.join(counts, "word").select("word", F.pmod(place, F.col("_p")).alias("p"), every("_q").alias("q"), "doc", "line", F.lit(True).alias("asked"))
    others = members.join(counts, "word").select("word", every("_p").alias("p"), F.pmod(place, F.col("_q")).alias("q"), "doc", "line", F.lit(False).alias("asked"))
    keys = ["word", "p", "q"]
    lines = queries.unionAll(others).join(bodies, ["doc", "line"])

    def compare(frames):
        for pdf in contiguous_groups(frames, keys):
            gone = []
            for _, part in pdf.groupby(keys, sort=False):
                rows = [(asked, (doc, line), words_of_line(body)) for asked, doc, line, body in part[["asked", "doc", "line", "body"]].itertuples(index=False)]
                known = [(at, words) for asked, at, words in rows if not asked]
                for asked, at, words in rows:
                    low, high = threshold * len(words) - 1e-9, len(words) / threshold + 1e-9
                    if asked and any(other < at and low <= len(w) <= high and _alike(words, w, threshold) for other, w in known):
                        gone.append(at)
            yield pd.DataFrame(gone, columns=["doc", "line"], dtype="int64")

    return materialize(lines.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(compare, "doc long, line long"), "lines-similar")


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, least_words: int = 3) -> tuple[DataFrame, DataFrame]:
    """(table, gone): the documents' table (_id and _row with all columns) bucketed by id, and rows (_id, _gone: numbers of the lines that go, _copied: a later copy of a whole text, where all lines that count go)."""
    bound_batches(docs.sparkSession)
    size = docs.agg(text_bytes(quoted(text_col))).first()[0] or 0
    parts = int(min(max(size // PART_BYTES, 4), 1 << 20))
    digest = F.unhex(F.sha2(F.coalesce(F.col(quoted(text_col)), F.lit("")), 256)).alias("_digest")
    rows = docs.select(F.col(quoted(id_col)).cast("long").alias("_id"), F.struct(*(F.col(quoted(c)) for c in docs.columns)).alias("_row"), digest)
    table = bucketed(rows, parts, "_id")
    whole = table.where("_id is not null").select("_id", F.coalesce(F.col("_row." + quoted(text_col)), F.lit("")).alias("_text"))
    copies = later_copies(table, ["_digest"])
    bits, hot = _sketch_shape(size)
    shared = docs.sparkSession.sparkContext.broadcast(_word_sketch(whole, bits, parts))
    texts = whole.join(copies.hint("shuffle_hash"), "_id", "left_anti")
    gone = _decided(whole, _candidates(_entries(texts, shared, hot, threshold, least_words), parts, threshold), threshold)
    nothing = F.lit(None).cast("array<long>").alias("_gone")
    return table, gone.withColumn("_copied", F.lit(False)).unionAll(copies.select("_id", nothing, F.lit(True).alias("_copied")))


def _short(line, least_words: int):
    """Whether a line has fewer than ``least_words`` different words; mostly its first words tell."""
    blanks, some = "[ \t\x0B\f\r]+", 2 * least_words + 2

    def different(words):
        return F.size(F.array_distinct(F.transform(F.filter(words, lambda w: w != ""), fold_ascii)))

    first = F.slice(F.split(line, blanks, some), 1, some - 1)
    return F.when(different(first) >= least_words, False).otherwise(different(F.split(line, blanks)) < least_words)


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, least_words: int = 3, counts: bool = False) -> DataFrame:
    """``docs`` without the lines that an earlier line is similar to; the text column is what remains.

    Lines are split at line feeds.  Lines with fewer than ``least_words`` different words
    stay.  A line is judged against all earlier ones, removed or not.  Null texts stay null
    and a text may become empty.  Ids are integers (others fail to cast) that identify texts: rows
    that repeat an id share its decisions, and rows without one neither lose nor remove lines.  With
    ``counts`` there are ``n_lines`` and ``n_removed`` too.
    """
    table, gone = repeated_lines(docs, id_col, text_col, threshold, least_words)
    joined = table.join(gone.hint("shuffle_hash"), "_id", "left")
    body = F.col("_row." + quoted(text_col))
    lines = F.split(body, "\n", -1)
    at = F.transform(F.col("_gone"), lambda x: x.cast("int"))
    kept = F.when(F.col("_copied"), F.filter(lines, lambda x: _short(x, least_words))).otherwise(F.filter(lines, lambda _, i: ~F.array_contains(at, i)))
    text = F.when(F.col("_copied").isNull(), body).otherwise(F.array_join(kept, "\n"))
    n_lines = F.coalesce(F.size(lines), F.lit(0)).cast("long")
    n_removed = F.when(F.col("_copied") & body.isNotNull(), F.size(lines) - F.size(kept)).otherwise(F.coalesce(F.size("_gone"), F.lit(0))).cast("long")
    more = [n_lines.alias("n_lines"), n_removed.alias("n_removed")] if counts else []
    return joined.select(*(text.alias(c) if c == text_col else F.col("_row." + quoted(c)).alias(c) for c in docs.columns), *more)
