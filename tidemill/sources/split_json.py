"""One large JSON document read by many tasks: a structural scan cuts its array at element borders.

A first pass over byte ranges counts, for a range that begins outside a string and for one
that begins inside, how quotes and brackets change the state: whether it ends inside, by how much
the depth changes and how low it gets.  Their prefix sums, a few numbers for each range, tell
every range's own state.  In a second pass each task finds the commas at the array's depth; an element
belongs to the range that the comma before it lies in, and comes out as one line of JSON.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from tidemill.errors import ConfigurationError, TidemillError
from tidemill.shipping import ship_package
from tidemill.sources.ranges import RangedFile

_BLOCK = 1 << 20
_BEYOND = 1 << 16
_QUOTE, _BACK, _COMMA = 34, 92, 44
_DEPTH = np.zeros(256, np.int64)
_DEPTH[[ord("["), ord("{")]] = 1
_DEPTH[[ord("]"), ord("}")]] = -1
_STRUCTURE = _DEPTH != 0
_STRUCTURE[_COMMA] = True
_BLANK = b" \t\r\n"
#: Bytes of the ranges of one task at most (one range at least), and tasks for each core while there are ranges enough.
TASK_BYTES = 32 << 20
TASKS_A_CORE = 8
#: Bytes at a document's start that are searched for the array.
MOST_HEAD = 64 << 20


def structure(data: np.ndarray, before: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(places of quotes that begin or end strings, places of brackets and commas, in strings or not); ``before`` ends where the data begins."""
    quotes = np.flatnonzero(data == _QUOTE)
    left = np.arange(len(quotes))
    run = np.zeros(len(quotes), np.int64)
    while len(left):  # how many backslashes stand before each
        at = quotes[left] - run[left] - 1
        ahead = np.where(at >= 0, data[np.maximum(at, 0)], 0)
        early = np.flatnonzero(at < 0)
        ahead[early] = [before[a] if -a <= len(before) else 0 for a in at[early]]
        left = left[ahead == _BACK]
        run[left] += 1
    return quotes[run % 2 == 0], np.flatnonzero(_STRUCTURE[data])


def _before(file, first: int) -> bytes:
    """Bytes before a place, with all backslashes right before it."""
    size = 64
    while True:
        data = file.read(max(first - size, 0), first)
        if len(data) < size or data.rstrip(b"\\"):
            return data
        size *= 4


def _blocks(file, first: int, end: int, own: int | None = None):
    """(first byte, data, bytes before) of blocks; those beyond ``own`` are small, as few bytes matter there."""
    before, at = _before(file, first), first
    while at < end:
        size = _BLOCK if own is None else min(_BLOCK, own - at) if at < own else _BEYOND
        data = file.read(at, min(at + size, end))
        yield at, np.frombuffer(data, np.uint8), before
        before = data if data.rstrip(b"\\") else before + data
        at += size


def survey(file, first: int, end: int) -> list[tuple[bool, int, int]]:
    """For a range that begins outside a string, and for one that begins inside: (whether it ends inside, change of depth, lowest depth)."""
    out = []
    for inside in (0, 1):
        out.append([inside, 0, 0])
    for _, data, before in _blocks(file, first, end):
        quotes, places = structure(data, before)
        count = np.searchsorted(quotes, places)
        for state in out:
            real = places[(count + state[0]) % 2 == 0]
            depth = state[1] + np.cumsum(_DEPTH[data[real]])
            if len(depth):
                state[1], state[2] = int(depth[-1]), min(state[2], int(depth.min()))
            state[0] = (state[0] + len(quotes)) % 2
    return [(bool(a), b, c) for a, b, c in out]


def array_start(file, length: int, root: str | None) -> tuple[int, int] | None:
    """(place of the bracket of the array at ``root``, brackets around it); none if there's no array."""
    size = 1 << 16
    while True:
        text = file.read(0, min(size, length))
        try:
            # bytes as characters, so that places are those of the file
            return _found(text.decode("latin-1"), [p for p in (root or "").split(".") if p], size >= length)
        except _More:
            if size >= length or size >= MOST_HEAD:
                raise ConfigurationError(f"no array at {root!r} in the first {size} bytes") from None
            size *= 4


class _More(Exception):
    """The text ends too early."""


def _found(text: str, path: list[str], whole: bool) -> tuple[int, int] | None:
    decoder = json.JSONDecoder(strict=False)

    def skip(at: int) -> int:
        while at < len(text) and text[at] in " \t\r\n":
            at += 1
        if at >= len(text):
            raise _More
        return at

    def value_end(at: int) -> int:
        try:
            end = decoder.raw_decode(text, at)[1]
        except ValueError:
            raise _More from None
        if end >= len(text) and not whole:
            raise _More
        return end

    at = 3 if text.startswith("ï»¿") else 0  # a byte order mark
    at = skip(at)
    for depth, part in enumerate(path):
        if text[at] != "{":
            return None
        at = skip(at + 1)
        while text[at] == '"':
            end = value_end(at)
            name = json.loads(text[at:end].encode("latin-1").decode("utf-8", "replace"), strict=False)
            at = skip(end)
            if text[at] != ":":
                raise ConfigurationError("no valid JSON object")
            at = skip(at + 1)
            if name == part:
                break
            at = skip(value_end(at))
            at = skip(at + 1) if text[at] == "," else at
        else:
            return None
    return (at, len(path)) if text[at] == "[" else None


def elements(file, length: int, first: int, end: int, inside: bool, depth: int, start: int, level: int, strict: bool):
    """The array's elements after the commas and the bracket that lie from ``first`` up to ``end``, each without line feeds.

    ``inside`` and ``depth`` are the state at ``first``; the array begins at ``start``, and its
    elements have ``level`` brackets around them.
    """
    if first <= start < end:
        inside, depth, began, at = False, level - 1, None, start
    else:
        began, at = None, first
    held = bytearray()  # from ``began`` on
    tops = strays = 0  # of the element: brackets that open at its level, and other characters there

    def cut(body: bytes) -> bytes | None:
        text = body.strip(_BLANK)
        nested = text[:1] in (b"{", b"[")
        if not text or nested and (tops != 1 or strays) or not nested and tops:
            if strict:
                raise TidemillError(f"malformed element before byte {began}: {bytes(text[:60])!r}")
            return None
        return bytes(text).replace(b"\n", b" ").replace(b"\r", b" ")

    for place, data, before in _blocks(file, at, length, end):
        quotes, marks = structure(data, before)
        outside = (np.searchsorted(quotes, marks) + inside) % 2 == 0
        real = marks[outside]
        depths = depth + np.cumsum(_DEPTH[data[real]])
        breaks = np.flatnonzero((data == 10) | (data == 13))
        if strict and ((np.searchsorted(quotes, breaks) + inside) % 2).any():
            raise TidemillError("a line feed inside a JSON string")
        # what stands at the elements' level outside strings: brackets that open there, and scalars or strings
        opens = real[(depths == level + 1) & (_DEPTH[data[real]] > 0)]
        solid = np.flatnonzero((data > 32) & ~_STRUCTURE[data] & (data != 58))
        solid_depth = np.append(depth, depths)[np.searchsorted(real, solid, side="right")]
        solid = solid[solid_depth == level]
        borders = np.flatnonzero((depths == level) & (data[real] == _COMMA) | (depths == level - 1) | (depths == level) & (_DEPTH[data[real]] > 0))
        done = 0
        raw = data.tobytes()
        for k in borders.tolist():
            here = int(real[k])
            kind, now = raw[here], int(depths[k])
            if began is None:
                if now == level - 1 and kind in b"]}" and place + here > start:
                    return  # the array ended before an element of ours
                if kind == _COMMA and now == level or place + here == start:
                    began, done, held = place + here + 1, here + 1, bytearray()
                    tops = strays = 0
                    if began > end:
                        return
                continue
            if kind in b"[{" and now == level:
                continue
            held += raw[done:here]
            tops += int(np.searchsorted(opens, here) - np.searchsorted(opens, done))
            strays += int(np.searchsorted(solid, here) - np.searchsorted(solid, done))
            last = now == level - 1
            if not (last and not held.strip(_BLANK) and began == start + 1):  # an empty array has no element
                text = cut(held)
                if text is not None:
                    yield text
            if last:
                return
            began, done, held = place + here + 1, here + 1, bytearray()
            tops = strays = 0
            if began > end:
                return
        if began is not None:
            held += raw[done:]
            tops += int(len(opens) - np.searchsorted(opens, done))
            strays += int(len(solid) - np.searchsorted(solid, done))
        elif place + len(data) >= end:
            return
        depth = int(depths[-1]) if len(depths) else depth
        inside = bool((inside + len(quotes)) % 2)


def read_documents(spark: SparkSession, files: list[tuple[str, int]], root: str | None, strict: bool, range_bytes: int, folder: str) -> str:
    """Write the elements of the files' arrays as JSON lines below ``folder``; gives the path.

    A file without an array at ``root`` is one element, or with a root the value there.
    """
    ship_package(spark)
    ranges = [(i, a, min(a + range_bytes, n)) for i, (_, n) in enumerate(files) for a in range(0, max(n, 1), range_bytes)]
    together = ranges_of_a_task(len(ranges), range_bytes, spark.sparkContext.defaultParallelism)
    starts = {}

    def first_pass(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for i, a, b in pdf[["file", "first", "end"]].itertuples(index=False):
                address, length = files[i]
                with RangedFile(address) as file:
                    found = survey(file, a, b)
                    start = array_start(file, length, root) if a == 0 and length else None
                rows.append([i, a, *(int(x) for s in found for x in s), *(start or (-1, -1))])
            yield pd.DataFrame(rows, columns=["file", "first", *"abcdef", "start", "level"])

    table = spark.createDataFrame([(*r, n // together) for n, r in enumerate(ranges)], "file int, first long, end long, task int")
    table = table.repartitionById(max(-(-len(ranges) // together), 1), "task")
    rows = table.mapInPandas(first_pass, "file int, first long, a int, b long, c long, d int, e long, f long, start long, level long").collect()
    work = []
    known = {(r["file"], r["first"]): r for r in rows}
    for i, a, b in ranges:
        r = known[i, a]
        if a == 0:
            inside, depth, starts[i] = 0, 0, (r["start"], r["level"] + 1)
            alive = True
        start, level = starts[i]
        if start < 0:
            if a == 0:
                work.append((i, 0, files[i][1], False, 0, -1, 0))
            continue
        if alive and b > start:
            if work and work[-1][0] == i and work[-1][2] == a and a - work[-1][1] < (together - 1) * range_bytes + 1:
                work[-1] = (*work[-1][:2], b, *work[-1][3:])  # one longer range, which the state at its start does for
            else:
                work.append((i, a, b, bool(inside), depth, start, level))
        ends, change, lowest = (r["a"], r["b"], r["c"]) if not inside else (r["d"], r["e"], r["f"])
        if a > start and depth + lowest < level:  # the array has ended; the range of its bracket sees to that itself
            alive = False
        inside, depth = ends, depth + change
        if b >= files[i][1] and strict and (inside or depth):
            raise TidemillError(f"{files[i][0]}: unbalanced JSON")

    def second_pass(batches):
        import pandas as pd

        for pdf in batches:
            for i, a, b, inside, depth, start, level in pdf.itertuples(index=False):
                address, length = files[i]
                with RangedFile(address) as file:
                    if start < 0:
                        text = whole_document(file.read(0, length), root, strict)
                        found = [] if text is None else [text]
                    else:
                        found = elements(file, length, a, b, inside, depth, start, level, strict)
                    held = []
                    for text in found:
                        held.append(text.decode("utf-8", "strict" if strict else "replace"))
                        if len(held) >= 1000:
                            yield pd.DataFrame({"value": held})
                            held = []
                    if held:
                        yield pd.DataFrame({"value": held})

    path = f"{folder}/documents/{uuid.uuid4().hex}"
    numbers, held, task = [], 0, -1
    for w in work:  # short ones go to a task together
        if task < 0 or together == 1 or held + w[2] - w[1] > together * range_bytes:
            task, held = task + 1, 0
        held += w[2] - w[1]
        numbers.append(task)
    todo = spark.createDataFrame([(*w, n) for w, n in zip(work, numbers)], "file int, first long, end long, inside boolean, depth long, start long, level long, task int")
    todo.repartitionById(max(task + 1, 1), "task").drop("task").mapInPandas(second_pass, "value string").write.text(path)
    return path


def ranges_of_a_task(count: int, range_bytes: int, cores: int) -> int:
    """How many of ``count`` ranges a task takes: one while they are few, more before the tasks get many."""
    return max(1, min(TASK_BYTES // range_bytes, count // (TASKS_A_CORE * cores)))


def whole_document(data: bytes, root: str | None, strict: bool) -> bytes | None:
    """A document that is no array, or what stands at ``root`` of it, as one line."""
    try:
        value = json.loads(data)
        for part in (root or "").split("."):
            value = value.get(part) if part and isinstance(value, dict) else value if not part else None
    except ValueError as e:
        if strict and data.strip():
            raise TidemillError(f"malformed JSON: {e}") from e
        return None
    return None if value is None else json.dumps(value, ensure_ascii=False).encode()


def elements_frame(spark: SparkSession, path: str, strict: bool) -> DataFrame:
    """The lines as rows; what is no object becomes ``value``."""
    reader = spark.read.option("mode", "FAILFAST" if strict else "DROPMALFORMED")
    texts = spark.read.text(path)
    if texts.where("value NOT LIKE '{%'").isEmpty():
        return reader.json(path)
    from pyspark.sql import functions as F

    wrapped = path + "-values"
    texts.select(F.concat(F.lit('{"value":'), "value", F.lit("}"))).write.text(wrapped)
    return reader.json(wrapped)
