"""SimHash near-duplicates, searched with BK-trees.

Fingerprints that differ in at most ``radius`` of 64 bits agree on two whole blocks when the
bits are cut into ``radius + 2`` blocks.  So each distinct fingerprint goes to one shard for
every pair of blocks, keyed by the values of both blocks, and every link lies inside a
shard.  A shard holds a BK-tree: children are keyed by their integer Hamming distance to the
parent, and a search follows only edges within the radius.  Fingerprints of a shard with many
of them go to narrower shards, which hold all bits but those of ``radius`` small blocks, so a
tree stays bounded however many fingerprints are close to each other.  A task returns a
spanning forest of the links it finds, never all pairs.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import bound_batches, contiguous_groups, materialize, ragged
from tidemill.llm.components import connected_components

#: Fingerprints of a shard beyond which they go to narrower ones.
TREE_SIZE = 512
#: Narrow shards of one fingerprint at most.
MOST_NARROW = 2000
_SLICE = 1 << 16


def fingerprint(text: str | None, words: int) -> int:
    """SimHash of the word shingles of a text, as an unsigned integer.

    A-Z is lower-cased, words are runs without ASCII white space, each shingle (repeats
    included) weighs one through its XXH64 with seed 42.  A bit is set if more than half of
    the hashes have it.  Fewer words than ``words`` make one shingle; no words give zero.
    """
    from xxhash import xxh64_intdigest

    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    if len(parts) <= words:
        return xxh64_intdigest(b" ".join(parts), 42)
    shingles = map(b" ".join, zip(*(parts[i:] for i in range(words))))
    hashes = np.fromiter((xxh64_intdigest(s, 42) for s in shingles), "<u8", len(parts) - words + 1)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _SLICE):
        bits = np.unpackbits(hashes[i : i + _SLICE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5) -> DataFrame:
    """One row per input row: the id and ``fp``, the fingerprint as a signed long."""
    bound_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def signed(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64))

    return docs.select(F.col(id_col), signed(F.col(text_col)).alias("fp"))


class BKTree:
    """Integers by Hamming distance."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        new = len(self.values)
        self.values.append(value)
        self.children.append({})
        at = 0
        while at != new:
            away = (self.values[at] ^ value).bit_count()
            at = self.children[at].setdefault(away, new)

    def within(self, value: int, radius: int):
        """Positions of the values at most ``radius`` bits away."""
        todo = [0] if self.values else []
        while todo:
            at = todo.pop()
            away = (self.values[at] ^ value).bit_count()
            if away <= radius:
                yield at
            todo += [c for d, c in self.children[at].items() if away - radius <= d <= away + radius]


def _forest(values: list[int], radius: int) -> list[tuple[int, int]]:
    """(value, root) links that join the same values as all links between them."""
    tree = BKTree()
    parent: dict[int, int] = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for q in values:  # each one meets those before it
        for at in tree.within(q, radius):
            a, b = find(q), find(tree.values[at])
            if a != b:
                parent[max(a, b)] = min(a, b)
        tree.add(q)
    return [(v, r) for v in parent if (r := find(v)) != v]


def _shards(radius: int, bits: int, free: int):
    """Shard names of a fingerprint, for all choices of ``free`` of its blocks of about ``bits`` bits that may differ."""
    count = max(64 // bits, free + 1)
    edges = [64 * i // count for i in range(count + 1)]
    names = []
    for n, gone in enumerate(combinations(range(count), free)):
        mask = sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in range(count) if i not in gone)
        kept = F.col("node").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))
        # one long names a shard; two shards that share it only compare a few more fingerprints
        names.append(F.xxhash64(F.lit(n), kept))
    return F.explode(F.array(*names)).alias("shard")


def _tree_links(rows: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) within the shards of ``rows`` (shard, node)."""

    def search(batches):
        for pdf in contiguous_groups(batches, ["shard"]):
            found = []
            for _, part in pdf.groupby("shard", sort=False):
                found += _forest(part["node"].astype("uint64").tolist(), radius)
            yield pd.DataFrame(np.array(found, np.uint64).reshape(-1, 2).view(np.int64), columns=["a", "b"])

    return rows.repartition("shard").sortWithinPartitions("shard").mapInPandas(search, "a long, b long")


def fingerprint_links(prints: DataFrame, radius: int = 2, tree_size: int = TREE_SIZE) -> DataFrame:
    """``prints`` (fp: long, distinct) to links (a, b) that connect all fingerprints within ``radius`` of each other.

    Shards with more than ``tree_size`` fingerprints aren't searched; their members go to narrow
    shards of at most 2**(block bits x radius) fingerprints, which find the same links.
    """
    nodes = prints.select(F.col("fp").alias("node"))
    rows = nodes.select("node", _shards(radius, 64 // (radius + 2), radius))
    sizes = materialize(rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shards")
    links = _tree_links(rows.join(sizes.where(F.col("n") <= tree_size), "shard").select("shard", "node"), radius)
    crowded = sizes.where(F.col("n") > tree_size)
    if crowded.isEmpty():
        return links
    busy = materialize(rows.join(crowded, "shard", "left_semi").select("node").distinct(), "crowded")
    bits = max(1, (TREE_SIZE.bit_length() - 1) // max(radius, 1))
    while comb(64 // bits, radius) > MOST_NARROW:  # for a radius of 4 or more trees get larger instead
        bits += 1
    return links.unionAll(_tree_links(busy.select("node", _shards(radius, bits, radius)), radius))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, radius: int = 2, tree_size: int = TREE_SIZE) -> DataFrame:
    """One row per input row: the id, ``fingerprint`` (16 hex digits) and ``component_id``.

    Documents whose fingerprints differ in at most ``radius`` bits are linked;
    ``component_id`` is the least id that links reach, the row's own included.  Null and
    empty texts have fingerprint zero and are linked like others.  Null ids are never the
    least unless no other id is in the component.  Repeated rows stay.  Other columns of
    ``docs`` are not read.
    """
    prints = materialize(fingerprints(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), "_id", "_text", words), "fingerprints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("_id").alias("least")), "fingerprints")
    roots = connected_components(fingerprint_links(distinct.select("fp"), radius, tree_size))
    owned = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    owned = materialize(owned, "fingerprint-roots")
    least = materialize(owned.groupBy("root").agg(F.min("least").alias("component_id")), "components")
    table = materialize(owned.join(least, "root").select("fp", "component_id"), "fingerprint-components")
    return prints.join(table, "fp").select(
        F.col("_id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


# ---- near-duplicates by similarity ----------------------------------------------------------

WIDE_BITS = 256
#: Differing bits of a candidate at most, of all bits and of the first 64.  The expected share at a
#: Jaccard similarity of 0.8 is acos(2 * 0.8 / 1.8) / pi = 0.151, and 0.19 for the smallest sets;
#: the bounds are 4.5 standard deviations above the first and 2.6 above the second.
WIDE_RADIUS = 64
_FIRST_RADIUS = 22
#: How often a pair of that similarity must fall into a common shard.
WIDE_RECALL = 0.99
#: Sets of at most so many shingles also meet by shingle, which is exact.
_SMALL_SET = 40
#: Shard tables whose neighbours are compared first.
_FIRST_TABLES = 6
#: Pairs that one task compares for one shard, and nodes of one side where there are more.
_SHARD_PAIRS = 1 << 22
_BLOCK_NODES = 2048
_PAIRS_AT_ONCE = 1 << 20
_FPS = ["f0", "f1", "f2", "f3"]


def shingle_set(text: str | None, words: int) -> set[bytes]:
    """The different word shingles of a text, by the rules of :func:`fingerprint`."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return set()
    return set(map(b" ".join, zip(*(parts[i:] for i in range(words))))) or {b" ".join(parts)}


def similar(a: set, b: set) -> bool:
    """Whether the Jaccard similarity is 0.8 or more; two empty sets are equal."""
    common = len(a & b)
    return 5 * common >= 4 * (len(a) + len(b) - common)


def wide_fingerprint(shingles: set[bytes]) -> tuple[bytes, bytes, list[int]]:
    """SimHash of 256 bits, a 128-bit digest of the set, and for small sets the shards of their least shingles.

    Two sets of a similarity of 0.8 share one of the n // 5 + 1 least hashes of either.
    """
    from xxhash import xxh3_128_digest

    ones = np.zeros(WIDE_BITS, np.int64)
    names, rest = [], list(shingles)
    for i in range(0, len(rest), 1 << 14):
        some = rest[i : i + (1 << 14)]
        first = [xxh3_128_digest(x, 1) for x in some]
        names += first
        raw = b"".join([n + xxh3_128_digest(x, 2) for n, x in zip(first, some)])
        bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(len(some), -1), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    names.sort()
    least = names[: len(names) // 5 + 1] if len(names) <= _SMALL_SET else []
    digest = xxh3_128_digest(b"".join(names))
    return np.packbits(2 * ones > len(rest), bitorder="little").tobytes(), digest, [int.from_bytes(n[:8], "little", signed=True) for n in least]


def _cross_pairs(pdf: pd.DataFrame, keys: list[str], most: int):
    """(i, j) arrays of rows of one group but different roots, and the rows of groups with over ``most`` such pairs.

    ``pdf`` is sorted by ``keys`` and root.  The last item is the one of the rows.
    """
    n = len(pdf)
    new = np.zeros(n - 1, bool)
    for k in keys:
        v = pdf[k].to_numpy()
        new |= v[1:] != v[:-1]
    root = pdf["root"].to_numpy()

    def ends_of(change):
        heads = np.flatnonzero(np.append(True, change))
        ends = np.append(heads[1:], n)
        return heads, ends - heads, np.repeat(ends, ends - heads)

    heads, lengths, group_end = ends_of(new)
    _, _, run_end = ends_of(new | (root[1:] != root[:-1]))
    sizes = group_end - run_end
    hot = np.repeat(np.add.reduceat(sizes, heads) > most, lengths)
    sizes[hot] = 0
    total = np.append(0, np.cumsum(sizes))
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + _PAIRS_AT_ONCE, side="right")) - 1)
        yield np.repeat(np.arange(lo, hi), sizes[lo:hi]), ragged(run_end[lo:hi], sizes[lo:hi])
        lo = hi
    yield np.flatnonzero(hot), None


def _candidates(rows: DataFrame, nodes: DataFrame, most: int = _SHARD_PAIRS, block: int = _BLOCK_NODES) -> DataFrame:
    """All pairs (a, b) of one shard, different roots and few differing first bits, for ``rows`` (shard, node, root, f0).

    Shards with more than ``most`` pairs are dealt into blocks, and each two blocks meet in a task of their own.
    """

    def compare(keys, most, dealt):
        def run(batches):
            for pdf in contiguous_groups(batches, keys):
                node, bits = pdf["node"].to_numpy(), pdf["f0"].to_numpy().view(np.uint64)
                for i, j in _cross_pairs(pdf, keys, most):
                    if j is None:
                        yield pd.DataFrame({"a": pdf["shard"].to_numpy()[i], "b": node[i], "hot": True})
                        continue
                    ok = np.bitwise_count(bits[i] ^ bits[j]) <= _FIRST_RADIUS
                    if dealt:
                        own, one = pdf["own"].to_numpy(), (pdf["one"] == pdf["two"]).to_numpy()
                        ok &= one[i] | (own[i] != own[j])
                    yield pd.DataFrame({"a": node[i[ok]], "b": node[j[ok]], "hot": False})

        return run

    out = "a long, b long, hot boolean"
    found = rows.repartition("shard").sortWithinPartitions("shard", "root").mapInPandas(compare(["shard"], most, False), out)
    found = materialize(found, "wide-found")
    pairs = found.where("not hot").select("a", "b")
    hot = found.where("hot").select(F.col("a").alias("shard"), F.col("b").alias("node"))
    if hot.isEmpty():
        return pairs
    sizes = materialize(hot.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks")), "wide-hot")
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    dealt = hot.join(sizes, "shard").select("shard", "node", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("shard", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), "own", "node").join(nodes.select("node", "root", "f0"), "node")
    keys = ["shard", "one", "two"]
    more = dealt.repartition(*keys).sortWithinPartitions(*keys, "root").mapInPandas(compare(keys, 1 << 62, True), out)
    return pairs.unionAll(more.select("a", "b"))


def _neighbours(batches):
    """Pairs of consecutive rows of one shard with few differing first bits."""
    for pdf in batches:
        shard, node, bits = pdf["shard"].to_numpy(), pdf["node"].to_numpy(), pdf["f0"].to_numpy().view(np.uint64)
        ok = (shard[1:] == shard[:-1]) & (np.bitwise_count(bits[1:] ^ bits[:-1]) <= _FIRST_RADIUS)
        yield pd.DataFrame({"a": node[:-1][ok], "b": node[1:][ok]})


def _verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """The ``pairs`` (a, b) of nodes within ``WIDE_RADIUS`` whose texts have a similarity of 0.8 or more."""
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    for side in "ab":
        pairs = pairs.join(nodes.select(F.col("node").alias(side), *(F.col(f).alias(side + f) for f in _FPS)), side)
    away = sum((F.bit_count(F.col("a" + f).bitwiseXOR(F.col("b" + f))) for f in _FPS), F.lit(0))
    pairs = materialize(pairs.where(away <= WIDE_RADIUS).select("a", "b"), "wide-pairs")
    needed = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "h0", "h1"), "node")
    held = materialize(texts.join(needed, ["h0", "h1"]).select("node", "_text").dropDuplicates(["node"]), "wide-texts")

    def check(batches):
        at, other = None, set()
        for pdf in batches:
            keep = []
            for b, x, y in zip(pdf["b"], pdf["x"], pdf["y"]):
                if b != at:
                    at, other = b, shingle_set(y, words)
                keep.append(similar(shingle_set(x, words), other))
            yield pdf.loc[keep, ["a", "b"]]

    both = pairs.join(held.select(F.col("node").alias("a"), F.col("_text").alias("x")), "a").join(held.select(F.col("node").alias("b"), F.col("_text").alias("y")), "b")
    return materialize(both.mapInPandas(check, "a long, b long"), "wide-links")


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5) -> DataFrame:
    """One row per input row: the id and ``group_id``, the least id of its near-duplicates.

    Documents are linked if the Jaccard similarity of their sets of ``words``-word shingles is 0.8
    or more.  256-bit fingerprints of the sets only propose the pairs: shards are keyed by samples
    of bits whose number grows with the logarithm of the number of sets, and there are as many
    samples as ``WIDE_RECALL`` needs at 0.8; small sets also meet by shingle.  Neighbours in a few
    shards are verified and linked first, so that large groups don't propose all their pairs.
    Null, empty and repeated rows are treated as by :func:`simhash_components`.
    """
    longs = ["k0", "k1", *_FPS]

    @F.pandas_udf(", ".join(f"{n} long" for n in longs) + ", small array<long>")
    def wide(texts: pd.Series) -> pd.DataFrame:
        rows = [wide_fingerprint(shingle_set(t, words)) for t in texts]
        whole = np.frombuffer(b"".join(key + fp for fp, key, _ in rows), np.int64).reshape(len(rows), 6)
        return pd.DataFrame({n: whole[:, i] for i, n in enumerate(longs)}).assign(small=pd.Series([s for _, _, s in rows], dtype=object))

    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(text.alias("_text"), F.xxhash64(text).alias("h0"), F.xxhash64(F.lit(1), text).alias("h1"))
    prints = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("h0"), F.xxhash64(F.lit(1), text).alias("h1"), wide(F.col(text_col)).alias("_wide"))
    prints = materialize(prints.select("_id", "h0", "h1", "_wide.*"), "wide-prints")
    one = F.min(F.struct("h0", "h1"))
    distinct = prints.groupBy("k0", "k1").agg(F.min("_id").alias("least"), one.alias("one"), *(F.min(f).alias(f) for f in _FPS))
    distinct = distinct.select("k0", "k1", "least", "one.*", *_FPS).withColumn("node", F.monotonically_increasing_id())
    distinct = materialize(distinct, "wide-distinct")
    bits = max(12, int(distinct.count()).bit_length())
    chance = (1 - float(np.arccos(1.6 / 1.8) / np.pi)) ** bits
    tables = int(np.ceil(np.log(1 - WIDE_RECALL) / np.log1p(-chance)))
    chosen = np.stack([np.random.default_rng([11, t]).permutation(WIDE_BITS)[:bits] for t in range(tables)])

    def shards(count: int):
        @F.pandas_udf("array<long>")
        def values(f0: pd.Series, f1: pd.Series, f2: pd.Series, f3: pd.Series) -> pd.Series:
            flags = np.unpackbits(np.stack([f0, f1, f2, f3], axis=1).astype(np.int64).view(np.uint8), axis=1, bitorder="little")
            keys = np.tile(np.arange(count, dtype=np.int64), (len(f0), 1))
            for i in range(bits):
                keys = keys * 2 + flags[:, chosen[:count, i]]
            return pd.Series(list(keys), dtype=object)

        return F.explode(values(*_FPS)).alias("shard")

    first = distinct.select("node", "f0", shards(min(_FIRST_TABLES, tables))).repartition("shard").sortWithinPartitions("shard", "f0")
    linked = _verified(first.mapInPandas(_neighbours, "a long, b long"), distinct, texts, words)
    nodes = distinct.join(connected_components(linked), "node", "left").withColumn("root", F.coalesce("root", "node"))
    nodes = materialize(nodes, "wide-nodes")
    small = prints.where(F.size("small") > 0).select("k0", "k1", F.explode("small").alias("shard")).distinct().join(nodes, ["k0", "k1"])
    rows = nodes.select("node", "root", "f0", shards(tables)).unionAll(small.select("node", "root", "f0", "shard"))
    linked = linked.unionAll(_verified(_candidates(rows, nodes), nodes, texts, words))
    roots = connected_components(linked)
    owned = distinct.join(roots, "node", "left").select("k0", "k1", F.coalesce("root", "node").alias("root"), "least")
    owned = materialize(owned, "wide-roots")
    least = materialize(owned.groupBy("root").agg(F.min("least").alias("group_id")), "wide-groups")
    table = materialize(owned.join(least, "root").select("k0", "k1", "group_id"), "wide-members")
    return prints.join(table, ["k0", "k1"]).select(F.col("_id").alias(id_col), "group_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5) -> DataFrame:
    """``docs`` with all columns, but of each group of near-duplicates only the row of least id.

    Rows without an id can't be told apart and stay.
    """
    groups = near_duplicate_groups(docs, id_col, text_col, words)
    gone = groups.where(~F.col(id_col).eqNullSafe(F.col("group_id"))).select(F.col(id_col).alias("_gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")
