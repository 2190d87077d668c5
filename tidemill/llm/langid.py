"""Language identification by interpolated Kneser-Ney character models.

A bounded sample of labelled documents (``docs_per_lang`` for each language) is counted in
Spark; the character n-gram counts, which the sample bounds, make one model per language.
The models of some languages at a time share sorted arrays of n-gram keys (16 bits a character, so that
all letters of the sample stay apart; up to four characters) with one column of log-probabilities a
language, so one search serves them all; with many languages there are many such groups, each
built by a task of its own, and none has the n-grams of all languages.  Every whole text is scored; the language with the lowest
cross-entropy per character wins.  A second part of the sample calibrates the score and,
for each language, the cross-entropy above which a text is marked as rejected.
"""

from __future__ import annotations

import json
import pickle
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import bound_batches, discard, materialize

UNDETERMINED = "und"
_BITS = 16
_OTHER = (1 << _BITS) - 1
#: N-grams are 64-bit keys.
MOST_ORDER = 4
_CHUNK_CHARS = 1 << 20
#: Languages whose models share their arrays of n-grams.
GROUP_LANGUAGES = 16
#: Factors that a score may put on differences of cross-entropy.
SCALES = [2.0**i for i in range(-1, 8)]


@lru_cache(maxsize=4)
def _symbol_table(alphabet: str) -> np.ndarray:
    """Code point to symbol: 0 for all but letters, 1.. for the alphabet, one more for other letters."""
    known = {c: i + 1 for i, c in enumerate(alphabet)}
    table = np.zeros(0x110000, np.uint16)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            table[cp] = known.get(c) or known.get(c.lower(), _OTHER)
    return table


def _symbols(texts: list[str], alphabet: str, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts, each text after ``order - 1`` zeros, and each text's number of symbols.

    Runs of anything but letters are one separator.
    """
    lens = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    ids = _symbol_table(alphabet)[points]
    ends = np.cumsum(lens)
    keep = ids != 0
    keep[1:] |= ids[:-1] != 0
    starts = ends - lens
    keep[starts[lens > 0]] = ids[starts[lens > 0]] != 0
    total = np.concatenate([[0], np.cumsum(keep)])
    kept = total[ends] - total[starts]
    ids = ids[keep]
    out = np.zeros(len(ids) + (order - 1) * len(texts), np.uint16)
    out[np.arange(len(ids)) + np.repeat((order - 1) * np.arange(1, len(texts) + 1), kept)] = ids
    return out, kept


def _kind(order: int) -> type:
    return np.uint32 if order <= 2 else np.uint64


def _below(order: int) -> np.uint64:
    """The bits of the last ``order`` characters."""
    return np.uint64((1 << _BITS * order) - 1)


def _grams(symbols: np.ndarray, order: int) -> np.ndarray:
    """The hash of the n-gram that ends at each position from ``order - 1`` on."""
    kind = _kind(order)
    n = len(symbols) - order + 1
    code = np.zeros(max(n, 0), kind)
    for i in range(order):
        code <<= kind(_BITS)
        code |= symbols[i : i + n]
    return code


def _positions(kept: np.ndarray, order: int) -> np.ndarray:
    """Index into :func:`_grams` of each symbol of each text."""
    return np.arange(int(kept.sum())) + np.repeat((order - 1) * np.arange(len(kept)), kept)


def _chunks(texts: list[str]):
    """(first, last) of runs of texts of about a million characters."""
    first = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > _CHUNK_CHARS:
            yield first, i
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield first, len(texts)


class LanguageModels:
    """Kneser-Ney models of several languages over shared sorted n-gram arrays."""

    def __init__(self, languages: list[str], alphabet: str, order: int, codes: np.ndarray, counts: np.ndarray):
        """``codes``: sorted distinct n-grams; ``counts``: their counts, one column a language."""
        self.languages, self.alphabet, self.order = languages, alphabet, order
        grams, cnts = {order: codes.astype(np.uint64)}, {order: counts.astype(np.float64)}
        for k in range(order - 1, 0, -1):  # continuation counts: how many symbols come before
            lower, at = np.unique(grams[k + 1] & _below(k), return_inverse=True)
            seen = np.zeros((len(lower), len(languages)))
            np.add.at(seen, at, cnts[k + 1] > 0)
            grams[k], cnts[k] = lower, seen
        every = np.unique(np.concatenate([grams[1], np.arange(len(alphabet) + 1, dtype=np.uint64), [np.uint64(_OTHER)]]))
        seen = np.zeros((len(every), len(languages)))
        seen[np.searchsorted(every, grams[1])] = cnts[1]
        grams[1], cnts[1] = every, seen
        self.keys, self.logp, self.contexts, self.backoff = {}, {}, {}, {}
        below = np.full((1, len(languages)), 1.0 / len(every))
        for k in range(1, order + 1):
            c = cnts[k]
            ones, twos = (c == 1).sum(0), (c == 2).sum(0)
            discount = np.where(ones > 0, ones / np.maximum(ones + 2 * twos, 1), 0.5)
            discount = np.clip(discount, 0.05, 0.95)
            contexts, at = np.unique(grams[k] >> np.uint64(_BITS), return_inverse=True)
            total, kinds = np.zeros((len(contexts), len(languages))), np.zeros((len(contexts), len(languages)))
            np.add.at(total, at, c)
            np.add.at(kinds, at, c > 0)
            gamma = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
            if k == 1:
                lower = np.broadcast_to(below, c.shape)
            else:
                lower = below[np.searchsorted(grams[k - 1], grams[k] & _below(k - 1))]
            below = np.where(total[at] > 0, np.maximum(c - discount, 0) / np.maximum(total[at], 1), 0) + gamma[at] * lower
            self.keys[k], self.logp[k] = grams[k].astype(_kind(k)), np.log(below).astype(np.float32)
            self.contexts[k], self.backoff[k] = contexts, np.log(gamma).astype(np.float32)

    def log_probabilities(self, codes: np.ndarray, k: int) -> np.ndarray:
        """Natural logarithms for k-grams, one column a language."""
        keys = self.keys[k]
        if not len(keys):  # languages that the sample has no text of
            return self.log_probabilities((codes.astype(np.uint64) & _below(k - 1)).astype(_kind(k - 1)), k - 1)
        at = np.minimum(np.searchsorted(keys, codes), len(keys) - 1)
        out = self.logp[k][at]
        miss = np.flatnonzero(keys[at] != codes)
        if len(miss):
            rest = codes[miss].astype(np.uint64)
            contexts = self.contexts[k]
            at = np.minimum(np.searchsorted(contexts, rest >> np.uint64(_BITS)), len(contexts) - 1)
            gamma = np.where((contexts[at] == rest >> np.uint64(_BITS))[:, None], self.backoff[k][at], 0)
            lower = (rest & _below(k - 1)).astype(_kind(k - 1))
            out[miss] = gamma + self.log_probabilities(lower, k - 1)
        return out


class GroupedModels:
    """The models of all languages, in groups; languages are in order."""

    def __init__(self, parts: list[LanguageModels]):
        self.parts = parts
        self.languages = [x for p in parts for x in p.languages]

    def cross_entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Mean negative log2-probability a symbol, one column a language; and which texts have a letter."""
        alphabet, order = self.parts[0].alphabet, self.parts[0].order
        sums, sizes = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64)
        letters = np.zeros(len(texts), bool)
        for first, last in _chunks(texts):
            symbols, kept = _symbols(texts[first:last], alphabet, order)
            codes = _grams(symbols, order)[_positions(kept, order)]
            owner = np.repeat(np.arange(first, last), kept)
            sizes[first:last] = kept
            letters[first:last] = kept > 0  # a separator stays only after a letter
            for i in range(0, len(codes), _CHUNK_CHARS // 4):
                own = owner[i : i + _CHUNK_CHARS // 4]
                heads = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                at = 0
                for part in self.parts:
                    logp = part.log_probabilities(codes[i : i + _CHUNK_CHARS // 4], order)
                    sums[own[heads], at : at + len(part.languages)] += np.add.reduceat(logp, heads, axis=0, dtype=np.float64)
                    at += len(part.languages)
        return -sums / np.maximum(sizes, 1)[:, None] / np.log(2), letters


def _alphabet(sample: DataFrame) -> str:
    """The letters of the sample, lower-cased, commonest first; Unicode bounds their number."""
    letters = sample.select(F.explode(F.split(F.lower("_text"), "")).alias("c")).groupBy("c").count()
    top = letters.where(F.length("c") == 1).orderBy(F.desc("count"), "c").limit(2 * _OTHER).collect()
    return "".join([r["c"] for r in top if r["c"].isalpha()][: _OTHER - 1])


def train(labelled: DataFrame, docs_per_lang: int = 600, order: int = 4) -> dict:
    """Models from ``labelled`` (_key, _text, _lang), with the calibration of score and rejection.

    About ``docs_per_lang`` documents of each language are taken by a hash of ``_key``; a
    quarter of them calibrates.  Null texts and languages teach nothing.
    """
    if not 1 <= order <= MOST_ORDER:
        raise ValueError(f"the order is 1 to {MOST_ORDER}")
    spark = labelled.sparkSession
    labelled = labelled.where("_lang is not null and _text is not null and _key is not null")
    sizes = {r["_lang"]: r["count"] for r in labelled.groupBy("_lang").count().collect()}
    unit = F.pmod(F.xxhash64(F.col("_key").cast("string")), F.lit(1_000_003)) / 1_000_003
    shares = F.from_json(F.lit(json.dumps({k: docs_per_lang / n for k, n in sizes.items()})), "map<string,double>")
    sample = labelled.where(unit < F.element_at(shares, F.col("_lang"))) if sizes else labelled
    sample = materialize(sample.select("_text", "_lang", (F.crc32(F.concat(F.lit("calibrate"), F.col("_key").cast("string"))) % 4 == 0).alias("_held")), "langid-sample")
    counted, held = sample.where("not _held"), sample.where("_held")
    languages = [r["_lang"] for r in sample.select("_lang").distinct().orderBy("_lang").collect()]
    if not languages:
        discard(sample)
        return {"models": None, "scale": 1.0, "limits": []}
    alphabet = _alphabet(counted)

    def count(batches):
        for pdf in batches:
            for lang, part in pdf.groupby("_lang"):
                texts = part["_text"].tolist()
                for first, last in _chunks(texts):
                    symbols, kept = _symbols(texts[first:last], alphabet, order)
                    codes, n = np.unique(_grams(symbols, order)[_positions(kept, order)], return_counts=True)
                    yield pd.DataFrame({"lang": lang, "code": codes.astype(np.int64), "n": n})

    group = {x: i // GROUP_LANGUAGES for i, x in enumerate(languages)}
    members = [languages[i : i + GROUP_LANGUAGES] for i in range(0, len(languages), GROUP_LANGUAGES)]

    def build(key: tuple, table: pd.DataFrame) -> pd.DataFrame:
        own = members[key[0]]
        codes, at = np.unique(table["code"].to_numpy(np.int64).astype(np.uint64), return_inverse=True)
        counts = np.zeros((len(codes), len(own)))
        counts[at, table["lang"].map({x: i for i, x in enumerate(own)})] = table["n"]
        return pd.DataFrame({"part": [key[0]], "model": [pickle.dumps(LanguageModels(own, alphabet, order, codes, counts))]})

    number = F.element_at(F.from_json(F.lit(json.dumps(group)), "map<string,int>"), F.col("lang"))
    table = counted.mapInPandas(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    built = {r["part"]: r["model"] for r in table.withColumn("part", number).groupBy("part").applyInPandas(build, "part int, model binary").collect()}
    nothing = (np.zeros(0, np.uint64), lambda own: np.zeros((0, len(own))))  # languages of which the sample has no letter
    models = GroupedModels([pickle.loads(built[i]) if i in built else LanguageModels(own, alphabet, order, nothing[0], nothing[1](own)) for i, own in enumerate(members)])
    shared = spark.sparkContext.broadcast(models)
    place = {x: i for i, x in enumerate(languages)}

    def measure(batches):
        for pdf in batches:
            bits, letters = shared.value.cross_entropies(pdf["_text"].tolist())
            own = bits[np.arange(len(bits)), pdf["_lang"].map(place)]
            low = bits.min(1)
            loss = [np.log(np.exp(-s * (bits - low[:, None])).sum(1)) + s * (own - low) for s in SCALES]
            yield pd.DataFrame({"lang": pdf["_lang"], "own": own, "loss": list(np.stack(loss, axis=1))})[letters]

    got = held.mapInPandas(measure, "lang string, own double, loss array<double>").toPandas()
    scale, limits = 8.0, np.full(len(languages), np.inf)
    if len(got):
        scale = SCALES[int(np.stack(got["loss"]).mean(0).argmin())]
        for lang, own in got.groupby("lang")["own"]:
            limits[place[lang]] = np.quantile(own, 0.99) + 3 * own.std(ddof=0)
    discard(sample)
    return {"models": shared, "scale": scale, "limits": limits.tolist()}


def identify(docs: DataFrame, text: Column, carry: list[str], trained: dict) -> DataFrame:
    """The columns ``carry`` of ``docs`` with ``lang_pred``, ``score``, ``bits_per_char``, ``rejected``.

    A text that is null or has no letter gets ``und`` with score 0 and null bits, and is
    rejected; so does every text if nothing could be learned.  Ties go to the language that
    sorts first.
    """
    bound_batches(docs.sparkSession)
    shared, scale, limits = trained["models"], trained["scale"], np.array(trained["limits"])
    picked = docs.select(*carry, text.alias("_text"))
    if shared is None:
        return picked.select(*carry, F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("bits_per_char"), F.lit(True).alias("rejected"))

    @F.pandas_udf("lang_pred string, score double, bits_per_char double, rejected boolean")
    def predict(texts: pd.Series) -> pd.DataFrame:
        models = shared.value
        bits, letters = models.cross_entropies([t or "" for t in texts])
        best = bits.argmin(1)
        low = bits[np.arange(len(bits)), best]
        score = 1 / np.exp(-scale * (bits - low[:, None])).sum(1)
        return pd.DataFrame({
            "lang_pred": np.where(letters, np.array(models.languages, object)[best], UNDETERMINED),
            "score": np.where(letters, score, 0.0),
            "bits_per_char": [float(b) if ok else None for b, ok in zip(low, letters)],
            "rejected": ~letters | (low > limits[best]),
        })

    found = picked.select(*carry, predict("_text").alias("_found"))
    return found.select(*carry, "_found.*")
