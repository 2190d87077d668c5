"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or abstain on every document.  The counts of
vote patterns over all documents (their number is bounded by the number of labellers) go
through expectation-maximisation, which estimates each labeller's accuracy and gives every
pattern a posterior.  Posterior labels of a bounded sample (``sample_docs``) train a hashed
linear scorer, which then scores every whole text.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm.common import bound_batches, in_slices, text_slices

BUCKETS = 1024
BAD, GOOD, ABSTAIN = 0, 1, 2

_SPACE, _LOWER, _UPPER, _DIGIT, _STOP, _COMMA, _MARK, _LOUD, _BAR, _LINE, _SYMBOL, _CONTROL = range(12)


def _classes() -> np.ndarray:
    table = np.full(256, _CONTROL, np.uint8)
    table[0x80:] = _LOWER  # all bytes of letters outside ASCII
    for chars, kind in ((" \r", _SPACE), (".?", _STOP), (",", _COMMA), (";:'\"()-", _MARK), ("!", _LOUD), ("|\t", _BAR), ("\n", _LINE), ("#$%&*+=<>@^_~\\/{}[]`", _SYMBOL)):
        table[[ord(c) for c in chars]] = kind
    table[ord("0") : ord("9") + 1] = _DIGIT
    table[ord("a") : ord("z") + 1] = _LOWER
    table[ord("A") : ord("Z") + 1] = _UPPER
    return table


_CLASS = _classes()

#: Name of a statistic, where a vote for bad begins and where one for good; below or above by their order.
LABELLERS = (
    ("words", 0.5, 19.5),
    ("bars", 0.2, 0.02),
    ("symbols", 0.08, 0.01),
    ("capitals", 0.5, 0.2),
    ("repeats", 0.2, 0.05),
    ("top_share", 0.4, 0.2),
    ("loud", 0.3, 0.03),
    ("stops", 0.005, 0.03),
    ("letters", 0.8, 0.9),
    ("odd_ends", 0.3, 0.05),
    ("pairs", 0.35, 0.6),
)
#: Statistics of shares say nothing below this number of words.
_LEAST_WORDS = 15


def statistics(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(statistics, hashed n-gram counts of character classes), a row for each text."""
    sizes = np.array([len(t) for t in texts], np.int64)
    data = _CLASS[np.frombuffer(b"".join(texts), np.uint8)]
    owner = np.repeat(np.arange(len(texts)), sizes)
    counts = np.bincount(owner * 16 + data, minlength=16 * len(texts)).reshape(-1, 16).astype(np.float64)
    stats = np.zeros((len(texts), len(LABELLERS)))
    for i, t in enumerate(texts):
        words = t.split()
        n = len(words)
        stats[i, 0] = n
        if n:
            tally = {}
            for w in words:
                tally[w] = tally.get(w, 0) + 1
            stats[i, 4] = sum(map(bytes.__eq__, words, words[1:])) / n
            stats[i, 5] = max(tally.values()) / n
            stats[i, 10] = len(set(zip(words, words[1:]))) / max(n - 1, 1)
    words, size = np.maximum(stats[:, 0], 1), np.maximum(sizes, 1)
    letters = counts[:, _LOWER] + counts[:, _UPPER]
    stats[:, 1] = counts[:, _BAR] / words
    stats[:, 2] = counts[:, _SYMBOL] / size
    stats[:, 3] = counts[:, _UPPER] / np.maximum(letters, 1)
    stats[:, 6] = counts[:, _LOUD] / words
    stats[:, 7] = counts[:, _STOP] / words
    stats[:, 8] = letters / np.maximum(size - counts[:, _SPACE] - counts[:, _LINE], 1)
    odd = (data == _LOUD) | (data == _BAR) | (data == _SYMBOL)
    last = np.append((data[1:] == _SPACE) | (data[1:] == _LINE) | (owner[1:] != owner[:-1]), True)[: len(data)]
    stats[:, 9] = np.bincount(owner[odd & last], minlength=len(texts)) / words
    # runs of a class count once, of rarer classes twice
    keep = np.ones(len(data), bool)
    keep[1:] = (data[1:] != data[:-1]) | (owner[1:] != owner[:-1])
    keep[2:] |= (data[2:] >= _LOUD) & (data[2:] != data[:-2])
    data, owner = data[keep].astype(np.uint32), owner[keep]
    grams = np.zeros((len(texts), BUCKETS), np.float32)
    if len(data) > 3:
        code = data[3:] | data[2:-1] << 4 | data[1:-2] << 8 | data[:-3] << 12
        inside = owner[3:] == owner[:-3]
        bucket = (code[inside] * np.uint32(2654435761) >> np.uint32(22)).astype(np.int64)
        grams += np.bincount(owner[3:][inside] * BUCKETS + bucket, minlength=grams.size).reshape(grams.shape)
    return stats, grams


def votes(stats: np.ndarray) -> np.ndarray:
    """The vote of each labeller for each row of statistics."""
    out = np.full(stats.shape, ABSTAIN)
    for k, (_, bad, good) in enumerate(LABELLERS):
        up = good > bad
        out[(stats[:, k] >= good) if up else (stats[:, k] <= good), k] = GOOD
        out[(stats[:, k] <= bad) if up else (stats[:, k] >= bad), k] = BAD
    few = stats[:, 0] < _LEAST_WORDS
    out[few, 1:] = ABSTAIN
    return out


_BASE = 3 ** np.arange(len(LABELLERS))


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> dict:
    """Expectation-maximisation over vote patterns: prior of good, vote probabilities, posterior of each pattern.

    A labeller's votes depend on the class alone, and an abstention tells nothing.  It starts
    from patterns with any vote for bad being bad, as labellers look for different faults;
    that also settles which class is the good one.
    """
    given = patterns[:, None] // _BASE % 3
    posterior = np.where((given == BAD).any(1), 0.1, 0.95)
    onehot = np.stack([given == v for v in (BAD, GOOD)], axis=2).astype(np.float64)
    for _ in range(rounds):
        weight = np.stack([1 - posterior, posterior]) * counts
        prior = (weight.sum(1) + 1) / (weight.sum() + 2)
        table = np.einsum("cp,plv->clv", weight, onehot) + 0.5
        table /= table.sum(2, keepdims=True)
        log = np.log(prior)[:, None] + np.einsum("plv,clv->cp", onehot, np.log(table))
        posterior = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
    return {"prior": float(prior[1]), "table": table, "posterior": posterior}


def features(stats: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Hashed features: square roots of n-gram shares, and a bucket for each statistic's range."""
    out = np.sqrt(grams / np.maximum(grams.sum(1, keepdims=True), 1))
    for k in range(1, stats.shape[1]):
        level = np.minimum(stats[:, k] * 12, 11).astype(np.int64)
        slot = ((level * 31 + k * 977 + 1) * 2654435761 >> 11) % BUCKETS
        out[np.arange(len(out)), slot] += np.float32(0.5)
    return out


def fit_scorer(x: np.ndarray, target: np.ndarray, rounds: int = 300, decay: float = 1e-5) -> np.ndarray:
    """Weights (bias last) of logistic regression on soft targets."""
    x = np.concatenate([x, np.ones((len(x), 1), np.float32)], axis=1)
    target = target.astype(np.float32)  # doubles would convert all of x in each round
    w, m, v = (np.zeros(x.shape[1]) for _ in range(3))
    for i in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-(x @ w.astype(np.float32))))
        g = x.T @ (p - target) / len(x) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-8)
    return w


def _raw(texts) -> list[bytes]:
    return [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]


def train(docs: DataFrame, text_col: str = "text", sample_docs: int = 6000) -> dict:
    """The weak-label model over all documents and the scorer: ``prior``, ``table``, ``weights``.

    About ``sample_docs`` documents, taken by a hash of the text, train the scorer.
    """
    bound_batches(docs.sparkSession)
    total = docs.count()
    text = F.coalesce(F.col(text_col), F.lit(""))
    share = min(1.0, sample_docs / max(total, 1))
    chosen = F.pmod(F.xxhash64(F.lit("sample"), text), F.lit(1 << 20)) < int(share * (1 << 20))
    schema = "pattern int, n long, row binary"

    def work(frames):
        tally = np.zeros(3 ** len(LABELLERS), np.int64)
        for pdf in frames:
            stats, grams = statistics(_raw(pdf["text"]))
            pattern = votes(stats) @ _BASE
            tally += np.bincount(pattern, minlength=len(tally))
            some = np.flatnonzero(pdf["chosen"])
            if len(some):
                rows = features(stats[some], grams[some]).astype(np.float16)
                yield pd.DataFrame({"pattern": pattern[some], "n": 0, "row": [r.tobytes() for r in rows]})
        at = np.flatnonzero(tally)
        yield pd.DataFrame({"pattern": at, "n": tally[at], "row": None})

    found = docs.select(text.alias("text"), chosen.alias("chosen")).mapInArrow(in_slices(work, schema, "text", 1 << 20), schema)
    # every task gives each pattern once and the sampled rows, so this stays small
    rows = found.groupBy("pattern", "row").agg(F.sum("n").alias("n")).toPandas()
    tallies, sample = rows[rows["row"].isna()], rows[rows["row"].notna()]
    if tallies.empty:
        return {"prior": 0.5, "table": None, "weights": np.zeros(BUCKETS + 1), "posterior": np.full(3 ** len(LABELLERS), 0.5)}
    tallies = tallies.sort_values("pattern")
    model = estimate(tallies["pattern"].to_numpy(), tallies["n"].to_numpy(np.float64))
    posterior = np.full(3 ** len(LABELLERS), model["prior"])
    posterior[tallies["pattern"].to_numpy()] = model["posterior"]
    sample = sample.sort_values("row")
    x = np.array([np.frombuffer(r, np.float16) for r in sample["row"]], np.float32).reshape(-1, BUCKETS)
    return {"prior": model["prior"], "table": model["table"], "weights": fit_scorer(x, posterior[sample["pattern"].to_numpy()]), "posterior": posterior}


def score(docs: DataFrame, model: dict, text_col: str = "text", score_col: str = "quality", label_col: str | None = None) -> DataFrame:
    """``docs`` with the probability that each whole text is good, and if asked its weak label.

    Null and blank texts score 0.  Repeated rows stay, and columns of these names are replaced.
    """
    bound_batches(docs.sparkSession)
    weights, posterior = model["weights"].astype(np.float32), model["posterior"]
    docs = docs.drop(score_col, *([label_col] if label_col else []))
    schema = T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())])
    if label_col:
        schema.add(label_col, T.DoubleType())

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for batch in text_slices(whole, text_col, 1 << 20):
                stats, grams = statistics(_raw(batch.column(batch.schema.get_field_index(text_col)).to_pylist()))
                z = (features(stats, grams) @ weights[:-1] + weights[-1]).astype(np.float64)
                columns, names = [*batch.columns, pa.array(np.where(stats[:, 0] > 0, 1 / (1 + np.exp(-z)), 0.0))], [*batch.schema.names, score_col]
                if label_col:
                    columns.append(pa.array(np.where(stats[:, 0] > 0, posterior[votes(stats) @ _BASE], 0.0)))
                    names.append(label_col)
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, schema)
