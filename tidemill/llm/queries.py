"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import ann, exactdedup, langid, linededup, merkle, mixing, negatives, pii, quality, simhash, spm, suffixdedup, topk


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality.train(docs), score_col="score", label_col="weak_label")
    return scored.select("doc_id", "score", "weak_label", (F.col("score") >= 0.5).alias("kept"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    docs = docs.withColumn("held_out", held_out)
    labelled = docs.where(~F.col("held_out")).select(F.col("doc_id").alias("_key"), F.col("text").alias("_text"), F.col("lang").alias("_lang"))
    return langid.identify(docs, F.col("text"), ["doc_id", "held_out"], langid.train(labelled))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = linededup.drop_repeated_lines(docs, counts=True)
    return found.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


#: The public 32,000-piece model; give another path to use another one.
PIECES = os.environ.get("SENTENCEPIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


def token_digests(docs: DataFrame, model: str = PIECES) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the comma-joined ids) and whether decoding gives the text back."""
    encoded = spm.encode_documents(docs.select("doc_id", "text"), spm.Vocabulary.load(model), check_col="round_trip")
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        "round_trip",
    )


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(_table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(_table(spark, sf_dir, "documents"))


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op7_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(_table(spark, sf_dir, "documents"), words=3, radius=2)


#: Target shares of the mixture query.  Sources beyond these keep their totals.
SOURCE_SHARES = {"src0": 0.10} | {f"src{i}": 0.90 / 19 for i in range(1, 20)}
LANG_SHARES = {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}
TOPIC_SHARES = {"contact": 0.05, "table": 0.02, "licence": 0.08, "short": 0.05, "prose": 0.8}
TOPIC = """CASE WHEN text LIKE '%@%' THEN 'contact' WHEN text LIKE '%| %' THEN 'table'
    WHEN text LIKE '%icense%' THEN 'licence' WHEN length(text) < 400 THEN 'short' ELSE 'prose' END"""
WORDS = "length(text) - length(replace(text, ' ', '')) + 1"
MIX_ROUNDS = 60


def mix(docs: DataFrame, share: float, **options) -> DataFrame:
    """The mixture of the registered query: words by source, language and topic."""
    parts = [F.col("source"), F.col("lang"), F.expr(TOPIC)]
    return mixing.sample_mixture(docs, parts, [SOURCE_SHARES, LANG_SHARES, TOPIC_SHARES], F.expr(WORDS), share, rounds=MIX_ROUNDS, **options)


def op8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    found = mix(docs, 0.5, chance_col="chance")
    return found.select("doc_id", "source", "lang", F.expr(TOPIC).alias("topic"), F.round("chance", 6).alias("chance"), "sampled")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.exact_duplicates(_table(spark, sf_dir, "documents"), keep="max")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixdedup.remove_repeats(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_impact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


_LEAF = ["doc_id", "source", "lang", "n_chars", "text"]


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(*_LEAF)
    tampered = merkle.leaf_digest([F.replace(F.col(c), F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in _LEAF])
    chosen = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, tampered)
    found = merkle.manifest(docs, _LEAF, also={"tampered": chosen})
    found = found.withColumn("folded_root", merkle.fold(F.coalesce("tampered", "leaf"), F.col("path")))
    proof = F.sha2(merkle.siblings(F.col("path")), 256)
    return found.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")
    return negatives.hard_negatives(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label_col=label)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_quality, op2_language_id, op3_line_dedup, op4_sentencepiece, op5_pii, op6_ann, op7_simhash_neardup, op8_mixture, op9_exact_dedup, op10_suffix_dedup)
    found += (op11_impact_topk, op12_merkle_manifest, op13_hard_negatives)
    return {f.__name__: f for f in found}


_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _values(shares: dict[str, float]) -> str:
    return ", ".join(f"('{k}', {v!r}::DOUBLE)" for k, v in shares.items())


def _goal(part: str, shares: dict[str, float]) -> str:
    """The goals of one marginal: its value, and the total that raking aims at."""
    return f"""
        {part}_have AS (SELECT {part}, sum(size) AS have FROM cells GROUP BY {part}),
        {part}_goal AS (
            SELECT h.{part}, s.share * (SELECT sum(have) FROM {part}_have h2 WHERE h2.{part} IN (SELECT v FROM {part}_shares))
                / sum(s.share) OVER () AS goal
            FROM {part}_have h JOIN {part}_shares s ON h.{part} = s.v),"""


def _scaled(inner: str, old: str, new: str, part: str) -> str:
    return f"SELECT t.*, t.{old} * coalesce(g.goal / sum(t.size * t.{old}) OVER (PARTITION BY t.{part}), 1) AS {new} FROM ({inner}) t LEFT JOIN {part}_goal g ON t.{part} = g.{part}"


def _mixture_sql(share: float) -> str:
    marginals = {"source": SOURCE_SHARES, "lang": LANG_SHARES, "topic": TOPIC_SHARES}
    step = f"SELECT i, source, lang, topic, size, w FROM raked WHERE i < {MIX_ROUNDS}"
    for n, part in enumerate(marginals):
        step = _scaled(step, "w" if n == 0 else f"w{n}", f"w{n + 1}", part)
    return f"""
        WITH RECURSIVE docs AS (SELECT doc_id, source, lang, {TOPIC} AS topic, ({WORDS})::DOUBLE AS size FROM documents),
        cells AS (SELECT source, lang, topic, sum(size) AS size FROM docs GROUP BY ALL),
        {" ".join(f"{p}_shares(v, share) AS (VALUES {_values(s)})," for p, s in marginals.items())}
        {"".join(_goal(p, s) for p, s in marginals.items())}
        raked AS (
            SELECT 0 AS i, source, lang, topic, size, 1.0::DOUBLE AS w FROM cells
            UNION ALL
            SELECT i + 1, source, lang, topic, size, w3 FROM ({step})),
        done AS (SELECT * FROM raked WHERE i = {MIX_ROUNDS}),
        ranked AS (
            SELECT *, coalesce(sum(size) OVER (ORDER BY w DESC, source, lang, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
                sum(size * w) OVER (ORDER BY w DESC, source, lang, topic ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
            FROM done),
        factors AS (SELECT *, ({share!r} * (SELECT sum(size) FROM cells) - before) / rest AS factor FROM ranked),
        chosen AS (SELECT max(w) AS top FROM factors WHERE factor * w < 1),
        chances AS (
            SELECT source, lang, topic, CASE WHEN w > (SELECT top FROM chosen) THEN 1.0
                ELSE w * (SELECT max(factor) FROM factors WHERE w = (SELECT top FROM chosen)) END AS chance
            FROM done)
        SELECT d.doc_id, d.source, d.lang, d.topic, round(c.chance, 6) AS chance,
            ('0x' || substr(md5(d.doc_id::VARCHAR), 1, 8))::BIGINT / 4294967296.0 < c.chance AS sampled
        FROM docs d JOIN chances c ON d.source IS NOT DISTINCT FROM c.source AND d.lang IS NOT DISTINCT FROM c.lang AND d.topic = c.topic
    """


#: Vectors as integers, without those that hold null or a component that isn't finite.
_WHOLE = """whole AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::HUGEINT) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)"""
_PRODUCT = "coalesce(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])), 0)::BIGINT"

_TOP_SQL = f"""
    WITH {_WHOLE},
    scored AS (SELECT a.vec_id AS query_id, b.vec_id, {_PRODUCT} AS score FROM whole a JOIN whole b ON a.vec_id % 50 = 0 AND b.vec_id <> a.vec_id AND len(a.v) = len(b.v))
    SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM scored QUALIFY rank <= 5
"""

_NEGATIVES_SQL = f"""
    WITH {_WHOLE},
    labelled AS (SELECT vec_id, v, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label FROM whole WHERE label IS NOT NULL),
    scored AS MATERIALIZED (
        SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, {_PRODUCT} AS score
        FROM labelled a JOIN labelled b ON a.vec_id % 100 = 0 AND b.vec_id <> a.vec_id AND len(a.v) = len(b.v)),
    positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
    SELECT p.anchor_id, p.positive_id, (row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id))::INTEGER AS rank,
        s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
    FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
    QUALIFY rank <= 10
"""


_FIELDS = " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR END" for c in _LEAF)
#: The unsigned CRC-32 of the decimal doc_id, bit by bit.
_CRC = """(list_reduce(flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: list_transform(range(8), lambda i: (ascii(c) >> i) & 1))),
    lambda a, b: xor(a >> 1, 3988292384 * (xor(a, b) & 1)), 4294967295))"""

_MERKLE_SQL = f"""
    WITH RECURSIVE leaves AS MATERIALIZED (
        SELECT doc_id, source, coalesce('=' || source, '') AS part, sha256({_FIELDS}) AS leaf,
            CASE WHEN doc_id IS NOT NULL AND xor({_CRC}, 4294967295) % 2 = 0 THEN sha256({_FIELDS.replace("text", "replace(text, chr(10), '')")}) END AS tampered,
            row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST) - 1 AS pos, count(*) OVER (PARTITION BY source) AS size
        FROM documents),
    nodes(height, part, pos, size, digest) AS (
        SELECT 0, part, pos, size, leaf FROM leaves
        UNION ALL
        SELECT height + 1, part, pos // 3, (size + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM nodes WHERE size > 1
        GROUP BY height, part, pos // 3, size),
    subroots AS MATERIALIZED (
        SELECT part, height, digest AS subroot, row_number() OVER (ORDER BY encode(part)) - 1 AS place, count(*) OVER () AS size FROM nodes WHERE size = 1),
    tops(height, pos, size, digest) AS (
        SELECT 0, place, size, subroot FROM subroots
        UNION ALL
        SELECT height + 1, pos // 3, (size + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM tops WHERE size > 1
        GROUP BY height, pos // 3, size),
    members AS MATERIALIZED (SELECT height, part, pos, digest FROM nodes WHERE size > 1 UNION ALL SELECT height, 'top' AS part, pos, digest FROM tops WHERE size > 1),
    steps AS MATERIALIZED (
        SELECT b.height, b.part, b.pos, coalesce(string_agg(o.digest, '' ORDER BY o.pos) FILTER (o.pos < b.pos), '') AS before,
            coalesce(string_agg(o.digest, '' ORDER BY o.pos) FILTER (o.pos > b.pos), '') AS after
        FROM members b JOIN members o ON b.height = o.height AND b.part = o.part AND b.pos // 3 = o.pos // 3
        GROUP BY b.height, b.part, b.pos),
    walk(doc_id, own, height, part, pos, proof, folded) AS (
        SELECT doc_id, pos, 0, part, pos, '', coalesce(tampered, leaf) FROM leaves
        UNION ALL
        SELECT w.doc_id, w.own, w.height + 1, w.part, w.pos // 3, w.proof || s.before || s.after, sha256(s.before || w.folded || s.after)
        FROM walk w JOIN steps s ON s.height = w.height AND s.part = w.part AND s.pos = w.pos),
    climb(doc_id, part, own, height, pos, proof, folded) AS (
        SELECT w.doc_id, w.part, w.own, 0, r.place, w.proof, w.folded FROM walk w JOIN subroots r ON r.part = w.part AND r.height = w.height
        UNION ALL
        SELECT c.doc_id, c.part, c.own, c.height + 1, c.pos // 3, c.proof || s.before || s.after, sha256(s.before || c.folded || s.after)
        FROM climb c JOIN steps s ON s.height = c.height AND s.part = 'top' AND s.pos = c.pos),
    root AS (SELECT height, digest AS root FROM tops WHERE size = 1)
    SELECT l.doc_id, l.leaf, r.subroot, root.root, sha256(c.proof) AS proof_sha256, c.folded AS folded_root, c.folded = root.root AS verified
    FROM leaves l JOIN subroots r ON r.part = l.part JOIN climb c ON c.part = l.part AND c.own = l.pos JOIN root ON root.height = c.height
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op12_merkle_manifest": _MERKLE_SQL,
        "op11_impact_topk": _TOP_SQL,
        "op13_hard_negatives": _NEGATIVES_SQL,
        "op8_mixture": _mixture_sql(0.5),
        "op9_exact_dedup": f"""
            WITH t AS (SELECT doc_id, {_FOLD} AS body FROM documents),
                 g AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY body)
            SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.body) AS text_sha256
            FROM t JOIN g ON t.body = g.body
        """,
    }
