"""Language identification by mixture inference.

Each language has a distribution over hashed byte n-grams (1 to 3 bytes, ASCII letters
in lower case, other ASCII as one blank), learnt from labelled texts. A document is
taken as a mixture: expectation-maximisation finds the proportions of the languages
that make its n-grams most likely. Sets of the leading languages are compared by

    log-likelihood - PENALTY * (languages - 1) * ln(n-grams)

and the best set's leading language is the prediction, its proportion the score. Sets
grow as long as the next language's proportion is LEAST or more.

Learning takes about SAMPLE texts a language at most, chosen by a hash of the text, and at
least one (copies of a text are chosen together), and learns every value of the label; its table has BUCKETS 4-byte numbers a value (128 kB),
which each worker gets. Prediction reads whole texts. A null text or one without a
letter is ``und`` with score 0. Without any labelled text everything is ``und``.
Repeated rows, and rows that share an id or have none, get each their own text's
prediction; other columns may have any name. An empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Shield, map_beside

BUCKETS = 1 << 15
#: Labelled texts of a language, about; more add cost and no accuracy.
SAMPLE = 4000
#: Rounds of expectation-maximisation end when no proportion moves by more, or after so many.
SETTLED, ROUNDS = 0.002, 60
PENALTY = 8.0
#: Least proportion of a language that a set may grow by.
LEAST = 0.02
#: Entries (n-grams by languages) of the documents that are inferred at once, about.
ENTRIES = 2_000_000
_letter = re.compile(r"[^\W\d_]").search
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, count) of the text's n-grams."""
    raw = b" " + b" ".join(text.encode("utf-8", "replace").translate(_FOLD).split()) + b" "
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    two = b[:-1] << np.uint32(8) | b[1:]
    three = two[:-1] << np.uint32(8) | b[2:]
    keys = np.concatenate([b, two + np.uint32(1 << 25), three + np.uint32(1 << 26)])
    count = np.bincount((keys * np.uint32(2654435761)) >> np.uint32(17), minlength=BUCKETS)
    at = np.flatnonzero(count)
    return at, count[at]


def held_out(id_col: str) -> Column:
    """Whether a row is held out; rows without an id aren't."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def learn(df: DataFrame, text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """(languages, log p[bucket, language]) from labelled rows; at most BUCKETS numbers a language come to the driver."""
    known = df.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("l"))
    draw = F.pmod(F.xxhash64("t"), F.lit(1 << 20))
    sizes = known.groupBy("l").agg(F.count("*").alias("n"), F.min(draw).alias("least")).collect()
    if not sizes:
        return [], np.zeros((BUCKETS, 0), np.float32)
    langs = sorted(r["l"] for r in sizes)
    # at least the texts of the least draw, so that something is learnt for each label
    bound = df.sparkSession.createDataFrame([(r["l"], max(r["least"] + 1.0, (1 << 20) * sample / r["n"])) for r in sizes], "l string, below double")
    some = known.join(F.broadcast(bound), "l").where(draw < F.col("below")).select("t", "l")
    place = {name: k for k, name in enumerate(langs)}

    def run(batches):
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for t, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                at, n = features(t)
                np.add.at(counts.setdefault(lang, np.zeros(BUCKETS, np.int64)), at, n)
        for lang, c in counts.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(c[at])], names=["l", "b", "n"])

    sums = some.mapInArrow(run, "l string, b int, n bigint").groupBy("l", "b").agg(F.sum("n").alias("n"))
    c = np.full((BUCKETS, len(langs)), 0.5)
    got = sums.toArrow()
    c[got.column("b").to_numpy(), [place[x] for x in got.column("l").to_pylist()]] += got.column("n").to_numpy()
    return langs, np.log(c / c.sum(0)).astype(np.float32)


def mixture(p: np.ndarray, c: np.ndarray, owner: np.ndarray, starts: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """EM for many documents at once: p[feature, language], c[feature], each feature's document, documents' first features,
    starting proportions theta[document, language]. (proportions, log-likelihoods)"""
    total = np.add.reduceat(c, starts)[:, None]
    for _ in range(ROUNDS):
        m = p * theta[owner]
        m *= (c / m.sum(1))[:, None]
        new = np.add.reduceat(m, starts) / total
        moved, theta = np.abs(new - theta).max(), new
        if moved <= SETTLED:
            break
    like = np.log((p * theta[owner]).sum(1)) * c
    return theta, np.add.reduceat(like, starts)


def infer(texts: list[str], langs: list[str], logp: np.ndarray) -> list[tuple[str, float, list[str], list[float]]]:
    """(prediction, score, set, proportions) of each text."""
    out: list = [("und", 0.0, [], [])] * len(texts)
    ask = [i for i, t in enumerate(texts) if t and langs and _letter(t)]
    chunks: list[list] = []
    for i in ask:
        x = features(texts[i])
        if not chunks or len(chunks[-1]) == 128 or size + len(x[0]) * len(langs) > ENTRIES:
            chunks.append([])
            size = 0
        size += len(x[0]) * len(langs)
        chunks[-1].append((i, x))
    for chunk in chunks:
        ids, got = [i for i, _ in chunk], [x for _, x in chunk]
        sizes = np.array([len(a) for a, _ in got])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        owner = np.repeat(np.arange(len(ids)), sizes)
        at = np.concatenate([a for a, _ in got])
        c = np.concatenate([n for _, n in got]).astype(np.float64)
        lp = logp[at].astype(np.float64)
        top = lp.max(1)
        p = np.exp(lp - top[:, None])
        shift = np.add.reduceat(top * c, starts)
        n = np.add.reduceat(c, starts)
        one = np.add.reduceat(lp * c[:, None], starts)  # each language alone
        theta, _ = mixture(p, c, owner, starts, np.full((len(ids), len(langs)), 1.0 / len(langs)))
        rank = np.argsort(-theta, axis=1, kind="stable")
        rows = np.arange(len(ids))
        best_like, best_set, best_theta = one.max(1), np.ones(len(ids), int), np.zeros_like(theta)
        best_theta[rows, one.argmax(1)] = 1.0
        for size in range(2, len(langs) + 1):
            live = theta[rows, rank[:, size - 1]] >= LEAST
            if not live.any():
                break
            start = np.zeros_like(theta)
            for j in range(size):
                start[rows, rank[:, j]] = theta[rows, rank[:, j]]
            start /= start.sum(1, keepdims=True)
            own = live[owner]
            sub = np.flatnonzero(live)
            part = np.cumsum(live) - 1
            firsts = np.concatenate([[0], np.cumsum(sizes[sub])[:-1]])
            th, like = mixture(p[own], c[own], part[owner[own]], firsts, start[sub])
            value = like + shift[sub] - PENALTY * (size - 1) * np.log(n[sub])
            better = value > best_like[sub]
            best_like[sub[better]], best_set[sub[better]], best_theta[sub[better]] = value[better], size, th[better]
        for r, i in enumerate(ids):
            order = np.argsort(-best_theta[r], kind="stable")[: best_set[r]]
            shares = [float(best_theta[r, j]) for j in order]
            out[i] = (langs[order[0]], min(1.0, shares[0]), [langs[j] for j in order], shares)
    return out


def _predictor(df: DataFrame, trained: tuple[list[str], np.ndarray], text: str):
    langs, logp = trained
    sent = df.sparkSession.sparkContext.broadcast(logp)  # BUCKETS numbers a language

    def make():
        table = sent.value

        def f(batch: pa.RecordBatch):
            texts, got = batch.column(batch.schema.get_field_index(text)), []
            for at in range(0, len(texts), 512):
                got += infer(texts[at : at + 512].to_pylist(), langs, table)
            return [[g[k] for g in got] for k in range(4)]

        return f

    return make


SAID = "lang_pred string, score double, lang_set array<string>, proportions array<double>"


def predict(df: DataFrame, trained: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, lang_set, proportions) of each row's whole text."""
    at = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    return map_beside(at, _predictor(df, trained, "t"), SAID).select(F.col("id").alias(id_col), "lang_pred", "score", "lang_set", "proportions")


def in_a_language(df: DataFrame, trained: tuple[list[str], np.ndarray], least: float, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` whose leading language is a learnt one and holds a share of ``least`` or more."""
    at = Shield(df)
    said = map_beside(at.df, _predictor(df, trained, at.of[text_col]), SAID)
    return said.where((F.col("lang_pred") != "und") & (F.col("score") >= least)).select(*at.back)
