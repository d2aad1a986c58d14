"""Language identification by error-correcting output codes.

Every language gets a codeword of bits. For each bit one binary classifier is
learned, a naive Bayes model over hashed byte trigrams that tells the languages
whose bit is set from the others, each language weighing the same. A text's trigram
weights, averaged, give a margin for each bit; the language whose codeword has the
least loss wins, where a bit counts by how well its classifier separates the
languages. A text is ambiguous if the second-best is close.

Learning is counting: all training texts are counted where they lie, and counts
are added up and turned into weights by Spark; what reaches the driver is the model,
of 65,536 buckets by the number of bits, however large the corpus is.

Texts are lower-cased; ASCII other than letters is blank. A null text, or one
without a letter, is `und` with score 0, and so is every text if nothing was learned.
Rows with a null label teach nothing. Output columns replace input columns of the
same name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthstat.llm.staging import stage
from hearthstat.llm.texts import slices

BUCKETS = 1 << 16
#: The most languages that can be told apart; bounds the model.
MAX_LANGUAGES = 1024
#: Added to every count.
SMOOTH = 0.5
#: How sharply losses turn into scores, and the score below which a text is ambiguous.
SHARP, SURE = 8.0, 0.8

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = [c if chr(c).isalpha() else 32 for c in range(128)]


def trigrams(data: np.ndarray) -> np.ndarray:
    """The bucket of the trigram that starts at each byte but the last two; -1 for three blanks."""
    x = _FOLD[data].astype(np.uint32)
    grams = x[:-2] << np.uint32(16) | x[1:-1] << np.uint32(8) | x[2:]
    out = ((grams * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int32)
    out[grams == 0x202020] = -1
    return out


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n rows of +-1: all ways to split up to 4 languages, else the best of random codes."""
    if n <= 4:
        splits = np.arange(1, 1 << max(n - 1, 0))
        return np.where((splits[None, :] >> np.arange(n)[:, None]) & 1, 1, -1).astype(np.int8)
    bits = max(15, int(np.ceil(10 * np.log2(n))))
    best, least = None, -1
    rng = np.random.default_rng(seed)
    for _ in range(200 if n <= 64 else 10):
        code = rng.choice(np.array([-1, 1], np.int8), (n, bits))
        code[0, np.abs(code.sum(0)) == n] *= -1
        apart = code.astype(np.int32) @ code.T
        np.fill_diagonal(apart, -bits)
        if (distance := (bits - apart.max()) // 2) > least:
            best, least = code, distance
    return best


def _padded(text: Column) -> Column:
    return F.concat(F.lit(" "), F.lower(F.coalesce(text, F.lit(""))), F.lit(" "))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigrams of a task's texts by language, added up before anything is shuffled."""
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for begin, _, data, offsets in slices(batch.column(1)):
            grams = trigrams(data)
            for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                own = grams[a : b - 2]
                total = counts.setdefault(langs[begin + i], np.zeros(BUCKETS, np.int64))
                np.add.at(total, own[own >= 0], 1)
    for lang, total in counts.items():
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total[at])],
            ["lang", "bucket", "n"],
        )


@dataclass(frozen=True)
class Model:
    langs: list[str]
    code: np.ndarray  # languages x bits, +-1
    weights: np.ndarray  # buckets x bits
    scale: np.ndarray  # the margin of a bit that its classifier reaches for every language
    trust: np.ndarray  # what a bit counts


def learn(examples: DataFrame) -> Model:
    """From all rows (lang, text) with a label."""
    rows = examples.where("lang is not null").select("lang", _padded(F.col("text")).alias("text"))
    counts = rows.mapInArrow(_counted, "lang string, bucket int, n long")
    counts = stage(counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    totals = {r[0]: r[1] for r in counts.groupBy("lang").agg(F.sum("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(totals) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    langs = sorted(totals)
    code = codewords(len(langs))
    n_bits = code.shape[1] if len(langs) > 1 else 0
    if not n_bits:
        return Model(langs, np.zeros((len(langs), 0), np.int8), np.zeros((BUCKETS, 0)), np.ones(0), np.ones(0))
    room = {lang: totals[lang] + SMOOTH * BUCKETS for lang in langs}

    def share(bit: int, sign: int) -> Column:
        """How likely a bucket is in the languages of one side of a bit."""
        own = [lang for lang, s in zip(langs, code[:, bit]) if s == sign]
        rest = sum(SMOOTH / room[lang] for lang in own)
        seen = F.sum(F.when(F.col("lang").isin(own), F.col("n") / F.col("room")).otherwise(0.0))
        return (seen + rest) / len(own)

    sizes = examples.sparkSession.createDataFrame(list(room.items()), "lang string, room double")
    table = counts.join(F.broadcast(sizes), "lang")
    ratios = [F.log(share(b, 1) / share(b, -1)).alias(f"w{b}") for b in range(n_bits)]
    by_bucket = stage(table.groupBy("bucket").agg(*ratios))
    margins = counts.join(by_bucket, "bucket").groupBy("lang").agg(
        *(F.sum(F.col("n") * F.col(f"w{b}")).alias(f"m{b}") for b in range(n_bits))
    )
    margin = {r[0]: np.array(r[1:]) / totals[r[0]] for r in margins.collect()}
    reach = np.min([code[i] * margin[lang] for i, lang in enumerate(langs)], axis=0)
    trust = np.maximum(reach, 0)
    pdf = by_bucket.toPandas()
    weights = np.zeros((BUCKETS, n_bits))
    weights[pdf["bucket"].to_numpy()] = pdf[[f"w{b}" for b in range(n_bits)]].to_numpy()
    return Model(langs, code, weights, np.maximum(reach, 1e-9), trust / trust.sum() if trust.sum() else trust + 1 / n_bits)


def losses(model: Model, margins: np.ndarray) -> np.ndarray:
    """Texts x languages: the weighted logistic loss of each codeword."""
    z = np.clip(margins / model.scale, -30, 30)
    agree = np.log1p(np.exp(-2 * z)) @ np.diag(model.trust)
    differ = np.log1p(np.exp(2 * z)) @ np.diag(model.trust)
    return agree @ (model.code > 0).T + differ @ (model.code < 0).T


def _predicted(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        model: Model = shared.value
        columns = np.ascontiguousarray(model.weights.T, np.float32)
        names = batch.schema.names
        for begin, end, data, offsets in slices(batch.column(names.index("_padded"))):
            part = batch.slice(begin, end - begin)
            letters = part.column(names.index("_letters")).to_numpy(zero_copy_only=False).astype(bool)
            out = {n: part.column(n) for n in names if n not in ("_padded", "_letters")}
            if not model.langs:
                best, score, second = np.zeros(len(letters), int), np.zeros(len(letters)), np.zeros(len(letters), int)
                letters[:] = False
            else:
                grams = trigrams(data)
                real = grams >= 0
                bounds = offsets[:-1], offsets[1:] - 2
                total = np.concatenate([[0], np.cumsum(real)])
                n = np.maximum(total[bounds[1]] - total[bounds[0]], 1)
                margins = np.zeros((len(letters), len(columns)))
                for bit, column in enumerate(columns):
                    sums = np.zeros(len(grams) + 1)
                    np.cumsum(np.where(real, column[grams], 0), out=sums[1:], dtype=np.float64)
                    margins[:, bit] = (sums[bounds[1]] - sums[bounds[0]]) / n
                loss = losses(model, margins)
                order = np.argsort(loss, axis=1, kind="stable")
                best, second = order[:, 0], order[:, min(1, len(model.langs) - 1)]
                odds = np.exp(-SHARP * (loss - loss.min(1, keepdims=True)))
                score = odds[np.arange(len(odds)), best] / odds.sum(1)
            langs = [*model.langs, "und"]
            name = lambda at: pa.array([langs[i] if ok else "und" for i, ok in zip(at.tolist(), letters)], pa.string())
            out |= {
                "lang_pred": name(best), "score": pa.array(np.where(letters, score, 0.0)), "second": name(second),
                "ambiguous": pa.array((score < SURE) | ~letters),
            }
            yield pa.RecordBatch.from_pydict(out)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with lang_pred, score (0 to 1), second (the next-best language) and ambiguous."""
    docs = docs.drop("lang_pred", "score", "second", "ambiguous", "_padded", "_letters")
    schema = T.StructType(list(docs.schema))
    for name, kind in (("lang_pred", "string"), ("score", "double"), ("second", "string"), ("ambiguous", "boolean")):
        schema = schema.add(name, kind)
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    ready = docs.withColumns({"_padded": _padded(F.col("text")), "_letters": letters})
    return ready.mapInArrow(partial(_predicted, shared=docs.sparkSession.sparkContext.broadcast(model)), schema)


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, F.lit(False))
    model = learn(docs.where(~out).select("lang", "text"))
    # The text goes to the scorer once, padded; ids come along, labels do not.
    asked = docs.select("doc_id", "text", out.alias("held_out"))
    return predict(asked, model).drop("text")
