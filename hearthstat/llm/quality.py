"""Quality filter: the perplexity of a text under an interpolated modified Kneser-Ney model of trusted text.

The model is over n-grams of bytes of all trusted text (see ngrams), counted and joined
with the texts' n-grams in shards, so that it grows with the corpus. Texts fall into two
folds by a hash of their contents, and each is scored by the trusted texts of the other
fold. So trusted texts have values on one scale with those of other texts, and
thresholds can be taken from them.

A text's perplexity is taken with PRIOR bytes of its language's trusted mean added,
so that a short text needs more than a few odd bytes to stand out. It is rejected
if that exceeds the threshold of its language (see thresholds): LEEWAY times the QUANTILE
of trusted texts' values, shrunk towards the spread of all languages by their number.
Documents of a language without trusted texts have no threshold and are kept.

A null or empty text has no perplexity (null) and is kept, as nothing speaks against
it; a null language is a language of its own. Rows are kept apart even if they repeat.
Output columns replace input columns of the same name.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthstat.llm import ngrams
from hearthstat.llm.staging import clean, small, stage

PRIOR = 128
QUANTILE = 0.998
#: Texts that the spread of all languages counts for in one; those that WIDE counts for in all.
FEW, FEWEST, WIDE = 50, 10, 0.5
#: How far above that a text may be: a line or a passage of a kind that trusted texts lack does not make junk of a text.
LEEWAY = 1.25


def held_out(docs: DataFrame, ids: DataFrame) -> DataFrame | None:
    """(_key, log_p) of the texts of `docs` (_key, doc_id, text), each by the trusted texts of the other fold.

    None if there is nothing to learn from.
    """
    texts = docs.where("length(text) > 0").withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(2)))
    known = texts.join(small(ids), "doc_id", "left_semi")
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if not known.limit(1).count():
        return None
    model = ngrams.train(known.select((1 - F.col("fold")).alias("fold"), "text"))
    scores = ngrams.score(texts.select("_key", "fold", "text"), model, size)
    # Rows that repeat a document have one value.
    scores = stage(scores.groupBy("_key").agg(F.max("log_p").alias("log_p")))
    clean(docs.sparkSession)
    return scores


def classify(docs: DataFrame, trusted_ids: DataFrame) -> DataFrame:
    """`docs` (doc_id, text, lang, ...) with n_symbols, perplexity, threshold and keep.

    `trusted_ids` holds the doc_id of the documents to learn from.
    """
    added = ["n_symbols", "perplexity", "threshold", "keep"]
    docs = docs.drop(*added, "_trusted", "_key", "log_p")
    names = docs.columns
    ids = stage(trusted_ids.select("doc_id").where("doc_id is not null").distinct())
    docs = docs.withColumn("_key", F.xxhash64("doc_id", "text"))
    docs = docs.withColumn("n_symbols", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    scores = held_out(docs.select("_key", "doc_id", "text"), ids)
    if scores is None:
        none = F.lit(None).cast("double")
        return docs.withColumns({"perplexity": none, "threshold": none, "keep": F.lit(True)}).select(*names, *added)
    scores = small(scores)
    trusted = docs.where("n_symbols > 0").select("_key", "doc_id", "lang", "n_symbols").join(small(ids), "doc_id", "left_semi")
    trusted = stage(trusted.join(scores, "_key").select("lang", "n_symbols", "log_p"))
    rate = (F.sum("log_p") / F.sum(F.col("n_symbols") + 1)).alias("mean")
    means = {r["lang"]: r["mean"] for r in _few(trusted.groupBy("lang").agg(rate))}
    every = trusted.agg(rate).first()["mean"]
    perplexity = _perplexity(means, every)
    threshold = _by_lang(thresholds(trusted.select("lang", F.log(perplexity).alias("x"))), None)
    scored = docs.join(scores, "_key", "left")
    scored = scored.withColumn("perplexity", F.when(F.col("n_symbols") > 0, perplexity))
    scored = scored.withColumn("threshold", threshold.cast("double"))
    keep = F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))
    return scored.withColumn("keep", keep).select(*names, *added)


def thresholds(trusted: DataFrame) -> dict:
    """By language, from the logarithms `x` of trusted texts' held-out perplexities: the highest one that is kept.

    A language's quantile lies above its mean by what its own texts show and, with the
    weight of FEW texts, by what those of all languages show about their own means. That
    in turn starts from WIDE, with the weight of FEWEST texts. The fewer its texts, the
    less is its mean known, which widens the distance.
    """
    quantile = F.percentile_approx("x", QUANTILE, 10000)
    rows = _few(trusted.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), quantile.alias("q")))
    # A text's distance from a mean that it is part of is too short.
    scale = {r["lang"]: (r["n"] / (r["n"] - 1)) ** 0.5 if r["n"] > 1 else 0.0 for r in rows}
    mean, scale = _by_lang({r["lang"]: r["mean"] for r in rows}, None), _by_lang(scale, None)
    apart = trusted.select(((F.col("x") - mean) * scale).alias("x"), scale.alias("scale")).where("scale > 0")
    n, pooled = apart.agg(F.count(F.lit(1)), quantile).first()
    pooled = (n * (pooled or 0.0) + FEWEST * WIDE) / (n + FEWEST)
    distance = {r["lang"]: (r["n"] * (r["q"] - r["mean"]) + FEW * pooled) / (r["n"] + FEW) for r in rows}
    return {r["lang"]: LEEWAY * math.exp(r["mean"] + distance[r["lang"]] * (1 + 1 / r["n"]) ** 0.5) for r in rows}


def _few(by_lang: DataFrame, most: int = 10_000) -> list:
    """The rows of a table by language, if these are few."""
    rows = by_lang.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} languages")
    return rows


def _by_lang(values: dict, default: float | None):
    """A column: the value of the row's language."""
    out = F.lit(default)
    if known := {k: v for k, v in values.items() if k is not None}:
        table = F.create_map(*(F.lit(x) for kv in known.items() for x in kv))
        out = F.coalesce(F.try_element_at(table, F.col("lang")), out)
    return F.when(F.col("lang").isNull(), F.lit(values[None])).otherwise(out) if None in values else out


def _perplexity(means: dict, every: float | None):
    mean = _by_lang(means, every)
    return F.exp(-(F.col("log_p") + mean * PRIOR) / (F.col("n_symbols") + 1 + PRIOR))


def op7_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classify(docs, labels.where("quality = 1")).select("doc_id", "n_symbols", "perplexity", "threshold", "keep")
