import math

import numpy as np
from pyspark.sql import functions as F

from hearthstat.llm import quality
from tests.llm import docs


def test_junk_goes_and_clean_text_stays(spark, sf_dir):
    """On labels that were not learned from. Words repeated many times are plausible to n-grams, hence a few stay."""
    folder = sf_dir.replace("sf0.001", "sf0.01")
    df = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality")
    out = quality.classify(df, labels.where("quality = 1 and doc_id % 3 > 0"))
    rows = out.join(labels, "doc_id").collect()
    kept = {q: [r["keep"] for r in rows if r["quality"] == q and (not q or r["doc_id"] % 3 == 0)] for q in (0, 1)}
    assert len(kept[0]) > 40 and len(kept[1]) > 80
    assert np.mean(kept[1]) > 0.97 and np.mean(kept[0]) < 0.15
    assert all(math.isfinite(r["perplexity"]) for r in rows if r["n_symbols"])


def test_the_query_covers_every_document(spark, sf_dir):
    out = quality.op7_quality(spark, sf_dir)
    assert out.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert out.where(F.col("perplexity").isNull() & (F.col("n_symbols") > 0)).count() == 0


def test_a_text_does_not_teach_its_copies(spark):
    """Trusted text and its exact copies are scored by other texts only."""
    rows = [(i, "en", f"common words of text number {i} and the end") for i in range(40)]
    odd = "zq xj kv wq " * 20
    rows += [(100 + i, "en", odd) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    out = {r["doc_id"]: r["perplexity"] for r in quality.classify(df, df).collect()}
    assert min(out[100 + i] for i in range(5)) > 3 * max(out[i] for i in range(40))


def test_odd_rows(spark):
    df = docs.odd(spark, "keep")
    out = quality.classify(df, df.where("lang = 'en'")).collect()
    assert len(out) == 12 and all(r["keep"] for r in out if not r["text"])
    assert all((r["perplexity"] is None) == (not r["text"]) for r in out)
    assert quality.classify(docs.empty(spark), df).count() == 0
    assert all(r["keep"] for r in quality.classify(df, df.limit(0)).collect())
