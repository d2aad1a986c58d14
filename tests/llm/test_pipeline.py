import os
import random

import pytest

import corpus_pipeline
from hearthstat.llm import bpe
from hearthstat.llm.staging import stage
from tests.llm import docs

PASSAGE = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"


def prose(rnd, n=120):
    vocabulary = ["the", "house", "stands", "near", "a", "river", "and", "many", "people", "walk", "slowly", "home"]
    text = []
    while len(text) < n:
        own = [rnd.choice(vocabulary) + rnd.choice(["", "s", "ing", "ed"]) for _ in range(rnd.randrange(6, 14))]
        text += [own[0].capitalize(), *own[1:-1], own[-1] + "."]
    return " ".join(text)


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    rnd = random.Random(5)
    rows, labels = [], []
    for i in range(160):
        rows.append((i, prose(rnd)))
        labels.append((i, 1, 0))
    rows += [(200, "### $$$ %%% 123 &&& @@@ !!! " * 30), (201, "XX!! QQ!! ZZ!! KK!! " * 40)]
    rows += [(300, rows[0][1]), (301, rows[1][1] + " And more.")]
    rows += [(310 + i, prose(rnd) + "\nA line that stands in many texts.\n" + prose(rnd, 30)) for i in range(12)]
    rows += [(400, prose(rnd) + " " + PASSAGE + ". " + prose(rnd)), (401, None), (402, ""), (None, prose(rnd))]
    path = str(tmp_path_factory.mktemp("planted"))
    full = [(i, t, "en", "s", None if t is None else len(t), "x") for i, t in rows]
    spark.createDataFrame(full, docs.SCHEMA + ", keep string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, PASSAGE)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_decide(spark, planted):
    df = spark.read.parquet(f"{planted}/documents.parquet")
    columns, texts = df.columns, {}
    for name, step in corpus_pipeline.STAGES:
        df = stage(step(spark, df, planted))
        if name != "tokens":
            assert df.columns == columns
            texts[name] = {r["doc_id"]: r for r in df.collect()}
            assert {r["keep"] for r in texts[name].values()} == {"x"}
    ids = {name: set(rows) for name, rows in texts.items()}
    clean = {*range(160), *range(310, 322), 400, 401, 402, None}
    assert clean <= ids["quality"] and not ids["quality"] & {200, 201}
    assert ids["lines"] == ids["quality"]
    line = "A line that stands in many texts."
    assert not any(line in (r["text"] or "") for r in texts["lines"].values())
    assert all(r["n_chars"] == len(r["text"]) for r in texts["lines"].values() if r["text"] is not None)
    assert ids["near_duplicates"] == ids["lines"] - {300, 301}
    cut = texts["benchmark"][400]["text"]
    assert "epsilon" not in cut and texts["near_duplicates"][400]["text"].replace(PASSAGE, "") == cut
    tokens, pattern = bpe.multi_ranks()
    encoder = bpe.Encoder(tokens, pattern, bpe.PerfectHash(tokens))
    for r in df.collect():
        assert bytes(r["ids"]) == encoder.encode([texts["benchmark"][r["doc_id"]]["text"] or ""])[0].tobytes()


def test_run_is_the_stages_in_turn(spark, planted):
    assert corpus_pipeline.run(spark, planted).count() == 176


def test_odd_and_empty_tables(spark, tmp_path):
    for name, df in (("odd", docs.odd(spark, "perplexity")), ("empty", docs.empty(spark))):
        path = os.path.join(str(tmp_path), name)
        df.write.parquet(f"{path}/documents.parquet")
        spark.createDataFrame([(1, 1)], "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
        out = corpus_pipeline.run(spark, path).collect()
        assert (len(out) > 5) == (name == "odd")


def test_batches_are_of_few_bytes_however_long_texts_are(spark):
    from pyspark.sql import functions as F

    df = spark.range(0, 200, 1, 1).select("id", F.repeat(F.lit("some words "), 20_000).alias("text"))
    corpus_pipeline._bound_batches(spark)
    sizes = df.mapInArrow(lambda batches: (b.select(["id"]) for b in batches), "id long")
    assert sizes.count() == 200
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) == corpus_pipeline.BATCH_BYTES < 16 << 20
