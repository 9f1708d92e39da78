"""The pipeline stage by stage against brute force, on small documents with odd columns."""
import random

import corpus_pipeline as pipeline
import pytest

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def folder(tmp_path_factory, spark):
    """Tables with clean, toxic, copied, nearly copied and leaked documents."""
    rng = random.Random(11)
    path = str(tmp_path_factory.mktemp("sf"))
    clean = lambda n=60: " ".join(rng.choice("abcdefghij") + str(rng.randrange(400)) for _ in range(n))
    docs, toxic = [], []
    for i in range(240):
        bad = i % 4 == 0
        docs.append((i, clean() + (" idiot moron" if bad else "")))
        toxic.append((i, 1, int(bad)))
    one, near, leak = clean(), clean(200), clean(30)
    docs += [(300, one), (301, one.upper()), (302, one), (302, one), (None, None), (303, "")]
    docs += [(310, near), (311, near + " end"), (312, near + " stop")]
    docs += [(320, clean() + " " + leak[:60] + " " + clean()), (321, clean())]
    schema = "doc_id long, text string, lang string, source string, n_chars long, row_key string, toxicity double, kept boolean"
    rows = [(i, t, "en", "s", len(t or ""), "r", 0.5, True) for i, t in docs]
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(toxic, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, leak), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in pipeline.STAGES:
        before = docs
        docs = pipeline.written(stage(spark, docs, folder))
        seen[name] = sorted((r.doc_id if r.doc_id is not None else -1) for r in docs.select("doc_id").collect())
        if name != "bpe_tokens":
            assert docs.columns == before.columns
    clean = [i for i in range(240) if i % 4]
    everything = sorted([*clean, 300, 301, 302, 302, -1, 303, 310, 311, 312, 320, 321])
    assert seen["toxicity"] == everything
    # Equal texts: 302 of its group once, and 303 rather than the null id.
    assert seen["exact_dedup"] == sorted([*clean, 302, 303, 310, 311, 312, 320, 321])
    assert seen["jaccard_join"] == sorted([*clean, 302, 303, 310, 320, 321])
    assert seen["decontamination"] == seen["bpe_tokens"] == sorted([*clean, 302, 303, 310, 321])
    assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]


def test_run_and_registration(spark, folder):
    assert entry.queries()["pipeline"](spark, folder).count() == 180 + 4
    assert len(pipeline.STAGES) == 5 and pipeline.ORACLE_SQL is None


def test_stages_with_no_rows(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, folder).collect() == []


def test_near_copies_from_four_fifths_of_five_word_shingles_on(spark):
    rng = random.Random(12)
    words = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    texts = {}
    for i, (n, more) in enumerate([(204, 28), (204, 50), (204, 51)]):  # similarity 200/228, 200/250 and 200/251
        texts[10 * i], texts[10 * i + 1] = (base := words(n)), base + words(more)
    texts[30], texts[31] = (base := words(204)), base[:-40]  # 160/200
    texts[40], texts[41] = (base := words(204)), base[:-41]  # 159/200
    texts[50], texts[51] = (base := words(1000)), [f"edit{k}" if k % 50 == 25 else w for k, w in enumerate(base)]  # 896/1096
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string").repartition(3)
    kept = {r.doc_id for r in pipeline.drop_near_copies(spark, docs, "").collect()}
    assert kept == {0, 10, 20, 21, 30, 40, 41, 50}


def test_near_copies_go_by_row_where_ids_repeat(spark):
    rng = random.Random(13)
    text = lambda: " ".join(f"w{rng.randrange(10**9)}" for _ in range(60))
    a, b, c, d, own = (text() for _ in range(5))
    rows = [(3, a), (5, a + " end"), (5, own), (7, b), (7, b + " end"), (8, c), (8, c), (9, c + " end"), (None, d), (6, d), (6, d.upper()), (1, None), (1, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = [(r.doc_id, r.text) for r in pipeline.drop_near_copies(spark, docs, "").collect()]
    short = sorted((i or 0, (t or "").lower().removesuffix(" end")) for i, t in kept)
    assert short == sorted([(3, a), (5, own), (7, b), (8, c), (0, d), (6, d), (1, ""), (1, " ")])
