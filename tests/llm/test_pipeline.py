"""The pipeline on a small corpus: clean documents come through, each stage's cases don't."""

import random

import corpus_pipeline
from pactline.llm.queries import ORACLES, QUERIES


def test_stages(spark, tmp_path):
    rng = random.Random(6)
    vocab = ["".join(rng.choice("aeiourstln") for _ in range(rng.randint(2, 7))) for _ in range(500)]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    clean = [(i, prose(90)) for i in range(20)]
    twin = prose(150)
    items = [(0, prose(30)), (1, prose(45))]
    line = prose(15)
    rows = clean + [(100, twin), (101, twin), (102, twin + " end"), (110, prose(60) + " " + items[1][1]), (120, "junk### " * 60), (121, "no"), (122, None), (123, ""), (130, f"{prose(60)}\n{line}"), (131, f"{prose(60)}\n{line}")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept, frame = {}, spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, frame, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        frame = spark.read.parquet(str(tmp_path / name))
        kept[name] = {r.doc_id for r in frame.collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(str(tmp_path / "line_dedup")).collect()}
    assert kept["quality_rules"] == {i for i, _ in rows} - {120, 121, 122, 123}
    assert line in texts[130] and line not in texts[131]
    assert len(kept["benchmark_decontamination"] & {100, 101, 102}) == 1 and 110 not in kept["benchmark_decontamination"] and 110 in kept["ngram_jaccard_join"]
    assert {i for i, _ in clean} <= kept["packing"] == kept["benchmark_decontamination"]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == frame.count()


def test_registry():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 14)] and set(ORACLES) <= set(QUERIES)


def test_a_stage_leaves_other_results_alone(spark, tmp_path):
    """A result that hasn't been read yet can be read after other stages have run on other documents."""
    rng = random.Random(7)
    make = lambda k: spark.createDataFrame([(i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "tau"]) + str(rng.randint(0, 99)) for _ in range(40)), "x") for i in range(k)], "doc_id long, text string, row_key_ string")
    spark.createDataFrame([(0, "no such passage in any of them at all")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stages = [f for _, f in corpus_pipeline.STAGES[:4]]
    first = [f(spark, make(12), str(tmp_path)) for f in stages]
    others = [f(spark, make(7), str(tmp_path)) for f in reversed(stages)]
    assert [x.count() for x in first] == [12] * 4 and [x.count() for x in others] == [7] * 4
    assert {r.row_key_ for x in first for r in x.collect()} == {"x"}


def test_stages_on_odd_tables(spark, tmp_path):
    """Empty tables, nulls, ties and repeated rows, columns that clash, and a very long text."""
    rng = random.Random(8)
    prose = lambda n: " ".join("".join(rng.choice("aeiourstln") for _ in range(rng.randint(2, 7))) for _ in range(n))
    same, long = prose(80), prose(120_000)
    schema = "doc_id long, text string, shard int, key string, node long, size long, row long"
    rows = [(1, same), (1, same), (None, same), (2, None), (3, ""), (4, long), (5, prose(80)), (None, prose(70))]
    spark.createDataFrame([(0, prose(30))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame([(i, t, 1, "k", 2, 3, 4) for i, t in rows], schema)
    for frame, want in ((docs, 4), (docs.limit(0), 0)):
        for _, stage in corpus_pipeline.STAGES[:4]:
            frame = stage(spark, frame, str(tmp_path))
            assert frame.columns == docs.columns
        got = frame.collect()
        assert len(got) == want and all((r.shard, r.key, r.node, r.size, r.row) == (1, "k", 2, 3, 4) for r in got)
    assert corpus_pipeline.STAGES[4][1](spark, docs.limit(0), str(tmp_path)).count() == 0
