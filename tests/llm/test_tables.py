"""URL cascade, shards, language ID."""

import zlib

from pyspark.sql import functions as F

from pactline.llm import langid, sharding, urlfilter


def test_cascade_is_exact(spark):
    keys = spark.range(4000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = keys.where(F.expr("pmod(hash(key), 9) = 0")).unionByName(spark.createDataFrame([("not in the corpus",)], "key string"))
    levels = urlfilter.build(listed, keys)
    assert len(levels) > 1
    got = keys.withColumn("in", urlfilter.contains(levels, F.col("key")))
    assert got.where("in <> (pmod(hash(key), 9) = 0)").count() == 0
    for bits in (1 << 24, 2000):  # one cascade, and several parts with one each
        pages = keys.select(F.col("key").alias("page_id"), F.concat(F.lit("x://"), "key").alias("url"))
        got = urlfilter.judge(pages, listed, max_bits=bits)
        assert got.where("listed <> (pmod(hash(page_id), 9) = 0)").count() == 0 and got.count() == 4000


def test_url_rules_and_edges(spark):
    rows = ["http://A.Example.org/en/12?x", "https://example.org/es/", "http://x.org", "http://notexample.org.com/fr/", "ftp://b.com/de/1#f", "no scheme", None, "", "http://", "http://plain.net/a", "http://plain.net/a", "see://x://y.org/"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(rows)], "page_id long, url string, host string").drop("host")
    listed = spark.createDataFrame([("plain.net/a",)], "key string")
    for bits in (1 << 24, 1):  # one cascade, and one for each of several parts
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(pages, listed, max_bits=bits).collect()}
        assert got[0] == ("a.example.org", "/en/12", "example.org/en/1", "block")
        assert got[1] == ("example.org", "/es/", "example.org/es/", "block")
        assert got[2] == ("x.org", "", None, "allow")
        assert got[3] == ("notexample.org.com", "/fr/", "com/fr/", "allow")
        assert got[4][2:] == ("com/de/", "block")
        assert got[5] == got[6] == got[7] == got[8] == ("", "", None, "allow")
        assert got[9] == got[10] == ("plain.net", "/a", None, "block")
        assert got[11][0] == "x:"
    assert urlfilter.judge(pages.limit(0), listed.limit(0)).count() == 0


def test_shards(spark):
    rows = [(i, "w" * (i * 7 % 900), "en" if i % 3 else "fr", f"s{i % 5}", "c") for i in range(3000)] + [(5000 + i, "copy " * 20, "en", "s0", "c") for i in range(1500)] + [(None, None, None, None, "c"), (7, "", "en", "s1", "c"), (7, "", "en", "s1", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, shard string")
    out = sharding.assign(df, 40).toPandas()
    assert len(out) == len(rows) and set(out.shard) == set(range(40)) and set(out.law) == {"bytes"}
    by = out.groupby("shard")
    assert by["size"].sum().max() < 1.1 * by["size"].sum().mean() and by["size"].sum().min() > 0.9 * by["size"].sum().mean()
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in by)
    assert (out[out.text_crc32.notna() & (out["size"] > 16)].groupby("text_crc32").shard.nunique() > 1).sum() <= 1  # only the group heavier than a shard
    assert int(out[out.doc_id == 5000].text_crc32.iloc[0]) == zlib.crc32(b"copy " * 20)
    assert sharding.assign(df.limit(0), 40).count() == 0


def test_shard_ranks_and_files(spark, tmp_path):
    """Sources with a common start differ as any others; files hold every row once, also those without or of equal id."""
    rows = [(None if i % 50 == 0 else i // 2, f"text {i} " * (i % 9), f"https://source{i % 9}", "en", "c") for i in range(900)] + [(5, "same", None, None, "c")] * 4
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, row string")
    assert {r.source: r.n for r in sharding.ranked(df, "source").groupBy("source").agg(F.count("*").alias("n")).collect()} == {0: 4} | dict.fromkeys(range(1, 10), 100)
    sharding.write(df, str(tmp_path / "out"), 8)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.drop("shard").select(*df.columns).exceptAll(df).count() == 0 and back.count() == len(rows) and back.select("shard").distinct().count() == 8


def test_shard_columns_that_clash(spark, tmp_path):
    """Columns named like those that are put in between are neither taken for them nor lost."""
    df = spark.createDataFrame([(i, "same text", "en", "s", 7, 5) for i in range(400)], "doc_id long, text string, lang string, source string, shard_row_ int, shard int")
    by = sharding.assign(df, 4).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    assert len(by) == 4 and max(r.b for r in by) < 1.3 * min(r.b for r in by)
    sharding.write(df, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.select(*df.columns).exceptAll(df).count() == 0 and back.count() == 400 and back.select("shard_").distinct().count() == 4


def test_language_sample_of_rows(spark):
    """A doc_id that many rows have draws no other language out of the sample; numerals are no letters."""
    rows = [(7, f"the quick brown fox {i} jumps", "en") for i in range(900)] + [(i, f"le renard brun saute {i}", "fr") for i in range(100, 160)]
    rows += [(7, "the same row", "en")] * 500 + [(1000 + i, t, None) for i, t in enumerate(("\u00bd", "\u00b2 \u2167", "\u2460 12", "\u0436"))]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 40)
    assert model.langs == ["en", "fr"]
    out = {r.doc_id: r.lang_pred for r in langid.predict(spark.createDataFrame([(i, t, False) for i, t, _ in rows], "doc_id long, text string, held_out boolean"), model).collect()}
    assert [out[1000 + i] for i in range(3)] == ["und"] * 3 and out[1003] != "und" and out[120] == "fr" and out[7] == "en"


def test_language_held_out(spark):
    words = {"en": "the quick brown fox and what they were doing", "de": "der schnelle fuchs und die katze über straße", "fr": "le renard brun est où les élèves étaient"}
    rows = [(i, " ".join(words[k].split()[(i + j) % 8] if (i + j) % 8 < len(words[k].split()) else "a" for j in range(12)), k, "s") for i, k in enumerate(["en", "de", "fr"] * 80)]
    rows += [(9001, None, "en", "s"), (9002, "123 456", None, "s"), (9003, "", "de", "s"), (None, words["de"], "de", "s")]
    out = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")).toPandas()
    assert len(out) == len(rows)
    truth = {r[0]: r[2] for r in rows}
    held = out[out.held_out & (out.doc_id < 9000)]
    assert len(held) > 40 and (held.lang_pred == held.doc_id.map(truth)).mean() > 0.95
    assert set(out[out.doc_id.isin([9001, 9002, 9003])].lang_pred) == {"und"}
    assert out.score.between(0, 1).all()
    assert [bool(x) for x in out.sort_values("doc_id").held_out[:5]] == [zlib.crc32(str(i).encode()) % 3 == 1 for i in range(5)]


def test_language_without_labels(spark):
    df = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert langid.identify(df).head().lang_pred == "und"
    assert langid.identify(df.limit(0)).count() == 0
