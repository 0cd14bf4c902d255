"""Line dedup, Jaccard join, passages, decontamination against brute force."""

import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from pactline.llm import common, decontam, jaccard, lines, passages

RNG = random.Random(9)
VOCAB = ["".join(RNG.choice("aeioulnrst") for _ in range(RNG.randint(2, 8))) for _ in range(900)]


def text(n, rng=RNG):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def edited(t, n, rng=RNG):
    w = t.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = rng.choice(VOCAB) + "x"
    return " ".join(w)


def shingles(t):
    w = re.findall("[^\x20\x09-\x0d]+", (t or "").lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    sets, par = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def root(x):
        while par[x] != x:
            x = par[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        i = len(sets[a] & sets[b])
        if i and 100 * i >= 80 * (len(sets[a]) + len(sets[b]) - i):
            x, y = sorted((root(a), root(b)))
            par[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


def corpus():
    rng = random.Random(3)
    rows, n = [], itertools.count()
    base, shared = text(120, rng), text(60, rng)
    for _ in range(25):
        rows.append((next(n), text(rng.randint(20, 150), rng)))
    for k in range(40):  # a large group of near copies, and one of exact ones
        rows.append((next(n), edited(base, rng.randint(0, 3), rng)))
        rows.append((next(n), base))
    for _ in range(20):  # a passage that many documents share
        rows.append((next(n), f"{text(40, rng)} {shared} {text(40, rng)}"))
    chain = text(100, rng)
    for _ in range(6):  # a chain of links
        chain = edited(chain, 2, rng)
        rows.append((next(n), chain))
    for t in (None, "", " \n", "one two", "ONE two", "one two three four", text(3000, rng)):
        rows.append((next(n), t))
    return rows


def test_cells_bound_the_overlap():
    """The bound is never below the overlap, also for cells of unlike number and full ones, and tells unlike sets apart."""
    rng = np.random.default_rng(6)
    for n, shared in ((1, 1), (1, 0), (4, 3), (60, 50), (500, 410), (5000, 0), (3000, 2500)):
        for extra in (0, n // 5):
            own = np.unique(rng.integers(0, 2**63, 2 * n + extra + shared, dtype=np.int64).astype(np.uint64) * np.uint64(2))
            rng.shuffle(own)
            a, b = np.sort(own[:n]), np.sort(np.concatenate([own[:shared], own[n : 2 * n + extra - shared]]))
            most = jaccard.most_shared(jaccard.cells(a), jaccard.cells(b), len(a), len(b))
            assert len(np.intersect1d(a, b)) <= most <= min(len(a), len(b))
            assert shared or n < 500 or most < 0.85 * n
    close = np.arange(9000, dtype=np.uint64)  # all in one cell
    assert jaccard.most_shared(jaccard.cells(close), jaccard.cells(close[:8000]), 9000, 8000) >= 8000


def test_jaccard_components(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, component_id string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.components(df).collect()}
    assert got == brute_components(rows)
    kept = {r.doc_id for r in jaccard.keep_one(df).collect()}
    assert kept == {c for _, c in brute_components(rows).values()}
    assert jaccard.components(df.limit(0)).count() == 0


def test_jaccard_repeated_rows_and_null_id(spark):
    t = text(30)
    df = spark.createDataFrame([(4, t), (4, t), (None, t), (2, t)], "doc_id long, text string")
    assert {r.component_id for r in jaccard.components(df).collect()} == {2}


def test_jaccard_keep_one_of_rows(spark):
    """One row a group: repeated rows and null ids too; a row stays though its doc_id is also that of a copy elsewhere."""
    t, u, v, w = (text(30) for _ in range(4))
    rows = [(4, t), (4, t), (None, t), (2, u), (2, u), (None, v), (None, v), (7, w), (7, t), (8, None), (8, None), (8, "")]
    df = spark.createDataFrame([(i, x, "z") for i, x in rows], "doc_id long, text string, row string")
    got = sorted(((r.doc_id, r.text) for r in jaccard.keep_one(df).collect()), key=str)
    assert got == sorted([(4, t), (2, u), (None, v), (7, w), (8, None), (8, None), (8, "")], key=str)
    assert jaccard.keep_one(df).columns == df.columns and jaccard.keep_one(df.limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5, 5)]
    got = {r.node: r.comp for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[1000 + i] == 1000 for i in range(50))
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_large_bucket_keeps_all_links(spark):
    """In one bucket, only neighbours link: the star finds one link, the rest comes from the second step."""
    members = spark.createDataFrame([(1, i, 0, 1) for i in range(40)], "key long, node long, rank long, size long")
    comps = common.link_buckets(members, lambda p: p.where("b - a = 1 and a <> 20"))
    got = {r.node: r.comp for r in comps.collect()}
    assert {got[i] for i in range(21)} == {0} and {got[i] for i in range(21, 40)} == {21}


def levenshtein(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


def test_edit_bound():
    rng = random.Random(5)
    for _ in range(400):
        a = "".join(rng.choice("ab") for _ in range(rng.randint(0, 20)))
        b = "".join(rng.choice("ab") for _ in range(rng.randint(0, 20)))
        k = rng.randint(0, 8)
        assert lines.within(a, b, k) == (levenshtein(a, b) <= k)


def test_alike_in_bands(monkeypatch):
    """Many pairs at once, in bands or one by one, against brute force: empty, equal, unlike ones, and other scripts."""
    rng = random.Random(17)
    pairs = [("", ""), ("", "a"), ("abc", "abc"), ("\u8bad\u7ec3\U0001f600" * 9, "\u8bad\u7ec3\U0001f601" * 9)]
    for _ in range(700):
        a = text(rng.randint(1, 12), rng)
        b = list(a)
        for _ in range(rng.randint(0, 14)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "e", "ab"])
        pairs.append((a, "".join(b)) if rng.random() < 0.5 else ("".join(b), a))
    for percent in (90, 70):
        want = [levenshtein(a, b) <= max(len(a), len(b)) * (100 - percent) // 100 for a, b in pairs]
        for banded in (400, 30):
            monkeypatch.setattr(lines, "BANDED", banded)
            assert lines.alike(*zip(*pairs, strict=True), percent).tolist() == want


def test_wide_buckets_make_no_rows_of_pairs(spark, monkeypatch):
    """Lines about one text, many of them too far from each other: the pairs across components are compared in parts of
    a bucket and only links are rows, with the same groups as from a list of these pairs."""
    rng = random.Random(4)
    base = text(60, rng)
    rows = [(i, edited(base, 4 + i % 7, rng)) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    link, listed, parts = common.link_buckets, [], []

    def counted(members, verify, *more, across, way):
        def count(pairs):
            listed.append((way, pairs))
            return verify(pairs)

        def held(rest):
            parts.append(rest.groupBy("key").count().agg({"count": "max"}).head()[0])
            return across(rest)

        return link(members, count, *more, across=held if way else None)

    got = []
    monkeypatch.setattr(lines, "PART", 12)
    for way in (True, False):
        monkeypatch.setattr(common, "link_buckets", lambda *a, across, way=way: counted(*a, across=across, way=way))
        got.append({(r.doc_id, r.group_id, r.n_lines, r.removed) for r in lines.groups(docs).collect()})
    assert got[0] == got[1] and len({x[1] for x in got[0]}) < len(got[0])
    assert parts and parts[0] > 2 * lines.PART
    assert [way for way, _ in listed] == [True, False, False]  # with parts, only the stars are listed


def test_line_groups(spark):
    rng = random.Random(8)
    own = [text(60, rng) for _ in range(30)]
    common_line, near = text(12, rng), text(80, rng)
    rows = [(i, f"{own[i]}\n{common_line.upper()}!\n\nLes.") for i in range(30)] + [(100 + i, f"{edited(near, 1, rng)}\r\n{text(50, rng)}") for i in range(20)] + [(200, None), (201, ""), (202, "Les."), (203, f"{common_line}\n{common_line}")]
    clash = ["node", "row", "row_key_", "gone_lines", "Key", "gone", "line_no", "group_id"]
    df = spark.createDataFrame([(i, t, len(t or ""), *clash) for i, t in rows], "doc_id long, text string, n_chars int, " + ", ".join(f"{c} string" for c in clash))
    assert lines.dedup(df).columns == df.columns
    got = lines.groups(df).toPandas()
    exact = got[got.doc_id.isin([*range(30), 203]) & (got.n_lines == 32)]
    assert set(zip(exact.doc_id, exact.line_no, strict=True)) == {(i, 1) for i in range(30)} | {(203, 0), (203, 1)}
    assert not exact[exact.doc_id == 0].removed.any() and exact[exact.doc_id != 0].removed.all()
    close = got[got.doc_id.between(100, 119)]
    assert len(close) >= 16 and (close.line_no == 0).all() and (~close.removed).sum() == close.group_id.nunique()
    assert not got.doc_id.isin([200, 201, 202]).any()
    out = {r.doc_id: r.text for r in lines.dedup(df).collect()}
    assert out[0] == rows[0][1] and out[5] == f"{own[5]}\n\nLes." and out[203] == "" and out[200] is None
    assert lines.groups(df.limit(0)).count() == 0


def near_lines(rng, n, changed, count):
    """Pairs of lines of n words with `changed` of them replaced, at edit similarity 0.9."""
    out = []
    while len(out) < count:
        a = text(n, rng).split()
        b = list(a)
        for i in rng.sample(range(n), changed):
            b[i] = rng.choice(VOCAB)
        a, b = " ".join(a), " ".join(b)
        if a != b and levenshtein(a, b) <= max(len(a), len(b)) // 10:
            out.append((a, b))
    return out


def test_normal_forms():
    """Words of each line, a space between two, against a regular expression; also for some of the lines only."""
    texts = [None, "", "a", "A  b\nc", "--", "\n\nx, Y!\r\nz", "\u00e9 \u00e8.\n", "\u8bad\u7ec3 \U0001f600x\n-a-", text(400)]
    want = [" ".join(re.findall(r"[0-9a-z\u0080-\U0010ffff]+", line.lower())) for t in texts for line in (t or "").split("\n")]
    got = lines.Lines(pa.array(texts, pa.string()), 1)
    every = np.arange(len(got.node))
    assert got.forms(every).to_pylist() == [w for w in want if w]
    assert got.forms(every[::2]).to_pylist() == [w for w in want if w][::2] and not len(got.forms(every[:0]))
    assert [len(x.encode()) for x in got.forms(every).to_pylist()] == got.sizes().tolist()


@pytest.mark.parametrize("others", [0, 40_000])
def test_line_recall(spark, others):
    """Pairs at edit similarity 0.9 are linked at the stated recall, whatever the number of other lines."""
    rng = random.Random(14)
    pairs = [p for n, k in ((12, 1), (20, 1), (20, 2), (40, 3)) for p in near_lines(rng, n, k, 60)]
    rows = [(2 * i + j, t) for i, p in enumerate(pairs) for j, t in enumerate(p)] + [(1000 + i, text(9, rng)) for i in range(others)]
    got = {r.doc_id: r.group_id for r in lines.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = [2 * i in got and got[2 * i] == got.get(2 * i + 1) for i in range(len(pairs))]
    assert sum(found) >= 0.9 * len(pairs)


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def changed_lines(rng, n, kind, k, count):
    """Pairs of lines of n words, k of whose letters or words are others, at edit similarity 0.9."""
    out = []
    while len(out) < count:
        a = text(n, rng)
        b = list(a) if kind == "letters" else a.split()
        for i in rng.sample([i for i, x in enumerate(b) if x != " "], k):
            b[i] = rng.choice("bcdfghjkm") if kind == "letters" else rng.choice(VOCAB)
        b = "".join(b) if kind == "letters" else " ".join(b)
        if a != b and 10 * edit_distance(a, b) <= max(len(a), len(b)):
            out.append((a, b))
    return out


#: Least recall by words in the line, what is changed and how much of it.  Several letters of a short line cost more bits
#: than blocks of 16 forgive.
CELLS = {("letters", 1): {5: 0.7, 6: 0.75, 8: 0.9, 10: 0.9, 12: 0.9, 20: 0.9, 40: 0.9}, ("letters", 2): {5: 0.2, 6: 0.25, 8: 0.5, 10: 0.65, 12: 0.8, 20: 0.9, 40: 0.9}, ("letters", 3): {8: 0.2, 10: 0.35, 12: 0.55, 20: 0.85, 40: 0.9}, ("words", 1): {8: 0.65, 10: 0.7, 12: 0.85, 20: 0.9, 40: 0.9}, ("words", 2): {20: 0.75, 40: 0.9}}


@pytest.mark.parametrize("others", [0, 30_000])
def test_line_recall_by_cell(spark, others):
    """Links found of all there are, by length and kind of change, whatever the number of other lines."""
    rng = random.Random(21)
    cells = [(n, kind, k, least) for (kind, k), by in CELLS.items() for n, least in by.items()]
    pairs = [p for n, kind, k, _ in cells for p in changed_lines(rng, n, kind, k, 60)]
    rows = [(2 * i + j, t) for i, p in enumerate(pairs) for j, t in enumerate(p)] + [(10_000 + i, text(9, rng)) for i in range(others)]
    got = {r.doc_id: r.group_id for r in lines.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for c, (n, kind, k, least) in enumerate(cells):
        found = [2 * i in got and got[2 * i] == got.get(2 * i + 1) for i in range(60 * c, 60 * c + 60)]
        assert sum(found) >= least * 60, (n, kind, k, sum(found) / 60)


@pytest.mark.parametrize("narrow", [96, 3])
def test_like_groups(monkeypatch, narrow):
    """Groups of like fingerprints inside buckets, narrow and wide, against brute force."""
    monkeypatch.setattr(lines, "NARROW", narrow)
    rng = np.random.default_rng(2)
    size = np.array([1, 2, 3, 4, 40, 150])
    mark = rng.integers(0, 2**63, size.sum()).astype(np.uint64)
    for i in range(1, len(mark)):  # chains of like ones, some in a row
        if rng.random() < 0.6:
            mark[i] = mark[i - 1 - rng.integers(0, min(i, 5))] ^ np.uint64(rng.integers(0, 2**12) << rng.integers(0, 51))
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    label = lines._groups(start, size, lines.Like([mark], np.full(len(mark), 50), 90))
    for s, n in zip(start, size, strict=True):
        part = mark[s : s + n]
        want = np.bitwise_count(part[:, None] ^ part) <= lines.FIRST_BITS
        for _ in range(8):
            want = want @ want
        assert ((label[s : s + n][:, None] == label[s : s + n]) == want).all()


def test_sizes_part_a_bucket():
    """In a bucket, nodes meet only those of a size that can be like theirs, not all others."""
    rng, met = np.random.default_rng(3), []

    class Counted(lines.Like):
        def pairs(self, i, j):
            met.append(len(i))
            return super().pairs(i, j)

        def ahead(self, reach, end):
            met.append(len(self.size) - reach)
            return super().ahead(reach, end)

        def table(self, i, j):
            met.append(len(i) * len(j))
            return super().table(i, j)

    size = np.repeat((10 * 1.2 ** np.arange(60)).astype(np.int64), 10)
    mark = rng.integers(0, 2**63, 600).astype(np.uint64)
    mark[5::10] = mark[4::10]
    label = lines._groups(np.array([0]), np.array([600]), Counted([mark], size, 90))
    assert (label[5::10] == label[4::10]).all() and len(set(label.tolist())) == 540
    assert sum(met) <= 12 * 600


def test_merged_lines():
    """One row a line: its number, the first place (unknown documents first) and the fingerprint that any of them has."""
    rows = np.zeros(5, lines.DISTINCT)
    rows["node"], rows["n"], rows["known"] = [7, 3, 7, 3, 7], [1, 2, 1, 1, 4], [1, 1, 1, 0, 1]
    rows["doc_id"], rows["line_no"], rows["printed"] = [5, 1, 4, 0, 4], [0, 3, 9, 8, 2], [0, 0, 0, 0, 1]
    rows["print"][4] = 11
    got = lines._merged(rows)
    assert got[["node", "n", "known", "doc_id", "line_no", "printed"]].tolist() == [(3, 3, 0, 0, 8, 0), (7, 6, 1, 4, 2, 1)]
    assert (got["print"][1] == 11).all() and not len(lines._merged(rows[:0]))


def test_short_lines(spark):
    """Lines under min_words: their exact copies go too where that is asked for, also those of scripts without spaces."""
    long = "\u8bad\u7ec3\u6570\u636e\u91cc\u91cd\u590d\u7684\u4e00\u884c" * 4
    rows = [(i, f"{text(20)}\nRead more!\n{long}\n---\n\nread  more") for i in range(3)] + [(9, f"{long}x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.line_no): (r.n_lines, r.removed) for r in lines.groups(df, short=True).collect()}
    assert got == {(i, n): (of, (i, n) not in {(0, 1), (0, 2)}) for i in range(3) for n, of in ((1, 6), (2, 3), (5, 6))}
    out = {r.doc_id: r.text for r in lines.dedup(df, short=True).collect()}
    assert out[1] == rows[1][1].split("\n")[0] + "\n---\n" and out[9] == f"{long}x"


def test_passages(spark):
    rng = random.Random(12)
    shared, short = text(70, rng), text(14, rng)
    rows = [(i, f"{text(30, rng)} {shared if i % 2 else ''} {text(30, rng)}\n{short}") for i in range(24)]
    line = text(90, rng)
    rows += [(100 + i, f"{text(20, rng)}\n{edited(line, i % 2, rng)}") for i in range(6)] + [(200, None), (201, ""), (202, short)]
    rows += [(300, f"{(own := text(40, rng))} {own}")]  # repeats itself only
    df = spark.createDataFrame([(i, t, "r", "s") for i, t in rows], "doc_id long, text string, row string, spans_ string")
    got = passages.spans(df).toPandas()
    assert set(got.doc_id) == {i for i in range(24) if i % 2} | set(range(100, 106))
    assert set(got[got.removed].doc_id) >= {i for i in range(2, 24) if i % 2}
    for r in got[got.doc_id < 24].itertuples():
        w = re.findall(r"[a-z]+", dict(rows)[r.doc_id])[r.first_word : r.end_word]
        assert " ".join(w) in shared and len(w) >= 32
    out = {r.doc_id: r.text for r in passages.dedup(df).collect()}
    assert out[1] == rows[1][1] and len(out[3]) < len(rows[3][1]) - 100 and out[0] == rows[0][1] and out[200] is None
    assert passages.spans(df.limit(0)).count() == 0


def test_sellers_distance():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rng.choice("ab ") for _ in range(rng.randint(1, 25))) for _ in range(2))
        best = min((levenshtein(a, b[i:j]) for i in range(len(b) + 1) for j in range(i, len(b) + 1)))
        assert decontam.distance(a, b)[0] == best


@pytest.mark.parametrize("block", [20_000, 3])
def test_decontamination(spark, block):
    rng = random.Random(21)
    items = [(i, text(n, rng)) for i, n in enumerate([40, 25, 60, 12, 9, 18, 4, 2])] + [(90, None), (91, "..."), (92, "")]
    rows, want = [], set()
    for k, (i, t) in enumerate(items[:8]):
        rows.append((k, f"{text(50, rng)} {t.upper()}!! {text(50, rng)}"))
        want.add((k, i))
    for k, (i, t) in enumerate(items[:3]):
        rows.append((20 + k, f"{text(33, rng)} {edited(t, 2, rng)} {text(10, rng)}"))
        want.add((20 + k, i))
    rows += [(50, items[0][1]), (51, None), (52, ""), (53, text(5000, rng)), (54, items[2][1] + " " + items[2][1])]
    want |= {(50, 0), (54, 2)}
    bench = spark.createDataFrame([(i, t, "d") for i, t in items], "item_id long, text string, doc_id string")
    docs = spark.createDataFrame([(i, t, "b") for i, t in rows], "doc_id long, text string, item_id string")
    got = decontam.matches(docs, bench, block=block).collect()
    long = {(r.doc_id, r.item_id) for r in got if r.item_id not in (6, 7)}
    assert long >= {w for w in want if w[1] not in (6, 7)} and all(r.similarity >= 0.8 for r in got)
    assert {(6, 6), (7, 7)} <= {(r.doc_id, r.item_id) for r in got}
    assert 53 not in {r.doc_id for r in got if r.item_id < 6}
    kept = {r.doc_id for r in decontam.clean(docs, bench).collect()}
    assert 51 in kept and 50 not in kept and 0 not in kept
    assert decontam.matches(docs.limit(0), bench).count() == 0 and decontam.matches(docs, bench.limit(0)).count() == 0


def test_items_without_id(spark):
    items = [(None, text(20)), (3, text(20)), (None, text(9)), (None, None)]
    docs = spark.createDataFrame([(i, f"{text(5)} {t}") for i, (_, t) in enumerate(items)], "doc_id long, text string")
    got = decontam.matches(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(0, None), (1, 3), (2, None)}


def test_decontamination_recall(spark):
    """A fifth of the words replaced: what the brute-force scan finds at similarity 0.8 is found at the stated recall."""
    rng = random.Random(31)
    items, rows = [], []
    for m in (3, 5, 7, 8, 10, 15, 16, 20, 30):
        for _ in range(40):
            t = text(m, rng)
            w = t.split()
            for i in rng.sample(range(m), max(1, m // 5)):
                w[i] = rng.choice(VOCAB)
            items.append((len(items), t))
            rows.append((len(rows), f"{text(rng.randint(8, 15), rng)} {' '.join(w)} {text(12, rng)}"))
    want = {i for (i, t), (_, d) in zip(items, rows, strict=True) if decontam.distance(t, d)[0] <= int(0.2 * len(t) + 1e-9)}
    got = {r.doc_id for r in decontam.matches(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect() if r.doc_id == r.item_id}
    assert len(want) > 100
    for k, m in enumerate((3, 5, 7, 8, 10, 15, 16, 20, 30)):
        of = {i for i in want if i // 40 == k}
        assert len(of & got) >= 0.9 * len(of), (m, len(of & got), len(of))
    assert len(want & got) >= 0.95 * len(want)
