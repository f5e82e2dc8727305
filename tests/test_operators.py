"""Operators on tiny texts against their definitions."""

import random

import pytest
from pyspark.sql import functions as F

from textloom.functions import symbols as fn
from textloom.operators import approx, index, mining, search, sequence, tree
from textloom.sources import tables
from textloom.streaming.counts import count_stream

TEXTS = ["", "a", "aaaa", "banana", "mississippi", "abcdefgh", "acgtacgt$", "0110100110010110", "éàéà", "banana", "a\nb c\nb"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string").cache()


@pytest.fixture(scope="module")
def built(docs):
    return index.build_index(docs).cache()


def by_id(df, *columns):
    out = {}
    for row in df.collect():
        out.setdefault(row["id"], []).append(tuple(row[c] for c in columns))
    return {k: sorted(v) for k, v in out.items()}


def sa(text):
    return sorted(range(len(text) + 1), key=lambda i: text[i:])


def test_three_ways_of_sorting_suffixes_agree(docs, built):
    want = {i: list(enumerate(sa(t))) for i, t in enumerate(TEXTS)}
    for got in (built, index.suffix_array(docs), index.suffix_array_doubling(docs)):
        assert by_id(got, "r", "pos") == want


def test_navigation_identities(built):
    for i, rows in by_id(built, "r", "pos", "lf", "psi").items():
        lf, psi = {r: x for r, _, x, _ in rows}, {r: x for r, _, _, x in rows}
        assert all(lf[psi[r]] == r for r in lf)
        at = {r: p for r, p, _, _ in rows}
        assert all(at[lf[r]] == (at[r] - 1 if at[r] else len(TEXTS[i])) for r in at)


def test_lf_and_texts_from_the_bwt_alone(built):
    bwt = built.select("id", "r", "bw")
    assert by_id(index.lf_from_bwt(bwt), "r", "lf") == by_id(built, "r", "lf")
    assert by_id(index.inverse_bwt(bwt), "text") == {i: [(t,)] for i, t in enumerate(TEXTS)}
    assert by_id(index.unbwt(built), "text") == {i: [(t,)] for i, t in enumerate(TEXTS)}
def test_index_by_joins(docs, built):
    assert by_id(index.finish(index.suffix_array(docs), docs), "r", "lf", "psi") == by_id(built, "r", "lf", "psi")


def test_counting_and_locating_overlaps_and_odd_patterns(docs):
    patterns = ["a", "aa", "ana", "issi", "", "é", "a\nb", "\\E", "$", "."]
    count, where = by_id(search.count_patterns(docs, patterns), "pattern", "occ"), by_id(search.locate_patterns(docs, patterns), "pattern", "pos")
    for i, t in enumerate(TEXTS):
        hits = sorted((p, k) for p in patterns for k in range(len(t) + 1) if t.startswith(p, k))
        assert where.get(i, []) == hits
        assert count[i] == sorted((p, sum(q == p for q, _ in hits)) for p in patterns)


def test_ranges_and_extensions(docs, built):
    keys = ["a", "an", "s", "is", "", "é"]
    nodes = search.nodes(built, docs, keys)
    left, right = by_id(search.search_left(nodes, built), "key", "sym", "l", "r"), by_id(search.search_right(nodes, built, docs), "key", "sym", "l", "r")

    def span(t, p):
        rows = [r for r, k in enumerate(sa(t)) if t.startswith(p, k)]
        return (rows[0], rows[-1]) if rows else None

    for i, t in enumerate(TEXTS):
        have = [k for k in keys if span(t, k)]
        assert left.get(i, []) == sorted((k, c, *span(t, c + k)) for k in have for c in set(t) if span(t, c + k))
        assert right.get(i, []) == sorted((k, c, *span(t, k + c)) for k in have for c in set(t) if span(t, k + c))
    assert by_id(search.max_match(docs, ["xana", "issi"]), "pattern", "matched")[3] == [("issi", 0), ("xana", 3)]


def test_trees(docs, built):
    def common(a, b):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        return n

    got = by_id(tree.lcp_array(built, docs), "r", "lcp")
    for i, t in enumerate(TEXTS):
        order = sa(t)
        assert got[i] == [(r, common(t[order[r - 1]:], t[order[r]:]) if r else 0) for r in range(len(order))]
    canon = {x[0]: x for x in by_id(tree.canonize(search.nodes(built, docs, ["a", "i", "is"]), built, docs), "key", "depth")[4]}
    assert canon["is"] == ("is", 4) and canon["i"] == ("i", 1)
    kids = by_id(tree.children(search.nodes(built, docs, ["a"]), built, docs), "nth", "sym")[3]
    assert kids == [(1, None), (2, "n")]


def test_mining_against_recursion(docs):
    least = 2
    texts = [t for t in TEXTS]
    subs = {t[i:j] for t in texts for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    occ = {s: sum(t.startswith(s, k) for t in texts for k in range(len(t))) for s in subs}
    often = {s for s in subs if occ[s] >= least}
    got = mining.frequent(docs, least)
    assert {r.gram: r.occ for r in got.collect()} == {s: occ[s] for s in often}
    assert {r.gram for r in mining.left_maximal(got).collect()} == {s for s in often if not any(c + s in often for c in set("".join(texts)))}
    assert {r.gram for r in mining.right_maximal(got).collect()} == {s for s in often if not any(s + c in often for c in set("".join(texts)))}
    with pytest.raises(ValueError):
        mining.frequent(docs, 0)


def test_approximate_search_two_ways_and_local_minima(docs, built):
    plain, seeded = (by_id(f(built, docs, ["anna", "missi"], 2), "query", "error", "len", "l", "r") for f in (approx.search, approx.search_seeded))
    assert plain == seeded and plain[3]
    low = by_id(approx.local_minima(approx.search(built, docs, ["banana"], 1), built, 1), "error", "len")
    assert low[3] == [(0, 6)]


def test_alignment():
    assert approx.align("kitten", "sitting") == "[ks]itt[ei]n[-g]"
    rng = random.Random(1)
    for _ in range(50):
        a, b = ("".join(rng.choices("ab", k=rng.randint(0, 6))) for _ in range(2))
        shown = approx.align(a, b)
        import re

        cells = re.findall(r"\[(.)(.)\]|(.)", shown)
        assert "".join(x or z for x, _, z in cells).replace("-", "") == a
        assert "".join(y or z for _, y, z in cells).replace("-", "") == b


def test_prefix_codes():
    freq = [("a", 45), ("b", 13), ("c", 12), ("d", 16), ("e", 9), ("f", 5)]
    lengths = sequence.code_lengths(freq)
    assert sum(n * lengths[s] for s, n in freq) == 224 and sum(2.0 ** -x for x in lengths.values()) == 1
    assert sequence.code_lengths([("x", 3)]) == {"x": 1}
    fib = [1, 1]
    while len(fib) < 40:
        fib.append(fib[-1] + fib[-2])
    assert max(sequence.code_lengths([(chr(100 + i), f) for i, f in enumerate(fib)]).values()) <= 32


def test_column_functions(spark):
    df = spark.createDataFrame([(0,), (1,), (5,), (1 << 40,), (-1,)], "x long")
    got = df.select(fn.popcount(F.col("x")), fn.blog(F.col("x")), fn.bit_at(F.col("x"), 63)).collect()
    assert [tuple(r) for r in got] == [(0, -1, 0), (1, 0, 1), (2, 2, 1), (1, 40, 0), (64, None, 1)]
    text = spark.createDataFrame([("aCgT",), ("$N",), ("n",), ("01",)], "t string")
    got = text.select(fn.dna_codes(F.col("t")), fn.dna2_codes(F.col("t")), fn.bit_codes(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [("0123", "1234", None), (None, "00", None), (None, None, None), (None, None, "01")]


def test_sources(spark, tmp_path, built):
    (tmp_path / "s.bin").write_bytes(bytes([1, 0, 255, 1]))
    assert [r.sym for r in tables.read_symbols(spark, str(tmp_path / "s.bin"), 2).orderBy("i").collect()] == [1, 511]
    (tmp_path / "t.txt").write_text("naïve")
    assert tables.read_text_files(spark, str(tmp_path / "t.txt")).head().text == "naïve"
    tables.save_index(built, str(tmp_path / "idx"))
    assert by_id(tables.load_index(spark, str(tmp_path / "idx")), "r", "pos") == by_id(built, "r", "pos")


def test_texts_from_bwt_files(spark, tmp_path):
    (tmp_path / "x.bw").write_bytes(b"annbaa")  # of banana, without the row of the end
    (tmp_path / "x.lst").write_text("4")
    bwt = tables.read_bwt(spark, str(tmp_path / "x.bw"), str(tmp_path / "x.lst"), size=256)
    assert by_id(index.inverse_bwt(bwt), "text") == {0: [("banana",)]}
    with pytest.raises(Exception, match="symbol out of range"):
        tables.read_bwt(spark, str(tmp_path / "x.bw"), str(tmp_path / "x.lst"), size=98).collect()


def test_stream_of_texts(spark, tmp_path, docs):
    docs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    count_stream(stream, ["a"], str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert by_id(spark.read.parquet(str(tmp_path / "out")), "occ") == by_id(search.count_patterns(docs, ["a"]), "occ")
