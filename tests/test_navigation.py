"""Backward search, point navigation, the cursor, trees by ranges, and long texts, on tiny texts against their definitions."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.functions import symbols as fn
from textloom.operators import approx, index, mining, navigate, search, sequence, tree
from textloom.plans import catalog
from textloom.sources import tables

RNG = random.Random(7)
TEXTS = ["", "a", "aaaa", "banana", "mississippi", "éàéà", "a\nb c\nb", "".join(RNG.choices("abé", k=700)), "ab" * 300]
KEYS = ["", "a", "an", "ab", "is", "é", "ba", "zz", "abab"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string").cache()


@pytest.fixture(scope="module")
def built(docs):
    return index.build_index(docs).cache()


@pytest.fixture(scope="module")
def known(spark, built, tmp_path_factory):
    """Rank blocks that were stored and are read again."""
    found, root = search.ranks(built), tmp_path_factory.mktemp("ranks")
    tables.save_index(found.blocks, str(root / "blocks"), order="block")
    tables.save_index(found.heads, str(root / "heads"), order="n")
    return search.Ranks(*(tables.load_index(spark, str(root / x)) for x in ("blocks", "heads")))


def sa(text):
    return sorted(range(len(text) + 1), key=lambda i: text[i:])


def span(text, p):
    rows = [r for r, k in enumerate(sa(text)) if text.startswith(p, k)]
    return (rows[0], rows[-1]) if rows else None


def by_id(df, *columns):
    out = {}
    for row in df.collect():
        out.setdefault(row["id"], []).append(tuple(row[c] for c in columns))
    return {k: sorted(v) for k, v in out.items()}


def test_backward_search_over_many_blocks(built, known):
    got = by_id(search.search_range(built, None, KEYS, known), "pattern", "l", "r")
    for i, t in enumerate(TEXTS):
        assert got.get(i, []) == sorted((k, *span(t, k)) for k in KEYS if span(t, k))
    plan = search.search_range(built, None, ["ab"], known)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "text" not in plan and plan.count("Join ") == 2


def test_packed_index_and_search(spark, docs, tmp_path):
    wide = ["".join(chr(0x4E00 + RNG.randrange(400)) for _ in range(3000)), "\U0010ffffa𝒳" * 90 + "a", "abab" * 256]
    texts = [*TEXTS, *wide]
    keys = [*KEYS, wide[0][1500:1503], wide[0][-1], "𝒳\U0010ffff", "\U0010ffff"]
    tables.save_packed(index.pack_index(spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(2)), str(tmp_path / "packed"))
    packed = tables.load_index(spark, str(tmp_path / "packed"))
    found = search.search_packed(packed, keys)
    got = by_id(found, "pattern", "l", "r")
    for i, t in enumerate(texts):
        assert got.get(i, []) == sorted((k, *span(t, k)) for k in keys if span(t, k))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "Arrow" not in plan
    assert search.search_packed(packed, []).count() == 0
    for r in packed.collect():  # every symbol of the last column, the end left out, and as many counts as a fourth of the symbols
        t = texts[r.id]
        assert "".join(r.bws) == "".join(t[p - 1] for p in sa(t) if p) and sa(t)[r.last] == 0 and r.n == len(t)
        assert len(r.before) == len(r.bws) * len(r.syms) <= len(t) / 4 + len(r.syms)


def test_suffixes_of_many_texts_in_one_sort():
    for texts in (["", ""], TEXTS, ["ab" * 300, "", "ab" * 301, "ba" * 300, "a" * 999], ["a"] * 70 + ["é𝒳\U0010ffff"]):
        order, a = index.sort_texts(index._codes("".join(texts)), np.array([*map(len, texts)])), 0
        for t in texts:
            assert (order[a : a + len(t) + 1] - a).tolist() == sa(t)
            a += len(t) + 1


def test_search_of_documents_writes_less_than_its_budget(spark, sf_dir, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "shared_dir", lambda _: str(tmp_path))
    for kept in ("_STORED", "_PACKED"):
        monkeypatch.setattr(catalog, kept, {}, raising=False)
    short = by_id(catalog.search_range_documents(spark, sf_dir), "pattern", "l", "r")
    assert sum(p.stat().st_size for p in tmp_path.rglob("*.parquet")) < 4 * os.path.getsize(f"{sf_dir}/documents.parquet")
    # texts over LOCAL_SYMBOLS have rank blocks and the same ranges
    lengths = sorted(r.n for r in catalog.corpus(spark, sf_dir).select(F.length("text").alias("n")).collect())
    monkeypatch.setattr(index, "LOCAL_SYMBOLS", lengths[-3])
    monkeypatch.setattr(catalog, "_PACKED", {})
    assert by_id(catalog.search_range_documents(spark, sf_dir), "pattern", "l", "r") == short
    assert catalog.held_corpus(spark, sf_dir)[1].heads.count() == sum(n > lengths[-3] for n in lengths) > 0


def test_ranks_at_points_and_everywhere(built, known):
    points = [(-1, "a"), (0, "a"), (300, "a"), (300, "é"), (599, "b"), (3, "z")]
    got = by_id(navigate.rank_at(built, points, known), "r", "sym", "occ")
    every = by_id(navigate.rankc(built, "a"), "r", "occ")
    for i, t in enumerate(TEXTS):
        bw = [t[p - 1] if p else None for p in sa(t)]
        assert got[i] == sorted((r, c, bw[: r + 1].count(c)) for r, c in points if r <= len(t))
        assert every[i] == [(r, bw[: r + 1].count("a")) for r in range(len(t) + 1)]


def test_extensions_and_children_both_ways(built, docs, known):
    nodes = search.nodes(built, docs, KEYS, known)
    left, right = (by_id(search.child(nodes, built, side, known), "key", "sym", "l", "r") for side in (True, False))
    for i, t in enumerate(TEXTS):
        have = [k for k in KEYS if span(t, k)]
        assert left.get(i, []) == sorted((k, c, *span(t, c + k)) for k in have for c in set(t) if span(t, c + k))
        assert right.get(i, []) == sorted((k, c, *span(t, k + c)) for k in have for c in set(t) if span(t, k + c))


def test_parents_and_links_from_ranges(built, docs, known):
    lcp = tree.lcp_array(built, docs)
    nodes = search.nodes(built, docs, KEYS, known)
    up, link = by_id(tree.parents(nodes, lcp), "key", "l", "r"), by_id(tree.suffix_links(nodes, built, lcp), "key", "l", "r")
    canon = by_id(tree.canonize(nodes, built, docs, lcp), "key", "depth")
    for i, t in enumerate(TEXTS):
        have = [k for k in KEYS if k and span(t, k)]
        assert up.get(i, []) == sorted((k, *span(t, k[:-1])) for k in have)
        assert link.get(i, []) == sorted((k, *span(t, k[1:])) for k in have)
        rows = sa(t)
        for k, depth in canon[i]:
            l, r = span(t, k)
            label = t[rows[l] : rows[l] + depth]
            assert span(t, label) == (l, r) and (l == r and rows[l] + depth == len(t) or any(not t.startswith(t[rows[l] : rows[l] + depth + 1], rows[x]) for x in (l, r)) or rows[l] + depth == len(t))
    assert by_id(tree.all_nodes(built, docs, 2), "label", "l", "r") == {i: sorted((s, *span(t, s)) for s in {t[a : a + n] for n in range(3) for a in range(len(t) + 1)}) for i, t in enumerate(TEXTS)}


def test_node_predicates(spark):
    nodes = spark.createDataFrame([(1, 2, 3, 3), (1, -1, 1, 0), (1, None, 1, 2)], "id long, depth long, l long, r long")
    got = nodes.select(tree.is_null().alias("none"), tree.is_leaf().alias("leaf"), F.struct("id", "depth", "l", "r").alias("a")).withColumn("same", tree.same("a", "a")).collect()
    assert [(r.none, r.leaf, r.same) for r in got] == [(False, True, True), (True, False, True), (True, False, True)]


def test_windows_and_extraction(built, docs):
    part, left = by_id(navigate.substring_rank(built, docs, 3), "r", "part"), by_id(navigate.left_context(built, docs, 3), "r", "part")
    some, more = by_id(navigate.text_range(docs, 2, 4), "part"), by_id(navigate.extract(docs, 2, 4), "part")
    for i, t in enumerate(TEXTS):
        assert part[i] == sorted((r, t[p : p + 3]) for r, p in enumerate(sa(t)))
        assert left[i] == sorted((r, t[max(0, p - 3) : p]) for r, p in enumerate(sa(t)))
        assert some[i] == [(t[2:5],)] and more.get(i, []) == ([(t[2:5],)] if len(t) > 2 else [])


def test_cursor(built):
    cursor = navigate.Cursor(built)
    assert by_id(cursor.here(), "pos", "r")[3] == [(0, span("banana", "banana")[0])]
    assert [c for _, c in by_id(cursor.peek(2), "pos", "ch")[3]] == [c for _, c in by_id(cursor.read(2), "pos", "ch")[3]] == ["b", "a"]
    assert by_id(cursor.read(9), "pos", "ch")[3] == [(2, "n"), (3, "a"), (4, "n"), (5, "a")] and cursor.pos == 11
    assert by_id(cursor.seek(3).read_back(2), "pos", "bw")[3] == [(2, "a"), (3, "n")] and cursor.pos == 1
    assert by_id(cursor.peek_back(5), "pos", "bw")[3] == [(1, "b")] and cursor.pos == 1
    assert by_id(navigate.lookup(built, [0, 3]), "r", "pos")[3] == [(0, 6), (3, 1)] and by_id(navigate.inverse(built, [6]), "pos", "r")[3] == [(6, 0)]


def test_samples_sizes_and_checks(built):
    assert by_id(navigate.sample(built, 4, "pos"), "pos")[3] == [(0,), (4,)]
    assert {i: w for i, ((w,),) in by_id(index.check(built), "wrong").items()} == {i: 0 for i in range(len(TEXTS))}
    broken = built.withColumn("lf", F.when((F.col("id") == 3) & (F.col("r") == 2), 0).otherwise(F.col("lf")))
    assert by_id(index.check(broken), "wrong")[3] == [(1,)]
    assert by_id(index.sizes(built), "n_rows", "bw_bytes")[5] == [(5, 8)]


def test_long_texts_take_the_path_over_executors(docs, built, monkeypatch):
    monkeypatch.setattr(index, "LOCAL_SYMBOLS", 5)
    assert by_id(index.build_index_any(docs), "r", "pos", "lf", "psi") == by_id(built, "r", "pos", "lf", "psi")
    symbols = by_id(index.build_index_any(docs).select("id", "r", F.coalesce("ch", F.lit("")).alias("ch"), F.coalesce("bw", F.lit("")).alias("bw")), "r", "ch", "bw")
    assert symbols == by_id(built.select("id", "r", F.coalesce("ch", F.lit("")).alias("ch"), F.coalesce("bw", F.lit("")).alias("bw")), "r", "ch", "bw")


def test_running_sums_hold_no_id_in_one_task(spark):
    rows = spark.range(1000).select(F.lit(1).cast("long").alias("id"), F.col("id").alias("x"), F.lit(2).alias("n"))
    summed = index.running(rows, ["x"], "n", "before")
    assert {r.x: r.before for r in summed.collect()} == {i: 2 * i for i in range(1000)}
    plan = summed._jdf.queryExecution().optimizedPlan().toString()
    assert all("_range" in line for line in plan.split("\n") if line.strip(" +-:").startswith("Window [sum(n"))


def test_rank_of_a_sequence_without_ones_is_zero(spark):
    vector = spark.createDataFrame([(1, 0, 1), (1, 1, 0), (2, 0, 0)], "id long, i long, bit long")
    assert by_id(sequence.sparse_rank(sequence.sparse(vector), [0, 5], vector), "i", "rank1") == {1: [(0, 1), (5, 1)], 2: [(0, 0), (5, 0)]}
    seq = vector.withColumnRenamed("bit", "sym")
    assert by_id(sequence.check(seq), "wrong") == {1: [(0,)], 2: [(0,)]}


def test_distances_step_by_step(spark):
    rng = random.Random(2)

    def far(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    for _ in range(5):
        query = "".join(rng.choices("ab", k=rng.randint(0, 5)))
        words = ["".join(rng.choices("abc", k=3)) for _ in range(6)]
        row = approx.first_row(query)
        df = spark.createDataFrame([(w,) for w in words], "w string")
        for k in (1, 2, 3):
            row = approx.next_row(row, F.substring("w", k, 1), query)
        assert [r.d for r in df.select(row.alias("d")).collect()] == [[far(w, query[:j]) for j in range(len(query) + 1)] for w in words]
    for _ in range(60):
        a, b = ("".join(rng.choices("ab", k=rng.randint(0, 6))) for _ in range(2))
        assert approx.align(a, b).count("[") == far(a, b)


def test_local_minima_by_walking(docs, built):
    """The walk from each hit's first row over its neighbours in the text, a row at a time."""
    k, query = 1, "banana"
    hits = [tuple(r) for r in approx.search(built, docs, [query], k).select("id", "error", "len", "l", "r").collect()]
    want = []
    for i, t in enumerate(TEXTS):
        mine = [h for h in hits if h[0] == i]
        least = {}
        for _, e, n, l, r in sorted(mine, key=lambda h: (h[1], h[2])):
            least.setdefault((l, r), (e, n))
        start = {}
        for (l, r), (e, _) in sorted(least.items()):
            start[l] = e  # of ranges that start at a row the largest comes last
        rows = sa(t)
        where = {p: r for r, p in enumerate(rows)}
        for (l, r), (e, n) in least.items():
            better = False
            for step in (-1, 1):
                p = rows[l]
                for _ in range(k + 1):
                    if where.get(p) not in start:
                        break
                    better |= start[where[p]] < e
                    p += step
            if not better:
                want.append((i, e, n, l, r))
    got = [tuple(r) for r in approx.local_minima(approx.search(built, docs, [query], k), built, k).select("id", "error", "len", "l", "r").collect()]
    assert sorted(got) == sorted(want) and (3, 0, 6, *span("banana", "banana")) in got


def test_mining_guards_and_frequencies(docs):
    with pytest.raises(ValueError):
        mining.approx_frequent(docs, 2, 2, 1)
    want = {}
    for t in TEXTS:
        for n in (1, 2):
            for a in range(len(t) - n + 1):
                want[t[a : a + n]] = want.get(t[a : a + n], 0) + 1
    assert {r.gram: r.occ for r in mining.substring_freq(docs, 2).collect()} == want
    assert {(r.sym, r.freq) for r in index.symbol_freq(docs).where("id = 4").collect()} == {("m", 1), ("i", 4), ("s", 4), ("p", 2)}


def test_words_and_files(spark, built, tmp_path):
    x = F.col("x")
    df = spark.createDataFrame([(0,), (5,), (258,)], "x long")
    got = df.select(fn.with_bit(x, 63, 1), fn.with_bit(x, 61, 0), fn.as_little_endian(x, 2), fn.from_little_endian(fn.as_little_endian(x, 2), 2)).collect()
    assert [tuple(r) for r in got] == [(1, 0, b"\0\0", 0), (5, 1, b"\5\0", 5), (259, 258, b"\2\1", 258)]
    wrote = {r.id: (bytes(r.symbols), r.last) for r in tables.bwt_bytes(built.select("id", "r", "bw")).collect()}
    assert wrote[3] == (b"annbaa", 4) and wrote[0] == (b"", 0)
    (tmp_path / "x.bw").write_bytes(wrote[4][0])
    (tmp_path / "x.lst").write_text(str(wrote[4][1]))
    assert index.inverse_bwt(tables.read_bwt(spark, str(tmp_path / "x.bw"), str(tmp_path / "x.lst"))).head().text == "mississippi"
