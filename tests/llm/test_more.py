"""Operators against SQL and brute force, held-out labels, and odd rows: collisions, null and repeated ids, clashing names, long texts."""

import collections
import html
import random
import re
import zlib

import numpy as np
import oracle
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from textloom.llm import chat, html_text, kernels, langid, neardup, oracles, packing, quality_rules, quality_trees, queries, repeats, scratch, sentencepieces, stats, topk  # noqa: E402

SF = "/root/testdata/sf0.01"
#: Names that operators use inside.
CLASHING = ("score", "n_words", "kept", "id", "key", "node", "starts", "_key", "_id", "copies", "regs", "base_failed", "_column_0", "text_", "_label", "lang_pred", "n_bytes")


@pytest.mark.parametrize("name", [n for n in oracles.ORACLES if n != "op2_quality_rules"])
def test_rows_are_those_of_the_sql(spark, sf_dir, name):
    assert oracle.differences(queries.QUERIES[name](spark, sf_dir), oracle.connect(sf_dir), oracles.ORACLES[name]) == ""


def test_rules_and_counts_are_those_of_the_sql(spark):
    assert oracle.differences(queries.op2_quality_rules(spark, SF), oracle.connect(SF), oracles.OP2) == ""


def thue_morse(n):
    word = "".join("ab"[bin(i).count("1") & 1] for i in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_words_that_collide_in_polynomials_modulo_powers_of_two_differ(spark):
    one, two = thue_morse(1024)
    rows = [(1, f"a b c d {one}"), (2, f"a b c d {two}"), (3, f"a b c d {one}\na b c d {two}"), (4, f"{one}\n{two}"), (5, f"{one}\n{one}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs).collect()}
    assert got == {i: i for i in range(1, 6)}
    counted = {r.doc_id: (r.n_repeat_words, r.n_dup_lines) for r in stats.with_counts(docs, "text", ["doc_id"]).collect()}
    assert counted == {1: (0, 0), 2: (0, 0), 3: (0, 0), 4: (0, 0), 5: (0, 1)}


def test_digests_and_windows_tell_bytes_apart():
    rng = random.Random(2)
    words = sorted({"".join(rng.choices("ab", k=rng.randint(1, 40))) for _ in range(3000)} | {"a" * n for n in range(1, 600)})
    data, off = kernels.buffers(pa.array([" ".join(words)]))
    s, e, _ = kernels.word_bounds(data, off)
    code, distinct = kernels.dictionary(data, s, e)
    assert len(set(kernels.digests(data, s, e).tolist())) == len(set(code.tolist())) == len(distinct) == len(words)
    twice = np.concatenate([data, np.frombuffer(b" ", np.uint8), data])
    s2, e2, _ = kernels.word_bounds(twice, np.array([0, len(twice)]))
    h = kernels.digests(twice, s2, e2)
    assert (h[: len(words)] == h[len(words) :]).all()
    roll = kernels.Rolling(1)
    at = np.arange(len(twice) - 50)
    seen = collections.defaultdict(set)
    for i, x in zip(at.tolist(), roll.windows(roll.sums(twice), at, at + 50).tolist()):
        seen[x].add(twice[i : i + 50].tobytes())
    assert all(len(v) == 1 for v in seen.values())


def test_tuples_are_exact_for_large_codes():
    rng = np.random.default_rng(3)
    code = rng.integers(0, 3, 500) * (1 << 40)
    got = kernels.tuples(code, 5)
    want = [tuple(code[i : i + 5]) for i in range(496)]
    assert len(set(zip(got.tolist(), want))) == len(set(want)) == len(set(got.tolist()))


def test_equal_hashes_are_told_apart_by_their_check():
    order, new = repeats._grouped(np.array([7, 7, 7, 9], np.uint64), np.array([1, 2, 1, 1], np.uint32))
    assert sorted(np.diff(np.append(np.flatnonzero(new), 4)).tolist()) == [1, 1, 2] and set(order.tolist()) == {0, 1, 2, 3}


def test_suffix_dedup_with_null_and_repeated_ids(spark):
    rng = random.Random(4)
    shared = "".join(rng.choices("abcdefgh", k=120))
    texts = ["".join(rng.choices("abcdefgh", k=200)) for _ in range(4)]
    rows = [(None, texts[0] + shared), (None, texts[1]), (5, texts[2]), (5, shared + texts[3]), (6, texts[1]), (6, texts[1]), (7, None), (None, "")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, kept int")
    got = sorted((str(r.doc_id), bytes(r.kept).decode()) for r in repeats.cut_repeats(docs, length=100).collect())
    assert got == sorted([("None", texts[0]), ("None", ""), ("5", texts[2]), ("5", texts[3]), ("6", ""), ("6", ""), ("7", ""), ("None", "")])


def test_queries_of_odd_rows_are_whole(spark):
    schema = "vec_id long, embedding array<float>, score int, rank int, part int, id int"
    for rows in ([(20, None), (20, [1.0]), (21, [1.0])], [(20, [1.0]), (20, None), (21, [1.0])], [(20, [float("nan")]), (21, [1.0]), (20, [1.0])]):
        got = topk.top_k(spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], schema)).collect()
        assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got] == [(20, 1, 21, 64 * 64)]
    rows = [(20, [2.0, 1.0]), (20, [1.0, 5.0]), (21, [1.0, 0.0]), (21, [0.0, 1.0]), (22, [1e30, 1e30]), (23, [-1e30, 0.0])]
    got = topk.top_k(spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], schema)).collect()
    most = 2**63 - 1
    assert sorted((r["rank"], r.vec_id, r.score) for r in got) == [(1, 22, most), (2, 21, 64 * 64 * 5), (3, 21, 64 * 64), (4, 23, -most)]


def test_top_k_over_many_groups(spark, monkeypatch):
    for name, n in (("SHARD_ROWS", 16), ("LEAF_ROWS", 4), ("QUERY_ROWS", 3), ("GROUP_SHARDS", 2), ("GROUP_BLOCKS", 2)):
        monkeypatch.setattr(topk, name, n)
    x = np.random.default_rng(5).normal(0, 1, (300, 4)).astype(np.float32)
    docs = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    q = np.floor(64 * x.astype(float)).astype(int)
    got = collections.defaultdict(list)
    for r in sorted(topk.top_k(docs, k=5, every=20).collect(), key=lambda r: (r.query_id, r["rank"])):
        got[r.query_id].append((r.vec_id, r.score))
    for i in range(0, 300, 20):
        want = sorted(((int(q[j] @ q[i]), j) for j in range(300) if j != i), key=lambda p: (-p[0], p[1]))[:5]
        assert got[i] == [(j, s) for s, j in want]


def test_ids_are_those_of_the_library_as_it_comes(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = ["a <|endoftext|> b<|endoftext|><|endoftext|>  c", " " * 400_000, "\n" * 300_000 + "x <|endoftext|>", "<|endoftext|>" + " " * 350_000, "", None, "plain words"]
    docs = spark.createDataFrame([(None if i % 2 else 3, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, start int")
    got = collections.Counter()
    by = collections.defaultdict(list)
    for r in packing.pack(docs.coalesce(1), path, added_tokens=True).collect():
        by[r.doc_id, r.doc_tokens].append((r.start, bytes(r.ids)))
    for pieces in by.values():
        got[b"".join(x for _, x in sorted(pieces))] += 1
    want = [np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes() for t in texts]
    assert set(got) >= {w for w in want if len(w) > 40}
    assert sum(len(k) for _, v in by.items() for _, k in v) == sum(map(len, want))


def test_pieces_are_cut_only_where_none_has_room():
    rng = random.Random(6)
    lengths = [rng.randint(1, 1023) for _ in range(300)]
    out = packing.assign(lengths)
    room = [1024 - sum(n for _, _, n in s) for s in out]
    assert min(room) >= 0 and sum(room) < 1024
    # the first sequences hold one long piece each: the cheapest is an empty one as long as there is any
    first = sorted(range(300), key=lambda i: (-lengths[i], i))[: len(out)]
    assert all(s[0][0] in first and s[0][1] == 0 and s[0][2] == lengths[s[0][0]] for s in out)


def planted(page):
    """The text of the one article, by regular expressions instead of parser, ratios and clusters."""
    inside = re.search(r"<article>(.*)</article>", page, re.S)[1]
    return " ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"</?(p|br|h1|div|ul|li)[^>]*>", " ", inside))).split())


def test_main_text_of_every_page_and_clusters_on_each(spark, monkeypatch):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    judged = []
    whole = html_text.content_lines
    monkeypatch.setattr(html_text, "content_lines", lambda ratios: judged.append(len(ratios)) or whole(ratios))
    assert all(html_text.extract(p.html) == planted(p.html) for p in pages)
    assert len(judged) >= len(pages)


def test_clusters_are_those_of_a_plain_split():
    rng = random.Random(8)
    for _ in range(50):
        r = np.array([rng.choice((rng.uniform(0, 10), rng.uniform(50, 300))) for _ in range(rng.randint(2, 30))])
        smooth = []
        for i in range(len(r)):
            weights = [(np.exp(-((i - j) ** 2) / 2), r[j]) for j in range(len(r)) if abs(i - j) <= 3]
            smooth.append(sum(w * x for w, x in weights) / sum(w for w, _ in weights))
        cut = np.mean(smooth)
        for _ in range(50):
            low, high = [x for x in smooth if x <= cut], [x for x in smooth if x > cut]
            if low and high:
                cut = (np.mean(low) + np.mean(high)) / 2
        want = [x > cut for x in smooth]
        assert html_text.content_lines(r).tolist() == (want if any(want) else [True] * len(r))


STORY = "<p>" + "some words of the story stand here. " * 10 + "</p>"


@pytest.mark.parametrize("part", [
    '<p class="cookie-notice">We use cookies <button>OK</button> to improve ads</p>', '<ul><li class="ad">Buy<ul><li>this product now</li></ul></li></ul>', '<li class="ad">Buy<ul><li>this product now</li></ul></li>',
    '<div id="commentList"><article>' + "a long comment, my friend. " * 80 + "</article></div>", '<form>mail <input value=x> me</form>', '<dl class="ad_slot2"><dt>one<dd>two<dt>three</dl>', '<table class="related-posts"><tr><td>a<td>b<tr><td>c</table>',
    '<div hidden><p>unseen</p></div>', '<nav><p>menu<ul><li>a<li>b</ul></nav>',
])
def test_boilerplate_inside_and_beside_an_article_goes(part):
    want = " ".join(re.sub("<.*?>", " ", STORY * 2).split())
    assert html_text.extract(f"<body><article>{STORY}{part}{STORY}</article></body>") == want
    assert html_text.extract(f"<body><article>{STORY}{STORY}</article>{part}</body>") == want


@pytest.mark.parametrize("attr", ['class="ad-hoc"', 'id="search-results"', 'class="share-price"', 'aria-hidden="true"', 'class="has-sidebar"', 'class="adventure"', 'id="menuhin"', 'class="entry-header"'])
def test_names_that_only_look_like_boilerplate_stay(attr):
    for tag in ("p", "div", "span", "section"):
        assert html_text.extract(f"<body><article>{STORY}<{tag} {attr}>kept words</{tag}>{STORY}</article></body>").count("kept words") == 1


def test_a_teaser_beside_the_story_goes():
    page = f"<body><main>{STORY * 3}</main><div><article><a href=1>a teaser</a></article></div></body>"
    assert html_text.extract(page) == " ".join(re.sub("<.*?>", " ", STORY * 3).split())


def test_pages_with_clashing_names(spark):
    rows = spark.createDataFrame([(1, "u", f"<article>{STORY}</article>", 5, "t")] * 2, "page_id long, url string, html string, n_chars int, text string")
    assert [r.text.startswith("some words") for r in html_text.main_text(rows).collect()] == [True, True]
    assert html_text.main_text(rows.where("false")).collect() == []


def naive_train(x, y):
    """Boosting by loops over rows, features and cuts."""
    edges = [sorted(set(np.quantile(v, np.linspace(0, 1, quality_trees.BINS + 1)[1:-1]))) for v in x.T]
    rate = min(max(y.mean(), 1e-3), 1 - 1e-3)
    margin = [float(np.log(rate / (1 - rate)))] * len(y)
    for _ in range(quality_trees.TREES):
        p = [1 / (1 + np.exp(-m)) for m in margin]
        grad, hess = [a - b for a, b in zip(p, y)], [a * (1 - a) for a in p]
        groups = [list(range(len(y)))]
        for _ in range(quality_trees.DEPTH):
            new = []
            for rows in groups:
                tg, th, best = sum(grad[i] for i in rows), sum(hess[i] for i in rows), (1e-6, None)
                for f in range(x.shape[1]):
                    for cut in edges[f]:
                        left = [i for i in rows if x[i, f] <= cut]
                        if min(len(left), len(rows) - len(left)) < quality_trees.LEAST_ROWS:
                            continue
                        g, h = sum(grad[i] for i in left), sum(hess[i] for i in left)
                        gain = g * g / (h + 1) + (tg - g) ** 2 / (th - h + 1) - tg * tg / (th + 1)
                        if gain > best[0] + 1e-9:
                            best = (gain, (f, cut))
                if best[1] is None:
                    new += [rows, []]
                else:
                    f, cut = best[1]
                    new += [[i for i in rows if x[i, f] <= cut], [i for i in rows if x[i, f] > cut]]
            groups = new
        for rows in groups:
            if rows:
                value = -quality_trees.RATE * sum(grad[i] for i in rows) / (sum(hess[i] for i in rows) + 1)
                for i in rows:
                    margin[i] += value
    return [1 / (1 + np.exp(-m)) for m in margin]


def test_trees_are_those_of_plain_loops(monkeypatch):
    monkeypatch.setattr(quality_trees, "TREES", 4)
    monkeypatch.setattr(quality_trees, "DEPTH", 2)
    monkeypatch.setattr(quality_trees, "BINS", 8)
    rng = np.random.default_rng(9)
    x = rng.normal(0, 1, (150, 3))
    y = ((x[:, 0] + 0.5 * x[:, 1] + rng.normal(0, 0.3, 150)) > 0).astype(float)
    trees = quality_trees.train(x, y)
    assert np.allclose(trees.score(x), naive_train(x, y))
    for row, got in zip(x, trees.score(x)):  # one row at a time through the flat arrays
        total = trees.start
        for feature, cut, leaf in zip(trees.feature, trees.cut, trees.leaf):
            node = 0
            while node < len(feature):
                node = 2 * node + 1 + (row[feature[node]] > cut[node])
            total += leaf[node - len(feature)]
        assert np.isclose(got, 1 / (1 + np.exp(-total)))


def test_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{x}.parquet") for x in ("documents", "labels"))
    truth = {r.doc_id: r.quality for r in labels.collect()}
    scored = [r for r in queries.op8_quality_classifier(spark, SF).collect() if r.held_out and r.doc_id in truth]
    assert len(scored) > 30 and np.mean([r.predicted == truth[r.doc_id] for r in scored]) > 0.95
    judged = [r for r in queries.op2_quality_rules(spark, SF).collect() if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    good = [r.kept for r in judged if truth[r.doc_id] == 1]
    bad = [r.kept for r in judged if truth[r.doc_id] == 0]
    assert np.mean(good) > 0.9 and np.mean(bad) < 0.2
    assert docs.count() == 1000


def test_the_spark_expression_of_rules_is_that_of_their_masks(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rules = quality_rules.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert rules
    out = quality_rules.apply_rules(docs, rules).toPandas()
    x = stats.features({c: out[c].to_numpy() for c in stats.COUNTS})
    rejected = np.zeros(len(x), bool)
    for rule in rules:
        rejected |= quality_rules._covers(rule, x)
    assert (out["kept"].to_numpy() == ~(rejected | out["base_failed"].to_numpy())).all()


def parse_brute(text, learned):
    n = i = 0
    while i < len(text):
        j = i + 1
        while j < len(text) and any(text[i : j + 1] in part for part in learned):
            j += 1
        n, i = n + 1, j
    return n


def test_predictions_are_those_of_plain_parsing(spark, monkeypatch):
    rng = random.Random(10)
    words = {"xx": ["kala", "muno", "tiri", "sodo"], "yy": ["brzk", "strom", "kalan", "chrp"]}
    rows = [(i, " ".join(rng.choices(words[lang], k=rng.randint(3, 40))), lang) for i in range(60) for lang in [("xx", "yy")[i % 2]]]
    rows += [(70, "Kala, 12 brzk! ÀÉ muno" * 30, None), (None, "strom strom", "yy"), (None, None, "xx"), (71, "sodo", None), (71, "sodo", None), (72, " 12 ", None)]
    docs = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "doc_id long, text string, lang string, lang_pred int, score double")
    automata = langid.learn(docs)
    sampled = [r for r in rows if r[2] and r[1] and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 != 1]
    learned = {lang: [langid.normal(t) for _, t, x in sampled if x == lang] for lang in words}
    want = []
    for i, t, _ in rows:
        t = langid.normal(t or "")
        counts = sorted((parse_brute(t, learned[lang]), lang) for lang in words)
        want.append((str(i), "und" if not t else counts[0][1], 0.0 if not t else (counts[1][0] - counts[0][0]) / max(counts[1][0], 1)))
    for cells, few in ((langid.TABLE_CELLS, langid.FEW), (langid.TABLE_CELLS, 1), (0, 0)):
        monkeypatch.setattr(langid, "TABLE_CELLS", cells)
        monkeypatch.setattr(langid, "FEW", few)
        got = sorted((str(r.doc_id), r.lang_pred, r.score) for r in langid.predict(docs, automata).collect())
        assert got == sorted(want)
    assert langid.predict(docs.where("false"), automata).collect() == []


def test_held_out_languages(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    got = [r for r in queries.op10_language_id(spark, SF).collect() if r.held_out and lang[r.doc_id]]
    assert len(got) > 200 and np.mean([r.lang_pred == lang[r.doc_id] for r in got]) > 0.97


def test_held_out_is_false_without_an_id(spark, tmp_path):
    docs = spark.createDataFrame([(None, "some words"), (1, "other words")], "doc_id long, text string").withColumn("lang", F.lit("en"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for query in (queries.op8_quality_classifier, queries.op10_language_id):
        assert {r.doc_id: r.held_out for r in query(spark, str(tmp_path)).collect()}[None] is False


def test_empty_tables_and_null_turns(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    path = public_tokenizers.path("piece_bpe_32k.model")
    assert sentencepieces.encode(none, path).collect() == [] and langid.learn(none) == {}
    turns = spark.createDataFrame([(1, None, "user", "first"), (1, 0, "assistant", "second")], "conv_id long, turn long, role string, text string")
    (got,) = chat.format_trees(chat.linear(turns)).collect()
    assert chat.parse(got.formatted) == [("user", "first"), ("assistant", "second")]


def test_pipeline_stages_with_clashing_names_odd_ids_and_long_texts(spark, sf_dir):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(40).collect()]
    rows = [((None, 5, i)[i % 3], t, "en", "web", len(t)) for i, t in enumerate(texts)] + [(None, None, None, None, None), (7, " ".join(texts) * 3, "en", "web", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHING)])
    for (_, stage), left in zip(corpus_pipeline.STAGES, (None, None, None, len(rows), None)):
        out = stage(spark, docs, sf_dir)
        if stage is not corpus_pipeline.packed:
            assert out.columns == docs.columns
            got = out.collect()
            assert left is None or len(got) == left
            assert all([r[c] for c in CLASHING] == list(range(len(CLASHING))) for r in got)
        assert stage(spark, docs.where("false"), sf_dir).collect() == []


def test_near_duplicates_with_hot_buckets_split_and_dealt_out(spark, monkeypatch):
    """Hot buckets, hubs, labels and copies in pieces, large mixed buckets by further bands, against all pairs."""
    for module in (neardup, scratch):
        monkeypatch.setattr(module, "HOT_ROWS", 3)
        monkeypatch.setattr(module, "HOT_KEYS", 1000)
    for name, value in (("BLOCK_ROWS", 4), ("TASK_ROWS", 16), ("SPLIT_ROWS", 12)):
        monkeypatch.setattr(neardup, name, value)
    parted = []
    plain = neardup._split
    monkeypatch.setattr(neardup, "_split", lambda turn: parted.append(turn) or plain(turn))
    rng = random.Random(8)
    base = [f"w{i}" for i in range(150)]
    texts = [None, "", " \n", "one two", "one two"] + [" ".join(base)] * 30
    for i in range(70):  # from near copies to texts that only share half of their words
        words = list(base)
        for _ in range(rng.choice([1, 2, 4, 6, 9, 14])):
            words[rng.randrange(len(words))] = f"v{rng.randint(0, 10**6)}"
        texts.append(" ".join(words))
    for i in range(40):  # a shared passage in texts of their own
        texts.append(" ".join([f"o{i} p{j} q{i * j}" for j in range(rng.choice([8, 20]))] + base[:90]))
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(texts)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                up[b] = a
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(docs).collect()}
    assert got == {i: (len(s), find(i), find(i) == i) for i, s in enumerate(sets)}
    assert parted == [1, 2]
    assert sorted(r.doc_id for r in neardup.one_of_each(docs).collect()) == sorted(i for i, s in enumerate(sets) if find(i) == i or not s)


def test_hot_keys_are_few_and_joined_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(scratch, "HOT_ROWS", 10)
    monkeypatch.setattr(scratch, "HOT_KEYS", 50)
    folder = scratch.Scratch(spark, "test")
    rows = folder.write(spark.range(1000).selectExpr("id", "CASE WHEN id < 400 THEN 1 WHEN id < 420 THEN 2 WHEN id < 430 THEN NULL ELSE id END AS k"), "rows")
    hot = scratch.hot_keys(folder, rows, "k", "hot")
    assert [tuple(r) for r in hot.collect()] == [(1, 20)]  # key 2 holds no more than a fiftieth
    one = rows.where("k IS NOT NULL").select("k").distinct().selectExpr("k", "k * 2 AS twice")
    want = sorted(tuple(r) for r in rows.where("k IS NOT NULL").selectExpr("id", "k", "k * 2").collect())
    for which in (hot, None):
        got = scratch.spread_join(rows, one, "k", which, ["id"])
        assert sorted(tuple(r) for r in got.select("id", "k", "twice").collect()) == want
