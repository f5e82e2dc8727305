"""Each operator on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing column names."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from textloom.llm import chat, html_text, langid, neardup, packing, quality_rules, quality_trees, repeats, sentencepieces, stats, topk  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, key string, k long, node string, id string, n string"


def table(spark, texts, first=0):
    """Columns whose names the operators use inside, too."""
    return spark.createDataFrame([(first + i, t, "x", 1, None, "y", None) for i, t in enumerate(texts)], SCHEMA)


def sample(seed=1, n=40):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeé", k=rng.randint(1, 6))) for _ in range(60)]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 120))) for _ in range(n)]
    texts += [texts[0], texts[0], texts[1] + " tail", "head " + texts[2], texts[3].replace(" ", "  ", 3), "", None, " \t\n", "one two", "A B c", "a b C", "x" * 500, "ab" * 300, "日本語 " * 80, "\n".join(["same line here"] * 5)]
    return texts


def test_suffix_dedup_is_exact(spark):
    texts = sample() + ["q" + "é" * 150, "r" + "é" * 150]
    got = {r.doc_id: r for r in repeats.cut_repeats(table(spark, texts), length=40).collect()}
    count = collections.Counter(b[i : i + 40] for b in ((t or "").encode() for t in texts) for i in range(len(b) - 39))
    for i, t in enumerate(texts):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for j in range(len(b) - 39):
            if count[b[j : j + 40]] > 1:
                gone[j : j + 40] = b"\1" * 40
        assert bytes(got[i].kept) == bytes(x for x, y in zip(b, gone) if not y)
        assert sum(e - s for s, e in zip(got[i].starts, got[i].ends)) == sum(gone)
    kept = repeats.cut_repeats(table(spark, texts), length=40, keep_characters=True, carry=["key", "k"]).collect()
    assert all(bytes(r.kept).decode() is not None and r.key == "x" and r.k == 1 for r in kept)
    assert repeats.cut_repeats(table(spark, []), length=40).collect() == []


def test_difference_covers():
    for v, cover in repeats.COVERS.items():
        assert {(a - b) % v for a in cover for b in cover} == set(range(v))
    assert repeats.cover_for(200)[0] == 133 and repeats.cover_for(1)[0] == 1


def test_whole_strings_are_compared_by_all_bits(monkeypatch):
    import pyarrow as pa

    # two strings whose hashes differ in the highest byte only
    monkeypatch.setattr(repeats.Rolling, "windows", lambda self, sums, s, e: np.array([1, 1 | 1 << 60], np.uint64)[s % 2])
    batch = pa.RecordBatch.from_pydict({"text": ["x" * 201], "key": [5], "deltas": [repeats.planes(np.array([1]), 4)]})
    tables = pa.Table.from_batches(repeats._candidates(200, 1, 1)([batch]))
    assert repeats._settle(1)(tables).num_rows == 0


def near_brute(texts, percent=75):
    sets = []
    for t in texts:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                up[b] = a
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def test_near_duplicates_are_exact(spark, monkeypatch):
    rng = random.Random(3)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(120)]
    texts = sample()
    for _ in range(40):  # copies at varying distance, of which some are only linked through others
        words = list(base)
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(len(words))] = f"v{rng.randint(0, 10**6)}"
        texts.append(" ".join(words))
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 8)
    got = {r.doc_id: r for r in neardup.near_duplicates(table(spark, texts)).collect()}
    want = near_brute(texts)
    assert [(got[i].n_shingles, got[i].component_id) for i in range(len(texts))] == want
    assert all(got[i].kept == (want[i][1] == i) for i in got)


def test_near_duplicates_with_null_ids_and_repeated_rows(spark):
    rows = [(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (None, None), (7, "")]
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [("5", 2, "5", True), ("5", 2, "5", True), ("7", 0, "7", True), ("None", 0, "None", True), ("None", 2, "5", False)]
    assert neardup.near_duplicates(table(spark, [])).collect() == []


def test_register_estimate():
    rng = np.random.default_rng(2)
    for share in (0.2, 0.75, 0.95):
        n = 3000
        both = rng.integers(0, 2**63, int(n * share), dtype=np.uint64)
        a, b = (np.concatenate([both, rng.integers(0, 2**63, (n - len(both)) // 2, dtype=np.uint64)]) for _ in range(2))
        true = len(both) / (len(a) + len(b) - len(both))
        ra, rb = (neardup.sketch(np.unique(x))[None, :] for x in (a, b))
        assert abs(neardup.estimate(ra, rb, np.array([n]), np.array([n]))[0] - true) < 0.13
    assert (neardup.sketch(np.array([7], np.uint64)) > 0).all()


def test_counts(spark):
    texts = sample() + ["a b c d e a b c d e", "#x *y\n#x *y\n\n \n#x *y"]
    got = {r.doc_id: r for r in stats.with_counts(table(spark, texts), "text", ["doc_id", "key"]).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        w = WORD.findall(t)
        c = collections.Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
        twice = {j + x for j in range(len(w) - 4) if c[tuple(w[j : j + 5])] > 1 for x in range(5)}
        lines, seen, again = t.split("\n"), set(), 0
        for line in lines:
            if WORD.search(line):
                again += line in seen
                seen.add(line)
        assert (got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_dup_lines, got[i].n_repeat_words) == (len(w), sum(map(len, w)), sum(map(t.count, "#*$%&|<>")), again, len(twice))
        assert got[i].n_distinct_words == len(set(w)) and got[i].key == "x"


def labelled(spark, n=600):
    rng = random.Random(4)
    good = ["the quick brown fox jumps over the lazy dog and then some other words follow here".split() for _ in range(1)][0]
    docs, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        words = [rng.choice(good) + str(rng.randint(0, 99)) for _ in range(rng.randint(20, 60))]
        docs.append((i, " ".join(w + "###" for w in words) if bad else " ".join(words)))
        labels.append((i, 0 if bad else 1))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_rules_and_trees_learn_what_labels_say(spark):
    docs, labels = labelled(spark)
    rules = quality_rules.fit(docs, labels)
    assert rules and all(r.kept == (r.doc_id % 4 != 0) for r in quality_rules.apply_rules(docs, rules).collect())
    trees = quality_trees.fit(docs, labels)
    assert all((r.score >= 0.3) == (r.doc_id % 4 != 0) for r in quality_trees.score(docs, trees).collect())


def test_rules_and_trees_without_labels_or_texts(spark):
    docs, labels = labelled(spark, 8)
    none = labels.where("false")
    assert quality_rules.fit(docs, none) == []
    assert {r.score for r in quality_trees.score(docs, quality_trees.fit(docs, none)).collect()} == {0.5}
    odd = spark.createDataFrame([(1, None), (2, ""), (2, "")], "doc_id long, text string")
    assert [r.base_failed for r in quality_rules.apply_rules(odd, []).collect()] == [True] * 3
    assert quality_trees.score(odd.where("false"), quality_trees.fit(docs, labels)).collect() == []


def test_language_identification(spark):
    rng = random.Random(5)
    words = {"xx": ["kala", "muno", "tiri", "sodo"], "yy": ["brzk", "strom", "vlkan", "chrp"]}
    rows = [(i, " ".join(rng.choices(words[lang], k=30)), lang) for i in range(120) for lang in [("xx", "yy")[i % 2]]]
    docs = spark.createDataFrame([*rows, (500, None, None), (501, " 12 !", "xx"), (502, "Kala MUNO", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.predict(docs, langid.learn(docs)).collect()}
    assert all(got[i].lang_pred == lang and 0 <= got[i].score <= 1 for i, _, lang in rows)
    assert [got[i].lang_pred for i in (500, 501, 502)] == ["und", "und", "xx"]
    assert {r.lang_pred for r in langid.predict(docs, {}).collect()} == {"und"}


def test_languages_are_learned_from_whole_texts(spark):
    rng = random.Random(9)
    words = {"xx": ["kala", "muno", "tiri", "sodo"], "yy": ["brzk", "strom", "vlkan", "chrp"]}
    header = "licence wording " * 100
    rows = [(i, header + " ".join(rng.choices(words[lang], k=30)), lang) for i in range(60) for lang in [("xx", "yy")[i % 2]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = spark.createDataFrame([(500 + i, " ".join(words[lang])) for i, lang in enumerate(("xx", "yy"))], "doc_id long, text string")
    got = {r.doc_id: r for r in langid.predict(held, langid.learn(docs)).collect()}
    assert [got[i].lang_pred for i in (500, 501)] == ["xx", "yy"] and all(r.score > 0.3 for r in got.values())


def test_suffix_automaton_takes_longest_phrases():
    rng = random.Random(6)
    text = "".join(rng.choices("abc", k=60))
    auto = langid.SuffixAutomaton(text)
    for _ in range(200):
        word = "".join(rng.choices("abcd", k=rng.randint(0, 20)))
        n = i = 0
        while i < len(word):
            j = i + 1
            while j < len(word) and word[i : j + 1] in text:
                j += 1
            n, i = n + 1, j
        assert auto.phrases(word) == n


def test_sentencepieces_match_the_library_and_come_back(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = sample() + ["  two  spaces ", "tab\tand\nline\r\n", "emoji 👍🏽 ok", "straße ÉCOLE naïve", "internationalization unbelievably", "a" * 3000, "▁mark"]
    got = {r.doc_id: r for r in sentencepieces.decode(sentencepieces.encode(table(spark, texts), path, keep=["doc_id", "key"]), path, keep=["doc_id", "ids"]).collect()}
    for i, t in enumerate(texts):
        assert np.frombuffer(got[i].ids, "<u4").tolist() == library.encode(t or "")
        assert got[i].decoded == library.decode(library.encode(t or ""))


def test_unigram_takes_the_best_sum():
    e = sentencepieces.Encoder.__new__(sentencepieces.Encoder)
    e.model = sentencepieces.Model.__new__(sentencepieces.Model)
    e.model.type, e.model.pieces, e.model.scores = sentencepieces.UNIGRAM, ["<unk>", "a", "b", "ab", "ba", "aba"], [0.0, -1.0, -1.0, -1.5, -3.0, -2.4]
    e.model.ids, e.model.unknown, e.model.bytes, e.model.least = {p: i for i, p in enumerate(e.model.pieces) if i}, 0, [-1] * 256, -13.0
    e.memo, e.pairs, e.back = {}, {}, {}
    for piece, k in e.model.ids.items():
        node = e.back
        for c in reversed(piece[1:]):
            node = node.setdefault(c, ({}, -1))[0]
        node[piece[0]] = (node.get(piece[0], ({}, -1))[0], k)
    e.learn(["aba", "abab", "abx", "b"])
    assert {w: np.frombuffer(x, "<u4").tolist() for w, x in e.memo.items()} == {"aba": [5], "abab": [3, 3], "abx": [3, 0], "b": [2]}


def test_packing(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    texts = sample() + ["<|endoftext|> is text", "word " * 3000, "'s it's\n\n  x"]
    rows = packing.pack(table(spark, texts), path).collect()
    for i, t in enumerate(texts):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        pieces = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        assert b"".join(bytes(r.ids) for r in pieces) == ids.tobytes() and all(r.doc_tokens == len(ids) for r in pieces)
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append(r)
    for s in by.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert packing.pack(table(spark, []), path).collect() == []


def test_balanced_assignment():
    rng = random.Random(7)
    lengths = [rng.randint(1, 1023) for _ in range(400)]
    out = packing.assign(lengths)
    sizes = [sum(n for _, _, n in s) for s in out]
    assert len(out) == -(-sum(lengths) // 1024) and max(sizes) <= 1024 and sum(sizes) == sum(lengths)
    got = collections.defaultdict(list)
    for s in out:
        for item, start, n in s:
            got[item].append((start, n))
    for i, n in enumerate(lengths):
        at = 0
        for start, k in sorted(got[i]):
            assert start == at
            at += k
        assert at == n


def test_exact_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 32)
    monkeypatch.setattr(topk, "LEAF_ROWS", 4)
    monkeypatch.setattr(topk, "QUERY_ROWS", 4)
    rng = np.random.default_rng(8)
    x = rng.normal(0, 0.2, (150, 8)).astype(np.float32)
    x[40:60] = x[0]
    rows = [(i, [float(v) for v in x[i]]) for i in range(150)] + [(160, None), (180, [1.0, None] * 4), (200, [float("nan")] * 8), (None, [0.1] * 8), (220, [0.5] * 3), (221, [0.25] * 3), (0, rows0 := [float(v) for v in x[0]])]
    del rows0
    got = collections.defaultdict(list)
    for r in sorted(topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=7, every=20).collect(), key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((r.vec_id, r.score))
    q = np.floor(64 * x.astype(float)).astype(int)
    ids = [*range(150), 0]
    full = np.concatenate([q, q[:1]])
    for i in range(0, 150, 20):
        want = sorted(((int(v @ q[i]), j) for v, j in zip(full, ids) if j != i), key=lambda p: (-p[0], p[1]))[:7]
        assert got[i] == [(j, s) for s, j in want]
    assert got[220] == [(221, 3 * 32 * 16)] and 160 not in got and 180 not in got and 200 not in got
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


PAGE = (
    '<html><head><title>t</title><style>p{}</style><script>var t="</p>";</script></head><body><header><h1>Site</h1></header><nav><a href="/">menu</a></nav>'
    '<div class="cookie-notice">We use cookies</div>{}<div id="comments"><p>nice post, thank you all very much indeed</p></div><aside>side</aside><form><label>mail</label></form><footer>&copy; f</footer></body></html>'
)


def test_main_text(spark):
    body = '<h1>Head&nbsp;line</h1><p>First <b>bold</b>er\n\t text &amp; more<p>Short.<div class="ad">buy</div><ul><li>one<li>two</ul><section class="comments">x</section>'
    want = "Head line First bolder text & more Short. one two"
    assert html_text.extract(PAGE.replace("{}", f"<article>{body}</article>")) == want
    assert html_text.extract(PAGE.replace("{}", f"<main>{body}")) == want
    long = "<p>" + "many words that make a paragraph of some length, " * 6 + "</p>"
    assert html_text.extract(PAGE.replace("{}", f"<div>{long}<p>Short.</p>{long}</div>")) == " ".join(["many words that make a paragraph of some length, " * 6, "Short.", "many words that make a paragraph of some length, " * 6]).replace(",  ", ", ").strip()
    rows = spark.createDataFrame([(1, "u", None), (1, "u", ""), (2, "v", "<p>a<br>b"), (3, "w", "<article><p>" + "x " * 100_000)], "page_id long, url string, html string")
    assert [len(r.text) for r in html_text.main_text(rows).orderBy("page_id").collect()] == [0, 0, 3, 199_999]


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join(f"{rng.choice('abc')}word{rng.randint(0, 99)}" for _ in range(n))


LINKS = "".join(f'<li><a href="/{i}">link {i}</a>' for i in range(8))


def test_main_text_of_several_sections_is_whole():
    a, b, lead = prose(130, 1), prose(70, 2), prose(40, 3)
    page = f"<body><div class=top><ul>{LINKS}</ul></div><div id=page><p>{lead}</p><div><p>{a}</p><p>Short.</p></div><div><p>{b}</p></div></div><div class=end><ul>{LINKS}</ul></div></body>"
    assert html_text.extract(page) == " ".join([lead, a, "Short.", b])


def test_ratios_outweigh_teasers_in_article_elements():
    a, b = prose(150, 4), prose(150, 5)
    teasers = "".join(f"<article><a href=/{i}>Read {i}</a></article>" for i in range(3))
    assert html_text.extract(f"<body><div><p>{a}</p><p>{b}</p></div><div>{teasers}</div></body>") == f"{a} {b}"
    assert html_text.extract(f"<body><ul>{LINKS}</ul><article><h1>Head</h1><section><p>{a}</p></section><div>by me</div></article></body>") == f"Head {a} by me"


def test_layout_classes_do_not_hide_the_text():
    a = prose(150, 6)
    for attr in ('class="content has-sidebar"', 'class="no-sidebar"', 'class="right-sidebar"', 'id="search-results"', 'class="related-article"', 'class="sidebar"'):
        for body in (f"<article><p>{a}</p></article>", f"<p>{a}</p>"):
            assert html_text.extract(f"<body><div {attr}>{body}<div class=ad>buy</div></div><div class='comments'>nice</div></body>") == a
    assert html_text.extract(f"<body><article><p>{a}</p></article><div class='related-posts'><article>See also</article></div></body>") == a


def test_chat_round_trip_and_mask(spark):
    texts = ["</s>[INST] ok [/INST]", "a\\b \\\\ <|im_end|>\n<|im_start|>user\n", "", None, "<", "|im_end|>", "<<|im_end|"]
    rows = [(1, i, ("user", "assistant", "system", "odd\nrole", None)[i % 5], t) for i, t in enumerate(texts)] + [(2, 0, "assistant", "x"), (2, 0, "assistant", "x"), (None, 3, "user", "z")]
    got = {r.tree: r for r in chat.format_trees(chat.linear(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert chat.parse(got[1].formatted) == [(r or "", t or "") for _, _, r, t in rows[: len(texts)]]
    assert [chat.unescape(got[1].formatted[s.start : s.end]) for s in got[1].loss] == [t or "" for _, _, r, t in rows[: len(texts)] if r == "assistant"]
    assert len(chat.parse(got[2].formatted)) == 2 and chat.parse(got[None].formatted) == [("user", "z")]
    assert chat.format_trees(chat.linear(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).collect() == []


def test_reply_trees_rank_branches(spark):
    rows = [(1, 1, None, 0.0), (1, 2, 1, 1.0), (1, 3, 1, 0.2), (1, 4, 3, 5.0), (1, 5, 99, 0.1), (2, 1, 2, 1.0), (2, 2, 1, 1.0), (2, 3, 2, 1.0)]
    messages = spark.createDataFrame([(*r, "user", str(r[1])) for r in rows], "tree long, node long, parent long, score double, role string, text string")
    every = collections.defaultdict(list)
    for r in chat.paths(messages, None).collect():
        every[r.tree, r.leaf].append((r.up, r.node))
    assert {k: [n for _, n in sorted(v, reverse=True)] for k, v in every.items()} == {(1, 2): [1, 2], (1, 4): [1, 3, 4], (1, 5): [5]}  # tree 2 is a cycle
    best = chat.format_trees(messages).collect()
    assert [(r.tree, [t for _, t in chat.parse(r.formatted)]) for r in best] == [(1, ["1", "3", "4"])]


def test_a_long_chain_takes_few_rounds(spark):
    rows = [(1, i, "user", str(i)) for i in range(300)]
    (got,) = chat.format_trees(chat.linear(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()
    assert [t for _, t in chat.parse(got.formatted)] == [str(i) for i in range(300)]


def test_digests_of_the_query_are_those_of_plain_python():
    text, mask = chat.render([("user", "hi"), ("assistant", "yo </s>")])
    assert hashlib.sha256("".join(chat.unescape(text[a:b]) for a, b in mask).encode()).hexdigest() == hashlib.sha256(b"yo </s>").hexdigest()
    assert zlib.crc32(b"") == 0
