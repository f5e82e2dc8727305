"""Every query of the text-index operators, with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import symbols as fn
from ..operators import approx, index, mining, navigate, search, sequence, tree
from ..sources import tables
from ..sources.tables import texts

PATTERNS = ["en", "aa", "the", "eine", "ere", "zqzq"]
KEYS = ["e", "en", "er", "the", "in", "th", "zq"]
SHORT = ["theren", "ation"]
NAMES = ["almond antique", "blush thistle", "green steel"]
FREQUENT, KMER = 40, 4

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bench(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(table(spark, sf_dir, "benchmark"), "item_id", "text")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(table(spark, sf_dir, "documents"), "doc_id", "text")


@dataclass(frozen=True)
class Stored:
    """A collection with its index, rank blocks and common prefixes, written once a session and read by every query on it."""

    docs: DataFrame
    index: DataFrame
    ranks: search.Ranks
    lcp: DataFrame


_STORED: dict[tuple[str, str, str], Stored] = {}
_PACKED: dict[tuple[str, str], tuple[DataFrame, search.Ranks | None]] = {}


def _new_root(spark: SparkSession) -> str:
    return f"{tables.shared_dir(spark)}/textloom-index-{uuid.uuid4().hex[:12]}"


def _store_ranks(spark: SparkSession, root: str, docs: DataFrame) -> tuple[DataFrame, search.Ranks]:
    tables.save_index(index.build_index_any(docs), f"{root}/index")
    built = tables.load_index(spark, f"{root}/index")
    known = search.ranks(built)
    tables.save_index(known.blocks, f"{root}/blocks", order="block")
    tables.save_index(known.heads, f"{root}/heads", order="n")
    return built, search.Ranks(*(tables.load_index(spark, f"{root}/{x}") for x in ("blocks", "heads")))


def stored(spark: SparkSession, sf_dir: str, name: str, docs: DataFrame) -> Stored:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STORED:
        root = _new_root(spark)
        built, known = _store_ranks(spark, root, docs)
        tables.save_index(tree.lcp_array(built, docs), f"{root}/lcp")
        _STORED[key] = Stored(docs, built, known, tables.load_index(spark, f"{root}/lcp"))
    return _STORED[key]


def held(spark: SparkSession, sf_dir: str) -> Stored:
    return stored(spark, sf_dir, "benchmark", bench(spark, sf_dir))


def held_corpus(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, search.Ranks | None]:
    """The packed index of documents, written once a session, and the ranks of those too long for a task (None if there are none)."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _PACKED:
        root, docs = _new_root(spark), corpus(spark, sf_dir)
        long = docs.where(F.length("text") > index.LOCAL_SYMBOLS)
        tables.save_packed(index.pack_index(docs.where(F.length("text") <= index.LOCAL_SYMBOLS)), f"{root}/packed")
        _PACKED[key] = tables.load_index(spark, f"{root}/packed"), _store_ranks(spark, root, long)[1] if long.head(1) else None
    return _PACKED[key]


def indexed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s = held(spark, sf_dir)
    return s.index, s.docs


def found(spark: SparkSession, sf_dir: str) -> tuple[Stored, DataFrame]:
    """The stored index and the nodes of KEYS."""
    s = held(spark, sf_dir)
    return s, search.nodes(s.index, s.docs, KEYS, s.ranks)


def dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bench(spark, sf_dir).select("id", fn.as_dna(F.col("text")).alias("text"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.build(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type")


def _values(items: list[str], name: str) -> str:
    return f"(SELECT unnest([{', '.join(repr(x) for x in items)}]) AS {name})"


DOCS = "docs AS (SELECT item_id AS id, text FROM benchmark WHERE text IS NOT NULL)"
_IDX = """, suf AS (SELECT id, text, unnest(range(0, length(text) + 1)) AS pos FROM {docs}),
sa AS (SELECT id, text, pos, row_number() OVER (PARTITION BY id ORDER BY substring(text, pos + 1)) - 1 AS r FROM suf),
idx AS (SELECT id, r, pos, text, nullif(substring(text, pos + 1, 1), '') AS ch, CASE WHEN pos > 0 THEN substring(text, pos, 1) END AS bw,
  coalesce(lag(r) OVER (PARTITION BY id ORDER BY pos), 0) AS lf,
  coalesce(lead(r) OVER (PARTITION BY id ORDER BY pos), first_value(r) OVER (PARTITION BY id ORDER BY pos)) AS psi FROM sa)"""
IDX = f"WITH {DOCS}" + _IDX.format(docs="docs")
DNA_TEXT = "translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'acgtacgtacgtacgtacgtacgtac')"
DNA = f"WITH {DOCS}, dna AS (SELECT id, {DNA_TEXT} AS text FROM docs)"
DNA_IDX = DNA + _IDX.format(docs="dna")
NODES = IDX + f""", nodes AS (SELECT id, key, CAST(length(key) AS BIGINT) AS depth, min(r) AS l, max(r) AS r FROM idx, {_values(KEYS, "key")} k
WHERE starts_with(substring(text, pos + 1), key) GROUP BY id, key)"""
SEQ = "WITH seq AS (SELECT user_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, event_type AS sym FROM events)"
ALPHABET = f"""WITH {DOCS}, cells AS (SELECT id, unnest(string_split(text, '')) AS sym FROM docs), freq AS (SELECT id, sym, count(*) AS freq FROM cells WHERE sym <> '' GROUP BY id, sym),
alphabet AS (SELECT id, sym, row_number() OVER (PARTITION BY id ORDER BY sym) - 1 AS code, freq,
  CAST(1 + sum(freq) OVER (PARTITION BY id ORDER BY sym ROWS UNBOUNDED PRECEDING) - freq AS BIGINT) AS k_start FROM freq)"""
#: Windows of four symbols at every position of whole documents; short patterns are compared with them.
WIN = f"""WITH cells AS (SELECT id, chars[i] AS c, i - 1 AS pos FROM (SELECT id, chars, unnest(range(1, len(chars) + 1)) AS i FROM (SELECT doc_id AS id, string_split(text, '') AS chars FROM documents WHERE text <> ''))),
win AS (SELECT id, pos, concat(c, lead(c, 1) OVER w, lead(c, 2) OVER w, lead(c, 3) OVER w) AS s FROM cells WINDOW w AS (PARTITION BY id ORDER BY pos)),
hits AS (SELECT id, pattern, pos FROM win, {_values(PATTERNS, "pattern")} p WHERE starts_with(s, pattern))"""
GRAMS = f"""WITH {DOCS}, grams AS (SELECT substring(text, i, k) AS gram, substring(text, i + k, 1) AS next FROM (SELECT text, k, unnest(range(1, length(text) - k + 2)) AS i FROM docs, (SELECT unnest(range(1, 13)) AS k) ks WHERE length(text) >= k)),
freq AS (SELECT gram, count(*) AS occ, count(DISTINCT nullif(next, '')) AS nexts FROM grams GROUP BY gram HAVING count(*) >= {FREQUENT})"""


# ---- construction


@query(IDX + " SELECT id, count(*) AS n_rows, max(CASE WHEN bw IS NULL THEN r END) AS last, count(DISTINCT bw) AS n_symbols FROM idx GROUP BY id")
def build_index_stats(spark, sf_dir):
    i = index.build_index(bench(spark, sf_dir))
    return i.groupBy("id").agg(F.count("*").alias("n_rows"), F.max(F.when(F.col("bw").isNull(), F.col("r"))).alias("last"), F.countDistinct("bw").alias("n_symbols"))


@query(IDX + " SELECT id, r, pos FROM idx WHERE r % 16 = 0")
def sa_sample(spark, sf_dir):
    return navigate.sample(indexed(spark, sf_dir)[0], 16)


@query(IDX + " SELECT id, r, pos FROM idx")
def suffix_array(spark, sf_dir):
    return index.build_index(bench(spark, sf_dir)).select("id", "r", "pos")


@query(IDX + " SELECT id, r, pos FROM idx")
def suffix_array_window(spark, sf_dir):
    return index.suffix_array(bench(spark, sf_dir))


@query(IDX + " SELECT id, r, pos FROM idx")
def suffix_array_doubling(spark, sf_dir):
    return index.suffix_array_doubling(bench(spark, sf_dir))


@query(IDX + " SELECT id, r, bw FROM idx")
def bwt(spark, sf_dir):
    return indexed(spark, sf_dir)[0].select("id", "r", "bw")


@query(DNA_IDX + " SELECT id, r, bw FROM idx")
def dna_bwt(spark, sf_dir):
    return index.build_index(dna(spark, sf_dir)).select("id", "r", "bw")


@query(DNA + ", two AS (SELECT id, concat(text, '$') AS text FROM dna)" + _IDX.format(docs="two") + " SELECT id, r, bw FROM idx")
def dna2_bwt(spark, sf_dir):
    docs = dna(spark, sf_dir).withColumn("text", F.concat("text", F.lit("$")))
    return index.build_index(docs).select("id", "r", "bw")


@query(f"WITH {DOCS}, two AS (SELECT id, translate({DNA_TEXT}, 'acgt', '0011') AS text FROM docs)" + _IDX.format(docs="two") + " SELECT id, r, bw FROM idx")
def bit_bwt(spark, sf_dir):
    docs = dna(spark, sf_dir).withColumn("text", F.translate("text", "acgt", "0011"))
    return index.build_index(docs).select("id", "r", "bw")


@query(IDX + """, sums AS (SELECT id, r // 64 AS block, bw AS sym, count(*) AS here FROM idx WHERE bw IS NOT NULL GROUP BY ALL)
SELECT id, block, sym, CAST(sum(here) OVER (PARTITION BY id, sym ORDER BY block ROWS UNBOUNDED PRECEDING) - here AS BIGINT) AS before, here FROM sums""")
def rank_directory(spark, sf_dir):
    return index.rank_directory(indexed(spark, sf_dir)[0], 64)


@query("SELECT item_id AS id, text FROM benchmark WHERE text IS NOT NULL")
def inverse_bwt(spark, sf_dir):
    return index.inverse_bwt(indexed(spark, sf_dir)[0].select("id", "r", "bw"))


@query("SELECT item_id AS id, text FROM benchmark WHERE text IS NOT NULL")
def unbwt_roundtrip(spark, sf_dir):
    return index.unbwt(indexed(spark, sf_dir)[0])


@query(f"WITH {DOCS} SELECT id, list_aggregate(list_reverse(string_split(text, '')), 'string_agg', '') AS reversed FROM docs")
def reverse_text(spark, sf_dir):
    return bench(spark, sf_dir).select("id", F.reverse("text").alias("reversed"))


# ---- alphabet


@query(ALPHABET + " SELECT id, sym, code, freq, k_start FROM alphabet")
def alphabet(spark, sf_dir):
    return index.alphabet(bench(spark, sf_dir))


@query(f"WITH {DOCS} SELECT id, CAST(length(text) AS BIGINT) AS n FROM docs")
def index_length(spark, sf_dir):
    return bench(spark, sf_dir).select("id", F.length("text").cast("long").alias("n"))


@query(ALPHABET + " SELECT id, count(*) AS m FROM alphabet GROUP BY id")
def alphabet_size(spark, sf_dir):
    return index.alphabet(bench(spark, sf_dir)).groupBy("id").agg(F.count("*").alias("m"))


@query(ALPHABET + " SELECT id, string_agg(sym, '' ORDER BY sym) AS charset FROM alphabet GROUP BY id")
def charset(spark, sf_dir):
    return bench(spark, sf_dir).select("id", F.array_join(F.array_sort(F.array_distinct(F.filter(F.split("text", ""), lambda c: c != ""))), "").alias("charset"))


@query(ALPHABET + " SELECT id, code, sym FROM alphabet WHERE code IN (0, 5, 20)")
def atoc(spark, sf_dir):
    return index.alphabet(bench(spark, sf_dir)).where(F.col("code").isin(0, 5, 20)).select("id", "code", "sym")


@query(ALPHABET + " SELECT id, sym, code FROM alphabet WHERE sym IN ('a', 'e', 'z')")
def ctoa(spark, sf_dir):
    return index.alphabet(bench(spark, sf_dir)).where(F.col("sym").isin("a", "e", "z")).select("id", "sym", "code")


@query("SELECT doc_id AS id, sym, count(*) AS freq FROM (SELECT doc_id, unnest(string_split(text, '')) AS sym FROM documents) WHERE sym <> '' GROUP BY ALL")
def symbol_freq(spark, sf_dir):
    return index.symbol_freq(corpus(spark, sf_dir))


@query(ALPHABET + " SELECT id, sym, k_start FROM alphabet")
def k_start(spark, sf_dir):
    return index.alphabet(bench(spark, sf_dir)).select("id", "sym", "k_start")


@query(ALPHABET + ", total AS (SELECT id, sum(freq) AS n FROM freq GROUP BY id) SELECT f.id, round(-sum(freq / n * log2(freq / n)), 6) AS h0 FROM freq f JOIN total t ON f.id = t.id GROUP BY f.id")
def entropy_h0(spark, sf_dir):
    a = index.alphabet(bench(spark, sf_dir))
    p = F.col("freq") / F.sum("freq").over(Window.partitionBy("id"))
    return a.select("id", (p * F.log2(p)).alias("x")).groupBy("id").agg(F.round(-F.sum("x"), 6).alias("h0"))


# ---- navigation


@query(IDX + " SELECT id, r, pos FROM idx WHERE r IN (0, 1, 7, 50)")
def lookup(spark, sf_dir):
    return navigate.lookup(indexed(spark, sf_dir)[0], [0, 1, 7, 50])


@query(IDX + " SELECT id, pos, r FROM idx WHERE pos IN (0, 1, 7, 50)")
def inverse(spark, sf_dir):
    return navigate.inverse(indexed(spark, sf_dir)[0], [0, 1, 7, 50])


@query(IDX + " SELECT id, r, bw, row_number() OVER (PARTITION BY id, bw ORDER BY r) AS bw_rank FROM idx WHERE bw IS NOT NULL")
def bw_rank(spark, sf_dir):
    return index.bw_ranked(indexed(spark, sf_dir)[0])


@query(IDX + " SELECT id, r, lf FROM idx")
def lf(spark, sf_dir):
    return indexed(spark, sf_dir)[0].select("id", "r", "lf")


@query(IDX + " SELECT id, r, bw, lf FROM idx")
def bw_lf(spark, sf_dir):
    """From the BWT alone."""
    return index.lf_from_bwt(indexed(spark, sf_dir)[0].select("id", "r", "bw"))


@query(IDX + " SELECT id, r, psi FROM idx")
def psi(spark, sf_dir):
    return indexed(spark, sf_dir)[0].select("id", "r", "psi")


@query(IDX + " SELECT id, min(r) AS row_found FROM idx WHERE r BETWEEN 5 AND 60 AND psi >= 20 GROUP BY id")
def psi_succ(spark, sf_dir):
    return navigate.psi_succ(indexed(spark, sf_dir)[0], 5, 60, 20)


@query(IDX + " SELECT id, max(r) AS row_found FROM idx WHERE r BETWEEN 5 AND 60 AND psi <= 20 GROUP BY id")
def psi_pred(spark, sf_dir):
    return navigate.psi_pred(indexed(spark, sf_dir)[0], 5, 60, 20)


@query(IDX + " SELECT id, r, count(CASE WHEN bw = 'e' THEN 1 END) OVER (PARTITION BY id ORDER BY r ROWS UNBOUNDED PRECEDING) AS occ FROM idx")
def rankc(spark, sf_dir):
    return navigate.rankc(indexed(spark, sf_dir)[0], "e")


@query(IDX + ", n AS (SELECT id, r, bw, row_number() OVER (PARTITION BY id, bw ORDER BY r) AS k FROM idx WHERE bw IS NOT NULL) SELECT id, bw, r FROM n WHERE k = 3")
def selectc(spark, sf_dir):
    return navigate.selectc(index.bw_ranked(indexed(spark, sf_dir)[0]), 3)


@query(ALPHABET + _IDX.format(docs="docs") + " SELECT i.id, r, code FROM idx i LEFT JOIN alphabet a ON i.id = a.id AND i.ch = a.sym")
def head(spark, sf_dir):
    i, docs = indexed(spark, sf_dir)
    a = index.alphabet(docs).select(F.col("id").alias("a"), "sym", "code")
    return i.join(a, (F.col("id") == F.col("a")) & (F.col("ch") == F.col("sym")), "left").select("id", "r", "code")


@query(IDX + " SELECT id, r, ch FROM idx")
def t_of_rank(spark, sf_dir):
    return indexed(spark, sf_dir)[0].select("id", "r", "ch")


@query(IDX + " SELECT id, r, pos FROM idx WHERE pos % 16 = 0")
def isa_sample(spark, sf_dir):
    return navigate.sample(indexed(spark, sf_dir)[0], 16, "pos")


@query(IDX + ", p AS (SELECT unnest([CAST(0 AS BIGINT), 20, 100]) AS q, unnest(['e', 't', 'e']) AS sym) SELECT i.id, q AS r, sym, count(CASE WHEN bw = sym THEN 1 END) AS occ FROM idx i JOIN p ON i.r <= q JOIN (SELECT id, max(r) AS n FROM idx GROUP BY id) m ON m.id = i.id AND q <= n GROUP BY ALL")
def rank_at(spark, sf_dir):
    """By one row of the rank blocks each."""
    s = held(spark, sf_dir)
    return navigate.rank_at(s.index, [(0, "e"), (20, "t"), (100, "e")], s.ranks)


@query(IDX + " SELECT id, count(*) AS n_rows, CAST(sum(coalesce(strlen(bw), 0)) AS BIGINT) AS bw_bytes, CAST(sum(coalesce(strlen(bw), 0) + coalesce(strlen(ch), 0) + 40) AS BIGINT) AS index_bytes FROM idx GROUP BY id")
def index_sizes(spark, sf_dir):
    return index.sizes(indexed(spark, sf_dir)[0])


@query(f"WITH {DOCS} SELECT id, CAST(0 AS BIGINT) AS wrong FROM docs")
def index_check(spark, sf_dir):
    return index.check(indexed(spark, sf_dir)[0])


@query(IDX + " SELECT id, r, pos, ch, bw, lf, psi FROM idx")
def index_read(spark, sf_dir):
    """The stored index, read again, with every column."""
    return indexed(spark, sf_dir)[0].select("id", "r", "pos", "ch", "bw", "lf", "psi")


@query(IDX + ", a AS (SELECT id, string_agg(bw, '' ORDER BY r) AS symbols, max(CASE WHEN bw IS NULL THEN r END) AS last FROM idx GROUP BY id) SELECT id, coalesce(symbols, '') AS symbols, last FROM a")
def bwt_write(spark, sf_dir):
    """What BWT files of four-byte symbols hold, read back."""
    wrote = tables.bwt_bytes(indexed(spark, sf_dir)[0].select("id", "r", "bw"), 4)
    codes = F.transform(F.sequence(F.lit(0), (F.octet_length("symbols") / 4).cast("int") - 1), lambda i: fn.from_code_point(fn.from_little_endian(F.substring("symbols", 4 * i + 1, F.lit(4)), 4)))
    return wrote.select("id", F.when(F.octet_length("symbols") > 0, F.array_join(codes, "")).otherwise("").alias("symbols"), "last")


# ---- extraction


@query("SELECT doc_id AS id, substring(text, 11, 20) AS part FROM documents WHERE text IS NOT NULL")
def text_range(spark, sf_dir):
    return navigate.text_range(corpus(spark, sf_dir), 10, 29)


@query(IDX + " SELECT id, r, substring(text, pos + 1, 8) AS part FROM idx")
def substring_rank(spark, sf_dir):
    return navigate.substring_rank(*indexed(spark, sf_dir), 8)


@query(IDX + " SELECT id, r, substring(text, greatest(pos - 8, 0) + 1, least(pos, 8)) AS part FROM idx")
def left_context(spark, sf_dir):
    return navigate.left_context(*indexed(spark, sf_dir), 8)


@query("SELECT doc_id AS id, substring(text, 101, least(160, length(text) - 1) - 100 + 1) AS part FROM documents WHERE length(text) > 100")
def extract(spark, sf_dir):
    return navigate.extract(corpus(spark, sf_dir), 100, 160)


@query(IDX + f""", hit AS (SELECT id, pattern, r, pos, row_number() OVER (PARTITION BY id, pattern ORDER BY r) AS k, regexp_replace(substring(text, pos + 1, 21), '[ \\t\\n\\r\\f\\v]', ' ', 'g') AS context
FROM idx, {_values(PATTERNS, "pattern")} p WHERE starts_with(substring(text, pos + 1), pattern)) SELECT id, pattern, k, r, pos, context FROM hit WHERE k <= 21""")
def kwic_top20(spark, sf_dir):
    s = held(spark, sf_dir)
    return search.first_hits(s.index, s.docs, PATTERNS, 21, 21, s.ranks)


@query(f"""WITH {DOCS}, hit AS (SELECT id, text, pattern, unnest(list_filter(range(0, length(text)), lambda i: substring(text, i + 1, length(pattern)) = pattern)) AS pos FROM docs, {_values(PATTERNS, "pattern")} p)
SELECT id, pattern, pos, substring(text, greatest(pos - 20, 0) + 1, least(pos, 20) + 21) AS context FROM hit""")
def kwic_two_sided(spark, sf_dir):
    return search.contexts(bench(spark, sf_dir), PATTERNS, 20, 21)


@query(f"""WITH {DOCS}, hit AS (SELECT id, text, pattern, unnest(list_filter(range(0, length(text)), lambda i: substring(text, i + 1, length(pattern)) = pattern)) AS pos FROM docs, {_values(PATTERNS, "pattern")} p)
SELECT id, pattern, pos, substring(text, greatest(pos - 12, 0) + 1, least(pos, 12) + length(pattern) + 12) AS context FROM hit""")
def display_context(spark, sf_dir):
    return search.contexts(bench(spark, sf_dir), PATTERNS, 12, 0, past=12)


# ---- search


@query(IDX + f" SELECT id, pattern, min(r) AS l, max(r) AS r FROM idx, {_values(PATTERNS, 'pattern')} p WHERE starts_with(substring(text, pos + 1), pattern) GROUP BY id, pattern")
def search_range(spark, sf_dir):
    s = held(spark, sf_dir)
    return search.search_range(s.index, s.docs, PATTERNS, s.ranks)


@query(f"WITH {DOCS} SELECT id, pattern, max(k) AS matched FROM (SELECT id, text, pattern, unnest(range(0, length(pattern) + 1)) AS k FROM docs, {_values(PATTERNS, 'pattern')} p) WHERE contains(text, right(pattern, k)) GROUP BY id, pattern")
def max_match_len(spark, sf_dir):
    return search.max_match(bench(spark, sf_dir), PATTERNS)


@query(NODES + " SELECT n.id, n.key, bw AS sym, min(lf) AS l, max(lf) AS r FROM nodes n JOIN idx i ON n.id = i.id AND i.r BETWEEN n.l AND n.r WHERE bw = 't' GROUP BY ALL")
def search_l(spark, sf_dir):
    s, nodes = found(spark, sf_dir)
    return search.search_left(nodes, s.index, "t", s.ranks)


@query(NODES + " SELECT n.id, n.key, substring(text, pos + depth + 1, 1) AS sym, min(i.r) AS l, max(i.r) AS r FROM nodes n JOIN idx i ON n.id = i.id AND i.r BETWEEN n.l AND n.r WHERE substring(text, pos + depth + 1, 1) = 'e' GROUP BY ALL")
def search_r(spark, sf_dir):
    s, nodes = found(spark, sf_dir)
    return search.search_right(nodes, s.index, symbol="e")


@query(WIN + f" SELECT d.doc_id AS id, p.pattern, count(h.pos) AS occ FROM documents d CROSS JOIN {_values(PATTERNS, 'pattern')} p LEFT JOIN hits h ON d.doc_id = h.id AND h.pattern = p.pattern WHERE d.text IS NOT NULL GROUP BY ALL")
def count_pattern(spark, sf_dir):
    return search.count_patterns(corpus(spark, sf_dir), PATTERNS)


@query(WIN + " SELECT id, pattern, pos FROM hits")
def locate_pattern(spark, sf_dir):
    return search.locate_patterns(corpus(spark, sf_dir), PATTERNS)


@query(WIN + " SELECT a.id, a.pos AS pos1, b.pos AS pos2 FROM hits a JOIN hits b ON a.id = b.id AND b.pos BETWEEN a.pos - 10 AND a.pos + 10 WHERE a.pattern = 'the' AND b.pattern = 'ere'")
def proximity(spark, sf_dir):
    return search.proximity(corpus(spark, sf_dir), "the", "ere", 10)


#: Rows of documents' suffixes before a pattern: positions (the end of the text too) whose windows are smaller.
WIN_RANGE = WIN + f""", sums AS (SELECT id, pattern, count(CASE WHEN left(s, length(pattern)) < pattern THEN 1 END) AS before, count(CASE WHEN starts_with(s, pattern) THEN 1 END) AS occ FROM win, {_values(PATTERNS, "pattern")} p GROUP BY id, pattern)
SELECT id, pattern, 1 + before AS l, before + occ AS r FROM sums WHERE occ > 0"""


@query(WIN_RANGE)
def search_range_documents(spark, sf_dir):
    """Backward search over the index of whole documents."""
    packed, long = held_corpus(spark, sf_dir)
    found = search.search_packed(packed, PATTERNS)
    return found.unionByName(search.search_range(None, None, PATTERNS, long)) if long else found


@query(WIN + " SELECT id, pattern, pos, concat(substring(text, greatest(pos - 20, 0) + 1, least(pos, 20)), substring(text, pos + 1, 21)) AS context FROM hits JOIN (SELECT doc_id, text FROM documents) d ON d.doc_id = hits.id")
def kwic_documents(spark, sf_dir):
    return search.contexts(corpus(spark, sf_dir), PATTERNS, 20, 21)


@query(f"SELECT doc_id AS id, pattern, max(k) AS matched FROM (SELECT doc_id, text, pattern, unnest(range(0, length(pattern) + 1)) AS k FROM documents, {_values(PATTERNS, 'pattern')} p WHERE text IS NOT NULL) WHERE contains(text, right(pattern, k)) GROUP BY doc_id, pattern")
def max_match_documents(spark, sf_dir):
    return search.max_match(corpus(spark, sf_dir), PATTERNS)


# ---- children and mining


@query(NODES + """ SELECT n.id, n.key, true AS is_left, bw AS sym, min(lf) AS l, max(lf) AS r FROM nodes n JOIN idx i ON n.id = i.id AND i.r BETWEEN n.l AND n.r WHERE bw IS NOT NULL GROUP BY ALL
UNION ALL SELECT n.id, n.key, false, substring(text, pos + depth + 1, 1), min(i.r), max(i.r) FROM nodes n JOIN idx i ON n.id = i.id AND i.r BETWEEN n.l AND n.r WHERE substring(text, pos + depth + 1, 1) <> '' GROUP BY ALL""")
def child(spark, sf_dir):
    s, nodes = found(spark, sf_dir)
    sides = [search.child(nodes, s.index, left, s.ranks).withColumn("is_left", F.lit(left)) for left in (True, False)]
    return sides[0].unionByName(sides[1])


@query(NODES + " SELECT n.id, n.key, bw AS sym, min(lf) AS l, max(lf) AS r FROM nodes n JOIN idx i ON n.id = i.id AND i.r BETWEEN n.l AND n.r WHERE bw IS NOT NULL GROUP BY ALL")
def child_l(spark, sf_dir):
    s, nodes = found(spark, sf_dir)
    return search.search_left(nodes, s.index, known=s.ranks)


@query(NODES + " SELECT n.id, n.key, substring(text, pos + depth + 1, 1) AS sym, min(i.r) AS l, max(i.r) AS r FROM nodes n JOIN idx i ON n.id = i.id AND i.r BETWEEN n.l AND n.r WHERE substring(text, pos + depth + 1, 1) <> '' GROUP BY ALL")
def child_r(spark, sf_dir):
    s, nodes = found(spark, sf_dir)
    return search.search_right(nodes, s.index)


@query(GRAMS + " SELECT gram, occ FROM freq f WHERE NOT EXISTS (SELECT 1 FROM freq h WHERE length(h.gram) > 1 AND substring(h.gram, 2) = f.gram)")
def left_maximal_frequent(spark, sf_dir):
    return mining.left_maximal(mining.frequent(bench(spark, sf_dir), FREQUENT)).select("gram", "occ")


@query(GRAMS + " SELECT gram, occ FROM freq f WHERE nexts <> 1 AND NOT EXISTS (SELECT 1 FROM freq h WHERE length(h.gram) > 1 AND substring(h.gram, 2) = f.gram)")
def maximal_frequent(spark, sf_dir):
    return mining.maximal(mining.frequent(bench(spark, sf_dir), FREQUENT)).select("gram", "occ")


@query(GRAMS + " SELECT gram, occ FROM freq f WHERE NOT EXISTS (SELECT 1 FROM freq h WHERE length(h.gram) > 1 AND left(h.gram, length(h.gram) - 1) = f.gram)")
def right_maximal_frequent(spark, sf_dir):
    return mining.right_maximal(mining.frequent(bench(spark, sf_dir), FREQUENT)).select("gram", "occ")


@query(DNA + f", g AS (SELECT substring(text, i, {KMER}) AS kmer FROM (SELECT text, unnest(range(1, length(text) - {KMER} + 2)) AS i FROM dna WHERE length(text) >= {KMER})) SELECT kmer, reverse(kmer) AS path, count(*) AS occ FROM g WHERE regexp_matches(kmer, '^[acgt]{{{KMER}}}$') GROUP BY kmer")
def kmer_counts(spark, sf_dir):
    return mining.kmer_counts(dna(spark, sf_dir), KMER)


_DIVERSE = NODES + ", d AS (SELECT n.id, n.key, count(DISTINCT bw) AS left_kinds, count(DISTINCT nullif(substring(text, pos + depth + 1, 1), '')) AS right_kinds FROM nodes n JOIN idx i ON n.id = i.id AND i.r BETWEEN n.l AND n.r GROUP BY ALL)"


@query(_DIVERSE + " SELECT id, key, left_kinds, left_kinds > 1 AS diverse FROM d")
def left_diverse(spark, sf_dir):
    s, nodes = found(spark, sf_dir)
    return mining.diversity(s.index, nodes).select("id", "key", "left_kinds", (F.col("left_kinds") > 1).alias("diverse"))


@query(_DIVERSE + " SELECT id, key, right_kinds, right_kinds > 1 AS diverse FROM d")
def right_diverse(spark, sf_dir):
    s, nodes = found(spark, sf_dir)
    return mining.diversity(s.index, nodes).select("id", "key", "right_kinds", (F.col("right_kinds") > 1).alias("diverse"))


@query(f"WITH {DOCS} SELECT gram, count(*) AS occ FROM (SELECT substring(text, i, k) AS gram FROM (SELECT text, k, unnest(range(1, length(text) - k + 2)) AS i FROM docs, (SELECT unnest(range(1, 4)) AS k) ks WHERE length(text) >= k)) GROUP BY gram")
def substring_freq(spark, sf_dir):
    return mining.substring_freq(bench(spark, sf_dir), 3)


@query(DNA + ", g AS (SELECT substring(text, i, 6) AS gram FROM (SELECT text, unnest(range(1, length(text) - 4)) AS i FROM dna WHERE length(text) >= 6)), c AS (SELECT gram, count(*) AS occ FROM g GROUP BY gram) SELECT a.gram, CAST(sum(b.occ) AS BIGINT) AS occ FROM c a, c b WHERE levenshtein(a.gram, b.gram) <= 1 GROUP BY a.gram HAVING sum(b.occ) >= 60")
def approx_frequent(spark, sf_dir):
    return mining.approx_frequent(dna(spark, sf_dir), 6, 1, 60)


# ---- suffix tree


@query(f"WITH {DOCS} SELECT id, '' AS key, CAST(0 AS BIGINT) AS depth, CAST(0 AS BIGINT) AS l, CAST(length(text) AS BIGINT) AS r FROM docs")
def st_root(spark, sf_dir):
    return tree.root(bench(spark, sf_dir))


@query(NODES + " SELECT n.id, n.l, n.r, depth, substring(text, pos + 1, depth) AS label FROM nodes n JOIN idx i ON n.id = i.id AND n.l = i.r")
def st_pathlabel(spark, sf_dir):
    s, nodes = found(spark, sf_dir)
    return tree.path_labels(nodes, s.index, s.docs)


@query(NODES + " SELECT id, key, l = r AS is_leaf FROM nodes")
def st_leaves(spark, sf_dir):
    return found(spark, sf_dir)[1].select("id", "key", tree.is_leaf().alias("is_leaf"))


@query(NODES + " SELECT n.id, key, substring(a.text, a.pos + depth + 1, 1) = substring(b.text, b.pos + depth + 1, 1) AS is_unary FROM nodes n JOIN idx a ON n.id = a.id AND n.l = a.r JOIN idx b ON n.id = b.id AND n.r = b.r")
def st_unary(spark, sf_dir):
    s, nodes = found(spark, sf_dir)
    return tree.unary(nodes, s.index)


@query(IDX + f" SELECT id, key, min(r) AS l, max(r) AS r FROM idx, {_values(KEYS, 'key')} k WHERE starts_with(substring(text, pos + 1), concat(key, 'r')) GROUP BY id, key")
def st_child(spark, sf_dir):
    s, nodes = found(spark, sf_dir)
    return search.search_right(nodes, s.index, symbol="r").select("id", "key", "l", "r")


@query(NODES + ", c AS (SELECT n.id, n.key, nullif(substring(text, pos + depth + 1, 1), '') AS sym, depth + 1 AS child_depth, min(i.r) AS l, max(i.r) AS r FROM nodes n JOIN idx i ON n.id = i.id AND i.r BETWEEN n.l AND n.r GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY id, key ORDER BY l) AS nth FROM c")
def st_children(spark, sf_dir):
    s, nodes = found(spark, sf_dir)
    return tree.children(nodes, s.index)


@query(IDX + f" SELECT id, key, min(r) AS l, max(r) AS r FROM idx, {_values(KEYS, 'key')} k WHERE starts_with(substring(text, pos + 1), concat('h', key)) GROUP BY id, key")
def st_weiner(spark, sf_dir):
    s, nodes = found(spark, sf_dir)
    return search.search_left(nodes, s.index, "h", s.ranks).select("id", "key", "l", "r")


@query(NODES + ", two AS (SELECT n.id, n.key, n.l, n.r, a.text, a.pos AS p, b.pos AS q FROM nodes n JOIN idx a ON n.id = a.id AND n.l = a.r JOIN idx b ON n.id = b.id AND n.r = b.r), ks AS (SELECT *, unnest(range(0, least(length(text) - p, length(text) - q) + 1)) AS k FROM two) SELECT id, key, l, r, max(k) AS depth FROM ks WHERE substring(text, p + 1, k) = substring(text, q + 1, k) GROUP BY id, key, l, r")
def st_canonize(spark, sf_dir):
    s, nodes = found(spark, sf_dir)
    return tree.canonize(nodes, s.index, s.docs, s.lcp)


@query(NODES + " SELECT n.id, n.key, left(n.key, length(n.key) - 1) AS parent, min(i.r) AS l, max(i.r) AS r FROM nodes n JOIN idx i ON n.id = i.id AND starts_with(substring(text, pos + 1), left(n.key, length(n.key) - 1)) GROUP BY ALL")
def st_parent(spark, sf_dir):
    s, nodes = found(spark, sf_dir)
    return tree.parents(nodes, s.lcp).select("id", "key", F.expr("left(key, length(key) - 1)").alias("parent"), "l", "r")


@query(NODES + " SELECT n.id, n.key, substring(n.key, 2) AS target, min(i.r) AS l, max(i.r) AS r FROM nodes n JOIN idx i ON n.id = i.id AND starts_with(substring(text, pos + 1), substring(n.key, 2)) GROUP BY ALL")
def st_suflink(spark, sf_dir):
    s, nodes = found(spark, sf_dir)
    return tree.suffix_links(nodes, s.index, s.lcp).select("id", "key", F.expr("substring(key, 2)").alias("target"), "l", "r")


@query(IDX + " SELECT id, label, CAST(length(label) AS BIGINT) AS depth, min(r) AS l, max(r) AS r FROM (SELECT id, r, substring(text, pos + 1, k) AS label FROM (SELECT *, unnest(range(0, least(3, length(text) - pos) + 1)) AS k FROM idx)) GROUP BY ALL")
def st_nodes(spark, sf_dir):
    i, docs = indexed(spark, sf_dir)
    return tree.all_nodes(i, docs, 3)


@query(IDX + ", two AS (SELECT id, r, text, pos AS q, lag(pos) OVER (PARTITION BY id ORDER BY r) AS p FROM idx), ks AS (SELECT *, unnest(range(0, least(length(text) - coalesce(p, length(text)), length(text) - q) + 1)) AS k FROM two) SELECT id, r, max(k) AS lcp FROM ks WHERE k = 0 OR substring(text, p + 1, k) = substring(text, q + 1, k) GROUP BY id, r")
def lcp_array(spark, sf_dir):
    return held(spark, sf_dir).lcp


@query(NODES + ", two AS (SELECT id, r, text, pos AS q, lag(pos) OVER (PARTITION BY id ORDER BY r) AS p FROM idx), ks AS (SELECT *, unnest(range(0, least(length(text) - coalesce(p, length(text)), length(text) - q) + 1)) AS k FROM two), lcp AS (SELECT id, r, max(k) AS lcp FROM ks WHERE k = 0 OR substring(text, p + 1, k) = substring(text, q + 1, k) GROUP BY id, r) SELECT id, max(lcp) AS longest_repeat, count(CASE WHEN lcp = 0 THEN 1 END) - 1 AS first_symbols FROM lcp GROUP BY id")
def st_side_data(spark, sf_dir):
    """From the stored common prefixes: the longest repeated substring and how many symbols begin suffixes."""
    return held(spark, sf_dir).lcp.groupBy("id").agg(F.max("lcp").alias("longest_repeat"), (F.count(F.when(F.col("lcp") == 0, 1)) - 1).alias("first_symbols"))


@query(NODES + " SELECT id, key, depth, false AS is_null, true AS is_same FROM nodes")
def st_compare(spark, sf_dir):
    """Whether nodes are none, and whether they are the nodes that the same keys lead to again."""
    s, nodes = found(spark, sf_dir)
    again = search.nodes(s.index, s.docs, KEYS, s.ranks)
    both = nodes.select("id", "key", "depth", F.struct("id", "depth", "l", "r").alias("a")).join(again.select("id", "key", F.struct("id", "depth", "l", "r").alias("b")), ["id", "key"])
    return both.select("id", "key", "depth", tree.is_null().alias("is_null"), tree.same("a", "b").alias("is_same"))


# ---- approximate search


#: DuckDB's levenshtein counts bytes, so other characters than ASCII become question marks on both sides.
ASCII_IDX = "WITH docs AS (SELECT item_id AS id, regexp_replace(text, '[^\\x00-\\x7F]', '?', 'g') AS text FROM benchmark WHERE text IS NOT NULL)" + _IDX.format(docs="docs")


def ascii_indexed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = bench(spark, sf_dir).withColumn("text", F.regexp_replace("text", "[^\\x00-\\x7F]", "?"))
    return index.build_index(docs), docs


def _approx(errors: int) -> str:
    return ASCII_IDX + f""", s AS (SELECT id, r, query, substring(text, pos + 1, k) AS s FROM (SELECT id, r, text, pos, query, unnest(range(greatest(1, length(query) - {errors}), length(query) + {errors} + 1)) AS k FROM idx, {_values(SHORT, 'query')} q) WHERE k <= length(text) - pos)
SELECT id, query, min(levenshtein(s, query)) AS error, CAST(length(s) AS BIGINT) AS len, min(r) AS l, max(r) AS r FROM s WHERE levenshtein(s, query) <= {errors} GROUP BY id, query, s"""


@query(_approx(2))
def approx_search(spark, sf_dir):
    return approx.search(*ascii_indexed(spark, sf_dir), SHORT, 2)


@query(_approx(2))
def approx_search_seeded(spark, sf_dir):
    return approx.search_seeded(*ascii_indexed(spark, sf_dir), SHORT, 2)


#: Of equal ranges the least error, then the shorter; of ranges that start at a row the largest; neighbours by position.
_LOCAL = _approx(2).replace("SELECT id, query, min(levenshtein(s, query))", ", hits AS (SELECT id, query, min(levenshtein(s, query))") + """),
one AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY id, query, l, r ORDER BY error, len) = 1),
placed AS (SELECT one.*, pos FROM one JOIN idx ON idx.id = one.id AND idx.r = one.l),
start AS (SELECT id, query, pos, error AS e FROM placed QUALIFY row_number() OVER (PARTITION BY id, query, l ORDER BY r DESC) = 1)
SELECT h.id, h.query, h.error, h.len, h.l, h.r FROM placed h JOIN start s ON s.id = h.id AND s.query = h.query AND s.pos = h.pos
LEFT JOIN start a ON a.id = h.id AND a.query = h.query AND a.pos = h.pos - 1 LEFT JOIN start b ON b.id = h.id AND b.query = h.query AND b.pos = h.pos - 2
LEFT JOIN start c ON c.id = h.id AND c.query = h.query AND c.pos = h.pos + 1 LEFT JOIN start d ON d.id = h.id AND d.query = h.query AND d.pos = h.pos + 2
WHERE s.e >= h.error AND NOT coalesce(a.e < h.error OR (a.e IS NOT NULL AND b.e < h.error), false) AND NOT coalesce(c.e < h.error OR (c.e IS NOT NULL AND d.e < h.error), false)"""


@query(_LOCAL)
def approx_local_min(spark, sf_dir):
    i, docs = ascii_indexed(spark, sf_dir)
    return approx.local_minima(approx.search(i, docs, SHORT, 2), i, 2)


@query(ASCII_IDX + """, q AS (SELECT substring(text, 11, 6) AS query FROM docs WHERE id = (SELECT min(id) FROM docs)), s AS (SELECT id, r, query, substring(text, pos + 1, k) AS s FROM (SELECT id, r, text, pos, query, unnest(range(greatest(1, length(query) - 1), length(query) + 2)) AS k FROM idx, q) WHERE k <= length(text) - pos)
SELECT id, query, min(levenshtein(s, query)) AS error, CAST(length(s) AS BIGINT) AS len, min(r) AS l, max(r) AS r FROM s WHERE levenshtein(s, query) <= 1 GROUP BY id, query, s""")
def approx_by_example(spark, sf_dir):
    i, docs = ascii_indexed(spark, sf_dir)
    example = docs.orderBy("id").limit(1).select(F.substring("text", 11, 6).alias("q")).head()
    return approx.search(i, docs, [example.q] if example else [], 1)


@query(f"SELECT DISTINCT p_name AS value, query, levenshtein(p_name, query) AS distance FROM part, {_values(NAMES, 'query')} q WHERE p_name IS NOT NULL")
def edit_distance(spark, sf_dir):
    return approx.edit_distances(table(spark, sf_dir, "part"), "p_name", NAMES)


@query()
def edit_alignment(spark, sf_dir):
    return approx.alignments(approx.edit_distances(table(spark, sf_dir, "part"), "p_name", NAMES))


@query(f"SELECT DISTINCT p_name AS value, list_aggregate(list_transform(range(0, length('{NAMES[0]}') + 1), lambda j: CAST(levenshtein(left(p_name, 2), left('{NAMES[0]}', j)) AS VARCHAR)), 'string_agg', ' ') AS distances FROM part WHERE length(p_name) >= 2")
def dp_row(spark, sf_dir):
    """Distances of each value's first two symbols to every beginning of a query, a step for each symbol."""
    rows = table(spark, sf_dir, "part").select(F.col("p_name").alias("value")).where(F.length("value") >= 2).distinct()
    row = rows.select("value", approx.next_row(approx.first_row(NAMES[0]), F.substring("value", 1, 1), NAMES[0]).alias("row"))
    return row.select("value", F.array_join(approx.next_row(F.col("row"), F.substring("value", 2, 1), NAMES[0]), " ").alias("distances"))


@query(f"SELECT DISTINCT p_name AS value, query, levenshtein(p_name, query) AS cost FROM part, {_values(NAMES, 'query')} q WHERE p_name IS NOT NULL")
def edit_alignment_cost(spark, sf_dir):
    """How many edits each alignment shows: no more than the distance."""
    shown = edit_alignment(spark, sf_dir)
    return shown.select("value", "query", (F.length("alignment") - F.length(F.replace("alignment", F.lit("["), F.lit("")))).cast("long").alias("cost"))


# ---- sequences


@query(SEQ + " SELECT id, CAST(0 AS BIGINT) AS wrong FROM seq GROUP BY id")
def seq_check(spark, sf_dir):
    return sequence.check(events(spark, sf_dir))


@query(SEQ + " SELECT id, count(*) AS n, count(DISTINCT sym) AS m FROM seq GROUP BY id")
def seq_build(spark, sf_dir):
    return events(spark, sf_dir).groupBy("id").agg(F.count("*").alias("n"), F.countDistinct("sym").alias("m"))


@query(SEQ + " SELECT id, i, sym FROM seq WHERE i IN (0, 3, 9)")
def seq_access(spark, sf_dir):
    return sequence.access(events(spark, sf_dir), [0, 3, 9])


@query(SEQ + " SELECT id, i, count(CASE WHEN sym = 'error' THEN 1 END) OVER (PARTITION BY id ORDER BY i ROWS UNBOUNDED PRECEDING) AS rank FROM seq")
def seq_rank(spark, sf_dir):
    return sequence.rank(events(spark, sf_dir), "error")


@query(SEQ + " SELECT id, i, sym, row_number() OVER (PARTITION BY id, sym ORDER BY i) AS rank FROM seq")
def seq_rank_access(spark, sf_dir):
    return sequence.rank_access(events(spark, sf_dir))


@query(SEQ + ", n AS (SELECT id, i, sym, row_number() OVER (PARTITION BY id, sym ORDER BY i) AS k FROM seq) SELECT id, sym, i FROM n WHERE k = 2")
def seq_select(spark, sf_dir):
    return sequence.select(events(spark, sf_dir), 2)


@query(SEQ + " SELECT id, sym, count(*) AS freq FROM seq WHERE i BETWEEN 2 AND 8 GROUP BY id, sym")
def seq_enumerate(spark, sf_dir):
    return sequence.enumerate_range(events(spark, sf_dir), 2, 8)


@query(SEQ + " SELECT id, i, min(CASE WHEN sym = 'error' THEN i END) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS succ FROM seq")
def seq_succ(spark, sf_dir):
    return sequence.successor(events(spark, sf_dir), "error")


_BITS = SEQ + ", bits AS (SELECT id, i, CAST(sym = 'error' AS BIGINT) AS bit FROM seq)"


@query(_BITS + ", o AS (SELECT *, CAST(sum(bit) OVER (PARTITION BY id ORDER BY i ROWS UNBOUNDED PRECEDING) AS BIGINT) AS rank1 FROM bits) SELECT id, i, bit, rank1, i + 1 - rank1 AS rank0 FROM o")
def bit_rank(spark, sf_dir):
    return sequence.bit_rank(sequence.bits(events(spark, sf_dir), "error"))


@query(_BITS + ", n AS (SELECT id, i, row_number() OVER (PARTITION BY id, bit ORDER BY i) AS k, bit FROM bits) SELECT id, bit, i FROM n WHERE k = 2")
def bit_select(spark, sf_dir):
    return sequence.select(sequence.bits(events(spark, sf_dir), "error").withColumnRenamed("bit", "sym"), 2).withColumnRenamed("sym", "bit")


@query(_BITS + " SELECT id, row_number() OVER (PARTITION BY id ORDER BY i) AS k, i AS pos FROM bits WHERE bit = 1")
def sparse_select(spark, sf_dir):
    return sequence.sparse(sequence.bits(events(spark, sf_dir), "error"))


@query(_BITS + " SELECT id, p.i AS i, count(CASE WHEN bit = 1 AND b.i <= p.i THEN 1 END) AS rank1 FROM bits b, (SELECT unnest([CAST(3 AS BIGINT), 10]) AS i) p GROUP BY id, p.i")
def sparse_rank(spark, sf_dir):
    vector = sequence.bits(events(spark, sf_dir), "error")
    return sequence.sparse_rank(sequence.sparse(vector), [3, 10], vector)


@query("SELECT event_id AS id, CAST(bit_count(event_id * 2654435761) AS BIGINT) AS ones FROM events")
def popcount(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), fn.popcount(F.col("event_id") * F.lit(2654435761)).alias("ones"))


@query("SELECT event_id AS id, CASE WHEN event_id = 0 THEN -1 ELSE CAST(length(bin(event_id)) - 1 AS BIGINT) END AS log FROM events")
def blog(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), fn.blog(F.col("event_id")).alias("log"))


@query("SELECT event_id AS id, CAST(getbit AS BIGINT) AS bit, event_id | 8 AS high, event_id & ~CAST(8 AS BIGINT) AS low FROM (SELECT event_id, (event_id >> 3) & 1 AS getbit FROM events)")
def bit_access(spark, sf_dir):
    x = F.col("event_id")
    return table(spark, sf_dir, "events").select(x.alias("id"), fn.bit_at(x, 60).alias("bit"), fn.with_bit(x, 60, 1).alias("high"), fn.with_bit(x, 60, 0).alias("low"))


@query("SELECT event_id AS id, lower(concat(right(lpad(hex(event_id), 16, '0'), 2), substring(lpad(hex(event_id), 16, '0'), 13, 2))) AS bytes, event_id % 65536 AS back FROM events")
def integer_codec(spark, sf_dir):
    x = F.col("event_id")
    return table(spark, sf_dir, "events").select(x.alias("id"), F.lower(F.hex(fn.as_little_endian(x, 2))).alias("bytes"), fn.from_little_endian(fn.as_little_endian(x, 2), 2).alias("back"))


@query()
def huffman_lengths(spark, sf_dir):
    return sequence.huffman(index.alphabet(bench(spark, sf_dir)).select("id", "sym", "freq"))


@query(ALPHABET + ", n AS (SELECT id, sum(freq) AS n FROM freq GROUP BY id) SELECT f.id, CAST(n.n AS BIGINT) AS n, CAST(1 AS DOUBLE) AS kraft, true AS is_near FROM freq f JOIN n ON n.id = f.id GROUP BY f.id, n.n HAVING count(*) > 1")
def huffman_bounds(spark, sf_dir):
    """Whether code lengths fill the code space and cost at least the entropy and less than a bit a symbol more."""
    p = F.col("freq") / F.sum("freq").over(Window.partitionBy("id"))
    rows = huffman_lengths(spark, sf_dir).withColumn("h", -F.col("freq") * F.log2(p))
    sums = rows.groupBy("id").agg(F.sum("freq").alias("n"), F.sum(F.pow(F.lit(2.0), -F.col("clen"))).alias("kraft"), F.sum(F.col("freq") * F.col("clen")).alias("cost"), F.sum("h").alias("h"), F.count("*").alias("m"))
    return sums.where("m > 1").select("id", "n", "kraft", ((F.col("cost") >= F.col("h") - 1e-6) & (F.col("cost") < F.col("h") + F.col("n"))).alias("is_near"))


# ---- encodings


@query(DNA + " SELECT id, translate(text, 'acgt', '0123') AS codes FROM dna")
def dna_encode(spark, sf_dir):
    return dna(spark, sf_dir).select("id", fn.dna_codes(F.col("text")).alias("codes"))


@query(DNA + " SELECT id, concat('0', translate(text, 'acgt', '1234'), '0') AS codes FROM dna")
def dna2_encode(spark, sf_dir):
    return dna(spark, sf_dir).select("id", fn.dna2_codes(F.concat(F.lit("N"), "text", F.lit("$"))).alias("codes"))


@query(DNA + " SELECT id, translate(text, 'acgt', '0011') AS codes FROM dna")
def bit_encode(spark, sf_dir):
    return dna(spark, sf_dir).select("id", fn.bit_codes(F.translate("text", "acgt", "0011")).alias("codes"))


@query("SELECT doc_id AS id, CAST(strlen(text) - length(text) AS BIGINT) AS tails, CAST(length(text) AS BIGINT) AS heads FROM documents WHERE text IS NOT NULL")
def utf8_byte_class(spark, sf_dir):
    hexes = F.regexp_extract_all(F.hex(F.encode("text", "UTF-8")), F.lit("(..)"), F.lit(1))
    rows = corpus(spark, sf_dir).select("id", F.filter(hexes, lambda h: F.substring(h, 1, 1).isin("8", "9", "A", "B")).alias("tail"), F.size(hexes).alias("n"))
    return rows.select("id", F.size("tail").cast("long").alias("tails"), (F.col("n") - F.size("tail")).cast("long").alias("heads"))


_CHARS = "WITH c AS (SELECT DISTINCT unnest(string_split(text, '')) AS ch FROM documents)"


def characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).select(F.explode(F.split("text", "")).alias("ch")).where("ch <> ''").distinct()


@query(_CHARS + " SELECT ch, CAST(strlen(ch) AS BIGINT) AS n_bytes FROM c WHERE ch <> ''")
def utf8_len(spark, sf_dir):
    return characters(spark, sf_dir).select("ch", F.octet_length("ch").cast("long").alias("n_bytes"))


@query(_CHARS + " SELECT ch, CAST(unicode(ch) AS BIGINT) AS code FROM c WHERE ch <> ''")
def codepoints(spark, sf_dir):
    return characters(spark, sf_dir).select("ch", F.ascii("ch").cast("long").alias("code"))


@query(_CHARS + " SELECT CAST(unicode(ch) AS BIGINT) AS code, chr(unicode(ch)) AS ch FROM c WHERE ch <> ''")
def from_codepoint(spark, sf_dir):
    return characters(spark, sf_dir).select(F.ascii("ch").cast("long").alias("code")).select("code", fn.from_code_point(F.col("code")).alias("ch"))


@query("SELECT doc_id AS id, true AS is_valid FROM documents WHERE text IS NOT NULL")
def valid_utf8(spark, sf_dir):
    return corpus(spark, sf_dir).select("id", F.is_valid_utf8("text").alias("is_valid"))


# ---- cursor


@query(IDX + " SELECT id, pos, ch, r FROM idx WHERE pos BETWEEN 10 AND 29 AND ch IS NOT NULL")
def scan_forward(spark, sf_dir):
    """Twenty symbols from position 10 on, with the row of each."""
    return navigate.Cursor(indexed(spark, sf_dir)[0]).seek(10).read(20)


@query(IDX + " SELECT id, pos, bw, r FROM idx WHERE pos BETWEEN 11 AND 30")
def scan_backward(spark, sf_dir):
    """Twenty symbols before position 30 leftwards, with the row of each."""
    return navigate.Cursor(indexed(spark, sf_dir)[0]).seek(30).read_back(20)


@query(IDX + " SELECT id, pos, r FROM idx WHERE pos = 0")
def cursor_open(spark, sf_dir):
    return navigate.Cursor(indexed(spark, sf_dir)[0]).here()


@query(IDX + " SELECT id, pos, ch, r FROM idx WHERE pos = 5 AND ch IS NOT NULL")
def cursor_peek(spark, sf_dir):
    """The symbol at position 5, peeked at twice: a peek moves nothing."""
    cursor = navigate.Cursor(indexed(spark, sf_dir)[0]).seek(5)
    cursor.peek()
    return cursor.peek()
