"""Pattern mining over a collection: frequent, left-, right- and two-sided maximal substrings, k-mers, diversity.

Frequent strings are found level by level over the places where the level before is frequent: a string of k + 1 symbols can
only be frequent at a position if those of k symbols there and at the next position are, so a level joins the places of the
one before with themselves, one position apart. Counts are aggregated before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import cut
from .index import symbols, windows
from .search import rows_of

#: Frequent strings of a level up to which they are sent to where the places are.
FEW = 100_000


def frequent(docs: DataFrame, least: int) -> DataFrame:
    """(gram, occ, nexts): all strings of at least ``least`` occurrences, with how many different symbols follow them."""
    if least < 1:
        raise ValueError("the threshold must be at least 1")
    places = symbols(docs).select("id", "pos", F.col("ch").alias("gram"), "next")
    out = None
    while True:
        counted = places.groupBy("gram").agg(F.count("*").alias("occ"), F.countDistinct(F.when(F.col("next") != "", F.col("next"))).alias("nexts"))
        now = cut(counted.where(F.col("occ") >= least))
        many = now.count()
        out = now if out is None else out.unionByName(now) if many else out
        if not many:
            return out
        grams = now.select("gram")
        here = cut(places.join(F.broadcast(grams) if many <= FEW else grams, "gram", "left_semi").select("id", "pos", "gram", "next"))
        after = here.select("id", (F.col("pos") - 1).alias("pos"), F.col("gram").alias("later"), F.col("next").alias("further"))
        # the later string begins where this one's second symbol stands, so its last symbol is this one's next
        places = here.where("next <> ''").join(after, ["id", "pos"]).select("id", "pos", F.concat("gram", "next").alias("gram"), F.col("further").alias("next"))


def left_maximal(all_frequent: DataFrame) -> DataFrame:
    """Frequent strings that no frequent string extends to the left."""
    longer = all_frequent.where("length(gram) > 1").select(F.expr("substring(gram, 2)").alias("gram")).distinct()
    return all_frequent.join(longer, "gram", "left_anti")


def right_maximal(all_frequent: DataFrame) -> DataFrame:
    """Frequent strings that no frequent string extends to the right."""
    longer = all_frequent.where("length(gram) > 1").select(F.expr("left(gram, length(gram) - 1)").alias("gram")).distinct()
    return all_frequent.join(longer, "gram", "left_anti")


def maximal(all_frequent: DataFrame) -> DataFrame:
    """Left-maximal ones that aren't always followed by the same one symbol."""
    return left_maximal(all_frequent).where("nexts <> 1")


def grams(docs: DataFrame, k: int) -> DataFrame:
    """(gram): every occurrence of a string of k symbols."""
    return windows(docs, k).where(F.length("part") == k).select(F.col("part").alias("gram"))


def kmer_counts(docs: DataFrame, k: int, symbols: str = "acgt") -> DataFrame:
    """(kmer, path, occ) of the strings of length k over the symbols; the path of a walk by prepending is the reverse."""
    counted = grams(docs, k).groupBy(F.col("gram").alias("kmer")).agg(F.count("*").alias("occ"))
    return counted.where(F.length(F.translate("kmer", symbols, "")) == 0).select("kmer", F.reverse("kmer").alias("path"), "occ")


def substring_freq(docs: DataFrame, longest: int) -> DataFrame:
    """(gram, occ) of all substrings up to a length: the windows of that length are counted first, then their beginnings."""
    counted = windows(docs, longest).where("part <> ''").groupBy("part").agg(F.count("*").alias("occ"))
    cells = counted.select("occ", F.explode(F.transform(F.sequence(F.lit(1), F.length("part")), lambda k: F.substring("part", F.lit(1), k))).alias("gram"))
    return cells.groupBy("gram").agg(F.sum("occ").alias("occ"))


def diversity(index: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, key, left_kinds, right_kinds): distinct symbols before and after each key; the text's ends don't count."""
    later = index.select("id", F.col("pos").alias("at"), F.col("ch").alias("sym"))
    hit = rows_of(nodes, index, ["pos", "bw"]).withColumn("at", F.col("pos") + F.col("depth")).join(later, ["id", "at"])
    return hit.groupBy("id", "key").agg(F.countDistinct("bw").alias("left_kinds"), F.countDistinct("sym").alias("right_kinds"))


def approx_frequent(docs: DataFrame, k: int, errors: int, least: int) -> DataFrame:
    """(gram, occ): k-grams of which the k-grams within ``errors`` edits occur at least ``least`` times together.

    Two k-grams within e edits share one of e + 1 pieces, shifted by at most e, so pairs are joined on pieces; k has to be
    long enough for them.
    """
    if errors < 0 or errors + 1 > k:
        raise ValueError("a k-gram needs a symbol for each of errors + 1 pieces")
    counts = grams(docs, k).groupBy("gram").agg(F.count("*").alias("occ"))
    size = k // (errors + 1)
    starts = [i * size for i in range(errors + 1)]
    ones = counts.select("gram", F.explode(F.array(*[F.struct(F.lit(s).alias("at"), F.expr(f"substring(gram, {s + 1}, {size})").alias("piece")) for s in starts])).alias("x")).select("gram", "x.at", "x.piece")
    places = sorted({(s, t) for s in starts for t in range(max(0, s - errors), min(k - size, s + errors) + 1)})
    twos = counts.select(F.col("gram").alias("other"), "occ", F.explode(F.array(*[F.struct(F.lit(s).alias("at"), F.expr(f"substring(gram, {t + 1}, {size})").alias("piece")) for s, t in places])).alias("x")).select("other", "occ", "x.at", "x.piece")
    pairs = ones.join(twos, ["at", "piece"]).select("gram", "other", "occ").distinct()
    near = pairs.where(F.levenshtein("gram", "other", errors) >= 0)
    return near.groupBy("gram").agg(F.sum("occ").alias("occ")).where(F.col("occ") >= least)
