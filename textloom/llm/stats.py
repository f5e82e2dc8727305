"""Counts over whole texts, many texts at once, that the quality operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import buffers, dictionary, line_bounds, ranges, tuples, word_bounds
from .scratch import small_batches

SYMBOLS = b"#*$%&|<>"
WINDOW = 5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct_words", "n_lines", "n_code_points", "n_upper", "n_digits", "n_points", "n_longest_word")


def _per_text(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[off[1:]] - total[off[:-1]]


def _distinct(code: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """How many distinct codes each text has."""
    most = int(code.max(initial=0)) + 1
    return np.bincount(np.unique(text * most + code) // most, minlength=n)


def count_texts(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    n = len(off) - 1
    hist = np.stack([np.bincount(data[a:b], minlength=256) for a, b in zip(off[:-1].tolist(), off[1:].tolist())])
    s, e, cut = word_bounds(data, off)
    words, _ = dictionary(data, s, e)
    n_words = np.diff(cut)
    text = np.repeat(np.arange(n), n_words)
    # words in windows that occur twice in their text: the window's text is a sixth member of the tuple
    full = max(0, len(words) - WINDOW + 1)
    at = np.flatnonzero(text[:full] == text[WINDOW - 1 :]) if full else np.zeros(0, np.int64)
    window = np.unique(tuples(words, WINDOW)[at], return_inverse=True)[1]
    _, back, many = np.unique(text[at] * (len(at) + 1) + window, return_inverse=True, return_counts=True)
    edge = np.zeros(len(words) + WINDOW + 1, np.int32)
    at = at[many[back] > 1]
    edge[at] += 1
    edge[at + WINDOW] -= 1
    covered = np.cumsum(edge)[: len(words)] > 0
    # lines with a word, and the distinct ones
    ls, le, lt = line_bounds(data, off)
    used = np.searchsorted(s, le) > np.searchsorted(s, ls)
    lines = np.bincount(lt[used], minlength=n)
    line, _ = dictionary(data, ls[used], le[used])
    white = hist[:, 9:14].sum(1) + hist[:, 32]
    points = hist[:, :128].sum(1) + hist[:, 192:].sum(1)
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, text, e - s)
    return {
        "n_words": n_words,
        "word_chars": points - white,
        "n_symbols": hist[:, list(SYMBOLS)].sum(1),
        "n_dup_lines": lines - _distinct(line, lt[used], n),
        "n_repeat_words": _per_text(covered, cut),
        "n_distinct_words": _distinct(words, text, n),
        "n_lines": lines,
        "n_code_points": points,
        "n_upper": hist[:, 65:91].sum(1),
        "n_digits": hist[:, 48:58].sum(1),
        "n_points": hist[:, list(b".,;:!?")].sum(1),
        "n_longest_word": longest,
    }


def count_batch(column: pa.Array) -> dict[str, np.ndarray]:
    data, off = buffers(column)
    parts = [count_texts(data[off[i] : off[j]], off[i : j + 1] - off[i]) for i, j in ranges(off)]
    return {c: np.concatenate([p[c] for p in parts]) if parts else np.zeros(0, np.int64) for c in COUNTS}


def map_text(df: DataFrame, text: str, keep: list[str], make, made: str) -> DataFrame:
    """The kept columns and what ``make`` gives for each batch of texts; ``made`` is the schema of that.

    The text travels once even if it is kept. ``make`` takes an Arrow column and returns Arrow columns.
    """
    small_batches(df.sparkSession)
    kinds = dict(df.dtypes)
    read = keep if text in keep else [*keep, text]
    at, kept = read.index(text), range(len(keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [*(batch.column(i) for i in kept), *make(batch.column(at))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = [*keep, *(x.split()[0] for x in made.split(", "))]
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), made])
    return df.select(*(F.col(f"`{c}`") for c in read)).mapInArrow(run, schema)


def with_counts(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """The kept columns and the counts of each whole text (null: empty)."""

    def make(column: pa.Array) -> list[pa.Array]:
        counts = count_batch(column)
        return [pa.array(counts[c], pa.int64()) for c in COUNTS]

    return map_text(df, text, keep, make, ", ".join(f"{c} long" for c in COUNTS))


def features(counts: dict[str, np.ndarray]) -> np.ndarray:
    """Ratios that don't depend on what a text is about, one row a text; see FEATURES."""
    c = {k: v.astype(np.float64) for k, v in counts.items()}
    return np.stack([c[top] if below is None else c[top] / np.maximum(c[below], 1) for top, below in FEATURES.values()], 1)


FEATURES = {
    "words": ("n_words", None),
    "chars_per_word": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "points_per_word": ("n_points", "n_words"),
    "repeated_share": ("n_repeat_words", "n_words"),
    "distinct_share": ("n_distinct_words", "n_words"),
    "dup_lines_per_line": ("n_dup_lines", "n_lines"),
    "words_per_line": ("n_words", "n_lines"),
    "upper_share": ("n_upper", "n_code_points"),
    "digit_share": ("n_digits", "n_code_points"),
    "longest_word": ("n_longest_word", None),
}


def feature_columns() -> dict[str, F.Column]:
    """The same ratios as Spark expressions over the count columns."""
    return {
        name: (F.col(top).cast("double") if below is None else F.col(top) / F.greatest(F.col(below), F.lit(1)))
        for name, (top, below) in FEATURES.items()
    }


def labelled_sample(docs: DataFrame, labels: DataFrame, text: str, ids: str, label: str, rows: int, folds: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Counts and labels of at most ``rows`` labelled documents outside the held-out fold, chosen by a hash of the id."""
    held = F.crc32(F.col(ids).cast("string")) % folds == 0
    known = labels.where(F.col(ids).isNotNull() & F.col(label).isNotNull() & ~held).groupBy(ids).agg(F.min(label).cast("int").alias("_label"))
    chosen = known.orderBy(F.xxhash64(ids), ids).limit(rows)
    # at most ``rows`` ids: their size is bounded whatever the corpus holds
    picked = docs.select(ids, text).join(F.broadcast(chosen), ids)
    got = with_counts(picked, text, ["_label"]).toPandas()
    return {c: got[c].to_numpy() for c in COUNTS}, got["_label"].to_numpy().astype(np.int64)
