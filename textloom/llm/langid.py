"""Language identification by cross-parsing entropy with suffix automata.

For each language the text of a bounded sample of whole labelled documents becomes a suffix automaton, which recognises
all substrings of the sample. A text is parsed greedily into the longest phrases that the automaton knows, across words;
the language that needs the fewest phrases for a letter wins, ties to the smaller name.

The automata are laid out as one table: row of a state, column of a symbol, holding the next state and how many phrases
end there, so a step of many texts in all languages is one look-up. Texts of a batch take their steps together; what
remains of the few longest is parsed alone. Where the table would exceed ``TABLE_CELLS`` (huge alphabets), the automata
parse by themselves, with the same result.

Words are maximal runs of letters, lower-cased, with one space between, before the first and after the last. A text that
is null or holds no letter gets ``und`` and score 0. The score is the margin between the best two languages as a share of
the second, 1 if only one was learned. With nothing learned every text is ``und``. Rows without an id teach nothing and
are predicted like any other; rows may repeat; other columns don't matter.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stats import map_text

#: The sample: so many whole documents of a language at most, chosen by a hash of the id, those of more characters than
#: ``LONG_CHARS`` last, and as many of them as fit into the language's equal share of ``SAMPLE_CHARS`` (one at least).
SAMPLE_DOCS, LONG_CHARS, SAMPLE_CHARS, FOLDS, HELD_OUT = 48, 20_000, 320_000, 3, 1
TABLE_CELLS, FEW = 48_000_000, 16
_BETWEEN = re.compile(r"[\W\d_]+")


def normal(text: str) -> str:
    """Lower-case words with one space around each; empty without letters."""
    words = _BETWEEN.sub(" ", text.lower()).strip(" ")
    return f" {words} " if words else ""


class SuffixAutomaton:
    """The substrings of a text; transitions are keyed by state and symbol."""

    def __init__(self, text: str):
        go: list[dict[str, int]] = [{}]
        link, size, last = [-1], [0], 0
        for c in text:
            cur = len(go)
            go.append({})
            size.append(size[last] + 1)
            link.append(0)
            p = last
            while p != -1 and c not in go[p]:
                go[p][c] = cur
                p = link[p]
            if p != -1:
                q = go[p][c]
                if size[p] + 1 == size[q]:
                    link[cur] = q
                else:
                    clone = len(go)
                    go.append(dict(go[q]))
                    size.append(size[p] + 1)
                    link.append(link[q])
                    while p != -1 and go[p].get(c) == q:
                        go[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
        self.go = go

    def phrases(self, text: str) -> int:
        """How many longest-match phrases the text falls into; an unknown symbol is one phrase."""
        go, n, state = self.go, 0, self.go[0]
        fresh = True
        for c in text:
            to = state.get(c)
            if to is None:
                n += 0 if fresh else 1
                to = go[0].get(c)
                if to is None:
                    n += 1
                    state, fresh = go[0], True
                    continue
            state, fresh = go[to], False
        return n + (0 if fresh else 1)


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", ids: str = "doc_id") -> dict[str, SuffixAutomaton]:
    """Automata by language, from documents outside the held-out fold."""
    held = F.crc32(F.col(ids).cast("string")) % FOLDS == HELD_OUT
    rows = docs.where(F.col(ids).isNotNull() & F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held)
    long = (F.length(text) > LONG_CHARS).alias("long")
    rows = rows.select(F.col(lang).alias("lang"), F.col(text).alias("text"), long, F.xxhash64(ids).alias("at"), F.col(ids).alias("id"), F.xxhash64(text).alias("key"))
    # the rank filter becomes a limit per language before the shuffle; texts are read again, for the chosen rows only
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("long", "at", "id", "key"))
    chosen = rows.drop("text").withColumn("turn", turn).where(F.col("turn") <= SAMPLE_DOCS).select("lang", "id", "key", "turn")
    texts = rows.select("lang", "id", "key", "text").join(F.broadcast(chosen), ["lang", "id", "key"]).dropDuplicates(["lang", "id", "key"])
    got: dict[str, list[tuple[int, str]]] = {}
    for row in texts.select("lang", "turn", "text").toLocalIterator():
        got.setdefault(row.lang, []).append((row.turn, normal(row.text)))
    share, out = SAMPLE_CHARS // max(1, len(got)), {}
    for name, found in sorted(got.items()):
        parts: list[str] = []
        for _, part in sorted(found):
            if part and (not parts or sum(map(len, parts)) + len(part) <= share):
                parts.append(part)
        out[name] = SuffixAutomaton("\0".join(parts))  # no phrase goes from one document to another
    return out


def sparse(automata: dict[str, SuffixAutomaton]) -> tuple[list[str], list[tuple[np.ndarray, np.ndarray, np.ndarray, int]]]:
    """The symbols, and each automaton's transitions as arrays (state, symbol's number, next state) with its number of states."""
    symbols = sorted({c for a in automata.values() for c in a.go[0]} - {"\0"})
    number = {c: i + 1 for i, c in enumerate(symbols)}
    out = []
    for a in automata.values():
        cells = [(s, number[c], to) for s, go in enumerate(a.go) for c, to in go.items() if c in number]
        state, symbol, to = np.array(cells, np.int32).reshape(-1, 3).T
        out.append((state, symbol, to, len(a.go)))
    return symbols, out


class Parser:
    """Phrase counts of many texts at once; symbol 0 is any that no language knows."""

    def __init__(self, names: list[str], symbols: list[str], automata: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]]):
        self.names, width = names, len(symbols) + 1
        self.number = np.zeros(0x110000, np.uint8 if width < 256 else np.int32)
        self.number[[ord(c) for c in symbols]] = np.arange(1, width)
        bases = np.cumsum([0, *(n for *_, n in automata)])
        # cells hold the next state's row << 2 | phrases that end
        self.table = np.empty((int(bases[-1]), width), np.int32)
        self.root = (bases[:-1] * width).astype(np.int32)
        for base, (state, symbol, to, n) in zip(bases.tolist(), automata):
            mine = self.table[base : base + n]
            start = np.full(width, base * width << 2 | 1, np.int32)  # an unknown symbol is a phrase, the next one starts anew
            first = state == 0
            start[symbol[first]] = (base + to[first]) * width << 2
            mine[:] = start + 1
            mine[0] = start
            mine[state, symbol] = (base + to) * width << 2
        self.table = self.table.reshape(-1)

    def counts(self, texts: list[str]) -> np.ndarray:
        """For each normal text and language, its phrases."""
        out = np.zeros((len(texts), len(self.names)), np.int64)
        size = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-size, kind="stable")
        sorted_size = size[order]
        flat = self.number[np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")]
        start = (np.cumsum(size) - size)[order]
        state = np.repeat(self.root[:, None], len(texts), 1)
        n = np.zeros(state.shape, np.int64)
        # how many texts are longer than each step
        longest = int(sorted_size[0]) if len(texts) else 0
        many = np.searchsorted(-sorted_size, -np.arange(longest), "left")
        alone = int(np.searchsorted(-many, -FEW, "right")) if longest else 0
        for t in range(alone):
            k = many[t]
            v = self.table[state[:, :k] + flat[start[:k] + t]]
            state[:, :k] = v >> 2
            n[:, :k] += v & 3
        cells = memoryview(self.table)
        for i in range(int(many[alone]) if alone < longest else 0):
            rest = flat[start[i] + alone : start[i] + sorted_size[i]].tolist()
            for j in range(len(self.names)):
                s, m = int(state[j, i]), 0
                for c in rest:
                    v = cells[s + c]
                    s = v >> 2
                    m += v & 3
                state[j, i] = s
                n[j, i] += m
        out[order] = (n + (state != self.root[:, None])).T
        return out


def best(names: list[str], phrases: np.ndarray, letters: np.ndarray) -> tuple[list[str], np.ndarray]:
    if not names:
        return ["und"] * len(letters), np.zeros(len(letters))
    win = phrases.argmin(1)
    ranked = np.sort(phrases, 1)
    score = (ranked[:, 1] - ranked[:, 0]) / np.maximum(ranked[:, 1], 1) if len(names) > 1 else np.ones(len(letters))
    return ["und" if not z else names[w] for w, z in zip(win, letters)], np.where(letters, score, 0.0)


def predict(docs: DataFrame, automata: dict[str, SuffixAutomaton], text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns, lang_pred and score."""
    names = list(automata)
    symbols, arrays = sparse(automata)
    dense = sum(n for *_, n in arrays) * (len(symbols) + 1) <= TABLE_CELLS
    # bounded by the sample's parameters
    shared = docs.sparkSession.sparkContext.broadcast((symbols, arrays) if dense else list(automata.values()))
    parsers: list[Parser] = []

    def make(column: pa.Array) -> list[pa.Array]:
        texts = [normal(t or "") for t in column.to_pylist()]
        if not names:
            phrases = np.zeros((len(texts), 0))
        elif dense:
            if not parsers:
                parsers.append(Parser(names, *shared.value))
            phrases = parsers[0].counts(texts)
        else:
            phrases = np.array([[a.phrases(t) for a in shared.value] for t in texts], np.int64).reshape(len(texts), len(names))
        lang, score = best(names, phrases, np.array([bool(t) for t in texts], bool))
        return [pa.array(lang, pa.string()), pa.array(score, pa.float64())]

    return map_text(docs, text, keep or ["doc_id"], make, "lang_pred string, score double")
