"""Language identification by cross-parsing entropy.

For every language a suffix automaton is built over a bounded sample of labelled text.
A text is cross-parsed against each: the longest piece from here on that occurs in the
language's sample is one phrase, and parsing goes on behind it.  The number of phrases
times log2 of the sample's length, over the text's length, estimates the entropy of the
text given the language; the language with the least wins.

Sample (the documented bound): of each language the ``SAMPLE_WINDOWS`` windows of
``WINDOW`` characters whose text's hash is smallest, one window from a hashed place of each
distinct labelled text.  Only these windows reach the driver.  Whole texts are parsed, in
blocks of ``BLOCK`` symbols that all advance together (a phrase ends at its block's
end), so a long text costs no more memory than many short ones.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loam.llm.common import text_or_empty, unused

WINDOW = 400
SAMPLE_WINDOWS = 60
BLOCK = 256
#: Symbols parsed at once (bounds the memory of a worker's arrays).
LANES = 1 << 20
UNKNOWN = "und"


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Lower-case form (single code point) and letter flag of every code point."""
    lower, letter = np.arange(0x110000, dtype=np.uint32), np.zeros(0x110000, bool)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            letter[c] = True
            low = ch.lower()
            lower[c] = ord(low[0])
    return lower, letter


_FOLD: list[np.ndarray] = []


def fold(text: str) -> tuple[np.ndarray, bool]:
    """Code points of the folded text (letters lower-cased, all else a space, spaces once), and whether it has a letter."""
    if not _FOLD:
        _FOLD.extend(_tables())
    lower, letter = _FOLD
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    is_letter = letter[points]
    out = np.where(is_letter, lower[points], np.uint32(32))
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # a space only right behind a letter
    return out[keep], bool(is_letter.any())


def suffix_automaton(symbols: list[int], alphabet: int) -> np.ndarray:
    """Transition table (states x alphabet) of the suffix automaton; 0 (the start) where there is none."""
    links, lengths, edges = [-1], [0], [{}]
    last = 0
    for s in symbols:
        cur = len(lengths)
        lengths.append(lengths[last] + 1)
        links.append(0)
        edges.append({})
        p = last
        while p >= 0 and s not in edges[p]:
            edges[p][s] = cur
            p = links[p]
        if p >= 0:
            q = edges[p][s]
            if lengths[p] + 1 == lengths[q]:
                links[cur] = q
            else:
                clone = len(lengths)
                lengths.append(lengths[p] + 1)
                links.append(links[q])
                edges.append(dict(edges[q]))
                while p >= 0 and edges[p].get(s) == q:
                    edges[p][s] = clone
                    p = links[p]
                links[q] = links[cur] = clone
        last = cur
    table = np.zeros((len(lengths), alphabet), np.uint16 if len(lengths) < 1 << 16 else np.uint32)
    for state, out in enumerate(edges):
        for s, to in out.items():
            table[state, s] = to
    return table


@dataclass
class Model:
    """Per language the automaton and the length of its sample; symbols maps code points below its length."""
    langs: list[str]
    tables: list[np.ndarray]
    sizes: list[int]
    symbols: np.ndarray
    spark: SparkSession


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", windows: int = SAMPLE_WINDOWS,
        window: int = WINDOW) -> Model:
    """Learn from rows with text and a non-NULL language.

    Copies of a text count once: map tasks merge them before the shuffle.  A hot language
    meets the others only in a per-language top-n that Spark prunes in the map tasks.  Without labelled rows the model knows no language and predicts ``und``.
    """
    body = F.col(text)
    h = F.xxhash64(body)
    place = F.pmod(F.xxhash64(h, F.lit(1)), F.greatest(F.char_length(body) - window, F.lit(0)) + 1) + 1
    some = labelled.where(F.col(lang).isNotNull() & body.isNotNull()).select(
        F.col(lang).alias("lang"), h.alias("h"), F.substring(body, place.cast("int"), F.lit(window)).alias("piece")) \
        .where(F.col("piece").rlike(r"\p{L}"))
    some = some.groupBy("lang", "h").agg(F.min("piece").alias("piece"))
    top = some.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h", "piece"))) \
        .where(F.col("n") <= windows)
    texts: dict[str, list[str]] = {}
    for r in top.orderBy("lang", "n").select("lang", "piece").collect():
        texts.setdefault(r["lang"], []).append(r["piece"])
    langs = sorted(texts)
    folded = [np.concatenate([np.append(fold(t)[0], np.uint32(32)) for t in texts[x]]) for x in langs]
    seen = sorted({int(c) for x in folded for c in np.unique(x)})
    symbols = np.zeros(max(seen, default=0) + 1, np.int32)  # 0: a symbol that no sample has
    for k, c in enumerate(seen, 1):
        symbols[c] = k
    tables = [suffix_automaton(symbols[x].tolist(), len(seen) + 1) for x in folded]
    return Model(langs, tables, [len(x) for x in folded], symbols, labelled.sparkSession)


def phrases(blocks: np.ndarray, lengths: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Phrases of each block (columns of ``blocks``; lengths descending) against one automaton.

    A symbol that even the start doesn't know is a phrase of its own.
    """
    width = table.shape[1]
    flat = table.ravel()
    start = table[0]
    state = np.zeros(blocks.shape[1], np.int64)
    count = np.zeros(blocks.shape[1], np.int64)
    live = np.searchsorted(-lengths, -np.arange(blocks.shape[0]), side="left")  # blocks longer than each step
    for step in range(blocks.shape[0]):
        n = live[step]
        if not n:
            break
        sym = blocks[step, :n]
        now = flat[state[:n] * width + sym]
        ended = (now == 0) & (state[:n] != 0)  # the phrase ends before this symbol
        fresh = start[sym]
        count[:n] += ended
        count[:n] += (now == 0) & (fresh == 0)  # an unknown symbol
        state[:n] = np.where(now == 0, fresh, now)
    return count + (state != 0)


def _parse(folded: list[np.ndarray], model_tables: list[np.ndarray], symbols: np.ndarray) -> np.ndarray:
    """(texts, languages) numbers of phrases."""
    sizes = np.array([len(x) for x in folded])
    counts = -(-sizes // BLOCK)
    owner = np.repeat(np.arange(len(folded)), counts)
    out = np.zeros((len(folded), len(model_tables)), np.int64)
    if not len(owner):
        return out
    points = np.concatenate(folded)
    known = np.where(points < len(symbols), symbols[np.minimum(points, len(symbols) - 1)], 0)
    first = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    begin = np.concatenate([first[i] + np.arange(c) * BLOCK for i, c in enumerate(counts)])
    length = np.minimum(BLOCK, (first + sizes)[owner] - begin)
    per = max(1, LANES // BLOCK)
    order = np.argsort(-length, kind="stable")
    known = np.append(known, np.zeros(BLOCK, known.dtype))
    for at in range(0, len(order), per):
        some = order[at: at + per]
        blocks = np.ascontiguousarray(known[begin[some][:, None] + np.arange(BLOCK)].T)
        for k, table in enumerate(model_tables):
            out[:, k] += np.bincount(owner[some], phrases(blocks, length[some], table), len(folded)).astype(np.int64)
    return out


def predict(model: Model, docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score, in place of columns of those names (score, 0 to 1: how far the best language's entropy lies below the next).

    ``und`` with score 0 if the text is NULL or has no letter, or no language was learned.
    Ties go to the language that sorts first; with one language the score is 1.
    """
    shared = model.spark.sparkContext.broadcast((model.langs, model.tables, model.sizes, model.symbols))

    def classify(texts: pa.Array) -> pa.Array:
        langs, tables, sizes, symbols = shared.value
        names, scores = [], []
        for at in range(0, len(texts), 256):
            folded, letters = zip(*[fold(t.as_py()) for t in texts[at: at + 256]])
            found = _parse(list(folded), tables, symbols) * np.log2(np.maximum(sizes, 2)) if langs else None
            for i, has in enumerate(letters):
                if not has or found is None:
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                best = int(found[i].argmin())
                rest = np.delete(found[i], best)
                names.append(langs[best])
                scores.append(float(1 - found[i, best] / rest.min()) if len(rest) else 1.0)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                                          ["lang_pred", "score"])

    p = F.arrow_udf(classify, "lang_pred string, score double")(text_or_empty(text))
    own = [c for c in docs.columns if c not in ("lang_pred", "score")]
    name, = unused(docs, "p_")
    return docs.select(*own, p.alias(name)).select(*own, f"{name}.lang_pred", f"{name}.score")


