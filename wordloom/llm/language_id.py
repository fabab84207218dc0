"""Language identification of words and of whole, possibly mixed, texts.

1. Letters belong to scripts (fixed code-point ranges).  A word's script leaves
   as candidates the languages that use it for a share of their letters.
2. Every candidate scores a word by its letter trigrams, word edges included.
3. Viterbi over a text's words, with a penalty for every switch of language,
   labels spans; a text's language is the one that labels most letters.

Training counts trigrams over all labelled texts; a task adds its texts up in
one table of fixed size per language before anything moves, so a language that
holds most rows is one row per task.

Defined cases: null text, and text without a letter, is ``und`` with score 0 and
no spans.  Rows without a language are not learned from.  Ties go to the
language that sorts first.  Without any training text every text is ``und``.
Repeated rows are counted and labelled each.  Columns other than those named are
not read.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from itertools import chain, groupby

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.llm.tables import release, unused_name
from wordloom.llm.words import column_slices

BUCKETS = 1 << 16       # trigrams are counted in so many buckets per language
SWITCH = 8.0            # penalty of a change of language, in nats
SCRIPT_SHARE = 0.01     # a language uses a script if this share of its letters is in it
CACHED_WORDS = 200_000  # a task forgets its word scores beyond this many words
SLICE_BYTES = 1 << 20   # of texts that are labelled at a time, with up to eight languages; fewer with more

# First and last code point of scripts.
SCRIPTS = [
    ("Latin", 0x0041, 0x024F), ("Latin", 0x1E00, 0x1EFF), ("Greek", 0x0370, 0x03FF), ("Greek", 0x1F00, 0x1FFF),
    ("Cyrillic", 0x0400, 0x052F), ("Armenian", 0x0530, 0x058F), ("Hebrew", 0x0590, 0x05FF),
    ("Arabic", 0x0600, 0x06FF), ("Arabic", 0x0750, 0x077F), ("Devanagari", 0x0900, 0x097F),
    ("Bengali", 0x0980, 0x09FF), ("Gurmukhi", 0x0A00, 0x0A7F), ("Gujarati", 0x0A80, 0x0AFF),
    ("Tamil", 0x0B80, 0x0BFF), ("Telugu", 0x0C00, 0x0C7F), ("Kannada", 0x0C80, 0x0CFF),
    ("Malayalam", 0x0D00, 0x0D7F), ("Thai", 0x0E00, 0x0E7F), ("Georgian", 0x10A0, 0x10FF),
    ("Ethiopic", 0x1200, 0x137F), ("Kana", 0x3040, 0x30FF), ("Han", 0x3400, 0x4DBF), ("Han", 0x4E00, 0x9FFF),
    ("Hangul", 0x1100, 0x11FF), ("Hangul", 0xAC00, 0xD7AF),
]
NAMES = list(dict.fromkeys(s[0] for s in SCRIPTS)) + ["Other"]

UND = "und"


def _ranges(kind: str, first: int, last: int) -> str:
    """The code points of a general category from ``first`` to ``last``, as the inside of a character class."""
    points = [c for c in range(first, last + 1) if unicodedata.category(chr(c))[0] == kind]
    runs = [[c for _, c in g] for _, g in groupby(enumerate(points), lambda x: x[1] - x[0])]
    return "".join(f"\\U{r[0]:08x}-\\U{r[-1]:08x}" for r in runs)


def _word(last: int):
    """A letter, then letters and the marks that combine with them, up to a code point."""
    letters, marks = _ranges("L", 0, last), _ranges("M", 0, last)
    return re.compile(f"[{letters}][{letters}{marks}]*")


# a class with ranges beyond the basic plane is searched range by range, so texts without such characters get one without them
WORD, BASIC_WORD, BEYOND_BASIC = _word(0x10FFFF), _word(0xFFFF), re.compile("[\U00010000-\U0010ffff]")


def word_pattern(text: str):
    """The pattern that finds the words of ``text``."""
    return WORD if not text.isascii() and BEYOND_BASIC.search(text) else BASIC_WORD


def script_of(word: str) -> int:
    """Index into NAMES of the script of a word's first letter."""
    c = ord(word[0])
    return next((NAMES.index(n) for n, a, b in SCRIPTS if a <= c <= b), len(NAMES) - 1)


def lower(words) -> list[str]:
    """The words in lower case; a word stays one word."""
    return "\n".join(words).lower().split("\n")


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each trigram of ``_word_``, index of the word it is in)."""
    codes = np.frombuffer(("\n" + "\n".join(words) + "\n").encode("utf-32-le"), np.uint32).astype(np.uint64)
    owner = np.cumsum(codes == 10) - 1
    mid = codes[1:-1]
    inside = mid != 10
    h = (codes[:-2] * np.uint64(0x9E3779B1) + mid) * np.uint64(0x85EBCA77) + codes[2:] * np.uint64(0xC2B2AE3D)
    h ^= h >> np.uint64(29)
    return ((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(48))[inside].astype(np.int64) % BUCKETS, owner[1:-1][inside]


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict:
    """The model: languages, log probabilities [language x bucket], scripts used [language x script].

    Counts cover every row.  One row per language and task is summed, then one
    table of fixed size per language reaches the driver.
    """
    src = (docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
           .select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")))
    width = BUCKETS + len(NAMES)

    def run(batches):
        import pyarrow as pa
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for a, b, texts in column_slices(batch.column(1)):
                of: dict[str, Counter] = {}
                for lang, text in zip(langs[a:b], texts):
                    of.setdefault(lang, Counter()).update(lower(word_pattern(text).findall(text)))
                for lang, counts in of.items():
                    counts.pop("", None)
                    if counts:
                        total = sums.setdefault(lang, np.zeros(width, np.int64))
                        words, n = list(counts), np.fromiter(counts.values(), np.int64, len(counts))
                        bucket, owner = trigrams(words)
                        total[:BUCKETS] += np.bincount(bucket, n[owner], BUCKETS).astype(np.int64)
                        letters = n * np.fromiter(map(len, words), np.int64, len(words))
                        scripts = np.fromiter(map(script_of, words), np.int64, len(words))
                        total[BUCKETS:] += np.bincount(scripts, letters, len(NAMES)).astype(np.int64)
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at)), pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["lang", "at", "n"])
        release()

    def fit(of_lang):
        """One language's row of the model, from at most ``width`` counts."""
        import pyarrow as pa
        total = np.zeros(width)
        np.add.at(total, of_lang.column("at").to_numpy(), of_lang.column("n").to_numpy())
        grams, scripts = total[:BUCKETS] + 0.1, total[BUCKETS:]
        logp = np.log(grams / grams.sum()).astype(np.float32)
        uses = scripts / max(scripts.sum(), 1) >= SCRIPT_SHARE
        return pa.table({"lang": of_lang.column("lang")[:1], "logp": pa.array([logp.tobytes()]), "uses": pa.array([uses.tobytes()])})

    counted = src.mapInArrow(run, "lang string, at int, n long").groupBy("lang", "at").agg(F.sum("n").alias("n"))
    rows = counted.groupBy("lang").applyInArrow(fit, "lang string, logp binary, uses binary").collect()
    rows.sort(key=lambda r: r["lang"].encode())
    return {"langs": [r["lang"] for r in rows],
            "logp": np.stack([np.frombuffer(r["logp"], np.float32) for r in rows]) if rows else np.empty((0, BUCKETS), np.float32),
            "uses": np.stack([np.frombuffer(r["uses"], bool) for r in rows]) if rows else np.empty((0, len(NAMES)), bool)}


def score_words(model: dict, words: list[str]) -> np.ndarray:
    """[word x language]: trigram log probabilities, minus infinity where the script rules a language out."""
    bucket, owner = trigrams(words)
    out = np.stack([np.bincount(owner, p[bucket], len(words)) for p in model["logp"]], axis=1).astype(np.float32)
    can = model["uses"].T[np.fromiter(map(script_of, words), np.int64, len(words))]
    can |= ~can.any(axis=1, keepdims=True)      # a script that no language was seen with rules nothing out
    return np.where(can, out, np.float32(-1e6))


def viterbi(scores: np.ndarray, starts: np.ndarray, counts: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best language of every word of several texts, stepping through all texts at once.

    ``scores`` [word x language] holds the texts one after another.
    """
    order = np.argsort(-counts, kind="stable")
    starts, counts = starts[order], counts[order]
    kind = np.min_scalar_type(scores.shape[1])      # holds every label
    back = np.empty(scores.shape, kind)
    labels = np.empty(len(scores), kind)
    own = np.arange(scores.shape[1], dtype=kind)[None, :]
    live = np.searchsorted(-counts, -np.arange(1, counts[0] + 1), "right") if len(counts) else np.empty(0, int)
    best = scores[starts[: live[0]]] if len(live) else scores[:0]
    final = np.empty(len(counts), kind)
    for t in range(1, len(live)):
        n = live[t]
        if n < len(best):
            final[n:len(best)] = best[n:].argmax(axis=1)
            best = best[:n]
        top = best.argmax(axis=1)
        jump = np.take_along_axis(best, top[:, None], 1) - switch
        moved = jump > best
        at = starts[:n] + t
        back[at] = np.where(moved, top[:, None].astype(kind), own)
        best = np.where(moved, jump, best) + scores[at]
    if len(live):
        final[: len(best)] = best.argmax(axis=1)
    now = final
    for t in range(len(live) - 1, -1, -1):
        n = live[t]
        at = starts[:n] + t
        labels[at] = now[:n]
        if t:
            now[:n] = back[at, now[:n]]
    return labels


class WordScores:
    """Scores of words by number; new words get the next numbers."""

    def __init__(self, model: dict):
        self.model, self.number, self.table = model, {}, np.empty((0, len(model["langs"])), np.float32)

    def numbers(self, words: list[str]) -> np.ndarray:
        if len(self.number) > CACHED_WORDS:
            self.__init__(self.model)
        number = self.number
        fresh = [w for w in dict.fromkeys(words) if w not in number]
        if fresh:
            number.update(zip(fresh, range(len(number), len(number) + len(fresh))))
            self.table = np.concatenate([self.table, score_words(self.model, fresh)])
        return np.fromiter(map(number.__getitem__, words), np.int64, len(words))


def identify(docs: DataFrame, model: dict, text_col: str = "text", switch: float = SWITCH,
             spans: bool = True, added: tuple[str, str, str] = ("lang_pred", "score", "spans")) -> DataFrame:
    """Add ``lang_pred``, ``score`` and, if asked, ``spans`` to every row.

    The score is the share of the text's letters that are labelled with
    ``lang_pred``.  A span is (lang, start, end) in characters of the text.  The
    added names (``added`` gives others) replace columns that the input may have under
    them; all other columns pass as they came.
    """
    given = docs.drop(*added[: 2 + spans])
    plain = isinstance(given.schema[text_col].dataType, T.StringType)
    src = given if plain else given.withColumn(unused_name(given, "text"), F.col(text_col).cast("string"))
    extra = [T.StructField(added[0], T.StringType()), T.StructField(added[1], T.DoubleType())]
    if spans:
        extra.append(T.StructField(added[2], T.ArrayType(T.StructType([
            T.StructField("lang", T.StringType()), T.StructField("start", T.IntegerType()),
            T.StructField("end", T.IntegerType())]))))
    schema, langs, names = T.StructType([*given.schema.fields, *extra]), model["langs"], given.columns
    text_at = names.index(text_col) if plain else len(names)
    shared = docs.sparkSession.sparkContext.broadcast(model)   # fixed size: languages x buckets
    most = max(1 << 14, SLICE_BYTES * 8 // max(8, len(langs)))  # a slice's scores are words x languages

    def label(texts, scores):
        """(language, score, spans) of each text of a slice."""
        words = [word_pattern(t).findall(t) if t and langs else [] for t in texts]
        counts = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.concatenate(([0], np.cumsum(counts)))[:-1]
        flat = lower(chain.from_iterable(words))
        if not len(counts) or not counts.any():
            return [(UND, 0.0, [])] * len(texts)
        numbers = scores.numbers(flat)
        best = viterbi(scores.table[numbers], starts, counts, switch)
        letters = np.fromiter(map(len, flat), np.int64, len(flat))
        owner = np.repeat(np.arange(len(texts)), counts)
        share = np.bincount(owner * len(langs) + best, letters, len(texts) * len(langs)).reshape(len(texts), -1)
        top, total = share.argmax(axis=1), share.sum(axis=1)
        out = []
        for i, t in enumerate(texts):
            if not counts[i]:
                out.append((UND, 0.0, []))
                continue
            found = []
            if spans:
                mine = best[starts[i]: starts[i] + counts[i]]
                edge = np.flatnonzero(np.diff(mine)) + 1
                at = [m.span() for m in word_pattern(t).finditer(t)]
                for a, b in zip([0, *edge], [*edge, counts[i]]):
                    found.append((langs[mine[a]], at[a][0], at[b - 1][1]))
            out.append((langs[top[i]], float(share[i, top[i]] / total[i]), found))
        return out

    def run(batches):
        import pyarrow as pa
        scores = WordScores(shared.value)
        for batch in batches:
            found = list(chain.from_iterable(label(texts, scores) for _, _, texts in column_slices(batch.column(text_at), most)))
            more = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            if spans:
                more.append(pa.array([[dict(zip(("lang", "start", "end"), s)) for s in f[2]] for f in found],
                                     pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *more],
                                             [*names, *(f.name for f in extra)])
        del scores
        release()

    return src.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    """True for the quarter of documents that training never sees."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2
