"""Token rules T1-T12 as Spark ``Column`` expressions.

All rules are JVM-side expressions (regex, higher-order array functions), so
they stay inside whole-stage code generation and never call Python per row.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.schema import EDIT_LETTERS, STOP_WORDS

__all__ = [
    "WORD_CLASS", "tokens_ws", "tokens_word", "tokens_word2", "treebank_text",
    "tokens_treebank", "normalize_text", "stopword_filter", "word_ngrams",
    "char_text", "char_windows", "char_wb_ngrams", "strip_id_suffix", "alpha_flag",
    "edit1_variants", "TREEBANK_RULES", "treebank_sql",
]

# Unicode word characters: letters, numbers, underscore.  Plain ``\w`` is
# ASCII-only in Java regex, which would split accented words.
WORD_CLASS = r"[\p{L}\p{N}_]"


# What separates words for a unicode-aware ``split()``; Java's and RE2's ``\s`` are ASCII-only.
# Written so that both engines read it.
SPACE = "[\\t\\n\\x0B\\f\\r\\x1C-\\x20\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"

# Runs of SPACE but a lone space, which one space would replace.
_SPACES = f"{SPACE.replace('-' + chr(92) + 'x20', '-' + chr(92) + 'x1F')}{SPACE}*| {SPACE}+"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens_ws(text) -> Column:
    """Whitespace tokens, case kept (``str.split()``)."""
    return F.filter(F.split(_col(text), SPACE + "+"), lambda x: x != "")


def tokens_word(text) -> Column:
    """Runs of unicode word characters, case kept (``re.findall(r'\\w+')``)."""
    return F.regexp_extract_all(_col(text), F.lit(WORD_CLASS + "+"), 0)


def tokens_word2(text) -> Column:
    """Count-vectoriser tokens: lower-cased runs of two or more word characters."""
    return F.regexp_extract_all(F.lower(_col(text)), F.lit(WORD_CLASS + "{2,}"), 0)


# The treebank-style word tokenizer as an ordered list of
# (pattern, replacement) pairs; ``\N`` in a replacement is group N.
TREEBANK_RULES = [
    (r'^"', r"`` "),
    (r'([ (\[{<])"', r"\1 `` "),
    (r"([:,])([^0-9])", r" \1 \2"),
    (r"([:,])$", r" \1 "),
    (r"\.\.\.", r" ... "),
    (r"([;@#$%&])", r" \1 "),
    (r"([^.])(\.)(\s|$)", r"\1 \2 "),
    (r"([?!])", r" \1 "),
    (r"([^'])' ", r"\1 ' "),
    (r"([\]\[(){}<>])", r" \1 "),
    (r"--", r" -- "),
    (r'"', r" '' "),
    (r"([^' ])('s|'m|'d|') ", r"\1 \2 "),
    (r"([^' ])('ll|'re|'ve|n't) ", r"\1 \2 "),
    # words written as one
    (r"(?i)\b(can)(not)\b", r" \1 \2 "),
    (r"(?i)\b(d)('ye)\b", r" \1 \2 "),
    (r"(?i)\b(gim)(me)\b", r" \1 \2 "),
    (r"(?i)\b(gon)(na)\b", r" \1 \2 "),
    (r"(?i)\b(got)(ta)\b", r" \1 \2 "),
    (r"(?i)\b(lem)(me)\b", r" \1 \2 "),
    (r"(?i)\b(more)('n)\b", r" \1 \2 "),
    (r"(?i)\b(wan)(na)\b", r" \1 \2 "),
    (r"(?i) ('t)(is)\b", r" \1 \2 "),
    (r"(?i) ('t)(was)\b", r" \1 \2 "),
]


def _java_repl(r: str) -> str:
    # Java replacement syntax: groups are $N, a literal $ would need escaping.
    out, i = [], 0
    while i < len(r):
        if r[i] == "\\" and i + 1 < len(r) and r[i + 1].isdigit():
            out.append("$" + r[i + 1])
            i += 2
        else:
            out.append(r[i])
            i += 1
    return "".join(out)


# What a rule of TREEBANK_RULES takes, in lower case, where that is a fixed string.
_LITERALS = {
    r"\.\.\.": ["..."], r"([^'])' ": ["' "], "--": ["--"], '"': ['"'],
    r"([^' ])('s|'m|'d|') ": ["'"], r"([^' ])('ll|'re|'ve|n't) ": ["'"],
    r"(?i)\b(can)(not)\b": ["cannot"], r"(?i)\b(d)('ye)\b": ["d'ye"], r"(?i)\b(gim)(me)\b": ["gimme"],
    r"(?i)\b(gon)(na)\b": ["gonna"], r"(?i)\b(got)(ta)\b": ["gotta"], r"(?i)\b(lem)(me)\b": ["lemme"],
    r"(?i)\b(more)('n)\b": ["more'n"], r"(?i)\b(wan)(na)\b": ["wanna"], r"(?i) ('t)(is)\b": [" 'tis"], r"(?i) ('t)(was)\b": [" 'twas"],
}
# Without one of these, only the rules below and contractions without an apostrophe change a text.
_SPECIAL = r"""["';@#$%&?!\[\](){}<>]|--|\.\.\."""
_PLAIN_RULES = [r"([:,])([^0-9])", r"([:,])$", r"([^.])(\.)(\s|$)"]


def _bound(c: Column, f) -> Column:
    """``f(c)`` with ``c`` worked out once however often ``f`` names it."""
    return F.element_at(F.transform(F.array(c), f), 1)


def _rule(pattern: str, repl: str, lower: bool):
    def apply(t):
        changed = F.regexp_replace(t, pattern, _java_repl(repl))
        if pattern == r"([:,])$":
            return F.when(F.endswith(t, F.lit(":")) | F.endswith(t, F.lit(",")), changed).otherwise(t)
        if pattern not in _LITERALS:
            return changed
        seen = t if lower or not pattern.startswith("(?i)") else F.lower(t)
        return F.when(functools.reduce(Column.__or__, [F.contains(seen, F.lit(v)) for v in _LITERALS[pattern]]), changed).otherwise(t)
    return apply


def _apply_rules(t: Column, rules, lower: bool) -> Column:
    return functools.reduce(lambda x, r: _bound(x, _rule(*r, lower)), rules, t)


def treebank_text(text, lower: bool = True) -> Column:
    """T4 as text: the tokenizer's output joined by single spaces.

    A rule that needs a fixed string is tried on texts that hold it, and texts
    without special characters skip all rules for those.
    """
    t = _col(text)
    if lower:
        t = F.lower(t)
    t = F.concat(F.trim(F.regexp_replace(t, _SPACES, " ")), F.lit(" "))
    plain = [r for r in TREEBANK_RULES if r[0] in _PLAIN_RULES or (r[0] in _LITERALS and all(v.isalpha() for v in _LITERALS[r[0]]))]
    t = _bound(t, lambda x: F.when(F.rlike(x, F.lit(_SPECIAL)), _apply_rules(x, TREEBANK_RULES, lower)).otherwise(_apply_rules(x, plain, lower)))
    return F.trim(F.regexp_replace(t, " {2,}", " "))    # spaces are all that is left of SPACE


def tokens_treebank(text, lower: bool = True) -> Column:
    """T4: treebank-style tokens (punctuation, quotes and contractions split)."""
    return tokens_ws(treebank_text(text, lower))


def treebank_sql(expr: str, lower: bool = True) -> str:
    """The same chain as DuckDB SQL, for oracle queries."""
    t = f"lower({expr})" if lower else expr
    t = f"trim(regexp_replace({t}, '{SPACE}+', ' ', 'g')) || ' '"
    for pattern, repl in TREEBANK_RULES:
        p = pattern.replace("'", "''")
        r = repl.replace("'", "''")
        t = f"regexp_replace({t}, '{p}', '{r}', 'g')"
    return f"trim(regexp_replace({t}, '{SPACE}+', ' ', 'g'))"


def normalize_text(text) -> Column:
    """T5: lower-case, collapse whitespace to one space, strip, drop outer quotes, ``"`` -> ``'``."""
    t = F.trim(F.regexp_replace(F.lower(_col(text)), SPACE + "+", " "))
    t = F.regexp_replace(t, r'^"+|"+$', "")
    return F.regexp_replace(t, '"', "'")


def stopword_filter(tokens, stop_words=None) -> Column:
    """Drop stop words from a token array."""
    words = F.array(*[F.lit(w) for w in (stop_words or STOP_WORDS)])
    return F.filter(_col(tokens), lambda x: ~F.array_contains(words, x))


def word_ngrams(tokens, lo: int, hi: int, sep: str = " ") -> Column:
    """Word n-grams for n in lo..hi, tokens joined by ``sep``; n-major order.

    ``tokens`` should name a column computed in an earlier projection: the
    lambda reads it once per n-gram, and an inlined tokenizer expression would
    be re-run for every position.
    """
    t = _col(tokens)
    n_tok = F.size(t)

    def grams(n):
        return F.when(
            n_tok >= n,
            F.transform(F.sequence(F.lit(1), n_tok - n + 1),
                        lambda i: F.array_join(F.slice(t, i, n), sep)),
        ).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.array(*[grams(n) for n in range(lo, hi + 1)]))


def char_text(text) -> Column:
    """T8 input: the lower-cased text, runs of two or more whitespace characters as one space."""
    return F.regexp_replace(F.lower(_col(text)), SPACE + "{2,}", " ")


def char_windows(text, hi: int) -> Column:
    """The ``hi`` characters (fewer at the end) from every position of a text, in one scan of it."""
    return F.regexp_extract_all(_col(text), F.lit(f"(?s)(?=(.{{1,{hi}}}))."), F.lit(1))


def char_wb_ngrams(word, lo: int, hi: int) -> Column:
    """T9 on one word: n-grams of `` word ``; a padded word shorter than n is emitted once."""
    padded = F.concat(F.lit(" "), _col(word), F.lit(" "))
    length = F.length(padded)
    top = F.least(F.lit(hi), length)
    return F.flatten(F.transform(
        F.sequence(F.lit(lo), F.greatest(top, F.lit(lo))),
        lambda n: F.when(
            n <= length,
            F.transform(F.sequence(F.lit(1), length - n + 1), lambda i: F.substring(padded, i, n)),
        ).otherwise(F.array().cast("array<string>")),
    ))


def strip_id_suffix(id_col) -> Column:
    """Remove every ``.txt`` from an id."""
    return F.regexp_replace(_col(id_col), r"\.txt", "")


def alpha_flag(token) -> Column:
    """Token consists of letters only (``str.isalpha``)."""
    return _col(token).rlike(r"^\p{L}+$")


def edit1_variants(words: DataFrame, word_col: str = "word") -> DataFrame:
    """Every string one delete, transpose, replace or insert (a-z) away, the word included.

    Input: a DataFrame of words.  Output: distinct ``(word, variant)`` pairs.
    """
    letters = F.array(*[F.lit(c) for c in EDIT_LETTERS])
    w = F.col(word_col)
    base = words.select(w.alias("word")).distinct()
    w = F.col("word")
    n = F.length(w)
    cut = base.select("word", F.explode(F.sequence(F.lit(0), n)).alias("i"))
    left = F.substring(w, 1, F.col("i"))          # word[:i]
    right = F.expr("substring(word, i + 1)")       # word[i:]
    right1 = F.expr("substring(word, i + 2)")      # word[i+1:]
    right2 = F.expr("substring(word, i + 3)")      # word[i+2:]
    has_r = F.col("i") < n
    deletes = cut.filter(has_r).select("word", F.concat(left, right1).alias("variant"))
    transposes = cut.filter(F.col("i") < n - 1).select(
        "word", F.concat(left, F.expr("substring(word, i + 2, 1)"),
                         F.expr("substring(word, i + 1, 1)"), right2).alias("variant"))
    with_c = cut.select("word", "i", F.explode(letters).alias("c"))
    replaces = with_c.filter(F.col("i") < n).select(
        "word", F.concat(left, F.col("c"), right1).alias("variant"))
    inserts = with_c.select("word", F.concat(left, F.col("c"), right).alias("variant"))
    return deletes.unionByName(transposes).unionByName(replaces).unionByName(inserts).distinct()
