"""DuckDB SQL for the fixtures, shared by the oracle queries.

Each fixture is a CTE body; ``with_sql`` assembles the ones a query needs.
The definitions restate ``plans/fixtures.py`` in plain SQL.  The treebank rule
list and the whitespace class are shared with the Spark code; golden tests hold
them to fixed rows.
"""

from __future__ import annotations

from wordloom.functions.tokens import SPACE, treebank_sql

WORD_RE = r"[\p{L}\p{N}_]+"


def explode_sql(list_expr: str, keep: str = "doc_id, lang", src: str = "documents",
                pos: str = "pos", word: str = "word") -> str:
    """Token table from a list expression over ``src``: (keep..., pos, word)."""
    ks = ", ".join(f"d.{k.strip()}" for k in keep.split(","))
    return f"""
SELECT {ks}, r.i::INT AS {pos}, d.t[r.i + 1] AS {word}
FROM (SELECT {keep}, {list_expr} AS t FROM {src}) d, unnest(range(len(d.t))) AS r(i)"""


WS_LIST = f"list_filter(regexp_split_to_array(text, '{SPACE}+'), lambda x: x <> '')"


def tb_list(expr: str = "text", lower: bool = True) -> str:
    return f"list_filter(string_split({treebank_sql(expr, lower)}, ' '), lambda x: x <> '')"


CTE = {
    "tokens": explode_sql(f"regexp_extract_all(lower(text), '{WORD_RE}')"),
    "ws_tokens": explode_sql(WS_LIST),
    "tf": """
SELECT doc_id, word, count(*) AS tf FROM tokens GROUP BY doc_id, word""",
    "word_vectors": """
SELECT wr.word, e.embedding
FROM (SELECT word, row_number() OVER (ORDER BY count(*) DESC, word) - 1 AS r
      FROM tokens GROUP BY word HAVING count(*) >= 5) wr
JOIN embeddings e ON e.vec_id = wr.r""",
    "n_docs": """
SELECT count(*) AS n FROM documents""",
    "idf": """
SELECT word, count(*) AS df, log2((SELECT n FROM n_docs) / count(*)) AS idf FROM tf GROUP BY word""",
    "tfidf": """
SELECT doc_id, word, tf, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS tfidf
FROM (SELECT tf.doc_id, tf.word, tf.tf, tf.tf * idf.idf AS w
      FROM tf JOIN idf USING (word) WHERE idf.idf <> 0)""",
    "predictions": """
SELECT doc_id, lang AS label,
       CASE WHEN (doc_id * 7919) % 10 < 7 THEN lang
            ELSE ['de', 'en', 'es', 'fr'][(doc_id % 4)::INT + 1] END AS prediction
FROM documents""",
    "tag_lexicon": """
SELECT word, ['DT', 'IN', 'NN', 'VB', 'JJ', 'RB', 'PRP', 'CD'][(r % 8)::INT + 1] AS tag
FROM (SELECT word, row_number() OVER (ORDER BY count(*) DESC, word) - 1 AS r
      FROM (SELECT unnest(regexp_extract_all(text, '""" + WORD_RE + """')) AS word FROM documents)
      GROUP BY word)
WHERE r < 200""",
    "spelling_lexicon": """
SELECT DISTINCT unnest(regexp_extract_all(lower(text), '""" + WORD_RE + """')) AS word FROM benchmark""",
    "cv_metrics": """
SELECT g.option, g.size, g."window", g.c, (d.doc_id % 5)::INT AS fold,
       avg(CASE WHEN (CASE WHEN (d.doc_id * 7919 + g.size * 7 + g."window" * 13 + g.c * 3 + length(g.option) * 5) % 10 < 7
                           THEN d.lang ELSE ['de', 'en', 'es', 'fr'][(d.doc_id % 4)::INT + 1] END) = d.lang
                THEN 1.0 ELSE 0.0 END) AS score
FROM documents d,
     (SELECT o AS option, s::INT AS size, w::INT AS "window", c::INT AS c
      FROM unnest(['mean', 'sum']) t1(o), unnest([100, 300]) t2(s), unnest([5, 9]) t3(w), unnest([1, 10]) t4(c)) g
GROUP BY 1, 2, 3, 4, 5""",
}


def context_cte(w: int) -> str:
    """Context-vector fixture for window ``w`` (needs ``ws_tokens``)."""
    half = w // 2
    offs = [o for o in range(-half, half + 1) if o != 0]
    return f"""
SELECT o.off::INT AS "offset", wr.word, e.embedding[1:{64 // w}] AS embedding
FROM (SELECT word, row_number() OVER (ORDER BY count(*) DESC, word) - 1 AS r
      FROM ws_tokens GROUP BY word HAVING count(*) >= 5) wr,
     unnest({offs}) AS o(off),
     (SELECT count(*) AS n FROM embeddings) nn,
     embeddings e
WHERE wr.r < nn.n AND (wr.r + o.off) % 37 <> 0
  AND e.vec_id = ((wr.r + o.off) % nn.n + nn.n) % nn.n"""


def with_sql(names, body: str, extra: dict | None = None) -> str:
    """``WITH`` the named fixture CTEs (in the given order), then ``body``."""
    defs = dict(CTE, **(extra or {}))
    parts = [f"{n} AS ({defs[n]}\n)" for n in names]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


__all__ = ["CTE", "with_sql", "treebank_sql", "WORD_RE", "explode_sql", "tb_list", "WS_LIST", "context_cte"]
