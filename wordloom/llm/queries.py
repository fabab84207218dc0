"""The queries of this folder: one per operator, over its whole table, and their SQL where SQL can say it.

A query is ``fn(spark, sf_dir)``.  It calls its operator with the operator's
own defaults and derives the columns of its contract from the result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm import (chat, decontaminate, divergence, exact_dedup, language_id, lexical, license_scan, packing, simhash,
                          substring_dedup, toxicity, vector_search, warc)
from wordloom.llm.tables import small_table
from wordloom.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


@register("op1_best_fit_packing")
def op1_best_fit_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), added_tokens=True)


@register("op2_exact_dedup", """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""")
def op2_exact_dedup(spark, sf_dir):
    return exact_dedup.classes(table(spark, sf_dir, "documents"))


@register("op3_decontamination")
def op3_decontamination(spark, sf_dir):
    """One row per contaminated document and item: the longest verified stretch of words."""
    found = decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.groupBy("doc_id", "item_id").agg(
        F.max(F.struct("words", "matches", F.negative("doc_start").alias("at"))).alias("best")).select(
        "doc_id", "item_id", F.negative("best.at").alias("doc_start"), "best.words", "best.matches")


#: The tool that the turns of ``conversations`` are read as calls of.
REPLY = """{"type":"object","additionalProperties":false,"required":["prompt","chars"],"properties":{
"prompt":{"type":"string"},"chars":{"type":"integer","minimum":1,"maximum":2000},"context":{"type":"string"}}}"""


def conversation_messages(conversations: DataFrame) -> DataFrame:
    """Every user turn as a call of ``reply``, every assistant turn as the result of the turn before it.

    A call's arguments are the turn's text, its length, and the result of the
    call two turns earlier.
    """
    name = lambda turn: F.concat_ws("-", "conv_id", turn)
    before = F.when(F.col("turn") >= 2, F.struct(name(F.col("turn") - 2).alias("$result")))
    user = F.col("role") == "user"
    arguments = F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("prompt"),
                                   F.length(F.coalesce("text", F.lit(""))).alias("chars"), before.alias("context")))
    return conversations.select(
        "conv_id", "turn", "role", F.when(~user, F.col("text")).alias("text"),
        F.when(user, name("turn")).when(F.col("role") == "assistant", name(F.col("turn") - 1)).alias("call_id"),
        F.when(user, "reply").alias("tool"), F.when(user, arguments).alias("arguments"))


@register("op4_chat_formatting")
def op4_chat_formatting(spark, sf_dir):
    tools = small_table(spark, [("reply", REPLY)], "tool string, schema string")
    return chat.link(conversation_messages(table(spark, sf_dir, "conversations")), tools)


@register("op5_substring_dedup", r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS seq
           FROM d, unnest(range(1, len(w) - 11)) AS t(i)),
gone AS (SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY seq) AS least FROM starts)
         WHERE least < doc_id),
covered AS (SELECT DISTINCT doc_id, i + k AS i FROM gone, unnest(range(13)) AS t(k)),
words AS (SELECT doc_id, i, w[i] AS word FROM d, unnest(range(1, len(w) + 1)) AS t(i)),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS kept
         FROM words ANTI JOIN covered USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)""")
def op5_substring_dedup(spark, sf_dir):
    found = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@register("op6_simhash_near_dedup")
def op6_simhash_near_dedup(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def _base32_sql(hex_digits: str) -> str:
    """SQL of the base32 letters of 40 hex digits: five digits are four letters."""
    letters = []
    for at in range(1, 41, 5):
        bits = f"CAST('0x' || substr({hex_digits}, {at}, 5) AS INTEGER)"
        letters += [f"substr('{warc.BASE32}', (({bits} >> {s}) & 31) + 1, 1)" for s in (15, 10, 5, 0)]
    return " || ".join(letters)


@register("op7_warc", f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS least
           FROM pages)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, {_base32_sql('sha1(html)')} AS payload_digest,
       CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> least THEN least END AS refers_to
FROM p""")
def op7_warc(spark, sf_dir):
    return warc.archive(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@register("op8_license_scan")
def op8_license_scan(spark, sf_dir):
    """Documents as files: the digits of a doc_id but the last are directories below the source."""
    digits = F.regexp_replace(F.col("doc_id").cast("string"), "([0-9])(?=[0-9])", "$1/")
    folder = F.regexp_extract(digits, "^(.*)/[0-9]$", 1)
    path = F.concat(F.col("source"), F.when(folder == "", "").otherwise(F.concat(F.lit("/"), folder)), F.lit("/"), "doc_id", F.lit(".txt"))
    files = table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), "text")
    return license_scan.scan(files, license_scan.template_table(spark))


@register("op9_language_id")
def op9_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn(
        "held_out", F.coalesce(language_id.held_out(), F.lit(False)))
    model = language_id.train(docs.filter(~F.col("held_out")))
    return language_id.identify(docs.select("doc_id", "held_out", "text"), model, spans=False).drop("text")


@register("op10_toxicity")
def op10_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").withColumn("low_quality", 1 - F.col("quality"))
    model = toxicity.fit(docs, labels, ["low_quality", "toxic"])
    return toxicity.predict(docs, model).drop("text")


@register("op11_source_divergence", r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (SELECT lang, source, doc_id, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT doc_id) >= 10),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang),
s AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT s.lang, s.source, kept.term, coalesce(c.n, 0) AS n,
             1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (s.total + 2 * v.v) AS p,
             1 + (1000000000::HUGEINT * (kept.n + 2)) // (v.n + 2 * v.v) AS whole
      FROM s JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = kept.term),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
                 coalesce((SELECT sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) FROM p x JOIN p y USING (lang, term)
                           WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0)::BIGINT AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
own AS (SELECT lang, source, 'term' AS part, term AS item, ((p - whole) * (p - whole) // (p + whole))::BIGINT AS value
        FROM p WHERE n > 0 AND p > whole),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
           FROM (FROM pairs UNION ALL FROM own))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10""")
def op11_source_divergence(spark, sf_dir):
    return divergence.audit(table(spark, sf_dir, "documents"))


@register("op12_ranked_search", r"""
WITH terms AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
               FROM documents),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                          '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
lengths AS (SELECT doc_id, count(*)::HUGEINT AS n FROM terms GROUP BY doc_id),
total AS (SELECT count(*)::HUGEINT AS docs, sum(n) AS len FROM lengths),
tf AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM terms SEMI JOIN asked USING (term) GROUP BY doc_id, term),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
      FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), total),
parts AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // len)))::BIGINT AS part
          FROM tf JOIN w USING (term) JOIN lengths USING (doc_id), total),
scores AS (SELECT item_id, doc_id, sum(part)::BIGINT AS score FROM asked JOIN parts USING (term) GROUP BY item_id, doc_id),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
           FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50""")
def op12_ranked_search(spark, sf_dir):
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op13_exact_topk", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank, vec_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s) WHERE rank <= 20""")
def op13_exact_topk(spark, sf_dir):
    return vector_search.nearest(table(spark, sf_dir, "embeddings"))
