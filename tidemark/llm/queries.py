"""The subpackage's registered queries: thin views of its operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm import langid

    docs = _table(spark, sf_dir, "documents")
    profiles = langid.fit(docs.where(~langid.held_out()))
    out = langid.identify(docs.select("doc_id", "text"), profiles)
    return out.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.substring_dedup import remove_repeated_passages

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = remove_repeated_passages(docs)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"), F.size("removed").cast("long").alias("n_spans"))


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.ann import nearest

    return nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op7_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.cover_tree import near_duplicate_vectors

    return near_duplicate_vectors(_table(spark, sf_dir, "embeddings"), threshold=0.98)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three edits a document: a third of the way in ten characters become two words, two thirds in a word is put in, and the last five characters go."""
    import public_tokenizers

    from tidemark.llm.token_count import RESULT, count_edited

    n = F.coalesce(F.length("text"), F.lit(0))
    third = F.floor(n / 3)

    def edit(start: F.Column, stop: F.Column, text: str) -> F.Column:
        return F.struct(start.cast("long").alias("start"), stop.cast("long").alias("stop"), F.lit(text).alias("text"))

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("edits", F.array(edit(third, third + 10, "two words"), edit(2 * third, 2 * third, " inserted"), edit(n - 6, n - 1, "")))
    out = count_edited(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", *RESULT)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.packing import pack

    docs = _table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", "source", F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).alias("n_words"), F.xxhash64("text").alias("cluster"))
    return pack(rows, F.col("n_words"), F.col("source"), F.col("cluster"), capacity=8192)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.suffix_dedup import remove_repeated_strings

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = remove_repeated_strings(docs)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept_bytes", 256).alias("kept_sha256"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.license_scan import RESULT, scan

    return scan(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *RESULT)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tidemark.llm.bpe import encode

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.simhash import near_duplicates

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs, carry_text=False).select("doc_id", "fingerprint", "component_id")


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.divergence import audit

    return audit(_table(spark, sf_dir, "documents").select("text", "lang", "source"), min_docs=30, top=50)


def op12_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tidemark.llm.transducer import encode

    out = encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.conversations import damaged, digests, repair

    rows = _table(spark, sf_dir, "conversations")
    summaries, turns = repair(damaged(rows), times_given="times")
    out = rows.select("conv_id").distinct()
    for found in (summaries, digests(turns)):
        found = found.withColumnRenamed("conv_id", "conv")
        out = out.join(found, F.col("conv_id").eqNullSafe(F.col("conv")), "left").drop("conv")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return out.select("conv_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in numbers), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_langid": op1_langid,
        "op2_substring_dedup": op2_substring_dedup,
        "op3_license_scan": op3_license_scan,
        "op4_bpe": op4_bpe,
        "op5_simhash": op5_simhash,
        "op6_ann": op6_ann,
        "op7_cover_tree": op7_cover_tree,
        "op8_token_counts": op8_token_counts,
        "op9_packing": op9_packing,
        "op10_suffix_dedup": op10_suffix_dedup,
        "op11_divergence": op11_divergence,
        "op12_bpe_transducer": op12_bpe_transducer,
        "op13_conversation_repair": op13_conversation_repair,
    }


_OP2 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
starts AS (SELECT doc_id, i, md5(array_to_string(ws[i : i + 34], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)),
again AS (SELECT h FROM starts GROUP BY 1 HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, j FROM (SELECT doc_id, unnest(range(i, i + 35)) AS j FROM starts SEMI JOIN again USING (h))),
words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS j FROM w),
marked AS (SELECT words.*, gone.j IS NOT NULL AS gone, coalesce(lag(gone.j IS NOT NULL) OVER (PARTITION BY words.doc_id ORDER BY words.j), false) AS before
           FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.j = words.j)
SELECT w.doc_id, len(any_value(ws))::BIGINT AS n_words, count(*) FILTER (gone) AS n_removed,
       sha256(coalesce(string_agg(word, ' ' ORDER BY j) FILTER (NOT gone), '')) AS kept_sha256, count(*) FILTER (gone AND NOT before) AS n_spans
FROM w LEFT JOIN marked ON marked.doc_id = w.doc_id GROUP BY 1
"""

_OP7 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT r.a AS vec_id, (SELECT count(*) FROM links WHERE links.a = r.a) AS n_links, min(r.b) AS component_id, r.a = min(r.b) AS kept FROM reach r GROUP BY 1
"""

_OP11 = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
numbered AS (SELECT *, row_number() OVER () AS i FROM d),
words AS (SELECT i, lang, source, unnest(ws) AS term FROM numbered),
kept AS (SELECT lang, term, count(*) AS n_lang FROM words GROUP BY 1, 2 HAVING count(DISTINCT i) >= 30),
grp AS (SELECT DISTINCT lang, source FROM d),
cnt AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
lng AS (SELECT lang, sum(n_lang)::HUGEINT + 5 * count(*) AS total, count(*) AS v FROM kept GROUP BY 1),
tot AS (SELECT g.lang, g.source, coalesce(sum(n), 0)::HUGEINT + 5 * any_value(v) AS total FROM grp g JOIN lng USING (lang) LEFT JOIN cnt c ON c.lang = g.lang AND c.source = g.source GROUP BY 1, 2),
share AS (SELECT t.lang, t.source, k.term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 5)) // t.total AS p, 1 + (1000000000::HUGEINT * (n_lang + 5)) // lng.total AS q
          FROM tot t JOIN kept k USING (lang) JOIN lng USING (lang) LEFT JOIN cnt c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term),
far AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM share a JOIN share b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
          FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN far f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
found AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM share WHERE n > 0 AND p > q),
ranked AS (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)))::INTEGER AS rank FROM (FROM pairs UNION ALL FROM found))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50
"""


def oracle_sql() -> dict[str, str]:
    """The rest is beyond SQL (profiles, XXH64, merges, searches, packing) or too slow in it (400-byte strings): see tests/llm."""
    return {"op2_substring_dedup": _OP2, "op7_cover_tree": _OP7, "op11_divergence": _OP11}
