"""The operators' registered queries over whole tables, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwarden.llm import decontaminate, licenses, mixing, pii, quality, simhash, substring, token_counts, toxicity, urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table; one that comes in fewer partitions than there are cores is dealt over all of them."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.fit_detect(docs, keep_text=False)
    base = F.filter("pii", lambda x: x.base)
    shown = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.start, x.end)), ",")
    of = lambda kind: lambda x: x.base & (x.kind == kind)
    counts = {f"n_{k}": F.size(F.filter("pii", of(k))).cast("long") for k in pii.BASE_KINDS}
    return found.select("doc_id", *(c.alias(n) for n, c in counts.items()), F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("pii")).alias("spans"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    import public_tokenizers

    docs = token_counts.token_counts(_table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer or public_tokenizers.path("byte_bpe_50k.json"))
    n_bytes = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    return docs.select("doc_id", n_bytes.alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality.learn(docs, _table(spark, sf_dir, "labels"))
    return quality.judge(docs, rules).select("doc_id", *quality.COUNTS[:5], "base_failed", "kept")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(pages).select("page_id", "host", "path", "rule", "verdict", "url_score")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, out="score")
    held_out = F.coalesce(toxicity.fold(F.col("doc_id")) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *(f"license.{c}" for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")))


QUERIES = {f.__name__: f for f in (op1_pii, op2_decontamination, op3_mixing, op4_token_counts, op5_quality_rules, op6_toxicity, op7_substring_dedup, op8_url_filter, op9_simhash, op10_license_scan)}

ORACLE_SQL = {
    "op7_substring_dedup": r"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
      win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS k FROM w, range(1, len(ws) - 48) t(i)),
      least AS (SELECT k, min(doc_id) AS d FROM win GROUP BY k),
      gone AS (SELECT DISTINCT win.doc_id, p FROM win JOIN least USING (k), range(i, i + 50) t(p) WHERE d < win.doc_id)
    SELECT w.doc_id, any_value(len(ws))::BIGINT AS n_words, count(g.p)::BIGINT AS n_removed, sha256(coalesce(string_agg(x.word, ' ' ORDER BY x.pos) FILTER (g.p IS NULL), '')) AS kept_sha256
    FROM w LEFT JOIN (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM w) x ON x.doc_id = w.doc_id LEFT JOIN gone g ON g.doc_id = x.doc_id AND g.p = x.pos GROUP BY w.doc_id""",
}
