"""The registered queries of this subpackage and the SQL they must agree with where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir
from . import (bond, context_tree, cover_tree, mixing, neardup, packing, quality_model, quality_rules, rans, repair, simhash,
               toxicity, urls)
from .tokens import public_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(modulus: int) -> Column:
    """The crc32 of ``doc_id`` as text, modulo a number."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus))


@query
def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_path("word_bpe_49k.json"), 4096, 1)


@query
def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = mixing.draw_copies(table(spark, sf_dir, "documents"), weights=(1, 2, 3), max_copies=3)
    return drawn.select(F.col("id").alias("doc_id"), "source", "size", "source_size", "target", "copies",
                        (F.col("copies") * F.col("size")).alias("taken"))


URL_RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block",
             "net/fr/": "block"}


@query
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return judged.select("page_id", *[F.col("judged")[c].alias(c) for c in ("host", "path", "rule", "verdict")])


def _term(term: str) -> str:
    return f"regexp_matches(low, '(^|[^a-z0-9]){term}([^a-z0-9]|$)')"


ORACLES["op3_url_filter"] = f"""
    WITH parts AS (
      SELECT page_id, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
        CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
      FROM pages),
    hosts AS (
      SELECT page_id, low, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
        translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host
      FROM parts),
    ruled AS (
      SELECT page_id, host, path, CASE {" ".join(
          f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}') THEN '{h}/{p}'"
          for h, p in (r.split("/", 1) for r in sorted(URL_RULES, key=lambda r: (-len(r), r))))} END AS rule,
        {" OR ".join(map(_term, urls.STRICT))}
        OR {" + ".join(f"{_term(t)}::INT" for t in urls.SOFT)} >= {urls.SOFT_HITS} AS rejected
      FROM hosts)
    SELECT page_id, host, path, rule, CASE {" ".join(
        f"WHEN rule = '{r}' THEN '{v}'" for r, v in URL_RULES.items())}
      WHEN rejected THEN 'block' ELSE 'allow' END AS verdict
    FROM ruled"""


@query
def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


ORACLES["op4_exact_top_k"] = """
    WITH good AS (
      SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
      WHERE embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    parts AS (SELECT r, vec_id, unnest(v) AS x, unnest(range(len(v))) AS i, len(v) AS n FROM good),
    scores AS (
      SELECT a.r AS q, a.vec_id AS query_id, b.r, b.vec_id, sum(a.x * b.x)::BIGINT AS score
      FROM parts a JOIN parts b ON a.i = b.i AND a.n = b.n AND a.r != b.r
      WHERE a.vec_id % 100 = 0 GROUP BY ALL)
    SELECT query_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
    FROM scores QUALIFY rank <= 10"""


@query
def op5_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/tokens"
    rans.write_token_file(table(spark, sf_dir, "documents"), path, public_path("byte_bpe_50k.json"), 2)
    return rans.read_token_digests(spark, path)


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents").select("doc_id", "text"), id_remainder(5) == 0
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels").filter(~held_out))
    scored = toxicity.score_toxicity(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), F.col("toxicity.score").alias("score"),
                         F.col("toxicity.predicted").alias("predicted"), F.col("toxicity.spans").alias("spans"))


@query
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.apply_quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return judged.select("doc_id", *[F.col("quality")[c].alias(c) for c in names])


_Q = quality_rules
ORACLES["op7_quality_rules"] = f"""
    WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    texts AS (
      SELECT doc_id, text, regexp_extract_all(text, '{_Q.WORD}') AS words, string_split(text, chr(10)) AS lines FROM docs),
    judged AS (
      SELECT doc_id, text, words, list_filter(lines, lambda a: regexp_matches(a, '{_Q.WORD}')) AS full_lines,
        list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) AS wins
      FROM texts),
    windows AS (SELECT doc_id, unnest(wins) AS w, unnest(range(1, len(wins) + 1)) AS p FROM judged),
    twice AS (SELECT doc_id, p FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, w) >= 2),
    steps AS (SELECT doc_id, least(3, p - lag(p, 1, -3) OVER (PARTITION BY doc_id ORDER BY p)) AS step FROM twice),
    repeats AS (SELECT doc_id, sum(step)::BIGINT AS n FROM steps GROUP BY doc_id),
    lines AS (SELECT doc_id, unnest(full_lines) AS line FROM judged),
    marked AS (
      SELECT doc_id, len(regexp_extract_all(line, '{_Q.WORD}')) AS words, length(line) - length(translate(line, '{_Q.SYMBOLS}', '')) AS symbols,
        len(regexp_extract_all(line, '{_Q.MENU}')) AS marks, regexp_matches(line, '{_Q.LINE_END.replace("'", "''")}') AS ends,
        {" OR ".join(f"contains(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{p}')" for p in _Q.BOILERPLATE)} AS phrase
      FROM lines),
    lost AS (
      SELECT doc_id, sum(words)::BIGINT AS lost FROM marked
      WHERE symbols > {_Q.SYMBOL_SHARE}::DOUBLE * words OR (words BETWEEN 3 AND {_Q.END_WORDS} AND NOT ends)
        OR (marks >= 2 AND words <= {_Q.MENU_WORDS} * marks) OR (words <= 30 AND phrase)
      GROUP BY doc_id),
    measured AS (
      SELECT j.doc_id, len(words)::BIGINT AS n_words,
        length(regexp_replace(text, '{_Q.SPACE}', '', 'g'))::BIGINT AS word_chars,
        (length(text) - length(translate(text, '{_Q.SYMBOLS}', '')))::BIGINT AS n_symbols,
        (len(full_lines) - len(list_distinct(full_lines)))::BIGINT AS n_dup_lines,
        coalesce(r.n, 0) AS n_repeat_words, coalesce(l.lost, 0) AS lost
      FROM judged j LEFT JOIN repeats r ON j.doc_id = r.doc_id LEFT JOIN lost l ON j.doc_id = l.doc_id)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
      n_words < {_Q.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed,
      NOT (n_words < {_Q.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words) AND lost <= {_Q.MAX_LOST}::DOUBLE * n_words AS kept
    FROM measured"""


def graded_labels(labels: DataFrame) -> DataFrame:
    """``doc_id, grade``: 0 for poor, 1 for good but toxic, 2 for good and harmless."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 2)
    return labels.select("doc_id", grade.alias("grade"))


@query
def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_model.fit_grades(docs, graded_labels(table(spark, sf_dir, "labels")), 3)
    graded = quality_model.grade_documents(docs, model, cut=1, least=0.5)
    names = ("expected_grade", "tail_probability", "selected")
    return graded.select("doc_id", *[F.col("graded")[c].alias(c) for c in names])


@query
def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.link_documents(table(spark, sf_dir, "documents"), percent=85)


@query
def op10_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = context_tree.score_documents(table(spark, sf_dir, "documents"), id_remainder(7) == 2)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score",
                         "bits_per_byte")


@query
def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.link_by_simhash(table(spark, sf_dir, "documents"), radius=2)


@query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label, vec_id = F.col("label"), F.col("vec_id")
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label))
    return bond.hard_negatives(vectors, vec_id % 100 == 0, positives=5, negatives=10, low=30, high=90, times=256)


ORACLES["op12_hard_negatives"] = """
    WITH good AS (
      SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
      WHERE embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL AND label IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    parts AS (SELECT vec_id, label, unnest(v) AS x, unnest(range(len(v))) AS i, len(v) AS n FROM good),
    scores AS (
      SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, sum(a.x * b.x)::BIGINT AS score
      FROM parts a JOIN parts b ON a.i = b.i AND a.n = b.n AND a.vec_id != b.vec_id
      WHERE a.vec_id % 100 = 0 GROUP BY ALL),
    positives AS (
      SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
    SELECT p.anchor_id, positive_id,
      row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank,
      vec_id AS negative_id, positive_score, score AS negative_score
    FROM positives p JOIN scores s ON p.anchor_id = s.anchor_id AND NOT same
      AND 100 * score BETWEEN 30 * positive_score AND 90 * positive_score
    QUALIFY rank <= 10"""


def damaged(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with rows dropped, emptied, cut, repeated and given to the user by a hash."""
    plain = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    fate = F.crc32(F.concat(plain["conv_id"], F.lit(":"), plain["turn"]).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", plain["role"].alias("role"), plain["text"].alias("text"), fate.alias("_fate"))
    rows = rows.filter("_fate != 0").select(
        "conv_id", "turn", F.when(F.col("_fate") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("_fate") == 1, "").when(F.col("_fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.sequence(F.lit(1), F.when(F.col("_fate") == 3, 2).otherwise(1))).alias("_copy"))
    return rows.drop("_copy")


@query
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    repaired = repair.repair(damaged(turns))
    report, digests = (df.withColumnRenamed("conv_id", n) for df, n in ((repaired.report, "_r"), (repair.digests(repaired.rows), "_d")))
    every = turns.select("conv_id").distinct().join(report, F.col("conv_id").eqNullSafe(F.col("_r")), "left")
    every = every.join(digests, F.col("conv_id").eqNullSafe(F.col("_d")), "left")
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return every.select("conv_id", *[F.coalesce(n, F.lit(0)).cast("bigint").alias(n) for n in numbers],
                        F.coalesce("audit", F.lit("")).alias("audit"),
                        F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
