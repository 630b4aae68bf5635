"""The registered queries of the operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    chat,
    htmltext,
    langid,
    linequality,
    mixing,
    neardup,
    packing,
    phrases,
    pii,
    quality,
    search,
    tokencount,
    whitening,
)
from .common import table

#: A public tokenizer file; the library that counts as its reference is installed beside it.
TOKENIZER = "word_bpe_49k.json"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


@query("op10_quality")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return quality.assess(table(spark, folder, "documents"))


@query("op7_language")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return langid.identify(table(spark, folder, "documents"))


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op6_token_counts")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, folder, "documents"), tokenizer_path())


@query("op9_packing")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    packed = packing.pack(table(spark, folder, "documents"), tokenizer_path())
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").cast("long").alias("ids_crc32"),
        "doc_tokens", "sequence_id", "offset", "loss_tokens")


@query("op4_html_text")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return htmltext.extract(table(spark, folder, "pages"), keep=("url",))


@query("op5_personal_data")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.detect(table(spark, folder, "documents"))

    def of_kind(spans: str, kind: str):
        return F.filter(spans, lambda x: x["kind"] == kind)

    def joined(spans: str):
        # The operator gives spans by kind and start.
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(
            ":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    return found.select(
        "doc_id", *(F.size(of_kind("base", k)).cast("long").alias(f"n_{k}") for k in pii.KINDS),
        F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"),
        joined("spans").alias("spans"))


@query("op1_near_duplicates")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.classes(table(spark, folder, "documents"))


@query("op3_mixture")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.plan(table(spark, folder, "documents"))


@query("op2_chats")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return chat.format_chats(table(spark, folder, "conversations"))


@query("op8_search")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return search.search(docs, docs.where(F.col("doc_id") % 100 == 0))


@query("op11_line_quality")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return linequality.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op12_whitening")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings"))


@query("op13_collocations", """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, doc_id, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
cut AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM cut),
one AS (SELECT lang, w[i] AS p, count(*) AS f FROM places GROUP BY ALL),
two AS (SELECT lang, w[i] AS p, w[i+1] AS q, count(*) AS f FROM places WHERE i < len(w) GROUP BY ALL),
three AS (SELECT lang, w[i] AS p, w[i+1] AS q, w[i+2] AS s, count(*) AS f FROM places
  WHERE i + 1 < len(w) GROUP BY ALL HAVING count(*) >= 10),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM one GROUP BY lang),
held AS (SELECT lang, p, q, max(f) AS f FROM (
  SELECT lang, p, q, f FROM three UNION ALL SELECT lang, q, s, f FROM three) GROUP BY ALL),
scored AS (
  SELECT t.lang, t.p || ' ' || t.q AS phrase, t.f AS a, x.f AS l, y.f AS r, 1 AS k,
    (1000000::HUGEINT * t.f * t.f) // (x.f::HUGEINT * y.f) AS score
  FROM two t JOIN one x ON x.lang = t.lang AND x.p = t.p JOIN one y ON y.lang = t.lang AND y.p = t.q
    LEFT JOIN held h ON h.lang = t.lang AND h.p = t.p AND h.q = t.q
  WHERE t.f >= 10 AND (h.f IS NULL OR 100 * h.f < 50 * t.f)
  UNION ALL
  SELECT t.lang, t.p || ' ' || t.q || ' ' || t.s, t.f, x.f, y.f, 1,
    (1000000::HUGEINT * t.f * t.f) // (x.f::HUGEINT * y.f)
  FROM three t JOIN one x ON x.lang = t.lang AND x.p = t.p
    JOIN two y ON y.lang = t.lang AND y.p = t.q AND y.q = t.s
  UNION ALL
  SELECT t.lang, t.p || ' ' || t.q || ' ' || t.s, t.f, x.f, y.f, 2,
    (1000000::HUGEINT * t.f * t.f) // (x.f::HUGEINT * y.f)
  FROM three t JOIN two x ON x.lang = t.lang AND x.p = t.p AND x.q = t.q
    JOIN one y ON y.lang = t.lang AND y.p = t.s),
weakest AS (SELECT * FROM scored
  QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM weakest)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score
FROM ranked JOIN total USING (lang) WHERE rank <= 2000""")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.mine(table(spark, folder, "documents"))
