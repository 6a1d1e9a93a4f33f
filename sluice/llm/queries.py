"""The queries of this subpackage, by name, and SQL for those that SQL can express; of others, parts that it can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import op9_bpe
from .embeddings import OP8_SQL, op8_embeddings
from .fingerprint import op4_fingerprint
from .language import op10_langid
from .licences import op5_licenses
from .minhash import op1_minhash
from .mixing import op3_mixing
from .quality import op6_quality
from .secret_scan import op7_secrets
from .warc import OP2_SQL, op2_warc



def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op4: what its edited texts are."""
    return op4_fingerprint(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def licence_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op5: words, and places of the fixed phrases."""
    return op5_licenses(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op7: matches of the fixed patterns."""
    return op7_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def mixed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op3: rows and blocks of each source, and the slots of the whole mix."""
    found = op3_mixing(spark, sf_dir)
    whole = found.agg(F.countDistinct("slot").alias("n"), (F.max("slot") + 1).alias("end")).first()
    each = found.groupBy("source").agg(F.count("*").alias("n_rows"), F.countDistinct("block").alias("n_blocks"), F.countDistinct("slot").alias("n_own_slots"))
    return each.select("*", F.lit(whole.n).cast("long").alias("n_slots"), F.lit(whole.end).cast("long").alias("end_slot"))


def round_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op9: what ids decode to."""
    return op9_bpe(spark, sf_dir).select("doc_id", "decoded_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash": op1_minhash,
    "op2_warc": op2_warc,
    "op3_mixing": op3_mixing,
    "op4_fingerprint": op4_fingerprint,
    "op5_licenses": op5_licenses,
    "op6_quality": op6_quality,
    "op7_secrets": op7_secrets,
    "op8_embeddings": op8_embeddings,
    "op9_bpe": op9_bpe,
    "op10_langid": op10_langid,
    "edited_texts": edited_texts,
    "licence_phrases": licence_phrases,
    "secret_counts": secret_counts,
    "mixed_sources": mixed_sources,
    "round_trips": round_trips,
}

ORACLE_SQL: dict[str, str] = {
    "op2_warc": OP2_SQL,
    "op8_embeddings": OP8_SQL,
    "edited_texts": """
with d as (select doc_id, coalesce(text, '') as t from documents),
n as (select doc_id, t, length(t) // 2 as half, coalesce(lead(t) over (order by doc_id desc), first_value(t) over (order by doc_id desc)) as after from d)
select doc_id, length(t) as n_chars, sha256(substr(t, 1, length(t) - half) || substr(after, 1, half)) as edited_sha256 from n""",
    "licence_phrases": r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
p as (select doc_id, len(w) as n_words,
  list_filter(range(len(w) - 1), lambda i: w[i + 1] = 'mit' and w[i + 2] = 'license') as mit,
  list_filter(range(len(w) - 1), lambda i: w[i + 1] = 'apache' and w[i + 2] = 'license') as apache,
  list_filter(range(len(w) - 2), lambda i: w[i + 1] = 'general' and w[i + 2] = 'public' and w[i + 3] = 'license') as gpl from d)
select doc_id, n_words, len(mit) + len(apache) + len(gpl) as n_base, least(list_min(mit), list_min(apache), list_min(gpl)) as first_word,
  greatest(list_max(mit), list_max(apache), list_max(gpl)) as last_word,
  concat_ws(',', case when len(apache) > 0 then 'apache' end, case when len(gpl) > 0 then 'gpl' end, case when len(mit) > 0 then 'mit' end) as base_labels
from p""",
    "secret_counts": r"""
select doc_id,
  len(list_filter(regexp_extract_all(coalesce(text, ''), '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 8)) as n_assign,
  len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 16)) as n_access,
  len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda x: length(x) >= 32)) as n_hex
from documents""",
    "mixed_sources": """
with s as (select source, count(*) as n_rows, (count(*) + 63) // 64 as n_blocks from documents group by source)
select source, n_rows, n_blocks, n_blocks as n_own_slots, cast(sum(n_blocks) over () as bigint) as n_slots, cast(sum(n_blocks) over () as bigint) as end_slot from s""",
    "round_trips": "select doc_id, sha256(coalesce(text, '')) as decoded_sha256 from documents",
}
