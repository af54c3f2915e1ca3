"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vintage.llm import bbit_minhash, conversation_repair, decontaminate, fingerprint, langid, mixing, ngram_join, sharding, token_alignment, token_counts, token_output, toxicity, warc
from vintage.llm.common import scratch, table


def tokenizer_file(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from labels that aren't held out."""
    return toxicity.held_out_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records and read back."""
    out = scratch(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages"), out, least=100)
    return warc.read_archive(spark, out).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
with p as (
  select page_id, coalesce(html, '') as body from pages
), d as (
  select page_id, octet_length(encode(body)) as payload_bytes, sha256(encode(body)) as payload_digest from p
), f as (
  select *, min(page_id) over (partition by payload_digest) as first_id from d
)
select page_id, payload_bytes, payload_digest,
       case when payload_bytes >= 100 and first_id is not null and page_id is distinct from first_id
            then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 100 and page_id is distinct from first_id then first_id end as refers_to
from f"""


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents that hold an item of the benchmark, copied or paraphrased."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("_text")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to the sources' targets."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents and of all pages: kind, doc_id (of a
    document), page_id (of a page), lang, posterior, text_lang, kept."""
    from pyspark.sql import functions as F
    docs = table(spark, sf_dir, "documents")
    model = langid.document_model(docs)
    none = F.lit(None).cast("long")
    rows = langid.document_evidence(docs).drop("_text").withColumn("kind", F.lit("document")).withColumn("page_id", none)
    pages = langid.page_evidence(table(spark, sf_dir, "pages")).withColumn("kind", F.lit("page")).withColumn("doc_id", none)
    own = ["kind", "doc_id", "page_id"]
    return langid.identify(rows, model, own).unionByName(langid.identify(pages, model, own))


def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Homomorphic fingerprints of all documents and their edited texts."""
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy word-piece lengths of all documents."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their class of near duplicates and their links."""
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents shuffled into 40 shards; the law is `rows`."""
    from pyspark.sql import functions as F
    return (sharding.assign_shards(table(spark, sf_dir, "documents"), 40)
            .withColumn("law", F.lit("rows")).withColumn("grown_shard", F.lit(None).cast("int")))


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token-id shards, read back through their index."""
    path, out = tokenizer_file("byte_bpe_50k.json"), scratch(spark, "ids")
    token_output.write_token_files(table(spark, sf_dir, "documents"), out, path, end_id=2)
    return token_output.read_token_files(spark, out, token_output.id_width(path)).select(
        "doc_id", "start", "n_tokens", "ids_crc32")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged by rule and repaired at least cost."""
    return conversation_repair.audit_conversations(table(spark, sf_dir, "conversations"))


def op12_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their component of near duplicates."""
    return bbit_minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, their tokens of two tokenizers aligned."""
    return token_alignment.align(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_warc, op3_decontamination, op4_mixing, op5_language_id, op6_fingerprint, op7_token_counts, op8_ngram_join, op9_sharding, op10_token_output, op11_conversation_repair, op12_bbit_minhash, op13_token_alignment)}
ORACLES: dict[str, str] = {"op2_warc": OP2_SQL}
