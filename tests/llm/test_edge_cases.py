"""Nulls, empty and long texts, repeated rows, empty tables and clashing
column names, for every operator and every stage."""

import pytest

import corpus_pipeline
from vintage.llm import decontaminate, fingerprint, langid, mixing, ngram_join, queries, sharding, token_counts, token_output, toxicity, warc
from vintage.llm.common import scratch, ship

FIELDS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "long text here " * 30_000
ROWS = [(1, "the same text twice over and over again", "en", "a", 1), (1, "the same text twice over and over again", "en", "a", 1),
        (2, None, "en", "a", None), (3, "", None, None, 0), (None, "a text without any id at all, here", "en", None, 5),
        (None, None, None, None, None), (4, LONG, "en", "b", 9), (5, "the same text twice over and over again", "fr", "b", 1),
        (6, "\n\n \t", "de", "c", 4), (7, "a b c", "en", "c", 5)]
#: Names that the operators use themselves.
CLASHES = ["_text", "_at", "_id", "_key", "_p", "key", "size", "slot", "shard", "nr", "block", "bucket", "ids", "ll", "p", "t", "id",
           "value", "row", "score", "target", "taken", "item", "position", "root", "copies", "payload", "digest"]


def table(spark, kind, fields, rows):
    ship(spark)
    names = [f.split()[0] for f in fields.split(", ")]
    df = spark.createDataFrame([] if kind == "empty" else rows, fields)
    if kind == "clashes":
        from pyspark.sql import functions as F
        df = df.select("*", *[F.lit("x").alias(c) for c in CLASHES if c not in names])
    return df


def ids_of(spark, docs):
    out = scratch(spark, "ids")
    token_output.write_token_files(docs, out, queries.tokenizer_file("byte_bpe_50k.json"))
    return token_output.read_token_files(spark, out, 2)


def bench(spark, rows=((1, "the same text twice over and over again"), (2, None), (3, ""), (1, "the same text twice over and over again"))):
    return spark.createDataFrame(list(rows), "item_id long, text string")


def labels(spark):
    return spark.createDataFrame([(1, 1), (2, 0), (4, None), (None, 1), (1, 0)], "doc_id long, toxic int")


PER_ROW = {
    "toxicity": lambda s, d: toxicity.held_out_scores(d, labels(s)),
    "mixing": lambda s, d: mixing.mix(d, block=4, shard=16),
    "language": lambda s, d: langid.identify(langid.document_evidence(d), langid.document_model(d), ["doc_id"]),
    "fingerprints": lambda s, d: fingerprint.fingerprints(d),
    "token counts": lambda s, d: token_counts.count_tokens(d, queries.tokenizer_file("piece_bpe_32k.model")),
    "near duplicates": lambda s, d: ngram_join.near_duplicates(d),
    "sharding": lambda s, d: sharding.assign_shards(d, 3),
    "token output": ids_of,
}


@pytest.mark.parametrize("kind", ["rows", "empty", "clashes"])
@pytest.mark.parametrize("name", PER_ROW)
def test_one_row_for_each_document(spark, name, kind):
    rows = PER_ROW[name](spark, table(spark, kind, FIELDS, ROWS)).collect()
    key = lambda x: (x is None, x or 0)
    assert sorted((r.doc_id for r in rows), key=key) == ([] if kind == "empty" else sorted((r[0] for r in ROWS), key=key))


@pytest.mark.parametrize("kind", ["rows", "empty", "clashes"])
def test_contaminated(spark, kind):
    docs = table(spark, kind, FIELDS, ROWS)
    got = decontaminate.contaminated(docs, bench(spark)).collect()
    assert {r.doc_id for r in got} == (set() if kind == "empty" else {1, 5}) and {r.item_id for r in got} <= {1}
    assert decontaminate.contaminated(docs, bench(spark, []).limit(0)).count() == 0
    kept = decontaminate.without_leaks(docs, bench(spark))
    assert kept.columns == docs.columns and kept.count() == (0 if kind == "empty" else 7)


@pytest.mark.parametrize("kind", ["rows", "empty", "clashes"])
def test_one_of_each(spark, kind):
    docs = table(spark, kind, FIELDS, ROWS)
    got = ngram_join.one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in got.collect()) == ([] if kind == "empty" else [-1, 1, 2, 4, 6, 7])


@pytest.mark.parametrize("kind", ["rows", "empty", "clashes"])
def test_known_languages(spark, kind):
    docs = table(spark, kind, FIELDS, ROWS)
    got = langid.in_known_languages(docs)
    assert got.columns == docs.columns
    left = [r.doc_id for r in got.collect()]
    assert (left == []) if kind == "empty" else (1 in left and 2 not in left and 3 not in left and 6 not in left)


@pytest.mark.parametrize("kind", ["rows", "empty", "clashes"])
def test_archives(spark, kind):
    rows = [(1, "u", None), (2, None, ""), (None, None, "x" * 150), (3, "v", "x" * 150), (3, "v", "x" * 150), (4, "w", LONG)]
    out = scratch(spark, "warc")
    warc.write_archive(table(spark, kind, "page_id long, url string, html string", rows), out)
    got = warc.read_archive(spark, out).collect()
    assert len(got) == (0 if kind == "empty" else 6)
    assert [r.refers_to for r in got if r.record_type == "revisit"] == ([] if kind == "empty" else [3])


@pytest.mark.parametrize("kind", ["rows", "empty", "clashes"])
def test_stages(spark, kind, tmp_path):
    bench(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = table(spark, kind, FIELDS, ROWS)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == corpus_pipeline.COLUMNS
    assert docs.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert (docs.count() > 0) == (kind != "empty")
