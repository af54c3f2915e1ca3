"""Language identification (operator 5) by Bayesian fusion of evidence.

For each row the log likelihoods of its text under the languages, and under
"und" (no known language), are added to the evidence of the declared markup
language, of the address suffix and of the host. The text model is a naive
Bayes over hashed words, word beginnings and word ends, counted on at most
BOUND labelled texts of a language (chosen by a hash of their id); one text
weighs no more than CERTAIN words. How far a declaration or a suffix goes with
a language, and how a host's pages divide over the languages, is counted over
all rows by grouped aggregation, each row weighing by its text's own
posterior. A host's shares are drawn towards those of its domain, and these
towards those of all rows.

A row is kept if a known language is likelier than "und" and likelier than
SURE. Null and empty texts have no text evidence: "und", not kept. Missing
declarations, suffixes and hosts give no evidence. An empty table gives an
empty result; equal rows get equal results."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vintage.llm.common import cut, free, staged, text_key, words
from vintage.llm.token_output import portions

BUCKETS = 1 << 16
#: Labelled texts of a language that are counted at most (in expectation).
BOUND = 1_500
#: Words that a worker remembers, about.
REMEMBERED = 150_000
#: Words that one text weighs at most.
CERTAIN = 40
#: Rows that a domain lends its host, or all rows a domain.
DRAW = 20.0
SMOOTH = 0.5
SURE = 0.5
UNKNOWN = "und"
#: Per word, what a text must have over chance to be in a known language.
MARGIN = 0.3


def _grams(word: str) -> tuple[str, str, str]:
    return " " + word, "<" + word[:3], word[-3:] + ">"


def _bucket(gram: str) -> int:
    return xxhash.xxh3_64_intdigest(gram.encode("utf-8", "surrogatepass"), 5) % BUCKETS


class TextModel:
    """Naive Bayes over hashed words, beginnings and ends."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        total = counts.sum(1, keepdims=True)
        self.table = np.log((counts + SMOOTH) / (total + SMOOTH * BUCKETS)).T if langs else np.zeros((BUCKETS, 0))
        self.forget()

    def forget(self) -> None:
        """Word numbers, and by number the mean log likelihood of the word's
        grams in each language and, last, under chance."""
        self.seen: dict[str, int] = {}
        self.rows = np.zeros((0, len(self.langs) + 1))

    def learn(self, new: list[str]) -> None:
        grams = np.array([_bucket(g) for w in new for g in _grams(w)], np.int64).reshape(-1, 3)
        own = np.full((len(new), len(self.langs) + 1), -np.log(BUCKETS) + MARGIN)
        own[:, :-1] = self.table[grams].mean(1)
        self.seen.update(zip(new, range(len(self.seen), len(self.seen) + len(new)), strict=True))
        self.rows = np.concatenate([self.rows, own])

    def likelihoods(self, texts: list[str]) -> list[list[float] | None]:
        """For each text, by language and under chance; null without words."""
        split = [[w for w in words(t) if not w.isdigit()] for t in texts]
        if len(self.seen) > REMEMBERED:
            self.forget()
        if new := set().union(*split).difference(self.seen):
            self.learn(list(new))
        number, out = self.seen.__getitem__, []
        for own in split:
            if not own:
                out.append(None)
                continue
            total = self.rows[np.fromiter(map(number, own), np.int64, len(own))].sum(0)
            total *= min(1.0, CERTAIN / len(own))
            out.append((total - total.max()).tolist())
        return out


def fit(texts: DataFrame, bound: int = BOUND) -> TextModel:
    """Count on labelled rows of ``texts`` (id, text, lang)."""
    known = texts.where("lang is not null and text is not null")
    n = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(n)
    share = F.lit(0.0)
    for lang in langs:
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, bound / n[lang]))).otherwise(share)
    draw = F.pmod(F.xxhash64(F.lit(5), "id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(langs), BUCKETS), np.int64)
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                np.add.at(total[langs.index(lang)], [_bucket(g) for w in words(text.as_py()) for g in _grams(w)], 1)
        for k in range(len(langs)):
            hit = np.flatnonzero(total[k])
            if len(hit):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hit), k)), pa.array(hit), pa.array(total[k, hit])],
                                                 ["lang", "bucket", "n"])

    rows = (known.where(draw < share).select("lang", "text").mapInArrow(count, "lang long, bucket long, n long")
            .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas())
    counts = np.zeros((len(langs), BUCKETS))
    counts[rows["lang"], rows["bucket"]] = rows["n"]
    return TextModel(langs, counts)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))


def domain_of(host: Column) -> Column:
    """The last two labels of a host name."""
    return F.when(host.contains("."), F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)).otherwise(host)


def suffix_of(host: Column) -> Column:
    return F.when(host.contains("."), F.substring_index(host, ".", -1))


def declared_in(html: Column) -> Column:
    """The language that the markup's root element declares."""
    found = F.lower(F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", 1))
    return F.when(found != "", found)


def text_of(html: Column) -> Column:
    """Markup without scripts, styles, comments, tags and entities."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    return F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), r"&#?\w+;", " ")


def likelihoods(rows: DataFrame, model: TextModel, keep: list[str]) -> DataFrame:
    """``keep`` columns of ``rows`` and the text's log likelihoods (null without words)."""
    shared = rows.sparkSession.sparkContext.broadcast((model.langs, model.table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = TextModel([], np.zeros((0, BUCKETS)))
        own.langs, own.table = shared.value
        own.forget()
        for batch in batches:
            out = [ll for texts in portions(batch.column("_body")) for ll in own.likelihoods(texts)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(out, pa.list_(pa.float64()))],
                                             [*keep, "ll"])

    schema = ", ".join(f"`{c}` {t}" for c, t in rows.select(*keep).dtypes) + ", ll array<double>"
    return rows.select(*keep, F.col("text").alias("_body")).mapInArrow(run, schema)


def _softmax(ll: Column) -> Column:
    e = F.transform(ll, lambda x: F.exp(x - F.array_max(ll)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def _weights(rows: DataFrame, by: str) -> DataFrame:
    """Rows of each value of ``by`` over the languages: by, nr, n. Weights are
    summed in millionths, so the order of the rows doesn't matter."""
    return (rows.where(F.col(by).isNotNull()).select(by, F.posexplode("p").alias("nr", "w"))
            .groupBy(by, "nr").agg((F.sum(F.round(F.col("w") * 1_000_000).cast("long")) / 1e6).alias("n")))


def _listed(table: DataFrame, by: str, name: str) -> DataFrame:
    return staged(table.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("nr", "v"))), lambda s: s["v"]).alias(name)), name)


def identify(rows: DataFrame, model: TextModel, keep: list[str]) -> DataFrame:
    """``rows``: ``keep`` columns, text, declared, suffix, host, domain ->
    ``keep`` columns, lang, posterior, text_lang (of the text alone), kept."""
    names = [*model.langs, UNKNOWN]
    own = [*keep, "declared", "suffix", "host", "domain"]
    rows = cut(likelihoods(rows, model, own))
    rows = rows.withColumn("p", F.when(F.col("ll").isNotNull(), _softmax(F.col("ll"))))
    seen = rows.where("p is not null")
    # P(declaration | language) and P(suffix | language)
    for by in ("declared", "suffix"):
        n = _weights(seen, by)
        kinds = n.select(F.countDistinct(by)).scalar()
        total = n.groupBy("nr").agg(F.sum("n").alias("all"))
        share = n.join(total, "nr").withColumn("v", F.log((F.col("n") + SMOOTH) / (F.col("all") + SMOOTH * kinds)))
        rows = rows.join(_listed(share, by, f"{by}_ll"), by, "left")
    # P(language | host), drawn towards the domain and towards all rows
    everything = _weights(seen.withColumn("_all", F.lit(1)), "_all").select("nr", "n")
    total = everything.agg(F.sum("n")).scalar()
    base = everything.select("nr", ((F.col("n") + SMOOTH) / (total + SMOOTH * len(names))).alias("base"))
    domain = _weights(seen, "domain").join(base, "nr")
    size = domain.groupBy("domain").agg(F.sum("n").alias("all"))
    domain = domain.join(size, "domain").select("domain", "nr", ((F.col("n") + DRAW * F.col("base")) / (F.col("all") + DRAW)).alias("d"))
    host = _weights(seen, "host").join(seen.where("host is not null").groupBy("host").agg(F.min("domain").alias("domain")), "host")
    size = host.groupBy("host").agg(F.sum("n").alias("all"))
    host = host.join(base, "nr").join(domain, ["domain", "nr"], "left").join(size, "host")
    host = host.withColumn("v", F.log((F.col("n") + DRAW * F.coalesce("d", "base")) / (F.col("all") + DRAW)))
    rows = rows.join(_listed(host, "host", "host_ll"), "host", "left")
    none = F.array(*[F.lit(0.0) for _ in names])
    add = lambda a, b: F.zip_with(a, F.coalesce(b, none), lambda x, y: x + y)
    rows = rows.withColumn("post", F.when(F.col("ll").isNotNull(), _softmax(
        add(add(add(F.col("ll"), F.col("declared_ll")), F.col("suffix_ll")), F.col("host_ll")))))
    listed = F.array(*[F.lit(x) for x in names])
    best = lambda a: F.element_at(listed, F.array_position(a, F.array_max(a)).cast("int"))
    lang = F.coalesce(best(F.col("post")), F.lit(UNKNOWN))
    posterior = F.coalesce(F.array_max("post"), F.lit(1.0))
    return rows.select(*keep, lang.alias("lang"), posterior.alias("posterior"),
                       F.coalesce(best(F.col("p")), F.lit(UNKNOWN)).alias("text_lang"),
                       ((lang != UNKNOWN) & (posterior >= SURE)).alias("kept"))


def document_evidence(docs: DataFrame) -> DataFrame:
    """Documents (doc_id, text, lang, source): the declared language is lang,
    the host is the source; they have no address."""
    none = F.lit(None).cast("string")
    return docs.select("doc_id", text_key(F.col("text")).alias("_text"), "text", F.lower("lang").alias("declared"),
                       none.alias("suffix"), F.col("source").alias("host"), none.alias("domain"))


def page_evidence(pages: DataFrame) -> DataFrame:
    """Pages (page_id, url, html)."""
    host = F.when(host_of(F.col("url")) != "", host_of(F.col("url")))
    return pages.select("page_id", text_of(F.col("html")).alias("text"), declared_in(F.col("html")).alias("declared"),
                        suffix_of(host).alias("suffix"), host.alias("host"), domain_of(host).alias("domain"))


def document_model(docs: DataFrame, bound: int = BOUND) -> TextModel:
    return fit(docs.select(F.col("doc_id").alias("id"), "text", F.lower("lang").alias("lang")), bound)


def in_known_languages(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept."""
    decided = identify(document_evidence(docs), document_model(docs), ["doc_id", "_text"])
    key, own_id, own_key = free(docs, "t", "id", "key")
    out = staged(decided.where("not kept").select(F.col("doc_id").alias(own_id), F.col("_text").alias(own_key)).distinct(), "rejected")
    rows = docs.withColumn(key, text_key(F.col("text")))
    return rows.join(out, (rows[key] == out[own_key]) & rows["doc_id"].eqNullSafe(out[own_id]), "left_anti").drop(key)
