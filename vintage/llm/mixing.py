"""Mixing sources to target weights (operator 4), in DataFrame functions only.

The words of each source, documents in doc_id order, are packed into blocks of
a fixed number of words (the last block of a source may be shorter). Sources
in code-point order, null last, weigh 5, 2, 1, repeating, and share the words
of all sources; a target stops at 3 times its source's size and what is above
is shared out again. A source's target gives its number of slots. Output
shards have equally many slots; each slot draws its source at random in
proportion to the slots of the sources, so a shard's counts are multinomial.
The few draws that a source gets beyond its slots go to the sources that fell
short. A source's slots are numbered over the shards; number t takes, in round
t div n, the block at the image of t mod n under that round's pseudorandom
permutation of its n blocks, and slots and blocks are joined by block number.
So no block is taken more often than 3 times, and reruns agree.

A word is a run of characters other than space and U+0009 to U+000D. Null and
empty texts have no words: they keep their row, with 0 taken. A null source is
a source. Documents of one source and doc_id (nulls first) follow a hash of
their text. An empty table gives an empty result. The table of sources is
held as constant arrays, so sources may be many thousands, not as many as
documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vintage.llm.common import cut, positions, staged, text_key
from vintage.llm.permute import PRIME, permute

SPACES = r"\x20\x09-\x0D"
WEIGHTS, LIMIT = (5, 2, 1), 3
#: Words in a block, blocks in an output shard.
BLOCK, SHARD = 64, 8192
#: Slots that a task lists, about.
TASK = 200_000
SEED = 4


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACES}]+")), F.lit(0)).cast("long")


def _div(a: Column, b: Column | int) -> Column:
    return F.call_function("div", a, F.lit(b).cast("long") if isinstance(b, int) else b)


def targets(sizes: DataFrame, block: int = BLOCK) -> DataFrame:
    """``sizes`` (source, size) -> one row per source: source, nr (from 0),
    source_size, target, blocks, slots, before (slots of earlier sources)."""
    own = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    own = own.withColumn("nr", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.col("nr") % len(WEIGHTS) + 1).cast("int"))
    own = own.withColumn("weight", weight).withColumn("ratio", LIMIT * F.col("source_size") / F.col("weight"))
    # sources reach their limit in the order of limit over weight: the share of a weight, were all earlier ones at their limit
    tight = W.orderBy("ratio", "nr")
    full = F.coalesce(F.sum(LIMIT * F.col("source_size")).over(tight.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(tight.rowsBetween(0, W.unboundedFollowing))
    everything = W.partitionBy()
    own = own.withColumn("share", (F.sum("source_size").over(everything) - full) / left)
    open_ = F.col("share") <= F.col("ratio")
    own = own.withColumn("share", F.min(F.when(open_, F.struct("ratio", "nr", "share"))).over(everything)["share"])
    own = own.withColumn("target", F.least(LIMIT * F.col("source_size").cast("double"), F.col("weight") * F.col("share")))
    blocks = F.ceil(F.col("source_size") / block).cast("long")
    slots = F.when(F.col("source_size") > 0, F.least(LIMIT * blocks, F.round(F.col("target") / F.col("source_size") * blocks)))
    own = own.withColumn("blocks", blocks).withColumn("slots", F.coalesce(slots, F.lit(0)).cast("long"))
    before = F.sum("slots").over(W.orderBy("nr").rowsBetween(W.unboundedPreceding, -1))
    return own.select("source", "nr", "source_size", "target", "blocks", "slots",
                      F.coalesce(before, F.lit(0)).alias("before"))


def _columns(table: DataFrame, *names: str) -> dict[str, Column]:
    """Columns of the table of sources as constant arrays in the order of nr."""
    rows = sorted(table.select("nr", *names).collect())
    return {n: F.lit([r[n] for r in rows]) if rows else F.array().cast("array<long>") for n in names}


def _interval(starts: Column, value: Column) -> Column:
    """Number of the last of the ascending ``starts`` that is not above
    ``value``: of empty intervals at one place, the one that follows them."""
    return F.size(F.filter(starts, lambda start: start <= value)) - 1


def slots(sources: DataFrame, shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """Layout of the mix: shard, slot, nr (source), round, block, one row per slot."""
    spark = sources.sparkSession
    total = sources.agg(F.sum("slots")).first()[0] or 0
    drawn = spark.range(total).select(_div(F.col("id"), shard).alias("shard"),
                                      F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(max(total, 1))).alias("v"))
    before = _columns(sources, "before")["before"]
    counts = cut(drawn.select("shard", _interval(before, F.col("v")).alias("nr"))
                 .groupBy("shard", "nr").agg(F.count(F.lit(1)).alias("n")))
    # draws beyond a source's slots fill the slots of those that fell short, in order
    got = counts.groupBy(F.col("nr").alias("_nr")).agg(F.sum("n").alias("got"))
    gap = sources.join(got, F.col("nr") == F.col("_nr"), "left").withColumn("got", F.coalesce("got", F.lit(0)))
    order = W.orderBy("nr").rowsBetween(W.unboundedPreceding, -1)
    over, short = F.greatest(F.col("got") - F.col("slots"), F.lit(0)), F.greatest(F.col("slots") - F.col("got"), F.lit(0))
    gap = gap.select("nr", "blocks", "slots", F.col("got").cast("long"),
                     F.coalesce(F.sum(over).over(order), F.lit(0)).alias("over"),
                     F.coalesce(F.sum(short).over(order), F.lit(0)).alias("short"))
    of = _columns(gap, "blocks", "slots", "got", "over", "short")
    at = lambda name, nr: F.get(of[name], F.col(nr).cast("int"))
    first = F.coalesce(F.sum("n").over(W.partitionBy("nr").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inside = F.coalesce(F.sum("n").over(W.partitionBy("shard").orderBy("nr").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # a row stands for up to a shard's slots: dealt out before they are listed
    tasks = max(spark.sparkContext.defaultParallelism, -(-total // TASK))
    rows = (counts.withColumn("first", first).withColumn("inside", inside).repartition(tasks, "shard", "nr")
            .withColumn("of_shard", F.least(F.lit(shard), F.lit(total) - F.col("shard") * shard).cast("long"))
            .select("shard", "nr", "first", "inside", "of_shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k")))
    rows = rows.withColumn("t", F.col("first") + F.col("k"))
    rows = rows.withColumn("spare", F.when(F.col("t") >= at("slots", "nr"), F.col("t") - at("slots", "nr") + at("over", "nr")))
    rows = rows.withColumn("to", F.when(F.col("spare").isNotNull(), _interval(of["short"], F.col("spare"))))
    rows = rows.withColumn("t", F.coalesce(F.col("spare") - at("short", "to") + at("got", "to"), F.col("t")))
    rows = rows.withColumn("nr", F.coalesce("to", "nr")).withColumn("n", at("blocks", "nr"))
    key = lambda *c: F.pmod(F.xxhash64(F.lit(seed), *c), F.lit(PRIME).cast("long"))
    round_ = _div(F.col("t"), F.col("n"))
    return rows.select(
        "shard", permute(F.col("inside") + F.col("k"), F.col("of_shard"), key(F.lit("shard"), F.col("shard"))).alias("slot"),
        "nr", round_.alias("round"), permute(F.col("t") % F.col("n"), F.col("n"), key(F.col("nr"), round_)).alias("block"))


def _placed(docs: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """Sources, and documents with the words before them in their source."""
    slim = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), text_key(F.col("text")).alias("_text"))
    rows = cut(positions(slim, ["source", "doc_id", "_text"], ["source"], "size"))
    sources = staged(targets(rows.select("source", "size"), block), "targets")
    named = sources.select(F.col("source").alias("_source"), "nr", "source_size", "target")
    return sources, rows.join(named, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def _blocks(block: int) -> Column:
    last = _div(F.col("_at") + F.col("size") - 1, block)
    return F.sequence(_div(F.col("_at"), block), last)


def _overlap(block: int) -> tuple[Column, Column]:
    """First word of a document (from 0) in ``block``, and how many are there."""
    low = F.greatest(F.col("block") * block - F.col("_at"), F.lit(0).cast("long"))
    high = F.least((F.col("block") + 1) * block - F.col("_at"), F.col("size"))
    return low, high - low


def mix(docs: DataFrame, block: int = BLOCK, shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """One row per document of ``docs`` (doc_id, source, text): doc_id, size,
    source_size, target, taken."""
    sources, rows = _placed(docs, block)
    uses = slots(sources, shard, seed).groupBy("nr", "block").agg(F.count(F.lit(1)).alias("uses"))
    own = ["doc_id", "size", "source_size", "target"]
    pieces = rows.where("size > 0").select(*own, "nr", "_at", F.explode(_blocks(block)).alias("block"))
    pieces = pieces.withColumn("words", _overlap(block)[1]).join(uses.hint("merge"), ["nr", "block"], "left")
    taken = pieces.groupBy("nr", "_at", *own).agg(
        F.sum(F.col("words") * F.coalesce("uses", F.lit(0))).cast("long").alias("taken"))
    none = rows.where("size = 0").select(*own, F.lit(0).cast("long").alias("taken"))
    return taken.select(*own, "taken").unionByName(none)


def _with_words(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` of _placed that have words, with lang and the array of words,
    each with the white space after it."""
    texts = (docs.select("doc_id", "lang", "source", "text", text_key(F.col("text")).alias("_text")).where("text is not null")
             .groupBy("doc_id", "source", "_text").agg(F.first(F.struct("text", "lang")).alias("d")))
    key = (rows["doc_id"].eqNullSafe(texts["doc_id"]) & rows["source"].eqNullSafe(texts["source"])
           & (rows["_text"] == texts["_text"]))
    more = [rows[c] for c in rows.columns if c not in ("_text", "source_size", "target")]
    return rows.where("size > 0").join(texts, key).select(
        *more, F.col("d.lang").alias("lang"),
        F.regexp_extract_all("d.text", F.lit(f"[^{SPACES}]+[{SPACES}]*"), F.lit(0)).alias("words"))


def _cut_out(low: Column, high: Column, block: int) -> Column:
    """The words of a document that lie in the blocks ``low`` to ``high``."""
    first = F.greatest(low * block - F.col("_at"), F.lit(0).cast("long"))
    n = F.least((high + 1) * block - F.col("_at"), F.col("size")) - first
    return F.array_join(F.slice("words", (first + 1).cast("int"), n.cast("int")), "")


def mixed_texts(docs: DataFrame, block: int = BLOCK, shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """The mix itself: for every slot the words of its block, one row for each
    document that the block takes them from: shard, slot, doc_id, text (those
    words with the white space after them), lang, source, n_chars."""
    sources, rows = _placed(docs, block)
    layout = slots(sources, shard, seed)
    piece = F.transform(_blocks(block), lambda b: F.struct(b.alias("block"), _cut_out(b, b, block).alias("text")))
    pieces = _with_words(docs, rows).select("doc_id", "lang", "source", "nr", F.explode(piece).alias("p"))
    pieces = pieces.select("doc_id", "lang", "source", "nr", "p.block", "p.text")
    return pieces.join(layout.hint("merge"), ["nr", "block"]).select(
        "shard", "slot", "doc_id", "text", "lang", "source", F.char_length("text").cast("long").alias("n_chars"))


def joined_texts(docs: DataFrame, block: int = BLOCK, shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """The words of the mix by document: one row for each document, round and
    run of adjoining blocks that the round drew: doc_id, text (the words of the
    run in their order, with the white space after them), lang, source,
    n_chars. A document breaks only where a block was not drawn."""
    sources, rows = _placed(docs, block)
    # number and place name a document that has words: the runs are found without its text
    drawn = rows.where("size > 0").select("nr", "_at", F.explode(_blocks(block)).alias("block"))
    drawn = drawn.join(slots(sources, shard, seed).select("nr", "round", "block").hint("merge"), ["nr", "block"])
    number = F.row_number().over(W.partitionBy("nr", "_at", "round").orderBy("block"))
    runs = (drawn.withColumn("run", F.col("block") - number).groupBy("nr", "_at", "round", "run")
            .agg(F.min("block").alias("low"), F.max("block").alias("high"))
            .groupBy("nr", "_at").agg(F.collect_list(F.struct("low", "high")).alias("runs")))
    texts = F.transform("runs", lambda r: _cut_out(r["low"], r["high"], block))
    full = _with_words(docs, rows.join(runs, ["nr", "_at"]))
    return full.select("doc_id", F.explode(texts).alias("text"), "lang", "source").withColumn(
        "n_chars", F.char_length("text").cast("long"))
