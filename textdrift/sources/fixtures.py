"""Fixture views built from the driver tables (FIXTURES.md, part B).

The reference's corpus is not in the tree, so the registered queries run on version tables that
Spark derives from the driver's ``documents`` and ``conversations`` tables. Every fixture keeps
whole texts and all rows; the modulo expressions only assign labels (dataset, source, rewriter)
and create the documented edge cases (an empty T3 rewriter, a missing T2 every 17th document).
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------------------------
# Fixed values of the fixtures
# ---------------------------------------------------------------------------------------------

# F1 rewriters and their keep-rate modulus m: at stage n, word i survives when (i+1) % m >= n
F1_REWRITERS = [("pegasus(slight)", 10), ("pegasus(full)", 6), ("dipper(low)", 5),
                ("dipper(high)", 3), ("palm", 7), ("chatgpt", 4)]
F1_DATASETS = ["sci_gen", "wp", "xsum", "eli5", "cmv", "tldr", "yelp"]  # by doc_id % 7
F1_MISSING_T2_EVERY = 17

# F2 rewriter by conv_id % 7
F2_REWRITERS = ["pegasus(full)", "pegasus(slight)", "dipper(high)", "palm", "dipper",
                "dipper(low)", "chatgpt"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _case_by_mod(col, n: int, labels) -> F.Column:
    expr = None
    for i, lab in enumerate(labels):
        expr = F.when(col % n == i, lab) if expr is None else expr.when(col % n == i, lab)
    return expr


def spread(df: DataFrame, *cols, parts: int | None = None) -> DataFrame:
    """Hash-partition ``df`` by ``cols`` into ``parts`` (default: ``spark.sql.shuffle.partitions``).

    The driver tables are single-row-group files, i.e. one scan task; spreading by the document
    keys right after the scan both parallelises the per-version work and leaves the version
    table partitioned the way the chain aggregate (R1) needs, so R1 plans no exchange of its own.
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *cols)


def kept_words(text: str, m: int, n: int) -> Column:
    """The words between single spaces of ``text`` whose place from 1, modulo ``m``, is ``n`` or more (1 <= n <= m).

    With a space put before each word, a run of m words loses its first n - 1 and its last: one fixed regex
    for the whole text, where a lambda would be interpreted for every word. A last, shorter run loses its
    first ones alone, as its places never come to m.
    """
    word = " [^ ]*+"
    lost = "".join(f"(?:{word})?+" if i else word for i in range(n - 1))
    kept = f"((?:{word}){{{0 if lost else 1},{m - n}}}+)"
    shorter = F.regexp_replace(F.concat(F.lit(" "), F.col(text)), f"{lost}{kept}(?:{word})?+", "$1")
    return F.substring(shorter, 2, 1 << 30)


def kept_words_in_batches(text: str, m: Column, n: Column) -> Column:
    """``kept_words`` for columns ``m`` and ``n`` (n = 0: the text as it is), in Arrow batches: slices of the list of
    words are dropped. A text that consecutive rows share is split once."""
    def each(texts: pa.Array, every: pa.Array, least: pa.Array) -> pa.Array:
        out, last, words = [], None, []
        for t, m, n in zip(texts.to_pylist(), every.to_pylist(), least.to_pylist()):
            if t is None or n == 0:
                out.append(t)
                continue
            if t != last:
                last, words = t, t.split(" ")
            kept = words[:]
            del kept[m - 1::m]
            for i in range(min(n, m) - 1):                  # the first word that is left of every run
                del kept[::m - 1 - i]
            out.append(" ".join(kept))
        return pa.array(out, pa.string())
    each.__annotations__ = {"texts": pa.Array, "every": pa.Array, "least": pa.Array, "return": pa.Array}
    return F.arrow_udf(each, "string")(F.col(text), m, n)


def versions(spark: SparkSession, sf_dir: str, in_batches: bool = False, parts: int | None = None) -> DataFrame:
    """one original per document plus 6 rewriters x 3 stages that drop more words each stage.

    Columns: dataset, source, key, text, version_name, seq. ``in_batches`` drops words in Arrow batches: faster, but
    Spark then does not know that the rows are partitioned by document, so it is for readers that don't group texts. ``parts`` is the number of its partitions.
    """
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    d = docs.select(
        _case_by_mod(F.col("doc_id"), 7, F1_DATASETS).alias("dataset"),
        F.when(F.col("doc_id") % 3 == 0, "Human").otherwise("OpenAI").alias("source"),
        "doc_id", "text",
    ).withColumn("key", F.concat("dataset", F.lit("-"), F.col("doc_id").cast("string")))
    d = spread(d, "dataset", "key", "source", parts=parts)

    # one generated row per version (the original is step n = 0): a Generate, no join, no union
    steps = [("original", 1, 0), *[(p, m, n) for p, m in F1_REWRITERS for n in (1, 2, 3)]]
    rows = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(p).alias("p"), F.lit(m).alias("m"), F.lit(n).alias("n"))
                     for i, (p, m, n) in enumerate(steps)])
    rw = (d.select("dataset", "source", "key", "doc_id", "text", F.explode(rows).alias("r"))
          .where(~((F.col("doc_id") % F1_MISSING_T2_EVERY == 0) & (F.col("r.n") == 2))))
    p, n = F.col("r.p"), F.col("r.n")
    version_name = (F.when(n == 0, p)
                    .when(n == 1, p)
                    .when(n == 2, F.concat(p, F.lit("_"), p))
                    .otherwise(F.concat(p, F.lit("_"), p, F.lit("_"), p)))
    if in_batches:
        text = kept_words_in_batches("text", F.col("r.m"), n)
    else:
        text = F.when(n == 0, F.col("text"))
        for i, (_, m, k) in enumerate(steps):
            if k:
                text = text.when(F.col("r.i") == i, kept_words("text", m, k))
    return rw.select("dataset", "source", "key",
                     text.alias("text"), version_name.alias("version_name"), n.cast("long").alias("seq"))


def turn_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversation turns as versions; the k-th turn of a role is T0, T1, T2, later ones T3."""
    conv = read_table(spark, sf_dir, "conversations")
    k = F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("turn"))
    p = _case_by_mod(F.col("conv_id"), 7, F2_REWRITERS)
    r = conv.select("conv_id", "role", "turn", "text", k.alias("k"), p.alias("p"))
    version_name = (F.when(F.col("k") == 1, "original")
                    .when(F.col("k") == 2, F.col("p"))
                    .when(F.col("k") == 3, F.concat("p", F.lit("_"), "p"))
                    .otherwise(F.concat("p", F.lit("_"), "p", F.lit("_"), "p")))
    return r.select(
        F.lit("conv").alias("dataset"), F.col("role").alias("source"),
        F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("key"),
        "text", version_name.alias("version_name"), F.col("turn").cast("long").alias("seq"))


def embedding_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedding pairs: vector 2k is the reference, 2k+1 the rewrite of pair k.

    Stage is T1..T3 by k % 3 and dataset by k % 7. Columns: pair_id, dataset, stage,
    ref_vec, hyp_vec (either may be NULL when a partner is missing).
    """
    emb = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    pair = F.floor(F.col("vec_id") / 2).cast("long")
    tagged = emb.select(pair.alias("pair_id"), (F.col("vec_id") % 2).alias("side"), "embedding")
    paired = tagged.groupBy("pair_id").agg(
        F.max(F.when(F.col("side") == 0, F.col("embedding"))).alias("ref_vec"),
        F.max(F.when(F.col("side") == 1, F.col("embedding"))).alias("hyp_vec"))
    return paired.select(
        "pair_id",
        _case_by_mod(F.col("pair_id"), 7, F1_DATASETS).alias("dataset"),
        F.concat(F.lit("T"), (F.col("pair_id") % 3 + 1).cast("string")).alias("stage"),
        "ref_vec", "hyp_vec")


def token_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token-embedding table: 16 consecutive vectors are the tokens of one text, so that the number
    of texts grows with the table. Columns: text_id, pos, vec."""
    emb = read_table(spark, sf_dir, "embeddings")
    return emb.select(F.floor(F.col("vec_id") / 16).cast("long").alias("text_id"),
                      F.col("vec_id").alias("pos"), F.col("embedding").alias("vec"))


def token_vector_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of token-vector texts: text l is the reference of text l+1 (stage by l % 3)."""
    ids = token_vectors(spark, sf_dir).select("text_id").distinct()
    pairs = ids.select(
        F.col("text_id").alias("ref_id"), (F.col("text_id") + 1).alias("hyp_id"),
        F.concat(F.lit("T"), (F.col("text_id") % 3 + 1).cast("string")).alias("stage"))
    return pairs.join(ids.withColumnRenamed("text_id", "hyp_id"), "hyp_id", "left_semi")


# F4 prediction table: the label flips when the first md5 hex digit of (row, stage) is below
# the stage's digit, so the error rate grows with the stage
F4_FLIP_BELOW = {"T0": "1", "T1": "4", "T2": "6", "T3": "8"}
F4_FAMILY_FLIP_BELOW = "6"


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the binary ``quality`` label (1 -> "Human", 0 -> "AI") for attribution."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return docs.join(labels, "doc_id")


# F5 gazetteer: the first one, two and three words of every benchmark item, class by item_id % 3
F5_CLASSES = ["PLACE", "ORG", "PERSON"]
F5_WORDS = (1, 2, 3)


def gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(phrase, label): phrases that lie within one another, some of several classes."""
    items = read_table(spark, sf_dir, "benchmark").select(
        F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), 0).alias("t"),
        _case_by_mod(F.col("item_id"), 3, F5_CLASSES).alias("label"))
    lengths = F.array(*[F.lit(n) for n in F5_WORDS])
    return items.select("t", "label", F.explode(lengths).alias("n")).where("n <= size(t)").select(
        F.array_join(F.slice("t", F.lit(1), F.col("n")), " ").alias("phrase"), "label")
