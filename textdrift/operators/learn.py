"""Learning and evaluation (L1-L13) on Spark ML.

- TF-IDF (L1): word 1-2-grams, sublinear tf ``1 + ln tf``, smoothed idf ``ln((1+N)/(1+df)) + 1``,
  L2 norm, vocabulary = top ``max_features`` terms by corpus frequency among terms with
  document frequency >= ``min_df`` (ties by term). Terms are counted, weighted and normalised in the
  Arrow batch that reads the texts; the vocabulary is bounded by ``max_features`` and is broadcast.
- Classifiers: ``LogisticRegression`` with ``regParam = 1/(C n)`` (same objective as C-penalised
  sum-of-losses LR), ``RandomForestClassifier``; PCA, silhouette from ``pyspark.ml``.
- Evaluation metrics are SQL over a prediction table (stage, label, prediction), so they are
  exact and checkable independently of any model.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.stat import Correlation, Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from textdrift.constants import NO_RETURN_THRESHOLD, STAGES
from textdrift.functions import text as tx
from textdrift.functions import words as wd
from textdrift.session import stored

TFIDF_TOKEN_RE = r"[\p{L}\p{N}_]{2,}"
TASK_TERMS = 200_000        # terms that a task holds at once


def tfidf_terms(text) -> F.Column:
    """Lower-cased tokens of >= 2 word characters, then their adjacent pairs."""
    tok = tx.tokens(F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text,
                                       F.lit(""))), TFIDF_TOKEN_RE)
    return F.concat(tok, tx.bigrams(tok))


def _texts_by_id(docs: DataFrame, id_col: str, text_col: str, one_row_each: bool = False) -> DataFrame:
    """Each id once, with the texts of its rows. ``one_row_each`` says that no id repeats: no text is shuffled."""
    if one_row_each:
        return docs.withColumn("_texts", F.array(F.coalesce(F.col(text_col), F.lit(""))))
    return docs.groupBy(id_col).agg(F.collect_list(F.coalesce(F.col(text_col), F.lit(""))).alias("_texts"))


def _term_stats(docs: DataFrame, id_col: str, text_col: str, one_row_each: bool = False) -> DataFrame:
    """(term, df, cf): documents that hold a term, and its occurrences. A document's terms are counted
    where its texts are read; only a task's sums become rows."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, cf = Counter(), Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(cf.keys(), pa.string()), pa.array([df[t] for t in cf], pa.int64()),
                                               pa.array(cf.values(), pa.int64())], names=["term", "df", "cf"])
        for batch in batches:
            alone, place = wd.runs(batch.column(0).to_pylist())
            for texts, times in zip(alone, np.bincount(place).tolist()):       # T0 of a document's chains once
                found = wd.term_counts(texts)
                if times == 1:
                    cf.update(found)
                    df.update(found.keys())
                else:
                    for t, n in found.items():
                        cf[t] += n * times
                        df[t] += times
                if len(cf) >= TASK_TERMS:
                    yield rows()
                    df, cf = Counter(), Counter()
        yield rows()

    texts = _texts_by_id(docs, id_col, text_col, one_row_each).select("_texts")
    found = texts.mapInArrow(task, "term string, df long, cf long")
    return found.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def fit_vocabulary(docs: DataFrame, id_col: str, text_col: str = "text",
                   max_features: int | None = 5000, min_df: int = 1, one_row_each: bool = False,
                   n_docs: int | None = None) -> DataFrame:
    """L1 (fit): vocabulary table (term, idx, df, cf, idf) over the fitting documents; ``n_docs`` is their number where
    it is known."""
    if n_docs is None:
        n_docs = docs.select(id_col).distinct().count()
    stats = _term_stats(docs, id_col, text_col, one_row_each).where(F.col("df") >= min_df)
    if max_features is not None:
        stats = stats.orderBy(F.desc("cf"), "term").limit(max_features)
    idf = F.log((1.0 + n_docs) / (1.0 + F.col("df"))) + 1.0
    w = Window.orderBy("term")
    return stats.select("term", (F.row_number().over(w) - 1).alias("idx"), "df", "cf",
                        idf.alias("idf"))


def tfidf_weights(docs: DataFrame, vocab: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """L1: (id, idx, term, weight) of every vocabulary term of every document, L2-normalised.

    Terms are counted and weighted in the Arrow batch that reads a document's texts: only the texts are shuffled, by
    id. With more than ``TASK_TERMS`` terms in the vocabulary, terms are rows that Spark joins and counts.
    """
    if vocab.count() <= TASK_TERMS:
        w = _unit_weights(F.col("_texts"), vocab)
        x = _texts_by_id(docs.where(F.col(id_col).isNotNull()), id_col, text_col).select(id_col, w.alias("_w"))
        x = x.select(id_col, F.inline(F.arrays_zip("_w.indices", "_w.values")).alias("idx", "weight"))
        return x.join(F.broadcast(vocab.select("idx", "term")), "idx").select(id_col, "idx", "term", "weight")
    tf = docs.select(id_col, F.explode(tfidf_terms(text_col)).alias("term")).groupBy(id_col, "term").agg(
        F.count(F.lit(1)).alias("tf"))
    w = tf.join(vocab.select("term", "idx", "idf"), "term").select(
        id_col, "idx", "term", ((1.0 + F.log("tf")) * F.col("idf")).alias("w"))
    norms = w.groupBy(id_col).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norms, id_col).select(id_col, "idx", "term", (F.col("w") / F.col("norm")).alias("weight"))


def _vector(size: int, nonzero: F.Column) -> F.Column:
    """A sparse vector in the physical form of ``VectorUDT``: type 0, size, indices, values."""
    return F.struct(F.lit(0).cast("byte").alias("type"), F.lit(size).cast("int").alias("size"),
                    F.transform(nonzero, lambda x: x["idx"].cast("int")).alias("indices"),
                    F.transform(nonzero, lambda x: x["w"]).alias("values"))


def _packed_by_join(docs: DataFrame, vocab: DataFrame, size: int, id_col: str, text_col: str, out_col: str) -> DataFrame:
    """(id, vector) by a shuffled join of terms with a vocabulary of any size."""
    v = vocab.select("term", "idx", "idf")
    terms = docs.select(id_col, F.explode_outer(tfidf_terms(text_col)).alias("term"))
    tf = terms.join(v, "term", "left").groupBy(id_col, "idx", "idf").agg(F.count(F.lit(1)).alias("tf"))
    weight = F.when(F.col("idx").isNotNull(), (1.0 + F.log("tf")) * F.col("idf"))
    per_doc = tf.select(id_col, "idx", weight.alias("w")).groupBy(id_col).agg(
        F.array_sort(F.collect_list(F.when(F.col("w").isNotNull(), F.struct("idx", "w")))).alias("nz"),
        F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    unit = F.transform("nz", lambda x: F.struct(x["idx"].alias("idx"), (x["w"] / F.col("norm")).alias("w")))
    return per_doc.select(id_col, _vector(size, unit).alias(out_col))


_term_words: dict[str, wd.TermWeights] = {}        # by call: a worker keeps the words of the last one


def _unit_weights(texts: Column, vocab: DataFrame, vectors: bool = False) -> Column:
    """struct(indices, values), or with ``vectors`` an ML vector: the L2-normalised weights of the vocabulary terms of
    ``texts``, by index. The vocabulary goes to every task; a document's terms are counted where its texts are read,
    once for equal texts of consecutive rows."""
    known = {r["term"]: (r["idx"], r["idf"]) for r in vocab.select("term", "idx", "idf").collect()}
    size, call = len(known), uuid.uuid4().hex

    def each(texts: pa.Array) -> pa.Array:
        if call not in _term_words:
            _term_words.clear()
            _term_words[call] = wd.TermWeights(known)
        alone, place = wd.runs(texts.to_pylist())
        parts, base = [], 0
        for part in wd.slices(alone, lambda d: sum(map(len, d))):
            of, index, w = _term_words[call].of(part)
            parts.append((of + base, index, w))
            base += len(part)
        of, index, w = (np.concatenate(x) for x in zip(*parts))
        ends = pa.array(np.append(0, np.cumsum(np.bincount(of, minlength=base))).astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, x) for x in (pa.array(index.astype(np.int32)), pa.array(w.astype(float)))]
        names = ["indices", "values"]
        if vectors:
            n = len(alone)
            lists, names = [pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, size, np.int32)), *lists], ["type", "size", *names]
        return pa.StructArray.from_arrays(lists, names).take(pa.array(place))
    each.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(each, VectorUDT() if vectors else "indices array<int>, values array<double>")(texts)


def transform_tfidf(docs: DataFrame, vocab: DataFrame, id_col: str, text_col: str = "text",
                    out_col: str = "features", one_row_each: bool = False, keep: bool = True) -> DataFrame:
    """L1 (transform): one sparse L2-normalised TF-IDF vector per document.

    Vectors are built in Arrow batches (from a shuffled join of terms if the vocabulary has more than
    ``TASK_TERMS`` rows) and stored once in their physical form; reading them with a vector schema
    makes them ML vectors, and training, which scans its input many times, reads them instead of
    computing them again. A document's non-zeros are bounded by the vocabulary. With ``one_row_each`` (no
    id repeats, as in chains of R1) the rows are stored with their vectors, without the text: nothing is
    shuffled or joined; without ``keep`` they are not stored either, for a reader that reads them once.
    """
    size = vocab.count()
    if one_row_each and size <= TASK_TERMS:
        own = docs.drop(text_col)
        if not keep:
            x = _texts_by_id(docs, id_col, text_col, True)
            return x.select(*own.columns, _unit_weights(F.col("_texts"), vocab, vectors=True).alias(out_col))
        x = _texts_by_id(docs, id_col, text_col, True).select(*own.columns, _unit_weights(F.col("_texts"), vocab).alias("_w"))
        x = x.select(*own.columns, F.struct(F.lit(0).cast("byte").alias("type"), F.lit(size).cast("int").alias("size"),
                                            "_w.indices", "_w.values").alias(out_col))
        return stored(x, "tfidf", StructType([*own.schema.fields, StructField(out_col, VectorUDT())]))
    if size > TASK_TERMS:
        packed = _packed_by_join(docs, vocab, size, id_col, text_col, out_col)
    else:
        w = _unit_weights(F.col("_texts"), vocab)
        x = _texts_by_id(docs, id_col, text_col).select(id_col, w.alias("_w"))
        packed = x.select(id_col, F.struct(F.lit(0).cast("byte").alias("type"), F.lit(size).cast("int").alias("size"),
                                           "_w.indices", "_w.values").alias(out_col))
    schema = StructType([packed.schema[id_col], StructField(out_col, VectorUDT())])
    return docs.join(stored(packed, "tfidf", schema), id_col)


def train_logistic(train: DataFrame, C: float = 1.0, max_iter: int = 1000,
                   features: str = "features", label: str = "label"):
    """LR with the objective of ``C``-penalised sum-of-losses logistic regression."""
    n = train.count()
    lr = LogisticRegression(featuresCol=features, labelCol=label, maxIter=max_iter,
                            regParam=1.0 / (C * max(n, 1)), elasticNetParam=0.0,
                            standardization=False, fitIntercept=True, tol=1e-6)
    return lr.fit(train)


def binary_label(source_col: str = "source"):
    return F.when(F.col(source_col) == "Human", 1.0).otherwise(0.0)


def holdout_split(chains: DataFrame, by=("dataset", "key"), percent: int = 25, seed: int = 42) -> DataFrame:
    """Chains with ``split`` (train or test), decided by a hash of the ``by`` columns alone: all chains
    of a document, whatever its source and rewriter, are on one side, so that a classifier is not
    tested on texts it has seen. Needs no shuffle; NULL keys are a document of their own."""
    name = F.concat(F.lit(f"{seed}|"), F.to_json(F.struct(*by), {"ignoreNullFields": "false"}))
    bucket = F.pmod(F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long"), F.lit(100))
    return chains.withColumn("split", F.when(bucket < percent, "test").otherwise("train"))


def train_attribution(chains: DataFrame, seed: int = 42, max_features: int = 5000,
                      min_df: int = 2, balanced: bool = True, holdout_by=None, one_row_each: bool = False,
                      fit_chains: DataFrame | None = None):
    """L2: balance Human/AI chains, fit TF-IDF + LR on the T0 texts.

    Returns (model, vocabulary, rows). The rows keep the chain keys. With ``holdout_by`` (columns, such
    as dataset and key) only the documents of the training side of ``holdout_split`` are balanced
    and fitted, and the returned rows are all those of the test side. ``one_row_each`` says that no chain
    repeats, as in chains of R1: the balanced chains are then told by a condition on their keys, only T0 of them is
    stored, and the returned rows are not. ``fit_chains`` are the same chains with the texts of T0 alone
    (``chains_with``), which are cheaper to read.
    """
    from textdrift.operators.reshape import CHAIN_KEYS, balance_classes, head_condition

    doc_id = F.to_json(F.struct(*CHAIN_KEYS), {"ignoreNullFields": "false"})     # distinct also for NULL keys
    rows = chains.withColumn("label", binary_label())
    fit = rows if fit_chains is None else fit_chains.withColumn("label", binary_label())
    held = None
    if holdout_by is not None:
        held = holdout_split(rows, holdout_by, seed=seed).where("split = 'test'")
        fit = holdout_split(fit, holdout_by, seed=seed).where("split = 'train'").select(*CHAIN_KEYS, "label", "T0")
    if one_row_each:
        if balanced:
            keys = stored(fit.select(*CHAIN_KEYS, "label"), "attribution-keys")
            head = head_condition(keys, "label", CHAIN_KEYS, lambda total, mn: mn, seed=seed)
            fit, rows = fit.where(head), rows.where(head)
        fit = stored(fit.where(F.col("T0").isNotNull()).select(*CHAIN_KEYS, "label", "T0").withColumn("doc_id", doc_id),
                     "attribution-rows")
        rows = rows.withColumn("doc_id", doc_id)
    else:
        if balanced:
            fit = balance_classes(fit, "label", CHAIN_KEYS, seed=seed)
        fit = rows = stored(fit.withColumn("doc_id", doc_id), "attribution-rows")
    train = fit.where(F.col("T0").isNotNull())
    vocab = stored(fit_vocabulary(train, "doc_id", "T0", max_features, min_df, one_row_each), "vocabulary")
    x = transform_tfidf(train.select("doc_id", "T0", "label"), vocab, "doc_id", "T0", one_row_each=one_row_each)
    model = train_logistic(x)
    return model, vocab, rows if held is None else held.withColumn("doc_id", doc_id)


def predict_stages(model, vocab: DataFrame, rows: DataFrame, stages=STAGES, one_row_each: bool = False) -> DataFrame:
    """Predictions for every stage text of the rows (missing text scored as ""), with ``present``."""
    from textdrift.operators.reshape import CHAIN_KEYS
    long = rows.select("doc_id", *CHAIN_KEYS, "family", "label",
                       F.inline(F.array(*[F.struct(F.lit(s).alias("stage"),
                                                   F.col(s).alias("text")) for s in stages])))
    long = long.withColumn("row_id", F.concat_ws("#", "doc_id", "stage")) \
        .withColumn("present", F.col("text").isNotNull())
    x = transform_tfidf(long, vocab, "row_id", "text", one_row_each=one_row_each, keep=False)
    pred = model.transform(x)
    return pred.select("row_id", *CHAIN_KEYS, "family", "stage", "present",
                       F.when(F.col("label") == 1.0, "Human").otherwise("AI").alias("label"),
                       F.when(F.col("prediction") == 1.0, "Human").otherwise("AI")
                       .alias("prediction"))


# ---------------------------------------------------------------------------------------------
# Metrics over a prediction table
# ---------------------------------------------------------------------------------------------

def _safe_div(a, b):
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def binary_metrics(pred: DataFrame, by=("stage",), pos: str = "Human", neg: str = "AI") -> DataFrame:
    """L3/L4: accuracy, macro and weighted F1, precision and recall of both classes by ``by``. The
    macro mean is over the classes that occur as label or prediction.

    Zero division gives 0 (like the reference's zero_division=0). Rows with ``present`` false
    are left out when that column exists.
    """
    p = pred.where(F.col("present")) if "present" in pred.columns else pred
    conf = p.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if((F.col("label") == pos) & (F.col("prediction") == pos)).alias("tp"),
        F.count_if((F.col("label") == neg) & (F.col("prediction") == pos)).alias("fp"),
        F.count_if((F.col("label") == pos) & (F.col("prediction") == neg)).alias("fn"),
        F.count_if((F.col("label") == neg) & (F.col("prediction") == neg)).alias("tn"))
    tp, fp, fn, tn, n = (F.col(c) for c in ("tp", "fp", "fn", "tn", "n"))
    hp, hr = _safe_div(tp, tp + fp), _safe_div(tp, tp + fn)
    ap, ar = _safe_div(tn, tn + fn), _safe_div(tn, tn + fp)
    hf = _safe_div(2 * hp * hr, hp + hr)
    af = _safe_div(2 * ap * ar, ap + ar)
    return conf.select(
        *by, "n", _safe_div(tp + tn, n).alias("accuracy"), 
        _safe_div(hf + af, (tp + fn + fp > 0).cast("int") + (tn + fp + fn > 0).cast("int")).alias("f1_macro"),
        _safe_div(hf * (tp + fn) + af * (tn + fp), n).alias("f1_weighted"),
        hp.alias("human_precision"), hr.alias("human_recall"),
        ap.alias("ai_precision"), ar.alias("ai_recall"))


def metrics_by_family(pred: DataFrame, min_n: int = 10) -> DataFrame:
    """L4: L3 per family x stage, skipping family ``none`` and families with fewer than ``min_n``
    chains (a chain has one prediction row per stage, present or not)."""
    large = (pred.groupBy("family", "stage").agg(F.count(F.lit(1)).alias("_rows")).groupBy("family")
             .agg(F.max("_rows").alias("_chains")).where(F.col("_chains") >= min_n).select("family"))
    m = binary_metrics(pred.where(F.col("family") != "none"), by=("family", "stage"))
    return m.join(large, "family", "left_semi")


def error_direction_by_stage(pred: DataFrame) -> DataFrame:
    """Human->AI and AI->Human counts and rates per stage; denominators count every row
    (missing texts included, scored as empty text)."""
    g = pred.groupBy("stage").agg(
        F.count_if((F.col("label") == "Human") & (F.col("prediction") == "AI"))
        .alias("human_misclassified_as_ai"),
        F.count_if(F.col("label") == "Human").alias("n_human"),
        F.count_if((F.col("label") == "AI") & (F.col("prediction") == "Human"))
        .alias("ai_misclassified_as_human"),
        F.count_if(F.col("label") == "AI").alias("n_ai"))
    return g.select("stage", "human_misclassified_as_ai",
                    _safe_div(F.col("human_misclassified_as_ai"), F.col("n_human"))
                    .alias("human_misclass_rate"),
                    "ai_misclassified_as_human",
                    _safe_div(F.col("ai_misclassified_as_human"), F.col("n_ai"))
                    .alias("ai_misclass_rate"))


def error_by_domain(pred: DataFrame, stage: str = "T3") -> DataFrame:
    """N, accuracy and error rate by dataset at one stage, highest error first."""
    g = pred.where(F.col("stage") == stage).groupBy("dataset").agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("accuracy"))
    return g.withColumn("error_rate", 1 - F.col("accuracy")).orderBy(F.desc("error_rate"))


def error_by_family(pred: DataFrame, stage: str = "T3") -> DataFrame:
    """Accuracy and n by family at one stage, skipping ``none``."""
    return pred.where((F.col("stage") == stage) & (F.col("family") != "none")) \
        .groupBy("family").agg(
            F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("accuracy"),
            F.count(F.lit(1)).alias("n"))


def point_of_no_return(results: DataFrame, threshold: float = NO_RETURN_THRESHOLD) -> DataFrame:
    """First stage after T0 whose accuracy is <= threshold (NULL when none)."""
    hit = results.where((F.col("stage") != "T0") & (F.col("accuracy") <= threshold))
    return hit.agg(F.min("stage").alias("point_of_no_return"))


def _cells(pred: DataFrame) -> DataFrame:
    """(label, prediction, n), counted once: at most classes x classes rows."""
    return stored(pred.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n")), "confusion")


def multiclass_metrics(pred: DataFrame) -> DataFrame:
    """Per class precision, recall, F1, support, plus accuracy and macro F1 on every row."""
    cells = _cells(pred)
    classes = cells.select(F.col("label").alias("cls")).union(
        cells.select(F.col("prediction").alias("cls"))).distinct()
    lab = cells.groupBy(F.col("label").alias("cls")).agg(
        F.sum("n").alias("support"),
        F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)).alias("tp"))
    prd = cells.groupBy(F.col("prediction").alias("cls")).agg(F.sum("n").alias("predicted"))
    j = classes.join(lab, "cls", "left").join(prd, "cls", "left").fillna(0, ["support", "tp",
                                                                              "predicted"])
    prec = _safe_div(F.col("tp"), F.col("predicted"))
    rec = _safe_div(F.col("tp"), F.col("support"))
    f1 = _safe_div(2 * prec * rec, prec + rec)
    per = j.select("cls", prec.alias("precision"), rec.alias("recall"), f1.alias("f1"),
                   F.col("support").cast("long").alias("support"), "tp")
    w = Window.partitionBy()
    return per.select("cls", "precision", "recall", "f1", "support",
                      (F.sum("tp").over(w) / F.sum("support").over(w)).alias("accuracy"),
                      F.avg("f1").over(w).alias("f1_macro"))


def confusion_matrix(pred: DataFrame) -> DataFrame:
    """(label, prediction, n) for every label x class cell, zeros included.

    The class list is the distinct labels and predictions (bounded by the number of classes);
    the cells are generated per label, not by a cross join.
    """
    cnt = _cells(pred)
    classes = sorted(r[0] for r in cnt.select(F.col("label").alias("c")).union(
        cnt.select(F.col("prediction").alias("c"))).distinct().collect())
    labels = cnt.select("label").distinct()
    cells = labels.select("label", F.explode(F.array(*[F.lit(c) for c in classes]))
                          .alias("prediction"))
    return cells.join(cnt, ["label", "prediction"], "left").fillna(0, ["n"])


# ---------------------------------------------------------------------------------------------
# Fingerprint, importance, PCA, silhouette
# ---------------------------------------------------------------------------------------------

def class_names(df: DataFrame, col: str) -> list[str]:
    """The classes that occur in ``col``, sorted (their number is bounded by what is to be told apart)."""
    return sorted(r[0] for r in df.select(col).where(F.col(col).isNotNull()).distinct().collect())


def fingerprint_features(texts: DataFrame, style: DataFrame, id_col: str, text_col: str,
                         vocab: DataFrame, style_cols, one_row_each: bool = False) -> DataFrame:
    """Style columns (22) followed by TF-IDF (sparse) in one vector column ``features``. Texts without a row of
    ``style`` are left out."""
    x = transform_tfidf(texts, vocab, id_col, text_col, "tfidf", one_row_each).join(style, id_col)
    asm = VectorAssembler(inputCols=list(style_cols) + ["tfidf"], outputCol="features")
    return asm.transform(x)


def train_fingerprint(train: DataFrame, num_trees: int = 200, max_depth: int = 20,
                      seed: int = 42, label: str = "label_idx"):
    """Random forest over the fingerprint vectors (gini, sqrt features per split)."""
    rf = RandomForestClassifier(featuresCol="features", labelCol=label, numTrees=num_trees,
                                maxDepth=max_depth, featureSubsetStrategy="sqrt",
                                impurity="gini", seed=seed)
    return rf.fit(train)


def feature_importance(model, names, top_n: int = 20, spark=None) -> DataFrame:
    """Top-n (feature, importance), largest first (the limit is the feature)."""
    imp = model.featureImportances.toArray().tolist()
    rows = list(zip(list(names), [float(v) for v in imp]))
    df = spark.createDataFrame(rows, "feature string, importance double")
    return df.orderBy(F.desc("importance"), "feature").limit(top_n)


def _projected(features: str, axes: np.ndarray) -> Column:
    """The product of each vector with ``axes`` (dimensions x k), as an array."""
    def each(vectors: pa.Array) -> pa.Array:
        out = []
        for v in vectors.to_pylist():
            if v is None:
                out.append(None)
            elif v["indices"] is None:                                  # a dense vector
                out.append(np.asarray(v["values"]) @ axes)
            else:
                out.append(np.asarray(v["values"]) @ axes[v["indices"]])
        return pa.array(out, pa.list_(pa.float64()))
    each.__annotations__ = {"vectors": pa.Array, "return": pa.Array}
    return F.arrow_udf(each, "array<double>")(F.unwrap_udt(features))


def pca_explained(vectors: DataFrame, k: int = 50, features: str = "features"):
    """PCA to k dimensions; returns (projected rows, total explained variance).

    The covariances are Spark's (correlations, in one pass over the rows, and standard deviations), so what
    the driver decomposes is bounded by the dimensions, never by the rows. It takes the symmetric eigenvalues
    of that matrix; the general decomposition of Spark ML's PCA takes minutes for a few thousand dimensions.
    """
    used = vectors.where(F.col(features).isNotNull())
    std = used.select(Summarizer.std(F.col(features))).first()[0].toArray()
    cov = np.nan_to_num(Correlation.corr(used, features).first()[0].toArray()) * np.outer(std, std)
    value, axes = np.linalg.eigh(cov)                                   # ascending
    value, axes = np.maximum(value[::-1], 0.0), np.ascontiguousarray(axes[:, ::-1][:, :k])
    total = value.sum()
    return (vectors.withColumn("pca", array_to_vector(_projected(features, axes))),
            float(value[:k].sum() / total) if total else 0.0)


def silhouette_by_stage(vectors: DataFrame, features: str = "pca", label: str = "stage") -> float:
    """Mean silhouette with the stage as cluster label (squared Euclidean, one pass)."""
    idx = vectors.withColumn("_cluster", (F.substring(label, 2, 1).cast("int")).cast("double"))
    ev = ClusteringEvaluator(featuresCol=features, predictionCol="_cluster",
                             metricName="silhouette", distanceMeasure="squaredEuclidean")
    return float(ev.evaluate(idx))
