"""Toxicity by a classifier chain.

The categories are predicted one after another by linear models over the shares that the stems have in a
document. Each later
model also sees the probabilities of the categories before it. While it is trained, those probabilities come
from models that have not seen the document (out of fold), so that the chain learns from what it will be
given in use.

The models are fitted on a bounded sample of the labelled documents (``SAMPLE``), every document is scored.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel, Normalizer, RegexTokenizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import stored, text_of

#: Most labelled documents that the chain is fitted on: those of the least hash of their id.
SAMPLE = 10_000
FOLDS = 3
#: Width of the models: the most frequent tokens, of those that this share of the labelled documents has.
VOCABULARY, LEAST_SHARE = 1 << 13, 0.005
#: The fits go over a bounded sample, in so few partitions that a step of a fit is one stage.
PARTS = 4
#: Lengths of the beginnings that stand for the stem of a word.
STEMS = (3, 4, 5)
#: A document is toxic from this probability of the chain's last category on.
THRESHOLD = 0.5


@dataclass
class Chain:
    """Category names in order, with the words' index and a model for each."""

    categories: list[str]
    vectorizer: CountVectorizerModel | None = None
    models: list[LogisticRegressionModel | float] = field(default_factory=list)


def _tokens(docs: DataFrame) -> DataFrame:
    """The beginnings of words in lower case, which stand for their stems, and single signs."""
    words = RegexTokenizer(inputCol="text", outputCol="__words", pattern=r"\p{L}+|[^\p{L}\d\s]", gaps=False, toLowercase=True).transform(docs)
    parts = [F.filter("__words", lambda w: F.length(w) < min(STEMS))]
    for n in STEMS:
        longer = F.filter("__words", lambda w: F.length(w) >= n)  # noqa: B023
        parts.append(F.transform(longer, lambda w: F.concat(F.lit("^"), F.substring(w, 1, n))))  # noqa: B023
    return words.withColumn("tokens", F.concat(*parts)).drop("__words")


def _counted(rows: DataFrame, vectorizer: CountVectorizerModel) -> DataFrame:
    """Adds ``words``: the share of each known token among a document's, whatever its length."""
    return Normalizer(p=1.0, inputCol="__counts", outputCol="words").transform(vectorizer.transform(rows)).drop("__counts")


def _vocabulary(rows: DataFrame) -> CountVectorizerModel:
    """The ``VOCABULARY`` tokens that most of ``rows`` have, of those that ``LEAST_SHARE`` of them have."""
    held = rows.select(F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    known = held.where(F.col("n") >= LEAST_SHARE * rows.count()).orderBy(F.desc("n"), "token").limit(VOCABULARY)
    # A model needs one token at least; an empty one is never met.
    return CountVectorizerModel.from_vocabulary([r.token for r in known.collect()] or [""], "tokens", "__counts")


def _fit(rows: DataFrame, category: str) -> LogisticRegressionModel | float:
    """A model of ``category`` over ``features``; its only value where there is but one, 0 without rows."""
    values = [r[0] for r in rows.select(category).distinct().limit(2).collect()]
    if len(values) < 2:
        return float(values[0]) if values else 0.0
    # An L1 penalty: the few words that tell, out of very many.
    return LogisticRegression(featuresCol="features", labelCol=category, regParam=0.001, elasticNetParam=1.0, maxIter=40, tol=1e-5, aggregationDepth=2).fit(rows)


def _predicted(rows: DataFrame, model: LogisticRegressionModel | float, column: str) -> DataFrame:
    if isinstance(model, float):
        return rows.withColumn(column, F.lit(model))
    scored = model.setPredictionCol("__prediction").setRawPredictionCol("__raw").setProbabilityCol("__probability").transform(rows)
    return scored.withColumn(column, F.get(vector_to_array("__probability"), 1)).drop("__prediction", "__raw", "__probability")


def _with_features(rows: DataFrame, before: list[str]) -> DataFrame:
    if not before:
        return rows.withColumn("features", F.col("words"))
    return VectorAssembler(inputCols=["words", *before], outputCol="features").transform(rows)


def fit_chain(docs: DataFrame, labels: DataFrame, categories: list[str], id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, folds: int = FOLDS) -> Chain:
    """Fit a chain on the labelled documents.

    ``labels`` holds the id and a 0/1 column for each category; rows with a null among them are left out,
    as are labels without a document. A category of one value only is predicted as that value, and all as 0
    without any labels.
    """
    known = reduce(lambda df, c: df.where(F.col(c).isNotNull()), categories, labels.where(F.col(id_col).isNotNull()))
    chosen = known.select(F.col(id_col).alias("__id"), *[F.col(c).cast("double").alias(c) for c in categories])
    # At most ``sample`` rows of an id and some numbers, so they may be broadcast.
    chosen = chosen.orderBy(F.xxhash64("__id"), "__id", *categories).limit(sample)
    rows = docs.select(F.col(id_col).alias("__id"), text_of(text_col).alias("text")).join(F.broadcast(chosen), "__id")
    rows = stored(_tokens(rows).select("__id", "tokens", *categories), "labelled")
    chain = Chain(categories)
    if rows.isEmpty():
        chain.models = [0.0 for _ in categories]
        return chain
    chain.vectorizer = _vocabulary(rows)
    rows = stored(_counted(rows, chain.vectorizer).withColumn("fold", F.pmod(F.xxhash64("__id", F.lit("fold")), F.lit(folds))).select("words", "fold", *categories).coalesce(PARTS), "labelled-words")
    before: list[str] = []
    for category in categories:
        rows = _with_features(rows.drop("features"), before)
        chain.models.append(_fit(rows, category))
        if category == categories[-1]:
            break
        parts = [_predicted(rows.where(F.col("fold") == k), _fit(rows.where(F.col("fold") != k), category), f"p_{category}") for k in range(folds)]
        rows = stored(reduce(DataFrame.unionByName, parts).drop("features").coalesce(PARTS), "out-of-fold")
        before.append(f"p_{category}")
    return chain


def score(docs: DataFrame, chain: Chain, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with p_<category> for each category (double, 0 to 1) and ``is_toxic`` (boolean: the last
    category's probability reaches ``threshold``). Columns of these names are replaced.

    Null counts as empty. A text without known tokens is not toxic, whatever the models' constants say, as nothing
    tells. Rows are independent of each other; an empty table gives an empty result.
    """
    names = [f"p_{c}" for c in chain.categories]
    kept = [c for c in docs.columns if c not in (*names, "is_toxic")]
    rows = docs.select(F.struct(*kept).alias("__row"), text_of(text_col).alias("text"))
    known = F.lit(True)
    if chain.vectorizer is not None:
        rows = _counted(_tokens(rows), chain.vectorizer)
        # The most frequent tokens come first, so this ends early.
        known = F.exists(vector_to_array("words"), lambda share: share > 0)
    before: list[str] = []
    for category, model in zip(chain.categories, chain.models):
        if not isinstance(model, float):
            rows = _with_features(rows.drop("features"), before)
        rows = _predicted(rows, model, f"p_{category}")
        before.append(f"p_{category}")
    return rows.select("__row.*", *names, ((F.col(names[-1]) >= threshold) & known).alias("is_toxic"))


def document_chain(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Chain:
    """The chain for tables like documents and labels: low quality first, then toxicity."""
    categories = labels.select(F.col("doc_id").alias(id_col), (1 - F.col("quality")).alias("low_quality"), F.col("toxic"))
    return fit_chain(docs, categories, ["low_quality", "toxic"], id_col, text_col)
