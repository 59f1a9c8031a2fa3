"""Learned page types: TF-IDF and structure into a random forest."""

from __future__ import annotations

from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import (
    IDF,
    CountVectorizer,
    RegexTokenizer,
    StandardScaler,
    StopWordsRemover,
    StringIndexer,
    VectorAssembler,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.functions.html import raw_text
from pagewright.functions.scoring import PAGE_TYPES, page_features, page_type_scores, top_type
from pagewright.session import cut_lineage

# Size of the vocabulary and of the forest.
VOCABULARY = 1000
TREES = 100
SEED = 42


def _inputs(df: DataFrame) -> DataFrame:
    return df.withColumn("_words", F.concat_ws(" ", "url", raw_text("html"))).withColumn(
        "_structure", array_to_vector(page_features("html", "url"))
    )


def train_page_classifier(
    df: DataFrame, label: str, trees: int = TREES, vocabulary: int = VOCABULARY
) -> PipelineModel:
    """Fit on ``url``, ``html`` and a label column of page types."""
    features = [
        StringIndexer(inputCol=label, outputCol="_label", stringOrderType="alphabetAsc"),
        RegexTokenizer(inputCol="_words", outputCol="_tokens", pattern=r"\W+", minTokenLength=2),
        StopWordsRemover(inputCol="_tokens", outputCol="_kept"),
        CountVectorizer(inputCol="_kept", outputCol="_counts", vocabSize=vocabulary),
        IDF(inputCol="_counts", outputCol="_tfidf"),
        VectorAssembler(inputCols=["_tfidf", "_structure"], outputCol="_all"),
        StandardScaler(inputCol="_all", outputCol="_features"),
    ]
    forest = RandomForestClassifier(
        featuresCol="_features", labelCol="_label", numTrees=trees, seed=SEED, cacheNodeIds=True
    )
    # Every stage reads its input again, and the forest once per level of its
    # trees, so labels, words and features are computed once and stored.
    fitted, data = [], cut_lineage(_inputs(df).select(label, "_words", "_structure"))
    for stage in features:
        model = stage.fit(data) if isinstance(stage, Estimator) else stage
        fitted.append(model)
        data = model.transform(data)
        if stage.getOutputCol() == "_counts":
            data = cut_lineage(data.select("_label", "_structure", "_counts"))
    ready = cut_lineage(data.select("_label", "_features"))
    return PipelineModel([*fitted, forest.fit(ready)])


def predict_page_type(model: PipelineModel | None, df: DataFrame) -> DataFrame:
    """Add class probabilities and the best class; heuristics sans model."""
    if model is None:
        return df.withColumn("page_type_scores", page_type_scores("html", "url")).withColumn(
            "page_type", top_type("page_type_scores")
        )
    labels = model.stages[0].labels
    scorer = PipelineModel(model.stages[1:])
    probability = vector_to_array("probability")
    found = F.map_from_arrays(F.array(*[F.lit(x) for x in labels]), probability)
    total = F.aggregate(probability, F.lit(0.0), lambda acc, x: acc + x)
    filled = F.map_from_arrays(
        F.array(*[F.lit(t) for t in PAGE_TYPES]),
        F.array(*[F.coalesce(F.try_element_at(found, F.lit(t)), F.lit(0.0)) / total for t in PAGE_TYPES]),
    )
    return (
        scorer.transform(_inputs(df))
        .select(*df.columns, filled.alias("page_type_scores"))
        .withColumn("page_type", top_type("page_type_scores"))
    )
