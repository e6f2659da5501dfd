"""Ranking, diverse selection and clustering over given vectors."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseledger import rules
from caseledger.functions.vectors import cosine, dot, unit
from caseledger.operators.ordering import top_per_group
from caseledger.operators.skew import join_back
from caseledger.storage import reliable


def centroids(vectors: DataFrame, group: str, vector: str) -> DataFrame:
    """Mean vector per group, summed up on the map side."""
    dense = array_to_vector(F.col(vector).cast("array<double>"))
    means = vectors.groupBy(group).agg(Summarizer.mean(dense).alias("_mean"))
    return means.select(group, vector_to_array("_mean").alias("centroid"))


def score_candidates(
    candidates: DataFrame, documents: DataFrame, group: str, vector: str, document_vector: str
) -> DataFrame:
    """Cosine of each candidate to its document; a lone candidate is left out."""
    several = candidates.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    sides = documents.select(group, document_vector).join(several.select(group), group, "left_semi")
    scored = join_back(candidates, sides, group)
    return scored.withColumn("score", cosine(F.col(vector), F.col(document_vector))).drop(
        document_vector
    )


def rank_candidates(scored: DataFrame, group: str, key: str, k: int) -> DataFrame:
    return top_per_group(scored, [group], [F.desc("score"), F.col(key)], k)


BLOCK = 64  # candidates of a group that are walked at once


def select_diverse(
    scored: DataFrame, group: str, key: str, vector: str,
    k: int = rules.KEYWORDS_PER_DOCUMENT,
    threshold: float = rules.DIVERSITY_THRESHOLD,
) -> DataFrame:
    """Walk candidates by falling score, keep those unlike all kept before, up to ``k``.

    Returns ``group, key, score, rank``. The best ``BLOCK`` candidates of each group are
    cut out before the shuffle and walked by a fold; where that fills the ``k`` places
    or takes all candidates the group is done. Of the others what comes after the block
    is cut by what was kept, and goes through another round.
    """
    rows = scored.select(group, key, "score", unit(F.col(vector)).alias("_unit"))
    rows = reliable(rows.withColumn("_order", F.struct((-F.col("score")).alias("col1"), F.col(key))))
    entry = f"array<struct<_order: {rows.schema['_order'].dataType.simpleString()}, _unit: array<double>>>"
    nothing = F.array().cast(entry)
    done = None

    def step(kept: Column, candidate: Column) -> Column:
        unlike = F.forall(kept, lambda other: dot(other["_unit"], candidate["_unit"]) < threshold)
        return F.when((F.size(kept) < k) & unlike, F.concat(kept, F.array(candidate))).otherwise(kept)

    while True:
        block = top_per_group(rows, [group], [F.col("_order")], BLOCK, "_nth")
        blocks = block.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("_order", "_unit"))).alias("_block"))
        before = nothing
        if done is not None:
            blocks = blocks.join(done.select(group, "_kept"), group, "left")
            before = F.coalesce("_kept", nothing)
        walked = blocks.select(
            group, F.aggregate("_block", before.cast(entry), step).alias("_kept"),
            F.element_at("_block", -1)["_order"].alias("_last"),
        )
        if done is not None:
            walked = walked.unionByName(done.join(walked.select(group), group, "left_anti"))
        done = reliable(walked)
        open_groups = done.filter(F.size("_kept") < k)
        rest = join_back(rows, open_groups, group).filter(
            (F.col("_order") > F.col("_last"))
            & F.forall("_kept", lambda other: dot(other["_unit"], F.col("_unit")) < threshold)
        )
        rest = rest.select(rows.columns)
        if rest.isEmpty():
            break
        rows = reliable(rest)
    chosen = done.select(group, F.posexplode("_kept").alias("_at", "_entry"))
    return chosen.select(
        group, F.col(f"_entry._order.{key}").alias(key), (-F.col("_entry._order.col1")).alias("score"),
        (F.col("_at") + 1).alias("rank"),
    )


_AT_REST, _MOST_ROUNDS = 1e-9, 1_000_000  # centres that move no further; any clustering rests long before


def cluster_documents(
    vectors: DataFrame, key: str, vector: str,
    clusters: int = rules.CLUSTERS, seed: int = rules.CLUSTER_SEED,
) -> tuple[DataFrame, DataFrame] | None:
    """K-means labels and centres; two documents or fewer are not clustered.

    The rounds go on until the centres rest, so each centre is the mean of its documents.
    """
    dense = array_to_vector(F.col(vector).cast("array<double>")).alias("features")
    features = vectors.select(key, dense)
    n = features.count()
    if n <= 2:
        return None
    model = KMeans(k=min(clusters, n), seed=seed, tol=_AT_REST, maxIter=_MOST_ROUNDS).fit(features)
    labels = model.transform(features).select(key, F.col("prediction").alias("cluster"))
    centres = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    spark = vectors.sparkSession
    return labels, spark.createDataFrame(centres, "cluster int, centre array<double>")


def with_cluster(documents: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    return documents.join(labels, key)
