"""What to say about clusters: size, centre, samples, terms, summary, picture."""

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Window
from pyspark.sql import functions as F

from postloom import fixed_values as V
from postloom.functions.hashing import uniform
from postloom.functions.text import label_answer, label_text
from postloom.functions.vectors import cosine
from postloom.operators.models import loaded, model_key
from postloom.operators.skew import join_per_key, positions
from postloom.operators.vectors import reduce_dims
from postloom.session import write_and_read


def kmeans_model(rows, k, id="post_id", vector="embedding", seed=V.REDUCE_SEED):
    """The fitted k-means model, and ``id, cluster`` by it."""
    points = rows.select(id, array_to_vector(vector).alias("_vector"))
    model = KMeans(k=k, seed=seed, featuresCol="_vector", predictionCol="cluster").fit(points)
    return model, model.transform(points).select(id, "cluster")


def kmeans_clusters(rows, k, id="post_id", vector="embedding", seed=V.REDUCE_SEED):
    """``id, cluster`` by k-means, a quick second opinion without noise."""
    return kmeans_model(rows, k, id, vector, seed)[1]


def clustered(assigned):
    """Without noise."""
    return assigned.where(F.col("cluster") != V.NOISE)


def cluster_sizes(assigned):
    return clustered(assigned).groupBy("cluster").agg(F.count("*").alias("size"))


def centroids(members, vector="reduced"):
    """``cluster, size, centroid``: the mean vector of each cluster."""
    return (
        clustered(members)
        .groupBy("cluster")
        .agg(
            F.count("*").alias("size"),
            Summarizer.mean(array_to_vector(vector)).alias("_mean"),
        )
        .withColumn("centroid", vector_to_array("_mean"))
        .drop("_mean")
    )


def member_similarity(members, centres, vector="reduced"):
    """``members`` with the cosine to the centroid of their cluster.

    ``centres`` is read more than once; write it down first.
    """
    together = join_per_key(clustered(members), centres, "cluster", "size")
    return together.withColumn("similarity", cosine(F.col(vector), F.col("centroid"))).drop(
        "centroid", "size"
    )


def sample_members(similar, id="post_id", size=V.SAMPLE_SIZE, seed=V.SAMPLE_SEED):
    """Up to ``size`` members per cluster, drawn without replacement by similarity.

    Each member gets the key ln(u) / weight with its own uniform u; the largest
    keys are a weighted sample.  Weights that are not positive count as a tiny
    one, so a cluster of zeros is sampled evenly.
    """
    weight = F.greatest("similarity", F.lit(1e-12))
    drawn = similar.withColumn("_key", F.ln(uniform(seed, F.col(id))) / weight)
    order = Window.partitionBy("cluster").orderBy(F.desc("_key"), id)
    return (
        drawn.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= size)
        .drop("_key")
    )


def cluster_prompts(sample, text="text_clean", posts=V.PROMPT_POSTS):
    """The labeller's prompt per cluster: instructions and the first sampled posts."""
    first = sample.where(F.col("rank") <= posts)
    lines = F.sort_array(F.collect_list(F.struct("rank", label_text(F.col(text)).alias("line"))))
    return first.groupBy("cluster").agg(
        F.concat(F.lit(V.PROMPT_HEAD), F.array_join(lines["line"], "\n")).alias("prompt")
    )


def label_clusters(prompts, make_labeller):
    """``cluster, summary`` by the user's text generator.

    ``make_labeller`` runs once per Python worker and returns a function from a list of
    prompts to a list of generated texts.
    """

    key = model_key(make_labeller)

    def label_task(frames):
        for frame in frames:
            label = loaded(key, make_labeller)
            frame["generated"] = label(frame["prompt"].tolist())
            yield frame[["cluster", "generated"]]

    cluster_type = prompts.schema["cluster"].dataType.simpleString()
    generated = prompts.mapInPandas(label_task, f"cluster {cluster_type}, generated string")
    return generated.select("cluster", label_answer(F.col("generated")).alias("summary"))


def term_scores(members, text="text_clean"):
    """Class-based TF-IDF: ``cluster, term, uses, score``.

    A term scores by its uses in the cluster, times ln(1 + mean cluster length
    / uses in all clusters).
    """
    # The outer form: the plain one would compute the text again to test it for words.
    spread = clustered(members).select("cluster", F.explode_outer(F.split(text, " ")).alias("term"))
    uses = write_and_read(
        spread.where("term <> ''").groupBy("cluster", "term").agg(F.count("*").alias("uses")),
        "term-uses",
    )
    everywhere = write_and_read(
        uses.groupBy("term").agg(
            F.sum("uses").alias("all_uses"), F.count("*").alias("clusters")
        ),
        "terms",
    )
    lengths = uses.groupBy("cluster").agg(F.sum("uses").alias("length"))
    mean_length = lengths.agg(F.avg("length")).scalar()
    score = F.col("uses") * F.ln(1 + mean_length / F.col("all_uses"))
    scored = join_per_key(uses, everywhere, "term", "clusters")
    return scored.select("cluster", "term", "uses", F.round(score, 9).alias("score"))


def cluster_terms(members, text="text_clean", terms=4):
    """``cluster, summary``: the best terms of each cluster, best first."""
    order = Window.partitionBy("cluster").orderBy(F.desc("score"), "term")
    best = term_scores(members, text).withColumn("rank", F.row_number().over(order))
    listed = F.sort_array(F.collect_list(F.struct("rank", "term")))
    return (
        best.where(F.col("rank") <= terms)
        .groupBy("cluster")
        .agg(F.array_join(listed["term"], " ").alias("summary"))
    )


def centroid_xy(centres):
    """``cluster, x, y``: centroids in two principal components; a lone one lies at 0, 0."""
    if centres.limit(2).count() < 2:
        return centres.select("cluster", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    placed = reduce_dims(centres, dims=2, vector="centroid", name="_xy")
    return placed.select(
        "cluster", F.col("_xy")[0].alias("x"), F.col("_xy")[1].alias("y")
    )


def cluster_summary(centres, places, labels):
    """``cluster, size, x, y, summary``, one row per cluster."""
    return (
        centres.select("cluster", "size")
        .join(places, "cluster")
        .join(labels, "cluster", "left")
        .select("cluster", "size", "x", "y", "summary")
    )


def scale_to_unit(rows, *columns):
    """The columns stretched to [0, 1] over all rows; a constant column becomes 0."""

    def scaled(name):
        low = rows.select(F.min(name)).scalar()
        high = rows.select(F.max(name)).scalar()
        # try_divide leaves a null where the range is empty.
        return F.coalesce(F.try_divide(F.col(name) - low, high - low), F.lit(0.0))

    return rows.withColumns({name: scaled(name) for name in columns})


def bubble_table(summary):
    """The summary ready to draw: unit square, bubble size, colour position, label."""
    clusters = summary.agg(F.count_distinct("cluster")).scalar()
    scaled = scale_to_unit(summary, "x", "y")
    ranked = positions(scaled, "cluster", "_position")
    return (
        ranked.withColumn("size_scaled", F.sqrt("size"))
        .withColumn("color", F.col("_position") / F.greatest(clusters - 1, F.lit(1)))
        .withColumn("label", F.concat(F.lit("Cluster "), F.col("cluster").cast("string")))
        .drop("_position")
    )
