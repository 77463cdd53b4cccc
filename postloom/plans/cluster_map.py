"""The analysis job: vectors to labelled clusters on a map."""

from pyspark.sql import functions as F

from postloom import fixed_values as V
from postloom.functions.vectors import normalize
from postloom.operators import clusters
from postloom.operators.hierarchy import density_clusters
from postloom.operators.vectors import reduce_dims
from postloom.session import write_and_read


def assign_clusters(vectors, dims=None, id="post_id", **density):
    """``vectors`` at unit length, reduced to ``dims`` components, with their cluster.

    Without ``dims`` the unit vectors themselves are clustered.
    """
    unit = vectors.withColumn("reduced", normalize(F.col("embedding"))).drop("embedding")
    if dims:
        unit = reduce_dims(unit, dims, "reduced")
    unit = write_and_read(unit, "reduced")
    width = dims or unit.select(F.size("reduced")).first()[0]
    # A post may occur several times: its first vector stands for it, and all its rows get its
    # one cluster.  Rows without an id stay, as noise.
    posts = unit.groupBy(id).agg(F.min("reduced").alias("reduced"))
    found = density_clusters(posts.where(F.col(id).isNotNull()), width, id, "reduced", **density)
    return unit.join(found, id, "left").withColumn(
        "cluster", F.coalesce("cluster", F.lit(V.NOISE)))


def summarize(members, make_labeller=None, id="post_id", text="text_clean",
              sample_size=V.SAMPLE_SIZE, seed=V.SAMPLE_SEED):
    """``cluster, size, x, y, summary`` for the clusters of ``members``.

    Labels are the best terms of a cluster, or come from the user's labeller,
    which sees a prompt with sampled posts.
    """
    centres = write_and_read(clusters.centroids(members), "centroids")
    if make_labeller is None:
        labels = clusters.cluster_terms(members, text)
    else:
        similar = clusters.member_similarity(members, centres)
        sample = clusters.sample_members(similar, id, sample_size, seed)
        labels = clusters.label_clusters(clusters.cluster_prompts(sample, text), make_labeller)
    return clusters.cluster_summary(centres, clusters.centroid_xy(centres), labels)


def cluster_map(vectors, make_labeller=None, dims=V.REDUCED_DIM, id="post_id",
                text="text_clean", **density):
    """The whole analysis, from a table of vectors to a table ready to draw."""
    members = write_and_read(assign_clusters(vectors, dims, id, **density), "assigned")
    summary = write_and_read(summarize(members, make_labeller, id, text), "summary")
    return clusters.bubble_table(summary)
