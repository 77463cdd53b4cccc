"""Queries on vectors: encoding, checks, arithmetic, reduction."""

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F

from postloom.checks.registry import query
from postloom.checks.text import clean_sql
from postloom.functions import vectors as V
from postloom.functions.text import normalize_post
from postloom.operators import vectors
from postloom.sources.tables import spread, table

# Vectors are compared component by component.
COMPONENTS_SQL = """
WITH parts AS (
    SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS pos,
           CAST(unnest(embedding) AS DOUBLE) AS x
    FROM embeddings)
"""
OF_DOCUMENT = "vec_id = doc_id % (SELECT count(*) FROM embeddings)"
HASHED_SQL = f"""
WITH words AS (
    SELECT doc_id, unnest(string_split({clean_sql('text')}, ' ')) AS word FROM documents
), codes AS (
    SELECT doc_id, CAST('0x' || substr(md5(word), 1, 8) AS BIGINT) % 64 AS pos,
           CASE WHEN substr(md5(word), 9, 1) < '8' THEN 1 ELSE -1 END AS sign
    FROM words WHERE word <> ''
), sums AS (
    SELECT doc_id, pos, sum(sign) AS value FROM codes GROUP BY ALL
), hashed AS (
    SELECT doc_id, p.pos, CAST(coalesce(value, 0) AS DOUBLE) AS value
    FROM documents CROSS JOIN range(64) AS p(pos) LEFT JOIN sums USING (doc_id, pos)
)
"""


def by_component(rows, id, vector, digits=None):
    # The outer form: the plain one would compute the vector again to test it for emptiness.
    components = rows.select(id, F.posexplode_outer(vector).alias("pos", "value"))
    value = F.col("value").cast("double")
    return components.select(
        id,
        F.col("pos").cast("bigint").alias("pos"),
        (F.round(value, digits) if digits else value).alias("value"),
    )


def embeddings(spark, folder):
    return table(spark, folder, "embeddings", "vec_id", "embedding", "label")


def document_words(spark, folder):
    return spread(table(spark, folder, "documents", "doc_id", "text")).select(
        "doc_id", normalize_post(F.col("text")).alias("text_clean")
    )


def dealt_words(spark, folder):
    """``document_words`` with the vector, ``vec_id``, that each document's number is dealt."""
    vectors_ = embeddings(spark, folder).select(F.count("*")).scalar()
    return document_words(spark, folder).withColumn("vec_id", F.col("doc_id") % vectors_)


@query("hashed_embeddings", HASHED_SQL + "SELECT doc_id, pos, value FROM hashed")
def hashed_embeddings(spark, folder):
    encoded = document_words(spark, folder).select(
        "doc_id", vectors.hashed_embedding(F.col("text_clean")).alias("embedding")
    )
    return by_component(encoded, "doc_id", "embedding")


@query("embed_posts", HASHED_SQL + """
SELECT doc_id, pos, round(CAST(CAST(CASE WHEN norm > 0 THEN value / norm ELSE value END AS FLOAT) AS DOUBLE), 5)
       AS value
FROM (SELECT *, sqrt(sum(value * value) OVER (PARTITION BY doc_id)) AS norm FROM hashed)""")
def embed_posts(spark, folder):
    """The encoder hook, with an encoder whose vectors SQL can repeat."""
    encoded = vectors.encode_posts(
        document_words(spark, folder), vectors.hashing_encoder(), text="text_clean"
    )
    return by_component(encoded, "doc_id", "embedding", 5)


@query("truncate_vectors", COMPONENTS_SQL + """
SELECT vec_id, pos, x AS value FROM parts WHERE pos < 16""")
def truncate_vectors(spark, folder):
    short = embeddings(spark, folder).withColumn("short", V.truncate(F.col("embedding"), 16))
    return by_component(short, "vec_id", "short")


@query("normalize_vectors", COMPONENTS_SQL + """, scaled AS (
    SELECT vec_id, pos, x * label AS x FROM parts)
SELECT vec_id, pos, round(CAST(CAST(CASE WHEN norm > 0 THEN x / norm ELSE x END AS FLOAT) AS DOUBLE), 5) AS value
FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY vec_id)) AS norm FROM scaled)""")
def normalize_vectors(spark, folder):
    """Vectors stretched by their label; label 0 makes zero vectors."""
    stretched = embeddings(spark, folder).select(
        "vec_id", F.transform("embedding", lambda x: x * F.col("label")).alias("embedding")
    )
    unit = stretched.select("vec_id", V.normalize(F.col("embedding")).alias("unit"))
    return by_component(unit, "vec_id", "unit", 5)


def damaged(spark, folder):
    """The vectors, with NaN, infinite and missing components for labels 0, 1 and 2."""
    wrong = (
        F.when(F.col("label") == 0, F.lit(float("nan")))
        .when(F.col("label") == 1, F.lit(float("-inf")))
        .when(F.col("label") == 2, F.lit(None))
    )
    return embeddings(spark, folder).withColumn(
        "embedding",
        F.transform(
            "embedding",
            lambda x: F.when((x < -0.2) & (F.col("label") <= 2), wrong).otherwise(x).cast("float"),
        ),
    )


@query("bad_vectors", COMPONENTS_SQL + """
SELECT DISTINCT vec_id, label FROM parts WHERE label <= 2 AND x < -0.2""")
def bad_vectors(spark, folder):
    return vectors.bad_vectors(damaged(spark, folder)).select("vec_id", "label")


@query("repair_vectors", HASHED_SQL + """, bad AS (
    SELECT vec_id FROM (SELECT vec_id, label, unnest(embedding) AS x FROM embeddings)
    WHERE label <= 2 AND x < -0.2 GROUP BY vec_id)
SELECT doc_id, pos, round(CAST(CAST(CASE WHEN norm > 0 THEN value / norm ELSE value END AS FLOAT) AS DOUBLE), 5)
       AS value
FROM (SELECT *, sqrt(sum(value * value) OVER (PARTITION BY doc_id)) AS norm FROM hashed)
JOIN bad ON """ + OF_DOCUMENT + """
UNION ALL
SELECT doc_id, generate_subscripts(embedding, 1) - 1, round(CAST(unnest(embedding) AS DOUBLE), 5)
FROM documents JOIN (SELECT * FROM embeddings ANTI JOIN bad USING (vec_id))
    ON """ + OF_DOCUMENT)
def repair_vectors(spark, folder):
    """Damaged vectors encoded again, each from the texts of all documents dealt to it."""
    rows = dealt_words(spark, folder).join(
        damaged(spark, folder).select("vec_id", "embedding"), "vec_id").drop("vec_id")
    repaired = vectors.repair_vectors(rows, vectors.hashing_encoder(), text="text_clean")
    return by_component(repaired, "doc_id", "embedding", 5)


def covariance_checks(reduced, dims):
    """``one, two, uncorrelated, falling``: for each pair of components whether their covariance is
    nothing beside the first variance, and whether variances fall from one to the next."""
    pairs = [(i, j) for i in range(dims) for j in range(i, dims)]
    value = [F.col("reduced")[i].cast("double") for i in range(dims)]
    sums = reduced.agg(*[F.covar_samp(value[i], value[j]).alias(f"c{i}_{j}") for i, j in pairs])
    first = F.col("c0_0")
    rows = [
        F.struct(
            F.lit(i).cast("bigint").alias("one"), F.lit(j).cast("bigint").alias("two"),
            (F.lit(i == j) | (F.abs(F.col(f"c{i}_{j}")) <= first * 1e-4)).alias("uncorrelated"),
            (F.lit(i == 0) | (F.col(f"c{i}_{i}") <= F.col(f"c{max(i - 1, 0)}_{max(i - 1, 0)}") * (1 + 1e-6))
             ).alias("falling"))
        for i, j in pairs
    ]
    return sums.select(F.inline(F.array(*rows)))


@query("reduce_dims", """
SELECT a.i AS one, b.i AS two, TRUE AS uncorrelated, TRUE AS falling
FROM range(16) AS a(i) JOIN range(16) AS b(i) ON b.i >= a.i""")
def reduce_dims(spark, folder):
    """The components are principal: uncorrelated, and of falling variance."""
    unit = embeddings(spark, folder).select(
        "vec_id", V.normalize(F.col("embedding")).alias("embedding")
    )
    return covariance_checks(vectors.reduce_dims(unit, dims=16), 16)


@query("kept_variance", COMPONENTS_SQL + """
SELECT count(*) AS n, TRUE AS most FROM (
    SELECT pos, var_samp(x) AS v FROM parts GROUP BY pos)""")
def kept_variance(spark, folder):
    """Sixteen principal components keep no less variance than the best sixteen plain ones."""
    rows = embeddings(spark, folder).select("vec_id", "embedding")
    width = rows.select(F.max(F.size("embedding"))).first()[0]
    plain = rows.agg(*[F.var_samp(F.col("embedding")[i].cast("double")).alias(f"v{i}") for i in range(width)])
    best = F.aggregate(F.slice(F.sort_array(F.array(*[F.col(f"v{i}") for i in range(width)]), False), 1, 16),
                       F.lit(0.0), lambda total, v: total + v)
    turned = vectors.reduce_dims(rows, dims=16)
    own = turned.agg(*[F.var_samp(F.col("reduced")[i].cast("double")).alias(f"r{i}") for i in range(16)])
    kept = sum((F.col(f"r{i}") for i in range(1, 16)), F.col("r0"))
    least = plain.select(best).scalar()
    return own.select(F.lit(width).cast("bigint").alias("n"), (kept >= least * (1 - 1e-6)).alias("most"))


@query("reduced_norms", COMPONENTS_SQL + """
SELECT vec_id, round(sqrt(sum((x - mean) * (x - mean))), 4) AS norm
FROM (SELECT *, avg(x) OVER (PARTITION BY pos) AS mean FROM parts) GROUP BY vec_id""")
def reduced_norms(spark, folder):
    """Distance of each vector to the mean, in all its principal components.

    Components only turn the space, so distances are what SQL finds without them.
    """
    rows = embeddings(spark, folder).select("vec_id", "embedding")
    model = vectors.reduction_model(rows, 64)
    mean = rows.agg(Summarizer.mean(array_to_vector("embedding")).alias("embedding"))
    mean = mean.select(vector_to_array("embedding").alias("embedding"))
    origin = vectors.reduce_dims(mean, model=model).select("reduced").scalar()
    turned = vectors.reduce_dims(rows, model=model).withColumn("origin", origin)
    steps = F.zip_with("reduced", "origin", lambda x, m: x - m)
    return turned.select("vec_id", F.round(V.norm(steps), 4).alias("norm"))
