"""Queries on clusters, with the label of a vector as its cluster where SQL needs one."""

from pyspark.sql import functions as F

from postloom import fixed_values as V
from postloom.checks.registry import query
from postloom.checks.text import clean_sql
from postloom.checks.vectors import (
    HASHED_SQL, OF_DOCUMENT, dealt_words, document_words, embeddings,
)
from postloom.operators import clusters, density, hierarchy, neighbors, vectors
from postloom.session import write_and_read
from postloom.sources.tables import table

# Label 0 plays the noise.
MEMBERS_SQL = """
WITH members AS (
    SELECT vec_id, CAST(label AS BIGINT) AS cluster, embedding
    FROM embeddings WHERE label <> 0
), parts AS (
    SELECT vec_id, cluster, generate_subscripts(embedding, 1) - 1 AS pos,
           CAST(unnest(embedding) AS DOUBLE) AS x
    FROM members
), centres AS (
    SELECT cluster, pos, avg(x) AS c FROM parts GROUP BY ALL
), sizes AS (
    SELECT cluster, count(*) AS size FROM members GROUP BY ALL
), likeness AS (
    SELECT vec_id, cluster, sum(x * c) / sqrt(sum(x * x) * sum(c * c)) AS similarity
    FROM parts JOIN centres USING (cluster, pos) GROUP BY ALL
)
"""


# Documents are dealt to the vectors in turn, so that every text is used.
VECTORS = "FROM embeddings"
DOCUMENT_VECTORS_SQL = f"""FROM (
    SELECT doc_id AS vec_id, label, embedding FROM documents JOIN embeddings ON {OF_DOCUMENT})"""


def members(spark, folder):
    """Vectors with their label as cluster; label 0 plays the noise."""
    cluster = F.when(F.col("label") == 0, -1).otherwise(F.col("label"))
    return embeddings(spark, folder).select("vec_id", cluster.alias("cluster"), "embedding")


def as_bigint(rows, *columns):
    return rows.withColumns({name: F.col(name).cast("bigint") for name in columns})


@query("cluster_sizes", MEMBERS_SQL + "SELECT cluster, size FROM sizes")
def cluster_sizes(spark, folder):
    return as_bigint(clusters.cluster_sizes(members(spark, folder)), "cluster")


@query("cluster_centroids", MEMBERS_SQL + """
SELECT cluster, size, pos, round(c, 6) AS value FROM centres JOIN sizes USING (cluster)""")
def cluster_centroids(spark, folder):
    centres = clusters.centroids(members(spark, folder), "embedding")
    spread = centres.select("cluster", "size", F.posexplode("centroid").alias("pos", "value"))
    return as_bigint(spread.withColumn("value", F.round("value", 6)), "cluster", "pos")


def similar_members(spark, folder):
    found = members(spark, folder)
    centres = write_and_read(clusters.centroids(found, "embedding"), "centroids")
    return clusters.member_similarity(found, centres, "embedding")


@query("member_similarity", MEMBERS_SQL + """
SELECT vec_id, cluster, round(similarity, 6) AS similarity FROM likeness""")
def member_similarity(spark, folder):
    return as_bigint(similar_members(spark, folder), "cluster").select(
        "vec_id", "cluster", F.round("similarity", 6).alias("similarity")
    )


SAMPLE_SQL = MEMBERS_SQL + """, keyed AS (
    SELECT *, ln((CAST('0x' || substr(md5('42:' || vec_id), 1, 13) AS BIGINT) + 1)
                 / 4503599627370497.0) / greatest(similarity, 1e-12) AS key
    FROM likeness
), sample AS (
    SELECT vec_id, cluster, similarity, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY key DESC, vec_id) AS rank
        FROM keyed)
    WHERE rank <= 10
)
"""


@query("cluster_sample", SAMPLE_SQL + """
SELECT vec_id, cluster, rank, round(similarity, 6) AS similarity FROM sample""")
def cluster_sample(spark, folder):
    sample = clusters.sample_members(similar_members(spark, folder), "vec_id")
    return as_bigint(sample, "cluster", "rank").select(
        "vec_id", "cluster", "rank", F.round("similarity", 6).alias("similarity")
    )


@query("cluster_prompts", SAMPLE_SQL.replace(VECTORS, DOCUMENT_VECTORS_SQL) + rf""", lines AS (
    SELECT cluster, rank, trim(regexp_replace(regexp_replace(
               regexp_replace({clean_sql('text')}, 'http[^\s\p{{Z}}\x1c-\x1f\x85]+', '', 'g'),
               '[^\p{{L}}\p{{N}}_\s\p{{Z}}\x1c-\x1f\x85]', '', 'g'),
               '[\s\p{{Z}}\x1c-\x1f\x85]+', ' ', 'g')) AS line
    FROM sample JOIN documents ON doc_id = vec_id WHERE rank <= {V.PROMPT_POSTS})
SELECT cluster, '{V.PROMPT_HEAD}' || string_agg(line, chr(10) ORDER BY rank) AS prompt
FROM lines GROUP BY cluster""")
def cluster_prompts(spark, folder):
    rows = write_and_read(worded_members(spark, folder), "worded")
    similar = clusters.member_similarity(
        rows, write_and_read(clusters.centroids(rows, "embedding"), "centroids"), "embedding"
    )
    sample = clusters.sample_members(similar, "doc_id")
    return as_bigint(clusters.cluster_prompts(sample), "cluster")


TERMS_SQL = f"""
WITH words AS (
    SELECT CAST(label AS BIGINT) AS cluster, unnest(string_split({clean_sql('text')}, ' ')) AS term
    FROM documents JOIN embeddings ON {OF_DOCUMENT} WHERE label <> 0
), uses AS (
    SELECT cluster, term, count(*) AS uses FROM words WHERE term <> '' GROUP BY ALL
), everywhere AS (
    SELECT term, sum(uses) AS all_uses FROM uses GROUP BY ALL
), lengths AS (
    SELECT cluster, sum(uses) AS length FROM uses GROUP BY ALL
), scores AS (
    SELECT cluster, term, uses,
           round(uses * ln(1 + (SELECT avg(length) FROM lengths) / all_uses), 9) AS score
    FROM uses JOIN everywhere USING (term)
)
"""


def worded_members(spark, folder):
    """Every document with the cluster and vector that its number is dealt."""
    vectors_ = members(spark, folder)
    return dealt_words(spark, folder).join(vectors_, "vec_id")


@query("term_scores", TERMS_SQL + """
SELECT cluster, term, uses, score FROM scores""")
def term_scores(spark, folder):
    return as_bigint(clusters.term_scores(worded_members(spark, folder)), "cluster")


@query("cluster_terms", TERMS_SQL + """
SELECT cluster, string_agg(term, ' ' ORDER BY rank) AS summary
FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY score DESC, term) AS rank
      FROM scores)
WHERE rank <= 4 GROUP BY cluster""")
def cluster_terms(spark, folder):
    return as_bigint(clusters.cluster_terms(worded_members(spark, folder)), "cluster")


# ---------------------------------------------------------------- picture


@query("minmax_scale", """
SELECT event_id, round((value - (SELECT min(value) FROM events))
           / ((SELECT max(value) FROM events) - (SELECT min(value) FROM events)), 9) AS value,
       0.0::DOUBLE AS zero
FROM events""")
def minmax_scale(spark, folder):
    events = table(spark, folder, "events", "event_id", "value").withColumn("zero", F.lit(5.0))
    scaled = clusters.scale_to_unit(events, "value", "zero")
    return scaled.withColumn("value", F.round("value", 9))


@query("bubble_table", MEMBERS_SQL + """, flat AS (
    SELECT cluster, max(c) FILTER (WHERE pos = 0) AS x, max(c) FILTER (WHERE pos = 1) AS y
    FROM centres GROUP BY ALL)
SELECT cluster, size,
       round((x - min(x) OVER ()) / (max(x) OVER () - min(x) OVER ()), 6) AS x,
       round((y - min(y) OVER ()) / (max(y) OVER () - min(y) OVER ()), 6) AS y,
       round(sqrt(size), 6) AS size_scaled,
       round((dense_rank() OVER (ORDER BY cluster) - 1) / (count(*) OVER () - 1), 6) AS color,
       'Cluster ' || cluster AS label
FROM flat JOIN sizes USING (cluster)""")
def bubble_table(spark, folder):
    centres = write_and_read(clusters.centroids(members(spark, folder), "embedding"), "centroids")
    places = centres.select("cluster", "size", F.col("centroid")[0].alias("x"),
                            F.col("centroid")[1].alias("y"))
    bubbles = as_bigint(clusters.bubble_table(places), "cluster")
    return bubbles.withColumns({
        name: F.round(name, 6) for name in ("x", "y", "size_scaled", "color")
    })


@query("centroid_xy", MEMBERS_SQL + """
SELECT count(*) AS clusters, TRUE AS uncorrelated, TRUE AS falling, TRUE AS centred_apart FROM sizes""")
def centroid_xy(spark, folder):
    """The places are principal: uncorrelated, and wider along x than along y."""
    places = clusters.centroid_xy(clusters.centroids(members(spark, folder), "embedding"))
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    return places.agg(
        F.count("*").alias("clusters"),
        (F.abs(F.covar_samp(x, y)) <= 1e-4 * F.var_samp(x)).alias("uncorrelated"),
        (F.var_samp(x) >= F.var_samp(y)).alias("falling"),
        (F.count_distinct("x", "y") == F.count("*")).alias("centred_apart"))


@query("cluster_summary", MEMBERS_SQL + TERMS_SQL.replace("WITH words", ", words") + """
SELECT cluster, size, round(x, 6) AS x, round(y, 6) AS y, summary
FROM sizes JOIN (
    SELECT cluster, max(c) FILTER (WHERE pos = 0) AS x, max(c) FILTER (WHERE pos = 1) AS y
    FROM centres GROUP BY ALL) USING (cluster)
LEFT JOIN (
    SELECT cluster, string_agg(term, ' ' ORDER BY rank) AS summary
    FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY score DESC, term) AS rank
          FROM scores)
    WHERE rank <= 4 GROUP BY cluster) USING (cluster)""")
def cluster_summary(spark, folder):
    """The summary with the first two components of a centroid as its place."""
    centres = write_and_read(clusters.centroids(members(spark, folder), "embedding"), "centroids")
    places = centres.select(
        "cluster",
        F.round(F.col("centroid")[0], 6).alias("x"),
        F.round(F.col("centroid")[1], 6).alias("y"),
    )
    labels = clusters.cluster_terms(worded_members(spark, folder))
    return as_bigint(clusters.cluster_summary(centres, places, labels), "cluster")


@query("kmeans_clusters", """
SELECT vec_id, TRUE AS nearest, (SELECT count(*) FROM embeddings) AS vectors FROM embeddings""")
def kmeans_clusters(spark, folder):
    """Every vector is in the cluster of the nearest centre."""
    rows = embeddings(spark, folder)
    model, found = clusters.kmeans_model(rows, k=10, id="vec_id")
    centres = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in model.clusterCenters()])

    def distance(centre):
        parts = F.zip_with("embedding", centre, lambda x, c: (x.cast("double") - c) * (x.cast("double") - c))
        return F.aggregate(parts, F.lit(0.0), lambda total, p: total + p)

    measured = found.join(rows, "vec_id").withColumn("distances", F.transform(centres, distance))
    own = F.get("distances", F.col("cluster"))
    near = own <= F.array_min("distances") * (1 + 1e-9) + 1e-12
    return measured.select("vec_id", near.alias("nearest"), rows.select(F.count("*")).scalar().alias("vectors"))


# ---------------------------------------------------------------- density


PLANES_SQL = """, directions AS (
    SELECT t, p, pos, CASE WHEN substr(md5('2025:' || t || ':' || p || ':' || pos), 1, 1) < '8'
                           THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS sign
    FROM range({tables}) AS a(t), range({lines}) AS b(p), range(64) AS c(pos)
)"""


def cells_sql(points, id, width, projections, tables, min_pts):
    """The definition of `postloom.operators.density`, step by step, as SQL CTEs."""
    return PLANES_SQL.format(tables=tables, lines=projections) + f""", shifts AS (
    SELECT t, p, CAST('0x' || substr(md5('2025:' || t || ':' || p), 1, 8) AS BIGINT)
                 / 4294967296.0::DOUBLE AS shift
    FROM range({tables}) AS a(t), range({projections}) AS b(p)
), boxes AS (
    SELECT {id}, t, p,
           CAST(floor(sum(x * sign) / {width}::DOUBLE + any_value(shift)) AS INTEGER) AS box
    FROM {points} JOIN directions USING (pos) JOIN shifts USING (t, p) GROUP BY {id}, t, p
), cells AS (
    SELECT {id}, t || ':' || string_agg(CAST(box AS VARCHAR), ',' ORDER BY p) AS cell
    FROM boxes GROUP BY {id}, t
), dense AS (
    SELECT cell, count(*) AS posts FROM cells GROUP BY cell HAVING count(*) >= {min_pts}
), touched AS (
    SELECT {id}, cell, posts, count(*) OVER (PARTITION BY {id}) AS dense_cells
    FROM cells JOIN dense USING (cell)
), inside AS (
    SELECT {id}, cell, posts FROM touched WHERE dense_cells >= 2
), links AS (
    SELECT a.cell AS one, b.cell AS two FROM inside a JOIN inside b USING ({id})
    WHERE a.cell <> b.cell GROUP BY ALL HAVING count(*) >= {min_pts}
)
"""


VECTOR_CELLS = dict(cell_width=1.5, projections=3, tables=4)
VECTOR_POINTS_SQL = """
WITH points AS (
    SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS pos,
           CAST(unnest(embedding) AS DOUBLE) AS x
    FROM embeddings)
""" + cells_sql("points", "vec_id", 1.5, 3, 4, 8)


@query("neighbor_cells", VECTOR_POINTS_SQL + "SELECT vec_id, cell, posts FROM touched")
def neighbor_cells(spark, folder):
    """Each vector with the dense cells it shares with its neighbours."""
    located, _, dense = density.locate(
        embeddings(spark, folder), 64, "vec_id", min_pts=8, **VECTOR_CELLS
    )
    spread = located.select("vec_id", F.explode("cells").alias("cell"))
    return density.join_per_key(spread, dense, "cell", "posts").select("vec_id", "cell", "posts")


@query("cell_links", VECTOR_POINTS_SQL + """
SELECT one AS "left", two AS "right" FROM links WHERE one < two""")
def cell_links(spark, folder):
    """Dense cells that overlap."""
    _, found, dense = density.locate(
        embeddings(spark, folder), 64, "vec_id", min_pts=8, **VECTOR_CELLS
    )
    members = density.dense_members(found, dense)
    return density.cell_links(members, 8).select("left", "right")


# ---------------------------------------------------------------- near posts


def near_sql(vectors_, id, least, k=16, tables=12, bucket=64, whole=False):
    """The definition of `postloom.operators.neighbors`, as CTEs over ``vectors_ (id, v)``; ``whole``
    without representatives."""
    first_ones = "SELECT * FROM buckets" if whole else f"""
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY t, bucket ORDER BY md5(point::VARCHAR), point) AS n
                   FROM buckets) WHERE n <= {bucket}"""
    return f""", named AS (
    SELECT min({id}) AS point, count(*) AS weight, v FROM {vectors_}
    WHERE len(list_filter(v, lambda x: x <> 0)) > 0 GROUP BY v
), parts AS (
    SELECT point, generate_subscripts(v, 1) - 1 AS pos, unnest(v) AS x FROM named
), plane_count AS (
    SELECT greatest(0, ceil(log2(count(*) / {bucket}.0::DOUBLE)))::INT AS bits FROM named
)""" + PLANES_SQL.format(tables=tables, lines=32) + f""", sides AS (
    SELECT point, t, p, sum(x * sign) >= 0 AS side
    FROM parts JOIN directions USING (pos), plane_count WHERE p < greatest(bits, 1) GROUP BY ALL
), buckets AS (
    SELECT point, t, sum(CASE WHEN side AND p < bits THEN 1 << p ELSE 0 END) AS bucket
    FROM sides, plane_count GROUP BY ALL
), first_ones AS ({first_ones}
), met AS (
    SELECT DISTINCT a.point AS post, b.point AS near
    FROM buckets a JOIN first_ones b USING (t, bucket) WHERE a.point <> b.point
), near AS (
    SELECT post, near, cosine FROM (
        SELECT post, near, cosine, row_number() OVER (PARTITION BY post ORDER BY cosine DESC, near) AS n
        FROM (SELECT post, near, round(list_cosine_similarity(a.v, b.v), 9) AS cosine
              FROM met JOIN named a ON a.point = post JOIN named b ON b.point = near)
        WHERE cosine >= {least})
    WHERE n <= {k}
)
"""


# Vectors of labels 1 to 6 drawn to a direction of their label; the other labels are noise.
DRAWN_SQL = """
WITH RECURSIVE drawn AS (
    SELECT vec_id, list(CAST(x AS DOUBLE) + CASE WHEN label BETWEEN 1 AND 6 THEN
        CASE WHEN substr(md5(label || ':' || pos), 1, 1) < '8' THEN 0.25::DOUBLE ELSE -0.25::DOUBLE END
        ELSE 0 END ORDER BY pos) AS v
    FROM (SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding) AS x
          FROM embeddings) GROUP BY vec_id)
"""


def drawn(spark, folder):
    """Vectors of labels 1 to 6 drawn to a direction of their label; the others are noise."""
    def moved(x, pos):
        digit = F.substring(F.md5(F.concat("label", F.lit(":"), pos)), 1, 1)
        return x.cast("double") + F.when(
            F.col("label").between(1, 6), F.when(digit < "8", 0.25).otherwise(-0.25)).otherwise(0.0)

    return embeddings(spark, folder).select("vec_id", F.transform("embedding", moved).alias("embedding"))


@query("neighbor_edges", DRAWN_SQL + near_sql("drawn", "vec_id", 0.5) + """
SELECT least(post, near) AS "left", greatest(post, near) AS "right", max(cosine) AS cosine
FROM near GROUP BY ALL""")
def neighbor_edges(spark, folder):
    """Near vectors with their cosine."""
    rows = write_and_read(drawn(spark, folder), "drawn")
    return neighbors.neighbor_edges(neighbors.nearest(
        rows, 64, "vec_id", least=0.5, representatives=neighbors.BUCKET))


def hierarchy_sql(id, vectors_, min_pts, min_size, levels=hierarchy.LEVELS):
    """The definition of `postloom.operators.hierarchy`, as CTEs over ``named`` and ``near``."""
    ladder = ", ".join(f"({at}, {level}::DOUBLE, {width!r}::DOUBLE)"
                       for at, (level, width) in enumerate(zip(levels, hierarchy.widths(levels))))
    sql = f""", ladder(level, least, width) AS (VALUES {ladder}
), listed AS (
    SELECT point, weight AS posts, 1.0::DOUBLE AS cosine, -1 AS near FROM named
    UNION ALL SELECT post, weight, cosine, near FROM near JOIN named ON point = near
), core AS (
    SELECT point, max(cosine) AS core FROM (
        SELECT point, cosine, sum(posts) OVER (
            PARTITION BY point ORDER BY near >= 0, cosine DESC, near ROWS UNBOUNDED PRECEDING) AS n FROM listed)
    WHERE n >= {min_pts} GROUP BY point
), entered AS (
    SELECT point, weight, level FROM core JOIN named USING (point) JOIN ladder ON core >= least
), reached AS (
    SELECT DISTINCT post AS a, near AS b, level
    FROM near JOIN core x ON x.point = post JOIN core y ON y.point = near
    JOIN ladder ON least(cosine, x.core, y.core) >= ladder.least
), ways AS (
    SELECT a, b, level FROM reached UNION SELECT b, a, level FROM reached
), reach AS (
    SELECT level, point, point AS other FROM entered
    UNION
    SELECT reach.level, reach.point, ways.b FROM reach JOIN ways ON ways.level = reach.level AND ways.a = reach.other
), placed AS (
    SELECT level, point, min(other) AS root FROM reach GROUP BY ALL
), parts_of AS (
    SELECT p.level, p.root, sum(weight) AS size, sum(weight) >= {min_size} AS big
    FROM placed p JOIN entered USING (level, point) GROUP BY ALL
), tree AS (
    SELECT c.*, p.root AS parent, width FROM parts_of c JOIN ladder USING (level)
    LEFT JOIN placed p ON p.level = c.level + 1 AND p.point = c.root
), sums_0 AS (
    SELECT *, CASE WHEN big THEN size * width ELSE 0 END AS own,
           CASE WHEN big THEN size * width ELSE 0 END AS best, big AS chosen FROM tree WHERE level = 0
)"""
    for at in range(1, len(levels)):
        sql += f""", inner_{at} AS (
    SELECT parent AS root, sum(own) AS own, sum(best) AS best, count(*) FILTER (WHERE big) AS parts
    FROM sums_{at - 1} GROUP BY parent
), owned_{at} AS (
    SELECT t.*, CASE WHEN big THEN size * width + CASE WHEN parts = 1 THEN i.own ELSE 0 END ELSE 0 END AS own,
           coalesce(i.best, 0) AS inner_best
    FROM tree t LEFT JOIN inner_{at} i ON i.root = t.root WHERE level = {at}
), sums_{at} AS (
    SELECT * EXCLUDE (inner_best), greatest(own, inner_best) AS best,
           big AND round(own, 6) >= round(inner_best, 6) AS chosen FROM owned_{at}
)"""
    every = " UNION ALL BY NAME ".join(f"SELECT * FROM sums_{at}" for at in range(len(levels)))
    return sql + f""", every AS ({every}
), best_of AS (
    SELECT point, arg_max(p.root, p.level) AS root
    FROM placed p JOIN every USING (level, root) WHERE chosen GROUP BY point
), numbers AS (
    SELECT root, row_number() OVER (ORDER BY CAST('0x' || substr(md5(root::VARCHAR), 1, 13) AS BIGINT)) - 1 AS cluster
    FROM (SELECT DISTINCT root FROM best_of)
), found AS (
    SELECT {id}, cluster FROM {vectors_} JOIN named USING (v) JOIN best_of USING (point) JOIN numbers USING (root)
)
"""


@query("density_clusters", DRAWN_SQL + near_sql("drawn", "vec_id", 0.5)
       + hierarchy_sql("vec_id", "drawn", 8, 8) + """
SELECT vec_id, coalesce(cluster, -1) AS cluster FROM embeddings LEFT JOIN found USING (vec_id)""")
def density_clusters(spark, folder):
    found = hierarchy.density_clusters(drawn(spark, folder), 64, "vec_id", min_pts=8, min_cluster_size=8,
                                       representatives=neighbors.BUCKET)
    return as_bigint(found, "cluster")


DOCUMENT_POINTS_SQL = HASHED_SQL.replace("WITH words", "WITH RECURSIVE words") + """, lists AS (
    SELECT doc_id, list(value ORDER BY pos) AS v FROM hashed GROUP BY doc_id)
""" + near_sql("lists", "doc_id", 0.5, whole=True) + hierarchy_sql("doc_id", "lists", 10, 10)


@query("document_clusters", DOCUMENT_POINTS_SQL + """
SELECT doc_id, coalesce(cluster, -1) AS cluster FROM documents LEFT JOIN found USING (doc_id)""")
def document_clusters(spark, folder):
    """Documents by their words: cleaned, encoded, clustered."""
    encoded = document_words(spark, folder).select(
        "doc_id", vectors.hashed_embedding(F.col("text_clean")).alias("embedding")
    )
    found = hierarchy.density_clusters(encoded, 64, "doc_id", min_pts=10, min_cluster_size=10)
    return as_bigint(found, "cluster")
