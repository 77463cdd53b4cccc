"""Post vectors: encoding, checks, repair and reduction."""

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from postloom import fixed_values as V
from postloom.functions.hashing import md5_uint
from postloom.functions.vectors import is_finite, let
from postloom.operators.models import loaded, model_key

HASHED_DIMS = 64


def encoder_input(text):
    """A missing text is encoded as an empty one."""
    return F.coalesce(text, F.lit(""))


def hashed_embedding(text, dims=HASHED_DIMS):
    """Signed hashed bag of words of a blank-separated text, as array<float>.

    The first eight hex digits of a word's md5 choose the component, the ninth
    the sign.  Each row is encoded on its own: nothing is exploded or shuffled.
    """
    tokens = F.filter(F.split(encoder_input(text), " "), lambda word: word != "")

    def code(number):
        bucket = (F.shiftright(number, 4) % dims).cast("int")
        return bucket * 2 + F.when(number.bitwiseAND(F.lit(15)) < 8, 0).otherwise(1)

    def runs(ordered):
        """How often each code occurs, from the codes in order."""
        starts = F.filter(
            F.transform(ordered, lambda x, i: F.when((i == 0) | (x != F.get(ordered, i - 1)), i)),
            lambda i: i.isNotNull(),
        )
        return let(starts, lambda at: F.map_from_entries(F.transform(at, lambda start, i: F.struct(
            F.get(ordered, start).alias("code"),
            (F.coalesce(F.get(at, i + 1), F.size(ordered)) - start).alias("uses")))))

    def uses(found, wanted):
        return F.coalesce(F.try_element_at(found, wanted), F.lit(0))

    codes = F.transform(F.transform(tokens, lambda word: md5_uint(word, 1, 9)), code)
    buckets = F.sequence(F.lit(0), F.lit(dims - 1))
    sums = let(
        F.sort_array(codes),
        lambda ordered: let(
            runs(ordered),
            lambda found: F.transform(
                buckets, lambda bucket: uses(found, bucket * 2) - uses(found, bucket * 2 + 1)
            ),
        ),
    )
    return sums.cast("array<float>")


def hashing_encoder(dims=HASHED_DIMS):
    """A maker of encoders that give the vectors of ``hashed_embedding``.

    Shows the protocol of ``encode_posts``: a maker without arguments, called
    in the worker, that returns a function from a list of texts to a matrix.
    """

    def make():
        import hashlib

        def encode(texts):
            matrix = np.zeros((len(texts), dims), dtype=np.float32)
            for row, text in enumerate(texts):
                for word in text.split(" "):
                    if word:
                        code = int(hashlib.md5(word.encode()).hexdigest()[:9], 16)
                        matrix[row, (code >> 4) % dims] += 1 if code % 16 < 8 else -1
            return matrix

        return encode

    return make


def unit_rows(matrix):
    """Rows at unit length; a row of zeros stays."""
    exact = matrix.astype(np.float64)
    norms = np.linalg.norm(exact, axis=1, keepdims=True)
    return (exact / np.where(norms > 0, norms, 1.0)).astype(np.float32)


def encode_posts(posts, make_encoder, text="text", unit_length=True, batch=V.ENCODER_BATCH,
                 repair=False, truncate_dim=None):
    """``posts`` with an ``embedding`` of their ``text`` by the user's encoder.

    ``make_encoder`` runs once per Python worker, when its first rows arrive, and
    serves its later tasks too; the encoder gets ``batch`` texts at a time.  With ``repair`` a vector
    that is not finite is encoded once more, and fails the job if it still is not.
    ``truncate_dim`` keeps the first components, before the length is made one.  Narrow ``posts`` to
    the columns you need first: Spark cannot prune columns through the call.
    """
    schema = StructType([*posts.schema, StructField("embedding", ArrayType(FloatType()))])

    key = model_key(make_encoder)
    held = max(1, V.ARROW_BATCH_ROWS // batch) * batch

    def encoded(encode, texts):
        parts = [
            np.asarray(encode(texts[i : i + batch]), dtype=np.float32)
            for i in range(0, len(texts), batch)
        ]
        return np.concatenate(parts)

    def vectors_of(texts):
        encode = loaded(key, make_encoder)
        vectors = encoded(encode, texts)
        bad = np.flatnonzero(~np.isfinite(vectors).all(axis=1)) if repair else []
        if len(bad):
            vectors[bad] = encoded(encode, [texts[i] for i in bad])
            if not np.isfinite(vectors[bad]).all():
                raise ValueError("a vector is not finite after repair")
        if truncate_dim:
            vectors = vectors[:, :truncate_dim]
        return unit_rows(vectors) if unit_length else vectors

    def encode_task(batches):
        for whole in batches:
            # The texts of a whole batch as Python strings would take many times their bytes.
            for first in range(0, whole.num_rows, held):
                part = whole.slice(first, held)
                found = vectors_of(part.column(text).cast(pa.string()).fill_null("").to_pylist())
                ends = pa.array(np.arange(len(found) + 1, dtype=np.int32) * found.shape[1])
                lists = pa.ListArray.from_arrays(ends, pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], [*part.schema.names, "embedding"])

    return posts.mapInArrow(encode_task, schema)


def bad_vectors(rows, vector="embedding"):
    """Rows whose vector is missing or has a component that is not a finite number."""
    return rows.where(~F.coalesce(is_finite(F.col(vector)), F.lit(False)))


def repair_vectors(rows, make_encoder, text="text", vector="embedding", **options):
    """Encode the texts of bad vectors once more; a vector still bad fails the job."""
    sound = F.coalesce(is_finite(F.col(vector)), F.lit(False))
    again = encode_posts(rows.where(~sound).drop(vector), make_encoder, text, **options)
    again = again.withColumnRenamed("embedding", vector).select(*rows.columns)
    checked = F.when(sound, F.col(vector)).otherwise(
        F.raise_error(F.lit("a vector is not finite after repair"))
    )
    return rows.where(sound).unionByName(again.withColumn(vector, checked))


def reduction_model(rows, dims=V.REDUCED_DIM, vector="embedding"):
    """Principal components of the vectors.

    The rows stay distributed; what reaches the driver is one matrix of the
    vector's own width, whatever the number of rows.
    """
    pca = PCA(k=dims, inputCol="_vector", outputCol="_reduced")
    return pca.fit(rows.select(array_to_vector(vector).alias("_vector")))


def component_signs(model):
    """+1 or -1 per component, so that its largest loading becomes positive."""
    loadings = model.pc.toArray()
    largest = np.abs(loadings).argmax(axis=0)
    return [1.0 if loadings[i, j] >= 0 else -1.0 for j, i in enumerate(largest)]


def reduce_dims(rows, dims=V.REDUCED_DIM, vector="embedding", name="reduced", model=None):
    """``rows`` with the vector in its ``dims`` principal components."""
    model = model or reduction_model(rows, dims, vector)
    signs = F.array(*[F.lit(sign) for sign in component_signs(model)])
    moved = model.transform(rows.withColumn("_vector", array_to_vector(vector)))
    turned = F.zip_with(vector_to_array("_reduced"), signs, lambda x, s: (x * s).cast("float"))
    return moved.withColumn(name, turned).drop("_vector", "_reduced")
