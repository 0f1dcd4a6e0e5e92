"""Embeddings, clustering and dataset distillation.

Vectors are ``array<float|double>`` columns; group means use Spark ML's ``Summarizer`` (JVM), or plain sums of the components
where there may be many groups.  Centres (K-means, nearest centre, distance matrices) are in ``clustering``.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import PCA, HashingTF, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recsuite.functions import lists as L
from recsuite.operators.clustering import assign_nearest, distance_matrix, kmeans, stored_centres  # noqa: F401
from recsuite.operators.common import as_list, dense_index, first_per_key, top_n_per_group
from recsuite.session import cut_lineage


def mean_vectors(df: DataFrame, group, vec: str, out: str = "vector", size: int | None = None, weight=None) -> DataFrame:
    """Element-wise mean vector per group (NULL vectors skipped).  With the vectors' ``size`` the components are summed
    as plain numbers, which Spark does in a hash table of fixed-width rows: many groups are neither sorted nor spilled as
    vectors.  Then a vector of another size or with a NULL component is an error, and a row counts ``weight`` (a column) times."""
    g = as_list(group)
    if size is not None:
        bad = F.raise_error(F.lit(f"{vec}: a vector without {size} components")).cast("array<double>")
        whole = (F.size(vec) == size) & ~F.exists(vec, lambda x: x.isNull())
        w = F.lit(1) if weight is None else F.col(weight)
        d = df.filter(F.col(vec).isNotNull()).select(*g, w.alias("_w"), F.when(whole, F.col(vec).cast("array<double>")).otherwise(bad).alias("_v"))
        sums = d.groupBy(*g).agg(F.sum("_w").alias("_n"), *[F.sum(F.get("_v", i) * F.col("_w")).alias(f"_s{i}") for i in range(size)])
        return sums.select(*g, F.array(*[F.col(f"_s{i}") / F.col("_n") for i in range(size)]).cast("array<double>").alias(out))
    if weight is not None:
        raise ValueError("weights need the vectors' size")
    d = df.filter(F.col(vec).isNotNull()).withColumn("_v", array_to_vector(F.transform(vec, lambda x: x.cast("double"))))
    return d.groupBy(*g).agg(Summarizer.mean(F.col("_v")).alias("_m")).select(*g, vector_to_array("_m").alias(out))


def user_vectors(history: DataFrame, vectors: DataFrame, user="user_id", item="item_id", vec="embedding",
                 out="user_vector") -> DataFrame:
    """A user's vector = mean of the vectors of the items in their history rows ``(user, item)``.  Rows of items
    without a vector go first; the others are counted per user and item and dealt by user while they are narrow, so where the
    vectors are few enough for a broadcast no vector is shuffled, and a user of many rows comes to one row per item."""
    size = vectors.agg(F.max(F.size(vec))).first()[0]  # one number
    known = history.select(user, item).join(vectors.filter(F.col(vec).isNotNull()).select(item), item, "left_semi")
    rows = known.groupBy(user, item).agg(F.count(F.lit(1)).alias("_rows")).repartition(user)
    return mean_vectors(rows.join(vectors.select(item, vec), item), user, vec, out, size=max(size or 0, 0), weight="_rows")


def dot_scores(pairs: DataFrame, users: DataFrame, items: DataFrame, user="user_id", item="item_id",
               user_vec="user_vector", item_vec="embedding", out="score") -> DataFrame:
    """M1: score = u . v for every (user, candidate) row (two joins, one in-row dot product)."""
    j = pairs.join(users.select(user, user_vec), user).join(items.select(item, item_vec), item)
    return j.withColumn(out, L.dot(user_vec, item_vec))


def medoids(assigned: DataFrame, key: str, cols=(), cluster="cluster") -> DataFrame:
    """M4: the member nearest to each centre (ties by key), with its columns; a min_by aggregate, so a large
    cluster is reduced map-side."""
    return first_per_key(assigned, cluster, ["dist", key], [key, "dist", *cols])


def select_per_cluster(assigned: DataFrame, key: str, topic: str, m: int, alpha: float, cluster="cluster") -> DataFrame:
    """M5: per cluster the m members with the smallest ``dist + alpha * |topic - mean topic of the cluster|``
    (euclidean; ``dist`` from ``assign_nearest`` is squared, so its root is used).  Both the members, which are read for
    the means and for the scores, and the few selected rows are written once, so neither is worked out for every use."""
    assigned = cut_lineage(assigned)
    tc = mean_vectors(assigned, cluster, topic, "_tc")
    j = assigned.join(tc, cluster)
    score = F.sqrt(F.col("dist")) + alpha * F.sqrt(L.sq_euclidean(topic, "_tc"))
    j = j.withColumn("_score", score)
    return cut_lineage(top_n_per_group(j, [cluster], [F.col("_score"), F.col(key)], m, salt_on=[key]).drop("_tc"))


def merge_histories(selected: DataFrame, history: DataFrame, key: str, hist: str, cluster="cluster",
                    rank="_rank") -> DataFrame:
    """M6: per cluster the concatenated histories of its selected members (in selection order), written back to
    each selected member."""
    j = selected.select(cluster, key, rank).join(history.select(key, hist), key)
    merged = j.groupBy(cluster).agg(F.array_sort(F.collect_list(F.struct(rank, hist))).alias("_l")) \
        .select(cluster, F.flatten(F.transform("_l", lambda e: e[hist])).alias("merged_history"))
    return selected.select(cluster, key).join(merged, cluster)


def distilled_sets(train: DataFrame, dev: DataFrame, kept: DataFrame, key: str, label="label", order=(),
                   index="index") -> tuple[DataFrame, DataFrame]:
    """M7: the distilled interaction sets of the ``kept`` users or items (``key`` names the column): their positive
    train rows, and all their dev rows whatever the label; each set gets a dense 0-based ``index`` under ``order``, which has
    to be a total order of the rows."""
    if not order:
        raise ValueError("the rows need an order to be numbered in")
    keys = kept.select(key).distinct()
    return tuple(dense_index(t.join(keys, key, "left_semi").select(*t.columns), list(order), index)
                 for t in (train.filter(F.col(label) > 0), dev))


def keep_items_in_histories(history: DataFrame, kept: DataFrame, user: str, hist: str, item: str) -> DataFrame:
    """M8: histories restricted to kept items (order kept; emptied -> [])."""
    from recsuite.operators.prep import keep_list_elements_in
    return keep_list_elements_in(history, hist, kept, item, user, empty_as_null=False)


def taste_sets(history: DataFrame, items: DataFrame, user: str, hist: str, item: str, attr: str) -> DataFrame:
    """M8: per user the set of attribute values (e.g. categories or clusters) of their history items."""
    return history.select(user, F.explode(hist).alias(item)).join(items.select(item, attr), item) \
        .groupBy(user).agg(F.sort_array(F.collect_set(attr)).alias("taste"))


def pca(df: DataFrame, vec: str, k: int, out="pca") -> DataFrame:
    """M9: centre the vectors (StandardScaler withMean, withStd=False) then project on k principal components
    (signs are arbitrary, as in any PCA)."""
    d = df.withColumn("_v", array_to_vector(F.transform(vec, lambda x: x.cast("double"))))
    sc = StandardScaler(inputCol="_v", outputCol="_c", withMean=True, withStd=False).fit(d)
    c = sc.transform(d)
    p = PCA(k=k, inputCol="_c", outputCol="_p").fit(c)
    return p.transform(c).withColumn(out, vector_to_array("_p")).drop("_v", "_c", "_p")


PAGE_BYTES = 1 << 20   # text of one call of a model
PAGE_ROWS = 256

_MODELS: dict = {}


def _model(factory):
    """One model per worker and factory (known by its pickled form, which holds whatever it was configured with)."""
    from pyspark import cloudpickle

    k = cloudpickle.dumps(factory)
    if k not in _MODELS:
        _MODELS[k] = factory()
    return _MODELS[k]


def embed_texts(df: DataFrame, col: str, dim: int = 64, model_factory=None, out="text_vector", page_bytes: int = PAGE_BYTES,
                page_rows: int = PAGE_ROWS) -> DataFrame:
    """Batch text embedding.  ``model_factory()`` gives a model, a callable (list of texts) -> list of vectors; it is made once
    per Python worker, and called with pages of at most ``page_rows`` texts and ``page_bytes`` of UTF-8 (a longer text is
    a page of its own).  NULL texts have a NULL vector and are not shown to the model.  The default is Spark ML's
    ``HashingTF`` over word tokens (JVM-side, runs offline)."""
    from recsuite.operators.vocab import word_tokens
    if model_factory is None:
        d = df.withColumn("_w", word_tokens(col))
        tf = HashingTF(inputCol="_w", outputCol="_tf", numFeatures=dim)
        return tf.transform(d).withColumn(out, vector_to_array("_tf").cast("array<float>")).drop("_w", "_tf")
    names = [c for c in df.columns if c != out]
    at = names.index(col)
    src = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in src.schema)

    def run(batches):
        model = _model(model_factory)
        for b in batches:
            vectors = [None] * b.num_rows
            for page in _pages(b.column(at), page_bytes, page_rows):
                got = model([b.column(at)[i].as_py() for i in page])
                if len(got) != len(page):
                    raise ValueError(f"the model gave {len(got)} vectors for {len(page)} texts")
                for i, v in zip(page, got):
                    vectors[i] = [float(x) for x in v]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(vectors, pa.list_(pa.float32()))], names=[*b.schema.names, "v"])

    res = src.mapInArrow(run, f"{fields}, v array<float>")
    return res.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], F.col("v").alias(out))


def _pages(texts, page_bytes: int, page_rows: int):
    """Row numbers of the texts that are not NULL, page by page."""
    sizes = pc.fill_null(pc.binary_length(texts), -1).to_pylist()
    page, held = [], 0
    for i, size in enumerate(sizes):
        if size < 0:
            continue
        if page and (held + size > page_bytes or len(page) == page_rows):
            yield page
            page, held = [], 0
        page.append(i)
        held += size
    if page:
        yield page


def embedding_table(df: DataFrame, key: str, col: str, path: str, out="text_vector", **options) -> DataFrame:
    """The vector table (key, vector) of ``embed_texts``, written once; every later use reads it, so no text is embedded
    twice however many joins follow."""
    embed_texts(df.select(key, col), col, out=out, **options).select(key, out).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
