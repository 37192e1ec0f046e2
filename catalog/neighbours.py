"""Exact neighbours of the test vectors, whole table against whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.base import query, table
from timetab.operators.neighbours import (
    FEISTEL_PRIME, candidate_step, context_misses, distinct_neighbours, feistel_keys, nearest, neighbour_mean, permuted_step, with_candidates,
)
from timetab.operators.ordering import global_position
from timetab.session import materialise

K = 10


def _sql(condition: str = "TRUE", k: int = K) -> str:
    """Neighbours by comparing all pairs."""
    return f"""
        v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings),
        pairs AS (
            SELECT q.vec_id AS query_id, c.vec_id AS candidate_id, pow(list_distance(q.e, c.e), 2) AS distance, c.label
            FROM v q, v c WHERE {condition}
        ),
        ranked AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, candidate_id) AS rank FROM pairs
        ),
        nn AS (SELECT * FROM ranked WHERE rank <= {k})
    """


_COLUMNS = "query_id, candidate_id, round(distance, 8) AS distance, rank::BIGINT AS rank"


def _shown(pairs: DataFrame) -> DataFrame:
    return pairs.select("query_id", "candidate_id", F.round("distance", 8).alias("distance"), F.col("rank").cast("bigint").alias("rank"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


@query(f"WITH {_sql('q.label < 5 AND c.label >= 5')} SELECT {_COLUMNS} FROM nn")
def neighbours_across(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest vectors of the upper labels for every vector of the lower ones: two disjoint tables."""
    v = _vectors(spark, sf_dir)
    return _shown(nearest(v.where("label < 5"), v.where("label >= 5"), K))


@query(f"WITH {_sql()} SELECT {_COLUMNS} FROM nn")
def neighbours_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest vectors of every vector, itself among them."""
    v = _vectors(spark, sf_dir)
    return _shown(nearest(v, v, K))


@query(f"WITH {_sql('q.vec_id <> c.vec_id')} SELECT {_COLUMNS} FROM nn")
def neighbours_without_self(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest other vectors of every vector."""
    v = _vectors(spark, sf_dir)
    return _shown(nearest(v, v, K, exclude_self=True))


_CAUSAL = "q.vec_id <> c.vec_id AND c.vec_id <= q.vec_id"


def _causal(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    v = _vectors(spark, sf_dir)
    return v, nearest(v, v, K, time="vec_id", exclude_self=True)


@query(f"WITH {_sql(_CAUSAL)} SELECT {_COLUMNS} FROM nn")
def neighbours_causal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest vectors that are not newer than the query, the id taken as time."""
    return _shown(_causal(spark, sf_dir)[1])


@query(f"""
    WITH {_sql(_CAUSAL)}
    SELECT vec_id AS query_id, greatest(0, {K} - count(candidate_id))::BIGINT AS misses
    FROM embeddings LEFT JOIN nn ON vec_id = query_id GROUP BY vec_id
""")
def neighbour_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the wanted neighbours the oldest vectors lack."""
    v, pairs = _causal(spark, sf_dir)
    return context_misses(v, pairs, K)


@query(f"""
    WITH {_sql('q.vec_id <> c.vec_id')}, w AS (SELECT *, exp(-(distance - min(distance) OVER (PARTITION BY query_id))) AS w FROM nn)
    SELECT query_id, round(sum(w * label) / sum(w), 6) AS y_mean, max(w) AS top_weight FROM w GROUP BY query_id
""")
def neighbour_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label mean over the neighbours, weighted by softmax of the negative squared distance."""
    v = _vectors(spark, sf_dir)
    pairs = nearest(v, v, K, exclude_self=True)
    return neighbour_mean(pairs, v, "label").select("query_id", F.round("y_mean", 6).alias("y_mean"), "top_weight")


@query(f"""
    WITH {_sql('q.vec_id <> c.vec_id')}
    SELECT candidate_id, any_value(label)::BIGINT AS label, count(*) AS n_queries FROM nn GROUP BY candidate_id
""")
def neighbours_reused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stored neighbour table used twice: for the distinct neighbours, and to look up their labels."""
    v = _vectors(spark, sf_dir)
    pairs = nearest(v, v, K, exclude_self=True)
    labels = with_candidates(pairs, v, ["label"]).groupBy("candidate_id").agg(F.any_value("label").cast("bigint").alias("label"))
    return distinct_neighbours(pairs).join(labels, "candidate_id").select("candidate_id", "label", "n_queries")


@query("""
    WITH n AS (SELECT count(*) AS n, floor(0.3 * count(*))::BIGINT AS size FROM embeddings),
    seq AS (
        SELECT turn, vec_id, turn * n + row_number() OVER (PARTITION BY turn ORDER BY substr(md5('0/' || turn || '|' || vec_id), 1, 15), vec_id) - 1 AS place
        FROM embeddings, n, range(2) r(turn)
    )
    SELECT vec_id, turn::BIGINT AS "pass" FROM seq, n WHERE place >= 3 * size AND place < 4 * size
""")
def candidates_of_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidates of the fourth step with three tenths of the rows each: it ends in the second permutation."""
    return candidate_step(_vectors(spark, sf_dir), "vec_id", 0.3, 3).select("vec_id", F.col("pass").cast("bigint").alias("pass"))


def _permuted_sql(turns: int, walks: int) -> str:
    """Places of all rows in the first permutations, step by step: the rounds of each, and the walk back inside."""
    tables, last = [], "start"
    for walk in range(walks):
        for i in range(len(feistel_keys(0, 0))):
            p, q = (f"CASE turn {' '.join(f'WHEN {t} THEN {feistel_keys(0, t)[i][side]}' for t in range(turns))} END" for side in (0, 1))
            moved, still, base = ("high", "low", "a") if i % 2 == 0 else ("low", "high", "b")
            new = f"({moved} + (({still} + {p}) * ({still} + {q})) % {FEISTEL_PRIME}) % {base}"
            both = f"CASE WHEN inside THEN {moved} ELSE {new} END AS {moved}, {still}"
            tables.append(f"w{walk}_{i} AS (SELECT vec_id, turn, n, a, b, inside, {both} FROM {last})")
            last = f"w{walk}_{i}"
        tables.append(f"w{walk} AS (SELECT vec_id, turn, n, a, b, high, low, high * b + low < n AS inside FROM {last})")
        last = f"w{walk}"
    return f"""
        sizes AS (SELECT count(*) AS n, ceil(sqrt(count(*)))::BIGINT AS a, ceil(count(*) / ceil(sqrt(count(*))))::BIGINT AS b FROM embeddings),
        start AS (
            SELECT vec_id, turn, n, a, b, false AS inside, place // b AS high, place % b AS low
            FROM (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS place FROM embeddings), sizes, range({turns}) r(turn)
        ),
        {", ".join(tables)}, seq AS (SELECT vec_id, turn, n, floor(0.3 * n)::BIGINT AS size, turn * n + high * b + low AS place FROM {last})
    """


@query(f"""
    WITH {_permuted_sql(2, 8)} SELECT vec_id, turn::BIGINT AS "pass" FROM seq WHERE place >= 3 * size AND place < 4 * size
""")
def candidates_by_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same step from a keyed permutation of places: no search, each row knows its place by arithmetic."""
    placed = materialise(global_position(_vectors(spark, sf_dir).select("vec_id"), ["vec_id"], "place"), "placed")
    n = placed.count()
    return permuted_step(placed, n, int(0.3 * n), 3).select("vec_id", F.col("pass").cast("bigint").alias("pass"))
