"""Registered queries of the association and annotation operators, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traitscan.functions import arrays as A
from traitscan.functions import density
from traitscan.functions.stats import log10_f_p, normal_cdf
from traitscan.operators import annotate, assoc, blocks, interval, matrix, ordered, profile, sva
from traitscan.operators.fdr import log10_fdr
from traitscan.plans import annotation
from traitscan.tables import ranked

DIM = 64
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str, odd: int | None = None) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("values"))
    return v if odd is None else v.where(F.col("id") % 2 == odd)


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.select(*(F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in df.columns))


# ---------------------------------------------------------------- association

_CELLS = "e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings)"
_PAIRS = """r AS (SELECT x.vec_id AS x_id, y.vec_id AS y_id, corr(y.v, x.v) AS r, regr_slope(y.v, x.v) AS b
      FROM {e} x JOIN {e} y USING (i) WHERE x.vec_id % 2 = 0 AND y.vec_id % 2 = 1 GROUP BY ALL),
s AS (SELECT *, r * r AS r2, r * sqrt({dfe} / (1 - r * r)) AS t FROM r WHERE r * r >= {low})"""
_P = """p AS (SELECT s.*, {nu} / ({nu} + t * t) AS x FROM s),
q AS (SELECT x_id, y_id, r, b, r2, t, x, sum(exp(lgamma(({nu} + 1) / 2 + k) - lgamma(({nu} + 1) / 2) - lgamma({nu} / 2 + 1 + k) + lgamma({nu} / 2 + 1)) * x ** k) AS h
      FROM p, (SELECT unnest(generate_series(0, 1200))::DOUBLE AS k) GROUP BY ALL),
z AS (SELECT *, ({nu} / 2 * ln(x) + 0.5 * ln(1 - x) - ln({nu} / 2) - (lgamma({nu} / 2) + lgamma(0.5) - lgamma({nu} / 2 + 0.5)) + ln(h)) / ln(10) AS lp FROM q)"""
_OUT = "SELECT x_id, y_id, round(r2, 6) AS rsq, round(b, 6) AS fx, round(t, 5) AS t, round(lp, 5) AS log10p FROM z"


def _assoc_sql(dfe: float, low: float = 0.1, nu: float | None = None, cells: str = "", source: str = "e", out: str = _OUT) -> str:
    return f"WITH {_CELLS}, {cells}{_PAIRS.format(e=source, dfe=dfe, low=low)}, {_P.format(nu=f'{nu or dfe}')} {out}"


def _scan(spark: SparkSession, sf_dir: str, **more) -> DataFrame:  # noqa: ANN003
    return assoc.association(vectors(spark, sf_dir, 0), vectors(spark, sf_dir, 1), DIM, **({"threshold": ("rsq", 0.1)} | more))


def _tidy(pairs: DataFrame) -> DataFrame:
    return rounded(pairs, rsq=6, fx=6, t=5, log10p=5)


@query(_assoc_sql(62.0))
def assoc_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of even and odd vectors with R² of 0.1 or more."""
    return _tidy(_scan(spark, sf_dir))


@query(_assoc_sql(62.0, out="SELECT x_id, y_id, round(r2, 6) AS rsq, CASE WHEN b < 0 THEN '-' ELSE '+' END AS dir FROM z"))
def assoc_rsq_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(assoc.pair_layout(_scan(spark, sf_dir), "rsq_only"), rsq=6)


@query(_assoc_sql(62.0, out="SELECT round(lp, 5) AS log10p FROM z"))
def assoc_pval_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(assoc.pair_layout(_scan(spark, sf_dir), "pval_only"), log10p=5)


@query(_assoc_sql(62.0, low=0.05, out=_OUT + " WHERE lp <= -3"))
def assoc_threshold_pval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with p of 0.001 or less; the bound becomes one on R² before the scan."""
    return _tidy(_scan(spark, sf_dir, threshold=("pval", 1e-3)))


@query(_assoc_sql(62.0, nu=57.0))
def assoc_df_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tidy(_scan(spark, sf_dir, df_offset=5))


@query(_assoc_sql(62.0, out="SELECT x_id, y_id, floor(r2 * 1e4 + 0.5) / 1e4 AS rsq, floor(b * 1e4 + 0.5) / 1e4 AS fx, floor(t * 1e4 + 0.5) / 1e4 AS t, floor(lp * 1e4 + 0.5) / 1e4 AS log10p FROM z"))
def assoc_simplified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four decimals, halves towards plus infinity."""
    return assoc.pair_layout(_scan(spark, sf_dir), simplify=True)


_TREND = "m AS (SELECT vec_id, regr_slope(v, i) AS k, regr_intercept(v, i) AS c FROM e GROUP BY ALL), f AS (SELECT vec_id, i, v - c - k * i AS v FROM e JOIN m USING (vec_id)), "


@query(_assoc_sql(61.0, cells=_TREND, source="f"))
def assoc_covariate_adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjusted for one numeric covariate, the sample's number."""
    return _tidy(_scan(spark, sf_dir, design=assoc.design_matrix(DIM, {"i": list(range(1, DIM + 1))})))


_GROUPS = "m AS (SELECT vec_id, i % 4 AS g, avg(v) AS c FROM e GROUP BY ALL), f AS (SELECT e.vec_id, i, v - c AS v FROM e JOIN m ON e.vec_id = m.vec_id AND i % 4 = g), "


@query(_assoc_sql(59.0, cells=_GROUPS, source="f"))
def assoc_factor_adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjusted for a factor of four levels."""
    return _tidy(_scan(spark, sf_dir, design=assoc.design_matrix(DIM, factors={"g": [i % 4 for i in range(1, DIM + 1)]})))


@query(_assoc_sql(62.0, out="SELECT * EXCLUDE (k_), k_ AS rank FROM (SELECT x_id, y_id, round(r2, 6) AS rsq, row_number() OVER (PARTITION BY x_id ORDER BY r2 DESC, y_id) AS k_ FROM z) WHERE k_ <= 3"))
def top_k_per_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = assoc.top_k_per_feature(_scan(spark, sf_dir).select("x_id", "y_id", "rsq"), 3)
    return rounded(pairs.withColumn("rank", F.col("rank").cast("long")), rsq=6)


# ---------------------------------------------------------------- matrices


@query(f"WITH {_CELLS} SELECT vec_id AS i, (i - 1)::INT AS j, round((v - avg(v) OVER w) / stddev_samp(v) OVER w, 6) AS v FROM e WINDOW w AS (PARTITION BY vec_id)")
def standardize_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(matrix.standardized_cells(vectors(spark, sf_dir)), v=6)


@query(f"WITH {_CELLS} SELECT vec_id AS id, round(stddev_samp(v), 6) AS sd, round(sqrt(sum(v * v)), 6) AS norm, round(avg(v), 6) AS mean FROM e GROUP BY ALL")
def row_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return rounded(v.select("id", A.sd("values").alias("sd"), A.norm2("values").alias("norm"), A.mean("values").alias("mean")), sd=6, norm=6, mean=6)


@query(f"WITH {_CELLS} SELECT (i - 1)::INT AS j, round(sum(v), 6) AS col_sum, round(avg(v), 6) AS col_mean, round(sum(v * v), 6) AS col_ss FROM e GROUP BY ALL")
def column_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(matrix.column_statistics(vectors(spark, sf_dir)), col_sum=6, col_mean=6, col_ss=6)


@query(f"WITH {_CELLS} SELECT a.i - 1 AS i, b.i - 1 AS j, round(sum(a.v * b.v), 6) AS v FROM e a JOIN e b USING (vec_id) GROUP BY ALL")
def gram_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(matrix.gram(vectors(spark, sf_dir), DIM), v=6)


@query(f"WITH {_CELLS}, {_TREND}g AS (SELECT 1) SELECT vec_id AS i, (i - 1)::INT AS j, round(v, 6) AS v FROM f")
def residualize_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = assoc.orthonormal(assoc.design_matrix(DIM, {"i": list(range(1, DIM + 1))}))
    return rounded(matrix.to_long(matrix.times(vectors(spark, sf_dir), np.eye(DIM) - q @ q.T)), v=6)


@query(f"""WITH {_CELLS}, a AS (SELECT label, i, sum(v) AS v FROM e JOIN embeddings USING (vec_id) GROUP BY ALL)
SELECT x.label AS i, y.label AS j, round(sum(x.v * y.v), 5) AS v FROM a x JOIN a y USING (i) GROUP BY ALL""")
def multiply_transpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S S' of the label sums S."""
    e = table(spark, sf_dir, "embeddings").select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("j", "v"))
    s = e.groupBy(F.col("label").alias("i"), "j").agg(F.sum("v").alias("v"))
    return rounded(matrix.multiply(s, matrix.transpose(s)), v=5)


@query(f"""WITH {_CELLS}, m AS (SELECT i, avg(v) AS c FROM e GROUP BY ALL) SELECT round(sum((v - c) * (v - c)), 5) AS sse FROM e JOIN m USING (i)""")
def sse_to_column_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = matrix.to_long(vectors(spark, sf_dir))
    means = cells.groupBy("j").agg(F.avg("v").alias("v"))
    fitted = cells.select("i", "j").join(F.broadcast(means), "j").select("i", "j", "v")  # one row per column
    return rounded(matrix.sse(cells, fitted), sse=5)


@query(f"""WITH {_CELLS}, c AS (SELECT vec_id, i, CASE WHEN v < -0.45 THEN NULL ELSE v END AS v FROM e), bad AS (SELECT DISTINCT i FROM c WHERE v IS NULL)
SELECT vec_id AS i, (i - 1)::INT AS j, round(v, 6) AS v FROM c WHERE i NOT IN (SELECT i FROM bad)""")
def complete_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples with a missing value (here: one below -0.45) in any row go."""
    cells = matrix.to_long(vectors(spark, sf_dir)).withColumn("v", F.when(F.col("v") >= -0.45, F.col("v")))
    return rounded(matrix.complete_samples(cells), v=6)


@query()
def singular_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    values, _ = matrix.svd_rows(vectors(spark, sf_dir), DIM, DIM)
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "k int, value double")


_GRAM = f"{_CELLS}, g AS (SELECT x.i - 1 AS i, y.i - 1 AS j, sum(x.v * y.v) AS v FROM e x JOIN e y USING (vec_id) GROUP BY ALL)"


@query(f"""WITH {_GRAM} SELECT 1 AS power, round((SELECT sum(v) FROM g WHERE i = j), 3) AS moment
UNION ALL SELECT 2, round((SELECT sum(v * v) / 1000 FROM g), 3) UNION ALL SELECT 3, round((SELECT sum(x.v * y.v * z.v) / 1000000 FROM g x JOIN g y ON x.j = y.i JOIN g z ON y.j = z.i AND z.j = x.i), 3)""")
def singular_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of the second, fourth and sixth powers of the singular values: traces of powers of the Gram matrix."""
    s = singular_values(spark, sf_dir).select(F.pow("value", F.lit(2)).alias("v"))
    powers = s.select(F.posexplode(F.array(F.col("v"), F.col("v") ** 2 / 1000, F.col("v") ** 3 / 1e6)).alias("p", "v"))
    return rounded(powers.groupBy((F.col("p") + 1).alias("power")).agg(F.sum("v").alias("moment")), moment=3)


@query(f"WITH {_GRAM} SELECT i::BIGINT AS i, j::BIGINT AS j, round(v, 5) AS v FROM g")
def qr_triangle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R'R of the tree-reduced triangle of all vectors, which is their Gram matrix."""
    r = blocks.tall_r(vectors(spark, sf_dir), DIM)
    rows = spark.createDataFrame([(i, j, float(r[i, j])) for i in range(DIM) for j in range(i, DIM)], "i long, j long, v double")
    return rounded(matrix.multiply(matrix.transpose(rows), rows, 40), v=5)


@query("SELECT i, j, (i = j)::INT::DOUBLE AS v FROM (SELECT unnest(range(64)) AS i) JOIN (SELECT unnest(range(64)) AS j) ON true")
def qr_orthogonality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q'Q of the vectors' QR factorisation."""
    q = matrix.orthonormal_rows(vectors(spark, sf_dir), DIM)
    return matrix.gram(q, DIM).select("i", "j", (F.round("v", 8) + 0.0).alias("v"))


@query(f"WITH {_CELLS}, l AS (SELECT label, i, sum(v) AS v FROM e JOIN embeddings USING (vec_id) GROUP BY ALL) SELECT vec_id AS i, label::BIGINT AS j, round(sum(e.v * l.v), 5) AS v FROM e JOIN l USING (i) GROUP BY ALL")
def block_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X S' of all vectors and the sums S of their labels, in tiles of 50 cells."""
    cells = matrix.to_long(vectors(spark, sf_dir))
    sums = cells.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("i"), "label"), "i").groupBy(F.col("label").alias("i"), "j").agg(F.sum("v").alias("v"))
    return rounded(matrix.multiply(cells, matrix.transpose(sums), 50), v=5)


@query(f"""WITH {_CELLS}, n AS (SELECT x.i, y.i AS j, sum(x.v * y.v) AS v FROM e x JOIN e y ON y.vec_id = x.vec_id + 1 GROUP BY ALL), d AS (SELECT x.i, y.i AS j, sum(x.v * y.v) AS v FROM e x JOIN e y USING (vec_id) GROUP BY ALL)
SELECT (d.i - 1)::BIGINT AS i, (d.j - 1)::BIGINT AS j, round(2 * d.v - n.v - m.v, 4) AS v FROM d JOIN n ON n.i = d.i AND n.j = d.j JOIN n m ON m.i = d.j AND m.j = d.i""")
def quadratic_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X' A X with A the second differences of neighbouring vectors."""
    v = vectors(spark, sf_dir)
    near = v.select(F.explode(F.array(*(F.struct((F.col("id") + a).alias("i"), (F.col("id") + b).alias("j"), F.lit(float(x)).alias("v")) for a, b, x in ((0, 0, 2), (0, 1, -1), (1, 0, -1))))).alias("c")).select("c.*")
    near = near.join(v.select(F.col("id").alias("i")), "i").join(v.select(F.col("id").alias("j")), "j").select("i", "j", "v")
    return rounded(blocks.cells_of_tiles(blocks.quadratic_form(blocks.tiles_of_cells(matrix.to_long(v), 96), blocks.tiles_of_cells(near, 96)), 96), v=4)


@query(f"WITH {_CELLS} SELECT round(sum(v * v), 4) AS energy FROM e")
def singular_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sum of the squared singular values, which is that of all cells."""
    return rounded(singular_values(spark, sf_dir).agg(F.sum(F.col("value") * F.col("value")).alias("energy")), energy=4)


@query("SELECT vec_id AS id, 128 AS n, round(embedding[64]::DOUBLE, 6) AS v63, round(embedding[64]::DOUBLE, 6) AS v64, round(2 * list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings")
def bind_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector side by side with its reverse."""
    v = vectors(spark, sf_dir)
    out = matrix.bind_columns(v, v.select("id", F.reverse("values").alias("values"))).select("id", F.size("values").alias("n"), F.col("values")[63].alias("v63"), F.col("values")[64].alias("v64"), A.fsum("values").alias("total"))
    return rounded(out, v63=6, v64=6, total=6)


@query("SELECT vec_id AS id, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings")
def bind_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even and odd vectors one below the other."""
    out = matrix.bind_rows(vectors(spark, sf_dir, 0), vectors(spark, sf_dir, 1))
    return rounded(out.select("id", A.fsum("values").alias("total")), total=6)


def _hidden(i: int) -> int:
    """A factor over the dimensions that no design has."""
    return 1 if 7 * i % 11 < 5 else -1


def _surrogates(spark: SparkSession, sf_dir: str) -> np.ndarray:
    """Surrogate variables of all vectors, to which rows of the labels below 5 have the hidden factor added; permutations find how many."""
    moved = F.when(F.col("label") < 5, 0.1 * (F.col("vec_id") % 3 + 1)).otherwise(0.0)
    hidden = F.array(*(F.lit(float(_hidden(i))) for i in range(DIM)))
    values = F.transform(F.col("embedding").cast("array<double>"), lambda x, i: x + moved * F.get(hidden, i))
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), values.alias("values"))
    alt = assoc.design_matrix(DIM, factors={"g": [i % 4 for i in range(DIM)]})
    return sva.surrogate_variables(rows, alt, count=None, rounds=5)


@query()
def surrogate_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surrogate variables of all vectors, adjusted for a factor of four levels."""
    sv = _surrogates(spark, sf_dir)
    return spark.createDataFrame([(i, k, float(sv[i, k])) for i in range(DIM) for k in range(sv.shape[1])], "sample int, k int, value double")


@query("SELECT 1 AS first, 1.0::DOUBLE AS length, true AS found")
def surrogate_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first surrogate variable has length 1 and is the hidden factor, by a correlation above 0.9."""
    first = surrogate_variables(spark, sf_dir).where("k = 0").withColumn("h", F.element_at(F.array(*(F.lit(_hidden(i)) for i in range(DIM))), F.col("sample") + 1))
    return first.agg(F.lit(1).alias("first"), F.round(F.sum(F.col("value") ** 2), 6).alias("length"), (F.abs(F.corr("value", "h")) > 0.9).alias("found"))


_D = "list_dot_product(embedding::DOUBLE[], list_reverse(embedding::DOUBLE[]))"


@query(f"""SELECT vec_id AS id, round({_D}, 6) AS dot, round(2 * embedding[1]::DOUBLE + embedding[64]::DOUBLE, 6) AS axpy0,
round(list_sum(embedding::DOUBLE[]) ** 2, 6) AS kron_sum, round(embedding[63]::DOUBLE, 6) AS shifted0, round(list_sum(embedding[1:10]::DOUBLE[]), 6) AS running9, round(embedding[4]::DOUBLE, 6) AS permuted1
FROM embeddings""")
def vector_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("values")
    out = vectors(spark, sf_dir).select(
        "id", A.dot(v, F.reverse(v)).alias("dot"), A.axpy(2.0, v, F.reverse(v))[0].alias("axpy0"), A.fsum(A.kronecker(v, v)).alias("kron_sum"), A.shifted(v, 2)[0].alias("shifted0"),
        A.running_sum(F.slice(v, 1, 10))[9].alias("running9"), A.permuted(v, F.array(*map(F.lit, (7, -1, 3))))[1].alias("permuted1"),
    )
    return rounded(out, dot=6, axpy0=6, kron_sum=6, shifted0=6, running9=6, permuted1=6)


# ---------------------------------------------------------------- lookups, filters, projections


@query("""SELECT p_name AS part_name, p_brand AS part_brand, s_name AS supp_name, l_orderkey, l_linenumber, l_partkey, l_suppkey
FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size <= 25) ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey""")
def annotate_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with part and supplier sections; a miss is NULL."""
    main = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    part = table(spark, sf_dir, "part").where("p_size <= 25").select("p_partkey", "p_name", "p_brand")
    out = annotate.annotate(main, {"Part": (part, "p_partkey", "l_partkey"), "Supp": (table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), "s_suppkey", "l_suppkey")})
    return out.withColumnsRenamed({"Part.p_name": "part_name", "Part.p_brand": "part_brand", "Supp.s_name": "supp_name"})


@query("SELECT o_orderkey AS key, o_totalprice * 2 AS doubled, CASE WHEN o_totalprice > 100000 THEN 'high' ELSE 'low' END AS band FROM orders")
def annotate_computed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotate.project(table(spark, sf_dir, "orders"), ["o_orderkey", "doubled", "band"], {"o_orderkey": "key"}, {"doubled": "o_totalprice * 2", "band": "if(o_totalprice > 100000, 'high', 'low')"})


@query("SELECT l_partkey, arg_max(l_suppkey, l_orderkey * 10 + l_linenumber) AS l_suppkey FROM lineitem GROUP BY ALL")
def last_duplicate_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber")
    return annotate.last_per_key(rows, "l_partkey", ["l_orderkey", "l_linenumber"]).select("l_partkey", "l_suppkey")


@query("""WITH t AS (SELECT l_partkey, arg_max(l_suppkey, l_orderkey * 10 + l_linenumber) AS supp FROM lineitem WHERE l_quantity > 25 GROUP BY ALL)
SELECT p_partkey, supp FROM part LEFT JOIN t ON p_partkey = l_partkey""")
def translate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "lineitem").where("l_quantity > 25")
    return annotate.translate_ids(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey", pairs, "l_partkey", "l_suppkey", ["l_orderkey", "l_linenumber"], "supp")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_extendedprice * (1 - l_discount) / l_quantity > 900 AND l_quantity % 3 = 1 AND abs(l_tax - 0.04) < 0.03")
def filter_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    cond = "try_divide(l_extendedprice * (1 - l_discount), l_quantity) > 900 and l_quantity % 3 = 1 and abs(l_tax - 0.04) < 0.03"
    return annotate.filter_rows(table(spark, sf_dir, "lineitem"), cond).select("l_orderkey", "l_linenumber")


@query("SELECT p_partkey FROM part WHERE p_size ** 2 + sqrt(p_retailprice) > 500 AND floor(ln(p_retailprice)) = 6")
def filter_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotate.filter_rows(table(spark, sf_dir, "part"), "pow(p_size, 2) + sqrt(p_retailprice) > 500 and floor(ln(p_retailprice)) = 6").select("p_partkey")


@query("SELECT p_partkey FROM part WHERE (p_size & 6) = 4 AND (p_size | 1) > 20 AND xor(p_size, 3) <> 7 AND NOT (p_size = 30)")
def filter_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotate.filter_rows(table(spark, sf_dir, "part"), "(p_size & 6) = 4 and (p_size | 1) > 20 and (p_size ^ 3) <> 7 and not (p_size = 30)").select("p_partkey")


_MATH = ["sin", "cos", "tan", "atan", "sinh", "tanh", "exp", "log10", "cbrt", "sign", "ceil", "radians", "degrees"]


@query("SELECT p_partkey, " + ", ".join(f"round({f}(p_size / 10.0::DOUBLE)::DOUBLE, 6) AS {f}_" for f in _MATH) + ", round(atan2(p_size::DOUBLE, 7), 6) AS atan2_, round(sqrt(p_size * p_size + 9.0::DOUBLE), 6) AS hypot_ FROM part")
def math_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mathematical functions of the filter language."""
    x = F.col("p_size") / F.lit(10.0)
    more = [F.round(F.atan2(F.col("p_size").cast("double"), F.lit(7.0)), 6).alias("atan2_"), F.round(F.hypot(F.col("p_size").cast("double"), F.lit(3.0)), 6).alias("hypot_")]
    return table(spark, sf_dir, "part").select("p_partkey", *(F.round(getattr(F, {"sign": "signum"}.get(f, f))(x).cast("double"), 6).alias(f"{f}_") for f in _MATH), *more)


@query("SELECT p_partkey, round(p_size / 51.0::DOUBLE, 5) AS p, round(-p_size / 2.0::DOUBLE * log10(1 + 2 * (p_retailprice / 500) / p_size), 6) AS log10p FROM part")
def tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The normal distribution of probits, and the upper tail of F with two degrees of freedom above."""
    rows = table(spark, sf_dir, "part").select("p_partkey", density.probit(F.col("p_size") / 51.0).alias("x"), log10_f_p(F.col("p_retailprice") / 500, F.lit(2.0), F.col("p_size").cast("double")).alias("log10p"))
    return rounded(rows.select("p_partkey", normal_cdf(F.col("x")).alias("p"), "log10p"), p=5, log10p=6)


@query("""SELECT p_partkey, round(asin(p_size / 100.0::DOUBLE), 6) AS asin_, round(acos(p_size / 100.0::DOUBLE), 6) AS acos_, round(cosh(p_size / 10.0::DOUBLE), 5) AS cosh_, round(exp(p_size / 1000.0::DOUBLE) - 1, 8) AS expm1_,
round(ln(1 + p_size / 1000.0::DOUBLE), 8) AS log1p_, floor(p_size / 4.0 + 0.5)::BIGINT AS round_, abs(p_size - 25) AS abs_, TRY_CAST(substr(p_brand, 7) AS DOUBLE) AS parsed, p_brand || repeat('*', p_size % 3) AS padded FROM part""")
def math_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rest of the filter language's functions, and text read as numbers."""
    x = F.col("p_size")
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.round(F.asin(x / 100.0), 6).alias("asin_"), F.round(F.acos(x / 100.0), 6).alias("acos_"), F.round(F.cosh(x / 10.0), 5).alias("cosh_"), F.round(F.expm1(x / 1000.0), 8).alias("expm1_"),
        F.round(F.log1p(x / 1000.0), 8).alias("log1p_"), A.half_up(x / 4.0).alias("round_"), F.abs(x - 25).alias("abs_"), A.num(F.substr("p_brand", F.lit(7))).alias("parsed"), F.concat("p_brand", F.repeat(F.lit("*"), x % 3)).alias("padded"),
    )


@query("SELECT p_partkey, trim('  ' || p_name || ' ') AS trimmed, replace(p_type, 'E', '_') AS replaced, lower(p_brand) AS low, ends_with(p_type, 'L') AS ends FROM part")
def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "part")
    return t.select("p_partkey", A.trim_all(F.concat(F.lit("  "), "p_name", F.lit(" "))).alias("trimmed"), F.replace("p_type", F.lit("E"), F.lit("_")).alias("replaced"), F.lower("p_brand").alias("low"), F.col("p_type").endswith("L").alias("ends"))


@query("""SELECT c_custkey, upper(substr(c_name, 1, 4)) AS head, instr(c_name, '#') - 1 AS at, length(c_name) - instr(reverse(c_name), '0') AS last_zero, regexp_replace(c_name, '0+', '_') AS first_run
FROM customer WHERE c_mktsegment LIKE '%U%' AND starts_with(c_name, 'Customer')""")
def filter_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = annotate.filter_rows(table(spark, sf_dir, "customer"), F.col("c_mktsegment").contains("U") & F.col("c_name").startswith("Customer"))
    return rows.select("c_custkey", F.upper(F.substring("c_name", 1, 4)).alias("head"), A.index_of("c_name", "#").cast("long").alias("at"), A.last_index_of("c_name", "0").cast("long").alias("last_zero"), A.replace_first("c_name", "0+", "_").alias("first_run"))


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') AND o_orderstatus IN ('O', 'P')")
def filter_in_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotate.filter_rows(table(spark, sf_dir, "orders"), F.col("o_orderpriority").isin("1-URGENT", "5-LOW") & F.col("o_orderstatus").isin("O", "P")).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) OR o_totalprice > 300000")
def filter_in_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membership in another table's column, inside an OR."""
    poor = table(spark, sf_dir, "customer").where("c_acctbal < 0")
    return annotate.in_table(table(spark, sf_dir, "orders"), "o_custkey", poor, "c_custkey", "hit").where("hit or o_totalprice > 300000").select("o_orderkey")


@query("SELECT p_partkey FROM part WHERE len(list_intersect(string_split(p_name, ' '), string_split(p_type, ' '))) > 0 OR len(list_intersect(string_split(lower(p_type), ' '), ['steel', 'tin'])) > 0")
def filter_split_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return annotate.filter_rows(p, A.split_overlap("p_name", "p_type", " ") | A.split_overlap(F.lower("p_type"), F.lit("steel tin"), " ")).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE regexp_full_match(p_brand, 'Brand#[1-3][0-9]*')")
def filter_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotate.filter_rows(table(spark, sf_dir, "part"), A.full_match("p_brand", "Brand#[1-3][0-9]*")).select("p_partkey")


@query("SELECT count(*) AS n_rows FROM events WHERE value > 10 AND event_type <> 'view'")
def filter_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotate.filter_count(table(spark, sf_dir, "events"), "value > 10 and event_type <> 'view'")


@query("SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' OR o_orderpriority = '5-LOW') AND o_totalprice > 150000")
def filter_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a || b && c reads from left to right."""
    a, b, c = F.col("o_orderstatus") == "F", F.col("o_orderpriority") == "5-LOW", F.col("o_totalprice") > 150000
    return annotate.filter_rows(table(spark, sf_dir, "orders"), A.equal_precedence(a, ("or", b), ("and", c))).select("o_orderkey")


@query("SELECT l_orderkey, l_linenumber, coalesce(list_position([4, 1, 6, 30, 2, 7], l_linenumber), 0) - 1 AS m0, coalesce(list_position([4, 1, 6, 30, 2, 7], (l_quantity % 10)::INT), 0) - 1 AS m1 FROM lineitem")
def match_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of two values in a list; a miss is -1."""
    rows = table(spark, sf_dir, "lineitem")
    m = A.match(F.array("l_linenumber", (F.col("l_quantity") % 10).cast("int")), F.array(*map(F.lit, (4, 1, 6, 30, 2, 7))))
    return rows.select("l_orderkey", "l_linenumber", m.alias("m")).select("l_orderkey", "l_linenumber", F.col("m")[0].alias("m0"), F.col("m")[1].alias("m1"))


@query("SELECT c_custkey, array_to_string(list_transform(regexp_extract_all(c_name, '[0-9]+|[^0-9]+'), lambda p: CASE WHEN regexp_matches(p, '^[0-9]') THEN lpad(regexp_replace(p, '^0+([0-9])', '\\1'), 20, '0') ELSE p END), '') AS key FROM customer")
def natural_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", A.natural_key("c_name").alias("key"))


@query("""WITH n AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN upper(p_brand) ELSE lower(p_brand) END AS brand, p_size FROM part)
SELECT min(p_partkey) AS first, count(*) AS n_parts, dense_rank() OVER (ORDER BY regexp_replace(lower(brand), '[0-9]+$', ''), regexp_extract(brand, '[0-9]+$')::BIGINT, p_size) AS place FROM n GROUP BY lower(brand), regexp_extract(brand, '[0-9]+$'), p_size, regexp_replace(lower(brand), '[0-9]+$', '')""")
def natural_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by brand and size written in mixed case and with leading zeros, grouped and ordered naturally under a collation."""
    case = F.when(F.col("p_partkey") % 2 == 0, F.upper("p_brand")).otherwise(F.lower("p_brand"))
    name = F.concat(case, F.lit(" "), F.when(F.col("p_partkey") % 3 == 0, "00").otherwise(""), F.col("p_size"))
    key = A.natural_order(name, "UNICODE_CI_AI")
    groups = table(spark, sf_dir, "part").groupBy(key.alias("k")).agg(F.min("p_partkey").alias("first"), F.count(F.lit(1)).alias("n_parts"))
    return ranked(groups, ["k"], "place").select("first", "n_parts", (F.col("place") + 1).alias("place"))


@query("SELECT l_orderkey, l_linenumber, ~l_partkey AS turned, l_partkey << l_linenumber AS up, l_partkey >> 2 AS down, -l_partkey >> 3 AS down_negative FROM lineitem")
def bit_shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("l_partkey")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", A.complement(p).alias("turned"), A.shifted_bits(p, F.col("l_linenumber")).alias("up"), A.shifted_bits(p, -2).alias("down"), A.shifted_bits(-p, -3).alias("down_negative"))


@query("SELECT p_brand, string_agg(DISTINCT p_size::VARCHAR, '|' ORDER BY p_size::VARCHAR) AS sizes, count(DISTINCT p_type) AS n_types, count(*) AS n_parts FROM part GROUP BY ALL")
def multimap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands with the set of their sizes, as annotation files list them."""
    sizes = F.array_join(F.sort_array(F.collect_set(F.col("p_size").cast("string"))), "|")
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(sizes.alias("sizes"), F.size(F.collect_set("p_type")).cast("long").alias("n_types"), F.count(F.lit(1)).alias("n_parts"))


ANNOTATION = """
[Orders]
file = orders
file_format = parquet
columns_kept = o_orderkey, o_custkey, o_orderstatus, o_totalprice
columns_rename = Order, Customer, Status, Price
Status = lower(Status)
Old = if(Customer % 2 = 0, 'even', 'odd')

[Parts]
file = part
file_format = parquet
columns_kept = p_partkey, p_brand, p_size
p_partkey = if(p_size > 40, null, p_partkey)

[Unlinked]
file = never_read

[Main]
input = lineitem
output = nowhere
file_format = parquet
matching_rule = Orders.Order == Main.l_orderkey, Main.l_partkey == Parts.p_partkey
Share = round(l_extendedprice / Orders.Price, 6)
Main.l_returnflag = concat(l_returnflag, coalesce(Parts.p_brand, '-'))
column_order = l_orderkey, Main.l_linenumber, Customer, Status, Old, p_brand, p_size, Share, l_returnflag
new_header = order_id, line, customer, status, parity, brand, size, share, flag
"""


@query("""SELECT l_orderkey AS order_id, l_linenumber AS line, o_custkey AS customer, lower(o_orderstatus) AS status, CASE WHEN o_custkey % 2 = 0 THEN 'even' WHEN o_custkey IS NOT NULL THEN 'odd' END AS parity,
p_brand AS brand, p_size AS size, round(l_extendedprice / o_totalprice, 6) AS share, l_returnflag || coalesce(p_brand, '-') AS flag
FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey LEFT JOIN (SELECT * FROM part WHERE p_size <= 40) ON p_partkey = l_partkey""")
def annotation_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of an order annotated by a configuration with two linked sections."""
    return annotation.annotated(annotation.parse_plan(ANNOTATION), lambda name, _: table(spark, sf_dir, name))


# ---------------------------------------------------------------- intervals

_DAY = "date_diff('day', DATE '1970-01-01', {}::DATE)"
_POINTS = f"p AS (SELECT o_orderkey AS id, o_custkey % 22 AS chr, {_DAY.format('o_orderdate')} AS pos FROM orders)"
_SITES = f"s AS (SELECT l_orderkey AS site, l_linenumber AS line, l_partkey % 22 AS chr, {_DAY.format('l_shipdate')} AS site_pos FROM lineitem)"


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.unix_date(F.to_date("o_orderdate")).cast("long")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 22).alias("chr"), day.alias("pos"))


def _sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.unix_date(F.to_date("l_shipdate")).cast("long")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("site"), F.col("l_linenumber").alias("line"), (F.col("l_partkey") % 22).alias("chr"), day.alias("site_pos"))


@query(f"WITH {_POINTS}, {_SITES} SELECT id, string_agg(DISTINCT line::VARCHAR, ',' ORDER BY line::VARCHAR) AS lines FROM p JOIN s ON p.chr = s.chr AND pos BETWEEN site_pos - 1 AND site_pos GROUP BY id")
def interval_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every order the line numbers of all intervals that hold its date, without repeats."""
    spans = _sites(spark, sf_dir).select("chr", F.col("line").cast("string").alias("lines"), (F.col("site_pos") - 1).alias("start"), F.col("site_pos").alias("end"))
    return interval.stab_payloads(_points(spark, sf_dir), spans, 7, "lines", by=["id"]).select("id", F.when(F.size("lines") > 0, F.array_join("lines", ",")).alias("lines"))


@query(f"WITH {_POINTS}, {_SITES} SELECT id, site, line FROM p JOIN s ON p.chr = s.chr AND pos BETWEEN site_pos - 1 AND site_pos + line % 3")
def interval_stab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points inside closed intervals of one to four days around every site."""
    spans = _sites(spark, sf_dir).select("chr", "site", "line", (F.col("site_pos") - 1).alias("start"), (F.col("site_pos") + F.col("line") % 3).alias("end"))
    return interval.stab_join(_points(spark, sf_dir), spans, 7).select("id", "site", "line")


@query(f"WITH {_POINTS}, {_SITES} SELECT id, site, line, pos - site_pos AS distance FROM p JOIN s ON p.chr = s.chr AND pos BETWEEN greatest(0, site_pos - 1) AND site_pos + 1")
def cis_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interval.cis_window(_points(spark, sf_dir), _sites(spark, sf_dir), 1).select("id", "site", "line", "distance")


@query(f"WITH {_POINTS}, {_SITES} SELECT id, count(site) FILTER (abs(pos - site_pos) > 300) AS n_long_cis FROM p LEFT JOIN s ON p.chr = s.chr GROUP BY ALL")
def long_cis_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interval.long_cis_counts(_points(spark, sf_dir), _sites(spark, sf_dir), 300).select("id", "n_long_cis")


@query(f"WITH {_POINTS}, {_SITES} SELECT id, site, line FROM p JOIN s ON p.chr = s.chr AND pos <= site_pos + line % 3 AND site_pos <= pos + 1")
def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _points(spark, sf_dir).select("chr", "id", F.col("pos").alias("a_start"), (F.col("pos") + 1).alias("a_end"))
    b = _sites(spark, sf_dir).select("chr", "site", "line", F.col("site_pos").alias("b_start"), (F.col("site_pos") + F.col("line") % 3).alias("b_end"))
    return interval.overlap_join(a, b, 10).select("id", "site", "line")


@query(f"""WITH {_POINTS}, {_SITES} SELECT p.id, count(*) AS n_spans, min(site_pos) AS first, sum(line) AS lines FROM p JOIN s ON p.chr = s.chr AND p.id % 100 = s.site % 100
AND pos BETWEEN site_pos - CASE WHEN line = 1 THEN 900000000 ELSE 1 << line::INT END AND site_pos GROUP BY ALL""")
def interval_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of four days to 900,000,000 that hold a point, one level of bins for each length."""
    reach = F.when(F.col("line") == 1, F.lit(900_000_000)).otherwise(F.expr("shiftleft(1L, line)"))
    spans = _sites(spark, sf_dir).select("chr", (F.col("site") % 100).alias("tag"), "line", "site_pos", (F.col("site_pos") - reach).alias("start"), F.col("site_pos").alias("end"))
    points = _points(spark, sf_dir).withColumn("tag", F.col("id") % 100)
    totals = {"n_spans": ("sum", F.lit(1)), "first": ("min", F.col("site_pos")), "lines": ("sum", F.col("line"))}
    hits = points.join(interval.stab_totals(points, spans, totals, ["chr", "tag"]), ["chr", "tag", "pos"])
    return hits.groupBy("id").agg(F.sum("n_spans").alias("n_spans"), F.min("first").alias("first"), F.sum("lines").alias("lines"))


# ---------------------------------------------------------------- order, ranks, rates

_FDR = """WITH r AS (SELECT event_id AS id, -value / 50 AS lp, row_number() OVER (ORDER BY -value / 50, event_id) - 1 AS k, count(*) OVER () AS n FROM events WHERE value IS NOT NULL),
c AS (SELECT *, CASE WHEN k + {b} = 0 THEN 0 ELSE least(0, lp + log10(n) - log10(k + {b})) END AS c FROM r)
SELECT id, k AS rank, round(min(c) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 8) AS log10fdr FROM c"""


def _lp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), (-F.col("value") / 50).alias("log10p"))


@query(_FDR.format(b=0))
def fdr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 false discovery rates with ranks from 0."""
    return rounded(log10_fdr(_lp(spark, sf_dir)).select("id", "rank", "log10fdr"), log10fdr=8)


@query(_FDR.format(b=1))
def fdr_bh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Benjamini-Hochberg form, ranks from 1."""
    return rounded(log10_fdr(_lp(spark, sf_dir), bh=True).select("id", "rank", "log10fdr"), log10fdr=8)


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_returnflag IN ('A', 'R') OR l_linestatus = 'O'")
def external_sort_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted union of three runs."""
    rows = table(spark, sf_dir, "lineitem")
    runs = [rows.where(c).select("l_orderkey", "l_linenumber", "l_extendedprice") for c in ("l_returnflag = 'A'", "l_returnflag = 'R'", "l_returnflag not in ('A', 'R') and l_linestatus = 'O'")]
    return annotate.merge_sorted(runs, "l_extendedprice", "l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS row_no, (row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1) // 1000 AS file_no FROM lineitem")
def split_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return annotate.split_every(rows, 1000, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]).select("l_orderkey", "l_linenumber", "row_no", "file_no")


@query("""SELECT event_id, user_id, round(sum(value) OVER w, 4) AS cum_sum, round(value - lag(value) OVER v, 4) AS diff, max(value) OVER w AS cum_max FROM events
WINDOW v AS (PARTITION BY user_id ORDER BY event_id), w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def accumulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ordered.accumulate(table(spark, sf_dir, "events").select("event_id", "user_id", "value"), "value", ["user_id"], ["event_id"])
    return rounded(out.drop("value"), cum_sum=4, diff=4)


@query("""SELECT event_id, user_id, round(exp(sum(ln(1 + value / 10000)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 4) AS cum_prod FROM events""")
def running_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", (1 + F.col("value") / 10000).alias("f"))
    return rounded(ordered.running_product(rows, "f", ["user_id"], ["event_id"]).drop("f"), cum_prod=4)


@query("""SELECT event_id, user_id, round(sum(value) OVER w, 4) AS cum_sum, round(value - lead(value) OVER (PARTITION BY user_id ORDER BY event_id), 4) AS diff, max(value) OVER w AS cum_max,
round(exp(sum(ln(1 + value / 10000)) OVER w), 4) AS cum_prod FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""")
def accumulate_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums, products, maxima and differences from the end of every series."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "value", (1 + F.col("value") / 10000).alias("f"))
    sums = ordered.accumulate(rows, "value", ["user_id"], ["event_id"], reverse=True)
    out = ordered.running_product(sums, "f", ["user_id"], ["event_id"], reverse=True)
    return rounded(out.select("event_id", "user_id", "cum_sum", "diff", "cum_max", "cum_prod"), cum_sum=4, diff=4, cum_prod=4)


@query("""SELECT event_id, round(sum(value) OVER w, 3) AS cum_sum, round(value - lag(value) OVER (ORDER BY event_id), 4) AS diff, max(value) OVER w AS cum_max
FROM events WINDOW w AS (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def accumulate_one_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as one series, scanned in ranges of 1,000 rows with carries."""
    rows = table(spark, sf_dir, "events").select("event_id", "value")
    return rounded(ordered.accumulate(rows, "value", [], ["event_id"], range_rows=1000).drop("value"), cum_sum=3, diff=4)


@query("SELECT o_orderkey, o_custkey, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) - 1 AS run FROM orders")
def duplicate_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ordered.run_number(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"), "o_orderpriority", ["o_custkey"])
    return out.select("o_orderkey", "o_custkey", F.col("run").cast("long").alias("run"))


@query("""WITH w AS (SELECT user_id, event_id, value, lag(value) OVER v AS l, lead(value) OVER v AS a FROM events WINDOW v AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, event_id, value FROM w WHERE (l IS NULL OR value > l) AND (a IS NULL OR value >= a)""")
def find_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local maxima of every user's values."""
    return ordered.find_peaks(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), "value", "event_id", "user_id", 0)


_APART = """WITH w AS (SELECT user_id, event_id, value, lag(value) OVER v AS l, lead(value) OVER v AS a FROM events WINDOW v AS (PARTITION BY user_id ORDER BY event_id)),
c AS (SELECT user_id, list([event_id] ORDER BY value DESC, event_id) AS c FROM w WHERE (l IS NULL OR value > l) AND (a IS NULL OR value >= a) GROUP BY ALL),
k AS (SELECT unnest(list_reduce(c, lambda kept, x: CASE WHEN len(list_filter(kept, lambda y: abs(y - x[1]) < {d})) = 0 THEN kept || x ELSE kept END)) AS event_id FROM c)
SELECT user_id, event_id, value FROM events JOIN k USING (event_id)"""


@query(_APART.format(d=500))
def find_peaks_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local maxima of every user's values at least 500 events apart, the highest first."""
    return ordered.find_peaks(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), "value", "event_id", "user_id", 500)


@query(_APART.replace("PARTITION BY user_id ", "").replace("SELECT user_id, list(", "SELECT list(").format(d=7))
def find_peaks_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local maxima of all events as one series, at least 7 events apart, in blocks of 500 candidates."""
    events = table(spark, sf_dir, "events").select(F.lit(1).alias("all"), "event_id", "value")
    peaks = ordered.find_peaks(events, "value", "event_id", "all", 7, block_rows=500)
    return peaks.drop("all", "value").join(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), "event_id")


@query("SELECT event_type, event_id, value, rank FROM (SELECT event_type, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rank FROM events) WHERE rank <= 5")
def top_k_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ordered.top_k(table(spark, sf_dir, "events").select("event_type", "event_id", "value"), "event_type", [F.desc("value"), "event_id"], 5)
    return out.withColumn("rank", F.col("rank").cast("long"))


# ---------------------------------------------------------------- genotypes, summaries


@query("""WITH p AS (SELECT l_partkey AS marker, l_suppkey AS feature, l_returnflag = 'R' AS cis FROM lineitem WHERE l_discount < 0.05)
SELECT CASE WHEN grouping(cis) = 1 THEN 'all' ELSE cis::VARCHAR END AS class, count(*) AS n_pairs, count(DISTINCT marker) AS n_markers, count(DISTINCT feature) AS n_features FROM p GROUP BY GROUPING SETS ((cis), ())""")
def cis_trans_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("marker"), F.col("l_suppkey").alias("feature"), (F.col("l_returnflag") == "R").alias("is_cis"), "l_discount")
    return profile.cis_trans_summary(pairs, "l_discount", 0.05)


@query("""WITH g AS (SELECT l_partkey % 500 AS marker, CASE WHEN l_linenumber = 7 THEN '0' ELSE substr('ACGT', (l_orderkey % 2 * 2 + l_partkey % 2)::INT + 1, 1) END AS a,
  CASE WHEN l_linenumber = 7 THEN '0' ELSE substr('ACGT', (l_suppkey % 2 * 2 + l_partkey % 2)::INT + 1, 1) END AS b FROM lineitem),
c AS (SELECT marker, sum((a = 'A')::INT + (b = 'A')::INT)::BIGINT AS n_A, sum((a = 'C')::INT + (b = 'C')::INT)::BIGINT AS n_C, sum((a = 'G')::INT + (b = 'G')::INT)::BIGINT AS n_G,
  sum((a = 'T')::INT + (b = 'T')::INT)::BIGINT AS n_T, sum((a = '0')::INT + (b = '0')::INT)::BIGINT AS n_0, count(*) FILTER (a = b AND a <> '0') AS n_hom, count(*) FILTER (a <> b AND a <> '0' AND b <> '0') AS n_het,
  count(*) FILTER (a = '0' AND b = '0') AS n_missing, count(*) AS n_calls FROM g GROUP BY ALL),
m AS (SELECT *, greatest(n_A, n_C, n_G, n_T) AS hi FROM c),
j AS (SELECT *, CASE WHEN n_A = hi THEN 'A' WHEN n_C = hi THEN 'C' WHEN n_G = hi THEN 'G' ELSE 'T' END AS major FROM m),
k AS (SELECT *, (SELECT arg_min(al, n * 10 - o) FROM (VALUES ('A', n_A, 1), ('C', n_C, 2), ('G', n_G, 3), ('T', n_T, 4)) v(al, n, o) WHERE n > 0 AND al <> major) AS second FROM j)
SELECT * EXCLUDE (hi, second), coalesce(second, CASE WHEN major = 'A' THEN 'C' ELSE 'A' END) AS minor,
  round(CASE coalesce(second, '') WHEN 'A' THEN n_A WHEN 'C' THEN n_C WHEN 'G' THEN n_G WHEN 'T' THEN n_T ELSE 0 END / (hi + CASE coalesce(second, '') WHEN 'A' THEN n_A WHEN 'C' THEN n_C WHEN 'G' THEN n_G WHEN 'T' THEN n_T ELSE 0 END), 8) AS maf FROM k""")
def genotype_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Allele and genotype counts per marker, from symbols derived of keys."""
    base = lambda key: F.substring(F.lit("ACGT"), (F.col(key) % 2 * 2 + F.col("l_partkey") % 2 + 1).cast("int"), F.lit(1))
    symbol = F.when(F.col("l_linenumber") == 7, "00").otherwise(F.concat(base("l_orderkey"), base("l_suppkey")))
    calls = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 500).alias("marker"), symbol.alias("symbol"))
    return rounded(profile.profile_long(calls), maf=8)


@query(f"""WITH {_CELLS}, g AS (SELECT vec_id, CASE WHEN abs(v) < 0.01 THEN '0' WHEN v > 0 THEN 'C' ELSE 'T' END AS a, CASE WHEN abs(v) < 0.01 THEN '0' WHEN v > 0.1 THEN 'C' ELSE 'T' END AS b FROM e),
c AS (SELECT vec_id, sum((a = 'C')::INT + (b = 'C')::INT) AS nc, sum((a = 'T')::INT + (b = 'T')::INT) AS nt, count(*) FILTER (a = '0') AS n_missing FROM g GROUP BY ALL)
SELECT vec_id AS id, CASE WHEN nc >= nt THEN 'C' ELSE 'T' END AS major, CASE WHEN nc >= nt THEN 'T' ELSE 'C' END AS minor, n_missing, least(nc, nt)::BIGINT AS code_sum, round(least(nc, nt) / (nc + nt), 8) AS maf FROM c""")
def recode_additive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """0/1/2 codes of 64 genotypes per row, as their sum, with alleles and MAF."""
    sym = lambda v: F.when(F.abs(v) < 0.01, "00").otherwise(F.concat(F.when(v > 0, "C").otherwise("T"), F.when(v > 0.1, "C").otherwise("T")))
    rows = vectors(spark, sf_dir).select("id", F.transform("values", sym).alias("symbols"))
    out = profile.recode_additive(rows)
    total = F.aggregate(F.filter("codes", lambda x: x.isNotNull()), F.lit(0).cast("long"), lambda s, x: s + x)
    return rounded(out.select("id", "major", "minor", "n_missing", total.alias("code_sum"), "maf"), maf=8)


@query("SELECT DISTINCT l_partkey AS key FROM lineitem WHERE l_returnflag = 'R' UNION SELECT l_partkey FROM lineitem WHERE l_discount > 0.08")
def union_of_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rows.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("key")).union(rows.where("l_discount > 0.08").select("l_partkey")).distinct()
