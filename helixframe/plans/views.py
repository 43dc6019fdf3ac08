"""Genomics-shaped views over the driver's tables, as SQL that Spark and DuckDB read alike.

In Spark a table in braces is a DataFrame argument; for DuckDB the braces go.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_CHR = "CASE WHEN {k} % 23 = 22 THEN 'X' ELSE CAST({k} % 23 + 1 AS STRING) END"
_BASE = "substr('ACGT', CAST({k} AS INT), 1)"


def _chr(key: str) -> str:
    return _CHR.replace("{k}", key)


def _base(place: str) -> str:
    return _BASE.replace("{k}", place)


#: Variants: a row for each part. Every fifth has an allele of two bases.
VARIANTS = f"""
SELECT {_chr("p_partkey")} AS chr, CAST(floor(p_partkey / 23) AS BIGINT) AS local_idx, concat('rs', CAST(p_partkey AS STRING)) AS snp,
       1000 + CAST(floor(p_partkey / 23) AS BIGINT) * 100 AS bp,
       concat({_base("p_size % 4 + 1")}, CASE WHEN p_partkey % 5 = 0 THEN 'C' ELSE '' END) AS a1,
       {_base("(p_size % 4 + 1 + p_partkey % 3) % 4 + 1")} AS a2, p_partkey AS k
FROM {{part}}
"""

#: Summary statistics: a row for each part with line items; some with alleles exchanged.
SUMSTATS = f"""
SELECT v.chr, v.bp, CASE WHEN v.k % 11 = 0 THEN v.a2 ELSE v.a1 END AS a1, CASE WHEN v.k % 11 = 0 THEN v.a1 ELSE v.a2 END AS a2,
       CASE WHEN v.k % 97 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(s.qty % 1000 + 1 AS DOUBLE) / 1001 END AS p,
       CASE WHEN v.k % 13 = 0 THEN NULL ELSE CAST(s.qty - 300 AS DOUBLE) / 100 END AS z, CAST(s.n * 10 AS DOUBLE) AS n, v.k
FROM ({VARIANTS}) v JOIN (
  SELECT l_partkey, CAST(sum(l_quantity) AS BIGINT) AS qty, count(*) AS n FROM {{lineitem}} GROUP BY l_partkey
) s ON v.k = s.l_partkey
"""

#: Intervals: one for each order, overlapping, touching, empty and long ones, in one of three groups.
INTERVALS = f"""
SELECT {_chr("o_orderkey")} AS chr, 900 + (o_custkey * 37) % 200000 AS start0, 900 + (o_custkey * 37) % 200000 + (o_orderkey % 9) * 50 AS end0,
       concat('g', CAST(o_custkey % 3 AS STRING)) AS grp, o_orderkey AS row0
FROM {{orders}}
"""

#: Intervals that do not overlap, with two values each; some touch.
NUMERIC = f"""
SELECT {_chr("s_suppkey")} AS chr, 950 + CAST(floor(s_suppkey / 23) AS BIGINT) * 400 AS start0,
       950 + CAST(floor(s_suppkey / 23) AS BIGINT) * 400 + 100 + (s_suppkey % 4) * 100 AS end0,
       CAST(s_suppkey % 5 AS DOUBLE) / 2 AS score, CAST(s_nationkey AS DOUBLE) - 12 AS weight, s_suppkey AS row0
FROM {{supplier}}
"""

#: Calls: a variant for each vector, a sample for each of its components; every 17th call is missing.
CALLS = f"""
SELECT {_chr("vec_id")} AS chr, CAST(floor(vec_id / 23) AS BIGINT) AS local_idx, 1000 + CAST(floor(vec_id / 23) AS BIGINT) * 1000 AS bp, vec_id AS k, pos AS sample_idx,
       CASE WHEN (vec_id + pos) % 17 = 0 THEN -1 WHEN x < -0.05 THEN 0 WHEN x < 0.05 THEN 1 ELSE 2 END AS g
FROM ({{unnested}}) e
"""
UNNESTED = {
    "spark": "SELECT vec_id, CAST(pos AS BIGINT) AS pos, x FROM {embeddings} LATERAL VIEW posexplode(embedding) t AS pos, x",
    "duckdb": "SELECT vec_id, unnest(range(len(embedding))) AS pos, unnest(embedding) AS x FROM embeddings",
}

#: Samples: a row for each customer.
SAMPLES = """
SELECT c_custkey AS sample_idx, concat('F', CAST(c_nationkey AS STRING)) AS fid, concat('I', CAST(c_custkey AS STRING)) AS iid,
       '0' AS father_id, '0' AS mother_id, CAST(c_custkey % 3 AS INT) AS sex
FROM {customer}
"""


def spark_view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The view's rows; each table in braces is read from sf_dir."""
    sql = sql.replace("{unnested}", UNNESTED["spark"])
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(re.findall(r"\{(\w+)\}", sql))}
    return spark.sql(sql, **tables)


def duck_view(sql: str) -> str:
    sql = sql.replace("{unnested}", UNNESTED["duckdb"]).replace("AS STRING)", "AS VARCHAR)").replace("AS INT)", "AS INTEGER)")
    return re.sub(r"\{(\w+)\}", r"\1", sql)


def duck(query: str) -> str:
    """A query with the views that it names before it."""
    names = {"variants": VARIANTS, "sumstats": SUMSTATS, "intervals": INTERVALS, "numerics": NUMERIC, "calls": CALLS, "samples": SAMPLES}
    used = [f"{n} AS ({duck_view(v)})" for n, v in names.items() if re.search(rf"\b{n}\b", query)]
    head = "WITH RECURSIVE " if "UNION ALL\n" in query else "WITH "
    return head + ",\n".join(used) + (",\n" if not query.lstrip().upper().startswith("SELECT") else "\n") + query
