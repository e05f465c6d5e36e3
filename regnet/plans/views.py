"""Genes, hits, peaks, counts, motifs and sequences as views over the relational test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The same text is valid in Spark and in the SQL that results are held against.
GENE = """CAST(p_partkey AS STRING) AS gene_name, concat('chr', CAST(p_partkey % 5 AS STRING)) AS seqname,
 CAST((p_partkey * 997) % 200000 + 1000 AS BIGINT) AS start_pos, CAST((p_partkey * 997) % 200000 + 1050 + p_size * 20 AS BIGINT) AS end_pos,
 CASE WHEN p_partkey % 3 = 0 THEN '-' ELSE '+' END AS strand"""
HIT = """concat('TF', CAST(l_suppkey % 25 AS STRING)) AS regulator, concat('chr', CAST(l_partkey % 5 AS STRING)) AS seqname,
 CAST((l_orderkey * 31 + l_partkey * 7 + l_linenumber * 113) % 200000 AS BIGINT) AS start_pos,
 CAST((l_orderkey * 31 + l_partkey * 7 + l_linenumber * 113) % 200000 + 11 AS BIGINT) AS stop_pos, l_quantity AS score"""
PEAK = """concat('chr', CAST(o_orderkey % 5 AS STRING)) AS chrom, CAST((o_orderkey * 389) % 200000 AS BIGINT) AS start_pos,
 CAST((o_orderkey * 389) % 200000 + 100 + o_custkey % 600 AS BIGINT) AS end_pos, '.' AS strand, CAST(floor(o_totalprice / 1000) AS DOUBLE) AS signal_value,
 concat('EXP', CAST(o_custkey % 8 AS STRING)) AS file_name"""
MASK = """concat('chr', CAST(s_suppkey % 5 AS STRING)) AS chrom, CAST((s_suppkey * 1999) % 200000 AS BIGINT) AS start_pos,
 CAST((s_suppkey * 1999) % 200000 + 900 AS BIGINT) AS end_pos, '.' AS strand"""
MOTIF_IC = "concat('TF', CAST(s_suppkey % 25 AS STRING)) AS regulator, CAST(5 + s_suppkey % 7 AS DOUBLE) AS information_content"
SEQUENCE = "concat('seq', CAST(doc_id AS STRING)) AS seqname, regexp_replace(upper(coalesce(text, '')), '[^ACGT]', ''{g}) AS seq"
COUNT = "concat('S', CAST(l_suppkey % 8 AS STRING)) AS sample, CASE WHEN l_partkey % 97 = 0 THEN '__no_feature' ELSE CAST(l_partkey AS STRING) END AS gene, CAST(l_quantity AS BIGINT) AS n"
LENGTH = "CAST(p_partkey AS STRING) AS gene, p_size / 10.0D + 0.1D AS length"


def _view(spark: SparkSession, sf_dir: str, table: str, text: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*_split(text))


def _dealt(df: DataFrame) -> DataFrame:
    """A table that comes in fewer splits than there are cores is dealt to all of them; larger ones stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _split(text: str) -> list[str]:
    """The expressions of a select list: commas inside parentheses don't part them."""
    out, depth, last = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            out.append(text[last:i])
            last = i + 1
    return [*out, text[last:]]


def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "part", GENE)


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return genes(spark, sf_dir).withColumns({"win_start": F.col("start_pos"), "win_end": F.col("end_pos")})


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits with one made-up information value per base."""
    per = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: (F.col("score") * (i + 3)) % 7)
    return _dealt(_view(spark, sf_dir, "lineitem", HIT)).withColumn("per_base", per)


def peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "orders", PEAK)


def peaks_of(spark: SparkSession, sf_dir: str, n: DataFrame) -> DataFrame:
    """Peaks whose files are spread over experiments 0 to _n - 1; _n is the one number in n."""
    df = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr(*_split(PEAK), "o_custkey").crossJoin(F.broadcast(n))
    return df.withColumn("file_name", F.expr("concat('EXP', CAST(o_custkey % _n AS STRING), '.bed.gz')")).drop("o_custkey", "_n")


def mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "supplier", MASK)


def motif_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "supplier", MOTIF_IC)


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dealt(_view(spark, sf_dir, "documents", SEQUENCE.format(g="")))


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "lineitem", COUNT).groupBy("sample", "gene").agg(F.sum("n").alias("count"))


def lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "part", LENGTH)


def motifs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matrices of all positions that each vector has numbers for, four to a position, as probabilities of 3 decimals."""
    share = lambda i, j: F.abs(F.get(F.col("embedding"), 4 * i + j).cast("double")) + 0.01
    row = lambda i: F.array(*[F.round(share(i, j) / (share(i, 0) + share(i, 1) + share(i, 2) + share(i, 3)), 3) for j in range(4)])
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet").filter(F.size("embedding") >= 4)
    places = F.sequence(F.lit(0), (F.size("embedding") / 4).cast("int") - 1)
    return df.select(F.concat(F.lit("M"), F.col("vec_id").cast("string")).alias("motif_id"), F.concat(F.lit("TF"), (F.col("vec_id") % 25).cast("string")).alias("motif_name"), F.transform(places, row).alias("pwm"))
