"""A persisted index from terms to facts, and ranked search by joined postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Which runs are terms, and their bounds in characters.
ASCII_RUN = "[a-z0-9_]{3,}"
CJK_RUN = "[\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}\\x{f900}-\\x{faff}]{2,}"
LONGEST_RUN = 12
WEAK = (2, 3)

BUCKETS = 64
#: A term's postings are dealt to so many tasks by their keys, so a common term is no hot key; large inputs take more.
SALTS = 16
#: Bytes of text whose postings a task of the index takes, and pairs of query and fact that a task of a search counts at most, about:
#: the number of tasks follows the input, and a task's memory doesn't.
TEXT_A_TASK, PAIRS_A_TASK = 1 << 23, 1 << 20
#: Terms of queries that are broadcast.
TERMS_SENT = 1 << 18


def strong(text: Column) -> Column:
    """Distinct identifiers of three characters or more, lower-cased, and whole CJK runs."""
    return F.array_distinct(F.concat(F.regexp_extract_all(F.lower(text), F.lit(ASCII_RUN), F.lit(0)), F.regexp_extract_all(text, F.lit(CJK_RUN), F.lit(0))))


def weak(text: Column, longer_than: int = 0) -> Column:
    """Distinct pieces of two and three characters of the CJK runs that are longer than ``longer_than``."""
    runs = F.filter(F.regexp_extract_all(text, F.lit(CJK_RUN), F.lit(0)), lambda r: F.char_length(r) > longer_than)

    def pieces(n: int) -> Column:
        at = lambda r: F.when(F.char_length(r) >= n, F.sequence(F.lit(1), F.char_length(r) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.flatten(F.transform(runs, lambda r: F.transform(at(r), lambda i: F.substring(r, i, F.lit(n)))))

    return F.array_distinct(F.concat(*[pieces(n) for n in WEAK]))


def _terms(df: DataFrame, key: str, text: str, longer_than: int) -> DataFrame:
    """key, term, weak: one row per term of each row."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))

    def marked(terms: Column, is_weak: bool) -> Column:
        return F.transform(terms, lambda t: F.struct(t.alias("term"), F.lit(is_weak).alias("weak")))

    kinds = [marked(strong(body), False), marked(weak(body, longer_than), True)]
    return df.select(F.col(key).alias("key"), F.explode(F.concat(*kinds)).alias("t")).select("key", "t.term", "t.weak")


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def build_index(df: DataFrame, key: str, text: str, path: str) -> None:
    """Write the postings (term, weak, key) of all rows as Parquet, in folders by the hash of their term; a search reads only the folders of its terms.

    A null text has no terms; rows that repeat a key are one fact with the terms of all. The pieces of all CJK runs are posted, since a search may ask for any.
    """
    size = df.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0
    tasks = max(1, -(-size // TEXT_A_TASK))
    salts = max(SALTS, -(-4 * tasks // BUCKETS))
    rows = _terms(df, key, text, 0).withColumn("bucket", _bucket(F.col("term"))).withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(salts)))
    dealt = rows.repartition(tasks, "bucket", "salt").dropDuplicates(["bucket", "salt", "term", "weak", "key"])
    dealt.drop("salt").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(path)


def search(spark: SparkSession, path: str, asked: DataFrame, key: str, text: str, top: int = 10) -> DataFrame:
    """query, key, strong_hits, weak_hits, rank of the ``top`` facts of each query: most strong terms, then most weak ones, then the smallest key.

    ``asked`` holds the queries; only CJK runs of more than twelve characters are asked for in pieces as well. The postings of
    asked terms are dealt to tasks by their key, so each task counts the whole hits of its facts and keeps the best of a query before
    ranks are given.
    """
    postings = spark.read.schema("term string, weak boolean, key long, bucket int").parquet(path)
    terms = _terms(asked, key, text, LONGEST_RUN).withColumnRenamed("key", "query").withColumn("bucket", _bucket(F.col("term")))
    by = ["bucket", "term", "weak"]
    n_terms, n_queries = terms.agg(F.count(F.lit(1)), F.approx_count_distinct("query")).first()
    tasks = max(1, -(-n_queries * postings.agg(F.approx_count_distinct("key")).first()[0] // PAIRS_A_TASK))
    if n_terms <= TERMS_SENT:
        met = postings.join(F.broadcast(terms.select(*by).distinct()), by, "left_semi").repartition(tasks, "key").join(F.broadcast(terms), by)
    else:
        dealt = postings.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
        copied = terms.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = dealt.join(copied, [*by, "salt"])
    hits = met.groupBy("query", "key").agg(F.count_if(~F.col("weak")).alias("strong_hits"), F.count_if(F.col("weak")).alias("weak_hits"))
    ranked = "SELECT *, row_number() OVER (PARTITION BY query ORDER BY strong_hits DESC, weak_hits DESC, key) AS rank FROM {hits}"
    return spark.sql(f"SELECT query, key, strong_hits, weak_hits, rank FROM ({ranked}) WHERE rank <= {int(top)}", hits=hits)
