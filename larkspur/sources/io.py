"""Sources and sinks: strict and lenient JSON lines, chunk and fact tables, create-only and append sinks, injected connectors."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.functions.columns import company_from_filename, is_blank

CHUNK = (
    "chunk_id bigint, content string, metadata struct<company:string, source_file:string, page:int, start_index:int, chunk_strategy:string, chunk_max_tokens:int, chunk_token_count:int,"
    " chunk_char_count:int, chunk_element_count:int, chunk_element_types:array<string>, chunk_overlap_tokens:int, chunk_index_on_page:int>"
)
FACTS = "companies map<string, struct<report_year:int, currency:string, source_file:string, page_number:int, metrics:map<string, struct<value:string, display:string>>>>"


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def read_jsonl_strict(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Rows of a JSON-lines file; blank lines are skipped, a line that is no JSON object of the schema raises with its file and text."""
    kind = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    with_bad = T.StructType([*kind.fields, T.StructField("_bad", T.StringType())])
    lines = spark.read.text(path).where(~is_blank(F.col("value"))).select("value", F.input_file_name().alias("file"))
    parsed = lines.withColumn("r", F.from_json("value", with_bad, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    message = F.concat(F.col("file"), F.lit(": invalid JSON: "), F.substring("value", 1, 200))
    good = F.when(F.col("r._bad").isNotNull() | F.col("r").isNull(), F.raise_error(message)).otherwise(F.lit(True))
    return parsed.where(good).select([F.col(f"r.{f.name}").alias(f.name) for f in kind.fields])


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Rows of a JSON-lines file; bad lines and a missing file give no rows."""
    kind = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    if not _exists(spark, path):
        return spark.createDataFrame([], kind)
    return spark.read.schema(kind).option("mode", "DROPMALFORMED").json(path)


def read_json_array(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Rows of a file that holds one JSON array; anything but an array of objects raises, an object at the top at once."""
    other = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("f"), F.substring(F.regexp_replace(F.substring("value", 1, 4096), r"^[\s\x{feff}]+", ""), 1, 1).alias("c")).where("c <> '['").limit(1).collect()
    if other:
        raise ValueError(f"{other[0]['f']} holds no JSON array")
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of a metadata file, flat, with the defaults of missing fields: page 0, start -1."""
    m = read_json_array(spark, path, CHUNK)
    return m.select("chunk_id", "content", "metadata.company", "metadata.source_file", F.coalesce("metadata.page", F.lit(0)).alias("page"), F.coalesce("metadata.start_index", F.lit(-1)).alias("start_index"))


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    """Facts of a file {"companies": {name: {...}}}, one row for each company."""
    whole = spark.read.schema(FACTS).option("multiLine", True).json(path)
    return whole.select(F.explode("companies").alias("company", "f")).select("company", "f.*")


def read_pages(spark: SparkSession, folder: str, parse: Callable[[bytes], list[str | None]], pattern: str = "*.pdf") -> DataFrame:
    """(source_file, company, page, text) of the pages that the injected parser finds; a file it fails on gives no rows, null text is empty. page counts from 0."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select(F.element_at(F.split("path", "/"), -1).alias("source_file"), "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf.source_file, pdf.content, strict=True):
                try:
                    texts = parse(bytes(content))
                except Exception:  # noqa: BLE001  a parser may fail in any way; its file is skipped
                    continue
                yield pd.DataFrame({"source_file": name, "page": range(len(texts)), "text": [t or "" for t in texts]}).astype({"page": "int32"})

    return files.mapInPandas(run, "source_file string, page int, text string").withColumn("company", company_from_filename(F.col("source_file")))


def write_new(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Create-only sink: an existing target raises."""
    df.write.mode("errorifexists").format(kind).save(path)


def append(df: DataFrame, path: str) -> None:
    """Append-only sink; its commit protocol makes a failed write invisible."""
    df.write.mode("append").parquet(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines, non-ASCII kept, null fields written."""
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def write_vectors(df: DataFrame, path: str, key: str = "chunk_id", vector: str = "embedding") -> None:
    """Vector index sink: (key, vector) of one width; a missing key or vector, or another width, raises, and so does an existing target."""
    wide = df.agg(F.max(F.size(vector))).first()[0]
    bad = F.when(F.col(key).isNull() | F.col(vector).isNull() | (F.size(vector) != F.lit(wide)), F.raise_error(F.concat(F.lit("no vector of the index's width for "), F.coalesce(F.col(key).cast("string"), F.lit("a missing key")))))
    write_new(df.where(bad.isNull()).select(key, vector), path)


def write_index(postings: DataFrame, frequencies: DataFrame, path: str) -> None:
    """BM25 corpus sink: the tables that a search joins."""
    postings.write.mode("overwrite").parquet(f"{path}/postings")
    frequencies.write.mode("overwrite").parquet(f"{path}/frequencies")


def with_retries(call: Callable[[], dict], attempts: int = 3, backoff: float = 1.5, retry: Callable[[Exception], bool] = lambda e: True, sleep: Callable[[float], None] = time.sleep) -> dict:
    """An external call, repeated while it fails in a way worth repeating."""
    for i in range(attempts):
        try:
            return call()
        except Exception as e:  # noqa: BLE001
            if i + 1 == attempts or not retry(e):
                raise
            sleep(backoff * (i + 1))
    raise AssertionError


def scored_by(df: DataFrame, client: Callable[[str, list[str]], list[float]], query: str, question: str, key: str, text: str) -> DataFrame:
    """(query, key, score) from an injected re-ranking client, called once for each query with its candidates; a failed call leaves null scores for a local fallback."""
    inner = f"`{query}` {df.schema[query].dataType.simpleString()}, `{key}` {df.schema[key].dataType.simpleString()}, score double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        try:
            scores = [float(x) for x in client(pdf[question].iloc[0], pdf[text].tolist())]
            if len(scores) != len(pdf):
                raise ValueError("scores do not match candidates")
        except Exception:  # noqa: BLE001
            scores = [None] * len(pdf)
        return pd.DataFrame({query: pdf[query], key: pdf[key], "score": scores})

    return df.select(query, question, key, text).groupBy(query).applyInPandas(run, inner)


def embedded_by(df: DataFrame, model: Callable[[list[str]], list[list[float]]], text: str, out: str = "embedding") -> DataFrame:
    """df with vectors from an injected embedding model, batch by batch."""

    @F.pandas_udf("array<float>")
    def embed(s: pd.Series) -> pd.Series:
        return pd.Series(model(s.fillna("").tolist()))

    return df.withColumn(out, embed(F.col(text)))
