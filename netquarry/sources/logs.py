"""Sources: newline-delimited logs, ground-truth CSV, datasets by extension, documents in JSON, packet and hello bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CONN = T.StructType(
    [T.StructField("ts", T.DoubleType()), T.StructField("uid", T.StringType())]
    + [T.StructField(c, T.StringType()) for c in ("id_orig_h", "id_resp_h")]
    + [T.StructField(c, T.IntegerType()) for c in ("id_orig_p", "id_resp_p")]
    + [T.StructField(c, T.StringType()) for c in ("proto", "service", "conn_state", "history")]
    + [T.StructField("duration", T.DoubleType())]
    + [T.StructField(c, T.LongType()) for c in ("orig_bytes", "resp_bytes", "missed_bytes", "orig_pkts", "resp_pkts", "orig_ip_bytes", "resp_ip_bytes")]
    + [T.StructField(c, T.BooleanType()) for c in ("local_orig", "local_resp")]
    + [T.StructField("ip_proto", T.IntegerType())]
)
PAYLOAD = T.StructType(
    [T.StructField("ts", T.DoubleType()), T.StructField("uid", T.StringType()), T.StructField("seq", T.LongType())]
    + [T.StructField("is_orig", T.BooleanType()), T.StructField("len", T.IntegerType()), T.StructField("payload", T.StringType())]
)
SSL = T.StructType(
    [T.StructField("ts", T.DoubleType())]
    + [T.StructField(c, T.StringType()) for c in ("uid", "version", "server_name", "session_id")]
    + [T.StructField("resumed", T.BooleanType())]
)


def _both_spellings(schema: T.StructType) -> T.StructType:
    """The schema with dotted names (id.orig_h) next to underscored ones."""
    dotted = [T.StructField(f.name.replace("id_", "id.", 1), f.dataType) for f in schema if f.name.startswith("id_")]
    return T.StructType([*schema.fields, *dotted])


def read_log(spark: SparkSession, path: str, schema: T.StructType, source: str | None = None) -> DataFrame:
    """A newline-delimited JSON log. Lines that don't parse are skipped; both spellings of a name give one column."""
    raw = spark.read.schema(_both_spellings(schema)).option("mode", "DROPMALFORMED").json(path)
    columns = []
    for f in schema:
        dotted = f.name.replace("id_", "id.", 1) if f.name.startswith("id_") else None
        columns.append(F.coalesce(F.col(f.name), F.col(f"`{dotted}`")).alias(f.name) if dotted else F.col(f.name))
    out = raw.select(*columns).where(F.col("uid").isNotNull())
    return out.withColumn("source_pcap", F.lit(source) if source else F.element_at(F.split(F.input_file_name(), "/"), -1))


def with_time(df: DataFrame) -> DataFrame:
    """ts_date from epoch seconds, in the session's time zone."""
    return df.withColumn("ts_date", F.timestamp_seconds(F.col("ts")))


def with_payload_size(df: DataFrame) -> DataFrame:
    """Bytes of a hex payload."""
    return df.withColumn("payload_size", F.floor(F.length("payload") / 2).cast("int"))


def new_sources(rows: DataFrame, loaded: DataFrame) -> DataFrame:
    """Rows of sources that haven't been loaded before."""
    return rows.join(loaded.select("source_pcap").distinct(), "source_pcap", "left_anti")


def parse_time(text: Column, shift_seconds: float = 0.0) -> Column:
    """Epoch seconds of dd/MM/yyyy HH:mm:ss with or without a fraction, shifted; null if it doesn't parse."""
    t = F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in ("dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy HH:mm:ss.SSSSSS", "dd/MM/yyyy HH:mm:ss.SSS")])
    return F.unix_micros(t) / 1e6 + F.lit(shift_seconds)


PROTOCOLS = {6: "tcp", 17: "udp", 1: "icmp"}


def protocol_name(number: Column, default: str = "unknown") -> Column:
    names = F.create_map(*[F.lit(x) for pair in PROTOCOLS.items() for x in pair])
    return F.coalesce(F.try_element_at(names, number.cast("int")), F.lit(default))


def protocol_number(name: Column) -> Column:
    """Number of a protocol's name in any case, null for another one."""
    numbers = F.create_map(*[F.lit(x) for k, v in PROTOCOLS.items() for x in (v, k)])
    return F.try_element_at(numbers, F.lower(name))


def read_csv(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """A CSV with a header, all columns as text: names trimmed and without a byte-order mark, values as they are."""
    raw = spark.read.options(header=True, sep=delimiter, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return raw.toDF(*[c.lstrip("\ufeff").strip() for c in raw.columns])


def read_truth(spark: SparkSession, path: str, shift_seconds: float = 12 * 3600.0) -> DataFrame:
    """The labelled CSV: header names trimmed, bad ports -1, unknown protocols 'unknown', durations in seconds."""
    raw = read_csv(spark, path)
    return raw.select(
        F.coalesce(F.col("Dst Port").try_cast("int"), F.lit(-1)).alias("dst_port"),
        protocol_name(F.col("Protocol").try_cast("int")).alias("proto"),
        parse_time(F.col("Timestamp"), shift_seconds).alias("ts"),
        (F.col("Flow Duration").try_cast("double") / 1e6).alias("duration"),
        (F.coalesce(F.col("Tot Fwd Pkts").try_cast("long"), F.lit(0)) + F.coalesce(F.col("Tot Bwd Pkts").try_cast("long"), F.lit(0))).alias("packets"),
        F.col("Label").alias("label"),
    )


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """A dataset by its extension: json (one array or object), jsonl, csv, parquet, xml, txt."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind == "json":
        return spark.read.option("multiLine", True).json(path)
    if kind == "jsonl":
        return spark.read.json(path)
    if kind == "csv":
        return spark.read.option("header", True).option("inferSchema", True).csv(path)
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind == "xml":
        return spark.read.option("rowTag", "row").xml(path)
    if kind == "txt":
        return spark.read.text(path)
    raise ValueError(f"no reader for .{kind}")


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """df, or an error that names the columns it lacks."""
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def checked(df: DataFrame, shape: str) -> DataFrame:
    """df in the columns and types of a DDL text, or an error. A column that is absent or can't be cast without loss fails when
    the rows are read, with the first such column's name."""
    schema = T.StructType.fromDDL(shape)
    require_columns(df, schema.names)

    def one(f: T.StructField) -> Column:
        made = F.col(f"`{f.name}`").try_cast(f.dataType)
        bad = made.isNull() & F.col(f"`{f.name}`").isNotNull()
        return F.when(bad, F.raise_error(F.lit(f"wrong shape: {f.name}")).cast(f.dataType)).otherwise(made).alias(f.name)

    return df.select(*map(one, schema))


def read_index(spark: SparkSession, vectors: str, corpus: str, id_col: str = "id") -> DataFrame:
    """The documents of a JSON-lines corpus with their vectors from a Parquet table of (id, vec). An identifier that only one of
    them has, or that one has twice, is an error."""
    docs, held = spark.read.json(corpus), spark.read.parquet(vectors)

    def once(df: DataFrame, name: str) -> DataFrame:
        whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
        return df.groupBy(F.col(id_col).alias("_id")).agg(F.first(whole).alias(name), F.count(F.lit(1)).alias(f"{name}_n"))

    both = once(docs, "_d").join(once(held, "_v"), "_id", "full")
    wrong = F.raise_error(F.concat(F.lit("corpus and vectors don't fit at "), F.coalesce(F.col("_id").cast("string"), F.lit("null")))).cast("boolean")
    both = both.where(F.when(F.coalesce((F.col("_d_n") == 1) & (F.col("_v_n") == 1), F.lit(False)), F.lit(True)).otherwise(wrong))
    return both.select("_d.*", *[F.col(f"_v.{c}").alias(c) for c in held.columns if c not in docs.columns])


def flatten(df: DataFrame, sep: str = ".") -> DataFrame:
    """Nested structs as columns of their own, names joined by sep."""

    def walk(schema: T.StructType, path: list[str]) -> list[Column]:
        out = []
        for f in schema:
            at = [*path, f.name]
            if isinstance(f.dataType, T.StructType):
                out += walk(f.dataType, at)
            else:
                out.append(F.col(".".join(f"`{p}`" for p in at)).alias(sep.join(at)))
        return out

    return df.select(*walk(df.schema, []))


def list_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, name, length, modified) of a folder's files by name; their contents aren't read."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return raw.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.col("modificationTime").alias("modified"))


def read_named(spark: SparkSession, root: str, split: str, name: str) -> DataFrame:
    """A dataset by split and name: the JSON file <root>/<split>/<name>.json, names in lower case."""
    return read_dataset(spark, f"{root}/{split.lower()}/{name.lower()}.json")


def read_with_failures(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows that parse, manifest of those that don't: file, number of lines, the least such line)."""
    known = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    lines = spark.read.text(path).where(F.trim("value") != "").withColumn("_file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    lines = lines.select("_file", F.from_json("value", known, {"columnNameOfCorruptRecord": "_bad"}).alias("r")).select("_file", "r.*")
    failed = lines.where("_bad is not null").groupBy(F.col("_file").alias("file")).agg(F.count(F.lit(1)).alias("lines"), F.min("_bad").alias("first"))
    return lines.where("_bad is null").select(*[f.name for f in schema]), failed
