"""Reading uploads, clean and raw tables; writing processed tables and stores."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlens.functions.roles import normal_name
from wardlens.functions.scalars import explode_once

HOSPITAL_SCHEMAS = {
    "admissions": "admission_id string, patient_id bigint, department_id int, admission_date date, discharge_date date, "
    "admission_type string, age double, gender string, length_of_stay int, bed_type string, discharge_status string",
    "appointments": "appointment_id bigint, patient_id bigint, department_id int, appointment_date date, appointment_type string, "
    "booking_date date, wait_time_days double, appointment_status string",
    "beds": "bed_record_id string, department_id int, record_date date, bed_type string, total_beds int, occupied_beds int, "
    "available_beds int, occupancy_rate double",
    "departments": "department_id int, department_name string, department_type string",
    "equipment": "equipment_id bigint, department_id int, equipment_type string, installation_date date, last_maintenance_date date, "
    "next_maintenance_date date, equipment_status string, usage_hours double, maintenance_count int, failure_count int",
}
EQUIPMENT_COLUMNS = tuple(field.split()[0] for field in HOSPITAL_SCHEMAS["equipment"].split(", "))
# A quote inside a quoted field is doubled, and white space belongs to its field.
CSV = {"header": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
CHUNK_FIELDS = "chunk_id int, page_number int, page_end int, section string, table_number int, document_name string, source_type string, text string"
LIST_FIELDS = "page_start int, page_end int, section string, table_number int, document_name string, source_type string, text string"


def normal_names(columns: list[str]) -> list[str]:
    """Normal names of one table's header, repeats numbered by position."""
    seen: dict[str, int] = {}
    names = []
    for column in columns:
        name = normal_name(column)
        seen[name] = seen.get(name, 0) + 1
        names.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return names


def read_upload_csv(spark: SparkSession, path: str, schema: str | None = None, multi_line: bool = True) -> DataFrame:
    """A headed CSV with inferred types and normal column names.

    Bytes that are not UTF-8 raise no error in the reader, so one search for
    such a line decides whether to read as Latin-1. Give ``schema`` for large
    inputs: inference reads the file once more. Fields may hold line breaks; a
    file known to have none can be split between tasks with ``multi_line=False``.
    """
    damaged = spark.read.text(path).where(~F.is_valid_utf8("value")).limit(1)
    encoding = "UTF-8" if damaged.isEmpty() else "ISO-8859-1"
    reader = spark.read.options(**CSV, multiLine=multi_line, encoding=encoding)
    frame = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    if frame.limit(1).isEmpty():
        raise ValueError("the uploaded dataset has no rows")
    return frame.toDF(*normal_names(frame.columns))


def read_clean_table(spark: SparkSession, path: str, name: str, date_columns: list[str] | None = None, multi_line: bool = True) -> DataFrame:
    """A cleaned table under its declared schema; the named columns are parsed as dates."""
    fields = [f.strip().rsplit(" ", 1) for f in HOSPITAL_SCHEMAS[name].split(",")]
    dates = date_columns if date_columns is not None else [f for f, kind in fields if kind == "date"]
    schema = ", ".join(f"{f} {'string' if f in dates else kind}" for f, kind in fields)
    table = spark.read.options(**CSV, multiLine=multi_line).schema(schema).csv(path)
    return table.withColumns({d: F.col(d).try_cast("date") for d in dates})


def read_raw_tables(spark: SparkSession, base: str, multi_line: bool = True) -> dict[str, DataFrame]:
    """The five raw tables, one folder each."""
    reader = spark.read.options(**CSV, multiLine=multi_line)
    return {name: reader.schema(schema).csv(f"{base}/{name}") for name, schema in HOSPITAL_SCHEMAS.items()}


def scan_equipment(equipment: DataFrame) -> DataFrame:
    return equipment.select(*EQUIPMENT_COLUMNS)


def write_processed(tables: dict[str, DataFrame], base: str, kind: str = "parquet") -> None:
    """One folder per table, replaced as a whole."""
    for name, table in tables.items():
        writer = table.write.mode("overwrite").format(kind)
        (writer.options(**CSV) if kind == "csv" else writer).save(f"{base}/{name}")


def append_table(table: DataFrame, columns: list[str], path: str, kind: str = "parquet", **options) -> None:
    """Append a fixed column list. ``kind='jdbc'`` with ``url`` and ``dbtable`` writes to a database instead."""
    writer = table.select(*columns).write.mode("append").format(kind).options(**options)
    writer.save() if kind == "jdbc" else writer.save(path)


def committed_batches(spark: SparkSession, path: str) -> dict[str, str]:
    """The folder of each committed batch; as many entries as there were appends. Of a batch committed twice at once, one counts."""
    try:
        commits = spark.read.schema("batch string, folder string").parquet(f"{path}/commits/*")
        return {r.batch: r.folder for r in commits.groupBy("batch").agg(F.min("folder").alias("folder")).collect()}
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}


def append_batch(table: DataFrame, columns: list[str], path: str, batch: str) -> bool:
    """Append a fixed column list once per ``batch``; false, and nothing written, where the batch is committed already.

    Rows go to a folder of their own that nobody reads; one row in the manifest then makes them visible as a whole. An
    aborted append leaves no row, and its repetition starts anew.
    """
    spark = table.sparkSession
    if batch in committed_batches(spark, path):
        return False
    name = uuid.uuid4().hex
    table.select(*columns).write.parquet(f"{path}/data/{name}")
    spark.createDataFrame([(batch, name)], "batch string, folder string").coalesce(1).write.parquet(f"{path}/commits/{name}")
    return True


def read_batches(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All rows of the committed batches; none where nothing is committed."""
    folders = [f"{path}/data/{name}" for name in sorted(committed_batches(spark, path).values())]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def write_chunk_store(chunks: DataFrame, path: str) -> None:
    """Chunk rows by workspace; big workspaces spread over many bounded files."""
    chunks.write.mode("overwrite").partitionBy("workspace_id").option("maxRecordsPerFile", 1_000_000).parquet(path)


def read_chunk_store(spark: SparkSession, path: str, schema: str, workspace: str | None = None) -> DataFrame:
    """Chunks of all workspaces or one (a pruned folder); unreadable files are skipped."""
    chunks = spark.read.schema(schema).option("ignoreCorruptFiles", True).parquet(path)
    return chunks if workspace is None else chunks.where(F.col("workspace_id") == workspace)


def write_embeddings(vectors: DataFrame, path: str, model: str, dimension: int) -> None:
    tagged = vectors.select("*", F.lit(model).alias("model_name"), F.lit(dimension).alias("dimension"))
    tagged.write.mode("overwrite").parquet(path)


def read_embeddings(spark: SparkSession, path: str, model: str) -> DataFrame:
    """Vectors of one model; a vector of another length than recorded stops the read."""
    stored = spark.read.parquet(path).where(F.col("model_name") == model)
    wrong = F.raise_error(F.lit("stored vector does not have the recorded dimension"))
    checked = F.when(F.size("embedding") == F.col("dimension"), F.col("embedding")).otherwise(wrong.cast("array<float>"))
    return stored.withColumn("embedding", checked)


def normalize_chunk_layout(stored: DataFrame) -> DataFrame:
    """Two stored JSON layouts as one table of chunks.

    Input ``(file_name, payload)``. A list gets chunk ids from its order and its
    start page as page number; an object keeps its chunks as they are.
    """
    is_list = F.col("payload").startswith("[")
    listed = stored.where(is_list).select("file_name", F.from_json("payload", f"array<struct<{_struct(LIST_FIELDS)}>>").alias("chunks"))
    from_list = explode_once(listed, ["file_name"], "chunks").select(
        "file_name", (F.col("position") + 1).alias("chunk_id"), F.col("item.page_start").alias("page_number"), "item.page_end", "item.section",
        "item.table_number", "item.document_name", "item.source_type", F.coalesce("item.text", F.lit("")).alias("text"),
    )
    kept = stored.where(~is_list).select("file_name", F.from_json("payload", f"document_name string, chunks array<struct<{_struct(CHUNK_FIELDS)}>>").getField("chunks").alias("chunks"))
    from_object = explode_once(kept, ["file_name"], "chunks").select("file_name", "item.*")
    return from_list.unionByName(from_object, allowMissingColumns=True)


def _struct(fields: str) -> str:
    return ", ".join(f.strip().replace(" ", ":", 1) for f in fields.split(","))


def file_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Supported files with size, type and use, by name. File contents are never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
    name = F.substring_index("path", "/", -1)
    kind = F.lower(F.regexp_extract(name, "\\.([A-Za-z0-9]+)$", 1))
    return (
        files.select(name.alias("file_name"), F.col("length").alias("size"), kind.alias("file_type"))
        .where(F.col("file_type").isin("pdf", "docx", "csv", "xlsx"))
        .withColumn("processing_type", F.when(F.col("file_type").isin("pdf", "docx"), "rag").otherwise("dataset"))
        .orderBy(F.lower("file_name"))
    )


def workspace_latest(analyses: DataFrame, workspace: str, order: list[str]) -> DataFrame:
    """The newest record per workspace: a pre-aggregating maximum, no sort per workspace."""
    rest = [c for c in analyses.columns if c not in (workspace, *order)]
    newest = analyses.groupBy(workspace).agg(F.max(F.struct(*order, *rest)).alias("newest"))
    return newest.select(workspace, "newest.*")
