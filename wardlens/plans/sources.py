"""S: sources and sinks (round trips through the shared scratch folder)."""

from pyspark.sql import functions as F

from wardlens.operators import documents
from wardlens.plans.documents import FIXED
from wardlens.plans.registry import query
from wardlens.session import work_dir
from wardlens.sources import io

WORKSPACE = "concat('ws', doc_id % 7)"
CHUNK_SCHEMA = "doc_id bigint, chunk_id int, chunk_count int, text string, workspace_id string"


@query("read_upload_csv", """SELECT appointment_id, patient_id AS patient_no, department_id AS dept_id, appointment_date AS appt_date, appointment_type AS type,
    booking_date AS type_2, wait_time_days AS waiting_time_d, appointment_status AS unnamed FROM appointments""")
def _(t):
    path = work_dir(t.spark, "upload")
    messy = t.appointments.toDF("Appointment ID", " Patient No.", "DEPT-ID", "Appt Date", "Type", "type!", "Waiting Time (d)", "--")
    messy.write.options(**io.CSV).csv(path)
    return io.read_upload_csv(t.spark, path)


@query("read_upload_csv_text", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def _(t):
    # Texts with quotes, commas and line breaks come back as they were written.
    path = work_dir(t.spark, "upload-text")
    t.documents.write.options(**io.CSV).csv(path)
    return io.read_upload_csv(t.spark, path, "doc_id bigint, text string, lang string, source string, n_chars bigint")


@query("read_clean_table", "SELECT * REPLACE (CAST(wait_time_days AS DOUBLE) AS wait_time_days) FROM appointments")
def _(t):
    path = work_dir(t.spark, "clean")
    io.write_processed({"appointments": t.appointments}, path, "csv")
    return io.read_clean_table(t.spark, f"{path}/appointments", "appointments")


@query("read_raw_table", "SELECT 'admissions' AS table_name, CAST(admission_id AS VARCHAR) AS id, department_id FROM admissions UNION ALL SELECT 'equipment', CAST(equipment_id AS VARCHAR), department_id FROM equipment UNION ALL SELECT 'beds', bed_record_id, department_id FROM beds UNION ALL SELECT 'appointments', CAST(appointment_id AS VARCHAR), department_id FROM appointments UNION ALL SELECT 'departments', department_name, department_id FROM departments")
def _(t):
    path = work_dir(t.spark, "raw")
    io.write_processed({n: getattr(t, n) for n in io.HOSPITAL_SCHEMAS}, path, "csv")
    raw = io.read_raw_tables(t.spark, path)
    keys = {"admissions": "admission_id", "equipment": "equipment_id", "beds": "bed_record_id", "appointments": "appointment_id", "departments": "department_name"}
    parts = [raw[n].select(F.lit(n).alias("table_name"), F.col(k).cast("string").alias("id"), "department_id") for n, k in keys.items()]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3]).unionAll(parts[4])


@query("scan_equipment", f"SELECT {', '.join(io.EQUIPMENT_COLUMNS)} FROM equipment")
def _(t):
    return io.scan_equipment(t.equipment)


@query("write_processed", "SELECT b.*, d.department_name, d.department_type FROM beds b LEFT JOIN departments d USING (department_id)")
def _(t):
    path = work_dir(t.spark, "processed")
    io.write_processed({"beds": t.beds, "departments": t.departments}, path)
    back = {name: t.spark.read.schema(io.HOSPITAL_SCHEMAS[name]).parquet(f"{path}/{name}") for name in ("beds", "departments")}
    return back["beds"].join(back["departments"], "department_id", "left")


def raw_table(name):
    @query(f"read_raw_table_{name}", f"SELECT * FROM {name}")
    def _(t):
        path = work_dir(t.spark, "raw")
        io.write_processed({n: getattr(t, n) for n in io.HOSPITAL_SCHEMAS}, path, "csv")
        return io.read_raw_tables(t.spark, path)[name]


for name in io.HOSPITAL_SCHEMAS:
    raw_table(name)


@query("append_table", "SELECT equipment_type, equipment_status, COUNT(*) * 2 AS units FROM equipment GROUP BY ALL")
def _(t):
    path, columns = work_dir(t.spark, "appended"), list(t.equipment.columns)
    io.append_table(t.equipment, columns, path)
    io.append_table(t.equipment.select(*reversed(columns)), columns, path)
    return t.spark.read.schema(t.equipment.schema).parquet(path).groupBy("equipment_type", "equipment_status").agg(F.count(F.lit(1)).alias("units"))


@query("append_batch", "SELECT equipment_type, equipment_status, COUNT(*) AS units FROM equipment GROUP BY ALL")
def _(t):
    columns = ["equipment_type", "equipment_status"]
    path = work_dir(t.spark, "batches")
    for _ in range(2):  # the repetition adds nothing
        io.append_batch(t.equipment, columns, path, "equipment")
    rows = io.read_batches(t.spark, path, "equipment_type string, equipment_status string")
    return rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("units"))


@query("write_chunk_store", f"WITH {FIXED} SELECT doc_id, chunk_id, chunk_count, text, {WORKSPACE} AS workspace_id FROM fixed")
def _(t):
    path = work_dir(t.spark, "chunks")
    io.write_chunk_store(documents.fixed_chunks(t.documents).withColumn("workspace_id", F.expr(WORKSPACE)), path)
    return io.read_chunk_store(t.spark, path, CHUNK_SCHEMA)


@query("write_embeddings", "SELECT vec_id, label, 'encoder-a' AS model_name, 64 AS dimension, ROUND(list_sum(CAST(embedding AS DOUBLE[])), 6) AS total FROM embeddings")
def _(t):
    path = work_dir(t.spark, "vectors")
    io.write_embeddings(t.embeddings, path, "encoder-a", 64)
    stored = io.read_embeddings(t.spark, path, "encoder-a")
    total = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda s, x: s + x)
    return stored.select("vec_id", "label", "model_name", "dimension", F.round(total, 6).alias("total"))


@query("normalize_chunk_layout", f"""WITH {FIXED} SELECT concat('doc_', doc_id, '_chunks.json') AS file_name, chunk_id, CASE doc_id % 2 WHEN 0 THEN chunk_id * 2 ELSE chunk_id * 3 END AS page_number,
    CASE doc_id % 2 WHEN 0 THEN chunk_id * 2 + 1 END AS page_end, CASE doc_id % 2 WHEN 1 THEN 'paragraph' END AS section, CAST(NULL AS INT) AS table_number,
    CASE doc_id % 2 WHEN 0 THEN concat('doc ', doc_id) END AS document_name, CASE doc_id % 2 WHEN 0 THEN 'text' END AS source_type, text FROM fixed""")
def _(t):
    # Even documents in the list layout, odd ones in the object layout.
    cut = t.documents.select("doc_id", documents.fixed_windows("text").alias("chunks"))
    listed = F.expr("to_json(transform(chunks, (c, i) -> named_struct('page_start', (i + 1) * 2, 'page_end', (i + 1) * 2 + 1, 'document_name', concat('doc ', doc_id), 'source_type', 'text', 'text', c)))")
    kept = F.expr("to_json(named_struct('document_name', concat('doc ', doc_id), 'chunks', transform(chunks, (c, i) -> named_struct('chunk_id', i + 1, 'page_number', (i + 1) * 3, 'section', 'paragraph', 'text', c))))")
    stored = cut.select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit("_chunks.json")).alias("file_name"), F.when(F.col("doc_id") % 2 == 0, listed).otherwise(kept).alias("payload"))
    return io.normalize_chunk_layout(stored)


@query("file_manifest")
def _(t):
    path = work_dir(t.spark, "files")
    io.write_processed({"appointments": t.appointments, "beds": t.beds}, path, "csv")
    return io.file_manifest(t.spark, path).groupBy("file_type", "processing_type").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))


@query("workspace_latest", "SELECT user_id, ts, event_id, event_type, value, props FROM events QUALIFY ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def _(t):
    return io.workspace_latest(t.events, "user_id", ["ts", "event_id"])
