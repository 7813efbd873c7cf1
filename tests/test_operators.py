"""Golden tables, brute-force comparisons and properties on small fixtures."""

import datetime
import random
import re
import unicodedata
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wardlens.functions import roles
from wardlens.functions.stats import exact_percentiles, row_numbers
from wardlens.operators import charts, documents, features, kpis, priority, questions, retrieval
from wardlens.plans.catalogue import PLANS
from wardlens.sources import io
from wardlens.sources.fixtures import QUESTION_TEMPLATES

ROUTING = [
    ("What is the average length of stay?", "sql", "average_length_of_stay"),
    ("Which department has the most admissions?", "sql", "most_admissions"),
    ("How many appointments were cancelled?", "sql", "cancelled_appointments_last_month"),
    ("How many beds are occupied?", "sql", "occupied_beds"),
    ("How many equipment units are operational?", "sql", "operational_equipment"),
    ("What problems were mentioned in the annual report?", "rag", None),
    ("What does the quality report say about patient safety?", "rag", None),
    ("What is the predicted bed demand next week?", "ml", "bed_forecast"),
    ("What is the predicted length of stay?", "ml", "length_of_stay"),
    ("What is the predicted equipment failure risk?", "ml", "equipment_failure"),
    ("What is the average LOS in Cardiology?", "sql", "average_length_of_stay"),
    ("DROP TABLE admissions", "clarify", None),
    ("  ", "clarify", None),
]


def test_routing_golden(spark):
    frame = spark.createDataFrame([(i, q) for i, (q, _, _) in enumerate(ROUTING)], "question_id bigint, question string")
    got = {r["question_id"]: r for r in questions.classify_questions(frame).collect()}
    for i, (_, intent, model) in enumerate(ROUTING):
        assert (got[i]["intent"], got[i]["model"]) == (intent, model)
    assert got[10]["department"] == "Cardiology" and got[0]["department"] is None
    assert got[12]["confidence"] == 0.0


def test_priority_golden(spark):
    rows = [
        ("EQ101", "Ventilator", "Operational", 45000.0, 20, 8, "2026-01-10"),
        ("EQ102", "MRI", "Operational", 12000.0, 5, 2, "2027-01-10"),
        ("EQ103", "Monitor", "Out of Service", 30000.0, 30, 10, "2025-01-01"),
    ]
    columns = "equipment_id string, equipment_type string, equipment_status string, usage_hours double, maintenance_count int, failure_count int, next_maintenance_date string"
    got = priority.equipment_priority(spark.createDataFrame(rows, columns), "2026-01-01").collect()
    assert [(r["equipment_id"], r["priority_score"], r["priority_level"]) for r in got] == [
        ("EQ103", 88.64, "Critical"), ("EQ101", 75.75, "High"), ("EQ102", 2.0, "Low"),
    ]


@pytest.mark.parametrize("hot_rows", [1, 40, 1000, 100_000])
def test_hot_key_row_numbers(spark, hot_rows):
    rows = [("hot", i, (i * 7919) % 100_003) for i in range(3000)] + [("cold", i, i) for i in range(50)] + [(None, i, i) for i in range(5)]
    random.Random(1).shuffle(rows)
    frame = spark.createDataFrame(rows, "k string, id int, position bigint")
    got = row_numbers(frame, ["k"], ["position", "id"], name="n", hot_rows=hot_rows, buckets=16).collect()
    assert len(got) == len(rows)
    for key in ("hot", "cold", None):
        mine = sorted((r for r in got if r["k"] == key), key=lambda r: (r["position"], r["id"]))
        assert [r["n"] for r in mine] == list(range(1, len(mine) + 1))


VALUES = {
    "ties": [5.0] * 40 + [1.0, 9.0], "long tail": list(np.random.default_rng(3).lognormal(3, 3, 501)), "two": [-4.0, 7.5], "one": [3.0],
    "outlier": [*range(3_000), 1e300, -1e300], "nearly one value": [7.0] * 9_500 + list(range(500)), "many": list(np.random.default_rng(4).normal(size=30_011)),
}


@pytest.mark.parametrize("accuracy", [100, 20_000])
def test_percentiles_match_numpy(spark, accuracy):
    rows = [tuple(float(v[i]) if i < len(v) else None for v in VALUES.values()) for i in range(max(map(len, VALUES.values())))]
    names = [f"c{i}" for i in range(len(VALUES))]
    frame = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).repartition(7).withColumn("none", F.lit(None).cast("double"))
    shares = {"a": 0.25, "b": 0.5, "c": 0.9, "d": 0.0, "e": 1.0}
    plan = exact_percentiles(frame, [*names, "none"], shares, accuracy)
    got = {r["column_name"]: r for r in plan.collect()}
    assert set(got) == set(names)
    for name, (kind, values) in zip(names, VALUES.items(), strict=True):
        assert np.allclose([got[name][s] for s in shares], np.percentile(values, [25, 50, 90, 0, 100]), rtol=1e-12), kind


def test_row_numbers_and_percentiles_store_nothing(spark, monkeypatch):
    def refused(*_):
        raise AssertionError("a table is written")

    monkeypatch.setattr("wardlens.session.work_dir", refused)
    frame = spark.range(1_000).selectExpr("id", "id % 3 AS k")
    assert exact_percentiles(frame, ["id"], {"m": 0.5}).first()["m"] == 499.5
    assert row_numbers(frame, ["k"], ["id"]).count() == 1_000


def test_split_is_exact_and_stable(spark):
    frame = spark.range(5003).select(F.col("id").alias("key"), (F.col("id") % 3 == 0).cast("int").alias("label"))
    got = features.stratified_split(frame, "key", "label")
    counts = {r["label"]: r["n"] for r in got.where("is_train").groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert counts == {1: int(1668 * 0.8), 0: int(3335 * 0.8)}
    again = features.stratified_split(frame.repartition(7), "key", "label")
    assert got.where("is_train").select("key").exceptAll(again.where("is_train").select("key")).isEmpty()


# --- documents -------------------------------------------------------------


def plain_windows(text, size, overlap):
    text = " ".join(text.split())
    out, start = [], 0
    while start < len(text):
        end = min(start + size, len(text))
        if text[start:end].strip():
            out.append(text[start:end].strip())
        if end == len(text):
            break
        start = end - overlap
    return out


def plain_packing(text, size=1800, overlap=250):
    """The packing rule restated directly, as the yardstick."""
    text = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", text.replace("\x00", " "))).strip()
    done, open_ = [], ""

    def cut(piece, stop):
        start = 0
        while start < len(piece):
            done.append(piece[start : start + size].strip())
            if stop and start + size >= len(piece):
                return
            start += size - overlap

    for part in (p.strip() for p in re.split(r"\n\s*\n", text)):
        if not part:
            continue
        joined = f"{open_}\n\n{part}" if open_ else part
        if len(part) <= size and len(joined) <= size:
            open_ = joined
            continue
        if open_:
            done.append(open_.strip())
        carried, open_ = f"{open_[-overlap:]}\n\n{part}", ""
        if len(part) > size:
            cut(part, True)
        elif len(carried) <= size:
            open_ = carried
        else:
            cut(carried, False)
    if open_:
        done.append(open_.strip())
    return [c for c in done if len(c) >= 20]


def random_text(generator, paragraphs):
    words = ["bed", "ward", "é", " ", "patient-safety", "ünder", "\t", "a" * 90, "x y", "　", "lo\nng"]
    parts = [" ".join(generator.choice(words) for _ in range(generator.choice([0, 3, 40, 200, 420]))) for _ in range(paragraphs)]
    return generator.choice(["\n\n", "\n \n", "\n\n\n\n"]).join(parts)


def test_chunkers_match_plain_rules(spark):
    generator = random.Random(7)
    texts = [random_text(generator, generator.randint(0, 9)) for _ in range(120)] + ["", " ", "x", "y" * 1000, "z" * 1001, "w" * 1800, "v" * 1801]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    fixed = Counter((r["doc_id"], r["chunk_id"], r["text"]) for r in documents.fixed_chunks(frame).collect())
    assert fixed == Counter((i, k + 1, c) for i, t in enumerate(texts) for k, c in enumerate(plain_windows(t, 1000, 200)))
    packed = {(r["doc_id"], r["chunk_id"]): r["text"] for r in documents.paragraph_chunks(frame).collect()}
    assert packed == {(i, k + 1): c for i, t in enumerate(texts) for k, c in enumerate(plain_packing(t))}


def test_window_parameters_are_checked():
    for size, overlap in ((0, 0), (10, -1), (10, 10)):
        with pytest.raises(ValueError):
            documents.fixed_windows("text", size, overlap)


def test_repair_and_normal_form(spark):
    def plain(text):
        try:
            fixed = text.encode("latin1").decode("utf-8")
        except (UnicodeEncodeError, UnicodeDecodeError):
            return text
        marks = lambda s: sum(s.count(m) for m in "âÂÃð")
        return fixed if marks(text) > marks(fixed) else text

    texts = ["cafÃ©", "Â£410m", "âge", "Ã", "naïve Ã© €", "plain", "ð\u009f\u0098\u0080 ok", "ðŸ˜€"]
    frame = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    got = {r["id"]: r["t"] for r in frame.select("id", documents.repair_double_encoding("text").alias("t")).collect()}
    assert got == {i: plain(t) for i, t in enumerate(texts)}
    wide = spark.createDataFrame([("ﬁle  Ⅷ\r\n\r\n​ x y ",)], "text string")
    (row,) = wide.select(documents.clean_text("text").alias("t")).collect()
    assert row["t"] == unicodedata.normalize("NFKC", "ﬁle Ⅷ") + "\nx y"


def test_composition_makes_python_strings_of_few_texts_at_a_time(monkeypatch):
    """A batch of long texts stays in Arrow; only strings that are not ASCII become Python objects, some hundred at once."""
    seen = []
    counting = SimpleNamespace(normalize=lambda form, v: seen.append(v) or unicodedata.normalize(form, v))
    monkeypatch.setattr(documents, "unicodedata", counting)
    assert documents._composed(pa.array(["ﬁ", "a", None, "", "Ⅷ é"] * 300)).to_pylist() == ["fi", "a", None, "", "VIII é"] * 300
    assert seen == ["ﬁ", "Ⅷ é"] * 300


def test_composition_of_cells_keeps_missing_rows_and_tables(spark):
    tables = [[["ﬁ", None], [], None, ["plain"]], None, [], [["Ⅷ", "a  b\tc "]]]
    frame = spark.createDataFrame(list(enumerate(tables)), "id int, rows array<array<string>>").coalesce(1)
    plain = {i: t and [None if r is None else [c and unicodedata.normalize("NFKC", c) for c in r] for r in t] for i, t in enumerate(tables)}
    assert dict(frame.select("id", documents.nfkc_cells("rows")).collect()) == plain
    assert frame.select(documents.clean_table_cells("rows", compatibility=True).alias("r")).where("id = 3").first().r == [["VIII", "a b c"]]


def test_tidy_cells_equal_the_full_cleaning(spark):
    cells = ["", " ", " a b ", "a  b", "\ta\t b", "é à", "âÃ", "caf\u00c3\u00a9", "a\u00a0b", "\u2003x", "a\nb\r\n\n c", "\ufeffx\u200b", "a\x1f", "\x1fa b\x85", "日本 語"]
    frame = spark.createDataFrame([([[c] for c in cells],)], "rows array<array<string>>")
    full = F.transform("rows", lambda row: F.transform(row, lambda c: documents.normalize_document_lines(documents.repair_double_encoding(c))))
    (row,) = frame.select(documents.clean_table_cells("rows").alias("got"), full.alias("want")).collect()
    assert row.got == row.want


@pytest.mark.parametrize("name", ["clean_table_cells", "clean_table_cells_nfkc"])
def test_cells_are_cleaned_once(tables, name):
    """An inner explode repeats the cleaning in a filter below it."""
    plan = PLANS[name](tables)._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" not in plan.split("Generate", 1)[1]


def test_only_questions_of_an_sql_pattern_are_routed_for_answers(spark):
    """Answers need no other question; the routes of those left are the same."""
    asked = [*QUESTION_TEMPLATES, None, "PREDICTED bed demand and how many beds are occupied?", "what is the  AVERAGE\n length of stay for the ICU?"]
    frame = spark.createDataFrame([(i, q and q.replace("#D#", "Asia")) for i, q in enumerate(asked)], "question_id int, question string")
    some = questions.sql_candidates(frame)
    whole, left = (sorted(map(tuple, questions.classify_questions(f).where("intent = 'sql'").collect())) for f in (frame, some))
    assert left == whole and 0 < len(whole) <= some.count() < len(asked) / 2


# --- retrieval -------------------------------------------------------------


def brute_search(asked, chunks, top=5):
    def words(text):
        return [w for w in re.findall(retrieval.TOKEN, text.lower()) if w not in retrieval.STOPWORDS and len(w) > 2]

    result = {}
    for q, question in asked:
        mine = words(question)
        counts, scored = Counter(mine), []
        for key, text in chunks:
            theirs = words(text)
            other = Counter(theirs)
            overlap = sum(min(n, other[w]) for w, n in counts.items())
            if overlap:
                phrase = 2.0 if " ".join(mine) in " ".join(theirs) else 0.0
                scored.append((-(overlap + 0.5 * sum(w in other for w in counts) + phrase), key))
        result[q] = [(k, -s) for s, k in sorted(scored)[:top]]
    return result


def test_lexical_search_is_exact(spark):
    generator = random.Random(11)
    common, rare = ["bed", "ward", "nurse", "care"], [f"term{i}" for i in range(60)]
    text = lambda n: " ".join(generator.choice(common * 6 + rare) for _ in range(n))
    chunks = [(i, text(generator.randint(1, 60))) for i in range(400)]
    asked = [(100 + i, text(generator.randint(1, 14))) for i in range(40)] + [(200, "art therapy"), (201, "the of"), (202, chunks[5][1]), (203, "term1 zzz bed")]
    chunks += [(900, "heart therapy ward"), (901, "therapy")]
    q = spark.createDataFrame(asked, "item_id bigint, text string")
    c = spark.createDataFrame(chunks, "chunk_id bigint, text string")
    got = {}
    for r in retrieval.lexical_search(q, c, "item_id", ["chunk_id"]).orderBy("item_id", "rank").collect():
        got.setdefault(r["item_id"], []).append((r["chunk_id"], r["score"]))
    assert got == {k: v for k, v in brute_search(asked, chunks).items() if v}


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_vector_search_in_blocks_equals_brute_force(spark, kind):
    generator = np.random.default_rng(5)
    data = generator.normal(size=(300, 8)).astype("float32")
    data[250:260] = data[0]  # ties, broken by the id
    vectors = [(f"{i:03}" if kind == "string" else i, [float(x) for x in v]) for i, v in enumerate(data)] + [("300" if kind == "string" else 300, [0.0] * 8)]
    frame = spark.createDataFrame(vectors, f"vec_id {kind}, embedding array<float>").repartition(3)
    asked = frame.select(F.col("vec_id").alias("query_id"), "embedding")
    rows = lambda size: sorted(tuple(r) for r in retrieval.vector_search(asked, frame, block_bytes=size).collect())
    names, matrix = [v[0] for v in vectors], np.array([v[1] for v in vectors])
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    unit = np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)
    scores = np.round(unit @ unit.T, 6)
    want = []
    for q, name in enumerate(names):
        best = sorted(range(len(names)), key=lambda v: (-scores[q, v], names[v]))[:5]
        want += [(name, rank, names[v], float(scores[q, v])) for rank, v in enumerate(best, 1)]
    got = rows(10**9)
    assert [r[:3] for r in got] == [r[:3] for r in sorted(want)] and np.allclose([r[3] for r in got], [r[3] for r in sorted(want)])
    assert rows(700) == got
    assert retrieval.vector_search(asked.where("false"), frame).count() == 0


def test_vector_search_keeps_queries_off_the_driver(spark, monkeypatch):
    """No query passes the driver, and repeated rows stay bounded without changing the result."""
    frame = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(60)], "vec_id bigint, embedding array<double>")
    asked = frame.select(F.col("vec_id").alias("query_id"), "embedding")

    def refused(*_):
        raise AssertionError("rows pass the driver")

    monkeypatch.setattr(type(frame), "toLocalIterator", refused)
    found = retrieval.vector_search(asked, frame, block_bytes=200, vector_bytes=400)
    plain = sorted(map(tuple, found.collect()))
    assert len(plain) == 300 and all(r[2:] == (i, 1.0) for i, r in enumerate(r for r in plain if r[1] == 1 and r[0] < 21))
    many = frame.union(frame.where("vec_id = 3").crossJoin(spark.range(50)).drop("id"))
    got = [(r.rank, r.vec_id) for r in retrieval.vector_search(asked.where("query_id = 3"), many, vector_bytes=400).collect()]
    assert sorted(got) == [(rank, 3) for rank in range(1, 6)]


def test_prototypes_with_other_labels(spark):
    kinds = [("rag", None, [0.0, 1.0]), ("sql", "beds", [1.0, 0.0]), ("sql", "beds", [0.99, 0.1]), ("sql", "los", [-1.0, 0.0])]
    prototypes = spark.createDataFrame([((a, b), v) for a, b, v in kinds], "label struct<intent:string,model:string>, embedding array<double>")
    vectors = spark.createDataFrame([("x", [1.0, 0.05]), ("y", [0.0, 2.0]), ("z", [0.68, 0.73])], "vec_id string, embedding array<double>")
    for size in (10**9, 16, 40):
        got = {r.vec_id: r.label and tuple(r.label) for r in retrieval.prototype_classify(vectors, prototypes, block_bytes=size).collect()}
        assert got == {"x": ("sql", "beds"), "y": ("rag", None), "z": None}
    assert retrieval.prototype_classify(vectors, prototypes.where("false")).count() == 0


def test_prototype_acceptance(spark):
    def unit(angle):
        return [float(np.cos(np.radians(angle))), float(np.sin(np.radians(angle)))]

    prototypes = spark.createDataFrame([(1, unit(0)), (1, unit(10)), (2, unit(90))], "label int, embedding array<double>")
    vectors = spark.createDataFrame([(0, unit(20)), (1, unit(50)), (2, unit(200)), (3, unit(0)), (4, [0.0, 0.0])], "vec_id bigint, embedding array<double>")
    got = {r["vec_id"]: r for r in retrieval.prototype_classify(vectors, prototypes).collect()}
    # Close and clear; halfway between labels; far from both; identical (confidence is capped); no direction.
    assert [got[i]["label"] for i in range(5)] == [1, None, None, 1, None]
    assert got[3]["confidence"] == 0.86 and got[0]["score"] == round(float(np.cos(np.radians(10))), 6)


def test_summary_sample_places(spark):
    frame = spark.range(1, 13).select(F.col("id").cast("int").alias("chunk_id"), F.lit(12).alias("chunk_count"))
    assert sorted(r["chunk_id"] - 1 for r in retrieval.summary_sample(frame).collect()) == [round(i * 11 / 4) for i in range(5)]


# --- roles, KPIs, charts, sources -------------------------------------------


@settings(max_examples=60, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.sampled_from(["bed", "total_beds", "los", "status", "device_type", "appt_id", "failure_date", "wait_days", "dept_name", "capacity", "x"]), max_size=6, unique=True))
def test_roles_are_columns_of_the_table(columns):
    for role, column in roles.roles_of(columns).items():
        assert column is None or column in columns, role


def test_role_fallbacks():
    assert roles.resolve(["device_id", "status"], "equipment_status") == "status"
    assert roles.resolve(["status"], "equipment_status") is None
    assert roles.resolve(["ward_capacity", "available_capacity"], "total_beds") == "ward_capacity"
    assert roles.modules_of(["Bed Type"]) == []


def test_kpis_skip_what_is_missing(spark):
    frame = spark.createDataFrame([("a", None), ("b", "x")], "admission_id string, length_of_stay string")
    assert {r["kpi"]: r["value"] for r in kpis.admission_kpis(frame).collect()} == {"Total Admissions": 2.0}


def test_time_chart_needs_two_periods(spark):
    frame = spark.createDataFrame([("2024-01-05",), ("not a date",), (None,)], "date string")
    assert charts.time_chart(frame, "date").isEmpty()


def test_coverage_row_when_nothing_is_found(spark, tables):
    chart = charts.group_chart(tables.events, "event_type", kind="donut").select(F.lit(0).alias("chart_no"), "*")
    (row,) = charts.insight_feed(chart, kpis.record_count(tables.events), []).collect()
    assert (row["insight"], row["label"]) == ("Dataset coverage", "general dataset")


def test_upload_encodings_and_emptiness(spark, tmp_path):
    (tmp_path / "latin.csv").write_bytes("Nom,Âge,Nom\nZoé,31,x\n".encode("latin-1"))
    frame = io.read_upload_csv(spark, str(tmp_path / "latin.csv"))
    assert frame.first()[0] == "Zoé" and frame.first()[1] == 31
    (tmp_path / "empty.csv").write_text("a,b\n")
    with pytest.raises(ValueError):
        io.read_upload_csv(spark, str(tmp_path / "empty.csv"))
    assert io.normal_names(["Dept ID", "dept-id", "", "--"]) == ["dept_id", "dept_id_2", "unnamed", "unnamed_2"]


def test_manifest_keeps_supported_files(spark, tmp_path):
    for name in ("b.PDF", "a.docx", "c.csv", "note.txt", "d.xlsx"):
        (tmp_path / name).write_text("x")
    rows = [(r["file_name"], r["file_type"], r["processing_type"], r["size"]) for r in io.file_manifest(spark, str(tmp_path)).collect()]
    assert rows == [("a.docx", "docx", "rag", 1), ("b.PDF", "pdf", "rag", 1), ("c.csv", "csv", "dataset", 1), ("d.xlsx", "xlsx", "dataset", 1)]


def test_chunk_store_reads_one_workspace(spark, tmp_path):
    frame = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "workspace_id string, chunk_id int, text string")
    io.write_chunk_store(frame, str(tmp_path / "s"))
    (tmp_path / "s" / "workspace_id=a" / "broken.parquet").write_text("not parquet")
    schema = "chunk_id int, text string, workspace_id string"
    assert [r["text"] for r in io.read_chunk_store(spark, str(tmp_path / "s"), schema, "a").collect()] == ["x"]
    assert io.read_chunk_store(spark, str(tmp_path / "s"), schema).count() == 2


def test_wrong_vector_length_is_refused(spark, tmp_path):
    frame = spark.createDataFrame([(1, [1.0, 2.0])], "vec_id bigint, embedding array<float>")
    io.write_embeddings(frame, str(tmp_path / "v"), "m", 3)
    with pytest.raises(Exception, match="recorded dimension"):
        io.read_embeddings(spark, str(tmp_path / "v"), "m").collect()


def test_month_gaps_are_filled(spark):
    frame = spark.createDataFrame([(datetime.date(2024, 1, 5),), (datetime.date(2024, 4, 1),), (None,)], "d date")
    assert [r["admissions"] for r in features.monthly_series(frame, "d").orderBy("month_start").collect()] == [1, 0, 0, 1]
    assert features.next_month_row(features.monthly_series(frame.limit(1), "d")).isEmpty()


def test_csv_keeps_quotes_commas_and_line_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('n,Full Text,k\n1,"he said ""hi"", ok",2\n3,"two\nlines, one field",4\n5, spaced ,6\n')
    got = [tuple(r) for r in io.read_upload_csv(spark, str(tmp_path / "a.csv")).collect()]
    assert got == [(1, 'he said "hi", ok', 2), (3, "two\nlines, one field", 4), (5, " spaced ", 6)]
    (tmp_path / "b.csv").write_bytes("n,text\n1,caf\xe9\n".encode("latin-1"))
    assert [tuple(r) for r in io.read_upload_csv(spark, str(tmp_path / "b.csv")).collect()] == [(1, "caf\xe9")]


def test_missing_failure_count_is_no_failure_and_rows_without_stratum_are_in_no_part(spark):
    units = spark.createDataFrame(
        [(1, 1, "x", "2020-01-01", "2021-01-01", 1.0, 1, None), (2, 1, "x", "2020-01-01", "2021-01-01", 1.0, 1, 3)],
        "equipment_id bigint, department_id int, equipment_type string, installation_date string, next_maintenance_date string, usage_hours double, maintenance_count int, failure_count int",
    )
    assert [r.failure_risk for r in features.equipment_features(units).orderBy("equipment_id").collect()] == [0, 1]
    frame = spark.createDataFrame([(i, None if i % 4 == 0 else i % 2) for i in range(200)], "id bigint, label int")
    parts = {r.id: r.is_train for r in features.stratified_split(frame, "id", "label").collect()}
    assert all((parts[i] is None) == (i % 4 == 0) for i in parts) and {True, False} <= set(parts.values())


def test_tables_that_match_no_module(spark):
    frame = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(9)], "k bigint, colour string")
    assert charts.group_tables(frame).count() == 0
    got = [(r.ord, r.label, r.value, r.dimension) for r in charts.dashboard_charts(frame).orderBy("ord").collect()]
    assert got == [(1, "a", 5.0, "colour"), (2, "b", 4.0, "colour")]
