"""Batch routing and answering of question logs.

Questions are the large table; rules, KPIs and result tables are small and are
met through one-row lookups or joins on words.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlens.functions import routing
from wardlens.functions.scalars import any_of, collapse_whitespace, compute_once, explode_once, lookup, scalar
from wardlens.operators import reports


def _says(text: Column, pattern: str) -> Column:
    return text.rlike(f"(?iU){pattern}")


def department_in(text: Column) -> Column:
    """A department named after ``in`` or ``for``; NULL when absent or longer than 80 characters."""
    found = F.regexp_extract(text, f"(?iU){routing.DEPARTMENT}", 1)
    name = F.btrim(collapse_whitespace(found), F.lit(routing.DEPARTMENT_EDGES))
    return F.when((name != "") & (F.length(name) <= 80), name)


def classify_questions(questions: DataFrame, key: str = "question_id", text: str = "question") -> DataFrame:
    """``(key, intent, confidence, model, department)`` from wording alone.

    Every pattern is tested once per row; precedence is a single CASE.
    """
    clean = collapse_whitespace(F.coalesce(F.col(text), F.lit("")))

    def matches(patterns) -> Column:
        return F.array_compact(F.array(*[F.when(_says(F.col("text"), p), F.lit(name)) for name, p in patterns]))

    def said(patterns) -> Column:
        return any_of([_says(F.col("text"), p) for p in patterns])

    flagged = compute_once(
        questions.select(F.col(key), clean.alias("text")),
        [key, "text"],
        {
            "ml": matches(routing.ML_PATTERNS),
            "document": said(routing.DOCUMENT_PATTERNS),
            "operational": said(routing.OPERATIONAL_PATTERNS),
            "sql": matches(routing.SQL_PATTERNS),
            "dataset": said(routing.DATASET_PATTERNS),
            "statement": _says(F.col("text"), routing.RAW_SQL),
        },
    )

    def route(intent: str, confidence: float, model: Column | None = None) -> Column:
        return F.struct(F.lit(intent).alias("intent"), F.lit(confidence).alias("confidence"), (F.lit(None).cast("string") if model is None else model).alias("model"))

    ml, sql = F.size("ml"), F.size("sql")
    chosen = (
        F.when(F.col("text") == "", route("clarify", 0.0))
        .when((ml == 1) & ~F.col("document"), route("ml", 0.96, F.get("ml", F.lit(0))))
        .when(ml >= 1, route("clarify", 0.35))
        .when(F.col("document"), route("rag", 0.94))
        .when(F.col("operational"), route("dataset", 0.90))
        .when(sql == 1, route("sql", 0.93, F.get("sql", F.lit(0))))
        .when(sql > 1, route("clarify", 0.30))
        .when(F.col("dataset"), route("dataset", 0.78))
        .when(F.col("statement"), route("clarify", 0.10))
        .otherwise(route("clarify", 0.20))
    )
    routed = flagged.select(key, "text", chosen.alias("route"))
    department = F.when(F.col("route.model") == "average_length_of_stay", department_in(F.col("text")))
    # A forecast of the stay shares no model name with the average, so only SQL answers carry a department.
    return routed.select(key, "route.intent", "route.confidence", "route.model", department.alias("department"))


def sql_candidates(questions: DataFrame, key: str = "question_id", text: str = "question") -> DataFrame:
    """Questions that some SQL pattern matches, ``(key, text)``: no other can be routed to SQL, so the rest need no more patterns."""
    clean = compute_once(questions, [key], {text: collapse_whitespace(F.coalesce(F.col(text), F.lit("")))})
    return clean.where(any_of([_says(F.col(text), p) for _, p in routing.SQL_PATTERNS]))


def extract_department(questions: DataFrame, key: str = "question_id", text: str = "question") -> DataFrame:
    return questions.select(key, department_in(collapse_whitespace(F.coalesce(F.col(text), F.lit("")))).alias("department"))


def intent_summary(routed: DataFrame) -> DataFrame:
    return routed.groupBy("intent", "model").agg(F.count(F.lit(1)).alias("questions"))


def _words(text: Column) -> Column:
    return F.transform(F.split(text, "\\s+"), lambda w: F.btrim(F.lower(w), F.lit(routing.WORD_EDGES)))


def question_words(questions: DataFrame, key: str = "question_id", text: str = "question") -> DataFrame:
    """Distinct words per question; words of up to two characters are ignored before punctuation is cut."""
    long = F.filter(F.split(collapse_whitespace(text), " "), lambda w: F.length(w) > 2)
    bare = F.transform(long, lambda w: F.btrim(F.lower(w), F.lit(routing.WORD_EDGES)))
    return compute_once(questions, [key], {"words": F.array_distinct(bare)})


def _matched(questions: DataFrame, key: str, labels: DataFrame, label_key: str, label: Column) -> DataFrame:
    """Distinct (question, label) pairs that share a word; ``labels`` is a short list."""
    asked = explode_once(question_words(questions, key), [key], "words").select(key, F.col("item").alias("word"))
    offered = labels.select(label_key, F.explode(F.array_distinct(_words(label))).alias("word"))
    return asked.join(offered, "word").select(key, label_key).distinct()


def match_kpis(questions: DataFrame, kpis: DataFrame, key: str = "question_id", most: int = 10, default: int = 6) -> DataFrame:
    """KPIs whose label shares a word with the question, at most ``most``; else the first ``default``.

    ``kpis`` is ``(kpi_no, kpi, value)``, one short list.
    """
    pairs = _matched(questions, key, kpis, "kpi_no", F.translate("kpi", "_", " "))
    order = F.row_number().over(Window.partitionBy(key).orderBy("kpi_no"))
    found = pairs.withColumn("nth", order).where(F.col("nth") <= most).join(kpis, "kpi_no").select(key, "kpi", "value", F.lit(True).alias("matched"))
    first = kpis.orderBy("kpi_no").limit(default)
    usual = scalar(first, F.collect_list(F.struct("kpi", "value")))
    rest = questions.select(key).join(pairs, key, "left_anti").select(key, F.explode(usual).alias("k"))
    return found.unionByName(rest.select(key, "k.kpi", "k.value", F.lit(False).alias("matched")))


def match_tables(questions: DataFrame, tables: DataFrame, key: str = "question_id", rows: int = 3) -> DataFrame:
    """First rows of each result table whose title or columns share a word with the question.

    ``tables`` is ``(title, columns, ord, label, value)``.
    """
    titles = tables.select("title", "columns").distinct()
    pairs = _matched(questions, key, titles, "title", F.translate(F.concat_ws(" ", "title", "columns"), "_", " "))
    return pairs.join(tables.where(F.col("ord") <= rows), "title").select(key, "title", "ord", "label", "value")


def highest_admissions_answer(questions: DataFrame, admissions_table: DataFrame, key: str = "question_id") -> DataFrame:
    """Top department for questions that ask for the highest admissions. The table is ``(label, value)``."""
    words = question_words(questions, key)
    asks = F.arrays_overlap("words", F.lit(list(routing.HIGHEST_WORDS))) & F.arrays_overlap("words", F.lit(list(routing.ADMISSION_WORDS)))
    top = admissions_table.orderBy(F.desc("value"), "label").limit(1).select(F.struct("label", "value").alias("top")).scalar()
    return words.where(asks).select(key, top.getField("label").alias("department"), top.getField("value").alias("admissions"))


def lookup_answers(kpis: DataFrame, charts: DataFrame) -> DataFrame:
    """One answer per lookup rule that has one: ``(rule, label, value)``."""
    parts = []
    for rule, _, source, pattern in routing.LOOKUPS:
        if source == "kpi":
            hit = kpis.where(_says(F.col("kpi"), pattern)).orderBy("kpi_no").limit(1)
            parts.append(hit.select(F.lit(rule).alias("rule"), F.col("kpi").alias("label"), "value"))
        else:
            points = charts.where(_says(F.col("title"), pattern)).orderBy("chart_no", F.desc("value"), "label").limit(1)
            parts.append(points.select(F.lit(rule).alias("rule"), "label", "value"))
    return reduce(DataFrame.unionByName, parts)


def kpi_phrase_lookup(questions: DataFrame, answers: DataFrame, key: str = "question_id", text: str = "question") -> DataFrame:
    """The first rule whose phrase the question contains and that has an answer."""
    table = lookup(answers, "rule", F.struct("label", "value"))
    lowered = F.lower(text)
    hits = [F.when(any_of([lowered.contains(p) for p in phrases]), F.lit(rule)) for rule, phrases, _, _ in routing.LOOKUPS]
    matched = compute_once(questions, [key], {"rules": F.array_compact(F.array(*hits))})
    asked = matched.where("size(rules) > 0").withColumn("answers", table)
    rule = F.get(F.filter("rules", lambda r: F.map_contains_key("answers", r)), F.lit(0))
    return (
        asked.select(key, "answers", rule.alias("rule"))
        .where("rule IS NOT NULL")
        .select(key, "rule", F.try_element_at("answers", F.col("rule")).alias("answer"))
        .select(key, "rule", "answer.label", "answer.value")
    )


def answer_questions(routed: DataFrame, admissions, appointments, beds, equipment, departments, as_of: str, key: str = "question_id") -> DataFrame:
    """One figure per SQL question: ``(key, model, department, label, value)``.

    Figures are computed once as keyed rows (model, department or NULL) and joined.
    """

    def keyed(frame: DataFrame, model: str, value: str, label: str | None = None, department: str | None = None) -> DataFrame:
        return frame.select(
            F.lit(model).alias("model"),
            (F.lower(department) if department else F.lit("")).alias("place"),
            (F.col(label) if label else F.lit(None)).cast("string").alias("label"),
            F.col(value).cast("double").alias("value"),
        )

    by_department = reports.avg_los_by_department(admissions, departments)
    figures = [
        keyed(reports.hospital_avg_los(admissions), "average_length_of_stay", "average_length_of_stay"),
        keyed(by_department, "average_length_of_stay", "average_length_of_stay", department="department_name"),
        keyed(reports.busiest_department(admissions, departments), "most_admissions", "total_admissions", label="department_name"),
        keyed(
            reports.cancelled_last_month(appointments, as_of).where("appointment_records > 0"),
            "cancelled_appointments_last_month", "cancelled_appointments",
        ),
        keyed(reports.occupied_beds_latest(beds), "occupied_beds", "occupied_beds", label="record_date"),
        keyed(reports.operational_equipment_count(equipment), "operational_equipment", "operational_equipment"),
    ]
    figures = reduce(DataFrame.unionByName, figures)
    asked = routed.where("intent = 'sql'").withColumn("place", F.coalesce(F.lower("department"), F.lit("")))
    return asked.join(figures, ["model", "place"], "left").select(key, "model", "department", "label", "value")
