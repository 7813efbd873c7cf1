"""Hospital tables derived from the retail benchmark tables.

Each text is valid in Spark SQL and in DuckDB. ``{name}`` marks an input: Spark
binds it to a DataFrame, the oracle to a view or an earlier CTE.
"""

from __future__ import annotations

import re

AS_OF = "1999-06-15"

DEPARTMENTS = """
SELECT n_nationkey AS department_id, n_name AS department_name, r_name AS department_type
FROM {nation} JOIN {region} ON n_regionkey = r_regionkey
"""

DEPARTMENTS_PARTIAL = """
SELECT department_id, department_name, department_type FROM {departments} WHERE department_id < 23
"""

ADMISSIONS = """
SELECT concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey) AS admission_id,
       o_custkey AS patient_id,
       s_nationkey AS department_id,
       CAST(l_shipdate AS DATE) AS admission_date,
       CAST(l_shipdate AS DATE) + CASE WHEN l_partkey % 89 = 0 THEN -1
            WHEN l_partkey % 97 = 0 THEN CAST(l_quantity AS INT) + 1
            ELSE CAST(l_quantity AS INT) END AS discharge_date,
       CASE l_returnflag WHEN 'A' THEN 'Elective' WHEN 'R' THEN 'Emergency' ELSE 'Urgent' END AS admission_type,
       CASE WHEN l_partkey % 20 = 0 THEN NULL ELSE CAST(l_partkey % 90 AS INT) END AS age,
       CASE WHEN o_custkey % 10 = 0 THEN NULL WHEN o_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender,
       CAST(l_quantity AS INT) AS length_of_stay,
       CASE WHEN l_suppkey % 15 = 0 THEN NULL WHEN l_linestatus = 'F' THEN 'General' ELSE 'ICU' END AS bed_type,
       CASE WHEN l_orderkey % 30 = 0 THEN NULL WHEN o_orderstatus = 'F' THEN 'Recovered'
            WHEN o_orderstatus = 'O' THEN 'Referred' ELSE 'Transferred' END AS discharge_status
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {supplier} ON l_suppkey = s_suppkey
"""

APPOINTMENTS = """
SELECT o_orderkey AS appointment_id,
       o_custkey AS patient_id,
       c_nationkey AS department_id,
       CAST(o_orderdate AS DATE) + CASE WHEN o_orderkey % 101 = 0 THEN -1
            ELSE CAST(o_orderkey % 31 AS INT) END AS appointment_date,
       CASE o_orderstatus WHEN 'O' THEN 'Consultation' WHEN 'F' THEN 'Follow-up' ELSE 'Diagnostic' END AS appointment_type,
       CAST(o_orderdate AS DATE) AS booking_date,
       CASE WHEN o_orderkey % 25 = 0 THEN NULL ELSE CAST(o_orderkey % 31 AS INT) END AS wait_time_days,
       CASE WHEN o_orderkey % 40 = 0 THEN NULL
            WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'Completed'
            WHEN o_orderpriority = '3-MEDIUM' THEN 'Cancelled'
            WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'No-Show' ELSE 'Rescheduled' END AS appointment_status
FROM {orders} JOIN {customer} ON o_custkey = c_custkey
"""

BED_DAYS = """
SELECT s_nationkey AS department_id, CAST(l_shipdate AS DATE) AS record_date,
       CAST(SUM(CAST(l_quantity AS INT)) AS INT) AS occupied_beds,
       CAST(SUM(CAST(l_quantity AS INT) + CAST(l_linenumber AS INT) * 4) AS INT) AS total_beds
FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey
GROUP BY s_nationkey, CAST(l_shipdate AS DATE)
"""

BEDS = """
SELECT concat(department_id, '-', record_date) AS bed_record_id, department_id, record_date,
       CASE WHEN department_id % 2 = 0 THEN 'General' ELSE 'ICU' END AS bed_type,
       total_beds,
       CASE WHEN total_beds % 211 = 0 THEN total_beds + 1 ELSE occupied_beds END AS occupied_beds,
       CASE WHEN total_beds % 53 = 0 THEN total_beds - occupied_beds + 1 ELSE total_beds - occupied_beds END AS available_beds,
       occupied_beds * 100.0e0 / total_beds AS occupancy_rate
FROM {bed_days}
"""

EQUIPMENT = """
SELECT p_partkey AS equipment_id,
       CAST(p_partkey % 25 AS INT) AS department_id,
       p_type AS equipment_type,
       CASE WHEN p_partkey % 71 = 0 THEN MAX(CAST(l_shipdate AS DATE)) ELSE MIN(CAST(l_shipdate AS DATE)) END AS installation_date,
       CASE WHEN p_size % 10 = 0 THEN NULL
            ELSE MAX(CASE WHEN l_returnflag = 'A' THEN CAST(l_shipdate AS DATE) END) END AS last_maintenance_date,
       CASE WHEN p_size % 10 = 0 THEN NULL ELSE MAX(CAST(l_shipdate AS DATE)) END AS next_maintenance_date,
       CASE p_size % 4 WHEN 0 THEN 'Out of Service' WHEN 1 THEN 'Under Maintenance' ELSE 'Operational' END AS equipment_status,
       SUM(l_quantity) * 10 AS usage_hours,
       CAST(SUM(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS INT) AS maintenance_count,
       CAST(SUM(CASE WHEN l_returnflag = 'R' AND l_quantity > 45 THEN 1 ELSE 0 END) AS INT) AS failure_count
FROM {part} JOIN {lineitem} ON p_partkey = l_partkey
GROUP BY p_partkey, p_type, p_size
"""

# Header vocabulary of the simulated uploads, deliberately untidy.
UPLOAD_HEADERS = (
    "Admission ID", "admission_date", "Admissions", "Total Admissions", "Admission-Type", "Admit Date", "Length of Stay",
    "LOS_Days", "Discharge Date", "Encounter Number", "patient_id", "Patient No.", "Patient Name", "e-mail", "Phone",
    "Appointment ID", "appt_status", "Appointment Status", "Appointment Date", "Booking Date", "No Show", "wait_time_days",
    "Waiting Time", "Number of Appointments", "Clinic Name", "Service Line", "Specialty", "Bed Type", "Total Beds",
    "Occupied Beds", "Available Beds", "Beds Occupied", "Occupancy Rate", "Bed Capacity", "occupied_capacity",
    "Available Capacity", "Utilization Percent", "Record Date", "Equipment ID", "Device Type", "Asset-Number",
    "Equipment Status", "Device Condition", "Failure Count", "failures", "Failure Date", "Maintenance Count",
    "maint events", "Usage Hours", "Operating Hours", "Installation Date", "next_maintenance_date", "Dept ID",
    "Department Name", "department", "Dept Type", "status", "State", "type", "Category", "Date", "timestamp", "Age",
    "Gender", "Notes", "", "--", "Ward #", "Region", "Cost (USD)", "Score", "Visit Reason", "MRN", "quantity_on_hand",
    "total_capacity", "Event Date", "Department Id", "hours_used", "Risk Score",
)

UPLOAD_CATALOG = """
SELECT l_partkey AS dataset_id,
       (l_orderkey * 10 + l_linenumber) * 1000000 + l_suppkey AS position,
       header AS column_name,
       CASE l_suppkey %% 3 WHEN 0 THEN 'bigint' WHEN 1 THEN 'double' ELSE 'string' END AS dtype
FROM {lineitem} JOIN (VALUES %s) AS headers(header_id, header)
  ON (l_orderkey * 7 + l_linenumber * 13 + l_suppkey) %% %d = header_id
""" % (
    ", ".join(f"({i}, '{h}')" for i, h in enumerate(UPLOAD_HEADERS)),
    len(UPLOAD_HEADERS),
)

# Question templates; the first twelve are the routing golden set.
QUESTION_TEMPLATES = (
    "What is the average length of stay?",
    "Which department has the most admissions?",
    "How many appointments were cancelled?",
    "How many beds are occupied?",
    "How many equipment units are operational?",
    "What problems were mentioned in the annual report?",
    "What does the quality report say about patient safety?",
    "What is the predicted bed demand next week?",
    "What is the predicted length of stay?",
    "What is the predicted equipment failure risk?",
    "What is the average LOS in #D#?",
    "DROP TABLE admissions",
    "Average   length of stay for the #D# department, please",
    "Forecast admissions for next month",
    "Predict no-show risk for tomorrow",
    "Summarize the uploaded document",
    "What are the major operational issues?",
    "Show bottlenecks in hospital operations performance",
    "Describe trends in the uploaded dataset",
    "Show the analyzed data",
    "Is the bed demand forecast consistent with the safety report?",
    "How many cancelled appointments and how many beds are occupied?",
    "Give the total admissions and the unique patients",
    "What is the peak LOS?",
    "How many departments are there?",
    "Which is the most common admission type?",
    "Which department has the highest admissions?",
    "What is the mean LOS and average wait?",
    "Highest admissions by department (#D#)",
    "Predicted admissions and predicted bed demand",
    "Thanks!",
    "   ",
)

QUESTION_LOG = """
SELECT o_orderkey AS question_id, replace(template, '#D#', n_name) AS question
FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey
JOIN (VALUES %s) AS templates(template_id, template) ON o_orderkey %% %d = template_id
UNION ALL
SELECT -1 - (conv_id * 1000 + turn) AS question_id, text AS question FROM {conversations}
""" % (
    ", ".join(f"({i}, '{t}')" for i, t in enumerate(QUESTION_TEMPLATES)),
    len(QUESTION_TEMPLATES),
)

FIXTURES = {
    "departments": DEPARTMENTS,
    "departments_partial": DEPARTMENTS_PARTIAL,
    "admissions": ADMISSIONS,
    "appointments": APPOINTMENTS,
    "bed_days": BED_DAYS,
    "beds": BEDS,
    "equipment": EQUIPMENT,
    "upload_catalog": UPLOAD_CATALOG,
    "question_log": QUESTION_LOG,
}


def inputs_of(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", text)))


def with_fixtures(body: str) -> str:
    """Prefix an oracle query with the CTEs of every fixture it names."""
    needed: list[str] = []

    def need(name: str) -> None:
        for dependency in inputs_of(FIXTURES[name]):
            if dependency in FIXTURES:
                need(dependency)
        if name not in needed:
            needed.append(name)

    for name in FIXTURES:
        if re.search(rf"\b{name}\b", body):
            need(name)
    ctes = []
    for name in needed:
        text = FIXTURES[name]
        ctes.append(f"{name} AS ({text.format(**{d: d for d in inputs_of(text)}).strip()})")
    body = body.strip()
    if not ctes:
        return body
    recursive = body.upper().startswith("WITH RECURSIVE")
    if body.upper().startswith("WITH"):
        body = re.sub(r"(?i)^with\s+(recursive\s+)?", ", ", body)
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(ctes) + "\n" + body
