"""Column roles: which physical column plays which part in an uploaded table.

The rule tables drive both the per-table lookup (a list of names on the driver)
and the catalogue-wide resolution in ``operators.catalog`` (a Spark aggregate).
"""

from __future__ import annotations

import re

# Accepted column names per role, best first.
ROLE_ALIASES = {
    "date": ("admission_date", "appointment_date", "record_date", "date", "event_date", "service_date", "timestamp", "datetime"),
    "department": ("department_id", "department_name", "department", "dept_id", "dept_name", "dept"),
    "admission_id": ("admission_id", "admission_number", "admission_no", "encounter_id"),
    "admission_count": ("admission_count", "total_admissions", "number_of_admissions", "admissions"),
    "admission_type": ("admission_type", "admit_type", "admission_category"),
    "appointment_id": ("appointment_id", "appointment_number", "appointment_no", "appt_id"),
    "appointment_count": ("appointment_count", "total_appointments", "number_of_appointments", "appointments"),
    "appointment_status": ("appointment_status", "appt_status", "status"),
    "length_of_stay": ("length_of_stay", "los_days", "stay_length", "length_stay"),
    "wait_time": ("wait_time_days", "wait_days", "waiting_time", "wait_time"),
    "patient_id": ("patient_id", "patient_number", "patient_no"),
    "total_beds": ("total_beds", "bed_capacity", "total_bed_count", "beds_available_total", "total_capacity"),
    "available_beds": ("available_beds", "beds_available", "available_bed_count", "available_capacity"),
    "occupied_beds": ("occupied_beds", "beds_occupied", "occupied_bed_count", "occupied", "occupied_capacity"),
    "occupancy_rate": ("occupancy_rate", "occupancy_percentage", "bed_occupancy_rate"),
    "equipment_id": ("equipment_id", "device_id", "asset_id"),
    "equipment_type": ("equipment_type", "device_type", "asset_type"),
    "equipment_status": ("equipment_status", "device_status", "operational_status"),
    "failure_count": ("failure_count", "failures", "number_of_failures"),
    "maintenance_count": ("maintenance_count", "maintenance_events"),
    "usage_hours": ("usage_hours", "hours_used"),
    "department_type": ("department_type", "dept_type"),
    "service": ("service", "service_line", "service_type", "clinic", "clinic_name", "specialty", "specialty_name", "appointment_service"),
}

# Fallback patterns. A name fits a role when it matches every pattern of one
# alternative; a pattern starting with "!" must not match.
ROLE_PATTERNS = {
    "date": [["date|timestamp|datetime"]],
    "department": [["department|^dept_"]],
    "admission_id": [["admission|admit|encounter", "_(id|number)$"]],
    "admission_count": [["admission", "count|total|number"]],
    "admission_type": [["admission", "type|category"]],
    "appointment_id": [["appointment|appt", "_(id|number)$"]],
    "appointment_count": [["appointment|appt", "count|total|number"]],
    "appointment_status": [["appointment|appt", "status|state"]],
    "length_of_stay": [["stay", "length|duration"], ["^(los|los_days)$"]],
    "wait_time": [["wait", "time|day|duration"]],
    "patient_id": [["patient", "_(id|number)$"]],
    "total_beds": [["bed", "total|capacity"], ["capacity", "!available|occupied"]],
    "available_beds": [["bed", "available"], ["available_capacity"]],
    "occupied_beds": [["bed", "occup"], ["occupied_capacity"]],
    "occupancy_rate": [["occupancy"], ["utilization", "rate|percent"]],
    "equipment_id": [["equipment|device|asset", "_(id|number)$"]],
    "equipment_type": [["equipment|device|asset", "type"]],
    "equipment_status": [["equipment|device|asset", "status|state|condition"]],
    "failure_count": [["fail", "count|total|number|quantity"], ["^(failures|equipment_failures)$"]],
    "maintenance_count": [["maint", "count|event|number"]],
    "usage_hours": [["usage|used|operating", "hour"]],
    "department_type": [["department|dept", "type"]],
    "service": [["service|clinic|specialty"]],
}

# Bare names that count once any equipment column is present.
EQUIPMENT_WORDS = "equipment|device|asset"
BARE_NAMES = {"equipment_status": ("status", "state", "condition"), "equipment_type": ("type", "category")}

# Names of failure events.
FAILURE_EVENT_PATTERNS = [["fail", "date|event|type|id"]]

# Module signals, in display order, in the form of the role patterns.
MODULES = (
    ("Admission Analytics", [["admission|admit_date|admitted|length_of_stay|los_days"]]),
    ("Appointment Analytics", [["appointment|appt_|no_show|noshow"]]),
    ("Bed & Capacity Analytics", [["bed|occupancy|capacity", "total|occupied|available|occupancy|capacity"]]),
    ("Equipment Analytics", [["equipment|device|asset"], ["failure|maintenance|usage"]]),
    ("Department Analytics", [["department|dept_"]]),
)

# Preferred date columns per module.
MODULE_DATES = {
    "Admission Analytics": ("admission_date", "admit_date", "admitted_at", "date_of_admission"),
    "Appointment Analytics": ("appointment_date", "scheduled_date", "appt_date"),
    "Bed & Capacity Analytics": ("record_date", "bed_date", "date"),
    "Equipment Analytics": ("record_date", "inspection_date", "service_date", "date"),
}

# What each model needs; a feature is met by a listed name or by a resolved role.
MODEL_FEATURES = {
    "admission_forecast": {"date": ("admission_date", "admit_date", "admitted_at", "date_of_admission")},
    "bed_forecast": {"date": ("record_date", "bed_date", "date", "observation_date"), "occupied_beds": "occupied_beds"},
    "equipment_failure": {
        "department_id": ("department_id", "department", "dept_id"),
        "equipment_type": "equipment_type",
        "usage_hours": "usage_hours",
        "maintenance_count": "maintenance_count",
        "installation_date": ("installation_date", "installed_date"),
        "next_maintenance_date": ("next_maintenance_date", "maintenance_due_date"),
    },
    "equipment_priority": {"equipment_id": ("equipment_id", "equipmentid", "equipment", "device_id", "deviceid")},
}

# Names that may identify a person, for previews and for charts.
SENSITIVE = "patient|mrn|ssn|email|phone|address|date_of_birth|dob|first_name|last_name"
PERSON_LEVEL = "patient|name|email|mrn|_id|identifier"


def normal_name(text: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", text.strip().lower()).strip("_") or "unnamed"


def fits(name: str, alternatives: list[list[str]]) -> bool:
    def holds(pattern: str) -> bool:
        return not re.search(pattern[1:], name) if pattern.startswith("!") else bool(re.search(pattern, name))

    return any(all(holds(p) for p in patterns) for patterns in alternatives)


def resolve(columns: list[str], role: str) -> str | None:
    """The column of one table that plays ``role``, from its names alone."""
    exact = [a for a in ROLE_ALIASES.get(role, ()) if a in columns]
    if exact:
        return exact[0]
    fallback = FAILURE_EVENT_PATTERNS if role == "failure_event" else ROLE_PATTERNS.get(role, [])
    matching = [c for c in columns if fits(c, fallback)]
    if not matching and any(re.search(EQUIPMENT_WORDS, c) for c in columns):
        matching = [c for c in columns if c in BARE_NAMES.get(role, ())]
    return matching[0] if matching else None


def roles_of(columns: list[str]) -> dict[str, str | None]:
    return {role: resolve(columns, role) for role in (*ROLE_ALIASES, "failure_event")}


def modules_of(columns: list[str]) -> list[str]:
    names = [normal_name(c) for c in columns]
    return [module for module, signals in MODULES if any(fits(n, signals) for n in names)]
