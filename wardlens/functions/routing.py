"""Wording rules that route a question. Matching ignores case; order is priority."""

ML_PATTERNS = (
    (
        "bed_forecast",
        r"\b(?:predict(?:ed|ion)?|forecast(?:ing)?)\b.{0,50}\b(?:bed demand|occupied beds|bed capacity)\b"
        r"|\b(?:bed demand|occupied beds|bed capacity)\b.{0,50}\b(?:predict(?:ed|ion)?|forecast(?:ing)?)\b",
    ),
    (
        "length_of_stay",
        r"\b(?:predict(?:ed|ion)?|forecast(?:ing)?)\b.{0,50}\b(?:length of stay|\blos\b)\b"
        r"|\b(?:length of stay|\blos\b)\b.{0,50}\b(?:predict(?:ed|ion)?|forecast(?:ing)?)\b",
    ),
    (
        "equipment_failure",
        r"\b(?:predict(?:ed|ion)?|forecast(?:ing)?|risk)\b.{0,50}\b(?:equipment|device|failure)\b"
        r"|\b(?:equipment|device)\b.{0,50}\b(?:failure risk|risk prediction|predicted failure)\b",
    ),
    (
        "appointment_no_show",
        r"\b(?:predict(?:ed|ion)?|risk)\b.{0,50}\b(?:no[ -]?show|missed appointment)\b"
        r"|\b(?:no[ -]?show|missed appointment)\b.{0,50}\b(?:predict(?:ed|ion)?|risk)\b",
    ),
    (
        "admission_forecast",
        r"\b(?:predict(?:ed|ion)?|forecast(?:ing)?)\b.{0,50}\b(?:admissions?|admission demand)\b"
        r"|\b(?:admissions?|admission demand)\b.{0,50}\b(?:predict(?:ed|ion)?|forecast(?:ing)?)\b",
    ),
)

DOCUMENT_PATTERNS = (
    r"\b(?:annual|quality|safety|inspection|policy|incident)\s+report\b",
    r"\b(?:uploaded|attached|selected)\s+(?:document|report|file)\b",
    r"\b(?:what did|what does|according to|mentioned in|stated in|said in|summari[sz]e)\b.{0,100}\b(?:report|document|policy|file|annual|quality|safety)\b",
    r"\b(?:report|document|policy)\b.{0,100}\b(?:mention|say|state|recommend|patient safety|summari[sz]e)\b",
    r"\b(?:summarize|summarise|analyze|analyse|review|explain)\b.{0,80}\b(?:report|document|annual report|quality report|safety report)\b",
    r"\b(?:according to|based on|from)\b.{0,60}\b(?:the\s+)?(?:report|document|annual report|quality report|safety report)\b",
    r"\b(?:summarize|summary|give\s+me\s+a\s+summary|provide\s+a\s+summary)\b.{0,60}\b(?:uploaded|document|report|file)\b",
    r"\b(?:uploaded|document|report|file)\b.{0,60}\b(?:summarize|summary)\b",
)

OPERATIONAL_PATTERNS = (
    r"\b(?:major|main|key|important|critical|top)?\s*\b(?:operational|operations)\b.{0,30}\b(?:issues?|problems?|challenges?|concerns?)\b",
    r"\b(?:major|main|key|important|critical|top)\b.{0,30}\b(?:issues?|problems?|challenges?|concerns?)\b",
    r"\b(?:issues?|problems?|challenges?|concerns?)\b.{0,40}\b(?:identified|reported|described|discussed|highlighted|outlined)\b",
    r"\bwhat\s+(?:are|were)\b.{0,50}\b(?:major|main|key|important|critical|top)\b.{0,30}\b(?:issues?|problems?|challenges?|concerns?)\b",
    r"\b(?:operational|operations)\b.{0,40}\b(?:performance|performance issues|bottlenecks?|inefficiencies?|gaps?)\b",
    r"\b(?:admission|admissions|appointment|appointments|bed|beds|equipment|capacity|wait|waiting)\b.{0,50}"
    r"\b(?:issue|issues|problem|problems|challenge|challenges|concern|concerns|bottleneck|inefficienc)\b",
)

SQL_PATTERNS = (
    (
        "average_length_of_stay",
        r"\b(?:average|avg)\b.{0,35}\b(?:length of stay|\blos\b)\b|\b(?:length of stay|\blos\b)\b.{0,35}\b(?:average|avg)\b",
    ),
    (
        "most_admissions",
        r"\b(?:which|what)\s+department\b.{0,50}\b(?:most|highest|largest|maximum)\b.{0,25}\badmissions?\b"
        r"|\b(?:most|highest|largest)\s+admissions?\b.{0,35}\bdepartment\b",
    ),
    (
        "cancelled_appointments_last_month",
        r"\b(?:how many|count|number of)\b.{0,45}\bappointments?\b.{0,25}\b(?:cancelled|canceled)\b|\b(?:cancelled|canceled)\s+appointments?\b",
    ),
    (
        "occupied_beds",
        r"\b(?:how many|count|number of)\b.{0,35}\bbeds?\b.{0,20}\boccupied\b|\b(?:occupied beds|beds occupied)\b",
    ),
    (
        "operational_equipment",
        r"\b(?:how many|count|number of)\b.{0,40}\bequipment\b.{0,20}\b(?:operational|working|active)\b"
        r"|\b(?:operational|working|active)\s+equipment\s+(?:units?|devices?)\b",
    ),
)

DATASET_PATTERNS = (
    r"\b(?:in|from|within|across)\s+(?:the\s+)?(?:uploaded|analyzed|analysed|current)\s+dataset\b",
    r"\b(?:uploaded|analyzed|analysed)\s+(?:data|dataset|file)\b",
)

RAW_SQL = r"^\s*(?:select|insert|update|delete|drop|create|alter|truncate|grant|revoke)\b"
DEPARTMENT = r"\b(?:in|for)\s+([A-Za-z][A-Za-z0-9 &'/-]{1,60}?)(?:\s+department\b|[?.!,;]|$)"
DEPARTMENT_EDGES = " \t.,?!:;-"

# Phrases that ask for one figure, the source it is read from, and the pattern of its label.
LOOKUPS = (
    ("average_los", ("average los", "average length of stay", "mean los"), "kpi", "average.*(los|length of stay)"),
    ("total_admissions", ("total admissions", "how many admissions", "number of admissions"), "kpi", "total.*admission"),
    (
        "top_department",
        ("highest admissions", "most admissions", "highest admission department", "department has the highest"),
        "chart",
        "admission.*department|department.*admission",
    ),
    (
        "top_admission_type",
        ("most common admission type", "highest admission type", "most common type"),
        "chart",
        "admission.*type|type.*admission",
    ),
    ("peak_los", ("peak los", "maximum los", "highest length of stay"), "kpi", "peak.*(los|length of stay)|maximum.*(los|length of stay)"),
    ("unique_patients", ("unique patients", "number of unique patients"), "kpi", "unique.*patient"),
    ("departments", ("how many departments", "number of departments"), "kpi", "^departments?$"),
)

HIGHEST_WORDS = ("highest", "most", "largest", "maximum")
ADMISSION_WORDS = ("admission", "admissions")
WORD_EDGES = ".,?!:;()"
