"""D: documents."""

from pyspark.sql import functions as F

from wardlens.functions.scalars import WHITESPACE, explode_once
from wardlens.operators import catalog
from wardlens.operators import documents as op
from wardlens.plans.registry import query

STRIP = lambda e: f"regexp_replace({e}, '^{WHITESPACE}+|{WHITESPACE}+$', '', 'g')"
COLLAPSE = lambda e: STRIP(f"regexp_replace({e}, '{WHITESPACE}+', ' ', 'g')")
CLEAN = lambda e: STRIP(f"regexp_replace(regexp_replace({e}, '[\\x00 \\t]+', ' ', 'g'), '\\n{{3,}}', '\\n\\n', 'g')").replace("'\\n\\n'", "chr(10) || chr(10)")


def lines_sql(text):
    plain = f"regexp_replace(regexp_replace(regexp_replace({text}, '\\r\\n|\\r', chr(10), 'g'), '\\x{{a0}}', ' ', 'g'), '[\\x{{200b}}\\x{{200c}}\\x{{200d}}\\x{{feff}}]', '', 'g')"
    trimmed = STRIP("regexp_replace(l, '[ \\t]+', ' ', 'g')")
    return f"array_to_string(list_filter(list_transform(string_split({plain}, chr(10)), lambda l: {trimmed}), lambda l: l <> ''), chr(10))"


def windows_sql(text, size=1000, overlap=200, stop=True):
    """List of stripped windows of a text already held in a column."""
    step = size - overlap
    count = f"CAST(ceil((length({text}) - {overlap if stop else 0}) / {step}e0) AS INT)"
    piece = STRIP(f"substring({text}, CAST(i AS INT) * {step} + 1, {size})")
    return f"""CASE WHEN length({text}) > 0 THEN list_filter(list_transform(range(GREATEST({count}, 1)), lambda i: {piece}), lambda p: p <> '') ELSE CAST([] AS VARCHAR[]) END"""


def unnest_sql(keys, source):
    return f"SELECT {keys}, CAST(len(chunks) AS INT) AS chunk_count, unnest(range(len(chunks))) + 1 AS chunk_id, unnest(chunks) AS text FROM {source}"


# Untidy variants of the documents: control characters, tabs, long gaps, foreign line ends, invisible characters.
SPOILED = "replace(replace(text, ' e', chr(9) || chr(9) || ' e'), chr(10), chr(10) || chr(10) || chr(10) || chr(10))"
FOREIGN = "replace(replace(replace(text, chr(10), chr(13) || chr(10) || ' ' || chr(13)), ', ', ',' || chr(160) || chr(9)), '. ', chr(8203) || '.  ')"
FOREIGN_SPARK = "replace(replace(replace(text, chr(10), concat(chr(13), chr(10), ' ', chr(13))), ', ', concat(',', chr(160), chr(9))), '. ', concat(decode(unhex('E2808B'), 'UTF-8'), '.  '))"
SPOILED_SPARK = "replace(replace(text, ' e', concat(chr(9), chr(9), ' e')), chr(10), concat(chr(10), chr(10), chr(10), chr(10)))"


@query("clean_document_text", f"SELECT doc_id, {CLEAN(SPOILED)} AS text FROM documents")
def _(t):
    return t.documents.select("doc_id", F.expr(SPOILED_SPARK).alias("text")).withColumn("text", op.clean_document_text("text"))


@query("normalize_document_lines", f"SELECT doc_id, {lines_sql(FOREIGN)} AS text FROM documents")
def _(t):
    return t.documents.select("doc_id", F.expr(FOREIGN_SPARK).alias("text")).withColumn("text", op.normalize_document_lines("text"))


@query("clean_text")
def _(t):
    return t.documents.select("doc_id", F.expr(FOREIGN_SPARK).alias("text")).withColumn("text", op.clean_text("text"))


BYTES = lambda low, high: f"len(regexp_extract_all(text, '[\\x{{{low}}}-\\x{{{high}}}]'))"


MISREAD = "array_to_string(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda b: chr(CAST(concat('0x', b) AS INTEGER))), '')"


@query("repair_double_encoding", f"""SELECT doc_id, changed, CASE WHEN changed THEN text ELSE {MISREAD} END AS text FROM (SELECT doc_id, text,
    {BYTES('80', 'ff')} + {BYTES('2000', '2fff')} + {BYTES('10000', '3ffff')} > len(regexp_extract_all(text, '[âÂÃð]')) AS changed FROM documents)""")
def _(t):
    # Every document misread once; repair must give the original back wherever it lowers the marker count, and else change nothing.
    misread = t.documents.select("doc_id", F.decode(F.encode("text", "UTF-8"), "ISO-8859-1").alias("misread"))
    fixed = misread.withColumn("text", op.repair_double_encoding("misread"))
    return fixed.select("doc_id", (F.col("text") != F.col("misread")).alias("changed"), "text")


FLAT = f"flat AS (SELECT doc_id, {COLLAPSE('text')} AS flat FROM documents)"
FIXED = f"{FLAT}, cut AS (SELECT doc_id, {windows_sql('flat')} AS chunks FROM flat), fixed AS ({unnest_sql('doc_id', 'cut')})"


@query("fixed_chunks", f"WITH {FIXED} SELECT * FROM fixed")
def _(t):
    return op.fixed_chunks(t.documents)


def fold_sql(source):
    """Greedy paragraph packing as a recursive query, one paragraph per step."""
    paragraphs = f"list_filter(list_transform(regexp_split_to_array({CLEAN('text')}, '\\n{WHITESPACE}*\\n'), lambda p: {STRIP('p')}), lambda p: p <> '')"
    flushed = f"CASE WHEN cur <> '' THEN list_append(done, {STRIP('cur')}) ELSE done END"
    return f"""WITH RECURSIVE paras AS (SELECT doc_id, {paragraphs} AS ps FROM {source}),
    fold AS (SELECT doc_id, ps, 1 AS i, '' AS cur, CAST([] AS VARCHAR[]) AS done FROM paras
      UNION ALL SELECT doc_id, ps, i + 1,
        CASE WHEN length(p) > 1800 THEN '' WHEN length(joined) <= 1800 THEN joined WHEN length(carried) <= 1800 THEN carried ELSE '' END,
        CASE WHEN length(p) > 1800 THEN list_concat(flushed, {windows_sql('p', 1800, 250)}) WHEN length(joined) <= 1800 THEN done
          WHEN length(carried) <= 1800 THEN flushed ELSE list_concat(flushed, {windows_sql('carried', 1800, 250, stop=False)}) END
      FROM (SELECT doc_id, ps, i, p, done, CASE WHEN cur = '' THEN p ELSE cur || chr(10) || chr(10) || p END AS joined,
          right(cur, 250) || chr(10) || chr(10) || p AS carried, {flushed} AS flushed FROM (SELECT *, ps[i] AS p FROM fold WHERE i <= len(ps)))),
    cut AS (SELECT doc_id, list_filter({flushed}, lambda c: length(c) >= 20) AS chunks FROM fold WHERE i = len(ps) + 1)
    {unnest_sql('doc_id', 'cut')}"""


@query("paragraph_chunks", fold_sql("documents"))
def _(t):
    return op.paragraph_chunks(t.documents)


@query("paragraph_chunks_lines", fold_sql("(SELECT doc_id, replace(text, chr(10), chr(10) || ' ' || chr(10)) AS text FROM documents)"))
def _(t):
    # Every line a paragraph, so packing, carried tails and long paragraphs all occur.
    return op.paragraph_chunks(t.documents.select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n \n")).alias("text")))


@query("page_chunks", f"""WITH flat AS (SELECT conv_id, turn, {COLLAPSE('text')} AS flat FROM conversations),
    cut AS (SELECT conv_id, turn, {windows_sql('flat')} AS chunks FROM flat), pieces AS (SELECT conv_id, turn, unnest(range(len(chunks))) AS k, unnest(chunks) AS text FROM cut)
    SELECT conv_id, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn, k) AS chunk_id, turn AS page_number, text FROM pieces""")
def _(t):
    return op.page_chunks(t.conversations, "conv_id", "turn")


def sectioned(t):
    """Documents with each line as a styled paragraph and as a row of one table."""
    return t.documents.select(
        "doc_id",
        F.expr("""transform(split(text, '\\n'), (l, i) -> struct(l AS text, CASE i % 3 WHEN 0 THEN 'Heading' WHEN 1 THEN '' ELSE 'Normal' END AS style))""").alias("paragraphs"),
        F.expr("""array(struct(1 AS table_number, transform(split(text, '\\n'), l -> transform(split(l, '[,.]', -1), (c, k) -> CASE WHEN k % 4 = 3 THEN NULL ELSE c END)) AS rows))""").alias("tables"),
    )


LINES = "string_split(text, chr(10))"
PARAGRAPHS = f"""list_transform({LINES}, lambda l, i: CASE (i - 1) % 3 WHEN 0 THEN 'Heading: ' || l WHEN 1 THEN l ELSE 'Normal: ' || l END)"""
ROWS = f"list_transform({LINES}, lambda l: list_transform(regexp_split_to_array(l, '[,.]'), lambda c, k: CASE WHEN (k - 1) % 4 = 3 THEN NULL ELSE c END))"


@query("section_chunks", f"""WITH p AS (SELECT doc_id, unnest(range(len({LINES}))) AS part, unnest({PARAGRAPHS}) AS raw FROM documents),
    c AS (SELECT doc_id, unnest(range(len({LINES}))) AS part, unnest({ROWS}) AS cells FROM documents),
    r AS (SELECT doc_id, part, list_filter(list_transform(cells, lambda x: {COLLAPSE("COALESCE(x, '')")}), lambda x: x <> '') AS kept FROM c),
    u AS (SELECT doc_id, 0 AS kind, part, {COLLAPSE('raw')} AS flat FROM p
      UNION ALL SELECT doc_id, 1, part, CASE WHEN len(kept) > 0 THEN 'Table 1: ' || array_to_string(kept, ' | ') ELSE '' END FROM r),
    w AS (SELECT doc_id, kind, part, {windows_sql('flat')} AS chunks FROM u),
    x AS (SELECT doc_id, kind, part, unnest(range(len(chunks))) AS k, unnest(chunks) AS text FROM w)
    SELECT doc_id, ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY kind, part, k) AS chunk_id, CASE kind WHEN 0 THEN 'paragraph' ELSE 'table' END AS section,
    CASE kind WHEN 1 THEN 1 END AS table_number, text FROM x""")
def _(t):
    return op.section_chunks(sectioned(t))


@query("clean_table_cells", f"""WITH c AS (SELECT doc_id, unnest(range(len({LINES}))) + 1 AS row_id, unnest({ROWS}) AS cells FROM documents)
    SELECT doc_id, row_id, array_to_string(list_transform(cells, lambda x: {lines_sql("COALESCE(x, '')")}), '|') AS cells FROM c""")
def _(t):
    # Pseudo-French text holds no double-encoding; the repair step leaves it alone.
    tables = sectioned(t).select("doc_id", op.clean_table_cells(F.col("tables")[0].getField("rows")).alias("rows"))
    return explode_once(tables, ["doc_id"], "rows").select("doc_id", (F.col("position") + 1).alias("row_id"), F.array_join("item", "|").alias("cells"))


@query("clean_table_cells_nfkc")
def _(t):
    tables = sectioned(t).select("doc_id", op.clean_table_cells(F.col("tables")[0].getField("rows"), compatibility=True).alias("rows"))
    return explode_once(tables, ["doc_id"], "rows").select("doc_id", F.array_join("item", "|").alias("cells"))


PROFILE = f"""profiled AS (SELECT doc_id, CAST(length(text) - len({LINES}) + 1 AS BIGINT) AS total_text_characters, 1 AS total_tables, CAST(NULL AS INT) AS total_pages,
    len({LINES}) AS total_paragraphs FROM documents)"""


@query("document_profile", f"WITH {PROFILE} SELECT * FROM profiled")
def _(t):
    return op.document_profile(sectioned(t))


@query("page_profile", "SELECT conv_id AS doc_id, CAST(SUM(length(text)) AS BIGINT) AS total_text_characters, 0 AS total_tables, COUNT(*) AS total_pages, 0 AS total_paragraphs FROM conversations GROUP BY conv_id")
def _(t):
    return op.page_profile(t.conversations, "conv_id")


@query("document_capabilities", f"""WITH {PROFILE}, l AS (SELECT doc_id, CASE WHEN total_text_characters > 0 THEN
    ['Document summarization', 'Document question answering', 'Document search / RAG', 'Table analysis', 'KPI extraction candidate', 'Document comparison']
    ELSE ['Table analysis', 'KPI extraction candidate'] END AS c FROM profiled)
    SELECT doc_id, unnest(range(len(c))) AS capability_order, unnest(c) AS capability FROM l""")
def _(t):
    return catalog.document_capabilities(op.document_profile(sectioned(t)))


@query("document_normal_form", f"""SELECT concat(source, '_', doc_id) AS document_name, kind AS file_type, CASE WHEN kind IN ('csv', 'xlsx') THEN 'structured_dataset' ELSE 'document' END AS content_type,
    CASE WHEN kind = 'pdf' THEN len(string_split(text, '. ')) END AS total_pages, CASE WHEN kind = 'docx' THEN len({LINES}) END AS total_paragraphs, CASE WHEN kind = 'docx' THEN 1 END AS total_tables
    FROM (SELECT *, CASE doc_id % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' WHEN 2 THEN 'csv' ELSE 'xlsx' END AS kind FROM documents)""")
def _(t):
    named = t.documents.select(
        "doc_id",
        F.concat("source", F.lit("_"), F.col("doc_id").cast("string")).alias("document_name"),
        F.expr("CASE doc_id % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' WHEN 2 THEN 'csv' ELSE 'xlsx' END").alias("file_type"),
        F.split("text", "\\. ", -1).alias("pages"),
        F.split("text", "\n", -1).alias("paragraphs"),
        F.array("text").alias("tables"),
    )
    return op.document_normal_form(named)
