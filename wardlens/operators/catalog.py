"""Schema understanding over a catalogue of many uploads.

Input rows are ``(dataset_id, position, column_name, dtype)``: one per column of
every registered table. Each operator is one pass over that catalogue followed
by aggregation to a bounded number of rows per dataset.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlens.functions import roles as rules
from wardlens.functions.scalars import all_of, any_of, count_where, explode_once, ratio, scalar
from wardlens.functions.stats import row_numbers
from wardlens.operators.quality import repeats_of


def _found(name: Column, pattern: str) -> Column:
    """``name.rlike(pattern)``; words, beginnings, endings and whole names are compared as text, far faster than a pattern."""
    if re.fullmatch(r"\^?[a-z_]+(\|\^?[a-z_]+)*", pattern):
        return any_of([name.startswith(word[1:]) if word.startswith("^") else name.contains(word) for word in pattern.split("|")])
    whole = re.fullmatch(r"\^\(([a-z_|]+)\)\$", pattern)
    if whole:
        return name.isin(*whole[1].split("|"))
    ending = re.fullmatch(r"([a-z_]+)\(([a-z_|]+)\)\$", pattern)
    if ending:
        return any_of([name.endswith(ending[1] + word) for word in ending[2].split("|")])
    return name.rlike(pattern)


def _fits(name: Column, alternatives: list[list[str]]) -> Column:
    def holds(pattern: str) -> Column:
        return ~_found(name, pattern[1:]) if pattern.startswith("!") else _found(name, pattern)

    return any_of([all_of([holds(p) for p in patterns]) for patterns in alternatives])


def normalize_columns(catalog: DataFrame) -> DataFrame:
    """Adds ``name``: lower-case with underscores, repeats numbered by position."""
    squeezed = F.regexp_replace(F.lower("column_name"), "[^a-z0-9]+", "_")
    base = F.coalesce(F.nullif(F.regexp_replace(squeezed, "^_+|_+$", ""), F.lit("")), F.lit("unnamed"))
    numbered = row_numbers(catalog.withColumn("base_", base), ["dataset_id", "base_"], ["position"], name="copy_")
    suffix = F.when(F.col("copy_") > 1, F.concat(F.lit("_"), F.col("copy_"))).otherwise("")
    return numbered.withColumn("name", F.concat("base_", suffix)).drop("base_", "copy_")


def module_flags(catalog: DataFrame) -> DataFrame:
    """One row per dataset: its modules in display order, possibly none."""
    name = F.col("name")
    signals = [F.bool_or(_fits(name, alternatives)).alias(f"m{i}") for i, (_, alternatives) in enumerate(rules.MODULES)]
    present = [F.when(F.col(f"m{i}"), F.lit(module)) for i, (module, _) in enumerate(rules.MODULES)]
    return catalog.groupBy("dataset_id").agg(*signals).select("dataset_id", F.array_compact(F.array(*present)).alias("modules"))


def detect_modules(catalog: DataFrame) -> DataFrame:
    return module_flags(catalog).select("dataset_id", F.posexplode("modules").alias("module_order", "module"))


def dataset_type(catalog: DataFrame) -> DataFrame:
    """Both spellings in use: the profile's and the analytics'."""
    only = F.lower(F.regexp_replace(F.element_at("modules", 1), " Analytics$", ""))
    n = F.size("modules")
    return module_flags(catalog).select(
        "dataset_id",
        F.when(n == 1, only).when(n > 1, "hospital operations").otherwise("general dataset").alias("profile_type"),
        F.when(n == 1, only).when(n > 1, "hospital_operations").otherwise("general").alias("analytics_type"),
    )


#: A candidate's rank in one long: kind of match, order of the alias, position in the table.
RANKS, PLACES = 1 << 8, 1 << 52


def resolve_roles(catalog: DataFrame) -> DataFrame:
    """``(dataset_id, role, column_name)`` for every role some column can play.

    Every row tests the patterns on its own name, in compiled text comparisons, so names do not meet in a join and a name
    that most tables share needs no task of its own. Candidates are ranked by (kind of match, alias order,
    position), which one long holds, and map tasks keep the best of each table and role; only its place is
    aggregated, so tasks hash and nothing is sorted. The winners read their names from the catalogue. Bare names
    count only where the same dataset has an equipment column.
    """
    return played_roles(catalog).join(catalog.select("dataset_id", "position", "name"), ["dataset_id", "position"]).select(
        "dataset_id", "role", F.col("name").alias("column_name")
    )


def played_roles(catalog: DataFrame) -> DataFrame:
    """``(dataset_id, role, position)`` of the column that plays each role; its name would need the catalogue again."""
    name = F.col("name")

    numbers = {role: i for i, role in enumerate(["", *rules.ROLE_ALIASES])}

    def candidate(role: str, tier: int, rank: Column) -> Column:
        return F.struct(F.lit(numbers[role]).alias("role"), (rank + F.lit(tier * RANKS)).cast("long").alias("kind"))

    candidates = []
    for role, aliases in rules.ROLE_ALIASES.items():
        rank = F.array_position(F.lit(list(aliases)), name)
        pattern = _fits(name, rules.ROLE_PATTERNS[role])
        best = F.when(rank > 0, candidate(role, 1, rank)).when(pattern, candidate(role, 2, F.lit(0)))
        if role in rules.BARE_NAMES:
            best = best.when(name.isin(*rules.BARE_NAMES[role]), candidate(role, 3, F.lit(0)))
        candidates.append(best)
    candidates.append(F.when(_found(name, rules.EQUIPMENT_WORDS), candidate("", 0, F.lit(0))))

    listed = catalog.select("dataset_id", F.col("position").alias("place"), F.array_compact(F.array(*candidates)).alias("c"))
    playable = explode_once(listed, ["dataset_id", "place"], "c")
    packed = F.col("item.kind") * F.lit(PLACES) + F.col("place")
    best = playable.groupBy("dataset_id", F.col("item.role").alias("number")).agg(F.min(packed).alias("pick"))
    # At most one row per role is left per dataset.
    has_equipment = F.max((F.col("number") == 0).cast("int")).over(Window.partitionBy("dataset_id"))
    return (
        best.withColumn("has_equipment", has_equipment)
        .where("pick IS NOT NULL")
        .where((F.col("number") > 0) & ((F.col("pick") < 3 * RANKS * PLACES) | (F.col("has_equipment") == 1)))
        .select("dataset_id", F.get(F.lit(["", *rules.ROLE_ALIASES]), "number").alias("role"), (F.col("pick") % PLACES).alias("position"))
    )


def failure_event_role(catalog: DataFrame) -> DataFrame:
    matching = catalog.where(_fits(F.col("name"), rules.FAILURE_EVENT_PATTERNS))
    return matching.groupBy("dataset_id").agg(F.min_by("name", "position").alias("failure_event_column"))


def feature_gate(catalog: DataFrame) -> DataFrame:
    """Whether each dataset holds every column each model needs, and what is missing."""
    name = F.col("name")
    by_name, by_role = [], []
    for model, features in rules.MODEL_FEATURES.items():
        for feature, source in features.items():
            entry = F.struct(F.lit(model).alias("model"), F.lit(feature).alias("feature"))
            if isinstance(source, str):
                by_role.append(F.when(F.col("role") == source, entry))
            else:
                by_name.append(F.when(name.isin(*source), entry))
    named = explode_once(catalog.select("dataset_id", F.array_compact(F.array(*by_name)).alias("f")), ["dataset_id"], "f")
    played = explode_once(played_roles(catalog).select("dataset_id", F.array_compact(F.array(*by_role)).alias("f")), ["dataset_id"], "f")
    named, played = named.select("dataset_id", "item.*"), played.select("dataset_id", "item.*")
    found = named.unionByName(played).distinct()

    needed = F.array(
        *[
            F.struct(F.lit(m).alias("model"), F.lit(f).alias("feature"))
            for m, features in rules.MODEL_FEATURES.items()
            for f in features
        ]
    )
    wanted = catalog.select("dataset_id").distinct().select("dataset_id", F.explode(needed).alias("f")).select("dataset_id", "f.*")
    return (
        wanted.join(found.withColumn("found", F.lit(1)), ["dataset_id", "model", "feature"], "left")
        .groupBy("dataset_id", "model")
        .agg(
            F.count("found").alias("features_found"),
            F.count(F.lit(1)).alias("features_needed"),
            # Bounded: a model lists at most six features.
            F.array_join(F.array_sort(F.collect_list(F.when(F.col("found").isNull(), F.col("feature")))), ",").alias("missing"),
        )
        .withColumn("available", F.col("features_found") == F.col("features_needed"))
    )


def module_date_column(catalog: DataFrame) -> DataFrame:
    """Date column per detected module: its preferred names, else the general date role."""
    name = F.col("name")
    entries = []
    for module, dates in rules.MODULE_DATES.items():
        rank = F.array_position(F.lit(list(dates)), name)
        entries.append(F.when(rank > 0, F.struct(F.lit(module).alias("module"), F.struct(rank.alias("rank"), name.alias("name")).alias("pick"))))
    preferred = (
        explode_once(catalog.select("dataset_id", F.array_compact(F.array(*entries)).alias("e")), ["dataset_id"], "e")
        .groupBy("dataset_id", "item.module")
        .agg(F.min("item.pick").getField("name").alias("preferred"))
    )
    general = resolve_roles(catalog).where("role = 'date'").select("dataset_id", F.col("column_name").alias("general"))
    modules = detect_modules(catalog).where(F.col("module").isin(*rules.MODULE_DATES)).select("dataset_id", "module")
    return (
        modules.join(preferred, ["dataset_id", "module"], "left")
        .join(general, "dataset_id", "left")
        .select("dataset_id", "module", F.coalesce("preferred", "general").alias("date_column"))
    )


NUMERIC_TYPES = ("tinyint", "smallint", "int", "bigint", "float", "double")


def _is_numeric(kind: str) -> bool:
    return kind in NUMERIC_TYPES or kind.startswith("decimal")


def open_columns(table: DataFrame, columns: list[str], most: int) -> Column:
    """For each column, whether it may hold at most ``most`` distinct values.

    A sketch keeps a bounded number of hashes per column and task. A few distinct
    hashes are listed one by one, so a column with ``most`` values is never
    estimated at twice as many or more; what passes is still counted exactly.
    """
    estimates = [F.coalesce(F.hll_sketch_estimate(F.hll_sketch_agg(F.col(c).cast("string"), 10)), F.lit(0)) <= 2 * most for c in columns]
    return scalar(table, F.array(*estimates))


def column_frequencies(table: DataFrame, columns: list[str], wanted: Column | None = None) -> DataFrame:
    """``(position, column_name, value, n)``, NULL included, for several columns in one pass.

    ``wanted`` says which columns to count, by position.
    """
    entries = [
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for i, c in enumerate(columns)
    ]
    if wanted is not None:
        entries = [F.when(wanted[i], e) for i, e in enumerate(entries)]
    long = table.select(F.explode(F.array(*entries)).alias("e")).where("e IS NOT NULL").select("e.*")
    return long.groupBy("position", "column_name", "value").agg(F.count(F.lit(1)).alias("n"))


def profile_dataset(table: DataFrame, name: str) -> DataFrame:
    """One row per column: type, missing and distinct values, numeric and date flags, and the table's shape.

    A date column has date/time in its name and at least 70 % parseable values
    (numbers count as parseable instants).
    """
    kinds = dict(table.dtypes)
    dated = [c for c in table.columns if "date" in c.lower() or "time" in c.lower()]

    def parsed(column: str) -> Column:
        return F.col(column).isNotNull() if _is_numeric(kinds[column]) else F.col(column).cast("string").try_cast("timestamp_ntz").isNotNull()

    one = table.agg(
        F.count(F.lit(1)).alias("rows"),
        *[count_where(F.col(c).isNull()).alias(f"missing_{i}") for i, c in enumerate(table.columns)],
        *[count_where(parsed(c)).alias(f"parsed_{c}") for c in dated],
    )
    entries = F.array(
        *[
            F.struct(
                F.lit(i).alias("position"),
                F.lit(c).alias("column_name"),
                F.lit(kinds[c]).alias("data_type"),
                F.col(f"missing_{i}").alias("missing"),
                F.lit(_is_numeric(kinds[c])).alias("is_numeric"),
                (F.coalesce(ratio(F.col(f"parsed_{c}"), F.col("rows")) >= 0.7, F.lit(False)) if c in dated else F.lit(False)).alias("is_date"),
            )
            for i, c in enumerate(table.columns)
        ]
    )
    columns = one.select("rows", F.explode(entries).alias("e")).select("rows", "e.*")
    distinct = column_frequencies(table, table.columns).groupBy("column_name").agg(F.count("value").alias("distinct_values"))
    duplicates = scalar(repeats_of(table), F.max("duplicate_rows"))
    return columns.join(distinct, "column_name").select(
        F.lit(name).alias("dataset_id"),
        "position",
        "column_name",
        "data_type",
        "missing",
        "distinct_values",
        "is_numeric",
        "is_date",
        F.col("rows").alias("row_count"),
        F.lit(len(table.columns)).alias("column_count"),
        duplicates.alias("duplicate_rows"),
    )


def dataset_capabilities(profiles: DataFrame) -> DataFrame:
    """Analyses each profiled dataset supports.

    An identifier ends in ``_id`` or is unique per row; a target is a column that
    is neither identifier nor date and has 2 to 20 distinct values.
    """
    is_id = F.col("column_name").endswith("_id") | (F.col("distinct_values") == F.col("row_count"))
    target = ~is_id & ~F.col("is_date") & F.col("distinct_values").between(2, 20)
    per = profiles.groupBy("dataset_id").agg(
        F.max("row_count").alias("rows"),
        F.max("column_count").alias("columns"),
        F.sum("missing").alias("missing"),
        count_where(F.col("is_numeric")).alias("numeric"),
        count_where(~F.col("is_numeric") & ~F.col("is_date")).alias("categorical"),
        count_where(F.col("is_date")).alias("dates"),
        count_where(target).alias("targets"),
    )
    # Labels in display order.
    ladder = [
        ("Descriptive statistics", "rows > 0 AND columns > 0"),
        ("Missing-value analysis", "missing > 0"),
        ("Numeric analysis", "numeric >= 1"),
        ("Correlation analysis", "numeric >= 2"),
        ("Numeric visualizations", "numeric >= 2"),
        ("Categorical analysis", "categorical >= 1"),
        ("Categorical visualizations", "categorical >= 1"),
        ("Data distribution analysis", "rows >= 10"),
        ("Date/time analysis", "dates >= 1"),
        ("Trend analysis", "dates >= 1"),
        ("Time-series visualizations", "dates >= 1"),
        ("Machine learning candidate analysis", "rows >= 20 AND columns >= 2 AND targets >= 1"),
    ]
    offered = F.array_compact(F.array(*[F.when(F.expr(rule), F.lit(label)) for label, rule in ladder]))
    return per.select("dataset_id", F.posexplode(offered).alias("capability_order", "capability"))


def document_capabilities(profiles: DataFrame) -> DataFrame:
    """Analyses each document supports, from its character and table counts."""
    # Labels in display order.
    ladder = [
        ("Document summarization", "total_text_characters > 0"),
        ("Document question answering", "total_text_characters > 0"),
        ("Document search / RAG", "total_text_characters > 0"),
        ("Table analysis", "total_tables > 0"),
        ("KPI extraction candidate", "total_tables > 0"),
        ("Document comparison", "total_text_characters > 0"),
    ]
    offered = F.array_compact(F.array(*[F.when(F.expr(rule), F.lit(label)) for label, rule in ladder]))
    return profiles.select("doc_id", F.posexplode(offered).alias("capability_order", "capability"))


def safe_preview(table: DataFrame, key: str, columns: int = 12, rows: int = 8) -> DataFrame:
    """First columns that name nothing personal, first rows by key (a top-k, not a sort)."""
    keep = [c for c in table.columns if not rules.re.search(rules.SENSITIVE, c)][:columns]
    return table.orderBy(key).limit(rows).select(*keep)


def fallback_category_chart(table: DataFrame, top: int = 12) -> DataFrame:
    """Counts of the first text column that is not person-level and has 2 to 8 distinct values.

    A first pass closes the columns that hold more; their values never leave the scan of the second.
    """
    texts = [c for c, kind in table.dtypes if kind == "string" and not rules.re.search(rules.PERSON_LEVEL, c)]
    counts = column_frequencies(table, texts, open_columns(table, texts, 8))
    eligible = counts.groupBy("position").agg(F.count("value").alias("kinds")).where("kinds BETWEEN 2 AND 8")
    chosen = scalar(eligible, F.min("position"))
    return (
        counts.where(F.col("position") == chosen)
        .select("column_name", F.coalesce("value", F.lit("Unknown")).alias("label"), F.col("n").alias("value"))
        .orderBy(F.desc("value"), "label")
        .limit(top)
    )


def catalog_of(tables: dict[str, DataFrame]) -> DataFrame:
    """Catalogue rows of live tables (schema only, no scan)."""
    rows = [(name, i, c, kind) for name, table in tables.items() for i, (c, kind) in enumerate(table.dtypes)]
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame(rows, "dataset_id string, position bigint, column_name string, dtype string")


