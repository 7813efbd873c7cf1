"""Group tables, charts and the insights read off them (top-k aggregation)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlens.functions.roles import MODULE_DATES, modules_of, roles_of
from wardlens.functions.scalars import explode_once, number, scalar, share_of_total, strip, timestamp
from wardlens.operators.catalog import fallback_category_chart

# Fixed values.
DEPARTMENT_DIMENSIONS = ("department", "department_id", "department_name", "dept_id", "dept_name")
# Fixed values.
MISSED_LABELS = ("no show", "no shows", "missed")


@dataclass(frozen=True)
class Group:
    """One group table or chart: a dimension and what is measured per value."""

    title: str
    dimension: str
    metric: str | None = None
    aggregation: str = "sum"
    kind: str | Column = "bar"
    unit: str | None = None
    metric_name: str | None = None
    only: Column | None = None

    def entry(self, number_: int) -> Column:
        """This group's contribution of one row."""
        if not self.metric:
            measured = F.lit(1.0)
        elif self.aggregation == "count":
            measured = F.col(self.metric).isNotNull().cast("double")
        else:
            measured = number(self.metric)
        label = F.coalesce(F.col(self.dimension).cast("string"), F.lit("Unknown"))
        entry = F.struct(F.lit(number_).alias("no"), label.alias("label"), measured.alias("x"))
        return entry if self.only is None else F.when(self.only, entry)


def grouped(table: DataFrame, groups: list[Group], top: int) -> DataFrame:
    """``(no, ord, label, value)``: the largest values of every group, in one pass over the table.

    A row contributes once per group and map tasks fold the contributions, so
    the shuffle carries one row per distinct label, however many groups there are.
    """
    if not groups:
        return table.sparkSession.createDataFrame([], "no int, ord int, label string, value double")
    entries = F.array_compact(F.array(*[g.entry(i) for i, g in enumerate(groups)]))
    totals = (
        explode_once(table.select(entries.alias("entries")), [], "entries")
        .groupBy("item.no", "item.label")
        .agg(F.sum("item.x").alias("total"), F.count("item.x").alias("n"))
    )
    means = [i for i, g in enumerate(groups) if g.aggregation == "mean"]
    raw = F.when(F.col("no").isin(means), F.col("total") / F.col("n")).otherwise(F.coalesce("total", F.lit(0.0)))
    order = Window.partitionBy("no").orderBy(F.desc_nulls_last("raw"), "label")
    ranked = totals.withColumn("raw", raw).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= top)
    return ranked.select("no", F.col("nth").alias("ord"), "label", F.round("raw", 2).alias("value"))


def _described(groups: list[Group], field) -> Column:
    """A property of the group a row belongs to."""
    if not groups:
        return F.lit(None).cast("string")
    values = [field(g) for g in groups]
    return F.get(F.array(*[v if isinstance(v, Column) else F.lit(v).cast("string") for v in values]), F.col("no"))


def group_table(table: DataFrame, dimension: str, value: str | None = None, aggregation: str = "sum", title: str = "", top: int = 20) -> DataFrame:
    return _tables(table, [Group(title, dimension, value, aggregation)], top)


def _tables(table: DataFrame, groups: list[Group], top: int = 20) -> DataFrame:
    return grouped(table, groups, top).select(_described(groups, lambda g: g.title).alias("title"), "label", "value")


def group_tables(table: DataFrame, roles: dict | None = None) -> DataFrame:
    """Every group table the columns allow, as ``(title, label, value)``."""
    roles = roles or roles_of(table.columns)
    modules = modules_of(table.columns)
    department = roles["department"]
    groups: list[Group] = []

    def add(title, dimension, value, aggregation="sum"):
        if dimension:
            groups.append(Group(title, dimension, value, aggregation))

    def counted(module: str) -> tuple[str | None, str]:
        return (roles[f"{module}_count"], "sum") if roles[f"{module}_count"] else (roles[f"{module}_id"], "count")

    if "Admission Analytics" in modules:
        add("Admissions by Type", roles["admission_type"], roles["admission_count"])
        add("Admissions by Department", department, *counted("admission"))
    if "Appointment Analytics" in modules:
        add("Appointment Status", roles["appointment_status"], roles["appointment_count"])
        add("Appointments by Department", department, *counted("appointment"))
        add("Appointments by Service", roles["service"], *counted("appointment"))
    if "Bed & Capacity Analytics" in modules and roles["occupied_beds"]:
        add("Average Occupied Beds by Department", department, roles["occupied_beds"], "mean")
    if "Equipment Analytics" in modules:
        add("Equipment Status", roles["equipment_status"], None)
        add("Equipment by Type", roles["equipment_type"], None)
    if "Department Analytics" in modules and not any("Department" in g.title for g in groups):
        add("Department Workload", department, None)
    return _tables(table, groups)


CHART_COLUMNS = ("chart_id", "title", "type", "dimension", "metric", "unit", "ord", "label", "value")


def _charts(table: DataFrame, groups: list[Group], first: int = 0, top: int = 12) -> DataFrame:
    """Chart rows of several groups; a label with nothing measured is not drawn."""
    rows = grouped(table, groups, top).where("value IS NOT NULL")
    return rows.select(
        (F.col("no") + first).alias("chart_no"),
        _described(groups, lambda g: g.title.lower().replace(" ", "-")).alias("chart_id"),
        _described(groups, lambda g: g.title).alias("title"),
        _described(groups, lambda g: g.kind).alias("type"),
        _described(groups, lambda g: g.dimension).alias("dimension"),
        _described(groups, lambda g: g.metric_name or g.metric or "records").alias("metric"),
        _described(groups, lambda g: g.unit).alias("unit"),
        "ord",
        "label",
        "value",
    )


def group_chart(
    table: DataFrame, dimension: str, metric: str | None = None, aggregation: str = "sum", title: str | None = None,
    kind: str | Column = "bar", unit: str | None = None, metric_name: str | None = None, top: int = 12,
) -> DataFrame:
    title = title or f"{dimension.replace('_', ' ').title()} breakdown"
    group = Group(title, dimension, metric, aggregation, kind, unit, metric_name)
    return _charts(table, [group], top=top).select(*CHART_COLUMNS)


def time_chart(table: DataFrame, date: str, measure: str | Column | None = None, aggregation: str = "sum", metric: str = "records", periods: int = 120) -> DataFrame:
    """A series whose grain follows the span of the data: month over 90 days, week over 31, else day.

    Facts are reduced to days first; span and periods are read off the days.
    """
    value = F.lit(1.0) if measure is None else number(measure)
    days = (
        table.select(timestamp(date).cast("date").alias("day"), value.alias("value"))
        .where("day IS NOT NULL AND value IS NOT NULL")
        .groupBy("day")
        .agg(F.sum("value").alias("total"), F.count("value").alias("n"))
    )
    span = scalar(days, F.date_diff(F.max("day"), F.min("day")))
    period = F.when(F.col("span") > 90, F.trunc("day", "MM")).when(F.col("span") > 31, F.trunc("day", "WEEK")).otherwise(F.col("day"))
    grain = F.when(F.col("span") > 90, "month").when(F.col("span") > 31, "week").otherwise("date")
    total = F.sum("total") / F.sum("n") if aggregation == "mean" else F.sum("total")
    points = (
        days.withColumn("span", span)
        .groupBy(period.alias("period"), grain.alias("dimension"))
        .agg(F.round(total, 2).alias("value"))
        .orderBy(F.desc("period"))
        .limit(periods)
        .withColumn("points", F.count(F.lit(1)).over(Window.partitionBy()))
        .where("points >= 2")
        .withColumn("label", F.date_format("period", "yyyy-MM-dd"))
    )
    title = f"{metric.replace('_', ' ').title()} over time"
    return points.select(
        F.lit(title.lower().replace(" ", "-")).alias("chart_id"),
        F.lit(title).alias("title"),
        F.lit("line").alias("type"),
        "dimension",
        F.lit(metric).alias("metric"),
        F.lit(None).cast("string").alias("unit"),
        F.row_number().over(Window.orderBy("period")).alias("ord"),
        "label",
        "value",
    )


def module_time_chart(table: DataFrame, module: str, roles: dict) -> DataFrame | None:
    """The time chart a module shows: its date column, measure and aggregation."""
    date = next((d for d in MODULE_DATES[module] if d in table.columns), roles["date"])
    if not date:
        return None
    if module == "Admission Analytics":
        return time_chart(table, date, roles["admission_count"], "sum", "admissions")
    if module == "Appointment Analytics":
        return time_chart(table, date, roles["appointment_count"], "sum", "appointments")
    if module == "Bed & Capacity Analytics":
        role = next((r for r in ("occupied_beds", "occupancy_rate", "available_beds", "total_beds") if roles[r]), None)
        aggregation = "mean" if role == "occupancy_rate" else "sum"
        return time_chart(table, date, roles[role] if role else None, aggregation, role or "occupied_beds")
    if roles["failure_count"]:
        return time_chart(table, date, roles["failure_count"], "sum", "failures")
    if roles["failure_event"]:
        return time_chart(table, date, F.col(roles["failure_event"]).isNotNull().cast("int"), "sum", "failures")
    return time_chart(table, date)


def _counted(module: str, dimension: str, roles: dict, title: str, kind: str | Column = "bar") -> Group:
    count, key = roles[f"{module}_count"], roles[f"{module}_id"]
    metric, aggregation = (count, "sum") if count else (key, "count")
    return Group(title, dimension, metric, aggregation, kind, f"{module}s", f"{module}s")


def admission_groups(table: DataFrame, roles: dict) -> list[Group]:
    groups = []
    if roles["department"]:
        groups.append(_counted("admission", roles["department"], roles, "Admissions by Department"))
    if roles["admission_type"]:
        groups.append(Group("Admission type distribution", roles["admission_type"], roles["admission_count"], "sum", "donut", "admissions"))
    return groups


def appointment_groups(table: DataFrame, roles: dict) -> list[Group]:
    groups = []
    if roles["appointment_status"]:
        groups.append(Group("Appointment status", roles["appointment_status"], roles["appointment_count"], "sum", "donut", "appointments"))
    if roles["department"]:
        groups.append(_counted("appointment", roles["department"], roles, "Appointments by Department"))
    if roles["service"]:
        services = table.groupBy(roles["service"]).agg(F.count(F.lit(1)).alias("n"))
        kind = F.when(scalar(services, F.count(roles["service"])) <= 8, "donut").otherwise("bar")
        groups.append(_counted("appointment", roles["service"], roles, "Appointments by Service", kind))
    return groups


def bed_groups(table: DataFrame, roles: dict) -> list[Group]:
    titles = {
        "occupied_beds": ("Average occupied beds by Department", "beds"),
        "occupancy_rate": ("Average occupancy by Department", "percent"),
        "available_beds": ("Average available beds by Department", "beds"),
    }
    role = next((r for r in titles if roles[r]), None)
    if not (role and roles["department"]):
        return []
    title, unit = titles[role]
    return [Group(title, roles["department"], roles[role], "mean", "bar", unit)]


def equipment_groups(table: DataFrame, roles: dict) -> list[Group]:
    groups = []
    if roles["equipment_status"]:
        groups.append(Group("Equipment status", roles["equipment_status"], None, "sum", "donut", "equipment"))
    if roles["equipment_type"] and (roles["failure_count"] or roles["failure_event"]):
        only = None if roles["failure_count"] else F.col(roles["failure_event"]).isNotNull()
        groups.append(Group("Recorded failures by equipment type", roles["equipment_type"], roles["failure_count"], "sum", "bar", "failures", only=only))
    return groups


MODULE_GROUPS = {
    "Admission Analytics": admission_groups,
    "Appointment Analytics": appointment_groups,
    "Bed & Capacity Analytics": bed_groups,
    "Equipment Analytics": equipment_groups,
}


def module_charts(table: DataFrame, module: str, roles: dict | None = None) -> DataFrame:
    """The group charts of one module."""
    return _charts(table, MODULE_GROUPS[module](table, roles or roles_of(table.columns))).select(*CHART_COLUMNS)


def department_workload(table: DataFrame, roles: dict | None = None) -> DataFrame:
    roles = roles or roles_of(table.columns)
    return group_chart(table, roles["department"], None, title="Department records", unit="records")


def dashboard_charts(table: DataFrame, roles: dict | None = None) -> DataFrame:
    """All charts of one table in display order (``chart_no``): time charts, then groups in one pass.

    A table that allows none of them shows its first suitable category column instead.
    """
    roles = roles or roles_of(table.columns)
    modules = modules_of(table.columns)
    lines = [module_time_chart(table, module, roles) for module in MODULE_DATES if module in modules]
    lines = [line for line in lines if line is not None]
    groups = [g for module, build in MODULE_GROUPS.items() if module in modules for g in build(table, roles)]
    if "Department Analytics" in modules and roles["department"] and not any("Department" in g.title for g in groups):
        groups.append(Group("Department records", roles["department"], unit="records"))
    parts = [line.select(F.lit(i).alias("chart_no"), "*") for i, line in enumerate(lines)]
    if groups:
        parts.append(_charts(table, groups, first=len(lines)))
    return reduce(DataFrame.unionByName, parts) if parts else _fallback(table)


def _fallback(table: DataFrame) -> DataFrame:
    counted = fallback_category_chart(table)
    order = Window.orderBy(F.desc("value"), "label")  # at most twelve rows
    return counted.select(
        F.lit(0).alias("chart_no"), F.lit("category-distribution").alias("chart_id"), F.lit("Category distribution").alias("title"), F.lit("bar").alias("type"),
        F.col("column_name").alias("dimension"), F.lit("records").alias("metric"), F.lit("records").alias("unit"), F.row_number().over(order).alias("ord"),
        "label", F.col("value").cast("double").alias("value"),
    )


def trailing_range_filter(points: DataFrame, date: str, days: int) -> DataFrame:
    """Points within ``days`` of the newest point of any series."""
    newest = scalar(points, F.max(date))
    return points.where(F.col(date) >= F.date_sub(newest, days))


def category_share(groups: DataFrame, label: str, value: str) -> DataFrame:
    """Share of each category in the total; negative values count as zero."""
    clipped = groups.select(label, F.greatest(F.col(value).cast("double"), F.lit(0.0)).alias("value"))
    return (
        clipped.withColumn("total", share_of_total(clipped, "value"))
        .where("total > 0")
        .withColumn("share", F.round(F.col("value") / F.col("total"), 6))
    )


def history_plus_forecast(history: DataFrame, forecast: DataFrame, last: int) -> DataFrame:
    """``(label, value)`` series joined under a ``kind``; only the last points of the history are shown."""
    recent = history.orderBy(F.desc("label")).limit(last)
    shape = lambda frame, kind: frame.select(F.lit(kind).alias("kind"), "label", F.round(F.col("value").cast("double"), 2).alias("value"))
    return shape(recent, "historical").unionByName(shape(forecast, "forecast"))


def trend_insight(charts: DataFrame) -> DataFrame:
    """First and last value of each line chart and the direction between them."""
    ends = (
        charts.where("type = 'line'")
        .groupBy("chart_no", "title")
        .agg(F.min_by("value", "ord").alias("first_value"), F.max_by("value", "ord").alias("last_value"), F.count("value").alias("points"))
        .where("points >= 2")
    )
    direction = F.when(F.col("last_value") > F.col("first_value"), "increased").when(F.col("last_value") < F.col("first_value"), "decreased")
    return ends.select("chart_no", "title", "first_value", "last_value", direction.otherwise("was unchanged").alias("direction"))


def top_department_insight(charts: DataFrame) -> DataFrame:
    by_department = charts.where((F.col("type") != "line") & F.col("dimension").isin(*DEPARTMENT_DIMENSIONS))
    return by_department.groupBy("chart_no", "title", "metric").agg(F.min_by("label", "ord").alias("label"), F.min_by("value", "ord").alias("value"))


def missed_appointment_insight(charts: DataFrame) -> DataFrame:
    plain = F.translate(F.lower(strip("label")), "-_", "  ")
    missed = charts.where((F.col("title") == "Appointment status") & plain.isin(*MISSED_LABELS))
    firsts = missed.groupBy("chart_no", "title").agg(F.min_by("label", "ord").alias("label"), F.min_by("value", "ord").alias("value"))
    return firsts.where("value > 0")


def kpi_insight(kpis: DataFrame, word: str, positive: bool = False) -> DataFrame:
    """First KPI whose label contains ``word`` (labels break ties)."""
    matching = kpis.where(F.lower("kpi").contains(word)).orderBy("kpi").limit(1)
    return matching.where("value > 0") if positive else matching


def insight_feed(charts: DataFrame, kpis: DataFrame, modules: list[str], top: int = 6) -> DataFrame:
    """Insights in display order, the first six; a coverage row when there is none."""

    def row(frame, order, kind, source, label, value, detail):
        return frame.select(
            order.cast("int").alias("ord"), F.lit(kind).alias("insight"), source.alias("source"),
            label.cast("string").alias("label"), value.cast("double").alias("value"), detail.cast("string").alias("detail"),
        )

    none = F.lit(None)
    parts = [
        row(trend_insight(charts), F.col("chart_no"), "Observed trend", F.col("title"), none, F.col("last_value"), F.col("direction")),
        row(top_department_insight(charts), F.col("chart_no"), "Highest department workload", F.col("title"), F.col("label"), F.col("value"), F.col("metric")),
        row(missed_appointment_insight(charts), F.col("chart_no"), "Missed appointments recorded", F.col("title"), F.col("label"), F.col("value"), none),
    ]
    if "Bed & Capacity Analytics" in modules:
        parts.append(row(kpi_insight(kpis, "occupancy"), F.lit(1000), "Bed utilization", F.col("kpi"), none, F.col("value"), none))
    if "Equipment Analytics" in modules:
        parts.append(row(kpi_insight(kpis, "failure", True), F.lit(1001), "Equipment failures recorded", F.col("kpi"), none, F.col("value"), none))
    found = reduce(DataFrame.unionByName, parts)
    names = ", ".join(m.replace(" Analytics", "") for m in modules) or "general dataset"
    coverage = row(
        found.agg(F.count(F.lit(1)).alias("n")).where("n = 0"), F.lit(0), "Dataset coverage", F.lit("Dataset profile"), F.lit(names), none, none
    )
    return found.unionByName(coverage).orderBy("ord").limit(top)
