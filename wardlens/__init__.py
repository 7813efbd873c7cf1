"""wardlens: hospital-operations analytics as plain Spark DataFrame plans."""

from wardlens.session import get_spark, work_dir
from wardlens.sources.tables import Tables

__all__ = ["Tables", "get_spark", "work_dir"]
