"""Words of questions and chunks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardlens.functions.scalars import col

# Word pattern, ignored words.
TOKEN = "[A-Za-z0-9][A-Za-z0-9'-]+"
STOPWORDS = (
    "the", "a", "an", "and", "or", "of", "to", "in", "on", "for", "with", "from", "is", "are", "was", "were", "what", "which", "how",
    "why", "when", "where", "this", "that", "these", "those", "about", "hospital", "report", "document",
)


def tokens(text: str | Column) -> Column:
    words = F.regexp_extract_all(F.lower(col(text)), F.lit(TOKEN), F.lit(0))
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*STOPWORDS))
