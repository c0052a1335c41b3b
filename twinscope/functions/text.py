"""Tokens and stop words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# English stop words, the common short list.
STOP_WORDS = """
a about above after again all also am an and any are as at be because been before being below between both but by can
could did do does doing down during each few for from further had has have having he her here hers him his how i if in
into is it its itself me more most my no nor not now of off on once only or other our out over own same she should so
some such than that the their them then there these they this those through to too under until up very was we were what
when where which while who whom why will with would you your
""".split()


def tokens(text: Column) -> Column:
    """Runs of word characters of the lowered text, in any script; none for null."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)\b\w+\b"), F.lit(0))


#: The same tokens in DuckDB.
SQL_TOKENS = r"regexp_extract_all(lower(coalesce({0}, '')), '[\pL\pN_\pM]+')"


def without_stop_words(words: Column) -> Column:
    return F.filter(words, lambda w: ~w.isin(STOP_WORDS))
