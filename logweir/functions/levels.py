"""Log levels and HTTP status classes."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from logweir.patterns import LEVEL_ALIASES, LEVEL_KEYWORDS, NUMERIC_LEVELS


def lookup(table: dict, key: Column) -> Column:
    """Value of ``key`` in a small literal table, NULL if absent."""
    pairs = [F.lit(item) for pair in table.items() for item in pair]
    return F.try_element_at(F.create_map(*pairs), key)


def status_level(status: Column) -> Column:
    return (
        F.when(status >= 500, "error")
        .when(status >= 400, "warn")
        .when(status >= 200, "info")
        .when(status.isNotNull(), "debug")
    )


def status_class(status: Column) -> Column:
    """``404`` gives ``4xx``; NULL stays NULL."""
    return F.concat(F.floor(status / 100).cast("string"), F.lit("xx"))


def normalize_level(level: Column) -> Column:
    """Map common aliases of a level to its usual name; other names pass."""
    return F.coalesce(lookup(LEVEL_ALIASES, level), level)


def numeric_level(number: Column) -> Column:
    """Usual name of a numeric level given as text, or ``level-N``."""
    shown = F.regexp_replace(number, r"\.0$", "")
    names = {str(value): name for value, name in NUMERIC_LEVELS.items()}
    return F.coalesce(lookup(names, number), lookup(names, shown), F.concat(F.lit("level-"), shown))


def keyword_level(text: Column) -> Column:
    """Level told by the words of a free text; ``info`` if no word tells."""
    lowered = F.lower(text)
    chain = F
    for level, words in LEVEL_KEYWORDS.items():
        found = lowered.contains(words[0])
        for word in words[1:]:
            found = found | lowered.contains(word)
        chain = chain.when(found, level)
    return chain.when(text.isNotNull(), "info")
