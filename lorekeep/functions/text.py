"""Text predicates and tokens as Column expressions (all stay in the JVM)."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters Python treats as white space, as one regex class.
SPACE = r"[\s\x1c-\x1f]"


def is_blank(col: Column) -> Column:
    """Absent, empty or white space only."""
    return col.isNull() | col.cast("string").rlike(f"(?U)^{SPACE}*$")


def tokens(col: Column) -> Column:
    """Lower-cased words split at white space; ``array_remove`` drops the empty edge pieces."""
    return F.array_remove(F.split(F.lower(col), f"(?U){SPACE}+"), "")


def quoted(prefix: str, col: Column) -> Column:
    """``prefix 'value'`` - the form every rejection reason takes."""
    return F.concat(F.lit(prefix + " '"), col, F.lit("'"))
