"""Strict reading of message bytes as one JSON object."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# JSON as the standard has it, without Spark's leniency.
STRICT = {"allowSingleQuotes": "false"}


def parse_objects(messages: DataFrame, schema: T.StructType) -> DataFrame:
    """``value: binary`` -> ``text`` (bad UTF-8 replaced), ``readable`` (valid UTF-8 holding exactly
    one JSON value), ``is_object`` and ``fields`` (a struct of ``schema``, null unless an object).

    Wrapping the text in ``[...]`` makes trailing text, a bare array or a second object show up as a
    parse failure or a wrong element count; a repeated key takes its last value.

    The one-element ``explode`` pins the parsing to one place: without it Catalyst copies
    ``from_json`` into every expression and filter above and parses each message many times.  Only
    a message that is no object is looked at again, to tell another JSON value from no JSON.
    """
    boxed = F.concat(F.lit("["), F.col("text"), F.lit("]"))
    as_text = messages.select(
        F.make_valid_utf8(F.col("value").cast("string")).alias("text"),
        F.is_valid_utf8(F.col("value").cast("string")).alias("valid"),
    )
    parsed = F.struct("text", "valid", F.from_json(boxed, T.ArrayType(schema), STRICT).alias("objects"))
    rows = as_text.select(F.explode(F.array(parsed)).alias("p")).select("p.*")
    is_object = F.coalesce((F.size("objects") == 1) & F.get("objects", F.lit(0)).isNotNull(), F.lit(False))
    any_value = F.coalesce(F.size(F.from_json(boxed, T.ArrayType(T.StringType()), STRICT)) == 1, F.lit(False))
    return rows.select(
        "text",
        F.when(is_object, F.col("valid")).otherwise(F.col("valid") & any_value).alias("readable"),
        is_object.alias("is_object"),
        F.when(is_object, F.get("objects", F.lit(0))).alias("fields"),
    )
