"""JSON texts as records: what can be read, and why the rest can't.

A text is parsed once, field by field: a field of another type is an error of that field, and the others stand. Rows are never dropped.
Errors are texts: "absent" (null), "empty" (white space), "broken" (no JSON, a name twice in an object, or something after the value that doesn't end as it would), "no
object", or for each field that isn't what it has to be, "name: no type". Absent fields and JSON nulls are null without an error.
"""

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def checked(rows: DataFrame, column: str, fields: dict[str, str]) -> DataFrame:
    """rows with record, a struct of fields (name to type, cast as Spark casts), and errors, an array of texts. A name may have quotes of one kind."""
    text, v = F.col(f"`{column}`"), F.col("_v")
    # The parser stops after the first value, so what a text ends in has to fit what it begins with.
    whole = F.when(text.rlike(r'^\s*(?:\{(?s:.*)\}|\[(?s:.*)\]|"(?s:.*)"|[^\s"{\[]\S*+)\s*$'), F.try_parse_json(text))
    path = {name: f'$["{name}"]' if "'" in name else f"$['{name}']" for name in fields}
    value = {name: F.try_variant_get(v, path[name], kind) for name, kind in fields.items()}
    some = {name: F.try_variant_get(v, path[name], "variant") for name in fields}
    there = lambda name: some[name].isNotNull() & ~F.is_variant_null(some[name])
    object_ = F.schema_of_variant(v).startswith("OBJECT")
    wrong = F.filter(F.array(*[F.when(there(n) & value[n].isNull(), F.lit(f"{n}: no {kind}")) for n, kind in fields.items()]), lambda e: e.isNotNull())
    one = lambda e: F.array(F.lit(e))
    errors = F.when(text.isNull(), one("absent")).when(F.btrim(text, F.lit(" \t\n\r")) == "", one("empty")).when(v.isNull(), one("broken")).when(~object_, one("no object")).otherwise(wrong)
    record = F.struct(*[F.when(object_, value[n]).alias(n) for n in fields])
    return rows.withColumn("_v", whole).withColumns({"record": record, "errors": errors}).drop("_v")


def parted(rows: DataFrame, place: str, seen: Observation | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows of checked without errors, and those with errors. They are written to place once, each kind in a folder of its own, so both come from
    one pass and reading one doesn't read the other. seen gets the number of rows and of bad ones."""
    marked = rows.withColumn("bad", F.size("errors") > 0)
    if seen is not None:
        marked = marked.observe(seen, F.count("*").alias("rows"), F.count_if("bad").alias("bad"))
    marked.write.mode("overwrite").partitionBy("bad").parquet(place)
    back = rows.sparkSession.read.schema(marked.schema).parquet(place)
    return back.where("NOT bad").drop("bad"), back.where("bad").drop("bad")
