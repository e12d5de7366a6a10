"""Protocol files of any headers and forms, read together: tables, JSON and free-form lines as rows of (file, row or fields)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.sources.readers import END_NAMES, LABEL_NAMES, PATH_NAMES, SEGMENT_NAMES, START_NAMES

ROW = "map<string,string>"
SEGS = "array<struct<s:double,e:double>>"


def _once(df: DataFrame, *columns: Column) -> DataFrame:
    """Selects columns through a generator of one row, so that filters which Spark derives above it do not carry copies of their
    expressions below: an explode of spans would else parse each line hundreds of times."""
    return df.select(F.inline_outer(F.array(F.struct(*columns))))


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, length) of every file below a folder; no content is read. As Spark lists them: neither empty files nor those whose name
    or folder starts with _ or a dot. Paths are written as in ``file`` below, ``file:/`` for local ones."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return found.select(F.col("_metadata.file_path").alias("path"), "length")


def _lines(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """(file, at, line): ``at`` orders the lines of a file, and its least is the file's first line."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(root)
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    return lines.select(F.col("_metadata.file_path").alias("file"), place.alias("at"), F.col("value").alias("line"))


def tables(spark: SparkSession, root: str) -> DataFrame:
    """(file, row) of all .csv and .tsv files below a folder, each with a header of its own; ``row`` maps column names in lower case to texts.

    Files are split like any text, so a quoted field may hold no line break. A short line's missing fields are empty texts,
    a long line's further fields go, an empty line is no row, and of columns of one name the first counts. An empty file,
    or one of a header alone, has no rows.
    """
    lines = _lines(spark, root, "*.{csv,tsv,CSV,TSV}").filter(F.trim("line") != "")
    headers = lines.groupBy("file").agg(F.min("at").alias("first"), F.min_by("line", "at").alias("header"))
    tab = lambda c: F.lower(c).endswith(".tsv")
    width = headers.agg(F.max(F.size(F.when(tab(F.col("file")), F.split("header", "\t")).otherwise(F.split("header", ","))))).first()[0] or 1
    schema = ", ".join(f"c{i} string" for i in range(width))

    def with_fields(df: DataFrame, name: str) -> DataFrame:
        """Adds the fields of a column of lines, each line parsed once."""
        comma, by_tab = (F.from_csv(F.col(name), schema, {"sep": sep, "mode": "PERMISSIVE"}) for sep in (",", "\t"))
        cut = df.withColumn("_cut", F.when(tab(F.col("file")), by_tab).otherwise(comma))
        return cut.withColumn("_fields", F.array(*[F.col(f"_cut.c{i}") for i in range(width)])).drop("_cut")

    # One row a file: Spark broadcasts it where its measured size allows.
    named = with_fields(headers, "header").select("file", "first", F.transform("_fields", lambda x: F.lower(F.trim(x))).alias("names"))
    placed = with_fields(lines.join(named, "file").filter(F.col("at") > F.col("first")), "line")
    # The last entry of a name would count: reversed, it is the first.
    pairs = F.filter(F.arrays_zip(F.col("names").alias("n"), F.col("_fields").alias("v")), lambda x: x["n"].isNotNull())
    firsts = F.filter(pairs, lambda x, i: F.array_position(F.transform(pairs, lambda y: y["n"]), x["n"]) == i + 1)
    return _once(placed, F.col("file"), F.map_from_entries(F.transform(firsts, lambda x: F.struct(x["n"], F.coalesce(x["v"], F.lit(""))))).alias("row"))


def json_rows(spark: SparkSession, root: str) -> DataFrame:
    """(file, row) of the items of all .json files below a folder: a list, or the first of items, data and entries that is no empty
    list, or the object itself. Values that are no texts stay as JSON. Malformed files and items that are no objects go."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{json,JSON}").text(root, wholetext=True)
    text = files.select(F.col("_metadata.file_path").alias("file"), "value").filter(F.try_parse_json("value").isNotNull())
    # Items as texts first: one that is no object must not spoil the others.
    wrapped = F.from_json("value", "items array<string>, data array<string>, entries array<string>")
    held = [F.when(F.size(wrapped[n]) > 0, wrapped[n]) for n in ("items", "data", "entries")]
    items = F.when(F.ltrim("value").startswith("["), F.from_json("value", "array<string>")).otherwise(F.coalesce(*held, F.array("value")))
    objects = text.select("file", F.explode(items).alias("item")).filter(F.ltrim("item").startswith("{"))
    return _once(objects, F.col("file"), F.transform_keys(F.from_json("item", ROW), lambda k, _: F.lower(k)).alias("row")).filter("row IS NOT NULL")


def field_lines(spark: SparkSession, root: str) -> DataFrame:
    """(file, fields) of the lines of all .txt and .lst files below a folder; blank lines, comments and lines of one field go."""
    lines = _lines(spark, root, "*.{txt,lst,TXT,LST}").filter(~F.col("line").rlike(r"^\s*(#|$)"))
    return lines.select("file", T.split_fields(F.trim("line")).alias("fields")).filter(F.size("fields") >= 2)


def _first(row: Column, names: tuple[str, ...]) -> Column:
    """The value of the first of the names that the row has; null if it has none."""
    return F.coalesce(*[F.when(F.map_contains_key(row, n), F.coalesce(row[n], F.lit(""))) for n in names])


def list_spans(cell: Column) -> Column:
    """Spans of a JSON list of pairs and of {start, end} objects, in any mixture; other items go, and a text that is no list has none."""

    def read(item: Column) -> Column:
        pair, named = F.from_json(item, "array<double>"), F.from_json(item, "start double, end double")
        of = lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.struct(F.least(a, b).alias("s"), F.greatest(a, b).alias("e")))
        return F.when(F.ltrim(item).startswith("["), of(F.get(pair, F.lit(0)), F.get(pair, F.lit(1)))).otherwise(of(named["start"], named["end"]))

    items = F.coalesce(F.from_json(cell, "array<string>"), F.array().cast("array<string>"))
    return F.filter(F.transform(items, read), lambda x: x.isNotNull())


def row_spans(row: Column) -> Column:
    """Spans of a row: of the first segment field that holds some, else of start and end fields, else of JSON in a segment field."""
    cells = F.filter(F.transform(F.lit(list(SEGMENT_NAMES)), lambda n: F.coalesce(F.element_at(row, n), F.lit(""))), lambda c: F.trim(c) != "")

    def inline(cell: Column) -> Column:
        parts = F.filter(F.split(cell, "[;|]"), lambda x: F.trim(x) != "")
        return T.segments(F.array_join(parts, ";"), parts)

    def first(read) -> Column:
        """What the first cell gives in which ``read`` finds spans."""
        return F.get(F.filter(F.transform(cells, read), lambda x: F.size(x) > 0), F.lit(0))

    a, b = (_first(row, names).try_cast("double") for names in (START_NAMES, END_NAMES))
    ends = F.when(a.isNotNull() & b.isNotNull(), F.array(F.struct(F.least(a, b).alias("s"), F.greatest(a, b).alias("e"))))
    found = F.coalesce(first(inline), ends, first(list_spans), F.array().cast(SEGS))
    # A list of one, so that the spans are found once and not at every place that names them.
    return F.get(F.transform(F.array(found), T.milliseconds_to_seconds), F.lit(0))


def row_entries(rows: DataFrame) -> DataFrame:
    """(file, token, last, label, segs) of rows (file, row): path and label by the first synonym that the row has; without one, its id or
    else the first value for the token, and all its values for the label. ``last`` is null: rows have no fields to fall back on."""
    row = F.col("row")
    token = F.coalesce(_first(row, (*PATH_NAMES, "id")), F.get(F.map_values(row), F.lit(0)), F.lit(""))
    label = T.normalize_label(F.coalesce(_first(row, LABEL_NAMES), F.array_join(F.map_values(row), " ")))
    return _once(rows, F.col("file"), token.alias("token"), F.lit(None).cast("string").alias("last"), label.alias("label"), row_spans(row).alias("segs"))


def line_entries(lines: DataFrame) -> DataFrame:
    """(file, token, last, label, segs) of lines (file, fields): first field, last field, label by the second, spans by the rest."""
    rest = F.slice("fields", F.lit(3), F.greatest(F.size("fields") - 2, F.lit(0)))
    segs = T.milliseconds_to_seconds(T.segments(F.array_join(rest, ";"), rest))
    return _once(lines, F.col("file"), F.get("fields", 0).alias("token"), F.element_at("fields", -1).alias("last"), T.normalize_label(F.get("fields", 1)).alias("label"), segs.alias("segs"))


def entries(spark: SparkSession, root: str) -> DataFrame:
    """(file, token, last, label, segs) of all protocol files below a folder, whatever their form."""
    return row_entries(tables(spark, root)).unionByName(row_entries(json_rows(spark, root))).unionByName(line_entries(field_lines(spark, root)))
