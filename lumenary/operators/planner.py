"""What a question about tables asks for, read from the question and bound to the tables at hand, before any fact came back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: References to tables, rows by number and rows by name (fixed values).
TABLE = r"(?iU)\bTable\s*(?:S\s*)?(\d+(?:\.\d+)?)\b"
ROW_NUMBER, CHINESE_ROW = r"(?iU)\brow\s+(\d+)\b", r"第\s*(\d+)\s*行"
ROW_NAME = r"(?iU)\b(total|average|mean|overall)\s+row\b"
#: What separates columns that are listed, and words that name none (fixed values).
LISTED = r"[、，,]|(?U:\band\b)|和"
STOP = "what which why when where who how is are was were does do did the a an of for with about from into and or not row column table this that these those its much many".split()


def column_key(text: Column) -> Column:
    """A column's or row's name: small letters, without a plural s."""
    t = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    return F.when(t.endswith("s") & (F.length(t) > 4), F.substring(t, F.lit(1), F.length(t) - 1)).otherwise(t)


def table_numbers(question: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(question, F.lit(TABLE), F.lit(1)), lambda x: x.cast("double"))))


def row_number(question: Column) -> Column:
    found = F.array(*[F.nullif(F.regexp_extract(question, p, 1), F.lit("")) for p in (ROW_NUMBER, CHINESE_ROW)])
    return F.get(F.filter(found, lambda x: x.isNotNull()), F.lit(0)).cast("int")


def row_name(question: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(question, ROW_NAME, 1)), F.lit(""))


def columns(question: Column) -> Column:
    """The columns that a question asks for. References to tables and rows are left out first. Of a list each item is one: its
    words of two characters or more, without "values" at the end; else all words of four characters or more are one."""
    bare = F.regexp_replace(F.regexp_replace(question, TABLE, " "), r"(?U)\brow\s+\d+\b|\b第\s*\d+\s*行\b", " ")
    bare = F.regexp_replace(bare, ROW_NAME, " ")

    def words(t: Column, least: int) -> Column:
        found = F.transform(F.regexp_extract_all(t, F.lit(rf"[A-Za-z][A-Za-z0-9_-]{{{least - 1},}}"), F.lit(0)), lambda w: F.lower(w))
        return F.filter(found, lambda w: ~w.isin(STOP))

    def item(t: Column) -> Column:
        return column_key(F.regexp_replace(F.array_join(words(t, 2), " "), r"(^| )(values?( |$))+$", ""))

    def of(parts: Column) -> Column:
        listed = F.filter(F.transform(parts, item), lambda x: x != "")
        whole = F.filter(F.array(column_key(F.array_join(words(F.array_join(parts, ","), 4), " "))), lambda x: x != "")
        return F.when(F.size(parts) > 1, listed).otherwise(whole)

    return T.let(F.split(bare, LISTED), of)


def planned(questions: DataFrame, inventory: DataFrame) -> DataFrame:
    """query_id, status and target fields of what questions (query_id, question) demand of tables in their inventory (query_id,
    document_id, parse_version, table_id).

    Each table that the question numbers must be exactly one of the inventory's, by the digits of its id; without a number,
    the inventory must have one table. Otherwise, and where no column can be read and no table is numbered, the demand is
    ``unknown``, with one row without a target; it never falls back to what came back. A numbered table without a column asks
    for any column. A row is asked for by number, else by name, else any will do.
    """
    q = F.coalesce(F.col("question"), F.lit(""))
    parsed = questions.select("query_id", table_numbers(q).alias("_numbers"), columns(q).alias("_columns"), row_number(q).alias("row_index"), row_name(q).alias("_name"), F.nullif(F.regexp_extract(q, TABLE, 0), F.lit("")).alias("table_ref"))
    parsed = parsed.select("query_id", "_numbers", F.when((F.size("_numbers") > 0) & (F.size("_columns") == 0), F.array(F.lit(""))).otherwise(F.col("_columns")).alias("_columns"), "row_index", F.when(F.col("row_index").isNull(), F.col("_name")).alias("row_label"), "table_ref")
    tables = inventory.select("query_id", "document_id", "parse_version", "table_id").distinct()
    digits = F.regexp_replace("table_id", r"\D", "")
    tables = tables.withColumn("_digits", F.when(digits != "", digits.cast("double")))
    place = F.struct("document_id", "parse_version", "table_id")
    asked = parsed.select("query_id", F.explode("_numbers").alias("_digits"))
    numbered = asked.join(tables, ["query_id", "_digits"], "left").groupBy("query_id", "_digits").agg(F.count("table_id").alias("n"), F.min(place).alias("_at"))
    by_number = numbered.groupBy("query_id").agg(F.max(F.col("n") != 1).alias("_bad"), F.collect_list("_at").alias("_tables"))  # as many as the question numbers
    alone = tables.groupBy("query_id").agg(F.count("*").alias("n"), F.min(place).alias("_only")).where("n = 1").drop("n")
    j = parsed.join(by_number, "query_id", "left").join(alone, "query_id", "left")
    bound = F.when(F.size("_numbers") > 0, F.when(~F.col("_bad"), F.col("_tables"))).when(F.col("_only").isNotNull(), F.array("_only"))
    known = F.coalesce(F.size(bound) > 0, F.lit(False)) & (F.size("_columns") > 0)
    each = j.select("query_id", F.when(known, "resolved").otherwise("unknown").alias("status"), "row_index", "row_label", "table_ref", F.explode_outer(F.when(known, bound)).alias("_t"), "_columns")
    return each.select("query_id", "status", "_t.*", "row_index", "row_label", "table_ref", F.explode_outer(F.when(F.col("status") == "resolved", F.col("_columns"))).alias("column"))


def answered(targets: DataFrame, facts: DataFrame) -> DataFrame:
    """query_id, expected, missing and status of ``planned`` targets against facts (query_id, document_id, parse_version, table_id,
    row_index, row_label, column_name, term) that came back: complete, missing, or unknown where nothing is demanded.

    A fact meets a target of its table if its column or term is the target's, or none is named, and its row's number or name is
    the target's, or none is named. One equi-join: each fact stands under each of the keys that it meets.
    """
    rows = F.array(F.concat(F.lit("index:"), F.coalesce("row_index", F.lit(0)).cast("string")), F.lit("any"), F.when(F.trim(F.coalesce("row_label", F.lit(""))) != "", F.concat(F.lit("label:"), column_key(F.col("row_label")))))
    names = F.array_distinct(F.array(column_key(F.col("term")), column_key(F.col("column_name")), F.lit("")))
    table = ["query_id", "document_id", "parse_version", "table_id"]
    have = facts.select(*table, F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("_row"), names.alias("_names")).select(*table, "_row", F.explode("_names").alias("column")).distinct().withColumn("_met", F.lit(1))
    row = F.when(F.col("row_index").isNotNull(), F.concat(F.lit("index:"), F.col("row_index").cast("string"))).when(F.col("row_label").isNotNull(), F.concat(F.lit("label:"), column_key(F.col("row_label")))).otherwise("any")
    j = targets.withColumn("_row", row).join(have, [*table, "_row", "column"], "left")
    g = j.groupBy("query_id").agg(F.count_if(F.col("status") == "resolved").alias("expected"), F.count_if((F.col("status") == "resolved") & F.col("_met").isNull()).alias("missing"))
    return g.withColumn("status", F.when(F.col("expected") == 0, "unknown").when(F.col("missing") > 0, "missing").otherwise("complete"))
