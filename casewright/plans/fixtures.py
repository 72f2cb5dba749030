"""Small tables of the caller, the same in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.operators import gates

#: code, name, category, severity, keywords
TAXONOMY = [
    ("X60-X84", "self harm", "X", 5, ["worthless", "trash"]), ("F32", "low mood", "F", 4, ["clown", "idiot", "worthless"]), ("0102", "public housing", "01", 3, ["licensed under", "public license", "released"]), ("0206", "open debts", "02", 3, ["password", "token"]),
    ("1005", "money", "10", 2, ["password=", "apache"]), ("Z59.0", "no shelter", "Z", 2, ["which", "tionst"]), ("0801", "shelter need", "08", 3, ["tionst", "heand", "that the"]), ("1205", "work", "12", 1, [" que ", " der ", "ment"]),
]
CONFLICTS = [("X60-X84", "0102"), ("X60-X84", "0206"), ("0801", "1205")]
GROUPS = [("0801", "shelter", 1), ("Z59.0", "shelter", 0)]
PREFERS = [("1205", "0801"), ("1005", "0206")]
#: prefix, priority, scope, has, also, valid, mult, reason
RULES = [
    ("F", 1, "window", ["not ", "never"], [], False, 0.3, "denied"), ("F", 2, "window", ["clown", "idiot"], ["you", "are"], True, 0.9, "together"), ("X60-X84", 1, "text", ["worthless"], ["trash"], True, 1.0, "both in text"), ("X60-X84", 2, "window", [], [], False, 0.25, "alone"),
    ("08", 1, "window", [" the"], [], True, 0.85, "category"), ("0801", 2, "text", ["which"], [], False, 0.4, "own code"), ("12", 1, "window", ["zzzz"], [], False, 0.1, "never seen"), ("02", 1, "window", ["password"], [":", "="], True, 0.88, "secret"), ("02", 2, "text", [], [], False, 0.3, "otherwise"),
]
MARKERS = gates.Markers(clause=[",", ";", " but "], negation=["not ", "nicht ", "pas ", "ne "], exceptions=["only"], own=[" i ", " ich ", " je "], other=[" he ", " er ", " il "], reported=[" said ", " released", "licensed"])
TOOLS = [("mood scale", ["low mood", "worthless"]), ("home visit", ["shelter", "public housing"]), ("budget sheet", ["money", "open debts", "token"])]


def values(spark: SparkSession, sql: str) -> DataFrame:
    return spark.sql(sql)


def _q(v) -> str:
    if isinstance(v, float):
        return f"{v!r}::DOUBLE"
    if v == []:
        return "[]::VARCHAR[]"
    return "[" + ", ".join(map(_q, v)) + "]" if isinstance(v, list) else str(v).lower() if isinstance(v, int) else "'" + v.replace("'", "''") + "'"


def _rows(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(map(_q, r)) + ")" for r in rows)


def frame(spark: SparkSession, rows: list[tuple], names: str) -> DataFrame:
    text = _rows(rows).replace("[", "array(").replace("]", ")")
    return spark.sql(f"SELECT * FROM VALUES {text} AS t({names})")


TAXONOMY_SQL = f"(SELECT * FROM (VALUES {_rows(TAXONOMY)}) t(code, name, category, severity, keywords))"
CONFLICTS_SQL, GROUPS_SQL, PREFERS_SQL = (f"(SELECT * FROM (VALUES {_rows(r)}) t({n}))" for r, n in ((CONFLICTS, "code, other"), (GROUPS, "code, grp, preferred"), (PREFERS, "generic, specific")))
RULES_SQL = f"(SELECT * FROM (VALUES {_rows(RULES)}) t(prefix, priority, scope, has, also, valid, mult, reason))"
TOOLS_SQL = f"(SELECT * FROM (VALUES {_rows(TOOLS)}) t(tool, uses))"


def taxonomy(spark: SparkSession) -> DataFrame:
    return frame(spark, TAXONOMY, "code, name, category, severity, keywords")


def cases(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").alias("case_id"), "text")


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "prefix string, priority int, scope string, has array<string>, also array<string>, valid boolean, mult double, reason string")
