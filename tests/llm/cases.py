"""Small tables with the cases that every operator must stand."""

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that operators use themselves; a table may hold them too.
CLASHES = ["score", "predicted", "held_out", "n_tokens", "token_ids", "id", "key", "host", "kept", "pos", "part", "t1", "words", "label", "rate", "copies", "component_id", "removed_lines", "unit", "path", "rule", "rep"]
PROSE = "The reerha rethhe aneden eronea erreingin eder the ea of thoron and bleer statwh rees with ththwh threer thndon oner is onthe shan of inder, that was for the whole of it, and none of them spoke. "


def edge_rows() -> list[tuple]:
    shouted = " ".join(w.upper() + "!!" for w in PROSE.split()) + " "
    rows = [
        (1, PROSE * 3, "en", "a", 1), (2, None, "en", "a", None), (3, "", None, None, 0), (4, " \n\t ", "en", "b", 4), (5, PROSE * 3, "en", "b", 1),
        (6, PROSE * 3 + "\n" + PROSE * 2, "en", None, 1), (7, "word", "en", "a", 4), (8, "\n".join([PROSE] * 4), "en", "a", 1), (9, PROSE * 400, "en", "c", 1),
        (10, "日本 é \x00 ​ <|endoftext|> 12345", "de", "c", 1), (11, shouted * 2, "en", "c", 1), (None, PROSE + "other end", "en", "a", 1), (None, None, None, None, None),
        (12, "x" * 30_000, "en", "a", 1), (5, PROSE * 3, "en", "b", 1), (13, PROSE * 3 + " changed", "de", "a", 1), (14, "a b c d e", "de", "a", 1), (15, "A B C D E", "de", "a", 1),
    ]
    return rows


def edges(spark: SparkSession, clashes: bool = True) -> DataFrame:
    frame = spark.createDataFrame(edge_rows(), SCHEMA)
    for name in CLASHES if clashes else []:
        frame = frame.selectExpr("*", f"'own' AS `{name}`")
    return frame


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def labels(spark: SparkSession, rows=None) -> DataFrame:
    return spark.createDataFrame([(i, int(i != 11), int(i == 7), "own") for i in (1, 2, 4, 5, 6, 7, 8, 9, 11, 99)] if rows is None else rows, "doc_id bigint, quality int, toxic int, text string")
