"""Small frames with nulls, empty and long texts, ties, repeated rows and columns that clash with internal names."""

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, hash string, label string, line string, n string, _gone string, token string, start string, bits string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
LONG = " ".join(f"{WORDS[k % 24]}{k % 97}" for k in range(30_000))


def docs(spark: SparkSession, rows: list[tuple[int | None, str | None]]) -> DataFrame:
    full = [(i, t, "en", "src", len(t or ""), *["x"] * 9) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)


def edges(spark: SparkSession) -> DataFrame:
    line = " ".join(WORDS[:20])
    return docs(spark, [
        (1, None), (2, ""), (3, " \n\t "), (4, line), (4, line), (5, line + "\n" + line), (6, LONG), (7, LONG + " end"),
        (8, "123 456 !!"), (9, "é ü 漢字"), (None, line), (None, None), (10, line.upper()), (11, "one"), (12, "one"),
    ])


def empty(spark: SparkSession) -> DataFrame:
    return docs(spark, [(1, "x")]).where("doc_id < 0")


def rows(df: DataFrame, *names: str) -> list[tuple]:
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)
