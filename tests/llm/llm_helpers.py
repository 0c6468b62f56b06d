import random
import tempfile

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid string, doc string, n_words int, label int, h long"


def words(rng: random.Random, n: int, vocabulary: int = 400) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}x" for _ in range(n)]


def corpus() -> list[tuple[int | None, str | None]]:
    """Plain, equal, nearly equal, null, empty and very long texts, junk, repeated rows and a null id."""
    rng = random.Random(5)
    rows: list[tuple[int | None, str | None]] = []
    base = [" ".join(words(rng, rng.randrange(60, 160))) for _ in range(12)]
    for i, t in enumerate(base):
        rows.append((i, t))
    for i, t in enumerate(base[:6]):
        w = t.split()
        w[3] = "changed"
        rows.append((20 + i, " ".join(w)))
    rows += [(30, base[0]), (31, base[0]), (32, None), (33, ""), (34, " \n\t "), (35, "One two"), (36, "one TWO")]
    rows += [(40, "be " * 900), (41, "ab" * 400), (42, "ab" * 400 + "c"), (43, "Größe été. " * 3 + base[2].upper())]
    rows += [(50, "\n".join([base[4], "A shared line of text", base[5]])), (51, "a shared LINE of text \nshort"), (51, "a shared LINE of text \nshort"), (None, "a shared line of text")]
    rows.append((60, " ".join(words(rng, 6000, 3000))))
    return rows


def frame(spark: SparkSession, rows: list[tuple[int | None, str | None]]) -> DataFrame:
    """Rows read from files, with more columns whose names the operators use themselves."""
    path = tempfile.mkdtemp(prefix="cirrus-test-") + "/documents.parquet"
    full = [(i, t, None if k % 3 else "en", f"s{k % 2}", len(t) if t is not None else None, "r", "d", 1, 2, 3) for k, (i, t) in enumerate(rows)]
    spark.createDataFrame(full, SCHEMA).repartition(2).write.parquet(path)
    return spark.read.parquet(path)
