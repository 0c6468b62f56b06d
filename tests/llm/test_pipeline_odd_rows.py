"""The pipeline over null ids and texts, repeated rows, empty texts, columns with names that the stages use, and an empty table."""

import re

from llm_helpers import SCHEMA, corpus, frame


def prepared(spark, folder, rows):
    df = frame(spark, rows) if rows else spark.createDataFrame([], SCHEMA)
    df.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 60, 3)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "one two three")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE = " \t\n\v\f\r"


def without_lines(rows):
    """Rows with an id, less the lines that a row with a smaller id has too."""
    held = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            held.setdefault(line.strip(SPACE).translate(LOWER), set()).add(i)
    stays = lambda i, key: len(key) < 10 or len(held[key]) < 2 or i == min(held[key])
    return [(i, "\n".join(x for x in (text or "").split("\n") if stays(i, x.strip(SPACE).translate(LOWER)))) for i, text in rows]


def one_of_each_group(rows):
    """Ids left: the least of each class of texts whose five-word shingles are alike; texts without words are alone."""
    sets = []
    for i, text in rows:
        words = [w for w in re.split(f"[{SPACE}]+", text.translate(LOWER)) if w]
        sets.append((i, {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()))
    group = {i: i for i, _ in sets}
    for _ in sets:  # labels spread until they are stable
        for i, a in sets:
            for j, b in sets:
                if a and b and 100 * len(a & b) >= 75 * len(a | b):
                    group[i] = group[j] = min(group[i], group[j])
    return set(group.values())


def test_odd_rows_come_through(spark, tmp_path):
    """Without a toxic label nothing is rejected; line dedup and near-dedup leave what plain versions of them leave, whole rows without words included."""
    import corpus_pipeline

    rows = corpus()
    prepared(spark, tmp_path, rows)
    packed = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "length", "sequence_id").collect()
    ids = {r.doc_id for r in packed}
    assert None in ids and ids - {None} == one_of_each_group(without_lines([r for r in rows if r[0] is not None]))
    used = {}
    for r in packed:
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    assert max(used.values()) <= 4096


def test_empty_table(spark, tmp_path):
    import corpus_pipeline

    prepared(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
