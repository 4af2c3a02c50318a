"""Training runs come from anywhere in long texts."""

from chunklore.llm import linecrf


def test_late_lines_are_learned_from(spark):
    text = "\n".join(f"line {i:04d} with words" for i in range(500))
    rows = [(i, text) for i in range(200)] + [(200 + i, "short\ntext") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(250)], "doc_id long, quality int")
    found = [t for _, t in linecrf.training_sample(docs, labels, 3000, 600, "doc_id", "text", "quality")]
    runs = [t for t in found if t != "short\ntext"]
    assert len(runs) > 100 and len(found) > len(runs) and all(len(t) <= 600 and t.startswith("line ") for t in runs)
    first = [int(t[5:9]) for t in runs]
    assert min(first) < 100 and max(first) > 400 and len(set(first)) > 50
