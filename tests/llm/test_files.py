"""How operators store the tables of their rounds."""

from crestline.llm import components as components_module
from crestline.llm import jaccard


def test_jaccard_tables_in_few_files(spark, monkeypatch):
    """Tables of the join go into files by their rows, not one per shuffle partition: each file may make the JVM start a process."""
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[(7 * i) % 90 + j] for j in range(60 + i % 3))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    made, store = {}, jaccard.materialize
    for module in (jaccard, components_module):
        monkeypatch.setattr(module, "materialize", lambda df, name: made.setdefault(f"{name} {len(made)}", store(df, name)))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        left = {r["doc_id"] for r in jaccard.keep_one(docs).collect()}
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for i, t in rows}
    low = {i: i for i in sets}
    for i in sets:
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((low[i], low[j]))
                low = {k: a if v == b else v for k, v in low.items()}
    assert left == {i for i in sets if low[i] == i}
    assert {n: len(df.inputFiles()) for n, df in made.items() if len(df.inputFiles()) > 8} == {}
