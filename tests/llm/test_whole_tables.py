"""Operators on tables larger, or of more classes, than what they learn from."""

import random
import textwrap

from pyspark.sql import functions as F

from crestline.llm import language, licenses, secrets


def test_rare_secrets(spark):
    """Few confirmed secrets among more findings than a sample of documents holds are learned and masked."""
    hex40 = F.sha1(F.col("doc_id").cast("string").cast("binary"))
    plain = spark.range(60_000).select(F.col("id").alias("doc_id")).withColumn("text", F.concat(F.lit("the file at http://host/"), hex40, F.lit(" was copied")))
    # Ids that a sample of every second document leaves out.
    ids = [r["id"] for r in spark.range(100_000, 100_100).where(F.pmod(F.xxhash64("id"), F.lit(2)) == 1).limit(12).collect()]
    keys = [f"AKIA{chr(65 + k) * 8}Z{1234567 + k}" for k in range(6)] + [f"{'0123456789abcdef'[k:]}{'fedcba98'}" for k in range(6)]
    kept = [("we found " if k < 6 else "the password = ") + v + " in there" for k, v in enumerate(keys)]
    docs = plain.unionByName(spark.createDataFrame(list(zip(ids, kept)), "doc_id long, text string"))
    got = secrets.scan_with_weak_labels(docs).select("doc_id", "clean", F.exists("findings", lambda x: x["secret"]).alias("hit")).where("hit or doc_id >= 100000").collect()
    assert sorted(r["doc_id"] for r in got) == sorted(ids)
    assert all(secrets.MASK in r["clean"] and not any(v in r["clean"] for v in keys) for r in got)


def test_sample_per_kind(spark):
    """Of each kind the smallest hashes up to the bound; rare kinds repeated; equal findings of rows without ids not lost."""
    texts = [(i, f"nr {i:020d} x") for i in range(300)] + [(None, f"password = {7:020d} x")] * 80 + [(999, f"key AKIA{'A' * 8}12345678 x")]
    got = secrets.weak_findings(spark.createDataFrame(texts, "doc_id long, text string"), most=50, least=10).collect()
    assert sum(r["label"] == 0 for r in got) == 50
    assert sum(r["before"].endswith("= ") for r in got) == 50
    assert sum(r["value"].startswith("AKIA") for r in got) == 10


CODE = "\n".join(f"int f{i}(int a) {{ return a + {i}; }}\n\n// adds {i} to what stands on the left hand" for i in range(60))


def laid_out(name: str, least: int, cuts: tuple[str, ...], mark: str) -> str:
    """A notice in its usual layout: short lines, blank lines before the words in ``cuts``, inside a longer file."""
    body = next(t for n, t in licenses.TEMPLATES if n == name and len(t.split()) > least)
    for c in cuts:
        assert c in body
        body = body.replace(c, "\n\n" + c)
    lines = [x for part in body.split("\n\n") for x in (*textwrap.wrap(part, 70), "")]
    return CODE + "\n\nCopyright 2020 Somebody\n\n" + "\n".join(f"{mark} {x}".rstrip() if x else "" for x in lines) + "\n\n" + CODE


def test_notices_of_several_paragraphs(spark):
    whole = {n: t for n, t in licenses.TEMPLATES if len(t.split()) > 500}
    assert set(whole) >= {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0"}
    files = {
        "MIT": laid_out("MIT", 100, ("The above", "THE SOFTWARE IS"), " *"), "Apache-2.0": laid_out("Apache-2.0", 50, ("You may obtain", "Unless"), "#"),
        "GPL-3.0": laid_out("GPL-3.0", 50, ("This program is dist",), "//"), "GPL-2.0": laid_out("GPL-2.0", 50, ("This program is dist",), ""),
        "BSD-3-Clause": laid_out("BSD-3-Clause", 100, ("1. Re", "2. Re", "3. Ne", "THIS"), " *"), "BSD-2-Clause": laid_out("BSD-2-Clause", 100, ("1. Re", "2. Re", "THIS"), " *"), None: CODE,
    }
    want = [*files, *whole]
    docs = spark.createDataFrame(list(enumerate([*files.values(), *(f"{CODE}\n\n{t}" for t in whole.values())])), "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan_licenses(docs).collect()}
    assert [got[i]["license"] for i in range(len(want))] == want
    assert all(got[i]["score"] > 0.95 and got[i]["n_matches"] < 4 for i, n in enumerate(want) if n)


def test_runs_equal_brute_force():
    """The best run of lines has the score of the best one among all runs of lines."""
    r, names = random.Random(5), [("a", "x y z x y w"), ("b", "p q r s t u v p q"), ("c", "x y p q")]
    m, reached = licenses.Matcher(names, 0.8), 0
    for _ in range(400):
        lines = [[r.choice([b"x", b"y", b"z", b"w", b"p", b"q", b"r"]) for _ in range(r.randrange(4))] for _ in range(7)]
        lines[r.randrange(6) : 7] = [w.split() for w in r.choice([b"x y z|x y w", b"p q r|s t u v|p q", b"x y|p q", b"k"]).split(b"|")]
        best = 0.0
        for i in range(len(lines)):
            for j in range(i + 1, len(lines)):
                got = licenses.bigrams([w for x in lines[i : j + 1] for w in x])
                best = max([best, *(licenses.dice(got, licenses.bigrams(licenses.normalised(t.encode()))) for _, t in names if got)])
        single = max([0.0, *(h[1] for x in lines if (h := m.best(x)))])
        found = max([0.0, *(x[1] for x in m.runs(lines))])
        # A run that only adds empty lines to one line is that line.
        assert max(found, single) == (max(best, single) if max(best, single) >= 0.8 else 0.0)
        reached += found >= 0.8
    assert reached > 100


def test_more_languages_than_one_group(spark):
    """Every labelled language is predicted, and groups of automata give the rows of a single one."""
    r, letters = random.Random(3), "abcdefghijklmnopqrstuvwxyz"
    known = {f"l{k:02d}": ["".join(r.choice(letters) for _ in range(r.randrange(3, 9))) for _ in range(30)] for k in range(70)}
    rows = [(70 * n + k, " ".join(r.choices(words, k=20)), name) for n in range(8) for k, (name, words) in enumerate(known.items())]
    rows += [(None, rows[0][1], "l00"), (None, rows[0][1], "l00"), (10_000, None, "l01"), (10_001, "12 3", "l02"), rows[5], rows[5]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language.identify_from_labels(docs).where("lang_pred <> 'und'").join(docs.dropDuplicates(["doc_id"]), "doc_id").collect()
    assert {x["lang"] for x in got} == set(known) and all(x["lang_pred"] == x["lang"] for x in got)
    texts = language.learn([(x, t) for _, t, x in rows[:140]])
    assert len(language.grouped(texts, 1_000)) > 10

    def found(**options):
        return sorted(map(tuple, language.identify(docs, texts, **options).collect()), key=repr)

    assert found(group_chars=1_000) == found() and len(found()) == len(rows)


def test_vocabulary_of_all_documents(spark, monkeypatch):
    """A frequent word is counted in whatever documents it stands."""
    # Ids that a sample of every second document leaves out.
    missed = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1
    docs = spark.range(45_000).select(F.col("id").alias("doc_id")).withColumn("text", F.when(missed, "quokka").otherwise("zebra"))
    seen = []
    monkeypatch.setattr(secrets, "scan", lambda docs, forest, dictionary, pairs, *rest: seen.append(dictionary))
    secrets.scan_with_weak_labels(docs)
    assert sorted(seen[0]) == ["quokka", "zebra"]
