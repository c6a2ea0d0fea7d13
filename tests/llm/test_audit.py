"""The filter audit against plain sets."""

import random
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from tidegrid.llm import audit

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, part string, A string, good int, digest string"


def test_runs_equal_sets():
    draw = random.Random(1)
    for _ in range(300):
        lists = [sorted(draw.sample(range(60), draw.choice([0, 1, 5, 30, 60]))) for _ in range(draw.randint(0, 7))]
        got, want = audit.runs(lists), {}
        for i in range(60):
            if mask := sum(1 << k for k, ids in enumerate(lists) if i in ids):
                want[mask] = want.get(mask, 0) + 1
        assert dict(got) == want
    ids = list(range(0, 1000, 3))
    assert all(audit.gallop(ids, b, bound) == next((i for i in range(b, len(ids)) if ids[i] >= bound), len(ids)) for b in (0, 5, 333) for bound in range(ids[b] + 1, 1003, 7))


def plain(docs, labels):
    """What the contract says, by sets of row numbers."""
    fails = {k: set() for k in "ABCDE"}
    for i, (doc_id, text, _) in enumerate(docs):
        text = text or ""
        words = [w for w in text.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
        tests = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text), "D": any(c in "#$%&*|" for c in text)}
        tests["E"] = doc_id is not None and any(o is not None and o < doc_id and (t or "") == text for o, t, _ in docs)
        for k, failed in tests.items():
            fails[k] |= {i} if failed else set()
    of = {name: {i for i, d in enumerate(docs) if any(x[0] == d[0] and d[0] is not None and x[at] == 1 for x in labels)} for name, at in (("good", 1), ("toxic", 2))}
    out = []
    for part in {d[2] or "" for d in docs}:
        mine = {i for i, d in enumerate(docs) if (d[2] or "") == part}
        rows, total = [], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            gone = set()
            for step, k in enumerate(order, 1):
                failing = fails[k] & mine
                new = failing - gone
                gone = gone | failing
                total[k] += len(new)
                only = failing - set().union(*(fails[o] for o in "ABCDE" if o != k))
                rows.append((part, "".join(order), step, len(mine) - len(gone), len(new), len(failing) - len(new), len(only), len(new & of["good"]), len(new & of["toxic"]), k))
        out += [(*r[:-1], total[r[-1]]) for r in rows]
    return sorted(out)


@pytest.mark.parametrize("width", [audit.RANGE, 3])
def test_audit_equals_sets(spark, monkeypatch, tmp_path, width):
    monkeypatch.setattr(audit, "RANGE", width)
    draw = random.Random(2)
    pool = ["", None, "one two", "A " * 150, "w\u00e4lder\x85x\u2003y " * 220, "a#b", "Abc DEF " * 3, "Abc", *(" ".join(f"w{draw.randrange(400)}" for _ in range(n)) for n in (199, 200, 201, 5000)), "x\t\n\x0b\x0c\r y" * 30]
    docs = [(draw.choice([None, *range(40)]), draw.choice(pool), draw.choice(["s", "s", "t", None, ""])) for _ in range(90)] + [(7, "same", "s")] * 3 + [(99, "z " * 300_000, "u")]
    labels = [(draw.choice([None, *range(45)]), draw.choice([0, 1, None]), draw.choice([0, 1, None])) for _ in range(60)]
    spark.createDataFrame([(i, t, None, s, None, "r", "p", "a", 5, "d") for i, t, s in docs], DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = audit.op11_filter_audit(spark, str(tmp_path))
    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert got.columns == names and sorted(tuple(r) for r in got.collect()) == plain(docs, labels)


def test_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a", None, "s", None, "r", "p", "a", 5, "d")], DOCS)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit_documents(docs.where("false"), labels).count() == 0
    got = audit.audit_documents(docs, labels)
    # one short document fails A alone: A removes it wherever it comes
    assert got.count() == 600 and got.where("filter_order LIKE 'A%'").agg(F.sum("kept"), F.sum("removed"), F.sum("good_lost")).first()[:] == (0, 24, 0)
    assert {(r.letter, r.shapley) for r in got.selectExpr("substr(filter_order, step, 1) AS letter", "shapley").distinct().collect()} == {("A", 120), *((k, 0) for k in "BCDE")}
    with pytest.raises(ValueError):
        audit.interactions(spark.createDataFrame([], "part string, mask int, size long"), list("ABCDEFG"), [])
