import random

import pytest

from freshet.llm import toxicity as tox


def brute_segments(scores):
    """Maximal scoring segments by their definition: recurse around the best one."""

    def best(lo, hi):
        found = None
        for a in range(lo, hi):
            for b in range(a + 1, hi + 1):
                s = sum(scores[a:b])
                # Ties: of equal sums the shorter, then the earlier.
                if s > 0 and (found is None or (s, a - b, -a) > (found[2], found[0] - found[1], -found[0])):
                    found = (a, b, s)
        if found is None:
            return []
        a, b, s = found
        return best(lo, a) + [found] + best(b, hi)

    return best(0, len(scores))


@pytest.mark.parametrize("seed", range(30))
def test_segments_equal_definition(seed):
    draw = random.Random(seed)
    scores = [draw.choice([-3, -2, -1, 1, 2, 3]) + draw.random() / 100 for _ in range(25)]
    got = tox.segments([(k, k + 1, s) for k, s in enumerate(scores)])
    want = brute_segments(scores)
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
    assert [s for *_, s in got] == pytest.approx([s for *_, s in want])


def test_many_runs_stay_linear():
    scores = [(k, k + 1, 1.0 if k % 2 else -1.5) for k in range(200_000)]
    assert len(tox.segments(scores)) == 100_000


def made(spark, n=600):
    draw = random.Random(5)
    rows, labels = [], []
    for k in range(n):
        words = [f"w{draw.randrange(300)}" for _ in range(draw.randrange(20, 200))]
        words = ["".join(chr(97 + int(c)) for c in w[1:]) + "q" for w in words]
        bad = k % 6 == 0
        if bad:
            at = draw.randrange(len(words))
            words[at:at] = [draw.choice(["vile", "rotten", "filth"]) for _ in range(4)]
        rows.append((k, " ".join(words)))
        labels.append((k, int(bad), 1))
    return (
        spark.createDataFrame(rows, "doc_id long, text string"),
        spark.createDataFrame(labels, "doc_id long, toxic int, quality int"),
    )


def test_held_out_accuracy_and_passages(spark):
    docs, labels = made(spark)
    model = tox.train_toxicity(docs, labels.where("doc_id % 5 <> 0"))
    got = tox.toxicity(docs, model).join(labels, "doc_id").where("doc_id % 5 = 0").collect()
    assert all(r["predicted"] == r["toxic"] for r in got)
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in got:
        found = " ".join(text[r["doc_id"]][p["start"] : p["end"]] for p in r["passages"])
        assert bool(found) == bool(r["toxic"])
        if found:
            assert set(found.split()) <= {"vile", "rotten", "filth"}


def test_odd_rows(odd_docs, spark):
    docs, labels = made(spark)
    odd = spark.createDataFrame(
        [(None, 1), (1, None), (3, 7), (4, 0), (4, 1), (4, 1)], "doc_id long, toxic int"
    )
    model = tox.train_toxicity(docs, labels.select("doc_id", "toxic").union(odd))
    got = tox.toxicity(odd_docs, model).collect()
    assert len(got) == odd_docs.count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert tox.toxicity(odd_docs.limit(0), model).count() == 0


def test_nothing_to_learn_from(odd_docs, spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = tox.train_toxicity(odd_docs, none)
    assert {r["predicted"] for r in tox.toxicity(odd_docs, model).collect()} <= {0, 1}
    one_class = spark.createDataFrame([(1, 0), (7, 0)], "doc_id long, toxic int")
    model = tox.train_toxicity(odd_docs, one_class)
    assert {r["predicted"] for r in tox.toxicity(odd_docs, model).collect()} == {0}
