import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from freshet.llm import phrases
from freshet.llm.queries import QUERIES

COMMON = "of the a in to is on for with by as at from it be or an are was that".split()


def texts(n, seed):
    draw = random.Random(seed)
    names = ["new york city hall", "machine learning", "once upon a time", "the end"]
    for _ in range(n):
        out = []
        for _ in range(draw.randrange(3, 60)):
            out.append(draw.choice(names) if draw.random() < 0.15 else draw.choice(COMMON))
            out.append(draw.choice([" ", " ", " ", "  ", "\t", ", ", ". ", "\n", "\x0b", "\xa0"]))
        yield "".join(out).title() if draw.random() < 0.2 else "".join(out)


def lower(text):
    return "".join(c.lower() if c.isascii() else c for c in text)


def pieces(text):
    for piece in re.split("[.,;:!?\n-\r]", lower(text or "")):
        yield re.findall("[^ \t]+", piece)


def brute_counts(rows, least):
    counts, totals = Counter(), Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        totals[lang] += 0
        for words in pieces(text):
            totals[lang] += len(words)
            for width in range(1, 5):
                for k in range(len(words) - width + 1):
                    counts[lang, tuple(words[k : k + width])] += 1
    return {p: n for p, n in counts.items() if n >= least}, totals


def brute(rows, least=30, first=2000):
    f, totals = brute_counts(rows, least)
    kept = defaultdict(list)
    for (lang, words), a in f.items():
        if len(words) < 2:
            continue
        inside = any(
            x == lang and len(longer) > len(words) and 100 * b >= 80 * a
            and any(longer[k : k + len(words)] == words for k in range(len(longer) - len(words) + 1))
            for (x, longer), b in f.items()
        )
        if not inside:
            score, _, left, right = min(
                (2_000_000 * a // (f[lang, words[:k]] + f[lang, words[k:]]), k, f[lang, words[:k]], f[lang, words[k:]])
                for k in range(1, len(words))
            )
            kept[lang].append((-score, -a, " ".join(words).encode(), left, right))
    out = []
    for lang, some in kept.items():
        for rank, (score, a, phrase, left, right) in enumerate(sorted(some)[:first], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def rows_of(n, seed):
    langs = ["en", "de", None, "und"]
    rows = [(k, t, langs[k % 4]) for k, t in enumerate(texts(n, seed))]
    return [*rows, (n, None, "en"), (n + 1, "", "fr"), (None, rows[0][1], "en"), rows[1], rows[1], (n + 2, "new york city hall, " * 3000, "de")]


def got_of(df):
    return sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in df.collect())


def test_registered_query(spark, tmp_path):
    rows = rows_of(400, 1)
    docs = spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, text string, lang string, a int, phrase string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = brute(rows)
    assert got_of(QUERIES["op13_phrase_collocations"](spark, str(tmp_path))) == want
    assert {r[0] for r in want} == {"en", "de", "und"} and any(len(r[2].split()) == 4 for r in want)


@pytest.mark.parametrize("bits", [6, 12])
def test_collisions_change_nothing(spark, bits):
    rows = rows_of(150, 2)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert got_of(phrases.collocations(docs, bits=bits, least=12, first=50)) == brute(rows, 12, 50)


def test_a_full_sieve_changes_nothing(spark):
    rows = rows_of(150, 3)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert got_of(phrases.collocations(docs, limit=64, least=12)) == brute(rows, 12)


def test_slices_change_nothing_and_pointers_point(monkeypatch):
    rows = [(k, t, None) for k, t in enumerate(texts(40, 4))]
    rows = [*rows, (40, None, None), (41, "", None), (42, "a b", None), (43, "ürger c", None)]
    column = pa.array(["left out", *(t for _, t, _ in rows)])[1:]
    monkeypatch.setattr(phrases, "SLICE", 200)
    counts = Counter()
    for first, part in phrases.read_slices(column, phrases._seeds(["und"] * len(rows))):
        for width in (1, 2, 3, 4):
            at, prints = part.prints(width)
            for p, value in zip(at.tolist(), prints.tolist()):
                [words] = (t.decode() for t in part.phrases(np.array([p]), width))
                counts[width, words, value] += 1
                row = part.row[p]
                text = lower(rows[first + row][1]).encode()[part.start[p] - part.origin[row] :].decode()
                assert " ".join(re.split("[ \t]+", text)).startswith(words)
    want = Counter()
    for (_, words), n in brute_counts(rows, 1)[0].items():
        want[len(words), " ".join(words)] += n
    got = Counter()
    for (width, words, _), n in counts.items():
        got[width, words] += n
    assert got == want
    assert len({(w, p) for w, p, _ in counts}) == len({v for _, _, v in counts})


def test_large_figures_are_exact(spark):
    big = 3 * 10**15 + 1
    rows = [("en", "x", 1, 2 * big, 0, 0), ("en", "y", 1, 3 * big + 5, 0, 0), ("en", "x y", 2, big, 0, 0)]
    frequent = spark.createDataFrame(rows, "group string, phrase string, width int, a long, doc long, at long")
    [r] = phrases.scored_phrases(frequent).collect()
    assert r["score"] == 2_000_000 * big // (5 * big + 5)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert phrases.collocations(docs).count() == 0
