"""Phrase collocations against counting by brute force, and against SQL."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from chronoloom.llm import phrases, registry
from tests.conftest import rows_of

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, key string, n long, p string, word string, f long, a long"


def counted(rows, least, top):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, 6):
                f[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, of in f.items():
        good = {p: a for p, a in of.items() if 2 <= len(p) and a >= least}
        rows = []
        for p, a in good.items():
            inside = any(len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) and b >= a for q, b in good.items())
            if not inside:
                score, k = min((1000 * a * n[lang] // (of[p[:k]] * of[p[k:]]), k) for k in range(1, len(p)))
                rows.append((score, a, " ".join(p), of[p[:k]], of[p[k:]]))
        rows.sort(key=lambda r: (-r[0], -r[1], r[2].encode()))
        out += [(lang, i, p, a, left, right, n[lang], score) for i, (score, a, p, left, right) in enumerate(rows[:top], 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "k", 1, "p", "w", 2, 3) for i, (t, lang) in enumerate(rows)], SCHEMA)


def test_matches_sql(spark, duck):
    got = registry.op11_phrase_collocations(spark, SF).toPandas()
    assert rows_of(got) == rows_of(duck.sql(registry.SQL["op11_phrase_collocations"]).df()) and len(got)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    words = ["a", "B", "b", "ça", "dd", "e e", "x\x1cy", "日本"]
    text = lambda: "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", " \x0b"]) for _ in range(rng.randrange(40)))
    out = [(text(), rng.choice(["en", "de", None, "und", ""])) for _ in range(150)]
    return out + [(None, "en"), ("", "xx"), ("  \n", None), ("hot hot hot hot hot hot hot", "en")] + [("one common passage of words here. " * 3, "en")] * 40


@pytest.mark.parametrize("budget,hot", [(phrases.BUDGET, 60000), (8, 2), (64, 0)])
def test_brute_force_at_any_budget(spark, rows, monkeypatch, budget, hot):
    monkeypatch.setattr(phrases, "_CODES", hot)
    monkeypatch.setattr(phrases, "_ESCAPE", np.uint16(hot + 1))
    got = phrases.collocations(frame(spark, rows), least=4, top=25, budget=budget)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == counted(rows, 4, 25)


def test_words_that_share_a_key_take_the_next_seed(spark, rows, monkeypatch):
    plain = phrases._vocabulary

    def weak(seed):
        run = plain(seed)
        if seed:
            return run

        def clashing(batches):
            for b in run(batches):
                yield pa.RecordBatch.from_arrays([pa.array(b.column("key").to_numpy() % 3), *b.columns[1:]], b.schema.names)

        return clashing

    texts = frame(spark, rows).selectExpr("cast(coalesce(text, '') as binary) AS text", "coalesce(lang, 'und') AS lang")
    words, seed = phrases.vocabulary(texts, hasher=weak)
    low = lambda t: (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    want = Counter(("und" if lang is None else lang, w) for t, lang in rows for w in re.findall(r"[^\x20\x09.,;:!?\x0A-\x0D]+", low(t)))
    assert seed == 1 and {(r["lang"], bytes(r["word"]).decode()): r["n"] for r in words.collect()} == want


def test_long_texts_and_no_texts(spark):
    long = "alpha beta gamma delta " * 100_000
    got = [tuple(r)[:5] for r in phrases.collocations(frame(spark, [(long, "en")])).collect()]
    want = [r[:5] for r in counted([(long, "en")], 100, 2000)]
    assert sorted(got) == want
    assert phrases.collocations(frame(spark, [])).count() == 0 and phrases.collocations(frame(spark, [("a b c", "en")])).count() == 0
