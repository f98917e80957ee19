import numpy as np
import pytest

from spendlens.llm import licenses as C


def brute(text, templates, threshold):
    lines = [C.normal(x) for x in (text or "").split("\n")]
    best = {}
    for i in range(len(lines)):
        for j in range(i + 1, len(lines) + 1):
            window = [w for line in lines[i:j] for w in line]
            for name, t in templates:
                d = C.dice(C.bigrams(window), C.bigrams(C.normal(t)))
                if window and d >= threshold and d > best.get(name, 0):
                    best[name] = d
    return best


def test_size_bounds_lose_no_window():
    rng = np.random.default_rng(6)
    say = lambda n: " ".join(rng.choice(list("abcdefg"), n).tolist())
    templates = [(f"t{i}", say(int(rng.integers(1, 14)))) for i in range(25)]
    for threshold in (0.5, 0.8):
        ready = C.Templates(templates, threshold)
        for _ in range(150):
            text = "\n".join(say(int(rng.integers(0, 6))) for _ in range(int(rng.integers(0, 6))))
            assert {x["licence"]: x["dice"] for x in ready.scan(text)} == pytest.approx(brute(text, templates, threshold))


def test_documents(spark):
    mit = C.TEMPLATES["MIT"]
    words = mit.split(" ")
    broken = "\n".join(" ".join(words[i : i + 11]) for i in range(0, len(words), 11))
    rows = [
        (1, "Some prose.\nReleased under the MIT License.\nMore prose.", "kept"),
        (2, "Header\n" + broken.replace("charge", "cost") + "\n\nthe code", "kept"),
        (3, "nothing here", "kept"), (4, None, "kept"), (5, "", "kept"), (1, "LICENSED UNDER CC BY-NC 4.0", "kept"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, licences string")
    got = C.scan(docs)
    assert got.columns == ["doc_id", "text", "licences"]
    rows = sorted((tuple(r) for r in C.best(got).collect()), key=str)
    assert [(r[0], r[1]) for r in rows] == [(1, "CC-BY-NC-4.0-notice"), (1, "MIT-notice"), (2, "MIT"), (3, None), (4, None), (5, None)]
    assert rows[1][2:] == (1.0, 1, 2, 1) and rows[2][3] == 1 and 0.97 < rows[2][2] < 1
    none = spark.createDataFrame([], "licence string, text string")
    assert C.scan(docs, none).filter("size(licences) > 0").count() == 0
    assert C.scan(docs.limit(0)).count() == 0


def brute_words(text, templates, threshold):
    """All windows of words, wherever lines end."""
    words = [w for x in (text or "").split("\n") for w in C.normal(x)]
    best = {}
    for i in range(len(words)):
        for j in range(i + 1, len(words) + 1):
            for name, t in templates:
                d = C.dice(C.bigrams(words[i:j]), C.bigrams(C.normal(t)))
                if d >= threshold and d > best.get(name, 0):
                    best[name] = d
    return best


def test_windows_of_words_against_brute_force():
    rng = np.random.default_rng(8)
    say = lambda n: " ".join(rng.choice(list("abcdefg"), n).tolist())
    templates = [(f"t{i}", say(int(rng.integers(1, 14)))) for i in range(15)]
    found = 0
    for threshold in (0.5, 0.8):
        ready = C.Templates(templates, threshold)
        for _ in range(40):
            text = "\n".join(say(int(rng.integers(0, 12))) for _ in range(int(rng.integers(0, 4))))
            want = brute_words(text, templates, threshold)
            found += len(want)
            assert {x["licence"]: x["dice"] for x in ready.passages(text)} == pytest.approx(want)
    assert found > 50


def test_notices_inside_long_lines(spark):
    prose = "some words of ordinary prose that go on and on before and after the notice " * 12
    one_line = prose + "Copyright 2020 the authors. " + C.TEMPLATES["MIT"] + " " + prose
    rows = [(1, prose + "Released under the MIT License. " + prose), (2, "first\n" + one_line), (3, prose)]
    got = {r["doc_id"]: r["licences"] for r in C.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert tuple(got[1][0]) == ("MIT-notice", 1.0, 0, 1) and tuple(got[2][0]) == ("MIT", 1.0, 1, 2) and got[3] == []


def test_every_built_in_template_is_found_in_prose():
    rows = C.built_in()
    assert len(rows) == len(dict(rows)) >= 60 and {"BSD-3-Clause-text", "Apache-2.0-text", "GPL-3.0-text", "MPL-2.0-text", "Unlicense-text", "Zlib-text"} <= set(dict(rows))
    ready = C.Templates(rows, C.THRESHOLD)
    for name, text in rows:
        found = {x["licence"]: x["dice"] for x in ready.passages(f"zebra quagga\nokapi {text} gnu\nkudu")}
        assert found[name] == 1.0 == max(found.values())


def test_whole_texts_are_found_by_default(spark):
    name = "BSD-3-Clause"
    body = (C.TEXTS / f"{name}.txt").read_text().replace("REGENTS", "AUTHORS")
    docs = spark.createDataFrame([(1, "Copyright 2020 A. Author\n" + body)], "doc_id long, text string")
    got = C.scan(docs).collect()[0]["licences"]
    assert got[0]["licence"] == f"{name}-text" and 0.95 < got[0]["dice"] <= 1


def test_query_returns_all_licences(spark, tmp_path):
    from spendlens.llm import queries

    text = "Some prose.\nReleased under the MIT License.\nAll rights reserved."
    spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op8_dice_licence_scan(spark, str(tmp_path)).collect()}
    assert [tuple(x) for x in got[1]["licences"]] == [("MIT-notice", 1.0, 1, 2), ("Proprietary", 1.0, 2, 3)]
    assert got[1]["licence"] == "MIT-notice" and got[1]["n_licences"] == 2 and got[2]["licences"] == []
