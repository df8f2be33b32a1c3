import random

import numpy as np

from skarn.llm import boilerplate as B
from tests.brute import rows

PARENTS = "parent_id string, rel_path string, text string, source string"
FILES = "rel_path string, source string, letters int"


def test_counted_lines():
    text = "Share this page now\n# Share this page now\n| Share this page now\n<p>Share this page now\n````\nShare this page now\n```\nShare this page now\n````\n*SHARE* this page, now 2024!\nshort line\n~~~\nopen to the end line"
    assert B.counted_lines(text) == [(1, "sharethispagenow"), (10, "sharethispagenow")]
    assert B.counted_lines(None) == [] and B.counted_lines("") == []
    assert B.letters_of("Ä² ① ß_9 é́x\nТест") == "äßéx\nтест"


def test_values_are_equal_for_equal_forms_and_alike_for_similar():
    a = "contentofthisreleaseisprovidedwithoutwarranty"
    v = B.min_hashes([a, a, a + "s", "x" * 12, "abc"])
    assert (v[0] == v[1]).all() and v.shape == (5, B.BANDS * B.BAND_ROWS)
    assert (v[0] == v[2]).mean() > 0.8 > 0.3 > (v[0] == v[3]).mean()


def test_numbers_dates_and_names_are_masked():
    form = lambda line: B.masked(line, B.letters_of(line))
    assert form("Last changed on 3 May 2024 by Jane Smith for all readers") == form("*Last* changed on 12 Sept 2019 by Bob Lee Jones for all readers") == "lastchangedonbyforallreaders"
    assert form("by Jane Smith, Monday") == "byjanesmithmonday"  # too little would be left


def test_hash_functions_are_independent():
    r, found, expected = random.Random(5), 0, 0.0
    for _ in range(4000):
        a, b = ("".join(r.choice("abcdefghijklmnop") for _ in range(40)) for _ in range(2))
        b = a[: r.randrange(8, 20)] + b
        v = B.min_hashes([a, b[:40]])
        found += (v[0] == v[1]).reshape(B.BANDS, B.BAND_ROWS).all(axis=1).any()
        expected += 1 - (1 - B.similarity(a, b[:40]) ** B.BAND_ROWS) ** B.BANDS
    assert 0.5 * expected < found < 1.6 * expected


def _corpus(n=12):
    rows_, files = [], []
    for i in range(n):
        path, source = f"f{i}", "wiki" if i % 2 == 0 or i > n - 3 else "app"
        rows_.append((f"p{i}", path, f"Intro number words {i}\nCopyright {2000 + i} the Tools Group!\nunique line about topic {chr(97 + i) * 12}", None))
        files.append((path, source, 1))
    return rows_, files


def test_repeated_lines(spark):
    parents, files = _corpus(20)
    parents += [("p0", "f0", parents[0][2], None), ("null", None, parents[0][2], None), ("lost", "unknown", parents[0][2], None), ("nosource", "ns", parents[0][2], None), ("t", "f0", None, None), (None, "f1", "x", None), ("empty", "f0", "", None)]
    files += [("f0", "wiki", 2), ("ns", None, 3), (None, "wiki", 4)]
    p, f = spark.createDataFrame(parents, PARENTS), spark.createDataFrame(files, FILES)
    wiki = sorted({x[0] for x in files if x[1] == "wiki" and x[0]})
    assert len(wiki) >= 10
    want = sorted((f"p{x[1:]}", n) for x in wiki for n in (1, 2))
    assert rows(B.repeated_lines(p, f)) == sorted(want, key=str)
    assert B.repeated_lines(p, f, min_paths=len(wiki) + 1).count() == 0
    assert B.repeated_lines(p.limit(0), f).count() == 0
    assert B.repeated_lines(p, f.limit(0)).count() == 0


def test_cleaned_sections(spark):
    parents, files = _corpus(20)
    parents += [("t", "f0", None, None), ("other", "unknown", "keep\nall", None)]
    p, f = spark.createDataFrame(parents, PARENTS), spark.createDataFrame(files, FILES)
    got = {r["parent_id"]: (r["text"], r["n_removed"]) for r in B.cleaned_sections(p, f).collect()}
    assert got["p0"][1] == 2 and got["p0"][0].startswith("unique line")
    assert got["t"] == (None, 0) and got["other"] == ("keep\nall", 0)
    assert got["p1"][1] == 0  # the other source has too few paths


def test_one_path_holds_most_sections(spark):
    p = spark.createDataFrame([(f"p{i}", "big" if i % 3 else f"f{i}", f"a line that stands here\nother {i}", None) for i in range(300)], PARENTS)
    f = spark.createDataFrame([(x, "wiki", 1) for x in {r[0] for r in p.select("rel_path").distinct().collect()}], FILES)
    assert B.sourced_lines(p, f, rows_per_salt=20).count() == B.sourced_lines(p, f).count() == 300


def test_one_source_holds_nearly_all(spark):
    parents = [(f"p{i}", f"f{i}", f"the same notice stands here\nand text {i}", None) for i in range(2000)]
    p, f = spark.createDataFrame(parents, PARENTS), spark.createDataFrame([(x[1], "wiki", 1) for x in parents], FILES)
    assert B.repeated_lines(p, f).count() == 2000


def test_lines_that_only_look_a_little_like_a_notice_stay(spark):
    notice, r = "See the release notes for details of every change in this version of the product", random.Random(1)
    base = B.letters_of(notice)
    unlike = []
    while len(unlike) < 40:
        line = notice[: r.randrange(35, 62)] + "".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(10, 40)))
        if 0.3 <= B.similarity(base, B.letters_of(line)) <= 0.6:
            unlike.append(line)
    like = [notice + " line", notice.replace("details", "detail")]
    parents = [(f"p{i}", f"f{i}", notice, None) for i in range(20)] + [(f"q{i}", f"g{i}", line, None) for i, line in enumerate(unlike)] + [(f"s{i}", f"h{i}", line, None) for i, line in enumerate(like)]
    f = spark.createDataFrame([(x[1], "wiki", 1) for x in parents], FILES)
    p = spark.createDataFrame(parents, PARENTS)
    got = {x["parent_id"]: x["n_removed"] for x in B.cleaned_sections(p, f).collect()}
    assert all(got[x[0]] == (x[0][0] == "p") for x in parents if x[0][0] != "s")
    assert sum(got[f"s{i}"] for i in range(2)) >= 1
    assert {x["parent_id"] for x in B.repeated_lines(p, f).collect()} == {f"p{i}" for i in range(20)}


def test_clusters_count_paths_of_verified_lines_only(spark):
    values = np.arange(16, dtype=np.uint16)
    other = values.copy()
    other[:6] += 100
    longs = lambda v: v.view(np.int64).tolist()
    df = spark.createDataFrame([("a", longs(values), longs(values)), ("b", longs(other), longs(values))], "letters string, bands array<bigint>, leader_bands array<bigint>")
    assert rows(B.agreeing(df)) == [("a",)] and len(rows(B.agreeing(df, 10))) == 2
    forms = spark.createDataFrame([("a", "sharethispagenow", "sharethispagenow"), ("b", "sharethispagenow", "sharethatpagelater")], "letters string, form string, leader_form string")
    assert rows(B.similar_forms(forms)) == [("a",)]


def test_found_rows_come_through_the_clusters(spark, monkeypatch):
    parents, files = _corpus(20)
    p, f = spark.createDataFrame(parents, PARENTS), spark.createDataFrame(files, FILES)
    lines = B.bucket_lines(B.sourced_lines(p, f))
    monkeypatch.setattr(B, "line_clusters", lambda *a: (spark.createDataFrame([], "source string, letters bigint, n_own bigint, cluster bigint, n_paths bigint"), lines))
    assert B.repeated_lines(p, f).count() == 0
    assert B.cleaned_sections(p, f).where("n_removed > 0").count() == 0


def test_same_letters_in_other_case_are_one_line(spark):
    line = "Last changed on Monday by Jane Smith for all the readers"
    parents = [(f"p{i}", f"f{i}", line if i % 2 else line.lower(), None) for i in range(11)]
    p, f = spark.createDataFrame(parents, PARENTS), spark.createDataFrame([(x[1], "wiki", 1) for x in parents], FILES)
    assert B.repeated_lines(p, f).count() == 11
