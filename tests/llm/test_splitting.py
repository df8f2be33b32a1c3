import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skarn.llm import splitting as P
from tests.brute import rows


def _blocks(text):
    """The same blocks by a loop over lines."""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    out, i, run = [], 0, ""

    def flush():
        nonlocal run
        if run:
            out.append(("text", run))
        run = ""

    while i < len(lines):
        m = re.match(r" {0,3}(`{3,}|~{3,})", lines[i])
        j = i
        if m:
            sign, n = m.group(1)[0], len(m.group(1))
            j = i + 1
            while j < len(lines) and not re.match(rf" {{0,3}}{re.escape(sign)}{{{n},}}[ \t\r]*\n?\Z", lines[j]):
                j += 1
            kind, j = "code", min(j + 1, len(lines))
        elif "|" in lines[i] and lines[i].endswith("\n") and i + 1 < len(lines) and re.fullmatch(r"[ \t]*[|:\- \t\r]+\n?", lines[i + 1]) and "-" in lines[i + 1] and "|" in lines[i + 1]:
            kind, j = "table", i + 2
            while j < len(lines) and "|" in lines[j]:
                j += 1
        if j > i:
            flush()
            out.append((kind, "".join(lines[i:j])))
            i = j
        else:
            run += lines[i]
            i += 1
    flush()
    return out


parts = st.sampled_from(["word " * 30, "Sentence one. Two! Three?\n", "\n", "\n\n", "x" * 620, "```\ncode\n\nmore\n```\n", "````py\n```\nstill\n````\n", "~~~\nopen\n", "| a | b |\n|---|---|\n| c | d |\n", "a | b\n", "漢字です。" * 40, "😀" * 90 + " ", "end"])


def test_blocks_and_pieces(spark):
    texts = []

    @settings(max_examples=150, deadline=None)
    @given(st.lists(parts, max_size=25))
    def collect(ps):
        texts.append("".join(ps))

    collect()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    out = df.select("i", P.blocks(F.col("t")).alias("b"), P.pieces(F.col("t")).alias("p"), P.is_one_block(P.pieces(F.col("t"))).alias("one")).collect()
    for r in out:
        text, want = texts[r["i"]], _blocks(texts[r["i"]])
        assert r["b"] == [b for _, b in want]
        solid = [k for k, b in want if b.strip()]
        assert r["one"] == (len(solid) == 1 and solid[0] != "text")
        atoms = [p["text"] for p in r["p"] if p["atomic"]]
        assert atoms == [b for k, b in want if k != "text" and b.strip()]
        runs, left = [b for k, b in want if k == "text" and b.strip()], "".join(p["text"][p["repeated"] :] for p in r["p"] if not p["atomic"])
        assert re.sub(r"\s", "", left) == re.sub(r"\s", "", "".join(runs))
        before = None
        for p in r["p"]:
            new = p["text"][p["repeated"] :]
            if p["atomic"]:
                before = None
                continue
            assert len(new) <= 500 and p["repeated"] <= 100 and new.strip()
            if p["repeated"]:
                assert before.endswith(p["text"][: p["repeated"]])
            if before is not None and len(before) > 100 and p["repeated"]:
                assert p["repeated"] >= 30
            before = p["text"]


def test_html_tables_nested_and_open(spark):
    html = "<table>\n<tr><td>\n<table><tr></tr></table>\n</td></tr>\n</table>\n"
    df = spark.createDataFrame([("a\n" + html + "b\n",), ("<TABLE>\n<tr>\n",), (html * 2,)], "t string")
    assert [r[0] for r in df.select(P.blocks(F.col("t"))).collect()] == [["a\n", html, "b\n"], ["<TABLE>\n<tr>\n"], [html, html]]


def test_null_empty_and_long(spark):
    r = random.Random(2)
    long = "".join(r.choice(["word ", "End. ", "\n", "\n\n"]) for _ in range(120_000))
    df = spark.createDataFrame([(0, None), (1, ""), (2, " \n\n "), (3, long), (4, "y" * 30_000), (5, "```\n" + "code\n" * 40_000), (6, "| a |\n|---|\n" + "| b |\n" * 40_000)], "i int, t string")
    got = {x["i"]: x["p"] for x in df.select("i", P.pieces(F.col("t")).alias("p")).collect()}
    assert got[0] is None and got[1] == [] and got[2] == []
    assert max(len(p["text"]) - p["repeated"] for p in got[3]) <= 500
    assert "".join(p["text"][p["repeated"] :] for p in got[3]).replace("\n", "") == long.replace("\n", "")
    assert [len(p["text"]) - p["repeated"] for p in got[4]] == [500] * 60
    assert len(got[5]) == len(got[6]) == 1 and got[5][0]["atomic"]


SECTION = "parent_id string, rel_path string, parent_idx int, text string, holder string"
CHILD = "chunk_id string, parent_id string, rel_path string, parent_idx int, child_idx int, h_path string, text string"


def _text(n, seed=0):
    r = random.Random(seed)
    return "".join(r.choice(["some ", "words ", "stand ", "here. "]) for _ in range(n // 5))


def test_oversized_sections(spark):
    code = "```\n" + "line();\n" * 900 + "```\n"
    data = [("a", "x", 0, _text(6000), "h"), ("a", "x", 0, _text(6000), "h"), ("b", "x", 1, "s" * 4000, "h"), ("c", "x", 2, code, "h"), ("d", "x", 3, "\n" + code + "\n", "h"), ("e", "x", 4, code + "tail\n", "h"), ("f", "x", 5, None, "h"), (None, "x", 6, _text(6000), "h"), ("g", "x", 7, "😀" * 4001, "h")]
    found = P.oversized_sections(spark.createDataFrame(data, SECTION))
    assert rows(found, "parent_id") == [("a",), ("e",), ("g",)]
    out = P.split_sections(found)
    assert rows(out.groupBy("parent_id").agg(F.min("child_idx"), F.max("child_idx") + 1 - F.count("*"))) == [("a", 0, 0), ("e", 0, 0), ("g", 0, 0)]
    assert out.where("NOT atomic AND length(text) > 600").count() == 0
    assert P.oversized_sections(spark.createDataFrame([], SECTION)).count() == 0


def test_audit(spark):
    text, code = _text(900, 1), "```\n" + "call(x);\n" * 30 + "```\n"
    one, cut = text[:450], text[:450].rfind(" ") + 1
    one = text[:cut]
    good, bad_repeat, mid = one[-80:].split(" ", 1)[1] + text[cut : cut + 300], text[cut : cut + 300], None
    half = text[: cut + 2]
    mid = half[-60:] + text[cut + 2 : cut + 300]
    section = text + "\n" + code
    child = [
        ("ok0", "p", 0, one), ("ok1", "p", 1, good), ("norepeat", "q", 1, bad_repeat), ("q0", "q", 0, one), ("m0", "m", 0, half), ("midword", "m", 1, mid),
        ("whole", "p", 2, code), ("part1", "r", 0, code[:100]), ("part2", "r", 1, code[100:]), ("inner", "r", 2, "call(x);\ncall(x);\n"), ("long", "s", 0, _text(700, 3)), ("blank", "s", 1, " \n"), ("null", "s", 2, None),
        ("longcode", "t", 0, "```\n" + "z();\n" * 300 + "```\n"), ("open", "u", 0, "```\nto the end\n"), ("short0", "v", 0, "Tiny."), ("short1", "v", 1, "Next one starts."), ("ok1", "p", 1, good), ("lost", "w", 0, code[:100]),
    ]
    children = spark.createDataFrame([(c, p, "f", 0, i, None, t) for c, p, i, t in child], CHILD)
    parents = spark.createDataFrame([(p, "f", 0, t, "h") for p, t in {"p": section, "q": section, "m": section, "r": section, "s": _text(700, 3), "t": "```\n" + "z();\n" * 300 + "```\n", "u": "x\n```\nto the end\n", "v": "Tiny.Next one starts."}.items()], SECTION)
    found = {r["chunk_id"]: tuple(k for k in ("too_long", "part", "no_repeat", "mid_word") if r[k]) for r in P.audit_pieces(children, parents).collect()}
    assert found == {"norepeat": ("no_repeat",), "midword": ("mid_word",), "part1": ("part",), "part2": ("part",), "inner": ("part",), "long": ("too_long",), "lost": ("part",)}
    assert P.audit_pieces(children.limit(0), parents).count() == 0
    assert rows(P.audit_pieces(children, parents, rows_per_salt=2), "chunk_id") == sorted((c,) for c in found)  # sections of more pieces are salted


def test_found_rows_come_through_the_splitter(spark, monkeypatch):
    data = [("a", "x", 0, _text(6000), "h"), ("b", "x", 1, " " * 5000, "h")]
    parents = spark.createDataFrame(data, SECTION)
    children = spark.createDataFrame([("long", "a", "x", 0, 0, None, _text(700, 3)), ("part", "a", "x", 0, 5, None, "```\n" + "z();\n" * 20)], CHILD)
    assert rows(P.oversized_sections(parents), "parent_id") == [("a",), ("b",)]
    assert rows(P.audit_pieces(children, parents), "chunk_id") == [("long",), ("part",)]
    monkeypatch.setattr(P, "pieces", lambda text, *a: F.array(F.struct(F.lit("```").alias("text"), F.lit(0).alias("repeated"), F.lit(True).alias("atomic"))))
    assert P.oversized_sections(parents).count() == 0
    assert "long" not in {r["chunk_id"] for r in P.audit_pieces(children, parents).collect()}
