import math

import pytest
from pyspark.sql import functions as F

from reporank.functions import code as C
from reporank.functions import numbers as N
from reporank.functions import present as P
from reporank.functions import scores as S
from reporank.functions import text as T
from reporank.functions import vectors as V


def values(spark, rows, schema, column):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"_row int, {schema}")
    return [r.x for r in df.select("_row", column.alias("x")).orderBy("_row").collect()]


def test_recency(spark):
    got = values(spark, [(-3,), (0,), (1,), (365,), (400,), (None,)], "d int", S.recency("d"))
    assert got == [1.0, 1.0, 1 - 1 / 365, 0.0, 0.0, 0.0]


def test_contributor_norm(spark):
    got = values(spark, [(0,), (1,), (50,), (500,), (None,)], "c int", S.contributor_norm("c"))
    assert got == pytest.approx([0, math.log(2) / math.log(51), 1, 1, 0])


def test_quality(spark):
    rows = [(0.5, 0.0, 0.2), (0.5, 0.05, 0.2), (1.0, 0.1, 1.0), (1.0, 0.5, 1.0), (None, None, None)]
    got = values(spark, rows, "t double, e double, a double", S.quality("t", "e", "a"))
    assert got == [0.25, 0.425, 1.0, 1.0, 0.0]


def test_health_and_composite(spark):
    got = values(spark, [(0, 50, 1.0), (None, None, None)], "d int, c int, i double",
                 S.health("d", "c", "i"))
    assert got == [1.0, 0.0]
    got = values(spark, [(0.9, 0.5, 0.25), (None, 1.0, 1.0)], "r double, q double, h double",
                 S.composite("r", "q", "h"))
    assert got == [0.65, 0.5]


def test_rounding_is_that_of_the_exact_value(spark):
    xs = [0.00015, 0.03125, 0.09375, 0.43125, 5e-5, -5e-5, -0.00001, 0.0, 2.5, 0.99995, 1 / 3]
    got = values(spark, [(x,) for x in xs], "x double", N.round_even(F.col("x"), 4))
    assert got == [round(x, 4) + 0.0 for x in xs]
    got = values(spark, [(0.03125,), (0.09375,), (0.00015,)], "x double", N.round_up(F.col("x"), 4))
    assert got == [0.0313, 0.0938, 0.0001]


def test_fixed_text(spark):
    rows = [(12.25,), (12.35,), (0.5,), (2.5,), (0.04,), (0.05,), (1234.0,)]
    assert values(spark, rows, "x double", N.fixed_text(F.col("x"), 1)) == [
        "12.3", "12.3", "0.5", "2.5", "0.0", "0.1", "1234.0"]
    assert values(spark, rows, "x double", N.fixed_text(F.col("x"), 0)) == [
        "12", "12", "1", "3", "0", "0", "1234"]


def test_lite_scores(spark):
    rows = [("Unit TEST kit", 5000, 1000), (None, 2500, 500), ("x", None, 5000)]
    got = values(spark, rows, "d string, s long, f long", S.lite_quality("d", "s", "f"))
    assert got == [1.0, 0.35, 0.3]
    as_of = F.lit("2024-01-11").cast("timestamp")
    rows = [("2024-01-11 00:00:00", 1), ("2020-01-01 00:00:00", 0), ("2024-01-10 12:00:00", 0)]
    got = values(spark, rows, "u string, o long",
                 S.lite_health(F.col("u").cast("timestamp"), "o", as_of))
    assert got == [0.8, 0.12, round(0.6 * (1 - 0.5 / 365) + 0.12, 4)]


def test_whole_days_cut_towards_zero(spark):
    as_of = F.lit("2024-01-11 06:00:00").cast("timestamp")
    rows = [("2024-01-10 07:00:00",), ("2024-01-10 05:00:00",), ("2024-01-11 18:00:00",)]
    assert values(spark, rows, "t string", S.whole_days(F.col("t").cast("timestamp"), as_of)) == [
        0, 1, 0]


def test_embedding_text(spark):
    twelve = [f"f{i}" for i in range(12)]
    rows = [(None, None), (None, ["a", "b", "c"]), ("d", twelve)]
    column = T.embedding_text("d", "s")
    assert values(spark, rows, "d string, s array<string>", column) == [
        "", " a b c", "d " + " ".join(twelve[:10])]
    everything = T.embedding_text("d", "s", None)
    assert values(spark, rows, "d string, s array<string>", everything)[2].endswith("f11")


def test_keywords(spark):
    rows = [
        ("I need a Python library for parsing log-files, fast!",),
        ("rate limiting rate limiting middleware express redis node",),
        ("a b cd",),
        ("vector search　engine",),
    ]
    assert values(spark, rows, "t string", T.search_query("t")) == [
        "python+parsing+logfiles+fast",
        "rate+limiting+rate+limiting+middleware",
        "",
        "vector+search+engine",
    ]


def test_blank_and_encoded(spark):
    rows = [(None,), ("",), (" \t ",), ("x",)]
    assert values(spark, rows, "t string", T.is_blank("t")) == [True, True, True, False]
    assert values(spark, [("a b*c~d/é",)], "t string", T.encoded_query("t")) == [
        "a+b%2Ac~d%2F%C3%A9"]


def test_paths(spark):
    rows = [("a/b/C.PY",), ("Makefile",), ("/a",), ("x.d/readme",), (".bashrc",)]
    assert values(spark, rows, "p string", T.extension("p")) == [".py", "", "", "", ".bashrc"]
    assert values(spark, rows, "p string", T.parent_dir("p")) == ["a/b", "/", "", "x.d", "/"]
    assert values(spark, rows, "p string", T.basename("p"))[0] == "C.PY"
    assert values(spark, [("o/r",)], "p string", T.sanitize("p")) == ["o_r"]


SIGNATURES = [
    ("def load(x):", ".py", "load", True),
    ("def _load (self):", ".py", "_load", False),
    ("async def load(x):", ".py", "", False),
    ("func Load(a int) error {", ".go", "Load", True),
    ("func load()", ".go", "load", False),
    ("func (r *T) Load()", ".go", "", False),
    ("export function go(", ".ts", "go", True),
    ("const go = async (x) => 1", ".js", "go", True),
    ("const go = x => 1", ".js", "", False),
    ("const a = (function named() {})", ".js", "a", True),
    ("public int size(", ".java", "size", True),
    ("protected void stop ()", ".java", "stop", True),
    ("public static void main(String[] a)", ".java", "", False),
    ("private int x(", ".java", "", False),
    ("def load(x):", ".md", "", False),
]


def test_signatures(spark):
    rows = [r[:2] for r in SIGNATURES]
    got = values(spark, rows, "l string, e string", C.signature("l", "e"))
    assert got == [r[2] for r in SIGNATURES]
    public = C.is_public(C.signature("l", "e"), "e")
    assert values(spark, rows, "l string, e string", public) == [r[3] for r in SIGNATURES]


def test_error_lines(spark):
    rows = [("if err != nil {", ".go"), ("except ValueError:", ".py"), ("except:", ".py"),
            ("} catch (e) {", ".ts"), ("} catch (E e) {", ".java")]
    assert values(spark, rows, "l string, e string", C.handles_error("l", "e")) == [
        True, True, False, True, False]


def test_test_files(spark):
    rows = [("a/test_x.py",), ("a/x.spec.ts",), ("test/x.py",), ("a/Contest.java",), ("a/x.js",)]
    assert values(spark, rows, "p string", C.is_test_file("p")) == [True, True, False, True, False]


def test_cosine(spark):
    rows = [([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0, 2.0], [-1.0, -2.0])]
    got = values(spark, rows, "a array<double>, b array<double>", V.cosine("a", "b"))
    assert got == pytest.approx([math.sqrt(0.5), 0.0, -1.0])
    rows += [(None, [1.0, 1.0])]
    slow = values(spark, rows, "a array<double>, b array<double>", V.cosine("a", "b"))
    fast = values(spark, rows, "a array<double>, b array<double>", V.cosine_rows("a", "b"))
    assert fast[3] is slow[3] is None and fast[:3] == pytest.approx(slow[:3])
    got = values(spark, [([3.0, 4.0],), (None,), ([0.0, 0.0],)], "a array<double>",
                 V.cosine_to([3.0, 4.0], "a"))
    assert got == [1.0, None, 0.0]
    with pytest.raises(Exception, match="dimension"):
        values(spark, [([1.0], [1.0, 2.0])], "a array<double>, b array<double>",
               V.cosine("a", "b"))
    with pytest.raises(Exception, match="dimension"):
        values(spark, [([1.0],)], "a array<double>", V.cosine_to([1.0, 2.0], "a"))


def test_given_encoder(spark):
    def make():
        import numpy as np

        return lambda texts: np.array([[len(t), 1.0] for t in texts])

    got = values(spark, [("abc",), (None,)], "t string", V.embed("t", make, batch=1))
    assert got[0] == pytest.approx([3 / math.sqrt(10), 1 / math.sqrt(10)])
    assert got[1] == [0.0, 1.0]


def test_hashed_embedding_has_unit_length(spark):
    got = values(spark, [("Some words",), ("words some",), ("",)], "t string", V.embed("t"))
    assert len(got[0]) == 384 and sum(x * x for x in got[0]) == pytest.approx(1)
    assert got[0] == got[1] and not any(got[2])


def test_presentation(spark):
    rows = [("a" * 159 + " bc",), ("short",), ("",), (None,)]
    shown = P.or_else(P.shortened("t"), "none")
    assert values(spark, rows, "t string", shown) == ["a" * 159 + "…", "short", "none", "none"]
    rows = [(0.7,), (0.4,), (0.399,), (0.125,)]
    assert values(spark, rows, "s double", P.score_class("s")) == ["high", "mid", "low", "low"]
    assert values(spark, rows, "s double", P.percent("s")) == ["70%", "40%", "40%", "13%"]
    assert values(spark, [(1234567,)], "n long", P.grouped_number("n")) == ["1,234,567"]
    rows = [("Go",), ("Zig",), (None,)]
    assert values(spark, rows, "l string", P.language_color("l")) == [
        "#00ADD8", "#6b7280", "#6b7280"]
    assert values(spark, [(0.1234,), (None,)], "r double", P.ratio_label("r", 1)) == [
        "12.3%", None]


def test_texts_and_stored_vectors_are_taken_in_pieces(monkeypatch):
    import numpy as np
    import pyarrow as pa
    from reporank.functions import minhash as M
    from reporank.operators import nearest as N

    monkeypatch.setattr(M, "TEXT_BYTES", 5)
    texts = pa.array(["a b", None, "", "c d e f g", "a"])
    assert list(M._pieces(texts)) == [(0, 3), (3, 4), (4, 5)]
    monkeypatch.setattr(N, "STORED_BLOCK", 2)
    ids = np.array(["d", "c", "b", "a", "e"], object)
    stored = np.array([[0, 1.0], [1.0, 0], [1.0, 0], [0, 1.0], [1.0, 0]])
    found = list(N._hits(np.array(["x", "y"], object), np.array([[1.0, 0], [0, 1.0]]), ids, stored, 0.9))
    assert [r["job_id"] for b in found for r in b.to_pylist()] == ["b", "a"]
