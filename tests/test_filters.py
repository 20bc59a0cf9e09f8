import re

import pytest
from pyspark.sql import functions as F

from versalake import errors as E
from versalake.functions.expr import compile_expression, compile_value, validate
from versalake.functions.text import PLAIN, Analyser
from versalake.operators import positions as pos
from versalake.functions.patterns import java
from versalake.operators.filter import filter_rows, filter_vectorized


@pytest.fixture(scope="module")
def ramp(spark):
    return spark.range(100).select(F.col("id").alias("_pos"), F.col("id").alias("test")).cache()


@pytest.fixture(scope="module")
def mixed(spark):
    texts = ["A0", "A1", "A2", "A3", "A4", "B0", "B1", "C0"]
    rows = [(i, t, i, i not in (4, 5, 7), [i, i + 1], float(i)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "_pos long, test1 string, test2 long, test3 boolean, items array<int>, ratio double").cache()


def at(df):
    return [r[0] for r in df.orderBy("_pos").select("_pos").collect()]


def test_paging(ramp):
    conditions = [("test", ">", 50), ("test", ">=", 20)]
    assert at(filter_vectorized(ramp, conditions, ["AND"], 60, 10)) == list(range(60, 70))
    assert at(filter_vectorized(ramp, conditions, ["AND"], 0, 10)) == list(range(51, 61))
    assert at(filter_vectorized(ramp, [("test", ">", 50), ("test", "==", 20, True)], ["OR"], 0, 10)) == [20, *range(51, 60)]
    assert at(filter_vectorized(ramp, [("test", "BETWEEN", [13, 15], True)])) == [13, 14, 15]
    assert at(filter_vectorized(ramp, conditions, ["AND"], 0, 0)) == list(range(51, 100))


@pytest.mark.parametrize("pattern, want", [("A[0-2]", [0, 1, 2]), ("B", [5, 6]), ("[a-zA-Z]+0", [0, 5, 7]), (re.compile("a[01]", re.I), [0, 1]), (r"(?P<x>[AB])1", [1, 6]), (r"(?P<x>.)0(?P=x)?", [0, 5, 7])])
def test_patterns(mixed, pattern, want):
    assert at(filter_vectorized(mixed, [("test1", "LIKE", pattern)])) == want


def test_negation_and_fold(mixed):
    assert at(filter_vectorized(mixed, [("test1", "LIKE", "A[0-2]", False, "NOT")])) == [3, 4, 5, 6, 7]
    assert at(filter_vectorized(mixed, [("test2", ">", 5.1)])) == [6, 7]
    assert at(filter_vectorized(mixed, [("test3", "==", True)])) == [0, 1, 2, 3, 6]
    assert at(filter_vectorized(mixed, [("test1", "==", "A0"), ("test1", "==", "B0"), ("test2", "<", 3)], ["OR", "AND"])) == [0]
    assert java(re.compile("x", re.I | re.S)) == "(?udis)x" and java(re.compile(r"(a)?(?(1)b|c)")) is None


BAD = [
    [("test1", "LIKE", 5)],
    [("test1", ">", "A")],
    [("test1", "==", ["A0"])],
    [("test1", "CONTAINS", 5)],
    [("test1", "CONTAINS", "A", True, "NOT")],
    [("test2", "==", 5, True, "NOT")],
    [("test1", "BETWEEN", [1, 2])],
    [("test2", "BETWEEN", [1, 2], True, "NOT")],
    [("test2", "BETWEEN", 3)],
    [("test2", ">", 1, True)],
    [("test2", ">", 1, False, "NOT", 6)],
    [("test2", "~", 1)],
    [("test2", "==", "text")],
    [],
]


@pytest.mark.parametrize("conditions", BAD)
def test_illegal_conditions(mixed, conditions):
    with pytest.raises(E.InvalidCondition):
        filter_vectorized(mixed, conditions, ["AND"] * (len(conditions) - 1))


def test_illegal_connectors(mixed):
    two = [("test2", ">", 1), ("test2", "<", 5)]
    for connectors in ([], ["AND", "OR"], ["XOR"]):
        with pytest.raises(E.InvalidCondition):
            filter_vectorized(mixed, two, connectors)
    with pytest.raises(E.UnknownColumn):
        filter_vectorized(mixed, [("nothing", "==", 1)])


@pytest.mark.parametrize(
    "text, want",
    [
        ("test2 == 1", [1]),
        ("test2 == 1 or test2 == 7", [1, 7]),
        ("1 in items", [0, 1]),
        ("1 not in items", [2, 3, 4, 5, 6, 7]),
        ("items == 3", [2, 3]),
        ("items == [3, 4]", [3]),
        ("items[0] == 2 and items[-1] == 3", [2]),
        ("items.shape[0] == 2 and items.max >= 8", [7]),
        ("2 <= test2 < 4", [2, 3]),
        ("not test3", [4, 5, 7]),
        ("test1 in ('A0', 'C0')", [0, 7]),
        ("'A' in test1 and ratio / 2 == 1.5", [3]),
        ("-test2 % 3 == 1", [2, 5]),
        ("-test2 // 2 == -2", [3, 4]),
        ("test2 ** 2 == 49", [7]),
        ("test2 - 3", [0, 1, 2, 4, 5, 6, 7]),
        ("10 / test2 > 4", [1, 2]),
        ("test2 == None", []),
        ("test2 == 10", []),
        ("test1[0] == 'B'", [5, 6]),
    ],
)
def test_expressions(mixed, text, want):
    assert at(filter_rows(mixed, text)) == want


@pytest.mark.parametrize("text", ["f(1)", "__import__('os')", "lambda: 1", "[x for x in items]", "a.__class__", "_x == 1", "x if y else z", "x := 1", "items[0:1]", "", "1 +", "f'{x}'", "{1: 2}", "x is None", "x & 1", "test2; test2", "await x", "`ls`", "x @ y", "~x", "exec('1')", "().__class__.__bases__"])
def test_rejected_expressions(mixed, text):
    with pytest.raises(E.ExpressionError):
        compile_expression(text, mixed.schema)
    assert validate("a == 1 and b.c > 2") == ["a", "b"]


def test_python_semantics(spark):
    rows = spark.createDataFrame([(a, b) for a in (-7, 7, 0) for b in (-3, 3)], "a long, b long")
    for text in ("a % b", "a // b", "a / b", "a ** 2", "a + b * 2", "-a"):
        got = [r[0] for r in rows.select(compile_value(text, rows.schema).get()).collect()]
        assert got == pytest.approx([eval(text, {"a": r.a, "b": r.b}) for r in rows.collect()]), text
    with pytest.raises(E.UnknownColumn):
        compile_expression("c == 1", rows.schema)
    nulls = spark.createDataFrame([(1, None), (2, 5)], "_pos long, x long")
    assert at(filter_rows(nulls, "x > 1")) == [2] and at(filter_rows(nulls, "not x > 1")) == [1] and at(filter_rows(nulls, "x == None")) == [1]
    assert at(filter_vectorized(nulls, [("x", ">", 1, False, "NOT")])) == [1]
    assert at(filter_rows(nulls, "x / 0 > 1")) == []


def test_functions_as_filters(mixed):
    assert at(filter_rows(mixed, lambda df: df.test2 > 5)) == [6, 7]

    def row(r):
        return r["test2"] > 5

    row.takes_row, row.columns = True, ["test2"]
    assert at(filter_rows(mixed, row, offset=7)) == [7]
    assert at(filter_rows(mixed, lambda r: r["test1"].startswith("B"))) == [5, 6]


def test_cjk_and_english_search(spark):
    texts = ["床前明月光", "明月几时有 春风", "黄河 远上", "The quick fox", "故乡 quick"]
    rows = spark.createDataFrame(list(enumerate(texts)), "_pos long, value string")
    find = lambda q, a=None: at(filter_vectorized(rows, [("value", "CONTAINS", q)], analyser=a))
    assert find("明月") == [0, 1] and find("春风 明月") == [1] and find("您好") == []
    assert find("QUICK") == [3, 4] and find("fox||黄河||床前") == [0, 2, 3]
    assert find("the fox", Analyser(stop=("the",))) == [3] and find("the", Analyser(stop=("the",))) == []
    assert find("quick", Analyser(PLAIN)) == [3, 4] and find("Quick", Analyser(case_sensitive=True)) == []


def test_positions(spark):
    rows = spark.range(0, 1000, 1, 7).select((F.col("id") * 37 % 1000).alias("_ord"))
    numbered = pos.number(rows, "_ord", span=64)
    assert at(numbered) == list(range(1000))
    assert [r._pos for r in pos.take_list(numbered, [5, 3, 5], order="n").orderBy("n").collect()] == [5, 3, 5]
    assert at(pos.take_slice(numbered, 10, 30, 7)) == [10, 17, 24]
    assert at(pos.take_slice(numbered, 20, 4, -5)) == [5, 10, 15, 20]
    for a, b in ((slice(2, 50, 3), slice(1, 9, 2)), (slice(None, None, 2), slice(5, None, None)), (slice(5, 10), slice(0, 100))):
        s = pos.compose(a, b)
        assert list(range(100))[a][b] == list(range(100))[s]
    with pytest.raises(IndexError):
        pos.compose(slice(-1, None), slice(0, 1))


TEXTS = ["café", "٣ kg", "ÉCOLE 5", "école", "naïve_x", "日本 語", "a\nb", "a\r", "x{,}y", "a}b]c", "one two", "Straße", "½ cup", "नमस्ते", "A&&B", "tab\there", "\x1cfs", "line\u2028sep", "k\u212a", "\u017fs", "İi", "🙂 ok", "", "aaa", "foo.bar", "-^[]", "v\x0bt", "end\n"]
PATTERNS = [r"^\w+$", r"\d", r"\d+ kg", r"\bok\b", r"\B", r"^\S+$", r"\W", r"[\w-]+_", r"[^\w]", r"[^\W\d_]{5}", r"\s$", r"a.b", r"(?s)a.b", r"a$", r"b\Z", r"(?m)^b", r"end$", r"x{,}y", r"a{,2}b", r"a{2}", r"a{2,}", r"x\{", r"[]]", r"[^]a]", r"[&&]", r"[\[\]^-]", r"(?i)école", r"(?i)ECOLE", r"(?i)k$", r"(?i)ss?", r"(?i)i", r"(?i)[a-c]+&", r"(?P<q_1>a)(?P=q_1)", r"(a)\1", r"(?#note)two", r"(?<=one )two", r"(?<!one )two", r"(?>a+)b", r"a++", r"\x41", r"\u00e9", r"\U0001F642", r"[\U0001F600-\U0001F650]", r"\.", r"[.]", r"\v", r"\t", r"(?:caf|na)", r"(?a:\w+)é", r"\A\w", r"(a)?(?(1)b|c)", r"one|two", r"}", r"^$", r"#", r"(?x) o n e ", r"[\s\d]", r"(?i:É)COLE", r"\-", r"[a\]]"]


def test_patterns_are_pythons(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "_pos long, t string").cache()
    for pattern in PATTERNS:
        assert at(filter_vectorized(rows, [("t", "LIKE", pattern)])) == [i for i, t in enumerate(TEXTS) if re.search(pattern, t)], pattern
    assert sum(java(p) is not None for p in PATTERNS) >= 50  # most never leave Java
    for bad in ("(", "[a", "*"):
        with pytest.raises(E.InvalidCondition):
            filter_vectorized(rows, [("t", "LIKE", bad)])


def test_random_patterns(spark):
    import random

    rng = random.Random(4)
    letters = ["a", "é", "日", "٣", " ", "\n", "_", "½", "-", "]", "K", "ſ", "👍", "\u0301"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 8))) for _ in range(150)]
    rows = spark.createDataFrame(list(enumerate(texts)), "_pos long, t string").cache()
    atoms = [r"\w", r"\W", r"\d", r"\s", r"\b", ".", "^", "$", "a", "é", "日", r"[\w]", r"[^\s]", r"[\W_]", "_", r"[é-日]", "(?:a|_)"]
    for _ in range(60):
        pattern = "".join(x + (rng.choice(["", "", "*", "+", "?", "{1,2}"]) if x not in (r"\b", "^", "$") else "") for x in rng.choices(atoms, k=rng.randint(1, 4)))
        assert at(filter_vectorized(rows, [("t", "LIKE", pattern)])) == [i for i, t in enumerate(texts) if re.search(pattern, t)], pattern
