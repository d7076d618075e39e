"""Phrases against brute force; JSON trees of any depth, schemas, findings and the guard."""

import json
import random
import re

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tessella.functions import phrases, trees

WORD = re.compile(r"[^\W_]+")


def brute(text, terms):
    words = [(m[0].lower(), m.start(), m.end()) for m in WORD.finditer(text)]
    known = {tuple(w.lower() for w in WORD.findall(p)): t for p, t in terms.items()}
    longest, i, out = max(map(len, known)), 0, []
    while i < len(words):
        for n in range(min(longest, len(words) - i), 0, -1):
            hit = known.get(tuple(w for w, _, _ in words[i : i + n]))
            if hit:
                out += [(t, words[i][1], words[i + n - 1][2]) for t in hit]
                i += n
                break
        else:
            i += 1
    return out


def test_ten_thousand_phrases(spark):
    rng = random.Random(3)
    vocabulary = ["ä" * k + c for k in range(3) for c in "abcdefghij"] + ["İx", "straße", "C3PO"]
    terms = {}
    while len(terms) < 10_000:
        p = " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 6)))
        terms[p] = tuple({f"t{rng.randrange(500)}" for _ in range(rng.randrange(1, 4))})
    terms = {k: v for k, v in {" ".join(WORD.findall(p)).lower(): t for p, t in terms.items()}.items()}
    texts = ["".join(rng.choice(vocabulary).upper() + rng.choice([" ", ", ", "\n", "-", "_", " 日 "]) for _ in range(rng.randrange(80))) for _ in range(60)] + [None, "", "…"]
    d = spark.createDataFrame(list(enumerate(texts)), "id int, t string").withColumns({"term": F.lit(1), "start": F.lit(2)})
    got = sorted((r["id"], r["term"], r["start"], r["end"]) for r in phrases.find(d, "id", "t", phrases.Lexicon(terms)).collect())
    assert got == sorted((i, t, a, b) for i, text in enumerate(texts) for t, a, b in brute(text or "", terms)) and len(got) > 1000


def test_gates_sections_and_routing(spark):
    lexicon = phrases.Lexicon(
        {"go": ("golang",), "react": ("react", "frontend"), "spring boot": ("java",), "rust": ("rust",)},
        gates={"golang": "code"}, triggers={"code": ("engineer", "go")}, markers={"must have": "required", "nice to have": "preferred"},
    )
    texts = ["Go now", "Go, engineer: go", "must have: Rust, react. Nice to have: rust; SPRING-boot", "rust"]
    d = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    found = phrases.find(d, "id", "t", lexicon)
    assert [tuple(r) for r in found.where("id < 2").orderBy("id", "start").collect()] == [(1, "golang", "go", 0, 2, "other"), (1, "golang", "go", 14, 16, "other")]
    got = {r["id"]: (r["terms"], r["required"], r["preferred"]) for r in phrases.routed(found, "id", ["required", "preferred"]).collect()}
    assert got[2] == (["frontend", "java", "react", "rust"], ["frontend", "react", "rust"], ["java"]) and got[3] == (["rust"], [], [])


def test_flags_capture_numbers(spark):
    d = spark.createDataFrame([("8+ years, on call",), ("none",), (None,)], "t string")
    cases = [("years", r"(\d+)\+? years", 1), ("call", "on call", None)]
    assert [[tuple(f) for f in r[0]] for r in d.select(phrases.flags(F.coalesce("t", F.lit("")), cases)).collect()] == [[("years", 8), ("call", None)], [], []]


def nested(n):
    return "[" * n + "7" + "]" * n


def test_walk_has_no_depth(spark):
    records = ['{"a": [1, {"b": null, "b": 1.50}], "c": true}', nested(200_000), "{bad", None, "3", '{"a": NaN}', "[]", '{"x": {}, "y": "é\\n"}', '{"a" 1}', "[1,]", "[1 2]", '{"k": ' * 50_000 + "1" + "}" * 50_000, '{"k": ' * 50_000]
    d = spark.createDataFrame(list(enumerate(records)), "id int, r string").withColumn("path", F.lit("p"))
    got = {}
    for r in trees.walk(d, "id", "r").collect():
        got.setdefault(r["id"], []).append((r["path"], r["value"]))
    deep, keys = got.pop(1), got.pop(11)
    assert deep == [("$" + "[0]" * 200_000, "7")] and keys == [("$" + ".k" * 50_000, "1")]
    assert got == {0: [("$.a[0]", "1"), ("$.a[1].b", None), ("$.a[1].b", "1.50"), ("$.c", "true")], 4: [("$", "3")], 7: [("$.y", "é\n")]}


@pytest.mark.parametrize("seed", range(3))
def test_the_own_stack_reads_what_the_decoder_reads(seed):
    rng = random.Random(seed)

    def value(depth):
        kind = rng.randrange(7 if depth else 5)
        if kind < 5:
            return [None, True, rng.random() * 10 ** rng.randrange(-9, 9), rng.randrange(-99, 99), "".join(rng.choice('a"\\é\n{}[],:') for _ in range(4))][kind]
        inner = [value(depth - 1) for _ in range(rng.randrange(4))]
        return inner if kind == 5 else {f"k{i}": v for i, v in enumerate(inner)}

    for _ in range(300):
        text = json.dumps(value(4), indent=rng.choice([None, 1]))
        assert trees._deep(text) == trees._DECODER.decode(text)
        broken = text[: rng.randrange(len(text) + 1)] + rng.choice(["", ",", "}", "]", ":", '"', "1"]) + text[rng.randrange(len(text) + 1) :]
        try:
            expected = trees._DECODER.decode(broken)
        except ValueError:
            with pytest.raises((ValueError, IndexError)):
                trees._deep(broken)
        else:
            assert trees._deep(broken) == expected


def test_schema_errors(spark):
    schema = {"type": "object", "required": ["a"], "properties": {"a": {"type": "array", "items": {"type": "object", "required": ["n"], "properties": {"n": {"type": "integer"}}}}, "e": {"enum": [1, "x", {"k": [2]}]}}, "additionalProperties": {"type": "string", "maxLength": 2}}
    records = ['{"a": [{"n": 1.0}, {"n": 1.5}, {}, 4]}', '{"e": {"k": [2.0]}, "z": "abc", "y": "ab", "w": 1}', "[]", "x", None, '{"a": [], "e": true}']
    d = spark.createDataFrame(list(enumerate(records)), "id int, r string")
    got = sorted(tuple(r) for r in trees.schema_errors(d, "id", "r", schema).collect())
    assert got == [
        (0, "$.a[1].n", "number instead of integer"), (0, "$.a[2].n", "missing"), (0, "$.a[3]", "integer instead of object"), (1, "$.a", "missing"), (1, "$.w", "integer instead of string"),
        (1, "$.z", "length out of bounds"), (2, "$", "array instead of object"), (3, "$", "no JSON"), (4, "$", "no JSON"), (5, "$.e", "not among the values allowed"),
    ]
    with pytest.raises(ValueError, match="anyOf"):
        trees.schema_errors(d, "id", "r", {"properties": {"a": {"anyOf": []}}})


def test_findings_and_guard(spark, tmp_path):
    patterns = {"key": "AKIA[A-Z0-9]{4,}", "mail": r"\S+@\S+"}
    texts = ["é AKIA1234 and AKIAXXXX, a@b", "fine", None, "password"]
    d = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    assert sorted(tuple(r) for r in trees.text_findings(d, "id", "t", patterns, {"pair": ("password", "=")}).collect()) == [(0, "key", 2, 10), (0, "key", 15, 23), (0, "mail", 25, 28)]
    records = d.select("id", F.to_json(F.struct(F.array(F.struct("t")).alias("x"))).alias("r"))
    assert {(r["path"], r["kind"]) for r in trees.record_findings(records, "id", "r", patterns).collect()} == {("$.x[0].t", "key"), ("$.x[0].t", "mail")}
    with pytest.raises(PySparkException, match="secret in t: key at 3") as said:
        trees.guarded(d, ["t"], patterns).write.parquet(f"{tmp_path}/out")
    assert "AKIA1234" not in str(said.value) and not list(tmp_path.glob("out/part-*")) and not (tmp_path / "out" / "_SUCCESS").exists()
    good = trees.guarded(d.where("id > 0"), ["t"], patterns)
    good.write.parquet(f"{tmp_path}/good")
    assert spark.read.parquet(f"{tmp_path}/good").count() == 3
