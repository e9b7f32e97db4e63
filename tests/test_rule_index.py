"""Rules as rows against rules as columns, covers against matches, source trees with odd names and bytes."""

import json
import random
import re

import pytest

from vigilark.operators import rule_index, rules
from vigilark.plans import scan
from vigilark.sources import readers


@pytest.mark.parametrize(
    ("pattern", "want"),
    [
        ("abc|de", []), ("a(?:bcd)?e", []), ("(?:foo)+bar", ["foo"]), ("Foo\\bBar", ["foobar"]), ("[ab]cde", ["cde"]), ("(?=foo)bar", ["bar"]), ("(ab|cd)(efg|hijk)", ["efg", "hijk"]), ("", []), (".*", []),
        ("\\d{3}token", ["token"]), ("x(?:abcd|efgh)y|(?!no)ijkl", ["abcd", "efgh", "ijkl"]), ("a*bcd{0,2}efghi?", ["efgh"]), ("(?>abc)?(?>def)", ["def"]),
    ],
)
def test_covers(pattern, want):
    assert sorted(rule_index.cover(pattern)) == want


def test_every_match_holds_a_literal_of_the_cover():
    rnd = random.Random(4)
    for _ in range(3000):
        parts = [rnd.choice(["abc", "Bcd", "x", "[a-c]", "a?", "(?:abc|bcd)", "(?:cab){1,2}", "(?:ab|ca)*", ".", "\\b", "(?i:CAB)", "c+", "|"]) for _ in range(rnd.randint(1, 5))]
        try:
            pattern = re.compile("".join(parts), re.IGNORECASE)
        except re.error:
            continue
        held = rule_index.cover(pattern.pattern)
        text = "".join(rnd.choice("abcABCdx") for _ in range(30))
        for m in pattern.finditer(text):
            assert not held or any(x in rule_index.folded(m[0]) for x in held), (pattern.pattern, m[0])


def test_rows_match_as_columns_do(spark):
    texts = [
        "jwt.sign(\n a)\nx\njwt.sign(b); jwt.sign(\n\n c)\npassword =\r\n 'abcdefghijklmnopq'", "os.system('x')\nEVAL (y)", "ſelect a from t + b; Key", "", None, "PICKLE.LOADS(x)" * 50,
        "exec(a)\nSELECT x FROM t` + `\nsubprocess.run(", "x" * 50_000 + "eval(1)",
    ]
    files = spark.createDataFrame([(f"f{k}", t, 1) for k, t in enumerate(texts)], "file_path string, text string, rule int").repartition(3)
    own = [*rules.RULES, ("a.key", "LOW", "key"), ("a.select", "LOW", "select a"), ("a.short", "LOW", "x\\b"), ("a.broken", "LOW", "("), ("a.python", "LOW", "(?P<q>['\"])x(?P=q)"), ("a.java", "LOW", "(?a)x")]
    plain = [r for r in own if r[0] not in ("a.python", "a.java")]
    got = rule_index.file_matches(files, rules.rule_rows(spark, own)).collect()
    want = rules.file_matches(files, plain).collect()
    key = lambda r: (r.file_path, r.rule_id, r.nth, r.line_no, r.severity, r.text)
    assert sorted(key(r) for r in got if r.rule_id != "a.python") == sorted(map(key, want)) and {r.rule_id for r in got} >= {"a.python", "a.key", "a.select", "a.short"}
    assert rule_index.file_matches(files, rules.rule_rows(spark, own).limit(0)).count() == 0 == rule_index.file_matches(files.limit(0), rules.rule_rows(spark)).count()


def test_ten_thousand_rules_of_a_folder(spark, tmp_path):
    (tmp_path / "rules").mkdir()
    (tmp_path / "src").mkdir()
    for k in range(10_000):
        (tmp_path / f"rules/{k}.json").write_text(json.dumps({"id": f"many.{k:05d}", "name": "n", "pattern": f"call{k}x\\s*\\(", "severity": "low"}))
    (tmp_path / "src/a.js").write_text("call17x (1)\nCALL9999X(2); call17x(3)\ncall5(")
    (tmp_path / "src/b.py").write_text("os.system(a + b)")
    rows = scan.all_rules(spark, str(tmp_path / "rules")).cache()
    found = rule_index.file_matches(readers.source_files(spark, str(tmp_path / "src")), rows)
    assert sorted((r.rule_id, r.nth, r.line_no) for r in found.collect()) == [("many.00017", 1, 1), ("many.00017", 2, 2), ("many.09999", 1, 2), ("regex.command-injection", 1, 1)]
    few = rule_index.file_matches(readers.source_files(spark, str(tmp_path / "src")), rows.limit(30))
    size = lambda df: len(df._jdf.queryExecution().optimizedPlan().toString())
    assert size(found) < 1.2 * size(few) + 2000


def test_many_rules_take_several_passes(spark, monkeypatch):
    monkeypatch.setattr(rule_index, "RULES_AT_ONCE", 5)
    files = spark.createDataFrame([("a", "eval(x)\nyaml.load(y)\ncors()")], "file_path string, text string")
    assert sorted(r.rule_id for r in rule_index.rule_matches(files, rules.rule_rows(spark)).collect()) == ["node.eval_usage", "regex.insecure-cors", "regex.unsafe-yaml-load"]


@pytest.mark.parametrize("name", ["plain", "it's a \"dir\"", "with space & %20 #x", "brack[et]{a}*", "ünï"])
def test_source_trees_with_odd_names_and_bytes(spark, tmp_path, name):
    root = tmp_path / name
    (root / "sub dir'").mkdir(parents=True)
    (root / "a.js").write_bytes("x = 'é�'".encode())
    (root / "sub dir'/b%41 c.js").write_bytes(b"caf\xe9 = '\xff\xfe' \xc3")
    (root / "z.js").write_bytes(b"")  # has no row
    rows = lambda **k: sorted((r.file_path, r.text) for r in readers.source_files(spark, str(root), **k).collect())
    assert rows() == [("a.js", "x = 'é�'"), ("sub dir'/b%41 c.js", "caf� = '��' �")]
    assert rows(undecodable="ignore") == [("a.js", "x = 'é�'"), ("sub dir'/b%41 c.js", "caf = '' ")]


def test_scan_of_a_tree_that_is_not_utf8(spark, tmp_path):
    root = tmp_path / "it's"
    root.mkdir()
    (root / "a.js").write_bytes(b"// \xe9t\xe9\n\ndb.query('SELECT a FROM t WHERE b=' + req.query.id);\n")
    rows = scan.scan(spark, str(root)).collect()
    assert {(r.file, r.line, r.category) for r in rows} == {("a.js", 3, "SQL Injection")}


def test_lines_that_read_alike_are_tried_once(spark):
    # a quarter of a million lines of one text under 600 rules would be 150 million trials
    lines = spark.range(250_000).selectExpr("id AS ordinal", "CASE WHEN id % 1000 = 1 THEN 'call7(x) call7 (y)' WHEN id % 1000 > 1 THEN 'eval(call)' END AS text")
    made = spark.range(600).selectExpr("CAST(id AS INT) AS rule_no", "concat('r', id) AS rule_id", "'LOW' AS severity", "CASE WHEN id = 3 THEN '(' WHEN id = 4 THEN '(?<x' WHEN id = 5 THEN '[[]' WHEN id % 2 = 0 THEN concat('call', id, '|eval') ELSE concat('call', id, '\\\\s*[(]') END AS pattern")
    got = {r.rule_id: (r.lines, r.n) for r in rule_index.rule_counts(lines, made).collect()}
    want = {f"r{k}": (249_500, 249_500) for k in range(0, 600, 2) if k != 4} | {"r7": (250, 500)}
    assert got == want
