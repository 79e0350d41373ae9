import pytest

from quillon.llm import grammars, syntax

GOOD = {
    "python": "import a\n\ndef f(x):\n    return x + 1\n",
    "javascript": "const a = require('b');\n// c\nfunction f(x, y = 2) {\n  if (x > 1) { return { a: 1, b: [1, 2] }; } else if (y) { x++; }\n  for (const i of y) { a.b(i, () => i + 1); }\n  try { f(); } catch (e) { throw new Error(`x ${e}`); }\n  return x ? 1 : 2\n}\n(function () { var q = function (p) { return p ? p.a : null }; })();\n",
    "typescript": "import { a } from './b';\nexport interface P { x: number; y?: string; }\nexport function f(x: number, y: string[] = []): unknown {\n  const z: string = 'a';\n  return x;\n}\nexport class A extends B { private x: number = 1; m(q: string): void { this.x = 2; } }\n",
    "java": "package a.b;\n\nimport a.c.D;\n\npublic class E extends F {\n    private static final String G = \"x\";\n    public Object h(Object i, List<String> j) throws K {\n        for (var l : j) { log.fine(\"m\"); }\n        for (int i = 0; i < 3; i++) { x += 1; }\n        return i.n;\n    }\n}\n",
    "go": "package a\n\nimport (\n\t\"b\"\n)\n\ntype T struct {\n\tA int\n}\n\nfunc f(x int, y string) (int, error) {\n\tfor _, i := range y {\n\t\tif i > 3 {\n\t\t\tg(i)\n\t\t} else {\n\t\t\treturn 1, nil\n\t\t}\n\t}\n\treturn x + 1, nil\n}\n",
    "cpp": "#include \"a.h\"\n\nnamespace n {\nint f(int a, const char* b) {\n    auto c = g(a, 4);\n    for (auto d : b) { h(d); }\n    if (a == 1) { return c.e; }\n    return 2;\n}\n}\n",
    "rust": "use crate::a;\n\npub fn f(x: i64, y: &str) -> i64 {\n    let z = x + 1;\n    for i in y { log::debug!(\"q {}\", i); }\n    if z > 3 { return 1; } else { g(z); }\n    z\n}\n",
    "ruby": "require_relative \"a\"\n\nmodule B\n  def c(d, e)\n    if d > 3\n      logger.info(\"x\")\n    else\n      e = d + 1\n    end\n    d.each do |i|\n      f(i)\n    end\n    return d.g\n  end\nend\n",
    "php": "<?php\nrequire_once \"a.php\";\n\nfunction f($a, $b = 1) {\n    foreach ($a as $c) { g($c); }\n    if ($b == 2) { $d = $a->e; }\n    return [\"k\" => $b];\n}\nRoute::get(\"/x\", \"y\");\n",
}


@pytest.mark.parametrize("language", list(GOOD))
def test_good_and_cut(language):
    text = GOOD[language]
    assert grammars.parses(text, language)
    assert grammars.parses(text.replace("\n", "\r\n"), language)
    assert grammars.parses("", language) or language == "php"
    cut = text[: text.rindex("(")] + "("
    assert not grammars.parses(cut, language)
    assert not grammars.parses("<<<<<<< ours\n" + text + "=======\n>>>>>>> theirs\n", language)
    assert not grammars.parses(text + "\n]\n", language)
    assert not grammars.parses("<!DOCTYPE html>\n<html><p>one, two three.</p></html>\n", language)


@pytest.mark.parametrize(("language", "bad"), [
    ("javascript", "const a = ;\n"), ("javascript", "f(1, 2;\n"), ("javascript", 'const a = "x;\n'), ("java", "public class A { void f() { int x = 1 } }\n"), ("rust", "fn f() { let x = ; }\n"), ("go", "package a\nfunc f() {\n\tx := \n}\n"),
    ("php", "<?php\n$a = 1 $b;\n"), ("ruby", "def f\n  if a\nend\n"), ("cpp", "int f( { return 1; }\n"), ("python", "print 'x'\n"), ("typescript", "export function f(x: ): void {}\n"),
])
def test_bad(language, bad):
    assert not grammars.parses(bad, language)


def test_markers_inside_strings_are_text():
    assert grammars.parses("const s = `\n<<<<<<< ours\na\n=======\n`;\n", "javascript")
    assert grammars.parses("package a\n/*\n<<<<<<< ours\n*/\n", "go")


def test_judge():
    assert syntax.judge(GOOD["go"], "python") == (True, "go", "wrong_extension")
    assert syntax.judge("Not at all, a text; of prose.", "java") == (True, None, "corrupt")
    assert syntax.judge(None, "java")[0] is False and syntax.judge("", "php")[0] is False


def test_tables(spark):
    rows = [
        (1, "r", "a.py", "x = 1\n", "PYTHON"), (2, "r", "b.py", "def f(:\n", None), (3, "r", "c.txt", "def f(:\n", "unknown"), (4, "r", "d.go", None, "go"), (5, None, None, "x", None),
        (6, "s", "e.js", "function f( {\n", "javascript"), (6, "s", "e.js", "function f( {\n", "javascript"), (7, "s", "l.py", "x = 1\n" * 50_000, "python"),
    ]
    df = spark.createDataFrame(rows, "file_id bigint, repo_id string, file_path string, raw_content string, detected_language string").withColumnRenamed("x", "language")
    assert sorted(r.file_id for r in syntax.found(df).collect()) == [2, 6]
    got = {(r.repo_id, r.language): (r.n_files, r.n_broken) for r in syntax.rates(syntax.check(df)).collect()}
    assert got["r", "python"] == (2, 1) and got["s", "javascript"] == (2, 2) and got["r", "unknown"] == (1, 0)
    assert syntax.found(df.limit(0)).count() == 0


def test_long_chains_parse():
    n = 700
    js = "if (a) { f(); }" + " else if (b) { g(); }" * n + "\n"
    assert grammars.parses(js, "javascript") and not grammars.parses(js + "}", "javascript")
    assert grammars.parses("x = a" + ".b(1)" * n + ";\n", "javascript")


@pytest.mark.parametrize("text", ["x = " + " + ".join(["a"] * 30_000) + "\n", "if a:\n    b()\n" + "elif c:\n    d()\n" * 3_000, "x = a" + ".b(1)" * 9_000 + "\n", "x = " + "not " * 9_000 + "a\n"])
def test_long_python_parses(text):
    assert grammars.parses(text, "python") and not grammars.parses(text + ")\n", "python")
