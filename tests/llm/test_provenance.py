import random

from quillon.llm import provenance as P


def _hand(r, n=30):
    out = ["import logging", ""]
    for i in range(n):
        a, b, c = (r.choice(["river", "stone", "cloud", "meadow", "harvest", "lantern"]) + r.choice(["", "_x", "_name"]) for _ in range(3))
        out += [f"def {a}_{i}({b}, {c}):", f"    # Keeps the {a} near the {b} when {c} is late.", f"    if {b} > {r.randint(1, 99)}:", f"        return {c} + {r.randint(1, 9)}", f"    return {b}.{a}", ""]
    return "\n".join(out)


def _stub(r, n=30):
    w = r.choice(["ferry", "urn", "winch"])
    return "\n".join(f"def get_{w}_field_{i}(msg):\n    return msg.fields[{i}]\n" for i in range(n))


def _table(r, n=120):
    return "TABLE = {\n" + "".join(f'    "{r.getrandbits(40):010x}": {r.randint(1, 10**6)},\n' for _ in range(n)) + "}\n"


def test_marks():
    mark = lambda t: P.noticed(P.parts(t)[0])
    assert mark("# @generated by x\ny = 1")
    assert mark("/*\n * Fichier généré automatiquement, ne pas modifier\n */\nint x;")
    assert mark("// libx 3.1 - upstream copy, see y\nint x;")
    assert not mark("# writes the auto-generated stubs; this module itself is maintained by hand\n")
    assert not mark('x = "generated by stubmill, do not edit"\n')
    assert mark("x = 1\n\n# Code produced by tool 7; hand edits will be lost\n")  # at the end of the file
    assert not mark("x = 1\n# generated by tool\ny = 2\n")  # in the middle of code


def test_altered_is_fixed_and_unlike_its_body():
    body = _hand(random.Random(4))
    kinds = {P.altered(body, k)[:12] for k in range(60)}
    assert len(kinds) > 20 and all(P.altered(body, k) == P.altered(body, k) != body for k in range(60))
    assert len(P.figures("")) == len(P.figures("é")) == len(P.FEATURES)


def test_tiny_bodies_are_judged(spark):
    rows = [(1, "a", "x.js", "x=1", 0.1), (2, "b", "y.js", "", 0.1), (3, None, None, "# generated by tool\n", None)]
    df = spark.createDataFrame(rows, "file_id bigint, repo_id string, file_path string, raw_content string, file_size_kb double")
    got = {x.file_id: x.is_case for x in P.classify(df).collect()}
    assert got == {1: False, 2: False, 3: True}


def test_found(spark):
    r = random.Random(1)
    rows, want, fid = [], set(), 0

    def put(path, text, case, repo="r"):
        nonlocal fid
        fid += 1
        rows.append((fid, repo, path, text, 0.5, "clash"))
        if case:
            want.add(fid)

    # the operator assumes that most files without a notice are written by hand, so here most are
    for i in range(1200):
        put(f"src/b{i}.py", _hand(r, r.randint(3, 40)), False, f"r{i % 7}")
    for i in range(60):
        put(f"src/a{i}.py", _hand(r), False, f"r{i % 7}")
        put(f"lib/g{i}.py", ("# @generated by stubmill\n\n" if i % 5 else "") + _stub(r, 20 + i % 9), True, f"r{i % 7}")
        put(f"data/t{i}.py", _table(r, 90 + i), True, f"r{i % 5}")
        put(f"js/m{i}.js", "!function(){" + "".join(f'var a{k}={{q:"{r.getrandbits(30):x}",z:{k}}};' for k in range(80)) + "}();", True)
    lib = _hand(r, 25)
    for i in range(6):
        put(f"vendor/libx/x{i}.py", ("# libx 1.2 - upstream copy\n" if i % 2 else "") + lib, True, f"q{i}")
    put("src/vendor/own.py", _hand(r), False)
    put(None, None, False)
    put("LICENSE", "text " * 200, False)
    put("long.py", _hand(r, 3000), False)
    rows.append(rows[0])
    df = spark.createDataFrame(rows, "file_id bigint, repo_id string, file_path string, raw_content string, file_size_kb double, labelled string")
    got = [x.file_id for x in P.found(df).collect()]
    assert len(got) == len(set(got))
    hit = len(want & set(got))
    assert hit >= 0.97 * len(want) and hit >= 0.98 * len(got)
    assert P.found(df.limit(0)).count() == 0
