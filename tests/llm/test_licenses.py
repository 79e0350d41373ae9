import pytest

from quillon.llm import licenses

REFS = [("MIT", "MIT License", "permissive", "You are free to host the work. These terms travel with it."), ("ISC", "ISC License", "permissive", "No promise is made that this is fit for any purpose at all.")]


LONG = [f"The {a} of this work may be {b} by anyone who keeps this page." for a, b in (("text", "read"), ("sound", "heard"), ("shape", "cast"), ("colour", "mixed"))]
WORDINGS = licenses.Wordings([(i, t, w) for i, t, _, w in REFS] + [("Long-1", "Long License", " ".join(LONG)), ("Named-1", "Named License", "Thanks are due to <name of the author> for all of it. Nobody may sell <the work>.")])


@pytest.mark.parametrize(("name", "want"), [
    ("MIT", "MIT"), ("Expat (MIT) license", "MIT"), ("Apache licence v2", "Apache-2.0"), ("Apache License, Version 2.0", "Apache-2.0"), ("Apache 2 license", "Apache-2.0"),
    ("BSD-style license with three clauses", "BSD-3-Clause"), ("Simplified BSD License", "BSD-2-Clause"), ("GPLv3", "GPL-3.0"), ("GPL-2.0-or-later", "GPL-2.0"), ("GPL-3.0-only", "GPL-3.0"),
    ("GNU General Public License 3.0 or any later version", "GPL-3.0"), ("GNU AGPL version 3", "AGPL-3.0"), ("GNU Lesser General Public License, version 3", "LGPL-3.0"), ("SSPL v1", "SSPL-1.0"),
    ("MPL 2.0", "MPL-2.0"), ("the Unlicense", "Unlicense"), ("MIT OR Apache-2.0", "Apache-2.0 OR MIT"), ("Apache-2.0 or MIT at your option", "Apache-2.0 OR MIT"), ("see LICENSE", None), ("proprietary", None),
])
def test_names(name, want):
    assert licenses.license_id(name) == want


@pytest.mark.parametrize(("text", "want"), [
    ("# SPDX-License-Identifier: Apache-2.0\nimport x\n", {"Apache-2.0"}),
    ("/*\r\n * Use, copying and changes are governed by the\r\n * GPLv2; the full wording ships elsewhere.\r\n */\r\n", {"GPL-2.0"}),
    ("// Copyright 2031 A B. Offered to you on the terms of the MIT\n// license terms and nothing else.\n", {"MIT"}),
    ("# TODO: pick a license, Apache-2.0 or MIT?\n", set()), ("# Rewritten from scratch after the MIT-licensed thing.\n", set()), ("# See the LICENSE file for terms.\n", set()),
    ("# Copyright 2031 A. All rights reserved.\n", set()), ('x = "License: MIT"\n', set()), ('__license__ = "MIT"\n', {"MIT"}),
    ("# License: MIT\n#\n# SPDX-License-Identifier: ISC\n", {"MIT", "ISC"}), ("", set()),
])
def test_comments(text, want):
    assert licenses.comment_licenses(text, licenses.Wordings([])) == want


def test_wording_in_comment():
    body = "No promise is made that this is fit for any purpose at all. " + "x " * 100
    text = "// Copyright A\n// " + body + "\ncode();\n"
    assert licenses.comment_licenses(text, WORDINGS) == {"ISC"}


def test_clauses_in_comments():
    head = lambda *lines: "".join(f"// {x}\n" for x in lines) + "\ncode();\n"
    look = lambda t: licenses.comment_licenses(t, WORDINGS)
    assert look(head("Copyright 2031 A B", LONG[0], LONG[2])) == {"Long-1"}  # some clauses and nothing else
    assert look(head("Copyright 2031 A B", LONG[0], "Our pump is late.")) == set() == look(head(LONG[0]))
    assert look(head("Thanks are due to A. B. Cee and many others at the mill for all of it.", "Nobody may sell this pump.")) == {"Named-1"}


def test_no_size_matters():
    file = lambda t: licenses.text_licenses(t, WORDINGS)
    assert file("\n".join(["Some words on the project."] * 40 + ["MIT License"])) == {"MIT"}  # a title far down
    assert file(" ".join([LONG[0], LONG[1].replace("heard", "sung aloud"), *LONG[2:]])) == {"Long-1"}  # a clause reworded
    assert file(" ".join(LONG[:2])) == set()
    who = "Copyright 2031 " + ", ".join(f"Author Number {i}" for i in range(60))
    assert licenses.comment_licenses(f"# {who}.\n# Released under\n# the terms\n# of\n# the\n# MIT license\nx = 1\n", WORDINGS) == {"MIT"}
    assert licenses.comment_licenses(f"# {who}. Licensed under the terms of the MIT license\n", WORDINGS) == {"MIT"}
    assert licenses.readme_license("# A\n\n## License\n\nThis project is\nlicensed\nunder the terms of\nthe MIT license\n\n## Other\n\nISC\n") == {"MIT"}


def test_resolve(spark):
    files = spark.createDataFrame(
        [
            (1, "a", "LICENSE", REFS[0][3], "clash"), (2, "a", "package.json", '{"license": "MIT"}', ""), (3, "a", "src/x.py", "x = 1", ""), (4, "a", "src/y.py", "# License: ISC\n", ""),
            (5, "a", "vendor/lib/LICENSE", "ISC License\n\n" + REFS[1][3], ""), (6, "a", "vendor/lib/deep/z.js", "let a = 1;", ""), (7, "a", "vendor/lib/w.js", "// License: MIT\n", ""),
            (8, "b", "README.md", "# B\n\n## License\n\nMIT\n", ""), (9, "b", "Cargo.toml", '[package]\nlicense = "ISC"\n', ""), (10, "b", "m.rs", "fn a() {}", ""), (11, "b", "n.rs", "// License: ISC\n", ""),
            (12, "c", "q.go", None, ""), (13, "c", None, "", ""), (14, None, "r.go", "// License: MIT\n", ""), (3, "a", "src/x.py", "x = 1", ""), (15, "d", "a.py", "x" * 400_000, ""),
            (16, "e", "COPYING", "either of two licenses, at your choice:\n\n * Apache License, Version 2.0\n * MIT License\n", ""),
        ],
        "file_id bigint, repo_id string, file_path string, raw_content string, license string",
    )
    repos = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("e",), ("none",)], "repo_id string")
    refs = spark.createDataFrame(REFS, "license_id string, title string, family string, reference_text string")
    rows = licenses.resolve(files, repos, refs).collect()
    got = {(r.scope, r.item): r.license for r in rows}
    assert len(rows) == len(got) == 6 + 16
    assert [got["repo", x] for x in ("a", "b", "c", "d", "e", "none")] == ["MIT", "CONFLICT", "UNKNOWN", "UNKNOWN", "Apache-2.0 OR MIT", "UNKNOWN"]
    want = {1: "MIT", 2: "MIT", 3: "MIT", 4: "CONFLICT", 5: "ISC", 6: "ISC", 7: "CONFLICT", 8: "MIT", 9: "ISC", 10: "CONFLICT", 11: "ISC", 12: "UNKNOWN", 13: "UNKNOWN", 14: "MIT", 15: "UNKNOWN", 16: "Apache-2.0 OR MIT"}
    assert {int(k[1]): v for k, v in got.items() if k[0] == "file"} == want
    assert licenses.resolve(files.limit(0), repos.limit(0), refs).count() == 0
