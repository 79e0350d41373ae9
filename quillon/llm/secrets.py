"""Credentials embedded in source code (problem 6).

Method: every line is cut into lexical tokens; a linear-chain conditional random field with shape and context
features labels them O, B (a credential's value starts) or I (it goes on), and the Viterbi spans decide which literal characters are
masked. The field is trained here on lines written by a generator (:func:`training_lines`), of a fixed number. An exact check then drops
placeholders and references. No line is left out before the field. A key block or certificate is one token of the field, from its BEGIN to its END. Lines of any length are decoded whole.

Defined results: null and empty texts have none; lines end at ``\\n`` alone and count from 1; a key block counts at its first line; a value divided over
several literals counts where it starts. Masking keeps the length, quotes and separators of every literal (a key block keeps its BEGIN and END
lines), so the code around still parses. Texts are searched whole. Each row stands by itself, so repeated rows repeat their result;
:func:`find` gives distinct (id, line) rows; extra columns are ignored.

Scale: no shuffle but the distinct of the small result. Lines are scored many at once (:class:`Field`). The model is a few hundred KB
of non-zero weights, fixed in size, sent with the closure.
"""

import base64
import hashlib
import itertools
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.crf import Chain, slot

K = 16
N_TRAIN, N_PLAIN, SEED = 7_000, 3_000, 11
O, B, I = 0, 1, 2  # noqa: E741

#: A key block or certificate from BEGIN to END, and a private key whose END is missing, up to its last line of text; either is one token.
_BLOCK = re.compile(
    r"-----BEGIN [A-Z0-9 ]+-----(?:(?!-----BEGIN )[\s\S])*?-----END [A-Z0-9 ]+-----|-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----(?:(?:\\n|[\s\"'+\\.])*[A-Za-z0-9+/=]{16,})+"
)
_PRIVATE = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----")
_FILLED = re.compile(r"-----BEGIN [A-Z0-9 ]+-----(?:\\n|[\s\"'+\\.])*[A-Za-z0-9+/=]{16}")
#: Marks and short words stand first only because they are most of the tokens; no later alternative could begin there.
_TOKEN = re.compile(
    r"[()\[\];,=:\"'`}>|]|\w{1,15}+(?![\w.+!$%^&*~/-]|://)|"
    + _BLOCK.pattern
    + r"|-----(?:BEGIN|END) [A-Z0-9 ]+-----|[A-Za-z][A-Za-z0-9+.-]*+://|\$\{[^}\s]*\}|\$\([^)\s]*\)|\{\{[^}]*\}\}|<[^<>\s][^<>]{0,40}>|%\([^)]*\)s|(?:[A-Za-z0-9+/_-]{16,}+={1,2}(?![\w=]))|[.+!$%^&*~/-]*+\w[\w.+!$%^&*~/-]*+|\S"
)
#: Words that tell a credential's name, and words that tell that it is none (fixed values).
SECRET_WORDS = set("password passwd pwd pass passphrase passcode pw secret token key apikey auth authtoken credential credentials cred creds pin kennwort passwort contrasena contraseña clave senha motdepasse passe mot signing private access bearer login authorization basic client dsn conn sshpass".split())
DENY_WORDS = set("label field name names ref sha sha1 sha256 sha384 sha512 md5 hash digest checksum commit uuid guid integrity docs url public pub verify msg text mode id build version revision rule marks banner fingerprint path title hint message placeholder example endpoint host port user path header_name".split())
#: Values that stand for a credential without being one (fixed values).
PLACEHOLDER = re.compile(
    r"(?i)^(?:x+|\*+|\.+|-+|0+|changeme\d*|change[_-]?me\d*|replace[_-]?me\d*|your[_-].*|my[_-](?:password|token|secret|key)|dummy\d*|example.*|sample|test|todo|none|null|nil|true|false|undefined|password\d{0,3}|secret|token|redacted|hidden|placeholder|fixme|foo|bar|default|empty|unset|<.*>|\$\{.*|\$\(.*|\{\{.*|%.*%|\$[A-Z_]+|!vault.*|vault:.*|ref\+.*|env[.:].*|os\.environ.*|process\.env.*|ENV\[.*|getenv.*|secrets?[./].*)$"
)
_UUID = re.compile(r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")
_HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_AKIA = re.compile(r"AKIA[A-Z0-9]{12,}$|ASIA[A-Z0-9]{12,}$")
_JWT = re.compile(r"eyJ[\w-]+\.[\w-]+\.[\w-]+$")
_SRI = re.compile(r"sha(?:1|256|384|512)-")
_IDENT = re.compile(r"[A-Za-z_][\w]*")
#: A name of words with one short number or mark at its end, in one piece or with hyphens, or a name with a version in it.
_NAMED = re.compile(r"_*(?:[A-Z]?[a-z]{2,}|[A-Z])(?:_?[A-Z]?[a-z]+|_[A-Z]+)*+(?:_?[A-Z]{0,2}\d{1,3}[A-Za-z]{0,2}|_[0-9a-f]{3,6})|[a-z]{2,}(?:-[a-z]{2,})+[-_][0-9a-z]{1,8}|[A-Z][A-Za-z]*-\d(?:\.\d)*(?:-[A-Za-z]+)*")
_HOST = re.compile(r"[\w.-]+\.(?:example|com|org|net|io|internal|local|js|py|ts|h|go|rb|tgz|json)(?:/.*)?")
_TAGGED = re.compile(r"[A-Za-z]{2,5}[._-](?:[a-z]{2,5}[._-])?[A-Za-z0-9]{16,}$")
_PASSLIKE = re.compile(r"[A-Za-z]+[^\w]?[A-Za-z_]*\d+\w{0,2}[!*$%]?|[A-Za-z]+[-_+.!~$%^&*][A-Za-z]+[-_+.!~$%^&*]?\d+\S{0,3}")
_ALNUM = re.compile(r"[A-Za-z0-9+/_=-]+")
_PARTS = re.compile(r"[A-Z]+(?![a-zé])|[A-Z]?[a-zñé]+|\d+")
_PATH = re.compile(r"[\w./-]+")


def shape(t: str) -> str:
    """Coarse kind of a token."""
    n = len(t)
    if n == 0:
        return "^"
    if n == 1:
        return t if not t.isalnum() else "1"
    if t.startswith("-----"):
        return ("private" if _PRIVATE.match(t) else "public") + ("" if _FILLED.match(t) else " frame")
    if t.endswith("://"):
        return "scheme"
    if t[0] in "<{$%" and n > 3 and t[-1] in ">})s" or t.startswith("${"):
        return "ref"
    if _UUID.match(t):
        return "uuid"
    if t.isdigit():
        return "num"
    low = t.islower() or not any(map(str.isupper, t))
    digits = sum(map(str.isdigit, t))
    letters = sum(map(str.isalpha, t))
    if _HEX.fullmatch(t) and digits and letters and n >= 8:
        return f"hex{n}" if n in (32, 40, 56, 64, 96, 128) else "hex" if n < 128 else "hex blob"
    if _AKIA.match(t):
        return "akia"
    if _JWT.match(t):
        return "jwt"
    if _SRI.match(t):
        return "sri"
    if digits == 0 and letters == n:
        return "lower" if low else "UPPER" if t.isupper() else "Camel"
    if _IDENT.fullmatch(t) and digits <= 2 and n < 22 and (low or t.isupper()):
        return "ident"
    if _HOST.fullmatch(t):
        return "host"
    if n < 40 and _NAMED.fullmatch(t):
        return "named"
    if _TAGGED.match(t) and digits and not low:
        return "tagged"
    if _PASSLIKE.fullmatch(t) and digits >= 2 and n >= 8:
        return "passlike"
    if digits and letters and not low and _ALNUM.fullmatch(t):
        return "rand" + ("9" if n < 12 else "16" if n < 20 else "32" if n < 45 else "99")
    if _PATH.fullmatch(t) and "/" in t and digits <= 2:
        return "path"
    if digits and letters and n >= 8:
        return "mixed"
    return "sym" if not letters else "word"


@lru_cache(maxsize=20_000)
def _facts(t: str) -> tuple[str, str, frozenset, str]:
    """(shape, lower-cased word or '', name parts, length bucket)."""
    parts = frozenset(map(str.lower, _PARTS.findall(t))) if len(t) < 40 else frozenset()
    if len(t) < 40 and t.lower().replace("_", "").replace("-", "") in ("motdepasse", "apikey", "authtoken", "sshpass"):
        parts = parts | {"password"}
    word = t.lower() if len(t) < 16 and not any(map(str.isdigit, t)) else ""
    n = len(t)
    return shape(t), word, parts, "0" if n < 4 else "1" if n < 8 else "2" if n < 14 else "3" if n < 24 else "4" if n < 60 else "5"


_CLEAN = {"(": 1, ")": 1, "{": 1, "}": 1, ";": 1, ",": 1}


def features(tokens: list[str], step: int = 0) -> Iterator[np.ndarray]:
    """(tokens, K) hashed feature slots, in pieces of ``step`` tokens (0: all at once); the pieces of one sequence share what is known from its left."""
    facts = [_facts(t) for t in tokens]
    n = len(tokens)
    step = step or n
    out = np.zeros((min(step, n), K), dtype=np.int64)
    lhs, lhs_kind, quote, header, after_scheme = "", "-", "", "", 0
    for i, t in enumerate(tokens):
        sh, word, _, size = facts[i]
        p1 = tokens[i - 1] if i else "^"
        p2 = tokens[i - 2] if i > 1 else "^"
        nx = tokens[i + 1] if i + 1 < n else "$"
        s1 = facts[i - 1][0] if i else "^"
        sn = facts[i + 1][0] if i + 1 < n else "$"
        w1 = facts[i - 1][1] if i else ""
        sep = p1 if len(p1) == 1 else "w"
        q = "q" if quote else "-"
        kind = lhs_kind
        # a word just before a bare value ("password VALUE", "passphrase VALUE") names it as well
        prev = next((tokens[j] for j in range(i - 1, max(-1, i - 4), -1) if len(tokens[j]) > 2), "")
        pk = _kind(prev)
        f = [
            f"s={sh}", f"s={sh}|k={kind}", f"s={sh}|k={kind}|{q}", f"s={sh}|pk={pk}", f"s={sh}|z={size}|{q}", f"p1={sep}|s={sh}", f"w1={w1}|s={sh}", f"p2={p2 if len(p2) < 12 else '#'}|{sep}|s={sh}",
            f"nx={nx if len(nx) == 1 else sn}|s={sh}|{sep}", f"hd={header}|s={sh}", f"url={after_scheme}|{sep}|{nx if len(nx) == 1 else 'w'}|s={sh}", f"w={word}" if word else "w=#", f"q={q}|{sep}|k={kind}", f"s1={s1}|s={sh}", f"k={kind}|z={size}|s={sh}", "bias",
        ]
        for j, x in enumerate(f):
            out[i % step, j] = slot(x)
        if t in "\"'`" and len(t) == 1:
            quote = "" if quote == t else (quote or t)
        elif t in ("=", ":") or t == ">" and p1 == "=":
            name = next((tokens[j] for j in range(i - 1, max(-1, i - 8), -1) if len(tokens[j]) > 1 and tokens[j] not in ("str", "string", "char", "static")), "")
            if name and not name.endswith("://") and facts[i - 1][0] not in ("host",):
                lhs, lhs_kind = name, _kind(name)
        elif t in (";", "\n") and not quote:
            lhs, lhs_kind = "", "-"
        if word in ("bearer", "basic"):
            header = word
        after_scheme = 1 if sh == "scheme" else (after_scheme + 1 if 0 < after_scheme < 6 else 0)
        if (i + 1) % step == 0 or i + 1 == n:
            yield out[: i % step + 1]


#: The same inside names written without separators.
_DENY_PART = re.compile(r"sha\d|hash|digest|checksum|commit|uuid|label|integrity|field|docsurl|secretname|keyname|tokenname|buildref|public")
_SECRET_PART = re.compile(r"secret|passw|passphrase|pwd|token|apikey|signingkey|accesskey|privatekey|cred|kennwort|motdepasse|smtplogin|dbpass")


@lru_cache(maxsize=20_000)
def _kind(name: str) -> str:
    """secret, deny or none by the parts of a name."""
    parts, low = _facts(name)[2], name.lower().replace("_", "").replace("-", "")
    deny = parts & DENY_WORDS or _DENY_PART.search(low)
    secret = parts & SECRET_WORDS or _SECRET_PART.search(low)
    return "both" if deny and secret else "deny" if deny else "secret" if secret else "none"


# ---------------------------------------------------------------- training lines


def _value(r: random.Random) -> str:
    """A value that looks like a credential."""
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    pick = lambda a, n: "".join(r.choice(a) for _ in range(n))
    word = lambda: r.choice("river stone cloud meadow lantern copper winter garden falcon marble thunder silver orange planet".split())
    kind = r.randrange(10)
    if kind == 9:
        plain = word().capitalize() + r.choice("!-_+.") + word() + str(r.randint(10, 9999))
        return plain.encode().hex() if r.random() < 0.5 else base64.b64encode(plain.encode()).decode()
    if kind <= 2:
        return word().capitalize() + r.choice("!-_+.$") + word() + str(r.randint(10, 9999)) + r.choice(["", "!", "_x", "Q", "*", "Zz"])
    if kind == 3:
        return "AKIA" + pick(alnum[:26] + "234567", 16)
    if kind == 4:
        return "eyJ" + pick(alnum, 20) + "." + pick(alnum, 40) + "." + pick(alnum + "-_", 43)
    if kind == 5:
        return r.choice(["lq_live_", "tk.api.", "ghk-", "SX_", "rz_test_"]) + pick(alnum, r.choice([24, 32]))
    if kind == 6:
        return pick("0123456789abcdef", r.choice([32, 40, 64]))
    if kind == 7:
        return pick(alnum + "+/", 40)
    return pick(alnum, r.choice([12, 16, 24, 28]))


def _harmless(r: random.Random) -> str:
    return r.choice(["changeme", "xxxx", "your-token", "REPLACE_ME", "dummy", "${API_TOKEN}", "<set in deploy>", "{{ token }}", "<your-key-here>", "xxxxxxxxxxxxxxxx", "!vault ref/river", "None", "x"])


def _plain(r: random.Random) -> str:
    """A line without a credential: common forms of programs, markup, data and prose."""
    words = "item value count index user data list node file line result buffer queue page name size offset state event path row column table total next left right first last config option handler client server request response token key secret auth cell entry frame match model order point score stack target thread weight window cache".split()
    one, d, pick = lambda: r.choice(words), lambda n=99: r.randint(0, n), lambda a, n: "".join(r.choice(a) for _ in range(n))
    hexes, base = lambda n: pick("0123456789abcdef", n), lambda n: pick("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", n)

    def name() -> str:
        parts = [one() for _ in range(r.choice([1, 1, 2, 2, 3]))]
        style = r.randrange(4)
        joined = "_".join(parts) if style == 0 else parts[0] + "".join(p.capitalize() for p in parts[1:]) if style < 3 else "".join(p.capitalize() for p in parts)
        letter = lambda: r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
        return joined + r.choice(["", "", "", str(d()), f"_{d()}", f"_{d(9)}{letter()}", f"{letter()}{d()}", f"{letter()}{d()}{letter()}", f"{d()}{letter()}", letter() + letter() + letter(), f"_{hexes(r.choice([3, 4, 6]))}"])

    n, m, k, indent, end, q = name(), name(), name(), r.choice(["", "  ", "    ", "\t"]), r.choice([";", ";", ""]), r.choice("\"\"'")
    call = lambda: r.choice([f"{m}({k}, {d()})", f"{m}.{k}({d()})", f"{m}({k})", f"{m}.{k}({n})", f"{m}[{d()}]", f"{m}[{k}]", f"{m} {r.choice('+-*/%')} {d(999)}", f"{m} {r.choice('+-*/')} {k}", f"new {m}({k})", f"await {m}({k})", f"{m} ? {k} : {d()}", f"{m}.{k}", f"{m}::{k}({d()})", m])
    text = lambda: r.choice([f"{one()} {one()} {one()}", f"{one()}-{one()}", f"{one()}/{one()}.{r.choice(['py', 'js', 'css', 'json', 'png', 'h'])}", f"%d {one()}", f"{one()}: {{}}", f"#{hexes(6)}", f"20{d():02}-{r.randint(1, 12):02}-{r.randint(1, 28):02}", f"{d(9)}.{d(30)}.{d(20)}", f"{one()}_{d()}", "application/json", "utf-8", f"/{one()}/v{d(9)}/{one()}", f"{one()} {one()}, {d()} {one()}.", f"v{d(9)}.{d(20)}.{d(9)}", n, f"{one()}-{hexes(4)}", f"{one()}.{one()}", r.choice(["MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-3.0-or-later", "MPL-2.0"])])
    kind = r.randrange(37)
    if kind <= 5:
        return indent + r.choice(["const ", "let ", "var ", "", "", "int ", "auto ", "final ", "val ", "local "]) + n + r.choice([" = ", " = ", " := ", " += ", ": int = ", ": number = "]) + call() + end
    if kind <= 8:
        return indent + r.choice(["if ({})", "if {}", "while ({})", "while {}", "elif {}", "}} else if ({})", "assert {}", "return {}"]).format(f"{n} {r.choice(['>', '<', '>=', '<=', '==', '!=', '===', '&&', '||', 'and', 'in'])} {r.choice([str(d(999)), m, call()])}") + r.choice([" {", ":", "", ";"])
    if kind <= 10:
        return indent + r.choice([f"for (const {n} of {m}) {{", f"for (int {n} = 0; {n} < {m}; {n}++) {{", f"for {n} in {m}:", f"for _, {n} := range {m} {{", f"for {n} in {m} {{", f"for (auto& {n} : {m}) {{", f"for (let {n} = {d()}; {n} < {m}.length; {n} += 1) {{", f"{m}.each do |{n}|", f"foreach (${m} as ${n}) {{"])
    if kind <= 12:
        return indent + r.choice([f"def {n}({m}, {k}={d()}):", f"function {n}({m}, {k}) {{", f"func {n}({m} int, {k} string) ({one()}, error) {{", f"fn {n}({m}: &str, {k}: u{r.choice([8, 32, 64])}) -> {one()} {{", f"public static void {n}(int {m}, String {k}) {{", f"void {n}(const char* {m}, int {k});", f"class {n} extends {m} {{", f"struct {n} {{", f"static const unsigned char {n}[] = {{", f"const {n} = ({m}, {k}) => {call()};", f"int {n}[{d(999)}] = {{", f"type {n} struct {{"])
    if kind <= 14:
        return r.choice([f"import {n} from {q}./{m}{q};", f"from {one()}.{n} import {m}, {k}", f"#include \"{n}.h\"", f"use {one()}::{n}::{m};", f"package {one()}.{one()}.{n};", f"import {one()}.{one()}.{n};", f"const {n} = require({q}./{m}{q});", f"export {{ {n}, {m} }};", f"require_once {q}{n}.php{q};", f"using {n};"])
    if kind <= 16:
        return indent + r.choice([f"return {call()}{end}", f"{n}({m}, {q}{text()}{q}){end}", f"{n}.{m}({q}{text()}{q}, {k}){end}", f"printf(\"{text()}\\n\", {n});", f"throw new Error({q}{text()}{q});", f"raise ValueError(f{q}{text()} {{{n}}}{q})", f"{n}.push({m});", f"{n}.{m}.{k}()", f"yield {n}", f"delete {n}[{m}];", f"{n}++;", f"case {d()}: return {n};", f"expect({n}({d()})).toBe({m});"])
    if kind <= 18:
        return indent + r.choice(["const ", "", "var ", "static const char* "]) + n + r.choice([" = ", ": ", "="]) + q + text() + q + end
    if kind == 19:
        return indent + f"{q}{one()}{q}: " + r.choice([f"{q}{text()}{q}", str(d(9999)), "true", "null", f"[{d()}, {d()}]", "{"]) + ","
    if kind == 20:
        return r.choice([f"  \"resolved\": \"https://{one()}.example/{one()}/-/{one()}-{d(9)}.{d(9)}.{d(9)}.tgz\",", f"  \"integrity\": \"sha512-{base(86)}==\",", f"{one()}=={d(9)}.{d(20)}.{d(9)}", f"  \"{one()}-{one()}\": \"^{d(9)}.{d(20)}.{d(9)}\",", f"{one()} v{d(9)}.{d(9)}.{d(9)} h1:{base(43)}=", f"implementation '{one()}.{one()}:{one()}:{d(9)}.{d(9)}'"])
    if kind <= 22:
        return r.choice(["# ", "// ", " * ", "-- ", "", "/* "]) + r.choice([f"SPDX-License-Identifier: {r.choice(['MIT', 'BSD-2-Clause', 'BSD-3-Clause', 'GPL-2.0-only', 'LGPL-2.1-or-later', 'MPL-2.0', 'ISC'])}", f"License: {r.choice(['MIT', 'BSD-3-Clause', 'Apache-2.0', 'MPL-2.0'])}", f"Copyright (c) 20{d():02} {one().capitalize()} {one().capitalize()}", f"TODO: move {n} to {m}", f"See https://{one()}.example/{one()}/{d(9999)}#L{d()}", f"{one().capitalize()} the {one()} before {d()} {one()}s are {one()}ed.", f"{n}: the {one()} of {m}, in {one()}s", f"@param {n} the {one()} {one()}", f"{one()} {d()}% of {n}, see {m}()", f"{d()}.{d(9)} - {one()} {one()} ({n})", f"=== {one()} {one()} ===", f"Generated on 20{d():02}-0{r.randint(1, 9)}-{r.randint(10, 28)} {r.randint(10, 23)}:{r.randint(10, 59)}"])
    if kind == 23:
        return indent + r.choice([f"<{one()} class=\"{one()}-{d()}\" id=\"{n}\">", f"<a href=\"/{one()}/{n}\">{one()}</a>", f".{one()}-{d()} {{ color: #{hexes(6)}; width: {d()}px; }}", f"<p>{one()} {one()} {d()}</p>", f"</{one()}>", f"@media (min-width: {d(999)}px) {{"])
    if kind == 24:
        return indent + ", ".join(r.choice([f"0x{hexes(2)}", str(d(255)), f"{d()}.{d(9999)}", f"-{d()}"]) for _ in range(r.randint(3, 12))) + ","
    if kind == 25:
        return indent + r.choice([q + base(r.choice([60, 64, 76])) + q + r.choice([",", " +", ""]), base(r.choice([64, 76])), hexes(64), f"b'{hexes(40)}'", "\\x" + "\\x".join(hexes(2) for _ in range(8)), f"[{d()}, \"{one()}\", \"{hexes(8)}\"],", f"({d()}, '{one()}', '{hexes(12)}', {d(9)}.{d()}),", f"{one()},{d()},{hexes(8)},{d(9)}.{d()}"])
    if kind == 26:
        return r.choice([f"SELECT {n}, {m} FROM {k} WHERE {n} = {d()};", f"CREATE TABLE {n} ({m} BIGINT, {k} VARCHAR({d()}));", f"INSERT INTO {n} VALUES ({d()}, '{text()}');", f"ALTER TABLE {n} ADD COLUMN {m} TEXT;"])
    if kind == 27:
        return r.choice([f"- {n}: {m}", f"{n}: {d(9999)}", f"  - {one()}-{d()}", f"  image: {one()}/{one()}:{d(9)}.{d(9)}", f"{n}: {text()}", f"[{one()}.{n}]", f"{n} = {text()}", f"RUN {one()} --{one()}={d()} {n}", f"EXPOSE {d(9999)}", f"COPY {n} /{one()}/{m}", f"{n}: {m} {k}", f"\t$({n.upper()}) -o {m} {k}.c", f"export {n.upper()}={d()}", f"#define {n.upper()} {d(9999)}", f"## {one().capitalize()} {d()}", f"| {one()} | {d()} | {n} |"])
    if kind == 28:
        return ";".join(r.choice([f"var {pick('abcdefgh', 1)}{d()}={call()}", f"{pick('abcdefgh', 2)}.{one()}=function({pick('abc', 1)},{pick('def', 1)}){{return {pick('abc', 1)}{d()}+{d()}}}", f"if({n}){{{m}({k})}}", f"{n}({{{one()}:{d()},{one()}:\"{text()}\"}})"]) for _ in range(r.randint(2, 6)))
    if kind == 29:
        return indent + r.choice(["{", "}", "});", "],", ")", "else:", "try {", "end", "pass", "break;", '"""', "/**", "*/", "---", "...", "<?php", "@Override", f"@{n}", f"}} // {n}", f"{n},", f"{n}: {m},", f"{n} = {m},", f"&{n},", f"*{n} = {m};"])
    if kind == 30:
        return f"{one().capitalize()} {one()} {r.choice(['of', 'and', 'with', 'for'])} {r.choice(['the', 'a', 'each'])} {one()}{r.choice([',', '', ';'])} {r.choice(['when', 'until', 'because', 'so'])} {d()} {one()}s {r.choice(['are', 'were'])} {one()}ed{r.choice(['.', ':', '', ', see ' + n + '.'])}"
    if kind == 31:
        return f"{n} {r.choice(['=', '=>', ':', '->', '<-'])} {{ {one()}: {r.choice([q + text() + q, str(d(999)), m])}, {one()}: {r.choice([q + text() + q, str(d(999)), k])} }}{end}"
    if kind == 32:
        return indent + r.choice([f"{q}{n}{q}: {m},", f"{m}[{q}{n}{q}] = {k}{end}", f"{m}.get({q}{n}{q}, {d()})", f"assert {m}({q}{text()}{q}) == {q}{text()}{q}", f"{n}={q}{text()}{q} {m}={q}{d()}{q}", f"`{text()} ${{{n}}}`", f"{q}{text()}{q},"])
    if kind == 33:
        return indent + r.choice([f"{q}license{q}: {q}{{}}{q}", f"license = {q}{{}}{q}", f"__license__ = {q}{{}}{q}", f"license: {{}}", f"license=({q}{{}}{q})"]).replace("{}", r.choice(["MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-3.0-or-later", "MPL-2.0", "EPL-2.0", "LGPL-2.1-only"])) + r.choice(["", ",", ""])
    if kind <= 35:
        return indent + r.choice([f"{one().capitalize()}::{m}({q}/{one()}/{one()}{q}, {q}{n}{q}){end}", f"{m}({q}{n}{q}, {q}{k}{q}){end}", f"{m}.on({q}{one()}{q}, {q}{n}{q});", f"${n}->{m}({q}{k}{q}){end}", f"[{q}{n}{q}, {q}{m}{q}],", f"{n} = {q}{m}{q}{end}", f"@{one()}({q}{n}{q})"])
    return indent + f"{n}{r.choice([' ', '.', '(', ' = ', ', ', ' -> ', '::', '['])}{m}{r.choice([' ', ')', '', ';', ', ', ']'])}{r.choice(['', k, str(d())])}"


def training_lines(without: frozenset[int] = frozenset()) -> list[tuple[str, list[tuple[int, int]]]]:
    """Lines with the character spans of their values; the generator's words are its own. Forms in ``without`` are held out, to measure the field on forms it has not seen."""
    r = random.Random(SEED)
    hexes = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    rand = lambda n: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(n))
    noun = lambda: r.choice("river stone cloud meadow lantern copper winter garden falcon marble batch token ledger key index".split())
    names = "password passwd pwd db_pass DB_PASS secret client_secret clientSecret CLIENT_SECRET api_key apiKey API_KEY token auth_token authToken accessToken signing_key signingKey access_key SMTP_PASSWORD smtpLogin adminPassword servicePwd passphrase kennwort contrasena motDePasse MOT_DE_PASSE clave senha hook_secret HOOK_SECRET auth bearer MAIL_PW PAYMENT_KEY uploadCred uploadCredential private_key FERRY_TOKEN RIVER_KEY".split()
    plain = "k1 connValue conn_value value K2 target mirror broker dsn target_2 BROKER handle remote".split()
    deny = [("GIT_COMMIT", 40), ("sha256sum", 64), ("baseRevision", 40), ("REVISION", 40), ("etag_hash", 32), ("md5_digest", 32), ("file_checksum", 64)]
    decl = lambda n: r.choice([f"{n} = ", f"const {n} = ", f"const {n}: string = ", f"let {n} = ", f"static const char* {n} = ", f"private static final String {n} = ", f"const {n}: &str = ", f"${n} = ", f"var {n} = ", f"  {n} := ", f"{n}_3 = "])
    out: list[tuple[str, list[tuple[int, int]]]] = []

    def put(*parts: str | tuple[str]) -> None:
        if kind in without:
            return
        text, spans = "", []
        for p in parts:
            if isinstance(p, tuple):
                spans.append((len(text), len(text) + len(p[0])))
                text += p[0]
            else:
                text += p
        out.append((text, spans))

    for _ in range(N_TRAIN):
        v, q, n, end = (_value(r),), r.choice("\"\"'`"), r.choice(names) + r.choice(["", "", "_1", "_4", "P"]), r.choice([";", "", ","])
        kind = r.randrange(35)
        user = f"svc{r.choice('_-')}{noun()}"
        host = f"{noun()}-{r.randint(1, 40)}.{r.choice(['internal', 'corp', 'staging', 'prod'])}.example"
        if kind <= 4:
            put(decl(n), q, v, q, end)
        elif kind == 5:
            put(decl(n), q, (rand(16).replace("+", "x").replace("/", "y"),), q, " + ", q, (rand(16).replace("+", "x").replace("/", "y"),), q, end)
        elif kind == 6:
            put("  ", '"', n, '": "', v, '"', end)
        elif kind == 7:
            put(f"{n}=", v) if r.random() < 0.7 else put(f"export {n}=", "'", v, "'")
        elif kind == 8:
            put(r.choice(["  ", ""]), f"{n}: ", *r.choice([(v,), ("'", v, "'"), ('"', v, '"')]))
        elif kind == 9:
            put(f"{n} = ", v)
        elif kind == 10:
            put(f"ENV {n}=", v)
        elif kind == 11:
            put(f"machine {host} login {user} password ", v)
        elif kind == 12:
            put(f"//{host}/:_authToken=", v)
        elif kind == 13:
            if r.random() < 0.6:
                put(r.choice(["# try: ", "", "// "]), f"curl {r.choice(['-u', '-u', '--user', '-s -u'])} {user}:", r.choice([v, (rand(r.choice([10, 12, 14])).replace("+", "x").replace("/", "y"),)]), f" https://{host}/{noun()}")
            else:
                put('curl -H "', r.choice(["X-Key", "X-Api-Key", "X-Auth-Token"]), ": ", v, f'" https://{host}/{noun()}')
        elif kind == 14:
            put("sshpass -p ", "'", v, "'", f" scp out.tgz svc@{host}:/srv")
        elif kind == 15:
            put(r.choice(["# ", "// ", ""]), f"mysql --user={user} --password=", v, f" -h {host}")
        elif kind == 16:
            put(decl(r.choice(plain + names)), q, r.choice(["postgres", "amqp", "https", "mysql", "redis"]) + f"://{user}:", (rand(14).replace("+", "x").replace("/", "y"),), f"@{host}:{r.randint(1000, 9999)}/{noun()}", q, end)
        elif kind == 17:
            put(decl(r.choice(["header", "HEADER", "line", "authLine", "AUTH_LINE"])), q, "Authorization: Bearer ", v, q, end)
        elif kind == 18:
            put(decl(r.choice(["auth_line", "authLine", "AUTH_LINE", "header"])), q, "Basic ", (base64.b64encode(f"{user}:{_value(r)[:20]}".encode()).decode(),), q, end)
        elif kind == 19:
            named = f"{r.choice(['user', 'login', 'account', 'log in as', ''])} {user}{r.choice([',', ' /', ':', ' and', ''])} {r.choice(['password', 'pass', 'pw', 'pwd', 'passphrase', 'secret'])}{r.choice(['', '', ':', ' is'])} "
            put(r.choice(["# ", "// ", "; "]), named if r.random() < 0.5 else r.choice([f"account {user}, passphrase ", f"use password ", f"{noun()} login is {user} / ", f"login for the demo: {user} / ", f"old token was ", f"pw: ", f"{user} has the password ", f"sign in with {user} / "]), (_value(r) if r.random() < 0.4 else noun().capitalize() + r.choice("!-_+.") + noun() + str(r.randint(100, 9999)) + r.choice(["", "!", "_x", "Q"]),))
        elif kind == 20:
            put("  ", r.choice(["token", "password", "pin", "key", "secret"]), ": ", (base64.b64encode((noun().capitalize() + r.choice("!-_+.") + noun() + str(r.randint(10, 9999))).encode()).decode(),))
        elif kind == 21:
            prefixed = r.choice([("AKIA" + rand(16).upper().replace("+", "2").replace("/", "3"),), (r.choice(["lq_live_", "tk.api.", "ghk-", "SX_"]) + rand(30).replace("+", "a").replace("/", "b"),), ("eyJ" + rand(20).replace("/", "a").replace("+", "b") + "." + rand(40).replace("/", "a").replace("+", "b") + "." + rand(43).replace("/", "a").replace("+", "b"),)])
            put(decl(r.choice(plain)), q, prefixed, q, end)
        elif kind == 22:
            put(decl(n), q, _harmless(r), q, end)
        elif kind == 23:
            put(f"{n}={_harmless(r)}") if r.random() < 0.5 else put(f"machine {host} login {user} password {_harmless(r)}")
        elif kind == 24:
            d, size = r.choice(deny)
            put(decl(d), q, hexes(size), q, end) if r.random() < 0.7 else put(f"{d}={hexes(size)}")
        elif kind == 25:
            put(decl(r.choice(["INTEGRITY", "integrity", "sri"])), q, "sha384-" + rand(64), q, end)
        elif kind == 26:
            h = hexes(32)
            put(decl(r.choice(["RUN_UUID", "runUuid", "trace_id", "request_id"])), q, f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}", q, end)
        elif kind == 27:
            put(decl(r.choice(["SECRET_NAME", "secretName", "PASSWORD_LABEL", "tokenField", "TOKEN_FIELD", "key_name", "password_hint"])), q, r.choice([f"{noun()}-{noun()}-credentials", "Forgot your password", "X-Auth-Token", "csrf_token", "access_token", "Enter your password", f"{noun()}-{noun()}-{r.randint(1, 99)}-key"]), q, end)
        elif kind == 28:
            put(r.choice([f'{n} = os.environ["{n.upper()}"]', f"const {n} = process.env.{n.upper()};", f'{n} = getenv("{n.upper()}")', f"// the password is read from the vault path secret/{noun()}/{noun()}", f'const {noun()}Lib = require("./{noun()}_2b");', f'{noun()}_1c = {noun()}.get("{noun()}_{r.randint(1, 99)}")', f'from . import token_{r.randint(1, 99)}']))
        elif kind == 29:
            put(r.choice([f'  "{rand(72)}"', f'    "{hexes(12)}": {r.randint(1, 10**6)},', f'  {{ "id": {r.randint(1, 99)}, "code": "{rand(10)}", "w": 0.{r.randint(100, 999)} }},', f"var a{r.randint(1, 99)}={{{noun()}:\"{rand(8)}\",z:{r.randint(1, 99)}}};", rand(64), f"    b'{hexes(64)}',", f"{noun().upper()} = {noun()}.{noun()}(b'{hexes(2 * r.randint(70, 900))}')", f'{noun()} = "{hexes(2 * r.randint(70, 900))}"']))
        elif kind == 30:
            put(decl(r.choice(["DOCS_URL", "docsUrl", "endpoint", "mirror"])), q, f"https://{host}:{r.randint(1000, 9999)}/{noun()}?token=<token>", q, end) if r.random() < 0.6 else put(f'  "endpoint": "https://{host}/v{r.randint(1, 9)}",')
        elif kind == 31:
            put(decl(r.choice(["GREETING_2", "errorText", "separator", "bracketPairs", "license", "version", "name", "name"])), q, r.choice([f"There is one {noun()} per token, and its key is {r.randint(1, 99)}.", f"{noun()}|{noun()}|{noun()}", "Apache-2.0", f"{r.randint(1, 9)}.{r.randint(1, 30)}.0", f"{noun()}-{noun()}-{r.randint(1, 9)}a", f"{noun()}-{noun()}_{hexes(8)}"]), q, end)
        elif kind == 34:
            owner = r.choice(["RSA ", "EC ", "OPENSSH ", "DSA ", "ENCRYPTED ", ""])
            body = lambda br: br + br.join(rand(64) for _ in range(r.randint(2, 4))) + br
            br = r.choice(["\n", "\n", "\\n"])
            private = f"-----BEGIN {owner}PRIVATE KEY-----{body(br)}" + (f"-----END {owner}PRIVATE KEY-----" if r.random() < 0.8 else "")
            public = f"-----BEGIN {'PUBLIC KEY'}-----{body(br)}-----END PUBLIC KEY-----" if r.random() < 0.5 else f"-----BEGIN CERTIFICATE-----{body(br)}-----END CERTIFICATE-----"
            other = r.choice([(public,), (f"-----BEGIN {owner}PRIVATE KEY-----{br}<paste here>{br}-----END {owner}PRIVATE KEY-----",), (public, (private.rstrip(br),))])
            block = [(private.rstrip("\\n\n"),)] if r.random() < 0.6 else [x if isinstance(x, tuple) else x for x in other]
            put(*([] if r.random() < 0.5 else [decl(n), q]), *block)
        elif kind == 32:
            put(r.choice(["# ", "// ", " * "]), r.choice([f"Version {r.randint(1, 99)}.{r.randint(1, 99)} lets you wrap the token without a key.", f"The token was rolled back at {r.randint(1, 59)}:{r.randint(10, 99)} because the {noun()} stayed.", f"With {r.randint(1, 99)} workers the token and the key finish {r.randint(1, 99)} percent sooner.", f"{noun()}lib v{r.randint(1, 9)}.{r.randint(1, 30)}.{r.randint(1, 9)}", f"(c) the {noun()}-ui contributors, https://{noun()}.example", f"Call sample_{noun()} only when the token is stale."]))
        else:
            put(r.choice([f"const {noun()}N{r.randint(1, 9)}e = {noun()}Token({noun()}N{r.randint(1, 9)}b, {r.randint(1, 99)});", f'app.get("/api/{noun()}/v{r.randint(1, 9)}/load", {noun()}Token);', f"  name: {noun()}-{r.randint(1, 99)}a", f"user={user}", f"  host: {host}", f"PORT={r.randint(1000, 9999)}", f"FROM base-{noun()}:{r.randint(1, 20)}", f"token_{r.randint(1, 9)}g = {noun()}.{noun()}"]))
    r = random.Random(SEED + 1)
    return out + [(_plain(r), []) for _ in range(N_PLAIN)]


def _label(text: str, spans: list[tuple[int, int]]) -> tuple[list[str], np.ndarray]:
    tokens, labels = [], []
    for m in _TOKEN.finditer(text):
        tokens.append(m[0])
        mark = O
        for s, e in spans:
            if m.start() < e and m.end() > s:
                mark = B if m.start() <= s else I
        labels.append(mark)
    return tokens, np.array(labels)


@lru_cache(maxsize=4)
def model(without: frozenset[int] = frozenset()) -> Chain:
    """The trained field; the same weights every time."""
    xs, ys = [], []
    for text, spans in training_lines(without):
        tokens, y = _label(text, spans)
        if tokens:
            tokens, y = tokens[:40], y[:40]
            xs.append(next(features(tokens)))
            ys.append(y)
    return Chain(3).fit(xs, ys)


# ---------------------------------------------------------------- search


def _credible(value: str) -> bool:
    """The exact check behind the field."""
    if len(value) < 5 or PLACEHOLDER.match(value) or _UUID.match(value) or value.startswith(("http://", "https://", "/", "./", "sha256-", "sha384-", "sha512-")):
        return False
    if len(value) < 10 and value.isalnum() and not re.fullmatch(r"[A-Z]?[a-z]+\d{2,}", value):
        return False
    if len(set(value)) < 4 or re.fullmatch(r"[a-z]+(?:[-_ .][a-z]+)*|[A-Z_]+|[A-Za-z]+\(.*", value):
        return False
    return not re.fullmatch(r"[\w-]+(?:\.[\w-]+)*\.(?:example|com|org|net|io|js|py)(?::\d+)?(?:/\S*)?", value)


#: The name left of a value, read backwards, so that it is found in one step whatever stands before it.
_LEFT = re.compile(r"[\"'`(]*\s*(?:>=|=:|=|:)\s*(?:[&\w ]+:\s*)?[\"']?([\w$-]*[A-Za-z_$])")


def _denied(before: str, value: str) -> bool:
    """A digest or id under a name that says so."""
    if not re.fullmatch(r"[0-9a-fA-F]{7,}|[0-9a-fA-F-]{36}", value):
        return False
    m = _LEFT.match(before[::-1])
    return bool(m) and _kind(m[1][::-1]) == "deny"


_NAME, _ASSIGNED = re.compile(r"[A-Za-z_$][\w$]*"), re.compile(r"(?:\s*:\s*[&\w ]+)?\s*:?=")


def _short(token: str) -> str:
    """A token by which the field judges a very long one: its kind is the same, and shapes are tried in bounded time."""
    if len(token) <= 2_000:
        return token
    token = re.sub(r"[A-Za-z0-9_-]{400,}", lambda m: m[0][:200] + m[0][-200:], token)
    return token if len(token) <= 4_000 else token[:2_000] + token[-2_000:]


_QUOTES, _TYPES = {'"': 1, "'": 2, "`": 3}, ("str", "string", "char", "static")
_KINDS, _HEADERS = ("-", "secret", "deny", "both", "none"), ("", "bearer", "basic")
CHUNK, MEMO, SLOTS = 100_000, 150_000, 1 << 18


class _Numbers(dict):
    """Classes of the tokens met so far; others are asked of the field."""

    def __init__(self, ask) -> None:
        self.ask = ask

    def __missing__(self, t: str) -> int:
        return self.ask(t)


class Field:
    """The field over many lines at once: the scores of :func:`features` without a call per token, and the best labels.

    Tokens are numbered by what the features see of them; groups of features are looked up by such numbers in tables of ``SLOTS`` places, where a later
    key takes an earlier one's place, and computed if they are not there. The numbers start anew beyond ``MEMO`` tokens, so memory is bounded and results do not change.
    """

    def __init__(self, chain: Chain) -> None:
        self.chain = chain
        move, start = chain.move, chain.start
        left, right = np.vstack([move, start]), np.hstack([move, np.zeros((3, 1))])  # also the two ends of a line
        self.sure = [max(left[a, y] + right[y, b] - left[a, O] - right[O, b] for a in range(4) for b in range(4)) for y in (B, I)]
        self.steps = [[float(x) for x in row] for row in move]
        self.clear()

    def clear(self) -> None:
        self.classes: dict[tuple, int] = {}
        self.known = _Numbers(self._token)
        self.strings: list[str] = []
        self.number: dict[str, int] = {}
        self.rows: list[tuple] = []
        self.table, self.filled = np.zeros((14, 1_024), dtype=np.int64), 0
        self.own = np.zeros((1_024, 3))
        self.memo = [(np.full(SLOTS, -1, dtype=np.int64), np.zeros((SLOTS, 3))) for _ in range(5)]
        self.bos = self._class(("^", "", "0", "none", "^", "^", "^", 0, 0, False, False, False, False, 0))
        self.eos = self._class(("$", "", "0", "none", "$", "$", "$", 0, 0, False, False, False, False, 0))

    def _str(self, s: str) -> int:
        n = self.number.get(s)
        if n is None:
            n = self.number[s] = len(self.strings)
            self.strings.append(s)
        return n

    def _class(self, c: tuple) -> int:
        n = self.classes.get(c)
        if n is None:
            n = self.classes[c] = len(self.rows)
            sh, word, z, kind, sep, two, nx, *flags = c
            self.rows.append((self._str(sh), self._str(word), int(z), _KINDS.index(kind), self._str(sep), self._str(two), self._str(nx), *map(int, flags)))
        return n

    def _token(self, t: str) -> int:
        """The class of a token not met before."""
        s = _short(t)
        sh, word, _, z = _facts(s)
        n, one = len(s), len(s) == 1
        event = 1 if s in ("=", ":") else 2 if s == ">" else 3 if s == ";" else 0
        header = _HEADERS.index(word) if word in ("bearer", "basic") else 0
        c = self._class((sh, word, z, _kind.__wrapped__(s), s if one else "w", s if n < 12 else "#", s if one else sh, _QUOTES.get(s, 0), event, n > 1 and s not in _TYPES, s.endswith("://"), sh == "host", n > 2, header))
        if n < 64:
            self.known[t] = c
        return c

    def _sync(self) -> None:
        """Rows of the classes met since the last time."""
        n = len(self.rows)
        if n > len(self.own):
            self.table = np.hstack([self.table, np.zeros((14, 2 * n - len(self.own)), dtype=np.int64)])
            self.own = np.vstack([self.own, np.zeros((2 * n - len(self.own), 3))])
        if n > self.filled:
            new = np.array(self.rows[self.filled :], dtype=np.int64)
            self.table[:, self.filled : n] = new.T
            words = [self.strings[w] for w in new[:, 1].tolist()]
            self.own[self.filled : n] = self.chain.emit[[slot(f"w={w}" if w else "w=#") for w in words]]
            self.filled = n

    def _look_up(self, which: int, key: np.ndarray, parts: tuple, names) -> np.ndarray:
        """Sums of the features that ``names`` gives for the parts, which the key stands for."""
        keys, rows = self.memo[which]
        at = (key ^ (key >> 17) ^ (key >> 37)) * 0x9E3779B1 >> 7 & SLOTS - 1
        out = rows[at]
        lost = np.flatnonzero(keys[at] != key)
        if len(lost):
            uniq, first, inverse = np.unique(key[lost], return_index=True, return_inverse=True)
            slots = [slot(f) for p in zip(*(p[lost[first]].tolist() for p in parts)) for f in names(*p)]
            new = self.chain.emit[np.array(slots).reshape(len(uniq), -1)].sum(axis=1)
            out[lost] = new[inverse]
            places = at[lost[first]]
            keys[places] = -1  # of keys that share a place, one is kept whole
            _, kept = np.unique(places, return_index=True)
            keys[places[kept]], rows[places[kept]] = uniq[kept], new[kept]
        return out

    def scores(self, lines: list[list[str]]) -> np.ndarray:
        """(tokens, labels) of the lines one after the other; every line stands for itself."""
        if max(len(self.classes), len(self.known)) > MEMO:
            self.clear()
        ids = np.array(list(map(self.known.__getitem__, itertools.chain.from_iterable(lines))))
        self._sync()
        if len(self.strings) >= 1 << 20:  # beyond the numbers that keys can hold
            return np.concatenate([self.chain.emit[x].sum(axis=1) for line in lines for x in features(list(map(_short, line)), 4_096)])
        n = len(ids)
        sizes = np.array([len(line) for line in lines])
        stop = np.cumsum(sizes)
        begin = stop - sizes
        here = np.arange(n)
        head = np.repeat(begin, sizes)

        def shift(k: int) -> np.ndarray:
            x = np.full(n, self.bos)
            x[k:] = ids[:-k] if k < n else []
            x[here - k < head] = self.bos
            return x

        table = self.table
        p1, p2 = shift(1), shift(2)
        nx = np.full(n, self.eos)
        nx[:-1] = ids[1:]
        nx[stop - 1] = self.eos
        sh, z, sep, two, sn = table[0][ids], table[2][ids], table[4][p1], table[5][p2], table[6][nx]

        def last(mask: np.ndarray) -> np.ndarray:
            """The last place to the left (not here) where the mask holds, -1 if none on the line."""
            x = np.full(n, -1)
            x[1:] = np.maximum.accumulate(np.where(mask[:-1], here[:-1], -1))
            x[x < head] = -1
            return x

        marks = table[7][ids]
        turn = np.zeros(n + 1, dtype=np.int64)
        at = np.flatnonzero(marks)
        mark, end = 0, 0  # the open quote, and where its line ends
        for i, m, e in zip(at.tolist(), marks[at].tolist(), np.repeat(stop, sizes)[at].tolist()):
            if e != end:
                if mark:
                    turn[end] -= 1
                mark, end = 0, e
            if mark == m:
                mark = 0
                turn[i + 1] -= 1
            elif not mark:
                mark = m
                turn[i + 1] += 1
        if mark:
            turn[end] -= 1
        q = np.cumsum(turn)[:-1]

        event = table[8][ids]
        name = last(table[9][ids] == 1)
        near = (name >= 0) & (name >= here - 7)
        named = ((event == 1) | (event == 2) & (p1 == self.known.get("=", -1))) & near
        named &= (table[10][ids[name]] == 0) & (table[11][p1] == 0)
        reset = (event == 3) & (q == 0)
        value = np.where(named, table[3][ids[name]], 0)
        e = last(named | reset)
        k = np.where(e >= 0, value[e], 0)
        e = last(table[12][ids] == 1)
        pk = np.where((e >= 0) & (e >= here - 3), table[3][ids[e]], 4)
        hd = url = np.zeros(n, dtype=np.int64)
        if (mask := table[13][ids] > 0).any():
            e = last(mask)
            hd = np.where(e >= 0, table[13][ids[e]], 0)
        if (mask := sh == self.number.get("scheme", -1)).any():
            e = last(mask)
            url = np.where((e >= 0) & (here - e <= 6), here - e, 0)

        S, K, Q, H = self.strings, _KINDS, "-q", _HEADERS
        out = self.own[ids].copy()
        out += self._look_up(0, (((((sh * 5 + k) * 2 + q) * 5 + pk) * 6 + z) * 3 + hd), (sh, k, q, pk, z, hd), lambda s, k, q, pk, z, hd: [f"s={S[s]}", f"s={S[s]}|k={K[k]}", f"s={S[s]}|k={K[k]}|{Q[q]}", f"s={S[s]}|pk={K[pk]}", f"s={S[s]}|z={z}|{Q[q]}", f"hd={H[hd]}|s={S[s]}", f"k={K[k]}|z={z}|s={S[s]}", "bias"])
        near_key = (sep << 40) + (sn << 20) + sh
        out += self._look_up(1, near_key * 8 + url, (sep, sn, sh, url), lambda p, x, s, u: [f"p1={S[p]}|s={S[s]}", f"nx={S[x]}|s={S[s]}|{S[p]}", f"url={u}|{S[p]}|{S[x] if len(S[x]) == 1 else 'w'}|s={S[s]}"])
        w1, s1 = table[1][p1], table[0][p1]
        out += self._look_up(2, (w1 << 40) + (s1 << 20) + sh, (w1, s1, sh), lambda w, p, s: [f"w1={S[w]}|s={S[s]}", f"s1={S[p]}|s={S[s]}"])
        out += self._look_up(3, (two << 40) + (sep << 20) + sh, (two, sep, sh), lambda t, p, s: [f"p2={S[t]}|{S[p]}|s={S[s]}"])
        out += self._look_up(4, ((q * 5 + k) << 20) + sep, (q, sep, k), lambda q, p, k: [f"q={Q[q]}|{S[p]}|k={K[k]}"])
        return out

    def labels(self, lines: list[list[str]]) -> list[np.ndarray | None]:
        """Best labels of every line, None if all are O.

        A token whose score for O leads by more than any transitions can give back is O on every best path; only the runs between such tokens are searched.
        """
        score = self.scores(lines)
        lead = score[:, O, None] - score[:, 1:]
        unsure = np.flatnonzero((lead <= np.array(self.sure) + 1e-9).any(axis=1))
        out: list[np.ndarray | None] = [None] * len(lines)
        if not len(unsure):
            return out
        stop = np.cumsum([len(line) for line in lines])
        owner = np.searchsorted(stop, unsure, "right")
        cut = np.flatnonzero((np.diff(unsure) > 1) | (np.diff(owner) > 0)) + 1
        for run, line in zip(np.split(unsure, cut), owner[np.concatenate([[0], cut])].tolist()):
            a, b, size = int(run[0]), int(run[-1]) + 1, len(lines[line])
            begin = int(stop[line]) - size
            best = self._best(score[a:b].tolist(), a == begin, b == begin + size)
            if B in best:
                if out[line] is None:
                    out[line] = np.zeros(size, dtype=np.int64)
                out[line][a - begin : b - begin] = best
        return out

    def _best(self, score: list[list[float]], first: bool, last: bool) -> list[int]:
        """Best labels of a run that stands between two O, or at an end of its line."""
        move = self.steps
        x, y, z = self.chain.start.tolist() if first else move[O]
        x, y, z = x + score[0][0], y + score[0][1], z + score[0][2]
        back = []
        for s in score[1:]:
            new, came = [], []
            for c in range(3):
                u, v, w = x + move[0][c], y + move[1][c], z + move[2][c]
                if u >= v and u >= w:
                    new.append(u + s[c])
                    came.append(0)
                elif v >= w:
                    new.append(v + s[c])
                    came.append(1)
                else:
                    new.append(w + s[c])
                    came.append(2)
            x, y, z = new
            back.append(came)
        if not last:
            x, y, z = x + move[0][O], y + move[1][O], z + move[2][O]
        path = [0 if x >= y and x >= z else 1 if y >= z else 2]
        for came in reversed(back):
            path.append(came[path[-1]])
        return path[::-1]


_FIELD: dict[bytes, Field] = {}


def _field(chain: Chain) -> Field:
    """The field of these weights; the last one is kept, so that the tasks of one worker share its tables."""
    key = hashlib.sha1(chain.emit.tobytes() + chain.move.tobytes() + chain.start.tobytes()).digest()
    if key not in _FIELD:
        for old in _FIELD.values():
            old.known.ask = None  # else the two keep each other in memory
        _FIELD.clear()
        _FIELD[key] = Field(chain)
    return _FIELD[key]


def _values(line: str, labels: np.ndarray) -> list[tuple[int, int]]:
    """Values in one line, whole, by the labels of its tokens."""
    found = [m.span() for m in _TOKEN.finditer(line)]
    out, i = [], 0
    while i < len(found):
        if labels[i] == B:
            j = i + 1
            while j < len(found) and labels[j] == I and found[j][0] <= found[j - 1][1] + 1:
                j += 1
            s, e = found[i][0], found[j - 1][1]
            value = line[s:e].rstrip("\"'`,;)")
            if _credible(value) and not _denied(line[:s], value) and not (_NAME.fullmatch(value) and _ASSIGNED.match(line, s + len(value))):
                out.append((s, s + len(value)))
            i = j
        else:
            i += 1
    return out


def _lines(text: str) -> Iterator[tuple[int, str]]:
    """(start, line) of every line; a key block makes the lines that it covers one."""
    blocks = [m.span() for m in _BLOCK.finditer(text)] if "-----BEGIN " in text else []
    at, k = 0, 0
    while k < len(blocks):
        begin, end = blocks[k]
        begin, end = max(at, text.rfind("\n", 0, begin) + 1), text.find("\n", end)
        end = len(text) if end < 0 else end
        if at < begin:
            for line in text[at : begin - 1].split("\n"):
                yield at, line
                at += len(line) + 1
        while k < len(blocks) and blocks[k][0] < end:  # blocks that begin on the last of these lines
            if blocks[k][1] > end:
                end = text.find("\n", blocks[k][1])
                end = len(text) if end < 0 else end
            k += 1
        yield begin, text[begin:end]
        at = end + 1
    if at < len(text):
        for line in text[at:].split("\n"):
            yield at, line
            at += len(line) + 1


def spans_of(texts: list[str], chain: Chain) -> list[list[tuple[int, int]]]:
    """Character spans of the credential values of each text: every line of it is decoded by the field."""
    field, out = _field(chain), [[] for _ in texts]
    places, lines, size = [], [], 0

    def decode() -> None:
        if lines:
            for (n, at, line), labels in zip(places, field.labels(lines)):
                if labels is not None:
                    out[n] += [(at + s, at + e) for s, e in _values(line, labels)]

    for n, text in enumerate(texts):
        for at, line in _lines(text):
            tokens = _TOKEN.findall(line)
            if tokens:
                places.append((n, at, line))
                lines.append(tokens)
                size += len(line)
                if size >= CHUNK:
                    decode()
                    places, lines, size = [], [], 0
    decode()
    return out


def spans(text: str, chain: Chain, code: bool = False) -> list[tuple[int, int]]:
    """Character spans of credential values; spans of one divided value follow each other on a line or the next. ``code`` changes nothing: every line of every kind of file is decoded."""
    return spans_of([text], chain)[0]


_JOIN = re.compile(r"[\"'`]?\s*(?:[+.\\]|\)?\s*)?\s*[\"'`]?")


def start_lines(text: str, found: list[tuple[int, int]]) -> list[int]:
    """Lines on which a value starts; a literal that only goes on with the one before it starts nothing."""
    out, last = [], None
    for s, e in found:
        if last is not None and "\n" in text[last:s] and re.fullmatch(r"[\"'`]\s*(?:[+.\\]\s*)?(?:\\\s*)?[\"'`]", text[last:s]):
            last = e
            continue
        out.append(text.count("\n", 0, s) + 1)
        last = e
    return out


def mask(text: str, found: list[tuple[int, int]], char: str = "*") -> str:
    """The text with the values' characters masked; a key block keeps its frame and line ends."""
    parts, at = [], 0
    for s, e in found:
        if s < at:
            continue
        value = text[s:e]
        if value.startswith("-----BEGIN"):
            head = value.index("-----", 10) + 5
            tail = value.rfind("-----END")
            tail = len(value) if tail < 0 else tail
            value = value[:head] + re.sub(r"[A-Za-z0-9+/=]{4,}", lambda m: char * len(m[0]), value[head:tail]) + value[tail:]
        else:
            value = re.sub(r"\w|[^\w\s]", char, value)
        parts += [text[at:s], value]
        at = e
    return "".join([*parts, text[at:]])


def _runner(id_col: str, kind: str, masked: bool):
    names = [id_col, "line_no"] if not masked else [id_col, "n_credentials", "line_nos", "masked_text"]

    def run_with(chain_parts):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys, rows, move, start = chain_parts
            chain = Chain(3, move=move, start=start)
            chain.emit[keys] = rows
            for b in batches:
                ids, lines, texts, counts = [], [], [], []
                whole = b.column(1).to_pylist()
                for rid, text, found in zip(b.column(0).to_pylist(), whole, spans_of(whole, chain)):
                    at = start_lines(text, found)
                    if masked:
                        ids.append(rid)
                        counts.append(len(at))
                        lines.append(sorted(set(at)))
                        texts.append(mask(text, found))
                    else:
                        for n in sorted(set(at)):
                            ids.append(rid)
                            lines.append(n)
                idc = pa.array(ids, b.schema.field(0).type)
                if masked:
                    yield pa.RecordBatch.from_arrays([idc, pa.array(counts, pa.int32()), pa.array(lines, pa.list_(pa.int64())), pa.array(texts, pa.string())], names)
                else:
                    yield pa.RecordBatch.from_arrays([idc, pa.array(lines, pa.int64())], names)

        return run

    return run_with


def _parts():
    chain = model()
    keys = np.flatnonzero(np.abs(chain.emit).sum(axis=1) > 0)
    return keys, chain.emit[keys], chain.move, chain.start


def find(files: DataFrame, id_col: str = "file_id", text_col: str = "raw_content") -> DataFrame:
    """(id, line_no) of every line on which a credential's value starts."""
    kind = dict(files.dtypes)[id_col]
    base = files.select(id_col, text_col).where(F.length(text_col) > 0)
    return base.mapInArrow(_runner(id_col, kind, False)(_parts()), f"{id_col} {kind}, line_no bigint").distinct()


def redact(files: DataFrame, id_col: str = "file_id", text_col: str = "raw_content") -> DataFrame:
    """(id, n_credentials, line_nos, masked_text) of every row that holds one; rows without keep their text."""
    kind = dict(files.dtypes)[id_col]
    base = files.select(id_col, text_col).where(F.length(text_col) > 0)
    return base.mapInArrow(_runner(id_col, kind, True)(_parts()), f"{id_col} {kind}, n_credentials int, line_nos array<bigint>, masked_text string").where("n_credentials > 0")
