"""Small grammars that tell whether a text is a program of a language.

A text is cut into tokens by one regular expression; every token becomes one character of a short alphabet, and the
grammar's productions are applied bottom-up as substitutions on that string until nothing changes. The text parses if the
string reduces to a sequence of statements. All heavy work is done by the regular expression engine, so a file
takes about a millisecond. Python itself is parsed with :mod:`ast`.

Alphabet: a operand; o binary operator; p + and -; m * and &; u prefix operator; i ++ and --; = assignment; < and >; ~ fat arrow;
t thin arrow; I if-like; L for-like; e else; T try; H catch; Y finally; d do; r return; k break; v variable keyword; f function keyword;
c type keyword; P import-like; W case; S statement; B block; Q type after a colon; ! nothing that a grammar knows.
"""

import ast
import io
import re
import tokenize
import warnings
from functools import lru_cache

_NUMBER = r"(?:0[xX][0-9a-fA-F_]+[uUlL]*|0[bB][01_]+|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?\d+)?(?:[uUlLfFdDn]+|[iu](?:8|16|32|64|size)|f(?:32|64))?)"
_DQ, _SQ = r'"(?:[^"\\\n]|\\(?:.|\n))*"', r"'(?:[^'\\\n]|\\(?:.|\n))*'"
_NAME = r"[^\W\d]\w*"
_OPS = r"<<=|>>=|>>>=?|\*\*=?|\.\.\.|\.\.=|===|!==|\?\?=?|\?\.|<=>|&&=|\|\|=|<=|>=|==|!=|=~|!~|&&|\|\||\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|:=|::|->|=>|<-|<<|&\^|\.\.|\S"


class Grammar:
    """Tokens, their classes and the productions of one language."""

    def __init__(self, comments: str, strings: str, name: str, keywords: dict[str, str], ops: dict[str, str], rules: list, newline: str = "", goal: str = "[SB]*", prepare: list = (), number: str = _NUMBER, errors: str = "", deleted: set[str] = frozenset()) -> None:
        self.token = re.compile(rf"(?:{comments})|(?:{strings})|{number}(?!\w)|{name}|{_OPS}" + (r"|\n" if newline else ""), re.S)
        self.skip = re.compile(comments, re.S)
        self.known = {k: v for v, ks in keywords.items() for k in ks.split()}
        self.ops = {
            **dict.fromkeys("( ) [ ] { } , ; : ? . < >".split(), None), **dict.fromkeys("/ % ^ | == != <= >= && || << >>".split(), "o"),
            **dict.fromkeys("+ -".split(), "p"), **dict.fromkeys("* &".split(), "m"), **dict.fromkeys("! ~".split(), "u"), **dict.fromkeys("++ --".split(), "i"),
            **dict.fromkeys("= += -= *= /= %= &= |= ^= <<= >>=".split(), "="), **ops,
        }
        self.deleted = deleted
        self.newline = newline
        self.errors = re.compile(errors, re.M) if errors else None
        self.prepare = [(re.compile(p), r) for p, r in prepare]
        self.rules = [(re.compile(p), r) for p, r in rules]
        self.goal = re.compile(goal)
        self.memo: dict[str, str] = {}

    def _class(self, tok: str) -> str:
        if tok in self.deleted:
            return ""
        if tok == "\n":
            return tok
        if tok in self.known:
            return self.known[tok]
        if tok in self.ops:
            return self.ops[tok] or tok
        first = tok[0]
        if len(tok) > 1 and self.skip.fullmatch(tok):
            return "\n" if self.newline and "\n" in tok else ""
        if first.isalnum() or first == "_" or first in "$@\"'`" and len(tok) > 1 or len(tok) > 2:
            return "a"
        return "!"

    def classes(self, text: str) -> str:
        memo, out = self.memo, []
        if len(memo) > 50_000:
            memo.clear()
        for tok in self.token.findall(text):
            c = memo.get(tok)
            if c is None:
                c = memo[tok] = self._class(tok)
            out.append(c)
        return "".join(out)

    def parses(self, text: str) -> bool:
        if self.errors and self.errors.search(text):
            return False
        s = self.classes(text)
        for p, r in self.prepare:
            s = p.sub(r, s)
        if "!" in s:
            return False
        seen = {s}
        while True:  # until nothing changes; a round that does not shorten the text may not come back to an earlier one
            before = s
            for p, r in self.rules:
                s = p.sub(r, s)
            if len(s) < len(before):
                seen = {s}
            elif s in seen:
                break
            else:
                seen.add(s)
        return bool(self.goal.fullmatch(s))


_C_COMMENTS = r"//[^\n]*|/\*.*?\*/"
#: What may not follow an operand that is taken as complete.
_END = r"(?![\(\[\.ai])"
_BEFORE = r"(?<![a\)\]\.])"
_ARG = r"(?:\.{3})?a(?:[:=~]a)?"
_EXPR = [
    (r"(?<=a)\.[a-zA-Z]", ""),
    (rf"(?<!f)a\((?:{_ARG}(?:,{_ARG})*,?)?\)", "a"),
    (r"a\[(?:a?(?::a?)?)\]", "a"),
    (rf"{_BEFORE}\[(?:{_ARG}(?:,+{_ARG})*,?)?\]", "a"),
    (r"(?<![a\)\]\.IHLf])\(a\)", "a"),
    (rf"{_BEFORE}[upm]+a{_END}", "a"),
    (r"ai(?!a)|(?<!a)ia" + _END, "a"),
    (rf"a[opm<>]a{_END}", "a"),
    (r"a\?a:a(?![\(\[\.aiopm<>?])", "a"),
]
#: Where a type may stand before a name, two operands in a row are the head of a definition and no call.
_TYPED_EXPR = [_EXPR[0], (_EXPR[1][0].replace("(?<!f)", "(?<![fa])(?<!am)"), "a"), *_EXPR[2:]]
_START = r"(?<![^;{}SBed):])"
_FLOW = [
    (r"I\(a\)[SB]e[SB]", "S"), (r"I\(a\)[SB](?!e)", "S"), (r"d[SB]I\(a\);", "S"),
    (r"T(?:\((?:[^(){}]*)\))?B(?:H(?:\([^(){}]*\))?B)*(?:YB)?(?!H|Y)", "S"),
    (r"ra?;|ka?;", "S"),
    (r"L\([^(){};]*;[^(){};]*;[^(){};]*\)[SB]", "S"),
    (r"W(?:a|\()?:", ""), (r"(?<=[{SB])a:(?=[SILrkaTvfc])", ""),
]
_BLOCK = (r"\{[SB]*\}", "B")


def _javascript(types: bool) -> Grammar:
    obj = r"\{(?:(?:a|\.{3}a|a:a|[a-zA-Z]:a|(?:[a-zA-Z]|a)\((?:[^(){}]*)\)B)(?:,(?:a|\.{3}a|a:a|[a-zA-Z]:a))*,?)?\}"
    param = r"(?:\.{3})?a(?:\?)?(?::Q)?(?:=a)?"
    rules = [
        *([(r"a<a(?:,a)*>(?=\(|[,;:={\)>\[])", "a"), (r":(?:u(?![a\(])|u?a(?:\[\])?(?:[o]a(?:\[\])?)*)(?=[,\)={;>~B])(?<!\?a:a)", ":Q"), (r"(?<=[a\)?]):\{(?:a\??:Q[;,]?)*\}(?=[,\)={;~])", ":Q"), (r"\):Q(?=[{B;~])", ")"), (r"(?<=[;{}SB])a\(\)B", "S"), (r"(?<=v)a:Q(?==)", "a"), (r"(?<=va):Q(?=;)", ""), (r"(?:cA|A)a=a(?:o?a)*;", "S")] if types else []),
        (rf"(?<=[=\(,\[:?~ropu])" + obj, "a"), (r"(?<=[=\(,\[:?~ro])B", "a"),
        (rf"f(?:m)?a?\((?:{param}(?:,{param})*,?)?\)B(?=[,;\)\]}}:.(])(?<![;SB]B)", "a"),
        (rf"(?<=[=\(,\[:?~roupmN])f(?:m)?a?\((?:{param}(?:,{param})*,?)?\)B", "a"),
        (rf"(?:\((?:{param}(?:,{param})*,?)?\)|a)~(?:B|a(?![\(\[\.opm<>?ai]))", "a"),
        *_TYPED_EXPR, (r"a=a(?=[,\)\]:]|=|[;}])(?<!va=a)(?<!,a=a)", "a"),
        (rf"(?:f|(?<=[;{{}}SB]))(?:m)?a\((?:{param}(?:,{param})*,?)?\)B", "S"),
        (rf"f(?:m)?a\((?:{param}(?:,{param})*,?)?\)B", "S"), (r"f(?:m)?a\((?:a(?::Q)?(?:,a(?::Q)?)*,?)?\)(?::Q)?;", "S"),
        (r"v(?:a|\{[a:,]*\})(?:=a)?(?:,a(?:=a)?)*;", "S"), (r"v(?:a|\{[a:,]*\})(?:=a)?(?:,a(?:=a)?)*(?=\})", "S"),
        (r"L\(v?(?:a|\{[a,:]*\})\)[SB]", "S"), (r"L\((?:v?a(?:=a)?(?:,a(?:=a)?)*)?;a?;(?:a(?:,a)*)?\)[SB]", "S"), (r"L\(S(?:a?;|S)(?:a(?:,a)*)?\)[SB]", "S"),
        (r"ca(?:xa(?:,a)*)*(?:\{(?:[SB;]|a\??(?::Q)?(?:=a)?;)*\}|B)", "S"),
        (r"P(?:a|m)?,?(?:\{(?:a(?:oa)?,?)*\}|a)?(?:oa)?(?:Fa)?;", "S"), (r"P\{(?:a(?:oa)?,?)*\}(?:Fa)?;", "S"), (r"E(?:a|\{(?:a,?)*\}|m)(?:Fa)?;", "S"), (r"E(?=[SBvfc])", ""),
        (r"(?<=[{SB;])aB", "S"), *_FLOW, (rf"{_START}a(?:,a)*;", "S"), (r"(?<=[;{SB])a(?:,a)*(?=\})", "S"), (r"ra(?=\})", "S"), (r"(?<=[;{S]);|(?<=[;{S]B);", ""), _BLOCK, (r"(?<=[;{}SB])a;", "S"),
    ]
    kw = {
        "I": "if while switch with", "L": "for", "e": "else", "T": "try", "H": "catch", "Y": "finally", "d": "do", "r": "return throw", "k": "break continue debugger", "v": "var let const",
        "f": "function", "c": "class interface enum namespace" if types else "class", "x": "extends implements", "u": "typeof new await delete void yield keyof", "o": "in of instanceof as", "P": "import", "F": "from", "W": "case default", "E": "export",
    }
    if types:
        kw["A"] = "type"
    gone = {"async", "static", "readonly", "private", "public", "protected", "abstract", "declare"} if types else {"async", "static"}
    strings = rf"`(?:[^`\\]|\\.)*`|{_DQ}|{_SQ}|(?<=[=(,:?!&|\[;{{])\s*/(?![/*\s])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*"
    prepare = [
        (r"(?<=[a\)\]\}ki])\n+(?=[avrILfcTdkPESWB\}])", ";"), (r"\n", ""), (r"Ea?(?=W)", "E"), (r"EW(?!:)", "E"), (r"(?<=[\)a])\?\.", "."), (r"\};(?=[eHY])", "}"), (r"(?<=\));(?=\{)", ""), (r";\}", ";}"), (r"\A", ";"),
    ]
    return Grammar(
        _C_COMMENTS, strings, r"[#@]?[^\W\d$]?[\w$]+", kw, {"===": "o", "!==": "o", "**": "o", "??": "o", ">>>": "o", "=>": "~", "?.": ".", "...": "...", "&&=": "=", "||=": "=", "??=": "="}, rules,
        newline="\n", prepare=prepare, goal="[;SB]*", deleted=gone,
    )


_TYPE = r"a(?:\[\])*[mo]*"


def _java() -> Grammar:
    param = r"(?:aa|a\[\]a|a\.{3}a)"
    rules = [
        (r"a<(?:a(?:xa)?(?:,a)*)?>(?=[a(){},;.:>\[~]|$)", "a"), (r"@a(?:\((?:[a=,{}]*)\))?", ""),
        *_TYPED_EXPR, (r"a\[\]\{[a,]*\}", "a"), (r"(?<==)\{[a,]*\}", "a"), (r"u?a\(\)B(?=[;,\)])", "a"), (r"(?:\((?:a|aa|v a)?(?:,a|,aa)*\)|a)t(?:B|a(?=[,;\)]))", "a"), (r"a=a(?=[\)\],=])", "a"),
        (r"(?:aa|va|a\[\]a)(?:=a)?(?:,a(?:=a)?)*;", "S"), (rf"(?:a\[\]a|aa|a|va)\((?:{param}(?:,{param})*)?\)(?:xa(?:,a)*)?(?:B|;)(?<!\)(?=;))", "S"),
        (rf"(?:aa|va|a\[\]a)\((?:{param}(?:,{param})*)?\)(?:xa(?:,a)*)?(?:B|;)", "S"), (r"aa(?=\(\)(?:xa(?:,a)*)?B)", "Z"), (r"Z\(\)(?:xa(?:,a)*)?B", "S"), (rf"a\({param}(?:,{param})*\)(?:xa(?:,a)*)?B", "S"), (r"(?<=[{SB;])a(?:xa(?:,a)*)?B", "S"),
        (r"L\((?:va|aa):a\)[SB]", "S"), (r"L\((?:S|;)(?:a?;|S)(?:a(?:,a)*)?\)[SB]", "S"), (r"c(?:a)(?:\((?:aa,?)*\))?(?:xa(?:,a)*)*B", "S"), (r"P(?:a|m)(?:\.m)?;|Pa\.?m?;", "S"),
        *_FLOW, (rf"{_START}a=a;|(?<=[{{}}SB;])a;", "S"), (r"(?<=[SB{};])a=a;", "S"), (r"(?<=[;{}SB]);", ""), _BLOCK,
    ]
    kw = {"I": "if while switch synchronized", "L": "for", "e": "else", "T": "try", "H": "catch", "Y": "finally", "d": "do", "r": "return throw", "k": "break continue", "v": "var", "c": "class interface enum", "x": "extends implements throws", "u": "new", "o": "instanceof", "P": "import package", "W": "case default"}
    gone = set("public private protected static final abstract native transient volatile strictfp sealed".split())
    return Grammar(_C_COMMENTS, rf'"""(?:[^"\\]|\\.|"(?!""))*"""|{_DQ}|{_SQ}', _NAME, kw, {"->": "t", "::": ".", ">>>": "o", "@": "@", "...": "..."}, rules, prepare=[(r"\A", ";")], goal="[;SB]*", deleted=gone)


def _go() -> Grammar:
    param = r"(?:a(?:(?:,a)*(?:\.{3})?[mQ]*a)?|aQ|Q)"
    rules = [
        (r"Ca|\[\]a(?=[,\){;}a])", "a"), (r"(?<=[\(,a])\[[a]?\][m]*a", "a"), (r"[m]a(?=[,\)])(?<=[a\)(,][m]a)", "a"), (r"c?D\[a\]m*a", "a"), (r"cB|D\{\}", "a"),
        *_EXPR, (r"(?<=[=(,:r\[])a\{(?:a(?::a)?(?:,a(?::a)?)*,?;?)?\}", "a"), (r"(?<=[=(,:r\[{])\{(?:a(?::a)?(?:,a(?::a)?)*,?;?)?\}", "a"),
        (rf"(?<=[=(,:rG])f\((?:{param}(?:,{param})*)?\)(?:a|\([a,]*\))?B", "a"),
        (rf"f(?:\(am?a\))?a\((?:{param}(?:,{param})*,?)?\)(?:m*a|\((?:[ma,]*)\))?B", "S"),
        (r"Iv?(?:a(?:,a)*=a(?:,a)*;)?aB(?:e(?:S|B))?(?!e)", "S"), (r"L(?:a?|(?:a(?:,a)*=)?u?a|(?:S|;)a?;(?:a|a=a|ai)?|a=a;a;a(?:=a)?)B", "S"), (r"XaB|XB", "S"),
        (r"P(?:a|a?a);", "S"), (r"P\((?:a;?|aa;?|S)*\)", "S"), (r"va(?:,a)*(?:a)?(?:=a(?:,a)*)?;", "S"), (r"v\((?:a(?:a)?(?:=a)?;?)*\)", "S"), (r"ca?a\{(?:a(?:,a)*m?a?a?;?)*\};?", "S"), (r"ca[ma]+;", "S"),
        (r"ra?(?:,a)*;|ka?;", "S"), (r"Ga;", "S"), (r"Wa?(?:,a)*:", ""), (r"(?<=[;{}SB])a(?:,a)*=a(?:,a)*;", "S"), (r"(?<=[;{}SB])a;", "S"), (r"(?<=[;{}SB]);", ""), _BLOCK,
        (r"(?<=[;{SB])a(?:,a)*=a(?:,a)*(?=\})", "S"), (r"(?<=[;{SB])a(?=\})", "S"), (r"ra?(?:,a)*(?=\})", "S"),
    ]
    kw = {"I": "if", "X": "switch select", "L": "for", "e": "else", "r": "return", "k": "break continue fallthrough goto", "v": "var const", "f": "func", "c": "type", "C": "chan", "D": "map", "G": "go defer", "u": "range", "P": "import package", "W": "case default"}
    prepare = [(r"(?<=[a\)\]\}kri])\n+", ";"), (r"\n", ""), (r";(?=\))", ""), (r"\A", ";"), (r"\}$", "};"), (r"\};(?=e)", "}"), (r"(?<=,);", ""), (r"c(?=a[{])", "c")]
    return Grammar(_C_COMMENTS, rf"`[^`]*`|{_DQ}|{_SQ}", _NAME, kw, {":=": "=", "<-": "p", "&^": "o", "...": "..."}, rules, newline="\n", prepare=prepare, goal=r"[;SB]*")


def _cpp() -> Grammar:
    param = r"(?:a+[m]*a?(?:\[a?\])?(?:=a)?|a)"
    rules = [
        (r"a<(?:a[m]*(?:,a[m]*)*)?>(?=[a(){},;.:>m\[])", "a"),
        *_TYPED_EXPR, (r"(?<=[=(,r])\{(?:a(?:,a)*,?)?\}", "a"), (r"(?<=[{,])\{(?:a(?:,a)*,?)?\}(?=[,}])", "a"), (rf"\[[am,=]*\](?:\((?:{param}(?:,{param})*)?\))?(?:ta)?B", "a"), (r"a=a(?=[\),=])", "a"),
        (r"L\((?:va|vma|aa):a\)[SB]", "S"), (r"L\((?:S|;)(?:a?;|S)(?:a(?:,a)*)?\)[SB]", "S"),
        (rf"(?:a[m]*){{1,3}}a\((?:{param}(?:,{param})*)?\)(?:a)?(?::a(?:,a)*)?B", "S"), (rf"(?:a[m]*){{1,3}}a(?:\((?:{param}(?:,{param})*)?\))?(?:a)?;", "S"), (r"(?:a[m]*)+a(?:=a)?(?:,[m]*a(?:=a)?)*;", "S"), (r"(?:a[m]*)+a\[a?\](?:=a)?;", "S"), (r"a[m]*a\[\]=a;", "S"),
        (r"(?<=a)m(?=a)", ""), (r"a{2,4}=a;|va(?:=a)?;|vma=a;", "S"), (r"a{2,4}(?:\(\))?B", "S"), (rf"a{{1,3}}\((?:{param}(?:,{param})*)?\)B", "S"),
        (r"ca?(?::a+(?:,a+)*)?B;?|ca;", "S"), (r"c?Na?B|Ua+(?:=a)?;|Uca;", "S"), (r"M:", ""),
        *_FLOW, (rf"{_START}a=a;", "S"), (r"(?<=[SB{};])a(?:=a)?;", "S"), (r"(?<=[;{}SB]);", ""), _BLOCK,
    ]
    kw = {"I": "if while switch", "L": "for", "e": "else", "T": "try", "H": "catch", "d": "do", "r": "return throw", "k": "break continue goto", "v": "auto", "c": "class struct enum union", "N": "namespace", "U": "using typedef", "M": "public private protected", "u": "new delete sizeof", "W": "case default"}
    gone = set("const static inline constexpr virtual extern explicit mutable volatile friend override noexcept unsigned signed template".split())
    comments = _C_COMMENTS + r"|#[ \t]*(?:include[ \t]*(?:\"[^\"\n]*\"|<[^>\n]*>)|define|if|ifdef|ifndef|endif|else|elif|pragma|undef|error)[^\n]*"
    return Grammar(comments, rf"{_DQ}|{_SQ}", _NAME, kw, {"->": ".", "::": ".", "...": "..."}, rules, prepare=[(r"\A", ";"), (r"(?<![a\)])\.a", "a"), (r"(?<=a)m+(?=a[=;,\)\[(])(?<=[;{}SB(,]am)", "")], goal="[;SB]*", deleted=gone)


def _rust() -> Grammar:
    param = r"(?:m?u?a(?::[mu]*a(?:\[a?\])?)?)"
    rules = [
        (r"a<[am,]*>(?=[a(){},;.:>=\[]|t|$)", "a"), (r"m(?=a[,;={\)>])(?<=[:(,t<]m)", ""),
        *_EXPR, (r"a=a(?=[,\)])", "a"), (r"(?<=[=(,r:~{;SB])a\{(?:a(?::a)?(?:,a(?::a)?)*,?)?\}(?=[;,)}.])", "a"),
        (r"(?<=[=(,r])I", "J"), (r"JaBeB", "a"), (r"(?:(?<=[=(,])|(?<=[=(,]q))o(?:a(?::a)?(?:,a(?::a)?)*)?o(?:B|a(?=[,\);]))", "a"), (r"(?<=[=])XaR", "a"),
        (rf"fa\((?:{param}(?:,{param})*,?)?\)(?:t[mu]*a)?(?:w[^{{}}]*)?(?:B|;)", "S"), (r"(?:Iv?a(?:=a)?|LaoaB|Lva|L)(?=B)B(?:e[SB])?(?!e)", "S"), (r"La(?:oa)?B|LB", "S"), (r"LaoaB|La?B", "S"), (r"IB", "S"),
        (r"v[mu]*a(?::[mu]*a)?(?:=a)?(?:eB)?;", "S"), (r"P[a.m]*(?:\{[a,.]*\})?;", "S"), (r"P(?:a\.)?\{(?:a,?)*\};", "S"), (r"(?:ca(?::a)?|Ga(?:La)?)(?:\{(?:a:[mu]*a,?)*\}|\{(?:a(?:\([a,]*\))?,?)*\}|B|;)", "S"), (r"ca\([a,]*\);", "S"), (r"ca(?::[mu]*a)?=a;", "S"),
        (r"a~(?:B,?|a,)", "R"), (r"\{R+(?:a~a)?\}", "R"), (r"XaR", "S"), (r"ra?;|ka?;", "S"), (r"(?<=[;{}SB])a(?:=a)?;", "S"), (r"(?<=[;{SB])a(?=\})", "S"), (r"ra(?=\})", "S"), (r"(?<=[;{}SB]);", ""), (r"(?<=[SB{};])Ga?B", "S"), _BLOCK,
    ]
    kw = {"I": "if while", "X": "match", "L": "for loop", "e": "else", "r": "return", "k": "break continue", "v": "let", "f": "fn", "c": "struct enum trait type const static union", "G": "impl mod", "o": "in as", "P": "use extern", "w": "where"}
    gone = {"pub", "mut", "unsafe", "async", "move", "ref", "dyn", "await"}
    comments = _C_COMMENTS + r"|#!?\[[^\]\n]*\]"
    prepare = [(r"\A", ";"), (r"(?<=a)u(?=[\(\[\{])", ""), (r"(?<=a)\?(?=[;.,\)])", "")]
    return Grammar(comments, rf"r#*\"[^\"]*\"#*|b?{_DQ}|b?'(?:[^'\\\n]|\\[^\n]+?)'|'[a-z_]\w*(?!')", _NAME, kw, {"->": "t", "::": ".", "=>": "~", "..": "o", "..=": "o", "|": "o"}, rules, prepare=prepare, goal="[;SB]*", deleted=gone)


def _php() -> Grammar:
    param = r"(?:\??a)?m?(?:\.{3})?a(?:=a)?"
    rules = [
        *_EXPR, (r"a=a(?=[,\)=;])(?<=[(,=]a=a)", "a"), (r"(?<=[=(,\[r~])\[(?:a(?:~a)?(?:,a(?:~a)?)*,?)?\]", "a"), (r"a~a(?=[,\]\)])", "a"), (rf"(?<=[=(,r])f\((?:{param}(?:,{param})*)?\)(?:U\(m?a(?:,m?a)*\))?(?::\??a)?B", "a"), (rf"f\((?:{param}(?:,{param})*)?\)~a(?=[,;\)])", "a"),
        (rf"fm?a\((?:{param}(?:,{param})*,?)?\)(?::\??a)?(?:B|;)", "S"), (r"L\(a(?:~a)?\)[SB]", "S"), (r"L\(a(?:=a)?;a?;(?:a(?:=a)?)?\)[SB]", "S"), (r"ca(?:xa(?:,a)*)*B", "S"), (r"[PU]a?(?:,a)*(?:oa)?;", "S"), (r"UB|PaB", "S"), (r"va?(?:a)?(?:=a)?;", "S"), (r"(?<=[{SB;])aa(?:=a)?;", "S"),
        *_FLOW, (r"(?<=[;{}SB])a(?:=a)?;", "S"), (r"(?<=[;{}SB]);", ""), _BLOCK,
    ]
    kw = {"I": "if while switch elseif", "L": "for foreach", "e": "else", "T": "try", "H": "catch", "Y": "finally", "d": "do", "r": "return throw", "k": "break continue", "v": "const global var", "f": "function fn", "c": "class interface trait", "x": "extends implements", "u": "new clone print", "o": "instanceof as and or xor insteadof", "P": "require require_once include include_once echo namespace", "U": "use", "W": "case default"}
    gone = {"public", "private", "protected", "static", "final", "abstract", "readonly"}
    prepare = [(r"\A(?:a!!)?O", ";"), (r"K\n*\Z", ""), (r"I(?=\(a\)B?)", "I"), (r"eI", "eI")]
    return Grammar(r"//[^\n]*|#(?!\[)[^\n]*|/\*.*?\*/", rf"{_DQ}|'(?:[^'\\]|\\.)*'", r"\$*[^\W\d]\w*|<\?php|<\?=|\?>", {**kw, "O": "<?php", "K": "?>"}, {"->": ".", "::": ".", "=>": "~", ".": "o", "===": "o", "!==": "o", "??": "o", "<=>": "o", ".=": "=", "\\": ".", "@": "u", "**": "o", "...": "...", "??=": "="}, rules, prepare=prepare, errors=r"\A(?!\s*(?:ï»¿|﻿)?<\?php)", goal="[;SB]*", deleted=gone)


def _ruby() -> Grammar:
    arg = r"(?:[m]{0,2}a(?:[~:=]a)?|a:)"
    nl = r"[\n;]"
    rules = [
        (r"(?<=a)\.[a-zA-Z]", ""), (rf"a\((?:\n*{arg}(?:,\n*{arg})*,?\n*)?\)", "a"), (r"a\[(?:a(?:,a)*)?\]", "a"), (rf"{_BEFORE}\[\n*(?:{arg}(?:,\n*{arg})*,?\n*)?\]", "a"), (rf"{_BEFORE}\(a\)", "a"), (rf"{_BEFORE}\{{\n*(?:{arg}(?:,\n*{arg})*,?\n*)?\}}", "a"),
        (r"(?<![a\)\]])[upm]a(?![\(\[\.])", "a"), (r"a[opm<>]\n*a(?![\(\[\.])", "a"), (r"a\?a:a(?![\(\[\.opm])", "a"),
        (rf"a\{{(?:O[a,]*O)?(?:a|{nl}*S*a?{nl}*)\}}", "a"), (rf"ad(?:O[a,m]*O)?{nl}+S*E", "a"), (rf"(?<=[\nSB;=])[IX]a(?:h)?{nl}+S*(?:G(?:a)?(?:h)?{nl}+S*)*(?:e{nl}+S*)?E", "a"), (rf"X(?:{nl}+|a{nl}+)(?:Wa(?:,a)*(?:h)?{nl}+S*)+(?:e{nl}+S*)?E", "a"),
        (rf"T{nl}+S*(?:H[a,~]*{nl}+S*)*(?:e{nl}+S*)?(?:Y{nl}+S*)?E", "a"), (rf"[LI]a(?:oa)?d?{nl}+S*E", "a"),
        (rf"fa(?:\(?(?:{arg}(?:,{arg})*)?\)?|\(\))?{nl}+S*(?:H[a,~]*{nl}+S*)*(?:Y{nl}+S*)?E", "a"), (rf"c(?:<<)?a(?:<a)?{nl}+S*E", "a"),
        (rf"(?<=[\nS;])a{arg}(?:,\n*{arg})*(?={nl})", "a"), (rf"(?<=[\nS;])(?:a(?:,a)*=)+a(?:,a)*(?={nl})", "a"), (rf"(?<=[=])aa(?={nl})", "a"), (rf"ra?(?:,a)*(?={nl})|k(?={nl})", "a"), (rf"(?<=[\nS;])a[IX]a(?={nl})", "a"),
        (rf"(?<=[\nS])a{nl}+", "S"), (r"(?<=S)\n+", ""),
    ]
    kw = {"I": "if unless while until", "X": "case", "L": "for", "e": "else", "G": "elsif", "h": "then", "E": "end", "T": "begin", "H": "rescue", "Y": "ensure", "d": "do", "r": "return raise yield", "k": "break next redo retry", "f": "def", "c": "class module", "u": "not", "o": "in and or", "W": "when"}
    comments = r"(?:(?<=\n)|(?<![\s\S]))=begin\b.*?\n=end[^\n]*|#[^\n]*"
    strings = rf"{_DQ}|{_SQ}|`[^`\n]*`|:\"[^\"\n]*\"|(?<![:\w]):{_NAME}[?!]?|%[wiqQ]?[\[({{<][^\])}}>]*[\])}}>]|(?<=[=(,~])\s*/(?!\s)[^/\n]+/[imx]*"
    prepare = [(r"\A\n*", "\n"), (r"\Z", "\n"), (r"do", "do"), (r"(?<=d)o([a,m]*)o", r"O\1O"), (r"(?<=\{)o([a,m]*)o", r"O\1O"), (r"\n\n+", "\n"), (r"(?<=[,opm=<\(\[\{\.])\n", "")]
    return Grammar(comments, strings, r"@{0,2}[^\W\d]\w*[?!]?|\$\w+", kw, {"**": "o", "=>": "~", "..": "o", "...": "o", "::": ".", "===": "o", "=~": "o", "<=>": "o", "||=": "=", "&&=": "=", "<<": "o", "&.": ".", "->": "u"}, rules, newline="\n", prepare=prepare, goal=r"\n?S*\n*")


_MAKERS = {"javascript": lambda: _javascript(False), "typescript": lambda: _javascript(True), "java": _java, "go": _go, "cpp": _cpp, "rust": _rust, "php": _php, "ruby": _ruby}
LANGUAGES = ("python", *_MAKERS)


@lru_cache(maxsize=None)
def grammar(language: str) -> Grammar:
    return _MAKERS[language]()


def _python(text: str) -> bool:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(text)
    except RecursionError:  # raised when the tree is built, after the text has been parsed
        return True
    except MemoryError:  # the parser's stack is used up, which tells nothing of the text
        return _python_tokens(text)
    except (SyntaxError, ValueError):
        return False
    return True


def _python_tokens(text: str) -> bool:
    """Whether the text has whole tokens, closed brackets and even indents; all that is judged of what is too deep for the parser."""
    open_ = []
    try:
        for t in tokenize.generate_tokens(io.StringIO(text).readline):
            if t.type == tokenize.OP and t.string in "([{":
                open_.append(t.string)
            elif t.type == tokenize.OP and t.string in ")]}":
                if not open_ or open_.pop() + t.string not in ("()", "[]", "{}"):
                    return False
    except (tokenize.TokenError, SyntaxError):
        return False
    return not open_


def parses(text: str, language: str) -> bool | None:
    """Whether the whole text is a program of the language; None for a language without a grammar."""
    if language == "python":
        return _python(text)
    if language not in _MAKERS:
        return None
    return grammar(language).parses(text.replace("\r\n", "\n").replace("\r", "\n"))
