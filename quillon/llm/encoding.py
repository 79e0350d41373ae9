"""Garbled text from wrong character encoding (problem 3).

Method: for every pair of a true encoding and an encoding it may have been read with, the garbled
sequences are computed once and put into one Aho-Corasick automaton. Each text with any non-ASCII character is run
through the automaton; a match is grown to its run, verified by encoding the run back and decoding it rightly,
and only that span is replaced. Correct text beside it stays as it is. Passes repeat for text garbled twice.

Families of pairs:
* UTF-8 read as a single-byte encoding (latin-1, cp1252, cp1250, cp1251, koi8-r, cp437, cp850, cp866, mac-roman, mac-cyrillic);
* a Cyrillic encoding read as another, or as latin-1/cp1252;
* cp1250 or iso8859-2 read as latin-1/cp1252;
* a double-byte encoding (gb2312, euc-kr, euc-jp, shift-jis) read as latin-1/cp1252;
* a single-byte text read as UTF-8 (replacement characters; found, but not restorable).

Defined results: null and pure ASCII texts are not garbled and are returned as they are. A garbled sequence that is the
whole of a quoted literal (a table of repairs, say) is a quotation and no case. Texts are taken whole, of any length.
Rows are treated one by one, so repeated rows repeat their result; extra columns are kept, and the operator's own
columns take the names ``garbled``, ``restorable``, ``true_encoding``, ``n_spans`` and ``restored``, replacing any columns so named.

Scale: no shuffle. ASCII-only rows never leave the JVM for detection: :func:`found` filters them before Python. The automaton is a
constant built per worker, nothing is broadcast.
"""

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NON_ASCII = r"[^\x00-\x7F]"

READ_AS = ("latin-1", "cp1252", "cp1250", "cp1251", "koi8-r", "cp437", "cp850", "cp866", "mac-roman", "mac-cyrillic")
CYRILLIC = ("cp1251", "koi8-r", "cp866", "iso8859-5", "mac-cyrillic")
WESTERN = ("latin-1", "cp1252")
CENTRAL = ("cp1250", "iso8859-2")
DOUBLE = ("gb2312", "euc-kr", "euc-jp")
#: Common bigrams of Russian, most frequent first (fixed values).
RUSSIAN = (
    "ст но то на ен ов ни ра во ко ро ос по го пр ка ли ер ре ть ет ор ол ал ны та ло ан ва ис ом ти ел ес ле ин ой ла од ри де от"
    " об ие ит ве да ся не за бы ат до ед за ль ск ки ви ых ий ая сл вы па см ши бк уд ще ря ед ач ем му мо уж ть ня ян ля ще ещ бн"
).split()


def _table(codec: str) -> list[str]:
    """Byte to character; undefined bytes stay control characters, as lenient readers leave them."""
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(codec))
        except UnicodeDecodeError:
            out.append(chr(b))
    return out


class _Pairs:
    """Tables and the automaton, built once per Python process."""

    def __init__(self) -> None:
        import ahocorasick

        self.tables = {c: _table(c) for c in {*READ_AS, *CYRILLIC, *CENTRAL}}
        self.bytes_of: dict[str, dict[str, int]] = {}
        for c, t in self.tables.items():
            back = {ch: b for b, ch in enumerate(t)}
            if c in ("cp1252", "cp1250", "cp1251"):
                for b in range(0x80, 0xA0):
                    back.setdefault(chr(b), b)
            self.bytes_of[c] = back
        patterns: dict[str, set[tuple[str, str]]] = {}
        add = lambda text, true, read: patterns.setdefault(text, set()).add((true, read))
        for read in READ_AS:
            t = self.tables[read]
            alts = [[t[b], chr(b)] if read.startswith("cp125") and 0x80 <= b < 0xA0 else [t[b]] for b in range(256)]
            for lead in (*range(0xC2, 0xE0), *range(0xE0, 0xF5)):
                for cont in range(0x80, 0xC0):
                    for a in alts[lead][:1]:
                        for b in alts[cont]:
                            add(a + b, "utf-8", read)
        for true in CYRILLIC:
            for read in (*CYRILLIC[:3], *WESTERN, "mac-cyrillic"):
                if read != true:
                    for pair in RUSSIAN:
                        seen = "".join(self.tables[read][self.bytes_of[true][ch]] for ch in pair)
                        if seen != pair:
                            add(seen, true, read)
        letters = "abcdefghijklmnoprstuwyzóABCDEFGHIJKLMNOPRSTUWYZ"
        for true in CENTRAL:
            for read in WESTERN:
                for ch in "ąęłśźżćńĄĘŁŚŹŻĆŃ":
                    seen = self.tables[read][self.bytes_of[true][ch]]
                    if seen.isalpha() and seen != "œ":
                        continue
                    for a in letters:
                        if seen == "¿":
                            add(a + seen, true, read)
                        elif seen == "œ":
                            for b in "æl³wmp":
                                add(a + seen + b, true, read)
                        else:
                            for b in letters[:24] + "æê³¹ñ":
                                add(a + seen + b, true, read)
        for lead in range(0xA4, 0xFE):
            for trail in range(0xA1, 0xFF):
                add(chr(lead) + chr(trail), "double-byte", "latin-1")
        for read in WESTERN:
            t = self.tables[read]
            for lead, trails in ((0x82, range(0x9F, 0xF2)), (0x83, (*range(0x40, 0x7F), *range(0x80, 0x97)))):
                for b in trails:
                    add(t[lead] + t[b], "shift-jis", read)
        self.automaton = ahocorasick.Automaton()
        for text, value in patterns.items():
            self.automaton.add_word(text, (len(text), sorted(value)))
        self.automaton.make_automaton()


_pairs: _Pairs | None = None


def pairs() -> _Pairs:
    global _pairs
    if _pairs is None:
        _pairs = _Pairs()
    return _pairs


_QUOTES = "\"'`"
_RU = set(RUSSIAN)


def _quoted(text: str, start: int, end: int) -> bool:
    """Whether the span is the whole of a quoted literal."""
    return start > 0 and end < len(text) and text[start - 1] in _QUOTES and text[end] == text[start - 1]


def _utf8_pieces(raw: bytes) -> list[tuple[int, int, str]]:
    """Valid multi-byte sequences in raw: (start, end, character)."""
    out, i = [], 0
    while i < len(raw):
        b = raw[i]
        n = 2 if 0xC2 <= b < 0xE0 else 3 if 0xE0 <= b < 0xF0 else 4 if 0xF0 <= b < 0xF5 else 0
        if n:
            try:
                out.append((i, i + n, raw[i : i + n].decode("utf-8")))
                i += n
                continue
            except UnicodeDecodeError:
                pass
        i += 1
    return out


def _plausible(ch: str) -> bool:
    """Characters that stand alone in otherwise Latin text."""
    c = ord(ch)
    return 0xA0 <= c < 0x180 or 0x2010 <= c < 0x2070 or 0x20A0 <= c < 0x20C0 or c in (0xFEFF, 0x2122, 0x2026)


class _Fix:
    """Spans to replace in one pass over a text.

    Each pair of encodings proposes spans with a weight, the number of garbled characters it explains; the strongest
    proposal goes first, and a line that one proposal has repaired is closed to the others.
    """

    def __init__(self, text: str) -> None:
        self.text = text
        self.spans: list[tuple[int, int, str, str]] = []
        hits: dict[tuple[str, str], list[tuple[int, int]]] = {}
        for end, (n, values) in pairs().automaton.iter(text):
            for v in values:
                hits.setdefault(v, []).append((end - n + 1, end + 1))
        if not hits:
            return
        self.offers: list[tuple[float, int, list]] = []
        for i, read in enumerate(READ_AS):
            if ("utf-8", read) in hits:
                self._utf8(i, read, hits["utf-8", read])
        self._double(hits.get(("double-byte", "latin-1"), []))
        for read in WESTERN:
            self._sjis(read, hits.get(("shift-jis", read), []))
        for (true, read), found in hits.items():
            if true in CYRILLIC:
                self._cyrillic(true, read, found)
            elif true in CENTRAL:
                self._central(true, read, found)
        closed: set[int] = set()
        for _, _, spans in sorted(self.offers, key=lambda o: (-o[0], o[1])):
            lines = [self._line(s) for s, *_ in spans]
            self.spans += [x for x, n in zip(spans, lines) if n not in closed]
            closed.update(lines)

    def _line(self, at: int) -> int:
        return self.text.rfind("\n", 0, at) + 1

    def _runs(self, codec: str, starts: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Maximal runs of characters that are high bytes of the codec, around the matches."""
        back, text, out, done = pairs().bytes_of[codec], self.text, [], -1
        high = lambda ch: back.get(ch, 0) >= 0x80
        for s, e in starts:
            if s < done:
                continue
            while s > 0 and high(text[s - 1]):
                s -= 1
            while e < len(text) and high(text[e]):
                e += 1
            out.append((s, e))
            done = e
        return out

    def _utf8(self, order: int, read: str, found: list[tuple[int, int]]) -> None:
        back, text, sure, maybe = pairs().bytes_of[read], self.text, [], []
        for s, e in self._runs(read, sorted(found)):
            raw = bytes(back[ch] for ch in text[s:e])
            pieces = _utf8_pieces(raw)
            if not pieces or _quoted(text, s, e):
                continue
            whole = sum(b - a for a, b, _ in pieces) == len(raw)
            if read in ("cp1251", "koi8-r", "cp866", "mac-cyrillic"):
                ok = whole and len(pieces) >= 2
            elif read in ("cp437", "cp850", "mac-roman"):
                near = any(0 <= i < len(text) and text[i].isascii() and text[i].isalnum() for i in (s - 1, e))
                ok = all(_plausible(c) for _, _, c in pieces) and near or whole and len(pieces) >= 2 and not all(0x2500 <= ord(c) < 0x25A0 for c in text[s:e])
            else:
                ok = whole and len(pieces) >= 2 or all(_plausible(c) for _, _, c in pieces)
            spans = [(s + a, s + b, c, f"utf-8 as {read}") for a, b, c in pieces]
            (sure if ok else maybe).extend(spans)
        if len(sure) >= 2:  # the reading is certain, so its lone sequences count as well
            sure += maybe
        if sure:
            odd = sum(not c.isprintable() and ord(c) != 0xFEFF for _, _, c, _ in sure)
            self.offers.append((sum(e - s for s, e, *_ in sure) - 3 * odd, order, sure))

    def _double(self, found: list[tuple[int, int]]) -> None:
        if not found:
            return
        back, text = pairs().bytes_of["latin-1"], self.text
        runs = []
        for s, e in self._runs("latin-1", sorted(found)):
            while s < e and back[text[s]] < 0xA1:
                s += 1
            while e > s and back[text[e - 1]] < 0xA1:
                e -= 1
            if (e - s) % 2 == 0 and not _quoted(text, s, e):
                runs.append((s, e, bytes(back[ch] for ch in text[s:e])))
        votes = []
        for codec in DOUBLE:
            good, score, long = [], 0.0, 0
            for s, e, raw in runs:
                try:
                    seen = raw.decode(codec)
                except UnicodeDecodeError:
                    continue
                kana = sum(0x3040 <= ord(c) < 0x3100 for c in seen)
                hangul = sum(0xAC00 <= ord(c) < 0xD7A4 for c in seen)
                cjk = sum(0x4E00 <= ord(c) < 0xA000 for c in seen)
                beside = any(0 <= i < len(text) and text[i].isascii() and text[i].isalpha() for i in (s - 1, e))
                if e - s < 4 and beside:
                    continue
                if kana + hangul + cjk >= len(seen) / 2 or all(0x3000 <= ord(c) < 0x3020 for c in seen):
                    good.append((s, e, seen, f"{codec} as latin-1"))
                    score += {"gb2312": cjk * 1.5 + kana, "euc-kr": hangul * 2.0, "euc-jp": kana * 3.0 + cjk}[codec]
                    long += e - s if e - s >= 4 else 0
            if long >= 4:
                votes.append((score, sum(e - s for s, e, *_ in good), good))
        if votes:
            _, weight, good = max(votes, key=lambda v: v[0])
            self.offers.append((weight, 50, good))

    def _sjis(self, read: str, found: list[tuple[int, int]]) -> None:
        back, text, spans = pairs().bytes_of[read], self.text, []
        for a in sorted({self._line(s) for s, _ in found}):
            b = text.find("\n", a)
            b = len(text) if b < 0 else b
            inside = [h for h in found if a <= h[0] < b]
            if len(inside) < 3:
                continue
            s, e = min(h[0] for h in inside), max(h[1] for h in inside)
            while s > a and not text[s - 1].isascii():
                s -= 1
            while e < b and not text[e].isascii():
                e += 1
            try:
                seen = bytes(back[ch] for ch in text[s:e]).decode("shift-jis")
            except (KeyError, UnicodeDecodeError):
                continue
            spans.append((s, e, seen, f"shift-jis as {read}"))
        if spans:
            self.offers.append((sum(e - s for s, e, *_ in spans), 60, spans))

    def _cyrillic(self, true: str, read: str, found: list[tuple[int, int]]) -> None:
        text, back, table = self.text, pairs().bytes_of[read], pairs().tables[true]
        high = lambda ch: back.get(ch, 0) >= 0x80
        joined = lambda i: high(text[i]) or (text[i] == " " and 0 < i < len(text) - 1 and high(text[i - 1]) and high(text[i + 1]))
        score = lambda t: sum(t[i : i + 2] in _RU for i in range(len(t) - 1))
        spans, maybe, weight, seen_to = [], [], 0.0, -1
        for s, e in sorted(found):
            if s < seen_to:
                continue
            while s > 0 and joined(s - 1):
                s -= 1
            while e < len(text) and joined(e):
                e += 1
            seen_to = e
            old = text[s:e]
            new = "".join(table[back[ch]] if high(ch) else ch for ch in old)
            was, now, letters = score(old), score(new), sum(not c.isascii() for c in old)
            if now > 2 * was and now * 4 >= letters and not _quoted(text, s, e):
                (spans if now >= 3 else maybe).append((s, e, new, f"{true} as {read}"))
                weight += min(letters, 2 * now)
        if spans:
            self.offers.append((weight, 70, spans + maybe))

    def _central(self, true: str, read: str, found: list[tuple[int, int]]) -> None:
        text, back, table = self.text, pairs().bytes_of[read], pairs().tables[true]
        spans, odd = [], 0
        for a in sorted({self._line(s) for s, _ in found}):
            b = text.find("\n", a)
            for m in re.compile(r"[^\x00-\x7f]+").finditer(text, a, len(text) if b < 0 else b):
                if all(c in back for c in m[0]):
                    new = "".join(table[back[ch]] for ch in m[0])
                    odd += sum(not c.isalpha() or not 0xC0 <= ord(c) < 0x180 for c in new)
                    spans.append((m.start(), m.end(), new, f"{true} as {read}"))
        if spans:
            self.offers.append((sum(e - s for s, e, *_ in spans) - 2 * odd, 80, spans))


def restore(text: str) -> tuple[str, int, str | None, bool]:
    """(text with garbled spans replaced, number of spans, encodings, whether anything is garbled)."""
    lost = any(
        (i and text[i - 1].isalpha()) or (i + 1 < len(text) and text[i + 1].isalpha())
        for i in (m.start() for m in re.finditer("�+", text))
        if not _quoted(text, i, re.compile("�+").match(text, i).end())
    )
    names: dict[str, int] = {}
    total = 0
    seen = {text}
    while spans := sorted(_Fix(text).spans):  # text may be garbled several times over
        parts, at = [], 0
        for s, e, new, name in spans:
            if s < at or new == text[s:e]:
                continue
            parts += [text[at:s], new]
            at = e
            names[name] = names.get(name, 0) + 1
            total += 1
        if not parts:
            break
        text = "".join([*parts, text[at:]])
        if text in seen:
            break
        seen.add(text)
    if lost:
        names["single-byte as utf-8"] = 1
    label = ", ".join(sorted(names)) or None
    return text, total, label, bool(total) or lost


_OUT = ["garbled", "restorable", "true_encoding", "n_spans", "restored"]


def repair(rows: DataFrame, text_col: str = "raw_content") -> DataFrame:
    """Adds garbled, restorable, true_encoding, n_spans and restored (the text itself where nothing is garbled)."""
    keep = [c for c in rows.columns if c not in _OUT]
    base = rows.select(*keep)

    @F.pandas_udf("n_spans int, true_encoding string, restored string, garbled boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = []
            for t in texts:
                if t is None or t.isascii():
                    out.append((0, None, t, False))
                else:
                    new, n, name, bad = restore(t)
                    out.append((n, name, new, bad))
            yield pd.DataFrame(out, columns=["n_spans", "true_encoding", "restored", "garbled"])

    fixed = base.withColumn("_fix", run(F.col(text_col)))
    lost = F.col("_fix.restored").contains("�")
    return fixed.select(
        *keep, F.col("_fix.garbled").alias("garbled"), (F.col("_fix.garbled") & ~lost).alias("restorable"),
        F.col("_fix.true_encoding").alias("true_encoding"), F.col("_fix.n_spans").alias("n_spans"), F.col("_fix.restored").alias("restored"),
    )


def found(rows: DataFrame, id_col: str = "file_id", text_col: str = "raw_content") -> DataFrame:
    """Ids of rows with garbled text. Rows of ASCII alone are ruled out in the JVM."""
    cand = rows.where(F.col(text_col).rlike(NON_ASCII)).select(id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([ids.filter(pa.array([restore(t)[3] for t in texts], pa.bool_()))], [id_col])

    kind = dict(rows.dtypes)[id_col]
    return cand.mapInArrow(run, f"{id_col} {kind}").distinct()
