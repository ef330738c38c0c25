"""Sentence boundaries across languages and scripts, by a pushdown automaton over each paragraph.

Lines are first put into paragraphs, list items, quoted lines and code. Over a paragraph the automaton reads only what
can matter: quotation marks and brackets, which it pushes and pops, code spans and links, which it steps over, closing
marks, and Thai polite particles. A closing mark ends a unit only while nothing is open, or where the whole unit lies
within what has just been closed. Dots are looked up backwards in tries of abbreviations.

Offsets are in code points; a unit's end is exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

PAIRS = {"(": ")", "[": "]", "{": "}", "（": "）", "［": "］", "【": "】", "「": "」", "『": "』", "《": "》", "〈": "〉", "«": "»", "‹": "›", "„": "“", "“": "”", '"': '"'}
CLOSERS = set(PAIRS.values()) | {"’"}
OPENERS = set(PAIRS) | {"¿", "¡", "‘", "'", "*", "_"}

#: Abbreviations after which a sentence never ends.
NEVER = """Dr Dra Mr Mrs Ms Mme Mlle Mgr Prof Sr Sra Srta Hr Fr Hrn Ing Mag St Ste Rev Gen Capt Lt Sgt vs cf viz i.e e.g z.B d.h u.a u.U s.o p.ex p.ej
bzw gem lt sog ggf evtl inkl exkl vgl engl dt ex ej см напр им проф тов ул т.е т π.χ δηλ βλ κ κα डॉ श्री प्रो د أ""".split()
#: Abbreviations that a number or a name follows; the sentence is over where neither a digit nor a small letter does.
NUMBERED = """No no Nr nr Nos Fig fig Figs Abb Tab Tabelle Kap S p pp pag pág págs núm n vol Vol ch sec Sec Art art approx ca circa aprox env รูปที่ พ.ศ ค.ศ рис стр гл
ил табл № εικ σελ αρ पृ सं ص""".split()
#: Abbreviations that may also close a sentence: it is over where a capital, a digit or a letter without case follows.
EITHER = """etc usw Inc Ltd Co Corp Jr Sr. Bros a.m p.m A.M P.M U.S U.K E.U u.s.w u.ä o.ä т.д т.п и.т.д г гг др пр κ.λπ κτλ κ.ά κ.ο.κ आदि ecc al""".split()
#: German month names, before which a number with a dot is an ordinal.
MONTHS = ("Januar", "Jänner", "Februar", "März", "April", "Mai", "Juni", "Juli", "August", "September", "Oktober", "November", "Dezember")
PARTICLES = ("ครับ", "ค่ะ", "คะ")


def _trie(words: dict[str, str]) -> dict:
    root: dict = {}
    for word, kind in words.items():
        node = root
        for ch in reversed(word):
            node = node.setdefault(ch, {})
        node[""] = kind
    return root


ABBREVIATIONS = _trie({**dict.fromkeys(NEVER, "never"), **dict.fromkeys(NUMBERED, "numbered"), **dict.fromkeys(EITHER, "either")})

_LINE = re.compile(r"([^\r\n]*)(\r\n|\r|\n|$)")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})")
_QUOTED = re.compile(r" {0,3}(?:> ?)+")
_ITEM = re.compile(r" {0,3}(?:[-*+•‣◦]|(\d{1,9})[.)])[ \t]+(?=\S)")
_EVENT = re.compile(
    r"(?P<code>(?P<tick>`+)(?!`).+?(?<!`)(?P=tick)(?!`))"
    r"|(?P<link>(?:[a-z][a-z0-9+.-]{1,9}://|www\.)[^\s()<>\[\]{}\"'`“”„«»\u0080-\U0010ffff]+)"
    r"|(?P<smile>(?<!\S)[:;=]['’]?-?[)(DPp|/\\*](?=\s|$))"
    r"|(?P<thai>(?:" + "|".join(PARTICLES) + r")(?=\s))"
    r"|(?P<mark>[.!?…。！？｡．।॥؟۔;;]+)"
    r"|(?P<pair>[()\[\]{}（）［］【】「」『』《》〈〉«»‹›„“”\"])",
    re.S,
)
_MONTH = re.compile(r"\s*(?:" + "|".join(MONTHS) + ")")
_WORD = re.compile(r"\w", re.U)
_SMILE = re.compile(r"[:;=]['’]?-?[)(DPp|/\\*]")
_GREEK = re.compile(r"[Ͱ-Ͽἀ-῿]")
_NUMBER = re.compile(r"(?<![\w.,/])\d{1,2}$")
_JOINED = re.compile(r"(?<![\w.])((?:\w\.[ \u00a0]?)*\w)$")
#: Kana that carry a quotation on inside its sentence.
_GOES_ON = "とをはがにのもでっや"


def blocks(text: str) -> Iterator[tuple[bool, list[tuple[int, int]]]]:
    """(is a list item, its stretches of text) in order; code and blank lines are in none."""
    fence = None
    now: list[tuple[int, int]] = []
    item = quoted = False
    for m in _LINE.finditer(text):
        lo, hi = m.span(1)
        line = m[1]
        if lo == hi and not m[2]:
            break
        if fence:
            f = _FENCE.match(line)
            if f and f[1][0] == fence[0] and len(f[1]) >= len(fence) and not line[f.end() :].strip():
                fence = None
            continue
        f = _FENCE.match(line)
        bare = line.strip()
        lead = line[: len(line) - len(line.lstrip(" \t"))]
        if f or not bare or len(lead.expandtabs(4)) >= 4:
            if now:
                yield item, now
            now, item, quoted = [], False, False
            fence = f[1] if f else None
            continue
        q = _QUOTED.match(line)
        if q and not quoted and now:
            yield item, now
            now, item = [], False
        # a line without the sign goes on with the quoted paragraph before it
        quoted = bool(q) or quoted and bool(now)
        if q:
            lo += q.end()
            line = text[lo:hi]
            if not line.strip():
                if now:
                    yield item, now
                now, item = [], False
                continue
        i = _ITEM.match(line)
        if i and (not now or item or not i[1] or i[1] == "1"):
            if now:
                yield item, now
            now, item = [(lo + i.end(), hi)], True
        else:
            now.append((lo, hi))
    if now:
        yield item, now


def _matched(s: str, events: list) -> dict[int, int]:
    """Position of each opening mark that is closed again -> position of its closing mark."""
    out: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    waiting: dict[str, int] = {}  # how many of each closing mark the stack waits for
    for e in events:
        if e.lastgroup != "pair":
            continue
        c, at = e[0], e.start()
        # a mark that opens and closes alike, or closes after a low opening one, closes if it is waited for
        if waiting.get(c):
            while stack:
                want, start = stack.pop()
                waiting[want] -= 1
                if want == c:
                    out[start] = at
                    break
        elif c in PAIRS:
            stack.append((PAIRS[c], at))
            waiting[PAIRS[c]] = waiting.get(PAIRS[c], 0) + 1
    return out


def _abbreviation(s: str, at: int) -> str | None:
    """Kind of the abbreviation that ends where the dot at ``at`` stands; longest match, at a word's start."""
    node, kind, i = ABBREVIATIONS, None, at
    while True:
        if "" in node and (i == 0 or _cjk(s[i - 1]) or not (s[i - 1].isalnum() or s[i - 1] in "-_/.")):
            kind = node[""]
        if i == 0 or s[i - 1] not in node:
            break
        i -= 1
        node = node[s[i]]
    if kind:
        # a Russian year after its number, else a title before a name
        return "never" if s[at - 1] == "г" and not s[:i].rstrip()[-1:].isdigit() else kind
    m = _JOINED.search(s, max(0, at - 16), at)
    if m:
        plain = re.sub(r"[  ]", "", m[1])
        if plain in NEVER:
            return "never"
        if plain in EITHER:
            return "either"
        if len(plain) == 1:
            return "never" if plain.isalpha() and not _cjk(plain) and not "฀" <= plain <= "๿" else None
        return None if any(c.isdigit() for c in plain) else "never" if " " in m[1] else "either"
    return None


def _cjk(c: str) -> bool:
    return "぀" <= c <= "ヿ" or "㐀" <= c <= "鿿" or "가" <= c <= "힯" or "ｦ" <= c <= "ﾝ"


def _next(s: str, at: int) -> str:
    """Case of what comes next: u(pper), l(ower), d(igit), o(ther letter) or "" at the end; a name like iName counts as upper."""
    for i in range(at, len(s)):
        c = s[i]
        if c.isalnum():
            if c.isdigit():
                return "d"
            if c.islower():
                return "u" if i + 1 < len(s) and s[i + 1].isupper() else "l"
            return "u" if c.isupper() else "o"
    return ""


def _ends(s: str, start: int, a: int, b: int) -> bool:
    """Whether the closing mark at [a, b) of the sentence from ``start`` ends it, nothing being open."""
    mark = s[a:b]
    after = s[b] if b < len(s) else ""
    if any(c in "。！？｡।॥؟۔" for c in mark):
        return True
    if mark == "．":
        return not after.isdigit()
    tight = bool(after) and not after.isspace() and after not in CLOSERS and after not in OPENERS and not _cjk(after)
    if all(c in ";;" for c in mark):
        return not tight and bool(_GREEK.search(s, max(start, a - 200), a))
    if "!" in mark or "?" in mark:
        return not (tight and (after.isalnum() or after in "=,;:/&"))
    if "…" in mark or len(mark) > 1:
        if tight and after.isalnum() and not _cjk(after):
            return _next(s, b) != "l" and mark != ".."
        if tight and after in ",;:":
            return False
        # set off by a blank it is a pause within the sentence, if that goes on in small letters
        return not (a == start or s[a - 1].isspace() and _next(s, b) == "l")
    if mark == ".":
        if tight:
            return False
        kind = _abbreviation(s, a)
        if kind is None:
            if _NUMBER.search(s, max(0, a - 6), a) and _MONTH.match(s, b):
                return False
            return a > start
        nxt = _next(s, b)
        if not nxt:
            return True
        if kind == "never":
            return False
        if kind == "numbered":
            return nxt not in "dl"
        return nxt != "l"
    return True


def _paragraph(s: str) -> list[tuple[int, int]]:
    """Units of one paragraph, as offsets in ``s``."""
    events = [e for e in _EVENT.finditer(s)]
    match = _matched(s, events)
    out: list[tuple[int, int]] = []

    def skip(i: int) -> int:
        while i < len(s) and s[i].isspace():
            i += 1
        return i

    start, reach = skip(0), 0
    for e in events:
        a, b, kind = e.start(), e.end(), e.lastgroup
        if kind == "tick":
            kind = "code"
        if a < reach:
            continue
        end = None
        if kind in ("code", "smile"):
            reach = b
        elif kind == "link":
            # marks at a link's end are not part of it
            tail = len(e[0]) - len(e[0].rstrip(".,;:!?"))
            if tail:
                reach = b - tail
                m = re.compile(r"[.!?]+").match(s, reach)
                if m and _ends(s, start, m.start(), m.end()):
                    end = m.end()
            else:
                reach = b
        elif kind == "thai":
            end = b
        elif kind == "pair":
            q = match.get(a)
            if q is None:
                continue
            reach = q + 1
            if not s[start:a].strip("".join(OPENERS) + "  \t\n\r"):
                # the unit began with it: over with it, if a closing mark stands right before its end
                i = q
                while i > a and (s[i - 1].isspace() or s[i - 1] in CLOSERS):
                    i -= 1
                j = i
                while j > a and s[j - 1] in ".!?…。！？｡।॥؟۔;;":
                    j -= 1
                if j < i and _whole(s, a + 1, j, i, q + 1):
                    end = q + 1
        elif kind == "mark" and _ends(s, start, a, b):
            end = b
        if end is None or end <= start:
            continue
        while end < len(s) and (s[end] in CLOSERS and end not in match):
            end += 1
        out.append((start, end))
        start = reach = skip(end)
    tail = s[start:].rstrip()
    if tail:
        if out and not _WORD.search(_SMILE.sub(" ", tail)):
            out[-1] = (out[-1][0], start + len(tail))
        else:
            out.append((start, start + len(tail)))
    return out


def _whole(s: str, inner: int, a: int, b: int, close: int) -> bool:
    """Whether a quoted or bracketed text with its last mark at [a, b) is a sentence of its own, given what follows ``close``."""
    after = s[close] if close < len(s) else ""
    if after and after in ".!?…。！？।؟,;:،、，":
        return False
    if s[a:b] == "." and _abbreviation(s, a) and _next(s, close) == "l":
        return False
    if s[a:b] in (";", ";") and not _GREEK.search(s, inner, a):
        return False
    if after in _GOES_ON and after:
        return False
    if after and not after.isspace() and after.isalnum() and not _cjk(after) and not "฀" <= after <= "๿":
        return False
    if _next(s, close) == "l" and s[a:b] != ".":
        return False
    return True


def units(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of each sentence unit."""
    out: list[tuple[int, int]] = []
    for item, parts in blocks(text or ""):
        lo, hi = parts[0][0], parts[-1][1]
        if item:
            body = text[lo:hi]
            out.append((lo + len(body) - len(body.lstrip()), lo + len(body.rstrip())))
            continue
        if len(parts) == 1:
            s = text[lo:hi]
        else:  # what lies between the lines' texts, such as quotation marks of quoted lines, counts as blanks
            s, at = "", lo
            for a, b in parts:
                s += " " * (a - at) + text[a:b]
                at = b
        out += [(lo + a, lo + b) for a, b in _paragraph(s)]
    return out


def sentences(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, start_char, end_char), one row per sentence unit of every document.

    Nulls: a null or empty text has no unit. Repeated rows come out repeated, a null key stays null, an empty table gives
    an empty result, and other columns are ignored. Texts of any length are read whole, in one task each.
    """
    kind = documents.schema[key].dataType.simpleString()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, lo, hi = [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                for s, e in units(t):
                    at.append(i)
                    lo.append(s)
                    hi.append(e)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())], names=[key, "start_char", "end_char"])

    return documents.select(key, text).mapInArrow(split, f"`{key}` {kind}, start_char int, end_char int")
