"""Secrets in text: three fixed patterns, and literals that are assigned to sensitive names.

The lexer is anchored at assignment signs, ``#define`` and key-value attributes. Left of a sign it reads a name, right of
it a value: quoted strings (with prefixes, triple or back quotes) and names joined by ``+`` or by standing side by side,
names in ``$name`` or ``{name}`` form, lists, YAML block scalars, the default of an environment lookup, or a bare word. That
covers source code, JSON, YAML, INI, shell and XML syntax. Literals flow through names: in ``a = "x9..."; password = a`` the literal is scored by the
name ``password``. A literal's score adds up how sensitive the name is and how random the literal looks,
and placeholders are taken off.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from qualitylab.llm.shared import arrow_texts, values

KINDS = ("assign", "access", "hex", "literal")
THRESHOLD = 3.0
#: Characters from which the suffixes of a bare word are weighed together, and those kept of both ends of a
#: literal; no placeholder is longer.
LONG, ENDS = 4096, 16

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

_SIGN = re.compile(r"=>|:=|[=:](?![=:/])|(?<=\w)>")
#: Read backwards from a sign: a type such as ``: str``, closing quotes or brackets, and the name.
_NAME = re.compile(r"""\n?[ \t]*+(?:[\w.\[\]]++[ \t]*+:[ \t]*+)?["'\]]*+([\w.-]*[A-Za-z_])""", re.A)
#: An ampersand inside a bare word: none that parts the fields of a query or joins commands.
_AMP = r"&(?!&|\s|$|(?:amp;)?[\w.%-]+=)"
#: A name is a whole value: what goes on with another symbol is a bare word.
_PART = re.compile(
    r"""(?P<quoted>"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+')|(?P<name>[A-Za-z_]\w*+(?=`?(?:[\s"'<>;,|(){}\[\]]|\Z|(?!"""
    + _AMP + r""")&)|\+["']))""", re.A)
_BLANKS, _BARE = re.compile(r"[ \t]*+"), re.compile(r"""(?:[^\s"'<>;,&|(){}\[\]]|""" + _AMP + ")++", re.A)
_PLUS = re.compile(r"[ \t]*\+[ \t]*(?=[\w\"'])", re.A)
#: Before a value: blanks, a continued line, opening brackets.
_OPEN = re.compile(r"[ \t]*+(?:\\\r?\n[ \t]*+)?(?:[(\[][ \t\r\n]*+)*+")
_QUOTED = re.compile(r"""([bBrRuUfF]{0,2})("(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'|`(?:[^`\\\n]|\\.)*+`)""")
_TRIPLE = re.compile(r"""[bBrRuUfF]{0,2}(\"""|\'\'\')""")
#: A value that is another name: ``$name`` or ``${name}``; inside quotes also ``{name}`` where the prefix says so.
_REF = re.compile(r"""\$(?:(\w++)|\{(\w++)\})(?=[\s"'`;,)&|]|\Z)""")
_WHOLE_REF = re.compile(r"\$?\{(\w+)\}|\$(\w+)")
#: What a string that goes on in the next one has between: blanks, or in brackets and at a continued line a line break.
_BESIDE = re.compile(r"""(?:[ \t]++|[ \t]*+\\\r?\n[ \t]*+)(?=[bBrRuUfF]{0,2}["'])""")
_BESIDE_INSIDE = re.compile(r"""[ \t\r\n]*+(?=[bBrRuUfF]{0,2}["'])""")
_COMMA = re.compile(r"""[ \t\r\n]*+,[ \t\r\n]*+(?=[bBrRuUfF]{0,2}["'])""")
_LOOKUP = re.compile(r"""[A-Za-z_][\w.]{0,60}\([ \t]*+["'][^"'\n]{0,100}["'][ \t]*+,""", re.A)
_LOOKUPS = ("getenv", "environ.get", "env", "getProperty")
_BLOCK = re.compile(r"[ \t]*+[|>][+-]?[ \t]*+\r?\n([ \t]++)(?=\S)")
_DEFINE = re.compile(r"^[ \t]*+#[ \t]*+define[ \t]++(\w++)[ \t]++", re.M)
_ATTRIBUTES = re.compile(r"""\b(?:key|name)[ \t]*+=[ \t]*+["']([\w.:-]++)["'][ \t\r\n]++value[ \t]*+=[ \t]*+(?=["'])""")
_NAME_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")

#: Parts of names and how sensitive they make a name.
SENSITIVE = {
    "password": 2.5, "passwd": 2.5, "pwd": 2.5, "passphrase": 2.5, "secret": 2.5, "token": 2.0, "apikey": 2.5,
    "credential": 2.0, "credentials": 2.0, "bearer": 1.5, "auth": 1.0, "private": 1.0, "access": 0.5, "signing": 1.0,
    "encryption": 1.0, "api": 1.0, "key": 1.0, "salt": 1.0,
}
#: Those that also count at the end of a longer word, as in ``dbpassword``.
_ENDINGS = ("password", "passwd", "pwd", "passphrase", "secret", "token", "apikey", "credential", "credentials")
#: Words that mark a literal as no real value.
_INSIDE = re.compile(
    r"example|sample|changeme|change_me|placeholder|dummy|your[_-]|redacted|xxxx|\*{3}|\.{3}|[$]\{|\{\{", re.I)
_WHOLE = re.compile(r"(?:none|null|true|false|test\w*|password|secret|token)$|[<{$%]", re.I)
_TEST = re.compile("test", re.I)


@dataclass
class Facts:
    """What a literal's score needs: length, characters, both ends, a placeholder inside, and nothing but word characters."""

    n: int
    chars: Counter
    head: str
    tail: str
    inside: bool
    word: bool

    @classmethod
    def of(cls, text: str) -> Facts:
        return cls(len(text), Counter(text), text[:ENDS], text[-ENDS:], bool(_INSIDE.search(text)), bool(re.fullmatch(r"\w*+", text)))

    def __add__(self, other: Facts) -> Facts:
        inside = self.inside or other.inside or bool(_INSIDE.search(self.tail + other.head))
        return Facts(self.n + other.n, self.chars + other.chars, (self.head + other.head)[:ENDS], (self.tail + other.tail)[-ENDS:],
                     inside, self.word and other.word)

    def weight(self) -> float | None:
        """The literal's part of a score; None if it is no secret whatever its name."""
        if self.n < 6 or " " in self.chars or self.inside:
            return None
        # a longer text with this head is a whole placeholder only by its first character or as test...
        if _WHOLE.match(self.head) if self.n <= ENDS else self.head[0] in "<{$%" or (self.word and _TEST.match(self.head)):
            return None
        kinds = {"a" if "a" <= c <= "z" else "A" if "A" <= c <= "Z" else "0" if "0" <= c <= "9" else "" for c in self.chars}
        return (len(kinds) - 1) * 0.5 + max(0.0, entropy(self.chars, self.n) - 3.0)


@dataclass
class Value:
    """A literal: its places in the text, among them other values; its facts if it is joined; whether it was reported."""

    parts: list[tuple[int, int] | Value]
    facts: Facts | None = None
    reported: bool = False

    def all_facts(self, text: str) -> Facts:
        if self.facts is None:
            (start, end), = self.parts
            self.facts = Facts.of(text[start:end])
        return self.facts


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three fixed patterns' matches, leftmost and non-overlapping per kind."""
    out = [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    low = text.lower()
    if any(word in low for word in _ASSIGN_WORDS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    return sorted(out)


def named_places(text: str) -> Iterator[tuple[str, int, bool]]:
    """Name, place of its value, and whether a bare or a joined value may follow (not after a sign without blanks), in order."""
    back, others = text[::-1], []
    if "define" in text:
        others += [(m.end(), m[1]) for m in _DEFINE.finditer(text)]
    if "value" in text:
        others += [(m.end(), m[1]) for m in _ATTRIBUTES.finditer(text)]
    others = iter(sorted(others))
    other = next(others, None)
    for sign in _SIGN.finditer(text):
        while other and other[0] <= sign.end():
            yield other[1], other[0], False
            other = next(others, None)
        name = _NAME.match(back, len(text) - sign.start())
        if name:
            yield name[1][::-1], sign.end(), text[sign.end():sign.end() + 1] in (" ", "\t")
    while other:
        yield other[1], other[0], False
        other = next(others, None)


def string_at(text: str, at: int, unclosed: set[str]) -> tuple[str, int, int, int] | None:
    """Kind, start and end of the string that begins at ``at``, without quotes, and the place after it. ``unclosed`` remembers the triple quotes
    that no later place closes."""
    if triple := _TRIPLE.match(text, at):
        end = -1 if triple[1] in unclosed else text.find(triple[1], triple.end())
        if end < 0:
            unclosed.add(triple[1])
            return None
        inner = text[triple.end():end]
        start = triple.end() + len(inner) - len(inner.lstrip())
        return "quoted", start, max(start, start + len(inner.strip())), end + 3
    quoted = _QUOTED.match(text, at)
    if not quoted:
        return None
    start, end = quoted.start(2) + 1, quoted.end() - 1
    inside = _WHOLE_REF.fullmatch(text, start, end) if end - start < 80 else None
    if inside and (text[start] == "$" or "f" in quoted[1].lower()):
        return "ref", *inside.span(inside.lastindex), quoted.end()
    return "quoted", start, end, quoted.end()


def pairs(text: str) -> Iterator[tuple[str, list[tuple[str, int, int]]]]:
    """Name and value parts (kind, start, end) of every assignment, in order; a list gives a pair for each of its strings. Parts reach
    to their true end; the end of a bare word with signs inside is looked for once, and so are the strings of a bracket."""
    word, unclosed, read, block_end = (0, 0), set(), 0, 0
    for name, at, spaced in named_places(text):
        if at >= block_end and text[at - 1:at] == ":" and (block := _BLOCK.match(text, at)):
            lines, at, indent = [], block.start(1), block[1]
            while text.startswith(indent, at):
                end = text.find("\n", at)
                end = len(text) if end < 0 else end
                lines.append(("quoted", at + len(indent), at + len(text[at:end].rstrip())))
                at = end + 1
            block_end = at
            yield name, [line for line in lines if line[1] < line[2]]
            continue
        opened = _OPEN.match(text, at)
        brackets = opened[0].count("(") + opened[0].count("[") if at >= read else 0
        at = opened.end() if brackets else _BLANKS.match(text, at).end() if "\\" not in opened[0] else opened.end()
        if (call := _LOOKUP.match(text, at)) and call[0].partition("(")[0].endswith(_LOOKUPS):
            at = _BLANKS.match(text, call.end()).end()
        beside = _BESIDE_INSIDE if brackets else _BESIDE if spaced and at >= read else None
        parts = []
        while True:
            at = _BLANKS.match(text, at).end()
            if string := string_at(text, at, unclosed):
                kind, start, end, after = string
            elif ref := _REF.match(text, at):
                kind, (start, end), after = "ref", ref.span(ref.lastindex), ref.end()
            elif part := _PART.match(text, at):
                kind, (start, end), after = part.lastgroup, part.span(), part.end()
            else:
                if not word[0] <= at < word[1]:
                    bare = _BARE.match(text, at)
                    if not bare:
                        break
                    word = bare.span()
                kind, start, end, after = "bare", at, word[1], word[1]
            if kind in ("name", "bare") and text[after:after + 1] in ("(", "["):  # a call or an element, no literal
                break
            parts.append((kind, start, end))
            more = _PLUS.match(text, after) if kind != "bare" else None
            if not more and string and beside:
                more = beside.match(text, after)
                if more and not brackets:
                    read = after  # side by side on one line: strings further on are not read again
            if not more and string and "[" in opened[0] and brackets and (more := _COMMA.match(text, after)):
                yield name, parts
                parts = []
            if brackets:
                read = max(read, after)
            if not more:
                break
            at = more.end()
        if parts:
            yield name, parts


def entropy(chars: Counter, n: int) -> float:
    """Bits per character of a text of ``n`` characters, from their frequencies."""
    return -sum(p * math.log2(p) for p in (k / n for k in chars.values()) if p) if n else 0.0


def sensitivity(name: str) -> float:
    """How sensitive the parts of ``name`` make it."""
    parts = dict.fromkeys(p.lower() for p in _NAME_PARTS.findall(name))
    found = [p if p in SENSITIVE else p.removesuffix("s") for p in parts]
    return sum(SENSITIVE[word] for word in dict.fromkeys(
        p if p in SENSITIVE else next((e for e in _ENDINGS if p.endswith(e)), None) for p in found) if word)


def score(name: str, literal: str) -> float:
    """How likely ``literal`` is a secret, being the value of ``name``."""
    weight, sensitive = Facts.of(literal).weight(), sensitivity(name)
    return sensitive + weight if sensitive and weight is not None else 0.0


def suffix_weights(text: str, start: int, end: int) -> dict[int, float | None]:
    """``Facts.weight`` of the bare word from ``start`` and from every sign in it to ``end``, in one run from the right."""
    places = [start, *(at for m in _SIGN.finditer(text, start, end) if start < (at := m.end()) < end)]
    facts, last, out = Facts(0, Counter(), "", "", False, True), end, {}
    for at in reversed(places):
        facts.chars.update(text[at:last])
        facts.n, facts.head = end - at, text[at:min(at + ENDS, end)]
        facts.inside = facts.inside or bool(_INSIDE.search(text, at, min(last + ENDS, end)))
        facts.word = facts.word and bool(re.fullmatch(r"\w*+", text[at:last]))
        out[at], last = facts.weight(), at
    return out


def literal_spans(text: str, threshold: float = THRESHOLD) -> set[tuple[int, int]]:
    """Spans of the literals that reach a sensitive name, directly or through other names.

    A joined value holds its parts and facts, not its text, and is reported once: time and memory follow the text's
    length even where names double again and again.
    """
    known: dict[str, Value] = {}
    out: set[tuple[int, int]] = set()
    word, weights = 0, {}
    for name, parts in pairs(text):
        found = [known[text[s:e]] if kind in ("name", "ref") and text[s:e] in known else Value([(s, e)])
                 for kind, s, e in parts if s < e and (kind != "ref" or text[s:e] in known)]
        if not found:
            value = Value([], Facts.of(""))
        elif len(found) == 1:
            value = found[0]
        else:
            facts = found[0].all_facts(text)
            for other in found[1:]:
                facts += other.all_facts(text)
            value = Value(found, facts)
        known[name.rpartition(".")[2]] = value
        sensitive = sensitivity(name)
        if not sensitive or value.reported:
            continue
        kind, start, end = parts[0]
        if kind == "bare" and end - start > LONG:
            if word != end or start not in weights:
                word, weights = end, suffix_weights(text, start, end)
            weight = weights[start]
        else:
            weight = value.all_facts(text).weight()
        if weight is not None and sensitive + weight >= threshold:
            todo = [value]
            while todo:
                one = todo.pop()
                if isinstance(one, tuple):
                    out.add(one)
                elif not one.reported:
                    one.reported = True
                    todo += one.parts
    return out


def find(text: str | None, threshold: float = THRESHOLD) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all secrets, by start and then kind."""
    if not text:
        return []
    out = base_spans(text)
    if "=" in text or ":" in text or "</" in text or "define" in text:
        out = sorted({*out, *((s, 3, e) for s, e in literal_spans(text, threshold))})
    return out


def secret_spans(text: Column, threshold: float = THRESHOLD) -> Column:
    """All spans of each text: an array of (kind, start, end), code points, end exclusive, in order."""

    @arrow_udf("array<struct<kind:string,start:bigint,end:bigint>>")
    def spans(column: pa.Array) -> pa.Array:
        rows = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in find(t, threshold)] for t in values(column)]
        return pa.array(rows, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))

    return spans(text)


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of ``docs``: its id and ``found``, the array of ``secret_spans``.

    Null and empty texts have none (an empty array). Ids may be null or repeat; other columns are not read.
    """
    return arrow_texts(docs).select(F.col(id_col), secret_spans(F.col(text_col), threshold).alias("found"))


def of_kinds(found: Column, *kinds: str) -> Column:
    """The spans of ``kinds``."""
    return F.filter(found, lambda s: s["kind"].isin(*kinds))


def joined(found: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """``kind:start:end`` of the spans of ``kinds``, comma-joined in order."""
    return F.array_join(F.transform(of_kinds(found, *kinds), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(text: Column, found: Column, mark: str = "[SECRET]") -> Column:
    """Each text with every span, overlapping ones as one, replaced by ``mark``."""

    @arrow_udf("string")
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for t, places in zip(values(texts), values(spans), strict=True):
            merged: list[list[int]] = []
            for s, e in sorted((p["start"], p["end"]) for p in places or ()):
                if merged and s <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], e)
                else:
                    merged.append([s, e])
            cuts = [0, *(place for span in merged for place in span), len(t)] if merged else []
            out.append(mark.join(t[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True)) if merged else t)
        return pa.array(out, pa.string())

    return cut(text, found)
