"""Secret scans: assignments are lexed into name-literal pairs, constants followed, literals scored by target names.

Four kinds of spans, in code points, end exclusive:

    assign, access, hex   plain patterns (``BASE``), leftmost and without overlap within a kind; the whole match
    literal               what the assignment-aware scan adds: literals that no plain span holds

The scan reads source and configuration alike: ``name = "x"``, ``"name": "x"``, ``name: x``, ``NAME=x``, ``name := x``,
``name => "x"``, ``t["name"] = "x"``, typed targets, comparisons, keyword arguments, ``put("name", "x")``,
``setName("x")``, ``<name>x</name>``, ``--name x`` and the password of ``scheme://user:x@host``. A literal may be joined
from parts or pass through one call. A name that is assigned and used again (``password = salt + key``, ``${KEY}``)
hands its target's sensitivity on to its own literals, a little less at each step, in whatever order the lines stand.

A literal's score is the sensitivity of the most sensitive name that it reaches times its strength: its entropy, less if
it is of letters only, nothing if it is a placeholder. Scores of ``LEAST`` and more are reported.

Null and empty texts have no spans. Repeated rows each give a row; a null doc_id is kept; empty tables give no rows; extra
columns are ignored. Time is linear in the text, but for strings left open, each of which is sought to the end of its line.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "literal")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS, _HEX = re.compile(r"AKIA[A-Z0-9]{16,}"), re.compile(r"[0-9a-f]{24,}")

LEAST, STEP, SHORTEST = 0.5, 0.9, 6
#: How sensitive a name is by its words (or two words in a row); weights of our own.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "passcode": 0.9, "secret": 1.0, "token": 0.9, "apikey": 1.0, "api key": 1.0, "access key": 1.0, "secret key": 1.0,
    "private key": 1.0, "signing key": 1.0, "encryption key": 1.0, "auth key": 1.0, "account key": 0.9, "master key": 0.9, "shared key": 0.9, "credential": 0.9, "credentials": 0.9, "bearer": 0.9,
    "authorization": 0.8, "auth": 0.7, "pass": 0.7, "jwt": 0.8, "webhook": 0.6, "salt": 0.6, "pin": 0.6, "cookie": 0.6, "session": 0.5, "key": 0.5,
}
#: A name that ends so tells about a secret and holds none.
ABOUT = frozenset("name id file path url uri type kind field label hint policy length size min max count ttl expiry expires timeout regex pattern format prefix header algorithm public version env var column prompt message error".split())
_PLACEHOLDER = re.compile(r"(?i)^(?:x{3,}|\*+|\.{3,}|-+|_+|<.*>|\{\{.*\}\}|%.*%|.*(?:your[_-]|change[_-]?me|example|placeholder|redacted|dummy|todo|insert[_-]|none$|null$|undefined$|true$|false$|required$|optional$).*)$")

_QUOTED = r'''(?:"""[\s\S]*?"""|\'\'\'[\s\S]*?\'\'\'|"[^"\\\n]*(?:\\.[^"\\\n]*)*"|'[^'\\\n]*(?:\\.[^'\\\n]*)*'|`[^`\n]*`)'''
_TOKEN = re.compile(
    rf"""(?P<str>(?<![\w"'`])[rbfuRBFU]{{0,2}}{_QUOTED})"""
    r"|(?P<ref>\$\{[A-Za-z_]\w*\}|\$[A-Za-z_]\w*)|(?P<name>[A-Za-z_][\w$]*(?:(?:\.|->|::|-)[A-Za-z_][\w$]*)*)|(?P<num>\d[\w.]*)"
    r"|(?P<op>:=|=>|<-|===?|!==?|<=|>=|\+=|\?=|::|=|:)|(?P<nl>\n)|(?P<mark>\S)",
    re.ASCII,
)
_SETS = {"=", ":", ":=", "=>", "<-", "+=", "?=", "==", "===", "!=", "!=="}
_BARE = re.compile(r"""[ \t]*([^\s"'`,;#(){}\[\]<>=&?]+(?:={1,2}(?![^\s"'`,;#)}\]&]))?)""")
_INSIDE = re.compile(r"\$?\{\s*([A-Za-z_]\w*)\s*\}", re.ASCII)
_TAGGED = re.compile(r"<([A-Za-z_][\w.-]*)>([^<>\n]+)</\1>", re.ASCII)
_FLAG = re.compile(r"""(?<![\w-])--?([A-Za-z][\w-]*)[ \t]+["']?([^\s"'`;|&<>-][^\s"'`;|&<>]*)""", re.ASCII)
_USERINFO = re.compile(r"""[A-Za-z][A-Za-z0-9+.-]{1,20}://[^\s:/@"'<>]*:([^\s/@"'<>]+)@""")
_WORTH = re.compile(r"[=:(<]|--")
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")


@dataclass
class Pair:
    """A target's name, the spans of the literals that are put together for it, and the names used beside them."""

    name: str
    literals: list[tuple[int, int]] = field(default_factory=list)
    uses: list[str] = field(default_factory=list)
    quoted: bool = True


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the plain patterns."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), "assign", m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), "access", m.end()) for m in _ACCESS.finditer(text)]
    return found + [(m.start(), "hex", m.end()) for m in _HEX.finditer(text)]


def _content(text: str, start: int, end: int) -> tuple[int, int]:
    """Of a string token, what lies between its quotes."""
    while text[start] not in "\"'`":
        start += 1
    n = 3 if text[start : start + 3] in ('"""', "'''") and end - start >= 6 else 1
    return start + n, end - n


class Lexer:
    """One text's tokens, and the pairs that its assignments make."""

    def __init__(self, text: str):
        self.text = text
        self.tokens = [(m.lastgroup, m.start(), m.end()) for m in _TOKEN.finditer(text)]

    def _word(self, i: int) -> str:
        return self.text[self.tokens[i][1] : self.tokens[i][2]] if 0 <= i < len(self.tokens) else ""

    def _kind(self, i: int) -> str | None:
        return self.tokens[i][0] if 0 <= i < len(self.tokens) else None

    def _string(self, i: int) -> str:
        a, b = _content(self.text, *self.tokens[i][1:])
        return self.text[a:b]

    def target(self, i: int) -> str | None:
        """The name that the operator at token ``i`` gives a value to."""
        kind = self._kind(i - 1)
        if kind == "str":
            key = self._string(i - 1)
            return key if len(key) <= 100 and "\n" not in key else None
        if self._word(i - 1) == "]" and self._kind(i - 2) == "str" and self._word(i - 3) == "[":
            return f"{self._word(i - 4)}.{self._string(i - 2)}" if self._kind(i - 4) == "name" else self._string(i - 2)
        if self._word(i) == "=":  # name: type = value
            for back in range(i - 2, max(-1, i - 6), -1):
                if self._kind(back) == "nl":
                    break
                if self._word(back) == ":" and self._kind(back - 1) == "name":
                    return self._word(back - 1)
        return self._word(i - 1) if kind in ("name", "ref") else None

    def value(self, i: int, name: str) -> Pair | None:
        """What follows the operator at token ``i``: strings and names joined by ``+``, ``.``, ``||`` or nothing."""
        out, k, first = Pair(name), i + 1, True
        while True:
            kind, word = self._kind(k), self._word(k)
            called = kind == "name" and self._word(k + 1) == "("
            if kind == "str":
                self._literal(out, k)
            elif kind == "ref":
                out.uses.append(word.strip("${}"))
            elif called and self._kind(k + 2) == "str":
                if self._word(k + 3) == ")":  # what one call makes of a literal
                    self._literal(out, k + 2)
                k += 3
            elif kind == "name":
                out.uses.append(word)
            elif not first or kind is None or kind == "nl":
                break
            if first and not called and kind in ("name", "num", "mark") and (bare := _BARE.match(self.text, self.tokens[i][2])):
                whole = self._kind(k) == "name" and bare.end() == self.tokens[k][2]
                if not whole or self._word(k + 1) != "+":
                    return Pair(name, [bare.span(1)], out.uses if whole else [], False)
            if kind in ("num", "mark"):
                break
            first, k = False, k + 1
            if self._word(k) in ("+", ".") or self._word(k) == "|" == self._word(k + 1):
                k += 2 if self._word(k) == "|" else 1
                while self._kind(k) == "nl":
                    k += 1
            elif not (self._kind(k) == "str" == kind):
                break
        return out if out.literals or out.uses else None

    def _literal(self, pair: Pair, k: int) -> None:
        a, b = _content(self.text, *self.tokens[k][1:])
        inside = _INSIDE.findall(self.text, a, b)
        if inside:
            pair.uses += inside
        elif b > a:
            pair.literals.append((a, b))

    def called(self, i: int) -> Pair | None:
        """``put("name", "x")`` and ``setName("x")``; token ``i`` is the opening bracket."""
        if self._kind(i + 1) != "str":
            return None
        if self._word(i + 2) == "," and self._kind(i + 3) == "str":
            pair = Pair(self._string(i + 1)[:100])
            self._literal(pair, i + 3)
            return pair
        callee = re.split(r"\.|->|::", self._word(i - 1))[-1]
        if self._word(i + 2) == ")" and re.match(r"(?i)(?:set|with|add|use)_?(?=[a-z])", callee):
            pair = Pair(callee)
            self._literal(pair, i + 1)
            return pair
        return None

    def pairs(self) -> list[Pair]:
        out, upto = [], 0
        for i, (kind, start, end) in enumerate(self.tokens):
            pair = None
            if start < upto:  # an operator inside a bare value is part of it
                continue
            if kind == "op" and self.text[start:end] in _SETS:
                name = self.target(i)
                pair = self.value(i, name) if name else None
                upto = pair.literals[0][1] if pair is not None and not pair.quoted else upto
            elif kind == "mark" and self.text[start] == "(" and self._kind(i - 1) == "name":
                pair = self.called(i)
            if pair is not None:
                out.append(pair)
        text = self.text
        if "</" in text:
            out += [Pair(m[1], [m.span(2)]) for m in _TAGGED.finditer(text)]
        out += [Pair(m[1], [m.span(2)], [], False) for m in _FLAG.finditer(text)] if "-" in text else []
        if "://" in text:
            out += [Pair("url password", [m.span(1)]) for m in _USERINFO.finditer(text)]
        return out


def sensitivity(name: str) -> float:
    """0 to 1, by the words of a name in snake, kebab, dotted or camel case."""
    words = [w.lower() for w in _WORD.findall(name)]
    if not words:
        return 0.0
    best = max([SENSITIVE.get(w, 0.0) for w in words] + [SENSITIVE.get(f"{a} {b}", 0.0) for a, b in zip(words, words[1:], strict=False)])
    return 0.2 * best if words[-1] in ABOUT else best


def strength(literal: str, quoted: bool) -> float:
    """0 to 1, by entropy and kinds of characters; 0 for placeholders and what is too short."""
    n = len(literal)
    if n < SHORTEST or _PLACEHOLDER.match(literal):
        return 0.0
    bits = -sum(c * math.log2(c / n) for c in Counter(literal).values())
    plain = literal.isalpha()
    spaced = 0.5 if any(c.isspace() for c in literal) else 1.0
    return min(1.0, bits / 32) * spaced * (1.0 if not plain else 0.7 if quoted else 0.3)


def reach(pairs: list[Pair]) -> dict[str, float]:
    """Name -> the largest sensitivity among the names that its value gets to, ``STEP`` times less at each step."""
    feeds = defaultdict(list)  # used name -> targets
    best: dict[str, float] = {}
    for pair in pairs:
        best[pair.name] = max(best.get(pair.name, 0.0), sensitivity(pair.name))
        for name in pair.uses:
            feeds[pair.name].append(name)
    heap = [(-score, name) for name, score in best.items() if score > 0]
    heapq.heapify(heap)
    while heap:
        score, name = heapq.heappop(heap)
        if -score < best.get(name, 0.0):
            continue
        for used in feeds.pop(name, ()):
            if (handed := -score * STEP) > best.get(used, 0.0):
                best[used] = handed
                heapq.heappush(heap, (-handed, used))
    return best


def scan(text: str, least: float = LEAST) -> list[tuple[int, str, int, str | None, float]]:
    """(start, kind, end, target name, score) of all spans, by start, then kind as listed."""
    base = base_spans(text)
    found: dict[tuple[int, int], tuple[float, str]] = {}
    if _WORTH.search(text):
        pairs = Lexer(text).pairs()
        best = reach(pairs)
        assigned = {p.name for p in pairs}
        for pair in pairs:
            if best[pair.name] < least or not pair.quoted and assigned.intersection(pair.uses):  # that name's own literals count
                continue
            score = best[pair.name] * strength("".join(text[a:b] for a, b in pair.literals), pair.quoted)
            if score >= least:
                for span in pair.literals:
                    found[span] = max(found.get(span, (0.0, "")), (score, pair.name))
    held, k, upto = sorted((s, e) for s, _, e in base), 0, -1
    spans = [(s, kind, e, None, 1.0) for s, kind, e in base]
    for (a, b), (score, name) in sorted(found.items()):
        while k < len(held) and held[k][0] <= a:
            upto, k = max(upto, held[k][1]), k + 1
        if upto < b:
            spans.append((a, "literal", b, name, score))
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[1]), s[2]))


_FOUND = "doc_id long, starts array<long>, kinds array<string>, ends array<long>, names array<string>, scores array<double>"
_TYPES = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.float64()))


def _scan_batches(batches, least: float):
    for batch in batches:
        for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
            spans = [scan(text or "", least) for text in part.column("text").to_pylist()]
            columns = [part.column("doc_id").cast(pa.int64()), *([[s[k] for s in row] for row in spans] for k in range(5))]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], names=["doc_id", "starts", "kinds", "ends", "names", "scores"])


def find(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id and spans: an array of (kind, start, end, name, score), by start, then kind; plain spans have no name."""
    found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(partial(_scan_batches, least=least), _FOUND)
    spans = F.arrays_zip(F.col("kinds").alias("kind"), F.col("starts").alias("start"), F.col("ends").alias("end"), F.col("names").alias("name"), F.col("scores").alias("score"))
    return found.select("doc_id", spans.cast("array<struct<kind:string,start:bigint,end:bigint,name:string,score:double>>").alias("spans"))


def report(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return find(docs, least).select(
        "doc_id", *(of(k).alias(f"n_{k}") for k in KINDS[:3]), F.sha2(told(F.filter("spans", lambda s: s["kind"] != KINDS[3])), 256).alias("base_sha256"), told(F.col("spans")).alias("spans")
    )
