"""Secrets in whole texts: fixed patterns, and an assignment-aware lexer for source and configuration text.

The lexer reads names, literals and operators of whole statements, over as many lines as they take, pairs names with the
literals assigned to them, follows names of constants into later values (`key = base + "x"`), and scores each
literal by the words of the names it reaches and by its own form. Private keys in armour are found as a whole. Spans are counted in code points, the end excluded.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flowsight.llm.common import Batches, map_rows

#: Fixed patterns, in the order of their kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "literal")

#: How much a word in a name says that its value is secret.
NAME_SCORES = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "token": 0.9, "apikey": 1.0,
    "credential": 0.9, "credentials": 0.9, "privatekey": 1.0, "accesskey": 1.0, "secretkey": 1.0, "auth": 0.6,
    "bearer": 0.8, "signature": 0.5, "salt": 0.5, "key": 0.5, "pass": 0.6, "private": 0.4, "access": 0.3, "api": 0.3,
}
#: Words of names whose values are seldom secret although another word of the name is sensitive.
HARMLESS = {"public", "name", "file", "path", "url", "uri", "type", "id", "length", "size", "field", "label", "hint", "expires"}
PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|<.*>|\$\{.*\}|\{\{.*\}\}|%.*%|change.?me|example|none|null|true|false|undefined|todo|test|default|your.*|redacted)$")
#: Least score of a literal that is reported.
LEAST = 0.5

_TOKEN = re.compile(
    r"""
    [^\S\n]*
    (?:
    (?P<string>(?:[rbfu]{1,2}(?=["']))?(?:\"{3}(?P<s1>(?:[^\\]|\\.)*?)\"{3}|\'{3}(?P<s2>(?:[^\\]|\\.)*?)\'{3}
        |"(?P<s3>(?:[^"\\\n]|\\.)*)"|'(?P<s4>(?:[^'\\\n]|\\.)*)'|`(?P<s5>[^`]*)`))
    |(?P<name>[A-Za-z_$][\w$]*(?:[.-][A-Za-z_$][\w$]*)*)
    |(?P<number>\d[\w.]*)
    |(?P<compare>[=!<>]=+)
    |(?P<assign>:=|=>|=|:)
    |(?P<either>\|\||\?\?|\?:)
    |(?P<plus>\+|\.\.)
    |(?P<line>\\?\n)
    |(?P<other>\S)
    )
    """,
    re.X | re.A | re.I | re.S,
)
_BARE = re.compile(r"[A-Za-z0-9+/_.~@#$%^&*!-]+=*")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_SIGN = re.compile(r"[:=]|-----BEGIN |(?:getenv|environ[.]get|setdefault|getProperty)[(]")
_BLOCK = re.compile(r"[^\S\n]*[|>][+-]?\d?[^\S\n]*\n((?:[^\S\n]*\n)*([^\S\n]+)\S[^\n]*(?:\n(?:\2[^\n]*|[^\S\n]*(?=\n)))*)")
_KEY = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----")
_DEFAULTS = re.compile(r"(?:^|[.])(?:getenv|get|setdefault|environ[.]get|env|getProperty|config)$")
#: Words that stand before a name and its type, and names of operators.
_DECLARES = {"var", "const", "let", "val"}
_EITHER = {"or", "else"}
_OPEN, _CLOSE = {"(": ")", "[": "]"}, {")", "]"}


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) of the fixed patterns; matches that are too short are dropped."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return found + [(m.start(), m.end(), "hex") for m in HEX.finditer(text) if m.end() - m.start() >= 32]


def name_score(name: str) -> float:
    """How sensitive a name is, from its words; joined neighbours (api_key) count as one word too."""
    words = [w.lower() for w in _WORDS.findall(name)]
    joined = {a + b for a, b in zip(words, words[1:])}
    best = max((NAME_SCORES.get(w, 0.0) for w in [*words, *joined]), default=0.0)
    return best * (0.3 if HARMLESS & set(words) else 1.0)


def literal_score(value: str) -> float:
    """How much a literal looks like a secret: its length, its entropy and its kinds of characters."""
    if len(value) < 6 or PLACEHOLDER.match(value) or any(c.isspace() for c in value):
        return 0.0
    counts = Counter(value)
    entropy = -sum(n / len(value) * math.log2(n / len(value)) for n in counts.values())
    kinds = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    if kinds == 1 and value.isalpha():
        return 0.3 if entropy < 3.5 else 0.5
    return min(1.0, 0.4 + 0.1 * kinds + max(0.0, entropy - 2.0) * 0.15)


def quoted_score(value: str) -> float:
    """As literal_score; of a quoted text with blanks the longest word counts, and a short phrase is likely enough."""
    words = value.split()
    if len(words) < 2:
        return literal_score(value.strip())
    phrase = 0.6 if 8 <= len(value) <= 64 and len(words) <= 8 and not PLACEHOLDER.match(value) and value[-1] not in ".:?!" else 0.0
    return max([phrase, *(literal_score(w) for w in words if len(w) >= 16)])


Literal = tuple[int, int, str]


class Lexer:
    """Pairs of names and literals of one text, read as one stream of tokens from each line with a sign on.

    A value may be a quoted or triple-quoted string, a block of indented lines, several strings joined or in brackets, one of
    several alternatives, or stand on the next line; constants hold from their place on.
    """

    def __init__(self, text: str):
        self.text, self.constants = text, {}
        self.defaults: list[tuple[str, list[list[Literal]]]] = []
        self.tokens: list[tuple[str, str, int, int]] = []
        self.at = 0

    def pairs(self) -> Iterator[tuple[str, list[list[Literal]]]]:
        """Names assigned to, each with the alternatives of its value, which are lists of literals (start, end, value)."""
        text, end = self.text, -1
        for sign in _SIGN.finditer(text):
            if sign.start() < end:
                continue
            if sign[0][0] == "-":
                key = _KEY.match(text, sign.start())
                stop = text.find(f"-----END {key[1]}-----", key.end()) if key else -1
                if stop >= 0:
                    end = stop + len(key[1]) + 14
                    yield "private_key", [[(sign.start(), end, text[key.end() : stop])]]
                continue
            start = max(text.rfind("\n", 0, sign.start()) + 1, end)
            line_end = text.find("\n", sign.start())
            line_end = len(text) if line_end < 0 else line_end
            self.tokens, self.at = [], start
            i = 0
            while self._kind(i) not in ("line", None):
                if self.tokens[i][0] == "assign" and i:
                    names, i = self._targets(i), i + 1
                    if names:
                        i = yield from self._assigned(names, i)
                elif self.tokens[i][0] == "name" and self._is(i + 1, "(") and _DEFAULTS.search(self.tokens[i][1]):
                    i = self._default(i)
                else:
                    i += 1
                yield from self.defaults
                self.defaults = []
            end = max(line_end, self.tokens[i - 1][3] if 0 < i <= len(self.tokens) else 0)

    def _token(self, i: int) -> tuple[str, str, int, int] | None:
        while i >= len(self.tokens):
            found = _TOKEN.match(self.text, self.at)
            if found is None:
                return None
            kind, at = found.lastgroup, found.end()
            if kind in ("s1", "s2", "s3", "s4", "s5", "string"):
                part = next(g for g in ("s1", "s2", "s3", "s4", "s5") if found[g] is not None)
                self.tokens.append(("string", found[part], found.start(part), found.end(part)))
            else:
                self.tokens.append((kind, found[kind], found.start(kind), found.end(kind)))
            self.at = at
        return self.tokens[i]

    def _kind(self, i: int) -> str | None:
        token = self._token(i)
        return token[0] if token else None

    def _is(self, i: int, *texts: str) -> bool:
        token = self._token(i)
        return token is not None and token[0] != "string" and token[1] in texts

    def _targets(self, i: int) -> list[str]:
        """The name or names before a sign: the last name, the key in brackets, or several names with commas."""
        kind, text, _, _ = self.tokens[i - 1]
        if text == "]" and i >= 3 and self.tokens[i - 2][0] == "string":
            return [self.tokens[i - 2][1]]
        if kind == "string":
            return [text]
        if kind != "name":
            return []
        # In `var name type =` the name comes first, in `final Type name =` last.
        if i >= 3 and self.tokens[i - 2][0] == "name" and self.tokens[i - 3][1] in _DECLARES:
            return [max(self.tokens[i - 2][1], text, key=name_score)]
        names, j = [text], i - 2
        while j >= 1 and self.tokens[j][1] == "," and self.tokens[j - 1][0] == "name":
            names.insert(0, self.tokens[j - 1][1])
            j -= 2
        return names if j < 0 or len(names) == 1 else [text]

    def _annotation(self, i: int) -> int:
        """Past the type between a colon and an equals sign on the same line: name: Type = value."""
        if not self._is(i - 1, ":"):
            return i
        j = i
        while self._kind(j) == "name" or self._is(j, "&", "*", "<", ">", "[", "]", ".", "?", "|", ","):
            j += 1
        return j + 1 if j > i and self._is(j, "=") else i

    def _assigned(self, names: list[str], i: int):
        i = self._annotation(i)
        block = _BLOCK.match(self.text, self.tokens[i - 1][3]) if self.tokens[i - 1][1] == ":" else None
        if block and len(block[2]) > self._indent(self.tokens[i - 1][2]):
            yield names[-1], [[(block.start(1) + len(block[1]) - len(block[1].lstrip()), block.end(1), block[1].strip())]]
            self.tokens, self.at = self.tokens[:i], block.end(1)
            return i
        values, i = self._values(i)
        for name, alternatives in zip(names, values) if len(names) > 1 else [(names[0], sum(values, []))]:
            if alternatives:
                self.constants[name] = [x for literals in alternatives for x in literals]
                yield name, alternatives
        return i

    def _indent(self, at: int) -> int:
        start = self.text.rfind("\n", 0, at) + 1
        return len(self.text[start:at]) - len(self.text[start:at].lstrip())

    def _default(self, i: int) -> int:
        """A call such as getenv("NAME", "default") pairs its first string with the second; returns where the second is due."""
        if self._kind(i + 2) != "string" or not self._is(i + 3, ","):
            return i + 1
        if self._kind(i + 4) == "string":
            _, value, start, end = self.tokens[i + 4]
            self.defaults.append((self.tokens[i + 2][1], [[(start, end, value)]]))
        return i + 4

    def _values(self, i: int) -> tuple[list[list[list[Literal]]], int]:
        """Values after a sign, apart at commas; each has alternatives, each of them the literals that are joined in it."""
        values: list[list[list[Literal]]] = [[[]]]
        depth, wants = 0, True
        while True:
            kind = self._kind(i)
            if kind is None:
                break
            _, text, start, end = self.tokens[i]
            literals = values[-1][-1]
            if kind == "line":
                # A value goes on after the line's end inside brackets, after a backslash, or if none has come yet and a string
                # is next.
                nothing = wants and not any(v for value in values for v in value)
                if not (depth or text.startswith("\\") or (nothing and self._kind(i + 1) == "string" and self._kind(i + 2) != "assign")):
                    break
            elif kind == "string":
                if not wants and not depth:
                    break
                # In brackets a string before a colon is the name of another pair.
                if self._kind(i + 1) == "assign":
                    break
                literals.append((start, end, text))
                wants = False
            elif kind == "plus":
                wants = True
            elif kind == "either" or (kind == "name" and text in _EITHER):
                values[-1].append([])
                wants = True
            elif kind == "name" and text in self.constants and wants:
                # Each literal once: a constant added to itself must not grow without end.
                literals += [x for x in self.constants[text] if x not in literals]
                wants = False
            elif kind == "name" and wants and self._is(i + 1, "("):
                i = max(self._default(i) - 1, i + 1) if _DEFAULTS.search(text) else i + 1
                depth += 1
            elif text in _OPEN and wants:
                depth += 1
            elif text in _CLOSE and depth:
                depth -= 1
            elif text == "," and (depth or len(values[0][0])):
                if depth:
                    values[-1].append([])
                else:
                    values.append([[]])
                wants = True
            elif kind == "name" and wants and (self._kind(i + 1) == "either" or self._is(i + 1, *_EITHER)):
                wants = False
            else:
                bare = _BARE.match(self.text, start)
                # Words without a digit are prose or code, not an unquoted value.
                if wants and not depth and bare and any(c.isdigit() for c in bare[0]) and not any(v for value in values for v in value):
                    literals.append((start, bare.end(), bare[0]))
                    while self._token(i) is not None and self.tokens[i][2] < bare.end():
                        i += 1
                    wants = False
                    if self._is(i, ","):
                        continue
                break
            i += 1
        return [[literals for literals in value if literals] for value in values], i


def literal_spans(text: str, least: float = LEAST) -> list[tuple[int, int, str]]:
    """Literals that reach a sensitive name and look like a secret."""
    scores: dict[tuple[int, int], float] = {}
    for name, alternatives in Lexer(text).pairs():
        sensitive = name_score(name)
        for literals in alternatives if sensitive else ():
            # The parts of a value that is put together are judged as the whole.
            form = quoted_score("".join(value for _, _, value in literals))
            for start, end, _ in literals:
                scores[start, end] = max(scores.get((start, end), 0.0), sensitive * form)
    return [(start, end, "literal") for (start, end), score in scores.items() if score >= least and end > start]


def _written(spans: list[tuple[int, int, str]]) -> str:
    ordered = sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in ordered)


def scan(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs with n_assign, n_access, n_hex, base_sha256 and spans, one row per row of docs.

    spans lists kind:start:end of the fixed patterns and of the lexer's literals, by start, then kind; the counts and the
    SHA-256 are those of the fixed patterns alone. Null or empty text: no spans. Repeated rows give repeated results; columns
    of docs with these names are replaced. Empty table: no rows. Whole texts are read, row by row, without a shuffle.
    """
    added = ["n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    kept = [c for c in (keep or docs.columns) if c not in added]

    def run(batches: Batches) -> Batches:
        for batch in batches:
            out = []
            for text in batch["text"].to_pylist():
                base = base_spans(text or "")
                counts = Counter(kind for _, _, kind in base)
                digest = hashlib.sha256(_written(base).encode()).hexdigest()
                spans = _written(base + literal_spans(text or ""))
                out.append((counts["assign"], counts["access"], counts["hex"], digest, spans))
            columns = zip(*out) if out else [[] for _ in added]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.record_batch([*(batch[c] for c in kept), *(pa.array(c, t) for c, t in zip(columns, kinds))], [*kept, *added])

    schema = docs.select(*kept).schema
    for name, kind in zip(added, ["long", "long", "long", "string", "string"]):
        schema = schema.add(name, kind)
    return map_rows(docs.select(*dict.fromkeys([*kept, "text"])), run, schema)


def _blotted(text: str | None, spans: str, mark: str) -> str | None:
    if not spans:
        return text
    parts, at = [], 0
    for start, end in sorted(tuple(map(int, s.split(":")[1:])) for s in spans.split(",")):
        if start >= at:
            parts += [text[at:start], mark]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with each found span (joined where they overlap) replaced by a mark in text; n_chars counts the new text.

    Nulls, repeated rows and empty tables as in scan(); a column n_chars is only set if docs has one.
    """
    names = docs.columns
    schema = docs.schema

    def run(batches: Batches) -> Batches:
        for batch in batches:
            texts = [_blotted(t, _written(base_spans(t or "") + literal_spans(t or "")), mark) for t in batch["text"].to_pylist()]
            columns = {c: batch[c] for c in names} | {"text": pa.array(texts, pa.string())}
            if "n_chars" in columns:
                sizes = [None if t is None else len(t) for t in texts]
                columns["n_chars"] = pa.array(sizes, pa.int64()).cast(batch["n_chars"].type)
            yield pa.record_batch([columns[c] for c in names], names)

    return map_rows(docs, run, schema)
