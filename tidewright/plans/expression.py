"""User-written scalar expressions: a small parser that builds Columns, with an allow-list instead of evaluating text.

One expression, at most 1000 characters, without semicolons or comments; known columns only, unqualified; the functions listed
here; CAST never fails but gives null. The placeholder source_col stands for the rule's source column.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_LENGTH, MAX_LITERAL = 1000, 4000
PLACEHOLDER = "source_col"
_TOKEN = re.compile(r"\s*(?:(?P<num>\d+(?:\.\d+)?)|(?P<str>'(?:[^']|'')*')|(?P<quoted>\"(?:[^\"]|\"\")+\")|(?P<name>[A-Za-z_][A-Za-z0-9_]*)|(?P<op>\|\||<>|!=|<=|>=|[-+*/%(),=<>]))")
_TYPES = {
    "VARCHAR": "string", "CHAR": "string", "TEXT": "string", "STRING": "string", "INTEGER": "int", "INT": "int", "SMALLINT": "smallint", "BIGINT": "bigint",
    "DOUBLE": "double", "FLOAT": "double", "DECIMAL": "decimal(38,10)", "NUMERIC": "decimal(38,10)", "DATE": "date", "TIMESTAMP": "timestamp_ntz", "BOOLEAN": "boolean",
}


class RuleError(ValueError):
    """The expression is not allowed or not well formed."""


@dataclass(frozen=True)
class Literal:
    value: object


def _size(x) -> Column:
    """A length argument: a literal of 0 to 4000, or any expression."""
    if isinstance(x, Literal) and (not isinstance(x.value, int) or not 0 <= x.value <= MAX_LITERAL):
        raise RuleError(f"a length must be a whole number from 0 to {MAX_LITERAL}")
    return _col(x)


def _start(x) -> Column:
    if isinstance(x, Literal) and (not isinstance(x.value, int) or x.value < 1):
        raise RuleError("positions count from 1")
    return _col(x)


def _col(x) -> Column:
    return F.lit(x.value) if isinstance(x, Literal) else x


def _pad(left: bool) -> Callable:
    def run(c, n, fill=Literal(" ")):
        if not isinstance(n, Literal) or not isinstance(fill, Literal):
            raise RuleError("padding needs a literal length and character")
        _size(n)
        return (F.lpad if left else F.rpad)(_col(c).cast("string"), n.value, str(fill.value))

    return run


def _decode(value, *rest):
    pairs, other = list(zip(rest[::2], rest[1::2])), rest[-1] if len(rest) % 2 else Literal(None)
    out = _col(other)
    for when, then in reversed(pairs):
        out = F.when(_col(value).eqNullSafe(_col(when)), _col(then)).otherwise(out)
    return out


def _round(c, n=Literal(0)):
    if not isinstance(n, Literal):
        raise RuleError("ROUND needs a literal number of digits")
    return F.round(_col(c), n.value)


def _many(f: Callable) -> Callable:
    return lambda *xs: f(*[_col(x) for x in xs])


FUNCTIONS: dict[str, tuple[int, int, Callable]] = {
    "TRIM": (1, 1, _many(F.trim)), "LTRIM": (1, 1, _many(F.ltrim)), "RTRIM": (1, 1, _many(F.rtrim)), "UPPER": (1, 1, _many(F.upper)), "LOWER": (1, 1, _many(F.lower)),
    "INITCAP": (1, 1, _many(F.initcap)), "LPAD": (2, 3, _pad(True)), "RPAD": (2, 3, _pad(False)), "PAD": (2, 3, _pad(True)),
    "SUBSTRING": (2, 3, lambda c, s, n=Literal(MAX_LITERAL): F.substring(_col(c), _start(s), _size(n))),
    "SUBSTR": (2, 3, lambda c, s, n=Literal(MAX_LITERAL): F.substring(_col(c), _start(s), _size(n))),
    "LEFT": (2, 2, lambda c, n: F.left(_col(c), _size(n))), "RIGHT": (2, 2, lambda c, n: F.right(_col(c), _size(n))),
    "CONCAT": (1, 50, lambda *xs: F.concat(*[F.coalesce(_col(x).cast("string"), F.lit("")) for x in xs])),
    "CONCAT_WS": (2, 50, lambda sep, *xs: F.concat_ws(str(sep.value), *[_col(x).cast("string") for x in xs])),
    "COALESCE": (1, 50, _many(F.coalesce)), "NVL": (2, 2, _many(F.coalesce)), "NVL2": (3, 3, lambda a, b, c: F.when(_col(a).isNotNull(), _col(b)).otherwise(_col(c))),
    "NULLIF": (2, 2, _many(F.nullif)), "IF": (3, 3, lambda a, b, c: F.when(_col(a), _col(b)).otherwise(_col(c))), "LENGTH": (1, 1, _many(F.length)),
    "ABS": (1, 1, _many(F.abs)), "ROUND": (1, 2, _round), "FLOOR": (1, 1, _many(F.floor)), "CEIL": (1, 1, _many(F.ceil)), "MOD": (2, 2, lambda a, b: _col(a) % _col(b)),
    "REPLACE": (3, 3, _many(F.replace)), "REGEXP_REPLACE": (3, 4, lambda c, p, r, *flags: F.regexp_replace(_col(c), _col(p), _col(r))), "REVERSE": (1, 1, _many(F.reverse)),
    "TRANSLATE": (3, 3, lambda c, a, b: F.translate(_col(c), str(a.value), str(b.value))), "STRPOS": (2, 2, lambda a, b: F.locate(str(b.value), _col(a))),
    "INSTR": (2, 2, lambda a, b: F.locate(str(b.value), _col(a))), "GREATEST": (2, 50, _many(F.greatest)), "LEAST": (2, 50, _many(F.least)), "DECODE": (3, 100, _decode),
    "TO_NUMBER": (1, 1, lambda c: _col(c).try_cast("decimal(38,10)")), "TO_CHAR": (1, 1, lambda c: _col(c).cast("string")),
    "TO_DATE": (1, 2, lambda c, f=Literal("yyyy-MM-dd"): F.try_to_timestamp(_col(c), _col(f)).cast("date")),
    "STRPTIME": (2, 2, lambda c, f: F.try_to_timestamp(_col(c), F.lit(java_format(str(f.value))))),
    "STRFTIME": (2, 2, lambda c, f: F.date_format(_col(c), java_format(str(f.value)))),
}
#: Functions whose result holds other characters than their input.
CHANGES_CONTENT = frozenset("LPAD RPAD PAD SUBSTRING SUBSTR LEFT RIGHT REPLACE REGEXP_REPLACE TRANSLATE REVERSE CONCAT CONCAT_WS DECODE UPPER LOWER INITCAP".split())


def java_format(form: str) -> str:
    """The pattern letters for a strptime format; single letters read one or two digits."""
    letters = {"%Y": "yyyy", "%m": "M", "%d": "d", "%H": "H", "%M": "m", "%S": "s", "%b": "MMM", "%y": "yy"}
    return re.sub(r"%.", lambda m: letters.get(m[0], ""), form)


class _Parser:
    def __init__(self, text: str, columns: dict[str, Column]):
        if len(text) > MAX_LENGTH:
            raise RuleError(f"an expression has at most {MAX_LENGTH} characters")
        bare = re.sub(r"'(?:[^']|'')*'", "''", text)
        if ";" in bare or "--" in bare or "/*" in bare:
            raise RuleError("one expression, without comments")
        self.columns, self.used, self.called = columns, set(), set()
        self.tokens, at = [], 0
        while at < len(text.rstrip()):
            m = _TOKEN.match(text, at)
            if not m:
                raise RuleError(f"unexpected {text[at : at + 10]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.i = 0

    def peek(self, n: int = 0) -> tuple[str, str]:
        return self.tokens[self.i + n] if self.i + n < len(self.tokens) else ("end", "")

    def word(self, *words: str) -> bool:
        kind, text = self.peek()
        if kind == "name" and text.upper() in words or kind == "op" and text in words:
            self.i += 1
            return True
        return False

    def need(self, word: str) -> None:
        if not self.word(word):
            raise RuleError(f"{word} is missing before {self.peek()[1]!r}")

    def parse(self):
        out = self.either()
        if self.peek()[0] != "end":
            raise RuleError(f"unexpected {self.peek()[1]!r}")
        return out

    def either(self):
        out = self.both()
        while self.word("OR"):
            out = _col(out) | _col(self.both())
        return out

    def both(self):
        out = self.negation()
        while self.word("AND"):
            out = _col(out) & _col(self.negation())
        return out

    def negation(self):
        return ~_col(self.negation()) if self.word("NOT") else self.comparison()

    def comparison(self):
        left = self.sum()
        for sign in ("=", "<>", "!=", "<=", ">=", "<", ">"):
            if self.word(sign):
                a, b = _col(left), _col(self.sum())
                return {"=": a == b, "<>": a != b, "!=": a != b, "<=": a <= b, ">=": a >= b, "<": a < b, ">": a > b}[sign]
        if self.word("IS"):
            no = self.word("NOT")
            self.need("NULL")
            return _col(left).isNotNull() if no else _col(left).isNull()
        no = self.word("NOT")
        if self.word("IN"):
            self.need("(")
            values = [_col(self.sum())]
            while self.word(","):
                values.append(_col(self.sum()))
            self.need(")")
            out = _col(left).isin(*values)
        elif self.word("LIKE"):
            pattern = self.sum()
            if not isinstance(pattern, Literal):
                raise RuleError("LIKE needs a literal")
            out = _col(left).like(str(pattern.value))
        elif self.word("BETWEEN"):
            a = _col(self.sum())
            self.need("AND")
            out = _col(left).between(a, _col(self.sum()))
        elif no:
            raise RuleError("NOT what?")
        else:
            return left
        return ~out if no else out

    def sum(self):
        out = self.product()
        while True:
            if self.word("+"):
                out = _col(out) + _col(self.product())
            elif self.word("-"):
                out = _col(out) - _col(self.product())
            elif self.word("||"):
                out = F.concat(_col(out).cast("string"), _col(self.product()).cast("string"))
            else:
                return out

    def product(self):
        out = self.unary()
        while True:
            if self.word("*"):
                out = _col(out) * _col(self.unary())
            elif self.word("/"):
                b = _col(self.unary())
                out = _col(out) / F.nullif(b, F.lit(0))
            elif self.word("%"):
                out = _col(out) % _col(self.unary())
            else:
                return out

    def unary(self):
        if self.word("-"):
            x = self.unary()
            return Literal(-x.value) if isinstance(x, Literal) else -x
        return self.atom()

    def atom(self):
        kind, text = self.peek()
        self.i += 1
        if kind == "num":
            return Literal(float(text) if "." in text else int(text))
        if kind == "str":
            return Literal(text[1:-1].replace("''", "'"))
        if kind == "quoted":
            return self.column(text[1:-1].replace('""', '"'))
        if kind == "op" and text == "(":
            out = self.either()
            self.need(")")
            return out
        if kind == "name":
            upper = text.upper()
            if upper == "CASE":
                return self.case()
            if upper in ("NULL", "TRUE", "FALSE"):
                return Literal({"NULL": None, "TRUE": True, "FALSE": False}[upper])
            if self.word("("):
                return self.cast() if upper in ("CAST", "TRY_CAST") else self.call(upper)
            return self.column(text)
        raise RuleError(f"unexpected {text!r}" if text else "the expression ends too early")

    def column(self, name: str) -> Column:
        found = self.columns.get(name.lower())
        if found is None:
            raise RuleError(f"unknown column {name}")
        self.used.add(name.lower())
        return found

    def case(self) -> Column:
        subject = None if self.peek()[1].upper() == "WHEN" else self.either()
        arms = []
        while self.word("WHEN"):
            cond = self.either()
            cond = _col(cond) if subject is None else _col(subject) == _col(cond)
            self.need("THEN")
            arms.append((cond, _col(self.either())))
        if not arms:
            raise RuleError("CASE without WHEN")
        out = _col(self.either()) if self.word("ELSE") else F.lit(None)
        self.need("END")
        for cond, then in reversed(arms):
            out = F.when(cond, then).otherwise(out)
        return out

    def cast(self) -> Column:
        value = self.either()
        self.need("AS")
        kind, name = self.peek()
        self.i += 1
        target = _TYPES.get(name.upper()) if kind == "name" else None
        if target is None:
            raise RuleError(f"unknown type {name}")
        if self.word("("):
            numbers = [self.atom().value]
            while self.word(","):
                numbers.append(self.atom().value)
            self.need(")")
            if target.startswith("decimal"):
                target = f"decimal({', '.join(map(str, numbers))})"
        self.need(")")
        return _col(value).try_cast(target)

    def call(self, name: str):
        if name not in FUNCTIONS:
            raise RuleError(f"function {name} is not allowed")
        least, most, build = FUNCTIONS[name]
        args = []
        if not self.word(")"):
            args.append(self.either())
            while self.word(","):
                args.append(self.either())
            self.need(")")
        if not least <= len(args) <= most:
            raise RuleError(f"{name} takes {least} to {most} arguments")
        self.called.add(name)
        return build(*args)


def compile_rule(text: str, columns: dict[str, Column], source: str | None = None) -> Column:
    """The expression as a Column of text. columns: by lower-case name; source: the column that source_col stands for."""
    known = dict(columns)
    if source is not None:
        known[PLACEHOLDER] = columns[source.lower()]
    return _col(_Parser(text, known).parse()).cast("string")


def content_functions(text: str, columns: list[str]) -> set[str]:
    """The functions of an expression that change what a value says."""
    p = _Parser(text, {c.lower(): F.lit(None).cast("string") for c in [*columns, PLACEHOLDER]})
    p.parse()
    return p.called & CHANGES_CONTENT


def refuse(text: str, columns: list[str]) -> str | None:
    """Why an expression is not allowed; None if it is."""
    try:
        compile_rule(text, {c.lower(): F.lit(None).cast("string") for c in [*columns, PLACEHOLDER]})
    except RuleError as e:
        return str(e)
    return None
