"""Conditions of rules and sampling policies as a small typed language, read to a tree and then to a column.

`{{env}} = "prod" and not ($value > 2 or {{id}}.hashCode() % 10 = 1)`. Values are numbers, texts or truths:

* `{{key}}` is a tag (of annotations the first), or the name, source or message; a missing one is an empty text. `$value`, `$timestamp`,
  `$startMillis` and `$duration` are numbers, `time("10 minutes ago")` is epoch milliseconds at planning time.
* `+ - * / %` take numbers, or texts that are read as numbers where they are some; an impossible result (a division by zero, an
  overflow, a text that is no number) is unknown.
* `= != < <= > >=` compare two numbers, two texts or two truths; a text beside a number is read as one. Anything compared with
  what is unknown is false, but for `!=`, which is true. `startsWith`, `endsWith`, `contains` take two texts, `.hashCode()` one.
* `not` binds tighter than `and`, `and` than `or`; comparisons stand once between sums. The whole is a truth.

What the grammar or these kinds don't allow is a ConditionError when the rule is read; no row's data can raise one later.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER, TEXT, TRUTH = "number", "text", "truth"
FIELDS = {"$value": "value", "$timestamp": "ts_ms", "$startMillis": "start_ms", "$duration": "duration_ms"}
NAMES = {"metricName": "name", "spanName": "name", "sourceName": "source", "message": "name"}
UNIT_MS = {"second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000, "week": 604_800_000}
_SYMBOL = re.compile(
    r"""\s*(?:(?P<text>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|\{\{(?P<scope>[^{}]+)\}\}|(?P<hash>\.\s*hashCode\s*\(\s*\))
    |(?P<number>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<field>\$\w+)|(?P<word>[A-Za-z]+)|(?P<sign>!=|<=|>=|==|[=<>%+*/()-])|(?P<end>$))""",
    re.VERBOSE | re.DOTALL,
)
_AGO = re.compile(r"\s*(\d+)\s+(second|minute|hour|day|week)s?\s+ago\s*")


class ConditionError(ValueError):
    """A condition that can't be read."""


@dataclass(frozen=True)
class Node:
    op: str
    kind: str
    of: tuple[Node, ...] = ()
    value: object = None


class _Reader:
    def __init__(self, text: str):
        self.symbols: list[tuple[str, str]] = []
        at = 0
        while not self.symbols or self.symbols[-1][0] != "end":
            m = _SYMBOL.match(text, at)
            if not m:
                raise ConditionError(f"{text[at : at + 20].strip()!r} is not known")
            self.symbols.append((str(m.lastgroup), m[str(m.lastgroup)]))
            at = m.end()
        self.at = 0

    def take(self, kind: str, *values: str) -> str | None:
        found, value = self.symbols[self.at]
        lowered = value.lower() if kind == "word" else value
        if found != kind or values and lowered not in values:
            return None
        self.at += 1
        return lowered if kind == "word" else value

    def need(self, sign: str) -> None:
        if self.take("sign", sign) is None:
            raise ConditionError(f"{sign} is missing before {self.symbols[self.at][1] or 'the end'!r}")

    def either(self, word: str, part) -> Node:
        left = part()
        while self.take("word", word):
            left = Node(word, TRUTH, (_of(left, word, TRUTH), _of(part(), word, TRUTH)))
        return left

    def whole(self) -> Node:
        return self.either("or", lambda: self.either("and", self.negated))

    def negated(self) -> Node:
        if self.take("word", "not"):
            return Node("not", TRUTH, (_of(self.negated(), "not", TRUTH),))
        return self.comparison()

    def comparison(self) -> Node:
        left = self.sum()
        if sign := self.take("sign", "=", "==", "!=", "<", "<=", ">", ">="):
            right = self.sum()
            kinds = {left.kind, right.kind}
            if TRUTH in kinds and (len(kinds) > 1 or sign not in ("=", "==", "!=")):
                raise ConditionError(f"{sign} does not compare a {left.kind} and a {right.kind}")
            return Node("=" if sign == "==" else sign, TRUTH, (left, right))
        if word := self.take("word", "startswith", "endswith", "contains"):
            return Node(word, TRUTH, (_of(left, word, TEXT), _of(self.sum(), word, TEXT)))
        return left

    def sum(self) -> Node:
        return self.chain(("+", "-"), lambda: self.chain(("*", "/", "%"), self.signed))

    def chain(self, signs: tuple[str, ...], part) -> Node:
        left = part()
        while sign := self.take("sign", *signs):
            left = Node(sign, NUMBER, (_of(left, sign, NUMBER, TEXT), _of(part(), sign, NUMBER, TEXT)))
        return left

    def signed(self) -> Node:
        if self.take("sign", "-"):
            return Node("-", NUMBER, (Node("number", NUMBER, value=0), _of(self.signed(), "-", NUMBER, TEXT)))
        out = self.single()
        while self.take("hash"):
            out = Node("hash", NUMBER, (_of(out, ".hashCode()", TEXT),))
        return out

    def single(self) -> Node:
        if self.take("sign", "("):
            out = self.whole()
            self.need(")")
            return out
        if (text := self.take("text")) is not None:
            return Node("text", TEXT, value=re.sub(r"(?s)\\(.)", r"\1", text[1:-1]))
        if (scope := self.take("scope")) is not None:
            return Node("scope", TEXT, value=scope)
        if number := self.take("number"):
            plain = number.isdigit() and int(number) < 1 << 63
            return Node("number", NUMBER, value=int(number) if plain else float(number))
        if field := self.take("field"):
            if field not in FIELDS:
                raise ConditionError(f"{field} is not known")
            return Node("field", NUMBER, value=FIELDS[field])
        if word := self.take("word", "true", "false"):
            return Node("truth", TRUTH, value=word == "true")
        if self.take("word", "time"):
            self.need("(")
            m = _AGO.fullmatch((self.take("text") or "  ")[1:-1])
            if not m:
                raise ConditionError("time takes a text such as '10 minutes ago'")
            self.need(")")
            return Node("ago", NUMBER, value=int(m[1]) * UNIT_MS[m[2]])
        found = self.symbols[self.at][1]
        raise ConditionError(f"{found!r} is not known here" if found else "it ends too early")


def _of(node: Node, what: str, *kinds: str) -> Node:
    if node.kind not in kinds:
        raise ConditionError(f"{what} does not take a {node.kind}")
    return node


def read(text: str) -> Node:
    """The tree of a condition, or a ConditionError."""
    reader = _Reader(text)
    try:
        out = _of(reader.whole(), "a condition", TRUTH)
    except RecursionError as e:
        raise ConditionError("it is nested too deep") from e
    if reader.symbols[reader.at][0] != "end":
        raise ConditionError(f"nothing may follow before {reader.symbols[reader.at][1]!r}")
    return out


def java_hash(text: Column) -> Column:
    """The sum of a text's UTF-16 units times powers of 31, as a signed number of 32 bits."""
    points = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c))
    pair = lambda p: F.array(F.lit(55232) + F.shiftright(p, 10), F.lit(56320) + p.bitwiseAND(1023))
    units = F.flatten(F.transform(points, lambda p: F.when(p > 65535, pair(p)).otherwise(F.array(p))))
    return F.aggregate(units, F.lit(0).cast("long"), lambda h, u: (h * 31 + u).bitwiseAND(4294967295), lambda h: F.when(h > 2147483647, h - 4294967296).otherwise(h))


def _number(node: Node, kind: str) -> Column:
    out = column(node, kind)
    return out.try_cast("double") if node.kind == TEXT else out


def column(node: Node, kind: str) -> Column:
    """The tree as a column over records of the kind (point: tags are a map; else a list of annotations)."""
    a = node.of
    match node.op:
        case "text" | "truth" | "number":
            return F.lit(node.value)
        case "field":
            return F.col(str(node.value))
        case "ago":
            return F.unix_millis(F.current_timestamp()) - F.lit(node.value)
        case "scope":
            key = str(node.value)
            tags = F.col("tags")
            tag = tags[F.lit(key)] if kind == "point" else F.get(F.filter(tags, lambda x: x["key"] == key), F.lit(0))["value"]
            return F.coalesce(F.col(NAMES[key]) if key in NAMES else tag, F.lit(""))
        case "hash":
            return java_hash(column(a[0], kind))
        case "not":
            return ~column(a[0], kind)
        case "and":
            return column(a[0], kind) & column(a[1], kind)
        case "or":
            return column(a[0], kind) | column(a[1], kind)
        case "startswith" | "endswith" | "contains":
            x, y = column(a[0], kind), column(a[1], kind)
            return {"startswith": F.startswith, "endswith": F.endswith, "contains": F.contains}[node.op](x, y)
        case "+" | "-" | "*" | "/" | "%":
            x, y = _number(a[0], kind), _number(a[1], kind)
            return {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply, "/": F.try_divide, "%": F.try_mod}[node.op](x, y)
    both = a[0].kind == a[1].kind != NUMBER
    x, y = (column(n, kind) if both else _number(n, kind) for n in a)
    if node.op == "!=":
        return ~F.coalesce(x == y, F.lit(False))
    found = {"=": x == y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[node.op]
    return F.coalesce(found, F.lit(False))


def condition(text: str, kind: str) -> Column:
    return column(read(text), kind)
