"""Rules over points, spans and logs (P1-P17): declared as dictionaries, compiled to DataFrame projections.

A record has `name` (metric name, span name or message), `source`, `tags` and, where the wire line is at hand,
`line`. tags is a map for points and a list of (key, value) annotations for spans and logs, where a key may occur
more than once. Rules set `status`: null goes on, `rejected` with the rule as `reason`. Rules apply in order, and
a rejected record is no longer changed.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tags as T
from . import conditions

KINDS = ("point", "span", "log")
SCOPES = {"metricName": "name", "spanName": "name", "message": "name", "sourceName": "source", "pointLine": "line", "inputText": "line", "spanLine": "line", "logLine": "line"}
#: Actions by the name they have without their prefix, with the arguments they need and may have.
ACTIONS = {
    "replaceRegex": ({"scope", "search", "replace"}, {"match", "iterations", "firstMatchOnly"}),
    "allow": (set(), {"scope", "match"}),
    "block": (set(), {"scope", "match"}),
    "forceLowercase": ({"scope"}, {"match", "firstMatchOnly"}),
    "dropTag": ({"tag"}, {"match", "firstMatchOnly"}),
    "addTag": ({"tag", "value"}, set()),
    "addTagIfNotExists": ({"tag", "value"}, set()),
    "extractTag": ({"tag", "source", "search", "replace"}, {"match", "replaceInput", "firstMatchOnly"}),
    "extractTagIfNotExists": ({"tag", "source", "search", "replace"}, {"match", "replaceInput", "firstMatchOnly"}),
    "renameTag": ({"tag", "newtag"}, {"match", "firstMatchOnly"}),
    "limitLength": ({"scope", "actionSubtype", "maxLength"}, {"match", "firstMatchOnly"}),
    "count": (set(), set()),
    "allowTag": ({"allow"}, set()),
    "metricsFilter": ({"function", "names"}, {"opts"}),
}
#: Names of arguments and actions that mean another one.
SAME_ARGUMENT = {"key": "tag", "newkey": "newtag", "input": "source"}
SAME_ACTION = {
    "logWhitelistRegex": "logAllow", "logBlacklistRegex": "logBlock", "whitelistRegex": "allow", "blacklistRegex": "block", "spanWhitelistRegex": "spanAllow", "spanBlacklistRegex": "spanBlock",
}
COMPARE: dict[str, Callable[[Column, str], Column]] = {
    "equals": lambda c, v: c == v,
    "startsWith": lambda c, v: c.startswith(v),
    "endsWith": lambda c, v: c.endswith(v),
    "contains": lambda c, v: c.contains(v),
    "regexMatch": lambda c, v: c.rlike(f"^(?:{v})$"),
}


class RuleError(ValueError):
    """A rule that can't be compiled."""


@dataclass(frozen=True)
class Rule:
    name: str
    kind: str
    action: str
    arguments: dict
    condition: dict | str | None = None


def parse(raw: dict) -> Rule:
    """One rule from its dictionary, or a RuleError that says what is wrong. Action names are case-sensitive."""
    if not isinstance(raw, dict) or not raw:
        raise RuleError("empty rule")
    name = re.sub(r"[^a-zA-Z0-9_\- ]", "", str(raw.get("rule") or ""))
    if not name:
        raise RuleError("a rule needs a name")
    action = raw.get("action")
    if not action:
        raise RuleError(f"{name}: no action")
    action = SAME_ACTION.get(action, action)
    kind = next((k for k in ("span", "log") if re.match(rf"{k}[A-Z]", action)), "point")
    plain = action if kind == "point" else action[len(kind)].lower() + action[len(kind) + 1 :]
    plain = re.sub(r"Annotation", "Tag", plain)
    if plain not in ACTIONS or (plain == "metricsFilter" and kind != "point"):
        raise RuleError(f"{name}: unknown action {raw['action']}")
    given = {SAME_ARGUMENT.get(k, k): v for k, v in raw.items() if k not in ("rule", "action", "if")}
    need, may = ACTIONS[plain]
    if unknown := set(given) - need - may:
        raise RuleError(f"{name}: {plain} does not take {', '.join(sorted(unknown))}")
    if missing := {k for k in need if given.get(k) is None or given[k] == "" and k != "replace"}:
        raise RuleError(f"{name}: {plain} needs {', '.join(sorted(missing))}")
    condition = raw.get("if")
    if plain in ("allow", "block") and condition is None and not (given.get("scope") and given.get("match")):
        raise RuleError(f"{name}: {plain} needs scope and match, or a condition")
    if plain in ("allow", "block") and bool(given.get("scope")) != bool(given.get("match")):
        raise RuleError(f"{name}: scope and match go together")
    if plain == "limitLength":
        if given["actionSubtype"] not in ("truncate", "truncateWithEllipsis", "drop"):
            raise RuleError(f"{name}: actionSubtype {given['actionSubtype']}")
        if int(given["maxLength"]) < (4 if given["actionSubtype"] == "truncateWithEllipsis" else 1):
            raise RuleError(f"{name}: maxLength is too small")
        if given["actionSubtype"] == "drop" and given["scope"] in SCOPES:
            raise RuleError(f"{name}: only tags can be dropped")
    if plain == "metricsFilter" and given["function"] not in ("allow", "drop"):
        raise RuleError(f"{name}: function {given['function']}")
    for key in ("match", "search"):
        if key in given:
            try:
                re.compile(str(given[key]))
            except re.error as e:
                raise RuleError(f"{name}: {key} is not a pattern ({e})") from e
    if isinstance(condition, dict):
        predicate_tree(condition, lambda _: F.lit(""), check_only=True)
    elif condition is not None:
        _condition(name, str(condition))
    return Rule(name, kind, plain, given, condition)


def _condition(rule: str, text: str) -> None:
    try:
        conditions.read(text)
    except conditions.ConditionError as e:
        raise RuleError(f"{rule}: condition: {e}") from e


def predicate_tree(tree: dict, scope: Callable[[str], Column] | None, check_only: bool = False) -> Column | None:
    """All / any / none / ignore over comparisons with one value or a list of values."""
    if len(tree) != 1:
        raise RuleError("a condition has one operator at its top")
    op, body = next(iter(tree.items()))
    if op in ("all", "any", "none", "ignore"):
        items = body if isinstance(body, list) else [body]
        if op == "ignore":
            return None if check_only else F.lit(True)
        parts = [predicate_tree(x, scope, check_only) for x in items]
        if check_only:
            return None
        joined = reduce(lambda a, b: a & b if op == "all" else a | b, parts)
        return ~joined if op == "none" else joined
    if op not in COMPARE or not isinstance(body, dict) or "scope" not in body or "value" not in body:
        raise RuleError(f"condition {op} is not known or lacks scope or value")
    if check_only:
        return None
    values = body["value"] if isinstance(body["value"], list) else [body["value"]]
    column = scope(body["scope"])
    return F.coalesce(reduce(lambda a, b: a | b, (COMPARE[op](column, str(v)) for v in values)), F.lit(False))


def _full(column: Column, pattern: str) -> Column:
    return F.coalesce(column.rlike(f"^(?:{pattern})$"), F.lit(False))


class Compiler:
    """Steps of one record kind."""

    def __init__(self, kind: str):
        self.kind, self.as_map = kind, kind == "point"

    def read(self, scope: str) -> Column:
        if scope in SCOPES:
            return F.col(SCOPES[scope])
        return F.col("tags")[scope] if self.as_map else T.first_value(F.col("tags"), scope)

    def change(self, scope: str, change: Callable[[Column], Column], when: Column) -> dict[str, Column]:
        """The columns that change where `when` holds: the scope's text becomes change(text); every annotation with the key does."""
        if scope in SCOPES:
            c = SCOPES[scope]
            return {c: F.when(when & F.col(c).isNotNull(), change(F.col(c))).otherwise(F.col(c))}
        if self.as_map:
            changed = F.transform_values("tags", lambda k, v: F.when(k == scope, change(v)).otherwise(v))
        else:
            changed = F.transform("tags", lambda a: F.when(a["key"] == scope, T.annotation(a["key"], change(a["value"]))).otherwise(a))
        return {"tags": F.when(when, changed).otherwise(F.col("tags"))}

    def add(self, key: str, value: Column, keep_old: bool) -> Column:
        tags = F.col("tags")
        if self.as_map:
            return T.put(tags, key, value, keep_old)
        has = F.exists(tags, lambda a: a["key"] == key)
        added = T.append(tags, key, value)
        return F.when(has, tags).otherwise(added) if keep_old else added

    def filter_tags(self, keep: Callable[[Column, Column], Column]) -> Column:
        return F.map_filter("tags", keep) if self.as_map else F.filter("tags", lambda a: keep(a["key"], a["value"]))

    def condition(self, rule: Rule) -> Column:
        if rule.condition is None:
            return F.lit(True)
        if isinstance(rule.condition, str):
            return conditions.condition(rule.condition, self.kind)
        return predicate_tree(rule.condition, self.read)

    def step(self, rule: Rule) -> dict[str, Column]:
        a, on = rule.arguments, F.col("status").isNull() & self.condition(rule)
        tags = F.col("tags")
        reject = lambda bad: {"status": F.when(bad, F.lit("rejected")).otherwise(F.col("status")), "reason": F.when(bad, F.lit(rule.name)).otherwise(F.col("reason"))}
        match rule.action:
            case "replaceRegex":
                if a.get("match"):
                    on &= _full(self.read(a["scope"]), a["match"])
                if a.get("firstMatchOnly"):
                    once = lambda c: F.regexp_replace(c, f"^(?s)(.*?)(?:{a['search']})", "$1" + _shifted(str(a["replace"])))
                else:
                    once = lambda c: F.regexp_replace(c, str(a["search"]), str(a["replace"]))
                return self.change(a["scope"], lambda c: reduce(lambda x, _: once(x), range(int(a.get("iterations", 1))), c), on)
            case "allow" | "block":
                hit = _full(self.read(a["scope"]), a["match"]) if a.get("scope") else F.lit(True)
                if rule.action == "block":
                    return reject(on & hit)
                return reject(F.col("status").isNull() & ~(hit & self.condition(rule))) if rule.condition is not None else reject(on & ~hit)
            case "forceLowercase":
                return self.change(a["scope"], lambda c: F.when(_full(c, a["match"]), F.lower(c)).otherwise(c) if a.get("match") else F.lower(c), on)
            case "dropTag":
                gone = lambda k, v: _full(k, a["tag"]) & (_full(v, a["match"]) if a.get("match") else F.lit(True))
                return {"tags": F.when(on, self.filter_tags(lambda k, v: ~gone(k, v))).otherwise(tags)}
            case "addTag" | "addTagIfNotExists":
                return {"tags": F.when(on, self.add(a["tag"], self.template(str(a["value"])), rule.action != "addTag")).otherwise(tags)}
            case "extractTag" | "extractTagIfNotExists":
                text = self.read(a["source"])
                found = on & F.coalesce(text.rlike(a["search"]), F.lit(False))
                if a.get("match"):
                    found &= _full(text, a["match"])
                if rule.action != "extractTag":
                    found &= self.read(a["tag"]).isNull()
                value = F.regexp_replace(text, a["search"], str(a["replace"]))
                out = {"tags": F.when(found & (value != ""), self.add(a["tag"], value, rule.action != "extractTag")).otherwise(tags)}
                if a.get("replaceInput") is not None:
                    changed = self.change(a["source"], lambda c: F.regexp_replace(c, a["search"], str(a["replaceInput"])), found)
                    if "tags" in changed:
                        raise RuleError(f"{rule.name}: replaceInput needs a name or source as input")
                    out |= changed
                return out
            case "renameTag":
                new = str(a["newtag"])
                if self.as_map:
                    moved = T.rename(tags, a["tag"], new, (lambda t: _full(t[a["tag"]], a["match"])) if a.get("match") else None)
                else:
                    moved = F.transform(tags, lambda x: F.when((x["key"] == a["tag"]) & (_full(x["value"], a["match"]) if a.get("match") else F.lit(True)), T.annotation(new, x["value"])).otherwise(x))
                return {"tags": F.when(on, moved).otherwise(tags)}
            case "limitLength":
                n, how = int(a["maxLength"]), a["actionSubtype"]
                if a.get("match"):
                    on &= _full(self.read(a["scope"]), a["match"])
                if how == "drop":
                    return {"tags": F.when(on, self.filter_tags(lambda k, v: ~((k == a["scope"]) & (F.char_length(v) > n)))).otherwise(tags)}
                cut = (lambda c: F.left(c, F.lit(n))) if how == "truncate" else (lambda c: F.concat(F.left(c, F.lit(n - 3)), F.lit("...")))
                return self.change(a["scope"], lambda c: F.when(F.char_length(c) > n, cut(c)).otherwise(c), on)
            case "count":
                return {"counted": F.when(on, F.concat("counted", F.array(F.lit(rule.name)))).otherwise(F.col("counted"))}
            case "allowTag":
                allowed = a["allow"] if isinstance(a["allow"], dict) else {k: ".*" for k in a["allow"]}
                keep = lambda k, v: reduce(lambda x, y: x | y, ((k == name) & _full(v, str(p)) for name, p in allowed.items()), F.lit(False))
                return {"tags": F.when(on, self.filter_tags(keep)).otherwise(tags)}
            case "metricsFilter":
                exact = [n for n in a["names"] if not (n.startswith("/") and n.endswith("/"))]
                patterns = [n[1:-1] for n in a["names"] if n.startswith("/") and n.endswith("/")]
                hit = reduce(lambda x, y: x | y, (_full(F.col("name"), p) for p in patterns), F.col("name").isin(*exact))
                return reject(on & (~hit if a["function"] == "allow" else hit))
        raise RuleError(rule.action)

    def template(self, value: str) -> Column:
        """A tag value with `{{tag}}` placeholders."""
        parts = re.split(r"\{\{([^}]+)\}\}", value)
        return F.concat(*[F.lit(p) if i % 2 == 0 else F.coalesce(self.read(p), F.lit("")) for i, p in enumerate(parts)]) if len(parts) > 1 else F.lit(value)


def _shifted(replacement: str) -> str:
    """The replacement's group numbers one up, for a pattern with one more group before it."""
    return re.sub(r"\$(\d+)", lambda m: f"${int(m[1]) + 1}", replacement)


def apply_rules(records: DataFrame, rules: list[dict | Rule], kind: str = "point") -> DataFrame:
    """records after the rules of their kind, with status, reason and counted (names of the count rules met)."""
    compiler = Compiler(kind)
    start = {"status": F.lit(None).cast("string"), "reason": F.lit(None).cast("string"), "counted": F.array().cast("array<string>")}
    out = records.withColumns({k: v for k, v in start.items() if k not in records.columns})
    for rule in (r if isinstance(r, Rule) else parse(r) for r in rules):
        if rule.kind == kind:
            out = out.withColumns(compiler.step(rule))
    return out


def accepted(records: DataFrame) -> DataFrame:
    return records.filter("status IS NULL")


def count_rule_hits(records: DataFrame) -> DataFrame:
    """P10: (rule, n) of the count rules."""
    return records.select(F.explode("counted").alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))


def system_rules(points: DataFrame, prefix: str = "", hours_back: int = 8760, hours_ahead: int = 24, allow: str | None = None, block: str | None = None, now_ms: Column | None = None) -> DataFrame:
    """Allow and block patterns on the metric, the time range, then the prefix. The range is judged first."""
    now = now_ms if now_ms is not None else F.unix_millis(F.current_timestamp())
    in_range = F.col("ts_ms").between(now - hours_back * 3_600_000, now + hours_ahead * 3_600_000)
    reason = F.when(~F.coalesce(in_range, F.lit(False)), F.lit("WF-402: Point outside of reasonable timeframe"))
    if allow:
        reason = reason.when(~_full(F.col("name"), allow), F.lit("not on the allow list"))
    if block:
        reason = reason.when(_full(F.col("name"), block), F.lit("on the block list"))
    out = points.withColumn("reason", reason).withColumn("status", F.when(F.col("reason").isNotNull(), F.lit("rejected")))
    return out.withColumn("name", F.concat(F.lit(f"{prefix}."), "name")) if prefix else out


class RuleFile:
    """Rules by port from a JSON file (or YAML, where a YAML reader is installed), read again when its time changes.
    Remote rules, once given, take precedence over the file's. Ask for rules once a micro-batch."""

    def __init__(self, path: str):
        self.path, self.read_at, self.rules, self.remote = path, -1.0, {}, None

    def for_port(self, port: str) -> list[Rule]:
        if self.remote is not None:
            return self._of(self.remote, port)
        changed = os.stat(self.path).st_mtime
        if changed != self.read_at:
            self.rules, self.read_at = load_rules(self.path), changed
        return self._of(self.rules, port)

    @staticmethod
    def _of(rules: dict, port: str) -> list[Rule]:
        own = [r for ports, some in rules.items() if ports == "global" or port in [p.strip() for p in ports.split(",")] for r in some]
        return [parse(r) for r in own]


def load_rules(path: str) -> dict[str, list[dict]]:
    with open(path) as text:
        if path.endswith(".json"):
            import json

            return json.load(text)
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("YAML rules need a YAML reader; JSON rules don't") from e
        return yaml.safe_load(text)
