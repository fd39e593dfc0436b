"""Column helpers for tag maps, annotation lists, identifiers and time units."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ANNOTATIONS = "array<struct<key:string,value:string>>"


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value worked out once however often it stands there: what is made of parts that are made
    of parts would else be copied at each level, in the plan and for each row."""
    return F.transform(F.array(value), lambda x: then(x))[0]


def settled(rows: DataFrame, columns: dict[str, Column], keep: list[str] | None = None) -> DataFrame:
    """rows (or those columns of them to keep) with more columns, which are worked out once for each row and only then filtered or read:
    a filter on a plain column is moved below it, together with a copy of all that the column is made of."""
    kept = rows.columns if keep is None else keep
    held = rows.select(*[F.col(f"`{c}`") for c in kept], F.explode_outer(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))).alias("_settled"))
    return held.select(*[F.col(f"`{c}`") for c in kept if c not in columns], *[F.col(f"_settled.`{k}`").alias(k) for k in columns])


def empty_tags() -> Column:
    return F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))


def canonical(tags: Column) -> Column:
    """Entries sorted by key: equal maps give equal lists, so the list groups, joins and hashes."""
    return F.array_sort(F.map_entries(tags))


def tag_text(tags: Column) -> Column:
    """Canonical `k=v` list joined by commas."""
    return F.array_join(F.transform(canonical(tags), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")


def merge(under: Column, over: Column) -> Column:
    """Both maps' tags; those of `over` win. Needs no session-wide map policy."""
    return once(over, lambda o: _merged(under, o))


def _merged(under: Column, over: Column) -> Column:
    return F.map_concat(F.map_filter(under, lambda k, _: ~F.array_contains(F.map_keys(over), k)), over)


def put(tags: Column, key: str | Column, value: Column, keep_old: bool = False) -> Column:
    """tags with key set to value; a null value leaves them as they are. keep_old: an existing key wins."""
    key = F.lit(key) if isinstance(key, str) else key
    return once(F.struct(tags.alias("tags"), value.alias("value")), lambda x: _put(x["tags"], key, x["value"], keep_old))


def _put(tags: Column, key: Column, value: Column, keep_old: bool = False) -> Column:
    one = F.create_map(key, value)
    # with one key there are no others to look through
    added = _merged(one, tags) if keep_old else F.map_concat(F.map_filter(tags, lambda k, _: k != key), one)
    return F.when(value.isNull(), tags).otherwise(added)


def drop(tags: Column, keys: list[str]) -> Column:
    return F.map_filter(tags, lambda k, _: ~k.isin(*keys))


def rename(tags: Column, old: str, new: str, when: Callable[[Column], Column] | None = None) -> Column:
    """The tag `old` under the name `new`, where it exists (and the condition on the tags holds)."""

    def renamed(t: Column) -> Column:
        has = F.array_contains(F.map_keys(t), old)
        moved = F.when(t[old].isNull(), drop(t, [old])).otherwise(F.map_concat(drop(t, [old, new]), F.create_map(F.lit(new), t[old])))
        return F.when(has if when is None else has & when(t), moved).otherwise(t)

    return once(tags, renamed)


def from_pairs(pairs: Column) -> Column:
    """A map from an array of (key, value) structs; of a key given twice the last value wins."""
    return once(pairs, _from_pairs)


def _from_pairs(pairs: Column) -> Column:
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs) - i - 1, F.lit(0))), lambda q: q["key"] == p["key"]))
    apart = F.size(F.array_distinct(F.transform(pairs, lambda p: p["key"]))) == F.size(pairs)
    return F.when(apart, F.map_from_entries(pairs)).otherwise(F.map_from_entries(last))


def first_value(annotations: Column, key: str | Column) -> Column:
    """Value of the first annotation with the key; annotation lists may hold a key twice."""
    return F.get(F.filter(annotations, lambda a: a["key"] == key), F.lit(0))["value"]


def annotation(key: str | Column, value: Column) -> Column:
    return F.struct((F.lit(key) if isinstance(key, str) else key).alias("key"), value.cast("string").alias("value"))


def append(annotations: Column, key: str, value: Column) -> Column:
    """annotations with one more, unless the value is null."""
    return once(F.struct(annotations.alias("of"), value.cast("string").alias("value")), lambda x: F.when(x["value"].isNull(), x["of"]).otherwise(F.concat(x["of"], F.array(annotation(key, x["value"])))))


def uuid_of_hex(identifier: Column) -> Column:
    """A hex identifier of up to 16 bytes as UUID text; shorter ones are padded with high zeros."""
    full = F.lpad(F.lower(identifier), 32, "0")
    return F.regexp_replace(full, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def low_bits(uuid: Column) -> Column:
    """The least significant 64 bits of a UUID text as a signed long."""
    return F.conv(F.substring(F.regexp_replace(uuid, "-", ""), 17, 16), 16, -10).cast("long")


def java_hash(text: Column) -> Column:
    """java.lang.String.hashCode: 31-multiplied sum over UTF-16 units, as a signed 32-bit integer."""
    units = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    wide = F.flatten(F.transform(units, lambda u: F.when(u > 0xFFFF, F.array(F.lit(0xD7C0) + F.shiftright(u, 10), F.lit(0xDC00) + u.bitwiseAND(F.lit(0x3FF)))).otherwise(F.array(u))))
    total = F.aggregate(wide, F.lit(0).cast("long"), lambda h, u: (h * 31 + u).bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.when(total > 0x7FFFFFFF, total - (1 << 32)).otherwise(total).cast("int")


def whole(number: Column, by: int) -> Column:
    """Integer division of a long."""
    return F.call_function("div", number, F.lit(by))


def millis_by_digits(stamp: Column) -> Column:
    """Epoch milliseconds from a number's digits: 19 are nanoseconds, 16 microseconds, 13 milliseconds, else seconds."""
    return once(stamp.cast("string"), _millis_by_digits)


def _millis_by_digits(text: Column) -> Column:
    number = text.try_cast("long")
    return F.when(F.length(text) == 19, whole(number, 1_000_000)).when(F.length(text) == 16, whole(number, 1000)).when(F.length(text) == 13, number).otherwise(number * 1000).cast("long")


def epoch_millis(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))
