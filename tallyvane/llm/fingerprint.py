"""Document fingerprints: invertible Bloom lookup sketches of piece digests, in DataFrame and SQL functions only.

A text's pieces (lines, or runs of sentences of a line from LEAST to MOST code points) are hashed to 64-bit digests. A table
has three rows of cells; each digest is added to one cell of each row: to its count, to the XOR of
digests and to the XOR of check hashes. Tables of two versions subtract cell by cell, what both hold
cancels out, and peeling recovers the rest: a cell with one digest left shows it, which clears it from its
other two cells, and so on. Digests are dealt over blocks by their bits, so many that a block has LOAD or fewer on
average, and each block has a table of its own, of SIZES[0] cells a row at first. A table that does not peel empty is
retried larger, with twice the cells, up to SIZES[-1] (three digests' collision there is out of question; what would
not peel even then is not counted).

The fingerprint is written as the number of digests and, for each block, the first of its tables that peels
empty by itself: so it holds all that the sketches are made from. Likenesses come from two fingerprints: their digests
are dealt over as many blocks as the larger one has, tables of a block subtract and peel, and with d recovered digests
the likeness is (|A| + |B| - d) / (|A| + |B| + d), or 1 where both have none. Equal texts have equal fingerprints.

The next document is found by one exchange: rows are dealt to ranges of (doc_id, text hash), and each range's greatest
row is also sent to the range above it. Null texts count as empty, null doc_ids as the least; rows repeated
under one doc_id follow each other by falling text hash, and a doc_id that fills several ranges is cut by it; extra columns
are left out. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions

LOAD, PEELS = 6, 12
SIZES = [1 << k for k in range(2, 11)]
LEAST, MOST = 64, 256
MAX_CUTS = 1000
#: A piece has LEAST code points or more and ends with its sentence, line or text, or else after MOST.
PIECES = rf"[^\n]{{{LEAST},{MOST}}}?(?:[.!?;:|](?=\s)|(?=\n)|$)|[^\n]{{1,{MOST}}}"
NO_ID = -(1 << 63)


def digests_sql(text: str) -> str:
    return f"array_distinct(transform(regexp_extract_all({text}, r'{PIECES}', 0), x -> xxhash64(trim(x))))"


def _let(value: str, name: str, body: str) -> str:
    """body with name bound to value: evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def placed_sql(digests: str, size: str) -> str:
    """Digests with their check hashes and their cell in each of three rows: ten bits for each row, as many of them as the size asks for."""
    cells = ", ".join(f"'{name}', {row} * {size} + (shiftright(d, {32 + 10 * row}) & ({size} - 1))" for row, name in enumerate("pqr"))
    return f"transform({digests}, d -> named_struct('k', d, 'h', xxhash64(d), {cells}))"


def table_sql(digests: str, size: str) -> str:
    """Cells of one table of three rows over an array of digests."""
    cell = "if(size(own) = 0, named_struct('n', 0, 'k', 0L, 'h', 0L), named_struct('n', size(own), 'k', aggregate(own, 0L, (s, x) -> s ^ x.k), 'h', aggregate(own, 0L, (s, x) -> s ^ x.h)))"
    rows = [f"transform(sequence({row} * {size}, {row + 1} * {size} - 1), j -> {_let(f'filter(placed, x -> x.{name} = j)', 'own', cell)})" for row, name in enumerate("pqr")]
    return _let(placed_sql(digests, size), "placed", f"concat({', '.join(rows)})")


def subtract_sql(a: str, b: str) -> str:
    return f"zip_with({a}, {b}, (x, y) -> named_struct('n', x.n - y.n, 'k', x.k ^ y.k, 'h', x.h ^ y.h))"


def peel_sql(cells: str, size: str) -> str:
    """(c, f): cells after peeling and the number of digests recovered. Each step clears what the step before showed."""

    def shown(c: str) -> str:
        pure = f"filter({c}, x -> abs(x.n) = 1 AND x.h = xxhash64(x.k))"
        at = ", ".join(f"'{name}', {row} * {size} + (shiftright(x.k, {32 + 10 * row}) & ({size} - 1))" for row, name in enumerate("pqr"))
        return f"array_distinct(transform({pure}, x -> named_struct('n', x.n, 'k', x.k, 'h', x.h, {at})))"

    less = "aggregate(filter(s.p, y -> y.p = j OR y.q = j OR y.r = j), x, (q, y) -> named_struct('n', q.n - y.n, 'k', q.k ^ y.k, 'h', q.h ^ y.h))"
    step = _let(f"transform(s.c, (x, j) -> {less})", "after", f"named_struct('c', after, 'f', s.f + size(s.p), 'p', {shown('after')})")
    start = _let(cells, "before", f"named_struct('c', before, 'f', 0, 'p', {shown('before')})")
    return f"aggregate(sequence(1, {PEELS}), {start}, (s, i) -> if(size(s.p) = 0, s, {step}))"


_EMPTY = "forall({}.c, x -> x.n = 0 AND x.k = 0 AND x.h = 0)"


def _sizes(least: int = SIZES[0]) -> str:
    return f"array({', '.join(f'{n}L' for n in SIZES if n >= least)})"


def difference_sql(a: str, b: str, least: int = SIZES[0]) -> str:
    """How many digests are in one of two arrays only: their tables subtracted and peeled, larger ones on failure."""
    table = subtract_sql(table_sql(a, "z"), table_sql(b, "z"))
    tried = _let(peel_sql(table, "z"), "e", f"named_struct('done', {_EMPTY.format('e')}, 'f', e.f)")
    return f"aggregate({_sizes(least)}, named_struct('done', false, 'f', 0), (t, z) -> if(t.done, t, {tried})).f"


def blocks_sql(digests: str) -> str:
    """Blocks for an array of digests: a power of two."""
    return f"cast(power(2, ceil(log2(greatest(1, size({digests}) / {LOAD}.0D)))) AS int)"


def dealt_sql(digests: str, blocks: str) -> str:
    """Digests by block, in two steps, groups of blocks and then the blocks of a group, so that a text of n digests is scanned some root of n times."""
    of_group = f"filter({digests}, d -> (shiftright(d, 16) & (m.hi - 1)) = g)"
    of_block = "filter(w, d -> (d & (m.lo - 1)) = o)"
    group = _let(of_group, "w", f"transform(sequence(0, m.lo - 1), o -> {of_block})")
    sides = _let(f"cast(power(2, floor(log2({blocks}) / 2)) AS int)", "lo", f"named_struct('lo', lo, 'hi', cast({blocks} / lo AS int))")
    return f"if({blocks} = 1, array({digests}), {_let(sides, 'm', f'flatten(transform(sequence(0, m.hi - 1), g -> {group}))')})"


def sketched_sql(digests: str) -> str:
    """(d, b, g): digests of a text, the number of their blocks, and the digests by block."""
    return _let(blocks_sql(digests), "b", f"named_struct('d', {digests}, 'b', b, 'g', {dealt_sql(digests, 'b')})")


def fingerprint_sql(of: str) -> str:
    """Number of digests ':' blocks parted by '|': cells a row ':' cells parted by ',', each count '.' XOR of digests, or nothing."""
    tried = _let(table_sql("u", "z"), "c", f"if({_EMPTY.format(peel_sql('c', 'z'))}, named_struct('z', z, 'c', c), t)")
    none = "filter(array(named_struct('n', 0, 'k', 0L, 'h', 0L)), x -> false)"
    first = f"aggregate({_sizes()}, named_struct('z', 0L, 'c', {none}), (t, z) -> if(t.z > 0, t, {tried}))"
    cells = "array_join(transform(e.c, x -> if(x.n = 0, '', concat(hex(x.n), '.', hex(x.k)))), ',')"
    block = f"if(size(u) = 0, '', {_let(first, 'e', f'concat(hex(e.z), chr(58), {cells})')})"
    return f"lower(concat(hex(size({of}.d)), ':', array_join(transform({of}.g, u -> {block}), '|')))"


def likeness_sql(a: str, b: str, least: int = SIZES[0]) -> str:
    """Shared part of two fingerprints' digests. least: the first tables' cells a row, larger where much is expected to differ."""
    sides = [f"if({x}.b = w, {x}.g, {dealt_sql(f'{x}.d', 'w')})" for x in (a, b)]
    apart = f"aggregate(zip_with({sides[0]}, {sides[1]}, (left, right) -> if(left = right, 0, {difference_sql('left', 'right', least)})), 0, (total, one) -> total + one)"
    recovered = f"if({a}.d = {b}.d, 0, {_let(f'greatest({a}.b, {b}.b)', 'w', apart)})"
    value = f"(size({a}.d) + size({b}.d) - f) / (size({a}.d) + size({b}.d) + f)"
    return f"if(size({a}.d) + size({b}.d) = 0, 1.0D, {_let(recovered, 'f', f'cast({value} AS double)')})"


def with_next(docs: DataFrame, ranges: int) -> DataFrame:
    """docs (_k, _h, ...) with the columns of the next row in falling (_k, _h) (of the last: the first) in a struct `next`.

    Range bounds are at most MAX_CUTS quantiles of _k, each cut in ranges of equal width; a _k that is several quantiles
    is the greatest of its range and cut by _h. What goes over a border is a row a range.
    """
    columns = [c for c in docs.columns if c not in ("_k", "_h")]
    coarse = min(ranges, MAX_CUTS)
    met = Counter(int(c) for c in docs.stat.approxQuantile("_k", [i / coarse for i in range(coarse + 1)], 0.1 / coarse))
    cuts = sorted(met)
    place = F.lit(0).cast("long")
    if cuts:
        fine = -(-ranges // coarse)
        bounds = F.array(*[F.lit(c) for c in cuts])
        index = F.size(F.filter(F.array(*[F.lit(c) for c in cuts[:-1]]).cast("array<bigint>"), lambda c: c < F.col("_k")))
        low, high = F.coalesce(F.get(bounds, index - 1), F.lit(cuts[0])).cast("double"), F.get(bounds, index).cast("double")
        inside = F.greatest(F.lit(0.0), F.least(F.lit(fine - 1.0), F.floor((F.col("_k").cast("double") - low) * fine / (high - low + 1)).cast("double")))
        inside = F.when(F.col("_k") == F.get(bounds, index), F.lit(fine - 1.0)).otherwise(inside)
        shares = F.array(*[F.lit(float(met[c] * fine if met[c] > 1 else 0)) for c in cuts])
        share = F.when(F.col("_k") == F.get(bounds, index), F.get(shares, index)).otherwise(F.lit(0.0))
        part = F.when(share > 0, 1 + F.least(share - 1, F.floor((F.col("_h").cast("double") / 2.0**64 + 0.5) * share).cast("double"))).otherwise(F.lit(0.0))
        place = ((index * fine + inside) * (2 * ranges + 4) + part).cast("long")
    placed = docs.withColumn("_range", place)
    in_order = Window.orderBy("_range")  # a row a range
    tops = placed.groupBy("_range").agg(F.max(F.struct("_k", "_h")).alias("top"))
    above = F.coalesce(F.lead("_range").over(in_order), F.first("_range").over(in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    borders = tops.select(F.col("top._k").alias("k"), F.col("top._h").alias("h"), above.alias("to"))
    sent = placed.join(F.broadcast(borders), (placed["_k"] == borders["k"]) & (placed["_h"] == borders["h"]), "left").drop("k", "h")
    place_of = lambda r, ghost: F.struct(r.alias("r"), F.lit(ghost).alias("ghost"))
    own = F.array(place_of(F.col("_range"), False))
    rows = sent.withColumn("_at", F.explode(F.when(F.col("to").isNull(), own).otherwise(F.concat(own, F.array(place_of(F.col("to"), True))))))
    order = Window.partitionBy("_at.r").orderBy("_at.ghost", F.desc("_k"), F.desc("_h"), columns[0])
    return rows.withColumn("next", F.lead(F.struct(*columns)).over(order)).filter(~F.col("_at.ghost")).select("_k", *columns, "next")


def fingerprint_versions(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row."""
    ranges = 4 * shuffle_partitions(docs.sparkSession)  # several to a partition, so that partitions are alike in size
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    source = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_k"), F.xxhash64(text).alias("_h"), text.alias("text"))
    # digests go with their text, so that a text is cut into pieces once though it is also the next one's
    source = source.withColumn("digests", F.expr(digests_sql("text")))
    paired = with_next(source, ranges).select("_k", "text", "digests", F.col("next.text").alias("following"), F.col("next.digests").alias("next_digests"))
    edited = paired.withColumn("n_chars", F.char_length("text").cast("long"))
    edited = edited.withColumn("_cut", F.floor(F.col("n_chars") / 3).cast("int"))
    edited = edited.withColumn("edited", F.expr("concat(substring(text, 1, cast(n_chars AS int) - _cut), substring(following, 1, _cut))"))
    edited = edited.select("_k", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "digests", "next_digests", F.expr(digests_sql("edited")).alias("edited_digests"))
    hashed = edited.select("_k", "n_chars", "edited_sha256", *[F.expr(sketched_sql(c)).alias(name) for c, name in (("digests", "_text"), ("edited_digests", "_edited"), ("next_digests", "_following"))])
    return hashed.select(
        F.when(F.col("_k") != NO_ID, F.col("_k")).alias("doc_id"),
        "n_chars",
        "edited_sha256",
        F.expr(fingerprint_sql("_text")).alias("fingerprint"),
        F.expr(fingerprint_sql("_edited")).alias("edited_fingerprint"),
        F.expr(likeness_sql("_text", "_edited")).alias("near_edited"),
        F.expr(likeness_sql("_text", "_following", 2 * SIZES[0])).alias("near_next"),
    )
