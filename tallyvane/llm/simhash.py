"""SimHash near-duplicates with bit-sliced comparison.

Fingerprints: bit b of a text is 1 if more than half of its word shingles' XXH64 values have bit b.
Links: equal fingerprints are first folded into one; two fingerprints at most `radius` bits apart
agree wholly on at least `agree` of `blocks` bit groups, so each fingerprint goes to one bucket for
each choice of so many groups (more groups, and so finer buckets, the more fingerprints there are), and buckets are
compared bit-sliced: the fingerprints stand as 64 vertical bit planes, the differing planes are added by carry-save
counters over whole machine words, and a block of rows is abandoned once all its counters exceed the radius. Buckets of
SMALL_GROUP rows or fewer stand side by side in the same planes, which are compared with themselves moved on by
1, 2, ... rows. A bucket beyond BUCKET rows is cut into slices whose pairs are compared in separate tasks, so none is dropped.
Each task emits only a spanning set of links; components are then found in Spark rounds.

Null, empty and wordless texts have fingerprint zero and link like any other. Repeated rows keep
their rows; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Powers, chunks, kept, materialise, mix64, remove, small_batches, text_bytes, unpacked, word_hashes, words_of
from .graph import components

BUCKET, SMALL_GROUP = 4096, 64
#: Near-dedup of whole texts: bits of its fingerprints, the most differing bits of two candidates, and the least similarity of two linked sets.
WIDE, WIDE_RADIUS, LIKE = 256, 80, (4, 5)
#: Bands of MinHashes that name its candidates, and MinHashes in each: at similarity 0.8 a pair is missed with a chance of 5e-8.
BANDS, ROWS = 32, 4
NO_ID = -(1 << 63)
_SALTS = mix64(np.arange(1, WIDE // 64 + 1, dtype=np.uint64))
_MIN_UP = mix64(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) << np.uint64(8)) | np.uint64(1)
_MIN_ADD = mix64(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) << np.uint64(24))
_SHINGLE = Powers(0xC6A4A7935BD1E995)


def fingerprint_bits(texts: list[bytes], shingle: int) -> list[int]:
    """SimHash of each text: ASCII lower case, words [^\\x20\\x09-\\x0D]+, shingles with repeats, XXH64 seed 42."""
    raw, starts, ends, first = words_of(texts, lower=True)
    keep = np.zeros(len(raw) + 1, bool)  # the words joined by one space each: bytes of words and one byte after each
    inside = np.zeros(len(raw) + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    keep[:-1] = np.cumsum(inside[:-1]) > 0
    keep[ends] = True
    joined = np.append(raw, np.uint8(32))
    joined[ends] = 32
    flat = joined[keep].tobytes()
    lengths = ends - starts + 1
    at = np.concatenate(([0], np.cumsum(lengths)))
    digest = xxhash.xxh64_digest
    found = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if a == b:
            found.append(0)
            continue
        n = max(1, b - a - shingle + 1)
        begin = at[a : a + n].tolist()
        end = (at[min(a + shingle, b) : b + 1] - 1).tolist()
        hashes = b"".join([digest(flat[i:j], 42) for i, j in zip(begin, end)])
        ones = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(n, 8), axis=1).sum(axis=0, dtype=np.int64)
        found.append(int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big"))
    return found


def fingerprints(docs: DataFrame, keep: list[str], shingle: int = 4) -> DataFrame:
    """The columns named in keep, then fp (the 64 bits as a signed long)."""
    small_batches(docs.sparkSession)
    source = docs.select(kept(keep), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            bits = np.array(fingerprint_bits(text_bytes(batch.column("text")), shingle), np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("_keep"), pa.array(bits)], names=["_keep", "fp"])

    return unpacked(source.mapInArrow(run, f"_keep {source.schema['_keep'].dataType.simpleString()}, fp long"), keep, "fp")


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """Planes of fingerprints (rows of 64-bit words): plane b holds bit b of 64 fingerprints a word."""
    bits = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(len(fps), -1), axis=1, bitorder="little")
    padded = np.zeros((bits.shape[1], -(-len(fps) // 64) * 64), np.uint8)
    padded[:, : len(fps)] = bits.T
    return np.packbits(padded, axis=1, bitorder="little").view(np.uint64)


def within(planes: np.ndarray, probes: np.ndarray, radius: int, every: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(probe, word, mask): for probes and plane words with any hit, the mask of the 64 lanes at most radius bits away.

    Counters are bit planes too (one word operation adds one bit to 64 distances), started so that they
    overflow just when the radius is passed; `over` keeps the lanes that have. Every few planes the blocks
    (a probe against 64 fingerprints) whose lanes are all over are abandoned.
    """
    width, full = radius.bit_length(), ~np.uint64(0)
    probe = np.repeat(np.arange(len(probes)), planes.shape[1])
    word = np.tile(np.arange(planes.shape[1]), len(probes))
    over = np.zeros(len(probe), np.uint64)
    offset = (1 << width) - 1 - radius
    count = [np.full(len(probe), full if offset >> k & 1 else 0, np.uint64) for k in range(width)]
    for b in range(len(planes)):
        bit = np.where(probes[:, b // 64] >> np.uint64(b % 64) & np.uint64(1), full, np.uint64(0))
        carry = planes[b][word] ^ bit[probe]
        for k in range(width):
            count[k], carry = count[k] ^ carry, count[k] & carry
        over |= carry
        if b % every == every - 1 or b == len(planes) - 1:
            live = over != full
            if not live.all():
                probe, word, over, count = probe[live], word[live], over[live], [c[live] for c in count]
                if not len(probe):
                    break
    return probe, word, ~over


def neighbours(planes: np.ndarray, n: int, probes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (place of the probe, place of the fingerprint) at most radius bits apart."""
    probe, word, mask = within(planes, probes, radius)
    lanes = np.unpackbits(mask.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool)
    at = word[:, None] * 64 + np.arange(64)
    lanes &= at < n
    return np.broadcast_to(probe[:, None], at.shape)[lanes], at[lanes]


class Forest:
    """Union-find over places 0..n-1 that keeps the links which joined two classes."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.parent = list(range(n))
        self.links: list[tuple[int, int]] = []

    def root(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def join(self, left: np.ndarray, right: np.ndarray) -> None:
        new = self.label[left] != self.label[right]
        for a, b in zip(left[new].tolist(), right[new].tolist()):
            x, y = self.root(a), self.root(b)
            if x != y:
                self.parent[max(x, y)] = min(x, y)
                self.links.append((a, b))
        if new.any():
            label = np.array(self.parent)
            while (label != label[label]).any():
                label = label[label]
            self.label, self.parent = label, label.tolist()


def spanning_links(left: np.ndarray, right: np.ndarray | None, radius: int, batch: int = 128) -> list[tuple[int, int]]:
    """Places of links that connect what the pairs within radius connect, one for each row that joins a class.

    left alone: its own pairs; with right (places go on after left's): pairs across.
    """
    target, base = (left, 0) if right is None else (right, len(left))
    forest, planes = Forest(base + len(target)), bit_planes(target)
    for i in range(0, len(left), batch):
        probe, found = neighbours(planes, len(target), left[i : i + batch], radius)
        forest.join(probe + i, found + base)
    return forest.links


def small_group_links(fps: np.ndarray, group: np.ndarray, radius: int, every: int = 12) -> list[tuple[int, int]]:
    """The same for many small groups at once: the planes of all rows against the same planes 1, 2, ... rows on.

    A word operation compares 64 rows with their partners; lanes whose partner is of another group don't count, and
    words whose lanes are all over the radius, or don't count, are abandoned.
    """
    if not len(fps):
        return []
    forest, planes, step = Forest(len(fps)), bit_planes(fps), 1
    words, full, width = planes.shape[1], ~np.uint64(0), radius.bit_length()
    padded = np.concatenate((planes, np.zeros((len(planes), 2 + -(-len(fps) // 64)), np.uint64)), axis=1)
    offset = (1 << width) - 1 - radius
    while step < len(fps):
        same = np.zeros(words * 64, np.uint8)
        same[: len(fps) - step] = group[step:] == group[:-step]
        lanes = np.packbits(same, bitorder="little").view(np.uint64)
        at = np.flatnonzero(lanes)
        if not len(at):
            break
        far, shift = divmod(step, 64)
        over = ~lanes[at]
        count = [np.full(len(at), full if offset >> k & 1 else 0, np.uint64) for k in range(width)]
        for b in range(len(planes)):
            moved = padded[b][at + far]
            if shift:
                moved = moved >> np.uint64(shift) | padded[b][at + far + 1] << np.uint64(64 - shift)
            carry = planes[b][at] ^ moved
            for k in range(width):
                count[k], carry = count[k] ^ carry, count[k] & carry
            over |= carry
            if b % every == every - 1:
                live = over != full
                if not live.all():
                    at, over, count = at[live], over[live], [c[live] for c in count]
        found, lane = np.nonzero(np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        left = at[found] * 64 + lane
        forest.join(left, left + step)
        step += 1
    return forest.links


def blocks_for(rows: int, radius: int, width: int = 64, full: int = BUCKET) -> int:
    """Bit groups for so many fingerprints: the least number, from radius + 2 on, with which a bucket of them has `full` / 4 rows or fewer if bits are even."""
    blocks = radius + 2
    while blocks < radius + 6 and rows >> width * (blocks - radius) // blocks > full // 4:
        blocks += 1
    return blocks


def bucket_keys(fp: Column, radius: int, blocks: int = 6) -> Column:
    """One key for each choice of blocks - radius bit groups: any two within radius share at least one."""
    agree = max(1, blocks - radius)
    edges = [64 * k // blocks for k in range(blocks + 1)]
    keys = []
    for n, chosen in enumerate(combinations(range(blocks), agree)):
        mask = sum(((1 << (edges[c + 1] - edges[c])) - 1) << edges[c] for c in chosen)
        keys.append(F.struct(F.lit(n).alias("choice"), fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)).alias("bits")))
    return F.array(*keys)


def whole_groups(parts: Iterator[pd.DataFrame], keys: list[str], links: Callable[[pd.DataFrame], pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """links of sorted batches, cut between groups: one that spans Arrow batches is carried over, so a task holds one batch and one group at a time."""
    rest: list[pd.DataFrame] = []
    for part in parts:
        if part.empty:
            continue
        if rest and any(rest[-1][k].iloc[-1] != part[k].iloc[-1] for k in keys) or not rest:
            last = np.logical_and.reduce([(part[k] == part[k].iloc[-1]).to_numpy() for k in keys])
            cut = len(part) - int(last.sum())
            whole = [*rest, part.iloc[:cut]]
            if sum(map(len, whole)):
                yield links(pd.concat(whole, ignore_index=True))
            rest = [part.iloc[cut:]]
        else:
            rest.append(part)
    if rest:
        yield links(pd.concat(rest, ignore_index=True))


def near_links(distinct: DataFrame, radius: int, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links that span all pairs of rows (node, keys, fp) which share a key and are at most radius bits apart.

    node: a long that stands for the row; keys: array of structs (choice, bits); fp: its words as binary.
    A task gets whole groups of at most two slices of about `bucket` rows.
    """
    # fingerprints stay out of the exchanges by key: `row` stands for a row, and where two have the same they only meet more others
    distinct = distinct.withColumn("row", F.xxhash64("node", "fp"))
    keyed = distinct.select("row", F.explode("keys").alias("key")).select("row", "key.choice", "key.bits")
    sizes = keyed.groupBy("choice", "bits").count().filter("count > 1")
    sizes = sizes.select(F.col("choice").alias("c"), F.col("bits").alias("k"), F.ceil(F.col("count") / bucket).cast("int").alias("slices"))
    rows = keyed.join(sizes, (keyed.choice == sizes.c) & (keyed.bits == sizes.k)).select(F.col("row").alias("_row"), "choice", "bits", "slices")
    rows = rows.join(distinct.select("row", "node", "fp"), F.col("_row") == F.col("row")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("slices")).cast("int"))
    # a row goes to the group of every pair of slices that has its own
    pairs = F.transform(F.sequence(F.lit(0), F.col("slices") - 1), lambda s: F.struct(F.least(s, F.col("own")).alias("i"), F.greatest(s, F.col("own")).alias("j")))
    sent = rows.select("node", "fp", "choice", "bits", "own", F.explode(pairs).alias("pair")).select("node", "fp", "own", "choice", "bits", "pair.i", "pair.j")
    keys = ["choice", "bits", "i", "j"]

    def links(part: pd.DataFrame) -> pd.DataFrame:
        """Links of the whole groups of a sorted batch."""
        fps = np.frombuffer(b"".join(part["fp"]), "<u8").reshape(len(part), -1)
        nodes, own = part["node"].to_numpy(), part["own"].to_numpy()
        new = np.ones(len(part), bool)
        new[1:] = np.logical_or.reduce([part[k].to_numpy()[1:] != part[k].to_numpy()[:-1] for k in keys])
        group = np.cumsum(new)
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(part))
        across = part["i"].to_numpy() != part["j"].to_numpy()
        large = (ends - starts > SMALL_GROUP) | across[starts]
        few = ~np.repeat(large, ends - starts)
        at = np.flatnonzero(few)
        found = [(int(at[a]), int(at[b])) for a, b in small_group_links(fps[at], group[at], radius)]
        for a, b in zip(starts[large].tolist(), ends[large].tolist()):
            here = np.arange(a, b)
            if across[a]:
                sides = [here[own[a:b] == part["i"].iloc[a]], here[own[a:b] == part["j"].iloc[a]]]
                here = np.concatenate(sides)
                pairs_found = spanning_links(fps[sides[0]], fps[sides[1]], radius)
            else:
                pairs_found = spanning_links(fps[here], None, radius)
            found += [(int(here[x]), int(here[y])) for x, y in pairs_found]
        ends_of = np.array(found, np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": nodes[ends_of[:, 0]], "b": nodes[ends_of[:, 1]]})

    return sent.repartition(*keys).sortWithinPartitions(*keys, "node").mapInPandas(lambda parts: whole_groups(parts, keys, links), "a long, b long")


def classes(folded: DataFrame, links: DataFrame, old: list[str]) -> DataFrame:
    """folded (first, ...) with component_id, the least doc_id reachable.

    A fingerprint goes by the least doc_id that has it, so the root of its component is the answer itself and
    nothing meets by component. old: gets the path of a table that the result reads.
    """
    found = components(links, "simhash", kept=old).withColumnRenamed("node", "_n")
    return folded.join(found, folded["first"] == found["_n"], "left").withColumn("component_id", F.coalesce("root", "first")).drop("_n", "root")


def link_documents(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row; rows of one doc_id are in one component."""
    spark, old = docs.sparkSession, []
    prints = materialise(fingerprints(docs.withColumn("doc_id", F.col("doc_id").cast("long")), ["doc_id"], shingle), "simhash-prints", old)
    folded = materialise(prints.groupBy("fp").agg(F.min(F.coalesce("doc_id", F.lit(NO_ID))).alias("first")), "simhash-distinct", old)
    words = F.unhex(F.lpad(F.hex("fp"), 16, "0"))  # the order of bits is one to distances
    keys = bucket_keys(F.col("fp"), radius, blocks_for(folded.count(), radius))
    links = near_links(folded.select(F.col("first").alias("node"), keys.alias("keys"), words.alias("fp")), radius)
    by_print = classes(folded, links, old).select(F.col("fp").alias("_fp"), "component_id")
    component = F.when(F.col("component_id") != NO_ID, F.col("component_id"))
    found = prints.join(by_print, prints.fp == by_print["_fp"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), component.alias("component_id"))
    found = materialise(found, "simhash")
    remove(spark, old)
    return found


def wide_prints(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """(_k, node, keys, fp): a WIDE-bit SimHash of the set of word shingles as fp, as keys the bands of its MinHashes; node stands for the set."""
    small_batches(docs.sparkSession)
    source = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_k"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            sets = shingle_sets(text_bytes(batch.column("text")), shingle)
            columns = [[xxhash.xxh3_128_digest(s.tobytes()) for s in sets], [wide_bits(s) for s in sets], [min_bands(s) for s in sets]]
            yield pa.RecordBatch.from_arrays([batch.column("_k"), pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.list_(pa.int64()))], names=["_k", "node", "fp", "bands"])

    prints = source.mapInArrow(run, "_k long, node binary, fp binary, bands array<bigint>")
    return prints.select("_k", "node", F.transform("bands", lambda x, n: F.struct(n.alias("choice"), x.alias("bits"))).alias("keys"), "fp")


def shingle_sets(texts: list[bytes], shingle: int = 5) -> list[np.ndarray]:
    """Each text's set of shingles as rising 64-bit hashes (by prefix sums over word hashes); fewer words are one shingle."""
    raw, starts, ends, first = words_of(texts, lower=True)
    words = word_hashes(raw, starts, ends)
    up, down = _SHINGLE.get(len(words) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * up[: len(words)], dtype=np.uint64)))
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        at = np.arange(a, max(a + 1, b - shingle + 1)) if b > a else np.arange(0)
        out.append(np.unique(mix64((total[np.minimum(at + shingle, b)] - total[at]) * down[at])))
    return out


def wide_bits(hashes: np.ndarray) -> bytes:
    """WIDE-bit SimHash of a set."""
    spread = np.stack([mix64(hashes ^ salt) for salt in _SALTS], axis=1)
    ones = np.unpackbits(spread.view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(hashes)).tobytes()


def min_bands(hashes: np.ndarray) -> np.ndarray:
    """BANDS keys of a set, each a mix of ROWS of its MinHashes: two sets of similarity s share none with chance (1 - s ** ROWS) ** BANDS."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 1024):
        np.minimum(least, (hashes[i : i + 1024] * _MIN_UP[:, None] + _MIN_ADD[:, None]).min(axis=1), out=least)
    key = np.zeros(BANDS, np.uint64)
    for k in range(ROWS):
        key = mix64(key * _MIN_UP[0] + least[k::ROWS])
    return key.view(np.int64)


def alike_links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray | None) -> list[tuple[int, int]]:
    """Places of links that connect what the pairs of sets of similarity LIKE or more connect; left alone: its own pairs; with right: pairs across."""
    at = left if right is None else np.concatenate((left, right))
    at = at[[len(sets[i]) > 0 for i in at.tolist()]]
    if len(at) < 2:
        return []
    size = np.array([len(sets[i]) for i in at.tolist()])
    names, number = np.unique(np.concatenate([sets[i] for i in at.tolist()]), return_inverse=True)
    ends = np.concatenate(([0], np.cumsum(size)))
    forest, mark = Forest(len(at)), np.zeros(len(names), np.int32)
    probes = len(at) - 1 if right is None else int(np.isin(at, left).sum())
    for p in range(probes):
        first = p + 1 if right is None else probes
        if first == len(at):
            break
        mine = number[ends[p] : ends[p + 1]]
        mark[mine] = 1
        both = np.add.reduceat(mark[number[ends[first] :]], ends[first:-1] - ends[first])
        mark[mine] = 0
        hit = np.flatnonzero(LIKE[1] * both >= LIKE[0] * (size[p] + size[first:] - both)) + first
        forest.join(np.full(len(hit), p), hit)
    return [(int(at[a]), int(at[b])) for a, b in forest.links]


def verified_links(docs: DataFrame, candidates: DataFrame, shingle: int = 5, most: int = 1024, most_bytes: int = 8 << 20, old: list[str] | None = None) -> DataFrame:
    """(a, b): links that span all pairs of documents of one candidate group whose shingle sets are alike by LIKE, from the sets themselves.

    candidates: (node, root). A group beyond `most` rows or `most_bytes` of sets is cut into slices whose pairs are
    compared in separate tasks, so every pair of a group is compared and only spanning links leave a task. old: gets the
    path of a table that the result reads.
    """
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_k"), F.col("text").cast("string").alias("text"))
    texts = texts.join(candidates, texts["_k"] == candidates["node"]).select("root", "node", "text")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            sets = [s.astype("<u8").tobytes() for s in shingle_sets(text_bytes(batch.column("text")), shingle)]
            yield pa.RecordBatch.from_arrays([batch.column("root"), batch.column("node"), pa.array(sets, pa.binary())], names=["root", "node", "hashes"])

    rows = materialise(texts.mapInArrow(read, "root long, node long, hashes binary"), "near-sets", old)
    slices = F.greatest(F.ceil(F.count("*") / most), F.ceil(F.sum(F.length("hashes")) / most_bytes)).cast("int")
    sizes = rows.groupBy(F.col("root").alias("_r")).agg(slices.alias("slices"))
    rows = rows.join(sizes, rows["root"] == sizes["_r"]).withColumn("own", F.pmod(F.xxhash64("node"), F.col("slices")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("slices") - 1), lambda s: F.struct(F.least(s, F.col("own")).alias("i"), F.greatest(s, F.col("own")).alias("j")))
    sent = rows.select("root", "node", "hashes", "own", F.explode(pairs).alias("pair")).select("root", "pair.i", "pair.j", "node", "own", "hashes")
    keys = ["root", "i", "j"]

    def links(part: pd.DataFrame) -> pd.DataFrame:
        sets = [np.frombuffer(x, "<u8") for x in part["hashes"]]
        nodes, own, i, j = (part[c].to_numpy() for c in ("node", "own", "i", "j"))
        new = np.append(True, np.logical_or.reduce([part[k].to_numpy()[1:] != part[k].to_numpy()[:-1] for k in keys]))
        starts = np.flatnonzero(new)
        found = []
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(part)]):
            here = np.arange(a, b)
            found += alike_links(sets, here, None) if i[a] == j[a] else alike_links(sets, here[own[a:b] == i[a]], here[own[a:b] == j[a]])
        ends_of = np.array(found, np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": nodes[ends_of[:, 0]], "b": nodes[ends_of[:, 1]]})

    return sent.repartition(*keys).sortWithinPartitions(*keys, "node").mapInPandas(lambda parts: whole_groups(parts, keys, links), "a long, b long")


def one_of_each(docs: DataFrame, radius: int = WIDE_RADIUS) -> DataFrame:
    """docs without near-duplicates: of each group of linked documents that with the least doc_id stays.

    Two documents link if their sets of five-word shingles have a similarity of 0.8 or more, counted from the sets.
    Only what shares a band of MinHashes and has WIDE-bit SimHashes at most radius bits apart (0.8 gives 39 on
    average, at worst 48 with deviation 6) is compared so: all pairs of each group that such candidates connect.
    Rows of one doc_id stay or go together; wordless texts are copies of each other.
    """
    old: list[str] = []
    prints = wide_prints(docs)
    folded = materialise(prints.groupBy("node").agg(F.min("_k").alias("first"), F.first("keys").alias("keys"), F.first("fp").alias("fp")), "near-distinct", old)
    links = near_links(folded.select(F.col("first").alias("node"), "keys", "fp"), radius)
    links = verified_links(docs, components(links, "near-groups", kept=old), old=old)
    stay = materialise(classes(folded.select("first"), links, old).select(F.col("component_id").alias("_stay")).distinct(), "near-stay")
    remove(docs.sparkSession, old)
    # one plan at every size: else the texts, which stay where they are while the ids are few, are sent and sorted from some size on
    return docs.join(stay.hint("shuffle_hash"), F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)) == stay["_stay"], "left_semi")
