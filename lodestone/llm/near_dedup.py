"""Near-duplicate classes by Order MinHash.

Similarity is edit similarity over words: 1 - edits / words of the longer text, lower-cased
A-Z, words split at white space; two texts are linked from ``SIMILARITY`` on, and classes
are the connected texts. Method:

* Sketch. A text's five-word runs are labelled with their occurrence number and hashed. For
  each of ``BANDS`` hash functions the few smallest are kept and put back into text order;
  the ordered tuple is a key. Unlike plain MinHash, texts with the same runs in another
  order get other keys. Tuples of two and, for the rounds below, four and eight are kept.
* Copies. Texts with the same words (128-bit hash and count) are one vertex from here on.
* Candidates. In each group of equal keys every text is paired with one hub only, so a
  group of n texts makes n - 1 pairs. The texts that turn out not to be similar to the hub
  are grouped again among themselves, twice, by longer tuples and with more hubs (``HUBS``, the
  first texts of so many slots that a hash deals). These pairs grow with texts times hubs;
  longer tuples only order the work.
* Completion. Texts of one group of equal two-tuples that the links so far don't join are
  paired exactly: texts with at most d edits share all but d words, so in any common order
  of words they share one of the first d + 1. Words that the group's hub lacks come first,
  then by rarity, so a passage that the group shares pairs nothing. Pairs that the words'
  places or the lengths rule out are left out, and so are words that one text has alone. A
  pair meets in the first group that both are in, and at one of the words near each other
  that they share. Two texts that share a two-tuple are thus joined, compared or ruled out by
  a bound; no group is capped.
* Verification. Pairs pass a count filter (words in common) and then a banded alignment:
  bit-parallel edit distance over a band of diagonals as wide as the distance allowed.
* Classes. Links are contracted by alternating large-star and small-star steps, each
  written to the shared folder.

Candidates are probabilistic, as with every MinHash: a pair whose runs agree to a share J
shares a tuple of two with chance 1 - (1 - J^2)^BANDS, that is over 0.9999 at J = 0.7,
0.99 at 0.5. Scattered edits lower J faster than edit similarity (J is about 0.6 at 0.95).

Memory: hubs' and members' words travel in pairs through Arrow batches of bounded rows; the
alignment's band is bits of Python integers. Hot groups: keys and hubs are joined by sort
merge between freshly dealt tables, which Spark may split where one key is hot.

Defined results: texts without words (null, empty, white space) form one class; a text of
fewer than five words is one run; a very long text is sketched and aligned whole; repeated
rows are members of their text's class; rows with a null id are classed by their text like
any other, and any id beats null as the class's smallest; of rows that tie for it the first is
kept; an empty table gives an empty result; other columns, of any name, are ignored unless
kept.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words
from .common import discard, staged

RUN = 5
BANDS = 16
DEPTHS = (2, 4, 8)
SIMILARITY = 0.8
SEED = 11
NARROW = 24
HUBS = (1, 2, 4)
RARITY_BITS = 22
EARLIER = 8  # words that a text's word in the completion remembers


# ---------------------------------------------------------------- sketches


def token_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of white-space words and the number of words before each text."""
    data = words.LOWER[data]
    starts, ends, before = words.spans(data, offsets, words.NOT_SPACE)
    return words.hashes(data, starts, ends), before


def runs(h: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Occurrence-labelled hashes of the RUN-word runs, and the number of runs before each text."""
    size = np.diff(before)
    many = np.where(size > 0, np.maximum(1, size - RUN + 1), 0)
    begins = np.concatenate([[0], np.cumsum(many)])
    row = np.repeat(np.arange(len(size)), many)
    first = before[row] + np.arange(len(row)) - begins[row]
    out = np.full(len(row), RUN, np.uint64)
    for j in range(RUN):
        there = first + j < before[row + 1]
        out = words.mix(out ^ np.where(there, h[np.minimum(first + j, max(0, len(h) - 1))] if len(h) else 0, np.uint64(j)))
    # The n-th occurrence in a text gets label n.
    turn = np.lexsort((out, row))
    same = np.zeros(len(out), bool)
    same[1:] = (out[turn][1:] == out[turn][:-1]) & (row[turn][1:] == row[turn][:-1])
    at = np.arange(len(out))
    label = np.empty(len(out), np.uint64)
    label[turn] = at - np.maximum.accumulate(np.where(same, 0, at))
    return words.mix(out + label * np.uint64(0x632BE59BD9B4E019)), begins


def sketch(h: np.ndarray, begins: np.ndarray, bands: int = BANDS, depths: tuple[int, ...] = DEPTHS, seed: int = SEED) -> np.ndarray:
    """(texts, bands, depths) keys; texts without runs have zeros."""
    texts, size, most = len(begins) - 1, np.diff(begins), max(depths)
    out = np.zeros((texts, bands, len(depths)), np.uint64)
    row = np.repeat(np.arange(texts), size)
    # Of n hashes about 4 x most lie below this bound; a text where too few do is taken whole.
    top = float(2**64 - 2**12)
    bound = np.where(size <= 8 * most, np.uint64(2**64 - 1), np.minimum(top, top * 4 * most / np.maximum(size, 1)).astype(np.uint64))
    bounds = bound[row]
    salts = np.random.default_rng(seed).integers(1, 2**63, bands, dtype=np.uint64)
    for b in range(bands):
        v = words.mix(h ^ salts[b])
        low = np.flatnonzero(v <= bounds)
        got = np.bincount(row[low], minlength=texts)
        short = np.flatnonzero((got < np.minimum(size, most)))
        if len(short):
            low = np.union1d(low, np.flatnonzero(np.isin(row, short)))
        r = row[low]
        turn = np.lexsort((v[low], r))
        low, r = low[turn], r[turn]
        rank = np.arange(len(r)) - np.searchsorted(r, r, "left")
        for d, depth in enumerate(depths):
            pick = low[rank < depth]
            pick.sort()  # text order
            r2 = row[pick]
            nth = np.arange(len(r2)) - np.searchsorted(r2, r2, "left")
            table = np.zeros((texts, depth), np.uint64)
            table[r2, nth] = v[pick]
            key = np.full(texts, (b << 8) + d + 1, np.uint64)
            for j in range(depth):
                key = words.mix(key ^ table[:, j])
            out[:, b, d] = key
    out[size == 0] = 0
    return out


SKETCH = "id long, n_words int, h1 long, h2 long, keys binary, tokens binary"


def sketched(docs: DataFrame, id_col: str, text_col: str, bands: int, seed: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of ``docs``: counts, a 128-bit hash of all words, keys, the words as 64-bit hashes, and ``keep`` columns as ``keep0``, ``keep1``..."""
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *[F.col(c).alias(f"keep{i}") for i, c in enumerate(keep)])
    kept = plain.columns[2:]
    ddl = ", ".join([SKETCH, *(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema[2:])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in words.chunks(batches, "text"):
            h, before = token_hashes(data, offsets)
            place = (np.arange(len(h)) - before[words.rows_of(before)]).astype(np.uint64)
            sums = []
            for salt in (np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)):
                total = np.concatenate([[np.uint64(0)], np.cumsum(words.mix(h ^ (place * salt + salt)), dtype=np.uint64)])
                sums.append((total[before[1:]] - total[before[:-1]]).view(np.int64))
            keys = sketch(*runs(h, before), bands=bands, seed=seed)
            binary = lambda flat, cuts: pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(flat.tobytes())])
            width = keys[0].nbytes
            yield pa.RecordBatch.from_arrays(
                [rows.column("id"), pa.array(np.diff(before), pa.int32()), pa.array(sums[0]), pa.array(sums[1]), binary(keys, np.arange(len(rows) + 1) * width), binary(h, before * 8), *(rows.column(c) for c in kept)],
                names=["id", "n_words", "h1", "h2", "keys", "tokens", *kept],
            )

    return plain.mapInArrow(run, ddl)


# ---------------------------------------------------------------- alignment


def banded_distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Edits between two sequences if at most ``most``, else ``most`` + 1.

    Equal ends are cut off. The rest runs column by column through bit vectors that hold one
    band of diagonals: bit i stands for row column + i - most, and the band moves one row down
    with each column, so the vectors shift right as they advance.
    """
    n = min(len(a), len(b))
    same = a[:n] == b[:n]
    cut = n if same.all() else int(same.argmin())
    a, b = a[cut:], b[cut:]
    n = min(len(a), len(b))
    if n:
        same = a[::-1][:n] == b[::-1][:n]
        cut = n if same.all() else int(same.argmin())
        a, b = a[: len(a) - cut], b[: len(b) - cut]
    if abs(len(a) - len(b)) > most:
        return most + 1
    if not len(a) or not len(b):
        return max(len(a), len(b))
    if len(a) < len(b):
        a, b = b, a
    m, n = len(a), len(b)
    most, all_ = min(most, m - 1), most
    width = 2 * most + 2
    mask, top = (1 << width) - 1, width - 1
    where: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        where[x] = where.get(x, 0) | 1 << i
    # In column 0 each row is one more than the row above it; rows above row 0 don't count.
    plus, minus = mask & ~((1 << (top - most)) - 1), 0
    score = most  # on the lowest diagonal of the band, then, from where that leaves the table, in row m
    for j, x in enumerate(b.tolist()):
        low = j + most - top  # place in a of bit 0
        p = where.get(x, 0)
        p = (p >> low if low >= 0 else p << -low) & mask
        zero = ((((p & plus) + plus) ^ plus) | p | minus) & mask
        up = (minus | ~(zero | plus)) & mask
        down = zero & plus
        if j < m - most:
            score += not zero >> top & 1
        else:
            bit = top - 1 - (j - (m - most))
            score += (up >> bit & 1) - (down >> bit & 1)
        if score > most + n - 1 - j + max(0, most - (m - n)):
            break
        right = zero >> 1
        plus = (down | ~(right | up)) & mask
        minus = right & up
    else:
        return min(score, most + 1)
    return min(most + 1, all_ + 1)


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    longer = max(len(a), len(b))
    most = int(longer * (1 - least) + 1e-9)
    if longer - min(len(a), len(b)) > most:
        return False
    if longer > 24:
        common = sum((Counter(a.tolist()) & Counter(b.tolist())).values())
        if longer - common > most:
            return False
    # A narrow band settles pairs with few edits.
    return (most > NARROW and banded_distance(a, b, NARROW) <= NARROW) or banded_distance(a, b, most) <= most


def verified(pairs: DataFrame, tokens: DataFrame, least: float) -> DataFrame:
    """(hub, row, near) for pairs (hub, row)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [similar(np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64), least) for a, b in zip(batch.column("a"), batch.column("b"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("hub"), batch.column("row"), pa.array(near, pa.bool_())], names=["hub", "row", "near"])

    return with_tokens(pairs, tokens).select("hub", "row", "a", "b").mapInArrow(run, "hub long, row long, near boolean")


def with_tokens(pairs: DataFrame, tokens: DataFrame) -> DataFrame:
    """``pairs`` (staged; hub, row and other columns) with the words of the hub as ``a`` and of the row as ``b``.

    Only words of texts that are in a pair move. The last join is by row, so that the pairs of a
    hot hub end up in many tasks.
    """
    of = lambda side: tokens.join(pairs.select(F.col(side).alias("row")).distinct(), "row", "left_semi")
    half = pairs.join(of("hub").select(F.col("row").alias("hub"), F.col("tokens").alias("a")), "hub")
    return half.join(of("row").withColumnRenamed("tokens", "b"), "row")


# ---------------------------------------------------------------- completion


def rarity(tokens: DataFrame) -> np.ndarray:
    """Occurrences of words by the low bits of their hashes, up to 65,535.

    It orders words, so sharing a place costs no result; a place with one occurrence is a word
    that one text has alone.
    """
    size = 1 << RARITY_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int32)
        for batch in batches:
            data, _ = words.buffer_of(batch.column("tokens"))
            total += np.bincount((data[:-8].view(np.uint64) & np.uint64(size - 1)).view(np.int64), minlength=size).astype(np.int32)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["at", "n"])

    sums = tokens.select("tokens").mapInArrow(run, "at int, n int").groupBy("at").agg(F.sum("n").alias("n")).where("n > 1")
    found = sums.select("at", F.least("n", F.lit(65_535)).cast("int").alias("n")).toArrow()
    out = np.ones(size, np.uint16)
    out[found.column("at").to_numpy()] = found.column("n").to_numpy()
    return out


def labelled(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words, sorted, and each with the number of its occurrence as one 64-bit hash."""
    t = np.sort(t)
    at = np.arange(len(t))
    first = np.ones(len(t), bool)
    first[1:] = t[1:] != t[:-1]
    turn = (at - np.maximum.accumulate(np.where(first, at, 0))).astype(np.uint64)
    return t, words.mix(t + turn * np.uint64(0x632BE59BD9B4E019))


def prefix(t: np.ndarray, hub: np.ndarray, often: np.ndarray, least: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """The first labelled words of a text, of which a similar text has one among its own first, and their places.

    Words that no other text has are left out.
    """
    word, own = labelled(t)
    rare = often[word & np.uint64(len(often) - 1)]
    turn = np.lexsort((own, rare, np.isin(own, labelled(hub)[1])))[: int(len(own) * (1 - least) + 1e-9) + 1]
    place = np.flatnonzero(rare[turn] > 1)
    return own[turn[place]], place


def completed(members: DataFrame, tokens: DataFrame, least: float) -> DataFrame:
    """Pairs (hub, row) of members (hub, row, root) of one hub with other roots that may be similar."""
    often = members.sparkSession.sparkContext.broadcast(rarity(tokens))
    # Two texts meet in the first of the groups that both are in; a text is in one group a band at most.
    hubs = members.groupBy("row").agg(F.collect_set("hub").alias("hubs"))
    lower = F.filter("hubs", lambda h: h < F.col("hub")).alias("lower")
    members = staged(members.join(hubs, "row").select("hub", "row", "root", lower), "members-hubs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = ([np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(c)] for c in "ab")
            got = [prefix(y, x, often.value, least) for x, y in zip(a, b, strict=True)]
            many = np.array([len(x) for x, _ in got], np.int64)
            row = pa.array(np.repeat(np.arange(len(got)), many))
            size = np.repeat(np.array([len(x) for x in b], np.int64), many)
            word, place = (np.concatenate(x) for x in zip(*got, strict=True)) if got else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            at = np.arange(len(word))
            low = np.maximum(np.repeat(np.cumsum(many) - many, many), at - EARLIER)
            upto = np.concatenate([[0], np.cumsum(at - low)])
            before = word[np.arange(upto[-1]) + np.repeat(low - upto[:-1], at - low)]
            earlier = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(before.view(np.int64)))
            flat = pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(row) for c in ("hub", "row", "root", "lower")), pa.array(word.view(np.int64)), earlier, pa.array(size, pa.int32()), pa.array(size - place, pa.int32())],
                names=["hub", "row", "root", "lower", "word", "earlier", "n", "left"],
            )
            for begin in range(0, len(flat), 1 << 16):
                yield flat.slice(begin, 1 << 16)

    each = with_tokens(members, tokens).select("hub", "row", "root", "lower", "a", "b").mapInArrow(run, "hub long, row long, root long, lower array<long>, word long, earlier array<long>, n int, left int")
    # Only words of two roots at least pair any.
    each = staged(each, "prefixes")
    shared = Window.partitionBy("hub", "word")
    roots = each.withColumns({"low": F.min("root").over(shared), "high": F.max("root").over(shared)})
    each_several = staged(roots.where("low <> high").drop("low", "high"), "prefix-words")
    x, y = each_several.alias("x"), each_several.alias("y")
    # Words in common: at most those from the first shared one on, at least all but the edits allowed.
    need = F.greatest("x.n", "y.n") - F.floor(F.greatest("x.n", "y.n") * (1 - least) + 1e-9)
    same = (F.col("x.hub") == F.col("y.hub")) & (F.col("x.word") == F.col("y.word"))
    # Where two texts share one of the words just before, too, they meet there.
    may = ~F.arrays_overlap("x.earlier", "y.earlier") & ~F.arrays_overlap("x.lower", "y.lower") & (F.col("x.row") < F.col("y.row")) & (F.col("x.root") != F.col("y.root")) & (F.least("x.left", "y.left", "x.n", "y.n") >= need)
    pairs = staged(x.join(y.hint("merge"), same & may).select(F.col("x.row").alias("hub"), F.col("y.row").alias("row")).distinct(), "pairs")
    discard(members.sparkSession, each, each_several, members)
    return pairs


# ---------------------------------------------------------------- classes


def components(links: DataFrame) -> DataFrame:
    """(v, root) for the linked vertices, from links (u, v); root is the smallest vertex. Staged.

    Alternates large-star and small-star steps until the links no longer change.
    """
    spark = links.sparkSession
    both = F.array(F.struct(F.col("u").alias("a"), F.col("v").alias("b")), F.struct(F.col("v").alias("a"), F.col("u").alias("b")))
    edges = staged(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    said = None
    while True:
        # Large star: larger neighbours go to the smallest of all neighbours and the vertex.
        sides = edges.select(F.explode(both).alias("e")).select("e.a", "e.b")
        low = staged(sides.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "low")
        large = staged(sides.join(low, "a").where("b > a").select(F.col("b").alias("u"), F.col("m").alias("v")).distinct(), "large")
        discard(spark, low)
        # Small star: smaller neighbours and the vertex go to the smallest.
        low = staged(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        moved = large.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        last, edges = edges, staged(moved, "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        for old in (low, large, last):
            discard(spark, old)
        if now == said:
            return edges.select(F.col("u").alias("v"), F.col("v").alias("root"))
        said = now


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, bands: int = BANDS, seed: int = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of ``docs``: id, class_id (smallest id of the class), class_size, kept (one row of each class), and ``keep`` columns."""
    spark = docs.sparkSession
    kept = [f"keep{i}" for i in range(len(keep))]
    rows = staged(sketched(docs, id_col, text_col, bands, seed, keep).withColumn("row", F.monotonically_increasing_id()), "sketches")
    words_key = ["h1", "h2", "n_words"]
    vertices = staged(rows.groupBy(*words_key).agg(F.min("row").alias("vertex")), "vertices")
    members = staged(rows.select("row", "id", *kept, *words_key).join(vertices, words_key).select("row", "id", *kept, "vertex"), "members")
    own = vertices.where("n_words > 0").select(F.col("vertex").alias("row"))

    # Keys of the vertices, as big-endian hex of eight bytes each, by band and depth.
    key = lambda band, d: F.expr(f"substring(keys, 1 + ({band} * {len(DEPTHS)} + {d}) * 8, 8)")
    level = [f"k{d}" for d in DEPTHS]
    by_band = F.explode(F.array(*[F.struct(*[F.conv(F.hex(key(b, d)), 16, -10).cast("long").alias(n) for d, n in enumerate(level)]) for b in range(bands)]))
    keyed = rows.select("row", "keys").join(own.hint("merge"), "row").select("row", by_band.alias("k")).select("row", "k.*")
    shared = staged(keyed.groupBy(level[0]).agg(F.count("*").alias("n"), F.min("row").alias("first")).where("n > 1"), "shared")
    # Vertices and shared keys grow with the input, so these are sort merge joins at every size.
    keyed = staged(keyed.join(shared.hint("merge"), level[0]).drop("n", "first"), "keyed")
    paired = staged(keyed.select("row").distinct(), "paired")
    tokens = staged(rows.select("row", "tokens").join(paired, "row"), "tokens")
    # Groups by their first hub; groups of one hub count as one.
    grouped = staged(keyed.join(shared, level[0]).where("row <> first").select(F.col("first").alias("hub"), "row").distinct(), "grouped")

    links, verdicts = [], []
    for number, hubs_of_group in enumerate(HUBS):
        group = [level[0], level[number]][: number + 1]
        slot = F.pmod(F.xxhash64("row", F.lit(number)), F.lit(hubs_of_group))
        slotted = keyed.withColumn("slot", slot)
        hubs = staged(slotted.groupBy(*group, "slot").agg(F.min("row").alias("hub")), "hubs")
        marked = slotted.join(hubs, [*group, "slot"]).withColumn("is_hub", F.col("row") == F.col("hub")).drop("hub", "slot")
        full = staged(marked.join(hubs.drop("slot"), group).where("row <> hub and (not is_hub or row > hub)"), "full")
        pairs = staged(full.select("hub", "row").distinct(), "pairs")
        verdict = staged(verified(pairs, tokens, similarity), "verdicts")
        verdicts.append(verdict)
        links.append(verdict.where("near").select(F.col("hub").alias("u"), F.col("row").alias("v")))
        apart = full.where("not is_hub").join(verdict, ["hub", "row"]).groupBy(*level, "row").agg(F.max("near").alias("near"))
        old, keyed = keyed, staged(apart.where("not near").drop("near"), "apart")
        discard(spark, old, hubs, full, pairs)
        if keyed.isEmpty():
            break
    union = links[0]
    for more in links[1:]:
        union = union.unionByName(more)
    roots = components(union)
    rooted = grouped.join(roots.withColumnRenamed("v", "row"), "row", "left").select("hub", "row", F.coalesce("root", "row").alias("root"))
    split = rooted.groupBy("hub").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("hub")
    apart = staged(rooted.join(split, "hub"), "split")
    if not apart.isEmpty():
        pairs = completed(apart, tokens, similarity)
        verdict = staged(verified(pairs, tokens, similarity), "verdicts")
        verdicts.append(verdict)
        more = verdict.where("near").select(F.col("hub").alias("u"), F.col("row").alias("v"))
        old, roots = roots, components(roots.select(F.col("v").alias("u"), F.col("root").alias("v")).unionByName(more))
        discard(spark, old, pairs)
    discard(spark, grouped, apart)
    placed = staged(
        members.join(roots.withColumnRenamed("v", "vertex"), "vertex", "left").select("row", "id", *kept, F.coalesce("root", "vertex").alias("root")), "placed"
    )
    discard(spark, rows, vertices, members, shared, keyed, paired, tokens, *verdicts)
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row"))
    classes = staged(placed.groupBy("root").agg(best.alias("best"), F.count("*").alias("class_size")), "classes")
    return placed.join(classes, "root").select(
        F.col("id").alias(id_col), F.col("best.id").alias("class_id"), "class_size", (F.col("row") == F.col("best.row")).alias("kept"), *[F.col(n).alias(c) for n, c in zip(kept, keep, strict=True)]
    )
