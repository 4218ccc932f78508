"""Links between documents whose sets of n-grams are alike, by T-occurrence search."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import U64, by_key, group_bounds, joined, materialize, rolled, slices, utf8, word_bytes, words
from ._components import connected_components, contracted


def shingle_sets(texts: list[bytes], n: int) -> tuple[list[np.ndarray], list[bytes]]:
    """Sorted hashes of each text's distinct n-grams of lower-cased words (with fewer words the whole sequence is one), and a digest of its words."""
    lanes, offsets = words(texts, lower=True)
    runs = rolled(lanes[0], n)
    pairs = np.ascontiguousarray(lanes.T)
    sets, digests = [], []
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        if b - a >= n:
            sets.append(np.unique(runs[a : b - n + 1]))
        elif b > a:
            sets.append(joined(rolled(lanes[0, a:b], int(b - a))[:1], U64(b - a)))
        else:
            sets.append(runs[:0])
        digests.append(hashlib.blake2b(pairs[a:b].data, digest_size=16).digest())
    return sets, digests


def exact_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """Each text's distinct n-grams as sorted numbers: equal ones if and only if the words are equal, letter by letter."""
    array, offsets = word_bytes(texts, lower=True)
    if not len(array):
        return [np.zeros(0, np.int64) for _ in texts]
    number = array.dictionary_encode().indices.to_numpy().astype(np.int64)
    runs = number
    for k in range(1, n):  # pairs (run of k words, word after it), numbered anew
        after = np.append(number[k:], np.zeros(min(k, len(number)), np.int64))
        runs = np.unique(runs * (int(number.max()) + 1) + after, return_inverse=True)[1]
    short: dict[bytes, int] = {}
    out = []
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        if b - a >= n:
            out.append(np.unique(runs[a : b - n + 1]))
        elif b > a:
            out.append(np.array([-1 - short.setdefault(number[a:b].tobytes(), len(short))]))
        else:
            out.append(runs[:0])
    return out


def sketch(own: np.ndarray) -> bytes:
    """Parities of the numbers of elements by residue of their hash, of a power of two of residues near the size."""
    bits = 1 << max(8, min(13, int(len(own) - 1).bit_length())) if len(own) else 256
    parity = np.bincount((own & U64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8)).tobytes()


class Sketches:
    """Sketches of many sets as bit matrices by width; a wider one folds to half its width by joining its halves."""

    def __init__(self, data: list[bytes]) -> None:
        self.width = np.fromiter(map(len, data), np.int64, len(data))
        self.place = np.zeros(len(data), np.int64)
        self.own: dict[int, np.ndarray] = {}
        for w in np.unique(self.width).tolist():
            at = np.flatnonzero(self.width == w)
            self.place[at] = np.arange(len(at))
            self.own[w] = np.frombuffer(b"".join(data[r] for r in at.tolist()), np.uint64).reshape(len(at), -1)
        self.half = {w // 2: np.bitwise_xor(m[:, : m.shape[1] // 2], m[:, m.shape[1] // 2 :]) for w, m in self.own.items() if m.shape[1] > 1}

    def rows(self, r: np.ndarray, w: int) -> np.ndarray:
        """Those of rows r at width w, which is theirs or half of it."""
        out = np.empty((len(r), w // 8), np.uint64)
        same = self.width[r] == w
        if same.any():
            out[same] = self.own[w][self.place[r[same]]]
        if not same.all():
            out[~same] = self.half[w][self.place[r[~same]]]
        return out


def alike(i: np.ndarray, j: np.ndarray, sketches: Sketches, size: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which pairs can reach the similarity num / den (over a half): sketches differ in no more bits than the sets in elements."""
    out = den * np.minimum(size[i], size[j]) >= num * np.maximum(size[i], size[j])
    at = np.flatnonzero(out)  # of fitting sizes, so of one width or two next to each other
    least = np.minimum(sketches.width[i[at]], sketches.width[j[at]])
    for w in np.unique(least).tolist():
        own = at[least == w]
        for a in range(0, len(own), 1 << 15):
            part = own[a : a + (1 << 15)]
            bits = np.bitwise_count(sketches.rows(i[part], w) ^ sketches.rows(j[part], w)).sum(axis=1, dtype=np.int64)
            out[part] = (den + num) * bits <= (den - num) * (size[i[part]] + size[j[part]])
    return out


def _joined(rows: np.ndarray, sketches: Sketches, size: np.ndarray, num: int, den: int) -> np.ndarray:
    """For each of the rows, which are sorted by size, the first of those that alike pairs join it with."""
    m = len(rows)
    near = np.zeros((m, m), bool)
    for w in np.unique(sketches.width[rows]).tolist():
        x = np.flatnonzero(sketches.width[rows] == w)
        y = np.flatnonzero((sketches.width[rows] == w) | (sketches.width[rows] == 2 * w))
        left, right = sketches.rows(rows[x], w), sketches.rows(rows[y], w)
        n_left, n_right = size[rows[x]], size[rows[y]]
        for a in range(len(x)):
            to = np.searchsorted(n_right, den * n_left[a] // num, "right")  # of fitting sizes
            low = np.searchsorted(n_right, -(-num * n_left[a] // den), "left")
            bits = np.bitwise_count(right[low:to] ^ left[a]).sum(axis=1, dtype=np.int64)
            near[x[a], y[low:to]] = (den + num) * bits <= (den - num) * (n_left[a] + n_right[low:to])
    near |= near.T
    label = np.arange(m)
    while True:
        new = np.where(near, label[None, :], m).min(axis=1)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def candidate_edges(keys: np.ndarray, ids: np.ndarray, size: np.ndarray, data: list[bytes], num: int, den: int, small: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of ids that join, within each key, all that `alike` pairs join; rows are sorted by key and size.

    Of small groups these are the alike pairs, of a larger one each member and the first that it is joined with.
    """
    bounds = group_bounds(keys)
    length = np.diff(bounds)
    sketches = Sketches(data)
    of_small = np.repeat(length <= small, length)
    left, right = [], []
    for lag in range(1, min(small, len(keys))):
        i = np.flatnonzero((keys[:-lag] == keys[lag:]) & of_small[:-lag])
        if len(i):
            fine = alike(i, i + lag, sketches, size, num, den)
            left.append(ids[i[fine]])
            right.append(ids[i[fine] + lag])
    for a, b in zip(bounds[:-1][length > small], bounds[1:][length > small], strict=True):
        label = _joined(np.arange(a, b), sketches, size, num, den)
        own = np.flatnonzero(label != np.arange(b - a))
        left.append(ids[a + own])
        right.append(ids[a + label[own]])
    none = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def linked(sets: list[np.ndarray], num: int, den: int, every: bool = False) -> list[tuple[int, int]]:
    """A forest of the pairs of sets with den * intersection >= num * union, which joins all that such pairs join; with `every` all pairs.

    Sets are taken by size; each searches the inverted lists of those before it for sets in at least
    T = ceil(num * size / den) of its lists. DivideSkip: some T / (1 + 0.01 log M) longest lists (M: the longest) are
    set aside, the short ones merged, and sets that occur there often enough looked up in the long ones by binary
    search. Sets that are joined already are not looked up.
    """
    order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), i))
    size = np.array([len(sets[i]) for i in order])
    token, flat = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True) if order else (np.zeros(0), np.zeros(0, np.int64))
    ends = np.cumsum(size)
    place = np.repeat(np.arange(len(order)), size)[np.argsort(flat, kind="stable")]
    tokens = np.sort(flat)
    start = np.searchsorted(tokens, np.arange(len(token)))
    entries = tokens * len(order) + place  # all lists one after another, each sorted
    filled = np.zeros(len(token), np.int64)
    root = np.arange(len(order))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    edges = []
    for x in range(len(order)):
        own = flat[ends[x] - size[x] : ends[x]]
        count = filled[own]
        filled[own] += 1
        need = -(-num * int(size[x]) // den)
        shared = own[count > 0]
        if len(shared) < need or not need:
            continue
        by_length = shared[np.argsort(count[count > 0], kind="stable")]
        longest = int(filled[by_length[-1]])
        aside = min(need - 1, int(need / (1 + 0.01 * np.log2(longest + 1))))
        short, long = by_length[: len(by_length) - aside], by_length[len(by_length) - aside :]
        lists = [place[start[t] : start[t] + filled[t] - 1] for t in short.tolist()]
        if sum(map(len, lists)) <= 64:
            seen: dict[int, int] = {}
            for y in heapq.merge(*(q.tolist() for q in lists)):
                seen[y] = seen.get(y, 0) + 1
            found, times = np.array(list(seen), np.int64), np.array(list(seen.values()), np.int64)
        else:
            found, times = np.unique(np.concatenate(lists), return_counts=True)
        fine = (times >= need - aside) & (den * size[found] >= num * size[x])
        found, times = found[fine], times[fine]
        step = 4
        while len(found):
            part, hits = found[:step], times[:step]
            probe = (long[:, None] * len(order) + part).ravel()
            at = np.minimum(np.searchsorted(entries, probe), len(entries) - 1)
            hits = hits + (entries[at] == probe).reshape(len(long), len(part)).sum(axis=0)
            for y in part[den * hits >= num * (size[x] + size[part] - hits)].tolist():
                if every:
                    edges.append((order[x], order[y]))
                elif find(y) != find(x):
                    root[find(y)] = find(x)
                    edges.append((order[x], order[y]))
            found, times = found[step:], times[step:]
            if len(found) and not every:
                mine = find(x)
                open_ = np.array([find(y) != mine for y in found.tolist()])
                found, times = found[open_], times[open_]
            step = max(8, (1 << 16) // max(1, len(long)))
    return edges


def _blocked(rows: DataFrame, key: str, blocks: str) -> DataFrame:
    """Deals the rows of a large group into blocks, and each row to the pairs of its block with every other: `part` is the pair."""
    rows = rows.withColumn("_b", F.expr(f"pmod(xxhash64(doc_id), {blocks})"))
    rows = rows.withColumn("_o", F.explode(F.expr(f"sequence(0L, bigint({blocks}) - 1)")))
    return rows.withColumn("part", F.expr(f"xxhash64({key}, least(_b, _o), greatest(_b, _o))")).drop("_b", "_o")


def _links(texts: DataFrame, n: int, num: int, den: int, sample_docs: int, group_rows: int, group_shingles: int, every: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, n, key) of each row, (key, rep) of each class of equal word sequences, and links (a, b) between representatives: with `every` all, else stars that join the same in each task."""
    count = texts.count()

    def spread(batches):
        for batch in slices(batches):
            own = [s for s in shingle_sets(utf8(batch.column("text")), n)[0] if len(s)]
            if own:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own).view(np.int64))], ["s"])

    step = max(1, -(-count // sample_docs))
    sampled = texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(step)) == 0)
    often = sampled.mapInArrow(spread, "s bigint").groupBy("s").count().where(F.col("count") >= max(8, min(count, sample_docs) // 500))
    heavy = np.sort(np.array([r[0] for r in often.orderBy(F.desc("count"), "s").limit(100_000).collect()], np.int64).view(np.uint64))

    def describe(batches):
        for batch in slices(batches):
            rows = []
            for own, digest in zip(*shingle_sets(utf8(batch.column("text")), n), strict=True):
                late = np.isin(own, heavy, assume_unique=True)
                prefix = np.concatenate([own[~late], own[late]])[: len(own) - -(-num * len(own) // den) + 1] if len(own) else own
                rows.append((len(own), digest, sketch(own), prefix.view(np.int64)))
            size, key, bits, prefix = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(key, pa.binary()), pa.array(bits, pa.binary()), pa.array(prefix, pa.list_(pa.int64()))], ["doc_id", "n", "key", "sketch", "prefix"])

    described = materialize(texts.mapInArrow(describe, "doc_id bigint, n bigint, key binary, sketch binary, prefix array<bigint>"))
    classes = materialize(described.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n")))
    reps = described.join(classes.select(F.col("rep").alias("doc_id"), "key"), ["doc_id", "key"], "left_semi")

    tokens = reps.select("doc_id", "n", F.explode("prefix").alias("token"))
    near = "over (partition by token order by n, doc_id"
    tokens = tokens.selectExpr("*", f"lag(n) {near}) as less", f"lead(n) {near}) as more", f"count(1) {near} rows between unbounded preceding and unbounded following) as rows")
    tokens = tokens.where(f"{den} * less >= {num} * n or {den} * n >= {num} * more").select("doc_id", "n", "token", "rows")
    # a long document has many prefix rows: its sketch is sent once for each few hundred of them
    salts = f"1 + n * {den - num} div {den * 256}"
    tokens = _blocked(tokens, "token", f"ceil(rows / {group_rows})").withColumn("salt", F.expr(f"pmod(xxhash64(token), {salts})"))
    drawn = reps.select("doc_id", "n", "sketch", F.explode(F.expr(f"sequence(0L, bigint({salts}) - 1)")).alias("salt"))
    met = tokens.select("doc_id", "salt", "part").join(drawn, ["doc_id", "salt"])

    def compare(table: pa.Table) -> Iterator[pa.RecordBatch]:
        a, b = candidate_edges(table.column("part").to_numpy(), table.column("doc_id").to_numpy(), table.column("n").to_numpy(), table.column("sketch").to_pylist(), num, den)
        a, b = contracted(a, b)  # what the task's groups join
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    clusters = materialize(connected_components(by_key(met, "part", compare, "a bigint, b bigint", rows=8000, order=("n", "doc_id")), "a", "b"))
    sizes = clusters.join(classes.selectExpr("rep as node", "n"), "node").groupBy("label").agg(F.count("*").alias("members"), F.sum("n").alias("total"))
    sizes = materialize(sizes.selectExpr("label", f"bigint(greatest(ceil(members / {group_rows}), ceil(total / {group_shingles}))) as blocks"))
    own = clusters.join(sizes, "label").select(F.col("node").alias("doc_id"), "label", "blocks")
    members = _blocked(texts.join(own, "doc_id"), "label", "blocks").select("part", "doc_id", "text")

    def search(table: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, texts_ = table.column("doc_id").to_numpy(), utf8(table.column("text"))
        bounds = group_bounds(table.column("part").to_numpy())
        a, b = [], []
        for first, last in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            for x, y in linked(exact_sets(texts_[first:last], n), num, den, every):
                a.append(min(ids[first + x], ids[first + y]))
                b.append(max(ids[first + x], ids[first + y]))
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        if not every:
            a, b = contracted(a, b)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return described.select("doc_id", "n", "key"), classes, by_key(members, "part", search, "a bigint, b bigint", rows=256)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.where(docs[id_col].isNotNull()).select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].alias("text"))


def jaccard_links(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = 4000, group_rows: int = 2048, group_shingles: int = 1 << 20) -> tuple[DataFrame, DataFrame]:
    """(a, b), all linked pairs of representatives, a < b, and (doc_id, rep), the documents that each stands for.

    A representative is the least id of those with the same lower-cased words, which are linked without being listed.
    Ids must differ; null ids and texts without words are in neither table.
    """
    same, classes, links = _links(_texts(docs, id_col, text_col), n, num, den, sample_docs, group_rows, group_shingles, True)
    return links.distinct(), same.join(classes.select("key", "rep"), "key").select("doc_id", "rep")


def jaccard_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = 4000, group_rows: int = 2048, group_shingles: int = 1 << 20) -> DataFrame:
    """(doc_id, n_shingles, component_id): documents joined by links, which are pairs with den * intersection >= num * union.

    1. One pass gives every document's size, digest, sketch and prefix: the shingles of which a similar set must hold
       one, in an order that puts those last which a bounded sample (`sample_docs`) finds frequent.
    2. Texts of the same words (a 128-bit digest of them) become one. Sets that share a prefix shingle and are of
       fitting size are compared by sketches, which never underrate; what may be alike falls into clusters.
    3. The texts of a cluster meet, and T-occurrence search over their words themselves finds the exact links
       (`linked`). Groups and clusters over `group_rows` documents or `group_shingles` shingles are dealt out as pairs
       of blocks.

    Null and empty texts have no shingles and are linked with nothing. Rows whose id is null are left out; rows that
    repeat an id stay, and an id's component joins those of all its rows' texts. Other columns are not read.
    """
    described, classes, links = _links(_texts(docs, id_col, text_col), n, num, den, sample_docs, group_rows, group_shingles, False)
    same = described.join(classes.select("key", "rep"), "key", "left")
    repeated = described.groupBy("doc_id").count().where("count > 1").select("doc_id")  # one id, several texts
    bridges = same.join(repeated, "doc_id").where("rep is not null").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    found = materialize(connected_components(links.unionAll(bridges), "a", "b")).selectExpr("node as rep", "label")
    same = same.withColumn("rep", F.coalesce("rep", "doc_id"))
    return same.join(found, "rep", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("label", "rep").alias("component_id"))


def keep_one_of_each(docs: DataFrame, components: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """All columns of the documents whose id is their component's; documents without a component (null ids) stay."""
    gone = components.where("component_id < doc_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs[id_col].cast("bigint") == gone["_gone"], "left_anti")
