"""Documents whose sets of word shingles have a Jaccard similarity of at least a threshold, by a token-group matrix.

1. Documents with one and the same set are one from here on (a signature of the whole set).
2. Similar sets are put into groups: sets that share one of three min-hashes, and sets those share one with, form a
   family. A family is first compared in neighbourhoods of bounded size, which have a few members in common, and what that
   links is a cluster: its members are not compared again, so N near copies cost N. Then families are cut into blocks of
   bounded size, large clusters apart. Groups steer cost only; no link depends on them.
3. The matrix has a row for every token and group in whose members' prefixes it occurs. A set of n tokens can only be
   linked with one that shares a token of the n - ceil(t n) + 1 rarest of both, so groups that share none with a query
   are never opened, and every other pair of query and group with members of other clusters is.
   The tokens that a query's prefix shares with those of a group bound the overlap further: a linked pair's overlap lies in
   both prefixes, or beyond the one that ends first, so too few shared tokens rule a group out before it is opened.
4. An opened group knows the union of its members' tokens. A query with fewer than t n tokens in the union is linked with
   none of them; otherwise its overlap with all members is counted exactly, from the group's token-to-member lists.
5. Links become components. What an opened group returns are at most as many edges as it has documents.

The rarity order counts tokens over all documents, exactly enough to put frequent ones last; any order gives right results.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .connected import components

_B, _C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_SEEDS = (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0)
HEAVY = 1 << 17  # most tokens whose frequency is kept for the order
WINDOW = 1_000_000  # tokens that a task holds before it passes them on
BLOCK = 256
NEAR = 64  # members of a neighbourhood
COMMON = 4  # members that the neighbourhoods of a family, or of one min-hash in it, have in common
FEW = 16
CHUNK = 512
WANTED_BITS = 24  # of the filter that says which documents' texts move


def mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(33))) * _C1
        h = (h ^ (h >> np.uint64(29))) * _C2
    return h ^ (h >> np.uint64(32))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; words are lower-cased (A-Z) runs without ASCII white space."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    size = min(width, len(words))
    with np.errstate(over="ignore"):
        out = np.full(len(h) - size + 1, size, dtype=np.uint64)
        for k in range(size):
            out = out * _B + h[k : k + len(out)]
    return np.unique(mix(out))


def least_overlap(n, percent: int):
    """Tokens of a set of n that a linked set must share."""
    return (percent * n + 99) // 100


def signature(tokens: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(tokens.tobytes())


def statistics(docs: DataFrame, width: int) -> DataFrame:
    """One row per document (doc_id, n, sig, m1..m3), and rows (token, df) of tokens frequent within a window of a task."""

    def run(batches):
        held, seen, size = [], set(), 0

        def frequent():
            tokens, counts = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            often = counts >= 2
            return tokens[often], counts[often]

        def emit(ids, n, sig, mins, tokens, counts):
            k, m = len(ids), len(tokens)
            pad = lambda values, kind: pa.concat_arrays([pa.array(values, kind), pa.nulls(m, kind)])
            columns = [pad(ids, pa.int64()), pad(n, pa.int64()), pad(sig, pa.binary())]
            columns += [pad([x[j] for x in mins], pa.int64()) for j in range(3)]
            columns += [pa.concat_arrays([pa.nulls(k, pa.int64()), pa.array(v, pa.int64())]) for v in (tokens.view(np.int64), counts.astype(np.int64))]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "sig", "m1", "m2", "m3", "token", "df"])

        for batch in batches:
            ids, n, sig, mins = batch.column(0).to_pylist(), [], [], []
            for value in batch.column(1):
                tokens = shingles(value.as_py(), width)
                n.append(len(tokens))
                sig.append(signature(tokens))
                mins.append([int(mix(tokens ^ np.uint64(s)).min().view(np.int64)) for s in _SEEDS] if len(tokens) else [0, 0, 0])
                if sig[-1] not in seen:
                    seen.add(sig[-1])
                    held.append(tokens)
                    size += len(tokens)
            none = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
            found = none
            if size >= 4 * WINDOW:
                found, held, seen, size = frequent(), [], set(), 0
            yield emit(ids, n, sig, mins, *found)
        yield emit([], [], [], [], *frequent())

    rows = docs.select(docs["doc_id"].cast("long"), docs["text"])
    return rows.mapInArrow(run, "doc_id long, n long, sig binary, m1 long, m2 long, m3 long, token long, df long")


def frequent_tokens(counts: DataFrame) -> np.ndarray:
    """The most frequent tokens, rarest first: those from the lowest frequency on for which at most HEAVY are left.

    A histogram of frequencies on a log scale finds that frequency, so the driver gets a few hundred rows and then HEAVY."""
    totals = counts.groupBy("token").agg(F.sum("df").alias("df")).withColumn("level", F.floor(8 * F.log2("df")))
    totals = materialize(totals, "frequencies")
    left, least = HEAVY, None
    for level, n in sorted(totals.groupBy("level").count().collect(), reverse=True):
        left -= n
        if left < 0:
            break
        least = level
    if least is None:
        return np.zeros(0, dtype=np.uint64)
    rows = totals.where(F.col("level") >= least).select("token", "df").toPandas().sort_values(["df", "token"])
    return rows["token"].to_numpy(dtype=np.int64).view(np.uint64).copy()


def families(sets: DataFrame, rounds: int = 2) -> DataFrame:
    """(doc, n, m1, label): sets that share min-hashes, or share them with such sets, have one label."""
    label = sets.select("doc", F.least("m1", "m2", "m3").alias("label"))
    values = sets.select("doc", F.explode(F.array("m1", "m2", "m3")).alias("value"))
    for _ in range(rounds):
        least = values.join(label, "doc").groupBy("value").agg(F.min("label").alias("least"))
        label = values.join(least, "value").groupBy("doc").agg(F.min("least").alias("label"))
    return sets.select("doc", "n", "m1").join(label, "doc")


def neighbourhoods(labels: DataFrame) -> DataFrame:
    """(doc, block): about NEAR members of a family a block, by their first min-hash. Where more have the same, they are cut
    into several; COMMON of them, and COMMON of the family, are in each, so that clusters meet across blocks."""
    counted = lambda *by: labels.groupBy(*by).agg(F.count(F.lit(1)).alias("size"))
    family = counted("label").where("size > 1").withColumnRenamed("size", "family")
    alike = counted("label", "m1").where(F.col("size") > NEAR).withColumnRenamed("size", "alike")
    parts = lambda size: F.ceil(F.col(size) / NEAR).cast("long")
    dealt = labels.join(family, "label").join(alike, ["label", "m1"], "left").withColumn("block", F.when(F.col("alike").isNull(), F.xxhash64("label", F.pmod(F.xxhash64("m1"), parts("family")))).otherwise(F.xxhash64("label", "m1", F.pmod(F.xxhash64("doc"), parts("alike")))))
    dealt = materialize(dealt.select("doc", "label", F.when(F.col("alike").isNotNull(), F.col("m1")).alias("m1"), "block"), "neighbourhoods")
    kind = F.pmod(F.xxhash64(F.lit(1), "doc"), F.lit(COMMON)).alias("kind")
    first = F.min_by("doc", F.xxhash64(F.lit(2), "doc")).alias("doc")
    blocks = dealt.select("label", "m1", "block").distinct()
    of_family = blocks.join(dealt.groupBy("label", kind).agg(first), "label")
    of_alike = blocks.join(dealt.where("m1 is not null").groupBy("label", "m1", kind).agg(first), ["label", "m1"])
    return dealt.select("doc", "block").unionByName(of_family.select("doc", "block")).unionByName(of_alike.select("doc", "block")).distinct()


def grouped(labels: DataFrame, clusters: DataFrame) -> DataFrame:
    """(doc, n, cluster, block, family): blocks of about BLOCK members of a family, or of a cluster of more; clusters are
    named by their smallest member, and family is the count of what the block is cut from.

    Members of a block have sizes within a tenth. So the tokens that a query must share with one follow from its own size
    and theirs, and a chance token or two in common open no group, except at the ends of what sizes allow."""
    named = labels.select("doc", "n", "label").join(clusters.withColumnRenamed("node", "doc"), "doc", "left")
    named = named.select("doc", "n", "label", F.coalesce("component", "doc").alias("cluster"))
    large = named.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > BLOCK).select("cluster", F.col("cluster").alias("own"))
    named = named.join(large, "cluster", "left")
    like = F.floor(F.log(F.col("n")) / F.log(F.lit(1.1)))
    named = materialize(named.select("doc", "n", "cluster", F.when(F.col("own").isNull(), F.xxhash64(F.lit(0), "label", like)).otherwise(F.xxhash64(F.lit(1), "own", like)).alias("whole")), "clusters")
    sizes = named.groupBy("whole").agg(F.count(F.lit(1)).alias("family"))
    part = F.pmod(F.xxhash64("doc"), F.ceil(F.col("family") / BLOCK).cast("long"))
    return named.join(sizes, "whole").select("doc", "n", "cluster", F.xxhash64("whole", part).alias("block"), "family")


def prefix_postings(docs: DataFrame, width: int, percent: int, heavy: np.ndarray, buckets: int) -> DataFrame:
    """Per task, window and bucket of tokens one row: the tokens of prefixes there, and their documents.

    heavy: frequent tokens, rarest first; they come after all others in the order. Copies within a window appear once."""
    by_token = np.argsort(heavy, kind="stable")
    known, rank = heavy[by_token], by_token  # rank[i]: place of known[i] in heavy

    def prefix(tokens: np.ndarray) -> np.ndarray:
        want = len(tokens) - least_overlap(len(tokens), percent) + 1
        if not len(known):
            return tokens[:want]
        at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
        frequent = known[at] == tokens
        light = tokens[~frequent]
        if len(light) >= want:
            return light[:want]
        rest = tokens[frequent][np.argsort(rank[at[frequent]], kind="stable")]
        return np.concatenate([light, rest[: want - len(light)]])

    def run(batches):
        held: dict[bytes, list] = {}
        size = 0

        def flush():
            if not held:
                return None
            tokens = np.concatenate([t for _, t in held.values()])
            owners = np.repeat(np.array([d for d, _ in held.values()], dtype=np.int64), [len(t) for _, t in held.values()])
            bucket = ((tokens >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            tokens, owners, bucket = tokens[order], owners[order], bucket[order]
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(bucket[cuts[:-1]], pa.int64()),
                    pa.array([tokens[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()),
                    pa.array([owners[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()),
                ],
                ["bucket", "tokens", "owners"],
            )

        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                tokens = shingles(value.as_py(), width)
                if key is None or not len(tokens):
                    continue
                sig = signature(tokens)
                if sig in held:
                    held[sig][0] = min(held[sig][0], key)
                    continue
                first = prefix(tokens)
                held[sig] = [key, first]
                size += len(first)
                if size >= WINDOW:
                    yield flush()
                    held, size = {}, 0
        last = flush()
        if last is not None:
            yield last

    rows = docs.select(docs["doc_id"].cast("long"), docs["text"])
    return rows.mapInArrow(run, "bucket long, tokens binary, owners binary")


def shared_tokens(frame: pd.DataFrame) -> pd.DataFrame:
    """(token, doc) of the bucket's tokens that at least two documents have."""
    tokens = np.frombuffer(b"".join(frame["tokens"]), dtype=np.int64)
    owners = np.frombuffer(b"".join(frame["owners"]), dtype=np.int64)
    order = np.lexsort((owners, tokens))
    tokens, owners = tokens[order], owners[order]
    fresh = np.ones(len(tokens), dtype=bool)
    fresh[1:] = (tokens[1:] != tokens[:-1]) | (owners[1:] != owners[:-1])
    tokens, owners = tokens[fresh], owners[fresh]
    same = tokens[1:] == tokens[:-1]
    keep = np.zeros(len(tokens), dtype=bool)
    keep[1:] |= same
    keep[:-1] |= same
    return pd.DataFrame({"token": tokens[keep], "doc": owners[keep]})


NO_PAIRS = {"query": np.zeros(0, np.int64), "block": np.zeros(0, np.int64), "shared": np.zeros(0, np.int64)}


def distinct(*columns: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct rows of equally long columns, and how often each occurs."""
    order = np.lexsort(columns)
    columns = [c[order] for c in columns]
    fresh = np.ones(len(order), dtype=bool)
    if len(order):
        fresh[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    at = np.flatnonzero(fresh)
    return [c[at] for c in columns], np.diff(np.append(at, len(order)))


def candidates(frame: pd.DataFrame, percent: int) -> pd.DataFrame:
    """(query, block, shared): how many of the frame's tokens a document's prefix shares with those of members of other
    clusters in a group, where sizes allow a link; in its own block, or between blocks.

    Of two blocks, the one of the larger family is opened, so many small queries meet one large group in one place. Tokens
    of up to FEW documents are taken all at once, pair by pair; others one by one, document by group."""
    frame = frame.sort_values("token", kind="stable")
    token, doc, n, cluster, block, family = (frame[c].to_numpy() for c in ("token", "doc", "n", "cluster", "block", "family"))
    cuts = np.concatenate([[0], np.flatnonzero(token[1:] != token[:-1]) + 1, [len(token)]])
    few = np.repeat(np.diff(cuts) <= FEW, np.diff(cuts))
    found = []  # (query, block, token)

    def add(rows, groups):
        found.append((doc[rows], groups, token[rows]))

    for lag in range(1, FEW):
        x = np.flatnonzero((token[lag:] == token[:-lag]) & few[lag:])
        y = x + lag
        fits = (cluster[x] != cluster[y]) & (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y]))
        x, y = x[fits], y[fits]
        home = block[x] == block[y]
        asks = (family[y] > family[x]) | ((family[y] == family[x]) & (block[y] > block[x]))
        for rows, others in ((x[home], y[home]), (y[home], x[home]), (x[~home & asks], y[~home & asks]), (y[~home & ~asks], x[~home & ~asks])):
            add(rows, block[others])
    for k in np.flatnonzero(np.diff(cuts) > FEW):
        a, b = cuts[k], cuts[k + 1]
        if (cluster[a:b] == cluster[a]).all():
            continue
        groups, first, inverse = np.unique(block[a:b], return_index=True, return_inverse=True)
        ends = np.iinfo(np.int64)
        low, high, least, most = (np.full(len(groups), x) for x in (ends.max, ends.min, ends.max, ends.min))
        np.minimum.at(low, inverse, n[a:b])
        np.maximum.at(high, inverse, n[a:b])
        np.minimum.at(least, inverse, cluster[a:b])
        np.maximum.at(most, inverse, cluster[a:b])
        size = family[a:b][first]
        asking = a + np.arange(b - a)
        top = size == size.max()
        if least[top].min() == most[top].max():  # the largest is one cluster: it is asked, and asks no other
            asking = asking[~top[inverse]]
        for s in range(0, len(asking), 4096):
            at = asking[s : s + 4096]
            q, qf, qb, qc = n[at, None], family[at, None], block[at, None], cluster[at, None]
            ok = (groups == qb) | (size > qf) | ((size == qf) & (groups > qb))
            ok &= (least != qc) | (most != qc)
            ok &= (100 * high >= percent * q) & (percent * low <= 100 * q)
            i, j = np.nonzero(ok)
            add(at[i], groups[j])
    if not sum(len(x[0]) for x in found):
        return pd.DataFrame(NO_PAIRS)
    (query, group, _), _ = distinct(*[np.concatenate(x) for x in zip(*found)])
    (query, group), shared = distinct(query, group)
    return pd.DataFrame({"query": query, "block": group, "shared": shared.astype(np.int64)})


def fewest_shared(n, low, high, percent: int):
    """Column: tokens that a set of n must share, between prefixes, with a member of low to high tokens to be linked with it.

    The overlap must be at least percent * (n + m) / (100 + percent), and beyond a prefix lie least_overlap - 1 tokens. The
    difference falls with the distance of m from n, so one of the ends of what sizes allow has the least."""

    def at(m):
        whole = F.ceil(F.lit(percent) * (n + m) / F.lit(100 + percent))
        beyond = F.floor((F.lit(percent) * F.greatest(n, m) + 99) / 100) - 1
        return whole - beyond

    a = F.greatest(low, F.ceil(F.lit(percent) * n / 100))
    b = F.least(high, F.floor(F.lit(100) * n / F.lit(percent)))
    return F.least(at(a), at(b)) - 1  # for what rounding may take within


class Forest:
    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


def opened(frame: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Edges (u, v) that connect what the links between an opened group's members, and with its queries, connect."""
    frame = frame.sort_values(["role", "doc"], kind="stable")
    sets = [np.frombuffer(x, dtype=np.uint64) for x in frame["tokens"]]
    docs, roles = frame["doc"].to_numpy(), frame["role"].to_numpy()
    sizes = np.array([len(x) for x in sets])
    m = int((roles == 0).sum())
    if not m or len(docs) < 2:
        return pd.DataFrame({"u": np.zeros(0, np.int64), "v": np.zeros(0, np.int64)})
    flat = np.concatenate(sets[:m])
    member = np.repeat(np.arange(m), sizes[:m])
    union, token = np.unique(flat, return_inverse=True)
    order = np.argsort(token, kind="stable")
    holders, start = member[order], np.concatenate([[0], np.cumsum(np.bincount(token, minlength=len(union)))])
    forest = Forest(len(docs))
    inside = bool((frame["chunk"].iloc[0]) == 0)  # one chunk of queries also links the members among themselves
    for q in range(0 if inside else m, len(docs)):
        at = np.minimum(np.searchsorted(union, sets[q]), len(union) - 1)
        hit = at[union[at] == sets[q]]
        if len(hit) < least_overlap(sizes[q], percent):
            continue  # the bound: no member can share more than the union does
        lengths = start[hit + 1] - start[hit]
        places = np.arange(lengths.sum()) + np.repeat(start[hit] - (np.cumsum(lengths) - lengths), lengths)
        overlap = np.bincount(holders[places], minlength=m)
        for k in np.flatnonzero(100 * overlap >= percent * (sizes[q] + sizes[:m] - overlap)):
            if k != q:
                forest.join(int(k), q)
    roots = np.array([forest.find(k) for k in range(len(docs))])
    linked = roots != np.arange(len(docs))
    return pd.DataFrame({"u": docs[linked], "v": docs[roots[linked]]})


def wanted_filter(docs: DataFrame) -> bytes:
    """A bitmap of 2**WANTED_BITS bits, one set for each doc of docs; others may share it."""
    at = F.expr(f"xxhash64(doc) & {(1 << WANTED_BITS) - 1}") + 1  # Spark's bitmaps count from 1
    maps = docs.select(F.bitmap_bucket_number(at).alias("bucket"), F.bitmap_bit_position(at).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("map"))
    out = bytearray(1 << WANTED_BITS >> 3)
    for bucket, held in maps.toLocalIterator():  # at most 2**WANTED_BITS / 32768 rows of 4 KB
        out[(bucket - 1) * 4096 : bucket * 4096] = held
    return bytes(out)


def links(rows: DataFrame, roles: DataFrame, width: int, percent: int) -> DataFrame:
    """Edges (u, v) of the groups opened by roles (doc, block, chunk, role): the moves of whole texts.

    Texts that no role asks for are left out by a bitmap first. Merged at every size, so that what a run needs follows from
    its input."""
    sent = rows.sparkSession.sparkContext.broadcast(wanted_filter(roles))
    mask = np.int64((1 << WANTED_BITS) - 1)

    def some(batches):
        bits = np.frombuffer(sent.value, dtype=np.uint8)
        for batch in batches:
            at = batch.column(2).to_numpy() & mask
            found = np.flatnonzero(bits[at >> 3] >> (at & 7).astype(np.uint8) & 1)
            yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(found)) for k in range(2)], ["doc", "text"])

    def tokens_of(batches):
        last, held = None, b""
        for batch in batches:
            out = []
            for value in batch.column(4):
                words = value.as_py()
                if words != last:
                    last, held = words, shingles(words, width).tobytes()
                out.append(held)
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(4)], pa.array(out, pa.binary())], ["doc", "block", "chunk", "role", "tokens"])

    texts = rows.where("doc_id is not null").select(F.col("doc_id").alias("doc"), "text", F.xxhash64("doc_id")).mapInArrow(some, "doc long, text string")
    placed = texts.hint("merge").join(roles, "doc").select("doc", "block", "chunk", "role", "text")
    placed = placed.mapInArrow(tokens_of, "doc long, block long, chunk int, role int, tokens binary")
    return placed.groupBy("block", "chunk").applyInPandas(lambda f: opened(f, percent), "u long, v long")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 5, percent: int = 75) -> DataFrame:
    """One row per document: doc_id, n_shingles (size of its set) and component_id (smallest id reachable by links).

    A set is the distinct shingles of `width` words; with fewer words, the whole sequence as one; null, empty and blank
    texts have none and are linked with nothing. Two documents are linked when 100 * intersection >= percent * union.
    Sets are held as 64-bit hashes. Ids are whole numbers; a row without one gets the component of its equals. Repeated
    rows are each returned; an empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text"))
    stats = materialize(statistics(rows, width), "shingles")
    own = stats.where("n is not null").select("doc_id", "n", "sig", "m1", "m2", "m3")
    sets = own.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("doc"), *[F.max(c).alias(c) for c in ("n", "m1", "m2", "m3")])
    sets = materialize(sets.where("doc is not null"), "sets")
    heavy = frequent_tokens(stats.where("token is not null"))
    total = sets.agg(F.coalesce(F.sum(F.col("n") * (100 - percent) / 100 + 1), F.lit(0.0))).first()[0]
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")) * 2, int(total // 300_000) + 1)
    labels = materialize(families(sets), "labels")
    near = materialize(neighbourhoods(labels).select("doc", "block", F.lit(0).alias("chunk"), F.lit(0).alias("role")), "roles")
    clusters = materialize(components(links(rows, near, width, percent)), "components")
    groups = materialize(grouped(labels, clusters), "groups")
    shared = prefix_postings(rows, width, percent, heavy, buckets).groupBy("bucket").applyInPandas(shared_tokens, "token long, doc long")
    matrix = shared.join(groups, "doc").withColumn("bucket", F.pmod(F.xxhash64("token"), F.lit(buckets)))
    pairs = matrix.groupBy("bucket").applyInPandas(lambda f: candidates(f, percent), "query long, block long, shared long")
    pairs = pairs.groupBy("query", "block").agg(F.sum("shared").alias("shared"))
    sizes = groups.groupBy("block").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    own_group = groups.groupBy(F.col("doc").alias("query")).agg(F.max("n").alias("n"), F.max("block").alias("own"))
    pairs = pairs.join(own_group, "query").join(sizes, "block").where(F.col("shared") >= fewest_shared(F.col("n"), F.col("low"), F.col("high"), percent))
    pairs = materialize(pairs.select("query", "block", (F.col("own") == F.col("block")).alias("home")), "pairs")
    # A group with queries from elsewhere is opened whole; one without, for those members that pass the bound themselves.
    chunks = pairs.where("not home").groupBy("block").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    each = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk")
    whole = groups.join(chunks, "block").select("doc", "block", each, F.lit(0).alias("role"))
    alone = pairs.where("home").join(chunks, "block", "left_anti").select(F.col("query").alias("doc"), "block", F.lit(0).alias("chunk"), F.lit(0).alias("role"))
    queries = pairs.where("not home").join(chunks, "block").select(F.col("query").alias("doc"), "block", F.pmod(F.xxhash64("query"), F.col("chunks")).cast("int").alias("chunk"), F.lit(1).alias("role"))
    roles = materialize(whole.unionByName(alone).unionByName(queries), "roles")
    known = clusters.where("node <> component").select(F.col("node").alias("u"), F.col("component").alias("v"))
    found = components(links(rows, roles, width, percent).unionByName(known))
    classes = sets.select("sig", "doc").join(found, sets["doc"] == found["node"], "left").select("sig", F.coalesce("component", "doc").alias("class"))
    out = own.select("doc_id", "n", "sig").join(classes, "sig", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("class", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """The rows of docs whose id is the smallest of their component, with all their columns; ids should not repeat."""
    first = near_duplicates(docs, text, key, **options).where("doc_id = component_id or doc_id is null").select(F.col("doc_id").alias("__first"))
    return docs.join(first.where("__first is not null").distinct(), F.col(key).cast("long") == F.col("__first"), "left_semi").unionByName(docs.where(F.col(key).isNull()))
