"""Phrases that occur together more often than their parts suggest, from suffix automata.

A shard is a bounded stretch of the corpus as word numbers. Each of its places gives the longest phrase that ends there;
what is rare everywhere is left out before by a filter of fixed size that lets no frequent phrase go. Equal ones are counted
in one distributed sum and dealt by their last two words, so that all the phrases with the same end meet in one task. Their
generalised suffix automaton, to a bounded depth, has one state for all the phrases that end at the same places: they are
suffixes of one another, occur equally often, and the state's link leads to the longest suffix that occurs elsewhere too. The
automaton is built by sorting, one length after another, which gives the states, links and counts of end places that adding
word by word gives. These counts are of the whole corpus, so rare phrases end there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lower_ascii, materialize
from .vocabulary import runs_of_rows

BORDERS = ".,;:!?\n\x0b\x0c\r"
_MIX, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass
class Level:
    """The distinct phrases of one length: where each ends first, how often it occurs, the number of its suffix (one word
    less, among the phrases one shorter), and whether it is of the same state as that suffix."""

    end: np.ndarray
    count: np.ndarray
    suffix: np.ndarray
    joined: np.ndarray


class SuffixAutomaton:
    """Of the phrases of up to `depth` words within the stretches of words between borders (0). Where `ends` are given, of
    those that end there, as often as `times` tells."""

    def __init__(self, words: np.ndarray, depth: int, ends: np.ndarray | None = None, times: np.ndarray | None = None):
        self.words, self.levels = words, []
        ends = np.flatnonzero(words) if ends is None else ends
        times = np.ones(len(ends), dtype=np.int64) if times is None else times
        kinds, first, at = np.unique(words[ends], return_index=True, return_inverse=True)
        self.levels.append(Level(ends[first], self._sums(at, times, len(kinds)), np.full(len(kinds), -1), np.zeros(len(kinds), dtype=bool)))
        for m in range(2, depth + 1):
            # A phrase of m words is one of m - 1 words, by number, with a word before it.
            fits = ends >= m - 1
            ends, at, times = ends[fits], at[fits], times[fits]
            before = words[ends - (m - 1)]
            real = before > 0
            ends, at, times, before = ends[real], at[real], times[real], before[real]
            key = at.astype(np.int64) << 32 | before
            shorter = self.levels[-1]
            kinds, first, at = np.unique(key, return_index=True, return_inverse=True)
            suffix, count = kinds >> 32, self._sums(at, times, len(kinds))
            # Equally often means at the same places, as every place of the longer is one of the shorter.
            self.levels.append(Level(ends[first], count, suffix, count == shorter.count[suffix]))

    @staticmethod
    def _sums(at: np.ndarray, times: np.ndarray, kinds: int) -> np.ndarray:
        out = np.zeros(kinds, dtype=np.int64)
        np.add.at(out, at, times)
        return out

    def phrases(self, shortest: int = 1):
        """(length, end, count) arrays of all distinct phrases from `shortest` words on, a length at a time."""
        for m, level in enumerate(self.levels, 1):
            if m >= shortest:
                yield m, level.end, level.count

    def states(self) -> list[tuple[int, int, int, int, int]]:
        """(longest, shortest, end, count, link) of each state: its phrases are the suffixes, of shortest to longest words,
        of what ends at `end`; link is the place in this list of the state of the suffix one word shorter still (-1: none)."""
        state_of = [np.full(len(x.end), -1) for x in self.levels]
        out = []
        for m in range(len(self.levels), 0, -1):
            for k in range(len(self.levels[m - 1].end)):
                if state_of[m - 1][k] >= 0:
                    continue
                length, g = m, k
                state_of[m - 1][k] = len(out)
                while length > 1 and self.levels[length - 1].joined[g]:
                    length, g = length - 1, int(self.levels[length - 1].suffix[g])
                    state_of[length - 1][g] = len(out)
                out.append((m, length, int(self.levels[m - 1].end[k]), int(self.levels[m - 1].count[k]), (length, g)))
        links = [int(state_of[n - 2][self.levels[n - 1].suffix[g]]) if n > 1 else -1 for *_, (n, g) in out]
        return [(*x[:4], link) for x, link in zip(out, links)]


class _Words(dict):
    """word -> number from 1 on; of empty strings -1, of a border 0."""

    def __init__(self, known: list):
        super().__init__({"": -1, "\n": 0})
        self.known = known  # (language, word) by number, of all languages

    def __missing__(self, word):
        self.known.append(word)
        self[word] = at = len(self.known)
        return at


class Shard:
    """Word numbers of texts until there are about `most` words; each language has its own numbers."""

    def __init__(self, most: int):
        self.most, self.words, self.langs, self.known, self.parts, self.size, self.totals = most, {}, [], [], [], 0, {}

    def add(self, lang: str, text: str) -> None:
        words = self.words.get(lang)
        if words is None:
            words = self.words[lang] = _Words(self.known)
        before = len(self.known)
        tokens = text.split(" ")
        ids = np.fromiter(map(words.__getitem__, tokens), dtype=np.int32, count=len(tokens))
        self.langs.extend([lang] * (len(self.known) - before))
        ids = np.append(ids[ids >= 0], np.int32(0))
        self.totals[lang] = self.totals.get(lang, 0) + int(np.count_nonzero(ids))
        self.parts.append(ids)
        self.size += len(ids)

    @property
    def full(self) -> bool:
        return self.size >= self.most

    def stream(self) -> np.ndarray:
        return np.concatenate([np.zeros(1, np.int32), *self.parts])

    def hashes(self) -> np.ndarray:
        """A 64-bit hash for each word number, by language and word."""
        seeds = {lang: xxhash.xxh3_64_intdigest(lang) for lang in self.words}
        out = np.zeros(len(self.known) + 1, dtype=np.uint64)
        out[1:] = np.fromiter((xxhash.xxh3_64_intdigest(w, seeds[g]) for g, w in zip(self.langs, self.known)), dtype=np.uint64, count=len(self.known))
        return out


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (first * _MIX) ^ ((second + _STEP) * _STEP)
        h = (h ^ (h >> np.uint64(29))) * _MIX
        return h ^ (h >> np.uint64(32))


class Filter:
    """2**bits bits, one set for each hash that was frequent. What it leaves out is rare; what it lets in may be rare too."""

    def __init__(self, bitmap: bytes, bits: int):
        self.bitmap, self.mask = np.frombuffer(bitmap, dtype=np.uint8), np.uint64((1 << bits) - 1)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = (hashes & self.mask).astype(np.int64)
        return (self.bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def _shards(rows: DataFrame, shard_words: int, found, schema: str) -> DataFrame:
    def run(batches):
        shard = Shard(shard_words)
        for batch in batches:
            for part in runs_of_rows(batch, 1):
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    for piece in _stretches(text, shard_words):
                        shard.add(lang, piece)
                        if shard.full:
                            yield from found(shard)
                            shard = Shard(shard_words)
        if shard.size:
            yield from found(shard)

    return rows.mapInArrow(run, schema)


def _stretches(text: str, most: int):
    """The text, cut at borders into parts of no more than about 8 * most characters where it is longer."""
    at, step = 0, 8 * most
    while len(text) - at > step and (cut := text.find("\n", at + step)) >= 0:
        yield text[at:cut]
        at = cut
    yield text[at:]


def _hash_counts(shard: Shard):
    """hash, n of the shard's words and pairs of words."""
    w, h = shard.stream(), shard.hashes()
    counts = np.bincount(w, minlength=len(h))[1:]
    yield pa.RecordBatch.from_arrays([pa.array(h[1:].view(np.int64)), pa.array(counts)], ["hash", "n"])
    a, b = w[:-1], w[1:]
    both = (a > 0) & (b > 0)
    pairs, n = np.unique(a[both].astype(np.int64) << 32 | b[both], return_counts=True)
    for k in range(0, len(pairs), 1 << 18):
        p = pairs[k : k + (1 << 18)]
        yield pa.RecordBatch.from_arrays([pa.array(pair_hash(h[p >> 32], h[p & 0xFFFFFFFF]).view(np.int64)), pa.array(n[k : k + (1 << 18)])], ["hash", "n"])


def _longest_phrases(shard: Shard, known: Filter, most_words: int):
    """lang, words, phrase, n: for each place of the shard the longest phrase of 2 to most_words words that ends there and
    that the filter leaves (n is 1; Spark counts equal ones), the counts of words that it leaves, and each language's count of
    words as the phrase of no words."""
    langs, totals = list(shard.totals), list(shard.totals.values())
    yield pa.RecordBatch.from_arrays([pa.array(langs), pa.array([0] * len(langs), pa.int32()), pa.array([""] * len(langs)), pa.array(totals, pa.int64())], ["lang", "words", "phrase", "n"])
    w, h = shard.stream(), shard.hashes()
    often = known.has(h)
    often[0] = False
    counts, name = np.bincount(w, minlength=len(h)), _Names(pa.array(shard.known, pa.large_string()), pa.array(shard.langs, pa.string()))
    at = np.flatnonzero(often)
    yield from name.rows(at, 1, np.arange(len(at)), counts[at])
    # Words stay where they are part of a pair that may be frequent; a border comes between two that are none together.
    a, b = w[:-1], w[1:]
    near = np.zeros(len(a), dtype=bool)
    both = np.flatnonzero((a > 0) & (b > 0) & often[a] & often[b])
    near[both] = known.has(pair_hash(h[a[both]], h[b[both]]))
    ends = np.flatnonzero(near) + 1
    place = np.arange(len(w))
    pairs = place - np.maximum.accumulate(np.where(np.concatenate([[False], near]), 0, place))  # one after another, up to here
    length = np.minimum(pairs[ends] + 1, most_words)
    for m in range(2, most_words + 1):
        e = ends[length == m]
        yield from name.rows(w, m, e, np.ones(len(e), dtype=np.int64))


class _Names:
    """Phrases of word numbers as rows of lang, words, phrase, n; about `most` bytes of them at once. words and langs are by
    number, from 1 on."""

    def __init__(self, words: pa.Array, langs: pa.Array, most: int = 1 << 23):
        self.words, self.langs, self.most = words, langs, most
        self.size = np.concatenate([[0], pc.binary_length(self.words).to_numpy(zero_copy_only=False)])

    def rows(self, words: np.ndarray, m: int, ends: np.ndarray, n: np.ndarray):
        for k in range(0, len(ends), 1 << 16):
            e = ends[k : k + (1 << 16)]
            full = np.cumsum(sum(self.size[words[e - j]] for j in range(m))) // self.most
            cuts = [0, *(np.flatnonzero(np.diff(full)) + 1).tolist(), len(e)]
            for first, last in zip(cuts, cuts[1:]):
                x = e[first:last]
                parts = [self.words.take(pa.array(words[x - j] - 1)) for j in range(m - 1, -1, -1)]
                phrase = pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())).cast(pa.string())
                yield pa.RecordBatch.from_arrays([self.langs.take(pa.array(words[x] - 1)), pa.array(np.full(len(x), m, dtype=np.int32)), phrase, pa.array(n[k + first : k + last])], ["lang", "words", "phrase", "n"])


def _whole_keys(batches: Iterator[pa.RecordBatch], rows: int, size: int = 1 << 26) -> Iterator[tuple[pa.Table, bool]]:
    """Tables of about `rows` rows and no more than about `size` bytes of batches that come by their first two columns, and
    whether all rows of their keys are in them. Only keys of more rows or bytes are parted."""
    held, parted, batches = None, False, iter(batches)
    while True:
        batch = next(batches, None)
        if batch is not None:
            part = pa.Table.from_batches([batch])
            held = part if held is None else pa.concat_tables([held, part])
        while held is not None and held.num_rows:
            most = min(rows, max(1, held.num_rows * size // max(held.nbytes, 1)))
            if batch is not None and held.num_rows <= most:
                break
            new = pc.or_(*(pc.not_equal(held.column(c).slice(1), held.column(c).slice(0, held.num_rows - 1)) for c in (0, 1)))
            starts = np.flatnonzero(new.to_numpy()) + 1
            if parted:  # the rest of a parted key, by itself
                cut = int(starts[0]) if len(starts) else held.num_rows
                goes_on = not len(starts) and batch is not None
            elif batch is None and held.num_rows <= most:
                cut, goes_on = held.num_rows, False
            else:
                fit = starts[starts <= most]
                cut = int(fit[-1]) if len(fit) else int(starts[0]) if len(starts) else held.num_rows
                goes_on = not len(starts) and batch is not None
            yield held.slice(0, cut), not (parted or goes_on)
            held, parted = held.slice(cut), goes_on
        if batch is None:
            return


def _suffix_counts(rows: DataFrame, least: int, most_words: int, shard_words: int) -> DataFrame:
    """lang, words, phrase, n of the suffixes, from 2 words on, of the phrases in rows, which occur n times each; single words
    and totals as they are. All that end in the same two words are in one task; what is rare there goes no further."""

    def run(batches):
        for table, whole in _whole_keys(batches, max(1, shard_words // most_words)):
            few = pc.less(table.column("words"), 2)
            yield from table.filter(few).drop_columns("tail").to_batches()
            table = table.filter(pc.invert(few))
            if not table.num_rows:
                continue
            texts, langs = table.column("phrase").cast(pa.large_string()).combine_chunks(), table.column("lang").combine_chunks().dictionary_encode()
            parts = pc.split_pattern(texts, " ")
            lengths, coded = pc.list_value_length(parts).to_numpy(), parts.flatten().dictionary_encode()
            # Each language has its own numbers.
            known = len(coded.dictionary)
            kinds, number = np.unique(np.repeat(langs.indices.to_numpy().astype(np.int64), lengths) * known + coded.indices.to_numpy(), return_inverse=True)
            name = _Names(coded.dictionary.take(pa.array(kinds % known)), langs.dictionary.take(pa.array(kinds // known)))
            words = np.zeros(1 + len(number) + len(lengths), dtype=np.int64)
            words[np.arange(1, len(number) + 1) + np.repeat(np.arange(len(lengths)), lengths)] = number + 1
            ends = np.cumsum(lengths.astype(np.int64) + 1) - 1
            for m, e, n in SuffixAutomaton(words, most_words, ends, table.column("n").to_numpy()).phrases(2):
                keep = n >= least if whole else np.ones(len(n), dtype=bool)
                yield from name.rows(words, m, e[keep], n[keep])

    tail = F.call_function("substring_index", F.col("phrase"), F.lit(" "), F.lit(-2))
    dealt = rows.select("lang", tail.alias("tail"), "words", "phrase", "n").repartition("lang", "tail").sortWithinPartitions("lang", "tail")
    return dealt.mapInArrow(run, "lang string, words int, phrase string, n long")


def _prepared(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """Lower-case A-Z; every border a word of its own, a line feed; words apart by spaces."""
    plain = F.translate(lower_ascii(F.coalesce(docs[text], F.lit(""))), BORDERS + "\t", "\n" * len(BORDERS) + " ")
    return docs.select(F.coalesce(docs[lang], F.lit("und")).alias("lang"), F.replace(plain, F.lit("\n"), F.lit(" \n ")).alias("text"))


def frequent_filter(rows: DataFrame, least: int, shard_words: int, bits: int) -> bytes:
    """The filter's bitmap: 2**bits / 8 bytes, whatever the corpus."""
    counted = _shards(rows, shard_words, _hash_counts, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    at = F.expr(f"hash & {(1 << bits) - 1}") + 1  # Spark's bitmaps count from 1
    maps = counted.select(F.bitmap_bucket_number(at).alias("bucket"), F.bitmap_bit_position(at).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("map"))
    out = bytearray(max(1 << bits >> 3, 4096))
    for bucket, held in maps.toLocalIterator():  # at most 2**bits / 32768 rows of 4 KB
        out[(bucket - 1) * 4096 : bucket * 4096] = held
    return bytes(out)


def phrase_counts(docs: DataFrame, least: int = 100, most_words: int = 5, text: str = "text", lang: str = "lang", shard_words: int = 1 << 22, filter_bits: int = 27) -> DataFrame:
    """lang, words, phrase, n: the exact number of occurrences of every phrase of 1 to most_words words that occurs at
    least `least` times in its language, and as words = 0 the language's count of words.

    Two passes over the texts. The first counts hashes of words and of pairs; those of at least `least` set bits of a filter
    of 2**filter_bits bits, the only thing that is broadcast. The second gives the longest phrase that ends at a place, as a
    string, but only such as consist of pairs in the filter: one row at most for each word, and one for each word of a shard
    by itself. Spark sums equal ones; automata of what has the same end give the counts of all phrases. A hash or bit that a
    rare phrase shares with another costs time and changes nothing. For corpora with more frequent pairs than the filter has
    bits, raise filter_bits. A text without a border is one piece, however long; longer texts than a shard are cut at borders.
    Two last words with more phrases than an automaton holds are counted by several, whose counts are summed."""
    rows = _prepared(docs, text, lang)
    sent = docs.sparkSession.sparkContext.broadcast(frequent_filter(rows, least, shard_words, filter_bits))
    found = lambda shard: _longest_phrases(shard, Filter(sent.value, filter_bits), most_words)
    sums = lambda df: df.groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n"))
    longest = sums(_shards(rows, shard_words, found, "lang string, words int, phrase string, n long"))
    counts = sums(_suffix_counts(longest.where((F.col("n") >= least) | (F.col("words") != 1)), least, most_words, shard_words))
    return counts.where((F.col("n") >= least) | (F.col("words") == 0))


def _cut(phrase: Column, k: Column, words: Column) -> tuple[Column, Column]:
    """The first k of a phrase's words, and the rest."""
    part = lambda n: F.call_function("substring_index", phrase, F.lit(" "), n)
    return part(k), part(k - words)


def collocations(docs: DataFrame, least: int = 100, most_words: int = 5, top: int = 2000, subsumed: int = 100, text: str = "text", lang: str = "lang", shard_words: int = 1 << 22, filter_bits: int = 27) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's `top` phrases of 2 to most_words words.

    A phrase that occurs a >= least times, cut after k words into parts that occur l and r times, has the score
    floor(1000 * a * n / (l * r)), n being the language's count of words; the cut of the lowest score counts, the smallest k
    of several. Phrases that lie within a longer one with 100 * its count >= subsumed * a are left out (with `subsumed` 100:
    those that occur nowhere else). Order: score, a (both descending), phrase by its UTF-8 bytes. Texts are compared in lower
    case A-Z; `.,;:!?` and line ends are borders; words are what spaces and tabs part. A null language is und, a null
    text empty; texts of any length are taken whole; repeated rows count as often as they occur; an empty table gives no rows;
    other columns are ignored. For the passes see phrase_counts; scores use decimals of 38 digits."""
    counts = materialize(phrase_counts(docs, least, most_words, text, lang, shard_words, filter_bits), "phrases")
    totals = counts.where("words = 0").select("lang", F.col("n").alias("total"))
    counts = counts.where("words > 0")
    candidates = counts.where("words > 1").select("lang", "words", "phrase", F.col("n").alias("a"))
    # Suffix links, and prefix links beside them: a longer phrase that holds this one holds one that is a word longer, and
    # that one occurs at least as often.
    phrase, words = F.col("phrase"), F.col("words")
    shorter = F.array(_cut(phrase, F.lit(1), words)[1], _cut(phrase, words - 1, words)[0])
    links = candidates.where("words > 2").select("lang", F.explode(shorter).alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    held = candidates.join(links, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < subsumed * F.col("a"))).drop("longer")
    cuts = held.withColumn("k", F.explode(F.sequence(F.lit(1), words - 1)))
    left, right = _cut(phrase, F.col("k"), words)
    part = lambda p, n: counts.select("lang", F.col("phrase").alias(p), F.col("n").alias(n))
    cuts = cuts.withColumn("left", left).withColumn("right", right).join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    # One row per language, of which each has some frequent phrase.
    cuts = cuts.join(totals, "lang").withColumn("score", F.expr("(CAST(1000 AS DECIMAL(4,0)) * CAST(a AS DECIMAL(17,0)) * CAST(total AS DECIMAL(17,0))) div (CAST(l AS DECIMAL(18,0)) * CAST(r AS DECIMAL(18,0)))"))
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "total")).alias("x"))
    best = best.select("lang", "phrase", "x.a", "x.l", "x.r", F.col("x.total").alias("n"), "x.score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # First the best of each of 64 parts of a language, then the best of those.
    part_of = F.pmod(F.xxhash64("phrase"), F.lit(64)).alias("part")
    some = best.select("*", part_of).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
