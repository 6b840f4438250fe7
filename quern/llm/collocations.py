"""Phrase collocations by Toivonen mining: a sample proposes phrases, full passes count them and their negative border exactly.

Texts are lower-cased (A to Z), cut into pieces at ``.,;:!?`` and line ends and into words at blanks and tabs. Everything is
per language. A phrase is frequent if it occurs at least ``least`` times; all contiguous parts of a frequent phrase are.

1. A sample of the rows (by hash) is mined level by level with its share of the threshold: the proposal. A lower threshold
   there would spare few failures, and one expansion pass finds all that fails, while every further word that is proposed
   makes the border larger.
2. One pass over all rows counts, exactly, all words and every phrase whose first and last k - 1 words are both proposed:
   that is the proposal and its negative border. Phrases that reach ``least`` are frequent.
3. A frequent phrase that was not proposed is a border failure: longer phrases with it were not counted. Failures join the
   proposal, and an expansion pass counts what becomes countable by them, longer and longer: every phrase whose first and
   last k - 1 words are proposed or counted in this pass. What it finds frequent can't have uncounted longer phrases, so the
   result is closed then, and no third pass is needed.

So the sample decides how much work is done and never what is found. Tasks hold the proposal as a Bloom filter whose size is
bounded by ``most_bits``; what it wrongly takes for proposed is counted too, exactly, and a proposal too large for it makes
passes count more phrases, not fewer. Within a task phrases are told apart by their words' numbers, and between tasks by
their text; each task sends one row for each phrase and slice of text, which Spark adds up before it shuffles them.

A candidate (a frequent phrase of two words or more) is cut after each of its first words; with l and r the frequencies of the
two parts, its score is the smallest floor(1000 * a * n / (l * r)), of ties at the first cut. Products are decimals of 38 digits.
Candidates inside a longer one that has at least ``keep`` percent of their occurrences are dropped. The best ``top`` per
language are taken within parts of the language first.

Defined cases. A null text is empty, a null language ``und``; an empty language stays as it is. Null ids and repeated rows and
ids count row by row. Words may hold any other character, also other white space. Ties in rank go to the larger frequency, then
to the phrase that comes first in UTF-8 order. A text is worked on in slices that share their border words, however long it
is or a piece of it. Other columns of the caller, whatever their names, are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import SALTS, bound_batches, col, materialise

#: Lower case for A to Z, one mark for all that ends a piece, a blank for a tab.
ENDS = b".,;:!?\n\x0b\x0c\r"
SIMPLER = bytes.maketrans(bytes(range(65, 91)) + ENDS + b"\t", bytes(range(97, 123)) + b"." * len(ENDS) + b" ")
#: Bytes of text that a task cuts into words at once, and words that it remembers.
SLICE, WORDS = 4_000_000, 400_000
#: Fixed odd numbers that mix 64 bits.
TIMES, MIX = 0x9E3779B97F4A7C15, 0xFF51AFD7ED558CCD
COUNTS = pa.schema([("key", pa.string()), ("n", pa.int64())])


class Words(dict):
    """Numbers of the words met so far, from 1 on (0 ends a piece), and their hashes."""

    def __init__(self):
        self.known, self.new = np.zeros(1, np.uint64), []
        self[b"."] = 0

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.new.append(xxhash.xxh64_intdigest(word))
        return n

    def hashes(self) -> np.ndarray:
        if self.new:
            self.known, self.new = np.concatenate([self.known, np.array(self.new, np.uint64)]), []
        return self.known


def words_of(texts: list[str]) -> Iterator[list[bytes]]:
    """Words and marks of texts one after another, in slices."""
    data = "\n".join(texts).encode("utf-8").translate(SIMPLER)
    at = 0
    while at < len(data):
        to = at + SLICE
        if to < len(data):
            to = data.rfind(b" ", at, to) + 1 or data.find(b" ", to) + 1 or len(data)
        yield data[at:to].replace(b".", b" . ").split()
        at = to


def language_seed(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang.encode("utf-8"), 1)


class Proposal:
    """A Bloom filter of phrases, by the hashes of their words; three bits each."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.last = bits, np.uint64(64 * len(bits) - 1)

    @staticmethod
    def size(n: int, most_bits: int) -> int:
        """A power of two: 16 bits a phrase, 2**20 at least and ``most_bits`` at most."""
        return min(max(1 << 20, 1 << (16 * n).bit_length()), most_bits)

    @staticmethod
    def places(hashes: np.ndarray, seed: int, last: np.uint64) -> list[np.ndarray]:
        h = (hashes ^ np.uint64(seed)) * np.uint64(MIX)
        h ^= h >> np.uint64(32)
        h *= np.uint64(MIX)
        step = h >> np.uint64(32) | np.uint64(1)
        return [(h + step * np.uint64(i)) & last for i in range(3)]

    def __call__(self, hashes: np.ndarray, seed: int) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        for at in self.places(hashes, seed, self.last):
            found &= (self.bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        return found


def longer(left: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of phrases with one more word."""
    return left * np.uint64(TIMES) + word


def phrase_hashes(phrases: list[str]) -> np.ndarray:
    out = []
    for p in phrases:
        h, *rest = (xxhash.xxh64_intdigest(w) for w in p.encode("utf-8").split(b" "))
        for w in rest:
            h = (h * TIMES + w) & 0xFFFFFFFFFFFFFFFF
        out.append(h)
    return np.array(out, np.uint64)


def counted(tokens: list[bytes], own: int, words: Words, lang: str, levels: range, now: Proposal | None, failed: Proposal | None, before: Proposal | None) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """The phrases of the levels (numbers of words) that begin in the first ``own`` tokens and how often: all words, and longer
    phrases whose first and last k - 1 words are proposed. The empty phrase stands for the number of words.

    In an expansion pass (with ``failed`` and what was proposed ``before``) phrases that were counted before are left out, and
    what is counted passes for proposed when longer phrases are.
    """
    ids = np.fromiter(map(words.__getitem__, tokens), np.int64, len(tokens))
    hashes, seed = words.hashes()[ids], language_seed(lang)
    word_hash, inside = hashes, ids > 0
    if 1 in levels:
        first, n = np.unique(ids[:own], return_index=True, return_counts=True)[1:]
        some = ids[first] > 0
        yield [b""], np.array([inside[:own].sum()])
        yield [tokens[p] for p in first[some].tolist()], n[some]
    if levels.stop < 3:
        return
    whole, taken = inside, np.zeros(0, np.int64)
    part = inside & now(hashes, seed) if failed is None else np.zeros(len(ids), bool)
    for k in range(2, levels.stop):
        if failed:
            part = whole & failed(hashes, seed)  # with what was counted at the level below
            part[taken] = True
        longer_whole = whole[:-1] & inside[k - 1 :]
        if not len(longer_whole):
            return
        if failed is None:
            taken = np.flatnonzero(longer_whole & part[:-1] & part[1:])
        else:
            taken = np.flatnonzero(longer_whole & (part[:-1] | part[1:]))
            one, two = hashes[taken], hashes[taken + 1]
            counts = (part[taken] | now(one, seed)) & (part[taken + 1] | now(two, seed))
            taken = taken[counts & ~(before(one, seed) & before(two, seed))]
        whole, hashes = longer_whole, longer(hashes[:-1], word_hash[k - 1 :])
        if failed is None:
            part = np.zeros(len(whole), bool)
            part[taken] = now(hashes[taken], seed)  # what is proposed has proposed parts
        at = taken[: np.searchsorted(taken, own)]
        if k not in levels or not len(at):
            continue
        number = ids[at]
        for j in range(1, k):
            pair = number << 32 | ids[at + j]
            if j < k - 1:
                number = np.unique(pair, return_inverse=True)[1]
        first, n = np.unique(pair, return_index=True, return_counts=True)[1:]
        yield [b" ".join(tokens[p : p + k]) for p in at[first].tolist()], n


def _count(levels: range, now, failed, before, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key (the phrase, a tab, which no word holds, and the language), n from rows of lang and text, gathered by language."""
    now, failed, before = (None if b is None else Proposal(b.value) for b in (now, failed, before))
    words, ahead = Words(), levels.stop - 2
    held: dict[str, list[str]] = defaultdict(list)
    sizes: dict[str, int] = defaultdict(int)

    def flush(lang: str) -> Iterator[pa.RecordBatch]:
        nonlocal words
        tokens: list[bytes] = []
        slices, end = words_of(held.pop(lang)), b"\t" + lang.encode("utf-8")
        del sizes[lang]
        more = next(slices, None)
        while more is not None:
            tokens += more
            more = next(slices, None)
            own = len(tokens) if more is None else len(tokens) - ahead
            if own > 0:
                if len(words) > WORDS:
                    words = Words()
                for phrases, n in counted(tokens, own, words, lang, levels, now, failed, before):
                    yield pa.RecordBatch.from_arrays([pa.array([p + end for p in phrases], pa.string()), pa.array(n.astype(np.int64))], schema=COUNTS)
                tokens = tokens[own:]

    total = 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            held[lang].append(text or "")
            sizes[lang] += len(text or "") + 1
            total += len(text or "") + 1
            full = lang if sizes[lang] >= SLICE else max(sizes, key=sizes.__getitem__) if total >= 4 * SLICE else None
            if full is not None:  # where there are many languages, the largest goes
                total -= sizes[full]
                yield from flush(full)
    for lang in [*held]:
        yield from flush(lang)


def _bits(last: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The filter's bits of each phrase: slot of 64 bits, and which of them."""
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), object)
        hashes = phrase_hashes(batch.column(1).to_pylist())
        for lang in dict.fromkeys(langs.tolist()):
            at = np.concatenate(Proposal.places(hashes[langs == lang], language_seed(lang), np.uint64(last)))
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int32)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], names=["slot", "bits"])


def _failures(now, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows (lang, phrase) that are not proposed."""
    proposal = Proposal(now.value)
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), object)
        hashes = phrase_hashes(batch.column(1).to_pylist())
        there = np.zeros(len(langs), bool)
        for lang in dict.fromkeys(langs.tolist()):
            there[langs == lang] = proposal(hashes[langs == lang], language_seed(lang))
        yield batch.filter(pa.array(~there))


def proposal_bits(phrases: DataFrame, size: int, also: np.ndarray | None = None) -> np.ndarray:
    """The filter of all rows (lang, phrase), and of what ``also`` has; size / 64 numbers whatever the rows."""
    out = np.zeros(size // 64, np.int64) if also is None else also.view(np.int64).copy()
    rows = phrases.select("lang", "phrase").mapInArrow(partial(_bits, size - 1), "slot int, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits"))
    got = rows.toPandas()
    out[got["slot"].to_numpy(np.int64)] |= got["bits"].to_numpy(np.int64)
    return out.view(np.uint64)


def frequent_phrases(docs: DataFrame, least: int = 100, longest: int = 5, share: float = 0.1, most_bits: int = 1 << 28, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """lang, k (words; 0: the language's number of words), phrase, n of all phrases of up to ``longest`` words that occur ``least`` times or more. Written."""
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.coalesce(col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(col(text_col), F.lit("")).alias("text"), col(id_col).alias("id"))

    def count(of: DataFrame, levels: range, now=None, failed=None, before=None) -> DataFrame:
        made = of.select("lang", "text").mapInArrow(partial(_count, levels, now, failed, before), "key string, n long")
        phrase = F.substring_index("key", "\t", 1)
        words = F.when(phrase == "", 0).otherwise(F.size(F.split(phrase, " ", -1)))
        return made.groupBy("key").agg(F.sum("n").alias("n")).select(F.expr("substring(key, instr(key, '\t') + 1)").alias("lang"), words.alias("k"), phrase.alias("phrase"), "n")

    # the sample proposes, level by level
    sample = materialise(rows.filter(F.pmod(F.xxhash64("id", "text"), F.lit(10_000)) < int(10_000 * share)).select("lang", "text"), "sample")
    least_here = max(2, round(least * share))  # what it misses, the expansion pass finds for little; what it adds, all rows are counted for
    proposed, now, size = None, None, 0
    for k in range(1, longest):
        level = materialise(count(sample, range(k, k + 1), now).filter((F.col("k") > 0) & (F.col("n") >= least_here)).select("lang", "phrase"), "proposed")
        if not size:  # longer phrases are seldom more than words
            size = Proposal.size(4 * level.count(), most_bits)
        proposed = proposal_bits(level, size, proposed)
        if now is not None:
            now.unpersist()
        now = spark.sparkContext.broadcast(proposed)  # of a size bounded by most_bits
    # all rows are counted, and border failures expanded
    found = [materialise(count(rows, range(1, longest + 1), now).filter((F.col("k") == 0) | (F.col("n") >= least)), "frequent")]
    short = found[0].filter((F.col("k") > 0) & (F.col("k") < longest)).select("lang", "phrase")
    failures = materialise(short.mapInArrow(partial(_failures, now), "lang string, phrase string"), "failures")
    if not failures.isEmpty():
        wider = spark.sparkContext.broadcast(proposal_bits(failures, size, proposed))
        failed = spark.sparkContext.broadcast(proposal_bits(failures, Proposal.size(failures.count(), most_bits)))
        found.append(materialise(count(rows, range(2, longest + 1), wider, failed, now).filter(F.col("n") >= least), "frequent"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return materialise(out, "phrases")


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, keep: int = 100, share: float = 0.1, most_bits: int = 1 << 28, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Each language's best ``top`` phrases: lang, rank, phrase, a, l, r, n, score."""
    found = frequent_phrases(docs, least, longest, share, most_bits, lang_col, text_col, id_col)
    some = found.filter("k > 0").select("lang", "phrase", F.col("n").alias("f"))
    totals = found.filter("k = 0").select("lang", "n")
    words = F.split("phrase", " ", -1)
    candidates = found.filter("k >= 2").select("lang", "phrase", "k", F.col("n").alias("a"), words.alias("w"))
    cut = candidates.select("*", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("j"))
    cut = cut.select("lang", "phrase", "k", "a", "j", F.array_join(F.slice("w", 1, F.col("j")), " ").alias("one"), F.array_join(F.slice("w", F.col("j") + 1, F.col("k") - F.col("j")), " ").alias("two"))
    cut = cut.join(some.select("lang", F.col("phrase").alias("one"), F.col("f").alias("l")), ["lang", "one"]).join(some.select("lang", F.col("phrase").alias("two"), F.col("f").alias("r")), ["lang", "two"]).join(totals, "lang")
    score = F.expr("(CAST(1000 * a AS DECIMAL(19,0)) * CAST(n AS DECIMAL(18,0))) div (CAST(l AS DECIMAL(18,0)) * CAST(r AS DECIMAL(18,0)))")
    scored = cut.groupBy("lang", "phrase").agg(F.min(F.struct(score.alias("score"), "j", "l", "r", "a", "n", "k")).alias("c")).select("lang", "phrase", "c.*")
    inner = candidates.filter("k > 2").select("lang", "a", "w", "k", F.explode(F.sequence(F.lit(2), F.col("k") - 1)).alias("m")).select("*", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("m") + 1)).alias("i"))
    inner = inner.select("lang", F.array_join(F.slice("w", F.col("i"), F.col("m")), " ").alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("within"))
    kept = scored.join(inner, ["lang", "phrase"], "left").filter(F.col("within").isNull() | (100 * F.col("within") < keep * F.col("a")))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(max(SALTS, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))).alias("part")
    best = kept.select("lang", "phrase", "a", "l", "r", "n", "score", part).withColumn("place", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("place") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
