"""N-gram Jaccard join by parity sketches.

A document's set is its distinct word shingles as 64-bit hashes. Two sets of n <= m with Jaccard similarity of at least
t/100 differ in at most (n + m)(100 - t)/(100 + t) elements, and m <= 100 n / t. Sizes are cut into bands; band k's scheme covers
pairs whose smaller set is in k, so a set is sketched for its own band and, where a partner can be smaller, for the one
before. A scheme's sketch has D + 1 + E words: an element XORs its hash into the word that another hash chooses, so words
of two sketches differ in at most as many places as the sets differ (D at most), and at least E + 1 words are equal. Equal
words are found by one shuffle of (word, set). What an equal word proves is weak where the word is empty or shared by very many sets:

* Empty words aren't sent while at most 0.7 E words of a set are empty; a set with more is sketched again with another seed, at
  last with its empty words. A pair is lost only where both have more, and then both have the next seed. So a pair
  shares at least 0.3 E + 1 words that were sent, and a set that shares fewer with anyone is dropped from the scheme.
* A word that more than ``HOT`` sets share is hot. A pair with at most 0.3 E hot words on either side still has an equal
  word that isn't hot, so hot words count only between sets that both have more.

Each word's sets have a centre c, the one with the most shared words. First every set is checked against its best centre; words whose
sets are then in one component are done. The sets of the others aren't paired with each other, as a large group of near copies would
make rows with the square of its size. Each is replaced by its difference from the centre, d(x) = x ^ c, since x ^ y = d(x) ^ d(y):

* x and c are similar exactly if d(x) is small enough. If d(x) and d(y) together are, both are similar to c.
* Any other similar pair must share elements of d(x) and d(y), at least o = (|d(x)| + |d(y)| - D(x, y)) / 2 of them. With the
  elements in order of how few sets of the centre have them, one stands among the first |d(x)| - o + 1 of x and |d(y)| - o + 1 of y.
  As one of the two isn't similar to c, the other's prefix is about the first half of its difference: what it alone has.

Both ends' places of the shared element bound the overlap, too; pairs that it leaves are verified exactly on the sets, after a
Hamming test on one-bit-per-element parity sketches. Equal sets are one set from the start, so copies cost nothing.

Edge cases: null or empty texts and texts without words have no shingles and link with nothing; fewer words than k are one
shingle; repeated rows are equal sets; a null key takes part and never names a component unless all its keys are null; sets of any
size have a band (``Bands`` goes on beyond 2^31 elements).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import ARROW_ROWS, discard, materialize, small_batches, tidy
from vellum.llm.components import components, joined_components

SHINGLE, PERCENT = 5, 80
#: Sets that share a word before it counts as hot; seeds; growth of size bands; bits of the parity sketch of the check; sets that meet one copy of their centre.
HOT, SEEDS, BAND, SKETCH_BITS, SHARE_ROWS = 32, 3, 1.4, 1024, 500

#: Both sides of these joins grow with the data, so they are dealt by their keys at every size.
MERGE = "merge"
#: Bytes of text handled at once.
PART_BYTES, NARROW_ROWS = 512 << 10, 20_000
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, a public constant-time bijection of 64 bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _rule(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed))


_BYTE, _PLACE = _rule(256, 1), [_rule(64, 2) | _U(1)]
_STEP = _rule(16, 3) | _U(1)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32


def shingle_hashes(text: str, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word k-shingles."""
    return shingle_sets([text], k)[0]


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """The sets of many texts, a few MB of text at a time."""
    out: list[np.ndarray] = []
    held: list[bytes] = []
    size = 0
    for text in texts:
        held.append((text or "").encode("utf-8", "surrogatepass"))
        size += len(held[-1])
        if size >= PART_BYTES:
            out += _sets_of(held, k)
            held, size = [], 0
    return out + _sets_of(held, k)


def _sets_of(texts: list[bytes], k: int) -> list[np.ndarray]:
    data = _LOW[np.frombuffer(b" ".join([*texts, b""]), np.uint8)]
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    inside = ~_IS_SPACE[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(data) and inside[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return [np.zeros(0, _U) for _ in texts]
    size = ends - starts
    while len(_PLACE[0]) < size.max():
        _PLACE[0] = _rule(2 * len(_PLACE[0]), 2) | _U(1)
    first = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(first, size)
    words = mix(np.add.reduceat(_BYTE[data[inside]] * _PLACE[0][place], first) + size.astype(_U))
    until = np.searchsorted(starts, np.cumsum(lengths))
    whole = _joined(words, k) if len(words) >= k else words[:0]
    out, low = [], 0
    for high in until.tolist():
        n = high - low
        rows = whole[low : high - k + 1] if n >= k else _joined(words[low:high], n) if n else words[:0]
        rows = np.sort(rows)
        out.append(rows[np.concatenate([[True], rows[1:] != rows[:-1]])] if len(rows) > 1 else rows)
        low = high
    return out


def _joined(words: np.ndarray, width: int) -> np.ndarray:
    rows = len(words) - width + 1
    total = np.full(rows, _U(width))
    for j in range(width):
        total += words[j : j + rows] * _STEP[j] if j < 16 else mix(words[j : j + rows] + _U(j))
    return mix(total)


def set_id(hashes: np.ndarray) -> int:
    """64 bits of a set: a sum and an exclusive or of its mixed elements and its size, as a signed number."""
    if not len(hashes):
        return 0
    both = np.array([np.add.reduce(mix(hashes ^ _U(0xA5A5A5A5A5A5A5A5))), np.bitwise_xor.reduce(mix(hashes + _U(77))), _U(len(hashes))])
    return int(mix(np.add.reduce(mix(both) * _STEP[:3], keepdims=True))[0].astype(np.int64))


class Bands:
    """Bands of set sizes and their schemes for a least similarity of percent / 100."""

    def __init__(self, percent: int) -> None:
        self.percent, lows = percent, [1]
        while lows[-1] <= 1 << 32:  # fewer than 80 bands: a scheme's number is a byte
            lows.append(max(lows[-1] + 1, int(lows[-1] * BAND) + 1))
        self.lows = np.array(lows)

    def of(self, n: int) -> int:
        return int(np.searchsorted(self.lows, n, side="right")) - 1

    def high(self, band: int) -> int:
        return int(self.lows[band + 1]) - 1

    def differ(self, band: int) -> int:
        """D: elements that may differ in pairs whose smaller set is in the band."""
        n = self.high(band)
        return (n + n * 100 // self.percent) * (100 - self.percent) // (100 + self.percent)

    def spare(self, band: int) -> int:
        return self.differ(band) // 5 + 1

    def empty(self, band: int) -> int:
        """Words of a set that may be empty before it is sketched with the next seed, too."""
        return 7 * self.spare(band) // 10

    def schemes(self, n: int) -> list[int]:
        band = self.of(n)
        return [band, band - 1] if band and n * self.percent <= self.high(band - 1) * 100 else [band]


def sketch_words(hashes: np.ndarray, bands: Bands) -> np.ndarray:
    """A set's words in all of its schemes, as 64-bit keys: a byte of the scheme and seed, and 56 of the word and its place."""
    out = []
    for band in bands.schemes(len(hashes)):
        spare = bands.spare(band)
        places = bands.differ(band) + 1 + spare
        for seed in range(SEEDS):
            scheme = band * SEEDS + seed
            at = ((mix(hashes + _U(scheme * 1_000_003 + 11)) >> _U(32)) * _U(places) >> _U(32)).astype(np.int64)
            words = np.zeros(places, _U)
            np.bitwise_xor.at(words, at, hashes)
            filled = np.flatnonzero(np.bincount(at, minlength=places))
            last = len(filled) >= places - bands.empty(band)
            if last or seed < SEEDS - 1:
                words = words[filled]
            else:
                filled = np.arange(places)
            key = mix(words + mix(filled.astype(_U) + _U(scheme << 32)))
            out.append((key >> _U(8)) | (_U(scheme) << _U(56)))
            if last:
                break
    return np.concatenate(out)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Exactly whether 100 * intersection >= percent * union; the Hamming distance of parity sketches may rule it out first."""
    n, m = len(a), len(b)
    if not n or not m or 100 * min(n, m) < percent * max(n, m):
        return False
    if np.count_nonzero(parity(a) != parity(b)) * (100 + percent) > (n + m) * (100 - percent):
        return False
    both = np.concatenate([a, b])
    both.sort()
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * shared >= percent * (n + m - shared)


def parity(hashes: np.ndarray) -> np.ndarray:
    return np.bincount((hashes & _U(SKETCH_BITS - 1)).astype(np.int64), minlength=SKETCH_BITS) & 1


def jaccard_components(docs: DataFrame, *, text: str = "text", key: str = "doc_id", k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """A row per document: doc_id, n_shingles, set_id, component_id (the smallest doc_id that links reach), label (one of the component's sets; null without shingles)."""
    spark = docs.sparkSession
    small_batches(spark)
    narrow = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    bands = Bands(percent)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = shingle_sets(batch.column(1).to_pylist(), k)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in made], pa.int64()), pa.array([set_id(s) for s in made], pa.int64())], names=["doc_id", "n", "sid"])

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            keys, owners = [], []
            for hashes in shingle_sets(batch.column(1).to_pylist(), k):
                sid = set_id(hashes)
                if not len(hashes) or sid in seen:
                    continue
                if len(seen) < 1_000_000:
                    seen.add(sid)
                keys.append(sketch_words(hashes, bands))
                owners.append(np.full(len(keys[-1]), sid, np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).astype(np.int64)), pa.array(np.concatenate(owners))], names=["word", "sid"])

    ids = materialize(narrow.mapInArrow(sets, "doc_id long, n long, sid long"), "jaccard-sets")
    shared = narrow.mapInArrow(words, "word long, sid long").repartition("word").sortWithinPartitions("word", "sid")
    stars = materialize(shared.mapInArrow(star_groups, "word long, first long, sid long, hot boolean"), "jaccard-stars", arrow_rows=NARROW_ROWS)

    # Sets that are linked share at least E + 1 words in a scheme, of which only as many are missing as may be empty; a set
    # with fewer shared words has no link there. Hot words count between sets that have many of them.
    scheme = F.shiftrightunsigned("word", 56).cast("int")
    every = range(len(bands.lows) - 1)
    places = [x for band in every for x in [bands.differ(band) + 1 + bands.spare(band) - bands.empty(band)] * SEEDS]
    most = [x for band in every for x in [bands.spare(band) - bands.empty(band)] * SEEDS]
    of = lambda numbers: F.element_at(F.array(*map(F.lit, numbers)), F.col("scheme") + 1)
    shares = materialize(stars.select("word", "sid", "hot").union(stars.groupBy("word").agg(F.first("first").alias("sid"), F.first("hot").alias("hot")).select("word", "sid", "hot")), "jaccard-shares")
    discard(stars)
    counts = shares.groupBy("sid", scheme.alias("scheme")).agg(F.count("*").alias("n"), F.sum(F.col("hot").cast("int")).alias("h"))
    sizes = ids.where("n > 0").groupBy("sid").agg(F.max("n").alias("size"))
    # No partner differs in more than this from a set of its size, so at least so many words are shared.
    differ = F.floor((F.col("size") + F.floor(F.col("size") * 100 / percent)) * (100 - percent) / (100 + percent))
    counts = counts.join(sizes.hint(MERGE), "sid").withColumn("need", F.greatest(of(places) - differ, F.lit(1)))
    good = materialize(counts.where("n >= need").select("sid", "scheme", F.col("n").alias("words"), (F.col("h") > of(most)).alias("heavy")), "jaccard-good")
    members = materialize(shares.withColumn("scheme", scheme).join(good.hint(MERGE), ["sid", "scheme"]).where("heavy or not hot").select("word", "sid", "words"), "jaccard-members")
    discard(shares, good)
    tidy(spark)

    # Centres, and each set against its best one.
    centres = members.groupBy("word").agg(F.max_by("sid", F.struct("words", "sid")).alias("c"), F.min("sid").alias("low"), F.max("sid").alias("high")).where("low <> high").select("word", "c")
    centres = materialize(centres, "jaccard-centres")
    tries = members.join(centres.hint(MERGE), "word").where("sid <> c").groupBy("c", "sid").agg(F.count("*").alias("shared"))
    best = tries.groupBy("sid").agg(F.max_by("c", F.struct("shared", "c")).alias("c"))
    best = materialize(best.select(F.least("c", "sid").alias("a"), F.greatest("c", "sid").alias("b")).distinct(), "jaccard-best")
    needed = members.select("sid").distinct()
    chosen = ids.join(needed, "sid").groupBy("sid").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id"))["doc_id"].alias("doc_id"))
    contents = set_contents(narrow, materialize(chosen, "jaccard-chosen"), k)

    def verify(candidates: DataFrame) -> DataFrame:
        """The pairs (a, b) that are similar."""
        left = candidates.join(contents.select(F.col("sid").alias("a"), F.col("hashes").alias("left")).hint(MERGE), "a")
        full = left.join(contents.select(F.col("sid").alias("b"), F.col("hashes").alias("right")).hint(MERGE), "b")

        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ok = [similar(np.frombuffer(x, _U), np.frombuffer(y, _U), percent) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])

        return full.select("a", "b", "left", "right").mapInArrow(check, "a long, b long")

    links = materialize(verify(best), "jaccard-links")
    discard(best)
    tidy(spark)
    labels = materialize(components(links), "jaccard-labels")

    # Words whose sets are in several components: their centres' groups.
    named = members.join(labels.withColumnRenamed("v", "sid"), "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    several = named.groupBy("word").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("word")
    # Any set serves all words whose centres are in its component: fewer groups, and each set is in few of them.
    own = centres.groupBy("c").agg(F.count("*").alias("words")).join(labels.withColumnRenamed("v", "c"), "c", "left").withColumn("label", F.coalesce("label", "c"))
    first = own.join(own.groupBy("label").agg(F.max_by("c", F.struct("words", "c")).alias("middle")), "label").select("c", "middle")
    of_word = several.hint(MERGE).join(centres, "word").join(first.hint(MERGE), "c").select("word", F.col("middle").alias("c"))
    groups = materialize(members.join(of_word.hint(MERGE), "word").select("c", "sid").distinct(), "jaccard-groups")
    discard(members, centres)
    tidy(spark)
    differences = materialize(from_centre(groups, contents, percent), "jaccard-differences")
    discard(groups)
    tidy(spark)
    near = differences.where("near and c <> sid").select(F.least("c", "sid").alias("a"), F.greatest("c", "sid").alias("b")).distinct()
    labels = joined_components(labels, near)
    last = materialize(beyond_centres(differences, labels, percent), "jaccard-last")
    discard(differences)
    tidy(spark)
    labels = joined_components(labels, verify(last)).withColumnRenamed("v", "sid")

    named = ids.select("doc_id", "n", "sid").join(labels, "sid", "left").withColumn("label", F.when(F.col("n") > 0, F.coalesce("label", "sid")))
    named = materialize(named, "jaccard-named")
    discard(ids, contents, last, links)
    least = named.where("n > 0").groupBy("label").agg(F.min("doc_id").alias("least"), F.count("*").alias("docs"))
    least = least.where("docs > 1").select("label", "least")
    return named.join(least, "label", "left").select("doc_id", F.col("n").alias("n_shingles"), F.col("sid").alias("set_id"), F.coalesce("least", "doc_id").alias("component_id"), "label")


def from_centre(groups: DataFrame, contents: DataFrame, percent: int) -> DataFrame:
    """groups(c, sid) with n and s (sizes of the set and of its centre), near (whether they are similar), and the elements that one of them alone has.

    A centre with many sets is repeated for every ``SHARE_ROWS`` of them, so its sets go to many tasks.
    """
    copies = groups.groupBy("c").agg(F.ceil(F.count("*") / SHARE_ROWS).alias("copies"))
    many = copies.where("copies > 1").select("c", "copies")
    dealt = groups.join(many, "c", "left").select("c", "sid", F.pmod(F.xxhash64("sid"), F.coalesce("copies", F.lit(1))).alias("part"))
    centre = contents.join(copies.withColumnRenamed("c", "sid"), "sid").select(F.col("sid").alias("c"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("part"), F.col("hashes").alias("centre"))
    full = dealt.join(contents.hint(MERGE), "sid").join(centre.hint(MERGE), ["c", "part"]).select("c", "sid", "hashes", "centre")

    def subtract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            columns = [list(x) for x in zip(*held, strict=True)]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64())), strict=True)], names=["c", "sid", "n", "s", "near", "elements"])

        for batch in batches:
            size = 0
            for c, sid, x, y in zip(*batch.columns, strict=True):
                a, b = np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)
                only = np.setxor1d(a, b, assume_unique=True)
                held.append((c.as_py(), sid.as_py(), len(a), len(b), (100 + percent) * len(only) <= (100 - percent) * (len(a) + len(b)), only.astype(np.int64)))
                size += len(only)
                if size >= PART_BYTES:
                    yield flush()
                    size = 0
            if held:
                yield flush()

    return full.mapInArrow(subtract, "c long, sid long, n long, s long, near boolean, elements array<long>")


def beyond_centres(differences: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of a centre's sets in different components that share enough of their differences to be similar (module docstring)."""
    q, r = 100 + percent, 100 - percent
    rows = differences.where("c <> sid").join(labels.withColumnRenamed("v", "sid"), "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    several = rows.groupBy("c").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("c")
    rows = rows.join(several, "c", "left_semi").withColumn("d", F.size("elements").cast("long")).withColumn("m", F.xxhash64("c", "sid"))
    # Least overlap with any partner that isn't near the centre; for one that isn't itself, with any near it.
    far = F.floor((q * F.col("d") + r * (F.col("s") - F.col("n"))) / (2 * q)) + 1
    any_ = F.ceil((q * F.col("d") - r * (F.col("s") + F.col("n"))) / (2 * q))
    rows = rows.withColumn("half", F.col("d") - F.greatest(far, F.lit(1)) + 1).withColumn("whole", F.when(~F.col("near"), F.col("d") - F.greatest(any_, F.lit(1)) + 1).otherwise(F.lit(0)))
    rows = materialize(rows.select("m", "sid", "n", "d", "near", "label", "half", "whole", F.transform("elements", lambda e: F.xxhash64("c", e)).alias("elements")), "jaccard-rows")
    # Elements of a centre as one number (equal numbers of different ones would only bring another pair to the exact check).
    each = rows.select("m", F.explode("elements").alias("e"))
    often = each.groupBy("e").agg(F.count("*").alias("sets")).where("sets > 1")
    met = each.join(often.hint(MERGE), "e").join(rows.drop("elements").hint(MERGE), "m")
    # Elements that one set alone has come first and meet nothing.
    own = Window.partitionBy("m")
    met = met.withColumn("at", F.col("d") - F.count("*").over(own) + F.row_number().over(own.orderBy("sets", "e")) - 1)
    met = materialize(met.where(F.col("at") < F.greatest("half", "whole")).select("e", "sid", "n", "d", "near", "label", "half", "whole", "at"), "jaccard-prefixes")
    discard(rows)
    x = met.where("not near and at < whole").select("e", *(F.col(i).alias(f"x_{i}") for i in ("sid", "n", "d", "label", "half", "at")))
    y = met.where("at < half").select("e", *(F.col(i).alias(f"y_{i}") for i in ("sid", "n", "d", "near", "label", "at")))
    fits = (F.col("x_label") != F.col("y_label")) & (F.col("y_near") | (F.col("x_at") < F.col("x_half")) & (F.col("x_sid") < F.col("y_sid")))
    fits &= 100 * F.least("x_n", "y_n") >= percent * F.greatest("x_n", "y_n")
    fits &= q * (F.col("x_d") + F.col("y_d")) - r * (F.col("x_n") + F.col("y_n")) <= 2 * q * F.least(F.col("x_d") - F.col("x_at"), F.col("y_d") - F.col("y_at"))
    return x.join(y.hint(MERGE), "e").where(fits).select(F.least("x_sid", "y_sid").alias("a"), F.greatest("x_sid", "y_sid").alias("b")).distinct()


def joined_batches(make):  # noqa: ANN001, ANN201
    """Many small batches as few larger ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in make(batches):
            held.append(batch)
            size += batch.nbytes
            if size >= 4 << 20 or len(held) >= ARROW_ROWS:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return run


def star_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (word, sid) in order: (word, first sid, sid, hot) of every sid after a word's first. At most HOT rows of a word are held."""
    word, first, last, held, hot = None, 0, 0, [], False
    out: list[tuple[int, int, int, bool]] = []

    def flush() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.bool_()))], names=["word", "first", "sid", "hot"])
        out.clear()
        return made

    for batch in batches:
        w, s = (c.to_numpy() for c in batch.columns)
        n = len(w)
        # Only words that a neighbour in the batch or the last batch's end shares are of interest.
        same = w[1:] == w[:-1]
        keep = np.zeros(n, bool)
        keep[1:] |= same
        keep[:-1] |= same
        if n:
            keep[0] |= word is not None and w[0] == word
            keep[-1] = True
        for x, y in zip(w[keep].tolist(), s[keep].tolist(), strict=True):
            if x != word:
                out += [(word, first, z, False) for z in held]
                word, first, last, held, hot = x, y, y, [], False
            elif y != last:
                last = y
                if hot:
                    out.append((word, first, y, True))
                else:
                    held.append(y)
                    if len(held) >= HOT:
                        out += [(word, first, z, True) for z in held]
                        held, hot = [], True
        if len(out) >= ARROW_ROWS:
            yield flush()
    out += [(word, first, z, False) for z in held]
    if out:
        yield flush()


def texts_of(narrow: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of narrow whose doc_id is one of wanted(id_). Ids grow with the documents, so texts are dealt by id at every size."""
    return narrow.join(wanted.where("id_ is not null").hint(MERGE), F.col("doc_id") == F.col("id_"), "left_semi")


def set_contents(narrow: DataFrame, chosen: DataFrame, k: int) -> DataFrame:
    """(sid, hashes) of the chosen sets(sid, doc_id), once each."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = shingle_sets(batch.column(0).to_pylist(), k)
            yield pa.RecordBatch.from_arrays([pa.array([set_id(x) for x in made], pa.int64()), pa.array([x.tobytes() for x in made], pa.binary())], names=["sid", "hashes"])

    wanted = chosen.select(F.col("doc_id").alias("id_")).distinct()
    found = texts_of(narrow, wanted)
    if not wanted.where("id_ is null").isEmpty():
        found = found.union(narrow.where("doc_id is null"))
    found = materialize(found.select("text").mapInArrow(joined_batches(make), "sid long, hashes binary"), "jaccard-contents")
    if found.count() > found.select("sid").distinct().count():  # keys that repeat, or are null, with several texts
        found = materialize(found.groupBy("sid").agg(F.first("hashes").alias("hashes")), "jaccard-contents")
    return found
