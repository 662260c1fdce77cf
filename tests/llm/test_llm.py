"""The operators against brute force, round trips and odd inputs."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

SF = "/root/testdata/sf0.001"
ODD = [(1, None, None, "en"), (2, "", "s", "en"), (3, "a b c d e f a b c d e f", "s", None), (3, "a b c d e f a b c d e f", "s", None), (None, "x y", "t", "en"), (7, "word " * 30000, "s", "en"), (8, "\n \t\n", "s", "en"), (9, "A b C d e f a b c d e f", "t", "fr")]


@pytest.fixture(scope="module")
def texts():
    return dict(zip(*(pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).columns[i].to_pylist() for i in (0, 1))))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, extra columns with names that operators use themselves."""
    from pyspark.sql import functions as F

    return spark.createDataFrame(ODD, "doc_id long, text string, source string, lang string").withColumn("n_chars", F.length("text")).withColumn("quality", F.lit("own")).withColumn("host", F.lit(1)).withColumn("copies", F.lit(2))


def query(spark, name):
    from vellum.llm.queries import QUERIES

    return QUERIES[name](spark, SF).toPandas()


def brute_pii(t):
    from vellum.llm.pii import luhn

    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    found += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    found += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d)]
    return found + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_pii_equals_regular_expressions(spark, texts):
    from vellum.llm.pii import BASE_KINDS, joined, masked, scan

    random.seed(3)
    for n, letters in ((30, "0123. -+@a(."), (16, "a@.-b"), (24, "12.3.@ x"), (40, "0 1-2+5("), (20, "0.@")):
        for _ in range(3000):
            t = "".join(random.choice(letters) for _ in range(random.randint(0, n)))
            assert [s for s in scan(t) if s[0] in BASE_KINDS] == brute_pii(t)
    for r in query(spark, "op3_pii").itertuples():
        assert r.base_sha256 == hashlib.sha256(joined(brute_pii(texts[r.doc_id])).encode()).hexdigest()
    assert masked("mail a@b.cd now", scan("mail a@b.cd now")) == "mail [email] now"


def test_licences(spark, texts):
    from vellum.llm.licences import BASE, LOWER, WORD, ExpressionError, evaluate, scan, to_postfix

    assert to_postfix("(MIT OR GPL-2.0-only) AND Apache-2.0 WITH LLVM-exception") == ["mit", "gpl-2.0-only", "or", "apache-2.0", "llvm-exception", "with", "and"]
    assert evaluate(to_postfix("MIT OR GPL-2.0")) == ({"mit", "gpl"}, True)
    assert evaluate(to_postfix("MIT AND GPL-2.0"))[1] is False
    for bad in ("", "MIT OR", "(MIT", "MIT)", "MIT GPL", "()", "AND MIT", "MIT ; GPL"):
        with pytest.raises(ExpressionError):
            to_postfix(bad)
    random.seed(5)
    made = [" ".join(random.choice(["gnu", "general", "public", "license", "CC", "by", "BY-NC", "mit", "MIT License", "apache", "é"]) for _ in range(random.randint(0, 12))) for _ in range(2000)]
    for t in [*texts.values(), *made]:
        w = WORD.findall(t.translate(LOWER))
        at = [(i, label) for p, label in BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        assert scan(t)[:5] == (len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at})))


def test_licence_tags(spark):
    from vellum.llm.licences import licences, scan

    def of(text):
        r = scan(text)
        return r[5], r[7], r[8]

    assert of("x\n// SPDX-License-Identifier: MIT This file is free\n") == ("mit", ["mit"], True)
    assert of('<!-- SPDX-License-Identifier: "(MIT OR GPL-2.0-only) AND Apache-2.0" -->') == ("apache,gpl,mit", ["mit gpl-2.0-only or apache-2.0 and"], True)
    assert of("SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0 */") == ("gpl", ["gpl-2.0-or-later classpath-exception-2.0 with"], False)
    assert of("SPDX-License-Identifier: MIT OR") == ("mit", ["mit"], True) and of("SPDX-License-Identifier: ???") == ("unparsed", [], False)
    both = scan("SPDX-License-Identifier: MIT\nSPDX-License-Identifier: GPL-3.0\nthe apache license")
    assert (both[4], both[5], both[8]) == ("apache", "apache,gpl,mit", False) and abs(both[6] - (1 - 0.1 * 0.01 * 0.01)) < 1e-12
    assert scan("")[:8] == (0, 0, None, None, "", "", 0.0, [])
    rows = licences(spark.createDataFrame([(1, "mit license"), (2, None)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r.labels, r.n_base) for r in rows] == [("mit", 1), ("", 0)]
    long_text = "the mit license of " * 50000
    assert scan(long_text)[1:4] == (50000, 1, 4 * 49999 + 1)


def test_token_ids_and_files(spark, texts):
    from tokenizers import Tokenizer

    from vellum.llm import huffman_ids as H
    from vellum.llm.tokens import encoder, vocabulary_path

    plain = Tokenizer.from_file(vocabulary_path())
    random.seed(1)
    letters = [" ", "  ", "\n", "\t", "a", "é", "Z", "9", ".", ",", "..", "'s", " ", "<|endoftext|>", "漢", "😀", "\r\n", "\x0b", "don't", "㆒", " "]
    made = ["".join(random.choice(letters) for _ in range(random.randint(0, 14))) for _ in range(3000)]
    for t, ids in zip(made, encoder(vocabulary_path()).encode_batch(made), strict=True):
        assert list(ids) == plain.encode(t, add_special_tokens=False).ids, repr(t)
    start = 0
    for r in query(spark, "op7_token_ids").sort_values("doc_id").itertuples():
        ids = [*plain.encode(texts[r.doc_id], add_special_tokens=False).ids, 0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 1000, 50000):
        c = np.floor(rng.pareto(1, n) * 10).astype(np.int64) + 1
        lengths = H.code_lengths(c)
        assert lengths.max() <= H.MAX_BITS and (2.0 ** -lengths[lengths > 0].astype(float)).sum() <= 1
        docs = [rng.choice(n, rng.integers(0, 2000), p=c / c.sum()).astype(np.uint32) for _ in range(20)]
        coded = H.encode_docs(docs, lengths, H.canonical_codes(lengths))
        keys, back = H.parse_file(H.file_bytes(lengths, [(i or None, len(x), *y) for i, (x, y) in enumerate(zip(docs, coded, strict=True))]))
        assert keys == [None, *range(1, 20)] and all((a == b).all() for a, b in zip(docs, back, strict=True))


def test_token_ids_have_few_files_of_sparks(spark, tmp_path, monkeypatch):
    """For each file that Spark writes, the executor's JVM starts commands, whose processes are as large as the JVM for a moment."""
    from pyspark.sql import functions as F

    from vellum.llm import huffman_ids as H
    from vellum.llm import queries as Q

    monkeypatch.setattr(H, "RANGE_IDS", 200)
    made, keep, by_spark = [], H.materialize, []
    monkeypatch.setattr(H, "materialize", lambda df, tag, **more: made.append(keep(df, tag, **more)) or made[-1])
    monkeypatch.setattr(Q, "materialize", lambda df, tag, **more: by_spark.append(tag) or keep(df, tag, **more))
    rows = [(i, f"text of document {i}, with a few words. " * (1 + i % 3)) for i in range(400)] + [(None, None), (7, "again")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(8).write.parquet(f"{tmp_path}/documents.parquet")
    Q.op7_token_ids(spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    assert made[0].count() > 20 and len(made[0].inputFiles()) <= 4  # the tests' shuffle partitions
    assert len(list((tmp_path / "out").glob("*.parquet"))) <= spark.sparkContext.defaultParallelism and not by_spark
    # However many partitions there are, as many tasks have files, unless a range is long.
    frame = type(spark.range(0))
    deal = frame.repartitionByRange
    monkeypatch.setattr(frame, "repartitionByRange", lambda self, n, *cols: deal(self, max(n, 30), *cols))
    tasks = lambda: H.read_ids(made[0]).select(F.spark_partition_id()).distinct().count()
    assert tasks() <= spark.sparkContext.defaultParallelism
    monkeypatch.setattr(H, "FILE_BYTES", 200)
    monkeypatch.setattr(H, "TASK_IDS", 1000)
    ids = spark.range(200).select(F.lit(5).cast("long").alias("key"), F.unhex(F.lit("0102" * 50)).alias("ids"))
    made[:] = [H.write_ids(ids)[0]]
    assert made[0].select("bucket").distinct().count() == 1 and 8 <= tasks() <= 12
    out = sorted(pq.read_table(f"{tmp_path}/out").to_pylist(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in out] == [None, *sorted([*range(400), 7])] and all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(out, out[1:]))


def test_ids_are_coded_several_at_once():
    """The bits are those of each id's code in turn, in less memory than numbers of eight bytes for each step and id take."""
    import tracemalloc

    from vellum.llm import huffman_ids as H

    rng = np.random.default_rng(4)
    for n in (1, 3, 50000):
        c = np.floor(rng.pareto(1, n) * 10).astype(np.int64) + 1
        lengths = H.code_lengths(c)
        codes = H.canonical_codes(lengths)
        docs = [rng.choice(n, k, p=c / c.sum()).astype(np.uint16) for k in (0, 1, 2, 3, 4, 0, 511, 512, 513, 1024, 1537, 0)]
        for d, (data, blocks) in zip(docs, H.encode_docs(docs, lengths, codes), strict=True):
            bits = "".join(f"{int(codes[i]):0{lengths[i]}b}" for i in d)
            assert data == int((bits + "0" * (-len(bits) % 8)) or "0", 2).to_bytes(-(-len(bits) // 8), "big")
            assert blocks.dtype == np.uint16 and blocks.tolist() == [int(lengths[d[i : i + H.BLOCK_IDS]].astype(int).sum()) for i in range(0, len(d), H.BLOCK_IDS)]
    docs = [rng.choice(n, 1000).astype(np.uint16) for _ in range(200)]
    tracemalloc.start()
    try:
        H.encode_docs(docs, lengths, codes)
        assert tracemalloc.get_traced_memory()[1] < 50 * 200_000
    finally:
        tracemalloc.stop()


def test_what_workers_wrote_is_read_once(spark):
    """Files that no finished task names don't count; tasks without rows have no file."""
    import pyarrow as pa

    from vellum.llm.common import materialize_arrow

    def run(batches):
        from pyspark import TaskContext

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([b"x" * 3000] * batch.num_rows, pa.binary())], names=["key", "ids"])
            yield batch.slice(0, 0)
        if TaskContext.get().partitionId() > 1:
            return
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([b""], pa.binary())], names=["key", "ids"])

    df = spark.range(0, 6000, 1, 3)
    got = materialize_arrow(df, run, "key long, ids binary", "test")
    files = got.inputFiles()
    assert len(files) == 3 and got.count() == 6002 and got.where("key is null and length(ids) = 0").count() == 2 and got.where("length(ids) = 3000").count() == 6000
    with open(files[0].removeprefix("file:").replace("//", "/").rsplit("/", 1)[0] + "/part-lost.parquet", "w") as f:
        f.write("torn")
    assert got.count() == 6002
    none = materialize_arrow(df, lambda batches: (batch for batch in batches if batch.num_rows < 0), "key long, ids binary", "test")
    assert none.count() == 0 and none.columns == ["key", "ids"]


def test_known_chunks_are_found_once_and_hashed_by_eight_bytes():
    import tracemalloc

    from tokenizers import Tokenizer

    from vellum.llm.tokens import Encoder, chunk_starts, vocabulary_path

    plain, encode, rng = Tokenizer.from_file(vocabulary_path()), Encoder(vocabulary_path()), random.Random(2)
    # Long chunks of which few bytes differ, at any place, and such as are another's beginning.
    long = ["".join(rng.choice("ab\0") for _ in range(n)) for n in (7, 8, 9, 15, 16, 17, 63, 64, 65, 66, 130, 300)]
    long += [t[:i] + "c" + t[i + 1 :] for t in long for i in range(0, len(t), 3)] + [t[:-1] for t in long] + [t + "\0" for t in long]
    for _ in range(2):
        rng.shuffle(long)
        made = [" ".join(long[i : i + 7]) for i in range(0, len(long), 7)]
        for t, ids in zip(made, encode.encode_batch(made), strict=True):
            assert list(ids) == plain.encode(t, add_special_tokens=False).ids
    asked, find = [], encode._find
    encode._find = lambda keys, checks: asked.append(len(keys)) or find(keys, checks)
    words = " ".join(["word"] * 1000)
    encode.encode_batch([words])
    asked.clear()
    encode.encode_batch([words + " unseen"])
    assert asked == [1001, 1]
    data = np.frombuffer((words * 100).encode(), np.uint8)
    starts = chunk_starts(data, np.zeros(1, np.int64))
    tracemalloc.start()
    try:
        encode._hashes(data, starts, np.diff(np.append(starts, len(data))))
        assert tracemalloc.get_traced_memory()[1] < 20 * len(data)  # a number for each byte and each step would be more
    finally:
        tracemalloc.stop()


def test_packing(spark, texts):
    from vellum.llm.packing import best_fit, solve
    from vellum.llm.tokens import encoder, vocabulary_path

    got = query(spark, "op10_best_fit_packing")
    ids = dict(zip(texts, encoder(vocabulary_path()).encode_batch(list(texts.values())), strict=True))
    for doc, rows in got.sort_values("piece").groupby("doc_id"):
        data = np.append(ids[doc], 0).astype("<u4").tobytes()
        assert list(rows.piece) == list(range(len(rows))) and rows.length.sum() * 4 == len(data)
        for r in rows.itertuples():
            assert r.ids_crc32 == zlib.crc32(data[4 * r.start : 4 * (r.start + r.length)])
    for _, rows in got.sort_values("offset").groupby("sequence_id"):
        assert list(rows.offset) == [0, *np.cumsum(rows.length)[:-1]] and rows.length.sum() <= 2048
    assert set(got.doc_id) == set(texts)
    rng = np.random.default_rng(2)
    h = dict(Counter(((rng.lognormal(6.6, 1.0, 20000)).astype(int) % 2047 + 1).tolist()))
    (plan, bound), placed = solve(h), Counter()
    for held, times in plan:
        assert sum(n * k for n, k in held.items()) <= 2048
        for n, k in held.items():
            placed[n] += k * times
    assert placed == Counter(h) and sum(k for _, k in plan) <= sum(k for _, k in best_fit(h, 2048)) + 2
    assert solve({}) == ([], 0.0) and sum(k for _, k in plan) >= bound


def one_by_one(points, gram=16, window=16):
    from vellum.llm.winnowing import _BASE, _mix

    base, mask = int(_BASE), (1 << 64) - 1
    n = len(points)
    if not n:
        return [], []
    letters = [int(x) for x in _mix(points.astype(np.uint64) + np.uint64(1))]
    if n < gram:
        return [int(_mix(np.array([sum(x * pow(base, i + 1, 1 << 64) for i, x in enumerate(letters)) & mask], np.uint64))[0])], [0]
    rolled = [sum(x * pow(base, gram - 1 - i, 1 << 64) for i, x in enumerate(letters[j : j + gram])) & mask for j in range(n - gram + 1)]
    hashes = [int(x) for x in _mix(np.array(rolled, np.uint64))]
    places = []
    for low in range(max(1, len(hashes) - window + 1)):
        part = hashes[low : low + window]
        place = low + max(i for i, x in enumerate(part) if x == min(part))
        if place not in places[-1:]:
            places.append(place)
    return [hashes[i] for i in places], places


def fractional(histogram, capacity=2048):
    """The configuration program's value, to a hundredth of a percent, over all maximal configurations by multiplicative weights of many small steps."""
    lengths = sorted(histogram, reverse=True)
    made = []

    def grow(i, room, held):
        if i == len(lengths):
            made.append(held)
            return
        for k in range(room // lengths[i], -1, -1):
            grow(i + 1, room - k * lengths[i], [*held, k])
            if i == len(lengths) - 1:
                break

    grow(0, capacity, [])
    rows, d = np.array(made, float), np.array([histogram[n] for n in lengths], float)
    price, best = np.array(lengths, float), 0.0
    for size in (0.3, 0.03, 0.003):  # the bound rises towards the value
        for _ in range(6000):
            worth = rows @ price
            j = int(worth.argmax())
            best = max(best, float(price @ d) / worth[j])
            price *= np.exp(-size * rows[j] / d * (d[rows[j] > 0] / rows[j][rows[j] > 0]).min())
    return best


def test_packing_solves_the_program():
    from vellum.llm.packing import best_fit, solve

    count = lambda plan: sum(k for _, k in plan)
    fixed = [{1100: 1000, 700: 2000, 340: 1500}, {700: 3000, 650: 2000, 420: 1000, 300: 500}, {1000: 500, 690: 1500, 530: 1700, 410: 900}, {820: 3000, 600: 3000, 500: 3000}]
    rng = np.random.default_rng(7)
    for h in fixed + [{int(n): int(k) for n, k in zip(rng.integers(200, 1900, 5), rng.integers(500, 3000, 5))} for _ in range(6)]:
        plan, bound = solve(h)
        value = fractional(h)
        assert bound <= value * 1.002 and count(plan) <= value * 1.01 + len(h), (h, count(plan), bound, value)
    for _ in range(100):
        h = {int(n): int(k) for n, k in zip(rng.integers(1, 2049, rng.integers(1, 9)), rng.integers(1, 400, 8))}
        plan, bound = solve(h)
        placed = Counter()
        for held, times in plan:
            assert times > 0 and sum(n * k for n, k in held.items()) <= 2048
            for n, k in held.items():
                placed[n] += k * times
        assert placed == Counter(h) and bound - 1e-6 <= count(plan) <= count(best_fit(h, 2048))


def test_packing_holds_only_configurations_that_a_step_used():
    from vellum.llm.packing import Program

    lengths = np.clip(np.random.default_rng(5).lognormal(5.3, 0.9, 10_000).astype(int) + 1, 1, 2047)  # short texts: very many configurations are about as good
    program = Program(Counter(lengths.tolist()), 2048)
    amounts = program.whole_lengths()
    assert len(amounts) == len(program.keys) <= len(program.lengths) and amounts.min() > 0
    assert sum(at.nbytes + pieces.nbytes for at, pieces in program.parts) < 64 * 16 * len(program.lengths)  # at most 63 different lengths make up 2048


def test_winnowing(spark, texts):
    from vellum.llm.winnowing import code_points, digest, likeness, winnow

    order = sorted(texts, reverse=True)
    got = query(spark, "op9_winnowing").set_index("doc_id")
    for i, doc in enumerate(order):
        t, after = texts[doc], texts[order[(i + 1) % len(order)]]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        r, a, b = got.loc[doc], winnow(code_points(t)), winnow(code_points(edited))
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(t), hashlib.sha256(edited.encode()).hexdigest(), digest(a), digest(b))
        assert r.near_edited == likeness(np.unique(a[0]), np.unique(b[0]))
        assert r.near_next == likeness(np.unique(a[0]), np.unique(winnow(code_points(after))[0]))
    random.seed(2)
    for _ in range(300):  # windows one by one: the least hash of each, the rightmost of equal ones
        points = code_points("".join(random.choice("ab") for _ in range(random.randint(0, 70))))
        h, at = one_by_one(points)
        got_h, got_at = winnow(points)
        assert got_at.tolist() == at and got_h.tolist() == h
    for _ in range(50):  # a shared passage of gram + window - 1 characters is found
        shared = "".join(random.choice("abcdef") for _ in range(31))
        x, y = (winnow(code_points("".join(random.choice("uvwxyz") for _ in range(20)) + shared + "".join(random.choice("uvwxyz") for _ in range(20)))) for _ in range(2))
        assert set(x[0].tolist()) & set(y[0].tolist())
    assert likeness(np.zeros(0), np.zeros(0)) == 1.0


def test_main_text(spark):
    import html

    pages = {r["page_id"]: r["html"] for r in pq.read_table(f"{SF}/pages.parquet").to_pylist()}
    for r in query(spark, "op8_main_text").itertuples():
        body = re.search(r"<article>(.*?)(</article>|\Z)", pages[r.page_id], re.S)[1].replace("<br>", " ")
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", body))
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_template_classes():
    from vellum.llm.html_template import extract, fitted

    assert fitted(list("axbyazb"), [["a", "b"], ["x"], ["y", "z"]])[0] == (0, 6, ["a", "b"])
    page = "<div>We use cookies here.</div><p>News &amp; more<p>of today<form>x</form><aside>y</aside>"
    words = ["We", "use", "cookies", "here."]
    assert extract(page, [words], 9) == "News & more\n\nof today" and extract(page, [], 1).startswith("We use")


def test_names_inside_articles():
    from vellum.llm.html_template import extract

    page = '<article><header><h1 id="share">Title</h1></header><h2 id="related-work">Related work</h2><p class="notice-period">Notice period text</p><div class="share">tweet</div><p>x</p></article>'
    assert extract(page, [], 1) == "Title\n\nRelated work\n\nNotice period text\n\nx"
    assert extract('<div class="site-header">h</div><p>the cat sat</p>', [["the", "q"], ["cat", "r"], ["sat", "s"]], 9) == "the cat sat"


def test_template_slots(spark):
    """Text repeated inside articles is template; main text outside a teaser and single pages' text stay."""
    from vellum.llm.html_template import main_text

    random.seed(8)
    say = lambda n: " ".join("".join(random.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    own = [(say(30), say(2), say(40)) for _ in range(12)]
    inside = "<article><p>{}</p><p>read more on this</p><p>This was written for you by {} in our office</p><p>read {}</p></article>"
    rows = [(i, "http://a.b/", inside.format(*x)) for i, x in enumerate(own)] + [(100 + i, "http://c.d/", f"<article>look here {x[1]}</article><div><p>we use files of yours</p><p>{x[0]}</p></div>") for i, x in enumerate(own)]
    rows += [(200, "http://e.f/", inside.format(*own[0]))]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, (text, name, more) in enumerate(own):
        assert got[i] == f"{text}\n\n{name}\n\nread {more}"
        assert text in got[100 + i] and name in got[100 + i] and "files" not in got[100 + i]
    assert "read more on this" in got[200]


def test_warc(spark):
    import base64

    from vellum.llm.warc import LoserTree, index_captures, read_archives, url_key, write_archives

    pages = pq.read_table(f"{SF}/pages.parquet").to_pylist()
    largest = {}
    for r in pages:
        largest[r["html"]] = max(largest.get(r["html"], -1), r["page_id"])
    for r, p in zip(query(spark, "op2_warc").sort_values("page_id").itertuples(), sorted(pages, key=lambda p: p["page_id"]), strict=True):
        data = p["html"].encode()
        assert (r.page_id, r.payload_bytes, r.payload_digest) == (p["page_id"], len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert r.record_type == ("response" if largest[p["html"]] == r.page_id else "revisit") and (r.record_type == "response" or r.refers_to == largest[p["html"]])
    odd = spark.createDataFrame([(1, None, None), (2, "http://a.b/c", ""), (2, "http://a.b/c", ""), (3, "HTTP://www.B.a/x?q", "é" * 9), (None, "u", "é" * 9)], "page_id long, url string, html string")
    written = write_archives(odd)
    assert sorted(r.payload for r in read_archives(written).where("record_type = 'response'").collect())[-1] == ("é" * 9).encode()
    rows = index_captures(written, fan_in=2).orderBy("range_id").collect()
    assert len(rows) == 5 and [(r.url_key, r.timestamp) for r in rows] == sorted((r.url_key, r.timestamp) for r in rows)
    kinds = {(r.page_id, r.payload_bytes): [] for r in rows}
    for r in rows:
        kinds[r.page_id, r.payload_bytes].append((r.record_type, r.refers_to))
    assert kinds == {(1, 0): [("revisit", 2)], (2, 0): [("response", None)] * 2, (3, 18): [("response", None)], (None, 18): [("revisit", 3)]}
    nulls = spark.createDataFrame([(None, "u", "x"), (None, "v", "x")], "page_id long, url string, html string")
    assert [(r.record_type, r.refers_to) for r in index_captures(write_archives(nulls)).collect()] == [("response", None)] * 2
    many = spark.range(300).selectExpr("id as page_id", "concat('http://h', id % 7, '.org/', id % 3) as url", "repeat('p', int(id % 50)) as html").repartition(12)
    got = index_captures(write_archives(many, archive_bytes=9000), fan_in=4, range_rows=20, block_rows=8).orderBy("range_id").collect()
    assert len({r.range_id for r in got}) > 3 and [(r.url_key, r.timestamp, r.page_id) for r in got] == sorted((r.url_key, r.timestamp, r.page_id) for r in got)
    seen = Counter()
    for r in got:
        assert r.history == seen[r.url_key]
        seen[r.url_key] += 1
    assert len(got) == 300 and sum(r.record_type == "response" for r in got) == 50
    assert index_captures(write_archives(odd.limit(0))).count() == 0
    random.seed(1)
    for k in range(1, 9):
        runs = [sorted(random.choices(range(50), k=random.randint(0, 20))) for _ in range(k)]
        assert [x for x, in LoserTree([iter([(v,) for v in r]) for r in runs])] == sorted(v for r in runs for v in r)
    assert url_key("http://www.a.example.org/P?Q") == "org,example,a)/p?q"


@pytest.mark.parametrize("name", ["op5_jaccard_join", "op6_line_frequency"])
def test_against_sql(spark, name):
    import os

    import duckdb

    from vellum.llm.oracle import SQL

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    want, got = con.execute(SQL[name]).df(), query(spark, name)
    cols = sorted(want.columns)
    assert cols == sorted(got.columns)
    assert got[cols].sort_values("doc_id").astype(str).values.tolist() == want[cols].sort_values("doc_id").astype(str).values.tolist()


def test_jaccard_large_group(spark):
    """Hot words: a large group of near copies beside unrelated documents that share a passage."""
    from vellum.llm.jaccard import jaccard_components, shingle_sets, similar

    random.seed(4)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(5))
    base, passage = [word() for _ in range(120)], [word() for _ in range(14)]
    docs = []
    for _ in range(90):
        w = list(base)
        for _ in range(random.randint(0, 4)):
            w[random.randrange(len(w))] = word()
        docs.append(" ".join(w))
    docs += [" ".join([*passage, *(word() for _ in range(random.randint(3, 100)))]) for _ in range(90)]
    sets = shingle_sets(docs, 5)
    label = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if similar(sets[i], sets[j], 80):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    got = jaccard_components(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(3)).orderBy("doc_id").collect()
    assert [r.component_id for r in got] == label and [r.n_shingles for r in got] == [len(s) for s in sets]


def test_jaccard_group_beyond_its_centre(spark):
    """Near copies with one to twelve edits each, some sharing edits: many aren't similar to the first text, but to each other."""
    from vellum.llm.jaccard import jaccard_components, shingle_sets, similar

    random.seed(9)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(150)]
    docs, kinds = [" ".join(base)], []
    for _ in range(12):  # versions far from the base, with copies of their own
        w = list(base)
        for at in random.sample(range(150), random.randint(4, 9)):
            w[at] = word()
        kinds.append(w)
    for _ in range(330):
        w = list(random.choice([base, *kinds]))
        for _ in range(random.randint(0, 12)):
            i = random.randrange(len(w))
            w[i : i + 1] = random.choice([[word()], [], [w[i], word()]])
        docs.append(" ".join(w))
    sets = shingle_sets(docs, 5)
    label = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if similar(sets[i], sets[j], 80):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    assert len(set(label)) > 20
    got = jaccard_components(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(3)).orderBy("doc_id").collect()
    assert [r.component_id for r in got] == label


def test_jaccard_deals_texts_by_id_at_every_size(spark):
    from vellum.llm.jaccard import texts_of

    narrow = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "d")], "doc_id long, text string")
    found = texts_of(narrow, spark.createDataFrame([(2,), (None,)], "id_ long"))
    assert sorted(map(tuple, found.collect())) == [(2, "b"), (2, "c")]
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_jaccard_bands_have_no_end():
    from vellum.llm.jaccard import Bands, mix, sketch_words

    bands = Bands(80)
    assert 3 * len(bands.lows) < 256 and bands.of(1 << 31) < len(bands.lows) - 1
    big = mix(np.arange(1, 1_300_001, dtype=np.uint64))
    words = sketch_words(big, bands)
    other = sketch_words(big[:1_200_000], bands)
    assert len(words) < 3 * 1_300_000 and len(np.intersect1d(words, other)) > bands.spare(bands.of(1_200_000)) // 4


def test_mixing_reaches_the_least_squares(spark):
    """Fitted totals against a plain projected gradient of many steps, with targets that can and that can't be met."""
    from vellum.llm.mixing import DOMAINS, fit_rates

    rows = [(100, [0.9, 0.1, 0.0]), (50, [0.2, 0.7, 0.1]), (80, [0.1, 0.1, 0.8]), (0, [0.4, 0.3, 0.3]), (30, [0.5, 0.25, 0.25]), (30, [0.5, 0.25, 0.25]), (7, [0.3, 0.3, 0.4])]
    n, p = np.array([r[0] for r in rows], float), np.array([r[1] for r in rows])
    df = spark.createDataFrame(rows, "n_tokens long, posterior array<double>")
    for targets in ({"good": 0.6, "poor": 0.3, "toxic": 0.1}, {"good": 0.1, "poor": 0.8, "toxic": 0.1}, {"good": 0.97, "poor": 0.01, "toxic": 0.02}):
        b, w = np.array([targets[d] for d in DOMAINS]) * 200, np.ones(len(n))
        for _ in range(200_000):
            w = np.maximum(0, w + 0.004 * p @ (b - (w * n) @ p))
        _, totals = fit_rates(df, targets=targets, budget=200.0)
        left = lambda got: float(np.linalg.norm(b - got))
        assert left(np.array([totals[d][1] for d in DOMAINS])) <= left((w * n) @ p) + 0.1, (targets, totals, (w * n) @ p)


def test_mixing(spark):
    from vellum.llm.common import table
    from vellum.llm.mixing import DOMAINS, fit, fit_rates, mix, posteriors

    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    from pyspark.sql import functions as F

    model = fit(docs, labels.where("doc_id % 2 = 0"))
    held = docs.join(labels.where("doc_id % 2 = 1"), "doc_id").select("quality", "toxic", posteriors(F.col("text"), model).alias("p")).collect()
    best = [max(range(3), key=lambda i: r.p[i]) for r in held]
    truth = [DOMAINS.index("toxic" if r.toxic else "good" if r.quality else "poor") for r in held]
    assert np.mean([a == b for a, b in zip(best, truth, strict=True)]) > 0.9
    rows = [(100, [0.9, 0.1, 0.0]), (50, [0.2, 0.7, 0.1]), (80, [0.0, 0.1, 0.9]), (0, [0.4, 0.3, 0.3])]
    _, totals = fit_rates(spark.createDataFrame(rows, "n_tokens long, posterior array<double>"), targets={"good": 0.6, "poor": 0.3, "toxic": 0.1}, budget=200.0)
    assert all(abs(a - b) < 0.1 for a, b in totals.values())
    assert mix(docs.limit(0), labels.limit(0)).count() == 0  # no labels either


@pytest.mark.parametrize("grow", [False, True])
def test_mixing_copies_meet_the_targets(spark, grow):
    from vellum.llm.common import table
    from vellum.llm.mixing import mix, totals

    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    got = totals(mix(docs, labels, grow=grow))
    assert all(abs(a - b) < 0.005 for a, b in got.values()), got


def test_pipeline_drops_toxic_documents(spark):
    import corpus_pipeline

    from vellum.llm.common import table
    from vellum.llm.mixing import TARGETS, fit, mixed_documents, posteriors

    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    toxic = labels.where("toxic = 1").select("doc_id")
    assert corpus_pipeline.mixing(spark, docs, sf).join(toxic, "doc_id").count() == 0
    # Labels that aren't known to the fit: those that the model takes for toxic go.
    known = labels.where("doc_id % 2 = 0")
    kept = mixed_documents(docs, known, targets={**TARGETS, "toxic": 0.0})
    p = posteriors(kept["text"], fit(docs, known))
    assert kept.select(p.alias("p")).where("p[2] > p[0] and p[2] > p[1]").count() == 0
    odd = toxic.where("doc_id % 2 = 1").join(docs, "doc_id")
    lost = 1 - kept.join(toxic.where("doc_id % 2 = 1"), "doc_id").select("doc_id").distinct().count() / odd.count()
    assert lost > 0.8


def test_odd_inputs(spark, odd):
    import corpus_pipeline

    from vellum.llm.html_template import main_text
    from vellum.llm.huffman_ids import read_ids, write_ids
    from vellum.llm.jaccard import jaccard_components
    from vellum.llm.licences import licences
    from vellum.llm.pii import find_pii
    from vellum.llm.quality import quality
    from vellum.llm.winnowing import compare_with_next, fingerprints

    none = odd.limit(0)
    for op in (licences, find_pii, fingerprints, compare_with_next, quality, jaccard_components):
        assert op(odd).count() == len(ODD) and op(none).count() == 0, op
    groups = {(r.doc_id, r.component_id) for r in jaccard_components(odd).collect()}
    assert (9, 3) in groups and (3, 3) in groups and (2, 2) in groups and (1, 1) in groups
    pages = spark.createDataFrame([(1, None, None), (None, "http://h/", "<p>a&amp;b"), (2, "x", "")], "page_id long, url string, html string")
    assert sorted(r.text for r in main_text(pages).collect()) == ["", "", "a&b"] and main_text(pages.limit(0)).count() == 0
    ids = spark.createDataFrame([(None, bytearray(b"\x01\x00")), (5, bytearray(b"")), (5, bytearray(b"\x02\x00\x01\x00"))], "key long, ids binary")
    assert [(r.key, r.start, r.n_ids) for r in read_ids(write_ids(ids)[0]).orderBy("start", "n_ids").collect()] == [(None, 0, 1), (5, 1, 0), (5, 1, 2)]
    assert read_ids(write_ids(ids.limit(0))[0]).count() == 0
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, SF)
        assert out.columns == odd.columns and out.dtypes == odd.dtypes, name
        out.count()
        assert stage(spark, none, SF).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, odd, SF).where("doc_id = 3").count() == 2
    assert corpus_pipeline.STAGES[-1][1](spark, none, SF).count() == 0


def test_one_row_of_each_group_stays(spark):
    """Near duplicates with null ids, and an id that names one group and is a copy in another."""
    import corpus_pipeline

    random.seed(6)
    a, b, c = (" ".join("".join(random.choice("abcdefgh") for _ in range(5)) for _ in range(60)) for _ in range(3))
    rows = [(5, a), (None, a), (None, a + " x"), (None, b), (None, b + " x"), (None, b), (1, c), (2, c + " x"), (2, a + " y"), (2, "own words only " * 3)]
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()
    groups = sorted((next(x for x in (a, b, c, "own") if r.text.startswith(x)), -1 if r.doc_id is None else r.doc_id) for r in got)
    assert groups == sorted([(a, 2), (b, -1), (c, 1), ("own", 2)])


def brute_quality(rows):
    """Kept (doc_id, text without lines above the limit) of (doc_id, source, text), by dictionaries of whole lines."""
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    norm = lambda x: " ".join(words(x.lower()))
    seen = {}
    for _, host, t in rows:
        for x in (t or "").split("\n"):
            if norm(x):
                seen.setdefault((host, norm(x)), set()).add(t)
    out = []
    for doc, host, t in rows:
        w = words(t or "")
        grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        again = {i + j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(3)}
        if len(w) < 50 or 100 * len(again) > 50 * len(w):
            continue
        clean = "\n".join(x for x in t.split("\n") if not norm(x) or len(seen[host, norm(x)]) <= 10)
        if len(words(clean)) >= 0.5 * len(w):
            out.append((doc, clean))
    return out


def test_pipeline_against_brute_force(spark):
    """Every stage on what the one before it has kept, each held against a plain version."""
    from tokenizers import Tokenizer

    import corpus_pipeline
    from vellum.llm.common import materialize, table
    from vellum.llm.jaccard import shingle_sets, similar
    from vellum.llm.pii import masked, scan
    from vellum.llm.tokens import vocabulary_path

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "ngram_jaccard_join", "pii", "mixing", "best_fit_packing"]
    stages = dict(corpus_pipeline.STAGES)
    docs = table(spark, SF, "documents")
    before = {r.doc_id: r for r in docs.collect()}
    one = materialize(stages["quality_rules"](spark, docs, SF), "t")
    got = {r.doc_id: r for r in one.collect()}
    assert {k: r.text for k, r in got.items()} == dict(brute_quality([(r.doc_id, r.source, r.text) for r in before.values()])) and one.columns == docs.columns
    assert all(r.n_chars == len(r.text) and r.lang == before[k].lang for k, r in got.items())
    two = materialize(stages["ngram_jaccard_join"](spark, one, SF), "t")
    ids = sorted(got)
    sets = shingle_sets([got[k].text for k in ids], 5)
    label = list(range(len(ids)))
    for i in range(len(ids)):
        for j in range(i):
            if similar(sets[i], sets[j], 80):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    kept = {r.doc_id: r for r in two.collect()}
    assert sorted(kept) == sorted({ids[x] for x in label}) and all(kept[k] == got[k] for k in kept) and two.count() == len(kept)
    three = materialize(stages["pii"](spark, two, SF), "t")
    for r in three.collect():
        assert r.text == masked(kept[r.doc_id].text, scan(kept[r.doc_id].text)) and not brute_pii(r.text) and r.n_chars == len(r.text)
    four = materialize(stages["mixing"](spark, three, SF), "t")
    toxic = {r.doc_id for r in table(spark, SF, "labels").where("toxic = 1").collect()}
    rows = {r.doc_id: r for r in three.collect()}
    mixed = four.collect()
    copies = Counter(r.doc_id for r in mixed)
    assert all(r == rows[r.doc_id] for r in mixed) and not toxic & set(copies) and four.columns == docs.columns and len(copies) > 0.7 * len(set(rows) - toxic)
    five = corpus_pipeline.run(spark, SF).collect()
    plain = Tokenizer.from_file(vocabulary_path())
    want = Counter()
    for r in mixed:
        data = np.array([*plain.encode(r.text, add_special_tokens=False).ids, 0], "<u4")
        first = len(data) % 2048 or min(len(data), 2048)
        for i, at in enumerate([0, *range(first, len(data), 2048)]):
            part = data[at : first if i == 0 else at + 2048]
            want[r.doc_id, i, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in five) == want
    held = {}
    for r in five:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in held.values():
        parts.sort()
        assert all(a == sum(n for _, n in parts[:i]) for i, (a, _) in enumerate(parts)) and sum(n for _, n in parts) <= 2048


def test_the_driver_keeps_no_encoder_for_the_ids_type():
    from vellum.llm import tokens

    held = dict(tokens._encoders)
    tokens._encoders.clear()
    try:
        assert tokens.id_type(tokens.vocabulary_path()) == "<u2" and not tokens._encoders
    finally:
        tokens._encoders.update(held)


def test_garbage_of_rounds_is_collected(spark, monkeypatch):
    from vellum.llm import components as C

    calls = []
    monkeypatch.setattr(C, "tidy", calls.append)
    links = spark.createDataFrame([(i, i + 1) for i in range(8)], "a long, b long")
    assert {(r.v, r.label) for r in C.components(links).collect()} == {(i, 0) for i in range(9)} and calls


def test_new_links_join_components_without_new_rounds(spark, monkeypatch):
    """Links added later give the labels of all links together, and links inside components start no rounds: each holds the driver's memory."""
    import vellum.llm.components as C

    made = lambda rows: spark.createDataFrame(rows, "a long, b long")
    of = lambda df: sorted((r.v, r.label) for r in df.collect())
    rng = random.Random(5)
    first, more = ([tuple(sorted(rng.sample(range(low, 90), 2))) for _ in range(30)] for low in (10, 0))
    labels = C.components(made(first))
    assert of(C.joined_components(labels, made(more))) == of(C.components(made(first + more)))
    inside = [(v, label) for v, label in of(labels) if v != label] + [(5, 5)]
    monkeypatch.setattr(C, "components", None)
    assert of(C.joined_components(labels, made(inside))) == of(labels)
