"""Archives, periodic runs and spelling variants against brute force."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tallyspark.llm import common, periodic, spelling, warc
from tallyspark.llm.common import materialize

WORD = re.compile(r"[^\x20\x09-\x0D]+")

# ---------------------------------------------------------------- archives

FAKE = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:row:77>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
LONGER = FAKE.replace("Content-Length: 5", "Content-Length: 1000")
PAGES = "page_id long, url string, html string, id int, value string, file string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, 1, "v", "f") for r in rows], PAGES)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def expected(rows):
    best = {}
    for i, _, h in rows:
        if i is not None:
            best[h or ""] = max(best.get(h or "", i), i)
    out = []
    for i, url, h in rows:
        body, first = (h or "").encode(), best.get(h or "")
        again = first is not None and first != i
        url = None if url is None else re.sub(r"[\x00-\x20]", "%20", url)
        out.append((i, url, "revisit" if again else "response", first if again else None, len(body), digest(body), None if again else h or ""))
    return Counter(out)


@pytest.fixture(scope="module")
def odd_pages():
    rng = random.Random(1)
    pool = ["", "a", None, "x\r\n" + FAKE + "y", FAKE, "\r\n" + FAKE * 3, "\r\nWARC/1.1\r\n", "p\r", "\r\n\r\nWARC/1.", "é" * 50, "\r\n" + LONGER, "x\r\n" + FAKE[:-4]]
    rows = [(i, f"http://h/{i} \r\nWARC-Type: x" if i % 5 else None, pool[rng.randrange(len(pool))] if i % 3 else f"body {i} " * rng.randrange(60)) for i in range(200)]
    rows += [(None, "u", "é" * 50), (None, None, "only"), (3, "again", "zz"), (1000, "\r\nWARC/1.1", "\r\n".join(FAKE for _ in range(300))), (1001, "long", "<p>long page</p>\r\n" * 40_000)]
    return rows


@pytest.mark.parametrize("range_bytes", ["128m", "5000", "300"])
def test_archives_are_read_back(spark, odd_pages, range_bytes, tmp_path):
    rows = [r for r in odd_pages if range_bytes != "300" or r[0] != 1001]
    path = str(tmp_path / "warc")
    warc.write(pages(spark, rows).repartition(3), path)
    keys = {"spark.sql.files.maxPartitionBytes": range_bytes, "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        found = warc.read(spark, path).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert Counter((r.id, r.url, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest, None if r.payload is None else bytes(r.payload).decode()) for r in found) == expected(rows)
    assert {r.digest_ok for r in found} == {None, True}


def test_archive_is_a_chain_of_records(spark, tmp_path):
    """Read by a plain reader that goes from record to record."""
    rows = [(i, "u", f"page {i // 2} \r\n{FAKE}") for i in range(20)]
    path = tmp_path / "warc"
    warc.write(pages(spark, rows).coalesce(1), str(path))
    data, kinds = b"".join(f.read_bytes() for f in sorted(path.glob("part-*"))), Counter()
    while data:
        head, _, rest = data.partition(b"\r\n\r\n")
        size = int(re.search(rb"\r\nContent-Length: ([0-9]+)$", head)[1])
        kinds[re.search(rb"WARC-Type: (\w+)", head)[1].decode()] += 1
        assert head.startswith(b"WARC/1.1\r\n") and rest[size : size + 4] == b"\r\n\r\n"
        data = rest[size + 4 :]
    assert kinds == {"response": 10, "revisit": 10}


def test_broken_archives(spark, tmp_path):
    """What is before a break is read; false magic behind it is not taken for a record."""
    good = lambda i: f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:row:{i}>\r\nContent-Length: 7\r\n\r\nA\r\n\r\nbc\r\n\r\n".encode()
    (tmp_path / "cut.warc").write_bytes(good(1) + good(2) + good(3)[:-9])
    (tmp_path / "wrong.warc").write_bytes(good(4) + good(5).replace(b"Length: 7", b"Length: 9999") + good(6))
    (tmp_path / "none.warc").write_bytes(b"no magic at all" + good(7))
    (tmp_path / "empty.warc").write_bytes(b"")
    (tmp_path / "short.warc").write_bytes(good(8).replace(b"Length: 7", b"Length: 6") + good(9))
    found = warc.read(spark, str(tmp_path)).collect()
    assert sorted((r.id, bytes(r.payload)) for r in found) == [(1, b"bc"), (2, b"bc"), (4, b"bc"), (8, b"b")]


def test_empty_tables(spark, tmp_path):
    warc.write(pages(spark, []), str(tmp_path / "w"))
    assert warc.read(spark, str(tmp_path / "w")).count() == 0


# ---------------------------------------------------------------- runs


def brute_runs(w, least=12):
    out, n = {}, len(w)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q):
                out.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((s, size, q) for (s, size), q in out.items())


def test_runs_of_words():
    rng = random.Random(3)
    for _ in range(3000):
        letters = rng.choice([1, 2, 2, 3, 4])
        w = [rng.randrange(letters) for _ in range(rng.randrange(1, 60))]
        if rng.random() < 0.6:
            base = [rng.randrange(letters + 1) for _ in range(rng.randrange(1, 12))]
            w = w[: rng.randrange(8)] + (base * 9)[: rng.randrange(1, 50)] + w[: rng.randrange(9)] + (base * 9)[: rng.randrange(1, 30)]
            w = w + w if rng.random() < 0.3 else w
        assert periodic.runs_of(w) == brute_runs(w), w
        assert periodic.runs_of(w, 2) == brute_runs(w, 2), w


def test_factors():
    rng = random.Random(4)
    for _ in range(500):
        w = [rng.randrange(3) for _ in range(rng.randrange(40))]
        at = 0
        for start, size, place in periodic.factors(w):
            assert start == at
            longest = max((k for p in range(start) for k in range(1, len(w) - start + 1) if w[p : p + k] == w[start : start + k]), default=0)
            assert size == max(1, longest) and (place is None) == (longest == 0)
            assert place is None or (place < start and w[place : place + size] == w[start : start + size])
            at += size
        assert at == len(w)


def changed(doc, text):
    w = WORD.findall(text or "")
    if doc is not None and w and (h := zlib.crc32(str(doc).encode())) % 10 == 0:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def test_periodic_runs(spark):
    rng = random.Random(5)
    rows = [(None, None), (None, "a " * 20), (1, None), (2, ""), (3, " \n\t"), (4, "é " * 12), (4, "é " * 11), (4, "\U0001f600 b\x0b" * 9 + "c")]
    vocabulary = [f"w{i}" for i in range(30)]
    for i in range(10, 150):
        w = rng.choices(vocabulary, k=rng.randrange(80))
        for _ in range(rng.randrange(3)):
            at, base = rng.randrange(len(w) + 1), rng.choices(vocabulary, k=rng.randrange(1, 15))
            w[at:at] = (base * 5)[: rng.randrange(1, 60)]
        rows.append((i, " ".join(w)))
    rows.append((200, " ".join(f"x{i % 977}" for i in range(60_000)) + " end " + "y " * 5000))
    docs = spark.createDataFrame([(i, t, 1, "r", "n") for i, t in rows], "doc_id long, text string, runs int, flat string, n_words string")
    for change in (False, True):
        got = Counter((r.doc_id, r.n_words, tuple(map(tuple, r.runs)), r.collapsed) for r in periodic.periodic_runs(docs, change=change).collect())
        want = Counter()
        for i, t in rows:
            w = changed(i, t) if change else WORD.findall(t or "")
            if len(w) > 10_000 and not change:
                runs = [(0, 60_000, 977), (60_001, 5000, 1)]
            elif len(w) > 10_000:
                continue
            else:
                runs = brute_runs(w)
            gone = {k for s, size, q in runs for k in range(s + q, s + size)}
            want[i, len(w), tuple(runs), " ".join(x for k, x in enumerate(w) if k not in gone)] += 1
        assert (want - got) == Counter() and sum(got.values()) == len(rows)
    assert periodic.periodic_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError, match="least"):
        periodic.periodic_runs(docs, 5)


# ---------------------------------------------------------------- spelling


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def brute_variants(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = 1 if doc is None else zlib.crc32(f"{doc}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    about = {w: [v for v in words if near(w, v)] for w in words}
    forms = {}
    for w, vs in about.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        forms[w] = best if best is not None and words[best] >= 5 * words[w] else None

    def root(w):
        while forms[w] is not None:
            w = forms[w]
        return w

    return {(w, forms[w], root(w), n, len(about[w]), words.get(forms[w])) for w, n in words.items()}


@pytest.fixture(scope="module")
def spelled_rows():
    rng = random.Random(6)
    stems = ["abcdef", "aaaaaa", "prefixlike", "prefixlikes", "ÀÉîôûß", "x" * 40, "straße÷×", "commonlongprefixed"]
    rows = [(None, "abcdef " * 3), (1, None), (2, ""), (3, "short abc"), (4, "Éclair éclair ÉCLAIR " * 6), (4, "ABCDEF abcdeF " * 9)]
    for i in range(10, 400):
        w = rng.choice(stems) if rng.random() < 0.5 else stems[0]
        for _ in range(rng.randrange(3)):
            at, c = rng.randrange(len(w)), rng.choice("abcé")
            w = rng.choice([w[:at] + c + w[at + 1 :], w[:at] + c + w[at:], w[:at] + w[at + 1 :]])
        rows.append((i, f"{w.upper() if i % 7 == 0 else w}, " * rng.choice([1, 5, 6, 30, 200])))
    return rows


@pytest.mark.parametrize("most", [2, 5, 4096])
def test_spelling_variants(spark, spelled_rows, most):
    docs = spark.createDataFrame([(i, t, "w", 3, "p") for i, t in spelled_rows], "doc_id long, text string, word string, n int, part string")
    got = [tuple(r) for r in spelling.variants(docs, change=True, most=most).collect()]
    want = brute_variants(spelled_rows)
    assert len(got) == len(want) and set(got) == want
    assert any(x[5] for x in want)
    if most == 2:
        assert spelling.variants(docs.limit(0), change=True).count() == 0


def test_chains_of_forms(spark):
    words = [("aaaaaaaa", 5), ("aaaaaaab", 25), ("aaaaaabb", 125), ("aaaaabbb", 625), ("aaaabbbb", 3125), ("aaabbbbb", 15625)]
    docs = spark.createDataFrame([(i, f"{w} " * n) for i, (w, n) in enumerate(words)], "doc_id long, text string")
    assert {r.word: r.root for r in spelling.variants(docs).collect()} == {w: "aaabbbbb" for w, _ in words}


def test_pairs_of_a_hot_prefix(spark):
    """Thousands of words behind one prefix, in parts of a few: the same pairs as in one part."""
    rng = random.Random(8)
    words = sorted({"sameprefix" + "".join(rng.choice("abc") for _ in range(rng.randrange(1, 8))) for _ in range(1500)})
    table = materialize(spark.createDataFrame([(w, 7) for w in words], "word string, n long"), "test-words")
    own = set(words)
    want = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            want[w] |= {w[:i] + c + w[i + 1 :] for c in "sameprfixbc"} | {w[:i] + w[i + 1 :]}
        for i in range(len(w) + 1):
            want[w] |= {w[:i] + c + w[i:] for c in "sameprfixbc"}
        want[w] = (want[w] & own) - {w}
    got = spelling.near_words(table, most=20).groupBy("word").agg(F.collect_list("near").alias("near")).collect()
    assert {r.word: sorted(r.near) for r in got} == {w: sorted(v) for w, v in want.items() if v}


def test_no_vocabulary_table_reaches_the_driver_by_the_size_of_its_files(spark, tmp_path, monkeypatch):
    """Tables counted beyond the bound are shuffled, though their files are small; so are the salted copies of their rows."""
    monkeypatch.setattr(common, "BROADCAST_BYTES", 1000)
    spark.createDataFrame([(f"w{i}", f"w{i // 3}") for i in range(100)], "word string, root string").write.parquet(str(tmp_path / "roots"))
    roots = spark.read.parquet(str(tmp_path / "roots"))
    onward = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
    moved = common.attached(roots, onward, "root", "left")
    assert "Broadcast" not in moved._jdf.queryExecution().executedPlan().toString()
    assert {r.word: r.further for r in moved.collect()} == {f"w{i}": f"w{i // 9}" for i in range(100)}
    one_side = roots.join(common.small_or_plain(onward.select("root")), "root", "left_anti")
    assert "Broadcast" not in one_side._jdf.queryExecution().executedPlan().toString() and one_side.count() == 0
    monkeypatch.setattr(common, "BROADCAST_BYTES", 1 << 20)
    assert "Broadcast" in common.attached(roots, onward, "root", "left")._jdf.queryExecution().executedPlan().toString()
