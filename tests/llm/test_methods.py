"""That the results come by the methods named: spans of the automaton, discovered identifiers, certified cutoffs, drawn slots."""

import hashlib
import html
import itertools
import random
import re
import time
from collections import Counter, defaultdict
from math import comb, log

import corpus_pipeline
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import common, html_text, mixing, neardup, pii, quality_classifier, quality_rules, secret_scan, topk
from tallyspark.llm import queries as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    return spark.createDataFrame([(r[0], r[1], *(r[2:] or ("en", "a")), len(r[1] or "")) for r in rows], DOCS)


# ---------------------------------------------------------------- secret scan

GROUPED = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "github": r"gh[pousr]_([A-Za-z0-9]+)",
    "slack": r"xox[abprs]-([A-Za-z0-9-]+)",
}


def by_engine(text):
    out = []
    for i, kind in enumerate(secret_scan.KINDS):
        what, least = secret_scan.LEAST[kind]
        for m in re.finditer(GROUPED.get(kind, secret_scan.RULES[kind]), text, re.ASCII):
            if len(m[1] if what == "tail" else m[0]) >= least:
                out.append((m.start(), i, m.end()))
    return sorted(out)


def scanned(texts):
    found = [[] for _ in texts]
    for text, rule, start, end in zip(*(x.tolist() for x in secret_scan.scanner().spans([t.encode() for t in texts])), strict=True):
        found[text].append((start, rule, end))
    return found


def test_all_kinds_of_secrets_against_an_engine():
    rng = random.Random(1)
    parts = ["password", "passwd", "TOKEN", "token", "api_key", "apiKey", "AKIA", "=", ": ", '"', "abcdef0123", "ABCDEF", "\n", " ", "é", "x", "secret", "deadbeef" * 4, "-----BEGIN ", "RSA "]
    parts += ["PRIVATE KEY-----", "-", "ghp_", "a1B2" * 9, "xoxb-", "1234567890", "eyJ", "eyJhbGciOi", ".", "😀"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 60))) for _ in range(4000)]
    found = scanned(texts)
    assert found == [by_engine(t) for t in texts]
    assert {rule for spans in found for _, rule, _ in spans} == set(range(len(secret_scan.KINDS)))


def test_long_secrets_take_linear_time():
    began = time.perf_counter()
    texts = ["a" * 1_000_000, "token=" * 50_000, "", "plain words " * 50_000]
    assert scanned(texts) == [by_engine(t) for t in texts]
    assert time.perf_counter() - began < 20


# ---------------------------------------------------------------- personal data


def spans_of(found):
    return {r.doc_id: r.s for r in found.select("doc_id", pii.listed(F.col("spans")).alias("s")).collect()}


def test_context_discovers_what_no_base_pattern_finds(spark):
    far = " " * 100
    rows = [(i, f"and so phone {far} +1 (212) 555-{1000 + i} it went") for i in range(30)]
    rows += [(99, "and so phone 212/555/7788, it went"), (98, "nothing at all 2125557788 here"), (97, f"phone{far}212.555.7799!"), (96, "phone the 2125557788 of")]
    found = spans_of(pii.find(documents(spark, rows)))
    assert found[99] == "phone:13:25" and found[97] == "phone:105:117"
    assert found[98] == found[96] == ""
    assert all(found[i] == f"phone:{13 + 101}:{13 + 101 + 17}" for i in range(30))
    assert {r.doc_id: r.text for r in pii.redact(documents(spark, rows)).collect()}[99] == "and so phone <phone>, it went"


def test_two_words_tell_what_one_doesnt(spark):
    rows = [(i, f"w{'abcdefghij'[i % 10]} my mail u{i}@x.org v{'abcdefghij'[i // 10]}") for i in range(60)]
    rows += [(100 + i, f"q{'abcdefghij'[i % 10]} your mail {i}0") for i in range(60)]  # "mail" alone is no pattern
    rows += [(500, "zz my mail someone@localhost yy"), (501, "zz your mail someone@localhost yy")]
    found = spans_of(pii.find(documents(spark, rows)))
    assert found[500] == "email:11:28" and found[501] == ""


def test_hidden_seeds_are_found_again(spark):
    """A tenth of the seeds is hidden; by their contexts nine in ten of them and nothing else are to be found again."""
    rng = random.Random(5)
    lead = {"email": ["mail to", "contact me at", "reply to"], "ip": ["from host", "server address"], "phone": ["call us on", "phone number"]}
    rows = []
    for i in range(1200):
        kind = rng.choice(sorted(lead))
        value = {"email": f"u{i}@host{i % 7}.org", "ip": f"10.{i % 200}.{i % 90}.{i % 250}", "phone": f"+1-555-{2000000 + i}"}[kind]
        rows.append((i, f"{rng.choice(['then', 'so', 'now', 'here'])} {rng.choice(lead[kind])} {value} {rng.choice(['and', 'or', 'but'])} price {i}.5 x"))
    marked = common.materialize(pii._marked(documents(spark, rows)), "test-marked")
    hidden = F.pmod(F.xxhash64("instance"), F.lit(10)) == 0
    got = {(r.doc_id, s.kind, s.start, s.end) for r in pii._discovered(marked, hidden).collect() for s in r.found}
    truth = {(r.doc_id, r.b.kind, r.b.start, r.b.end): r.h for r in marked.select("doc_id", F.explode("base").alias("b"), F.col("instances")).select(
        "doc_id", "b", F.exists("instances", lambda i: (i["start"] <= F.col("b.end")) & (i["end"] >= F.col("b.start")) & (F.pmod(F.xxhash64(i["instance"]), F.lit(10)) == 0)).alias("h")).collect()}
    want = {k for k, h in truth.items() if h}
    same_place = {(d, k, e) for d, k, _, e in want}
    right = {x for x in got if (x[0], x[1], x[3]) in same_place}
    assert len(want) > 80 and len(right) >= 0.9 * len(want) and len(right) == len(got)


# ---------------------------------------------------------------- quality rules


def brute_cutoffs(rows, labels, learns, risk, delta):
    """The same choice in plain Python, with exact binomial sums. rows: dicts of the measures."""
    rules = list(quality_rules.shares())
    top = {"symbols": ("n_symbols", "word_chars"), "marks": ("n_marks", "n_words"), "lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words")}
    step = lambda r, rule: int(min(r[top[rule][0]] / max(r[top[rule][1]], 1), 1.0) * quality_rules.STEPS)
    used = [r for r in rows if r["doc_id"] in labels and not r["held"] and not (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])]
    goods = Counter({r["lang"]: 0 for r in used})
    for r in used:
        goods[r["lang"]] += labels[r["doc_id"]] if not learns[r["doc_id"]] else 0
    need = quality_rules.least_rows(len(goods), risk, delta)
    group = {g: ("own", g) if n >= need else ("pool",) for g, n in goods.items()}
    tests = {}
    for s in set(group.values()):
        mine = [({q: step(r, q) for q in rules}, labels[r["doc_id"]], learns[r["doc_id"]]) for r in used if group[r["lang"]] == s]
        learn, test = [x for x in mine if x[2]], [x for x in mine if not x[2]]
        n_good, n_bad = sum(y for _, y, _ in learn), sum(1 - y for _, y, _ in learn)
        worth = {}
        for q in rules:
            best = 0.0
            for at in sorted({x[q] for x, _, _ in learn} - {0}):
                g, b = sum(y for x, y, _ in learn if x[q] >= at), sum(1 - y for x, y, _ in learn if x[q] >= at)
                best = max(best, (b / max(n_bad, 1)) / (g / max(n_good, 1) + quality_rules.FLOOR))
                worth[q, at] = best
        n, seq = sum(y for _, y, _ in test), []
        for level in sorted({w for w in worth.values() if w > 0}, reverse=True):
            cut = {q: min((at for (p, at), w in worth.items() if p == q and w >= level), default=None) for q in rules}
            beyond = [y for x, y, _ in test if any(cut[q] is not None and x[q] >= cut[q] for q in rules)]
            k = sum(beyond)
            p = 1.0 if k >= n * risk else sum(comb(n, i) * risk**i * (1 - risk) ** (n - i) for i in range(k + 1))
            seq.append((p, len(beyond) - k - quality_rules.PENALTY * k, level, cut))
        if seq and n:
            tests[s] = seq
    out, alpha = {}, delta / len(set(group.values()))
    for s, seq in tests.items():
        passed = list(itertools.takewhile(lambda one: one[0] <= alpha, seq))
        gain, _, cut = max(((g, level, cut) for _, g, level, cut in passed), default=(0, 0, None))
        if gain > 0:
            out[s] = cut
    return {g: out[s] for g, s in group.items() if s in out}


def labelled(spark, seed, langs):
    rng = random.Random(seed)
    rows, labels = [], {}
    for i in range(2500):
        bad = rng.random() < 0.25
        mark = lambda w: w + ("##" if bad and rng.random() < 0.4 else "#" if rng.random() < 0.002 else "!" * rng.randrange(3) if bad else "")
        rows.append((i, " ".join(mark(f"w{rng.randrange(10**6)}") for _ in range(rng.randrange(12, 40))) + "\nsame line" * (rng.randrange(4) if bad else 0), rng.choice(langs), "a"))
        if rng.random() < 0.9:
            labels[i] = int(not bad)
    return documents(spark, rows), labels


@pytest.mark.parametrize(("seed", "langs"), [(1, ["en"] * 8 + ["de"] * 4 + [None, ""]), (2, ["en", "de", "fr", "es", "it", "pl", "nl", None, "", "pt"])])
def test_cutoffs_against_exact_binomials(spark, seed, langs):
    docs, labels = labelled(spark, seed, langs)
    table = spark.createDataFrame([(i, y, 0) for i, y in labels.items()], "doc_id long, quality int, toxic int")
    measured = common.materialize(quality_rules.measured(docs), "test-measured")
    learns = F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(1000)) < int(1000 * quality_rules.LEARN)
    rows = [r.asDict() for r in measured.withColumns({"held": common.held_out(), "learns": learns}).collect()]
    got = {r.stratum.lang: {q: r[q] for q in quality_rules.shares()} for r in quality_rules.cutoffs(measured, table).collect()}
    want = brute_cutoffs(rows, labels, {r["doc_id"]: r["learns"] for r in rows}, quality_rules.RISK, quality_rules.DELTA)
    assert got == want and got
    kept = {r.doc_id: r.kept for r in quality_rules.judge(docs, table).collect()}
    assert sum(not kept[i] for i, y in labels.items() if not y) > 0.5 * sum(1 - y for y in labels.values())
    assert sum(not kept[i] for i, y in labels.items() if y) <= 0.02 * sum(labels.values())


@pytest.mark.parametrize("strata", [1, 4, 16])
def test_chance_of_a_false_cutoff(spark, strata):
    """Drawn numbers of rejected good rows, three levels a stratum: the second and third are at the limit, so accepting either is an error. In many
    runs, the share with an error in any stratum keeps within DELTA (and 3 standard deviations of its own)."""
    rng, times, good = np.random.default_rng(strata), 3000, 2000
    rows = []
    for run in range(times):
        for s in range(strata):
            k = 0
            for level, chance in ((3.0, 0.001), (2.0, (quality_rules.RISK - 0.001) / 0.999), (1.0, 0.0)):  # each level contains the stricter ones
                k += int(rng.binomial(good - k, chance))
                rows.append((run, s, level, k))
    table = spark.createDataFrame(pd.DataFrame(rows, columns=["run", "s", "level", "k"])).select("run", F.struct("run", "s").alias("stratum"), "level", "k")
    tested = table.withColumn("p", quality_rules.at_most(F.col("k"), F.lit(good).cast("long"), quality_rules.RISK))
    found = quality_rules.accepted(tested, F.lit(quality_rules.DELTA / strata))
    wrong = found.filter("level < 3").select("run").distinct().count() / times
    assert wrong <= quality_rules.DELTA + 3 * (quality_rules.DELTA * (1 - quality_rules.DELTA) / times) ** 0.5
    assert found.filter("level = 3").count() > 0.9 * times * strata


def test_least_rows_and_large_binomials(spark):
    n = quality_rules.least_rows(4)
    assert 0.98**n <= 0.05 / 4 < 0.98 ** (n - 1) and n == -(-log(0.05 / 4) // log(0.98))
    for k, size, p in [(900, 100_000, 0.01), (0, 217, 0.02), (1, 320, 0.02), (150, 9000, 0.02)]:
        got = spark.range(1).select(quality_rules.at_most(F.lit(k).cast("long"), F.lit(size).cast("long"), p)).first()[0]
        term = total = (1 - p) ** size if size < 10_000 else None
        if term is None:
            from decimal import Decimal, getcontext

            getcontext().prec = 60
            q = Decimal(str(p))
            term = total = (1 - q) ** size
            for i in range(1, k + 1):
                term = term * (size - i + 1) / i * q / (1 - q)
                total += term
        else:
            for i in range(1, k + 1):
                term = term * (size - i + 1) / i * p / (1 - p)
                total += term
        assert abs(got - float(total)) < 1e-8 * float(total) + 1e-300


# ---------------------------------------------------------------- mixing


def test_taken_words_recomputed(spark, monkeypatch):
    """Every draw, slot and permutation again, in plain whole numbers, over more than 1024 shards."""
    monkeypatch.setattr(mixing, "SHARD_SLOTS", 2)
    monkeypatch.setattr(mixing, "CHUNK_ROWS", 64)
    rng = random.Random(7)
    rows = [(i, " ".join(f"w{k}" for k in range(rng.randrange(0, 220))), "en", rng.choice("aaaab") if i % 9 else "c") for i in range(1400)]
    docs = documents(spark, rows)
    got = {r.doc_id: r.taken for r in mixing.mixed_sizes(docs).collect()}
    rank = {r[0]: (r[2], r[1]) for r in docs.select("doc_id", F.xxhash64("doc_id", "text").alias("k")).select("doc_id", "k", F.pmod(F.xxhash64("k"), F.lit(len(rows) // 64))).collect()}
    sizes, names = {i: len(WORD.findall(t)) for i, t, _, _ in rows}, ["a", "b", "c"]
    total = [sum(sizes[i] for i, _, _, s in rows if s == name) for name in names]
    targets = mixing.water_fill(total, [5.0, 2.0, 1.0])
    n_blocks = [-(-n // 64) for n in total]
    slots = [min(round(t * b / n), 3 * b) for t, b, n in zip(targets, n_blocks, total, strict=True)]
    n_shards = -(-sum(slots) // 2)
    assert n_shards > 1024
    runs = defaultdict(list)  # of each source, by shard

    def down(low, high, begin, left):
        if high - low == 1:
            for i in range(3):
                runs[i] += range(begin[i], begin[i] + left[i])
            return
        parts = mixing.parts_of(low, high)
        drawn = mixing.draws([x for x in left if x], [b - a for a, b in parts], [mixing.SEED, low, high])
        some = [i for i in range(3) if left[i]]
        for (a, b), taken in zip(parts, drawn, strict=True):
            part = [0, 0, 0]
            for i, k in zip(some, taken, strict=True):
                part[i] = k
            down(a, b, list(begin), part)
            begin = [x + k for x, k in zip(begin, part, strict=True)]

    down(0, n_shards, [0, 0, 0], slots)
    assert [sorted(runs[i]) for i in range(3)] == [list(range(s)) for s in slots]
    m = 2**64 - 1

    def scramble(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & m
        x = (x ^ x >> 27) * 0x94D049BB133111EB & m
        return x ^ x >> 31

    def place(index, n, key):
        half = max(1, -(-(n - 1).bit_length() // 2))
        while True:
            left, right = index >> half, index & (1 << half) - 1
            for r in range(4):
                left, right = right, left ^ scramble(right + scramble(key + (r * 0x9E3779B97F4A7C15 & m) & m) & m) & (1 << half) - 1
            index = left << half | right
            if index < n:
                return index

    taken = Counter()
    for i, name in enumerate(names):
        times = Counter(place(slot % n_blocks[i], n_blocks[i], i * 1_000_003 + slot // n_blocks[i] + 7919 * mixing.SEED) for slot in runs[i])
        at = 0
        for doc in sorted((d for d, _, _, s in rows if s == name), key=lambda d: rank[d]):
            for k in range(at, at + sizes[doc]):
                taken[doc] += times[k // 64]
            at += sizes[doc]
    assert got == {i: taken[i] for i, *_ in rows}


# ---------------------------------------------------------------- the others


def test_pages_give_their_articles(spark, sf):
    def article(page):
        inner = re.sub(r"<!--.*?-->", "", (re.search(r"<article>(.*?)(?:</article>|$)", page, re.S) or [None, ""])[1], flags=re.S)
        inner = re.sub(r"<[^>]*>", "", re.sub(r"</?(?:h1|p|br)[^>]*>", "\n", inner))
        return " ".join(x for x in (re.sub(r"\s+", " ", html.unescape(y)).strip() for y in inner.split("\n")) if x)

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = {r.page_id: r.text for r in Q.op7_html_extraction(spark, sf).collect()}
    assert got == {i: article(h or "") for i, h in pages.items()}


TEXT = ("This is the text of the page that is for all of you to read and not to miss. " * 4).strip()


def test_main_text_that_once_was_lost():
    japanese = "昨日の夕方、市民たちは市役所の前に集まり、川に新しい橋を架ける計画について話し合った。市長は工事が来年の春に始まると述べた。" * 2
    assert html_text.main_text(f"<body><article><p>A teaser of the thing.</p></article><div id=content><p>{TEXT}</p><p>{TEXT}</p></div></body>") == f"{TEXT} {TEXT}"
    assert html_text.main_text(f"<body><p>{TEXT}</p><p>{japanese}</p></body>") == f"{TEXT} {japanese}"
    for name in ("share-price", "related-work", "article-header"):
        assert html_text.main_text(f"<body><div class='{name}'><p>{TEXT}</p></div></body>") == TEXT
    for name in ("site-header", "comment-list", "related-posts", "cookie-banner", "ad-slot", "share-buttons", "post-comments"):
        assert html_text.main_text(f"<body><p>{TEXT}</p><div class='{name}'><p>{TEXT}</p></div></body>") == TEXT
    references = "<ul><li><a href=x>First reference</a></li><li><a href=y>Second reference</a></li></ul>"
    assert html_text.main_text(f"<article><p>{TEXT}</p>{references}</article>") == f"{TEXT} First reference Second reference"


@pytest.mark.parametrize("page", ["<div>" * 90_000 + "</p>" * 90_000, "<div><b>" * 60_000 + "<p>x</p>" * 60_000, "<li><div>" * 60_000 + "<td>" * 60_000, "<p>" + "word " * 200_000])
def test_deep_and_long_pages_take_linear_time(page):
    began = time.perf_counter()
    html_text.main_text(page)
    assert time.perf_counter() - began < 10


def test_queries_digest(spark, sf):
    for rows, kinds in ((Q.op3_pii(spark, sf).collect(), pii.KINDS), (Q.op8_secret_scan(spark, sf).collect(), secret_scan.BASE)):
        assert rows
        for r in rows:
            assert sum(r[f"n_{k}"] for k in kinds) <= len([x for x in r.spans.split(",") if x])
            if all(x.split(":")[0] in kinds for x in r.spans.split(",") if x) and sum(r[f"n_{k}"] for k in kinds) == len([x for x in r.spans.split(",") if x]):
                assert r.base_sha256 == hashlib.sha256(r.spans.encode()).hexdigest()


def test_top_k_in_several_lots(spark, monkeypatch):
    monkeypatch.setattr(topk, "BROADCAST_BYTES", 2000)
    monkeypatch.setattr(topk, "QUERIES", 4)
    rng = np.random.default_rng(3)
    vectors = {i: [float(x) for x in rng.integers(-2, 3, 12) / 3] for i in range(600)}
    got = Counter(map(tuple, topk.top_k(spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect()))
    whole = {i: np.floor(256 * np.array(v)).astype(int) for i, v in vectors.items()}
    want = Counter()
    for q in range(0, 600, 20):
        best = sorted((-int(whole[q] @ v), i) for i, v in whole.items() if i != q)[:5]
        want.update((q, k, i, -s) for k, (s, i) in enumerate(best, 1))
    assert got == want


def test_components_of_random_graphs(spark):
    rng = random.Random(2)
    for n, m in ((60, 45), (300, 260), (40, 0)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(5, k) for k in range(10, 25)]
        parent = list(range(n))
        find = lambda x: x if parent[x] == x else find(parent[x])
        for a, b in edges:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
        got = {r.node: r.component for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def test_hot_classes_and_large_ids_beside_nulls(spark, monkeypatch):
    monkeypatch.setattr(neardup, "HOT", 5)
    low = 2**60 + 1
    rows = [(low + i, "one text of some words here") for i in range(20)] + [(None, "another text"), (None, None), (low + 50, "a third text that stands alone")]
    got = Counter((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(documents(spark, rows).coalesce(1)).collect())
    assert got == Counter([(low + i, low, i == 0) for i in range(20)] + [(None, None, True)] * 2 + [(low + 50, low + 50, True)])


@pytest.mark.parametrize("budget", [0, common.BROADCAST_BYTES])
def test_hot_leaders_against_brute_force(spark, monkeypatch, budget):
    """Two large groups of near copies, whose leaders are joined apart, and texts that are near to nothing."""
    monkeypatch.setattr(neardup, "HOT", 5)
    monkeypatch.setattr(common, "BROADCAST_BYTES", budget)
    rng = random.Random(8)
    bases = [[f"w{rng.randrange(9999)}" for _ in range(n)] for n in (60, 90)]
    texts = []
    for base in bases:
        for _ in range(70):
            words = list(base)
            for _ in range(rng.choice((0, 1, 1, 2))):
                words[rng.randrange(len(words))] = f"x{rng.randrange(99999)}"
            texts.append(words)
    texts += [[f"y{rng.randrange(9999)}" for _ in range(40)] for _ in range(20)]
    sets = [{tuple(w[i : i + 4]) for i in range(len(w) - 3)} for w in texts]
    root = list(range(len(texts)))
    find = lambda x: x if root[x] == x else find(root[x])
    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(documents(spark, [(i, " ".join(w)) for i, w in enumerate(texts)]), 4).collect()}
    assert got == {i: find(i) for i in range(len(texts))}


def test_pipeline_keeps_different_texts_of_one_id(spark):
    one, two = "one text of the five words and more of them", "quite other words stand here in this one text"
    rows = [(5, one), (5, two), (5, two.replace("quite", "Quite  ")), (5, one), (-7, "a negative id is fine as it is here"), (8, two)]
    got = Counter((r.doc_id, r.text.lower().replace("  ", " ")) for r in corpus_pipeline.dedup(spark, documents(spark, rows), "").collect())
    assert Counter(t.replace("quite  ", "quite ") for _, t in got.elements()) == Counter([one, two, "a negative id is fine as it is here"])


def test_pii_of_a_text_of_many_identifiers(spark):
    """50,000 identifiers in one text: all are found and replaced, in a time that doesn't grow with their square."""
    many = lambda n: " ".join(f"mail u{i}@host{i % 97}.example.com or +1 (212) 555-{i % 9000 + 1000}," for i in range(n // 2))
    took = {}
    for n in (10_000, 50_000):
        docs = spark.createDataFrame([(1, many(n)), (2, "x a@b.cd y"), (1, "other text of it")], "doc_id long, text string")
        began = time.perf_counter()
        found = {(r.doc_id, r.n, r.m) for r in pii.find(docs).select("doc_id", F.size("base").alias("n"), F.size("spans").alias("m")).collect()}
        assert found == {(1, n, n), (2, 1, 1), (1, 0, 0)}
        clean = sorted(r.text for r in pii.redact(docs).collect())
        assert clean == sorted([" ".join("mail <email> or <phone>," for _ in range(n // 2)), "x <email> y", "other text of it"])
        took[n] = time.perf_counter() - began
    assert took[50_000] < 10 * took[10_000]


def test_replaced_stretches(spark):
    """Spans that overlap, touch and hold each other, around the borders of pieces and of runs, against plain Python."""
    rng = random.Random(12)
    rows = []
    for i in range(60):
        text = "".join(rng.choice("ab é\U0001f600\n") for _ in range(rng.choice([1, 30, 5000, 13_000])))
        spans = []
        for _ in range(rng.choice([1, 3, 40, 700])):
            a = rng.randrange(len(text))
            spans.append((a, min(len(text), a + rng.choice([1, 2, 9, 300])), rng.randrange(4)))
        rows.append((i, text, sorted(set(spans))))
    df = spark.createDataFrame(rows, "i int, text string, spans array<struct<start:long,end:long,kind:int>>")
    got = {r.i: r.t for r in df.select("i", pii.replaced(F.col("text"), F.col("spans")).alias("t")).collect()}
    for i, text, spans in rows:
        at, out = 0, []
        for a, b, kind in spans:
            if a >= at:
                out += [text[at:a], f"<{pii.KINDS[kind]}>"]
            at = max(at, b)
        assert got[i] == "".join(out) + text[at:], i


def test_the_base_span_of_an_instance(spark):
    """The first span by kind and start that an instance shares a place with, against a search."""
    rng = random.Random(13)
    rows = []
    for i in range(200):
        base = []
        for kind in range(4):
            at = 0
            for _ in range(rng.randrange(4)):
                at += rng.randrange(6)
                base.append((kind, at, at + rng.randrange(1, 9), rng.randrange(99)))
                at = base[-1][2]
        at, instances = 0, []
        for _ in range(rng.randrange(7)):
            at += rng.randrange(6)
            instances.append((at, at + rng.randrange(1, 5), "x", []))
            at = instances[-1][1]
        rows.append((i, base, instances))
    df = spark.createDataFrame(rows, "i int, base array<struct<kind:int,start:long,end:long,h:long>>, instances array<struct<start:long,end:long,instance:string,patterns:array<string>>>")
    got = {r.i: [x and tuple(x) for x in r.t] for r in df.select("i", pii._touched(F.col("base"), F.col("instances")).alias("t")).collect()}
    for i, base, instances in rows:
        assert got[i] == [next((b for b in base if b[1] < e and b[2] > a), None) for a, e, _, _ in instances], i


def test_scores_are_softmaxes_of_averages(spark):
    """A whole model's scores from plain averages of its vectors, text by text: words, pairs, n-grams and ends counted in Python."""
    rng = random.Random(14)
    texts = ["", None, "one", "one two one two", "é \U0001f600 zz", *(" ".join(rng.choice(["ab", "cde", "ü", "fghij"]) for _ in range(rng.randrange(60))) for _ in range(40))]
    rows = {}

    def row(text, group):  # a feature's row, seen in a text that has no other
        return rows.setdefault((text, group), [x for x in quality_classifier.features([text])[2 * group].tolist() if x not in (quality_classifier.END, quality_classifier.END + quality_classifier.BUCKETS)])

    folded = np.random.default_rng(1).normal(size=2 * quality_classifier.BUCKETS).astype(np.float32)
    got = quality_classifier.score_texts(texts, folded, 0.25)
    for text, score in zip(texts, got, strict=True):
        words = WORD.findall(text or "")
        one = [quality_classifier.END]
        for w in words:
            one += row(w, 0)
        for a, b in zip(words, words[1:], strict=False):  # two words make three features: the pair's is the one that isn't theirs
            left = Counter(quality_classifier.features([f"{a} {b}"])[0].tolist())
            left.subtract([quality_classifier.END, *row(a, 0), *row(b, 0)])
            one += [x for x, n in left.items() if n > 0]
        two = [quality_classifier.END + quality_classifier.BUCKETS]
        for w in words:
            two += row(w, 1)
        assert len(one) == 1 + len(words) + max(0, len(words) - 1) and len(two) == 1 + sum(len(w) + 3 - n for w in words for n in quality_classifier.GRAMS if n < len(w) + 2)
        logit = sum(float(folded[x]) for x in one) / len(one) + sum(float(folded[x]) for x in two) / len(two) + 0.25
        assert score == pytest.approx(1 / (1 + np.exp(-logit)), abs=1e-6)


def test_a_step_goes_down_the_gradient():
    """Against differences of the loss for each number of the table, the layer and the bias."""
    rng = np.random.default_rng(2)
    table, layer, bias = rng.normal(size=(6, 3)), rng.normal(size=(3, 2)), rng.normal(size=2)
    rows, w, label, small = np.array([0, 2, 5]), np.array([0.5, 1.0, 0.5]), 1, 1e-6

    def loss(t, f, b):
        logits = w @ t[rows] @ f + b
        return np.log(np.exp(logits).sum()) - logits[label]

    after = [table.copy(), layer.copy(), bias.copy()]
    quality_classifier.step(*after, rows, w, label, 0.1, 2.0)
    for k, (own, new, speed) in enumerate(zip((table, layer, bias), after, (quality_classifier.BOOST, 1, 1), strict=True)):
        for at in np.ndindex(own.shape):
            moved = [table.copy(), layer.copy(), bias.copy()]
            moved[k][at] += small
            slope = (loss(*moved) - loss(table, layer, bias)) / small
            assert own[at] - new[at] == pytest.approx(0.2 * speed * slope, abs=1e-4)
